"""Kendall's tau-b of series of any length, spread over partitions.

Repeated points are reduced to one row with a weight. The rows get two positions, one in the order
(x, y) and one in the order (y, x): with these orders ties count for nothing, and a discordant pair is
exactly one whose two positions disagree. Both orders are cut into blocks of a bounded number of rows.
A discordant pair then lies in two different blocks of both orders (counted from a histogram of blocks
by blocks), or in one block of the second order (counted inside it), or in one block of the first order
and two of the second (counted inside the first). No block holds more rows than its size, whatever
values are frequent, because rows of equal x or y still have positions of their own.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from panelstats.functions.pvalues import kendall_exact, kendall_p_of_sums
from panelstats.functions.scalar import nan_to_null
from panelstats.operators.trend import finite_points
from panelstats.session import materialise

BLOCK_ROWS, MOST_BLOCKS = 1 << 16, 2048  # a block has so many rows; more, once there are so many blocks


def weighted_inversions(values: np.ndarray, weights: np.ndarray) -> int:
    """Sum of weights[i] * weights[j] over i < j with values[i] > values[j]; the values differ."""
    order = np.argsort(values, kind="stable")
    rank = np.empty(len(values), np.int64)
    rank[order] = np.arange(len(values))
    weights, n, width, total = np.asarray(weights, np.int64), len(rank), 1, 0
    place = np.arange(n)
    while width < n:
        block, right = place // (2 * width), (place // width) % 2 == 1
        keys = block * n + rank
        left_keys, sums = keys[~right], np.r_[0, np.cumsum(weights[~right])]
        ends = np.searchsorted(left_keys, (block[right] + 1) * n)
        upto = np.searchsorted(left_keys, keys[right])
        total += int(((sums[ends] - sums[upto]) * weights[right]).sum())
        order = np.argsort(keys, kind="stable")
        rank, weights = rank[order], weights[order]
        width *= 2
    return total


def numbered(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """Adds the row's position, from 0, in the given order of the whole table: one shuffle by range."""
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order)
    stored = materialise(ordered.withColumn("_id", F.monotonically_increasing_id()), name.strip("_"))
    part = F.shiftright("_id", 33)  # the upper bits of these ids are the partition, the lower the row in it
    sizes = stored.groupBy(part.alias("_p")).agg(F.count("*").alias("_size"))
    # one row for each partition
    ahead = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_p", F.coalesce(F.sum("_size").over(ahead), F.lit(0)).alias("_start"))
    row = F.col("_id") - F.shiftleft(part, 33)
    return stored.withColumn("_p", part).join(starts, "_p").withColumn(name, F.col("_start") + row).drop("_p", "_id", "_start")


def _kernels(by: Sequence[str]):
    def result(frame: pd.DataFrame, count: int) -> pd.DataFrame:
        return pd.DataFrame({**{c: [frame[c].iloc[0]] for c in by}, "discordant": [count]})

    def second_block(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("_first")
        return result(frame, weighted_inversions(frame["_second"].to_numpy(), frame["_w"].to_numpy()))

    def first_block(frame: pd.DataFrame) -> pd.DataFrame:
        whole, cells = frame.sort_values("_first"), frame.sort_values(["_q", "_first"])
        count = [weighted_inversions(f["_second"].to_numpy(), f["_w"].to_numpy()) for f in (whole, cells)]
        return result(frame, count[0] - count[1])

    def across(frame: pd.DataFrame) -> pd.DataFrame:
        a, q = (np.unique(frame[c], return_inverse=True)[1] for c in ("_a", "_q"))
        cells = np.zeros((a.max() + 1, q.max() + 1), np.int64)
        cells[a, q] = frame["_w"]
        later = np.cumsum(cells[:, ::-1], axis=1)[:, ::-1] - cells  # in the same first block, of larger second blocks
        above = np.cumsum(later, axis=0) - later  # and of smaller first blocks
        return result(frame, int((cells * above).sum()))

    return second_block, first_block, across


def _tie_sums(reduced: DataFrame, by: Sequence[str], keys: Sequence[str], name: str) -> DataFrame:
    """Sums over tied values: pairs, triples and the weights of the variance."""
    t = F.col("_t")
    sizes = reduced.groupBy(*by, *keys).agg(F.sum("_w").cast("double").alias("_t"))
    return sizes.groupBy(*by).agg(
        F.sum(t * (t - 1) / 2).alias(f"{name}_pairs"), F.sum(t * (t - 1) * (t - 2)).alias(f"{name}_triples"),
        F.sum(t * (t - 1) * (2 * t + 5)).alias(f"{name}_weights"))


@F.pandas_udf(DoubleType())
def _p_value(n: pd.Series, score: pd.Series, discordant: pd.Series, xp: pd.Series, xt: pd.Series, xw: pd.Series,
             yp: pd.Series, yt: pd.Series, yw: pd.Series) -> pd.Series:
    out = []
    for n_, s, d, *sums in zip(n, score, discordant, xp, xt, xw, yp, yt, yw):
        n_, d = int(n_), int(d)
        exact = not sums[0] and not sums[3] and (n_ <= 33 or min(d, n_ * (n_ - 1) // 2 - d) <= 1)
        out.append(kendall_exact(n_, d) if exact else kendall_p_of_sums(s, n_, sums[:3], sums[3:]))
    return pd.Series(out)


def kendall_long(df: DataFrame, by: Sequence[str], x: str, y: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(by, n, discordant, score, kendall_tau, kendall_p): as trend_robust's tau and p, for series too long for one row.

    Points with a missing or non-finite side, and groups with a missing key, are left out. score: concordant less
    discordant pairs. tau and p are missing below three points and where either side does not vary.
    """
    by = list(by)
    if not by:
        return kendall_long(df.withColumn("_all", F.lit(0)), ["_all"], x, y, block_rows).drop("_all")
    reduced = finite_points(df, by, x, y).groupBy(*by, "_x", "_y").agg(F.count("*").alias("_w"))
    first = numbered(reduced, [*by, "_x", "_y"], "_first")
    placed = materialise(numbered(first, [*by, "_y", "_x"], "_second"), "placed")
    size = max(block_rows, math.ceil(placed.count() / MOST_BLOCKS))
    blocks = placed.withColumn("_a", F.floor(F.col("_first") / size)).withColumn("_q", F.floor(F.col("_second") / size))
    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in placed.schema.fields if f.name in by]
    schema = ", ".join([*kinds, "discordant long"])
    second_block, first_block, across = _kernels(by)
    narrow = blocks.select(*by, "_first", "_second", "_a", "_q", "_w")
    cells = narrow.groupBy(*by, "_a", "_q").agg(F.sum("_w").alias("_w"))
    # the histogram of a group has at most MOST_BLOCKS rows and columns
    counts = (narrow.groupBy(*by, "_q").applyInPandas(second_block, schema)
              .unionByName(narrow.groupBy(*by, "_a").applyInPandas(first_block, schema))
              .unionByName(cells.groupBy(*by).applyInPandas(across, schema)))
    discordant = counts.groupBy(*by).agg(F.sum("discordant").alias("discordant"))
    found = placed.groupBy(*by).agg(F.sum("_w").alias("n"))
    for other in (discordant, _tie_sums(placed, by, ["_x"], "x"), _tie_sums(placed, by, ["_y"], "y"),
                  _tie_sums(placed, by, ["_x", "_y"], "both")):
        found = found.join(other, by)
    n = F.col("n").cast("double")
    pairs = n * (n - 1) / 2
    score: Column = pairs - F.col("x_pairs") - F.col("y_pairs") + F.col("both_pairs") - 2 * F.col("discordant")
    scale = F.sqrt(pairs - F.col("x_pairs")) * F.sqrt(pairs - F.col("y_pairs"))
    enough = (F.col("n") >= 3) & (scale > 0)
    tau = F.least(F.greatest(F.col("score") / scale, F.lit(-1.0)), F.lit(1.0))
    sums = [f"{side}_{kind}" for side in ("x", "y") for kind in ("pairs", "triples", "weights")]
    scored = found.withColumn("score", score).withColumn("_p", _p_value("n", "score", "discordant", *sums))
    return scored.select(*by, "n", "discordant", F.col("score").cast("long").alias("score"), F.when(enough, tau).alias("kendall_tau"),
                         F.when(enough, nan_to_null("_p")).alias("kendall_p"))
