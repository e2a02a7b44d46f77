"""Pearson and Spearman families on aligned daily series, and sensor coherence.

Series come with one row per group and date, so a ranking window holds no more
rows than there are days.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelstats.functions.scalar import nan_to_null, pearson
from panelstats.operators.distribution import distribution, present, ranks_of_counts
from panelstats.session import materialise


SENSORS_PER_TILE = 512


def avg_rank(value: str, by: Sequence[str]) -> Column:
    """Tie-averaged rank inside the group."""
    ordered = Window.partitionBy(*by).orderBy(value)
    ties = F.count("*").over(Window.partitionBy(*by, value))
    return F.rank().over(ordered) + (ties - 1) / 2


def _complete_pairs(pairs: DataFrame) -> DataFrame:
    clean = pairs.withColumn("x", nan_to_null("x")).withColumn("y", nan_to_null("y"))
    return clean.where("x is not null and y is not null")


def correlate_pairs(pairs: DataFrame, by: Sequence[str], long_series: bool = False) -> DataFrame:
    """Pairs (by, x, y) to n, Pearson r and Spearman rho on complete pairs.

    ``long_series`` ranks without a per-group window, for groups of any size.
    """
    complete = _complete_pairs(pairs)
    if long_series:
        return _correlate_reduced(complete, by)
    ranked = complete.select(*by, "x", "y", avg_rank("x", by).alias("rx"), avg_rank("y", by).alias("ry"))
    return ranked.groupBy(*by).agg(
        F.count("*").alias("n"),
        pearson("x", "y").alias("pearson_r"),
        pearson("rx", "ry").alias("spearman_rho"),
    )


def _with_group(rows: DataFrame, groups: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows with the columns of their group's only row; without groups that is one row for all."""
    if by:
        return rows.join(groups, list(by))
    return rows.withColumn("_one", F.lit(1)).join(groups.withColumn("_one", F.lit(1)), "_one").drop("_one")


def _correlate_reduced(complete: DataFrame, by: Sequence[str]) -> DataFrame:
    """Correlations of groups of any size from two scans, each reduced before it is shuffled.

    The first scan leaves (by, y, count), which is ranked; the second brings each pair the distances of its
    y and of its y's rank from their means, and leaves their sums for each (by, x). A sum over pairs is then one
    over different x, so no rank of x ever meets a pair. What a later step reads several times is written
    once; a table of ranks that turns out small is thereby sent to the pairs, which then stay where they are.
    Least work where y has the fewer different values. Sums are of distances from the means, so large offsets
    lose no digits.
    """
    complete = present(complete, by)
    c, v = F.col("_c"), F.col("_v")
    ys = materialise(complete.groupBy(*by, F.col("y").alias("_v")).agg(F.count("*").alias("_c"), F.sum("x").alias("_sx")), "y-counts")
    groups = materialise(ys.groupBy(*by).agg(
        F.sum("_c").alias("n"), (F.sum("_sx") / F.sum("_c")).alias("_mx"), (F.sum(c * v) / F.sum("_c")).alias("_my")), "groups")
    mid = (F.col("n") + 1) / 2
    ranked = _with_group(ranks_of_counts(ys.drop("_sx"), by, keep=["_c"]), groups, by)
    y = materialise(ranked.select(
        *by, v.alias("y"), c, (v - F.col("_my")).alias("_dy"), (F.col("avg_rank") - mid).alias("_dr")), "y-ranks")
    xs = materialise(complete.join(y.drop("_c"), [*by, "y"]).groupBy(*by, F.col("x").alias("_v")).agg(
        F.count("*").alias("_c"), F.sum("_dy").alias("_sy"), F.sum("_dr").alias("_sr")), "x-sums")

    dx, dr = v - F.col("_mx"), F.col("avg_rank") - mid
    of_x = _with_group(ranks_of_counts(xs, by, keep=["_c", "_sy", "_sr"]), groups, by).groupBy(*by).agg(
        F.first("n").alias("n"), (F.min("_v") < F.max("_v")).alias("_x_varies"),
        F.sum(dx * F.col("_sy")).alias("_xy"), F.sum(c * dx * dx).alias("_xx"),
        F.sum(dr * F.col("_sr")).alias("_rxy"), F.sum(c * dr * dr).alias("_rxx"))
    of_y = y.groupBy(*by).agg(
        (F.min("y") < F.max("y")).alias("_y_varies"),
        F.sum(c * F.col("_dy") * F.col("_dy")).alias("_yy"), F.sum(c * F.col("_dr") * F.col("_dr")).alias("_ryy"))

    # whether a side varies is told by its extremes: a mean of equal values need not equal them to the last bit
    varies = F.col("_x_varies") & F.col("_y_varies")

    def r(xy: str, xx: str, yy: str) -> Column:
        raw = F.try_divide(F.col(xy), F.sqrt(xx) * F.sqrt(yy))
        return F.when(varies, F.least(F.greatest(raw, F.lit(-1.0)), F.lit(1.0)))

    return _with_group(of_x, of_y, by).select(
        *by, "n", r("_xy", "_xx", "_yy").alias("pearson_r"), r("_rxy", "_rxx", "_ryy").alias("spearman_rho"))


def correlate(
    df: DataFrame, by: Sequence[str], target: str, variables: Sequence[str], long_series: bool = False
) -> DataFrame:
    """Target against each variable, same row."""
    base = df.dropna(subset=list(by)).select(
        *by, F.col(target).cast("double").alias("_y"), *[F.col(v).cast("double").alias(v) for v in variables]
    )
    pairs = base.unpivot([*by, "_y"], list(variables), "variable", "x").withColumnRenamed("_y", "y")
    return correlate_pairs(pairs, [*by, "variable"], long_series)


def shift_rows(value: str, k: int, by: Sequence[str], order: str) -> Column:
    """Value k rows earlier."""
    return F.lag(value, k).over(Window.partitionBy(*by).orderBy(order))


def shift_days(value: str, k: int, by: Sequence[str], date: str) -> Column:
    """Value exactly k calendar days earlier; missing when that day has no row."""
    day = F.datediff(F.col(date), F.lit("1970-01-01").cast("date"))
    return F.max(value).over(Window.partitionBy(*by).orderBy(day).rangeBetween(-k, -k))


def lagged_pairs(
    df: DataFrame, by: Sequence[str], order: str, target: str, variables: Sequence[str],
    lags: Sequence[int], mode: str = "row",
) -> DataFrame:
    """Long (by, variable, lag, x, y): x is the variable, lag rows (or days) earlier."""
    shift = shift_rows if mode == "row" else shift_days
    wide = df.dropna(subset=list(by)).select(
        *by,
        F.col(target).cast("double").alias("y"),
        *[shift(v, k, by, order).cast("double").alias(f"{v}@{k}") for v in variables for k in lags],
    )
    items = F.array(*[
        F.struct(F.lit(v).alias("variable"), F.lit(k).alias("lag"), F.col(f"`{v}@{k}`").alias("x"))
        for v in variables for k in lags
    ])
    return wide.select(*by, "y", F.inline(items))


def correlate_lagged(
    df: DataFrame, by: Sequence[str], order: str, target: str, variables: Sequence[str],
    lags: Sequence[int] = (0, 1, 3, 7), mode: str = "row",
) -> DataFrame:
    """Correlations with the variable shifted; ranks are taken anew for each lag."""
    return correlate_pairs(lagged_pairs(df, by, order, target, variables, lags, mode), [*by, "variable", "lag"])


def correlate_differences(
    df: DataFrame, by: Sequence[str], order: str, target: str, variables: Sequence[str]
) -> DataFrame:
    """Correlations of row-to-row changes of both sides."""
    w = Window.partitionBy(*by).orderBy(order)
    change = lambda c: (F.col(c) - F.lag(c).over(w)).cast("double")
    diffs = df.dropna(subset=list(by)).select(
        *by, change(target).alias("_y"), *[change(v).alias(v) for v in variables]
    )
    pairs = diffs.unpivot([*by, "_y"], list(variables), "variable", "x").withColumnRenamed("_y", "y")
    return correlate_pairs(pairs, [*by, "variable"])


def best_lag(lagged: DataFrame, by: Sequence[str]) -> DataFrame:
    """Lag of the largest absolute rho per group; the smallest lag wins ties."""
    valid = lagged.where("spearman_rho is not null")
    order = F.struct(F.abs("spearman_rho"), -F.col("lag"))
    row = F.struct("lag", "spearman_rho", "pearson_r", "n")
    picked = valid.groupBy(*by).agg(F.max_by(row, order).alias("b"))
    return picked.select(*by, F.col("b.lag").alias("best_lag"), "b.spearman_rho", "b.pearson_r", "b.n")


# ---- coherence of many sensors -------------------------------------------

def _block_products(by: Sequence[str], entity: str):
    """Sums needed for the sensor pairs of one block of dates and one pair of tiles.

    Matrix products over (dates x sensors): masks make them pairwise complete.
    """
    def kernel(block: pd.DataFrame) -> pd.DataFrame:
        first = block.iloc[0]
        x = block.pivot(index="_date", columns=entity, values="v").sort_index(axis=1)
        tile = block.drop_duplicates(entity).set_index(entity)["_tile"].reindex(x.columns).to_numpy()
        names, values = x.columns.to_numpy(), x.to_numpy(float)
        mask = (~np.isnan(values)).astype(float)
        filled = np.where(mask > 0, values, 0.0)
        n = mask.T @ mask
        sx, sxx, sxy = filled.T @ mask, (filled ** 2).T @ mask, filled.T @ filled
        i, j = np.triu_indices(len(names), k=1)
        across = (tile[i] != tile[j]) | (first["_ti"] == first["_tj"])
        i, j = i[across & (n[i, j] > 0)], j[across & (n[i, j] > 0)]
        out = pd.DataFrame({
            "a": names[i], "b": names[j], "n": n[i, j],
            "sa": sx[i, j], "sb": sx[j, i], "saa": sxx[i, j], "sbb": sxx[j, i], "sab": sxy[i, j],
        })
        for c in by:
            out[c] = first[c]
        return out
    return kernel


def tiles_for(df: DataFrame, entity: str, sensors_per_tile: int = SENSORS_PER_TILE) -> int:
    """How many tiles the sensors of a table are dealt to, so that one holds about ``sensors_per_tile``; counts them."""
    n = df.select(entity).where(F.col(entity).isNotNull()).distinct().count()
    return max(1, math.ceil(n / sensors_per_tile))


def correlation_matrix(
    df: DataFrame, by: Sequence[str], date: str, entity: str, value: str,
    block_days: int = 64, tiles: int | None = None, sensors_per_tile: int = SENSORS_PER_TILE,
) -> DataFrame:
    """Long pairwise-complete Pearson matrix (by, a, b, n, r) with a < b.

    Dates are cut into blocks and sensors into tiles; a block of dates and a pair of tiles
    yields one row of sums per sensor pair, and the blocks' sums are added. A task holds two
    tiles of sensors at a time. Without ``tiles`` their number follows from that of the
    sensors, which are counted first. Repeated readings of a sensor and date are averaged.
    """
    tiles = tiles_for(df, entity, sensors_per_tile) if tiles is None else tiles
    daily = df.dropna(subset=[*by, date, entity]).groupBy(*by, date, entity).agg(
        F.avg(F.col(value).cast("double")).alias("v")
    )
    # shifting a sensor by its own typical value keeps the sums small and r unchanged
    level = daily.groupBy(*by, entity).agg(F.avg("v").alias("level"))
    day = F.datediff(F.col(date).cast("date"), F.lit("1970-01-01").cast("date"))
    tile = F.pmod(F.xxhash64(entity), F.lit(tiles)).cast("int")
    partners = F.sequence(F.lit(0), F.lit(tiles - 1))
    centred = daily.join(level, [*by, entity]).where("v is not null").select(
        *by, entity, day.alias("_date"), (F.col("v") - F.col("level")).alias("v"),
        F.floor(day / block_days).alias("_block"), tile.alias("_tile"), F.explode(partners).alias("_other"),
    )
    blocks = centred.withColumn("_ti", F.least("_tile", "_other")).withColumn("_tj", F.greatest("_tile", "_other"))
    kind = daily.schema[entity].dataType.simpleString()
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in daily.schema.fields if f.name in by]
    sums = ["n", "sa", "sb", "saa", "sbb", "sab"]
    schema = ", ".join([*fields, f"a {kind}", f"b {kind}", *[f"{s} double" for s in sums]])
    parts = blocks.groupBy(*by, "_block", "_ti", "_tj").applyInPandas(_block_products(by, entity), schema)
    t = parts.groupBy(*by, "a", "b").agg(*[F.sum(s).alias(s) for s in sums])
    cov = F.col("sab") - F.col("sa") * F.col("sb") / F.col("n")
    va = F.greatest(F.col("saa") - F.col("sa") * F.col("sa") / F.col("n"), F.lit(0.0))
    vb = F.greatest(F.col("sbb") - F.col("sb") * F.col("sb") / F.col("n"), F.lit(0.0))
    r = F.try_divide(cov, F.sqrt(va) * F.sqrt(vb))
    bounded = F.least(F.greatest(r, F.lit(-1.0)), F.lit(1.0))
    return t.select(*by, "a", "b", F.col("n").cast("bigint").alias("n"), F.when(r.isNotNull(), bounded).alias("r"))


def pivot_matrix(matrix: DataFrame, by: Sequence[str], entities: Sequence[str]) -> DataFrame:
    """Square presentation of the long matrix, with ones on the diagonal."""
    mirrored = matrix.select(*by, "a", "b", "r").unionByName(
        matrix.select(*by, F.col("b").alias("a"), F.col("a").alias("b"), "r")
    )
    diagonal = mirrored.select(*by, "a").dropDuplicates().select(
        *by, "a", F.col("a").alias("b"), F.lit(1.0).alias("r")
    )
    return mirrored.unionByName(diagonal).groupBy(*by, "a").pivot("b", list(entities)).agg(F.first("r"))


def correlation_summary(matrix: DataFrame, by: Sequence[str]) -> DataFrame:
    """Finite upper triangle per group: mean, exact median, extremes, and number of sensors.

    The pairs grow with the square of the sensors, so the median is not gathered in one
    place. Both parts read the matrix: hand in a stored one when it is costly.
    """
    ends = F.explode(F.array("a", "b"))
    n = matrix.select(*by, ends.alias("e")).dropDuplicates().groupBy(*by).agg(F.count("*").alias("n_entities"))
    r = distribution(matrix.where("r is not null"), by, ["r"], {"median": 0.5}).select(
        *by, F.col("n").alias("n_pairs"), F.col("mean").alias("mean_r"), F.col("median").alias("median_r"),
        F.col("min").alias("min_r"), F.col("max").alias("max_r"),
    )
    # without groups both sides are a single row
    if by:
        return n.join(r, list(by), "left")
    return n.withColumn("_one", F.lit(1)).join(r.withColumn("_one", F.lit(1)), "_one", "left").drop("_one")
