"""Residual block bootstrap of a straight-line slope, without a sequential generator.

Block starts come from MD5 of the text "seed|series|block length|replicate|four blocks",
whose 32 hex digits give four starts, so a replicate is the same on every attempt, under
any partitioning, and in any engine that knows MD5.
The slope is linear in the data: refitting fitted + resampled residuals equals the
observed slope plus the weighted sum of the resampled residuals, so a batch of
replicates is one gather and one matrix product, and nothing is regrouped.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from panelstats.operators.trend import detrend, residual_memory

BATCH = 500  # replicates per row of work

DRAWS = 4  # block starts that one digest gives, each from eight hex digits


def circular_positions(key: str, n: int, block_length: int, replicates: np.ndarray) -> np.ndarray:
    """(replicate, place) -> source position: blocks of consecutive places from random
    starts, wrapping round at n, cut off when n places are filled."""
    place = np.arange(n)
    digests = -(-n // (block_length * DRAWS))
    begun = hashlib.md5(f"{key}|".encode())
    raw = []
    for r in replicates.tolist():
        for d in range(digests):
            one = begun.copy()
            one.update(b"%d|%d" % (r, d))
            raw.append(one.digest())
    starts = np.frombuffer(b"".join(raw), ">u4").reshape(len(replicates), -1).astype(np.int64) % n
    return (starts[:, place // block_length] + place % block_length) % n


@F.pandas_udf(ArrayType(DoubleType()))
def batch_slopes(
    key: pd.Series, slope: pd.Series, e: pd.Series, w: pd.Series, length: pd.Series, first: pd.Series, last: pd.Series
) -> pd.Series:
    out = []
    for k, s, resid, weight, size, lo, hi in zip(key, slope, e, w, length, first, last):
        at = circular_positions(k, len(resid), int(size), np.arange(lo, hi + 1))
        out.append(s + np.asarray(resid, float)[at] @ np.asarray(weight, float))
    return pd.Series(out)


def slope_batches(
    df: DataFrame, by: Sequence[str], x: str, y: str,
    block_lengths: Sequence[int], n_boot: int, seed: int,
) -> DataFrame:
    """(by, block_length, observed_slope, slopes): one row per batch of replicates."""
    line = detrend(df, by, x, y).withColumn("_x", F.col(x).cast("double"))
    packed = line.groupBy(*by).agg(
        F.count("*").alias("_n"),
        F.array_sort(F.collect_list(F.struct("_x", F.col("residual").alias("e")))).alias("_p"),
        F.avg("_x").alias("_mx"),
        (F.var_pop("_x") * F.count("*")).alias("_sxx"),
        F.regr_slope(F.col(y).cast("double"), F.col("_x")).alias("observed_slope"),
    ).where("_n >= 3 and _sxx > 0")
    series = packed.select(
        *by, "observed_slope", F.col("_p.e").alias("_e"),
        F.transform("_p._x", lambda v: (v - F.col("_mx")) / F.col("_sxx")).alias("_w"),
    )
    # Small work units, spread evenly: one per series, block length and batch. The rows are
    # light and the work is not, so the number of tasks is named and not left to row sizes.
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    work = (
        series.withColumn("block_length", F.explode(F.array(*[F.lit(int(b)) for b in block_lengths])))
        .withColumn("_batch", F.explode(F.sequence(F.lit(0), F.lit((n_boot - 1) // BATCH))))
        .repartition(tasks, *by, "block_length", "_batch")
    )
    first = F.col("_batch") * BATCH
    last = F.least(first + BATCH, F.lit(n_boot)) - 1
    key = F.concat_ws("|", F.lit(str(seed)), *[F.col(b).cast("string") for b in by], F.col("block_length").cast("string"))
    slopes = batch_slopes(key, "observed_slope", "_e", "_w", "block_length", first, last)
    return work.select(*by, "block_length", "observed_slope", slopes.alias("slopes"))


def replicate_slopes(
    df: DataFrame, by: Sequence[str], x: str, y: str,
    block_lengths: Sequence[int], n_boot: int, seed: int,
) -> DataFrame:
    """(by, block_length, observed_slope, slope): one row per replicate."""
    batches = slope_batches(df, by, x, y, block_lengths, n_boot, seed)
    return batches.select(*by, "block_length", "observed_slope", F.explode("slopes").alias("slope"))


def block_bootstrap(
    df: DataFrame, by: Sequence[str], x: str, y: str,
    block_lengths: Sequence[int] = (3, 4, 5), n_boot: int = 20_000, seed: int = 1,
) -> DataFrame:
    """Per series and block length: observed slope, residual memory, bootstrap median,
    2.5 % and 97.5 % quantiles and the share of negative slopes.

    The replicates of a series come together again as one array of ``n_boot`` numbers.
    """
    batches = slope_batches(df, by, x, y, block_lengths, n_boot, seed)
    whole = batches.groupBy(*by, "block_length").agg(
        F.first("observed_slope").alias("observed_slope"),
        F.sort_array(F.flatten(F.collect_list("slopes"))).alias("_s"),
    )

    def quantile(p: float) -> Column:
        at = p * (n_boot - 1)
        low = math.floor(at)
        a, b = F.element_at("_s", low + 1), F.element_at("_s", min(low + 2, n_boot))
        return a + (b - a) * (at - low)

    negative = F.size(F.filter("_s", lambda v: v < 0)) / F.size("_s")
    memory = residual_memory(df, by, x, y).select(*by, "lag1", "durbin_watson")
    return whole.join(memory, list(by)).select(
        *by, "block_length", "observed_slope", F.col("lag1").alias("residual_lag1"), "durbin_watson",
        quantile(0.5).alias("median_slope"), quantile(0.025).alias("low95"), quantile(0.975).alias("high95"),
        negative.alias("share_negative"),
    )
