"""Baseline contrasts, two-period pairs, nested rollups and direction checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelstats.functions.scalar import percent_change, ratio, same_sign


def contrast(
    df: DataFrame,
    by: Sequence[str],
    group: str,
    baseline: str,
    metrics: Sequence[str],
    on_missing: str = "error",
    guard: bool = True,
) -> DataFrame:
    """Every row of a summary against the baseline row of the same ``by``.

    ``on_missing``: 'error' aborts when a stratum lacks exactly one baseline row,
    'skip' leaves that stratum out. The input holds one row per (by, group); the
    baseline is picked up in the same pass that groups the strata.
    """
    stratum = Window.partitionBy(*by)
    is_base = F.col(group) == baseline
    n_base = F.count_if(is_base).over(stratum)
    marked = df.withColumn("_n_base", n_base)
    for m in metrics:
        marked = marked.withColumn(f"{m}_baseline", F.max(F.when(is_base, F.col(m))).over(stratum))
    if on_missing == "error":
        fail = F.raise_error(F.lit(f"a stratum lacks exactly one {baseline} row")).cast("boolean")
        marked = marked.where(F.when(F.col("_n_base") == 1, F.lit(True)).otherwise(fail))
    else:
        marked = marked.where(F.col("_n_base") == 1)
    out = marked.drop("_n_base")
    for m in metrics:
        base = f"{m}_baseline"
        out = out.withColumn(f"{m}_difference", F.col(m) - F.col(base))
        out = out.withColumn(f"{m}_percent", percent_change(base, m, guard))
    return out


def period_pair(
    df: DataFrame,
    entity: Sequence[str],
    period: str,
    a: object,
    b: object,
    metrics: Sequence[str],
    on_missing: str = "skip",
) -> DataFrame:
    """Long (entity, metric): value in a, value in b, change, percent, ratio.

    An entity that lacks one of the periods is left out, or aborts the query.
    """
    wide = df.where(F.col(period).isin(a, b)).dropna(subset=list(entity)).groupBy(*entity).agg(
        F.count_if(F.col(period) == a).alias("_na"),
        F.count_if(F.col(period) == b).alias("_nb"),
        *[
            F.struct(
                F.max(F.when(F.col(period) == a, F.col(m))).cast("double").alias("value_a"),
                F.max(F.when(F.col(period) == b, F.col(m))).cast("double").alias("value_b"),
            ).alias(m)
            for m in metrics
        ],
    )
    both = (F.col("_na") > 0) & (F.col("_nb") > 0)
    if on_missing == "error":
        wide = wide.where(F.when(both, F.lit(True)).otherwise(F.raise_error(F.lit("entity lacks a period")).cast("boolean")))
    else:
        wide = wide.where(both)
    long = wide.unpivot(list(entity), list(metrics), "metric", "v").select(*entity, "metric", "v.*")
    return (
        long.withColumn("change", F.col("value_b") - F.col("value_a"))
        .withColumn("percent_change", percent_change("value_a", "value_b"))
        .withColumn("ratio", ratio("value_a", "value_b"))
    )


def direction_consistency(
    df: DataFrame, entity: Sequence[str], period: str, a: object, b: object, difference: str
) -> DataFrame:
    """Does a difference point the same way in two periods?"""
    pair = period_pair(df, entity, period, a, b, [difference])
    return pair.select(
        *entity,
        F.col("value_a").alias("difference_a"),
        F.col("value_b").alias("difference_b"),
        same_sign("value_a", "value_b").alias("same_direction"),
    )


def unit_means(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Innermost level: rows (missing values included), mean, min and max per unit."""
    return df.dropna(subset=list(by)).groupBy(*by).agg(
        F.count("*").alias("n_subunits"),
        F.avg(value).alias("unit_mean"),
        F.min(value).alias("unit_min"),
        F.max(value).alias("unit_max"),
    )


def group_of_means(df: DataFrame, by: Sequence[str], mean: str = "unit_mean") -> DataFrame:
    """Outer level: mean of unit means, sd between units, extremes."""
    return df.groupBy(*by).agg(
        F.count("*").alias("n_units"),
        F.avg(mean).alias("mean_value"),
        F.stddev_samp(mean).alias("sd_between"),
        F.min(mean).alias("min_unit_mean"),
        F.max(mean).alias("max_unit_mean"),
    )


def rollup_nested(df: DataFrame, outer: Sequence[str], inner: Sequence[str], value: str) -> DataFrame:
    """Sub-units to units to groups. The groups average unit means, never sub-units."""
    return group_of_means(unit_means(df, [*outer, *inner], value), outer)


def common_index(
    units: DataFrame, by: Sequence[str], unit: Sequence[str], stratum: str, strata: Sequence[str]
) -> DataFrame:
    """Equal-weight mean of each unit over the strata shared by all periods."""
    shared = units.where(F.col(stratum).isin(list(strata)))
    return shared.groupBy(*by, *unit).agg(
        F.countDistinct(stratum).alias("n_strata"), F.avg("unit_mean").alias("index_mean")
    )


def common_index_groups(units: DataFrame, by: Sequence[str], unit: Sequence[str], stratum: str,
                        strata: Sequence[str]) -> DataFrame:
    """Second level of the index: mean, sd, extremes over the units of each group."""
    return group_of_means(common_index(units, by, unit, stratum, strata), by, "index_mean")


def primary_stratum(df: DataFrame, stratum: str, value: str) -> DataFrame:
    return df.where(F.col(stratum) == value)
