"""Unit-by-period panels: coverage, balanced subset, period summaries, block changes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelstats.functions.scalar import is_finite, percent_change, standard_error
from panelstats.operators.distribution import distribution, distribution_of_counts, value_counts
from panelstats.operators.joins import restrict_to_keys


def coverage(df: DataFrame, key: Sequence[str], period: str) -> DataFrame:
    """Distinct periods per key."""
    return (
        df.dropna(subset=[*key, period]).select(*key, period).dropDuplicates()
        .groupBy(*key).agg(F.count("*").alias("n_periods"))
    )


def coverage_histogram(df: DataFrame, key: Sequence[str], period: str) -> DataFrame:
    """Number of keys per coverage level."""
    return coverage(df, key, period).groupBy("n_periods").agg(F.count("*").alias("n_keys"))


def balanced_keys(df: DataFrame, key: Sequence[str], period: str, n_periods: int) -> DataFrame:
    return coverage(df, key, period).where(F.col("n_periods") == n_periods).select(*key)


def balanced_panel(df: DataFrame, key: Sequence[str], period: str, n_periods: int) -> DataFrame:
    """Rows of the keys present in every period."""
    return restrict_to_keys(df, balanced_keys(df, key, period, n_periods), key)


def mark_balanced(df: DataFrame, key: Sequence[str], period: str, n_periods: int) -> DataFrame:
    """Adds the flag ``balanced`` so that both populations come from one pass."""
    keys = balanced_keys(df, key, period, n_periods).withColumn("balanced", F.lit(True))
    return df.join(keys, list(key), "left").withColumn("balanced", F.coalesce("balanced", F.lit(False)))


def _support_sums(value: str, support: str) -> dict[str, tuple[str, Column]]:
    v, w = F.col(value).cast("double"), F.col(support).cast("double")
    ok = is_finite(v) & is_finite(w) & (w > 0)
    return {
        "support_sum": ("sum", w),
        "support_n": ("sum", w.isNotNull().cast("bigint")),
        "weight_sum": ("sum", F.when(ok, w)),
        "weighted_sum": ("sum", F.when(ok, v * w)),
    }


def _annual_columns(stats: DataFrame, by: Sequence[str]) -> DataFrame:
    return stats.select(
        *by,
        F.col("n_rows").alias("n"),
        F.col("mean").alias("mean_value"),
        F.col("median").alias("median_value"),
        F.col("sd").alias("sd_value"),
        F.try_divide("support_sum", "support_n").alias("mean_support"),
        standard_error("sd", "n_rows").alias("spatial_se"),
        F.try_divide("weighted_sum", "weight_sum").alias("weighted_mean"),
    )


def annual_summary(df: DataFrame, by: Sequence[str], value: str, support: str) -> DataFrame:
    """Per group: rows, exact mean, median, sd, spatial se, mean support, weighted mean."""
    stats = distribution(df, by, [value], {"median": 0.5}, carry=_support_sums(value, support))
    return _annual_columns(stats, by)


def population_summary(
    df: DataFrame, by: Sequence[str], value: str, support: str, populations: Mapping[str, Column]
) -> DataFrame:
    """annual_summary for overlapping populations (name -> row condition) in one pass.

    Facts are reduced once, by the set of populations they are in; only the reduced rows are
    repeated for each population.
    """
    inside = [F.when(F.coalesce(c, F.lit(False)), F.lit(1 << k)).otherwise(0) for k, c in enumerate(populations.values())]
    masked = df.withColumn("_mask", sum(inside[1:], inside[0]))
    carry = _support_sums(value, support)
    counts = value_counts(masked.where("_mask <> 0"), [*by, "_mask"], [value], carry)
    members = F.array_compact(F.array(*[
        F.when(F.col("_mask").bitwiseAND(F.lit(1 << k)) != 0, F.lit(name)) for k, name in enumerate(populations)]))
    repeated = counts.withColumn("population", F.explode(members)).drop("_mask")
    group = [*by, "population"]
    return _annual_columns(distribution_of_counts(repeated, [*group, "variable"], {"median": 0.5}, carry), group)


def annual_table(
    df: DataFrame, key: Sequence[str], period: str, value: str, support: str, n_periods: int, min_support: int = 3
) -> DataFrame:
    """Balanced, full and support-filtered figures of every period side by side."""
    marked = mark_balanced(df, key, period, n_periods)
    enough = f"balanced_support_ge{min_support}"
    long = population_summary(marked, [period], value, support, {
        "balanced": F.col("balanced"),
        "full": F.lit(True),
        enough: F.col("balanced") & (F.col(support) >= min_support),
    })
    pick = lambda name, c: F.max(F.when(F.col("population") == name, F.col(c)))
    wide = long.groupBy(period).agg(
        pick("balanced", "n").alias("n_balanced"),
        pick("balanced", "mean_value").alias("mean_balanced"),
        pick("balanced", "median_value").alias("median_balanced"),
        pick("balanced", "sd_value").alias("sd_balanced"),
        pick("balanced", "mean_support").alias("mean_support"),
        pick("balanced", "spatial_se").alias("spatial_se_balanced"),
        pick("full", "n").alias("n_full"),
        pick("full", "mean_value").alias("mean_full"),
        pick("full", "median_value").alias("median_full"),
        pick("full", "sd_value").alias("sd_full"),
        pick(enough, "n").alias(f"n_{enough}"),
        pick(enough, "mean_value").alias(f"mean_{enough}"),
        pick(enough, "median_value").alias(f"median_{enough}"),
        pick("balanced", "weighted_mean").alias("mean_balanced_weighted"),
    )
    both = wide.where("n_balanced is not null")
    return both.withColumn("full_minus_balanced", F.col("mean_full") - F.col("mean_balanced"))


def compare_populations(
    df: DataFrame, by: Sequence[str], flag: str, value: str, digits: int = 6
) -> DataFrame:
    """Size and mean of all rows and of the flagged rows; the difference is rounded last."""
    inside = F.coalesce(F.col(flag), F.lit(False))
    full, part = F.avg(value), F.avg(F.when(inside, F.col(value)))
    return df.dropna(subset=list(by)).groupBy(*by).agg(
        F.count("*").alias("n_full"),
        F.bround(full, digits).alias("mean_full"),
        F.count_if(inside).alias("n_balanced"),
        F.bround(part, digits).alias("mean_balanced"),
        F.bround(part - full, digits).alias("difference"),
    )


def block_change(
    df: DataFrame, by: Sequence[str], period: str, value: str, early: tuple, late: tuple
) -> DataFrame:
    """Mean of an early and a late block (bounds inclusive), absolute and percent change."""
    mean_in = lambda block: F.avg(F.when(F.col(period).between(*block), F.col(value)))
    out = df.groupBy(*by).agg(mean_in(early).alias("early_mean"), mean_in(late).alias("late_mean"))
    return _with_change(out, "early_mean", "late_mean")


def endpoint_change(
    df: DataFrame, by: Sequence[str], period: str, value: str, first: object, last: object
) -> DataFrame:
    """Value of the first and the last period, absolute and percent change."""
    at = lambda p: F.max(F.when(F.col(period) == p, F.col(value)))
    out = df.groupBy(*by).agg(at(first).alias("first_value"), at(last).alias("last_value"))
    return _with_change(out, "first_value", "last_value")


def _with_change(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.withColumn("absolute_change", F.col(b) - F.col(a)).withColumn(
        "relative_change_percent", percent_change(a, b, guard=False)
    )
