"""Daily multivariate series: common windows, season summaries, cross-group checks, resampling."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelstats.functions.scalar import min_count_sum, month_start, plain_sum, share_true
from panelstats.operators.distribution import distribution


def windows(df: DataFrame, period: str, group: str, date: str) -> DataFrame:
    """Per period: latest start and earliest end over its groups."""
    spans = df.dropna(subset=[period, group]).groupBy(period, group).agg(
        F.min(date).alias("s"), F.max(date).alias("e")
    )
    return spans.groupBy(period).agg(F.max("s").alias("common_start"), F.min("e").alias("common_end"))


def common_window(df: DataFrame, period: str, group: str, date: str) -> DataFrame:
    """Rows dated inside the window shared by all groups of the period, both ends included.

    The window table has one row per period; whether it is broadcast is decided
    from its measured size.
    """
    inside = df.join(windows(df, period, group, date), period)
    return inside.where(F.col(date).between(F.col("common_start"), F.col("common_end")))


def season_summary(
    df: DataFrame,
    by: Sequence[str],
    date: str,
    sums: Sequence[str],
    optional_sums: Sequence[str] = (),
    level: str | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Totals and level statistics of each group over its own recorded period.

    ``sums`` give 0 when nothing was recorded, ``optional_sums`` stay missing.
    """
    aggs = [
        *[F.min(c).alias(c) for c in keep],
        F.min(date).alias("start_date"),
        F.max(date).alias("end_date"),
        F.count("*").alias("n_days"),
        *[plain_sum(c).alias(f"{c}_sum") for c in sums],
        *[min_count_sum(c).alias(f"{c}_sum") for c in optional_sums],
    ]
    if level:
        aggs += [
            F.avg(level).alias("mean_level"),
            F.max(level).alias("max_level"),
            F.count_if(F.col(level) > 0).alias("positive_days"),
            F.count(level).alias("valid_days"),
        ]
    out = df.dropna(subset=list(by)).groupBy(*by).agg(*aggs)
    if level:
        out = out.withColumn("fraction_positive", F.try_divide("positive_days", "valid_days"))
    return out


def common_window_summary(
    df: DataFrame,
    period: str,
    group: str,
    date: str,
    sums: Sequence[str],
    optional_sums: Sequence[str] = (),
    level: str | None = None,
) -> DataFrame:
    inside = common_window(df, period, group, date)
    return season_summary(
        inside, [period, group], date, sums, optional_sums, level, keep=["common_start", "common_end"]
    )


def profile(df: DataFrame, by: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Distribution diagnostics per (by, variable); quantiles are exact."""
    out = distribution(df, by, cols)
    return out.withColumn("pct_zero", 100 * F.try_divide("n_zero", "n")).withColumn(
        "pct_negative", 100 * F.try_divide("n_negative", "n")
    )


def event_structure(
    df: DataFrame, by: Sequence[str], inflow: str, outflow: str, balance: str
) -> DataFrame:
    """How often and how much on days with a positive flow. One row per group and day in.

    Fractions keep days without a measurement in the denominator. A group holds
    at most one row per calendar day, which bounds the median's state.
    """
    i = F.col(inflow)
    up, out_up, down = i > 0, F.col(outflow) > 0, F.col(balance) < 0
    return df.dropna(subset=list(by)).groupBy(*by).agg(
        F.count("*").alias("n_days"),
        F.count_if(up).alias("days_positive_inflow"),
        share_true(up).alias("fraction_positive_inflow"),
        plain_sum(inflow).alias("total_inflow"),
        F.avg(i).alias("mean_inflow_all_days"),
        F.avg(F.when(up, i)).alias("mean_inflow_positive_days"),
        F.median(F.when(up, i)).alias("median_inflow_positive_days"),
        F.max(i).alias("max_inflow"),
        F.count_if(out_up).alias("days_positive_outflow"),
        share_true(out_up).alias("fraction_positive_outflow"),
        F.count_if(down).alias("days_negative_balance"),
        share_true(down).alias("fraction_negative_balance"),
    )


def align_groups(df: DataFrame, period: str, date: str, group: str, value: str) -> DataFrame:
    """(period, date) on which every group of the period has a row: spread of the value.

    Same result as merging the groups' tables on the date, without a self join.
    """
    per_date = df.dropna(subset=[period, group]).groupBy(period, group, date).agg(
        F.min(value).alias("lo"), F.max(value).alias("hi")
    )
    n_groups = per_date.select(period, group).dropDuplicates().groupBy(period).agg(F.count("*").alias("n_groups"))
    days = per_date.groupBy(period, date).agg(
        F.count("*").alias("present"), F.max("hi").alias("highest"), F.min("lo").alias("lowest")
    )
    return (
        days.join(n_groups, period)
        .where("present = n_groups")
        .select(period, date, "highest", "lowest", (F.col("highest") - F.col("lowest")).alias("spread"))
    )


def consistency(
    df: DataFrame, period: str, date: str, group: str, value: str, eps: float = 1e-9
) -> DataFrame:
    """Per period: common dates, largest spread between groups, days that differ."""
    return align_groups(df, period, date, group, value).groupBy(period).agg(
        F.count("*").alias("n_common_dates"),
        F.max("spread").alias("max_spread"),
        F.count_if(F.col("spread") > eps).alias("days_differing"),
    )


def entity_summary(df: DataFrame, by: Sequence[str], date: str, value: str) -> DataFrame:
    """Per sensor: valid readings, first and last date, exact location and spread."""
    stats = distribution(df, by, [value], {"median": 0.5}, carry={
        "first_date": ("min", F.col(date)), "last_date": ("max", F.col(date)),
    })
    return stats.select(
        *by, "n", "first_date", "last_date", "mean", "median", "sd", "min", "max",
        (F.col("max") - F.col("min")).alias("range"),
    )


def spatial_mean(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Per period and date: readings, mean, median, extremes and sd across sensors."""
    stats = distribution(df, by, [value], {"median": 0.5})
    return stats.select(
        *by, "n", "mean", "median", "min", "max", "sd", (F.col("max") - F.col("min")).alias("spread")
    )


def mixed_daily(
    df: DataFrame, by: Sequence[str], means: Sequence[str], sums: Sequence[str]
) -> DataFrame:
    """Mean of some columns and sum of others per key; sums of nothing are 0."""
    return df.dropna(subset=list(by)).groupBy(*by).agg(
        *[F.avg(c).alias(f"mean_{c}") for c in means],
        *[plain_sum(c).alias(f"total_{c}") for c in sums],
    )


def resample_month(
    df: DataFrame, by: Sequence[str], date: str, aggs: Mapping[str, Column]
) -> DataFrame:
    """Month buckets between first and last date of each group; empty months give missing."""
    keyed = df.dropna(subset=[*by, date]).withColumn("_found", month_start(date))
    monthly = keyed.groupBy(*by, "_found").agg(*[c.alias(name) for name, c in aggs.items()])
    # the spine is laid between the months found, so the facts are read once
    ahead = F.lead("_found").over(Window.partitionBy(*by).orderBy("_found"))
    last_before = F.coalesce(F.add_months(ahead, -1), F.col("_found"))
    spans = monthly.withColumn("_until", last_before)
    steps = F.sequence("_found", "_until", F.expr("interval 1 month"))
    filled = spans.select("*", F.explode(steps).alias("month"))
    here = F.col("month") == F.col("_found")
    return filled.select(*by, "month", *[F.when(here, F.col(n)).alias(n) for n in aggs])


def series_for_plot(frames: Mapping[str, tuple[DataFrame, str, Sequence[str], str | None]]) -> DataFrame:
    """Chart-ready (panel, series, x, y). Each entry: table, x column, y columns, optional
    column whose values name the series."""
    parts = []
    for panel, (df, x, ys, name) in frames.items():
        ids = [x] + ([name] if name else [])
        doubles = df.select(*ids, *[F.col(y).cast("double").alias(y) for y in ys])
        long = doubles.unpivot(ids, list(ys), "series", "y")
        series = F.col(name).cast("string") if name else F.col("series")
        parts.append(
            long.select(F.lit(panel).alias("panel"), series.alias("series"), F.col(x).cast("double").alias("x"), "y")
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.orderBy("panel", "series", "x")
