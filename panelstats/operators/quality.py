"""Coverage, missingness, duplicates, reproduction errors and rule reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelstats.functions.scalar import (
    days_inclusive, is_blank, joined_set, rmse, share_true,
)


def require_columns(df: DataFrame, needed: Sequence[str]) -> DataFrame:
    """The column contract; the error lists what is actually there."""
    missing = set(needed) - set(df.columns)
    if missing:
        raise ValueError(f"missing columns {sorted(missing)}; found {df.columns}")
    return df


# ---- coverage and missingness --------------------------------------------

def date_coverage(df: DataFrame, by: Sequence[str], date: str) -> DataFrame:
    """Rows, first and last date, distinct dates, calendar days expected and absent."""
    keyed = df.dropna(subset=list(by))
    per_day = keyed.groupBy(*by, date).agg(F.count("*").alias("r"))
    out = per_day.groupBy(*by).agg(
        F.sum("r").alias("n_rows"),
        F.min(date).alias("first_date"),
        F.max(date).alias("last_date"),
        F.count(date).alias("n_unique_dates"),
    )
    return out.withColumn("expected_calendar_days", days_inclusive("first_date", "last_date")).withColumn(
        "missing_calendar_days", F.col("expected_calendar_days") - F.col("n_unique_dates")
    )


def missingness(df: DataFrame, by: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """(by, variable): rows, missing, percent. One pass over wide rows, long output."""
    keyed = df.dropna(subset=list(by))
    wide = keyed.groupBy(*by).agg(
        F.count("*").alias("n_rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in cols]
    )
    long = wide.unpivot([*by, "n_rows"], list(cols), "variable", "n_missing")
    return long.withColumn("percent_missing", 100 * F.col("n_missing") / F.col("n_rows"))


def duplicate_rows(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All members of every repeated key. Keys are counted first, then matched back."""
    return df.join(repeated_keys(df, keys).select(*keys), list(keys), "left_semi")


def repeated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n_members")).where("n_members > 1")


def surplus_rows(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: members, distinct keys and rows beyond the first of each key."""
    per_key = df.groupBy(*keys).agg(F.count("*").alias("m"))
    return per_key.agg(
        F.coalesce(F.sum("m"), F.lit(0)).alias("n_rows"),
        F.count("*").alias("n_keys"),
        F.coalesce(F.sum(F.col("m") - 1), F.lit(0)).alias("n_surplus"),
        F.count_if(F.col("m") > 1).alias("n_repeated_keys"),
    )


def negatives(df: DataFrame, by: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """(by, variable): valid and negative counts, percent, extremes; empty pairs left out."""
    keyed = df.dropna(subset=list(by))
    stats = keyed.groupBy(*by).agg(*[
        F.struct(
            F.count(c).alias("n_valid"),
            F.count_if(F.col(c) < 0).alias("n_negative"),
            F.min(F.col(c).cast("double")).alias("minimum"),
            F.max(F.col(c).cast("double")).alias("maximum"),
        ).alias(c)
        for c in cols
    ])
    long = stats.unpivot(list(by), list(cols), "variable", "s").select(*by, "variable", "s.*")
    return long.where("n_valid > 0").withColumn(
        "percent_negative", 100 * F.col("n_negative") / F.col("n_valid")
    )


# ---- reproduction of reported variables ----------------------------------

def recompute_balance(
    df: DataFrame, plus: Sequence[str], minus: Sequence[str], reported: str
) -> DataFrame:
    """Adds recalculated, difference and absolute difference; missing parts give missing."""
    total = F.lit(0.0)
    for c in plus:
        total = total + F.col(c)
    for c in minus:
        total = total - F.col(c)
    return with_difference(df.withColumn("recalculated", total), "recalculated", reported)


def with_difference(df: DataFrame, calculated: str, reported: str) -> DataFrame:
    out = df.withColumn("difference", F.col(calculated) - F.col(reported))
    return out.withColumn("absolute_difference", F.abs("difference"))


def reproduction_error(
    df: DataFrame, by: Sequence[str], calculated: str, reported: str, count: str = "rows"
) -> DataFrame:
    """n, mean and largest absolute difference, RMSE. ``count``: 'rows' or 'present' pairs."""
    compared = with_difference(df.dropna(subset=list(by)), calculated, reported)
    n = F.count("*") if count == "rows" else F.count("difference")
    return compared.groupBy(*by).agg(
        n.alias("n_compared"),
        F.avg("difference").alias("mean_difference"),
        F.max("absolute_difference").alias("max_absolute_difference"),
        rmse("difference").alias("rmse"),
    )


# ---- whole-table summaries ------------------------------------------------

def group_sizes(df: DataFrame, by: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(by)).groupBy(*by).agg(F.count("*").alias("n_rows"))


def group_qa(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Group summary that keeps missing keys as groups of their own."""
    return df.groupBy(*by).agg(
        F.count("*").alias("n_rows"),
        F.avg(value).alias("mean_value"),
        F.min(value).alias("min_value"),
        F.max(value).alias("max_value"),
    )


def identified(key: Sequence[str], period: str) -> Column:
    """Rows whose period and whole key are known."""
    known = ~is_blank(F.col(period).cast("string"))
    for c in key:
        known = known & ~is_blank(F.col(c).cast("string"))
    return known


def panel_cells(
    df: DataFrame, key: Sequence[str], period: str, area: str, extra: Sequence[Column] = ()
) -> DataFrame:
    """One row per (key, period, area), marked where a key or a key-period starts.

    Identified rows come first, so that a key is marked on one of them if it has any.

    The marks turn distinct counts into plain counts, so a whole-table summary
    needs no second scan and carries no set that grows with the data.
    """
    cells = df.groupBy(*key, period, area).agg(F.count("*").alias("r"), *extra)
    per_key, per_pair = Window.partitionBy(*key), Window.partitionBy(*key, period)
    return cells.select(
        "*",
        (F.row_number().over(per_key.orderBy(F.desc(identified(key, period)), period, area)) == 1).alias("first_of_key"),
        (F.row_number().over(per_pair.orderBy(area)) == 1).alias("first_of_pair"),
    )


def qa_summary(
    df: DataFrame,
    key: Sequence[str],
    period: str,
    area: str,
    value: str,
    support: str,
    digits: int = 6,
) -> DataFrame:
    """One row for the whole panel: counts, extremes, extents, duplicates, missing cells."""
    blank = {c: is_blank(F.col(c).cast("string")) for c in [*key, area, period, value, support]}
    v = F.col(value).cast("double")
    cells = panel_cells(df, key, period, area, [
        F.sum(v).alias("s"), F.count(v).alias("nv"),
        F.min(v).alias("vmin"), F.max(v).alias("vmax"),
        F.min(support).alias("smin"), F.max(support).alias("smax"),
        *[F.count_if(m).alias(f"miss_{c}") for c, m in blank.items()],
        F.first(identified(key, period)).alias("ok"),
    ])
    ok = F.col("ok")
    extents = [
        e for c in key
        for e in (F.min(F.when(ok, F.col(c))).alias(f"{c}_min"), F.max(F.when(ok, F.col(c))).alias(f"{c}_max"))
    ]
    pairs = F.count_if(ok & F.col("first_of_pair"))
    return cells.agg(
        F.sum("r").alias("n_rows"),
        F.min(F.when(ok, F.col(period))).alias("period_min"),
        F.max(F.when(ok, F.col(period))).alias("period_max"),
        F.size(F.collect_set(F.when(ok, F.col(period)))).cast("bigint").alias("n_periods"),
        F.count_if(ok & F.col("first_of_key")).alias("unique_keys"),
        joined_set(F.when(~is_blank(F.col(area).cast("string")), F.col(area))).alias("areas"),
        F.min("vmin").alias("value_min"),
        F.max("vmax").alias("value_max"),
        F.bround(F.try_divide(F.sum("s"), F.sum("nv")), digits).alias("value_mean"),
        F.min("smin").alias("support_min"),
        F.max("smax").alias("support_max"),
        *extents,
        (F.coalesce(F.sum(F.when(ok, F.col("r"))), F.lit(0)) - pairs).alias("duplicate_key_periods"),
        *[F.sum(f"miss_{c}").alias(f"missing_{c}") for c in blank],
    )


def completeness(df: DataFrame, key: Sequence[str], period: str, area: str) -> DataFrame:
    """Per period: records and distinct keys of identified rows, and the sorted list of all areas seen."""
    cells = panel_cells(df.dropna(subset=[period]), key, period, area).withColumn("ok", identified(key, period))
    return cells.groupBy(period).agg(
        F.coalesce(F.sum(F.when(F.col("ok"), F.col("r"))), F.lit(0)).alias("n_records"),
        F.count_if(F.col("first_of_pair") & F.col("ok")).alias("n_keys"),
        joined_set(area).alias("areas"),
    )


def unstable_keys(df: DataFrame, key: Sequence[str], category: str) -> DataFrame:
    """Keys seen with more than one category: how many and which."""
    return (
        df.select(*key, category).dropDuplicates()
        .groupBy(*key)
        .agg(F.countDistinct(category).alias("n_categories"), joined_set(category).alias("categories"))
        .where("n_categories > 1")
    )


def frequency(df: DataFrame, by: str, digits: int = 3) -> DataFrame:
    """Count per value and percent of all rows, rounded half to even, in numeric order."""
    counts = df.groupBy(by).agg(F.count("*").alias("n_records"))
    total = df.agg(F.count("*")).scalar()
    share = F.bround(100 * F.col("n_records") / total, digits).alias("percent")
    return counts.select(by, "n_records", share).orderBy(
        F.col(by).try_cast("double"), by
    )


def value_frequency(df: DataFrame, by: str) -> DataFrame:
    """Counts in descending order, ties by value."""
    return df.groupBy(by).agg(F.count("*").alias("n_records")).orderBy(F.desc("n_records"), by)


def condition_shares(df: DataFrame, by: Sequence[str], conditions: Mapping[str, Column]) -> DataFrame:
    """Fraction of all rows meeting each condition; missing comparisons stay in the denominator."""
    return df.dropna(subset=list(by)).groupBy(*by).agg(
        F.count("*").alias("n_rows"),
        *[F.count_if(F.coalesce(c, F.lit(False))).alias(f"n_{name}") for name, c in conditions.items()],
        *[share_true(c).alias(f"fraction_{name}") for name, c in conditions.items()],
    )


# ---- rule reports ---------------------------------------------------------

def rule_report(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """(rule, failed, passed): rows breaking each rule, all rules in one pass.

    A rule that is unknown for a row (missing value) counts as broken.
    """
    one = df.agg(*[F.count_if(~F.coalesce(c, F.lit(False))).alias(name) for name, c in rules.items()])
    long = one.unpivot([], list(rules), "rule", "failed")
    return long.withColumn("passed", F.col("failed") == 0)


def expect_values(df: DataFrame, expected: Mapping[str, tuple[Column, object]]) -> DataFrame:
    """(rule, failed, passed) of table-level aggregates against expected values."""
    one = df.agg(*[
        F.when(agg.eqNullSafe(F.lit(want)), 0).otherwise(1).cast("bigint").alias(name)
        for name, (agg, want) in expected.items()
    ])
    long = one.unpivot([], list(expected), "rule", "failed")
    return long.withColumn("passed", F.col("failed") == 0)


def expect_unique(df: DataFrame, keys: Sequence[str], rule: str = "unique") -> DataFrame:
    return surplus_rows(df, keys).select(
        F.lit(rule).alias("rule"), F.col("n_surplus").alias("failed"), (F.col("n_surplus") == 0).alias("passed")
    )


def expect_equal_sizes(df: DataFrame, period: str, size: int, rule: str = "equal_sizes") -> DataFrame:
    """Every period must hold exactly ``size`` rows."""
    per = df.groupBy(period).agg(F.count("*").alias("n"))
    failed = F.count_if(F.col("n") != size)
    return per.agg(failed.alias("failed")).select(
        F.lit(rule).alias("rule"), "failed", (F.col("failed") == 0).alias("passed")
    )


def expect_present(expected: DataFrame, found: DataFrame, on: Sequence[str], rule: str = "present") -> DataFrame:
    """Expected sources that were not found."""
    absent = expected.select(*on).dropDuplicates().join(found.select(*on), list(on), "left_anti")
    return absent.agg(F.count("*").alias("failed")).select(
        F.lit(rule).alias("rule"), "failed", (F.col("failed") == 0).alias("passed")
    )


def enforce(report: DataFrame) -> None:
    """Run a rule report (one row per rule) and abort naming every rule that failed."""
    broken = report.where(~F.col("passed")).orderBy("rule").collect()
    if broken:
        raise ValueError("; ".join(f"{r['rule']}: {r['failed']} failed" for r in broken))


def diagnostics(
    df: DataFrame, key: Sequence[str], period: str, area: str, value: str, n_periods: int
) -> DataFrame:
    """One row: size of the panel and of its balanced part, periods, missing, duplicates."""
    cells = panel_cells(df, key, period, area, [F.count_if(F.col(value).isNull()).alias("m")])
    per_key = Window.partitionBy(*key)
    seen = F.sum((F.col("first_of_pair") & F.col(period).isNotNull()).cast("int")).over(per_key)
    cells = cells.withColumn("full", seen == n_periods)
    full = F.col("full")
    return cells.agg(
        F.sum("r").alias("n_rows"),
        F.count_if("first_of_key").alias("unique_keys"),
        F.count_if(full & F.col("first_of_key")).alias("balanced_keys"),
        F.coalesce(F.sum(F.when(full, F.col("r"))), F.lit(0)).alias("balanced_rows"),
        F.min(period).alias("period_min"),
        F.max(period).alias("period_max"),
        F.size(F.collect_set(period)).cast("bigint").alias("n_periods"),
        F.sum("m").alias("missing_values"),
        (F.sum("r") - F.count_if("first_of_pair")).alias("duplicate_key_periods"),
        joined_set(F.when(full, F.col(area)), ignore_case=False).alias("balanced_areas"),
    )
