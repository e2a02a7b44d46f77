"""Runs of equal state in an ordered series (wet and dry spells).

The plain operators expect a series with one row per group and date, so a group
holds no more rows than the calendar has days. ``spells_chunked`` takes series
of any length: runs are found inside time chunks and joined up through one summary
row per chunk.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelstats.functions.scalar import clip_lower, state_flag
from panelstats.operators.joins import cross_axis
from panelstats.session import new_folder


def row_index(df: DataFrame, by: Sequence[str], order: str, name: str = "idx") -> DataFrame:
    """0-based position in date order."""
    w = Window.partitionBy(*by).orderBy(order)
    return df.withColumn(name, F.row_number().over(w) - 1)


def daily_states(
    df: DataFrame, by: Sequence[str], date: str, level: str, threshold: float | Column = 0.0
) -> DataFrame:
    """Level with its wet (above) and dry (at or below) marks."""
    wet = state_flag(level, threshold)
    return df.dropna(subset=list(by)).select(*by, date, level, wet.alias("wet"), (1 - wet).alias("dry"))


def incomplete_groups(df: DataFrame, by: Sequence[str], level: str) -> DataFrame:
    """Groups in which the level is missing at least once."""
    return (
        df.dropna(subset=list(by)).groupBy(*by)
        .agg(F.count_if(F.col(level).isNull()).alias("n_missing"))
        .where("n_missing > 0")
    )


def require_complete(df: DataFrame, by: Sequence[str], level: str) -> DataFrame:
    """Abort when any group lacks a level; the scope is the rows handed in."""
    bad = incomplete_groups(df, by, level)
    found = bad.agg(F.count("*").alias("groups"), F.sum("n_missing").alias("rows")).first()
    if found["groups"]:
        path = new_folder(df.sparkSession, "incomplete-groups")
        bad.write.parquet(path)
        raise ValueError(f"missing {level} in {found['groups']} groups ({found['rows']} rows), listed in {path}")
    return df


def _with_runs(
    df: DataFrame, by: Sequence[str], order: str, state: str, ties: Sequence[str] = ()
) -> DataFrame:
    """Adds idx, step (state minus previous state) and run (number of the run).

    ``ties`` are columns that order rows of equal ``order``, missing ones last.
    """
    w = Window.partitionBy(*by).orderBy(order, *[F.col(c).asc_nulls_last() for c in ties])
    before = F.lag(state).over(w)
    starts = F.when(before.isNull() | (before != F.col(state)), 1).otherwise(0)
    marked = df.select(
        "*",
        (F.row_number().over(w) - 1).alias("_idx"),
        (F.col(state) - before).alias("_step"),
        starts.alias("_starts"),
    )
    return marked.withColumn(
        "_run", F.sum("_starts").over(w.rowsBetween(Window.unboundedPreceding, 0))
    ).drop("_starts")


def transitions(df: DataFrame, by: Sequence[str], order: str, state: str) -> DataFrame:
    """Falls (1 to 0) and rises (0 to 1) per group."""
    return _with_runs(df, by, order, state).groupBy(*by).agg(
        F.count_if(F.col("_step") == -1).alias("wet_to_dry"),
        F.count_if(F.col("_step") == 1).alias("dry_to_wet"),
    )


def spells(df: DataFrame, by: Sequence[str], order: str, state: str) -> DataFrame:
    """Numbered maximal runs of equal state; adjacency is by row.

    Columns: by, state, spell_id (per group and state), start, end, length,
    start_index, end_index.
    """
    runs = (
        _with_runs(df.dropna(subset=[*by, state]), by, order, state)
        .groupBy(*by, "_run", state)
        .agg(
            F.min(order).alias("start"),
            F.max(order).alias("end"),
            F.count("*").alias("length"),
            F.min("_idx").cast("bigint").alias("start_index"),
            F.max("_idx").cast("bigint").alias("end_index"),
        )
    )
    number = F.row_number().over(Window.partitionBy(*by, state).orderBy("_run"))
    return runs.select(*by, state, number.cast("bigint").alias("spell_id"), "start", "end", "length",
                       "start_index", "end_index")


def spells_chunked(
    df: DataFrame, by: Sequence[str], order: str, state: str, chunk: Column, ties: Sequence[str] = ()
) -> DataFrame:
    """Same result as ``spells`` for 0/1 states of series of any length.

    ``chunk`` never decreases along ``order`` (for example the hour of a timestamp).
    Rows of equal ``order`` follow the columns ``ties`` and at last their state, 0 before 1,
    so the result depends on the rows alone.
    Runs are found per chunk. One row per chunk then tells which state went before,
    how many rows and how many spells of each state came earlier; with that every
    run knows its spell, and runs of one spell are merged.
    """
    cut = df.dropna(subset=[*by, state]).withColumn("_chunk", chunk)
    local = [*by, "_chunk"]
    runs = (
        _with_runs(cut, local, order, state, [*ties, state])
        .groupBy(*local, "_run", state)
        .agg(F.min(order).alias("start"), F.max(order).alias("end"), F.count("*").alias("length"),
             F.min("_idx").alias("_first_idx"))
    )
    per_chunk = runs.groupBy(*local).agg(
        F.sum("length").alias("_n"),
        F.min_by(state, "_run").alias("_first_state"),
        F.max_by(state, "_run").alias("_last_state"),
        F.count_if(F.col(state) == 0).alias("_n0"),
        F.count_if(F.col(state) == 1).alias("_n1"),
    )
    along = Window.partitionBy(*by).orderBy("_chunk")
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    per_chunk = per_chunk.withColumn("_prev", F.lag("_last_state").over(along))
    # the first run of a chunk may continue the last run before it
    carried = F.coalesce((F.col("_prev") == F.col("_first_state")).cast("int"), F.lit(0))
    per_chunk = per_chunk.withColumn("_carried", carried)
    opened = lambda k: F.col(f"_n{k}") - F.when(F.col("_first_state") == k, F.col("_carried")).otherwise(0)
    before = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0))
    summary = per_chunk.select(
        *local, "_first_state", "_carried", before(F.col("_n")).alias("_offset"),
        before(opened(0)).alias("_base0"), before(opened(1)).alias("_base1"),
    )
    same = F.col(state) == F.col("_first_state")
    # states alternate inside a chunk, so a run's place among its state follows from its number
    place = F.floor((F.col("_run") - F.when(same, 1).otherwise(2)) / 2) + 1 - F.when(same, F.col("_carried")).otherwise(0)
    base = F.when(F.col(state) == 1, F.col("_base1")).otherwise(F.col("_base0"))
    numbered = runs.join(summary, local).select(
        *by, state, (base + place).cast("bigint").alias("spell_id"), "start", "end", "length",
        (F.col("_offset") + F.col("_first_idx")).alias("start_index"),
    )
    return (
        numbered.groupBy(*by, state, "spell_id")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("length").alias("length"),
             F.min("start_index").alias("start_index"))
        .withColumn("end_index", F.col("start_index") + F.col("length") - 1)
    )


def hydroperiod(
    df: DataFrame,
    by: Sequence[str],
    date: str,
    level: str,
    threshold: float | Column = 0.0,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Full state summary per group: days, spells, transitions, longest and first dry
    spell, level quantiles, cumulative clipped level. One exchange for the whole plan.

    A missing level aborts the query.
    """
    absent = F.raise_error(F.lit(f"missing {level}: the state needs a complete series")).cast("int")
    wet_state = F.coalesce(state_flag(level, threshold), absent)
    rows = df.dropna(subset=list(by)).withColumn("_state", wet_state)
    runs = _with_runs(rows, by, date, "_state")
    in_run = Window.partitionBy(*by, "_run")
    runs = runs.select(
        "*",
        F.count("*").over(in_run).alias("_run_length"),
        F.min(date).over(in_run).alias("_run_start"),
        F.max(date).over(in_run).alias("_run_end"),
    )
    wet, dry = F.col("_state") == 1, F.col("_state") == 0
    opens = F.col(date) == F.col("_run_start")
    h = F.col(level).cast("double")
    # longest dry run, earliest on ties: the smallest of (-length, start)
    worst = F.min(F.when(dry, F.struct((-F.col("_run_length")).alias("n"), F.col("_run_start").alias("s"),
                                       F.col("_run_end").alias("e"))))
    first = F.min(F.when(dry, F.struct(F.col("_run_start").alias("s"), F.col("_run_length").alias("n"))))
    q = F.percentile(h, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75), F.lit(0.95)))
    out = runs.groupBy(*by).agg(
        *[F.min(c).alias(c) for c in keep],
        F.min(date).alias("start_date"),
        F.max(date).alias("end_date"),
        F.count("*").alias("n_days"),
        F.count_if(wet).alias("wet_days"),
        F.count_if(dry).alias("dry_days"),
        F.count_if(opens & wet).alias("n_wet_spells"),
        F.count_if(opens & dry).alias("n_dry_spells"),
        F.count_if(F.col("_step") == -1).alias("wet_to_dry"),
        F.count_if(F.col("_step") == 1).alias("dry_to_wet"),
        F.coalesce(F.max(F.when(wet, F.col("_run_length"))), F.lit(0)).alias("longest_wet"),
        F.coalesce(F.max(F.when(dry, F.col("_run_length"))), F.lit(0)).alias("longest_dry"),
        first.alias("_first"),
        worst.alias("_worst"),
        F.avg(h).alias("mean_level"),
        q.alias("_q"),
        F.max(h).alias("max_level"),
        F.avg(F.when(h > 0, h)).alias("mean_positive_level"),
        F.median(F.when(h > 0, h)).alias("median_positive_level"),
        F.coalesce(F.sum(clip_lower(h)), F.lit(0.0)).alias("cumulative_level"),
    )
    return out.select(
        *by, *keep, "start_date", "end_date", "n_days", "wet_days", "dry_days",
        (F.col("wet_days") / F.col("n_days")).alias("wet_fraction"),
        (F.col("dry_days") / F.col("n_days")).alias("dry_fraction"),
        "n_wet_spells", "n_dry_spells", "wet_to_dry", "dry_to_wet", "longest_wet", "longest_dry",
        F.col("_first.s").alias("first_dry_start"),
        F.coalesce("_first.n", F.lit(0)).alias("first_dry_length"),
        F.datediff("_first.s", "start_date").alias("days_to_first_dry"),
        F.col("_worst.s").alias("longest_dry_start"),
        F.col("_worst.e").alias("longest_dry_end"),
        "mean_level",
        F.col("_q")[1].alias("median_level"), F.col("_q")[0].alias("p25_level"),
        F.col("_q")[2].alias("p75_level"), F.col("_q")[3].alias("p95_level"),
        "max_level", "mean_positive_level", "median_positive_level", "cumulative_level",
    )


SENSITIVITY_COLUMNS = [
    "n_days", "wet_days", "dry_days", "wet_fraction", "dry_fraction", "n_wet_spells",
    "n_dry_spells", "wet_to_dry", "dry_to_wet", "longest_wet", "longest_dry",
]


def threshold_sensitivity(
    df: DataFrame, by: Sequence[str], date: str, level: str, thresholds: Sequence[float],
    keep: Sequence[str] = (),
) -> DataFrame:
    """The state summary for several thresholds, computed in one plan."""
    axis = cross_axis(df, "threshold", [float(t) for t in thresholds])
    full = hydroperiod(axis, [*by, "threshold"], date, level, F.col("threshold"), keep)
    return full.select(*by, "threshold", *keep, *SENSITIVITY_COLUMNS)


def delta_vs(
    df: DataFrame, by: Sequence[str], axis: str, base: object, metrics: Sequence[str]
) -> DataFrame:
    """Each row off the base setting minus the base row of its group.

    The input is a summary with one row per group and setting.
    """
    w = Window.partitionBy(*by)
    at_base = lambda m: F.max(F.when(F.col(axis) == base, F.col(m))).over(w)
    out = df.select(*by, axis, *[(F.col(m) - at_base(m)).alias(f"{m}_change") for m in metrics])
    return out.where(F.col(axis) != base)
