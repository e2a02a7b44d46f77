"""Runs of state, thresholds, transitions."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelstats.operators import joins, series, spells
from panelstats.workload.common import (
    COMMON_DAYS, EVENT_DAYS, ORDER_DAYS, Query, event_days, order_days, shape, shaped, table,
)

LIMIT = 50.0
THRESHOLDS = (0.0, 5.0, 50.0)


def _event_states(spark, folder):
    return spells.daily_states(event_days(spark, folder), ["event_type"], "day", "level", LIMIT)


def run_spells(spark, folder):
    return shape(spells.spells(_event_states(spark, folder), ["event_type"], "day", "wet"))


def run_spells_chunked(spark, folder):
    """Spells of raw events by time; events of one time follow their id, at last their state."""
    e = table(spark, folder, "events").select("event_type", "ts", "event_id", "value")
    marked = e.withColumn("wet", (F.col("value") > LIMIT).cast("int"))
    out = spells.spells_chunked(marked, ["event_type"], "ts", "wet", F.date_trunc("minute", "ts"), ["event_id"])
    return shape(out)


def run_daily_states(spark, folder):
    return shape(_event_states(spark, folder))


def run_row_index(spark, folder):
    out = spells.row_index(event_days(spark, folder), ["event_type"], "day").select("event_type", "day", "idx")
    return shape(out)


def run_transitions(spark, folder):
    return shape(spells.transitions(_event_states(spark, folder), ["event_type"], "day", "wet"))


def run_spell_summary(spark, folder):
    return shape(spells.hydroperiod(order_days(spark, folder), ["year", "grp"], "date", "level"))


def run_common_window_spells(spark, folder):
    inside = series.common_window(order_days(spark, folder), "year", "grp", "date")
    out = spells.hydroperiod(inside, ["year", "grp"], "date", "level", keep=["common_start", "common_end"])
    return shape(out.select("year", "grp", "common_start", "common_end", *spells.SENSITIVITY_COLUMNS,
                            "mean_level", "median_level", "cumulative_level"))


def _sensitivity(spark, folder):
    inside = series.common_window(order_days(spark, folder), "year", "grp", "date")
    return spells.threshold_sensitivity(inside, ["year", "grp"], "date", "level", THRESHOLDS)


def run_sensitivity(spark, folder):
    return shape(_sensitivity(spark, folder))


def run_delta(spark, folder):
    metrics = ["wet_fraction", "n_wet_spells", "n_dry_spells", "wet_to_dry", "longest_dry"]
    return shape(spells.delta_vs(_sensitivity(spark, folder), ["year", "grp"], "threshold", 0.0, metrics))


def run_incomplete(spark, folder):
    return shape(spells.incomplete_groups(order_days(spark, folder), ["year", "grp"], "net"))


def run_axes(spark, folder):
    axis = joins.cross_axis(event_days(spark, folder), "threshold", [40.0, 45.0, 50.0, 55.0])
    return shape(axis.groupBy("event_type", "threshold").agg(
        F.count("*").alias("n_days"), F.count_if(F.col("level") > F.col("threshold")).alias("days_above")
    ))


def _runs_sql(source: str, by: str, order: str, ties: str = "") -> str:
    """Gaps and islands over a table that has by-columns, an order column and ``wet``.

    ``ties`` goes on with the ordering where several rows share a value of the order column.
    """
    return f"""
marked AS (
  SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY {order}{ties}) - 1 AS idx,
         lag(wet) OVER (PARTITION BY {by} ORDER BY {order}{ties}) AS prev FROM {source}),
numbered AS (
  SELECT *, sum(CASE WHEN prev IS NULL OR prev <> wet THEN 1 ELSE 0 END)
            OVER (PARTITION BY {by} ORDER BY {order}{ties}) AS run FROM marked),
runs AS (
  SELECT {by}, run, wet, min({order}) AS s, max({order}) AS e, count(*) AS length,
         min(idx) AS start_index, max(idx) AS end_index
  FROM numbered GROUP BY {by}, run, wet)"""


_SPELL_COLUMNS = """
SELECT event_type, wet, row_number() OVER (PARTITION BY event_type, wet ORDER BY run) AS spell_id,
       s AS "start", e AS "end", length, start_index, end_index FROM runs"""

_EVENT_WET = EVENT_DAYS + f""",
states AS (SELECT event_type, day, level, CASE WHEN level > {LIMIT} THEN 1 ELSE 0 END AS wet FROM event_days)"""


def _summary_sql(source: str, by: str, keep: str = "") -> str:
    """State summary of a table with by-columns, date, level and wet."""
    kept = "".join(f"min({c}) AS {c}, " for c in keep.split())
    out = "".join(f"a.{c}, " for c in keep.split())
    on = " AND ".join(f"a.{c} = b.{c}" for c in by.replace(" ", "").split(","))
    cols = ", ".join(f"a.{c}" for c in by.replace(" ", "").split(","))
    return _runs_sql(source, by, "date") + f""",
day_part AS (
  SELECT {by}, {kept}min(date) AS start_date, max(date) AS end_date, count(*) AS n_days,
    sum(wet) AS wet_days, sum(1 - wet) AS dry_days,
    count(*) FILTER (wet - prev = -1) AS wet_to_dry, count(*) FILTER (wet - prev = 1) AS dry_to_wet,
    avg(level) AS mean_level, median(level) AS median_level, quantile_cont(level, 0.25) AS p25_level,
    quantile_cont(level, 0.75) AS p75_level, quantile_cont(level, 0.95) AS p95_level, max(level) AS max_level,
    avg(level) FILTER (level > 0) AS mean_positive_level,
    median(level) FILTER (level > 0) AS median_positive_level,
    sum(greatest(level, 0)) AS cumulative_level
  FROM numbered GROUP BY {by}),
run_part AS (
  SELECT {by}, count(*) FILTER (wet = 1) AS n_wet_spells, count(*) FILTER (wet = 0) AS n_dry_spells,
    coalesce(max(length) FILTER (wet = 1), 0) AS longest_wet,
    coalesce(max(length) FILTER (wet = 0), 0) AS longest_dry,
    min(s) FILTER (wet = 0) AS first_dry_start,
    coalesce(arg_min(length, s) FILTER (wet = 0), 0) AS first_dry_length,
    arg_min(s, (-length, s)) FILTER (wet = 0) AS longest_dry_start,
    arg_min(e, (-length, s)) FILTER (wet = 0) AS longest_dry_end
  FROM runs GROUP BY {by}),
summary AS (
  SELECT {cols}, {out}start_date, end_date, n_days, wet_days, dry_days, wet_days / n_days AS wet_fraction,
    dry_days / n_days AS dry_fraction, n_wet_spells, n_dry_spells, wet_to_dry, dry_to_wet, longest_wet,
    longest_dry, first_dry_start, first_dry_length,
    date_diff('day', start_date, first_dry_start) AS days_to_first_dry, longest_dry_start, longest_dry_end,
    mean_level, median_level, p25_level, p75_level, p95_level, max_level, mean_positive_level,
    median_positive_level, cumulative_level
  FROM day_part a JOIN run_part b ON {on})"""


_INTS = "year n_days wet_days dry_days n_wet_spells n_dry_spells wet_to_dry dry_to_wet longest_wet longest_dry"
_THRESHOLDS = COMMON_DAYS + f""",
axis AS (SELECT d.year, d.grp, d.date, d.level, t.threshold, CASE WHEN d.level > t.threshold THEN 1 ELSE 0 END AS wet
         FROM common_days d, (VALUES {', '.join(f'({t})' for t in THRESHOLDS)}) t(threshold)),
""" + _summary_sql("axis", "year, grp, threshold")
_SENS = """year, grp, CAST(threshold AS DOUBLE) AS threshold, n_days, wet_days, dry_days, wet_fraction, dry_fraction,
  n_wet_spells, n_dry_spells, wet_to_dry, dry_to_wet, longest_wet, longest_dry"""

QUERIES = {
    "spells": Query(run_spells, shaped(
        f"WITH {_EVENT_WET}, {_runs_sql('states', 'event_type', 'day')} --final {_SPELL_COLUMNS}",
        ints="wet spell_id length start_index end_index", dates='"start" "end"')),
    "spells_chunked": Query(run_spells_chunked, shaped(
        f"WITH states AS (SELECT event_type, ts, event_id, CASE WHEN value > {LIMIT} THEN 1 ELSE 0 END AS wet FROM events), "
        f"{_runs_sql('states', 'event_type', 'ts', ', event_id NULLS LAST, wet')} --final {_SPELL_COLUMNS}",
        ints="wet spell_id length start_index end_index", stamps='"start" "end"')),
    "daily_states": Query(run_daily_states, shaped(
        f"WITH {_EVENT_WET} --final SELECT *, 1 - wet AS dry FROM states", real="level", ints="wet dry", dates="day")),
    "row_index": Query(run_row_index, shaped(
        f"WITH {EVENT_DAYS} --final SELECT event_type, day, "
        "row_number() OVER (PARTITION BY event_type ORDER BY day) - 1 AS idx FROM event_days", ints="idx", dates="day")),
    "transitions": Query(run_transitions,
        f"WITH {_EVENT_WET}, {_runs_sql('states', 'event_type', 'day')} SELECT event_type, "
        "count(*) FILTER (wet - prev = -1) AS wet_to_dry, count(*) FILTER (wet - prev = 1) AS dry_to_wet "
        "FROM numbered GROUP BY 1"),
    "spell_summary": Query(run_spell_summary, shaped(
        f"WITH {ORDER_DAYS}, wet_days AS (SELECT *, CASE WHEN level > 0 THEN 1 ELSE 0 END AS wet FROM order_days), "
        f"{_summary_sql('wet_days', 'year, grp')} --final SELECT * FROM summary",
        real="wet_fraction dry_fraction mean_level median_level p25_level p75_level p95_level max_level "
             "mean_positive_level median_positive_level cumulative_level",
        ints=_INTS + " first_dry_length days_to_first_dry",
        dates="start_date end_date first_dry_start longest_dry_start longest_dry_end")),
    "common_window_spells": Query(run_common_window_spells, shaped(
        f"WITH {COMMON_DAYS}, wet_days AS (SELECT *, CASE WHEN level > 0 THEN 1 ELSE 0 END AS wet FROM common_days), "
        f"{_summary_sql('wet_days', 'year, grp', 'common_start common_end')} --final SELECT year, grp, common_start, "
        "common_end, n_days, wet_days, dry_days, wet_fraction, dry_fraction, n_wet_spells, n_dry_spells, wet_to_dry, "
        "dry_to_wet, longest_wet, longest_dry, mean_level, median_level, cumulative_level FROM summary",
        real="wet_fraction dry_fraction mean_level median_level cumulative_level", ints=_INTS,
        dates="common_start common_end")),
    "threshold_sensitivity": Query(run_sensitivity, shaped(
        f"WITH {_THRESHOLDS} --final SELECT {_SENS} FROM summary",
        real="threshold wet_fraction dry_fraction", ints=_INTS)),
    "threshold_delta": Query(run_delta, shaped(
        f"WITH {_THRESHOLDS} --final SELECT s.year, s.grp, CAST(s.threshold AS DOUBLE) AS threshold, "
        + ", ".join(f"s.{m} - b.{m} AS {m}_change" for m in
                    ["wet_fraction", "n_wet_spells", "n_dry_spells", "wet_to_dry", "longest_dry"])
        + " FROM summary s JOIN summary b ON s.year = b.year AND s.grp = b.grp AND b.threshold = 0 WHERE s.threshold <> 0",
        real="threshold wet_fraction_change",
        ints="year n_wet_spells_change n_dry_spells_change wet_to_dry_change longest_dry_change")),
    "incomplete_groups": Query(run_incomplete, shaped(
        f"WITH {ORDER_DAYS} --final SELECT year, grp, count(*) - count(net) AS n_missing FROM order_days "
        "GROUP BY 1, 2 HAVING count(*) > count(net)", ints="year n_missing")),
    "threshold_axis": Query(run_axes, shaped(
        f"WITH {EVENT_DAYS} --final SELECT event_type, CAST(threshold AS DOUBLE) AS threshold, count(*) AS n_days, "
        "count(*) FILTER (level > threshold) AS days_above FROM event_days, (VALUES (40), (45), (50), (55)) t(threshold) "
        "GROUP BY 1, 2", ints="n_days days_above")),
}
