"""Baseline contrasts, period pairs, nested rollups, lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelstats.functions.scalar import composite_key
from panelstats.operators import contrast, mapping
from panelstats.workload.common import Query, shape, shaped, table
from panelstats.workload.panel_queries import COMMON_DAYS, _season, common_summary

SEGMENTS = ["BUILDING", "HOUSEHOLD", "MACHINERY"]


def _trial(spark, folder):
    """region > nation > customer, measured by account balance, stratum = market segment."""
    c = table(spark, folder, "customer")
    n = table(spark, folder, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey")
    r = table(spark, folder, "region").select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("region"))
    return c.join(n, "c_nationkey").join(r, "n_regionkey").select(
        "region", F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"),
        F.nullif(F.col("c_acctbal"), F.lit(0.0)).alias("yield"),
    )


def run_unit_means(spark, folder):
    return shape(contrast.unit_means(_trial(spark, folder), ["region", "segment", "nation"], "yield"))


def _rollup(spark, folder):
    return contrast.rollup_nested(_trial(spark, folder), ["region", "segment"], ["nation"], "yield")


def run_rollup(spark, folder):
    return shape(_rollup(spark, folder))


def _units(spark, folder):
    return contrast.unit_means(_trial(spark, folder), ["region", "segment", "nation"], "yield")


def run_common_index(spark, folder):
    return shape(contrast.common_index(_units(spark, folder), ["region"], ["nation"], "segment", SEGMENTS))


def run_common_index_groups(spark, folder):
    return shape(contrast.common_index_groups(_units(spark, folder), ["region"], ["nation"], "segment", SEGMENTS))


def run_primary(spark, folder):
    return shape(contrast.primary_stratum(_rollup(spark, folder), "segment", "BUILDING"))


def run_baseline(spark, folder):
    out = contrast.contrast(_rollup(spark, folder), ["region"], "segment", "BUILDING", ["mean_value"], "skip", guard=False)
    return shape(out.select("region", "segment", "mean_value", "mean_value_baseline", "mean_value_difference",
                            "mean_value_percent"))


FLOWS = ["inflow_sum", "net_sum", "mean_level", "fraction_positive"]


def run_window_contrast(spark, folder):
    out = contrast.contrast(common_summary(spark, folder), ["year"], "grp", "1-URGENT", FLOWS)
    cols = [f"{m}_{s}" for m in FLOWS for s in ("difference", "percent")]
    return shape(out.select("year", "grp", "common_start", "common_end", *FLOWS, *cols), 5)


def run_period_pair(spark, folder):
    return shape(contrast.period_pair(common_summary(spark, folder), ["grp"], "year", 1996, 1999, FLOWS, "error"), 5)


def run_direction(spark, folder):
    diff = contrast.contrast(common_summary(spark, folder), ["year"], "grp", "1-URGENT", ["mean_level"])
    others = diff.where("grp <> '1-URGENT'")
    return shape(contrast.direction_consistency(others, ["grp"], "year", 1996, 1999, "mean_level_difference"))


# ---- lookups --------------------------------------------------------------------

GROUPS = {
    ("A", "F"): {"early": [1, 2, 3], "late": [5, 6]},
    ("R", "F"): {"early": [1, 4], "late": [7]},
    ("N", "O"): {"middle": [3, 4, 5]},
}
RULES = [
    (("A",), 1, 3, "plot 1"),
    (("A",), None, None, "plot 2"),  # everything else of A
    (("R",), 2, 4, "plot 1"),
    (("R",), 5, 6, "plot 2"),
    ((None,), 7, 7, "plot 3"),
]


def _assigned(spark, folder):
    line = table(spark, folder, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber", "l_quantity")
    named = mapping.lookup(line, ["l_returnflag", "l_linestatus", "l_linenumber"], GROUPS, "agronomy")
    return mapping.range_lookup(named, ["l_returnflag"], "l_linenumber", RULES, "plot")


def run_lookup(spark, folder):
    out = _assigned(spark, folder).groupBy("agronomy").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q"))
    return shape(out)


def run_range_map(spark, folder):
    out = _assigned(spark, folder).groupBy("l_returnflag", "plot").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q"))
    return shape(out)


def run_unresolved(spark, folder):
    out = mapping.unresolved(_assigned(spark, folder), ["agronomy", "plot"])
    return shape(out.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n_unresolved")))


def run_composite_key(spark, folder):
    line = table(spark, folder, "lineitem").select(
        composite_key(["l_returnflag", "l_linestatus"], "_").alias("key"), "l_quantity"
    )
    return shape(line.groupBy("key").agg(F.count("*").alias("n")))


_TRIAL = """
trial AS (
  SELECT r_name AS region, c_nationkey AS nation, c_mktsegment AS segment, nullif(c_acctbal, 0) AS yield
  FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey),
units AS (
  SELECT region, segment, nation, count(*) AS n_subunits, avg(yield) AS unit_mean, min(yield) AS unit_min,
         max(yield) AS unit_max FROM trial GROUP BY 1, 2, 3),
groups AS (
  SELECT region, segment, count(*) AS n_units, avg(unit_mean) AS mean_value, stddev_samp(unit_mean) AS sd_between,
         min(unit_mean) AS min_unit_mean, max(unit_mean) AS max_unit_mean FROM units GROUP BY 1, 2),
idx AS (
  SELECT region, nation, count(DISTINCT segment) AS n_strata, avg(unit_mean) AS index_mean
  FROM units WHERE segment IN ('BUILDING', 'HOUSEHOLD', 'MACHINERY') GROUP BY 1, 2)"""
_GROUP_REAL = "mean_value sd_between min_unit_mean max_unit_mean"
_SUMMARY = COMMON_DAYS + ", summary AS (" + _season("common_days", "common_start common_end") + ")"
_PAIR = " UNION ALL ".join(
    f"SELECT a.grp, '{m}' AS metric, CAST(a.{m} AS DOUBLE) AS value_a, CAST(b.{m} AS DOUBLE) AS value_b "
    "FROM summary a JOIN summary b ON a.grp = b.grp AND a.year = 1996 AND b.year = 1999" for m in FLOWS)
_ASSIGNED = """
assigned AS (
  SELECT *,
    CASE WHEN l_returnflag = 'A' AND l_linestatus = 'F' AND l_linenumber IN (1, 2, 3) THEN 'early'
         WHEN l_returnflag = 'A' AND l_linestatus = 'F' AND l_linenumber IN (5, 6) THEN 'late'
         WHEN l_returnflag = 'R' AND l_linestatus = 'F' AND l_linenumber IN (1, 4) THEN 'early'
         WHEN l_returnflag = 'R' AND l_linestatus = 'F' AND l_linenumber = 7 THEN 'late'
         WHEN l_returnflag = 'N' AND l_linestatus = 'O' AND l_linenumber IN (3, 4, 5) THEN 'middle' END AS agronomy,
    CASE WHEN l_returnflag = 'A' AND l_linenumber BETWEEN 1 AND 3 THEN 'plot 1'
         WHEN l_returnflag = 'A' THEN 'plot 2'
         WHEN l_returnflag = 'R' AND l_linenumber BETWEEN 2 AND 4 THEN 'plot 1'
         WHEN l_returnflag = 'R' AND l_linenumber BETWEEN 5 AND 6 THEN 'plot 2'
         WHEN l_linenumber = 7 THEN 'plot 3' END AS plot
  FROM lineitem)"""

QUERIES = {
    "unit_means": Query(run_unit_means, shaped(
        f"WITH {_TRIAL} --final SELECT * FROM units", real="unit_mean unit_min unit_max", ints="nation")),
    "nested_rollup": Query(run_rollup, shaped(f"WITH {_TRIAL} --final SELECT * FROM groups", real=_GROUP_REAL)),
    "common_index": Query(run_common_index, shaped(f"WITH {_TRIAL} --final SELECT * FROM idx", real="index_mean", ints="nation")),
    "common_index_groups": Query(run_common_index_groups, shaped(f"""WITH {_TRIAL} --final
        SELECT region, count(*) AS n_units, avg(index_mean) AS mean_value, stddev_samp(index_mean) AS sd_between,
          min(index_mean) AS min_unit_mean, max(index_mean) AS max_unit_mean FROM idx GROUP BY 1""", real=_GROUP_REAL)),
    "primary_stratum": Query(run_primary, shaped(
        f"WITH {_TRIAL} --final SELECT * FROM groups WHERE segment = 'BUILDING'", real=_GROUP_REAL)),
    "baseline_contrast": Query(run_baseline, shaped(f"""WITH {_TRIAL} --final
        SELECT g.region, g.segment, g.mean_value, b.mean_value AS mean_value_baseline,
          g.mean_value - b.mean_value AS mean_value_difference,
          100 * (g.mean_value - b.mean_value) / b.mean_value AS mean_value_percent
        FROM groups g JOIN groups b ON g.region = b.region AND b.segment = 'BUILDING'""",
        real="mean_value mean_value_baseline mean_value_difference mean_value_percent")),
    "window_contrast": Query(run_window_contrast, shaped(f"WITH {_SUMMARY} --final SELECT s.year, s.grp, s.common_start, s.common_end, "
        + ", ".join(f"s.{m}" for m in FLOWS) + ", "
        + ", ".join(f"s.{m} - b.{m} AS {m}_difference, 100 * (s.{m} - b.{m}) / nullif(b.{m}, 0) AS {m}_percent" for m in FLOWS)
        + " FROM summary s JOIN summary b ON s.year = b.year AND b.grp = '1-URGENT'",
        real=" ".join(f"{m} {m}_difference {m}_percent" for m in FLOWS), ints="year",
        dates="common_start common_end", digits=5)),
    "period_pair": Query(run_period_pair, shaped(f"""WITH {_SUMMARY}, pairs AS ({_PAIR}) --final
        SELECT *, value_b - value_a AS "change", 100 * (value_b - value_a) / nullif(value_a, 0) AS percent_change,
          value_b / nullif(value_a, 0) AS ratio FROM pairs""",
        real='value_a value_b "change" percent_change ratio', digits=5)),
    "direction_consistency": Query(run_direction, shaped(f"""WITH {_SUMMARY},
        d AS (SELECT s.year, s.grp, s.mean_level - b.mean_level AS x FROM summary s
              JOIN summary b ON s.year = b.year AND b.grp = '1-URGENT' WHERE s.grp <> '1-URGENT') --final
        SELECT p.grp, p.x AS difference_a, q.x AS difference_b, sign(p.x) = sign(q.x) AS same_direction
        FROM d p JOIN d q ON p.grp = q.grp AND p.year = 1996 AND q.year = 1999""", real="difference_a difference_b")),
    "lookup_map": Query(run_lookup, f"WITH {_ASSIGNED} SELECT agronomy, count(*) AS n, sum(l_quantity) AS q FROM assigned GROUP BY 1"),
    "range_map": Query(run_range_map,
        f"WITH {_ASSIGNED} SELECT l_returnflag, plot, count(*) AS n, sum(l_quantity) AS q FROM assigned GROUP BY 1, 2"),
    "unresolved": Query(run_unresolved, f"""WITH {_ASSIGNED} SELECT l_returnflag, l_linestatus, count(*) AS n_unresolved
        FROM assigned WHERE agronomy IS NULL OR plot IS NULL GROUP BY 1, 2"""),
    "composite_key": Query(run_composite_key,
        "SELECT l_returnflag || '_' || l_linestatus AS key, count(*) AS n FROM lineitem GROUP BY 1"),
}
