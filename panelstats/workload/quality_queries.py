"""Coverage, missingness, duplicates, reproduction checks, rule reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelstats.operators import joins, quality
from panelstats.sources.tables import where_present
from panelstats.workload.common import (
    N_YEARS, ORDER_DAYS, PART_PANEL, Query, order_days, part_panel, shape, shaped, table,
)

BY = ["year", "grp"]
VARIABLES = ["inflow", "outflow", "net", "model", "level"]


def run_date_coverage(spark, folder):
    return shape(quality.date_coverage(order_days(spark, folder), BY, "date"))


def run_missingness(spark, folder):
    return shape(quality.missingness(order_days(spark, folder), BY, VARIABLES))


def run_negatives(spark, folder):
    return shape(quality.negatives(order_days(spark, folder), BY, ["net", "model", "level"]))


def run_duplicate_rows(spark, folder):
    line = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return shape(quality.duplicate_rows(line, ["l_orderkey", "l_linenumber"]))


def run_duplicate_summary(spark, folder):
    return shape(quality.surplus_rows(part_panel(spark, folder), ["unit", "year"]))


def _line_balance(spark, folder):
    """Charge rebuilt from price, discount and tax against the price less the discount."""
    line = table(spark, folder, "lineitem")
    p, d, t = F.col("l_extendedprice"), F.col("l_discount"), F.col("l_tax")
    return line.select(
        "l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus",
        p.alias("price"), (p * t).alias("tax"), (p * d).alias("discount"),
        F.when(F.col("l_linenumber") % 3 != 0, F.round(p * (1 - d) * (1 + t), 0)).alias("reported"),
    )


def run_balance(spark, folder):
    out = quality.recompute_balance(_line_balance(spark, folder), ["price", "tax"], ["discount"], "reported")
    return shape(out.groupBy("l_linestatus").agg(
        F.count("recalculated").alias("n"), F.count("difference").alias("n_compared"),
        F.avg("recalculated").alias("mean_recalculated"), F.max("absolute_difference").alias("max_difference"),
    ), 4)


def run_reproduction_error(spark, folder):
    out = quality.recompute_balance(_line_balance(spark, folder), ["price", "tax"], ["discount"], "reported")
    return shape(quality.reproduction_error(out, ["l_returnflag"], "recalculated", "reported", "present"), 4)


def run_net_reproduction(spark, folder):
    rows = order_days(spark, folder).withColumn("net_reported", F.round("net", 2))
    return shape(quality.reproduction_error(where_present(rows, ["net_reported"]), BY, "net", "net_reported"))


def run_group_sizes(spark, folder):
    return shape(quality.group_sizes(order_days(spark, folder), BY))


def run_group_qa(spark, folder):
    c = table(spark, folder, "customer").withColumn("segment", F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")))
    return shape(quality.group_qa(c, ["c_nationkey", "segment"], "c_acctbal"))


def run_condition_shares(spark, folder):
    return shape(quality.condition_shares(order_days(spark, folder), BY, {
        "inflow": F.col("inflow") > 0, "negative_net": F.col("net") < 0,
    }))


def run_qa_summary(spark, folder):
    return shape(quality.qa_summary(part_panel(spark, folder), ["unit"], "year", "area", "value", "support", digits=8), 8)


def run_completeness(spark, folder):
    panel = part_panel(spark, folder)
    out = quality.completeness(panel, ["unit"], "year", "area")
    filled = joins.with_spine(spark, out, "year", 1993, 2003, ["n_records", "n_keys"], ["areas"])
    return shape(filled)


def _gappy_panel(spark, folder):
    """The panel with units, years, areas and values missing by rules on the row."""
    line = table(spark, folder, "lineitem")
    gone = lambda rule, c: F.when(~F.expr(rule), F.col(c))
    return line.withColumn("y", F.year("l_shipdate")).select(
        gone("l_partkey % 10 = 3", "l_partkey").alias("unit"), gone("l_suppkey % 7 = 2", "y").alias("year"),
        gone("l_tax = 0", "l_discount").alias("value"), F.col("l_linenumber").alias("support"),
        gone("l_returnflag = 'A' AND l_linenumber = 1", "l_returnflag").alias("area"))


_GAPPY = """
gappy AS (
  SELECT CASE WHEN NOT l_partkey % 10 = 3 THEN l_partkey END AS unit, CASE WHEN NOT l_suppkey % 7 = 2 THEN year(l_shipdate) END AS year,
    CASE WHEN NOT l_tax = 0 THEN l_discount END AS value, l_linenumber AS support,
    CASE WHEN NOT (l_returnflag = 'A' AND l_linenumber = 1) THEN l_returnflag END AS area FROM lineitem),
known AS (SELECT * FROM gappy WHERE unit IS NOT NULL AND year IS NOT NULL)"""


def run_qa_missing(spark, folder):
    """Whole-table QA where identity is missing in a part of the rows."""
    return shape(quality.qa_summary(_gappy_panel(spark, folder), ["unit"], "year", "area", "value", "support", digits=8), 8)


def run_completeness_missing(spark, folder):
    return shape(quality.completeness(_gappy_panel(spark, folder), ["unit"], "year", "area"))


def run_unstable_keys(spark, folder):
    return shape(quality.unstable_keys(part_panel(spark, folder), ["unit"], "area"))


def run_freq_share(spark, folder):
    return shape(quality.frequency(part_panel(spark, folder), "support"))


def run_value_frequency(spark, folder):
    return shape(quality.value_frequency(table(spark, folder, "part"), "p_type"))


def run_numeric_text_order(spark, folder):
    sizes = table(spark, folder, "part").select(F.col("p_size").cast("string").alias("size_text"))
    return shape(quality.frequency(sizes, "size_text"))


def run_diagnostics(spark, folder):
    return shape(quality.diagnostics(part_panel(spark, folder), ["unit"], "year", "area", "value", N_YEARS))


def run_rules(spark, folder):
    panel = part_panel(spark, folder)
    orders = table(spark, folder, "orders")
    line = table(spark, folder, "lineitem")
    values = quality.rule_report(panel, {
        "value_in_unit_range": F.col("value").between(0, 1),
        "value_below_nine_percent": F.col("value") < 0.09,
        "support_positive": F.col("support") > 0,
    })
    shape_rules = quality.expect_values(panel, {
        "year_min": (F.min("year"), 1995),
        "year_max": (F.max("year"), 2001),
        "n_years": (F.countDistinct("year"), N_YEARS),
    })
    unique = quality.expect_unique(orders, ["o_orderkey"], "unique_orders")
    unique_lines = quality.expect_unique(line, ["l_orderkey", "l_linenumber"], "unique_lines")
    even = quality.expect_equal_sizes(orders.withColumn("year", F.year("o_orderdate")), "year", 1000)
    found = quality.expect_present(
        line.select(F.col("l_orderkey").alias("o_orderkey")), orders, ["o_orderkey"], "orders_present"
    )
    unused = quality.expect_present(
        orders, line.select(F.col("l_orderkey").alias("o_orderkey")), ["o_orderkey"], "orders_with_lines"
    )
    return shape(joins.union_all([values, shape_rules, unique, unique_lines, even, found, unused]))


def run_spine_counts(spark, folder):
    orders = table(spark, folder, "orders")
    counts = quality.group_sizes(orders.withColumn("year", F.year("o_orderdate")), ["year"])
    return shape(joins.with_spine(spark, counts, "year", 1992, 2004, ["n_rows"]))


_RULES = [
    ("value_in_unit_range", "SELECT count(*) FILTER (NOT value BETWEEN 0 AND 1) FROM panel"),
    ("value_below_nine_percent", "SELECT count(*) FILTER (NOT value < 0.09) FROM panel"),
    ("support_positive", "SELECT count(*) FILTER (NOT support > 0) FROM panel"),
    ("year_min", "SELECT CASE WHEN min(year) = 1995 THEN 0 ELSE 1 END FROM panel"),
    ("year_max", "SELECT CASE WHEN max(year) = 2001 THEN 0 ELSE 1 END FROM panel"),
    ("n_years", "SELECT CASE WHEN count(DISTINCT year) = 7 THEN 0 ELSE 1 END FROM panel"),
    ("unique_orders", "SELECT count(*) - count(DISTINCT o_orderkey) FROM orders"),
    ("unique_lines", "SELECT count(*) - count(DISTINCT (l_orderkey, l_linenumber)) FROM lineitem"),
    ("equal_sizes", "SELECT count(*) FROM (SELECT year(o_orderdate) y, count(*) n FROM orders GROUP BY 1) WHERE n <> 1000"),
    ("orders_present", "SELECT count(DISTINCT l_orderkey) FROM lineitem ANTI JOIN orders ON l_orderkey = o_orderkey"),
    ("orders_with_lines", "SELECT count(DISTINCT o_orderkey) FROM orders ANTI JOIN lineitem ON l_orderkey = o_orderkey"),
]
_BALANCE = """
lines AS (
  SELECT *, l_extendedprice + l_extendedprice * l_tax - l_extendedprice * l_discount AS recalculated,
    CASE WHEN l_linenumber % 3 <> 0 THEN round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 0) END AS reported
  FROM lineitem),
diffs AS (SELECT *, recalculated - reported AS difference FROM lines)"""


def _long(columns, template: str) -> str:
    return " UNION ALL ".join(template.format(c=c) for c in columns)


QUERIES = {
    "date_coverage": Query(run_date_coverage, shaped(f"""WITH {ORDER_DAYS} --final
        SELECT year, grp, count(*) AS n_rows, min(date) AS first_date, max(date) AS last_date,
          count(DISTINCT date) AS n_unique_dates, date_diff('day', min(date), max(date)) + 1 AS expected_calendar_days,
          date_diff('day', min(date), max(date)) + 1 - count(DISTINCT date) AS missing_calendar_days
        FROM order_days GROUP BY 1, 2""", ints="year", dates="first_date last_date")),
    "missingness": Query(run_missingness, shaped(f"WITH {ORDER_DAYS} --final " + _long(VARIABLES, """
        SELECT year, grp, '{c}' AS variable, count(*) AS n_rows, count(*) - count({c}) AS n_missing,
          100 * (count(*) - count({c})) / count(*) AS percent_missing FROM order_days GROUP BY 1, 2"""),
        real="percent_missing", ints="year")),
    "negatives": Query(run_negatives, shaped(f"WITH {ORDER_DAYS} --final " + _long(["net", "model", "level"], """
        SELECT year, grp, '{c}' AS variable, count({c}) AS n_valid, count(*) FILTER ({c} < 0) AS n_negative,
          min({c}) AS minimum, max({c}) AS maximum, 100 * count(*) FILTER ({c} < 0) / count({c}) AS percent_negative
        FROM order_days GROUP BY 1, 2 HAVING count({c}) > 0"""), real="minimum maximum percent_negative", ints="year")),
    "duplicate_rows": Query(run_duplicate_rows, shaped("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM (
        SELECT *, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS m FROM lineitem) WHERE m > 1""",
        ints="l_linenumber")),
    "duplicate_summary": Query(run_duplicate_summary, f"""WITH {PART_PANEL},
        k AS (SELECT unit, year, count(*) AS m FROM panel GROUP BY 1, 2)
        SELECT CAST(sum(m) AS BIGINT) AS n_rows, count(*) AS n_keys, CAST(sum(m - 1) AS BIGINT) AS n_surplus,
          count(*) FILTER (m > 1) AS n_repeated_keys FROM k"""),
    "balance": Query(run_balance, shaped(f"""WITH {_BALANCE} --final SELECT l_linestatus, count(recalculated) AS n,
        count(difference) AS n_compared, avg(recalculated) AS mean_recalculated, max(abs(difference)) AS max_difference
        FROM diffs GROUP BY 1""", real="mean_recalculated max_difference", digits=4)),
    "reproduction_error": Query(run_reproduction_error, shaped(f"""WITH {_BALANCE} --final
        SELECT l_returnflag, count(difference) AS n_compared, avg(difference) AS mean_difference,
          max(abs(difference)) AS max_absolute_difference, sqrt(avg(difference * difference)) AS rmse
        FROM diffs GROUP BY 1""", real="mean_difference max_absolute_difference rmse", digits=4)),
    "net_reproduction": Query(run_net_reproduction, shaped(f"""WITH {ORDER_DAYS} --final
        SELECT year, grp, count(*) AS n_compared, avg(net - round(net, 2)) AS mean_difference,
          max(abs(net - round(net, 2))) AS max_absolute_difference,
          sqrt(avg((net - round(net, 2)) * (net - round(net, 2)))) AS rmse
        FROM order_days WHERE net IS NOT NULL GROUP BY 1, 2""",
        real="mean_difference max_absolute_difference rmse", ints="year")),
    "group_sizes": Query(run_group_sizes, shaped(
        f"WITH {ORDER_DAYS} --final SELECT year, grp, count(*) AS n_rows FROM order_days GROUP BY 1, 2", ints="year")),
    "group_qa": Query(run_group_qa, shaped("""SELECT c_nationkey, nullif(c_mktsegment, 'BUILDING') AS segment,
        count(*) AS n_rows, avg(c_acctbal) AS mean_value, min(c_acctbal) AS min_value, max(c_acctbal) AS max_value
        FROM customer GROUP BY 1, 2""", real="mean_value min_value max_value", ints="c_nationkey")),
    "condition_shares": Query(run_condition_shares, shaped(f"""WITH {ORDER_DAYS} --final
        SELECT year, grp, count(*) AS n_rows, count(*) FILTER (inflow > 0) AS n_inflow,
          count(*) FILTER (net < 0) AS n_negative_net, count(*) FILTER (inflow > 0) / count(*) AS fraction_inflow,
          count(*) FILTER (net < 0) / count(*) AS fraction_negative_net FROM order_days GROUP BY 1, 2""",
        real="fraction_inflow fraction_negative_net", ints="year")),
    "qa_summary": Query(run_qa_summary, shaped(f"""WITH {PART_PANEL} --final
        SELECT count(*) AS n_rows, min(year) AS period_min, max(year) AS period_max, count(DISTINCT year) AS n_periods,
          count(DISTINCT unit) AS unique_keys, string_agg(DISTINCT area, ',' ORDER BY area) AS areas,
          min(value) AS value_min, max(value) AS value_max, round_even(avg(value), 8) AS value_mean,
          min(support) AS support_min, max(support) AS support_max, min(unit) AS unit_min, max(unit) AS unit_max,
          count(*) - count(DISTINCT (unit, year)) AS duplicate_key_periods,
          count(*) - count(unit) AS missing_unit, count(*) - count(area) AS missing_area,
          count(*) - count(year) AS missing_year, count(*) - count(value) AS missing_value,
          count(*) - count(support) AS missing_support FROM panel""",
        ints="period_min period_max support_min support_max")),
    "qa_missing": Query(run_qa_missing, shaped(f"""WITH {_GAPPY} --final
        SELECT (SELECT count(*) FROM gappy) AS n_rows, min(year) AS period_min, max(year) AS period_max,
          count(DISTINCT year) AS n_periods, count(DISTINCT unit) AS unique_keys, min(unit) AS unit_min, max(unit) AS unit_max,
          count(*) - count(DISTINCT (unit, year)) AS duplicate_key_periods, any_value(g.areas) AS areas,
          any_value(g.value_min) AS value_min, any_value(g.value_max) AS value_max, any_value(g.value_mean) AS value_mean,
          any_value(g.support_min) AS support_min, any_value(g.support_max) AS support_max,
          any_value(g.missing_unit) AS missing_unit, any_value(g.missing_area) AS missing_area,
          any_value(g.missing_year) AS missing_year, any_value(g.missing_value) AS missing_value,
          any_value(g.missing_support) AS missing_support
        FROM known, (
          SELECT string_agg(DISTINCT area, ',' ORDER BY area) AS areas, min(value) AS value_min, max(value) AS value_max,
            round_even(avg(value), 8) AS value_mean, min(support) AS support_min, max(support) AS support_max,
            count(*) - count(unit) AS missing_unit, count(*) - count(area) AS missing_area, count(*) - count(year) AS missing_year,
            count(*) - count(value) AS missing_value, count(*) - count(support) AS missing_support FROM gappy) g""",
        ints="period_min period_max support_min support_max")),
    "completeness_missing": Query(run_completeness_missing, shaped(f"""WITH {_GAPPY} --final
        SELECT year, count(unit) AS n_records, count(DISTINCT unit) AS n_keys, string_agg(DISTINCT area, ',' ORDER BY area) AS areas
        FROM gappy WHERE year IS NOT NULL GROUP BY 1""", ints="year")),
    "completeness": Query(run_completeness, shaped(f"""WITH {PART_PANEL},
        c AS (SELECT year, count(*) AS r, count(DISTINCT unit) AS k, string_agg(DISTINCT area, ',' ORDER BY area) AS a
              FROM panel GROUP BY 1) --final
        SELECT y.year, coalesce(r, 0) AS n_records, coalesce(k, 0) AS n_keys, coalesce(a, '') AS areas
        FROM generate_series(1993, 2003) y(year) LEFT JOIN c USING (year)""", ints="year")),
    "unstable_keys": Query(run_unstable_keys, f"""WITH {PART_PANEL} SELECT unit, count(DISTINCT area) AS n_categories,
        string_agg(DISTINCT area, ',' ORDER BY area) AS categories FROM panel GROUP BY 1 HAVING count(DISTINCT area) > 1"""),
    "freq_share": Query(run_freq_share, shaped(f"""WITH {PART_PANEL} --final SELECT support, count(*) AS n_records,
        round_even(100 * count(*) / sum(count(*)) OVER (), 3) AS percent FROM panel GROUP BY 1""",
        ints="support")),
    "value_frequency": Query(run_value_frequency, "SELECT p_type, count(*) AS n_records FROM part GROUP BY 1"),
    "numeric_text_order": Query(run_numeric_text_order, """SELECT CAST(p_size AS VARCHAR) AS size_text,
        count(*) AS n_records, round_even(100 * count(*) / sum(count(*)) OVER (), 3) AS percent
        FROM part GROUP BY p_size"""),
    "diagnostics": Query(run_diagnostics, shaped(f"""WITH {PART_PANEL} --final
        SELECT count(*) AS n_rows, count(DISTINCT unit) AS unique_keys,
          (SELECT count(*) FROM cov WHERE n_periods = 7) AS balanced_keys, (SELECT count(*) FROM bal) AS balanced_rows,
          min(year) AS period_min, max(year) AS period_max, count(DISTINCT year) AS n_periods,
          count(*) - count(value) AS missing_values, count(*) - count(DISTINCT (unit, year)) AS duplicate_key_periods,
          (SELECT string_agg(DISTINCT area, ',' ORDER BY area) FROM bal) AS balanced_areas FROM panel""",
        ints="period_min period_max")),
    "dq_gates": Query(run_rules, f"WITH {PART_PANEL} SELECT rule, CAST(failed AS BIGINT) AS failed, failed = 0 AS passed FROM ("
        + " UNION ALL ".join(f"SELECT '{r}' AS rule, ({q}) AS failed" for r, q in _RULES) + ")"),
    "spine_counts": Query(run_spine_counts, shaped("""SELECT y.year, coalesce(n, 0) AS n_rows
        FROM generate_series(1992, 2004) y(year)
        LEFT JOIN (SELECT year(o_orderdate) AS year, count(*) AS n FROM orders GROUP BY 1) USING (year)""", ints="year")),
}
