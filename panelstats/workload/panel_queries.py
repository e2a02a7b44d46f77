"""Unit-by-period panel, its summaries and changes, and the daily-series summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelstats.functions.scalar import weighted_mean
from panelstats.operators import joins, panel, quality, series
from panelstats.sources import tables
from panelstats.workload.common import (
    COMMON_DAYS, N_YEARS, ORDER_DAYS, PART_PANEL, UNIT, Query, order_days, part_panel, shape, shaped, table,
)

BY = ["year", "grp"]


def run_coverage_hist(spark, folder):
    return shape(panel.coverage_histogram(part_panel(spark, folder), ["unit"], "year"))


def run_balanced_panel(spark, folder):
    rows = panel.balanced_panel(part_panel(spark, folder), ["unit"], "year", N_YEARS)
    return shape(rows.groupBy("year").agg(F.count("*").alias("n_rows"), F.countDistinct("unit").alias("n_units")))


def run_annual_summary(spark, folder):
    return shape(panel.annual_summary(part_panel(spark, folder), ["year"], "value", "support"))


def run_subarea_annual(spark, folder):
    rows = panel.balanced_panel(part_panel(spark, folder), ["unit"], "year", N_YEARS)
    return shape(panel.annual_summary(rows, ["area", "year"], "value", "support"))


def run_annual_table(spark, folder):
    return shape(panel.annual_table(part_panel(spark, folder), ["unit"], "year", "value", "support", N_YEARS))


def run_weighted_mean(spark, folder):
    rows = table(spark, folder, "lineitem").withColumn("brandless", F.col("l_suppkey") % 10)
    return shape(rows.groupBy("brandless").agg(weighted_mean("l_extendedprice", "l_tax").alias("weighted")), 4)


def run_full_vs_balanced(spark, folder):
    marked = panel.mark_balanced(part_panel(spark, folder), ["unit"], "year", N_YEARS)
    return shape(panel.compare_populations(marked, ["year"], "balanced", "value"))


def run_support_filtered(spark, folder):
    rows = part_panel(spark, folder).where("support >= 3")
    return shape(panel.annual_summary(rows, ["year"], "value", "support").select("year", "n", "mean_value", "median_value"))


def _area_years(spark, folder):
    rows = part_panel(spark, folder)
    return rows.groupBy("area", "year").agg(F.avg("value").alias("y"))


def run_block_change(spark, folder):
    return shape(panel.block_change(_area_years(spark, folder), ["area"], "year", "y", (1995, 1997), (1999, 2001)))


def run_endpoint_change(spark, folder):
    return shape(panel.endpoint_change(_area_years(spark, folder), ["area"], "year", "y", 1995, 2001))


def run_series_for_plot(spark, folder):
    rows = part_panel(spark, folder)
    marked = panel.mark_balanced(rows, ["unit"], "year", N_YEARS)
    annual = marked.groupBy("year").agg(
        F.avg("value").alias("full"), F.avg(F.when(F.col("balanced"), F.col("value"))).alias("balanced")
    )
    return shape(series.series_for_plot({
        "levels": (annual, "year", ["balanced", "full"], None),
        "areas": (_area_years(spark, folder), "year", ["y"], "area"),
    }))


# ---- daily series -------------------------------------------------------------

SUMS = ["inflow", "outflow", "net", "rain"]


def run_season_summary(spark, folder):
    return shape(series.season_summary(order_days(spark, folder), BY, "date", SUMS, ["model"], "level"))


def run_common_window(spark, folder):
    rows = series.common_window(order_days(spark, folder), "year", "grp", "date")
    return shape(rows.select("year", "grp", "date", "common_start", "common_end", "level"))


def common_summary(spark, folder):
    return series.common_window_summary(order_days(spark, folder), "year", "grp", "date", SUMS, ["model"], "level")


def run_common_window_summary(spark, folder):
    return shape(common_summary(spark, folder))


def run_publication_table(spark, folder):
    """Renamed subset with the fraction as percent, rounded for reporting."""
    out = common_summary(spark, folder).withColumn("positive_percent", 100 * F.col("fraction_positive"))
    named = tables.select_rename(out, {
        "year": "year", "grp": "priority", "n_days": "n_days", "inflow_sum": "measured_inflow",
        "net_sum": "derived_net", "positive_percent": "positive_percent",
    })
    return shape(tables.report(named, digits={"measured_inflow": 2, "derived_net": 2, "positive_percent": 1}))


def run_event_structure(spark, folder):
    rows = series.common_window(order_days(spark, folder), "year", "grp", "date")
    return shape(series.event_structure(rows, BY, "inflow", "outflow", "net"))


def run_group_consistency(spark, folder):
    return shape(series.consistency(order_days(spark, folder), "year", "date", "grp", "rain"))


def run_aligned_groups(spark, folder):
    return shape(series.align_groups(order_days(spark, folder), "year", "date", "grp", "level"))


def run_profile(spark, folder):
    rows = table(spark, folder, "lineitem").select(
        "l_returnflag", "l_quantity", "l_discount", (F.col("l_extendedprice") / UNIT).alias("price"),
        (F.col("l_quantity") - 25).alias("balance"))
    return shape(series.profile(rows, ["l_returnflag"], ["l_quantity", "l_discount", "price", "balance"]), 4)


def run_sensor_summary(spark, folder):
    rows = table(spark, folder, "events").withColumn("date", F.to_date("ts"))
    return shape(series.entity_summary(rows, ["event_type", "user_id"], "date", "value"))


def _platform(spark, folder):
    rows = table(spark, folder, "events").select(F.year("ts").alias("year"), F.to_date("ts").alias("date"), "value")
    return series.spatial_mean(rows, ["year", "date"], "value")


def run_platform_daily(spark, folder):
    return shape(_platform(spark, folder))


def run_surface_daily(spark, folder):
    return shape(series.mixed_daily(order_days(spark, folder), ["year", "date"], ["rain", "level"], ["inflow", "outflow"]))


def run_monthly_resample(spark, folder):
    days = order_days(spark, folder)
    return shape(series.resample_month(days, ["grp"], "date", {
        "mean_model": F.avg("model"), "min_model": F.min("model"), "max_model": F.max("model"),
    }))


def run_aligned_sources(spark, folder):
    """Two daily aggregates of different tables on their shared dates."""
    orders = table(spark, folder, "orders").groupBy(F.to_date("o_orderdate").alias("date")).agg(
        F.count("*").alias("n_orders"))
    lines = table(spark, folder, "lineitem").groupBy(F.to_date("l_shipdate").alias("date")).agg(
        F.count("*").alias("n_lines"))
    return shape(joins.align(orders, lines, ["date"]))


def run_merge_checked(spark, folder):
    """Three per-year tables merged one to one, one of them optional."""
    rows = part_panel(spark, folder)
    full = rows.groupBy("year").agg(F.avg("value").alias("mean_full"))
    late = rows.where("support >= 5").groupBy("year").agg(F.count("*").alias("n_late"))
    early = rows.where("support <= 2 and year >= 1997").groupBy("year").agg(F.count("*").alias("n_early"))
    out = joins.merge_checked(full, late, ["year"])
    return shape(joins.merge_checked(out, early, ["year"], "left"))


def run_union_distinct(spark, folder):
    orders = table(spark, folder, "orders").select(F.year("o_orderdate").alias("year"), F.col("o_orderstatus").alias("flag"))
    lines = table(spark, folder, "lineitem").select(F.year("l_shipdate").alias("year"), F.col("l_returnflag").alias("flag"))
    return shape(joins.distinct_rows(joins.union_all([orders, lines]), ["year", "flag"]))


def run_restrict(spark, folder):
    """Rows of the customers that have orders of every priority."""
    orders = table(spark, folder, "orders")
    keys = panel.balanced_keys(orders, ["o_custkey"], "o_orderpriority", 5)
    kept = joins.restrict_to_keys(orders, keys, ["o_custkey"])
    return shape(quality.group_sizes(kept, ["o_orderstatus"]))


def _annual(source: str, by: str) -> str:
    return f"""SELECT {by}, count(*) AS n, avg(value) AS mean_value, median(value) AS median_value,
      stddev_samp(value) AS sd_value, avg(support) AS mean_support, stddev_samp(value) / sqrt(count(*)) AS spatial_se,
      sum(value * support) FILTER (support > 0) / sum(support) FILTER (support > 0) AS weighted_mean
      FROM {source} GROUP BY {by}"""


_ANNUAL_REAL = "mean_value median_value sd_value mean_support spatial_se weighted_mean"
_CHANGE = "absolute_change relative_change_percent"
_AREA_YEARS = PART_PANEL + ", area_years AS (SELECT area, year, avg(value) AS y FROM panel GROUP BY 1, 2)"


def _season(source: str, keep: str = "") -> str:
    kept = "".join(f"min({c}) AS {c}, " for c in keep.split())
    return f"""SELECT year, grp, {kept}min(date) AS start_date, max(date) AS end_date, count(*) AS n_days,
      coalesce(sum(inflow), 0) AS inflow_sum, coalesce(sum(outflow), 0) AS outflow_sum,
      coalesce(sum(net), 0) AS net_sum, coalesce(sum(rain), 0) AS rain_sum, sum(model) AS model_sum,
      avg(level) AS mean_level, max(level) AS max_level, count(*) FILTER (level > 0) AS positive_days,
      count(level) AS valid_days, count(*) FILTER (level > 0) / count(level) AS fraction_positive
      FROM {source} GROUP BY 1, 2"""


_SEASON_REAL = "inflow_sum outflow_sum net_sum rain_sum model_sum mean_level max_level fraction_positive"


def _profile(c: str, expr: str) -> str:
    return f"""SELECT l_returnflag, '{c}' AS variable, count(*) AS n_rows, count({expr}) AS n, sum({expr}) AS "sum",
      avg({expr}) AS mean, stddev_samp({expr}) AS sd, min({expr}) AS "min", max({expr}) AS "max",
      count(*) FILTER ({expr} = 0) AS n_zero, count(*) FILTER ({expr} < 0) AS n_negative,
      quantile_cont({expr}, 0.05) AS p05, quantile_cont({expr}, 0.25) AS p25, median({expr}) AS median,
      quantile_cont({expr}, 0.75) AS p75, quantile_cont({expr}, 0.95) AS p95,
      100 * count(*) FILTER ({expr} = 0) / count({expr}) AS pct_zero,
      100 * count(*) FILTER ({expr} < 0) / count({expr}) AS pct_negative FROM lineitem GROUP BY 1"""


QUERIES = {
    "coverage_hist": Query(run_coverage_hist, f"WITH {PART_PANEL} SELECT n_periods, count(*) AS n_keys FROM cov GROUP BY 1"),
    "balanced_panel": Query(run_balanced_panel, shaped(f"""WITH {PART_PANEL} --final
        SELECT year, count(*) AS n_rows, count(DISTINCT unit) AS n_units FROM bal GROUP BY 1""", ints="year")),
    "annual_summary": Query(run_annual_summary, shaped(
        f"WITH {PART_PANEL} --final {_annual('panel', 'year')}", real=_ANNUAL_REAL, ints="year")),
    "subarea_annual": Query(run_subarea_annual, shaped(
        f"WITH {PART_PANEL} --final {_annual('bal', 'area, year')}", real=_ANNUAL_REAL, ints="year")),
    "annual_table": Query(run_annual_table, shaped(f"""WITH {PART_PANEL},
        b AS ({_annual('bal', 'year')}), f AS ({_annual('panel', 'year')}),
        c AS ({_annual('bal WHERE support >= 3', 'year')}) --final
        SELECT b.year, b.n AS n_balanced, b.mean_value AS mean_balanced, b.median_value AS median_balanced,
          b.sd_value AS sd_balanced, b.mean_support, b.spatial_se AS spatial_se_balanced, f.n AS n_full,
          f.mean_value AS mean_full, f.median_value AS median_full, f.sd_value AS sd_full,
          c.n AS n_balanced_support_ge3, c.mean_value AS mean_balanced_support_ge3,
          c.median_value AS median_balanced_support_ge3, b.weighted_mean AS mean_balanced_weighted,
          f.mean_value - b.mean_value AS full_minus_balanced
        FROM b JOIN f USING (year) LEFT JOIN c USING (year)""",
        real="mean_balanced median_balanced sd_balanced mean_support spatial_se_balanced mean_full median_full sd_full "
             "mean_balanced_support_ge3 median_balanced_support_ge3 mean_balanced_weighted full_minus_balanced",
        ints="year")),
    "weighted_mean": Query(run_weighted_mean, shaped("""SELECT l_suppkey % 10 AS brandless,
        sum(l_extendedprice * l_tax) FILTER (l_tax > 0) / sum(l_tax) FILTER (l_tax > 0) AS weighted
        FROM lineitem GROUP BY 1""", real="weighted", digits=4)),
    "full_vs_balanced": Query(run_full_vs_balanced, shaped(f"""WITH {PART_PANEL},
        m AS (SELECT p.*, c.n_periods = 7 AS inside FROM panel p JOIN cov c USING (unit)) --final
        SELECT year, count(*) AS n_full, round_even(avg(value), 6) AS mean_full, count(*) FILTER (inside) AS n_balanced,
          round_even(avg(value) FILTER (inside), 6) AS mean_balanced,
          round_even(avg(value) FILTER (inside) - avg(value), 6) AS difference FROM m GROUP BY 1""",
        real="difference", ints="year")),
    "support_filtered": Query(run_support_filtered, shaped(f"""WITH {PART_PANEL} --final SELECT year, n, mean_value,
        median_value FROM ({_annual('panel WHERE support >= 3', 'year')})""", real="mean_value median_value", ints="year")),
    "block_change": Query(run_block_change, shaped(f"""WITH {_AREA_YEARS},
        c AS (SELECT area, avg(y) FILTER (year BETWEEN 1995 AND 1997) AS early_mean,
                     avg(y) FILTER (year BETWEEN 1999 AND 2001) AS late_mean FROM area_years GROUP BY 1) --final
        SELECT *, late_mean - early_mean AS absolute_change,
          100 * (late_mean - early_mean) / early_mean AS relative_change_percent FROM c""",
        real=f"early_mean late_mean {_CHANGE}")),
    "endpoint_change": Query(run_endpoint_change, shaped(f"""WITH {_AREA_YEARS},
        c AS (SELECT area, max(y) FILTER (year = 1995) AS first_value_, max(y) FILTER (year = 2001) AS last_value_
              FROM area_years GROUP BY 1) --final
        SELECT area, first_value_ AS "first_value", last_value_ AS "last_value",
          last_value_ - first_value_ AS absolute_change,
          100 * (last_value_ - first_value_) / first_value_ AS relative_change_percent FROM c""",
        real=f'"first_value" "last_value" {_CHANGE}')),
    "series_for_plot": Query(run_series_for_plot, shaped(f"""WITH {_AREA_YEARS} --final
        SELECT 'levels' AS panel, 'full' AS series, CAST(year AS DOUBLE) AS x, avg(value) AS y FROM panel GROUP BY year
        UNION ALL SELECT 'levels', 'balanced', CAST(year AS DOUBLE), avg(value) FROM bal GROUP BY year
        UNION ALL SELECT 'areas', area, CAST(year AS DOUBLE), y FROM area_years""", real="y")),
    "season_summary": Query(run_season_summary, shaped(
        f"WITH {ORDER_DAYS} --final {_season('order_days')}", real=_SEASON_REAL, ints="year", dates="start_date end_date")),
    "common_window": Query(run_common_window, shaped(f"""WITH {COMMON_DAYS} --final
        SELECT year, grp, date, common_start, common_end, level FROM common_days""",
        real="level", ints="year", dates="date common_start common_end")),
    "common_window_summary": Query(run_common_window_summary, shaped(
        f"WITH {COMMON_DAYS} --final {_season('common_days', 'common_start common_end')}",
        real=_SEASON_REAL, ints="year", dates="common_start common_end start_date end_date")),
    "publication_table": Query(run_publication_table, shaped(f"""WITH {COMMON_DAYS} --final
        SELECT year, grp AS priority, n_days, round(inflow_sum, 2) AS measured_inflow, round(net_sum, 2) AS derived_net,
          round(100 * fraction_positive, 1) AS positive_percent FROM ({_season('common_days')})""", ints="year")),
    "event_structure": Query(run_event_structure, shaped(f"""WITH {COMMON_DAYS} --final
        SELECT year, grp, count(*) AS n_days, count(*) FILTER (inflow > 0) AS days_positive_inflow,
          count(*) FILTER (inflow > 0) / count(*) AS fraction_positive_inflow, coalesce(sum(inflow), 0) AS total_inflow,
          avg(inflow) AS mean_inflow_all_days, avg(inflow) FILTER (inflow > 0) AS mean_inflow_positive_days,
          median(inflow) FILTER (inflow > 0) AS median_inflow_positive_days, max(inflow) AS max_inflow,
          count(*) FILTER (outflow > 0) AS days_positive_outflow,
          count(*) FILTER (outflow > 0) / count(*) AS fraction_positive_outflow,
          count(*) FILTER (net < 0) AS days_negative_balance,
          count(*) FILTER (net < 0) / count(*) AS fraction_negative_balance FROM common_days GROUP BY 1, 2""",
        real="fraction_positive_inflow total_inflow mean_inflow_all_days mean_inflow_positive_days "
             "median_inflow_positive_days max_inflow fraction_positive_outflow fraction_negative_balance", ints="year")),
    "group_consistency": Query(run_group_consistency, shaped(f"""WITH {ORDER_DAYS},
        a AS (SELECT year, date, max(rain) - min(rain) AS spread FROM order_days GROUP BY 1, 2
              HAVING count(DISTINCT grp) = 5) --final
        SELECT year, count(*) AS n_common_dates, max(spread) AS max_spread,
          count(*) FILTER (spread > 1e-9) AS days_differing FROM a GROUP BY 1""", real="max_spread", ints="year")),
    "aligned_groups": Query(run_aligned_groups, shaped(f"""WITH {ORDER_DAYS} --final
        SELECT year, date, max(level) AS highest, min(level) AS lowest, max(level) - min(level) AS spread
        FROM order_days GROUP BY 1, 2 HAVING count(DISTINCT grp) = 5""",
        real="highest lowest spread", ints="year", dates="date")),
    "distribution_profile": Query(run_profile, shaped(" UNION ALL ".join([
        _profile("l_quantity", "l_quantity"), _profile("l_discount", "l_discount"),
        _profile("price", "(l_extendedprice / 997)"), _profile("balance", "(l_quantity - 25)")]),
        real='"sum" mean sd "min" "max" p05 p25 median p75 p95 pct_zero pct_negative', digits=4)),
    "sensor_summary": Query(run_sensor_summary, shaped("""SELECT event_type, user_id, count(value) AS n,
        min(CAST(ts AS DATE)) AS first_date, max(CAST(ts AS DATE)) AS last_date, avg(value) AS mean,
        median(value) AS median, stddev_samp(value) AS sd, min(value) AS "min", max(value) AS "max",
        max(value) - min(value) AS "range" FROM events GROUP BY 1, 2""",
        real='mean median sd "min" "max" "range"', dates="first_date last_date")),
    "platform_daily": Query(run_platform_daily, shaped("""SELECT year(ts) AS year, CAST(ts AS DATE) AS date,
        count(value) AS n, avg(value) AS mean, median(value) AS median, min(value) AS "min", max(value) AS "max",
        stddev_samp(value) AS sd, max(value) - min(value) AS spread FROM events GROUP BY 1, 2""",
        real='mean median "min" "max" sd spread', ints="year", dates="date")),
    "surface_daily": Query(run_surface_daily, shaped(f"""WITH {ORDER_DAYS} --final
        SELECT year, date, avg(rain) AS mean_rain, avg(level) AS mean_level, coalesce(sum(inflow), 0) AS total_inflow,
          coalesce(sum(outflow), 0) AS total_outflow FROM order_days GROUP BY 1, 2""",
        real="mean_rain mean_level total_inflow total_outflow", ints="year", dates="date")),
    "monthly_resample": Query(run_monthly_resample, shaped(f"""WITH {ORDER_DAYS},
        m AS (SELECT grp, CAST(date_trunc('month', date) AS DATE) AS month, avg(model) AS mean_model,
                     min(model) AS min_model, max(model) AS max_model
              FROM order_days GROUP BY 1, 2),
        spine AS (SELECT grp, CAST(unnest(generate_series(min(month), max(month), INTERVAL 1 MONTH)) AS DATE) AS month
                  FROM m GROUP BY 1) --final
        SELECT grp, month, mean_model, min_model, max_model FROM spine LEFT JOIN m USING (grp, month)""",
        real="mean_model min_model max_model", dates="month")),
    "aligned_sources": Query(run_aligned_sources, shaped("""SELECT * FROM
        (SELECT CAST(o_orderdate AS DATE) AS date, count(*) AS n_orders FROM orders GROUP BY 1)
        JOIN (SELECT CAST(l_shipdate AS DATE) AS date, count(*) AS n_lines FROM lineitem GROUP BY 1) USING (date)""",
        dates="date")),
    "merge_checked": Query(run_merge_checked, shaped(f"""WITH {PART_PANEL} --final
        SELECT year, mean_full, n_late, n_early FROM (SELECT year, avg(value) AS mean_full FROM panel GROUP BY 1)
        JOIN (SELECT year, count(*) AS n_late FROM panel WHERE support >= 5 GROUP BY 1) USING (year)
        LEFT JOIN (SELECT year, count(*) AS n_early FROM panel WHERE support <= 2 AND year >= 1997 GROUP BY 1)
        USING (year)""", real="mean_full", ints="year")),
    "union_distinct": Query(run_union_distinct, shaped("""SELECT year(o_orderdate) AS year, o_orderstatus AS flag FROM orders
        UNION SELECT year(l_shipdate), l_returnflag FROM lineitem""", ints="year")),
    "restrict_to_keys": Query(run_restrict, """SELECT o_orderstatus, count(*) AS n_rows FROM orders WHERE o_custkey IN
        (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderpriority) = 5) GROUP BY 1"""),
}
