"""Trends, residual memory, bootstrap, correlation families."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelstats.operators import bootstrap, correlation, rank_trend, trend
from panelstats.session import materialise
from panelstats.workload.common import (
    BRAND_MONTHS, EVENT_WIDE, Query, brand_months, event_wide, shape, shaped, table,
)

TARGET, OTHERS, LAGS = "click", ["error", "purchase", "signup", "view"], (0, 1, 3, 7)


def run_trend_ols(spark, folder):
    return shape(trend.trend_ols(brand_months(spark, folder), ["brand"], "m", "y"))


def run_trend_robust(spark, folder):
    return shape(trend.trend_robust(brand_months(spark, folder), ["brand"], "m", "y"))


def run_trend_table(spark, folder):
    return shape(trend.trend_table(brand_months(spark, folder), ["brand"], "m", "y"))


def _named_series(spark, folder):
    """Three yearly series of the same panel, made long: all lines, late lines, weighted."""
    line = table(spark, folder, "lineitem")
    wide = line.groupBy(F.year("l_shipdate").alias("year")).agg(
        F.avg("l_discount").alias("all_lines"),
        F.avg(F.when(F.col("l_linenumber") >= 5, F.col("l_discount"))).alias("late_lines"),
        (F.sum(F.col("l_discount") * F.col("l_quantity")) / F.sum("l_quantity")).alias("weighted"),
    )
    return wide.unpivot("year", ["all_lines", "late_lines", "weighted"], "series", "y")


def run_trend_series(spark, folder):
    return shape(trend.trend_table(_named_series(spark, folder), ["series"], "year", "y"), 8)


def run_detrend(spark, folder):
    out = trend.detrend(brand_months(spark, folder), ["brand"], "m", "y")
    return shape(out.select("brand", "m", "fitted", "residual"))


def run_memory(spark, folder):
    return shape(trend.residual_memory(brand_months(spark, folder), ["brand"], "m", "y"))


def run_bootstrap(spark, folder):
    return shape(bootstrap.block_bootstrap(brand_months(spark, folder), ["brand"], "m", "y", n_boot=20_000))


def run_kendall_raw(spark, folder):
    """Raw events, a series as long as its events: hours against values, both with ties."""
    hour = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 3600)
    e = table(spark, folder, "events").select("event_type", hour.alias("hour"), "value")
    out = rank_trend.kendall_long(e, ["event_type"], "hour", "value")
    return shape(out.select("event_type", "n", "discordant", "score", "kendall_tau"))


# ---- correlations ----------------------------------------------------------------

def run_corr_contemporaneous(spark, folder):
    return shape(correlation.correlate(event_wide(spark, folder), ["year"], TARGET, OTHERS))


def _lagged(spark, folder):
    return correlation.correlate_lagged(event_wide(spark, folder), ["year"], "day", TARGET, OTHERS, LAGS)


def run_corr_lagged(spark, folder):
    return shape(_lagged(spark, folder))


def run_corr_calendar(spark, folder):
    """Calendar lags on records with gaps: nations do not order every day."""
    orders = table(spark, folder, "orders").select(
        F.col("o_custkey").alias("c_custkey"), F.to_date("o_orderdate").alias("day"), "o_totalprice")
    customers = table(spark, folder, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"))
    days = orders.join(customers, "c_custkey").groupBy("nation", "day").agg(
        F.max("o_totalprice").alias("highest"), F.min("o_totalprice").alias("lowest"), F.count("*").alias("n_orders"))
    return shape(correlation.correlate_lagged(
        days, ["nation"], "day", "highest", ["lowest", "n_orders"], LAGS, mode="calendar"))


def run_corr_diff(spark, folder):
    return shape(correlation.correlate_differences(event_wide(spark, folder), ["year"], "day", TARGET, OTHERS))


def run_best_lag(spark, folder):
    return shape(correlation.best_lag(_lagged(spark, folder), ["year", "variable"]))


def run_corr_long(spark, folder):
    """Ranks of whole return-flag groups, without a window over a group."""
    line = table(spark, folder, "lineitem")
    return shape(correlation.correlate(line, ["l_returnflag"], "l_quantity", ["l_extendedprice", "l_discount"], long_series=True))


def _readings(spark, folder):
    return table(spark, folder, "events").select(
        F.year("ts").alias("year"), F.to_date("ts").alias("date"), "value",
        F.concat_ws("_", "event_type", (F.col("user_id") % 4).cast("string")).alias("sensor"),
    )


def _matrix(spark, folder):
    return correlation.correlation_matrix(_readings(spark, folder), ["year"], "date", "sensor", "value", block_days=7)


def run_corr_matrix(spark, folder):
    return shape(_matrix(spark, folder))


def run_corr_matrix_tiled(spark, folder):
    out = correlation.correlation_matrix(
        _readings(spark, folder), ["year"], "date", "sensor", "value", block_days=7, tiles=3
    )
    return shape(out)


def run_corr_summary(spark, folder):
    """The matrix is stored once; the summary reads it twice."""
    return shape(correlation.correlation_summary(materialise(_matrix(spark, folder), "matrix"), ["year"]))


# Student t with even degrees of freedom as a finite sum, normal tail as a series
_FIT = """
fit AS (
  SELECT {by}, count(*) AS n, regr_slope(y, x) AS ols_slope, regr_intercept(y, x) AS ols_intercept,
         regr_r2(y, x) AS ols_r2 FROM pts GROUP BY {by}),
tail AS (
  SELECT {by}, 1 - CASE WHEN n % 2 = 0 THEN sqrt(ols_r2) * (
      SELECT sum(exp(lgamma(k + 0.5) - lgamma(0.5) - lgamma(k + 1.0)) * pow(1 - ols_r2, k))
      FROM generate_series(0, CAST((n - 4) / 2 AS INT)) g(k))
    ELSE 2 / pi() * (asin(sqrt(ols_r2)) + sqrt(ols_r2) * (
      SELECT sum(sqrt(pi()) / 2 * exp(lgamma(k + 1.0) - lgamma(k + 1.5)) * pow(1 - ols_r2, k + 0.5))
      FROM generate_series(0, CAST((n - 5) / 2 AS INT)) g(k))) END AS ols_p
  FROM fit)"""
_PAIRS = """
pairs AS (
  SELECT a.{by}, sign(b.y - a.y) AS s, (b.y - a.y) / (b.x - a.x) AS slope
  FROM pts a JOIN pts b ON a.{by} = b.{by} AND a.x < b.x),
pair_stats AS (
  SELECT {by}, count(*) AS np, sum(s) AS score, count(*) FILTER (s = 0) AS y_ties, median(slope) AS theil_sen_slope,
         list_sort(list(slope)) AS slopes FROM pairs GROUP BY {by}),
sizes AS (SELECT {by}, sum(t) AS n, sum(t * (t - 1) * (2 * t + 5)) AS tied
          FROM (SELECT {by}, y, count(*) AS t FROM pts GROUP BY {by}, y) GROUP BY {by}),
ranks AS (
  SELECT *, sqrt((n * (n - 1) * (2 * n + 5) - tied) / 18.0) AS sigma FROM pair_stats JOIN sizes USING ({by})),
robust AS (
  SELECT {by}, n, score / sqrt(np) / sqrt(np - y_ties) AS kendall_tau, abs(score) / sigma AS z, score, np,
    theil_sen_slope,
    slopes[CAST(greatest(round_even((np - 1.959963984540054 * sigma) / 2, 0) - 1, 0) AS INT) + 1] AS theil_sen_low,
    slopes[CAST(least(round_even((np + 1.959963984540054 * sigma) / 2, 0), np - 1) AS INT) + 1] AS theil_sen_high
  FROM ranks),
kendall AS (
  SELECT {by}, 1 - 2 / sqrt(pi()) * (SELECT sum(pow(-1, k) * pow(z / sqrt(2), 2 * k + 1) / exp(lgamma(k + 1.0)) / (2 * k + 1))
                                     FROM generate_series(0, 120) g(k)) AS kendall_p FROM robust)"""
_BRAND = BRAND_MONTHS + ", pts AS (SELECT brand, CAST(m AS DOUBLE) AS x, y FROM brand_months)"
_ROBUST_REAL = "kendall_tau kendall_p theil_sen_slope theil_sen_low theil_sen_high"
_OLS_REAL = "ols_slope ols_intercept ols_r2 ols_p"
_ROBUST = "kendall_tau, kendall_p, theil_sen_slope, theil_sen_low, theil_sen_high"
_YEARS = """
years AS (
  SELECT year(l_shipdate) AS year, avg(l_discount) AS all_lines, avg(l_discount) FILTER (l_linenumber >= 5) AS late_lines,
         sum(l_discount * l_quantity) / sum(l_quantity) AS weighted FROM lineitem GROUP BY 1),
pts AS (SELECT series, CAST(year AS DOUBLE) AS x, y FROM years UNPIVOT (y FOR series IN (all_lines, late_lines, weighted)))"""
# exact two-sided p of n = 7 points: cumulative counts of orders by number of inversions
_MAHONIAN = """
m AS (SELECT * FROM (VALUES (0, 1), (1, 6), (2, 20), (3, 49), (4, 98), (5, 169), (6, 259), (7, 359), (8, 455), (9, 531),
                            (10, 573)) t(inv, cnt)),
exact AS (
  SELECT series, least(1.0, 2.0 * (SELECT sum(cnt) FROM m WHERE inv <= least((np - score) / 2, (np + score) / 2)) / 5040) AS kendall_p
  FROM robust)"""

_RESIDUALS = BRAND_MONTHS + """,
fits AS (SELECT brand, regr_slope(y, m) AS b, regr_intercept(y, m) AS a FROM brand_months GROUP BY 1),
raw AS (SELECT brand, m, y, a + b * m AS fitted, y - (a + b * m) AS e FROM brand_months JOIN fits USING (brand)),
res AS (SELECT brand, m, fitted, e - avg(e) OVER (PARTITION BY brand) AS residual FROM raw)"""

_CORR_TAIL = """
clean AS (SELECT * FROM prs WHERE x IS NOT NULL AND y IS NOT NULL),
ranked AS (
  SELECT *,
    rank() OVER (PARTITION BY {by} ORDER BY x) + (count(*) OVER (PARTITION BY {by}, x) - 1) / 2 AS rx,
    rank() OVER (PARTITION BY {by} ORDER BY y) + (count(*) OVER (PARTITION BY {by}, y) - 1) / 2 AS ry FROM clean),
result AS (SELECT {by}, count(*) AS n, corr(x, y) AS pearson_r, corr(rx, ry) AS spearman_rho FROM ranked GROUP BY {by})"""


def _wide_pairs(lag: str) -> str:
    """Pairs of the target with each variable; ``lag`` is the shift expression."""
    return "prs AS (" + " UNION ALL ".join(
        f"SELECT year, '{v}' AS variable, {TARGET} AS y, {lag.format(v=v)} AS x FROM event_wide" for v in OTHERS) + ")"


_LAGGED = EVENT_WIDE + ", prs AS (" + " UNION ALL ".join(
    f"SELECT year, '{v}' AS variable, {k} AS lag, {TARGET} AS y, lag(\"{v}\", {k}) OVER (PARTITION BY year ORDER BY day) AS x "
    f"FROM event_wide" for v in OTHERS for k in LAGS) + ")," + _CORR_TAIL.format(by="year, variable, lag")
_CALENDAR = """days AS (SELECT c_nationkey AS nation, CAST(o_orderdate AS DATE) AS day, max(o_totalprice) AS highest,
    min(o_totalprice) AS lowest, count(*) AS n_orders FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2),
prs AS (""" + " UNION ALL ".join(
    f"SELECT a.nation, '{v}' AS variable, {k} AS lag, a.highest AS y, CAST(b.{v} AS DOUBLE) AS x "
    f"FROM days a LEFT JOIN days b ON b.nation = a.nation AND b.day = a.day - {k}" for v in ("lowest", "n_orders") for k in LAGS
) + ")," + _CORR_TAIL.format(by="nation, variable, lag")
_DIFF = EVENT_WIDE + ", prs AS (" + " UNION ALL ".join(
    f"SELECT year, '{v}' AS variable, {TARGET} - lag({TARGET}) OVER w AS y, \"{v}\" - lag(\"{v}\") OVER w AS x "
    "FROM event_wide WINDOW w AS (PARTITION BY year ORDER BY day)" for v in OTHERS
) + ")," + _CORR_TAIL.format(by="year, variable")
_SAME_DAY = EVENT_WIDE + ", " + _wide_pairs('"{v}"') + "," + _CORR_TAIL.format(by="year, variable")
_LONG = "prs AS (" + " UNION ALL ".join(
    f"SELECT l_returnflag, '{v}' AS variable, l_quantity AS y, {v} AS x FROM lineitem" for v in ("l_extendedprice", "l_discount")
) + ")," + _CORR_TAIL.format(by="l_returnflag, variable")
_CORR_REAL = "pearson_r spearman_rho"
_SENSORS = """
daily AS (
  SELECT year(ts) AS year, CAST(ts AS DATE) AS date, event_type || '_' || (user_id % 4) AS sensor, avg(value) AS v
  FROM events GROUP BY 1, 2, 3),
mat AS (
  SELECT p.year, p.sensor AS a, q.sensor AS b, count(*) AS n, corr(p.v, q.v) AS r
  FROM daily p JOIN daily q ON p.year = q.year AND p.date = q.date AND p.sensor < q.sensor GROUP BY 1, 2, 3)"""
_MATRIX_SQL = shaped(f"WITH {_SENSORS} --final SELECT * FROM mat", real="r", ints="year")

QUERIES = {
    "trend_ols": Query(run_trend_ols, shaped(f"WITH {_BRAND}, {_FIT.format(by='brand')} --final "
        "SELECT fit.*, ols_p FROM fit JOIN tail USING (brand)", real=_OLS_REAL)),
    "trend_robust": Query(run_trend_robust, shaped(f"WITH {_BRAND}, {_PAIRS.format(by='brand')} --final "
        f"SELECT brand, n, {_ROBUST} FROM robust JOIN kendall USING (brand)", real=_ROBUST_REAL, ints="n")),
    "trend_table": Query(run_trend_table, shaped(
        f"WITH {_BRAND}, {_FIT.format(by='brand')}, {_PAIRS.format(by='brand')} --final SELECT fit.*, ols_p, {_ROBUST} "
        "FROM fit JOIN tail USING (brand) JOIN robust USING (brand) JOIN kendall USING (brand)",
        real=f"{_OLS_REAL} {_ROBUST_REAL}")),
    "trend_series": Query(run_trend_series, shaped(
        f"WITH {_YEARS}, {_FIT.format(by='series')}, {_PAIRS.format(by='series')}, {_MAHONIAN} --final "
        f"SELECT fit.*, ols_p, {_ROBUST} "
        "FROM fit JOIN tail USING (series) JOIN robust USING (series) JOIN exact USING (series)",
        real=f"{_OLS_REAL} {_ROBUST_REAL}", digits=8)),
    "detrend": Query(run_detrend, shaped(f"WITH {_RESIDUALS} --final SELECT brand, m, fitted, residual FROM res",
        real="fitted residual", ints="m")),
    "lag1_dw": Query(run_memory, shaped(f"""WITH {_RESIDUALS},
        steps AS (SELECT *, lag(residual) OVER (PARTITION BY brand ORDER BY m) AS before FROM res) --final
        SELECT brand, count(*) AS n, corr(before, residual) AS lag1,
          sum((residual - before) * (residual - before)) / sum(residual * residual) AS durbin_watson
        FROM steps GROUP BY 1""", real="lag1 durbin_watson")),
    "kendall_raw": Query(run_kendall_raw, shaped("""WITH e AS (
          SELECT event_type, floor(epoch(ts) / 3600) AS h, value, row_number() OVER () AS r FROM events),
        sizes AS (SELECT event_type, count(*) AS n FROM e GROUP BY 1),
        pairs AS (
          SELECT a.event_type, sign(b.h - a.h) * sign(b.value - a.value) AS s, a.h = b.h AS x_tie, a.value = b.value AS y_tie
          FROM e a JOIN e b ON a.event_type = b.event_type AND a.r < b.r) --final
        SELECT event_type, any_value(n) AS n, count(*) FILTER (s < 0) AS discordant, CAST(sum(s) AS BIGINT) AS score,
          sum(s) / (sqrt(count(*) FILTER (NOT x_tie)) * sqrt(count(*) FILTER (NOT y_tie))) AS kendall_tau
        FROM pairs JOIN sizes USING (event_type) GROUP BY 1""", real="kendall_tau", ints="n discordant score")),
    "block_bootstrap": Query(run_bootstrap, shaped(f"""WITH {BRAND_MONTHS},
        line AS (SELECT *, y - (regr_intercept(y, m) OVER s + regr_slope(y, m) OVER s * m) AS raw FROM brand_months WINDOW s AS (PARTITION BY brand)),
        series AS (
          SELECT brand, count(*) AS n, regr_slope(y, m) AS slope, list(m ORDER BY m) AS ms, avg(m) AS mm, var_pop(m) * count(*) AS sxx,
            list(raw - mean ORDER BY m) AS e
          FROM (SELECT *, avg(raw) OVER (PARTITION BY brand) AS mean FROM line) GROUP BY 1 HAVING count(*) >= 3 AND var_pop(m) > 0),
        packed AS (SELECT *, list_transform(ms, lambda x: (x - mm) / sxx) AS w FROM series),
        drawn AS (
          SELECT brand, len, n, slope, e, w, list_transform(range(CAST(ceil(n / (4.0 * len)) AS BIGINT)),
              lambda d: md5(concat_ws('|', 1, brand, len, r, d))) AS digests
          FROM packed, (SELECT unnest([3, 4, 5]) AS len), (SELECT unnest(range(20000)) AS r)),
        started AS (
          SELECT brand, len, n, slope, e, w, list_transform(range(CAST(ceil(n / len) AS BIGINT)), lambda b:
              CAST('0x' || substr(digests[b // 4 + 1], CAST(8 * (b % 4) + 1 AS INT), 8) AS BIGINT) % n) AS starts FROM drawn),
        slopes AS (
          SELECT brand, len, slope, slope + list_sum(list_transform(range(n), lambda p:
              e[(starts[p // len + 1] + p % len) % n + 1] * w[p + 1])) AS s FROM started),
        steps AS (
          SELECT brand, e, lag(e) OVER (PARTITION BY brand ORDER BY m) AS e0
          FROM (SELECT brand, m, raw - avg(raw) OVER (PARTITION BY brand) AS e FROM line)),
        memory AS (SELECT brand, corr(e0, e) AS lag1, sum((e - e0) * (e - e0)) / sum(e * e) AS dw FROM steps GROUP BY 1) --final
        SELECT brand, len AS block_length, any_value(slope) AS observed_slope, any_value(lag1) AS residual_lag1, any_value(dw) AS durbin_watson,
          quantile_cont(s, 0.5) AS median_slope, quantile_cont(s, 0.025) AS low95, quantile_cont(s, 0.975) AS high95,
          count(*) FILTER (s < 0) / count(*) AS share_negative
        FROM slopes JOIN memory USING (brand) GROUP BY 1, 2""",
        real="observed_slope residual_lag1 durbin_watson median_slope low95 high95 share_negative", ints="block_length")),
    "corr_contemporaneous": Query(run_corr_contemporaneous, shaped(
        f"WITH {_SAME_DAY} --final SELECT * FROM result", real=_CORR_REAL, ints="year")),
    "corr_lagged": Query(run_corr_lagged, shaped(
        f"WITH {_LAGGED} --final SELECT * FROM result", real=_CORR_REAL, ints="year lag")),
    "corr_calendar_lag": Query(run_corr_calendar, shaped(
        f"WITH {_CALENDAR} --final SELECT * FROM result", real=_CORR_REAL, ints="nation lag")),
    "corr_diff": Query(run_corr_diff, shaped(
        f"WITH {_DIFF} --final SELECT * FROM result", real=_CORR_REAL, ints="year")),
    "best_lag": Query(run_best_lag, shaped(f"""WITH {_LAGGED} --final
        SELECT year, variable, lag AS best_lag, spearman_rho, pearson_r, n FROM result
        WHERE spearman_rho IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY year, variable ORDER BY abs(spearman_rho) DESC, lag) = 1""",
        real=_CORR_REAL, ints="year best_lag")),
    "corr_long_series": Query(run_corr_long, shaped(f"WITH {_LONG} --final SELECT * FROM result", real=_CORR_REAL)),
    "corr_matrix": Query(run_corr_matrix, _MATRIX_SQL),
    "corr_matrix_tiled": Query(run_corr_matrix_tiled, _MATRIX_SQL),
    "corr_summary": Query(run_corr_summary, shaped(f"""WITH {_SENSORS} --final
        SELECT year, (SELECT count(DISTINCT sensor) FROM daily) AS n_entities, count(r) AS n_pairs, avg(r) AS mean_r,
          median(r) AS median_r, min(r) AS min_r, max(r) AS max_r FROM mat GROUP BY 1""",
        real="mean_r median_r min_r max_r", ints="year")),
}
