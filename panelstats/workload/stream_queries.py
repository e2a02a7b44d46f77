"""Streaming operators run over the events to completion, returned as tables.

The SQL is the batch form: windows the watermark has closed, runs that have ended.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from panelstats.session import new_folder
from panelstats.streaming import daily
from panelstats.workload.common import Query, shape, shaped, table

LIMIT = 50.0


def _events(spark, folder):
    return daily.event_stream(spark, folder, "events.parquet", "ts")


def run_stream_qa(spark, folder):
    out = daily.fill_table(daily.stream_qa(_events(spark, folder), ["event_type"], "ts", "value"), "qa", "complete")
    return shape(out)


ARRIVALS = 4


def run_stream_qa_days(spark, folder):
    """Events that arrive in four parts, those of every fifth user one part later; each part is taken up by a stream
    that goes on where it stopped."""
    landing, state = new_folder(spark, "arrivals"), new_folder(spark, "qa-days")
    events = table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    last = events.agg(F.max("event_id")).first()[0]
    for k in range(ARRIVALS):
        due = F.floor(F.col("event_id") * ARRIVALS / F.lit(last + 1)) + F.when(F.col("user_id") % 5 == 0, 1).otherwise(0)
        events.where(F.least(due, F.lit(ARRIVALS - 1)) == k).write.mode("append").parquet(landing)
        out = daily.fill_qa(daily.event_stream(spark, landing, "*.parquet", "ts"), ["event_type"], "ts", "value", state, "1 day")
    return shape(out)


def run_stream_duplicates(spark, folder):
    counts = daily.stream_duplicates(_events(spark, folder), ["event_type", "user_id"], "ts")
    return shape(daily.fill_table(counts, "duplicates"))


def _closed_days(spark, folder):
    return daily.fill_table(daily.daily_stream(_events(spark, folder), ["event_type"], "ts", "value"), "days")


def run_stream_daily(spark, folder):
    return shape(_closed_days(spark, folder))


def run_stream_monthly(spark, folder):
    """Two linked streams: closed days land in a table, months follow that table."""
    days = daily.file_stream(spark, _landed_days(spark, folder), "*.parquet")
    return shape(daily.fill_table(daily.monthly_stream(days, ["event_type"]), "months", "complete"))


def _landed_days(spark, folder):
    path = new_folder(spark, "closed-days")
    _closed_days(spark, folder).write.parquet(path)
    return path


def run_stream_spells(spark, folder):
    """Two linked streams: closed days land in a table, spells follow that table."""
    days = daily.file_stream(spark, _landed_days(spark, folder), "*.parquet")
    return shape(daily.fill_table(daily.spells_stream(days, "event_type", "date", "mean", LIMIT), "spells"))


_DAYS = """
days AS (
  SELECT event_type, CAST(ts AS DATE) AS date, count(value) AS n, avg(value) AS mean, sum(value) AS total
  FROM events GROUP BY 1, 2
  HAVING CAST(ts AS DATE) + 1 <= (SELECT max(ts) - INTERVAL 1 DAY FROM events))"""

QUERIES = {
    "stream_qa": Query(run_stream_qa, shaped("""SELECT event_type, count(*) AS n_rows, count(*) - count(value) AS n_missing,
        count(*) FILTER (value < 0) AS n_negative, min(value) AS min_value, max(value) AS max_value, min(ts) AS first_ts,
        max(ts) AS last_ts FROM events GROUP BY 1""", real="min_value max_value", stamps="first_ts last_ts")),
    "stream_qa_days": Query(run_stream_qa_days, shaped(f"""WITH parts AS (
          SELECT *, least({ARRIVALS - 1}, floor(event_id * {ARRIVALS}.0 / (SELECT max(event_id) + 1 FROM events))
            + CASE WHEN user_id % 5 = 0 THEN 1 ELSE 0 END) AS part FROM events),
        tops AS (SELECT part, max(ts) AS top FROM parts GROUP BY 1),
        seen AS (SELECT part, max(top) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM tops) --final
        SELECT event_type, count(*) AS n_rows, count(*) - count(value) AS n_missing, count(*) FILTER (value < 0) AS n_negative,
          min(value) AS min_value, max(value) AS max_value, min(ts) AS first_ts, max(ts) AS last_ts,
          count(DISTINCT CAST(ts AS DATE)) AS n_days, count(*) FILTER (ts <= before - INTERVAL 1 DAY) AS n_late
        FROM parts JOIN seen USING (part) GROUP BY 1""", real="min_value max_value", stamps="first_ts last_ts")),
    "stream_duplicates": Query(run_stream_duplicates, shaped("""SELECT event_type, user_id, CAST(ts AS DATE) AS day,
        count(*) AS n_members FROM events GROUP BY 1, 2, 3 HAVING count(*) > 1
        AND CAST(ts AS DATE) + 1 <= (SELECT max(ts) - INTERVAL 1 DAY FROM events)""", dates="day")),
    "stream_daily": Query(run_stream_daily, shaped(f"WITH {_DAYS} --final SELECT * FROM days", real="mean total", dates="date")),
    "stream_monthly": Query(run_stream_monthly, shaped(f"""WITH {_DAYS} --final
        SELECT event_type, CAST(date_trunc('month', date) AS DATE) AS month, avg(mean) AS mean_of_days, min(mean) AS min_day,
          max(mean) AS max_day, count(*) AS n_days FROM days GROUP BY 1, 2""",
        real="mean_of_days min_day max_day", dates="month")),
    "stream_spells": Query(run_stream_spells, shaped(f"""WITH {_DAYS},
        w AS (SELECT event_type, date, CASE WHEN mean > {LIMIT} THEN 1 ELSE 0 END AS state FROM days
              WHERE date < (SELECT max(date) - 7 FROM days)),
        p AS (SELECT *, lag(state) OVER (PARTITION BY event_type ORDER BY date) AS prev FROM w),
        r AS (SELECT *, sum(CASE WHEN prev IS NULL OR prev <> state THEN 1 ELSE 0 END)
                        OVER (PARTITION BY event_type ORDER BY date) AS run FROM p),
        s AS (SELECT event_type, run, state, min(date) AS s, max(date) AS e, count(*) AS length FROM r GROUP BY 1, 2, 3) --final
        SELECT event_type, state, s AS "start", e AS "end", length FROM s
        QUALIFY run < max(run) OVER (PARTITION BY event_type)""", ints="state", dates='"start" "end"')),
}
