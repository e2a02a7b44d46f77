"""Tables, derived inputs and result shaping shared by the registered queries."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shape(df: DataFrame, digits: int = 6) -> DataFrame:
    """Rounded doubles, 64-bit counts and ISO dates, so that two engines can be compared."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), digits)
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def shaped(
    sql: str, real: str = "", ints: str = "", dates: str = "", stamps: str = "", digits: int = 6
) -> str:
    """The same shaping for the SQL side; columns are listed by name, separated by blanks."""
    parts = [f"CASE WHEN round({c}, {digits}) = 0 THEN 0.0 ELSE round({c}, {digits}) END AS {c}" for c in real.split()]
    parts += [f"CAST({c} AS BIGINT) AS {c}" for c in ints.split()]
    parts += [f"strftime({c}, '%Y-%m-%d') AS {c}" for c in dates.split()]
    parts += [f"strftime({c}, '%Y-%m-%d %H:%M:%S.%f') AS {c}" for c in stamps.split()]
    head, body = split_with(sql)
    return f"{head}SELECT * REPLACE ({', '.join(parts)}) FROM ({body})" if parts else sql


def split_with(sql: str) -> tuple[str, str]:
    """Separate leading common tables from the final query at the marker line."""
    if "--final" in sql:
        head, body = sql.split("--final")
        return head, body
    return "", sql


# ---- events: one level per event type and day ------------------------------

def event_days(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events")
    return e.groupBy("event_type", F.to_date("ts").alias("day")).agg(
        F.avg("value").alias("level"), F.count("*").alias("n_events")
    )


EVENT_DAYS = """
event_days AS (
  SELECT event_type, CAST(ts AS DATE) AS day, avg(value) AS level, count(*) AS n_events
  FROM events GROUP BY 1, 2)"""


def event_wide(spark: SparkSession, folder: str) -> DataFrame:
    """One row per day with daily means of the five event types that the correlation queries compare."""
    e = table(spark, folder, "events")
    kinds = ["click", "error", "purchase", "signup", "view"]
    return e.groupBy(F.year("ts").alias("year"), F.to_date("ts").alias("day")).agg(
        *[F.avg(F.when(F.col("event_type") == k, F.col("value"))).alias(k) for k in kinds]
    )


EVENT_WIDE = """
event_wide AS (
  SELECT year(ts) AS year, CAST(ts AS DATE) AS day,
    avg(CASE WHEN event_type = 'click' THEN value END) AS click,
    avg(CASE WHEN event_type = 'error' THEN value END) AS error,
    avg(CASE WHEN event_type = 'purchase' THEN value END) AS purchase,
    avg(CASE WHEN event_type = 'signup' THEN value END) AS signup,
    avg(CASE WHEN event_type = 'view' THEN value END) AS "view"
  FROM events GROUP BY 1, 2)"""


# ---- orders: daily flows per year and priority ------------------------------

UNIT = 997  # a prime, so that rounded means are not decided by exact decimal ties


def order_days(spark: SparkSession, folder: str) -> DataFrame:
    """Flows of finished and open orders, level as mean price around 250 units; a flow
    without orders on the day is missing."""
    o = table(spark, folder, "orders")
    k = F.col("o_totalprice") / UNIT
    days = o.groupBy(
        F.year("o_orderdate").alias("year"),
        F.col("o_orderpriority").alias("grp"),
        F.to_date("o_orderdate").alias("date"),
    ).agg(
        F.sum(F.when(F.col("o_orderstatus") == "F", k)).alias("inflow"),
        F.sum(F.when(F.col("o_orderstatus") == "O", k)).alias("outflow"),
        F.sum(F.when(F.col("o_orderstatus") == "P", k)).alias("model"),
        (F.avg(k) - 250).alias("level"),
        F.count("*").cast("double").alias("rain"),
    )
    return days.withColumn("net", F.col("inflow") - F.col("outflow"))


ORDER_DAYS = """
order_days AS (
  SELECT *, inflow - outflow AS net FROM (
    SELECT year(o_orderdate) AS year, o_orderpriority AS grp, CAST(o_orderdate AS DATE) AS date,
      sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice / 997 END) AS inflow,
      sum(CASE WHEN o_orderstatus = 'O' THEN o_totalprice / 997 END) AS outflow,
      sum(CASE WHEN o_orderstatus = 'P' THEN o_totalprice / 997 END) AS model,
      avg(o_totalprice / 997) - 250 AS level,
      CAST(count(*) AS DOUBLE) AS rain
    FROM orders GROUP BY 1, 2, 3))"""

COMMON_DAYS = ORDER_DAYS + """,
spans AS (SELECT year, grp, min(date) AS s, max(date) AS e FROM order_days GROUP BY 1, 2),
win AS (SELECT year, max(s) AS common_start, min(e) AS common_end FROM spans GROUP BY 1),
common_days AS (
  SELECT d.*, w.common_start, w.common_end FROM order_days d JOIN win w USING (year)
  WHERE d.date BETWEEN w.common_start AND w.common_end)"""


# ---- line items as a unit-by-year panel -------------------------------------

def part_panel(spark: SparkSession, folder: str) -> DataFrame:
    """unit = part, year of shipping, value = discount, support = line number, area = return flag."""
    return table(spark, folder, "lineitem").select(
        F.col("l_partkey").alias("unit"),
        F.year("l_shipdate").alias("year"),
        F.col("l_discount").alias("value"),
        F.col("l_linenumber").alias("support"),
        F.col("l_returnflag").alias("area"),
    )


PART_PANEL = """
panel AS (
  SELECT l_partkey AS unit, year(l_shipdate) AS year, l_discount AS value,
         l_linenumber AS support, l_returnflag AS area
  FROM lineitem),
cov AS (SELECT unit, count(DISTINCT year) AS n_periods FROM panel GROUP BY 1),
bal AS (SELECT p.* FROM panel p JOIN cov c USING (unit) WHERE c.n_periods = 7)"""

N_YEARS = 7


# ---- brand series ------------------------------------------------------------

def brand_months(spark: SparkSession, folder: str) -> DataFrame:
    """Mean line quantity per brand and month number."""
    line = table(spark, folder, "lineitem").select("l_partkey", "l_shipdate", "l_quantity")
    part = table(spark, folder, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("brand"))
    month = (F.year("l_shipdate") * 12 + F.month("l_shipdate")).alias("m")
    return line.join(part, "l_partkey").groupBy("brand", month).agg(F.avg("l_quantity").alias("y"))


BRAND_MONTHS = """
brand_months AS (
  SELECT p_brand AS brand, year(l_shipdate) * 12 + month(l_shipdate) AS m, avg(l_quantity) AS y
  FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2)"""


def names(cols: Sequence[str]) -> str:
    return " ".join(cols)
