"""Tables that are landed as files first and read back: listings, text tables with line breaks, JSON payloads; and the
square form of a correlation matrix."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelstats.functions import scalar as S
from panelstats.operators import correlation, quality
from panelstats.session import new_folder
from panelstats.sources import cells, files, tables, workbooks
from panelstats.workload.common import ORDER_DAYS, Query, order_days, shape, shaped, table

KINDS = ["click", "error", "purchase", "signup", "view"]  # columns of the square form
PRIORITIES = {"1-URGENT": "urgent", "2-HIGH": "high", "3-MEDIUM": "medium", "4-NOT": "none", "5-LOW": "low"}
YEARS = {f"year={y}": str(y) for y in range(1990, 2010)}


def run_scan_files(spark, folder):
    """Files of daily tables found by pattern, with year and priority taken from their paths."""
    path = new_folder(spark, "daily-files")
    days = order_days(spark, folder).repartition("year", "grp")  # one file for each year and priority
    tables.write_table(days, path, "csv", ["year", "grp"])
    found = files.scan_glob(spark, [path], "*.csv")
    named = files.with_dims(found, "path", {"year": YEARS, "priority": PRIORITIES})
    return shape(named.groupBy("year", "priority").agg(F.count("*").alias("n_files"), F.count_if(F.col("size_bytes") > 0).alias("n_filled")))


def run_csv_multiline(spark, folder):
    """Texts with line breaks and quotes, in files that begin with a byte-order mark."""
    path = new_folder(spark, "texts-csv")
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("\ufeffdoc_id"), "lang", "text")
    tables.write_table(docs, path, "csv")
    back = tables.read_text_table(spark, path, ["doc_id", "lang", "text"], multiline=True)
    back = quality.require_columns(tables.cast_strict(back, {"doc_id": "bigint"}), ["doc_id", "lang", "text"])
    return shape(back.select("doc_id", "lang", F.md5("text").alias("text_md5")))


def run_json_landing(spark, folder):
    """Payloads kept as one JSON document per line, and read with a declared schema."""
    path = new_folder(spark, "customers-json")
    customers = table(spark, folder, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    tables.land_json(customers, path)
    back = spark.read.schema("c_custkey bigint, c_mktsegment string, c_acctbal double").json(path)
    return shape(back.groupBy("c_mktsegment").agg(
        F.count("*").alias("n"), F.max("c_custkey").alias("last_key"), F.sum("c_acctbal").alias("balance")), 2)


FLOWS = ["date", "inflow", "outflow", "level"]


def run_workbook_source(spark, folder):
    """Daily tables landed as workbooks, one for each year with a sheet for each priority, and read back by sheet."""
    path = new_folder(spark, "workbooks")
    days = order_days(spark, folder)
    place = [F.concat(F.lit("flows_"), "year", F.lit(".xlsx")).alias("workbook"), F.col("grp").alias("sheet")]
    across = lambda text: F.inline(F.array(*[F.struct(F.lit(k + 1).alias("column"), text(c).alias("text")) for k, c in enumerate(FLOWS)]))
    body = days.select(*place, (F.dayofyear("date") + 1).alias("row"), across(lambda c: F.col(c).cast("string")))
    heads = days.select(*place).distinct().select("*", F.lit(1).alias("row"), across(F.lit))
    workbooks.write_workbooks(body.unionByName(heads), path)
    grid = workbooks.read_cells(spark, path)
    back = cells.read_sheet(grid, None, 1, {c: k + 1 for k, c in enumerate(FLOWS)})
    typed = tables.cast_strict(back, {c: "double" for c in FLOWS[1:]})
    return shape(typed.select("workbook", F.col("sheet").alias("grp"), *FLOWS, S.net("inflow", "outflow").alias("net")))


def run_matrix_square(spark, folder):
    days = table(spark, folder, "events").select(
        F.year("ts").alias("year"), F.to_date("ts").alias("date"), "value", F.col("event_type").alias("sensor"))
    matrix = correlation.correlation_matrix(days, ["year"], "date", "sensor", "value", block_days=7)
    return shape(correlation.pivot_matrix(matrix, ["year"], KINDS))


QUERIES = {
    "scan_files": Query(run_scan_files, f"""WITH {ORDER_DAYS} SELECT CAST(year AS VARCHAR) AS year,
        CASE left(grp, 1) WHEN '1' THEN 'urgent' WHEN '2' THEN 'high' WHEN '3' THEN 'medium' WHEN '4' THEN 'none' ELSE 'low' END AS priority,
        CAST(1 AS BIGINT) AS n_files, CAST(1 AS BIGINT) AS n_filled FROM order_days GROUP BY year, grp"""),
    "csv_multiline": Query(run_csv_multiline, "SELECT doc_id, lang, md5(text) AS text_md5 FROM documents"),
    "json_landing": Query(run_json_landing, shaped("""SELECT c_mktsegment, count(*) AS n, max(c_custkey) AS last_key,
        sum(c_acctbal) AS balance FROM customer GROUP BY 1""", real="balance", digits=2)),
    "workbook_source": Query(run_workbook_source, shaped(f"""WITH {ORDER_DAYS} --final
        SELECT 'flows_' || year || '.xlsx' AS workbook, grp, date, inflow, outflow, level, net FROM order_days""",
        real="inflow outflow level net", dates="date")),
    "corr_matrix_square": Query(run_matrix_square, shaped("""WITH daily AS (
          SELECT year(ts) AS year, CAST(ts AS DATE) AS date, event_type AS sensor, avg(value) AS v FROM events GROUP BY 1, 2, 3),
        mat AS (SELECT p.year, p.sensor AS a, q.sensor AS b, CASE WHEN p.sensor = q.sensor THEN 1.0 ELSE corr(p.v, q.v) END AS r
          FROM daily p JOIN daily q ON p.year = q.year AND p.date = q.date GROUP BY 1, 2, 3) --final
        SELECT year, a, """ + ", ".join(f"max(r) FILTER (b = '{k}') AS \"{k}\"" for k in KINDS) + " FROM mat GROUP BY 1, 2",
        real='click error purchase signup "view"', ints="year")),
}
