"""Cell grids, JSON records, text, date and number functions, table round trips."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelstats.functions import scalar as S
from panelstats.session import materialise, new_folder
from panelstats.sources import catalogue, cells, files, tables
from panelstats.workload.common import ORDER_DAYS, Query, order_days, shape, shaped, table


# ---- conversations as a grid of cells ------------------------------------------------

def _grid(spark, folder):
    """workbook = tens of conversations, sheet = conversation, row = turn + 1, column = role."""
    c = table(spark, folder, "conversations")
    column = F.when(F.col("role") == "system", 1).when(F.col("role") == "user", 2).otherwise(3)
    return c.select(
        F.floor(F.col("conv_id") / 10).cast("string").alias("workbook"),
        F.concat(F.lit("s"), F.col("conv_id")).alias("sheet"),
        (F.col("turn") + 1).cast("int").alias("row"), column.alias("column"), "text",
    )


def run_sheet_inventory(spark, folder):
    out = cells.sheet_inventory(_grid(spark, folder))
    return shape(out.withColumn("first_row_headers", F.md5("first_row_headers")))


def run_head_cells(spark, folder):
    out = cells.head_cells(_grid(spark, folder), 3, 2)
    return shape(out.select("workbook", "sheet", "row", "column", "address", F.md5("text").alias("text_md5")))


def run_keyword_scan(spark, folder):
    out = cells.scan_cells(_grid(spark, folder), "the|tion")
    return shape(out.select("workbook", "sheet", "row", "column", F.length("text").alias("chars")))


def run_row_scan(spark, folder):
    out = cells.scan_rows(_grid(spark, folder), "whth|eau")
    return shape(out.select("workbook", "sheet", "row", F.md5("row_text").alias("row_md5")))


def run_alias(spark, folder):
    names = _grid(spark, folder).select("workbook", "sheet").dropDuplicates()
    return shape(cells.resolve_alias(names, ["s3", "s13", "s11", "s25", "s24", "s42"]))


def run_label_summary(spark, folder):
    """Distinct words of first rows that match, per workbook and column."""
    head = _grid(spark, folder).where("row <= 2")
    words = head.select("workbook", "column", F.explode(F.split("text", "\\s+")).alias("text"))
    out = cells.label_summary(words, ["workbook", "column"], "^[a-z]*whth[a-z]*$")
    return shape(out)


def run_read_sheet(spark, folder):
    out = cells.read_sheet(_grid(spark, folder), None, 1, {"question": 2, "answer": 3})
    return shape(out.select("workbook", "sheet", "row", F.md5("question").alias("question"), F.md5("answer").alias("answer")))


# ---- grids written from daily tables, then read back ---------------------------------

# physical columns per period: the second layout swaps the flows and adds one variable
LAYOUT = [
    *[(y, c, v) for y in (1995, 1996, 1997) for c, v in ((1, "date"), (2, "inflow"), (3, "outflow"), (4, "level"))],
    *[(y, c, v) for y in (1998, 1999, 2000, 2001)
      for c, v in ((1, "date"), (2, "outflow"), (3, "inflow"), (5, "level"), (6, "model"))],
]


def run_positional(spark, folder):
    """Daily flows laid out as cells by period, then mapped back by position."""
    days = order_days(spark, folder).withColumn("date", S.iso_date("date"))
    early = F.col("year") <= 1997
    text = lambda c: F.col(c).cast("string")
    layout = F.array(
        *[F.struct(at.alias("column"), value.alias("text")) for at, value in [
            (F.lit(1), text("date")),
            (F.lit(2), F.when(early, text("inflow")).otherwise(text("outflow"))),
            (F.lit(3), F.when(early, text("outflow")).otherwise(text("inflow"))),
            (F.when(early, 4).otherwise(5), text("level")),
            (F.when(early, 7).otherwise(6), text("model")),
        ]]
    )
    # day of year is the sheet row: it does not depend on other rows
    grid = days.select(
        "year", F.lit("book").alias("workbook"), F.col("grp").alias("sheet"),
        (F.dayofyear("date") + 2).alias("row"), F.inline(layout),
    )
    wide = cells.map_positions(grid, ["year"], LAYOUT, ["date", "inflow", "outflow", "level", "model"])
    named = wide.withColumnRenamed("sheet", "grp").drop("workbook", "row")
    typed = tables.cast_coerce(named, ["inflow", "outflow", "level", "model"])
    return shape(typed.withColumn("net", S.net("inflow", "outflow")))


def run_header_discovery(spark, folder):
    """Sensor columns found by header text; dates written as serials and as text."""
    e = table(spark, folder, "events")
    daily = e.groupBy("event_type", F.to_date("ts").alias("date"), (F.col("user_id") % 4).alias("k")).agg(
        F.max("value").alias("v"))
    daily = materialise(daily, "daily-sensors")  # read by four parts of the grid
    serial = F.datediff("date", F.lit("1899-12-30").cast("date"))
    written = F.when(F.day("date") % 2 == 0, serial.cast("string")).otherwise(S.iso_date("date"))
    place = [F.col("event_type").alias("workbook"), F.lit("Depth").alias("sheet")]
    row = (F.datediff("date", F.lit("1970-01-01").cast("date")) + 3).alias("row")  # one row for each date
    dates = daily.select(*place, row, F.lit(3).alias("column"), written.alias("text")).dropDuplicates()
    values = daily.select(*place, row, (F.col("k") + 4).cast("int").alias("column"), F.col("v").cast("string").alias("text"))
    heads = daily.select(*place, F.col("k").cast("int").alias("k")).dropDuplicates()
    header = heads.select(*["workbook", "sheet"], F.lit(2).alias("row"), (F.col("k") + 4).alias("column"),
                          F.concat(F.lit("Depth (cm) Sensor S"), F.col("k") + 1).alias("text"))
    date_head = heads.select("workbook", "sheet", F.lit(2).alias("row"), F.lit(3).alias("column"), F.lit("DATE").alias("text"))
    grid = dates.unionByName(values).unionByName(header).unionByName(date_head.dropDuplicates())
    out = cells.discover_and_unpivot(grid, r"Depth.*SENSOR\s+S?([0-9]+)", prefix="S")
    return shape(out.select(F.col("workbook").alias("event_type"), "date", "sensor", "value"))


# ---- JSON ------------------------------------------------------------------------------

def _records(spark, folder):
    """A landed record per part: metadata as type-value pairs, one file per brand and type."""
    p = table(spark, folder, "part")
    as_text = lambda c: F.to_json(F.struct(F.col(c).alias("v")))
    fields = F.concat(
        F.lit('[{"typeName":"title","value":'), F.regexp_extract(as_text("p_name"), '^\\{"v":(.*)\\}$', 1),
        F.lit('},{"typeName":"subject","value":["'), F.col("p_brand"), F.lit('", "'), F.col("p_type"),
        F.lit('"]},{"typeName":"author","value":[ {"size" : '), F.col("p_size"), F.lit("} ]}]"),
    )
    file = lambda name, size: F.concat(
        F.lit('{"description":"'), F.col("p_type"), F.lit('","restricted":false,"dataFile":{"id":'), F.col("p_partkey"),
        F.lit(',"filename":"'), name, F.lit('","contentType":"text/csv","filesize":'), size,
        F.lit(',"checksum":{"type":"MD5","value":"'), F.md5("p_name"), F.lit('"}}}'),
    )
    body = F.concat(
        F.lit('{"status":"OK","data":{"latestVersion":{"versionNumber":1,"versionMinorNumber":'), F.col("p_size") % 3,
        F.lit(',"metadataBlocks":{"citation":{"fields":'), fields, F.lit('}},"files":['),
        file(F.col("p_brand"), F.col("p_size")), F.lit(","), file(F.col("p_type"), F.col("p_size") * 2), F.lit("]}}}"),
    )
    return p.select("p_partkey", body.alias("body")).select(
        "p_partkey", F.from_json("body", catalogue.RECORD_SCHEMA).alias("r")).select("p_partkey", "r.*")


def run_eav(spark, folder):
    records = catalogue.require_status(_records(spark, folder))
    return shape(catalogue.record_fields(records, ["p_partkey"], ["title", "subject", "author", "keyword"]))


def run_field_values(spark, folder):
    """Records as JSON text whose fields are texts, lists, objects, numbers, booleans and nulls."""
    p = table(spark, folder, "part")
    json = lambda *cols: F.to_json(F.struct(*cols))
    field = lambda name, value: F.concat(F.lit(f'{{"typeName":"{name}","value":'), value, F.lit("}"))
    cut = lambda text: F.regexp_extract(text, '^\\{"v":(.*)\\}$', 1)
    fields = F.concat_ws(
        ", ", field("title", cut(json(F.col("p_name").alias("v")))),
        field("looks_like_list", cut(json(F.concat(F.lit('["'), "p_brand", F.lit('"]')).alias("v")))),
        field("subject", cut(json(F.array("p_brand", "p_type").alias("v")))), field("size", F.col("p_size").cast("string")),
        field("large", (F.col("p_size") > 25).cast("string")), field("author", json("p_size", "p_brand")), field("none", F.lit("null")),
        field("empty", F.lit("[]")),
    )
    body = F.concat(F.lit('{"data":{"latestVersion":{"metadataBlocks":{"citation":{"fields":['), fields, F.lit("]}}}}}"))
    out = catalogue.field_values(p.select("p_partkey", body.alias("body")), ["p_partkey"], "body")
    return shape(out.select("p_partkey", "position", "field", "kind", F.size("values").alias("n_values"), F.array_join("values", "|").alias("value")))


def run_file_explode(spark, folder):
    return shape(catalogue.explode_files(_records(spark, folder), ["p_partkey"]).drop("directory_label"))


def run_json_props(spark, folder):
    e = table(spark, folder, "events")
    k = F.from_json("props", "k int")["k"]
    compact = F.to_json(F.struct(k.alias("k"), F.col("event_type").alias("kind")))
    return shape(e.groupBy(compact.alias("doc")).agg(F.count("*").alias("n"), F.min(F.get_json_object("props", "$.k").cast("int")).alias("k")))


def run_catalogue(spark, folder):
    """Search answers, one per nation, each listing its items; flattened to one row per item."""
    n = table(spark, folder, "nation")
    s = table(spark, folder, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    item = F.struct(
        F.col("s_name").alias("name"), F.concat(F.lit("id:"), F.col("s_suppkey")).alias("global_id"),
        F.url_encode("s_name").alias("url"), F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), (F.col("s_suppkey") % 400).cast("int")), "yyyy-MM-dd").alias("published_at"),
        F.col("n_name").alias("description"), F.array("s_name", "n_name").alias("authors"),
        F.array(F.lit("Supply")).alias("subjects"), F.lit("dataset").alias("type"),
    )
    answers = s.groupBy("s_nationkey").agg(F.collect_list(item).alias("items")).select(  # suppliers of a nation: one answer
        F.lit("OK").alias("status"), F.struct("items").alias("data"))
    text = answers.select(F.to_json(F.struct("status", "data")).alias("body"))
    parsed = text.select(F.from_json("body", catalogue.CATALOGUE_SCHEMA).alias("r")).select("r.*")
    return shape(catalogue.flatten_catalogue(parsed))


# ---- functions ---------------------------------------------------------------------------

def run_text_functions(spark, folder):
    p = table(spark, folder, "pages")
    return shape(p.select(
        "page_id",
        S.leaf_name("url").alias("leaf"),
        S.capture_ci("url", "//([^/]+)/").alias("host"),
        S.matches_ci("url", "EXAMPLE\\.COM").alias("is_com"),
        S.is_blank(F.regexp_extract("url", "\\?(.*)$", 1)).alias("no_query"),
        F.lower(F.trim(F.concat(F.lit("  "), "url"))).alias("lowered"),
        S.url_encode("url").alias("encoded"),
        F.col("url").contains("/en/").alias("has_en"),
        F.replace("url", F.lit("http://"), F.lit("")).alias("bare"),
    ))


def run_name_dims(spark, folder):
    """Language and scheme taken from the address; pages from which one is missing drop out."""
    p = table(spark, folder, "pages").select("page_id", "url")
    out = files.with_dims(p, "url", {
        "lang": {"/en/": "en", "/fr/": "fr", "/de/": "de"}, "scheme": {"https:": "secure", "http:": "plain"}})
    return shape(out.groupBy("lang", "scheme").agg(F.count("*").alias("n")))


def run_date_functions(spark, folder):
    o = table(spark, folder, "orders")
    d = F.to_date("o_orderdate")
    serial = F.datediff(d, F.lit("1899-12-30").cast("date")).cast("string")
    text = F.when(F.col("o_orderkey") % 3 == 0, serial).when(F.col("o_orderkey") % 3 == 1, S.iso_date(d)).otherwise(
        F.concat(F.lit("x"), S.iso_date(d)))
    parsed = o.select("o_orderkey", "o_orderdate", text.alias("t")).select(
        "o_orderkey", S.parse_serial_date("t").alias("date"), S.parse_serial_date("t", 1998).alias("in_1998"),
        S.month_start("o_orderdate").alias("month"))
    return shape(parsed.groupBy("month").agg(
        F.count("date").alias("n_dates"), F.count("in_1998").alias("n_1998"), F.min("date").alias("first"),
        S.days_inclusive(F.min("date"), F.max("date")).alias("span")))


def run_number_functions(spark, folder):
    line = table(spark, folder, "lineitem")
    key = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    whole = F.floor(F.col("l_extendedprice") / 1000)  # written with a thousands separator
    price = F.concat_ws(",", F.nullif(whole.cast("string"), F.lit("0")), F.format_string(
        "%07.3f", F.col("l_extendedprice") - whole * 1000))
    text = F.when(key % 11 == 0, F.lit("")).when(key % 13 == 0, F.lit("n/a")).otherwise(price)
    v = F.col("v")
    rows = line.select("l_returnflag", "l_quantity", "l_discount", "l_tax", "l_linenumber", S.parse_number(text).alias("v"))
    return shape(rows.groupBy("l_returnflag").agg(
        F.count(v).alias("n_parsed"),
        F.count_if(S.is_finite(v)).alias("n_finite"),
        F.sum(S.clip_lower(v - 50_000)).alias("clipped"),
        F.sum(F.signum(F.col("l_quantity") - 25)).alias("sign_sum"),
        F.sum(F.pmod(F.col("l_linenumber") - 4, F.lit(3))).alias("mod_sum"),
        F.max(S.row_range(["l_quantity", "l_discount", "l_tax"])).alias("max_row_range"),
        F.sum(S.to_location(F.concat(F.col("l_quantity").cast("string"), F.lit("5")))).alias("location_sum"),
        F.sum(F.bround(F.col("l_quantity") / 2, 0)).alias("half_even"),
        S.rmse(F.col("l_discount") - F.col("l_tax")).alias("rmse"),
    ), 3)


def run_percent_rules(spark, folder):
    """Guarded and unguarded change against a base that is sometimes zero."""
    line = table(spark, folder, "lineitem").select("l_tax", "l_discount")
    rows = line.select(
        "l_tax", S.percent_change("l_tax", "l_discount").alias("guarded"),
        S.percent_change("l_tax", "l_discount", guard=False).alias("open"), S.ratio("l_tax", "l_discount").alias("ratio"))
    return shape(rows.groupBy("l_tax").agg(
        F.count("*").alias("n"), F.count("guarded").alias("n_guarded"), F.count("open").alias("n_open"),
        F.count_if(S.is_finite("open")).alias("n_finite"), F.avg("guarded").alias("mean_guarded"), F.avg("ratio").alias("mean_ratio")))


# ---- sinks ---------------------------------------------------------------------------------

def run_csv_round_trip(spark, folder):
    """Table to headed CSV and back with a declared schema, strict and lenient casts."""
    path = new_folder(spark, "orders-csv")
    out = table(spark, folder, "orders").select(
        "o_orderkey", "o_orderstatus", S.iso_date("o_orderdate").alias("date"),
        F.when(F.col("o_orderkey") % 10 == 0, F.lit("unknown")).otherwise(F.col("o_totalprice").cast("string")).alias("price"),
        F.concat(F.lit('say "hi", '), "o_orderpriority").alias("note"))
    tables.write_table(out, path, "csv")
    back = tables.read_text_table(spark, path, out.columns)
    strict = tables.cast_strict(back, {"o_orderkey": "bigint", "date": "date"})
    loose = tables.cast_coerce(strict, ["price"])
    return shape(loose.groupBy("o_orderstatus", "note").agg(
        F.count("*").alias("n"), F.count("price").alias("n_price"), F.sum("price").alias("total"), F.max("date").alias("last")), 2)


def run_parquet_round_trip(spark, folder):
    path = new_folder(spark, "days")
    tables.write_table(order_days(spark, folder), path, partition_by=["year"])
    back = spark.read.parquet(path)
    return shape(back.groupBy("year", "grp").agg(F.count("*").alias("n"), F.sum("level").alias("level_sum")))


_GRID = """
grid AS (
  SELECT CAST(CAST(floor(conv_id / 10) AS BIGINT) AS VARCHAR) AS workbook, 's' || conv_id AS sheet, turn + 1 AS "row",
         CASE role WHEN 'system' THEN 1 WHEN 'user' THEN 2 ELSE 3 END AS "column", text FROM conversations)"""
_COMPACT_K = """'{"k":' || json_extract_string(props, '$.k') || ',"kind":"' || event_type || '"}'"""

QUERIES = {
    "cell_inventory": Query(run_sheet_inventory, f"""WITH {_GRID} SELECT workbook, sheet, max("row") AS used_rows,
        CAST(max("column") AS BIGINT) AS used_columns,
        md5(coalesce(string_agg(text, ' | ' ORDER BY "column") FILTER ("row" = 1 AND trim(text) <> ''), '')) AS first_row_headers
        FROM grid GROUP BY 1, 2"""),
    "head_cells": Query(run_head_cells, shaped(f"""WITH {_GRID} --final SELECT workbook, sheet, "row", "column",
        chr(CAST(64 + "column" AS INT)) || "row" AS address, md5(text) AS text_md5
        FROM grid WHERE "row" <= 3 AND "column" <= 2 AND trim(text) <> ''""", ints='"column"')),
    "keyword_scan": Query(run_keyword_scan, shaped(f"""WITH {_GRID} --final SELECT workbook, sheet, "row", "column",
        length(text) AS chars FROM grid WHERE regexp_matches(text, 'the|tion', 'i')""", ints='"column"')),
    "row_scan": Query(run_row_scan, f"""WITH {_GRID}, r AS (
        SELECT workbook, sheet, "row", string_agg('C' || "column" || '=' || text, ' | ' ORDER BY "column") AS t
        FROM grid WHERE trim(text) <> '' GROUP BY 1, 2, 3)
        SELECT workbook, sheet, "row", md5(t) AS row_md5 FROM r WHERE regexp_matches(t, 'whth|eau', 'i')"""),
    "alias_resolution": Query(run_alias, f"""WITH {_GRID},
        c AS (SELECT * FROM (VALUES (1, 's3'), (2, 's13'), (3, 's11'), (4, 's25'), (5, 's24'), (6, 's42')) t(prio, sheet))
        SELECT workbook, arg_min(c.sheet, prio) AS resolved FROM (SELECT DISTINCT workbook, sheet FROM grid) g
        LEFT JOIN c USING (sheet) GROUP BY 1"""),
    "label_summary": Query(run_label_summary, shaped(f"""WITH {_GRID},
        w AS (SELECT DISTINCT workbook, "column", unnest(regexp_split_to_array(text, '\\s+')) AS t FROM grid WHERE "row" <= 2)
        --final SELECT workbook, "column", count(*) AS n_matches, string_agg(t, ' || ' ORDER BY t) AS variables
        FROM w WHERE regexp_matches(t, '^[a-z]*whth[a-z]*$', 'i') GROUP BY 1, 2""", ints='"column"')),
    "read_sheet": Query(run_read_sheet, f"""WITH {_GRID} SELECT workbook, sheet, "row", md5(max(text) FILTER ("column" = 2)) AS question,
        md5(max(text) FILTER ("column" = 3)) AS answer FROM grid WHERE "row" > 1 GROUP BY 1, 2, 3"""),
    "positional_pivot": Query(run_positional, shaped(f"""WITH {ORDER_DAYS} --final SELECT year, grp, date, inflow, outflow,
        level, CASE WHEN year >= 1998 THEN model END AS model, net FROM order_days""",
        real="inflow outflow level model net", ints="year", dates="date")),
    "header_discovery": Query(run_header_discovery, shaped("""SELECT event_type, CAST(ts AS DATE) AS date,
        'S' || (user_id % 4 + 1) AS sensor, max(value) AS value FROM events GROUP BY 1, 2, 3""", dates="date")),
    "eav_json": Query(run_eav, """SELECT p_partkey, p_name AS title, '["' || p_brand || '","' || p_type || '"]' AS subject,
        '[{"size":' || p_size || '}]' AS author, '' AS keyword, '1.' || (p_size % 3) AS version,
        CAST(2 AS BIGINT) AS file_count FROM part"""),
    "field_values": Query(run_field_values, """SELECT p_partkey, CAST(f.at AS BIGINT) AS position, f.field, f.kind,
        CAST(f.n AS BIGINT) AS n_values, f.value FROM (SELECT p_partkey, unnest([
          {'at': 0, 'field': 'title', 'kind': 'text', 'n': 1, 'value': p_name},
          {'at': 1, 'field': 'looks_like_list', 'kind': 'text', 'n': 1, 'value': '["' || p_brand || '"]'},
          {'at': 2, 'field': 'subject', 'kind': 'list', 'n': 2, 'value': p_brand || '|' || p_type},
          {'at': 3, 'field': 'size', 'kind': 'number', 'n': 1, 'value': CAST(p_size AS VARCHAR)},
          {'at': 4, 'field': 'large', 'kind': 'boolean', 'n': 1, 'value': CASE WHEN p_size > 25 THEN 'true' ELSE 'false' END},
          {'at': 5, 'field': 'author', 'kind': 'object', 'n': 1, 'value': '{"p_brand":"' || p_brand || '","p_size":' || p_size || '}'},
          {'at': 6, 'field': 'none', 'kind': 'null', 'n': 0, 'value': ''},
          {'at': 7, 'field': 'empty', 'kind': 'list', 'n': 0, 'value': ''}]) AS f FROM part)"""),
    "file_explode": Query(run_file_explode, """SELECT p_partkey, p_partkey AS file_id, filename, 'text/csv' AS content_type,
        CAST(size AS BIGINT) AS size_bytes, 'MD5' AS checksum_type, md5(p_name) AS checksum_value, p_type AS description,
        FALSE AS restricted FROM (SELECT *, p_brand AS filename, p_size AS size FROM part
        UNION ALL SELECT *, p_type, p_size * 2 FROM part)"""),
    "json_props": Query(run_json_props, f"""SELECT {_COMPACT_K} AS doc, count(*) AS n,
        CAST(min(CAST(json_extract_string(props, '$.k') AS INT)) AS BIGINT) AS k FROM events GROUP BY 1"""),
    "catalogue_flatten": Query(run_catalogue, """SELECT s_name AS dataset_title, 'id:' || s_suppkey AS persistent_id,
        replace(s_name, '#', '%23') AS url, strftime(DATE '2020-01-01' + CAST(s_suppkey % 400 AS INT), '%Y-%m-%d') AS publication_date,
        n_name AS description, s_name || '; ' || n_name AS authors, 'Supply' AS subjects, 'dataset' AS type
        FROM supplier JOIN nation ON n_nationkey = s_nationkey"""),
    "text_functions": Query(run_text_functions, """SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS leaf,
        regexp_extract(url, '//([^/]+)/', 1) AS host, regexp_matches(url, 'example\\.com', 'i') AS is_com,
        trim(regexp_extract(url, '\\?(.*)$', 1)) = '' AS no_query, lower(url) AS lowered, url_encode(url) AS encoded,
        contains(url, '/en/') AS has_en, replace(url, 'http://', '') AS bare FROM pages"""),
    "name_dims": Query(run_name_dims, """SELECT * FROM (SELECT CASE WHEN contains(url, '/en/') THEN 'en'
        WHEN contains(url, '/fr/') THEN 'fr' WHEN contains(url, '/de/') THEN 'de' END AS lang,
        CASE WHEN contains(url, 'https:') THEN 'secure' WHEN contains(url, 'http:') THEN 'plain' END AS scheme,
        count(*) AS n FROM pages GROUP BY 1, 2) WHERE lang IS NOT NULL AND scheme IS NOT NULL"""),
    "date_functions": Query(run_date_functions, shaped("""WITH d AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month,
        CASE WHEN o_orderkey % 3 < 2 THEN CAST(o_orderdate AS DATE) END AS date FROM orders) --final
        SELECT month, count(date) AS n_dates, count(date) FILTER (year(date) = 1998) AS n_1998, min(date) AS "first",
          date_diff('day', min(date), max(date)) + 1 AS span FROM d GROUP BY 1""", dates='month "first"')),
    "number_functions": Query(run_number_functions, shaped("""WITH r AS (SELECT *,
          CASE WHEN (l_orderkey * 10 + l_linenumber) % 11 = 0 OR (l_orderkey * 10 + l_linenumber) % 13 = 0 THEN NULL
               ELSE l_extendedprice END AS v FROM lineitem) --final
        SELECT l_returnflag, count(v) AS n_parsed, count(v) AS n_finite, sum(greatest(v - 50000, 0)) FILTER (v IS NOT NULL) AS clipped,
          CAST(sum(sign(l_quantity - 25)) AS DOUBLE) AS sign_sum, sum(((l_linenumber - 4) % 3 + 3) % 3) AS mod_sum,
          max(greatest(l_quantity, l_discount, l_tax) - least(l_quantity, l_discount, l_tax)) AS max_row_range,
          sum(floor(l_quantity)) AS location_sum, sum(round_even(l_quantity / 2, 0)) AS half_even,
          sqrt(avg((l_discount - l_tax) * (l_discount - l_tax))) AS rmse FROM r GROUP BY 1""",
        real="clipped sign_sum max_row_range half_even rmse", ints="mod_sum location_sum", digits=3)),
    "percent_rules": Query(run_percent_rules, shaped("""SELECT l_tax, count(*) AS n,
        count(*) FILTER (l_tax <> 0) AS n_guarded, count(*) FILTER (l_tax <> 0 OR l_discount <> 0) AS n_open,
        count(*) FILTER (l_tax <> 0) AS n_finite, avg(100 * (l_discount - l_tax) / nullif(l_tax, 0)) AS mean_guarded,
        avg(l_discount / nullif(l_tax, 0)) AS mean_ratio FROM lineitem GROUP BY 1""", real="l_tax mean_guarded mean_ratio")),
    "csv_round_trip": Query(run_csv_round_trip, shaped("""SELECT o_orderstatus, 'say "hi", ' || o_orderpriority AS note,
        count(*) AS n, count(*) FILTER (o_orderkey % 10 <> 0) AS n_price,
        sum(o_totalprice) FILTER (o_orderkey % 10 <> 0) AS total, max(CAST(o_orderdate AS DATE)) AS "last"
        FROM orders GROUP BY 1, 2""", real="total", dates='"last"', digits=2)),
    "parquet_round_trip": Query(run_parquet_round_trip, shaped(f"""WITH {ORDER_DAYS} --final
        SELECT year, grp, count(*) AS n, sum(level) AS level_sum FROM order_days GROUP BY 1, 2""", real="level_sum", ints="year")),
}
