"""Tables, cell grids, workbooks, JSON records, manifests, streams."""

import datetime as dt
import hashlib
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from panelstats.operators import series, spells
from panelstats.session import materialise, new_folder
from panelstats.sources import catalogue, cells, files, tables, xlsx
from panelstats.streaming import daily


def test_csv_with_mark_and_quotes(spark, tmp_path, rows):
    p = tmp_path / "t.csv"
    p.write_bytes('﻿"x","note"\n"1.5","say ""hi"",\nthen go"\n"NaN","b"\n'.encode())
    df = tables.read_table(spark, str(p), "x double, note string", multiline=True)
    assert rows(df) == [(1.5, 'say "hi",\nthen go'), (None, "b")]


def test_casts(spark):
    df = spark.createDataFrame([("1",), ("x",), (None,)], "v string")
    assert [r[0] for r in tables.cast_coerce(df, ["v"]).collect()] == [1.0, None, None]
    assert [r[0] for r in tables.cast_strict(df.where("v is null or v = '1'"), {"v": "int"}).collect()] == [1, None]
    with pytest.raises(Exception, match="cannot read as int: x"):
        tables.cast_strict(df, {"v": "int"}).collect()


def test_write_and_report(spark, rows):
    df = spark.createDataFrame([(1, 1.23456, "a")], "i int, v double, s string")
    path = new_folder(spark, "t")
    tables.write_table(df, path, "csv")
    assert rows(tables.read_table(spark, path, "i int, v double, s string")) == rows(df)
    assert rows(tables.report(df, ["v", "s"], {"v": 2})) == [(1.23, "a")]
    assert rows(tables.select_rename(df, {"v": "value"})) == [(1.23456,)]
    assert rows(materialise(df)) == rows(df)


GRID = [
    (1, 1, "TITLE"), (2, 1, "Date"), (2, 2, "Depth (cm) SENSOR S6"), (2, 3, "note"), (2, 4, "depth (CM) sensor 3"),
    (3, 1, "43599"), (3, 2, "12.5"), (3, 3, "x"), (3, 4, "7"), (4, 1, "2019-05-15"), (4, 2, " "), (4, 3, "y"),
    (4, 4, "1,234"), (5, 2, "9"),
]


@pytest.fixture(scope="module")
def grid(spark):
    return spark.createDataFrame([("w.xlsx", "G", r, c, t) for r, c, t in GRID],
                                 "workbook string, sheet string, row int, column int, text string")


def test_header_discovery(grid, rows):
    out = cells.discover_and_unpivot(grid, r"Depth.*SENSOR\s+S?([0-9]+)", prefix="S")
    d = dt.date
    assert rows(out, "date", "sensor", "value") == sorted(
        [(d(2019, 5, 14), "S6", 12.5), (d(2019, 5, 14), "S3", 7.0), (d(2019, 5, 15), "S3", 1234.0)], key=repr)
    undated = grid.where("not (row = 2 and column = 1)")
    assert cells.discover_and_unpivot(undated, "Depth.*", on_missing="skip", prefix="").count() == 0
    with pytest.raises(Exception, match="no date column in w.xlsx G"):
        cells.discover_and_unpivot(undated, r"Depth.*SENSOR\s+S?([0-9]+)").collect()


def test_grid_reports(grid, rows):
    assert rows(cells.sheet_inventory(grid)) == [("w.xlsx", "G", 5, 4, "TITLE")]
    assert rows(cells.head_cells(grid, 2, 2), "address") == [("A1",), ("A2",), ("B2",)]
    assert cells.scan_cells(grid, "sensor|TITLE").count() == 3
    assert rows(cells.scan_rows(grid, "sensor 3"), "row_text") == [("C1=Date | C2=Depth (cm) SENSOR S6 | C3=note | C4=depth (CM) sensor 3",)]
    assert rows(cells.label_summary(grid, ["sheet"], "depth")) == [("G", 2, "Depth (cm) SENSOR S6 || depth (CM) sensor 3")]
    assert rows(cells.read_sheet(grid, "G", 2, {"when": 1, "value": 4}), "when", "value") == [
        ("2019-05-15", "1,234"), ("43599", "7"), (None, None)]


def test_alias(spark, rows):
    df = spark.createDataFrame([("w1", "Yield"), ("w1", "Yield+product"), ("w2", "Other")], "workbook string, sheet string")
    assert rows(cells.resolve_alias(df, ["Yield+product", "Yield"])) == [("w1", "Yield+product"), ("w2", None)]


def test_positions_keep_variables_apart(spark, rows):
    data = [(2019, "b", "s", 3, 2, "5"), (2019, "b", "s", 3, 3, "6"), (2020, "b", "s", 3, 2, "7"), (2020, "b", "s", 3, 4, "8")]
    g = spark.createDataFrame(data, "year int, workbook string, sheet string, row int, column int, text string")
    layout = [(2019, 2, "flow"), (2019, 3, "model_a"), (2020, 2, "flow"), (2020, 4, "model_b")]
    out = cells.map_positions(g, ["year"], layout, ["flow", "model_a", "model_b"])
    assert rows(out, "year", "flow", "model_a", "model_b") == [(2019, "5", "6", None), (2020, "7", None, "8")]
    with pytest.raises(Exception, match="no column mapping"):
        cells.map_positions(g, ["year"], layout[:2], ["flow", "model_a", "model_b"]).collect()


def write_workbook(path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} {rel}><sheets><sheet name="G" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>Date</t></si><si><r><t>De</t></r><r><t>pth</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row r="2"><c r="A2" t="s"><v>0</v></c>'
                   '<c r="AB2" t="s"><v>1</v></c></row><row r="3"><c r="A3"><v>43599</v></c><c r="B3"><f>A3+1</f><v>43600</v></c>'
                   '<c r="C3" t="inlineStr"><is><t>x</t></is></c><c r="D3"/></row></sheetData></worksheet>')


def test_field_values(spark, rows):
    record = lambda fields: '{"data":{"latestVersion":{"metadataBlocks":{"citation":{"fields":' + fields + "}}}}}"
    bodies = [(1, record('[{"typeName":"a","value":"[1]"},{"value":[1,{"b":2},null,"x"]},{"typeName":"c"},{"typeName":"d","value":1.5}]')),
              (2, record("[]")), (3, "{not json"), (4, None), (5, "{}"), (6, record('{"typeName":"a"}'))]
    got = catalogue.field_values(spark.createDataFrame(bodies, "id int, body string"), ["id"], "body")
    assert rows(got, "id", "position", "field", "kind", "values") == [
        (1, 0, "a", "text", ["[1]"]), (1, 1, None, "list", ["1", '{"b":2}', None, "x"]), (1, 2, "c", "null", []),
        (1, 3, "d", "number", ["1.5"])]


def test_workbooks(spark, tmp_path, rows):
    write_workbook(tmp_path / "a_2019.xlsx")
    write_workbook(tmp_path / "b_2020.xlsx")
    got = xlsx.read_workbooks(spark, str(tmp_path)).where("workbook = 'a_2019.xlsx'")
    assert rows(got, "sheet", "row", "column", "text", "formula") == [
        ("G", 2, 1, "Date", None), ("G", 2, 28, "Depth", None), ("G", 3, 1, "43599", None), ("G", 3, 2, "43600", "A3+1"),
        ("G", 3, 3, "x", None)]


def test_glob_and_dims(spark, tmp_path, rows):
    for name in ("x_AWD_2019.csv", "x_DFL_2020.csv", "x_2020.csv", "x_AWD_2019.txt"):
        (tmp_path / name).write_text("abc")
    found = files.scan_glob(spark, [str(tmp_path)], "*.csv")
    dims = files.with_dims(found, "file_name", {"treatment": {"_AWD_": "AWD", "_DFL_": "DFL"}, "year": {"2019": "2019", "2020": "2020"}})
    assert rows(dims, "treatment", "year", "size_bytes") == [("AWD", "2019", 3), ("DFL", "2020", 3)]


def test_manifest(spark, tmp_path, rows):
    for name in ("match", "upper", "size", "hash", "algo", "none"):
        (tmp_path / name).write_text("hello")
    md5, sha1 = hashlib.md5(b"hello").hexdigest(), hashlib.sha1(b"hello").hexdigest()
    data = [("match", 5, "MD5", md5), ("upper", 5, "SHA-1", sha1.upper()), ("size", 6, "MD5", md5), ("hash", 5, "MD5", sha1),
            ("lost", 5, "MD5", md5), ("algo", 5, "CRC32", "1"), ("none", None, None, None)]
    manifest = spark.createDataFrame(data, "filename string, size_bytes long, checksum_type string, checksum_value string")
    v = files.verify_manifest(manifest, files.file_facts(spark, [str(tmp_path)]))
    assert dict(rows(v, "filename", "status")) == {
        "match": "match", "upper": "match", "size": "size_mismatch", "hash": "hash_mismatch", "lost": "missing",
        "algo": "unsupported_algorithm", "none": "match"}
    assert {r.rule: r.failed for r in files.integrity_rules(v).collect()} == {"missing": 1, "size_mismatch": 1, "hash_mismatch": 1}
    assert files.integrity_report(v).first().verified_date == dt.datetime.now(dt.timezone.utc).strftime("%Y-%m-%d")


RECORD = {"status": "OK", "data": {"latestVersion": {
    "versionNumber": 2, "versionMinorNumber": 1, "metadataBlocks": {"citation": {"fields": [
        {"typeName": "title", "value": "T"}, {"typeName": "title", "value": "second"},
        {"typeName": "author", "value": [{"name": "n"}]}, {"typeName": "subject", "value": ["a", "b"]}]}},
    "files": [{"description": "d", "restricted": False, "dataFile": {
        "id": 7, "filename": "f", "filesize": 3, "contentType": "c", "checksum": {"type": "MD5", "value": "v"}}}]}}}


def test_records(spark, tmp_path, rows):
    (tmp_path / "r.json").write_text(json.dumps(RECORD, indent=1))
    (tmp_path / "s.json").write_text("{broken")
    df = catalogue.read_json(spark, str(tmp_path), catalogue.RECORD_SCHEMA)
    good = catalogue.require_status(df.where("file_name = 'r.json'"))
    out = catalogue.record_fields(good, ["file_name"], ["title", "author", "subject", "grant"])
    assert rows(out) == [("r.json", "T", '[{"name":"n"}]', '["a","b"]', "", "2.1", 1)]
    assert rows(catalogue.explode_files(good, ["file_name"]), "filename", "size_bytes", "restricted") == [("f", 3, False)]
    assert df.count() == 2
    with pytest.raises(Exception, match="response status"):
        catalogue.require_status(df).select("data").collect()


def test_catalogue_and_deposit(spark, tmp_path, rows):
    item = {"name": "n", "global_id": "g", "published_at": "2020", "authors": ["a", "b"], "subjects": ["s"], "type": "dataset"}
    (tmp_path / "c.json").write_text(json.dumps({"status": "OK", "data": {"items": [item]}}))
    df = spark.read.schema(catalogue.CATALOGUE_SCHEMA).option("multiLine", True).json(str(tmp_path / "c.json"))
    assert rows(catalogue.flatten_catalogue(df), "persistent_id", "authors") == [("g", "a; b")]
    d = spark.createDataFrame([('{"id":"1","files":[{"key":"k","size":2,"checksum":"md5:ab"}]}',)], "t string")
    parsed = d.select(F.from_json("t", catalogue.DEPOSIT_SCHEMA).alias("r")).select("r.*")
    assert rows(catalogue.deposit_files(parsed)) == [("1", "k", 2, "md5", "ab")]


# ---- streams ---------------------------------------------------------------------------

@pytest.fixture(scope="module")
def landed(spark):
    """Three files of readings in time order, one row per half day and key."""
    folder = new_folder(spark, "landed")
    base = spark.range(120).select(
        F.when(F.col("id") % 3 == 0, "b").otherwise("a").alias("k"),
        (F.lit("2024-01-01").cast("timestamp") + F.make_interval(hours=(F.col("id") * 12).cast("int"))).alias("ts"),
        ((F.col("id") * 37) % 11).cast("double").alias("v"))
    for lo in (0, 40, 80):
        base.where((F.col("v") >= 0) & (F.col("ts") >= F.expr(f"timestamp'2024-01-01' + interval {lo * 12} hours"))
                   & (F.col("ts") < F.expr(f"timestamp'2024-01-01' + interval {(lo + 40) * 12} hours"))
                   ).coalesce(1).write.mode("append").parquet(folder)
    return folder


def test_stream_equals_batch(spark, landed, rows):
    stream = daily.file_stream(spark, landed, "*.parquet", files_per_batch=1)
    batch = spark.read.parquet(landed)
    qa = daily.fill_table(daily.stream_qa(stream, ["k"], "ts", "v"), "qa", "complete")
    want = batch.groupBy("k").agg(F.count("*"), F.min("v"), F.max("ts"))
    assert rows(qa, "k", "n_rows", "min_value", "last_ts") == rows(want)
    days = daily.fill_table(daily.daily_stream(stream, ["k"], "ts", "v"), "days")
    full = batch.groupBy("k", F.to_date("ts").alias("date")).agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.sum("v").alias("total"))
    closed = full.where("date + interval 1 day <= timestamp'2024-02-28 12:00:00'")
    assert rows(days) == rows(closed) and days.count() > 50
    path = new_folder(spark, "months")
    days.repartition(3).write.parquet(path)
    months = daily.fill_table(daily.monthly_stream(daily.file_stream(spark, path, "*.parquet", 1), ["k"]), "m", "complete")
    want = days.groupBy("k", F.trunc("date", "MM").alias("month")).agg(F.avg("mean"), F.min("mean"), F.max("mean"), F.count("*"))
    assert len(rows(months)) == 4
    assert [r[:2] + tuple(round(x, 9) for x in r[2:]) for r in rows(months)] == [
        r[:2] + tuple(round(x, 9) for x in r[2:]) for r in rows(want)]


@pytest.mark.parametrize("files", [[0, 1, 2, 3], [3, 1, 0, 2], [2, 3, 1, 0]])
def test_stream_spells_equal_batch(spark, landed, rows, files):
    """Files out of order, one for each batch; a far day of another key moves the watermark past all others."""
    path = new_folder(spark, "daily")
    day = spark.read.parquet(landed).groupBy("k", F.to_date("ts").alias("date")).agg(F.avg("v").alias("h"))
    for part in files:
        day.where(F.floor(F.dayofyear("date") / 16) == part).coalesce(1).write.mode("append").parquet(path)
    spark.sql("SELECT 'far' AS k, DATE'2024-06-30' AS date, 1.0D AS h").coalesce(1).write.mode("append").parquet(path)
    stream = daily.file_stream(spark, path, "*.parquet", files_per_batch=1)
    got = daily.fill_table(daily.spells_stream(stream, "k", "date", "h", 5.0, "70 days"), "spells")
    states = spells.daily_states(day, ["k"], "date", "h", 5.0)
    batch = spells.spells(states, ["k"], "date", "wet")
    last = batch.groupBy("k").agg(F.max("start").alias("open"))
    ended = batch.join(last, "k").where("start < open")
    assert rows(got, "k", "state", "start", "end", "length") == rows(ended, "k", "wet", "start", "end", "length")
