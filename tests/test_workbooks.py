"""The workbook format: what is written comes back, by sheet, and nothing half written is seen."""

import os

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from panelstats.sources import cells, workbooks, xlsx

SCHEMA = "workbook string, sheet string, row int, column int, text string, formula string"
TEXTS = ["Date", "", " two  blanks ", "1.50", "-3", "007", "1e5", "a\nb\r\nc\td", "<&>\"'", "_x0041_", "\x07bell￾", "\U0001f33e é",
         "x" * 40_000]


def grid(spark):
    rows = [("b.xlsx", "one", k + 1, 1 + 27 * k, t, None) for k, t in enumerate(TEXTS)]
    rows += [("b.xlsx", "two & <3>", 1, 1, "5", "2+3"), ("b.xlsx", "two & <3>", 1, 2, None, "A1"), ("b.xlsx", "two & <3>", 9, 1, None, None),
             ("b.xlsx", "two & <3>", 10, 1, "yes", 'IF(A1>4,"yes","no")'), ("a.xlsx", "one", 1_048_576, 16_384, "corner", None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def wanted(df):
    kept = df.where("text IS NOT NULL OR formula IS NOT NULL")
    return sorted(map(tuple, kept.select(*SCHEMA.replace(" string", "").replace(" int", "").split(", ")).collect()), key=repr)


def test_round_trip(spark, tmp_path):
    workbooks.write_workbooks(grid(spark), str(tmp_path))
    back = workbooks.read_cells(spark, str(tmp_path))
    assert wanted(back) == wanted(grid(spark))
    assert back.rdd.getNumPartitions() == 3 and back.columns == xlsx.COLUMNS  # one for each sheet
    assert wanted(xlsx.read_workbooks(spark, str(tmp_path))) == wanted(back)
    assert sorted(os.listdir(tmp_path)) == ["a.xlsx", "b.xlsx"]
    joined = workbooks.read_cells(spark, str(tmp_path), partitionBytes="1000000000")
    assert joined.rdd.getNumPartitions() == 1 and wanted(joined) == wanted(back)
    one = workbooks.read_cells(spark, str(tmp_path), sheets="one", pathGlobFilter="b*")
    assert one.rdd.getNumPartitions() == 1 and one.count() == len(TEXTS)
    assert cells.sheet_inventory(back).count() == 3


def test_modes(spark, tmp_path):
    workbooks.write_workbooks(grid(spark), str(tmp_path))
    more = spark.createDataFrame([("c.xlsx", "s", 1, 1, "t")], "workbook string, sheet string, row long, column long, text string")
    workbooks.write_workbooks(more, str(tmp_path))
    assert sorted(os.listdir(tmp_path)) == ["a.xlsx", "b.xlsx", "c.xlsx"]
    workbooks.write_workbooks(more, str(tmp_path), "overwrite")
    assert sorted(os.listdir(tmp_path)) == ["c.xlsx"]
    workbooks.write_workbooks(more.limit(0), str(tmp_path / "none"))
    os.makedirs(tmp_path / "empty")
    assert workbooks.read_cells(spark, str(tmp_path / "empty")).count() == 0


@pytest.mark.parametrize("bad, message", [
    ([("a.xlsx", "s", 1, 1, "x", None)] * 2, "repeated"),
    ([("a.xlsx", "s", 0, 1, "x", None)], "outside"),
    ([("a.xlsx", None, 1, 1, "x", None)], "needs"),
    ([("a/b.xlsx", "s", 1, 1, "x", None)], "file name"),
])
def test_bad_cells_leave_no_file(spark, tmp_path, bad, message):
    with pytest.raises(Exception, match=message):
        workbooks.write_workbooks(spark.createDataFrame(bad, SCHEMA), str(tmp_path))
    assert os.listdir(tmp_path) == []


def test_book_in_two_tasks(spark, tmp_path):
    cell = lambda k: spark.createDataFrame([("a.xlsx", "s", k, 1, "x")], "workbook string, sheet string, row int, column int, text string")
    workbooks.register(spark)
    with pytest.raises(Exception, match="two tasks"):
        cell(1).union(cell(2)).write.format("workbook").mode("append").save(str(tmp_path))
    assert os.listdir(tmp_path) == []


@settings(max_examples=200, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(st.characters(exclude_categories=("Cs",)), max_size=30), min_size=1, max_size=8))
def test_any_text_comes_back(tmp_path_factory, texts):
    path = tmp_path_factory.mktemp("book") / "t.xlsx"
    book = workbooks.BookFile(open(path, "wb"))
    book.begin_sheet("s")
    for k, t in enumerate(texts):
        book.add(k + 1, 1, t, None)
    book.end()
    assert [c[4] for c in xlsx.workbook_cells("t.xlsx", path.read_bytes())] == texts


def test_number_formats(tmp_path):
    import zipfile

    path = tmp_path / "f.xlsx"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{workbooks.MAIN}" xmlns:r="{workbooks.LINKS}"><sheets><sheet name="G" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="/xl/worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/styles.xml", f'<styleSheet xmlns="{workbooks.MAIN}"><numFmts><numFmt numFmtId="164" formatCode="yyyy-mm-dd"/></numFmts>'
                   '<cellXfs><xf numFmtId="0"/><xf numFmtId="164"/><xf numFmtId="10"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{workbooks.MAIN}"><sheetData><row r="1"><c r="A1"><v>1</v></c>'
                   '<c r="B1" s="1"><v>43599</v></c><c r="C1" s="2"><v>0.5</v></c></row></sheetData></worksheet>')
    assert [c[7] for c in xlsx.workbook_cells("f.xlsx", path.read_bytes())] == [None, "yyyy-mm-dd", "0.00%"]
