"""Workbooks to the long cell table. One file per row of a binary scan; a small helper
reads the sheet parts of one file, everything after that is DataFrame work. `workbooks` reads by sheet."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from panelstats.functions.scalar import leaf_name

CELL_SCHEMA = "workbook string, sheet string, row int, column int, text string, raw_value string, formula string, number_format string"
COLUMNS = ["workbook", "sheet", "row", "column", "text", "raw_value", "formula", "number_format"]

# fixed values of the file format: numbered formats that have one code everywhere
NUMBERED_FORMATS = {
    "1": "0", "2": "0.00", "3": "#,##0", "4": "#,##0.00", "9": "0%", "10": "0.00%", "11": "0.00E+00",
    "14": "mm-dd-yy", "22": "m/d/yy h:mm", "49": "@",
}


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _plain(text: str) -> str:
    """Characters that XML cannot carry are written as _xHHHH_."""
    return re.sub("_x([0-9A-Fa-f]{4})_", lambda m: chr(int(m.group(1), 16)), text)


def _text_of(node) -> str:
    return _plain("".join(t.text or "" for t in node.iter() if _local(t.tag) == "t"))


def column_number(reference: str) -> int:
    n = 0
    for letter in re.match("[A-Z]+", reference).group():
        n = n * 26 + ord(letter) - 64
    return n


def sheet_parts(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    """Sheet names with the part that holds their cells, in workbook order."""
    links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    root = ElementTree.fromstring(book.read("xl/workbook.xml"))
    found = []
    for sheet in (e for e in root.iter() if _local(e.tag) == "sheet"):
        target = links[next(v for k, v in sheet.attrib.items() if k.endswith("}id"))]
        path = target.lstrip("/") if target.startswith("/") else posixpath.normpath(f"xl/{target}")
        found.append((sheet.get("name"), path))
    return found


def shared_texts(book: zipfile.ZipFile) -> list[str]:
    texts: list[str] = []
    if "xl/sharedStrings.xml" in book.namelist():
        with book.open("xl/sharedStrings.xml") as stream:
            for _, node in ElementTree.iterparse(stream):
                if _local(node.tag) == "si":
                    texts.append(_text_of(node))
                    node.clear()
    return texts


def number_formats(book: zipfile.ZipFile) -> list[str | None]:
    """Format code of each cell style; None for the general format and for numbered formats without a fixed code."""
    if "xl/styles.xml" not in book.namelist():
        return []
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    own = {n.get("numFmtId"): n.get("formatCode") for n in root.iter() if _local(n.tag) == "numFmt"}
    styles = next((n for n in root if _local(n.tag) == "cellXfs"), ())
    return [own.get(x.get("numFmtId"), NUMBERED_FORMATS.get(x.get("numFmtId"))) for x in styles]


def sheet_cells(book: zipfile.ZipFile, path: str, shared: list[str], formats: list[str | None]) -> Iterator[tuple]:
    """(row, column, value, formula, number format) of one sheet in file order; read as a stream."""
    with book.open(path) as stream:
        rows = None
        for event, node in ElementTree.iterparse(stream, ("start", "end")):
            tag = _local(node.tag)
            if event == "start":
                rows = node if tag == "sheetData" else rows
            elif tag == "row":
                rows.clear()
            elif tag == "c":
                parts_of = {_local(k.tag): k for k in node}
                raw = parts_of["v"].text if "v" in parts_of else None
                kind, ref = node.get("t"), node.get("r")
                if kind == "s" and raw is not None:
                    raw = shared[int(raw)]
                elif kind == "inlineStr" and "is" in parts_of:
                    raw = _text_of(parts_of["is"])
                formula = parts_of["f"].text if "f" in parts_of else None
                if raw is not None or formula is not None:
                    style = int(node.get("s") or 0)
                    row = int(re.search(r"\d+", ref).group())
                    yield row, column_number(ref), raw, formula, formats[style] if style < len(formats) else None


def workbook_cells(name: str, content: bytes) -> Iterator[tuple]:
    """Cells of one workbook in file order; sheets are read as streams."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        shared, formats = shared_texts(book), number_formats(book)
        for sheet, path in sheet_parts(book):
            for row, column, raw, formula, code in sheet_cells(book, path, shared, formats):
                yield name, sheet, row, column, raw, raw, formula, code


def read_workbooks(spark: SparkSession, path: str, pattern: str = "*.xlsx") -> DataFrame:
    """Cells of all workbooks below a folder; text and raw value agree, display texts are not rendered."""
    files = (
        spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True)
        .load(path).select(leaf_name("path").alias("workbook"), "content")
    )

    def to_cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["workbook"], batch["content"]):
                rows: list[tuple] = []
                for cell in workbook_cells(name, content):
                    rows.append(cell)
                    if len(rows) == 50_000:
                        yield pd.DataFrame(rows, columns=COLUMNS)
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=COLUMNS)

    return files.mapInPandas(to_cells, CELL_SCHEMA)
