"""Workbooks as a format of Spark: `spark.read.format("workbook")` and `df.write.format("workbook")`.

Reading makes one partition of each sheet. Only the list of sheets is read while planning, so a folder of large
workbooks is spread over the cluster by sheet, and a task holds one row of a sheet and the shared texts of its book.
Options: `pathGlobFilter` (default *.xlsx), `sheets` (names separated by |), `partitionBytes` (neighbouring sheets are
joined up to this size of their parts; for many small books).

Writing makes one file of each workbook name. A book is written by one task as a stream, its sheets are bounded by the
format (1,048,576 rows). Files get their name when all tasks have ended; a lost task leaves nothing that is read.
"""

from __future__ import annotations

import fnmatch
import posixpath
import re
import uuid
import zipfile
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage,
)

from panelstats.sources.xlsx import CELL_SCHEMA, COLUMNS, number_formats, shared_texts, sheet_cells, sheet_parts

BATCH = 20_000
LAST_ROW, LAST_COLUMN = 1_048_576, 16_384  # bounds of the file format
MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
LINKS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"
NUMBER = re.compile(r"-?(0|[1-9]\d{0,14})(\.\d{1,15})?")
UNWRITABLE = re.compile("[\x00-\x08\x0b-\x1f￾￿]|_(?=x[0-9A-Fa-f]{4}_)")


def open_store(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder; s3a addresses are read as s3."""
    return fs.FileSystem.from_uri(re.sub("^s3[an]://", "s3://", path))


@dataclass
class Sheets(InputPartition):
    """Sheets that one task reads: (path of the file, sheet, part of the file)."""

    parts: list[tuple[str, str, str]]


class WorkbookReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.pattern = options.get("pathGlobFilter", "*.xlsx")
        self.sheets = options["sheets"].split("|") if "sheets" in options else None
        self.most = int(options.get("partitionBytes", 0))

    def partitions(self) -> list[Sheets]:
        store, folder = open_store(self.path)
        found = store.get_file_info(fs.FileSelector(folder, recursive=True))
        if not isinstance(found, list):
            found = [found]
        names = sorted(f.path for f in found if f.is_file and not f.base_name.startswith((".", "_", "~"))
                       and fnmatch.fnmatch(f.base_name, self.pattern))

        def listed(path: str) -> list[tuple[int, tuple[str, str, str]]]:
            with store.open_input_file(path) as file, zipfile.ZipFile(file) as book:
                return [(book.getinfo(part).file_size, (path, sheet, part)) for sheet, part in sheet_parts(book)
                        if self.sheets is None or sheet in self.sheets]

        groups: list[list] = []
        size = 0
        with ThreadPoolExecutor(16) as pool:
            for sheets in pool.map(listed, names):
                for n, part in sheets:
                    if not groups or size + n > self.most:
                        groups.append([])
                        size = 0
                    groups[-1].append(part)
                    size += n
        return [Sheets(g) for g in groups] or [Sheets([])]

    def read(self, partition: Sheets) -> Iterator[pa.RecordBatch]:
        store, _ = open_store(self.path)
        schema = pa.schema([(c, pa.int32() if c in ("row", "column") else pa.string()) for c in COLUMNS])
        by_book: dict[str, list] = {}
        for path, sheet, part in partition.parts:
            by_book.setdefault(path, []).append((sheet, part))

        def batch(name: str, sheet: str, cells: list[tuple]) -> pa.RecordBatch:
            row, column, raw, formula, code = map(list, zip(*cells))
            n = len(row)
            return pa.record_batch([pa.array(v, t) for v, t in zip(
                [[name] * n, [sheet] * n, row, column, raw, raw, formula, code], schema.types)], schema=schema)

        for path, sheets in by_book.items():
            name = posixpath.basename(path)
            with store.open_input_file(path) as file, zipfile.ZipFile(file) as book:
                shared, formats = shared_texts(book), number_formats(book)
                for sheet, part in sheets:
                    held: list[tuple] = []
                    for cell in sheet_cells(book, part, shared, formats):
                        held.append(cell)
                        if len(held) == BATCH:
                            yield batch(name, sheet, held)
                            held = []
                    if held:
                        yield batch(name, sheet, held)


def column_letters(number: int) -> str:
    letters = ""
    while number:
        number, rest = divmod(number - 1, 26)
        letters = chr(65 + rest) + letters
    return letters


def _written(text: str) -> str:
    return escape(UNWRITABLE.sub(lambda m: f"_x{ord(m.group()):04X}_", text))


class BookFile:
    """One workbook that is written front to back: sheets in the order of their cells."""

    def __init__(self, stream) -> None:
        self.stream, self.book = stream, zipfile.ZipFile(stream, "w", zipfile.ZIP_DEFLATED)
        self.names: list[str] = []
        self.sheet, self.at = None, (0, 0)

    def _end_sheet(self) -> None:
        if self.sheet is not None:
            self.sheet.write(b"</row></sheetData></worksheet>" if self.at[0] else b"</sheetData></worksheet>")
            self.sheet.close()

    def begin_sheet(self, name: str) -> None:
        if name in self.names:
            raise ValueError(f"cells of sheet {name} do not follow each other")
        self._end_sheet()
        self.names.append(name)
        self.sheet, self.at = self.book.open(f"xl/worksheets/sheet{len(self.names)}.xml", "w", force_zip64=True), (0, 0)
        self.sheet.write(f'<worksheet xmlns="{MAIN}"><sheetData>'.encode())

    def add(self, row: int, column: int, text: str | None, formula: str | None) -> None:
        if (row, column) <= self.at or not (1 <= row <= LAST_ROW and 1 <= column <= LAST_COLUMN):
            raise ValueError(f"cell {row}, {column} is repeated, out of order or outside the sheet")
        out = ""
        if row != self.at[0]:
            out = ("</row>" if self.at[0] else "") + f'<row r="{row}">'
        self.at = (row, column)
        place = f'r="{column_letters(column)}{row}"'
        rule = "" if formula is None else f"<f>{_written(formula)}</f>"
        if text is None:
            out += f"<c {place}>{rule}</c>"
        elif NUMBER.fullmatch(text):
            out += f"<c {place}>{rule}<v>{text}</v></c>"
        elif rule:
            out += f'<c {place} t="str">{rule}<v>{_written(text)}</v></c>'
        else:
            out += f'<c {place} t="inlineStr"><is><t xml:space="preserve">{_written(text)}</t></is></c>'
        self.sheet.write(out.encode("utf-8"))

    def end(self) -> None:
        self._end_sheet()
        numbers = range(1, len(self.names) + 1)
        sheets = "".join(f'<sheet name={quoteattr(n)} sheetId="{k}" r:id="r{k}"/>' for k, n in zip(numbers, self.names))
        rels = "".join(f'<Relationship Id="r{k}" Type="{LINKS}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in numbers)
        kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
        types = "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="{kind}.worksheet+xml"/>' for k in numbers)
        for name, body in {
            "xl/workbook.xml": f'<workbook xmlns="{MAIN}" xmlns:r="{LINKS}"><sheets>{sheets}</sheets></workbook>',
            "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{PACKAGE}/relationships">{rels}</Relationships>',
            "_rels/.rels": f'<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="r1" '
                           f'Type="{LINKS}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
            "[Content_Types].xml": f'<Types xmlns="{PACKAGE}/content-types"><Default Extension="rels" '
                                   'ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
                                   '<Default Extension="xml" ContentType="application/xml"/><Override '
                                   f'PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/>{types}</Types>',
        }.items():
            self.book.writestr(name, body)
        self.close()

    def close(self) -> None:
        self.book.close()
        self.stream.close()


@dataclass
class Written(WriterCommitMessage):
    """Files of one task: (name while writing, final name)."""

    files: list[tuple[str, str]]


class WorkbookWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool) -> None:
        self.path, self.overwrite = options["path"], overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, folder = open_store(self.path)
        store.create_dir(folder, recursive=True)
        files: list[tuple[str, str]] = []
        book, name, sheet = None, None, None
        try:
            for batch in iterator:
                columns = batch.to_pydict()
                formulas = columns.get("formula") or [None] * batch.num_rows
                for b, s, r, c, text, formula in zip(*(columns[k] for k in COLUMNS[:5]), formulas):
                    if b is None or s is None or r is None or c is None:
                        raise ValueError("a cell needs a workbook, a sheet, a row and a column")
                    if b != name:
                        if "/" in b or b.startswith((".", "_", "~")):
                            raise ValueError(f"not a file name: {b}")
                        if book is not None:
                            book.end()
                        final, now = f"{folder}/{b}", f"{folder}/.{uuid.uuid4().hex}"
                        files.append((now, final))
                        book, name, sheet = BookFile(store.open_output_stream(now)), b, None
                    if s != sheet:
                        book.begin_sheet(s)
                        sheet = s
                    book.add(r, c, text, formula)
            if book is not None:
                book.end()
        except BaseException:
            for now, _ in files:
                if store.get_file_info(now).type != fs.FileType.NotFound:
                    store.delete_file(now)
            raise
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        store, folder = open_store(self.path)
        files = [f for m in messages if m is not None for f in m.files]
        finals = [final for _, final in files]
        if len(set(finals)) < len(finals):
            self.abort(messages)
            raise ValueError("a workbook was written by two tasks: repartition by workbook")
        if self.overwrite:
            for info in store.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
                if info.is_file and info.extension == "xlsx" and not info.base_name.startswith("."):
                    store.delete_file(info.path)
        for now, final in files:
            store.move(now, final)

    def abort(self, messages: list[Written | None]) -> None:
        store, _ = open_store(self.path)
        for m in messages:
            for now, _ in m.files if m is not None else ():
                store.delete_file(now)


class WorkbookSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return CELL_SCHEMA

    def reader(self, schema) -> WorkbookReader:
        return WorkbookReader(self.options)

    def writer(self, schema, overwrite: bool) -> WorkbookWriter:
        return WorkbookWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format `workbook` known to the session."""
    spark.dataSource.register(WorkbookSource)


def write_workbooks(cells: DataFrame, path: str, mode: str = "append") -> None:
    """One file per workbook name. Cells without text and formula are left out; a repeated cell is an error."""
    register(cells.sparkSession)
    wanted = [c for c in COLUMNS if c in cells.columns and c not in ("raw_value", "number_format")]
    some = "text IS NOT NULL" + (" OR formula IS NOT NULL" if "formula" in wanted else "")
    place = cells.select(*wanted).where(some)
    for c in ("row", "column"):
        place = place.withColumn(c, place[c].cast("int"))
    place.repartition("workbook").sortWithinPartitions("workbook", "sheet", "row", "column") \
        .write.format("workbook").mode(mode).save(path)


def read_cells(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """The cell table of all workbooks below a folder, one partition per sheet."""
    register(spark)
    return spark.read.format("workbook").options(**options).load(path)
