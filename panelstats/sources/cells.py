"""Spreadsheet cell grids as one long table.

A cell is (workbook, sheet, row, column, text) with optional raw_value, formula
and number_format; positions start at 1.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelstats.functions.scalar import (
    capture_ci, cell_address, is_blank, matches_ci, parse_number, parse_serial_date,
)
from panelstats.operators.mapping import literal_table

SHEET = ["workbook", "sheet"]


def _value(cells: DataFrame) -> Column:
    return F.col("raw_value" if "raw_value" in cells.columns else "text")


def _row_text(pairs: Column, render) -> Column:
    return F.array_join(F.transform(F.array_sort(pairs), render), " | ")


def sheet_inventory(cells: DataFrame) -> DataFrame:
    """Per sheet: used rows, used columns, first-row headers joined by ' | '."""
    header = (F.col("row") == 1) & ~is_blank("text")
    pairs = F.collect_list(F.when(header, F.struct("column", "text")))
    return cells.groupBy(*SHEET).agg(
        F.max("row").cast("bigint").alias("used_rows"),
        F.max("column").cast("bigint").alias("used_columns"),
        _row_text(pairs, lambda p: p["text"]).alias("first_row_headers"),
    )


def head_cells(
    cells: DataFrame, max_row: int, max_col: int | None = None, sheets: Sequence[str] | None = None
) -> DataFrame:
    """Non-blank cells in the first rows and columns, with their address."""
    inside = F.col("row") <= max_row
    if max_col is not None:
        inside = inside & (F.col("column") <= max_col)
    if sheets is not None:
        inside = inside & F.col("sheet").isin(list(sheets))
    return cells.where(inside & ~is_blank("text")).withColumn("address", cell_address("row", "column"))


def scan_cells(cells: DataFrame, pattern: str, max_row: int | None = None) -> DataFrame:
    """Cells whose text matches the alternatives, ignoring case."""
    rows = cells if max_row is None else cells.where(F.col("row") <= max_row)
    return rows.where(matches_ci("text", pattern))


def scan_rows(cells: DataFrame, pattern: str) -> DataFrame:
    """Rows whose joined non-blank cells match: 'C1=a | C2=b'."""
    pairs = F.collect_list(F.struct("column", "text"))
    rows = cells.where(~is_blank("text")).groupBy(*SHEET, "row").agg(
        _row_text(pairs, lambda p: F.concat(F.lit("C"), p["column"].cast("string"), F.lit("="), p["text"])).alias("row_text")
    )
    return rows.where(matches_ci("row_text", pattern))


def resolve_alias(sheets: DataFrame, candidates: Sequence[str]) -> DataFrame:
    """Per workbook the first candidate sheet name it has; NULL when it has none."""
    place = F.array_position(F.array(*[F.lit(c) for c in candidates]), F.col("sheet"))
    hit = F.when(place > 0, place)
    return sheets.groupBy("workbook").agg(F.min_by("sheet", hit).alias("_s"), F.min(hit).alias("_p")).select(
        "workbook", F.when(F.col("_p").isNotNull(), F.col("_s")).alias("resolved")
    )


def label_summary(cells: DataFrame, by: Sequence[str], pattern: str, sep: str = " || ") -> DataFrame:
    """Per group: number and joined list of the distinct labels that match.

    The list is one text by definition; labels are made distinct before they are
    gathered, and a group is a sheet's header area.
    """
    labels = scan_cells(cells, pattern).select(*by, "text").dropDuplicates()
    return labels.groupBy(*by).agg(
        F.count("*").alias("n_matches"),
        F.array_join(F.array_sort(F.collect_list("text")), sep).alias("variables"),
    )


def map_positions(
    cells: DataFrame, source: Sequence[str], mapping: Sequence[tuple], variables: Sequence[str],
    first_row: int = 3,
) -> DataFrame:
    """Wide rows from cells whose column meaning differs by source.

    ``mapping`` holds (source values.., column, variable); a variable a source lacks is NULL, a column
    without a variable is left out, and a source that the mapping does not know aborts the query.
    """
    keys = [*source, "column"]
    table = literal_table(cells, mapping, keys, ["variable"])
    known = literal_table(cells, sorted({m[:len(source)] for m in mapping}), source, []).withColumn("_known", F.lit(True))
    body = cells.where((F.col("row") >= first_row) & ~is_blank(_value(cells))).join(known, list(source), "left")
    unknown = F.raise_error(F.concat(F.lit("no column mapping for source "), F.to_json(F.struct(*source))))
    named = body.where(F.coalesce("_known", unknown.cast("boolean"))).join(table, keys)
    return named.groupBy(*source, *[c for c in SHEET if c not in source], "row").pivot(
        "variable", list(variables)
    ).agg(F.first(_value(cells)))


def read_sheet(cells: DataFrame, sheet: str | None, header_row: int, positions: Mapping[str, int]) -> DataFrame:
    """Rows below the header with columns taken by position, not by name.

    One named sheet of every workbook, or all sheets.
    """
    body = cells.where(F.col("row") > header_row)
    if sheet is not None:
        body = body.where(F.col("sheet") == sheet)
    aggs = [F.first(F.when(F.col("column") == at, _value(cells)), ignorenulls=True).alias(name)
            for name, at in positions.items()]
    return body.groupBy(*SHEET, "row").agg(*aggs)


def discover_and_unpivot(
    cells: DataFrame,
    value_pattern: str,
    date_pattern: str = "^date$",
    prefix: str = "P",
    header_row: int = 2,
    expected_year: int | None = None,
    on_missing: str = "error",
) -> DataFrame:
    """Long readings from sheets whose value columns are found by their header text.

    The first header matching ``date_pattern`` gives the date; every header matching
    ``value_pattern`` is a sensor named by the pattern's group. Blank and non-numeric
    cells and rows without a date are left out. A sheet that has value columns but no
    date column aborts the query, or is skipped.
    """
    head = cells.where((F.col("row") == header_row) & ~is_blank("text")).withColumn("header", F.trim("text"))
    is_date, is_value = matches_ci("header", date_pattern), matches_ci("header", value_pattern)
    date_col = head.groupBy(*SHEET).agg(
        F.min(F.when(is_date, F.col("column"))).alias("date_column"), F.count_if(is_value).alias("n_values")
    ).where("n_values > 0")
    if on_missing == "error":
        message = F.concat_ws(" ", F.lit("no date column in"), "workbook", "sheet")
        date_col = date_col.withColumn(
            "date_column", F.coalesce("date_column", F.raise_error(message).cast("int"))
        )
    sensors = head.where(is_value).select(
        *SHEET, "column", "header", F.concat(F.lit(prefix), capture_ci("header", value_pattern)).alias("sensor")
    )
    body = cells.where(F.col("row") > header_row).select(*SHEET, "row", "column", _value(cells).alias("v"))
    dates = body.join(
        date_col.select(*SHEET, F.col("date_column").alias("column")), [*SHEET, "column"]
    ).select(*SHEET, "row", parse_serial_date("v", expected_year).alias("date")).where("date is not null")
    readings = body.join(sensors, [*SHEET, "column"]).withColumn("value", parse_number("v")).where("value is not null")
    return readings.join(dates, [*SHEET, "row"]).select(
        *SHEET, F.col("row").alias("source_row"), "date", "sensor", "value", F.col("header").alias("source_header")
    )
