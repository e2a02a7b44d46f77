"""Delimited tables in, tables out; strict and lenient casts; rounded reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelstats.functions.scalar import nan_to_null


def read_table(
    spark: SparkSession, path: str | list[str], schema: T.StructType | str, multiline: bool = False
) -> DataFrame:
    """Headed CSV with a declared schema. A leading byte-order mark is ignored; quoted
    fields may hold doubled quotes and, with ``multiline``, line breaks."""
    reader = (
        spark.read.schema(schema).option("header", True).option("escape", '"')
        .option("multiLine", multiline).option("enforceSchema", False)
    )
    df = reader.csv(path)
    doubles = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.select(*[nan_to_null(c).alias(c) if c in doubles else F.col(c) for c in df.columns])


def read_text_table(spark: SparkSession, path: str, columns: Sequence[str], multiline: bool = False) -> DataFrame:
    """Every column as text, to be cast at use."""
    return read_table(spark, path, T.StructType([T.StructField(c, T.StringType()) for c in columns]), multiline)


def cast_strict(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Cast; a value that does not parse aborts the query (whatever the session's ANSI mode)."""
    out = df
    for c, t in types.items():
        parsed = F.col(c).try_cast(t)
        message = F.concat(F.lit(f"{c}: cannot read as {t}: "), F.col(c).cast("string"))
        checked = F.when(F.col(c).isNotNull() & parsed.isNull(), F.raise_error(message).cast(t)).otherwise(parsed)
        out = out.withColumn(c, checked)
    return out


def cast_coerce(df: DataFrame, cols: Sequence[str], to: str = "double") -> DataFrame:
    """Cast; a value that does not parse becomes missing, and so does NaN."""
    out = df
    for c in cols:
        parsed = F.col(c).try_cast(to)
        out = out.withColumn(c, nan_to_null(parsed) if to in ("double", "float") else parsed)
    return out


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = ()) -> None:
    """Result table as Parquet, or as headed CSV for exchange."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer.option("header", True).option("escape", '"').csv(path)
    else:
        writer.format(fmt).save(path)


def land_json(df: DataFrame, path: str) -> None:
    """Raw payload kept for provenance, one JSON document per line."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path)


def select_rename(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """The listed columns under their publication names."""
    return df.select(*[F.col(old).alias(new) for old, new in names.items()])


def where_present(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows in which all the columns hold a value."""
    return df.dropna(subset=list(cols))


def report(df: DataFrame, cols: Sequence[str] | None = None, digits: int | Mapping[str, int] = 3) -> DataFrame:
    """Selected columns with the numeric ones rounded."""
    chosen = list(cols or df.columns)

    def shown(c: str):
        places = digits.get(c) if isinstance(digits, Mapping) else digits
        real = isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType))
        return F.round(c, places).alias(c) if real and places is not None else F.col(c)

    return df.select(*[shown(c) for c in chosen])
