"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LOWEST = -(1 << 63)  # stands for a missing id where an integer is needed


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def whole_text(col: str = "text") -> Column:
    """The text, with a missing one as empty."""
    return F.coalesce(F.col(f"`{col}`").cast("string"), F.lit(""))


def text_bytes(col: str = "text") -> Column:
    """UTF-8 bytes of the text; no conversion takes place."""
    return whole_text(col).cast("binary")


def documents_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns an operator works on, under fixed names, so that others cannot clash."""
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
