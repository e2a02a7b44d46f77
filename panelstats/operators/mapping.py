"""Lookups of categories and ranges for keys, with parameter tables from the caller."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def literal_table(df: DataFrame, rows: Sequence[tuple], like: Sequence[str], extra: Sequence[str]) -> DataFrame:
    """Parameter rows as a table whose key columns take the types they have in ``df``."""
    fields = [T.StructField(c, df.schema[c].dataType) for c in like]
    fields += [T.StructField(c, T.StringType()) for c in extra]
    return df.sparkSession.createDataFrame(list(rows), T.StructType(fields))


def lookup(df: DataFrame, keys: Sequence[str], mapping: Mapping[tuple, Mapping[str, Sequence]], name: str) -> DataFrame:
    """Category by list membership: ``mapping[key prefix][category] = values of the last key``.

    Unmatched rows get NULL.
    """
    rows = [
        (*prefix, value, category)
        for prefix, groups in mapping.items()
        for category, values in groups.items()
        for value in values
    ]
    return df.join(literal_table(df, rows, keys, [name]), list(keys), "left")


def range_lookup(
    df: DataFrame, keys: Sequence[str], value: str, rules: Sequence[tuple], name: str
) -> DataFrame:
    """First rule that fits gives the label; NULL otherwise.

    A rule is (key prefix, low, high, label), bounds inclusive; a prefix or bound of
    None fits everything, which expresses a fallback for all other values.
    """
    chain = None
    for prefix, low, high, label in rules:
        hit = F.lit(True)
        for key, want in zip(keys, prefix or ()):
            if want is not None:
                hit = hit & (F.col(key) == want)
        if low is not None:
            hit = hit & (F.col(value) >= low)
        if high is not None:
            hit = hit & (F.col(value) <= high)
        chain = F.when(hit, F.lit(label)) if chain is None else chain.when(hit, F.lit(label))
    return df.withColumn(name, chain)


def unresolved(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows in which at least one assignment is missing."""
    gap = F.lit(False)
    for c in cols:
        gap = gap | F.col(c).isNull()
    return df.where(gap)
