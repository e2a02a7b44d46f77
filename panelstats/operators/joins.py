"""Key-checked joins, restriction to key sets, aligned groups and spines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def restrict_to_keys(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose key is listed. A semi join never multiplies rows."""
    return df.join(keys.select(*on), list(on), "left_semi")


def unique_or_fail(df: DataFrame, on: Sequence[str], side: str) -> DataFrame:
    """One row per key; a repeated key aborts the query when it runs."""
    others = [c for c in df.columns if c not in on]
    message = F.concat_ws(" ", F.lit(f"repeated key on the {side} side:"), *[F.col(c).cast("string") for c in on])
    checked = df.groupBy(*on).agg(
        F.count("*").alias("_n"), *[F.first(c).alias(c) for c in others]
    )
    guard = F.when(F.col("_n") > 1, F.raise_error(message).cast("boolean")).otherwise(True)
    return checked.where(guard).drop("_n")


def merge_checked(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    validate: str = "one_to_one",
) -> DataFrame:
    """Equi join with the cardinality contract enforced on the plan itself."""
    if validate in ("one_to_one", "one_to_many"):
        left = unique_or_fail(left, on, "left")
    if validate in ("one_to_one", "many_to_one"):
        right = unique_or_fail(right, on, "right")
    return left.join(right, list(on), how)


def align(a: DataFrame, b: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows of two sources that share the key."""
    return a.join(b, list(on), "inner")


def with_spine(
    spark: SparkSession,
    df: DataFrame,
    period: str,
    lo: int,
    hi: int,
    counts: Sequence[str] = (),
    labels: Sequence[str] = (),
) -> DataFrame:
    """Every period of the fixed range; absent ones get 0 counts and empty lists."""
    spine = spark.range(lo, hi + 1, numPartitions=1).select(F.col("id").cast("int").alias(period))
    joined = spine.join(df.withColumn(period, F.col(period).cast("int")), period, "left")
    return joined.fillna(0, subset=list(counts)).fillna("", subset=list(labels))


def cross_axis(df: DataFrame, name: str, values: Sequence) -> DataFrame:
    """Each row once per parameter value, without a cross join."""
    return df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """Append tables by column name; absent columns become NULL."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def distinct_rows(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(*cols).dropDuplicates()


def enrich_left(
    base: DataFrame, detail: DataFrame, on: str, blanks: Sequence[str], fallback: dict[str, str] | None = None
) -> DataFrame:
    """Keep every base row; a row without detail gets empty text, or a base column's value."""
    fallback = fallback or {}
    kept = base.join(detail, on, "left")
    for name in blanks:
        other = F.col(fallback[name]) if name in fallback else F.lit("")
        kept = kept.withColumn(name, F.coalesce(F.col(name).cast("string"), other.cast("string"), F.lit("")))
    return kept
