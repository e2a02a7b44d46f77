"""Files found by pattern, dimensions taken from their names, and integrity checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelstats.functions.scalar import col, leaf_name, normal_algorithm


def scan_glob(spark: SparkSession, paths: Sequence[str], pattern: str) -> DataFrame:
    """(path, file_name, size_bytes) of matching files in several folders; contents not read."""
    return (
        spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(list(paths))
        .select("path", leaf_name("path").alias("file_name"), F.col("length").alias("size_bytes"))
    )


def dims_from_name(name: str | Column, tokens: Mapping[str, str]) -> Column:
    """Label of the first token the name contains; NULL when it contains none."""
    chain = None
    for token, label in tokens.items():
        hit = col(name).contains(token)
        chain = F.when(hit, label) if chain is None else chain.when(hit, label)
    return chain


def with_dims(df: DataFrame, name: str, dims: Mapping[str, Mapping[str, str]]) -> DataFrame:
    """Adds each dimension and drops files from which one cannot be derived."""
    out = df.select("*", *[dims_from_name(name, tokens).alias(d) for d, tokens in dims.items()])
    return out.dropna(subset=list(dims))


def file_facts(spark: SparkSession, paths: Sequence[str], pattern: str = "*") -> DataFrame:
    """Actual size and hashes of files, computed where the bytes are read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(list(paths))
    return with_hashes(files.select(leaf_name("path").alias("filename"), "length", "content"), "content", "length")


def with_hashes(df: DataFrame, content: str, size: str) -> DataFrame:
    return df.select(
        "filename",
        F.col(size).cast("bigint").alias("actual_size"),
        F.md5(content).alias("actual_MD5"),
        F.sha1(content).alias("actual_SHA1"),
        F.sha2(content, 256).alias("actual_SHA256"),
    )


def verify_manifest(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Manifest rows with the verdict: missing, size_mismatch, unsupported_algorithm,
    hash_mismatch or match. Hashes compare without case; a check without an expected
    value is passed."""
    algorithm = normal_algorithm("checksum_type")
    joined = manifest.withColumn("algorithm", algorithm).join(files, "filename", "left")
    actual = F.when(F.col("algorithm") == "MD5", F.col("actual_MD5")).when(
        F.col("algorithm") == "SHA1", F.col("actual_SHA1")
    ).when(F.col("algorithm") == "SHA256", F.col("actual_SHA256"))
    expected = F.coalesce(F.col("checksum_value"), F.lit(""))
    status = (
        F.when(F.col("actual_size").isNull(), "missing")
        .when(F.col("size_bytes").isNotNull() & (F.col("size_bytes") != F.col("actual_size")), "size_mismatch")
        .when(expected == "", "match")
        .when(F.col("algorithm").isNull(), "unsupported_algorithm")
        .when(F.lower(expected) != F.lower(actual), "hash_mismatch")
        .otherwise("match")
    )
    return joined.select(
        *manifest.columns, "actual_size", actual.alias("actual_hash"), status.alias("status"),
        (F.lower(expected) == F.lower(actual)).alias("checksum_match"),
    )


def integrity_report(verified: DataFrame) -> DataFrame:
    """The verdicts with the day of verification, for keeping."""
    return verified.withColumn("verified_date", F.date_format(F.current_date(), "yyyy-MM-dd"))


def integrity_rules(verified: DataFrame) -> DataFrame:
    """(rule, failed, passed) of the verdicts that must abort an import."""
    rules = ["missing", "size_mismatch", "hash_mismatch"]
    one = verified.agg(*[F.count_if(F.col("status") == r).alias(r) for r in rules])
    long = one.unpivot([], rules, "rule", "failed")
    return long.withColumn("passed", F.col("failed") == 0)
