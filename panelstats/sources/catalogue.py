"""Landed catalogue and record JSON: flattening, field extraction, file lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelstats.functions.scalar import split_checksum

# ``value`` is text, object or list in the source; declared as text, a nested value
# comes back as its compact JSON
RECORD_SCHEMA = (
    "status string, data struct<latestVersion: struct<versionNumber: int, versionMinorNumber: int, "
    "versionState: string, releaseTime: string, termsOfUse: string, metadataBlocks: struct<citation: struct<fields: "
    "array<struct<typeName: string, value: string>>>>, files: array<struct<description: string, "
    "directoryLabel: string, restricted: boolean, dataFile: struct<id: bigint, filename: string, "
    "contentType: string, filesize: bigint, checksum: struct<type: string, value: string>>>>>>"
)
CATALOGUE_SCHEMA = (
    "status string, data struct<items: array<struct<name: string, global_id: string, url: string, "
    "published_at: string, description: string, authors: array<string>, subjects: array<string>, type: string>>>"
)
DEPOSIT_SCHEMA = (
    "id string, metadata struct<title: string>, "
    "files array<struct<key: string, size: bigint, checksum: string>>"
)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Whole-document JSON files with their name; a broken file stays as an empty record."""
    text = spark.read.text(path, wholetext=True)
    parsed = text.select(F.col("_metadata.file_name").alias("file_name"), F.from_json("value", schema).alias("r"))
    return parsed.select("file_name", "r.*")


def require_status(df: DataFrame, payload: str = "data", status: str = "status", ok: str = "OK") -> DataFrame:
    """Abort when the payload of a response that reports anything but success is read."""
    message = F.concat(F.lit("response status: "), F.coalesce(F.col(status), F.lit("NULL")))
    checked = F.when(F.col(status) == ok, F.col(payload)).otherwise(F.raise_error(message).cast(df.schema[payload].dataType))
    return df.withColumn(payload, checked)


def flatten_catalogue(df: DataFrame) -> DataFrame:
    """One row per dataset, list fields joined by '; ', in date order."""
    item = require_status(df).select(F.explode("data.items").alias("i"))
    return item.select(
        F.col("i.name").alias("dataset_title"),
        F.col("i.global_id").alias("persistent_id"),
        F.col("i.url").alias("url"),
        F.col("i.published_at").alias("publication_date"),
        F.col("i.description").alias("description"),
        F.array_join("i.authors", "; ").alias("authors"),
        F.array_join("i.subjects", "; ").alias("subjects"),
        F.col("i.type").alias("type"),
    ).orderBy("publication_date")


def eav_field(fields: str | Column, name: str) -> Column:
    """Value of the first entry with the type name; an absent field is empty text."""
    entries = F.col(fields) if isinstance(fields, str) else fields
    found = F.filter(entries, lambda f: f["typeName"] == name)
    return F.coalesce(F.get(found, F.lit(0))["value"], F.lit(""))


def record_fields(df: DataFrame, keep: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Chosen metadata fields of each record plus version and number of files."""
    latest = "data.latestVersion"
    fields = f"{latest}.metadataBlocks.citation.fields"
    version = F.concat_ws(".", F.col(f"{latest}.versionNumber").cast("string"), F.col(f"{latest}.versionMinorNumber").cast("string"))
    return df.select(
        *keep,
        *[eav_field(fields, n).alias(n) for n in names],
        version.alias("version"),
        F.coalesce(F.size(f"{latest}.files"), F.lit(0)).alias("file_count"),
    )


def field_values(
    df: DataFrame, keep: Sequence[str], body: str, path: str = "$.data.latestVersion.metadataBlocks.citation.fields"
) -> DataFrame:
    """The metadata fields of records that are kept as JSON text, one row per field: its position, name, kind and values.

    kind is that of the JSON value itself (text, list, object, number, boolean or null), so a text that looks like a list
    stays a text. values: the elements of a list, else the value alone; objects are compact JSON, a null has none. A
    record without fields, a missing one and one that is not JSON have no rows; a field without a name keeps its row.
    """
    entries = F.try_variant_get(F.try_parse_json(F.col(body)), path, "array<variant>")
    each = df.select(*keep, F.posexplode(entries).alias("position", "_field"))
    value = F.try_variant_get("_field", "$.value", "variant")
    named = each.select(*keep, "position", F.try_variant_get("_field", "$.typeName", "string").alias("field"), value.alias("_value"))
    kind = F.coalesce(F.regexp_extract(F.schema_of_variant("_value"), "^[A-Z]+", 0), F.lit("VOID"))
    known = F.when(kind == "STRING", "text").when(kind == "ARRAY", "list").when(kind == "OBJECT", "object") \
        .when(kind == "BOOLEAN", "boolean").when(kind == "VOID", "null").otherwise("number")
    alone = F.array(F.try_variant_get("_value", "$", "string"))
    values = F.when(known == "list", F.try_variant_get("_value", "$", "array<string>")).when(known == "null", F.array().cast("array<string>"))
    return named.select(*keep, "position", "field", known.alias("kind"), values.otherwise(alone).alias("values"))


def explode_files(df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """One row per file of a record, carrying the record's columns."""
    f = df.select(*keep, F.explode("data.latestVersion.files").alias("f"))
    return f.select(
        *keep,
        F.col("f.dataFile.id").alias("file_id"),
        F.col("f.dataFile.filename").alias("filename"),
        F.col("f.dataFile.contentType").alias("content_type"),
        F.col("f.dataFile.filesize").alias("size_bytes"),
        F.col("f.dataFile.checksum.type").alias("checksum_type"),
        F.col("f.dataFile.checksum.value").alias("checksum_value"),
        F.col("f.description").alias("description"),
        F.col("f.directoryLabel").alias("directory_label"),
        F.col("f.restricted").alias("restricted"),
    )


def deposit_files(df: DataFrame) -> DataFrame:
    """File list of a deposit record whose checksum is written 'algo:hex'."""
    f = df.select(F.col("id").alias("record_id"), F.explode("files").alias("f"))
    kind, value = split_checksum("f.checksum")
    return f.select(
        "record_id", F.col("f.key").alias("filename"), F.col("f.size").alias("size_bytes"),
        kind.alias("checksum_type"), value.alias("checksum_value"),
    )
