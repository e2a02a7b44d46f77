"""Exact identity of texts by deterministic block naming (no Python on the executors).

A text is cut into blocks of fixed size. Distinct blocks are sorted and numbered; the number is the block's name.
Then adjacent names are paired and the distinct pairs numbered again, level by level, until each text has one name.
Two texts have the same name at the same level exactly if they are equal: at every level, names stand for distinct
contents, never for hashes of them.

The first level is the only one that moves text, and moves it once. Rows find their block's name by a 64-bit key; the
table of names knows how many distinct blocks stand behind each key, and where it is more than one, the rows
concerned are named by comparing the block itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelstats.llm.common import text_bytes
from panelstats.session import materialise

KEY = ["doc_id", "text_sha256"]


def _numbered(df: DataFrame, cols: list[str], name: str) -> DataFrame:
    """Rows in global order with increasing integers; written, so that the numbers are fixed once and for all."""
    return materialise(df.orderBy(*cols).withColumn("name", F.monotonically_increasing_id()), name)


def _name_blocks(blocks: DataFrame, key: Column) -> DataFrame:
    """(doc_id, text_sha256, n, i, name) of the blocks (…, block)."""
    keyed = blocks.withColumn("key", key)
    distinct = keyed.groupBy("key", "block").agg(F.count("*").alias("rows"))
    names = _numbered(distinct.groupBy("key").agg(F.count("*").alias("texts")), ["key"], "block-names")
    rows = keyed.drop("block").join(names, "key")
    named = rows.where("texts = 1").select(*KEY, "n", "i", F.lit(0).alias("part"), "name")
    if names.where("texts > 1").isEmpty():
        return named.drop("part")
    shared = names.where("texts > 1").select("key", F.col("name").alias("first"))
    mixed = keyed.join(shared, "key")
    apart = _numbered(mixed.groupBy("first", "block").agg(F.count("*").alias("rows")), ["first", "block"], "block-ties")
    ties = mixed.join(apart.select("first", "block", "name"), ["first", "block"])
    # numbers of the two tables are kept apart by doubling
    both = named.select(*KEY, "n", "i", (F.col("name") * 2).alias("name")).unionByName(
        ties.select(*KEY, "n", "i", (F.col("name") * 2 + 1).alias("name")))
    return both


def identities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 2048,
               block_key: Column | None = None) -> DataFrame:
    """One row per document: doc_id, text_sha256, n_bytes, level, name; equal texts have equal (level, name).

    A missing text counts as empty, an empty text is one empty block. A missing doc_id is an id of its own. Rows
    that repeat both id and text are one document; one id with two texts is two. `block_key` replaces the 64-bit key.
    """
    data = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_bytes(text_col).alias("b"))
    size = F.length("b")
    n = F.greatest(F.ceil(size / block_bytes), F.lit(1)).cast("long")
    cut = F.expr(f"transform(sequence(0L, n - 1), p -> substring(b, cast(p * {block_bytes} + 1 as int), {block_bytes}))")
    blocks = (
        data.select("doc_id", F.sha2("b", 256).alias("text_sha256"), n.alias("n"), "b")
        .select(*KEY, "n", F.posexplode(cut).alias("i", "block"))
        .withColumn("i", F.col("i").cast("long"))
    )
    rows = materialise(_name_blocks(blocks, F.xxhash64("block") if block_key is None else block_key), "names")
    longest = rows.agg(F.max("n")).first()[0] or 1
    level, done = 0, []
    while True:
        done.append(rows.where("n = 1").select(*KEY, F.lit(level).alias("level"), "name"))
        if longest == 1:
            break
        pairs = (
            rows.where("n > 1")
            .groupBy(*KEY, F.expr("(n + 1) div 2").alias("n"), F.expr("i div 2").alias("i"))
            .agg(F.max(F.when(F.expr("i % 2 = 0"), F.col("name"))).alias("left"),
                 F.coalesce(F.max(F.when(F.expr("i % 2 = 1"), F.col("name"))), F.lit(-1)).alias("right"))
        )
        pairs = materialise(pairs, "pairs")
        names = _numbered(pairs.groupBy("left", "right").agg(F.count("*").alias("rows")), ["left", "right"], "pair-names")
        rows = materialise(pairs.join(names, ["left", "right"]).select(*KEY, "n", "i", "name"), "names")
        longest, level = (longest + 1) // 2, level + 1
    found = done[0]
    for part in done[1:]:
        found = found.unionByName(part)
    return found.distinct()


def copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 2048,
           block_key: Column | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: of equal texts the largest doc_id stays.

    A missing doc_id sorts below all others; it stays only where no other id has the text.
    """
    ids = materialise(identities(docs, id_col, text_col, block_bytes, block_key), "identities")
    groups = ids.groupBy("level", "name").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    return ids.join(groups, ["level", "name"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )
