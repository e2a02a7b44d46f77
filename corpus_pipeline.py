"""A training corpus in five stages: language, exact copies, near copies, repeats, packing.

Each stage takes all documents its predecessor kept and returns documents with the columns of the table `documents`;
the last returns token pieces with their places in sequences. Results are written as Parquet and read again in between.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelstats.llm import jaccard, langid, naming, packing, repeats
from panelstats.llm.common import LOWEST, whole_text
from panelstats.llm.queries import SEQUENCE, vocabulary_file
from panelstats.session import materialise

REPEAT_BYTES = 50


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known from text and source; blank ones and those in no known language go."""
    model = langid.fit(docs, "doc_id", "text", "lang")
    found = langid.identify(docs, model, "doc_id", "text", host_col="source")
    kept = found.where("accepted").select(F.col("id").alias("doc_id"), "row_key").distinct()
    return _keep(docs, kept)


def _keep(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of the documents whose (doc_id, row_key) is kept."""
    keyed = docs.withColumn("row_key", F.xxhash64(whole_text()))
    match = [keyed["doc_id"].eqNullSafe(kept["doc_id"]), keyed["row_key"] == kept["row_key"]]
    return keyed.join(kept, match, "left_semi").select(docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts the one with the largest id stays, and of its repeated rows the smallest."""
    key = ["id", "no_id", "sha"]
    # a missing id is an id of its own
    numbered = [F.coalesce("doc_id", F.lit(0)).alias("id"), F.isnull("doc_id").alias("no_id")]
    kept = naming.copies(docs).where("kept").select(*numbered, F.col("text_sha256").alias("sha")).distinct()
    keyed = docs.select(*numbered, F.sha2(whole_text().cast("binary"), 256).alias("sha"), F.struct(*docs.columns).alias("row"))
    return keyed.join(kept, key, "left_semi").groupBy(*key).agg(F.min("row").alias("row")).select("row.*")


def one_of_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies (five-word shingles, similarity 0.8 or more) the document with the smallest id stays.

    Of several texts of that id which are near copies of each other, the one with the smallest hash stays.
    """
    classes = jaccard.near_copies(docs, tell_texts=True)
    return _keep(docs, classes.where("kept").select("doc_id", "row_key"))


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has are cut out; a document of which only white space is left goes."""
    cut = repeats.remove_repeats(docs, least=REPEAT_BYTES, keep_text=True)
    cut = cut.where((F.col("n_removed") == 0) | (F.trim(F.regexp_replace("text", r"\s+", " ")) != "")).select(
        F.coalesce("doc_id", F.lit(LOWEST)).alias("cut_id"), F.col("row_key").alias("cut_key"), F.col("text").alias("cut_text"))
    cut = cut.dropDuplicates(["cut_id", "cut_key"])  # repeated rows have the same text left
    rest = docs.withColumn("cut_key", F.xxhash64(whole_text())).withColumn("cut_id", F.coalesce("doc_id", F.lit(LOWEST)))
    out = rest.drop("text").join(cut, ["cut_id", "cut_key"]).withColumn("text", F.col("cut_text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents, packed into sequences."""
    return packing.pack_documents(docs, vocabulary_file("byte_bpe_50k.json"), end_id=0, most_tokens=SEQUENCE)


STAGES = [
    ("language ID", known_language),
    ("exact dedup", one_of_each),
    ("n-gram Jaccard join", one_of_near),
    ("suffix-array dedup", without_repeats),
    ("packing", packed),
]

ORACLE_SQL = None  # SQL has neither the trigram models nor the byte-level vocabulary


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table `documents`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number + 1 < len(STAGES):
            docs = materialise(docs, "stage")
    return docs
