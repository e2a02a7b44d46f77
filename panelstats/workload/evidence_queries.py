"""Evidence registers built from documents and labels; integrity of a file manifest."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelstats.functions.scalar import classify, equals_ci, matches_ci, normal_algorithm, split_checksum, switch
from panelstats.operators import evidence, joins
from panelstats.sources import files
from panelstats.workload.common import Query, shape, shaped, table

FOUND = ["dir_quality", "dir_toxic", "dir_size"]


def register(spark, folder):
    """One study per document; documents without a label have missing directions."""
    d = table(spark, folder, "documents").select("doc_id", "lang", "source", "n_chars")
    both = d.join(table(spark, folder, "labels"), "doc_id", "left")
    return both.select(
        F.col("doc_id").alias("study_id"),
        F.when(F.col("source").isin("src0", "src1", "src2"), "A1")
        .when(F.col("source").isin("src3", "src4"), "A2").otherwise("C").alias("tier"),
        F.when(F.col("doc_id") % 5 == 0, "no").when(F.col("doc_id") % 2 == 0, "YES").otherwise("yes").alias("direct"),
        F.when(F.col("lang") == "es", "northern ITALY").when(F.col("lang") == "fr", "Italian site")
        .otherwise(F.col("lang")).alias("location"),
        F.when(F.col("quality") == 1, "decrease").when(F.col("quality") == 0, "not_primary").alias("dir_quality"),
        F.when(F.col("toxic") == 1, "increase").when(F.col("toxic") == 0, "no_clear_increase").alias("dir_toxic"),
        F.when(F.col("n_chars") > 5000, "decrease").when(F.col("n_chars") > 2000, "usually_decrease")
        .when(F.col("n_chars") > 500, "increase").otherwise("not_measured").alias("dir_size"),
        "n_chars",
    )


def flagged(spark, folder):
    return evidence.add_flags(register(spark, folder), {
        "is_direct": equals_ci("direct", "yes"),
        "is_italian": matches_ci("location", "italy|italian"),
        "is_local": F.col("tier").isin("A1", "A2"),
        "is_global": F.col("tier") == "C",
    })


FLAGS = ["is_direct", "is_italian", "is_local", "is_global"]


def run_inventory(spark, folder):
    return shape(evidence.inventory(flagged(spark, folder), FLAGS))


def run_directional(spark, folder):
    return shape(evidence.directional_counts(flagged(spark, folder), {
        "all_direct": F.col("is_direct"),
        "local_direct": F.col("is_direct") & F.col("is_local"),
        "global_direct": F.col("is_direct") & F.col("is_global"),
    }, FOUND))


UNKNOWN = ["not_measured", "not_primary"]


def claims():
    """Rules differ per claim: the last one sends every other label to not_applicable."""
    q, t, s = (F.col(c) for c in FOUND)
    return {
        "lowers_quality": classify(
            [(q == "decrease", "support"), (q.isin(UNKNOWN), "not_applicable")], "mixed_or_no_support"),
        "raises_toxicity": classify(
            [(t == "increase", "support"), (t == "no_clear_increase", "qualified"),
             (t.isin(UNKNOWN), "not_applicable")], "mixed_or_no_support"),
        "lowers_size": classify(
            [(s.isin("decrease", "usually_decrease"), "support"), (s == "increase", "counterexample")], "not_applicable"),
        "constant": F.lit("no_support"),
    }


def _matrix(spark, folder):
    return evidence.claim_matrix(register(spark, folder), ["study_id", "tier"], claims())


def run_matrix(spark, folder):
    return shape(_matrix(spark, folder))


def run_claim_summary(spark, folder):
    return shape(evidence.claim_summary(_matrix(spark, folder)))


def run_local(spark, folder):
    cols = ["study_id", "location", "tier", *FOUND, "n_chars"]
    return shape(evidence.local_evidence(flagged(spark, folder), F.col("is_direct") & F.col("is_local"), cols))


# ---- integrity --------------------------------------------------------------------

def _manifest(spark, folder):
    """Expected sizes count characters, so texts with wide letters disagree with their bytes."""
    d = table(spark, folder, "documents")
    raw = F.encode("text", "utf-8")
    kind = (F.when(F.col("lang") == "en", "md5").when(F.col("lang") == "de", "SHA-1")
            .when(F.col("lang") == "fr", "sha256").otherwise("CRC32"))
    value = (F.when(F.col("doc_id") % 7 == 0, F.upper(F.md5(raw)))
             .when(F.col("lang") == "de", F.upper(F.sha1(raw))).when(F.col("lang") == "fr", F.sha2(raw, 256))
             .otherwise(F.md5(raw)))
    return d.select(
        F.concat(F.lit("doc_"), F.col("doc_id")).alias("filename"), F.col("n_chars").alias("size_bytes"),
        kind.alias("checksum_type"), value.alias("checksum_value"),
    )


def _landed(spark, folder):
    """Files that arrived: the labelled documents."""
    d = table(spark, folder, "documents").join(table(spark, folder, "labels").select("doc_id"), "doc_id", "left_semi")
    raw = d.select(F.concat(F.lit("doc_"), F.col("doc_id")).alias("filename"), F.encode("text", "utf-8").alias("content"))
    return files.with_hashes(raw.withColumn("n", F.length("content")), "content", "n")


def _verified(spark, folder):
    return files.verify_manifest(_manifest(spark, folder), _landed(spark, folder))


def run_integrity(spark, folder):
    return shape(_verified(spark, folder).select("filename", "size_bytes", "actual_size", "checksum_type", "status"))


def run_integrity_rules(spark, folder):
    return shape(files.integrity_rules(_verified(spark, folder)))


def run_checksum_split(spark, folder):
    d = table(spark, folder, "documents")
    text = F.when(F.col("doc_id") % 4 == 0, F.md5("text")).otherwise(F.concat(F.lit("md5:"), F.md5("text")))
    kind, value = split_checksum("c")
    return shape(d.select("doc_id", text.alias("c")).select(
        "doc_id", kind.alias("checksum_type"), value.alias("checksum_value")))


def run_algorithms(spark, folder):
    m = _manifest(spark, folder)
    return shape(m.groupBy("checksum_type", normal_algorithm("checksum_type").alias("algorithm")).agg(F.count("*").alias("n")))


def run_switch(spark, folder):
    o = table(spark, folder, "orders")
    place = switch("o_orderstatus", {"F": "finished", "O": "open", "P": "partial"})
    return shape(o.groupBy(place.alias("folder")).agg(F.count("*").alias("n")))


def run_enrich(spark, folder):
    """Unlabelled documents stay, with empty fields and their source as title."""
    base = table(spark, folder, "documents").select("doc_id", "source")
    detail = table(spark, folder, "labels").select(
        "doc_id", F.concat(F.lit("quality "), "quality").alias("title"), F.col("toxic").cast("string").alias("toxic"))
    return shape(joins.enrich_left(base, detail, "doc_id", ["title", "toxic"], {"title": "source"}))


_REGISTER = """
reg AS (
  SELECT d.doc_id AS study_id, n_chars,
    CASE WHEN source IN ('src0', 'src1', 'src2') THEN 'A1' WHEN source IN ('src3', 'src4') THEN 'A2' ELSE 'C' END AS tier,
    CASE WHEN d.doc_id % 5 = 0 THEN 'no' WHEN d.doc_id % 2 = 0 THEN 'YES' ELSE 'yes' END AS direct,
    CASE lang WHEN 'es' THEN 'northern ITALY' WHEN 'fr' THEN 'Italian site' ELSE lang END AS location,
    CASE quality WHEN 1 THEN 'decrease' WHEN 0 THEN 'not_primary' END AS dir_quality,
    CASE toxic WHEN 1 THEN 'increase' WHEN 0 THEN 'no_clear_increase' END AS dir_toxic,
    CASE WHEN n_chars > 5000 THEN 'decrease' WHEN n_chars > 2000 THEN 'usually_decrease'
         WHEN n_chars > 500 THEN 'increase' ELSE 'not_measured' END AS dir_size
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id),
flagged AS (
  SELECT *, lower(direct) = 'yes' AS is_direct, regexp_matches(location, 'italy|italian', 'i') AS is_italian,
    tier IN ('A1', 'A2') AS is_local, tier = 'C' AS is_global FROM reg),
claims AS (
  SELECT study_id, tier, 'lowers_quality' AS claim, CASE WHEN dir_quality = 'decrease' THEN 'support'
    WHEN dir_quality IN ('not_measured', 'not_primary') THEN 'not_applicable' ELSE 'mixed_or_no_support' END AS support FROM reg
  UNION ALL SELECT study_id, tier, 'raises_toxicity', CASE WHEN dir_toxic = 'increase' THEN 'support'
    WHEN dir_toxic = 'no_clear_increase' THEN 'qualified' WHEN dir_toxic IN ('not_measured', 'not_primary')
    THEN 'not_applicable' ELSE 'mixed_or_no_support' END FROM reg
  UNION ALL SELECT study_id, tier, 'lowers_size', CASE WHEN dir_size IN ('decrease', 'usually_decrease') THEN 'support'
    WHEN dir_size = 'increase' THEN 'counterexample' ELSE 'not_applicable' END FROM reg
  UNION ALL SELECT study_id, tier, 'constant', 'no_support' FROM reg)"""
_SUBSETS = {"all_direct": "is_direct", "local_direct": "is_direct AND is_local", "global_direct": "is_direct AND is_global"}
_VERDICT = """
m AS (
  SELECT 'doc_' || doc_id AS filename, n_chars AS size_bytes, strlen(text) AS bytes, doc_id,
    CASE lang WHEN 'en' THEN 'md5' WHEN 'de' THEN 'SHA-1' WHEN 'fr' THEN 'sha256' ELSE 'CRC32' END AS checksum_type,
    CASE WHEN doc_id % 7 = 0 THEN upper(md5(text)) WHEN lang = 'de' THEN upper(sha1(text))
         WHEN lang = 'fr' THEN sha256(text) ELSE md5(text) END AS checksum_value,
    CASE lang WHEN 'en' THEN md5(text) WHEN 'de' THEN sha1(text) WHEN 'fr' THEN sha256(text) END AS actual,
    doc_id IN (SELECT doc_id FROM labels) AS landed
  FROM documents),
v AS (
  SELECT filename, size_bytes, CASE WHEN landed THEN bytes END AS actual_size, checksum_type,
    CASE WHEN NOT landed THEN 'missing' WHEN size_bytes <> bytes THEN 'size_mismatch'
         WHEN checksum_type = 'CRC32' THEN 'unsupported_algorithm'
         WHEN lower(checksum_value) <> actual THEN 'hash_mismatch' ELSE 'match' END AS status FROM m)"""

QUERIES = {
    "evidence_inventory": Query(run_inventory, f"WITH {_REGISTER} SELECT 'total' AS metric, count(*) AS value FROM flagged "
        + " ".join(f"UNION ALL SELECT '{f}', count(*) FILTER ({f}) FROM flagged" for f in FLAGS)),
    "directional_counts": Query(run_directional, f"WITH {_REGISTER} " + " UNION ALL ".join(
        f"SELECT '{s}' AS evidence_subset, '{o}' AS outcome, coalesce({o}, 'missing') AS direction, count(*) AS n_studies "
        f"FROM flagged WHERE {c} GROUP BY coalesce({o}, 'missing')" for s, c in _SUBSETS.items() for o in FOUND)),
    "claim_matrix": Query(run_matrix, f"WITH {_REGISTER} SELECT * FROM claims"),
    "claim_summary": Query(run_claim_summary,
        f"WITH {_REGISTER} SELECT claim, support, count(*) AS n_studies FROM claims GROUP BY 1, 2"),
    "local_subset": Query(run_local, f"""WITH {_REGISTER} SELECT study_id, location, tier, dir_quality, dir_toxic, dir_size,
        n_chars FROM flagged WHERE is_direct AND is_local"""),
    "manifest_integrity": Query(run_integrity, f"WITH {_VERDICT} SELECT * FROM v"),
    "manifest_rules": Query(run_integrity_rules, f"WITH {_VERDICT} SELECT rule, failed, failed = 0 AS passed FROM ("
        + " UNION ALL ".join(f"SELECT '{r}' AS rule, count(*) FILTER (status = '{r}') AS failed FROM v"
                             for r in ("missing", "size_mismatch", "hash_mismatch")) + ")"),
    "checksum_split": Query(run_checksum_split, """SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN '' ELSE 'md5' END AS checksum_type,
        CASE WHEN doc_id % 4 = 0 THEN '' ELSE md5(text) END AS checksum_value FROM documents"""),
    "algorithm_names": Query(run_algorithms, f"""WITH {_VERDICT} SELECT checksum_type,
        CASE checksum_type WHEN 'md5' THEN 'MD5' WHEN 'SHA-1' THEN 'SHA1' WHEN 'sha256' THEN 'SHA256' END AS algorithm,
        count(*) AS n FROM m GROUP BY 1, 2"""),
    "enum_switch": Query(run_switch, """SELECT CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open'
        WHEN 'P' THEN 'partial' END AS folder, count(*) AS n FROM orders GROUP BY 1"""),
    "enrich_left": Query(run_enrich, """SELECT d.doc_id, source, CASE WHEN quality IS NULL THEN source
        ELSE 'quality ' || quality END AS title, coalesce(CAST(toxic AS VARCHAR), '') AS toxic
        FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id"""),
}
