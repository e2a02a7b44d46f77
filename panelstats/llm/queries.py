"""The registered queries of the training-data operators and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelstats.llm import alignment, counts, divergence, jaccard, langid, licenses, naming, negatives, packing, pieces, repeats, topk, warc
from panelstats.llm.common import Query, table


SEQUENCE = 1024  # tokens


def vocabulary_file(name: str) -> str:
    """Where the named public vocabulary lies on this machine."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def base32_sql(digest: str) -> str:
    """SQL for the base-32 form of a hex SHA-1: eight digits for every ten of hex."""
    parts = []
    for block in range(4):
        number = f"('0x' || substr({digest}, {10 * block + 1}, 10))::BIGINT"
        parts += [f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (({number} >> {35 - 5 * k}) & 31)::INT + 1, 1)" for k in range(8)]
    return " || ".join(parts)


def op1_packing(spark, folder):
    return packing.pack_documents(table(spark, folder, "documents"), vocabulary_file("byte_bpe_50k.json"),
                                  end_id=0, most_tokens=SEQUENCE)


def op2_repeats(spark, folder):
    return repeats.remove_repeats(table(spark, folder, "documents"), least=50)


def op3_language_id(spark, folder):
    model = langid.fit(table(spark, folder, "documents"), "doc_id", "text", "lang")
    found = langid.identify(table(spark, folder, "pages"), model, "page_id", "html", url_col="url", has_markup=True)
    return found.withColumnRenamed("id", "page_id").drop("row_key")


def op4_near_copies(spark, folder):
    return jaccard.near_copies(table(spark, folder, "documents"))


def op5_topk(spark, folder):
    return topk.search(table(spark, folder, "embeddings"), "vec_id % 20 = 0", 20)


OP5_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q, v c WHERE q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 20
"""


def op6_warc(spark, folder):
    return warc.round_trip(table(spark, folder, "pages")).drop("url")


OP6_SQL = """
SELECT page_id, strlen(html) AS payload_bytes, {base32} AS payload_digest,
  CASE WHEN page_id = holder THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> holder THEN holder END AS refers_to
FROM (SELECT *, max(page_id) OVER (PARTITION BY html) AS holder, sha1(html) AS h
      FROM (SELECT page_id, coalesce(html, '') AS html FROM pages))
"""


def op7_sentencepiece(spark, folder):
    return pieces.encode(table(spark, folder, "documents"), vocabulary_file("piece_bpe_32k.model"))


def op8_token_counts(spark, folder):
    stored = counts.store(table(spark, folder, "documents"), vocabulary_file("byte_bpe_50k.json"))
    return counts.answer(stored, [SEQUENCE]).drop("limit")


def op9_exact_dedup(spark, folder):
    return naming.copies(table(spark, folder, "documents"))


OP9_SQL = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
"""


def op10_license_scan(spark, folder):
    return licenses.scan(table(spark, folder, "documents"))


def op10_sql() -> str:
    """Every line against every template, and every word place against every phrase."""
    word = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
    lowered = f"translate(coalesce(text, ''), '{licenses.UPPER}', '{licenses.LOWER}')"
    templates = ", ".join(
        f"({k}, '{label}', ['{(chr(39) + ', ' + chr(39)).join(sorted(set(text.split())))}'])"
        for k, (label, text) in enumerate(licenses.TEMPLATES))
    starts = " UNION ALL ".join(
        f"SELECT doc_id, i - 1 AS pos, '{label}' AS label FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM words) "
        f"WHERE w[i] = '{p.split()[0]}' AND list_slice(w, i, i + {len(p.split()) - 1}) = ['{(chr(39) + ', ' + chr(39)).join(p.split())}']"
        for p, label in licenses.PHRASES.items())
    return f"""
WITH words AS (SELECT doc_id, regexp_extract_all({lowered}, {word}) AS w FROM documents),
places AS ({starts}),
lines AS (SELECT doc_id, list_distinct(regexp_extract_all(unnest(string_split({lowered}, chr(10))), {word})) AS w FROM documents),
templates(k, label, t) AS (VALUES {templates}),
matched AS (
  SELECT doc_id, label, len(list_intersect(t, w)) / len(t) AS part
  FROM lines, templates WHERE len(list_intersect(t, w)) >= ceil(0.8 * len(t) - 1e-9)),
base AS (SELECT doc_id, count(*) AS n, min(pos) AS lo, max(pos) AS hi FROM places GROUP BY 1),
best AS (SELECT doc_id, max(part) AS part FROM matched GROUP BY 1),
base_names AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS s FROM (SELECT DISTINCT doc_id, label FROM places) GROUP BY 1),
all_names AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS s FROM (
  SELECT doc_id, label FROM places UNION SELECT doc_id, label FROM matched) GROUP BY 1)
SELECT words.doc_id, len(w) AS n_words, coalesce(base.n, 0) AS n_base, lo AS first_word, hi AS last_word,
  coalesce(base_names.s, '') AS base_labels, coalesce(all_names.s, '') AS labels,
  CASE WHEN base.n > 0 THEN 1.0 ELSE coalesce(part, 0.0) END::DOUBLE AS score
FROM words LEFT JOIN base USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN base_names USING (doc_id)
  LEFT JOIN all_names USING (doc_id)
"""


def op11_alignment(spark, folder):
    return alignment.align(table(spark, folder, "documents"), vocabulary_file("byte_bpe_50k.json"), vocabulary_file("piece_bpe_32k.model"))


def op12_quality_rules(spark, folder):
    return divergence.quality(table(spark, folder, "documents"))


def op12_sql() -> str:
    """Windows and common words as rows; distances from lists of shares."""
    word = r"'[^\x20\x09-\x0D]+'"
    quoted = [chars.replace("'", "''") for chars in divergence.CLASSES.values()]
    counted = lambda col: [f"len(regexp_replace({col}, '[^{chars}]+', '', 'g'))" for chars in quoted]
    of_text = ", ".join(f"{c} AS c{k}" for k, c in enumerate(counted("text")))
    sums = ", ".join(f"sum(n * {c}) AS c{k}" for k, c in enumerate(counted("word")))
    rest = " - ".join(["{0}", *(f"c{k}" for k in range(len(quoted)))])
    shares = lambda total: "[" + ", ".join([*(f"c{k} / {total}" for k in range(len(quoted))), f"({rest.format(total)}) / {total}"]) + "]"
    part = "CASE WHEN {0} > 0 THEN {0} * log2({0}) ELSE 0 END"
    distance = ("round(sqrt(greatest(0, list_sum(list_transform(list_zip({0}, {1}), lambda z: "
                f"({part.format('z[1]')} + {part.format('z[2]')}) / 2 - {part.format('((z[1] + z[2]) / 2)')})))), 6)")
    return f"""
WITH t AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), {word}) AS w FROM documents),
each AS MATERIALIZED (SELECT r, lang, generate_subscripts(w, 1) AS i, unnest(w) AS word FROM t),
words AS (SELECT lang, word, count(*) AS n FROM each GROUP BY 1, 2),
totals AS (SELECT lang, sum(n) AS all_words, sum(n * len(word)) AS size, {sums} FROM words GROUP BY 1),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS place FROM words) WHERE place <= 20),
refs AS (SELECT lang, {shares('size')} AS classes FROM totals),
word_refs AS (SELECT lang, list(n / all_words ORDER BY place) AS shares FROM best JOIN totals USING (lang) GROUP BY 1),
windows AS (SELECT r, k, w[k] || ' ' || w[k + 1] || ' ' || w[k + 2] AS v FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS k FROM t)),
twice AS (SELECT r, k FROM (SELECT *, count(*) OVER (PARTITION BY r, v) AS n FROM windows) WHERE n > 1),
repeated AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest([k, k + 1, k + 2]) AS j FROM twice) GROUP BY 1),
own AS (
  SELECT r, list(coalesce(n, 0) ORDER BY place) AS counts
  FROM (SELECT r, place, word FROM t JOIN best USING (lang)) LEFT JOIN (SELECT r, word, count(*) AS n FROM each GROUP BY 1, 2) USING (r, word)
  GROUP BY 1),
measured AS (
  SELECT r, doc_id, lang, len(w) AS n_words, len(array_to_string(w, '')) AS word_chars,
    len(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
    list_filter(string_split(text, chr(10)), lambda line: regexp_matches(line, {word})) AS lines, {of_text} FROM t),
judged AS (
  SELECT doc_id, n_words, word_chars, n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    coalesce(repeated.n, 0) AS n_repeat_words,
    CASE WHEN word_chars >= 200 THEN {distance.format(shares('word_chars'), 'refs.classes')} END AS class_distance,
    CASE WHEN n_words >= 100 THEN {distance.format(
        "list_append(list_transform(counts, lambda c: c / n_words), (n_words - list_sum(counts)) / n_words)",
        "list_append(shares, greatest(0, 1 - list_sum(shares)))")} END AS word_distance
  FROM measured LEFT JOIN repeated USING (r) LEFT JOIN own USING (r) LEFT JOIN refs USING (lang) LEFT JOIN word_refs USING (lang))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR coalesce(class_distance > 0.35, false) OR coalesce(word_distance > 0.35, false)) AS kept
FROM judged
"""


def op13_hard_negatives(spark, folder):
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(table(spark, folder, "embeddings"), "vec_id % 100 = 0", moved)


OP13_SQL = """
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS MATERIALIZED (
  SELECT a.r, a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_inner_product(a.v, c.v)::BIGINT AS score
  FROM v a, v c WHERE a.vec_id % 100 = 0 AND a.r <> c.r),
positives AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS nth FROM scored WHERE same) WHERE nth <= 5),
ranked AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
    row_number() OVER (PARTITION BY p.r, p.nth ORDER BY n.score DESC, n.vec_id) AS rank
  FROM positives p JOIN scored n ON p.r = n.r AND NOT n.same AND 100 * n.score BETWEEN 80 * p.score AND 100 * p.score)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 5
"""


QUERIES = {
    "op1_packing": Query(op1_packing),
    "op2_repeats": Query(op2_repeats),
    "op3_language_id": Query(op3_language_id),
    "op4_near_copies": Query(op4_near_copies),
    "op5_topk": Query(op5_topk, OP5_SQL),
    "op6_warc": Query(op6_warc, OP6_SQL.format(base32=base32_sql("h"))),
    "op7_sentencepiece": Query(op7_sentencepiece),
    "op8_token_counts": Query(op8_token_counts),
    "op9_exact_dedup": Query(op9_exact_dedup, OP9_SQL),
    "op10_license_scan": Query(op10_license_scan, op10_sql()),
    "op11_alignment": Query(op11_alignment),
    "op12_quality_rules": Query(op12_quality_rules, op12_sql()),
    "op13_hard_negatives": Query(op13_hard_negatives, OP13_SQL),
}
