"""Quality rules against plain Python."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from panelstats.llm import divergence

WORD = re.compile(r"[^\x20\x09-\x0D]+")
CLASSES = [r"[A-Z]", r"[0-9]", r"[.,;:!?'\"()\-]", r"[#$%&*+/<=>@\[\\\]^_`{|}~]", r"[^\x00-\x7f]"]


def counted(text):
    words = WORD.findall(text)
    lines = [line for line in text.split("\n") if WORD.search(line)]
    triples = [tuple(words[k:k + 3]) for k in range(len(words) - 2)]
    often = Counter(triples)
    inside = {j for k, t in enumerate(triples) if often[t] > 1 for j in (k, k + 1, k + 2)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside))


def classes(text):
    found = [len(re.findall(c, text)) for c in CLASSES]
    return [*found, sum(map(len, WORD.findall(text))) - sum(found)]


def distance(p, q):
    h = lambda x: x * math.log2(x) if x > 0 else 0.0
    return math.sqrt(max(0.0, sum((h(a) + h(b)) / 2 - h((a + b) / 2) for a, b in zip(p, q))))


def expected(rows, guard_chars, guard_words, common=20):
    by_lang = {}
    for _, text, lang in rows:
        by_lang.setdefault(lang or "", []).append(text or "")
    out = []
    for number, text, lang in rows:
        text, others = text or "", by_lang[lang or ""]
        base = counted(text)
        n, size = base[:2]
        failed = n < 50 or 100 * base[4] > 50 * n
        all_words = Counter(w for t in others for w in WORD.findall(t))
        near = far = None
        if size >= guard_chars and all_words:
            total = [sum(c) for c in zip(*map(classes, others))]
            near = distance([c / size for c in classes(text)], [c / sum(total) for c in total])
        if n >= guard_words and all_words:
            best = sorted(all_words.items(), key=lambda x: (-x[1], x[0].encode()))[:common]
            own, mass = Counter(WORD.findall(text)), sum(all_words.values())
            p, q = [own[w] / n for w, _ in best], [c / mass for _, c in best]
            far = distance([*p, 1 - sum(p)], [*q, max(0.0, 1 - sum(q))])
        kept = not failed and not (near or 0) > 0.35 and not (far or 0) > 0.35
        out.append((number, *base, failed, near, far, kept))
    return sorted(out, key=lambda r: (repr(r[0]), r[1:6]))


def same(got, want):
    got = sorted((tuple(r) for r in got), key=lambda r: (repr(r[0]), r[1:6]))
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:7] == w[:7] and g[9] == w[9], (g, w)
        assert all((a is None) == (b is None) and (a is None or abs(a - b) < 2e-6) for a, b in zip(g[7:9], w[7:9])), (g, w)


@pytest.fixture(scope="module")
def rows(odd_docs):
    docs = odd_docs.withColumn("lang", F.when(F.col("doc_id") < 6, F.lit("fr")).when(F.col("doc_id") < 300, F.col("lang")))
    return docs, [(r["doc_id"], r["text"], r["lang"]) for r in docs.select("doc_id", "text", "lang").collect()]


def test_rules_equal_plain_python(rows):
    docs, plain = rows
    same(divergence.quality(docs).collect(), expected(plain, 200, 100))
    same(divergence.quality(docs, guard_chars=1, guard_words=1).collect(), expected(plain, 1, 1))


REPEATS = ["a b c a b c", "a b c d a b c", "a a a a a", "x y z", "x y", "", None, " lead a b\x0bc a b c \t", "one\n\none\n one\none #$%",
           "p q r s p q r t u v w p q r", ("w " * 30 + "\n") * 40, "😀 b c 😀 b c < > | é", "a bc a b c ab c a bc a",
           "Ab Cd-Ef 12 3.4 " * 40]


@pytest.mark.parametrize("key", [F.xxhash64, lambda *w: F.lit(7).cast("long"), lambda *w: F.length(w[0]).cast("long")])
def test_windows_of_equal_hash_are_compared(spark, key):
    texts = [(k, t, "en") for k, t in enumerate(REPEATS)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    found = divergence.references(docs)
    got = divergence.judge(docs, found, window_hash=key).collect()
    assert {r["doc_id"]: tuple(r)[1:6] for r in got} == {k: counted(t or "") for k, t, _ in texts}


def test_junk_goes_and_prose_stays(spark):
    prose = [(k, " ".join(f"{w}{(k * 7 + j * j) % 97}x" if j % 3 else "the" for j, w in enumerate(["house", "water", "with"] * 60)), "en") for k in range(30)]
    junk = [(100, "".join(f"{k}$#|* " for k in range(150)), "en"), (101, " ".join(f"cell{k * k}" for k in range(150)), "en")]
    got = {r["doc_id"]: r["kept"] for r in divergence.quality(spark.createDataFrame(prose + junk, "doc_id long, text string, lang string")).collect()}
    assert all(got[k] for k in range(30)) and not got[100]


def test_rules_without_documents(no_docs):
    assert divergence.quality(no_docs).count() == 0


def test_no_reference_no_distance(spark):
    docs = spark.createDataFrame([(1, "word " * 3 + " ".join(f"w{k}" for k in range(200)), "xx")], "doc_id long, text string, lang string")
    other = divergence.references(spark.createDataFrame([("a b", "en")], "text string, lang string"))
    row = divergence.judge(docs, other).first()
    assert row["class_distance"] is None and row["word_distance"] is None and row["kept"]
