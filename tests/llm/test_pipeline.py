"""The pipeline's stages against what their operators say, one after the other."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline  # noqa: E402
from panelstats.llm import jaccard, naming, repeats  # noqa: E402
from panelstats.session import materialise  # noqa: E402

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables not present")


def ids(df):
    return sorted((r["doc_id"] for r in df.select("doc_id").collect()), key=repr)


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = materialise(stage(spark, docs, DATA), "stage")
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        before, after = ids(docs), ids(out)
        assert set(after) <= set(before) and len(after) == len(set(after))
        if name == "language ID":
            assert len(after) >= 0.97 * len(before)
        elif name == "exact dedup":
            assert after == ids(naming.copies(docs).where("kept"))
        elif name == "n-gram Jaccard join":
            assert after == ids(jaccard.near_copies(docs).where("doc_id = class_id"))
        else:
            cut = {r["doc_id"]: r for r in repeats.remove_repeats(docs).collect()}
            texts = {r["doc_id"]: r["text"] for r in out.select("doc_id", "text").collect()}
            assert sum(r["n_removed"] > 0 for r in cut.values()) > 0
            for number, text in texts.items():
                r = cut[number]
                assert r["n_bytes"] - r["n_removed"] <= len(text.encode()) <= r["n_bytes"] - r["n_removed"] + 6 * r["n_spans"]
        docs = out
    pieces = corpus_pipeline.STAGES[4][1](spark, docs, DATA)
    assert {r["doc_id"] for r in pieces.select("doc_id").distinct().collect()} == set(ids(docs))


def test_odd_documents(odd_docs, spark):
    docs = odd_docs
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = materialise(stage(spark, docs, DATA), "stage")
        assert docs.columns == odd_docs.columns
    left = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    assert 0 not in left and 201 in left and 500 not in left and 501 not in left
    assert corpus_pipeline.STAGES[4][1](spark, docs, DATA).count() > 0


def test_repeated_rows_and_ids(spark):
    prose = lambda word, n: " ".join(f"{word}{k * k % 97}x{k}" for k in range(n))
    one, two = prose("some", 60), prose("other", 60)
    rows = [(1, one, "en", "a", 0)] * 3 + [(1, one, "en", "b", 0)]  # a repeated row, and once from another source
    rows += [(2, prose("more", 60) + " end", "en", "a", 0), (3, prose("more", 60) + " fin", "en", "a", 0)]  # near copies
    rows += [(2, two, "en", "a", 0), (2, two + " too", "en", "a", 0)]  # the same id: near copies of each other
    rows += [(3, prose("last", 60), "en", "a", 0), (None, prose("none", 60), "en", "a", 0), (None, prose("none", 60), "en", "a", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    _, exact, near, cut = (stage for _, stage in corpus_pipeline.STAGES[:4])
    # repeats left in: each row gives one row
    assert cut(spark, docs, DATA).count() == len(rows)
    once = materialise(exact(spark, docs, DATA), "stage")
    got = [tuple(r) for r in once.collect()]
    assert sorted(got, key=repr) == sorted(set(rows) - {(1, one, "en", "b", 0)}, key=repr)
    left = materialise(near(spark, once, DATA), "stage").collect()
    # of id 3 only the text that is no near copy; of id 2 one of the two alike
    assert sorted((r["doc_id"] or 0, r["text"][:4]) for r in left) == [(0, "none"), (1, "some"), (2, "more"), (2, "othe"), (3, "last")]
    assert cut(spark, spark.createDataFrame(left, docs.schema), DATA).count() == 5


def test_nothing(no_docs, spark):
    docs = no_docs
    for _, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, DATA), "stage")
    assert docs.count() == 0


def test_run(spark):
    assert corpus_pipeline.run(spark, DATA).count() > 0
