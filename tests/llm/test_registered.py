"""Registered queries of the subpackage: against their SQL where there is one, else rows and columns."""

import os

import pytest

from panelstats.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables not present")

# fixed values: the columns that the results must have
COLUMNS = {
    "op1_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    "op2_repeats": "doc_id n_bytes n_removed n_spans kept_sha256",
    "op5_topk": "query_id rank vec_id score",
    "op6_warc": "page_id payload_bytes payload_digest record_type refers_to",
    "op8_token_counts": "doc_id n_bytes n_tokens over_limit",
    "op9_exact_dedup": "doc_id keep_id group_size kept text_sha256",
    "op11_alignment": "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256",
    "op12_quality_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op13_hard_negatives": "anchor_id positive_id rank negative_id positive_score negative_score",
    "op10_license_scan": "doc_id n_words n_base first_word last_word base_labels labels score",
}


def test_numbers():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    duckdb = pytest.importorskip("duckdb")
    df = QUERIES[name].run(spark, DATA)
    assert set(COLUMNS.get(name, "").split()) <= set(df.columns)
    rows = df.collect()
    assert rows
    if QUERIES[name].sql:
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
        cursor = con.execute(QUERIES[name].sql)
        cols = [d[0] for d in cursor.description]
        assert sorted(cols) == sorted(df.columns)
        assert sorted((tuple(r[c] for c in cols) for r in rows), key=repr) == sorted(map(tuple, cursor.fetchall()), key=repr)
