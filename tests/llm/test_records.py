"""Language, search and archives against plain Python."""

import base64
import hashlib
import math
import random

import numpy as np
import pytest

from panelstats.llm import langid, topk, warc
from panelstats.session import new_folder

LANGS = {"en": ["the", "and", "of", "with", "house", "water", "thing"], "fr": ["le", "une", "des", "avec", "maison", "eau", "chose"],
         "de": ["der", "und", "ein", "mit", "haus", "wasser", "ding"]}


def sentences(rng, lang, words):
    return " ".join(rng.choice(LANGS[lang]) for _ in range(words))


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(2)
    rows = [(k, sentences(rng, lang, 30), lang) for k, lang in enumerate(list(LANGS) * 30)]
    return spark.createDataFrame([*rows, (None, "x", None), (999, None, "en")], "doc_id long, text string, lang string")


@pytest.fixture(scope="module")
def model(labelled):
    return langid.fit(labelled, "doc_id", "text", "lang")


@pytest.fixture(scope="module")
def pages(spark):
    rng = random.Random(3)
    rows = []
    for k in range(40):
        lang = list(LANGS)[k % 3]
        rows.append((k, f"http://{lang}.site.example.{lang}/{k}", f'<html lang="{lang}"><script>the of and</script><p>{sentences(rng, lang, 12)}</p>', "x"))
    rows += [(50, "http://fr.site.example.fr/a", "<p>zz</p>", "x"), (51, None, None, None), (52, "http://fr.site.example.fr/b", "", "x"),
             (53, "not an address", '<html lang="xx-YY"><p>der ding</p>', "x"), (54, "http://de.site.example.de", "12345 #### 9999 $$$$ 0000", "x"),
             (None, None, "<p>the house and the water</p>", "x"), (0, rows[0][1], rows[0][2], "x")]
    return spark.createDataFrame(rows, "page_id long, url string, html string, scores string")


def fused(rows, model, temper=0.1, strength=5.0):
    """The same evidence, row by row."""
    langs, n = model["langs"], len(model["langs"])
    seen = []
    for number, url, html in rows:
        text = html or ""
        got = langid.DECLARED.search(text)
        text = langid.markup.unescape(langid.HIDDEN.sub(" ", text))
        scores = np.zeros(n)
        if text and not text.isspace():
            scores = temper * model["logs"][langid.trigrams(text)].sum(axis=0, dtype=np.float64)
        soft = np.exp(scores - scores.max())
        seen.append((number, langid._place(url), got[1].lower() if got else None, scores, soft / soft.sum()))
    out = []
    for number, place, declared, scores, soft in seen:
        total = lambda keep: np.maximum(sum((s for _, p, d, _, s in seen if keep(p, d)), np.zeros(n)) - soft, 0)
        prior = np.full(n, 1 / n)
        for keep, weight in ((lambda p, d: True, 1.0), (lambda p, d: p[2] == place[2], strength), (lambda p, d: p[1] == place[1], strength),
                             (lambda p, d: p[0] == place[0], strength)):
            c = total(keep)
            prior = (c + weight * prior) / (c.sum() + weight)
        logs = scores + np.log(prior)
        if declared is not None:
            values = len({d for _, _, d, _, _ in seen if d is not None}) + 1
            logs = logs + np.log((total(lambda p, d: d == declared) + 1) / (total(lambda p, d: d is not None) + values))
        post = np.exp(logs - logs.max())
        out.append((number, langs[int(np.argmax(logs))], 1 / post.sum()))
    return out


def test_evidence_is_fused(pages, model):
    rows = [(r["page_id"], r["url"], r["html"]) for r in pages.collect()]
    want = sorted(fused(rows, model), key=repr)
    found = langid.identify(pages, model, "page_id", "html", url_col="url", has_markup=True).collect()
    got = sorted(((r["id"], r["lang"], r["posterior"]) for r in found), key=repr)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert all(math.isclose(g[2], w[2], rel_tol=1e-6) for g, w in zip(got, want))
    by = {r["id"]: r for r in found}
    assert all(by[k]["lang"] == list(LANGS)[k % 3] and by[k]["accepted"] for k in range(40))
    assert by[50]["lang"] == "fr"  # two letters of text, but a French place
    assert not by[51]["accepted"] and not by[52]["accepted"]


def test_held_out_accuracy(spark, model):
    rng = random.Random(9)
    rows = [(k, sentences(rng, lang, 8), lang) for k, lang in enumerate(list(LANGS) * 20)]
    found = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), model, "doc_id", "text").collect()
    truth = {k: lang for k, _, lang in rows}
    assert sum(r["lang"] == truth[r["id"]] for r in found) >= 0.95 * len(rows)


def test_rare_languages_have_a_model(spark):
    rng = random.Random(5)
    rows = [(k, sentences(rng, "en" if k % 2 else "fr", 12), "en" if k % 2 else "fr") for k in range(1996)]
    rows += [(5000 + k, sentences(rng, "de", 12), "de") for k in range(4)]  # 0.2 %
    rows += [(7, "zum beispiel", "xx")] * 50  # one text, repeated
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for size in (100, 4000):
        model = langid.fit(table, "doc_id", "text", "lang", sample_rows=size)
        assert model["langs"] == ["de", "en", "fr", "xx", langid.UNKNOWN]
        docs = spark.createDataFrame([(k, sentences(rng, "de", 30)) for k in range(20)], "doc_id long, text string")
        found = langid.identify(docs, model, "doc_id", "text").collect()
        assert all(r["lang"] == "de" and r["accepted"] for r in found)


def test_no_pages(spark, model, no_docs):
    assert langid.identify(no_docs, model, "doc_id", "text", host_col="source").count() == 0


def test_search_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(int(k), [float(x) for x in rng.normal(size=12)], "x") for k in range(300)]
    rows += [(k + 300, rows[k][1], "x") for k in range(40)]  # ties
    rows += [(400, None, "x"), (401, [float("nan")] * 12, "x"), (402, [1.0, None] * 6, "x"), (403, [float("inf")] * 12, "x"),
             (404, [], "x"), (None, rows[0][1], "x"), (420, [1.0, 2.0], "x"), (7, rows[7][1], "x"), (440, [3e9] * 12, "x")]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, v string")
    got = {}
    for r in topk.search(frame, "vec_id % 20 = 0", 9, query_rows=6, candidate_rows=50, levels=(2, 5)).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    usable = {i: [math.floor(64 * x) for x in v] for i, v, _ in rows
              if i is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    want = {}
    for q in (i for i in usable if i % 20 == 0):
        scored = sorted((-sum(a * b for a, b in zip(usable[q], v)), i) for i, v in usable.items() if i != q and len(v) == len(usable[q]))
        if scored:
            want[q] = [(k + 1, i, -s) for k, (s, i) in enumerate(scored[:9])]
    assert {q: sorted(v) for q, v in got.items()} == want


def test_bounds_are_above_products():
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(50, 10)), rng.normal(size=(60, 10))
    last = None
    for segments in (1, 2, 5, 10):
        bound = topk.statistics(a, segments) @ topk.statistics(b, segments).T
        assert (bound >= a @ b.T - 1e-9).all()
        last = bound
    assert np.allclose(last, a @ b.T)  # one component a segment


def test_search_in_nothing(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.search(empty, "vec_id % 20 = 0", 3).count() == 0


@pytest.fixture(scope="module")
def raw_pages(spark):
    rows = [(1, "http://a/\n1", "<p>one</p>", "x"), (2, None, "<p>one</p>", "x"), (3, "u", None, "x"), (4, "u", "", "x"),
            (5, "u", "ü" * 50_000, "x"), (6, "u", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n", "x"), (None, "u", "<p>one</p>", "x"),
            (None, None, "alone", None), (7, "u", "again", "x"), (7, "u", "again", "x")]
    return spark.createDataFrame(rows, "page_id long, url string, html string, digest string")


def expected(rows, least):
    out = []
    for number, html in rows:
        raw = (html or "").encode()
        holder = max((i for i, h in rows if (h or "") == (html or "") and i is not None), default=None)
        again = holder is not None and holder != number and len(raw) >= least
        out.append((number, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response",
                    holder if again else None))
    return sorted(out, key=repr)


def test_round_trip(raw_pages):
    rows = [(r["page_id"], r["html"]) for r in raw_pages.collect()]
    for least in (0, 10):
        got = warc.round_trip(raw_pages, least_bytes=least).drop("url").collect()
        assert sorted((tuple(r) for r in got), key=repr) == expected(rows, least)


def test_look_up_and_payloads(raw_pages, spark):
    index = warc.write_bundles(raw_pages, new_folder(spark, "warc"), frame_bytes=500, bundle_bytes=600)
    assert index.count() == 10
    whole = {r["page_id"]: r["payload"] for r in warc.read_bundles(index).collect()}
    assert whole[5] == "ü" * 50_000 and whole[4] == "" and whole[1] is None
    found = warc.look_up(index, spark.createDataFrame([(5,), (2,), (77,)], "page_id long")).collect()
    assert {r["page_id"]: r["payload"] for r in found} == {5: "ü" * 50_000, 2: "<p>one</p>"}


def test_frames_are_read_side_by_side(raw_pages, spark):
    index = warc.write_bundles(raw_pages.coalesce(1), new_folder(spark, "warc"), frame_bytes=1)  # a frame for each record
    assert index.select("bundle").distinct().count() == 1 and index.agg({"frame": "max"}).first()[0] > warc.STRETCH
    for size in (1 << 30, 20_000):
        frame = warc.read_bundles(index, task_bytes=size)
        assert frame.rdd.getNumPartitions() == (1 if size > 1 << 20 else 1 + index.agg({"length": "sum"}).first()[0] // size)
        assert sorted(r["page_id"] or -1 for r in frame.collect()) == sorted(r["page_id"] or -1 for r in raw_pages.collect())


def test_bundles_are_plain_zstandard(raw_pages, spark):
    import io

    import zstandard
    from pyarrow import fs

    index = warc.write_bundles(raw_pages, new_folder(spark, "warc"), frame_bytes=100)
    for r in index.select("bundle").distinct().collect():
        store, path = fs.FileSystem.from_uri(r["bundle"])
        raw = store.open_input_file(path).read()
        with zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw), read_across_frames=True) as reader:
            assert reader.read().startswith(b"WARC/1.1\r\n")


def test_no_archives(spark):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.round_trip(empty).count() == 0
