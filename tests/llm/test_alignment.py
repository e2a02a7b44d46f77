"""Alignment of two tokenizers against their libraries and plain Python."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from panelstats.llm import alignment

tokenizers = pytest.importorskip("tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")


@pytest.fixture(scope="module")
def files(file):
    return file("byte_bpe_50k.json"), file("piece_bpe_32k.model")


def expected(texts, files):
    a_model = tokenizers.Tokenizer.from_file(files[0])
    a_model.encode_special_tokens = True
    b_model = sentencepiece.SentencePieceProcessor(model_file=files[1])
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
    a_bytes = lambda i: bytes(back[c] for c in a_model.id_to_token(i))
    b_bytes = lambda i: (bytes([int(b_model.id_to_piece(i)[3:5], 16)]) if b_model.is_byte(i)
                         else b_model.id_to_piece(i).replace("▁", " ").encode())
    per_text = []
    for text in texts:
        a = a_model.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_model.encode(text) if text else []
        raw = (" " + text).encode() if text else b""
        left, right = [a_bytes(i) for i in a], [b_bytes(i) for i in b]
        if not text or b"".join(left) != raw or b"".join(right) != raw:
            per_text.append(None)
            continue
        common = np.intersect1d(np.cumsum([*map(len, left)]), np.cumsum([*map(len, right)]))
        groups, ends = [([], []) for _ in common], ([*np.cumsum([*map(len, left)])], [*np.cumsum([*map(len, right)])])
        for side, ids in enumerate((a, b)):
            for i, e in zip(ids, ends[side]):
                groups[int(np.searchsorted(common, e))][side].append(i)
        per_text.append((a, b, groups))
    count = Counter(pair for t in per_text if t for pair in {(x, y) for ga, gb in t[2] for x in ga for y in gb})
    highest = defaultdict(int)
    for (x, _), n in count.items():
        highest[x] = max(highest[x], n)
    out = []
    for t in per_text:
        if t is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        links = [(x, y) for ga, gb in t[2] for x in ga for y in gb]
        written = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in t[2])
        out.append((len(t[0]), len(t[1]), len(t[2]), len(links), sum(count[p] == highest[p[0]] for p in links),
                    sum(count[p] for p in links), hashlib.sha256(written.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("chunk", [alignment.CHUNK_CHARS, 300])
def test_alignment_equals_the_libraries(odd_docs, files, chunk):
    rows = [(r["doc_id"], r["text"] or "") for r in odd_docs.select("doc_id", "text").collect()]
    want = sorted(((i, *w) for (i, _), w in zip(rows, expected([t for _, t in rows], files))), key=repr)
    got = alignment.align(odd_docs, *files, chunk_chars=chunk).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()
    assert sorted((tuple(r) for r in got), key=repr) == want


def test_messy_texts(spark, files):
    rng = random.Random(11)
    units = [*"ab's 'tre  \n\t.!1234éÊß日本  ½Ⅷ😀vl", "<|endoftext|>", "'ll", " the", "hello", "▁", "<s>", "<0x41>", "\x00", "　", "한글"]
    texts = ["".join(rng.choice(units) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    texts += ["日本語" * 400, "é" * 3000, " " * 700 + "x", "\n" * 500, "ab" * 4000, "▁", "1234567890" * 90]
    big = (1 << 60) + 1  # ids beyond what a float holds, next to a missing one
    frame = spark.createDataFrame([(big + k, t) for k, t in enumerate(texts)] + [(None, "x")], "doc_id long, text string").repartition(3)
    want = {big + k: w for k, w in enumerate(expected([*texts, "x"], files)[:-1])}
    got = {r["doc_id"]: tuple(r)[1:] for r in alignment.align(frame, *files).collect() if r["doc_id"] is not None}
    assert got == want


def test_galloping():
    rng = np.random.default_rng(5)
    for short, long in ((0, 5), (5, 0), (1, 1), (40, 4000), (300, 300), (3000, 5000), (7, 100_000)):
        for stretch in (1, 3, 64):
            a = np.unique(rng.integers(0, 2 * long + 2, short))
            b = np.unique(rng.integers(0, 2 * long + 2, long))
            i, j = alignment.gallop(a, b, stretch)
            assert (a[i] == b[j]).all() and a[i].tolist() == np.intersect1d(a, b).tolist()


def test_links_travel_whole():
    rng = np.random.default_rng(6)
    for top in (1, 255, 256, 70_000):
        codes, times = rng.permutation(200_000)[:500], rng.integers(1, top + 1, 500)
        order = np.argsort(codes)
        got = alignment.unpacked(*alignment.packed(codes, times))
        assert got[0].tolist() == codes[order].tolist() and got[1].tolist() == times[order].tolist()
    assert [len(x) for x in alignment.unpacked(*alignment.packed(np.zeros(0, np.int64), np.zeros(0, np.int64)))] == [0, 0]


def test_nothing_to_align(no_docs, files):
    assert alignment.align(no_docs, *files).count() == 0
