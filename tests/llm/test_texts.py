"""Identity, licences, repeats and near copies against plain Python on odd inputs."""

import hashlib
import re

import numpy as np
from pyspark.sql import functions as F

from panelstats.llm import jaccard, licenses, naming, repeats
from panelstats.llm.components import components


def whole(docs):
    return [(r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()]


def copies(docs):
    groups = {}
    for number, text in set(whole(docs)):
        groups.setdefault(text, []).append(number)
    out = set()
    for text, ids in groups.items():
        keep = max(ids, key=lambda i: (i is not None, i or 0))
        sha = hashlib.sha256(text.encode()).hexdigest()
        out |= {(i, keep, len(ids), i == keep, sha) for i in ids}
    return out


def test_copies(odd_docs):
    want = copies(odd_docs)
    got = [tuple(r) for r in naming.copies(odd_docs).collect()]
    assert len(got) == len(want) and set(got) == want


def test_copies_when_block_keys_collide(odd_docs):
    # all blocks of one size share a key, so names must come from the blocks themselves
    got = naming.copies(odd_docs, block_bytes=64, block_key=F.length("block").cast("long"))
    assert {tuple(r) for r in got.collect()} == copies(odd_docs)


def test_copies_of_nothing(no_docs):
    assert naming.copies(no_docs).count() == 0


def scanned(text):
    words = [w.translate(str.maketrans(licenses.UPPER, licenses.LOWER)) for w in re.findall("[0-9A-Za-z\x80-\U0010ffff]+", text)]
    places = [(k, label) for p, label in licenses.PHRASES.items() for k in range(len(words))
              if words[k:k + len(p.split())] == p.split()]
    found, best = set(), 0.0
    for line in text.split("\n"):
        have = {w.translate(str.maketrans(licenses.UPPER, licenses.LOWER)) for w in re.findall("[0-9A-Za-z\x80-\U0010ffff]+", line)}
        for label, template in licenses.TEMPLATES:
            t = set(template.split())
            if len(t & have) >= 0.8 * len(t) - 1e-9:
                found.add(label)
                best = max(best, len(t & have) / len(t))
    base = {label for _, label in places}
    at = [k for k, _ in places]
    return (len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)),
            ",".join(sorted(base | found)), 1.0 if at else best)


def test_license_scan(odd_docs):
    want = sorted(((i, *scanned(t)) for i, t in whole(odd_docs)), key=repr)
    got = sorted((tuple(r) for r in licenses.scan(odd_docs).collect()), key=repr)
    assert got == want
    assert sum(r[2] for r in got) == 4


def test_license_scan_of_nothing(no_docs):
    assert licenses.scan(no_docs).count() == 0


def without_repeats(rows, least):
    key = lambda i: -(1 << 63) if i is None else i
    first = {}
    for number, text in sorted(rows, key=lambda r: key(r[0])):
        raw = text.encode()
        for p in range(len(raw) - least + 1):
            first.setdefault(raw[p:p + least], key(number))
    out = []
    for number, text in rows:
        raw = text.encode()
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - least + 1):
            if first[raw[p:p + least]] < key(number):
                gone[p:p + least] = True
        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        spans = int((gone & ~np.r_[False, gone[:-1]]).sum()) if len(gone) else 0
        out.append((number, len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def test_repeats_are_removed(odd_docs):
    some = odd_docs.where("doc_id is null or doc_id <> 600")  # the longest text is slow for the plain version only
    for least, block in ((50, 1 << 20), (50, 700), (30, 3000)):
        got = sorted((tuple(r) for r in repeats.remove_repeats(some, least=least, block_bytes=block).collect()), key=repr)
        assert got == without_repeats(whole(some), least)


def test_windows_of_hot_grams_are_dealt_singly(odd_docs, spark):
    some = odd_docs.where("doc_id is null or doc_id <> 600")
    for block in (1 << 20, 700):
        got = repeats.remove_repeats(some, block_bytes=block, hot=1)
        assert sorted((tuple(r) for r in got.collect()), key=repr) == without_repeats(whole(some), 50)
    # one frequent line in ever different surroundings
    rng = np.random.default_rng(4)
    word = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    rows = [(k, f"{word(60)} of the University of {'=' * 20} {word(60)}") for k in range(400)]
    rows += [(1000 + k, rows[k][1][20:]) for k in range(0, 400, 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")

    def most_together(hot):
        blocks, shared, key_buckets, _ = repeats._prepared(repeats._sized(docs, "doc_id", "text"), 50, 4000, hot)
        sent = repeats._sent_pieces(blocks, shared, 50, key_buckets, 1, False).collect()
        return np.unique(np.concatenate([np.frombuffer(r["key"], "<u4") for r in sent]), return_counts=True)[1].max()

    assert most_together(repeats.HOT) > 300 and most_together(20) <= 20
    got = repeats.remove_repeats(docs, block_bytes=4000, hot=20)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == without_repeats(rows, 50)


def test_kept_text_has_whole_characters(spark):
    docs = spark.createDataFrame([(1, "é" * 40), (2, "x" + "é" * 40 + "y"), (3, "zé" * 3)], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in repeats.remove_repeats(docs, keep_text=True).collect()}
    assert got == {1: "é" * 40, 2: "xy", 3: "zé" * 3}


def test_repeat_groups_have_all_occurrences(spark):
    passage = "the quick brown fox jumps over the lazy dog and runs away, far away"
    docs = spark.createDataFrame([(k, f"{k} {passage} {k}" if k < 4 else f"nothing of the kind in document number {k}, really")
                                  for k in range(6)], "doc_id long, text string")
    groups = {}
    for r in repeats.repeat_groups(docs).collect():
        groups.setdefault((r["group_id"], r["length"]), set()).add((r["doc_id"], r["start"]))
    covered = {k: np.zeros(len(f"{k} {passage} {k}"), bool) for k in range(4)}
    for (_, length), places in groups.items():
        assert {d for d, _ in places} == {0, 1, 2, 3}
        texts = {f"{d} {passage} {d}"[s:s + length] for d, s in places}
        assert len(texts) == 1
        for d, s in places:
            covered[d][s:s + length] = True
    assert all(c.sum() == len(passage) + 2 for c in covered.values())


def test_no_repeats_in_nothing(no_docs):
    assert repeats.remove_repeats(no_docs).count() == 0
    assert repeats.repeat_groups(no_docs).count() == 0


def shingled(text):
    words = [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in re.findall(rb"[0-9A-Za-z\x80-\xff]+", text.encode())]
    width = min(5, len(words))
    return {tuple(words[k:k + width]) for k in range(len(words) - width + 1)} if words else set()


def near(docs):
    key = lambda i: -(1 << 63) if i is None else i
    rows = sorted({(i, t) for i, t in whole(docs)}, key=lambda r: (key(r[0]), r[1]))
    sets = [shingled(t) for _, t in rows]
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        return x if root[x] == x else find(root[x])

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and len(a & b) >= 0.8 * len(a | b) - 1e-9:
                links[i] += 1
                links[j] += 1
                x, y = sorted((find(i), find(j)))
                root[y] = x
    size = [sum(find(k) == find(i) for k in range(len(rows))) for i in range(len(rows))]
    return sorted(((r[0], rows[find(i)][0], size[i], links[i]) for i, r in enumerate(rows)), key=repr)


def test_near_copies(odd_docs):
    docs = odd_docs.where("doc_id is not null or text is not null")
    for block in (1024, 3, 2, 1):
        got = jaccard.near_copies(docs, block=block).select("doc_id", "class_id", "class_size", "n_links")
        assert sorted((tuple(r) for r in got.collect()), key=repr) == near(docs)


def test_near_copies_of_nothing(no_docs):
    assert jaccard.near_copies(no_docs).count() == 0


def test_pairs_go_on_unless_improbable():
    least = jaccard.least_matches(200, 20, 0.8, 1e-6)
    assert least == sorted(least) and 100 < least[-1] < 160
    # a pair at the threshold loses less than a millionth in all
    rng = np.random.default_rng(3)
    hits = rng.random((200_000, 200)) < 0.8
    ok = np.all([hits[:, :20 * (k + 1)].sum(axis=1) >= n for k, n in enumerate(least)], axis=0)
    assert ok.mean() > 0.9999


def test_components(spark):
    edges = [(k, k + 1) for k in range(0, 60)] + [(100, k) for k in range(101, 140)] + [(7, 7), (200, 201), (201, 200)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {k: 0 for k in range(61)} | {k: 100 for k in range(100, 140)} | {200: 200, 201: 200}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
