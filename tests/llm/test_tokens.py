"""Token operators against the libraries."""

import random
import zlib

import numpy as np
import pytest

from panelstats.llm import bytelevel, counts, packing, pieces

tokenizers = pytest.importorskip("tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")


@pytest.fixture(scope="module")
def byte_level(file):
    return tokenizers.Tokenizer.from_file(file("byte_bpe_50k.json"))


def messy(seed, count, longest):
    rng = random.Random(seed)
    units = [*"ab's 'tre  \n\t.!1234éÊß日本  ½Ⅷ😀vl", "<|endoftext|>", "'ll", "'ve", " the", "hello", "▁", "<s>"]
    return ["".join(rng.choice(units) for _ in range(rng.randint(0, longest))) for _ in range(count)]


def test_ids_of_batches(file, byte_level):
    texts = [*messy(1, 3000, 30), "", "a" * 5000, " " * 500 + "x", "=-" * 300]
    flat, sizes = bytelevel.Encoder(bytelevel.read_vocabulary(file("byte_bpe_50k.json"))).encode(texts)
    ends = np.r_[0, np.cumsum(sizes)]
    for k, text in enumerate(texts):
        assert flat[ends[k]:ends[k + 1]].tolist() == byte_level.encode(text, add_special_tokens=False).ids


def test_counts_at_every_prefix(file, byte_level):
    texts = messy(2, 300, 12)
    flat, sizes = counts.Prefixes(bytelevel.read_vocabulary(file("byte_bpe_50k.json"))).tables(texts)
    ends = np.r_[0, np.cumsum(sizes)]
    for k, text in enumerate(texts):
        for c in range(1, len(text) + 1):
            want = len(byte_level.encode(text[:c], add_special_tokens=False).ids)
            assert flat[ends[k] + len(text[:c].encode()) - 1] == want, (text, c)


def test_token_counts(odd_docs, file, byte_level):
    got = counts.prefix_counts(odd_docs, file("byte_bpe_50k.json"), 16, keep_table=True).collect()
    rows = odd_docs.select("doc_id", "text").collect()
    want = sorted(((r["doc_id"], len((r["text"] or "").encode()),
                    len(byte_level.encode(r["text"] or "", add_special_tokens=False).ids)) for r in rows), key=repr)
    assert sorted(((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in got), key=repr) == want
    for r in got:
        assert r["over_limit"] == (r["n_tokens"] > 16) and len(r["prefix_table"]) == 4 * r["n_bytes"]
        if r["kept_bytes"]:
            assert np.frombuffer(r["prefix_table"], "<u4")[r["kept_bytes"] - 1] <= 16


def test_stored_counts_answer_limits(spark, odd_docs, no_docs, file, byte_level):
    limits = [0, 1, 7, 16, 16, 900]
    stored = counts.store(odd_docs, file("byte_bpe_50k.json"))
    got = counts.answer(stored, limits)
    rows = got.collect()
    assert len(rows) == len(limits) * odd_docs.count()
    for limit in set(limits):
        same = counts.prefix_counts(odd_docs, file("byte_bpe_50k.json"), limit).collect()
        mine = [r for r in rows if r["limit"] == limit]
        assert sorted(((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"], r["kept_bytes"]) for r in mine), key=repr) == \
            sorted((tuple(r) for r in same for _ in range(limits.count(limit))), key=repr)
    assert {r["step_bytes"] for r in stored.collect()} == {1}
    assert counts.answer(stored, []).columns == got.columns and counts.answer(stored, []).count() == 0
    none = counts.store(no_docs, file("byte_bpe_50k.json"))
    assert counts.answer(none, [5]).count() == 0 and none.columns == stored.columns


def test_stored_counts_answer_places(spark, file, byte_level):
    from pyspark.sql import functions as F

    texts = [*messy(9, 40, 25), "", None, "日本語 text"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    stored = counts.store(docs, file("byte_bpe_50k.json"))
    got = counts.tokens_before(stored, F.sequence(F.lit(-1), F.col("n_bytes") + 1)).collect()
    assert len(got) == sum(len((t or "").encode()) + 3 for t in texts)
    for r in got:
        raw = (texts[r["doc_id"]] or "").encode()
        end = min(max(r["place"], 0), len(raw))
        while end and end < len(raw) and raw[end] & 0xC0 == 0x80:
            end += 1
        assert r["tokens"] == len(byte_level.encode(raw[:end].decode(), add_special_tokens=False).ids)
    assert counts.tokens_before(stored, F.array().cast("array<long>")).count() == 0


def test_steps_of_any_width():
    flat, sizes = np.array([1, 300, 2, 5, 6]), np.array([3, 0, 2])
    assert counts._steps(flat, sizes, b"abcde").tolist() == [1, 299, -298, 5, 1]
    assert counts._steps(np.array([1, 7, 3]), np.array([3]), "aé".encode()).tolist() == [1, 2, 0]


def test_pieces_and_back(odd_docs, file):
    model = sentencepiece.SentencePieceProcessor(model_file=file("piece_bpe_32k.model"))
    encoded = pieces.encode(odd_docs, file("piece_bpe_32k.model"))
    got = sorted(((r["doc_id"], r["ids"]) for r in encoded.collect()), key=repr)
    texts = [(r["doc_id"], r["text"] or "") for r in odd_docs.select("doc_id", "text").collect()]
    assert got == sorted(((i, model.encode(t)) for i, t in texts), key=repr)
    back = pieces.decode(encoded, file("piece_bpe_32k.model")).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in back), key=repr) == sorted(
        ((i, t.replace("▁", " ")) for i, t in texts), key=repr)


def test_pieces_of_messy_texts(file):
    model = sentencepiece.SentencePieceProcessor(model_file=file("piece_bpe_32k.model"))
    spec = pieces.read_pieces(file("piece_bpe_32k.model"))
    from panelstats.llm import forward
    encoder = pieces.Encoder(spec, forward.from_scores(spec["pieces"], spec["scores"], spec["size"]))
    texts = [*messy(4, 2000, 40), "", " ", "  x", "a" * 3000]
    flat, sizes = encoder.encode(texts)
    ends = np.r_[0, np.cumsum(sizes)]
    for k, text in enumerate(texts):
        assert flat[ends[k]:ends[k + 1]].tolist() == model.encode(text)


def thue_morse(length):
    word = "".join("ab"[bin(k).count("1") % 2] for k in range(length))
    return [word, word.translate(str.maketrans("ab", "ba"))]


@pytest.mark.parametrize("key", [None, lambda points, starts: np.zeros(len(starts), np.uint64)])
def test_words_are_compared(file, byte_level, monkeypatch, key):
    from panelstats.llm import forward
    if key:  # every word has the same key
        monkeypatch.setattr(bytelevel, "word_keys", key)
    texts = [t for n in (8, 1024, 2048) for t in thue_morse(n)] + ["one two one", "two", "owt one", "", "a b a b"]
    vocabulary = bytelevel.read_vocabulary(file("byte_bpe_50k.json"))
    encoder, prefixes = bytelevel.Encoder(vocabulary), counts.Prefixes(vocabulary)
    model = sentencepiece.SentencePieceProcessor(model_file=file("piece_bpe_32k.model"))
    spec = pieces.read_pieces(file("piece_bpe_32k.model"))
    marked = pieces.Encoder(spec, forward.from_scores(spec["pieces"], spec["scores"], spec["size"]))
    for _ in range(2):  # met for the first time, and met again
        for batch in (texts, texts[::-1]):
            want = [byte_level.encode(t, add_special_tokens=False).ids for t in batch]
            flat, sizes = encoder.encode(batch)
            assert flat.tolist() == [i for ids in want for i in ids] and sizes.tolist() == [len(ids) for ids in want]
            table, width = prefixes.tables(batch)
            assert [int(table[e - 1]) if w else 0 for e, w in zip(np.cumsum(width), width)] == [len(ids) for ids in want]
            flat, sizes = marked.encode(batch)
            assert flat.tolist() == [i for t in batch for i in model.encode(t)]


def test_words_start_anew(file):
    words = bytelevel.Words(lambda ws: (np.array([len(w) for w in ws]), np.arange(len(ws) + 1)), most=2)
    for text in ("abc de f", "abc de f ghij", "x"):
        points, starts, _ = bytelevel.Splitter().split([text])
        values, sizes = words.gather(words.look_up(points, starts))
        assert values.tolist() == np.diff(np.r_[starts, len(text)]).tolist() and (sizes == 1).all()


def check_packed(rows, most):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= most
    return len(by)


def test_every_id_is_packed_once(odd_docs, file, byte_level):
    rows = packing.pack_documents(odd_docs, file("byte_bpe_50k.json"), most_tokens=64, block_items=200).collect()
    sequences = check_packed(rows, 64)
    assert sequences <= 1.1 * sum(r["length"] for r in rows) / 64 + 8  # little padding, but for the last of each block
    want = []
    for r in odd_docs.select("doc_id", "text").collect():
        ids = np.array([*byte_level.encode(r["text"] or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(r["doc_id"], s, min(64, len(ids) - s), zlib.crc32(ids[s:s + 64].tobytes()), len(ids)) for s in range(0, len(ids), 64)]
    got = [(r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_limits_hold_together():
    rng = np.random.default_rng(5)
    demands = np.stack([rng.integers(1, 100, 400), np.ones(400, int), rng.integers(0, 50, 400)], axis=1)
    sequence, place = packing.fill(demands, [100, 6, 60])
    assert sequence.min() == 0
    for s in range(sequence.max() + 1):
        mine = sequence == s
        assert mine.any() and (demands[mine].sum(axis=0) <= [100, 6, 60]).all()
        assert sorted(place[mine]) == list(range(mine.sum()))
    assert sequence.max() + 1 <= 1.15 * max(demands.sum(axis=0) / [100, 6, 60])
    with pytest.raises(ValueError):
        packing.fill(np.array([[101, 1, 0]]), [100, 6, 60])


def test_instruction_turns(spark, file):
    turns = spark.createDataFrame(
        [(c, t, ("user", "assistant")[t % 2], "word " * (5 + c) if c % 5 else None) for c in range(40) for t in range(4)]
        + [(None, None, None, None)], "conv_id long, turn long, role string, text string")
    rows = packing.pack_turns(turns, file("byte_bpe_50k.json"), 64, 4, 32).collect()
    check_packed(rows, 64)
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append(r)
    assert all(len(v) <= 4 and sum(r["loss_tokens"] for r in v) <= 32 for v in by.values())
    assert {(r["conv_id"], r["turn"]) for r in rows} == {(r["conv_id"], r["turn"]) for r in turns.collect()}


def test_tokens_of_nothing(no_docs, file):
    assert packing.pack_documents(no_docs, file("byte_bpe_50k.json")).count() == 0
    assert counts.prefix_counts(no_docs, file("byte_bpe_50k.json"), 5).count() == 0
    assert pieces.encode(no_docs, file("piece_bpe_32k.model")).count() == 0
