"""Alignment of two tokenizers' tokens by galloping intersection of their byte offsets.

1. A text is encoded by both vocabularies; the byte offsets at which tokens end are two rising lists. The shorter list
   drives: each of its offsets is searched in the longer one by steps of doubling width from the last place found, then
   by halving the last step. Stretches of the driving list are searched side by side.
2. Common offsets cut both lists into groups; differences of their ranks are the numbers of tokens in each, so a group
   is one range of tokens of either side. All tokens of a group are linked.
3. How many documents hold a pair of ids linked is counted over chunks of texts: a chunk keeps each of its pairs once,
   with the number of its documents; chunks are added up by pair, rated within the first id, and the ratings go back to
   the chunks they came from. Pairs of a document travel as numbers within its chunk.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelstats.llm import bytelevel, pieces
from panelstats.llm.common import documents_of
from panelstats.llm.counts import batches
from panelstats.session import materialise

STRETCH = 64  # offsets of the driving list searched one after the other
CHUNK_CHARS = 8_000_000
WORDS = 200_000  # distinct words of either side that a worker remembers
SMALL_GROUP = 64  # links of a group that are written out; in larger ones equal ids are counted first
SHORT = 1 << 16


def gallop(short: np.ndarray, long: np.ndarray, stretch: int = STRETCH) -> tuple[np.ndarray, np.ndarray]:
    """Places of the values that two rising lists share, in the first and in the second."""
    if not len(short) or not len(long):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    last = len(long) - 1
    heads = np.arange(0, len(short), stretch)
    at = np.searchsorted(long, short[heads])  # where each stretch begins
    found = np.full(len(short), -1, np.int64)
    for step in range(stretch):
        mine = heads + step
        lanes = np.flatnonzero(mine < len(short))
        target, low = short[mine[lanes]], at[lanes]
        low = np.minimum(low, last)
        # doubling steps: long[low + width] is still too small
        width = np.zeros(len(lanes), np.int64)
        going = np.flatnonzero(long[low] < target)
        high = low.copy()
        while len(going):
            width[going] = np.maximum(1, 2 * width[going])
            reach = low[going] + width[going]
            high[going] = np.minimum(reach, last)
            going = going[(reach <= last) & (long[high[going]] < target[going])]
        # halving: the first place not too small lies in (low + width / 2, high], or at low
        left = low + np.where(width > 0, width // 2, 0)
        right = high
        going = np.flatnonzero((width > 0) & (right - left > 1))
        while len(going):
            middle = (left[going] + right[going]) // 2
            less = long[middle] < target[going]
            left[going[less]] = middle[less]
            right[going[~less]] = middle[~less]
            going = going[right[going] - left[going] > 1]
        at[lanes] = right
        hit = long[right] == target
        found[mine[lanes[hit]]] = right[hit]
    shared = np.flatnonzero(found >= 0)
    return shared, found[shared]


def ranges(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For parts of the given sizes: the part of each element, and its place in the part."""
    part = np.repeat(np.arange(len(sizes)), sizes)
    return part, np.arange(len(part)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


class Side:
    """A vocabulary: ids of texts and the bytes of each id."""

    def __init__(self, encoder, content: Sequence[bytes]) -> None:
        self.encoder = encoder
        self.length = np.fromiter(map(len, content), np.int64, len(content))
        self.flat = np.frombuffer(b"".join(content), np.uint8)
        self.begin = np.cumsum(self.length) - self.length

    def tokens(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        return self.encoder.encode(texts)

    def joined(self, ids: np.ndarray) -> bytes:
        part, place = ranges(self.length[ids])
        return self.flat[self.begin[ids][part] + place].tobytes()


class PieceEncoder(pieces.Encoder):
    """As the piece operator's encoder, but the library encodes the distinct words."""

    def __init__(self, model) -> None:
        self.model, self.mark = model, model.piece_to_id(chr(pieces.MARK))
        self.words = bytelevel.Words(self._make, WORDS)

    def _make(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        # the library puts the first mark of a word there itself, but for an empty text
        found = [ids or [self.mark] for ids in self.model.encode([w.decode()[1:] for w in words], num_threads=1)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter((i for ids in found for i in ids), np.int64, int(sizes.sum())), np.r_[0, np.cumsum(sizes)]


class Aligner:
    """Groups and links of batches of texts."""

    def __init__(self, vocabulary: dict, spec: dict) -> None:
        import sentencepiece

        plain = bytelevel.Encoder(vocabulary | {"special": {}})  # special strings inside texts are plain text
        plain.words.most = WORDS
        self.a = Side(plain, [vocabulary["content"].get(i, b"") for i in range(vocabulary["size"])])
        literal = [b if b else spec["names"][i] for i, b in enumerate(spec["content"])]
        self.b = Side(PieceEncoder(sentencepiece.SentencePieceProcessor(model_proto=spec["file"])), literal)
        ids = [str(i) for i in range(max(len(self.a.length), len(self.b.length)))]
        self.shown = [i + mark for mark in ",|;" for i in ids]
        self.wide = len(ids)

    def align(self, texts: Sequence[str]) -> dict[str, np.ndarray]:
        """Per text: n_a, n_b, n_groups, n_links, sha; and (owner, pair, times) of the distinct linked pairs of each."""
        lead = [" " + t if t else "" for t in texts]
        raw = [t.encode() for t in lead]
        ids, counts = [], []
        whole = np.array([bool(t) for t in texts], bool)
        for side, given in ((self.a, lead), (self.b, texts)):
            flat, count = side.tokens(given)
            sizes = np.bincount(np.repeat(np.arange(len(texts)), count), weights=side.length[flat], minlength=len(texts)).astype(np.int64)
            joined, end = side.joined(flat), np.cumsum(sizes).tolist()
            whole &= np.fromiter((joined[e - s:e] == r for e, s, r in zip(end, sizes.tolist(), raw)), bool, len(texts))
            ids.append(flat)
            counts.append(count)
        for k in (0, 1):
            ids[k] = ids[k][np.repeat(whole, counts[k])]
            counts[k] = np.where(whole, counts[k], 0)
        cut_a, cut_b = self._common(ids, counts)
        groups_a, groups_b = np.diff(np.r_[-1, cut_a]), np.diff(np.r_[-1, cut_b])
        owner = np.searchsorted(np.cumsum(counts[0]), cut_a, side="right")  # the text of each group
        per_text = lambda w: np.bincount(owner, weights=w, minlength=len(texts)).astype(np.int64)
        return {"n_a": counts[0], "n_b": counts[1], "n_groups": per_text(np.ones(len(owner))),
                "n_links": per_text(groups_a * groups_b), "sha": self._digests(ids, counts, groups_a, groups_b),
                "links": self._links(ids, cut_a, cut_b, groups_a, groups_b, owner)}

    def _common(self, ids: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Places, among all tokens of either side, at which both sides end; the shorter list of each text drives."""
        ends = [np.cumsum(side.length[flat]) for side, flat in zip((self.a, self.b), ids)]
        found_a, found_b = [], []
        for a_drives in (True, False):
            texts = counts[0] <= counts[1] if a_drives else counts[0] > counts[1]
            own = [np.flatnonzero(np.repeat(texts, count)) for count in counts]
            lists = [e[o] for e, o in zip(ends, own)]
            if a_drives:
                i, j = gallop(lists[0], lists[1])
            else:
                j, i = gallop(lists[1], lists[0])
            found_a.append(own[0][i])
            found_b.append(own[1][j])
        cut_a = np.concatenate(found_a)
        order = np.argsort(cut_a, kind="stable")
        return cut_a[order], np.concatenate(found_b)[order]

    def _digests(self, ids, counts, groups_a, groups_b) -> list[str]:
        """SHA-256 of the written groups of each text; '' for a text without tokens."""
        written, keys = [], []
        for side, (flat, groups, mark) in enumerate(((ids[0], groups_a, 1), (ids[1], groups_b, 2))):
            last = np.zeros(len(flat), np.int64)
            last[np.cumsum(groups) - 1] = mark
            written.append(flat + last * self.wide)
            keys.append(2 * np.repeat(np.arange(len(groups)), groups) + side)
        order = np.argsort(np.concatenate(keys), kind="stable")
        text = list(map(self.shown.__getitem__, np.concatenate(written)[order].tolist()))
        ends = np.cumsum(counts[0] + counts[1]).tolist()
        return [hashlib.sha256("".join(text[b:e])[:-1].encode()).hexdigest() if e > b else "" for b, e in zip([0, *ends], ends)]

    def _links(self, ids, cut_a, cut_b, groups_a, groups_b, owner) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        first_a, first_b = cut_a - groups_a + 1, cut_b - groups_b + 1
        size = groups_a * groups_b
        small = np.flatnonzero(size <= SMALL_GROUP)
        part, place = ranges(size[small])
        group, wide = small[part], groups_b[small][part]
        pair = ids[0][first_a[group] + place // wide] * self.wide + ids[1][first_b[group] + place % wide]
        of, pairs, times = [owner[group]], [pair], [np.ones(len(pair), np.int64)]
        for g in np.flatnonzero(size > SMALL_GROUP).tolist():
            left, n_left = np.unique(ids[0][first_a[g]:cut_a[g] + 1], return_counts=True)
            right, n_right = np.unique(ids[1][first_b[g]:cut_b[g] + 1], return_counts=True)
            pairs.append((left[:, None] * self.wide + right[None, :]).ravel())
            times.append((n_left[:, None] * n_right[None, :]).ravel())
            of.append(np.full(len(left) * len(right), owner[g]))
        return distinct(np.concatenate(of), np.concatenate(pairs), np.concatenate(times))


def distinct(owner: np.ndarray, pair: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each (owner, pair) once, with the sum of its times."""
    import pandas as pd

    code, names = pd.factorize(pair)
    key, met = pd.factorize(owner * max(len(names), 1) + code)
    return met // max(len(names), 1), names[met % max(len(names), 1)], np.bincount(key, weights=times, minlength=len(met)).astype(np.int64)


def packed(codes: np.ndarray, times: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Numbers below SHORT in two bytes, the others in four; times in one byte each, or in eight."""
    order = np.argsort(codes)
    codes, times = codes[order], times[order]
    cut = int(np.searchsorted(codes, SHORT))
    kind = "<u1" if times.max(initial=0) < 256 else "<i8"
    return codes[:cut].astype("<u2").tobytes(), codes[cut:].astype("<u4").tobytes(), times.astype(kind).tobytes()


def unpacked(low: bytes, high: bytes, times: bytes) -> tuple[np.ndarray, np.ndarray]:
    codes = np.r_[np.frombuffer(low, "<u2").astype(np.int64), np.frombuffer(high, "<u4").astype(np.int64)]
    return codes, np.frombuffer(times, "<u1" if len(times) == len(codes) else "<i8").astype(np.int64)


_KEPT: dict[tuple[str, str], Aligner] = {}  # a worker process keeps the words it has met, as far as `Words` allows


def aligner(files: tuple[str, str], vocabulary: dict, spec: dict) -> Aligner:
    if files not in _KEPT:
        _KEPT.clear()
        _KEPT[files] = Aligner(vocabulary, spec)
    return _KEPT[files]


def read_pieces(file: str) -> dict:
    """As pieces.read_pieces, with the file and the written names of the pieces that stand for no text."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=file)
    spec = pieces.read_pieces(file)
    with open(file, "rb") as f:
        content = f.read()
    return spec | {"file": content, "names": [model.id_to_piece(i).encode() for i in range(spec["size"])]}


def encoded(docs: DataFrame, file_a: str, file_b: str, id_col: str, text_col: str, chunk_chars: int) -> DataFrame:
    """Rows of documents with their groups and packed links, and a row of pairs for each chunk."""
    vocabulary, spec = bytelevel.read_vocabulary(file_a), read_pieces(file_b)
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, spec))  # as large as the vocabularies
    names = ["chunk", "doc_id", "no_id", "n_a", "n_b", "n_groups", "n_links", "sha", "low", "high", "times", "pairs", "n_docs"]
    schema = ("chunk string, doc_id long, no_id boolean, n_a long, n_b long, n_groups long, n_links long, sha string, low binary, high binary, "
              "times binary, pairs array<long>, n_docs array<long>")

    def rows_of(name, met):
        """One chunk: numbers for its pairs, the most frequent first, and everything packed by them."""
        import pandas as pd

        owner = np.concatenate([m["links"][0] + m["base"] for m in met])
        code, pairs = pd.factorize(np.concatenate([m["links"][1] for m in met]))
        times = np.concatenate([m["links"][2] for m in met])
        n_docs = np.bincount(code, minlength=len(pairs))
        rank = np.empty(len(pairs), np.int64)
        order = np.lexsort((pairs, -n_docs))
        rank[order] = np.arange(len(pairs))
        by = np.argsort(owner, kind="stable")
        code, times = rank[code][by], times[by]
        total = sum(len(m["ids"]) for m in met)
        ends = np.cumsum(np.bincount(owner, minlength=total)).tolist()
        links = [packed(code[b:e], times[b:e]) for b, e in zip([0, *ends], ends)]
        out = pd.DataFrame({"chunk": name, "doc_id": pd.concat([m["ids"] for m in met], ignore_index=True)})
        out["no_id"] = pd.concat([m["no_id"] for m in met], ignore_index=True)
        for column in ("n_a", "n_b", "n_groups", "n_links", "sha"):
            out[column] = np.concatenate([m[column] for m in met])
        for k, column in enumerate(("low", "high", "times")):
            out[column] = [x[k] for x in links]
        out["pairs"] = out["n_docs"] = None
        yield out[names]
        if len(pairs):
            yield pd.DataFrame({n: [None] for n in names} | {"chunk": [name], "pairs": [pairs[order]], "n_docs": [n_docs[order]]})[names]

    def run(frames):
        import uuid

        tools = aligner((file_a, file_b), *shared.value)
        met, size, base = [], 0, 0
        for frame in frames:
            texts = frame["text"].tolist()
            for part in batches(texts):
                got = tools.align(texts[part])
                met.append(got | {"ids": frame["doc_id"].iloc[part], "no_id": frame["no_id"].iloc[part], "base": base})
                base += part.stop - part.start
                size += sum(map(len, texts[part])) + 64 * (part.stop - part.start)
                if size >= chunk_chars:
                    yield from rows_of(uuid.uuid4().hex, met)  # names need only differ; the table is written once and then read
                    met, size, base = [], 0, 0
        if met:
            yield from rows_of(uuid.uuid4().hex, met)

    # a column of integers with missing ones would reach pandas as floats
    numbered = documents_of(docs, id_col, text_col).select(
        F.coalesce("doc_id", F.lit(0).cast("long")).alias("doc_id"), F.isnull("doc_id").alias("no_id"), "text")
    return materialise(numbered.mapInPandas(run, schema), "aligned")


def align(docs: DataFrame, file_a: str, file_b: str, id_col: str = "doc_id", text_col: str = "text",
          chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A (a byte-level vocabulary) encodes a blank and the text, B (a piece vocabulary) the text, before which it puts a
    blank; special strings are plain text. A pair of ids counts the documents in which it is linked. n_best: links whose
    count is the largest of their A id, ties included; count_sum: the sum of counts over links. A missing or empty text,
    and one whose tokens of A or of B do not spell blank and text, has no tokens: zeros and ''. A missing id is kept,
    repeated rows each give a row and count as documents of their own.
    """
    table = encoded(docs, file_a, file_b, id_col, text_col, chunk_chars)
    wide = F.lit(max(bytelevel.read_vocabulary(file_a)["size"], read_pieces(file_b)["size"]))
    held = table.where(F.col("pairs").isNotNull()).select(
        "chunk", F.posexplode(F.arrays_zip("pairs", "n_docs")).alias("code", "held")).select(
        "chunk", "code", F.col("held.pairs").alias("pair"), F.col("held.n_docs").alias("n"))
    counted = held.groupBy("pair").agg(F.sum("n").alias("count")).withColumn("a", F.floor(F.col("pair") / wide))
    counted = materialise(counted, "pairs")
    highest = counted.groupBy("a").agg(F.max("count").alias("highest"))  # at most as many rows as A has ids
    rated = counted.join(highest, "a").select("pair", "count", (F.col("count") == F.col("highest")).alias("best"))
    back = held.drop("n").join(rated, "pair").select(F.col("chunk").alias("in_chunk"), "code", "count", "best")
    base = ["doc_id", "no_id", "n_a", "n_b", "n_groups", "n_links"]
    texts = table.where(F.col("pairs").isNull())
    linked = texts.where("n_links > 0").select("chunk", *base, "sha", "low", "high", "times")

    def add(docs_frame, ratings):
        import pandas as pd

        count, best = np.zeros(len(ratings), np.int64), np.zeros(len(ratings), np.int64)
        count[ratings["code"]] = ratings["count"]
        best[ratings["code"]] = ratings["best"]
        sums = []
        for low, high, times in zip(docs_frame["low"], docs_frame["high"], docs_frame["times"]):
            codes, n = unpacked(low, high, times)
            sums.append((int((n * best[codes]).sum()), int((n * count[codes]).sum())))
        out = docs_frame[[*base]].copy()
        out[["n_best", "count_sum"]] = np.array(sums, np.int64).reshape(-1, 2)
        out["groups_sha256"] = docs_frame["sha"]
        return pd.DataFrame(out)

    schema = ("doc_id long, no_id boolean, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, "
              "groups_sha256 string")
    summed = linked.groupBy("chunk").cogroup(back.groupBy("in_chunk")).applyInPandas(add, schema)
    zero = F.lit(0).cast("long")
    without = texts.where("n_links = 0").select(*base, zero.alias("n_best"), zero.alias("count_sum"), F.col("sha").alias("groups_sha256"))
    return summed.unionByName(without).withColumn("doc_id", F.when(~F.col("no_id"), F.col("doc_id"))).drop("no_id")
