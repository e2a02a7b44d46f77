"""Repeats across documents from an enhanced suffix array, and their removal.

The array is never built over the whole corpus at once. Every window of `least` bytes has one leading 16-gram, the one
with the smallest hash (leftmost of equals), so equal windows have equal leading grams; consecutive windows with the
same leading gram form a piece of at most 2 * least - 16 bytes. Hence

1. documents are packed into compressed blocks;
2. blocks send the hashes of their leading grams to buckets, which answer, bit by bit, which of them more than one
   document has, and which lead more than a set number of distinct pieces;
3. blocks send the pieces of these to buckets by hash, each distinct content of a block once. A frequent gram would
   bring all its surroundings to one bucket: its pieces are sent as single windows of `least` bytes, each to the bucket
   of its whole content, where equal windows still meet. A bucket sorts all
   suffixes of its pieces (at least `least` bytes long), computes the common prefixes of neighbours, and scans them
   with a stack: each interval with a common prefix of at least `least` bytes is a repeat with all its occurrences.
   Intervals whose members all have the same byte on the left are part of a longer repeat and are passed over;
4. blocks take back which parts of their pieces occur in a document with a smaller id.

Every comparison that decides is one of bytes, not of hashes.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelstats.llm.common import LOWEST, whole_text
from panelstats.session import materialise

GRAM = 16
BLOCK_BYTES = 1 << 20  # a longer document is a block of its own
KEY_BUCKET_BYTES = 16 << 20  # text per bucket of hashes
PIECE_BUCKET_BYTES = 8 << 20  # text per bucket of pieces
SLICE = 8_000  # pieces whose suffixes are sorted together, more only where one leading gram or window has more
HOT = 8_000  # distinct pieces with one leading gram, above which its windows are dealt singly
_SENT = np.uint64((1 << 64) - (1 << 16))  # the part of a hash that is sent: its upper 48 bits
_STEP = (1 << 20) - 4096
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def pieces_of(raw: np.ndarray, sizes: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, length, hash of the leading gram, and document of every piece of documents laid end to end."""
    n, grams = len(raw), least - GRAM + 1
    of = np.repeat(np.arange(len(sizes)), sizes)
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))]
    raw = np.ascontiguousarray(raw)
    for a in range(0, n - least + 1, _STEP):
        b = min(a + _STEP, n - least + 1)  # windows a..b-1
        words = np.ndarray((b - a + grams + 7,), "<u8", raw, a, (1,))
        h = words[:-8] * _M1 ^ words[8:] * _M2
        h ^= h >> np.uint64(29)
        h *= _M1
        h ^= h >> np.uint64(32)
        low = (h >> np.uint64(20) << np.uint64(20)) | np.arange(len(h), dtype=np.uint64)
        width = 1
        while width * 2 <= grams:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        if width < grams:
            low = np.minimum(low[:len(low) - (grams - width)], low[grams - width:])
        at = (low & np.uint64((1 << 20) - 1)).astype(np.int64)
        window = np.flatnonzero(of[a:b] == of[a + least - 1:b + least - 1])
        if not len(window):
            continue
        at = at[window]
        head = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (np.diff(window) != 1)])
        tail = np.r_[head[1:], len(window)] - 1
        start = window[head] + a
        chosen = h[at[head]] * _M2  # the smallest hashes lie close together: mixed again, they spread evenly
        chosen ^= chosen >> np.uint64(32)
        out.append((start, window[tail] - window[head] + least, chosen * _M1, of[start]))
    return tuple(np.concatenate(x) for x in zip(*out))


def _content_hash(raw: np.ndarray, start: np.ndarray, length: np.ndarray, least: int) -> np.ndarray:
    """A hash of each stretch of at least `least` and at most 2 * least - 16 bytes, by its words from both ends."""
    words = np.ndarray((len(raw) - 7,), "<u8", np.ascontiguousarray(raw), 0, (1,)) if len(start) else np.zeros(0, np.uint64)
    h, last = length.astype(np.uint64), start + length - 8
    for step in range(0, least - 7, 8):
        for at in (start + step, last - step):
            h = (h ^ words[at]) * _M1
            h ^= h >> np.uint64(32)
    h *= _M2
    return (h ^ h >> np.uint64(29)) * _M1


def _matrix(raw: np.ndarray, start: np.ndarray, length: np.ndarray, width: int) -> np.ndarray:
    """Pieces as rows, with zeros behind their end."""
    padded = np.concatenate([raw, np.zeros(width, np.uint8)])
    rows = np.lib.stride_tricks.sliding_window_view(padded, width)[start]
    rows[np.arange(width) >= length[:, None]] = 0
    return rows


def _buckets_of(key: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets in the order of the keys."""
    return (((key >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def _edges(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin, and the end."""
    return np.flatnonzero(np.r_[True, values[1:] != values[:-1], True])


def _packed(values: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values).tobytes())


def _unpacked(parts: Sequence[bytes], kind) -> np.ndarray:
    import zstandard

    unpack = zstandard.ZstdDecompressor()
    return np.frombuffer(b"".join(unpack.decompress(p) for p in parts), kind)


def _same(rows: np.ndarray, length: np.ndarray) -> np.ndarray:
    """For each row the first row with the same content."""
    if not len(rows):
        return np.zeros(0, np.int64)
    padded = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), np.uint8)
    padded[:, :rows.shape[1]] = rows
    h = length.astype(np.uint64)
    for word in padded.view("<u8").T:
        h = (h ^ word) * _M1
        h ^= h >> np.uint64(29)
    _, first, inverse = np.unique(h, return_index=True, return_inverse=True)
    first = first[inverse]
    equal = (rows == rows[first]).all(axis=1) & (length == length[first])
    return np.where(equal, first, np.arange(len(rows)))  # of two contents behind one hash, one is left unjoined


class Block:
    """The shared pieces of a block: where they are, and which occurrence of each content speaks for the others."""

    def __init__(self, raw: bytes, ids: np.ndarray, sizes: np.ndarray, answers, buckets: int, least: int) -> None:
        data = np.frombuffer(raw, np.uint8)
        start, length, key, doc = pieces_of(data, sizes, least)
        sent, place = np.unique(key & _SENT, return_inverse=True)
        bucket, shared, hot = _buckets_of(sent, buckets), np.zeros(len(sent), bool), np.zeros(len(sent), bool)
        for a in answers:
            lo, hi = np.searchsorted(bucket, [a["bucket"], a["bucket"] + 1])
            shared[lo:hi] = np.unpackbits(np.frombuffer(a["bits"], np.uint8), count=hi - lo)
            if len(a["hot"]):
                hot[lo:hi] = np.unpackbits(np.frombuffer(a["hot"], np.uint8), count=hi - lo)
        known, apart = (shared & ~hot)[place], np.flatnonzero(hot[place])
        self.start, self.length, self.key, of = start[known], length[known], key[known], doc[known]
        if len(apart):
            n = length[apart] - least + 1
            window = np.repeat(start[apart] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            size = np.full(len(window), least)
            self.start, self.length = np.r_[self.start, window], np.r_[self.length, size]
            self.key = np.r_[self.key, _content_hash(data, window, size, least)]
            of = np.r_[of, np.repeat(doc[apart], n)]
        self.doc = ids[of]
        self.rows = _matrix(data, self.start, self.length, 2 * least - GRAM) if len(self.start) else np.zeros((0, 1), np.uint8)
        group = _same(self.rows, self.length)
        smallest = np.full(len(group), np.iinfo(np.int64).max)
        np.minimum.at(smallest, group, self.doc)
        self.later = self.doc > smallest[group]  # another document of the block has it: removed as a whole
        own = np.flatnonzero(~self.later)
        _, first, inverse = np.unique(group[own], return_index=True, return_inverse=True)
        self.speaker = np.full(len(group), -1)
        self.speaker[own] = own[first][inverse]
        self.speakers = own[first]


def suffix_intervals(rows: np.ndarray, length: np.ndarray, doc: np.ndarray, least: int, all_nodes: bool = False):
    """Sorts the suffixes of pieces and scans their common prefixes.

    Returns piece, offset and length of every stretch that occurs in a piece of a smaller document; and, if asked for,
    the repeats: number, length, and piece and offset of each occurrence.
    """
    none = np.zeros(0, np.int64)
    if not len(rows):
        return (none, none, none), []
    width = rows.shape[1]
    count = length - least + 1
    piece = np.repeat(np.arange(len(rows)), count)
    offset = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    rest = length[piece] - offset
    wide = np.zeros((len(rows), 2 * width), np.uint8)
    wide[:, :width] = rows
    suffix = np.zeros((len(piece), width + 1), np.uint8)
    suffix[:, :width] = np.lib.stride_tricks.sliding_window_view(wide, width, axis=1)[piece, offset]
    suffix[:, width] = rest  # of equal bytes the shorter first
    order = np.argsort(suffix.view(f"S{width + 1}").ravel(), kind="stable")
    suffix, piece, offset, rest = suffix[order], piece[order], offset[order], rest[order]
    differ = suffix[1:, :width] != suffix[:-1, :width]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    common = np.r_[0, np.minimum(common, np.minimum(rest[1:], rest[:-1]))]
    left = np.where(offset > 0, wide[piece, offset - 1].astype(np.int64), -1)
    owner = doc[piece]
    head = np.flatnonzero(common < least)
    size = np.diff(np.r_[head, len(common)])
    low_left, high_left = np.minimum.reduceat(left, head), np.maximum.reduceat(left, head)
    low_doc, high_doc = np.minimum.reduceat(owner, head), np.maximum.reduceat(owner, head)
    open_ = (size > 1) & ((low_left != high_left) | (low_left < 0)) & (low_doc != high_doc)
    head, size, low_doc = head[open_], size[open_], low_doc[open_]
    cover = np.zeros(len(common), np.int64)
    nodes = []
    for at, n, smallest in zip(head.tolist(), size.tolist(), low_doc.tolist()):
        values = common[at + 1:at + n]
        if not all_nodes and (n == 2 or (values == values[0]).all()):
            part = cover[at:at + n]
            part[owner[at:at + n] > smallest] = values[0]
            continue
        stack: list[tuple[int, int]] = []
        for i, now in enumerate([*values.tolist(), 0], 1):
            begin = i - 1
            while stack and stack[-1][0] > now:
                depth, begin = stack.pop()
                a, b = at + begin, at + i
                part, docs = cover[a:b], owner[a:b]
                np.maximum(part, np.where(docs > docs.min(), depth, 0), out=part)
                if all_nodes:
                    lefts = left[a:b]
                    if lefts.min() < 0 or lefts.min() != lefts.max():
                        nodes.append((depth, piece[a:b], offset[a:b]))
            if now >= least and (not stack or stack[-1][0] < now):
                stack.append((now, begin))
    hit = np.flatnonzero(cover)
    return (piece[hit], offset[hit], cover[hit]), nodes


def _slices(key: np.ndarray, most: int) -> list[slice]:
    """Cuts of sorted keys into parts of about `most` rows, never inside a key."""
    edges = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True]) if len(key) else np.zeros(1, np.int64)
    out, begin = [], 0
    while begin < len(key):
        end = edges[np.searchsorted(edges, begin + most)] if begin + most < len(key) else len(key)
        out.append(slice(int(begin), int(end)))
        begin = end
    return out


def _blocks(docs: DataFrame, block_bytes: int) -> DataFrame:
    """Documents (doc_id, text) in compressed blocks: block, size, ids, sizes, data."""
    def gather(frames):
        import pandas as pd
        import zstandard
        from pyspark import TaskContext

        context = TaskContext.get()
        base, number = (context.partitionId() if context else 0) << 32, 0
        pack = zstandard.ZstdCompressor(level=1)
        ids: list[int] = []
        parts: list[bytes] = []
        filled = 0

        def row():
            return pd.DataFrame({"block": [base + number], "size": [filled], "ids": [np.array(ids, "<i8").tobytes()],
                                 "sizes": [np.array([len(p) for p in parts], "<i8").tobytes()],
                                 "data": [pack.compress(b"".join(parts))]})

        for frame in frames:
            for doc, text in zip(frame["doc_id"], frame["text"]):
                raw = text.encode()
                if parts and filled + len(raw) > block_bytes:
                    yield row()
                    number, filled, ids, parts = number + 1, 0, [], []
                ids.append(doc)
                parts.append(raw)
                filled += len(raw)
        if parts:
            yield row()

    return materialise(docs.mapInPandas(gather, "block long, size long, ids binary, sizes binary, data binary"), "text-blocks")


def _opened(ids: bytes, sizes: bytes, data: bytes) -> tuple[bytes, np.ndarray, np.ndarray]:
    import zstandard

    sizes = np.frombuffer(sizes, "<i8")
    raw = zstandard.ZstdDecompressor().decompress(data, max_output_size=max(1, int(sizes.sum())))
    return raw, np.frombuffer(ids, "<i8"), sizes


def _shared_keys(blocks: DataFrame, least: int, buckets: int, most: int) -> DataFrame:
    """block, answers: for each bucket, which of the hashes that the block sent there more than one document has.

    hot: which of these lead more than `most` distinct pieces, as told by 16 bits of their content; empty if none.
    """
    def send(frames):
        import pandas as pd

        for frame in frames:
            for block, ids, sizes, data in zip(frame["block"], frame["ids"], frame["sizes"], frame["data"]):
                raw, ids, sizes = _opened(ids, sizes, data)
                data = np.frombuffer(raw, np.uint8)
                start, length, key, doc = pieces_of(data, sizes, least)
                if not len(key):
                    continue
                # the key, and in its unused bits some of the content
                key = (key & _SENT) | (_content_hash(data, start, length, least) & ~_SENT)
                order = np.argsort(key, kind="stable")
                key, doc = key[order], ids[doc[order]]
                head = _edges(key & _SENT)[:-1]
                many = np.minimum.reduceat(doc, head) != np.maximum.reduceat(doc, head)
                bucket = _buckets_of(key[head], buckets)
                edge = _edges(bucket)
                key = key[_edges(key)[:-1]]
                cut = _edges(_buckets_of(key, buckets))
                yield pd.DataFrame({
                    "bucket": bucket[edge[:-1]], "block": block,
                    "keys": [key[a:b].astype(">u8").tobytes() for a, b in zip(cut, cut[1:])],
                    "many": [np.packbits(many[a:b]).tobytes() for a, b in zip(edge, edge[1:])],
                })

    def answer(key, frame):
        import pandas as pd

        values = np.frombuffer(b"".join(frame["keys"]), ">u8").astype(np.uint64)
        part = np.repeat(np.arange(len(frame)), [len(k) // 8 for k in frame["keys"]])
        keys = values & _SENT
        head = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]) | (part[1:] != part[:-1])])
        keys, sizes = keys[head], np.bincount(part[head], minlength=len(frame))
        many = np.concatenate([np.unpackbits(np.frombuffer(m, np.uint8), count=n) for m, n in zip(frame["many"], sizes)])
        order = np.argsort(keys, kind="stable")
        edge = _edges(keys[order])
        size = np.diff(edge)
        shared = np.zeros(len(keys), bool)  # by two blocks, or by two documents of one
        shared[order] = np.repeat((size > 1) | (np.add.reduceat(many[order].astype(np.int64), edge[:-1]) > 0), size)
        values.sort()
        values = values[_edges(values)[:-1]] & _SENT
        runs = _edges(values)
        hot = shared & np.isin(keys, values[runs[:-1]][np.diff(runs) > most])
        cuts = np.cumsum(sizes)[:-1]
        parts, hots = np.split(shared, cuts), np.split(hot, cuts)
        out = pd.DataFrame({"block": frame["block"], "bucket": int(key[0]), "bits": [np.packbits(p).tobytes() for p in parts],
                            "hot": [np.packbits(p).tobytes() if p.any() else b"" for p in hots]})
        return out[[bool(p.any()) for p in parts]]

    sent = blocks.mapInPandas(send, "bucket long, block long, keys binary, many binary")
    back = sent.groupBy("bucket").applyInPandas(answer, "block long, bucket long, bits binary, hot binary")
    return materialise(back.groupBy("block").agg(F.collect_list(F.struct("bucket", "bits", "hot")).alias("answers")), "shared-keys")


def _sent_pieces(blocks: DataFrame, shared: DataFrame, least: int, key_buckets: int, buckets: int, every: bool) -> DataFrame:
    """Per bucket and block the shared pieces, packed; one for each content of the block unless `every`."""
    def send(frames):
        import pandas as pd

        for frame in frames:
            for block, ids, sizes, data, answers in zip(*(frame[c] for c in ("block", "ids", "sizes", "data", "answers"))):
                if answers is None:
                    continue
                part = Block(*_opened(ids, sizes, data), answers, key_buckets, least)
                chosen = np.arange(len(part.start)) if every else part.speakers
                if not len(chosen):
                    continue
                bucket = _buckets_of(part.key[chosen], buckets)
                order = np.argsort(bucket, kind="stable")
                bucket, chosen = bucket[order], chosen[order]
                edge = _edges(bucket)
                take = [chosen[a:b] for a, b in zip(edge, edge[1:])]
                width = np.arange(part.rows.shape[1])
                yield pd.DataFrame({
                    "bucket": bucket[edge[:-1]], "block": block,
                    "content": [_packed(part.rows[t][width < part.length[t][:, None]]) for t in take],
                    "length": [part.length[t].astype(np.uint8).tobytes() for t in take],
                    "key": [(part.key[t] >> np.uint64(16)).astype("<u4").tobytes() for t in take],
                    "doc": [_packed(part.doc[t]) for t in take],
                    "start": [_packed(part.start[t].astype("<u4")) for t in take],
                })

    schema = "bucket long, block long, content binary, length binary, key binary, doc binary, start binary"
    # the outer join is the one of the last step, which can so read the same shuffled blocks
    both = blocks.join(shared.hint("merge"), "block", "left").select("block", "ids", "sizes", "data", "answers")
    return both.mapInPandas(send, schema)


def _met_pieces(frame, least: int):
    """The pieces of a bucket, sorted by key: rows, length, key, doc, start, block."""
    length = np.frombuffer(b"".join(frame["length"]), np.uint8).astype(np.int64)
    key = np.frombuffer(b"".join(frame["key"]), "<u4")  # enough to keep equal leading grams, or equal windows, together
    doc, start = _unpacked(frame["doc"], np.int64), _unpacked(frame["start"], "<u4").astype(np.int64)
    block = np.repeat(frame["block"].to_numpy(np.int64), [len(x) for x in frame["length"]])
    width = 2 * least - GRAM
    rows = np.zeros((len(length), width), np.uint8)
    rows[np.arange(width) < length[:, None]] = _unpacked(frame["content"], np.uint8)
    order = np.lexsort((start, block, key))
    return rows[order], length[order], key[order], doc[order], start[order], block[order]


def _sized(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(LOWEST)).alias("doc_id"), whole_text(text_col).alias("text"))


def _prepared(docs: DataFrame, least: int, block_bytes: int, hot: int) -> tuple[DataFrame, DataFrame, int, int]:
    if not GRAM <= least <= 120:
        raise ValueError(f"a repeat is between {GRAM} and 120 bytes at least")
    blocks = _blocks(docs, block_bytes)
    total = blocks.agg(F.sum("size")).first()[0] or 0
    key_buckets = max(1, math.ceil(total / KEY_BUCKET_BYTES))
    return blocks, _shared_keys(blocks, least, key_buckets, hot), key_buckets, max(1, math.ceil(total / PIECE_BUCKET_BYTES))


def repeat_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 50,
                  block_bytes: int = BLOCK_BYTES, hot: int = HOT) -> DataFrame:
    """Repeats with all occurrences: group_id, length, doc_id, start (bytes in the document).

    A group is an interval of the suffix array that cannot be extended to the left, over at least two documents, seen
    through pieces: a longer repeat appears as overlapping groups of at most 2 * least - 16 bytes, which together
    cover it, and as groups of `least` bytes where a leading gram has more than `hot` distinct pieces. Missing texts are empty; a missing doc_id is an id below all others; repeated rows are one document.
    """
    blocks, shared, key_buckets, buckets = _prepared(_sized(docs, id_col, text_col), least, block_bytes, hot)

    def scan(key, frame):
        import pandas as pd

        rows, length, grams, doc, start, block = _met_pieces(frame, least)
        out, number = [], 0
        for cut in _slices(grams, SLICE):
            _, nodes = suffix_intervals(rows[cut], length[cut], doc[cut], least, all_nodes=True)
            for depth, piece, offset in nodes:
                at = piece + cut.start
                out.append(pd.DataFrame({"group_id": (int(key[0]) << 32) + number, "length": depth, "doc_id": doc[at],
                                         "block": block[at], "start": start[at] + offset}))
                number += 1
        names = ["group_id", "length", "doc_id", "block", "start"]
        return pd.concat(out)[names] if out else pd.DataFrame({n: np.zeros(0, np.int64) for n in names})

    found = _sent_pieces(blocks, shared, least, key_buckets, buckets, True).groupBy("bucket").applyInPandas(
        scan, "group_id long, length long, doc_id long, block long, start long")

    def places(frames):
        for frame in frames:
            sizes = [np.frombuffer(s, "<i8") for s in frame["sizes"]]
            first = [int((np.cumsum(s) - s)[np.searchsorted(np.cumsum(s), at, side="right")]) for s, at in zip(sizes, frame["start"])]
            frame["start"] = frame["start"] - first
            yield frame[["group_id", "length", "doc_id", "start"]]

    located = found.join(blocks.select("block", "sizes"), "block").select("group_id", "length", "doc_id", "start", "sizes")
    out = located.mapInPandas(places, "group_id long, length long, doc_id long, start long").distinct()
    return out.withColumn("doc_id", F.when(F.col("doc_id") != LOWEST, F.col("doc_id")))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 50,
                   keep_text: bool = False, block_bytes: int = BLOCK_BYTES, hot: int = HOT) -> DataFrame:
    """Removes every byte covered by a string of `least` bytes that also starts in a document with a smaller id.

    Returns doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 and, with keep_text, row_key (hash
    of the whole text) and text: what is left, where a character that is removed in part stays whole. Strings are
    judged on the input. A missing text is empty; a missing doc_id is below all others; rows that share an id never
    count against each other and each give a row.
    """
    blocks, shared, key_buckets, buckets = _prepared(_sized(docs, id_col, text_col), least, block_bytes, hot)

    def scan(frame):
        import pandas as pd

        rows, length, grams, doc, start, block = _met_pieces(frame, least)
        found = [(np.zeros(0, np.int64),) * 4]
        for cut in _slices(grams, SLICE):
            (piece, offset, size), _ = suffix_intervals(rows[cut], length[cut], doc[cut], least)
            at = piece + cut.start
            found.append((block[at], start[at], offset, size))
        of, first, offset, size = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((offset, first, of))
        of, first, offset, size = of[order], first[order], offset[order], size[order]
        edge = np.flatnonzero(np.r_[True, of[1:] != of[:-1], True]) if len(of) else np.zeros(1, np.int64)
        parts = list(zip(edge, edge[1:]))
        return pd.DataFrame({"block": of[edge[:-1]], "first": [first[a:b].tobytes() for a, b in parts],
                             "offset": [offset[a:b].astype(np.uint8).tobytes() for a, b in parts],
                             "covered": [size[a:b].astype(np.uint8).tobytes() for a, b in parts]})

    met = _sent_pieces(blocks, shared, least, key_buckets, buckets, False).groupBy("bucket").applyInPandas(
        scan, "block long, first binary, offset binary, covered binary")
    stretches = met.groupBy("block").agg(F.collect_list(F.struct("first", "offset", "covered")).alias("stretches"))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    schema += ", whole binary, text string" if keep_text else ""

    def cut(frames):
        import hashlib

        import pandas as pd

        for frame in frames:
            for block, ids, sizes, data, answers, found in zip(*(frame[c] for c in ("block", "ids", "sizes", "data", "answers", "stretches"))):
                raw, ids, sizes = _opened(ids, sizes, data)
                delta = np.zeros(len(raw) + 1, np.int64)
                if answers is not None:
                    part = Block(raw, ids, sizes, answers, key_buckets, least)
                    np.add.at(delta, part.start[part.later], 1)
                    np.add.at(delta, (part.start + part.length)[part.later], -1)
                    if found is not None and len(found):
                        join = lambda name, kind: np.frombuffer(b"".join(s[name] for s in found), kind).astype(np.int64)
                        first, offset, size = join("first", np.int64), join("offset", np.uint8), join("covered", np.uint8)
                        # what holds for the piece that was sent holds for its equals in the same document
                        order = np.argsort(first, kind="stable")
                        first, offset, size = first[order], offset[order], size[order]
                        own = np.flatnonzero(part.speaker >= 0)
                        asked = part.start[part.speaker[own]]
                        lo, hi = np.searchsorted(first, asked), np.searchsorted(first, asked, side="right")
                        n = hi - lo
                        where = np.arange(int(n.sum())) + np.repeat(lo - (np.cumsum(n) - n), n)
                        begin = np.repeat(part.start[own], n) + offset[where]
                        np.add.at(delta, begin, 1)
                        np.add.at(delta, begin + size[where], -1)
                gone = np.cumsum(delta[:-1]) > 0
                yield _documents(raw, ids, sizes, gone, keep_text, pd, hashlib)

    both = blocks.join(shared.hint("merge"), "block", "left").join(stretches.hint("merge"), "block", "left")
    done = both.select("block", "ids", "sizes", "data", "answers", "stretches").mapInPandas(cut, schema)
    if keep_text:
        done = done.withColumn("row_key", F.xxhash64(F.col("whole").cast("string"))).drop("whole")
    return done.withColumn("doc_id", F.when(F.col("doc_id") != LOWEST, F.col("doc_id")))


def _documents(raw: bytes, ids: np.ndarray, sizes: np.ndarray, gone: np.ndarray, keep_text: bool, pd, hashlib):
    data = np.frombuffer(raw, np.uint8)
    ends = np.cumsum(sizes)
    rows = []
    for doc, a, b in zip(ids.tolist(), (ends - sizes).tolist(), ends.tolist()):
        out = gone[a:b]
        removed = int(out.sum())
        spans = int((out & ~np.r_[False, out[:-1]]).sum()) if removed else 0
        kept = data[a:b][~out].tobytes() if removed else raw[a:b]
        row = (doc, b - a, removed, spans, hashlib.sha256(kept).hexdigest())
        if keep_text:
            if removed:  # a character of which a byte stays keeps all its bytes
                lead = np.flatnonzero((data[a:b] & 0xC0) != 0x80)
                whole = np.logical_and.reduceat(out, lead)
                kept = data[a:b][~np.repeat(whole, np.diff(np.r_[lead, b - a]))].tobytes()
            row += (raw[a:b], kept.decode())
        rows.append(row)
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + (["whole", "text"] if keep_text else [])
    return pd.DataFrame(rows, columns=names)
