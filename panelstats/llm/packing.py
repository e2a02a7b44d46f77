"""Vector bin packing: pieces of documents into sequences under limits on tokens, segments and loss-bearing tokens.

Items are dealt to blocks by a hash of their key; the number of blocks grows with the items, so a block holds about
`block_items` of them. Within a block a sequence is filled greedily: of the items that still fit in every dimension,
the one with the largest dot product of its demand and what is left of the sequence goes next, each dimension weighted
by its mean demand. Items with equal demand are one kind, so a step looks at kinds, not items.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelstats.llm import bytelevel
from panelstats.llm.common import documents_of
from panelstats.llm.counts import batches
from panelstats.session import materialise


def fill(demands: np.ndarray, limits: Sequence[float]) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and place within it of each item (rows of demands, one column for each limit)."""
    limits = np.asarray(limits, np.float64)
    sequence, place = np.full(len(demands), -1, np.int64), np.zeros(len(demands), np.int64)
    if not len(demands):
        return sequence, place
    kinds, kind_of = np.unique(demands, axis=0, return_inverse=True)
    kind_of = kind_of.ravel()
    share = kinds / limits
    if (share > 1).any():
        raise ValueError("an item exceeds a limit by itself")
    weight = np.average(share, axis=0, weights=np.bincount(kind_of))
    order = np.argsort(kind_of, kind="stable")
    ends = np.cumsum(np.bincount(kind_of))
    begins = np.r_[0, ends[:-1]]
    here = np.arange(len(kinds))
    number = 0
    while len(here):
        left, nth = np.ones(len(limits)), 0
        fits = here
        while len(fits):
            fits = fits[(share[fits] <= left + 1e-9).all(axis=1)]
            if not len(fits):
                break
            k = fits[np.argmax(share[fits] @ (left * weight))]
            item = order[begins[k]]
            sequence[item], place[item] = number, nth
            left, nth = left - share[k], nth + 1
            begins[k] += 1
            if begins[k] == ends[k]:
                here, fits = here[here != k], fits[fits != k]
        number += 1
    return sequence, place


def pack(items: DataFrame, key: Sequence[str], demands: Sequence[str], limits: Sequence[int],
         block_items: int = 8192) -> DataFrame:
    """The items with sequence_id, place (from 0) and offset (sum of the first demand before it in the sequence).

    `key` must tell the items apart; items that agree in it are ordered by all their columns. Demands must be whole
    numbers between 0 and the limit; a missing demand counts as 0. Items of an empty table give an empty table.
    """
    items = items.withColumn("block_", F.xxhash64(*key))
    blocks = max(1, math.ceil(items.count() / block_items))
    items = items.withColumn("block_", F.pmod("block_", F.lit(blocks)))
    names = [c for c in items.columns if c != "block_"]
    schema = items.drop("block_").schema
    for name in ("sequence_id", "place", "offset"):
        schema = schema.add(name, "long")
    key, demands, limits = list(key), list(demands), list(limits)

    def run(block, frame):
        frame = frame.sort_values([*key, *[c for c in names if c not in key]], ignore_index=True)
        need = frame[demands].fillna(0).to_numpy(np.float64)
        sequence, place = fill(need, limits)
        order = np.lexsort((place, sequence))
        size, of = need[order, 0], sequence[order]
        before = np.cumsum(size) - size
        head = np.r_[True, of[1:] != of[:-1]]
        offset = np.empty(len(order))
        offset[order] = before - np.repeat(before[head], np.diff(np.r_[np.flatnonzero(head), len(order)]))
        frame["sequence_id"] = (int(block[0]) << 32) + sequence
        frame["place"] = place
        frame["offset"] = offset.astype(np.int64)
        return frame[[*names, "sequence_id", "place", "offset"]]

    return items.groupBy("block_").applyInPandas(run, schema)


def document_pieces(docs: DataFrame, file: str, end_id: int, most: int, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """Token pieces of at most `most` ids: doc_id, start, length, ids_crc32, doc_tokens, copy.

    A document's ids are those of its text, then `end_id`, so an empty or missing text has one id. `copy` numbers
    rows within their batch and tells repeated rows apart.
    """
    vocabulary = docs.sparkSession.sparkContext.broadcast(bytelevel.read_vocabulary(file))  # as large as the file

    def run(frames):
        import zlib

        import pandas as pd

        encoder, seen = bytelevel.Encoder(vocabulary.value), 0
        for frame in frames:
            texts, ids = frame["text"].tolist(), frame["doc_id"].array
            for part in batches(texts):
                flat, counts = encoder.encode(texts[part])
                out, owner, begin = [], [], 0
                for k, n in enumerate(counts.tolist(), part.start):
                    raw = np.append(flat[begin:begin + n], end_id).astype("<u4").tobytes()
                    begin += n
                    for start in range(0, n + 1, most):
                        length = min(most, n + 1 - start)
                        owner.append(k)
                        out.append((start, length, zlib.crc32(memoryview(raw)[4 * start:4 * (start + length)]), n + 1, seen + k))
                pieces = pd.DataFrame(out, columns=["start", "length", "ids_crc32", "doc_tokens", "copy"])
                pieces.insert(0, "doc_id", ids[owner])
                yield pieces
            seen += len(texts)

    return documents_of(docs, id_col, text_col).mapInPandas(
        run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, copy long")


def pack_documents(docs: DataFrame, file: str, end_id: int = 0, most_tokens: int = 1024, most_segments: int = 256,
                   most_loss: int | None = None, id_col: str = "doc_id", text_col: str = "text",
                   block_items: int = 8192) -> DataFrame:
    """Every id of every document in exactly one piece, pieces packed into sequences of at most `most_tokens` ids.

    Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, loss_tokens. Each id but the closing one
    of a document bears loss. Missing texts are empty, a missing doc_id is kept, repeated rows are packed each.
    """
    pieces = materialise(document_pieces(docs, file, end_id, most_tokens, id_col, text_col), "pieces")
    closing = (F.col("start") + F.col("length") == F.col("doc_tokens")).cast("long")
    items = pieces.withColumn("loss_tokens", F.col("length") - closing).withColumn("segments", F.lit(1).cast("long"))
    packed = pack(items, ["doc_id", "start", "copy", "ids_crc32"], ["length", "segments", "loss_tokens"],
                  [most_tokens, most_segments, most_loss or most_tokens], block_items)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens")


def pack_turns(turns: DataFrame, file: str, most_tokens: int, most_segments: int, most_loss: int,
               conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
               loss_role: str = "assistant", block_items: int = 8192) -> DataFrame:
    """Instruction data: turns as segments, of which those of `loss_role` bear loss; longer ones are cut.

    Returns conv_id, turn, start, length, loss_tokens, sequence_id, offset.
    """
    rows = turns.select(F.col(f"`{conversation}`").cast("long").alias("conv_id"),
                        F.col(f"`{turn}`").cast("long").alias("turn"), F.col(f"`{role}`").alias("role"),
                        F.col(f"`{text}`").alias("text"))
    rows = materialise(rows.withColumn("doc_id", F.monotonically_increasing_id()), "turns")
    cut = min(most_tokens, most_loss)
    pieces = document_pieces(rows, file, 0, cut)
    items = pieces.join(rows.select("doc_id", "conv_id", "turn", "role"), "doc_id").select(
        "doc_id", "conv_id", "turn", "start", "length", F.lit(1).cast("long").alias("segments"),
        F.when(F.col("role") == loss_role, F.col("length")).otherwise(0).cast("long").alias("loss_tokens"))
    packed = pack(materialise(items, "items"), ["doc_id", "start"], ["length", "segments", "loss_tokens"],
                  [most_tokens, most_segments, most_loss], block_items)
    return packed.select("conv_id", "turn", "start", "length", "loss_tokens", "sequence_id", "offset")
