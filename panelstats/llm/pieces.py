"""SentencePiece encoding and decoding by a walk over a trie of marked words.

Blanks become the mark, texts fall apart before each run of marks (no piece of the vocabulary has a mark behind another
character), and each distinct marked word is encoded once: the words are sorted into a trie and walked depth
first, every prefix taking over the forward states of the prefix it shares with the word before.

A vocabulary of merged pairs is not encoded by the path of the largest score, so the forward state of a prefix is not a
score but the last piece and the number of pieces of the prefix's encoding (`forward`); the ids equal the library's.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame

from panelstats.llm import bytelevel, forward
from panelstats.llm.common import documents_of
from panelstats.llm.counts import batches

MARK = 0x2581


def read_pieces(file: str) -> dict:
    """Ids of the ordinary pieces, their scores, the byte pieces, and what each id stands for in bytes."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=file)
    pieces, scores, fallback, content = {}, {}, [0] * 256, []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            fallback[int(piece[3:5], 16)] = i
            content.append(bytes([int(piece[3:5], 16)]))
        elif model.is_control(i) or model.is_unknown(i):
            content.append(b"")
        else:
            pieces[piece], scores[i] = i, model.get_score(i)
            content.append(piece.replace(chr(MARK), " ").encode())
    return {"pieces": pieces, "scores": scores, "bytes": fallback, "content": content, "size": model.get_piece_size()}


class Encoder:
    """Ids of whole texts."""

    def __init__(self, spec: dict, states: forward.Forward) -> None:
        self.states, self.fallback = states, spec["bytes"]
        self.length = {i: len(p) for p, i in spec["pieces"].items()}
        self.words = bytelevel.Words(self._make)

    def _make(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        texts = [w.decode() for w in words]
        order = sorted(range(len(texts)), key=texts.__getitem__)
        found: list = [None] * len(texts)
        for k, (word, last, _) in zip(order, self.states.walk(map(texts.__getitem__, order))):
            ids = forward.trace(word, last, self.length)
            if min(ids) < 0:  # characters without a piece: their bytes
                ids = [x for i in ids for x in ([i] if i >= 0 else [self.fallback[b] for b in chr(-2 - i).encode()])]
            found[k] = ids
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter((i for f in found for i in f), np.int64, int(sizes.sum())), np.r_[0, np.cumsum(sizes)]

    def encode(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts and the number of ids of each; a text with characters gets a mark in front."""
        points = np.frombuffer("".join(" " + t if t else "" for t in texts).encode("utf-32-le"), np.uint32).copy()
        points[points == 32] = MARK
        if not len(points):
            return np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
        mark = points == MARK
        ends = np.cumsum(np.fromiter((len(t) + 1 if t else 0 for t in texts), np.int64, len(texts)))
        first = np.zeros(len(points) + 1, bool)
        first[np.r_[0, ends]] = True
        starts = np.flatnonzero(first[:-1] | (mark & ~np.r_[False, mark[:-1]]))
        flat, sizes = self.words.gather(self.words.look_up(points, starts))
        of = np.searchsorted(ends, starts, side="right")
        return flat, np.bincount(of, weights=sizes, minlength=len(texts)).astype(np.int64)


class Decoder:
    """Texts of ids."""

    def __init__(self, spec: dict) -> None:
        self.flat = np.frombuffer(b"".join(spec["content"]), np.uint8)
        self.offsets = np.r_[0, np.cumsum(np.fromiter(map(len, spec["content"]), np.int64, len(spec["content"])))]

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        sizes = self.offsets[ids + 1] - self.offsets[ids]
        ends = np.cumsum(sizes)
        shift = np.repeat(self.offsets[ids] - (ends - sizes), sizes)
        raw = self.flat[np.arange(len(shift)) + shift].tobytes()
        stop = np.r_[0, ends][np.r_[0, np.cumsum(counts)]].tolist()
        return [raw[a:b].decode("utf-8", "replace")[1 if raw[a:a + 1] == b" " else 0:] for a, b in zip(stop, stop[1:])]


_KEPT: dict[str, tuple[Encoder, Decoder]] = {}  # one vocabulary at a time; `Words` bounds what it remembers


def coders(file: str, spec: dict, states: forward.Forward) -> tuple[Encoder, Decoder]:
    """Encoder and decoder of a vocabulary; a worker process keeps them, so later tasks find the words of earlier ones."""
    if file not in _KEPT:
        _KEPT.clear()
        _KEPT[file] = Encoder(spec, states), Decoder(spec)
    return _KEPT[file]


def encode(docs: DataFrame, file: str, id_col: str = "doc_id", text_col: str = "text",
           keep_ids: bool = True) -> DataFrame:
    """doc_id, n_pieces, ids_crc32 (unsigned, little-endian 32-bit ids), round_trip and, unless declined, ids.

    round_trip: decoding gives the text back; false only where the text itself holds the mark. A missing text is empty
    and has no pieces; a missing doc_id is kept; repeated rows each give a row.
    """
    spec = read_pieces(file)
    states = forward.from_scores(spec["pieces"], spec["scores"], spec["size"])
    shared = docs.sparkSession.sparkContext.broadcast((spec, states))  # as large as the vocabulary
    schema = "doc_id long, n_pieces long, ids_crc32 long, round_trip boolean" + (", ids array<int>" if keep_ids else "")

    def run(frames):
        import zlib

        import pandas as pd

        spec, states = shared.value
        encoder, decoder = coders(file, spec, states)
        for frame in frames:
            texts = frame["text"].tolist()
            for part in batches(texts):
                flat, counts = encoder.encode(texts[part])
                back = decoder.decode(flat, counts)
                ends = np.r_[0, np.cumsum(counts)].tolist()
                raw = flat.astype("<u4")
                out = pd.DataFrame({
                    "doc_id": frame["doc_id"].iloc[part].array,
                    "n_pieces": counts,
                    "ids_crc32": [zlib.crc32(raw[a:b].tobytes()) for a, b in zip(ends, ends[1:])],
                    "round_trip": [a == b for a, b in zip(back, texts[part])],
                })
                if keep_ids:
                    out["ids"] = [flat[a:b].astype(np.int32) for a, b in zip(ends, ends[1:])]
                yield out

    return documents_of(docs, id_col, text_col).mapInPandas(run, schema)


def decode(rows: DataFrame, file: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, text of arrays of ids; a missing or empty array gives an empty text, control ids give nothing."""
    from pyspark.sql import functions as F

    shared = rows.sparkSession.sparkContext.broadcast(read_pieces(file))

    def run(frames):
        import pandas as pd

        decoder = Decoder(shared.value)
        for frame in frames:
            arrays = [np.asarray(a, np.int64) for a in frame["ids"]]
            flat = np.concatenate([np.zeros(0, np.int64), *arrays])
            yield pd.DataFrame({"doc_id": frame["doc_id"], "text": decoder.decode(flat, np.array([len(a) for a in arrays], np.int64))})

    chosen = rows.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"),
                         F.coalesce(F.col(f"`{ids_col}`").cast("array<long>"), F.array().cast("array<long>")).alias("ids"))
    return chosen.mapInPandas(run, "doc_id long, text string")
