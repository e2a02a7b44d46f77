"""Exact token counts at every prefix, from which truncation and budget questions are answered without encoding again.

For each distinct word of a task the number of tokens of each of its prefixes is computed once (`forward`, words sorted
and walked as a trie). A text's table is the running sum over its words plus the word's own table. Where a cut changes
how the text before it falls into words - at the end of white space, or inside a contraction - the entry is that of
the cut text, so each entry is what the tokenizer library gives for the prefix alone.

`store` writes the tables, a byte or so for each byte of text before compression. `answer` (what fits into a budget),
`tokens_before` (what a prefix costs) read them; no tokenizer takes part.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelstats.llm import bytelevel, forward
from panelstats.llm.common import documents_of
from panelstats.session import new_folder

BATCH_CHARS = 3_000_000  # texts handled together in a task; a longer text makes a batch of its own


def batches(texts: Sequence[str], most: int = BATCH_CHARS) -> Iterator[slice]:
    """Slices of the texts that hold about `most` characters."""
    begin, size = 0, 0
    for k, t in enumerate(texts):
        if size and size + len(t) > most:
            yield slice(begin, k)
            begin, size = k, 0
        size += len(t)
    if begin < len(texts):
        yield slice(begin, len(texts))


class Prefixes:
    """Tables of token counts by prefix."""

    def __init__(self, vocabulary: dict) -> None:
        self.special = vocabulary["special"]
        self.states = forward.from_merges(vocabulary)
        self.splitter = bytelevel.Splitter()
        self.words = bytelevel.Words(self._make)

    def _make(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        order = sorted(range(len(words)), key=words.__getitem__)
        tables: list = [None] * len(words)
        for k, (_, _, count) in zip(order, self.states.walk(map(words.__getitem__, order))):
            tables[k] = count[1:]
        flat = np.fromiter((c for t in tables for c in t), np.int64, sum(map(len, words)))
        return flat, np.r_[0, np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))]

    def _plain(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Counts for prefixes of 1 byte, 2 bytes, … of each text, one after the other; and the texts' sizes."""
        points, starts, of = self.splitter.split(texts)
        n = len(points)
        if not n:
            return np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
        inner, sizes = self.words.gather(self.words.look_up(points, starts))
        stop = np.cumsum(sizes)
        whole = inner[stop - 1]
        before = np.cumsum(whole) - whole
        text_first = np.r_[True, of[1:] != of[:-1]]
        base = before - np.repeat(before[text_first], np.diff(np.r_[np.flatnonzero(text_first), len(of)]))
        table = inner + np.repeat(base, sizes)
        at = np.r_[0, np.cumsum(1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000))]  # bytes before a point
        # white space that goes on in the next word: cut behind it, it is one word
        stops = np.r_[starts[1:], n]
        blank = self.splitter._classes(points) == bytelevel.SPACE
        head = np.flatnonzero(blank[starts] & blank[stops - 1])  # words of white space only
        after = head + 1
        ok = (after < len(starts))
        head, after = head[ok], after[ok]
        ok = (of[after] == of[head]) & blank[starts[after]]
        head, after = head[ok], after[ok]
        if len(head):
            a, b = starts[head], starts[after] + 1
            run = np.concatenate([points[x:y] for x, y in zip(a.tolist(), b.tolist())])
            extra, width = self.words.gather(self.words.look_up(run, np.r_[0, np.cumsum(b - a)[:-1]]))
            table[at[b] - 1] = base[head] + extra[np.cumsum(width) - 1]
        # the first letter of a contraction of two letters: without the second it is a word of its own
        two = (stops - starts == 3) & (points[starts] == 39)
        for k in np.flatnonzero(two).tolist():
            s = starts[k]
            if chr(points[s + 1]) + chr(points[s + 2]) in bytelevel.CONTRACTIONS:
                table[at[s] + 1] = base[k] + 2
        return table, np.bincount(of, weights=sizes, minlength=len(texts)).astype(np.int64)

    def tables(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """As _plain, for texts that may hold special strings; a special string is one token once it is complete."""
        odd = [k for k, t in enumerate(texts) if any(s in t for s in self.special)]
        if not odd:
            return self._plain(texts)
        skip = set(odd)
        flat, sizes = self._plain(["" if k in skip else t for k, t in enumerate(texts)])
        parts = np.split(flat, np.cumsum(sizes)[:-1])
        for k in odd:
            pieces, base, out = bytelevel.apart(texts[k], list(self.special)), 0, []
            for nth, piece in enumerate(pieces):
                if nth % 2:
                    earlier = pieces[nth - 1]
                    cut = [earlier + piece[:c] for c in range(1, len(piece))]
                    table, width = self._plain(cut)
                    ends = table[np.cumsum(width) - 1] if len(cut) else table
                    start = base - (out[-1][-1] - base_before if len(earlier) else 0)
                    out.append(np.r_[ends + start, base + 1])
                    base += 1
                elif piece:
                    base_before = base
                    table, _ = self._plain([piece])
                    out.append(table + base)
                    base += int(table[-1])
            parts[k] = np.concatenate(out)
            sizes[k] = len(parts[k])
        return np.concatenate(parts), sizes


def _cut(table: np.ndarray, raw: bytes, limit: int) -> int:
    """Bytes of the longest prefix of whole characters with at most `limit` tokens."""
    code = np.frombuffer(raw, np.uint8)
    whole = np.r_[(code[1:] & 0xC0) != 0x80, True] if len(code) else np.zeros(0, bool)
    fits = np.flatnonzero((table <= limit) & whole)
    return int(fits[-1]) + 1 if len(fits) else 0


def prefix_counts(docs: DataFrame, file: str, limit: int, id_col: str = "doc_id", text_col: str = "text",
                  keep_table: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, kept_bytes and, if asked for, the whole table.

    kept_bytes: the longest prefix of whole characters with at most `limit` tokens. prefix_table: little-endian
    unsigned 32-bit counts for prefixes of 1, 2, … bytes; entries inside a character have no meaning. A missing text is
    empty, has no tokens and an empty table; a missing doc_id is kept; repeated rows each give a row.
    """
    vocabulary = docs.sparkSession.sparkContext.broadcast(bytelevel.read_vocabulary(file))  # as large as the file
    schema = "doc_id long, n_bytes long, n_tokens long, over_limit boolean, kept_bytes long"
    schema += ", prefix_table binary" if keep_table else ""

    def count(frames):
        import pandas as pd

        prefixes = Prefixes(vocabulary.value)
        for frame in frames:
            ids, texts = frame["doc_id"], frame["text"].tolist()
            for part in batches(texts):
                flat, sizes = prefixes.tables(texts[part])
                rows, end = [], 0
                for text, size in zip(texts[part], sizes.tolist()):
                    table, end = flat[end:end + size], end + size
                    total = int(table[-1]) if size else 0
                    kept = size if total <= limit else _cut(table, text.encode(), limit)
                    rows.append((size, total, total > limit, kept, *((table.astype("<u4").tobytes(),) if keep_table else ())))
                names = schema.replace(" long", "").replace(" boolean", "").replace(" binary", "").split(", ")[1:]
                out = pd.DataFrame(rows, columns=names)
                out.insert(0, "doc_id", ids.iloc[part].array)
                yield out

    return documents_of(docs, id_col, text_col).mapInPandas(count, schema)


def _steps(flat: np.ndarray, sizes: np.ndarray, raw: bytes) -> np.ndarray:
    """Differences along each text's table; the entries of a character's bytes are those of its end."""
    code = np.frombuffer(raw, np.uint8)
    inner = np.r_[(code[1:] & 0xC0) == 0x80, False] if len(code) else np.zeros(0, bool)
    if inner.any():
        ends = np.flatnonzero(~inner)
        flat = flat[ends[np.searchsorted(ends, np.arange(len(flat)))]]
    steps = np.diff(flat, prepend=0)
    first = (np.cumsum(sizes) - sizes)[sizes > 0]
    steps[first] = flat[first]
    return steps


def store(docs: DataFrame, file: str, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the prefix table of every text below `path` (by default in the shared folder) and reads it back.

    doc_id, n_bytes, n_tokens, step_bytes, steps: signed little-endian differences of the counts of neighbouring
    prefixes, of 1 byte each, or of 4 where a difference needs it; bytes inside a character carry the count of its end.
    A missing text is empty and has no steps; a missing doc_id is kept; repeated rows each give a row; an empty table
    gives an empty table.
    """
    vocabulary = docs.sparkSession.sparkContext.broadcast(bytelevel.read_vocabulary(file))  # as large as the file
    schema = "doc_id long, n_bytes long, n_tokens long, step_bytes int, steps binary"

    def tables(frames):
        import pandas as pd

        prefixes = Prefixes(vocabulary.value)
        for frame in frames:
            ids, texts = frame["doc_id"], frame["text"].tolist()
            for part in batches(texts):
                flat, sizes = prefixes.tables(texts[part])
                steps, end, rows = _steps(flat, sizes, "".join(texts[part]).encode()), 0, []
                small = bool(len(steps)) and -128 <= steps.min() and steps.max() <= 127
                narrow = steps.astype("<i1") if small else None
                for size in sizes.tolist():
                    own, end = slice(end, end + size), end + size
                    one = small or not size or (-128 <= steps[own].min() and steps[own].max() <= 127)
                    held = narrow[own] if small else steps[own].astype("<i1" if one else "<i4")
                    rows.append((size, int(flat[end - 1]) if size else 0, 1 if one else 4, held.tobytes()))
                out = pd.DataFrame(rows, columns=["n_bytes", "n_tokens", "step_bytes", "steps"])
                out.insert(0, "doc_id", ids.iloc[part].array)
                yield out

    path = path or new_folder(docs.sparkSession, "prefix-counts")
    documents_of(docs, id_col, text_col).mapInPandas(tables, schema).write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(schema).parquet(path)


@F.pandas_udf(T.ArrayType(T.LongType()))
def _fitting(steps, step_bytes, limits):
    """For each limit, the bytes of the longest prefix with at most so many tokens."""
    import pandas as pd

    out = []
    for held, width, asked in zip(steps, step_bytes, limits):
        table = np.cumsum(np.frombuffer(held, f"<i{width}"), dtype=np.int64)
        # the least count from a place to the end says whether a later place fits
        least = np.minimum.accumulate(table[::-1])[::-1]
        out.append(np.searchsorted(least, np.asarray(asked, np.int64), side="right"))
    return pd.Series(out)


@F.pandas_udf(T.ArrayType(T.LongType()))
def _counted(steps, step_bytes, places):
    import pandas as pd

    out = []
    for held, width, asked in zip(steps, step_bytes, places):
        table = np.r_[0, np.cumsum(np.frombuffer(held, f"<i{width}"), dtype=np.int64)]
        out.append(table[np.clip(np.asarray(asked, np.int64), 0, len(table) - 1)])
    return pd.Series(out)


def answer(table: DataFrame, limits: Sequence[int]) -> DataFrame:
    """doc_id, n_bytes, n_tokens, limit, over_limit, kept_bytes: a row for each row of a stored table and each limit.

    kept_bytes: the longest prefix of whole characters with at most `limit` tokens. Only the tables of texts above the
    smallest limit are looked into. Limits may repeat and each give a row; a negative one keeps nothing. No limits give no rows.
    """
    asked = sorted(int(v) for v in limits)
    if not asked:
        return table.select("doc_id", "n_bytes", "n_tokens", F.lit(0).cast("long").alias("limit"),
                            F.lit(False).alias("over_limit"), F.col("n_bytes").alias("kept_bytes")).where(F.lit(False))
    wanted = F.array(*[F.lit(v).cast("long") for v in asked])
    long = table.where(F.col("n_tokens") > asked[0]).withColumn("kept", _fitting("steps", "step_bytes", wanted))
    short = table.where(F.col("n_tokens") <= asked[0]).withColumn("kept", F.array_repeat("n_bytes", len(asked)))
    both = long.drop("steps", "step_bytes").unionByName(short.drop("steps", "step_bytes"))
    each = both.select("doc_id", "n_bytes", "n_tokens", F.inline(F.arrays_zip(wanted.alias("limit"), F.col("kept").alias("kept_bytes"))))
    return each.select("doc_id", "n_bytes", "n_tokens", "limit", (F.col("n_tokens") > F.col("limit")).alias("over_limit"), "kept_bytes")


def tokens_before(table: DataFrame, places: Column) -> DataFrame:
    """doc_id, place, tokens: the count of the text's first `place` bytes, for each place of an array column.

    A place inside a character counts to its end, one before the text is 0, one behind it is the whole text. A missing
    array, and an empty one, give no rows.
    """
    asked = F.transform(places, lambda p: p.cast("long"))
    some = table.withColumn("_places", asked).where(F.size("_places") > 0)
    counted = some.withColumn("_tokens", _counted("steps", "step_bytes", "_places"))
    return counted.select("doc_id", F.inline(F.arrays_zip(F.col("_places").alias("place"), F.col("_tokens").alias("tokens"))))
