"""Byte-level BPE over whole batches of texts with numpy: word boundaries, distinct words, merges.

Texts are cut into the words that the vocabulary's splitting pattern gives, with array operations over code points.
Each distinct word of a task is encoded once, by merging the best pair of every word in one round over all words.
Ids equal those of the tokenizer library for the same file.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

import numpy as np

# fixed values: contractions that the splitting pattern keeps together
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
NONE = np.iinfo(np.int64).max
OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3


def read_vocabulary(file: str) -> dict:
    """Byte ids, merges in order as (left id, right id, merged id), and special tokens of a tokenizer file."""
    with open(file, encoding="utf-8") as f:
        spec = json.load(f)
    shown = {}  # how the file writes a byte: printable Latin-1 characters as they are, others from 256 on
    extra = 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            shown[b] = chr(b)
        else:
            shown[b], extra = chr(extra), extra + 1
    vocab = spec["model"]["vocab"]
    merges = []
    for m in spec["model"]["merges"]:
        left, right = m.split(" ") if isinstance(m, str) else m
        merges.append((vocab[left], vocab[right], vocab[left + right]))
    back = {c: b for b, c in shown.items()}
    return {
        "bytes": np.array([vocab[shown[b]] for b in range(256)], np.int64),
        "merges": np.array(merges, np.int64),
        "special": {t["content"]: t["id"] for t in spec["added_tokens"]},
        "content": {i: bytes(back[c] for c in piece) for piece, i in vocab.items() if all(c in back for c in piece)},
        "size": 1 + max(vocab.values()),
    }


class Splitter:
    """Word boundaries of many texts at once."""

    def __init__(self) -> None:
        import regex

        self.kinds = [(LETTER, regex.compile(r"\p{L}")), (NUMBER, regex.compile(r"\p{N}")),
                      (SPACE, regex.compile(r"\p{White_Space}"))]
        self.table = np.full(0x110000, 255, np.uint8)

    def _classes(self, points: np.ndarray) -> np.ndarray:
        got = self.table[points]
        if (got == 255).any():
            for p in np.unique(points[got == 255]).tolist():
                self.table[p] = next((k for k, r in self.kinds if r.match(chr(p))), OTHER)
            got = self.table[points]
        return got

    def split(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Code points of all texts, the positions at which words start, and the text of each word."""
        points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        n = len(points)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        if not n:
            return points, np.zeros(0, np.int64), np.zeros(0, np.int64)
        ends = np.cumsum(sizes)
        first = np.zeros(n + 1, bool)  # a text starts here
        first[np.r_[0, ends]] = True
        kind = self._classes(points)
        start = np.ones(n + 4, bool)
        start[1:n] = (kind[1:] != kind[:-1]) | first[1:n]
        runs = np.flatnonzero(start[:n])
        stops = np.r_[runs[1:], n]
        blank = kind[runs] == SPACE
        inner = blank & ~first[stops]  # white space before something else in the same text
        head, stop = runs[inner], stops[inner]
        start[stop - 1] = True  # the last character stands apart from the rest ...
        joined = points[stop - 1] == 32
        start[stop[joined]] = False  # ... and a blank belongs to what follows
        quote = runs[(points[runs] == 39) & (stops - runs == 1)]
        quote = quote[start[quote] & ~first[quote + 1]]
        if len(quote):
            padded = np.r_[points, np.zeros(4, np.uint32)]
            wide = np.r_[kind, np.full(4, OTHER, np.uint8)]
            inside = lambda k: (wide[quote + k] == LETTER) & ~first[np.minimum(quote + k, n)]
            second = inside(1) & inside(2) & ~first[np.minimum(quote + 1, n)]
            for tail in CONTRACTIONS:
                hit = (inside(1) if len(tail) == 1 else second).copy()
                for k, c in enumerate(tail):
                    hit &= padded[quote + 1 + k] == ord(c)
                q = quote[hit]
                start[q + 1] = False
                start[q + 1 + len(tail)] = True
        starts = np.flatnonzero(start[:n])
        return points, starts, np.searchsorted(ends, starts, side="right")


def word_keys(points: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A 64-bit key of each word's content: the sum of a mixed value of each code point and its place in the word."""
    size = np.diff(np.r_[starts, len(points)])
    place = (np.arange(len(points)) - np.repeat(starts, size)).astype(np.uint64)
    v = (points.astype(np.uint64) + (place << np.uint64(21)) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    v ^= v >> np.uint64(29)
    v *= np.uint64(0xD6E8FEB86659FD93)
    v ^= v >> np.uint64(32)
    key = np.add.reduceat(v, starts) if len(starts) else np.zeros(0, np.uint64)
    return (key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def same_content(left: np.ndarray, a: np.ndarray, right: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether left[a:a + size] equals right[b:b + size], for each triple; every size is at least 1."""
    if not len(size):
        return np.zeros(0, bool)
    ends = np.cumsum(size)
    place = np.arange(int(ends[-1])) - np.repeat(ends - size, size)
    return np.logical_and.reduceat(left[place + np.repeat(a, size)] == right[place + np.repeat(b, size)], ends - size)


class Merger:
    """Ids of many words at once: every round merges the best pair of each word, wherever it stands."""

    def __init__(self, vocabulary: dict) -> None:
        self.bytes = vocabulary["bytes"]
        self.size = vocabulary["size"]
        merges = vocabulary["merges"]
        self.made = merges[:, 2]
        self.bits = max(4, int(np.ceil(np.log2(len(merges) * 4 + 16))))
        self.mask = (1 << self.bits) - 1
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.full(1 << self.bits, NONE, np.int64)
        for rank, key in enumerate((merges[:, 0] * self.size + merges[:, 1]).tolist()):
            at = self._slot(key)
            while self.keys[at] >= 0:
                at = (at + 1) & self.mask
            self.keys[at], self.ranks[at] = key, rank

    def _slot(self, key):
        return ((key * 0x9E3779B1) >> 11) & self.mask

    def _rank(self, keys: np.ndarray) -> np.ndarray:
        at = self._slot(keys)
        out = np.full(len(keys), NONE, np.int64)
        open_ = np.arange(len(keys))
        while len(open_):
            there = self.keys[at[open_]]
            hit = there == keys[open_]
            out[open_[hit]] = self.ranks[at[open_[hit]]]
            open_ = open_[~hit & (there >= 0)]
            at[open_] = (at[open_] + 1) & self.mask
        return out

    def encode(self, words: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and the offset at which each word's ids start (one more at the end)."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ids = self.bytes[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), sizes)
        done_ids, done_words = [], []
        while len(ids):
            pair = np.flatnonzero(word[1:] == word[:-1])
            rank = self._rank(ids[pair] * self.size + ids[pair + 1])
            known = rank < NONE
            pair, rank = pair[known], rank[known]
            if not len(pair):
                break
            owner = word[pair]
            head = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            best = np.repeat(np.minimum.reduceat(rank, head), np.diff(np.r_[head, len(owner)]))
            chosen = rank == best
            pair, rank = pair[chosen], rank[chosen]
            # of overlapping places (a a a) every other one counts, from the left
            run = np.flatnonzero(np.r_[True, np.diff(pair) != 1])
            nth = np.arange(len(pair)) - np.repeat(run, np.diff(np.r_[run, len(pair)]))
            pair, rank = pair[nth % 2 == 0], rank[nth % 2 == 0]
            ids[pair] = self.made[rank]
            live = np.zeros(len(words), bool)
            live[owner] = True
            keep = np.ones(len(ids), bool)
            keep[pair + 1] = False
            ids, word = ids[keep], word[keep]
            going = live[word]
            done_ids.append(ids[~going])
            done_words.append(word[~going])
            ids, word = ids[going], word[going]
        ids = np.concatenate([*done_ids, ids])
        word = np.concatenate([*done_words, word])
        order = np.argsort(word, kind="stable")
        counts = np.bincount(word, minlength=len(words)) if len(words) else np.zeros(0, np.int64)
        return ids[order], np.r_[0, np.cumsum(counts)]


class Words:
    """Distinct words met so far, each with what `make` gave for it (flat values and offsets).

    Words are met again by a key of their content, and then compared; of words with one key the first has the key, the
    others are met by their content. Beyond `most` words the collection starts anew.
    """

    def __init__(self, make, most: int = 500_000) -> None:
        self.make, self.most = make, most
        self._forget()

    def _forget(self) -> None:
        self.index: dict[int, int] = {}
        self.others: dict[bytes, int] = {}
        self.count = 0
        self.values, self.offsets = np.zeros(0, np.int64), np.zeros(1, np.int64)
        self.texts, self.ends = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _add(self, points: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Numbers of words that are new."""
        raw = points.tobytes()
        words = [raw[a:b].decode("utf-32-le").encode() for a, b in zip((starts * 4).tolist(), ((starts + size) * 4).tolist())]
        values, offsets = self.make(words)
        self.offsets = np.r_[self.offsets, self.offsets[-1] + offsets[1:]]
        self.values = np.r_[self.values, values]
        ends = np.cumsum(size)
        self.texts = np.r_[self.texts, points[np.arange(int(ends[-1])) + np.repeat(starts - (ends - size), size)]]
        self.ends = np.r_[self.ends, self.ends[-1] + ends]
        self.count += len(words)
        return np.arange(self.count - len(words), self.count)

    def look_up(self, points: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The number of each word."""
        import pandas as pd

        if self.count > self.most:
            self._forget()
        size = np.diff(np.r_[starts, len(points)])
        inverse, keys = pd.factorize(word_keys(points, starts))  # keys in the order of their first words
        first = np.empty(len(keys), np.int64)
        first[inverse[::-1]] = np.arange(len(inverse) - 1, -1, -1)
        numbers = np.fromiter((self.index.get(k, -1) for k in keys.tolist()), np.int64, len(keys))
        known = np.flatnonzero(numbers >= 0)
        # the first word of each key against the known one, the others against the first
        of_key = np.ones(len(keys), bool)
        there, here = numbers[known], first[known]
        of_key[known] = self.ends[there + 1] - self.ends[there] == size[here]
        known = known[of_key[known]]
        there, here = numbers[known], first[known]
        of_key[known] = same_content(self.texts, self.ends[there], points, starts[here], size[here])
        head = first[inverse]
        same = of_key[inverse] & (size == size[head])
        rest = np.flatnonzero(same & (head != np.arange(len(head))))
        same[rest] = same_content(points, starts[head[rest]], points, starts[rest], size[rest])
        new = np.flatnonzero(numbers < 0)
        if len(new):
            numbers[new] = self._add(points, starts[first[new]], size[first[new]])
            self.index.update(zip(keys[new].tolist(), numbers[new].tolist()))
        out = numbers[inverse]
        for k in np.flatnonzero(~same).tolist():
            content = points[starts[k]:starts[k] + size[k]].tobytes()
            if content not in self.others:
                self.others[content] = int(self._add(points, starts[k:k + 1], size[k:k + 1])[0])
            out[k] = self.others[content]
        return out

    def gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values of the words one after the other, and the size of each word's part."""
        sizes = self.offsets[numbers + 1] - self.offsets[numbers]
        shift = np.repeat(self.offsets[numbers] - np.r_[0, np.cumsum(sizes)[:-1]], sizes) if len(sizes) else sizes
        return self.values[np.arange(int(sizes.sum())) + shift], sizes


def apart(text: str, special: Sequence[str]) -> list[str]:
    """The text cut around special strings, which stand at odd places."""
    import re

    if not any(s in text for s in special):
        return [text]
    return re.split("(" + "|".join(re.escape(s) for s in sorted(special, key=len, reverse=True)) + ")", text)


class Encoder:
    """Ids of whole texts."""

    def __init__(self, vocabulary: dict) -> None:
        self.special = vocabulary["special"]
        self.splitter = Splitter()
        self.words = Words(Merger(vocabulary).encode)

    def encode(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts and the number of ids of each."""
        parts, owner, fixed = [], [], []
        for k, t in enumerate(texts):
            for nth, part in enumerate(apart(t, list(self.special))):
                parts.append("" if nth % 2 else part)
                owner.append(k)
                fixed.append(self.special[part] if nth % 2 else -1)
        points, starts, of = self.splitter.split(parts)
        if len(starts):
            flat, sizes = self.words.gather(self.words.look_up(points, starts))
            per_part = np.bincount(of, weights=sizes, minlength=len(parts)).astype(np.int64)
        else:
            flat, per_part = np.zeros(0, np.int64), np.zeros(len(parts), np.int64)
        fixed = np.array(fixed, np.int64)
        at = np.flatnonzero(fixed >= 0)
        if len(at):
            flat = np.insert(flat, np.cumsum(per_part)[at], fixed[at])
            per_part[at] = 1
        counts = np.bincount(np.array(owner, np.int64), weights=per_part, minlength=len(texts)) if parts else np.zeros(0)
        return flat, counts.astype(np.int64)
