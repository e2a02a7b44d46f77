"""Word shingles of texts as 64-bit hashes, and MinHash signatures of them, with numpy."""

from __future__ import annotations

import numpy as np

WIDTH = 5
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_INWORD = np.array([(48 <= b <= 57) or (65 <= b <= 90) or (97 <= b <= 122) or b >= 128 for b in range(256)])
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _M1
    h = (h ^ (h >> np.uint64(29))) * _M2
    return h ^ (h >> np.uint64(32))


def word_hashes(raw: bytes) -> np.ndarray:
    """Hash of each word: a run of ASCII letters, digits and non-ASCII bytes, A-Z lowered."""
    b = np.frombuffer(raw, np.uint8)
    inside = np.zeros(len(b) + 2, bool)
    inside[1:-1] = _INWORD[b]
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    starts, stops = edge[::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64)
    # the sum of a mixed value of each byte and its place in the word
    size = stops - starts
    ends = np.cumsum(size)
    place = np.arange(int(ends[-1])) - np.repeat(ends - size, size)
    v = mix(_LOWER[b[place + np.repeat(starts, size)]].astype(np.uint64) + (place.astype(np.uint64) << np.uint64(8)) + np.uint64(1))
    return mix(np.add.reduceat(v, ends - size) + size.astype(np.uint64))


def shingle_set(text: str, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of `width` consecutive words; a shorter text is one shingle, one without words has none."""
    w = word_hashes(text.encode())
    if not len(w):
        return w
    width = min(width, len(w))
    h = np.zeros(len(w) - width + 1, np.uint64)
    for k in range(width):
        h = h * _M1 + w[k:len(w) - width + 1 + k]
    return np.unique(mix(h + np.uint64(width)))


class MinHash:
    """Signatures of `count` minimums; value k of two sets agrees with probability equal to their Jaccard similarity."""

    def __init__(self, count: int, seed: int = 1) -> None:
        rng = np.random.default_rng(seed)
        self.a = rng.integers(1, 1 << 63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.count = count

    def __call__(self, shingles: np.ndarray) -> np.ndarray:
        out = np.empty(self.count, np.uint32)
        short = (shingles ^ (shingles >> np.uint64(33)))
        for begin in range(0, len(shingles), 2048):
            part = short[begin:begin + 2048]
            low = np.empty(self.count, np.uint32)
            for k in range(0, self.count, 50):  # the upper half of a product with an odd number
                low[k:k + 50] = ((part[None, :] * self.a[k:k + 50, None]) >> np.uint64(32)).astype(np.uint32).min(axis=1)
            out = low if not begin else np.minimum(out, low)
        return out


def fingerprint(shingles: np.ndarray) -> int:
    """A 64-bit hash of the set."""
    import hashlib

    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def bands(signature: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key for each run of `rows` values, different for equal values in different runs."""
    groups = signature.reshape(-1, rows).astype(np.uint64)
    h = mix(np.arange(1, len(groups) + 1, dtype=np.uint64))
    for k in range(rows):
        h = mix(h * _M1 + groups[:, k])
    return h.view(np.int64)
