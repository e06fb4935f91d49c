"""Word-shingle sets of texts as sorted arrays of 64-bit hashes, and their b-bit MinHash signatures."""

from __future__ import annotations

import hashlib

import numpy as np

from retrospark.llm.common import mix64, ship

ship(__name__)

MEMO_WORDS = 400_000
_EDGE = np.uint64(0xA0761D6478BD642F)


class Hasher:
    """Hashes words; remembers those it has met (bounded)."""

    def __init__(self, words: int) -> None:
        self.words = words
        self.memo: dict[bytes, int] = {}

    def _hash(self, word: bytes) -> int:
        if len(self.memo) >= MEMO_WORDS:
            self.memo.clear()
        h = self.memo[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return h

    def shingles(self, text: str | None) -> np.ndarray:
        """Sorted distinct shingles of ``self.words`` words (A-Z lower-cased); fewer words: the whole sequence as one."""
        words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
        if not words:
            return np.zeros(0, np.uint64)
        get = self.memo.get
        got = list(map(get, words))
        if None in got:
            got = [self._hash(w) if g is None else g for w, g in zip(words, got, strict=True)]
        h = np.array(got, np.uint64)
        k = min(self.words, len(h))
        out = np.full(len(h) - k + 1, _EDGE + np.uint64(k), np.uint64)
        for j in range(k):
            out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + h[j : len(h) - k + 1 + j])
        return np.unique(out)


def minima(sets: list[np.ndarray], perms: int, seed: int = 11) -> np.ndarray:
    """MinHash minima (sets x perms, uint32) of non-empty sets."""
    rng = np.random.default_rng(seed)
    a, b = (rng.integers(0, 1 << 32, perms, np.uint64).astype(np.uint32) | np.uint32(1) for _ in range(2))
    flat = np.concatenate(sets)
    low, high = flat.astype(np.uint32), (flat >> np.uint64(32)).astype(np.uint32)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.empty((len(sets), perms), np.uint32)
    for i in range(perms):
        x = low * a[i] + high * b[i]
        x ^= x >> np.uint32(15)
        out[:, i] = np.minimum.reduceat(x, starts)
    return out


def bands(minima_: np.ndarray, count: int) -> np.ndarray:
    """Band keys (sets x count, int64): a hash of the band number and its rows' minima."""
    rows = minima_.shape[1] // count
    out = np.empty((len(minima_), count), np.uint64)
    for j in range(count):
        h = np.full(len(minima_), j + 1, np.uint64)
        for r in range(rows):
            h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + minima_[:, j * rows + r])
        out[:, j] = h
    return out.view(np.int64)


def pack(minima_: np.ndarray, bits: int) -> np.ndarray:
    """The low ``bits`` (a divisor of 8) of each minimum, packed into bytes."""
    low = (minima_ & np.uint32((1 << bits) - 1)).astype(np.uint8)
    each = 8 // bits
    low = low.reshape(len(low), -1, each)
    out = np.zeros(low.shape[:2], np.uint8)
    for j in range(each):
        out |= low[:, :, j] << np.uint8(bits * j)
    return out


def estimate(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    """Similarity of packed signatures, row by row: share of equal fields, corrected for chance collisions (2**-bits)."""
    x = a ^ b
    each, mask = 8 // bits, np.uint8((1 << bits) - 1)
    equal = sum((((x >> np.uint8(bits * j)) & mask) == 0).sum(axis=1) for j in range(each))
    share = equal / (each * x.shape[1])
    chance = 2.0**-bits
    return (share - chance) / (1 - chance)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * |a & b| >= percent * |a | b| for sorted distinct arrays; empty sets are linked with nothing."""
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)
