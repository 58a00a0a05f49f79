"""Hashed word shingles, MinHash and HyperMinHash sketches of texts; helpers of the near-duplicate operators."""

from __future__ import annotations

import numpy as np
import xxhash

from tidemark.llm.common import remembered

WIDTH = 5
#: Words whose hashes a worker remembers at once.
REMEMBERED = 100_000
_rng = np.random.default_rng(20240117)
_PLACE = _rng.integers(0, 2**63, WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def word_hashes(words: list[bytes]) -> np.ndarray:
    known = remembered(_WordHashes, _WordHashes)
    return np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))


def windows(h: np.ndarray) -> np.ndarray:
    """A hash for each window of WIDTH words; with fewer words, one for them all; none without words."""
    n = len(h) - WIDTH + 1
    if n > 0:
        out = np.zeros(n, dtype=np.uint64)
        for i in range(WIDTH):
            out += h[i : i + n] * _PLACE[i]
        return mix(out)
    if not len(h):
        return h
    return mix(np.array([np.sum(h * _PLACE[: len(h)], dtype=np.uint64) + np.uint64(len(h))], dtype=np.uint64))


def windows_of(h: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The windows of several texts, of ``counts`` words each (one at least), as ``windows`` has them, and where each text's begin."""
    n = np.maximum(1, counts - WIDTH + 1)
    starts = np.cumsum(n) - n
    at = np.arange(n.sum()) + np.repeat(np.cumsum(counts) - counts - starts, n)
    held = np.repeat(np.minimum(counts, WIDTH), n)
    padded = np.r_[h, np.zeros(WIDTH, dtype=np.uint64)]
    out = np.where(held < WIDTH, held, 0).astype(np.uint64)
    for i in range(WIDTH):
        out += np.where(held > i, padded[at + i], np.uint64(0)) * _PLACE[i]
    return mix(out), starts


def shingle_set(text: bytes) -> np.ndarray:
    """The sorted distinct shingle hashes of a whole text, lower-cased A-Z."""
    return np.unique(windows(word_hashes(text.lower().split())))


class HyperMinHash:
    """Sketches of ``registers`` buckets: each holds, of the least hash in it, how many zeros lead and the next bits.

    A bucket without a hash borrows from another, in an order fixed for each bucket (densification), so that small sets band
    as large ones do.
    """

    def __init__(self, registers: int = 128, mantissa: int = 10, rows: int = 4) -> None:
        self.m, self.bits, self.rows = registers, mantissa, rows
        self.shift = registers.bit_length() - 1
        rng = np.random.default_rng(7)
        self.order = np.stack([np.r_[i, rng.permutation(np.delete(np.arange(registers), i))] for i in range(registers)])
        self.salt = rng.integers(0, 2**63, registers // rows, dtype=np.uint64)

    def sketch(self, hashes: np.ndarray) -> np.ndarray:
        """Registers of 16 bits."""
        width = np.uint64(64 - self.shift)
        bucket = hashes & np.uint64(self.m - 1)
        keyed = np.sort((bucket << width) | (hashes >> np.uint64(self.shift)))
        at = keyed >> width
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        least = keyed[first] & ((np.uint64(1) << width) - np.uint64(1))
        bound = np.float64(2.0) ** float(width)
        _, exponent = np.frexp(least / bound)  # least / bound = f * 2**exponent, f in [0.5, 1)
        zeros = np.minimum(-exponent, 63)
        tail = np.floor((least / bound * np.exp2(zeros + 1.0) - 1) * 2**self.bits).clip(0, 2**self.bits - 1)
        registers, full = np.zeros(self.m, dtype=np.uint16), np.zeros(self.m, dtype=bool)
        registers[at[first].astype(np.int64)] = (zeros.astype(np.uint32) << self.bits) + tail.astype(np.uint32)
        full[at[first].astype(np.int64)] = True
        if not full.all():
            registers = registers[self.order[np.arange(self.m), full[self.order].argmax(axis=1)]]
        return registers

    def bands(self, registers: np.ndarray) -> np.ndarray:
        """A key for each run of ``rows`` registers."""
        packed = registers.reshape(-1, self.rows).astype(np.uint64)
        key = self.salt.copy()
        for i in range(self.rows):
            key = mix(key + packed[:, i])
        return key.view(np.int64)

    def similarity(self, a: np.ndarray, b: np.ndarray) -> float:
        """The Jaccard estimate: the share of equal registers, less those that are equal by chance.

        Two different least hashes share their leading zeros in about a third of all cases, and then their next bits once in 2**bits.
        """
        chance = 2.0**-self.bits / 3
        return max(0.0, (float(np.mean(a == b)) - chance) / (1 - chance))


class MinHash:
    """``bands`` keys of ``rows`` least hashes each."""

    def __init__(self, bands: int, rows: int) -> None:
        rng = np.random.default_rng(11)
        self.bands, self.rows = bands, rows
        self.factor = rng.integers(0, 2**63, (bands * rows, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.salt = rng.integers(0, 2**63, (bands, 1), dtype=np.uint64)

    def keys(self, hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The keys (bands by sets) of the sets of hashes that begin at ``starts``, none of them empty."""
        least = np.stack([np.minimum.reduceat(hashes * f, starts) for f in self.factor]).reshape(self.bands, self.rows, -1)
        key = np.repeat(self.salt, least.shape[2], axis=1)
        for i in range(self.rows):
            key = mix(key + least[:, i])
        return key.view(np.int64)


def tuned(threshold: float, missed: float = 1e-4, most: int = 32) -> tuple[int, int]:
    """Bands and rows: the most rows, and for them the fewest bands, that miss a pair at the threshold at most so often; at most ``most`` hashes."""
    for rows in range(8, 0, -1):
        for bands in range(1, most // rows + 1):
            if (1 - threshold**rows) ** bands <= missed:
                return bands, rows
    raise ValueError("no banding is that sure")
