"""Word shingles of whole texts as 64-bit hashes, and MinHash signatures, with numpy."""

from __future__ import annotations

import numpy as np

#: A text's bytes that separate words.
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def random64(seed: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mixed((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 20)) * np.uint64(0x9E3779B97F4A7C15))


_BYTES = random64(1, 256)
_STEP = np.uint64(0x9E3779B97F4A7C55)


def word_hashes(raw: bytes) -> np.ndarray:
    """64-bit hashes of the words of a UTF-8 text, A-Z lower-cased: a polynomial over the word's bytes, then mixed."""
    data = np.frombuffer(raw, dtype=np.uint8)
    if not len(data):
        return np.zeros(0, dtype=np.uint64)
    inside = ~_SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    lengths = ends - starts
    values = _BYTES[_LOWER[data]]
    # Horner's rule for all words at once, one byte of each at a time; very long words go on their own
    out = np.zeros(len(starts), dtype=np.uint64)
    with np.errstate(over="ignore"):
        short = np.flatnonzero(lengths <= 64)
        order = short[np.argsort(-lengths[short], kind="stable")]
        sizes = lengths[order]
        h, at = np.zeros(len(order), dtype=np.uint64), starts[order]
        for k in range(int(sizes[0]) if len(sizes) else 0):
            n = int(np.searchsorted(-sizes, -k, side="left"))  # words longer than k
            h[:n] = h[:n] * _STEP + values[at[:n] + k]
        out[order] = h
        for i in np.flatnonzero(lengths > 64):
            word = values[starts[i] : ends[i]]
            power = np.cumprod(np.full(len(word), _STEP, dtype=np.uint64)) if len(word) else word
            out[i] = (word[::-1] * (power * np.uint64(1))).sum(dtype=np.uint64)
        return mixed(out + lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def shingle_set(raw: bytes, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``size`` words; of the whole sequence where it is shorter; none without words."""
    words = word_hashes(raw)
    n = len(words)
    if not n:
        return words
    k = min(size, n)
    with np.errstate(over="ignore"):
        turns = random64(7 + k, k) | np.uint64(1)
        total = np.zeros(n - k + 1, dtype=np.uint64)
        for j in range(k):
            total = mixed(total + words[j : n - k + 1 + j] * turns[j])
    return np.unique(total)


class MinHash:
    """``n`` minima over multiply-shift hashes of a set, and their odd sketch."""

    def __init__(self, n: int, bits: int = 1024, seed: int = 11):
        self.n, self.bits = n, bits
        self.a, self.b = random64(seed, n) | np.uint64(1), random64(seed + 1, n)

    def minima(self, hashes: np.ndarray) -> np.ndarray:
        """The least mixed value for each function (the set must not be empty)."""
        out = np.full(self.n, np.uint64(0xFFFFFFFFFFFFFFFF))
        with np.errstate(over="ignore"):
            for at in range(0, len(hashes), 1024):
                part = hashes[at : at + 1024]
                x = part[:, None] * self.a[None, :] + self.b[None, :]
                x ^= x >> np.uint64(32)
                np.minimum(out, x.min(axis=0), out=out)
        return out

    def bands(self, minima: np.ndarray, rows: int) -> np.ndarray:
        """A 64-bit key for each band of ``rows`` minima, the band's number mixed in."""
        parts = minima.reshape(-1, rows)
        with np.errstate(over="ignore"):
            total = random64(21, len(parts))
            for j in range(rows):
                total = mixed(total + parts[:, j])
        return total

    def odd_sketch(self, minima: np.ndarray) -> np.ndarray:
        """A bitmap of the parities of how many (function, minimum) pairs fall on each bit."""
        with np.errstate(over="ignore"):
            at = mixed(minima + self.b) % np.uint64(self.bits)
        counts = np.bincount(at.astype(np.int64), minlength=self.bits)
        return np.packbits((counts & 1).astype(np.uint8))

    def estimate(self, ones: np.ndarray | int):
        """Similarity from the number of ones in the XOR of two odd sketches (Mitzenmacher, Pagh and Pham 2014)."""
        part = np.minimum(2 * np.asarray(ones) / self.bits, 1 - 1e-9)
        return 1 + self.bits / (4 * self.n) * np.log1p(-part)
