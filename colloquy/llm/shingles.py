"""Word shingles of texts as 64-bit hashes, for many texts at a time in NumPy."""

from __future__ import annotations

import numpy as np
import xxhash

from colloquy.llm.common import LOWER

#: White space of the word pattern `[^\x20\x09-\x0D]+`.
_SPACES = np.zeros(256, dtype=bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = np.array([xxhash.xxh64_intdigest(bytes([b]), seed=7) | 1 for b in range(256)], dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class _Powers:
    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n + 1:
            size = len(self.up)
            step_up = np.uint64(pow(_BASE, size, 1 << 64))
            step_down = np.uint64(pow(_INVERSE, size, 1 << 64))
            self.up = np.concatenate([self.up, self.up * step_up])
            self.down = np.concatenate([self.down, self.down * step_down])
        return self.up, self.down


_powers = _Powers()


def shingle_sets(texts: list[bytes], words: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Sorted distinct shingle hashes of each text, and its number of words.

    A-Z are lower-cased; words are runs without white space; a shingle is `words` words in a row. A
    text with fewer words has one shingle, all of them; a text without words has none.
    """
    data = np.frombuffer(b"\n".join(texts).translate(LOWER), dtype=np.uint8)
    inside = ~_SPACES[data]
    edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]])))
    starts, ends = edges[0::2], edges[1::2]
    up, down = _powers.upto(len(data))
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(_BYTE[data] * up[: len(data)], dtype=np.uint64)])
    hashes = mix((sums[ends] - sums[starts]) * down[starts])
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    begins = np.cumsum(lengths + 1) - lengths - 1
    first = np.searchsorted(starts, begins)
    counts = np.searchsorted(starts, begins + lengths) - first
    out = []
    for at, n in zip(first.tolist(), counts.tolist()):
        if n == 0:
            out.append(np.zeros(0, dtype=np.uint64))
            continue
        size = min(words, n)
        own = hashes[at:at + n]
        total = np.full(n - size + 1, size, dtype=np.uint64)
        for k in range(size):
            total = mix(total + own[k:n - size + 1 + k])
        out.append(np.unique(total))
    return out, counts


def digest(shingles: np.ndarray) -> bytes:
    """16 bytes that stand for a whole set."""
    return xxhash.xxh3_128_digest(shingles.tobytes())


def at_least(a: np.ndarray, b: np.ndarray, percent: int) -> tuple[bool, float]:
    """Whether 100 * |a and b| >= percent * |a or b| for sorted distinct arrays, and the ratio."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    union = len(a) + len(b) - both
    return 100 * both >= percent * union and union > 0, both / union if union else 0.0
