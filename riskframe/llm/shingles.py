"""Word shingles, MinHash signatures and sequential Bayesian verification (numpy, inside tasks)."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import xxhash

from riskframe.llm.common import ship_by_value

ship_by_value(__name__)


def _mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``words``-word shingles of the text, A-Z lower-cased.

    Words are runs of bytes other than blank and \\t \\n \\v \\f \\r. A text with fewer words is one shingle; without words
    the set is empty.
    """
    tokens = text.encode("utf-8", "replace").lower().split() if text else []
    if not tokens:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh3_64_intdigest
    h = np.array([digest(w) for w in tokens], np.uint64)
    width = min(words, len(h))
    out = np.full(len(h) - width + 1, width, np.uint64)
    for j in range(width):
        out += h[j:len(h) - width + 1 + j] * np.uint64(2 * j * 0x9E3779B97F4A7C15 % 2**64 | 1 if j else 0x2545F4914F6CDD1D)
    return np.unique(_mix(out))


@dataclass(frozen=True)
class Banding:
    """MinHash parameters: ``bands`` bands of ``rows`` hashes; two sets share a band with probability 1 - (1 - J^rows)^bands."""

    words: int = 5
    bands: int = 30
    rows: int = 5
    seed: int = 1

    @property
    def hashes(self) -> int:
        return self.bands * self.rows

    def coefficients(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rng = np.random.default_rng(self.seed)
        a = rng.integers(0, 2**32, self.hashes, dtype=np.uint32) | np.uint32(1)
        b = rng.integers(0, 2**32, self.hashes, dtype=np.uint32)
        return a[:, None], b[:, None], rng.integers(0, 2**63, self.rows + 1, dtype=np.uint64) | np.uint64(1)

    def sketch(self, s: np.ndarray, coefficients) -> tuple[np.ndarray, np.ndarray]:
        """(one byte of every minimum hash, the 64-bit band keys) of a non-empty set."""
        a, b, c = coefficients
        x = (s >> np.uint64(32)).astype(np.uint32)
        low = np.full(self.hashes, np.iinfo(np.uint32).max, np.uint32)
        for at in range(0, len(x), 1024):
            np.minimum(low, (x[None, at:at + 1024] * a + b).min(axis=1), out=low)
        keys = (low.reshape(self.bands, self.rows).astype(np.uint64) * c[1:]).sum(axis=1) + np.arange(1, self.bands + 1, dtype=np.uint64) * c[0]
        mixed = _mix(low.astype(np.uint64))
        return (mixed & np.uint64(255)).astype(np.uint8), _mix(keys).view(np.int64)


def at_least(numerator: int, denominator: int, inter: int, union: int) -> bool:
    return denominator * inter >= numerator * union


def posterior_floor(n: int, threshold: float, miss: float) -> int:
    """Fewest equal hashes of ``n`` at which P(similarity >= threshold | data) is still at least ``miss``.

    One-byte hashes of unequal minima agree with probability 1/256, so agreement has probability
    p = J + (1 - J) / 256; with a uniform prior on p the posterior is Beta(m + 1, n - m + 1), whose upper tail at t
    is P(Binomial(n + 1, t) <= m).
    """
    t = threshold + (1 - threshold) / 256
    total = 0.0
    for m in range(n + 1):
        total += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        if total >= miss:
            return m
    return n


def verification_steps(hashes: int, batch: int, threshold: float, miss: float) -> list[tuple[int, int]]:
    """(hashes seen, fewest equal ones to go on) after each batch of a sequential comparison."""
    ends = list(range(batch, hashes, batch)) + [hashes]
    return [(n, posterior_floor(n, threshold, miss)) for n in ends]


def survives(a: np.ndarray, b: np.ndarray, steps: list[tuple[int, int]]) -> np.ndarray:
    """Row-wise sequential comparison of signature matrices; rows are dropped as soon as a bound rules them out."""
    alive, equal, seen = np.arange(len(a)), np.zeros(len(a), np.int32), 0
    for n, least in steps:
        equal[alive] += (a[alive, seen:n] == b[alive, seen:n]).sum(axis=1, dtype=np.int32)
        alive, seen = alive[equal[alive] >= least], n
    out = np.zeros(len(a), bool)
    out[alive] = True
    return out


def intersection_size(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted distinct arrays."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    return int((b[at] == a).sum()) if len(b) else 0
