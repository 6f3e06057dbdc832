"""SetSketch registers: exponentially spaced, truncated minima of hash values.

Every element sends points of a Poisson process of rate ``RATE`` to each register; a register holds
``floor(1 - log_b(first arrival))``, cut to 16 bits. Two sketches merge by the larger register, as the first arrival of
a union is the earlier one, and registers of similar sets tend to agree, so runs of them serve as keys of bands.
"""

from __future__ import annotations

import numpy as np

from lodestone.llm.textarrays import mix

BASE = 1.001
RATE = 20.0
_STEP = np.uint64(0x9E3779B97F4A7C15)


def sketch(elements: np.ndarray, m: int) -> np.ndarray:
    """Registers of a set of distinct 64-bit hashes; all 0 for an empty set.

    The points of one element come in ascending order, each for a register at random, so an element is done as soon
    as it has passed the latest first arrival: about m ln m + n points in all instead of m n.
    """
    if not len(elements):
        return np.zeros(m, dtype=np.uint16)
    first = np.full(m, np.inf)
    seed, at, done = elements.astype(np.uint64), np.zeros(len(elements)), 0
    expect = m * (np.log(m) + 0.6)
    while len(seed):
        width = int(max(1, min(4096, np.ceil(expect / len(seed)))))
        draw = mix(seed[:, None] + np.arange(done + 1, done + width + 1, dtype=np.uint64) * _STEP)
        done += width
        times = at[:, None] + np.cumsum(-np.log(((draw >> np.uint64(24)).astype(np.float64) + 0.5) * 2.0**-40), axis=1)
        register = ((draw & np.uint64(0xFFFFFF)) * np.uint64(m)) >> np.uint64(24)
        np.minimum.at(first, register.ravel().astype(np.int64), times.ravel())
        at = times[:, -1]
        more = at < first.max()
        seed, at = seed[more], at[more]
        expect = len(seed) or 1
    x = first / (RATE * m)
    return np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, 65535).astype(np.uint16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union."""
    return np.maximum(a, b)


def band_keys(registers: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(texts, bands) keys; equal where all rows of a band agree."""
    parts = registers[:, : bands * rows].reshape(len(registers), bands, rows).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _STEP, parts.shape[:2]).copy()
    for j in range(rows):
        key = mix(key ^ (parts[:, :, j] + np.uint64(0x632BE59BD9B4E019)))
    return key


def estimate_jaccard(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Maximum-likelihood similarity of pairs of sketches of sets of known sizes.

    The likelihood of how many registers are larger, smaller and equal is concave in the similarity; its maximum is
    found by golden-section search over all pairs at once.
    """
    more, less = (a > b).sum(axis=1), (a < b).sum(axis=1)
    same = a.shape[1] - more - less
    u, v = size_a / (size_a + size_b), size_b / (size_a + size_b)
    share = (BASE - 1) / BASE

    def p(x):
        return -np.log1p(-np.clip(x, 0, 1) * share) / np.log(BASE)

    def likelihood(j):
        up, down = p(u - v * j), p(v - u * j)
        tiny = 1e-300
        return more * np.log(np.maximum(up, tiny)) + less * np.log(np.maximum(down, tiny)) + same * np.log(np.maximum(1 - up - down, tiny))

    low, high = np.zeros(len(a)), np.minimum(u / v, v / u)
    golden = (np.sqrt(5) - 1) / 2
    for _ in range(30):
        c, d = high - golden * (high - low), low + golden * (high - low)
        left = likelihood(c) > likelihood(d)
        high, low = np.where(left, d, high), np.where(left, low, c)
    return (low + high) / 2
