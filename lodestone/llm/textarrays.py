"""Words, hashes and shingles of many texts at once, as numpy arrays.

Texts arrive as UTF-8 bytes in groups of about a megabyte, so memory is bounded by that or by one text. Word separators
are ASCII, so bytes of longer code points never split a word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

GROUP_BYTES = 1 << 19

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Words of everything but space, tab, line feed, vertical tab, form feed and carriage return.
SPACED = np.ones(256, dtype=bool)
SPACED[[0x20, 9, 10, 11, 12, 13]] = False
#: Words of 0-9, a-z and all that is not ASCII; texts are lower-cased before.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

_PRIME = 0x9E3779B97F4A7C55 | 1
_INVERSE = pow(_PRIME, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit over all others."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_powers = {_PRIME: np.ones(1, dtype=np.uint64), _INVERSE: np.ones(1, dtype=np.uint64)}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 to n - 1, modulo 2 ** 64."""
    have = _powers[base]
    if len(have) < n:
        have = np.full(max(n, 2 * GROUP_BYTES), base, dtype=np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        _powers[base] = have
    return have[:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Running polynomial sums, one longer than the data: any span's hash is a difference of two of them."""
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * powers(_PRIME, len(data)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end], equal for equal bytes wherever they stand."""
    h = (prefix[end] - prefix[start]) * powers(_INVERSE, len(prefix))[start]
    return mix(h + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


@dataclass
class Words:
    """Words of a group of texts: ``bounds[i]:bounds[i + 1]`` are those of text i, in reading order."""

    data: np.ndarray
    text_start: np.ndarray
    start: np.ndarray
    end: np.ndarray
    bounds: np.ndarray

    def hashes(self) -> np.ndarray:
        return span_hash(prefix_hash(self.data), self.start, self.end)

    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)


def words_of(texts: list[bytes], kind: np.ndarray) -> Words:
    """Lower-case A-Z and find the words; None stands for no text."""
    data = _LOWER[np.frombuffer(b" ".join(t or b"" for t in texts), dtype=np.uint8)]
    sizes = np.fromiter((len(t or b"") + 1 for t in texts), dtype=np.int64, count=len(texts))
    text_start = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    edge = np.diff(kind[data].astype(np.int8), prepend=0, append=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    bounds = np.append(np.searchsorted(start, text_start), len(start))
    return Words(data, text_start, start, end, bounds)


def groups(batch: pa.RecordBatch, column: str = "text", limit: int = GROUP_BYTES) -> Iterator[tuple[slice, list[bytes | None]]]:
    """Slices of a batch with about ``limit`` bytes of text each, one text at least; only one slice at a time is copied."""
    values = batch.column(column)
    ends = np.cumsum(pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at, before = 0, 0
    while at < len(values):
        stop = max(at + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield slice(at, stop), values.slice(at, stop - at).cast(pa.large_binary()).to_pylist()
        at, before = stop, int(ends[stop - 1])
    pa.default_memory_pool().release_unused()


def gram_hashes(word: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words in a row, texts ignored; ``len(word) - n + 1`` of them."""
    count = len(word) - n + 1
    if count <= 0:
        return np.zeros(0, dtype=np.uint64)
    total = np.full(count, n, dtype=np.uint64)
    for j in range(n):
        total = total * np.uint64(0x2545F4914F6CDD1D) + word[j : j + count]
    return mix(total)


def shingle_sets(words: Words, n: int) -> Iterator[np.ndarray]:
    """Each text's distinct n-word shingles as sorted hashes; a text of fewer words has its whole sequence as one."""
    word = words.hashes()
    grams = gram_hashes(word, n)
    for a, b in zip(words.bounds[:-1], words.bounds[1:], strict=True):
        if b - a >= n:
            yield np.unique(grams[a : b - n + 1])
        elif b > a:
            yield gram_hashes(word[a:b], int(b - a))
        else:
            yield word[:0]
