"""Words and tokens of many texts at once, as numpy arrays over their UTF-8 bytes.

They are those of ``text.words``, ``text.name_tokens`` and ``text.tokenize``: tokens are ASCII, so bytes of longer code
points never belong to one, and blanks of several bytes are found by their bytes. Texts come in slices of some megabytes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from lodestone import constants as C

SLICE_BYTES = 4 << 20
#: Slices of passages, whose distinct words are counted: fewer slices repeat fewer words.
WIDE_SLICE_BYTES = 12 << 20

#: Bytes of ``text.tokenize`` in either case and of ``C.NAME_TOKEN``, and those that are stripped from a name's ends.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = True
NAME = ALNUM.copy()
NAME[list(b"[](),'-")] = True
_STRIPPED = np.zeros(256, dtype=bool)
_STRIPPED[list(C.NAME_STRIP.encode())] = True
#: Rounds in which ends are stripped a byte at a time; what is left after them is looked up.
_STRIP_ROUNDS = 8
#: The two longer code points that have ASCII in lower case.
_FOLDED = (("\u212a".encode(), b"k"), ("\u0130".encode(), "i\u0307".encode()))
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[*range(9, 14), *range(0x1C, 0x21)]] = True
#: First bytes of longer blanks.
_LEAD = np.zeros(256, dtype=bool)
_LEAD[[0xC2, 0xE1, 0xE2, 0xE3]] = True
#: Unicode blanks of three bytes.
_WIDE = [0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def by_slices(f: Callable[[pa.RecordBatch], pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``f`` over slices with about ``most`` bytes of text each, one row at least, as ``mapInArrow`` takes it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            at, before = 0, 0
            while at < batch.num_rows:
                stop = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
                yield f(batch.slice(at, stop - at))
                at, before = stop, int(ends[stop - 1])

    return run


def _bytes_of(texts: pa.Array, folded: bool = False) -> tuple[bytes, np.ndarray]:
    """(data, begins): the texts with a line feed behind each, and where each begins; a null is an empty text. ``folded`` replaces ``_FOLDED``."""
    values = [v or b"" for v in texts.cast(pa.large_binary()).to_pylist()]
    joined = b"\n".join(values) + b"\n"
    if folded and any(long in joined for long, _ in _FOLDED):
        for long, short in _FOLDED:
            values = [v.replace(long, short) for v in values]
        joined = b"\n".join(values) + b"\n"
    sizes = np.fromiter(map(len, values), dtype=np.int64, count=len(values)) + 1
    return joined, np.concatenate([[0], np.cumsum(sizes)])[:-1]


def _marked(data: bytes, table: np.ndarray) -> np.ndarray:
    """For each byte what the table has for it; by bytes.translate, which is faster than numpy's look-up."""
    return np.frombuffer(data.translate(table.tobytes()), dtype=bool)


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted, each once; by a sort, which is much faster than numpy's table where most values are distinct."""
    values = np.sort(values)
    return values[np.append(True, values[1:] != values[:-1])] if len(values) else values


def _runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs begin and end. The last byte is in none, as each text ends with a line feed."""
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        edge = np.append(0, edge)
    return edge[0::2], edge[1::2]


@dataclass
class Tokens:
    """``words[code[i]]`` is token i, in reading order, and ``text[i]`` the number of its text; ``dictionary`` has the words as Arrow binaries."""

    text: np.ndarray
    code: np.ndarray
    dictionary: pa.Array

    @cached_property
    def words(self) -> list[bytes]:
        return self.dictionary.to_pylist()


def _owners(begins: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The number of the text that each run is in."""
    return np.repeat(np.arange(len(begins)), np.diff(np.append(np.searchsorted(start, begins), len(start))))


def _coded(begins: np.ndarray, start: np.ndarray, sizes: np.ndarray, flat: bytes | np.ndarray) -> Tokens:
    """Tokens of ``sizes`` bytes each, which stand in ``flat`` without gaps."""
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(flat)]).dictionary_encode()
    return Tokens(_owners(begins, start), coded.indices.to_numpy().astype(np.int64), coded.dictionary)


_NOT_ALNUM = bytes(np.flatnonzero(~ALNUM).tolist())


def tokens(texts: pa.Array) -> Tokens:
    """``text.tokenize``."""
    data, begins = _bytes_of(texts, folded=True)
    start, end = _runs(_marked(data, ALNUM))
    return _coded(begins, start, end - start, data.lower().translate(None, _NOT_ALNUM))


def token_counts(texts: pa.Array) -> np.ndarray:
    """The size of ``text.tokenize`` of each text."""
    data, begins = _bytes_of(texts, folded=True)
    start, _ = _runs(_marked(data, ALNUM))
    return np.diff(np.append(np.searchsorted(start, begins), len(start)))


def name_tokens(texts: pa.Array) -> Tokens:
    """``text.name_tokens``; tokens of punctuation alone are empty."""
    data, begins = _bytes_of(texts)
    inside = _marked(data, NAME).copy()
    start, end = _runs(inside)
    stripped = _marked(data, _STRIPPED)
    first, last = start.copy(), end.copy()
    left, right = np.arange(len(start)), np.arange(len(start))
    for _ in range(_STRIP_ROUNDS):
        left = left[stripped[first[left]] & (first[left] < last[left])]
        inside[first[left]] = False
        first[left] += 1
        right = right[stripped[last[right] - 1] & (first[right] < last[right])]
        last[right] -= 1
        inside[last[right]] = False
    if len(left) or len(right):
        kept = np.flatnonzero(inside & ~stripped)
        for i in np.union1d(left, right).tolist():
            a, b = np.searchsorted(kept, [first[i], last[i]]).tolist()
            low, high = (int(kept[a]), int(kept[b - 1]) + 1) if b > a else (int(first[i]), int(first[i]))
            inside[first[i] : low] = inside[high : last[i]] = False
            first[i], last[i] = low, high
    return _coded(begins, start, last - first, np.frombuffer(data.lower(), dtype=np.uint8)[inside])


def _blanks(data: bytes) -> np.ndarray:
    """Bytes of Unicode blanks, and of U+001C to U+001F."""
    blank = _marked(data, _BLANK).copy()
    lead = np.flatnonzero(_marked(data, _LEAD))
    data = np.frombuffer(data, dtype=np.uint8)
    # a text is followed by a line feed, so that bytes behind a lead are there
    first, second, third = (data[np.minimum(lead + i, len(data) - 1)].astype(np.int32) for i in range(3))
    two = lead[(first == 0xC2) & ((second == 0x85) | (second == 0xA0))]
    three = lead[(first > 0xC2) & np.isin(((first & 15) << 12) | ((second & 63) << 6) | (third & 63), _WIDE)]
    for places, size in ((two, 2), (three, 3)):
        for i in range(size):
            blank[places + i] = True
    return blank


def windows(texts: pa.Array, size: int, step: int) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(text, number, window) of windows of ``size`` words that begin every ``step`` words and end with the text, words joined by one blank."""
    data, begins = _bytes_of(texts)
    inside = ~_blanks(data)
    start, end = _runs(inside)
    # each word and one byte behind it, as a blank
    kept = inside.copy()
    kept[end] = True
    flat = np.where(inside, np.frombuffer(data, dtype=np.uint8), np.uint8(0x20))[kept].tobytes()
    stop = np.cumsum(end - start + 1)
    head = stop - (end - start + 1)
    n = np.diff(np.append(np.searchsorted(start, begins), len(start)))
    count = np.where(n == 0, 0, np.where(n <= size, 1, 1 + -(-(n - size) // step)))
    text = np.repeat(np.arange(len(n)), count)
    number = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    base = np.cumsum(n) - n
    low = base[text] + number * step
    high = np.minimum(low + size, base[text] + n[text]) - 1
    return text, number, [flat[a:b] for a, b in zip(head[low].tolist(), (stop[high] - 1).tolist(), strict=True)]
