"""Vectorised word keys over Arrow string columns.

The word rule is ``[^\\x20\\x09-\\x0D]+``.  Words become 64-bit keys by a
polynomial hash over their bytes (A-Z folded to a-z on demand) with a final
mix, so later steps work on NumPy arrays and never loop over words.  Two
different words share a key with a chance of about 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BASE = U(0x9E3779B97F4A7C15 | 1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over uint64 (xor-shift and multiply)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


def _byte_values(lower: bool) -> np.ndarray:
    values = mix(np.arange(1, 257, dtype=U) * _BASE)
    if lower:
        values[65:91] = values[97:123]
    values[_SPACE] = 0
    return values


#: A-Z as a-z.
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_VALUES = {False: _byte_values(False), True: _byte_values(True)}


class Words(NamedTuple):
    """The words of rows ``first`` to ``last`` - 1: row of each word, its key, and its byte span in ``data``."""

    first: int
    last: int
    row: np.ndarray
    key: np.ndarray
    start: np.ndarray
    end: np.ndarray
    data: np.ndarray

    def bounds(self) -> np.ndarray:
        """Index of each row's first word, and the number of words at the end."""
        return np.searchsorted(self.row, np.arange(self.first, self.last + 1))


def text_buffers(texts) -> tuple[np.ndarray, np.ndarray]:
    """(row offsets, bytes) of a string column; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if offsets is not None else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return offsets, data


def polynomial(part: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool) -> np.ndarray:
    """Keys of the words that lie from ``start`` to ``end`` in ``part``, by all their bytes."""
    if not len(start):
        return np.zeros(0, U)
    longest, base = int((end - start).max()), int(start[0])
    powers = np.cumprod(np.full(longest, _BASE))
    place = np.arange(base, len(part), dtype=np.int64) - np.repeat(start, np.diff(np.append(start, len(part))))
    place[place >= longest] = 0  # spaces, whose value is 0
    with np.errstate(over="ignore"):
        return mix(np.add.reduceat(_VALUES[lower][part[base:]] * powers[place], start - base))


def by_eights(part: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool) -> np.ndarray:
    """Keys of the same words, other ones than ``polynomial`` gives: from the length on, eight bytes at a time, so it takes a quarter of the time."""
    data = np.zeros(len(part) + 8, np.uint8)
    data[: len(part)] = _FOLD[part] if lower else part
    eights = np.ndarray((len(part) + 1,), "<u8", data, strides=(1,))
    left = end - start
    key, todo = left.astype(U), np.arange(len(start))
    with np.errstate(over="ignore"):
        while len(todo):
            known = eights[start] & (U(0xFFFFFFFFFFFFFFFF) >> ((8 - np.minimum(left, 8)).astype(U) * U(8)))
            key[todo] = mix(known ^ (key[todo] * _BASE))
            more = np.flatnonzero(left > 8)
            todo, start, left = todo[more], start[more] + 8, left[more] - 8
    return key


def word_keys(texts, lower: bool = True, chunk_bytes: int = 4 << 20, hashed=polynomial) -> Iterator[Words]:
    """Words of a string column, some rows at a time so that temporaries stay near ``chunk_bytes`` (one row is never split)."""
    offsets, data = text_buffers(texts)
    rows, first = len(offsets) - 1, 0
    while first < rows:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + chunk_bytes, "right")) - 1)
        bounds = offsets[first : last + 1] - offsets[first]
        part = data[offsets[first] : offsets[last]]
        blank = (part == 0x20) | ((part >= 0x09) & (part <= 0x0D))
        cuts = np.zeros(len(part) + 1, bool)
        cuts[bounds] = True  # a row's end ends its last word
        before = np.ones(len(part), bool)
        before[1:] = blank[:-1]
        start = np.flatnonzero(~blank & (before | cuts[:-1]))
        after = np.ones(len(part), bool)
        after[:-1] = blank[1:]
        end = np.flatnonzero(~blank & (after | cuts[1:])) + 1
        row = np.repeat(np.arange(first, last), np.diff(np.searchsorted(start, bounds)))
        yield Words(first, last, row, hashed(part, start, end, lower), start, end, part)
        first = last


def windows(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first word, key) of every ``n``-word window inside one row."""
    m = len(words.key) - n + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, U)
    with np.errstate(over="ignore"):
        key = words.key[:m].copy()
        for k in range(1, n):
            key = key * U(0xD6E8FEB86659FD93) + words.key[k : m + k]
    at = np.flatnonzero(words.row[:m] == words.row[n - 1 :])
    return at, mix(key[at])
