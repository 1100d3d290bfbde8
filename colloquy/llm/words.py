"""Vectorised word splitting and hashing of Arrow string columns.

Words are the runs ``[^\\x20\\x09-\\x0D]+`` of the UTF-8 bytes with A-Z
lower-cased. Everything works on byte buffers with numpy; a slice of whole
documents is handled at a time, so temporary memory follows ``SLICE_BYTES``
(or one document, if that is longer).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20

_rng = np.random.default_rng(20240607)
_BYTE_KEY = _rng.integers(0, 2**64, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_KEY = _BYTE_KEY[_LOWER]  # upper and lower case letters hash alike
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[[9, 10, 11, 12, 13, 32]] = False
_powers = np.ones(1, dtype=np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser over uint64."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def _pow(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        steps = np.full(max(n, 1024), _BASE, dtype=np.uint64)
        steps[0] = 1
        with np.errstate(over="ignore"):
            _powers = np.multiply.accumulate(steps)
    return _powers


class Words(NamedTuple):
    """Words of a slice of documents: ``hashes`` in order, document ``i`` owning
    ``hashes[bounds[i]:bounds[i + 1]]``; ``ends`` are byte ends in ``data``, ``data`` the bytes."""

    first: int
    hashes: np.ndarray
    bounds: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    data: np.ndarray


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary array; nulls become empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, offs


def text_slices(column: pa.Array, limit: int) -> Iterator[tuple[int, pa.Array]]:
    """(first row, large strings without nulls) of consecutive rows of about ``limit`` bytes."""
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        yield a, column.slice(a, b - a)
        a = b


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Words]:
    """Words of all documents of ``column``, whole documents at a time."""
    raw, offs = string_buffers(column)
    n, a = len(offs) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + limit, "right")) - 1)
        b = min(b, n)
        yield split(raw[offs[a] : offs[b]], offs[a : b + 1] - offs[a], a)
        a = b


def split(data: np.ndarray, offs: np.ndarray, first: int = 0) -> Words:
    inside = _IS_WORD[data]
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    cut = offs[:-1][offs[:-1] < len(data)]
    before[cut] = False  # no word spans two documents
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1:] = False
    after[:-1] = inside[1:]
    last = offs[1:][offs[1:] > 0] - 1
    after[last] = False
    ends = np.flatnonzero(inside & ~after) + 1
    if not len(starts):
        return Words(first, np.zeros(0, np.uint64), np.zeros(len(offs), np.int64), starts, ends, data)
    size = ends - starts
    at = np.flatnonzero(inside)
    word_at = np.concatenate(([0], np.cumsum(size)[:-1]))
    place = np.arange(len(at)) - np.repeat(word_at, size)
    with np.errstate(over="ignore"):
        value = _BYTE_KEY[data[at]] * _pow(int(size.max()))[place]
        hashes = mix64(np.add.reduceat(value, word_at))
    return Words(first, hashes, np.searchsorted(starts, offs), starts, ends, data)


def hash_word(word: bytes) -> np.uint64:
    """The hash that ``split`` gives one word."""
    return split(np.frombuffer(word, np.uint8), np.array([0, len(word)]))[1][0]


_STEP = _rng.integers(0, 2**64, 16, dtype=np.uint64) | np.uint64(1)


def shingles(words: Words, size: int) -> Iterator[np.ndarray]:
    """Per document its sorted distinct ``size``-word shingle hashes.

    A document with fewer words has its whole sequence as its only shingle;
    one without words has none.
    """
    h, bounds = words.hashes, words.bounds
    n = len(h)
    with np.errstate(over="ignore"):
        if n >= size:
            s = np.full(n - size + 1, _STEP[size], dtype=np.uint64)
            for k in range(size):
                s += h[k : n - size + 1 + k] * _STEP[k]
            s = mix64(s)
        for i in range(len(bounds) - 1):
            a, b = int(bounds[i]), int(bounds[i + 1])
            if b - a >= size:
                yield np.unique(s[a : b - size + 1])
            elif b > a:
                short = _STEP[b - a].copy()
                for k in range(b - a):
                    short = short + h[a + k] * _STEP[k]
                yield mix64(np.array([short], dtype=np.uint64))
            else:
                yield np.zeros(0, np.uint64)
