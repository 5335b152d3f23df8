"""Vectorised words: start, end and a 64-bit hash of every word of a block of text."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes that are handled at once (a longer text is cut at white space).
BLOCK = 1 << 20
_SPACE = frozenset(b" \t\n\r\x0b\x0c")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_M = [np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)]

#: A-Z lower-cased; white space only, or whatever isn't 0-9, a-z or beyond ASCII, becomes a space.
WHITE = bytes(0x20 if x in _SPACE else x + 32 if 0x41 <= x <= 0x5A else x for x in range(256))
SIGNS = bytes(0x20 if x < 0x30 or 0x3A <= x <= 0x40 or 0x5B <= x <= 0x60 or 0x7B <= x <= 0x7F else x + 32 if 0x41 <= x <= 0x5A else x for x in range(256))

_values = np.random.default_rng(2024).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M[0]
    x = (x ^ (x >> np.uint64(27))) * _M[1]
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2^64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, BLOCK + 4096)
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        _powers[:] = [np.cumprod(np.full(size, b, np.uint64)) for b in (_BASE, inverse)]
    return _powers[0], _powers[1]


def hashed_words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each word of `data`, in which only b" " separates words."""
    a = np.frombuffer(data, np.uint8)
    if not len(a):
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    solid = np.zeros(len(a) + 2, np.int8)
    solid[1:-1] = a != 0x20
    turn = np.diff(solid)
    starts, ends = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
    up, down = _power(len(a))
    sums = np.zeros(len(a) + 1, np.uint64)
    np.cumsum(_values[a] * up[: len(a)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * down[starts]
    return starts, mix(h + (ends - starts).astype(np.uint64) * _M[2])


def _cut(data: bytes) -> Iterator[bytes]:
    """Pieces of a long text that end at a space (or where a single word is longer than a block, after it)."""
    at = 0
    while len(data) - at > BLOCK:
        end = data.rfind(b" ", at, at + BLOCK)
        if end <= at:
            end = data.find(b" ", at + BLOCK)
        if end < 0:
            break
        yield data[at:end]
        at = end
    yield data[at:]


def blocks(column: pa.Array, table: bytes) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, words in each of the next rows, hashes of all their words in order) over a text column.

    Null counts as empty. Rows are joined up to a block; a longer one comes alone.
    """
    texts = [(t or b"").translate(table) for t in column.cast(pa.binary()).to_pylist()]
    k = 0
    while k < len(texts):
        first, size = k, 0
        while k < len(texts) and (k == first or size + len(texts[k]) < BLOCK):
            size += len(texts[k]) + 1
            k += 1
        own = texts[first:k]
        if len(own) == 1 and size > BLOCK:
            h = np.concatenate([hashed_words(p)[1] for p in _cut(own[0])])
            yield first, np.array([len(h)]), h
            continue
        lengths = np.array([len(t) + 1 for t in own])
        starts, h = hashed_words(b" ".join(own))
        edges = np.searchsorted(starts, np.concatenate(([0], np.cumsum(lengths))))
        yield first, np.diff(edges), h


def chunked(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct chunks between white space, the number of each chunk in order, and where each text's chunks begin.

    Splits as str.split() does; null counts as empty; an empty chunk may stand at a text's ends.
    """
    lists = pc.utf8_split_whitespace(pc.fill_null(texts.cast(pa.string()), ""))
    coded = lists.flatten().dictionary_encode()
    lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(lengths)))


def gather(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs values[start : start + length], one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.repeat(starts - (ends - lengths), lengths) + np.arange(total)]


def common_subsequence(item: list, text: list) -> int:
    """Length of the longest common subsequence of an item and a text, a machine word of the item at a time (bit-parallel)."""
    place: dict = {}
    for k, w in enumerate(item):
        place[w] = place.get(w, 0) | 1 << k
    full = (1 << len(item)) - 1
    v = full
    for w in text:
        if m := place.get(w, 0):
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(item) - v.bit_count()


def release() -> None:
    """Give freed memory back to the system: Python workers are used again, and would hold on to their largest task's."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def by_size(batch: pa.RecordBatch, column: int, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts come to about `most` bytes (a longer text is a slice of its own)."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column).cast(pa.binary())), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        end = int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + most, "right"))
        end = max(at + 1, end)
        yield batch.slice(at, end - at)
        at = end
