"""Vectorised words and word hashes over the UTF-8 buffers of Arrow string columns.

Everything works on whole texts, a chunk of documents at a time, with numpy only. Memory follows the chunk:
about CHUNK bytes of text, or one document where that is longer.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext

CHUNK = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

#: Bytes of words between ASCII white space.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes of words made of digits, lower-cased letters and everything beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
#: Lower case for A to Z only.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values; one to one."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class _Powers:
    """Powers of the base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self):
        self.up = self.down = np.ones(0, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up, self.down = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, b)])) for b in (_BASE, _INVERSE))
        return self.up, self.down


_powers = _Powers()


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and document offsets of a string or binary column; nulls have no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)), at


def chunks(at: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about size bytes each; a longer document is alone."""
    n, i = len(at) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + size, "right")) - 1)
        yield i, j
        i = j


def places(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... within each of the runs of the given sizes."""
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def runs(batches: Iterator[pa.RecordBatch], column: int, size: int) -> Iterator[tuple[int, pa.Table]]:
    """Number and rows of runs of about size bytes of text in a column; numbers differ between the tasks of a stage."""
    context = TaskContext.get()
    number, held, total = (context.partitionId() if context else 0) << 24, [], 0
    for batch in batches:
        at = buffers(batch.column(column))[1]
        for i, j in chunks(at, size):
            held.append(batch.slice(i, j - i))
            total += int(at[j] - at[i])
            if total >= size:
                yield number, pa.Table.from_batches(held).combine_chunks()
                number, held, total = number + 1, [], 0
    if held:
        yield number, pa.Table.from_batches(held).combine_chunks()


@dataclass
class Words:
    """Words of some documents: byte ranges in data, hashes, and where each document's words begin."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    at: np.ndarray

    def doc(self) -> np.ndarray:
        """The document of each word."""
        return np.repeat(np.arange(len(self.at) - 1), np.diff(self.at))


def words(data: np.ndarray, at: np.ndarray, kind: np.ndarray) -> Words:
    """Lower-case A to Z and find the words of documents data[at[i]:at[i+1]], runs of bytes of a kind."""
    base = int(at[0])
    low = LOWER[data[base : int(at[-1])]]
    at = at - base
    n = len(low)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = kind[low]
    begins = inside[1:-1] & ~inside[:-2]
    ends = inside[1:-1] & ~inside[2:]
    cut = at[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    begins[cut] = inside[cut + 1]
    ends[cut - 1] = inside[cut]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    up, down = _powers.get(n + 1)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
    hashed = mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
    return Words(low, start, end, hashed, np.searchsorted(start, at))


def shingles(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every run of size words, and the document of each; a shorter document with words is one run."""
    n, doc = len(w.hash), w.doc()
    runs = max(0, n - size + 1)
    last = w.at[1:][doc]
    whole = np.arange(n)[:runs] + size <= last[:runs]
    out = np.zeros(runs, np.uint64)
    for k in range(size):
        out = out * np.uint64(0xD1342543DE82EF95) + w.hash[k : k + runs]
    out, of = mix(out[whole]), doc[:runs][whole]
    count = np.diff(w.at)
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        extra = np.array([_sequence(w.hash[w.at[d] : w.at[d + 1]]) for d in short], np.uint64)
        out, of = np.concatenate([out, extra]), np.concatenate([of, short])
        order = np.argsort(of, kind="stable")
        out, of = out[order], of[order]
    return out, of


def _sequence(h: np.ndarray) -> np.uint64:
    value = np.full(1, len(h), np.uint64)
    for x in h:
        value = mix(value * _BASE + x)
    return value[0]


def distinct_sets(value: np.ndarray, doc: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each document, one after another, and where each document's begin."""
    cut = np.searchsorted(doc, np.arange(docs + 1))
    value = value.copy()
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
        value[a:b].sort()
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    value, doc = value[new], doc[new]
    return value, np.searchsorted(doc, np.arange(docs + 1))
