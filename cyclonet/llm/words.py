"""Whole Arrow batches of texts cut into words and hashed with numpy, without a Python loop over words.

A word is a maximal run of bytes other than space and 0x09-0x0D, so UTF-8 sequences are never cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: An odd base; its inverse modulo 2**64 moves a prefix sum to the start of a word or window.
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INV = pow(BASE, -1, 1 << 64)
CHUNK_BYTES = 1 << 20

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**n modulo 2**64; grown as needed and kept for the worker's life."""
    have = _powers.get(base)
    if have is None or len(have) <= n:
        size = max(n + 1, CHUNK_BYTES)
        table = np.full(size, base, np.uint64)
        table[0] = 1
        _powers[base] = have = np.multiply.accumulate(table)
    return have


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser (splitmix64); bijective for a fixed seed."""
    x = x + np.uint64((seed * 0xD1342543DE82EF95 + 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(256, dtype=np.uint64), 7)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


@dataclass
class Words:
    """Words of a run of documents, in order."""

    data: np.ndarray  # uint8, the documents' bytes one after another
    start: np.ndarray  # int64 per word, into data
    end: np.ndarray
    first: np.ndarray  # int64 per document plus one: its first word
    at: np.ndarray  # int64 per document plus one: its first byte
    row: int  # the run's first row in the batch

    @property
    def docs(self) -> int:
        return len(self.first) - 1

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(self.docs), np.diff(self.first))

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        n = len(self.data)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[self.data] * powers(BASE, n)[:n], out=sums[1:])
        return mix((sums[self.end] - sums[self.start]) * powers(BASE_INV, n)[self.start])


def windows(word_hash: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of the `size` words from each word on; the last size-1 words have none."""
    n = len(word_hash)
    if n < size:
        return np.zeros(0, np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(mix(word_hash, seed + 1) * powers(BASE, n)[:n], out=sums[1:])
    return mix((sums[size:] - sums[: n - size + 1]) * powers(BASE_INV, n)[: n - size + 1], seed)


def inside(words: Words, size: int) -> np.ndarray:
    """For each word that `windows` hashes: does its window stay in one document?"""
    n = len(words.start) - size + 1
    if n <= 0:
        return np.zeros(0, bool)
    last = np.repeat(words.first[1:], np.diff(words.first))  # end of the word's document
    return np.arange(n) + size <= last[:n]


def split(texts: pa.Array, chunk_bytes: int = CHUNK_BYTES) -> Iterator[Words]:
    """Cuts an Arrow string array (null: empty) into runs of documents of about chunk_bytes, each with its words."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    row = 0
    while row < n:
        to = max(row + 1, int(np.searchsorted(offsets, offsets[row] + chunk_bytes, "right")) - 1)
        at = offsets[row : to + 1] - offsets[row]
        part = data[offsets[row] : offsets[to]]
        solid = np.zeros(len(part) + 2, bool)
        np.logical_not(_SPACE[part], out=solid[1:-1])
        begins = solid[1:] & ~solid[:-1]
        ends = ~solid[1:] & solid[:-1]
        # A document's border cuts a word that would run over it.
        edge = at[1:-1]
        edge = edge[(edge > 0) & (edge < len(part))]
        touch = edge[solid[edge] & solid[edge + 1]] if len(edge) else edge
        begins[touch] = True
        ends[touch] = True
        start, end = np.flatnonzero(begins), np.flatnonzero(ends)
        yield Words(part, start, end, np.searchsorted(start, at).astype(np.int64), at, row)
        row = to


def sliding(x: np.ndarray, size: int, op) -> np.ndarray:
    """op (np.minimum, np.maximum) over each `size` neighbours, by doubling."""
    width = 1
    while width * 2 <= size:
        x = op(x[:-width], x[width:])
        width *= 2
    if width < size:
        x = op(x[: len(x) - (size - width)], x[size - width :])
    return x


def slices(b: pa.RecordBatch, column: int = -1, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about `size` bytes of text each."""
    texts = b.column(b.num_columns + column if column < 0 else column)
    n = b.num_rows
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if pa.types.is_large_string(texts.type) else np.int32)[texts.offset : texts.offset + n + 1]
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, int(offsets[at]) + size, "right")) - 1)
        yield b.slice(at, to - at)
        at = to
