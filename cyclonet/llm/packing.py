"""Best-fit packing of tokenised documents into sequences, by hierarchical rounds over what stays underfull.

Every task packs its own pieces best-fit decreasing. Nearly full bins are done; the others are items of the next round,
in an eighth of the pools. From the third round on whatever is over half full is done too, and best-fit leaves one bin
at most a pool that is not, so the last pool gets no more bins than there were tasks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import codec, default_path, encode_batch
from .common import materialize
from .words import slices

FAN_IN = 8
END_ID = 0
COLUMNS = ("doc_id", "piece", "start", "length", "ids_crc32")
TYPES = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
BINS = "sequence_id long, used int, pool int, doc_id array<long>, piece array<int>, start array<long>, length array<long>, ids_crc32 array<long>, offset array<long>"


def cut(ids: bytes, size: int) -> list[tuple[int, int, int, int]]:
    """Pieces (number, start, length, checksum) of a document's ids, with END_ID after them; the first may be short."""
    ids += END_ID.to_bytes(4, "little")
    n = len(ids) >> 2
    first = n if n <= size else n % size or size
    at = [0, *range(first, n, size), n]
    return [(k, a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for k, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True))]


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of item numbers, largest items first, each into the bin it leaves the least room in."""
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_ = 0  # bit r: a bin with room r
    bins: list[list[int]] = []
    sizes = sizes.tolist()
    for i in sorted(range(len(sizes)), key=sizes.__getitem__, reverse=True):
        need = sizes[i]
        fits = open_ >> need
        if fits:
            room = need + (fits & -fits).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                open_ &= ~(1 << room)
            bins[b].append(i)
        else:
            room, b = capacity, len(bins)
            bins.append([i])
        room -= need
        rooms[room].append(b)
        open_ |= 1 << room
    return bins


def _emit(members: list[pa.Array], first: np.ndarray, capacity: int, level: int, pool: int) -> pa.RecordBatch:
    """Packs items (runs of members that start at `first`) and gives one row for each bin."""
    length = members[3].to_numpy()
    ends = np.append(first[1:], len(length)).astype(np.int64)
    total = np.zeros(len(length) + 1, np.int64)
    np.cumsum(length, out=total[1:])
    bins = best_fit(total[ends] - total[first], capacity)
    flat = np.array([i for b in bins for i in b], np.int64)
    many = (ends - first)[flat]
    to = np.cumsum(many)
    order = np.repeat(first[flat] - (to - many), many) + np.arange(to[-1] if len(to) else 0)
    count = np.array([sum(int(ends[i] - first[i]) for i in b) for b in bins], np.int64)
    cuts = np.append(0, np.cumsum(count))
    run = np.zeros(len(order) + 1, np.int64)
    np.cumsum(length[order], out=run[1:])
    used = run[cuts[1:]] - run[cuts[:-1]]
    offset = run[:-1] - np.repeat(run[cuts[:-1]], count)
    lists = [pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), m.take(pa.array(order))) for m in members]
    lists.append(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(offset)))
    ids = (level << 56) + (pool << 32) + np.arange(len(bins), dtype=np.int64)
    return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(used, pa.int32()), pa.array(np.full(len(bins), pool), pa.int32()), *lists], names=["sequence_id", "used", "pool", *COLUMNS, "offset"])


def pack(docs: DataFrame, size: int = 2048, path: str | None = None) -> DataFrame:
    """One row for each piece of each document: where its ids start, how many, their checksum, sequence and place there.

    Null text: empty, so END_ID alone. A document of over `size` ids is cut, others stay whole. Equal lengths pack in
    the order read. Repeated rows are packed each. Empty table: no rows. Null doc_id: stays null.
    """
    path = path or default_path()

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, library=True)
        held: list[pa.Array] = []
        rows: list[list[tuple[int, int, int, int]]] = []
        for b in batches:
            for part in slices(b):
                pieces = [cut(x, size) for x in encode_batch([t or "" for t in part.column(1).to_pylist()], c)]
                held.append(part.column(0).take(pa.array(np.repeat(np.arange(len(pieces)), [len(p) for p in pieces]))))
                rows.append([p for own in pieces for p in own])
        if held:
            columns = [np.array(x, np.int64) for x in zip(*(p for own in rows for p in own), strict=True)]
            members = [pa.concat_arrays(held), *(pa.array(x, t) for x, t in zip(columns, TYPES[1:], strict=True))]
            yield _emit(members, np.arange(len(columns[0])), size, 1, TaskContext.get().partitionId())

    def again(level: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[list[pa.Array]] = []
            counts: list[np.ndarray] = []
            for b in batches:
                counts.append(b.column(3).value_lengths().to_numpy())
                held.append([b.column(3 + i).flatten() for i in range(len(COLUMNS))])
            if held:
                n = np.concatenate(counts).astype(np.int64)
                yield _emit([pa.concat_arrays(x) for x in zip(*held, strict=True)], np.cumsum(n) - n, size, level, TaskContext.get().partitionId())

        return run

    light = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    bins = materialize(light.mapInArrow(local, BINS))
    pools = (bins.agg(F.max("pool")).first()[0] or 0) + 1
    done, level = [], 1
    while pools > 1:
        full = size - size // 128 if level == 1 else size - size // 32 if level == 2 else size // 2 + 1
        done.append(bins.filter(F.col("used") >= full))
        pools = -(-pools // FAN_IN)
        rest = bins.filter(F.col("used") < full).withColumn("_to", F.col("pool") % pools)
        # The rows of a pool follow from the pools before; sorted, a lost task packs them the same way again.
        rest = rest.repartition(pools, "_to").sortWithinPartitions("sequence_id").drop("_to")
        level += 1
        bins = materialize(rest.mapInArrow(again(level), BINS))
    out = reduce(DataFrame.unionByName, [*done, bins])
    zipped = F.arrays_zip(*COLUMNS, "offset")
    return out.select("sequence_id", F.inline(zipped)).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
