"""Removal of repeated word windows: a merged count-min sketch clears most windows, a second pass groups the rest exactly.

Sketch. Each window is counted through its anchor, the least hash among its shorter runs of words ("grams"). Equal
windows have equal anchors, and each occurrence of a window has an anchor place of its own, so an anchor's count is
never below the count of a window it stands for; anchors are some tenth of the places. Every task adds its anchors to a
sketch of saturating counters (0, 1, 2 or more), sparse, in blocks; blocks are merged by their number, and one bit a
cell (two or more) is all that goes on. Its size is fixed by `width_bits`: where it fills up, more windows are passed to
the second pass, and none is lost.

Second pass. A task groups its own passed windows by two hashes of 64 and 32 bits, both over the words' 64-bit hashes, so
words that collide there collide in both. What it sees twice it knows; what it sees once it
asks about, in packed rows dealt by the anchor; a window thus travels at most once a task, however often it occurs, and
the answers come back as runs of positions for each document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, partitions, row_key, shield
from .words import inside, mix, slices, sliding, split, windows

SKETCH_ROWS = 2
BLOCK_BITS = 16
FLUSH = 500_000


def gram_size(size: int) -> int:
    return max(1, size * 16 // 35)


def anchors(word_hash: np.ndarray, ok: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The anchor hash of each window, and the hashes at the distinct anchor places of valid windows."""
    if not len(ok):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    gram = gram_size(size)
    span = size - gram + 1
    g = windows(word_hash, gram, 5) | np.uint64(1)
    least = sliding(g, span, np.minimum)
    pad = np.zeros(span - 1, np.uint64)
    reach = sliding(np.concatenate([pad, np.where(ok, least, np.uint64(0)), pad]), span, np.maximum)
    return least, g[reach == g]


def cells(anchor: np.ndarray, row: int, width_bits: int) -> np.ndarray:
    return mix(anchor, 20 + row) >> np.uint64(64 - width_bits)


def sketch(docs: DataFrame, size: int, width_bits: int) -> np.ndarray:
    """The merged sketch as bits, [SKETCH_ROWS, 2**width_bits / 8]: is the cell's count two or more?

    What reaches the driver is these bits, a bound set by the parameter.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            values, times = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            rows: list[tuple[int, int, bytes, bytes]] = []
            for r in range(SKETCH_ROWS):
                cell = cells(values, r, width_bits)
                order = np.argsort(cell)
                cell, many = cell[order], times[order]
                first = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
                total, cell = np.add.reduceat(many, first), cell[first]
                block, low = (cell >> np.uint64(BLOCK_BITS)).astype(np.int64), cell.astype(np.uint16)
                cut = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
                for a, b in zip(cut, np.append(cut[1:], len(block)), strict=True):
                    twice = total[a:b] > 1
                    rows.append((r, int(block[a]), low[a:b][~twice].tobytes(), low[a:b][twice].tobytes()))
            kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["row", "block", "once", "twice"])

        for b in batches:
            for w in split(b.column(0)):
                if len(w.start) >= size:
                    held.append(anchors(w.hashes(), inside(w, size), size)[1])
                if sum(map(len, held)) > FLUSH:
                    yield out()
        if sum(map(len, held)):
            yield out()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            for r, k, once, twice in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                have = seen.setdefault((r, k), np.zeros(1 << BLOCK_BITS, np.uint8))
                one, two = np.frombuffer(once, np.uint16), np.frombuffer(twice, np.uint16)
                have[one] = np.minimum(have[one] + 1, 2)  # a task lists a cell once
                have[two] = 2
        for (r, k), have in seen.items():
            if (have > 1).any():
                yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([k], pa.int32()), pa.array([np.packbits(have > 1).tobytes()], pa.binary())], names=["row", "block", "bits"])

    parts = docs.select("text").mapInArrow(count, "row int, block int, once binary, twice binary")
    merged = parts.repartition("row", "block").mapInArrow(merge, "row int, block int, bits binary")
    bits = np.zeros((SKETCH_ROWS, 1 << (width_bits - BLOCK_BITS), 1 << (BLOCK_BITS - 3)), np.uint8)
    for r in merged.toLocalIterator():
        bits[r["row"], r["block"]] = np.frombuffer(r["bits"], np.uint8)
    return bits.reshape(SKETCH_ROWS, -1)


def passed(anchor: np.ndarray, bits: np.ndarray, width_bits: int) -> np.ndarray:
    """Which anchors the sketch counts twice or more, in every row."""
    out = np.ones(len(anchor), bool)
    for r in range(len(bits)):
        cell = cells(anchor, r, width_bits)
        out &= (bits[r][cell >> np.uint64(3)] >> (np.uint64(7) - (cell & np.uint64(7))).astype(np.uint8)) & np.uint8(1) > 0
    return out


def as_runs(at: np.ndarray) -> np.ndarray:
    """Sorted distinct positions as pairs (first, count)."""
    if not len(at):
        return np.zeros((0, 2), np.int32)
    first = np.flatnonzero(np.append(True, np.diff(at) != 1))
    return np.stack([at[first], np.diff(np.append(first, len(at)))], 1).astype(np.int32)


def _runs_by_doc(ids: np.ndarray, hashes: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    order = np.lexsort((at, hashes, ids))
    ids, hashes, at = ids[order], hashes[order], at[order]
    cut = np.flatnonzero(np.append(True, (ids[1:] != ids[:-1]) | (hashes[1:] != hashes[:-1])))
    runs = [as_runs(x).tobytes() for x in np.split(at, cut[1:])]
    return pa.RecordBatch.from_arrays([pa.array(ids[cut]), pa.array(hashes[cut]), pa.array(runs, pa.binary())], names=["_id", "_h", "_runs"])


def _groups(h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorting order by the pair of hashes, and where its groups begin."""
    order = np.lexsort((h2, h1))
    a, b = h1[order], h2[order]
    return order, np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))


def repeated_windows(docs: DataFrame, size: int = 35, width_bits: int = 26) -> DataFrame:
    """For each document that has some, (_id, _h) as in row_key and _runs: runs of places where repeated windows start."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(sketch(docs, size, width_bits))
    buckets = 16 * partitions(spark)
    names = ["kind", "_id", "_h", "_runs", "bucket", "h1", "h2", "ids", "hashes", "at"]
    schema = "kind int, _id long, _h long, _runs binary, bucket int, h1 binary, h2 binary, ids binary, hashes binary, at binary"

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def out() -> Iterator[pa.RecordBatch]:
            anchor, h1, h2, ids, hashes, at = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order, cut = _groups(h1, h2)
            times = np.diff(np.append(cut, len(order)))
            alone = np.repeat(times == 1, times)
            known = order[~alone]
            if len(known):
                b = _runs_by_doc(ids[known], hashes[known], at[known])
                n = b.num_rows
                empty = pa.nulls(n, pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int32)), *b.columns, pa.nulls(n, pa.int32()), *[empty] * 5], names=names)
            lead = order[cut]  # one place stands for a group; at -1: the answer is known here already
            at = np.where(times > 1, -1, at[lead]).astype(np.int32)
            anchor, h1, h2, ids, hashes = anchor[lead], h1[lead], h2[lead], np.where(times > 1, 0, ids[lead]), np.where(times > 1, 0, hashes[lead])
            bucket = (mix(anchor, 40) % np.uint64(buckets)).astype(np.int32)
            order = np.lexsort((at, hashes, ids, bucket))
            bucket = bucket[order]
            cut = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
            parts = [[y.tobytes() for y in np.split(x[order], cut[1:])] for x in (h1, h2, ids, hashes, at)]
            n = len(cut)
            none = pa.nulls(n, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(n, np.int32)), none, none, pa.nulls(n, pa.binary()), pa.array(bucket[cut]), *(pa.array(x, pa.binary()) for x in parts)], names=names)

        for b in batches:
            key_id, key_h = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for w in split(b.column(2)):
                if len(w.start) < size:
                    continue
                ok, h = inside(w, size), w.hashes()
                least, _ = anchors(h, ok, size)
                places = np.flatnonzero(ok)
                places = places[passed(least[places], sent.value, width_bits)]
                if not len(places):
                    continue
                doc = np.searchsorted(w.first, places, "right") - 1
                h1, h2 = windows(h, size)[places], windows(h, size, 9)[places].astype(np.uint32)
                held.append((least[places], h1, h2, key_id[w.row + doc], key_h[w.row + doc], (places - w.first[doc]).astype(np.int32)))
                if sum(len(x[0]) for x in held) > FLUSH:
                    yield from out()
        if held:
            yield from out()

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (np.uint64, np.uint32, np.int64, np.int64, np.int32)
        held: list[list[bytes]] = []
        now = None

        def out() -> Iterator[pa.RecordBatch]:
            h1, h2, ids, hashes, at = (np.frombuffer(b"".join(x), k) for x, k in zip(zip(*held, strict=True), kinds, strict=True))
            held.clear()
            order, cut = _groups(h1, h2)
            times = np.add.reduceat(np.where(at[order] < 0, 2, 1), cut)
            yes = order[np.repeat(times > 1, np.diff(np.append(cut, len(order))))]
            yes = yes[at[yes] >= 0]
            if len(yes):
                yield _runs_by_doc(ids[yes], hashes[yes], at[yes])

        for b in batches:
            for bucket, *row in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                if held and bucket != now:
                    yield from out()
                now = bucket
                held.append(row)
        if held:
            yield from out()

    asked = materialize(docs.select(*row_key(), "text").mapInArrow(ask, schema))
    known = asked.filter("kind = 0").select("_id", "_h", "_runs")
    dealt = asked.filter("kind = 1").select("bucket", "h1", "h2", "ids", "hashes", "at").repartition("bucket").sortWithinPartitions("bucket")
    told = dealt.mapInArrow(answer, "_id long, _h long, _runs binary")
    return known.unionByName(told).groupBy("_id", "_h").agg(F.collect_list("_runs").alias("_runs"))


def kept_words(text: bytes, runs: list[bytes] | None, size: int) -> tuple[int, int, bytes]:
    """Words of the text, words removed, and the kept words joined by one space."""
    words = text.split()
    if not runs:
        return len(words), 0, b" ".join(words)
    cover = np.zeros(len(words) + 1, np.int32)
    for first, count in np.concatenate([np.frombuffer(r, np.int32).reshape(-1, 2) for r in runs]):
        cover[first] += 1
        cover[first + count - 1 + size] -= 1
    keep = np.cumsum(cover)[:-1] == 0
    return len(words), int((~keep).sum()), b" ".join([words[i] for i in np.flatnonzero(keep)])


def remove_repeats(docs: DataFrame, size: int = 35, width_bits: int = 26) -> DataFrame:
    """docs with n_words, n_removed and kept (the kept words joined by one space).

    A word goes if a window of `size` words that covers it also starts elsewhere, in any document or its own; windows
    are judged on the input. Null or blank text: no words. Texts under `size` words and an empty table: nothing goes.
    Repeated rows and equal texts repeat each other's windows.
    """
    keep = docs.columns
    fields = docs.schema.fields
    runs = repeated_windows(docs, size, width_bits)
    ids = [f"_k{i}" for i in range(len(keep))]
    left = docs.select(*row_key(), *(F.col(c).alias(k) for c, k in zip(keep, ids, strict=True)))
    joined = left.join(runs, ["_id", "_h"], "left").select(*ids, F.col(ids[keep.index("text")]).cast("binary").alias("_bytes"), "_runs")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, len(keep)):
                got = [kept_words(t or b"", r, size) for t, r in zip(part.column(len(keep)).to_pylist(), part.column(len(keep) + 1).to_pylist(), strict=True)]
                n, removed, text = zip(*got, strict=True)
                extra = [pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(text, pa.binary())]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *extra], names=[*ids, "n_words", "n_removed", "_kept"])

    out = joined.mapInArrow(cut, ", ".join([*(f"{k} {f.dataType.simpleString()}" for k, f in zip(ids, fields, strict=True)), "n_words long, n_removed long, _kept binary"]))
    # The words' bytes are those of valid text, cut at ASCII only.
    return out.select(*(F.col(k).alias(c) for k, c in zip(ids, keep, strict=True)), "n_words", "n_removed", F.col("_kept").cast("string").alias("kept"))


def rewrite_documents(docs: DataFrame, size: int = 35, width_bits: int = 26) -> DataFrame:
    """docs whose texts lose their repeated windows; a text that loses none stays as it is, null included.

    Repeated rows lose what repeats in both. Clashing columns come back as they were. Very long texts are cut whole.
    Empty table: no rows.
    """
    docs, restore = shield(docs, ("doc_id", "text"))
    out = remove_repeats(docs, size, width_bits)
    return restore(out.withColumn("text", F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))))
