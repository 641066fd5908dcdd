"""Phrase collocations by prefix-free parsing: phrases are counted in a dictionary of chunks, not in the texts.

Parsing. A document's words are cut where the hash of two neighbouring words hits a modulus, so equal passages are cut
at equal places, whatever stands around them. A chunk is its own words and, as overlap, up to `size` - 1 words that
follow in the same piece. The distinct chunks with their frequencies are the dictionary; a copied passage is in it once.

Counting. A run of words is counted in the chunk whose own words it begins in, weighted by that chunk's frequency, so
an overlap counts once and no run is missed. Runs of one to three words first fill a sketch of counters, merged over all
chunks, that never counts less than the truth; a longer run can only be frequent if all its triples are. What passes is
counted exactly, by its text: a task adds up its own, and sends lists of phrases and counts, dealt by the phrase's hash.
The sketch's width follows from the number of words, up to 2**MOST_BITS cells, which bounds what is broadcast; a fuller
sketch lets more runs pass and loses none.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, partitions
from .words import CHUNK_BYTES, Words, mix, windows

MODULUS, SKETCHED = 64, 3
BLOCK_BITS, LEAST_BITS, MOST_BITS = 16, 18, 30
FLUSH = 1_000_000
DEAL = 32  # parts that a language's ranking is dealt into first

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_GAP = np.zeros(256, bool)
_GAP[[0x20, 0x09]] = True
_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True


def tokens(texts: pa.Array) -> Iterator[tuple[Words, np.ndarray]]:
    """Runs of texts (null: empty) of about CHUNK_BYTES in lower case, with their words, and which words begin a piece."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    row = 0
    while row < n:
        to = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK_BYTES, "right")) - 1)
        at = offsets[row : to + 1] - offsets[row]
        part = _LOWER[data[offsets[row] : offsets[to]]]
        breaks = _BREAK[part]
        solid = np.zeros(len(part) + 2, bool)
        np.logical_not(breaks | _GAP[part], out=solid[1:-1])
        begins, ends = solid[1:] & ~solid[:-1], ~solid[1:] & solid[:-1]
        edge = at[1:-1]
        edge = edge[(edge > 0) & (edge < len(part))]
        touch = edge[solid[edge] & solid[edge + 1]] if len(edge) else edge
        begins[touch] = ends[touch] = True
        start, end = np.flatnonzero(begins), np.flatnonzero(ends)
        w = Words(part, start, end, np.searchsorted(start, at).astype(np.int64), at, row)
        broken = np.cumsum(breaks, dtype=np.int64)
        fresh = np.ones(len(start), bool)
        if len(start):
            fresh[1:] = broken[start[1:]] != broken[start[:-1]]
            fresh[w.first[:-1][w.first[:-1] < len(start)]] = True
        yield w, fresh
        row = to


def ahead(w: Words, fresh: np.ndarray, most: int) -> np.ndarray:
    """For each word, how many words follow it in its piece, `most` at most."""
    n = len(fresh)
    begins = np.append(np.flatnonzero(fresh), n)
    last = begins[np.searchsorted(begins, np.arange(n), "right")]
    return np.minimum(last - 1 - np.arange(n), most)


def parse(docs: DataFrame, size: int) -> DataFrame:
    """lang, own, chunk, n: the distinct chunks, of which the first `own` words are their own, and their frequencies."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for w, fresh in tokens(b.column(1)):
                n = len(fresh)
                if not n:
                    continue
                pair = windows(w.hashes(), 2, 310)
                begin = np.zeros(n, bool)
                begin[: len(pair)] = pair % np.uint64(MODULUS) == 0
                begin[w.first[:-1][w.first[:-1] < n]] = True
                first = np.flatnonzero(begin)
                last = np.append(first[1:], n) - 1
                # The words after the last own one, as far as the piece and the overlap go.
                reach = last + ahead(w, fresh, size - 1)[last]
                text = w.data.tobytes()
                chunk = [text[x:y] for x, y in zip(w.start[first].tolist(), w.end[reach].tolist(), strict=True)]
                lang = b.column(0).take(pa.array(w.row + w.doc[first]))
                yield pa.RecordBatch.from_arrays([lang, pa.array(last - first + 1, pa.int32()), pa.array(chunk, pa.binary())], names=["lang", "own", "chunk"])

    cuts = docs.mapInArrow(cut, "lang string, own int, chunk binary")
    return cuts.groupBy("lang", "own", "chunk").agg(F.count("*").alias("n"))


def _read(b: pa.RecordBatch) -> Iterator[tuple[Words, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of a batch (lang, own, chunk, n): words, each word's row, whether a run may begin at it, how many words of its piece
    follow it, and its hash, which differs between languages."""
    salt = mix(np.array([zlib.crc32((x or "").encode()) for x in b.column(0).to_pylist()], np.uint64), 320)
    own = b.column(1).to_numpy()
    for w, fresh in tokens(b.column(2)):
        row = w.doc + w.row
        place = np.arange(len(fresh)) - w.first[w.doc]
        yield w, row, place < own[row], ahead(w, fresh, len(fresh)), mix(w.hashes() + salt[row])


def _cells(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.uint32)


def _spans(h: np.ndarray, size: int) -> np.ndarray:
    """The hash of `size` words from each word on (past the end: of nothing)."""
    got = windows(h, size, 330 + 10 * size)
    return np.append(got, np.zeros(len(h) - len(got), np.uint64))


def sketch(chunks: DataFrame, bits: int, least: int) -> np.ndarray:
    """One bit for each of 2**bits cells: do the runs of up to SKETCHED words there occur `least` times or more in all?"""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def out() -> pa.RecordBatch:
            cell, times = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order = np.argsort(cell)
            cell, times = cell[order], times[order]
            first = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
            times, cell = np.minimum(np.add.reduceat(times, first), least).astype(np.uint32), cell[first]
            block = (cell >> np.uint32(BLOCK_BITS)).astype(np.int32)
            at = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
            low, few = cell.astype(np.uint16), times < 256
            rows = [(int(block[i]), low[i:j][few[i:j]].tobytes(), times[i:j][few[i:j]].astype(np.uint8).tobytes(), low[i:j][~few[i:j]].tobytes(), times[i:j][~few[i:j]].tobytes()) for i, j in zip(at, np.append(at[1:], len(cell)), strict=True)]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[k] for r in rows], pa.binary()) for k in range(1, 5))], names=["block", "low", "few", "high", "many"])

        for b in batches:
            weight = b.column(3).to_numpy()
            for _, row, begins, rest, h in _read(b):
                times = weight[row]
                for k in range(1, SKETCHED + 1):
                    ok = begins & (rest >= k - 1)
                    held.append((_cells(h[ok] if k == 1 else _spans(h, k)[ok], bits), times[ok]))
                if sum(len(x[0]) for x in held) > FLUSH:
                    yield out()
        if sum(len(x[0]) for x in held):
            yield out()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, np.ndarray] = {}
        for b in batches:
            for k, low, few, high, many in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                have = seen.setdefault(k, np.zeros(1 << BLOCK_BITS, np.uint32))
                for at, add in ((low, np.frombuffer(few, np.uint8)), (high, np.frombuffer(many, np.uint32))):
                    cell = np.frombuffer(at, np.uint16)
                    have[cell] = np.minimum(have[cell].astype(np.int64) + add, least)
        for k, have in seen.items():
            if (have >= least).any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([np.packbits(have >= least).tobytes()], pa.binary())], names=["block", "bits"])

    parts = chunks.mapInArrow(count, "block int, low binary, few binary, high binary, many binary")
    merged = parts.repartition("block").mapInArrow(merge, "block int, bits binary")
    table = np.zeros((1 << (bits - BLOCK_BITS), 1 << (BLOCK_BITS - 3)), np.uint8)
    for r in merged.toLocalIterator():
        table[r["block"]] = np.frombuffer(r["bits"], np.uint8)
    return table.reshape(-1)


def _hit(cell: np.ndarray, table: np.ndarray) -> np.ndarray:
    return (table[cell >> np.uint32(3)] >> (np.uint32(7) - (cell & np.uint32(7))).astype(np.uint8)) & np.uint8(1) > 0


def runs(chunks: DataFrame, size: int, bits: int, least: int) -> DataFrame:
    """lang, k, phrase, f: every run of 1 to `size` words that the sketch lets pass, with its exact count."""
    sent = chunks.sparkSession.sparkContext.broadcast(sketch(chunks, bits, least))
    buckets = 4 * partitions(chunks.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def out() -> pa.RecordBatch:
            lang, word, single, pair, triple, begins, rest, times = zip(*held, strict=True)
            held.clear()
            lang = pa.concat_arrays(lang).dictionary_encode()
            word = pa.concat_arrays(word).dictionary_encode()
            single, pair, triple, begins, rest, times = (np.concatenate(x) for x in (single, pair, triple, begins, rest, times))
            # Codes of what passes, dense at each length: a run's code is its first words' code and its last word's.
            words = np.zeros(len(single), np.int64)
            words[single] = word.indices.to_numpy()
            wide = max(1, len(word.dictionary))
            tongue = lang.indices.to_numpy().astype(np.int64)
            at = np.flatnonzero(single)
            kinds, code = np.unique(tongue[at] * wide + words[at], return_inverse=True)
            now = np.full(len(single), -1, np.int64)
            now[at] = code
            text, owner = word.dictionary.take(pa.array(kinds % wide)), kinds // wide
            ends = np.frombuffer(word.dictionary.buffers()[1], np.int64)[word.dictionary.offset :][: len(word.dictionary) + 1]
            every = np.frombuffer(word.dictionary.buffers()[2] or b"", np.uint8)
            hashed = Words(every, ends[:-1], ends[1:], ends[:0], ends[:0], 0).hashes()
            mark = hashed[kinds % wide]
            rows: list[tuple] = []
            for k in range(1, size + 1):
                if k > 1:
                    # A run goes on while its next pair and word pass and it stays in its piece.
                    at = at[(at + k - 1 < len(single)) & (rest[at] >= k - 1)]
                    at = at[pair[at + k - 2] & single[at + k - 1]]
                    if k > 2:
                        at = at[triple[at + k - 3]]
                    kinds, code = np.unique(now[at] * wide + words[at + k - 1], return_inverse=True)
                    now = np.full(len(single), -1, np.int64)
                    now[at] = code
                    before, after = pa.array(kinds // wide), pa.array(kinds % wide)
                    text, owner = pc.binary_join_element_wise(text.take(before), word.dictionary.take(after), pa.scalar(b" ", pa.large_binary())), owner[kinds // wide]
                    mark = mix(mark[kinds // wide] + mix(hashed[kinds % wide], k))
                if not len(at):
                    break
                mine = begins[at]
                total = np.bincount(code[mine], times[at][mine], len(kinds)).astype(np.int64)
                some = np.flatnonzero(total)
                rows.append((mark[some], lang.dictionary.take(pa.array(owner[some])), np.full(len(some), k, np.int32), text.take(pa.array(some)), total[some]))
            mark, owner, k, text, total = zip(*rows, strict=True) if rows else ([np.zeros(0, np.uint64)], [pa.array([], pa.string())], [np.zeros(0, np.int32)], [pa.array([], pa.large_binary())], [np.zeros(0, np.int64)])
            bucket = (np.concatenate(mark) % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            bucket, place = bucket[order], pa.array(order)
            cut = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.zeros(0, np.int64)
            offsets = pa.array(np.append(cut, len(bucket)).astype(np.int32))
            flat = (pa.concat_arrays(owner).cast(pa.string()), pa.array(np.concatenate(k)), pa.concat_arrays(text).cast(pa.binary()), pa.array(np.concatenate(total)))
            return pa.RecordBatch.from_arrays([pa.array(bucket[cut]), *(pa.ListArray.from_arrays(offsets, x.take(place)) for x in flat)], names=["bucket", "lang", "k", "phrase", "f"])

        size_held = 0
        for b in batches:
            weight = b.column(3).to_numpy()
            for w, row, begins, rest, h in _read(b):
                single = _hit(_cells(h, bits), sent.value)
                pair = _hit(_cells(_spans(h, 2), bits), sent.value) & (rest > 0)
                triple = _hit(_cells(_spans(h, 3), bits), sent.value) & (rest > 1)
                lengths = (w.end - w.start)[single]
                ends = np.cumsum(lengths)
                bytes_ = w.data[np.repeat(w.start[single] - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)]
                offsets = np.concatenate([[0], ends]).astype(np.int64)
                word = pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(bytes_)])
                held.append((b.column(0).take(pa.array(row)), word, single, pair, triple, begins, rest, weight[row]))
                size_held += len(single)
                if size_held > FLUSH:
                    yield out()
                    size_held = 0
        if size_held:
            yield out()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["lang", "k", "phrase"]
        held: list[pa.Table] = []

        def summed() -> pa.Table:
            both = pa.concat_tables(held)
            return both.group_by(names).aggregate([("f", "sum")]).rename_columns([*names, "f"])

        for b in batches:
            held.append(pa.table([b.column(i).flatten() for i in range(1, 5)], names=[*names, "f"]))
            if sum(t.num_rows for t in held[1:]) > FLUSH:
                held = [summed()]
        if held:
            yield from (t := summed()).filter(pc.greater_equal(t["f"], least)).to_batches()

    counted = chunks.mapInArrow(count, "bucket int, lang array<string>, k array<int>, phrase array<binary>, f array<bigint>")
    return counted.repartition("bucket").mapInArrow(add, "lang string, k int, phrase binary, f long").withColumn("phrase", F.col("phrase").cast("string"))


def _exact(c: Column) -> Column:
    return c.cast("decimal(19,0)")


def collocations(docs: DataFrame, size: int = 5, least: int = 100, most: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first `most` phrases of 2 to `size` words.

    a: the phrase's count (`least` at least), n: all words of the language; l and r: the counts of the two parts of the
    cut of least score, floor(1000 a n / (l r)), of several that cut first. A phrase inside a longer frequent one with
    no smaller count is dropped. Ordered by score, a, phrase (bytes). Null lang: und; null or blank text: no words; an
    empty table: no rows. Repeated rows and equal texts count as often as they stand there; texts of any length are
    parsed whole; other columns are not read.
    """
    chunks = materialize(parse(docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text"), size))
    words = materialize(chunks.groupBy("lang").agg(F.sum(F.col("own") * F.col("n")).alias("n")))
    total = words.agg(F.sum("n")).first()[0] or 0
    bits = min(MOST_BITS, max(LEAST_BITS, (16 * total // least).bit_length()))
    frequent = materialize(runs(chunks, size, bits, least))
    parts = F.split("phrase", " ")
    found = frequent.filter("k > 1").select("lang", "phrase", "k", F.col("f").alias("a"), parts.alias("_w"))
    side = lambda name: frequent.select("lang", F.col("phrase").alias(f"_{name}"), F.col("f").alias(name))
    cuts = found.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    cuts = cuts.withColumns({"_l": F.array_join(F.slice("_w", F.lit(1), F.col("cut")), " "), "_r": F.array_join(F.slice("_w", F.col("cut") + 1, F.col("k") - F.col("cut")), " ")})
    cuts = cuts.join(side("l"), ["lang", "_l"]).join(side("r"), ["lang", "_r"]).join(words, "lang")
    cuts = cuts.withColumns({"_up": _exact(1000 * F.col("a")) * F.col("n").cast("decimal(18,0)"), "_down": F.col("l").cast("decimal(18,0)") * F.col("r").cast("decimal(18,0)")})
    cuts = cuts.withColumn("score", F.expr("_up div _down"))
    scored = cuts.groupBy("lang", "phrase").agg(F.max("a").alias("a"), F.max("n").alias("n"), F.min(F.struct("score", "cut", "l", "r")).alias("_m"))
    scored = scored.select("lang", "phrase", "a", "_m.l", "_m.r", "n", "_m.score")
    # All contiguous parts of the longer ones, and the greatest count of what they lie in.
    begin = found.filter("k > 2").withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    span = F.explode(F.sequence(F.lit(2), F.least(F.col("k") - 1, F.col("k") - F.col("_i") + 1)))
    inside = begin.withColumn("_s", span).select("lang", F.array_join(F.slice("_w", F.col("_i"), F.col("_s")), " ").alias("phrase"), "a")
    holder = inside.groupBy("lang", "phrase").agg(F.max("a").alias("_most"))
    left = scored.join(holder, ["lang", "phrase"], "left").filter(F.coalesce("_most", F.lit(0)) < F.col("a"))
    # A language is ranked in parts first, so no task takes all of its phrases.
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    dealt = left.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(DEAL)))
    best = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).filter(F.col("rank") <= most)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= most)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
