"""Near-duplicate classes: improved consistent weighted sampling over TF-IDF shingles, banded, verified.

Weights. A shingle is five consecutive words (a shorter text is one shingle); its weight is its count in the text times
1 + STRENGTH * ln(N / df) / ln(N). Document frequencies come from a count-mean-min sketch of fixed size that every
task fills and that is merged by blocks: it takes in every shingle of every document, and its error stays a fixed share
of the corpus.

Sampling. PASSES passes; in each, a shingle draws r, c, beta and a bin from its hash, and each bin keeps the shingle of
least a = c / (y e^r) (Ioffe's scheme, one evaluation a pass instead of one a sample). An empty bin takes the next full
one's sample. A band is one bin number over all passes.

Candidates. Equal texts are one node. In each band's buckets every node meets one pivot, and pairs are verified by the
exact weighted Jaccard similarity. A pivot has then met its whole bucket and leaves it; buckets that still hold several
components get another one. Where pivots link little any more, all pairs of the buckets that still hold several
components are compared in blocks: a bucket is dealt into chunks of bounded size, each two chunks meet in one group,
and that group adds up the common weights of its texts shingle by shingle and returns only links between components.
So every two texts that share a band are linked, compared, or in one component already.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, row_key, shield
from .words import Words, mix, split, windows

SIZE = 5
PASSES, BINS = 4, 16
STRENGTH = 0.5
DF_ROWS, DF_BITS, DF_BLOCK = 2, 18, 12
#: Buckets are compared in blocks when this many rounds in a row link at most this share of the pairs they test.
QUIET_ROUNDS, QUIET_SHARE = 2, 0.01
CHUNK, CHUNK_TEXT = 512, 8 << 20  # texts of a chunk, and their bytes (a longer text is a chunk by itself)
FEW, DENSE = 256, 1024
SHRINK = 16  # links and pairs are a small part of the input


def shingles(w: Words, size: int = SIZE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document number, hash and count of each document's distinct shingles, ordered by document."""
    n = np.diff(w.first)
    h = w.hashes()
    doc = w.doc
    full = windows(h, size, 2)
    ok = np.arange(len(full)) + size <= w.first[1:][doc[: len(full)]] if len(full) else np.zeros(0, bool)
    value, owner = full[ok], doc[: len(full)][ok]
    short = np.flatnonzero((n > 0) & (n < size))
    if len(short):
        whole = np.zeros(len(short), np.uint64)
        for j in range(size - 1):
            has = n[short] > j
            whole[has] = mix(whole[has] + h[w.first[short[has]] + j], 50 + j)
        value, owner = np.concatenate([value, whole]), np.concatenate([owner, short])
    if not len(value):
        return owner, value, np.zeros(0, np.int64)
    _, at, count = np.unique(mix(value + mix(owner.astype(np.uint64), 3)), return_index=True, return_counts=True)
    order = np.lexsort((value[at], owner[at]))
    return owner[at][order], value[at][order], count[order]


def df_cells(value: np.ndarray, row: int) -> np.ndarray:
    return mix(value, 60 + row) >> np.uint64(64 - DF_BITS)


def frequency_sketch(docs: DataFrame) -> tuple[np.ndarray, int]:
    """The merged sketch of document frequencies, [DF_ROWS, 2**DF_BITS], and the number of documents.

    Its size, and so what reaches the driver, is fixed.
    """
    per = 1 << DF_BLOCK

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = np.zeros((DF_ROWS, 1 << DF_BITS), np.int64), 0
        for b in batches:
            n += b.num_rows
            for w in split(b.column(0)):
                value = shingles(w)[1]
                for r in range(DF_ROWS):
                    held[r] += np.bincount(df_cells(value, r).astype(np.int64), minlength=1 << DF_BITS)
        if n:
            blocks = held.reshape(-1, per)
            full = np.flatnonzero(blocks.any(1))
            number = pa.array(np.append(full, -1), pa.int32())
            counts = [blocks[k].astype(np.uint32).tobytes() for k in full]
            yield pa.RecordBatch.from_arrays([number, pa.array([*counts, np.array([n], np.uint32).tobytes()], pa.binary())], names=["block", "counts"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, counts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                add = np.frombuffer(counts, np.uint32).astype(np.int64)
                sums[k] = sums[k] + add if k in sums else add
        for k, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([v.tobytes()], pa.binary())], names=["block", "counts"])

    merged = docs.select("text").mapInArrow(fill, "block int, counts binary").repartition("block").mapInArrow(merge, "block int, counts binary")
    out, n = np.zeros((DF_ROWS << DF_BITS) // per * per, np.int64).reshape(-1, per), 0
    for r in merged.toLocalIterator():
        counts = np.frombuffer(r["counts"], np.int64)
        if r["block"] < 0:
            n = int(counts[0])
        else:
            out[r["block"]] = counts
    return out.reshape(DF_ROWS, -1), n


def weight_tables(counts: np.ndarray, n: int) -> np.ndarray:
    """For each cell of the sketch, the weight of a shingle of count 1 that falls there (float32)."""
    width = counts.shape[1]
    noise = (counts.sum(1, keepdims=True) - counts) / max(1, width - 1)
    df = np.clip(counts - noise, 1.0, max(1, n))
    top = math.log(max(2, n))
    return (1.0 + STRENGTH * (top - np.log(df)).clip(0) / top).astype(np.float32)


def weights(value: np.ndarray, count: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """TF-IDF weight of each shingle: the least estimated frequency, so the greatest cell weight, over the rows."""
    idf = tables[0][df_cells(value, 0)]
    for r in range(1, len(tables)):
        idf = np.maximum(idf, tables[r][df_cells(value, r)])
    return count * idf.astype(np.float64)


def signatures(owner: np.ndarray, value: np.ndarray, weight: np.ndarray, docs: int) -> np.ndarray:
    """[docs, BINS] band hashes; documents without shingles get zeros."""
    band = np.zeros((docs, BINS), np.uint64)
    log_w = np.log(weight)
    for p in range(PASSES):
        m1, m2 = mix(value, 100 + 2 * p), mix(value, 101 + 2 * p)
        low = np.uint64((1 << 21) - 1)
        r = -np.log(((m1 & low) + np.uint64(1)) * ((m1 >> np.uint64(21) & low) + np.uint64(1)).astype(np.float64) * 2.0**-42)
        beta = (m1 >> np.uint64(42)) * 2.0**-22
        low = np.uint64((1 << 30) - 1)
        c = -np.log(((m2 & low) + np.uint64(1)).astype(np.float64) * ((m2 >> np.uint64(30) & low) + np.uint64(1)) * 2.0**-60)
        r, c = np.maximum(r, 1e-9), np.maximum(c, 1e-9)
        t = np.floor(log_w / r + beta)
        a = np.log(c) - r * (t - beta) - r
        slot = owner * BINS + (m2 >> np.uint64(60)).astype(np.int64) % BINS
        least = np.full(docs * BINS, np.inf)
        np.minimum.at(least, slot, a)
        won = np.flatnonzero(a == least[slot])
        sample = np.zeros(docs * BINS, np.uint64)
        sample[slot[won]] = mix(value[won] + t[won].astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), p)
        sample, full = sample.reshape(docs, BINS), np.isfinite(least).reshape(docs, BINS)
        for _ in range(BINS - 1):  # an empty bin borrows from the next one on
            empty = ~full
            if not empty.any():
                break
            sample = np.where(empty, np.roll(sample, -1, 1), sample)
            full = full | np.roll(full, -1, 1)
        band = mix(band + sample, 200 + p)
    return band


def sign(docs: DataFrame, tables: Broadcast) -> DataFrame:
    """doc_id (null: the lowest long), node (a hash of the text) and bands for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[bytes | None] = []
            for w in split(b.column(2)):
                owner, value, count = shingles(w)
                band = signatures(owner, value, weights(value, count, tables.value), w.docs)
                words = np.diff(w.first)
                out += [x.tobytes() if k else None for x, k in zip(band, words, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary())], names=["doc_id", "node", "bands"])

    return docs.select(row_key()[0].alias("doc_id"), node_key(), "text").mapInArrow(run, "doc_id long, node string, bands binary")


def node_key():
    """32 hexadecimal digits that equal texts share."""
    return F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("node")


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two sets given as sorted hashes with weights."""
    if not len(a[0]) or not len(b[0]):
        return float(len(a[0]) == len(b[0]))
    at = np.searchsorted(b[0], a[0]).clip(max=len(b[0]) - 1)
    both = b[0][at] == a[0]
    common = np.minimum(a[1][both], b[1][at[both]]).sum()
    return float(common / (a[1].sum() + b[1].sum() - common))


def vectors(texts: pa.Array, tables: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    out = []
    for w in split(texts):
        owner, value, count = shingles(w)
        weight = weights(value, count, tables)
        cut = np.searchsorted(owner, np.arange(w.docs + 1))
        out += [(value[a:b], weight[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
    return out


def verify(pairs: DataFrame, texts: DataFrame, tables: Broadcast, least: float) -> DataFrame:
    """Of the pairs (node, pivot), those at least that similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pivots = b.column(3).dictionary_encode()
            own, other, which = vectors(b.column(2), tables.value), vectors(pivots.dictionary, tables.value), pivots.indices.to_numpy()
            yes = [similarity(x, other[k]) >= least for x, k in zip(own, which, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(i).filter(pa.array(yes, pa.bool_())) for i in (0, 1)], names=["node", "pivot"])

    joined = pairs.join(texts, "node").withColumnRenamed("text", "_a").join(texts.withColumnsRenamed({"node": "pivot", "text": "_b"}), "pivot")
    return joined.select("node", "pivot", "_a", "_b").mapInArrow(run, "node string, pivot string")


def leveled(texts: pa.Array, tables: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, feature and weight, ordered by feature: a shingle that a text has c times gives it c features of one
    weight each, so the weight that two texts have in common is that of their common features."""
    out: list[tuple[np.ndarray, ...]] = []
    for w in split(texts):
        owner, value, count = shingles(w)
        at = np.repeat(np.arange(len(value)), count)
        level = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
        idf = weights(value, np.ones(len(value), np.int64), tables)
        feature = np.where(level == 0, value[at], mix(value[at] + mix(level.astype(np.uint64), 90), 91))
        out.append((owner[at] + w.row, feature, idf[at]))
    owner, feature, weight = (np.concatenate(x) for x in zip(*out, strict=True))
    order = np.argsort(feature, kind="stable")
    return owner[order], feature[order], weight[order]


def common_weights(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...], m: int, n: int) -> np.ndarray:
    """[m, n]: the weight of the features that each two texts of `leveled` a and b share.

    Features of many pairs go through a product of matrices, DENSE at a time, the others pair by pair.
    """
    (ia, va, wa), (ib, vb, _) = a, b
    both = np.intersect1d(va, vb)
    at, bt = np.searchsorted(va, both), np.searchsorted(vb, both)
    na, nb = np.searchsorted(va, both, "right") - at, np.searchsorted(vb, both, "right") - bt
    out = np.zeros((m, n))
    many = np.flatnonzero(na * nb > FEW)
    for k in range(0, len(many), DENSE):
        own = many[k : k + DENSE]
        sides = []
        for i, start, size, rows in ((ia, at[own], na[own], m), (ib, bt[own], nb[own], n)):
            column = np.repeat(np.arange(len(own)), size)
            place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start, size)
            side = np.zeros((rows, len(own)))
            side[i[place], column] = 1.0
            sides.append(side)
        out += (sides[0] * wa[at[own]]) @ sides[1].T
    few = np.flatnonzero(na * nb <= FEW)
    for k in range(0, len(few), 1 << 14):
        own = few[k : k + (1 << 14)]
        pairs = na[own] * nb[own]
        which = np.repeat(own, pairs)
        nth = np.arange(pairs.sum()) - np.repeat(np.cumsum(pairs) - pairs, pairs)
        p, q = at[which] + nth // nb[which], bt[which] + nth % nb[which]
        out += np.bincount(ia[p] * n + ib[q], wa[p], m * n).reshape(m, n)
    return out


def mixed(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    """The members of buckets that hold several components, with their labels."""
    named = members.withColumn("label", F.col("node")) if labels is None else members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    several = named.groupBy("bucket").agg(F.min("label").alias("_l"), F.max("label").alias("_m")).filter("_l <> _m").select("bucket")
    return named.join(several, "bucket").select(*members.columns, "label")


def settle(members: DataFrame, labels: DataFrame | None, texts: DataFrame, tables: Broadcast, least: float) -> DataFrame | None:
    """The links (node, pivot) that the buckets' components still lack, from all pairs of each bucket; None: no bucket is mixed.

    Texts go to the group of each two chunks of their bucket, so a bucket of n texts sends n / CHUNK copies of each, and
    no group holds more than two chunks. Of a group's links only those come out that join two components.
    """
    open_ = materialize(mixed(members, labels), SHRINK)
    if open_.isEmpty():
        return None
    sized = open_.join(texts.select("node", F.octet_length("text").alias("_b")), "node")
    chunks = F.greatest(F.ceil(F.count("*") / F.lit(CHUNK)), F.ceil(F.sum("_b") / F.lit(CHUNK_TEXT)), F.lit(1)).cast("int")
    dealt = open_.join(sized.groupBy("bucket").agg(chunks.alias("_n")), "bucket")
    dealt = dealt.withColumn("_k", F.pmod(F.xxhash64("node"), F.col("_n")).cast("int")).withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    dealt = dealt.select("bucket", "node", "label", "_k", F.least("_k", "_o").alias("_i"), F.greatest("_k", "_o").alias("_j"))

    def compare(t: pa.Table) -> pa.Table:
        i, j, k = t["_i"][0].as_py(), t["_j"][0].as_py(), t["_k"].to_numpy()
        own, other = np.flatnonzero(k == i), np.flatnonzero(k == j)
        node, label = t["node"].to_pylist(), t["label"].to_pylist()
        links: list[tuple[str, str]] = []
        if len(own) and len(other):
            texts = t["text"].combine_chunks()
            a = leveled(texts.take(pa.array(own)), tables.value)
            b = a if i == j else leveled(texts.take(pa.array(other)), tables.value)
            common = common_weights(a, b, len(own), len(other))
            size = [np.bincount(x[0], x[2], n) for x, n in ((a, len(own)), (b, len(other)))]
            root: dict[str, str] = {}
            for x, y in zip(*np.nonzero(common >= least * (size[0][:, None] + size[1][None, :] - common)), strict=True):
                p, q = label[own[x]], label[other[y]]
                while p in root:
                    p = root[p]
                while q in root:
                    q = root[q]
                if p != q:
                    root[max(p, q)] = min(p, q)
                    links.append((node[own[x]], node[other[y]]))
        return pa.table({"node": pa.array([x for x, _ in links], pa.string()), "pivot": pa.array([y for _, y in links], pa.string())})

    met = dealt.join(texts.select("node", "text"), "node").groupBy("bucket", "_i", "_j")
    return materialize(met.applyInArrow(compare, "node string, pivot string"), SHRINK)


def components(links: DataFrame) -> DataFrame:
    """node, label for every node that has a link; the label is the least node of the component.

    Least labels spread over the links and then jump to their own label's label; each round is written out. A root is not
    hooked itself, so the rounds are few for the star-like classes that pivots make, but grow with the length of a chain.
    """
    both = materialize(links.select(F.col("node").alias("a"), F.col("pivot").alias("b")).union(links.select("pivot", "node")).distinct(), SHRINK)
    labels = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), SHRINK)
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("m"))
        hooked = labels.join(near, labels["node"] == near["a"]).select("node", F.col("label").alias("was"), F.least("label", "m").alias("label"))
        parent = labels.select(F.col("node").alias("_p"), F.col("label").alias("_pl"))
        jumped = materialize(hooked.join(parent, hooked["label"] == parent["_p"]).select("node", "was", F.least("label", "_pl").alias("label")), SHRINK)
        labels = jumped.select("node", "label")
        if jumped.filter("was <> label").isEmpty():
            return labels


def classes(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """doc_id, node and class_id for each row; class_id is the least doc_id among the class's rows.

    A class is a component of links of weighted Jaccard similarity `least` or more between different texts, with all
    rows of equal text. Null text: as the empty text; texts without words link to nothing but their equals. Null
    doc_id: the lowest long. Empty table: no rows. Repeated rows: each keeps its row.
    """
    spark = docs.sparkSession
    counts, n = frequency_sketch(docs)
    tables = spark.sparkContext.broadcast(weight_tables(counts, n))
    signed = materialize(sign(docs, tables))
    nodes = signed.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.max("bands").alias("bands"))
    part = F.expr("transform(sequence(0, %d), i -> struct(i AS band, substring(bands, 8 * i + 1, 8) AS value))" % (BINS - 1))
    bands = nodes.filter(F.col("bands").isNotNull()).select("node", "doc_id", F.inline(part))
    bands = bands.select("node", "doc_id", F.xxhash64("band", "value").alias("bucket"))
    several = bands.groupBy("bucket").agg(F.count("*").alias("n"), F.min("node").alias("_low")).filter("n > 1").select("bucket", "n")
    members = materialize(bands.join(several, "bucket"))
    # Copies of one text differ from it at places of their own, so it lies in the fullest bucket of every band.
    met = members.groupBy("node", "doc_id").agg(F.sum("n").alias("score"))
    # One text a node: the row of least doc_id, which the hash and the id name.
    texts = docs.select(row_key()[0].alias("doc_id"), node_key(), F.coalesce("text", F.lit("")).alias("text"))
    texts = materialize(texts.join(met, ["node", "doc_id"], "left_semi").dropDuplicates(["node"]))
    members = members.select("bucket", "node").join(met.select("node", "score"), "node")
    links = labels = None
    quiet = rounds = 0
    while quiet < QUIET_ROUNDS:
        open_ = members.withColumn("label", F.col("node")) if not rounds else materialize(mixed(members, labels), SHRINK)
        if rounds and open_.isEmpty():
            break
        rank = F.struct(-F.col("score"), F.xxhash64("node"))
        pivots = open_.groupBy("bucket").agg(F.min_by(F.struct("node", "label"), rank).alias("_p"))
        met = open_.join(pivots, "bucket").filter(F.col("node") != F.col("_p.node"))
        pairs = met.filter(F.col("label") != F.col("_p.label")).select("node", F.col("_p.node").alias("pivot")).distinct()
        pairs = materialize(pairs, SHRINK)
        found = materialize(verify(pairs, texts, tables, least))
        members = met.select("bucket", "node", "score")  # the pivot has met its whole bucket
        rounds += 1
        n_found = found.count()
        quiet = quiet + 1 if n_found <= QUIET_SHARE * pairs.count() else 0
        if n_found:
            links = found if links is None else links.union(found)
            labels = components(links)
    if quiet == QUIET_ROUNDS:
        found = settle(members, labels, texts, tables, least)
        if found is not None and not found.isEmpty():
            labels = components(found if links is None else links.union(found))
    named = signed.select("doc_id", "node")
    if labels is None:
        named = named.withColumn("label", F.col("node"))
    else:
        named = named.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least_id = named.groupBy("label").agg(F.min("doc_id").alias("class_id"))
    return named.join(least_id, "label").select("doc_id", "node", "class_id")


def keep_one(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """docs with one row for each class: that of the least doc_id, and of the least text hash among those.

    Null and empty texts are one class, a null doc_id is the lowest, and of repeated rows one stays. Clashing columns
    come back as they were. Empty table: no rows.
    """
    docs, restore = shield(docs, ("doc_id", "text"))
    named = classes(docs, least)
    first = named.filter("doc_id = class_id").groupBy("class_id").agg(F.min("node").alias("_first"))
    keyed = docs.withColumns({"_id": row_key()[0], "_node": node_key()})
    kept = keyed.join(first, (F.col("_id") == F.col("class_id")) & (F.col("_node") == F.col("_first")), "left_semi")
    return restore(kept.dropDuplicates(["_id", "_node"]))
