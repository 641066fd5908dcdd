"""Registered queries and the pipeline without SQL against plain versions of them."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from cyclonet.llm import bpe, common, packing, queries, sharding

SF = "/root/testdata/sf0.001"
SOLID = r"[^\x20\x09-\x0D]+"


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(bpe.default_path())


def pieces_of(tokenizer, text: str | None, size: int = 2048) -> list[tuple[int, int, int, int]]:
    """Number, start, length and checksum of a text's pieces; only the first of several may be short."""
    ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
    starts = [0] if len(ids) <= size else sorted({0, *range(len(ids) - size, 0, -size)})
    out = []
    for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)], strict=True)):
        out.append((k, a, b - a, zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids[a:b]))))
    return out


def plain_bins(lengths: list[int], size: int = 2048) -> int:
    """Sequences of best fit over all pieces at once, the longest first, each put by looking at every open sequence."""
    rooms: list[int] = []
    for n in sorted(lengths, reverse=True):
        fitting = [i for i, r in enumerate(rooms) if r >= n]
        if fitting:
            rooms[min(fitting, key=lambda i: rooms[i])] -= n
        else:
            rooms.append(size - n)
    return len(rooms)


def check_packing(rows, want: Counter, size: int = 2048, slack: float = 1.0) -> None:
    """Every wanted piece once, sequences without gaps or excess, and no more of them than plain best fit makes (x slack)."""
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    assert len(sequences) <= slack * plain_bins([k[3] for k in want.elements()], size)


def test_query_of_packing(spark, tokenizer):
    docs = common.table(spark, SF, "documents").select("doc_id", "text").collect()
    want = Counter((d.doc_id, *p) for d in docs for p in pieces_of(tokenizer, d.text))
    check_packing(queries.op5_best_fit_packing(spark, SF).collect(), want)


def test_rounds_of_packing_come_near_best_fit_over_all(spark, tokenizer):
    """Twenty tasks in three rounds: 486 sequences when this was written, 481 by plain best fit over all pieces."""
    docs = common.table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text")
    want = Counter((d.doc_id, *p) for d in docs.collect() for p in pieces_of(tokenizer, d.text))
    check_packing(packing.pack(docs.repartition(20), 2048).collect(), want, slack=1.02)


def test_query_of_sharding(spark):
    """Cuts, slots and shards by plain running sums over the order that the query's shards and slots state; that order
    by the curve's index of each row's cell (which test_hilbert_neighbours holds)."""
    docs = {d.doc_id: d for d in common.table(spark, SF, "documents").collect()}
    got = {r.doc_id: r for r in queries.op8_sharding(spark, SF).collect()}
    assert got.keys() == docs.keys()
    body = {i: (d.text or "").encode() for i, d in docs.items()}
    assert all((r.size, r.text_crc32, r.law, r.grown_shard) == (len(body[i]) + 1, zlib.crc32(body[i]), "bytes", None) for i, r in got.items())
    order = sorted(got, key=lambda i: (got[i].shard, got[i].slot))
    for s in range(8):
        slots = [got[i].slot for i in order if got[i].shard == s]
        assert slots == list(range(len(slots)))
    # Plain cuts: a group's middle byte (a row's, in groups that are too large to stay whole) over an eighth of all bytes.
    total, largest = sum(r.size for r in got.values()), max(r.size for r in got.values())
    group = {i: xxhash.xxh64(body[i], seed=42).intdigest() for i in got}
    size = Counter()
    for i in got:
        size[group[i]] += got[i].size
    before, at = {}, 0
    for i in order:
        before[i] = at
        at += got[i].size
    start = {}
    for i in order:
        start.setdefault(group[i], before[i])
    for i in order:
        whole = size[group[i]] * 8 <= total * 0.01 or size[group[i]] <= largest
        middle = start[group[i]] + size[group[i]] / 2 if whole else before[i] + got[i].size / 2
        assert got[i].shard == min(7, math.floor(middle * 8 / total))
    level = lambda name: zlib.crc32((name or "").encode()) % 32
    cells = [(i, level(d.lang), level(d.source), min(31, math.floor(math.log2(got[i].size + 1) * 1.5))) for i, d in docs.items()]
    dims = [F.col(c) for c in ("a", "b", "c")]
    curve = {r.i: r.at for r in sharding.with_hilbert_index(spark.createDataFrame(cells, "i long, a long, b long, c long"), "at", dims, 5).collect()}
    least: dict[int, int] = {}
    for i in order:
        least[group[i]] = min(least.get(group[i], curve[i]), curve[i])
    places = [(least[group[i]], group[i] - (group[i] >> 63 << 64)) for i in order]
    assert places == sorted(places)


PATTERNS = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))


def plain_pipeline(rows: list[tuple], tokenizer) -> Counter:
    """The stages one after another in plain Python, for rows that are far from every threshold."""
    kept = []
    for i, t in rows:
        w = re.findall(SOLID, t or "")
        seen = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        again = {j for k in range(len(w) - 2) if seen[tuple(w[k : k + 3])] > 1 for j in range(k, k + 3)}
        if len(w) >= 50 and 100 * len(again) <= 50 * len(w) and 2 * sum(c in "#*$%&|<>" for c in t) < len(w):
            kept.append((i, t))
    shingles = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (t.split() for _, t in kept)]
    order = sorted(range(len(kept)), key=lambda x: (kept[x][0] is not None, kept[x][0] or 0, hashlib.md5(kept[x][1].encode()).hexdigest()))
    label = list(range(len(kept)))
    for a in range(len(kept)):
        for b in range(a):
            if len(shingles[a] & shingles[b]) >= 0.85 * len(shingles[a] | shingles[b]) and label[a] != label[b]:
                label = [label[b] if x == label[a] else x for x in label]
    first: dict[int, int] = {}
    for x in order:
        first.setdefault(label[x], x)
    kept = [kept[x] for x in sorted(first.values())]
    words = [re.findall(SOLID, t) for _, t in kept]
    seen = Counter(tuple(w[k : k + 35]) for w in words for k in range(len(w) - 34))
    out = Counter()
    for (i, t), w in zip(kept, words, strict=True):
        gone = {j for k in range(len(w) - 34) if seen[tuple(w[k : k + 35])] > 1 for j in range(k, k + 35)}
        text = " ".join(x for j, x in enumerate(w) if j not in gone) if gone else t
        for kind, pattern in PATTERNS:
            text = re.sub(pattern, f"[{kind.upper()}]", text)
        out.update((i, *p) for p in pieces_of(tokenizer, text))
    return out


def test_pipeline_against_plain_stages(spark, tokenizer, tmp_path):
    """Junk, exact and near copies, shared passages, personal data, long texts, nulls, blanks, a null id, repeated rows."""
    vocab = [f"v{k}" for k in range(900)]
    r = random.Random(5)
    text = lambda n: [r.choice(vocab) for _ in range(n)]
    rows: list[tuple] = []
    passage = text(60)
    for k in range(260):
        w = text(r.randint(60, 260))
        if k % 20 == 0:
            w[10:10] = passage
        if k % 9 == 0:
            w[5:5] = [f"u{k}@host{k}.example,", "or", f"+49 30 {1000000 + k}."]
        rows.append((len(rows), " ".join(w)))
        if k % 25 == 3:
            rows.append((len(rows), rows[-1][1]))
            w[30] = "changed"
            rows.append((len(rows), "  ".join(w)))
    for _ in range(30):
        rows.append((len(rows), " ".join(f"{x} ##" for x in text(70))))
    rows += [(5000, None), (5001, ""), (5002, " \n\t "), (5003, "too short"), (5004, "same words here " * 40), (None, " ".join(text(90))), (5005, " ".join(text(9000)))]
    rows.append(rows[7])
    schema = "doc_id long, text string, lang string, source string, n_chars long, _id string, node string, kept string"
    full = [(i, t, "en" if (i or 0) % 2 else None, "s", len(t or ""), "a", "b", "c") for i, t in rows]
    spark.createDataFrame(full, schema).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    marks = [(i, int("##" not in t), 0) for i, t in rows if i is not None and i < 5000]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    want = plain_pipeline(rows, tokenizer)
    assert 200 < len({k[0] for k in want}) < len(rows) - 40
    check_packing(got, want, slack=1.02)


def test_pipeline_over_no_rows(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
