"""Whitening, phrase collocations and benchmark decontamination against brute force, and on awkward rows."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.mllib.common import JavaModelWrapper
from pyspark.sql import functions as F

from cyclonet.llm import contamination, phrases, queries, whitening

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string"
ITEMS = "item_id long, text string"
VECTORS = "vec_id long, embedding array<float>, label int"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# 11. Whitening


def plain_whitening(rows, most=32):
    """{row number: (deviation, components)}, shares; components up to sign."""
    x = np.array([[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for v in rows], object)
    n, s = len(x), x.sum(0)
    apart = n * x - s
    z = (apart / n).astype(float)
    v = z.T @ z / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:most], u[:, ::-1][:, :most]
    return [int(r) for r in (apart * apart).sum(1)], z @ u / np.sqrt(e), e / np.trace(v), n


def held_to_plain(out, kept, most=32):
    deviation, white, shares, n = plain_whitening([v for _, v in kept], most)
    got = {}
    for r in out:
        got.setdefault(r["vec_id"], {})[r["component"]] = r
    assert set(got) == {k for k, _ in kept}
    k = min(most, len(kept[0][1]))
    assert all(set(v) == set(range(1, k + 1)) for v in got.values())
    mine = np.array([[got[key][c]["whitened"] for c in range(1, k + 1)] for key, _ in kept])
    sign = np.sign((mine * white).sum(0))
    assert np.abs(mine * sign - white).max() < 1e-9
    assert [got[key][1]["deviation"] for key, _ in kept] == deviation
    assert max(abs(r["explained"] - shares[r["component"] - 1]) for r in out) < 1e-12
    assert {r["n"] for r in out} == {n} and len({r["identity_error"] for r in out}) == 1 and out[0]["identity_error"] < 1e-9


def test_query_of_whitening(spark):
    out = queries.op11_embedding_whitening(spark, SF).collect()
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    kept = [(r["vec_id"], r["embedding"]) for r in rows if r["embedding"] is not None and all(c is not None and np.isfinite(c) for c in r["embedding"])]
    held_to_plain(out, kept)


def test_whitening_of_several_blocks(spark, monkeypatch):
    """Rows and columns fill several blocks, the middle dimension several partitions."""
    r = np.random.default_rng(1)
    mixing = r.normal(size=(9, 9))
    kept = [(i, (r.normal(size=9) @ mixing + 50).astype(np.float32).tolist()) for i in range(333)]
    monkeypatch.setattr(whitening, "ROWS", 32)
    monkeypatch.setattr(whitening, "COLS", 4)
    df = spark.createDataFrame([(i, v, 0) for i, v in kept], VECTORS).repartition(5)
    held_to_plain(whitening.whiten(df, 5).collect(), kept, 5)


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    kept = [(1, [1.0, 0.5]), (2, [0.0, 2.0]), (3, [-1.0, 0.25]), (None, [5.0, 1.0]), (4, [0.0, 0.0])]
    odd = [(5, None), (6, [1.0, None]), (7, [nan, 1.0]), (8, [1.0, -inf]), (9, []), (10, [1.0])]
    df = spark.createDataFrame([(i, v, None) for i, v in kept + odd], VECTORS).withColumns({c: F.lit("x") for c in ("x", "_i", "component", "n", "w", "v")})
    held_to_plain(whitening.whiten(df).collect(), kept)
    twice = whitening.whiten(df.unionByName(df)).collect()
    assert len(twice) == 2 * 2 * len(kept) and {r["n"] for r in twice} == {2 * len(kept)}
    for rows in ([], [(1, [1.0, 2.0], 0)], [(k, [1.0, 2.0], 0) for k in range(4)], [(5, None, 0)]):
        out = whitening.whiten(spark.createDataFrame(rows, VECTORS))
        assert out.collect() == [] and out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    flat = whitening.whiten(spark.createDataFrame([(k, [float(k), 2.0, float(-k)], 0) for k in range(6)], VECTORS)).collect()
    assert {r["component"] for r in flat} == {1} and flat[0]["identity_error"] < 1e-9
    far = whitening.whiten(spark.createDataFrame([(k, [k * 1e5], 0) for k in range(100)], VECTORS)).collect()
    assert {r["deviation"] is None for r in far} == {True, False}  # null only where it does not fit


def test_matrices_are_held_while_in_use(spark, monkeypatch):
    """The JVM drops what a collected wrapper held at once here, and not whenever Py4J's worker comes to it."""
    client = spark.sparkContext._gateway._gateway_client
    monkeypatch.setattr(JavaModelWrapper, "__del__", lambda w: client.garbage_collect_object(w._java_model._target_id, False))
    kept = [(i, [float(i), float(i * i % 7), float(-i % 5)]) for i in range(20)]
    held_to_plain(whitening.whiten(spark.createDataFrame([(i, v, 0) for i, v in kept], VECTORS)).collect(), kept)


# 12. Phrases


def plain_collocations(docs, size, least, most):
    count, words = {}, Counter()
    for _, text, lang in docs:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            words[lang] += len(w)
            for k in range(1, size + 1):
                for i in range(len(w) - k + 1):
                    f = count.setdefault(lang, Counter())
                    f[tuple(w[i : i + k])] += 1
    out = []
    for lang, f in count.items():
        found = {p: a for p, a in f.items() if a >= least and len(p) > 1}
        inside = Counter()
        for p, a in found.items():
            for s in range(2, len(p)):
                for i in range(len(p) - s + 1):
                    inside[p[i : i + s]] = max(inside[p[i : i + s]], a)
        rows = []
        for p, a in found.items():
            if inside[p] >= a:
                continue
            score, _, l, r = min((1000 * a * words[lang] // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(rows)[:most], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, words[lang], -score))
    return sorted(out)


def spoken(seed, n):
    """Texts of few words, with fixed phrases, pieces, copies and runs of one word."""
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(30)]
    fixed = ["alpha beta gamma delta epsilon zeta", "The Quick fox", "l'été À deux", "x x x x x x x"]
    texts = []
    for _ in range(n):
        w = []
        for _ in range(r.randint(0, 60)):
            w.append(r.choice(fixed) if r.random() < 0.15 else r.choice(vocabulary))
            if r.random() < 0.1:
                w.append(r.choice([". ", ",", "\n", " ;\t", "!?", "\x0b"]))
        texts.append(" ".join(w))
    texts += [texts[3]] * 12 + [None, "", " \t ", "a", ".,;", "\x00 \x00 b c " * 9, "y " * 4000]
    return [(i, t, r.choice(["en", "en", "fr", None])) for i, t in enumerate(texts)]


@pytest.mark.parametrize("size,least,most,flush", [(5, 8, 2000, 2_000_000), (5, 3, 7, 300), (2, 5, 50, 300)])
def test_collocations_against_brute_force(spark, monkeypatch, size, least, most, flush):
    monkeypatch.setattr(phrases, "FLUSH", flush)
    docs = spoken(size + least, 150)
    df = spark.createDataFrame(docs, DOCS).repartition(3).withColumns({c: F.lit(1) for c in ("n", "k", "phrase", "own", "chunk")})
    got = sorted(tuple(r) for r in phrases.collocations(df, size, least, most).collect())
    assert got == plain_collocations(docs, size, least, most)


def test_chunks_hold_every_word_once_and_copies_share_them(spark):
    r = random.Random(8)
    text = " ".join(f"v{r.randrange(500)}" for _ in range(4000))
    df = spark.createDataFrame([(0, text, "en"), (1, "other words first " + text, "en")], DOCS).select("lang", "text")
    rows = phrases.parse(df, 5).collect()
    assert sum(c["own"] * c["n"] for c in rows) == 8003
    assert sum(c["n"] > 1 for c in rows) > 0.8 * len(rows)  # cut alike, whatever stands before


def test_scores_beyond_64_bits():
    """The integers of the score go beyond 64 bits at corpora of 10^12 words; its decimals hold them."""
    a, n = 10**12, 10**15
    assert 1000 * a * n > 2**64 and 1000 * a < 10**19 and n < 10**18


def test_no_phrases(spark):
    for docs in ([], [(0, None, None), (1, " . ", "en")], [(0, "a b", "en")]):
        assert phrases.collocations(spark.createDataFrame(docs, DOCS)).collect() == []


# 13. Decontamination


def plain_contamination(docs, items, size):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    where = {}
    for item, text in items:
        w = split(text)
        for s in range(max(1, len(w) - size + 1) if w else 0):
            where.setdefault(tuple(w[s : s + size]), set()).add("" if item is None else str(item))
    out = []
    for doc, text, *_ in docs:
        w = split(text)
        hit, held = set(), set()
        for n in {len(k) for k in where}:
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in where:
                    hit.update(range(s, s + n))
                    held |= where[tuple(w[s : s + n])]
        out.append((doc, len(w), len(hit), len(held), sorted(held), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("size", [10, 4])
def test_contamination_against_brute_force(spark, size):
    r = random.Random(size)
    word = lambda: r.choice([f"w{r.randrange(40)}", f"rare{r.randrange(3000)}", "é", "\U0001f600x", "W7"])
    items = [(k, " ".join(word() for _ in range(r.randint(size, 30)))) for k in range(25)]
    items += [(100, "only three words"), (101, "solo"), (102, ""), (103, None), (104, items[0][1]), (None, "nobody owns this " + items[1][1]), (105, "w1 w2 w1 w2 w1 w2 w1 w2 w1 w2 w1 w2 w1 w2"), (106, "Two words")]
    docs = []
    for k in range(200):
        w = [word() for _ in range(r.randint(0, 80))]
        if r.random() < 0.5:
            t = re.split(r"\s+", r.choice(items)[1] or "")
            i = r.randrange(len(t))
            w[len(w) // 2 : len(w) // 2] = t[i : i + r.randint(size - 1, size + 8)]
        docs.append((k, "".join(x + r.choice([" ", ", ", "\n", "--", "\x00"]) for x in w), None))
    docs += [(300, None, None), (301, "", None), (302, "...", None), (303, " SOLO", None), (304, "solos sol", None), (305, "w1 w2 " * 3000, "x"), docs[3], docs[3], (None, items[2][1].upper(), "en"), (307, "TWO  words, only THREE words", None)]
    df = spark.createDataFrame(docs, DOCS).withColumns({c: F.lit("x") for c in ("_id", "_h", "items", "n_words", "gram", "win", "pos", "item")})
    bench = spark.createDataFrame(items, ITEMS).withColumns({c: F.lit(1) for c in ("doc_id", "win", "n")})
    got = sorted((tuple(x) for x in contamination.contamination(df, bench, size).collect()), key=str)
    want = plain_contamination(docs, items, size)
    assert got == want
    clean = contamination.decontaminate(df, bench, size)
    assert clean.columns == df.columns
    bad = {(w[0]) for w in want if w[5]}
    assert sorted(str(x["doc_id"]) for x in clean.collect()) == sorted(str(d[0]) for d in docs if d[0] not in bad)


def test_nothing_to_find(spark):
    none = spark.createDataFrame([], ITEMS)
    docs = spark.createDataFrame([(1, "a b", "en")], DOCS)
    assert [tuple(r) for r in contamination.contamination(docs, none).collect()] == [(1, 2, 0, 0, [], False)]
    assert contamination.contamination(docs.limit(0), spark.createDataFrame([(1, "a b")], ITEMS)).collect() == []


def test_query_of_decontamination(spark):
    import hashlib

    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    got = sorted((tuple(r) for r in queries.op13_benchmark_decontamination(spark, SF).collect()), key=str)
    assert got == sorted(((d, n, h, k, hashlib.sha256(",".join(i).encode()).hexdigest(), c) for d, n, h, k, i, c in plain_contamination(docs, items, 10)), key=str)
