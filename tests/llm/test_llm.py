"""The operators against brute force on small fixtures, and on awkward rows: nulls, blanks, ties, repeats, odd columns."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cyclonet.llm import bpe, common, fingerprints, near_dedup, packing, pii, quality, queries, sharding, substrings, toxicity, wrappers

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"
VOCAB = [f"w{k}" for k in range(400)]


def words(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(VOCAB) for _ in range(n))


def make(spark, texts, start=0):
    rows = [(start + i, t, "en" if i % 2 else None, f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


ODD = [None, "", " \n\t ", "a", "a", "é \U0001f600 ß", "x" * 5000, "one two three four", words(1, 80), words(1, 80), "l1\nl1\nl2 \n l2", words(2, 3000), "+12 345 678 90 a@b.co", "<|endoftext|> it's", "\x00  "]


@pytest.fixture(scope="module")
def odd(spark):
    """Awkward texts, a repeated row, a null id, and columns named like the operators' own."""
    d = make(spark, ODD)
    d = d.unionByName(d.filter("doc_id = 8")).unionByName(d.filter("doc_id = 3").withColumn("doc_id", F.lit(None).cast("long")))
    extra = ("n_words", "kept", "_id", "_node", "node", "key", "spans", "score", "class_id", "_x0", "label", "ids", "shard", "_text")
    return d.withColumns({c: F.lit(c) for c in extra})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, (i // 2) % 2) for i in range(15)] + [(3, None, None)], LABELS)


def runs(docs, labels):
    return {
        "pii": lambda: pii.digest(pii.locate(docs)), "sanitize": lambda: pii.sanitize(docs), "bpe": lambda: bpe.encode_texts(docs, ["doc_id"]), "substrings": lambda: substrings.rewrite_documents(docs),
        "toxicity": lambda: toxicity.score(docs, labels), "packing": lambda: packing.pack(docs), "fingerprints": lambda: fingerprints.compare_documents(docs), "sharding": lambda: sharding.document_shards(docs),
        "quality": lambda: quality.score_documents(docs, labels), "filter": lambda: quality.filter_documents(docs, labels), "classes": lambda: near_dedup.classes(docs), "keep_one": lambda: near_dedup.keep_one(docs),
    }


@pytest.mark.parametrize("name", runs(None, None))
def test_awkward_rows(odd, labels, name):
    out = runs(odd, labels)[name]()
    got = out.collect()
    n = odd.count()
    if name == "keep_one":
        assert len(got) < n
    elif name not in ("filter", "packing"):
        assert len(got) == n
    if name in ("sanitize", "substrings", "filter", "keep_one"):
        assert out.columns == odd.columns
        assert all(r["kept"] == "kept" and r["_x0"] == "_x0" for r in got)


@pytest.mark.parametrize("name", runs(None, None))
def test_empty_table(empty, spark, name):
    assert runs(empty, spark.createDataFrame([], LABELS))[name]().collect() == []


# 1. Personal data

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    good = {
        "email": lambda m: True, "ip": lambda m: all(int(x) <= 255 for x in m.split(".")),
        "card": lambda m: 16 <= len(d := re.sub("[ -]", "", m)) <= 19 and luhn(d), "phone": lambda m: 8 <= len(re.sub("[^0-9]", "", m)) <= 15,
    }
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text) if good[k](m[0])]


def test_base_spans(spark):
    r = random.Random(5)
    texts = ["a@b.c.d@e.f", "a@b.c_d@e.f g", "1.2.3.4.5.6.7.8", "256.1.1.1 01.002.3.4", "é 4381-8935-5774-1609, x@y", "4381 8935 5774 1609", "1" * 20000, "a" * 20000, "a.b@" * 500, "\U0001f600 a@b.co 10.0.0.1 +44 (20) 7946-0958"]
    texts += ["".join(r.choice("a1@. -+().é\U0001f60025_%") for _ in range(r.randint(5, 80))) for _ in range(300)]
    got = make(spark, texts).select("doc_id", pii.base_spans(F.col("text")).alias("s")).collect()
    assert all([(x.kind, x.start, x.end) for x in g.s] == base_spans(texts[g.doc_id]) for g in got)


def test_disclosing_term_and_redaction(spark):
    texts = [f"{words(k, 20)} zorblax wrote to lead@corp.example today {words(k + 500, 20)}" for k in range(6)] + [words(k + 900, 60) + " wrote today" for k in range(60)]
    docs = make(spark, texts)
    got = {r.doc_id: r for r in pii.digest(pii.locate(docs)).collect()}
    for k in range(6):
        terms = [texts[k][int(a) : int(b)] for kind, a, b in (s.split(":") for s in got[k].spans.split(",")) if kind == "term"]
        assert "zorblax" in terms and "wrote" not in terms
    assert all(got[k].spans == "" for k in range(6, 66))
    clean = {r.doc_id: r.text for r in pii.sanitize(docs).collect()}
    assert all("zorblax" not in clean[k] and "[EMAIL]" in clean[k] for k in range(6))
    assert all(clean[k] == texts[k] for k in range(6, 66))


def test_terms_against_brute_force(spark):
    """Distinct texts of random words, some values with words that stand by them always, mostly or now and then."""
    r = random.Random(11)
    texts = []
    for k in range(160):
        t = words(k, 30).split()
        v = k % 8
        if v < 4:
            t.insert(5, f"lead{v}@corp.example")
            t.insert(r.randrange(len(t)), f"sure{v}")
            if r.random() < 0.9:
                t.insert(r.randrange(len(t)), f"mostly{v}")
        if r.random() < 0.05:
            t.insert(3, f"mostly{r.randrange(4)}")
        if r.random() < 0.3:
            t.insert(7, f"often{r.randrange(4)}")
        if k == 100:
            t.insert(1, "rare@corp.example oncebesides")
        texts.append(" ".join(t))
    held = [set(re.findall(PATTERNS["email"].replace("(", "(?:"), t)) for t in texts]
    bags = [{w.lower() for w in re.findall(r"[^\W\d_][^\W_]+", re.sub(PATTERNS["email"], " ", t))} for t in texts]
    n = len(texts)
    alone = {v: c for v, c in Counter(v for h in held for v in h).items() if c > 1}
    need, want = np.log2(len(alone) * n / 0.01), {}
    df = Counter(w for b in bags for w in b)
    for v, c in alone.items():
        for w, both in Counter(w for h, b in zip(held, bags, strict=True) if v in h for w in b).items():
            bits = np.log2(both / df[w] / (c / n))
            if bits >= 0.9 * -np.log2(c / n) and bits * both >= need:
                want[w] = max(want.get(w, 0), bits / -np.log2(c / n))
    docs = make(spark, texts)
    got = {r.term: r.share for r in pii.disclosing(docs, pii.profile(docs)).collect()}
    assert got.keys() == want.keys() and {f"sure{v}" for v in range(4)} <= got.keys() and "oncebesides" not in got
    assert all(np.isclose(got[w], want[w]) for w in got)
    for r in pii.locate(docs).collect():
        places = [(m.start(), m.end()) for m in re.finditer(r"[^\W\d_][^\W_]+", texts[r.doc_id]) if m[0].lower() in want]
        assert [(s.start, s.end) for s in r.added or []] == places


def test_copies_are_no_evidence_and_long_texts_are_whole(spark):
    one = f"{words(1, 40)} write to solo@corp.example zorblax {words(2, 40)}"
    long = " ".join(f"x{i}@b.co é" for i in range(20_000))
    docs = make(spark, [one] * 30 + [words(k, 50) for k in range(60)] + [long])
    got = {r.doc_id: r for r in pii.digest(pii.locate(docs)).collect()}
    assert all(got[k].spans.startswith("email") and "term" not in got[k].spans for k in range(30)) and got[90].n_email == 20_000
    assert {r.doc_id: r.text for r in pii.sanitize(docs).collect()}[90] == " ".join(["[EMAIL] é"] * 20_000)


# 2. Encoding


def test_encoding_equals_the_library():
    from tokenizers import Tokenizer

    t, c = Tokenizer.from_file(bpe.default_path()), bpe.Codec(bpe.default_path())
    fast = bpe.Codec(bpe.default_path(), library=True)
    r = random.Random(3)
    bits = ["a", "b", "the", "ing", " ", "  ", "\n", "\t", "é", "ü", "1", "23", "!", "...", "'s", "'", "'ll", "<|endoftext|>", "中文", "\U0001f600", "­", "٣", "_", "-", "%%%", "A", "\r\n", "　", "́", "\x00"]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 40))) for _ in range(3000)] + ["".join(r.choice("abcdeiounrst") for _ in range(r.randint(1, 30))) for _ in range(3000)]
    texts += ["a" * k for k in range(1, 150)] + [" " * k + "x" for k in range(30)] + ["\n" * k for k in range(30)]
    want = [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    for codec in (c, fast):
        got = bpe.encode_batch(texts, codec)
        assert [np.frombuffer(x, "<u4").tolist() for x in got] == want
    assert [c.decode(x) for x in got] == [t.decode(w, skip_special_tokens=False) for w in want]


def test_the_query_equals_the_library(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_path())
    texts = {r.doc_id: r.text or "" for r in common.table(spark, "/root/testdata/sf0.001", "documents").collect()}
    for r in queries.op2_bpe(spark, "/root/testdata/sf0.001").collect():
        ids = t.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


# 3. Repeated windows


def brute_removal(texts: list[str | None], size: int) -> list[str]:
    cut = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = Counter(tuple(w[i : i + size]) for w in cut for i in range(len(w) - size + 1))
    out = []
    for w in cut:
        gone = {j for i in range(len(w) - size + 1) if seen[tuple(w[i : i + size])] > 1 for j in range(i, i + size)}
        out.append(" ".join(x for j, x in enumerate(w) if j not in gone))
    return out


@pytest.mark.parametrize("size", [35, 5, 1])
def test_removal_equals_brute_force(spark, size):
    passage = words(77, 60)
    texts = [*ODD, f"{words(20, 50)} {passage} {words(21, 30)}", f"{words(22, 10)}\n{passage}", f"{passage} {passage}", "again " * 90, words(23, 34), words(23, 34), words(24, 35), words(24, 35), "a b " * 40 + "\U0001f600"]
    got = {r.doc_id: r for r in substrings.remove_repeats(make(spark, texts).select("doc_id", "text"), size, 16).collect()}
    want = brute_removal(texts, size)
    assert [got[i].kept for i in range(len(texts))] == want
    assert all(got[i].n_words - got[i].n_removed == len(want[i].split()) for i in range(len(texts)))


# 4. Toxicity


def test_toxicity_separates_held_out(spark):
    r = random.Random(9)
    bad = ["vilegrub", "snotwick", "drabbulk"]
    texts, marks = [], []
    for i in range(600):
        t = words(i, r.randint(30, 120)).split()
        if i % 5 == 0:
            t[3], t[17] = r.choice(bad), r.choice(bad)
        texts.append(" ".join(t))
        marks.append((i, 1, int(i % 5 == 0)))
    got = toxicity.score(make(spark, texts), spark.createDataFrame(marks, LABELS)).collect()
    assert all(g.held_out == (zlib.crc32(str(g.doc_id).encode()) % 4 == 2) for g in got)
    held = [g for g in got if g.held_out]
    assert all(0 <= g.score <= 1 for g in got)
    right = np.mean([g.predicted == int(g.doc_id % 5 == 0) for g in held])
    assert right > 0.97


def kneser_ney(train, order, d):
    """ln P1 / P0 of a letter after order - 1 letters, by plain dictionaries."""
    pad = lambda w: " " * (order - 1) + w + " "
    grams = [Counter(), Counter()]
    for text, y in train:
        for w in set(re.findall(r"[^\W\d_]+", text.lower())):
            grams[y].update(pad(w)[k : k + order] for k in range(len(w) + 1))
    types = grams[0].keys() | grams[1].keys()
    below = {order - 1: Counter(g[1:] for g in types)}
    for n in range(order - 2, 0, -1):
        below[n] = Counter(g[1:] for g in below[n + 1])

    def shared(g):
        own = below[len(g)]
        total = sum(c for k, c in own.items() if k[:-1] == g[:-1])
        kinds = sum(1 for k in own if k[:-1] == g[:-1])
        rest = 1 / (kinds + 1) if len(g) == 1 else shared(g[1:])
        return (own[g] - d) / total + d * kinds / total * rest

    def ratio(g):
        out = []
        for own in grams:
            n = sum(c for k, c in own.items() if k[:-1] == g[:-1])
            kinds = sum(1 for k in own if k[:-1] == g[:-1])
            if g in types:
                q = shared(g[1:])
                out.append(q if not n else max(own[g] - d, 0) / n + d * kinds / n * q)
            else:
                out.append(d * kinds / n if n else 1.0)
        return np.log(out[1] / out[0])

    kept = {}
    return lambda w: sum(kept[g] if g in kept else kept.setdefault(g, ratio(g)) for g in (pad(w)[k : k + order] for k in range(len(w) + 1)))


@pytest.mark.parametrize("broadcast", [True, False])
def test_ratios_against_brute_force(spark, monkeypatch, broadcast):
    """Where the model is broadcast and where words are joined to it."""
    r = random.Random(2)
    syllables = ["ba", "do", "ki", "lu", "mé", "no"]
    texts = [" ".join("".join(r.choice(syllables) for _ in range(r.randint(1, 3))) + (" grub" if i % 3 == 0 and r.random() < 0.3 else "") for _ in range(r.randint(1, 12))) for i in range(60)]
    texts += ["", "12 34", "Ba_ba GRUB!"]
    docs = make(spark, texts)
    marks = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(60)], LABELS)
    seen = {}
    fit = toxicity.fit_curve
    monkeypatch.setattr(toxicity, "fit_curve", lambda x, y: seen.setdefault("curve", fit(x, y)))
    monkeypatch.setattr(toxicity, "MODEL_ROWS", 6_000_000 if broadcast else 0)
    got = {g.doc_id: g.score for g in toxicity.score(docs, marks).collect()}
    ratio = kneser_ney([(texts[i], int(i % 3 == 0)) for i in range(60) if zlib.crc32(str(i).encode()) % 4 != 2], toxicity.ORDER, toxicity.DISCOUNT)
    mean, spread, w = seen["curve"]
    for i, t in enumerate(texts):
        own = [(ratio(x), len(x) + 1) for x in re.findall(r"[^\W\d_]+", t.lower())]
        x = np.zeros(2)
        if own:
            runs = [own[k : k + 2] for k in range(max(1, len(own) - 1))]
            x = np.array([sum(a for a, _ in own) / sum(b for _, b in own), max(sum(a for a, _ in run) / sum(b for _, b in run) for run in runs)])
        assert np.isclose(got[i], 1 / (1 + np.exp(-((x - mean) / spread @ w[:-1] + w[-1]))), atol=1e-5)


# 5. Packing


def test_packing_is_whole_and_tight(spark):
    texts = [*ODD, *(words(k, 20 + 37 * k % 900) for k in range(120))]
    codec = bpe.Codec(bpe.default_path())
    got = packing.pack(make(spark, texts).repartition(6), 512).collect()
    sequences, docs = defaultdict(list), defaultdict(list)
    for g in got:
        sequences[g.sequence_id].append((g.offset, g.length))
        docs[g.doc_id].append(g)
    total = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 512
        total += at
    for i, t in enumerate(texts):
        ids = codec.encode(t or "") + bytes(4)
        own = sorted(docs[i], key=lambda g: g.piece)
        assert [g.piece for g in own] == list(range(len(own)))
        assert all(g.ids_crc32 == zlib.crc32(ids[4 * g.start : 4 * (g.start + g.length)]) for g in own)
        assert sum(g.length for g in own) * 4 == len(ids) and (len(own) == 1 or all(g.length == 512 for g in own[1:]))
    assert len(sequences) <= 1.05 * total / 512 + 1


# 6. Fingerprints


def test_edits_and_likeness(spark):
    texts = [words(k, 150) for k in range(40)] + [*ODD]
    docs = make(spark, texts)
    got = {r.doc_id: r for r in fingerprints.compare_documents(docs).collect()}
    n = len(texts)
    for i in range(n):
        t, following = texts[i] or "", texts[i - 1 if i else n - 1] or ""
        third = len(t) // 3
        edited = t[: len(t) - third] + following[:third]
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert got[i].n_chars == len(t)
    assert all(got[i].near_edited > 0.3 and got[i].near_next < 0.1 for i in range(1, 40))
    assert got[48].fingerprint == got[49].fingerprint and got[49].near_next == 1.0


def test_fingerprints_and_likeness_against_brute_force(spark):
    texts = [words(1, 60), f"{words(2, 30)} {words(1, 60)}", " ".join(words(1, 60).split()[:25] + ["new"] + words(1, 60).split()[25:]), "a b a b a b a b a b", "a b c", "a", None, "z" * 400, f"{words(3, 20)} {words(4, 20)}", f"{words(4, 20)} {words(3, 20)}"]
    docs = make(spark, texts)
    got = {r.doc_id: r for r in fingerprints.compare_documents(docs).collect()}
    full = [t or "" for t in texts]
    edited = [t[: len(t) - len(t) // 3] + full[i - 1][: len(t) // 3] for i, t in enumerate(full)]
    rows = make(spark, full + edited)
    anchors = {r.doc_id: [(a.at, a.hash) for a in r.a] for r in fingerprints.with_anchors(rows, "text", "a").collect()}

    def likeness(x, y):
        first = [{h: at for at, h in sorted(v, reverse=True)} for v in (x, y)]
        if first[0] == first[1]:
            return 1.0
        if not x or not y:
            return 0.0
        met = sorted((at, first[1][h] - at) for h, at in first[0].items() if h in first[1])
        near = [m for k, m in enumerate(met) if min(map(len, first)) == 1 or any(0 <= j < len(met) and met[j][1] == m[1] for j in (k - 1, k + 1))]
        return len(near) / (len(first[0]) + len(first[1]) - len(near))

    def text(x):
        gaps = np.diff([1 - fingerprints.K, *(at for at, _ in x)])
        return "".join(f"{h:08X}{g:02X}" if g < 255 else f"{h:08X}FF{g:08X}" for (_, h), g in zip(x, gaps, strict=True))

    n = len(texts)
    for i in range(n):
        following = (i - 1) % n
        assert (got[i].fingerprint, got[i].edited_fingerprint) == (text(anchors[i]), text(anchors[n + i]))
        assert np.isclose(got[i].near_edited, likeness(anchors[i], anchors[n + i])) and np.isclose(got[i].near_next, likeness(anchors[i], anchors[following]))
    assert got[1].near_next > 0.4 and got[2].near_next > 0.1


def test_ids_that_many_rows_share_are_dealt_by_text(spark):
    rows = [(None if i % 3 else i, words(i, 6)) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    dealt = fingerprints.dealt_by_range(docs.withColumn("_tie", F.xxhash64("text")), "doc_id", "_tie")
    assert dealt.filter("doc_id IS NULL").select("_b").distinct().count() > 1
    got = fingerprints.compare_documents(docs).collect()
    order = [r.text for r in docs.withColumns({"o": F.coalesce("doc_id", F.lit(common.LOWEST)), "u": F.shiftrightunsigned(F.xxhash64("text"), 11)}).orderBy(F.col("o").desc(), F.col("u").desc()).collect()]
    want = Counter()
    for i, t in enumerate(order):
        following = order[(i + 1) % len(order)]
        want[hashlib.sha256((t[: len(t) - len(t) // 3] + following[: len(t) // 3]).encode()).hexdigest()] += 1
    assert Counter(r.edited_sha256 for r in got) == want


def test_anchors_do_not_depend_on_context(spark):
    passage = words(5, 60)
    rows = make(spark, [passage, f"{words(6, 40)} {passage} {words(7, 40)}"])
    a, b = (set(x.hash for x in r.a) for r in fingerprints.with_anchors(rows, "text", "a").orderBy("doc_id").collect())
    assert len(a & b) >= len(a) - fingerprints.K


# 7. HTML

PAGE = '<html><head><title>t</title><script>var a="</p>";</script></head><body><nav><ul><li><a>{0} menu</a><li><a>more</a></ul></nav><div class="ad">buy {0}</div><article><h1>Title {0}</h1><p>First &amp;\n  {0}<br>line<p><b>Second {0}</article><section class="comments"><p>Nice {0}!</section><footer>(c) {0}</footer></body></html>'


def test_main_text(spark):
    rows = [(i, f"http://h{i % 2}.example/{i}", PAGE.format(f"n{i}")) for i in range(12)] + [(90, None, None), (91, "x", ""), (92, "http://h0.example/z", "plain <b>text"), (93, "http://h0.example/y", "<p>unclosed 'quote <a href='x>y</p>")]
    got = {r.page_id: r.text for r in wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"Title n{i}\nFirst & n{i} line\nSecond n{i}" for i in range(12))
    assert (got[90], got[91], got[92]) == ("", "", "plain text")


def test_fixed_text_and_main_element_without_article(spark):
    page = "<body><div id=top><p>Welcome to the site</p></div><div id=content><p>{0} is a long open text about {0}</p><p>{0} again, and more of it</p></div></body>"
    rows = [(i, f"http://a.example/{i}", page.format(words(i, 12))) for i in range(8)]
    got = wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert all("Welcome" not in r.text and r.text.count("\n") == 1 for r in got)


def extracted(spark, rows):
    return {r.page_id: r.text for r in wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_pages_equal_what_their_articles_were_made_from(spark):
    r = random.Random(8)
    rows, want = [], {}
    for i in range(60):
        blocks = [words(i * 20 + k, r.randint(1, 60)) for k in range(r.randint(1, 9))]
        inner = "".join(r.choice(["<p>{}</p>", "<p><b>{}</b>", "<ul><li>{}</ul>", "<blockquote>{}</blockquote>", "<div>{}</div>"]).format(x.replace(" ", " &#32;\n")) for x in blocks[1:])
        menu = "".join(f"<li><a href=/{k}>{words(i + k, 2)}</a>" for k in range(r.randint(1, 6)))
        rows.append((i, f"http://h{i % 3}.example/{i}", f"<html><body class='{r.choice(['has-sidebar', 'home'])}'><ul>{menu}</ul><article class='post comments-open'><h1>{blocks[0]}</h1>{inner}</article><aside>{words(i, 40)}</aside><div class='site-footer'>{words(i, 30)}</div></body></html>"))
        want[i] = "\n".join(blocks)
    assert extracted(spark, rows) == want


def test_the_wrapper_decides_and_not_the_page(spark):
    """A short text beside a long one of the page's own: its host's other pages tell which is the article."""
    page = "<body><div id=top><p>{}</p></div><div id=content><p>{}</p><p>end of it</p></div></body>"
    pages = [page.format(words(i, 8), words(100 + i, 80)) for i in range(9)] + [page.format(words(10, 60), "short")]
    got = extracted(spark, [(i, "http://a.example/", p) for i, p in enumerate(pages)])
    assert got[9] == "short\nend of it"
    assert wrappers.main_text(pages[9], None) == words(10, 60)


def test_nothing_else_is_dropped(spark):
    rows = [(i, "http://a.example/", f"<body><article><h2>News</h2><p>{words(i, 30)}</p><div class=comments-open>still {i}</div></article></body>") for i in range(8)]
    rows += [(20, "http://b.example/", "<body class='has-sidebar'><article><p>Hello")]
    rows += [(30 + i, "http://c.example/", f"<body><p>{'this stands on every page and is long ' * 9}</p><div><p>{words(i, 90)}</p></div></body>") for i in range(8)]
    got = extracted(spark, rows)
    assert all(got[i] == f"News\n{words(i, 30)}\nstill {i}" for i in range(8)) and got[20] == "Hello"
    assert all(got[30 + i] == words(i, 90) for i in range(8))


def test_long_deep_and_awkward_pages(spark):
    deep = "<div>" * 20_000 + "deep" + "</div>" * 20_000
    long = "<body><article>" + "".join(f"<h2>s{i}</h2><p>{words(i, 10)}</p>{'<ul><li>x</ul>' if i % 3 else ''}" for i in range(4000)) + "</article></body>"
    rows = [(1, "http://a.example/", deep), (2, "http://a.example/", long), (2, "http://a.example/", long), (3, None, None), (4, None, "</p></div><b>x y")]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(c) for c in ("host", "told", "text", "wrapper", "_g")})
    out = wrappers.extract(d)
    got = out.collect()
    assert out.columns == ["page_id", "url", "text"] and len(got) == 5
    by = {g.page_id: g.text for g in got}
    assert by[1] == "deep" and by[3] == "" and by[4] == "x y"
    assert by[2].count("\n") == 4000 * 2 + sum(1 for i in range(4000) if i % 3) - 1
    assert wrappers.extract(d.limit(0)).collect() == []


def test_wrapper_alignment():
    one, two = (wrappers.parse(f"<ul>{'<li>a' * n}</ul><p>x</p>{more}<dl>{'<dt>k<dd>v' * n}</dl>")[0] for n, more in ((2, ""), (4, "<h2>y</h2>")))
    w = wrappers.both(one, two)
    by = {k.key: k for k in w.kids}
    assert [k.key for k in w.kids] == ["ul", "p", "h2", "dl"] and (w.pages, by["h2"].pages) == (2, 1)
    assert [(k.key, k.repeated) for k in by["ul"].kids] == [("li", True)] and [(k.key, k.repeated) for k in by["dl"].kids] == [("dt", True), ("dd", True)]
    assert by["p"].kids[0].fixed and not wrappers.both(w, wrappers.parse("<p>z</p>")[0]).kids[1].kids[0].fixed


# 8. Sharding


@pytest.mark.parametrize(("n", "bits"), [(2, 3), (3, 2)])
def test_hilbert_neighbours(spark, n, bits):
    grid = spark.range(2 ** (n * bits)).select(*(F.pmod(F.shiftright("id", bits * i), F.lit(2**bits)).alias(f"x{i}") for i in range(n)))
    rows = sharding.with_hilbert_index(grid, "h", [F.col(f"x{i}") for i in range(n)], bits).orderBy("h").collect()
    assert [r.h for r in rows] == list(range(2 ** (n * bits)))
    assert all(sum(abs(a[f"x{i}"] - b[f"x{i}"]) for i in range(n)) == 1 for a, b in zip(rows, rows[1:], strict=False))


def test_shards_are_near_equal_and_gapless(spark):
    texts = [words(k, 5 + 13 * k % 90) for k in range(300)] + ["copy of one text"] * 150
    got = sharding.document_shards(make(spark, texts), 8).collect()
    by = defaultdict(list)
    for g in got:
        by[g.shard].append(g)
        t = texts[g.doc_id].encode()
        assert (g.size, g.text_crc32) == (len(t) + 1, zlib.crc32(t))
    sizes = [sum(g["size"] for g in by[s]) for s in range(8)]
    assert max(sizes) - min(sizes) <= 2 * max(g["size"] for g in got)
    assert all(sorted(g.slot for g in by[s]) == list(range(len(by[s]))) for s in by)


def test_groups_up_to_the_largest_row_stay_whole(spark):
    texts = [words(k, 300) for k in range(4)] + [words(100 + k // 7, 12) for k in range(700)]
    got = sharding.document_shards(make(spark, texts), 8).collect()
    shards = defaultdict(set)
    for g in got:
        shards[texts[g.doc_id]].add(g.shard)
    assert all(len(s) == 1 for s in shards.values())
    sizes = Counter()
    for g in got:
        sizes[g.shard] += g["size"]
    assert max(sizes.values()) - min(sizes.values()) <= 2 * max(g["size"] for g in got)


# 9. Quality


def brute_counts(text: str | None) -> tuple:
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_counts_equal_brute_force(spark):
    texts = [*ODD, "a b c a b c a b", "x\n x\nx\n\n \nx", "### a|b <c>   d", "a b c " * 40, "one two three one two three"]
    got = {r.doc_id: r for r in quality.measure(make(spark, texts), ["doc_id"]).collect()}
    for i, t in enumerate(texts):
        r, want = got[i], brute_counts(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])


def test_binomial_bound():
    from math import comb

    for n, k, p in ((20, 3, 0.3), (50, 0, 0.02), (200, 9, 0.1)):
        assert np.isclose(quality.binomial_tail(k, n, p), sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)))
    assert quality.pick_cutoff(1000, [0, 0, 1, 500], 0.01, 0.01) == 2
    assert quality.pick_cutoff(10, [0, 0], 0.01, 0.01) == -1


def test_rules_reject_junk_only(spark):
    texts = [words(k, 60) + "\nplain line" for k in range(900)] + [" ".join(w + "###" for w in words(k, 60).split()) for k in range(900, 1000)]
    docs = make(spark, texts).withColumn("lang", F.lit("en"))
    marks = spark.createDataFrame([(i, int(i < 900), 0) for i in range(1000)], LABELS)
    got = {r.doc_id: r.kept for r in quality.score_documents(docs, marks).collect()}
    assert all(got[i] for i in range(900)) and not any(got[i] for i in range(900, 1000))


def test_cutoffs_against_brute_force(spark):
    r = np.random.default_rng(4)
    rows, marks = [], []
    for i in range(1500):
        good = int(r.random() < 0.8)
        x = np.where(r.random(4) < (0.004 if good else 0.3), r.random(4), 0.0)
        rows.append((i, "en" if i < 900 else "de" if i < 1400 else ["fr", "es", None][i % 3], False, *map(float, x)))
        marks.append((i, good, 0))
    d = spark.createDataFrame(rows, "doc_id long, lang string, base_failed boolean, " + ", ".join(f"{k} double" for k in quality.RULES))
    got = {g.stratum: g for g in quality.cutoffs(d, spark.createDataFrame(marks, LABELS), "lang").collect()}
    level = 0.05 / len(got)
    path = [(j, c) for j in range(4) for c in quality.GRID]
    for name, group in (("en", ["en"]), ("de", ["de"]), ("fr", ["fr", "es", None])):
        own = [(x, marks[x[0]][1]) for x in rows if x[1] in group]
        n = [sum(1 for _, g in own if g == k) for k in (0, 1)]
        best, gain = None, 0.0
        for step, (rule, cut) in enumerate(path):
            over = lambda x: any(x[3 + j] > (quality.GRID[-1] if j < rule else cut) for j in range(rule + 1))  # noqa: E731, B023
            bad, good = (sum(1 for x, g in own if g == k and over(x)) for k in (0, 1))
            if quality.binomial_tail(good, n[1], 0.02) > level:
                break
            if bad / n[0] - good / n[1] > gain + 1e-12:
                best, gain = step, bad / n[0] - good / n[1]
        limits = [None] * 4 if best is None else [quality.GRID[-1]] * path[best][0] + [path[best][1]] + [None] * (3 - path[best][0])
        assert [got[name][f"max_{k}"] for k in quality.RULES] == limits
    assert [got[k].pooled for k in ("en", "de", "fr", "es", "")] == [False, False, True, True, True]


def test_copies_are_one_draw(spark):
    """A text that stands 500 times in the holdout is one draw: it neither makes a bound nor breaks one."""
    few = [words(k, 60) for k in range(100)]
    docs = make(spark, few + [few[0]] * 500 + [" ".join(w + "###" for w in words(9000, 60).split())] * 50).withColumn("lang", F.lit("en"))
    marks = spark.createDataFrame([(i, int(i < 600), 0) for i in range(650)], LABELS)
    got = quality.cutoffs(quality._keyed(docs), marks, "lang", identity="text_key").first()
    assert (got.n_good, got.pooled) == (100, True)
    assert all(r.kept for r in quality.score_documents(docs, marks).collect())
    many = [words(k, 60) for k in range(400)]
    odd = " ".join(w + "###" for w in words(9001, 60).split())
    docs = make(spark, many + [odd] * 200 + [" ".join(w + "###" for w in words(k, 60).split()) for k in range(9100, 9120)]).withColumn("lang", F.lit("en"))
    marks = spark.createDataFrame([(i, int(i < 600), 0) for i in range(620)], LABELS)
    got = {r.doc_id: r.kept for r in quality.score_documents(docs, marks).collect()}
    assert all(got[i] for i in range(400)) and not any(got[i] for i in range(600, 620))


# 10. Near duplicates


def test_classes_against_brute_force(spark):
    r = random.Random(4)
    texts = []
    for k in range(25):
        base = words(k, 200).split()
        texts.append(" ".join(base))
        for _ in range(k % 4):
            t = list(base)
            t[r.randrange(200)] = "changed"
            texts.append(" ".join(t))
    texts += [texts[0]] * 3 + ["", "", None, "a b", "a b", "b a"]
    got = {g.doc_id: g.class_id for g in near_dedup.classes(make(spark, texts), 0.8).collect()}
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if (w := (t or "").split()) else None for t in texts]
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            same = (texts[i] or "") == (texts[j] or "") or (sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.85)
            if same and root(i) != root(j):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    assert [got[i] for i in range(len(texts))] == [root(i) for i in range(len(texts))]


def test_pairs_in_buckets_of_unlike_texts_are_linked(spark):
    """Texts of one template at 0.75, in pairs a little over 0.8: nearly all that meet in a bucket are unlike."""
    base = words(1, 150)
    texts = [f"{base} " + " ".join([*(f"s{k}x{i}" for i in range(5)), *(f"t{k}x{j}x{i}" for i in range(11))]) for k in range(250) for j in range(2)]
    docs = make(spark, texts)
    counts, n = near_dedup.frequency_sketch(docs)
    tables = near_dedup.weight_tables(counts, n)
    vectors = near_dedup.vectors(pa.array(texts), tables)
    rows = near_dedup.sign(docs, spark.sparkContext.broadcast(tables)).collect()
    bands = {r.doc_id: np.frombuffer(r.bands, np.uint64) for r in rows}
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if (bands[i] == bands[j]).any() and near_dedup.similarity(vectors[i], vectors[j]) >= 0.8 and root(i) != root(j):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    want = [root(i) for i in range(len(texts))]
    assert 250 <= len(set(want)) <= 300
    got = {r.doc_id: r.class_id for r in near_dedup.classes(docs, 0.8).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_links_near_the_least_similarity(spark):
    """Pairs between 0.7 and 0.95 by weights; of those of 0.8 or more, nearly all are found, and no class joins others."""
    r = random.Random(6)
    texts = []
    for k in range(220):
        base = [f"a{k}x{i}" for i in range(120)]
        other = list(base)
        for _ in range(1 + k % 5):
            other[r.randrange(120)] = f"n{r.random()}"
        texts += [" ".join(base), " ".join(other)]
    docs = make(spark, texts)
    counts, n = near_dedup.frequency_sketch(docs)
    vectors = near_dedup.vectors(pa.array(texts), near_dedup.weight_tables(counts, n))
    like = [near_dedup.similarity(vectors[2 * k], vectors[2 * k + 1]) for k in range(220)]
    got = {g.doc_id: g.class_id for g in near_dedup.classes(docs, 0.8).collect()}
    found = [got[2 * k] == got[2 * k + 1] for k in range(220)]
    near = [f for f, s in zip(found, like, strict=True) if s >= 0.8]
    assert len(near) > 60 and min(like) < 0.75 and sum(near) >= 0.97 * len(near)
    assert not any(f for f, s in zip(found, like, strict=True) if s < 0.8) and len(set(got.values())) == 440 - sum(found)


def test_common_weights(monkeypatch):
    r = random.Random(1)
    texts = [" ".join(r.choice("abc") for _ in range(r.randint(0, 60))) for _ in range(40)] + ["x y z w v " * 9]
    tables = np.ones((near_dedup.DF_ROWS, 1 << near_dedup.DF_BITS), np.float32) * 1.5
    vectors = near_dedup.vectors(pa.array(texts), tables)
    a, b = near_dedup.leveled(pa.array(texts), tables), near_dedup.leveled(pa.array(texts[:7]), tables)
    want = [[sum(min(w, dict(zip(*q, strict=True)).get(v, 0)) for v, w in zip(*p, strict=True)) for q in vectors[:7]] for p in vectors]
    for few in (0, 256):
        monkeypatch.setattr(near_dedup, "FEW", few)
        assert np.allclose(near_dedup.common_weights(a, b, len(texts), 7), want)


def test_one_of_each_class_stays(spark):
    docs = make(spark, [words(1, 100), words(1, 100), words(2, 100), None])
    assert sorted(r.doc_id for r in near_dedup.keep_one(docs).collect()) == [0, 2, 3]


# Pipeline


def test_pipeline_over_the_smallest_tables(spark):
    sf = "/root/testdata/sf0.001"
    docs = common.table(spark, sf, "documents")
    before = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf))
        assert docs.columns == before
    kept = {r.doc_id: r.text for r in docs.collect()}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    codec = bpe.Codec(bpe.default_path())
    length = Counter()
    for g in packed:
        length[g.doc_id] += g.length
    assert length == {i: len(codec.encode(t)) // 4 + 1 for i, t in kept.items()}
    assert not any(base_spans(t) for t in kept.values())
    assert all(n == 1 for n in Counter(t for t in kept.values() if len(t.split()) >= 5).values())
