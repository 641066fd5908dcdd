"""Toxicity by two class-conditional Kneser-Ney models over the letters of words.

Each class has a model of a letter after the ORDER - 1 letters before it within its word; where a class lacks an
expression, it backs off to continuation counts that both classes share, so rare expressions weigh by their context
alone. A word counts once a text, so that a text repeating a word is no more evidence than one that has it.
Texts are judged by log-likelihood ratios of the classes, normalised by length in letters: that of the whole text and
that of its most toxic run of RUN words, which a long text does not dilute. A logistic curve turns the two into a
score. It is fitted on labelled rows that the models did not see; the models that score are then counted anew with
those rows too.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .words import mix

ORDER = 5
DISCOUNT = 0.75
FLUSH_WORDS = 100_000
KEPT_WORDS = 500_000  # word ratios that a worker keeps
RUN = 2
MODEL_ROWS = 6_000_000  # expressions and contexts that may be broadcast; beyond, words are joined to them
LABEL_ROWS = 1_000_000  # labels that may be broadcast; beyond, they are joined by a shuffle
FIT_ROWS = 100_000  # labelled rows for the logistic curve: those of least id hash

_words = re.compile(r"[^\W\d_]+")


def remainder(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 4."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4


def grams_of(word: str) -> list[str]:
    s = " " * (ORDER - 1) + word + " "
    return [s[k : k + ORDER] for k in range(len(s) - ORDER + 1)]


def gram_counts(labelled: DataFrame) -> DataFrame:
    """part, gram, c0, c1: how often each run of ORDER letters occurs in ordinary and toxic texts' words, over all rows
    of each part (0 or 1).

    Words count once a text and stand between ORDER - 1 blanks and one. A task counts words first and their letters
    once for each word.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(Counter(), Counter()) for _ in range(2)]

        def out() -> Iterator[pa.RecordBatch]:
            for part, classes in enumerate(held):
                grams = (Counter(), Counter())
                for words, to in zip(classes, grams, strict=True):
                    for w, n in words.items():
                        for g in grams_of(w):
                            to[g] += n
                    words.clear()
                if keys := list(grams[0].keys() | grams[1].keys()):
                    counts = (pa.array([g[k] for k in keys], pa.int64()) for g in grams)
                    yield pa.RecordBatch.from_arrays([pa.array([part] * len(keys), pa.int32()), pa.array(keys, pa.string()), *counts], names=["part", "gram", "c0", "c1"])

        for b in batches:
            for text, toxic, part in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                held[part][toxic].update(set(_words.findall((text or "").lower())))
                if sum(len(c) for classes in held for c in classes) > FLUSH_WORDS:
                    yield from out()
        yield from out()

    parts = labelled.select("text", "toxic", "part").mapInArrow(run, "part int, gram string, c0 long, c1 long")
    return parts.groupBy("part", "gram").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))


def ratios(grams: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(gram, ratio) of seen expressions and (context, ratio) for others after a seen context: ln P1 / P0.

    P_k = max(c_k - D, 0) / n_k + D t_k / n_k Q, where n_k and t_k are the context's occurrences and types in class k and
    Q is the Kneser-Ney probability of the shorter expression, from the continuation counts of both classes together.
    """
    d = F.lit(DISCOUNT)
    counts = {ORDER - 1: grams.groupBy(F.substring("gram", 2, ORDER - 1).alias("g")).agg(F.count("*").alias("c"))}
    for n in range(ORDER - 2, 0, -1):
        counts[n] = counts[n + 1].groupBy(F.substring("g", 2, n).alias("g")).agg(F.count("*").alias("c"))
    ends = counts[1].agg(F.sum("c").alias("s"), F.count("*").alias("t"))
    p = counts[1].crossJoin(F.broadcast(ends)).select("g", ((F.col("c") - d) / F.col("s") + d * F.col("t") / F.col("s") / (F.col("t") + 1)).alias("p"))
    for n in range(2, ORDER):
        own = counts[n].withColumns({"h": F.substring("g", 1, n - 1), "l": F.substring("g", 2, n - 1)})
        context = own.groupBy("h").agg(F.sum("c").alias("s"), F.count("*").alias("t"))
        lower = p.select(F.col("g").alias("l"), F.col("p").alias("q"))
        p = own.join(context, "h").join(lower, "l").select("g", ((F.col("c") - d) / F.col("s") + d * F.col("t") / F.col("s") * F.col("q")).alias("p"))
    own = grams.withColumns({"h": F.substring("gram", 1, ORDER - 1), "l": F.substring("gram", 2, ORDER - 1)})
    context = own.groupBy("h").agg(*(F.sum(f"c{k}").alias(f"n{k}") for k in (0, 1)), *(F.sum((F.col(f"c{k}") > 0).cast("long")).alias(f"t{k}") for k in (0, 1)))
    weight = lambda k: F.when(F.col(f"n{k}") > 0, d * F.col(f"t{k}") / F.col(f"n{k}")).otherwise(1.0)
    given = lambda k: F.when(F.col(f"n{k}") > 0, F.greatest(F.col(f"c{k}") - d, F.lit(0.0)) / F.col(f"n{k}")).otherwise(0.0) + weight(k) * F.col("q")
    full = own.join(context, "h").join(p.select(F.col("g").alias("l"), F.col("p").alias("q")), "l")
    return full.select("gram", F.ln(given(1) / given(0)).alias("ratio")), context.select("h", F.ln(weight(1) / weight(0)).alias("ratio"))


def window_hashes(points: np.ndarray, size: int) -> np.ndarray:
    """A hash of each `size` neighbouring code points."""
    n = len(points) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(size):
        out = mix(out + points[j : j + n], 300 + j)
    return out


def hashed(table: DataFrame, size: int) -> DataFrame:
    """key, ratio of a table of expressions of `size` letters and ratios, so that the driver gets numbers only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            points = np.frombuffer("".join(b.column(0).to_pylist()).encode("utf-32-le"), np.uint32).astype(np.uint64)
            keys = window_hashes(points, size)[::size].view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys), b.column(1).cast(pa.float32())], names=["key", "ratio"])

    return table.mapInArrow(run, "key long, ratio float")


class Model:
    """Sorted hashes of expressions and contexts with their ratios, from two tables of `hashed`."""

    def __init__(self, grams: pa.Table, contexts: pa.Table):
        self.__setstate__([self._sorted(t) for t in (grams, contexts)])

    @staticmethod
    def _sorted(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        keys = t.column(0).to_numpy().view(np.uint64)
        order = np.argsort(keys)
        return keys[order], t.column(1).to_numpy()[order]

    def __getstate__(self):
        return self.parts

    def __setstate__(self, parts):
        self.parts = parts
        self.ids: dict[str, int] = {}
        self.ratio, self.letters = np.zeros(0), np.zeros(0)

    def _look(self, part: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        have, ratio = self.parts[part]
        if not len(have):
            return np.zeros(len(keys), bool), np.zeros(len(keys), np.float32)
        at = np.searchsorted(have, keys).clip(max=len(have) - 1)
        return have[at] == keys, ratio[at]

    def learn(self, words: list[str]) -> None:
        """Keeps the words' ratios: the sums over their letters."""
        joined = "".join(" " * (ORDER - 1) + w + " " for w in words)
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.uint64)
        letters = np.array([len(w) + 1 for w in words])
        first = np.cumsum(letters + ORDER - 1) - (letters + ORDER - 1)
        seen, ratio = self._look(0, window_hashes(points, ORDER))
        known, backed = self._look(1, window_hashes(points, ORDER - 1)[: len(seen)])
        each = np.where(seen, ratio, np.where(known, backed, np.float32(0))).astype(np.float64)
        own = np.repeat(first, letters) + np.arange(letters.sum()) - np.repeat(np.cumsum(letters) - letters, letters)
        self.ids.update(zip(words, range(len(self.ratio), len(self.ratio) + len(words)), strict=True))
        self.ratio = np.concatenate([self.ratio, np.add.reduceat(each[own], np.cumsum(letters) - letters)])
        self.letters = np.concatenate([self.letters, letters.astype(np.float64)])

    def features(self, texts: list[str | None]) -> np.ndarray:
        """[texts, 2]: ratio a letter of the text and of its most toxic run; zeros for texts without words."""
        if len(self.ids) > KEPT_WORDS:
            self.__setstate__(self.parts)
        cut = [_words.findall((t or "").lower()) for t in texts]
        new = set().union(*cut) - self.ids.keys()
        if new:
            self.learn(sorted(new))
        flat = np.fromiter((self.ids[w] for words in cut for w in words), np.int64)
        return run_features(self.ratio[flat], self.letters[flat], np.array([len(words) for words in cut]))


def run_features(ratio: np.ndarray, letters: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Model.features from the ratio and the letters (one more than it has) of each word and the words of each text."""
    out = np.zeros((len(words), 2))
    full = np.flatnonzero(words)
    if not len(full):
        return out
    first = (np.cumsum(words) - words)[full]
    end = np.repeat(first + words[full], words[full])
    at = np.arange(len(ratio))
    sums, size = ratio.copy(), letters.copy()
    for j in range(1, RUN):
        inside = at + j < end
        there = np.minimum(at + j, len(at) - 1)
        sums += np.where(inside, ratio[there], 0.0)
        size += np.where(inside, letters[there], 0.0)
    cut = (at + RUN > end) & (at != np.repeat(first, words[full]))  # a run that the text's end cuts, but for a short text
    out[full, 0] = np.add.reduceat(ratio, first) / np.add.reduceat(letters, first)
    out[full, 1] = np.maximum.reduceat(np.where(cut, -np.inf, sums / size), first)
    return out


def featured(docs: DataFrame, model: Broadcast, keep: list[str]) -> DataFrame:
    """The columns `keep` of docs with mean_ratio and top_ratio (that of a run) of each whole text."""
    names = [f"_k{i}" for i in range(len(keep))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(len(names)).to_pylist()
            got = np.concatenate([model.value.features(texts[k : k + 200]) for k in range(0, len(texts), 200)]) if texts else np.zeros((0, 2))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(got[:, 0]), pa.array(got[:, 1])], names=[*names, "mean_ratio", "top_ratio"])

    fields = [f"{k} {docs.schema[c].dataType.simpleString()}" for k, c in zip(names, keep, strict=True)]
    out = docs.select(*(F.col(c).alias(k) for c, k in zip(keep, names, strict=True)), "text").mapInArrow(run, ", ".join([*fields, "mean_ratio double, top_ratio double"]))
    return out.select(*(F.col(k).alias(c) for c, k in zip(keep, names, strict=True)), "mean_ratio", "top_ratio")


def word_ratios(docs: DataFrame, seen: DataFrame, contexts: DataFrame) -> DataFrame:
    """word, ratio for each word of the texts, by joins: words are distinct before their letters meet the expressions."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = set().union(*(_words.findall((t or "").lower()) for t in b.column(0).to_pylist()))
            yield pa.RecordBatch.from_arrays([pa.array(sorted(own), pa.string())], names=["word"])

    def letters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs = [(w, g) for w in b.column(0).to_pylist() for g in grams_of(w)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in (zip(*pairs, strict=True) if pairs else ((), ()))], names=["word", "gram"])

    each = docs.select("text").mapInArrow(words, "word string").distinct().mapInArrow(letters, "word string, gram string")
    each = each.join(seen.withColumnRenamed("ratio", "_seen"), "gram", "left").withColumn("h", F.substring("gram", 1, ORDER - 1))
    each = each.join(contexts.withColumnRenamed("ratio", "_backed"), "h", "left")
    return each.groupBy("word").agg(F.sum(F.coalesce("_seen", "_backed", F.lit(0.0))).alias("ratio"))


def featured_by_join(docs: DataFrame, ratios: DataFrame, keep: list[str]) -> DataFrame:
    """`featured` where the model is too large to broadcast: each text's distinct words are joined to their ratios.

    The large side of that join is the texts' words, which Spark splits where a word is in most texts; a text's words
    meet again in one group, as large as the text.
    """
    names = [f"_k{i}" for i in range(len(keep))]
    keyed = materialize(docs.select(*(F.col(c).alias(k) for c, k in zip(keep, names, strict=True)), "text").withColumn("_row", F.expr("uuid()")))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                at: dict[str, list[int]] = {}
                for i, w in enumerate(_words.findall((text or "").lower())):
                    at.setdefault(w, []).append(i)
                if at:
                    yield pa.RecordBatch.from_arrays([pa.array([row] * len(at)), pa.array(list(at)), pa.array([len(w) + 1 for w in at], pa.int32()), pa.array(list(at.values()), pa.list_(pa.int32()))], names=["_row", "word", "letters", "at"])

    def gather(f: pd.DataFrame) -> pd.DataFrame:
        n = np.array([len(x) for x in f["at"]])
        order = np.argsort(np.concatenate(list(f["at"])))
        got = run_features(np.repeat(f["ratio"].to_numpy(), n)[order], np.repeat(f["letters"].to_numpy().astype(np.float64), n)[order], np.array([n.sum()]))
        return pd.DataFrame({"_row": [f["_row"].iloc[0]], "mean_ratio": got[:, 0], "top_ratio": got[:, 1]})

    words = keyed.select("_row", "text").mapInArrow(places, "_row string, word string, letters int, at array<int>").join(ratios, "word")
    got = words.select("_row", "letters", "at", "ratio").groupBy("_row").applyInPandas(gather, "_row string, mean_ratio double, top_ratio double")
    out = keyed.drop("text").join(got, "_row", "left").fillna(0.0, ["mean_ratio", "top_ratio"])
    return out.select(*(F.col(k).alias(c) for c, k in zip(keep, names, strict=True)), "mean_ratio", "top_ratio")


def fit_curve(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, spread and weights (the constant last) of a logistic curve, by Newton steps with a small ridge.

    With one class only, or no rows, the smoothed share of toxic rows alone.
    """
    mean, spread = (x.mean(0), x.std(0)) if len(x) else (np.zeros(2), np.ones(2))
    spread = np.where(spread > 0, spread, 1.0)
    w = np.zeros(x.shape[1] + 1)
    if y.sum() in (0, len(y)):
        w[-1] = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 4.5))
        return mean, spread, w
    z = np.c_[(x - mean) / spread, np.ones(len(x))]
    ridge = np.diag([1e-2] * x.shape[1] + [1e-6])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge, z.T @ (y - p) - ridge @ w)
        w = w + step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return mean, spread, w


def look(docs: DataFrame, grams: DataFrame, keep: list[str]) -> DataFrame:
    """The columns `keep` with the texts' features by the models of these counts, which are broadcast up to MODEL_ROWS
    expressions and contexts and joined to the texts' words beyond."""
    seen, contexts = (materialize(t) for t in ratios(grams))
    if seen.count() + contexts.count() > MODEL_ROWS:
        return featured_by_join(docs, materialize(word_ratios(docs, seen, contexts)), keep)
    model = Model(hashed(seen, ORDER).toArrow(), hashed(contexts, ORDER - 1).toArrow())
    return featured(docs, docs.sparkSession.sparkContext.broadcast(model), keep)


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted for every row.

    Rows whose remainder is 2 are held out: neither models nor curve see their labels. The curve is fitted on remainder
    3, with models of remainders 0 and 1; the models that score are of all three. A doc_id labelled more than once is
    toxic if any label says so. Null or wordless text: the curve at zero. Repeated rows score alike. No labels: one low
    score for all. Empty table: no rows.
    """
    marks = labels.filter(F.col("toxic").isNotNull()).groupBy(F.col("doc_id").alias("_id")).agg(F.max("toxic").cast("int").alias("toxic")).filter(remainder("_id") != 2)
    marks = materialize(marks)
    if marks.count() <= LABEL_ROWS:
        marks = F.broadcast(marks)
    known = docs.select("doc_id", "text").join(marks, F.col("doc_id") == F.col("_id"))
    grams = materialize(gram_counts(known.withColumn("part", (remainder() == 3).cast("int"))))
    whole = materialize(grams.groupBy("gram").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1")))
    last = known.filter(remainder() == 3)
    fit = look(last, grams.filter("part = 0").drop("part"), ["doc_id", "toxic"])
    rows = fit.orderBy(F.xxhash64("doc_id"), "mean_ratio").limit(FIT_ROWS).select("mean_ratio", "top_ratio", "toxic").toArrow()
    x = np.stack([rows.column(0).to_numpy(), rows.column(1).to_numpy()], 1).reshape(-1, 2)
    mean, spread, w = fit_curve(x, rows.column(2).to_numpy().astype(np.float64))
    z = F.lit(float(w[-1])) + sum((F.col(c) - float(m)) * float(k / s) for c, m, s, k in zip(("mean_ratio", "top_ratio"), mean, spread, w, strict=False))
    out = look(docs, whole, ["doc_id"]).withColumn("score", 1 / (1 + F.exp(-z)))
    return out.select("doc_id", (remainder() == 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
