"""Quality rules whose cutoffs are chosen on labelled documents with exact binomial bounds."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, shield
from .words import inside, mix, split, windows

SYMBOLS = b"#*$%&|<>"
#: Rules, as ratios of what `measure` counts; more is worse.
RULES = {
    "symbol_rate": ("n_symbols", "n_words"),
    "upper_rate": ("n_upper", "word_chars"),
    "repeat_rate": ("n_repeat_words", "n_words"),
    "dup_line_rate": ("n_dup_lines", "n_lines"),
}
#: Cutoffs tried for each rule, the laxest first.
GRID = (0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_lines")

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_SOLID_CHAR = np.array([(b & 0xC0) != 0x80 and b not in (0x20, 9, 10, 11, 12, 13) for b in range(256)])


def count_texts(texts: pa.Array) -> dict[str, np.ndarray]:
    """The counts of COUNTS for each text of an Arrow array (null: empty)."""
    out: dict[str, list] = {k: [] for k in COUNTS}
    for w in split(texts):
        n = np.diff(w.first)

        def total(flag: np.ndarray, w=w) -> np.ndarray:
            sums = np.zeros(len(w.data) + 1, np.int64)
            np.cumsum(flag[w.data], out=sums[1:])
            return np.diff(sums[w.at])

        repeated = np.zeros(len(w.start) + 1, np.int64)
        h = windows(w.hashes(), 3)
        ok = np.flatnonzero(inside(w, 3))
        if len(ok):
            key = mix(h[ok] + mix(w.doc[ok].astype(np.uint64), 3))
            _, back, times = np.unique(key, return_inverse=True, return_counts=True)
            cover = np.zeros(len(w.start) + 4, np.int64)
            twice = ok[times[back] > 1]
            np.add.at(cover, twice, 1)
            np.add.at(cover, twice + 3, -1)
            np.cumsum(np.cumsum(cover)[: len(w.start)] > 0, out=repeated[1:])
        lines, dup = np.zeros(w.docs, np.int64), np.zeros(w.docs, np.int64)
        data = w.data.tobytes()
        for i in np.flatnonzero(n):
            own = [x for x in data[w.at[i] : w.at[i + 1]].split(b"\n") if x and not x.isspace()]
            lines[i], dup[i] = len(own), len(own) - len(set(own))
        got = {"n_words": n, "word_chars": total(_SOLID_CHAR), "n_symbols": total(_SYMBOL), "n_upper": total(_UPPER), "n_repeat_words": repeated[w.first[1:]] - repeated[w.first[:-1]], "n_lines": lines, "n_dup_lines": dup}
        for k, v in got.items():
            out[k].append(v)
    return {k: np.concatenate(v).astype(np.int64) if v else np.zeros(0, np.int64) for k, v in out.items()}


MEASURES = ", ".join(f"{k} long" for k in COUNTS)


def measure(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns `keep` of docs with the counts of each whole text, the base verdict and the rules' ratios.

    base_failed: fewer than 50 words, or over half of the words in 3-word windows that the text repeats.
    A null or blank text has no words and so fails; its ratios are 0.
    """
    schema = docs.select(*keep).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts = count_texts(b.column(b.num_columns - 1))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *(pa.array(counts[k]) for k in COUNTS)], names=[*b.schema.names[:-1], *COUNTS])

    text = docs.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)), F.col("text").alias("_text"))
    fields = ", ".join(f"_k{i} {f.dataType.simpleString()}" for i, f in enumerate(schema.fields))
    out = text.mapInArrow(run, f"{fields + ', ' if fields else ''}{MEASURES}")
    out = out.select(*(F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)), *COUNTS)
    ratios = {name: F.when(F.col(of) > 0, F.col(part) / F.col(of)).otherwise(F.lit(0.0)) for name, (part, of) in RULES.items()}
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.withColumns(ratios | {"base_failed": failed})


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(at most k of n) where each has chance p, exactly (log-gamma terms summed)."""
    if k >= n:
        return 1.0
    a, b, c = math.log(p), math.log1p(-p), math.lgamma(n + 1)
    return min(1.0, math.fsum(math.exp(c - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * a + (n - i) * b) for i in range(k + 1)))


def pick_cutoff(n: int, over: list[int], risk: float, level: float) -> int:
    """Index of the last step of a path that the bound allows, -1 for none.

    Fixed-sequence test: from the laxest step on, "the false-rejection rate is above `risk`" has to be refuted at
    `level`, and the first step that fails ends the walk, so the steps cost no further correction.
    """
    best = -1
    for i, k in enumerate(over):
        # Once more than risk * n good documents are over the cutoff, the tail exceeds any level below one half.
        if n == 0 or k > risk * n or binomial_tail(k, n, risk) > level:
            break
        best = i
    return best


def first_step() -> Column:
    """Place on the path of the first step whose cutoff a document is over; null: none.

    The path is set before any label is seen: the rules in the order of RULES, each through GRID from its laxest cutoff
    on. A step holds its own cutoff, the laxer ones before it and the strictest one of every rule before.
    """
    steps = []
    for j, r in enumerate(RULES):
        passed = sum((F.col(r) <= c).cast("int") for c in GRID)
        steps.append(F.when(passed < len(GRID), passed + j * len(GRID)))
    return F.least(*steps)


def pick_step(good: list[int], bad: list[int], risk: float, level: float) -> int:
    """The step to use, -1 for none, from the documents that each step is the first to reject (last entry: none does).

    All steps up to the one that `pick_cutoff` names hold their bound at once, so which of them is used is free: the
    one that rejects the greatest share of bad less good documents, the earliest of equals.
    """
    over = list(itertools.accumulate(good[:-1]))
    last = pick_cutoff(sum(good), over, risk, level)
    gains = [b / max(1, sum(bad)) - g / max(1, sum(good)) for b, g in zip(itertools.accumulate(bad[:-1]), over, strict=True)][: last + 1]
    return gains.index(max(gains)) if gains and max(gains) > 0 else -1


def cutoffs(measured: DataFrame, labels: DataFrame, stratum: str, risk: float = 0.02, error: float = 0.05, identity: str = "doc_id") -> DataFrame:
    """One row a stratum with labels: a cutoff for each rule (null: the rule rejects nothing there), n_good and pooled.

    With probability 1 - error over the labelled documents, in every stratum at once, all rules together reject at most
    a share `risk` of good documents. Bonferroni shares the error among the strata; within one, an exact binomial test
    of the rejections of all rules so far walks the path of `first_step` until a step fails (a fixed-sequence test, so
    the steps need no further correction). The path and the rules' ratios depend on no label, so all labelled rows are
    the holdout. A stratum with too few good documents for any step (217 of four strata) shares its cutoffs with the
    others like it; the bound is then that of their union, not of each, which `pooled` says. What is counted, n_good
    too, are distinct values of `identity` in a stratum (or the pool), as copies of a text are no further draws; give it
    a hash of the text. One labelled more than once is good if any label says so. Null stratum: counts as empty. No
    labels: no rows.
    """
    marks = labels.filter(F.col("quality").isNotNull()).groupBy(F.col("doc_id").alias("_label_id")).agg((F.max("quality") == 1).alias("good"))
    held = measured.filter(~F.col("base_failed")).join(marks, F.col("doc_id") == F.col("_label_id"))
    own = F.coalesce(F.col(stratum), F.lit("")).alias("stratum")
    draws = materialize(held.groupBy(own, F.col(identity).alias("_draw"), first_step().alias("step")).agg(F.max("good").alias("good")))
    sizes = materialize(draws.groupBy("stratum").agg(F.sum(F.col("good").cast("long")).alias("n_good")))
    level = error / max(1, sizes.count())
    fewest = math.ceil(math.log(level) / math.log1p(-risk))
    sizes = sizes.withColumn("pooled", F.col("n_good") < fewest).withColumn("_pool", F.when(~F.col("pooled"), F.col("stratum")))
    none = len(RULES) * len(GRID)

    def run(f: pd.DataFrame) -> pd.DataFrame:
        counts = {g: [0] * (none + 1) for g in (True, False)}
        for g, step, n in zip(f["good"], f["step"], f["n"], strict=True):
            counts[bool(g)][none if pd.isna(step) else int(step)] += int(n)
        rule, place = divmod(pick_step(counts[True], counts[False], risk, level), len(GRID))
        limits = [GRID[-1] if j < rule else GRID[place] if j == rule else None for j in range(len(RULES))]
        return pd.DataFrame({"_pool": [f["_pool"].iloc[0]], **{f"max_{r}": pd.Series([v], dtype="float64") for r, v in zip(RULES, limits, strict=True)}})

    # At most 2 * (steps + 1) rows a stratum; the pooled ones are added up before they meet.
    pooled = draws.join(sizes, "stratum").groupBy("_pool", "_draw", "step").agg(F.max("good").alias("good"))
    rows = pooled.groupBy("_pool", "good", "step").agg(F.count("*").alias("n"))
    chosen = rows.groupBy("_pool").applyInPandas(run, "_pool string, " + ", ".join(f"max_{r} double" for r in RULES))
    out = sizes.join(chosen, sizes["_pool"].eqNullSafe(chosen["_pool"])).drop("_pool")
    return out.withColumns({f"max_{r}": F.when(~F.isnan(f"max_{r}"), F.col(f"max_{r}")) for r in RULES})


def verdict(measured: DataFrame, limits: DataFrame, stratum: str) -> DataFrame:
    """Adds kept: not base_failed, and over no cutoff of its stratum (a stratum without labels has none)."""
    joined = measured.join(limits.withColumnRenamed("stratum", "_stratum").drop("n_good", "pooled"), F.coalesce(F.col(stratum), F.lit("")) == F.col("_stratum"), "left")
    over = F.lit(False)
    for r in RULES:
        over = over | F.coalesce(F.col(r) > F.col(f"max_{r}"), F.lit(False))
    return joined.withColumn("kept", ~F.col("base_failed") & ~over).drop("_stratum", *(f"max_{r}" for r in RULES))


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, lang, text_key (64 bits of the text) and the measures."""
    return measure(docs.select("doc_id", "lang", "text", F.xxhash64("text").alias("text_key")), ["doc_id", "lang", "text_key"])


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts, base verdict and final verdict for every document, in strata of its language.

    Empty table: no rows. No labels: kept is the base verdict's opposite. Repeated rows are judged alike.
    """
    measured = materialize(_keyed(docs))
    return verdict(measured, cutoffs(measured, labels, "lang", identity="text_key"), "lang").drop("text_key")


def filter_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the rules keep, with all their columns.

    Counts are taken twice, for the cutoffs and for the verdicts: to keep them between the two would shuffle the texts.
    Null or blank text: rejected. Repeated rows: judged alike, each keeps its row. Clashing columns come back as they
    were. Empty table: no rows.
    """
    docs, restore = shield(docs, ("doc_id", "lang", "text"))
    limits = materialize(cutoffs(materialize(_keyed(docs)), labels, "lang", identity="text_key"))
    return restore(verdict(measure(docs, docs.columns), limits, "lang").filter("kept"))
