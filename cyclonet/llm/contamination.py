"""Benchmark decontamination as a prefix-filtered set join, DataFrame operations only.

Records. An item's windows (`size` consecutive words; an item of fewer words is one window) are the sets to be found
whole; their tokens are shingles of GRAM words (of a shorter window: the window itself) at known offsets.

Rarity. One pass over the documents finds where they hold any shingle of the benchmark, by its words. Those places,
written once, give each shingle's count over the whole corpus, and with it a window's shingles from rare to common.

Prefix. A set that has to be contained whole has a necessary prefix of one token, its rarest shingle: a document
without that one cannot hold the window. Only places of prefix shingles become candidates. The shingle's offset gives
the place where the window would begin, and the document's and the window's lengths bound it.

Verification. A candidate holds if each of the window's shingles stands at its own place. Shingles are words, not
hashes, and they overlap over the whole window, so this is exact, and no text is read or moved a second time.

Tables made from the benchmark are broadcast where their measured bytes are under BROADCAST; beyond, they join by a
shuffle whose skewed keys AQE splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, materialize, row_key

SIZE, GRAM = 10, 3
SHRINK = 16  # tables of the benchmark are small beside the documents
BROADCAST = 32 << 20
#: What no word contains: ASCII but for digits and letters.
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(text: Column) -> Column:
    """A-Z in lower case, nothing else changed; ASCII texts go the short way."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def words(text: Column) -> Column:
    """The words of a text (null: none)."""
    first, last = lambda w: F.get(w, F.lit(0)), lambda w: F.get(w, F.size(w) - 1)
    head = lambda w: F.when(first(w) == "", 1).otherwise(0)
    tail = lambda w: F.when((last(w) == "") & (F.size(w) > 1), 1).otherwise(0)
    # Only a break at either end leaves an empty string.
    return let(F.split(lowered(F.coalesce(text, F.lit(""))), BREAK), lambda w: F.slice(w, head(w) + 1, F.size(w) - head(w) - tail(w)))


def grams(w: Column, size: int) -> Column:
    """Array of (pos, gram) over all runs of `size` words: the place, from 0, and the words joined by a space."""
    places = F.when(F.size(w) >= size, F.sequence(F.lit(0), F.size(w) - size)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.struct(i.alias("pos"), F.concat_ws(" ", *(F.get(w, i + k) for k in range(size))).alias("gram")))


def light(df: DataFrame, *texts: str, row: int = 64) -> DataFrame:
    """A written table, to be broadcast if its rows (of `row` bytes) and these columns' bytes are within BROADCAST."""
    held = df.agg(F.sum(sum((F.octet_length(c) for c in texts), F.lit(row)))).first()[0] or 0
    return F.broadcast(df) if held <= BROADCAST else df


def item_windows(items: DataFrame, size: int) -> DataFrame:
    """item, win (words joined by a space), n (its words): the distinct windows of each item."""
    w = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words(F.col("text")).alias("_w")).filter(F.size("_w") > 0)
    starts = F.explode(F.sequence(F.lit(1), F.greatest(F.size("_w") - size + 1, F.lit(1))))
    cut = w.select("item", "_w", starts.alias("_s")).select("item", F.slice("_w", F.col("_s"), size).alias("_v"))
    return cut.select("item", F.array_join("_v", " ").alias("win"), F.size("_v").alias("n")).distinct()


def window_grams(windows: DataFrame) -> DataFrame:
    """wid, n, size (of its shingles), pos, gram: every shingle of every window (wid, win, n)."""
    v = F.split("win", " ")
    sized = F.when(F.col("n") >= GRAM, grams(v, GRAM))
    for k in range(1, GRAM):
        sized = sized.when(F.col("n") == k, grams(v, k))
    return windows.select("wid", "n", F.least("n", F.lit(GRAM)).alias("size"), F.inline(sized))


def occurrences(documents: DataFrame, items: DataFrame, size: int = SIZE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, found, windows). rows: _id, _h as in row_key, doc_id, n_words, for each document. found: _id, _h, start, n,
    wid for each place where a document holds a window. windows: item, wid.

    Null or blank texts have no words and hold nothing; a null item_id is the item "". Repeated items and equal texts
    share their windows. Very long texts are searched whole. Without items, or without documents, nothing is found.
    """
    of_item = materialize(item_windows(items, size))
    windows = materialize(of_item.select("win", "n").distinct().withColumn("wid", F.monotonically_increasing_id()), SHRINK)
    shingle = materialize(window_grams(windows), SHRINK)
    sizes = sorted(r[0] for r in shingle.select("size").distinct().collect())  # GRAM values at most
    keyed = documents.select("doc_id", *row_key(), words(F.col("text")).alias("_w"))
    row = F.array(F.struct(F.lit(-1).alias("pos"), F.lit(None).cast("string").alias("gram")))
    placed = keyed.select("doc_id", "_id", "_h", F.size("_w").alias("n_words"), F.inline(F.concat(row, *(grams(F.col("_w"), k) for k in sizes))))
    # One row for the document itself (pos -1) and one for each place that holds a shingle of the benchmark.
    known = materialize(shingle.select("gram").distinct().withColumn("gid", F.monotonically_increasing_id()), SHRINK)
    met = placed.join(light(known, "gram"), "gram", "left").filter((F.col("pos") < 0) | F.col("gid").isNotNull())
    met = materialize(met.select("doc_id", "_id", "_h", "n_words", "pos", "gid"))
    rows = met.filter("pos < 0").select("doc_id", "_id", "_h", F.col("n_words").cast("long").alias("n_words"))
    places = met.filter("pos >= 0").select("_id", "_h", "n_words", "pos", "gid")
    rarity = places.groupBy("gid").agg(F.count("*").alias("_f"))
    # A window with a shingle that occurs nowhere is nowhere; of the others the rarest shingle is the prefix.
    numbered = shingle.join(known, "gram").select("wid", "n", "pos", "gid").join(rarity, "gid", "left")
    ranked = numbered.groupBy("wid", "n").agg(F.min(F.struct(F.coalesce("_f", F.lit(0)).alias("f"), "pos", "gid")).alias("_p"), F.collect_list(F.struct("pos", "gid")).alias("_all"))
    prefix = materialize(ranked.filter("_p.f > 0").select("wid", "n", F.col("_p.pos").alias("_o"), F.col("_p.gid").alias("gid"), "_all"), SHRINK)
    at = F.col("pos") - F.col("_o")
    bounded = (at >= 0) & (at + F.col("n") <= F.col("n_words"))
    candidates = places.join(light(prefix, row=64 + 48 * size), "gid").filter(bounded).select("_id", "_h", at.alias("start"), "n", "wid", "_all")
    wanted = candidates.select("_id", "_h", "start", "n", "wid", F.size("_all").alias("_need"), F.inline("_all"))
    wanted = wanted.select("_id", "_h", "start", "n", "wid", "_need", (F.col("start") + F.col("pos")).alias("pos"), "gid")
    # Rows that repeat one another hold the same places, each as often; so both sides count distinct ones.
    met_all = wanted.distinct().join(places.select("_id", "_h", "pos", "gid").distinct(), ["_id", "_h", "pos", "gid"])
    counted = met_all.groupBy("_id", "_h", "start", "n", "wid", "_need").agg(F.count("*").alias("_k")).filter("_k = _need")
    found = materialize(counted.select("_id", "_h", "start", "n", "wid"))
    return rows, found, of_item.join(windows.select("win", "wid"), "win").select("item", "wid")


def contamination(documents: DataFrame, items: DataFrame, size: int = SIZE) -> DataFrame:
    """For each document: doc_id, n_words, n_hit (words inside occurrences of item windows), n_items, items (their ids as
    strings, sorted) and contaminated.

    Awkward rows are as in `occurrences`; a document that repeats another's id and text gets the same row.
    """
    rows, found, windows = occurrences(documents, items, size)
    so_far = Window.partitionBy("_id", "_h").orderBy("start", F.col("n").desc()).rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("n")
    spans = found.select("_id", "_h", "start", "n").distinct().withColumn("_reach", F.coalesce(F.max(end).over(so_far), F.lit(0)))
    hit = spans.groupBy("_id", "_h").agg(F.sum(F.greatest(end - F.greatest("start", "_reach"), F.lit(0))).alias("n_hit"))
    held = found.select("_id", "_h", "wid").distinct().join(windows, "wid").groupBy("_id", "_h").agg(F.sort_array(F.collect_set("item")).alias("items"))
    out = rows.join(hit, ["_id", "_h"], "left").join(held, ["_id", "_h"], "left")
    items_ = F.coalesce("items", F.array().cast("array<string>"))
    return out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(items_).cast("long").alias("n_items"), items_.alias("items"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))


def decontaminate(documents: DataFrame, items: DataFrame, size: int = SIZE) -> DataFrame:
    """documents without the contaminated ones; all their columns, as they were."""
    _, found, _ = occurrences(documents, items, size)
    bad = found.select(F.col("_id").alias("_bad_id"), F.col("_h").alias("_bad_h")).distinct()
    mine = [k.alias(f"_mine{i}") for i, k in enumerate(row_key())]
    keyed = documents.select("*", *mine)
    return keyed.join(bad, (F.col("_mine0") == F.col("_bad_id")) & (F.col("_mine1") == F.col("_bad_h")), "left_anti").drop("_mine0", "_mine1")
