"""Document fingerprints from closed syncmers of words. DataFrame operations only.

A text is cut into words (runs without white space, pieces of PIECE characters at most). A syncmer is a run of K words
whose least inner run of S words, by hash, lies at its start or end; whether a run is chosen depends on its own words
alone, so a shared passage has the same anchors in every text. K - 1 empty words stand before the text, so that short
texts have anchors too.

A fingerprint holds every anchor with its place, so it grows with the text and nothing of a long text is lost. Two
fingerprints are matched by position: anchors of equal hash lie on a diagonal (the distance of their places), and a
match counts if the match before or after it in the text lies on the same one, as the anchors of a shared passage do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWEST, let, long_array, partitions

K, S = 5, 2
PIECE = 12
INNER = K - S  # place of the last inner run
#: An anchor as one long: 30 bits of hash, one bit for the side of a comparison, 32 bits of place.
HASH_SHIFT, SIDE = 33, 1 << 32


def with_anchors(df: DataFrame, text: str, name: str) -> DataFrame:
    """Adds an array of structs (at, hash): the place of each closed syncmer's first word, from 1 - K on, and its hash.

    Null or blank text: an empty array. Very long texts: the arrays grow with the words, each place costs the same.
    """
    words = F.regexp_extract_all(F.col(text), F.lit(r"[^\x20\x09-\x0D]{1,%d}" % PIECE), F.lit(0))
    df = df.withColumn("_w", F.transform(words, lambda w: F.xxhash64(w)))
    df = df.withColumn("_w", F.concat(F.array_repeat(F.lit(0).cast("long"), K - 1), F.col("_w")))
    w, r = F.col("_w"), F.col("_r")
    runs = F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1)))  # the last one has no right neighbour and is not used
    df = df.withColumn("_r", runs)
    places = F.when(F.size(w) >= K, F.sequence(F.lit(0), F.size(w) - K)).otherwise(F.array().cast("array<int>"))

    def closed(i: Column) -> Column:
        inner = [F.get(r, i + j) for j in range(1, INNER)]
        return F.least(F.get(r, i), F.get(r, i + INNER)) <= (F.least(*inner) if len(inner) > 1 else inner[0])

    df = df.withColumn("_at", F.filter(places, closed))
    # Runs of two at 0 and 2 and the word at 4 name all five words.
    whole = F.transform(F.col("_at"), lambda i: F.struct((i - (K - 1)).alias("at"), F.shiftrightunsigned(F.xxhash64(F.get(r, i), F.get(r, i + 2), F.get(w, i + 4)), HASH_SHIFT + 1).alias("hash")))
    return df.withColumn(name, whole).drop("_w", "_r", "_at")


def as_text(anchors: Column) -> Column:
    """Each anchor's hash (8 hexadecimal digits) and its distance from the anchor before (2; FF and 8 from 255 on), in order."""

    def one(a: Column, i: Column) -> Column:
        gap = a["at"] - F.coalesce(F.get(anchors, i - 1)["at"], F.lit(1 - K))
        far = F.concat(F.lit("FF"), F.lpad(F.hex(gap), 8, "0"))
        return F.concat(F.lpad(F.hex(a["hash"]), 8, "0"), F.when(gap < 255, F.lpad(F.hex(gap), 2, "0")).otherwise(far))

    return F.array_join(F.transform(anchors, one), "")


def first_places(anchors: Column) -> Column:
    """Distinct anchors as sorted longs: hash, a zero for the side, first place."""
    codes = F.sort_array(F.transform(anchors, lambda a: F.shiftleft(a["hash"], HASH_SHIFT) + (a["at"] + (K - 1)).cast("long")))
    new = lambda s: lambda x, i: F.coalesce(F.shiftright(F.get(s, i - 1), HASH_SHIFT) != F.shiftright(x, HASH_SHIFT), F.lit(True))
    return let(codes, lambda s: F.filter(s, new(s)))


def with_fingerprint(df: DataFrame, text: str, name: str, places: str) -> DataFrame:
    """Adds the fingerprint of a text and, for comparisons, its distinct anchors with their first places."""
    df = with_anchors(df, text, "_anchors")
    return df.withColumns({name: as_text(F.col("_anchors")), places: first_places(F.col("_anchors"))}).drop("_anchors")


def with_likeness(df: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """Adds the positional likeness of two columns of first places: matches that count over all distinct anchors.

    Equal ones, two empty ones included: 1; one empty: 0. An anchor that is a text's only one counts by itself.
    """
    x, y = F.col(a), F.col(b)
    df = df.withColumn("_m", F.sort_array(F.concat(x, F.transform(y, lambda v: v + SIDE))))
    m = F.col("_m")
    place = F.lit(SIDE - 1)

    def match(v: Column, i: Column) -> Column:
        n = F.get(m, i + 1)
        at = v.bitwiseAND(place)
        return F.when(F.shiftright(v, HASH_SHIFT) == F.shiftright(n, HASH_SHIFT), F.struct(at.alias("at"), (n.bitwiseAND(place) - at).alias("off")))

    df = df.withColumn("_d", F.sort_array(F.filter(F.transform(m, match), lambda s: s.isNotNull())))
    d = F.col("_d")
    near = lambda s, i: F.coalesce(F.get(d, i - 1)["off"] == s["off"], F.lit(False)) | F.coalesce(F.get(d, i + 1)["off"] == s["off"], F.lit(False))
    lone = F.least(F.size(x), F.size(y)) == 1
    common = F.when(lone, F.size(d)).otherwise(F.size(F.filter(d, near)))
    df = df.withColumn("_c", common)
    value = F.when(x == y, 1.0).when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(F.col("_c") / (F.size(x) + F.size(y) - F.col("_c")))
    return df.withColumn(name, value).drop("_m", "_d", "_c")


def _bucket(value: Column, cuts: list[int], equal: bool) -> Column:
    """How many of the sorted cuts are below value (equal: at most value), by binary search over a literal array."""
    depth = max(1, len(cuts)).bit_length()
    table = long_array([*cuts, *[(1 << 63) - 1] * ((1 << depth) - len(cuts))])
    steps = F.array(*(F.lit(1 << d) for d in range(depth - 1, -1, -1)))

    def step(at: Column, by: Column) -> Column:
        cut = F.get(table, at + by - 1)
        return F.when((at + by <= len(cuts)) & (cut <= value if equal else cut < value), at + by).otherwise(at)

    return F.aggregate(steps, F.lit(0), step)


def dealt_by_range(df: DataFrame, order: str, tie: str) -> DataFrame:
    """Adds _o (order as long), _u (tie in [0, 1)), _b (its range) and _guest, and puts each range into one partition.

    The ranges are those of (order, tie) at approximate quantiles, as many as shuffle partitions: a value of `order`
    that takes several quantiles has its rows dealt over that many ranges by their ties. The first row of each range in
    descending order also goes, as a guest, to the range after it.
    """
    n = partitions(df.sparkSession)
    keyed = df.withColumns({"_o": F.coalesce(F.col(order).cast("long"), F.lit(LOWEST)), "_u": F.shiftrightunsigned(F.col(tie), 11) * 2.0**-53})
    fractions = [i / n for i in range(1, n)]
    cuts = keyed.agg(F.percentile_approx("_o", fractions, 10_000).alias("c")).first()["c"] if fractions else []
    cuts = sorted(cuts or [])
    low, high = _bucket(F.col("_o"), cuts, False), _bucket(F.col("_o"), cuts, True)
    keyed = keyed.withColumns({"_lo": low, "_hi": high}).withColumn("_b", (F.col("_lo") + F.floor(F.col("_u") * (F.col("_hi") - F.col("_lo") + 1))).cast("int")).drop("_lo", "_hi")
    tops = keyed.groupBy("_b").agg(F.max(F.struct("_o", "_u")).alias("_t"))  # one row a range
    ranges = Window.orderBy("_b")
    every = ranges.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    guests = tops.select(F.col("_t._o").alias("_o"), F.col("_t._u").alias("_u"), F.coalesce(F.lead("_b").over(ranges), F.min("_b").over(every)).alias("_g"))
    sent = keyed.join(F.broadcast(guests), ["_o", "_u"], "left")
    places = F.concat(F.array(F.struct(F.col("_b").alias("_b"), F.lit(0).alias("_guest"))), F.when(F.col("_g").isNotNull(), F.array(F.struct(F.col("_g").alias("_b"), F.lit(1).alias("_guest")))).otherwise(F.array().cast("array<struct<_b:int,_guest:int>>")))
    return sent.select(*df.columns, "_o", "_u", F.inline(places)).repartition(n, "_b")


def compare_documents(docs: DataFrame) -> DataFrame:
    """For each document: its fingerprint, that of its edited text, and likenesses; see the README for the edit.

    A null text counts as empty. A table of one row: the document is its own next. Equal doc_ids follow one another by
    the hash of their texts, and are dealt by it where they are many. Null doc_id: the lowest. Repeated rows: each keeps
    its row. Empty table: no rows.
    """
    light = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("_tie", F.xxhash64("text"))
    dealt = with_fingerprint(dealt_by_range(light, "doc_id", "_tie"), "text", "fingerprint", "_p")
    w = Window.partitionBy("_b").orderBy("_guest", F.col("_o").desc(), F.col("_u").desc())
    pair = dealt.select("*", F.lead("text").over(w).alias("_next"), F.lead("_p").over(w).alias("_np")).filter("_guest = 0")
    n = F.char_length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.left(F.col("text"), n - third), F.left(F.col("_next"), third))
    out = pair.select("doc_id", n.cast("long").alias("n_chars"), "fingerprint", "_p", "_np", edited.alias("_edited"))
    out = with_fingerprint(out, "_edited", "edited_fingerprint", "_ep")
    out = with_likeness(with_likeness(out, "_p", "_ep", "near_edited"), "_p", "_np", "near_next")
    return out.select("doc_id", "n_chars", F.sha2(F.col("_edited").cast("binary"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")
