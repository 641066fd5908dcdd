"""Personal data: pattern spans with checks, and terms that the corpus shows to disclose them. DataFrame operations only.

Base spans come from four patterns. The information-theoretic part takes the found values as entities and asks which
words disclose them, wherever they stand: over the whole corpus, a term t discloses a value e by
log2(p(e | t) / p(e)) bits of the -log2 p(e) bits that e carries. Terms that give away at least a set share of them are
spans of kind `term`, in every text that holds them.

All counts are of units, not rows: texts that share their least hash of five words are one unit, so copies, and most
near copies, are no evidence. What a term discloses must also be no accident: the bits of its meetings with e, added up,
have to exceed log2(tests / ERROR), where a test is a value of two units or more with a unit of the corpus. A value of
one unit can never reach that (it carries log2 n bits, and there are n tests at least), so such values have no terms.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, long_array, materialize, shield

#: The patterns as given, with possessive steps and a start at a run's head, which matches the same spans
#: in linear time (a run that fails at its head fails at every later start; \G allows the rest of a run after a match).
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IP_PARTS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.|$)){4}$"
TERM = r"\p{L}[\p{L}\p{N}]+"

SHARE = 0.9  # of the value's information, from which on a term is a span
REMOVE = 0.97  # from which on it is removed rather than generalised
ERROR = 0.01  # chance that any term is taken by accident
BIT_WORDS = 1 << 14  # 64-bit words of the term filter
BROADCAST_ROWS = 100_000
CUT = 256  # code points of the pieces that `sanitize` takes texts from

SPAN = "struct<kind:string,start:int,end:int,value:string>"
NO_SPANS = f"array<{SPAN}>"
ADDED = "array<struct<start:int,end:int,share:double>>"


def luhn(digits: Column) -> Column:
    def step(total: Column, i: Column) -> Column:
        d = F.substring(digits, -i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))

    return F.aggregate(F.sequence(F.lit(1), F.char_length(digits)), F.lit(0), step) % 10 == 0


def _card(m: Column) -> Column:
    digits = F.regexp_replace(m, "[ -]", "")
    return F.when(F.char_length(digits).between(16, 19), luhn(digits)).otherwise(False)


KINDS: dict[str, tuple[str, Callable[[Column], Column], Callable[[Column], Column]]] = {
    "email": (EMAIL, lambda m: m.isNotNull(), lambda t: F.contains(t, F.lit("@"))),
    "ip": (IP, lambda m: m.rlike(IP_PARTS), lambda t: t.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]")),
    "card": (CARD, _card, lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){15}")),
    "phone": (PHONE, lambda m: F.char_length(F.regexp_replace(m, "[^0-9]", "")).between(8, 15), lambda t: t.rlike(r"\+[0-9]")),
}


def running(values: Column, zero: Column, op: Callable[[Column, Column], Column]) -> Column:
    """For each element, op over all before it. By blocks of about the root of the size, so n elements take n * sqrt(n)
    short steps and no array grows element by element."""

    def blocked(v: Column) -> Column:
        width = F.greatest(F.ceil(F.sqrt(F.size(v))), F.lit(1)).cast("int")
        starts = F.filter(F.sequence(F.lit(0), F.greatest(F.size(v) - 1, F.lit(0))), lambda i: i % width == 0)
        sums = F.transform(starts, lambda i: F.aggregate(F.slice(v, i + 1, width), zero, op))

        def upto(befores: Column) -> Column:
            return F.transform(v, lambda _, i: F.aggregate(F.slice(v, i - i % width + 1, i % width), F.get(befores, F.floor(i / width).cast("int")), op))

        return let(sums, lambda x: let(F.transform(x, lambda _, k: F.aggregate(F.slice(x, F.lit(1), k), zero, op)), upto))

    return let(values, blocked)


def find(text: Column, kind: str, pattern: str, good: Callable[[Column], Column], guard: Callable[[Column], Column] | None = None) -> Column:
    """Leftmost non-overlapping matches that pass `good`, in code points, as an array of SPAN.

    The text is split at the matches; the running length over pieces and matches gives the places.
    """
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("piece"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"))
    long = lambda p: F.char_length(p["piece"]) + F.coalesce(F.char_length(p["match"]), F.lit(0))

    def placed(z: Column) -> Column:
        def span(before: Column) -> Callable[[Column, Column], Column]:
            start = lambda p, i: F.get(before, i) + F.char_length(p["piece"])
            return lambda p, i: F.struct(F.lit(kind).alias("kind"), start(p, i).alias("start"), (start(p, i) + F.char_length(p["match"])).alias("end"), p["match"].alias("value"))

        return let(running(F.transform(z, long), F.lit(0), lambda x, y: x + y), lambda before: F.transform(z, span(before)))

    spans = F.filter(let(parts, placed), lambda s: s["value"].isNotNull() & F.coalesce(good(s["value"]), F.lit(False))).cast(NO_SPANS)
    return F.when(guard(text), spans).otherwise(F.array().cast(NO_SPANS)) if guard else spans


def base_spans(text: Column) -> Column:
    """All base spans of a text (null: none), by kind as in KINDS, then by start."""
    text = F.coalesce(text, F.lit(""))
    return F.concat(*(find(text, kind, *how) for kind, how in KINDS.items()))


def _words(text: Column) -> Column:
    """The text's terms, in lower case; what belongs to an email is none."""
    plain = F.when(F.contains(text, F.lit("@")), F.regexp_replace(text, EMAIL, " ")).otherwise(text)
    return F.regexp_extract_all(F.lower(plain), F.lit(TERM), F.lit(0))


def _unit(text: Column) -> Column:
    """The least hash of five words (of all, if there are fewer): equal for copies, and for most near copies."""
    w = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    whole = lambda x: F.transform(F.slice(x, F.lit(1), F.greatest(F.size(x) - 4, F.lit(1))), lambda v, i: F.xxhash64(v, *(F.get(x, i + k) for k in range(1, 5))))
    return F.coalesce(let(w, lambda x: F.array_min(whole(x))), F.lit(0).cast("long"))


def _key(text: Column) -> Column:
    return F.md5(text.cast("binary"))


def profile(docs: DataFrame) -> DataFrame:
    """doc_id, key (equal for equal texts), unit, spans and, where there are spans, the text's distinct terms."""
    text = F.col("text")
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumns({"spans": base_spans(text), "unit": _unit(text)})
    terms = F.when(F.size("spans") > 0, F.array_distinct(_words(text)))
    return materialize(found.select("doc_id", _key(text).alias("key"), "unit", "spans", terms.alias("terms")))


def term_filter(terms: DataFrame) -> Callable[[Column], Column] | None:
    """A test that every one of the terms passes, and few other words: a fixed array of bits. None: there are no terms."""
    h = F.xxhash64("term")
    bits = terms.select(F.pmod(F.shiftright(h, 6), F.lit(BIT_WORDS)).cast("int").alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(63).cast("int")).alias("bit"))
    words = [0] * BIT_WORDS
    for r in bits.groupBy("word").agg(F.bit_or("bit").alias("bits")).collect():  # BIT_WORDS rows at most
        words[r["word"]] = r["bits"]
    table = long_array(words)

    def maybe(w: Column) -> Column:
        x = F.xxhash64(w)
        return F.call_function("shiftright", F.get(table, F.pmod(F.shiftright(x, 6), F.lit(BIT_WORDS)).cast("int")), x.bitwiseAND(63).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1

    return maybe if any(words) else None


def disclosing(docs: DataFrame, found: DataFrame) -> DataFrame | None:
    """term, share: the greatest share of a value's information that the term discloses. None: no term does enough."""
    n = max(1, found.select("unit").distinct().count())
    with_spans = found.filter(F.size("spans") > 0)
    held = with_spans.select("unit", "terms", F.inline(F.array_distinct(F.transform("spans", lambda s: F.struct(s["kind"].alias("kind"), s["value"].alias("value"))))))
    values = held.select("unit", "kind", "value").distinct().groupBy("kind", "value").agg(F.count("*").alias("alone")).filter("alone > 1")
    values = materialize(values.withColumn("p", F.least(F.lit(0.5), F.col("alone") / F.lit(n))))
    tests = values.count() * n
    if not tests:
        return None
    need = math.log2(tests / ERROR)
    values = values.filter(-F.log2("p") * F.col("alone") >= need)
    # The units where a value meets a term; a value is at most in `alone` units, so both sides of the join are what texts hold.
    met = held.join(values.select("kind", "value", "p"), ["kind", "value"]).select("kind", "value", "p", "unit", F.explode("terms").alias("term")).distinct()
    met = met.groupBy("kind", "value", "p", "term").agg(F.count("*").alias("both"))
    met = materialize(met.filter(-F.log2("p") * F.col("both") >= need))
    maybe = term_filter(met.select("term"))
    if maybe is None:
        return None
    share = lambda of: F.log2(F.least(F.lit(1.0), F.col("both") / F.col(of)) / F.col("p")) / -F.log2("p")
    # One text of each unit with values: fewer units than all that hold a term, which clears common words at once.
    some = with_spans.groupBy("unit").agg(F.first("terms").alias("terms")).select(F.explode(F.filter("terms", maybe)).alias("term"))
    met = materialize(met.join(some.groupBy("term").agg(F.count("*").alias("least")), "term", "left").fillna(1, ["least"]).filter(share("least") >= SHARE))
    maybe = term_filter(met.select("term"))
    if maybe is None:
        return None
    # The unit is a column before the terms are spread, or it would be found anew for each of them; and the outer form
    # keeps Spark from testing for empty arrays beforehand, which would find the terms twice.
    own = docs.select(F.coalesce("text", F.lit("")).alias("text")).withColumn("_t", F.array_distinct(F.filter(_words(F.col("text")), maybe)))
    own = own.select(F.when(F.size("_t") > 0, _unit(F.col("text"))).alias("unit"), "_t")
    df = own.select("unit", F.explode_outer("_t").alias("term")).filter("term IS NOT NULL").distinct().groupBy("term").agg(F.count("*").alias("df"))
    rated = met.join(df, "term").withColumn("share", share("df"))
    strong = rated.filter((F.col("share") >= SHARE) & (F.col("share") * -F.log2("p") * F.col("both") >= need))
    return materialize(strong.groupBy("term").agg(F.max("share").alias("share")))


def _small(df: DataFrame, size: str) -> bool:
    """Few enough rows and array elements to broadcast."""
    return df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS and (df.agg(F.sum(F.size(size))).first()[0] or 0) <= 10 * BROADCAST_ROWS


def places(docs: DataFrame, terms: DataFrame | None) -> DataFrame:
    """key, added: for every text that holds some of the terms, an array of structs (start, end, share) by start."""
    maybe = terms and term_filter(terms)
    if not maybe:
        return docs.sparkSession.createDataFrame([], f"key string, added {ADDED}")
    own = docs.select(F.coalesce("text", F.lit("")).alias("text")).withColumn("_t", F.array_distinct(F.filter(_words(F.col("text")), maybe)))
    hits = own.select(F.when(F.size("_t") > 0, _key(F.col("text"))).alias("key"), "_t").select("key", F.explode_outer("_t").alias("term"))
    hits = hits.filter("term IS NOT NULL").distinct().join(terms, "term")
    hits = materialize(hits.groupBy("key").agg(F.collect_list(F.struct("term", "share")).alias("hits")))
    if _small(hits, "hits"):
        joined = own.select("text", _key(F.col("text")).alias("key")).join(F.broadcast(hits), "key")
    else:  # texts without a term do not go through the shuffle
        joined = own.filter(F.size("_t") > 0).select("text", _key(F.col("text")).alias("key")).join(hits, "key")
    joined = joined.withColumn("_map", F.map_from_entries("hits"))
    spans = find(F.col("text"), "term", f"{EMAIL}|{TERM}", lambda m: ~F.contains(m, F.lit("@")) & F.map_contains_key("_map", F.lower(m)))
    added = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.element_at(F.col("_map"), F.lower(s["value"])).alias("share")))
    return materialize(joined.select("key", added.alias("added")).groupBy("key").agg(F.first("added").alias("added")))


def locate(docs: DataFrame) -> DataFrame:
    """doc_id, spans (base, as SPAN) and added (disclosing terms; null: none) for each row.

    Null or empty text: no spans. Equal texts have equal spans. Repeated rows: each keeps its row. Very long texts: all
    of it, in steps that grow little faster than the matches. Empty table: no rows.
    """
    found = profile(docs)
    added = places(docs, disclosing(docs, found))
    return found.select("doc_id", "key", "spans").join(F.broadcast(added) if _small(added, "added") else added, "key", "left").select("doc_id", "spans", "added")


def span_texts(spans: Column) -> Column:
    return F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))


def digest(located: DataFrame) -> DataFrame:
    """The spans of `locate` as counts, a checksum of the base spans and one string of all spans (no spans: empty)."""
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = span_texts(F.col("spans"))
    term = F.transform(F.coalesce("added", F.array().cast(ADDED)), lambda s: F.concat_ws(":", F.lit("term"), s["start"].cast("string"), s["end"].cast("string")))
    return located.select("doc_id", *(count(k) for k in KINDS), F.sha2(F.array_join(base, ",").cast("binary"), 256).alias("base_sha256"), F.array_join(F.concat(base, term), ",").alias("spans"))


def replaced(text: Column, cuts: Column) -> Column:
    """text with each cut (start, end, by), sorted, replaced; one that overlaps those before only lengthens what goes.

    Pieces come from the text's parts of CUT code points, so that a piece costs its own length wherever it stands.
    """

    def piece(parts: Column, a: Column, b: Column) -> Column:
        first, last = F.floor(a / CUT).cast("int"), F.floor(b / CUT).cast("int")
        head = F.substring(F.get(parts, first), a % CUT + 1, F.when(first == last, b - a).otherwise(F.lit(CUT)))
        rest = F.concat(F.array_join(F.slice(parts, first + 2, last - first - 1), ""), F.coalesce(F.left(F.get(parts, last), b % CUT), F.lit("")))
        return F.when(b <= a, "").when(first == last, head).otherwise(F.concat(head, rest))

    def put(parts: Column) -> Callable[[Column], Column]:
        def with_ends(ends: Column) -> Column:
            each = F.transform(cuts, lambda c, i: F.when(c["start"] >= F.get(ends, i), F.concat(piece(parts, F.get(ends, i), c["start"]), c["by"])).otherwise(""))
            return F.concat(F.array_join(each, ""), piece(parts, F.array_max(F.transform(cuts, lambda c: c["end"])), F.char_length(text)))

        return with_ends

    ends = running(F.transform(cuts, lambda c: c["end"]), F.lit(0), lambda x, y: F.greatest(x, y))
    return let(F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % CUT), F.lit(0)), lambda parts: let(ends, put(parts)))


def sanitize(docs: DataFrame) -> DataFrame:
    """docs with their texts' spans replaced: a value by its kind in brackets, a term by [TERM] or, from REMOVE on, by nothing.

    A text without spans stays as it is, null included. Repeated rows: each keeps its row. Clashing columns come back
    as they were. Very long texts: as in `locate`. Empty table: no rows. Base spans are found twice, in the profile and
    here: to carry them over would shuffle the texts.
    """
    docs, restore = shield(docs, ("doc_id", "text"))
    added = places(docs, disclosing(docs, profile(docs)))
    found = docs.withColumn("_text", F.coalesce("text", F.lit("")))
    found = found.withColumns({"_key": _key(F.col("_text")), "_spans": base_spans(F.col("_text"))})
    joined = found.join((F.broadcast(added) if _small(added, "added") else added).withColumnRenamed("key", "_key"), "_key", "left")
    put = lambda s, by: F.struct(s["start"].alias("start"), s["end"].alias("end"), by.alias("by"))
    cuts = F.concat(
        F.transform("_spans", lambda s: put(s, F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))),
        F.transform(F.coalesce("added", F.array().cast(ADDED)), lambda s: put(s, F.when(s["share"] >= REMOVE, "").otherwise("[TERM]"))),
    )
    joined = joined.withColumn("_cuts", F.sort_array(cuts))
    clean = F.when(F.size("_cuts") == 0, F.col("text")).otherwise(replaced(F.col("_text"), F.col("_cuts")))
    return restore(joined.withColumn("text", clean))
