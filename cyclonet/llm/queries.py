"""The operators' queries over the given tables; each applies its operator to every row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, contamination, fingerprints, near_dedup, packing, phrases, pii, quality, sharding, substrings, toxicity, whitening, wrappers
from .common import table


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal-data spans of every document, with the terms that disclose them."""
    return pii.digest(pii.locate(table(spark, sf_dir, "documents")))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids and the text decoded from them, as checksums."""
    out = bpe.encode_texts(table(spark, sf_dir, "documents"), ["doc_id"])
    ids = (F.octet_length("ids") / 4).cast("long")
    return out.select("doc_id", ids.alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the 35-word windows that occur more than once."""
    out = substrings.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), 35)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score for every document."""
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), 2048)


def op6_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Syncmer fingerprints of every document and of its edited text."""
    return fingerprints.compare_documents(table(spark, sf_dir, "documents"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    out = wrappers.extract(table(spark, sf_dir, "pages"))
    return out.withColumn("n_chars", F.char_length("text").cast("long"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 8 shards of near equal bytes along a Hilbert curve."""
    out = sharding.document_shards(table(spark, sf_dir, "documents"), 8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdicts of the quality rules for all documents."""
    out = quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document, at a weighted Jaccard similarity of 0.8."""
    return near_dedup.classes(table(spark, sf_dir, "documents").select("doc_id", "text"), 0.8).select("doc_id", "class_id")


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings projected on the first 32 whitened components."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"), 32)


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's 2000 strongest phrases over all documents."""
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op13_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which words of every document stand in ten-word windows of benchmark items."""
    out = contamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_bpe": op2_bpe,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_toxicity": op4_toxicity,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_document_fingerprints": op6_document_fingerprints,
    "op7_html_extraction": op7_html_extraction,
    "op8_sharding": op8_sharding,
    "op9_quality_rules": op9_quality_rules,
    "op10_minhash_near_dedup": op10_minhash_near_dedup,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_phrase_collocations": op12_phrase_collocations,
    "op13_benchmark_decontamination": op13_benchmark_decontamination,
}

_OP3_SQL = r"""
WITH words AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents
), places AS (
  SELECT r, unnest(range(1, len(ws) - 33)) AS i, ws FROM words WHERE len(ws) >= 35
), hashed AS (
  SELECT r, i, md5(array_to_string(ws[i : i + 34], ' ')) AS h FROM places
), twice AS (
  SELECT h FROM hashed GROUP BY h HAVING count(*) > 1
), gone AS (
  SELECT r, list(DISTINCT k) AS ks FROM (SELECT r, unnest(range(i, i + 35)) AS k FROM hashed JOIN twice USING (h)) GROUP BY r
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(ks), 0) AS BIGINT) AS n_removed,
       sha256(coalesce(array_to_string(CASE WHEN ks IS NULL THEN ws ELSE list_transform(list_filter(range(1, len(ws) + 1), lambda k: NOT list_contains(ks, k)), lambda k: ws[k]) END, ' '), '')) AS kept_sha256
FROM words LEFT JOIN gone USING (r)
"""

_LOWER_SQL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP12_SQL = rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_LOWER_SQL}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), words AS (
  SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda w: w <> '') AS ws FROM pieces
), totals AS (
  SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM words GROUP BY 1
), frequent AS (
  SELECT lang, k, array_to_string(ws[i : i + k - 1], ' ') AS phrase, count(*) AS f
  FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM words CROSS JOIN (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE len(ws) >= k)
  GROUP BY 1, 2, 3 HAVING count(*) >= 100
), found AS (
  SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM frequent WHERE k > 1
), cuts AS (
  SELECT *, array_to_string(ws[1 : c], ' ') AS lp, array_to_string(ws[c + 1 : k], ' ') AS rp FROM (SELECT *, unnest(range(1, k)) AS c FROM found)
), scored AS (
  SELECT c.lang, c.phrase, c.a, l.f AS l, r.f AS r, t.n, c.c, CAST(1000::HUGEINT * c.a * t.n // (l.f::HUGEINT * r.f) AS BIGINT) AS score
  FROM cuts c JOIN frequent l ON l.lang = c.lang AND l.phrase = c.lp JOIN frequent r ON r.lang = c.lang AND r.phrase = c.rp JOIN totals t ON t.lang = c.lang
), least AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1
), holders AS (
  SELECT lang, array_to_string(ws[i : i + s - 1], ' ') AS phrase, max(a) AS most
  FROM (SELECT *, unnest(range(1, k - s + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS s FROM found WHERE k > 2)) GROUP BY 1, 2
), ranked AS (
  SELECT e.*, row_number() OVER (PARTITION BY e.lang ORDER BY e.score DESC, e.a DESC, e.phrase) AS rank
  FROM least e LEFT JOIN holders h ON h.lang = e.lang AND h.phrase = e.phrase WHERE coalesce(h.most, 0) < e.a
)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000
"""

_BREAK_SQL = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_OP13_SQL = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS d, doc_id, list_filter(string_split_regex({_LOWER_SQL}, '{_BREAK_SQL}'), lambda w: w <> '') AS ws FROM documents
), items AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, list_filter(string_split_regex({_LOWER_SQL}, '{_BREAK_SQL}'), lambda w: w <> '') AS ws FROM benchmark
), wins AS (
  SELECT DISTINCT item, len(v) AS size, array_to_string(v, ' ') AS win
  FROM (SELECT item, ws[s : s + 9] AS v FROM (SELECT item, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS s FROM items WHERE len(ws) > 0))
), places AS (
  SELECT d, s, size, array_to_string(ws[s : s + size - 1], ' ') AS win
  FROM (SELECT d, ws, size, unnest(range(1, len(ws) - size + 2)) AS s FROM docs CROSS JOIN (SELECT DISTINCT size FROM wins) WHERE len(ws) >= size)
), met AS (
  SELECT p.d, p.s, p.size, w.item FROM places p JOIN wins w ON w.size = p.size AND w.win = p.win
), hit AS (
  SELECT d, count(DISTINCT k) AS n FROM (SELECT d, unnest(range(s, s + size)) AS k FROM met) GROUP BY d
), held AS (
  SELECT d, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT d, item FROM met) GROUP BY d
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(held.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (d) LEFT JOIN held USING (d)
"""

ORACLE_SQL: dict[str, str] = {"op3_substring_dedup": _OP3_SQL, "op12_phrase_collocations": _OP12_SQL, "op13_benchmark_decontamination": _OP13_SQL}
