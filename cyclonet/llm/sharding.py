"""Sharding along a Hilbert curve over metadata dimensions, cut into runs of near equal bytes. DataFrame operations only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, running_sums


def with_hilbert_index(df: DataFrame, name: str, levels: list[Column], bits: int) -> DataFrame:
    """Adds the position on the Hilbert curve through the grid of 2**bits levels a dimension, by Skilling's transform.

    levels: integer columns in [0, 2**bits). The steps run in one `aggregate` over a literal array, so the plan does
    not grow with the number of bits; each stage is a column of its own, so nothing is computed twice.
    """
    n = len(levels)
    masks = [1 << b for b in range(bits - 1, 0, -1)]
    steps = F.array(*(F.struct(F.lit(q).cast("long").alias("q"), F.lit(i).alias("i")) for q in masks for i in range(n)))

    def undo(x: Column, step: Column) -> Column:
        low, first, own = step["q"] - 1, F.get(x, F.lit(0)), F.get(x, step["i"])
        swapped = first.bitwiseXOR(own).bitwiseAND(low)
        turned = own.bitwiseAND(step["q"]) != 0
        return F.transform(
            x,
            lambda v, j: F.when(turned, F.when(j == 0, v.bitwiseXOR(low)).otherwise(v))
            .when((j == 0) & (step["i"] != 0), v.bitwiseXOR(swapped))
            .when((j == step["i"]) & (step["i"] != 0), v.bitwiseXOR(swapped))
            .otherwise(v),
        )

    axes = F.aggregate(steps, F.array(*(c.cast("long") for c in levels)), undo) if masks else F.array(*(c.cast("long") for c in levels))
    df = df.withColumn("_axes", axes)
    axes = F.col("_axes")
    # Gray code: each axis takes the exclusive or of the ones before it.
    df = df.withColumn("_gray", F.transform(axes, lambda _, j: F.aggregate(F.slice(axes, 1, j + 1), F.lit(0).cast("long"), lambda a, v: a.bitwiseXOR(v))))
    gray = F.col("_gray")
    last = F.get(gray, F.lit(n - 1))
    flip = reduce(
        lambda a, q: a.bitwiseXOR(F.when(last.bitwiseAND(F.lit(q).cast("long")) != 0, F.lit(q - 1).cast("long")).otherwise(F.lit(0).cast("long"))),
        masks,
        F.lit(0).cast("long"),
    )
    df = df.withColumn("_flip", flip)
    spread = F.lit(0).cast("long")
    for b in range(bits):
        for i in range(n):
            bit = F.shiftright(F.get(gray, F.lit(i)).bitwiseXOR(F.col("_flip")), b).bitwiseAND(F.lit(1).cast("long"))
            spread = spread.bitwiseOR(F.shiftleft(bit, b * n + n - 1 - i))
    return df.withColumn(name, spread).drop("_axes", "_gray", "_flip")


def hash_level(value: Column, bits: int) -> Column:
    """A level for a column of names; null counts as empty."""
    return F.pmod(F.crc32(F.coalesce(value.cast("string"), F.lit("")).cast("binary")), F.lit(1 << bits)).cast("long")


def log_level(size: Column, bits: int, steps: float = 2.0) -> Column:
    """A level for a size: `steps` levels each doubling."""
    return F.least(F.floor(F.log2(size.cast("double") + 1) * steps), F.lit((1 << bits) - 1)).cast("long")


def hilbert_shards(df: DataFrame, dims: list[Column], size: Column, group: Column, tie: list[str], shards: int = 8, bits: int = 5, whole: float = 0.01) -> DataFrame:
    """Adds shard (0 .. shards-1) and slot (gapless from 0 in each shard); law `bytes`: the shards' sizes are near equal.

    Rows are ordered by the curve through `dims` (levels, see hash_level and log_level), then `group`, then `tie`, and
    the order is cut where the running size passes a multiple of total/shards. Rows of one group (equal texts) take the
    least curve position of the group and so lie together. A border never cuts a group that is no larger than the
    largest row or than `whole` of a shard: even a text by itself may put a shard that far from the mean, and no shard
    is further from it. Only a border that falls into a larger group (to keep that whole would break the law) cuts it.
    Empty table: no rows. Nulls: a null name counts as empty, a null text has size 1. Repeated rows keep a slot each.
    """
    placed = with_hilbert_index(df.select("*", size.alias("_size"), group.alias("_group")), "_at", dims, bits)
    # A group's sums, partial ones before the shuffle. Written out, so that the join back has plain shuffles on both
    # sides, which Spark may split where a group is hot.
    groups = materialize(placed.groupBy("_group").agg(F.min("_at").alias("_curve"), F.sum("_size").alias("_bytes")))
    placed = placed.drop("_at").join(groups, "_group")
    order = ["_curve", "_group", *tie]
    summed = materialize(running_sums(placed, order, {"_before": "_size", "_index": "1"}))
    total = summed.agg(F.coalesce(F.sum("_size"), F.lit(0)).alias("_total"), F.max("_size").alias("_largest"))
    whole_groups = (F.col("_bytes") * F.lit(shards) <= F.col("_total") * F.lit(whole)) | (F.col("_bytes") <= F.col("_largest"))
    first = materialize(summed.groupBy("_group").agg(F.min("_before").alias("_group_before")))
    middle = F.when(whole_groups, F.col("_group_before") + F.col("_bytes") / 2).otherwise(F.col("_before") + F.col("_size") / 2)
    cut = F.least(F.floor(middle * F.lit(shards) / F.col("_total")), F.lit(shards - 1)).cast("int")
    cutting = materialize(summed.join(first, "_group").crossJoin(F.broadcast(total)).withColumn("shard", cut))
    starts = cutting.groupBy("shard").agg(F.min("_index").alias("_start"))  # as many rows as shards
    out = cutting.join(F.broadcast(starts), "shard")
    return out.select(*df.columns, "shard", (F.col("_index") - F.col("_start")).alias("slot"))


def document_shards(docs: DataFrame, shards: int = 8) -> DataFrame:
    """`documents` without their texts, sharded over language, source and size of the text.

    Null text: size 1. Null lang or source: counts as empty. Repeated rows: a slot each. Empty table: no rows.
    """
    body = F.coalesce(F.col("text"), F.lit(""))
    light = docs.select("doc_id", "lang", "source", (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"), F.xxhash64(body).alias("_text"))
    dims = [hash_level(F.col("lang"), 5), hash_level(F.col("source"), 5), log_level(F.col("size"), 5, 1.5)]
    return hilbert_shards(light, dims, F.col("size"), F.col("_text"), ["doc_id"], shards).drop("_text")


