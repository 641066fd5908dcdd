"""Reading, materialising and ordering, shared by the operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shared import shared_dir

LOWEST = -(1 << 63)
BATCH_BYTES = 2 << 20


def shield(df: DataFrame, needed: tuple[str, ...]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """df with all columns but the needed ones under names that no operator uses, and what gives back df's columns."""
    hidden = {c: f"_x{i}" for i, c in enumerate(df.columns) if c not in needed}
    back = {v: k for k, v in hidden.items()}
    return df.withColumnsRenamed(hidden), lambda out: out.select(*(hidden.get(c, c) for c in df.columns)).withColumnsRenamed(back)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame, shrink: int = 1) -> DataFrame:
    """Cuts the lineage: written to the shared folder and read back, so that a lost executor costs no recomputation.

    shrink: for tables that are a small part of the input, into that many times fewer files than shuffle partitions.
    """
    spark = df.sparkSession
    if shrink > 1:
        df = df.coalesce(max(2, partitions(spark) // shrink))
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bound_batches(spark: SparkSession, size: int = BATCH_BYTES) -> None:
    """Arrow batches of about `size` bytes from here on, in this session, instead of 64 MB or 10,000 rows: a task that
    hands whole texts to Python then holds a few such batches and not its whole partition, several times over.

    A limit that the session has below that stays. A row longer than that is a batch by itself.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key)) > size:
        spark.conf.set(key, str(size))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def row_key(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """Two columns that rows share only if they repeat one another: the id (null: the lowest long) and a hash of the text."""
    return [F.coalesce(F.col(doc_id), F.lit(LOWEST)).alias("_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_h")]


def running_sums(df: DataFrame, order: list[str], sums: dict[str, str]) -> DataFrame:
    """For each row, in the order of `order`, the sum of a column over all rows before it; no task sees more than its range.

    sums: new column -> summed column; the special name "1" counts rows. Rows equal in every order column are dealt to
    one range, so the order should end in columns that tell rows apart.
    """
    spark = df.sparkSession
    n = partitions(spark)
    ranged = materialize(df.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()))
    amount = {new: F.lit(1).cast("long") if old == "1" else F.col(old).cast("long") for new, old in sums.items()}
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # One row a range: n rows at most, so the window below and the broadcast are bounded by the number of partitions.
    starts = ranged.groupBy("_range").agg(*(F.sum(c).alias(f"_t_{new}") for new, c in amount.items()))
    starts = starts.select("_range", *(F.coalesce(F.sum(f"_t_{new}").over(before), F.lit(0)).alias(f"_s_{new}") for new in amount))
    inner = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.select("*", *(F.coalesce(F.sum(c).over(inner), F.lit(0)).alias(f"_l_{new}") for new, c in amount.items()))
    joined = local.join(F.broadcast(starts), "_range")
    return joined.select(*df.columns, *((F.col(f"_l_{new}") + F.col(f"_s_{new}")).alias(new) for new in amount))


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once however often `then` uses it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def long_array(values: list[int]) -> Column:
    """A literal array, folded to a constant by the optimizer; one call instead of one for each value."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")
