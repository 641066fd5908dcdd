"""Whitening of embeddings with MLlib block matrices.

Entries are quantised to integers x = floor(SCALE c) + SHIFT, whose sums are exact, so a centred entry (n x - S) / n
carries one rounding only, however large the mean is against the spread. The centred rows get running numbers and become
a BlockMatrix A. Its transpose times A is the scatter matrix: the row blocks (the middle dimension) are dealt over the
partitions, each adds up its own products, and one d x d matrix comes back. Its eigenvectors are found on the driver
(d is the vectors' length, the only size there), and A times the whitening matrix, block by block, projects every row.
The covariance of the projected rows is measured in the same way, by another transposed product.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import long_array, materialize, partitions

SCALE, SHIFT = 64, 1_000_000
ROWS, COLS = 1024, 1024  # of a block: 8 MB at most

SCHEMA = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def quantised(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """vectors with x (array of long) in place of the vector, without rows whose vector is null, is empty or holds null or
    non-finite entries. Only vectors of the greatest length stay: others have no place in the same space. Entries of 2**40
    and more are too large for exact sums in longs; Spark's arithmetic then raises."""
    whole = F.col(vector).isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    x = F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE) + F.lit(SHIFT).cast("long"))
    kept = vectors.filter(F.coalesce(whole, F.lit(False))).withColumn("x", x).drop(vector)
    longest = kept.agg(F.max(F.size("x")).alias("_d"))
    return kept.join(F.broadcast(longest), F.size("x") == F.col("_d")).drop("_d")


def numbered(df: DataFrame) -> DataFrame:
    """df, written, with _i: running numbers from 0 without gaps, by the written order of each partition."""
    marked = materialize(df.withColumns({"_p": F.spark_partition_id(), "_m": F.monotonically_increasing_id()}))
    # One row a partition.
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = marked.groupBy("_p").agg(F.count("*").alias("_n")).select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_s"))
    return marked.join(F.broadcast(starts), "_p").withColumn("_i", F.col("_s") + F.col("_m").bitwiseAND((1 << 33) - 1)).drop("_p", "_m", "_s")


def sums(df: DataFrame, column: str) -> tuple[int, list]:
    """Rows, and the column's sum at each place of the array."""
    long = df.select(F.posexplode(column).alias("at", "v")).groupBy("at").agg(F.sum("v").alias("s"), F.count("*").alias("n"))
    got = sorted(long.collect())  # one row a place
    return (got[0]["n"], [r["s"] for r in got]) if got else (0, [])


def block_matrix(rows: DataFrame, n: int, d: int) -> BlockMatrix:
    """rows (_i, v array of double) as distributed blocks."""
    old = MLUtils.convertVectorColumnsFromML(rows.select("_i", array_to_vector("v").alias("v")), "v")
    return IndexedRowMatrix(old, n, d).toBlockMatrix(ROWS, COLS)


def product(a: BlockMatrix, b: BlockMatrix, splits: int) -> BlockMatrix:
    """a times b; the middle dimension is dealt over `splits` partitions, which add up their own products."""
    java = a._java_matrix_wrapper.call("multiply", b._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(java, a.rowsPerBlock, b.colsPerBlock)


def scatter(a: BlockMatrix, n: int, splits: int) -> np.ndarray:
    return product(a.transpose(), a, max(1, min(splits, -(-n // ROWS)))).toLocalMatrix().toArray()


def whiten(vectors: DataFrame, most: int = 32, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """For each vector that `quantised` keeps and each component, by falling eigenvalue, up to `most`: the key and SCHEMA.

    deviation is exact; null where it does not fit in a long. A direction whose eigenvalue is no more than rounding of
    the greatest one has no certain vector and is left out, so equal vectors, a single one, or an empty table give no
    rows. A null key stays; repeated rows each keep theirs; other columns are not read.
    """
    spark = vectors.sparkSession
    none = spark.createDataFrame([], f"{key} {vectors.schema[key].dataType.simpleString()}, {SCHEMA}")
    rows = numbered(quantised(vectors.select(F.col(key), F.col(vector)), vector))
    n, total = sums(rows, "x")
    if n == 0:
        return none
    d, splits = len(total), partitions(spark)
    apart = F.zip_with("x", long_array(total), lambda x, s: F.lit(n).cast("long") * x - s)
    a = block_matrix(rows.select("_i", F.transform(apart, lambda c: c.cast("double") / float(n)).alias("v")), n, d)
    v = scatter(a, n, splits) / n
    e, u = np.linalg.eigh((v + v.T) / 2)
    e, u = e[::-1], u[:, ::-1]
    k = int((e[:most] > e[0] * d * np.finfo(float).eps).sum()) if e[0] > 0 else 0
    if not k:
        return none
    w = u[:, :k] / np.sqrt(e[:k])
    parts = [((i, 0), DenseMatrix(len(b), k, b.ravel(order="F").tolist())) for i, b in enumerate(np.split(w, range(COLS, d, COLS)))]
    white = product(a, BlockMatrix(spark.sparkContext.parallelize(parts, 1), COLS, k, d, k), 1)
    indexed = white.toIndexedRowMatrix()  # has a name, as the JVM's matrix may go as soon as its wrapper is collected
    projected = callMLlibFunc("getIndexedRows", indexed._java_matrix_wrapper._java_model)
    projected = materialize(projected.select(F.col("index").alias("_i"), vector_to_array("vector").alias("w")))
    means = [s / n for s in sums(projected, "w")[1]]
    middle = F.array(*map(F.lit, means))
    again = scatter(block_matrix(projected.select("_i", F.zip_with("w", middle, lambda x, m: x - m).alias("v")), n, k), n, splits) / n
    error = float(np.abs(again - np.eye(k)).max())
    deviation = F.aggregate(apart, F.lit(0).cast("long"), lambda t, c: F.try_add(t, F.try_multiply(c, c)))
    shares = F.array(*(F.lit(float(x)) for x in e[:k] / np.trace(v)))
    out = rows.select(key, "_i", deviation.alias("deviation")).join(projected, "_i").select(key, "deviation", F.posexplode("w").alias("_at", "whitened"))
    return out.select(key, (F.col("_at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.get(shares, F.col("_at")).alias("explained"), F.lit(error).alias("identity_error"))
