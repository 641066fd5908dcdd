"""Views over the given tables in the shape of contacts, particles and panels, for Spark and as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import materialize


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _run(key: str):
    return F.concat(F.lit("R"), (F.col(key) % 5 + 1).cast("string"))


def contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run, cycle, phase, id1, id2, force: states of run x month x line status.

    Parts have even ids and suppliers odd ones, so networks grow with the tables.
    """
    li = read(spark, sf_dir, "lineitem")
    phase = F.when(F.col("l_linestatus") == "F", "cold").otherwise("hot")
    li = li.select(_run("l_orderkey").alias("run"), F.month("l_shipdate").alias("cycle"), phase.alias("phase"), (2 * F.col("l_partkey")).alias("id1"), (2 * F.col("l_suppkey") + 1).alias("id2"), "l_extendedprice")
    return li.groupBy("run", "cycle", "phase", "id1", "id2").agg(F.max("l_extendedprice").alias("force"))


def particles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run, cycle, id, x, y, z, radius: positions that move with the cycle."""
    c = read(spark, sf_dir, "customer").withColumn("cycle", F.explode(F.array(*map(F.lit, (1, 2, 3, 4)))))
    k = F.col("c_custkey")
    return c.select(
        _run("c_nationkey").alias("run"), "cycle", k.alias("id"), (((k * 7919) % 1009) / 1009.0 + ((k * 31 + F.col("cycle") * 17) % 100) / 5000.0).alias("x"),
        (((k * 104729) % 1013) / 1013.0).alias("y"), (((k * 1299709) % 1019) / 1019.0).alias("z"), (0.02 + 0.005 * (k % 3)).alias("radius"),
    )


def nodes(spark: SparkSession, sf_dir: str, written: DataFrame | None = None) -> DataFrame:
    """run, cycle, phase, id, x, y, z of the ends of contacts, by integer formulas. written: contacts that are written already; then
    so are the ids, which several steps read."""
    c = contacts(spark, sf_dir) if written is None else written
    ids = c.select("run", "cycle", "phase", F.explode(F.array("id1", "id2")).alias("id")).distinct()
    ids = ids if written is None else materialize(ids)
    k = F.col("id")
    return ids.select("run", "cycle", "phase", "id", ((k * 37) % 101 / 101.0).alias("x"), ((k * 53) % 103 / 103.0).alias("y"), ((k * 71) % 107 / 107.0).alias("z"))


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """regime_id, cycle, n, x, y, z, w: 5 groups x 30 cycles."""
    li = read(spark, sf_dir, "lineitem")
    cycle = ((F.year("l_shipdate") * 12 + F.month("l_shipdate")) % 30 + 1).alias("cycle")
    cents = lambda c: F.sum(F.round(c * 100).cast("long")) / 100.0
    return li.groupBy(_run("l_orderkey").alias("regime_id"), cycle).agg(
        F.count("*").alias("n"), cents(F.col("l_extendedprice")).alias("x"), cents(F.col("l_discount") * F.col("l_quantity")).alias("y"),
        (F.max("l_quantity") * F.max("l_tax")).alias("z"), (F.max("l_extendedprice") - F.min("l_extendedprice")).alias("w"),
    )


CONTACTS = """contacts AS (SELECT concat('R', CAST(l_orderkey % 5 + 1 AS VARCHAR)) AS run, CAST(month(l_shipdate) AS INTEGER) AS cycle,
  CASE WHEN l_linestatus = 'F' THEN 'cold' ELSE 'hot' END AS phase, 2 * l_partkey AS id1, 2 * l_suppkey + 1 AS id2, max(l_extendedprice) AS force
  FROM lineitem GROUP BY 1, 2, 3, 4, 5)"""
PARTICLES = """particles AS (SELECT concat('R', CAST(c_nationkey % 5 + 1 AS VARCHAR)) AS run, cy.cycle, c_custkey AS id,
  ((c_custkey * 7919) % 1009) / 1009.0::DOUBLE + ((c_custkey * 31 + cy.cycle * 17) % 100) / 5000.0::DOUBLE AS x, ((c_custkey * 104729) % 1013) / 1013.0::DOUBLE AS y,
  ((c_custkey * 1299709) % 1019) / 1019.0::DOUBLE AS z, 0.02::DOUBLE + 0.005::DOUBLE * (c_custkey % 3) AS radius
  FROM customer CROSS JOIN (SELECT unnest([1, 2, 3, 4]) AS cycle) cy)"""
NODES = CONTACTS + """, nodes AS (SELECT DISTINCT run, cycle, phase, id, (id * 37) % 101 / 101.0::DOUBLE AS x, (id * 53) % 103 / 103.0::DOUBLE AS y, (id * 71) % 107 / 107.0::DOUBLE AS z
  FROM (SELECT run, cycle, phase, unnest([id1, id2]) AS id FROM contacts))"""
PANEL = """panel AS (SELECT concat('R', CAST(l_orderkey % 5 + 1 AS VARCHAR)) AS regime_id, CAST((year(l_shipdate) * 12 + month(l_shipdate)) % 30 + 1 AS INTEGER) AS cycle, count(*) AS n,
  sum(CAST(round(l_extendedprice * 100) AS BIGINT)) / 100.0::DOUBLE AS x, sum(CAST(round(l_discount * l_quantity * 100) AS BIGINT)) / 100.0::DOUBLE AS y,
  max(l_quantity) * max(l_tax) AS z, max(l_extendedprice) - min(l_extendedprice) AS w FROM lineitem GROUP BY 1, 2)"""
