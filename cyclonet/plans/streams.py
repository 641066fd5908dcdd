"""Queries that read a table as a stream and give what the batch gives."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import streaming
from ..shared import materialize, shared_dir
from .registry import register
from .views import CONTACTS, contacts


def source(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/{table}.parquet").schema
    return spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 4).parquet(f"{sf_dir}/{table}.parquet*")


def settle(df: DataFrame) -> DataFrame:
    """Runs an aggregation to the end of what is there, in complete mode, and reads back the last result.

    Results and checkpoints go to the shared folder.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    query = df.writeStream.outputMode("complete").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(lambda b, _: b.write.mode("overwrite").parquet(f"{path}/out")).start()
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{path}/out")


def _windows(s, d):
    out = settle(streaming.rare_windows(source(s, d, "events"), "ts", "event_type", F.col("value") > 50, "6 hours"))
    return out.withColumn("start", F.unix_timestamp("start"))


def _completeness(s, d):
    li = source(s, d, "lineitem")
    states = li.select((F.col("l_orderkey") % 5).alias("run"), F.month("l_shipdate").alias("cycle"), F.col("l_linestatus").alias("phase"))
    return settle(streaming.completeness(states, "run", 24))


def _cycle_delta(s, d):
    """The mean force of each state as rows of a stream, in an order that mixes the phases; each cycle's pair comes out once."""
    means = contacts(s, d).groupBy("run", "cycle", "phase").agg(F.avg("force").alias("force"))
    at = F.timestamp_seconds(F.col("cycle") * 3600 + F.pmod(F.xxhash64("run", "phase"), F.lit(1800)))
    rows = materialize(means.withColumn("ts", at).repartition(4, F.xxhash64("run", "cycle", "phase")))
    stream = s.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(rows.inputFiles()[0].rpartition("/")[0])
    path = f"{shared_dir(s)}/{uuid.uuid4().hex}"
    pairs = streaming.pair_phases(stream, "run", "force", "ts", "100 days")
    pairs.writeStream.outputMode("append").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(lambda b, k: b.write.mode("overwrite").parquet(f"{path}/out/batch={k}")).start().awaitTermination()
    return s.read.schema(pairs.schema).option("recursiveFileLookup", True).parquet(f"{path}/out")


register("str_cycle_delta", _cycle_delta, "run cycle", "cold hot hot_minus_cold", CONTACTS, """
  SELECT run, cycle, avg(force) FILTER (phase = 'cold') AS cold, avg(force) FILTER (phase = 'hot') AS hot, avg(force) FILTER (phase = 'hot') - avg(force) FILTER (phase = 'cold') AS hot_minus_cold
  FROM contacts GROUP BY 1, 2 HAVING count(DISTINCT phase) = 2""")
register("str_overload_window", _windows, "start event_type n events", "", "",
  "SELECT CAST(floor(epoch(ts) / 21600) * 21600 AS BIGINT) AS start, event_type, count(*) AS n, CAST(sum(CAST(value > 50 AS INT)) AS BIGINT) AS events FROM events GROUP BY 1, 2")
register("str_completeness", _completeness, "run seen complete", "", "",
  "SELECT l_orderkey % 5 AS run, count(DISTINCT (month(l_shipdate), l_linestatus)) AS seen, count(DISTINCT (month(l_shipdate), l_linestatus)) >= 24 AS complete FROM lineitem GROUP BY 1")
