"""The folder for intermediate tables that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a folder of its own in local mode, as in tests; on a cluster an error,
    for what one machine wrote to its own disk no other would find."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where is None:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Written to the shared folder and read back: the lineage ends there, and a lost executor costs no recomputation."""
    path = f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes a table of `materialize` that no later plan reads; anything else is left alone."""
    spark = df.sparkSession
    root = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        if where.getParent() is not None and where.getParent().toUri().getPath() == root.toUri().getPath():
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
