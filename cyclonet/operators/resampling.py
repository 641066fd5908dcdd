"""Replicates by hash-keyed draws: the same seed gives the same replicates on any cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw(seed: int, *keys: str | Column) -> Column:
    """A uniform number in [0, 1) for the row's keys: the first 52 bits of an md5, so that SQL elsewhere can repeat it."""
    parts = [F.lit(str(seed)), *((F.col(k) if isinstance(k, str) else k).cast("string") for k in keys)]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13), 16, 10).cast("double") / float(16**13)


def replicates(df: DataFrame, n: int, name: str = "rep") -> DataFrame:
    return df.withColumn(name, F.explode(F.sequence(F.lit(1), F.lit(n))))


def permute(df: DataFrame, by: list[str], order: str, col: str, n: int, seed: int = 0) -> DataFrame:
    """Long form (rep, by, order, col): the column's values permuted within each group, n times."""
    r = replicates(df.select(*by, order, col), n)
    r = r.withColumn("_u", draw(seed, "rep", *by, order))
    place = F.row_number().over(Window.partitionBy("rep", *by).orderBy(order))
    where = F.row_number().over(Window.partitionBy("rep", *by).orderBy("_u", order))
    values = r.select("rep", *by, where.alias("_i"), col)
    return r.select("rep", *by, order, place.alias("_i")).join(values, ["rep", *by, "_i"]).select("rep", *by, order, col)


def circular_shift(df: DataFrame, by: list[str], order: str, col: str, n: int, seed: int = 0, zero: bool = True) -> DataFrame:
    """Long form: the column shifted around within each group by a drawn step, in [0, size) or, without zero, [1, size)."""
    w = Window.partitionBy(*by)
    base = df.select(*by, order, col, (F.row_number().over(w.orderBy(order)) - 1).alias("_i"), F.count("*").over(w).alias("_n"))
    r = replicates(base, n).withColumn("_u", draw(seed, "rep", *by))
    step = F.floor(F.col("_u") * F.col("_n")) if zero else F.when(F.col("_n") > 1, 1 + F.floor(F.col("_u") * (F.col("_n") - 1))).otherwise(0)
    r = r.withColumn("_j", F.pmod(F.col("_i") + step, F.col("_n")))
    values = r.select("rep", *by, F.col("_j").alias("_i"), col)
    return r.select("rep", *by, order, "_i").join(values, ["rep", *by, "_i"]).select("rep", *by, order, col)


def row_bootstrap(df: DataFrame, by: list[str], order: str, cols: list[str], n: int, seed: int = 0) -> DataFrame:
    """Long form (rep, by, slot, cols): as many rows as the group has, drawn with replacement within it."""
    w = Window.partitionBy(*by)
    base = df.select(*by, *cols, (F.row_number().over(w.orderBy(order)) - 1).alias("_i"), F.count("*").over(w).alias("_n"))
    slots = replicates(base.select(*by, F.col("_i").alias("slot"), "_n"), n).withColumn("_i", F.floor(draw(seed, "rep", *by, "slot") * F.col("_n")).cast("int"))
    return slots.join(base.drop("_n"), [*by, "_i"]).select("rep", *by, "slot", *cols)


def block_bootstrap(df: DataFrame, by: list[str], order: str, cols: list[str], n: int, block: int = 5, seed: int = 0) -> DataFrame:
    """Long form (rep, by, slot, cols): blocks of neighbouring rows drawn with replacement until the group's size is reached."""
    w = Window.partitionBy(*by)
    base = df.select(*by, *cols, (F.row_number().over(w.orderBy(order)) - 1).alias("_i"), F.count("*").over(w).alias("_n"))
    slots = replicates(base.select(*by, F.col("_i").alias("slot"), "_n"), n).withColumn("_b", F.floor(F.col("slot") / block).cast("int"))
    starts = F.greatest(F.col("_n") - block + 1, F.lit(1))
    slots = slots.withColumn("_i", (F.floor(draw(seed, "rep", *by, "_b") * starts) + F.col("slot") % block).cast("int"))
    return slots.join(base.drop("_n"), [*by, "_i"]).select("rep", *by, "slot", *cols)


def null_summary(observed: DataFrame, null: DataFrame, by: list[str], stat: str, sided: str = "two", plus_one: bool = True) -> DataFrame:
    """observed, n, p, median, mean, sd and the central 95 % of the null, per test."""
    obs = observed.select(*by, F.col(stat).alias("observed"))
    j = null.select(*by, F.col(stat).alias("_v")).join(obs, by)
    hit = F.abs("_v") >= F.abs("observed") if sided == "two" else F.col("_v") >= F.col("observed")
    one = 1 if plus_one else 0
    out = j.groupBy(*by, "observed").agg(
        F.count("_v").alias("n"), F.sum(hit.cast("long")).alias("_h"), F.avg("_v").alias("null_mean"), F.stddev_samp("_v").alias("null_sd"),
        F.expr("percentile(_v, 0.5)").alias("null_median"), F.expr("percentile(_v, 0.025)").alias("null_low"), F.expr("percentile(_v, 0.975)").alias("null_high"),
    )
    return out.withColumn("p", (F.col("_h") + one) / (F.col("n") + one)).drop("_h")


def shift_null(df: DataFrame, by: list[str], order: str, x: str, y: str, n: int, seed: int = 0, least: int = 6) -> DataFrame:
    """rep, rho: centred Spearman of y with x circularly shifted within groups."""
    from .statistics import spearman

    moved = circular_shift(df, by, order, x, n, seed).withColumnRenamed(x, "_xs")
    return spearman(moved.join(df.select(*by, order, F.col(y).alias("_y")), [*by, order]), ["rep"], "_xs", "_y", least, by)
