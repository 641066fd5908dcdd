"""Information measures, rare events and risk."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .windows import average_rank, qcut


def entropy_bits(df: DataFrame, by: list[str], col: str) -> DataFrame:
    h = df.groupBy(*by, col).agg(F.count("*").alias("_n"))
    p = F.col("_n") / F.sum("_n").over(Window.partitionBy(*(by or [F.lit(0)])))
    return h.withColumn("_p", p).groupBy(*by).agg((-F.sum(F.col("_p") * F.log2("_p"))).alias("bits"))


def mutual_info(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Mutual information of two code columns in bits, and its share of the entropy of y (null if that is 0)."""
    part = lambda *c: Window.partitionBy(*(by or [F.lit(0)]), *c)
    j = df.groupBy(*by, x, y).agg(F.count("*").alias("_n"))
    j = j.withColumns({"_t": F.sum("_n").over(part()), "_nx": F.sum("_n").over(part(x)), "_ny": F.sum("_n").over(part(y))})
    term = F.col("_n") / F.col("_t") * F.log2(F.col("_n") * F.col("_t") / (F.col("_nx") * F.col("_ny")))
    hy = -F.sum(F.col("_n") / F.col("_t") * F.log2(F.col("_ny") / F.col("_t")))
    return j.groupBy(*by).agg(F.sum(term).alias("mi"), F.when(hy > 0, F.sum(term) / hy).alias("nmi"))


def conditional_mi(df: DataFrame, by: list[str], x: str, y: str, z: str) -> DataFrame:
    """I(x; y | z) in bits: the average over z of the mutual information within."""
    part = lambda *c: Window.partitionBy(*(by or [F.lit(0)]), *c)
    j = df.groupBy(*by, x, y, z).agg(F.count("*").alias("_n"))
    j = j.withColumns({"_t": F.sum("_n").over(part()), "_nz": F.sum("_n").over(part(z)), "_nxz": F.sum("_n").over(part(x, z)), "_nyz": F.sum("_n").over(part(y, z))})
    return j.groupBy(*by).agg(F.sum(F.col("_n") / F.col("_t") * F.log2(F.col("_n") * F.col("_nz") / (F.col("_nxz") * F.col("_nyz")))).alias("cmi"))


def decompose(df: DataFrame, route: str, predictor: str, target: str) -> DataFrame:
    """Information of route, predictor and both together about the target, and of each given the other."""
    d = df.withColumn("_joint", F.concat_ws("|", F.col(route).cast("string"), F.col(predictor).cast("string")))
    r, p, j = (mutual_info(d, [], c, target).select(F.col("mi").alias(n)) for c, n in ((route, "route_mi"), (predictor, "predictor_mi"), ("_joint", "joint_mi")))
    out = r.crossJoin(p).crossJoin(j)
    return out.withColumns({"predictor_given_route": F.col("joint_mi") - F.col("route_mi"), "route_given_predictor": F.col("joint_mi") - F.col("predictor_mi")})


def auc(df: DataFrame, by: list[str], score: str, label: str) -> DataFrame:
    """Area under the ROC curve by average ranks; null with one class only."""
    d = df.filter(F.col(score).isNotNull() & F.col(label).isNotNull()).withColumn("_r", average_rank(by, score))
    p = F.sum(F.col(label).cast("long"))
    n = F.count("*")
    s = F.sum(F.when(F.col(label).cast("long") == 1, F.col("_r")))
    return d.groupBy(*by).agg(F.when((p > 0) & (p < n), (s - p * (p + 1) / 2) / (p * (n - p))).alias("auc"), n.alias("n"))


def quantile_risk(df: DataFrame, by: list[str], score: str, label: str, bins: int = 5) -> DataFrame:
    """Event rate, count and ratio to the base rate in each exact-quantile bin."""
    q = qcut(df, by, score, bins).groupBy(*by, "bin").agg(F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("_e"))
    base = F.sum("_e").over(Window.partitionBy(*(by or [F.lit(0)]))) / F.sum("n").over(Window.partitionBy(*(by or [F.lit(0)])))
    rate = F.col("_e") / F.col("n")
    return q.select(*by, "bin", "n", rate.alias("rate"), F.when(base > 0, rate / base).alias("ratio"))


def gate_risk(df: DataFrame, gate: str, label: str) -> DataFrame:
    """Event rate with and without the gate, and their difference."""
    y = F.col(label).cast("double")
    out = df.agg(F.avg(F.when(F.col(gate), y)).alias("rate_in"), F.avg(F.when(~F.col(gate), y)).alias("rate_out"))
    return out.withColumn("difference", F.col("rate_in") - F.col("rate_out"))
