"""Cycle indices built from panel columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import asinh_scale, clip, safe_div
from .windows import minmax, zscore


def response(df: DataFrame, cold: str, hot: str, next_cold: str, loop: str, eps: float = 1e-9) -> DataFrame:
    """Amplitude (hot - cold), recovery (hot - next cold), efficiency, positive loop cost, hazard and overload."""
    amp, rec = F.col(hot) - F.col(cold), F.col(hot) - F.col(next_cold)
    out = df.withColumns({"amplitude": amp, "recovery": rec, "loop_cost": clip(loop, low=0.0)})
    out = out.withColumn("efficiency", safe_div("recovery", "amplitude"))
    out = out.withColumn("hazard", F.col("loop_cost") / (F.abs("recovery") + eps))
    return out.withColumns({"quality": 1 / (1 + F.col("hazard")), "overload": asinh_scale("hazard", 2.0)})


def hazard(df: DataFrame, cost: str, recovery: str, q: float = 0.1) -> DataFrame:
    """cost over (recovery's positive part + eps), eps the q-quantile of positive recoveries; its log."""
    eps = df.agg(F.expr(f"percentile(CASE WHEN {recovery} > 0 THEN {recovery} END, {q})").alias("_eps"))
    out = df.crossJoin(F.broadcast(eps))
    return out.withColumn("hazard", clip(cost, low=0.0) / (clip(recovery, low=0.0) + F.col("_eps"))).withColumn("log_hazard", F.log1p("hazard")).drop("_eps")


def signed_index(df: DataFrame, by: list[str], weights: dict[str, float], name: str = "index") -> DataFrame:
    """Weighted sum of group z-scores."""
    z = zscore(df, by, list(weights))
    return z.withColumn(name, sum(F.col(f"{c}_z") * w for c, w in weights.items())).drop(*(f"{c}_z" for c in weights))


def activity_memory(df: DataFrame, by: list[str], up: list[str], down: list[str], name: str = "activity") -> DataFrame:
    """Mean of min-max scaled columns, those in `down` inverted."""
    out = minmax(minmax(df, by, up, suffix="_mu"), by, down, invert=True, suffix="_md")
    cols = [*(f"{c}_mu" for c in up), *(f"{c}_md" for c in down)]
    return out.withColumn(name, sum(F.col(c) for c in cols) / len(cols)).drop(*cols)


def relative_to_first(df: DataFrame, by: list[str], order: str, col: str) -> DataFrame:
    first = F.first(col).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return df.withColumn(f"{col}_rel", F.when(first != 0, F.col(col) / first))


def triplet(df: DataFrame, by: list[str], cols: list[str]) -> DataFrame:
    """Norm of the group z-scores and the sum of their positive parts."""
    z = zscore(df, by, cols)
    out = z.withColumns({"z_norm": F.sqrt(sum(F.col(f"{c}_z") ** 2 for c in cols)), "z_positive": sum(clip(f"{c}_z", low=0.0) for c in cols)})
    return out.drop(*(f"{c}_z" for c in cols))


def cycle_modes(df: DataFrame, by: list[str], order: str, cold: str, hot: str) -> DataFrame:
    """Inhale |hot - cold|, exhale |next cold - hot|, closure ratio and the reservoir (running sum of the remainder)."""
    w = Window.partitionBy(*by).orderBy(order)
    out = df.withColumn("_next", F.lead(cold).over(w))
    out = out.withColumns({"inhale": F.abs(F.col(hot) - F.col(cold)), "exhale": F.abs(F.col("_next") - F.col(hot)), "_rest": F.col("_next") - F.col(cold)})
    out = out.withColumn("closure", F.when(F.col("inhale") > 0, F.col("exhale") / F.col("inhale")))
    return out.withColumn("reservoir", F.sum("_rest").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_next", "_rest")


def benchmark_error(df: DataFrame, by: list[str], model: str, reference: str) -> DataFrame:
    """RMSE, MAE and MAPE of a model column against a reference column; MAPE over non-zero references."""
    e = F.col(model) - F.col(reference)
    return df.groupBy(*by).agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.avg(F.when(F.col(reference) != 0, F.abs(e / F.col(reference)))).alias("mape"))


def wall_bins(df: DataFrame, by: list[str], z: str, force: str, height: float, bins: int, width: float = 1.0) -> DataFrame:
    """Contacts, force, greatest force and pressure in each height bin of a wall."""
    step = height / bins
    b = df.filter((F.col(z) >= 0) & (F.col(z) < height)).withColumn("bin", F.floor(F.col(z) / step).cast("int"))
    out = b.groupBy(*by, "bin").agg(F.count("*").alias("contacts"), F.sum(force).alias("force"), F.max(force).alias("max_force"))
    return out.withColumns({"z_mid": (F.col("bin") + 0.5) * step, "pressure": F.col("force") / (step * width)})
