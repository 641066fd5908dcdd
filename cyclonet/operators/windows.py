"""Per-group transformations along an order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import is_finite
from ..shared import materialize


def over(by: list[str]):
    return Window.partitionBy(*(by or [F.lit(0)]))


def with_stats(df: DataFrame, by: list[str], stats: dict[str, Column]) -> DataFrame:
    """Adds aggregates of each row's group: over a window, or, without groups, from one aggregated row joined to all."""
    if by:
        return df.withColumns({k: v.over(over(by)) for k, v in stats.items()})
    return df.crossJoin(F.broadcast(df.agg(*(v.alias(k) for k, v in stats.items()))))


def center(df: DataFrame, by: list[str], cols: list[str], suffix: str = "_wc", before: bool = True) -> DataFrame:
    """Adds col minus its group mean; with `before`, rows with a non-finite column are dropped first."""
    if before:
        df = df.filter(reduce(lambda a, b: a & b, map(is_finite, cols)))
    means = {f"_m_{c}": F.avg(c) for c in cols}
    return with_stats(df, by, means).withColumns({c + suffix: F.col(c) - F.col(f"_m_{c}") for c in cols}).drop(*means)


def zscore(df: DataFrame, by: list[str], cols: list[str], ddof: int = 0, suffix: str = "_z") -> DataFrame:
    """Group z-scores. ddof 0: population sd, a zero sd gives 0; ddof 1: sample sd, a zero or missing sd gives null."""
    stats = {f"_m_{c}": F.avg(c) for c in cols} | {f"_s_{c}": (F.stddev_pop if ddof == 0 else F.stddev_samp)(c) for c in cols}
    out = {}
    for c in cols:
        z = F.when(F.col(f"_s_{c}") > 0, (F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}"))
        out[c + suffix] = z.otherwise(0.0) if ddof == 0 else z
    return with_stats(df, by, stats).withColumns(out).drop(*stats)


def pooled_z(df: DataFrame, by: list[str], cols: list[str], suffix: str = "_pz") -> DataFrame:
    """z-scores with one mean and population sd pooled over several columns; sums are over non-null values."""
    n = sum(F.count(c) for c in cols) if not by else sum(F.count(c).over(over(by)) for c in cols)
    total = lambda v: F.coalesce(F.sum(v) if not by else F.sum(v).over(over(by)), F.lit(0.0))
    mean = sum(total(F.col(c)) for c in cols) / n
    df = df.withColumns({"_n": n, "_m": mean}) if by else df.crossJoin(F.broadcast(df.agg(n.alias("_n"), mean.alias("_m"))))
    var = sum(total((F.col(c) - F.col("_m")) ** 2) for c in cols)
    df = df.withColumn("_s", F.sqrt(var / F.col("_n"))) if by else df.crossJoin(F.broadcast(df.agg(var.alias("_v")))).withColumn("_s", F.sqrt(F.col("_v") / F.col("_n"))).drop("_v")
    return df.withColumns({c + suffix: F.when(F.col("_s") > 0, (F.col(c) - F.col("_m")) / F.col("_s")).otherwise(0.0) for c in cols}).drop("_n", "_m", "_s")


def robust_z(df: DataFrame, by: list[str], col: str, scale: str = "iqr", suffix: str = "_rz") -> DataFrame:
    """(x - median) / IQR (null if 0), or / (1.4826 MAD), which falls back to the sample sd."""
    if scale == "iqr":
        q = df.groupBy(*by).agg(F.expr(f"percentile({col}, array(0.25, 0.5, 0.75))").alias("_q"))
        iqr = F.get("_q", F.lit(2)) - F.get("_q", F.lit(0))
        return df.join(q, by).withColumn(col + suffix, F.when(iqr > 0, (F.col(col) - F.get("_q", F.lit(1))) / iqr)).drop("_q")
    m = df.groupBy(*by).agg(F.expr(f"percentile({col}, 0.5)").alias("_m"), F.stddev_samp(col).alias("_sd"))
    out = df.join(m, by).withColumn("_d", F.abs(F.col(col) - F.col("_m")))
    mad = out.groupBy(*by).agg(F.expr("percentile(_d, 0.5)").alias("_mad"))
    s = F.when(F.col("_mad") > 0, 1.4826 * F.col("_mad")).otherwise(F.col("_sd"))
    return out.join(mad, by).withColumn(col + suffix, F.when(s > 0, (F.col(col) - F.col("_m")) / s)).drop("_m", "_sd", "_d", "_mad")


def minmax(df: DataFrame, by: list[str], cols: list[str], invert: bool = False, suffix: str = "_mm") -> DataFrame:
    """Scaled to [0, 1] within the group, a constant to 0; optionally 1 minus that."""
    stats = {f"_lo_{c}": F.min(c) for c in cols} | {f"_hi_{c}": F.max(c) for c in cols}
    out = {}
    for c in cols:
        low, high = F.col(f"_lo_{c}"), F.col(f"_hi_{c}")
        v = F.when(high > low, (F.col(c) - low) / (high - low)).otherwise(0.0)
        out[c + suffix] = 1 - v if invert else v
    return with_stats(df, by, stats).withColumns(out).drop(*stats)


def average_rank(by: list[str], col: str) -> Column:
    """Rank within the group with ties averaged."""
    return F.rank().over(over(by).orderBy(col)) + (F.count("*").over(over([*by, col])) - 1) / 2


def running_counts(rows: DataFrame, order: list[str], amount: Column, name: str) -> DataFrame:
    """Adds the sum of amount over all rows before, in the order of the columns, without a window over the whole table:
    rows go to ranges, and each adds to its own running sum what the ranges before it hold (one row a range)."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialize(rows.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()))
    held = dealt.groupBy("_range").agg(F.sum(amount).alias("_held"))
    before = held.select("_range", F.coalesce(F.sum("_held").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = F.coalesce(F.sum(amount).over(Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return dealt.withColumn("_own", own).join(F.broadcast(before), "_range").withColumn(name, F.col("_own") + F.col("_before")).drop("_range", "_own", "_before")


def _global_rank(df: DataFrame, col: str, name: str) -> DataFrame:
    """Average rank over the whole table, from the counts of its distinct values."""
    values = running_counts(df.groupBy(F.col(col).alias("_v")).agg(F.count("*").alias("_c")), ["_v"], F.col("_c"), "_b")
    out = df.join(values, F.col(col).eqNullSafe(F.col("_v")), "left")
    return out.withColumn(name, F.col("_b") + (F.col("_c") + 1) / 2).drop("_v", "_c", "_b")


def rank_avg(df: DataFrame, by: list[str], col: str, name: str = "rank") -> DataFrame:
    return df.withColumn(name, average_rank(by, col)) if by else _global_rank(df, col, name)


def rank_pct(df: DataFrame, by: list[str], col: str, centred: bool = False, name: str = "pct") -> DataFrame:
    """Average rank over n; centred: (rank - 0.5) / n - 0.5."""
    ranked = with_stats(rank_avg(df, by, col, "_rank"), by, {"_size": F.count("*")})
    return ranked.withColumn(name, (F.col("_rank") - 0.5) / F.col("_size") - 0.5 if centred else F.col("_rank") / F.col("_size")).drop("_rank", "_size")


def equal_count(df: DataFrame, by: list[str], col: str, bins: int, ties: list[str], name: str = "code") -> DataFrame:
    """floor(rank / n * bins) of the 0-based rank, ties broken by the given columns."""
    if by:
        ranked = df.withColumn("_r", F.row_number().over(over(by).orderBy(col, *ties)) - 1)
    else:
        ranked = running_counts(df, [col, *ties], F.lit(1), "_r")
    ranked = with_stats(ranked, by, {"_size": F.count("*")})
    return ranked.withColumn(name, F.least(F.floor(F.col("_r") / F.col("_size") * bins), F.lit(bins - 1)).cast("int")).drop("_r", "_size")


def qcut(df: DataFrame, by: list[str], col: str, bins: int, name: str = "bin") -> DataFrame:
    """Bins by exact quantile edges, equal edges merged, right-closed, the least value in the first bin."""
    qs = ", ".join(str(i / bins) for i in range(bins + 1))
    edges = df.groupBy(*by).agg(F.array_distinct(F.expr(f"percentile({col}, array({qs}))")).alias("_e")) if by else df.agg(F.array_distinct(F.expr(f"percentile({col}, array({qs}))")).alias("_e"))
    out = df.join(edges, by) if by else df.crossJoin(F.broadcast(edges))
    inner = F.slice("_e", 2, F.greatest(F.size("_e") - 2, F.lit(0)))
    return out.withColumn(name, F.size(F.filter(inner, lambda e: e < F.col(col)))).drop("_e")


def lag_design(df: DataFrame, by: list[str], order: str, cols: list[str], lags: list[int]) -> DataFrame:
    """Adds <c>_lag<k> for every column and lag; rows that lack one are dropped."""
    w = Window.partitionBy(*by).orderBy(order)
    names = {f"{c}_lag{k}": F.lag(c, k).over(w) for c in cols for k in lags}
    return df.withColumns(names).dropna(subset=list(names))


def rolling(df: DataFrame, by: list[str], order: str, col: str, size: int = 3, least: int = 2) -> DataFrame:
    """Mean and sample sd of the previous `size` rows; null with fewer than `least` values."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(-size, -1)
    enough = F.count(col).over(w) >= least
    return df.withColumns({f"{col}_roll_mean": F.when(enough, F.avg(col).over(w)), f"{col}_roll_sd": F.when(enough, F.stddev_samp(col).over(w))})


def differences(df: DataFrame, by: list[str], order: str, col: str) -> DataFrame:
    """|x - previous| and (next - x) / x."""
    w = Window.partitionBy(*by).orderBy(order)
    return df.withColumns({f"{col}_absdiff": F.abs(F.col(col) - F.lag(col).over(w)), f"{col}_relnext": F.when(F.col(col) != 0, (F.lead(col).over(w) - F.col(col)) / F.col(col))})


def cumulative(df: DataFrame, by: list[str], order: str, col: str) -> DataFrame:
    """Running sum and its share of the group's total."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum(col).over(over(by))
    return df.withColumn(f"{col}_cum", F.sum(col).over(w)).withColumn(f"{col}_cum_share", F.when(total != 0, F.col(f"{col}_cum") / total))


def writing_time(df: DataFrame, by: list[str], order: str, col: str) -> DataFrame:
    """First order key where |running sum| reaches half of |total|, and the first from which its sign stays the total's."""
    c = cumulative(df, by, order, col)
    total = F.sum(col).over(over(by))
    c = c.withColumn("_t", total)
    wrong = F.max(F.when(F.signum(f"{col}_cum") != F.signum("_t"), F.col(order)))
    out = c.groupBy(*by).agg(F.min(F.when(F.abs(f"{col}_cum") >= 0.5 * F.abs("_t"), F.col(order))).alias("half_at"), wrong.alias("_w"))
    later = c.join(out.select(*by, "_w"), by).filter(F.col("_w").isNull() | (F.col(order) > F.col("_w"))).groupBy(*by).agg(F.min(order).alias("stable_at"))
    return out.drop("_w").join(later, by, "left")


def fill(df: DataFrame, by: list[str], order: str, col: str) -> DataFrame:
    """Forward, then backward fill of nulls."""
    w = Window.partitionBy(*by).orderBy(order)
    ahead = F.last(col, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    back = F.first(col, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return df.withColumn(f"{col}_filled", F.coalesce(ahead, back))


def rare_flag(df: DataFrame, by: list[str], col: str, q: float = 0.8, name: str = "rare") -> DataFrame:
    """Rows at or above the group's exact quantile."""
    cut = df.groupBy(*by).agg(F.expr(f"percentile({col}, {q})").alias("_q"))
    return df.join(cut, by).withColumn(name, (F.col(col) >= F.col("_q")).cast("int")).drop("_q")


def first_per_group(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter("_n = 1").drop("_n")


def curve_area(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Trapezoid area of y over x; null with fewer than two points."""
    w = Window.partitionBy(*by).orderBy(x)
    part = (F.col(x) - F.lag(x).over(w)) * (F.col(y) + F.lag(y).over(w)) / 2
    return df.withColumn("_a", part).groupBy(*by).agg(F.sum("_a").alias("area"))


def local_slope(df: DataFrame, by: list[str], axis: str, col: str) -> DataFrame:
    """Derivative along one axis with the others fixed: central inside, one-sided at the ends."""
    w = Window.partitionBy(*by).orderBy(axis)
    hi, lo = F.coalesce(F.lead(col).over(w), F.col(col)), F.coalesce(F.lag(col).over(w), F.col(col))
    xh, xl = F.coalesce(F.lead(axis).over(w), F.col(axis)), F.coalesce(F.lag(axis).over(w), F.col(axis))
    return df.withColumn("slope", F.when(xh > xl, (hi - lo) / (xh - xl)))


def topk_score(df: DataFrame, weights: dict[str, float], k: int, ties: list[str], name: str = "score") -> DataFrame:
    """The k rows of greatest weighted score, ranked."""
    scored = df.withColumn(name, sum(F.col(c) * w for c, w in weights.items()))
    top = scored.orderBy(F.col(name).desc(), *ties).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.col(name).desc(), *ties)))


def novelty(df: DataFrame, selected: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """Least and mean Euclidean distance of each row to a small selected set, in the given (scaled) columns."""
    side = selected.select(F.col(key).alias("_k"), *(F.col(c).alias(f"_{c}") for c in cols))
    d = F.sqrt(sum((F.col(c) - F.col(f"_{c}")) ** 2 for c in cols))
    return df.join(side, F.col(key) != F.col("_k")).groupBy(key).agg(F.min(d).alias("min_distance"), F.avg(d).alias("mean_distance"))


def pareto(df: DataFrame, by: list[str], cost: str, benefit: str) -> DataFrame:
    """Adds front (no row has more benefit at no more cost, or as much at less) and the deficit to the best such benefit."""
    w = Window.partitionBy(*by).orderBy(cost)
    best = F.max(benefit).over(w.rangeBetween(Window.unboundedPreceding, 0))
    out = df.withColumn("_best", best)
    # The best benefit at strictly less cost: that of the row before the first peer.
    steps = out.groupBy(*by, cost).agg(F.max("_best").alias("_b"))
    steps = steps.withColumn("_less", F.lag("_b").over(w)).select(*by, cost, "_less")
    out = out.join(steps, [*by, cost])
    front = (F.col(benefit) >= F.col("_best")) & (F.col("_less").isNull() | (F.col(benefit) > F.col("_less")))
    return out.withColumns({"front": front, "deficit": F.col("_best") - F.col(benefit)}).drop("_best", "_less")
