"""Grouped summaries of one table."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def group_summary(df: DataFrame, by: list[str], cols: list[str], flags: list[str] = ()) -> DataFrame:
    """n, and mean, sample sd, min, max of each column; the share of true for flags."""
    agg = [F.count("*").alias("n")]
    for c in cols:
        agg += [F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_sd"), F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max")]
    agg += [F.avg(F.col(c).cast("double")).alias(f"{c}_share") for c in flags]
    return df.groupBy(*by).agg(*agg)


def mode(df: DataFrame, by: list[str], col: str) -> DataFrame:
    """The most frequent value of each group, the smallest on ties."""
    counts = df.filter(F.col(col).isNotNull()).groupBy(*by, col).agg(F.count("*").alias("_n"))
    return counts.groupBy(*by).agg(F.min(F.struct((-F.col("_n")).alias("n"), F.col(col).alias("v"))).alias("_m")).select(*by, F.col("_m.v").alias(col), (-F.col("_m.n")).alias("n"))


def gini(df: DataFrame, by: list[str], col: str) -> DataFrame:
    """Gini coefficient of non-negative values; null for a zero sum."""
    w = Window.partitionBy(*by).orderBy(col)
    r = df.select(*by, F.col(col).cast("double").alias("_x"), F.row_number().over(w).alias("_i"))
    out = r.groupBy(*by).agg(F.sum(F.col("_i") * F.col("_x")).alias("_s"), F.sum("_x").alias("_t"), F.count("*").alias("_n"))
    return out.select(*by, F.when(F.col("_t") > 0, 2 * F.col("_s") / (F.col("_n") * F.col("_t")) - (F.col("_n") + 1) / F.col("_n")).alias("gini"))


def top_share(df: DataFrame, by: list[str], col: str, p: float) -> DataFrame:
    """Share of the sum that the top ceil(n p) values hold, one at least."""
    w = Window.partitionBy(*by).orderBy(F.col(col).desc())
    r = df.select(*by, F.col(col).alias("_x"), F.row_number().over(w).alias("_i"), F.count("*").over(Window.partitionBy(*by)).alias("_n"))
    top = F.sum(F.when(F.col("_i") <= F.greatest(F.lit(1), F.ceil(F.col("_n") * F.lit(p))), F.col("_x")).otherwise(0.0))
    return r.groupBy(*by).agg((top / F.sum("_x")).alias("share"))


def tail(df: DataFrame, by: list[str], col: str, qs: tuple[float, ...] = (0.9, 0.95, 0.99), error: float | None = None) -> DataFrame:
    """Mean, quantiles, maximum and the quantiles' ratios to the mean; approximate says which quantiles they are.

    Exact ones hold a group's distinct values in one buffer. With `error` they come from a mergeable sketch of bounded size:
    a value of the group whose rank is off by at most error x rows, so 1e-5 tells the 99.9 % quantile to a hundredth of its
    tail.
    """
    names = {q: "p" + f"{100 * q:g}".replace(".", "_") for q in qs}
    one = lambda q: F.expr(f"percentile({col}, {q})") if error is None else F.percentile_approx(col, q, max(1, round(1 / error)))
    out = df.groupBy(*by).agg(F.avg(col).alias("mean"), F.max(col).alias("max"), *(one(q).alias(n) for q, n in names.items()))
    return out.withColumns({f"{n}_over_mean": F.col(n) / F.col("mean") for n in names.values()} | {"approximate": F.lit(error is not None)})


def fabric(df: DataFrame, by: list[str], weight: str | None = None) -> DataFrame:
    """(Weighted) mean of n_i n_j, the spread of its eigenvalues, vertical bias (zz - 1/3) and mean abs_nz.

    Eigenvalues of the symmetric 3 x 3 tensor in closed form.
    """
    w = F.col(weight) if weight else F.lit(1.0)
    pairs = [(a, b) for i, a in enumerate("xyz") for b in "xyz"[i:]]
    total = F.sum(w)
    out = df.groupBy(*by).agg(*((F.sum(w * F.col(f"n{a}") * F.col(f"n{b}")) / total).alias(f"f_{a}{b}") for a, b in pairs), (F.sum(w * F.abs("nz")) / total).alias("abs_nz"))
    q = (F.col("f_xx") + F.col("f_yy") + F.col("f_zz")) / 3
    p1 = F.col("f_xy") ** 2 + F.col("f_xz") ** 2 + F.col("f_yz") ** 2
    p2 = (F.col("f_xx") - q) ** 2 + (F.col("f_yy") - q) ** 2 + (F.col("f_zz") - q) ** 2 + 2 * p1
    out = out.withColumns({"_q": q, "_p": F.sqrt(p2 / 6)})
    b = {f"{a}{c}": (F.col(f"f_{a}{c}") - (F.col("_q") if a == c else 0)) / F.when(F.col("_p") > 0, F.col("_p")).otherwise(1.0) for a, c in pairs}
    det = b["xx"] * (b["yy"] * b["zz"] - b["yz"] ** 2) - b["xy"] * (b["xy"] * b["zz"] - b["yz"] * b["xz"]) + b["xz"] * (b["xy"] * b["yz"] - b["yy"] * b["xz"])
    out = out.withColumn("_phi", F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), det / 2))) / 3)
    high, low = F.col("_q") + 2 * F.col("_p") * F.cos("_phi"), F.col("_q") + 2 * F.col("_p") * F.cos(F.col("_phi") + 2 * math.pi / 3)
    return out.withColumns({"eigen_spread": high - low, "vertical_bias": F.col("f_zz") - 1 / 3}).drop("_q", "_p", "_phi")


def orientation_histogram(df: DataFrame, by: list[str], theta: str = "theta", force: str = "force", width: float = 10.0, top: float = 90.0) -> DataFrame:
    """Left-closed bins of the angle: share of contacts and of force; angles at the upper end are dropped."""
    binned = df.filter((F.col(theta) >= 0) & (F.col(theta) < top)).withColumn("bin_left", F.floor(F.col(theta) / width) * width)
    w = Window.partitionBy(*by)
    out = binned.groupBy(*by, "bin_left").agg(F.count("*").alias("_n"), F.sum(force).alias("_f"))
    return out.select(*by, "bin_left", (F.col("_n") / F.sum("_n").over(w)).alias("count_fraction"), (F.col("_f") / F.sum("_f").over(w)).alias("force_fraction"))


def entropy(df: DataFrame, by: list[str], bin_col: str, weight: str | None = None, bins: int | None = None) -> DataFrame:
    """Entropy of the (weighted) histogram in nats, divided by ln(bins) if bins is given."""
    w = F.sum(weight) if weight else F.count("*")
    h = df.groupBy(*by, bin_col).agg(w.cast("double").alias("_w")).filter("_w > 0")
    p = F.col("_w") / F.sum("_w").over(Window.partitionBy(*by))
    out = h.withColumn("_p", p).groupBy(*by).agg((-F.sum(F.col("_p") * F.ln("_p"))).alias("entropy"))
    return out.withColumn("entropy", F.col("entropy") / math.log(bins)) if bins and bins > 1 else out


def weighted_mean(df: DataFrame, by: list[str], col: str, weight: str) -> DataFrame:
    """sum(w x) / sum(w); null where the weights sum to 0."""
    s = F.sum(weight)
    return df.groupBy(*by).agg(F.when(s != 0, F.sum(F.col(col) * F.col(weight)) / s).alias("weighted_mean"))


def cv(df: DataFrame, by: list[str], col: str) -> DataFrame:
    """Sample sd over mean; null for a zero mean."""
    m = F.avg(col)
    return df.groupBy(*by).agg(F.when(m != 0, F.stddev_samp(col) / m).alias("cv"))


def median_reference(df: DataFrame, by: list[str], col: str, ref: str) -> DataFrame:
    """Adds <col>_rel: col over the group's median of ref."""
    m = df.groupBy(*by).agg(F.expr(f"percentile({ref}, 0.5)").alias("_m"))
    return df.join(m, by).withColumn(f"{col}_rel", F.when(F.col("_m") != 0, F.col(col) / F.col("_m"))).drop("_m")


def first_last_ratio(df: DataFrame, by: list[str], order: str, col: str) -> DataFrame:
    """Last value over the first by the order; null if the first is 0."""
    first, last = F.min_by(col, order), F.max_by(col, order)
    return df.groupBy(*by).agg(first.alias("first"), last.alias("last"), F.when(first != 0, last / first).alias("ratio"))


def peak(df: DataFrame, by: list[str], order: str, col: str) -> DataFrame:
    """Order key of the greatest value (the earliest on ties) and the value."""
    best = F.min(F.struct((-F.col(col)).alias("v"), F.col(order).alias("o")))
    return df.groupBy(*by).agg(best.alias("_b")).select(*by, F.col("_b.o").alias("peak_at"), (-F.col("_b.v")).alias("peak"))


def early_late(df: DataFrame, by: list[str], order: str, cols: list[str], early: float = 5, late: float = 26) -> DataFrame:
    """Means up to `early` and from `late` on, and their difference."""
    agg = []
    for c in cols:
        a, b = F.avg(F.when(F.col(order) <= early, F.col(c))), F.avg(F.when(F.col(order) >= late, F.col(c)))
        agg += [a.alias(f"{c}_early"), b.alias(f"{c}_late"), (b - a).alias(f"{c}_change")]
    return df.groupBy(*by).agg(*agg)


def completeness(states: DataFrame, by: list[str], order: str, phase: str, expected: int) -> DataFrame:
    """States seen, pairs with both phases, and whether all expected states are there."""
    per = states.groupBy(*by, order).agg(F.countDistinct(phase).alias("_p"))
    out = per.groupBy(*by).agg(F.sum("_p").alias("states"), F.sum((F.col("_p") >= 2).cast("long")).alias("pairs"))
    return out.withColumn("complete", F.col("states") >= expected)


def fold_change(df: DataFrame, by: list[str], order: str, col: str, first: int, last: int) -> DataFrame:
    """Percent change of a column between two cycles; null without either or from 0."""
    at = lambda k: F.max(F.when(F.col(order) == k, F.col(col)))
    return df.groupBy(*by).agg(F.when(at(first) != 0, 100 * (at(last) - at(first)) / at(first)).alias("percent"))
