"""Correlations, slopes and small fits over grouped panels."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import is_finite
from ..functions.special import chi2_p, correlation_p
from .slopes import median_slope
from .windows import average_rank, center


def _moments(df: DataFrame, by: list[str], x: str, y: str, least: int) -> DataFrame:
    out = df.groupBy(*by).agg(F.count("*").alias("n"), F.covar_pop(x, y).alias("_c"), F.var_pop(x).alias("_vx"), F.var_pop(y).alias("_vy"))
    enough = (F.col("n") >= least) & (F.col("_vx") > 0) & (F.col("_vy") > 0)
    return out.select(*by, "n", F.when(enough, F.col("_c") / (F.sqrt("_vx") * F.sqrt("_vy"))).alias("r"))


def with_p(correlations: DataFrame, value: str = "rho", n: str = "n") -> DataFrame:
    """Correlation rows with p, two-sided by Student's t; one vectorised call over result rows, none over the data."""
    return correlations.withColumn("p", correlation_p(F.col(value), F.col(n)))


def pearson(df: DataFrame, by: list[str], x: str, y: str, least: int = 3, group: list[str] | None = None) -> DataFrame:
    """n and r for each key over rows finite in both; with `group`, both are centred on the group's mean first.

    Too few rows or no variance: null.
    """
    d = df.select(*dict.fromkeys([*by, *(group or [])]), F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).filter(is_finite("_x") & is_finite("_y"))
    if group:
        d = center(d, [*by, *group], ["_x", "_y"], suffix="", before=False)
    return _moments(d, by, "_x", "_y", least)


def spearman(df: DataFrame, by: list[str], x: str, y: str, least: int = 3, group: list[str] | None = None) -> DataFrame:
    """As pearson, on average ranks within each key."""
    d = df.select(*dict.fromkeys([*by, *(group or [])]), F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).filter(is_finite("_x") & is_finite("_y"))
    if group:
        d = center(d, [*by, *group], ["_x", "_y"], suffix="", before=False)
        # Centring leaves rounding in values that are equal; ranks must not see it.
        d = d.withColumns({"_x": F.round("_x", 9), "_y": F.round("_y", 9)})
    d = d.withColumns({"_rx": average_rank(by, "_x"), "_ry": average_rank(by, "_y")})
    return _moments(d, by, "_rx", "_ry", least).withColumnRenamed("r", "rho")


def pair_table(df: DataFrame, predictors: list[str], targets: list[str], group: list[str], least: int = 4) -> DataFrame:
    """predictor, target, n, rho, r: group-centred correlations of the whole grid in one job."""
    cells = F.array(*(F.struct(F.lit(p).alias("predictor"), F.lit(t).alias("target"), F.col(p).cast("double").alias("x"), F.col(t).cast("double").alias("y")) for p in predictors for t in targets))
    long = df.select(*group, F.inline(cells))
    by = ["predictor", "target"]
    return spearman(long, by, "x", "y", least, group).join(pearson(long, by, "x", "y", least, group).drop("n"), by)


def group_profile(df: DataFrame, group: list[str], x: str, y: str, least: int = 4) -> DataFrame:
    """Mean, min, max and mean absolute value of the groups' own Spearman correlations."""
    per = spearman(df, group, x, y, least)
    return per.agg(F.count("rho").alias("groups"), F.avg("rho").alias("mean_rho"), F.min("rho").alias("min_rho"), F.max("rho").alias("max_rho"), F.avg(F.abs("rho")).alias("mean_abs_rho"))


def leave_one_out(df: DataFrame, group: str, x: str, y: str, least: int = 4) -> DataFrame:
    """Centred Spearman with each group left out in turn."""
    groups = df.select(F.col(group).alias("left_out")).distinct()
    rest = df.join(groups, F.col(group) != F.col("left_out"))
    return spearman(rest, ["left_out"], x, y, least, [group])


def lag_scan(df: DataFrame, by: list[str], order: str, x: str, y: str, lags: list[int], least: int = 6) -> DataFrame:
    """Group-centred Spearman of y with x at each lag, by position."""
    from .frames import lag_join

    return spearman(lag_join(df, by, order, x, y, lags, "position"), ["lag"], "x", "y", least, by)


def autocorrelation(df: DataFrame, by: list[str], order: str, col: str, lags: list[int], least: int = 4) -> DataFrame:
    """Pearson correlation of the column with itself at each lag, per group."""
    from .frames import lag_join

    return pearson(lag_join(df, by, order, col, col, lags, "position"), [*by, "lag"], "x", "y", least)


def theil_sen(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """slope: the median of the slopes between all rows of a group that differ in x, and pairs, how many there are.

    Slopes are not listed: those up to a value are the inversions of the rows by y - value x, so the median is found by
    counting, in memory linear in the group's rows and in n log n time a count. A group is one task. Rows that are not
    finite in both do not count; a group without two different x has a null slope. Exact; where more than CANDIDATES
    slopes a row lie between two neighbouring doubles, to the last place.
    """
    d = df.select(*by, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    d = d.withColumns({c: F.when(is_finite("_x") & is_finite("_y"), F.col(c)) for c in ("_x", "_y")})
    types = ", ".join(f"`{b}` {d.schema[b].dataType.simpleString()}" for b in by)

    def run(f: pd.DataFrame) -> pd.DataFrame:
        some = f.dropna(subset=["_x", "_y"])
        slope, pairs = median_slope(some["_x"].to_numpy(float), some["_y"].to_numpy(float))
        return f[by].head(1).assign(slope=slope, pairs=pairs)

    return d.groupBy(*by).applyInPandas(run, f"{types}, slope double, pairs long").withColumn("slope", F.when(~F.isnan("slope"), F.col("slope")))


def group_ols(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """n, slope, intercept, r2 of a line per group; null without variance in x."""
    d = df.filter(is_finite(x) & is_finite(y))
    out = d.groupBy(*by).agg(F.count("*").alias("n"), F.avg(x).alias("_mx"), F.avg(y).alias("_my"), F.covar_pop(x, y).alias("_c"), F.var_pop(x).alias("_vx"), F.var_pop(y).alias("_vy"))
    slope = F.when(F.col("_vx") > 0, F.col("_c") / F.col("_vx"))
    r2 = F.when((F.col("_vx") > 0) & (F.col("_vy") > 0), F.col("_c") ** 2 / (F.col("_vx") * F.col("_vy")))
    return out.select(*by, "n", slope.alias("slope"), (F.col("_my") - slope * F.col("_mx")).alias("intercept"), r2.alias("r2"))


def log_decay(df: DataFrame, by: list[str], order: str, col: str) -> DataFrame:
    """Slope of ln(col) over the order on positive rows, and the half-life where it decays."""
    d = df.filter(F.col(col) > 0).withColumn("_ly", F.ln(col))
    out = group_ols(d, by, order, "_ly").select(*by, "n", "slope")
    return out.withColumn("half_life", F.when(F.col("slope") < 0, math.log(2) / -F.col("slope")))


def gram(df: DataFrame, by: list[str], features: list[str], target: str) -> DataFrame:
    """Sufficient statistics of a linear model per key: the upper triangle of [1, X, y]' [1, X, y], one shuffle.

    The features should be centred beforehand where their mean is large against their spread.
    """
    cols = [F.lit(1.0), *(F.col(c).cast("double") for c in features), F.col(target).cast("double")]
    d = df.filter(reduce(lambda a, b: a & b, [is_finite(c) for c in [*features, target]]))
    return d.groupBy(*by).agg(*(F.sum(cols[i] * cols[j]).alias(f"g_{i}_{j}") for i in range(len(cols)) for j in range(i, len(cols))))


def gram_matrix(row, size: int) -> np.ndarray:
    g = np.zeros((size, size))
    for i in range(size):
        for j in range(i, size):
            g[i, j] = g[j, i] = row[f"g_{i}_{j}"]
    return g


def solve_gram(g: np.ndarray, ridge: float = 0.0) -> np.ndarray:
    """Coefficients, the intercept first; the intercept is not penalised."""
    a = g[:-1, :-1].copy()
    a[np.arange(1, len(a)), np.arange(1, len(a))] += ridge
    return np.linalg.lstsq(a, g[:-1, -1], rcond=None)[0]


def r2_of(g: np.ndarray, w: np.ndarray) -> float:
    n, s, q = g[0, 0], g[0, -1], g[-1, -1]
    total = q - s * s / n
    rest = q - 2 * w @ g[:-1, -1] + w @ g[:-1, :-1] @ w
    return float(1 - rest / total) if total > 1e-300 else float("nan")


def ols_r2(df: DataFrame, by: list[str], features: list[str], target: str, group: list[str] | None = None) -> DataFrame:
    """n and R2 of a multi-feature linear model per key; `group` effects enter by centring."""
    d = center(df, [*by, *group], [*features, target], suffix="", before=True) if group else df
    size = len(features) + 2

    def fit(frames):
        for f in frames:
            gs = [gram_matrix(r, size) for _, r in f.iterrows()]
            f = f[by].assign(n=[int(g[0, 0]) for g in gs], r2=[r2_of(g, solve_gram(g)) for g in gs])
            yield f

    stats = gram(d, by, features, target)
    types = ", ".join(f"{b} {stats.schema[b].dataType.simpleString()}" for b in by)
    return stats.mapInPandas(fit, f"{types + ', ' if by else ''}n long, r2 double")


def partial_spearman(df: DataFrame, group: list[str], x: str, y: str, controls: list[str], least: int = 4) -> DataFrame:
    """Spearman of the residuals of x and y after the controls, all centred on the group's mean."""
    d = center(df, group, [x, y, *controls], suffix="", before=True)
    fits = [gram(d, [], controls, t).first() for t in (x, y)]  # one row each
    size = len(controls) + 2
    for t, row in zip((x, y), fits, strict=True):
        w = solve_gram(gram_matrix(row, size))
        d = d.withColumn(f"_res_{t}", F.col(t) - float(w[0]) - sum(F.col(c) * float(k) for c, k in zip(controls, w[1:], strict=True)))
    d = d.withColumns({f"_res_{t}": F.round(f"_res_{t}", 9) for t in (x, y)})
    return spearman(d.withColumn("_one", F.lit(1)), ["_one"], f"_res_{x}", f"_res_{y}", least).drop("_one")


def mediation(df: DataFrame, x: str, mediator: str, y: str) -> DataFrame:
    """a (x to mediator), b and direct (mediator and x to y), total (x to y), indirect a b, in closed form from moments."""
    d = df.filter(reduce(lambda p, q: p & q, [is_finite(c) for c in (x, mediator, y)]))
    c = {f"{i}{j}": F.covar_pop(a, b) for i, a in (("x", x), ("m", mediator), ("y", y)) for j, b in (("x", x), ("m", mediator), ("y", y))}
    out = d.agg(F.count("*").alias("n"), *(v.alias(k) for k, v in c.items() if k in ("xx", "mm", "xm", "xy", "my")))
    det = F.col("xx") * F.col("mm") - F.col("xm") ** 2
    a = F.col("xm") / F.col("xx")
    b = (F.col("xx") * F.col("my") - F.col("xm") * F.col("xy")) / det
    direct = (F.col("mm") * F.col("xy") - F.col("xm") * F.col("my")) / det
    return out.select("n", a.alias("a"), b.alias("b"), direct.alias("direct"), (F.col("xy") / F.col("xx")).alias("total"), (a * b).alias("indirect"))


def threshold(df: DataFrame, score: str, label: str) -> DataFrame:
    """The cut of best balanced accuracy (score >= cut is positive) over midpoints of neighbouring distinct scores.

    Counts of each distinct score run over one window per table; the lowest such cut wins ties.
    """
    counts = df.filter(is_finite(score)).groupBy(F.col(score).alias("s")).agg(F.sum(F.col(label).cast("long")).alias("p"), F.sum(1 - F.col(label).cast("long")).alias("q"))
    w = Window.orderBy("s")
    tot = counts.agg(F.sum("p").alias("tp"), F.sum("q").alias("tq"))
    below = w.rowsBetween(Window.unboundedPreceding, -1)
    c = counts.withColumns({"lp": F.sum("p").over(below), "lq": F.sum("q").over(below), "prev": F.lag("s").over(w)}).filter("prev IS NOT NULL").crossJoin(F.broadcast(tot))
    c = c.withColumns({"cut": (F.col("s") + F.col("prev")) / 2, "sensitivity": 1 - F.col("lp") / F.col("tp"), "specificity": F.col("lq") / F.col("tq")})
    c = c.withColumn("balanced", (F.col("sensitivity") + F.col("specificity")) / 2)
    best = c.agg(F.min(F.struct((-F.round("balanced", 12)).alias("b"), "cut", "sensitivity", "specificity")).alias("m"))
    return best.select(F.col("m.cut").alias("cut"), F.col("m.sensitivity").alias("sensitivity"), F.col("m.specificity").alias("specificity"), (-F.col("m.b")).alias("balanced_accuracy"))


def chi2(df: DataFrame, a: str, b: str) -> DataFrame:
    """Chi-square statistic, degrees of freedom and p of a contingency table.

    The sum of o * o / e less the total: cells that do not occur add nothing to it, so no table of all pairs is made.
    """
    n = df.groupBy(a, b).agg(F.count("*").alias("o"))
    ra, rb = n.groupBy(a).agg(F.sum("o").alias("ra")), n.groupBy(b).agg(F.sum("o").alias("rb"))
    cells = n.join(ra, a).join(rb, b)
    out = cells.agg(F.sum("o").alias("t"), F.sum(F.col("o") * F.col("o") / (F.col("ra") * F.col("rb"))).alias("s"), F.countDistinct(a).alias("na"), F.countDistinct(b).alias("nb"))
    out = out.select((F.col("t") * F.col("s") - F.col("t")).alias("chi2"), ((F.col("na") - 1) * (F.col("nb") - 1)).alias("dof"))
    return out.withColumn("p", chi2_p(F.col("chi2"), F.col("dof")))


def shapley_r2(df: DataFrame, features: list[str], target: str, group: list[str] | None = None) -> DataFrame:
    """Each feature's Shapley share of R2 over all subsets; one pass over the data gives the Gram matrix of all."""
    d = center(df, group, [*features, target], suffix="", before=True) if group else df
    k = len(features)

    def share(frames):
        for f in frames:
            g = gram_matrix(f.iloc[0], k + 2)

            def r2(s: tuple[int, ...]) -> float:
                if not s:
                    return 0.0
                at = [0, *(i + 1 for i in s), k + 1]
                sub = g[np.ix_(at, at)]
                return r2_of(sub, solve_gram(sub))

            worth = {m: r2(tuple(i for i in range(k) if m >> i & 1)) for m in range(1 << k)}
            out = []
            for i in range(k):
                total = 0.0
                for m in range(1 << k):
                    if not m >> i & 1:
                        size = m.bit_count()
                        total += math.factorial(size) * math.factorial(k - size - 1) / math.factorial(k) * (worth[m | 1 << i] - worth[m])
                out.append(total)
            yield pd.DataFrame({"feature": features, "share": out, "r2": worth[(1 << k) - 1]})

    return gram(d, [], features, target).mapInPandas(share, "feature string, share double, r2 double")
