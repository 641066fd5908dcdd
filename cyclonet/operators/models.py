"""Leave-one-group-out and forward-in-time models from sufficient statistics: one aggregation, no refit over the data."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import is_finite
from ..shared import materialize
from .statistics import gram, gram_matrix, r2_of, solve_gram


def _score(train: np.ndarray, test: np.ndarray, ridge: float, baseline: str) -> tuple[float, np.ndarray]:
    w = solve_gram(train, ridge)
    rest = test[-1, -1] - 2 * w @ test[:-1, -1] + w @ test[:-1, :-1] @ w
    mean = train[0, -1] / train[0, 0] if baseline == "train" else test[0, -1] / test[0, 0]
    total = test[-1, -1] - 2 * mean * test[0, -1] + mean * mean * test[0, 0]
    return (float(1 - rest / total) if total > 1e-300 else float("nan")), w


def logo_linear(df: DataFrame, group: str, features: list[str], target: str, ridge: float = 0.0, baseline: str = "train") -> DataFrame:
    """Per held-out group: n, R2 against the training (or held-out) mean, and the coefficients.

    Each group's Gram matrix is summed once; a fold's training matrix is the total, one row broadcast to all, less its own.
    """
    size = len(features) + 2
    stats = gram(df, [group], features, target)
    kind = stats.schema[group].dataType.simpleString()
    names = ["intercept", *features]
    cells = [c for c in stats.columns if c != group]
    total = stats.agg(F.count("*").alias("_groups"), *(F.sum(c).alias(f"_t_{c}") for c in cells))

    def folds(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for _, r in f.iterrows():
                g, every = gram_matrix(r, size), gram_matrix({c: r[f"_t_{c}"] for c in cells}, size)
                r2, w = _score(every - g, g, ridge, baseline) if r["_groups"] > 1 else (float("nan"), np.full(size - 1, np.nan))
                out.append({group: r[group], "n": int(g[0, 0]), "r2": r2} | {f"coef_{c}": v for c, v in zip(names, w, strict=True)})
            yield pd.DataFrame(out, columns=[group, "n", "r2", *(f"coef_{c}" for c in names)])

    schema = f"{group} {kind}, n long, r2 double, " + ", ".join(f"coef_{c} double" for c in names)
    return stats.crossJoin(F.broadcast(total)).mapInPandas(folds, schema)


def predict_linear(df: DataFrame, coefficients: DataFrame, group: str, features: list[str]) -> DataFrame:
    """Adds the held-out prediction of each row's own fold."""
    c = coefficients.select(group, *(f"coef_{x}" for x in ["intercept", *features]))
    out = df.join(c, group)
    return out.withColumn("predicted", F.col("coef_intercept") + sum(F.col(f"coef_{x}") * F.col(x) for x in features)).drop(*(x for x in c.columns if x != group))


def pooled_r2(predictions: DataFrame, observed: str, predicted: str = "predicted", by: list[str] = ()) -> DataFrame:
    """R2 and RMSE of predictions against the observed mean, pooled or per key."""
    e = (F.col(observed) - F.col(predicted)) ** 2
    return predictions.groupBy(*by).agg(F.count("*").alias("n"), F.when(F.var_pop(observed) > 0, 1 - F.avg(e) / F.var_pop(observed)).alias("r2"), F.sqrt(F.avg(e)).alias("rmse"))


def forward_linear(df: DataFrame, by: list[str], order: str, features: list[str], target: str, split: float, ridge: float = 0.0, least: int = 4) -> DataFrame:
    """Per group: fitted up to the split, scored after it; groups with too few rows on either side are left out."""
    size = len(features) + 2
    d = df.withColumn("_late", (F.col(order) > split).cast("int"))
    stats = gram(d, [*by, "_late"], features, target)
    types = ", ".join(f"{b} {stats.schema[b].dataType.simpleString()}" for b in by)

    def fit(f: pd.DataFrame) -> pd.DataFrame:
        parts = {int(r["_late"]): gram_matrix(r, size) for _, r in f.iterrows()}
        cols = [*by, "n_train", "n_test", "r2"]
        if set(parts) != {0, 1} or parts[0][0, 0] < max(least, size) or parts[1][0, 0] < 2:
            return pd.DataFrame(columns=cols)
        r2, _ = _score(parts[0], parts[1], ridge, "train")
        return pd.DataFrame([{b: f[b].iloc[0] for b in by} | {"n_train": int(parts[0][0, 0]), "n_test": int(parts[1][0, 0]), "r2": r2}])[cols]

    return stats.groupBy(*by).applyInPandas(fit, f"{types}, n_train long, n_test long, r2 double")


def forward_ridge(df: DataFrame, by: list[str], order: str, features: list[str], target: str, split: float, strengths: tuple[float, ...] = (0.01, 0.1, 1.0, 10.0, 100.0), least: int = 5) -> DataFrame:
    """Per group: ridge regression on the rows up to the split, scored after it by R2 against the early mean.

    The strength is the one of least leave-one-row-out error on the early rows (the first of equal ones) for features of
    unit variance there. Fits and leverages of all strengths come from a group's early Gram matrix; the early rows then
    meet their own group's, and their errors are summed. Groups with fewer than `least` rows on a side are left out.
    """
    size, width = len(features) + 2, len(features) + 1
    finite = reduce(lambda a, b: a & b, [is_finite(c) for c in [*features, target]])
    d = df.filter(finite).select(*by, F.col(order).alias("_t"), *(F.col(c).cast("double").alias(c) for c in [*features, target])).withColumn("_late", (F.col("_t") > split).cast("int"))
    stats = materialize(gram(d, [*by, "_late"], features, target))
    types = ", ".join(f"{b} {stats.schema[b].dataType.simpleString()}" for b in by)

    def cases(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for _, r in f.iterrows():
                g = gram_matrix(r, size)
                spread = [max(g[i, i] / g[0, 0] - (g[0, i] / g[0, 0]) ** 2, 0.0) for i in range(1, width)]
                for k, a in enumerate(strengths):
                    inverse = np.linalg.pinv(g[:-1, :-1] + a * np.diag([0.0, *spread]))
                    out.append({b: r[b] for b in by} | {"_k": k, "_w": (inverse @ g[:-1, -1]).tolist(), "_m": inverse.ravel().tolist()})
            yield pd.DataFrame(out, columns=[*by, "_k", "_w", "_m"])

    fitted = materialize(stats.filter("_late = 0").mapInPandas(cases, f"{types}, _k int, _w array<double>, _m array<double>"))
    x = F.array(F.lit(1.0), *features)
    guess = F.aggregate(F.zip_with("_w", "_x", lambda w, v: w * v), F.lit(0.0), lambda t, v: t + v)
    across = F.flatten(F.transform("_x", lambda u: F.transform("_x", lambda v: u * v)))
    lever = F.aggregate(F.zip_with("_m", across, lambda m, v: m * v), F.lit(0.0), lambda t, v: t + v)
    early = d.filter("_late = 0").select(*by, x.alias("_x"), F.col(target).alias("_y")).join(fitted, by)
    error = F.sum(((F.col("_y") - guess) / F.greatest(1 - lever, F.lit(1e-12))) ** 2)
    best = early.groupBy(*by, "_k").agg(error.alias("_e")).groupBy(*by).agg(F.min(F.struct("_e", "_k")).alias("_b"))
    chosen = fitted.join(best, by).filter(F.col("_k") == F.col("_b._k")).select(*by, "_k", "_w")

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for _, r in f.iterrows():
                test, w = gram_matrix(r, size), np.append(-np.array(r["_w"]), 1.0)
                mean = r["_mean"]
                total = test[-1, -1] - 2 * mean * test[0, -1] + mean * mean * test[0, 0]
                out.append({b: r[b] for b in by} | {"n_train": int(r["_n"]), "n_test": int(test[0, 0]), "strength": strengths[int(r["_k"])], "r2": float(1 - w @ test @ w / total) if total > 1e-300 else None})
            yield pd.DataFrame(out, columns=[*by, "n_train", "n_test", "strength", "r2"])

    first = stats.filter("_late = 0").select(*by, F.col("g_0_0").alias("_n"), (F.col(f"g_0_{size - 1}") / F.col("g_0_0")).alias("_mean"))
    both = stats.filter("_late = 1").join(first, by).join(chosen, by).filter((F.col("_n") >= least) & (F.col("g_0_0") >= least))
    return both.mapInPandas(score, f"{types}, n_train long, n_test long, strength double, r2 double")


def forward_baseline(df: DataFrame, by: list[str], order: str, target: str, split: float) -> DataFrame:
    """Per group: R2 after the split of two plain forecasts, the training mean and the previous value."""
    w = Window.partitionBy(*by).orderBy(order)
    d = df.withColumns({"_prev": F.lag(target).over(w), "_m": F.avg(F.when(F.col(order) <= split, F.col(target))).over(Window.partitionBy(*by))}).filter(F.col(order) > split)
    total = F.sum((F.col(target) - F.col("_m")) ** 2)
    return d.groupBy(*by).agg(F.count("*").alias("n_test"), F.when(total > 0, 1 - F.sum((F.col(target) - F.col("_prev")) ** 2) / total).alias("r2_previous"), F.sqrt(F.avg((F.col(target) - F.col("_m")) ** 2)).alias("rmse_mean"))


def r2_gain(df: DataFrame, base: list[str], added: str, target: str) -> DataFrame:
    """R2 without and with the added column, and the gain."""
    k = len(base)

    def run(frames):
        for f in frames:
            g = gram_matrix(f.iloc[0], k + 3)
            at = [*range(k + 1), k + 2]
            small = g[np.ix_(at, at)]
            a, b = r2_of(small, solve_gram(small)), r2_of(g, solve_gram(g))
            yield pd.DataFrame([{"r2_base": a, "r2_full": b, "gain": b - a}])

    return gram(df, [], [*base, added], target).mapInPandas(run, "r2_base double, r2_full double, gain double")
