"""Iterated and small-sample fits: each iteration is one scan of the data for all folds, never a copy of it on the driver
and never a join of rows with folds."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import is_finite
from ..shared import materialize
from .statistics import gram, gram_matrix, solve_gram


MOST_FOLDS = 10_000  # groups whose coefficients are held on the driver and broadcast
FOLD_BLOCK = 256  # folds that a batch of rows meets in one product of matrices


def _clean(df: DataFrame, group: str, features: list[str], target: str, keep: tuple[str, ...] = ()) -> tuple[DataFrame, list]:
    """The finite rows, written once for all rounds, and their groups; too many groups are an error."""
    d = df.select(group, *keep, *(F.col(c).cast("double").alias(c) for c in [*features, target])).filter(reduce(lambda a, b: a & b, [is_finite(c) for c in [*features, target]]))
    d = materialize(d)
    groups = sorted(r[0] for r in d.select(group).distinct().limit(MOST_FOLDS + 1).collect())
    if len(groups) > MOST_FOLDS:
        raise ValueError(f"more than {MOST_FOLDS} groups")
    return d, groups


def _table(df: DataFrame, group: str, coef: dict, more: dict | None = None) -> DataFrame:
    """_fold, _w (its coefficients) and _s (a number of its own), to be broadcast: as many rows as folds."""
    kind = df.schema[group].dataType.simpleString()
    rows = [(k, [float(v) for v in w], float((more or {}).get(k, 1.0))) for k, w in coef.items()]
    return F.broadcast(df.sparkSession.createDataFrame(rows, f"_fold {kind}, _w array<double>, _s double"))


def _linear(features: list[str]) -> Column:
    """Each row's linear predictor by the coefficients beside it."""
    return reduce(lambda a, b: a + b, [F.get("_w", F.lit(0)), *(F.col(c) * F.get("_w", F.lit(i)) for i, c in enumerate(features, 1))])


def _weighted(df: DataFrame, features: list[str], target: Column, weight: Column) -> dict:
    cols = [F.lit(1.0), *(F.col(c) for c in features), target]
    agg = [F.sum(weight * cols[i] * cols[j]).alias(f"g_{i}_{j}") for i in range(len(cols)) for j in range(i, len(cols))]
    return {r["_fold"]: gram_matrix(r, len(cols)) for r in df.groupBy("_fold").agg(*agg).collect()}  # one row a fold


def _held_out(df: DataFrame, group: str, features: list[str], coef: dict, link: Callable[[Column], Column] = lambda z: z) -> DataFrame:
    out = df.join(_table(df, group, coef), F.col(group) == F.col("_fold"), "left")
    return out.withColumn("predicted", link(_linear(features))).drop("_fold", "_w", "_s")


def upper(x: np.ndarray) -> np.ndarray:
    """The products of each two columns, the upper triangle by rows: what a weighted Gram matrix is a sum of."""
    i, j = np.triu_indices(x.shape[1])
    return x[:, i] * x[:, j]


def full(flat: np.ndarray, size: int) -> np.ndarray:
    g = np.zeros((size, size))
    i, j = np.triu_indices(size)
    g[i, j] = g[j, i] = flat
    return g


def fold_sums(data: DataFrame, group: str, groups: list, columns: list[str], out: list, params: np.ndarray, width: int, sums: Callable[..., np.ndarray]) -> np.ndarray:
    """[folds, width]: for each fold k, sums over all rows but those of the group out[k]; one scan, no join.

    sums(rows, params of some folds, mask) gets the columns of a batch of rows as an array, and mask [rows, folds], 0 where
    a row's group is left out; it returns [folds, width] by products of matrices. A task adds up what it sees and sends one
    row a fold.
    """
    sent = data.sparkSession.sparkContext.broadcast((np.asarray(params), np.array([groups.index(g) for g in out])))
    names = [f"s{i}" for i in range(width)]

    def scan(batches):
        coef, left_out = sent.value
        total = np.zeros((len(coef), width))
        seen = False
        for b in batches:
            if b.num_rows:
                seen = True
                code = pc.index_in(b.column(0), value_set=pa.array(groups, b.schema.field(0).type)).fill_null(-1).to_numpy(zero_copy_only=False)
                rows = np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(1, b.num_columns)], 1)
                for k in range(0, len(coef), FOLD_BLOCK):
                    part = slice(k, k + FOLD_BLOCK)
                    total[part] += sums(rows, coef[part], (code[:, None] != left_out[part]).astype(float))
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(coef), dtype=np.int32)), *(pa.array(total[:, i]) for i in range(width))], names=["fold", *names])

    parts = data.select(group, *columns).mapInArrow(scan, "fold int, " + ", ".join(f"{c} double" for c in names))
    got = np.zeros((len(params), width))
    for r in parts.groupBy("fold").agg(*(F.sum(c).alias(c) for c in names)).collect():  # one row a fold
        got[r["fold"]] = [r[c] for c in names]
    return got


def _least_squares(data: DataFrame, group: str, groups: list, columns: list[str]) -> dict:
    """Each fold's Gram matrix of [1, features, target]: the total less its own group's."""
    size = len(columns) + 1
    own = {r[group]: gram_matrix(r, size) for r in gram(data, [group], columns[:-1], columns[-1]).collect()}  # one row a group
    every = sum(own.values())
    return {k: every - own[k] for k in groups}


def logo_huber(df: DataFrame, group: str, features: list[str], target: str, epsilon: float = 1.35, alpha: float = 1e-4, scaled: bool = True, rounds: int = 60) -> DataFrame:
    """Leave-one-group-out Huber regression with concomitant scale; adds predicted, the held-out prediction, to the rows.

    A fold's coefficients w, intercept c and scale s together minimise, over its rows' residuals r,
    sum(s + H(r / s) s) + alpha |w|^2 with H(z) = z^2 up to epsilon and 2 epsilon |z| - epsilon^2 beyond; `scaled`: w are
    those of features with unit variance over the fold's rows. Each round is one scan for all folds: with the rows inside
    and outside the bound known, the best point for that division follows from their sums; a point that is no better is
    halved back, and a fold that has come to rest takes no part in later scans.
    """
    data, groups = _clean(df, group, features, target)
    return _held_out(data, group, features, huber_coefficients(data, group, groups, features, target, epsilon, alpha, scaled, rounds))


def huber_coefficients(data: DataFrame, group: str, groups: list, features: list[str], target: str, epsilon: float, alpha: float, scaled: bool, rounds: int) -> dict:
    """{group: intercept and coefficients} of the fits of `logo_huber`; of a fold without rows, zeros."""
    size = len(features) + 1
    grams = _least_squares(data, group, groups, [*features, target])
    width = (size + 1) * (size + 2) // 2

    def sums(rows: np.ndarray, params: np.ndarray, mask: np.ndarray) -> np.ndarray:
        x = np.c_[np.ones(len(rows)), rows]
        rest = x[:, -1:] - x[:, :-1] @ params[:, :-1].T
        near = np.abs(rest) <= epsilon * params[:, -1]
        far = np.where(near, 0.0, np.sign(rest)) * mask
        return np.c_[(near * mask).T @ upper(x), far.T @ x, np.abs(far).sum(0)]

    def objective(p: np.ndarray, got: np.ndarray, n: float, d: np.ndarray) -> float:
        g, u, s = full(got[:width], size + 1), got[width : width + size + 1], p[-1]
        v = np.append(-p[:-1], 1.0)
        return n * s + v @ g @ v / s + 2 * epsilon * (v @ u) - got[-1] * epsilon**2 * s + alpha * p[:-1] @ (d * p[:-1])

    def best(p: np.ndarray, got: np.ndarray, n: float, d: np.ndarray) -> np.ndarray:
        g, u, s, free = full(got[:width], size + 1), got[width : width + size], p[-1], n - epsilon**2 * got[-1]
        if free <= 0:  # too many outside for this scale
            return np.append(p[:-1], 2 * s)
        for _ in range(200):
            w = np.linalg.lstsq(g[:-1, :-1] + alpha * s * np.diag(d), g[:-1, -1] + epsilon * s * u, rcond=None)[0]
            v = np.append(-w, 1.0)
            new = max(math.sqrt(max(v @ g @ v, 0.0) / free), 1e-12)
            if abs(new - s) <= 1e-15 * s:
                break
            s = new
        return np.append(w, s)

    state: dict = {}
    for k in groups:
        g = grams[k]
        n = g[0, 0]
        if n < 0.5:
            continue
        w = solve_gram(g)
        v = np.append(-w, 1.0)
        spread = np.array([0.0, *(max(g[i, i] / n - (g[0, i] / n) ** 2, 0.0) if scaled else 1.0 for i in range(1, size))])
        state[k] = {"n": n, "d": spread, "at": None, "f": math.inf, "try": np.append(w, max(math.sqrt(max(v @ g @ v, 0.0) / n), 1e-12))}
    active = list(state)
    for _ in range(rounds):
        if not active:
            break
        got = fold_sums(data, group, groups, [*features, target], active, np.array([state[k]["try"] for k in active]), width + size + 2, sums)
        still = []
        for k, g in zip(active, got, strict=True):
            f = state[k]
            value = objective(f["try"], g, f["n"], f["d"])
            if value <= f["f"] + 1e-13 * abs(value):
                f |= {"at": f["try"], "f": value}
                f["try"] = best(f["at"], g, f["n"], f["d"])
            else:
                f["try"] = (f["try"] + f["at"]) / 2
            if np.abs(f["try"] - f["at"]).max() > 1e-11 * (1 + np.abs(f["at"]).max()):
                still.append(k)
        active = still
    return {k: state[k]["at"][:-1] if k in state else np.zeros(size) for k in groups}


def ridge_choice(data: DataFrame, group: str, groups: list, features: list[str], target: str, strengths: tuple[float, ...]) -> dict:
    """{group: (strength, coefficients)}: for the rows of all other groups, the strength of least leave-one-row-out error
    (the first of equal ones) for features of unit variance, and the fit with it.

    A row's error without itself is its residual over one less its leverage. Fits and leverages of all folds and strengths
    come from one Gram matrix a fold; a second scan adds up the errors.
    """
    size = len(features) + 1
    grams = _least_squares(data, group, groups, [*features, target])
    cases, params, fits = [], [], {}
    for k in groups:
        g = grams[k]
        n = g[0, 0]
        spread = [max(g[i, i] / n - (g[0, i] / n) ** 2, 0.0) if n > 0.5 else 0.0 for i in range(1, size)]
        for a in strengths:
            inverse = np.linalg.pinv(g[:-1, :-1] + a * np.diag([0.0, *spread]))
            w = inverse @ g[:-1, -1]
            twice = inverse * 2 - np.diag(np.diag(inverse))  # a product of two columns stands once in `upper`
            cases.append(k)
            params.append(np.r_[w, twice[np.triu_indices(size)]])
            fits[k, a] = w

    def sums(rows: np.ndarray, params: np.ndarray, mask: np.ndarray) -> np.ndarray:
        x = np.c_[np.ones(len(rows)), rows[:, :-1]]
        rest = rows[:, -1:] - x @ params[:, :size].T
        lever = upper(x) @ params[:, size:].T
        return ((rest / np.maximum(1 - lever, 1e-12)) ** 2 * mask).sum(0)[:, None]

    error = fold_sums(data, group, groups, [*features, target], cases, np.array(params), 1, sums)[:, 0].reshape(len(groups), len(strengths))
    # Errors that are equal but for rounding tie.
    first = [int(np.flatnonzero(e <= e.min() * (1 + 1e-12))[0]) if np.isfinite(e).all() else 0 for e in error]
    return {k: (strengths[i], fits[k, strengths[i]]) for k, i in zip(groups, first, strict=True)}


def logo_ridge(df: DataFrame, group: str, features: list[str], target: str, strengths: tuple[float, ...] = (0.01, 0.1, 1.0, 10.0, 100.0)) -> DataFrame:
    """Leave-one-group-out ridge regression whose strength is chosen on each fold's training rows (see `ridge_choice`).

    Per held-out group: n, strength, R2 against the training mean, and the coefficients.
    """
    data, groups = _clean(df, group, features, target)
    chosen = ridge_choice(data, group, groups, features, target, strengths)
    size = len(features) + 2
    own = {r[group]: gram_matrix(r, size) for r in gram(data, [group], features, target).collect()}
    every = sum(own.values())
    rows = []
    for k in groups:
        strength, w = chosen[k]
        g, rest = own[k], every - own[k]
        v = np.append(-w, 1.0)
        mean = rest[0, -1] / rest[0, 0] if rest[0, 0] > 0.5 else math.nan
        total = g[-1, -1] - 2 * mean * g[0, -1] + mean * mean * g[0, 0]
        rows.append((k, int(g[0, 0]), float(strength), float(1 - v @ g @ v / total) if total > 1e-300 else None, *map(float, w)))
    kind = df.schema[group].dataType.simpleString()
    return df.sparkSession.createDataFrame(rows, f"{group} {kind}, n long, strength double, r2 double, coef_intercept double, " + ", ".join(f"coef_{c} double" for c in features))


def _newton(rows: Callable[[dict], DataFrame], groups: list, features: list[str], label: str, weight: Column, penalty: np.ndarray, rounds: int) -> dict:
    """Coefficients of a penalised logistic regression for each fold of rows(coefficients); one aggregation a round."""
    coef = {k: np.zeros(len(penalty)) for k in groups}
    for _ in range(rounds):
        p = 1 / (1 + F.exp(-_linear(features)))
        # The last column is the working residual, so that one Gram matrix holds the Hessian and the gradient.
        sums = _weighted(rows(coef).withColumn("_p", p).withColumn("_v", F.greatest(F.col("_p") * (1 - F.col("_p")), F.lit(1e-12))), features, (F.col(label) - F.col("_p")) / F.col("_v"), weight * F.col("_v"))
        step = {k: np.linalg.solve(g[:-1, :-1] + penalty + 1e-9 * np.eye(len(penalty)), g[:-1, -1] - penalty @ coef[k]) for k, g in sums.items()}
        coef = {k: coef[k] + step[k] for k in step}
        if max((float(np.abs(s).max()) for s in step.values()), default=0.0) < 1e-9:
            break
    return coef


def logo_logistic(df: DataFrame, group: str, features: list[str], label: str, ridge: float = 1.0, balanced: bool = False, rounds: int = 25) -> DataFrame:
    """Leave-one-group-out logistic regression by Newton steps, one scan a step for all folds; adds predicted, the held-out
    probability. balanced: both classes of a fold weigh the same."""
    data, groups = _clean(df, group, features, label)
    size = len(features) + 1
    own = {r[group]: (r["n"], r["s"]) for r in data.groupBy(group).agg(F.count("*").alias("n"), F.sum(label).alias("s")).collect()}
    n, s = (sum(v[i] for v in own.values()) for i in (0, 1))
    share = {k: min(max((s - v[1]) / max(1, n - v[0]), 1e-9), 1 - 1e-9) for k, v in own.items()}
    penalty = np.diag([0.0, *[ridge] * (size - 1)])
    half = size * (size + 1) // 2

    def sums(rows: np.ndarray, params: np.ndarray, mask: np.ndarray) -> np.ndarray:
        x, y = np.c_[np.ones(len(rows)), rows[:, :-1]], rows[:, -1:]
        p = 1 / (1 + np.exp(-np.clip(x @ params[:, :-1].T, -700, 700)))
        weight = mask * np.where(y > 0, 0.5 / params[:, -1], 0.5 / (1 - params[:, -1])) if balanced else mask
        return np.c_[(weight * np.maximum(p * (1 - p), 1e-12)).T @ upper(x), (weight * (y - p)).T @ x]

    coef = {k: np.zeros(size) for k in groups}
    active = list(groups)
    for _ in range(rounds):
        if not active:
            break
        got = fold_sums(data, group, groups, [*features, label], active, np.array([np.append(coef[k], share[k]) for k in active]), half + size, sums)
        still = []
        for k, g in zip(active, got, strict=True):
            step = np.linalg.solve(full(g[:half], size) + penalty + 1e-9 * np.eye(size), g[half:] - penalty @ coef[k])
            coef[k] = coef[k] + step
            if np.abs(step).max() >= 1e-9:
                still.append(k)
        active = still
    return _held_out(data, group, features, coef, lambda z: 1 / (1 + F.exp(-z)))


def forward_logistic(df: DataFrame, group: str, order: str, features: list[str], label: str, split: float, ridge: float = 1.0, rounds: int = 40, least: tuple[int, int] = (6, 3)) -> DataFrame:
    """Rows after the split with predicted, the probability by a balanced logistic regression on the group's rows up to it.

    Features are scaled by the early rows' mean and sd (a constant one to zero); the penalty takes in the intercept.
    Groups with fewer than `least` rows on either side, or with one class among the early rows, are left out.
    """
    data, _ = _clean(df, group, features, label, (order,))
    early = F.col(order) <= split
    sums = [F.avg(F.when(early, F.col(c))).alias(f"_m_{c}") for c in features] + [F.stddev_pop(F.when(early, F.col(c))).alias(f"_d_{c}") for c in features]
    stats = data.groupBy(F.col(group).alias("_g")).agg(F.count(F.when(early, 1)).alias("_n0"), F.count(F.when(~early, 1)).alias("_n1"), F.avg(F.when(early, F.col(label))).alias("_share"), *sums)
    stats = stats.filter((F.col("_n0") >= least[0]) & (F.col("_n1") >= least[1]) & (F.col("_share") > 0) & (F.col("_share") < 1))
    scaled = data.join(F.broadcast(stats), F.col(group) == F.col("_g")).withColumns({c: F.when(F.col(f"_d_{c}") > 0, (F.col(c) - F.col(f"_m_{c}")) / F.col(f"_d_{c}")).otherwise(F.lit(0.0)) for c in features})
    scaled = materialize(scaled.select(group, order, label, "_share", *features))
    groups = [r[0] for r in scaled.select(group).distinct().collect()]  # MOST_FOLDS at most
    weight = F.when(F.col(label) > 0, 0.5 / F.col("_share")).otherwise(0.5 / (1 - F.col("_share")))
    rows = lambda coef: scaled.filter(early).join(_table(scaled, group, coef), F.col(group) == F.col("_fold"))
    coef = _newton(rows, groups, features, label, weight, np.diag([ridge] * (len(features) + 1)), rounds)
    return _held_out(scaled.filter(~early), group, features, coef, lambda z: 1 / (1 + F.exp(-z))).drop("_share")


def balanced_accuracy(predictions: DataFrame, by: list[str], label: str, predicted: str = "predicted", cut: float = 0.5) -> DataFrame:
    """by, n and the mean of the two classes' shares that fall on their side of the cut (null: one class only)."""
    yes = (F.col(predicted) >= cut).cast("double")
    return predictions.groupBy(*by).agg(F.count("*").alias("n"), ((F.avg(F.when(F.col(label) > 0, yes)) + F.avg(F.when(F.col(label) <= 0, 1 - yes))) / 2).alias("balanced_accuracy"))


def brier(df: DataFrame, label: str, predicted: str = "predicted") -> DataFrame:
    return df.agg(F.avg((F.col(predicted) - F.col(label)) ** 2).alias("brier"), F.avg(((F.col(predicted) >= 0.5).cast("int") == F.col(label)).cast("double")).alias("accuracy"))


def exact_permutation(df: DataFrame, by: list[str], x: str, y: str, most: int = 8, draws: int = 10_000) -> DataFrame:
    """Two-sided p of the Spearman correlation over all orders, for groups of at most `most` rows.

    Larger groups: over `draws` random orders, seeded by the group's keys, the observed one counted in.
    """
    types = ", ".join(f"{b} {df.schema[b].dataType.simpleString()}" for b in by)

    def run(f: pd.DataFrame) -> pd.DataFrame:
        a, b = f[x].rank().to_numpy(), f[y].rank().to_numpy()
        n, p, rho = len(f), None, None
        if n >= 3 and a.std() > 0 and b.std() > 0:
            order = np.lexsort((b, a))  # the draws do not depend on the order of the rows
            a, b = ((a - a.mean()) / a.std())[order], ((b - b.mean()) / b.std())[order]
            rho = float(a @ b / n)
            if n <= most:
                orders = (list(o) for o in itertools.permutations(range(n)))
            else:
                rng = np.random.default_rng(list("|".join(str(f[k].iloc[0]) for k in by).encode()))
                orders = (range(n) if k == 0 else rng.permutation(n) for k in range(draws + 1))
            every = np.array([a @ b[o] for o in orders]) / n
            p = float((np.abs(every) >= abs(rho) - 1e-12).mean())
        return pd.DataFrame([{k: f[k].iloc[0] for k in by} | {"n": n, "rho": rho, "p": p}]).astype({"rho": "float64", "p": "float64"})

    return df.select(*by, x, y).groupBy(*by).applyInPandas(run, f"{types}, n long, rho double, p double")


def hinge_scan(df: DataFrame, x: str, y: str, breaks: int = 120) -> DataFrame:
    """Piecewise-linear fits y ~ x + (x - b)+ over evenly spaced breakpoints: sse of each; one aggregation for all."""
    ends = df.filter(is_finite(x) & is_finite(y)).agg(F.min(x).alias("a"), F.max(x).alias("b"))
    d = df.filter(is_finite(x) & is_finite(y)).crossJoin(F.broadcast(ends)).withColumn("break_at", F.explode(F.transform(F.sequence(F.lit(1), F.lit(breaks)), lambda k: F.col("a") + (F.col("b") - F.col("a")) * k / (breaks + 1))))
    cols = [F.lit(1.0), F.col(x).cast("double"), F.greatest(F.col(x) - F.col("break_at"), F.lit(0.0)), F.col(y).cast("double")]
    g = d.groupBy("break_at").agg(*(F.sum(cols[i] * cols[j]).alias(f"g_{i}_{j}") for i in range(4) for j in range(i, 4)))

    def run(frames):
        for f in frames:
            out = []
            for _, r in f.iterrows():
                m = gram_matrix(r, 4)
                w, line = solve_gram(m), m[np.ix_([0, 1, 3], [0, 1, 3])]
                k = solve_gram(line)
                sse = lambda q, v: float(q[-1, -1] - 2 * v @ q[:-1, -1] + v @ q[:-1, :-1] @ v)
                out.append({"break_at": r["break_at"], "sse": sse(m, w), "sse_line": sse(line, k), "slope_before": w[1], "slope_after": w[1] + w[2]})
            yield pd.DataFrame(out, columns=["break_at", "sse", "sse_line", "slope_before", "slope_after"])

    return g.mapInPandas(run, "break_at double, sse double, sse_line double, slope_before double, slope_after double")


def relax_fit(df: DataFrame, by: list[str], order: str, col: str, taus: int = 60) -> DataFrame:
    """y_inf + amplitude exp(-t / tau) per group: tau on a logarithmic grid in [0.05, 100], the rest linear at each."""
    types = ", ".join(f"{b} {df.schema[b].dataType.simpleString()}" for b in by)
    grid = np.geomspace(0.05, 100, taus)

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f[np.isfinite(f[col])].sort_values(order)
        t, y = f[order].to_numpy(float), f[col].to_numpy(float)
        best = (math.inf, None, None, None)
        if len(f) >= 4:
            t = t - t[0]
            for tau in grid:
                a = np.c_[np.ones(len(t)), np.exp(-t / tau)]
                w, *_ = np.linalg.lstsq(a, y, rcond=None)
                sse = float(((y - a @ w) ** 2).sum())
                best = min(best, (sse, float(tau), float(w[0]), float(w[1])))
        total = float(((y - y.mean()) ** 2).sum()) if len(y) else 0.0
        row = {"tau": best[1], "y_inf": best[2], "amplitude": best[3], "half_life": best[1] * math.log(2) if best[1] else None, "r2": 1 - best[0] / total if best[1] and total > 0 else None}
        return pd.DataFrame([{k: f[k].iloc[0] if len(f) else None for k in by} | row]).astype(dict.fromkeys(row, "float64"))

    return df.select(*by, order, col).groupBy(*by).applyInPandas(run, f"{types}, tau double, y_inf double, amplitude double, half_life double, r2 double")


def loo_row(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """Adds predicted, each row's prediction by the fit without it: residual / (1 - leverage), one aggregation in all."""
    g = gram_matrix(gram(df, [], features, target).first(), len(features) + 2)
    w, inverse = solve_gram(g), np.linalg.pinv(g[:-1, :-1])
    x = [F.lit(1.0), *(F.col(c) for c in features)]
    fit = reduce(lambda a, b: a + b, [c * float(v) for c, v in zip(x, w, strict=True)])
    lever = reduce(lambda a, b: a + b, [x[i] * x[j] * float(inverse[i, j]) for i in range(len(x)) for j in range(len(x))])
    return df.withColumn("predicted", F.col(target) - (F.col(target) - fit) / (1 - lever))


def coefficient_bootstrap(samples: DataFrame, by: list[str], features: list[str], target: str) -> DataFrame:
    """Per feature over bootstrap replicates (rows tagged by `rep`): mean, central 95 % and probability of a positive sign."""
    size = len(features) + 2

    def fit(frames):
        for f in frames:
            yield pd.DataFrame([{"rep": r["rep"], "feature": c, "coefficient": v} for _, r in f.iterrows() for c, v in zip(features, solve_gram(gram_matrix(r, size))[1:], strict=True)], columns=["rep", "feature", "coefficient"])

    coef = gram(samples, ["rep"], features, target).mapInPandas(fit, "rep int, feature string, coefficient double")
    q = lambda v: F.expr(f"percentile(coefficient, {v})")
    return coef.groupBy("feature").agg(F.avg("coefficient").alias("mean"), q(0.025).alias("low"), q(0.975).alias("high"), F.avg((F.col("coefficient") > 0).cast("double")).alias("positive"))
