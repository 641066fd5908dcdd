"""Queries without SQL against plain computations over the same rows."""

from __future__ import annotations

import itertools
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cyclonet import catalog
from cyclonet.operators import fits
from cyclonet.operators import frames as fr
from cyclonet.plans import views
from cyclonet.plans.additions import _sides

SF = "/root/testdata/sf0.001"
STATE = ["run", "cycle", "phase"]


def run(spark, name):
    return catalog.QUERIES[name](spark, SF).toPandas()


def near(a, b):
    return np.allclose(np.array(a, float), np.array(b, float), atol=2e-6, rtol=1e-6, equal_nan=True)


@pytest.fixture(scope="module")
def panel(spark):
    p = views.panel(spark, SF).toPandas().sort_values(["regime_id", "cycle"], ignore_index=True)
    for c in ("x", "y", "w"):
        p[c] = p[c].astype(float)
        p[c + "_z"] = p.groupby("regime_id")[c].transform(lambda v: (v - v.mean()) / v.std(ddof=0))
    p["rare"] = p.groupby("regime_id")["w"].transform(lambda v: (v >= v.quantile(0.8)).astype(int))
    return p


class Trees:
    def __init__(self, marks=None):
        self.of, self.sets, self.marks = {}, {}, marks or {}

    def add(self, a, b):
        """Does the edge close a loop? The tree that it is in then."""
        for x in (a, b):
            if x not in self.of:
                self.of[x], self.sets[x] = x, {x}
        p, q = self.of[a], self.of[b]
        if p == q:
            return True, self.sets[p]
        for x in self.sets[q]:
            self.of[x] = p
        self.sets[p] |= self.sets.pop(q)
        return False, self.sets[p]


def filtration(f, marks=None):
    f = f.sort_values(["force", "id1", "id2"], ascending=[False, True, True])
    t, closes, giant, touch, best = Trees(), [], [], [], 0
    for a, b in zip(f["id1"], f["id2"], strict=True):
        c, tree = t.add(a, b)
        closes.append(c)
        best = max(best, len(tree))
        giant.append(best)
        touch.append(set().union(*(marks.get(x, set()) for x in tree)) if marks else set())
    return f["force"].to_numpy(float), np.array(closes), np.array(giant), touch, len(t.of), t


@pytest.fixture(scope="module")
def states(spark):
    c = views.contacts(spark, SF).toPandas()
    c["force"] = c["force"].astype(float)
    return {k: f for k, f in c.groupby(STATE)}


def by_state(df):
    return {tuple(r[k] for k in STATE): r for _, r in df.iterrows()}


def test_loops_giants_curves_and_enrichment(spark, states):
    loops, edges, enrich, curve = (run(spark, n) for n in ("topo_loops", "topo_cycle_edges", "topo_enrichment", "topo_curve"))
    loops, edges, enrich = by_state(loops), by_state(edges), by_state(enrich)
    curves = curve.groupby(STATE)
    assert set(loops) == set(states) == set(edges)
    for k, f in states.items():
        v, closes, giant, _, n, _ = filtration(f)
        m = len(v)
        at = {p: next(i for i in range(m) if (i + 1) / m >= p) for p in (0.01, 0.05, 0.1)}
        half = [i for i in range(m) if giant[i] >= 0.5 * n]
        want = [closes.sum(), closes.mean(), v[closes].sum() / v.sum(), giant[at[0.01]] / n, giant[at[0.05]] / n, giant[at[0.1]] / n, (half[0] + 1) / m if half else np.nan]
        assert near(loops[k][["loop_births", "loop_fraction", "loop_value_share", "giant_top1", "giant_top5", "giant_top10", "giant_half_fraction"]], want)
        first = np.flatnonzero(closes)[0] + 1 if closes.any() else np.nan
        assert near(edges[k][["edges", "loops", "first"]], [m, closes.sum(), first])
        share, part = v[closes].sum() / v.sum(), closes.mean()
        assert near(enrich[k][["loop_fraction", "loop_share", "enrichment"]], [part, share, share / part if part else np.nan])
        for _, r in curves.get_group(k).iterrows():
            i = max(1, int(np.ceil(r["fraction"] * m))) - 1
            assert near(r[["loop_rate", "loop_share", "giant_share", "value_share"]], [closes[: i + 1].mean(), v[: i + 1][closes[: i + 1]].sum() / v[: i + 1].sum(), giant[i] / n, v[: i + 1].sum() / v.sum()])


def test_enrichment_of_hot_and_cold(spark):
    e, d = run(spark, "topo_enrichment"), run(spark, "topo_enrichment_delta").set_index(["run", "cycle"])
    wide = e.pivot(index=["run", "cycle"], columns="phase", values="enrichment").dropna()
    assert all(abs(d.loc[k, "enrichment_hot_minus_cold"] - (r["hot"] - r["cold"])) < 3e-6 for k, r in wide.iterrows())
    assert set(wide.index) <= set(d.index)


def test_curve_summaries(spark, states):
    got, curve = by_state(run(spark, "topo_curve_summary")), run(spark, "topo_curve").groupby(STATE)
    assert set(got) == set(states)
    for k, f in states.items():
        v, closes, giant, _, n, _ = filtration(f)
        m, total = len(v), v.sum()
        ranks = [max(1, int(np.ceil(p * m))) for p in (0.01, 0.02, 0.05, 0.1, 0.2, 0.4, 0.8, 1.0)]
        area = lambda y: float(np.trapezoid(y, (0.01, 0.02, 0.05, 0.1, 0.2, 0.4, 0.8, 1.0)))
        loops = [v[:r][closes[:r]].sum() / total for r in ranks]
        first = np.flatnonzero(closes)
        want = [(first[0] + 1) / m if len(first) else np.nan, v[: first[0] + 1].sum() / total if len(first) else np.nan, area([closes[:r].mean() for r in ranks]), area(loops), area([giant[r - 1] / n for r in ranks]), v[: ranks[2]].sum() / total]
        assert near(got[k][["first_loop_fraction", "first_loop_value_share", "loop_rate_area", "loop_value_area", "giant_area", "top5_share"]], want)
        assert near(curve.get_group(k).sort_values("fraction")["loop_total_share"], loops)


def test_approximate_tails(spark):
    r = np.random.default_rng(2)
    x = r.lognormal(0, 2, 200_000)
    df = spark.createDataFrame(pd.DataFrame({"g": "a", "x": x})).repartition(7)
    from cyclonet.operators import aggregates

    (got,) = aggregates.tail(df, ["g"], "x", (0.9, 0.999), 1e-5).collect()
    order = np.sort(x)
    for q, c in ((0.9, "p90"), (0.999, "p99_9")):
        assert abs(np.searchsorted(order, got[c], "right") - q * len(x)) <= 1e-5 * len(x) + 1
    assert got["approximate"] and not aggregates.tail(df, ["g"], "x").collect()[0]["approximate"]
    exact, near_ = run(spark, "agg_tail").set_index(STATE), run(spark, "agg_tail_approx").set_index(STATE)
    assert set(exact.index) == set(near_.index) and near_["approximate"].all()


def test_sides_and_spanning(spark, states):
    flags = defaultdict(dict)
    for r in _sides(spark, SF).collect():
        flags[(r.run, r.cycle, r.phase)][r.id] = {c for c in ("bottom", "top", "side") if r[c]}
    touches, spans, parts = (by_state(run(spark, n)) for n in ("topo_touches", "topo_spanning", "net_spanning"))
    for k, f in states.items():
        v, closes, _, touch, _, trees = filtration(f, flags[k])
        first = {s: next((i + 1 for i, t in enumerate(touch) if {"bottom", s} <= t), np.nan) for s in ("top", "side")}
        assert near(touches[k][["edges", "loops", "bottom_top", "bottom_side"]], [len(v), closes.sum(), first["top"], first["side"]])
        assert near([spans[k]["span_fraction"]], [first["top"] / len(v)])
        spanning = [t for t in trees.sets.values() if {"bottom", "top"} <= set().union(*(flags[k].get(x, set()) for x in t))]
        assert parts[k]["spanning_components"] == len(spanning)


def test_components_loops_and_backbone(spark, states):
    comp, beta, back = (by_state(run(spark, n)) for n in ("net_components", "net_beta1", "net_backbone"))
    for k, f in states.items():
        *_, n, t = filtration(f)
        assert near(comp[k][["nodes", "components", "giant_share"]], [n, len(t.sets), max(map(len, t.sets.values())) / n])
        assert beta[k]["loops"] == len(f) - n + len(t.sets)
        g = f[f["force"] >= f["force"].quantile(0.9)]
        *_, bn, bt = filtration(g)
        assert list(back[k][["edges", "nodes", "components", "largest"]]) == [len(g), bn, len(bt.sets), max(map(len, bt.sets.values()))]


def test_cores(spark, states):
    got = by_state(run(spark, "net_kcore"))
    for k, f in states.items():
        f = f[f["force"] >= f["force"].quantile(0.5)]
        edges = set(map(tuple, f[["id1", "id2"]].to_numpy()))
        core, level = {}, 0
        left = set(itertools.chain(*edges))
        while left:
            degree = Counter(x for e in edges if e[0] in left and e[1] in left for x in e)
            low = {x for x in left if degree[x] <= level}
            if not low:
                level += 1
                continue
            core.update(dict.fromkeys(low, level))
            left -= low
        c = np.array(list(core.values()))
        assert near(got[k][["core_max", "core_mean", "core4_share", "core5_share"]], [c.max(), c.mean(), (c >= 4).mean(), (c >= 5).mean()])


def test_loop_places(spark, states):
    c = views.contacts(spark, SF).select(*STATE, "id1", "id2", "force")
    where = {(r.run, r.cycle, r.phase, r.id1, r.id2): (r.boundary_edge, r.z_mid, r.r_mid) for r in fr.edge_position(c, views.nodes(spark, SF), STATE).collect()}
    got = by_state(run(spark, "topo_spatial"))
    for k, f in states.items():
        t = Trees()
        f = f.sort_values(["force", "id1", "id2"], ascending=[False, True, True])
        loops = [(v, where[(*k, a, b)]) for a, b, v in zip(f["id1"], f["id2"], f["force"], strict=True) if t.add(a, b)[0]]
        if loops:
            w = np.array([v for v, _ in loops])
            assert near(got[k][["loop_boundary_share", "loop_z", "loop_r"]], [sum(v for v, p in loops if p[0]) / w.sum(), sum(v * p[1] for v, p in loops) / w.sum(), sum(v * p[2] for v, p in loops) / w.sum()])


def test_snapshot_and_overlaps(spark, states):
    got = by_state(run(spark, "topo_snapshot"))
    flags = defaultdict(dict)
    for r in _sides(spark, SF).collect():
        flags[(r.run, r.cycle, r.phase)][r.id] = {c for c in ("bottom", "side") if r[c]}
    for k, f in states.items():
        v, closes, _, touch, *_ = filtration(f, flags[k])
        at = np.arange(1, len(v) + 1) / len(v)
        shown = at <= 0.2
        assert near(got[k][["shown", "shown_loops", "force_share", "loop_share"]], [shown.sum(), (shown & closes).sum(), v[shown].sum() / v.sum(), v[shown & closes].sum() / v[shown].sum()])
        first = next((a for a, t in zip(at, touch, strict=True) if {"bottom", "side"} <= t), np.nan)
        assert near(got[k][["top1_share", "top5_share", "loop_total_share", "bottom_side_first"]], [v[at <= 0.01].sum() / v.sum(), v[at <= 0.05].sum() / v.sum(), v[closes].sum() / v.sum(), first])
    o = fr.contact_overlap(views.particles(spark, SF), ["run", "cycle"]).toPandas().rename(columns={"overlap": "force"})
    got = {(r["run"], r["cycle"]): r for _, r in run(spark, "topo_overlap_percolation").iterrows()}
    for k, f in o.groupby(["run", "cycle"]):
        v, closes, giant, _, n, _ = filtration(f)
        at = next(i for i in range(len(v)) if (i + 1) / len(v) >= 0.05)
        assert near(got[k][["contacts", "loop_births", "giant_top5", "value_sum"]], [len(v), closes.sum(), giant[at] / n, v.sum()])


def test_values_at_loop_births(spark):
    rows = [("s", 1, 2, 5.0), ("s", 2, 3, 4.0), ("s", 1, 3, 3.0), ("s", 3, 4, 2.0), ("s", 2, 4, 1.0), ("s", 1, 4, -1.0), ("t", 1, 2, 1.0)]
    from cyclonet.operators import networks

    df = spark.createDataFrame(rows, "state string, id1 long, id2 long, force double")
    (r,) = networks.loop_values(df, ["state"]).collect()
    assert tuple(r) == ("s", 3, 2, 1.0, pytest.approx(2.6), pytest.approx(2 / 3))


def test_graph_nulls_keep_what_does_not_depend_on_order(spark, states):
    loops = {k: filtration(f)[1].sum() for k, f in states.items()}
    force, order = run(spark, "topo_force_shuffle_null"), run(spark, "topo_order_null")
    assert len(force) == 24 * len(states) and len(order) == 25 * len(states)
    assert all(r["loop_births"] == loops[tuple(r[k] for k in STATE)] for _, r in force.iterrows())
    assert all(r["loops"] == loops[tuple(r[k] for k in STATE)] and 0 <= r["loop_area"] <= 1 for _, r in order.iterrows())
    spread = order.groupby(STATE)["loop_area"].nunique()
    assert (spread[[loops[k] > 1 for k in spread.index]] > 1).all()
    p = run(spark, "topo_order_null_p").iloc[0]
    assert p["n"] == 25 and 1 / 26 <= p["p"] <= 1 and p["null_low"] <= p["null_median"] <= p["null_high"]


def test_shuffled_forces_to_rho_and_p(spark, states):
    force = run(spark, "topo_force_shuffle_null")
    p99 = pd.DataFrame([(*k, np.percentile(f["force"], 99)) for k, f in states.items()], columns=[*STATE, "p99"]).pivot(index=["run", "cycle"], columns="phase", values="p99").dropna()
    y = p99["hot"] - p99["cold"]
    got, want = run(spark, "topo_force_shuffle_rho").set_index("rep"), {}
    for rep, f in force.groupby("rep"):
        w = f.pivot(index=["run", "cycle"], columns="phase", values="loop_value_share").dropna()
        d = pd.DataFrame({"x": w["hot"] - w["cold"], "y": y}).dropna()
        d = d - d.groupby("run").transform("mean")
        want[rep] = (len(d), d["x"].rank().corr(d["y"].rank()))
    assert set(got.index) == set(want) == set(range(1, 25))
    # The shares of the query are rounded, so a rank may differ.
    assert all(got.loc[k, "n"] == n and abs(got.loc[k, "rho"] - r) < 1e-2 and 0 <= got.loc[k, "p"] <= 1 for k, (n, r) in want.items())
    s = run(spark, "topo_force_shuffle_null_p").iloc[0]
    assert s["n"] == 24 and near([s["p"]], [((got["rho"].abs() >= abs(s["observed"]) - 1e-9).sum() + 1) / 25])


def least_squares(x, y, w=None, ridge=None):
    a = np.c_[np.ones(len(x)), x]
    w = np.ones(len(x)) if w is None else w
    g = (a * w[:, None]).T @ a + (0 if ridge is None else np.diag(ridge))
    return np.linalg.solve(g, (a * w[:, None]).T @ y)


def logistic(x, y, weight, penalty):
    a, w = np.c_[np.ones(len(x)), x], np.zeros(x.shape[1] + 1)
    for _ in range(100):
        p = 1 / (1 + np.exp(-a @ w))
        w = w + np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + np.diag(penalty), a.T @ (weight * (y - p)) - penalty * w)
    return w


def auc(y, s):
    return np.mean([1.0 if a > b else 0.5 if a == b else 0.0 for a in s[y == 1] for b in s[y == 0]])


def huber_loss(x, y, w, s, epsilon, alpha):
    """The objective on features as given; w has the intercept first."""
    r = np.abs(y - np.c_[np.ones(len(x)), x] @ w)
    return len(y) * s + np.where(r <= epsilon * s, r * r / s, 2 * epsilon * r - epsilon**2 * s).sum() + alpha * (w[1:] ** 2).sum()


def plain_huber(x, y, epsilon=1.35, alpha=1e-4):
    """The joint minimiser by reweighting, coefficients of the features as given; features are scaled inside."""
    m, d = x.mean(0), x.std(0)
    z = (x - m) / d
    a = np.c_[np.ones(len(z)), z]
    w, s = least_squares(z, y), 1.0
    for _ in range(20_000):
        r = np.abs(y - a @ w)
        weight = np.minimum(1, epsilon * s / np.maximum(r, 1e-300))
        new = np.linalg.solve((a * weight[:, None]).T @ a + alpha * s * np.diag([0.0, *np.ones(len(d))]), a.T @ (weight * y))
        inside = np.abs(y - a @ new) <= epsilon * s
        t = np.sqrt(((y - a @ new)[inside] ** 2).sum() / (len(y) - epsilon**2 * (~inside).sum()))
        done = max(np.abs(new - w).max(), abs(t - s)) < 1e-14
        w, s = new, t
        if done:
            break
    best = huber_loss(z, y, w, s, epsilon, alpha)
    for k in range(len(w) + 1):  # it is a minimum: no step along an axis is better
        for h in (1e-4, -1e-4):
            step = np.zeros(len(w) + 1)
            step[k] = h
            assert huber_loss(z, y, w + step[:-1], s + step[-1], epsilon, alpha) > best
    return np.r_[w[0] - (w[1:] / d * m).sum(), w[1:] / d]


def test_huber(spark, panel):
    got = run(spark, "mod_logo_huber").set_index("regime_id")
    for g, f in panel.groupby("regime_id"):
        rest = panel[panel["regime_id"] != g]
        w = plain_huber(rest[["x_z", "y_z"]].to_numpy(), rest["w_z"].to_numpy())
        e = f["w_z"] - np.c_[np.ones(len(f)), f[["x_z", "y_z"]]] @ w
        assert near(got.loc[g, ["n", "r2", "rmse"]], [len(f), 1 - (e**2).mean() / f["w_z"].var(ddof=0), np.sqrt((e**2).mean())])


def test_huber_coefficients(spark):
    """Heavy tails, features of unlike scales, folds beyond one block."""
    r = np.random.default_rng(7)
    n = 900
    x = r.normal(size=(n, 2)) * [3.0, 0.1] + [10.0, -2.0]
    y = x @ [0.5, -4.0] + r.standard_t(1.3, n)
    g = np.repeat([f"g{k}" for k in range(300)], 3)
    d = spark.createDataFrame([(g[i], *map(float, x[i]), float(y[i])) for i in range(n)], "g string, a double, b double, y double").repartition(4)
    groups = sorted(set(g))
    got = fits.huber_coefficients(d, "g", groups, ["a", "b"], "y", 1.35, 1e-4, True, 60)
    for k in (groups[0], groups[137], groups[299]):
        assert np.abs(got[k] - plain_huber(x[g != k], y[g != k])).max() < 1e-6


def plain_ridge(x, y, strengths=(0.01, 0.1, 1.0, 10.0, 100.0)):
    """Refits without each row in turn; features scaled once over all of them."""
    m, d = x.mean(0), x.std(0)
    z = (x - m) / d
    fit = lambda keep, a: least_squares(z[keep], y[keep], ridge=[0.0, *[a] * z.shape[1]])
    error = [sum((y[i] - np.r_[1, z[i]] @ fit(np.arange(len(y)) != i, a)) ** 2 for i in range(len(y))) for a in strengths]
    a = strengths[int(np.argmin(error))]
    w = fit(np.ones(len(y), bool), a)
    return a, np.r_[w[0] - (w[1:] / d * m).sum(), w[1:] / d]


def test_ridge_strength_by_refits(spark, panel):
    got = run(spark, "mod_logo_ridge").set_index("regime_id")
    for g, f in panel.groupby("regime_id"):
        rest = panel[panel["regime_id"] != g]
        a, w = plain_ridge(rest[["x_z", "y_z"]].to_numpy(), rest["w_z"].to_numpy())
        e = f["w_z"] - np.c_[np.ones(len(f)), f[["x_z", "y_z"]]] @ w
        r2 = 1 - (e**2).sum() / ((f["w_z"] - rest["w_z"].mean()) ** 2).sum()
        assert near(got.loc[g, ["n", "strength", "r2", "coef_intercept", "coef_x_z", "coef_y_z"]], [len(f), a, r2, *w])
    got = run(spark, "mod_forward_ridge").set_index("regime_id")
    for g, f in panel.groupby("regime_id"):
        f = f.assign(l1=f["w_z"].shift(1), l2=f["w_z"].shift(2)).dropna()
        a, b = f[f["cycle"] <= 18], f[f["cycle"] > 18]
        strength, w = plain_ridge(a[["x_z", "l1", "l2"]].to_numpy(), a["w_z"].to_numpy())
        e = b["w_z"] - np.c_[np.ones(len(b)), b[["x_z", "l1", "l2"]]] @ w
        assert near(got.loc[g, ["n_train", "n_test", "strength", "r2"]], [len(a), len(b), strength, 1 - (e**2).sum() / ((b["w_z"] - a["w_z"].mean()) ** 2).sum()])


def test_ridge_ties_take_the_first(spark):
    rows = [(f"g{i % 3}", float(i % 4), 0.0) for i in range(12)]
    out = fits.logo_ridge(spark.createDataFrame(rows, "g string, x double, y double"), "g", ["x"], "y", (5.0, 1.0, 2.0)).collect()
    assert {r["strength"] for r in out} == {5.0}


@pytest.mark.parametrize("balanced", [False, True])
def test_logistic_by_group(spark, panel, balanced):
    prob = np.zeros(len(panel))
    for g in panel["regime_id"].unique():
        own = (panel["regime_id"] == g).to_numpy()
        x, y = panel.loc[~own, ["x_z", "y_z"]].to_numpy(), panel.loc[~own, "rare"].to_numpy()
        weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())) if balanced else np.ones(len(y))
        w = logistic(x, y, weight, np.array([0.0, 1.0, 1.0]))
        prob[own] = 1 / (1 + np.exp(-np.c_[np.ones(own.sum()), panel.loc[own, ["x_z", "y_z"]]] @ w))
    y = panel["rare"].to_numpy()
    if balanced:
        assert near(run(spark, "mod_brier").iloc[0], [((prob - y) ** 2).mean(), ((prob >= 0.5) == y).mean()])
    else:
        got = run(spark, "mod_logo_logistic").set_index("regime_id")
        assert all(near([got.loc[g, "auc"]], [auc(y[i], prob[i])]) for g, i in panel.groupby("regime_id").indices.items())


def test_forward_logistic(spark, panel):
    ys, ps = [], []
    for _, f in panel.groupby("regime_id"):
        a, b = f[f["cycle"] <= 18], f[f["cycle"] > 18]
        y = a["rare"].to_numpy()
        if len(a) < 6 or len(b) < 3 or y.min() == y.max():
            continue
        m, s = a[["x_z", "y_z"]].mean().to_numpy(), a[["x_z", "y_z"]].std(ddof=0).to_numpy()
        w = logistic((a[["x_z", "y_z"]].to_numpy() - m) / s, y, np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())), np.ones(3))
        ps.append(1 / (1 + np.exp(-np.c_[np.ones(len(b)), (b[["x_z", "y_z"]].to_numpy() - m) / s] @ w)))
        ys.append(b["rare"].to_numpy())
    y, p = np.concatenate(ys), np.concatenate(ps)
    balanced = ((p >= 0.5)[y == 1].mean() + (p < 0.5)[y == 0].mean()) / 2
    rho = np.corrcoef(pd.Series(y).rank(), pd.Series(p).rank())[0, 1]
    assert near(run(spark, "mod_forward_logistic")[["n", "auc", "balanced_accuracy", "rho"]].iloc[0], [len(y), auc(y, p), balanced, rho])


def test_forward_logistic_leaves_out_thin_and_one_sided_groups(spark):
    rows = [("thin", t, float(t), t % 2) for t in range(4)] + [("one", t, float(t), 0) for t in range(12)] + [("good", t, float(t % 5), t % 2) for t in range(12)] + [("good", 99, None, 1)]
    d = spark.createDataFrame(rows, "g string, t int, x double, y int")
    out = fits.forward_logistic(d, "g", "t", ["x"], "y", 7).collect()
    assert {r.g for r in out} == {"good"} and len(out) == 4 and all(0 < r.predicted < 1 for r in out)


def test_profiles_and_fixed_effects(spark, panel):
    got = run(spark, "mod_heldout_profile").set_index("regime_id")
    x, y = panel[["x_z", "y_z"]].to_numpy(), panel["w_z"].to_numpy()
    pred = np.array([np.r_[1, x[i]] @ least_squares(np.delete(x, i, 0), np.delete(y, i)) for i in range(len(x))])
    for g, i in panel.groupby("regime_id").indices.items():
        e = y[i] - pred[i]
        assert near(got.loc[g, ["r2", "rmse"]], [1 - (e**2).mean() / y[i].var(), np.sqrt((e**2).mean())])
    got = run(spark, "mod_forward_fe").set_index("regime_id")
    for g, f in panel.groupby("regime_id"):
        f = f.assign(l1=f["w_z"].shift(1), l2=f["w_z"].shift(2)).dropna()
        a, b = f[f["cycle"] <= 18], f[f["cycle"] > 18]
        cols = ["x_z", "l1", "l2"]
        w = least_squares(a[cols].to_numpy(), a["w_z"].to_numpy(), ridge=[0, 1, 1, 1])
        e = b["w_z"] - np.c_[np.ones(len(b)), b[cols]] @ w
        assert near(got.loc[g, ["n_train", "n_test", "r2"]], [len(a), len(b), 1 - (e**2).sum() / ((b["w_z"] - a["w_z"].mean()) ** 2).sum()])


def test_orders_relaxation_and_maps(spark, panel):
    m = panel.groupby("regime_id")[["x", "w"]].mean()
    a, b = m["x"].rank().to_numpy(), m["w"].rank().to_numpy()
    every = [np.corrcoef(a, b[list(o)])[0, 1] for o in itertools.permutations(range(len(b)))]
    rho = np.corrcoef(a, b)[0, 1]
    assert near(run(spark, "st_exact_perm")[["n", "rho", "p"]].iloc[0], [len(m), rho, np.mean(np.abs(every) >= abs(rho) - 1e-12)])
    got = run(spark, "st_relax_fit").set_index("regime_id")
    for g, f in panel.groupby("regime_id"):
        t, y = (f["cycle"] - f["cycle"].min()).to_numpy(float), f["w_z"].to_numpy()
        best = min((np.linalg.lstsq(np.c_[np.ones(len(t)), np.exp(-t / tau)], y, rcond=None)[1].sum(), tau) for tau in np.geomspace(0.05, 100, 60))
        assert near(got.loc[g, ["tau", "r2"]], [best[1], 1 - best[0] / ((y - y.mean()) ** 2).sum()])
    maps = run(spark, "map_fit").set_index("regime_id")
    for _, r in run(spark, "map_lyapunov").iterrows():
        k = maps.loc[r["regime_id"]]
        q = np.array([[k["a11"], k["a12"]], [k["a21"], k["a22"]]])
        p = np.array([[r["p11"], r["p12"]], [r["p12"], r["p22"]]])
        assert np.allclose(q.T @ p @ q - p + np.eye(2), 0, atol=1e-4)
        e = np.linalg.eigvalsh(p)
        assert np.isclose(r["anisotropy"], e[1] / e[0], atol=1e-4) and np.isclose(r["stability_margin"], 1 - k["spectral_radius"], atol=1e-5)


def test_larger_groups_get_drawn_orders(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=40)
    d = spark.createDataFrame([("a", float(v), float(v + r.normal())) for v in x] + [("b", float(v), float(r.normal())) for v in x], "g string, x double, y double")
    p = {r.g: r.p for r in fits.exact_permutation(d, ["g"], "x", "y", draws=2000).collect()}
    assert p["a"] < 0.01 < 0.02 < p["b"]
    assert p == {r.g: r.p for r in fits.exact_permutation(d.orderBy(F.col("y").desc()), ["g"], "x", "y", draws=2000).collect()}


def test_bootstraps(spark, panel):
    from cyclonet.operators import resampling as nul
    from cyclonet.operators import windows as win

    z = win.zscore(views.panel(spark, SF), ["regime_id"], ["x", "y", "w"]).withColumn("n", F.col("n").cast("double"))
    boot = nul.row_bootstrap(z, ["regime_id"], "cycle", ["x_z", "y_z", "w_z", "n"], 50).toPandas()
    coef = np.array([least_squares(f[["x_z", "y_z"]].to_numpy(), f["w_z"].to_numpy())[1:] for _, f in boot.groupby("rep")])
    got = run(spark, "st_coef_boot").set_index("feature")
    for i, c in enumerate(("x_z", "y_z")):
        assert near(got.loc[c, ["mean", "low", "high", "positive"]], [coef[:, i].mean(), *np.quantile(coef[:, i], [0.025, 0.975]), (coef[:, i] > 0).mean()])
    angles = []
    for _, f in boot.groupby("rep"):
        p, q = (least_squares(f[["x_z", "y_z"]].to_numpy(), f[c].to_numpy())[1:] for c in ("w_z", "n"))
        angles.append(np.degrees(np.arccos(p @ q / np.linalg.norm(p) / np.linalg.norm(q))))
    assert near(run(spark, "geo_gradient_angle").iloc[0], [np.median(angles), *np.quantile(angles, [0.025, 0.975])])


def test_information_sweep_against_its_null(spark):
    got, plain = run(spark, "inf_sweep_null"), run(spark, "inf_sweep").set_index(["lag", "bins"])
    assert len(got) == 6 and (got["n"] == 200).all()
    for _, r in got.iterrows():
        assert near([r["mi"], r["corrected"]], [plain.loc[(r["lag"], r["bins"]), "mi"], r["mi"] - r["null_median"]])
        assert 1 / 201 - 1e-6 <= r["p"] <= 1 and 0 <= r["low"] <= r["high"]


def test_merged_forests_close_the_same_edges(spark, states, monkeypatch):
    from cyclonet.operators import networks as net

    rows = [(k[0], int(k[1]), k[2], int(a), int(b), float(v)) for k, f in list(states.items())[:6] for a, b, v in zip(f["id1"] % 12, f["id2"] % 9 + 100, f["force"], strict=True)]
    rows += [("big", 1, "hot", int(a), int(b), float(v)) for a, b, v in np.random.default_rng(1).integers(0, 60, (900, 3))]  # ties and repeated edges
    d = spark.createDataFrame(rows, "run string, cycle int, phase string, id1 long, id2 long, force double")
    whole = Counter(map(tuple, net.loop_edges(d, STATE).collect()))
    monkeypatch.setattr(net, "PART_EDGES", 20)
    monkeypatch.setattr(net, "MERGE", 3)
    parts = net.loop_edges(d, STATE).toPandas()
    assert len(parts) == len(rows)
    # Equal edges may change places, so values are compared.
    key = lambda rs: Counter((r[0], r[1], r[2], r[5], r[6]) for r in rs.elements())
    assert key(Counter(map(tuple, parts[[*STATE, "id1", "id2", "force", "closes"]].itertuples(index=False)))) == key(whole)


def test_ranks_and_codes_of_the_whole_table(spark):
    from cyclonet.operators import windows as win

    r = np.random.default_rng(2)
    f = pd.DataFrame({"k": range(500), "v": r.integers(0, 40, 500).astype(float)})
    d = spark.createDataFrame(f).repartition(7)
    got = win.equal_count(win.rank_pct(win.rank_avg(d, [], "v"), [], "v"), [], "v", 6, ["k"]).toPandas().sort_values("k")
    want = f["v"].rank()
    place = f.sort_values(["v", "k"]).reset_index().sort_values("k").index.to_numpy()
    assert near(got["rank"], want) and near(got["pct"], want / 500) and list(got["code"]) == list(np.minimum(place * 6 // 500, 5))
    assert win.rank_avg(d.limit(0), [], "v").collect() == []


def test_neighbours_by_the_radii_of_their_state(spark):
    r = np.random.default_rng(5)
    rows = [(s, i, *map(float, r.random(3)), float(r.choice([0.01, 0.05]) if s == "a" else r.choice([0.02, 0.3]))) for s in "ab" for i in range(150)]
    d = spark.createDataFrame(rows, "run string, id long, x double, y double, z double, radius double")
    want = {(p[0], p[1], q[1]) for p, q in itertools.combinations(rows, 2) if p[0] == q[0] and np.linalg.norm(np.subtract(p[2:5], q[2:5])) <= (p[5] + q[5]) * 1.004}
    got = [(x.run, x.id1, x.id2) for x in fr.contact_skin(d, ["run"]).collect()]
    assert len(got) == len(set(got)) and set(got) == want
