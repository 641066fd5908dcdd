"""Graph operators on hand-made cases and by identities."""

from __future__ import annotations

import pytest

from cyclonet.operators import networks as net

GRAPHS = {
    "triangle": [(1, 2), (2, 3), (1, 3)],
    "path": [(1, 2), (2, 3), (3, 4)],
    "two": [(1, 2), (3, 4)],
    "k4": [(1, 2), (1, 3), (1, 4), (2, 3), (2, 4), (3, 4)],
    "star": [(1, k) for k in range(2, 9)],
}


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame([(g, a, b, float(100 - k)) for g, es in GRAPHS.items() for k, (a, b) in enumerate(es)], "state string, id1 long, id2 long, force double")


def by_state(df, *cols):
    return {r["state"]: tuple(r[c] for c in cols) for r in df.collect()}


def test_loops_and_components(edges):
    got = by_state(net.beta1(edges, ["state"]), "nodes", "components", "loops")
    assert got == {"triangle": (3, 1, 1), "path": (4, 1, 0), "two": (4, 2, 0), "k4": (4, 1, 3), "star": (8, 1, 0)}


def test_cores(edges):
    assert by_state(net.kcore_stats(edges, ["state"]), "core_max") == {"triangle": (2,), "path": (1,), "two": (1,), "k4": (3,), "star": (1,)}


def test_triangles(edges):
    assert by_state(net.triangles(edges, ["state"]), "triangles", "wedges") == {"triangle": (1, 3), "path": (0, 2), "two": (0, 0), "k4": (4, 12), "star": (0, 21)}


def test_filtration_order(spark):
    square = [(1, 2, 5.0), (2, 3, 4.0), (3, 4, 3.0), (4, 1, 2.0), (1, 3, 1.0)]
    df = spark.createDataFrame([("s", *e) for e in square], "state string, id1 long, id2 long, force double")
    got = [r["closes"] for r in net.filtration_edges(df, ["state"]).orderBy("rank").collect()]
    assert got == [False, False, False, True, True]


def test_loop_identity(spark):
    from cyclonet.plans.views import contacts

    c = contacts(spark, "/root/testdata/sf0.001")
    keys = ["run", "cycle", "phase"]
    a = {tuple(r[k] for k in keys): r["loop_births"] for r in net.percolation(c, keys).collect()}
    b = {tuple(r[k] for k in keys): r["loops"] for r in net.beta1(c, keys).collect()}
    assert a == b


def test_nulls_keep_the_number_of_loops(edges):
    runs = [{(r["state"], r["rep"]): (r["loops"], r["loop_area"]) for r in net.order_null(edges, ["state"], 4).collect()} for _ in range(2)]
    assert runs[0] == runs[1]
    assert {v[0] for k, v in runs[0].items() if k[0] == "k4"} == {3}


def test_queries_take_all_states(spark):
    from cyclonet import catalog
    from cyclonet.plans.views import contacts

    sf, keys = "/root/testdata/sf0.001", ("run", "cycle", "phase")
    edges = {}
    for r in contacts(spark, sf).collect():
        edges.setdefault(tuple(r[k] for k in keys), []).append((r["id1"], r["id2"]))
    want = {}
    for state, es in edges.items():
        label = {n: n for e in es for n in e}
        for a, b in es:
            old, new = label[a], label[b]
            label = {n: new if c == old else c for n, c in label.items()}
        want[state] = (len(label), len(set(label.values())), len(es) - len(label) + len(set(label.values())))
    rows = {n: catalog.QUERIES[n](spark, sf).collect() for n in ("net_components", "net_beta1", "net_spanning", "topo_force_shuffle_null", "topo_order_null")}
    state = lambda r: tuple(r[k] for k in keys)
    assert {state(r): (r["nodes"], r["components"]) for r in rows["net_components"]} == {k: v[:2] for k, v in want.items()}
    assert {state(r): r["loops"] for r in rows["net_beta1"]} == {k: v[2] for k, v in want.items()}
    assert {state(r) for r in rows["net_spanning"]} == set(want)
    for name, loops, n in (("topo_force_shuffle_null", "loop_births", 24), ("topo_order_null", "loops", 25)):
        assert {(state(r), r["rep"], r[loops]) for r in rows[name]} == {(k, rep, v[2]) for k, v in want.items() for rep in range(1, n + 1)}


def test_exact_permutation_takes_all_cycles(spark):
    import itertools

    import numpy as np

    from cyclonet import catalog
    from cyclonet.plans.views import panel

    sf = "/root/testdata/sf0.001"
    p = panel(spark, sf).toPandas()
    means = p.groupby("regime_id")[["x", "w"]].mean().rank()
    rho = lambda y: np.corrcoef(means["x"], y)[0, 1]
    every = [abs(rho(list(y))) for y in itertools.permutations(means["w"])]
    (r,) = catalog.QUERIES["st_exact_perm"](spark, sf).collect()
    assert r["n"] == p["regime_id"].nunique()
    assert (r["rho"], r["p"]) == (pytest.approx(rho(means["w"]), abs=1e-6), pytest.approx(np.mean([e >= abs(rho(means["w"])) - 1e-9 for e in every]), abs=1e-6))


def _plain_labels(pairs):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def test_components_of_a_long_path(spark):
    """No task solves a state here: every step is a round of joins, and the rounds stay logarithmic."""
    n = 100_000
    edges = spark.range(n - 1).selectExpr("'s' AS state", "id AS id1", "id + 1 AS id2")
    trace = []
    (r,) = net.component_labels(edges, ["state"], local=0, trace=trace).selectExpr("count(*) AS n", "max(component) AS c", "count(DISTINCT node) AS d").collect()
    assert (r["n"], r["c"], r["d"]) == (n, 0, n)
    assert len(trace) <= 40


def test_components_by_rounds_and_by_task(spark):
    import random

    r = random.Random(3)
    pairs = [(s, r.randrange(400), r.randrange(400)) for s in "ab" for _ in range(260)] + [("c", 7, 7)] + [("d", 0, k) for k in range(1, 600)]
    df = spark.createDataFrame([(s, a, b) for s, a, b in pairs], "state string, id1 long, id2 long")
    want = {(s, n): c for s in "abcd" for n, c in _plain_labels([p[1:] for p in pairs if p[0] == s]).items()}
    for local in (0, 50, 10_000):
        got = net.component_labels(df, ["state"], local=local).collect()
        assert {(x["state"], x["node"]): x["component"] for x in got} == want and len(got) == len(want)
    assert net.component_labels(df.limit(0), ["state"]).collect() == []


def test_cores_of_a_star_and_of_drawn_graphs(spark):
    import random

    r = random.Random(4)
    pairs = {tuple(sorted((r.randrange(60), r.randrange(60)))) for _ in range(240)}
    pairs = [p for p in pairs if p[0] != p[1]] + [(1000, 1001 + k) for k in range(5000)]
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want, left, k = {}, {x: set(v) for x, v in near.items()}, 0
    while left:
        low = [x for x, v in left.items() if len(v) <= k]
        if not low:
            k += 1
        for x in low:
            want[x] = k
            for y in left.pop(x):
                if y in left:
                    left[y].discard(x)
    df = spark.createDataFrame([("s", *p) for p in pairs], "state string, id1 long, id2 long")
    assert {x["node"]: x["core"] for x in net.kcore(df, ["state"]).collect()} == want


@pytest.mark.parametrize("local,part", [(0, 40), (20, 12)])
def test_percolation_of_states_larger_than_a_task(spark, local, part):
    """Cut into parts and blocks, every column is as a single task has it."""
    import random

    r = random.Random(local + part)
    rows = []
    for state, n, m in (("a", 40, 120), ("b", 200, 150), ("c", 9, 36), ("d", 2, 1)):
        pairs = set()
        while len(pairs) < min(m, n * (n - 1) // 2):
            a, b = r.sample(range(n), 2)
            pairs.add((min(a, b), max(a, b)))
        rows += [(state, a, b, float(r.randint(1, 30))) for a, b in pairs]
    df = spark.createDataFrame(rows, "state string, id1 long, id2 long, force double")
    ids = sorted({(x[0], i) for x in rows for i in x[1:3]})
    sides = spark.createDataFrame([(s, i, r.random() < 0.1, r.random() < 0.1, r.random() < 0.1) for s, i in ids], "state string, id long, bottom boolean, top boolean, side boolean")
    whole = {x["state"]: x.asDict() for x in net.percolation(df, ["state"], nodes=sides).collect()}
    cut = {x["state"]: x.asDict() for x in net.percolation(df, ["state"], nodes=sides, local=local, part=part).collect()}
    assert set(cut) == set(whole) == set("abcd")
    for k in whole:
        assert set(cut[k]) == set(whole[k])
        for c, v in whole[k].items():
            assert (cut[k][c] is None) == (v is None) and (v is None or cut[k][c] == pytest.approx(v)), (k, c)
    if local:
        curves = [sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in x) for x in net.filtration_curve(df, ["state"], **more).collect()) for more in ({}, {"local": local, "part": part})]
        assert curves[0] == curves[1] and len(curves[0]) == 32
