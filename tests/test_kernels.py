"""Array kernels and the grouped calls over them against plain computations and the paths by joins."""

from __future__ import annotations

import random

import numpy as np
import pytest

from cyclonet.operators import kernels
from cyclonet.operators import networks as net


def drawn(seed, n, m, loops=True):
    r = random.Random(seed)
    pairs = [(r.randrange(n), r.randrange(n)) for _ in range(m)]
    return [p for p in pairs if loops or p[0] != p[1]]


GRAPHS = [[], [(0, 0)], [(0, 1)], [(0, 1), (1, 0), (1, 1)], [(k, k + 1) for k in range(300)], [(0, k) for k in range(1, 300)], *(drawn(k, n, m) for k, (n, m) in enumerate([(6, 30), (40, 30), (200, 190), (200, 230), (300, 3000), (1000, 1100)]))]


def plain(pairs):
    """closes, giant and the tree's nodes after each edge."""
    tree, out, best = {x: {x} for p in pairs for x in p}, [], 1
    for x, y in pairs:
        closes = tree[x] is tree[y]
        if not closes:
            small, large = sorted((tree[x], tree[y]), key=len)
            large |= small
            for z in small:
                tree[z] = large
        best = max(best, len(tree[x]))
        out.append((closes, best, frozenset(tree[x])))
    return out


@pytest.mark.parametrize("pairs", GRAPHS)
def test_kernels_against_plain_trees(pairs):
    want = plain(pairs)
    ids, a, b = kernels.coded(np.array([p[0] for p in pairs], np.int64), np.array([p[1] for p in pairs], np.int64))
    n = len(ids)
    closes = kernels.closing(n, a, b)
    assert closes.tolist() == [w[0] for w in want]
    flags = np.array([1 << (i % 5) for i in ids.tolist()], np.int64)
    giant, touch = kernels.grown(n, a, b, closes, flags, each=True)
    assert giant.tolist() == [w[1] for w in want]
    mark = lambda nodes: int(np.bitwise_or.reduce([1 << (i % 5) for i in nodes]))
    assert touch.tolist() == [mark(w[2]) for w in want]
    last = {x: tree for tree in (w[2] for w in want) for x in tree}
    assert ids[kernels.components(n, a, b)].tolist() == [min(last[i]) for i in ids.tolist()]


@pytest.fixture(scope="module")
def states(spark):
    pairs = [(s, *p) for s, (k, n, m) in {"a": (1, 60, 240), "b": (2, 300, 310), "c": (3, 9, 200)}.items() for p in drawn(k, n, m)]
    pairs += [("d", 0, k) for k in range(1, 400)] + [("e", 5, 5)]
    return spark.createDataFrame(pairs, "state string, id1 long, id2 long")


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_cores_in_a_task_and_by_rounds(states):
    one, rounds = (rows(net.kcore(states, ["state"], local), "state", "node", "core") for local in (10_000, 0))
    assert one == rounds and {r[0] for r in one} == set("abcd")


def test_cores_take_few_jobs(spark, states):
    """By rounds each state took two written tables a round, and their tables of nodes went through the driver."""
    spark.sparkContext.setJobGroup("cores", "")
    net.kcore(states, ["state"]).collect()
    few = len(spark.sparkContext.statusTracker().getJobIdsForGroup("cores"))
    spark.sparkContext.setJobGroup("rest", "")
    assert few <= 8


@pytest.fixture(scope="module")
def valued(spark, states):
    r = random.Random(9)
    pairs = sorted({(x["state"], min(x["id1"], x["id2"]), max(x["id1"], x["id2"])) for x in states.collect() if x["id1"] != x["id2"]})
    return spark.createDataFrame([(*p, float(r.randint(1, 40))) for p in pairs], "state string, id1 long, id2 long, force double")


@pytest.fixture(scope="module")
def sided(spark, valued):
    r = random.Random(10)
    ids = sorted({(x["state"], i) for x in valued.collect() for i in (x["id1"], x["id2"])} | {("a", 5000), ("b", 5001)})
    return spark.createDataFrame([(s, i, r.random(), *(r.random() < 0.1 for _ in range(3))) for s, i in ids], "state string, id long, z double, bottom boolean, top boolean, side boolean")


def same(a, b):
    a, b = (sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect()), key=repr) for df in (a, b))
    assert a == b and a


def test_spanning_by_call_by_labels_and_by_joins(valued, sided):
    cols = ["state", "spanning_components", "bottom_side_components", "span", "boundary_edge_share"]
    one, labels, joins = (net.spanning(valued, ["state"], sided, local).select(cols) for local in (10_000, valued.groupBy("state").count().agg({"count": "max"}).first()[0], 0))
    same(one, joins)
    same(labels, joins)


def test_loops_per_state_in_a_task_and_by_joins(states):
    same(net.beta1(states, ["state"]), net.beta1(states, ["state"], local=0).select(net.beta1(states, ["state"]).columns))


def test_counts_of_written_contacts_take_few_jobs(spark, valued, sided):
    """By rounds a state took several written tables a round."""
    jobs = lambda name: len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
    for name, run in {"beta1": lambda: net.beta1(valued, ["state"]), "spanning": lambda: net.spanning(valued, ["state"], sided)}.items():
        spark.sparkContext.setJobGroup(name, "")
        run().collect()
        spark.sparkContext.setJobGroup("rest", "")
        assert jobs(name) <= 10


def test_neighbours_bring_their_columns(spark):
    """A pair is not shuffled for its ends' columns: no join follows the one that makes the pairs."""
    from cyclonet.operators import frames as fr

    r = random.Random(11)
    rows = [(s, i, r.random(), r.random(), r.random(), r.choice([0.02, 0.05])) for s in "ab" for i in range(150)]
    df = spark.createDataFrame(rows, "state string, id long, x double, y double, z double, radius double")
    got = fr.contact_overlap(df, ["state"])
    want = {}
    for p in rows:
        for q in rows:
            if p[0] == q[0] and p[1] < q[1]:
                dist = sum((p[k] - q[k]) ** 2 for k in (2, 3, 4)) ** 0.5
                if p[5] + q[5] - dist >= -0.004 * 0.1:
                    want[(p[0], p[1], q[1])] = (p[5], q[5], p[5] + q[5] - dist)
    assert {(x.state, x.id1, x.id2): (x.radius1, x.radius2, pytest.approx(x.overlap)) for x in got.collect()} == want and want
    joins = got._jdf.queryExecution().optimizedPlan().toString().count("Join")
    assert joins <= 5  # greatest radius, crowded cells (twice, with that of the greatest radius in each) and the pairs


def test_null_of_loops_alone_and_its_copies(spark, valued):
    full, loops = (net.force_shuffle_null(valued, ["state"], 5, giants=g) for g in (True, False))
    same(full.select("state", "rep", "loop_births", "loop_fraction", "loop_value_share"), loops.select("state", "rep", "loop_births", "loop_fraction", "loop_value_share"))
    assert loops.count() == 5 * valued.select("state").distinct().count()
    many = spark.range(2000).selectExpr("concat('s', id % 40) AS state", "id AS id1", "id + 1 AS id2", "double(id) AS force")
    assert "Generate" not in net.force_shuffle_null(many, ["state"], 24)._jdf.queryExecution().optimizedPlan().toString()


def test_curve_summary_in_a_task_and_by_joins(valued):
    one = net.curve_summary(valued, ["state"])
    same(one, net.curve_summary(valued, ["state"], local=0).select(one.columns))
