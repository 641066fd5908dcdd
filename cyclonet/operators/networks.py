"""Contact networks: one graph for each state (key), many states.

Degrees, components, loops, cores and triangles are joins and aggregations, so one state may be as large as the data.
So may it be where loop-closing edges are asked for (merged spanning forests).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import discard, materialize
from . import kernels

PART_EDGES, MERGE = 200_000, 8
TASK_EDGES = 2_500_000  # of a state that is one grouped call
BLOCKS = 4  # groups that a state's replicates are dealt over
MARKS = (0.01, 0.05, 0.10)
FRACTIONS = (0.01, 0.02, 0.05, 0.1, 0.2, 0.4, 0.8, 1.0)


def incidence(edges: DataFrame, keys: list[str], values: list[str] = ()) -> DataFrame:
    """Each edge from both ends: node, other."""
    ends = F.array(F.struct(F.col("id1").alias("node"), F.col("id2").alias("other")), F.struct(F.col("id2").alias("node"), F.col("id1").alias("other")))
    return edges.select(*keys, *values, F.inline(ends))


def degrees(edges: DataFrame, keys: list[str], nodes: DataFrame | None = None) -> DataFrame:
    """keys, node, degree; nodes of the node table without an edge have degree 0."""
    d = incidence(edges, keys).groupBy(*keys, "node").agg(F.count("*").alias("degree"))
    if nodes is None:
        return d
    return nodes.select(*keys, F.col("id").alias("node")).distinct().join(d, [*keys, "node"], "left").fillna(0, ["degree"])


def degree_stats(edges: DataFrame, keys: list[str], nodes: DataFrame | None = None, low: int = 3) -> DataFrame:
    """Nodes, mean degree, population variance, variance over mean, nodes of degree 0 and the share below `low`."""
    d = degrees(edges, keys, nodes)
    out = d.groupBy(*keys).agg(
        F.count("*").alias("nodes"), F.avg("degree").alias("z_mean"), F.var_pop("degree").alias("z_var"),
        F.sum((F.col("degree") == 0).cast("long")).alias("rattlers"), F.avg((F.col("degree") < low).cast("double")).alias("low_share"),
    )
    return out.withColumn("var_over_mean", F.when(F.col("z_mean") > 0, F.col("z_var") / F.col("z_mean")))


def _local_labels(edges: DataFrame, keys: list[str], ends: tuple[str, str] = ("a", "b")) -> DataFrame:
    """keys, node, root (the least node of its component) for states of few edges, one grouped call each."""

    def run(id1: np.ndarray, id2: np.ndarray) -> dict[str, np.ndarray]:
        ids, a, b = kernels.coded(id1, id2)
        return {"node": ids, "root": ids[kernels.components(len(ids), a, b)]}

    kind = edges.schema[ends[0]].dataType.simpleString()
    return grouped(edges, keys, list(ends), f"node {kind}, root {kind}", run)


def _jumped(parent: DataFrame, keys: list[str]) -> DataFrame:
    """keys, node, root of a forest given by keys, node, parent, whose only cycles are of two nodes or one.

    Of two nodes that point to each other the lesser becomes the root; then every node takes its parent's parent until
    none changes, so the steps grow with the logarithm of the depth.
    """
    up = lambda p: p.select(*keys, F.col("node").alias("parent"), F.col("parent").alias("_up"))
    first = parent.join(up(parent), [*keys, "parent"])
    first = first.withColumn("_new", F.when(F.col("_up") == F.col("node"), F.least("node", "parent")).otherwise(F.col("_up")))
    now = materialize(first.select(*keys, "node", F.col("_new").alias("parent")))
    while True:
        new = materialize(now.join(up(now), [*keys, "parent"]).select(*keys, "node", F.col("_up").alias("parent"), (F.col("_up") != F.col("parent")).alias("_moved")))
        discard(now)
        now = new.select(*keys, "node", "parent")
        if new.filter("_moved").isEmpty():
            return now.withColumnRenamed("parent", "root")


def component_labels(edges: DataFrame, keys: list[str], nodes: DataFrame | None = None, local: int = TASK_EDGES, trace: list | None = None) -> DataFrame:
    """keys, node, component: the least node id of its component. Isolated nodes of the node table are their own.

    States are one grouped call each while the largest has at most `local` edges. Beyond that, every node takes its edge of least hash;
    these edges are trees of two nodes or more, each tree becomes one node, and edges inside a tree and repeated edges go.
    So a round leaves at most half of the nodes that have edges, whatever the diameter, and the rounds' sizes add up to
    a few times the input. Hash order keeps the trees shallow. trace: gets (edges) of each round, for tests.
    """
    if trace is None and _most(edges, keys) <= local:
        label = _local_labels(edges, keys, ("id1", "id2")).withColumnRenamed("root", "component")
        if nodes is None:
            return label
        every = nodes.select(*keys, F.col("id").alias("node")).distinct()
        return every.join(label, [*keys, "node"], "full").withColumn("component", F.coalesce("component", "node"))
    pair = edges.filter("id1 <> id2").select(*keys, F.least("id1", "id2").alias("a"), F.greatest("id1", "id2").alias("b"))
    left, maps = materialize(pair.distinct()), []
    while True:
        sizes = left.groupBy(*keys).agg(F.count("*").alias("_n"))
        most = sizes.agg(F.max("_n")).first()[0] or 0
        if trace is not None:
            trace.append(most)
        if most <= local or most == 0:
            break
        ends = left.select(*keys, F.inline(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("parent")), F.struct(F.col("b").alias("node"), F.col("a").alias("parent")))))
        hashed = F.xxhash64(F.least("node", "parent"), F.greatest("node", "parent"), F.lit(len(maps)))
        picked = materialize(ends.groupBy(*keys, "node").agg(F.min(F.struct(hashed, F.least("node", "parent"), "parent")).alias("_m")).select(*keys, "node", "_m.parent"))
        roots = _jumped(picked, keys)
        discard(picked)
        for end in ("a", "b"):
            named = roots.withColumnsRenamed({"node": end, "root": f"_{end}"})
            left = left.join(named, [*keys, end])
        left = materialize(left.filter("_a <> _b").select(*keys, F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct())
        maps.append(roots)
    label = _local_labels(left, keys)
    for roots in reversed(maps):  # a root without an edge in the next round is its component's own
        later = label.select(*keys, F.col("root").alias("_later"), F.col("node").alias("root"))
        label = materialize(roots.join(later, [*keys, "root"], "left").select(*keys, "node", F.coalesce("_later", "root").alias("root")))
        discard(roots)
    every = edges.select(*keys, F.explode(F.array("id1", "id2")).alias("node"))
    if nodes is not None:
        every = every.unionByName(nodes.select(*keys, F.col("id").alias("node")))
    label = materialize(every.distinct().join(label, [*keys, "node"], "left").withColumn("root", F.coalesce("root", "node")))
    least = label.groupBy(*keys, "root").agg(F.min("node").alias("component"))
    return label.join(least, [*keys, "root"]).select(*keys, "node", "component")


def _counts(edges: DataFrame, keys: list[str]) -> DataFrame:
    """keys, edges (distinct), nodes, components and giant_share of states that are one grouped call each."""

    def run(id1: np.ndarray, id2: np.ndarray) -> dict[str, np.ndarray]:
        ids, a, b = kernels.coded(id1, id2)
        root, n = kernels.components(len(ids), a, b), len(ids)
        sizes = np.bincount(root, minlength=n)
        pairs = kernels.distinct(a.astype(np.int64) * n + b)
        return {"edges": np.array([len(pairs)]), "nodes": np.array([n]), "components": np.array([(sizes > 0).sum()]), "giant_share": np.array([sizes.max() / n])}

    return grouped(edges, keys, ["id1", "id2"], "edges long, nodes long, components long, giant_share double", run)


def components(edges: DataFrame, keys: list[str], nodes: DataFrame | None = None, local: int = TASK_EDGES) -> DataFrame:
    """Nodes, components and the giant component's share of the nodes, per state."""
    if nodes is None and _most(edges, keys) <= local:
        return _counts(edges, keys).drop("edges")
    sizes = component_labels(edges, keys, nodes, local).groupBy(*keys, "component").agg(F.count("*").alias("_n"))
    return sizes.groupBy(*keys).agg(F.sum("_n").alias("nodes"), F.count("*").alias("components"), (F.max("_n") / F.sum("_n")).alias("giant_share"))


def beta1(edges: DataFrame, keys: list[str], nodes: DataFrame | None = None, local: int = TASK_EDGES) -> DataFrame:
    """Independent loops E - N + C, per node and per edge."""
    if nodes is None and _most(edges, keys) <= local:
        out = _counts(edges, keys)
    else:
        e = edges.select(*keys, "id1", "id2").distinct().groupBy(*keys).agg(F.count("*").alias("edges"))
        out = components(edges, keys, nodes, local).join(e, keys, "left").fillna(0, ["edges"])
    out = out.withColumn("loops", F.col("edges") - F.col("nodes") + F.col("components"))
    return out.withColumns({"loops_per_node": F.col("loops") / F.col("nodes"), "loops_per_edge": F.when(F.col("edges") > 0, F.col("loops") / F.col("edges"))})


def spanning(edges: DataFrame, keys: list[str], nodes: DataFrame, local: int = TASK_EDGES) -> DataFrame:
    """Components that touch bottom and top, and bottom and side; the greatest z span of a component over the state's
    height; the share of edges with an end on the bottom or the side. nodes: id, z and the flags bottom, top, side.

    States of at most `local` edges and nodes together are one grouped call each, to which nodes come as rows of their own.
    With at most `local` edges a call gives each node its component, and the share of edges, for which the nodes on bottom
    and side come to it; nodes are joined to that. Beyond, all is joins."""
    most = _most(edges, keys)
    if most + _most(nodes, keys) <= local:
        of_nodes = nodes.select(*keys, F.col("id").alias("id1"), F.col("id").alias("id2"), F.col("z").cast("double").alias("_z"), _bits(("bottom", "top", "side")).alias("_f"))
        both = edges.select(*keys, "id1", "id2", F.lit(None).cast("double").alias("_z"), F.lit(-1).alias("_f")).unionByName(of_nodes)
        return grouped(both, keys, ["id1", "id2", "_z", "_f"], "spanning_components long, bottom_side_components long, span double, boundary_edge_share double", _spans)
    if most <= local:
        marks = nodes.filter(F.col("bottom") | F.col("side")).select(*keys, F.col("id").alias("id1"), F.col("id").alias("id2"), F.lit(1).alias("_f"))
        kind = edges.schema["id1"].dataType.simpleString()
        labels = grouped(edges.select(*keys, "id1", "id2", F.lit(0).alias("_f")).unionByName(marks), keys, ["id1", "id2", "_f"], f"id {kind}, component {kind}, _share double", _bordered)
        c = nodes.join(labels, [*keys, "id"], "left").withColumn("component", F.coalesce("component", "id"))
        sided = [F.max(f).alias(f) for f in ("bottom", "top", "side", "_share")]
        per = c.groupBy(*keys, "component").agg(*sided, F.min("z").alias("_lo"), F.max("z").alias("_hi"))
        height = F.max("_hi") - F.min("_lo")
        both = lambda a, b: F.sum((F.col(a) & F.col(b)).cast("long"))
        return per.groupBy(*keys).agg(both("bottom", "top").alias("spanning_components"), both("bottom", "side").alias("bottom_side_components"), F.when(height > 0, F.max(F.col("_hi") - F.col("_lo")) / height).alias("span"), F.max("_share").alias("boundary_edge_share"))
    c = component_labels(edges, keys, nodes, local).join(nodes.withColumnRenamed("id", "node"), [*keys, "node"])
    per = c.groupBy(*keys, "component").agg(*(F.max(f).alias(f) for f in ("bottom", "top", "side")), (F.max("z") - F.min("z")).alias("_span"))
    height = nodes.groupBy(*keys).agg((F.max("z") - F.min("z")).alias("_height"))
    flagged = _flagged(edges.select(*keys, "id1", "id2").distinct(), nodes, keys, ("bottom", "side"))
    border = flagged.groupBy(*keys).agg(F.avg(((F.col("_f1") > 0) | (F.col("_f2") > 0)).cast("double")).alias("boundary_edge_share"))
    both = lambda a, b: F.sum((F.col(a) & F.col(b)).cast("long"))
    out = per.groupBy(*keys).agg(both("bottom", "top").alias("spanning_components"), both("bottom", "side").alias("bottom_side_components"), F.max("_span").alias("_s")).join(height, keys).join(border, keys, "left")
    return out.select(*keys, "spanning_components", "bottom_side_components", F.when(F.col("_height") > 0, F.col("_s") / F.col("_height")).alias("span"), "boundary_edge_share")


def _spans(id1: np.ndarray, id2: np.ndarray, z: np.ndarray, f: np.ndarray) -> dict[str, np.ndarray]:
    """The row of `spanning`; f: the sides (bits) of nodes, -1 for edges."""
    edge = f < 0
    node, z, bits = id1[~edge], z[~edge], f[~edge].astype(np.int32)
    if not len(node):
        return {"spanning_components": np.empty(0, np.int64), "bottom_side_components": np.empty(0, np.int64), "span": np.empty(0), "boundary_edge_share": np.empty(0)}
    a, b = id1[edge], id2[edge]
    ids = kernels.distinct(a, b, node)
    n = len(ids)
    a, b, node = (np.searchsorted(ids, x).astype(np.int32) for x in (a, b, node))
    root = kernels.components(n, a, b)
    low, high, sides, own = np.full(n, np.nan), np.full(n, np.nan), np.zeros(n, np.int32), np.zeros(n, np.int32)
    np.fmin.at(low, root[node], z)
    np.fmax.at(high, root[node], z)
    np.bitwise_or.at(sides, root[node], bits)
    np.bitwise_or.at(own, node, bits)
    height = np.fmax.reduce(z) - np.fmin.reduce(z)
    pair = kernels.distinct(a.astype(np.int64) * n + b)
    border = (own[pair // n] | own[pair % n]) & 0b101
    row = {name: int(((sides & bits) == bits).sum()) for name, bits in (("spanning_components", 0b011), ("bottom_side_components", 0b101))}
    return {k: np.array([v]) for k, v in row.items()} | {"span": np.array([np.fmax.reduce(high - low) / height if height > 0 else np.nan]), "boundary_edge_share": np.array([(border > 0).mean() if len(pair) else np.nan])}


def _bordered(id1: np.ndarray, id2: np.ndarray, f: np.ndarray) -> dict[str, np.ndarray]:
    """Each node of the edges (f 0) with its component, and the share of distinct edges with an end among the marked (f 1)."""
    marked, id1, id2 = id1[f > 0], id1[f == 0], id2[f == 0]
    ids, a, b = kernels.coded(id1, id2)
    n, on = len(ids), np.isin(ids, marked)
    pair = kernels.distinct(a.astype(np.int64) * n + b)
    share = (on[pair // n] | on[pair % n]).mean() if n else np.nan
    return {"id": ids, "component": ids[kernels.components(n, a, b)], "_share": np.full(n, share)}


def _most(edges: DataFrame, keys: list[str]) -> int:
    """Edges of the largest state."""
    return edges.groupBy(*keys).agg(F.count("*").alias("_n")).agg(F.max("_n")).first()[0] or 0


def grouped(df: DataFrame, keys: list[str], columns: list[str], schema: str, run: Callable[..., dict[str, np.ndarray]]) -> DataFrame:
    """One grouped Arrow call for each state: run gets the listed columns as arrays and returns the columns of the schema,
    arrays of equal length; NaN becomes null."""

    def call(t: pa.Table) -> pa.Table:
        state = {k: t.column(k)[0] for k in keys}
        out = run(*(t.column(c).to_numpy() for c in columns))
        n = len(next(iter(out.values())))
        return pa.table({k: pa.repeat(v, n) for k, v in state.items()} | {c: pa.array(v, from_pandas=True) for c, v in out.items()})

    return df.select(*keys, *columns).groupBy(*keys).applyInArrow(call, f"{_types(df, keys)}, {schema}")


def per_edge(df: DataFrame, keys: list[str], columns: list[str], schema: str, run: Callable[..., dict[str, np.ndarray]]) -> DataFrame:
    """As `grouped`, with the columns of the schema added to the group's rows."""

    def call(t: pa.Table) -> pa.Table:
        for c, v in run(*(t.column(c).to_numpy() for c in columns)).items():
            t = t.append_column(c, pa.array(v))
        return t

    return df.groupBy(*keys).applyInArrow(call, f"{_types(df, df.columns)}, {schema}")


def _filtered(id1: np.ndarray, id2: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, ...]:
    """ids, codes a and b, the order by falling value, and does an edge close a loop (in the order of the rows)?"""
    ids, a, b = kernels.coded(id1, id2)
    order, closes = kernels.descending(a, b, v), np.empty(len(a), bool)
    closes[order] = kernels.closing(len(ids), a[order], b[order])
    return ids, a, b, order, closes


def kcore(edges: DataFrame, keys: list[str], local: int = TASK_EDGES) -> DataFrame:
    """keys, node, core.

    States are one grouped call each while the largest has at most `local` edges. Beyond that: rounds of the h-index of
    the neighbours' values, which end at the core numbers. The h-index comes from counts of the neighbours' values, capped
    at the node's own: a hub's neighbours are summed before they are shuffled, and what is left of them is one row a value.
    No table of nodes is broadcast, for it would pass through the driver.
    """
    if _most(edges, keys) <= local:

        def run(id1: np.ndarray, id2: np.ndarray) -> dict[str, np.ndarray]:
            apart = id1 != id2
            ids, a, b = kernels.coded(id1[apart], id2[apart])
            pair = np.unique(np.minimum(a, b).astype(np.int64) * len(ids) + np.maximum(a, b))
            return {"node": ids, "core": kernels.cores(len(ids), pair // max(1, len(ids)), pair % max(1, len(ids)))}

        return grouped(edges, keys, ["id1", "id2"], f"node {edges.schema['id1'].dataType.simpleString()}, core long", run)
    both = materialize(incidence(edges.filter("id1 <> id2").select(*keys, F.least("id1", "id2").alias("id1"), F.greatest("id1", "id2").alias("id2")).distinct(), keys))
    core = materialize(both.groupBy(*keys, "node").agg(F.count("*").alias("core")))
    while True:
        own = core.withColumnRenamed("core", "_own")
        near = both.join(core.withColumnsRenamed({"node": "other", "core": "_c"}).hint("merge"), [*keys, "other"]).join(own.hint("merge"), [*keys, "node"])
        counts = near.groupBy(*keys, "node", "_own", F.least("_c", "_own").alias("_v")).agg(F.count("*").alias("_k"))
        at_least = F.sum("_k").over(Window.partitionBy(*keys, "node").orderBy(F.col("_v").desc()))
        h = counts.withColumn("_h", F.least("_v", at_least)).groupBy(*keys, "node", "_own").agg(F.max("_h").alias("core"))
        new = materialize(h.select(*keys, "node", F.col("_own").alias("_was"), "core"))
        discard(core)
        core = new.select(*keys, "node", "core")
        if new.filter("_was <> core").isEmpty():
            discard(both)
            return core


def kcore_stats(edges: DataFrame, keys: list[str]) -> DataFrame:
    c = kcore(edges, keys)
    return c.groupBy(*keys).agg(F.avg("core").alias("core_mean"), F.max("core").alias("core_max"), F.avg((F.col("core") >= 4).cast("double")).alias("core4_share"), F.avg((F.col("core") >= 5).cast("double")).alias("core5_share"))


def triangles(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Triangles, wedges, triangles a node (density) and transitivity per state; edges are directed from the lower-degree end, so hubs fan out little."""
    e = edges.select(*keys, F.least("id1", "id2").alias("id1"), F.greatest("id1", "id2").alias("id2")).filter("id1 <> id2").distinct()
    d = degrees(e, keys)
    for k in "12":
        e = e.join(d.withColumnsRenamed({"node": f"id{k}", "degree": f"_d{k}"}), [*keys, f"id{k}"])
    up = (F.col("_d1") < F.col("_d2")) | ((F.col("_d1") == F.col("_d2")) & (F.col("id1") < F.col("id2")))
    o = e.select(*keys, F.when(up, F.col("id1")).otherwise(F.col("id2")).alias("a"), F.when(up, F.col("id2")).otherwise(F.col("id1")).alias("b"))
    two = o.join(o.withColumnRenamed("b", "c"), [*keys, "a"]).filter("b < c")
    close = e.select(*keys, F.col("id1").alias("b"), F.col("id2").alias("c"))
    t = two.join(close, [*keys, "b", "c"]).groupBy(*keys).agg(F.count("*").alias("triangles"))
    wedges = d.groupBy(*keys).agg(F.sum(F.col("degree") * (F.col("degree") - 1) / 2).cast("long").alias("wedges"), F.count("*").alias("_nodes"))
    out = wedges.join(t, keys, "left").fillna(0, ["triangles"])
    return out.withColumn("density", F.col("triangles") / F.col("_nodes")).drop("_nodes").withColumn("transitivity", F.when(F.col("wedges") > 0, 3 * F.col("triangles") / F.col("wedges")))


def backbone(contacts: DataFrame, keys: list[str], q: float = 0.9, force: str = "force", nodes: DataFrame | None = None, low: float = 0.02, high: float = 0.98) -> DataFrame:
    """The sub-network at or above the state's force quantile: edges, their share of all, nodes, components; nodes and edges
    of the largest component (of equal ones that of the least node).

    With nodes (id, x, y, z): the largest component's z span, over the height of all nodes too, and whether it touches the
    lowest and highest share of z and the highest of the distance from the axis.
    """
    cut = contacts.groupBy(*keys).agg(F.expr(f"percentile({force}, {q})").alias("_q"), F.count("*").alias("_all"))
    strong = materialize(contacts.join(cut, keys).filter(F.col(force) >= F.col("_q")).select(*keys, "id1", "id2", "_all"))
    labels = materialize(component_labels(strong, keys))
    edges = strong.join(labels.withColumnRenamed("node", "id1"), [*keys, "id1"]).groupBy(*keys, "component").agg(F.count("*").alias("_e"), F.max("_all").alias("_all"))
    sizes = labels.groupBy(*keys, "component").agg(F.count("*").alias("_n")).join(edges, [*keys, "component"])
    largest = F.max(F.struct("_n", (-F.col("component")).alias("_c"), "_e"))
    out = sizes.groupBy(*keys).agg(F.sum("_e").alias("edges"), (F.sum("_e") / F.max("_all")).alias("edge_share"), F.sum("_n").alias("nodes"), F.count("*").alias("components"), largest.alias("_l"))
    out = out.select(*keys, "edges", "edge_share", "nodes", "components", F.col("_l._n").alias("largest"), F.col("_l._e").alias("largest_edges"), (-F.col("_l._c")).alias("_component"))
    if nodes is None:
        return out.drop("_component")
    r = F.sqrt(F.col("x") ** 2 + F.col("y") ** 2)
    bed = nodes.select(*keys, F.col("id").alias("node"), "z", r.alias("_r"))
    cuts = bed.groupBy(*keys).agg(F.expr(f"percentile(z, {low})").alias("_lo"), F.expr(f"percentile(z, {high})").alias("_hi"), F.expr(f"percentile(_r, {high})").alias("_rh"), (F.max("z") - F.min("z")).alias("_height"))
    inside = labels.join(out.select(*keys, F.col("_component").alias("component")), [*keys, "component"]).join(bed, [*keys, "node"]).join(cuts, keys)
    touch = {"touches_bottom": F.col("z") <= F.col("_lo"), "touches_top": F.col("z") >= F.col("_hi"), "touches_side": F.col("_r") >= F.col("_rh")}
    span = F.max("z") - F.min("z")
    more = inside.groupBy(*keys).agg(span.alias("z_span"), F.when(F.max("_height") > 0, span / F.max("_height")).alias("z_span_norm"), *(F.max(v).alias(k) for k, v in touch.items()))
    return out.drop("_component").join(more, keys, "left")


class Forest:
    """Union-find over nodes 0 .. n-1 with sizes and side flags of each tree."""

    def __init__(self, n: int, flags: np.ndarray | None = None):
        self.parent = list(range(n))
        self.size = [1] * n
        self.flags = flags.tolist() if flags is not None else [0] * n

    def root(self, x: int) -> int:
        p = self.parent
        while p[x] != x:
            p[x] = x = p[p[x]]
        return x

    def link(self, a: int, b: int) -> tuple[bool, int]:
        """(were they joined already, root of the tree they are in now)."""
        a, b = self.root(a), self.root(b)
        if a == b:
            return True, a
        if self.size[a] < self.size[b]:
            a, b = b, a
        self.parent[b] = a
        self.size[a] += self.size[b]
        self.flags[a] |= self.flags[b]
        return False, a


def _types(df: DataFrame, cols: list[str]) -> str:
    return ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in cols)


def _bits(sides: tuple[str, ...]) -> Column:
    return sum(F.when(F.col(c), 1 << i).otherwise(0) for i, c in enumerate(sides)).cast("int")


def _flagged(contacts: DataFrame, nodes: DataFrame, keys: list[str], sides: tuple[str, ...]) -> DataFrame:
    """contacts with _f1 and _f2, the sides (bits) that either end is on; ends that nodes lacks are on none."""
    ends = nodes.select(*keys, "id", _bits(sides).alias("_f"))
    for k in "12":
        contacts = contacts.join(ends.withColumnsRenamed({"id": f"id{k}", "_f": f"_f{k}"}), [*keys, f"id{k}"], "left").fillna(0, [f"_f{k}"])
    return contacts


def _flags(n: int, a: np.ndarray, b: np.ndarray, f1: np.ndarray, f2: np.ndarray) -> np.ndarray:
    """The sides (bits) of each node, from the edges' ends."""
    flags = np.zeros(n, np.int32)
    flags[a], flags[b] = f1, f2
    return flags


def loop_edges(contacts: DataFrame, keys: list[str], value: str = "force", more: tuple[str, ...] = ()) -> DataFrame:
    """Each edge with closes: are its ends joined by greater edges already? By maximum spanning forests, merged in a tree.

    A state of more than PART_EDGES edges is dealt into parts. An edge that closes a loop within any set of the state's
    edges closes one in the whole, so each part hands on only its forest, a few parts' forests meet in the next round,
    and what stays to the end closes nothing. No task holds more than PART_EDGES edges or MERGE forests of a state.
    """
    columns = ["id1", "id2", value, *more]

    def run(id1: np.ndarray, id2: np.ndarray, v: np.ndarray) -> dict[str, np.ndarray]:
        return {"closes": _filtered(id1, id2, v)[-1]}

    part = F.pmod(F.xxhash64("id1", "id2"), F.ceil(F.col("_n") / F.lit(PART_EDGES)))
    sizes = contacts.groupBy(*keys).agg(F.count("*").alias("_n"))
    left = contacts.select(*keys, *columns).join(sizes, keys).withColumn("_part", part.cast("long")).drop("_n")
    closed: list[DataFrame] = []
    while True:
        done = per_edge(left.select(*keys, "_part", *columns), [*keys, "_part"], ["id1", "id2", value], "closes boolean", run)
        if not closed:
            # With one part a state there is nothing to merge, and nothing to write.
            if (sizes.agg(F.max("_n")).first()[0] or 0) <= PART_EDGES:
                return done.drop("_part")
        done = materialize(done)
        closed.append(done.filter("closes"))
        left = done.filter("NOT closes").drop("closes")
        if (left.agg(F.max("_part")).first()[0] or 0) == 0:
            return reduce(DataFrame.unionByName, [*closed, left.withColumn("closes", F.lit(False))]).drop("_part")
        left = left.withColumn("_part", F.floor(F.col("_part") / MERGE))


def filtration_edges(contacts: DataFrame, keys: list[str], value: str = "force", nodes: DataFrame | None = None, sides: tuple[str, ...] = ("bottom", "top")) -> DataFrame:
    """Each edge with its rank by descending value, its edge fraction, and whether it closes a loop at its insertion.

    With nodes, also touches_<side>: whether the tree that it joins or closes then has a node on that side; that needs
    the trees as they grow, so a state is then one task.
    """
    if nodes is None:
        w = Window.partitionBy(*keys)
        ranked = loop_edges(contacts, keys, value).withColumn("rank", F.row_number().over(w.orderBy(F.col(value).desc(), "id1", "id2")).cast("long"))
        return ranked.withColumn("fraction", F.col("rank") / F.count("*").over(w)).select(*keys, "id1", "id2", value, "rank", "fraction", "closes")
    flags = tuple(f"touches_{c}" for c in sides)

    def run(id1: np.ndarray, id2: np.ndarray, v: np.ndarray, f1: np.ndarray, f2: np.ndarray) -> dict[str, np.ndarray]:
        ids, a, b, order, closes = _filtered(id1, id2, v)
        rank, touch = np.empty(len(a), np.int64), np.empty(len(a), np.int32)
        rank[order] = np.arange(1, len(a) + 1)
        touch[order] = kernels.grown(len(ids), a[order], b[order], closes[order], _flags(len(ids), a, b, f1, f2), each=True)[1]
        return {"rank": rank, "fraction": rank / len(a), "closes": closes} | {c: (touch >> i & 1).astype(bool) for i, c in enumerate(flags)}

    flagged = _flagged(contacts.select(*keys, "id1", "id2", value), nodes, keys, sides).select(*keys, "id1", "id2", value, "_f1", "_f2")
    more = ", ".join(["rank long, fraction double, closes boolean", *(f"{c} boolean" for c in flags)])
    return per_edge(flagged, keys, ["id1", "id2", value, "_f1", "_f2"], more, run).drop("_f1", "_f2")


def percolation_row(v: np.ndarray, closes: np.ndarray, giant: np.ndarray, n: int) -> dict:
    """Of a state's n nodes and its edges by falling value: their values, do they close a loop, the largest tree so far."""
    m, total = len(v), v.sum()
    row = loop_row(v, closes) | {"contacts": m, "value_sum": total, "value_mean": v.mean(), "value_p99": float(np.percentile(v, 99))}
    for p in MARKS:
        k = int(np.argmax(np.arange(1, m + 1) / m >= p))
        row |= {f"giant_top{round(100 * p)}": giant[k] / n, f"share_top{round(100 * p)}": v[: k + 1].sum() / total if total else np.nan}
    half = np.flatnonzero(giant >= 0.5 * n)
    row["giant_half_fraction"] = (half[0] + 1) / m if len(half) else np.nan
    return row


def loop_row(v: np.ndarray, closes: np.ndarray) -> dict:
    total = v.sum()
    return {"loop_births": int(closes.sum()), "loop_fraction": closes.mean(), "loop_value_share": v[closes].sum() / total if total else np.nan}


LOOPS = "loop_births long, loop_fraction double, loop_value_share double"
PERCOLATION = "contacts long, value_sum double, value_mean double, value_p99 double, loop_births long, loop_fraction double, loop_value_share double, " + ", ".join(f"giant_top{round(100 * p)} double, share_top{round(100 * p)} double" for p in MARKS) + ", giant_half_fraction double"


#: Columns of the first edge fraction at which one tree touches two sides, and the bits of (bottom, top, side).
TOUCHING = {"bottom_top": 0b011, "bottom_side": 0b101}


def _one(row: dict) -> dict[str, np.ndarray]:
    return {k: np.array([v]) for k, v in row.items()}


def percolation(contacts: DataFrame, keys: list[str], value: str = "force", nodes: DataFrame | None = None, local: int = TASK_EDGES, part: int = PART_EDGES) -> DataFrame:
    """One row a state: totals, giant and value shares after the top edges, loop births and their share of the value.

    With nodes (id and the flags bottom, top, side) also the edge fractions at which one tree first touches bottom and top,
    and bottom and side (null: never). States are one grouped call each while the largest has at most `local` edges, and the
    nodes on a side come to it as rows of their own; beyond that, trees grow by joins over blocks of `part` edges
    (`mergetree`), with the same results.
    """
    sides = ("bottom", "top", "side")
    flagged = contacts.select(*keys, "id1", "id2", value)
    pairs = {} if nodes is None else TOUCHING
    if _most(contacts, keys) > local:
        from . import mergetree

        flagged = flagged.withColumns({"_f1": F.lit(0), "_f2": F.lit(0)}) if nodes is None else _flagged(flagged, nodes, keys, sides)
        return mergetree.percolation_rows(mergetree.filtration_trees(flagged, keys, value, min(local, PART_EDGES), part), keys, value, MARKS, pairs)
    flagged = flagged.withColumn(value, F.col(value).cast("double"))
    schema = PERCOLATION + "".join(f", {name} double" for name in pairs)
    columns = [c.split()[0] for c in schema.split(", ")]
    if pairs:
        marks = nodes.select(*keys, F.col("id").alias("id1"), F.col("id").alias("id2"), F.lit(None).cast("double").alias(value), _bits(sides).alias("_f"))
        flagged = flagged.withColumn("_f", F.lit(0)).unionByName(marks.filter("_f <> 0"))

    def run(id1: np.ndarray, id2: np.ndarray, v: np.ndarray, f: np.ndarray | None = None) -> dict[str, np.ndarray]:
        sided = np.flatnonzero(f) if f is not None else np.empty(0, int)
        side_ids, bits = id1[sided], f[sided] if f is not None else None
        if len(sided):
            edge = f == 0
            id1, id2, v = id1[edge], id2[edge], v[edge]
        if not len(id1):
            return {c: np.empty(0, np.int64 if f"{c} long" in schema else float) for c in columns}
        ids, a, b, order, closes = _filtered(id1, id2, v)
        n, flags = len(ids), None
        if pairs:
            flags = np.zeros(n, np.int32)
            at = np.minimum(np.searchsorted(ids, side_ids), n - 1)
            known = ids[at] == side_ids
            np.bitwise_or.at(flags, at[known], bits[known])
        a, b, v, closes = a[order], b[order], v[order], closes[order]
        giant, touch = kernels.grown(n, a, b, closes, flags)
        first = {name: np.flatnonzero((touch & both) == both) for name, both in pairs.items()}
        row = percolation_row(v, closes, giant, n) | {name: (at[0] + 1) / len(v) if len(at) else np.nan for name, at in first.items()}
        return _one({c: row[c] for c in columns})

    return grouped(flagged, keys, ["id1", "id2", value, *(["_f"] if pairs else [])], schema, run)


def spanning_percolation(contacts: DataFrame, nodes: DataFrame, keys: list[str], sides: tuple[str, str] = ("bottom", "top"), value: str = "force") -> DataFrame:
    """Edge fraction at which one tree first touches both sides (null: never); node flags join the edges beforehand."""

    def run(id1: np.ndarray, id2: np.ndarray, v: np.ndarray, f1: np.ndarray, f2: np.ndarray) -> dict[str, np.ndarray]:
        ids, a, b, order, closes = _filtered(id1, id2, v)
        touch = kernels.grown(len(ids), a[order], b[order], closes[order], _flags(len(ids), a, b, f1, f2))[1]
        hit = np.flatnonzero(touch == 3)
        return _one({"span_fraction": (hit[0] + 1) / len(a) if len(hit) else np.nan})

    return grouped(_flagged(contacts.select(*keys, "id1", "id2", value), nodes, keys, sides), keys, ["id1", "id2", value, "_f1", "_f2"], "span_fraction double", run)


CURVE = ("loop_rate", "loop_share", "loop_total_share", "giant_share", "value_share")


FIRST = ("first_loop_fraction", "first_loop_value_share")


def _curves(contacts: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The curve of states that are one grouped call each, with the edge and value fraction at the first loop."""

    def run(id1: np.ndarray, id2: np.ndarray, v: np.ndarray) -> dict[str, np.ndarray]:
        ids, a, b, order, closes = _filtered(id1, id2, v)
        m, n = len(v), len(ids)
        v, closes = v[order], closes[order]
        giant = kernels.grown(n, a[order], b[order], closes)[0]
        k = np.maximum(1, np.ceil(np.array(FRACTIONS) * m).astype(int)) - 1
        births, loops, added = np.cumsum(closes), np.cumsum(np.where(closes, v, 0.0)), np.cumsum(v)
        first = int(np.argmax(closes))
        share = v[: first + 1].sum() / v.sum() if v.sum() else np.nan
        of_first = ((first + 1) / m, share) if closes[first] else (np.nan, np.nan)
        return {
            "fraction": np.array(FRACTIONS), "loop_rate": births[k] / (k + 1), "loop_share": loops[k] / np.maximum(added[k], 1e-300), "loop_total_share": loops[k] / added[-1], "giant_share": giant[k] / n,
            "value_share": added[k] / added[-1], **{c: np.full(len(k), x) for c, x in zip(FIRST, of_first, strict=True)},
        }

    return grouped(contacts.withColumn(value, F.col(value).cast("double")), keys, ["id1", "id2", value], ", ".join(f"{c} double" for c in ("fraction", *CURVE, *FIRST)), run)


def filtration_curve(contacts: DataFrame, keys: list[str], value: str = "force", local: int = TASK_EDGES, part: int = PART_EDGES) -> DataFrame:
    """Long form over edge fractions: loop births per rank, the loops' share of the value so far and of all of it, giant
    share, added value share. As in `percolation`, states are one grouped call each up to `local` edges; beyond, joins."""
    if _most(contacts, keys) > local:
        from . import mergetree

        plain = contacts.select(*keys, "id1", "id2", value).withColumns({"_f1": F.lit(0), "_f2": F.lit(0)})
        return mergetree.curve_rows(mergetree.filtration_trees(plain, keys, value, min(local, PART_EDGES), part), keys, value, FRACTIONS)
    return _curves(contacts, keys, value).drop(*FIRST)


def curve_summary(contacts: DataFrame, keys: list[str], value: str = "force", local: int = TASK_EDGES) -> DataFrame:
    """Per state: edge and value fraction at the first loop (null: none), the areas under the curves of loop rate, loop
    value and giant share over the edge fractions, and the value share of the top 5 % of edges."""
    whole = _most(contacts, keys) <= local
    curve = materialize(_curves(contacts, keys, value) if whole else filtration_curve(contacts, keys, value, local))
    step = Window.partitionBy(*keys).orderBy("fraction")
    width = F.col("fraction") - F.lag("fraction").over(step)
    areas = {"loop_rate_area": "loop_rate", "loop_value_area": "loop_total_share", "giant_area": "giant_share"}
    parts = curve.select(*keys, "fraction", "value_share", *(((F.col(c) + F.lag(c).over(step)) / 2 * width).alias(a) for a, c in areas.items()))
    sums = parts.groupBy(*keys).agg(*(F.sum(a).alias(a) for a in areas), F.max(F.when(F.col("fraction") == 0.05, F.col("value_share"))).alias("top5_share"))
    if whole:
        return sums.join(curve.groupBy(*keys).agg(*(F.max(c).alias(c) for c in FIRST)), keys)
    edges = materialize(filtration_edges(contacts, keys, value))
    first = edges.filter("closes").groupBy(*keys).agg(F.min("rank").alias("_first"))
    at = edges.join(first, keys, "left").groupBy(*keys).agg((F.max("_first") / F.count("*")).alias("first_loop_fraction"), (F.sum(F.when(F.col("rank") <= F.col("_first"), F.col(value))) / F.sum(value)).cast("double").alias("first_loop_value_share"))
    return sums.join(at, keys)


def _rng(seed: int, state: list[str], rep: int) -> np.random.Generator:
    return np.random.default_rng(list("|".join([str(seed), str(rep), *state]).encode()))


def _by_block(contacts: DataFrame, keys: list[str], columns: list[str], n: int, schema: str, run: Callable[..., Callable[[np.random.Generator], dict]], seed: int) -> DataFrame:
    """keys, rep and the row of replicates 1 to n; run takes a state's columns in the order of the edges' ids, once, and
    returns what makes a row from a replicate's generator.

    A state is one group, or, where there are fewer states than the cores need, up to BLOCKS groups, each with a copy of its
    edges and its part of the replicates. So what is shuffled does not depend on n. A replicate depends on seed, state and
    its number only.
    """
    states = contacts.select(*keys).distinct().count()
    blocks = max(1, min(BLOCKS, n, -(-2 * contacts.sparkSession.sparkContext.defaultParallelism // max(1, states))))

    def block(t: pa.Table) -> pa.Table:
        first, state = int(t.column("_block")[0].as_py()), {k: t.column(k)[0] for k in keys}
        ids, a, b = kernels.coded(t.column("id1").to_numpy(), t.column("id2").to_numpy())
        order = np.lexsort((b, a))
        make = run(len(ids), a[order], b[order], *(t.column(c).to_numpy()[order] for c in columns))
        reps = range(first + 1, n + 1, blocks)
        rows = [make(_rng(seed, [str(v.as_py()) for v in state.values()], rep)) for rep in reps]
        out = {"rep": pa.array(reps, pa.int32())} | {c: pa.array(np.array([r[c] for r in rows]), from_pandas=True) for c in names}
        return pa.table({k: pa.repeat(v, len(rows)) for k, v in state.items()} | out)

    names = [c.split()[0] for c in schema.split(", ")]
    copies = contacts.select(*keys, "id1", "id2", *columns).withColumn("_block", F.explode(F.array(*map(F.lit, range(blocks)))) if blocks > 1 else F.lit(0))
    return copies.groupBy(*keys, "_block").applyInArrow(block, f"{_types(contacts, keys)}, rep int, {schema}")


def force_shuffle_null(contacts: DataFrame, keys: list[str], n: int, seed: int = 0, value: str = "force", giants: bool = True) -> DataFrame:
    """rep and the percolation row of each state with its values permuted over its edges; without giants only what the row
    has of loops, for which only the edges of cycles need an order."""

    def run(nodes: int, a: np.ndarray, b: np.ndarray, v: np.ndarray) -> Callable[[np.random.Generator], dict]:
        left = kernels.cyclic(nodes, a, b)

        def loops(rng: np.random.Generator) -> dict:
            w = rng.permutation(v)
            order = left[np.argsort(-w[left], kind="stable")]
            closes = np.zeros(len(v), bool)
            closes[order] = kernels.closing(nodes, a[order], b[order])
            return loop_row(w, closes)

        def all_of(rng: np.random.Generator) -> dict:
            w = rng.permutation(v)
            order = np.argsort(-w, kind="stable")
            x, y = a[order], b[order]
            closes = kernels.closing(nodes, x, y)
            return percolation_row(w[order], closes, kernels.grown(nodes, x, y, closes)[0], nodes)

        return all_of if giants else loops

    return _by_block(contacts.withColumn(value, F.col(value).cast("double")), keys, [value], n, PERCOLATION if giants else LOOPS, run, seed)


def loop_area(closes: np.ndarray) -> float:
    """Mean over the ranks of the share of edges so far that closed a loop."""
    return float(np.mean(np.cumsum(closes) / np.arange(1, len(closes) + 1)))


def order_null(contacts: DataFrame, keys: list[str], n: int, seed: int = 0) -> DataFrame:
    """rep, loop_area and loops for random edge orders of each state."""

    def run(nodes: int, a: np.ndarray, b: np.ndarray) -> Callable[[np.random.Generator], dict]:
        left = kernels.cyclic(nodes, a, b)

        def row(rng: np.random.Generator) -> dict:
            rank, closes = np.empty(len(a), np.int32), np.zeros(len(a), bool)
            rank[rng.permutation(len(a))] = np.arange(len(a))
            order = left[np.argsort(rank[left])]
            closes[rank[order]] = kernels.closing(nodes, a[order], b[order])
            return {"loop_area": loop_area(closes), "loops": int(closes.sum())}

        return row

    return _by_block(contacts, keys, [], n, "loop_area double, loops long", run, seed)


def loop_areas(contacts: DataFrame, keys: list[str], value: str = "force") -> DataFrame:
    """loop_area of each state in the order of its values."""

    def run(id1: np.ndarray, id2: np.ndarray, v: np.ndarray) -> dict[str, np.ndarray]:
        *_, order, closes = _filtered(id1, id2, v)
        return _one({"loop_area": loop_area(closes[order])})

    return grouped(contacts, keys, ["id1", "id2", value], "loop_area double", run)


def loop_values(contacts: DataFrame, keys: list[str], value: str = "force") -> DataFrame:
    """Per state with loops: how many births there are and how many at a positive value, their median and 90 % quantile,
    and the positive share; negative values count as 0."""
    v = F.greatest(F.col(value).cast("double"), F.lit(0.0))
    born = loop_edges(contacts, keys, value).filter("closes").select(*keys, v.alias("_v"))
    positive = F.sum((F.col("_v") > 0).cast("long"))
    return born.groupBy(*keys).agg(F.count("*").alias("births"), positive.alias("positive_births"), F.expr("percentile(_v, 0.5)").alias("birth_median"), F.expr("percentile(_v, 0.9)").alias("birth_p90"), (positive / F.count("*")).alias("positive_share"))


def loop_enrichment(edges: DataFrame, keys: list[str], value: str = "force") -> DataFrame:
    """Of filtration edges: the loop edges' value share over their share of edges, and its logarithm."""
    share = F.sum(F.when(F.col("closes"), F.col(value)).otherwise(0.0)) / F.sum(value)
    fraction = F.avg(F.col("closes").cast("double"))
    out = edges.groupBy(*keys).agg(fraction.alias("loop_fraction"), share.alias("loop_share"))
    e = F.when(F.col("loop_fraction") > 0, F.col("loop_share") / F.col("loop_fraction"))
    return out.withColumn("enrichment", e).withColumn("log_enrichment", F.ln("enrichment"))
