"""Growing trees of the value-ordered filtration for states larger than a task.

Edges join in falling order of their value. Only edges of the maximum spanning forest change a tree; it comes from
contraction rounds in which every node takes its first edge. How large a tree is after each of them is found by halves:
the edges' ranks are cut into blocks; at each bit of the block number the components of every first half, one set of
joins for all of them, become the nodes of its second half. Each level moves every forest edge once. At the end each
block knows, for the ends of its edges, the tree they are in when the block begins, with its size and sides, and goes
through its own edges in one task. No task holds a state.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import discard, materialize
from .networks import PART_EDGES, Forest, _jumped, _types, component_labels


def ranked(contacts: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, id1, id2, value, rank from 1 by falling value (ties by the ids), and edges, the state's number of them.

    Ranks come from ranges of the order, their counts and a running sum of those, not from a window over a state. Null
    values come last.
    """
    spark = contacts.sparkSession
    order = [F.col(value).desc_nulls_last(), F.col("id1"), F.col("id2")]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(contacts.select(*keys, "id1", "id2", value).repartitionByRange(parts, *keys, *order).withColumn("_range", F.spark_partition_id()))
    state = Window.partitionBy(*keys)
    counts = ranged.groupBy(*keys, "_range").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(state.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(*keys, "_range", before.alias("_before"), F.sum("_n").over(state).alias("edges"))
    local = ranged.withColumn("_i", F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(*order)))
    return local.join(starts, [*keys, "_range"]).withColumn("rank", F.col("_before") + F.col("_i")).select(*keys, "id1", "id2", value, "rank", "edges")


def spanning_forest(edges: DataFrame, keys: list[str], local: int = PART_EDGES) -> DataFrame:
    """keys, rank: the edges (id1, id2, rank) that join two trees when edges join by rank.

    Every node's first edge is one of them. Their trees become nodes; of parallel edges the first stays, edges inside a tree
    go. States of at most `local` edges that are left are one grouped call each.
    """
    kind = edges.schema["id1"].dataType.simpleString()
    least = lambda df: df.groupBy(*keys, "a", "b").agg(F.min("rank").alias("rank"))
    left = materialize(least(edges.filter("id1 <> id2").select(*keys, F.least("id1", "id2").alias("a"), F.greatest("id1", "id2").alias("b"), "rank")))
    found: list[DataFrame] = []

    def kruskal(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("rank")
        code, _ = pd.factorize(pd.concat([f["a"], f["b"]], ignore_index=True))
        forest = Forest(len(code))
        joins = [not forest.link(a, b)[0] for a, b in zip(code[: len(f)].tolist(), code[len(f) :].tolist(), strict=True)]
        return f.loc[joins, [*keys, "rank"]]

    while True:
        most = left.groupBy(*keys).agg(F.count("*").alias("_n")).agg(F.max("_n")).first()[0] or 0
        if most <= local or most == 0:
            found.append(left.groupBy(*keys).applyInPandas(kruskal, f"{_types(left, keys)}, rank long"))
            break
        ends = left.select(*keys, "rank", F.inline(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("parent")), F.struct(F.col("b").alias("node"), F.col("a").alias("parent")))))
        picked = materialize(ends.groupBy(*keys, "node").agg(F.min(F.struct("rank", "parent")).alias("_m")).select(*keys, "node", F.col("_m.parent").cast(kind).alias("parent"), F.col("_m.rank").alias("rank")))
        found.append(picked.select(*keys, "rank"))
        roots = _jumped(picked.select(*keys, "node", "parent"), keys)
        for end in ("a", "b"):
            left = left.join(roots.withColumnsRenamed({"node": end, "root": f"_{end}"}), [*keys, end])
        left = left.filter("_a <> _b").select(*keys, F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"), "rank")
        left = materialize(least(left))
        discard(roots)
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return materialize(out.distinct())


def grow(tree: DataFrame, keys: list[str], part: int = PART_EDGES, local: int = PART_EDGES) -> DataFrame:
    """keys, rank, size, sides for each forest edge (id1, id2, rank, _f1, _f2): the nodes of the tree that it is in once it
    has joined, and the sides (bits) they are on. Blocks are of `part` ranks."""
    block = F.floor((F.col("rank") - 1) / part)
    now = materialize(tree.select(*keys, "rank", block.alias("block"), F.col("id1").alias("a"), F.col("id2").alias("b"), F.lit(1).cast("long").alias("sa"), F.lit(1).cast("long").alias("sb"), F.col("_f1").alias("fa"), F.col("_f2").alias("fb")))
    top = now.agg(F.max("block")).first()[0] or 0
    for bit in reversed(range(int(top).bit_length())):
        half = now.withColumns({"_p": F.shiftright("block", bit + 1), "_second": F.shiftright("block", bit).bitwiseAND(1) == 1})
        first = half.filter("NOT _second")
        sub = [*keys, "_p"]
        label = component_labels(first.select(*sub, F.col("a").alias("id1"), F.col("b").alias("id2")), sub, local=local)
        ends = first.select(*sub, F.inline(F.array(F.struct(F.col("a").alias("node"), F.col("sa").alias("s"), F.col("fa").alias("f")), F.struct(F.col("b").alias("node"), F.col("sb").alias("s"), F.col("fb").alias("f"))))).groupBy(*sub, "node").agg(F.max("s").alias("s"), F.max("f").alias("f"))
        member = materialize(ends.join(label, [*sub, "node"]))
        whole = member.groupBy(*sub, "component").agg(F.sum("s").alias("_s"), F.bit_or("f").alias("_f"))
        known = materialize(member.select(*sub, "node", "component").join(whole, [*sub, "component"]))
        second = half.filter("_second")
        for end in ("a", "b"):
            to = known.select(*sub, F.col("node").alias(end), F.col("component").alias("_c"), "_s", "_f")
            second = second.join(to, [*sub, end], "left").withColumns({f"s{end}": F.coalesce("_s", f"s{end}"), f"f{end}": F.coalesce("_f", f"f{end}"), "_to": F.coalesce("_c", end)}).drop("_c", "_s", "_f", end).withColumnRenamed("_to", end)
        new = materialize(first.select(*now.columns).unionByName(second.select(*now.columns)))
        for old in (now, member, known):
            discard(old)
        now = new

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("rank", ignore_index=True)
        code, ids = pd.factorize(pd.concat([f["a"], f["b"]], ignore_index=True))
        forest = Forest(len(ids))
        n = len(f)
        for c, s, x in zip(code.tolist(), [*f["sa"], *f["sb"]], [*f["fa"], *f["fb"]], strict=True):
            forest.size[c], forest.flags[c] = s, x
        size, sides = [], []
        for a, b in zip(code[:n].tolist(), code[n:].tolist(), strict=True):
            root = forest.link(a, b)[1]
            size.append(forest.size[root])
            sides.append(forest.flags[root])
        return f[[*keys, "rank"]].assign(size=size, sides=sides)

    return now.groupBy(*keys, "block").applyInPandas(run, f"{_types(now, keys)}, rank long, size long, sides int")


def filtration_trees(contacts: DataFrame, keys: list[str], value: str, local: int = PART_EDGES, part: int = PART_EDGES) -> DataFrame:
    """Every edge (keys, id1, id2, value, rank, edges) with size and sides of the tree that it makes; null where it closes a
    loop. contacts need _f1 and _f2, the sides (bits) of their ends."""
    flags = contacts.select(*keys, "id1", "id2", "_f1", "_f2").distinct()
    r = materialize(ranked(contacts, keys, value))
    forest = spanning_forest(r, keys, local)
    tree = r.join(forest, [*keys, "rank"]).join(flags, [*keys, "id1", "id2"])
    return r.join(grow(tree, keys, part, local), [*keys, "rank"], "left")


def percolation_rows(trees: DataFrame, keys: list[str], value: str, marks: tuple[float, ...], pairs: dict[str, int]) -> DataFrame:
    """The row of `networks.percolation` for each state of `filtration_trees`, by aggregation."""
    nodes = trees.select(*keys, F.explode(F.array("id1", "id2")).alias("node")).distinct().groupBy(*keys).agg(F.count("*").alias("_nodes"))
    t = trees.join(nodes, keys)
    loop = F.col("size").isNull()
    share = lambda x: F.when(F.sum(value) != 0, x / F.sum(value))
    upto = lambda p: (F.col("rank") - 1) / F.col("edges") < p
    out: list[Column] = [
        F.count("*").alias("contacts"), F.sum(value).cast("double").alias("value_sum"), F.avg(value).cast("double").alias("value_mean"), F.expr(f"percentile({value}, 0.99)").alias("value_p99"),
        F.sum(loop.cast("long")).alias("loop_births"), F.avg(loop.cast("double")).alias("loop_fraction"), share(F.sum(F.when(loop, F.col(value)).otherwise(0))).cast("double").alias("loop_value_share"),
    ]
    for p in marks:
        name = f"top{round(100 * p)}"
        out += [(F.max(F.when(upto(p), F.col("size"))) / F.max("_nodes")).alias(f"giant_{name}"), share(F.sum(F.when(upto(p), F.col(value)))).cast("double").alias(f"share_{name}")]
    at = lambda cond: F.min(F.when(cond, F.col("rank"))) / F.max("edges")
    out.append(at(F.col("size") >= 0.5 * F.col("_nodes")).alias("giant_half_fraction"))
    out += [at(F.col("sides").bitwiseAND(bits) == bits).alias(name) for name, bits in pairs.items()]
    return t.groupBy(*keys).agg(*out)


def curve_rows(trees: DataFrame, keys: list[str], value: str, fractions: tuple[float, ...]) -> DataFrame:
    """The rows of `networks.filtration_curve` for each state of `filtration_trees`, by one aggregation."""
    nodes = trees.select(*keys, F.explode(F.array("id1", "id2")).alias("node")).distinct().groupBy(*keys).agg(F.count("*").alias("_nodes"))
    t = trees.withColumn("_v", F.col(value).cast("double")).join(nodes, keys)
    loop = F.col("size").isNull()
    rows = []
    for i, p in enumerate(fractions):
        k = F.greatest(F.lit(1), F.ceil(F.lit(p) * F.col("edges")))
        on = F.col("rank") <= k
        rows += [
            F.max(k).alias(f"_k{i}"), F.sum((on & loop).cast("long")).alias(f"_b{i}"), F.sum(F.when(on & loop, F.col("_v")).otherwise(0.0)).alias(f"_l{i}"),
            F.sum(F.when(on, F.col("_v")).otherwise(0.0)).alias(f"_a{i}"), F.max(F.when(on, F.col("size"))).alias(f"_g{i}"),
        ]
    out = t.groupBy(*keys).agg(F.sum("_v").alias("_t"), F.max("_nodes").alias("_n"), *rows)
    line = lambda i, p: F.struct(
        F.lit(p).alias("fraction"), (F.col(f"_b{i}") / F.col(f"_k{i}")).alias("loop_rate"), (F.col(f"_l{i}") / F.greatest(F.col(f"_a{i}"), F.lit(1e-300))).alias("loop_share"), (F.col(f"_l{i}") / F.col("_t")).alias("loop_total_share"),
        (F.col(f"_g{i}") / F.col("_n")).alias("giant_share"), (F.col(f"_a{i}") / F.col("_t")).alias("value_share"),
    )
    return out.select(*keys, F.inline(F.array(*(line(i, p) for i, p in enumerate(fractions)))))
