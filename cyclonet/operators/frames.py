"""Filters, pairing of phases and cycles, set operations on edges, neighbours in space."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import is_finite
from ..shared import materialize


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {missing}")
    return df


def finite(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows whose listed columns are all finite."""
    return df.filter(reduce(lambda a, b: a & b, [is_finite(c) for c in columns]))


def valid_contacts(contacts: DataFrame, particles: DataFrame, keys: list[str], id_col: str = "id") -> DataFrame:
    """Contacts of positive force with both ends among the particles of their state."""
    out = contacts.filter(F.col("force") > 0)
    for end in ("id1", "id2"):
        out = out.join(particles.select(*keys, F.col(id_col).alias(end)).distinct(), [*keys, end], "left_semi")
    return out


def with_ends(contacts: DataFrame, particles: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Adds each value column of both ends, suffixed 1 and 2."""
    for k in ("1", "2"):
        side = particles.select(*keys, F.col("id").alias(f"id{k}"), *(F.col(v).alias(f"{v}{k}") for v in values))
        contacts = contacts.join(side, [*keys, f"id{k}"])
    return contacts


def branch_geometry(contacts: DataFrame, particles: DataFrame, keys: list[str]) -> DataFrame:
    """Adds nx, ny, nz (unit vector from id1 to id2), length, abs_nz and theta, the angle from the vertical in degrees.

    Contacts of length 0 are dropped.
    """
    out = with_ends(contacts, particles, keys, ["x", "y", "z"])
    d = {c: F.col(f"{c}2") - F.col(f"{c}1") for c in "xyz"}
    out = out.withColumn("length", F.sqrt(sum(v * v for v in d.values()))).filter("length > 0")
    out = out.withColumns({f"n{c}": v / F.col("length") for c, v in d.items()})
    out = out.withColumn("abs_nz", F.abs("nz"))
    return out.withColumn("theta", F.degrees(F.acos(F.least("abs_nz", F.lit(1.0))))).drop(*(f"{c}{k}" for c in "xyz" for k in "12"))


def edge_position(contacts: DataFrame, particles: DataFrame, keys: list[str], low: float = 0.06, high: float = 0.94) -> DataFrame:
    """Edge midpoints in node coordinates scaled to [0, 1] per state (z, and r from the mean axis), with boundary flags."""
    w = Window.partitionBy(*keys)
    node = particles.withColumn("r", F.sqrt((F.col("x") - F.avg("x").over(w)) ** 2 + (F.col("y") - F.avg("y").over(w)) ** 2))
    for c in ("z", "r"):
        span = F.max(c).over(w) - F.min(c).over(w)
        node = node.withColumn(f"{c}n", F.when(span > 0, (F.col(c) - F.min(c).over(w)) / span).otherwise(0.0))
    out = with_ends(contacts, node, keys, ["zn", "rn"])
    out = out.withColumns({"z_mid": (F.col("zn1") + F.col("zn2")) / 2, "r_mid": (F.col("rn1") + F.col("rn2")) / 2})
    bottom = (F.col("zn1") <= low) | (F.col("zn2") <= low)
    side = (F.col("rn1") >= high) | (F.col("rn2") >= high)
    top = (F.col("zn1") >= high) | (F.col("zn2") >= high)
    return out.withColumns({"bottom_edge": bottom, "side_edge": side, "boundary_edge": bottom | side | top}).drop("zn1", "zn2", "rn1", "rn2")


def boundary_flags(nodes: DataFrame, keys: list[str], low: float = 0.03, high: float = 0.97, z: str = "z", r: str | None = None) -> DataFrame:
    """Adds bottom, top (and side, if r is given) by exact quantiles within each state.

    Equal values are counted before the quantile takes them, and the quantiles are written, so Spark knows that they are few.
    """
    cut = lambda c, **at: nodes.groupBy(*keys, c).agg(F.count("*").alias("_n")).groupBy(*keys).agg(*(F.expr(f"percentile({c}, {p}, _n)").alias(k) for k, p in at.items()))
    cuts = cut(z, _lo=low, _hi=high)
    if r:
        cuts = cuts.join(cut(r, _rh=high), keys)
    out = nodes.join(materialize(cuts), keys)
    flags = {"bottom": F.col(z) <= F.col("_lo"), "top": F.col(z) >= F.col("_hi")}
    if r:
        flags["side"] = F.col(r) >= F.col("_rh")
    return out.withColumns(flags).drop("_lo", "_hi", "_rh")


def phase_delta(df: DataFrame, keys: list[str], phase: str, values: list[str], a: str = "cold", b: str = "hot") -> DataFrame:
    """One row for each key that has both phases: value_a, value_b and value_b_minus_a; one shuffle."""
    pick = lambda v, p: F.max(F.when(F.col(phase) == p, F.col(v)))
    both = (F.max((F.col(phase) == a).cast("int")) + F.max((F.col(phase) == b).cast("int"))).alias("_both")
    wide = df.filter(F.col(phase).isin(a, b)).groupBy(*keys).agg(both, *(pick(v, p).alias(f"{v}_{p}") for v in values for p in (a, b)))
    wide = wide.filter("_both = 2").drop("_both")
    return wide.withColumns({f"{v}_{b}_minus_{a}": F.col(f"{v}_{b}") - F.col(f"{v}_{a}") for v in values})


def phase_wide(df: DataFrame, keys: list[str], phase: str, values: list[str], phases: list[str], how: str = "avg") -> DataFrame:
    """Mean (or first by value) of each value in each phase, and the last phase minus the first."""
    agg = {"avg": F.avg, "min": F.min, "max": F.max}[how]
    out = df.groupBy(*keys).agg(*(agg(F.when(F.col(phase) == p, F.col(v))).alias(f"{v}_{p}") for v in values for p in phases))
    return out.withColumns({f"{v}_delta": F.col(f"{v}_{phases[-1]}") - F.col(f"{v}_{phases[0]}") for v in values})


def next_delta(df: DataFrame, by: list[str], order: str, cols: list[str]) -> DataFrame:
    """Adds next_<c> and <c>_step, the next value minus this one; null on a group's last row."""
    w = Window.partitionBy(*by).orderBy(order)
    out = df.withColumns({f"next_{c}": F.lead(c).over(w) for c in cols})
    return out.withColumns({f"{c}_step": F.col(f"next_{c}") - F.col(c) for c in cols})


def shifted_key_join(df: DataFrame, other: DataFrame, by: list[str], order: str, cols: list[str], shift: int = 1, prefix: str = "next_") -> DataFrame:
    """Left join with the rows of `other` whose order key is `shift` ahead."""
    side = other.select(*by, (F.col(order) - shift).alias(order), *(F.col(c).alias(prefix + c) for c in cols))
    return df.join(side, [*by, order], "left")


def lag_join(df: DataFrame, by: list[str], order: str, x: str, y: str, lags: list[int], mode: str = "key") -> DataFrame:
    """Long form (by, order, lag, x, y): y of a row with x of `lag` earlier.

    mode key: by arithmetic on the order key (negative lags look ahead, gaps stay gaps); position: by rows of the group.
    """
    if mode == "key":
        left = df.select(*by, order, F.col(y).alias("y")).withColumn("lag", F.explode(F.array(*map(F.lit, lags))))
        right = df.select(*by, F.col(order).alias("_o"), F.col(x).alias("x"))
        on = [*by, "_o"]
        return left.withColumn("_o", F.col(order) - F.col("lag")).join(right, on).select(*by, order, "lag", "x", "y")
    w = Window.partitionBy(*by).orderBy(order)
    wide = df.select(*by, order, F.col(y).alias("y"), F.array(*(F.struct(F.lit(k).alias("lag"), F.lag(x, k).over(w).alias("x")) for k in lags)).alias("_l"))
    return wide.select(*by, order, "y", F.inline("_l")).filter(F.col("x").isNotNull()).select(*by, order, "lag", "x", "y")


def join_suffix(a: DataFrame, b: DataFrame, on: list[str], how: str = "inner", suffixes: tuple[str, str] = ("_x", "_y")) -> DataFrame:
    """Join on several keys; other columns of equal name get a suffix each."""
    clash = (set(a.columns) & set(b.columns)) - set(on)
    return a.withColumnsRenamed({c: c + suffixes[0] for c in clash}).join(b.withColumnsRenamed({c: c + suffixes[1] for c in clash}), on, how)


def join_one_to_one(a: DataFrame, b: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """Join that fails if either side repeats a key."""
    for name, side in (("left", a), ("right", b)):
        if not side.groupBy(*on).count().filter("count > 1").isEmpty():
            raise ValueError(f"{name} side repeats a key in {on}")
    return a.join(b, on, how)


def build_atlas(tables: list[DataFrame], key: list[str]) -> DataFrame:
    """Left joins of group summaries onto the first one; clashing columns get the table's number."""
    out = tables[0]
    for k, t in enumerate(tables[1:], 2):
        out = out.join(t.withColumnsRenamed({c: f"{c}_{k}" for c in t.columns if c in out.columns and c not in key}), key, "left")
    return out


def common_union(a: DataFrame, b: DataFrame, labels: tuple[str, str], column: str = "source") -> DataFrame:
    """Both tables on their common columns, with a label of origin."""
    common = [c for c in a.columns if c in b.columns]
    return a.select(*common, F.lit(labels[0]).alias(column)).unionByName(b.select(*common, F.lit(labels[1]).alias(column)))


def union_runs(tables: dict[str, DataFrame], column: str = "run") -> DataFrame:
    """One table of several runs, tagged by run; columns that a run lacks are null."""
    parts = [t.withColumn(column, F.lit(name)) for name, t in tables.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


#: A cell's own place and half of its 26 neighbours, so that each two cells meet once.
HALF = [(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1) if (i, j, k) >= (0, 0, 0)]


#: A cell of more rows than this is joined in parts of about so many rows.
CELL_ROWS = 1000
#: A crowded cell is cut into so many sub-cells along each axis, and a sub-cell by hash of the id where that is not enough.
SUB = 4


def _crowded(p: DataFrame, keys: list[str], cell: list[str], rows: int) -> DataFrame:
    """keys, cell, _parts: for cells of more than `rows` rows, their sub-cells that hold any, with the number of parts of
    each. At most one row for `rows` particles, of at most SUB ** 3 entries."""
    subs = p.groupBy(*keys, *cell, "_s").agg(F.count("*").alias("_m"))
    part = F.struct("_s", F.ceil(F.col("_m") / rows).cast("int").alias("_h"))
    cells = subs.groupBy(*keys, *cell).agg(F.sum("_m").alias("_m"), F.collect_list(part).alias("_parts"))
    return cells.filter(F.col("_m") > rows).drop("_m")


def radius_pairs(particles: DataFrame, keys: list[str], cutoff: float | str, id_col: str = "id", rows: int = CELL_ROWS, carry: tuple[str, ...] = ()) -> DataFrame:
    """keys, id1 < id2, dist for all pairs of a state within the cutoff: a number, or a column that is equal in a state.

    Cells of the cutoff's size; one side is sent to its own and 13 of the neighbour cells, so an equi-join on (state,
    cell) meets every pair once, and a state of any size spreads over its cells. A cell of more than `rows` rows is cut
    into sub-cells and those into parts by hash; a particle is then sent to every part of the sub-cells that its cutoff
    reaches. So a join key holds about `rows` rows of one side however the particles are crowded, in one place too, and
    the other side of a key streams past them. The list of crowded
    cells is written first, so Spark knows its size and broadcasts it only where it is small. Rows with a null or non-finite coordinate, a null id or a cutoff of 0 or
    less are in no pair; an id that stands twice pairs as two rows do, but not with itself. carry: columns of the particles
    that a pair has of both ends, as <c>1 and <c>2; so pairs, of which there are most, are never shuffled.
    """
    c = F.col(cutoff) if isinstance(cutoff, str) else F.lit(float(cutoff))
    p = particles.select(*keys, F.col(id_col).alias("id"), *(F.col(a).cast("double").alias(a) for a in "xyz"), c.alias("_k"), *(F.col(v).alias(f"_v{i}") for i, v in enumerate(carry)))
    held = [f"_v{i}" for i in range(len(carry))]
    p = p.filter(reduce(lambda u, v: u & v, [is_finite(a) for a in ("x", "y", "z", "_k")], F.col("id").isNotNull() & (F.col("_k") > 0)))
    cell = [f"_c{a}" for a in "xyz"]
    p = p.withColumns({f"_c{a}": F.floor(F.col(a) / F.col("_k")).cast("long") for a in "xyz"})
    sub = [F.greatest(F.lit(0), F.least(F.lit(SUB - 1), F.floor((F.col(a) / F.col("_k") - F.col(f"_c{a}")) * SUB))).cast("int") for a in "xyz"]
    p = p.withColumn("_s", (sub[0] * SUB + sub[1]) * SUB + sub[2])
    crowded = materialize(_crowded(p, keys, cell, rows))

    # A row's own part: sub-cell and hash in a crowded cell, one part for all else.
    home = p.join(crowded, [*keys, *cell], "left").withColumn("_h", F.expr("filter(_parts, q -> q._s = _s)[0]._h"))
    home = home.select(*keys, *cell, F.when(F.col("_h").isNull(), -1).otherwise(F.col("_s")).alias("_s"), F.coalesce(F.pmod(F.xxhash64("id", *"xyz"), F.col("_h")), F.lit(0)).cast("int").alias("_h"), "id", *"xyz", *held)

    steps = F.array(*(F.struct(*(F.lit(v).alias(f"_d{a}") for a, v in zip("xyz", step, strict=True))) for step in HALF))
    near = p.select(*keys, F.col("id").alias("_a"), "_k", *(F.col(a).alias(f"{a}1") for a in "xyz"), *(F.col(v).alias(f"{v}_a") for v in held), *cell, F.inline(steps))
    own = (F.col("_dx") == 0) & (F.col("_dy") == 0) & (F.col("_dz") == 0)
    near = near.withColumns({f"_c{a}": F.col(f"_c{a}") + F.col(f"_d{a}") for a in "xyz"}).withColumn("_own", own).drop("_dx", "_dy", "_dz")
    near = near.join(crowded, [*keys, *cell], "left")
    # Squared distance from the particle to a sub-cell, in cutoffs; the margin covers rounding of places.
    gaps = []
    for a, step in zip("xyz", (SUB * SUB, SUB, 1), strict=True):
        low = f"(_c{a} + (int(q._s / {step}) % {SUB}) / {SUB}.0D - {a}1 / _k)"
        gaps.append(f"pow(greatest({low}, -{low} - {1 / SUB}D, 0D), 2)")
    reached = F.expr(f"filter(_parts, q -> {' + '.join(gaps)} <= 1.000001D)")
    every = F.expr("flatten(transform(_reached, q -> transform(sequence(0, q._h - 1), h -> named_struct('_s', q._s, '_h', h))))")
    parts = F.when(F.col("_parts").isNull(), F.array(F.struct(F.lit(-1).alias("_s"), F.lit(0).alias("_h")))).otherwise(every)
    near = near.withColumn("_reached", reached).select(*keys, *cell, "_a", "_k", "_own", "x1", "y1", "z1", *(f"{v}_a" for v in held), F.inline(parts))
    pairs = near.join(home, [*keys, *cell, "_s", "_h"]).filter((F.col("_a") < F.col("id")) | ~F.col("_own") & (F.col("_a") != F.col("id")))
    d2 = sum((F.col(a) - F.col(f"{a}1")) ** 2 for a in "xyz")
    first = F.col("_a") < F.col("id")
    ends = [F.when(first if k == "1" else ~first, F.col(f"{v}_a")).otherwise(F.col(v)).alias(c + k) for v, c in zip(held, carry, strict=True) for k in "12"]
    return pairs.withColumn("dist", F.sqrt(d2)).filter(F.col("dist") <= F.col("_k")).select(*keys, F.least("_a", "id").alias("id1"), F.greatest("_a", "id").alias("id2"), "dist", *ends)


def _reach(particles: DataFrame, keys: list[str], skin: float) -> DataFrame:
    """particles with _r, the greatest radius of the state, and _reach, how far two of its particles can be in contact."""
    rmax = particles.groupBy(*keys).agg(F.max("radius").cast("double").alias("_r"))
    return particles.join(rmax, keys).withColumn("_reach", F.greatest(2 * F.col("_r") * skin, F.lit(1e-12)))


def contact_skin(particles: DataFrame, keys: list[str], skin: float = 1.004) -> DataFrame:
    """Pairs whose distance is at most skin times the sum of their radii, with both radii; cells follow the state's radii."""
    pairs = radius_pairs(_reach(particles, keys, skin), keys, "_reach", carry=("radius",))
    return pairs.filter(F.col("dist") <= (F.col("radius1") + F.col("radius2")) * skin)


def contact_overlap(particles: DataFrame, keys: list[str], skin: float = 1.004) -> DataFrame:
    """Pairs with overlap (sum of radii minus distance) of at least -(skin - 1) * 2 * rmax of the state; adds overlap.

    Pairs at distance 0 are dropped.
    """
    pairs = radius_pairs(_reach(particles, keys, skin), keys, "_reach", carry=("radius", "_r")).drop("_r2").withColumnRenamed("_r1", "_r")
    pairs = pairs.withColumn("overlap", F.col("radius1") + F.col("radius2") - F.col("dist"))
    return pairs.filter((F.col("dist") > 0) & (F.col("overlap") >= -(skin - 1) * 2 * F.col("_r"))).drop("_r")


def edge_canon(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct undirected edges, the smaller id first."""
    return edges.select(*keys, F.least("id1", "id2").alias("id1"), F.greatest("id1", "id2").alias("id2")).distinct()


def _turnover(tagged: DataFrame, keys: list[str]) -> DataFrame:
    old, new = F.col("_old"), F.col("_new")
    out = tagged.groupBy(*keys, "id1", "id2").agg(F.max("_old").alias("_old"), F.max("_new").alias("_new")).groupBy(*keys)
    out = out.agg(F.sum(old * new).alias("persistent"), F.sum((1 - old) * new).alias("created"), F.sum(old * (1 - new)).alias("broken"))
    total = F.col("persistent") + F.col("created") + F.col("broken")
    frac = lambda a, b: F.when(b > 0, a / b)
    return out.withColumns({"jaccard": frac(F.col("persistent"), total), "survival": frac(F.col("persistent"), F.col("persistent") + F.col("broken")), "creation": frac(F.col("created"), F.col("persistent") + F.col("created"))})


def edge_turnover(edges: DataFrame, keys: list[str], order: str = "cycle") -> DataFrame:
    """Edges of each cycle against those of the cycle before: persistent, created, broken, Jaccard, survival, creation.

    Each edge is tagged with its own cycle (new) and the following one (old); one shuffle. Only cycles with a
    predecessor are kept.
    """
    flags = F.array(F.struct(F.lit(0).alias("_d"), F.lit(0).alias("_old"), F.lit(1).alias("_new")), F.struct(F.lit(1).alias("_d"), F.lit(1).alias("_old"), F.lit(0).alias("_new")))
    e = edge_canon(edges, [*keys, order])
    tagged = e.select(*keys, order, "id1", "id2", F.inline(flags)).withColumn(order, F.col(order) + F.col("_d"))
    both = e.select(*keys, order).distinct()
    both = both.join(both.withColumn(order, F.col(order) + 1), [*keys, order])
    return _turnover(tagged, [*keys, order]).join(both, [*keys, order], "left_semi")


def phase_turnover(edges: DataFrame, keys: list[str], phase: str = "phase", a: str = "cold", b: str = "hot") -> DataFrame:
    """Edges of one phase against those of the other within each key that has both."""
    e = edge_canon(edges, [*keys, phase])
    tagged = e.filter(F.col(phase).isin(a, b)).withColumns({"_old": (F.col(phase) == a).cast("int"), "_new": (F.col(phase) == b).cast("int")})
    both = e.filter(F.col(phase).isin(a, b)).groupBy(*keys).agg(F.countDistinct(phase).alias("_n")).filter("_n = 2").select(*keys)
    return _turnover(tagged, keys).join(both, keys, "left_semi")


def edge_survival(edges: DataFrame, keys: list[str], order: str = "cycle") -> DataFrame:
    """As edge_turnover, against the next cycle that was sampled, whatever the gap; the row carries cycle and next_cycle."""
    e = edge_canon(edges, [*keys, order])
    w = Window.partitionBy(*keys).orderBy(order)
    steps = e.select(*keys, order).distinct().withColumn("next_" + order, F.lead(order).over(w)).filter(F.col("next_" + order).isNotNull())
    old = e.join(steps, [*keys, order]).withColumns({"_old": F.lit(1), "_new": F.lit(0)})
    new = e.withColumnRenamed(order, "next_" + order).join(steps, [*keys, "next_" + order]).withColumns({"_old": F.lit(0), "_new": F.lit(1)})
    return _turnover(old.unionByName(new), [*keys, order, "next_" + order])


def keep_last(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row a key: the last by the order."""
    w = Window.partitionBy(*keys).orderBy(*(c.desc() for c in order))
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def membership(df: DataFrame, other: DataFrame, on: list[str], name: str = "member") -> DataFrame:
    """Adds a boolean: is the row's key in the other table?"""
    return df.join(other.select(*on).distinct().withColumn(name, F.lit(True)), on, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def pivot_matrix(df: DataFrame, rows: list[str], column: str, value: str, names: list) -> DataFrame:
    """Long to wide: the mean of value for each listed name."""
    return df.groupBy(*rows).pivot(column, names).agg(F.avg(value))


MOST_CELLS = 10_000_000


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    """Long contingency table with zeros where a pair never occurs; over MOST_CELLS cells it is an error.

    (The counts of the pairs that do occur are a plain groupBy.)
    """
    left, right = df.select(a).distinct(), df.select(b).distinct()
    if left.count() * right.count() > MOST_CELLS:
        raise ValueError(f"more than {MOST_CELLS} cells")
    return left.join(right, how="cross").join(df.groupBy(a, b).agg(F.count("*").alias("n")), [a, b], "left").fillna(0, ["n"])
