"""Queries of table files, nulls that end in p values, forward logistic models and the sides that trees touch."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import sources as src
from ..operators import fits
from ..operators import frames as fr
from ..operators import information as inf
from ..operators import networks as net
from ..operators import resampling as nul
from ..operators import statistics as st
from ..operators import windows as win
from ..shared import materialize, shared_dir
from .registry import register
from .views import PANEL, contacts, nodes, panel

STATE = ["run", "cycle", "phase"]
G = ["regime_id"]


def _folder(s) -> str:
    return f"{shared_dir(s)}/{uuid.uuid4().hex}"


def _csv(s, d):
    """The panel written as csv and read back with its types."""
    p, path = panel(s, d), _folder(s)
    src.write_table(p, path, form="csv")
    return src.read_table(s, path, p.schema, ["regime_id", "cycle", "x"])


def _table(s, d):
    """The panel written in folders of its groups and read back."""
    p, path = panel(s, d), _folder(s)
    src.write_table(p, path, ["regime_id"])
    return s.read.schema(p.schema).parquet(path)


def _json(s, d):
    """Summaries of each group as one nested object, written as text and flattened: as large as there are groups."""
    own = panel(s, d).groupBy("regime_id").agg(F.count("*").alias("rows"), F.avg("x").alias("mean_x"), F.max("w").alias("max_w"))
    value = F.create_map(*(v for c in ("rows", "mean_x", "max_w") for v in (F.lit(c), F.col(c).cast("double"))))
    path = _folder(s)
    own.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("regime_id", value)))).alias("value")).coalesce(1).write.text(path)
    return src.json_stats(s, path).withColumnRenamed("case", "item")


register("src_csv", _csv, "regime_id cycle n", "x y z w", PANEL, "SELECT * FROM panel")
register("snk_table", _table, "regime_id cycle n", "x y z w", PANEL, "SELECT * FROM panel")
register("src_json_stats", _json, "item name", "value", PANEL, """
  SELECT regime_id AS item, name, value FROM (SELECT regime_id, unnest(['rows', 'mean_x', 'max_w']) AS name, unnest([count(*)::DOUBLE, avg(x), max(w)::DOUBLE]) AS value FROM panel GROUP BY 1)""")

_C = ", p AS (SELECT regime_id, x, w, row_number() OVER (PARTITION BY regime_id ORDER BY cycle) - 1 AS i, count(*) OVER (PARTITION BY regime_id) AS size FROM panel), c AS (SELECT *, round(x - avg(x) OVER (PARTITION BY regime_id), 9) AS xc, round(w - avg(w) OVER (PARTITION BY regime_id), 9) AS wc FROM p)"
_U = "CAST(('0x' || substr(md5(concat('0|', rep, '|', regime_id)), 1, 13)) AS BIGINT) / 4503599627370496.0::DOUBLE"
_RANKS = "rank() OVER (PARTITION BY rep ORDER BY {0}) + (count(*) OVER (PARTITION BY rep, {0}) - 1) / 2.0::DOUBLE"
SHIFTS = 1000


def _shift_p(s, d):
    """Centred Spearman of two columns against SHIFTS circular shifts within groups."""
    p = materialize(panel(s, d))
    null = nul.shift_null(p, G, "cycle", "x", "w", SHIFTS).select(F.lit("x").alias("test"), "rho")
    return nul.null_summary(st.spearman(p.withColumn("test", F.lit("x")), ["test"], "x", "w", 4, G), null, ["test"], "rho")


register("nul_shift_p", _shift_p, "test n", "observed p null_mean null_median null_low null_high", PANEL + _C + f""", reps AS (SELECT CAST(unnest(range(0, {SHIFTS + 1})) AS INTEGER) AS rep),
  m AS (SELECT a.rep, b.xc, a.wc FROM (SELECT rep, c.* FROM c CROSS JOIN reps) a JOIN (SELECT rep, regime_id, xc, (i + CASE WHEN rep = 0 THEN 0 ELSE CAST(floor({_U} * size) AS BIGINT) END) % size AS j FROM c CROSS JOIN reps) b ON a.rep = b.rep AND a.regime_id = b.regime_id AND a.i = b.j),
  v AS (SELECT rep, corr(rx, rw) AS r FROM (SELECT rep, {_RANKS.format("xc")} AS rx, {_RANKS.format("wc")} AS rw FROM m) GROUP BY 1), o AS (SELECT r AS observed FROM v WHERE rep = 0)""",
  "SELECT 'x' AS test, count(*) AS n, any_value(observed) AS observed, (count(*) FILTER (abs(r) >= abs(observed)) + 1) / (count(*) + 1)::DOUBLE AS p, avg(r) AS null_mean, quantile_cont(r, 0.5) AS null_median, quantile_cont(r, 0.025) AS null_low, quantile_cont(r, 0.975) AS null_high FROM v CROSS JOIN o WHERE rep > 0")


def _forward_logistic(s, d):
    """Rare events after cycle 18 by a model of the cycles up to it, for each group; scores over all groups' late rows."""
    z = win.rare_flag(win.zscore(panel(s, d), G, ["x", "y", "w"]), G, "w", 0.8)
    out = materialize(fits.forward_logistic(z, "regime_id", "cycle", ["x_z", "y_z"], "rare", 18).withColumn("test", F.lit("rare")))
    scores = inf.auc(out, ["test"], "predicted", "rare").drop("n")
    return fits.balanced_accuracy(out, ["test"], "rare").join(scores, "test").join(st.spearman(out, ["test"], "rare", "predicted").drop("n"), "test")


register("mod_forward_logistic", _forward_logistic, "test n", "auc balanced_accuracy rho")


def _sides(s, d):
    """Nodes with the flags of three sides, the last by distance from the axis."""
    n = nodes(s, d).withColumn("r", F.sqrt(F.col("x") ** 2 + F.col("y") ** 2))
    return fr.boundary_flags(n, STATE, r="r")


def _touching(s, d):
    """Over the filtration's edges: how many close a loop, and the first rank at which a tree touches each pair of sides."""
    e = net.filtration_edges(contacts(s, d), STATE, nodes=_sides(s, d), sides=("bottom", "top", "side"))
    both = lambda a, b: F.min(F.when(F.col(f"touches_{a}") & F.col(f"touches_{b}"), F.col("rank")))
    return e.groupBy(*STATE).agg(F.count("*").alias("edges"), F.sum(F.col("closes").cast("long")).alias("loops"), both("bottom", "top").alias("bottom_top"), both("bottom", "side").alias("bottom_side"))


register("topo_touches", _touching, "run cycle phase edges loops bottom_top bottom_side")


def _order_p(s, d, n: int = 25):
    """Does the loop area's hot less cold difference follow that of the mean force more than under random edge orders?

    Centred Spearman over cycles, the null's from `n` orders of each state's edges.
    """
    c = materialize(contacts(s, d))
    force = fr.phase_delta(c.groupBy(*STATE).agg(F.avg("force").alias("force")), ["run", "cycle"], "phase", ["force"]).select("run", "cycle", F.col("force_hot_minus_cold").alias("y"))
    rho = lambda areas, by: st.spearman(fr.phase_delta(areas, [*by, "run", "cycle"], "phase", ["loop_area"]).join(force, ["run", "cycle"]), by, "loop_area_hot_minus_cold", "y", 4, ["run"])
    null = rho(net.order_null(c, STATE, n), ["rep"]).select(F.lit("loop_area").alias("test"), "rho")
    observed = rho(net.loop_areas(c, STATE).withColumn("test", F.lit("loop_area")), ["test"])
    return nul.null_summary(observed, null, ["test"], "rho")


register("topo_order_null_p", _order_p, "test n", "observed p null_median null_low null_high")


def _shuffle_rho(s, d, n: int = 24):
    """For each replicate of shuffled forces: does the loops' force share, hot less cold, follow the real p99's difference?

    Centred Spearman over cycles with n and p.
    """
    c = materialize(contacts(s, d))
    p99 = fr.phase_delta(c.groupBy(*STATE).agg(F.expr("percentile(force, 0.99)").alias("p99")), ["run", "cycle"], "phase", ["p99"]).select("run", "cycle", F.col("p99_hot_minus_cold").alias("y"))
    rho = lambda rows, by: st.with_p(st.spearman(fr.phase_delta(rows, [*by, "run", "cycle"], "phase", ["loop_value_share"]).join(p99, ["run", "cycle"]), by, "loop_value_share_hot_minus_cold", "y", 4, ["run"]))
    return rho(net.force_shuffle_null(c, STATE, n, giants=False), ["rep"]), rho(net.percolation(c, STATE).withColumn("test", F.lit("loop_value_share")), ["test"])


def _shuffle_p(s, d):
    null, observed = _shuffle_rho(s, d)
    return nul.null_summary(observed.select("test", "rho"), null.select(F.lit("loop_value_share").alias("test"), "rho"), ["test"], "rho")


register("topo_force_shuffle_rho", lambda s, d: _shuffle_rho(s, d)[0], "rep n", "rho p")
register("topo_force_shuffle_null_p", _shuffle_p, "test n", "observed p null_median null_low null_high")
