"""Queries of networks, statistics, resampling, information, return maps and geometry."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import frames as fr
from ..operators import geometry as geo
from ..operators import information as inf
from ..operators import models as mod
from ..operators import networks as net
from ..operators import resampling as nul
from ..operators import statistics as st
from ..operators import windows as win
from ..shared import materialize
from .registry import register
from .views import CONTACTS, NODES, PANEL, contacts, nodes, panel

STATE = ["run", "cycle", "phase"]
G = ["regime_id"]
_W = "(PARTITION BY regime_id)"
_O = "(PARTITION BY regime_id ORDER BY cycle)"


def strong(s, d, q: float = 0.5):
    """The stronger contacts of each state, so that networks fall into components."""
    c = contacts(s, d)
    cut = c.groupBy(*STATE).agg(F.expr(f"percentile(force, {q})").alias("_q"))
    return c.join(cut, STATE).filter(F.col("force") >= F.col("_q")).drop("_q")


def three_sides(s, d, c=None):
    """Nodes with the flags bottom, top and side, the last by distance from the axis."""
    return fr.boundary_flags(nodes(s, d, c).withColumn("r", F.sqrt(F.col("x") ** 2 + F.col("y") ** 2)), STATE, r="r")


def _sided(s, d, run):
    """run over the contacts and their nodes with flags, both written once."""
    c = materialize(contacts(s, d))
    return run(c, STATE, nodes=three_sides(s, d, c))


def _strong(q: float) -> str:
    return CONTACTS + f", strong AS (SELECT c.* FROM contacts c JOIN (SELECT run, cycle, phase, quantile_cont(force, {q}) AS q FROM contacts GROUP BY 1, 2, 3) t ON c.run = t.run AND c.cycle = t.cycle AND c.phase = t.phase AND c.force >= t.q)"


register("net_degree", lambda s, d: net.degree_stats(strong(s, d), STATE), "run cycle phase nodes rattlers", "z_mean z_var low_share var_over_mean", _strong(0.5), """
  SELECT run, cycle, phase, count(*) AS nodes, count(*) FILTER (g = 0) AS rattlers, avg(g) AS z_mean, var_pop(g) AS z_var, avg(CAST(g < 3 AS INT)) AS low_share, var_pop(g) / avg(g) AS var_over_mean
  FROM (SELECT run, cycle, phase, id, count(*) AS g FROM (SELECT run, cycle, phase, unnest([id1, id2]) AS id FROM strong) GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3""")


def _labels(of: str) -> str:
    """SQL of each node's component: least labels spread over the edges of a table until none changes."""
    return f"""both_ AS (SELECT run, cycle, phase, id1 AS a, id2 AS b FROM {of} UNION SELECT run, cycle, phase, id2, id1 FROM {of}),
  label(run, cycle, phase, node, component) USING KEY (run, cycle, phase, node) AS (SELECT run, cycle, phase, a, least(a, min(b)) FROM both_ GROUP BY 1, 2, 3, 4
  UNION SELECT c.run, c.cycle, c.phase, c.node, min(p.component) FROM label p JOIN both_ e ON e.run = p.run AND e.cycle = p.cycle AND e.phase = p.phase AND e.a = p.node
  JOIN recurring.label c ON c.run = p.run AND c.cycle = p.cycle AND c.phase = p.phase AND c.node = e.b WHERE p.component < c.component GROUP BY 1, 2, 3, 4)"""


_PARTS = "RECURSIVE " + CONTACTS + ", " + _labels("contacts")
_COMPONENTS = "SELECT run, cycle, phase, CAST(sum(n) AS BIGINT) AS nodes, count(*) AS components, max(n) / sum(n)::DOUBLE AS giant_share FROM (SELECT run, cycle, phase, component, count(*) AS n FROM label GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3"
_BETA = """
  SELECT l.run, l.cycle, l.phase, e - n + c AS loops, (e - n + c) / n::DOUBLE AS loops_per_node, (e - n + c) / e::DOUBLE AS loops_per_edge FROM (SELECT run, cycle, phase, count(*) AS n, count(DISTINCT component) AS c FROM label GROUP BY 1, 2, 3) l
  JOIN (SELECT run, cycle, phase, count(*) AS e FROM contacts GROUP BY 1, 2, 3) p ON l.run = p.run AND l.cycle = p.cycle AND l.phase = p.phase"""
register("net_components", lambda s, d: net.components(materialize(contacts(s, d)), STATE), "run cycle phase nodes components", "giant_share", _PARTS, _COMPONENTS)
register("net_beta1", lambda s, d: net.beta1(materialize(contacts(s, d)), STATE), "run cycle phase loops", "loops_per_node loops_per_edge", _PARTS, _BETA)
register("net_spanning", lambda s, d: _sided(s, d, net.spanning), "run cycle phase spanning_components bottom_side_components", "span boundary_edge_share", "RECURSIVE " + NODES + ", " + _labels("contacts"), """
  WITH q AS (SELECT run, cycle, phase, quantile_cont(z, 0.03) AS lo, quantile_cont(z, 0.97) AS hi, quantile_cont(sqrt(x * x + y * y), 0.97) AS rh, max(z) - min(z) AS height FROM nodes GROUP BY 1, 2, 3),
  f AS (SELECT n.run, n.cycle, n.phase, n.id, n.z, z <= lo AS bottom, z >= hi AS top, sqrt(x * x + y * y) >= rh AS side, height FROM nodes n JOIN q ON n.run = q.run AND n.cycle = q.cycle AND n.phase = q.phase),
  c AS (SELECT l.run, l.cycle, l.phase, component, bool_or(bottom) AND bool_or(top) AS bt, bool_or(bottom) AND bool_or(side) AS bs, max(z) - min(z) AS span, any_value(height) AS height FROM label l
    JOIN f ON l.run = f.run AND l.cycle = f.cycle AND l.phase = f.phase AND l.node = f.id GROUP BY 1, 2, 3, 4),
  e AS (SELECT c.run, c.cycle, c.phase, avg(CAST(a.bottom OR a.side OR b.bottom OR b.side AS INT)) AS share FROM contacts c JOIN f a ON a.run = c.run AND a.cycle = c.cycle AND a.phase = c.phase AND a.id = c.id1
    JOIN f b ON b.run = c.run AND b.cycle = c.cycle AND b.phase = c.phase AND b.id = c.id2 GROUP BY 1, 2, 3)
  SELECT c.run, c.cycle, c.phase, count(*) FILTER (bt) AS spanning_components, count(*) FILTER (bs) AS bottom_side_components, max(span) / any_value(height) AS span, any_value(share) AS boundary_edge_share
  FROM c JOIN e ON e.run = c.run AND e.cycle = c.cycle AND e.phase = c.phase GROUP BY 1, 2, 3""")
register("net_kcore", lambda s, d: net.kcore_stats(materialize(strong(s, d)), STATE), "run cycle phase core_max", "core_mean core4_share core5_share")
register("net_triangles", lambda s, d: net.triangles(_web(s, d), ["run", "cycle"]), "run cycle triangles wedges", "transitivity density", CONTACTS + """,
  web AS (SELECT DISTINCT run, cycle, least(a, b) AS a, greatest(a, b) AS b FROM (SELECT run, cycle, id1 % 60 AS a, id2 % 47 AS b FROM contacts) WHERE a <> b)""", """
  SELECT w.run, w.cycle, coalesce(t.n, 0) AS triangles, w.n AS wedges, 3 * coalesce(t.n, 0) / w.n::DOUBLE AS transitivity, coalesce(t.n, 0) / w.nodes::DOUBLE AS density FROM (SELECT run, cycle, CAST(sum(g * (g - 1) / 2) AS BIGINT) AS n, count(*) AS nodes FROM (SELECT run, cycle, v, count(*) AS g FROM (SELECT run, cycle, unnest([a, b]) AS v FROM web) GROUP BY 1, 2, 3) GROUP BY 1, 2) w
  LEFT JOIN (SELECT x.run, x.cycle, count(*) AS n FROM web x JOIN web y ON x.run = y.run AND x.cycle = y.cycle AND x.b = y.a JOIN web z ON z.run = x.run AND z.cycle = x.cycle AND z.a = x.a AND z.b = y.b GROUP BY 1, 2) t ON w.run = t.run AND w.cycle = t.cycle""")  # fmt: skip


def _web(s, d):
    return contacts(s, d).select("run", "cycle", (F.col("id1") % 60).alias("id1"), (F.col("id2") % 47).alias("id2"))


register("net_backbone", lambda s, d: net.backbone(contacts(s, d), STATE, 0.9, nodes=nodes(s, d)), "run cycle phase edges nodes components largest largest_edges touches_bottom touches_top touches_side", "edge_share z_span z_span_norm", "RECURSIVE " + NODES + _strong(0.9).removeprefix(CONTACTS) + ", " + _labels("strong"), """
  WITH q AS (SELECT run, cycle, phase, quantile_cont(z, 0.02) AS lo, quantile_cont(z, 0.98) AS hi, quantile_cont(sqrt(x * x + y * y), 0.98) AS rh, max(z) - min(z) AS height FROM nodes GROUP BY 1, 2, 3),
  sizes AS (SELECT run, cycle, phase, component, count(*) AS n FROM label GROUP BY 1, 2, 3, 4),
  per AS (SELECT run, cycle, phase, CAST(sum(n) AS BIGINT) AS nodes, count(*) AS components FROM sizes GROUP BY 1, 2, 3),
  big AS (SELECT * FROM sizes QUALIFY row_number() OVER (PARTITION BY run, cycle, phase ORDER BY n DESC, component) = 1),
  e AS (SELECT s.run, s.cycle, s.phase, count(*) AS edges, count(*) FILTER (l.component = b.component) AS largest_edges FROM strong s JOIN label l ON l.run = s.run AND l.cycle = s.cycle AND l.phase = s.phase AND l.node = s.id1
    JOIN big b ON b.run = s.run AND b.cycle = s.cycle AND b.phase = s.phase GROUP BY 1, 2, 3),
  m AS (SELECT b.run, b.cycle, b.phase, max(z) - min(z) AS z_span, any_value(height) AS height, bool_or(z <= lo) AS touches_bottom, bool_or(z >= hi) AS touches_top, bool_or(sqrt(x * x + y * y) >= rh) AS touches_side FROM big b
    JOIN label l ON l.run = b.run AND l.cycle = b.cycle AND l.phase = b.phase AND l.component = b.component JOIN nodes n ON n.run = b.run AND n.cycle = b.cycle AND n.phase = b.phase AND n.id = l.node
    JOIN q ON q.run = b.run AND q.cycle = b.cycle AND q.phase = b.phase GROUP BY 1, 2, 3),
  t AS (SELECT run, cycle, phase, count(*) AS n FROM contacts GROUP BY 1, 2, 3)
  SELECT p.*, e.edges, e.largest_edges, b.n AS largest, e.edges / t.n::DOUBLE AS edge_share, z_span, z_span / height AS z_span_norm, touches_bottom, touches_top, touches_side FROM per p JOIN e USING (run, cycle, phase) JOIN big b USING (run, cycle, phase) JOIN m USING (run, cycle, phase) JOIN t USING (run, cycle, phase)""")
register("topo_cycle_edges", lambda s, d: net.filtration_edges(contacts(s, d), STATE).groupBy(*STATE).agg(F.count("*").alias("edges"), F.sum(F.col("closes").cast("long")).alias("loops"), F.min(F.when(F.col("closes"), F.col("rank"))).alias("first")), "run cycle phase edges loops first")
_RANKED = NODES + """, ranked AS (SELECT *, row_number() OVER (PARTITION BY run, cycle, phase ORDER BY force DESC, id1, id2) AS i, count(*) OVER (PARTITION BY run, cycle, phase) AS m FROM contacts),
  marked AS (SELECT run, cycle, phase, mark, id1, id2 FROM ranked CROSS JOIN (SELECT unnest([1, 5, 10, 100]) AS mark) WHERE (i - 1) / m::DOUBLE < mark / 100.0::DOUBLE),
  both_ AS (SELECT run, cycle, phase, mark, id1 AS a, id2 AS b FROM marked UNION SELECT run, cycle, phase, mark, id2, id1 FROM marked),
  label(run, cycle, phase, mark, node, component) USING KEY (run, cycle, phase, mark, node) AS (SELECT run, cycle, phase, mark, a, least(a, min(b)) FROM both_ GROUP BY 1, 2, 3, 4, 5
  UNION SELECT c.run, c.cycle, c.phase, c.mark, c.node, min(p.component) FROM label p JOIN both_ e ON e.run = p.run AND e.cycle = p.cycle AND e.phase = p.phase AND e.mark = p.mark AND e.a = p.node
  JOIN recurring.label c ON c.run = p.run AND c.cycle = p.cycle AND c.phase = p.phase AND c.mark = p.mark AND c.node = e.b WHERE p.component < c.component GROUP BY 1, 2, 3, 4, 5),
  flagged AS (SELECT n.run, n.cycle, n.phase, n.id, z <= lo AS bottom, z >= hi AS top, sqrt(x * x + y * y) >= rh AS side FROM nodes n JOIN (SELECT run, cycle, phase, quantile_cont(z, 0.03) AS lo, quantile_cont(z, 0.97) AS hi,
  quantile_cont(sqrt(x * x + y * y), 0.97) AS rh FROM nodes GROUP BY 1, 2, 3) q ON n.run = q.run AND n.cycle = q.cycle AND n.phase = q.phase),
  steps AS (SELECT run, cycle, phase, i, id1 AS a, id2 AS b FROM ranked UNION ALL SELECT run, cycle, phase, i, id2, id1 FROM ranked),
  reach(run, cycle, phase, node, cost) USING KEY (run, cycle, phase, node) AS (SELECT s.run, s.cycle, s.phase, s.a, CASE WHEN bool_or(f.bottom) THEN min(s.i) ELSE 1000000000 END FROM steps s JOIN flagged f ON f.run = s.run AND f.cycle = s.cycle AND f.phase = s.phase AND f.id = s.a GROUP BY 1, 2, 3, 4
  UNION SELECT c.run, c.cycle, c.phase, c.node, min(greatest(p.cost, s.i)) FROM reach p JOIN steps s ON s.run = p.run AND s.cycle = p.cycle AND s.phase = p.phase AND s.a = p.node
  JOIN recurring.reach c ON c.run = p.run AND c.cycle = p.cycle AND c.phase = p.phase AND c.node = s.b WHERE greatest(p.cost, s.i) < c.cost GROUP BY 1, 2, 3, 4)"""
# Giants by components of the first edges; spans by the least greatest rank on a path from the bottom.
register("topo_percolation", lambda s, d: _sided(s, d, net.percolation), "run cycle phase contacts loop_births", "value_sum value_mean value_p99 share_top1 share_top5 share_top10 loop_fraction giant_top1 giant_top5 giant_top10 bottom_top bottom_side", "RECURSIVE " + _RANKED, """
  WITH sums AS (SELECT run, cycle, phase, count(*) AS contacts, sum(force) AS value_sum, avg(force) AS value_mean, quantile_cont(force, 0.99) AS value_p99, sum(force) FILTER ((i - 1) / m::DOUBLE < 0.01::DOUBLE) / sum(force) AS share_top1,
  sum(force) FILTER ((i - 1) / m::DOUBLE < 0.05::DOUBLE) / sum(force) AS share_top5, sum(force) FILTER ((i - 1) / m::DOUBLE < 0.1::DOUBLE) / sum(force) AS share_top10 FROM ranked GROUP BY 1, 2, 3),
  parts AS (SELECT run, cycle, phase, mark, component, count(*) AS n FROM label GROUP BY 1, 2, 3, 4, 5),
  giants AS (SELECT run, cycle, phase, max(n) FILTER (mark = 1) AS g1, max(n) FILTER (mark = 5) AS g5, max(n) FILTER (mark = 10) AS g10, CAST(sum(n) FILTER (mark = 100) AS BIGINT) AS nodes, count(*) FILTER (mark = 100) AS comps FROM parts GROUP BY 1, 2, 3),
  spans AS (SELECT r.run, r.cycle, r.phase, min(cost) FILTER (top AND cost < 1000000000) AS bt, min(cost) FILTER (side AND cost < 1000000000) AS bs FROM reach r JOIN flagged f ON f.run = r.run AND f.cycle = r.cycle AND f.phase = r.phase AND f.id = r.node GROUP BY 1, 2, 3)
  SELECT s.*, contacts - nodes + comps AS loop_births, (contacts - nodes + comps) / contacts::DOUBLE AS loop_fraction, g1 / nodes::DOUBLE AS giant_top1, g5 / nodes::DOUBLE AS giant_top5, g10 / nodes::DOUBLE AS giant_top10,
  bt / contacts::DOUBLE AS bottom_top, bs / contacts::DOUBLE AS bottom_side FROM sums s JOIN giants g ON g.run = s.run AND g.cycle = s.cycle AND g.phase = s.phase JOIN spans p ON p.run = s.run AND p.cycle = s.cycle AND p.phase = s.phase""")
register("topo_loops", lambda s, d: net.percolation(materialize(contacts(s, d)), STATE), "run cycle phase loop_births", "loop_fraction loop_value_share giant_top1 giant_top5 giant_top10 giant_half_fraction")
register("topo_spanning", lambda s, d: net.spanning_percolation(contacts(s, d), fr.boundary_flags(nodes(s, d), STATE), STATE), "run cycle phase", "span_fraction")
register("topo_curve", lambda s, d: net.filtration_curve(materialize(contacts(s, d)), STATE), "run cycle phase", "fraction loop_rate loop_share loop_total_share giant_share value_share")
register("topo_curve_summary", lambda s, d: net.curve_summary(materialize(contacts(s, d)), STATE), "run cycle phase", "first_loop_fraction first_loop_value_share loop_rate_area loop_value_area giant_area top5_share")
register("topo_enrichment", lambda s, d: net.loop_enrichment(net.filtration_edges(contacts(s, d), STATE), STATE), "run cycle phase", "loop_fraction loop_share enrichment log_enrichment")
register("topo_enrichment_delta", lambda s, d: fr.phase_delta(net.loop_enrichment(net.filtration_edges(contacts(s, d), STATE), STATE), ["run", "cycle"], "phase", ["enrichment", "log_enrichment"]), "run cycle", "enrichment_cold enrichment_hot enrichment_hot_minus_cold log_enrichment_hot_minus_cold")
register("topo_force_shuffle_null", lambda s, d: net.force_shuffle_null(materialize(contacts(s, d)), STATE, 24, giants=False), "run cycle phase rep loop_births", "loop_value_share")
register("topo_order_null", lambda s, d: net.order_null(materialize(contacts(s, d)), STATE, 25), "run cycle phase rep loops", "loop_area")
register("topo_spatial", lambda s, d: _spatial(s, d), "run cycle phase", "loop_boundary_share loop_z loop_r")


def _spatial(s, d):
    e = net.filtration_edges(contacts(s, d), STATE).filter("closes")
    e = fr.edge_position(e.select(*STATE, "id1", "id2", "force"), nodes(s, d), STATE)
    w = F.sum("force")
    return e.groupBy(*STATE).agg((F.sum(F.when(F.col("boundary_edge"), F.col("force")).otherwise(0.0)) / w).alias("loop_boundary_share"), (F.sum(F.col("force") * F.col("z_mid")) / w).alias("loop_z"), (F.sum(F.col("force") * F.col("r_mid")) / w).alias("loop_r"))


def _ranks(src: str, by: str, x: str, y: str) -> str:
    part = f"PARTITION BY {by}, " if by else "PARTITION BY "
    only = f"PARTITION BY {by} " if by else ""
    return f"SELECT *, rank() OVER ({only}ORDER BY {x}) + (count(*) OVER ({part}{x}) - 1) / 2.0::DOUBLE AS rx, rank() OVER ({only}ORDER BY {y}) + (count(*) OVER ({part}{y}) - 1) / 2.0::DOUBLE AS ry FROM {src}"


def _p(r: str, n: str) -> str:
    """SQL of the two-sided p of a correlation: Student's t has finite sums for whole degrees (even and odd)."""
    c, df = f"(1 - {r} * {r})", f"({n} - 2)"
    even = f"1 - abs({r}) * list_sum(list_transform(range(0, CAST({df} // 2 AS BIGINT)), lambda k: exp(lgamma(k + 0.5) - lgamma(0.5) - lgamma(k + 1) + k * ln({c}))))"
    odd = f"1 - 2 / pi() * (asin(abs({r})) + abs({r}) * sqrt({c}) * coalesce(list_sum(list_transform(range(0, CAST(({df} - 1) // 2 AS BIGINT)), lambda k: exp(lgamma(k + 1) + lgamma(1.5) - lgamma(k + 1.5) + k * ln({c})))), 0))"
    return f"CASE WHEN {df} % 2 = 0 THEN {even} ELSE {odd} END"


_C = ", c AS (SELECT *, round(x - avg(x) OVER (PARTITION BY regime_id), 9) AS xc, round(y - avg(y) OVER (PARTITION BY regime_id), 9) AS yc, round(w - avg(w) OVER (PARTITION BY regime_id), 9) AS wc FROM panel)"
register("st_spearman", lambda s, d: st.with_p(st.spearman(panel(s, d), G, "n", "w")), "regime_id n", "rho p", PANEL, f"SELECT *, {_p('rho', 'n')} AS p FROM (SELECT regime_id, count(*) AS n, corr(rx, ry) AS rho FROM ({_ranks('panel', 'regime_id', 'n', 'w')}) GROUP BY 1)")
register("st_spearman_centred", lambda s, d: st.with_p(st.spearman(panel(s, d).withColumn("test", F.lit("x")), ["test"], "x", "w", 4, G)), "test n", "rho p", PANEL + _C, f"SELECT *, {_p('rho', 'n')} AS p FROM (SELECT 'x' AS test, count(*) AS n, corr(rx, ry) AS rho FROM ({_ranks('c', '', 'xc', 'wc')}))")
register("st_pearson", lambda s, d: st.with_p(st.pearson(panel(s, d), G, "x", "w"), "r"), "regime_id n", "r p", PANEL, f"SELECT *, {_p('r', 'n')} AS p FROM (SELECT regime_id, count(*) AS n, corr(x, w) AS r FROM panel GROUP BY 1)")
register("st_pair_table", lambda s, d: st.pair_table(panel(s, d), ["x", "y"], ["w"], G), "predictor target n", "rho r", PANEL + _C,
  f"SELECT 'x' AS predictor, 'w' AS target, count(*) AS n, corr(rx, ry) AS rho, corr(xc, wc) AS r FROM ({_ranks('c', '', 'xc', 'wc')}) UNION ALL SELECT 'y', 'w', count(*), corr(rx, ry), corr(yc, wc) FROM ({_ranks('c', '', 'yc', 'wc')})")
register("st_group_profile", lambda s, d: st.group_profile(panel(s, d), G, "x", "w"), "groups", "mean_rho min_rho max_rho mean_abs_rho", PANEL,
  f"SELECT count(rho) AS groups, avg(rho) AS mean_rho, min(rho) AS min_rho, max(rho) AS max_rho, avg(abs(rho)) AS mean_abs_rho FROM (SELECT regime_id, corr(rx, ry) AS rho FROM ({_ranks('panel', 'regime_id', 'x', 'w')}) GROUP BY 1)")
register("st_leave_one_corr", lambda s, d: st.with_p(st.leave_one_out(panel(s, d), "regime_id", "x", "w")), "left_out n", "rho p", PANEL + _C + ", l AS (SELECT c.*, g.regime_id AS left_out FROM c JOIN (SELECT DISTINCT regime_id FROM c) g ON c.regime_id <> g.regime_id)",
  f"SELECT *, {_p('rho', 'n')} AS p FROM (SELECT left_out, count(*) AS n, corr(rx, ry) AS rho FROM ({_ranks('l', 'left_out', 'xc', 'wc')}) GROUP BY 1)")
_LAG = ", r AS (SELECT *, row_number() OVER (PARTITION BY regime_id ORDER BY cycle) AS i FROM panel), l AS (SELECT a.regime_id, a.cycle, CAST(k.k AS INTEGER) AS lag, a.w AS y, b.x FROM r a CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS k) k JOIN r b ON a.regime_id = b.regime_id AND b.i = a.i - k.k)"
register("st_lag_scan", lambda s, d: st.with_p(st.lag_scan(panel(s, d), G, "cycle", "x", "w", [0, 1, 2, 3])), "lag n", "rho p", PANEL + _LAG + ", lc AS (SELECT lag, round(x - avg(x) OVER (PARTITION BY lag, regime_id), 9) AS xc, round(y - avg(y) OVER (PARTITION BY lag, regime_id), 9) AS yc FROM l)",
  f"SELECT *, {_p('rho', 'n')} AS p FROM (SELECT lag, count(*) AS n, corr(rx, ry) AS rho FROM ({_ranks('lc', 'lag', 'xc', 'yc')}) GROUP BY 1)")
register("st_autocorr", lambda s, d: st.autocorrelation(panel(s, d), G, "cycle", "w", [1, 2, 3]), "regime_id lag n", "r", PANEL + ", r AS (SELECT *, row_number() OVER (PARTITION BY regime_id ORDER BY cycle) AS i FROM panel)",
  "SELECT a.regime_id, CAST(k.k AS INTEGER) AS lag, count(*) AS n, corr(b.w, a.w) AS r FROM r a CROSS JOIN (SELECT unnest([1, 2, 3]) AS k) k JOIN r b ON a.regime_id = b.regime_id AND b.i = a.i - k.k GROUP BY 1, 2")
register("st_theil_sen", lambda s, d: st.theil_sen(panel(s, d), G, "cycle", "w"), "regime_id", "slope", PANEL, "SELECT a.regime_id, quantile_cont((b.w - a.w) / (b.cycle - a.cycle), 0.5) AS slope FROM panel a JOIN panel b ON a.regime_id = b.regime_id AND a.cycle < b.cycle GROUP BY 1")
register("st_group_ols", lambda s, d: st.group_ols(panel(s, d), G, "x", "w"), "regime_id n", "slope intercept r2", PANEL, "SELECT regime_id, count(*) AS n, regr_slope(w, x) AS slope, regr_intercept(w, x) AS intercept, regr_r2(w, x) AS r2 FROM panel GROUP BY 1")
register("st_log_decay", lambda s, d: st.log_decay(panel(s, d), G, "cycle", "x"), "regime_id n", "slope half_life", PANEL, "SELECT regime_id, count(*) AS n, regr_slope(ln(x), cycle) AS slope, CASE WHEN regr_slope(ln(x), cycle) < 0 THEN ln(2) / -regr_slope(ln(x), cycle) END AS half_life FROM panel WHERE x > 0 GROUP BY 1")
register("st_ols_r2", lambda s, d: st.ols_r2(win.zscore(panel(s, d), G, ["x", "y", "w"]), G, ["x_z"], "w_z"), "regime_id n", "r2", PANEL, "SELECT regime_id, count(*) AS n, regr_r2(w, x) AS r2 FROM panel GROUP BY 1")
_P = ", q AS (SELECT x - avg(x) OVER (PARTITION BY regime_id) AS a, w - avg(w) OVER (PARTITION BY regime_id) AS b, y - avg(y) OVER (PARTITION BY regime_id) AS c FROM panel), f AS (SELECT regr_slope(a, c) AS sa, regr_intercept(a, c) AS ia, regr_slope(b, c) AS sb, regr_intercept(b, c) AS ib FROM q), e AS (SELECT round(a - ia - sa * c, 9) AS xr, round(b - ib - sb * c, 9) AS wr FROM q CROSS JOIN f)"
register("st_partial", lambda s, d: st.partial_spearman(panel(s, d), G, "x", "w", ["y"]), "n", "rho", PANEL + _P, f"SELECT count(*) AS n, corr(rx, ry) AS rho FROM ({_ranks('e', '', 'xr', 'wr')})")
register("st_mediation", lambda s, d: st.mediation(panel(s, d), "x", "y", "w"), "n", "a b direct total indirect", PANEL, """
  SELECT n, xm / xx AS a, (xx * my - xm * xy) / (xx * mm - xm * xm) AS b, (mm * xy - xm * my) / (xx * mm - xm * xm) AS direct, xy / xx AS total, xm / xx * (xx * my - xm * xy) / (xx * mm - xm * xm) AS indirect
  FROM (SELECT count(*) AS n, var_pop(x) AS xx, var_pop(y) AS mm, covar_pop(x, y) AS xm, covar_pop(x, w) AS xy, covar_pop(y, w) AS my FROM panel)""")  # fmt: skip
register("st_r2_gain", lambda s, d: mod.r2_gain(win.zscore(panel(s, d), G, ["x", "y", "w"]), ["x_z"], "y_z", "w_z"), "", "r2_base r2_full gain", PANEL, f"""
  SELECT rxw * rxw AS r2_base, (rxw * rxw + ryw * ryw - 2 * rxw * ryw * rxy) / (1 - rxy * rxy) AS r2_full, (rxw * rxw + ryw * ryw - 2 * rxw * ryw * rxy) / (1 - rxy * rxy) - rxw * rxw AS gain
  FROM (SELECT corr(a, c) AS rxw, corr(b, c) AS ryw, corr(a, b) AS rxy FROM (SELECT (x - avg(x) OVER {_W}) / stddev_pop(x) OVER {_W} AS a, (y - avg(y) OVER {_W}) / stddev_pop(y) OVER {_W} AS b, (w - avg(w) OVER {_W}) / stddev_pop(w) OVER {_W} AS c FROM panel))""")  # fmt: skip
register("st_shapley_r2", lambda s, d: st.shapley_r2(win.zscore(panel(s, d), G, ["x", "y", "w"]), ["x_z", "y_z"], "w_z"), "feature", "share r2", PANEL, f"""
  WITH r AS (SELECT rxw * rxw AS a, ryw * ryw AS b, (rxw * rxw + ryw * ryw - 2 * rxw * ryw * rxy) / (1 - rxy * rxy) AS ab FROM (SELECT corr(a, c) AS rxw, corr(b, c) AS ryw, corr(a, b) AS rxy
  FROM (SELECT (x - avg(x) OVER {_W}) / stddev_pop(x) OVER {_W} AS a, (y - avg(y) OVER {_W}) / stddev_pop(y) OVER {_W} AS b, (w - avg(w) OVER {_W}) / stddev_pop(w) OVER {_W} AS c FROM panel)))
  SELECT 'x_z' AS feature, (a + ab - b) / 2 AS share, ab AS r2 FROM r UNION ALL SELECT 'y_z', (b + ab - a) / 2, ab FROM r""")
register("st_threshold", lambda s, d: st.threshold(win.rare_flag(panel(s, d), G, "w", 0.8), "x", "rare"), "", "cut sensitivity specificity balanced_accuracy", PANEL, """
  WITH r AS (SELECT p.x AS s, CAST(w >= q AS INT) AS l FROM panel p JOIN (SELECT regime_id, quantile_cont(w, 0.8) AS q FROM panel GROUP BY 1) t ON p.regime_id = t.regime_id), v AS (SELECT DISTINCT s FROM r), m AS (SELECT (s + lag(s) OVER (ORDER BY s)) / 2 AS cut FROM v),
  e AS (SELECT cut, sum(CAST(l = 1 AND s >= cut AS INT)) / sum(l)::DOUBLE AS sensitivity, sum(CAST(l = 0 AND s < cut AS INT)) / sum(1 - l)::DOUBLE AS specificity FROM m CROSS JOIN r WHERE cut IS NOT NULL GROUP BY 1)
  SELECT cut, sensitivity, specificity, (sensitivity + specificity) / 2 AS balanced_accuracy FROM e ORDER BY round((sensitivity + specificity) / 2, 12) DESC, cut LIMIT 1""")
register("st_chi2", lambda s, d: st.chi2(contacts(s, d), "run", "phase"), "dof", "chi2 p", CONTACTS, """
  WITH n AS (SELECT run, phase, count(*) AS o FROM contacts GROUP BY 1, 2), e AS (SELECT a.run, b.phase, a.t * b.t / (SELECT sum(o) FROM n)::DOUBLE AS e FROM (SELECT run, sum(o) AS t FROM n GROUP BY 1) a CROSS JOIN (SELECT phase, sum(o) AS t FROM n GROUP BY 1) b)
  SELECT *, exp(-chi2 / 2) * list_sum(list_transform(range(0, CAST(dof // 2 AS BIGINT)), lambda k: pow(chi2 / 2, k) / gamma(k + 1))) AS p FROM (
  SELECT (count(DISTINCT e.run) - 1) * (count(DISTINCT e.phase) - 1) AS dof, sum((coalesce(o, 0) - e) * (coalesce(o, 0) - e) / e) AS chi2 FROM e LEFT JOIN n ON e.run = n.run AND e.phase = n.phase)""")  # p: the finite sum for an even number of degrees



def _u(*keys: str) -> str:
    return "CAST(('0x' || substr(md5(concat('0|', " + ", '|', ".join(keys) + ")), 1, 13)) AS BIGINT) / 4503599627370496.0::DOUBLE"


_REP = ", p AS (SELECT *, row_number() OVER (PARTITION BY regime_id ORDER BY cycle) - 1 AS i, count(*) OVER (PARTITION BY regime_id) AS size FROM panel), reps AS (SELECT CAST(unnest(range(1, 21)) AS INTEGER) AS rep)"
register("nul_group_perm", lambda s, d: nul.permute(panel(s, d), G, "cycle", "w", 20), "rep regime_id cycle", "w", PANEL + _REP, f"""
  SELECT a.rep, a.regime_id, a.cycle, b.w FROM (SELECT rep, regime_id, cycle, row_number() OVER (PARTITION BY rep, regime_id ORDER BY cycle) AS k FROM p CROSS JOIN reps) a
  JOIN (SELECT rep, regime_id, w, row_number() OVER (PARTITION BY rep, regime_id ORDER BY {_u('rep', 'regime_id', 'cycle')}, cycle) AS k FROM p CROSS JOIN reps) b ON a.rep = b.rep AND a.regime_id = b.regime_id AND a.k = b.k""")
register("nul_phase_perm", lambda s, d: nul.permute(panel(s, d).withColumn("parity", F.col("cycle") % 2), ["regime_id", "parity"], "cycle", "w", 20).groupBy("rep", "regime_id", "parity").agg(F.sum("w").alias("w"), F.max_by("w", "cycle").alias("last")), "rep regime_id parity", "w last", PANEL + _REP, f"""
  SELECT rep, regime_id, CAST(cycle % 2 AS INTEGER) AS parity, sum(w) AS w, arg_max(w, {_u('rep', 'regime_id', 'cycle % 2', 'cycle')}) AS last FROM p CROSS JOIN reps GROUP BY 1, 2, 3""")
register("nul_shift", lambda s, d: nul.circular_shift(panel(s, d), G, "cycle", "w", 20), "rep regime_id cycle", "w", PANEL + _REP, f"""
  SELECT a.rep, a.regime_id, a.cycle, b.w FROM (SELECT rep, p.* FROM p CROSS JOIN reps) a JOIN (SELECT rep, regime_id, w, (i + CAST(floor({_u('rep', 'regime_id')} * size) AS BIGINT)) % size AS j FROM p CROSS JOIN reps) b ON a.rep = b.rep AND a.regime_id = b.regime_id AND a.i = b.j""")
register("nul_row_boot", lambda s, d: nul.row_bootstrap(panel(s, d), G, "cycle", ["w"], 20), "rep regime_id slot", "w", PANEL + _REP, f"""
  SELECT a.rep, a.regime_id, CAST(a.i AS INTEGER) AS slot, b.w FROM (SELECT rep, p.* FROM p CROSS JOIN reps) a JOIN p b ON a.regime_id = b.regime_id AND b.i = CAST(floor({_u('a.rep', 'a.regime_id', 'a.i')} * a.size) AS BIGINT)""")
register("nul_block_boot", lambda s, d: nul.block_bootstrap(panel(s, d), G, "cycle", ["w"], 20), "rep regime_id slot", "w", PANEL + _REP, f"""
  SELECT a.rep, a.regime_id, CAST(a.i AS INTEGER) AS slot, b.w FROM (SELECT rep, p.* FROM p CROSS JOIN reps) a JOIN p b ON a.regime_id = b.regime_id AND b.i = CAST(floor({_u('a.rep', 'a.regime_id', 'a.i // 5')} * greatest(a.size - 4, 1)) AS BIGINT) + a.i % 5""")
register("nul_summary", lambda s, d: _summary(s, d), "test n", "observed p null_mean null_sd null_median null_low null_high", PANEL + _REP, f"""
  WITH z AS (SELECT 'x' AS test, a.rep, corr(b.x, a.w) AS v FROM (SELECT rep, p.* FROM p CROSS JOIN reps) a JOIN (SELECT rep, regime_id, x, (i + CAST(floor({_u('rep', 'regime_id')} * size) AS BIGINT)) % size AS j FROM p CROSS JOIN reps) b ON a.rep = b.rep AND a.regime_id = b.regime_id AND a.i = b.j GROUP BY 2),
  o AS (SELECT corr(x, w) AS observed FROM panel) SELECT test, count(v) AS n, observed, (count(*) FILTER (abs(v) >= abs(observed)) + 1) / (count(v) + 1)::DOUBLE AS p, avg(v) AS null_mean, stddev_samp(v) AS null_sd, quantile_cont(v, 0.5) AS null_median, quantile_cont(v, 0.025) AS null_low, quantile_cont(v, 0.975) AS null_high FROM z CROSS JOIN o GROUP BY test, observed""")  # fmt: skip


def _summary(s, d):
    p = panel(s, d)
    moved = nul.circular_shift(p, G, "cycle", "x", 20).join(p.select("regime_id", "cycle", "w"), ["regime_id", "cycle"])
    null = st.pearson(moved, ["rep"], "x", "w").select(F.lit("x").alias("test"), "r")
    return nul.null_summary(p.agg(F.corr("x", "w").alias("r")).withColumn("test", F.lit("x")), null, ["test"], "r")


register("mod_logo_linear", lambda s, d: _logo(s, d).withColumnRenamed("r2", "score"), "regime_id n", "score coef_intercept coef_x_z", PANEL + f", z AS (SELECT regime_id, cycle, (x - avg(x) OVER {_W}) / stddev_pop(x) OVER {_W} AS x, (w - avg(w) OVER {_W}) / stddev_pop(w) OVER {_W} AS w FROM panel)", """
  SELECT t.regime_id, count(*) AS n, 1 - sum((t.w - i - k * t.x) * (t.w - i - k * t.x)) / sum((t.w - m) * (t.w - m)) AS score, any_value(i) AS coef_intercept, any_value(k) AS coef_x_z FROM z t
  JOIN (SELECT g.regime_id, regr_intercept(z.w, z.x) AS i, regr_slope(z.w, z.x) AS k, avg(z.w) AS m FROM z JOIN (SELECT DISTINCT regime_id FROM z) g ON z.regime_id <> g.regime_id GROUP BY 1) f ON t.regime_id = f.regime_id GROUP BY 1""")


def _logo(s, d):
    return mod.logo_linear(win.zscore(panel(s, d), G, ["x", "w"]), "regime_id", ["x_z"], "w_z")


register("mod_predictions", lambda s, d: mod.pooled_r2(mod.predict_linear(win.zscore(panel(s, d), G, ["x", "w"]), _logo(s, d), "regime_id", ["x_z"]), "w_z", by=["regime_id"]), "regime_id n", "r2 rmse", PANEL + f", z AS (SELECT regime_id, cycle, (x - avg(x) OVER {_W}) / stddev_pop(x) OVER {_W} AS x, (w - avg(w) OVER {_W}) / stddev_pop(w) OVER {_W} AS w FROM panel)", """
  SELECT t.regime_id, count(*) AS n, 1 - avg((t.w - i - k * t.x) ** 2) / var_pop(t.w) AS r2, sqrt(avg((t.w - i - k * t.x) ** 2)) AS rmse FROM z t
  JOIN (SELECT g.regime_id, regr_intercept(z.w, z.x) AS i, regr_slope(z.w, z.x) AS k FROM z JOIN (SELECT DISTINCT regime_id FROM z) g ON z.regime_id <> g.regime_id GROUP BY 1) f ON t.regime_id = f.regime_id GROUP BY 1""")
register("mod_forward_linear", lambda s, d: mod.forward_linear(panel(s, d).withColumns({"x": F.col("x") / 1e6, "w": F.col("w") / 1e4}), G, "cycle", ["x"], "w", 18), "regime_id n_train n_test", "r2", PANEL, """
  SELECT t.regime_id, any_value(nt) AS n_train, count(*) AS n_test, 1 - sum((w / 1e4 - i - k * x / 1e6) ** 2) / sum((w / 1e4 - m) ** 2) AS r2 FROM panel t
  JOIN (SELECT regime_id, count(*) AS nt, regr_intercept(w / 1e4, x / 1e6) AS i, regr_slope(w / 1e4, x / 1e6) AS k, avg(w / 1e4) AS m FROM panel WHERE cycle <= 18 GROUP BY 1) f ON t.regime_id = f.regime_id WHERE cycle > 18 GROUP BY 1""")
register("mod_forward_baseline", lambda s, d: mod.forward_baseline(panel(s, d), G, "cycle", "w", 18), "regime_id n_test", "r2_previous rmse_mean", PANEL, f"""
  SELECT regime_id, count(*) AS n_test, 1 - sum((w - pv) * (w - pv)) / sum((w - m) * (w - m)) AS r2_previous, sqrt(avg((w - m) * (w - m))) AS rmse_mean FROM (SELECT *, lag(w) OVER {_O} AS pv, avg(w) FILTER (cycle <= 18) OVER {_W} AS m FROM panel) WHERE cycle > 18 GROUP BY 1""")

_CODE = ", k AS (SELECT *, CAST(floor((row_number() OVER (PARTITION BY regime_id ORDER BY x, cycle) - 1) / (count(*) OVER (PARTITION BY regime_id))::DOUBLE * 4) AS INTEGER) AS cx, CAST(floor((row_number() OVER (PARTITION BY regime_id ORDER BY w, cycle) - 1) / (count(*) OVER (PARTITION BY regime_id))::DOUBLE * 4) AS INTEGER) AS cw FROM panel)"


def _codes(s, d):
    return win.equal_count(win.equal_count(panel(s, d), G, "x", 4, ["cycle"], "cx"), G, "w", 4, ["cycle"], "cw")


_MI = "SELECT {by}sum(n / t * log2(n * t / (nx * ny))) AS mi, -sum(n / t * log2(ny / t)) AS hy FROM (SELECT *, sum(n) OVER ({p}) AS t, sum(n) OVER ({px}) AS nx, sum(n) OVER ({py}) AS ny FROM (SELECT {by}{x} AS a, {y} AS b, count(*)::DOUBLE AS n FROM k GROUP BY ALL)){g}"
register("inf_entropy", lambda s, d: inf.entropy_bits(contacts(s, d), ["run"], "id2"), "run", "bits", CONTACTS, "SELECT run, -sum(p * log2(p)) AS bits FROM (SELECT run, count(*) / sum(count(*)) OVER (PARTITION BY run) AS p FROM contacts GROUP BY run, id2) GROUP BY 1")
register("inf_mi", lambda s, d: inf.mutual_info(_codes(s, d), G, "cx", "cw"), "regime_id", "mi nmi", PANEL + _CODE, "SELECT regime_id, mi, mi / hy AS nmi FROM (" + _MI.format(by="regime_id, ", p="PARTITION BY regime_id", px="PARTITION BY regime_id, a", py="PARTITION BY regime_id, b", x="cx", y="cw", g=" GROUP BY regime_id") + ")")
register("inf_cmi", lambda s, d: inf.conditional_mi(_codes(s, d), [], "cx", "cw", "regime_id"), "", "cmi", PANEL + _CODE, "SELECT sum(n / t * log2(n * nz / (nx * ny))) AS cmi FROM (SELECT *, sum(n) OVER () AS t, sum(n) OVER (PARTITION BY regime_id) AS nz, sum(n) OVER (PARTITION BY regime_id, cx) AS nx, sum(n) OVER (PARTITION BY regime_id, cw) AS ny FROM (SELECT regime_id, cx, cw, count(*)::DOUBLE AS n FROM k GROUP BY ALL))")
register("inf_decompose", lambda s, d: inf.decompose(_codes(s, d).withColumn("late", F.col("cycle") > 15), "late", "cx", "cw"), "", "route_mi predictor_mi joint_mi predictor_given_route route_given_predictor", PANEL + _CODE,
  "SELECT a.mi AS route_mi, b.mi AS predictor_mi, c.mi AS joint_mi, c.mi - a.mi AS predictor_given_route, c.mi - b.mi AS route_given_predictor FROM " + " CROSS JOIN ".join("(" + _MI.format(by="", p="", px="PARTITION BY a", py="PARTITION BY b", x=x, y="cw", g="") + f") {n}" for n, x in (("a", "cycle > 15"), ("b", "cx"), ("c", "concat(cycle > 15, '|', cx)"))))
_RARE = ", k AS (SELECT p.*, CAST(w >= q AS INTEGER) AS rare FROM panel p JOIN (SELECT regime_id, quantile_cont(w, 0.8) AS q FROM panel GROUP BY 1) t ON p.regime_id = t.regime_id)"
_rare = lambda s, d: win.rare_flag(panel(s, d), G, "w", 0.8)
register("rsk_auc", lambda s, d: inf.auc(_rare(s, d), G, "n", "rare"), "regime_id n", "auc", PANEL + _RARE,
  "SELECT a.regime_id, any_value(t.n) AS n, avg(CASE WHEN a.n > b.n THEN 1.0 WHEN a.n = b.n THEN 0.5 ELSE 0 END) AS auc FROM k a JOIN k b ON a.regime_id = b.regime_id AND a.rare = 1 AND b.rare = 0 JOIN (SELECT regime_id, count(*) AS n FROM k GROUP BY 1) t ON t.regime_id = a.regime_id GROUP BY 1")
register("rsk_quintile", lambda s, d: inf.quantile_risk(_rare(s, d), G, "x", "rare"), "regime_id bin n", "rate ratio", PANEL + _RARE, """
  SELECT regime_id, bin, count(*) AS n, avg(rare) AS rate, avg(rare) / any_value(base) AS ratio FROM (SELECT k.*, CAST(x > a AS INT) + CAST(x > b AS INT) + CAST(x > c AS INT) + CAST(x > d AS INT) AS bin, base FROM k JOIN (SELECT regime_id, quantile_cont(x, 0.2) AS a, quantile_cont(x, 0.4) AS b, quantile_cont(x, 0.6) AS c, quantile_cont(x, 0.8) AS d, avg(rare) AS base FROM k GROUP BY 1) q ON k.regime_id = q.regime_id) GROUP BY 1, 2""")
register("rsk_gate", lambda s, d: inf.gate_risk(_rare(s, d).withColumn("gate", F.col("cycle") % 3 == 0), "gate", "rare"), "", "rate_in rate_out difference", PANEL + _RARE, "SELECT avg(rare) FILTER (cycle % 3 = 0) AS rate_in, avg(rare) FILTER (cycle % 3 <> 0) AS rate_out, avg(rare) FILTER (cycle % 3 = 0) - avg(rare) FILTER (cycle % 3 <> 0) AS difference FROM k")
register("rsk_timeline", lambda s, d: win.rare_flag(_rare(s, d), G, "x", 0.75, "high"), "regime_id cycle rare high", "", PANEL + _RARE, "SELECT k.regime_id, cycle, rare, CAST(x >= q AS INTEGER) AS high FROM k JOIN (SELECT regime_id, quantile_cont(x, 0.75) AS q FROM k GROUP BY 1) t ON k.regime_id = t.regime_id")

_Z = f", z AS (SELECT regime_id, cycle, (x - avg(x) OVER {_W}) / stddev_samp(x) OVER {_W} AS u, (w - avg(w) OVER {_W}) / stddev_samp(w) OVER {_W} AS v, (lead(x) OVER {_O} - avg(x) OVER {_W}) / stddev_samp(x) OVER {_W} AS next_u, (lead(w) OVER {_O} - avg(w) OVER {_W}) / stddev_samp(w) OVER {_W} AS next_v FROM panel)"
_M = ", m AS (SELECT regime_id, n, (syy * xp - sxy * yp) / det AS a11, (sxx * yp - sxy * xp) / det AS a12, (syy * xq - sxy * yq) / det AS a21, (sxx * yq - sxy * xq) / det AS a22 FROM (SELECT *, sxx * syy - sxy * sxy AS det FROM (SELECT regime_id, count(*) AS n, var_pop(u) AS sxx, covar_pop(u, v) AS sxy, var_pop(v) AS syy, covar_pop(u, next_u) AS xp, covar_pop(v, next_u) AS yp, covar_pop(u, next_v) AS xq, covar_pop(v, next_v) AS yq FROM z WHERE next_u IS NOT NULL GROUP BY 1)))"
_coords = lambda s, d: geo.map_coordinates(panel(s, d), G, "cycle", "x", "w")
_maps = lambda s, d: geo.map_fit(_coords(s, d), G)
register("map_coords", _coords, "regime_id cycle", "u v next_u next_v", PANEL + _Z, "SELECT * FROM z")
register("map_fit", _maps, "regime_id n", "a11 a12 a21 a22 determinant spectral_radius", PANEL + _Z + _M, """
  SELECT *, a11 * a22 - a12 * a21 AS determinant, CASE WHEN (a11 + a22) ** 2 / 4 >= a11 * a22 - a12 * a21 THEN abs((a11 + a22) / 2) + sqrt(greatest((a11 + a22) ** 2 / 4 - (a11 * a22 - a12 * a21), 0)) ELSE sqrt(abs(a11 * a22 - a12 * a21)) END AS spectral_radius FROM m""")
register("map_normal_form", lambda s, d: geo.map_normal_form(_maps(s, d)), "regime_id", "half_trace split shear circulation", PANEL + _Z + _M, "SELECT regime_id, (a11 + a22) / 2 AS half_trace, (a11 - a22) / 2 AS split, (a12 + a21) / 2 AS shear, (a21 - a12) / 2 AS circulation FROM m")
register("map_gain", lambda s, d: geo.map_gain(_maps(s, d), G), "regime_id power", "gain", "RECURSIVE " + PANEL + _Z + _M + """, pw(regime_id, power, a, b, c, d) AS (SELECT regime_id, 1, a11, a12, a21, a22 FROM m
  UNION ALL SELECT p.regime_id, power + 1, a * a11 + b * a21, a * a12 + b * a22, c * a11 + d * a21, c * a12 + d * a22 FROM pw p JOIN m ON p.regime_id = m.regime_id WHERE power < 15)""", """
  SELECT regime_id, CAST(power AS INTEGER) AS power, sqrt((f + sqrt(greatest(f * f - 4 * g, 0))) / 2) AS gain FROM (SELECT regime_id, power, a * a + b * b + c * c + d * d AS f, (a * d - b * c) ** 2 AS g FROM pw)""")
register("map_modes", lambda s, d: geo.map_modes(_maps(s, d), G), "regime_id", "sigma1 sigma2", PANEL + _Z + _M,
  "SELECT regime_id, sqrt((f + sqrt(greatest(f * f - 4 * g, 0))) / 2) AS sigma1, sqrt(greatest((f - sqrt(greatest(f * f - 4 * g, 0))) / 2, 0)) AS sigma2 FROM (SELECT regime_id, a11 * a11 + a12 * a12 + a21 * a21 + a22 * a22 AS f, (a11 * a22 - a12 * a21) ** 2 AS g FROM m)")
register("map_lyapunov", lambda s, d: geo.map_lyapunov(_maps(s, d), G), "regime_id", "p11 p12 p22 anisotropy stability_margin")
_S = f", st AS (SELECT * FROM (SELECT regime_id, cycle, lead(cycle) OVER {_O} AS next_cycle, u, v, lead(u) OVER {_O} AS nu, lead(v) OVER {_O} AS nv FROM z) WHERE nu IS NOT NULL)"
register("geo_flow", lambda s, d: geo.steps(_coords(s, d), G, "cycle", "u", "v"), "regime_id cycle next_cycle", "dx dy step contraction area", PANEL + _Z + _S, "SELECT regime_id, cycle, next_cycle, nu - u AS dx, nv - v AS dy, sqrt((nu - u) * (nu - u) + (nv - v) * (nv - v)) AS step, sqrt(u * u + v * v) - sqrt(nu * nu + nv * nv) AS contraction, (u * nv - nu * v) / 2 AS area FROM st")
register("geo_path", lambda s, d: geo.path(_coords(s, d), G, "cycle", "u", "v"), "regime_id segments", "signed_area counterclockwise clockwise arc_length net up down persistence", PANEL + _Z + _S, """
  SELECT regime_id, count(*) AS segments, sum((u * nv - nu * v) / 2) AS signed_area, sum(greatest((u * nv - nu * v) / 2, 0)) AS counterclockwise, sum(least((u * nv - nu * v) / 2, 0)) AS clockwise, sum(sqrt((nu - u) ** 2 + (nv - v) ** 2)) AS arc_length, sqrt(sum(nu - u) ** 2 + sum(nv - v) ** 2) AS net,
  sum(greatest(nv - v, 0)) AS up, sum(least(nv - v, 0)) AS down, sqrt(sum(nu - u) ** 2 + sum(nv - v) ** 2) / sum(sqrt((nu - u) ** 2 + (nv - v) ** 2)) AS persistence FROM st GROUP BY 1""")
register("geo_loop_polygon", lambda s, d: geo.polygon_area(_coords(s, d), G, "cycle", [("u", "v"), ("v", "u")]), "regime_id", "signed_area area", PANEL + _Z + ", q AS (SELECT regime_id, cycle, k, CASE WHEN k = 0 THEN u ELSE v END AS a, CASE WHEN k = 0 THEN v ELSE u END AS b FROM z CROSS JOIN (SELECT unnest([0, 1]) AS k))", """
  SELECT regime_id, sum(t) AS signed_area, abs(sum(t)) AS area FROM (SELECT regime_id, (a * coalesce(lead(b) OVER w, first_value(b) OVER w) - coalesce(lead(a) OVER w, first_value(a) OVER w) * b) / 2 AS t FROM q WINDOW w AS (PARTITION BY regime_id ORDER BY cycle, k)) GROUP BY 1""")
register("geo_segment_displacement", lambda s, d: geo.segment_displacement(_coords(s, d).withColumn("seg", F.when(F.col("cycle") <= 10, "early").when(F.col("cycle") <= 20, "middle").otherwise("late")), G, "seg", "u", "v", "early", "late"), "regime_id", "x_first y_first x_last y_last norm angle", PANEL + _Z, """
  SELECT *, sqrt((x_last - x_first) ** 2 + (y_last - y_first) ** 2) AS norm, degrees(atan2(y_last - y_first, x_last - x_first)) AS angle FROM (SELECT regime_id, quantile_cont(u, 0.5) FILTER (cycle <= 10) AS x_first, quantile_cont(v, 0.5) FILTER (cycle <= 10) AS y_first, quantile_cont(u, 0.5) FILTER (cycle > 20) AS x_last, quantile_cont(v, 0.5) FILTER (cycle > 20) AS y_last FROM z GROUP BY 1)""")
register("geo_order_null", lambda s, d: geo.order_null(_coords(s, d), G, "cycle", "u", "v", 20), "rep regime_id", "signed_area", PANEL + _Z + ", reps AS (SELECT CAST(unnest(range(1, 21)) AS INTEGER) AS rep)", f"""
  SELECT rep, regime_id, sum(a) AS signed_area FROM (SELECT rep, regime_id, (u * lead(v) OVER w - lead(u) OVER w * v) / 2 AS a FROM z CROSS JOIN reps WINDOW w AS (PARTITION BY rep, regime_id ORDER BY {_u('rep', 'regime_id', 'cycle')})) GROUP BY 1, 2""")
