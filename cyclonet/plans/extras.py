"""Queries of iterated fits, composite panels and the remaining summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import fits
from ..operators import frames as fr
from ..operators import geometry as geo
from ..operators import indices as ix
from ..operators import information as inf
from ..operators import models as mod
from ..operators import networks as net
from ..operators import resampling as nul
from ..operators import statistics as st
from ..operators import windows as win
from ..shared import materialize
from .panels import three_sides
from .registry import register
from .views import CONTACTS, PANEL, contacts, panel, particles

STATE = ["run", "cycle", "phase"]
G = ["regime_id"]
_W = "(PARTITION BY regime_id)"
_O = "(PARTITION BY regime_id ORDER BY cycle)"
_z = lambda s, d: win.zscore(panel(s, d), G, ["x", "y", "w"])
_rare = lambda s, d: win.rare_flag(_z(s, d), G, "w", 0.8)
_ZSQL = f", z AS (SELECT *, (x - avg(x) OVER {_W}) / stddev_pop(x) OVER {_W} AS x_z, (y - avg(y) OVER {_W}) / stddev_pop(y) OVER {_W} AS y_z, (w - avg(w) OVER {_W}) / stddev_pop(w) OVER {_W} AS w_z FROM panel)"


def dimensionless(df, by, factors: list[str], gap: str, activation: str):
    """Product of the factors over (1 + gap) times the activation, the same without the last factor, and group medians."""
    full, part = F.lit(1.0), F.lit(1.0)
    for k, c in enumerate(factors):
        full = full * F.col(c)
        part = part * F.col(c) if k < len(factors) - 1 else part
    out = df.withColumns({"number": full / (1 + F.col(gap)) * F.col(activation), "ablated": part / (1 + F.col(gap)) * F.col(activation)})
    return out.groupBy(*by).agg(F.expr("percentile(number, 0.5)").alias("number"), F.expr("percentile(ablated, 0.5)").alias("ablated"))


register("prj_dimensionless", lambda s, d: dimensionless(panel(s, d).withColumns({"a": F.col("x") / 1e6, "b": F.col("w") / 1e5, "g": F.col("n") / 1e3}), G, ["a", "b"], "g", "z"), "regime_id", "number ablated", PANEL,
  "SELECT regime_id, quantile_cont(x / 1e6 * (w / 1e5) / (1 + n / 1e3) * z, 0.5) AS number, quantile_cont(x / 1e6 / (1 + n / 1e3) * z, 0.5) AS ablated FROM panel GROUP BY 1")
register("prj_orderlabel", lambda s, d: panel(s, d).groupBy("regime_id").agg(F.sum("n").alias("n")).join(F.broadcast(s.sql("SELECT * FROM VALUES ('R3', 1), ('R1', 2), ('R5', 3), ('R2', 4), ('R4', 5) AS t(regime_id, place)")), "regime_id"), "regime_id place n", "", PANEL,
  "SELECT regime_id, CAST(CASE regime_id WHEN 'R3' THEN 1 WHEN 'R1' THEN 2 WHEN 'R5' THEN 3 WHEN 'R2' THEN 4 ELSE 5 END AS INTEGER) AS place, CAST(sum(n) AS BIGINT) AS n FROM panel GROUP BY 1")
def _overlaps(s, d):
    """Percolation of geometric contacts by falling overlap, with the overlaps at which loops are born (null: none)."""
    c, keys = materialize(fr.contact_overlap(particles(s, d), ["run", "cycle"])), ["run", "cycle"]
    return net.percolation(c, keys, "overlap").join(net.loop_values(c, keys, "overlap").drop("births"), keys, "left").fillna(0, ["positive_births"])


register("topo_overlap_percolation", _overlaps, "run cycle contacts loop_births positive_births", "giant_top5 giant_top10 value_sum birth_median birth_p90 positive_share")
register("topo_snapshot", lambda s, d: _snapshot(s, d), "run cycle phase shown shown_loops", "force_share loop_share top1_share top5_share loop_total_share bottom_side_first")


def _snapshot(s, d):
    """Of each state's strongest fifth of edges: their number, the loops among them, their share of the force, and the
    loops' share of that; of all edges: the force shares of the top 1 and 5 % and of the loops, and the edge fraction at
    which a tree first touches bottom and side (null: never)."""
    e = net.filtration_edges(contacts(s, d), STATE, nodes=three_sides(s, d), sides=("bottom", "top", "side"))
    shown = F.col("fraction") <= 0.2
    f = lambda c: F.sum(F.when(c, F.col("force")).otherwise(0.0))
    first = F.min(F.when(F.col("touches_bottom") & F.col("touches_side"), F.col("fraction")))
    return e.groupBy(*STATE).agg(
        F.sum(shown.cast("long")).alias("shown"), F.sum((shown & F.col("closes")).cast("long")).alias("shown_loops"), (f(shown) / F.sum("force")).alias("force_share"), (f(shown & F.col("closes")) / f(shown)).alias("loop_share"),
        (f(F.col("fraction") <= 0.01) / F.sum("force")).alias("top1_share"), (f(F.col("fraction") <= 0.05) / F.sum("force")).alias("top5_share"), (f(F.col("closes")) / F.sum("force")).alias("loop_total_share"), first.alias("bottom_side_first"),
    )


register("mod_logo_huber", lambda s, d: mod.pooled_r2(fits.logo_huber(_z(s, d), "regime_id", ["x_z", "y_z"], "w_z"), "w_z", by=G), "regime_id n", "r2 rmse")
register("mod_logo_ridge", lambda s, d: fits.logo_ridge(_z(s, d), "regime_id", ["x_z", "y_z"], "w_z"), "regime_id n", "strength r2 coef_intercept coef_x_z coef_y_z")
register("mod_forward_ridge", lambda s, d: mod.forward_ridge(win.lag_design(_z(s, d), G, "cycle", ["w_z"], [1, 2]), G, "cycle", ["x_z", "w_z_lag1", "w_z_lag2"], "w_z", 18), "regime_id n_train n_test", "strength r2")
register("mod_logo_logistic", lambda s, d: inf.auc(fits.logo_logistic(_rare(s, d), "regime_id", ["x_z", "y_z"], "rare"), G, "predicted", "rare"), "regime_id n", "auc")
register("mod_brier", lambda s, d: fits.brier(fits.logo_logistic(_rare(s, d), "regime_id", ["x_z", "y_z"], "rare", balanced=True), "rare"), "", "brier accuracy")
register("mod_loo_row", lambda s, d: fits.loo_row(_z(s, d), ["x_z"], "w_z"), "regime_id cycle", "predicted", PANEL + _ZSQL, """
  SELECT a.regime_id, a.cycle, regr_intercept(b.w_z, b.x_z) + regr_slope(b.w_z, b.x_z) * any_value(a.x_z) AS predicted FROM z a JOIN z b ON (a.regime_id, a.cycle) <> (b.regime_id, b.cycle) GROUP BY 1, 2""")
register("mod_heldout_profile", lambda s, d: mod.pooled_r2(fits.loo_row(_z(s, d), ["x_z", "y_z"], "w_z"), "w_z", by=G), "regime_id n", "r2 rmse")
register("mod_forward_fe", lambda s, d: mod.forward_linear(win.lag_design(_z(s, d), G, "cycle", ["w_z"], [1, 2]), G, "cycle", ["x_z", "w_z_lag1", "w_z_lag2"], "w_z", 18, ridge=1.0), "regime_id n_train n_test", "r2")
register("mod_increment", lambda s, d: _increment(s, d), "regime_id", "increment", PANEL + _ZSQL + """, f AS (SELECT g.regime_id, avg(w_z) AS m, avg(x_z) AS mx, avg(y_z) AS my, var_pop(x_z) AS sxx, covar_pop(x_z, y_z) AS sxy, var_pop(y_z) AS syy, covar_pop(x_z, w_z) AS xw, covar_pop(y_z, w_z) AS yw FROM z JOIN (SELECT DISTINCT regime_id FROM z) g ON z.regime_id <> g.regime_id GROUP BY 1)""", """
  SELECT z.regime_id, (sum((w_z - m - xw / sxx * (x_z - mx)) ** 2) - sum((w_z - m - (syy * xw - sxy * yw) / (sxx * syy - sxy * sxy) * (x_z - mx) - (sxx * yw - sxy * xw) / (sxx * syy - sxy * sxy) * (y_z - my)) ** 2)) / sum((w_z - m) ** 2) AS increment FROM z JOIN f ON z.regime_id = f.regime_id GROUP BY 1""")


def _increment(s, d):
    a, b = (mod.logo_linear(_z(s, d), "regime_id", f, "w_z").select("regime_id", F.col("r2").alias(n)) for f, n in ((["x_z"], "a"), (["x_z", "y_z"], "b")))
    return a.join(b, "regime_id").withColumn("increment", F.col("b") - F.col("a"))


register("st_exact_perm", lambda s, d: fits.exact_permutation(_runs(s, d), ["test"], "x", "w"), "test n", "rho p")
register("st_hinge", lambda s, d: fits.hinge_scan(_z(s, d), "x_z", "w_z", 40), "", "break_at sse sse_line slope_before slope_after", PANEL + _ZSQL + """, b AS (SELECT lo + (hi - lo) * k / 41 AS t FROM (SELECT min(x_z) AS lo, max(x_z) AS hi FROM z) CROSS JOIN (SELECT unnest(range(1, 41)) AS k)),
  h AS (SELECT t, count(*) AS n, var_pop(x_z) AS sxx, covar_pop(x_z, greatest(x_z - t, 0)) AS sxy, var_pop(greatest(x_z - t, 0)) AS syy, covar_pop(x_z, w_z) AS xw, covar_pop(greatest(x_z - t, 0), w_z) AS yw, var_pop(w_z) AS ww FROM z CROSS JOIN b GROUP BY 1),
  c AS (SELECT *, (syy * xw - sxy * yw) / (sxx * syy - sxy * sxy) AS p, (sxx * yw - sxy * xw) / (sxx * syy - sxy * sxy) AS q FROM h)""",
  "SELECT t AS break_at, n * (ww - p * xw - q * yw) AS sse, n * (ww - xw * xw / sxx) AS sse_line, p AS slope_before, p + q AS slope_after FROM c")
register("st_relax_fit", lambda s, d: fits.relax_fit(_z(s, d), G, "cycle", "w_z"), "regime_id", "tau y_inf amplitude r2")
register("st_coef_boot", lambda s, d: fits.coefficient_bootstrap(nul.row_bootstrap(_z(s, d), G, "cycle", ["x_z", "y_z", "w_z"], 50), G, ["x_z", "y_z"], "w_z"), "feature", "mean low high positive")


def _runs(s, d):
    """One row a run, the means over all its cycles, in one group: few enough for every order."""
    return panel(s, d).groupBy(*G).agg(F.avg("x").alias("x"), F.avg("w").alias("w")).withColumn("test", F.lit("x"))


_U = "CAST(('0x' || substr(md5(concat('0|', rep, '|', regime_id)), 1, 13)) AS BIGINT) / 4503599627370496.0::DOUBLE"
_REPS = ", reps AS (SELECT CAST(unnest(range(1, 21)) AS INTEGER) AS rep)"
register("nul_direction", lambda s, d: _direction(s, d), "rep", "rho", PANEL + _ZSQL + _REPS, f"""
  SELECT rep, avg(abs(r)) AS rho FROM (SELECT rep, regime_id, corr(a, b) AS r FROM (SELECT rep, regime_id, rank() OVER (PARTITION BY rep, regime_id ORDER BY p) AS a, rank() OVER (PARTITION BY rep, regime_id ORDER BY w_z) + (count(*) OVER (PARTITION BY rep, regime_id, w_z) - 1) / 2.0::DOUBLE AS b
  FROM (SELECT rep, regime_id, w_z, cos(2 * 3.141592653589793 * {_U}) * x_z + sin(2 * 3.141592653589793 * {_U}) * y_z AS p FROM z CROSS JOIN reps)) GROUP BY 1, 2) GROUP BY 1""")


def _direction(s, d):
    """Random directions in the plane of two columns, one for each replicate and group: mean absolute correlation."""
    angle = 2 * 3.141592653589793 * nul.draw(0, "rep", "regime_id")
    r = nul.replicates(_z(s, d), 20).withColumn("_p", F.cos(angle) * F.col("x_z") + F.sin(angle) * F.col("y_z"))
    return st.spearman(r, ["rep", "regime_id"], "_p", "w_z").groupBy("rep").agg(F.avg(F.abs("rho")).alias("rho"))


register("inf_sweep", lambda s, d: _sweep(s, d), "lag bins", "mi nmi", PANEL + """, r AS (SELECT *, row_number() OVER (PARTITION BY regime_id ORDER BY cycle) AS i FROM panel),
  l AS (SELECT a.regime_id, a.cycle, CAST(k.k AS INTEGER) AS lag, CAST(b.b AS INTEGER) AS bins, a.w AS y, s.x FROM r a CROSS JOIN (SELECT unnest([0, 1, 2]) AS k) k CROSS JOIN (SELECT unnest([3, 5]) AS b) b JOIN r s ON a.regime_id = s.regime_id AND s.i = a.i - k.k),
  c AS (SELECT lag, bins, floor((row_number() OVER (PARTITION BY lag, bins ORDER BY x, regime_id, cycle) - 1) / (count(*) OVER (PARTITION BY lag, bins))::DOUBLE * bins) AS a, floor((row_number() OVER (PARTITION BY lag, bins ORDER BY y, regime_id, cycle) - 1) / (count(*) OVER (PARTITION BY lag, bins))::DOUBLE * bins) AS b FROM l),
  j AS (SELECT *, sum(n) OVER (PARTITION BY lag, bins) AS t, sum(n) OVER (PARTITION BY lag, bins, a) AS nx, sum(n) OVER (PARTITION BY lag, bins, b) AS ny FROM (SELECT lag, bins, a, b, count(*)::DOUBLE AS n FROM c GROUP BY ALL))""",
  "SELECT lag, bins, sum(n / t * log2(n * t / (nx * ny))) AS mi, sum(n / t * log2(n * t / (nx * ny))) / -sum(n / t * log2(ny / t)) AS nmi FROM j GROUP BY 1, 2")
register("inf_sweep_null", lambda s, d: _sweep_null(s, d), "lag bins n", "mi null_median corrected p low high")


def _sweep(s, d):
    """Mutual information of a lagged predictor and the target over a grid of lags and numbers of bins."""
    out = None
    for bins in (3, 5):
        long = fr.lag_join(panel(s, d), G, "cycle", "x", "w", [0, 1, 2], "position").withColumnsRenamed({"x": "a", "y": "b"})
        coded = win.equal_count(win.equal_count(long, ["lag"], "a", bins, ["regime_id", "cycle"], "ca"), ["lag"], "b", bins, ["regime_id", "cycle"], "cb")
        part = inf.mutual_info(coded, ["lag"], "ca", "cb").withColumn("bins", F.lit(bins))
        out = part if out is None else out.unionByName(part)
    return out


def _sweep_null(s, d, shifts: int = 200, boots: int = 100):
    """The sweep against circular shifts of the predictor: median-corrected, p, and the central 95 % of row bootstraps."""
    p = panel(s, d)
    long = fr.lag_join(p, G, "cycle", "x", "w", [0, 1, 2], "position").withColumnsRenamed({"x": "a", "y": "b"})
    keyed = long.withColumn("_g", F.concat_ws("|", "regime_id", "lag"))
    moved = nul.circular_shift(keyed, ["regime_id", "lag"], "cycle", "a", shifts).join(long.drop("a"), ["regime_id", "lag", "cycle"])
    drawn = nul.row_bootstrap(long.withColumn("cycle", F.col("cycle").cast("int")), ["regime_id", "lag"], "cycle", ["a", "b"], boots).withColumnRenamed("slot", "cycle")
    out = None
    for bins in (3, 5):
        info = lambda df, by: inf.mutual_info(win.equal_count(win.equal_count(df, by, "a", bins, ["regime_id", "cycle"], "ca"), by, "b", bins, ["regime_id", "cycle"], "cb"), by, "ca", "cb")  # noqa: E731, B023
        null = nul.null_summary(info(long, ["lag"]), info(moved, ["rep", "lag"]), ["lag"], "mi", "one")
        band = info(drawn, ["rep", "lag"]).groupBy("lag").agg(F.expr("percentile(mi, 0.025)").alias("low"), F.expr("percentile(mi, 0.975)").alias("high"))
        part = null.join(band, "lag").select("lag", F.lit(bins).alias("bins"), "n", F.col("observed").alias("mi"), "null_median", (F.col("observed") - F.col("null_median")).alias("corrected"), "p", "low", "high")
        out = part if out is None else out.unionByName(part)
    return out


_RANK = ", k AS (SELECT z.*, CAST(w_z >= q AS INTEGER) AS rare FROM z JOIN (SELECT regime_id, quantile_cont(w_z, 0.8) AS q FROM z GROUP BY 1) t ON z.regime_id = t.regime_id)"
register("rsk_auc_null", lambda s, d: _auc_null(s, d), "rep n", "auc", PANEL + ", z AS (SELECT *, w AS w_z FROM panel)" + _RANK + f""", p AS (SELECT *, row_number() OVER (PARTITION BY regime_id ORDER BY cycle) - 1 AS i, count(*) OVER (PARTITION BY regime_id) AS size, (x - avg(x) OVER {_W}) / stddev_pop(x) OVER {_W} AS xz FROM k){_REPS},
  m AS (SELECT a.rep, a.xz, b.rare FROM (SELECT rep, p.* FROM p CROSS JOIN reps) a JOIN (SELECT rep, regime_id, rare, (i + CAST(floor({_U} * size) AS BIGINT)) % size AS j FROM p CROSS JOIN reps) b ON a.rep = b.rep AND a.regime_id = b.regime_id AND a.i = b.j)""", """
  SELECT a.rep, any_value(t.n) AS n, avg(CASE WHEN a.xz > b.xz THEN 1.0 WHEN a.xz = b.xz THEN 0.5 ELSE 0 END) AS auc FROM m a JOIN m b ON a.rep = b.rep AND a.rare = 1 AND b.rare = 0 JOIN (SELECT rep, count(*) AS n FROM m GROUP BY 1) t ON t.rep = a.rep GROUP BY 1""")


def _auc_null(s, d):
    r = _rare(s, d)
    moved = nul.circular_shift(r, G, "cycle", "rare", 20).withColumnRenamed("rare", "label")
    return inf.auc(moved.join(r.select("regime_id", "cycle", "x_z"), ["regime_id", "cycle"]), ["rep"], "x_z", "label")


register("rsk_score_table", lambda s, d: _score_table(s, d), "predictor n", "auc rho", PANEL + _ZSQL + _RANK + ", l AS (SELECT 'x' AS predictor, x_z AS s, rare AS y FROM k UNION ALL SELECT 'y', y_z, rare FROM k)", """
  SELECT a.predictor, n, auc, rho FROM (SELECT a.predictor, avg(CASE WHEN a.s > b.s THEN 1.0 WHEN a.s = b.s THEN 0.5 ELSE 0 END) AS auc FROM l a JOIN l b ON a.predictor = b.predictor AND a.y = 1 AND b.y = 0 GROUP BY 1) a JOIN (SELECT predictor, count(*) AS n, corr(rs, ry) AS rho
  FROM (SELECT predictor, rank() OVER (PARTITION BY predictor ORDER BY s) + (count(*) OVER (PARTITION BY predictor, s) - 1) / 2.0::DOUBLE AS rs, rank() OVER (PARTITION BY predictor ORDER BY y) + (count(*) OVER (PARTITION BY predictor, y) - 1) / 2.0::DOUBLE AS ry FROM l) GROUP BY 1) b ON a.predictor = b.predictor""")


def _score_table(s, d):
    cells = F.array(*(F.struct(F.lit(c).alias("predictor"), F.col(f"{c}_z").alias("score"), F.col("rare").cast("double").alias("label")) for c in ("x", "y")))
    long = _rare(s, d).select(F.inline(cells))
    return inf.auc(long, ["predictor"], "score", "label").join(st.spearman(long, ["predictor"], "score", "label").drop("n"), "predictor")


register("cyc_panel", lambda s, d: _panel(s, d), "run cycle", "force_cold force_hot force_delta next_force_cold jaccard", CONTACTS, """
  WITH p AS (SELECT run, cycle, avg(force) FILTER (phase = 'cold') AS force_cold, avg(force) FILTER (phase = 'hot') AS force_hot FROM contacts GROUP BY 1, 2),
  j AS (SELECT run, cycle, count(*) FILTER (n = 2) / count(*)::DOUBLE AS jaccard FROM (SELECT run, cycle, id1, id2, count(*) AS n FROM contacts GROUP BY 1, 2, 3, 4) GROUP BY 1, 2)
  SELECT p.run, p.cycle, force_cold, force_hot, force_hot - force_cold AS force_delta, lead(force_cold) OVER (PARTITION BY p.run ORDER BY p.cycle) AS next_force_cold, jaccard FROM p LEFT JOIN j ON p.run = j.run AND p.cycle = j.cycle""")


def _panel(s, d):
    c = contacts(s, d)
    wide = fr.next_delta(fr.phase_wide(c, ["run", "cycle"], "phase", ["force"], ["cold", "hot"]), ["run"], "cycle", ["force_cold"])
    return wide.join(fr.phase_turnover(c, ["run", "cycle"]), ["run", "cycle"], "left")


register("cyc_index", lambda s, d: ix.signed_index(ix.signed_index(panel(s, d), G, {"x": 0.7, "y": 0.3}, "a"), G, {"w": 1.0, "y": -0.5}, "b").withColumn("angle", F.degrees(F.atan2("b", "a"))), "regime_id cycle", "a b angle", PANEL + _ZSQL,
  "SELECT regime_id, cycle, 0.7 * x_z + 0.3 * y_z AS a, w_z - 0.5 * y_z AS b, degrees(atan2(w_z - 0.5 * y_z, 0.7 * x_z + 0.3 * y_z)) AS angle FROM z")
register("cyc_irreversibility", lambda s, d: geo.steps(_z(s, d), G, "cycle", "x_z", "w_z").withColumn("local", F.abs("area") / F.greatest(F.col("step"), F.lit(1e-9))), "regime_id cycle", "area local", PANEL + _ZSQL,
  f"SELECT regime_id, cycle, a AS area, abs(a) / greatest(sqrt(dx * dx + dy * dy), 1e-9) AS local FROM (SELECT regime_id, cycle, (x_z * lead(w_z) OVER {_O} - lead(x_z) OVER {_O} * w_z) / 2 AS a, lead(x_z) OVER {_O} - x_z AS dx, lead(w_z) OVER {_O} - w_z AS dy FROM z) WHERE dx IS NOT NULL")
_MAP = f""", c AS (SELECT regime_id, cycle, y, (x - avg(x) OVER {_W}) / stddev_samp(x) OVER {_W} AS u, (w - avg(w) OVER {_W}) / stddev_samp(w) OVER {_W} AS v, (lead(x) OVER {_O} - avg(x) OVER {_W}) / stddev_samp(x) OVER {_W} AS next_u, (lead(w) OVER {_O} - avg(w) OVER {_W}) / stddev_samp(w) OVER {_W} AS next_v FROM panel),
  m AS (SELECT regime_id, (syy * xp - sxy * yp) / det AS a11, (sxx * yp - sxy * xp) / det AS a12, (syy * xq - sxy * yq) / det AS a21, (sxx * yq - sxy * xq) / det AS a22 FROM (SELECT *, sxx * syy - sxy * sxy AS det FROM (SELECT regime_id, var_pop(u) AS sxx, covar_pop(u, v) AS sxy, var_pop(v) AS syy, covar_pop(u, next_u) AS xp, covar_pop(v, next_u) AS yp, covar_pop(u, next_v) AS xq, covar_pop(v, next_v) AS yq FROM c WHERE next_u IS NOT NULL GROUP BY 1)))"""
register("map_residual_memory", lambda s, d: _residual_memory(s, d), "regime_id", "raw residual", PANEL + _MAP, f"""
  SELECT regime_id, corr(p, next_u) AS raw, corr(q, res) AS residual FROM (SELECT *, lag(next_u) OVER {_O} AS p, lag(res) OVER {_O} AS q FROM (SELECT c.*, next_u - a11 * u - a12 * v AS res FROM c JOIN m ON c.regime_id = m.regime_id)) GROUP BY 1""")


def _residual_memory(s, d):
    """Lag-1 correlation of the raw next values and of what the group's own map leaves of them."""
    c = geo.map_coordinates(panel(s, d), G, "cycle", "x", "w").join(geo.map_fit(geo.map_coordinates(panel(s, d), G, "cycle", "x", "w"), G), G)
    c = c.withColumn("res", F.col("next_u") - F.col("a11") * F.col("u") - F.col("a12") * F.col("v"))
    a, b = (st.autocorrelation(c, G, "cycle", x, [1]).select("regime_id", F.col("r").alias(n)) for x, n in (("next_u", "raw"), ("res", "residual")))
    return a.join(b, "regime_id")


register("geo_area_modes", lambda s, d: _area_modes(s, d), "scaling regime_id", "signed_area net", PANEL + f""", q AS (SELECT regime_id, cycle, unnest(['raw', 'z', 'sample', 'minmax', 'centred']) AS scaling,
  unnest([x, (x - avg(x) OVER {_W}) / stddev_pop(x) OVER {_W}, (x - avg(x) OVER {_W}) / stddev_samp(x) OVER {_W}, (x - min(x) OVER {_W}) / (max(x) OVER {_W} - min(x) OVER {_W}), x - avg(x) OVER {_W}]) AS a,
  unnest([w, (w - avg(w) OVER {_W}) / stddev_pop(w) OVER {_W}, (w - avg(w) OVER {_W}) / stddev_samp(w) OVER {_W}, (w - min(w) OVER {_W}) / (max(w) OVER {_W} - min(w) OVER {_W}), w - avg(w) OVER {_W}]) AS b FROM panel)""", """
  SELECT scaling, regime_id, sum((a * nb - na * b) / 2) AS signed_area, sqrt(sum(na - a) ** 2 + sum(nb - b) ** 2) AS net FROM (SELECT *, lead(a) OVER k AS na, lead(b) OVER k AS nb FROM q WINDOW k AS (PARTITION BY scaling, regime_id ORDER BY cycle)) WHERE na IS NOT NULL GROUP BY 1, 2""")


def _area_modes(s, d):
    """Signed area and net displacement under several coordinate scalings."""
    p = panel(s, d)
    ways = {"raw": (p, "x", "w"), "z": (_z(s, d), "x_z", "w_z"), "sample": (win.zscore(p, G, ["x", "w"], 1), "x_z", "w_z"), "minmax": (win.minmax(p, G, ["x", "w"]), "x_mm", "w_mm"), "centred": (win.center(p, G, ["x", "w"]), "x_wc", "w_wc")}
    out = None
    for name, (df, x, y) in ways.items():
        part = geo.path(df, G, "cycle", x, y).select(F.lit(name).alias("scaling"), "regime_id", "signed_area", "net")
        out = part if out is None else out.unionByName(part)
    return out


def _observability(s, d):
    c = geo.map_coordinates(panel(s, d), G, "cycle", "x", "w")
    return geo.observability(geo.map_fit(c, G), geo.readout(c, G, "u", "v", "y"), G)


def _gradient_angle(s, d):
    """Bootstrap of the angle between the readouts of two columns: median and central 95 %."""
    boot = nul.row_bootstrap(_z(s, d).withColumn("n", F.col("n").cast("double")), G, "cycle", ["x_z", "y_z", "w_z", "n"], 50)
    q = lambda v: F.expr(f"percentile(angle, {v})")
    return geo.gradient_angle(boot, ["rep"], "x_z", "y_z", "w_z", "n").agg(q(0.5).alias("median"), q(0.025).alias("low"), q(0.975).alias("high"))


register("map_observability", _observability, "regime_id", "gain angle c1 c2", PANEL + _MAP + """, r AS (SELECT regime_id, (syy * xt - sxy * yt) / (sxx * syy - sxy * sxy) AS c1, (sxx * yt - sxy * xt) / (sxx * syy - sxy * sxy) AS c2
  FROM (SELECT regime_id, var_pop(u) AS sxx, covar_pop(u, v) AS sxy, var_pop(v) AS syy, covar_pop(u, y) AS xt, covar_pop(v, y) AS yt FROM c GROUP BY 1)), o AS (SELECT r.*, a11 * c1 + a21 * c2 AS d1, a12 * c1 + a22 * c2 AS d2 FROM r JOIN m ON r.regime_id = m.regime_id)""",
  "SELECT regime_id, sqrt(d1 * d1 + d2 * d2) / sqrt(c1 * c1 + c2 * c2) AS gain, degrees(acos(greatest(-1, least(1, (c1 * d1 + c2 * d2) / (sqrt(c1 * c1 + c2 * c2) * sqrt(d1 * d1 + d2 * d2)))))) AS angle, c1, c2 FROM o")
register("geo_gradient_angle", _gradient_angle, "", "median low high")
register("map_readout", lambda s, d: geo.readout(panel(s, d).withColumns({"x": F.col("x") / 1e6, "y": F.col("y") / 1e5}), G, "x", "y", "w"), "regime_id", "c1 c2", PANEL, """
  SELECT regime_id, (syy * xt - sxy * yt) / (sxx * syy - sxy * sxy) AS c1, (sxx * yt - sxy * xt) / (sxx * syy - sxy * sxy) AS c2
  FROM (SELECT regime_id, var_pop(x / 1e6) AS sxx, covar_pop(x / 1e6, y / 1e5) AS sxy, var_pop(y / 1e5) AS syy, covar_pop(x / 1e6, w) AS xt, covar_pop(y / 1e5, w) AS yt FROM panel GROUP BY 1)""")
