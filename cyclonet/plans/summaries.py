"""Queries of aggregations and windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as agg
from ..operators import frames as fr
from ..operators import indices as ix
from ..operators import windows as win
from .registry import register
from .views import CONTACTS, NODES, PANEL, contacts, nodes, panel

STATE = ["run", "cycle", "phase"]
G = ["regime_id"]

register("agg_group_summary", lambda s, d: agg.group_summary(panel(s, d).withColumn("late", F.col("cycle") > 15), G, ["x", "w"], ["late"]), "regime_id n", "x_mean x_sd x_min x_max w_mean w_sd late_share", PANEL,
  "SELECT regime_id, count(*) AS n, avg(x) AS x_mean, stddev_samp(x) AS x_sd, min(x) AS x_min, max(x) AS x_max, avg(w) AS w_mean, stddev_samp(w) AS w_sd, avg(CAST(cycle > 15 AS INT)) AS late_share FROM panel GROUP BY 1")
register("agg_mode", lambda s, d: agg.mode(contacts(s, d), ["run", "cycle"], "id1"), "run cycle id1 n", "", CONTACTS,
  "SELECT run, cycle, id1, n FROM (SELECT run, cycle, id1, count(*) AS n FROM contacts GROUP BY 1, 2, 3) QUALIFY row_number() OVER (PARTITION BY run, cycle ORDER BY n DESC, id1) = 1")
register("agg_gini", lambda s, d: agg.gini(contacts(s, d), STATE, "force"), "run cycle phase", "gini", CONTACTS,
  "SELECT run, cycle, phase, 2 * sum(i * force) / (count(*) * sum(force)) - (count(*) + 1) / count(*)::DOUBLE AS gini FROM (SELECT *, row_number() OVER (PARTITION BY run, cycle, phase ORDER BY force) AS i FROM contacts) GROUP BY 1, 2, 3")
register("agg_top_share", lambda s, d: agg.top_share(contacts(s, d), STATE, "force", 0.05), "run cycle phase", "share", CONTACTS,
  "SELECT run, cycle, phase, sum(force) FILTER (i <= greatest(1, ceil(n * 0.05::DOUBLE))) / sum(force) AS share FROM (SELECT *, row_number() OVER (PARTITION BY run, cycle, phase ORDER BY force DESC) AS i, count(*) OVER (PARTITION BY run, cycle, phase) AS n FROM contacts) GROUP BY 1, 2, 3")
register("agg_tail_approx", lambda s, d: agg.tail(contacts(s, d), STATE, "force", (0.9, 0.99, 0.999), 1e-5), "run cycle phase approximate", "mean p90 p99 p99_9 max p99_over_mean")
register("agg_tail", lambda s, d: agg.tail(contacts(s, d), STATE, "force"), "run cycle phase", "mean p90 p95 p99 max p99_over_mean", CONTACTS,
  "SELECT run, cycle, phase, avg(force) AS mean, quantile_cont(force, 0.9) AS p90, quantile_cont(force, 0.95) AS p95, quantile_cont(force, 0.99) AS p99, max(force) AS max, quantile_cont(force, 0.99) / avg(force) AS p99_over_mean FROM contacts GROUP BY 1, 2, 3")
_NV = """SELECT c.run, c.cycle, c.phase, c.force, dx / l AS nx, dy / l AS ny, dz / l AS nz, degrees(acos(least(abs(dz / l), 1.0))) AS theta FROM (SELECT *, sqrt(dx * dx + dy * dy + dz * dz) AS l FROM (SELECT c.*, b.x - a.x AS dx, b.y - a.y AS dy, b.z - a.z AS dz
  FROM contacts c JOIN nodes a ON a.run = c.run AND a.cycle = c.cycle AND a.phase = c.phase AND a.id = c.id1 JOIN nodes b ON b.run = c.run AND b.cycle = c.cycle AND b.phase = c.phase AND b.id = c.id2)) c WHERE l > 0"""
register("agg_fabric_tensor", lambda s, d: agg.fabric(fr.branch_geometry(contacts(s, d), nodes(s, d), STATE), STATE, "force"), "run cycle phase", "f_xx f_xy f_xz f_yy f_yz f_zz abs_nz vertical_bias", NODES,
  f"SELECT run, cycle, phase, sum(force * nx * nx) / sum(force) AS f_xx, sum(force * nx * ny) / sum(force) AS f_xy, sum(force * nx * nz) / sum(force) AS f_xz, sum(force * ny * ny) / sum(force) AS f_yy, sum(force * ny * nz) / sum(force) AS f_yz, sum(force * nz * nz) / sum(force) AS f_zz, sum(force * abs(nz)) / sum(force) AS abs_nz, sum(force * nz * nz) / sum(force) - 1.0::DOUBLE / 3 AS vertical_bias FROM ({_NV}) GROUP BY 1, 2, 3")
register("agg_orient_hist", lambda s, d: agg.orientation_histogram(fr.branch_geometry(contacts(s, d), nodes(s, d), STATE), STATE), "run cycle phase", "bin_left count_fraction force_fraction", NODES,
  f"SELECT run, cycle, phase, b AS bin_left, n / sum(n) OVER w AS count_fraction, f / sum(f) OVER w AS force_fraction FROM (SELECT run, cycle, phase, floor(theta / 10) * 10 AS b, count(*) AS n, sum(force) AS f FROM ({_NV}) WHERE theta >= 0 AND theta < 90 GROUP BY 1, 2, 3, 4) WINDOW w AS (PARTITION BY run, cycle, phase)")
register("agg_entropy", lambda s, d: agg.entropy(contacts(s, d), STATE, "id2", "force", 50), "run cycle phase", "entropy", CONTACTS,
  "SELECT run, cycle, phase, -sum(p * ln(p)) / ln(50) AS entropy FROM (SELECT run, cycle, phase, sum(force) / sum(sum(force)) OVER (PARTITION BY run, cycle, phase) AS p FROM contacts GROUP BY run, cycle, phase, id2) GROUP BY 1, 2, 3")
register("agg_weighted_mean", lambda s, d: agg.weighted_mean(panel(s, d), G, "w", "n"), "regime_id", "weighted_mean", PANEL, "SELECT regime_id, sum(w * n) / sum(n) AS weighted_mean FROM panel GROUP BY 1")
register("agg_cv", lambda s, d: agg.cv(panel(s, d), G, "x"), "regime_id", "cv", PANEL, "SELECT regime_id, stddev_samp(x) / avg(x) AS cv FROM panel GROUP BY 1")
register("agg_median_ref", lambda s, d: agg.median_reference(panel(s, d), G, "x", "y"), "regime_id cycle", "x_rel", PANEL, "SELECT regime_id, cycle, x / quantile_cont(y, 0.5) OVER (PARTITION BY regime_id) AS x_rel FROM panel")
register("agg_first_last_ratio", lambda s, d: agg.first_last_ratio(panel(s, d), G, "cycle", "x"), "regime_id", "first last ratio", PANEL, "SELECT regime_id, arg_min(x, cycle) AS first, arg_max(x, cycle) AS last, arg_max(x, cycle) / arg_min(x, cycle) AS ratio FROM panel GROUP BY 1")
register("agg_peak", lambda s, d: agg.peak(panel(s, d), G, "cycle", "w"), "regime_id peak_at", "peak", PANEL, "SELECT regime_id, cycle AS peak_at, w AS peak FROM panel QUALIFY row_number() OVER (PARTITION BY regime_id ORDER BY w DESC, cycle) = 1")
register("agg_early_late", lambda s, d: agg.early_late(panel(s, d), G, "cycle", ["x"]), "regime_id", "x_early x_late x_change", PANEL, "SELECT regime_id, avg(x) FILTER (cycle <= 5) AS x_early, avg(x) FILTER (cycle >= 26) AS x_late, avg(x) FILTER (cycle >= 26) - avg(x) FILTER (cycle <= 5) AS x_change FROM panel GROUP BY 1")
register("agg_completeness", lambda s, d: agg.completeness(contacts(s, d).filter("NOT (run = 'R2' AND cycle = 4 AND phase = 'hot')"), ["run"], "cycle", "phase", 24), "run states pairs complete", "", CONTACTS,
  "SELECT run, CAST(sum(p) AS BIGINT) AS states, count(*) FILTER (p >= 2) AS pairs, sum(p) >= 24 AS complete FROM (SELECT run, cycle, count(DISTINCT phase) AS p FROM contacts WHERE NOT (run = 'R2' AND cycle = 4 AND phase = 'hot') GROUP BY 1, 2) GROUP BY 1")
register("agg_fold_change", lambda s, d: agg.fold_change(panel(s, d), G, "cycle", "x", 1, 30), "regime_id", "percent", PANEL, "SELECT regime_id, 100 * (max(x) FILTER (cycle = 30) - max(x) FILTER (cycle = 1)) / max(x) FILTER (cycle = 1) AS percent FROM panel GROUP BY 1")

_W = "(PARTITION BY regime_id)"
_O = "(PARTITION BY regime_id ORDER BY cycle)"
register("win_center", lambda s, d: win.center(panel(s, d), G, ["x", "w"]), "regime_id cycle", "x_wc w_wc", PANEL, f"SELECT regime_id, cycle, x - avg(x) OVER {_W} AS x_wc, w - avg(w) OVER {_W} AS w_wc FROM panel")
register("win_z", lambda s, d: win.zscore(win.zscore(panel(s, d).withColumn("k", F.lit(2.0)), G, ["x", "k"]), G, ["x"], 1, "_s"), "regime_id cycle", "x_z k_z x_s", PANEL,
  f"SELECT regime_id, cycle, (x - avg(x) OVER {_W}) / stddev_pop(x) OVER {_W} AS x_z, 0.0 AS k_z, (x - avg(x) OVER {_W}) / stddev_samp(x) OVER {_W} AS x_s FROM panel")
register("win_pooled_z", lambda s, d: win.pooled_z(panel(s, d), G, ["x", "w"]), "regime_id cycle", "x_pz w_pz", PANEL,
  "SELECT p.regime_id, cycle, (x - m) / s AS x_pz, (w - m) / s AS w_pz FROM panel p JOIN (SELECT regime_id, avg(v) AS m, stddev_pop(v) AS s FROM (SELECT regime_id, unnest([x, w]) AS v FROM panel) GROUP BY 1) q ON p.regime_id = q.regime_id")
register("win_robust_z", lambda s, d: win.robust_z(win.robust_z(panel(s, d), G, "x"), G, "w", "mad"), "regime_id cycle", "x_rz w_rz", PANEL, """
  SELECT p.regime_id, cycle, (x - xm) / (xh - xl) AS x_rz, (w - wm) / (1.4826 * mad) AS w_rz FROM panel p JOIN (SELECT a.regime_id, xm, xh, xl, any_value(wm) AS wm, quantile_cont(abs(w - wm), 0.5) AS mad
  FROM panel a JOIN (SELECT regime_id, quantile_cont(x, 0.5) AS xm, quantile_cont(x, 0.75) AS xh, quantile_cont(x, 0.25) AS xl, quantile_cont(w, 0.5) AS wm FROM panel GROUP BY 1) m ON a.regime_id = m.regime_id GROUP BY 1, 2, 3, 4) q ON p.regime_id = q.regime_id""")  # fmt: skip
register("win_minmax", lambda s, d: win.minmax(win.minmax(panel(s, d), G, ["x"]), G, ["w"], True), "regime_id cycle", "x_mm w_mm", PANEL,
  f"SELECT regime_id, cycle, (x - min(x) OVER {_W}) / (max(x) OVER {_W} - min(x) OVER {_W}) AS x_mm, 1 - (w - min(w) OVER {_W}) / (max(w) OVER {_W} - min(w) OVER {_W}) AS w_mm FROM panel")
_RANK = "rank() OVER (PARTITION BY regime_id ORDER BY n) + (count(*) OVER (PARTITION BY regime_id, n) - 1) / 2.0::DOUBLE"
register("win_rank_avg", lambda s, d: win.rank_avg(panel(s, d), G, "n"), "regime_id cycle", "rank", PANEL, f"SELECT regime_id, cycle, {_RANK} AS rank FROM panel")
register("win_rank_pct", lambda s, d: win.rank_pct(win.rank_pct(panel(s, d), G, "n"), G, "n", True, "centred"), "regime_id cycle", "pct centred", PANEL, f"SELECT regime_id, cycle, ({_RANK}) / count(*) OVER {_W} AS pct, (({_RANK}) - 0.5) / count(*) OVER {_W} - 0.5 AS centred FROM panel")
register("win_equal_count", lambda s, d: win.equal_count(panel(s, d), G, "x", 7, ["cycle"]), "regime_id cycle code", "", PANEL, f"SELECT regime_id, cycle, CAST(floor((row_number() OVER (PARTITION BY regime_id ORDER BY x, cycle) - 1) / (count(*) OVER {_W})::DOUBLE * 7) AS INTEGER) AS code FROM panel")
register("win_qcut", lambda s, d: win.qcut(panel(s, d), G, "x", 4), "regime_id cycle bin", "", PANEL,
  "SELECT p.regime_id, cycle, CAST((x > a) AS INTEGER) + CAST((x > b) AS INTEGER) + CAST((x > c) AS INTEGER) AS bin FROM panel p JOIN (SELECT regime_id, quantile_cont(x, 0.25) AS a, quantile_cont(x, 0.5) AS b, quantile_cont(x, 0.75) AS c FROM panel GROUP BY 1) q ON p.regime_id = q.regime_id")
register("win_lags", lambda s, d: win.lag_design(panel(s, d), G, "cycle", ["x"], [1, 2]), "regime_id cycle", "x x_lag1 x_lag2", PANEL, f"SELECT * FROM (SELECT regime_id, cycle, x, lag(x) OVER {_O} AS x_lag1, lag(x, 2) OVER {_O} AS x_lag2 FROM panel) WHERE x_lag2 IS NOT NULL")
register("win_rolling", lambda s, d: win.rolling(panel(s, d), G, "cycle", "x"), "regime_id cycle", "x_roll_mean x_roll_sd", PANEL,
  "SELECT regime_id, cycle, CASE WHEN count(x) OVER w >= 2 THEN avg(x) OVER w END AS x_roll_mean, CASE WHEN count(x) OVER w >= 2 THEN stddev_samp(x) OVER w END AS x_roll_sd FROM panel WINDOW w AS (PARTITION BY regime_id ORDER BY cycle ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)")
register("win_diff", lambda s, d: win.differences(panel(s, d), G, "cycle", "x"), "regime_id cycle", "x_absdiff x_relnext", PANEL, f"SELECT regime_id, cycle, abs(x - lag(x) OVER {_O}) AS x_absdiff, (lead(x) OVER {_O} - x) / x AS x_relnext FROM panel")
register("win_cumsum", lambda s, d: win.cumulative(panel(s, d), G, "cycle", "w"), "regime_id cycle", "w_cum w_cum_share", PANEL, f"SELECT regime_id, cycle, sum(w) OVER {_O} AS w_cum, sum(w) OVER {_O} / sum(w) OVER {_W} AS w_cum_share FROM panel")
register("geo_writing_time", lambda s, d: win.writing_time(win.center(panel(s, d), [], ["w"]), G, "cycle", "w_wc"), "regime_id half_at stable_at", "", PANEL, """
  WITH c AS (SELECT regime_id, cycle, w - avg(w) OVER () AS v FROM panel), r AS (SELECT regime_id, cycle, sum(v) OVER (PARTITION BY regime_id ORDER BY cycle) AS s, sum(v) OVER (PARTITION BY regime_id) AS t FROM c),
  h AS (SELECT regime_id, min(cycle) FILTER (abs(s) >= 0.5 * abs(t)) AS half_at, max(cycle) FILTER (sign(s) <> sign(t)) AS bad FROM r GROUP BY 1)
  SELECT h.regime_id, half_at, (SELECT min(cycle) FROM r WHERE r.regime_id = h.regime_id AND (bad IS NULL OR cycle > bad)) AS stable_at FROM h""")  # fmt: skip
register("win_fill", lambda s, d: win.fill(panel(s, d).withColumn("g", F.when(F.col("cycle") % 4 == 2, F.col("x"))), G, "cycle", "g"), "regime_id cycle", "g_filled", PANEL,
  "SELECT p.regime_id, p.cycle, coalesce((SELECT arg_max(x, q.cycle) FROM panel q WHERE q.regime_id = p.regime_id AND q.cycle <= p.cycle AND q.cycle % 4 = 2), (SELECT arg_min(x, q.cycle) FROM panel q WHERE q.regime_id = p.regime_id AND q.cycle >= p.cycle AND q.cycle % 4 = 2)) AS g_filled FROM panel p")
register("win_group_quantile_flag", lambda s, d: win.rare_flag(panel(s, d), G, "w", 0.8), "regime_id cycle rare", "", PANEL, "SELECT p.regime_id, cycle, CAST(w >= q AS INTEGER) AS rare FROM panel p JOIN (SELECT regime_id, quantile_cont(w, 0.8) AS q FROM panel GROUP BY 1) t ON p.regime_id = t.regime_id")
register("win_first_per_group", lambda s, d: win.first_per_group(panel(s, d), G, [F.col("n").desc(), F.col("cycle")]), "regime_id cycle n", "", PANEL, "SELECT regime_id, cycle, n FROM panel QUALIFY row_number() OVER (PARTITION BY regime_id ORDER BY n DESC, cycle) = 1")
register("win_trapz", lambda s, d: win.curve_area(panel(s, d), G, "cycle", "w"), "regime_id", "area", PANEL, f"SELECT regime_id, sum(a) AS area FROM (SELECT regime_id, (cycle - lag(cycle) OVER {_O}) * (w + lag(w) OVER {_O}) / 2 AS a FROM panel) GROUP BY 1")
register("win_local_slope", lambda s, d: win.local_slope(panel(s, d), G, "cycle", "w"), "regime_id cycle", "slope", PANEL,
  f"SELECT regime_id, cycle, (coalesce(lead(w) OVER {_O}, w) - coalesce(lag(w) OVER {_O}, w)) / (coalesce(lead(cycle) OVER {_O}, cycle) - coalesce(lag(cycle) OVER {_O}, cycle)) AS slope FROM panel")
register("srt_topk_score", lambda s, d: win.topk_score(panel(s, d), {"x": 1.0, "w": 2.0}, 10, ["regime_id", "cycle"]), "regime_id cycle rank", "score", PANEL,
  "SELECT regime_id, cycle, CAST(row_number() OVER (ORDER BY x + 2 * w DESC, regime_id, cycle) AS INTEGER) AS rank, x + 2 * w AS score FROM panel QUALIFY row_number() OVER (ORDER BY x + 2 * w DESC, regime_id, cycle) <= 10")
register("srt_novelty", lambda s, d: _novelty(panel(s, d)), "key", "min_distance mean_distance", PANEL, """
  WITH z AS (SELECT concat(regime_id, '_', cycle) AS key, cycle, (x - avg(x) OVER ()) / stddev_pop(x) OVER () AS a, (w - avg(w) OVER ()) / stddev_pop(w) OVER () AS b FROM panel)
  SELECT p.key, min(sqrt((p.a - q.a) ** 2 + (p.b - q.b) ** 2)) AS min_distance, avg(sqrt((p.a - q.a) ** 2 + (p.b - q.b) ** 2)) AS mean_distance FROM z p JOIN z q ON q.cycle = 1 AND p.key <> q.key GROUP BY 1""")  # fmt: skip


def _novelty(p):
    z = win.zscore(p.withColumn("key", F.concat_ws("_", "regime_id", "cycle")), [], ["x", "w"])
    return win.novelty(z, z.filter("cycle = 1"), "key", ["x_z", "w_z"])


register("srt_pareto", lambda s, d: win.pareto(panel(s, d), G, "n", "w"), "regime_id cycle front", "deficit", PANEL, """
  SELECT p.regime_id, p.cycle, NOT EXISTS (SELECT 1 FROM panel q WHERE q.regime_id = p.regime_id AND ((q.n <= p.n AND q.w > p.w) OR (q.n < p.n AND q.w >= p.w))) AS front,
  (SELECT max(q.w) FROM panel q WHERE q.regime_id = p.regime_id AND q.n <= p.n) - p.w AS deficit FROM panel p""")  # fmt: skip

register("cyc_response", lambda s, d: ix.response(fr.next_delta(panel(s, d), G, "cycle", ["x"]), "x", "y", "next_x", "w"), "regime_id cycle", "amplitude recovery loop_cost efficiency hazard quality overload", PANEL, f"""
  SELECT regime_id, cycle, y - x AS amplitude, y - nx AS recovery, greatest(w, 0) AS loop_cost, (y - nx) / (y - x) AS efficiency, w / (abs(y - nx) + 1e-9) AS hazard, 1 / (1 + w / (abs(y - nx) + 1e-9)) AS quality, asinh(w / (abs(y - nx) + 1e-9) / 2) AS overload
  FROM (SELECT *, lead(x) OVER {_O} AS nx FROM panel)""")  # fmt: skip
register("cyc_hazard", lambda s, d: ix.hazard(panel(s, d), "w", "y"), "regime_id cycle", "hazard log_hazard", PANEL, "SELECT regime_id, cycle, w / (y + e) AS hazard, ln(1 + w / (y + e)) AS log_hazard FROM panel CROSS JOIN (SELECT quantile_cont(y, 0.1) AS e FROM panel WHERE y > 0)")
register("cyc_vital", lambda s, d: ix.signed_index(panel(s, d), G, {"x": 1.0, "y": -1.0, "w": 0.5}), "regime_id cycle", "index", PANEL,
  f"SELECT regime_id, cycle, (x - avg(x) OVER {_W}) / stddev_pop(x) OVER {_W} - (y - avg(y) OVER {_W}) / stddev_pop(y) OVER {_W} + 0.5 * (w - avg(w) OVER {_W}) / stddev_pop(w) OVER {_W} AS index FROM panel")
register("cyc_training", lambda s, d: ix.relative_to_first(ix.activity_memory(panel(s, d), G, ["x"], ["w"]), G, "cycle", "y"), "regime_id cycle", "activity y_rel", PANEL,
  f"SELECT regime_id, cycle, ((x - min(x) OVER {_W}) / (max(x) OVER {_W} - min(x) OVER {_W}) + 1 - (w - min(w) OVER {_W}) / (max(w) OVER {_W} - min(w) OVER {_W})) / 2 AS activity, y / first_value(y) OVER {_O} AS y_rel FROM panel")
register("cyc_triplet", lambda s, d: ix.triplet(panel(s, d), G, ["x", "y", "w"]), "regime_id cycle", "z_norm z_positive", PANEL,
  f"SELECT regime_id, cycle, sqrt(a * a + b * b + c * c) AS z_norm, greatest(a, 0) + greatest(b, 0) + greatest(c, 0) AS z_positive FROM (SELECT regime_id, cycle, (x - avg(x) OVER {_W}) / stddev_pop(x) OVER {_W} AS a, (y - avg(y) OVER {_W}) / stddev_pop(y) OVER {_W} AS b, (w - avg(w) OVER {_W}) / stddev_pop(w) OVER {_W} AS c FROM panel)")
register("cyc_modes", lambda s, d: ix.cycle_modes(panel(s, d), G, "cycle", "x", "y"), "regime_id cycle", "inhale exhale closure reservoir", PANEL,
  f"SELECT regime_id, cycle, abs(y - x) AS inhale, abs(nx - y) AS exhale, abs(nx - y) / abs(y - x) AS closure, sum(nx - x) OVER {_O} AS reservoir FROM (SELECT *, lead(x) OVER {_O} AS nx FROM panel)")
register("prof_benchmark", lambda s, d: ix.benchmark_error(panel(s, d), G, "x", "w"), "regime_id", "rmse mae mape", PANEL, "SELECT regime_id, sqrt(avg((x - w) * (x - w))) AS rmse, avg(abs(x - w)) AS mae, avg(abs((x - w) / w)) AS mape FROM panel GROUP BY 1")
register("prof_wall_bins", lambda s, d: ix.wall_bins(fr.with_ends(contacts(s, d), nodes(s, d), STATE, ["z"]), STATE, "z1", "force", 1.0, 8), "run cycle phase bin contacts", "force max_force z_mid pressure", NODES, """
  SELECT c.run, c.cycle, c.phase, CAST(floor(a.z / 0.125) AS INTEGER) AS bin, count(*) AS contacts, sum(force) AS force, max(force) AS max_force, (floor(a.z / 0.125) + 0.5) * 0.125 AS z_mid, sum(force) / 0.125 AS pressure
  FROM contacts c JOIN nodes a ON a.run = c.run AND a.cycle = c.cycle AND a.phase = c.phase AND a.id = c.id1 JOIN nodes b ON b.run = c.run AND b.cycle = c.cycle AND b.phase = c.phase AND b.id = c.id2 WHERE a.z < 1 GROUP BY c.run, c.cycle, c.phase, floor(a.z / 0.125)""")  # fmt: skip
