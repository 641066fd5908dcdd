"""Queries of filters, joins, reshaping and sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import functions as C
from .. import sources
from ..operators import frames as ops
from .registry import register
from .views import CONTACTS, NODES, PANEL, PARTICLES, contacts, nodes, panel, particles, read

STATE = ["run", "cycle", "phase"]

register(
    "src_contacts", lambda s, d: sources.parse_contacts(_contact_lines(s, d), ["path"]).groupBy("path").agg(F.count("*").alias("n"), F.sum("id1").alias("ids"), F.max("force").alias("top")), "path n ids", "top", CONTACTS,
    "SELECT concat(run, '/contacts_cycle_', cycle, '_', phase, '.local') AS path, count(*) AS n, CAST(sum(id1) AS BIGINT) AS ids, max(abs(force)) AS top FROM contacts GROUP BY 1",
)


def _placed(rows, file, heads, last=()):
    """path-like columns, place, line: head lines of each file, then its rows (column line), then last lines."""
    fixed = [F.struct(F.lit(0).alias("block"), F.lit(k).cast("long").alias("row"), F.lit(v).alias("line")) for k, v in enumerate(heads)]
    fixed += [F.struct(F.lit(9).alias("block"), F.lit(k).cast("long").alias("row"), F.lit(v).alias("line")) for k, v in enumerate(last)]
    ends = rows.select(*file).distinct().select(*file, F.inline(F.array(*fixed)))
    return rows.select(*file, "block", "row", "line").unionByName(ends).select(*file, F.struct("block", "row").alias("place"), "line")


def _contact_lines(s, d):
    """Contact tables as lines of text files, one file a state, to be parsed back."""
    line = F.concat_ws(" ", F.col("id1"), F.col("id2"), F.lit(0), F.col("force").cast("decimal(18,2)"), *[F.lit(0)] * 12)
    path = F.concat("run", F.lit("/contacts_cycle_"), "cycle", F.lit("_"), "phase", F.lit(".local"))
    rows = contacts(s, d).select(path.alias("path"), F.lit(1).alias("block"), F.xxhash64("id1", "id2").alias("row"), line.alias("line"))
    return _placed(rows, ["path"], ["ITEM: TIMESTEP", "1", "ITEM: ENTRIES " + " ".join(f"c_cp[{i}]" for i in range(1, 17))], ["ragged line", ""])


def _particle_lines(s, d):
    """Two frames a file; the first has other values and must not be read."""
    p, item = particles(s, d), ["ITEM: TIMESTEP", "1", "ITEM: ATOMS id x y z radius"]
    file, order = ["run", "cycle"], F.col("id").cast("long").alias("row")
    old = p.select(*file, F.lit(1).alias("block"), order, F.concat_ws(" ", "id", F.lit("0 0 0 0")).alias("line"))
    new = p.select(*file, F.lit(3).alias("block"), order, F.concat_ws(" ", "id", "x", "y", "z", "radius").alias("line"))
    second = p.select(*file).distinct().select(*file, F.inline(F.array(*(F.struct(F.lit(2).alias("block"), F.lit(k).cast("long").alias("row"), F.lit(v).alias("line")) for k, v in enumerate(item)))))
    return _placed(old.unionByName(second).unionByName(new), file, item)


register(
    "src_dump", lambda s, d: sources.parse_particles(_particle_lines(s, d), ["run", "cycle"]).groupBy("run", "cycle").agg(F.count("*").alias("n"), F.max("x").alias("x"), F.min("z").alias("z"), F.avg("radius").alias("radius")), "run cycle n", "x z radius", PARTICLES,
    "SELECT run, cycle, count(*) AS n, max(x) AS x, min(z) AS z, avg(radius) AS radius FROM particles GROUP BY 1, 2",
)


def _listing(s, d):
    c = contacts(s, d).select(*STATE).distinct()
    name = lambda a, b: F.concat(F.lit("data/"), "run", F.lit(a), "cycle", F.lit("_"), "phase", F.lit(b))
    both = c.select(name("/contacts_cycle_", ".local").alias("path"), F.lit(10).cast("long").alias("length"))
    return both.unionByName(c.filter("cycle <> 3").select(name("/cycle_", ".dump").alias("path"), F.when(F.col("cycle") == 5, 0).otherwise(9).cast("long").alias("length")))


register("src_discover", lambda s, d: sources.discover_states(_listing(s, d)), "run cycle phase", "", CONTACTS, "SELECT DISTINCT run, cycle, phase FROM contacts WHERE cycle NOT IN (3, 5)")
register(
    "src_multi_run_union", lambda s, d: ops.union_runs({r: panel(s, d).filter(F.col("regime_id") == r).drop("regime_id") for r in ("R1", "R2", "R3", "R4", "R5")}).groupBy("run").agg(F.sum("n").alias("n")), "run n", "", PANEL,
    "SELECT regime_id AS run, CAST(sum(n) AS BIGINT) AS n FROM panel GROUP BY 1",
)
register(
    "flt_valid_contacts", lambda s, d: ops.valid_contacts(contacts(s, d), nodes(s, d).filter("id % 7 <> 0"), STATE), "run cycle phase id1 id2", "force", CONTACTS,
    "SELECT * FROM contacts WHERE force > 0 AND id1 % 7 <> 0 AND id2 % 7 <> 0",
)
register(
    "flt_finite", lambda s, d: ops.finite(panel(s, d).withColumn("y", F.when(F.col("cycle") % 5 == 0, float("nan")).when(F.col("cycle") % 7 == 0, float("inf")).otherwise(F.col("y"))), ["x", "y"]), "regime_id cycle n", "x y", PANEL,
    "SELECT * FROM panel WHERE cycle % 5 <> 0 AND cycle % 7 <> 0",
)
# Every end of a contact is a node, whose place is a formula of its id; so the SQL needs no join.
_BRANCH = """SELECT c.*, sqrt(dx * dx + dy * dy + dz * dz) AS length, abs(dz / sqrt(dx * dx + dy * dy + dz * dz)) AS abs_nz, degrees(acos(least(abs(dz / sqrt(dx * dx + dy * dy + dz * dz)), 1.0))) AS theta
  FROM (SELECT *, (id2 * 37) % 101 / 101.0::DOUBLE - (id1 * 37) % 101 / 101.0::DOUBLE AS dx, (id2 * 53) % 103 / 103.0::DOUBLE - (id1 * 53) % 103 / 103.0::DOUBLE AS dy,
  (id2 * 71) % 107 / 107.0::DOUBLE - (id1 * 71) % 107 / 107.0::DOUBLE AS dz FROM contacts) c WHERE dx * dx + dy * dy + dz * dz > 0"""
register("prj_branch_vector", lambda s, d: ops.branch_geometry(contacts(s, d), nodes(s, d), STATE), "run cycle phase id1 id2", "length abs_nz theta", CONTACTS, _BRANCH)
register("prj_edge_position", lambda s, d: ops.edge_position(contacts(s, d), nodes(s, d), STATE).groupBy(*STATE).agg(F.count("*").alias("n"), F.sum(F.col("bottom_edge").cast("long")).alias("bottom"), F.sum(F.col("boundary_edge").cast("long")).alias("boundary"), F.avg("z_mid").alias("z_mid")), "run cycle phase n bottom boundary", "z_mid", NODES, """
  WITH m AS (SELECT *, avg(x) OVER s AS mx, avg(y) OVER s AS my FROM nodes WINDOW s AS (PARTITION BY run, cycle, phase)), r AS (SELECT *, sqrt((x - mx) * (x - mx) + (y - my) * (y - my)) AS r FROM m),
  k AS (SELECT run, cycle, phase, id, (z - min(z) OVER s) / (max(z) OVER s - min(z) OVER s) AS zn, (r - min(r) OVER s) / (max(r) OVER s - min(r) OVER s) AS rn FROM r WINDOW s AS (PARTITION BY run, cycle, phase))
  SELECT c.run, c.cycle, c.phase, count(*) AS n, CAST(sum(CAST(a.zn <= 0.06 OR b.zn <= 0.06 AS INT)) AS BIGINT) AS bottom,
  CAST(sum(CAST(a.zn <= 0.06 OR b.zn <= 0.06 OR a.zn >= 0.94 OR b.zn >= 0.94 OR a.rn >= 0.94 OR b.rn >= 0.94 AS INT)) AS BIGINT) AS boundary, avg((a.zn + b.zn) / 2) AS z_mid
  FROM contacts c JOIN k a ON a.run = c.run AND a.cycle = c.cycle AND a.phase = c.phase AND a.id = c.id1 JOIN k b ON b.run = c.run AND b.cycle = c.cycle AND b.phase = c.phase AND b.id = c.id2 GROUP BY 1, 2, 3""")  # fmt: skip
register("prj_boundary_flags", lambda s, d: ops.boundary_flags(nodes(s, d), STATE), "run cycle phase id bottom top", "", NODES, """
  SELECT n.run, n.cycle, n.phase, n.id, z <= lo AS bottom, z >= hi AS top FROM nodes n JOIN (SELECT run, cycle, phase, quantile_cont(z, 0.03) AS lo, quantile_cont(z, 0.97) AS hi FROM nodes GROUP BY 1, 2, 3) q
  ON n.run = q.run AND n.cycle = q.cycle AND n.phase = q.phase""")
register("prj_asinh_log", lambda s, d: panel(s, d).select("regime_id", "cycle", C.asinh_scale("x", 2.0).alias("a"), C.log10_eps("y", 1.0).alias("b"), F.log1p("w").alias("c"), C.clip(F.col("w") - 50000, low=0.0).alias("e"), C.signed_ratio("y", F.col("z") - 4, 0.5).alias("r")), "regime_id cycle", "a b c e r", PANEL,
  "SELECT regime_id, cycle, asinh(x / 2.0) AS a, log10(y + 1.0) AS b, ln(1 + w) AS c, greatest(w - 50000, 0.0) AS e, y / CASE WHEN abs(z - 4) >= 0.5 THEN z - 4 WHEN z - 4 < 0 THEN -0.5 ELSE 0.5 END AS r FROM panel")
register("prj_cut", lambda s, d: panel(s, d).select("regime_id", "cycle", C.cut("cycle", [0, 5, 15, 30], ["early", "middle", "late"]).alias("a"), C.cut("cycle", [1, 10, 20, 30], ["p", "q", "r"], right=False).alias("b")), "regime_id cycle a b", "", PANEL,
  "SELECT regime_id, cycle, CASE WHEN cycle <= 5 THEN 'early' WHEN cycle <= 15 THEN 'middle' ELSE 'late' END AS a, CASE WHEN cycle < 10 THEN 'p' WHEN cycle < 20 THEN 'q' WHEN cycle < 30 THEN 'r' END AS b FROM panel")
register("prj_segment", lambda s, d: panel(s, d).select("regime_id", "cycle", C.segment("cycle", [10, 20], ["early", "middle", "late"]).alias("segment"), C.parity("cycle").alias("parity")), "regime_id cycle segment parity", "", PANEL,
  "SELECT regime_id, cycle, CASE WHEN cycle <= 10 THEN 'early' WHEN cycle <= 20 THEN 'middle' ELSE 'late' END AS segment, CASE WHEN cycle % 2 = 0 THEN 'even' ELSE 'odd' END AS parity FROM panel")
register("prj_quadrant", lambda s, d: panel(s, d).select("regime_id", "cycle", C.quadrant(F.col("cycle") > 15, F.col("w") > 50000, ("both", "late", "wide", "neither")).alias("quadrant")), "regime_id cycle quadrant", "", PANEL,
  "SELECT regime_id, cycle, CASE WHEN cycle > 15 AND w > 50000 THEN 'both' WHEN cycle > 15 THEN 'late' WHEN w > 50000 THEN 'wide' ELSE 'neither' END AS quadrant FROM panel")
register("prj_rule_class", lambda s, d: panel(s, d).select("regime_id", "cycle", C.rule_class([(F.col("cycle") < 4, "a"), (F.col("n") % 2 == 0, "b")], "c").alias("class")), "regime_id cycle class", "", PANEL,
  "SELECT regime_id, cycle, CASE WHEN cycle < 4 THEN 'a' WHEN n % 2 = 0 THEN 'b' ELSE 'c' END AS class FROM panel")
register("prj_parity", lambda s, d: panel(s, d).groupBy(C.parity("cycle").alias("parity")).agg(F.sum("n").alias("n")), "parity n", "", PANEL, "SELECT CASE WHEN cycle % 2 = 0 THEN 'even' ELSE 'odd' END AS parity, CAST(sum(n) AS BIGINT) AS n FROM panel GROUP BY 1")
register("prj_string", lambda s, d: read(s, d, "part").select("p_partkey", F.regexp_replace("p_name", " ", "_").alias("a"), F.lower("p_brand").alias("b"), F.regexp_extract("p_brand", r"(\d+)", 1).alias("c"), F.col("p_name").contains("a").alias("e")), "p_partkey a b c e", "", "",
  r"SELECT p_partkey, regexp_replace(p_name, ' ', '_', 'g') AS a, lower(p_brand) AS b, regexp_extract(p_brand, '(\d+)', 1) AS c, contains(p_name, 'a') AS e FROM part")
register("jon_phase_delta", lambda s, d: ops.phase_delta(contacts(s, d).groupBy(*STATE).agg(F.count("*").cast("double").alias("n"), F.max("force").alias("top")), ["run", "cycle"], "phase", ["n", "top"]), "run cycle", "n_cold n_hot n_hot_minus_cold top_cold top_hot top_hot_minus_cold", CONTACTS, """
  SELECT c.run, c.cycle, c.n AS n_cold, h.n AS n_hot, h.n - c.n AS n_hot_minus_cold, c.top AS top_cold, h.top AS top_hot, h.top - c.top AS top_hot_minus_cold
  FROM (SELECT run, cycle, count(*) AS n, max(force) AS top FROM contacts WHERE phase = 'cold' GROUP BY 1, 2) c JOIN (SELECT run, cycle, count(*) AS n, max(force) AS top FROM contacts WHERE phase = 'hot' GROUP BY 1, 2) h ON c.run = h.run AND c.cycle = h.cycle""")  # fmt: skip
register("jon_phase_wide", lambda s, d: ops.phase_wide(contacts(s, d), ["run", "cycle"], "phase", ["force"], ["cold", "hot"]), "run cycle", "force_cold force_hot force_delta", CONTACTS,
  "SELECT run, cycle, avg(force) FILTER (phase = 'cold') AS force_cold, avg(force) FILTER (phase = 'hot') AS force_hot, avg(force) FILTER (phase = 'hot') - avg(force) FILTER (phase = 'cold') AS force_delta FROM contacts GROUP BY 1, 2")
register("jon_next_state", lambda s, d: ops.next_delta(panel(s, d), ["regime_id"], "cycle", ["x"]), "regime_id cycle", "next_x x_step", PANEL, "SELECT regime_id, cycle, lead(x) OVER w AS next_x, lead(x) OVER w - x AS x_step FROM panel WINDOW w AS (PARTITION BY regime_id ORDER BY cycle)")
register("jon_shifted_key", lambda s, d: ops.shifted_key_join(panel(s, d).filter("cycle % 4 <> 0"), panel(s, d).filter("cycle % 4 <> 0"), ["regime_id"], "cycle", ["w"]), "regime_id cycle", "w next_w", PANEL,
  "SELECT a.regime_id, a.cycle, a.w, b.w AS next_w FROM (SELECT * FROM panel WHERE cycle % 4 <> 0) a LEFT JOIN (SELECT * FROM panel WHERE cycle % 4 <> 0) b ON a.regime_id = b.regime_id AND b.cycle = a.cycle + 1")
register("jon_lag_key", lambda s, d: ops.lag_join(panel(s, d).filter("cycle % 9 <> 0"), ["regime_id"], "cycle", "x", "y", [-2, -1, 0, 1, 2]), "regime_id cycle lag", "x y", PANEL,
  "SELECT a.regime_id, a.cycle, CAST(l.lag AS INTEGER) AS lag, b.x, a.y FROM panel a CROSS JOIN (SELECT unnest([-2, -1, 0, 1, 2]) AS lag) l JOIN panel b ON a.regime_id = b.regime_id AND b.cycle = a.cycle - l.lag WHERE a.cycle % 9 <> 0 AND b.cycle % 9 <> 0")
register("jon_lag_position", lambda s, d: ops.lag_join(panel(s, d).filter("cycle % 9 <> 0"), ["regime_id"], "cycle", "x", "y", [0, 1, 2, 3], "position"), "regime_id cycle lag", "x y", PANEL,
  "WITH r AS (SELECT *, row_number() OVER (PARTITION BY regime_id ORDER BY cycle) AS i FROM panel WHERE cycle % 9 <> 0) SELECT a.regime_id, a.cycle, CAST(l.lag AS INTEGER) AS lag, b.x, a.y FROM r a CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS lag) l JOIN r b ON a.regime_id = b.regime_id AND b.i = a.i - l.lag")
register("jon_left_suffix", lambda s, d: ops.join_suffix(panel(s, d), panel(s, d).filter("cycle > 20").select("regime_id", "cycle", "x"), ["regime_id", "cycle"], "left"), "regime_id cycle", "x_x x_y", PANEL, "SELECT regime_id, cycle, x AS x_x, CASE WHEN cycle > 20 THEN x END AS x_y FROM panel")
register("jon_one_to_one", lambda s, d: ops.join_one_to_one(read(s, d, "nation").select("n_nationkey", "n_regionkey"), read(s, d, "nation").select("n_nationkey", "n_name"), ["n_nationkey"]), "n_nationkey n_regionkey n_name", "", "", "SELECT n_nationkey, n_regionkey, n_name FROM nation")
register("jon_atlas", lambda s, d: ops.build_atlas([panel(s, d).groupBy("regime_id").agg(F.avg(c).alias("m")) for c in ("x", "y", "w")], ["regime_id"]), "regime_id", "m m_2 m_3", PANEL, "SELECT regime_id, avg(x) AS m, avg(y) AS m_2, avg(w) AS m_3 FROM panel GROUP BY 1")
register("jon_common_union", lambda s, d: ops.common_union(panel(s, d).select("regime_id", "cycle", "x"), panel(s, d).filter("cycle < 4").select("cycle", "regime_id", "y"), ("all", "early")).groupBy("source", "regime_id").agg(F.count("*").alias("n")), "source regime_id n", "", PANEL,
  "SELECT 'all' AS source, regime_id, count(*) AS n FROM panel GROUP BY 2 UNION ALL SELECT 'early', regime_id, count(*) FROM panel WHERE cycle < 4 GROUP BY 2")
_PAIR = "FROM particles a JOIN particles b ON a.run = b.run AND a.cycle = b.cycle AND a.id < b.id"
_DIST = "sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z))"
register("jon_radius", lambda s, d: ops.radius_pairs(particles(s, d), ["run", "cycle"], 0.05), "run cycle id1 id2", "dist", PARTICLES, f"SELECT a.run, a.cycle, a.id AS id1, b.id AS id2, {_DIST} AS dist {_PAIR} WHERE {_DIST} <= 0.05")
register("jon_contact_skin", lambda s, d: ops.contact_skin(particles(s, d), ["run", "cycle"]), "run cycle id1 id2", "dist", PARTICLES, f"SELECT a.run, a.cycle, a.id AS id1, b.id AS id2, {_DIST} AS dist {_PAIR} WHERE {_DIST} <= (a.radius + b.radius) * 1.004")
register("jon_contact_overlap", lambda s, d: ops.contact_overlap(particles(s, d), ["run", "cycle"]), "run cycle id1 id2", "overlap", PARTICLES,
  f"SELECT a.run, a.cycle, a.id AS id1, b.id AS id2, a.radius + b.radius - {_DIST} AS overlap {_PAIR} JOIN (SELECT run, cycle, max(radius) AS r FROM particles GROUP BY 1, 2) m ON m.run = a.run AND m.cycle = a.cycle WHERE {_DIST} > 0 AND a.radius + b.radius - {_DIST} >= -0.004 * 2 * m.r")
register("set_edge_canon", lambda s, d: ops.edge_canon(contacts(s, d), ["run"]), "run id1 id2", "", CONTACTS, "SELECT DISTINCT run, least(id1, id2) AS id1, greatest(id1, id2) AS id2 FROM contacts")
_TURN = """count(*) FILTER (o AND w) AS persistent, count(*) FILTER (w AND NOT o) AS created, count(*) FILTER (o AND NOT w) AS broken, count(*) FILTER (o AND w) / count(*)::DOUBLE AS jaccard,
  count(*) FILTER (o AND w) / nullif(count(*) FILTER (o), 0)::DOUBLE AS survival, count(*) FILTER (w AND NOT o) / nullif(count(*) FILTER (w), 0)::DOUBLE AS creation"""
register("set_edge_turnover", lambda s, d: ops.edge_turnover(contacts(s, d), ["run", "phase"]), "run phase cycle persistent created broken", "jaccard survival creation", CONTACTS, f"""
  SELECT run, phase, cycle, {_TURN} FROM (SELECT coalesce(a.run, b.run) AS run, coalesce(a.phase, b.phase) AS phase, coalesce(a.cycle, b.cycle + 1) AS cycle, b.id1 IS NOT NULL AS o, a.id1 IS NOT NULL AS w
  FROM contacts a FULL JOIN contacts b ON a.run = b.run AND a.phase = b.phase AND a.cycle = b.cycle + 1 AND a.id1 = b.id1 AND a.id2 = b.id2)
  WHERE (run, phase, cycle) IN (SELECT DISTINCT run, phase, cycle FROM contacts) AND (run, phase, cycle - 1) IN (SELECT DISTINCT run, phase, cycle FROM contacts) GROUP BY 1, 2, 3""")
register("set_phase_turnover", lambda s, d: ops.phase_turnover(contacts(s, d), ["run", "cycle"]), "run cycle persistent created broken", "jaccard survival creation", CONTACTS, f"""
  SELECT run, cycle, {_TURN} FROM (SELECT coalesce(a.run, b.run) AS run, coalesce(a.cycle, b.cycle) AS cycle, b.id1 IS NOT NULL AS o, a.id1 IS NOT NULL AS w
  FROM (SELECT * FROM contacts WHERE phase = 'hot') a FULL JOIN (SELECT * FROM contacts WHERE phase = 'cold') b ON a.run = b.run AND a.cycle = b.cycle AND a.id1 = b.id1 AND a.id2 = b.id2)
  WHERE (run, cycle) IN (SELECT run, cycle FROM contacts GROUP BY 1, 2 HAVING count(DISTINCT phase) = 2) GROUP BY 1, 2""")
register("set_edge_survival", lambda s, d: ops.edge_survival(contacts(s, d).filter("cycle % 5 <> 3"), ["run", "phase"]), "run phase cycle next_cycle persistent created broken", "jaccard survival creation", CONTACTS, f"""
  WITH c AS (SELECT * FROM contacts WHERE cycle % 5 <> 3), s AS (SELECT * FROM (SELECT run, phase, cycle, lead(cycle) OVER (PARTITION BY run, phase ORDER BY cycle) AS next_cycle FROM (SELECT DISTINCT run, phase, cycle FROM c)) WHERE next_cycle IS NOT NULL),
  b AS (SELECT s.*, c.id1, c.id2 FROM s JOIN c ON s.run = c.run AND s.phase = c.phase AND s.cycle = c.cycle), a AS (SELECT s.*, c.id1, c.id2 FROM s JOIN c ON s.run = c.run AND s.phase = c.phase AND s.next_cycle = c.cycle)
  SELECT run, phase, cycle, next_cycle, {_TURN} FROM (SELECT coalesce(a.run, b.run) AS run, coalesce(a.phase, b.phase) AS phase, coalesce(a.cycle, b.cycle) AS cycle, coalesce(a.next_cycle, b.next_cycle) AS next_cycle, b.id1 IS NOT NULL AS o, a.id1 IS NOT NULL AS w
  FROM a FULL JOIN b ON a.run = b.run AND a.phase = b.phase AND a.cycle = b.cycle AND a.id1 = b.id1 AND a.id2 = b.id2) GROUP BY 1, 2, 3, 4""")
register("set_dedup_keep", lambda s, d: ops.keep_last(read(s, d, "events"), ["user_id"], [F.col("ts"), F.col("event_id")]), "user_id event_id event_type", "value", "", "SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
register("set_membership", lambda s, d: ops.membership(panel(s, d), panel(s, d).filter("n % 3 = 0").select("regime_id", "cycle"), ["regime_id", "cycle"]), "regime_id cycle member", "", PANEL, "SELECT regime_id, cycle, n % 3 = 0 AS member FROM panel")
register("rsh_pivot_matrix", lambda s, d: ops.pivot_matrix(panel(s, d), ["cycle"], "regime_id", "w", ["R1", "R2", "R3", "R4", "R5"]), "cycle", "R1 R2 R3 R4 R5", PANEL, "SELECT cycle, " + ", ".join(f"avg(w) FILTER (regime_id = 'R{k}') AS R{k}" for k in range(1, 6)) + " FROM panel GROUP BY 1")
register("rsh_crosstab", lambda s, d: ops.crosstab(read(s, d, "lineitem"), "l_returnflag", "l_linestatus"), "l_returnflag l_linestatus n", "", "",
  "SELECT a.l_returnflag, b.l_linestatus, count(c.l_orderkey) AS n FROM (SELECT DISTINCT l_returnflag FROM lineitem) a CROSS JOIN (SELECT DISTINCT l_linestatus FROM lineitem) b LEFT JOIN lineitem c ON c.l_returnflag = a.l_returnflag AND c.l_linestatus = b.l_linestatus GROUP BY 1, 2")


def _page_files(s, d):
    p = read(s, d, "pages")
    return p.select(F.col("url").alias("path"), F.octet_length(F.coalesce("html", F.lit(""))).cast("long").alias("length"), F.col("html").cast("binary").alias("content"))


_RULES = [("/en/", "english"), ("/fr/", "french")]
_INV = "inv AS (SELECT url AS path, CASE WHEN regexp_matches(url, '/en/') THEN 'english' WHEN regexp_matches(url, '/fr/') THEN 'french' ELSE 'other' END AS \"group\", CASE WHEN contains(url, 'blog.') THEN 'required' ELSE 'optional' END AS tier, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS bytes FROM pages)"
register("aud_inventory", lambda s, d: sources.inventory(_page_files(s, d), _RULES, ["blog."]).withColumnRenamed("group", "kind"), "path kind tier bytes", "mb", _INV, "SELECT path, \"group\" AS kind, tier, bytes, bytes / 1e6 AS mb FROM inv")
register("aud_tier_stats", lambda s, d: sources.tier_stats(sources.inventory(_page_files(s, d), _RULES, ["blog."])).withColumnRenamed("group", "kind"), "tier kind files bytes", "", _INV, "SELECT tier, \"group\" AS kind, count(*) AS files, CAST(sum(bytes) AS BIGINT) AS bytes FROM inv GROUP BY 1, 2")
register("aud_checksum", lambda s, d: sources.checksums(_page_files(s, d).filter("length % 3 <> 0"), _page_files(s, d)), "path sha256 status", "", "",
  "SELECT a.url AS path, b.h AS sha256, CASE WHEN b.h IS NULL THEN 'missing' ELSE 'present' END AS status FROM pages a LEFT JOIN (SELECT url, sha256(html) AS h FROM pages WHERE octet_length(encode(coalesce(html, ''))) % 3 <> 0) b ON a.url = b.url")
register("aud_package_plan", lambda s, d: sources.package_plan(sources.inventory(_page_files(s, d), _RULES, ["blog."]), F.concat_ws("_", "tier", F.substring("group", 1, 2))), "package files bytes groups", "", _INV,
  "SELECT concat(tier, '_', left(\"group\", 2)) AS package, count(*) AS files, CAST(sum(bytes) AS BIGINT) AS bytes, count(DISTINCT \"group\") AS groups FROM inv GROUP BY 1")
register("aud_presence", lambda s, d: sources.presence(_page_files(s, d).select(F.concat("path", F.lit("")).alias("path")), _page_files(s, d).filter("length > 3000").dropDuplicates(["path"])), "path present non_empty", "", "",
  "SELECT a.url AS path, b.url IS NOT NULL AS present, b.url IS NOT NULL AS non_empty FROM pages a LEFT JOIN (SELECT DISTINCT url FROM pages WHERE octet_length(encode(coalesce(html, ''))) > 3000) b ON a.url = b.url")


def _claims(s, d):
    """Claims about group sums: some right, some off, some with no row or several."""
    p = panel(s, d)
    values = p.groupBy(F.col("regime_id").alias("selector")).agg(F.sum("n").cast("double").alias("value"))
    values = values.unionByName(values.filter("selector = 'R5'"))
    claims = p.groupBy(F.col("regime_id").alias("selector")).agg((F.sum("n") + F.when(F.col("regime_id") == "R2", 9).otherwise(0.25)).cast("double").alias("claimed"))
    claims = claims.withColumn("selector", F.when(F.col("selector") == "R4", "R9").otherwise(F.col("selector")))
    return sources.audit_claims(claims.withColumns({"claim_id": F.concat(F.lit("c_"), "selector"), "tolerance": F.lit(0.5)}), values)


register("aud_claims", _claims, "claim_id status reason", "claimed source_value", PANEL, """
  SELECT concat('c_', CASE WHEN regime_id = 'R4' THEN 'R9' ELSE regime_id END) AS claim_id, CASE WHEN regime_id IN ('R4', 'R5') THEN 'error' WHEN regime_id = 'R2' THEN 'mismatch' ELSE 'pass' END AS status,
  CASE WHEN regime_id = 'R4' THEN 'no row' WHEN regime_id = 'R5' THEN 'several rows' WHEN regime_id = 'R2' THEN 'beyond tolerance' END AS reason, sum(n) + CASE WHEN regime_id = 'R2' THEN 9 ELSE 0.25 END AS claimed,
  CASE WHEN regime_id NOT IN ('R4', 'R5') THEN sum(n) END AS source_value FROM panel GROUP BY regime_id""")
