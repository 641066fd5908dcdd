"""Edge cases of frames, windows, statistics, models and streaming."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from cyclonet import functions as C
from cyclonet import sources, streaming
from cyclonet.operators import frames as fr
from cyclonet.operators import geometry as geo
from cyclonet.operators import models as mod
from cyclonet.operators import resampling as nul
from cyclonet.operators import statistics as st
from cyclonet.operators import windows as win


def test_finite_drops_nan_inf_null(spark):
    df = spark.createDataFrame([(1, 1.0), (2, float("nan")), (3, float("inf")), (4, None)], "k int, x double")
    assert [r.k for r in fr.finite(df, ["x"]).collect()] == [1]


def test_equal_count_seven_into_five(spark):
    df = spark.createDataFrame([(float(i),) for i in range(7)], "x double")
    got = [r.code for r in win.equal_count(df, [], "x", 5, []).orderBy("x").collect()]
    assert [got.count(c) for c in range(5)] == [2, 1, 2, 1, 1]


def test_cut_edges(spark):
    df = spark.createDataFrame([(0.0,), (5.0,), (5.1,), (31.0,)], "x double")
    assert [r.b for r in df.select("x", C.cut("x", [0, 5, 15], ["a", "b"]).alias("b")).collect()] == [None, "a", "b", None]
    assert df.select(C.cut("x", [0, 5, 15], ["a", "b"], include_lowest=True).alias("b")).first().b == "a"


def test_lag_modes_differ_with_gaps(spark):
    df = spark.createDataFrame([("g", c, float(c), float(c)) for c in (1, 2, 4)], "g string, cycle int, x double, y double")
    key = fr.lag_join(df, ["g"], "cycle", "x", "y", [1]).count()
    position = fr.lag_join(df, ["g"], "cycle", "x", "y", [1], "position").count()
    assert (key, position) == (1, 2)


def test_duplicate_key_fails(spark):
    a = spark.createDataFrame([(1, 2), (1, 3)], "k int, v int")
    with pytest.raises(ValueError, match="repeats"):
        fr.join_one_to_one(a, a.withColumnRenamed("v", "w"), ["k"])


def test_radius_pairs_brute_force(spark):
    rng = np.random.default_rng(1)
    p = rng.uniform(-1, 1, (120, 3))
    df = spark.createDataFrame([("s", i, *map(float, x)) for i, x in enumerate(p)], "s string, id long, x double, y double, z double")
    got = {(r.id1, r.id2) for r in fr.radius_pairs(df, ["s"], 0.3).collect()}
    want = {(i, j) for i in range(120) for j in range(i + 1, 120) if np.linalg.norm(p[i] - p[j]) <= 0.3}
    assert got == want


def test_radius_pairs_in_crowded_cells(spark):
    rng = np.random.default_rng(2)
    p = np.r_[rng.uniform(-1, 1, (150, 3)), rng.uniform(0.61, 0.89, (260, 3)), rng.normal(0.3, 0.004, (120, 3)), np.full((90, 3), -0.45)]
    rows = [("s", i, *map(float, x)) for i, x in enumerate(p)] + [("t", i, *map(float, x)) for i, x in enumerate(p[:40])]
    rows += [("s", 9000, float("nan"), 0.0, 0.0), ("s", None, 0.7, 0.7, 0.7), ("s", 9001, None, 0.7, 0.7)]
    df = spark.createDataFrame(rows, "s string, id long, x double, y double, z double").repartition(6)
    near = np.argwhere(np.triu(np.linalg.norm(p[:, None] - p[None], axis=2) <= 0.3, 1))
    want = sorted(("s", int(i), int(j)) for i, j in near) + sorted(("t", int(i), int(j)) for i, j in near if j < 40)
    for limit in (15, 40, 1000):
        assert sorted((r.s, r.id1, r.id2) for r in fr.radius_pairs(df, ["s"], 0.3, rows=limit).collect()) == want
    assert fr.radius_pairs(df.limit(0), ["s"], 0.3).count() == 0


def test_a_crowd_in_one_cell_spreads_over_join_keys(spark):
    place = F.sqrt((F.pmod(F.xxhash64("id"), F.lit(10007)) / 10007.0))
    df = spark.range(20_000).select(F.lit("s").alias("s"), "id", place.alias("x"), (F.col("id") % 97 / 97.0 * 0.99).alias("y"), (F.col("id") % 89 / 89.0 * 0.99).alias("z")).withColumn("x", F.col("x") * 0.99)
    p = df.withColumns({f"_c{a}": F.lit(0).cast("long") for a in "xyz"}).withColumn("_s", F.lit(0))
    parts = fr._crowded(p, ["s"], ["_cx", "_cy", "_cz"], 500).first()._parts
    assert sum(q._h for q in parts) == 40
    got = fr.radius_pairs(df, ["s"], 1.0).agg(F.count("*").alias("n"), F.countDistinct("id1").alias("a")).first()
    x = np.array([tuple(r) for r in df.select(*"xyz").collect()])
    rest = sum(int((((x[i] - x[i + 1 :]) ** 2).sum(axis=1) <= 1.0).sum()) for i in range(0, len(x), 400))
    some = fr.radius_pairs(df, ["s"], 1.0).filter("id1 % 400 = 0").count()
    assert some == rest and got.n > 1e8 and got.a > 19_000


def test_spearman_no_variance_and_few_rows(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 1.0, 3.0), ("a", 1.0, 4.0), ("b", 1.0, 2.0)], "g string, x double, y double")
    assert {r.g: r.rho for r in st.spearman(df, ["g"], "x", "y").collect()} == {"a": None, "b": None}


def test_map_fit_recovers_a_known_map(spark):
    a = np.array([[0.6, -0.5], [0.4, 0.7]])
    x, rows = np.array([1.0, 0.3]), []
    for c in range(12):
        rows.append(("g", c, float(x[0]), float(x[1])))
        x = a @ x
    df = spark.createDataFrame(rows, "g string, cycle int, u double, v double").withColumns({"next_u": F.expr("lead(u) over (partition by g order by cycle)"), "next_v": F.expr("lead(v) over (partition by g order by cycle)")})
    r = geo.map_fit(df, ["g"]).first()
    assert np.allclose([[r.a11, r.a12], [r.a21, r.a22]], a)
    assert np.isclose(r.spectral_radius, max(abs(np.linalg.eigvals(a))))


def test_unit_square_area(spark):
    square = [(0, 0), (1, 0), (1, 1), (0, 1)]
    df = spark.createDataFrame([("ccw", k, float(x), float(y)) for k, (x, y) in enumerate(square)] + [("cw", k, float(x), float(y)) for k, (x, y) in enumerate(square[::-1])], "g string, t int, x double, y double")
    assert {r.g: r.signed_area for r in geo.polygon_area(df, ["g"], "t", [("x", "y")]).collect()} == {"ccw": 1.0, "cw": -1.0}


def test_shift_of_single_rows_stays(spark):
    df = spark.createDataFrame([("a", 1, 5.0)], "g string, t int, x double")
    assert [r.x for r in nul.circular_shift(df, ["g"], "t", "x", 3, zero=False).collect()] == [5.0] * 3


def test_permutation_keeps_values(spark):
    df = spark.createDataFrame([("a", t, float(t)) for t in range(6)], "g string, t int, x double")
    got = nul.permute(df, ["g"], "t", "x", 4).groupBy("rep").agg(F.sort_array(F.collect_list("x")).alias("v")).collect()
    assert all(r.v == [0.0, 1.0, 2.0, 3.0, 4.0, 5.0] for r in got)


def test_logo_matches_refit(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, 2))
    y = x @ [1.0, -2.0] + 0.5 + rng.normal(scale=0.1, size=40)
    g = np.repeat(list("abcd"), 10)
    df = spark.createDataFrame([(str(k), *map(float, r), float(t)) for k, r, t in zip(g, x, y, strict=True)], "g string, p double, q double, y double")
    for r in mod.logo_linear(df, "g", ["p", "q"], "y").collect():
        inside = g != r.g
        w, *_ = np.linalg.lstsq(np.c_[np.ones(inside.sum()), x[inside]], y[inside], rcond=None)
        assert np.allclose([r.coef_intercept, r.coef_p, r.coef_q], w)


def test_parsers_take_the_last_frame(spark):
    text = "ITEM: TIMESTEP\n1\nITEM: ATOMS id x y z radius\n1 9 9 9 9\nITEM: TIMESTEP\n2\nITEM: ATOMS id radius x y z\n1 0.5 1 2 3\n2 0.5 4 5 6\n1 0.7 7 8 9\nshort\n"
    df = spark.createDataFrame([("p", text), ("none", "")], "path string, text string")
    got = {r.id: (r.x, r.y, r.z, r.radius) for r in sources.parse_particles(df, ["path"]).collect()}
    assert got == {1: (7.0, 8.0, 9.0, 0.7), 2: (4.0, 5.0, 6.0, 0.5)}


def test_lines_of_split_files_parse_as_whole_texts(spark, tmp_path):
    rng = np.random.default_rng(5)
    row = lambda i, v: f"{i} {v:.6f} 1 2 0.5"
    for k in range(3):
        frames = [f"ITEM: TIMESTEP\n{t}\nITEM: ATOMS id x y z radius\n" + "\n".join(row(i, v) for i, v in zip(rng.integers(0, 900, 1500), rng.random(1500), strict=True)) for t in range(3)]
        (tmp_path / f"a{k}.dump").write_text("\n".join(frames) + "\nshort\nITEM: BOX\n1 2 3 4 5\n")
        rows = "\n".join(" ".join(map(str, [i, i + 1, 0, *rng.integers(-5, 5, 13)])) for i in range(1200))
        (tmp_path / f"c{k}.local").write_text(f"ITEM: ENTRIES a\n1 2\nITEM: ENTRIES b\n{rows}\nragged line\n" if k else "no frame\n")
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    try:
        for name, parse in (("*.dump", sources.parse_particles), ("*.local", sources.parse_contacts)):
            lines = sources.read_lines(spark, str(tmp_path / name))
            assert lines.select("path", "place.block").distinct().count() > 10
            got = sorted(map(tuple, parse(lines, ["path"]).collect()))
            want = sorted(map(tuple, parse(sources.read_files(spark, str(tmp_path / name)), ["path"]).collect()))
            assert got == want and len(got) > 2000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


def test_files_round_trip(spark, tmp_path):
    run = tmp_path / "runA"
    run.mkdir()
    (run / "contacts_cycle_1_hot.local").write_text("x")
    (run / "cycle_1_hot.dump").write_text("y")
    (run / "cycle_2_hot.dump").write_text("")
    listing = spark.read.format("binaryFile").load(str(run)).select("path", "length")
    assert [(r.run, r.cycle, r.phase) for r in sources.discover_states(listing).collect()] == [("runA", 1, "hot")]
    (tmp_path / "t.csv").write_text("a,b\n1,2.5\n")
    assert sources.read_table(spark, str(tmp_path / "t.csv"), "a int, b double", ["a"]).first().b == 2.5
    (tmp_path / "s.json").write_text('{"c1": {"a": 1.5,\n "b": 2},\n "c2": {"a": 3}}')
    assert {(r.case, r.name): r.value for r in sources.json_stats(spark, str(tmp_path / "s.json")).collect()} == {("c1", "a"): 1.5, ("c1", "b"): 2.0, ("c2", "a"): 3.0}


def _stream(spark, tmp_path, batches, schema):
    folder = tmp_path / "in"
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(folder / f"b{k}"))
    return spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(folder))


def _run(spark, df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.sql(f"SELECT * FROM {name}").collect()


def test_pairs_once_in_any_order(spark, tmp_path):
    t = dt.datetime(2026, 1, 1)
    schema = "run string, cycle int, phase string, v double, ts timestamp"
    batches = [[("a", 1, "hot", 5.0, t), ("b", 1, "cold", 1.0, t)], [("a", 1, "cold", 2.0, t), ("a", 1, "cold", 9.0, t)]]
    out = _run(spark, streaming.pair_phases(_stream(spark, tmp_path, batches, schema), "run", "v", "ts", "10 minutes"), "pairs")
    assert [(r.run, r.cycle, r.cold, r.hot, r.hot_minus_cold) for r in out] == [("a", 1, 2.0, 5.0, 3.0)]


def test_stream_windows_equal_batch(spark, tmp_path):
    t = dt.datetime(2026, 1, 1)
    rows = [("a", t + dt.timedelta(minutes=m), float(m)) for m in range(0, 60, 7)]
    schema = "g string, ts timestamp, v double"
    made = _run(spark, streaming.rare_windows(_stream(spark, tmp_path, [rows[:4], rows[4:]], schema), "ts", "g", F.col("v") > 20, "15 minutes"), "windows", "complete")
    batch = streaming.rare_windows(spark.createDataFrame(rows, schema), "ts", "g", F.col("v") > 20, "15 minutes").collect()
    assert sorted(map(tuple, made)) == sorted(map(tuple, batch))
    assert streaming.rare_sessions(spark.createDataFrame(rows, schema), "ts", "g", F.col("v") > 20, "5 minutes").count() == len(rows)


def test_completeness_counts_once(spark):
    rows = [("a", 1, "hot"), ("a", 1, "hot"), ("a", 1, "cold"), ("b", 1, "hot")]
    got = {r.run: (r.seen, r.complete) for r in streaming.completeness(spark.createDataFrame(rows, "run string, cycle int, phase string"), "run", 2).collect()}
    assert got == {"a": (2, True), "b": (1, False)}
