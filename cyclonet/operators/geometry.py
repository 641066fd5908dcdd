"""Return maps and phase-plane geometry of cyclic panels."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .windows import over


def steps(df: DataFrame, by: list[str], order: str, x: str, y: str) -> DataFrame:
    """Adds dx, dy, step length, radial contraction, signed area increment of each step; the last row of a group has none."""
    w = Window.partitionBy(*by).orderBy(order)
    out = df.withColumns({"next_" + order: F.lead(order).over(w), "_nx": F.lead(x).over(w), "_ny": F.lead(y).over(w)}).filter(F.col("_nx").isNotNull())
    dx, dy = F.col("_nx") - F.col(x), F.col("_ny") - F.col(y)
    out = out.withColumns({"dx": dx, "dy": dy}).withColumn("step", F.sqrt(F.col("dx") ** 2 + F.col("dy") ** 2))
    out = out.withColumns({"contraction": F.sqrt(F.col(x) ** 2 + F.col(y) ** 2) - F.sqrt(F.col("_nx") ** 2 + F.col("_ny") ** 2), "area": (F.col(x) * F.col("_ny") - F.col("_nx") * F.col(y)) / 2})
    return out.drop("_nx", "_ny")


def path(df: DataFrame, by: list[str], order: str, x: str, y: str) -> DataFrame:
    """Per group: signed area and its two parts, arc length, net displacement, persistence, up and down flux, turning."""
    s = steps(df, by, order, x, y)
    w = Window.partitionBy(*by).orderBy(order)
    turn = F.atan2(F.lag("dx").over(w) * F.col("dy") - F.lag("dy").over(w) * F.col("dx"), F.lag("dx").over(w) * F.col("dx") + F.lag("dy").over(w) * F.col("dy"))
    s = s.withColumn("_turn", turn)
    out = s.groupBy(*by).agg(
        F.count("*").alias("segments"), F.sum("area").alias("signed_area"), F.sum(F.greatest("area", F.lit(0.0))).alias("counterclockwise"), F.sum(F.least("area", F.lit(0.0))).alias("clockwise"),
        F.sum("step").alias("arc_length"), F.sqrt(F.sum("dx") ** 2 + F.sum("dy") ** 2).alias("net"), F.sum(F.greatest("dy", F.lit(0.0))).alias("up"), F.sum(F.least("dy", F.lit(0.0))).alias("down"), F.avg(F.abs("_turn")).alias("mean_turn"),
    )
    return out.withColumn("persistence", F.when(F.col("arc_length") > 0, F.col("net") / F.col("arc_length")))


def polygon_area(df: DataFrame, by: list[str], order: str, points: list[tuple[str, str]]) -> DataFrame:
    """Closed signed polygon area per group over the points of every row in turn (cold then hot); under three points null."""
    cells = F.array(*(F.struct(F.lit(i).alias("_k"), F.col(a).alias("_x"), F.col(b).alias("_y")) for i, (a, b) in enumerate(points)))
    p = df.select(*by, F.col(order).alias("_o"), F.inline(cells)).filter("_x IS NOT NULL AND _y IS NOT NULL")
    w = Window.partitionBy(*by).orderBy("_o", "_k")
    every = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nx, ny = F.coalesce(F.lead("_x").over(w), F.first("_x").over(every)), F.coalesce(F.lead("_y").over(w), F.first("_y").over(every))
    p = p.withColumn("_a", (F.col("_x") * ny - nx * F.col("_y")) / 2)
    return p.groupBy(*by).agg(F.when(F.count("*") >= 3, F.sum("_a")).alias("signed_area")).withColumn("area", F.abs("signed_area"))


def map_coordinates(df: DataFrame, by: list[str], order: str, x: str, y: str) -> DataFrame:
    """Group z of two columns (sample sd; zero: null) and of their next values on the current columns' mean and sd."""
    w, o = over(by), Window.partitionBy(*by).orderBy(order)
    out = df.withColumns({"_n" + c: F.lead(c).over(o) for c in (x, y)})
    cols = {}
    for name, c in (("u", x), ("v", y)):
        sd, m = F.stddev_samp(c).over(w), F.avg(c).over(w)
        cols[name] = F.when(sd > 0, (F.col(c) - m) / sd)
        cols["next_" + name] = F.when(sd > 0, (F.col("_n" + c) - m) / sd)
    return out.withColumns(cols).drop("_n" + x, "_n" + y)


def map_fit(coords: DataFrame, by: list[str], x: str = "u", y: str = "v") -> DataFrame:
    """The 2 x 2 linear map (with intercept) from (x, y) to the next values: entries, determinant, trace, spectral radius,
    real and imaginary part of the leading eigenvalue; closed form from covariances."""
    d = coords.filter(" AND ".join(f"{c} IS NOT NULL" for c in (x, y, f"next_{x}", f"next_{y}")))
    pairs = [(x, x), (x, y), (y, y), (x, f"next_{x}"), (y, f"next_{x}"), (x, f"next_{y}"), (y, f"next_{y}")]
    names = ["sxx", "sxy", "syy", "xp", "yp", "xq", "yq"]
    out = d.groupBy(*by).agg(F.count("*").alias("n"), *(F.covar_pop(a, b).alias(k) for (a, b), k in zip(pairs, names, strict=True)))
    det = F.col("sxx") * F.col("syy") - F.col("sxy") ** 2
    solve = lambda p, q: (F.when(det > 1e-12, (F.col("syy") * F.col(p) - F.col("sxy") * F.col(q)) / det), F.when(det > 1e-12, (F.col("sxx") * F.col(q) - F.col("sxy") * F.col(p)) / det))
    (a11, a12), (a21, a22) = solve("xp", "yp"), solve("xq", "yq")
    out = out.select(*by, "n", a11.alias("a11"), a12.alias("a12"), a21.alias("a21"), a22.alias("a22"))
    out = out.withColumns({"determinant": F.col("a11") * F.col("a22") - F.col("a12") * F.col("a21"), "trace": F.col("a11") + F.col("a22")})
    disc = F.col("trace") ** 2 / 4 - F.col("determinant")
    half = F.col("trace") / 2
    real = F.when(disc >= 0, F.when(half >= 0, half + F.sqrt(F.greatest(disc, F.lit(0.0)))).otherwise(half - F.sqrt(F.greatest(disc, F.lit(0.0))))).otherwise(half)
    imag = F.when(disc < 0, F.sqrt(F.greatest(-disc, F.lit(0.0)))).otherwise(0.0)
    return out.withColumns({"eigen_real": real, "eigen_imag": F.when(F.col("trace").isNotNull(), imag)}).withColumn("spectral_radius", F.sqrt(F.col("eigen_real") ** 2 + F.col("eigen_imag") ** 2))


def map_normal_form(maps: DataFrame) -> DataFrame:
    """Half trace, split, shear, circulation, alternation and the margin to instability of each fitted map."""
    return maps.withColumns({
        "half_trace": F.col("trace") / 2, "split": (F.col("a11") - F.col("a22")) / 2, "shear": (F.col("a12") + F.col("a21")) / 2, "circulation": (F.col("a21") - F.col("a12")) / 2,
        "alternation": F.greatest(-F.col("eigen_real"), F.lit(0.0)), "margin": 1 - F.col("spectral_radius"),
    })


def _per_map(maps: DataFrame, by: list[str], schema: str, run) -> DataFrame:
    types = ", ".join(f"{b} {maps.schema[b].dataType.simpleString()}" for b in by)

    def each(frames):
        for f in frames:
            rows = []
            for _, r in f.iterrows():
                a = np.array([[r["a11"], r["a12"]], [r["a21"], r["a22"]]], float)
                rows += [{b: r[b] for b in by} | x for x in run(a)] if np.isfinite(a).all() else []
            yield pd.DataFrame(rows, columns=[*by, *(c.strip().split()[0] for c in schema.split(","))])

    return maps.mapInPandas(each, f"{types}, {schema}")


def map_gain(maps: DataFrame, by: list[str], powers: int = 15) -> DataFrame:
    """Spectral norm of each power of the map."""

    def run(a: np.ndarray) -> list[dict]:
        p, out = np.eye(2), []
        for k in range(1, powers + 1):
            p = p @ a
            out.append({"power": k, "gain": float(np.linalg.norm(p, 2))})
        return out

    return _per_map(maps, by, "power int, gain double", run)


def map_modes(maps: DataFrame, by: list[str]) -> DataFrame:
    """Singular values and the angle of the most amplified direction, in degrees from the first axis, in (-90, 90]."""

    def run(a: np.ndarray) -> list[dict]:
        _, s, vt = np.linalg.svd(a)
        angle = math.degrees(math.atan2(vt[0, 1], vt[0, 0]))
        angle = angle - 180 if angle > 90 else angle + 180 if angle <= -90 else angle
        return [{"sigma1": float(s[0]), "sigma2": float(s[1]), "direction": angle}]

    return _per_map(maps, by, "sigma1 double, sigma2 double, direction double", run)


def map_lyapunov(maps: DataFrame, by: list[str]) -> DataFrame:
    """P of A'PA - P + I = 0 for stable maps, its anisotropy (ratio of eigenvalues) and the margin; unstable: null."""

    def run(a: np.ndarray) -> list[dict]:
        radius = max(abs(np.linalg.eigvals(a)))
        if radius >= 1:
            return [{"p11": None, "p12": None, "p22": None, "anisotropy": None, "stability_margin": 1 - radius}]
        p = np.linalg.solve(np.eye(4) - np.kron(a.T, a.T), np.eye(2).ravel()).reshape(2, 2)
        e = np.linalg.eigvalsh((p + p.T) / 2)
        return [{"p11": p[0, 0], "p12": p[0, 1], "p22": p[1, 1], "anisotropy": e[1] / e[0], "stability_margin": 1 - radius}]

    return _per_map(maps, by, "p11 double, p12 double, p22 double, anisotropy double, stability_margin double", run)


def segment_displacement(df: DataFrame, by: list[str], segment: str, x: str, y: str, first: str, last: str) -> DataFrame:
    """Median of the coordinates in two segments, the vector between them, its norm and angle."""
    m = lambda c, s: F.expr(f"percentile(CASE WHEN {segment} = '{s}' THEN {c} END, 0.5)")
    out = df.groupBy(*by).agg(m(x, first).alias("x_first"), m(y, first).alias("y_first"), m(x, last).alias("x_last"), m(y, last).alias("y_last"))
    out = out.withColumns({"dx": F.col("x_last") - F.col("x_first"), "dy": F.col("y_last") - F.col("y_first")})
    return out.withColumns({"norm": F.sqrt(F.col("dx") ** 2 + F.col("dy") ** 2), "angle": F.degrees(F.atan2("dy", "dx"))})


def order_null(df: DataFrame, by: list[str], order: str, x: str, y: str, n: int, seed: int = 0) -> DataFrame:
    """rep, by, signed_area under random row orders of each group."""
    from .resampling import draw, replicates

    r = replicates(df.select(*by, order, x, y), n).withColumn("_u", draw(seed, "rep", *by, order))
    return steps(r, ["rep", *by], "_u", x, y).groupBy("rep", *by).agg(F.sum("area").alias("signed_area"))


def readout(df: DataFrame, by: list[str], x: str, y: str, target: str) -> DataFrame:
    """c1, c2: coefficients of the linear readout of the target from two columns per key (with intercept), closed form."""
    out = df.filter(f"{x} IS NOT NULL AND {y} IS NOT NULL AND {target} IS NOT NULL").groupBy(*by).agg(
        F.var_pop(x).alias("sxx"), F.covar_pop(x, y).alias("sxy"), F.var_pop(y).alias("syy"), F.covar_pop(x, target).alias("xt"), F.covar_pop(y, target).alias("yt")
    )
    det = F.col("sxx") * F.col("syy") - F.col("sxy") ** 2
    c = lambda v: F.when(det > 1e-12, v / det)
    return out.select(*by, c(F.col("syy") * F.col("xt") - F.col("sxy") * F.col("yt")).alias("c1"), c(F.col("sxx") * F.col("yt") - F.col("sxy") * F.col("xt")).alias("c2"))


def observability(maps: DataFrame, readouts: DataFrame, by: list[str]) -> DataFrame:
    """Direction A'c that the readout c sees one step later, its gain |A'c| / |c| and the angle between both in degrees."""
    out = maps.join(readouts, by)
    out = out.withColumns({"d1": F.col("a11") * F.col("c1") + F.col("a21") * F.col("c2"), "d2": F.col("a12") * F.col("c1") + F.col("a22") * F.col("c2")})
    norm, seen = F.sqrt(F.col("c1") ** 2 + F.col("c2") ** 2), F.sqrt(F.col("d1") ** 2 + F.col("d2") ** 2)
    dot = (F.col("c1") * F.col("d1") + F.col("c2") * F.col("d2")) / F.when((norm > 0) & (seen > 0), norm * seen)
    return out.select(*by, "c1", "c2", "d1", "d2", F.when(norm > 0, seen / norm).alias("gain"), F.degrees(F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), dot)))).alias("angle"))


def gradient_angle(samples: DataFrame, by: list[str], x: str, y: str, first: str, second: str) -> DataFrame:
    """Angle in degrees between the readouts of two targets for each key (a replicate, say)."""
    a = readout(samples, by, x, y, first)
    b = readout(samples, by, x, y, second).withColumnsRenamed({"c1": "e1", "c2": "e2"})
    n = F.sqrt(F.col("c1") ** 2 + F.col("c2") ** 2) * F.sqrt(F.col("e1") ** 2 + F.col("e2") ** 2)
    dot = (F.col("c1") * F.col("e1") + F.col("c2") * F.col("e2")) / F.when(n > 0, n)
    return a.join(b, by).select(*by, F.degrees(F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), dot)))).alias("angle"))
