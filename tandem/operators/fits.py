"""Fits of poses and lines: every pass over the data is one aggregation of moments; only 3x3 algebra is done on the driver or
per group."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

A, B = ("ax", "ay", "az"), ("bx", "by", "bz")


def moments(df: DataFrame, weight: Column, first: tuple[str, ...] = A, second: tuple[str, ...] = B) -> dict:
    """Weighted moments of two sets of columns, in one aggregation: rows and weight, both means, the cross covariance, and the
    first set's own covariance."""
    two = [(i, j) for i in first for j in second] + [(i, j) for k, i in enumerate(first) for j in first[k:]]
    sums = {c: F.sum(weight * F.col(c)) for c in first + second} | {f"{i} {j}": F.sum(weight * F.col(i) * F.col(j)) for i, j in two}
    r = df.agg(F.count(F.lit(1)).alias("rows"), F.sum(weight).alias("weight"), *(c.alias(n) for n, c in sums.items())).first()
    n = r["weight"] or 0.0
    if n <= 0:
        return {"rows": 0, "weight": 0.0}
    ma, mb = np.array([r[c] for c in first]) / n, np.array([r[c] for c in second]) / n
    own = lambda i, j: r[f"{first[min(i, j)]} {first[max(i, j)]}"]
    cross = np.array([[r[f"{i} {j}"] for j in second] for i in first]) / n - np.outer(ma, mb)
    spread = np.array([[own(i, j) for j in range(len(first))] for i in range(len(first))]) / n - np.outer(ma, ma)
    return {"rows": r["rows"], "weight": n, "first": ma, "second": mb, "cross": cross, "spread": spread}


def proper(u: np.ndarray, vt: np.ndarray) -> np.ndarray:
    """1, 1 and 1, or -1 where the two bases together would mirror: the weakest direction is turned round then."""
    return np.array([1.0, 1.0, -1.0 if np.linalg.det(u @ vt) < 0 else 1.0])


def nearest_rotation(m: np.ndarray) -> np.ndarray:
    """The rotation closest to a 3x3 matrix."""
    u, _, vt = np.linalg.svd(m)
    return (u * proper(u, vt)) @ vt


def fit_rigid(pairs: DataFrame, with_scale: bool = False, rounds: int = 1, huber: float | None = None, least_width: float = 0.02) -> dict | None:
    """Rotation r, translation t and scale with b = scale * r a + t, by least squares; with `huber`, rounds of reweighting by
    Huber's rule on the residual. pairs: ax, ay, az, bx, by, bz; rows with a null don't count.

    None where the rotation is undetermined: fewer than three pairs, or points a so near to one line that their second
    largest extent is under `least_width` of the largest.
    """
    known = pairs.dropna(subset=[*A, *B])
    middle = known.agg(*(F.avg(c).alias(c) for c in A + B)).first()  # squares of far coordinates would lose what the fit is about
    if middle[A[0]] is None:
        return None
    known = known.withColumns({c: F.col(c) - middle[c] for c in A + B})
    weight = F.lit(1.0)
    out: dict = {}
    for _ in range(rounds if huber else 1):
        m = moments(known, weight)
        if m["rows"] < 3:
            return None
        extents = np.sqrt(np.maximum(np.linalg.eigvalsh(m["spread"])[::-1], 0))
        if extents[0] <= 0 or extents[1] < least_width * extents[0]:
            return None
        u, d, vt = np.linalg.svd(m["cross"].T)
        sign = proper(u, vt)
        r = (u * sign) @ vt
        scale = float((d * sign).sum() / np.trace(m["spread"])) if with_scale else 1.0
        t = m["second"] - scale * r @ m["first"]
        out = {"rotation": r, "translation": t, "scale": scale, "weight": m["weight"]}
        if huber:
            weight = F.least(F.lit(1.0), huber / F.greatest(residual(out), F.lit(1e-12)))
    first, second = (np.array([middle[c] for c in names]) for names in (A, B))
    return out | {"translation": out["translation"] + second - out["scale"] * out["rotation"] @ first}


def scale_diagnostic(pairs: DataFrame, rotation: np.ndarray) -> float | None:
    """The least-squares scale of the positions when the rotation is held; None where a doesn't move. For diagnosis only: a
    scale off 1 says that one side's metres are not the other's."""
    known = pairs.dropna(subset=[*A, *B])
    middle = known.agg(*(F.avg(c).alias(c) for c in A + B)).first()
    if middle[A[0]] is None:
        return None
    a, b = ([F.col(c) - middle[c] for c in names] for names in (A, B))
    turned = [sum((float(rotation[i, j]) * a[j] for j in (1, 2)), float(rotation[i, 0]) * a[0]) for i in range(3)]
    r = known.agg(F.sum(sum((x * y for x, y in zip(turned[1:], b[1:], strict=True)), turned[0] * b[0])).alias("xy"), F.sum(sum((x * x for x in turned[1:]), turned[0] * turned[0])).alias("xx")).first()
    return r["xy"] / r["xx"] if r["xx"] > 2.3e-16 else None


def residual(fit: dict):
    """Distance of b from where the fit puts a, as a column."""
    r, t, s = fit["rotation"], fit["translation"], fit["scale"]
    parts = [F.col(B[i]) - (s * sum((float(r[i, j]) * F.col(A[j]) for j in (1, 2)), float(r[i, 0]) * F.col(A[0])) + float(t[i])) for i in range(3)]
    return F.sqrt(parts[0] * parts[0] + parts[1] * parts[1] + parts[2] * parts[2])


def alignment_study(pairs: DataFrame, order: str, huber: float) -> DataFrame:
    """Residuals of a fit without every fifth pair, on these and on the others: n, p50, p95, max. order: a column that
    numbers the pairs. An undetermined fit gives no rows."""
    numbered = pairs.withColumn("held_out", F.pmod(F.col(order), F.lit(5)) == 0)
    fit = fit_rigid(numbered.filter("NOT held_out"), rounds=5, huber=huber)
    error = F.lit(None).cast("double") if fit is None else residual(fit)
    rows = numbered.withColumn("e", error).filter("e IS NOT NULL")
    return rows.groupBy("held_out").agg(F.count("e").alias("n"), F.percentile("e", F.lit(0.5)).alias("p50"), F.percentile("e", F.lit(0.95)).alias("p95"), F.max("e").alias("max"))


def mean_rotation(df: DataFrame, by: list[str], schema: str) -> DataFrame:
    """The chordal mean of each group's quaternions: their rotations are summed in the aggregation, the nearest rotation to the
    sum is found per group. Columns r00..r22."""
    from tandem.functions import geometry as g

    names = [f"r{i}{j}" for i in range(3) for j in range(3)]
    sums = df.groupBy(*by).agg(*(F.sum(c).alias(n) for n, c in zip(names, g.rotation(g.cols("qx", "qy", "qz", "qw"), None), strict=True)))

    def project(batches):
        for batch in batches:
            m = batch[names].to_numpy().reshape(-1, 3, 3)
            r = np.array([nearest_rotation(x) for x in m]).reshape(-1, 9)
            yield pd.concat([batch[by], pd.DataFrame(r, columns=names)], axis=1)

    return sums.mapInPandas(project, f"{schema}, " + ", ".join(f"{n} double" for n in names))


def fit_inverse_depth(anchors: DataFrame, by: list[str], tolerance: float) -> DataFrame:
    """1 / z = a * d + b per group: each pair of anchors is a hypothesis, the one with most inliers (then the least pair) is
    fitted again by least squares on them. anchors: i, d, z; groups are a frame's few anchors."""
    rows = anchors.filter("z > 0").withColumn("y", 1 / F.col("z"))
    side = lambda n: rows.select(*by, *(F.col(c).alias(f"{c}{n}") for c in ("i", "d", "y")))
    pairs = side(1).join(side(2), by).filter("i1 < i2 AND d1 <> d2").withColumn("a", (F.col("y2") - F.col("y1")) / (F.col("d2") - F.col("d1"))).withColumn("b", F.col("y1") - F.col("a") * F.col("d1"))
    votes = pairs.join(rows, by).withColumn("in", F.abs(F.col("a") * F.col("d") + F.col("b") - F.col("y")) <= tolerance)
    counted = votes.groupBy(*by, "i1", "i2", "a", "b").agg(F.count_if("in").alias("n"))
    best = counted.groupBy(*by).agg(F.min(F.struct(-F.col("n"), "i1", "i2", "a", "b")).alias("h")).select(*by, F.col("h.a").alias("a0"), F.col("h.b").alias("b0"))
    inliers = rows.join(best, by).filter(F.abs(F.col("a0") * F.col("d") + F.col("b0") - F.col("y")) <= tolerance)
    return inliers.groupBy(*by).agg(F.regr_slope("y", "d").alias("a"), F.regr_intercept("y", "d").alias("b"), F.count(F.lit(1)).alias("n"))


def triangulate(rays: DataFrame, by: list[str], least_depth: float | None = None, most_range: float | None = None, least_angle: float | None = None) -> DataFrame:
    """by, n, x, y, z: the point nearest to all rays (origin ox.., direction dx.., weight if given) of a group, by the closed 3x3
    solution; null with fewer than two rays of a weight over 0, or parallel ones.

    With gates a point is null too unless it is at least least_depth ahead along every ray, at most most_range from every
    origin, and seen from two origins under an angle of least_angle degrees; a group's rays are then paired.
    """
    weight = F.col("weight") if "weight" in rays.columns else F.lit(1.0)
    rays = rays.withColumn("_w", weight).filter("_w > 0")
    d = [F.col(f"d{c}") for c in "xyz"]
    n = F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])
    u = [c / n for c in d]
    m = {(i, j): F.sum(F.col("_w") * ((1.0 if i == j else 0.0) - u[i] * u[j])) for i in range(3) for j in range(i, 3)}
    o = [F.col(f"o{c}") for c in "xyz"]
    v = [F.sum(F.col("_w") * sum((((1.0 if i == j else 0.0) - u[i] * u[j]) * o[j] for j in (1, 2)), ((1.0 if i == 0 else 0.0) - u[i] * u[0]) * o[0])) for i in range(3)]
    s = rays.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *(c.alias(f"m{i}{j}") for (i, j), c in m.items()), *(c.alias(f"v{i}") for i, c in enumerate(v)))
    e = lambda i, j: F.col(f"m{min(i, j)}{max(i, j)}")
    cof = lambda i, j: e((i + 1) % 3, (j + 1) % 3) * e((i + 2) % 3, (j + 2) % 3) - e((i + 1) % 3, (j + 2) % 3) * e((i + 2) % 3, (j + 1) % 3)
    det = sum((e(0, j) * cof(0, j) for j in (1, 2)), e(0, 0) * cof(0, 0))
    ok = (F.col("n") >= 2) & (F.abs(det) > 1e-9)
    point = [F.when(ok, F.try_divide(sum((cof(j, i) * F.col(f"v{j}") for j in (1, 2)), cof(0, i) * F.col("v0")), det)) for i in range(3)]
    out = s.select(*by, "n", *(p.alias(c) for c, p in zip("xyz", point, strict=True)))
    if least_depth is None and most_range is None and least_angle is None:
        return out
    to = [F.col(c) - F.col(f"o{c}") for c in "xyz"]
    far = F.sqrt(to[0] * to[0] + to[1] * to[1] + to[2] * to[2])
    seen = rays.join(out.filter("x IS NOT NULL").drop("n"), by).withColumns({"far": far, "depth": sum((a * b for a, b in zip(to[1:], u[1:], strict=True)), to[0] * u[0]), "way": F.when(far > 0, F.array(*(c / far for c in to)))})
    ways = seen.groupBy(*by).agg(F.min("depth").alias("depth"), F.max("far").alias("far"), F.collect_list("way").alias("ways"))
    cosines = F.flatten(F.transform("ways", lambda a: F.transform("ways", lambda b: a[0] * b[0] + a[1] * b[1] + a[2] * b[2])))
    ways = ways.withColumn("angle", F.degrees(F.acos(F.greatest(F.least(F.array_min(cosines), F.lit(1.0)), F.lit(-1.0)))))
    good = F.lit(True)
    for limit, test in ((least_depth, lambda x: F.col("depth") >= x), (most_range, lambda x: F.col("far") <= x), (least_angle, lambda x: F.col("angle") >= x)):
        good = good if limit is None else good & test(limit)
    kept = out.join(ways.select(*by, good.alias("good")), by, "left")
    return kept.select(*by, "n", *(F.when(F.coalesce("good", F.lit(False)), F.col(c)).alias(c) for c in "xyz"))


def masked_median(pixels: DataFrame, by: list[str], value: str, mask: str, least: int) -> DataFrame:
    """The median over time of each pixel's unmasked values; null where fewer than `least` are there."""
    seen = F.when(~F.col(mask), F.col(value))
    return pixels.groupBy(*by).agg(F.when(F.count(seen) >= least, F.percentile(seen, F.lit(0.5))).alias("median"), F.count(seen).alias("support"))
