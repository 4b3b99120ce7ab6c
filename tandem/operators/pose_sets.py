"""Several observations of one pose: means that leave outliers out, tags seen by several cameras, and motion without a frame."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tandem.functions import geometry as g

from .fits import nearest_rotation
from .graph import settled

POSE = ("x", "y", "z", "qx", "qy", "qz", "qw")
ROTATION = [f"r{i}{j}" for i in range(3) for j in range(3)]


def apart(a: str, b: str) -> tuple[Column, Column]:
    """Distance and angle in degrees between two poses, columns by prefix."""
    of = lambda p, names: g.cols(*(f"{p}{c}" for c in names))
    return g.norm(g.minus(of(a, "xyz"), of(b, "xyz"))), F.degrees(g.quaternion_angle(of(a, ("qx", "qy", "qz", "qw")), of(b, ("qx", "qy", "qz", "qw"))))


def inliers(poses: DataFrame, by: list[str], tolerance: tuple[float, float]) -> DataFrame:
    """by, id, medoid (the group's pose with the least sum of distances and angles to all others, in tolerances; of equal ones
    the least id) and inlier: within both tolerances of it. Groups are a pose's few observations: they are paired with themselves."""
    side = lambda p: poses.select(*by, F.col("id").alias(f"{p}id"), *(F.col(c).alias(f"{p}{c}") for c in POSE))
    far, turn = apart("a_", "b_")
    pairs = settled(side("a_").join(side("b_"), by).select(*by, "a_id", "b_id", far.alias("far"), turn.alias("turn")))
    cost = F.when(F.col("a_id") != F.col("b_id"), F.col("far") / tolerance[0] + F.col("turn") / tolerance[1]).otherwise(0.0)
    sums = pairs.groupBy(*by, "a_id").agg(F.sum(cost).alias("total"))
    medoid = sums.groupBy(*by).agg(F.min(F.struct(F.round("total", 6), "a_id")).getField("a_id").alias("medoid"))
    near = pairs.join(medoid, by).filter(F.col("a_id") == F.col("medoid"))
    return near.select(*by, F.col("b_id").alias("id"), "medoid", ((F.col("far") <= tolerance[0]) & (F.col("turn") <= tolerance[1])).alias("inlier"))


def mean_pose(poses: DataFrame, by: list[str], schema: str, tolerance: tuple[float, float] | None = None) -> DataFrame:
    """by, n, n_in, x, y, z and r00..r22: the weighted mean position and chordal mean rotation of each group's inliers (of all
    poses without a tolerance). poses: id, the pose and, if given, weight; weights under or at 0 don't count.

    Rotations are summed in the aggregation; the nearest rotation to each sum is found per group.
    """
    weight = F.col("weight") if "weight" in poses.columns else F.lit(1.0)
    rows = poses.withColumn("_w", weight)
    rows = rows.withColumn("inlier", F.lit(True)) if tolerance is None else rows.join(inliers(poses, by, tolerance), [*by, "id"])
    w = F.when(F.col("inlier") & (F.col("_w") > 0), F.col("_w"))
    sums = {n: F.sum(w * c) for n, c in zip(ROTATION, g.unit_rotation(g.cols("qx", "qy", "qz", "qw")), strict=True)}
    found = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count(w).alias("n_in"), *((F.sum(w * F.col(c)) / F.sum(w)).alias(c) for c in "xyz"), *(c.alias(n) for n, c in sums.items()))
    return found.filter("n_in > 0").mapInPandas(_rotations, f"{schema}, n long, n_in long, x double, y double, z double, " + ", ".join(f"{n} double" for n in ROTATION))


def _rotations(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        if len(batch):
            batch[ROTATION] = np.array([nearest_rotation(m) for m in batch[ROTATION].to_numpy().reshape(-1, 3, 3)]).reshape(-1, 9)
        yield batch


def agreements(seen: DataFrame, by: list[str], tolerance: tuple[float, float]) -> DataFrame:
    """Each solution of a tag in a frame with n, the cameras that agree with it (its own too), and the sums of their poses.

    seen: frame, camera, k (0 the first solution, 1 the other one of an ambiguous view), err and the pose. Of another camera's
    solutions the one nearest to this is asked, distance and angle in tolerances added up; it agrees within both.
    """
    key = [*by, "frame"]
    rotation = F.array(*g.unit_rotation(g.cols("qx", "qy", "qz", "qw")))
    rows = seen.select(*key, "camera", "k", "err", *POSE, rotation.alias("r"))
    side = lambda p: rows.select(*key, *(F.col(c).alias(f"{p}{c}") for c in ("camera", "k", *POSE, "r")))
    far, turn = apart("a_", "b_")
    pairs = side("a_").join(side("b_"), key).filter("a_camera <> b_camera").withColumns({"far": far, "turn": turn})
    cost = F.round(F.col("far") / tolerance[0] + F.col("turn") / tolerance[1], 9)
    best = pairs.groupBy(*key, "a_camera", "a_k", "b_camera").agg(F.min(F.struct(cost.alias("cost"), "b_k", "far", "turn", F.array("b_x", "b_y", "b_z").alias("p"), "b_r")).alias("m"))
    agree = best.filter((F.col("m.far") <= tolerance[0]) & (F.col("m.turn") <= tolerance[1]))
    add = {f"p{i}": F.sum(F.col("m.p")[i]) for i in range(3)} | {n: F.sum(F.col("m.b_r")[i]) for i, n in enumerate(ROTATION)}
    sums = agree.groupBy(*key, F.col("a_camera").alias("camera"), F.col("a_k").alias("k")).agg(F.count(F.lit(1)).alias("m"), *(c.alias(n) for n, c in add.items()))
    out = rows.join(sums, [*key, "camera", "k"], "left")
    plus = lambda c, own: (F.coalesce(c, F.lit(0.0)) + own).alias(c)
    return out.select(*key, "camera", "k", "err", (1 + F.coalesce("m", F.lit(0))).alias("n"), *(plus(f"p{i}", F.col(c)) for i, c in enumerate("xyz")), *(plus(n, F.col("r")[i]) for i, n in enumerate(ROTATION)))


def fuse_tags(seen: DataFrame, by: list[str], schema: str, tolerance: tuple[float, float] = (0.05, 10.0), window: int = 1) -> DataFrame:
    """by, frame, n (cameras that agree), ambiguous, x, y, z and r00..r22: one pose of each tag in each frame that shows it.

    The largest set of agreeing cameras counts, of equal ones that round the smaller error, then the first solution, then the
    first camera; its mean is the pose. A lone camera with two solutions shows the one whose rotation is nearer to the pose
    of the frame before it in which the tag is fused: only this goes along a tag's frames. With a window, positions are
    running medians over so many frames.
    """
    key = [*by, "frame"]
    rows = agreements(seen, by, tolerance)
    cameras = F.size(F.collect_set("camera").over(Window.partitionBy(*key)))
    order = Window.partitionBy(*key).orderBy(F.desc("n"), "err", "k", "camera")
    rows = rows.withColumns({"cameras": cameras, "place": F.row_number().over(order)}).filter("place = 1 OR cameras = 1")
    names = [f"p{i}" for i in range(3)]

    def chain(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["frame", "place"], kind="stable")
        out, before = [], None
        for frame, own in part.groupby("frame", sort=True):
            turns = [nearest_rotation(m) for m in own[ROTATION].to_numpy().reshape(-1, 3, 3)]
            at = 0
            if len(turns) > 1 and before is not None:
                at = int(np.argmax([np.trace(before.T @ r) for r in turns]))
            before = turns[at]
            row = own.iloc[at]
            out.append((*(row[c] for c in by), frame, row["n"], len(turns) > 1, *(row[names] / row["n"]), *before.ravel()))
        return pd.DataFrame(out, columns=[*by, "frame", "n", "ambiguous", "x", "y", "z", *ROTATION])

    out = rows.groupBy(*by).applyInPandas(chain, f"{schema}, frame long, n long, ambiguous boolean, x double, y double, z double, " + ", ".join(f"{n} double" for n in ROTATION))
    if window > 1:
        w = Window.partitionBy(*by).orderBy("frame").rangeBetween(-(window // 2), window // 2)
        out = out.withColumns({c: F.percentile(c, F.lit(0.5)).over(w) for c in "xyz"})
    return out


def relative_motion(pairs: DataFrame, by: list[str], stride: int) -> DataFrame:
    """by, i, elapsed, distance and angle (degrees): by how much two devices' own motion over `stride` pairs differs, which needs
    no frame that both share. pairs: i, t and the poses a_ and b_, in the order of i; the first `stride` pairs have no row."""
    w = Window.partitionBy(*by).orderBy("i")
    names = [f"{p}_{c}" for p in "ab" for c in POSE]
    rows = pairs.withColumns({f"was_{c}": F.lag(c, stride).over(w) for c in (*names, "t")}).filter("was_t IS NOT NULL")
    own = []
    for p in "ab":
        then, now = (g.unit_rotation(g.cols(*(f"{x}{p}_{c}" for c in POSE[3:]))) for x in ("was_", ""))
        step = g.minus(g.cols(*(f"{p}_{c}" for c in "xyz")), g.cols(*(f"was_{p}_{c}" for c in "xyz")))
        own.append((g.turned(g.transposed(then), step), g.product(g.transposed(then), now)))
    (move_a, turn_a), (move_b, turn_b) = own
    angle = F.degrees(g.rotation_angle(g.product(g.transposed(turn_a), turn_b)))
    return rows.select(*by, "i", (F.col("t") - F.col("was_t")).alias("elapsed"), g.norm(g.minus(move_a, move_b)).alias("distance"), angle.alias("angle"))


def time_bins(rows: DataFrame, by: list[str], values: list[str], bins: int = 10) -> DataFrame:
    """by, bin, n and of each value p50, p95 and max, in equal parts of the time from a group's first t to its last."""
    ends = rows.groupBy(*by).agg(F.min("t").alias("t0"), F.max("t").alias("t1")) if by else rows.agg(F.min("t").alias("t0"), F.max("t").alias("t1"))
    placed = (rows.join(ends, by) if by else rows.join(F.broadcast(ends))).withColumn("bin", F.expr(f"cast((t - t0) * {bins} div (t1 - t0 + 1) AS int)"))
    stats = [f(v).alias(f"{v}_{n}") for v in values for n, f in (("p50", lambda c: F.percentile(c, F.lit(0.5))), ("p95", lambda c: F.percentile(c, F.lit(0.95))), ("max", F.max))]
    return placed.groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"), *stats)
