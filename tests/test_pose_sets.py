"""Means with outliers, tags by brute force over cameras, motion without a frame, gates of triangulation, thresholds by events."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tandem.operators import evaluate, fits, pose_sets

NAMES = "x double, y double, z double, qx double, qy double, qz double, qw double"


def quaternion(axis, degrees):
    a = np.asarray(axis, float)
    a = a / np.linalg.norm(a)
    h = math.radians(degrees) / 2
    return (*map(float, a * math.sin(h)), math.cos(h))


def matrix(q):
    x, y, z, w = q
    return np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)], [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)], [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]])


def angle(a, b):
    return math.degrees(math.acos(max(-1, min(1, (np.trace(a.T @ b) - 1) / 2))))


def test_outliers_are_left_out_of_the_mean(spark):
    rng = random.Random(1)
    near = [(1, k, rng.gauss(1, 0.004), 2.0, 3.0, *quaternion((1, 2, 3), 40 + rng.gauss(0, 1))) for k in range(7)]
    far = [(1, 7, 1.5, 2.0, 3.0, *quaternion((1, 2, 3), 40)), (1, 8, 1.0, 2.0, 3.0, *quaternion((1, 2, 3), 80)), (2, 0, 0.0, 0.0, 0.0, *quaternion((0, 0, 1), 10))]
    flipped = [(*r[:5], *(-c for c in r[5:])) if r[1] % 2 else r for r in near]  # q and -q are one rotation
    df = spark.createDataFrame(flipped + far, f"g int, id int, {NAMES}")
    mask = {(r["g"], r["id"]): r["inlier"] for r in pose_sets.inliers(df, ["g"], (0.05, 10.0)).collect()}
    assert [mask[1, k] for k in range(9)] == [True] * 7 + [False] * 2 and mask[2, 0]
    got = {r["g"]: r for r in pose_sets.mean_pose(df, ["g"], "g int", (0.05, 10.0)).collect()}
    assert (got[1]["n"], got[1]["n_in"]) == (9, 7) and got[1]["x"] == pytest.approx(np.mean([r[2] for r in near]))
    turn = np.array([got[1][c] for c in pose_sets.ROTATION]).reshape(3, 3)
    u, _, vt = np.linalg.svd(sum(matrix(r[5:]) for r in near))
    assert turn == pytest.approx(u @ np.diag([1, 1, np.linalg.det(u @ vt)]) @ vt)
    weighted = df.withColumn("weight", F.when((F.col("g") == 1) & (F.col("id") == 3), 1.0).when(F.col("g") == 1, 0.0).otherwise(2.0))
    only = {r["g"]: r for r in pose_sets.mean_pose(weighted, ["g"], "g int").collect()}
    assert only[1]["n_in"] == 1 and only[1]["x"] == pytest.approx(near[3][2])


def plain_tags(seen, tolerance):
    """Every solution of every camera tried as the centre of a set, frame after frame."""
    out, before = {}, None
    for frame in sorted({s[0] for s in seen}):
        now = sorted(s for s in seen if s[0] == frame)
        cameras = sorted({s[1] for s in now})
        best = None
        for _, camera, k, err, pose in now:
            members = [pose]
            for other in cameras:
                if other != camera:
                    cost = lambda p: (round(math.dist(p[0], pose[0]) / tolerance[0] + angle(p[1], pose[1]) / tolerance[1], 7))
                    members.append(min((s[4] for s in now if s[1] == other), key=cost))
            members = [p for p in members if math.dist(p[0], pose[0]) <= tolerance[0] and angle(p[1], pose[1]) <= tolerance[1]]
            turn = -round(angle(before, pose[1]), 6) if before is not None and len(cameras) == 1 else 0
            key = (len(members), turn, -err, -k, -camera)
            if best is None or key > best[0]:
                best = (key, members)
        u, _, vt = np.linalg.svd(sum(p[1] for p in best[1]))
        before = u @ np.diag([1, 1, np.linalg.det(u @ vt)]) @ vt
        out[frame] = (len(best[1]), np.mean([p[0] for p in best[1]], axis=0), before)
    return out


def test_tags_as_by_trying_every_camera(spark):
    rng = random.Random(2)
    for case in range(3):
        rows, seen = [], []
        for frame in range(15):
            true = (np.array([0.1 * frame, 0.0, 1.0]), quaternion((0, 1, 0), 8 * frame))
            for camera in range(rng.choice([1, 1, 2, 4])):
                for k in range(rng.choice([1, 2])):
                    wrong = k == rng.randrange(2) or rng.random() < 0.2
                    at = true[0] + np.array([rng.gauss(0, 0.01) for _ in range(3)]) + (0.3 if wrong and rng.random() < 0.5 else 0)
                    q = quaternion((0, 1, 0), 8 * frame + rng.gauss(0, 2) + (50 if wrong else 0))
                    err = rng.randrange(5) / 10
                    rows.append((1, frame, camera, k, err, *map(float, at), *q))
                    seen.append((frame, camera, k, err, (tuple(at), matrix(q))))
        df = spark.createDataFrame(rows, f"tag int, frame long, camera int, k int, err double, {NAMES}")
        want = plain_tags(seen, (0.05, 10.0))
        got = {r["frame"]: r for r in pose_sets.fuse_tags(df, ["tag"], "tag int").collect()}
        assert set(got) == set(want)
        for frame, (n, at, turn) in want.items():
            r = got[frame]
            assert r["n"] == n and [r[c] for c in "xyz"] == pytest.approx(list(at)) and [r[c] for c in pose_sets.ROTATION] == pytest.approx(list(turn.ravel()), abs=1e-6), (case, frame)
        smooth = {r["frame"]: r for r in pose_sets.fuse_tags(df, ["tag"], "tag int", window=3).collect()}
        assert smooth[7]["x"] == pytest.approx(np.median([want[f][1][0] for f in (6, 7, 8)]))


def test_motion_needs_no_common_frame(spark):
    """b is a seen from another world, with a kick at pair 20."""
    rng = random.Random(3)
    other, shift = matrix(quaternion((1, 1, 0), 70)), np.array([5.0, -2.0, 9.0])
    turn = quaternion((1, 1, 0), 70)

    def times(a, b):
        x1, y1, z1, w1 = a
        x2, y2, z2, w2 = b
        return (w1 * x2 + x1 * w2 + y1 * z2 - z1 * y2, w1 * y2 - x1 * z2 + y1 * w2 + z1 * x2, w1 * z2 + x1 * y2 - y1 * x2 + z1 * w2, w1 * w2 - x1 * x2 - y1 * y2 - z1 * z2)

    rows = []
    for i in range(40):
        p, q = np.array([rng.random() for _ in range(3)]), quaternion([rng.random() for _ in range(3)], rng.uniform(0, 90))
        b = other @ p + shift + (np.array([0.0, 0.3, 0.4]) if i >= 20 else 0)
        rows.append((1, i, i * 100, *map(float, p), *q, *map(float, b), *times(turn, q)))
    schema = "g int, i int, t long, " + ", ".join(f"{p}_{c} double" for p in "ab" for c in pose_sets.POSE)
    got = {r["i"]: r for r in pose_sets.relative_motion(spark.createDataFrame(rows, schema), ["g"], 2).collect()}
    assert set(got) == set(range(2, 40)) and all(r["elapsed"] == 200 and r["angle"] < 1e-4 for r in got.values())
    assert all(r["distance"] == pytest.approx(0.5 if i in (20, 21) else 0.0, abs=1e-6) for i, r in got.items())
    bins = pose_sets.time_bins(spark.createDataFrame([(1, r["i"] * 100, r["distance"]) for r in got.values()], "g int, t long, d double"), ["g"], ["d"]).collect()
    assert sorted(r["bin"] for r in bins) == list(range(10)) and sum(r["n"] for r in bins) == 38


def test_a_far_origin_does_not_spoil_a_fit(spark):
    rng = random.Random(4)
    r, t = matrix(quaternion((1, 2, -1), 33)), np.array([4e6, -3e6, 5e6])
    points = [np.array([6e6, 1e6, -2e6]) + [rng.random() for _ in range(3)] for _ in range(60)]
    df = spark.createDataFrame([(*map(float, p), *map(float, r @ p + t)) for p in points], "ax double, ay double, az double, bx double, by double, bz double")
    fit = fits.fit_rigid(df)
    assert fit["rotation"] == pytest.approx(r, abs=1e-6) and df.agg(F.max(fits.residual(fit))).first()[0] < 1e-4
    assert fits.scale_diagnostic(df.withColumns({c: F.col(c) * 1.25 for c in ("bx", "by", "bz")}), fit["rotation"]) == pytest.approx(1.25, abs=1e-6)
    assert fits.scale_diagnostic(df.limit(1), fit["rotation"]) is None and fits.fit_rigid(df.limit(0)) is None


def test_gates_of_triangulation(spark):
    rays = [("ok", 0, 0, 0, 0, 0, 1, 1.0), ("ok", 2, 0, 0, -2, 0, 4, 2.0), ("ok", 9, 9, 9, 1, 0, 0, 0.0), ("behind", 0, 0, 0, 0, 0, -1, 1.0), ("behind", 2, 0, 0, -2, 0, 4, 1.0), ("far", 0, 0, 0, 0, 0, 1, 1.0), ("far", 2, 0, 0, -2, 0, 90, 1.0), ("one", 0, 0, 0, 0, 0, 1, 1.0)]
    df = spark.createDataFrame([(r[0], *map(float, r[1:])) for r in rays], "g string, ox double, oy double, oz double, dx double, dy double, dz double, weight double")
    free = {r["g"]: r for r in fits.triangulate(df, ["g"]).collect()}
    assert [free["ok"][c] for c in ("n", "x", "y", "z")] == pytest.approx([2, 0, 0, 4]) and free["behind"]["z"] == pytest.approx(4) and free["one"]["x"] is None
    got = {r["g"]: r["z"] for r in fits.triangulate(df, ["g"], 0.1, 50.0, 5.0).collect()}
    assert got["ok"] == pytest.approx(4) and got["behind"] is None and got["far"] is None and got["one"] is None
    assert {r["g"]: r["z"] for r in fits.triangulate(df, ["g"], least_angle=30.0).collect()}["ok"] is None


def test_quantiles_are_exact(spark):
    rng = random.Random(5)
    for values in ([rng.random() for _ in range(500)], [rng.choice([1.0, 2.0, 50.0]) for _ in range(77)], [3.0], [-5.0, 5.0]):
        df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
        got = {r["share"]: r["value"] for r in evaluate.quantiles(df, "v", (0.0, 0.25, 0.9, 0.995, 1.0), bins=16).collect()}
        assert got == {q: pytest.approx(np.quantile(values, q)) for q in (0.0, 0.25, 0.9, 0.995, 1.0)}
    assert evaluate.quantiles(df.limit(0), "v", (0.5,)).collect() == []


def test_thresholds_by_precision_or_else_by_events(spark):
    rows = [(1, f, p, y) for f, (p, y) in enumerate([(0.1, 0)] * 20 + [(0.9, 1)] * 5 + [(0.2, 0)] * 20 + [(0.8, 1)] * 5 + [(0.1, 0)] * 10)]
    scores = spark.createDataFrame(rows, "g int, frame long, p double, y int")
    truth = spark.createDataFrame([(1, 1, 20, 24), (1, 2, 45, 49)], "g int, id long, start long, end long")
    first = evaluate.choose_thresholds(scores, truth, ["g"], 0.9, 2, 3, 1).first()
    assert (first["rule"], first["high"], first["low"]) == ("precision", 0.8, pytest.approx(0.48))
    worse = scores.withColumn("y", F.lit(0))
    other = evaluate.choose_thresholds(worse, truth, ["g"], 0.9, 2, 3, 1).first()
    assert other["rule"] == "event_f1" and other["f1"] == 1.0 and other["recall"] == 1.0 and 0.2 <= other["high"] < 0.8
