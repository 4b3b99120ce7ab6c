"""Fits find known transforms, points and lines."""

import numpy as np

from tandem.operators import fits


def turn(axis, angle):
    k = np.array([[0, -axis[2], axis[1]], [axis[2], 0, -axis[0]], [-axis[1], axis[0], 0]])
    return np.eye(3) + np.sin(angle) * k + (1 - np.cos(angle)) * k @ k


def pairs(spark, r, t, s, outliers=0):
    rng = np.random.default_rng(1)
    a = rng.normal(size=(60, 3))
    b = s * a @ r.T + t
    b[:outliers] += 5
    return spark.createDataFrame([(i, *map(float, x), *map(float, y)) for i, (x, y) in enumerate(zip(a, b, strict=True))], "i int, ax double, ay double, az double, bx double, by double, bz double")


def test_similarity(spark):
    r, t = turn(np.array([0, 0.6, 0.8]), 1.1), np.array([1.0, -2, 3])
    f = fits.fit_rigid(pairs(spark, r, t, 2.5), with_scale=True)
    assert np.allclose(f["rotation"], r) and np.allclose(f["translation"], t) and abs(f["scale"] - 2.5) < 1e-9


def test_undetermined_rotations_are_not_guessed(spark):
    line = [(i, float(i), 2.0 * i, 0.0, float(i), 0.0, 0.0) for i in range(9)]
    schema = "i int, ax double, ay double, az double, bx double, by double, bz double"
    assert fits.fit_rigid(spark.createDataFrame(line, schema)) is None
    assert fits.fit_rigid(pairs(spark, np.eye(3), np.zeros(3), 1.0).limit(2)) is None
    flat = [(i, float(i % 3), float(i // 3), 0.0, float(i // 3), float(i % 3), 0.0) for i in range(9)]
    r = fits.fit_rigid(spark.createDataFrame(flat, schema))["rotation"]
    assert np.isclose(np.linalg.det(r), 1) and np.allclose(r @ r.T, np.eye(3))


def test_outliers_are_weighed_down(spark):
    r, t = turn(np.array([1.0, 0, 0]), 0.4), np.array([0.5, 0, 0])
    df = pairs(spark, r, t, 1.0, outliers=6)
    assert np.abs(fits.fit_rigid(df, rounds=20, huber=0.01)["rotation"] - r).max() < 0.01
    study = {x["held_out"]: x["n"] for x in fits.alignment_study(df, "i", 0.01).collect()}
    assert study == {True: 12, False: 48}


def test_mean_rotation(spark):
    q = [(1, 0.0, 0.0, float(np.sin(a / 2)), float(np.cos(a / 2))) for a in (0.1, 0.3)]
    m = fits.mean_rotation(spark.createDataFrame(q, "g int, qx double, qy double, qz double, qw double"), ["g"], "g int").first()
    assert np.allclose([m["r00"], m["r10"]], [np.cos(0.2), np.sin(0.2)])


def test_triangulation(spark):
    p = np.array([0.3, -0.2, 4.0])
    rows = []
    for o in ([0, 0, 0], [1, 0, 0], [0, 1, 0.5]):
        rows.append((1, *map(float, o), *map(float, p - np.array(o))))
    rows += [(2, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0), (3, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0), (3, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0)]
    got = {r["g"]: r for r in fits.triangulate(spark.createDataFrame(rows, "g int, ox double, oy double, oz double, dx double, dy double, dz double"), ["g"]).collect()}
    assert np.allclose([got[1][c] for c in "xyz"], p) and got[2]["x"] is None and got[3]["x"] is None


def test_inverse_depth_and_median(spark):
    rows = [(1, i, float(i), 1 / (0.5 * i + 0.2)) for i in range(8)] + [(1, 9, 3.0, 0.1)]
    r = fits.fit_inverse_depth(spark.createDataFrame(rows, "g int, i int, d double, z double"), ["g"], 0.01).first()
    assert abs(r["a"] - 0.5) < 1e-9 and abs(r["b"] - 0.2) < 1e-9 and r["n"] == 8
    px = spark.createDataFrame([(0, 1.0, False), (0, 3.0, False), (0, 99.0, True), (1, 5.0, True)], "p int, v double, m boolean")
    assert {x["p"]: x["median"] for x in fits.masked_median(px, ["p"], "v", "m", 2).collect()} == {0: 2.0, 1: None}
