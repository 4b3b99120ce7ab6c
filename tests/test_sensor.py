"""The clock of a sensor: planted offsets and drift found, unrelated signals rejected; the arm at rest and bent."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tandem.operators import sensor

RULE = sensor.ClockRule(most_lag=1.0, step=0.1, n_null=200, least_shift=3.0, least_frames=60, drift_window=60.0, least_window=20.0)


def signals(seed, seconds, offset=0.0, drift=0.0, related=True, rate=10):
    """Frames ten a second, and a sensor turning about one axis at the speed the camera moves; stream = (1 + drift) x own + offset."""
    rng = random.Random(seed)
    speed = [abs(rng.gauss(0, 1)) * (1.5 + math.sin(k / 7)) for k in range(int(seconds * rate) + 40)]
    other = [abs(rng.gauss(0, 1)) for _ in speed]
    frames = [(k / rate, speed[k + 20]) for k in range(int(seconds * rate))]
    samples, angle = [], 0.0
    for k in range(len(speed)):
        own = ((k - 20) / rate - offset) / (1 + drift)
        angle += (speed if related else other)[k] / rate
        samples.append((own, 0.0, 0.0, math.sin(angle / 2), math.cos(angle / 2)))
    return frames, samples


def clocks(spark, cases, rule=RULE):
    frames = spark.createDataFrame([(n, *f) for n, (fs, _) in cases.items() for f in fs], "name string, t double, motion double")
    samples = spark.createDataFrame([(n, *s) for n, (_, ss) in cases.items() for s in ss], "name string, t double, qx double, qy double, qz double, qw double")
    return {r["name"]: r for r in sensor.sensor_clock(frames, samples, ["name"], "name string", 0.35, rule).collect()}


def test_planted_offsets_are_found_and_unrelated_signals_rejected(spark):
    cases = {"early": signals(1, 50, 0.4), "late": signals(2, 50, -0.3), "none": signals(3, 50, related=False), "edge": signals(4, 50, 0.97), "short": signals(5, 5), "drift": signals(6, 75, 0.1, 0.004)}
    cases["still"] = ([(t, 0.0) for t, _ in cases["early"][0]], cases["early"][1])
    got = clocks(spark, cases, sensor.ClockRule(**{**RULE.__dict__, "most_ppm": 5000.0}))
    assert len(got) == 7
    for name, want in (("early", 0.4), ("late", -0.3)):
        r = got[name]
        assert r["status"] == "estimated" and r["offset"] == pytest.approx(want, abs=0.03) and r["r"] > 0.8 and r["p"] == pytest.approx(1 / 201) and r["drift_check"] == "consistent"
    assert got["none"]["status"] == "unsynced" and {"not significant", "low correlation"} & set(got["none"]["reason"]) and got["none"]["drift_check"] == "not run"
    assert got["edge"]["status"] == "unsynced" and "peak at the edge" in got["edge"]["reason"]
    assert got["short"]["reason"] == ["too few frames"] and got["still"]["status"] == "unsynced"
    assert got["drift"]["status"] == "estimated" and got["drift"]["drift_check"] == "drift fitted" and got["drift"]["drift_ppm"] == pytest.approx(4000, rel=0.3)


def test_null_is_the_correlation_with_turned_signals(spark):
    rng = random.Random(7)
    x, y = ([rng.random() for _ in range(40)] for _ in range(2))
    rows = spark.createDataFrame([(1, k, 0, x[k], y[k]) for k in range(40)], "g int, k int, lag int, x double, y double")
    got = sensor.shift_scores(rows, ["g"], "g int", F.lit(5), 4).first()
    corr = lambda a, b: (sum(p * q for p, q in zip(a, b)) / 40 - sum(a) * sum(b) / 1600) / math.sqrt((sum(p * p for p in a) / 40 - (sum(a) / 40) ** 2) * (sum(q * q for q in b) / 40 - (sum(b) / 40) ** 2))
    assert got["r"] == pytest.approx(corr(x, y))
    assert got["null"] == [pytest.approx(corr([x[(k - s) % 40] for k in range(40)], y)) for s in (5, 15, 25, 35)]


def test_the_arm(spark):
    """At rest all sensors look ahead along the scene's z... the y axis of each is turned to it; a quarter turn of the forearm bends the elbow."""
    half = math.sqrt(0.5)
    still = (0.0, 0.0, 0.0, 1.0)
    chest = (half, 0.0, 0.0, half)  # its z axis points along the scene's z, so that there is no heading
    rows = [("rest", s, *(chest if s == "chest" else still)) for s in ("chest", "u", "f", "h")] + [("bent", "chest", *chest), ("bent", "u", *still), ("bent", "f", 0.0, 0.0, half, half)] + [("lost", "u", *still), ("lost", "f", *still), ("lost", "h", *still)]
    df = spark.createDataFrame(rows, "at string, slot string, qx double, qy double, qz double, qw double")
    got = {r["at"]: r for r in sensor.arm_chain(df, ["at"], {"right": ("u", "f", "h")}).collect()}
    assert not got["lost"]["valid"] and got["lost"]["wrist_x"] is None
    rest, bent = got["rest"], got["bent"]
    assert rest["flexion"] == pytest.approx(0, abs=1e-5) and bent["flexion"] == pytest.approx(90, abs=1e-4)
    for r in (rest, bent):
        at = [[r[f"{j}_{c}"] for c in "xyz"] for j in sensor.JOINTS]
        assert at[0] == [0.18, 1.40, 0.0] and math.dist(at[0], at[1]) == pytest.approx(0.30) and math.dist(at[1], at[2]) == pytest.approx(0.26)
    assert rest["hand_valid"] and not bent["hand_valid"] and bent["fingertip_x"] is None and math.dist([rest[f"shoulder_{c}"] for c in "xyz"], [rest[f"fingertip_{c}"] for c in "xyz"]) == pytest.approx(0.66)


def test_heading_is_taken_out(spark):
    """The whole body turned about the upward axis gives the same points."""
    def turned(q, a):  # about the device's z axis, which is up in the scene
        x, y, z, w = q
        s, c = math.sin(a / 2), math.cos(a / 2)
        return (c * x - s * y, c * y + s * x, c * z + s * w, c * w - s * z)

    rng = random.Random(8)
    qs = {}
    for s in ("chest", "u", "f", "h"):
        v = [rng.gauss(0, 1) for _ in range(4)]
        n = math.sqrt(sum(x * x for x in v))
        qs[s] = tuple(x / n for x in v)
    rows = [(str(a), s, *turned(q, a)) for a in (0.0, 1.0, 2.5) for s, q in qs.items()]
    df = spark.createDataFrame(rows, "at string, slot string, qx double, qy double, qz double, qw double")
    got = sensor.arm_chain(df, ["at"], {"left": ("u", "f", "h")}).collect()
    points = [[r[f"{j}_{c}"] for j in sensor.JOINTS for c in "xyz"] for r in got]
    assert len({round(r["yaw"], 6) for r in got}) == 3
    for p in points[1:]:
        assert p == pytest.approx(points[0], abs=1e-9)
