"""Known offsets, drifts and turns."""

import math
import random

from tandem.operators import motion


def signal(n, seed=1):
    rng = random.Random(seed)
    out, x = [], 0.0
    for _ in range(n):
        x = 0.6 * x + rng.gauss(0, 1)
        out.append(abs(x))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "g int, frame long, e double")


def test_known_offset(spark):
    x = signal(400)
    ref, sig = frame(spark, [(1, k, v) for k, v in enumerate(x)]), frame(spark, [(1, k, x[k + 7]) for k in range(380)])
    r = motion.audio_offset(ref, sig, ["g"], "e", 20).first()
    assert r["lag"] == 7 and abs(r["offset"] - 7) < 0.6 and r["z"] > 8 and r["second_ratio"] < 0.6
    other = motion.audio_offset(ref, frame(spark, [(1, k, v) for k, v in enumerate(signal(380, 9))]), ["g"], "e", 20).first()
    assert other["r"] < 0.4


def test_known_drift(spark):
    x = signal(1600, 3)
    sig = [(1, k, x[min(1599, round(k * 1.01) + 4)]) for k in range(1500)]
    r = motion.offset_drift(frame(spark, [(1, k, v) for k, v in enumerate(x)]), frame(spark, sig), ["g"], "e", 150, 30, 2.0).first()
    assert abs(r["drift"] - 0.01) < 0.002 and abs(r["offset"] - 4) < 1.5 and r["n_inliers"] >= 6


def test_drift_between_two_windows(spark):
    x = signal(1400, 6)
    sig = [(1, k, x[min(1399, round(k * 1.005) + 6)]) for k in range(1200)]
    r = motion.drift_factor(frame(spark, [(1, k, v) for k, v in enumerate(x)]), frame(spark, sig), ["g"], "e", 120, 20, 15, 400).first()
    assert abs(r["k"] - 1.005) < 0.002 and abs(r["offset_start"] - 6.3) < 1 and r["reason"] is None
    short = motion.drift_factor(frame(spark, [(1, k, v) for k, v in enumerate(x[:300])]), frame(spark, sig[:280]), ["g"], "e", 120, 20, 15, 400).first()
    assert short["k"] is None and short["reason"] == "too_short"


def quat(a):
    return (0.0, 0.0, math.sin(a / 2), math.cos(a / 2))


def test_turning_skips_gaps(spark):
    rows = [(1, t, *quat(a)) for t, a in ((0.0, 0.0), (1.0, 0.2), (2.0, 0.2), (9.0, 1.5), (10.0, 1.6))]
    df = spark.createDataFrame(rows, "g int, t double, qx double, qy double, qz double, qw double")
    assert [round(r["path"], 6) for r in motion.angular_path(df, ["g"], 2.0).orderBy("t").collect()] == [0, 0.2, 0.2, 0.2, 0.3]


def test_a_turn_that_holds_a_gap_adds_nothing(spark):
    rows = [(1, t, *quat(a)) for t, a in ((0.0, 0.0), (1.0, 0.2), (9.0, 0.2), (10.0, 0.5), (11.0, 0.5), (12.0, 0.7))]
    df = spark.createDataFrame(rows, "g int, t double, qx double, qy double, qz double, qw double")
    got = motion.angular_path(df, ["g"], 2.0).orderBy("t").collect()
    assert [round(r["path"], 6) for r in got] == [0, 0.2, 0.2, 0.2, 0.3, 0.4] and [r["valid"] for r in got] == [0, 1, 1, 2, 3, 4]
    asked = spark.createDataFrame([(1, 1, 10.0, 12.0), (1, 2, 0.5, 3.0), (1, 3, 11.5, 13.0), (1, 4, 0.0, 0.5)], "g int, id int, start double, end double")
    speed = {r["id"]: r["speed"] for r in motion.interval_speed(motion.angular_path(df, ["g"], 2.0), asked, ["g"]).collect()}
    assert abs(speed[1] - 0.1) < 1e-9 and abs(speed[4] - 0.2) < 1e-9 and speed[2] is None and speed[3] is None


def test_the_parabola_takes_the_very_next_lags_only(spark):
    x = signal(60, 5)
    ref, sig = frame(spark, [(1, k, v) for k, v in enumerate(x)]), frame(spark, [(1, k, x[k + 20]) for k in range(40)])
    r = motion.audio_offset(ref, sig, ["g"], "e", 20, 40).first()  # lag 20 alone has a lag before it, none after
    assert r["lag"] == 20 and r["offset"] == 20


def test_slerp_between_samples_only(spark):
    rows = [(1, t, *quat(a)) for t, a in ((0.0, 0.0), (1.0, 1.0), (9.0, 2.0))]
    df = spark.createDataFrame(rows, "g int, t double, qx double, qy double, qz double, qw double")
    asked = spark.createDataFrame([(1, t) for t in (-1.0, 0.25, 1.0, 5.0, 10.0)], "g int, t double")
    got = {r["t"]: r["qz"] for r in motion.slerp_at(df, asked, ["g"], 2.0).collect()}
    assert abs(got[0.25] - math.sin(0.125)) < 1e-9 and abs(got[1.0] - math.sin(0.5)) < 1e-9
    assert got[-1.0] is None and got[5.0] is None and got[10.0] is None
