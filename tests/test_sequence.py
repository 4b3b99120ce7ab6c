"""Frames, intervals and boxes against known answers."""

from tandem.operators import boxes, evaluate, intervals, sequence


def series(spark, values):
    return spark.createDataFrame([(1, k, v) for k, v in enumerate(values)], "g int, frame int, x double")


def test_causal_windows_do_not_see_the_future(spark):
    values = [float(v) for v in (3, 1, 4, 1, 5, 9, 2, 6, 5, 3)]
    changed = values[:6] + [100.0, -7.0, 50.0, 0.0]
    pick = lambda v: [tuple(r) for r in sequence.causal_stats(series(spark, v), ["g"], "x", 4).filter("frame < 6").orderBy("frame").collect()]
    assert pick(values) == pick(changed)
    first = sequence.causal_stats(series(spark, values), ["g"], "x", 4).orderBy("frame").first()
    assert (first["x_mean"], first["x_std"]) == (3.0, 0.0)


def test_runs_need_length_and_bridge_gaps(spark):
    flags = [1, 1, 0, 1, 0, 0, 0, 1, 1, 1]
    df = spark.createDataFrame([(1, k, bool(f)) for k, f in enumerate(flags)], "g int, frame int, on boolean")
    got = lambda *a: [(r["start"], r["end"]) for r in intervals.runs(df, ["g"], "on", *a).orderBy("start").collect()]
    assert got(3) == [(7, 9)]
    assert got(3, 1) == [(0, 3), (7, 9)]


def test_onset_is_strictly_later(spark):
    df = spark.createDataFrame([(1, k, k == 3) for k in range(6)], "g int, frame int, onset boolean")
    got = [r["onset_2"] for r in sequence.onset_within(df, ["g"], "onset", [2]).orderBy("frame").collect()]
    assert got == [False, True, True, False, False, False]


def test_correlation_finds_a_known_lag(spark):
    import math

    a = [math.sin(k * k / 7) for k in range(60)]
    df = spark.createDataFrame([(1, k, a[k], a[k - 4] if k >= 4 else None) for k in range(60)], "g int, frame int, a double, b double")
    r = sequence.cross_correlation(df, ["g"], "a", "b", 8, 10).first()
    assert r["lag"] == 4 and round(r["r"], 6) == 1.0
    flat = spark.createDataFrame([(1, k, 1.0, float(k)) for k in range(20)], "g int, frame int, a double, b double")
    assert sequence.cross_correlation(flat, ["g"], "a", "b", 2, 5).first()["r"] is None


def test_sessions_by_gap(spark):
    df = spark.createDataFrame([(1, 0, 0, 100), (1, 1, 280, 300), (1, 2, 1920, 2000), (1, 3, None, None)], "camera int, chunk int, start long, end long")
    assert [r["session"] for r in intervals.sessions(df, ["camera"], 600).orderBy("chunk").collect()] == [0, 0, 1, 1]


def test_release_comes_before_a_grasp_at_the_same_time(spark):
    e = [(1, 0, "grasp", 1), (1, 5, "grasp", 2), (1, 5, "release", 3)]
    got = intervals.hold_spans(spark.createDataFrame(e, "p int, t long, kind string, event_id int"), ["p"]).orderBy("start").collect()
    assert [(r["start"], r["end"], r["state"]) for r in got] == [(0, 5, "closed"), (5, None, "open")]


def test_nms_is_greedy(spark):
    b = [(1, 1, 0.9, 0.0, 0.0, 10.0, 10.0), (1, 2, 0.8, 0.0, 1.0, 10.0, 11.0), (1, 3, 0.7, 20.0, 0.0, 30.0, 10.0), (1, 4, 0.6, 0.0, 4.0, 10.0, 14.0)]
    df = spark.createDataFrame(b, "frame int, slot int, conf double, x0 double, y0 double, x1 double, y1 double")
    assert sorted(r["slot"] for r in boxes.nms(df, ["frame"], 0.5).collect()) == [1, 3, 4]


def test_auroc_counts_ties_half(spark):
    df = spark.createDataFrame([("a", 1, 2.0), ("a", 0, 2.0), ("a", 0, 1.0), ("b", 1, 1.0)], "g string, y int, score double")
    assert {r["g"]: r["auroc"] for r in evaluate.auroc(df, ["g"]).collect()} == {"a": 0.75, "b": None}


def test_bootstrap_brackets_the_mean(spark):
    df = spark.createDataFrame([(k, 0.1 + (k % 5) / 100) for k in range(60)], "unit int, d double")
    r = evaluate.paired_bootstrap(df, "d", 300, 3).first()
    assert r["low"] < r["mean"] < r["high"] and r["p_positive"] == 1.0
