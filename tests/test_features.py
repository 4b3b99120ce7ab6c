"""Feature tables against plain versions, the funnel of events, and conflicts rejected until none is left."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tandem.operators import features, intervals, scopes, sequence


def test_person_features_of_absent_and_present_wrists(spark):
    nan = float("nan")
    rows = [(1, 0, 0.5, 0.5, None, 0.1, True, None, 20.0), (1, 1, 0.8, 0.9, 0.5, 0.5, False, True, nan), (1, 2, nan, 0.9, 0.6, 0.5, None, False, None), (1, 3, 0.1, 0.5, 0.6, 0.5, None, False, 1.0)]
    df = spark.createDataFrame(rows, "g int, frame int, left_u double, left_v double, right_u double, right_v double, left_held boolean, right_held boolean, angle double")
    got = [r.asDict() for r in features.person_features(df, ["g"], 10.0, (0.5, 0.5)).orderBy("frame").collect()]
    assert [round(r["wrist_speed_left"], 6) for r in got] == [0, 5, 0, 0] and [round(r["wrist_speed_right"], 6) for r in got] == [0, 0, 1, 0]
    assert [r["present_left"] for r in got] == [1, 1, 0, 1] and [round(r["radius_left"], 6) for r in got] == [0, 0.5, 0, 0.4]
    assert [round(r["hands_apart"], 6) for r in got] == [0, 0.5, 0, 0.5] and [r["held_left"] for r in got] == [1, 0, 0, 0] and [r["angle_valid"] for r in got] == [1, 0, 0, 1]


def test_proposal_features_look_back_only_and_swap_people(spark):
    rng = np.random.default_rng(1)
    n, d = 40, len(features.PERSON)
    people = {p: rng.random((n, d)) for p in "ab"}
    frame_of = lambda p, upto=n: spark.createDataFrame([(1, k, *map(float, people[p][k])) for k in range(upto)], "g int, frame int, " + ", ".join(f"{c} double" for c in features.PERSON))
    apart = spark.createDataFrame([(1, k, 1.5 if k % 3 else None, 0.4) for k in range(n)], "g int, frame int, head_distance double, wrist_distance double")
    windows = {"1s": 5, "3s": 15}
    out = features.proposal_features(frame_of("a"), frame_of("b"), apart, ["g"], windows)
    assert len(out.columns) == 3 + 175
    rows = {(r["order"], r["frame"]): r for r in out.collect()}
    base = np.concatenate([people["a"], people["b"], [[1.5 if k % 3 else 0.0, 0.4, float(k % 3 > 0)] for k in range(n)]], axis=1)
    names = [*(f"{p}_{c}" for p in "ab" for c in features.PERSON), *features.TOGETHER]
    for k in (0, 3, 39):
        for w, width in windows.items():
            past = np.concatenate([np.repeat(base[:1], max(0, width - k - 1), 0), base[max(0, k + 1 - width) : k + 1]])
            for s, want in (("mean", past.mean(0)), ("std", past.std(0)), ("max", past.max(0))):
                assert [rows["ab", k][f"{c}_{s}_{w}"] for c in names] == pytest.approx(list(want), abs=1e-7)
        assert rows["ba", k]["a_radius_left_std_3s"] == rows["ab", k]["b_radius_left_std_3s"] and rows["ba", k]["head_distance"] == rows["ab", k]["head_distance"]
    cut = {(r["order"], r["frame"]): r for r in features.proposal_features(frame_of("a", 20), frame_of("b", 20), apart, ["g"], windows).collect()}
    assert all(cut[o, k] == rows[o, k] for o in ("ab", "ba") for k in range(20))  # causal


def test_hand_and_gaze_samples_that_are_not_valid_are_zero(spark):
    grid = spark.createDataFrame([(1, 0, f, f * 10) for f in range(5)], "g int, role int, frame int, t long")
    hands = spark.createDataFrame([(1, 0, 0, 0, [1.0, 2.0], 0.5, [3.0, float("nan")], 0.5), (1, 0, 10, 1, [1.0, 2.0], -1.0, [3.0, 4.0], 7.0), (1, 0, 21, 2, [5.0, 6.0], 0.0, None, 0.3)], "g int, role int, t long, idx int, left array<double>, left_conf double, right array<double>, right_conf double")
    got = features.hand_features(grid, hands, ["g", "role"], 5).orderBy("frame").collect()
    assert [r["left_valid"] for r in got] == [True, False, True, False, False] and [r["right_valid"] for r in got] == [False, True, False, False, False]
    assert got[0]["left"] == [1.0, 2.0] and got[1]["left"] == [0.0, 0.0] and got[1]["right_conf"] == 1.0 and got[2]["left_conf"] == 0.0 and got[0]["right"] == [0.0, 0.0]
    gaze = spark.createDataFrame([(1, 0, 0, 0, 0.2, 0.4, 0.1, 50.0), (1, 0, 10, 1, 0.0, 0.0, 0.0, 2.0), (1, 0, 20, 2, None, 0.0, 0.0, 2.0)], "g int, role int, t long, idx int, left_yaw double, right_yaw double, pitch double, depth double")
    got = features.gaze_features(grid, gaze, ["g", "role"], 5).orderBy("frame").collect()
    assert [r["gaze_valid"] for r in got] == [True, True, False, False, False]
    assert got[0]["gaze_x"] == pytest.approx(math.tan(0.3) / math.sqrt(math.tan(0.3) ** 2 + math.tan(0.1) ** 2 + 1)) and got[1]["gaze_z"] == 2.0 and got[1]["look_z"] == 1.0 and got[2]["look_z"] == 0.0


def test_every_event_is_accepted_or_rejected_once_with_its_stage(spark):
    n = 300
    sure = lambda g, f, r: (g, r, f, not (g == 1 and f == 150), 1.0, True, 1.0, not (g == 2 and 10 <= f < 40), True, 0.95, 0.95, 1.0)
    frames = spark.createDataFrame([sure(g, f, r) for g in (1, 2, 3) for f in range(n) for r in (0, 1)], "g int, role int, frame int, verified boolean, map_conf double, pose boolean, residual double, left boolean, right boolean, left_conf double, right_conf double, speed double")
    apart = spark.createDataFrame([(g, f, 0.5) for g in (1, 2, 3) for f in range(n)], "g int, frame int, distance double")
    events = [(1, 1, 10, 20), (1, 2, 148, 152), (1, 3, 100, 110), (1, 4, 55, 60), (1, 5, None, 7), (1, 6, 290, 300), (1, 7, 9, 8), (2, 8, 15, 30), (2, 9, 200, 210), (3, 10, 5, 9), (4, 11, 5, 9)]
    recordings = spark.createDataFrame([(1, True, None), (2, True, None), (3, False, "no calibration")], "g int, valid boolean, problem string")
    out = scopes.assess_events(spark.createDataFrame(events, "g int, iv int, start_frame int, end_frame int"), frames, apart, recordings, ["g"], (120, 90)).collect()
    got = {r["iv"]: r for r in out}
    assert len(out) == len(got) == len(events)
    assert {k: r["stage"] for k, r in got.items()} == {1: None, 2: "event_mapping", 3: "context_mapping", 4: "context_mapping", 5: "annotation_bounds", 6: "annotation_bounds", 7: "annotation_bounds", 8: "tracking_qc", 9: None, 10: "derived_validation", 11: "annotation_bounds"}
    assert got[2]["reason"] == "frame 150 is not verified" and got[8]["reason"] == "event_hands_missing" and got[10]["reason"] == "no calibration"
    assert (got[1]["around"], got[1]["clip_start"], got[1]["clip_end"], got[1]["rank"]) == (120, 0, 140, 1) and got[9]["clip_end"] == n - 1
    narrow = scopes.plan_contexts(spark.createDataFrame([(1, 1, 40, 45)], "g int, iv int, start_frame int, end_frame int"), frames, ["g"], (120, 90)).first()
    assert (narrow["around"], narrow["clip_start"], narrow["clip_end"]) == (90, 0, 135)


def test_conflicts_are_rejected_until_none_is_left(spark):
    rng = random.Random(2)
    series = {k: [rng.choice([None, rng.randrange(30) + 2 * i]) if rng.random() < 0.9 else None for i in range(rng.randrange(1, 40))] for k in range(12)}
    series[99] = list(range(40, 0, -1))
    series[100] = [1, 2, 50, 49, 3, 4]  # 50 and 49 go, then 2 and 3 agree
    df = spark.createDataFrame([(k, f, v) for k, vs in series.items() for f, v in enumerate(vs)], "g int, frame int, v int")
    got = {(r["g"], r["frame"]): r["v"] for r in sequence.reject_nonmonotone(df, ["g"], "v").collect()}
    for k, vs in series.items():
        left = {f: v for f, v in enumerate(vs) if v is not None}
        while True:
            order = sorted(left)
            bad = {x for a, b in zip(order, order[1:]) if left[b] < left[a] for x in (a, b)}
            if not bad:
                break
            left = {f: v for f, v in left.items() if f not in bad}
        assert {f: got[k, f] for f in range(len(vs)) if got[k, f] is not None} == left


def test_extents_come_from_the_data(spark):
    """Nothing ends at 30 days: frames past 719 are masked, turned and cut out like others."""
    grid = spark.createDataFrame([(1, f, f) for f in range(1000)], "g int, frame int, v int")
    events = spark.createDataFrame([(1, 1, 850, 990), (1, 2, 900, 1200)], "g int, iv int, start_frame int, end_frame int")
    assert intervals.interval_mask(grid, events, ["g"]).filter("active").count() == 150
    turned = sequence.circular_shift(grid, ["g"], F.col("g"), 10, ["v"]).collect()
    assert len(turned) == 1000 == len({r["shifted_v"] for r in turned}) and len({(r["shifted_v"] - r["frame"]) % 1000 for r in turned}) == 1
    cut = intervals.excerpts(events, grid, ["g"], 200).orderBy("iv").collect()
    assert [(r["excerpt_from"], r["excerpt_to"]) for r in cut] == [(799, 999), (799, 999)] or cut[1]["excerpt_to"] == 999
    short = sequence.circular_shift(grid.filter("frame < 15"), ["g"], F.col("g"), 10, ["v"]).collect()
    assert all(r["shifted_v"] == r["frame"] for r in short)
