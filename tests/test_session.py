"""Handovers, minutes and reports with known answers."""

import re

import pytest
from pyspark.sql import functions as F

from tandem.functions import scalar
from tandem.operators import session
from tandem.operators.intervals import dealt
from tandem.operators.sequence import cross_correlation

TEN = session.SessionRule(fps=10.0, still=0.1, floor=0.05, lead=15, base=30, ahead=60, run=2, lag=20, pad=10, idle=20)


def series(spark, *people, g=1):
    rows = [(g, r, f, None if v is None else float(v)) for r, vs in enumerate(people) for f, v in enumerate(vs)]
    return spark.createDataFrame(rows, "g int, role int, frame int, speed double")


def events(spark, *rows):
    return spark.createDataFrame(list(rows), "g int, iv int, start_frame int, end_frame int, giver int, receiver int")


def distances(spark, values=(), g=1):
    return spark.createDataFrame([(g, f, v) for f, v in enumerate(values)], "g int, frame int, distance double")


def moving(a, b, n=300, speed=1.0):
    return [speed if a <= f < b else 0.0 for f in range(n)]


def test_onset_and_response(spark):
    speed = series(spark, moving(150, 170), moving(156, 176))
    got = {r["iv"]: r for r in session.handover_metrics(events(spark, (1, 1, 150, 180, 0, 1), (1, 2, 150, 180, None, None), (1, 3, 20, 30, None, None)), speed, distances(spark), ["g"], TEN).collect()}
    assert (got[1]["reach_onset"], got[1]["response"], got[1]["basis"]) == (0.0, pytest.approx(0.6), "given")
    assert (got[2]["giver"], got[2]["receiver"], got[2]["basis"]) == (0, 1, "onset_order")  # who reaches first gives
    assert (got[3]["giver"], got[3]["basis"], got[3]["reach_onset"], got[3]["response"]) == (0, "unknown", None, None)
    other = session.handover_metrics(events(spark, (1, 1, 150, 180, 1, 0)), speed, distances(spark), ["g"], TEN).first()
    assert other["reach_onset"] == pytest.approx(0.6) and other["response"] == pytest.approx(-0.6)  # the receiver anticipates
    assert got[1]["synchrony"] == pytest.approx(1.0) and got[1]["synchrony_lag"] == pytest.approx(0.6)


def test_hold_and_transfer(spark):
    """Fast for four frames, still for two seconds, nearest at 2.4 s."""
    giver = [0.0] * 100 + [1.0] * 4 + [0.0] * 196
    near = [0.1 if f == 124 else 0.5 for f in range(300)]
    got = session.handover_metrics(events(spark, (1, 1, 100, 140, 0, 1)), series(spark, giver, moving(105, 120)), distances(spark, near), ["g"], TEN).first()
    assert got["transfer"] == pytest.approx(2.4) and got["min_distance"] == pytest.approx(0.1) and got["hold"] == pytest.approx(2.1)
    blind = session.handover_metrics(events(spark, (1, 1, 100, 140, 0, 1)), series(spark, giver, moving(105, 120)), distances(spark), ["g"], TEN).first()
    assert blind["min_distance"] is None and blind["transfer"] == pytest.approx(0.4) and blind["hold"] == pytest.approx(0.1)


def test_events_are_cut_to_the_recording(spark):
    got = {r["iv"]: r for r in session.handover_metrics(events(spark, (1, 1, -20, 5, None, None), (1, 2, 290, 500, 0, 1), (1, 3, 900, 950, 0, 1)), series(spark, moving(0, 20), moving(280, 300)), distances(spark), ["g"], TEN).collect()}
    assert len(got) == 3 and got[1]["start"] == 0 and got[2]["duration"] == pytest.approx(0.9) and (got[3]["start"], got[3]["duration"]) == (299, 0.0)


def test_idle_needs_two_seconds_in_sight(spark):
    still = [0.0] * 30 + [1.0] * 10 + [0.0] * 10 + [1.0] * 10 + [None] * 25 + [1.0] * 15
    rows = session.idle_frames(series(spark, still), ["g"], TEN).orderBy("frame").collect()
    assert [r["frame"] for r in rows if r["idle"]] == list(range(30))
    report = session.session_report(session.handover_metrics(events(spark, (1, 1, 35, 40, 0, 1)).limit(0), series(spark, still), distances(spark), ["g"], TEN), series(spark, still), ["g"], TEN).first()
    assert report["idle_0"] == pytest.approx(0.3) and report["visible_0"] == pytest.approx(0.75) and report["idle_1"] is None
    assert report["handovers"] == 0 and report["partial"] and report["c_engage"] == pytest.approx(0.7) and report["score"] == pytest.approx(70.0)


def test_the_report_adds_up(spark):
    a, b = moving(150, 170, 1300), moving(156, 176, 1300)
    speed = series(spark, a, b)
    hand = session.handover_metrics(events(spark, (1, 1, 150, 180, 0, 1), (1, 2, 150, 180, 1, 0), (1, 3, 700, 710, 0, 1)), speed, distances(spark), ["g"], TEN)
    r = session.session_report(hand, speed, ["g"], TEN).first()
    assert r["handovers"] == 3 and r["seconds"] == 130 and r["rate"] == pytest.approx(3 / 130 * 60) and r["anticipation"] == 0.5 and r["response"] == pytest.approx(0.0)
    assert r["c_response"] == pytest.approx(1 - 0.6 / 2) and r["c_sync"] == pytest.approx(1.0) and r["synchrony_lag"] == pytest.approx(0.6)
    assert r["score"] == pytest.approx(100 * (r["c_sync"] + r["c_response"] + r["c_hold"] + r["c_engage"]) / 4)
    speech = spark.createDataFrame([(1, 0, f, f < 300) for f in range(1300)], "g int, role int, frame int, speaking boolean")
    minutes = {m["minute"]: m for m in session.session_minutes(hand, speed, speech, ["g"], TEN).collect()}
    assert {k: m["handovers"] for k, m in minutes.items()} == {0: 2, 1: 1, 2: 0} and minutes[0]["speech"] == 0.5 and minutes[2]["idle"] == 1.0 and minutes[0]["visible"] == 1.0


def test_frames_of_handovers_stay_where_they_are_dealt(spark):
    """Frames were shuffled by recording and frame to be joined to each event's, and these again to each lag's."""
    speed = dealt(series(spark, moving(150, 170), moving(156, 176)), ["g"])
    plan = session.handover_metrics(events(spark, (1, 1, 150, 180, 0, 1)), speed, dealt(distances(spark, [0.5] * 300), ["g"]), ["g"], TEN)._jdf.queryExecution().executedPlan().toString()
    assert set(re.findall(r"Exchange hashpartitioning\((\w+?)#", plan)) == {"g"} and not re.search(r"Exchange hashpartitioning\(g#\w+, [a-z]", plan)
    assert plan.count("Join") == 1  # events with what is known of the whole recording


def test_missing_frames_keep_their_place(spark):
    """Frames 105 to 109 and all of the second person's from 130 on are gone; an event without a frame of its own is dropped."""
    speed = series(spark, moving(100, 120), moving(102, 122)).filter("NOT frame BETWEEN 105 AND 109 AND NOT (role = 1 AND frame >= 130)")
    got = {r["iv"]: r for r in session.handover_metrics(events(spark, (1, 1, 100, 125, 0, 1), (1, 2, 105, 109, 0, 1), (2, 3, 100, 125, 0, 1)), speed, distances(spark), ["g"], TEN).collect()}
    assert list(got) == [1] and got[1]["synchrony"] == pytest.approx(1.0) and got[1]["synchrony_lag"] == pytest.approx(0.2)
    assert (got[1]["reach_onset"], got[1]["response"], got[1]["transfer"]) == (0.0, pytest.approx(0.2), pytest.approx(2.0))


def test_best_lag_is_cross_correlation(spark):
    a = [None if f % 7 == 3 else float(f * 37 % 23) for f in range(40)]
    b = [None if f % 11 == 5 else float((f - 3) * 37 % 23 + f % 3) for f in range(40)]
    rows = [(1, a, b), (2, [1.0] * 9, b[:9]), (3, [1.0, None, 2.0], [None, 5.0, 4.0]), (4, [], []), (5, [1.0, 2.0, 4.0, 1.0, 2.0, 4.0, 1.0], [1.0, 2.0, 4.0, 1.0, 2.0, 4.0, 1.0])]
    df = spark.createDataFrame(rows, "g int, a array<double>, b array<double>")
    got = {r["g"]: (r["k"]["r"], r["k"]["lag"]) if r["k"] else (None, None) for r in df.select("g", scalar.best_lag(F.col("a"), F.col("b"), 5, 3).alias("k")).collect()}
    frames = df.select("g", F.posexplode(F.arrays_zip("a", "b")).alias("frame", "v")).select("g", "frame", "v.a", "v.b")
    want = {r["g"]: (r["r"], r["lag"]) for r in cross_correlation(frames, ["g"], "a", "b", 5, 3).collect()}
    assert got.pop(4) == (None, None) and got == {g: (r if r is None else pytest.approx(r), k) for g, (r, k) in want.items()}
    assert got[5][1] == 0 and got[2] == (None, None) and got[1][1] == 3
