"""As-of joins against known answers and the definition."""

import random

from tandem.operators import align


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_tie_takes_the_earlier_sample_and_the_first_index(spark):
    q = spark.createDataFrame([(1, 10, 0)], "g int, t long, q_idx long")
    s = spark.createDataFrame([(1, 15, 4), (1, 5, 7), (1, 5, 3)], "g int, t long, idx long")
    assert rows(align.asof_nearest(q, s, ["g"], 5), "sample_t", "sample_idx", "residual", "status") == [(5, 3, -5, "matched")]


def test_limit_is_inclusive_and_rejected_rows_keep_their_residual(spark):
    q = spark.createDataFrame([(1, 10, 0), (1, 30, 1), (2, 10, 2), (1, None, 3)], "g int, t long, q_idx long")
    s = spark.createDataFrame([(1, 20, 0)], "g int, t long, idx long")
    got = rows(align.asof_nearest(q, s, ["g"], 10), "q_idx", "residual", "status")
    assert got == [(0, 10, "matched"), (1, -10, "matched"), (2, None, "no_samples"), (3, None, "missing_query")]
    assert rows(align.asof_nearest(q, s, ["g"], 9), "q_idx", "residual", "status")[0] == (0, 10, "gap_exceeded")


def test_two_people_on_their_own_clocks(spark):
    s = spark.createDataFrame([("a", 0, 0), ("a", 1000, 1), ("a", 2000, 2), ("b", 1010, 0), ("b", 2010, 1), ("b", 10, 2), ("b", 3010, 3)], "p string, t long, idx long")
    q = spark.createDataFrame([("a", 1005, 0), ("b", 1005, 0)], "p string, t long, q_idx long")
    assert rows(align.asof_nearest(q, s, ["p"], 10), "p", "sample_idx", "residual") == [("a", 1, -5), ("b", 0, 5)]


def test_nearest_against_brute_force(spark):
    rng = random.Random(5)
    samples = [(rng.randrange(4), rng.choice([None, rng.randrange(60)]), i) for i in range(120)]
    queries = [(rng.randrange(5), rng.randrange(60), i) for i in range(80)]
    got = rows(align.asof_nearest(spark.createDataFrame(queries, "g int, t long, q_idx long"), spark.createDataFrame(samples, "g int, t long, idx long"), ["g"], 3), "q_idx", "sample_idx")
    want = []
    for g, t, i in queries:
        near = sorted((abs(st - t), st, k) for sg, st, k in samples if sg == g and st is not None)
        want.append((i, near[0][2] if near else None))
    assert sorted(got, key=str) == sorted(want, key=str)


def test_backward_looks_back_only(spark):
    """What comes after the cut changes nothing before it."""
    q = spark.createDataFrame([(1, t, t) for t in range(20)], "g int, t long, q_idx long")
    early = [(1, 3, 0), (1, 9, 1)]
    later = [(1, 15, 2), (1, 17, 3)]
    a = rows(align.asof_backward(q, spark.createDataFrame(early, "g int, t long, idx long"), ["g"]).filter("t < 15"), "t", "event_idx", "age")
    b = rows(align.asof_backward(q, spark.createDataFrame(early + later, "g int, t long, idx long"), ["g"]).filter("t < 15"), "t", "event_idx", "age")
    assert a == b and a[3] == (3, 0, 0) and a[2] == (2, None, None)


def test_overlap_statuses(spark):
    s = spark.createDataFrame([(1, 0, 0), (1, 0, 10), (1, 1, 5), (1, 1, 20), (2, 0, 0), (2, 1, 9), (3, 0, 4), (4, 0, 1), (4, 1, None)], "g int, role int, t long")
    got = {r["g"]: r["status"] for r in align.qc_overlap(s, ["g"], "role", 5).collect()}
    assert got == {1: "PASS", 2: "FAIL", 3: "INSUFFICIENT_DATA", 4: "INSUFFICIENT_DATA"}
