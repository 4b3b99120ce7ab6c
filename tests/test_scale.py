"""What must hold on large tables, shown on small ones: no window that starts anew at each row, and no sum that overflows."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tandem.operators import align, identity, motion, scopes, sensor, sequence
from tandem.operators import proposals as pr
from tandem.operators import text as tx
from tandem.plans import registry
from tandem.sources import fixtures as fx

DOUBLES = ", ".join(f"{c} double" for c in ("qx", "qy", "qz", "qw"))


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_no_window_reaches_to_the_end(spark):
    """Spark adds a frame up to the last row anew for each row, which is square in a series."""
    s = spark.createDataFrame([(1, k, k, float(k)) for k in range(9)], "g int, t long, idx long, v double")
    q = spark.createDataFrame([(1, k, k % 3) for k in range(5)], "g int, t long, n int")
    turns = spark.createDataFrame([(1, float(k), 0.0, 0.0, 0.0, 1.0) for k in range(5)], f"g int, t double, {DOUBLES}")
    f = s.withColumn("frame", F.col("t"))
    asked = turns.selectExpr("g", "t AS id", "t AS start", "t + 1 AS end")
    flags = f.selectExpr("g", "frame", "v > 3 AS verified", "v > 5 AS on")
    events = spark.createDataFrame([(1, 1, 2, 3)], "g int, iv int, start_frame int, end_frame int")
    made = [
        align.asof_nearest(q, s, ["g"], 2), align.borrow_nearest(q.withColumn("n", F.expr("nullif(n, 1)")), ["g"], "n", 2), sequence.time_to_next(flags, ["g"], "on", 4), sequence.nonmonotone(f, ["g"], "v"),
        motion.interval_speed(motion.angular_path(turns, ["g"], 2.0), asked, ["g"]), motion.slerp_at(turns, turns.select("g", "t"), ["g"], 2.0),
        scopes.plan_contexts(events, flags, ["g"], (2, 1)),
    ]
    assert not [p for p in map(plan_of, made) if "unboundedfollowing" in p.lower()]


def test_repeated_tracks_divide_by_nothing(spark):
    rows = [(0, "a", 1, 1, 0.0), (0, "a", 1, 1, 1.0), (0, "b", 1, 2, 0.0)]
    out = pr.view_cooccurrence(spark.createDataFrame(rows, "g int, stream string, frame int, track int, x double"), ["g"], "a", "b", 1)
    assert [(r["n"], r["ratio"]) for r in out.collect()] == [(2, float("inf"))]


def test_a_lead_of_just_the_margin_counts(spark):
    energy = spark.createDataFrame([(1, p, k, e) for p, es in (("a", (21.0, 30.0, 30.0)), ("b", (20.0, 30.0, 30.0))) for k, e in enumerate(es)], "g int, person string, bin long, energy double")
    out = tx.attribute_speaker(spark.createDataFrame([(1, 1, 0, 0)], "g int, id int, start_bin long, end_bin long"), energy, ["g"], 1.05)
    assert out.first()["speaker"] == "a"


def test_rows_of_one_slot_are_one_box_in_any_order(spark):
    rows = [(1, 5, 0.0, 0.0, 10.0, 10.0, 0.9, "cup"), (1, 5, 0.0, 0.0, 10.0, 10.0, 0.9, "box"), (1, 5, 0.0, 0.0, 10.0, 10.0, 0.4, "tin")]
    points = spark.createDataFrame([(1, 0, 5.0, 5.0)] * 3, "frame int, hand int, x double, y double")
    gaze = spark.createDataFrame([(1, 5.0, 5.0)], "frame int, x double, y double")
    for order in (rows, rows[::-1]):
        boxes = spark.createDataFrame(order, "frame int, slot int, x0 double, y0 double, x1 double, y1 double, conf double, cat string").coalesce(1)
        r = pr.object_association(points, gaze, boxes, ["frame"]).first()
        assert (r["held_0"], r["gazed"]) == ("cup", "box")


@pytest.mark.parametrize("noise", [0.0, 1e-16, -1e-16])
def test_lags_that_are_equal_but_for_noise(spark, noise):
    curve = {-5: 0.3 + noise, -4: 0.3, -3: 0.0, -2: 0.1, -1: 0.0, 0: -0.5, 1: 0.9, 2: -0.5}
    scores = spark.createDataFrame([(1, k, 30, r, [0.1, 0.2]) for k, r in curve.items()], "g int, lag int, n int, r double, null array<double>")
    assert sensor.lag_test(scores, ["g"]).first()["peak_ratio"] == pytest.approx(3.0)


def test_time_of_a_long_series_fits(spark, tmp_path):
    rows = spark.range(4400).selectExpr("id AS vec_id", "1 AS label", "transform(sequence(1, 64), k -> cast(cos(id * k) AS float)) AS embedding")
    rows.write.parquet(f"{tmp_path}/embeddings.parquet")
    assert registry.queries()["continuity"](spark, str(tmp_path)).count() == 4399
    assert registry.queries()["qc_continuity"](spark, str(tmp_path)).first()["n_samples"] == 4400
    assert registry.queries()["camera_pose"](spark, str(tmp_path)).count() == 1100


def events_of(spark, folder, rows):
    df = spark.createDataFrame(rows, "event_id long, user_id long, hour int, value double, event_type string")
    df.selectExpr("event_id", "timestampadd(HOUR, hour, TIMESTAMP_NTZ '2024-01-01 00:00:01') AS ts", "user_id", "event_type", "value", "'{}' AS props").coalesce(1).write.parquet(f"{folder}/events.parquet")


def test_sums_of_a_frame_do_not_show_their_order(spark, tmp_path):
    events_of(spark, tmp_path, [(k, 0, 0, v, "view") for k, v in enumerate([0.1] * 10)])
    assert fx.frames(spark, str(tmp_path)).filter("n > 0").first()["val"] == 1.0


@pytest.mark.parametrize("name", ["merged_intervals", "sparse_reads"])
def test_equal_intervals_are_joined_alike_in_sql(spark, tmp_path, name):
    events_of(spark, tmp_path, [(k, k % 40, k * 7919 % 150 * 4, 1.0, "purchase") for k in range(20_000)])
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    got = registry.queries()[name](spark, str(tmp_path))
    cur = con.execute(registry.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    assert sorted(tuple(r) for r in got.select(*cols).collect()) == sorted(cur.fetchall())


def test_the_first_of_utterances_that_end_together(spark, tmp_path):
    turns = [(1, 1, "user", " ".join("a" * 152)), (1, 2, "user", "a a"), (1, 3, "user", "a")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    got = {r["turn"]: r["last_turn"] for r in registry.queries()["last_utterance"](spark, str(tmp_path)).collect()}
    assert got == {1: None, 2: None, 3: 1} == {r[1]: r[2] for r in con.execute(registry.oracle_sql()["last_utterance"]).fetchall()}


def test_few_columns_are_assigned_like_many_and_boxes_meet_all_at_once():
    rng = np.random.default_rng(3)
    for _ in range(300):
        n, m = sorted(rng.integers(1, 12, 2))
        cost = np.round(rng.random((n, m)), rng.integers(0, 4))
        assert identity._owners_of_few(cost.tolist(), m)[:m] == list(identity._owners(cost))[:m]
    a, b = (np.sort(rng.integers(0, 9, (k, 4)).astype(float), 1) for k in (5, 7))
    assert identity.overlaps(a, b).tolist() == [[identity.overlap(x, y) for y in b] for x in a]
    looks = [None, np.zeros(3), *rng.random((4, 3))]
    assert identity.looks_all_apart(looks, looks[1:]).tolist() == [[identity.looks_apart(x, y) for y in looks[1:]] for x in looks]
