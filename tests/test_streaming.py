"""Streams give the rows of their batch forms."""

import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from tandem.operators import align, bookkeeping, folds
from tandem.streaming import jobs


@pytest.fixture()
def events(spark, tmp_path):
    rng = random.Random(1)
    rows = [(k, rng.randrange(3), rng.randrange(4000), float(rng.randrange(9))) for k in range(300)]
    df = spark.createDataFrame(rows, "id long, key long, s long, value double").withColumn("ts", F.timestamp_seconds("s"))
    for k in range(3):
        df.filter(F.col("s").between(k * 1400, k * 1400 + 1399)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    return df


def run(stream, path, mode="append", how=None):
    w = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{path}/cp").outputMode(mode)
    q = w.foreachBatch(how).start() if how else w.format("parquet").option("path", f"{path}/out").start()
    q.awaitTermination()
    return None if how else stream.sparkSession.read.parquet(f"{path}/out")


def source(spark, df, path):
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize(
    ("job", "args", "size"), [(jobs.tumbling, ("60 seconds",), 60), (jobs.sliding, ("120 seconds", "60 seconds"), 120), (jobs.sessions, ("90 seconds",), None)]
)
def test_windows_equal_batch(spark, events, tmp_path, job, args, size):
    got = set(rows(run(job(source(spark, events, tmp_path), "key", *args, "10 minutes"), tmp_path)))
    batch = rows(job(events, "key", *args, "10 minutes"))
    passed = events.agg(F.max("ts")).first()[0] - timedelta(minutes=10)
    done = {r for r in batch if (r[2] if size is None else r[1] + timedelta(seconds=size)) < passed}
    assert len(done) > 10 and done <= got <= set(batch)


STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def test_nearest_gives_every_query_once_as_in_batch(spark, tmp_path):
    """Rows arrive shuffled over four batches, queries before and after their samples, some with none in reach."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    rng = random.Random(2)
    q = [(k, k % 2, rng.randrange(1000)) for k in range(60)]
    x = [(k, k % 2, rng.randrange(1000) // 7 * 7) for k in range(60)]
    rows_of = [(b, *r) for r in [(k, t, q_id, None) for q_id, k, t in q] + [(k, t, None, s_id) for s_id, k, t in x] for b in [rng.randrange(4)]]
    rows_of += [(4, key, 10_000, None, 999 + key) for key in (0, 1)] + [(5, 0, 20_000, None, 1001)]  # what moves the watermark past all
    df = spark.createDataFrame(rows_of, "b int, key long, s long, q_id long, s_id long").withColumn("ts", F.timestamp_seconds("s"))
    for b in range(6):
        df.filter(F.col("b") == b).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = source(spark, df, tmp_path)
    got = run(jobs.nearest(stream.filter("q_id IS NOT NULL"), stream.filter("s_id IS NOT NULL"), "key", 10_000, "1 hour"), tmp_path).collect()
    queries = spark.createDataFrame([(k, key, t * 1_000_000) for k, key, t in q], "q_id long, key long, t long")
    samples = spark.createDataFrame([(k, key, t * 1_000_000) for k, key, t in x], "idx long, key long, t long")
    want = {r["q_id"]: (r["sample_idx"], r["gap"], "matched") if r["status"] == "matched" else (None, None, "unmatched") for r in align.asof_nearest(queries, samples, ["key"], 10_000_000).collect()}
    assert len(got) == 60 and {r["q_id"]: (r["s_id"], r["gap"], r["status"]) for r in got} == want and len({s for *_, s in want.values()}) == 2


def test_streamed_hysteresis_equals_batch(spark, tmp_path):
    rng = random.Random(3)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    data = [(g, k, rng.choice(["a", "a", "b", None])) for g in range(4) for k in range(60)]
    df = spark.createDataFrame(data, "series long, frame long, label string")
    for k in range(3):
        df.filter(F.col("frame").between(k * 20, k * 20 + 19)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    got = rows(run(jobs.hysteresis(source(spark, df, tmp_path), 2, 3), tmp_path).select("series", "kind", "label", "frame"))
    spans = folds.label_hysteresis(df, ["series"], "label", 2, 3, "series long")
    assert got == rows(folds.contact_events(spans, ["series"], "label").select("series", "kind", "label", "frame")) and len(got) > 10


def test_persistence_holds_after_the_last_detection(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    df = spark.createDataFrame([(1, 10), (1, 11), (1, 20), (2, 12), (9, 500)], "object long, s long").withColumn("ts", F.timestamp_seconds("s"))
    for low, high in ((0, 15), (16, 100), (101, 600)):
        df.filter(F.col("s").between(low, high)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    got = rows(run(jobs.persistence(source(spark, df, tmp_path), 3000, "10 seconds"), tmp_path))
    assert got == [(1, 10_000, 14_000), (1, 20_000, 23_000), (2, 12_000, 15_000)]


def test_upsert_keeps_the_latest(spark, events, tmp_path):
    run(source(spark, events, tmp_path), tmp_path, how=jobs.upsert_to(f"{tmp_path}/state", ["key"], ["s", "id"]))
    got = bookkeeping.latest(spark.read.parquet(f"{tmp_path}/state"), ["key"], ["s", "id"])
    assert rows(got.select("key", "id")) == rows(bookkeeping.latest(events, ["key"], ["s", "id"]).select("key", "id"))


def test_late_rows_are_quarantined(spark, tmp_path):
    """What is late is late against all earlier batches, so that a batch of late rows alone is found."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    df = spark.createDataFrame([(1, 100), (1, 900), (2, 50), (1, 200), (1, 290), (1, 350), (2, 60), (1, 1000)], "key long, s long").withColumn("ts", F.timestamp_seconds("s"))
    for k, part in enumerate(([100, 900, 50], [200, 290, 350, 60], [1000])):
        df.filter(F.col("s").isin(part)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    marked = jobs.mark_late(source(spark, df, tmp_path), "key", 600)
    run(marked, tmp_path, how=jobs.quarantine_to(f"{tmp_path}/good", f"{tmp_path}/bad"))
    good, bad = spark.read.parquet(f"{tmp_path}/good"), spark.read.parquet(f"{tmp_path}/bad")
    assert sorted(r["s"] for r in bad.collect()) == [200, 290] and good.count() == 6 and good.columns == df.columns


@pytest.mark.parametrize(
    ("labels", "want"),
    [
        ([None, "a", "a", "a", None, "a", None, None, None, "b", "b", "c", "c", "c"], [("a", 1, 6), ("b", 9, 11), ("c", 11, None)]),
        (["a", "a", "a", None, "b", None, "a", "a", "a"], [("a", 0, None)]),
        (["b", "a", "a", "b", "b", "b"], [("a", 1, 3), ("b", 3, None)]),
        ([None, "a", None], []),
    ],
)
def test_label_hysteresis(spark, labels, want):
    df = spark.createDataFrame([(1, k, x) for k, x in enumerate(labels)], "g long, frame int, label string")
    got = folds.label_hysteresis(df, ["g"], "label", 2, 3, "g long").select("label", "start", "end").orderBy("start").collect()
    assert list(map(tuple, got)) == want


def test_prob_hysteresis(spark):
    p = [0.1, 0.9, 0.9, 0.5, 0.1, 0.9, 0.1, 0.1, 0.1, 0.9, 0.9, None]
    df = spark.createDataFrame([(1, k, x) for k, x in enumerate(p)], "g long, frame int, p double")
    assert rows(folds.prob_hysteresis(df, ["g"], 0.8, 0.2, 2, 2).select("start", "end")) == [(1, 5), (9, 11)]
    assert rows(folds.prob_hysteresis(df, ["g"], 0.9, 0.2, 2, 2)) == []  # at the limit is not over it


def test_each_release_is_used_once(spark):
    spans = [("r", 1, 7, 0, 100), ("r", 2, 7, 103, 200), ("r", 2, 7, 95, 180), ("r", 3, 7, 104, 300)]
    df = spark.createDataFrame(spans, "rec string, person long, object int, start long, end long")
    got = rows(folds.pair_handovers(df, ["rec"], 10, 50, 3, "rec string").select("giver", "receiver", "start", "end"))
    assert got == [(1, 2, 92, 103)]  # the first taker in time, not the nearest pair


def test_a_taker_may_still_hold(spark):
    spans = [("r", 1, 7, 0, 100), ("r", 2, 7, 103, None), ("r", 1, 8, 0, 40), ("r", 2, 8, 41, 45)]
    df = spark.createDataFrame(spans, "rec string, person long, object int, start long, end long")
    assert rows(folds.pair_handovers(df, ["rec"], 10, 50, 0, "rec string").select("giver", "receiver", "start", "end")) == [(1, 2, 100, 103)]


def test_overlapping_handovers_are_merged(spark):
    spans = [("r", 1, 7, 0, 100), ("r", 2, 7, 102, 200), ("r", 1, 7, 101, 104), ("r", 2, 7, 105, 200)]
    df = spark.createDataFrame(spans, "rec string, person long, object int, start long, end long")
    assert rows(folds.pair_handovers(df, ["rec"], 10, 2, 3, "rec string").select("giver", "receiver", "start", "end", "n")) == [(1, 2, 97, 108, 2)]
