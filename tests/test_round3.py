"""What round 3's findings on large tables changed, on small ones."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from tandem.functions import scalar
from tandem.operators import bookkeeping, events, folds
from tandem.operators import text as tx


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_words_are_cut_once_for_each_utterance(spark):
    """Comparing cut the texts anew for each word, which took hours."""
    texts = [None, "", "...", "a", "b a a", "a B a c a", "it's ÄÖ äö 12 12 12", "a b c " * 300, "c c b " * 200]
    rows = [(1, k, 0, 100, t, "s", 0.5) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "g int, id long, start long, end long, text string, speaker string, prob double")
    cut = {r["id"]: r["w"] for r in df.select("id", scalar.numbered_words(F.col("text")).alias("w")).collect()}
    assert cut[4] == ["a 0", "a 1", "b 0"] and cut[2] == [] and cut[0] is None
    assert all(w is None or len(set(w)) == len(w) for w in cut.values())
    likeness = scalar.text_similarity(F.col("a.w"), F.col("b.w"))
    words = df.filter("text <> ''").select("id", "text", scalar.numbered_words(F.col("text")).alias("w"))
    for r in words.alias("a").crossJoin(words.alias("b")).select(F.col("a.text").alias("a"), F.col("b.text").alias("b"), likeness.alias("s")).collect():
        a, b = (Counter(t.lower().split()) if t != "..." else Counter() for t in (r["a"], r["b"]))
        want = (a & b).total() / min(a.total(), b.total()) if a and b else 0.0
        assert r["s"] == pytest.approx(want)
    assert plan_of(tx.duplicate_utterances(df.repartition(3), ["g"], 50)).split("Join")[0].count("regexp_extract_all") == 0


def test_folds_run_over_many_series_at_once(spark):
    df = spark.range(60).selectExpr("id % 20 AS g", "id div 20 AS k", "nullif(id % 3, 0) AS v")
    got = folds.folded(df, ["g"], ["k"], lambda rows: [(len(x := list(rows)), x[-1][1])], "g long, n int, last long")
    assert "FlatMapGroups" not in plan_of(got)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(((g, 3, (g + 40) % 3 or None) for g in range(20)), key=str)
    labels = spark.createDataFrame([(g, k, "a") for g in range(3) for k in range(3)], "g long, frame int, label string")
    spans = spark.createDataFrame([("r", 1, 7, 0, 100)], "rec string, person long, object int, start long, end long")
    segments = spark.createDataFrame([(1, 1, 0, 9, "a", "s", 0.5)], "g int, id long, start long, end long, text string, speaker string, prob double")
    made = [folds.label_hysteresis(labels, ["g"], "label", 2, 3, "g long"), folds.pair_handovers(spans, ["rec"], 10, 50, 3, "rec string"), tx.dedup_utterances(segments, ["g"], 60, "g int, id long")]
    assert not [p for p in map(plan_of, made) if "FlatMapGroups" in p]


def test_slots_are_found_in_one_aggregation(spark):
    df = spark.createDataFrame([(1, 1, 2.0), (1, 1, 3.0), (1, 2, 5.0), (2, 9, 1.0)], "g int, slot int, v double")
    out = bookkeeping.slots_to_columns(df, ["g"], "slot", "v", [1, 2])
    assert plan_of(out).count("Exchange") == 1  # before it runs: afterwards the plan is there twice
    assert sorted(map(tuple, out.collect())) == [(1, 3.0, 5.0), (2, None, None)]


def test_frames_meet_without_a_join(spark):
    p = spark.createDataFrame([(1, k, float(k % 4)) for k in range(9)], "g int, frame int, p double")
    asked = spark.createDataFrame([(1, 0), (1, 3), (1, 3), (1, 8), (2, 3), (None, 3)], "g int, frame int")
    out = events.peaks_before(p, asked, ["g"], 3)
    assert sorted(map(tuple, out.collect())) == [(1, 3, 2.0), (1, 8, 3.0)]
    near = spark.createDataFrame([(1, 2, 3)], "g int, start_frame int, end_frame int")
    far = folds.negative_windows(p.select("g", "frame"), near, ["g"], 2, 9, 3)
    assert sorted(map(tuple, far.collect())) == [(1, 0), (1, 5), (1, 6), (1, 7), (1, 8)]
    words = spark.createDataFrame([(1, 4, 9, "can")], "g int, start long, end long, token string")
    said = tx.speech_block(words, p.select("g", "frame"), ["g"], 5, 2, 20, 2)
    assert [r["n_words"] for r in said.orderBy("frame").collect()] == [0, 0, 1, 1, 0, 0, 0, 0, 0]
    assert not [d for d in map(plan_of, (out, far, said)) if "Join" in d]
