"""What callers bring themselves, and values that SQL does not hold against the operators."""

import json
import zlib

import pytest
from pyspark.sql import functions as F

from tandem.functions import scalar
from tandem.operators import checks, proposals
from tandem.operators import text as tx
from tandem.sources import files


def test_a_caller_selects_segments(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"r1": [{"s": 1}, {"s": 5}], "r2": []}))
    (tmp_path / "b.json").write_text("{}")

    def pick(text):
        return [(r, k, x["s"]) for r, xs in json.loads(text).items() for k, x in enumerate(xs)]

    out = files.select_segments(spark, str(tmp_path), pick, "recording_id string, k long, start long")
    assert sorted(map(tuple, out.collect())) == [("r1", 0, 1), ("r1", 1, 5)]


def test_a_caller_annotates_what_is_not_done(spark, tmp_path):
    asked = tmp_path / "asked"
    asked.mkdir()

    def fn(key):
        tries = len(list(asked.glob(f"{key}-*")))
        (asked / f"{key}-{tries}").touch()
        if key == "bad" or (key == "late" and tries < 1):
            raise RuntimeError("no answer")
        return key.upper()

    keys = spark.createDataFrame([(k,) for k in ("new", "late", "bad", "done", "new")], "key string")
    done = spark.createDataFrame([("done", "D"), ("bad", None)], "key string, reply string")
    got = {r["key"]: (r["reply"], r["error"]) for r in proposals.annotate(keys, done, "key", fn).collect()}
    assert got == {"new": ("NEW", None), "late": ("LATE", None), "bad": (None, "RuntimeError: no answer")}


def test_a_caller_projects_by_a_pandas_udf(spark):
    import pandas as pd

    @F.pandas_udf("double")
    def half(x: pd.Series) -> pd.Series:
        return x / 2

    points = spark.createDataFrame([(1, 2.0, 4.0, 1.0), (1, -2.0, 4.0, 1.0), (1, None, 4.0, 1.0)], "g int, x double, y double, z double")
    r = checks.coverage_by(points, ["g"], lambda p: [half(p[0]), half(p[1])], 5, 5).first()
    assert (r["n"], r["n_inside"], r["n_outside"], r["n_unplaced"], r["min_u"]) == (3, 1, 1, 1, -1.0)


def test_the_bag_is_of_the_window(spark):
    words = [(1, 1, 4, "give"), (1, 5, 9, "me"), (1, 40, 44, "cup"), (1, 0, 0, "start")]
    df = spark.createDataFrame(words, "g int, start long, end long, token string")
    grid = spark.range(12).selectExpr("1 AS g", "id AS frame")
    rows = {r["frame"]: r for r in tx.speech_block(df, grid, ["g"], 5, 3, 20, 8).collect()}
    bin_of = lambda t: zlib.crc32(t.encode()) % 8
    for frame, own in ((0, []), (1, ["give"]), (2, ["give", "me"]), (3, ["give", "me"]), (4, ["me"]), (5, []), (9, ["cup"]), (11, ["cup"])):
        want = [sum(bin_of(t) == b for t in own) / max(1, len(own)) for b in range(8)]
        r = rows[frame]
        assert (list(r["bag"]), r["n_words"], r["request"]) == (want, len(own), "give" in own)
    assert rows[0]["since"] == 0 and rows[1]["since"] == pytest.approx(0.05) and rows[7]["since"] == 1 and [rows[k]["speaking"] for k in (0, 2, 3, 7, 8)] == [True, True, False, False, True]


def test_json_in_free_text(spark):
    cases = {
        'x {"a": "}"} {"b": 1}': '{"a": "}"}', "none": None, "{broken": None, '```json\n{"a": {"b": 2}}\n``` {z}': '{"a": {"b": 2}}', '{not json} then {"a": 1}': None, "": None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", scalar.extract_json(F.col("t")).alias("j"))
    assert {r["t"]: r["j"] for r in df.collect()} == cases
    a = spark.createDataFrame([('{"persons": null, "handover": null, "note": ""}',), (None,)], "t string").select(scalar.normal_annotation(F.col("t")).alias("a")).collect()
    assert all(r["a"]["persons"] == [] and r["a"]["handover"] is None and r["a"]["note"] is None for r in a)


def test_reports_and_small_readers(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    files.write_report(df, f"{tmp_path}/r")
    assert spark.read.option("header", True).csv(f"{tmp_path}/r").count() == 2
    (tmp_path / "c.jsonl").write_text(json.dumps({"tracking_timestamp_us": 5, "CameraCalibrations": [{"Label": "rgb", "Projection": {"Name": "Fisheye", "Params": [1.0, 2.0]}}]}) + "\n")
    r = files.read_calibration(spark, f"{tmp_path}/c.jsonl").first()
    assert (r["t_us"], r["position"], r["label"], r["model"], r["params"]) == (5, 0, "rgb", "Fisheye", [1.0, 2.0])


def test_sessions_without_overlap_match_by_index(spark):
    from tandem.operators import intervals

    ref = spark.createDataFrame([("e", 1, 0, 100), ("e", 2, 200, 300)], "ep string, id int, start long, end long")
    own = [("e", 11, "left", 10, 90), ("e", 12, "left", 20, 400), ("e", 21, "right", 1000, 1100), ("e", 22, "right", 1200, 1300), ("e", 31, "one", 5000, 5100)]
    df = spark.createDataFrame(own, "ep string, id int, cam string, start long, end long")
    matched = intervals.match_sessions(df, ref, ["ep"], width=50)
    assert sorted((r["a_id"], r["b_id"], r["shared"], r["claimed"]) for r in matched.collect()) == [(11, 1, 80, True), (12, 2, 100, True)]
    got = sorted((r["a_id"], r["b_id"], r["by_index"]) for r in intervals.match_by_index(df, ref, matched, ["ep"], "cam").collect())
    assert got == [(11, 1, False), (12, 2, False), (21, 1, True), (22, 2, True)]
