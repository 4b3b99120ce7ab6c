"""Readers and writers on small files."""

import hashlib
import json

import pytest

from tandem.sources import files

HEAD = "graph_uid,tracking_timestamp_us,utc_timestamp_ns,tx,ty,tz,qx,qy,qz,qw,quality_score\n"


def test_trajectory_is_strict(spark, tmp_path):
    (tmp_path / "a.csv").write_text(HEAD + "g,9007199254740993,-1,1,2,3,0,0,0,1,1.0\n")
    r = files.read_trajectory(spark, f"{tmp_path}/a.csv").first()
    assert r["tracking_timestamp_us"] == 9007199254740993 and r["utc_timestamp_ns"] is None
    (tmp_path / "b.csv").write_text(HEAD + "g,1,2,3\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        files.read_trajectory(spark, f"{tmp_path}/b.csv").collect()
    (tmp_path / "c.csv").write_text(HEAD.replace("tx", "ty", 1) + "g,1,1,1,2,3,0,0,0,1,1.0\n")
    with pytest.raises(Exception, match="(?i)header"):
        files.read_trajectory(spark, f"{tmp_path}/c.csv").collect()


def test_hands_fold_to_sides(spark, tmp_path):
    names = ["tracking_timestamp_us", "left_confidence", "right_confidence"] + [f"{a}{p}_{s}" for s in ("left", "right") for p in range(2) for a in ("tx", "ty", "tz")]
    rows = [[5, 0, -1, *range(12)], [6, 1.5, 1, *range(5), "", *range(6)]]
    (tmp_path / "h.csv").write_text("\n".join([",".join(names), *(",".join(map(str, r)) for r in rows)]) + "\n")
    got = {(r["t_us"], r["side"]): (r["conf"], r["points"] and len(r["points"])) for r in files.read_hands(spark, f"{tmp_path}/h.csv", 2).collect()}
    assert got == {(5, "left"): (0.0, 2), (5, "right"): (None, None), (6, "left"): (None, None), (6, "right"): (1.0, 2)}


def test_handovers_keep_keys_and_literal_skip(spark, tmp_path):
    seg = {"start_frame": 1, "end_frame": 2, "start_time": 0.1, "end_time": 0.2, "initiator": "A", "initiation_type": ["x", "y"]}
    (tmp_path / "h.json").write_text(json.dumps({"r1": {"7": {**seg, "skip": False}, "x": {**seg, "skip": "false?"}}, "r2": {"k": seg}}))
    df = files.read_handovers(spark, f"{tmp_path}/h.json")
    assert sorted((r["recording_id"], r["key"]) for r in df.collect()) == [("r1", "7"), ("r1", "x"), ("r2", "k")]
    assert [r["key"] for r in files.usable(df).collect()] == ["7"]
    assert sorted(r["key"] for r in files.usable(df, "falsy").collect()) == ["7", "k"]


def test_intervals_as_list_or_map(spark, tmp_path):
    (tmp_path / "i.json").write_text(json.dumps({"a": [{"start": 1, "end": 2}], "b": {"x": {"start": 3, "end": 4}}}))
    assert sorted(map(tuple, files.read_intervals(spark, f"{tmp_path}/i.json").collect())) == [("a", 1.0, 2.0), ("b", 3.0, 4.0)]


def test_words_verdicts_roles(spark, tmp_path):
    (tmp_path / "w.json").write_text(json.dumps({"segments": [{"words": [{"word": " Hello,", "start": 0.1, "end": 0.2}]}]}))
    assert tuple(files.read_words(spark, f"{tmp_path}/w.json").first()) == (0.1, 0.2, "hello")
    (tmp_path / "v.jsonl").write_text('{"id": "a", "item": "b", "verdict": "ok"}\nnot json\n')
    assert [r["id"] for r in files.read_verdicts(spark, f"{tmp_path}/v.jsonl").collect()] == ["a"]
    (tmp_path / "r.json").write_text('{"leader": "1", "helper": "1", "third": "x"}')
    assert {r["role"]: r["problem"] for r in files.read_role_map(spark, f"{tmp_path}/r.json").collect()} == {"leader": "repeated", "helper": "repeated", "third": "not_numeric"}


def test_manifest_problems(spark, tmp_path):
    h = "a" * 64
    rows = [("a/b", 1, h), ("a/b", 1, h), ("../x", 1, h), ("c", -1, h), ("d", 1, "zz"), ("e", 1, h)]
    (tmp_path / "m.json").write_text(json.dumps([{"path": p, "size": s, "hash": x} for p, s, x in rows]))
    got = sorted((r["path"], r["problem"]) for r in files.read_manifest(spark, f"{tmp_path}/m.json").collect() if r["problem"])
    assert got == [("../x", "unsafe_path"), ("a/b", "duplicate"), ("a/b", "duplicate"), ("c", "bad_size"), ("d", "bad_hash")]


def test_inventory_and_manifest_of_a_folder(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_bytes(b"abc")
    (tmp_path / "in/b.part").write_bytes(b"x")
    assert {r["kind"]: (r["size"], r["partial"]) for r in files.inventory(spark, f"{tmp_path}/in").collect()} == {"txt": (3, False), "part": (1, True)}
    assert hashlib.sha256(b"abc").hexdigest() in {r["hash"] for r in files.build_manifest(spark, f"{tmp_path}/in").collect()}


def test_records_have_the_declared_columns(spark, tmp_path):
    df = spark.createDataFrame([("r", 1, 2.0)], "recording_id string, frame int, x double")
    files.write_records(df, f"{tmp_path}/rec", [("frame", "bigint", {}), ("x", "float", {"unit": "m"}), ("absent", "array<float>", {})])
    got = spark.read.parquet(f"{tmp_path}/rec")
    assert got.columns == ["frame", "x", "absent", "recording_id"] and got.schema["x"].metadata == {"unit": "m"} and got.first()["absent"] is None
    assert {r["name"]: (r["unit"], r["unknown"]) for r in files.column_dictionary(got, [("^x$", "m", "position")]).collect()}["x"] == ("m", 0.0)


def test_fields_are_discovered(spark):
    df = spark.createDataFrame([((1, [(2,)]),)], "a struct<b: int, c: array<struct<d: int>>>")
    assert sorted(r["path"] for r in files.discover_fields(df).collect()) == ["a.b", "a.c[].d"]
