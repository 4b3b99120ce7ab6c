"""What round 4's findings changed."""

import math
import random

import duckdb
import pytest

from tandem.operators import sensor
from tandem.plans import registry


def rows_of(spark, folder, name, table, rows, schema):
    """A query's rows and its SQL's, over one given table."""
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{table}.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet/*.parquet')")
    got = registry.queries()[name](spark, str(folder))
    cur = con.execute(registry.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    return sorted(map(tuple, got.select(*cols).collect())), sorted(cur.fetchall())


LINES = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_discount double, l_returnflag string"


def lines(boxes):
    return [(frame, x, 0, track, 1.0, 0.0, "A") for frame, track, x in boxes]


def test_halves_are_rounded_as_in_sql(spark, tmp_path):
    """41 of 640 pairs agree: 0.0640625, which times a million is a little less than a half over 64062."""
    boxes = [(f, t, 5) for f in range(41) for t in [1] + [2] * (40 if f == 40 else 15)]
    got, want = rows_of(spark, tmp_path, "view_cooccurrence", "lineitem", lines(boxes), LINES)
    assert got == want == [(0, 1, 2, 640, -1.146953, 0.064062)]


@pytest.mark.parametrize("left", [(1, None), (None, 5)])
def test_a_box_without_place_is_the_last_from_the_left(spark, tmp_path, left):
    boxes = [(f, t, x) for f in range(3) for t, x in (left, (3, 5), (2, 7))]
    got, want = rows_of(spark, tmp_path, "view_cooccurrence", "lineitem", lines(boxes), LINES)
    assert got == want and got[-1] == (0, 3, 2, 3, 1.0, 1.0)


def test_a_clock_is_found_by_the_query(spark, tmp_path):
    """A sensor that is 0.37 s ahead: 20 turns can't be significant at one in a hundred, steps of a second don't find its peak,
    and no window of 40 s has turns enough."""
    rng, late, angle, rows = random.Random(4), 0.37, 0.0, []
    turns = [rng.uniform(0.05, 1.5) for _ in range(400)]
    for k, turn in enumerate(turns):
        angle += turn
        speed = late * turns[k - 1] + (1 - late) * turn
        rows.append((k, 1, [speed, 0.0, 0.0, 0.0, 0.0, math.sin(angle / 2), math.cos(angle / 2)] + [0.0] * 57))
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    r = registry.queries()["sensor_clock"](spark, str(tmp_path)).first()
    assert (r["status"], r["reason"], r["drift_check"]) == ("estimated", [], "consistent")
    assert r["offset"] == pytest.approx(late, abs=0.01) and r["p"] == pytest.approx(1 / 201) and r["r"] > 0.99


def test_units_of_lags_give_what_single_lags_give(spark, monkeypatch):
    """Scores of two series with windows, one with a gap, whatever lags go together."""
    rng = random.Random(5)
    path = [(g, k / 10, k * 0.1 + rng.random() / 50, min(k, 230) / 10 if g else k / 10) for g in range(2) for k in range(600)]
    frames = [(g, k // 25, k, k / 2 - 0.5, k / 2, rng.random()) for g in range(2) for k in range(1, 125)]
    paths = spark.createDataFrame(path, "g int, t double, path double, valid double")
    known = spark.createDataFrame(frames, "g int, win int, k int, a double, b double, motion double")
    rule = sensor.ClockRule(most_lag=1.0, step=0.1, n_null=9, least_shift=2.0, least_frames=8)
    found = []
    for at_once in (64, 4):
        monkeypatch.setattr(sensor, "LAGS_A_UNIT", at_once)
        tests = sensor.lag_test(sensor.clock_scores(known, paths, ["g"], ["win"], "g int, win int", rule), ["g", "win"])
        found.append({(r["g"], r["win"]): (r["lag"], r["n"], r["p"], round(r["r"], 9), round(r["null_p99"], 9)) for r in tests.collect()})
    assert found[0] == found[1] and {w for g, w in found[0] if g == 0} == {0, 1, 2, 3, 4}
    assert {w for g, w in found[0] if g == 1} == {0, 1}  # nothing is valid in the third and later ones
