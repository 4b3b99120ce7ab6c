"""Small tables on which a finding of round 3 shows."""

import datetime
import re

import duckdb
import pytest

from tandem.plans import registry
from tandem.sources import fixtures as fx


@pytest.fixture
def events(spark, tmp_path):
    """Writes rows of (event_id, hour since 2024, user_id, event_type, value) as a table of events; the folder."""

    def write(rows):
        start = datetime.datetime(2024, 1, 1)
        rows = [(i, None if h is None else start + datetime.timedelta(hours=h), u, k, v) for i, h, u, k, v in rows]
        spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
        return str(tmp_path)

    return write


def by_sql(folder, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{folder}/events.parquet/*.parquet')")
    return con.execute(registry.oracle_sql()[name])


def test_stream_quality_rounds_halves_up_in_query_and_sql(spark, events):
    """35.97705 / 900 is 0.0399745, which floating point puts just under it."""
    folder = events([(1, 0, 0, "view", 35.97705), (2, 0, 2, "view", 0.00225)])
    want = {0: 0.039975, 1: 0.000003}
    got = registry.queries()["stream_quality"](spark, folder).filter("role = 0").collect()
    assert {r["recording_id"]: r["average_motion"] for r in got} == want
    rows = by_sql(folder, "stream_quality").fetchdf()
    assert {r.recording_id: r.average_motion for r in rows[rows.role == 0].itertuples()} == want


def test_frames_are_dealt_by_recording_once(spark, events):
    """F38 and others: every frame of every recording is there, and no row of the grid is shuffled."""
    folder = events([
        (1, 0, 0, "view", 1.5), (2, 0, 0, "view", None), (3, 5, 0, "view", 2.0), (4, 722, 1, "view", 4.0), (5, 719, 3, "view", None), (6, None, 6, "view", 1.0), (7, 3, None, "view", 1.0),
        (8, -2, 8, "view", 1.0), (9, 4, -1, "view", 9.0), (10, 4, 8, "view", 3.0),
    ])
    for hours in (1, 6):
        df = fx.frames(spark, folder, hours)
        keys = {(r["recording_id"], role, r["frame"]) for r in fx.grid(spark, folder, hours).collect() for role in (0, 1)}
        rows = df.collect()
        assert len(rows) == len(keys) and {(r["recording_id"], r["role"], r["frame"]) for r in rows} == keys
        want = {(0, 0, 0): (1.5, 2), (0, 0, 5): (2.0, 1), (0, 1, 722): (4.0, 1), (1, 1, 719): (None, 1), (4, 0, 4): (3.0, 1)}
        if hours == 6:
            want = {(0, 0, 0): (3.5, 3), (0, 1, 120): (4.0, 1), (1, 1, 119): (None, 1), (4, 0, 0): (3.0, 1)}
        assert {(r["recording_id"], r["role"], r["frame"]): (r["val"], r["n"]) for r in rows if r["n"]} == want
        assert all(r["val"] is None for r in rows if not r["n"])
        plan = df.groupBy("recording_id", "role").count()._jdf.queryExecution().executedPlan().toString()
        assert plan.count("hashpartitioning") == 1


@pytest.mark.parametrize("name", ["scope_metrics", "recommend", "rank_events"])
def test_scopes_shuffle_no_frames(spark, events, name):
    """only events are shuffled, by recording; frames and what is asked of them stay where they are."""
    folder = events([(1, 0, 0, "purchase", 1.5), (2, 30, 1, "view", 2.0), (3, 50, 0, "purchase", 2.0), (4, 700, 3, "purchase", 4.0)])
    df = registry.queries()[name](spark, folder)
    plan = df._jdf.queryExecution().executedPlan().toString()
    keys = re.findall(r"hashpartitioning\((.*?), \d+\)", re.sub(r"#\d+L?", "", plan))
    assert set(keys) == {"recording_id"} and df.count() == 3
