"""Queries over whole tables leave no row out."""

import os

import pytest

from tandem.plans import registry
from tandem.sources import fixtures as fx

DATA = "/root/testdata/sf0.01"

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def test_every_sample_is_placed_or_has_a_reason(spark):
    out = registry.queries()["to_world_all"](spark, DATA)
    assert out.count() == fx.samples(spark, DATA).count()
    assert {r["status"] for r in out.select("status").distinct().collect()} >= {"no_samples"}


def test_every_frame_that_all_offsets_cover_is_a_target(spark):
    out = registry.queries()["offset_search_all"](spark, DATA).collect()
    n = fx.vectors(spark, DATA).count()
    assert {r["offset"]: r["n"] for r in out} == {k: n - 10 for k in range(-5, 6)}


def test_no_chunk_and_no_document_is_on_neither_side(spark):
    sides = registry.queries()["match_sessions_all"](spark, DATA).selectExpr("a_id % 3 AS a", "b_id % 3 AS b").distinct().collect()
    assert {r["a"] for r in sides} == {r["b"] for r in sides} == {0, 1, 2}
    assert registry.queries()["select_required_all"](spark, DATA).filter("present").count() == fx.files(spark, DATA).count()


def test_every_recording_is_followed_to_its_last_word(spark):
    out = registry.queries()["speech_window_all"](spark, DATA)
    words = fx.words(spark, DATA).selectExpr("recording_id", "start div 10 AS frame")
    ends = lambda df: {r[0]: r[1] for r in df.groupBy("recording_id").agg({"frame": "max"}).collect()}
    assert ends(out) == ends(words)
