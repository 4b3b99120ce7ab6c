"""Pooled evaluation, spread over bins, gives what the plain forms give."""

import hashlib
import random

import pytest

from tandem.operators import evaluate


def plain_auroc(rows):
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    return sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg)) if pos and neg else None


def plain_ap(rows):
    pos = [s for y, s in rows if y]
    return sum(sum(y for y, s in rows if s >= a) / sum(s >= a for _, s in rows) for a in pos) / len(pos)


@pytest.mark.parametrize("scale", [1.0, 1e-9, 1e12])
def test_ranks_over_bins(spark, scale):
    rng = random.Random(1)
    groups = {1: [(rng.randrange(2), rng.randrange(40) / 7 * scale) for _ in range(200)], 2: [(1, 5.0), (0, 5.0)], 3: [(1, -1e300), (0, 2.0), (1, 3.0)], 4: [(1, 1.0)]}
    groups[5] = [(rng.randrange(2), -scale * rng.random() ** 9) for _ in range(150)]
    df = spark.createDataFrame([(g, y, float(s)) for g, rows in groups.items() for y, s in rows], "g int, y int, score double")
    got = {r["g"]: r["auroc"] for r in evaluate.auroc(df, ["g"]).collect()}
    assert got == {g: pytest.approx(plain_auroc(rows)) if plain_auroc(rows) is not None else None for g, rows in groups.items()}
    pooled = [r for rows in groups.values() for r in rows]
    assert evaluate.auroc(df, []).first()["auroc"] == pytest.approx(plain_auroc(pooled))
    assert evaluate.average_precision(df, []).first()["ap"] == pytest.approx(plain_ap(pooled))
    assert {r["g"]: r["ap"] for r in evaluate.average_precision(df, ["g"]).collect()} == {g: pytest.approx(plain_ap(rows)) for g, rows in groups.items()}


def test_no_rows(spark):
    none = spark.createDataFrame([], "g int, y int, score double")
    assert evaluate.auroc(none, ["g"]).collect() == [] and evaluate.auroc(none, []).collect() == []


def test_folds_in_the_order_of_the_hash(spark):
    ids = spark.createDataFrame([(f"id{k}",) for k in range(500)] * 2, "id string")
    got = {r["id"]: r["fold"] for r in evaluate.assign_folds(ids, "id", 7, 3).collect()}
    order = sorted(got, key=lambda x: (hashlib.md5(f"3:{x}".encode()).hexdigest(), x))
    assert len(order) == 500 and [got[x] for x in order] == [k % 7 for k in range(500)]
