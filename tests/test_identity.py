"""Assignments, tracks and views: brute force and cases where a greedy choice is wrong."""

import itertools
import random

import numpy as np
import pytest

from tandem.operators import identity


def test_least_cost_is_the_least_of_all():
    rng = np.random.default_rng(1)
    for _ in range(300):
        n, m = rng.integers(1, 6, 2)
        cost = np.round(rng.random((n, m)) * rng.choice([1, 10]), rng.integers(0, 4))
        pairs = identity.least_cost(cost)
        assert len(pairs) == min(n, m) == len({i for i, _ in pairs}) == len({j for _, j in pairs})
        c = cost if n <= m else cost.T
        assert sum(cost[i, j] for i, j in pairs) == pytest.approx(min(sum(c[i, p[i]] for i in range(len(c))) for p in itertools.permutations(range(c.shape[1]), len(c))))


def costs_of(spark, tables):
    rows = [(g, f"a{i}", f"b{j}", float(c)) for g, t in tables.items() for i, row in enumerate(t) for j, c in enumerate(row)]
    return spark.createDataFrame(rows, "g int, a string, b string, c double")


def test_assignments_margins_and_refusal(spark):
    rng = random.Random(2)
    tables = {0: [[abs(x - y) for y in (9, 19.5, 31)] for x in (0, 10, 21)], 1: [[1.0]], 9: [[1.0] * 5] * 2}
    tables |= {k: [[rng.randrange(50) / 7 for _ in range(rng.randrange(1, 5))]] * 1 for k in range(10, 20)}
    tables |= {k: [[rng.randrange(50) / 7 for _ in range(m)] for _ in range(n)] for k, (n, m) in enumerate(itertools.product(range(1, 5), repeat=2), 20)}
    got = {}
    for r in identity.assignments(costs_of(spark, tables), ["g"], "a", "b", "c").collect():
        got.setdefault(r["g"], []).append(r)
    assert sorted((r["a"], r["b"]) for r in got[0]) == [("a0", "b0"), ("a1", "b1"), ("a2", "b2")] and got[0][0]["total"] == 28.5
    assert got[1][0]["margin"] is None and [r["a"] for r in got[9]] == [None]
    for g, t in tables.items():
        if g == 9:
            continue
        c = np.array(t) if len(t) <= len(t[0]) else np.array(t).T
        totals = sorted(sum(c[i, p[i]] for i in range(len(c))) for p in itertools.permutations(range(c.shape[1]), len(c)))
        assert got[g][0]["total"] == pytest.approx(totals[0])
        assert got[g][0]["margin"] == (pytest.approx(totals[1] - totals[0]) if len(totals) > 1 else None)


def box(x, y=0.0, w=10.0, h=20.0):
    return (x, y, x + w, y + h)


def linked(spark, rows, memory=10, least=3, **options):
    df = spark.createDataFrame([(1, f, s, *map(float, b), h) for f, s, b, h in rows], "stream int, frame long, slot int, x0 double, y0 double, x1 double, y1 double, hist array<double>")
    return {(r["frame"], r["slot"]): r["track"] for r in identity.link_tracks(df, ["stream"], "stream int", memory, least, **options).collect()}


def test_crossing_people_keep_their_tracks(spark):
    red, blue = [9.0, 1.0], [1.0, 9.0]
    rows = []
    for f in range(40):
        a, b = (f, 0, box(3.0 * f), red), (f, 1, box(117 - 3.0 * f), blue)
        rows += [a, b] if f % 2 else [(f, 0, b[2], blue), (f, 1, a[2], red)]
    got = linked(spark, rows)
    assert len({got[(f, 0 if f % 2 else 1)] for f in range(40)}) == 1 and len(set(got.values())) == 2


def plain_links(rows, memory, least, most=4):
    """All assignments of a frame compared."""
    tracks, out = [], []
    for f in sorted({r[0] for r in rows}):
        now = sorted(r for r in rows if r[0] == f)
        alive = [t for t in tracks if f - t["seen"] <= memory]
        cost = [[1 - identity.overlap(t["box"] + t["v"] * min(f - t["seen"], 5), np.array(b, float)) + identity.looks_apart(t["look"], None if h is None else np.array(h)) for _, _, b, h in now] for t in alive]
        small, wide = (len(alive), len(now)) if len(alive) <= len(now) else (len(now), len(alive))
        pairs = []
        if small:
            at = lambda i, j: cost[i][j] if len(alive) <= len(now) else cost[j][i]
            best = min(itertools.permutations(range(wide), small), key=lambda p: sum(at(i, j) for i, j in enumerate(p)))
            pairs = [(i, j) if len(alive) <= len(now) else (j, i) for i, j in enumerate(best)]
        mine = {j: alive[i] for i, j in pairs if cost[i][j] <= 1.4}
        for j, (_, s, b, h) in enumerate(now):
            b, h = np.array(b, float), None if h is None else np.array(h)
            t = mine.get(j)
            if t is None:
                t = {"v": np.zeros(4), "box": b, "look": h, "seen": f, "n": 0, "first": f, "id": len(tracks)}
                tracks.append(t)
            else:
                t["v"] = 0.5 * t["v"] + 0.5 * (b - t["box"]) if f - t["seen"] == 1 else np.zeros(4)
                t["look"] = t["look"] if h is None else h if t["look"] is None else 0.85 * t["look"] + 0.15 * h
                t["box"], t["seen"] = b, f
            t["n"] += 1
            out.append((f, s, t))
    kept = sorted((t for t in tracks if t["n"] >= least), key=lambda t: (-t["n"], t["first"], t["id"]))[:most]
    rank = {t["id"]: k for k, t in enumerate(kept)}
    return {(f, s): rank[t["id"]] for f, s, t in out if t["id"] in rank}


def test_links_as_by_comparing_all_assignments(spark):
    rng = random.Random(3)
    for _ in range(3):
        people = [[rng.uniform(0, 200), rng.uniform(-4, 4)] for _ in range(5)]
        rows = []
        for f in range(60):
            for s, p in enumerate(rng.sample(people, 5)):
                p[0] += p[1]
                if rng.random() < 0.8:
                    rows.append((f, s, box(p[0] + rng.uniform(-1, 1)), None if rng.random() < 0.1 else [1.0 + people.index(p), 2.0, rng.random()]))
        assert linked(spark, rows, memory=4, least=3) == plain_links(rows, 4, 3)


def test_a_gap_stops_a_track_and_long_tracks_win(spark):
    rows = [(f, 0, box(4.0 * f), None) for f in range(20) if not 8 <= f < 10] + [(f, 1, box(500.0), None) for f in range(30)] + [(0, 2, box(900.0), None)]
    got = linked(spark, rows, memory=5, least=2)
    assert got[(0, 1)] == 0 and (0, 2) not in got  # the longest first, single boxes go
    assert set(linked(spark, rows, memory=5, least=2, most_tracks=1).values()) == {0}


def test_keypoints_decide_which_body_a_track_is(spark):
    points = lambda x: [(x + k, float(k), 0.9) for k in range(6)]
    tracks = spark.createDataFrame([(1, f, t, points(x)) for f in range(6) for t, x in (("p", 0.0), ("q", 30.0), ("r", 300.0))], "g int, frame int, track string, t array<struct<x: double, y: double, conf: double>>")
    bodies = spark.createDataFrame([(1, f, b, [(x + k, float(k)) for k in range(6)]) for f in range(6) for b, x in ((1, 20.0), (2, 1.0))], "g int, frame int, body int, b array<struct<x: double, y: double>>")
    got = sorted((r["track"], r["body"], r["n"], round(r["distance"], 3)) for r in identity.match_tracks(tracks, bodies, ["g"], 200.0).collect())
    assert got == [("p", 2, 6, 0.005), ("q", 1, 6, 0.05)]
    assert identity.match_tracks(tracks, bodies, ["g"], 200.0, least=7).count() == 0
    assert identity.match_tracks(tracks, bodies, ["g"], 200.0, least_points=7).count() == 0


def test_views_from_opposite_sides_are_mirrored(spark):
    rows = [(1, s, t, f, float(x)) for f in range(10) for s, t, x in (("a", 0, f), ("a", 1, 50), ("b", 7, 60 - f), ("b", 8, 5))]
    tracks = spark.createDataFrame(rows, "g int, stream string, track int, frame int, x double")
    looks = spark.createDataFrame([(1, "a", 0, [1.0, 0.0]), (1, "a", 1, [0.0, 1.0]), (1, "b", 7, [1.0, 0.0]), (1, "b", 8, [0.0, 1.0])], "g int, stream string, track int, hist array<double>")
    got = {(r["track_a"], r["track_b"]): r for r in identity.cross_view(tracks, looks, ["g"], "a", "b").collect()}
    assert set(got) == {(0, 7), (1, 8)} and got[(0, 7)]["orientation"] == "mirrored" and not got[(0, 7)]["ambiguous"] and got[(0, 7)]["margin"] == pytest.approx(2.0)
    plain = {(r["track_a"], r["track_b"]): r for r in identity.cross_view(tracks, looks.limit(0), ["g"], "a", "b").collect()}
    assert all(r["ambiguous"] and r["margin"] == 0 for r in plain.values())
