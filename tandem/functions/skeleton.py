"""Checks on skeletons of 17 keypoints, an array of structs (x, y, z or x, y, conf), as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import geometry as g


def point(points: Column, i: int) -> list[Column]:
    return [points[i][c] for c in "xyz"]


def head_pixel(people: Column, parts: tuple[int, ...] = (0, 1, 2), least: float = 0.3) -> Column:
    """Mean pixel of the sure head keypoints (conf >= least) of the person who has most of such confidence, the first of equal
    ones; null where no one has any. people: an array of skeletons (x, y, conf)."""
    head = lambda p: F.filter(F.array(*(p[i] for i in parts)), lambda k: k["conf"] >= least)
    total = lambda ks, c: F.aggregate(ks, F.lit(0.0), lambda a, k: a + k[c])
    rated = F.transform(people, lambda p, i: F.struct(total(head(p), "conf").alias("score"), (-i).alias("first"), F.try_divide(total(head(p), "x"), F.size(head(p))).alias("x"), F.try_divide(total(head(p), "y"), F.size(head(p))).alias("y")))
    best = F.array_max(F.filter(rated, lambda r: r["score"] > 0))
    return F.when(best.isNotNull(), F.struct(best["x"].alias("x"), best["y"].alias("y")))


def bone_scale(points: Column, bones: list[tuple[int, int, float]], least: int = 3) -> Column:
    """Median over the bones (from, to, usual length) of their length by the usual one; null with fewer than `least` of them."""
    ratios = F.array_compact(F.array(*(g.norm(g.minus(point(points, a), point(points, b))) / usual for a, b, usual in bones)))
    ordered, n = F.array_sort(ratios), F.size(ratios)
    low, high = F.element_at(ordered, F.floor((n + 1) / 2).cast("int")), F.element_at(ordered, F.floor(n / 2 + 1).cast("int"))
    return F.when(n >= least, (low + high) / 2)


def cross(a: list[Column], b: list[Column]) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def chirality(points: Column, sure: float = 0.3) -> Column:
    """1 where left and right are labelled as a body has them, -1 where they are mirrored, 0 where it can't be told.

    The face points along (left to right shoulder) x (hips to shoulders); it is the nose against the ears, else the eyes.
    """
    mean = lambda p, q: [F.when(a.isNotNull() & b.isNotNull(), (a + b) / 2) for a, b in zip(p, q, strict=True)]
    either = lambda p, q: [F.when(a.isNull(), b).when(b.isNull(), a).otherwise((a + b) / 2) for a, b in zip(p, q, strict=True)]
    face = [F.coalesce(a, b) for a, b in zip(mean(point(points, 3), point(points, 4)), mean(point(points, 1), point(points, 2)), strict=True)]
    left, right = point(points, 5), point(points, 6)
    up = g.minus(mean(left, right), either(point(points, 11), point(points, 12)))
    shown, seen = cross(g.minus(left, right), up), g.minus(point(points, 0), face)
    c = g.dot(shown, seen) / (g.norm(shown) * g.norm(seen) + 1e-12)
    return F.when(c > sure, 1).when(c < -sure, -1).otherwise(0)
