"""Rotations, rigid transforms, gaze and projection as column expressions.

A vector is three columns, a quaternion (x, y, z, w) four, a rotation nine in row order; all stay inside generated code.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = list[Column]


def cols(*names: str) -> Vec:
    return [F.col(n) for n in names]


def dot(a: Vec, b: Vec) -> Column:
    out = a[0] * b[0]
    for x, y in zip(a[1:], b[1:], strict=True):
        out = out + x * y
    return out


def norm(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def minus(a: Vec, b: Vec) -> Vec:
    return [x - y for x, y in zip(a, b, strict=True)]


def normalized(a: Vec) -> Vec:
    """a at length 1; null for a null vector or one of length 0."""
    n = norm(a)
    return [F.when(n > 0, x / n) for x in a]


def rotation(q: Vec, tolerance: float | None = 1e-6) -> Vec:
    """Rotation of a quaternion. With a tolerance, quaternions whose length is off 1 by more give null and none is repaired;
    without, every quaternion is brought to length 1 first."""
    n = norm(q)
    return unit_rotation(normalized(q) if tolerance is None else [F.when(F.abs(n - 1) <= tolerance, c) for c in q])


def unit_rotation(q: Vec) -> Vec:
    """Rotation of a quaternion that is known to have length 1."""
    x, y, z, w = q
    return [
        1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w),
        2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w),
        2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y),
    ]


def product(a: Vec, b: Vec) -> Vec:
    """Of two rotations."""
    return [dot([a[3 * i], a[3 * i + 1], a[3 * i + 2]], [b[j], b[3 + j], b[6 + j]]) for i in range(3) for j in range(3)]


def transposed(r: Vec) -> Vec:
    return [r[3 * j + i] for i in range(3) for j in range(3)]


def turned(r: Vec, p: Vec) -> Vec:
    return [dot([r[3 * i], r[3 * i + 1], r[3 * i + 2]], p) for i in range(3)]


def applied(r: Vec, t: Vec, p: Vec) -> Vec:
    """The point p by the rigid transform (r, t)."""
    return [a + b for a, b in zip(turned(r, p), t, strict=True)]


def inverse(r: Vec, t: Vec) -> tuple[Vec, Vec]:
    back = transposed(r)
    return back, [-x for x in turned(back, t)]


def composed(r1: Vec, t1: Vec, r2: Vec, t2: Vec) -> tuple[Vec, Vec]:
    """First (r2, t2), then (r1, t1)."""
    return product(r1, r2), applied(r1, t1, t2)


def determinant(r: Vec) -> Column:
    return r[0] * (r[4] * r[8] - r[5] * r[7]) - r[1] * (r[3] * r[8] - r[5] * r[6]) + r[2] * (r[3] * r[7] - r[4] * r[6])


def rigid_errors(r: Vec, tolerance: float = 1e-8) -> Column:
    """What is wrong with a rotation, as a list: not_finite, not_orthonormal, not_right_handed."""
    finite = F.lit(True)
    for c in r:
        finite = finite & c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    p = product(r, transposed(r))
    off = F.greatest(*(F.abs(c - (1.0 if k in (0, 4, 8) else 0.0)) for k, c in enumerate(p)))
    return F.when(~finite, F.array(F.lit("not_finite"))).otherwise(
        F.array_compact(F.array(F.when(off > tolerance, F.lit("not_orthonormal")), F.when(F.abs(determinant(r) - 1) > tolerance, F.lit("not_right_handed"))))
    )


def rotation_angle(r: Vec) -> Column:
    """Angle of a rotation in radians, stable near 0 and pi."""
    skew = [r[7] - r[5], r[2] - r[6], r[3] - r[1]]
    return F.atan2(norm(skew), r[0] + r[4] + r[8] - 1)


def quaternion_angle(a: Vec, b: Vec) -> Column:
    """The angle, in radians, by which unit quaternion b is turned against a."""
    x1, y1, z1, w1 = a
    x2, y2, z2, w2 = b
    v = [w1 * x2 - w2 * x1 - y1 * z2 + z1 * y2, w1 * y2 - w2 * y1 - z1 * x2 + x1 * z2, w1 * z2 - w2 * z1 - x1 * y2 + y1 * x2]
    return 2 * F.atan2(norm(v), F.abs(dot(a, b)))


def angle_degrees(a: Vec, b: Vec) -> Column:
    """Angle between two vectors; null if one has length 0."""
    n = norm(a) * norm(b)
    return F.when(n > 0, F.degrees(F.acos(F.greatest(F.least(dot(a, b) / n, F.lit(1.0)), F.lit(-1.0)))))


def gaze_point(yaw: Column, pitch: Column, depth: Column) -> Vec:
    """Point that a gaze meets: depth outside (0, 10) counts as 1 m."""
    far = F.when((depth > 0) & (depth < 10), depth).otherwise(F.lit(1.0))
    direction = normalized([F.tan(yaw), F.tan(pitch), F.lit(1.0)])
    return [c * far for c in direction]


def fisheye(p: Vec, focal: float, cx: float, cy: float) -> Vec:
    """Equidistant projection of a point before the camera; null behind it."""
    radial = F.hypot(p[0], p[1])
    scale = F.when(radial > 1e-12, F.atan2(radial, p[2]) / radial).otherwise(F.lit(0.0)) * focal
    ahead = p[2] > 0
    return [F.when(ahead, p[0] * scale + cx), F.when(ahead, p[1] * scale + cy)]


def pinhole(p: Vec, focal: float, cx: float, cy: float) -> Vec:
    """Pixel of a point before the camera; null behind it."""
    ahead = p[2] > 0
    return [F.when(ahead, p[0] / p[2] * focal + cx), F.when(ahead, p[1] / p[2] * focal + cy)]
