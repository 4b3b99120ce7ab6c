"""Queries on poses, gaze, boxes and vectors, with the same rows in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tandem.functions import geometry as g
from tandem.functions import scalar as s
from tandem.operators import boxes as bx
from tandem.operators import checks
from tandem.operators import vectors as vec
from tandem.sources import fixtures as fx

from .oracle import recursive, sql
from .registry import also, query


def _q() -> list:
    return g.cols("qx", "qy", "qz", "qw")


def _p() -> list:
    return g.cols("x", "y", "z")


R9 = [f"r{i}{j}" for i in range(3) for j in range(3)]

#: The rotation's entries in SQL.
_ROT = {
    "r00": "1 - 2 * (qy * qy + qz * qz)", "r01": "2 * (qx * qy - qz * qw)", "r02": "2 * (qx * qz + qy * qw)",
    "r10": "2 * (qx * qy + qz * qw)", "r11": "1 - 2 * (qx * qx + qz * qz)", "r12": "2 * (qy * qz - qx * qw)",
    "r20": "2 * (qx * qz - qy * qw)", "r21": "2 * (qy * qz + qx * qw)", "r22": "1 - 2 * (qx * qx + qy * qy)",
}
_R = "r AS (SELECT *, " + ", ".join(f"{e} AS {n}" for n, e in _ROT.items()) + " FROM poses)"


def _round(*pairs: tuple) -> list:
    return [F.round(c, 6).alias(n) for n, c in pairs]


@query(sql("poses", _R + " SELECT recording_id, frame, " + ", ".join(f"round({n}, 6) AS {n}" for n in R9) + " FROM r"))
def quaternion_to_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.poses(spark, sf_dir).select("recording_id", "frame", *_round(*zip(R9, g.rotation(_q()), strict=True)))


@query(sql("poses", "SELECT recording_id, frame, CASE WHEN frame % 5 = 0 THEN ['not_orthonormal', 'not_right_handed'] WHEN frame % 5 = 1 THEN ['not_finite'] WHEN frame % 5 = 2 THEN ['not_right_handed'] ELSE [] END AS errors FROM poses"))
def rigid_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    poses = fx.poses(spark, sf_dir).select("recording_id", "frame", *(c.alias(n) for n, c in zip(R9, g.rotation(_q()), strict=True)))
    kind = F.col("frame") % 5
    bent = [F.when(kind == 0, 1.1 * F.col(n)).when((kind == 1) & F.lit(n == "r11"), F.lit(None)).when(kind == 2, -F.col(n)).otherwise(F.col(n)) for n in R9]
    return poses.select("recording_id", "frame", g.rigid_errors(bent).alias("errors"))


_LAG = "l AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py, lag(z) OVER w AS pz, " + ", ".join(f"lag({n}) OVER w AS p{n}" for n in R9) + " FROM r WINDOW w AS (PARTITION BY recording_id ORDER BY frame))"


def _with_previous(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("recording_id").orderBy("frame")
    poses = fx.poses(spark, sf_dir).withColumns(dict(zip(R9, g.rotation(_q()), strict=True)))
    return poses.withColumns({f"p{c}": F.lag(c).over(w) for c in ["x", "y", "z", *R9]})


@query(sql("poses", _R + ", " + _LAG + """ SELECT recording_id, frame, round(px + r00 * 1 + r01 * 2 + r02 * 3, 6) IS NOT NULL AS has_previous,
round(r00 * px + r01 * py + r02 * pz + x, 6) AS wx, round(r10 * px + r11 * py + r12 * pz + y, 6) AS wy, round(r20 * px + r21 * py + r22 * pz + z, 6) AS wz,
round(r00 * (px - x) + r10 * (py - y) + r20 * (pz - z), 6) AS dx, round(r01 * (px - x) + r11 * (py - y) + r21 * (pz - z), 6) AS dy, round(r02 * (px - x) + r12 * (py - y) + r22 * (pz - z), 6) AS dz FROM l"""))  # fmt: skip
def transform_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The previous position as a device point into the world, and as a world point into the device."""
    r, p = g.cols(*R9), g.cols("px", "py", "pz")
    back = g.inverse(r, _p())
    return _with_previous(spark, sf_dir).select("recording_id", "frame", F.col("px").isNotNull().alias("has_previous"), *_round(*zip(("wx", "wy", "wz"), g.applied(r, _p(), p), strict=True), *zip(("dx", "dy", "dz"), g.applied(*back, p), strict=True)))


@query(sql("poses", _R + ", " + _LAG + """, d AS (SELECT recording_id, frame,
r00*pr00+r10*pr10+r20*pr20 + r01*pr01+r11*pr11+r21*pr21 + r02*pr02+r12*pr12+r22*pr22 AS tr FROM l)
SELECT recording_id, frame, CASE WHEN tr IS NOT NULL THEN round(degrees(acos(greatest(least((tr - 1) / 2, 1), -1))), 4) END AS turned FROM d"""))  # fmt: skip
def rotation_angle(spark: SparkSession, sf_dir: str) -> DataFrame:
    relative = g.product(g.transposed(g.cols(*R9)), g.cols(*(f"p{n}" for n in R9)))
    return _with_previous(spark, sf_dir).select("recording_id", "frame", F.round(F.degrees(g.rotation_angle(relative)), 4).alias("turned"))


@query(sql("poses", _R + ", " + _LAG + """, m AS (SELECT *, sqrt((x-px)*(x-px)+(y-py)*(y-py)+(z-pz)*(z-pz)) AS step FROM l)
SELECT recording_id, count(*) AS n_poses, count(step) AS n_steps, round(max(step), 6) AS max_step, count(*) FILTER (step > 0.6) AS n_fast, round(sum(step), 6) AS path,
round(sqrt((arg_max(x, frame) - arg_min(x, frame)) ** 2 + (arg_max(y, frame) - arg_min(y, frame)) ** 2 + (arg_max(z, frame) - arg_min(z, frame)) ** 2), 6) AS net,
round(max(x) - min(x), 6) AS extent_x, CASE WHEN count(step) = 0 THEN 'INSUFFICIENT_DATA' WHEN count(*) FILTER (step > 0.6) > 0 THEN 'FAIL' ELSE 'PASS' END AS status FROM m GROUP BY recording_id"""))  # fmt: skip
def qc_motion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps, path length, net displacement, extent and a status per trajectory."""
    step = g.norm(g.minus(_p(), g.cols("px", "py", "pz")))
    ends = [F.max(F.struct("frame", c))[c] - F.min(F.struct("frame", c))[c] for c in ("x", "y", "z")]
    out = _with_previous(spark, sf_dir).withColumn("step", step).groupBy("recording_id").agg(
        F.count(F.lit(1)).alias("n_poses"), F.count("step").alias("n_steps"), F.round(F.max("step"), 6).alias("max_step"), F.count_if(F.col("step") > 0.6).alias("n_fast"),
        F.round(F.sum("step"), 6).alias("path"), F.round(g.norm(ends), 6).alias("net"), F.round(F.max("x") - F.min("x"), 6).alias("extent_x"),
    )
    return out.withColumn("status", F.when(F.col("n_steps") == 0, "INSUFFICIENT_DATA").when(F.col("n_fast") > 0, "FAIL").otherwise("PASS"))


@query(sql("poses", """
t AS (SELECT recording_id, frame - CASE WHEN vec_id % 29 = 0 THEN 1 ELSE 0 END AS t, frame, x, y, z, qx, qy, qz, CASE WHEN vec_id % 7 = 0 THEN qw + 0.3 WHEN vec_id % 31 = 0 THEN NULL ELSE qw END AS qw, CASE WHEN vec_id % 5 = 0 THEN -1 ELSE frame END AS utc FROM poses),
v AS (SELECT *, abs(sqrt(qx*qx+qy*qy+qz*qz+qw*qw) - 1) AS off, NOT coalesce(abs(sqrt(qx*qx+qy*qy+qz*qz+qw*qw) - 1) <= 1e-6, false) AS bad, row_number() OVER (PARTITION BY recording_id, NOT coalesce(abs(sqrt(qx*qx+qy*qy+qz*qz+qw*qw) - 1) <= 1e-6, false) ORDER BY t, frame) AS k FROM t)
SELECT recording_id, count(*) AS n, count(*) - count(DISTINCT t) AS n_duplicate_times, min(t) AS first_t, max(t) AS last_t, count(*) FILTER (utc = -1) AS n_no_utc, round(max(off), 6) AS max_norm_error, count(*) FILTER (bad) AS n_invalid,
coalesce(list(frame ORDER BY t, frame) FILTER (bad AND k <= 10), []) AS invalid, round(arg_min(x, struct_pack(t := t, i := frame)), 6) AS first_x, round(arg_max(x, struct_pack(t := t, i := frame)), 6) AS last_x FROM v GROUP BY 1"""))  # fmt: skip
def audit_trajectory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Poses with some quaternions bent or missing, some times repeated and some UTC times unknown."""
    p = fx.poses(spark, sf_dir).selectExpr(
        "recording_id", "cast(frame - if(vec_id % 29 = 0, 1, 0) AS long) AS t", "cast(frame AS long) AS idx", "x", "y", "z", "qx", "qy", "qz", "CASE WHEN vec_id % 7 = 0 THEN qw + 0.3 WHEN vec_id % 31 = 0 THEN null ELSE qw END AS qw",
        "if(vec_id % 5 = 0, -1, frame) AS utc",
    )
    out = checks.audit_trajectory(p, ["recording_id"])
    return out.select("recording_id", "n", "n_duplicate_times", "first_t", "last_t", "n_no_utc", F.round("max_norm_error", 6).alias("max_norm_error"), "n_invalid", "invalid", *(F.round(F.col(f"{e}_position.x"), 6).alias(f"{e}_x") for e in ("first", "last")))


@query(sql("poses", """
a AS (SELECT recording_id, frame, x, y, z, CASE WHEN vec_id % 3 = 0 THEN 12.0 ELSE abs(x) * 10 END AS depth FROM poses),
d AS (SELECT *, sqrt(tan(x) * tan(x) + tan(y) * tan(y) + 1) AS n, CASE WHEN depth > 0 AND depth < 10 THEN depth ELSE 1 END AS f FROM a)
SELECT recording_id, frame, round(tan(x) / n * f, 6) AS gx, round(tan(y) / n * f, 6) AS gy, round(1 / n * f, 6) AS gz FROM d"""))  # fmt: skip
def gaze_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    depth = F.when(F.col("vec_id") % 3 == 0, 12.0).otherwise(F.abs("x") * 10)
    return fx.poses(spark, sf_dir).select("recording_id", "frame", *_round(*zip(("gx", "gy", "gz"), g.gaze_point(F.col("x"), F.col("y"), depth), strict=True)))


@query(sql("poses", """
a AS (SELECT *, CASE WHEN z > 0 THEN atan2(sqrt(x * x + y * y), z) / sqrt(x * x + y * y) * 250 END AS k FROM poses)
SELECT recording_id, frame, round(x * k + 320, 6) AS u, round(y * k + 240, 6) AS v, round(CASE WHEN z > 0 THEN x / z * 250 + 320 END, 6) AS pu, round(CASE WHEN z > 0 THEN y / z * 250 + 240 END, 6) AS pv FROM a"""))  # fmt: skip
def project_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fisheye and pinhole pixels; null behind the camera."""
    return fx.poses(spark, sf_dir).select("recording_id", "frame", *_round(*zip(("u", "v"), g.fisheye(_p(), 250, 320, 240), strict=True), *zip(("pu", "pv"), g.pinhole(_p(), 250, 320, 240), strict=True)))


@query(sql("poses", """
p AS (SELECT *, CASE WHEN z > 0 THEN x / z * 250 + 320 END AS u, CASE WHEN z > 0 THEN y / z * 250 + 240 END AS v FROM poses)
SELECT recording_id, count(*) AS n_tracked, count(u) AS n_evaluable, count(*) FILTER (u BETWEEN 0 AND 640 AND v BETWEEN 0 AND 480) AS n_inside, round(count(*) FILTER (u BETWEEN 0 AND 640 AND v BETWEEN 0 AND 480) / nullif(count(u), 0), 6) AS fraction,
CASE WHEN count(u) = 0 THEN 'INSUFFICIENT_DATA' WHEN count(*) FILTER (u BETWEEN 0 AND 640 AND v BETWEEN 0 AND 480) >= 0.5 * count(u) THEN 'PASS' ELSE 'FAIL' END AS status FROM p GROUP BY 1"""))  # fmt: skip
def projection_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points that were tracked, can be projected, and lie in the image."""
    u, v = g.pinhole(_p(), 250, 320, 240)
    inside = u.between(0, 640) & v.between(0, 480)
    out = fx.poses(spark, sf_dir).groupBy("recording_id").agg(F.count(F.lit(1)).alias("n_tracked"), F.count(u).alias("n_evaluable"), F.count_if(inside).alias("n_inside"))
    status = F.when(F.col("n_evaluable") == 0, "INSUFFICIENT_DATA").when(F.col("n_inside") >= 0.5 * F.col("n_evaluable"), "PASS").otherwise("FAIL")
    return out.withColumns({"fraction": F.round(F.try_divide("n_inside", "n_evaluable"), 6), "status": status})


@query(sql("poses", """
a AS (SELECT p.recording_id, p.frame, degrees(acos(greatest(least(p.z / sqrt(p.x*p.x+p.y*p.y+p.z*p.z), 1), -1))) AS angle FROM poses p)
SELECT recording_id, round(quantile_cont(angle, 0.5), 6) AS median, round(avg(angle), 6) AS mean, round(count(*) FILTER (angle < 60) / count(*), 6) AS near FROM a GROUP BY 1"""))  # fmt: skip
def gaze_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The angle of each direction to the camera axis: its median, mean and share under 60 degrees."""
    angle = g.angle_degrees(_p(), [F.lit(0.0), F.lit(0.0), F.lit(1.0)])
    return fx.poses(spark, sf_dir).withColumn("angle", angle).groupBy("recording_id").agg(
        F.round(F.percentile("angle", F.lit(0.5)), 6).alias("median"), F.round(F.avg("angle"), 6).alias("mean"), F.round(F.count_if(F.col("angle") < 60) / F.count(F.lit(1)), 6).alias("near"))


@query(sql("poses", """
p AS (SELECT a.recording_id, a.frame, b.frame AS other, sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)) AS d FROM poses a JOIN poses b ON a.recording_id = b.recording_id AND b.frame // 4 = a.frame // 4 AND a.frame % 4 < 2 AND b.frame % 4 >= 2)
SELECT recording_id, frame // 4 AS moment, round(min(d), 6) AS distance FROM p GROUP BY ALL"""))  # fmt: skip
def cross_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least distance between two people's points of the same moment."""
    points = fx.poses(spark, sf_dir).withColumn("moment", F.expr("cast(frame div 4 AS bigint)"))
    return vec.cross_distance(points.filter("frame % 4 < 2"), points.filter("frame % 4 >= 2"), ["recording_id", "moment"]).withColumn("distance", F.round("distance", 6))


@query(sql("poses", "SELECT recording_id, count(*) AS n, round(min(x), 6) AS min_x, round(max(x), 6) AS max_x, round(quantile_cont(y, 0.01), 6) AS p1_y, round(quantile_cont(y, 0.5), 6) AS p50_y, round(quantile_cont(y, 0.99), 6) AS p99_y, round(sqrt((max(x)-min(x))**2 + (max(y)-min(y))**2 + (max(z)-min(z))**2), 6) AS diagonal FROM poses GROUP BY 1"))
def cloud_qc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds, percentiles and diagonal of a point cloud."""
    return fx.poses(spark, sf_dir).groupBy("recording_id").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.min("x"), 6).alias("min_x"), F.round(F.max("x"), 6).alias("max_x"),
        *(F.round(F.percentile("y", F.lit(p)), 6).alias(f"p{round(100 * p)}_y") for p in (0.01, 0.5, 0.99)),
        F.round(g.norm([F.max(c) - F.min(c) for c in ("x", "y", "z")]), 6).alias("diagonal"),
    )


@query(sql("poses", """
n AS (SELECT recording_id, frame, row_number() OVER (PARTITION BY recording_id ORDER BY frame) - 1 AS i, count(*) OVER (PARTITION BY recording_id) AS n FROM poses)
SELECT recording_id, frame FROM n WHERE i // 4 % ((n + 19) // 20) = 0"""))  # fmt: skip
def block_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every k-th block of 4 points, k such that about 20 points stay."""
    return vec.block_sample(fx.poses(spark, sf_dir).select("recording_id", "frame"), ["recording_id"], 4, 20)


# boxes

_PAIR = """p AS (SELECT a.frame, a.slot AS a_slot, b.slot AS b_slot, a.conf AS a_conf, b.conf AS b_conf,
greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0) AS i, (a.x1-a.x0)*(a.y1-a.y0) AS aa, (b.x1-b.x0)*(b.y1-b.y0) AS ba
FROM boxes a JOIN boxes b ON a.frame = b.frame AND a.slot < b.slot)"""


@query(sql("boxes", _PAIR + " SELECT frame, a_slot, b_slot, round(i / (aa + ba - i), 6) AS iou, round(i / least(aa, ba), 6) AS contained FROM p WHERE i / (aa + ba - i) > 0.2 OR i / least(aa, ba) > 0.8"))
def box_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bx.overlapping_pairs(fx.boxes(spark, sf_dir), ["frame"], 0.2, 0.8)
    return out.withColumns({"iou": F.round("iou", 6), "contained": F.round("contained", 6)})


_FITS = """m AS (SELECT frame, round(avg(x0)) AS px, round(avg(y0)) AS py FROM boxes GROUP BY 1),
c AS (SELECT b.frame, b.slot, b.name, (x1-x0)*(y1-y0) AS area FROM boxes b JOIN m USING (frame) WHERE px BETWEEN x0 - 0.1*(x1-x0) AND x1 + 0.1*(x1-x0) AND py BETWEEN y0 - 0.1*(y1-y0) AND y1 + 0.1*(y1-y0)),
r AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY area, slot, name) AS k FROM c)"""


@query(sql("boxes", _FITS + " SELECT frame, slot, name, round(area, 6) AS area FROM r WHERE k = 1"))
def smallest_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smallest box (grown by a tenth) around the boxes' mean corner in each frame."""
    points = fx.boxes(spark, sf_dir).groupBy("frame").agg(F.round(F.avg("x0")).alias("px"), F.round(F.avg("y0")).alias("py"))
    return bx.smallest_around(points, fx.boxes(spark, sf_dir), ["frame"], 0.1).select("frame", "slot", "name", F.round("area", 6).alias("area"))


@query(sql("boxes", """
l AS (SELECT *, (x0+x1)/2 AS cx, lag((x0+x1)/2) OVER w AS pc, x1-x0 AS width, lag(frame) OVER w AS pf FROM boxes WINDOW w AS (PARTITION BY slot ORDER BY frame, x0, y0, x1)),
n AS (SELECT frame, count(*) AS n FROM boxes GROUP BY 1)
SELECT l.frame, slot, coalesce(round(abs(cx - pc) - 0.4 * width, 6) > 0 AND n.n >= 2 AND pn.n >= 2, false) AS switched FROM l JOIN n ON n.frame = l.frame LEFT JOIN n pn ON pn.frame = pf"""))  # fmt: skip
def switch_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bx.switch_flags(fx.boxes(spark, sf_dir), [])


@query(recursive(sql("boxes", """n AS MATERIALIZED (SELECT frame, slot, conf, struct_pack(x0 := x0, y0 := y0, x1 := x1, y1 := y1) AS b, row_number() OVER (PARTITION BY frame ORDER BY -conf, slot, x0, y0, x1, y1) AS k FROM boxes),
g(frame, k, slot, conf, keep, kept) AS (
  SELECT frame, k, slot, conf, true, [b] FROM n WHERE k = 1
  UNION ALL SELECT frame, k, slot, conf, NOT hit, CASE WHEN hit THEN kept ELSE list_append(kept, b) END FROM (
    SELECT n.*, g.kept, len(list_filter(g.kept, lambda o: greatest(0, least(o.x1, n.b.x1) - greatest(o.x0, n.b.x0)) * greatest(0, least(o.y1, n.b.y1) - greatest(o.y0, n.b.y0)) >
      0.2 * ((o.x1 - o.x0) * (o.y1 - o.y0) + (n.b.x1 - n.b.x0) * (n.b.y1 - n.b.y0) - greatest(0, least(o.x1, n.b.x1) - greatest(o.x0, n.b.x0)) * greatest(0, least(o.y1, n.b.y1) - greatest(o.y0, n.b.y0))))) > 0 AS hit
    FROM g JOIN n ON n.frame = g.frame AND n.k = g.k + 1))
SELECT frame, slot, round(conf, 6) AS conf FROM g WHERE keep""")))
def nms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes that greedy suppression keeps, the surest first."""
    return bx.nms(fx.boxes(spark, sf_dir), ["frame"], 0.2).withColumn("conf", F.round("conf", 6))


@query(sql("boxes", """
b AS (SELECT *, (x1-x0)*(y1-y0) AS area FROM boxes WHERE (x1-x0)*(y1-y0) <= 20000)
SELECT frame, slot, round(conf, 6) AS conf FROM b WHERE conf >= 0.95 OR EXISTS (SELECT 1 FROM b o WHERE o.frame = b.frame AND o.conf >= 0.95 AND b.x0 <= o.x1 AND o.x0 <= b.x1 AND b.y0 <= o.y1 AND o.y0 <= b.y1)"""))  # fmt: skip
def filter_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bx.plausible(fx.boxes(spark, sf_dir), ["frame"], 20_000.0, 0.95).select("frame", "slot", F.round("conf", 6).alias("conf"))


# vectors

_NEAR = """v AS (SELECT vec_id AS frame, label AS group_id, list_transform(embedding, lambda e: CAST(e AS DOUBLE)) AS v FROM embeddings),
p AS (SELECT a.frame, b.frame AS candidate, sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) ** 2)) / 64) AS rmse FROM v a JOIN v b ON b.frame BETWEEN a.frame - 3 AND a.frame + 3 AND b.frame <> a.frame),
r AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY round(rmse, 9), candidate) AS k FROM p),
t AS (SELECT frame, max(candidate) FILTER (k = 1) AS candidate, max(rmse) FILTER (k = 1) AS best, max(rmse) FILTER (k = 2) AS second FROM r GROUP BY 1)"""


@query(f"WITH {_NEAR} SELECT frame, candidate, round(best, 6) AS best, round(second, 6) AS second, round(second - best, 6) AS margin, best <= 0.17 AND second - best >= 0.002 AND second / best >= 1.02 AS matched FROM t")
def match_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = vec.match_fingerprints(fx.vectors(spark, sf_dir), fx.vectors(spark, sf_dir), 3, 0.17, 0.002, 1.02, same=False)
    return out.withColumns({c: F.round(c, 6) for c in ("best", "second", "margin")})


@query("""WITH v AS (SELECT vec_id AS frame, list_transform(embedding, lambda e: CAST(e AS DOUBLE)) AS v FROM embeddings),
g AS (SELECT * FROM v WHERE frame BETWEEN (SELECT min(frame) + 5 FROM v) AND (SELECT max(frame) - 5 FROM v)),
p AS (SELECT o AS "offset", sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) ** 2)) / 64) AS rmse FROM g a CROSS JOIN range(-5, 6) r(o) JOIN v b ON b.frame = a.frame + o)
SELECT CAST("offset" AS BIGINT) AS "offset", count(*) AS n, round(avg(rmse), 6) AS mean_error FROM p GROUP BY 1 HAVING count(*) = (SELECT count(*) FROM g)""")  # fmt: skip
def offset_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets are all frames that every offset covers."""
    v = fx.vectors(spark, sf_dir)
    ends = v.agg((F.min("frame") + 5).alias("first"), (F.max("frame") - 5).alias("last"))
    targets = v.join(F.broadcast(ends), F.col("frame").between(F.col("first"), F.col("last"))).drop("first", "last")
    return vec.offset_search(targets, v, 5).withColumn("mean_error", F.round("mean_error", 6))


also("offset_search_all", offset_search)

@query("""WITH v AS (SELECT vec_id AS frame, label AS group_id, list_transform(embedding, lambda e: abs(CAST(e AS DOUBLE))) AS v FROM embeddings)
SELECT a.frame, round(sqrt(greatest(1 - list_sum(list_transform(list_zip(a.v, b.v), lambda z: sqrt(z[1] * z[2]))) / sqrt(list_sum(a.v) * list_sum(b.v)), 0)), 6) AS distance FROM v a JOIN v b ON b.frame = a.frame + 1""")  # fmt: skip
def hist_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = fx.vectors(spark, sf_dir).select("frame", F.transform("v", F.abs).alias("v"))
    following = v.select((F.col("frame") - 1).alias("frame"), F.col("v").alias("w"))
    return v.join(following, "frame").select("frame", F.round(s.hist_distance(F.col("v"), F.col("w")), 6).alias("distance"))
