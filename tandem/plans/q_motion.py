"""Queries on turning, lags and fits; with the same rows in SQL where no rotation has to be found."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tandem.operators import fits, motion
from tandem.sources import fixtures as fx

from .oracle import nearest_to_rays, sql
from .registry import query

ID = ["recording_id"]
Q = ["qx", "qy", "qz", "qw"]


def _rounded(df: DataFrame, *names: str, digits: int = 5) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


def _sensor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Poses as a sensor's samples: every sixth repeats the one before, after every ten comes a gap."""
    w = Window.partitionBy("recording_id").orderBy("frame")
    again = (F.col("frame") % 6 == 0) & (F.col("frame") > 0)
    held = {c: F.when(again, F.lag(c).over(w)).otherwise(F.col(c)) for c in Q}
    return fx.poses(spark, sf_dir).withColumns(held).select("recording_id", F.expr("cast(frame + 3 * (frame div 10) AS double)").alias("t"), *Q)


_SENSOR = """s AS (SELECT recording_id, CAST(frame + 3 * (frame // 10) AS DOUBLE) AS t, """ + ", ".join(f"CASE WHEN frame % 6 = 0 AND frame > 0 THEN lag({c}) OVER w ELSE {c} END AS {c}" for c in Q) + """ FROM poses WINDOW w AS (PARTITION BY recording_id ORDER BY frame)),
a AS (SELECT *, t - lag(t) OVER w AS dt, lead(t) OVER w AS lt, lag(qx) OVER w IS DISTINCT FROM qx OR lag(qy) OVER w IS DISTINCT FROM qy OR lag(qz) OVER w IS DISTINCT FROM qz OR lag(qw) OVER w IS DISTINCT FROM qw AS other FROM s WINDOW w AS (PARTITION BY recording_id ORDER BY t)),
b AS (SELECT *, dt IS NULL OR other OR lt IS NULL AS knot, sum(CASE WHEN dt > 2 THEN 1 ELSE 0 END) OVER w AS gaps, sum(CASE WHEN dt <= 2 THEN dt ELSE 0 END) OVER w AS valid FROM a WINDOW w AS (PARTITION BY recording_id ORDER BY t)),
k AS (SELECT *, CASE WHEN gaps = lag(gaps) OVER w THEN 2 * acos(least(1, abs(qx * lag(qx) OVER w + qy * lag(qy) OVER w + qz * lag(qz) OVER w + qw * lag(qw) OVER w))) ELSE 0 END AS turn FROM b WHERE knot WINDOW w AS (PARTITION BY recording_id ORDER BY t)),
p AS (SELECT recording_id, t, sum(turn) OVER (PARTITION BY recording_id ORDER BY t) AS path FROM k), n AS (SELECT *, lead(t) OVER w AS nt, lead(path) OVER w AS np FROM p WINDOW w AS (PARTITION BY recording_id ORDER BY t)),
z AS (SELECT b.recording_id, b.t, b.valid, CASE WHEN b.t = n.t THEN n.path ELSE n.path + (n.np - n.path) * (b.t - n.t) / (n.nt - n.t) END AS path FROM b ASOF JOIN n ON b.recording_id = n.recording_id AND b.t >= n.t)
"""


@query(sql("poses", _SENSOR + "SELECT recording_id, t, round(path, 5) AS path, round(valid, 5) AS valid FROM z"))
def angular_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(motion.angular_path(_sensor(spark, sf_dir), ID, 2.0).select("recording_id", "t", "path", "valid"), "path", "valid")


@query(sql("poses", _SENSOR + """, i AS (SELECT recording_id, CAST(t AS BIGINT) AS id, t - 0.75 AS a, t + 1.25 AS b FROM s WHERE CAST(t AS BIGINT) % 2 = 0),
f AS (SELECT *, lead(t) OVER w AS nt, lead(path) OVER w AS np, lead(valid) OVER w AS nv FROM z WINDOW w AS (PARTITION BY recording_id ORDER BY t)),
x AS (SELECT i.*, f.path + coalesce((f.np - f.path) * (a - f.t) / (f.nt - f.t), 0) AS pa, f.valid + coalesce((f.nv - f.valid) * (a - f.t) / (f.nt - f.t), 0) AS va FROM i ASOF LEFT JOIN f ON i.recording_id = f.recording_id AND i.a >= f.t),
y AS (SELECT x.*, CASE WHEN f.nt IS NULL AND b > f.t THEN NULL ELSE f.path + coalesce((f.np - f.path) * (b - f.t) / (f.nt - f.t), 0) END AS pb, f.valid + coalesce((f.nv - f.valid) * (b - f.t) / (f.nt - f.t), 0) AS vb FROM x ASOF LEFT JOIN f ON x.recording_id = f.recording_id AND x.b >= f.t)
SELECT recording_id, id, CASE WHEN (vb - va) / (b - a) >= 0.9 THEN round((pb - pa) / (b - a), 5) END AS speed FROM y"""))
def interval_speed(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _sensor(spark, sf_dir)
    asked = s.filter("cast(t AS long) % 2 = 0").selectExpr("recording_id", "cast(t AS long) AS id", "t - 0.75D AS start", "t + 1.25D AS end")
    return _rounded(motion.interval_speed(motion.angular_path(s, ID, 2.0), asked, ID), "speed")


@query(sql("poses", """s AS (SELECT recording_id, frame * 10.0 AS t, qx, qy, qz, qw, lead(frame * 10.0) OVER w AS nt, """ + ", ".join(f"lead({c}) OVER w AS n{c}" for c in Q) + """ FROM poses WINDOW w AS (PARTITION BY recording_id ORDER BY frame)),
a AS (SELECT recording_id, vec_id, frame * 10.0 + vec_id % 13 - 4 AS t FROM poses), j AS (SELECT a.vec_id, a.recording_id, a.t AS asked, s.* EXCLUDE (recording_id) FROM a ASOF LEFT JOIN s ON a.recording_id = s.recording_id AND a.t >= s.t),
d AS (SELECT *, (asked - t) / (nt - t) AS h, CASE WHEN qx * nqx + qy * nqy + qz * nqz + qw * nqw < 0 THEN -1 ELSE 1 END AS sg, acos(least(1, abs(qx * nqx + qy * nqy + qz * nqz + qw * nqw))) AS g FROM j)
SELECT recording_id, CAST(asked AS DOUBLE) AS t, """ + ", ".join(f"round(CASE WHEN asked = t THEN {c} WHEN nt IS NULL THEN NULL ELSE sin((1 - h) * g) / sin(g) * {c} + sg * sin(h * g) / sin(g) * n{c} END, 5) AS {c}" for c in Q) + " FROM d"))
def slerp_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = fx.poses(spark, sf_dir)
    samples = p.select("recording_id", (F.col("frame") * 10.0).alias("t"), *Q)
    asked = p.select("recording_id", (F.col("frame") * 10.0 + F.col("vec_id") % 13 - 4).alias("t"))
    return _rounded(motion.slerp_at(samples, asked, ID, 20.0), *Q)


@query(sql("frames6", """l AS (SELECT a.recording_id, o AS lag, count(*) AS n, CASE WHEN stddev_pop(b.val) * stddev_pop(a.val) > 1e-12 THEN covar_pop(b.val, a.val) / (stddev_pop(a.val) * stddev_pop(b.val)) END AS r
  FROM (SELECT * FROM frames6 WHERE role = 1 AND val IS NOT NULL) a, range(-4, 5) t(o), (SELECT * FROM frames6 WHERE role = 0 AND val IS NOT NULL) b WHERE b.recording_id = a.recording_id AND b.frame = a.frame + o GROUP BY ALL)
SELECT recording_id, CAST(lag AS INT) AS lag, n, round(r, 6) AS r, round(r * sqrt(n), 6) AS score FROM l WHERE n >= 5 AND r IS NOT NULL"""))
def lag_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fx.frames(spark, sf_dir, 6)
    return _rounded(motion.lag_scores(f.filter("role = 0"), f.filter("role = 1"), ID, "val", 4, 5), "r", "score", digits=6)


@query()
def audio_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fx.frames(spark, sf_dir, 6)
    return motion.audio_offset(f.filter("role = 0"), f.filter("role = 1"), ID, "val", 4, 5, 2)


@query()
def mean_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fits.mean_rotation(fx.poses(spark, sf_dir), ID, "recording_id long")


@query()
def alignment_study(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Poses against themselves moved and bent a little: how well one transform explains it, by held-out pairs."""
    moved = fx.poses(spark, sf_dir).selectExpr("vec_id", "x AS ax", "y AS ay", "z AS az", "y + 1 AS bx", "-x + 0.01 * qx AS by", "z + 2 + 0.01 * qy AS bz")
    return fits.alignment_study(moved, "vec_id", 0.01)


@query(sql("poses", """r AS (SELECT recording_id, frame // 6 AS part, vec_id AS i, abs(x) * 10 AS d, 0.5 * abs(x) * 10 + 0.2 + y * 0.2 AS y FROM poses), v AS (SELECT * FROM r WHERE y > 0),
p AS (SELECT a.recording_id, a.part, a.i AS i1, b.i AS i2, (b.y - a.y) / (b.d - a.d) AS a0, a.y - (b.y - a.y) / (b.d - a.d) * a.d AS b0 FROM v a JOIN v b ON a.recording_id = b.recording_id AND a.part = b.part AND a.i < b.i AND a.d <> b.d),
c AS (SELECT p.*, count(*) FILTER (abs(a0 * d + b0 - y) <= 0.02) AS n FROM p JOIN v ON v.recording_id = p.recording_id AND v.part = p.part GROUP BY ALL),
h AS (SELECT recording_id, part, arg_min(a0, struct_pack(n := -n, a := i1, b := i2)) AS a0, arg_min(b0, struct_pack(n := -n, a := i1, b := i2)) AS b0 FROM c GROUP BY ALL)
SELECT recording_id, part, round(regr_slope(y, d), 4) AS a, round(regr_intercept(y, d), 4) AS b, count(*) AS n FROM v JOIN h USING (recording_id, part) WHERE abs(a0 * d + b0 - y) <= 0.02 GROUP BY ALL"""))
def fit_inverse_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    anchors = fx.poses(spark, sf_dir).selectExpr("recording_id", "frame div 6 AS part", "vec_id AS i", "abs(x) * 10 AS d", "1 / nullif(0.5 * abs(x) * 10 + 0.2 + y * 0.2, 0) AS z")
    return _rounded(fits.fit_inverse_depth(anchors, ["recording_id", "part"], 0.02), "a", "b", digits=4)


@query(sql("poses", nearest_to_rays("r AS (SELECT recording_id, frame // 4 AS part, x AS ox, y AS oy, z AS oz, qx / nrm AS ux, qy / nrm AS uy, qz / nrm AS uz, 1.0 AS w FROM (SELECT *, sqrt(qx * qx + qy * qy + qz * qz) AS nrm FROM poses))")))
def triangulate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rays = fx.poses(spark, sf_dir).selectExpr("recording_id", "frame div 4 AS part", "x AS ox", "y AS oy", "z AS oz", "qx AS dx", "qy AS dy", "qz AS dz")
    return _rounded(fits.triangulate(rays, ["recording_id", "part"]), "x", "y", "z", digits=3)


@query("""SELECT l_partkey % 500 AS pixel, CASE WHEN count(*) FILTER (l_linestatus <> 'F') >= 5 THEN round(quantile_cont(l_extendedprice, 0.5) FILTER (l_linestatus <> 'F'), 4) END AS median, count(*) FILTER (l_linestatus <> 'F') AS support FROM lineitem GROUP BY 1""")
def masked_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = fx.table(spark, sf_dir, "lineitem").selectExpr("l_partkey % 500 AS pixel", "l_extendedprice AS v", "l_linestatus = 'F' AS masked")
    return _rounded(fits.masked_median(pixels, ["pixel"], "v", "masked", 5), "median", digits=4)


@query(sql("poses", """p AS (SELECT recording_id, frame, qx, qy, qz, x, y, z FROM poses)
SELECT recording_id, frame, round(degrees(acos(greatest(-1, least(1, (qx * x + qy * y + qz * z) / (sqrt(qx * qx + qy * qy + qz * qz) * sqrt(x * x + y * y + z * z)))))), 4) AS flexion FROM p"""))
def elbow_angle(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = fx.poses(spark, sf_dir).select("recording_id", "frame", "qx", "qy", "qz", "x", "y", "z")
    return _rounded(motion.elbow_angle(p, ["qx", "qy", "qz"], ["x", "y", "z"]).select("recording_id", "frame", "flexion"), "flexion", digits=4)
