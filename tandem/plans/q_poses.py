"""Queries on sets of poses and on thresholds chosen by events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tandem.operators import evaluate, fits, pose_sets
from tandem.sources import fixtures as fx

from .oracle import nearest_to_rays, sql
from .registry import query

ID = ["recording_id"]
_ANGLE = "degrees(2 * acos(least(1, abs(a.qx * b.qx + a.qy * b.qy + a.qz * b.qz + a.qw * b.qw))))"
_FAR = "sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2)"


def _sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five poses in a row as observations of one."""
    return fx.poses(spark, sf_dir).withColumn("part", F.expr("frame div 5")).withColumn("id", F.col("vec_id"))


@query(sql("poses", f"""p AS (SELECT recording_id, frame // 5 AS part, vec_id AS id, x, y, z, qx, qy, qz, qw FROM poses),
d AS (SELECT a.recording_id, a.part, a.id AS i, b.id AS j, {_FAR} AS far, {_ANGLE} AS turn FROM p a JOIN p b ON a.recording_id = b.recording_id AND a.part = b.part),
t AS (SELECT recording_id, part, i, round(sum(CASE WHEN i <> j THEN far / 0.4 + turn / 90 ELSE 0 END), 6) AS total FROM d GROUP BY ALL), m AS (SELECT recording_id, part, arg_min(i, struct_pack(t := total, i := i)) AS medoid FROM t GROUP BY ALL)
SELECT d.recording_id, d.part, j AS id, medoid, far <= 0.4 AND turn <= 90 AS inlier FROM d JOIN m ON m.recording_id = d.recording_id AND m.part = d.part AND d.i = medoid"""))
def pose_inliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pose_sets.inliers(_sets(spark, sf_dir), ["recording_id", "part"], (0.4, 90.0))


@query()
def mean_pose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pose_sets.mean_pose(_sets(spark, sf_dir).withColumn("weight", 1.0 + F.col("vec_id") % 3), ["recording_id", "part"], "recording_id long, part long", (0.4, 90.0))


def _tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four poses in a row as cameras that see a tag in one frame; every third view is ambiguous, its other solution the same pose mirrored."""
    p = fx.poses(spark, sf_dir).selectExpr("recording_id", "frame div 4 AS frame", "frame % 4 AS camera", "vec_id", "vec_id % 7 / 10.0D AS err", "x", "y", "z", "qx", "qy", "qz", "qw")
    second = p.filter("vec_id % 3 = 0").selectExpr("recording_id", "frame", "camera", "vec_id", "err", "x", "y", "-z AS z", "-qx AS qx", "qy", "-qz AS qz", "qw")
    both = p.withColumn("k", F.lit(0)).unionByName(second.withColumn("k", F.lit(1)))
    return both.filter("NOT (frame % 3 = 0 AND camera > 0)")


_TAGS = """p AS (SELECT recording_id, frame // 4 AS frame, frame % 4 AS camera, vec_id, vec_id % 7 / 10.0 AS err, x, y, z, qx, qy, qz, qw FROM poses),
s AS (SELECT * FROM (SELECT *, 0 AS k FROM p UNION ALL SELECT recording_id, frame, camera, vec_id, err, x, y, -z, -qx, qy, -qz, qw, 1 FROM p WHERE vec_id % 3 = 0) WHERE NOT (frame % 3 = 0 AND camera > 0))"""


@query(sql("poses", _TAGS + f""", d AS (SELECT a.recording_id, a.frame, a.camera, a.k, b.camera AS other, b.k AS j, {_FAR} AS far, {_ANGLE} AS turn, b.x, b.y, b.z FROM s a JOIN s b ON a.recording_id = b.recording_id AND a.frame = b.frame AND a.camera <> b.camera),
n AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY recording_id, frame, camera, k, other ORDER BY round(far / 0.4 + turn / 90, 9), j) = 1),
c AS (SELECT recording_id, frame, camera, k, count(*) AS m, sum(x) AS x, sum(y) AS y, sum(z) AS z FROM n WHERE far <= 0.4 AND turn <= 90 GROUP BY ALL)
SELECT s.recording_id, s.frame, s.camera, s.k, 1 + coalesce(m, 0) AS n, round(s.x + coalesce(c.x, 0), 5) AS p0, round(s.y + coalesce(c.y, 0), 5) AS p1, round(s.z + coalesce(c.z, 0), 5) AS p2 FROM s LEFT JOIN c USING (recording_id, frame, camera, k)"""))
def tag_agreements(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pose_sets.agreements(_tags(spark, sf_dir), ID, (0.4, 90.0))
    return out.select("recording_id", "frame", "camera", "k", "n", *(F.round(f"p{i}", 5).alias(f"p{i}") for i in range(3)))


@query()
def fuse_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pose_sets.fuse_tags(_tags(spark, sf_dir), ID, "recording_id long", (0.4, 90.0), 5)


def _rel(p: str) -> str:
    """Quaternion of the turn from the pose before (w) to this one: the first one's inverse, then the second."""
    a, b = [f"w{p}{c}" for c in ("qx", "qy", "qz", "qw")], [f"{p}{c}" for c in ("qx", "qy", "qz", "qw")]
    x, y, z, w = (f"(-{c})" for c in a[:3]), None, None, a[3]
    x, y, z = x
    X, Y, Z, W = b
    return f"[{w} * {X} + {x} * {W} + {y} * {Z} - {z} * {Y}, {w} * {Y} - {x} * {Z} + {y} * {W} + {z} * {X}, {w} * {Z} + {x} * {Y} - {y} * {X} + {z} * {W}, {w} * {W} - {x} * {X} - {y} * {Y} - {z} * {Z}]"


def _step(p: str) -> list[str]:
    """The step seen from the pose before: its rotation's transpose times the difference."""
    x, y, z, w = (f"w{p}{c}" for c in ("qx", "qy", "qz", "qw"))
    d = [f"({p}{c} - w{p}{c})" for c in "xyz"]
    r = [[f"(1 - 2 * ({y} * {y} + {z} * {z}))", f"(2 * ({x} * {y} - {z} * {w}))", f"(2 * ({x} * {z} + {y} * {w}))"], [f"(2 * ({x} * {y} + {z} * {w}))", f"(1 - 2 * ({x} * {x} + {z} * {z}))", f"(2 * ({y} * {z} - {x} * {w}))"], [f"(2 * ({x} * {z} - {y} * {w}))", f"(2 * ({y} * {z} + {x} * {w}))", f"(1 - 2 * ({x} * {x} + {y} * {y}))"]]
    return [" + ".join(f"{r[k][i]} * {d[k]}" for k in range(3)) for i in range(3)]


#: The second device turned by half a turn about z, a metre away and a little off in its own way.
def _paired(a: str, b: str) -> list[str]:
    own = [f"{c} AS {a}{c}" for c in pose_sets.POSE]
    return ["recording_id", "frame AS i", "frame * 1000 AS t", *own, f"-x + 1 + frame % 3 * 0.01 AS {b}x", f"-y AS {b}y", f"z AS {b}z", f"-qy AS {b}qx", f"qx AS {b}qy", f"qw AS {b}qz", f"-qz AS {b}qw"]


_RELATIVE = f"""p AS (SELECT {', '.join(_paired('u', 'v'))} FROM poses), l AS (SELECT *, {', '.join(f'lag({c}, 3) OVER w AS w{c}' for c in ['t', *(f'{p}{c}' for p in 'uv' for c in pose_sets.POSE)])} FROM p WINDOW w AS (PARTITION BY recording_id ORDER BY i)),
m AS (SELECT recording_id, i, t, t - wt AS elapsed, {_rel('u')} AS ra, {_rel('v')} AS rb, {', '.join(f'{s} AS s{p}{k}' for p in 'uv' for k, s in enumerate(_step(p)))} FROM l WHERE wt IS NOT NULL),
z AS (SELECT recording_id, i, t, elapsed, sqrt((su0 - sv0) ** 2 + (su1 - sv1) ** 2 + (su2 - sv2) ** 2) AS distance, degrees(2 * acos(least(1, abs(list_dot_product(ra, rb))))) AS angle FROM m)"""


def _motion(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = fx.poses(spark, sf_dir).selectExpr(*_paired("a_", "b_"))
    return pose_sets.relative_motion(pairs.withColumn("t", F.col("t").cast("long")), ID, 3)


@query(sql("poses", _RELATIVE + "SELECT recording_id, i, elapsed, round(distance, 5) AS distance, round(angle, 2) AS angle FROM z"))
def relative_motion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _motion(spark, sf_dir).withColumns({"distance": F.round("distance", 5), "angle": F.round("angle", 2)})


@query(sql("poses", _RELATIVE + """, b AS (SELECT *, (t - min(t) OVER (PARTITION BY recording_id)) * 10 // (max(t) OVER (PARTITION BY recording_id) - min(t) OVER (PARTITION BY recording_id) + 1) AS bin FROM z)
SELECT recording_id, CAST(bin AS INT) AS bin, count(*) AS n, round(quantile_cont(distance, 0.5), 5) AS distance_p50, round(quantile_cont(distance, 0.95), 5) AS distance_p95, round(max(distance), 5) AS distance_max FROM b GROUP BY ALL"""))
def motion_by_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _motion(spark, sf_dir).withColumn("t", (F.col("i") * 1000).cast("long"))
    out = pose_sets.time_bins(rows, ID, ["distance"])
    return out.withColumns({c: F.round(c, 5) for c in out.columns if c.startswith("distance")})


@query(sql("poses", nearest_to_rays("r AS (SELECT recording_id, frame // 4 AS part, x AS ox, y AS oy, z AS oz, qx / nrm AS ux, qy / nrm AS uy, qz / nrm AS uz, 1.0 + vec_id % 3 AS w FROM (SELECT *, sqrt(qx * qx + qy * qy + qz * qz) AS nrm FROM poses) WHERE vec_id % 10 <> 0)")))
def triangulate_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rays = fx.poses(spark, sf_dir).filter("vec_id % 10 <> 0").selectExpr("recording_id", "frame div 4 AS part", "x AS ox", "y AS oy", "z AS oz", "qx AS dx", "qy AS dy", "qz AS dz", "1.0D + vec_id % 3 AS weight")
    out = fits.triangulate(rays, ["recording_id", "part"])
    return out.withColumns({c: F.round(c, 3) for c in "xyz"})


_TRUTH = """sc AS (SELECT recording_id, frame, n, least(coalesce(val, 0) / 211, 1.0) AS p, CASE WHEN (frame * 7 + recording_id) % 5 = 0 THEN 1 ELSE 0 END AS y FROM frames6 WHERE role = 0),
tr AS (SELECT recording_id, iv AS id, start_frame // 6 AS s, end_frame // 6 AS e FROM intervals WHERE NOT skip),
gd AS (SELECT q AS share, quantile_cont(p, q) AS high FROM sc, (SELECT unnest([0.8, 0.85, 0.9, 0.93, 0.95, 0.97, 0.98, 0.99, 0.995]) AS q) GROUP BY q),"""
_GRID = _TRUTH.replace("gd AS (SELECT q AS share, quantile_cont(p, q) AS high FROM sc, (SELECT unnest([0.8, 0.85, 0.9, 0.93, 0.95, 0.97, 0.98, 0.99, 0.995]) AS q) GROUP BY q),", "gd AS (" + " UNION ALL ".join(f"SELECT {q} AS share, quantile_cont(p, {q}) AS high FROM sc" for q in evaluate.QUANTILES) + "),") + """
l AS (SELECT share, recording_id, frame, CASE WHEN p > high THEN 'h' WHEN p < 0.6 * high THEN 'l' ELSE 'm' END AS level FROM sc, gd),
b AS (SELECT *, lead(level, 1) OVER w AS next, max(frame) OVER (PARTITION BY share, recording_id) AS last, lag(level) OVER w AS pre FROM l WINDOW w AS (PARTITION BY share, recording_id ORDER BY frame)),
t AS (SELECT * FROM b WHERE (level = 'h' OR level = 'l' AND level = next) AND level IS DISTINCT FROM pre),
k AS (SELECT *, lag(level) OVER w AS prior FROM t WINDOW w AS (PARTITION BY share, recording_id ORDER BY frame)),
z AS (SELECT share, recording_id, level, frame, last, lead(frame) OVER (PARTITION BY share, recording_id ORDER BY frame) AS stop FROM k WHERE level IS DISTINCT FROM prior AND NOT (level = 'l' AND prior IS NULL)),
pp AS (SELECT share, recording_id, frame AS s, coalesce(stop - 1, last) AS e FROM z WHERE level = 'h'),
x AS (SELECT pp.share, pp.recording_id, pp.s AS a, tr.id AS b FROM pp JOIN tr ON pp.recording_id = tr.recording_id AND (pp.s <= tr.e AND tr.s <= pp.e OR abs(pp.s - tr.s) <= 1)),
pn AS (SELECT share, count(*) AS n_proposals FROM pp GROUP BY 1), ph AS (SELECT share, count(*) AS h FROM (SELECT DISTINCT share, recording_id, a FROM x) GROUP BY 1), th AS (SELECT share, count(*) AS h FROM (SELECT DISTINCT share, b FROM x) GROUP BY 1),
f AS (SELECT gd.share, high, 0.6 * high AS low, coalesce(n_proposals, 0) AS n_proposals, (SELECT count(*) FROM tr) AS n_truth, coalesce(ph.h / n_proposals, 0) AS precision, coalesce(th.h, 0) / (SELECT count(*) FROM tr) AS recall FROM gd LEFT JOIN pn USING (share) LEFT JOIN ph USING (share) LEFT JOIN th USING (share)),
f1 AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM f)
"""


def _scored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    scores = fx.frames(spark, sf_dir, 6).filter("role = 0").selectExpr("recording_id", "cast(frame AS long) AS frame", "least(coalesce(val, 0) / 211, 1.0D) AS p", "if((frame * 7 + recording_id) % 5 = 0, 1, 0) AS y")
    truth = fx.intervals(spark, sf_dir).filter("NOT skip").selectExpr("recording_id", "iv AS id", "start_frame div 6 AS start", "end_frame div 6 AS end")
    return scores, truth


@query(sql("frames6 intervals", _GRID + "SELECT share, round(high, 6) AS high, round(low, 6) AS low, n_proposals, n_truth, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM f1"))
def event_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of thresholds of the grid with what its events reach."""
    scores, truth = _scored(spark, sf_dir)
    grid = evaluate.quantiles(scores, "p", evaluate.QUANTILES).select("share", F.col("value").alias("high"), (F.col("value") * 0.6).alias("low"))
    out = evaluate.event_f1(scores, truth, grid, ID, 1, 2, 1)
    return out.withColumns({c: F.round(c, 6) for c in ("high", "low", "precision", "recall", "f1")})


@query(sql("frames6 intervals", _GRID + "SELECT round(high, 6) AS high, round(low, 6) AS low, 'event_f1' AS rule, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM f1 ORDER BY round(f1, 12) DESC, share LIMIT 1"))
def choose_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores, truth = _scored(spark, sf_dir)
    out = evaluate.choose_thresholds(scores, truth, ID, 0.99, 1, 2, 1)
    return out.withColumns({c: F.round(c, 6) for c in ("high", "low", "recall", "f1")})
