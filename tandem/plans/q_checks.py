"""Checks of trajectories, hands, frames and correspondences, with the same rows in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tandem.operators import checks
from tandem.sources import fixtures as fx

from .oracle import sql
from .registry import query

ID = ["recording_id"]


def _rounded(df: DataFrame, *names: str, digits: int = 5) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


_TRACK = """t AS (SELECT recording_id, frame AS idx, CASE WHEN vec_id % 13 <> 0 THEN x END AS x, y, z, qx, qy, qz, qw, frame * 500000 - CASE WHEN vec_id % 11 = 0 THEN 700000 ELSE 0 END AS t,
  CASE WHEN vec_id % 17 = 0 THEN 'b' ELSE 'a' END AS clock, CASE WHEN vec_id % 19 = 0 THEN 'w2' ELSE 'w1' END AS world FROM poses),
l AS (SELECT *, row_number() OVER w AS n, """ + ", ".join(f"lag({c}) OVER w AS p{c}" for c in "x y z qx qy qz qw t clock world".split()) + """ FROM t WINDOW w AS (PARTITION BY recording_id ORDER BY idx)),
r AS (SELECT *, CASE WHEN x IS NULL OR px IS NULL THEN 'missing' WHEN clock <> pclock THEN 'clock' WHEN world <> pworld THEN 'frame' WHEN t <= pt THEN 'time' END AS reason FROM l WHERE n > 1),
m AS (SELECT *, CASE WHEN reason IS NULL THEN sqrt((x - px) ** 2 + (y - py) ** 2 + (z - pz) ** 2) / ((t - pt) / 1e6) END AS speed,
  CASE WHEN reason IS NULL THEN 2 * acos(least(1, abs(qx * pqx + qy * pqy + qz * pqz + qw * pqw))) / ((t - pt) / 1e6) END AS turn FROM r),
c AS (SELECT recording_id, idx, speed, turn, coalesce(reason, CASE WHEN speed > 0.6 OR turn > 5 THEN 'speed' END) AS reason FROM m)
"""


def _track(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.poses(spark, sf_dir).selectExpr(
        "recording_id", "frame AS idx", "if(vec_id % 13 <> 0, x, null) AS x", "y", "z", "qx", "qy", "qz", "qw", "frame * 500000L - if(vec_id % 11 = 0, 700000, 0) AS t",
        "if(vec_id % 17 = 0, 'b', 'a') AS clock", "if(vec_id % 19 = 0, 'w2', 'w1') AS world",
    )


@query(sql("poses", _TRACK + "SELECT recording_id, idx, round(speed, 5) AS speed, round(turn, 5) AS turn, reason FROM c"))
def continuity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(checks.continuity(_track(spark, sf_dir), ID, 0.6, 5.0), "speed", "turn")


@query(sql("poses", _TRACK + """, k AS (SELECT recording_id, count(*) AS n_samples, count(*) FILTER (x IS NULL) AS n_missing FROM t GROUP BY 1),
s AS (SELECT recording_id, count(speed) AS n_checked, round(max(speed), 5) AS max_speed, round(max(turn), 5) AS max_turn, count(*) FILTER (reason = 'speed') AS n_fast,
  count(*) FILTER (reason IN ('clock', 'frame', 'time')) AS n_invalid FROM c GROUP BY 1)
SELECT recording_id, n_samples, n_missing, coalesce(n_checked, 0) AS n_checked, max_speed, max_turn, coalesce(n_fast, 0) AS n_fast, coalesce(n_invalid, 0) AS n_invalid,
  CASE WHEN n_fast + n_invalid > 0 THEN 'FAIL' WHEN coalesce(n_checked, 0) = 0 OR n_missing > 0 THEN 'INSUFFICIENT_DATA' ELSE 'PASS' END AS status FROM k LEFT JOIN s USING (recording_id)"""))
def qc_continuity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(checks.qc_continuity(_track(spark, sf_dir), ID, 0.6, 5.0), "max_speed", "max_turn")


@query(sql("poses", """h AS (SELECT p.recording_id, p.frame AS idx, vec_id, e.embedding AS e,
  p.frame * 50000 + p.frame // 7 * 100000 - CASE WHEN vec_id % 31 = 0 THEN 90000 ELSE 0 END AS t,
  CASE vec_id % 9 WHEN 0 THEN -1.0 WHEN 1 THEN NULL WHEN 2 THEN 0.0 ELSE least(abs(e.embedding[64]::DOUBLE), 1) END AS conf FROM poses p JOIN embeddings e USING (vec_id)),
g AS (SELECT *, coalesce(conf, 0) <> -1 AND vec_id % 14 <> 3 AND vec_id % 15 <> 4 AS present, list_max(list_transform(range(0, 21), lambda i: sqrt(e[3 * i + 1]::DOUBLE ** 2 + e[3 * i + 2]::DOUBLE ** 2 + e[3 * i + 3]::DOUBLE ** 2))) AS farthest FROM h),
p AS (SELECT recording_id, idx, t, conf, present, present AND farthest > 0.42 AS far, CASE WHEN present THEN e[16]::DOUBLE END AS wx, CASE WHEN present THEN e[17]::DOUBLE END AS wy, CASE WHEN present THEN e[18]::DOUBLE END AS wz FROM g),
l AS (SELECT *, lag(wx) OVER w AS px, lag(wy) OVER w AS py, lag(wz) OVER w AS pz, t - lag(t) OVER w AS dt, row_number() OVER w AS k FROM p WINDOW w AS (PARTITION BY recording_id ORDER BY idx)),
s AS (SELECT *, CASE WHEN dt > 0 AND dt <= 100000 AND wx IS NOT NULL AND px IS NOT NULL THEN sqrt((wx - px) ** 2 + (wy - py) ** 2 + (wz - pz) ** 2) / (dt / 1e6) END AS speed FROM l),
a AS (SELECT recording_id, count(*) AS n, count(*) FILTER (present) AS n_present, count(*) FILTER (conf = 0) AS n_zero_conf, count(*) FILTER (conf IS NULL) AS n_unknown_conf,
  quantile_cont(sqrt(wx ** 2 + wy ** 2 + wz ** 2), [0.5, 0.95, 1.0]) AS distance, quantile_cont(speed, [0.5, 0.95, 1.0]) AS speed, count(*) FILTER (far) AS n_far, count(speed) AS n_checked,
  count(*) FILTER (speed > 5) AS n_fast, count(*) FILTER (k > 1 AND speed IS NULL) AS n_gaps, count(*) FILTER (dt <= 0) AS n_backwards, coalesce(list(idx ORDER BY idx) FILTER (speed > 5), [])[1:20] AS first_fast FROM s GROUP BY 1)
SELECT * REPLACE (list_transform(distance, lambda v: round(v, 5)) AS distance, list_transform(speed, lambda v: round(v, 5)) AS speed),
  CASE WHEN n_far + n_fast + n_backwards > 0 THEN 'FAIL' WHEN n_present = 0 THEN 'INSUFFICIENT_DATA' ELSE 'PASS' END AS status FROM a"""))
def qc_hand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector as a hand of 21 points, the last number as its confidence."""
    points = fx.poses(spark, sf_dir).join(fx.table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "vec_id")
    e = lambda i: F.col("embedding")[i].cast("double")
    xyz = lambda i: F.struct(*(F.when((F.lit(i == 7)) & (F.col("vec_id") % 15 == 4), F.lit(None)).otherwise(e(3 * i + k)).alias(c) for k, c in enumerate("xyz")))
    hands = points.select(
        "recording_id", F.col("frame").cast("long").alias("idx"), F.expr("frame * 50000L + frame div 7 * 100000 - if(vec_id % 31 = 0, 90000, 0)").alias("t"),
        F.when(F.col("vec_id") % 9 == 0, -1.0).when(F.col("vec_id") % 9 == 1, None).when(F.col("vec_id") % 9 == 2, 0.0).otherwise(F.least(F.abs(e(63)), F.lit(1.0))).alias("conf"),
        F.when(F.col("vec_id") % 14 != 3, F.array(*map(xyz, range(21)))).alias("points"),
    )
    out = checks.qc_hand(hands, ID, 0.42, 5.0, 100_000)
    return out.withColumns({c: F.transform(c, lambda v: F.round(v, 5)) for c in ("distance", "speed")})


_VALID = """f AS (SELECT recording_id, idx AS frame, CASE WHEN idx % 7 <> 1 THEN t END AS t, CASE idx % 7 WHEN 0 THEN 'INFERRED' WHEN 1 THEN 'UNRESOLVED' ELSE 'VERIFIED' END AS evidence FROM samples WHERE role = 0),
p AS (SELECT recording_id, t, idx FROM samples WHERE role = 1 AND kind IN ('click', 'view')),
h AS (SELECT recording_id, t, idx, (idx % 10) / 10.0 AS conf, idx % 5 * 10 - 15 AS pr, idx % 8 <> 0 AS pok, idx % 6 <> 0 AS whole FROM samples WHERE role = 1 AND kind NOT IN ('click', 'view')),
pm AS (SELECT f.recording_id, frame, p.idx AS pose_idx, p.t - f.t AS pose_residual, row_number() OVER (PARTITION BY f.recording_id, frame ORDER BY abs(p.t - f.t), p.t, p.idx) AS k FROM f JOIN p ON f.recording_id = p.recording_id WHERE evidence = 'VERIFIED'),
hm AS (SELECT f.recording_id, frame, h.idx AS hand_idx, h.t - f.t AS hand_residual, conf, pr, pok, whole, row_number() OVER (PARTITION BY f.recording_id, frame ORDER BY abs(h.t - f.t), h.t, h.idx) AS k FROM f JOIN h ON f.recording_id = h.recording_id WHERE evidence = 'VERIFIED'),
j AS (SELECT f.recording_id, f.frame, f.t, f.evidence, pose_idx, pose_residual, coalesce(abs(pose_residual) <= 21600000000, false) AS pose_ok, hand_idx, hand_residual, coalesce(abs(hand_residual) <= 43200000000, false) AS hand_ok, conf, pr, pok, whole
  FROM f LEFT JOIN (SELECT * FROM pm WHERE k = 1) a USING (recording_id, frame) LEFT JOIN (SELECT * FROM hm WHERE k = 1) b USING (recording_id, frame)),
v AS (SELECT *, coalesce(hand_ok AND pok AND abs(pr) <= 20, false) AS hand_pose_ok, CASE WHEN hand_ok THEN CAST(conf AS DOUBLE) END AS hand_conf FROM j),
z AS (SELECT recording_id, frame, t, evidence, pose_idx, pose_residual, pose_ok, hand_idx, hand_residual, hand_ok, hand_pose_ok, hand_conf, coalesce(hand_pose_ok AND whole, false) AS present, coalesce(hand_pose_ok AND whole AND conf >= 0.5, false) AS sure FROM v)
"""


def _validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One person's samples as frames, the other's as poses (clicks and views) and hands (all else)."""
    s = fx.samples(spark, sf_dir)
    frames = s.filter("role = 0").selectExpr("recording_id", "idx AS frame", "if(idx % 7 <> 1, t, null) AS t", "CASE idx % 7 WHEN 0 THEN 'INFERRED' WHEN 1 THEN 'UNRESOLVED' ELSE 'VERIFIED' END AS evidence")
    poses = s.filter("role = 1 AND kind IN ('click', 'view')").select("recording_id", "t", "idx")
    hands = s.filter("role = 1 AND kind NOT IN ('click', 'view')").selectExpr("recording_id", "t", "idx", "(idx % 10) / 10 AS conf", "idx % 5 * 10 - 15 AS pose_residual", "idx % 8 <> 0 AS pose_ok", "idx % 6 <> 0 AS whole")
    hour = 3_600_000_000
    return checks.validate_frames(frames, poses, hands, ID, 6 * hour, 12 * hour, 20, 0.5)


@query(sql("samples", _VALID + "SELECT * FROM z"))
def validate_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _validated(spark, sf_dir)


@query(sql("samples", _VALID + "SELECT * REPLACE (CASE WHEN pose_ok THEN pose_idx END AS pose_idx, CASE WHEN sure THEN hand_idx END AS hand_idx) FROM z"))
def frame_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.frame_gate(_validated(spark, sf_dir), {"pose_idx": "pose_ok", "hand_idx": "sure"})


@query(sql("samples", _VALID + """SELECT recording_id, count(*) FILTER (evidence = 'VERIFIED') AS n_verified, count(*) FILTER (evidence = 'INFERRED') AS n_inferred, count(*) FILTER (evidence = 'UNRESOLVED') AS n_unresolved,
count(*) FILTER (pose_ok) AS n_pose, round(count(*) FILTER (pose_ok) / count(*), 6) AS pose_share, max(abs(pose_residual)) FILTER (pose_ok) AS most_pose_residual,
count(*) FILTER (hand_ok) AS n_hand, round(count(*) FILTER (hand_ok) / count(*), 6) AS hand_share, max(abs(hand_residual)) FILTER (hand_ok) AS most_hand_residual,
count(*) FILTER (present) AS n_present, round(count(*) FILTER (present) / count(*), 6) AS present_share, count(*) FILTER (sure) AS n_sure, round(count(*) FILTER (sure) / count(*), 6) AS sure_share,
count(*) FILTER (hand_ok AND NOT hand_pose_ok) AS n_second_rejected FROM z GROUP BY 1"""))
def participant_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(checks.participant_summary(_validated(spark, sf_dir), ID), "pose_share", "hand_share", "present_share", "sure_share", digits=6)


def _rot(p: str) -> list[str]:
    x, y, z, w = (f"{p}q{c}" for c in "xyzw")
    return [
        f"(1 - 2 * ({y} * {y} + {z} * {z}))", f"(2 * ({x} * {y} - {z} * {w}))", f"(2 * ({x} * {z} + {y} * {w}))", f"(2 * ({x} * {y} + {z} * {w}))", f"(1 - 2 * ({x} * {x} + {z} * {z}))",
        f"(2 * ({y} * {z} - {x} * {w}))", f"(2 * ({x} * {z} - {y} * {w}))", f"(2 * ({y} * {z} + {x} * {w}))", f"(1 - 2 * ({x} * {x} + {y} * {y}))",
    ]


_D, _C = _rot("d"), _rot("c")
_CAMERA = ", ".join(
    [f"CASE WHEN reason IS NULL THEN round({' + '.join(f'{_D[3 * i + k]} * {_C[3 * k + j]}' for k in range(3))}, 5) END AS r{i}{j}" for i in range(3) for j in range(3)]
    + [f"CASE WHEN reason IS NULL THEN round({_D[3 * i]} * cx + {_D[3 * i + 1]} * cy + {_D[3 * i + 2]} * cz + d{c}, 5) END AS {c}" for i, c in enumerate("xyz")]
)


@query(sql("poses", """a AS (SELECT recording_id, vec_id % 3 AS camera, frame * 500000 + 120000 * (vec_id % 5) AS t, vec_id % 10 <> 0 AS calibrated, vec_id, z AS cx, x AS cy, y AS cz, qy AS cqx, qz AS cqy, qx AS cqz, qw AS cqw FROM poses WHERE frame % 4 = 0),
m AS (SELECT a.*, p.frame * 500000 - a.t AS residual, p.x AS dx, p.y AS dy, p.z AS dz, p.qx AS dqx, p.qy AS dqy, p.qz AS dqz, p.qw AS dqw,
  row_number() OVER (PARTITION BY a.vec_id ORDER BY abs(p.frame * 500000 - a.t), p.frame) AS k FROM a JOIN poses p USING (recording_id)),
b AS (SELECT *, CASE WHEN NOT calibrated THEN 'uncalibrated' WHEN abs(residual) > 200000 THEN 'gap_exceeded' END AS reason FROM m WHERE k = 1)
SELECT recording_id, camera, t, residual, reason, """ + _CAMERA + " FROM b"))
def camera_pose(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = fx.poses(spark, sf_dir)
    calibrations = p.filter("frame % 4 = 0").selectExpr(
        "recording_id", "vec_id % 3 AS camera", "frame * 500000L + 120000 * (vec_id % 5) AS t", "vec_id % 10 <> 0 AS calibrated",
        "z AS x", "x AS y", "y AS z", "qy AS qx", "qz AS qy", "qx AS qz", "qw",
    )
    device = p.selectExpr("recording_id", "frame * 500000L AS t", "frame AS idx", *checks.POSE)
    out = checks.camera_pose(calibrations, device, ID, 200_000)
    return _rounded(out, *(f"r{i}{j}" for i in range(3) for j in range(3)), "x", "y", "z")


@query(sql("grid intervals", """s AS (SELECT recording_id, role AS camera, frame, CAST((frame * 7 + role * 3 + recording_id) % 5 AS BIGINT) AS n_in FROM grid, (VALUES (0), (1)) r(role) WHERE (frame + role) % 50 <> 0),
w AS (SELECT recording_id, iv, end_frame - start_frame + 1 AS n, unnest(range(start_frame, end_frame + 1)) AS frame FROM intervals),
p AS (SELECT recording_id, iv, camera, any_value(n) AS n, count(*) AS k, sum(n_in) AS n_in FROM w JOIN s USING (recording_id, frame) GROUP BY ALL),
q AS (SELECT recording_id, iv, count(*) FILTER (k = n) AS n_cameras, min(n_in / (4 * n)) FILTER (k = n) AS least FROM p GROUP BY ALL)
SELECT recording_id, iv, coalesce(n_cameras, 0) AS n_cameras, CASE WHEN n_cameras = 2 THEN round(least, 6) END AS least FROM intervals LEFT JOIN q USING (recording_id, iv)"""))
def event_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = fx.grid(spark, sf_dir).withColumn("camera", F.explode(F.array(F.lit(0), F.lit(1)))).filter("(frame + camera) % 50 <> 0").withColumn("n_in", F.expr("(frame * 7 + camera * 3 + recording_id) % 5"))
    return _rounded(checks.event_projection(fx.intervals(spark, sf_dir), seen, ID), "least", digits=6)


_MATCHES = "m AS (SELECT recording_id, CAST(frame AS BIGINT) AS frame, frame + 3 + CASE WHEN vec_id % 9 = 0 THEN 1 ELSE 0 END AS candidate, abs(x) AS best, abs(y) < 0.15 AS matched FROM poses)"


@query(sql("poses", _MATCHES + """, l AS (SELECT *, candidate - frame AS o, lag(frame) OVER w AS pf, lag(candidate) OVER w AS pc, lag(matched) OVER w AS pm FROM m WINDOW w AS (PARTITION BY recording_id ORDER BY frame)),
a AS (SELECT recording_id, arg_min(o, frame) AS first_offset, count(*) AS n, count(*) FILTER (matched) AS n_sure, count(DISTINCT CASE WHEN matched THEN o END) > 1 AS constant_rejected,
  list_transform(quantile_cont(CASE WHEN matched THEN best END, [0.5, 0.95, 1.0]), lambda v: round(v, 6)) AS errors, count(*) FILTER (matched AND pm AND frame = pf + 1 AND candidate <> pc + 1) AS n_irregular,
  arg_min(candidate, frame) + max(frame) - min(frame) AS implied_last FROM l GROUP BY 1)
SELECT *, implied_last >= 50 AS out_of_range FROM a"""))
def correspondence_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    matches = fx.poses(spark, sf_dir).selectExpr("recording_id", "cast(frame AS long) AS frame", "frame + 3 + if(vec_id % 9 = 0, 1, 0) AS candidate", "abs(x) AS best", "abs(y) < 0.15 AS matched")
    return checks.correspondence_summary(matches, ID, 50).withColumn("errors", F.transform("errors", lambda v: F.round(v, 6)))


@query(sql("poses", """a AS (SELECT recording_id, frame, [abs(x) + 0.2, abs(x) * 0.3, abs(y) + 0.1, abs(z) + 0.15] AS s FROM poses WHERE frame % 3 = 0 OR recording_id % 3 = 0),
b AS (SELECT *, s[2] AS own, least(s[1], s[3], s[4]) - s[2] AS margin, frame - lag(frame) OVER (PARTITION BY recording_id ORDER BY frame) AS gap FROM a),
t AS (SELECT recording_id, max(frame) AS last FROM poses GROUP BY 1),
g AS (SELECT recording_id, count(*) AS n, max(gap) AS widest, max(own) AS worst, min(margin) AS margin, min(frame) AS f, max(frame) AS l, any_value(last) AS last FROM b JOIN t USING (recording_id) GROUP BY 1)
SELECT recording_id, n, widest, round(worst, 6) AS worst, round(margin, 6) AS margin, CASE WHEN n < 5 THEN 'too_few' WHEN f <> 0 OR l <> last OR coalesce(widest, 0) > 3 THEN 'not_covered'
  WHEN worst > 0.2 OR margin < 0.02 THEN 'not_established' END AS reason FROM g"""))
def orientation_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = fx.poses(spark, sf_dir)
    anchors = p.filter("frame % 3 = 0 OR recording_id % 3 = 0").selectExpr("recording_id", "frame", "array(abs(x) + 0.2, abs(x) * 0.3, abs(y) + 0.1, abs(z) + 0.15) AS scores")
    anchors = anchors.join(p.groupBy("recording_id").agg(F.max("frame").alias("last")), "recording_id")
    return _rounded(checks.orientation_gate(anchors, ID, 1, 0.2, 0.02, 5, 3, F.max("last")), "worst", "margin", digits=6)


@query(sql("poses", """m AS (SELECT vec_id AS frame, vec_id + vec_id % 3 - 1 AS candidate, abs(y) < 0.15 AS matched FROM poses), z AS (SELECT max(vec_id) AS last FROM poses),
q AS (SELECT vec_id AS frame, unnest(range(greatest(vec_id - 8, 0), least(vec_id + 8, last) + 1)) AS at FROM poses, z WHERE vec_id % 4 <> 0),
v AS (SELECT DISTINCT vec_id AS at FROM poses WHERE vec_id % 40 <> 7), w AS (SELECT frame, count(*) FILTER (v.at IS NULL) = 0 AS whole FROM q LEFT JOIN v ON q.at = v.at GROUP BY 1)
SELECT m.frame, CASE WHEN whole AND matched THEN candidate END AS candidate, CASE WHEN whole AND matched THEN 'VERIFIED' ELSE 'UNRESOLVED' END AS evidence,
  CASE WHEN whole IS NULL THEN 'outside_requested_windows' WHEN NOT whole THEN 'incomplete_candidate_window' END AS reason FROM m LEFT JOIN w USING (frame)"""))
def match_requested(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = fx.poses(spark, sf_dir)
    matches = p.selectExpr("vec_id AS frame", "vec_id + vec_id % 3 - 1 AS candidate", "abs(y) < 0.15 AS matched")
    last = p.agg(F.max("vec_id")).first()[0]
    return checks.match_requested(matches, p.filter("vec_id % 4 <> 0").selectExpr("vec_id AS frame", "vec_id AS center"), p.filter("vec_id % 40 <> 7").selectExpr("vec_id AS frame"), 8, last or 0)


@query(sql("words", """SELECT recording_id, turn, count(*) AS n, count(DISTINCT pos) AS n_frames, count(*) = count(DISTINCT pos) AND min(pos) = 0 AND max(pos) = count(*) - 1 AS complete
FROM words WHERE NOT (turn % 3 = 0 AND pos % 17 = 5) GROUP BY ALL"""))
def check_frame_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.check_frame_index(fx.words(spark, sf_dir).filter("NOT (turn % 3 = 0 AND pos % 17 = 5)").withColumn("frame", F.col("pos")), ["recording_id", "turn"])


@query(sql("intervals", """SELECT recording_id, iv, start_frame, end_frame, 'video length' AS evidence, CASE WHEN start_frame >= 0 AND end_frame < 300 + recording_id % 300 AND start_frame <= end_frame THEN 'VERIFIED' ELSE 'UNRESOLVED' END AS status,
CASE WHEN start_frame > end_frame THEN 'start_after_end' WHEN start_frame < 0 OR end_frame >= 300 + recording_id % 300 THEN 'out_of_range' END AS reason FROM intervals"""))
def bind_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = fx.intervals(spark, sf_dir).select("recording_id", "iv", "start_frame", "end_frame")
    extent = events.select("recording_id").distinct().withColumn("n_frames", F.expr("300 + recording_id % 300"))
    return checks.bind_events(events, extent, ID, "video length", "VERIFIED")


@query(sql("poses", """p AS (SELECT recording_id, CASE WHEN z > 0.05 THEN 200 * x / z + 320 END AS u, CASE WHEN z > 0.05 THEN 200 * y / z + 240 END AS v FROM poses)
SELECT recording_id, count(*) AS n, count(*) FILTER (u >= 0 AND u < 640 AND v >= 0 AND v < 480) AS n_inside, count(*) FILTER (NOT (u >= 0 AND u < 640 AND v >= 0 AND v < 480)) AS n_outside, count(*) FILTER (u IS NULL) AS n_unplaced,
round(min(u), 4) AS min_u, round(max(u), 4) AS max_u, round(min(v), 4) AS min_v, round(max(v), 4) AS max_v FROM p GROUP BY 1"""))
def coverage_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage under a projector of the caller's: a pinhole that places nothing nearer than 0.05."""
    projector = lambda p: [F.when(p[2] > 0.05, 200 * p[0] / p[2] + 320), F.when(p[2] > 0.05, 200 * p[1] / p[2] + 240)]
    return _rounded(checks.coverage_by(fx.poses(spark, sf_dir), ID, projector, 640, 480), "min_u", "max_u", "min_v", "max_v", digits=4)
