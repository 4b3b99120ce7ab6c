"""Queries on sessions: handovers, minutes and the report, on six-hour frames that stand for a second each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tandem.operators import session
from tandem.sources import fixtures as fx

from .oracle import sql
from .registry import query

ID = ["recording_id"]
RULE = session.SessionRule(fps=1.0, still=20.0, floor=1.0, lead=2, base=4, ahead=6, run=2, lag=2, pad=3, idle=2)

_HAND = """sp AS (SELECT recording_id, role, frame, val * 0.9971371 AS speed, coalesce(val, 0) * 0.9971371 AS v FROM frames6), la AS (SELECT recording_id, max(frame) AS last FROM frames6 GROUP BY 1),
ev AS (SELECT recording_id, iv, least(start_frame // 6, last) AS s, least(greatest(end_frame // 6 + 2, start_frame // 6), last) AS e, last, CASE WHEN iv % 3 = 0 THEN initiator END AS gg, CASE WHEN iv % 3 = 0 THEN 1 - initiator END AS rr FROM intervals JOIN la USING (recording_id) WHERE NOT skip),
al AS (SELECT recording_id, role, avg(speed) AS m, stddev_pop(speed) AS d FROM sp GROUP BY ALL),
wi AS (SELECT ev.recording_id, iv, role, s, frame, v FROM ev JOIN sp ON sp.recording_id = ev.recording_id AND frame BETWEEN greatest(s - 6, 0) AND greatest(s - 2, 0) + 5),
ba AS (SELECT recording_id, iv, role, count(*) FILTER (frame < s - 2) AS c, avg(v) FILTER (frame < s - 2) AS m, stddev_pop(v) FILTER (frame < s - 2) AS d FROM wi GROUP BY ALL),
th AS (SELECT ba.recording_id, iv, ba.role, CASE WHEN c >= 3 THEN ba.m + 2 * ba.d ELSE coalesce(al.m + 2 * al.d, 0) END + 1 AS thr FROM ba JOIN al USING (recording_id, role)),
ov AS (SELECT wi.recording_id, wi.iv, wi.role, frame, v > thr AS up, lead(v > thr) OVER (PARTITION BY wi.recording_id, wi.iv, wi.role ORDER BY frame) AS up2 FROM wi JOIN th USING (recording_id, iv, role) WHERE frame >= greatest(s - 2, 0)),
os AS (SELECT recording_id, iv, min(frame) FILTER (up AND up2 AND role = 0) AS o0, min(frame) FILTER (up AND up2 AND role = 1) AS o1 FROM ov GROUP BY ALL),
gv AS (SELECT ev.*, o0, o1, CASE WHEN gg IS NOT NULL THEN gg WHEN o0 IS NULL AND o1 IS NULL THEN 0 WHEN coalesce(o0, 9999999) <= coalesce(o1, 9999999) THEN 0 ELSE 1 END AS g, CASE WHEN gg IS NOT NULL THEN 'given' WHEN o0 IS NULL AND o1 IS NULL THEN 'unknown' ELSE 'onset_order' END AS basis FROM ev LEFT JOIN os USING (recording_id, iv)),
wd AS (SELECT a.recording_id, a.frame, a.v AS v0, b.v AS v1, CASE WHEN (a.frame + a.recording_id) % 4 <> 0 THEN (a.frame * 37 + a.recording_id * 11) % 23 / 4.0 END AS dist FROM sp a JOIN sp b ON a.recording_id = b.recording_id AND a.frame = b.frame AND a.role = 0 AND b.role = 1),
ar AS (SELECT gv.recording_id, iv, s, e, wd.frame, dist, CASE WHEN g = 0 THEN v0 ELSE v1 END AS gs, CASE WHEN g = 0 THEN v1 ELSE v0 END AS rs FROM gv JOIN wd ON wd.recording_id = gv.recording_id AND wd.frame BETWEEN greatest(s - 3, 0) AND least(e + 3, last)),
pk AS (SELECT recording_id, iv, arg_max(frame, struct_pack(g := gs, f := -frame)) AS peak, arg_min(frame, struct_pack(d := dist, f := frame)) FILTER (dist IS NOT NULL) AS near, min(dist) AS min_distance FROM ar WHERE frame BETWEEN s AND e GROUP BY ALL),
tu AS (SELECT ar.recording_id, ar.iv, any_value(peak) AS peak, any_value(min_distance) AS min_distance, coalesce(any_value(near), arg_min(frame, struct_pack(g := gs, f := frame)) FILTER (frame >= peak)) AS turn FROM ar JOIN pk USING (recording_id, iv) WHERE frame BETWEEN s AND e GROUP BY ALL),
ho AS (SELECT ar.recording_id, ar.iv, count(*) FILTER (turn > peak AND frame BETWEEN peak AND turn AND gs < 20) AS hold FROM ar JOIN tu USING (recording_id, iv) WHERE frame BETWEEN s AND e GROUP BY ALL),
lg AS (SELECT a.recording_id, a.iv, o AS lag, CASE WHEN count(*) >= 3 AND stddev_pop(a.gs) > 1e-9 AND stddev_pop(b.rs) > 1e-9 THEN covar_pop(a.gs, b.rs) / (stddev_pop(a.gs) * stddev_pop(b.rs)) END AS r FROM ar a, range(-2, 3) t(o), ar b WHERE a.recording_id = b.recording_id AND a.iv = b.iv AND b.frame = a.frame + o GROUP BY ALL),
sy AS (SELECT recording_id, iv, r, lag FROM lg WHERE r IS NOT NULL QUALIFY row_number() OVER (PARTITION BY recording_id, iv ORDER BY round(r, 9) DESC, abs(lag), lag) = 1),
hm AS (SELECT gv.recording_id, gv.iv, CAST(g AS INT) AS giver, CAST(1 - g AS INT) AS receiver, basis, CAST(s AS INT) AS start, CAST(e - s AS DOUBLE) AS duration, CAST((CASE WHEN g = 0 THEN o0 ELSE o1 END) - s AS DOUBLE) AS reach_onset, CAST((CASE WHEN g = 0 THEN o1 ELSE o0 END) - (CASE WHEN g = 0 THEN o0 ELSE o1 END) AS DOUBLE) AS response,
  CAST(turn - s AS DOUBLE) AS transfer, CAST(hold AS DOUBLE) AS hold, r AS synchrony, CAST(lag AS DOUBLE) AS synchrony_lag, min_distance FROM gv JOIN tu USING (recording_id, iv) JOIN ho USING (recording_id, iv) LEFT JOIN sy USING (recording_id, iv)),
rn AS (SELECT *, coalesce(speed < 20, false) AS still, frame - row_number() OVER (PARTITION BY recording_id, role, coalesce(speed < 20, false) ORDER BY frame) AS k FROM sp),
id AS (SELECT recording_id, role, frame, speed, still AND count(*) OVER (PARTITION BY recording_id, role, still, k) >= 2 AS idle FROM rn)
"""


def _speed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.frames(spark, sf_dir, 6).select("recording_id", "role", "frame", (F.col("val") * 0.9971371).alias("speed"))


def _handovers(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = "if(iv % 3 = 0, {}, null)"
    events = fx.intervals(spark, sf_dir).filter("NOT skip").selectExpr("recording_id", "iv", "cast(start_frame div 6 AS int) AS start_frame", "cast(end_frame div 6 + 2 AS int) AS end_frame", f"{known.format('initiator')} AS giver", f"{known.format('1 - initiator')} AS receiver")
    distance = fx.grid(spark, sf_dir, 6).selectExpr("recording_id", "frame", "if((frame + recording_id) % 4 <> 0, (frame * 37 + recording_id * 11) % 23 / 4.0D, null) AS distance")
    return session.handover_metrics(events, _speed(spark, sf_dir), distance, ID, RULE)


@query(sql("frames6 intervals", _HAND + "SELECT * REPLACE (round(synchrony, 6) AS synchrony) FROM hm"))
def handover_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _handovers(spark, sf_dir).withColumn("synchrony", F.round("synchrony", 6))


@query(sql("frames6 intervals", _HAND + """, mi AS (SELECT recording_id, CAST(frame // 60 AS INT) AS minute, role, avg(CAST(idle AS INT)) AS idle, avg(CAST(speed IS NOT NULL AS INT)) AS visible FROM id GROUP BY ALL),
mm AS (SELECT recording_id, minute, avg(idle) AS idle, avg(visible) AS visible FROM mi GROUP BY ALL), ms AS (SELECT recording_id, CAST(frame // 60 AS INT) AS minute, avg(CASE WHEN (frame + role) % 3 = 0 THEN 1.0 ELSE 0 END) AS speech, role FROM frames6 GROUP BY ALL),
m2 AS (SELECT recording_id, minute, avg(speech) AS speech FROM ms GROUP BY ALL), mh AS (SELECT recording_id, CAST(start // 60 AS INT) AS minute, count(*) AS handovers FROM hm GROUP BY ALL)
SELECT recording_id, minute, coalesce(handovers, 0) AS handovers, round(idle, 6) AS idle, round(visible, 6) AS visible, round(speech, 6) AS speech FROM mm LEFT JOIN m2 USING (recording_id, minute) LEFT JOIN mh USING (recording_id, minute)"""))
def session_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    speech = fx.frames(spark, sf_dir, 6).selectExpr("recording_id", "role", "frame", "(frame + role) % 3 = 0 AS speaking")
    out = session.session_minutes(_handovers(spark, sf_dir), _speed(spark, sf_dir), speech, ID, RULE)
    return out.withColumns({c: F.round(c, 6) for c in ("idle", "visible", "speech")})


@query(sql("frames6 intervals", _HAND + """, pe AS (SELECT recording_id, count(DISTINCT frame) AS n_frames, """ + ", ".join(f"avg(CAST(speed IS NOT NULL AS INT)) FILTER (role = {r}) AS visible_{r}, avg(CAST(idle AS INT)) FILTER (role = {r}) AS idle_{r}, avg(speed) FILTER (role = {r}) AS mean_speed_{r}" for r in (0, 1)) + """ FROM id GROUP BY 1),
sl AS (SELECT a.recording_id, o AS lag, CASE WHEN stddev_pop(a.v0) > 1e-9 AND stddev_pop(b.v1) > 1e-9 THEN covar_pop(a.v0, b.v1) / (stddev_pop(a.v0) * stddev_pop(b.v1)) END AS r FROM wd a, range(-2, 3) t(o), wd b WHERE a.recording_id = b.recording_id AND b.frame = a.frame + o GROUP BY ALL),
ss AS (SELECT recording_id, r AS synchrony, lag AS synchrony_lag FROM sl WHERE r IS NOT NULL QUALIFY row_number() OVER (PARTITION BY recording_id ORDER BY round(r, 9) DESC, abs(lag), lag) = 1),
he AS (SELECT recording_id, count(*) AS handovers, median(response) AS response, median(abs(response)) AS quick, median(hold) AS hold, median(synchrony) AS handover_synchrony, avg(CASE WHEN response < 0 THEN 1.0 WHEN response >= 0 THEN 0 END) AS anticipation FROM hm GROUP BY 1),
sc AS (SELECT pe.*, synchrony, synchrony_lag, coalesce(handovers, 0) AS handovers, response, quick, hold, handover_synchrony, anticipation, greatest(0, least(1, synchrony)) AS c_sync, CASE WHEN quick IS NOT NULL THEN 1 - greatest(0, least(1, quick / 2)) END AS c_response, CASE WHEN hold IS NOT NULL THEN 1 - greatest(0, least(1, hold / 3)) END AS c_hold, 1 - (idle_0 + idle_1) / 2 AS c_engage FROM pe LEFT JOIN ss USING (recording_id) LEFT JOIN he USING (recording_id))
SELECT recording_id, n_frames, CAST(n_frames AS DOUBLE) AS seconds, """ + ", ".join(f"round({c}_{r}, 5) AS {c}_{r}" for r in (0, 1) for c in ("visible", "idle", "mean_speed")) + """, handovers, round(handovers / n_frames * 60, 5) AS rate, response, hold, round(anticipation, 5) AS anticipation, round(synchrony, 5) AS synchrony, CAST(synchrony_lag AS DOUBLE) AS synchrony_lag, round(handover_synchrony, 5) AS handover_synchrony,
  round(CASE WHEN synchrony IS NOT NULL THEN c_sync END, 5) AS c_sync, round(c_response, 5) AS c_response, round(c_hold, 5) AS c_hold, round(c_engage, 5) AS c_engage, round(100 * list_avg(list_filter([CASE WHEN synchrony IS NOT NULL THEN c_sync END, c_response, c_hold, c_engage], lambda x: x IS NOT NULL)), 4) AS score, c_response IS NULL OR c_hold IS NULL AS partial FROM sc"""))
def session_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = session.session_report(_handovers(spark, sf_dir), _speed(spark, sf_dir), ID, RULE)
    skip = ("recording_id", "n_frames", "seconds", "handovers", "response", "hold", "synchrony_lag", "partial")
    return out.withColumns({c: F.round(c, 4 if c == "score" else 5) for c in out.columns if c not in skip})
