"""Queries of quality rules, session reports and rankings, with the same rows in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tandem.functions import geometry as g
from tandem.operators import align, graph, qc, scopes
from tandem.sources import fixtures as fx

from .oracle import recursive, sql
from .registry import also, query

HOUR = 3_600_000_000


def _rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols})


@query(sql("boxes", """c AS (SELECT frame, slot, CASE WHEN slot % 3 = 0 THEN -1 WHEN slot % 5 = 0 THEN NULL ELSE conf * 1.2 - 0.1 END AS conf FROM boxes)
SELECT frame, slot, CASE WHEN conf IS NULL THEN 'unknown' WHEN conf = -1 THEN 'missing' ELSE 'present' END AS state, round(CASE WHEN conf <> -1 THEN greatest(least(conf, 1), 0) END, 6) AS confidence FROM c"""))  # fmt: skip
def hand_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    conf = F.expr("CASE WHEN slot % 3 = 0 THEN -1D WHEN slot % 5 = 0 THEN NULL ELSE conf * 1.2 - 0.1 END")
    state, value = qc.presence(F.col("c"))
    return fx.boxes(spark, sf_dir).withColumn("c", conf).select("frame", "slot", state.alias("state"), F.round(value, 6).alias("confidence"))


@query(sql("poses", """s AS (SELECT recording_id, frame AS idx, frame // 2 AS t, qx * (0.4 + vec_id % 5 * 0.3) AS qx, qy * (0.4 + vec_id % 5 * 0.3) AS qy, qz * (0.4 + vec_id % 5 * 0.3) AS qz, qw * (0.4 + vec_id % 5 * 0.3) AS qw, 0.4 + vec_id % 5 * 0.3 AS n FROM poses),
r AS (SELECT *, row_number() OVER (PARTITION BY recording_id, t ORDER BY idx) AS k FROM s WHERE n > 0.5 AND n < 1.5)
SELECT recording_id, t, idx, round(qx / n, 6) AS qx, round(qy / n, 6) AS qy, round(qz / n, 6) AS qz, round(qw / n, 6) AS qw FROM r WHERE k = 1"""))  # fmt: skip
def clean_quaternions(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = ["qx", "qy", "qz", "qw"]
    s = 0.4 + F.col("vec_id") % 5 * 0.3
    p = fx.poses(spark, sf_dir).select("recording_id", F.col("frame").alias("idx"), F.expr("cast(frame div 2 AS bigint)").alias("t"), *((F.col(c) * s).alias(c) for c in q))
    return _rounded(qc.clean_quaternions(p, ["recording_id"], q).select("recording_id", "t", "idx", *q), *q)


@query(sql("samples", "SELECT recording_id, role, kind FROM (SELECT *, row_number() OVER (PARTITION BY recording_id, role ORDER BY n DESC, kind) AS k FROM (SELECT recording_id, role, kind, count(*) AS n FROM samples GROUP BY ALL)) WHERE k = 1"))
def dominant_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qc.dominant(fx.samples(spark, sf_dir), ["recording_id", "role"], "kind")


@query(sql("samples", """k AS (SELECT recording_id, role, CASE WHEN recording_id % 5 = 0 THEN recording_id WHEN recording_id % 5 = 1 THEN recording_id + role WHEN recording_id % 5 = 2 THEN idx % 2 ELSE 7 END AS graph FROM samples WHERE NOT (recording_id % 5 = 3 AND role = 1)),
p AS (SELECT recording_id, role, count(DISTINCT graph) AS n, min(graph) AS g FROM k GROUP BY ALL)
SELECT recording_id, CASE WHEN count(*) < 2 THEN 'one_role' WHEN max(n) > 1 THEN 'several_keys' WHEN min(n) < 1 THEN 'no_key' WHEN count(DISTINCT g) > 1 THEN 'different_keys' ELSE 'verified' END AS state FROM p GROUP BY 1"""))  # fmt: skip
def shared_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fx.samples(spark, sf_dir).filter("NOT (recording_id % 5 = 3 AND role = 1)")
    graph = F.expr("CASE WHEN recording_id % 5 = 0 THEN recording_id WHEN recording_id % 5 = 1 THEN recording_id + role WHEN recording_id % 5 = 2 THEN idx % 2 ELSE 7 END")
    return qc.shared_key(s.withColumn("graph", graph), ["recording_id"], "role", "graph")


_MAP = """m AS (SELECT recording_id, role, frame, CASE WHEN n = 0 THEN -1 ELSE frame * 2 + CAST(floor(val) AS BIGINT) % 5 END AS source, frame * 10 + CAST(floor(coalesce(val, 0)) AS BIGINT) % 13 AS time, CASE WHEN n = 0 AND frame % 9 > 0 THEN 'UNRESOLVED' WHEN n > 1 THEN 'INFERRED' ELSE 'VERIFIED' END AS status FROM frames6)"""


def _frame_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.frames(spark, sf_dir, 6).selectExpr(
        "recording_id", "role", "frame", "CASE WHEN n = 0 THEN -1 ELSE frame * 2 + cast(floor(val) AS bigint) % 5 END AS source", "frame * 10 + cast(floor(coalesce(val, 0)) AS bigint) % 13 AS time",
        "CASE WHEN n = 0 AND frame % 9 > 0 THEN 'UNRESOLVED' WHEN n > 1 THEN 'INFERRED' ELSE 'VERIFIED' END AS status",
    )


@query(sql("frames6", _MAP + """, k AS (SELECT *, lag(source) OVER w AS ps, lag(time) OVER w AS pt FROM m WHERE source >= 0 WINDOW w AS (PARTITION BY recording_id, role ORDER BY frame))
SELECT recording_id, role, frame, 'source_falls' AS rule FROM k WHERE source < ps UNION ALL SELECT recording_id, role, frame, 'time_falls' FROM k WHERE time < pt
UNION ALL SELECT recording_id, role, frame, 'same_source_other_time' FROM k WHERE source = ps AND time <> pt UNION ALL SELECT recording_id, role, frame, 'resolved_without_source' FROM m WHERE source < 0 AND status <> 'UNRESOLVED'
UNION ALL SELECT recording_id, role, frame, 'unresolved_with_source' FROM m WHERE source >= 0 AND status = 'UNRESOLVED'"""))  # fmt: skip
def check_frame_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qc.check_frame_map(_frame_map(spark, sf_dir), ["recording_id", "role"])


@query(sql("frames6", _MAP + " SELECT recording_id, role, frame, source, time FROM m WHERE status = 'VERIFIED'"))
def require_verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qc.require(_frame_map(spark, sf_dir)).drop("status")


@query(sql("intervals", """a AS (SELECT recording_id, start_frame + CASE WHEN iv % 4 = 0 THEN 1 ELSE 0 END AS frame, start_frame // 3 AS seconds FROM intervals), o AS (SELECT *, unnest([0, 1]) AS origin FROM a)
SELECT recording_id, origin, max(abs((frame - origin) * 1 - seconds * 3)) AS max_residual, count(*) FILTER (abs((frame - origin) - seconds * 3) > 2) AS n_over, count(*) AS n FROM o GROUP BY ALL"""))  # fmt: skip
def frame_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = fx.intervals(spark, sf_dir).selectExpr("recording_id", "start_frame + CASE WHEN iv % 4 = 0 THEN 1 ELSE 0 END AS frame", "start_frame div 3 AS seconds")
    return qc.frame_origin(a, ["recording_id"], 3, 1, 2)


_STREAM = """s AS (SELECT recording_id, role, count(*) FILTER (n > 0) / count(*) AS present, avg(CASE WHEN val > 20 THEN 1.0 ELSE 0.0 END) AS good, quantile_cont(val, 0.5) AS median FROM frames6 GROUP BY ALL)"""


def _stream_qc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.frames(spark, sf_dir, 6).groupBy("recording_id", "role").agg(
        (F.count_if(F.col("n") > 0) / F.count(F.lit(1))).alias("present"), F.avg(F.when(F.col("val") > 20, 1.0).otherwise(0.0)).alias("good"), F.percentile("val", F.lit(0.5)).alias("median"))


@query(sql("frames6", _STREAM + " SELECT recording_id, role, round(present, 6) AS present, round(good, 6) AS good, round(median, 6) AS median FROM s"))
def stream_qc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_stream_qc(spark, sf_dir), "present", "good", "median")


@query(sql("frames6", _STREAM + """, b AS (SELECT recording_id, avg(CASE WHEN n0 > 0 AND n1 > 0 THEN 1.0 ELSE 0.0 END) AS both_visible FROM (SELECT recording_id, frame, max(CASE WHEN role = 0 THEN n END) AS n0, max(CASE WHEN role = 1 THEN n END) AS n1 FROM frames6 GROUP BY ALL) GROUP BY 1)
SELECT recording_id, round(min(present), 6) AS worst_present, round(min(good), 6) AS worst_good, round(any_value(both_visible), 6) AS both_visible, count(median) = count(*) AS complete FROM s JOIN b USING (recording_id) GROUP BY 1"""))  # fmt: skip
def episode_qc(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = fx.frames(spark, sf_dir, 6).groupBy("recording_id", "frame").agg(F.bool_and(F.col("n") > 0).alias("both")).groupBy("recording_id").agg(F.avg(F.col("both").cast("double")).alias("both_visible"))
    out = _stream_qc(spark, sf_dir).groupBy("recording_id").agg(F.min("present").alias("worst_present"), F.min("good").alias("worst_good"), F.bool_and(F.col("median").isNotNull()).alias("complete"))
    return _rounded(out.join(both, "recording_id"), "worst_present", "worst_good", "both_visible")


@query(sql("frames6", _STREAM + """, v AS (SELECT recording_id, role, 'good' AS metric, good AS value, 0.2 AS flag, 0.05 AS reject FROM s UNION ALL SELECT recording_id, role, 'median', median, 40, 25 FROM s),
r AS (SELECT *, CASE WHEN value IS NULL THEN 1 WHEN value < reject THEN 3 WHEN value < flag THEN 2 ELSE 0 END AS rank FROM v)
SELECT recording_id, role, ['pass', 'missing', 'flag', 'reject'][max(rank) + 1] AS verdict, coalesce(string_agg(metric || ':' || ['pass', 'missing', 'flag', 'reject'][rank + 1], ',' ORDER BY metric) FILTER (rank > 0), '') AS reasons FROM r GROUP BY ALL"""))  # fmt: skip
def grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _stream_qc(spark, sf_dir)
    values = s.select("recording_id", "role", F.explode(F.array(F.struct(F.lit("good").alias("metric"), F.col("good").alias("value")), F.struct(F.lit("median").alias("metric"), F.col("median").alias("value")))).alias("m")).select("recording_id", "role", "m.*")
    return qc.grade(values, ["recording_id", "role"], spark.createDataFrame([("good", 0.2, 0.05), ("median", 40.0, 25.0)], "metric string, flag double, reject double"))


_SCOPE = """e AS (SELECT recording_id, iv, start_frame, end_frame, cue, initiator FROM intervals WHERE NOT skip),
f AS (SELECT e.*, x.role, x.frame, x.n, x.val FROM e JOIN frames x ON e.recording_id = x.recording_id AND x.frame BETWEEN start_frame - 6 AND end_frame + 6),
m AS (SELECT recording_id, iv, cue, initiator, start_frame, count(*) FILTER (role = 0) AS n_frames, count(*) FILTER (role = 0 AND n > 0) / nullif(count(*) FILTER (role = 0), 0) AS cover_0, count(*) FILTER (role = 1 AND n > 0) / nullif(count(*) FILTER (role = 1), 0) AS cover_1,
  max(val) AS peak, quantile_cont(val, 0.5) AS median FROM f GROUP BY ALL)"""


def scope_metrics_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage per role, peak and median over each event and six frames around it."""
    e = fx.intervals(spark, sf_dir).filter("NOT skip").withColumn("frame", F.explode(F.sequence(F.col("start_frame") - 6, F.col("end_frame") + 6)))
    rows = e.join(fx.frames(spark, sf_dir), ["recording_id", "frame"])
    cover = lambda r: F.try_divide(F.count_if((F.col("role") == r) & (F.col("n") > 0)), F.count_if(F.col("role") == r))
    return rows.groupBy("recording_id", "iv", "cue", "initiator", "start_frame").agg(
        F.count_if(F.col("role") == 0).alias("n_frames"), cover(0).alias("cover_0"), cover(1).alias("cover_1"), F.max("val").alias("peak"), F.percentile("val", F.lit(0.5)).alias("median"))


_FRAMES = """f AS (SELECT recording_id, role, frame, (frame * 5 + recording_id) % 41 <> 0 AS verified, (frame * 3 + role) % 10 / 20.0 + 0.5 AS map_conf, (frame * 7 + role * 3 + recording_id) % 37 <> 0 AS pose, (frame * 13 + role) % 97 AS residual,
  (frame + role * 2) % 19 <> 0 AS l, (frame * 3 + role) % 23 <> 0 AS r, 0.8 + (frame * 7 + role) % 20 / 100.0 AS lc, 0.85 + (frame * 11 + role) % 15 / 100.0 AS rc, val / 20 AS speed FROM frames),
w AS (SELECT recording_id, frame, bool_and(verified) AS verified, """ + ", ".join(f"max({c}) FILTER (role = {r}) AS {c}{r}" for c in ("map_conf", "pose", "residual", "l", "r", "lc", "rc", "speed") for r in (0, 1)) + """, (frame * 17 + recording_id) % 50 / 10.0 AS distance FROM f GROUP BY recording_id, frame),
e AS (SELECT recording_id, iv, 'event' AS scope, unnest(range(start_frame, end_frame + 1)) AS frame FROM intervals WHERE NOT skip UNION ALL SELECT recording_id, iv, 'context', unnest(range(greatest(start_frame - 6, 0), least(end_frame + 6, (SELECT max(frame) FROM frames)) + 1)) FROM intervals WHERE NOT skip),
j AS (SELECT e.recording_id, e.iv, e.scope, w.* EXCLUDE (recording_id, frame) FROM e JOIN w USING (recording_id, frame)),
a AS (SELECT recording_id, iv, scope, bool_and(verified) AS verified, avg(CAST(pose0 AS INT)) AS pose_0, avg(CAST(pose1 AS INT)) AS pose_1, avg(CAST(l0 OR r0 AS INT)) AS any_0, avg(CAST(l1 OR r1 AS INT)) AS any_1, avg(CAST((l0 OR r0) AND (l1 OR r1) AS INT)) AS both_any,
  avg(CAST(l0 AND r0 AND l1 AND r1 AS INT)) AS all_four, least(quantile_cont(map_conf0, 0.5), quantile_cont(map_conf1, 0.5)) AS map_conf, quantile_cont(distance, 0.5) AS distance, count(*) FILTER (speed0 > 5) + count(*) FILTER (speed1 > 5) AS n_fast,
  greatest(coalesce(count(*) FILTER (speed0 > 5) / nullif(count(speed0), 0), 0), coalesce(count(*) FILTER (speed1 > 5) / nullif(count(speed1), 0), 0)) AS fast_rate FROM j GROUP BY ALL),
c AS (SELECT recording_id, iv, scope, quantile_cont(v, 0.5) AS conf FROM (SELECT recording_id, iv, scope, unnest([CASE WHEN l0 THEN lc0 END, CASE WHEN r0 THEN rc0 END, CASE WHEN l1 THEN lc1 END, CASE WHEN r1 THEN rc1 END]) AS v FROM j) GROUP BY ALL),
q AS (SELECT recording_id, iv, scope, quantile_cont(v, 0.95) AS residual_p95 FROM (SELECT recording_id, iv, scope, unnest([residual0, residual1]) AS v FROM j) GROUP BY ALL),
m AS (SELECT * FROM a LEFT JOIN c USING (recording_id, iv, scope) LEFT JOIN q USING (recording_id, iv, scope)),
ev AS (SELECT * EXCLUDE (scope) FROM m WHERE scope = 'event'), cx AS (SELECT * EXCLUDE (scope) FROM m WHERE scope = 'context')
"""
_METRICS = ["verified", "pose_0", "pose_1", "any_0", "any_1", "both_any", "all_four", "map_conf", "distance", "n_fast", "fast_rate", "conf", "residual_p95"]


def _tracked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """What is tracked of both people per frame, and their distance."""
    f = fx.frames(spark, sf_dir).selectExpr(
        "recording_id", "role", "frame", "(frame * 5 + recording_id) % 41 <> 0 AS verified", "(frame * 3 + role) % 10 / 20 + 0.5 AS map_conf", "(frame * 7 + role * 3 + recording_id) % 37 <> 0 AS pose", "cast((frame * 13 + role) % 97 AS double) AS residual",
        "(frame + role * 2) % 19 <> 0 AS left", "(frame * 3 + role) % 23 <> 0 AS right", "0.8D + (frame * 7 + role) % 20 / 100 AS left_conf", "0.85D + (frame * 11 + role) % 15 / 100 AS right_conf", "val / 20 AS speed",
    )
    near = f.filter("role = 0").selectExpr("recording_id", "frame", "(frame * 17 + recording_id) % 50 / 10 AS distance")
    return f, near


def _scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scopes.scope_metrics(*_tracked(spark, sf_dir), fx.intervals(spark, sf_dir).filter("NOT skip"), ["recording_id"], 6, 5.0)


_WIDE = ", ".join(f"{t}.{c} AS {s}_{c}" if c in ("verified", "n_fast") else f"round({t}.{c}, 6) AS {s}_{c}" for t, s in (("ev", "event"), ("cx", "context")) for c in _METRICS)


@query(sql("frames intervals", _FRAMES + f" SELECT recording_id, iv, {_WIDE} FROM ev JOIN cx USING (recording_id, iv)"))
def scope_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_scoped(spark, sf_dir), *(f"{s}_{c}" for s in scopes.SCOPES for c in _METRICS if c not in ("verified", "n_fast")))


@query(sql("frames intervals", _FRAMES + """ SELECT recording_id, iv,
CASE WHEN NOT cx.verified OR least(ev.pose_0, ev.pose_1) < 1 OR ev.all_four < 0.9 THEN 'exclude' WHEN ev.all_four < 1 OR cx.all_four < 0.75 OR least(cx.pose_0, cx.pose_1) < 1 OR ev.n_fast > 0 OR cx.n_fast > 0 THEN 'caution' ELSE 'acceptable' END AS status,
CASE WHEN NOT cx.verified THEN 'context_not_verified' WHEN least(ev.pose_0, ev.pose_1) < 1 THEN 'event_pose_incomplete' WHEN ev.all_four < 0.9 THEN 'event_hands_missing' WHEN ev.all_four < 1 THEN 'event_hands_incomplete'
  WHEN cx.all_four < 0.75 OR least(cx.pose_0, cx.pose_1) < 1 THEN 'context_gaps' WHEN ev.n_fast > 0 OR cx.n_fast > 0 THEN 'fast_wrists' ELSE 'complete' END AS reason,
concat_ws(',', CASE WHEN NOT ev.verified THEN 'event_not_verified' END, CASE WHEN ev.pose_0 < 0.95 THEN 'event_pose_0' END, CASE WHEN ev.pose_1 < 0.95 THEN 'event_pose_1' END, CASE WHEN ev.n_fast > 0 THEN 'event_fast_wrists' END,
  CASE WHEN NOT cx.verified THEN 'context_not_verified' END, CASE WHEN cx.pose_0 < 0.95 THEN 'context_pose_0' END, CASE WHEN cx.pose_1 < 0.95 THEN 'context_pose_1' END, CASE WHEN cx.n_fast > 0 THEN 'context_fast_wrists' END,
  CASE WHEN ev.any_0 < 0.8 THEN 'event_hand_0' END, CASE WHEN ev.any_1 < 0.8 THEN 'event_hand_1' END, CASE WHEN coalesce(ev.conf, -1) < 0.9 THEN 'event_conf' END) AS failed FROM ev JOIN cx USING (recording_id, iv)"""))
def recommend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The recommendation with its reason, and all rules of the demo gate that fail, of every event."""
    return _scoped(spark, sf_dir).select("recording_id", "iv", scopes.recommendation().alias("r"), scopes.demo_failures().alias("failed")).select("recording_id", "iv", "r.status", "r.reason", "failed")


@query(sql("frames intervals", _FRAMES + """, k AS (SELECT recording_id, iv, cx.verified AS verified, row_number() OVER (PARTITION BY recording_id ORDER BY CASE WHEN cx.verified THEN 0 ELSE 1 END, round(ev.both_any, 9) DESC, round(ev.all_four, 9) DESC, round(least(ev.pose_0, ev.pose_1), 9) DESC,
  round(ev.map_conf, 9) DESC, round(ev.conf, 9) DESC NULLS LAST, round(ev.residual_p95, 9) NULLS LAST, round(ev.distance, 9) NULLS LAST, round(ev.fast_rate, 9), iv) AS rank FROM ev JOIN cx USING (recording_id, iv))
SELECT recording_id, iv, CAST(rank AS INT) AS rank, rank = 1 AND verified AS selected FROM k"""))
def rank_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a recording from the best to the worst, and the one that is selected."""
    return scopes.rank_handovers(_scoped(spark, sf_dir), ["recording_id"]).select("recording_id", "iv", "rank", "selected")


@query(sql("frames intervals", _SCOPE + """ SELECT cue, initiator, count(*) AS n, round(quantile_cont(peak, 0.5), 6) AS median_peak, round(quantile_cont(peak, 0.75) - quantile_cont(peak, 0.25), 6) AS iqr_peak, round(avg(cover_0), 6) AS cover FROM m GROUP BY GROUPING SETS ((cue), (initiator), (cue, initiator), ())"""))
def quality_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, medians and quartile ranges by cue, by initiator, by both and over all."""
    m = scope_metrics_of(spark, sf_dir)
    p = lambda q: F.percentile("peak", F.lit(q))
    c, i = F.col("cue"), F.col("initiator")
    out = m.groupingSets([[c], [i], [c, i], []], c, i).agg(F.count(F.lit(1)).alias("n"), p(0.5).alias("median_peak"), (p(0.75) - p(0.25)).alias("iqr_peak"), F.avg("cover_0").alias("cover"))
    return _rounded(out, "median_peak", "iqr_peak", "cover")


_DAY = """d AS (SELECT recording_id, frame // 24 AS day, sum(n) AS n_events, count(*) FILTER (n = 0) / count(*) AS idle, count(DISTINCT role) FILTER (n > 0) AS n_people FROM frames GROUP BY ALL)"""


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.frames(spark, sf_dir).groupBy("recording_id", F.expr("frame div 24").alias("day")).agg(F.sum("n").alias("n_events"), (F.count_if(F.col("n") == 0) / F.count(F.lit(1))).alias("idle"), F.count_distinct(F.when(F.col("n") > 0, F.col("role"))).alias("n_people"))


@query(sql("frames", _DAY + " SELECT recording_id, CAST(day AS BIGINT) AS day, CAST(n_events AS BIGINT) AS n_events, round(idle, 6) AS idle, n_people FROM d"))
def per_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_daily(spark, sf_dir), "idle")


@query(sql("frames", _DAY + """, s AS (SELECT recording_id, sum(n_events) / count(*) AS rate, quantile_cont(n_events, 0.5) AS median, avg(idle) AS idle, avg(CASE WHEN n_people = 2 THEN 1.0 ELSE 0.0 END) AS together FROM d GROUP BY 1)
SELECT recording_id, round(rate, 6) AS rate, round(median, 6) AS median, round(idle, 6) AS idle, round(together, 6) AS together, round((least(rate / 10, 1) + (1 - idle) + together) / 3 * 100, 6) AS score FROM s"""))  # fmt: skip
def session_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates, medians and the coordination score of every recording."""
    out = _daily(spark, sf_dir).groupBy("recording_id").agg((F.sum("n_events") / F.count(F.lit(1))).alias("rate"), F.percentile("n_events", F.lit(0.5)).alias("median"), F.avg("idle").alias("idle"), F.avg((F.col("n_people") == 2).cast("double")).alias("together"))
    points, _ = qc.score([F.col("rate") / 10, 1 - F.col("idle"), F.col("together")])
    return _rounded(out.withColumn("score", points), "rate", "median", "idle", "together", "score")


@query(sql("frames6", """h AS (SELECT recording_id, role, frame, CASE WHEN n = 0 THEN NULL WHEN n = 1 THEN 'one' ELSE 'many' END AS object FROM frames6),
t AS (SELECT recording_id, count(DISTINCT frame) AS n_frames, round(count(DISTINCT CASE WHEN object IS NOT NULL THEN frame END) / count(DISTINCT frame), 6) AS "any", round(count(object) FILTER (role = 0) / count(*) FILTER (role = 0), 6) AS hand_0,
  round(count(object) FILTER (role = 1) / count(*) FILTER (role = 1), 6) AS hand_1, count(*) FILTER (object = 'one') AS n_one, count(*) FILTER (object = 'many') AS n_many FROM h GROUP BY 1)
SELECT * FROM t"""))
def contact_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = fx.frames(spark, sf_dir, 6).select("recording_id", "role", "frame", F.expr("CASE WHEN n = 0 THEN NULL WHEN n = 1 THEN 'one' ELSE 'many' END AS object"))
    out = scopes.contact_report(held, ["recording_id"], "role")
    of = lambda o: F.coalesce(F.try_element_at("objects", F.lit(o)), F.lit(0)).alias(f"n_{o}")
    return out.select("recording_id", "n_frames", F.round("any", 6).alias("any"), *(F.round(F.col("by_hand")[str(r)], 6).alias(f"hand_{r}") for r in (0, 1)), of("one"), of("many"))


def _in_world(samples: DataFrame, poses: DataFrame) -> DataFrame:
    points = samples.select(F.col("recording_id").alias("rec"), F.expr("t div 3600000000 - 473352").alias("t"), "recording_id", "role", F.col("idx").alias("q_idx"), "val")
    cols = ["x", "y", "z", "qx", "qy", "qz", "qw"]
    poses = poses.select(F.col("recording_id").alias("rec"), (F.col("frame") * 15).cast("bigint").alias("t"), F.col("frame").cast("bigint").alias("idx"), *cols)
    near = align.asof_nearest(points, poses, ["rec"], 5, cols)
    r = g.rotation(g.cols(*(f"sample_{c}" for c in cols[3:])))
    w = g.applied(r, g.cols("sample_x", "sample_y", "sample_z"), [F.col("val") / 100, F.lit(0.0), F.lit(0.0)])
    ok = F.col("status") == "matched"
    return near.select("recording_id", "role", F.col("q_idx").alias("idx"), F.when(ok, F.round(w[0], 6)).alias("wx"), F.when(ok, F.round(w[1], 6)).alias("wy"), "status")


@query(sql("samples poses", """q AS (SELECT recording_id, role, idx, t // 3600000000 - 473352 AS t, val FROM samples),
p AS (SELECT recording_id, frame * 15 AS t, x, y, z, qx, qy, qz, qw FROM poses),
m AS (SELECT q.*, p.t AS pt, p.x, p.y, p.z, p.qx, p.qy, p.qz, p.qw, row_number() OVER (PARTITION BY q.recording_id, role, idx ORDER BY abs(p.t - q.t), p.t) AS k FROM q LEFT JOIN p USING (recording_id))
SELECT recording_id, role, idx, CASE WHEN abs(pt - t) <= 5 THEN round((1 - 2 * (qy * qy + qz * qz)) * val / 100 + x, 6) END AS wx, CASE WHEN abs(pt - t) <= 5 THEN round(2 * (qx * qy + qz * qw) * val / 100 + y, 6) END AS wy,
  CASE WHEN pt IS NULL THEN 'no_samples' WHEN abs(pt - t) <= 5 THEN 'matched' ELSE 'gap_exceeded' END AS status FROM m WHERE k = 1"""))  # fmt: skip
def to_world(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points on a device's first axis in the world, by the nearest pose within five hours; others are unknown. Points of
    recordings without a pose have no_samples."""
    return _in_world(fx.samples(spark, sf_dir), fx.poses(spark, sf_dir))


also("to_world_all", to_world)

@query(sql("frames6", "SELECT a.recording_id, a.frame, round(a.val, 6) AS first_val, round(b.val, 6) AS second_val, CAST(a.n + b.n AS BIGINT) AS n FROM frames6 a JOIN frames6 b USING (recording_id, frame) WHERE a.role = 0 AND b.role = 1"))
def pair_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fx.frames(spark, sf_dir, 6)
    out = f.filter("role = 0").alias("a").join(f.filter("role = 1").alias("b"), ["recording_id", "frame"])
    return out.select("recording_id", "frame", F.round("a.val", 6).alias("first_val"), F.round("b.val", 6).alias("second_val"), (F.col("a.n") + F.col("b.n")).alias("n"))


_EDGES = """o AS (SELECT *, max(frame) OVER (PARTITION BY recording_id) AS last FROM poses),
e AS (SELECT recording_id, CASE WHEN vec_id % 37 = 0 AND 2 * frame + 1 <= last THEN 2 * frame + 1 ELSE (frame - 1) // 2 END AS a, frame AS b, x, y, z, qx, qy, qz, qw FROM o WHERE frame > 0
  UNION ALL SELECT recording_id, frame - 1, frame, x, y, z, qx, qy, qz, qw FROM o WHERE frame > 2 AND vec_id % 23 = 0),
n AS (SELECT recording_id, b, count(*) AS c FROM e GROUP BY ALL), u AS MATERIALIZED (SELECT e.* FROM e JOIN n USING (recording_id, b) WHERE c = 1),
r AS (SELECT DISTINCT recording_id, a AS node FROM e WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.recording_id = e.recording_id AND n.b = e.a)),
p(recording_id, node, root, hops, x, y, z, qx, qy, qz, qw) AS (
  SELECT recording_id, node, node, 0, 0::DOUBLE, 0::DOUBLE, 0::DOUBLE, 0::DOUBLE, 0::DOUBLE, 0::DOUBLE, 1::DOUBLE FROM r
  UNION ALL SELECT p.recording_id, u.b, root, hops + 1,
    p.x + (1 - 2 * (p.qy * p.qy + p.qz * p.qz)) * u.x + 2 * (p.qx * p.qy - p.qz * p.qw) * u.y + 2 * (p.qx * p.qz + p.qy * p.qw) * u.z,
    p.y + 2 * (p.qx * p.qy + p.qz * p.qw) * u.x + (1 - 2 * (p.qx * p.qx + p.qz * p.qz)) * u.y + 2 * (p.qy * p.qz - p.qx * p.qw) * u.z,
    p.z + 2 * (p.qx * p.qz - p.qy * p.qw) * u.x + 2 * (p.qy * p.qz + p.qx * p.qw) * u.y + (1 - 2 * (p.qx * p.qx + p.qy * p.qy)) * u.z,
    p.qw * u.qx + p.qx * u.qw + p.qy * u.qz - p.qz * u.qy, p.qw * u.qy - p.qx * u.qz + p.qy * u.qw + p.qz * u.qx, p.qw * u.qz + p.qx * u.qy - p.qy * u.qx + p.qz * u.qw, p.qw * u.qw - p.qx * u.qx - p.qy * u.qy - p.qz * u.qz
  FROM p JOIN u ON u.recording_id = p.recording_id AND u.a = p.node)
SELECT n.recording_id, n.b AS node, p.root, CAST(p.hops AS BIGINT) AS hops, CASE WHEN n.c > 1 THEN 'second_path' WHEN p.root IS NULL THEN 'unreached' ELSE 'ok' END AS status, """ + ", ".join(f"round(p.{c}, 5) AS {c}" for c in "x y z qx qy qz qw".split()) + """
FROM n LEFT JOIN p ON p.recording_id = n.recording_id AND p.node = n.b"""


@query(recursive(sql("poses", _EDGES)))
def compose_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every recording's poses as a tree of frames, with some cycles and some frames that two edges lead to."""
    w = Window.partitionBy("recording_id")
    p = fx.poses(spark, sf_dir).withColumn("frame", F.col("frame").cast("long")).withColumn("last", F.max("frame").over(w))
    tree = p.filter("frame > 0").selectExpr("recording_id", "if(vec_id % 37 = 0 AND 2 * frame + 1 <= last, 2 * frame + 1, (frame - 1) div 2) AS a", "frame AS b", *graph.POSE)
    second = p.filter("frame > 2 AND vec_id % 23 = 0").selectExpr("recording_id", "frame - 1 AS a", "frame AS b", *graph.POSE)
    return _rounded(graph.compose_paths(tree.unionByName(second), ["recording_id"]), *graph.POSE, digits=5)


_PLANNED = """u AS (SELECT recording_id, frame FROM frames GROUP BY ALL HAVING count(*) FILTER ((frame * 5 + recording_id) % 41 <> 0) < 2), lf AS (SELECT recording_id, max(frame) AS last FROM frames GROUP BY 1),
ev0 AS (SELECT i.recording_id, iv, CASE WHEN iv % 31 = 0 THEN NULL ELSE start_frame END AS start_frame, CASE WHEN iv % 29 = 0 THEN start_frame - 1 ELSE end_frame END AS end_frame, last FROM intervals i LEFT JOIN lf USING (recording_id) WHERE NOT skip),
pl AS (SELECT e.*, coalesce(start_frame >= 0 AND start_frame <= end_frame AND end_frame <= last, false) AS inside, """ + ", ".join(f"(SELECT min(frame) FROM u WHERE u.recording_id = e.recording_id AND frame BETWEEN greatest(start_frame - {c}, 0) AND least(end_frame + {c}, last)) AS bad{c}" for c in (0, 12, 4)) + """ FROM ev0 e),
st AS (SELECT recording_id, iv, start_frame, end_frame, last, CASE WHEN NOT inside THEN NULL WHEN bad12 IS NULL THEN 12 WHEN bad4 IS NULL THEN 4 END AS around,
  CASE WHEN NOT inside THEN 'annotation_bounds' WHEN bad0 IS NOT NULL THEN 'event_mapping' WHEN bad12 IS NOT NULL AND bad4 IS NOT NULL THEN 'context_mapping' WHEN recording_id % 9 = 0 THEN 'derived_validation' END AS stage,
  CASE WHEN NOT inside THEN 'outside the recording' WHEN bad0 IS NOT NULL THEN 'frame ' || bad0 || ' is not verified' WHEN bad12 IS NOT NULL AND bad4 IS NOT NULL THEN 'frame ' || bad4 || ' is not verified' WHEN recording_id % 9 = 0 THEN 'no calibration' END AS reason FROM pl),"""
_ASSESSED = _FRAMES[_FRAMES.index("f AS (") : _FRAMES.index("e AS (SELECT recording_id, iv, 'event'")] + _PLANNED + """
e AS (SELECT recording_id, iv, 'event' AS scope, unnest(range(start_frame, end_frame + 1)) AS frame FROM st WHERE stage IS NULL UNION ALL SELECT recording_id, iv, 'context', unnest(range(greatest(start_frame - around, 0), least(end_frame + around, last) + 1)) FROM st WHERE stage IS NULL),
""" + _FRAMES[_FRAMES.index("j AS (SELECT e.recording_id") :] + """, rc AS (SELECT recording_id, iv, CASE WHEN NOT cx.verified THEN 'context_not_verified' WHEN least(ev.pose_0, ev.pose_1) < 1 THEN 'event_pose_incomplete' WHEN ev.all_four < 0.9 THEN 'event_hands_missing' WHEN ev.all_four < 1 THEN 'event_hands_incomplete'
  WHEN cx.all_four < 0.75 OR least(cx.pose_0, cx.pose_1) < 1 THEN 'context_gaps' WHEN ev.n_fast > 0 OR cx.n_fast > 0 THEN 'fast_wrists' ELSE 'complete' END AS why FROM ev JOIN cx USING (recording_id, iv)),
rk AS (SELECT recording_id, iv, row_number() OVER (PARTITION BY recording_id ORDER BY CASE WHEN cx.verified THEN 0 ELSE 1 END, round(ev.both_any, 9) DESC, round(ev.all_four, 9) DESC, round(least(ev.pose_0, ev.pose_1), 9) DESC,
  round(ev.map_conf, 9) DESC, round(ev.conf, 9) DESC NULLS LAST, round(ev.residual_p95, 9) NULLS LAST, round(ev.distance, 9) NULLS LAST, round(ev.fast_rate, 9), iv) AS rank FROM ev JOIN cx USING (recording_id, iv) JOIN rc USING (recording_id, iv) WHERE why NOT IN ('context_not_verified', 'event_pose_incomplete', 'event_hands_missing')),
fin AS (SELECT st.*, why, rank, CASE WHEN stage IS NULL AND rank IS NULL THEN 'tracking_qc' ELSE stage END AS stg FROM st LEFT JOIN rc USING (recording_id, iv) LEFT JOIN rk USING (recording_id, iv))
SELECT recording_id, iv, CASE WHEN stg IS NULL THEN 'accepted' ELSE 'rejected' END AS status, stg AS stage, CASE WHEN stg = 'tracking_qc' THEN why ELSE reason END AS reason, CASE WHEN stg IS NULL THEN around END AS around,
  CASE WHEN stg IS NULL THEN greatest(start_frame - around, 0) END AS clip_start, CASE WHEN stg IS NULL THEN least(end_frame + around, last) END AS clip_end, CASE WHEN stg IS NULL THEN why <> 'complete' END AS caution, CASE WHEN stg IS NULL THEN why END AS detail, CAST(rank AS INT) AS rank FROM fin"""


@query(sql("frames intervals", _ASSESSED))
def assess_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event accepted with its clip and rank, or rejected with stage and reason; some annotations have no start or end before it."""
    f, near = _tracked(spark, sf_dir)
    events = fx.intervals(spark, sf_dir).filter("NOT skip").withColumn("s", F.when(F.col("iv") % 31 != 0, F.col("start_frame"))).withColumn("end_frame", F.when(F.col("iv") % 29 == 0, F.col("start_frame") - 1).otherwise(F.col("end_frame")))
    events = events.withColumn("start_frame", F.col("s")).drop("s")
    recordings = fx.grid(spark, sf_dir).select("recording_id").distinct().selectExpr("recording_id", "recording_id % 9 <> 0 AS valid", "if(recording_id % 9 = 0, 'no calibration', null) AS problem")
    return scopes.assess_events(events, f, near, recordings, ["recording_id"], (12, 4))


_SHARES = ["good_frame_percent", "lighting_score", "average_brightness", "average_sharpness", "median_motion", "average_motion", "presence", "stability_score"]
_RANK = {c: "CASE WHEN {a} IS NULL THEN 1 " + (f"WHEN {{a}} < {lo} THEN 3 " if lo is not None else "") + f"WHEN {{a}} < {hi} THEN 2 ELSE 0 END" for c, (lo, hi) in qc.LEVELS.items()}
_QUALITY = """f AS (SELECT recording_id, role, CASE WHEN role = 0 THEN 'ego' ELSE 'exo' END AS kind, n * 23.0 AS sharp, (frame * 37 + recording_id * 11) % 256 AS bright, CASE WHEN n > 0 THEN val / 900 END AS motion, CASE WHEN recording_id % 13 <> 0 THEN n > 0 END AS present FROM frames6),
m AS (SELECT recording_id, role, kind, count(*) AS n_frames, avg(CASE WHEN sharp > 40 AND bright > 35 AND bright < 225 THEN 1.0 ELSE 0 END) AS good_frame_percent, avg(CASE WHEN bright BETWEEN 35 AND 225 THEN 1.0 ELSE 0 END) AS lighting_score, avg(bright) AS average_brightness, avg(sharp) AS average_sharpness,
  median(motion) AS median_motion, avg(motion) AS average_motion, avg(CAST(present AS INT)) AS presence, greatest(0, least(1, 1 - median(motion) / 0.1875)) AS stability FROM f GROUP BY ALL),
v AS (SELECT *, CASE WHEN median_motion IS NOT NULL THEN stability END AS stability_score, CASE WHEN kind = 'ego' THEN presence END AS hand_presence_ratio, CASE WHEN kind = 'exo' THEN presence END AS person_presence_ratio FROM m),
r AS (SELECT *, """ + ", ".join((f"CASE WHEN kind <> '{dict(hand_presence_ratio='ego', person_presence_ratio='exo')[c]}' THEN 0 ELSE {e.format(a=c)} END" if c.endswith("_ratio") else e.format(a=c)) + f" AS k_{c}" for c, e in _RANK.items()) + """ FROM v)
SELECT recording_id, role, kind, n_frames, """ + ", ".join(f"CAST(round(CAST(round({c}, 9) AS DECIMAL(38, 9)), {6 if 'motion' in c else 5}) AS DOUBLE) AS {c}" for c in _SHARES) + """,
  ['pass', 'missing', 'flag', 'reject'][greatest(""" + ", ".join(f"k_{c}" for c in _RANK) + ") + 1] AS verdict, concat_ws(',', " + ", ".join(f"CASE WHEN k_{c} > 0 THEN '{c}:' || ['missing', 'flag', 'reject'][k_{c}] END" for c in sorted(_RANK)) + ") AS reasons FROM r"


@query(sql("frames6", _QUALITY))
def stream_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One person's frames as an ego stream's, the other's as an exo stream's. What lies halfway between two values to nine
    digits is rounded away from zero, whatever the order of adding."""
    f = fx.frames(spark, sf_dir, 6).selectExpr(
        "recording_id", "role", "if(role = 0, 'ego', 'exo') AS kind", "n * 23.0D AS sharp", "cast((frame * 37 + recording_id * 11) % 256 AS double) AS bright", "if(n > 0, val / 900, null) AS motion", "if(recording_id % 13 <> 0, n > 0, null) AS present",
    )
    out = qc.stream_quality(f, ["recording_id", "role"])
    return out.withColumns({c: F.round(F.round(c, 9), 6 if "motion" in c else 5) for c in _SHARES})
