"""Queries on frames, intervals and events, with the same rows in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tandem.operators import intervals as iv
from tandem.operators import sequence as seq
from tandem.sources import fixtures as fx

from .oracle import recursive, sql
from .registry import also, query

REC, SERIES = ["recording_id"], ["recording_id", "role"]


def _rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols})


def usable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.intervals(spark, sf_dir).filter("NOT skip")


def onsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hourly grid with onset: a usable interval starts in the frame."""
    at = usable(spark, sf_dir).select("recording_id", F.col("start_frame").alias("frame")).distinct().withColumn("onset", F.lit(True))
    return fx.grid(spark, sf_dir).join(at, ["recording_id", "frame"], "left").withColumn("onset", F.coalesce("onset", F.lit(False)))


_ONSETS = "o AS (SELECT g.recording_id, g.frame, x.frame IS NOT NULL AS onset FROM grid g LEFT JOIN (SELECT DISTINCT recording_id, start_frame AS frame FROM intervals WHERE NOT skip) x USING (recording_id, frame))"


@query(sql("intervals", "SELECT recording_id, iv, start_frame, end_frame, initiator = 1 AS by_second, cue = 0 AS spoken FROM intervals WHERE NOT skip"))
def usable_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usable(spark, sf_dir).select("recording_id", "iv", "start_frame", "end_frame", (F.col("initiator") == 1).alias("by_second"), (F.col("cue") == 0).alias("spoken"))


@query(sql("grid", "SELECT recording_id, frame FROM grid"))
def frame_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.grid(spark, sf_dir)


@query(sql("grid intervals", "SELECT g.recording_id, g.frame, EXISTS (SELECT 1 FROM intervals i WHERE i.recording_id = g.recording_id AND NOT skip AND g.frame BETWEEN start_frame AND end_frame) AS active FROM grid g"))
def interval_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iv.interval_mask(fx.grid(spark, sf_dir), usable(spark, sf_dir), REC)


@query(sql("grid intervals", _ONSETS + """
SELECT a.recording_id, a.frame, bool_or(coalesce(b.onset AND b.frame <= a.frame + 1, false)) AS onset_1, bool_or(coalesce(b.onset AND b.frame <= a.frame + 3, false)) AS onset_3, bool_or(coalesce(b.onset, false)) AS onset_8
FROM o a LEFT JOIN o b ON a.recording_id = b.recording_id AND b.frame BETWEEN a.frame + 1 AND a.frame + 8 GROUP BY ALL"""))  # fmt: skip
def onset_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seq.onset_within(onsets(spark, sf_dir), REC, "onset", [1, 3, 8]).drop("onset")


@query(sql("grid intervals", _ONSETS + """,
n AS (SELECT a.recording_id, a.frame, min(b.frame) AS nxt FROM o a LEFT JOIN o b ON a.recording_id = b.recording_id AND b.onset AND b.frame > a.frame GROUP BY ALL)
SELECT recording_id, frame, CAST(least(coalesce(nxt - frame, 48), 48) AS INT) AS to_next FROM n"""))  # fmt: skip
def time_to_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seq.time_to_next(onsets(spark, sf_dir), REC, "onset", 48).drop("onset")


@query(sql("grid intervals", """
h AS (SELECT g.recording_id, g.frame, arg_max(end_frame, (start_frame, iv)) AS e FROM grid g JOIN intervals i ON g.recording_id = i.recording_id AND NOT skip AND g.frame BETWEEN start_frame AND end_frame GROUP BY ALL)
SELECT recording_id, frame, e - frame AS to_end FROM grid LEFT JOIN h USING (recording_id, frame)"""))  # fmt: skip
def time_to_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seq.time_to_end(fx.grid(spark, sf_dir), usable(spark, sf_dir), REC)


@query(sql("grid intervals", _ONSETS + """,
a AS (SELECT g.recording_id, g.frame, bool_or(i.iv IS NOT NULL) AS active, bool_or(coalesce(i.cue = 0, false)) AS attention FROM grid g LEFT JOIN intervals i ON g.recording_id = i.recording_id AND NOT skip AND g.frame BETWEEN start_frame AND end_frame GROUP BY ALL),
w AS (SELECT x.recording_id, x.frame, bool_or(coalesce(b.onset AND b.frame <= x.frame + 2, false)) AS onset_2, bool_or(coalesce(b.onset, false)) AS onset_5 FROM o x LEFT JOIN o b ON x.recording_id = b.recording_id AND b.frame BETWEEN x.frame + 1 AND x.frame + 5 GROUP BY ALL)
SELECT recording_id, frame, active, attention, onset_2, onset_5 FROM a JOIN w USING (recording_id, frame)"""))  # fmt: skip
def frame_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = seq.onset_within(onsets(spark, sf_dir), REC, "onset", [2, 5]).drop("onset")
    active = iv.interval_mask(labels, usable(spark, sf_dir), REC)
    attention = iv.interval_mask(fx.grid(spark, sf_dir), usable(spark, sf_dir).filter("cue = 0"), REC).withColumnRenamed("active", "attention")
    return active.join(attention, ["recording_id", "frame"])


@query(sql("frames intervals", """
b AS (SELECT recording_id, frame, bool_or(n > 2) AS bad FROM frames GROUP BY ALL),
e AS (SELECT recording_id, iv, start_frame, end_frame FROM intervals WHERE NOT skip),
c AS (SELECT e.recording_id, iv, start_frame, end_frame, count(*) FILTER (bad AND b.frame BETWEEN start_frame - 12 AND end_frame + 12) AS wide_bad, count(*) FILTER (bad AND b.frame BETWEEN start_frame - 4 AND end_frame + 4) AS narrow_bad
  FROM e JOIN b USING (recording_id) GROUP BY ALL)
SELECT recording_id, iv, start_frame, end_frame, CASE WHEN wide_bad = 0 THEN 'wide' WHEN narrow_bad = 0 THEN 'narrow' ELSE 'rejected' END AS context,
  CASE WHEN wide_bad = 0 THEN greatest(start_frame - 12, 0) WHEN narrow_bad = 0 THEN greatest(start_frame - 4, 0) END AS context_from,
  CASE WHEN wide_bad = 0 THEN least(end_frame + 12, last) WHEN narrow_bad = 0 THEN least(end_frame + 4, last) END AS context_to, wide_bad, narrow_bad FROM c, (SELECT max(frame) AS last FROM frames)"""))  # fmt: skip
def context_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = fx.frames(spark, sf_dir).groupBy("recording_id", "frame").agg(F.bool_or(F.col("n") > 2).alias("bad"))
    events = usable(spark, sf_dir).select("recording_id", "iv", "start_frame", "end_frame")
    return iv.context_windows(events, status, REC, 12, 4)


_MATCH = """
p AS (SELECT recording_id, iv AS id, start_frame AS s, end_frame AS e FROM intervals WHERE initiator = 0), t AS (SELECT recording_id, iv AS id, start_frame AS s, end_frame AS e FROM intervals WHERE initiator = 1),
x AS (SELECT p.recording_id, p.id AS a, t.id AS b FROM p JOIN t ON p.recording_id = t.recording_id AND (p.s <= t.e AND t.s <= p.e OR abs(p.s - t.s) <= 5)),
np AS (SELECT p.recording_id, count(*) AS n_proposals, count(*) FILTER (id IN (SELECT a FROM x)) AS proposals_hit FROM p GROUP BY 1), nt AS (SELECT t.recording_id, count(*) AS n_truth, count(*) FILTER (id IN (SELECT b FROM x)) AS truth_hit FROM t GROUP BY 1)
SELECT recording_id, coalesce(n_proposals, 0) AS n_proposals, coalesce(proposals_hit, 0) AS proposals_hit, coalesce(n_truth, 0) AS n_truth, coalesce(truth_hit, 0) AS truth_hit,
  round(proposals_hit / n_proposals, 6) AS precision, round(truth_hit / n_truth, 6) AS recall FROM np FULL JOIN nt USING (recording_id)"""


@query(sql("intervals", _MATCH))
def match_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = fx.intervals(spark, sf_dir).select("recording_id", F.col("iv").alias("id"), F.col("start_frame").alias("start"), F.col("end_frame").alias("end"), "initiator")
    return _rounded(iv.match_events(i.filter("initiator = 0"), i.filter("initiator = 1"), REC, 5), "precision", "recall")


@query(sql("frames6", """
h AS (SELECT *, frame - row_number() OVER (PARTITION BY recording_id, role ORDER BY frame) AS k FROM frames6 WHERE n > 0)
SELECT recording_id, role, min(frame) AS start, max(frame) AS "end", count(*) AS n FROM h GROUP BY recording_id, role, k HAVING count(*) >= 3"""))  # fmt: skip
def active_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iv.runs(fx.frames(spark, sf_dir, 6).withColumn("on", F.col("n") > 0), SERIES, "on", 3)


@query(sql("frames6", """
h AS (SELECT *, frame - lag(frame) OVER (PARTITION BY recording_id, role ORDER BY frame) AS gap FROM frames6 WHERE n > 0),
r AS (SELECT *, sum(CASE WHEN gap > 2 THEN 1 ELSE 0 END) OVER (PARTITION BY recording_id, role ORDER BY frame) AS k FROM h)
SELECT recording_id, role, min(frame) AS start, max(frame) AS "end", count(*) AS n FROM r GROUP BY recording_id, role, k HAVING max(frame) - min(frame) + 1 >= 4"""))  # fmt: skip
def bridged_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iv.runs(fx.frames(spark, sf_dir, 6).withColumn("on", F.col("n") > 0), SERIES, "on", 4, 1)


@query(sql("intervals", """
r AS (SELECT recording_id, iv, start_frame AS s, end_frame AS e, max(end_frame) OVER (PARTITION BY recording_id ORDER BY start_frame, end_frame, iv ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM intervals),
k AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach + 2 THEN 1 ELSE 0 END) OVER (PARTITION BY recording_id ORDER BY s, e, iv ROWS UNBOUNDED PRECEDING) AS run FROM r)
SELECT recording_id, min(s) AS start, max(e) AS "end", count(*) AS n FROM k GROUP BY recording_id, run"""))  # fmt: skip
def merged_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = fx.intervals(spark, sf_dir).select("recording_id", F.col("start_frame").alias("start"), F.col("end_frame").alias("end"))
    return iv.merge(i, REC, 2)


@query(sql("chunks", """
r AS (SELECT *, max("end") OVER (PARTITION BY camera ORDER BY start NULLS LAST, chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM chunks)
SELECT camera, chunk, start, "end", CAST(sum(CASE WHEN start - reach > 2592000 THEN 1 ELSE 0 END) OVER (PARTITION BY camera ORDER BY start NULLS LAST, chunk ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM r"""))  # fmt: skip
def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iv.sessions(fx.chunks(spark, sf_dir), ["camera"], 30 * 86_400)


@query(sql("chunks", """
x AS (SELECT camera, chunk AS id, start AS s, "end" AS e FROM chunks WHERE start IS NOT NULL),
p AS (SELECT a.camera, a.id AS a_id, b.id AS b_id, a.s AS a0, b.s AS b0, least(a.e, b.e) - greatest(a.s, b.s) AS shared FROM x a JOIN x b ON a.camera = b.camera AND a.id % 2 = 0 AND b.id % 2 = 1 WHERE least(a.e, b.e) > greatest(a.s, b.s)),
q AS (SELECT *, row_number() OVER (PARTITION BY camera, a_id ORDER BY shared DESC, b0, b_id) AS n FROM p)
SELECT camera, a_id, b_id, shared, row_number() OVER (PARTITION BY camera, b_id ORDER BY a0, a_id) = 1 AS claimed FROM q WHERE n = 1"""))  # fmt: skip
def match_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chunk with a start is on one of the two sides."""
    c = fx.chunks(spark, sf_dir).filter("start IS NOT NULL").select("camera", F.col("chunk").alias("id"), "start", "end")
    return iv.match_sessions(c.filter("id % 2 = 0"), c.filter("id % 2 = 1"), ["camera"])


also("match_sessions_all", match_sessions)

@query(sql("contact", """
r AS (SELECT *, lead(kind) OVER w AS nk, lead(t) OVER w AS e FROM contact WINDOW w AS (PARTITION BY recording_id, person, object ORDER BY t, CASE kind WHEN 'release' THEN 0 ELSE 1 END, event_id))
SELECT recording_id, person, object, t AS start, e AS "end", CASE nk WHEN 'release' THEN 'closed' WHEN 'grasp' THEN 'regrasp' ELSE 'open' END AS state FROM r WHERE kind = 'grasp'"""))  # fmt: skip
def hold_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iv.hold_spans(fx.contact(spark, sf_dir), ["recording_id", "person", "object"])


@query(sql("frames6", """
l AS (SELECT *, lag(val) OVER w AS p, row_number() OVER w AS k, lead(val) OVER w AS nx FROM frames6 WINDOW w AS (PARTITION BY recording_id, role ORDER BY frame))
SELECT recording_id, role, frame, round(CASE WHEN k = 1 THEN CASE WHEN val IS NOT NULL THEN abs(nx - val) * 2 END ELSE abs(val - p) * 2 END, 6) AS speed FROM l"""))  # fmt: skip
def speed(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = seq.speed(fx.frames(spark, sf_dir, 6), SERIES, ["val"], 2.0, first="copy")
    return _rounded(out.select(*SERIES, "frame", "speed"), "speed")


@query(sql("poses", """
l AS (SELECT *, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy, z - lag(z) OVER w AS dz FROM poses WINDOW w AS (PARTITION BY recording_id ORDER BY frame))
SELECT recording_id, frame, round(coalesce(sqrt(dx * dx + dy * dy + dz * dz) * 10, 0), 6) AS speed FROM l"""))  # fmt: skip
def pose_speed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(seq.speed(fx.poses(spark, sf_dir), REC, ["x", "y", "z"], 10.0).select("recording_id", "frame", "speed"), "speed")


_W = "(PARTITION BY recording_id, role ORDER BY frame ROWS BETWEEN {} AND {})"


@query(sql("frames6", "SELECT recording_id, role, frame, round(avg(val) OVER " + _W.format("2 PRECEDING", "2 FOLLOWING") + ", 6) AS smoothed FROM frames6"))
def smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(seq.smooth(fx.frames(spark, sf_dir, 6), SERIES, "val", 5).select(*SERIES, "frame", "smoothed"), "smoothed")


@query(sql("frames6", "SELECT recording_id, role, frame, round(sum(coalesce(val, 0)) OVER " + _W.format("2 PRECEDING", "2 FOLLOWING") + " / 5, 6) AS smoothed FROM frames6"))
def smooth_zero_padded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(seq.smooth(fx.frames(spark, sf_dir, 6), SERIES, "val", 5, True).select(*SERIES, "frame", "smoothed"), "smoothed")


@query(sql("frames6", """
k AS (SELECT unnest(range(8)) AS back), v AS (SELECT a.recording_id, a.role, a.frame, coalesce(b.val, 0) AS val
  FROM frames6 a CROSS JOIN k JOIN frames6 b ON b.recording_id = a.recording_id AND b.role = a.role AND b.frame = greatest(a.frame - k.back, 0))
SELECT recording_id, role, frame, round(avg(val), 6) AS val_mean, round(max(val), 6) AS val_max, round(min(val), 6) AS val_min, round(stddev_pop(val), 4) AS val_std FROM v GROUP BY ALL"""))  # fmt: skip
def causal_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = seq.causal_stats(fx.frames(spark, sf_dir, 6), SERIES, "val", 8).select(*SERIES, "frame", "val_mean", "val_max", "val_min", "val_std")
    return _rounded(_rounded(out, "val_max", "val_min", "val_mean"), "val_std", digits=4)


@query(sql("frames6", """
l AS (SELECT *, lag(val) OVER w AS p, row_number() OVER w AS k FROM frames6 WINDOW w AS (PARTITION BY recording_id, role ORDER BY frame))
SELECT recording_id, role, frame, round(CASE WHEN k = 1 THEN 0 ELSE val - p END, 6) AS d_val FROM l"""))  # fmt: skip
def deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(seq.deltas(fx.frames(spark, sf_dir, 6), SERIES, ["val"]).select(*SERIES, "frame", "d_val"), "d_val")


@query(sql("frames6", """
l AS (SELECT *, lead(val, 4) OVER w AS f, lag(val, 2) OVER w AS p FROM frames6 WINDOW w AS (PARTITION BY recording_id, role ORDER BY frame))
SELECT recording_id, role, frame, round(CASE WHEN val IS NOT NULL THEN f END, 6) AS target, round(val, 6) AS still, round(val + (val - p) / 2 * 4, 6) AS drift FROM l"""))  # fmt: skip
def forecast_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = seq.forecast_targets(fx.frames(spark, sf_dir, 6), SERIES, "val", 4, 2)
    return _rounded(out.select(*SERIES, "frame", "target", "still", "drift"), "target", "still", "drift")


@query(sql("frames6", """
s AS (SELECT recording_id, n, CAST('0x' || substr(sha256(CAST(recording_id AS VARCHAR)), 1, 8) AS BIGINT) % (n - 19) + 10 AS shift FROM (SELECT recording_id, max(frame) + 1 AS n FROM frames6 GROUP BY 1))
SELECT a.recording_id, a.role, a.frame, round(b.val, 6) AS shifted_val FROM frames6 a JOIN s USING (recording_id) LEFT JOIN frames6 b ON b.recording_id = a.recording_id AND b.role = a.role AND (b.frame + shift) % s.n = a.frame"""))  # fmt: skip
def circular_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = seq.circular_shift(fx.frames(spark, sf_dir, 6), SERIES, F.col("recording_id"), 10, ["val"])
    return _rounded(out.select(*SERIES, "frame", "shifted_val"), "shifted_val")


@query(sql("grid intervals", """
f AS (SELECT recording_id, frame, sum(coalesce(e.value, 0)) AS speed FROM grid LEFT JOIN (SELECT user_id // 2 AS recording_id, epoch_us(ts) // 3600000000 - 473352 AS frame, value FROM events) e USING (recording_id, frame) GROUP BY ALL),
e AS (SELECT recording_id, iv, start_frame FROM intervals WHERE NOT skip),
b AS (SELECT e.recording_id, iv, avg(speed) + 0.5 * stddev_pop(speed) + 1 AS lim FROM e JOIN f ON e.recording_id = f.recording_id AND f.frame BETWEEN start_frame - 36 AND start_frame - 13 GROUP BY ALL),
h AS (SELECT e.recording_id, e.iv, f.frame, f.frame - row_number() OVER (PARTITION BY e.recording_id, e.iv ORDER BY f.frame) AS k FROM e JOIN b ON e.iv = b.iv JOIN f ON e.recording_id = f.recording_id AND f.frame BETWEEN start_frame - 12 AND start_frame WHERE speed > lim),
r AS (SELECT iv, min(frame) AS onset FROM h GROUP BY iv, k HAVING count(*) >= 2)
SELECT recording_id, e.iv, start_frame, min(onset) AS onset FROM e LEFT JOIN r ON e.iv = r.iv GROUP BY ALL"""))  # fmt: skip
def reach_onset(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = fx.frames(spark, sf_dir).groupBy("recording_id", "frame").agg(F.sum(F.coalesce("val", F.lit(0.0))).alias("speed"))
    return seq.reach_onset(series, usable(spark, sf_dir), REC, 12, 24, 2, 0.5, 1.0)


@query(sql("frames6", """
l AS (SELECT recording_id, role, frame, CASE WHEN n = 0 THEN NULL WHEN n = 1 THEN 'one' ELSE 'many' END AS label FROM frames6),
c AS (SELECT a.recording_id, a.role, a.frame, b.label, a.label AS own, count(*) AS n, min(b.frame) AS first FROM l a JOIN l b ON a.recording_id = b.recording_id AND a.role = b.role AND abs(a.frame - b.frame) <= 2 AND b.label IS NOT NULL GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY recording_id, role, frame ORDER BY n DESC, CASE WHEN label = own THEN 0 ELSE 1 END, first) AS k FROM c)
SELECT l.recording_id, l.role, l.frame, l.label, r.label AS voted FROM l LEFT JOIN r ON l.recording_id = r.recording_id AND l.role = r.role AND l.frame = r.frame AND k = 1"""))  # fmt: skip
def majority_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fx.frames(spark, sf_dir, 6).select(*SERIES, "frame", F.expr("CASE WHEN n = 0 THEN NULL WHEN n = 1 THEN 'one' ELSE 'many' END AS label"))
    return seq.majority_vote(f, SERIES, "label", 2)


@query(sql("grid intervals", """
x AS (SELECT g.recording_id, g.frame, min(iv) AS iv FROM grid g JOIN intervals i ON g.recording_id = i.recording_id AND NOT skip AND g.frame BETWEEN start_frame - 3 AND end_frame + 2 GROUP BY ALL)
SELECT g.recording_id, g.frame, x.iv, CASE WHEN x.iv IS NULL THEN 'none' WHEN g.frame < start_frame THEN 'approach' WHEN g.frame <= end_frame THEN 'transfer' ELSE 'retract' END AS stage
FROM grid g LEFT JOIN x USING (recording_id, frame) LEFT JOIN intervals i ON i.iv = x.iv"""))  # fmt: skip
def event_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seq.stages(fx.grid(spark, sf_dir), usable(spark, sf_dir), REC, 3, 2)


@query(sql("frames6", """
p AS (SELECT a.recording_id, a.frame, a.val AS x, b.val AS y FROM frames6 a JOIN frames6 b USING (recording_id, frame) WHERE a.role = 0 AND b.role = 1),
c AS (SELECT a.recording_id, k.lag, corr(a.x, b.y) AS r, count(*) AS n, stddev_pop(a.x) AS sx, stddev_pop(b.y) AS sy FROM p a CROSS JOIN (SELECT unnest(range(-4, 5)) AS lag) k JOIN p b ON a.recording_id = b.recording_id AND b.frame = a.frame + k.lag AND a.x IS NOT NULL AND b.y IS NOT NULL GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY round(r, 9) DESC, abs(lag), lag) AS k FROM c WHERE n >= 6 AND sx > 1e-9 AND sy > 1e-9 AND r IS NOT NULL)
SELECT recording_id, round(r, 6) AS r, CAST(lag AS INT) AS lag FROM (SELECT DISTINCT recording_id FROM p) LEFT JOIN (SELECT * FROM o WHERE k = 1) USING (recording_id)"""))  # fmt: skip
def cross_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fx.frames(spark, sf_dir, 6)
    pair = f.filter("role = 0").select("recording_id", "frame", F.col("val").alias("a")).join(f.filter("role = 1").select("recording_id", "frame", F.col("val").alias("b")), ["recording_id", "frame"])
    return _rounded(seq.cross_correlation(pair, REC, "a", "b", 4, 6), "r")


@query(sql("frames6", """
l AS (SELECT *, ln(1 + coalesce(val, 0)) AS x, lag(ln(1 + coalesce(val, 0))) OVER (PARTITION BY recording_id, role ORDER BY frame) AS p FROM frames6)
SELECT recording_id, role, frame, round(CASE WHEN coalesce(val, 0) < 5 OR p IS NULL THEN 0 ELSE greatest(x - p, 0) END, 6) AS envelope FROM l"""))  # fmt: skip
def onset_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(seq.onset_envelope(fx.frames(spark, sf_dir, 6), SERIES, "val", 5.0).select(*SERIES, "frame", "envelope"), "envelope")


@query(sql("frames", "SELECT recording_id, role, frame, n FROM frames WHERE frame >= 48 AND (frame - 48) % 10 = 0"))
def eval_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seq.eval_rows(fx.frames(spark, sf_dir), 48, 10).select(*SERIES, "frame", "n")


@query(sql("grid", "SELECT recording_id, frame FROM grid WHERE frame % 24 = 0 AND frame // 24 < 12"))
def keyframes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seq.keyframes(fx.grid(spark, sf_dir), REC, 24, 12)


@query(sql("frames6", """
s AS (SELECT recording_id, role, frame, CAST(sum(n) OVER (PARTITION BY recording_id, role ORDER BY frame) AS BIGINT) AS source FROM frames6),
l AS (SELECT *, source - lag(source) OVER (PARTITION BY recording_id, role ORDER BY frame) AS step FROM s)
SELECT recording_id, role, frame, source, coalesce(step = 0, false) AS repeated, greatest(coalesce(step - 1, 0), 0) AS skipped FROM l"""))  # fmt: skip
def repeat_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fx.frames(spark, sf_dir, 6)
    return seq.repeat_skip(f.select(*SERIES, "frame", F.sum("n").over(seq.over(SERIES)).alias("source")), SERIES, "source")


@query(sql("frames6", """
r AS (SELECT *, n IS DISTINCT FROM lag(n) OVER w AND row_number() OVER w > 1 AS changed, row_number() OVER w AS k FROM (SELECT recording_id, role, frame, n FROM frames6) WINDOW w AS (PARTITION BY recording_id, role ORDER BY frame DESC))
SELECT recording_id, role, coalesce(min(CASE WHEN changed THEN k END) - 1, max(k)) AS tail FROM r GROUP BY ALL"""))  # fmt: skip
def tail_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seq.tail_run(fx.frames(spark, sf_dir, 6), SERIES, "n")


@query(sql("frames6", "SELECT recording_id, role, frame, CAST(sum(n) OVER " + _W.format("3 PRECEDING", "CURRENT ROW") + " AS BIGINT) AS trailing FROM frames6"))
def trailing_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seq.trailing_count(fx.frames(spark, sf_dir, 6), SERIES, "n", 4).select(*SERIES, "frame", "trailing")


@query(sql("frames6", """
v AS (SELECT recording_id, role, frame, CASE WHEN n > 0 THEN frame * 2 + CAST(floor(val) AS BIGINT) % 7 END AS source FROM frames6)
SELECT recording_id, role, frame, source, coalesce(source < max(source) OVER a, false) OR coalesce(source > min(source) OVER b, false) AS conflict FROM v
WINDOW a AS (PARTITION BY recording_id, role ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), b AS (PARTITION BY recording_id, role ORDER BY frame ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)"""))  # fmt: skip
def nonmonotone(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fx.frames(spark, sf_dir, 6).select(*SERIES, "frame", F.expr("CASE WHEN n > 0 THEN frame * 2 + cast(floor(val) AS bigint) % 7 END AS source"))
    return seq.nonmonotone(f, SERIES, "source")


@query(sql("scores", "SELECT doc_id, group_id, score, rank() OVER (PARTITION BY group_id ORDER BY score) + (count(*) OVER (PARTITION BY group_id, score) - 1) / 2 AS rank FROM scores"))
def fold_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seq.fold_rank(fx.scores(spark, sf_dir).select("doc_id", "group_id", "score"), ["group_id"], "score")


@query(recursive(sql("frames6", """
v AS (SELECT recording_id, role, list(struct_pack(f := frame, v := frame * 2 + CAST(floor(val) AS BIGINT) % 7) ORDER BY frame) AS l FROM frames6 WHERE n > 0 GROUP BY ALL),
r(recording_id, role, l, k, lost) AS (SELECT recording_id, role, l, 0, CAST([] AS STRUCT(f INT, k INT)[]) FROM v UNION ALL
  SELECT recording_id, role, list_filter(l, lambda x: NOT list_contains(bad, x.f)), k + 1, list_concat(lost, list_transform(bad, lambda f: {'f': f, 'k': k + 1}))
  FROM (SELECT *, list_transform(list_filter(range(1, len(l) + 1), lambda i: coalesce(i > 1 AND l[i - 1].v > l[i].v, false) OR coalesce(i < len(l) AND l[i + 1].v < l[i].v, false)), lambda i: l[i].f) AS bad FROM r) WHERE len(bad) > 0),
z AS (SELECT recording_id, role, unnest(lost) AS x FROM r QUALIFY row_number() OVER (PARTITION BY recording_id, role ORDER BY k DESC) = 1)
SELECT a.recording_id, a.role, a.frame, CASE WHEN x.f IS NULL AND n > 0 THEN frame * 2 + CAST(floor(val) AS BIGINT) % 7 END AS source, x.k AS round FROM frames6 a LEFT JOIN z ON z.recording_id = a.recording_id AND z.role = a.role AND x.f = a.frame""")))  # fmt: skip
def reject_nonmonotone(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fx.frames(spark, sf_dir, 6).select(*SERIES, "frame", F.expr("CASE WHEN n > 0 THEN frame * 2 + cast(floor(val) AS bigint) % 7 END AS source"))
    return seq.reject_nonmonotone(f, SERIES, "source")
