"""Queries of composite features and selections, with the same rows in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tandem.operators import bookkeeping as bk
from tandem.operators import evaluate
from tandem.operators import scopes
from tandem.operators import events as evt
from tandem.operators import folds, intervals
from tandem.operators import sequence as seq
from tandem.operators import intervals as iv
from tandem.sources import fixtures as fx

from .oracle import sql
from .registry import also, query

SERIES = ["recording_id", "role"]


def _rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols})


@query(sql("frames6", """m AS (SELECT recording_id, role, frame, CASE WHEN n > 1 THEN val / 100 END AS s3, val AS s2 FROM frames6), h AS (SELECT recording_id, role, count(s3) / count(*) AS share FROM m GROUP BY ALL)
SELECT recording_id, role, frame, round(CASE WHEN share >= 0.12 THEN s3 ELSE s2 END, 6) AS speed, CASE WHEN share >= 0.12 THEN 'm/s' ELSE 'image/s' END AS unit FROM m JOIN h USING (recording_id, role)"""))  # fmt: skip
def hand_speed(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fx.frames(spark, sf_dir, 6)
    metric = f.select(*SERIES, "frame", F.when(F.col("n") > 1, F.col("val") / 100).alias("speed"))
    return _rounded(evt.hand_speed(metric, f.select(*SERIES, "frame", F.col("val").alias("speed")), SERIES, 0.12), "speed")


@query(sql("frames6 intervals", """a AS (SELECT recording_id, start_frame AS s, end_frame AS e FROM intervals WHERE skip), b AS (SELECT recording_id, start_frame AS s, end_frame AS e FROM intervals WHERE NOT skip AND cue = 1), c AS (SELECT recording_id, start_frame AS s, end_frame AS e FROM intervals WHERE cue = 2),
u AS (SELECT *, 0 AS k, 'contact' AS source FROM a UNION ALL SELECT *, 1, 'proposals' FROM b UNION ALL SELECT *, 2, 'distance' FROM c), m AS (SELECT recording_id, min(k) AS k FROM u GROUP BY 1)
SELECT recording_id, s AS start, e AS "end", source FROM u JOIN m USING (recording_id, k)"""))  # fmt: skip
def event_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = fx.intervals(spark, sf_dir).withColumnsRenamed({"start_frame": "start", "end_frame": "end"})
    return evt.by_priority([("contact", i.filter("skip")), ("proposals", i.filter("NOT skip AND cue = 1")), ("distance", i.filter("cue = 2"))], ["recording_id"])


def _distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fx.frames(spark, sf_dir)
    pair = f.filter("role = 0").select("recording_id", "frame", F.col("val").alias("a")).join(f.filter("role = 1").select("recording_id", "frame", F.col("val").alias("b")), ["recording_id", "frame"])
    return pair.select("recording_id", "frame", F.abs(F.coalesce("a", F.lit(0.0)) - F.coalesce("b", F.lit(0.0))).alias("distance"))


_DIST = "d AS (SELECT a.recording_id, a.frame, abs(coalesce(a.val, 0) - coalesce(b.val, 0)) AS distance FROM frames a JOIN frames b USING (recording_id, frame) WHERE a.role = 0 AND b.role = 1)"


@query(sql("frames intervals", _DIST + """, e AS (SELECT recording_id, iv, start_frame, end_frame FROM intervals WHERE NOT skip),
sp AS (SELECT recording_id, role, frame, coalesce(val, 0) AS speed FROM frames),
b AS (SELECT e.iv, role, avg(speed) + stddev_pop(speed) AS lim FROM e JOIN sp ON e.recording_id = sp.recording_id AND sp.frame BETWEEN start_frame - 24 AND start_frame - 9 GROUP BY ALL),
o AS (SELECT e.iv, sp.role, min(sp.frame) AS onset FROM e JOIN sp ON e.recording_id = sp.recording_id AND sp.frame BETWEEN start_frame - 8 AND start_frame JOIN b ON b.iv = e.iv AND b.role = sp.role WHERE speed > lim GROUP BY ALL),
n AS (SELECT e.iv, min(distance) AS md, arg_min(d.frame, (round(distance, 9), d.frame)) AS nf FROM e JOIN d ON e.recording_id = d.recording_id AND d.frame BETWEEN start_frame AND end_frame GROUP BY ALL)
SELECT e.recording_id, e.iv, CASE WHEN o0.onset IS NULL AND o1.onset IS NULL THEN NULL WHEN coalesce(o0.onset, 1073741824) <= coalesce(o1.onset, 1073741824) THEN 0 ELSE 1 END AS giver, least(o0.onset, o1.onset) AS reach_onset, abs(o0.onset - o1.onset) AS response,
  end_frame - start_frame AS transfer, nf AS nearest_frame, round(md, 6) AS min_distance FROM e LEFT JOIN o o0 ON o0.iv = e.iv AND o0.role = 0 LEFT JOIN o o1 ON o1.iv = e.iv AND o1.role = 1 LEFT JOIN n ON n.iv = e.iv"""))  # fmt: skip
def event_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    speed = fx.frames(spark, sf_dir).select(*SERIES, "frame", F.coalesce("val", F.lit(0.0)).alias("speed"))
    events = fx.intervals(spark, sf_dir).filter("NOT skip")
    distance = _distance(spark, sf_dir).withColumn("distance", F.round("distance", 9))
    return _rounded(evt.event_metrics(events, speed, distance, ["recording_id"], 8), "min_distance")


@query(sql("frames", _DIST + """, l AS (SELECT *, lag(distance) OVER (PARTITION BY recording_id ORDER BY frame) AS p, row_number() OVER (PARTITION BY recording_id ORDER BY frame) AS k FROM d)
SELECT recording_id, frame, round(distance, 6) AS distance, round(CASE WHEN k = 1 THEN 0 ELSE greatest(least(p - distance, 5), -5) END, 6) AS closing FROM l"""))  # fmt: skip
def closing_speed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evt.closing_speed(_distance(spark, sf_dir), ["recording_id"], "distance", 5.0), "distance", "closing")


@query(sql("frames", _DIST + """, h AS (SELECT *, frame - lag(frame) OVER (PARTITION BY recording_id ORDER BY frame) AS gap FROM d WHERE distance < 1), r AS (SELECT *, sum(CASE WHEN gap > 3 THEN 1 ELSE 0 END) OVER (PARTITION BY recording_id ORDER BY frame) AS k FROM h)
SELECT recording_id, min(frame) AS start, max(frame) AS "end", count(*) AS n FROM r GROUP BY recording_id, k HAVING max(frame) - min(frame) + 1 >= 24"""))  # fmt: skip
def proximity_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evt.proximity_events(_distance(spark, sf_dir), ["recording_id"], 1.0, 24, 2)


@query(sql("poses", """p AS (SELECT recording_id, frame // 2 AS moment, frame % 2 AS side, x, y, z, qx AS fx, qy AS fy, qz AS fz FROM poses),
j AS (SELECT a.recording_id, a.moment, sqrt((b.x-a.x)**2+(b.y-a.y)**2+(b.z-a.z)**2) AS d, a.fx*(b.x-a.x)+a.fy*(b.y-a.y)+a.fz*(b.z-a.z) AS ab, -(b.fx*(b.x-a.x)+b.fy*(b.y-a.y)+b.fz*(b.z-a.z)) AS ba, sqrt(a.fx*a.fx+a.fy*a.fy+a.fz*a.fz) AS na, sqrt(b.fx*b.fx+b.fy*b.fy+b.fz*b.fz) AS nb
  FROM p a JOIN p b USING (recording_id, moment) WHERE a.side = 0 AND b.side = 1)
SELECT recording_id, moment, round(d, 6) AS distance, round(ab / (na * d), 6) AS a_faces_b, round(ba / (nb * d), 6) AS b_faces_a, ab / (na * d) > 0.8 AND ba / (nb * d) > 0.8 AS mutual FROM j"""))  # fmt: skip
def pair_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = fx.poses(spark, sf_dir).withColumn("moment", F.expr("cast(frame div 2 AS bigint)")).withColumnsRenamed({"qx": "fx", "qy": "fy", "qz": "fz"})
    return _rounded(evt.pair_features(p.filter("frame % 2 = 0"), p.filter("frame % 2 = 1"), ["recording_id", "moment"]), "distance", "a_faces_b", "b_faces_a")


_ONSETS = """pr AS (SELECT recording_id, frame, sum(n) + frame % 7 / 100.0 AS p FROM frames GROUP BY recording_id, frame), o AS (SELECT DISTINCT recording_id, start_frame AS a FROM intervals WHERE NOT skip)"""


def _activity(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    p = fx.frames(spark, sf_dir).groupBy("recording_id", "frame").agg(F.sum("n").alias("n")).select("recording_id", "frame", (F.col("n") + F.col("frame") % 7 / 100).alias("p"))
    events = fx.intervals(spark, sf_dir).filter("NOT skip")
    return p, events.select("recording_id", F.col("start_frame").alias("frame")).distinct(), folds.negative_windows(fx.grid(spark, sf_dir), events, ["recording_id"], 5, 100, 3)


@query(sql("frames grid intervals", _ONSETS + """,
x AS (SELECT DISTINCT recording_id, unnest(range(start_frame - 4, end_frame + 5)) AS frame FROM intervals WHERE NOT skip),
n0 AS (SELECT recording_id, frame, row_number() OVER (PARTITION BY recording_id ORDER BY md5(concat_ws(':', '3', recording_id, frame)), frame) AS k FROM grid ANTI JOIN x USING (recording_id, frame)),
pos AS (SELECT o.recording_id, a, max(p) AS peak FROM o JOIN pr ON pr.recording_id = o.recording_id AND pr.frame BETWEEN a - 5 AND a - 1 GROUP BY ALL),
neg AS (SELECT n.recording_id, n.frame AS a, max(p) AS peak FROM n0 n JOIN pr ON pr.recording_id = n.recording_id AND pr.frame BETWEEN n.frame - 5 AND n.frame - 1 WHERE k <= 100 GROUP BY ALL),
t AS (SELECT 0.01::DOUBLE AS rate, round(quantile_cont(peak, 0.99), 9) AS threshold FROM neg UNION ALL SELECT 0.05, round(quantile_cont(peak, 0.95), 9) FROM neg UNION ALL SELECT 0.1, round(quantile_cont(peak, 0.9), 9) FROM neg),
c AS (SELECT rate, any_value(threshold) AS threshold, avg(CASE WHEN round(peak, 9) >= threshold THEN 1.0 ELSE 0 END) AS recall, count(*) AS n_onsets FROM pos, t GROUP BY 1),
f AS (SELECT o.recording_id, a, rate, min(CASE WHEN round(p, 9) >= threshold THEN pr.frame END) AS first FROM o JOIN pr ON pr.recording_id = o.recording_id AND pr.frame BETWEEN a - 12 AND a - 1, t GROUP BY ALL),
l AS (SELECT rate, quantile_cont(a - first, 0.5) AS median_lead, avg(a - first) AS mean_lead, count(first) / count(*) AS detected FROM f GROUP BY 1),
u AS (SELECT 1 AS y, peak FROM pos UNION ALL SELECT 0, peak FROM neg), ru AS (SELECT y, rank() OVER (ORDER BY peak) + (count(*) OVER (PARTITION BY peak) - 1) / 2 AS r FROM u),
au AS (SELECT (sum(r) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))) AS auroc FROM ru)
SELECT rate, round(threshold, 6) AS threshold, (SELECT count(*) FROM neg) AS n_negatives, round(recall, 6) AS recall, n_onsets, round(median_lead, 6) AS median_lead, round(mean_lead, 6) AS mean_lead, round(detected, 6) AS detected, round(auroc, 6) AS auroc
FROM c JOIN l USING (rate), au"""))
def anticipation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Onsets told at 1, 5 and 10 % false alarms, p being the events of the hour, and how long before."""
    out = evt.anticipation(*_activity(spark, sf_dir), ["recording_id"], 5, 12, [0.01, 0.05, 0.1])
    return out.withColumns({c: F.round(c, 6) for c in ("threshold", "recall", "median_lead", "mean_lead", "detected", "auroc")})


@query(sql("frames intervals", _ONSETS + """, b AS (SELECT recording_id, a, unnest(range(-12, 0, 3)) AS before FROM o)
SELECT CAST(before AS INT) AS before, round(avg(coalesce(p, 0)), 6) AS mean, count(*) AS n FROM b LEFT JOIN pr ON pr.recording_id = b.recording_id AND pr.frame = a + before GROUP BY 1"""))
def mean_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, onsets, _ = _activity(spark, sf_dir)
    return evt.mean_curve(p, onsets, ["recording_id"], 12, 3).withColumn("mean", F.round("mean", 6))


@query(sql("frames", """s AS (SELECT recording_id, frame, count(*) FILTER (n > 0) / count(*) AS valid FROM frames GROUP BY ALL) SELECT recording_id, round(avg(valid), 6) AS coverage, round(quantile_cont(valid, 0.9), 6) AS p90, count(*) FILTER (valid = 1) AS n_full FROM s GROUP BY 1"""))
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fx.frames(spark, sf_dir).groupBy("recording_id", "frame").agg((F.count_if(F.col("n") > 0) / F.count(F.lit(1))).alias("valid"))
    return s.groupBy("recording_id").agg(F.round(F.avg("valid"), 6).alias("coverage"), F.round(F.percentile("valid", F.lit(0.9)), 6).alias("p90"), F.count_if(F.col("valid") == 1).alias("n_full"))


@query(sql("frames intervals", """p AS (SELECT i.recording_id, iv, initiator, cue, skip, max(val) AS peak FROM intervals i JOIN frames f ON f.recording_id = i.recording_id AND f.frame BETWEEN start_frame - 6 AND start_frame - 1 GROUP BY ALL),
t AS (SELECT quantile_cont(val, 0.95) AS limit_ FROM frames)
SELECT initiator, cue, skip, count(*) AS n, round(avg(CASE WHEN peak >= limit_ THEN 1.0 WHEN peak IS NOT NULL THEN 0.0 END), 6) AS recall FROM p, t GROUP BY GROUPING SETS ((initiator), (cue), (skip), ())"""))
def recall_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose signal in the six frames before reaches what one frame in twenty does."""
    f = fx.frames(spark, sf_dir)
    before = fx.intervals(spark, sf_dir).withColumn("frame", F.explode(F.sequence(F.col("start_frame") - 6, F.col("start_frame") - 1)))
    peaks = before.join(f.select("recording_id", "frame", "val"), ["recording_id", "frame"]).groupBy("recording_id", "iv", "initiator", "cue", "skip").agg(F.max("val").alias("peak"))
    limit = evaluate.quantiles(f, "val", (0.95,)).select(F.col("value").alias("limit"))
    return scopes.recall_by(peaks.join(F.broadcast(limit)), ["initiator", "cue", "skip"], "peak", F.col("limit")).withColumn("recall", F.round("recall", 6))


@query(sql("grid intervals", """SELECT recording_id, iv, greatest(0, least(start_frame - (48 - (end_frame - start_frame)) // 2, last - 48)) AS excerpt_from, greatest(0, least(start_frame - (48 - (end_frame - start_frame)) // 2, last - 48)) + 48 AS excerpt_to FROM intervals JOIN (SELECT recording_id, max(frame) AS last FROM grid GROUP BY 1) USING (recording_id)"""))
def excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Excerpts of 48 frames centred on an event, moved inside the recording."""
    return iv.excerpts(fx.intervals(spark, sf_dir), fx.grid(spark, sf_dir), ["recording_id"], 48)


@query(sql("intervals", """w AS (SELECT recording_id, iv, start_frame - 3 AS s, end_frame + 3 AS e, 1000 + iv % 7 * 100 AS bytes FROM intervals),
r AS (SELECT *, max(e) OVER (PARTITION BY recording_id ORDER BY s, e, iv ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM w), k AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY recording_id ORDER BY s, e, iv ROWS UNBOUNDED PRECEDING) AS run FROM r),
m AS (SELECT recording_id, min(s) AS s, max(e) AS e FROM k GROUP BY recording_id, run), z AS (SELECT recording_id, avg(bytes) AS mean, quantile_cont(bytes, 0.95) AS p95 FROM w GROUP BY 1)
SELECT recording_id, count(*) AS n_reads, CAST(sum(e - s + 1) AS BIGINT) AS n_frames, round(sum(e - s + 1) * any_value(mean), 4) AS expected_bytes, round(sum(e - s + 1) * any_value(p95), 4) AS p95_bytes FROM m JOIN z USING (recording_id) GROUP BY 1"""))  # fmt: skip
def sparse_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What reading the requested windows alone would take: joined windows, their frames and bytes."""
    w = fx.intervals(spark, sf_dir).select("recording_id", (F.col("start_frame") - 3).alias("start"), (F.col("end_frame") + 3).alias("end"), (1000 + F.col("iv") % 7 * 100).alias("bytes"))
    size = w.groupBy("recording_id").agg(F.avg("bytes").alias("mean"), F.percentile("bytes", F.lit(0.95)).alias("p95"))
    m = intervals.merge(w, ["recording_id"], 1).groupBy("recording_id").agg(F.count(F.lit(1)).alias("n_reads"), F.sum(F.col("end") - F.col("start") + 1).alias("n_frames"))
    return m.join(size, "recording_id").select("recording_id", "n_reads", "n_frames", F.round(F.col("n_frames") * F.col("mean"), 4).alias("expected_bytes"), F.round(F.col("n_frames") * F.col("p95"), 4).alias("p95_bytes"))


@query(sql("words", r"""f AS (SELECT recording_id, role, start // 10 AS frame, count(*) AS n FROM words GROUP BY ALL), e AS (SELECT recording_id, max(frame) AS last FROM f GROUP BY 1),
g AS (SELECT recording_id, role, unnest(range(CAST(last AS BIGINT) + 1)) AS frame FROM (SELECT DISTINCT recording_id, role FROM words) JOIN e USING (recording_id)),
c AS (SELECT g.recording_id, g.role, g.frame, coalesce(f.n, 0) AS n FROM g LEFT JOIN f USING (recording_id, role, frame))
SELECT recording_id, role, frame, CAST(sum(n) OVER (PARTITION BY recording_id, role ORDER BY frame ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS BIGINT) AS trailing FROM c"""))  # fmt: skip
def speech_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words begun in the last three seconds, per speaker, up to the recording's last frame with a word."""
    w = fx.words(spark, sf_dir).withColumn("frame", F.expr("start div 10"))
    last = w.groupBy("recording_id").agg(F.max("frame").alias("last"))
    grid = w.select("recording_id", "role").distinct().join(last, "recording_id").select("recording_id", "role", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("last").cast("bigint"))).alias("frame"))
    counts = grid.join(w.groupBy("recording_id", "role", "frame").agg(F.count(F.lit(1)).alias("n")), ["recording_id", "role", "frame"], "left")
    return seq.trailing_count(counts, SERIES, "n", 3).select(*SERIES, "frame", "trailing")


also("speech_window_all", speech_window)

@query("""WITH r(path) AS (SELECT source || '/' || doc_id FROM documents UNION ALL SELECT 'extra/' || doc_id FROM documents WHERE doc_id % 50 = 0)
SELECT r.path, d.n_chars AS size, d.n_chars IS NOT NULL AS present FROM r LEFT JOIN documents d ON r.path = d.source || '/' || d.doc_id""")  # fmt: skip
def select_required(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's path is asked for, and some that are missing."""
    f = fx.files(spark, sf_dir)
    extra = f.filter("doc_id % 50 = 0").select(F.concat(F.lit("extra/"), F.col("doc_id").cast("string")).alias("path"))
    return bk.select_required(f, f.select("path").unionByName(extra))


also("select_required_all", select_required)

@query(sql("words", """t AS (SELECT recording_id, turn, min(start) AS s, max("end") AS e FROM words GROUP BY ALL), x AS (SELECT a.recording_id, a.turn AS a, b.turn AS b FROM t a JOIN t b ON a.recording_id = b.recording_id AND a.turn < b.turn AND least(a.e, b.e) > greatest(a.s, b.s))
SELECT recording_id, count(*) AS n_overlaps FROM x GROUP BY 1"""))  # fmt: skip
def talk_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = fx.words(spark, sf_dir).groupBy("recording_id", "turn").agg(F.min("start").alias("start"), F.max("end").alias("end")).withColumnRenamed("turn", "id")
    pairs = intervals.overlapping(t, t, ["recording_id"], 0, 100).filter("a_id < b_id")
    strict = pairs.join(t.select("recording_id", F.col("id").alias("a_id"), F.col("start").alias("s1"), F.col("end").alias("e1")), ["recording_id", "a_id"]).join(t.select("recording_id", F.col("id").alias("b_id"), F.col("start").alias("s2"), F.col("end").alias("e2")), ["recording_id", "b_id"])
    return strict.filter(F.least("e1", "e2") > F.greatest("s1", "s2")).groupBy("recording_id").agg(F.count(F.lit(1)).alias("n_overlaps"))


