"""Queries whose rows come from folds, hashes or fitted models; and those of utterances."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tandem.operators import evaluate as ev
from tandem.operators import folds, intervals, learning
from tandem.operators import text as tx
from tandem.operators.graph import settled
from tandem.sources import fixtures as fx

from .oracle import recursive, sql
from .registry import query

SERIES = ["recording_id", "role"]


@query(sql("frames6", """l AS (SELECT recording_id, role, frame, CASE WHEN n = 0 THEN NULL WHEN n = 1 THEN 'one' ELSE 'many' END AS label FROM frames6),
k AS (SELECT *, CASE WHEN label IS DISTINCT FROM lag(label) OVER w OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS new FROM l WINDOW w AS (PARTITION BY recording_id, role ORDER BY frame)),
r AS (SELECT *, sum(new) OVER (PARTITION BY recording_id, role ORDER BY frame) AS run FROM k)
SELECT recording_id, role, any_value(label) AS label, min(frame) AS start, max(frame) AS "end", count(*) AS n FROM r GROUP BY recording_id, role, run"""))  # fmt: skip
def value_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.value_runs(_labels(spark, sf_dir), SERIES, "label")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.frames(spark, sf_dir, 6).select(*SERIES, "frame", F.expr("CASE WHEN n = 0 THEN NULL WHEN n = 1 THEN 'one' ELSE 'many' END AS label"))


_RUNS = """l AS (SELECT recording_id, role, frame, CASE WHEN n = 0 THEN NULL WHEN n = 1 THEN 'one' ELSE 'many' END AS label FROM frames6),
k AS (SELECT *, CASE WHEN label IS DISTINCT FROM lag(label) OVER w OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS new FROM l WINDOW w AS (PARTITION BY recording_id, role ORDER BY frame)),
r0 AS (SELECT *, sum(new) OVER (PARTITION BY recording_id, role ORDER BY frame) AS run FROM k),
r AS MATERIALIZED (SELECT recording_id, role, CAST(run AS INT) AS run, any_value(label) AS label, min(frame) AS start, count(*) AS n FROM r0 GROUP BY recording_id, role, run),
"""
_HELD = _RUNS + """st(recording_id, role, run, held, since, was, was_since, released) AS (
  SELECT recording_id, role, 0, CAST(NULL AS VARCHAR), CAST(NULL AS INT), CAST(NULL AS VARCHAR), CAST(NULL AS INT), CAST(NULL AS INT) FROM r WHERE run = 1
  UNION ALL
  SELECT recording_id, role, run, CASE WHEN grasps THEN label WHEN NOT lets THEN held END, CASE WHEN grasps THEN start WHEN NOT lets THEN since END,
    CASE WHEN lets THEN held END, CASE WHEN lets THEN since END, CASE WHEN lets THEN start END
  FROM (SELECT *, (held IS NULL OR lets) AND label IS NOT NULL AND n >= 2 AS grasps FROM (
    SELECT r.*, st.held, st.since, st.held IS NOT NULL AND st.held IS DISTINCT FROM r.label AND r.n >= 3 AS lets FROM st JOIN r ON r.recording_id = st.recording_id AND r.role = st.role AND r.run = st.run + 1)))
, spans AS (
  SELECT recording_id, role, was AS label, was_since AS start, released AS "end" FROM st WHERE was IS NOT NULL
  UNION ALL SELECT recording_id, role, held, since, NULL FROM st WHERE held IS NOT NULL AND run = (SELECT max(run) FROM r WHERE r.recording_id = st.recording_id AND r.role = st.role))
"""
#: The same from labels l that come from elsewhere.
HELD_FROM = _HELD[_HELD.index("k AS (") :]


@query(recursive(sql("frames6", _HELD + """SELECT recording_id, role, label, CAST(start AS BIGINT) AS start, CAST("end" AS BIGINT) AS "end" FROM spans""")))
def label_hysteresis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.label_hysteresis(_labels(spark, sf_dir), SERIES, "label", 2, 3, "recording_id long, role int")


@query(recursive(sql("frames6", _HELD + """SELECT recording_id, role, 'grasp' AS kind, label, CAST(start AS BIGINT) AS frame FROM spans
UNION ALL SELECT recording_id, role, 'release', label, "end" FROM spans WHERE "end" IS NOT NULL""")))
def contact_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.contact_events(folds.label_hysteresis(_labels(spark, sf_dir), SERIES, "label", 2, 3, "recording_id long, role int"), SERIES, "label")


@query(sql("frames6", """l AS (SELECT recording_id, role, frame, CASE WHEN p > 0.4 THEN 'h' WHEN p < 0.2 THEN 'l' ELSE 'm' END AS level FROM (SELECT *, least(coalesce(val, 0) / 100, 1.0) AS p FROM frames6)),
b AS (SELECT *, lead(level, 1) OVER w AS next, max(frame) OVER (PARTITION BY recording_id, role) AS last, lag(level) OVER w AS before FROM l WINDOW w AS (PARTITION BY recording_id, role ORDER BY frame)),
t AS (SELECT * FROM b WHERE level <> 'm' AND level = next AND level IS DISTINCT FROM before),
k AS (SELECT *, lag(level) OVER w AS prior FROM t WINDOW w AS (PARTITION BY recording_id, role ORDER BY frame)),
z AS (SELECT recording_id, role, level, frame, last, lead(frame) OVER (PARTITION BY recording_id, role ORDER BY frame) AS stop FROM k WHERE level IS DISTINCT FROM prior AND NOT (level = 'l' AND prior IS NULL))
SELECT recording_id, role, CAST(frame AS BIGINT) AS start, CAST(coalesce(stop - 1, last) AS BIGINT) AS "end" FROM z WHERE level = 'h'"""))
def prob_hysteresis(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = fx.frames(spark, sf_dir, 6).select(*SERIES, F.col("frame").cast("long").alias("frame"), F.least(F.coalesce("val", F.lit(0.0)) / 100, F.lit(1.0)).alias("p"))
    return folds.prob_hysteresis(p, SERIES, 0.4, 0.2, 2, 2)


_SPANS = """e AS (SELECT *, lead(kind) OVER w AS next_kind, lead(t) OVER w AS stop FROM contact WINDOW w AS (PARTITION BY recording_id, person, object ORDER BY t, CASE WHEN kind = 'release' THEN 0 ELSE 1 END, event_id)),
s AS (SELECT recording_id, person, object, t AS start, CASE WHEN next_kind = 'release' THEN stop END AS "end" FROM e WHERE kind = 'grasp'),
h AS (SELECT * FROM s WHERE "end" IS NULL OR "end" - start >= 3600000000),
c AS (SELECT a.recording_id, a.object, a.person AS receiver, a.start AS grasped, list(struct_pack(gap := abs(a.start - b."end"), released := b."end", giver := b.person) ORDER BY abs(a.start - b."end"), b."end", b.person) AS gives
  FROM h a JOIN h b ON a.recording_id = b.recording_id AND a.object = b.object AND a.person <> b.person AND b."end" IS NOT NULL AND abs(a.start - b."end") <= 21600000000 GROUP BY ALL),
n AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY recording_id, object ORDER BY grasped, receiver) AS k FROM c),
g(recording_id, object, k, receiver, grasped, pick, used) AS (
  SELECT recording_id, object, k, receiver, grasped, gives[1], [struct_pack(r := gives[1].released, p := gives[1].giver)] FROM n WHERE k = 1
  UNION ALL SELECT recording_id, object, k, receiver, grasped, pick, CASE WHEN pick IS NULL THEN used ELSE list_append(used, struct_pack(r := pick.released, p := pick.giver)) END FROM (
    SELECT n.*, g.used, list_filter(n.gives, lambda x: NOT list_contains(g.used, struct_pack(r := x.released, p := x.giver)))[1] AS pick FROM g JOIN n ON n.recording_id = g.recording_id AND n.object = g.object AND n.k = g.k + 1)),
p AS (SELECT recording_id, object, pick.giver AS giver, receiver, least(pick.released, grasped) - 300000000 AS start, greatest(pick.released, grasped) + 300000000 AS stop FROM g WHERE pick IS NOT NULL),
m AS (SELECT *, CASE WHEN start <= max(stop) OVER (PARTITION BY recording_id, object, giver, receiver ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM p),
q AS (SELECT *, sum(new) OVER (PARTITION BY recording_id, object, giver, receiver ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS run FROM m)
SELECT recording_id, object, giver, receiver, min(start) AS start, max(stop) AS "end", count(*) AS n FROM q GROUP BY recording_id, object, giver, receiver, run"""


@query(recursive(sql("contact", _SPANS)))
def pair_handovers(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = intervals.hold_spans(fx.contact(spark, sf_dir), ["recording_id", "person", "object"]).withColumn("end", F.expr("CASE WHEN state = 'closed' THEN `end` END"))
    return folds.pair_handovers(spans, ["recording_id"], 6 * 3_600_000_000, 3_600_000_000, 300_000_000, "recording_id long")


@query(sql("frames6", """r AS (SELECT recording_id, role, frame, row_number() OVER (PARTITION BY recording_id, role ORDER BY md5(concat_ws(':', '3', recording_id, role, frame)), frame) AS k, count(*) OVER (PARTITION BY recording_id, role) AS c FROM frames6 WHERE n > 0)
SELECT recording_id, role, frame FROM r WHERE k <= greatest(ceil(c * 0.1), 1)"""))
def review_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.review_sample(fx.frames(spark, sf_dir, 6).filter("n > 0").select(*SERIES, "frame"), SERIES, "frame", 0.1, 3)


@query(sql("grid intervals", """b AS (SELECT DISTINCT recording_id, unnest(range(start_frame - 4, end_frame + 5)) AS frame FROM intervals WHERE NOT skip),
r AS (SELECT recording_id, frame, row_number() OVER (PARTITION BY recording_id ORDER BY md5(concat_ws(':', '3', recording_id, frame)), frame) AS k FROM grid ANTI JOIN b USING (recording_id, frame))
SELECT recording_id, frame FROM r WHERE k <= 200"""))
def negative_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.negative_windows(fx.grid(spark, sf_dir), fx.intervals(spark, sf_dir).filter("NOT skip"), ["recording_id"], 5, 200, 3)


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn, and the same heard by another microphone without every fourth word."""
    w = fx.words(spark, sf_dir)

    def said(words: DataFrame, copy: int) -> DataFrame:
        text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]), " ")
        out = words.groupBy("recording_id", "turn", "role").agg(F.min("start").alias("start"), F.max("end").alias("end"), text.alias("text"))
        return out.select("recording_id", (F.col("turn") * 2 + copy).alias("id"), "start", "end", "text", F.concat("role", F.lit(str(copy))).alias("speaker"), F.lit(0.9 - copy / 10).alias("prob"))

    return said(w, 0).unionByName(said(w.filter("pos % 4 <> 3"), 1))


@query(recursive(sql("words", r"""s0 AS (SELECT recording_id, turn, role, c AS copy, min(start) AS start, max("end") AS stop, string_agg(word, ' ' ORDER BY pos) AS text FROM words, range(2) x(c) WHERE c = 0 OR pos % 4 <> 3 GROUP BY ALL),
s AS (SELECT recording_id, turn * 2 + copy AS id, start, stop, regexp_extract_all(lower(text), '[\p{L}\p{N}'']+') AS w, role || copy AS speaker, 0.9 - copy / 10.0 AS prob FROM s0),
r AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY -prob, -(stop - start), id) AS k FROM s),
p AS (SELECT a.recording_id, a.k AS ka, b.k AS kb, least(a.stop, b.stop) - greatest(a.start, b.start) AS shared, greatest(least(a.stop - a.start, b.stop - b.start), 1) AS shorter, a.speaker = b.speaker AS same, a.w AS aw, b.w AS bw
  FROM r a JOIN r b ON a.recording_id = b.recording_id AND a.k < b.k AND a.start < b.stop AND b.start < a.stop),
t AS (SELECT *, CASE WHEN least(len(aw), len(bw)) > 0 THEN coalesce(list_sum(list_transform(list_distinct(aw), lambda x: least(len(list_filter(aw, lambda v: v = x)), len(list_filter(bw, lambda v: v = x))))), 0) / least(len(aw), len(bw)) ELSE 0 END AS alike FROM p),
f AS (SELECT recording_id, kb, list(ka) AS foes FROM t WHERE shared > 0 AND (shared / shorter >= 0.5 AND alike >= 0.6 OR same AND shared / shorter >= 0.8) GROUP BY ALL),
n AS MATERIALIZED (SELECT r.recording_id, r.k, r.id, r.speaker, coalesce(f.foes, []) AS foes FROM r LEFT JOIN f ON f.recording_id = r.recording_id AND f.kb = r.k),
g(recording_id, k, id, speaker, out_, gone) AS (
  SELECT recording_id, k, id, speaker, false, CAST([] AS BIGINT[]) FROM n WHERE k = 1
  UNION ALL SELECT recording_id, k, id, speaker, hit, CASE WHEN hit THEN list_append(gone, k) ELSE gone END FROM (
    SELECT n.*, g.gone, len(list_filter(n.foes, lambda x: NOT list_contains(g.gone, x))) > 0 AS hit FROM g JOIN n ON n.recording_id = g.recording_id AND n.k = g.k + 1))
SELECT recording_id, id, speaker FROM g WHERE NOT out_""")))
def dedup_utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tx.dedup_utterances(_segments(spark, sf_dir), ["recording_id"], 600, "recording_id long, id long").select("recording_id", "id", "speaker")


@query(sql("words", """e AS (SELECT recording_id, role AS person, start // 10 AS bin, CAST(sum(length(word)) AS DOUBLE) AS energy FROM words GROUP BY ALL),
l AS (SELECT recording_id, person, greatest(quantile_cont(energy, 0.5), 1e-9) AS level FROM e GROUP BY ALL),
s AS (SELECT recording_id, turn AS id, min(start) // 10 AS b0, max(start) // 10 AS b1 FROM words GROUP BY ALL),
p AS (SELECT s.recording_id, s.id, e.person, avg(energy) / any_value(level) AS loud FROM s JOIN e ON s.recording_id = e.recording_id AND e.bin BETWEEN b0 AND b1 JOIN l ON l.recording_id = e.recording_id AND l.person = e.person GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY recording_id, id ORDER BY round(loud, 9) DESC, person) AS k FROM p)
SELECT s.recording_id, s.id, CASE WHEN max(loud) FILTER (k = 2) IS NULL OR round(max(loud) FILTER (k = 1) - max(loud) FILTER (k = 2) * 1.05, 9) >= 0 THEN max(person) FILTER (k = 1) END AS speaker FROM s LEFT JOIN r USING (recording_id, id) GROUP BY ALL"""))  # fmt: skip
def attribute_speaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = fx.words(spark, sf_dir).withColumn("bin", F.expr("start div 10"))
    energy = w.groupBy("recording_id", F.col("role").alias("person"), "bin").agg(F.sum(F.length("word")).cast("double").alias("energy"))
    turns = w.groupBy("recording_id", F.col("turn").alias("id")).agg(F.min("bin").alias("start_bin"), F.max("bin").alias("end_bin"))
    return tx.attribute_speaker(turns, energy, ["recording_id"], 1.05).select("recording_id", "id", "speaker")


def _task(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Does the first person act in a 6-hour frame; from both people's last two days. Folds by recording. Every fold's models read
    these rows several times, so they are computed once."""
    f = fx.frames(spark, sf_dir, 6)
    w = Window.partitionBy(*SERIES).orderBy("frame")
    lagged = f.select(*SERIES, "frame", (F.col("n") > 0).cast("int").alias("y"), *(F.coalesce(F.lag("n", k).over(w), F.lit(0)).cast("double").alias(f"n{k}") for k in (1, 2, 4)), F.coalesce(F.avg("val").over(w.rowsBetween(-8, -1)), F.lit(0.0)).alias("level"))
    # both people's rows lie in one partition and meet in a group there; a join by frame would shuffle all frames
    of = lambda r, c: F.max(F.when(F.col("role") == r, F.col(c)))
    met = lagged.groupBy("recording_id", "frame").agg(*(of(0, c).alias(c) for c in ("y", *OWN)), of(1, "n1").alias("o1"), of(1, "level").alias("o_level"))
    return settled(met.join(ev.assign_folds(f, "recording_id", 3, 7), "recording_id"))


OWN, BOTH = ["n1", "n2", "n4", "level"], ["n1", "n2", "n4", "level", "o1", "o_level"]


@query()
def linear_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.auroc(learning.linear_oof(_task(spark, sf_dir), BOTH, 3), ["fold"])


@query()
def boosted_oof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learning.boosted_oof(_task(spark, sf_dir), BOTH, 3, rounds=4).select("recording_id", "frame", "fold", "y", "score")


@query()
def boosted_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _task(spark, sf_dir).withColumn("y", F.col("level")).drop("level")
    out = learning.boosted_regression(rows, ["n1", "n2", "n4", "o1", "o_level"], 3, rounds=4)
    return ev.mae_vs_median(out, ["fold"], 200.0)


@query()
def ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _task(spark, sf_dir)
    return ev.auroc(learning.ablate(t, BOTH, ["o1", "o_level"], 3), ["fold"]).withColumn("left_out", F.lit("partner"))


@query()
def reduce_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learning.reduce_vectors(fx.vectors(spark, sf_dir), "v", 4).select("frame", "components")


@query(sql("poses", """t AS (SELECT recording_id, frame, x, y, lag(x, 3) OVER w AS px, lag(y, 3) OVER w AS py, lead(x, 5) OVER w AS fx, lead(y, 5) OVER w AS fy FROM poses WINDOW w AS (PARTITION BY recording_id ORDER BY frame))
SELECT recording_id, round(avg(sqrt((fx - x) ** 2 + (fy - y) ** 2)), 6) AS still, round(avg(sqrt((fx - (x + (x - px) / 3 * 5)) ** 2 + (fy - (y + (y - py) / 3 * 5)) ** 2)), 6) AS drift FROM t WHERE px IS NOT NULL AND fx IS NOT NULL GROUP BY 1"""))  # fmt: skip
def forecast_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean distance of the position five frames later from where no motion and constant velocity put it."""
    from tandem.operators import sequence as seq

    df = fx.poses(spark, sf_dir).select("recording_id", "frame", "x", "y")
    for c in ("x", "y"):
        df = seq.forecast_targets(df, ["recording_id"], c, 5, 3).withColumnsRenamed({n: f"{n}_{c}" for n in ("target", "still", "drift")})
    d = lambda n: F.sqrt((F.col("target_x") - F.col(f"{n}_x")) ** 2 + (F.col("target_y") - F.col(f"{n}_y")) ** 2)
    known = df.filter("target_x IS NOT NULL AND drift_x IS NOT NULL")
    return known.groupBy("recording_id").agg(F.round(F.avg(d("still")), 6).alias("still"), F.round(F.avg(d("drift")), 6).alias("drift"))
