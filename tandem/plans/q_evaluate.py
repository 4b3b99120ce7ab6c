"""Queries on predictions, manifests, reviews and words, with the same rows in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tandem.functions import scalar as s
from tandem.operators import bookkeeping as bk
from tandem.operators import evaluate as ev
from tandem.operators import text as tx
from tandem.operators.intervals import dealt
from tandem.sources import fixtures as fx

from .oracle import sql
from .registry import query


def _rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols})


_AUROC = """p AS (SELECT group_id, sum(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0 END) / count(*) AS auroc FROM scores a JOIN scores b USING (group_id) WHERE a.y = 1 AND b.y = 0 GROUP BY 1)"""


@query(sql("scores", _AUROC + " SELECT s.group_id, CAST(count(*) AS BIGINT) AS n, CAST(sum(y) AS BIGINT) AS n_pos, round(any_value(auroc), 6) AS auroc FROM scores s LEFT JOIN p USING (group_id) GROUP BY 1"))
def auroc_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ev.auroc(fx.scores(spark, sf_dir), ["group_id"]), "auroc")


@query(sql("scores", """SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(y) AS BIGINT) AS n_pos,
(SELECT round(sum(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0 END) / count(*), 6) FROM scores a, scores b WHERE a.y = 1 AND b.y = 0) AS auroc FROM scores"""))  # fmt: skip
def auroc_pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ev.auroc(fx.scores(spark, sf_dir), []), "auroc")


@query(sql("scores", """p AS (SELECT a.group_id, a.doc_id, (SELECT sum(b.y) / count(*) FROM scores b WHERE b.group_id = a.group_id AND b.score >= a.score) AS prec FROM scores a WHERE y = 1),
g AS (SELECT group_id, avg(prec) AS ap FROM p GROUP BY 1)
SELECT s.group_id, round(any_value(ap), 6) AS ap, round(avg(y), 6) AS prevalence FROM scores s LEFT JOIN g USING (group_id) GROUP BY 1"""))  # fmt: skip
def average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ev.average_precision(fx.scores(spark, sf_dir), ["group_id"]), "ap", "prevalence")


@query(sql("scores", """c AS (SELECT group_id, least(score, 3000) AS t, greatest(least(doc_id % 97 * 40.0, 3000), 0) AS p FROM scores), m AS (SELECT group_id, quantile_cont(t, 0.5) AS med FROM c GROUP BY 1)
SELECT group_id, round(avg(abs(p - t)), 6) AS mae, round(avg(abs(med - t)), 6) AS mae_median, count(*) AS n FROM c JOIN m USING (group_id) GROUP BY 1"""))  # fmt: skip
def mae_vs_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = fx.scores(spark, sf_dir).select("group_id", F.col("score").alias("y"), (F.col("doc_id") % 97 * 40.0).alias("pred"))
    return _rounded(ev.mae_vs_median(d, ["group_id"], 3000.0), "mae", "mae_median")


@query(sql("scores", "SELECT group_id, round(avg(y), 6) AS prevalence, round(least(CASE WHEN avg(y) > 0 THEN (1 - avg(y)) / avg(y) ELSE 5 END, 5), 6) AS weight FROM scores GROUP BY 1"))
def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ev.class_weights(fx.scores(spark, sf_dir), ["group_id"], 5.0), "prevalence", "weight")


@query(sql("poses", "SELECT name, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std FROM (UNPIVOT (SELECT x, y, z FROM poses) ON x, y, z INTO NAME name VALUE v) GROUP BY 1"))
def normalizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ev.normalizer(fx.poses(spark, sf_dir), ["x", "y", "z"]), "mean", "std")


@query("""WITH g AS (SELECT DISTINCT user_id // 2 AS recording_id FROM events)
SELECT recording_id, CAST((row_number() OVER (ORDER BY md5('7:' || recording_id), recording_id) - 1) % 5 AS INT) AS fold FROM g""")  # fmt: skip
def assign_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.assign_folds(fx.table(spark, sf_dir, "events").select(F.expr("user_id div 2").alias("recording_id")), "recording_id", 5, 7)


@query(sql("scores", """f AS (SELECT doc_id, group_id AS fold, score AS a, CAST(doc_id * 37 % 101 AS DOUBLE) AS b FROM scores)
SELECT doc_id, fold, round((a + b) / 2, 6) AS mean_score, round((rank() OVER (PARTITION BY fold ORDER BY a) + (count(*) OVER (PARTITION BY fold, a) - 1) / 2 + rank() OVER (PARTITION BY fold ORDER BY b) + (count(*) OVER (PARTITION BY fold, b) - 1) / 2) / 2, 6) AS mean_rank FROM f"""))  # fmt: skip
def late_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = fx.scores(spark, sf_dir).select("doc_id", F.col("group_id").alias("fold"), "score")
    b = a.withColumn("score", (F.col("doc_id") * 37 % 101).cast("double"))
    return _rounded(ev.late_fusion(a, b, ["doc_id"], "fold"), "mean_score", "mean_rank")


@query(sql("scores", _AUROC + " SELECT count(auroc) AS n_folds, round(avg(auroc), 6) AS mean, round(stddev_pop(auroc), 6) AS sd FROM p"))
def summarise_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = ev.auroc(fx.scores(spark, sf_dir), ["group_id"]).withColumn("run", F.lit("length"))
    return _rounded(ev.summarise_runs(per, ["run"], "auroc"), "mean", "sd").select("n_folds", "mean", "sd")


@query()
def paired_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    diffs = ev.auroc(fx.scores(spark, sf_dir), ["group_id"]).filter("auroc IS NOT NULL").select(F.col("group_id").alias("unit"), (F.col("auroc") - 0.5).alias("d"))
    return ev.paired_bootstrap(diffs, "d", 1000, 11)


@query(sql("scores", """t AS (SELECT DISTINCT score FROM scores), r AS (SELECT t.score, sum(y) / count(*) AS prec, sum(y) / (SELECT sum(y) FROM scores) AS recall FROM t JOIN scores s ON s.score >= t.score GROUP BY 1)
SELECT arg_max(score, (recall, score)) AS threshold, round(max(recall), 6) AS recall FROM r WHERE prec >= 0.8"""))  # fmt: skip
def threshold_for_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ev.threshold_for_precision(fx.scores(spark, sf_dir), 0.8), "recall")


# bookkeeping


@query(sql("files disk", """SELECT coalesce(f.path, d.path) AS path, CASE WHEN d.path IS NULL THEN 'missing' WHEN f.path IS NULL THEN 'untracked' ELSE 'mismatched' END AS state
FROM files f FULL JOIN disk d ON f.path = d.path WHERE d.path IS NULL OR f.path IS NULL OR f.size <> d.size OR f.hash <> d.hash"""))  # fmt: skip
def verify_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bk.verify_manifest(fx.files(spark, sf_dir), fx.files_on_disk(spark, sf_dir))


@query(sql("files", """SELECT category, count(*) AS n_files, CAST(sum(size) AS BIGINT) AS bytes FROM (SELECT size, CASE WHEN regexp_matches(path, '^src1\\d/') THEN 'teens' WHEN regexp_matches(path, '^src[0-4]/') THEN 'low' ELSE 'other' END AS category FROM files) GROUP BY 1"""))
def part_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bk.breakdown(bk.categorize(fx.files(spark, sf_dir), "path", [(r"^src1\d/", "teens"), (r"^src[0-4]/", "low")]), "category")


@query(sql("verdicts", "SELECT id, item, stream, verdict, t FROM (SELECT *, row_number() OVER (PARTITION BY id, item ORDER BY t DESC, event_id DESC) AS n FROM verdicts) WHERE n = 1"))
def latest_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bk.latest(fx.verdicts(spark, sf_dir), ["id", "item"], ["t", "event_id"]).drop("event_id")


@query(sql("verdicts", """SELECT item, stream, count(*) FILTER (verdict = 'ok') AS ok, count(*) FILTER (verdict = 'wrong') AS wrong, count(*) FILTER (verdict = 'unsure') AS unsure,
round(count(*) FILTER (verdict = 'ok') / nullif(count(*) FILTER (verdict IN ('ok', 'wrong')), 0), 6) AS accuracy FROM verdicts GROUP BY GROUPING SETS ((item, stream), (item), (stream), ())"""))  # fmt: skip
def review_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(bk.review_summary(fx.verdicts(spark, sf_dir)), "accuracy")


@query(sql("files disk", "SELECT path FROM files EXCEPT SELECT path FROM disk"))
def missing_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bk.difference(fx.files(spark, sf_dir), fx.files_on_disk(spark, sf_dir), "path")


@query("SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels")
def common_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bk.common(fx.table(spark, sf_dir, "documents"), fx.table(spark, sf_dir, "labels"), "doc_id")


@query("""WITH s AS (SELECT n_chars AS k, count(*) AS n, min(doc_id) AS id, min(lang) AS lang FROM documents GROUP BY 1)
SELECT l.doc_id, CASE WHEN n = 1 AND d.lang = 'en' THEN id END AS source_id, CASE WHEN n > 1 THEN 'several' WHEN d.lang <> 'en' THEN 'conflict' ELSE 'ok' END AS bound FROM labels l JOIN documents d USING (doc_id) JOIN s ON s.k = d.n_chars""")  # fmt: skip
def bind_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = fx.table(spark, sf_dir, "documents")
    rows = fx.table(spark, sf_dir, "labels").join(docs.select("doc_id", "n_chars"), "doc_id").select("doc_id", "n_chars", F.lit("en").alias("lang"))
    return bk.bind_ids(rows, docs.select(F.col("doc_id").alias("id"), "n_chars", "lang"), ["n_chars"], ["lang"]).select("doc_id", "source_id", "bound")


@query(sql("frames6", """SELECT a.recording_id, a.frame, CAST(a.n AS BIGINT) AS n, b.n AS second_n, round(b.val, 6) AS second_val FROM frames6 a LEFT JOIN (SELECT * FROM frames6 WHERE role = 1 AND n > 0) b USING (recording_id, frame) WHERE a.role = 0"""))
def merge_side_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fx.frames(spark, sf_dir, 6)
    side = f.filter("role = 1 AND n > 0").select("recording_id", "frame", "n", F.round("val", 6).alias("val"))
    return bk.merge_side_columns(f.filter("role = 0").select("recording_id", "frame", "n"), ["recording_id", "frame"], {"second": side})


@query(sql("boxes", """SELECT frame, max(CASE WHEN slot = 1 THEN area END) AS "1", max(CASE WHEN slot = 2 THEN area END) AS "2", max(CASE WHEN slot = 3 THEN area END) AS "3" FROM (SELECT frame, slot, round(max((x1 - x0) * (y1 - y0)), 6) AS area FROM boxes GROUP BY ALL) GROUP BY 1"""))
def slots_to_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    areas = fx.boxes(spark, sf_dir).select("frame", "slot", F.round((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")), 6).alias("area"))
    return bk.slots_to_columns(areas, ["frame"], "slot", "area", [1, 2, 3])


# words

_TICKS = """k AS (SELECT recording_id, unnest(range(0, CAST(last AS BIGINT) + 45, 15)) AS t FROM (SELECT recording_id, max("end") AS last FROM words GROUP BY 1))"""


@query(sql("words", _TICKS + """ SELECT k.recording_id, k.t, count(w.word) AS n_words, bool_or(coalesce(w.start <= k.t AND w."end" > k.t, false)) AS speaking
FROM k LEFT JOIN words w ON w.recording_id = k.recording_id AND w."end" > k.t - 30 AND w.start <= k.t AND (w."end" <= k.t OR w.start <= k.t) GROUP BY ALL""".replace("count(w.word)", """count(CASE WHEN w."end" <= k.t THEN 1 END)""")))  # fmt: skip
def speech_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that ended in the last 3 s, and whether a word is being spoken, on a grid of 1.5 s to the last word's end and on."""
    words = fx.words(spark, sf_dir)
    last = words.groupBy("recording_id").agg(F.max("end").alias("last"))
    ticks = last.select("recording_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("last") + 44, F.lit(15).cast("bigint"))).alias("t"))
    return tx.speech_columns(words, ticks, ["recording_id"], 30, 15)


_BLOCK = """k AS (SELECT recording_id, role, CAST(ceil("end" / 5.0) AS BIGINT) AS k, start // 5 AS a, "end" AS e, regexp_extract(lower(word), '([a-z0-9'']+)', 1) AS tok FROM words),
l AS (SELECT recording_id, max(k) + 20 AS last FROM k GROUP BY 1), g AS (SELECT DISTINCT k.recording_id, role, unnest(range(last + 1)) AS frame FROM k JOIN l USING (recording_id)),
c AS (SELECT recording_id, role, k AS frame, count(*) FILTER (k > 0) AS n, count(*) FILTER (k > 0 AND tok IN ('pass', 'hand', 'give', 'take', 'grab', 'need', 'can', 'could', 'please', 'here', 'want', 'get', 'bring')) AS asks, max(e) AS e FROM k GROUP BY ALL),
s AS (SELECT DISTINCT recording_id, role, unnest(range(a, k + 1)) AS frame FROM k),
j AS (SELECT g.*, n, asks, e, s.frame IS NOT NULL AS speaking FROM g LEFT JOIN c USING (recording_id, role, frame) LEFT JOIN s ON s.recording_id = g.recording_id AND s.role = g.role AND s.frame = g.frame)
SELECT recording_id, role, frame, speaking, round(least(coalesce((frame * 5 - last_value(e IGNORE NULLS) OVER (PARTITION BY recording_id, role ORDER BY frame)) / 100, 1), 1), 6) AS since,
  CAST(coalesce(sum(n) OVER (PARTITION BY recording_id, role ORDER BY frame ROWS BETWEEN 5 PRECEDING AND CURRENT ROW), 0) AS BIGINT) AS n_words,
  coalesce(sum(asks) OVER (PARTITION BY recording_id, role ORDER BY frame ROWS BETWEEN 5 PRECEDING AND CURRENT ROW), 0) > 0 AS request FROM j"""


@query(sql("words", _BLOCK))
def speech_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speech on frames of half a second, to ten seconds after the last word; the bag's bins have no SQL and are left out."""
    words = fx.words(spark, sf_dir).withColumn("token", s.token(F.col("word")))
    last = words.groupBy("recording_id").agg((F.ceil(F.max("end") / 5) + 20).cast("long").alias("last"))
    grid = dealt(words.select("recording_id", "role").distinct().join(last, "recording_id"), ["recording_id", "role"]).select("recording_id", "role", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("frame"))
    return tx.speech_block(words, grid, ["recording_id", "role"], 5, 6, 100, 8).drop("bag").withColumn("since", F.round("since", 6))


@query("""SELECT conv_id, turn, role AS label, CASE WHEN turn % 2 = 0 THEN ['a {', 'b'] ELSE ['cup'] END AS holding, turn % 3 = 0 AS occurring, md5(text) AS summary FROM conversations""")
def extract_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as replies of an annotator: prose, an object with braces in its strings, and more braces after it."""
    held = F.when(F.col("turn") % 2 == 0, F.lit('["a {", null, "b"]')).otherwise(F.lit('"cup"'))
    json = F.concat(F.lit('{"persons": [{"label": "'), "role", F.lit('", "holding": '), held, F.lit('}], "handover": {"occurring": '), (F.col("turn") % 3 == 0).cast("string"), F.lit('}, "summary": "'), F.md5("text"), F.lit('"}'))
    fenced = F.when(F.col("turn") % 4 == 1, F.concat(F.lit("Sure {!\n```json\n"), json, F.lit("\n``` {done}"))).otherwise(F.concat(F.lit("Here: "), json, F.lit(" and {more}")))
    t = fx.table(spark, sf_dir, "conversations").select("conv_id", "turn", s.normal_annotation(s.extract_json(fenced)).alias("a"))
    return t.select("conv_id", "turn", F.col("a.persons")[0]["label"].alias("label"), F.col("a.persons")[0]["holding"].alias("holding"), "a.handover.occurring", "a.summary")


@query(sql("words", r"""SELECT recording_id, turn, pos, word, regexp_extract(lower(word), '([a-z0-9'']+)', 1) AS token FROM words"""))
def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.words(spark, sf_dir).select("recording_id", "turn", "pos", "word", s.token(F.col("word")).alias("token"))


@query(sql("words", """w AS (SELECT recording_id, turn, min(start) AS start, max("end") AS e FROM words GROUP BY ALL), f AS (SELECT recording_id, e, min(turn) AS turn FROM w GROUP BY ALL)
SELECT a.recording_id, a.turn, b.turn AS last_turn, least(a.start - b.e, 300) AS age FROM w a ASOF LEFT JOIN f b ON a.recording_id = b.recording_id AND a.start >= b.e"""))  # fmt: skip
def last_utterance(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tandem.operators import align

    turns = fx.words(spark, sf_dir).groupBy("recording_id", "turn").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    asked = turns.select("recording_id", F.col("start").alias("t"), "turn")
    ended = turns.select("recording_id", F.col("end").alias("t"), F.col("turn").alias("idx"))
    out = align.asof_backward(asked, ended, ["recording_id"], max_age=300)
    return out.select("recording_id", "turn", F.col("event_idx").alias("last_turn"), "age")


@query(r"""WITH f AS (SELECT doc_id, source || '/' || doc_id AS path FROM documents)
SELECT path, NOT regexp_matches(path, '^/|\\|(^|/)\.{0,2}(/|$)') AS safe, doc_id % 2 = 0 AS even FROM f""")  # fmt: skip
def path_safety(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.files(spark, sf_dir).select("path", s.path_ok(F.col("path")).alias("safe"), (F.col("doc_id") % 2 == 0).alias("even"))


@query("""SELECT o_orderkey AS chunk, CAST(strptime(CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') WHEN 1 THEN strftime(o_orderdate, '%Y%m%d_%H%M%S') ELSE strftime(o_orderdate, '%Y-%m-%d') END,
['%Y-%m-%d %H:%M:%S', '%Y%m%d_%H%M%S', '%Y-%m-%d']) AS DATE)::VARCHAR AS day FROM orders""")  # fmt: skip
def parse_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = fx.table(spark, sf_dir, "orders")
    d = lambda p: F.date_format("o_orderdate", p)
    text = F.when(F.col("o_orderkey") % 3 == 0, d("yyyy-MM-dd HH:mm:ss")).when(F.col("o_orderkey") % 3 == 1, d("yyyyMMdd_HHmmss")).otherwise(d("yyyy-MM-dd"))
    return o.select(F.col("o_orderkey").alias("chunk"), s.parse_time(text).cast("date").cast("string").alias("day"))


@query("""SELECT p_partkey, p_name, regexp_replace(p_brand, '(\\d+)', lpad(regexp_extract(p_brand, '(\\d+)', 1), 12, '0')) AS key FROM part""")
def natural_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.table(spark, sf_dir, "part").select("p_partkey", "p_name", s.natural_key(F.col("p_brand")).alias("key"))


@query("""WITH u AS (SELECT s_suppkey, s_acctbal AS x, ['m', 'cm', 'mm', 'ft'][s_suppkey % 4 + 1] AS unit FROM supplier)
SELECT s_suppkey, unit, round(CASE unit WHEN 'm' THEN x WHEN 'cm' THEN x * 0.01 WHEN 'mm' THEN x * 0.001 END, 6) AS metres, round((1 + 20 * 1e-6) * x + 3, 6) AS ref, round((x - 3) / (1 + 20 * 1e-6), 6) AS own FROM u""")  # fmt: skip
def unit_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = F.element_at(F.array(*map(F.lit, ("m", "cm", "mm", "ft"))), (F.col("s_suppkey") % 4 + 1).cast("int"))
    x = F.col("s_acctbal")
    return fx.table(spark, sf_dir, "supplier").select("s_suppkey", unit.alias("unit"), F.round(s.to_metres(x, unit), 6).alias("metres"), F.round(s.reference_time(x, F.lit(3), F.lit(20)), 6).alias("ref"), F.round(s.stream_time(x, F.lit(3), F.lit(20)), 6).alias("own"))


@query(r"""SELECT doc_id, substr(trim(regexp_replace(text, '[\x00-\x20]+', ' ', 'g')), 1, 200) AS line FROM documents""")
def public_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as one line of 200 characters at most, which is the feature."""
    return fx.table(spark, sf_dir, "documents").select("doc_id", s.sanitise(F.col("text"), 200).alias("line"))


@query("""WITH u AS (SELECT s_suppkey, s_suppkey * 7 AS x, ['s', 'ms', 'us', 'ns', 'h'][s_suppkey % 5 + 1] AS unit FROM supplier)
SELECT s_suppkey, unit, CAST(CASE unit WHEN 's' THEN x * 1000000000 WHEN 'ms' THEN x * 1000000 WHEN 'us' THEN x * 1000 WHEN 'ns' THEN x END AS BIGINT) AS nanos FROM u""")
def nanoseconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = F.element_at(F.array(*map(F.lit, ("s", "ms", "us", "ns", "h"))), (F.col("s_suppkey") % 5 + 1).cast("int"))
    return fx.table(spark, sf_dir, "supplier").select("s_suppkey", unit.alias("unit"), s.to_nanos((F.col("s_suppkey") * 7).cast("long"), unit).cast("long").alias("nanos"))


@query(sql("boxes", "SELECT frame, slot, name, greatest(0, least(x0 - (x1 - x0) * 0.25, 640)) AS x0, greatest(0, least(y0 - (y1 - y0) * 0.25, 480)) AS y0, greatest(0, least(x1 + (x1 - x0) * 0.25, 640)) AS x1, greatest(0, least(y1 + (y1 - y0) * 0.25, 480)) AS y1 FROM boxes"))
def clipped_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes made larger by a quarter on each side and cut to the image."""
    box = s.clip(s.grow([F.col(c).cast("double") for c in ("x0", "y0", "x1", "y1")], 0.25), 640, 480)
    return fx.boxes(spark, sf_dir).select("frame", "slot", "name", *(c.alias(n) for n, c in zip(("x0", "y0", "x1", "y1"), box, strict=True)))
