"""Queries on feature blocks, contact, objects, directions, controls, gaze and identity, with the same rows in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tandem.functions import skeleton
from tandem.operators import boxes as bx
from tandem.operators import events as evt
from tandem.operators import proposals as pr
from tandem.sources import fixtures as fx

from .oracle import recursive, sql
from .q_events import HELD_FROM
from .registry import query

ID = ["recording_id"]
SERIES = ["recording_id", "role"]


def _rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


_BLOCKS = """k AS (SELECT recording_id, frame, max(val) FILTER (role = 0) AS leader_val, max(val) FILTER (role = 1) AS helper_val FROM frames6 GROUP BY ALL),
n AS (SELECT recording_id, frame, max(n) FILTER (role = 0) AS a, max(n) FILTER (role = 1) AS b FROM frames6 GROUP BY ALL),
s1 AS (SELECT recording_id, frame, a AS leader_said, b AS helper_said FROM n WHERE recording_id % 3 <> 0 AND frame % 2 = 0),
s2 AS (SELECT recording_id, frame, a * 2 AS leader_emb, b * 2 AS helper_emb FROM n WHERE recording_id % 4 <> 0),
w AS (SELECT recording_id, frame, a - b AS world_d FROM n WHERE recording_id % 5 <> 0)
"""


def _blocks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[DataFrame], DataFrame]:
    f = fx.frames(spark, sf_dir, 6)
    of = lambda c, r: F.max(F.when(F.col("role") == r, F.col(c)))
    kinematics = f.groupBy("recording_id", "frame").agg(of("val", 0).alias("leader_val"), of("val", 1).alias("helper_val"))
    n = f.groupBy("recording_id", "frame").agg(of("n", 0).alias("a"), of("n", 1).alias("b"))
    said = n.filter("recording_id % 3 <> 0 AND frame % 2 = 0").select("recording_id", "frame", F.col("a").alias("leader_said"), F.col("b").alias("helper_said"))
    emb = n.filter("recording_id % 4 <> 0").selectExpr("recording_id", "frame", "a * 2 AS leader_emb", "b * 2 AS helper_emb")
    return kinematics, [said, emb], n.filter("recording_id % 5 <> 0").selectExpr("recording_id", "frame", "a - b AS world_d")


_LOADED = _BLOCKS + """, h AS (SELECT recording_id FROM s1 INTERSECT SELECT recording_id FROM s2),
x AS (SELECT k.recording_id, k.frame, leader_val, helper_val, leader_said, helper_said, leader_emb, helper_emb, world_d FROM k
  LEFT JOIN (SELECT * FROM s1 SEMI JOIN h USING (recording_id)) USING (recording_id, frame) LEFT JOIN (SELECT * FROM s2 SEMI JOIN h USING (recording_id)) USING (recording_id, frame) LEFT JOIN w USING (recording_id, frame))
"""


@query(sql("frames6", _LOADED + "SELECT * FROM x"))
def load_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pr.load_features(*_blocks(spark, sf_dir), ID)


@query(sql("frames6", _LOADED + "SELECT recording_id, frame, leader_val, leader_said, leader_emb, helper_val, helper_said, helper_emb, world_d FROM x"))
def view_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pr.view(pr.load_features(*_blocks(spark, sf_dir), ID), "both", ID, 10)


@query(sql("frames6", _LOADED + """, o AS (SELECT recording_id, CAST('0x' || substr(sha256(CAST(recording_id AS VARCHAR)), 1, 8) AS BIGINT) % (n - 19) + 10 AS shift, n FROM (SELECT recording_id, max(frame) + 1 AS n FROM x GROUP BY 1)),
m AS (SELECT recording_id, (frame + shift) % n AS frame, helper_val, helper_said, helper_emb FROM x JOIN o USING (recording_id))
SELECT x.recording_id, x.frame, x.leader_val, x.leader_said, x.leader_emb, m.helper_val, m.helper_said, m.helper_emb FROM x LEFT JOIN m USING (recording_id, frame)"""))
def view_both_shuffled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pr.view(pr.load_features(*_blocks(spark, sf_dir), ID), "both_shuffled", ID, 10)


@query(sql("frames6", "SELECT recording_id, role, frame, val FROM frames6 WHERE recording_id % 4 = 3"))
def split_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fx.frames(spark, sf_dir, 6)
    splits = f.select("recording_id").distinct().withColumn("split", F.expr("if(recording_id % 4 = 3, 'test', 'train')"))
    return pr.split_rows(f.select("recording_id", "role", "frame", "val"), splits, "test", ID)


@query(sql("boxes", """SELECT frame, slot, name, 'one' AS detector, round(conf, 6) AS conf FROM boxes WHERE name = 'R' UNION ALL SELECT frame, slot, NULL, 'two', round(conf, 6) FROM boxes WHERE name <> 'R'"""))
def union_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = fx.boxes(spark, sf_dir).select("frame", "slot", F.round("conf", 6).alias("conf"), "name")
    return pr.union_boxes({"one": b.filter("name = 'R'"), "two": b.filter("name <> 'R'").drop("name")})


_CONTACT = """raw AS (SELECT recording_id, role, frame, CASE WHEN n = 0 THEN NULL WHEN n = 1 THEN 'one' ELSE 'many' END AS name, val / 100 AS score FROM frames6),
named AS (SELECT *, coalesce(name, '') AS own FROM raw),
vc AS (SELECT a.recording_id, a.role, a.frame, b.own AS name, count(*) AS c, min(b.frame) AS f, any_value(a.own) AS mine FROM named a JOIN named b ON a.recording_id = b.recording_id AND a.role = b.role AND b.frame BETWEEN a.frame - 1 AND a.frame + 1 GROUP BY a.recording_id, a.role, a.frame, b.own),
l AS (SELECT recording_id, role, frame, nullif(arg_min(name, struct_pack(a := -c, b := CASE WHEN name = mine THEN 0 ELSE 1 END, f := f)), '') AS label FROM vc GROUP BY ALL),
""" + HELD_FROM + """, fin AS (SELECT recording_id, role, max(frame) AS last FROM raw GROUP BY ALL),
held AS (SELECT recording_id, role, label, unnest(range(start, coalesce("end" - 1, last) + 1)) AS frame FROM spans JOIN fin USING (recording_id, role)),
sc AS (SELECT h.recording_id, h.role, h.frame, avg(r.score) AS score FROM held h JOIN raw r ON h.recording_id = r.recording_id AND h.role = r.role AND r.name = h.label AND r.frame BETWEEN h.frame - 1 AND h.frame + 1 GROUP BY ALL)
"""


@query(recursive(sql("frames6", _CONTACT + """SELECT raw.recording_id, raw.role, CAST(raw.frame AS BIGINT) AS frame, held.label AS held, round(coalesce(sc.score, 0), 6) AS score FROM raw
LEFT JOIN held USING (recording_id, role, frame) LEFT JOIN sc USING (recording_id, role, frame)""")))
def contact_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = fx.frames(spark, sf_dir, 6).select(*SERIES, "frame", F.expr("CASE WHEN n = 0 THEN NULL WHEN n = 1 THEN 'one' ELSE 'many' END AS name"), (F.col("val") / 100).alias("score"))
    return _rounded(pr.contact_series(raw, SERIES, 1, 2, 3, "recording_id long, role int")[0], "score")


@query(sql("boxes", """b AS (SELECT * REPLACE (slot * 1000000 + CAST(x0 AS INT) * 1000 + CAST(y0 AS INT) AS slot), CASE WHEN name = 'N' THEN 'hand' WHEN name = 'A' THEN 'cup' WHEN slot % 2 = 0 THEN 'box' END AS cat FROM boxes),
p AS (SELECT frame, slot - 1 AS hand, x0 + 10 * k AS x, y0 + 8 * k AS y FROM boxes, range(5) r(k) WHERE slot <= 2), g AS (SELECT frame, x0 + 5 AS x, y0 + 5 AS y FROM boxes WHERE slot = 3),
m AS (SELECT p.frame, hand, slot, count(*) AS n, nullif(arg_max(coalesce(cat, ''), struct_pack(c := conf, k := coalesce(cat, ''))), '') AS cat, max(conf) AS conf FROM p JOIN b ON p.frame = b.frame AND x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 GROUP BY ALL),
h AS (SELECT frame, hand, arg_max(cat, struct_pack(c := conf, s := -slot)) FILTER (n >= 3 AND cat IS NOT NULL AND cat <> 'hand') AS held, count(*) AS near FROM m GROUP BY ALL),
q AS (SELECT frame, max(held) FILTER (hand = 0) AS held_0, max(held) FILTER (hand = 1) AS held_1, sum(near) AS n_near FROM h GROUP BY 1),
s AS (SELECT g.frame, arg_min(slot, struct_pack(a := (x1 - x0) * (y1 - y0), s := slot)) AS slot, arg_min(cat, struct_pack(a := (x1 - x0) * (y1 - y0), s := slot, k := cat)) AS gazed FROM g JOIN b ON g.frame = b.frame AND x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 AND cat IS NOT NULL GROUP BY 1),
t AS (SELECT s.frame, gazed, gazed = 'hand' AND NOT EXISTS (SELECT 1 FROM m WHERE m.frame = s.frame AND m.slot = s.slot) AS partner FROM s)
SELECT frame, held_0, held_1, gazed, coalesce(partner, false) AS gazed_partner, n_boxes, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near FROM (SELECT frame, count(*) AS n_boxes FROM b GROUP BY 1) LEFT JOIN q USING (frame) LEFT JOIN t USING (frame)"""))
def object_association(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = fx.boxes(spark, sf_dir)
    points = b.filter("slot <= 2").select("frame", (F.col("slot") - 1).alias("hand"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("k"), "x0", "y0").selectExpr("frame", "hand", "x0 + 10 * k AS x", "y0 + 8 * k AS y")
    gaze = b.filter("slot = 3").selectExpr("frame", "x0 + 5 AS x", "y0 + 5 AS y")
    boxes = b.withColumn("cat", F.expr("CASE WHEN name = 'N' THEN 'hand' WHEN name = 'A' THEN 'cup' WHEN slot % 2 = 0 THEN 'box' END"))
    boxes = boxes.withColumn("slot", F.expr("slot * 1000000 + cast(x0 AS int) * 1000 + cast(y0 AS int)"))  # line numbers repeat
    return pr.object_association(points, gaze, boxes, ["frame"])


@query(sql("boxes", """b AS (SELECT * REPLACE (slot * 1000000 + CAST(x0 AS INT) * 1000 + CAST(y0 AS INT) AS slot), CASE WHEN frame % 4 <> 0 THEN (frame * 3 + slot * 2) % 7 / 10.0 END AS z, slot AS s FROM boxes),
h AS (SELECT frame, slot AS hand, [30 * k + x0 for k in range(5)] AS tx, [25 * k + y0 for k in range(5)] AS ty, x0 + 20 AS px, y0 + 10 AS py, frame * s % 7 / 10.0 AS hz FROM b WHERE s <= 2),
g AS (SELECT *, (x0 + x1) / 2 - (x1 - x0) * 0.55 AS g0, (y0 + y1) / 2 - (y1 - y0) * 0.55 AS g1, (x0 + x1) / 2 + (x1 - x0) * 0.55 AS g2, (y0 + y1) / 2 + (y1 - y0) * 0.55 AS g3 FROM b),
m AS (SELECT h.frame, hand, slot, name, conf, (x1 - x0) * (y1 - y0) AS area, len(list_filter(range(1, 6), lambda k: tx[k] >= g0 AND tx[k] <= g2 AND ty[k] >= g1 AND ty[k] <= g3)) AS n_in, px BETWEEN g0 AND g2 AND py BETWEEN g1 AND g3 AS palm
  FROM h JOIN g USING (frame) WHERE coalesce(abs(z - hz) <= 0.15, true)),
c AS (SELECT frame, hand, arg_min(struct_pack(slot := slot, name := name, score := greatest(n_in / 5, CASE WHEN palm THEN 0.2 ELSE 0 END) * conf), struct_pack(a := area, s := slot)) AS best FROM m WHERE n_in >= 3 OR palm GROUP BY ALL)
SELECT h.frame, h.hand, best.slot AS slot, best.name AS name, round(coalesce(best.score, 0), 6) AS score FROM h LEFT JOIN c USING (frame, hand)"""))
def contact_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = fx.boxes(spark, sf_dir).withColumn("s", F.col("slot")).withColumn("slot", F.expr("slot * 1000000 + cast(x0 AS int) * 1000 + cast(y0 AS int)"))
    b = b.withColumn("z", F.expr("if(frame % 4 <> 0, (frame * 3 + s * 2) % 7 / 10, null)"))
    tips = F.expr("transform(sequence(0, 4), k -> named_struct('x', x0 + 30 * k, 'y', y0 + 25 * k))")
    hands = b.filter("s <= 2").select("frame", F.col("slot").alias("hand"), tips.alias("tips"), F.expr("named_struct('x', x0 + 20, 'y', y0 + 10)").alias("palm"), F.expr("frame * s % 7 / 10").alias("z"))
    return _rounded(bx.contact_candidates(hands, b, ["frame"], depth_tolerance=0.15), "score")


_PROBS = """pr AS (SELECT recording_id, role, frame, least(coalesce(val, 0) / 100, 1.0) AS p, CASE WHEN frame % 5 <> 0 THEN frame * 37 % 100 / 100.0 END AS pg FROM frames6),
b AS (SELECT *, CASE WHEN p > 0.4 THEN 'h' WHEN p < 0.2 THEN 'l' ELSE 'm' END AS level FROM pr),
c AS (SELECT *, lead(level) OVER w AS next, max(frame) OVER (PARTITION BY recording_id, role) AS last, lag(level) OVER w AS before FROM b WINDOW w AS (PARTITION BY recording_id, role ORDER BY frame)),
t AS (SELECT * FROM c WHERE level <> 'm' AND level = next AND level IS DISTINCT FROM before),
k AS (SELECT *, lag(level) OVER (PARTITION BY recording_id, role ORDER BY frame) AS prior FROM t),
z AS (SELECT recording_id, role, level, frame AS start, coalesce(lead(frame) OVER (PARTITION BY recording_id, role ORDER BY frame) - 1, last) AS stop FROM k WHERE level IS DISTINCT FROM prior AND NOT (level = 'l' AND prior IS NULL))
"""


@query(sql("frames6", _PROBS + """SELECT z.recording_id, z.role, CAST(start AS BIGINT) AS start, CAST(stop AS BIGINT) AS "end", round(avg(p), 8) AS confidence, round(avg(coalesce(pg, 0.5)), 8) AS gives, round(avg(coalesce(pg, 0.5)), 9) >= 0.5 AS first_gives
FROM z JOIN pr ON z.recording_id = pr.recording_id AND z.role = pr.role AND pr.frame BETWEEN start AND stop WHERE level = 'h' GROUP BY ALL"""))
def propose(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = fx.frames(spark, sf_dir, 6).select(*SERIES, F.col("frame").cast("long").alias("frame"), F.least(F.coalesce("val", F.lit(0.0)) / 100, F.lit(1.0)).alias("p"), F.expr("if(frame % 5 <> 0, frame * 37 % 100 / 100D, null)").alias("p_gives"))
    out = pr.propose(p, SERIES, 0.4, 0.2, 2, 2)
    return _rounded(out.withColumn("first_gives", F.round("gives", 9) >= 0.5), "confidence", "gives", digits=8)


@query(sql("frames intervals", """f AS (SELECT recording_id, frame, max(n) FILTER (role = 0) AS a_n, max(n) FILTER (role = 1) AS b_n, frame % 24 AS hour FROM frames GROUP BY ALL),
w AS (SELECT recording_id, unnest(range(start_frame, end_frame + 1)) AS frame, struct_pack(s := start_frame, i := iv, y := CASE WHEN initiator = 0 THEN 1 ELSE 0 END) AS e FROM intervals),
l AS (SELECT recording_id, frame, max(e).y AS y FROM w WHERE frame >= 24 GROUP BY ALL), r AS (SELECT * FROM f JOIN l USING (recording_id, frame))
SELECT recording_id, frame, a_n, b_n, hour, y, 'ab' AS "order" FROM r UNION ALL SELECT recording_id, frame, b_n, a_n, hour, 1 - y, 'ba' FROM r"""))
def direction_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda r: F.max(F.when(F.col("role") == r, F.col("n")))
    features = fx.frames(spark, sf_dir).groupBy("recording_id", "frame").agg(of(0).alias("a_n"), of(1).alias("b_n")).withColumn("hour", F.col("frame") % 24)
    events = fx.intervals(spark, sf_dir).withColumn("first_gives", F.col("initiator") == 0)
    return pr.direction_rows(features, events, ID, "a_", "b_", 24)


_METRICS = "m AS (SELECT l_returnflag AS task, l_linenumber AS fold, CASE l_suppkey % 5 WHEN 0 THEN 'leader' WHEN 1 THEN 'helper' WHEN 2 THEN 'both' WHEN 3 THEN 'both_shuffled' ELSE 'late_fusion' END AS view, avg(l_discount) AS value FROM lineitem GROUP BY ALL)"


@query("WITH " + _METRICS + """, a AS (SELECT task, view, avg(value) AS mean FROM m WHERE view IN ('leader', 'helper') GROUP BY ALL), b AS (SELECT task, arg_min(view, struct_pack(a := -mean, v := view)) AS reference FROM a GROUP BY 1),
r AS (SELECT task, 'best_single' AS versus, reference FROM b UNION ALL SELECT DISTINCT task, c, c FROM m, (VALUES ('both_shuffled'), ('late_fusion')) x(c)),
d AS (SELECT r.task, versus, reference, f.value - o.value AS d FROM r JOIN m o ON o.task = r.task AND o.view = reference JOIN m f ON f.task = r.task AND f.fold = o.fold AND f.view = 'both')
SELECT task, versus, reference, round(avg(d), 6) AS mean_diff, round(stddev_pop(d), 6) AS sd_diff, count(*) FILTER (d > 0) AS folds_won, count(d) AS n_folds FROM d GROUP BY ALL""")
def controls_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = F.expr("CASE l_suppkey % 5 WHEN 0 THEN 'leader' WHEN 1 THEN 'helper' WHEN 2 THEN 'both' WHEN 3 THEN 'both_shuffled' ELSE 'late_fusion' END")
    m = fx.table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("task"), F.col("l_linenumber").alias("fold"), views.alias("view")).agg(F.avg("l_discount").alias("value"))
    return _rounded(pr.controls_table(m, ["task"], "view", ["leader", "helper"], "both", ["both_shuffled", "late_fusion"]), "mean_diff", "sd_diff")


@query(sql("scores", """l AS (SELECT group_id, y, 'length' AS name, score FROM scores UNION ALL SELECT group_id, y, 'number', CAST(doc_id % 97 AS DOUBLE) FROM scores WHERE doc_id % 10 <> 0),
r AS (SELECT *, rank() OVER (PARTITION BY name, group_id ORDER BY score) + (count(*) OVER (PARTITION BY name, group_id, score) - 1) / 2 AS r, rank() OVER (PARTITION BY name ORDER BY score) + (count(*) OVER (PARTITION BY name, score) - 1) / 2 AS ra FROM l),
g AS (SELECT name, group_id, CASE WHEN sum(y) > 0 AND sum(y) < count(*) THEN (sum(r) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))) END AS a FROM r GROUP BY ALL),
p AS (SELECT name, (sum(ra) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))) AS pooled FROM r GROUP BY 1)
SELECT name, round(avg(a), 6) AS mean, round(stddev_pop(a), 6) AS sd, count(a) AS n_series, round(any_value(pooled), 6) AS pooled FROM g JOIN p USING (name) GROUP BY 1"""))
def score_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fx.scores(spark, sf_dir).withColumnRenamed("score", "length").withColumn("number", F.expr("if(doc_id % 10 <> 0, cast(doc_id % 97 AS double), null)"))
    return _rounded(pr.score_table(s, ["group_id"], ["length", "number"]), "mean", "sd", "pooled")


@query(sql("poses", """h AS (SELECT recording_id, frame // 2 AS frame, frame % 2 AS role, CASE WHEN vec_id % 5 <> 0 THEN qx END AS fx, qy AS fy, qz AS fz, CASE WHEN vec_id % 7 <> 0 THEN x END AS x, y, z, CASE WHEN vec_id % 3 <> 0 THEN abs(x) * 500 END AS ia FROM poses),
j AS (SELECT a.*, b.x - a.x AS dx, b.y - a.y AS dy, b.z - a.z AS dz FROM h a LEFT JOIN h b ON a.recording_id = b.recording_id AND a.frame = b.frame AND a.role = 1 - b.role),
c AS (SELECT *, (fx * dx + fy * dy + fz * dz) / (sqrt(fx * fx + fy * fy + fz * fz) * sqrt(dx * dx + dy * dy + dz * dz)) AS c FROM j),
s AS (SELECT *, degrees(acos(CASE WHEN c > 1 THEN 1 WHEN c < -1 THEN -1 ELSE c END)) AS solid FROM c),
r AS (SELECT recording_id, frame, role, coalesce(solid, ia) AS angle, CASE WHEN solid IS NOT NULL THEN 'headpose' WHEN ia IS NOT NULL THEN 'image' ELSE 'none' END AS method, coalesce(coalesce(solid, ia) < 80, false) AS looking FROM s)
SELECT recording_id, frame, role, round(angle, 4) AS angle, method, looking, count(*) FILTER (looking) OVER (PARTITION BY recording_id, frame) = 2 AS mutual FROM r"""))
def gaze_proxy(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = fx.poses(spark, sf_dir).selectExpr(
        "recording_id", "frame div 2 AS frame", "frame % 2 AS role", "if(vec_id % 5 <> 0, qx, null) AS fx", "qy AS fy", "qz AS fz", "if(vec_id % 7 <> 0, x, null) AS x", "y", "z",
        "if(vec_id % 3 <> 0, abs(x) * 500, null) AS image_angle",
    )
    return _rounded(pr.gaze_proxy(heads, ID, (0, 1), 80.0), "angle", digits=4)


@query(sql("poses", """h AS (SELECT recording_id, frame // 2 AS frame, frame % 2 AS role, vec_id, CASE WHEN vec_id % 5 <> 0 THEN qx END AS fx, qy AS fy, qz AS fz, x, y, z FROM poses),
o AS (SELECT recording_id, frame // 2 AS frame, k AS name, CASE WHEN (vec_id + ascii(k)) % 3 <> 0 THEN y + ascii(k) / 200.0 END AS x, z - ascii(k) / 300.0 AS y, x AS z FROM poses, (VALUES ('cup'), ('box'), ('jar')) v(k) WHERE frame % 2 = 0 AND vec_id % 4 <> 0),
c AS (SELECT h.recording_id, h.frame, role, name, (fx * (o.x - h.x) + fy * (o.y - h.y) + fz * (o.z - h.z)) / (sqrt(fx * fx + fy * fy + fz * fz) * sqrt((o.x - h.x) ** 2 + (o.y - h.y) ** 2 + (o.z - h.z) ** 2)) AS c FROM h JOIN o ON o.recording_id = h.recording_id AND o.frame = h.frame),
k AS (SELECT recording_id, frame, role, name, degrees(acos(greatest(-1, least(1, c)))) AS angle FROM c WHERE c IS NOT NULL QUALIFY row_number() OVER (PARTITION BY recording_id, frame, role ORDER BY c DESC, name) = 1),
s AS (SELECT recording_id, frame, role, name, angle FROM (SELECT recording_id, frame, role, n AS name, abs(x) * 300 + length(n) AS angle FROM h, (VALUES ('cup'), ('plate')) v(n) WHERE vec_id % 6 <> 0) QUALIFY row_number() OVER (PARTITION BY recording_id, frame, role ORDER BY angle, name) = 1)
SELECT h.recording_id, h.frame, h.role, coalesce(k.name, s.name) AS object, round(coalesce(k.angle, s.angle), 4) AS object_angle, CASE WHEN coalesce(k.angle, s.angle) < 60 THEN coalesce(k.name, s.name) END AS looking_at FROM h LEFT JOIN k USING (recording_id, frame, role) LEFT JOIN s USING (recording_id, frame, role)"""))
def object_gaze(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = fx.poses(spark, sf_dir).withColumns({"role": F.col("frame") % 2, "at": F.col("frame")}).withColumn("frame", F.expr("frame div 2"))
    heads = p.selectExpr("recording_id", "frame", "role", "if(vec_id % 5 <> 0, qx, null) AS fx", "qy AS fy", "qz AS fz", "x", "y", "z")
    things = p.filter("at % 2 = 0 AND vec_id % 4 <> 0").withColumn("name", F.explode(F.array(*map(F.lit, ("cup", "box", "jar")))))
    things = things.selectExpr("recording_id", "frame", "name", "if((vec_id + ascii(name)) % 3 <> 0, y + ascii(name) / 200, null) AS x", "z - ascii(name) / 300 AS y", "x AS z")
    seen = p.filter("vec_id % 6 <> 0").withColumn("name", F.explode(F.array(F.lit("cup"), F.lit("plate")))).selectExpr("recording_id", "frame", "role", "name", "abs(x) * 300 + length(name) AS angle")
    return _rounded(pr.object_gaze(heads, things, seen, ID, 60.0), "object_angle", digits=4)


@query(sql("boxes", """t AS (SELECT frame // 50 AS grp, CASE WHEN slot % 2 = 0 THEN 'b' ELSE 'a' END AS stream, frame, slot AS track, x0 AS x FROM boxes),
p AS (SELECT *, row_number() OVER (PARTITION BY grp, stream, frame ORDER BY x, track) AS place FROM t), z AS (SELECT grp, stream, track, count(DISTINCT frame) AS size FROM t GROUP BY ALL),
c AS (SELECT a.grp, a.track AS track_a, b.track AS track_b, count(*) AS n, avg(CASE WHEN a.place = b.place THEN 1.0 ELSE 0 END) AS agreement FROM p a JOIN p b ON a.grp = b.grp AND a.frame = b.frame AND a.stream = 'a' AND b.stream = 'b' GROUP BY ALL)
SELECT c.grp, track_a, track_b, n, round(n / (u.size + v.size - n), 6) AS ratio, round(agreement, 6) AS rank_agreement FROM c
JOIN z u ON u.grp = c.grp AND u.stream = 'a' AND u.track = track_a JOIN z v ON v.grp = c.grp AND v.stream = 'b' AND v.track = track_b WHERE n >= 3"""))
def view_cooccurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    tracks = fx.boxes(spark, sf_dir).selectExpr("frame div 50 AS grp", "if(slot % 2 = 0, 'b', 'a') AS stream", "frame", "slot AS track", "x0 AS x")
    out = pr.view_cooccurrence(tracks, ["grp"], "a", "b", 3)
    # as DuckDB rounds: the product with a million, whose half may lie a little beside that of the decimal digits
    return out.withColumns({c: F.round(F.col(c) * 1e6, 0) / 1e6 for c in ("ratio", "rank_agreement")})


BONES = [(5, 7, 0.3), (7, 9, 0.25), (6, 8, 0.3), (8, 10, 0.25), (11, 13, 0.4), (13, 15, 0.4)]


def _e(i: int, c: int) -> str:
    """Coordinate c of keypoint i in SQL; keypoint 7 is missing in every sixth vector, 12 in every fourth."""
    gone = {7: "vec_id % 6 = 0", 12: "vec_id % 4 = 0"}.get(i)
    value = f"embedding[{3 * i + c + 1}]::DOUBLE"
    return f"(CASE WHEN NOT ({gone}) THEN {value} END)" if gone else value


_LEN = ", ".join(f"sqrt({' + '.join(f'({_e(a, c)} - {_e(b, c)}) ** 2' for c in range(3))}) / {usual}" for a, b, usual in BONES)
_UP = [f"(({_e(5, c)} + {_e(6, c)}) / 2 - CASE WHEN {_e(12, 0)} IS NULL THEN {_e(11, c)} ELSE ({_e(11, c)} + {_e(12, c)}) / 2 END)" for c in range(3)]
_SIDE = [f"({_e(5, c)} - {_e(6, c)})" for c in range(3)]
_SHOWN = [f"({_SIDE[(k + 1) % 3]} * {_UP[(k + 2) % 3]} - {_SIDE[(k + 2) % 3]} * {_UP[(k + 1) % 3]})" for k in range(3)]
_SEEN = [f"({_e(0, c)} - ({_e(3, c)} + {_e(4, c)}) / 2)" for c in range(3)]


@query(f"""WITH b AS (SELECT vec_id, list_filter([{_LEN}], lambda v: v IS NOT NULL) AS r, {', '.join(f'{s} AS s{k}' for k, s in enumerate(_SHOWN))}, {', '.join(f'{s} AS f{k}' for k, s in enumerate(_SEEN))} FROM embeddings),
c AS (SELECT *, (s0 * f0 + s1 * f1 + s2 * f2) / (sqrt(s0 * s0 + s1 * s1 + s2 * s2) * sqrt(f0 * f0 + f1 * f1 + f2 * f2) + 1e-12) AS c FROM b)
SELECT vec_id, CASE WHEN len(r) >= 5 THEN round(list_median(r), 5) END AS scale, CASE WHEN c > 0.3 THEN 1 WHEN c < -0.3 THEN -1 ELSE 0 END AS side FROM c""")
def skeleton_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = lambda i, c: F.col("embedding")[3 * i + c].cast("double")
    gone = {7: F.col("vec_id") % 6 == 0, 12: F.col("vec_id") % 4 == 0}
    points = F.array(*(F.struct(*(F.when(~gone[i], e(i, c)).alias(n) if i in gone else e(i, c).alias(n) for c, n in enumerate("xyz"))) for i in range(17)))
    t = fx.table(spark, sf_dir, "embeddings").select("vec_id", points.alias("p"))
    return t.select("vec_id", F.round(skeleton.bone_scale(F.col("p"), BONES, 5), 5).alias("scale"), skeleton.chirality(F.col("p")).alias("side"))


@query("""WITH k AS (SELECT vec_id, unnest([0, 1]) AS person, embedding AS e FROM embeddings), p AS (SELECT vec_id, person, i, e[person * 9 + 3 * i + 1]::DOUBLE AS x, e[person * 9 + 3 * i + 2]::DOUBLE AS y, abs(e[person * 9 + 3 * i + 3]::DOUBLE) * 3 AS c FROM k, range(3) r(i)),
s AS (SELECT vec_id, person, sum(c) AS score, avg(x) AS x, avg(y) AS y FROM p WHERE c >= 0.3 GROUP BY ALL), b AS (SELECT vec_id, arg_max(x, struct_pack(s := score, p := -person)) AS x, arg_max(y, struct_pack(s := score, p := -person)) AS y FROM s GROUP BY 1)
SELECT vec_id, round(x, 6) AS x, round(y, 6) AS y FROM embeddings LEFT JOIN b USING (vec_id)""")
def head_pixel(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = lambda i: F.col("embedding")[i].cast("double")
    person = lambda p: F.array(*(F.struct(e(9 * p + 3 * i).alias("x"), e(9 * p + 3 * i + 1).alias("y"), (F.abs(e(9 * p + 3 * i + 2)) * 3).alias("conf")) for i in range(3)))
    t = fx.table(spark, sf_dir, "embeddings").select("vec_id", skeleton.head_pixel(F.array(person(0), person(1))).alias("h"))
    return t.select("vec_id", F.round("h.x", 6).alias("x"), F.round("h.y", 6).alias("y"))


_AXES = {"a": (0.6, 0.0, 0.8), "b": (0.0, 0.6, 0.8)}


def _people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring poses as the two people of a frame; their wrists and gaze are the same numbers in other orders."""
    p = fx.poses(spark, sf_dir)
    parts = []
    for k, name in enumerate("ab"):
        have = {"": "vec_id % 10 <> 0", "left_": "vec_id % 9 <> 0", "right_": "vec_id % 4 <> 0", "gaze_": "vec_id % 8 <> 0"}
        at = {"": ("x", "y", "z"), "left_": ("2 * y", "2 * z", "2 * x"), "right_": ("3 * z", "x", "3 * y"), "gaze_": ("4 * x", "x", "z")}
        cols = [f"if({have[n]}, {e}, null) AS {name}_{n}{c}" for n in have for c, e in zip("xyz", at[n], strict=True)] + [f"if({have['']}, {q}, null) AS {name}_{q}" for q in ("qx", "qy", "qz", "qw")]
        parts.append(p.filter(f"frame % 2 = {k}").selectExpr("recording_id", "frame div 2 AS frame", *cols))
    return parts[0].join(parts[1], ["recording_id", "frame"])


def _world_sql() -> str:
    have = {"": "vec_id % 10 <> 0", "left_": "vec_id % 9 <> 0", "right_": "vec_id % 4 <> 0", "gaze_": "vec_id % 8 <> 0"}
    at = {"": ("x", "y", "z"), "left_": ("2 * y", "2 * z", "2 * x"), "right_": ("3 * z", "x", "3 * y"), "gaze_": ("4 * x", "x", "z")}

    def rot(p: str) -> list[str]:
        x, y, z, w = (f"{p}_q{c}" for c in "xyzw")
        return [f"(1-2*({y}*{y}+{z}*{z}))", f"(2*({x}*{y}-{z}*{w}))", f"(2*({x}*{z}+{y}*{w}))", f"(2*({x}*{y}+{z}*{w}))", f"(1-2*({x}*{x}+{z}*{z}))", f"(2*({y}*{z}-{x}*{w}))", f"(2*({x}*{z}-{y}*{w}))", f"(2*({y}*{z}+{x}*{w}))", f"(1-2*({x}*{x}+{y}*{y}))"]

    one = lambda p, k: f"{p} AS (SELECT recording_id, frame // 2 AS frame, " + ", ".join([f"CASE WHEN {have[n]} THEN {e} END AS {p}_{n}{c}" for n in have for c, e in zip("xyz", at[n], strict=True)] + [f"CASE WHEN {have['']} THEN {q} END AS {p}_{q}" for q in ("qx", "qy", "qz", "qw")]) + f" FROM poses WHERE frame % 2 = {k})"
    world = [f"{rot(p)[3 * i]}*{p}_{n}_x+{rot(p)[3 * i + 1]}*{p}_{n}_y+{rot(p)[3 * i + 2]}*{p}_{n}_z+{p}_{c} AS {p}_w{n}_{c}" for p in "ab" for n in ("left", "right", "gaze") for i, c in enumerate("xyz")]
    dist = lambda u, v: f"sqrt(({u}x-{v}x)**2+({u}y-{v}y)**2+({u}z-{v}z)**2)"
    zero = lambda c, e: f"coalesce(CASE WHEN {c} THEN {e} END, 0)"
    pairs = {f"d_{i[0]}{j[0]}": f"coalesce({dist(f'a_w{i}_', f'b_w{j}_')}, 3)" for i in ("left", "right") for j in ("left", "right")}
    has = lambda p, n: f"{p}_{n}_x IS NOT NULL"
    any_pair = " OR ".join(f'"both" AND {has("a", i)} AND {has("b", j)}' for i in ("left", "right") for j in ("left", "right"))
    out = {"d_min": zero("any_pair", "near"), "closing": zero("any_pair AND lag(any_pair) OVER w", "greatest(least((near - lag(near) OVER w) * 10, 5), -5)"), "heads": zero('"both"', dist("a_", "b_"))}
    for p, o in (("a", "b"), ("b", "a")):
        back = lambda v, i, p=p: f"{rot(p)[i]}*({v}x-{p}_x)+{rot(p)[3 + i]}*({v}y-{p}_y)+{rot(p)[6 + i]}*({v}z-{p}_z)"
        out |= {f"{p}_{o}_{c}": zero('"both"', back(f"{o}_", i)) for i, c in enumerate("xyz")}
        out |= {f"{p}_{n}_{c}": zero('"both"', back(f"{o}_w{n}_", i)) for n in ("left", "right") for i, c in enumerate("xyz")}
        looks = f'"both" AND {has(p, "gaze")}'
        out[f"gaze_wrist_{p}"] = zero(f"{looks} AND ({has(o, 'left')} OR {has(o, 'right')})", f"least(coalesce({dist(f'{p}_wgaze_', f'{o}_wleft_')}, 3), coalesce({dist(f'{p}_wgaze_', f'{o}_wright_')}, 3))")
        out[f"gaze_head_{p}"] = zero(looks, dist(f"{p}_wgaze_", f"{o}_"))
        ahead = [f"({'+'.join(f'{rot(p)[3 * i + k]}*{_AXES[p][k]}' for k in range(3))})" for i in range(3)]
        out[f"facing_{p}"] = zero('"both"', f"({'+'.join(f'{ahead[i]}*({o}_{c}-{p}_{c})' for i, c in enumerate('xyz'))})/({dist(f'{o}_', f'{p}_')}+1e-6)")
    rounded = ", ".join(f"round({n}, 5) AS {n}" for n in pairs) + ", " + ", ".join(f"round({e}, 5) AS {n}" for n, e in out.items())
    hands = ", ".join(f"{has(p, 'left')} OR {has(p, 'right')} AS hands_{p}" for p in "ab")
    near = "least(" + ", ".join(pairs) + ")"
    return f"{one('a', 0)}, {one('b', 1)}, j AS (SELECT *, a_x IS NOT NULL AND b_x IS NOT NULL AS \"both\" FROM a JOIN b USING (recording_id, frame)), v AS (SELECT *, {', '.join(world)} FROM j), d AS (SELECT *, {', '.join(f'{e} AS {n}' for n, e in pairs.items())}, {any_pair} AS any_pair FROM v), m AS (SELECT *, {near} AS near FROM d) SELECT recording_id, frame, \"both\", {hands}, {rounded} FROM m WINDOW w AS (PARTITION BY recording_id ORDER BY frame)"


@query(sql("poses", _world_sql()))
def world_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evt.world_block(_people(spark, sf_dir), ID, 10.0, _AXES)
    return _rounded(out, *(c for c in evt.WORLD if c not in ("both", "hands_a", "hands_b")), digits=5)
