"""Queries on tracks, bodies and views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tandem.operators import identity
from tandem.sources import fixtures as fx

from .oracle import recursive, sql
from .registry import query

#: All ways to pair the smaller side: a's one after the other take a free b or, where there are more a's than b's, none.
_ENUMERATION = """sides AS (SELECT grp, list_sort(list(DISTINCT a)) AS la, list_sort(list(DISTINCT b)) AS lb FROM costs GROUP BY grp),
ways(grp, k, pairs, total) AS (SELECT grp, 0, CAST([] AS STRUCT(a BIGINT, b BIGINT)[]), CAST(0 AS DOUBLE) FROM sides UNION ALL
  SELECT w.grp, w.k + 1, CASE WHEN c.b IS NULL THEN pairs ELSE list_append(pairs, {'a': la[w.k + 1], 'b': c.b}) END, total + coalesce(c.cost, 0)
  FROM ways w JOIN sides s USING (grp) JOIN (SELECT grp, a, b, cost FROM costs UNION ALL SELECT grp, a, NULL, NULL FROM (SELECT DISTINCT grp, a FROM costs)) c ON c.grp = w.grp AND c.a = la[w.k + 1]
  WHERE w.k < len(la) AND (c.b IS NULL OR NOT list_contains(list_transform(pairs, lambda p: p.b), c.b))),
full_ways AS (SELECT w.*, row_number() OVER (PARTITION BY w.grp ORDER BY round(total, 9), pairs) AS place, lead(total) OVER (PARTITION BY w.grp ORDER BY round(total, 9), pairs) - total AS margin FROM ways w JOIN sides USING (grp) WHERE k = len(la) AND len(pairs) = least(len(la), len(lb))),
chosen AS (SELECT grp, unnest(pairs) AS p, margin FROM full_ways WHERE place = 1)"""

#: Six keypoints of a box: its corners, the middle of its top and its centre; seen by the box's confidence, or hidden.
_POINTS = [("x0", "y0"), ("x1", "y0"), ("x0", "y1"), ("x1", "y1"), ("(x0 + x1) / 2", "y0"), ("(x0 + x1) / 2", "(y0 + y1) / 2")]


@query(recursive(sql("boxes", f"""t AS (SELECT frame // 50 AS grp, frame, slot AS a, [{', '.join(f"{{'x': {x}, 'y': {y}, 'c': CASE WHEN (frame + {k}) % 17 = 0 THEN 0.2 ELSE conf END}}" for k, (x, y) in enumerate(_POINTS))}] AS p FROM boxes WHERE slot % 2 = 1),
b AS (SELECT frame // 50 AS grp, frame, slot AS b, [{', '.join(f"{{'x': CASE WHEN (frame + {k}) % 13 <> 0 THEN {x} END, 'y': {y}}}" for k, (x, y) in enumerate(_POINTS))}] AS q FROM boxes WHERE slot % 2 = 0),
m AS (SELECT t.grp, a, b, list_filter(list_transform(range(1, 7), lambda i: CASE WHEN p[i].c > 0.3 THEN sqrt((p[i].x - q[i].x) ** 2 + (p[i].y - q[i].y) ** 2) END), lambda v: v IS NOT NULL) AS d FROM t JOIN b ON t.grp = b.grp AND t.frame = b.frame),
g AS (SELECT grp, a, b, count(*) FILTER (len(d) >= 5) AS n, avg(list_avg(d) / 1000) FILTER (len(d) >= 5) AS distance FROM m GROUP BY ALL),
costs AS (SELECT x.grp, x.a, y.b, coalesce(n, 0) AS n, distance, coalesce(distance, 1.0) AS cost FROM (SELECT DISTINCT grp, a FROM t) x JOIN (SELECT DISTINCT grp, b FROM b) y ON x.grp = y.grp LEFT JOIN g ON g.grp = x.grp AND g.a = x.a AND g.b = y.b),
{_ENUMERATION}
SELECT c.grp, c.a AS track, c.b AS body, n, round(distance, 6) AS distance FROM chosen JOIN costs c ON c.grp = chosen.grp AND c.a = p.a AND c.b = p.b WHERE n >= 2 AND distance < 0.25""")))
def match_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = fx.boxes(spark, sf_dir).withColumn("grp", F.expr("frame div 50"))
    tracks = ", ".join(f"struct({x} AS x, {y} AS y, if((frame + {k}) % 17 = 0, 0.2D, cast(conf AS double)) AS conf)" for k, (x, y) in enumerate(_POINTS))
    bodies = ", ".join(f"struct(if((frame + {k}) % 13 <> 0, {x}, null) AS x, {y} AS y)" for k, (x, y) in enumerate(_POINTS))
    t = boxes.filter("slot % 2 = 1").selectExpr("grp", "frame", "slot AS track", f"array({tracks}) AS t")
    b = boxes.filter("slot % 2 = 0").selectExpr("grp", "frame", "slot AS body", f"array({bodies}) AS b")
    out = identity.match_tracks(t, b, ["grp"], 1000.0, least=2, most=0.25)
    return out.withColumn("distance", F.round("distance", 6))


@query(recursive(sql("boxes", f"""t AS (SELECT frame // 50 AS grp, CASE WHEN slot % 2 = 0 THEN 'b' ELSE 'a' END AS stream, frame, slot AS track, min(x0) AS x, min(y0) AS y FROM boxes GROUP BY ALL),
h AS (SELECT grp, stream, track, [count(*) FILTER (y < 100), count(*) FILTER (y >= 100 AND y < 250), count(*) FILTER (y >= 250)] AS hist, count(*) AS size FROM t GROUP BY ALL),
n AS (SELECT u.grp, u.track AS a, v.track AS b, count(*) AS n FROM t u JOIN t v ON u.grp = v.grp AND u.frame = v.frame AND u.stream = 'a' AND v.stream = 'b' GROUP BY ALL),
costs AS (SELECT u.grp, u.track AS a, v.track AS b, coalesce(n, 0) / (u.size + v.size - coalesce(n, 0)) AS ratio,
    sqrt(greatest(0, 1 - (sqrt(u.hist[1] * v.hist[1]) + sqrt(u.hist[2] * v.hist[2]) + sqrt(u.hist[3] * v.hist[3])) / sqrt(u.size * v.size))) AS appearance, appearance + 1 - ratio AS cost
  FROM h u JOIN h v ON u.grp = v.grp AND u.stream = 'a' AND v.stream = 'b' LEFT JOIN n ON n.grp = u.grp AND n.a = u.track AND n.b = v.track),
{_ENUMERATION},
shown AS (SELECT c.grp, u.frame, list(p.a ORDER BY u.x, p.a) AS in_a, list(p.a ORDER BY v.x, p.a) AS in_b FROM chosen c JOIN t u ON u.grp = c.grp AND u.stream = 'a' AND u.track = p.a JOIN t v ON v.grp = c.grp AND v.stream = 'b' AND v.track = p.b AND v.frame = u.frame GROUP BY ALL HAVING count(*) >= 2),
lr AS (SELECT grp, count(*) AS n_covisible, avg(CASE WHEN in_a = in_b THEN 1.0 ELSE 0 END) AS same, avg(CASE WHEN in_a = list_reverse(in_b) THEN 1.0 ELSE 0 END) AS mirrored FROM shown GROUP BY grp)
SELECT c.grp, p.a AS track_a, p.b AS track_b, round(ratio, 6) AS ratio, round(appearance, 6) AS appearance, round(cost, 6) AS cost, round(margin, 6) AS margin, coalesce(margin < 0.1, false) AS ambiguous,
  coalesce(n_covisible, 0) AS n_covisible, round(same, 6) AS same, round(mirrored, 6) AS mirrored, CASE WHEN n_covisible IS NULL THEN 'unknown' WHEN same >= mirrored THEN 'same' ELSE 'mirrored' END AS orientation
FROM chosen c JOIN costs k ON k.grp = c.grp AND k.a = p.a AND k.b = p.b LEFT JOIN lr ON lr.grp = c.grp""")))
def cross_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    tracks = fx.boxes(spark, sf_dir).selectExpr("frame div 50 AS grp", "if(slot % 2 = 0, 'b', 'a') AS stream", "frame", "slot AS track", "x0 AS x", "y0 AS y").groupBy("grp", "stream", "frame", "track").agg(F.min("x").alias("x"), F.min("y").alias("y"))
    bins = [F.count_if(x).cast("double") for x in (F.col("y") < 100, (F.col("y") >= 100) & (F.col("y") < 250), F.col("y") >= 250)]
    looks = tracks.groupBy("grp", "stream", "track").agg(F.array(*bins).alias("hist"))
    out = identity.cross_view(tracks, looks, ["grp"], "a", "b")
    return out.withColumns({c: F.round(c, 6) for c in ("ratio", "appearance", "cost", "margin", "same", "mirrored")})


@query()
def link_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = fx.boxes(spark, sf_dir).withColumn("stream", F.expr("frame div 50")).withColumn("frame", F.col("frame") % 50)
    look = F.array(F.lit(1.0), F.pmod(F.hash("name"), F.lit(7)).cast("double"), F.col("slot") % 3 + 0.5)
    return identity.link_tracks(boxes.withColumn("hist", F.when(F.col("slot") < 7, look)), ["stream"], "stream long", 5, 2)
