"""Queries on feature tables of recordings and on the choice of thresholds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tandem.operators import features
from tandem.sources import fixtures as fx

from .oracle import sql
from .registry import query

ID = ["recording_id"]
#: Samples of both people from the vectors, every other one's: two points and a palm's normal for each hand, and gaze.
_HANDS = {"left": range(1, 10), "right": range(20, 29)}
_RAW = """raw AS (SELECT recording_id, CAST(p.vec_id % 2 AS INT) AS role, frame * 1000 + p.vec_id % 5 AS t, p.vec_id AS idx, embedding AS e FROM poses p JOIN embeddings v ON v.vec_id = p.vec_id),
gr AS (SELECT recording_id, role, CAST(f AS INT) AS frame, f * 700 + role * 50 AS t FROM (SELECT recording_id, role, max(t) AS last FROM raw GROUP BY ALL), unnest(range(last // 700 + 2)) x(f)),
nr AS (SELECT g.recording_id, g.role, g.frame, r.idx, r.e, row_number() OVER (PARTITION BY g.recording_id, g.role, g.frame ORDER BY abs(r.t - g.t), r.t, r.idx) AS k, abs(r.t - g.t) AS gap FROM gr g JOIN raw r USING (recording_id, role)),
"""
_SIDE = "; ".join(_HANDS)
_ONE = "ne AS (SELECT * FROM nr WHERE k = 1), one AS (SELECT recording_id, role, frame, " + ", ".join(
    f"list_transform([{', '.join(f'CAST(e[{i + 1}] AS DOUBLE)' for i in at)}], lambda v: CASE WHEN {s}_valid THEN round(v, 5) ELSE 0 END) AS {s}, round(CASE WHEN {s}_valid THEN least(abs(CAST(e[{11 + k}] AS DOUBLE)) * 8, 1) ELSE 0 END, 5) AS {s}_conf, {s}_valid" for k, (s, at) in enumerate(_HANDS.items())
) + """, round(CASE WHEN gv THEN tan(yaw) / ln * far ELSE 0 END, 5) AS gaze_x, round(CASE WHEN gv THEN tan(pitch) / ln * far ELSE 0 END, 5) AS gaze_y, round(CASE WHEN gv THEN 1 / ln * far ELSE 0 END, 5) AS gaze_z,
  round(CASE WHEN gv THEN tan(yaw) / ln ELSE 0 END, 5) AS look_x, round(CASE WHEN gv THEN tan(pitch) / ln ELSE 0 END, 5) AS look_y, round(CASE WHEN gv THEN 1 / ln ELSE 0 END, 5) AS look_z, gv AS gaze_valid
  FROM (SELECT *, gap <= 900 AND idx % 7 <> 0 AS left_valid, gap <= 900 AND idx % 11 <> 0 AS right_valid, gap <= 500 AND idx % 13 <> 0 AS gv, yaw, pitch, sqrt(tan(yaw) ** 2 + tan(pitch) ** 2 + 1) AS ln, CASE WHEN d > 0 AND d < 10 THEN d ELSE 1 END AS far
    FROM (SELECT *, (CAST(e[41] AS DOUBLE) + CAST(e[42] AS DOUBLE)) / 2 AS yaw, CAST(e[43] AS DOUBLE) AS pitch, CAST(e[44] AS DOUBLE) * 40 AS d FROM ne)))"""
_OWN = [*(f"{s}{x}" for s in _HANDS for x in ("", "_conf", "_valid")), "gaze_x", "gaze_y", "gaze_z", "look_x", "look_y", "look_z", "gaze_valid"]


def _kinematics(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = fx.poses(spark, sf_dir).select("recording_id", "frame", "vec_id").join(fx.table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e")), "vec_id")
    raw = raw.select("recording_id", F.expr("cast(vec_id % 2 AS int)").alias("role"), F.expr("frame * 1000 + vec_id % 5").alias("t"), F.col("vec_id").alias("idx"), "e")
    last = raw.groupBy("recording_id", "role").agg(F.max("t").alias("last"))
    grid = last.select("recording_id", "role", F.explode(F.expr("sequence(0, cast(last div 700 + 1 AS int))")).alias("frame")).withColumn("t", F.expr("cast(frame * 700 + role * 50 AS long)"))
    part = lambda s, k, gone: [F.array(*(F.when((F.col("idx") % gone != 0) | (i % 2 == 0), F.col("e")[i]).otherwise(F.lit(float("nan"))) for i in _HANDS[s])).alias(s), F.when(F.col("idx") % (2 * gone) == 0, F.lit(-1.0)).otherwise(F.abs(F.col("e")[10 + k]) * 8).alias(f"{s}_conf")]
    hands = raw.select("recording_id", "role", "t", "idx", *part("left", 0, 7), *part("right", 1, 11))
    gone = F.col("idx") % 13 == 0
    gaze = raw.select("recording_id", "role", "t", "idx", F.when(~gone, F.col("e")[40]).alias("left_yaw"), F.col("e")[41].alias("right_yaw"), F.col("e")[42].alias("pitch"), (F.col("e")[43] * 40).alias("depth"))
    return features.recording_kinematics(grid, hands, gaze, ID, {0: "leader", 1: "helper"}, 900, 500)


@query(sql("poses", _RAW + _ONE + f" SELECT a.recording_id, a.frame, {', '.join(f'{t}.{c} AS {n}_{c}' for t, n in (('a', 'leader'), ('b', 'helper')) for c in _OWN)} FROM one a JOIN one b ON a.recording_id = b.recording_id AND a.frame = b.frame AND a.role = 0 AND b.role = 1"))
def recording_kinematics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _kinematics(spark, sf_dir)
    flat = [c for c, kind in out.dtypes if kind == "double"]
    lists = [c for c, kind in out.dtypes if kind == "array<double>"]
    return out.withColumns({c: F.round(c, 5) for c in flat} | {c: F.transform(c, lambda v: F.round(v, 5)) for c in lists})


@query(sql("poses", _RAW + _ONE + f" SELECT a.recording_id, count(*) AS n_frames, {', '.join(f'round(avg(CAST({t}.{c}_valid AS INT)), 6) AS {n}_{c}_valid' for t, n in (('a', 'leader'), ('b', 'helper')) for c in ('left', 'right', 'gaze'))} FROM one a JOIN one b ON a.recording_id = b.recording_id AND a.frame = b.frame AND a.role = 0 AND b.role = 1 GROUP BY 1"))
def valid_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = features.valid_shares(_kinematics(spark, sf_dir), ID, ["leader", "helper"])
    return out.withColumns({c: F.round(c, 6) for c in out.columns if c.endswith("_valid")})


_PERSON_SQL = """w AS (SELECT recording_id, role, frame, CASE WHEN (frame * 7 + role) % 9 <> 0 AND n > 0 THEN val / 500 END AS lu, CASE WHEN (frame * 7 + role) % 9 <> 0 AND n > 0 THEN n / 7.0 END AS lv, CASE WHEN n > 1 THEN val / 300 END AS ru, CASE WHEN n > 1 THEN frame % 5 / 5.0 END AS rv,
  frame % 4 = 0 AS lh, CASE WHEN frame % 6 <> 0 THEN frame % 3 = 0 END AS rh, CASE WHEN n <> 2 THEN val END AS angle FROM frames6),
c AS (SELECT *, lu - 0.5137 AS a, lv - 0.3071 AS b, ru - 0.5137 AS c, rv - 0.3071 AS d FROM w),
ps AS (SELECT recording_id, role, frame, coalesce(sqrt((a - lag(a) OVER u) ** 2 + (b - lag(b) OVER u) ** 2) * 9.973, 0) AS wrist_speed_left, coalesce(sqrt((c - lag(c) OVER u) ** 2 + (d - lag(d) OVER u) ** 2) * 9.973, 0) AS wrist_speed_right, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN 1.0 ELSE 0 END AS present_left, CASE WHEN c IS NOT NULL AND d IS NOT NULL THEN 1.0 ELSE 0 END AS present_right,
  coalesce(sqrt(a * a + b * b), 0) AS radius_left, coalesce(sqrt(c * c + d * d), 0) AS radius_right, coalesce(sqrt((a - c) ** 2 + (b - d) ** 2), 0) AS hands_apart, CAST(lh AS INT) AS held_left, coalesce(CAST(rh AS INT), 0) AS held_right, coalesce(angle, 0) AS angle, CASE WHEN angle IS NULL THEN 0 ELSE 1 END AS angle_valid FROM c WINDOW u AS (PARTITION BY recording_id, role ORDER BY frame)),
tg AS (SELECT recording_id, frame, coalesce(max(val) FILTER (role = 0), 0) AS head_distance, coalesce(max(n) FILTER (role = 1), 0) AS wrist_distance, CASE WHEN max(val) FILTER (role = 0) IS NOT NULL AND max(n) FILTER (role = 1) > 0 THEN 1 ELSE 0 END AS distance_valid FROM frames6 GROUP BY ALL),
"""
_BASE = [*(f"{p}_{c}" for p in "ab" for c in features.PERSON), *features.TOGETHER]
_ALL = [*_BASE, *(f"{c}_{s}_{w}" for w in ("1s", "3s") for s in features.STATS for c in _BASE)]


def _proposal_sql() -> str:
    base = "bs AS (SELECT a.recording_id, a.frame, " + ", ".join(f"CAST({p}.{c} AS DOUBLE) AS {p}_{c}" for p in "ab" for c in features.PERSON) + ", " + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in features.TOGETHER)
    base += " FROM ps a JOIN ps b ON a.recording_id = b.recording_id AND a.frame = b.frame AND a.role = 0 AND b.role = 1 JOIN tg ON tg.recording_id = a.recording_id AND tg.frame = a.frame),\n"
    # rows before the first frame stand for themselves: its copies
    pad = "pd AS (SELECT * FROM bs UNION ALL SELECT recording_id, CAST(0 - k AS INT), " + ", ".join(_BASE) + " FROM bs, range(1, 10) t(k) WHERE frame = 0),\n"
    fn = {"mean": "avg", "std": "stddev_pop", "max": "max"}
    stats = ", ".join(f"{fn[s]}({c}) OVER w{w} AS {c}_{s}_{w}" for w in ("1s", "3s") for s in features.STATS for c in _BASE)
    full = f"fu AS (SELECT *, {stats} FROM pd WINDOW w1s AS (PARTITION BY recording_id ORDER BY frame ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), w3s AS (PARTITION BY recording_id ORDER BY frame ROWS BETWEEN 8 PRECEDING AND CURRENT ROW))\n"
    swap = lambda c: {"a_": "b_", "b_": "a_"}.get(c[:2], c[:2]) + c[2:]
    rows = [f"SELECT recording_id, frame, '{o}' AS \"order\", {', '.join(f'round({swap(c) if o == 'ba' else c}, 4) AS {c}' for c in _ALL)} FROM fu WHERE frame >= 0" for o in ("ab", "ba")]
    return _PERSON_SQL + base + pad + full + " UNION ALL ".join(rows)


def _people(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fx.frames(spark, sf_dir, 6)
    return f.selectExpr(
        "recording_id", "role", "frame", "if((frame * 7 + role) % 9 <> 0 AND n > 0, val / 500, null) AS left_u", "if((frame * 7 + role) % 9 <> 0 AND n > 0, n / 7.0D, double('NaN')) AS left_v", "if(n > 1, val / 300, null) AS right_u", "if(n > 1, frame % 5 / 5.0D, null) AS right_v",
        "frame % 4 = 0 AS left_held", "if(frame % 6 <> 0, frame % 3 = 0, null) AS right_held", "if(n <> 2, val, double('NaN')) AS angle",
    )


@query(sql("frames6", _proposal_sql()))
def proposal_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """175 features of every frame for both orders of the two people."""
    p = features.person_features(_people(spark, sf_dir), ["recording_id", "role"], 9.973, (0.5137, 0.3071))
    apart = fx.frames(spark, sf_dir, 6).groupBy("recording_id", "frame").agg(F.max(F.when(F.col("role") == 0, F.col("val"))).alias("head_distance"), F.max(F.when(F.col("role") == 1, F.col("n").cast("double"))).alias("wrist_distance"))
    out = features.proposal_features(p.filter("role = 0").drop("role"), p.filter("role = 1").drop("role"), apart, ID, {"1s": 4, "3s": 9}, 4)
    return out.select("recording_id", "frame", "order", *_ALL)


@query(sql("words", """u AS (SELECT recording_id, role, max("end") AS t, turn AS idx, [count(*) / 10.0, CAST(turn AS DOUBLE)] AS v FROM words GROUP BY recording_id, role, turn),
gr AS (SELECT recording_id, role, CAST(f AS INT) AS frame, f * 250 AS t FROM (SELECT recording_id, role, max(t) AS last FROM u GROUP BY ALL), unnest(range(last // 250 + 3)) x(f)),
j AS (SELECT g.recording_id, g.role, frame, least(g.t - u.t, 1000) AS age, v FROM gr g ASOF LEFT JOIN u ON g.recording_id = u.recording_id AND g.role = u.role AND g.t >= u.t)
SELECT recording_id, role, frame, CASE WHEN v IS NULL THEN [0.0, 0.0] ELSE list_transform(v, lambda x: round(x * exp(-age / 400.0), 6)) END AS block, round(coalesce(age / 1000.0, 1), 6) AS age FROM j"""))
def utterance_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn with its number of words and its place as a vector."""
    said = fx.words(spark, sf_dir).groupBy("recording_id", "role", "turn").agg(F.max("end").alias("t"), F.count(F.lit(1)).alias("k"))
    said = said.select("recording_id", "role", "t", F.col("turn").alias("idx"), F.array(F.col("k") / 10, F.col("turn").cast("double")).alias("v"))
    grid = said.groupBy("recording_id", "role").agg(F.max("t").alias("last")).select("recording_id", "role", F.explode(F.expr("sequence(0, cast(last div 250 + 2 AS int))")).alias("frame")).withColumn("t", F.expr("cast(frame * 250 AS long)"))
    out = features.utterance_block(grid, said, ["recording_id", "role"], 2, 400.0, 1000.0)
    return out.withColumns({"block": F.transform("block", lambda x: F.round(x, 6)), "age": F.round("age", 6)})


_FOUR = "round(quantile_cont({c}, 0.5), 4) AS {n}median, round(avg({c}), 4) AS {n}mean, round(quantile_cont({c}, 0.9), 4) AS {n}p90, round(avg(CASE WHEN {c} < 70 THEN 1.0 ELSE 0 END), 6) AS {n}near"


@query(sql("poses", """q AS (SELECT recording_id, frame, vec_id, x / nm AS x, y / nm AS y, z / nm AS z FROM (SELECT *, sqrt(x * x + y * y + z * z) AS nm FROM poses) WHERE vec_id % 9 <> 0),
p AS (SELECT recording_id, 'all' AS part, x, y, z FROM q UNION ALL SELECT recording_id, 'attending', x, y, z FROM q WHERE vec_id % 4 < 2), a AS (SELECT *, degrees(acos(greatest(-1, least(1, 0.6 * y + 0.8 * z)))) AS angle FROM p),
m AS (SELECT recording_id, part, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM a GROUP BY ALL), k AS (SELECT recording_id, part, mx / nm AS ax, my / nm AS ay, mz / nm AS az FROM (SELECT *, sqrt(mx * mx + my * my + mz * mz) AS nm FROM m)),
o AS (SELECT a.*, ax, ay, az, degrees(acos(greatest(-1, least(1, x * ax + y * ay + z * az)))) AS off FROM a JOIN k USING (recording_id, part))
SELECT recording_id, part, count(*) AS n, """ + _FOUR.format(c="angle", n="") + ", round(any_value(ax), 5) AS axis_x, round(any_value(ay), 5) AS axis_y, round(any_value(az), 5) AS axis_z, round(degrees(acos(0.6 * any_value(ay) + 0.8 * any_value(az))), 4) AS axis_angle, " + _FOUR.format(c="off", n="off_") + " FROM o GROUP BY ALL"))
def gaze_axis_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    length = F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2)
    p = fx.poses(spark, sf_dir)
    gaze = p.select("recording_id", *(F.when(F.col("vec_id") % 9 != 0, F.col(c) / length).alias(c) for c in "xyz"), (F.col("vec_id") % 4 < 2).alias("attending"))
    out = features.gaze_axis_stats(gaze, ID, (0.0, 0.6, 0.8), 70.0)
    digits = lambda c: 5 if c in ("axis_x", "axis_y", "axis_z") else 6 if c.endswith("near") else 4
    return out.withColumns({c: F.round(c, digits(c)) for c in out.columns if c not in ("recording_id", "part", "n")})
