"""Queries on motion sensors: lags with a null distribution, clocks, and the arm chain."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tandem.operators import sensor
from tandem.sources import fixtures as fx

from .oracle import sql
from .registry import query

ID = ["recording_id"]


@query(sql("frames6", """mf AS (SELECT max(frame) AS m FROM frames6), x0 AS (SELECT recording_id, frame - 4 AS i, sqrt(n) AS x FROM frames6, mf WHERE role = 0 AND frame BETWEEN 4 AND m - 4),
y0 AS (SELECT recording_id, frame + o - 4 AS i, CAST(o AS INT) AS lag, sqrt(n) AS y FROM frames6, range(-4, 5) t(o) WHERE role = 1), nn AS (SELECT recording_id, count(*) AS n FROM x0 GROUP BY 1),
tr AS (SELECT DISTINCT recording_id, n, 6 + ((n - 12) * i) // 19 AS s, true AS turned FROM nn, range(20) t(i) UNION ALL SELECT recording_id, n, 0, false FROM nn),
c AS (SELECT tr.recording_id, lag, s, turned, any_value(n) AS n, CASE WHEN stddev_pop(x) > 1e-12 AND stddev_pop(y) > 1e-12 THEN corr(x, y) END AS r
  FROM tr JOIN x0 USING (recording_id) JOIN y0 ON y0.recording_id = tr.recording_id AND y0.i = (x0.i + s) % n GROUP BY ALL),
cv AS (SELECT * FROM c WHERE NOT turned), pk AS (SELECT recording_id, lag AS best, r, n FROM cv WHERE r IS NOT NULL QUALIFY row_number() OVER (PARTITION BY recording_id ORDER BY round(r, 12) DESC, lag) = 1),
w AS (SELECT cv.recording_id, lag, cv.r AS c, best, pk.r, pk.n, lag(cv.r) OVER u AS pre, lead(cv.r) OVER u AS post FROM cv JOIN pk USING (recording_id) WINDOW u AS (PARTITION BY cv.recording_id ORDER BY lag)),
b AS (SELECT recording_id, coalesce(max(lag) FILTER (lag < best AND coalesce(round(c - r / 2, 12) <= 0, true)), -99) AS lo, coalesce(min(lag) FILTER (lag > best AND coalesce(round(c - r / 2, 12) <= 0, true)), 99) AS hi FROM w GROUP BY 1),
f AS (SELECT recording_id, best, r, n, max(c) FILTER (lag BETWEEN -3 AND 3 AND round(c, 12) >= coalesce(round(pre, 12), '-Infinity'::DOUBLE) AND round(c, 12) >= coalesce(round(post, 12), '-Infinity'::DOUBLE) AND (lag <= lo OR lag >= hi)) AS hill, max(c) FILTER (lag <= lo OR lag >= hi) AS outside,
  max(pre) FILTER (lag = best) AS pre, max(post) FILTER (lag = best) AS post, max(c) FILTER (lag = 0) AS r_at_zero FROM w JOIN b USING (recording_id) GROUP BY ALL),
nl AS (SELECT recording_id, s, max(r) AS v FROM c WHERE turned AND r IS NOT NULL GROUP BY ALL),
q AS (SELECT recording_id, count(*) AS m, count(*) FILTER (round(v, 12) >= round(r, 12)) AS above, avg(v) AS mean, stddev_pop(v) AS sd, quantile_cont(v, 0.99) AS p99 FROM nl JOIN pk USING (recording_id) GROUP BY 1)
SELECT recording_id, best AS lag, round(best + CASE WHEN round(pre - 2 * r + post, 12) < 0 THEN greatest(-0.5, least(0.5, 0.5 * (pre - post) / (pre - 2 * r + post))) ELSE 0 END, 5) AS fine, round(r, 5) AS r, round(r_at_zero, 5) AS r_at_zero, CAST(n AS INT) AS n,
  round((1 + above) / (1 + m), 5) AS p, round((r - mean) / sd, 4) AS z, round(p99, 5) AS null_p99, CASE WHEN round(coalesce(hill, outside), 12) > 0 THEN round(r / coalesce(hill, outside), 4) END AS peak_ratio, best <= -3 OR best >= 3 AS at_edge FROM f JOIN q USING (recording_id)"""))
def lag_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fx.frames(spark, sf_dir, 6)
    last = f.groupBy("recording_id").agg(F.max("frame").alias("last"))
    x = f.filter("role = 0").join(last, ID).filter("frame BETWEEN 4 AND last - 4").selectExpr("recording_id", "frame AS k", "sqrt(n) AS x")
    y = f.filter("role = 1").selectExpr("recording_id", "frame", "sqrt(n) AS y", "explode(sequence(-4, 4)) AS lag").selectExpr("recording_id", "frame + lag AS k", "lag", "y")
    out = sensor.lag_test(sensor.shift_scores(x.join(y, ["recording_id", "k"]), ID, "recording_id long", F.lit(6), 20), ID)
    return out.withColumns({c: F.round(c, 5) for c in ("fine", "r", "r_at_zero", "p", "null_p99")} | {c: F.round(c, 4) for c in ("z", "peak_ratio")})


@query()
def sensor_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every recording's turns against how far its position is from the middle, a frame a second; the usual steps, turns and
    windows, so that a clock can be found. Less of these can't: of 20 turns none is significant at one in a hundred."""
    p = fx.poses(spark, sf_dir).withColumn("t", F.col("frame").cast("double"))
    frames = p.select("recording_id", "t", F.sqrt(F.col("x") ** 2 + F.col("y") ** 2).alias("motion"))
    rule = sensor.ClockRule(most_lag=3, least_shift=6, least_frames=20)
    return sensor.sensor_clock(frames, p.select("recording_id", "t", "qx", "qy", "qz", "qw"), ID, "recording_id long", 2.0, rule)


_SLOTS = ["chest", "left_shoulder", "left_forearm", "left_hand", "right_shoulder", "right_forearm", "right_hand"]
_NAMES = {s: tuple(f"{s}_{x}" for x in ("shoulder", "forearm", "hand")) for s in ("left", "right")}


def _arm_sql() -> str:
    """Every instant's seven sensors side by side, then the chain written out."""
    q = lambda k: [f"q{k}{c}" for c in "xyzw"]

    def fwd(k: int) -> list[str]:
        x, y, z, w = q(k)
        return [f"(-2 * ({x} * {y} - {z} * {w}))", f"(2 * ({y} * {z} + {x} * {w}))", f"(1 - 2 * ({x} * {x} + {z} * {z}))"]

    x, y, z, w = q(0)
    wide = ", ".join(f"max(q{c}) FILTER (slot = {k}) AS q{k}{c}" for k in range(7) for c in "xyzw")
    turned = ", ".join(f"cos(yaw) * {f[0]} - sin(yaw) * {f[2]} AS f{k}x, {f[1]} AS f{k}y, sin(yaw) * {f[0]} + cos(yaw) * {f[2]} AS f{k}z" for k in range(1, 7) for f in [fwd(k)])
    sides = []
    for side, base, at in (("left", 1, (-0.18, 1.4, 0.0)), ("right", 4, (0.18, 1.4, 0.0))):
        ok = f"(yaw IS NOT NULL AND f{base}y IS NOT NULL AND f{base + 1}y IS NOT NULL)"
        cols, sums = [], [str(v) for v in at]
        for k, joint in enumerate(sensor.JOINTS):
            if k:
                sums = [f"{s} + {sensor.ARM[k - 1]} * f{base + k - 1}{c}" for s, c in zip(sums, "xyz")]
            cols += [f"round(CASE WHEN {ok} THEN {s} END, 5) AS {joint}_{c}" for s, c in zip(sums, "xyz")]
        dot = " + ".join(f"f{base}{c} * f{base + 1}{c}" for c in "xyz")
        sides.append(f"SELECT recording_id, instant, '{side}' AS side, {ok} AS valid, {ok} AND f{base + 2}y IS NOT NULL AS hand_valid, round(CASE WHEN {ok} THEN yaw END, 5) AS yaw, round(CASE WHEN {ok} THEN degrees(acos(greatest(-1, least(1, {dot})))) END, 3) AS flexion, {', '.join(cols)} FROM t")
    return f"""s AS (SELECT recording_id, frame // 7 AS instant, frame % 7 AS slot, qx, qy, qz, qw FROM poses WHERE vec_id % 19 <> 0), v AS (SELECT recording_id, instant, {wide} FROM s GROUP BY ALL),
y AS (SELECT *, atan2(-2 * ({x} * {z} + {y} * {w}), 2 * ({y} * {z} - {x} * {w})) AS yaw FROM v), t AS (SELECT recording_id, instant, yaw, {turned} FROM y)
{' UNION ALL '.join(sides)}"""


@query(sql("poses", _arm_sql()))
def arm_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven poses in a row as the seven sensors of an instant; every 19th is missing."""
    p = fx.poses(spark, sf_dir).filter("vec_id % 19 <> 0")
    names = F.array(*map(F.lit, _SLOTS))
    slots = p.select("recording_id", F.expr("frame div 7").alias("instant"), F.element_at(names, (F.col("frame") % 7 + 1).cast("int")).alias("slot"), "qx", "qy", "qz", "qw")
    out = sensor.arm_chain(slots, ["recording_id", "instant"], _NAMES)
    return out.withColumns({c: F.round(c, 3 if c == "flexion" else 5) for c in out.columns if c not in ("recording_id", "instant", "side", "valid", "hand_valid")})
