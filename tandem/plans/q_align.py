"""Queries on aligned series, with the same rows in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tandem.operators import align
from tandem.sources import fixtures as fx

from .oracle import sql
from .registry import query

HOUR = 3_600_000_000
SIX = 6 * HOUR


def _two(samples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The first person's samples as queries, the second's as samples."""
    return samples.filter("role = 0").select("recording_id", "t", F.col("idx").alias("q_idx")), samples.filter("role = 1").select("recording_id", "t", "idx", "val")


#: Brute force: every pair of a query and a first sample of its time.
_NEAREST = """
q AS (SELECT recording_id, t, idx AS q_idx FROM {table} WHERE role = 0),
s AS (SELECT recording_id, t, min(idx) AS idx, arg_min(val, idx) AS val FROM {table} WHERE role = 1 AND t IS NOT NULL GROUP BY recording_id, t),
p AS (SELECT q.recording_id, q.t, q.q_idx, s.t AS sample_t, s.idx AS sample_idx, s.val AS sample_val,
  row_number() OVER (PARTITION BY q.recording_id, q.q_idx ORDER BY abs(s.t - q.t), s.t, s.idx) AS rn
  FROM q LEFT JOIN s ON q.recording_id = s.recording_id AND q.t IS NOT NULL),
m AS (SELECT recording_id, t, q_idx, sample_t, sample_idx, sample_val, sample_t - t AS residual, abs(sample_t - t) AS gap,
  CASE WHEN t IS NULL THEN 'missing_query' WHEN sample_t IS NULL THEN 'no_samples' WHEN abs(sample_t - t) <= {limit} THEN 'matched' ELSE 'gap_exceeded' END AS status
  FROM p WHERE rn = 1)
"""


def nearest_sql(table: str, limit: int, body: str) -> str:
    return sql("samples sparse" if table == "sparse" else "samples", _NEAREST.format(table=table, limit=limit) + body)


def nearest(spark: SparkSession, sf_dir: str, limit: int = SIX, sparse: bool = False) -> DataFrame:
    q, s = _two(fx.sparse_samples(spark, sf_dir) if sparse else fx.samples(spark, sf_dir))
    return align.asof_nearest(q, s, ["recording_id"], limit, ["val"])


@query(nearest_sql("samples", SIX, "SELECT recording_id, t, q_idx, sample_t, sample_idx, round(sample_val, 6) AS sample_val, residual, gap, status FROM m"))
def asof_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark, sf_dir).withColumn("sample_val", F.round("sample_val", 6))


@query(nearest_sql("sparse", SIX, "SELECT recording_id, t, q_idx, sample_t, sample_idx, round(sample_val, 6) AS sample_val, residual, gap, status FROM m"))
def asof_nearest_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark, sf_dir, sparse=True).withColumn("sample_val", F.round("sample_val", 6))


@query(sql("samples", """
q AS (SELECT recording_id, t, idx AS q_idx FROM samples WHERE role = 0), s AS (SELECT recording_id, t, min(idx) AS idx FROM samples WHERE role = 1 GROUP BY ALL)
SELECT q.recording_id, q.t, q_idx, s.t AS event_t, s.idx AS event_idx, least(q.t - s.t, 14400000000) AS age FROM q ASOF LEFT JOIN s ON q.recording_id = s.recording_id AND q.t >= s.t"""))  # fmt: skip
def asof_backward(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, s = _two(fx.samples(spark, sf_dir))
    return align.asof_backward(q, s, ["recording_id"], max_age=4 * HOUR)


@query(sql("samples", """
g AS (SELECT recording_id, 1704067200000000 + f * 21600000000 AS t, f AS frame FROM (SELECT DISTINCT recording_id FROM samples), range(120) r(f)),
s AS (SELECT recording_id, t, min(idx) AS idx FROM samples WHERE role = 1 GROUP BY ALL),
p AS (SELECT g.recording_id, g.t, frame, s.idx AS sample_idx, abs(s.t - g.t) AS gap, row_number() OVER (PARTITION BY g.recording_id, frame ORDER BY abs(s.t - g.t), s.t) AS rn
  FROM g LEFT JOIN s USING (recording_id))
SELECT recording_id, CAST(frame AS INT) AS frame, sample_idx, gap, coalesce(gap <= 10800000000, false) AS covered FROM p WHERE rn = 1"""))  # fmt: skip
def asof_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = fx.grid(spark, sf_dir, 6).withColumn("t", F.col("frame").cast("long") * SIX + 1_704_067_200_000_000)
    return align.asof_grid(grid, _two(fx.samples(spark, sf_dir))[1], ["recording_id"], 3 * HOUR).select("recording_id", "frame", "sample_idx", "gap", "covered")


@query(nearest_sql("samples", 1 << 62, """,
d AS (SELECT recording_id, quantile_cont(step, 0.5) AS period FROM (SELECT recording_id, t - lag(t) OVER (PARTITION BY recording_id ORDER BY t, idx) AS step FROM samples WHERE role = 1) GROUP BY 1)
SELECT recording_id, t, q_idx, CASE WHEN gap <= period * 0.75 THEN sample_idx END AS sample_idx, residual, gap, round(period, 6) AS period, coalesce(gap <= period * 0.75, false) AS near FROM m LEFT JOIN d USING (recording_id)"""))  # fmt: skip
def asof_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, s = _two(fx.samples(spark, sf_dir))
    return align.asof_period(q, s, ["recording_id"]).withColumn("period", F.round("period", 6))


@query(sql("samples sparse", """
SELECT q.recording_id, q.t, q.idx, p.other FROM sparse q LEFT JOIN (SELECT recording_id, t, arg_min(t * 2 + idx, idx) AS other FROM sparse WHERE role = 1 AND t IS NOT NULL GROUP BY ALL) p
ON q.recording_id = p.recording_id AND q.t = p.t WHERE q.role = 0"""))  # fmt: skip
def clock_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fx.sparse_samples(spark, sf_dir)
    pairs = s.filter("role = 1 AND t IS NOT NULL").select("recording_id", "t", "idx", (F.col("t") * 2 + F.col("idx")).alias("other"))
    return align.clock_lookup(s.filter("role = 0").select("recording_id", "t", "idx"), pairs, ["recording_id"])


#: Mappings between the clocks: one direct, two rival ones, none for the last.
_MAPS = [("dev0", "utc", 1.5, 1000), ("dev1", "utc", 1.0, 5), ("dev1", "utc", 1.0, 6), ("utc", "dev0", 0.5, 0)]


@query(sql("samples", """
SELECT recording_id, role, idx, clock, CASE clock WHEN 'utc' THEN t WHEN 'dev0' THEN CAST(round(t * 1.5) AS BIGINT) + 1000 END AS t_to,
  CASE clock WHEN 'utc' THEN 'identity' WHEN 'dev0' THEN 'ok' WHEN 'dev1' THEN 'ambiguous' ELSE 'no_mapping' END AS clock_status
FROM (SELECT *, CASE idx % 4 WHEN 0 THEN 'utc' WHEN 1 THEN 'dev0' WHEN 2 THEN 'dev1' ELSE 'dev2' END AS clock FROM (SELECT recording_id, role, idx, (t - 1704067200000000) // 1000 AS t FROM samples))"""))  # fmt: skip
def convert_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fx.samples(spark, sf_dir).selectExpr("recording_id", "role", "idx", "(t - 1704067200000000) div 1000 AS t", "CASE idx % 4 WHEN 0 THEN 'utc' WHEN 1 THEN 'dev0' WHEN 2 THEN 'dev1' ELSE 'dev2' END AS clock")
    return align.convert_clock(s, spark.createDataFrame(_MAPS, "src string, dst string, scale double, offset long"), "utc").drop("t")


@query(sql("samples", """
v AS (SELECT recording_id, role, t, idx, CASE WHEN kind = 'click' THEN val END AS own FROM samples),
p AS (SELECT a.recording_id, a.role, a.idx, b.own AS borrowed, abs(a.t - b.t) AS g, row_number() OVER (PARTITION BY a.recording_id, a.role, a.idx ORDER BY abs(a.t - b.t), b.t, b.own) AS rn
  FROM v a LEFT JOIN v b ON a.recording_id = b.recording_id AND a.role = b.role AND b.own IS NOT NULL)
SELECT recording_id, role, idx, CASE WHEN g <= 43200000000 THEN round(borrowed, 6) END AS borrowed, CASE WHEN g <= 43200000000 THEN g END AS borrow_gap FROM p WHERE rn = 1"""))  # fmt: skip
def borrow_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fx.samples(spark, sf_dir).withColumn("own", F.when(F.col("kind") == "click", F.col("val")))
    return align.borrow_nearest(s, ["recording_id", "role"], "own", 12 * HOUR).select("recording_id", "role", "idx", F.round("borrowed", 6).alias("borrowed"), "borrow_gap")


@query(nearest_sql("sparse", SIX, """
SELECT recording_id, count(*) AS n_queries, count(*) FILTER (status = 'matched') AS n_accepted, round(count(*) FILTER (status = 'matched') / count(*), 6) AS coverage,
  count(*) FILTER (status = 'gap_exceeded') AS n_rejected, count(*) FILTER (status = 'missing_query') AS n_missing, round(quantile_cont(gap, 0.5), 6) AS gap_p50, round(quantile_cont(gap, 0.95), 6) AS gap_p95,
  CAST(max(gap) AS DOUBLE) AS gap_max, round(quantile_cont(CASE WHEN status = 'matched' THEN gap END, 0.5), 6) AS accepted_p50, CAST(max(CASE WHEN status = 'matched' THEN gap END) AS DOUBLE) AS accepted_max FROM m GROUP BY recording_id"""))  # fmt: skip
def match_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = align.match_summary(nearest(spark, sf_dir, sparse=True), ["recording_id"])
    return out.withColumns({c: F.round(c, 6) for c in ("coverage", "gap_p50", "gap_p95", "accepted_p50")})


@query(nearest_sql("sparse", SIX, """
SELECT *, CASE WHEN n_compared = 0 THEN 'INSUFFICIENT_DATA' WHEN n_excessive + n_rejected + n_missing > 0 THEN 'FAIL' ELSE 'PASS' END AS status FROM (
SELECT recording_id, count(gap) AS n_compared, count(*) FILTER (status = 'matched' AND gap > 10800000000) AS n_excessive, count(*) FILTER (status = 'gap_exceeded') AS n_rejected,
  count(*) FILTER (status = 'missing_query') AS n_missing, max(gap) AS max_gap FROM m GROUP BY recording_id)"""))  # fmt: skip
def qc_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.qc_residuals(nearest(spark, sf_dir, sparse=True), ["recording_id"], 3 * HOUR)


@query(sql("samples sparse", "SELECT recording_id, role, count(t) AS n_present, count(*) FILTER (t IS NULL) AS n_missing, count(t) - count(DISTINCT t) AS n_duplicate, min(t) AS t_min, max(t) AS t_max FROM sparse GROUP BY ALL"))
def timeline_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.timeline_summary(fx.sparse_samples(spark, sf_dir), ["recording_id", "role"])


_OVERLAP = """
e AS (SELECT recording_id, role, min(t) AS a, max(t) AS b FROM sparse GROUP BY ALL),
o AS (SELECT recording_id, count(*) AS n_streams, count(*) FILTER (a IS NULL) AS n_empty, max(a) AS s, min(b) AS e FROM e GROUP BY 1)
"""


@query(sql("samples sparse", _OVERLAP + """SELECT recording_id, n_streams, n_empty, CASE WHEN n_empty = 0 AND s <= e THEN s END AS start, CASE WHEN n_empty = 0 AND s <= e THEN e END AS "end" FROM o"""))
def overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.overlap(fx.sparse_samples(spark, sf_dir), ["recording_id"], "role")


@query(sql("samples sparse", _OVERLAP + """SELECT recording_id, n_streams, CASE WHEN n_empty = 0 AND s <= e THEN e - s END AS length,
CASE WHEN n_streams < 2 OR n_empty > 0 THEN 'INSUFFICIENT_DATA' WHEN s <= e AND e - s >= 2419200000000 THEN 'PASS' ELSE 'FAIL' END AS status FROM o"""))  # fmt: skip
def qc_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.qc_overlap(fx.sparse_samples(spark, sf_dir), ["recording_id"], "role", 28 * 24 * HOUR)


@query(sql("samples", """SELECT kind, count(val) AS n, round(min(val), 6) AS min, round(quantile_cont(val, 0.5), 6) AS p50, round(quantile_cont(val, 0.95), 6) AS p95, round(quantile_cont(val, 0.99), 6) AS p99, round(max(val), 6) AS max FROM samples GROUP BY 1"""))
def distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = align.distribution(fx.samples(spark, sf_dir), ["kind"], "val")
    return out.withColumns({c: F.round(c, 6) for c in ("min", "p50", "p95", "p99", "max")})


@query(sql("samples sparse", """
SELECT recording_id, role, count(step) AS n_gaps, count(*) FILTER (step = 0) AS n_duplicate, max(step) AS max_gap, count(*) FILTER (step > 259200000000) AS n_excessive,
  CASE WHEN count(step) = 0 THEN 'INSUFFICIENT_DATA' WHEN count(*) FILTER (step > 259200000000) > 0 THEN 'FAIL' ELSE 'PASS' END AS status
FROM (SELECT recording_id, role, t - lag(t) OVER (PARTITION BY recording_id, role ORDER BY t, idx) AS step FROM sparse WHERE t IS NOT NULL) GROUP BY ALL"""))  # fmt: skip
def qc_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.qc_gaps(fx.sparse_samples(spark, sf_dir), ["recording_id", "role"], 72 * HOUR)


@query(sql("samples", """
b AS (SELECT *, (t - min(t) OVER (PARTITION BY recording_id, role)) // 86400000000 AS bin FROM samples),
r AS (SELECT *, row_number() OVER (PARTITION BY recording_id, role, bin ORDER BY t, idx) AS n, row_number() OVER (PARTITION BY recording_id, role ORDER BY t DESC, idx DESC) AS m FROM b)
SELECT recording_id, role, t, idx, round(val, 6) AS val, kind FROM r WHERE n = 1 OR m = 1"""))  # fmt: skip
def thin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.thin(fx.samples(spark, sf_dir), ["recording_id", "role"], 24 * HOUR).withColumn("val", F.round("val", 6))


@query(sql("samples", """
p AS (SELECT recording_id, role, idx, t // 1000000 AS t, t // 1000000 + CAST(floor(val) AS BIGINT) // 40 AS other FROM samples),
r AS (SELECT *, t - lag(t) OVER w AS dt, other - lag(other) OVER w AS dother, other - t AS "offset", t - min(t) OVER (PARTITION BY recording_id, role) AS x FROM p WINDOW w AS (PARTITION BY recording_id, role ORDER BY t, idx))
SELECT recording_id, role, count(dt) AS n_steps, count(*) FILTER (dother = 0 AND dt > 0) AS n_plateaus, count(*) FILTER (abs(dother - dt) > 1) AS n_jumps, min("offset") AS offset_min, max("offset") AS offset_max,
  round(regr_slope(CAST("offset" AS DOUBLE), CAST(x AS DOUBLE)) * 1e6, 4) AS drift_ppm,
  round(stddev_pop(CAST("offset" AS DOUBLE)) * sqrt(greatest(1 - coalesce(regr_r2(CAST("offset" AS DOUBLE), CAST(x AS DOUBLE)), 0), 0)), 4) AS residual_rms FROM r GROUP BY ALL"""))  # fmt: skip
def clock_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fx.samples(spark, sf_dir).selectExpr("recording_id", "role", "idx", "t div 1000000 AS t", "t div 1000000 + cast(floor(val) AS bigint) div 40 AS other")
    return align.clock_stats(s, ["recording_id", "role"], 1).withColumns({c: F.round(c, 4) for c in ("drift_ppm", "residual_rms")})
