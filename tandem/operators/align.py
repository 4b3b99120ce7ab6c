"""Alignment of series that run on different clocks.

A series is the rows of equal `by` columns; its times are integers. As-of joins put queries and samples into one sort per
series and look both ways from each query: one shuffle on the series' key, no pair is ever formed that is not the answer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _events(queries: DataFrame, samples: DataFrame, by: list[str], keep: list[str]) -> DataFrame:
    """Queries and the first sample of every time, in one table."""
    firsts = samples.filter("t IS NOT NULL").groupBy(*by, "t").agg(F.min(F.struct("idx", *keep)).alias("s"))
    firsts = firsts.withColumn("s", F.struct(F.col("t").alias("t"), "s.*"))
    rest = [c for c in queries.columns if c not in by and c != "t"]
    asked = queries.withColumn("q", F.struct(*rest)).select(*by, "t", "q")
    return asked.unionByName(firsts, allowMissingColumns=True)


def asof_nearest(queries: DataFrame, samples: DataFrame, by: list[str], max_gap: int, keep: list[str] | None = None) -> DataFrame:
    """The nearest sample in time of every query, with its residual and a status.

    Of equally near samples the earlier one, of equal times the one with the least idx. max_gap is inclusive; a sample
    beyond it stays in the row with its residual. status: matched, gap_exceeded, no_samples (the series has none),
    missing_query (null time). Adds sample_t, sample_idx, the kept columns as sample_<name>, residual (sample - query), gap.
    """
    keep = keep or []
    w = Window.partitionBy(*by).orderBy("t")
    later = Window.partitionBy(*by).orderBy(F.desc("t"))  # a frame that reaches to the end is added up anew for each row
    back = F.last("s", ignorenulls=True).over(w.rangeBetween(Window.unboundedPreceding, 0))
    ahead = F.last("s", ignorenulls=True).over(later.rangeBetween(Window.unboundedPreceding, 0))
    known = queries.filter("t IS NOT NULL")
    rest = [c for c in queries.columns if c not in by and c != "t"]
    best = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col(c)["t"] - F.col("t")).alias("gap"), F.col(c).alias("s")))
    found = (
        _events(known, samples, by, keep)
        .select("*", back.alias("back"), ahead.alias("ahead"))
        .filter("q IS NOT NULL")
        .withColumn("best", F.least(best("back"), best("ahead")))
        .select(*by, "t", "q.*", F.col("best.s").alias("s"))
    )
    out = found.unionByName(queries.filter("t IS NULL").select(*by, "t", *rest), allowMissingColumns=True)
    residual = F.col("s.t") - F.col("t")
    status = F.when(F.col("t").isNull(), "missing_query").when(F.col("s").isNull(), "no_samples").when(F.abs(residual) <= max_gap, "matched").otherwise("gap_exceeded")
    return out.select(*by, "t", *rest, F.col("s.t").alias("sample_t"), F.col("s.idx").alias("sample_idx"), *(F.col(f"s.{c}").alias(f"sample_{c}") for c in keep), residual.alias("residual"), F.abs(residual).alias("gap"), status.alias("status"))


def asof_backward(queries: DataFrame, events: DataFrame, by: list[str], keep: list[str] | None = None, max_age: int | None = None) -> DataFrame:
    """The last event at or before every query: event_t, event_idx, the kept columns and age, clipped at max_age; null before
    the first event. Of equal times the one with the least idx."""
    keep = keep or []
    w = Window.partitionBy(*by).orderBy("t").rangeBetween(Window.unboundedPreceding, 0)
    rest = [c for c in queries.columns if c not in by and c != "t"]
    found = _events(queries.filter("t IS NOT NULL"), events, by, keep).withColumn("e", F.last("s", ignorenulls=True).over(w)).filter("q IS NOT NULL")
    age = F.col("t") - F.col("e.t")
    return found.select(*by, "t", "q.*", F.col("e.t").alias("event_t"), F.col("e.idx").alias("event_idx"), *(F.col(f"e.{c}").alias(f"event_{c}") for c in keep), (age if max_age is None else F.least(age, F.lit(max_age))).alias("age")).select(*by, "t", *rest, "event_t", "event_idx", *(f"event_{c}" for c in keep), "age")


def asof_grid(grid: DataFrame, frames: DataFrame, by: list[str], tolerance: int) -> DataFrame:
    """The nearest frame of every grid time; covered tells whether it is within the tolerance."""
    out = asof_nearest(grid, frames, by, tolerance)
    return out.withColumn("covered", F.col("status") == "matched")


def asof_period(queries: DataFrame, samples: DataFrame, by: list[str], factor: float = 0.75) -> DataFrame:
    """The nearest sample within `factor` median sample periods of its series; further ones are null, never held over gaps."""
    w = Window.partitionBy(*by).orderBy("t", "idx")
    step = samples.filter("t IS NOT NULL").withColumn("step", F.col("t") - F.lag("t").over(w)).groupBy(*by).agg(F.percentile("step", F.lit(0.5)).alias("period"))
    out = asof_nearest(queries, samples, by, 1 << 62).join(step, by, "left")
    near = F.col("gap") <= F.col("period") * factor
    return out.withColumn("sample_idx", F.when(near, F.col("sample_idx"))).withColumn("near", F.coalesce(near, F.lit(False))).drop("status", "sample_t")


def clock_lookup(queries: DataFrame, pairs: DataFrame, by: list[str]) -> DataFrame:
    """The recorded other clock's time at exactly the query's time; the first pair where one time has several."""
    first = pairs.groupBy(*by, "t").agg(F.min(F.struct("idx", "other")).alias("p"))
    return queries.join(first, [*by, "t"], "left").withColumn("other", F.col("p.other")).drop("p")


def convert_clock(df: DataFrame, maps: DataFrame, to: str) -> DataFrame:
    """t on the clock `to` through the one direct mapping (src, dst, scale, offset): status ok, identity, no_mapping, ambiguous.

    Times that can't be converted are null. Mappings go one way; a mapping table is a small dimension, joined by the source.
    """
    direct = maps.filter(F.col("dst") == to).groupBy("src").agg(F.count(F.lit(1)).alias("n"), F.first("scale").alias("scale"), F.first("offset").alias("offset"))
    out = df.join(direct, df["clock"] == direct["src"], "left")
    status = F.when(F.col("clock") == to, "identity").when(F.col("n").isNull(), "no_mapping").when(F.col("n") > 1, "ambiguous").otherwise("ok")
    moved = F.round(F.col("t") * F.col("scale")).cast("long") + F.col("offset")
    t = F.when(status == "identity", F.col("t")).when(status == "ok", moved)
    return out.select(*df.columns, t.alias("t_to"), status.alias("clock_status"))


def borrow_nearest(df: DataFrame, by: list[str], value: str, max_gap: int) -> DataFrame:
    """Rows without a value take that of the nearest row with one, at most max_gap away; of two, the earlier one's."""
    own = F.when(F.col(value).isNotNull(), F.struct(F.col("t").alias("t"), F.col(value).alias("v")))
    w, later = Window.partitionBy(*by).orderBy("t"), Window.partitionBy(*by).orderBy(F.desc("t"))
    back = F.last(own, ignorenulls=True).over(w.rangeBetween(Window.unboundedPreceding, 0))
    ahead = F.last(own, ignorenulls=True).over(later.rangeBetween(Window.unboundedPreceding, 0))
    near = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col(c)["t"] - F.col("t")).alias("gap"), F.col(c).alias("s")))
    out = df.select("*", back.alias("b"), ahead.alias("a")).withColumn("n", F.least(near("b"), near("a")))
    ok = F.col("n.gap") <= max_gap
    return out.select(*df.columns, F.when(ok, F.col("n.s.v")).alias("borrowed"), F.when(ok, F.col("n.gap")).alias("borrow_gap"))


def match_summary(matches: DataFrame, by: list[str]) -> DataFrame:
    """Per series: queries, accepted, coverage, rejected, missing, and the gaps' distribution over all and accepted matches."""
    ok, gap = F.col("status") == "matched", F.col("gap").cast("double")
    return matches.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_queries"), F.count_if(ok).alias("n_accepted"), (F.count_if(ok) / F.count(F.lit(1))).alias("coverage"),
        F.count_if(F.col("status") == "gap_exceeded").alias("n_rejected"), F.count_if(F.col("status") == "missing_query").alias("n_missing"),
        F.percentile(gap, F.lit(0.5)).alias("gap_p50"), F.percentile(gap, F.lit(0.95)).alias("gap_p95"), F.max(gap).alias("gap_max"),
        F.percentile(F.when(ok, gap), F.lit(0.5)).alias("accepted_p50"), F.max(F.when(ok, gap)).alias("accepted_max"),
    )


def qc_residuals(matches: DataFrame, by: list[str], limit: int) -> DataFrame:
    """Per series PASS, FAIL (a gap over the limit, or rejected, or a missing query) or INSUFFICIENT_DATA (nothing to compare)."""
    excessive = F.count_if((F.col("status") == "matched") & (F.col("gap") > limit))
    rejected, missing = F.count_if(F.col("status") == "gap_exceeded"), F.count_if(F.col("status") == "missing_query")
    compared = F.count("gap")
    out = matches.groupBy(*by).agg(compared.alias("n_compared"), excessive.alias("n_excessive"), rejected.alias("n_rejected"), missing.alias("n_missing"), F.max("gap").alias("max_gap"))
    status = F.when(F.col("n_compared") == 0, "INSUFFICIENT_DATA").when((F.col("n_excessive") + F.col("n_rejected") + F.col("n_missing")) > 0, "FAIL").otherwise("PASS")
    return out.withColumn("status", status)


def timeline_summary(samples: DataFrame, by: list[str]) -> DataFrame:
    """Per series: present, missing and duplicate times, and the extent."""
    return samples.groupBy(*by).agg(
        F.count("t").alias("n_present"), F.count_if(F.col("t").isNull()).alias("n_missing"), (F.count("t") - F.count_distinct("t")).alias("n_duplicate"), F.min("t").alias("t_min"), F.max("t").alias("t_max")
    )


def overlap(samples: DataFrame, group: list[str], stream: str) -> DataFrame:
    """Per group the common extent of its streams (ends included): null when one is empty or they don't meet."""
    extents = samples.groupBy(*group, stream).agg(F.min("t").alias("a"), F.max("t").alias("b"))
    out = extents.groupBy(*group).agg(F.count(F.lit(1)).alias("n_streams"), F.count_if(F.col("a").isNull()).alias("n_empty"), F.max("a").alias("start"), F.min("b").alias("end"))
    ok = (F.col("n_empty") == 0) & (F.col("start") <= F.col("end"))
    return out.select(*group, "n_streams", "n_empty", F.when(ok, F.col("start")).alias("start"), F.when(ok, F.col("end")).alias("end"))


def qc_overlap(samples: DataFrame, group: list[str], stream: str, least: int) -> DataFrame:
    """PASS if the streams overlap for at least `least`, else FAIL; INSUFFICIENT_DATA with fewer than two streams or an empty one."""
    out = overlap(samples, group, stream)
    length = F.col("end") - F.col("start")
    status = F.when((F.col("n_streams") < 2) | (F.col("n_empty") > 0), "INSUFFICIENT_DATA").when(F.coalesce(length, F.lit(-1)) >= least, "PASS").otherwise("FAIL")
    return out.select(*group, "n_streams", length.alias("length"), status.alias("status"))


def distribution(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """count, min, p50, p95, p99, max of the finite values; nulls when there are none."""
    x = F.when(~F.isnan(F.col(value)) & (F.abs(F.col(value)) < float("inf")), F.col(value).cast("double"))
    return df.groupBy(*by).agg(
        F.count(x).alias("n"), F.min(x).alias("min"), *(F.percentile(x, F.lit(p)).alias(f"p{round(100 * p)}") for p in (0.5, 0.95, 0.99)), F.max(x).alias("max")
    )


def qc_gaps(samples: DataFrame, by: list[str], most: int) -> DataFrame:
    """Consecutive gaps per series (a repeated time is a gap of 0): how many are over `most`, and the status."""
    w = Window.partitionBy(*by).orderBy("t", "idx")
    steps = samples.filter("t IS NOT NULL").withColumn("step", F.col("t") - F.lag("t").over(w))
    out = steps.groupBy(*by).agg(F.count("step").alias("n_gaps"), F.count_if(F.col("step") == 0).alias("n_duplicate"), F.max("step").alias("max_gap"), F.count_if(F.col("step") > most).alias("n_excessive"))
    return out.withColumn("status", F.when(F.col("n_gaps") == 0, "INSUFFICIENT_DATA").when(F.col("n_excessive") > 0, "FAIL").otherwise("PASS"))


def thin(samples: DataFrame, by: list[str], width: int) -> DataFrame:
    """The first sample of every bin of `width` from the series' start, and its last sample."""
    whole = Window.partitionBy(*by)
    w = Window.partitionBy(*by, "bin").orderBy("t", "idx")
    last = Window.partitionBy(*by).orderBy(F.desc("t"), F.desc("idx"))
    known = samples.filter("t IS NOT NULL").withColumn("bin", F.floor((F.col("t") - F.min("t").over(whole)) / width))
    return known.withColumn("n", F.row_number().over(w)).withColumn("m", F.row_number().over(last)).filter("n = 1 OR m = 1").select(*samples.columns)


def clock_stats(pairs: DataFrame, by: list[str], jump: int) -> DataFrame:
    """Paired clocks (t, other) per series: steps, plateaus (no step of the other clock), jumps, the offsets' range, and the
    drift in parts per million by least squares on centred times, with the root mean square of what it leaves."""
    w = Window.partitionBy(*by).orderBy("t", "idx")
    whole = Window.partitionBy(*by)
    rows = pairs.withColumns({"dt": F.col("t") - F.lag("t").over(w), "do": F.col("other") - F.lag("other").over(w), "offset": F.col("other") - F.col("t")})
    rows = rows.withColumns({"x": (F.col("t") - F.min("t").over(whole)).cast("double"), "y": (F.col("offset") - F.min("offset").over(whole)).cast("double")})
    return rows.groupBy(*by).agg(
        F.count("dt").alias("n_steps"), F.count_if((F.col("do") == 0) & (F.col("dt") > 0)).alias("n_plateaus"), F.count_if(F.abs(F.col("do") - F.col("dt")) > jump).alias("n_jumps"),
        F.min("offset").alias("offset_min"), F.max("offset").alias("offset_max"), (F.regr_slope("y", "x") * 1e6).alias("drift_ppm"),
        (F.stddev_pop("y") * F.sqrt(F.greatest(1 - F.coalesce(F.regr_r2("y", "x"), F.lit(0.0)), F.lit(0.0)))).alias("residual_rms"),
    )

