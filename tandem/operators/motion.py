"""Offsets between signals and turning of sensors. Lags are bounded: a signal meets the other at each lag by equality."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tandem.functions import geometry as g


def clipped(df: DataFrame, by: list[str], value: str, q: float = 0.98) -> DataFrame:
    """The value clipped at the q-th quantile of what lies over its median."""
    middle = df.groupBy(*by).agg(F.percentile(value, F.lit(0.5)).alias("_m"))
    high = df.join(middle, by).filter(F.col(value) > F.col("_m")).groupBy(*by).agg(F.percentile(value, F.lit(q)).alias("_h"))
    return df.join(high, by, "left").withColumn(value, F.least(value, F.coalesce("_h", F.col(value)))).drop("_h")


def lag_scores(ref: DataFrame, sig: DataFrame, by: list[str], value: str, lag: int, least: int) -> DataFrame:
    """by, lag, score: the correlation of ref(frame + lag) with sig(frame), times the root of the overlap; lags with fewer than
    `least` common frames or a flat side are left out."""
    moved = sig.filter(F.col(value).isNotNull()).select(*by, F.col(value).alias("y"), "frame", F.explode(F.sequence(F.lit(-lag), F.lit(lag))).alias("lag")).withColumn("frame", F.col("frame") + F.col("lag"))
    both = ref.filter(F.col(value).isNotNull()).select(*by, "frame", F.col(value).alias("x")).join(moved, [*by, "frame"])
    spread = F.stddev_pop("x") * F.stddev_pop("y")
    per = both.groupBy(*by, "lag").agg(F.count(F.lit(1)).alias("n"), F.when(spread > 1e-12, F.try_divide(F.covar_pop("x", "y"), spread)).alias("r"))
    return per.filter((F.col("n") >= least) & F.col("r").isNotNull()).withColumn("score", F.col("r") * F.sqrt("n"))


def audio_offset(ref: DataFrame, sig: DataFrame, by: list[str], value: str, lag: int, least: int = 20, apart: int = 5) -> DataFrame:
    """The offset of sig against ref per group: lag of the best score (of equal ones the least), refined by a parabola through
    the scores at the very next lags, by half a frame at most and only where these bend downwards; robust z of the peak (by
    median and absolute deviation) and the ratio of the best score more than `apart` lags away to it (null without one).
    Groups with fewer than three lags, or whose scores don't spread, have no row."""
    s = lag_scores(clipped(ref, by, value), clipped(sig, by, value), by, value, lag, least)
    peak = s.groupBy(*by).agg(F.max(F.struct(F.round("score", 9).alias("s"), (-F.col("lag")).alias("first"), "lag", "score", "r")).alias("p"), F.percentile("score", F.lit(0.5)).alias("median"), F.count(F.lit(1)).alias("n_lags"))
    rows = s.join(peak, by)
    beside = lambda d: F.max(F.when(F.col("lag") == F.col("p.lag") + d, F.col("score")))
    rest = rows.groupBy(*by).agg(
        F.percentile(F.abs(F.col("score") - F.col("median")), F.lit(0.5)).alias("mad"), F.max(F.when(F.abs(F.col("lag") - F.col("p.lag")) > apart, F.col("score"))).alias("second"),
        beside(-1).alias("before"), beside(1).alias("after"),
    )
    bend = F.col("before") - 2 * F.col("p.score") + F.col("after")
    shift = F.greatest(F.least(F.try_divide(0.5 * (F.col("before") - F.col("after")), bend), F.lit(0.5)), F.lit(-0.5))
    out = peak.join(rest, by).filter("n_lags >= 3 AND mad > 0")
    return out.select(
        *by, F.col("p.lag").alias("lag"), (F.col("p.lag") + F.when(bend < 0, shift).otherwise(0.0)).alias("offset"), F.col("p.r").alias("r"),
        ((F.col("p.score") - F.col("median")) / (1.4826 * F.col("mad"))).alias("z"), F.try_divide("second", F.col("p.score")).alias("second_ratio"),
    )


def offset_drift(ref: DataFrame, sig: DataFrame, by: list[str], value: str, width: int, lag: int, tolerance: float, least_z: float = 4.0) -> DataFrame:
    """Offset and drift per group: audio_offset in windows of `width`, the median slope of all pairs of windows (Theil-Sen),
    then least squares on the windows within `tolerance` of that line. n_windows, n_inliers, offset (at frame 0), drift."""
    part = lambda df: df.withColumn("win", F.floor(F.col("frame") / width))
    near = part(sig)
    wide = part(ref).select("*", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))).alias("d")).withColumn("win", F.col("win") + F.col("d")).drop("d")
    found = audio_offset(wide, near, [*by, "win"], value, lag).filter(F.col("z") >= least_z).withColumn("t", (F.col("win") + 0.5) * width)
    a, b = found.select(*by, F.col("t").alias("t1"), F.col("offset").alias("o1")), found.select(*by, F.col("t").alias("t2"), F.col("offset").alias("o2"))
    slope = a.join(b, by).filter("t1 < t2").groupBy(*by).agg(F.percentile((F.col("o2") - F.col("o1")) / (F.col("t2") - F.col("t1")), F.lit(0.5)).alias("k"))
    base = found.join(slope, by).withColumn("rest", F.col("offset") - F.col("k") * F.col("t"))
    middle = base.groupBy(*by).agg(F.percentile("rest", F.lit(0.5)).alias("c"), F.count(F.lit(1)).alias("n_windows"))
    good = base.join(middle, by).filter(F.abs(F.col("rest") - F.col("c")) <= tolerance)
    return good.groupBy(*by, "n_windows").agg(F.count(F.lit(1)).alias("n_inliers"), F.regr_intercept("offset", "t").alias("offset"), F.regr_slope("offset", "t").alias("drift"))


def drift_factor(ref: DataFrame, sig: DataFrame, by: list[str], value: str, width: int, lag: int, local: int, apart: int) -> DataFrame:
    """k, the factor for sig's times, from its offset in a window of `width` frames at the start and at the end of what both
    have: 1 + the change of the offset by the frames between them.

    A first lag, of at most `lag`, comes from the signals' heads (lag + 2 windows); around it the windows' offsets are looked
    for within `local`. Groups whose windows are less than `apart` frames apart have k null and the reason too_short.
    """
    head = lag + 2 * width
    whole = audio_offset(ref.filter(F.col("frame") < head), sig.filter(F.col("frame") < head), by, value, lag).select(*by, F.col("lag").alias("global"))
    ends = ref.groupBy(*by).agg(F.max("frame").alias("r")).join(sig.groupBy(*by).agg(F.max("frame").alias("s")), by).join(whole, by)
    ends = ends.select(*by, "global", F.greatest(F.lit(0), -F.col("global")).alias("a"), (F.least(F.col("s"), F.col("r") - F.col("global")) + 1 - width).alias("b"))
    windows = ends.select(*by, "global", F.posexplode(F.array("a", "b")).alias("win", "at"))
    part = sig.join(windows, by).filter((F.col("frame") >= F.col("at")) & (F.col("frame") < F.col("at") + width)).select(*by, "win", "frame", value)
    near = ref.withColumn("frame", F.col("frame")).join(windows, by).withColumn("frame", F.col("frame") - F.col("global"))
    near = near.filter((F.col("frame") >= F.col("at") - local) & (F.col("frame") < F.col("at") + width + local)).select(*by, "win", "frame", value)
    found = audio_offset(near, part, [*by, "win"], value, local, least=width // 2)
    side = lambda k: F.max(F.when(F.col("win") == k, F.col("offset")))
    out = ends.join(found.groupBy(*by).agg(side(0).alias("first"), side(1).alias("last")), by, "left")
    span = F.col("b") - F.col("a")
    ok = span >= apart
    return out.select(
        *by, (F.col("global") + F.col("first")).alias("offset_start"), (F.col("global") + F.col("last")).alias("offset_end"), span.alias("span"),
        F.when(ok, 1 + (F.col("last") - F.col("first")) / span).alias("k"), F.when(~ok, "too_short").alias("reason"),
    )


def angular_path(df: DataFrame, by: list[str], most_gap: float) -> DataFrame:
    """path, the turning angle (radians) added up along a series of quaternions (t, qx..qw), and valid, the time added up.

    Samples that repeat the one before are no new measurement: the turn between two distinct samples is spread evenly over
    the time between them. A gap over most_gap adds no valid time, and a turn whose time holds one adds no angle.
    """
    q = ["qx", "qy", "qz", "qw"]
    w = Window.partitionBy(*by).orderBy("t")
    upto, after = w.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*by).orderBy(F.desc("place")).rowsBetween(Window.unboundedPreceding, 0)
    rows = df.withColumns({f"p{c}": F.lag(c).over(w) for c in q} | {"place": F.row_number().over(w), "dt": F.col("t") - F.lag("t").over(w), "left": F.lead("t").over(w)})
    other = F.lit(False)
    for c in q:
        other = other | (F.col(c) != F.col(f"p{c}"))
    rows = rows.withColumn("knot", F.col("dt").isNull() | other | F.col("left").isNull())
    rows = rows.withColumns({"gaps": F.sum(F.coalesce((F.col("dt") > most_gap).cast("int"), F.lit(0))).over(w), "valid": F.sum(F.when(F.col("dt") <= most_gap, F.col("dt")).otherwise(0)).over(w)})
    rows = rows.withColumn("k", F.when(F.col("knot"), F.struct("t", *q, "gaps"))).withColumn("last", F.last("k", ignorenulls=True).over(upto))
    along = F.abs(g.dot(g.cols(*q), [F.col(f"last.{c}") for c in q]))
    turn = F.when(F.col("knot") & (F.col("gaps") == F.col("last.gaps")), 2 * F.acos(F.least(along, F.lit(1.0)))).otherwise(0.0)
    rows = rows.withColumn("path", F.sum(turn).over(w))
    # between knots the path grows evenly to the next one
    rows = rows.withColumn("next", F.last(F.when(F.col("knot"), F.struct("t", "path")), ignorenulls=True).over(after))
    share = F.try_divide(F.col("t") - F.col("last.t"), F.col("next.t") - F.col("last.t"))
    even = F.col("path") + (F.col("next.path") - F.col("path")) * share
    return rows.withColumn("path", F.when(F.col("knot"), F.col("path")).otherwise(even)).select(*df.columns, "path", "valid")


def interval_speed(paths: DataFrame, intervals: DataFrame, by: list[str], least: float = 0.9) -> DataFrame:
    """The mean turning speed over intervals (id, start, end) of a series with `angular_path`; null where they reach beyond it
    or less than `least` of their time is valid."""
    ends = intervals.select(*by, "id", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("start").alias("t")), F.struct(F.lit(1).alias("side"), F.col("end").alias("t")))).alias("e")).select(*by, "id", "e.side", "e.t")
    known = paths.select(*by, "t", F.struct("t", "path", "valid").alias("s"))
    w, later = Window.partitionBy(*by).orderBy("t"), Window.partitionBy(*by).orderBy(F.desc("t"))
    both = ends.withColumn("asked", F.lit(True)).unionByName(known, allowMissingColumns=True)
    both = both.withColumns({"a": F.last("s", ignorenulls=True).over(w.rangeBetween(Window.unboundedPreceding, 0)), "b": F.last("s", ignorenulls=True).over(later.rangeBetween(Window.unboundedPreceding, 0))}).filter("asked")
    share = F.coalesce(F.try_divide(F.col("t") - F.col("a.t"), F.col("b.t") - F.col("a.t")), F.lit(0.0))
    at = lambda c: F.col(f"a.{c}") + (F.col(f"b.{c}") - F.col(f"a.{c}")) * share
    both = both.withColumns({"path": at("path"), "valid": at("valid")})
    side = lambda c, k: F.max(F.when(F.col("side") == k, F.col(c)))
    out = both.groupBy(*by, "id").agg(*(side(c, k).alias(f"{c}{k}") for c in ("t", "path", "valid") for k in (0, 1)))
    time = F.col("t1") - F.col("t0")
    ok = (F.col("valid1") - F.col("valid0")) / time >= least
    return out.select(*by, "id", F.when(ok, (F.col("path1") - F.col("path0")) / time).alias("speed"))


def slerp_at(samples: DataFrame, times: DataFrame, by: list[str], most_gap: float) -> DataFrame:
    """The quaternion at each time between its bracketing samples; null outside them and across gaps over most_gap."""
    q = ["qx", "qy", "qz", "qw"]
    s = samples.select(*by, "t", F.struct("t", *q).alias("s"))
    both = times.select(*by, "t").withColumn("asked", F.lit(True)).unionByName(s, allowMissingColumns=True)
    w, later = Window.partitionBy(*by).orderBy("t"), Window.partitionBy(*by).orderBy(F.desc("t"))
    out = both.withColumns({"a": F.last("s", ignorenulls=True).over(w.rangeBetween(Window.unboundedPreceding, 0)), "b": F.last("s", ignorenulls=True).over(later.rangeBetween(Window.unboundedPreceding, 0))}).filter("asked")
    share = F.coalesce(F.try_divide(F.col("t") - F.col("a.t"), F.col("b.t") - F.col("a.t")), F.lit(0.0))
    raw = g.dot([F.col(f"a.{c}") for c in q], [F.col(f"b.{c}") for c in q])
    sign = F.when(raw < 0, -1.0).otherwise(1.0)
    angle = F.acos(F.least(F.abs(raw), F.lit(1.0)))
    flat = angle < 1e-6
    wa = F.when(flat, 1 - share).otherwise(F.try_divide(F.sin((1 - share) * angle), F.sin(angle)))
    wb = F.when(flat, share).otherwise(F.try_divide(F.sin(share * angle), F.sin(angle))) * sign
    ok = F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("b.t") - F.col("a.t") <= most_gap)
    return out.select(*by, "t", *(F.when(ok, wa * F.col(f"a.{c}") + wb * F.col(f"b.{c}")).alias(c) for c in q))


def elbow_angle(df: DataFrame, upper: list[str], lower: list[str]) -> DataFrame:
    """flexion in degrees between two arm segments' direction columns."""
    return df.withColumn("flexion", g.angle_degrees(g.cols(*upper), g.cols(*lower)))
