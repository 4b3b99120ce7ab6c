"""Features and labels along a series of frames. Windows look back only, unless the docstring says otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .graph import settled
from .intervals import extents


def over(by: list[str], order: str | Column = "frame") -> WindowSpec:
    return Window.partitionBy(*by).orderBy(order)


def speed(df: DataFrame, by: list[str], cols: list[str], fps: float = 1.0, first: str = "zero") -> DataFrame:
    """Length of the step from the frame before, per second; null where either end is missing. The first frame has 0, or with
    first="copy" the second frame's."""
    w = over(by)
    step = F.sqrt(sum(((F.col(c) - F.lag(c).over(w)) * (F.col(c) - F.lag(c).over(w)) for c in cols[1:]), (F.col(cols[0]) - F.lag(cols[0]).over(w)) * (F.col(cols[0]) - F.lag(cols[0]).over(w)))) * fps
    out = df.withColumn("_n", F.row_number().over(w)).withColumn("speed", step)
    start = F.lit(0.0) if first == "zero" else F.lead("speed").over(w)
    return out.withColumn("speed", F.when(F.col("_n") == 1, F.when(F.col(cols[0]).isNotNull(), start)).otherwise(F.col("speed"))).drop("_n")


def smooth(df: DataFrame, by: list[str], col: str, k: int, zero_pad: bool = False) -> DataFrame:
    """Centred moving average over k frames (looks ahead): of the values there are, or of all k with zeros for the rest."""
    w = over(by).rowsBetween(-(k // 2), k // 2)
    return df.withColumn("smoothed", F.sum(F.coalesce(F.col(col), F.lit(0.0))).over(w) / k if zero_pad else F.avg(col).over(w))


def causal_stats(df: DataFrame, by: list[str], col: str, width: int) -> DataFrame:
    """Trailing mean, max, min and population deviation over `width` frames; before the first frame its value is repeated.

    Nulls count as 0, as a feature table has them.
    """
    w = over(by).rowsBetween(-(width - 1), 0)
    x = F.coalesce(F.col(col), F.lit(0.0))
    first = F.first(x).over(over(by).rowsBetween(Window.unboundedPreceding, 0))
    out = df.withColumns({"_n": F.count(F.lit(1)).over(w), "_f": first, "_s": F.sum(x).over(w), "_q": F.sum(x * x).over(w), f"{col}_max": F.max(x).over(w), f"{col}_min": F.min(x).over(w)})
    pad = width - F.col("_n")
    mean = (F.col("_s") + pad * F.col("_f")) / width
    square = (F.col("_q") + pad * F.col("_f") * F.col("_f")) / width
    return out.withColumns({f"{col}_mean": mean, f"{col}_std": F.sqrt(F.greatest(square - mean * mean, F.lit(0.0)))}).drop("_n", "_f", "_s", "_q")


def onset_within(df: DataFrame, by: list[str], onset: str, horizons: list[int]) -> DataFrame:
    """For every horizon h whether an onset lies in the h frames after this one (strictly later; a label looks ahead)."""
    return df.withColumns({f"onset_{h}": F.coalesce(F.max(F.col(onset).cast("int")).over(over(by).rowsBetween(1, h)) == 1, F.lit(False)) for h in horizons})


def time_to_next(df: DataFrame, by: list[str], onset: str, most: int) -> DataFrame:
    """Frames to the next later onset, at most `most`; `most` when there is none."""
    following = F.min(F.when(F.col(onset), F.col("frame"))).over(over(by, F.desc("frame")).rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("to_next", F.least(F.coalesce(following - F.col("frame"), F.lit(most)), F.lit(most)))


def time_to_end(grid: DataFrame, intervals: DataFrame, by: list[str]) -> DataFrame:
    """Frames to the end of the interval that holds the frame; of several the one that starts last (then the larger id)."""
    ends = intervals.join(extents(grid, by), by).withColumns({"a": F.greatest("start_frame", F.lit(0)), "b": F.least("end_frame", "last")}).filter("a <= b")
    held = ends.withColumn("frame", F.explode(F.sequence("a", "b"))).groupBy(*by, "frame").agg(F.max(F.struct("start_frame", "iv", "end_frame")).alias("i"))
    return grid.join(held, [*by, "frame"], "left").withColumn("to_end", F.col("i.end_frame") - F.col("frame")).drop("i")


def deltas(df: DataFrame, by: list[str], cols: list[str]) -> DataFrame:
    """First differences; 0 in the first frame, null where a value is missing."""
    w = over(by)
    return df.withColumns({f"d_{c}": F.when(F.row_number().over(w) == 1, F.lit(0.0)).otherwise(F.col(c) - F.lag(c).over(w)) for c in cols})


def forecast_targets(df: DataFrame, by: list[str], col: str, ahead: int, back: int) -> DataFrame:
    """The value `ahead` frames later with the guesses of no motion and of constant velocity over the last `back` frames;
    null where an end is missing."""
    w = over(by)
    drift = F.col(col) + (F.col(col) - F.lag(col, back).over(w)) / back * ahead
    return df.withColumns({"target": F.when(F.col(col).isNotNull(), F.lead(col, ahead).over(w)), "still": F.col(col), "drift": drift})


def circular_shift(df: DataFrame, by: list[str], key: Column, least: int, cols: list[str]) -> DataFrame:
    """A control: every series' columns turned by a shift of its own, at least `least` frames either way, taken from the
    SHA-256 of its key. A series has the frames from 0 to its last one; one of fewer than 2 * least frames stays as it is."""
    rows = df.withColumn("_n", F.max("frame").over(Window.partitionBy(*by)) + 1)
    drawn = F.conv(F.substring(F.sha2(key.cast("string"), 256), 1, 8), 16, 10).cast("long")
    shift = F.when(F.col("_n") >= 2 * least, F.try_mod(drawn, F.col("_n") - 2 * least + 1) + least).otherwise(0)
    moved = rows.select(*by, F.pmod(F.col("frame") + shift, F.col("_n")).cast("int").alias("frame"), *(F.col(c).alias(f"shifted_{c}") for c in cols))
    return df.join(moved, [*by, "frame"], "left")


def reach_onset(series: DataFrame, events: DataFrame, by: list[str], lead: int, base: int, run: int, factor: float, floor: float) -> DataFrame:
    """Per event the first frame of the `lead` frames before it at which speed stays over mean + factor * deviation + floor of
    the `base` frames before those, for at least `run` frames; null if none does."""
    asked = events.select(*by, "iv", F.col("start_frame").alias("at"), F.explode(F.sequence(F.col("start_frame") - lead - base, F.col("start_frame"))).alias("frame"))
    rows = asked.join(series, [*by, "frame"])
    early = F.col("frame") < F.col("at") - lead
    whole = Window.partitionBy(*by, "iv")
    limit = F.avg(F.when(early, F.col("speed"))).over(whole) + factor * F.stddev_pop(F.when(early, F.col("speed"))).over(whole) + floor
    hits = rows.withColumn("limit", limit).filter(~early & (F.col("speed") > F.col("limit")))
    w = Window.partitionBy(*by, "iv").orderBy("frame")
    hits = hits.withColumn("run", F.col("frame") - F.row_number().over(w))
    first = hits.groupBy(*by, "iv", "run").agg(F.min("frame").alias("onset"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= run).groupBy(*by, "iv").agg(F.min("onset").alias("onset"))
    return events.select(*by, "iv", "start_frame").join(first, [*by, "iv"], "left")


def majority_vote(df: DataFrame, by: list[str], label: str, half: int) -> DataFrame:
    """The commonest label of the frames within `half` (looks ahead); of equally common ones the frame's own, else the one
    seen first."""
    seen = df.select(*by, F.explode(F.sequence(F.col("frame") - half, F.col("frame") + half)).alias("at"), F.col("frame").alias("seen"), F.col(label).alias("label"))
    counts = seen.filter("label IS NOT NULL").groupBy(*by, F.col("at").alias("frame"), "label").agg(F.count(F.lit(1)).alias("n"), F.min("seen").alias("first"))
    votes = df.select(*by, "frame", F.col(label).alias("own")).join(counts, [*by, "frame"], "left")
    best = votes.groupBy(*by, "frame").agg(F.min(F.struct(-F.col("n"), ~F.coalesce(F.col("label") == F.col("own"), F.lit(False)), "first", "label")).alias("v"))
    return df.join(best.select(*by, "frame", F.col("v.label").alias("voted")), [*by, "frame"], "left")


def stages(grid: DataFrame, events: DataFrame, by: list[str], reach: int, retract: int) -> DataFrame:
    """Sub-stages of an event: approach before its transfer frame, transfer at it, retract after; the event with the least id
    where two meet."""
    inside = events.withColumn("frame", F.explode(F.sequence(F.col("start_frame") - reach, F.col("end_frame") + retract))).join(extents(grid, by), by).filter("frame BETWEEN 0 AND last").drop("last")
    stage = F.when(F.col("frame") < F.col("start_frame"), "approach").when(F.col("frame") <= F.col("end_frame"), "transfer").otherwise("retract")
    first = inside.withColumn("stage", stage).groupBy(*by, "frame").agg(F.min(F.struct("iv", "stage")).alias("s"))
    return grid.join(first, [*by, "frame"], "left").withColumns({"iv": F.col("s.iv"), "stage": F.coalesce("s.stage", F.lit("none"))}).drop("s")


def cross_correlation(df: DataFrame, by: list[str], a: str, b: str, lag: int, least: int) -> DataFrame:
    """The best Pearson correlation of a(frame) with b(frame + lag) over lags -lag..lag, on frames where both are present.

    Lags with fewer than `least` frames or a flat side don't count; of equally good ones the smallest shift, then the negative
    one. Series without any are null.
    """
    left = df.filter(F.col(a).isNotNull()).select(*by, "frame", F.col(a).alias("x"))
    right = df.filter(F.col(b).isNotNull()).select(*by, F.col("frame").alias("f"), F.col(b).alias("y"), F.explode(F.sequence(F.lit(-lag), F.lit(lag))).alias("lag")).withColumn("frame", F.col("f") - F.col("lag"))
    flat = (F.stddev_pop("x") > 1e-9) & (F.stddev_pop("y") > 1e-9)
    per = left.join(right, [*by, "frame"]).groupBy(*by, "lag").agg(F.when((F.count(F.lit(1)) >= least) & flat, F.try_divide(F.covar_pop("x", "y"), F.stddev_pop("x") * F.stddev_pop("y"))).alias("r"))
    best = per.filter("r IS NOT NULL").groupBy(*by).agg(F.min(F.struct((-F.round("r", 9)).alias("m"), F.abs("lag").alias("s"), F.col("lag").alias("lag"))).alias("k"))
    return df.select(*by).distinct().join(best, by, "left").select(*by, (-F.col("k.m")).alias("r"), F.col("k.lag").alias("lag"))


def onset_envelope(df: DataFrame, by: list[str], energy: str, silence: float) -> DataFrame:
    """Positive rise of log(1 + energy) from the frame before; 0 in silence and in the first frame."""
    x = F.log1p(F.coalesce(F.col(energy), F.lit(0.0)))
    rise = F.greatest(x - F.lag(x).over(over(by)), F.lit(0.0))
    return df.withColumn("envelope", F.when(F.coalesce(F.col(energy), F.lit(0.0)) < silence, 0.0).otherwise(F.coalesce(rise, F.lit(0.0))))


def fold_rank(df: DataFrame, by: list[str], score: str) -> DataFrame:
    """Average ranks (from 1) of the scores within a fold."""
    w = Window.partitionBy(*by).orderBy(score)
    return df.withColumn("rank", F.rank().over(w) + (F.count(F.lit(1)).over(Window.partitionBy(*by, score)) - 1) / 2)


def eval_rows(df: DataFrame, warm: int, stride: int) -> DataFrame:
    """Every stride-th frame from frame `warm` on."""
    return df.filter((F.col("frame") >= warm) & ((F.col("frame") - warm) % stride == 0))


def keyframes(df: DataFrame, by: list[str], step: int, most: int) -> DataFrame:
    """Every step-th frame, the first `most` of them in each series."""
    return df.filter((F.col("frame") % step == 0) & (F.col("frame") / step < most)).select(*by, "frame")


def repeat_skip(df: DataFrame, by: list[str], source: str) -> DataFrame:
    """repeated: the same source frame as in the row before; skipped: how many source frames were left out between them."""
    step = F.col(source) - F.lag(source).over(over(by))
    return df.withColumns({"repeated": F.coalesce(step == 0, F.lit(False)), "skipped": F.greatest(F.coalesce(step - 1, F.lit(0)), F.lit(0))})


def tail_run(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Length of the run of equal values with which each series ends."""
    w = Window.partitionBy(*by).orderBy(F.desc("frame"))
    rows = df.withColumn("changed", ~F.col(value).eqNullSafe(F.lag(value).over(w)) & (F.row_number().over(w) > 1))
    rows = rows.withColumn("run", F.sum(F.col("changed").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*by).agg(F.count_if(F.col("run") == 0).alias("tail"))


def trailing_count(df: DataFrame, by: list[str], col: str, width: int) -> DataFrame:
    """Sum over the last `width` frames, this one included."""
    return df.withColumn("trailing", F.sum(F.coalesce(F.col(col), F.lit(0))).over(over(by).rowsBetween(-(width - 1), 0)))


def nonmonotone(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """conflict: the value is below an earlier one or above a later one of its series; nulls never are."""
    w = over(by)
    high = F.max(value).over(w.rowsBetween(Window.unboundedPreceding, -1))
    low = F.min(value).over(over(by, F.desc("frame")).rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("conflict", F.coalesce(F.col(value) < high, F.lit(False)) | F.coalesce(F.col(value) > low, F.lit(False)))


def reject_nonmonotone(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """The value without conflicts, and the round in which a row lost it (null where it kept it): of two rows in a row that have
    a value and whose values fall, both lose it, until no two do.

    Each round is written before the next, and only series that still had a conflict go through it; a round takes at least
    two values from such a series, so that its values bound the rounds.
    """
    w = over(by)
    rows = settled(df.filter(F.col(value).isNotNull()).select(*by, "frame", F.col(value).alias("v"), F.lit(None).cast("int").alias("round")))
    k = 0
    while True:
        k += 1
        left = rows.filter("round IS NULL")
        some = F.coalesce(F.lag("v").over(w) > F.col("v"), F.lit(False)) | F.coalesce(F.lead("v").over(w) < F.col("v"), F.lit(False))
        lost = settled(left.withColumn("bad", some).filter("bad").select(*by, "frame", F.lit(k).alias("now")))
        if lost.isEmpty():
            break
        rows = settled(rows.join(lost, [*by, "frame"], "left").select(*by, "frame", "v", F.coalesce("round", "now").alias("round")))
    out = df.join(rows.drop("v"), [*by, "frame"], "left")
    return out.withColumn(value, F.when(F.col("round").isNull(), F.col(value)))
