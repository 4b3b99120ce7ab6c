"""Intervals, events and sessions. Overlaps are found by equality on frames or on coarse time buckets, never by comparing all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dealt(df: DataFrame, by: list[str]) -> DataFrame:
    """df in as many partitions by series as the session shuffles to. They are not joined to fewer where what is dealt is small
    against what is made of it, as events are against frames."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def extents(grid: DataFrame, by: list[str]) -> DataFrame:
    """last: the last frame of every series."""
    return grid.groupBy(*by).agg(F.max("frame").alias("last"))


def interval_mask(grid: DataFrame, intervals: DataFrame, by: list[str]) -> DataFrame:
    """Grid rows with active: inside an interval, both ends included. What an interval has outside the grid's frames is left."""
    ends = intervals.join(extents(grid, by), by).withColumns({"a": F.greatest("start_frame", F.lit(0)), "b": F.least("end_frame", "last")})
    inside = ends.filter("a <= b").select(*by, F.explode(F.sequence("a", "b")).alias("frame")).distinct().withColumn("active", F.lit(True))
    return grid.join(inside, [*by, "frame"], "left").withColumn("active", F.coalesce("active", F.lit(False)))


def merge(intervals: DataFrame, by: list[str], gap: int = 0) -> DataFrame:
    """Overlapping intervals, and those at most `gap` apart, joined into one: start, end, n."""
    w = Window.partitionBy(*by).orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = intervals.withColumn("new", (reach.isNull() | (F.col("start") > reach + gap)).cast("int"))
    rows = rows.withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*by, "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("n")).drop("run")


def runs(series: DataFrame, by: list[str], flag: str, least: int = 1, bridge: int = 0) -> DataFrame:
    """Runs of frames with a true flag: start, end (included), n. Runs at most `bridge` frames apart are joined before those
    shorter than `least` are dropped; a missing frame or flag ends a run."""
    w = Window.partitionBy(*by).orderBy("frame")
    hits = series.filter(F.col(flag)).withColumn("gap", F.col("frame") - F.lag("frame").over(w))
    hits = hits.withColumn("run", F.sum((F.coalesce("gap", F.lit(0)) > bridge + 1).cast("int")).over(w))
    out = hits.groupBy(*by, "run").agg(F.min("frame").alias("start"), F.max("frame").alias("end"), F.count(F.lit(1)).alias("n"))
    return out.filter(F.col("end") - F.col("start") + 1 >= least).drop("run")


def context_windows(events: DataFrame, status: DataFrame, by: list[str], wide: int, narrow: int) -> DataFrame:
    """A window of `wide` frames around every event, clamped to the frames that its recording has a status for; `narrow` where the wide one holds a bad frame; the
    event is rejected if that holds one too. status: frame and bad per grid frame. Bad frames are counted by prefix sums."""
    w = Window.partitionBy(*by).orderBy("frame").rowsBetween(Window.unboundedPreceding, 0)
    sums = status.select(*by, "frame", F.sum(F.col("bad").cast("long")).over(w).alias("upto"))

    def bad(df: DataFrame, size: int, name: str) -> DataFrame:
        low, high = F.greatest(F.col("start_frame") - size, F.lit(0)), F.least(F.col("end_frame") + size, F.col("_last"))
        df = df.withColumns({f"{name}_from": low, f"{name}_to": high})
        ends = sums.select(*by, F.col("frame").alias(f"{name}_to"), F.col("upto").alias(f"{name}_b"))
        starts = sums.select(*by, (F.col("frame") + 1).alias(f"{name}_from"), F.col("upto").alias(f"{name}_a"))
        df = df.join(ends, [*by, f"{name}_to"], "left").join(starts, [*by, f"{name}_from"], "left")
        return df.withColumn(f"{name}_bad", F.coalesce(f"{name}_b", F.lit(0)) - F.coalesce(f"{name}_a", F.lit(0)))

    out = bad(bad(events.join(extents(status, by).withColumnRenamed("last", "_last"), by), wide, "wide"), narrow, "narrow")
    decision = F.when(F.col("wide_bad") == 0, "wide").when(F.col("narrow_bad") == 0, "narrow").otherwise("rejected")
    pick = lambda end: F.when(F.col("wide_bad") == 0, F.col(f"wide_{end}")).when(F.col("narrow_bad") == 0, F.col(f"narrow_{end}"))
    return out.select(*events.columns, decision.alias("context"), pick("from").alias("context_from"), pick("to").alias("context_to"), "wide_bad", "narrow_bad")


def excerpts(events: DataFrame, grid: DataFrame, by: list[str], size: int) -> DataFrame:
    """by, iv, excerpt_from and excerpt_to (both included, `size` apart): centred on the event, moved inside its recording's
    frames; longer events are cut at both ends alike."""
    start = F.col("start_frame") - F.floor((size - (F.col("end_frame") - F.col("start_frame"))) / 2)
    start = F.greatest(F.lit(0), F.least(start, F.col("last") - size)).cast("int")
    return events.join(extents(grid, by), by).select(*by, "iv", start.alias("excerpt_from"), (start + size).alias("excerpt_to"))


def _buckets(start: Column, end: Column, width: int) -> Column:
    return F.explode(F.sequence(F.floor(start / width), F.floor(end / width)))


def overlapping(a: DataFrame, b: DataFrame, by: list[str], slack: int, width: int) -> DataFrame:
    """Pairs (a_id, b_id) of intervals that overlap or whose starts are at most `slack` apart. a, b: id, start, end.

    Both sides are dealt to buckets of `width`, so that the join is by equality; a pair that shares several counts once.
    """
    x = a.select(*by, F.col("id").alias("a_id"), F.col("start").alias("a0"), F.col("end").alias("a1")).withColumn("bucket", _buckets(F.col("a0") - slack, F.greatest("a1", F.col("a0") + slack), width))
    y = b.select(*by, F.col("id").alias("b_id"), F.col("start").alias("b0"), F.col("end").alias("b1")).withColumn("bucket", _buckets(F.col("b0"), F.col("b1"), width))
    near = (F.col("a0") <= F.col("b1")) & (F.col("b0") <= F.col("a1")) | (F.abs(F.col("a0") - F.col("b0")) <= slack)
    return x.join(y, [*by, "bucket"]).filter(near).select(*by, "a_id", "b_id").distinct()


def match_events(proposals: DataFrame, truth: DataFrame, by: list[str], slack: int, width: int = 16) -> DataFrame:
    """Per group n_proposals, n_truth, hits on either side, precision and recall (null without any)."""
    pairs = overlapping(proposals, truth, by, slack, width)
    hit = lambda df, side, name: df.join(pairs.select(*by, F.col(side).alias("id")).distinct().withColumn("hit", F.lit(1)), [*by, "id"], "left").groupBy(*by).agg(F.count(F.lit(1)).alias(f"n_{name}"), F.count("hit").alias(f"{name}_hit"))
    out = hit(proposals, "a_id", "proposals").join(hit(truth, "b_id", "truth"), by, "full")
    out = out.na.fill(0, ["n_proposals", "proposals_hit", "n_truth", "truth_hit"])
    return out.withColumns({"precision": F.try_divide("proposals_hit", "n_proposals"), "recall": F.try_divide("truth_hit", "n_truth")})


def match_sessions(sessions: DataFrame, reference: DataFrame, by: list[str], width: int = 30 * 86_400) -> DataFrame:
    """The reference session with the longest positive overlap of every session; of equal ones the earlier. Of sessions that
    chose the same one, the earliest claims it (claimed). Both sides meet in time buckets of `width`."""
    side = lambda df, n: df.select(*by, F.col("id").alias(f"{n}_id"), F.col("start").alias(f"{n}0"), F.col("end").alias(f"{n}1")).withColumn("bucket", _buckets(F.col(f"{n}0"), F.col(f"{n}1"), width))
    met = side(sessions, "a").join(side(reference, "b"), [*by, "bucket"])
    # a pair counts in the first bucket that both are in
    met = met.filter(F.col("bucket") == F.floor(F.greatest("a0", "b0") / width)).drop("bucket")
    pairs = met.withColumn("shared", F.least("a1", "b1") - F.greatest("a0", "b0")).filter("shared > 0")
    best = Window.partitionBy(*by, "a_id").orderBy(F.desc("shared"), "b0", "b_id")
    claim = Window.partitionBy(*by, "b_id").orderBy("a0", "a_id")
    return pairs.withColumn("n", F.row_number().over(best)).filter("n = 1").withColumn("claimed", F.row_number().over(claim) == 1).select(*by, "a_id", "b_id", "shared", "claimed")


def match_by_index(sessions: DataFrame, reference: DataFrame, matched: DataFrame, by: list[str], group: str) -> DataFrame:
    """Claimed matches; and, for a `group` (a camera, say) of which none was claimed and which has as many sessions as there
    are references, its sessions and the references one by one in order of start. by_index tells the latter."""
    claimed = matched.filter("claimed").select(*by, "a_id", "b_id")
    own = sessions.select(*by, group, "id", "start")
    hit = claimed.join(own.select(*by, group, F.col("id").alias("a_id")), [*by, "a_id"]).select(*by, group).distinct()
    number = lambda df, keys: df.withColumn("k", F.row_number().over(Window.partitionBy(*keys).orderBy(F.asc_nulls_last("start"), "id")))
    sizes = own.groupBy(*by, group).agg(F.count(F.lit(1)).alias("n")).join(reference.groupBy(*by).agg(F.count(F.lit(1)).alias("n_ref")), by).filter("n = n_ref")
    rest = sizes.join(hit, [*by, group], "left_anti").select(*by, group)
    pairs = number(own.join(rest, [*by, group]), [*by, group]).select(*by, "k", F.col("id").alias("a_id")).join(number(reference, by).select(*by, "k", F.col("id").alias("b_id")), [*by, "k"])
    return claimed.withColumn("by_index", F.lit(False)).unionByName(pairs.select(*by, "a_id", "b_id", F.lit(True).alias("by_index")))


def sessions(chunks: DataFrame, by: list[str], gap: int) -> DataFrame:
    """Chunks with session (from 0): a new one where a chunk starts more than `gap` after all before it ended. Chunks without
    a start never open one; they come last and belong to the last."""
    w = Window.partitionBy(*by).orderBy(F.asc_nulls_last("start"), "chunk")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.coalesce(F.col("start") - reach > gap, F.lit(False))
    return chunks.withColumn("opens", opens.cast("int")).withColumn("session", F.sum("opens").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("opens")


def hold_spans(events: DataFrame, by: list[str]) -> DataFrame:
    """Spans from a grasp to what follows it for the same person and object: a release (closed) or a new grasp (re-grasp).
    At equal times a release comes before a grasp; a grasp that nothing follows stays open, without an end."""
    w = Window.partitionBy(*by).orderBy("t", F.when(F.col("kind") == "release", 0).otherwise(1), "event_id")
    rows = events.withColumns({"next_kind": F.lead("kind").over(w), "end": F.lead("t").over(w)}).filter("kind = 'grasp'")
    return rows.select(*by, F.col("t").alias("start"), "end", F.coalesce(F.when(F.col("next_kind") == "release", "closed").when(F.col("next_kind") == "grasp", "regrasp"), F.lit("open")).alias("state"))


def chatter_free(events: DataFrame, by: list[str], least: int) -> DataFrame:
    """Hold spans that lasted at least `least`."""
    return hold_spans(events, by).filter(F.col("end") - F.col("start") >= least)
