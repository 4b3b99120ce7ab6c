"""Events judged by what was tracked in them and around them: metrics of both scopes, recommendation, gate and ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import settled
from .intervals import dealt, extents
from .qc import failed_rules

ROLES, SIDES, SCOPES = (0, 1), ("left", "right"), ("event", "context")


def at_frames(asked: DataFrame, frames: DataFrame, by: list[str], keep: bool = False) -> DataFrame:
    """Rows of asked (by, frame and more) with what frames, one row per by and frame, has there; those without a frame go, or
    with keep stay with nulls.

    The same as a join, which would shuffle both sides by frame; where both are dealt by `by` already, nothing is shuffled.
    """
    key = [*by, "frame"]
    side = {n: F.struct(*(c for c in df.columns if c not in key)) for n, df in (("asked", asked), ("seen", frames))}
    rows = frames.select(*key, side["seen"].alias("seen")).unionByName(asked.select(*key, side["asked"].alias("asked")), allowMissingColumns=True)
    rows = rows.withColumn("seen", F.first("seen", ignorenulls=True).over(Window.partitionBy(*key))).filter("asked IS NOT NULL" if keep else "asked IS NOT NULL AND seen IS NOT NULL")
    return rows.select(*key, "asked.*", "seen.*")


def pooled_percentile(parts: list[Column], q: float) -> Column:
    """The exact, linear percentile of a group's known values in several columns; all values of a group are in memory."""
    values = F.array_sort(F.flatten(F.collect_list(F.array_compact(F.array(*parts)))))
    place = (F.size(values) - 1) * F.lit(q)
    low, high = F.floor(place), F.ceil(place)
    at = lambda k: F.get(values, k.cast("int"))
    return F.when(low == high, at(low)).otherwise((high - place) * at(low) + (place - low) * at(high))


def scope_metrics(frames: DataFrame, distances: DataFrame, events: DataFrame, by: list[str], around: int | Column, fast: float) -> DataFrame:
    """One row per event, with metrics of its own frames (event_*) and of those `around` it too (context_*): a number of frames
    or a column of the events. Frames are those that the recording has.

    frames, a row per role (0, 1) and frame: verified, map_conf, pose, residual, left and right (a sure hand is there), their
    left_conf and right_conf, speed (the faster wrist's, null where not evaluated). distances: frame and distance between the
    two people's nearest wrists. Per scope: verified (all frames of both), pose_0, pose_1, any_0, any_1 (a hand), both_any,
    all_four (shares of frames), map_conf (the lesser median of the two), conf (median of all sure hands), residual_p95,
    distance (median), n_fast, fast_rate (the greater share among the two of evaluated speeds over `fast`).
    """
    events = dealt(events, by)  # frames that are dealt by series so stay where they are: nothing below shuffles them
    wanted = ["verified", "map_conf", "pose", "residual", "left", "right", "left_conf", "right_conf", "speed"]
    both = frames.select(*by, "frame", "role", *wanted).withColumn("n", F.lit(1)).unionByName(distances.select(*by, "frame", "distance"), allowMissingColumns=True)
    wide = both.groupBy(*by, "frame").agg(*(F.max(F.when(F.col("role") == r, F.col(c))).alias(f"{c}_{r}") for c in wanted for r in ROLES), F.max("distance").alias("distance"), F.count("n").alias("n")).filter("n > 0").drop("n")
    scopes = F.explode(F.array(
        F.struct(F.lit("event").alias("scope"), F.col("start_frame").alias("a"), F.col("end_frame").alias("b")),
        F.struct(F.lit("context").alias("scope"), F.greatest(F.col("start_frame") - around, F.lit(0)).alias("a"), F.least(F.col("end_frame") + around, F.col("last")).alias("b")),
    ))
    key = [*by, "iv", "scope"]
    asked = events.join(extents(frames, by), by).filter("start_frame <= last").select(*by, "iv", scopes.alias("s")).select(*by, "iv", "s.scope", F.explode(F.sequence("s.a", "s.b")).alias("frame"))
    rows = at_frames(asked, wide, by)
    hands = {r: [F.coalesce(F.col(f"{s}_{r}"), F.lit(False)) for s in SIDES] for r in ROLES}
    share = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("double"))
    either = {r: hands[r][0] | hands[r][1] for r in ROLES}
    out = rows.groupBy(*key).agg(
        F.min(F.coalesce(F.col("verified_0") & F.col("verified_1"), F.lit(False))).alias("verified"), *(share(F.col(f"pose_{r}")).alias(f"pose_{r}") for r in ROLES), *(share(either[r]).alias(f"any_{r}") for r in ROLES),
        share(either[0] & either[1]).alias("both_any"), share(hands[0][0] & hands[0][1] & hands[1][0] & hands[1][1]).alias("all_four"),
        F.least(F.percentile("map_conf_0", F.lit(0.5)), F.percentile("map_conf_1", F.lit(0.5))).alias("map_conf"), F.percentile("distance", F.lit(0.5)).alias("distance"),
        *(F.count_if(F.col(f"speed_{r}") > fast).alias(f"fast_{r}") for r in ROLES), *(F.count(f"speed_{r}").alias(f"steps_{r}") for r in ROLES),
        pooled_percentile([F.when(hands[r][k], F.col(f"{s}_conf_{r}")) for r in ROLES for k, s in enumerate(SIDES)], 0.5).alias("conf"), pooled_percentile([F.col(f"residual_{r}") for r in ROLES], 0.95).alias("residual_p95"),
    )
    rate = lambda r: F.coalesce(F.try_divide(f"fast_{r}", f"steps_{r}"), F.lit(0.0))
    out = out.withColumns({"n_fast": F.col("fast_0") + F.col("fast_1"), "fast_rate": F.greatest(rate(0), rate(1))}).drop("fast_0", "fast_1", "steps_0", "steps_1")
    names = [c for c in out.columns if c not in key]
    sides = out.groupBy(*by, "iv").agg(*(F.max(F.when(F.col("scope") == s, F.struct(*names))).alias(s) for s in SCOPES)).dropna(subset=list(SCOPES))
    return sides.select(*by, "iv", *(F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in SCOPES for c in names))


def recommendation(full_hands: float = 0.90, context_hands: float = 0.75) -> Column:
    """exclude, caution or acceptable with the first reason that holds, as a struct (status, reason), of `scope_metrics`."""
    pose = {s: F.least(f"{s}_pose_0", f"{s}_pose_1") for s in SCOPES}
    rules = [
        (~F.col("context_verified"), "exclude", "context_not_verified"), (pose["event"] < 1, "exclude", "event_pose_incomplete"), (F.col("event_all_four") < full_hands, "exclude", "event_hands_missing"),
        (F.col("event_all_four") < 1, "caution", "event_hands_incomplete"), ((F.col("context_all_four") < context_hands) | (pose["context"] < 1), "caution", "context_gaps"),
        ((F.col("event_n_fast") > 0) | (F.col("context_n_fast") > 0), "caution", "fast_wrists"),
    ]
    out = F.struct(F.lit("acceptable").alias("status"), F.lit("complete").alias("reason"))
    for rule, status, reason in reversed(rules):
        out = F.when(rule, F.struct(F.lit(status).alias("status"), F.lit(reason).alias("reason"))).otherwise(out)
    return out


def demo_failures(least_pose: float = 0.95, least_hand: float = 0.80, least_conf: float = 0.90) -> Column:
    """All rules of the demo gate that an event fails, by name and in order, as one string; empty if it passes."""
    rules = {}
    for s in SCOPES:
        rules[f"{s}_not_verified"] = ~F.col(f"{s}_verified")
        rules |= {f"{s}_pose_{r}": F.col(f"{s}_pose_{r}") < least_pose for r in ROLES}
        rules[f"{s}_fast_wrists"] = F.col(f"{s}_n_fast") > 0
    rules |= {f"event_hand_{r}": F.col(f"event_any_{r}") < least_hand for r in ROLES}
    rules["event_conf"] = F.coalesce(F.col("event_conf"), F.lit(-1.0)) < least_conf
    return failed_rules(rules)


def rank_handovers(metrics: DataFrame, by: list[str], digits: int = 9) -> DataFrame:
    """rank from the best event on, and selected: the first whose context is verified, if any.

    Verified contexts come first; then more frames with a hand of both, with all four hands, the lesser pose share, the
    lesser mapping confidence, the hands' confidence, the smaller residual, the nearer wrists, fewer fast steps; then the id.
    What is not known comes last.
    """
    up = lambda c: F.desc_nulls_last(F.round(c, digits))
    down = lambda c: F.asc_nulls_last(F.round(c, digits))
    order = [
        F.desc("context_verified"), up("event_both_any"), up("event_all_four"), up(F.least("event_pose_0", "event_pose_1")), up("event_map_conf"), up("event_conf"), down("event_residual_p95"),
        down("event_distance"), down("event_fast_rate"), F.asc("iv"),
    ]
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return metrics.withColumn("rank", rank).withColumn("selected", (F.col("rank") == 1) & F.col("context_verified"))


def plan_contexts(events: DataFrame, frames: DataFrame, by: list[str], contexts: tuple[int, ...]) -> DataFrame:
    """Events with around (the first of `contexts` whose frames are all verified for both), clip_start, clip_end, and stage and
    reason where there is none: annotation_bounds, event_mapping or context_mapping.

    The next unverified frame is known at each frame from one window, so that a context costs an equality join however long
    it is. A frame that a role has no row for is unverified.
    """
    both = frames.groupBy(*by, "frame").agg((F.count_if("verified") < len(ROLES)).alias("bad"))
    ahead = Window.partitionBy(*by).orderBy(F.desc("frame")).rowsBetween(Window.unboundedPreceding, 0)
    coming = both.select(*by, F.col("frame").alias("_at"), F.min(F.when(F.col("bad"), F.col("frame"))).over(ahead).alias("_bad"))
    out = dealt(events, by).join(extents(frames, by), by, "left")
    inside = F.coalesce((F.col("start_frame") >= 0) & (F.col("start_frame") <= F.col("end_frame")) & (F.col("end_frame") <= F.col("last")), F.lit(False))
    out = out.withColumn("_inside", inside)
    for c in (0, *contexts):
        out = out.withColumns({f"_from{c}": F.greatest(F.col("start_frame") - c, F.lit(0)), f"_to{c}": F.least(F.col("end_frame") + c, F.col("last"))})
        out = out.withColumn("_at", F.when(F.col("_inside"), F.col(f"_from{c}"))).join(coming, [*by, "_at"], "left").drop("_at")
        out = out.withColumn(f"_bad{c}", F.when(F.col("_bad") <= F.col(f"_to{c}"), F.col("_bad"))).drop("_bad")
    pick = lambda value: F.coalesce(*(F.when(F.col(f"_bad{c}").isNull(), value(c)) for c in contexts))
    place = lambda c: F.concat(F.lit("frame "), F.col(f"_bad{c}").cast("string"), F.lit(" is not verified"))
    found = F.when(~F.col("_inside"), F.struct(F.lit("annotation_bounds").alias("stage"), F.lit("outside the recording").alias("reason")))
    found = found.when(F.col("_bad0").isNotNull(), F.struct(F.lit("event_mapping").alias("stage"), place(0).alias("reason")))
    found = found.when(pick(F.lit).isNull(), F.struct(F.lit("context_mapping").alias("stage"), place(contexts[-1]).alias("reason"))).alias("r")
    ok = F.col("r").isNull()
    out = out.select(*events.columns, pick(F.lit).alias("around"), pick(lambda c: F.col(f"_from{c}")).alias("clip_start"), pick(lambda c: F.col(f"_to{c}")).alias("clip_end"), found)
    return out.select(*events.columns, *(F.when(ok, F.col(c)).alias(c) for c in ("around", "clip_start", "clip_end")), "r.stage", "r.reason")


def assess_events(events: DataFrame, frames: DataFrame, distances: DataFrame, recordings: DataFrame, by: list[str], contexts: tuple[int, ...] = (120, 90), fast: float = 5.0) -> DataFrame:
    """Every event once: status accepted or rejected, and the stage and reason of a rejection; of accepted ones also around,
    clip_start, clip_end, caution (true: keep with caution), detail and rank within the recording, the best first.

    Stages in order: `plan_contexts`; derived_validation (recordings: by, valid, problem); tracking_qc (`recommendation` says
    exclude). Metrics are only computed for events that reach them. frames and distances as for `scope_metrics`.
    """
    planned = plan_contexts(events.select(*by, "iv", "start_frame", "end_frame"), frames, by, contexts)
    checked = planned.join(recordings.select(*by, "valid", "problem"), by, "left")
    invalid = F.col("stage").isNull() & ~F.coalesce("valid", F.lit(False))
    checked = checked.withColumns({"reason": F.when(invalid, F.coalesce("problem", F.lit("not validated"))).otherwise(F.col("reason")), "stage": F.when(invalid, "derived_validation").otherwise(F.col("stage"))}).drop("valid", "problem")
    checked = settled(checked)
    metrics = scope_metrics(frames, distances, checked.filter("stage IS NULL"), by, F.col("around"), fast).withColumn("r", recommendation())
    metrics = settled(metrics)
    ranks = rank_handovers(metrics.filter("r.status <> 'exclude'"), by).select(*by, "iv", "rank")
    judged = checked.join(metrics.select(*by, "iv", "r"), [*by, "iv"], "left").join(ranks, [*by, "iv"], "left")
    stage = F.when(F.col("stage").isNull() & (F.col("r.status") == "exclude"), "tracking_qc").otherwise(F.col("stage"))
    reason = F.when(F.col("stage").isNull() & (F.col("r.status") == "exclude"), F.col("r.reason")).otherwise(F.col("reason"))
    judged = judged.select("*", stage.alias("s"), reason.alias("why"))
    ok = F.col("s").isNull()
    return judged.select(
        *by, "iv", F.when(ok, "accepted").otherwise("rejected").alias("status"), F.col("s").alias("stage"), F.col("why").alias("reason"), *(F.when(ok, F.col(c)).alias(c) for c in ("around", "clip_start", "clip_end")),
        F.when(ok, F.col("r.status") == "caution").alias("caution"), F.when(ok, F.col("r.reason")).alias("detail"), "rank",
    )


def recall_by(events: DataFrame, keys: list[str], peak: str, threshold: Column) -> DataFrame:
    """Share of events whose peak reaches the threshold, with their number, by each key alone and over all."""
    hit = F.avg((F.col(peak) >= threshold).cast("double"))
    cols = [F.col(k) for k in keys]
    return events.groupingSets([*([c] for c in cols), []], *cols).agg(F.count(F.lit(1)).alias("n"), hit.alias("recall"))


def contact_report(held: DataFrame, by: list[str], hand: str) -> DataFrame:
    """Frames, the share of them with something held in each hand (a map) and in any, and for how many frames each object was
    held. held: frame, a hand, object (null: nothing)."""
    n = held.groupBy(*by).agg(F.count_distinct("frame").alias("n_frames"), F.count_distinct(F.when(F.col("object").isNotNull(), F.col("frame"))).alias("n_any"))
    hands = held.groupBy(*by, hand).agg((F.count("object") / F.count(F.lit(1))).alias("share")).groupBy(*by).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col(hand).cast("string"), "share")))).alias("by_hand"))
    objects = held.filter("object IS NOT NULL").groupBy(*by, "object").agg(F.count(F.lit(1)).alias("k")).groupBy(*by).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("object").cast("string"), "k")))).alias("objects"))
    return n.join(hands, by).join(objects, by, "left").withColumn("any", F.col("n_any") / F.col("n_frames")).drop("n_any")
