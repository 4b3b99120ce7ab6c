"""Checks of what was recorded: continuity of trajectories, plausible hands, frames with pose and hands under their evidence,
image correspondences. Nothing is bridged, repaired or upgraded; every limit is a parameter."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tandem.functions import geometry as g

from .align import asof_nearest

POSE = ["x", "y", "z", "qx", "qy", "qz", "qw"]


def audit_trajectory(poses: DataFrame, by: list[str], tolerance: float = 1e-6, listed: int = 10) -> DataFrame:
    """A whole trajectory's counts and ranges. poses: t, idx, utc (-1: unknown) and a pose.

    n, n_duplicate_times (rows beyond the first of a time), first_t, last_t, n_no_utc, max_norm_error of the quaternions,
    n_invalid (a number is missing or not finite, or a quaternion's length is off 1 by more than `tolerance`; none is
    repaired), the idx of the first `listed` of these, and first_position and last_position (x, y, z).
    """
    off = F.abs(g.norm(g.cols(*POSE[3:])) - 1)
    known = F.lit(True)
    for c in POSE:
        known = known & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    rows = poses.withColumns({"off": off, "bad": ~F.coalesce(known & (off <= tolerance), F.lit(False))})
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy(*by, "bad").orderBy("t", "idx")))
    place = F.struct("t", "idx", *POSE[:3])
    out = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) - F.count_distinct("t")).alias("n_duplicate_times"), F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.count_if(F.col("utc") == -1).alias("n_no_utc"),
        F.max("off").alias("max_norm_error"), F.count_if("bad").alias("n_invalid"), F.sort_array(F.collect_list(F.when(F.col("bad") & (F.col("k") <= listed), F.struct("t", "idx")))).alias("invalid"),
        F.min(place).alias("first_position"), F.max(place).alias("last_position"),
    )
    return out.withColumn("invalid", F.col("invalid.idx"))


def continuity(samples: DataFrame, by: list[str], max_speed: float, max_turn: float, second: int = 1_000_000) -> DataFrame:
    """The interval that ends at each sample but a series' first: idx, speed, turn (radians), both a second, and reason.

    samples: idx (their order), t (`second` to a second), clock, world (the coordinate frame) and a pose; the pose or t may
    be missing. reason: missing (an end is), clock, frame, time (not after the one before) where nothing is measured,
    speed where a limit is passed, else null.
    """
    w = Window.partitionBy(*by).orderBy("idx")
    names = [*POSE, "t", "clock", "world"]
    rows = samples.withColumns({f"p_{c}": F.lag(c).over(w) for c in names}).withColumn("n", F.row_number().over(w)).filter("n > 1")
    now, before = g.cols(*POSE[:3]), g.cols(*(f"p_{c}" for c in POSE[:3]))
    seconds = (F.col("t") - F.col("p_t")) / second
    there = F.lit(True)
    for c in (*POSE, "t"):
        there = there & F.col(c).isNotNull() & F.col(f"p_{c}").isNotNull()
    why = F.when(~there, "missing").when(F.col("clock") != F.col("p_clock"), "clock").when(F.col("world") != F.col("p_world"), "frame").when(F.col("t") <= F.col("p_t"), "time")
    rows = rows.withColumn("reason", why)
    ok = F.col("reason").isNull()
    rows = rows.withColumns({"speed": F.when(ok, g.norm(g.minus(now, before)) / seconds), "turn": F.when(ok, g.quaternion_angle(g.cols(*(f"p_{c}" for c in POSE[3:])), g.cols(*POSE[3:])) / seconds)})
    fast = (F.col("speed") > max_speed) | (F.col("turn") > max_turn)
    return rows.select(*by, "idx", "speed", "turn", F.coalesce("reason", F.when(fast, F.lit("speed"))).alias("reason"))


def qc_continuity(samples: DataFrame, by: list[str], max_speed: float, max_turn: float, second: int = 1_000_000) -> DataFrame:
    """Per series: n_samples, n_missing, n_checked, max_speed, max_turn, n_fast, n_invalid (intervals of clock, frame or time)
    and status: FAIL with any of the last two, INSUFFICIENT_DATA with a missing sample or nothing checked, else PASS."""
    gone = F.col("t").isNull()
    for c in POSE:
        gone = gone | F.col(c).isNull()
    counts = samples.groupBy(*by).agg(F.count(F.lit(1)).alias("n_samples"), F.count_if(gone).alias("n_missing"))
    found = continuity(samples, by, max_speed, max_turn, second).groupBy(*by).agg(
        F.count("speed").alias("n_checked"), F.max("speed").alias("max_speed"), F.max("turn").alias("max_turn"),
        F.count_if(F.col("reason") == "speed").alias("n_fast"), F.count_if(F.col("reason").isin("clock", "frame", "time")).alias("n_invalid"),
    )
    out = counts.join(found, by, "left").fillna(0, ["n_checked", "n_fast", "n_invalid"])
    status = F.when(F.col("n_fast") + F.col("n_invalid") > 0, "FAIL").when((F.col("n_checked") == 0) | (F.col("n_missing") > 0), "INSUFFICIENT_DATA").otherwise("PASS")
    return out.withColumn("status", status)


def qc_hand(hands: DataFrame, by: list[str], max_distance: float, max_speed: float, max_gap: int, wrist: int = 5, second: int = 1_000_000, listed: int = 20) -> DataFrame:
    """Plausibility of one side's hands per series. hands: idx, t, conf (-1: absent) and points (array of x, y, z; null or
    with a null coordinate: missing).

    n, n_present, n_zero_conf, n_unknown_conf, distance and speed percentiles of the wrist (50, 95, 100 %), n_far (hands with
    a landmark beyond max_distance), n_checked (intervals between present hands, at most max_gap apart), n_fast, n_gaps (all
    other intervals), n_backwards, the first `listed` idx that end a fast interval, and status: FAIL with any far, fast or
    backwards, INSUFFICIENT_DATA without a present hand, else PASS.
    """
    whole = F.forall("points", lambda p: p["x"].isNotNull() & p["y"].isNotNull() & p["z"].isNotNull())
    length = lambda p: F.sqrt(p["x"] * p["x"] + p["y"] * p["y"] + p["z"] * p["z"])
    present = (F.coalesce(F.col("conf"), F.lit(0.0)) != -1) & F.coalesce(whole, F.lit(False))
    at = lambda c: F.col("points")[wrist][c]
    rows = hands.withColumn("present", present)
    rows = rows.withColumns({
        "far": F.col("present") & (F.array_max(F.transform("points", length)) > max_distance),
        "away": F.when(F.col("present"), length(F.col("points")[wrist])), **{f"w{c}": F.when(F.col("present"), at(c)) for c in "xyz"},
    })
    w = Window.partitionBy(*by).orderBy("idx")
    rows = rows.withColumns({f"p{c}": F.lag(f"w{c}").over(w) for c in "xyz"} | {"dt": F.col("t") - F.lag("t").over(w), "k": F.row_number().over(w)})
    near = (F.col("dt") > 0) & (F.col("dt") <= max_gap) & F.col("wx").isNotNull() & F.col("px").isNotNull()
    step = g.norm(g.minus(g.cols("wx", "wy", "wz"), g.cols("px", "py", "pz")))
    rows = rows.withColumn("speed", F.when(near, step / (F.col("dt") / second))).withColumn("fast", F.coalesce(F.col("speed") > max_speed, F.lit(False)))
    rows = rows.withColumn("nth", F.sum(F.col("fast").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    shares = F.lit([0.5, 0.95, 1.0])
    out = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("present").alias("n_present"), F.count_if(F.col("conf") == 0).alias("n_zero_conf"), F.count_if(F.col("conf").isNull()).alias("n_unknown_conf"),
        F.percentile("away", shares).alias("distance"), F.percentile("speed", shares).alias("speed"), F.count_if("far").alias("n_far"), F.count("speed").alias("n_checked"),
        F.count_if("fast").alias("n_fast"), F.count_if((F.col("k") > 1) & F.col("speed").isNull()).alias("n_gaps"), F.count_if(F.col("dt") <= 0).alias("n_backwards"),
        F.sort_array(F.collect_list(F.when(F.col("fast") & (F.col("nth") <= listed), F.col("idx")))).alias("first_fast"),
    )
    status = F.when(F.col("n_far") + F.col("n_fast") + F.col("n_backwards") > 0, "FAIL").when(F.col("n_present") == 0, "INSUFFICIENT_DATA").otherwise("PASS")
    return out.withColumn("status", status)


def validate_frames(frames: DataFrame, poses: DataFrame, hands: DataFrame, by: list[str], pose_gap: int, hand_gap: int, second_gap: int, least_conf: float) -> DataFrame:
    """One row per frame of a participant's video, with the pose and the hand that may be shown for it.

    frames: frame, t (the device time of its map row, null if unresolved), evidence (VERIFIED, INFERRED, UNRESOLVED). Only
    VERIFIED frames are matched; a time that was inferred is never used. poses: t, idx. hands: t, idx, conf, pose_residual and
    pose_ok (of the pose the hand was placed by), whole (all points there). pose_ok and hand_ok: the nearest within its gap;
    hand_pose_ok: also placed by a pose within second_gap; present: with all points; sure: with a confidence of least_conf.
    """
    frames = frames.select(*by, "frame", "t", "evidence")
    known = frames.filter("evidence = 'VERIFIED'")
    pose = asof_nearest(known, poses, by, pose_gap).select(*by, "frame", F.col("sample_idx").alias("pose_idx"), F.col("residual").alias("pose_residual"), (F.col("status") == "matched").alias("pose_ok"))
    hand = asof_nearest(known, hands, by, hand_gap, ["conf", "pose_residual", "pose_ok", "whole"])
    ok = F.col("status") == "matched"
    placed = ok & F.col("sample_pose_ok") & (F.abs("sample_pose_residual") <= second_gap)
    hand = hand.select(
        *by, "frame", F.col("sample_idx").alias("hand_idx"), F.col("residual").alias("hand_residual"), ok.alias("hand_ok"), placed.alias("hand_pose_ok"), F.when(ok, F.col("sample_conf")).alias("hand_conf"),
        (placed & F.col("sample_whole")).alias("present"), (placed & F.col("sample_whole") & (F.col("sample_conf") >= least_conf)).alias("sure"),
    )
    out = frames.join(pose, [*by, "frame"], "left").join(hand, [*by, "frame"], "left")
    flags = ["pose_ok", "hand_ok", "hand_pose_ok", "present", "sure"]
    return out.withColumns({f: F.coalesce(f, F.lit(False)) for f in flags})


def participant_summary(validated: DataFrame, by: list[str]) -> DataFrame:
    """Counts of `validate_frames`: frames by evidence, matched poses and hands with their share, the largest accepted
    residuals, present and sure hands with their share, and hands that only the second gap turned away."""
    share = lambda flag: F.count_if(flag) / F.count(F.lit(1))
    return validated.groupBy(*by).agg(
        *(F.count_if(F.col("evidence") == e).alias(f"n_{e.lower()}") for e in ("VERIFIED", "INFERRED", "UNRESOLVED")),
        F.count_if("pose_ok").alias("n_pose"), share(F.col("pose_ok")).alias("pose_share"), F.max(F.when(F.col("pose_ok"), F.abs("pose_residual"))).alias("most_pose_residual"),
        F.count_if("hand_ok").alias("n_hand"), share(F.col("hand_ok")).alias("hand_share"), F.max(F.when(F.col("hand_ok"), F.abs("hand_residual"))).alias("most_hand_residual"),
        F.count_if("present").alias("n_present"), share(F.col("present")).alias("present_share"), F.count_if("sure").alias("n_sure"), share(F.col("sure")).alias("sure_share"),
        F.count_if(F.col("hand_ok") & ~F.col("hand_pose_ok")).alias("n_second_rejected"),
    )


def frame_gate(validated: DataFrame, values: dict[str, str]) -> DataFrame:
    """Frames ready to be shown: each column of `values` is kept only where the flag that it names is true, else cleared."""
    return validated.withColumns({c: F.when(F.col(flag), F.col(c)) for c, flag in values.items()})


def camera_pose(calibrations: DataFrame, poses: DataFrame, by: list[str], max_gap: int) -> DataFrame:
    """The camera in the world at the time of its calibration: the nearest device pose within max_gap, then the camera's own.

    calibrations: camera, t, calibrated and the camera in the device (POSE); poses: t, idx and the device in the world
    (POSE). reason is uncalibrated, the match's status where it is not matched, or not_a_rotation; the pose (rotation r00 to r22, x, y, z) is
    null then.
    """
    asked = calibrations.select(*by, "camera", "t", "calibrated", *(F.col(c).alias(f"c_{c}") for c in POSE))
    found = asof_nearest(asked, poses, by, max_gap, POSE)
    off = lambda p: F.abs(g.norm(g.cols(*(f"{p}{c}" for c in POSE[3:]))) - 1) > 1e-6
    device = g.unit_rotation(g.cols(*(f"sample_{c}" for c in POSE[3:]))), g.cols(*(f"sample_{c}" for c in POSE[:3]))
    camera = g.unit_rotation(g.cols(*(f"c_{c}" for c in POSE[3:]))), g.cols(*(f"c_{c}" for c in POSE[:3]))
    r, t = g.composed(*device, *camera)
    why = F.when(~F.col("calibrated"), "uncalibrated").when(F.col("status") != "matched", F.col("status")).when(off("sample_") | off("c_"), "not_a_rotation")
    names = [*(f"r{i}{j}" for i in range(3) for j in range(3)), "x", "y", "z"]
    return found.withColumn("reason", why).select(*by, "camera", "t", "residual", "reason", *(F.when(F.col("reason").isNull(), c).alias(n) for n, c in zip(names, [*r, *t], strict=True)))


def event_projection(events: DataFrame, seen: DataFrame, by: list[str], cameras: int = 2, points: int = 4) -> DataFrame:
    """The share of an event's points that lie in each camera's image, and the least of them.

    events: iv, start_frame, end_frame (included). seen: camera, frame, n_in (of `points` points a frame). least is null
    unless all `cameras` have a row for each of the event's frames.
    """
    wide = events.select(*by, "iv", (F.col("end_frame") - F.col("start_frame") + 1).alias("n_frames"), F.explode(F.sequence("start_frame", "end_frame")).alias("frame"))
    per = wide.join(seen, [*by, "frame"]).groupBy(*by, "iv", "camera").agg(F.first("n_frames").alias("n_frames"), F.count(F.lit(1)).alias("k"), F.sum("n_in").alias("n_in"))
    per = per.withColumn("share", F.when(F.col("k") == F.col("n_frames"), F.col("n_in") / (points * F.col("n_frames"))))
    out = per.groupBy(*by, "iv").agg(F.count("share").alias("n_cameras"), F.min("share").alias("least"))
    return events.select(*by, "iv").join(out, [*by, "iv"], "left").select(*by, "iv", F.coalesce("n_cameras", F.lit(0)).alias("n_cameras"), F.when(F.col("n_cameras") == cameras, F.col("least")).alias("least"))


def match_requested(matches: DataFrame, requested: DataFrame, valid: DataFrame, radius: int, last: int) -> DataFrame:
    """Matches of requested frames only, and only where every candidate of their window was there.

    matches: frame, candidate, matched. requested: frame, center. valid: the frames of candidates (0..last) that are there.
    All frames of matches come back; reason is outside_requested_windows, incomplete_candidate_window or null.
    """
    window = requested.distinct().select("frame", F.explode(F.sequence(F.greatest(F.col("center") - radius, F.lit(0)), F.least(F.col("center") + radius, F.lit(last)))).alias("at"))
    there = valid.select(F.col("frame").alias("at")).distinct().withColumn("there", F.lit(True))
    whole = window.join(there, "at", "left").groupBy("frame").agg((F.count_if(F.col("there").isNull()) == 0).alias("whole"))
    out = matches.join(whole, "frame", "left")
    why = F.when(F.col("whole").isNull(), "outside_requested_windows").when(~F.col("whole"), "incomplete_candidate_window")
    ok = why.isNull() & F.coalesce("matched", F.lit(False))
    return out.select("frame", F.when(ok, F.col("candidate")).alias("candidate"), F.when(ok, "VERIFIED").otherwise("UNRESOLVED").alias("evidence"), why.alias("reason"))


def correspondence_summary(matches: DataFrame, by: list[str], n_source: int) -> DataFrame:
    """What matches (frame, candidate, best, matched) say of one constant offset: that of the first frame, where its last
    frame would fall and whether that is beyond n_source, whether confident matches reject a constant offset, their error's
    median, 95 % and largest, and how many confident neighbours don't go on by one."""
    w = Window.partitionBy(*by).orderBy("frame")
    rows = matches.withColumns({"offset": F.col("candidate") - F.col("frame"), "pf": F.lag("frame").over(w), "pc": F.lag("candidate").over(w), "pm": F.lag("matched").over(w)})
    odd = F.col("matched") & F.col("pm") & (F.col("frame") == F.col("pf") + 1) & (F.col("candidate") != F.col("pc") + 1)
    sure = F.when(F.col("matched"), F.col("best"))
    out = rows.groupBy(*by).agg(
        F.min_by("offset", "frame").alias("first_offset"), F.count(F.lit(1)).alias("n"), F.count_if("matched").alias("n_sure"), (F.max("frame") - F.min("frame")).alias("span"), F.min_by("candidate", "frame").alias("first_candidate"),
        (F.count_distinct(F.when(F.col("matched"), F.col("offset"))) > 1).alias("constant_rejected"), F.percentile(sure, F.lit([0.5, 0.95, 1.0])).alias("errors"), F.count_if(odd).alias("n_irregular"),
    )
    return out.withColumn("implied_last", F.col("first_candidate") + F.col("span")).withColumn("out_of_range", F.col("implied_last") >= n_source).drop("span", "first_candidate")


def orientation_gate(anchors: DataFrame, by: list[str], expected: int, most: float, margin: float, least: int, max_gap: int, last: Column) -> DataFrame:
    """Whether every anchor shows the same quarter turn. anchors: frame and scores (errors of the turns 0 to 3).

    reason, else null: too_few, not_covered (the first anchor is not frame 0, the last not `last`, or two are more than
    max_gap apart), not_established (the expected turn's error is over `most`, or another's is less than `margin` larger).
    """
    w = Window.partitionBy(*by).orderBy("frame")
    own = F.col("scores")[expected]
    rows = anchors.withColumns({"own": own, "margin": F.array_min(F.transform("scores", lambda x, i: F.when(i != expected, x))) - own, "gap": F.col("frame") - F.lag("frame").over(w)})
    out = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.min("frame").alias("first"), F.max("frame").alias("final"), F.max("gap").alias("widest"), F.max("own").alias("worst"), F.min("margin").alias("margin"), last.alias("last"),
    )
    why = F.when(F.col("n") < least, "too_few").when((F.col("first") != 0) | (F.col("final") != F.col("last")) | (F.coalesce("widest", F.lit(0)) > max_gap), "not_covered")
    why = why.when((F.col("worst") > most) | (F.col("margin") < margin), "not_established")
    return out.select(*by, "n", "widest", "worst", "margin", why.alias("reason"))


def check_frame_index(frames: DataFrame, by: list[str]) -> DataFrame:
    """Whether each series' frames are exactly 0 to n - 1: n, n_frames, complete."""
    out = frames.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("frame").alias("n_frames"), F.min("frame").alias("low"), F.max("frame").alias("high"))
    return out.select(*by, "n", "n_frames", ((F.col("n") == F.col("n_frames")) & (F.col("low") == 0) & (F.col("high") == F.col("n") - 1)).alias("complete"))


def bind_events(events: DataFrame, extent: DataFrame, by: list[str], evidence: str, status: str) -> DataFrame:
    """Events bound to a timeline under explicit evidence: status is the evidence's where the bounds lie inside the timeline
    and in order, else UNRESOLVED with the reason. Nothing is clamped. extent: n_frames per series."""
    rows = events.join(extent, by, "left")
    why = F.when(F.col("n_frames").isNull(), "no_timeline").when(F.col("start_frame").isNull() | F.col("end_frame").isNull(), "no_bounds")
    why = why.when(F.col("start_frame") > F.col("end_frame"), "start_after_end").when((F.col("start_frame") < 0) | (F.col("end_frame") >= F.col("n_frames")), "out_of_range")
    return rows.select(*events.columns, F.lit(evidence).alias("evidence"), F.when(why.isNull(), status).otherwise("UNRESOLVED").alias("status"), why.alias("reason"))


def coverage_by(points: DataFrame, by: list[str], projector: Callable[[list[Column]], list[Column]], width: float, height: float) -> DataFrame:
    """Counts of points (x, y, z) that a caller's projector (columns to columns; a pandas UDF's result will do) places inside
    and outside an image, and those that it can't place, with the extent of all that it places."""
    u, v = projector(g.cols("x", "y", "z"))
    rows = points.select(*by, u.alias("u"), v.alias("v"))
    inside = (F.col("u") >= 0) & (F.col("u") < width) & (F.col("v") >= 0) & (F.col("v") < height)
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(inside).alias("n_inside"), F.count_if(~inside).alias("n_outside"), F.count_if(F.col("u").isNull() | F.col("v").isNull()).alias("n_unplaced"),
        *(f(c).alias(f"{n}_{c}") for c in "uv" for n, f in (("min", F.min), ("max", F.max))),
    )
