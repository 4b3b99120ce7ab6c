"""Composite event analytics: hand speed, event metrics, candidates with source priority, gaze and pair features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tandem.functions import geometry as g
from tandem.operators import evaluate, graph, intervals, sequence


def hand_speed(metric: DataFrame, image: DataFrame, by: list[str], least: float) -> DataFrame:
    """speed and unit per frame: the metric source's where at least `least` of a series' frames have one, else the image's.
    Both: by, frame, speed (null when missing)."""
    share = metric.groupBy(*by).agg((F.count("speed") / F.count(F.lit(1))).alias("share"))
    both = image.select(*by, "frame", F.col("speed").alias("s2")).join(metric.select(*by, "frame", F.col("speed").alias("s3")), [*by, "frame"], "left").join(share, by, "left")
    good = F.coalesce(F.col("share") >= least, F.lit(False))
    return both.select(*by, "frame", F.when(good, F.col("s3")).otherwise(F.col("s2")).alias("speed"), F.when(good, "m/s").otherwise("image/s").alias("unit"))


def by_priority(sources: list[tuple[str, DataFrame]], by: list[str]) -> DataFrame:
    """Events of the first source in the list that has any for the group, with its name."""
    every = None
    for k, (name, df) in enumerate(sources):
        part = df.select(*by, "start", "end", F.lit(k).alias("priority"), F.lit(name).alias("source"))
        every = part if every is None else every.unionByName(part)
    first = F.min("priority").over(Window.partitionBy(*by))
    return every.withColumn("first", first).filter("priority = first").drop("first", "priority")


def event_metrics(events: DataFrame, speed: DataFrame, distance: DataFrame, by: list[str], lead: int) -> DataFrame:
    """Per event (iv, start_frame, end_frame): the giver's and receiver's reach onset in the `lead` frames before it, the
    response (receiver after giver), the transfer's length, the frame of least distance (the first) and that distance.

    speed: by, role, frame, speed; distance: by, frame, distance. The role that reaches first gives.
    """
    events = intervals.dealt(events, by)  # as the frames are dealt where they are dealt by series
    asked = [sequence.reach_onset(speed.filter(F.col("role") == r).select(*by, "frame", "speed"), events, by, lead, 2 * lead, 1, 1.0, 0.0).select(*by, "iv", F.col("onset").alias(f"onset_{r}")) for r in (0, 1)]
    inside = events.select(*by, "iv", F.explode(F.sequence("start_frame", "end_frame")).alias("frame")).join(distance, [*by, "frame"])
    near = inside.filter("distance IS NOT NULL").groupBy(*by, "iv").agg(F.min(F.struct("distance", "frame")).alias("near"))
    out = events.select(*by, "iv", "start_frame", "end_frame").join(asked[0], [*by, "iv"]).join(asked[1], [*by, "iv"]).join(near, [*by, "iv"], "left")
    giver = F.when(F.col("onset_0").isNull() & F.col("onset_1").isNull(), F.lit(None)).when(F.coalesce("onset_0", F.lit(1 << 30)) <= F.coalesce("onset_1", F.lit(1 << 30)), 0).otherwise(1)
    return out.select(
        *by, "iv", giver.alias("giver"), F.least("onset_0", "onset_1").alias("reach_onset"), F.abs(F.col("onset_0") - F.col("onset_1")).alias("response"),
        (F.col("end_frame") - F.col("start_frame")).alias("transfer"), F.col("near.frame").alias("nearest_frame"), F.col("near.distance").alias("min_distance"),
    )


def pair_features(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """Distance of two people's heads, how each faces the other (cosine of its axis to the line between them), and whether
    both do (over 0.8). a, b: by, x, y, z, fx, fy, fz (facing direction)."""
    side = lambda df, n: df.select(*by, *(F.col(c).alias(f"{n}{c}") for c in ("x", "y", "z", "fx", "fy", "fz")))
    both = side(a, "a").join(side(b, "b"), by)
    line = g.minus(g.cols("bx", "by", "bz"), g.cols("ax", "ay", "az"))
    cos = lambda f, v: F.try_divide(g.dot(f, v), g.norm(f) * g.norm(v))
    ab, ba = cos(g.cols("afx", "afy", "afz"), line), cos(g.cols("bfx", "bfy", "bfz"), [-c for c in line])
    return both.select(*by, g.norm(line).alias("distance"), ab.alias("a_faces_b"), ba.alias("b_faces_a"), ((ab > 0.8) & (ba > 0.8)).alias("mutual"))


def closing_speed(df: DataFrame, by: list[str], column: str, most: float) -> DataFrame:
    """How fast a distance shrinks, clipped to -most..most; null where an end is missing, 0 in the first frame."""
    step = sequence.deltas(df, by, [column])
    return step.withColumn("closing", F.greatest(F.least(-F.col(f"d_{column}"), F.lit(most)), F.lit(-most))).drop(f"d_{column}")


def proximity_events(distance: DataFrame, by: list[str], near: float, least: int, bridge: int) -> DataFrame:
    """Runs of frames with a distance under `near`."""
    return intervals.runs(distance.withColumn("near", F.coalesce(F.col("distance") < near, F.lit(False))), by, "near", least, bridge)


def peaks_before(probs: DataFrame, frames: DataFrame, by: list[str], back: int) -> DataFrame:
    """The largest p in the `back` frames before each frame `at`; frames without any have no row. What else `frames` has is kept."""
    rows = _before(probs, frames, by, back, {"peak": F.max("p")})
    return rows.select(*by, F.col("frame").alias("at"), *(c for c in frames.columns if c not in (*by, "frame")), "peak")


def _before(probs: DataFrame, frames: DataFrame, by: list[str], back: int, values: dict[str, Column]) -> DataFrame:
    """Each of `frames` once, with aggregates of the rows of probs in the `back` frames before it, if there are any. Both meet in a
    union and a window by series, so that probs, dense as they are, stay where they are dealt by series."""
    asked = frames.dropna(subset=[*by, "frame"]).distinct().withColumn("_asked", F.lit(True))
    rows = probs.withColumn("_known", F.lit(True)).unionByName(asked, allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy("frame").rangeBetween(-back, -1)
    rows = rows.withColumns({n: v.over(w) for n, v in values.items()} | {"_n": F.count("_known").over(w)})
    return rows.filter("_asked AND _n > 0").select(*frames.columns, *values)


def anticipation(probs: DataFrame, onsets: DataFrame, negatives: DataFrame, by: list[str], back: int, ahead: int, rates: list[float]) -> DataFrame:
    """How well p tells onsets beforehand: its peak in the `back` frames before them against that before negative frames.

    One row per rate of false alarms: the threshold that so many negatives reach, recall (onsets that reach it), both counts,
    auroc of all peaks, and the lead: from the first of the `ahead` frames before an onset that reaches the threshold to the
    onset, its median and mean over the onsets that are detected so, and their share. Values are compared to nine decimals.
    """
    onsets = intervals.dealt(onsets, by)  # as the frames are dealt where they are dealt by series
    asked = onsets.select(*by, "frame", F.lit(1).alias("y")).unionByName(negatives.select(*by, "frame", F.lit(0).alias("y")))
    peaks = graph.settled(peaks_before(probs.select(*by, "frame", "p"), asked, by, back))  # read four times
    pos, neg = peaks.filter("y = 1"), peaks.filter("y = 0")
    levels = neg.agg(*(F.percentile("peak", F.lit(1 - r)).alias(f"t{k}") for k, r in enumerate(rates)), F.count(F.lit(1)).alias("n_negatives"))
    rows = levels.select("n_negatives", F.explode(F.array(*(F.struct(F.lit(r).alias("rate"), F.round(F.col(f"t{k}"), 9).alias("threshold")) for k, r in enumerate(rates)))).alias("l")).select("n_negatives", "l.*")
    rows = graph.settled(rows)
    every = rows.agg(F.sort_array(F.collect_list(F.struct("rate", "threshold"))).alias("levels"))  # as many as rates
    rows = F.broadcast(rows)
    reached = lambda c: F.round(c, 9) >= F.col("threshold")
    recall = pos.join(rows).groupBy("rate", "threshold", "n_negatives").agg(F.avg(reached("peak").cast("double")).alias("recall"), F.count(F.lit(1)).alias("n_onsets"))
    level = [F.col("levels")[k] for k in range(len(rates))]
    told = probs.select(*by, "frame", "p").join(F.broadcast(every)).select(*by, "frame", *(F.when(F.round("p", 9) >= v["threshold"], F.col("frame")).alias(f"_told{k}") for k, v in enumerate(level)))
    first = _before(told, onsets.select(*by, "frame"), by, ahead, {f"first{k}": F.min(f"_told{k}") for k in range(len(rates))}).join(F.broadcast(every))
    first = first.select("frame", F.explode(F.array(*(F.struct(v["rate"].alias("rate"), F.col(f"first{k}").alias("first")) for k, v in enumerate(level)))).alias("f")).select("frame", "f.*")
    lead = F.col("frame") - F.col("first")
    leads = first.groupBy("rate").agg(F.percentile(lead, F.lit(0.5)).alias("median_lead"), F.avg(lead).alias("mean_lead"), (F.count("first") / F.count(F.lit(1))).alias("detected"))
    both = peaks.select("y", F.col("peak").alias("score"))
    return recall.join(leads, "rate").join(F.broadcast(evaluate.auroc(both, []).select("auroc")))


def mean_curve(probs: DataFrame, onsets: DataFrame, by: list[str], ahead: int, step: int) -> DataFrame:
    """The mean of p at every `step` of the `ahead` frames before onsets; what lies before a series' start counts as 0."""
    asked = onsets.select(*by, F.col("frame").alias("at"), F.explode(F.sequence(F.lit(-ahead), F.lit(-1), F.lit(step))).alias("before"))
    rows = asked.withColumn("frame", F.col("at") + F.col("before")).join(probs, [*by, "frame"], "left")
    return rows.groupBy("before").agg(F.avg(F.coalesce("p", F.lit(0.0))).alias("mean"), F.count(F.lit(1)).alias("n"))


#: The columns of `world_block`, in their order.
WORLD = [
    "d_ll", "d_lr", "d_rl", "d_rr", "d_min", "closing", "heads", "a_b_x", "a_b_y", "a_b_z", "b_a_x", "b_a_y", "b_a_z",
    *(f"a_{s}_{c}" for s in ("left", "right") for c in "xyz"), *(f"b_{s}_{c}" for s in ("left", "right") for c in "xyz"),
    "gaze_wrist_a", "gaze_wrist_b", "gaze_head_a", "gaze_head_b", "facing_a", "facing_b", "both", "hands_a", "hands_b",
]


def world_block(frames: DataFrame, by: list[str], fps: float, axes: dict[str, tuple[float, float, float]], far: float = 3.0, most: float = 5.0) -> DataFrame:
    """What two people, a and b, are to each other in the world, per frame: the columns of WORLD.

    frames: frame and, for each of a_ and b_, a pose in the world (x, y, z, qx, qy, qz, qw; null if unknown) and, in the
    device, left_, right_ and gaze_ x, y, z (null if absent). axes: each camera's forward axis in its device.
    d_*: distances between the wrists of a and b (`far` where one is unknown), d_min the least (0 if all are unknown), closing
    its change a second, within `most`, where the frame before knew one too. heads: distance of the devices. a_b_*: b's
    device in a's; a_left_* and so on: b's wrists there; b_* likewise of a. gaze_wrist, gaze_head: from the point looked at to
    the other's nearest wrist and device. facing: cosine of the forward axis to the other. both, hands_*: what is known.
    Unknown values are 0.
    """
    people, sides = ("a", "b"), ("left", "right")
    cols = lambda p, n="": g.cols(*(f"{p}_{n}{c}" for c in "xyz"))
    r9 = [f"r{i}{j}" for i in range(3) for j in range(3)]
    rot = {p: g.cols(*(f"{p}_{n}" for n in r9)) for p in people}
    rows = frames.withColumns({f"{p}_{n}": e for p in people for n, e in zip(r9, g.unit_rotation(g.cols(*(f"{p}_q{c}" for c in "xyzw"))), strict=True)})
    rows = rows.withColumns({"both": F.col("a_x").isNotNull() & F.col("b_x").isNotNull(), **{f"{p}_has_{n}": F.col(f"{p}_{n}_x").isNotNull() for p in people for n in (*sides, "gaze")}})
    rows = rows.withColumns({f"{p}_w{n}_{c}": e for p in people for n in (*sides, "gaze") for c, e in zip("xyz", g.applied(rot[p], cols(p), cols(p, f"{n}_")), strict=True)})
    world = lambda p, n: cols(p, f"w{n}_")
    known = lambda c, e: F.coalesce(F.when(c, e), F.lit(0.0))
    other = {"a": "b", "b": "a"}
    pairs = {f"d_{i[0]}{j[0]}": F.coalesce(g.norm(g.minus(world("a", i), world("b", j))), F.lit(far)) for i in sides for j in sides}
    rows = rows.withColumns(pairs)
    near = F.least(*map(F.col, pairs))
    any_pair = F.lit(False)
    for i in sides:
        for j in sides:
            any_pair = any_pair | (F.col("both") & F.col(f"a_has_{i}") & F.col(f"b_has_{j}"))
    rows = rows.withColumns({"near": near, "any_pair": any_pair})
    w = Window.partitionBy(*by).orderBy("frame")
    speed = F.greatest(F.least((F.col("near") - F.lag("near").over(w)) * fps, F.lit(most)), F.lit(-most))
    out = {"d_min": known(F.col("any_pair"), F.col("near")), "closing": known(F.col("any_pair") & F.lag("any_pair").over(w), speed), "heads": known(F.col("both"), g.norm(g.minus(cols("a"), cols("b"))))}
    back = lambda p, v: g.turned(g.transposed(rot[p]), g.minus(v, cols(p)))
    for p in people:
        o = other[p]
        out |= {f"{p}_{o}_{c}": known(F.col("both"), e) for c, e in zip("xyz", back(p, cols(o)), strict=True)}
        out |= {f"out_{p}_{n}_{c}": known(F.col("both"), e) for n in sides for c, e in zip("xyz", back(p, world(o, n)), strict=True)}
        looks = F.col("both") & F.col(f"{p}_has_gaze")
        reach = F.least(*(F.coalesce(g.norm(g.minus(world(p, "gaze"), world(o, n))), F.lit(far)) for n in sides))
        out[f"gaze_wrist_{p}"] = known(looks & (F.col(f"{o}_has_left") | F.col(f"{o}_has_right")), reach)
        out[f"gaze_head_{p}"] = known(looks, g.norm(g.minus(world(p, "gaze"), cols(o))))
        toward = g.minus(cols(o), cols(p))
        out[f"facing_{p}"] = known(F.col("both"), g.dot(g.turned(rot[p], [F.lit(float(v)) for v in axes[p]]), toward) / (g.norm(toward) + 1e-6))
        out[f"hands_{p}"] = F.col(f"{p}_has_left") | F.col(f"{p}_has_right")
    rows = rows.select(*by, "frame", "both", *pairs, *(e.alias(n) for n, e in out.items()))
    return rows.select(*by, "frame", *(F.col(f"out_{n}" if f"out_{n}" in out else n).alias(n) for n in WORLD))
