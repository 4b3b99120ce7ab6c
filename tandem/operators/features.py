"""Feature tables on a recording's frames: both people's hands and gaze, and what event proposals are trained on."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tandem.functions import geometry as g

from .align import asof_backward, asof_nearest
from .qc import presence
from .sequence import over

SIDES = ("left", "right")
#: What a person contributes to a proposal's features, and the two together; windows' statistics.
PERSON = ("wrist_speed_left", "wrist_speed_right", "present_left", "present_right", "radius_left", "radius_right", "hands_apart", "held_left", "held_right", "angle", "angle_valid")
TOGETHER = ("head_distance", "wrist_distance", "distance_valid")
STATS = ("mean", "std", "max")


def _finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def hand_features(grid: DataFrame, hands: DataFrame, by: list[str], max_gap: int) -> DataFrame:
    """The nearest hand sample's points for every frame: left, left_conf, left_valid and the same for right.

    grid: frame, t. hands: t, idx, left and right (arrays of coordinates), left_conf, right_conf. A side is valid if a sample is
    near enough, its confidence isn't the mark for absent (-1) and all its numbers are finite; else its numbers are 0.
    """
    keep = [c for s in SIDES for c in (s, f"{s}_conf")]
    near = asof_nearest(grid, hands, by, max_gap, keep)
    out = {}
    for s in SIDES:
        state, conf = presence(F.col(f"sample_{s}_conf"))
        points = F.col(f"sample_{s}")
        ok = F.coalesce((F.col("status") == "matched") & (state == "present") & points.isNotNull() & F.forall(points, _finite), F.lit(False))
        out |= {s: F.when(ok, points).otherwise(F.transform(points, lambda _: F.lit(0.0))), f"{s}_conf": F.when(ok, conf).otherwise(F.lit(0.0)), f"{s}_valid": ok}
    return near.select(*by, "frame", *(c.alias(n) for n, c in out.items()))


def gaze_features(grid: DataFrame, gaze: DataFrame, by: list[str], max_gap: int) -> DataFrame:
    """The nearest gaze sample's point and unit direction for every frame, and gaze_valid; 0 where it isn't.

    gaze: t, idx, left_yaw, right_yaw, pitch, depth. The direction goes along the mean yaw; a depth outside (0, 10) counts as 1.
    """
    near = asof_nearest(grid, gaze, by, max_gap, ["left_yaw", "right_yaw", "pitch", "depth"])
    yaw, pitch = (F.col("sample_left_yaw") + F.col("sample_right_yaw")) / 2, F.col("sample_pitch")
    depth = F.when(_finite(F.col("sample_depth")), F.col("sample_depth"))
    direction, point = g.normalized([F.tan(yaw), F.tan(pitch), F.lit(1.0)]), g.gaze_point(yaw, pitch, depth)
    ok = F.coalesce((F.col("status") == "matched") & reduce(lambda a, b: a & b, map(_finite, point)), F.lit(False))
    cols = dict(zip(("gaze_x", "gaze_y", "gaze_z", "look_x", "look_y", "look_z"), [*point, *direction], strict=True))
    return near.select(*by, "frame", *(F.when(ok, c).otherwise(F.lit(0.0)).alias(n) for n, c in cols.items()), ok.alias("gaze_valid"))


def recording_kinematics(grid: DataFrame, hands: DataFrame, gaze: DataFrame, by: list[str], roles: dict[object, str], hand_gap: int, gaze_gap: int) -> DataFrame:
    """by, frame and both people's hand and gaze columns, prefixed by their names, on the frames that both have.

    grid, hands and gaze carry role and each role's own times. roles: value of role to prefix.
    """
    series = [*by, "role"]
    both = hand_features(grid, hands, series, hand_gap).join(gaze_features(grid, gaze, series, gaze_gap), [*series, "frame"])
    own = [c for c in both.columns if c not in (*series, "frame")]
    parts = [both.filter(F.col("role") == r).select(*by, "frame", *(F.col(c).alias(f"{name}_{c}") for c in own)) for r, name in roles.items()]
    return reduce(lambda a, b: a.join(b, [*by, "frame"]), parts)


def valid_shares(kinematics: DataFrame, by: list[str], names: list[str]) -> DataFrame:
    """n_frames and the share of frames in which each person's left hand, right hand and gaze are valid."""
    share = lambda c: F.avg(F.col(c).cast("double")).alias(c)
    return kinematics.groupBy(*by).agg(F.count(F.lit(1)).alias("n_frames"), *(share(f"{n}_{c}_valid") for n in names for c in (*SIDES, "gaze")))


def person_features(frames: DataFrame, by: list[str], fps: float, centre: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """The numbers of PERSON for every frame of a person.

    frames: left_u, left_v, right_u, right_v (wrists in image widths, null or NaN where there is none), left_held, right_held,
    angle (to the partner; null or NaN where unknown). Speeds are from one frame to the next, 0 unless the wrist is in both; the
    radius is from `centre`; what is absent is 0.
    """
    w = over(by)
    at = {(s, c): F.col(f"{s}_{c}") - centre[k] for s in SIDES for k, c in enumerate("uv")}
    there = {s: _finite(at[s, "u"]) & _finite(at[s, "v"]) for s in SIDES}
    out = frames.withColumns({f"_{s}": F.when(there[s], F.struct(at[s, "u"].alias("u"), at[s, "v"].alias("v"))) for s in SIDES})
    size = lambda a, b=None: F.hypot(a["u"] - (b["u"] if b is not None else 0.0), a["v"] - (b["v"] if b is not None else 0.0))
    zero = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    col = {s: F.col(f"_{s}") for s in SIDES}
    angle = F.when(_finite(F.col("angle")), F.col("angle"))
    values = {f"wrist_speed_{s}": zero(size(col[s], F.lag(col[s]).over(w)) * fps) for s in SIDES} | {f"present_{s}": col[s].isNotNull().cast("double") for s in SIDES}
    values |= {f"radius_{s}": zero(size(col[s])) for s in SIDES} | {"hands_apart": zero(size(col["left"], col["right"]))}
    values |= {f"held_{s}": zero(F.col(f"{s}_held")) for s in SIDES} | {"angle": zero(angle), "angle_valid": angle.isNotNull().cast("double")}
    return out.select(*by, "frame", *(values[c].alias(c) for c in PERSON))


def proposal_features(a: DataFrame, b: DataFrame, together: DataFrame, by: list[str], windows: dict[str, int], digits: int | None = None) -> DataFrame:
    """by, frame, order and the features that proposals are trained on, once for each order of the two people (ab, ba).

    a, b: PERSON's columns per frame. together: head_distance and wrist_distance per frame, null where unknown; valid are frames
    with both and a wrist distance over 0. Behind every number come its mean, deviation and maximum over the last frames of
    each window (name to number of frames); before the first frame its value is repeated. With two windows these are
    25 x 7 = 175 columns. All statistics of a recording share one sort, are made (and rounded to `digits`) once for both orders,
    and are made where people are dealt by series: these meet in groups there, without a join by frame.
    """
    known = {c: F.when(_finite(F.col(c)), F.col(c)) for c in TOGETHER[:2]}
    valid = F.coalesce(known["head_distance"].isNotNull() & (known["wrist_distance"] > 0), F.lit(False)).cast("double")
    apart = together.select(*by, "frame", *(F.coalesce(v, F.lit(0.0)).alias(c) for c, v in known.items()), valid.alias("distance_valid"))
    side = lambda df, p: df.select(*by, "frame", *(F.col(c).alias(f"{p}_{c}") for c in PERSON))
    base = [*(f"{p}_{c}" for p in "ab" for c in PERSON), *TOGETHER]
    parts = [df.withColumn(f"_{n}", F.lit(True)) for n, df in (("a", side(a, "a")), ("b", side(b, "b")), ("apart", apart))]
    met = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts).dropna(subset=[*by, "frame"])
    met = met.groupBy(*by, "frame").agg(*(F.max(c).alias(c) for c in (*base, "_a", "_b"))).filter("_a AND _b").drop("_a", "_b")
    rows = met.na.fill(0.0, list(TOGETHER))
    start = over(by).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select("*", *(F.first(c).over(start).alias(f"_first_{c}") for c in base))
    sums, values, out = {}, {}, [*base]
    for name, width in windows.items():
        w = over(by).rowsBetween(1 - width, 0)
        sums[f"_n_{name}"] = width - F.count(F.lit(1)).over(w)
        for c in base:
            sums |= {f"_sum_{c}_{name}": F.sum(c).over(w), f"_square_{c}_{name}": F.sum(F.col(c) * F.col(c)).over(w), f"{c}_max_{name}": F.max(c).over(w)}
            mean = (F.col(f"_sum_{c}_{name}") + F.col(f"_n_{name}") * F.col(f"_first_{c}")) / width
            square = (F.col(f"_square_{c}_{name}") + F.col(f"_n_{name}") * F.col(f"_first_{c}") * F.col(f"_first_{c}")) / width
            values |= {f"{c}_mean_{name}": mean, f"{c}_std_{name}": F.sqrt(F.greatest(square - mean * mean, F.lit(0.0))), f"{c}_max_{name}": F.col(f"{c}_max_{name}")}
        out += [f"{c}_{s}_{name}" for s in STATS for c in base]
    rows = rows.select("*", *(c.alias(n) for n, c in sums.items()))  # one pass for each width
    exact = lambda c: c if digits is None else F.round(c, digits)
    orders = F.explode(F.array(F.lit("ab"), F.lit("ba"))).alias("order")
    rows = rows.select(*by, "frame", *(exact(values.get(c, F.col(c))).alias(c) for c in out)).select("*", orders)
    swapped = lambda c: {"a_": "b_", "b_": "a_"}.get(c[:2], c[:2]) + c[2:]
    return rows.select(*by, "frame", "order", *(F.when(F.col("order") == "ab", F.col(c)).otherwise(F.col(swapped(c))).alias(c) for c in out))


def utterance_block(grid: DataFrame, utterances: DataFrame, by: list[str], size: int, fade: float, most: float) -> DataFrame:
    """by, frame, block and age: the vector of the last utterance that has ended, fading by exp(-age / fade), and its age as a share
    of `most`, at which it stops growing; before the first one zeros and an age of 1.

    grid: frame, t. utterances: t (the end, in the grid's unit), idx, v (an array of `size` numbers, of the text's meaning, say).
    """
    rows = asof_backward(grid, utterances, by, ["v"])
    age = F.least(F.col("age").cast("double"), F.lit(most))
    fading = F.transform("event_v", lambda x: x * F.exp(-age / fade))
    none = F.array_repeat(F.lit(0.0), size)
    return rows.select(*by, "frame", F.when(F.col("event_v").isNotNull(), fading).otherwise(none).alias("block"), F.coalesce(age / most, F.lit(1.0)).alias("age"))


def gaze_axis_stats(gaze: DataFrame, by: list[str], axis: tuple[float, float, float], near: float = 15.0) -> DataFrame:
    """by, part (all, attending) and of each: n, the median, mean and 90th percentile of the angle between gaze and the camera's
    axis with the share under `near` degrees; the mean gaze axis and its angle to the camera's; and the same four numbers of
    the angle to the mean axis, which tell a fixed offset from scatter.

    gaze: x, y, z (a unit direction, null where not valid) and attending. Parts without a direction have no row.
    """
    known = gaze.filter("x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL")
    parts = F.explode(F.array_compact(F.array(F.lit("all"), F.when(F.col("attending"), F.lit("attending"))))).alias("part")
    rows = known.select(*by, "x", "y", "z", parts).withColumn("angle", g.angle_degrees(g.cols("x", "y", "z"), [F.lit(float(c)) for c in axis]))
    key = [*by, "part"]

    def four(c: str, name: str) -> list[Column]:
        return [F.percentile(c, F.lit(0.5)).alias(f"{name}median"), F.avg(c).alias(f"{name}mean"), F.percentile(c, F.lit(0.9)).alias(f"{name}p90"), F.avg((F.col(c) < near).cast("double")).alias(f"{name}near")]

    first = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), *four("angle", ""), *(F.avg(c).alias(f"m{c}") for c in "xyz"))
    unit = g.normalized(g.cols("mx", "my", "mz"))
    first = first.withColumns({f"axis_{c}": u for c, u in zip("xyz", unit, strict=True)}).drop("mx", "my", "mz")
    first = first.withColumn("axis_angle", g.angle_degrees(g.cols("axis_x", "axis_y", "axis_z"), [F.lit(float(c)) for c in axis]))
    rest = rows.join(first.select(*key, "axis_x", "axis_y", "axis_z"), key).withColumn("off", g.angle_degrees(g.cols("x", "y", "z"), g.cols("axis_x", "axis_y", "axis_z")))
    return first.join(rest.groupBy(*key).agg(*four("off", "off_")), key)
