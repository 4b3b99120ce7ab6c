"""The clock of a motion sensor against video, and the arm that its sensors' turns describe."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from tandem.functions import geometry as g

from .graph import settled
from .motion import angular_path


@dataclass(frozen=True)
class ClockRule:
    """Limits of a clock estimate. Times in the unit of the series; the numbers are the usual ones for seconds."""

    most_lag: float = 2.0
    step: float = 0.01
    least_valid: float = 0.9
    n_null: int = 200
    least_shift: float = 5.0
    least_r: float = 0.2
    most_p: float = 0.01
    least_ratio: float = 1.3
    least_frames: int = 100
    drift_window: float = 300.0
    least_window: float = 60.0
    least_fit_windows: int = 3
    most_ppm: float = 1000.0

    @property
    def lags(self) -> int:
        """Lags go from minus this to this, in steps."""
        return round(self.most_lag / self.step)


#: A unit of a clock's test has so many lags of a recording at most, and so many values of them at once.
LAGS_A_UNIT, VALUES_AT_ONCE = 64, 2**18


def _turns(n: int, low: int, most: int) -> np.ndarray:
    """By how much a series of n is turned in a circle: `most` ways at most, evenly from `low` to as much less than n."""
    return np.unique(low + (n - 2 * low) * np.arange(most) // max(1, most - 1)) if n > 2 * low else np.zeros(0, int)


def _apart(df: DataFrame, unit: list[str]) -> DataFrame:
    """df dealt by unit. Little data, much work: a number of partitions that is asked for isn't made smaller."""
    session = df.sparkSession
    return df.repartition(max(int(session.conf.get("spark.sql.shuffle.partitions")), 4 * session.sparkContext.defaultParallelism), *unit)


def shift_scores(rows: DataFrame, by: list[str], schema: str, least_shift: Column, n_null: int) -> DataFrame:
    """by, lag, n, r and null: at each lag the correlation of x and y over a group's k, and those of x turned in a circle.

    rows: k, lag, x, y, the same k at all lags. There are n_null turns at most, evenly from `least_shift` (a column of each group,
    in steps of k) to as much less than n. A lag of a group is one unit of work, in which all turns cost one Fourier
    transform. A lag at which a side is flat has r and null null.
    """

    def score(x: np.ndarray, y: np.ndarray, low: int) -> tuple[int, float | None, list[float] | None]:
        n = len(x)
        if not (x.std() > 1e-12 and y.std() > 1e-12):
            return n, None, None
        a, b = (x - x.mean()) / x.std(), (y - y.mean()) / y.std()
        around = np.fft.irfft(np.conj(np.fft.rfft(a)) * np.fft.rfft(b), n) / n  # at s: with x turned by s
        return n, float(around[0]), around[_turns(n, low, n_null)].tolist()

    def scored(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = [score(np.asarray(x, float), np.asarray(y, float), int(low)) for x, y, low in zip(part["x"], part["y"], part["low"], strict=True)]
            yield part[[*by, "lag"]].join(pd.DataFrame(found, columns=["n", "r", "null"], index=part.index).astype({"r": object}))

    series = F.sort_array(F.collect_list(F.struct("k", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))))
    given = _apart(rows.withColumn("low", least_shift), [*by, "lag"]).groupBy(*by, "lag").agg(series.alias("s"), F.first("low").alias("low"))
    given = given.select(*by, "lag", "s.x", "s.y", "low")
    return given.mapInPandas(scored, f"{schema}, lag int, n int, r double, null array<double>")


def lag_test(scores: DataFrame, by: list[str]) -> DataFrame:
    """by, lag, fine, r, r_at_zero, n, p, z, null_p99, peak_ratio and at_edge of the best lag of each group of `shift_scores`.

    fine adds the top of the parabola through the neighbours, within half a step. p is the share of turns, the real one
    counted, whose best r over all lags is r or more; z is r in their standard deviations. peak_ratio compares r with the
    best local maximum outside the peak's lobe, the lags around it with more than r / 2 (where there is none, with the best
    value outside); it is null where nothing outside is over 0. What is equal to twelve digits is equal.
    """
    known = scores.filter("r IS NOT NULL")
    peak = known.groupBy(*by).agg(F.max(F.struct(F.round("r", 12).alias("top"), (-F.col("lag")).alias("first"), "lag", "r", "n")).alias("p")).select(*by, F.col("p.lag").alias("best"), F.col("p.r").alias("r"), F.col("p.n").alias("n"))
    curve = scores.select(*by, "lag", F.col("r").alias("c"))
    w = Window.partitionBy(*by).orderBy("lag")
    rows = curve.withColumns({"before": F.lag("c").over(w), "after": F.lead("c").over(w), "inner": F.lag("lag").over(w).isNotNull() & F.lead("lag").over(w).isNotNull()}).join(peak, by)
    low = (~F.coalesce(F.round(F.col("c") - F.col("r") / 2, 12) > 0, F.lit(False))).cast("int")
    left, right = Window.partitionBy(*by, F.col("lag") <= F.col("best")).orderBy(F.desc("lag")), Window.partitionBy(*by, F.col("lag") >= F.col("best")).orderBy("lag")
    lobe = F.when(F.col("lag") <= F.col("best"), F.sum(low).over(left) == 0).otherwise(F.sum(low).over(right) == 0)
    rows = rows.withColumn("lobe", lobe)
    least = lambda c: F.coalesce(F.round(c, 12), F.lit(float("-inf")))
    hill = F.col("inner") & (F.round("c", 12) >= least(F.col("before"))) & (F.round("c", 12) >= least(F.col("after"))) & ~F.col("lobe")
    at = lambda c: F.max(F.when(F.col("lag") == F.col("best"), F.col(c)))
    found = rows.groupBy(*by).agg(
        F.max(F.when(hill, F.col("c"))).alias("hill"), F.max(F.when(~F.col("lobe"), F.col("c"))).alias("outside"), at("before").alias("before"), at("after").alias("after"),
        F.max(F.when(F.col("lag") == 0, F.col("c"))).alias("r_at_zero"), F.min("lag").alias("low"), F.max("lag").alias("high"),
    )
    turned = known.select(*by, F.posexplode("null").alias("turn", "v")).groupBy(*by, "turn").agg(F.max("v").alias("v")).join(peak.select(*by, "r"), by)
    null = turned.groupBy(*by).agg(F.count(F.lit(1)).alias("m"), F.count_if(F.round("v", 12) >= F.round("r", 12)).alias("over"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd"), F.percentile("v", F.lit(0.99)).alias("null_p99"))
    out = peak.join(found, by).join(null, by, "left")
    second = F.coalesce("hill", "outside")
    bend = F.col("before") - 2 * F.col("r") + F.col("after")
    shift = F.when(F.round(bend, 12) < 0, F.greatest(F.least(0.5 * (F.col("before") - F.col("after")) / bend, F.lit(0.5)), F.lit(-0.5)))
    return out.select(
        *by, F.col("best").alias("lag"), (F.col("best") + F.coalesce(shift, F.lit(0.0))).alias("fine"), "r", "r_at_zero", "n",
        ((1 + F.coalesce("over", F.lit(0))) / (1 + F.coalesce("m", F.lit(0)))).alias("p"), F.try_divide(F.col("r") - F.col("mean"), F.col("sd")).alias("z"), "null_p99",
        F.when(F.round(second, 12) > 0, F.col("r") / second).alias("peak_ratio"), ((F.col("best") <= F.col("low") + 1) | (F.col("best") >= F.col("high") - 1)).alias("at_edge"),
    )


def judged(tests: DataFrame, rule: ClockRule) -> DataFrame:
    """With status, estimated or unsynced, and reason: what fails, in order. Groups without a test are not among them."""
    fails = F.array_compact(F.array(
        F.when(F.col("n") < rule.least_frames, "too few frames"), F.when(F.col("r") < rule.least_r, "low correlation"), F.when(F.col("p") > rule.most_p, "not significant"),
        F.when(F.col("peak_ratio") < rule.least_ratio, "second peak"), F.when(F.col("at_edge"), "peak at the edge"),
    ))
    return tests.withColumn("reason", fails).withColumn("status", F.when(F.size("reason") == 0, "estimated").otherwise("unsynced"))


def _moved(a: np.ndarray, b: np.ndarray, lags: np.ndarray, t: np.ndarray, *sums: np.ndarray) -> Iterator[tuple]:
    """Some intervals from a to b at a time: which, and for each lag (a row) their starts and ends less it, and what each of the sums
    over t gains in them. Most ends are the next one's start: each time is looked up once."""
    some = max(1, VALUES_AT_ONCE // len(lags))
    for k in range(0, len(a), some):
        part = slice(k, k + some)
        times, where = np.unique(np.concatenate([a[part], b[part]]), return_inverse=True)
        first, last = np.split(where, 2)
        x = times - lags[:, None]
        near = slice(max(0, np.searchsorted(t, x.min(), "right") - 1), np.searchsorted(t, x.max(), "left") + 1)
        at = (np.interp(x.ravel(), t[near], s[near]).reshape(x.shape) for s in sums)
        yield part, x[:, first], x[:, last], *(v[:, last] - v[:, first] for v in at)


def clock_scores(frames: DataFrame, paths: DataFrame, by: list[str], key: list[str], schema: str, rule: ClockRule) -> DataFrame:
    """by, key, lag, n, r and null as of `shift_scores`, for each group of frames (by and key; k, a, b, motion) against its series'
    turning path (by; t, path, valid): roots of motion and of the mean turning speed from a to b, less each lag.

    Only frames count whose time is covered at every lag, and only groups that have enough of them. A series meets its path
    once; some lags of it are one unit of work, so that what is written grows with the frames, not with frames times lags.
    `lag_test` takes each turn's best over all lags: a unit's best stand at its first lag with r, and the others have none.
    """
    every, units = np.arange(-rule.lags, rule.lags + 1), -(-(2 * rule.lags + 1) // LAGS_A_UNIT)
    lags_of = lambda unit: every[LAGS_A_UNIT * unit : LAGS_A_UNIT * (unit + 1)]
    numbers = lambda part, *cols: zip(*([np.asarray(v, float) for v in part[c]] for c in cols), strict=True)

    def covered(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            bits = []
            for unit, (a, b, t, path, valid) in zip(part["unit"], numbers(part, "a", "b", "t", "path", "valid"), strict=True):
                ok = np.zeros(len(a), bool)
                for part_of, start, end, time, angle in _moved(a, b, lags_of(unit) * rule.step, t, valid, path):
                    ok[part_of] = ((start >= t[0]) & (end <= t[-1]) & (time / (end - start) >= rule.least_valid) & np.isfinite(angle)).all(axis=0)
                bits.append(np.packbits(ok).tobytes())
            yield part[by].assign(ok=bits)

    def tested(a: np.ndarray, b: np.ndarray, motion: np.ndarray, t: np.ndarray, path: np.ndarray, lags: np.ndarray) -> list[tuple]:
        """lag, n, r, null of a group's covered frames; nothing if they are too few or motion is flat. Sums over the frames, some at
        a time, of the product of speed at all lags with motion in all turns give the correlations."""
        n, x = len(a), np.sqrt(motion)
        low = int(np.ceil(max(rule.least_shift, 2 * rule.most_lag) / np.median(b - a))) if n else 0
        if n < max(rule.least_frames, 4 * low, 1) or not x.std() > 1e-12:
            return []
        x = np.tile((x - x.mean()) / x.std(), 2)
        turns = [0, *_turns(n, low, rule.n_null)]
        both, once, twice, usual = np.zeros((len(lags), len(turns))), 0.0, 0.0, None
        for part, start, end, angle in _moved(a, b, lags * rule.step, t, path):
            y = np.sqrt(np.maximum(angle / (end - start), 0))
            usual = y.mean(axis=1, keepdims=True) if usual is None else usual
            y -= usual
            once, twice = once + y.sum(axis=1), twice + (y * y).sum(axis=1)
            both += y @ np.stack([x[n - s + part.start :][: y.shape[1]] for s in turns]).T
        sd = np.sqrt(np.maximum(twice / n - (once / n) ** 2, 0))
        moves = sd > 1e-12
        r = both[moves] / (n * sd[moves, None])
        best = iter([r[:, 1:].max(axis=0).tolist()] if len(r) else [])
        found = dict(zip(lags[moves].tolist(), r[:, 0].tolist(), strict=True))
        return [(int(lag), n, found.get(int(lag)), next(best, []) if int(lag) in found else []) for lag in lags]

    def scored(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            names = list(zip(*(part[c] for c in by), strict=True))
            keys = list(zip(*(part[f"in_{c}"] for c in key), strict=True)) or [()] * len(part)
            for name, of, bits, unit, (a, b, motion, t, path) in zip(names, keys, part["ok"], part["unit"], numbers(part, "a", "b", "motion", "t", "path"), strict=True):
                ok = np.unpackbits(np.bitwise_and.reduce([np.frombuffer(x, np.uint8) for x in bits]), count=len(a)).astype(bool)
                new = reduce(np.logical_or, [np.asarray(v)[1:] != np.asarray(v)[:-1] for v in of], np.zeros(len(a) - 1, bool))
                starts = [0, *(np.flatnonzero(new) + 1)]
                for start, end in zip(starts, [*starts[1:], len(a)], strict=True):
                    at = start + np.flatnonzero(ok[start:end])
                    rows += [(*name, *(v[start] for v in of), *x) for x in tested(a[at], b[at], motion[at], t, path, lags_of(unit))]
            yield pd.DataFrame(rows, columns=[*by, *key, "lag", "n", "r", "null"]).astype({"r": object})

    frame, sample = F.struct(*key, "k", "a", "b", "motion"), F.struct("t", "path", "valid")
    given = frames.groupBy(*by).agg(F.sort_array(F.collect_list(frame)).alias("f"))
    given = given.join(paths.filter("t IS NOT NULL AND NOT isnan(t)").groupBy(*by).agg(F.sort_array(F.collect_list(sample)).alias("s")), by)
    given = settled(given.select(*by, *(F.col(f"f.{c}").alias(f"in_{c}") for c in key), "f.a", "f.b", "f.motion", "s.t", "s.path", "s.valid"))
    parts = lambda df: _apart(df.withColumn("unit", F.explode(F.sequence(F.lit(0), F.lit(units - 1)))), [*by, "unit"])
    names = StructType([*given.select(*by).schema.fields, StructField("ok", BinaryType())])
    bits = parts(given.select(*by, "a", "b", "t", "path", "valid")).mapInPandas(covered, names).groupBy(*by).agg(F.collect_list("ok").alias("ok"))
    return parts(given.drop("valid").join(bits, by)).mapInPandas(scored, f"{schema}, lag int, n int, r double, null array<double>")


def clock_offsets(frames: DataFrame, paths: DataFrame, by: list[str], key: list[str], schema: str, rule: ClockRule) -> DataFrame:
    """The judged lag test of each group of frames (by and key; t, motion) against its series' turning paths (by).

    motion is the camera's between a frame and the one before. At each lag the sensor's mean turning speed over that time,
    less the lag, is compared with it, both as roots, over the frames that have one at every lag.
    """
    group = [*by, *key]
    w = Window.partitionBy(*group).orderBy("t")
    known = frames.filter("t IS NOT NULL").withColumns({"a": F.lag("t").over(w), "k": F.row_number().over(w)}).filter("t > a AND NOT isnan(t) AND motion >= 0 AND NOT isnan(motion)")
    scores = settled(clock_scores(known.withColumnRenamed("t", "b"), paths, by, key, schema, rule))
    return judged(lag_test(scores, group), rule).withColumn("offset", F.col("fine") * rule.step)


def sensor_clock(frames: DataFrame, samples: DataFrame, by: list[str], schema: str, most_gap: float, rule: ClockRule = ClockRule()) -> DataFrame:
    """by, status, reason, offset, drift_ppm, r, p, z, peak_ratio, n, drift_check and spread: stream time = (1 + drift) x sensor
    time + offset, one row for each series with frames.

    The offset of the whole is tested by `clock_offsets`, and again in windows of the recording, two of them or, from three
    least windows on, as many as fit, three at least. Windows that agree within half a frame's period confirm it. If they
    don't, a line through them is taken where it has windows enough, residuals and uncertainty over the whole within that
    half period and a slope within `most_ppm`; else the drift is suspected and no offset is to be applied.
    """
    paths = settled(angular_path(samples, by, most_gap))
    whole = settled(clock_offsets(frames, paths, by, [], schema, rule))
    span = frames.filter("t IS NOT NULL").groupBy(*by).agg(F.min("t").alias("t0"), (F.max("t") - F.min("t")).alias("time"), F.count(F.lit(1)).alias("n_all"))
    parts = F.when(F.col("time") < 2 * rule.least_window, 0).when(F.col("time") < 3 * rule.least_window, 2).otherwise(F.greatest(F.lit(3), F.floor(F.col("time") / rule.drift_window))).cast("int")
    span = span.withColumn("windows", parts)
    tried = span.join(whole.filter("status = 'estimated'").select(*by), by, "left_semi").filter("windows > 0")
    inside = frames.join(tried, by).withColumn("width", F.col("time") / F.col("windows"))
    place = F.least(F.floor((F.col("t") - F.col("t0")) / F.col("width")), F.col("windows") - 1).cast("int")
    inside = inside.select(*frames.columns, "t0", "width", place.alias("win"))
    own = clock_offsets(inside.select(*frames.columns, "win"), paths, by, ["win"], f"{schema}, win int", rule)
    own = settled(own.filter("status = 'estimated'"))
    places = own.join(tried, by).withColumn("centre", F.col("t0") + (F.col("win") + 0.5) * F.col("time") / F.col("windows")).withColumn("s", F.col("centre") - F.col("offset"))
    line = places.groupBy(*by).agg(
        F.count(F.lit(1)).alias("good"), (F.max("offset") - F.min("offset")).alias("spread"), F.regr_slope("offset", "s").alias("slope"), F.regr_intercept("offset", "s").alias("at_zero"), F.regr_sxx("offset", "s").alias("sxx"),
    )
    rest = places.join(line, by).withColumn("e", F.col("offset") - F.col("slope") * F.col("s") - F.col("at_zero")).groupBy(*by).agg(F.max(F.abs("e")).alias("most_rest"), F.sum(F.col("e") * F.col("e")).alias("sse"))
    out = span.join(whole, by, "left").join(line, by, "left").join(rest, by, "left")
    half = 0.5 * F.col("time") / (F.col("n_all") - 1)
    error = F.when(F.col("good") > 2, F.sqrt(F.col("sse") / (F.col("good") - 2)) / F.sqrt("sxx"))
    fits = F.coalesce((F.col("good") >= rule.least_fit_windows) & (F.col("most_rest") <= half) & (error * F.col("time") <= half) & (F.abs("slope") * 1e6 <= rule.most_ppm), F.lit(False))
    estimated = F.col("status") == "estimated"
    check = (
        F.when(~F.coalesce(estimated, F.lit(False)) | (F.col("windows") == 0), "not run").when(F.coalesce("good", F.lit(0)) < 2, "unverified").when(F.col("spread") <= half, "consistent")
        .when(fits, "drift fitted").otherwise("drift suspected")
    )
    out = out.withColumn("drift_check", check)
    drifted = F.col("drift_check") == "drift fitted"
    return out.select(
        *by, F.when(F.col("drift_check") == "drift suspected", "drift_suspected").otherwise(F.coalesce("status", F.lit("unsynced"))).alias("status"),
        F.coalesce("reason", F.array(F.lit("too few frames"))).alias("reason"), F.when(drifted, F.col("at_zero")).otherwise(F.col("offset")).alias("offset"),
        F.when(drifted, F.col("slope") * 1e6).otherwise(0.0).alias("drift_ppm"), "r", "p", "z", "peak_ratio", "n", "drift_check", "spread",
    )


#: Lengths of upper arm, forearm and hand, and where the shoulders are, in metres; y is up.
ARM = (0.30, 0.26, 0.10)
SHOULDERS = {"left": (-0.18, 1.40, 0.0), "right": (0.18, 1.40, 0.0)}
JOINTS = ("shoulder", "elbow", "wrist", "fingertip")


def axes(q: list[Column]) -> tuple[list[Column], list[Column]]:
    """Where a sensor's y and z axes point in the scene: x to the left, y up, z ahead of a sensor at rest."""
    turn = g.unit_rotation(q)
    along = lambda k: [-turn[k], turn[6 + k], turn[3 + k]]
    return along(1), along(2)


def without_heading(v: list[Column], yaw: Column) -> list[Column]:
    """v turned back by the heading, about the upward axis."""
    c, s = F.cos(yaw), F.sin(yaw)
    return [c * v[0] - s * v[2], v[1], s * v[0] + c * v[2]]


def arm_chain(slots: DataFrame, by: list[str], names: dict[str, tuple[str, str, str]], chest: str = "chest") -> DataFrame:
    """by, side, valid, hand_valid, yaw, flexion and x, y, z of shoulder, elbow, wrist and fingertip, for each instant and side.

    slots: by, slot, qx..qw, one row for each sensor (null or absent where it has no valid sample). names: a side's upper arm,
    forearm and hand. The heading is that of the chest's upward axis. A side needs its arm's sensors and the chest's; the
    fingertip needs the hand's too; what is not valid is null. flexion is the angle between upper arm and forearm, in degrees.
    """
    q = ("qx", "qy", "qz", "qw")
    every = [chest, *(s for side in names.values() for s in side)]
    pick = {s: F.max(F.when(F.col("slot") == s, F.struct(*q))) for s in dict.fromkeys(every)}
    wide = slots.filter(" AND ".join(f"{c} IS NOT NULL" for c in q)).groupBy(*by).agg(*(c.alias(f"s_{s}") for s, c in pick.items()))
    of = lambda s: [F.col(f"s_{s}").getField(c) for c in q]
    up = axes(of(chest))[1]
    yaw = F.atan2(up[0], up[2])
    parts = []
    for side, (upper, lower, hand) in names.items():
        ok = F.col(f"s_{upper}").isNotNull() & F.col(f"s_{lower}").isNotNull() & F.col(f"s_{chest}").isNotNull()
        ways = [without_heading(axes(of(s))[0], yaw) for s in (upper, lower, hand)]
        at = [F.lit(x) for x in SHOULDERS[side]]
        points = [at]
        for length, way in zip(ARM, ways, strict=True):
            at = [p + length * d for p, d in zip(at, way, strict=True)]
            points.append(at)
        angle = F.degrees(F.acos(F.greatest(F.least(g.dot(ways[0], ways[1]), F.lit(1.0)), F.lit(-1.0))))
        hold = {f"{joint}_{c}": F.when(ok, p[i]) for joint, p in zip(JOINTS, points, strict=True) for i, c in enumerate("xyz")}
        parts.append(wide.select(*by, F.lit(side).alias("side"), ok.alias("valid"), (ok & F.col(f"s_{hand}").isNotNull()).alias("hand_valid"), F.when(ok, yaw).alias("yaw"), F.when(ok, angle).alias("flexion"), *(c.alias(n) for n, c in hold.items())))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
