"""Who is who: tracks of a stream, tracks and projected bodies, tracks of two views. Assignments are one to one at least cost."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tandem.functions.scalar import hist_distance

#: Sides of up to this many are enumerated: 24 choices at most.
MOST = 4


def choices(most: int) -> list[tuple[int, int, int, int, int]]:
    """n_a, n_b, choice, i, j: of every size of both sides all ways to give each member of the smaller one a member of the larger."""
    out = []
    for n_a, n_b in itertools.product(range(1, most + 1), repeat=2):
        for k, taken in enumerate(itertools.permutations(range(max(n_a, n_b)), min(n_a, n_b))):
            out += [(n_a, n_b, k, i, j) if n_a <= n_b else (n_a, n_b, k, j, i) for i, j in enumerate(taken)]
    return out


def assignments(costs: DataFrame, by: list[str], a: str, b: str, cost: str, most: int = MOST) -> DataFrame:
    """by, a, b, cost, total and margin of every group's one-to-one assignment at the least total cost.

    costs: a row for each pair of a group's a and b. Of totals equal to nine digits the choice that comes first in order of a and b is taken.
    margin is what the second best choice costs more, null where there is no other. A group with more than `most` on a side
    is refused: one row with a, b and cost null, whose total and margin are null too.
    """
    place = lambda c: (F.dense_rank().over(Window.partitionBy(*by).orderBy(c)) - 1).alias
    rows = costs.select(*by, a, b, F.col(cost).alias("cost"), place(a)("i"), place(b)("j"))
    sizes = rows.groupBy(*by).agg((F.max("i") + 1).alias("n_a"), (F.max("j") + 1).alias("n_b"))
    fits = (F.col("n_a") <= most) & (F.col("n_b") <= most)
    ways = F.broadcast(costs.sparkSession.createDataFrame(choices(most), "n_a int, n_b int, choice int, i int, j int"))  # some 1 000 rows for 4
    tried = rows.join(sizes.filter(fits), by).join(ways, ["n_a", "n_b", "i", "j"]).select(*by, a, b, "cost", "choice")
    totals = tried.groupBy(*by, "choice").agg(F.sum("cost").alias("total"))
    w = Window.partitionBy(*by).orderBy(F.round("total", 9), "choice")
    best = totals.withColumns({"k": F.row_number().over(w), "margin": F.lead("total").over(w) - F.col("total")}).filter("k = 1").drop("k")
    out = tried.join(best, [*by, "choice"]).select(*by, a, b, "cost", "total", "margin")
    kinds = dict(out.dtypes)
    refused = sizes.filter(~fits).select(*by, *(F.lit(None).cast(kinds[c]).alias(c) for c in (a, b, "cost", "total", "margin")))
    return out.unionByName(refused)


def keypoint_distance(track: Column, body: Column, seen: float, least: int) -> Column:
    """Mean distance of a track's keypoints (x, y, conf) from a body's projected ones (x, y), over those that the track shows
    with more than `seen` and the body has; null with fewer than `least`."""
    both = F.filter(F.arrays_zip(track.alias("t"), body.alias("b")), lambda p: p["t"]["conf"].isNotNull() & (p["t"]["conf"] > seen) & p["t"]["x"].isNotNull() & p["b"]["x"].isNotNull() & p["b"]["y"].isNotNull())
    apart = F.transform(both, lambda p: F.hypot(p["t"]["x"] - p["b"]["x"], p["t"]["y"] - p["b"]["y"]))
    return F.when(F.size(apart) >= least, F.aggregate(apart, F.lit(0.0), lambda s, x: s + x) / F.size(apart))


def match_tracks(tracks: DataFrame, bodies: DataFrame, by: list[str], width: float, seen: float = 0.3, least_points: int = 5, least: int = 5, most: float = 0.1) -> DataFrame:
    """by, track, body, n and distance: tracks and bodies that are the same person.

    tracks: frame, track, t (keypoints x, y, conf); bodies: frame, body, b (projected keypoints x, y, null where unknown). The
    cost of a pair is the mean over common frames of `keypoint_distance` over the image's width, 1 without any; the assignment
    has the least total; pairs of it count with `least` frames and a distance under `most`.
    """
    met = tracks.join(bodies, [*by, "frame"]).select(*by, "track", "body", (keypoint_distance(F.col("t"), F.col("b"), seen, least_points) / width).alias("d"))
    pairs = met.groupBy(*by, "track", "body").agg(F.count("d").alias("n"), F.avg("d").alias("distance"))
    every = tracks.select(*by, "track").distinct().join(bodies.select(*by, "body").distinct(), by)  # few of a group meet few
    costs = every.join(pairs, [*by, "track", "body"], "left").select(*by, "track", "body", F.coalesce("n", F.lit(0)).alias("n"), "distance", F.coalesce("distance", F.lit(1.0)).alias("cost"))
    chosen = assignments(costs, by, "track", "body", "cost").select(*by, "track", "body")
    return chosen.join(costs, [*by, "track", "body"]).filter((F.col("n") >= least) & (F.col("distance") < most)).select(*by, "track", "body", "n", "distance")


def cross_view(tracks: DataFrame, looks: DataFrame, by: list[str], a: str, b: str, unsure: float = 0.1) -> DataFrame:
    """by, track_a, track_b, ratio, appearance, cost, margin, ambiguous and, of all pairs of the assignment together, n_covisible,
    same, mirrored and orientation: which tracks of two streams are the same person.

    tracks: stream, frame, track, x. looks: stream, track, hist. A pair costs its appearance distance and 1 less the share of
    the frames with either that have both; an assignment is ambiguous if the next best one costs less than `unsure` more. In
    frames that show two pairs or more, their order from the left is the same in both views, mirrored, or neither.
    """
    frames = tracks.groupBy(*by, "stream", "track", "frame").agg(F.min("x").alias("x"))
    side = lambda df, s, n, *cols: df.filter(F.col("stream") == s).select(*by, F.col("track").alias(f"track_{n}"), *cols)
    fa, fb = side(frames, a, "a", "frame", F.col("x").alias("x_a")), side(frames, b, "b", "frame", F.col("x").alias("x_b"))
    size_a, size_b = (f.groupBy(*by, f"track_{n}").agg(F.count(F.lit(1)).alias(f"size_{n}")) for f, n in ((fa, "a"), (fb, "b")))
    met = fa.join(fb, [*by, "frame"])
    both = met.groupBy(*by, "track_a", "track_b").agg(F.count(F.lit(1)).alias("n"))
    pairs = size_a.join(size_b, by).join(both, [*by, "track_a", "track_b"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    for s, n in ((a, "a"), (b, "b")):
        pairs = pairs.join(side(looks, s, n, F.col("hist").alias(f"hist_{n}")), [*by, f"track_{n}"], "left")
    pairs = pairs.withColumns({"ratio": F.col("n") / (F.col("size_a") + F.col("size_b") - F.col("n")), "appearance": F.coalesce(hist_distance(F.col("hist_a"), F.col("hist_b")), F.lit(0.5))})
    pairs = pairs.select(*by, "track_a", "track_b", "ratio", "appearance", (F.col("appearance") + 1 - F.col("ratio")).alias("own_cost"))
    chosen = assignments(pairs, by, "track_a", "track_b", "own_cost").drop("total")
    shown = met.join(chosen.select(*by, "track_a", "track_b"), [*by, "track_a", "track_b"])
    order = lambda x: F.transform(F.sort_array(F.collect_list(F.struct(x, "track_a"))), lambda p: p["track_a"])
    rows = shown.groupBy(*by, "frame").agg(F.count(F.lit(1)).alias("n"), order("x_a").alias("in_a"), order("x_b").alias("in_b")).filter("n >= 2")
    same, mirrored = F.col("in_a") == F.col("in_b"), F.col("in_a") == F.reverse("in_b")
    lr = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n_covisible"), F.avg(same.cast("double")).alias("same"), F.avg(mirrored.cast("double")).alias("mirrored"))
    out = chosen.join(pairs, [*by, "track_a", "track_b"], "left").join(lr, by, "left")
    way = F.when(F.col("n_covisible").isNull(), "unknown").when(F.col("same") >= F.col("mirrored"), "same").otherwise("mirrored")
    return out.select(
        *by, "track_a", "track_b", "ratio", "appearance", "cost", "margin", F.coalesce(F.col("margin") < unsure, F.lit(False)).alias("ambiguous"),
        F.coalesce("n_covisible", F.lit(0)).alias("n_covisible"), "same", "mirrored", way.alias("orientation"),
    )


#: Up to this many columns plain numbers are faster than arrays.
FEW = 48


def least_cost(cost: np.ndarray) -> list[tuple[int, int]]:
    """The one-to-one assignment of rows to columns at least total cost: each row in turn finds the cheapest chain of changes,
    by prices of rows and columns that keep every reduced cost at 0 or more."""
    turned = cost.shape[0] > cost.shape[1]
    c = cost.T if turned else cost
    m = c.shape[1]
    owner = _owners_of_few(c.tolist(), m) if m <= FEW else _owners(c)
    pairs = [(int(owner[j]), j) for j in range(m) if owner[j] >= 0]
    return sorted((j, i) if turned else (i, j) for i, j in pairs)


def _owners(c: np.ndarray) -> np.ndarray:
    """The row of each column or -1, and one number more."""
    n, m = c.shape
    row_price, col_price = np.zeros(n), np.zeros(m + 1)
    owner = np.full(m + 1, -1)  # the row of each column; the last one is where a row begins
    for row in range(n):
        owner[m], at = row, m
        slack, came, done = np.full(m, np.inf), np.full(m, m), np.zeros(m + 1, bool)
        while owner[at] >= 0:
            done[at] = True
            reduced = c[owner[at]] - row_price[owner[at]] - col_price[:m]
            better = ~done[:m] & (reduced < slack)
            slack[better], came[better] = reduced[better], at
            nearest = int(np.argmin(np.where(done[:m], np.inf, slack)))
            step = slack[nearest]
            row_price[owner[done]] += step
            col_price[done] -= step
            slack[~done[:m]] -= step
            at = nearest
        while at != m:
            owner[at], at = owner[came[at]], came[at]
    return owner


def _owners_of_few(c: list[list[float]], m: int) -> list[int]:
    """The same, column by column."""
    row_price, col_price = [0.0] * len(c), [0.0] * (m + 1)
    owner = [-1] * (m + 1)
    for row in range(len(c)):
        owner[m], at = row, m
        slack, came, free, done = [float("inf")] * m, [m] * m, list(range(m)), []
        while owner[at] >= 0:
            done.append(at)
            if at < m:
                free.remove(at)
            costs, price = c[owner[at]], row_price[owner[at]]
            nearest, step = 0, float("inf")
            for j in free:
                reduced = costs[j] - price - col_price[j]
                if reduced < slack[j]:
                    slack[j], came[j] = reduced, at
                if slack[j] < step:
                    nearest, step = j, slack[j]
            for j in done:
                row_price[owner[j]] += step
                col_price[j] -= step
            for j in free:
                slack[j] -= step
            at = nearest
        while at != m:
            owner[at], at = owner[came[at]], came[at]
    return owner


def overlaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Intersection over union of each of some boxes with each of others."""
    a, b = a[:, None], b[None]
    side = np.maximum(np.minimum(a[..., 2:], b[..., 2:]) - np.maximum(a[..., :2], b[..., :2]), 0.0)
    shared = side[..., 0] * side[..., 1]
    union = (a[..., 2] - a[..., 0]) * (a[..., 3] - a[..., 1]) + (b[..., 2] - b[..., 0]) * (b[..., 3] - b[..., 1]) - shared
    return np.divide(shared, union, out=np.zeros_like(shared), where=union > 0)


def looks_all_apart(a: list[np.ndarray | None], b: list[np.ndarray | None]) -> np.ndarray:
    """Bhattacharyya distance of each of some histograms from each of others, 0.5 where one is unknown or empty."""
    out = np.full((len(a), len(b)), 0.5)
    rows, cols = ([k for k, h in enumerate(side) if h is not None] for side in (a, b))
    if rows and cols:
        x, y = np.array([a[k] for k in rows])[:, None], np.array([b[k] for k in cols])[None]
        size_x, size_y = x.sum(-1), y.sum(-1)
        some = (size_x > 0) & (size_y > 0)
        close = np.divide(np.sqrt(x * y).sum(-1), np.sqrt(np.where(some, size_x * size_y, 1.0)))
        out[np.ix_(rows, cols)] = np.where(some, np.sqrt(np.maximum(0.0, 1 - close)), 0.5)
    return out


def overlap(a: np.ndarray, b: np.ndarray) -> float:
    """`overlaps` of two boxes."""
    return float(overlaps(a[None], b[None])[0, 0])


def looks_apart(a: np.ndarray | None, b: np.ndarray | None) -> float:
    """`looks_all_apart` of two histograms."""
    return float(looks_all_apart([a], [b])[0, 0])


def link_tracks(
    boxes: DataFrame, by: list[str], schema: str, memory: int, least: int, most_tracks: int = 4, most_cost: float = 1.4, weights: tuple[float, float] = (1.0, 1.0),
    most_ahead: int = 5, learn_velocity: float = 0.5, learn_look: float = 0.15,
) -> DataFrame:
    """by, frame, slot and track of the boxes (frame, slot, x0, y0, x1, y1, hist) that belong to a stream's longest tracks.

    In each frame boxes meet the tracks seen in the last `memory` frames by the assignment of least total cost: weighted, 1
    less the overlap with where the track is expected, and the distance of appearances; pairs over `most_cost` stay apart. A
    track is expected where its velocity takes it in up to `most_ahead` frames. The velocity is a moving average of steps
    from one frame to the next, and 0 after a gap; the appearance is one of histograms. Tracks of fewer than `least` boxes
    go; of the others the `most_tracks` longest stay, numbered by length, then start. A stream is sequential and worked on
    as a whole, streams side by side; tracks past memory are closed, so that a frame costs the same late in a stream.
    """
    has_look = "hist" in boxes.columns

    def fold(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["frame", "slot", "x0", "y0"], kind="stable")
        corners = part[["x0", "y0", "x1", "y1"]].to_numpy(float)
        looks = [None if h is None else np.asarray(h, float) for h in part["hist"]] if has_look else [None] * len(part)
        frames, owner = part["frame"].to_numpy(), np.zeros(len(part), np.int64)
        starts = np.append(np.flatnonzero(np.diff(frames, prepend=frames[0] - 1)), len(part))
        alive: list[dict] = []
        n = 0
        for low, high in zip(starts, starts[1:], strict=False):
            now = frames[low]
            alive = [t for t in alive if now - t["seen"] <= memory]
            taken: dict[int, dict] = {}
            if alive:
                ahead = np.array([t["box"] for t in alive]) + np.array([t["velocity"] for t in alive]) * np.array([[min(now - t["seen"], most_ahead)] for t in alive])
                cost = weights[0] * (1 - overlaps(ahead, corners[low:high])) + weights[1] * looks_all_apart([t["look"] for t in alive], looks[low:high])
                taken = {low + j: alive[i] for i, j in least_cost(cost) if cost[i, j] <= most_cost}
            for k in range(low, high):
                t = taken.get(k)
                if t is None:
                    t = {"id": n, "box": corners[k], "velocity": np.zeros(4), "look": looks[k], "seen": now}
                    n += 1
                    alive.append(t)
                else:
                    step = corners[k] - t["box"]
                    t["velocity"] = (1 - learn_velocity) * t["velocity"] + learn_velocity * step if now - t["seen"] == 1 else np.zeros(4)
                    if looks[k] is not None:
                        t["look"] = looks[k] if t["look"] is None else (1 - learn_look) * t["look"] + learn_look * looks[k]
                    t["box"], t["seen"] = corners[k], now
                owner[k] = t["id"]
        ids, first, size = np.unique(owner, return_index=True, return_counts=True)
        long = [t for t in np.lexsort((ids, frames[first], -size)) if size[t] >= least][:most_tracks]
        rank = np.full(n, -1)
        rank[ids[long]] = np.arange(len(long))
        track = rank[owner]
        kept = track >= 0
        return pd.DataFrame({**{c: [part[c].iloc[0]] * int(kept.sum()) for c in by}, "frame": frames[kept], "slot": part["slot"].to_numpy()[kept], "track": track[kept]})

    return boxes.groupBy(*by).applyInPandas(fold, f"{schema}, frame long, slot int, track long")
