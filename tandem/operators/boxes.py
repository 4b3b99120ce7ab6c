"""Detected boxes: x0, y0, x1, y1, conf, slot, name. Boxes meet only inside a frame, by equality."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tandem.functions import scalar as s

EDGES = ("x0", "y0", "x1", "y1")


def _box(side: str = "") -> list:
    return [F.col(f"{side}{e}") for e in EDGES]


def _side(df: DataFrame, by: list[str], name: str) -> DataFrame:
    return df.select(*by, *(F.col(c).alias(f"{name}_{c}") for c in ("slot", "conf", *EDGES)))


def overlapping_pairs(boxes: DataFrame, by: list[str], least_iou: float, least_contained: float) -> DataFrame:
    """Pairs of slots whose boxes share more than least_iou of their union or least_contained of the smaller one."""
    a, b = _box("a_"), _box("b_")
    both = _side(boxes, by, "a").join(_side(boxes, by, "b"), by).filter("a_slot < b_slot")
    out = both.withColumns({"iou": s.iou(a, b), "contained": F.try_divide(s.intersection(a, b), F.least(s.area(a), s.area(b)))})
    return out.filter((F.col("iou") > least_iou) | (F.col("contained") > least_contained)).select(*by, "a_slot", "b_slot", "iou", "contained")


def smallest_around(points: DataFrame, boxes: DataFrame, by: list[str], share: float) -> DataFrame:
    """For every point (px, py) the smallest box that holds it once grown by `share`; of equal ones the lower slot."""
    fits = points.join(boxes, by).filter(s.inside(F.col("px"), F.col("py"), s.grow(_box(), share)))
    return fits.groupBy(*by, "px", "py").agg(F.min(F.struct(s.area(_box()).alias("area"), "slot", "name")).alias("b")).select(*by, "px", "py", "b.*")


def contact_candidates(hands: DataFrame, boxes: DataFrame, by: list[str], least: int = 3, share: float = 0.1, palm_share: float = 0.2, depth_tolerance: float | None = None) -> DataFrame:
    """What each hand touches in its frame: of the boxes that, larger by `share` about their centre, hold at least `least` of
    its tips or its palm, the smallest (of equal ones the lower slot): slot, name and score, null and 0 where there is none.

    hands: hand, tips (array of x, y), palm (x, y), z (depth, null if unknown); a hand without tips touches nothing. boxes:
    slot, corners, conf, name, z. With a tolerance, boxes whose known depth is further than that from the hand's are left
    out. The score is the share of tips inside, or palm_share for the palm alone, by the box's confidence.
    """
    grown = s.grow(_box(), share / 2)
    n_in = F.size(F.filter("tips", lambda t: s.inside(t["x"], t["y"], grown)))
    met = hands.filter("tips IS NOT NULL").select(*by, "hand", "tips", "palm", F.col("z").alias("hand_z")).join(boxes.filter("conf IS NOT NULL AND name IS NOT NULL"), by)
    met = met.withColumns({"n_in": n_in, "palm_in": F.coalesce(s.inside(F.col("palm.x"), F.col("palm.y"), grown), F.lit(False))}).filter((F.col("n_in") >= least) | F.col("palm_in"))
    if depth_tolerance is not None:
        met = met.filter(F.coalesce(F.abs(F.col("z") - F.col("hand_z")) <= depth_tolerance, F.lit(True)))
    score = F.greatest(F.col("n_in") / F.size("tips"), F.when(F.col("palm_in"), palm_share).otherwise(0.0)) * F.col("conf")
    best = met.groupBy(*by, "hand").agg(F.min(F.struct(s.area(_box()).alias("area"), "slot", "name", score.alias("score"))).alias("b"))
    return hands.select(*by, "hand").join(best, [*by, "hand"], "left").select(*by, "hand", "b.slot", "b.name", F.coalesce("b.score", F.lit(0.0)).alias("score"))


def plausible(boxes: DataFrame, by: list[str], largest: float, sure: float) -> DataFrame:
    """Boxes of at most `largest` area that are sure (conf >= sure) or touch a sure one."""
    small = boxes.filter(s.area(_box()) <= largest)
    strong = _side(small.filter(F.col("conf") >= sure), by, "b").drop("b_slot", "b_conf")
    near = [small[c] == strong[c] for c in by] + [s.touches([small[e] for e in EDGES], _box("b_"))]
    backed = small.filter(F.col("conf") < sure)
    return small.filter(F.col("conf") >= sure).unionByName(backed.join(strong, near, "left_semi"))


def switch_flags(boxes: DataFrame, by: list[str]) -> DataFrame:
    """switched: a slot's centre jumps by over 40 % of its width while both frames hold two boxes or more."""
    w = Window.partitionBy(*by, "slot").orderBy("frame", "x0", "y0", "x1")
    counted = boxes.join(boxes.groupBy(*by, "frame").agg(F.count(F.lit(1)).alias("n")), [*by, "frame"])
    centre = (F.col("x0") + F.col("x1")) / 2
    jump = F.round(F.abs(centre - F.lag(centre).over(w)) - 0.4 * (F.col("x1") - F.col("x0")), 6) > 0
    return counted.select(*by, "frame", "slot", F.coalesce(jump & (F.col("n") >= 2) & (F.lag("n").over(w) >= 2), F.lit(False)).alias("switched"))


def nms(boxes: DataFrame, by: list[str], limit: float) -> DataFrame:
    """Greedy suppression inside a frame: the surest box (of equal ones the lower slot) drops those that share over `limit`
    of their union with it, and so on. A frame's boxes are few and are folded in one sorted array."""
    row = F.struct((-F.col("conf")).alias("rank"), "slot", *EDGES)
    sorted_boxes = F.sort_array(F.collect_list(row))
    box = lambda r: [r[e] for e in EDGES]
    grouped = boxes.groupBy(*by).agg(sorted_boxes.alias("all"))
    empty = F.slice("all", 1, 0)
    kept = F.aggregate("all", empty, lambda acc, b: F.when(F.exists(acc, lambda k: s.iou(box(k), box(b)) > limit), acc).otherwise(F.concat(acc, F.array(b))))
    return grouped.select(*by, F.explode(kept).alias("k")).select(*by, "k.slot", (-F.col("k.rank")).alias("conf"))
