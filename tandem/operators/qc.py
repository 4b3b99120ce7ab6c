"""Quality rules: evidence, thresholds, statuses, grades and rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tandem.functions import geometry as g


def presence(conf: Column, absent: float = -1.0) -> tuple[Column, Column]:
    """State and confidence: the sentinel means absent (no confidence), 0 is present; others are clipped to 0..1."""
    there = conf.isNotNull() & (conf != absent)
    return F.when(there, "present").when(conf.isNull(), "unknown").otherwise("missing"), F.when(there, F.greatest(F.least(conf, F.lit(1.0)), F.lit(0.0)))


def clean_quaternions(df: DataFrame, by: list[str], q: list[str]) -> DataFrame:
    """Finite quaternions of length 0.5 to 1.5, normalised; of repeated times the first row stays."""
    v = g.cols(*q)
    n = g.norm(v)
    w = Window.partitionBy(*by, "t").orderBy("idx")
    kept = df.filter(n.isNotNull() & ~F.isnan(n) & (n > 0.5) & (n < 1.5)).withColumn("k", F.row_number().over(w)).filter("k = 1").drop("k")
    return kept.withColumns(dict(zip(q, g.normalized(v), strict=True)))


def dominant(df: DataFrame, by: list[str], key: str) -> DataFrame:
    """The commonest key of every series; of equally common ones the least."""
    counts = df.groupBy(*by, key).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*by).agg(F.min(F.struct(-F.col("n"), F.col(key).alias("k"))).alias("m")).select(*by, F.col("m.k").alias(key))


def shared_key(df: DataFrame, by: list[str], role: str, key: str) -> DataFrame:
    """verified where every role has exactly one key and all have the same; otherwise the reason."""
    per = df.groupBy(*by, role).agg(F.count_distinct(key).alias("n"), F.min(key).alias("k"))
    out = per.groupBy(*by).agg(F.count(F.lit(1)).alias("n_roles"), F.max("n").alias("most"), F.min("n").alias("fewest"), F.count_distinct("k").alias("n_keys"))
    state = F.when(F.col("n_roles") < 2, "one_role").when(F.col("most") > 1, "several_keys").when(F.col("fewest") < 1, "no_key").when(F.col("n_keys") > 1, "different_keys").otherwise("verified")
    return out.select(*by, state.alias("state"))


def check_frame_map(df: DataFrame, by: list[str]) -> DataFrame:
    """Violations of a frame map (frame, source, time, status): -1 only where unresolved, sources and times rise, equal
    sources have equal times. One row per violated rule and frame."""
    w = Window.partitionBy(*by).orderBy("frame")
    known = df.filter("source >= 0").withColumns({"ps": F.lag("source").over(w), "pt": F.lag("time").over(w)})
    rules = F.array_compact(F.array(
        F.when(F.col("source") < F.col("ps"), F.lit("source_falls")), F.when(F.col("time") < F.col("pt"), F.lit("time_falls")), F.when((F.col("source") == F.col("ps")) & (F.col("time") != F.col("pt")), F.lit("same_source_other_time")),
    ))
    order = known.select(*by, "frame", F.explode(rules).alias("rule"))
    state = F.when((F.col("source") < 0) & (F.col("status") != "UNRESOLVED"), "resolved_without_source").when((F.col("source") >= 0) & (F.col("status") == "UNRESOLVED"), "unresolved_with_source")
    return order.unionByName(df.select(*by, "frame", state.alias("rule")).filter("rule IS NOT NULL"))


def require(df: DataFrame, status: str = "VERIFIED") -> DataFrame:
    """Only rows of that evidence; nothing is ever upgraded."""
    return df.filter(F.col("status") == status)


def frame_origin(annotations: DataFrame, by: list[str], num: int, den: int, tolerance: int) -> DataFrame:
    """Whether annotated frames count from 0 or 1: for both origins the largest residual in exact integers (frame * den -
    seconds * num, in 1 / den frames) and how many lie over the tolerance."""
    tried = annotations.withColumn("origin", F.explode(F.array(F.lit(0), F.lit(1))))
    residual = F.abs((F.col("frame") - F.col("origin")) * den - F.col("seconds") * num)
    return tried.groupBy(*by, "origin").agg(F.max(residual).alias("max_residual"), F.count_if(residual > tolerance).alias("n_over"), F.count(F.lit(1)).alias("n"))


def grade(values: DataFrame, by: list[str], levels: DataFrame) -> DataFrame:
    """Verdicts per metric (pass, flag, reject, missing) and the worst one. values: metric, value; levels: metric, flag, reject
    (a value under them is so judged)."""
    judged = values.join(levels, "metric")
    rank = F.when(F.col("value").isNull(), 1).when(F.col("value") < F.col("reject"), 3).when(F.col("value") < F.col("flag"), 2).otherwise(0)
    names = F.array(*map(F.lit, ("pass", "missing", "flag", "reject")))
    out = judged.withColumn("rank", rank).groupBy(*by).agg(F.max("rank").alias("worst"), F.array_join(F.sort_array(F.collect_list(F.when(F.col("rank") > 0, F.concat("metric", F.lit(":"), names[F.col("rank")])))), ",").alias("reasons"))
    return out.select(*by, names[F.col("worst")].alias("verdict"), "reasons")


#: Limits of a good frame, the motion (frame widths a second) at which stability is 0, and per metric the values
#: under which a stream is rejected and flagged (None: it isn't).
SHARP, DARK, BRIGHT, FASTEST = 40.0, 35.0, 225.0, 0.1875
LEVELS = {
    "good_frame_percent": (0.5, 0.8), "hand_presence_ratio": (0.2, 0.3), "person_presence_ratio": (None, 0.5), "lighting_score": (0.5, 0.8), "average_brightness": (20.0, 40.0), "stability_score": (None, 0.25),
}


def stream_quality(frames: DataFrame, by: list[str]) -> DataFrame:
    """by, kind, n_frames, good_frame_percent (sharp, neither dark nor bright), lighting_score (in range, ends included),
    average_brightness, average_sharpness, median_motion, average_motion, stability_score (1 without motion, 0 from FASTEST on),
    presence, verdict (reject, flag, missing or pass, the worst of its metrics) and reasons.

    frames: kind (ego: presence is of hands; exo: of persons), sharp, bright, motion and present, the last two null where unknown.
    """
    good = (F.col("sharp") > SHARP) & (F.col("bright") > DARK) & (F.col("bright") < BRIGHT)
    share = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("double"))
    known = F.when(~F.isnan("motion"), F.col("motion"))
    out = frames.groupBy(*by, "kind").agg(
        F.count(F.lit(1)).alias("n_frames"), share(good).alias("good_frame_percent"), share(F.col("bright").between(DARK, BRIGHT)).alias("lighting_score"), F.avg("bright").alias("average_brightness"),
        F.avg("sharp").alias("average_sharpness"), F.percentile(known, F.lit(0.5)).alias("median_motion"), F.avg(known).alias("average_motion"), F.avg(F.col("present").cast("double")).alias("presence"),
    )
    stable = F.greatest(F.least(1 - F.col("median_motion") / FASTEST, F.lit(1.0)), F.lit(0.0))
    out = out.withColumn("stability_score", F.when(F.col("median_motion").isNotNull(), stable))
    ego = F.col("kind") == "ego"
    value = {c: F.col(c) for c in LEVELS if not c.endswith("_ratio")} | {"hand_presence_ratio": F.when(ego, F.col("presence")), "person_presence_ratio": F.when(~ego, F.col("presence"))}
    asked = {c: F.lit(True) for c in LEVELS} | {"hand_presence_ratio": ego, "person_presence_ratio": ~ego}
    ranks, reasons = [], []
    for c, (reject, flag) in sorted(LEVELS.items()):
        v = value[c]
        rank = F.when(~asked[c], 0).when(v.isNull(), 1).when(v < flag, 2 if reject is None else F.when(v < reject, 3).otherwise(2)).otherwise(0)
        ranks.append(rank)
        reasons.append(F.when(rank > 0, F.concat(F.lit(f"{c}:"), F.element_at(F.array(*map(F.lit, ("missing", "flag", "reject"))), rank.cast("int")))))
    names = F.array(*map(F.lit, ("pass", "missing", "flag", "reject")))
    return out.withColumns({"verdict": names[F.greatest(*ranks)], "reasons": F.array_join(F.array_compact(F.array(*reasons)), ",")})


def failed_rules(rules: dict[str, Column]) -> Column:
    """Names of the rules that hold, in order, as one string."""
    return F.array_join(F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in rules.items()))), ",")


def rank_rows(df: DataFrame, by: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order) if by else Window.orderBy(*order)))


def score(parts: list[Column]) -> tuple[Column, Column]:
    """Mean of the parts that are there, each clipped to 0..1, times 100; and whether some are missing."""
    known = F.filter(F.array(*(F.when(p.isNotNull(), F.greatest(F.least(p, F.lit(1.0)), F.lit(0.0))) for p in parts)), lambda x: x.isNotNull())
    total = F.aggregate(known, F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(known) > 0, total / F.size(known) * 100), F.size(known) < len(parts)
