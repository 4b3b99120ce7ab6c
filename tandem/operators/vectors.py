"""Fingerprint vectors and points: nearest candidates, offsets, distances, sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tandem.functions import geometry as g
from tandem.functions import scalar as s


def match_fingerprints(targets: DataFrame, candidates: DataFrame, radius: int, most: float, margin: float, ratio: float, same: bool = True) -> DataFrame:
    """The nearest candidate (least root mean square difference, then least frame) among frames within `radius`, with the
    second best; matched if good enough, apart enough and better enough. Candidates are found by equality on exploded frames."""
    asked = targets.select("frame", "v", F.explode(F.sequence(F.col("frame") - radius, F.col("frame") + radius)).alias("candidate"))
    if not same:
        asked = asked.filter("candidate <> frame")
    pairs = asked.join(candidates.select(F.col("frame").alias("candidate"), F.col("v").alias("w")), "candidate").withColumn("rmse", s.rmse(F.col("v"), F.col("w")))
    w = Window.partitionBy("frame").orderBy(F.round("rmse", 9), "candidate")
    top = pairs.withColumn("k", F.row_number().over(w)).filter("k <= 2")
    out = top.groupBy("frame").agg(F.max(F.when(F.col("k") == 1, F.col("candidate"))).alias("candidate"), *(F.max(F.when(F.col("k") == k, F.col("rmse"))).alias(n) for k, n in ((1, "best"), (2, "second"))))
    ok = (F.col("best") <= most) & (F.col("second") - F.col("best") >= margin) & (F.col("second") / F.col("best") >= ratio)
    return out.withColumns({"margin": F.col("second") - F.col("best"), "matched": ok})


def offset_search(targets: DataFrame, candidates: DataFrame, most: int) -> DataFrame:
    """Mean error of all targets against the candidates at every constant offset; only offsets that cover all targets."""
    n = targets.select(F.count(F.lit(1)).alias("n_targets"))
    moved = targets.select("v", "frame", F.explode(F.sequence(F.lit(-most), F.lit(most)).cast("array<bigint>")).alias("offset")).withColumn("frame", F.col("frame") + F.col("offset"))
    errors = moved.join(candidates.select("frame", F.col("v").alias("w")), "frame").groupBy("offset").agg(F.count(F.lit(1)).alias("n"), F.avg(s.rmse(F.col("v"), F.col("w"))).alias("mean_error"))
    return errors.join(F.broadcast(n), F.col("n") == F.col("n_targets")).drop("n_targets")


def cross_distance(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """The least distance between a point of a and one of b (x, y, z) with equal keys; missing points don't count."""
    side = lambda df, n: df.select(*by, *(F.col(c).alias(f"{n}{c}") for c in "xyz"))
    d = g.norm(g.minus(g.cols("ax", "ay", "az"), g.cols("bx", "by", "bz")))
    return side(a, "a").join(side(b, "b"), by).groupBy(*by).agg(F.min(d).alias("distance"))


def block_sample(points: DataFrame, by: list[str], block: int, most: int) -> DataFrame:
    """Whole blocks of `block` consecutive points, evenly chosen so that about `most` points stay."""
    w = Window.partitionBy(*by).orderBy("frame")
    every = F.floor((F.count(F.lit(1)).over(Window.partitionBy(*by)) + most - 1) / most)
    i = F.row_number().over(w) - 1
    return points.withColumn("take", F.floor(i / block) % every == 0).filter("take").drop("take")
