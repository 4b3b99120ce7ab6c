"""Frames that are known against each other: composition along the one path between them."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandem.functions import geometry as g

POSE = ["x", "y", "z", "qx", "qy", "qz", "qw"]


def settled(df: DataFrame) -> DataFrame:
    """df, computed and kept in the session's checkpoint folder, so that later rounds start from it. Where the session names
    none, one of this machine's is set in local mode alone."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tandem-"))
    return df.checkpoint()


def _composed(p: str, c: str) -> dict[str, Column]:
    """The pose of a child (prefix c) in what its parent (prefix p) is posed in."""
    x1, y1, z1, w1 = (F.col(f"{p}q{k}") for k in "xyzw")
    x2, y2, z2, w2 = (F.col(f"{c}q{k}") for k in "xyzw")
    q = [w1 * x2 + x1 * w2 + y1 * z2 - z1 * y2, w1 * y2 - x1 * z2 + y1 * w2 + z1 * x2, w1 * z2 + x1 * y2 - y1 * x2 + z1 * w2, w1 * w2 - x1 * x2 - y1 * y2 - z1 * z2]
    t = g.applied(g.unit_rotation([x1, y1, z1, w1]), g.cols(*(f"{p}{k}" for k in "xyz")), g.cols(*(f"{c}{k}" for k in "xyz")))
    return dict(zip(POSE, [*t, *q], strict=True))


def compose_paths(edges: DataFrame, by: list[str]) -> DataFrame:
    """Every frame's pose in the root that its path leads to. edges: a, b and the pose of frame b in frame a (unit quaternion).

    node, root, hops, pose and status: ok; second_path, for a frame that several edges lead to, which are all rejected, as
    consistent as they may be; unreached, below such a frame or in or below a cycle. A root has no edge that leads to it.
    Paths are doubled in each round, so that their number is the logarithm of the longest one's length.
    """
    edges = edges.select(*by, "a", "b", *POSE)
    counted = settled(edges.groupBy(*by, "b").agg(F.count(F.lit(1)).alias("n")))
    twice = counted.filter("n > 1").select(*by, "b")
    at = edges.join(twice, [*by, "b"], "left_anti").select(*by, F.col("b").alias("node"), F.col("a").alias("up"), F.lit(1).cast("long").alias("hops"), *POSE)
    most = counted.groupBy(*by).agg(F.count(F.lit(1)).alias("k")).agg(F.max("k")).first()[0] or 0
    for _ in range(int(most).bit_length() + 1):
        at = settled(at)
        above = at.select(*by, F.col("node").alias("up"), F.col("up").alias("p_up"), F.col("hops").alias("p_hops"), *(F.col(c).alias(f"p_{c}") for c in POSE))
        met = at.select(*by, "node", "up", "hops", *(F.col(c).alias(f"c_{c}") for c in POSE)).join(above, [*by, "up"], "left")
        further = F.col("p_up").isNotNull()
        moved = {c: F.when(further, v).otherwise(F.col(f"c_{c}")) for c, v in _composed("p_", "c_").items()}
        at = met.select(*by, "node", F.coalesce("p_up", "up").alias("up"), (F.col("hops") + F.coalesce("p_hops", F.lit(0))).alias("hops"), *(v.alias(c) for c, v in moved.items()))
    led = counted.select(*by, F.col("b").alias("up"), F.lit(True).alias("led"))
    out = at.join(led, [*by, "up"], "left")
    ok = F.col("led").isNull()
    out = out.select(*by, "node", F.when(ok, F.col("up")).alias("root"), F.when(ok, F.col("hops")).alias("hops"), F.when(ok, "ok").otherwise("unreached").alias("status"), *(F.when(ok, F.col(c)).alias(c) for c in POSE))
    return out.unionByName(twice.select(*by, F.col("b").alias("node"), F.lit("second_path").alias("status")), allowMissingColumns=True)
