"""The given tables in the shapes of the domain: two people's series, frames, intervals, poses, words, boxes and files.

Each function takes (spark, sf_dir). Times are integer microseconds or frames, never floating point.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tandem.operators.intervals import dealt

HOURS = 720


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp without zone, whatever the session's zone."""
    second = F.extract(F.lit("SECOND"), ts)
    return (F.unix_date(ts.cast("date")).cast("long") * 86_400 + F.hour(ts) * 3_600 + F.minute(ts) * 60) * 1_000_000 + (second * 1_000_000).cast("long")


def hour_of(ts: Column) -> Column:
    """Hours since 2024-01-01."""
    return ((F.unix_date(ts.cast("date")) - 19_723) * 24 + F.hour(ts)).cast("int")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """recording_id, role, t, idx, val, kind: one series per person, idx in order of time."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(
        F.expr("user_id div 2").alias("recording_id"),
        F.expr("cast(user_id % 2 AS int)").alias("role"),
        micros(F.col("ts")).alias("t"),
        (F.row_number().over(w) - 1).cast("long").alias("idx"),
        F.col("value").alias("val"),
        F.col("event_type").alias("kind"),
    )


def sparse_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """samples with times floored to six hours, without role 1 in every seventh recording, every 13th time missing."""
    six = 6 * 3_600_000_000
    s = samples(spark, sf_dir).filter("NOT (role = 1 AND recording_id % 7 = 0)")
    return s.withColumn("t", F.when(F.col("idx") % 13 == 0, F.lit(None)).otherwise(F.expr(f"t div {six} * {six}")))


def _last(spark: SparkSession, sf_dir: str, hours: int) -> DataFrame:
    """One row: the last frame of the 30 days, or of the last event of all."""
    last = F.floor(F.max(hour_of(F.col("ts"))) / hours).cast("int")
    return table(spark, sf_dir, "events").agg(F.greatest(F.coalesce(last, F.lit(0)), F.lit(HOURS // hours - 1)).alias("last"))


def grid(spark: SparkSession, sf_dir: str, hours: int = 1) -> DataFrame:
    """recording_id, frame: frames of `hours` hours over the 30 days, and on to the last event of all."""
    events = table(spark, sf_dir, "events")
    ids = dealt(events.select(F.expr("user_id div 2").alias("recording_id")).distinct(), ["recording_id"])
    frames = F.sequence(F.lit(0), F.col("last"))
    return ids.join(F.broadcast(_last(spark, sf_dir, hours))).select("recording_id", F.explode(frames).alias("frame"))


def frames(spark: SparkSession, sf_dir: str, hours: int = 1) -> DataFrame:
    """recording_id, role, frame, val (sum of the frame's values to six digits, so that the order of adding can't show; null without any), n.

    Events are dealt by recording once. Each frame with events makes the empty ones up to the next in its place, so that the
    grid, many times as long as the events, is neither shuffled nor joined, and what follows by recording needs no shuffle.
    """
    events = table(spark, sf_dir, "events").select(
        F.expr("user_id div 2").alias("recording_id"), F.expr("cast(user_id % 2 AS int)").alias("role"), F.floor(hour_of(F.col("ts")) / hours).cast("int").alias("frame"), F.col("value").alias("val"),
    )
    events = dealt(events, ["recording_id"])
    first = F.row_number().over(Window.partitionBy("recording_id").orderBy("role", "frame")) == 1
    seen = F.struct("role", "frame", "val", F.lit(1).alias("n"))
    before = [F.struct(F.lit(r).alias("role"), F.lit(-1).alias("frame"), F.lit(None).cast("double").alias("val"), F.lit(0).alias("n")) for r in (0, 1)]
    rows = events.withColumn("first", first).select("recording_id", F.inline(F.when(F.col("first"), F.array(seen, *before)).otherwise(F.array(seen))))
    known = F.col("recording_id").isNotNull() & (F.col("frame") >= 0) & F.col("role").isin(0, 1)
    cells = rows.filter((F.col("n") == 0) | known).groupBy("recording_id", "role", "frame").agg(F.round(F.sum("val"), 6).alias("val"), F.sum("n").alias("n"))
    following = F.lead("frame").over(Window.partitionBy("recording_id", "role").orderBy("frame"))
    upto = cells.withColumn("upto", following - 1).join(F.broadcast(_last(spark, sf_dir, hours)))
    # before a series' first frame there are as many frames as its number says, which may be none
    spans = upto.withColumns({"start": F.greatest("frame", F.lit(0)), "upto": F.coalesce("upto", "last")}).filter("start <= upto")
    dense = spans.select("recording_id", "role", F.explode(F.sequence("start", "upto")).alias("at"), "frame", "val", "n")
    here = F.col("at") == F.col("frame")
    return dense.select("recording_id", "role", F.col("at").alias("frame"), F.when(here, F.col("val")).alias("val"), F.when(here, F.col("n")).otherwise(F.lit(0)).alias("n"))


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """recording_id, iv, start_frame, end_frame, initiator, cue, skip: purchases as annotated intervals of hourly frames."""
    hour = hour_of(F.col("ts"))
    return table(spark, sf_dir, "events").filter("event_type = 'purchase'").select(
        F.expr("user_id div 2").alias("recording_id"), F.col("event_id").alias("iv"), hour.alias("start_frame"),
        (hour + 1 + F.col("event_id") % 4).cast("int").alias("end_frame"),
        F.expr("cast(event_id % 2 AS int)").alias("initiator"), F.expr("cast(event_id % 3 AS int)").alias("cue"), F.expr("event_id % 11 = 0").alias("skip"),
    )


def poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """recording_id, frame, x, y, z and a unit quaternion qx, qy, qz, qw."""
    e = lambda i: F.col("embedding")[i].cast("double")
    norm = F.sqrt(sum((e(i) * e(i) for i in range(4, 7)), e(3) * e(3)))
    w = Window.partitionBy("label").orderBy("vec_id")
    return table(spark, sf_dir, "embeddings").select(
        F.col("label").cast("long").alias("recording_id"), (F.row_number().over(w) - 1).alias("frame"), "vec_id",
        e(0).alias("x"), e(1).alias("y"), e(2).alias("z"), *((e(3 + i) / norm).alias(q) for i, q in enumerate(("qx", "qy", "qz", "qw"))),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frame, v: fingerprint vectors."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame"), F.col("embedding").cast("array<double>").alias("v"), F.col("label").alias("group_id"))


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """recording_id, role, pos, word, start, end in tenths of a second: every turn begins on a minute."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("recording_id"), "turn", "role", F.posexplode(F.split("text", r"\s+")).alias("pos", "word"))
    start = F.col("turn") * 600 + F.col("pos") * 4
    return turns.filter("word <> ''").select("recording_id", "turn", "role", F.col("pos").cast("long").alias("pos"), "word", start.cast("long").alias("start"), (start + 3).cast("long").alias("end"))


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frame, slot, x0, y0, x1, y1, conf, name."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("frame"), F.col("l_linenumber").alias("slot"), F.expr("cast(l_partkey % 600 AS double)").alias("x0"), F.expr("cast(l_suppkey % 400 AS double)").alias("y0"),
        F.expr("cast(l_partkey % 600 AS double) + l_quantity * 4").alias("x1"), F.expr("cast(l_suppkey % 400 AS double) + l_quantity * 3").alias("y1"),
        F.expr("1 - l_discount").alias("conf"), F.col("l_returnflag").alias("name"),
    )


def contact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """recording_id, person, t, object, kind: clicks grasp, views release."""
    return table(spark, sf_dir, "events").filter("event_type IN ('click', 'view')").select(
        F.expr("user_id div 2").alias("recording_id"), F.col("user_id").alias("person"), micros(F.col("ts")).alias("t"),
        F.expr("cast(event_id % 5 AS int)").alias("object"), F.expr("CASE event_type WHEN 'click' THEN 'grasp' ELSE 'release' END").alias("kind"), "event_id",
    )


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, y, score, group_id: quality labels with the text's length as score, grouped by source."""
    return table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars", "source"), "doc_id").select("doc_id", F.col("quality").alias("y"), F.col("n_chars").cast("double").alias("score"), F.col("source").alias("group_id"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, size, hash of every listed file."""
    return table(spark, sf_dir, "documents").select("doc_id", F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("path"), F.col("n_chars").alias("size"), F.md5("text").alias("hash"))


def files_on_disk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listed files as found: every 17th is gone, every 19th changed, every 23rd has an unlisted neighbour."""
    f = files(spark, sf_dir).filter("doc_id % 17 <> 0").withColumn("hash", F.expr("CASE WHEN doc_id % 19 = 0 THEN md5(hash) ELSE hash END"))
    return f.unionByName(f.filter("doc_id % 23 = 0").withColumn("path", F.concat("path", F.lit(".tmp"))))


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, item, stream, verdict, t: a log of review verdicts, later ones replacing earlier ones."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("id"), F.col("event_type").alias("item"), F.expr("user_id % 4").alias("stream"),
        F.expr("CASE event_id % 3 WHEN 0 THEN 'ok' WHEN 1 THEN 'wrong' ELSE 'unsure' END").alias("verdict"), micros(F.col("ts")).alias("t"), "event_id",
    )


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """camera, chunk, start, end in seconds: recorded chunks; every 29th has no start."""
    start = F.unix_date(F.col("o_orderdate").cast("date")).cast("long") * 86_400
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("camera"), F.col("o_orderkey").alias("chunk"), F.when(F.col("o_orderkey") % 29 != 0, start).alias("start"),
        F.when(F.col("o_orderkey") % 29 != 0, start + F.floor(F.col("o_totalprice"))).alias("end"),
    )
