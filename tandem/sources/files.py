"""Readers and writers of the files that recordings come in. Times are read as integers, never through floating point."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TRAJECTORY = "graph_uid string, tracking_timestamp_us long, utc_timestamp_ns long, tx double, ty double, tz double, qx double, qy double, qz double, qw double, quality_score double"
HANDOVERS = "map<string, map<string, struct<start_frame: int, end_frame: int, start_time: decimal(18, 6), end_time: decimal(18, 6), initiator: string, delivering_flow: string, initiation_type: string, skip: string>>>"


def read_trajectory(spark: SparkSession, path: str) -> DataFrame:
    """Strict CSV: the header must name the columns in order, every row must have all of them; a UTC of -1 is null."""
    df = spark.read.schema(TRAJECTORY).option("header", True).option("mode", "FAILFAST").option("enforceSchema", False).csv(path)
    return df.withColumn("utc_timestamp_ns", F.nullif("utc_timestamp_ns", F.lit(-1)))


def read_hands(spark: SparkSession, path: str, points: int = 21) -> DataFrame:
    """t_us, side, conf, points: one row per side; a confidence of -1 or a blank coordinate makes the whole hand null."""
    names = [f"{a}{p}_{s}" for s in ("left", "right") for p in range(points) for a in ("tx", "ty", "tz")]
    fields = [T.StructField("tracking_timestamp_us", T.LongType()), *(T.StructField(f"{s}_confidence", T.DoubleType()) for s in ("left", "right")), *(T.StructField(n, T.DoubleType()) for n in names)]
    df = spark.read.schema(T.StructType(fields)).option("header", True).option("mode", "FAILFAST").option("enforceSchema", False).csv(path)

    def hand(side: str):
        coords = [[F.col(f"{a}{p}_{side}") for a in ("tx", "ty", "tz")] for p in range(points)]
        whole = F.array(*(c for p in coords for c in p))
        conf = F.nullif(F.col(f"{side}_confidence"), F.lit(-1.0))
        there = conf.isNotNull() & F.forall(whole, lambda x: x.isNotNull() & ~F.isnan(x))
        pts = F.array(*(F.struct(p[0].alias("x"), p[1].alias("y"), p[2].alias("z")) for p in coords))
        return F.struct(F.lit(side).alias("side"), F.when(there, F.greatest(F.least(conf, F.lit(1.0)), F.lit(0.0))).alias("conf"), F.when(there, pts).alias("points"))

    return df.select(F.col("tracking_timestamp_us").alias("t_us"), F.explode(F.array(hand("left"), hand("right"))).alias("h")).select("t_us", "h.*")


def read_gaze(spark: SparkSession, path: str) -> DataFrame:
    """t_us, yaw (mean of both eyes), pitch, depth."""
    df = spark.read.option("header", True).csv(path)
    d = lambda c: F.col(c).try_cast("double")
    yaw = (d("left_yaw_rads_cpf") + d("right_yaw_rads_cpf")) / 2 if "left_yaw_rads_cpf" in df.columns else d("yaw_rads_cpf")
    return df.select(F.col("tracking_timestamp_us").cast("long").alias("t_us"), yaw.alias("yaw"), d("pitch_rads_cpf").alias("pitch"), d("depth_m").alias("depth"))


def read_calibration(spark: SparkSession, path: str) -> DataFrame:
    """One row per time and camera of a JSON-lines calibration: t_us, position, label, model, params."""
    schema = "tracking_timestamp_us long, CameraCalibrations array<struct<Label: string, Projection: struct<Name: string, Params: array<double>>>>"
    df = spark.read.schema(schema).json(path)
    return df.select(F.col("tracking_timestamp_us").alias("t_us"), F.posexplode("CameraCalibrations").alias("position", "c")).select("t_us", "position", F.col("c.Label").alias("label"), F.col("c.Projection.Name").alias("model"), F.col("c.Projection.Params").alias("params"))


def select_segments(spark: SparkSession, path: str, selector: Callable[[str], Iterable[tuple]], schema: str) -> DataFrame:
    """Segments that a caller's selector finds in each raw annotation file: it takes a file's text and gives rows of `schema`."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for text in batch["value"]:
                rows = list(selector(text))
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    names = spark.createDataFrame([], schema).columns
    return spark.read.text(path, wholetext=True).mapInPandas(run, schema)


def read_handovers(spark: SparkSession, path: str) -> DataFrame:
    """Annotated segments of a JSON map from recording and key to segment; keys stay as ids. Scalar-or-list fields stay text."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", HANDOVERS).alias("m"))
    return whole.select(F.explode("m").alias("recording_id", "segments")).select("recording_id", F.explode("segments").alias("key", "s")).select("recording_id", "key", "s.*")


def usable(df: DataFrame, mode: str = "literal") -> DataFrame:
    """Segments to be used: skip is the literal false, or with mode="falsy" absent, empty or 0 too."""
    return df.filter(F.col("skip") == "false" if mode == "literal" else F.coalesce(F.col("skip"), F.lit("")).isin("", "false", "0", "null"))


def read_intervals(spark: SparkSession, path: str) -> DataFrame:
    """recording_id, start, end of a JSON map from recording to a list (or a map) of intervals."""
    text = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string, string>")).alias("recording_id", "v"))
    item = "struct<start: double, end: double>"
    listed = F.when(F.ltrim("v").startswith("["), F.from_json("v", f"array<{item}>")).otherwise(F.map_values(F.from_json("v", f"map<string, {item}>")))
    return text.select("recording_id", F.explode(listed).alias("i")).select("recording_id", "i.start", "i.end")


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """start, end, token of a transcript's words."""
    schema = "segments array<struct<words: array<struct<word: string, start: double, end: double>>>>"
    df = spark.read.schema(schema).option("multiLine", True).json(path)
    return df.select(F.explode("segments").alias("s")).select(F.explode("s.words").alias("w")).select("w.start", "w.end", F.regexp_extract(F.lower("w.word"), r"([a-z0-9']+)", 1).alias("token"))


def read_imu(spark: SparkSession, path: str, slots: int = 7) -> DataFrame:
    """slot, t_s and quaternion; missing columns and slots out of range are errors."""
    df = spark.read.parquet(path)
    if missing := {"time_ms", "slot", "quat_x", "quat_y", "quat_z", "quat_w"} - set(df.columns):
        raise ValueError(f"columns are missing: {sorted(missing)}")
    slot = F.when(F.col("slot").between(0, slots - 1), F.col("slot")).otherwise(F.raise_error(F.lit("a slot is out of range")).cast("int"))
    return df.select(slot.alias("slot"), (F.col("time_ms") / 1000).alias("t_s"), *(F.col(f"quat_{c}").alias(f"q{c}") for c in "xyzw"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """path, size, hash and problem (duplicate, bad_size, bad_hash, unsafe_path) of a JSON list of files."""
    from pyspark.sql import Window

    from tandem.functions.scalar import path_ok

    df = spark.read.schema("path string, size long, hash string").option("multiLine", True).json(path)
    n = F.count(F.lit(1)).over(Window.partitionBy("path"))
    problem = F.when(~path_ok(F.col("path")), "unsafe_path").when(F.coalesce(F.col("size"), F.lit(-1)) < 0, "bad_size").when(~F.coalesce(F.col("hash").rlike("^[0-9a-f]{64}$"), F.lit(False)), "bad_hash")
    return df.withColumn("n", n).select("path", "size", "hash", F.coalesce(problem, F.when(F.col("n") > 1, "duplicate")).alias("problem"))


def inventory(spark: SparkSession, root: str) -> DataFrame:
    """path, size, time, kind and partial of every file under a folder; contents aren't read, empty files have no row."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length", "modificationTime")
    return df.select("path", F.col("length").alias("size"), "modificationTime", F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)).alias("kind"), F.col("path").rlike(r"\.(part|tmp|partial)$").alias("partial"))


def read_verdicts(spark: SparkSession, path: str) -> DataFrame:
    """A JSON-lines log of verdicts; lines that can't be read are skipped."""
    return spark.read.schema("id string, item string, stream string, verdict string, t double").option("mode", "DROPMALFORMED").json(path)


def read_role_map(spark: SparkSession, path: str) -> DataFrame:
    """role, id and problem of a JSON map from role to a number: not_numeric, repeated."""
    from pyspark.sql import Window

    m = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string, string>")).alias("role", "id"))
    n = F.count(F.lit(1)).over(Window.partitionBy("id"))
    return m.withColumn("n", n).select("role", "id", F.when(~F.col("id").rlike(r"^\d+$"), "not_numeric").when(F.col("n") > 1, "repeated").alias("problem"))


def discover_fields(df: DataFrame, depth: int = 3) -> DataFrame:
    """path and type of every field of a table, down to `depth` levels of structs and arrays."""
    found: list[tuple[str, str]] = []

    def walk(kind: T.DataType, path: str, level: int) -> None:
        if isinstance(kind, T.ArrayType):
            walk(kind.elementType, f"{path}[]", level)
        elif isinstance(kind, T.StructType) and level < depth:
            for f in kind.fields:
                walk(f.dataType, f"{path}.{f.name}" if path else f.name, level + 1)
        else:
            found.append((path, kind.simpleString()))

    walk(df.schema, "", 0)
    return df.sparkSession.createDataFrame(found, "path string, type string")


def write_records(df: DataFrame, path: str, columns: list[tuple[str, str, dict]], by: str = "recording_id") -> None:
    """The declared columns (name, type, metadata) in order, missing ones as nulls, as Parquet partitioned by recording."""
    have = set(df.columns)
    out = df.select(by, *((F.col(n) if n in have else F.lit(None)).cast(t).alias(n, metadata=m) for n, t, m in columns if n != by))
    out.write.partitionBy(by).parquet(path)


def write_report(df: DataFrame, path: str, kind: str = "csv") -> None:
    w = df.write.mode("overwrite")
    (w.option("header", True).csv if kind == "csv" else w.json)(path)


def build_manifest(spark: SparkSession, root: str) -> DataFrame:
    """path, size and SHA-256 of every file under a folder."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return df.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("hash"))


def column_dictionary(df: DataFrame, meanings: list[tuple[str, str, str]]) -> DataFrame:
    """name, dtype, unit and meaning (of the first pattern that fits the name), and the share of nulls of every column."""
    import re

    nulls = df.agg(*(F.avg(F.col(c).isNull().cast("double")).alias(c) for c in df.columns)).first()
    rows = []
    for f in df.schema.fields:
        unit, meaning = next(((u, m) for p, u, m in meanings if re.search(p, f.name)), (None, None))
        rows.append((f.name, f.dataType.simpleString(), unit, meaning, nulls[f.name]))
    return df.sparkSession.createDataFrame(rows, "name string, dtype string, unit string, meaning string, unknown double")
