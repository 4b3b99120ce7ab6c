"""State that only a step-by-step fold can carry: hysteresis, greedy pairing, linking. Folds run over runs, pairs or one
stream's boxes, never over a whole table; work is spread over series."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain, groupby, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .intervals import dealt, merge


def folded(df: DataFrame, by: list[str], order: list[str], fn: Callable[[Iterator[tuple]], Iterator[tuple]], schema: str) -> DataFrame:
    """fn over every series, many series to an Arrow batch: from its rows in order, without the by columns, to what it makes of
    them. fn takes rows as they come, so that a series need not be in memory. df: the by columns first. `schema`: the by columns'
    types, then those of fn's rows."""
    n, names = len(by), [c for c in df.columns if c not in by]
    rows = dealt(df.select(*by, *names), by).sortWithinPartitions(*by, *order)
    width = 10_000

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = chain.from_iterable(zip(*(c.to_pylist() for c in b.columns), strict=True) for b in batches)
        out = (key + tuple(r) for key, part in groupby(every, key=lambda r: r[:n]) for r in fn(r[n:] for r in part))
        while chunk := list(islice(out, width)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*chunk, strict=True), types, strict=True)], fields)

    target = to_arrow_schema(StructType.fromDDL(schema))
    fields, types = target.names, target.types
    return rows.mapInArrow(run, schema)


def value_runs(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Runs of equal values in order of frame: value, start, end, n. A null is a value of its own."""
    w = Window.partitionBy(*by).orderBy("frame")
    new = (~F.col(value).eqNullSafe(F.lag(value).over(w)) | (F.row_number().over(w) == 1)).cast("int")
    rows = df.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w))
    return rows.groupBy(*by, "_run").agg(F.first(value).alias(value), F.min("frame").alias("start"), F.max("frame").alias("end"), F.count(F.lit(1)).alias("n")).drop("_run")


def label_hysteresis(df: DataFrame, by: list[str], label: str, start: int, end: int, schema: str) -> DataFrame:
    """Held labels as spans: by, label, start and end (null while still held).

    A label is grasped by a run of `start` frames and released by one run of another label, or of none, of `end` frames;
    both are dated back to the first frame of that run, which may do both. Shorter runs change nothing, whatever their sum.
    schema: the by columns' types.
    """

    def fold(rows: Iterator[tuple]) -> Iterator[tuple]:
        held = since = None
        for first, value, n in rows:
            if held is not None and value != held and n >= end:
                yield held, since, first
                held = None
            if held is None and value is not None and n >= start:
                held, since = value, first
        if held is not None:
            yield held, since, None

    runs = value_runs(df, by, label).select(*by, "start", label, "n")
    return folded(runs, by, ["start"], fold, f"{schema}, {label} string, start long, end long")


def contact_events(spans: DataFrame, by: list[str], label: str) -> DataFrame:
    """Grasp and release events (kind, label, frame) of held spans."""
    sides = F.array(F.struct(F.lit("grasp").alias("kind"), F.col("start").alias("frame")), F.struct(F.lit("release").alias("kind"), F.col("end").alias("frame")))
    return spans.select(*by, label, F.explode(sides).alias("e")).select(*by, "e.kind", label, "e.frame").filter("frame IS NOT NULL")


def prob_hysteresis(df: DataFrame, by: list[str], high: float | Column, low: float | Column, on: int, off: int) -> DataFrame:
    """Intervals (start, end, both included) of a probability p: one opens where p is over `high` for `on` frames and closes
    before the first of `off` frames under `low`; what is open at the series' end closes there. A null p is neither.

    Opening and closing runs are found by themselves; of those that follow each other only the first of a kind counts.
    """
    level = F.when(F.col("p") > high, "h").when(F.col("p") < low, "l").otherwise("m")
    w = Window.partitionBy(*by).orderBy("start")
    rows = value_runs(df.withColumn("level", level), by, "level").withColumn("last", F.max("end").over(Window.partitionBy(*by)))
    turns = rows.filter((F.col("level") == "h") & (F.col("n") >= on) | (F.col("level") == "l") & (F.col("n") >= off))
    turns = turns.withColumn("before", F.lag("level").over(w)).filter((F.col("level") == "h") & (F.coalesce("before", F.lit("l")) == "l") | (F.col("level") == "l") & (F.col("before") == "h"))
    closes = F.coalesce(F.lead("start").over(w) - 1, F.col("last"))
    return turns.select(*by, "level", "start", closes.alias("end")).filter("level = 'h'").drop("level")


def pair_handovers(spans: DataFrame, by: list[str], window: int, least: int, margin: int, schema: str) -> DataFrame:
    """Handovers: giver, receiver, object, start and end (from the earlier to the later of release and grasp, `margin` around).

    Takers, in order of their grasp, take the nearest release (then the earliest, then the least giver) of the same object
    by another person at most `window` away that none has taken. Both have held it for `least`; a taker may still hold it.
    Handovers of the same object, giver and receiver that overlap are merged. spans: person, object, start, end (null while
    still held). Candidates meet in time buckets of `window`; the greedy choice runs over one object's candidates.
    """
    held = spans.filter(F.col("end").isNull() | (F.col("end") - F.col("start") >= least))
    gives = held.filter("end IS NOT NULL").select(*by, "object", F.col("person").alias("giver"), F.col("end").alias("released"), F.explode(F.expr(f"sequence(end div {window} - 1, end div {window} + 1)")).alias("bucket"))
    takes = held.select(*by, "object", F.col("person").alias("receiver"), F.col("start").alias("grasped"), F.expr(f"start div {window}").alias("bucket"))
    near = gives.join(takes, [*by, "object", "bucket"]).filter((F.col("giver") != F.col("receiver")) & (F.abs(F.col("grasped") - F.col("released")) <= window)).drop("bucket")

    def fold(rows: Iterator[tuple]) -> Iterator[tuple]:
        given, taken = set(), set()
        for grasped, receiver, _, released, giver in rows:
            if (giver, released) not in given and (receiver, grasped) not in taken:
                given.add((giver, released))
                taken.add((receiver, grasped))
                yield giver, released, receiver, grasped

    order = ["grasped", "receiver", "gap", "released", "giver"]
    near = near.withColumn("gap", F.abs(F.col("grasped") - F.col("released"))).select(*by, "object", *order)
    pairs = folded(near, [*by, "object"], order, fold, f"{schema}, object int, giver long, released long, receiver long, grasped long")
    key = [*by, "object", "giver", "receiver"]
    around = pairs.select(*key, (F.least("released", "grasped") - margin).alias("start"), (F.greatest("released", "grasped") + margin).alias("end"))
    return merge(around, key)


def lot(seed: int, *names: str) -> Column:
    """A row's lot in a draw: the MD5 of the seed and the named columns, joined by colons."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(n).cast("string") for n in names)))


def review_sample(df: DataFrame, by: list[str], key: str, share: float, seed: int) -> DataFrame:
    """A fixed share of every stream's rows, at least one, chosen by a hash."""
    w = Window.partitionBy(*by).orderBy(lot(seed, *by, key), key)
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    return df.withColumns({"k": F.row_number().over(w), "n_all": n}).filter(F.col("k") <= F.greatest(F.ceil(F.col("n_all") * share), F.lit(1))).drop("k", "n_all")


def negative_windows(grid: DataFrame, events: DataFrame, by: list[str], far: int, most: int, seed: int) -> DataFrame:
    """Frames at least `far` from every event, at most `most` of each recording, chosen by a hash."""
    near = dealt(events.dropna(subset=by), by).select(*by, F.explode(F.sequence(F.col("start_frame") - far + 1, F.col("end_frame") + far - 1)).alias("frame")).distinct()
    # both meet in a window, so that a grid that is dealt by series isn't shuffled anew
    rows = grid.withColumn("_near", F.lit(False)).unionByName(near.withColumn("_near", F.lit(True)), allowMissingColumns=True)
    rows = rows.withColumn("_near", F.max("_near").over(Window.partitionBy(*by, "frame"))).filter("NOT _near").drop("_near")
    w = Window.partitionBy(*by).orderBy(lot(seed, *by, "frame"), "frame")
    return rows.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= most).drop("k")
