"""Structured Streaming forms of the sequence operators. Each takes a streaming DataFrame with an event time column ts and
returns one; watermarks bound what is kept."""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def sessions(stream: DataFrame, key: str, gap: str, late: str) -> DataFrame:
    """Sessions per key: start, end (of the last event's gap) and n; a gap of `gap` without events ends one."""
    window = F.session_window("ts", gap)
    return stream.withWatermark("ts", late).groupBy(window, key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def tumbling(stream: DataFrame, key: str, width: str, late: str) -> DataFrame:
    """Counts and mean values per key and window of `width`."""
    out = stream.withWatermark("ts", late).groupBy(F.window("ts", width), key).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))
    return out.select(key, F.col("window.start").alias("start"), "n", "mean")


def sliding(stream: DataFrame, key: str, width: str, step: str, late: str) -> DataFrame:
    """Counts per key over the last `width`, every `step`."""
    out = stream.withWatermark("ts", late).groupBy(F.window("ts", width, step), key).agg(F.count(F.lit(1)).alias("n"))
    return out.select(key, F.col("window.start").alias("start"), "n")


class Nearest(StatefulProcessor):
    """Gives each query its nearest sample within `gap` microseconds once the watermark has passed all that could be nearer.

    State are the queries that wait and the samples that these, or queries still to come, may need.
    """

    def __init__(self, gap: int):
        self.gap = gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.queries = handle.getMapState("queries", "q_id long", "t long")
        self.samples = handle.getMapState("samples", "t long", "s_id long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        for part in rows:
            asked = part[part["q_id"].notna()]
            for q_id, t in zip(asked["q_id"].astype("int64"), asked["t"], strict=True):
                self.queries.updateValue((int(q_id),), (int(t),))
                self.handle.registerTimer((int(t) + self.gap) // 1000 + 1)
            first = part[part["s_id"].notna()].groupby("t")["s_id"].min()
            for t, s_id in first.items():
                known = self.samples.getValue((int(t),)) if self.samples.containsKey((int(t),)) else None
                self.samples.updateValue((int(t),), (int(s_id) if known is None else min(int(s_id), known[0]),))
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        passed = expiredTimerInfo.getExpiryTimeInMs() * 1000
        waiting = {k[0]: v[0] for k, v in self.queries.iterator()}
        samples = sorted((k[0], v[0]) for k, v in self.samples.iterator())
        times, out = [t for t, _ in samples], []
        for q_id, t in waiting.items():
            if t + self.gap < passed:
                at = bisect.bisect_left(times, t)
                near = min(((abs(x - t), x, i) for x, i in samples[max(0, at - 1) : at + 1] if abs(x - t) <= self.gap), default=None)
                out.append((key[0], q_id, *((near[2], near[0], "matched") if near else (None, None, "unmatched"))))
                self.queries.removeKey((q_id,))
        left = [t for q, t in waiting.items() if t + self.gap >= passed]
        for t in times:
            if t < min([timerValues.getCurrentWatermarkInMs() * 1000, *left]) - self.gap:
                self.samples.removeKey((t,))
        if out:
            yield pd.DataFrame(out, columns=["key", "q_id", "s_id", "gap", "status"]).astype({"s_id": "Int64", "gap": "Int64"})

    def close(self) -> None: ...


def nearest(queries: DataFrame, samples: DataFrame, key: str, gap_ms: int, late: str) -> DataFrame:
    """Every query (q_id, ts) once, with the nearest sample (s_id, ts) of its key within gap_ms: key, q_id, s_id, gap in
    microseconds and status, matched or unmatched. Ties as in the batch form: the earlier sample, then the least s_id.

    A query waits until the watermark, `late` behind the newest row of either stream, is past its time and the gap, so that the
    answer doesn't depend on the order of rows that are less late than that. Needs the RocksDB state store.
    """
    none = F.lit(None).cast("long")
    micros = F.unix_micros(F.col("ts").cast("timestamp")).alias("t")
    own = F.col(key).cast("long").alias("key")
    q = queries.select(own, "ts", micros, F.col("q_id").cast("long").alias("q_id"), none.alias("s_id"))
    s = samples.select(own, "ts", micros, none.alias("q_id"), F.col("s_id").cast("long").alias("s_id"))
    both = q.unionByName(s).withWatermark("ts", late)
    out = both.groupBy("key").transformWithStateInPandas(Nearest(gap_ms * 1000), outputStructType="key long, q_id long, s_id long, gap long, status string", outputMode="Append", timeMode="EventTime")
    return out.withColumnRenamed("key", key)


class Hysteresis(StatefulProcessor):
    """Turns a stream of (frame, label) into grasp and release events, one row at a time and in order of frame."""

    def __init__(self, start: int, end: int):
        self.start, self.end = start, end

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("held", "held string, next string, run int, since long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        held, following, run, since = self.state.get() if self.state.exists() else (None, None, 0, 0)
        out = []
        for r in pd.concat(list(rows)).sort_values("frame").itertuples(index=False):
            label = None if pd.isna(r.label) else r.label
            if label == held:
                following, run = None, 0
                continue
            if run and label == following:
                run += 1
            else:
                following, run, since = label, 1, int(r.frame)
            if run >= (self.end if held is not None else self.start):
                if held is not None:
                    out.append((key[0], "release", held, since))
                    held = None
                if following is not None and run >= self.start:
                    out.append((key[0], "grasp", following, since))
                    held = following
                if held == following:
                    following, run = None, 0
        self.state.update((held, following, run, since))
        if out:
            yield pd.DataFrame(out, columns=["series", "kind", "label", "frame"]).astype({"kind": object, "label": object})

    def close(self) -> None: ...


def hysteresis(stream: DataFrame, start: int, end: int) -> DataFrame:
    """Events of a stream with series (long), frame and label."""
    return stream.groupBy("series").transformWithStateInPandas(Hysteresis(start, end), outputStructType="series long, kind string, label string, frame long", outputMode="Append", timeMode="None")


class Persistence(StatefulProcessor):
    """Keeps an object active until `hold_ms` after its last detection, by event-time timers."""

    def __init__(self, hold_ms: int):
        self.hold_ms = hold_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("span", "first long, last long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        first, last = self.state.get() if self.state.exists() else (None, None)
        out = []
        for t in sorted(x for part in rows for x in part["ms"].tolist()):
            if last is not None and t - last > self.hold_ms:
                out.append((key[0], first, last + self.hold_ms))
                first = None
            first, last = (t if first is None else first), t
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(last + self.hold_ms)
        self.state.update((int(first), int(last)))
        if out:
            yield pd.DataFrame(out, columns=["object", "start_ms", "end_ms"])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        if self.state.exists():
            first, last = self.state.get()
            self.state.clear()
            yield pd.DataFrame([(key[0], first, last + self.hold_ms)], columns=["object", "start_ms", "end_ms"])

    def close(self) -> None: ...


def persistence(stream: DataFrame, hold_ms: int, late: str) -> DataFrame:
    """Active spans of a stream with object (long) and ts."""
    timed = stream.withWatermark("ts", late).withColumn("ms", F.unix_millis(F.col("ts").cast("timestamp")))
    return timed.groupBy("object").transformWithStateInPandas(Persistence(hold_ms), outputStructType="object long, start_ms long, end_ms long", outputMode="Append", timeMode="EventTime")


def upsert_to(path: str, keys: list[str], order: list[str]):
    """A foreachBatch function: appends the latest row of every key in the batch; `latest` over the folder gives the state."""
    from tandem.operators.bookkeeping import latest

    def write(batch: DataFrame, _: int) -> None:
        latest(batch, keys, order).write.mode("append").parquet(path)

    return write


class Lateness(StatefulProcessor):
    """Marks rows that lie more than late_seconds behind the newest of their key in all earlier batches."""

    def __init__(self, late_seconds: int):
        self.late = pd.Timedelta(seconds=late_seconds)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("newest", "micros long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        newest = pd.Timestamp(self.state.get()[0], unit="us") if self.state.exists() else None
        top = newest
        for part in rows:
            times = part["ts"].dt.tz_localize(None)
            yield part.assign(late=False if newest is None else (times < newest - self.late).to_numpy())
            top = times.max() if top is None else max(top, times.max())
        self.state.update((int(top.value // 1000),))

    def close(self) -> None: ...


def mark_late(stream: DataFrame, key: str, late_seconds: int) -> DataFrame:
    """The stream's rows with late; ts must not be null."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema.fields)
    return stream.groupBy(key).transformWithStateInPandas(Lateness(late_seconds), outputStructType=f"{schema}, late boolean", outputMode="Append", timeMode="None")


def quarantine_to(good: str, bad: str):
    """A foreachBatch function for `mark_late`: late rows go to `bad` with the batch's number, all others to `good`."""

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        batch.filter("NOT late").drop("late").write.mode("append").parquet(good)
        batch.filter("late").drop("late").withColumn("batch", F.lit(number)).write.mode("append").parquet(bad)
        batch.unpersist()

    return write
