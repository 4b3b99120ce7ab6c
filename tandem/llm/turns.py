"""Rows of conversations in order, in pieces of bounded size, however unevenly the rows are spread over conversations."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Characters of a text that decide where a range of rows may end; rows that agree in them stay in one range.
RANGE_CHARS = 256


def pieces(rows: DataFrame, most_turns: int, most_chars: int, context: int = 0, expand: bool = False) -> tuple[DataFrame, DataFrame]:
    """All rows in order, cut into pieces; and where conversations go on in another partition.

    rows: conv_id, turn, role, text, copies and any further columns, no two rows equal in the first four. Order: turn (null
    first), then role, then text. Pieces have conv_id, part, piece (in order), ends (the last of this part), turns (rows
    but for conv_id) and before (the last `context` rows before the piece in this part). A piece ends after `most_turns`
    rows or `most_chars` characters; the rows' order is that of a range partitioning, so a conversation that holds a third
    of all rows is spread over a third of the tasks. With `expand` a row that stands for n copies comes n times.

    The second table, conv_id, part, next_part, previous_part, has a row for each part of a conversation with several: two
    at most for each partition, as ranges are contiguous. It may be broadcast.
    """
    held = [c for c in rows.columns if c != "conv_id"]
    turn = "struct<" + ", ".join(f"`{c}`: {rows.schema[c].dataType.simpleString()}" for c in held) + ">"
    conv = rows.schema["conv_id"].dataType.simpleString()
    ranges = rows.repartitionByRange("conv_id", "turn", "role", F.left("text", F.lit(RANGE_CHARS))).sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", *held)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, schema = TaskContext.get().partitionId(), None
        out: list[tuple] = []
        now: list[dict] = []
        recent: list[dict] = []
        before: list[dict] = []
        at, piece, size, total, fresh = None, 0, 0, 0, True

        def flush(ends: bool) -> None:
            nonlocal now, before, piece, size, total
            out.append((at, part, piece, ends, now, before))
            now, before, piece, total, size = [], list(recent), piece + 1, total + size, 0

        def batch_of() -> pa.RecordBatch:
            nonlocal total
            arrays = [pa.array(x, t) for x, t in zip(zip(*out), schema, strict=True)]
            out.clear()
            total = 0
            return pa.RecordBatch.from_arrays(arrays, ["conv_id", "part", "piece", "ends", "turns", "before"])

        for batch in batches:
            if schema is None:
                struct = pa.struct([f for f in batch.schema if f.name != "conv_id"])
                schema = [batch.schema.field("conv_id").type, pa.int32(), pa.int32(), pa.bool_(), pa.list_(struct), pa.list_(struct)]
            for row in batch.to_pylist():
                own = row.pop("conv_id")
                if fresh or own != at:
                    if now:
                        flush(True)
                    at, piece, recent, before, fresh = own, 0, [], [], False
                for _ in range(row["copies"] if expand else 1):
                    if now and (len(now) >= most_turns or size >= most_chars):
                        flush(False)
                    now.append(row)
                    size += len(row["text"] or "")
                    recent = [*recent, row][len(recent) + 1 - context :] if len(recent) >= context else [*recent, row]
                    if total > 1 << 22 or len(out) >= 4096:
                        yield batch_of()
        if now:
            flush(True)
        if out:
            yield batch_of()

    done = ranges.mapInArrow(cut, f"conv_id {conv}, part int, piece int, ends boolean, turns array<{turn}>, before array<{turn}>")
    done = materialize(done, "pieces")
    runs = done.filter("ends").groupBy("conv_id").agg(F.sort_array(F.collect_set("part")).alias("parts")).filter(F.size("parts") > 1)
    w = Window.partitionBy("conv_id").orderBy("part")
    hops = runs.select("conv_id", F.explode("parts").alias("part")).select("conv_id", "part", F.lead("part").over(w).alias("next_part"), F.lag("part").over(w).alias("previous_part"))
    return done, materialize(hops, "hops")


def distinct_rows(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and copies: equal rows as one, added up before they are shuffled."""
    return rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))


def same(a: DataFrame, b: DataFrame, *names: str):
    """Equality of columns that may be null."""
    out = a[names[0]].eqNullSafe(b[names[0]])
    for c in names[1:]:
        out = out & a[c].eqNullSafe(b[c])
    return out
