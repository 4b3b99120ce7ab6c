"""Chat formatting: a template is a black box that turns messages into text; rendering prefixes tells where each turn is.

The template is called with the first message, the first two and so on. Where every output begins with the one before, a
turn's span is what its message added; where one doesn't, the template rewrites history. The content of a turn lies between
what the template puts before and after a mark of our own in its place.

A prefix costs its whole length, so conversations are cut into pieces, each rendered with the last turns before it. That
holds for templates whose output for a turn depends on few turns before it, which is tested: the turns before a piece must
look as they did in the piece before. A conversation where they don't, and one with rewritten history, is rendered whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .turns import distinct_rows, pieces, same

#: Characters of private use, which stand for a turn's text when the template is probed.
MARK = "\ue000\ue001"
PIECE, PIECE_CHARS, CONTEXT = 16, 1 << 20, 3
Message = tuple[str, str]


class Template(NamedTuple):
    """render: messages (role, text) to text. unescape: undoes what render does to a text. parse: output to messages."""

    render: Callable[[list[Message]], str]
    unescape: Callable[[str], str]
    parse: Callable[[str], list[Message]]


def escape(text: str) -> str:
    r"""No `<|` is left in it: every `<`, backslashes, `|` gets a backslash more."""
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescape(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


def _render(messages: list[Message]) -> str:
    one_line = [(r.replace("\\", "\\\\").replace("\n", "\\n"), t) for r, t in messages]
    return "".join(f"<|im_start|>{escape(r)}\n{escape(t)}<|im_end|>\n" for r, t in one_line)


def _parse(text: str) -> list[Message]:
    out = []
    for role, body in re.findall(r"<\|im_start\|>(.*?)\n(.*?)<\|im_end\|>\n", text, re.S):
        role = re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))
        out.append((role, unescape(body)))
    return out


#: Turns between start and end marks, the role on a line of its own.
CHATML = Template(_render, unescape, _parse)


class Span(NamedTuple):
    """Of a turn in the output; the text's part of it is from text_start to text_end. None where it can't be told."""

    role: str
    start: int | None
    end: int | None
    text_start: int | None
    text_end: int | None


def common_prefix(a: str, b: str) -> int:
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid - 1)
    return low


def spans(render: Callable[[list[Message]], str], messages: list[Message]) -> tuple[str, list[Span], list[int]]:
    """The output of all messages, each message's span in it, and the numbers of messages that change what was before.

    A message's span and all that reaches into a part which a later message rewrites are unknown.
    """
    before, out, rewriting = render([]), [], []
    for k, (role, text) in enumerate(messages):
        now, probe = render(messages[: k + 1]), render([*messages[:k], (role, MARK)])
        start = len(before)
        if not now.startswith(before):
            rewriting.append(k)
            start = common_prefix(before, now)
            out = [s if s.end is not None and s.end <= start else Span(s.role, None, None, None, None) for s in out]
        at = probe.find(MARK, min(start, len(probe)))
        head, foot = probe[start:at], probe[at + len(MARK) :]
        inside = at >= 0 and probe[:start] == now[:start] and len(now) - start >= len(head) + len(foot) and now.startswith(head, start) and now.endswith(foot)
        out.append(Span(role, start, len(now), *((start + len(head), len(now) - len(foot)) if inside else (None, None))))
        before = now
    return before, out, rewriting


_SPAN = pa.struct([("role", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("text_start", pa.int64()), ("text_end", pa.int64())])
_OUT = "part int, piece int, ends boolean, formatted string, spans array<struct<role: string, start: bigint, end: bigint, text_start: bigint, text_end: bigint>>, rewriting array<int>, head array<string>, tail array<string>"
_KINDS = [pa.int32(), pa.int32(), pa.bool_(), pa.string(), pa.list_(_SPAN), pa.list_(pa.int32()), pa.list_(pa.string()), pa.list_(pa.string())]


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def _rendered(template: Template) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of conv_id, part, piece, ends, turns and before: the turns' output, their spans in it, how the turns before look."""

    def one(own: dict) -> tuple:
        before, turns = ([(t["role"], t["text"]) for t in own[c]] for c in ("before", "turns"))
        text, found, rewriting = spans(template.render, before + turns)
        seen = [_digest(text[s.start : s.end]) if s.start is not None else "" for s in found]
        n = len(before)
        at = (found[n].start or 0) if n else 0
        moved = [{k: x - at if isinstance(x, int) else x for k, x in s._asdict().items()} for s in found[n:]]
        return own["conv_id"], own["part"], own["piece"], own["ends"], text[at:], moved, rewriting, seen[1:n], seen[-CONTEXT:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            conv = batch.schema.field("conv_id").type
            for start in range(0, batch.num_rows, 64):
                out = [one(row) for row in batch.slice(start, 64).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), [conv, *_KINDS], strict=True)], ["conv_id", "part", "piece", "ends", "formatted", "spans", "rewriting", "head", "tail"])

    return run


def format_chats(conversations: DataFrame, template: Template = CHATML, piece: int = PIECE, piece_chars: int = PIECE_CHARS) -> DataFrame:
    """conv_id, part, piece, formatted, spans and rewriting, in order of part and piece the whole conversation's output.

    Spans are offsets in the piece's `formatted`, one for each turn; rewriting lists the turns, counted from 0, that change
    earlier output. Rows are taken by turn, null first, then by role and text; equal rows all count. Null roles and texts
    are empty; a null conv_id is a conversation of its own. No rows give no rows. Other columns are not carried.
    """
    conv = conversations.schema["conv_id"].dataType.simpleString()
    text = [F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")]
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), *text, F.lit(1).cast("long").alias("copies"))
    cut, hops = pieces(distinct_rows(rows), piece, piece_chars, CONTEXT, expand=True)
    hops = F.broadcast(hops)
    continued = same(cut, hops, "conv_id", "part") & hops.previous_part.isNotNull() & (cut.piece == 0)
    last = F.expr(f"slice(concat(before, turns), -least({CONTEXT}, size(before) + size(turns)), {CONTEXT})").alias("before")
    left = cut.filter("ends").join(hops, same(cut, hops, "conv_id", "part") & hops.next_part.isNotNull()).select(cut.conv_id.alias("c"), "next_part", last)
    first = cut.join(hops, continued, "left_semi").drop("before")
    first = first.join(left, first.conv_id.eqNullSafe(left.c) & (first.part == left.next_part)).drop("c", "next_part")
    names = ["conv_id", "part", "piece", "ends", "turns", "before"]
    whole = cut.join(hops, continued, "left_anti").select(names).unionByName(first.select(names))
    out = materialize(whole.mapInArrow(_rendered(template), f"conv_id {conv}, {_OUT}"), "formatted")
    result = ["conv_id", "part", "piece", "formatted", "spans", "rewriting"]
    odd = materialize(_depends_on_more(out, hops), "odd")
    if odd.isEmpty():
        return out.select(result)
    rest = cut.join(odd, cut.conv_id.eqNullSafe(odd.odd), "left_semi").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("part", "piece", "turns"))).alias("x"))
    rest = rest.select("conv_id", F.lit(0).alias("part"), F.lit(0).alias("piece"), F.lit(True).alias("ends"), F.flatten("x.turns").alias("turns"), F.slice(F.flatten("x.turns"), 1, 0).alias("before"))
    rest = rest.mapInArrow(_rendered(template), f"conv_id {conv}, {_OUT}")
    return out.join(odd, out.conv_id.eqNullSafe(odd.odd), "left_anti").select(result).unionByName(rest.select(result))


def _depends_on_more(out: DataFrame, hops: DataFrame) -> DataFrame:
    """odd: conversations of several pieces where a piece has rewritten history, or shows the turns before it otherwise than their own piece does."""
    slim = out.select("conv_id", "part", "piece", "ends", "rewriting", "head", "tail")
    slim = slim.join(hops, same(slim, hops, "conv_id", "part"), "left").drop(hops.conv_id).drop(hops.part)
    several = F.expr("piece > 0 OR NOT ends OR next_part IS NOT NULL OR previous_part IS NOT NULL")
    rewriting = slim.filter(several & (F.size("rewriting") > 0)).select(F.col("conv_id").alias("odd"))
    go_on = F.expr("NOT ends OR next_part IS NOT NULL")
    here = slim.filter(go_on).select(F.col("conv_id").alias("c"), F.expr("CASE WHEN ends THEN next_part ELSE part END").alias("p"), F.expr("CASE WHEN ends THEN 0 ELSE piece + 1 END").alias("k"), "tail")
    there = slim.filter("piece > 0 OR previous_part IS NOT NULL").select("conv_id", "part", "piece", "head")
    pairs = here.join(there, here.c.eqNullSafe(there.conv_id) & (here.p == there.part) & (here.k == there.piece))
    other = pairs.filter(F.expr("size(head) > 0 AND slice(tail, -size(head), size(head)) <> head")).select(F.col("c").alias("odd"))
    return rewriting.union(other).distinct()


def read_back(formatted: DataFrame, template: Template = CHATML) -> DataFrame:
    """What the output holds, read from it alone: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    Digests go through a conversation's pieces one after the other, in a stream sorted by them: only one piece is held.
    """
    conv = formatted.schema["conv_id"].dataType.simpleString()
    ordered = formatted.withColumn("loss", F.expr("transform(filter(spans, s -> s.role = 'assistant' AND s.text_start IS NOT NULL), s -> struct(s.text_start AS a, s.text_end AS b))"))
    ordered = ordered.select("conv_id", "part", "piece", "formatted", "loss").repartition("conv_id").sortWithinPartitions("conv_id", "part", "piece")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, started = None, False
        n = chars = loss = 0
        turns, masked = hashlib.sha256(), hashlib.sha256()
        for batch in batches:
            kind, out = batch.schema.field("conv_id").type, []
            for row in batch.to_pylist():
                if started and row["conv_id"] != at:
                    out.append((at, n, turns.hexdigest(), loss, masked.hexdigest(), chars))
                if not started or row["conv_id"] != at:
                    at, started, n, chars, loss, turns, masked = row["conv_id"], True, 0, 0, 0, hashlib.sha256(), hashlib.sha256()
                text = row["formatted"]
                chars += len(text)
                for role, body in template.parse(text):
                    n += 1
                    turns.update(f"{role}\n{body}\n".encode("utf-8", "surrogatepass"))
                for s in row["loss"]:
                    body = template.unescape(text[s["a"] : s["b"]])
                    loss += len(body)
                    masked.update(body.encode("utf-8", "surrogatepass"))
            if out:
                yield _summary(out, kind)
        if started:
            yield _summary([(at, n, turns.hexdigest(), loss, masked.hexdigest(), chars)], kind)

    return ordered.mapInArrow(run, f"conv_id {conv}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _summary(out: list[tuple], conv: pa.DataType) -> pa.RecordBatch:
    kinds = [conv, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds, strict=True)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
