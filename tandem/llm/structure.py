"""Repair of conversations: the cheapest edits that give turns `(s?(ua)+)?`, by a parallel Viterbi with rank convergence.

Between two rows a conversation is in one of four states: nothing said, after the system, after the user, after the
assistant. The cost to finish from each state, computed from the last row backwards, is a vector; a row's step on vectors
is linear in (min, +). Pieces of a conversation start from a guessed vector at their end. After some rows the guess
matters only by a constant added to all four costs; where it still matters, the piece runs again from the vector that the
next piece gave, until the vectors differ only by a constant, and so on until no piece's start changes. With costs known,
each piece traces the least audit from every state it may begin in; the pieces' states are then stitched from the first.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize
from .turns import distinct_rows, pieces, same

PIECE, PIECE_CHARS = 1024, 1 << 22
DELETE, REROLE, INSERT, TRUNCATED = 2, 1, 5, 5
SPACE = r"\x20\x09-\x0D"
#: Kinds of rows: the role's initial (s, u, a, any other), 4 more if truncated; BAD is to be deleted.
INITIALS, BAD = "sua", 8
#: States 0 to 3: nothing said, after the system, after the user, after the assistant.
SPOKEN = {(0, 0): 1, (0, 1): 2, (1, 1): 2, (2, 2): 3, (3, 1): 2}
NEXT = (2, 2, 3, 2)
FAR = 1 << 40
Vector = tuple[int, int, int, int]


def closed(w: Vector) -> Vector:
    """With rows inserted first: two are enough to reach any state that leads on."""
    v = tuple(min(w[q], INSERT + w[NEXT[q]], 2 * INSERT + w[NEXT[NEXT[q]]]) for q in range(4))
    return v  # type: ignore[return-value]


def apart(v: Vector) -> Vector:
    """What is left of a vector without the constant: equal for two vectors if they differ only by one."""
    low = min(v)
    return tuple(x - low for x in v)  # type: ignore[return-value]


END = closed((0, FAR, FAR, 0))


def options(after: Vector, kind: int, q: int) -> dict[str, int]:
    """Cost of what can be done with a row in state q, by the edit's initial."""
    out = {"D": DELETE + after[q]}
    if kind != BAD:
        cut = TRUNCATED if kind >= 4 else 0
        if (q, kind % 4) in SPOKEN:
            out["K"] = cut + after[SPOKEN[q, kind % 4]]
        out["R"] = REROLE + cut + after[NEXT[q]]
    return out


@functools.lru_cache(maxsize=1 << 16)
def step(after: Vector, kind: int) -> Vector:
    """The vector before a row, from the one after it."""
    return apart(closed(tuple(min(options(after, kind, q).values()) for q in range(4))))  # type: ignore[arg-type]


@functools.lru_cache(maxsize=1 << 16)
def choice(after: Vector, kind: int, q: int) -> tuple[str, int]:
    """The least letters among the cheapest for one row in state q, and the state after it."""
    before = closed(tuple(min(options(after, kind, s).values()) for s in range(4)))  # type: ignore[arg-type]
    letters = ""
    while True:
        ways = options(after, kind, q)
        ways["I"] = INSERT + before[NEXT[q]]
        best = min(ways, key=lambda x: (ways[x], x))
        letters += best
        if best == "I":
            q = NEXT[q]
            continue
        return letters, q if best == "D" else SPOKEN[q, kind % 4] if best == "K" else NEXT[q]


def codes(kinds: str) -> list[int]:
    """Kinds are written one digit a row."""
    return list(map(int, kinds))


def backwards(kinds: list[int], after: Vector) -> list[Vector]:
    """The vectors before and after each row, the piece's end last."""
    out = [after]
    for kind in reversed(kinds):
        out.append(step(out[-1], kind))
    return out[::-1]


def rerun(kinds: list[int], used: Vector, true: Vector, start: Vector) -> Vector:
    """The vector at a piece's start from the true end, given the start from the end used: rows are gone through until both differ only by a constant."""
    for kind in reversed(kinds):
        if used == true:
            return start
        used, true = step(used, kind), step(true, kind)
    return true


def trace(kinds: list[int], copies: list[int], vectors: list[Vector], q: int, last: bool) -> tuple[list[str], int]:
    """The edits of each row, those after the last one in an entry of their own, and the state at the end."""
    out = []
    for k, kind in enumerate(kinds):
        letters, q = choice(vectors[k + 1], kind, q)
        out.append(letters + "D" * (copies[k] - 1))
    tail = ""
    while last and q in (1, 2):
        tail, q = tail + "I", NEXT[q]
    return [*out, tail], q


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and copies of what crc32 of `conv_id:turn` leaves of rows: by its rest by 20, 0 drops a row, 1 empties its text, 2 takes `.!?` out, 3 repeats it, 4 makes it the user's. Null is one space."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    rest, text = F.crc32(key) % 20, F.coalesce("text", space)
    return conversations.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.when(rest == 4, "user").otherwise(F.coalesce("role", space)).alias("role"),
        F.when(rest == 1, "").when(rest == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"), F.when(rest == 3, 2).otherwise(1).cast("long").alias("copies"), rest.alias("rest"),
    ).filter("rest <> 0").drop("rest")


def faults(rows: DataFrame) -> DataFrame:
    """Distinct rows with blank, again (role and text at an earlier turn too) and truncated."""
    blank = ~F.col("text").rlike(f"[^{SPACE}]")
    truncated: Column = ~F.col("text").rlike(rf"[.!?][{SPACE}]*\z")
    rows = rows.withColumns({"blank": blank, "truncated": truncated, "digest": F.sha2("text", 256)})
    first = rows.groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d")).agg(F.min(F.struct(F.col("turn").isNotNull(), "turn")).getField("turn").alias("first_turn"))
    joined = rows.join(first, rows.conv_id.eqNullSafe(first.c) & (rows.role == first.r) & (rows.digest == first.d))
    return joined.select("conv_id", "turn", "role", "text", "copies", "blank", (~F.col("turn").eqNullSafe(F.col("first_turn"))).alias("again"), "truncated")


def _converged(slim: DataFrame, hops: DataFrame) -> DataFrame:
    """conv_id, part, piece and after: the vector at the end of each piece that has a next one.

    slim: conv_id, part, piece, kinds, follows (part and piece of the next one, or null). Passes go on until no start of a
    piece changes: at most as many as a conversation has pieces, in practice one or two, as vectors forget their end.
    """
    conv, vec = slim.schema["conv_id"].dataType.simpleString(), pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                true = tuple(r["true"])
                kinds = codes(r["kinds"])
                start = rerun(kinds, tuple(r["used"]), true, tuple(r["start"])) if r["used"] else backwards(kinds, true)[0]
                out.append((r["conv_id"], r["part"], r["piece"], list(true), list(start)))
            if out:
                types = [batch.schema.field("conv_id").type, pa.int32(), pa.int32(), vec, vec]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types, strict=True)], ["conv_id", "part", "piece", "used", "start"])

    schema = f"conv_id {conv}, part int, piece int, used array<long>, start array<long>"
    guess = F.array(*[F.lit(x).cast("long") for x in apart(END)])
    none = F.lit(None).cast("array<long>")
    known = materialize(slim.select("conv_id", "part", "piece", "kinds", none.alias("used"), none.alias("start"), guess.alias("true")).mapInArrow(run, schema), "vectors")
    order = slim.filter("next_piece IS NOT NULL").select("conv_id", "part", "piece", "kinds", "next_part", "next_piece")
    while True:
        ahead = known.select(F.col("conv_id").alias("c"), F.col("part").alias("p"), F.col("piece").alias("k"), F.col("start").alias("true"))
        here = order.join(known, same(order, known, "conv_id", "part", "piece")).select(order.conv_id, order.part, order.piece, "kinds", "next_part", "next_piece", "used", "start")
        here = here.join(ahead, here.conv_id.eqNullSafe(ahead.c) & (here.next_part == ahead.p) & (here.next_piece == ahead.k))
        changed = materialize(here.filter("used <> `true`").select("conv_id", "part", "piece", "kinds", "used", "start", "true").mapInArrow(run, schema), "vectors-changed")
        if changed.isEmpty():
            return known.select("conv_id", "part", "piece", F.col("used").alias("after"))
        kept = known.join(changed, same(known, changed, "conv_id", "part", "piece"), "left_anti")
        known, old = materialize(kept.unionByName(changed), "vectors"), known
        discard(old)


def _stitched(slim: DataFrame) -> DataFrame:
    """conv_id, part, piece, after and q: the state each piece begins in. slim: kinds, after and last of each piece."""
    conv = slim.schema["conv_id"].dataType.simpleString()

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.select(["kinds", "after"]).to_pylist()
            ends = []
            for r in rows:
                kinds = codes(r["kinds"])
                vectors = backwards(kinds, tuple(r["after"]))
                ends.append([trace(kinds, [1] * len(kinds), vectors, q, False)[1] for q in range(4)])
            keys = [batch.column(c) for c in ("conv_id", "part", "piece", "after")]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(ends, pa.list_(pa.int32()))], ["conv_id", "part", "piece", "after", "ends"])

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, q = object(), 0
        for batch in batches:
            out = []
            for conv_id, ends in zip(batch.column("conv_id").to_pylist(), batch.column("ends").to_pylist(), strict=True):
                if conv_id != at:
                    at, q = conv_id, 0
                out.append(q)
                q = ends[q]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("conv_id", "part", "piece", "after")), pa.array(out, pa.int32())], ["conv_id", "part", "piece", "after", "q"])

    key = f"conv_id {conv}, part int, piece int, after array<long>"
    ends = slim.select("conv_id", "part", "piece", "kinds", "after").mapInArrow(maps, f"{key}, ends array<int>")
    return ends.repartition("conv_id").sortWithinPartitions("conv_id", "part", "piece").mapInArrow(follow, f"{key}, q int")


_PIECE = "part int, piece int, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired array<struct<role: string, text: string>>, first_turn long, last_turn long, n_turns long, first_role string, last_role string"
_NAMES = ["conv_id", *[x.split()[0] for x in "part piece blank duplicate truncated illegal cost audit repaired first_turn last_turn n_turns first_role last_role".split()]]
_REPAIRED = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
_KINDS = [pa.int32(), pa.int32(), *[pa.int64()] * 5, pa.string(), _REPAIRED, *[pa.int64()] * 3, pa.string(), pa.string()]
LEGAL = {"su", "ua", "au"}


def repair(rows: DataFrame, piece: int = PIECE, piece_chars: int = PIECE_CHARS) -> DataFrame:
    """Pieces of the repaired conversations: conv_id, part, piece, repaired (roles and texts), audit, cost and counts of faults.

    rows: conv_id, turn, role, text, copies. They are taken by turn (null first), then by role and text. A row without any
    character but white space is blank; one whose role and text came before is a duplicate; one that ends otherwise than
    in `.!?` is truncated; the first of these counts. Turns and roles at a piece's ends let `summary` count across pieces.
    Conversations without rows give none. Null roles and texts must be replaced before.
    """
    conv = rows.schema["conv_id"].dataType.simpleString()
    cut, hops = pieces(faults(distinct_rows(rows)), piece, piece_chars)
    joined = cut.join(F.broadcast(hops), same(cut, hops, "conv_id", "part"), "left").select(cut.conv_id, cut.part, "piece", "ends", "turns", "next_part", "previous_part")
    kind = F.expr(f"array_join(transform(turns, t -> CASE WHEN t.blank OR t.again THEN '{BAD}' ELSE cast(CASE left(t.role, 1) WHEN 's' THEN 0 WHEN 'u' THEN 1 WHEN 'a' THEN 2 ELSE 3 END + CASE WHEN t.truncated THEN 4 ELSE 0 END AS string) END), '')")
    last = F.expr("ends AND next_part IS NULL").alias("last")
    keyed = joined.withColumn("last", last).withColumn("kinds", kind)
    several = F.expr("piece > 0 OR NOT ends OR next_part IS NOT NULL OR previous_part IS NOT NULL")
    slim = keyed.filter(several).select("conv_id", "part", "piece", "kinds", "last", F.expr("CASE WHEN last THEN NULL WHEN ends THEN next_part ELSE part END").alias("next_part"), F.expr("CASE WHEN last THEN NULL WHEN ends THEN 0 ELSE piece + 1 END").alias("next_piece"))
    slim = materialize(slim, "piece-kinds")
    alone = keyed.filter(~several).select("conv_id", "part", "piece", "kinds", "last", "turns", F.array(*[F.lit(x).cast("long") for x in apart(END)]).alias("after"), F.lit(0).alias("q"))
    if not slim.isEmpty():
        after = _converged(slim, hops)
        begun = _stitched(slim.join(after, same(slim, after, "conv_id", "part", "piece")).select(slim.conv_id, slim.part, slim.piece, "kinds", "after"))
        begun = materialize(begun, "piece-starts")
        rest = keyed.filter(several)
        alone = alone.unionByName(rest.join(begun, same(rest, begun, "conv_id", "part", "piece")).select(rest.conv_id, rest.part, rest.piece, "kinds", "last", "turns", "after", "q"))

    def one(r: dict) -> tuple:
        turns, kinds, q = r["turns"], codes(r["kinds"]), r["q"]
        copies = [t["copies"] for t in turns]
        edits, _ = trace(kinds, copies, backwards(kinds, tuple(r["after"])), q, r["last"])
        repaired, cost = [], 0
        for t, kind, letters in zip([*turns, None], [*kinds, BAD], edits, strict=True):
            for x in letters:
                new = "assistant" if q == 2 else "user"
                cost += {"D": DELETE, "I": INSERT, "K": 0, "R": REROLE}[x] + (TRUNCATED if x in "KR" and kind >= 4 else 0)
                if x == "K":
                    repaired.append({"role": t["role"], "text": t["text"]})
                    q = SPOKEN[q, kind % 4]
                elif x != "D":
                    repaired.append({"role": new, "text": t["text"] if x == "R" else ""})
                    q = NEXT[q]
        blank = sum(n for t, n in zip(turns, copies, strict=True) if t["blank"])
        duplicate = sum(n if t["again"] else n - 1 for t, n in zip(turns, copies, strict=True) if not t["blank"])
        truncated = sum(t["truncated"] and not t["blank"] and not t["again"] for t in turns)
        illegal = sum(copies) - len(copies) + sum(a["role"][:1] + b["role"][:1] not in LEGAL for a, b in zip(turns, turns[1:]))
        known = [t["turn"] for t in turns if t["turn"] is not None]
        ends = (known[0], known[-1]) if known else (None, None)
        return (r["conv_id"], r["part"], r["piece"], blank, duplicate, truncated, illegal, cost, "".join(edits), repaired, *ends, len(set(known)), turns[0]["role"], turns[-1]["role"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                out = [one(r) for r in part.to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), [part.schema.field("conv_id").type, *_KINDS], strict=True)], _NAMES)

    return alone.mapInArrow(run, f"conv_id {conv}, {_PIECE}")


_SUMS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def summary(repaired: DataFrame, conversations: DataFrame) -> DataFrame:
    """A row for every conv_id: gaps, counts of faults, illegal neighbours, cost, audit and the repaired text's digest.

    A conversation's pieces are read one after the other from a sorted stream; the audit is the only thing that grows. A
    conversation without rows after the damage has zeros, no audit and the digest of no text.
    """
    conv = repaired.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: dict | None = None

        def closed_row(x: dict) -> tuple:
            gaps = x["high"] - x["low"] + 1 - x["n"] if x["low"] is not None else 0
            return (x["conv_id"], gaps, *(x[c] for c in _SUMS[1:]), "".join(x["audit"]), x["sha"].hexdigest())

        kinds = None
        for batch in batches:
            kinds, out = [batch.schema.field("conv_id").type, *[pa.int64()] * 6, pa.string(), pa.string()], []
            for r in batch.to_pylist():
                if at is None or at["conv_id"] != r["conv_id"]:
                    if at is not None:
                        out.append(closed_row(at))
                    at = {"conv_id": r["conv_id"], "low": None, "high": None, "n": 0, "role": None, "audit": [], "sha": hashlib.sha256(), "some": False} | dict.fromkeys(_SUMS[1:], 0)
                for c in _SUMS[1:]:
                    at[c] += r[c]
                if at["role"] is not None:
                    at["illegal"] += at["role"][:1] + r["first_role"][:1] not in LEGAL
                at["role"] = r["last_role"]
                if r["first_turn"] is not None:
                    at["n"] += r["n_turns"] - (at["high"] == r["first_turn"])
                    at["low"] = r["first_turn"] if at["low"] is None else at["low"]
                    at["high"] = r["last_turn"]
                at["audit"].append(r["audit"])
                for t in r["repaired"]:
                    at["sha"].update(("\n" * at["some"] + t["role"] + ":" + t["text"]).encode("utf-8", "surrogatepass"))
                    at["some"] = True
            if out:
                yield rows_of(out, kinds)
        if at is not None:
            yield rows_of([closed_row(at)], kinds)

    def rows_of(out: list[tuple], kinds: list[pa.DataType]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds, strict=True)], ["c", *_SUMS, "audit", "repaired_sha256"])

    found = repaired.repartition("conv_id").sortWithinPartitions("conv_id", "part", "piece").mapInArrow(run, f"c {conv}, {', '.join(f'{x} long' for x in _SUMS)}, audit string, repaired_sha256 string")
    ids = conversations.select("conv_id").distinct()
    zero = {c: F.coalesce(c, F.lit(0)).cast("long") for c in _SUMS} | {"audit": F.coalesce("audit", F.lit("")), "repaired_sha256": F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest()))}
    return ids.join(found, ids.conv_id.eqNullSafe(found.c), "left").select("conv_id", *[x.alias(c) for c, x in zero.items()])
