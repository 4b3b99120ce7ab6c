"""Line deduplication by a segment-partition edit join, in DataFrame functions alone.

Exact repeats of any line are found by its hash. For lines long enough, two of at most `edits` edits between them share a
segment: of the edits + 1 segments of the shorter one (equally long ones: of either) one stands unchanged in the other, at a
place that is off by few characters. Every distinct line is indexed by its segments with its length and probed by its
substrings at those places for all lengths from its own down to `edits` less. Keys that only one line has are dropped before
lines are paired. Pairs whose letter counts allow it are verified by a banded bit-parallel edit distance inside the join, so
that unverified pairs are never rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

EDITS = 2
#: Shorter lines (in characters, without spaces at their ends) repeat only if they are equal.
MIN_CHARS = 30
#: Up to so many line hashes of 8 bytes (32 MB in a hash table at most) are broadcast to pick lines; more are joined by a shuffle.
BROADCAST_HASHES = 1_000_000
#: Letters that are counted together; an edit changes the counts by two in all at most.
COUNTED = ("ea", "ti", "on", "sr", "hldc", "umfpg", "wybvkjxqz", "0123456789")


def probes(edits: int) -> list[tuple[int, int, int, int]]:
    """Segment, how much shorter the other line is, how far the place is off, and 0 for a line's own segments, else 1."""
    own = [(i, 0, 0, 0) for i in range(edits + 1)]
    return own + [
        (i, less, shift, 1)
        for less in range(edits + 1)
        for i in range(edits + 1)
        for shift in range(max(-i, less - (edits - i)), min(i, less + edits - i) + 1)
        if less or shift
    ]


def keyed(lines: DataFrame, edits: int, bit: int) -> DataFrame:
    """key and h of every segment (bit 0) or probe (bit 1) of lines (h, line, length).

    Segments are as even as can be, longer ones last. A place before the line or beyond its end gives no key.
    """
    n = edits + 1
    places = ", ".join(f"named_struct('i', {i}, 'less', {less}, 'shift', {shift})" for i, less, shift, own in probes(edits) if own == bit)
    short, longer = F.expr(f"cast((length - k.less) div {n} as int)"), F.expr(f"cast((length - k.less) % {n} as int)")
    rows = lines.select("h", "line", "length", F.explode(F.expr(f"array({places})")).alias("k")).withColumns({"short": short, "longer": longer})
    rows = rows.withColumn("own", F.expr(f"short + if(k.i >= {n} - longer, 1, 0)"))
    rows = rows.withColumn("at", F.expr(f"short * k.i + greatest(k.i - ({n} - longer), 0) + 1 + k.shift")).filter("at >= 1 AND at + own - 1 <= length")
    return rows.select(F.expr("xxhash64(k.i, length - k.less, substring(line, at, own))").alias("key"), "h")


def within(a: str, b: str, edits: int) -> str:
    """SQL that is true where the strings are at most `edits` edits apart, their lengths differing by no more than that.

    Bit r of lane e is set when the first t - edits + r characters of a can become the first t of b by e edits at most. A step of b
    keeps bits where the characters agree, hands all on to the next lane for a character changed, shifted down for one put
    in, and, when they are read again, shifted up for one left out. A line has no line feed, so that these may stand for
    the places outside a.
    """
    if not 0 < edits <= 3:
        raise ValueError("edits must be 1 to 3")
    width = 3 * edits + 2
    lanes = [e * width for e in range(edits + 1)]
    mask = sum(((1 << (2 * edits + 1)) - 1) << at for at in lanes)
    ones = sum(1 << at for at in lanes)
    reached = "(acc.q" + "".join(f" | (shiftleft(acc.q, {d * (width + 1)}) & {mask}L)" for d in range(1, edits + 1)) + ")"
    same = " + ".join(f"if(substring(acc.a, acc.t + {4 * r + 1}, 4) = c, {1 << r}L, 0L)" for r in range(2 * edits + 1))
    step = f"({reached} & (({same}) * {ones}L)) | (shiftleft({reached}, {width}) & {mask}L) | (shiftleft({reached}, {width - 1}) & {mask}L)"
    padded = f"encode(concat(repeat('\\n', {edits}), {a}, repeat('\\n', {2 * edits})), 'UTF-32')"
    start = f"named_struct('a', {padded}, 't', 0, 'q', {ones << edits}L)"
    last = f"shiftright({reached}, {lanes[-1] + edits} + length({a}) - length({b})) & 1 = 1"
    return f"aggregate(transform(split({b}, ''), x -> encode(x, 'UTF-32')), {start}, (acc, c) -> named_struct('a', acc.a, 't', acc.t + 4, 'q', {step}), acc -> {last})"


def lines_of(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, pos (0-based), line (without spaces at its ends), h and h2 of every line with more than spaces."""
    return (
        docs.filter("text IS NOT NULL")
        .select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
        .withColumn("line", F.trim("line"))
        .filter("line <> ''")
        .withColumns({"h": F.xxhash64("line"), "h2": F.xxhash64(F.lit(1), "line")})
    )


def near_places(lines: DataFrame, edits: int, min_chars: int) -> DataFrame:
    """h, h2 and near: of every distinct long line that has one within `edits` edits, the first place of such a line.

    lines: h, h2, place, line; one row per line.
    """
    long = lines.select("h", "line", F.length("line").alias("length")).filter(F.col("length") >= min_chars)
    index, probe = keyed(long, edits, 0), keyed(long, edits, 1)
    heads = index.groupBy("key").agg(F.min("h").alias("low"), F.max("h").alias("high"))
    hits = materialize(probe.join(heads, "key").filter("h <> low OR h <> high").select("key", "h").distinct(), "line-probes")
    several = heads.filter("low <> high").select("key").union(hits.select("key")).distinct()
    own = materialize(index.join(several, "key", "left_semi").distinct(), "line-segments")
    wanted = materialize(own.select("h").union(hits.select("h")).distinct(), "line-candidates")
    few = wanted.count() <= BROADCAST_HASHES
    counts = [(F.length("line") - F.length(F.translate("line", c, ""))).alias(f"c{k}") for k, c in enumerate(COUNTED)]
    texts = lines.join(F.broadcast(wanted) if few else wanted, "h", "left_semi").filter(F.length("line") >= min_chars).select("h", "h2", "place", "line", *counts)
    texts = materialize(texts, "line-texts")
    a, b = own.join(texts, "h"), own.withColumn("probe", F.lit(False)).union(hits.withColumn("probe", F.lit(True))).join(texts, "h")
    once = "(b.probe OR a.h < b.h OR (a.h = b.h AND a.h2 < b.h2)) AND NOT (a.h = b.h AND a.h2 = b.h2)"
    close = f"abs(length(a.line) - length(b.line)) <= {edits} AND {' + '.join(f'abs(a.c{k} - b.c{k})' for k in range(len(COUNTED)))} <= {2 * edits}"
    links = a.alias("a").join(b.alias("b"), F.expr(f"a.key = b.key AND {once} AND {close} AND {within('a.line', 'b.line', edits)}"))
    sides = F.array(F.struct("a.h", "a.h2", F.col("b.place").alias("place")), F.struct("b.h", "b.h2", F.col("a.place").alias("place")))
    return links.select(F.explode(sides).alias("s")).select("s.*").groupBy("h", "h2").agg(F.min("place").alias("near"))


def first_places(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """h, h2, own and first: for every distinct line its first place (doc_id, pos), and that of a line within `edits` edits."""
    row = F.struct(F.struct("doc_id", "pos").alias("place"), "line").alias("row")
    lines = lines_of(docs).select("h", "h2", row).groupBy("h", "h2").agg(F.min("row").alias("row"))
    lines = materialize(lines.select("h", "h2", "row.place", "row.line"), "lines")
    out = lines.select("h", "h2", "place").join(near_places(lines, edits, min_chars), ["h", "h2"], "left")
    return out.select("h", "h2", F.col("place").alias("own"), F.least("place", F.coalesce("near", "place")).alias("first"))


def repeated_lines(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, text_hash, pos and near of every line that an earlier place (by doc_id, then line number) has already, exactly
    or, from min_chars characters on, within `edits` edits; near tells lines whose exact text this place is the first to have.

    A line counts as an earlier one even if it is removed itself. Empty lines are left alone. Rows with the same id are one
    document: the same line at the same place of two of them is no repeat. A null id comes first.
    """
    at = F.struct("doc_id", "pos")
    places = lines_of(docs).select("doc_id", "text_hash", "pos", "h", "h2")
    found = places.join(first_places(docs, edits, min_chars), ["h", "h2"])
    return found.filter(at > F.col("first")).select("doc_id", "text_hash", "pos", (at <= F.col("own")).alias("near")).distinct()


def dedup_report(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, n_lines, n_removed, n_near (of them) and removed (their numbers) of every document.

    Null texts have no lines, empty texts one. Repeated rows give repeated rows; other columns are not carried.
    """
    gone = repeated_lines(docs, edits, min_chars).groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_list("pos")).alias("removed"), F.count_if("near").alias("n_near"))
    rows = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("t"), F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))).cast("long").alias("n_lines"))
    return rows.join(gone, F.expr("id <=> doc_id AND t = text_hash"), "left").select(
        F.col("id").alias("doc_id"), "n_lines", F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.coalesce("removed", F.expr("cast(array() as array<int>)")).alias("removed"),
    )


def remove_repeats(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """The documents without their repeated lines; n_chars, where there is one, follows the text. Documents of which nothing
    but white space is left, while something was removed, go; others with null or empty texts stay. All columns are kept,
    whatever their names."""
    gone = repeated_lines(docs, edits, min_chars).groupBy("doc_id", "text_hash").agg(F.collect_list("pos").alias("removed"))
    whole = docs.select(F.struct(*docs.columns).alias("d"))
    met = whole.join(gone, F.col("d.doc_id").eqNullSafe(F.col("doc_id")) & (F.xxhash64("d.text") == F.col("text_hash")), "left")
    hit = F.col("removed").isNotNull()
    # what stands between two removed lines, in one pass; lambda variables, so that neither array is made again for each
    bounds = "concat(array(-1), array_sort(removed), array(size(lines)))"
    between = "flatten(transform(sequence(1, size(b) - 1), k -> slice(lines, b[k - 1] + 2, b[k] - b[k - 1] - 1)))"
    rest = F.expr(f"element_at(transform(array(split(d.text, '\\n')), lines -> element_at(transform(array({bounds}), b -> array_join({between}, '\\n')), 1)), 1)")
    met = met.select("d", hit.alias("hit"), F.when(hit, rest).otherwise(F.col("d.text")).alias("rest")).filter(~F.col("hit") | F.col("rest").rlike(r"\S"))
    new = {"text": F.col("rest"), "n_chars": F.when(F.col("hit"), F.length("rest").cast("long")).otherwise(F.col("d.n_chars")) if "n_chars" in docs.columns else None}
    return met.select(*((new[c] if c in new else F.col("d").getField(c)).alias(c) for c in docs.columns))
