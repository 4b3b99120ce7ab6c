"""Small column functions: boxes, units, text, files and vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = list[Column]


def area(b: Box) -> Column:
    return F.greatest(b[2] - b[0], F.lit(0.0)) * F.greatest(b[3] - b[1], F.lit(0.0))


def intersection(a: Box, b: Box) -> Column:
    return area([F.greatest(a[0], b[0]), F.greatest(a[1], b[1]), F.least(a[2], b[2]), F.least(a[3], b[3])])


def iou(a: Box, b: Box) -> Column:
    """Shared over joint area; 0 where both boxes are empty."""
    both = intersection(a, b)
    union = area(a) + area(b) - both
    return F.when(union > 0, both / union).otherwise(F.lit(0.0))


def touches(a: Box, b: Box) -> Column:
    return (a[0] <= b[2]) & (b[0] <= a[2]) & (a[1] <= b[3]) & (b[1] <= a[3])


def inside(x: Column, y: Column, b: Box) -> Column:
    return (x >= b[0]) & (x <= b[2]) & (y >= b[1]) & (y <= b[3])


def grow(b: Box, share: float) -> Box:
    """Larger by `share` of its size on each side."""
    dx, dy = (b[2] - b[0]) * share, (b[3] - b[1]) * share
    return [b[0] - dx, b[1] - dy, b[2] + dx, b[3] + dy]


def clip(b: Box, width: float, height: float) -> Box:
    return [F.greatest(F.least(c, F.lit(float(m))), F.lit(0.0)) for c, m in zip(b, (width, height, width, height), strict=True)]


#: Metres and nanoseconds in a unit.
METRES = {"m": 1.0, "cm": 0.01, "mm": 0.001}
NANOS = {"s": 1_000_000_000, "ms": 1_000_000, "us": 1_000, "ns": 1}


def to_metres(x: Column, unit: Column) -> Column:
    """Null for an unknown unit."""
    return F.coalesce(*(F.when(unit == u, x * f) for u, f in METRES.items()))


def to_nanos(x: Column, unit: Column) -> Column:
    return F.coalesce(*(F.when(unit == u, x * f) for u, f in NANOS.items()))


def reference_time(t: Column, offset: Column, ppm: Column) -> Column:
    return (1 + ppm * 1e-6) * t + offset


def stream_time(t: Column, offset: Column, ppm: Column) -> Column:
    return (t - offset) / (1 + ppm * 1e-6)


def token(text: Column) -> Column:
    """The first run of a-z, 0-9 and apostrophes of the lower-cased text; empty if there is none."""
    return F.regexp_extract(F.lower(text), r"([a-z0-9']+)", 1)


def hash_bin(tok: Column, bins: int) -> Column:
    return (F.crc32(tok) % bins).cast("int")


def numbered_words(text: Column) -> Column:
    """A text's words in order of their letters, each followed by a blank and the number of equal ones before it, so that no two
    are the same. It costs a sort; to compare many texts, keep it as a column."""
    words = F.sort_array(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}']+)"), F.lit(1)))

    def numbered(w: Column) -> Column:
        firsts = F.filter(F.transform(w, lambda x, i: F.when((i == 0) | (x != F.get(w, i - 1)), i)), lambda i: i.isNotNull())
        ends = F.array_append(F.slice(firsts, 2, F.greatest(F.size(firsts), F.lit(1))), F.size(w))
        run = lambda i, end: F.transform(F.sequence(F.lit(0), end - i - 1), lambda k: F.concat_ws(" ", F.get(w, i), k.cast("string")))
        return F.flatten(F.zip_with(firsts, ends, lambda i, end: F.when(i.isNotNull(), run(i, end)).otherwise(F.array().cast("array<string>"))))

    # bound once: each use of the words themselves would search the text anew
    return F.get(F.transform(F.array(words), numbered), F.lit(0))


def text_similarity(a: Column, b: Column) -> Column:
    """Share of the shorter text's words that the other has too, repeats counted; 0 for a text without words. a, b: numbered_words."""
    shorter = F.least(F.size(a), F.size(b))
    return F.when(shorter > 0, F.size(F.array_intersect(a, b)) / shorter).otherwise(F.lit(0.0))


def parse_time(text: Column) -> Column:
    """A timestamp in one of the formats that recorders write; null if none fits."""
    formats = ["yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyyMMdd_HHmmss", "yyyy/MM/dd HH:mm", "yyyy-MM-dd"]
    return F.coalesce(*(F.try_to_timestamp(text, F.lit(f)) for f in formats))


def path_ok(path: Column) -> Column:
    """A relative path without empty, `.` or `..` parts, backslashes or control characters."""
    bad = path.rlike(r"^/|\\|[\x00-\x1f]|(^|/)\.{0,2}(/|$)")
    return F.coalesce(~bad & (path != ""), F.lit(False))


def sanitise(text: Column, most: int) -> Column:
    """One line of printable text of at most `most` characters."""
    return F.substring(F.trim(F.regexp_replace(text, r"[\x00-\x20]+", " ")), 1, most)


def rmse(a: Column, b: Column) -> Column:
    """Root mean square difference of two arrays of the same length."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x) / F.size(a))


def hist_distance(a: Column, b: Column) -> Column:
    """Bhattacharyya distance of two histograms; 0.5 when one is unknown or empty."""
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    shared = F.aggregate(F.zip_with(a, b, lambda x, y: F.sqrt(x * y)), F.lit(0.0), lambda s, x: s + x) / F.sqrt(total(a) * total(b))
    return F.when((total(a) > 0) & (total(b) > 0), F.sqrt(F.greatest(1 - shared, F.lit(0.0)))).otherwise(F.lit(0.5))


def mean(a: Column) -> Column:
    """Of an array of doubles without nulls; null if it is empty."""
    return F.try_divide(F.aggregate(a, F.lit(0.0), lambda s, x: s + x), F.size(a))


def deviation(a: Column, centre: Column) -> Column:
    """Population deviation of an array of doubles without nulls from its mean; null if it is empty."""
    return F.sqrt(F.try_divide(F.aggregate(a, F.lit(0.0), lambda s, x: s + (x - centre) * (x - centre)), F.size(a)))


def best_lag(a: Column, b: Column, lag: int, least: int) -> Column:
    """What `sequence.cross_correlation` finds, as a struct (r, lag), of two arrays of the same length with a value, or null, a frame;
    null where no lag counts."""
    shift = lambda v, o: F.slice(v, F.greatest(o, F.lit(0)) + 1, F.greatest(F.size(v) - F.abs(o), F.lit(0)))
    pairs = lambda o: F.filter(F.zip_with(shift(a, -o), shift(b, o), lambda x, y: F.struct(x.alias("x"), y.alias("y"))), lambda p: p["x"].isNotNull() & p["y"].isNotNull())
    # each step is bound once by a transform, as in numbered_words
    lags = F.transform(F.sequence(F.lit(-lag), F.lit(lag)), lambda o: F.struct(o.alias("o"), pairs(o).alias("p")))
    known = F.transform(F.filter(lags, lambda t: F.size(t["p"]) >= least), lambda t: F.struct(t["o"].alias("o"), t["p"].alias("p"), mean(t["p"]["x"]).alias("mx"), mean(t["p"]["y"]).alias("my")))
    both = lambda t: F.aggregate(t["p"], F.lit(0.0), lambda s, p: s + (p["x"] - t["mx"]) * (p["y"] - t["my"])) / F.size(t["p"])
    parts = F.transform(known, lambda t: F.struct(t["o"].alias("o"), both(t).alias("c"), deviation(t["p"]["x"], t["mx"]).alias("dx"), deviation(t["p"]["y"], t["my"]).alias("dy")))
    rounded = F.transform(F.filter(parts, lambda t: (t["dx"] > 1e-9) & (t["dy"] > 1e-9)), lambda t: F.struct((-F.round(F.try_divide(t["c"], t["dx"] * t["dy"]), 9)).alias("m"), F.abs(t["o"]).alias("s"), t["o"].alias("lag")))
    best = F.transform(F.array(F.array_min(F.filter(rounded, lambda t: t["m"].isNotNull()))), lambda k: F.when(k.isNotNull(), F.struct((-k["m"]).alias("r"), k["lag"].alias("lag"))))
    return F.get(best, F.lit(0))


def natural_key(name: Column) -> Column:
    """Sorts digits by value: every run of digits is padded to 12 places."""
    parts = F.regexp_extract_all(name, F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), F.lpad(p, 12, "0")).otherwise(p)), "")


def label_scalar(value: Column) -> Column:
    """A JSON value as text: a scalar as it is, lists and objects as compact JSON."""
    return F.coalesce(F.get_json_object(value, "$"), value)


def extract_json(text: Column) -> Column:
    """The first JSON object in free text, inside its first fence if it has one: from the first brace on, the shortest piece
    that is one; null without any. Braces in strings and text around the object don't matter."""
    fence = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1)
    body = F.when(fence != "", fence).otherwise(text)
    parts = F.split(F.regexp_extract(body, r"(?s)\{.*\}", 0), r"\}")
    pieces = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.concat(F.array_join(F.slice(parts, F.lit(1), i), "}"), F.lit("}")))
    whole = F.filter(pieces, lambda p: p.startswith("{") & F.try_parse_json(p).isNotNull())
    return F.try_element_at(whole, F.lit(1))


def normal_annotation(json: Column) -> Column:
    """An annotation in a fixed shape: persons (label, action, holding as a list, attending_to), coordination, handover
    (occurring, giver, receiver, object), summary and note; what is missing is null, no list is."""
    person = "struct<label: string, action: string, holding: string, attending_to: string>"
    d = F.from_json(json, f"struct<persons: array<{person}>, coordination: string, handover: struct<occurring: string, giver: string, receiver: string, object: string>, summary: string, note: string>")
    none = F.expr("cast(array() AS array<string>)")
    held = lambda h: F.when(h.isNull() | (h == ""), none).when(h.startswith("["), F.filter(F.coalesce(F.from_json(h, "array<string>"), none), lambda x: x.isNotNull())).otherwise(F.array(h))
    persons = F.transform(F.filter(F.coalesce(d["persons"], F.expr(f"cast(array() AS array<{person}>)")), lambda p: p.isNotNull()), lambda p: F.struct(p["label"].alias("label"), p["action"].alias("action"), held(p["holding"]).alias("holding"), p["attending_to"].alias("attending_to")))
    occurs = d["handover"]["occurring"]
    handover = F.when(d["handover"].isNotNull(), F.struct((~occurs.isin("false", "0", "", "[]", "{}")).alias("occurring"), *(d["handover"][c].alias(c) for c in ("giver", "receiver", "object"))))
    return F.struct(persons.alias("persons"), d["coordination"].alias("coordination"), handover.alias("handover"), d["summary"].alias("summary"), F.nullif(d["note"], F.lit("")).alias("note"))
