"""Quality rules: base counts, and the divergence of a document from its language's reference.

A language's reference is two histograms over all its documents: of character classes, and of its commonest short words
with one bin for all others. A document is dropped when a base rule fails or when a Jensen-Shannon distance (base 2, 0 to 1)
to the reference is over its limit, provided it is long enough for the histogram to mean something. As all words that are not
common share a bin, a text without any common word is only about half of the way to 1; so the share of common words alone
has a distance of its own, told in parts of the distance that such a text has.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the base rules.
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = "#*$%&|<>"
MIN_WORDS, REPEAT_SHARE = 50, 0.5
#: Character classes, in the order of the histogram.
CLASSES = ["lower", "upper", "other letter", "digit", "space", "newline", "end mark", "comma", "quote", "symbol", "other mark", "other"]
COMMON, LONGEST_COMMON = 100, 5
#: Least characters that are no white space, and least words, for which a distance counts; and the largest distances of a
#: kept document.
MIN_CHARS, MIN_COUNTED_WORDS = 200, 50
MAX_CLASS_DISTANCE, MAX_WORD_DISTANCE = 0.35, 0.75
#: The same for the share of common words, and the standard deviations that a count of them may be off by chance.
MAX_COMMON_DISTANCE, CHANCE = 0.5, 4.0
#: A language is what has the form of a language tag; all else is judged by all languages together. Words of all languages
#: together that are mixed into each language's own reference, so that one with few words is held against both.
LANG, POOLED, PRIOR_WORDS = r"^[A-Za-z]{1,8}([-_][A-Za-z0-9]{1,8}){0,3}$", "*", 2_000


def _class_of(c: str) -> int:
    if c.isalpha():
        return 0 if c.islower() else 1 if c.isupper() else 2
    if c.isdigit():
        return 3
    if c == "\n":
        return 5
    if c.isspace():
        return 4
    for k, marks in ((6, ".!?"), (7, ",;:"), (8, "\"'()-"), (9, SYMBOLS)):
        if c in marks:
            return k
    return 10 if not c.isalnum() and ord(c) < 0x3000 else 11


TABLE = np.array([_class_of(chr(i)) for i in range(0x3000)], dtype=np.int64)


def classes(text: str) -> np.ndarray:
    """Counts of the character classes of a whole text."""
    out = np.zeros(len(CLASSES), dtype=np.int64)
    for at in range(0, len(text), 1 << 20):
        points = np.frombuffer(text[at : at + (1 << 20)].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        small = points[points < len(TABLE)]
        out += np.bincount(TABLE[small], minlength=len(CLASSES))
        for p in points[points >= len(TABLE)]:
            out[_class_of(chr(p))] += 1
    return out


def base(text: str | None, words: list[str]) -> dict:
    """The base counts of one text: words of white-space-free characters, symbols, repeated lines, words in repeated
    3-word windows."""
    text = text or ""
    n = len(words)
    repeat = 0
    if n > 3:
        ids: dict[str, int] = {}
        w = np.array([ids.setdefault(x, len(ids)) for x in words], dtype=np.int64)
        k = len(ids)
        pair = w[:-1] * k + w[1:]
        _, pair = np.unique(pair, return_inverse=True)
        _, inverse, counts = np.unique(pair[:-1] * k + w[2:], return_inverse=True, return_counts=True)
        twice = counts[inverse] >= 2
        hit = np.zeros(n, dtype=bool)
        for shift in range(3):
            hit[shift : shift + len(twice)] |= twice
        repeat = int(hit.sum())
    lines = [x for x in text.split("\n") if WORDS.search(x)] if "\n" in text else []
    return {
        "n_words": n,
        "word_chars": sum(map(len, words)),
        "n_symbols": sum(map(text.count, SYMBOLS)),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": repeat,
    }


def _short(words: list[str]) -> list[str]:
    """Lower-cased words without marks at their ends, of at most LONGEST_COMMON letters."""
    return [x for w in words if len(w) <= LONGEST_COMMON + 1 and 0 < len(x := w.strip(".,;:!?\"'()").lower()) <= LONGEST_COMMON]


def references(docs: DataFrame) -> DataFrame:
    """lang, total (words), classes (histogram), words (the COMMON commonest short words), shares (of each among all words).

    Counted over all documents; POOLED is over all languages.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[str, tuple[np.ndarray, Counter, int]] = {}

        def flush() -> pd.DataFrame:
            rows = []
            for lang, (hist, words, n) in found.items():
                rows += [(lang, None, int(c), k) for k, c in enumerate(hist)]
                rows.append((lang, None, n, len(CLASSES)))
                rows += [(lang, w, c, -1) for w, c in words.items()]
            found.clear()
            return pd.DataFrame(rows, columns=["lang", "word", "n", "bin"]).astype({"n": "int64", "bin": "int64"})

        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"], strict=True):
                if text is None:
                    continue
                words = WORDS.findall(text)
                hist, counter, n = found.get(lang) or (np.zeros(len(CLASSES), np.int64), Counter(), 0)
                counter.update(_short(words))
                found[lang] = (hist + classes(text), counter, n + len(words))
            if sum(len(x[1]) for x in found.values()) > 200_000:
                yield flush()
        if found:
            yield flush()

    own = docs.select(F.when(F.col("lang").rlike(LANG), F.col("lang")).otherwise(F.lit(POOLED)).alias("lang"), "text")
    counts = own.mapInPandas(count, "lang string, word string, n long, bin long").groupBy("lang", "word", "bin").agg(F.sum("n").alias("n"))
    pooled = F.explode(F.when(F.col("lang") == POOLED, F.array(F.lit(POOLED))).otherwise(F.array("lang", F.lit(POOLED))))
    counts = counts.withColumn("lang", pooled).groupBy("lang", "word", "bin").agg(F.sum("n").alias("n"))
    bins = counts.filter("bin >= 0").groupBy("lang").agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("bins"))
    top = (
        counts.filter("bin < 0")
        .withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word")))
        .filter(F.col("rank") <= COMMON)
        .groupBy("lang")
        .agg(F.sort_array(F.collect_list(F.struct("rank", "word", "n"))).alias("top"))
    )
    total = F.col("bins")[len(CLASSES)]
    return bins.join(top, "lang", "left").select(
        "lang",
        total.alias("total"),
        F.array(*(F.col("bins")[k].cast("double") for k in range(len(CLASSES)))).alias("classes"),
        F.coalesce("top.word", F.expr("cast(array() as array<string>)")).alias("words"),
        F.coalesce(F.transform("top.n", lambda n: F.try_divide(n, total)), F.expr("cast(array() as array<double>)")).alias("shares"),
    )


def mixed_references(rows: list) -> dict[str, tuple[np.ndarray, dict[str, int], np.ndarray]]:
    """Per language the histogram of classes, the places of its common words, and the histogram of these with one bin for all
    other words; each with PRIOR_WORDS words of all languages together mixed in."""
    pooled = next((r for r in rows if r["lang"] == POOLED), None)
    if pooled is None:
        return {}
    base, known = np.array(pooled["classes"]) / max(1, pooled["total"]), {}
    for r in rows:
        weight = r["total"] / (r["total"] + PRIOR_WORDS)
        share = Counter({w: weight * (s or 0.0) for w, s in zip(r["words"], r["shares"], strict=True)})
        for w, s in zip(pooled["words"], pooled["shares"], strict=True):
            share[w] += (1 - weight) * (s or 0.0)
        top = sorted(share, key=lambda w: (-share[w], w))[:COMMON]
        shares = np.array([share[w] for w in top])
        known[r["lang"]] = (np.array(r["classes"]) + PRIOR_WORDS * base, {w: k for k, w in enumerate(top)}, np.append(shares, max(0.0, 1 - shares.sum())))
    return known


def distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance of two histograms, base 2; 0 if one is empty."""
    if not p.sum() or not q.sum():
        return 0.0
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    part = lambda x: float(np.sum(x[x > 0] * np.log2(x[x > 0] / m[x > 0])))
    return float(np.sqrt(max(0.0, (part(p) + part(q)) / 2)))


def common_distance(n_common: float, n: float, share: float) -> float | None:
    """Distance of n_common common words among n to a reference's share of them, 1 for a text that has none; null where
    chance explains the number."""
    if abs(n_common - n * share) <= CHANCE * np.sqrt(n * share * (1 - share)):
        return None
    ref = np.array([share, 1 - share])
    return distance(np.array([n_common, n - n_common]), ref) / distance(np.array([0.0, 1.0]), ref)


def judge(docs: DataFrame, refs: DataFrame | None = None) -> DataFrame:
    """doc_id, the base counts, base_failed, class_distance, word_distance, common_distance and kept of every whole text.

    A document is held against the reference of its `lang`, with a little of all languages' together; where that is null or
    no language tag, against all languages' alone. Null and empty texts have counts of 0 and fail the base rules. Distances
    of texts under the minimum lengths are null and don't count; nor does common_distance where chance explains the number
    of common words. Repeated rows give repeated rows; other columns are not carried. The references, some 3 KB for each
    language, go through the driver to the tasks.
    """
    known = mixed_references((references(docs) if refs is None else refs).collect())
    fallback = known.get(POOLED, (np.zeros(len(CLASSES)), {}, np.zeros(1)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, lang, text in zip(batch["doc_id"], batch["lang"], batch["text"], strict=True):
                words = WORDS.findall(text) if text else []
                row = base(text, words)
                row["base_failed"] = row["n_words"] < MIN_WORDS or 100 * row["n_repeat_words"] > 100 * REPEAT_SHARE * row["n_words"]
                ref, index, shares = known.get(lang, fallback)
                hist = classes(text or "")
                row["class_distance"] = distance(hist, ref) if hist.sum() - hist[4:6].sum() >= MIN_CHARS else None
                own = np.zeros(len(shares))
                for w, c in Counter(_short(words)).items():
                    own[index.get(w, -1)] += c
                own[-1] += len(words) - own.sum()
                row["word_distance"] = distance(own, shares) if len(words) >= MIN_COUNTED_WORDS else None
                row["common_distance"] = common_distance(own[:-1].sum(), len(words), shares[:-1].sum()) if len(words) >= MIN_COUNTED_WORDS else None
                rows.append({"doc_id": doc_id, **row})
            yield pd.DataFrame(rows, columns=COLUMNS).astype({"doc_id": "Int64", "class_distance": "float64", "word_distance": "float64", "common_distance": "float64"})

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, class_distance double, word_distance double, common_distance double"
    out = docs.select("doc_id", "lang", "text").mapInPandas(run, schema)
    out = out.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("class_distance", "word_distance", "common_distance")})
    far = (F.coalesce("class_distance", F.lit(0.0)) > MAX_CLASS_DISTANCE) | (F.coalesce("word_distance", F.lit(0.0)) > MAX_WORD_DISTANCE) | (F.coalesce("common_distance", F.lit(0.0)) > MAX_COMMON_DISTANCE)
    return out.withColumn("kept", ~F.col("base_failed") & ~far)


COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "class_distance", "word_distance", "common_distance"]
