"""Toxicity of restored text: noisy-channel deobfuscation, then a score.

A token that may be disguised (digits or signs for letters, letters set apart, letters repeated) becomes a lattice of what
its characters may stand for. A Viterbi search finds the cheapest path under the channel's costs and a character trigram
model counted over all documents. The restored words and their beginnings are looked up in a lexicon learned from the
labels, and a logistic model turns what was found into a score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, held, materialize

#: What a sign may stand for (fixed values).
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "#": "h",
}
GAPS = " ._-*~/\\'`^"
#: Costs of the channel in nats: a sign for a letter, a sign that means nothing, a gap dropped or kept, a letter too many.
SIGN, NOISE, DROP, KEEP, REPEAT, ANY = 0.7, 4.0, 0.2, 1.0, 0.3, 3.5
TOKENS = re.compile(r"[^\x20\x09-\x0D]+")
EDGE = ".,;:!?\"'()[]{}%&*$#=<>-_"
DISGUISED = re.compile(r"[0-9@$!|+(<€£#*]|(.)\1\1|(?:[^\W_][._\-*~/'`^]){2,}[^\W_]")
APART = re.compile(r"(?<!\S)(?:\S[ ._\-*]){2,}\S(?!\S)")
LETTERS = re.compile(r"[^\W\d_]+")
CLASSES = 64
#: Labelled documents that the classifier is fitted on, at most; words' beginnings that count as features.
SAMPLE, BEGINNINGS = 20_000, (3, 4, 5, 6)
#: Least evidence (likelihood ratio statistic) and least toxic documents of a feature in the lexicon.
EVIDENCE, LEAST = 20.0, 3
#: Disguised tokens kept with what they were read as, and the longest that is kept.
CACHE, LONGEST = 50_000, 64


def code(c: str) -> int:
    """Class of a lower-case letter: 1 to 26 for a to z, others by code point; 0 for what is no letter."""
    if "a" <= c <= "z":
        return ord(c) - 96
    return 27 + ord(c) % 37 if c.isalpha() else 0


TABLE = np.array([0 if 0xD800 <= i < 0xE000 else code(chr(i).lower()[0]) for i in range(0x10000)], dtype=np.int64)


def trigrams(text: str) -> np.ndarray:
    """The trigrams' numbers of a text, anything but letters being one blank, with a blank before and behind."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    c = TABLE[np.minimum(points, 0xFFFF)]
    c = c[np.concatenate((c[:1] > 0, (c[1:] > 0) | (c[:-1] > 0)))] if len(c) else c
    c = np.concatenate(([0, 0], c, [0]))
    return (c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:]


def trigram_counts(docs: DataFrame) -> np.ndarray:
    """Counts of character trigrams over all whole texts, about a million characters at a time; texts are apart by a blank."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(CLASSES**3, dtype=np.int64)
        for batch in batches:
            texts = [t for t in batch["text"] if t]
            for at, end in chunks(texts):
                joined = " ".join(texts[at:end])
                for k in range(0, len(joined), 1 << 20):
                    total += np.bincount(trigrams(joined[k : k + (1 << 20)]), minlength=CLASSES**3)
        hit = np.flatnonzero(total)
        yield pd.DataFrame({"gram": hit, "n": total[hit]})

    rows = docs.select("text").mapInPandas(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(CLASSES**3, dtype=np.float64)
    for r in rows:
        out[r["gram"]] = r["n"]
    return out


def language_model(counts: np.ndarray) -> list:
    """-log P(c | a, b) as nested lists, trigrams backed by bigrams and these by single letters."""
    three = counts.reshape(CLASSES, CLASSES, CLASSES)
    two, one = three.sum(axis=0), three.sum(axis=(0, 1))
    p1 = (one + 1) / (one.sum() + CLASSES)
    p2 = (two + 5 * p1) / (two.sum(axis=1, keepdims=True) + 5)
    p3 = (three + 5 * p2[None]) / (three.sum(axis=2, keepdims=True) + 5)
    return (-np.log(p3)).tolist()


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """Per run of equal characters the strings it may stand for, with the channel's costs. Gaps stand for nothing or a blank."""
    out: list[list[tuple[str, float]]] = []
    at = 0
    while at < len(token):
        c, end = token[at], at + 1
        while end < len(token) and token[end] == c:
            end += 1
        n, at = end - at, end
        if c.isalpha():
            out.append([(c, 0.0)] if n == 1 else [(c * 2, 0.0), (c, REPEAT * (n - 1))] if n == 2 else [(c, REPEAT), (c * 2, REPEAT)])
        elif c in LEET:
            most = [(x * k, SIGN * min(n, 3)) for x in LEET[c] for k in ((1,) if n == 1 else (1, 2))]
            out.append([*most, (" ", NOISE)])
        elif c == "*":
            out.append([("", DROP), (" ", KEEP), *((chr(x), ANY) for x in range(97, 123))])
        elif c in GAPS:
            out.append([("", DROP), (" ", KEEP)])
        else:
            out.append([(" ", 0.0)])
    return out


def restore(token: str, model: list) -> str:
    """The cheapest reading of a lower-cased token; exact search, the state being the last two characters' classes."""
    states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    for options in lattice(token):
        fresh: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (cost, path) in states.items():
            for text, price in options:
                x, y, total = a, b, cost + price
                for c in text:
                    z = code(c)
                    if z or y:  # one blank at a time
                        total += model[x][y][z]
                        x, y = y, z
                if (x, y) not in fresh or total < fresh[(x, y)][0]:
                    fresh[(x, y)] = (total, (text, path) if text else path)
        states = fresh
    _, path = min(((cost + model[a][b][0], path) for (a, b), (cost, path) in states.items()), key=lambda s: s[0])
    parts = []
    while path:
        parts.append(path[0])
        path = path[1]
    return "".join(reversed(parts))


def words_of(token: str, model: list) -> list[str]:
    """Words of a lower-cased token, as written and as restored."""
    core = re.sub(r"(\W)\1{2,}$", "", token).strip(EDGE)
    out = LETTERS.findall(core)
    # the disguise of a token may reach its ends, as in `a$$`, but a bare mark at the end is no letter
    raw = re.sub(r"([^\w\s])\1{2,}$", "", token).strip(".,;:?\"'")
    raw = raw if any(c in "$@" for c in raw[-2:]) else raw.rstrip(EDGE)
    if raw and any(c.isalpha() for c in raw) and DISGUISED.search(raw):
        out += restore(raw, model).split()
    return out


def beginnings(words: list[str]) -> list[str]:
    """Features of words: each itself, marked, and its beginnings."""
    out = []
    for w in words:
        if len(w) >= BEGINNINGS[0]:
            out.append(f"{w}$")
            out += [w[:n] for n in BEGINNINGS if n <= len(w)]
    return out


def _marks() -> np.ndarray:
    """Bits of each character of the basic plane: 1 white space, 2 a sign that may stand for a letter, 4 a letter or digit,
    8 a gap inside a word, 16 a gap between letters set apart. Characters beyond count as signs, so that none is missed."""
    out = np.zeros(0x10000, dtype=np.uint8)
    out[[*range(9, 14), 32]] = 1
    for bit, of in ((2, "0123456789@$!|+(<€£#*"), (8, "._-*~/'`^"), (16, " ._-*")):
        out[[ord(c) for c in of]] |= bit
    out[[i for i in range(0xFFFF) if not 0xD800 <= i < 0xE000 and chr(i).isalnum()]] |= 4
    out[0xFFFF] = 2
    return out


MARKS = _marks()


def suspects(low: str) -> tuple[set[str], list[str]]:
    """Tokens of a lower-cased text that DISGUISED may match, and its runs of letters set apart."""
    points = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    m = np.concatenate((MARKS[np.minimum(points, 0xFFFF)], np.ones(4, dtype=np.uint8)))
    n = len(points)
    black = (m & 1) == 0
    odd = (m[:n] & 2) > 0
    odd[: max(0, n - 2)] |= (points[2:] == points[1:-1]) & (points[1:-1] == points[:-2])
    letter, gap, apart = (m & 4) > 0, (m & 8) > 0, (m & 16) > 0
    odd |= letter[:n] & gap[1 : n + 1] & letter[2 : n + 2] & gap[3 : n + 3] & letter[4 : n + 4]
    at = np.flatnonzero(odd & black[:n])
    tokens: set[str] = set()
    if len(at):
        white = np.flatnonzero(~black[: n + 1])
        right = np.searchsorted(white, at)
        tokens = {low[(white[r - 1] + 1 if r else 0) : white[r]] for r in np.unique(right)}
    first = np.concatenate(([True], ~black[: n - 1])) if n else np.zeros(0, dtype=bool)
    runs, done = [], 0
    for k in np.flatnonzero(first & black[:n] & apart[1 : n + 1] & black[2 : n + 2] & apart[3 : n + 3] & black[4 : n + 4]).tolist():
        if k >= done and (hit := APART.match(low, k)):
            runs.append(hit[0])
            done = hit.end()
    return tokens, runs


class Reader:
    """Finds features of whole texts: of their plain words, and of disguised tokens, which are restored once and kept."""

    def __init__(self, model: list, lexicon: dict[str, float] | None = None):
        self.model, self.lexicon, self.kept = model, lexicon, {}
        self.heads = {f[: BEGINNINGS[0]] for f in lexicon or ()}

    def words(self, words) -> list:
        if self.lexicon is None:
            return beginnings(words)
        near = [w for w in words if w[: BEGINNINGS[0]] in self.heads]
        return [(w, best) for w in near if (best := max((self.lexicon.get(f, 0.0) for f in beginnings([w])), default=0.0)) > 0]

    def token(self, token: str) -> tuple:
        if (got := self.kept.get(token)) is None:
            got = tuple(self.words(words_of(token, self.model)))
            if len(token) <= LONGEST:
                if len(self.kept) >= CACHE:
                    self.kept.clear()
                self.kept[token] = got
        return got

    def text(self, text: str | None) -> set:
        if not text:
            return set()
        low = text.lower()
        out = set(self.words(set(LETTERS.findall(low))))
        tokens, runs = suspects(low)
        for t in tokens:
            out.update(self.token(t))
        for t in runs:
            out.update(self.token(re.sub(r"[ ._\-*]", "_", t)))
        return out


def values(found: set) -> list[float]:
    """What the logistic model sees of the lexicon's words in a text."""
    hits = [v for _, v in found]
    return [max(hits, default=0.0) / 5, math.log1p(sum(hits)), math.log1p(len(hits)), 1.0]


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[list, dict[str, float], np.ndarray]:
    """Language model, lexicon and logistic weights.

    The language model is counted over all of docs. The classifier learns from at most `sample` labelled documents (doc_id,
    toxic), those with the least hash of their id; a document with several labels counts as toxic if any says so. Half of
    them give the lexicon through which the other half's values are seen when the weights are fitted.
    """
    model = language_model(trigram_counts(docs))
    known = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    n = known.count()
    chance = min(1.0, 3 * sample / max(1, n))
    known = known.withColumn("order", F.xxhash64("doc_id")).filter(F.pmod("order", F.lit(1_000_000)) < chance * 1_000_000)
    known = known.orderBy("order").limit(sample)
    # at most `sample` rows of three numbers
    train = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("text", "toxic", F.pmod("order", F.lit(2)).alias("fold"))
    train = materialize(train.filter("text IS NOT NULL"), "toxic-training")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader, seen = Reader(model), {}
        for batch in batches:
            for text, toxic, fold in zip(batch["text"], batch["toxic"], batch["fold"], strict=True):
                own = seen.setdefault((int(toxic), int(fold)), Counter())
                own.update(reader.text(text))
                own["\n"] += 1
        rows = [(f, t, k, n) for (t, k), c in seen.items() for f, n in c.items()]
        yield pd.DataFrame(rows, columns=["feature", "toxic", "fold", "n"])

    counts = train.mapInPandas(count, "feature string, toxic long, fold long, n long").groupBy("feature").agg(
        *(F.sum(F.when((F.col("toxic") == t) & (F.col("fold") == k), F.col("n")).otherwise(0)).alias(f"n{t}{k}") for t in (0, 1) for k in (0, 1))
    )
    counts = materialize(counts, "toxic-counts")
    marks = counts.filter("feature = '\n'").collect()
    total = {(t, k): marks[0][f"n{t}{k}"] if marks else 0 for t in (0, 1) for k in (0, 1)}
    # only what has evidence enough in one of the lexicons leaves Spark
    found = []
    for folds in ((0,), (1,), (0, 1)):
        n1, n0 = (max(1, sum(total[(t, k)] for k in folds)) for t in (1, 0))
        a, b = (" + ".join(f"n{t}{k}" for k in folds) for t in (1, 0))
        both = f"({a} + {b})"
        g = f"2 * (({a}) * ln(({a}) / ({both} * {n1 / (n1 + n0)!r}D)) + if({b} > 0, ({b}) * ln(({b}) / ({both} * {n0 / (n1 + n0)!r}D)), 0D))"
        found.append(F.expr(f"if({a} >= {LEAST}, {g}, 0D)"))
    rows = counts.filter("feature <> '\n' AND n10 + n11 > (n00 + n01) / 8").withColumn("evidence", F.greatest(*found)).filter(F.col("evidence") >= EVIDENCE * 0.999).orderBy(F.desc("evidence"), "feature").collect()

    def lexicon(folds: tuple[int, ...]) -> dict[str, float]:
        n1, n0 = (max(1, sum(total[(t, k)] for k in folds)) for t in (1, 0))
        out = {}
        for r in rows:
            a, b = (sum(r[f"n{t}{k}"] for k in folds) for t in (1, 0))
            if a < LEAST:
                continue
            expected = (a + b) * n1 / (n1 + n0)
            other = (a + b) * n0 / (n1 + n0)
            g = 2 * (a * math.log(a / expected) + (b * math.log(b / other) if b else 0.0))
            odds = math.log((a + 0.5) / (n1 + 1)) - math.log((b + 0.5) / (n0 + 1))
            if odds > 1 and g >= EVIDENCE:
                out[r["feature"]] = odds
        return out

    halves = [lexicon((1,)), lexicon((0,))]

    def seen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        readers = [Reader(model, x) for x in halves]
        for batch in batches:
            x = [values(readers[int(k)].text(t)) for t, k in zip(batch["text"], batch["fold"], strict=True)]
            yield pd.DataFrame({"toxic": batch["toxic"].to_numpy(), "x": x})

    points = train.mapInPandas(seen, "toxic long, x array<double>").collect()
    return model, lexicon((0, 1)), logistic(np.array([list(p["x"]) for p in points]).reshape(-1, 4), np.array([p["toxic"] for p in points], dtype=float))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.02) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the bias is not shrunk. Without rows the score is 0.5 less what is found."""
    w = np.zeros(4)
    if not len(x):
        return np.array([1.0, 1.0, 1.0, -3.0])
    penalty = np.diag([ridge] * 3 + [1e-6]) * len(x) / 100
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + penalty + 1e-9 * np.eye(4), x.T @ (y - p) - penalty @ w)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return w


def score(docs: DataFrame, labels: DataFrame, train_filter=None, threshold: float = 0.3, sample: int = SAMPLE) -> DataFrame:
    """doc_id, score (0 to 1), predicted and found (the words that count) of every whole text.

    labels: doc_id, toxic. Null and empty texts get the score of a text in which nothing is found. Repeated rows give
    repeated rows; other columns are not carried. The lexicon is bounded by the sample that it is learned from.
    """
    model, lexicon, weights = learn(docs, labels if train_filter is None else labels.filter(train_filter), sample)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader(model, lexicon)
        for batch in batches:
            found = [reader.text(t) for t in batch["text"]]
            s = [1 / (1 + math.exp(-max(-30.0, min(30.0, float(np.dot(weights, values(f))))))) for f in found]
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "score": s, "found": [sorted({w for w, _ in f}) for f in found]})

    out = docs.select("doc_id", "text").mapInPandas(run, "doc_id long, score double, found array<string>")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def score_held_out(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted; labels of every fourth document by crc32 of its id teach nothing."""
    out = score(docs, labels, ~held(F.col("doc_id"), 4, 2))
    return out.select("doc_id", held(F.col("doc_id"), 4, 2).alias("held_out"), "score", "predicted")

