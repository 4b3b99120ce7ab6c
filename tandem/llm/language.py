"""Language identification: the family first, then one-versus-one linear support vector machines inside it.

Features are shares of hashed character n-grams of one to three letters of the lower-cased text, anything but letters
counting as one blank. The family is that of the naive Bayes model with the largest likelihood; within it every pair of
languages has a linear support vector machine, and the language with the most (then the strongest) votes wins.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import held, materialize, mix64, release

DIM = 4096
#: Families of closely related languages; a language that is missing is a family of its own.
FAMILIES = {
    "germanic": ["af", "da", "de", "en", "is", "nb", "nl", "nn", "no", "sv"],
    "romance": ["ca", "es", "fr", "gl", "it", "oc", "pt", "ro"],
    "slavic": ["be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"],
    "uralic": ["et", "fi", "hu"],
    "indic": ["bn", "gu", "hi", "mr", "ne", "pa", "ur"],
}
FAMILY_OF = {lang: family for family, langs in FAMILIES.items() for lang in langs}
#: Different labelled texts of each language that the models are fitted on.
SAMPLE = 500
UNKNOWN = "und"


def _letters() -> np.ndarray:
    """Code of each character of the basic plane: 0 for all that are no letters."""
    out = np.zeros(0x10000, dtype=np.uint64)
    for i in range(0x10000):
        if not 0xD800 <= i < 0xE000 and chr(i).isalpha():
            out[i] = ord(chr(i).lower()[0])
    return out


CODES = _letters()


def features(text: str) -> np.ndarray:
    """Counts of hashed n-grams of a whole text."""
    out = np.zeros(DIM, dtype=np.float64)
    tail = np.zeros(0, dtype=np.uint64)
    for at in range(0, len(text), 1 << 20):
        points = np.frombuffer(text[at : at + (1 << 20)].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        codes = CODES[np.minimum(points, len(CODES) - 1)]
        beyond = np.flatnonzero(points >= len(CODES))
        if len(beyond):
            high, where = np.unique(points[beyond], return_inverse=True)
            codes[beyond] = np.array([p if chr(p).isalpha() else 0 for p in high.tolist()], dtype=np.uint64)[where]
        codes = np.concatenate([tail, codes.astype(np.uint64)])
        codes = codes[np.concatenate(([True], (codes[1:] != 0) | (codes[:-1] != 0)))]  # one blank at a time
        fresh = len(tail)
        with np.errstate(over="ignore"):
            for n in (1, 2, 3):
                if len(codes) < n:
                    continue
                key = codes[: len(codes) - n + 1]
                for k in range(1, n):
                    key = key * np.uint64(0x110000) + codes[k : len(codes) - n + 1 + k]
                key = key[max(0, fresh - n + 1) :]
                key = key[key != 0]
                out += np.bincount((mix64(key * np.uint64(4) + np.uint64(n)) % np.uint64(DIM)).astype(np.int64), minlength=DIM)
        tail = codes[-2:]
    return out


def fit_pair(x: np.ndarray, y: np.ndarray, cost: float = 10.0, rounds: int = 200) -> np.ndarray:
    """Weights and bias of a linear support vector machine with squared hinge loss; y is -1 or 1. Both classes weigh alike."""
    x = np.hstack([x, np.ones((len(x), 1))]).astype(np.float32)
    y = y.astype(np.float32)
    weight = np.where(y > 0, 1 / max(1, (y > 0).sum()), 1 / max(1, (y < 0).sum())).astype(np.float32)
    w = last = np.zeros(x.shape[1], dtype=np.float32)
    momentum = 1.0
    step = 1 / (1e-2 + 2 * cost * float(np.sum(weight * np.einsum("ij,ij->i", x, x))))
    for _ in range(rounds):  # accelerated gradient descent
        slack = np.maximum(0, 1 - y * (x @ last))
        fresh = last - np.float32(step) * (np.float32(1e-2) * last - np.float32(2 * cost) * (x.T @ (weight * y * slack)))
        grown = (1 + (1 + 4 * momentum**2) ** 0.5) / 2
        last, w, momentum = fresh + np.float32((momentum - 1) / grown) * (fresh - w), fresh, grown
    return w.astype(np.float64)


def _scale(counts: np.ndarray) -> np.ndarray:
    x = np.sqrt(counts)
    return x / np.maximum(1e-9, np.linalg.norm(x, axis=-1, keepdims=True))


def training_sample(docs: DataFrame, sample: int = SAMPLE) -> tuple[list[str], DataFrame]:
    """The languages, and lang and text of at most `sample` different texts of each: those with the least hash.

    Copies count once: shares and ranks are of the different texts. Null texts and languages and texts without a letter
    teach nothing.
    """
    usable = docs.filter("text IS NOT NULL AND lang IS NOT NULL").filter(F.col("text").rlike(r"\p{L}")).select("lang", "text", F.xxhash64("text").alias("order"))
    keys = materialize(usable.select("lang", "order").distinct(), "language-keys")
    counts = keys.groupBy("lang").agg(F.count(F.lit(1)).alias("texts"))
    langs = sorted(r["lang"] for r in counts.select("lang").collect())  # the model has an entry for each of them anyway
    if not langs:
        return [], usable.select("lang", "text")
    # a first, coarse choice by the hash keeps the exact one small
    keys = keys.join(F.broadcast(counts), "lang").filter(F.pmod("order", F.lit(1_000_000)) < F.lit(3_000_000.0 * sample) / F.col("texts")).drop("texts")
    w = Window.partitionBy("lang").orderBy("order")
    keys = keys.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= sample).drop("rank")
    return langs, usable.join(F.broadcast(keys), ["lang", "order"]).groupBy("lang", "order").agg(F.min("text").alias("text")).select("lang", "text")


def fit(docs: DataFrame, sample: int = SAMPLE) -> dict:
    """The models, from text and lang of the given documents: naive Bayes of the families, and a machine per pair.

    They learn from `training_sample`; its features stay in the tasks that fit a pair, and only sums and weights come to the
    driver.
    """
    langs, usable = training_sample(docs, sample)
    if not langs:
        return {"langs": [], "families": {}, "pairs": {}}
    family = {k: FAMILY_OF.get(k, f"own:{k}") for k in langs}

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"lang": batch["lang"], "x": [features(t).astype(np.float32).tobytes() for t in batch["text"]]})

    rows = usable.mapInPandas(vectors, "lang string, x binary")
    rows = materialize(rows, "language-features")

    def total(part: pd.DataFrame) -> pd.DataFrame:
        x = np.zeros(DIM)
        for b in part["x"]:
            x += np.frombuffer(b, dtype=np.float32)
        return pd.DataFrame({"lang": [part["lang"].iloc[0]], "x": [x.tobytes()]})

    sums = {r["lang"]: np.frombuffer(r["x"]) for r in rows.groupBy("lang").applyInPandas(total, "lang string, x binary").collect()}
    families = {}
    for f in sorted(set(family.values())):
        own = [sums[k] / max(1.0, sums[k].sum()) for k in langs if family[k] == f and k in sums]
        if own:
            families[f] = np.log(np.mean(own, axis=0) + 1e-6)
    pairs = [(a, b) for i, a in enumerate(langs) for b in langs[i + 1 :] if family[a] == family[b] and a in sums and b in sums]
    fitted = {}
    if pairs:
        table = docs.sparkSession.createDataFrame([(f"{a} {b}", x) for a, b in pairs for x in (a, b)], "pair string, lang string")

        def machine(part: pd.DataFrame) -> pd.DataFrame:
            pair = part["pair"].iloc[0]
            part = part.iloc[np.argsort([zlib.crc32(b) for b in part["x"]], kind="stable")]
            x = _scale(np.array([np.frombuffer(b, dtype=np.float32) for b in part["x"]]))
            y = np.where(part["lang"].to_numpy() == pair.split(" ")[1], 1.0, -1.0)
            w = fit_pair(x, y).tobytes()
            del x
            release()
            return pd.DataFrame({"pair": [pair], "w": [w]})

        for r in rows.join(F.broadcast(table), "lang").groupBy("pair").applyInPandas(machine, "pair string, w binary").collect():
            fitted[tuple(r["pair"].split(" "))] = np.frombuffer(r["w"])
    return {"langs": [k for k in langs if k in sums], "families": families, "pairs": fitted, "of": family}


def guess(model: dict, text: str | None) -> tuple[str, float]:
    """Language and score (0 to 1) of a whole text; `und` and 0 for texts without a letter and where nothing was learned."""
    if not text or not model["langs"] or not any(map(str.isalpha, text)):
        return UNKNOWN, 0.0
    counts = features(text)
    if not counts.sum():
        return UNKNOWN, 0.0
    names = list(model["families"])
    mean = np.array([counts @ model["families"][f] for f in names]) / counts.sum()
    chance = np.exp((mean - mean.max()) * min(counts.sum(), 60))
    best = int(np.argmax(mean))
    score = float(chance[best] / chance.sum())
    langs = [k for k in model["langs"] if model["of"][k] == names[best]]
    if len(langs) == 1:
        return langs[0], score
    x = np.append(_scale(counts), 1.0)
    votes = dict.fromkeys(langs, 0)
    margin = dict.fromkeys(langs, 0.0)
    for (a, b), w in model["pairs"].items():
        if a in votes and b in votes:
            m = float(x @ w)
            votes[b if m > 0 else a] += 1
            margin[a] -= m
            margin[b] += m
    lang = max(langs, key=lambda k: (votes[k], margin[k], k))
    rest = min((m if b == lang else -m) for (a, b), m in ((p, float(x @ w)) for p, w in model["pairs"].items() if lang in p and p[0] in votes and p[1] in votes))
    return lang, score / (1 + float(np.exp(-4 * rest)))


def guesses(model: dict):
    """A column function: struct of lang_pred and score from a text column."""

    @F.arrow_udf("lang_pred string, score double")
    def run(text: pa.Array) -> pa.Array:
        found = [guess(model, t.as_py()) for t in text]  # one text at a time is a string of its own
        release()
        return pa.StructArray.from_arrays([pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["lang_pred", "score"])

    return run


def guessed(docs: DataFrame, train: DataFrame | None = None, sample: int = SAMPLE) -> DataFrame:
    """d, the row with all its columns whatever their names, and guess (lang_pred, score) of its whole text.

    `train` (text, lang) defaults to docs. Null and empty texts and texts without a letter are `und` with score 0. The model
    sent to the tasks has an array of DIM numbers per family and per pair of related languages.
    """
    found = guesses(fit(docs if train is None else train, sample))
    return docs.select(F.struct(*docs.columns).alias("d"), found(docs["text"]).alias("guess"))


def label(docs: DataFrame, train: DataFrame | None = None, sample: int = SAMPLE) -> DataFrame:
    """The documents with lang_pred and score of every whole text. Columns of these names are replaced, all others kept."""
    kept = [F.col("d").getField(c).alias(c) for c in docs.columns if c not in ("lang_pred", "score")]
    return guessed(docs, train, sample).select(*kept, "guess.lang_pred", "guess.score")


def identify_held_out(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score; every fifth document by crc32 of its id teaches nothing."""
    rest = held(F.col("doc_id"), 5, 0)
    out = label(docs.select("doc_id", "text"), docs.filter(~rest).select("text", "lang"))
    return out.select("doc_id", rest.alias("held_out"), "lang_pred", "score")
