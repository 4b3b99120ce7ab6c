"""Quality classifier by importance resampling.

Two generative models of hashed word unigrams and bigrams, one of the target text and one of all raw text, give every
document a log importance weight; rows are drawn without replacement in proportion to the weights by Gumbel top-k.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, materialize, mix64, word_hashes

BUCKETS = 10_000
#: Share of the rows that the draw keeps, and the pseudo-count of every bucket.
SHARE, PRIOR = 0.85, 1.0
#: Labelled documents that the target's model is counted on, at most.
SAMPLE = 50_000
#: Values that are sorted on the driver at the end of the search for the k-th largest.
FEW = 5_000


def _grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the unigrams and bigrams of all texts, and the text of each."""
    words, offset = word_hashes(texts)
    of = np.repeat(np.arange(len(texts)), np.diff(offset))
    same = of[1:] == of[:-1]
    with np.errstate(over="ignore"):
        pairs = mix64(words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:])[same]
    return np.concatenate([words % np.uint64(BUCKETS), pairs % np.uint64(BUCKETS)]).astype(np.int64), np.concatenate([of, of[1:][same]])


def gram_counts(docs: DataFrame) -> np.ndarray:
    """Counts of all buckets over whole texts; every task sends one array of them."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            texts = list(batch["text"])
            for at, end in chunks(texts):
                total += np.bincount(_grams(texts[at:end])[0], minlength=BUCKETS)
        yield pd.DataFrame({"bucket": np.arange(BUCKETS), "n": total})

    rows = docs.select("text").mapInPandas(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(BUCKETS, dtype=np.int64)
    for r in rows:
        out[r["bucket"]] = r["n"]
    return out


def log_weights(docs: DataFrame, target: DataFrame) -> DataFrame:
    """doc_id, n_grams and log_weight: the log ratio of the target's and the raw text's probability of the whole text.

    Both models are counted over all their rows. Texts without words weigh 0, null texts too.
    """
    share = lambda n: np.log((n + PRIOR) / (n.sum() + PRIOR * BUCKETS))
    ratio = share(gram_counts(target)) - share(gram_counts(docs))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at, end in chunks(list(batch["text"])):
                part = batch[at:end]
                buckets, of = _grams(list(part["text"]))
                yield pd.DataFrame({
                    "doc_id": part["doc_id"].astype("Int64").to_numpy(), "salt": part["salt"].to_numpy(),
                    "n_grams": np.bincount(of, minlength=len(part)), "log_weight": np.bincount(of, weights=ratio[buckets], minlength=len(part)),
                })

    return docs.select("doc_id", F.xxhash64("doc_id", "text").alias("salt"), "text").mapInPandas(score, "doc_id long, salt long, n_grams long, log_weight double")


def gumbel(salt: Column, seed: int) -> Column:
    """Gumbel noise that a row gets again in every run; equal rows get equal noise."""
    u = (F.pmod(F.xxhash64(salt, F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return -F.log(-F.log(u))


def kth_largest(df: DataFrame, column: str, k: int) -> float | None:
    """The k-th largest value, exactly: counts by bin narrow the interval until few values are left in it."""
    low, high, n = df.agg(F.min(column), F.max(column), F.count(column)).first()
    if not n or k <= 0:
        return None
    if k >= n:
        return low
    above = 0
    while True:
        inside = df.filter((F.col(column) >= low) & (F.col(column) <= high))
        if n <= FEW or low == high:
            values = sorted((r[0] for r in inside.select(column).limit(FEW).collect()), reverse=True) if low != high else [low]
            return values[min(k - above, len(values)) - 1]
        step = (high - low) / 4096
        at = F.least(F.floor((F.col(column) - low) / step), F.lit(4095)) if step else F.lit(0)
        bins = inside.groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min(column).alias("low"), F.max(column).alias("high")).orderBy(F.desc("bin")).collect()
        for b in bins:
            if above + b["n"] >= k:
                low, high, n = b["low"], b["high"], b["n"]
                break
            above += b["n"]


def good_documents(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Documents labelled quality = 1, those with the least hash of their id, at most `sample` of them (whose ids are
    broadcast, so that no text is shuffled)."""
    ids = labels.filter("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct()
    n = ids.count()
    ids = ids.withColumn("order", F.xxhash64("doc_id")).filter(F.pmod("order", F.lit(1_000_000)) < min(1.0, 3 * sample / max(1, n)) * 1_000_000)
    return docs.join(F.broadcast(ids.orderBy("order").limit(sample).select("doc_id")), "doc_id", "left_semi")


def resample(docs: DataFrame, target: DataFrame, share: float = SHARE, temperature: float = 1.0, seed: int = 29) -> DataFrame:
    """doc_id, n_grams, log_weight, priority and kept of every document.

    A row's priority is its log weight by temperature plus Gumbel noise; kept are the k = ceil(share * rows) rows of the
    largest priorities. Rows that tie with the k-th stay too, so repeated rows share one fate. An empty table gives an
    empty result. `target` has a column text; with no target text every weight is near 0 and the draw is uniform.
    """
    scored = log_weights(docs, target).withColumn("priority", F.col("log_weight") / temperature + gumbel(F.col("salt"), seed)).drop("salt")
    scored = materialize(scored, "importance")
    k = -(-scored.count() * int(share * 1000) // 1000)
    least = kth_largest(scored, "priority", k)
    return scored.withColumn("kept", F.col("priority") >= F.lit(least) if least is not None else F.lit(False))
