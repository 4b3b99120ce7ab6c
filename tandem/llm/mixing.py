"""Mixing sources to target weights.

The words of a source, document after document, are a stream that is cut into blocks of fixed length. Every output shard
draws how many of its slots each source gets from a multinomial distribution over the targets. The slots of a source are
numbered through all shards; a pseudorandom permutation of the source's block numbers, a new one each time all have been
used, says which block a slot holds. Blocks and documents meet in a join by source and block number; texts take no part in
that: they meet the spans that are taken of them once, at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, mix64, n_words

#: Parts that the stream of a source goes through.
PARTS = 1024
#: Groups of sources among which a shard's slots are drawn first, then within each: 10 million sources are 40 000 a group.
GROUPS = 256
SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def _key() -> Column:
    """A source's key; null has one, too."""
    return F.expr("coalesce(concat('s', source), 'n') AS key")


def targets(sizes: DataFrame, weights: Column, most: float = 3.0) -> DataFrame:
    """source, size, target: sizes' total is shared by weight, no source above `most` times its size.

    Sources at their limit are closed in the order of limit to weight; what they leave goes to the others by weight. With
    no words at all every target is 0.
    """
    w = Window.orderBy("fill", F.asc_nulls_last("source"))
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    all_rows = Window.partitionBy()
    return (
        sizes.withColumn("weight", weights.cast("double"))
        .withColumn("cap", F.col("size") * most)
        .withColumn("fill", F.col("cap") / F.col("weight"))
        .withColumn("closed", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("closed_w", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", (F.sum("size").over(all_rows) - F.col("closed")) / (F.sum("weight").over(all_rows) - F.col("closed_w")))
        .withColumn("level", F.max(F.when(F.col("level") <= F.col("fill"), F.col("level"))).over(all_rows))
        .select("source", "size", F.least("cap", F.col("level") * F.col("weight")).alias("target"))
    )


def rank_weights() -> Column:
    """1, 2, 3, repeating, over the sources by code point, null last."""
    return (F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1) % 3 + 1


def permuted(index: np.ndarray, size: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """A pseudorandom permutation of 0..size-1, by seed: a four-round Feistel network, walked until it is inside."""
    half = np.maximum(1, np.ceil(np.log2(np.maximum(size, 2)) / 2)).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    x, size, seed = index.astype(np.uint64), size.astype(np.uint64), seed.astype(np.uint64)
    todo = np.ones(len(x), dtype=bool)
    with np.errstate(over="ignore"):
        while todo.any():
            left, right = x[todo] >> half[todo], x[todo] & mask[todo]
            for r in range(4):
                left, right = right, left ^ (mix64(right + seed[todo] + np.uint64(r) * np.uint64(0x9E3779B97F4A7C15)) & mask[todo])
            x[todo] = (left << half[todo]) | right
            todo = x >= size
    return x.astype(np.int64)


def placed(docs: DataFrame, carry: tuple[str, ...] = (), parts: int = PARTS) -> tuple[DataFrame, DataFrame]:
    """Documents with their source's key and the place of their first word in the source's stream; and the sources' sizes.

    The stream goes through the parts of a source, in a part by id. Parts hash ids and texts, so that a source with a
    third of all rows is dealt over all of them; which words meet in a block depends on their number, `parts`. Texts are
    read once and not moved: row (a hash of id and text) leads back to them.
    """
    row = F.xxhash64("doc_id", "text")
    rows = docs.select("doc_id", "source", _key(), n_words(F.col("text")).alias("size"), row.alias("row"), F.pmod(row, F.lit(parts)).cast("int").alias("part"), *carry)
    rows = materialize(rows, "mix-rows")
    sums = rows.groupBy("key", "part").agg(F.sum("size").alias("words"), F.first("source", ignorenulls=True).alias("source"))
    sums = materialize(sums, "mix-parts")
    w = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("base", F.coalesce(F.sum("words").over(w), F.lit(0))).select("key", "part", "base")
    own = Window.partitionBy("key", "part").orderBy("doc_id", "size", "row")
    before = own.rowsBetween(Window.unboundedPreceding, -1)
    out = (
        rows.join(starts.hint("shuffle_merge"), ["key", "part"])
        .withColumn("start", F.col("base") + F.coalesce(F.sum("size").over(before), F.lit(0)))
        .withColumn("seq", F.row_number().over(own))
        .drop("base")
    )
    return out, sums.groupBy("key").agg(F.first("source", ignorenulls=True).alias("source"), F.sum("words").alias("size"))


def slots(plan: DataFrame, block: int, shard_slots: int, seed: int) -> DataFrame:
    """key, shard, block, copy and words: the slots of all shards. plan: key, size, target.

    A source takes round(target) words in full rounds over its blocks, then a part of a round over its whole blocks, the
    last one cut; its short last block comes into a part round only when all others are used. What a shard draws beyond a
    source's number of slots stays empty; what the draws leave over fills further shards, one after the other.
    """
    spark = plan.sparkSession
    size, quota = F.col("size"), F.least(F.round("target").cast("long"), F.floor(F.col("size") * 3))
    plan = plan.select(
        "key", "size", "target", quota.alias("quota"), F.ceil(size / block).cast("long").alias("n"), F.floor(size / block).cast("long").alias("whole"),
        F.when(size > 0, F.floor(quota / size)).otherwise(0).cast("long").alias("rounds"),
    ).withColumn("rest", F.col("quota") - F.col("rounds") * F.col("size"))
    plan = plan.withColumn("part", F.least(F.ceil(F.col("rest") / block).cast("long"), F.col("whole"))).withColumn("tail", F.greatest(F.col("rest") - F.col("whole") * block, F.lit(0)))
    plan = plan.withColumn("total", F.col("rounds") * F.col("n") + F.col("part") + (F.col("tail") > 0).cast("long")).filter("total > 0")
    group = F.pmod(F.xxhash64("key"), F.lit(GROUPS)).cast("int").alias("group")
    members = plan.groupBy(group).agg(F.sum("total").alias("total"), F.sort_array(F.collect_list(F.struct("key", "total"))).alias("members"))
    members = materialize(members, "mix-groups")
    totals = dict(members.select("group", "total").collect())  # GROUPS rows at most
    share = np.array([totals.get(g, 0) for g in range(GROUPS)], dtype=float)
    n_slots = int(share.sum())
    shards = -(-n_slots // shard_slots)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shard in batch["id"]:
                n = min(shard_slots, n_slots - shard * shard_slots)
                counts = np.random.default_rng([seed, shard]).multinomial(n, share / share.sum())
                hit = np.flatnonzero(counts)
                yield pd.DataFrame({"shard": shard, "group": hit, "n_group": counts[hit]})

    def within(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shard, g, n, own in zip(batch["shard"], batch["group"], batch["n_group"], batch["members"], strict=True):
                part = np.array([m["total"] for m in own], dtype=float)
                counts = np.random.default_rng([seed, shard, g]).multinomial(n, part / part.sum())
                hit = np.flatnonzero(counts)
                yield pd.DataFrame({"shard": shard, "key": [own[i]["key"] for i in hit], "n_drawn": counts[hit]})

    drawn = spark.range(shards).mapInPandas(draw, "shard long, group int, n_group long").join(members.select("group", "members"), "group")
    drawn = drawn.mapInPandas(within, "shard long, key string, n_drawn long")
    upto = Window.partitionBy("key").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    drawn = drawn.withColumn("upto", F.sum("n_drawn").over(upto)).withColumn("from", F.col("upto") - F.col("n_drawn"))
    got = drawn.groupBy("key").agg(F.max("upto").alias("got"))
    left = plan.join(got, "key", "left").select("key", F.coalesce("got", F.lit(0)).alias("from"), F.col("total").alias("upto")).filter("from < upto")
    gap = F.sum(F.col("upto") - F.col("from")).over(Window.orderBy("key").rowsBetween(Window.unboundedPreceding, -1))  # a row per source
    left = left.select("key", F.lit(None).cast("long").alias("shard"), "from", "upto", F.coalesce(gap, F.lit(0)).alias("gap"))
    given = drawn.join(plan.select("key", "total"), "key").select("key", "shard", "from", F.least("upto", "total").alias("upto"), F.lit(0).cast("long").alias("gap")).filter("from < upto")
    given = given.unionByName(left).withColumn("slot", F.explode(F.expr("sequence(`from`, upto - 1)"))).join(plan, "key")
    given = given.withColumn("shard", F.coalesce("shard", F.lit(shards) + F.floor((F.col("gap") + F.col("slot") - F.col("from")) / shard_slots)))
    # the short last round: slots of whole blocks, the last one cut, then the front of the short block
    late = F.col("slot") - F.col("rounds") * F.col("n")
    given = given.withColumn("late", late).withColumn("copy", F.floor(F.col("slot") / F.col("n")))

    @F.pandas_udf("long")
    def place(key: pd.Series, slot: pd.Series, n: pd.Series, rounds: pd.Series, late: pd.Series, whole: pd.Series) -> pd.Series:
        key, slot, n, rounds, late, whole = (c.to_numpy() for c in (key, slot, n, rounds, late, whole))
        early = late < 0
        within = np.where(early, slot % n, np.minimum(late, np.maximum(whole - 1, 0)))
        with np.errstate(over="ignore"):
            seeds = mix64(key.astype(np.uint64) + np.uint64(seed) + np.where(early, slot // n, rounds).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        out = permuted(within, np.where(early, n, np.maximum(whole, 1)), seeds)
        return pd.Series(np.where(~early & (late >= whole), n - 1, out))

    words = F.when(F.col("late") < 0, F.lit(block)).when(F.col("late") >= F.col("part"), F.col("tail")).when((F.col("late") == F.col("part") - 1) & (F.col("tail") == 0), F.col("rest") - (F.col("part") - 1) * block).otherwise(F.lit(block))
    return given.select("key", "shard", "slot", place(F.xxhash64("key"), "slot", "n", "rounds", "late", "whole").alias("block"), "late", "part", "tail", "rest").select("key", "shard", "slot", "block", words.cast("long").alias("words"))


def spans(docs: DataFrame, weights: Column | None, block: int, shard_slots: int, seed: int, carry: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """The spans of `mix` without targets, and the plan: key, size and target."""
    rows, sizes = placed(docs, carry)
    plan = materialize(targets(sizes, rank_weights() if weights is None else weights).select(_key(), "size", "target"), "mix-plan")
    chosen = slots(plan, block, shard_slots, seed)
    empty = rows.filter("size = 0")
    blocks = F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))
    pieces = rows.filter("size > 0").withColumn("block", F.explode(blocks)).join(chosen, ["key", "block"], "left")
    low = F.greatest("start", F.col("block") * block)
    n = F.least(F.col("start") + F.col("size"), F.col("block") * block + F.coalesce("words", F.lit(0))) - low
    pieces = pieces.withColumn("first", low - F.col("start")).withColumn("taken", F.greatest(n, F.lit(0))).drop("words")
    return pieces.unionByName(empty.withColumn("first", F.lit(0).cast("long")).withColumn("taken", F.lit(0).cast("long")), allowMissingColumns=True), plan


def mix(docs: DataFrame, weights: Column | None = None, block: int = 512, shard_slots: int = 4096, seed: int = 17, carry: tuple[str, ...] = ()) -> DataFrame:
    """The mix as spans of documents, one row per slot and document in its block; and the documents that give none.

    doc_id, source, size (words of the document), source_size, target, row, key, part and seq (which row of docs it is),
    shard, slot, block, first and taken: `taken` words from word number `first` (0-based) of the document. Documents of
    which nothing is taken, null and empty texts among them, have one row with taken 0 and null shard. A null source is a
    source of its own, repeated rows are documents of their own, other columns are not carried unless named in `carry`.
    Of a source's target the mix takes exactly round(target) words, each word three times at most.
    """
    out, plan = spans(docs, weights, block, shard_slots, seed, carry)
    return out.join(plan.select("key", F.col("size").alias("source_size"), "target"), "key")


def taken_by_document(spans: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken of every document."""
    return (
        spans.groupBy("key", "part", "seq")
        .agg(*(F.first(c).alias(c) for c in ("doc_id", "size", "source_size", "target")), F.sum("taken").alias("taken"))
        .drop("key", "part", "seq")
    )


def mixed_documents(docs: DataFrame, weights: Column | None = None, block: int = 512, shard_slots: int = 4096, seed: int = 17) -> DataFrame:
    """The mix in the columns of documents: a row per span of a document in a slot, with the span's text.

    Texts are shuffled once, to the spans that are taken of them; a text's spans are as many as its blocks, three times at
    most. Rows with the same id and text have their spans each.
    """
    out, _ = spans(docs, weights, block, shard_slots, seed, ("lang",))
    taken = out.filter("taken > 0").groupBy("key", "part", "seq", "row", "doc_id", "lang", "source").agg(F.sort_array(F.collect_list(F.struct("slot", "first", "taken"))).alias("cuts"))
    texts = docs.filter("text IS NOT NULL").select(F.xxhash64("doc_id", "text").alias("row"), "text").repartition("row").dropDuplicates(["row"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts, times = [], []
                for text, cuts in zip(part.column("text"), part.column("cuts"), strict=True):
                    raw = text.as_py().encode("utf-8", "surrogatepass")
                    gap = SPACE[np.frombuffer(raw, dtype=np.uint8)]
                    starts = np.append(np.flatnonzero(~gap & np.concatenate(([True], gap[:-1]))), len(raw))
                    own = [raw[starts[c["first"]] : starts[c["first"] + c["taken"]]].decode("utf-8", "surrogatepass") for c in cuts.as_py()]
                    texts += own
                    times.append(len(own))
                again = pa.array(np.repeat(np.arange(part.num_rows), times))
                others = [part.column(c).take(again) for c in ("doc_id", "lang", "source")]
                yield pa.RecordBatch.from_arrays(
                    [others[0], pa.array(texts, pa.string()), *others[1:], pa.array([len(x) for x in texts], pa.int64())], ["doc_id", "text", "lang", "source", "n_chars"]
                )

    rows = taken.join(texts, "row").select("doc_id", "lang", "source", "text", "cuts")
    return rows.mapInArrow(cut, "doc_id long, text string, lang string, source string, n_chars long")
