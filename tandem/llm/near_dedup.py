"""Near-duplicate documents by SetSketch registers.

A document's set is its distinct word shingles. Register i keeps the least of all elements' i-th hashes as a truncated
exponent on a fine exponential scale; registers of a union are the larger ones of both. Equal sets become one node. Nodes
that agree on all registers of a band meet in a bucket. In a bucket each is paired with two leaders only: the node that has
most company in its buckets (an original has more than its copies), and any other. Pairs whose similarity, estimated from
all registers by maximum likelihood, may reach the threshold are verified on their full sets, and links make components.

Nodes of larger buckets that then still hold several components are compared exactly, without pairing all of a bucket: two
sets that are similar enough share one of their rarest elements, as many of them as they may differ in. Each node is keyed
by these, with its own and the partner's class of sizes, and only nodes of different components meet, those of a key's
largest component with the others alone. Copies with edits of their own share no such element unless they are similar, so
a large group of copies never gives all its pairs.

A pair of similarity 0.8 is lost only where it shares no bucket (a chance of 5e-8), or where its estimate is off by more
than SLACK (over five standard deviations); all else is exact, but for 64-bit hashes standing for shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, discard, materialize, mix64, word_hashes

WORDS, SIMILARITY = 5, 0.8
#: Bands and registers in each: a pair at the threshold of 0.8 shares no bucket with a chance of 5e-8.
BANDS, ROWS = 32, 4
#: The exponential scale's base and rate.
BASE, RATE = 1.001, 20.0
#: Pairs whose estimate is lower by this than the threshold (over five standard deviations) are not verified.
SLACK = 0.2
_M = BANDS * ROWS
_XOR = mix64(np.arange(1, _M + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_MUL = mix64(np.arange(1001, 1001 + _M, dtype=np.uint64)) | np.uint64(1)
#: Leaders of a bucket: of one with a node more at most, all pairs have been tried.
LEADERS = 2
#: Least sizes of the classes of sizes, each a twelfth above the last.
SIZES = np.unique(np.ceil(1.08 ** np.arange(0, 400)).astype(np.int64))


def shingle_sets(texts: list[str | None], words: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every text (A-Z lower-cased); with fewer words the whole sequence is one."""
    hashes, offset = word_hashes(texts)
    out = []
    with np.errstate(over="ignore"):
        power = np.uint64(0x9E3779B97F4A7C15)
        rolled = np.zeros(max(0, len(hashes) - words + 1), dtype=np.uint64)
        for k in range(words):
            rolled = rolled * power + hashes[k : len(hashes) - words + 1 + k] if len(rolled) else rolled
        rolled = mix64(rolled)
        for a, b in zip(offset[:-1], offset[1:], strict=True):
            n = b - a
            if n >= words:
                out.append(np.unique(rolled[a : b - words + 1]))
            elif n:
                one = np.uint64(n)
                for h in hashes[a:b]:
                    one = one * power + h
                out.append(mix64(np.array([one], dtype=np.uint64)))
            else:
                out.append(np.zeros(0, dtype=np.uint64))
    return out


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """Registers of non-empty sets, one row per set."""
    joined = np.concatenate(sets)
    at = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1]))
    least = np.empty((len(sets), _M), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(_M):
            least[:, i] = np.minimum.reduceat((joined ^ _XOR[i]) * _MUL[i], at)
    exponential = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64) / RATE
    return np.clip(np.floor(1 - np.log(exponential) / np.log(BASE)), 0, 65535).astype(np.uint16)


def node_of(s: np.ndarray) -> int:
    """64 bits that stand for a set; two sets among n share them with a chance of n^2 / 2^65."""
    with np.errstate(over="ignore"):
        x = mix64(s * np.uint64(0xA24BAED4963EE407) + np.arange(len(s), dtype=np.uint64))
        return int(mix64(np.array([x.sum(dtype=np.uint64) + np.uint64(len(s))], dtype=np.uint64)).view(np.int64)[0])


def rows_of(docs: DataFrame) -> DataFrame:
    """doc_id, row (a hash of id and text) and text."""
    return docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), "text")


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, row (a hash of id and text), n_shingles, node, registers and bands of every document; node is null without words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        power = mix64(np.arange(1, _M + 1, dtype=np.uint64) + np.uint64(1 << 40)) | np.uint64(1)
        for batch in batches:
            for at, end in chunks(list(batch["text"])):
                part = batch[at:end]
                sets = shingle_sets(list(part["text"]), words)
                full = [k for k, s in enumerate(sets) if len(s)]
                node = np.zeros(len(sets), dtype=object)
                node[:] = None
                regs, bands = [None] * len(sets), [None] * len(sets)
                if full:
                    made = registers([sets[k] for k in full])
                    with np.errstate(over="ignore"):
                        mixed = mix64((made.astype(np.uint64) + np.uint64(1)) * power).reshape(len(full), BANDS, ROWS).sum(axis=2, dtype=np.uint64)
                        mixed = mix64(mixed + np.arange(BANDS, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)).view(np.int64)
                    for row, k in enumerate(full):
                        node[k], regs[k], bands[k] = node_of(sets[k]), made[row].tobytes(), mixed[row]
                yield pd.DataFrame({
                    "doc_id": part["doc_id"].astype("Int64").to_numpy(), "row": part["row"].to_numpy(), "n_shingles": [len(s) for s in sets],
                    "node": pd.array(list(node), dtype="Int64"), "registers": regs, "bands": bands,
                })

    return rows_of(docs).mapInPandas(run, "doc_id long, row long, n_shingles long, node long, registers binary, bands array<long>")


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Maximum-likelihood similarity of pairs of sets of known sizes, from how many registers are larger, smaller, equal."""
    up, down = (a > b).sum(axis=1)[:, None], (a < b).sum(axis=1)[:, None]
    same = _M - up - down
    total = (n_a + n_b).astype(np.float64)
    u, v = (n_a / total)[:, None], (n_b / total)[:, None]
    most = np.minimum(u / v, v / u)
    j = most * np.linspace(0, 1, 257)[None, :]
    chance = lambda x: -np.log1p(-np.clip(x, 1e-12, 1) * (BASE - 1) / BASE) / np.log(BASE)
    p, q = chance(u - v * j), chance(v - u * j)
    like = up * np.log(p) + down * np.log(q) + same * np.log(np.maximum(1e-12, 1 - p - q))
    return np.take_along_axis(j, like.argmax(axis=1)[:, None], axis=1)[:, 0]


def element_sets(docs: DataFrame, people: DataFrame, words: int) -> DataFrame:
    """node and elements (its sorted 64-bit shingle hashes) of each of people (node, row); the one time that texts move."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at, end in chunks(list(batch["text"])):
                part = batch[at:end]
                made = shingle_sets(list(part["text"]), words)
                yield pd.DataFrame({"node": part["node"].to_numpy(), "elements": [x.tobytes() for x in made]})

    texts = rows_of(docs).filter("text IS NOT NULL").select("row", "text")
    # the slim side is hashed, so that texts are not sorted; rows that are repeated give equal sets
    found = texts.join(people.select("row", "node").hint("shuffle_hash"), "row").select("node", "text")
    return found.mapInPandas(run, "node long, elements binary").groupBy("node").agg(F.max("elements").alias("elements"))


def verify(pairs: DataFrame, people: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of nodes whose full sets are similar enough. people: node, n, registers; sets: node, elements."""
    side = lambda x: people.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("registers").alias(f"r_{x}"))
    thousandths = round(1000 * similarity)
    close = F.least("n_a", "n_b") * 1000 >= F.greatest("n_a", "n_b") * thousandths
    sized = pairs.join(side("a"), "a").join(side("b"), "b").filter(close)

    def likely(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 2000):
                part = batch[at : at + 2000]
                r = [np.frombuffer(b"".join(part[c]), dtype=np.uint16).reshape(-1, _M) for c in ("r_a", "r_b")]
                keep = estimate(*r, part["n_a"].to_numpy(), part["n_b"].to_numpy()) >= similarity - SLACK
                yield part.loc[keep, ["a", "b"]]

    likely_pairs = materialize(sized.mapInPandas(likely, "a long, b long"), "near-pairs")

    def similar(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = []
            for x, y in zip(batch["x"], batch["y"], strict=True):
                x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(1000 * both >= thousandths * (len(x) + len(y) - both))
            yield batch.loc[keep, ["a", "b"]]

    full = likely_pairs.join(sets.select(F.col("node").alias("a"), F.col("elements").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("elements").alias("y")), "b")
    return full.mapInPandas(similar, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """node and root of every linked node: labels sink along links and are shortened by jumps until none changes."""
    both = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    links = materialize(links.select(F.explode(both).alias("e")).select("e.*").distinct(), "links")
    labels = materialize(links.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")), "labels")
    while True:
        near = links.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("root").alias("m"))
        sunk = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", F.col("root").alias("old"), F.least("root", "m").alias("root"))
        ends = labels.select(F.col("node").alias("root"), F.col("root").alias("end"))
        fresh = materialize(sunk.join(ends, "root").select("node", "old", F.least("root", "end").alias("root")), "labels")
        discard(labels)
        labels = fresh
        if labels.filter("old <> root").isEmpty():
            discard(links)
            return labels.select("node", "root")


def prefix_pairs(rest: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Distinct pairs of nodes of different roots that share an element so rare in both that they may be similar enough.

    rest: node, root. Elements are ordered by how many nodes have them, rarest first. Sets of sizes m and n at the
    threshold s share at least w = s (m + n) / (1 + s) elements, hence one of the m - w + 1 and n - w + 1 rarest ones.
    """
    thousandths = round(1000 * similarity)

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch[at : at + 256]
                found = [np.frombuffer(x, dtype=np.int64) for x in part["elements"]]
                n = np.array([len(x) for x in found])
                yield pd.DataFrame({"element": np.concatenate(found), **{c: np.repeat(part[c].to_numpy(), n) for c in ("node", "root")}, "n": np.repeat(n, n)})

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for node, root, n, shared in zip(batch["node"], batch["root"], batch["n"], batch["shared"], strict=True):
                alone = n - len(shared)  # elements of this node only come first and meet nothing
                low, high = -(-n * thousandths // 1000), n * 1000 // thousandths
                own, first, last = np.searchsorted(SIZES, (n, low, high), side="right") - 1
                out = []
                for c in range(first, last + 1):
                    m = max(int(SIZES[c]), low)
                    most = n + 1 - -(-thousandths * (n + m) // (1000 + thousandths)) - alone
                    if most > 0:
                        x = np.array(shared[:most], dtype=np.int64).view(np.uint64)
                        with np.errstate(over="ignore"):
                            key = mix64(x ^ mix64(np.array([min(own, c) * 1000 + max(own, c)], dtype=np.uint64)))
                        out.append(pd.DataFrame({"key": key.view(np.int64), "pos": np.arange(len(x)) + alone, "node": node, "root": root, "n": n}))
                if out:
                    yield pd.concat(out)

    rows = rest.join(sets, "node").mapInPandas(spread, "element long, node long, root long, n long")
    several = rows.groupBy("element").agg(F.count(F.lit(1)).alias("times")).filter("times > 1")
    ranked = rows.join(several, "element").groupBy("node", "root", "n").agg(F.expr("transform(sort_array(collect_list(struct(times, element))), x -> x.element)").alias("shared"))
    keyed = materialize(ranked.mapInPandas(keys, "key long, pos long, node long, root long, n long"), "near-keys")
    tops = keyed.groupBy("key", "root").agg(F.count(F.lit(1)).alias("k")).groupBy("key").agg(F.max(F.struct("k", "root")).alias("top"), F.count(F.lit(1)).alias("roots"))
    met = keyed.join(tops.filter("roots > 1"), "key").withColumn("main", F.col("root") == F.col("top.root")).drop("top", "roots")
    shared = f"(({thousandths} * (x.n + y.n) + {999 + thousandths}) div {1000 + thousandths})"
    allowed = f"x.key = y.key AND x.root <> y.root AND (y.main OR x.node < y.node) AND x.pos <= x.n - {shared} AND y.pos <= y.n - {shared}"
    close = f"least(x.n, y.n) * 1000 >= greatest(x.n, y.n) * {thousandths}"
    pairs = met.filter("NOT main").alias("x").join(met.alias("y"), F.expr(f"{allowed} AND {close}"))
    return pairs.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def leaders(met: DataFrame) -> DataFrame:
    """node and leader: each node with the two leaders of each of its buckets, the one with most company and another one drawn."""
    drawn = F.struct(F.xxhash64("node").alias("any"), "node")
    of = met.groupBy("bucket").agg(F.max(F.struct("score", "node")).alias("x"), F.min(drawn).alias("y"), F.max(drawn).alias("z"))
    other = F.when(F.col("y.node") == F.col("x.node"), F.col("z.node")).otherwise(F.col("y.node"))
    return met.join(of.select("bucket", F.array("x.node", other).alias("leaders")), "bucket").select("bucket", "node", F.explode("leaders").alias("leader"))


def near_duplicates(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id that links lead to) and kept (doc_id = component_id).

    Documents link at a similarity of their sets of `similarity` (in thousandths) or more. Null texts and texts without
    words have an empty set and link with nothing; their component is their own id. Rows with equal sets are one class,
    repeated rows among them; a null id stands behind all others of its component. Other columns are not carried.
    """
    found = materialize(signatures(docs, words), "signatures")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", F.col("n_shingles").alias("n"), "registers", "bands")).alias("x")
    nodes = materialize(found.filter("node IS NOT NULL").groupBy("node").agg(least).select("node", "x.row", "x.n", "x.registers", "x.bands"), "nodes")
    members = nodes.select(F.explode("bands").alias("bucket"), "node")
    sizes = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("company")).filter("company > 1")
    # nodes with company, each with its buckets: at most one per band
    own = members.join(sizes, "bucket").groupBy("node").agg(F.sum("company").alias("score"), F.collect_list(F.struct("bucket", "company")).alias("buckets"))
    people = materialize(own.join(nodes.select("node", "row", "n", "registers"), "node"), "near-people")
    discard(nodes)
    sets = materialize(element_sets(docs, people, words), "near-sets")

    met = people.select("node", "score", F.explode("buckets.bucket").alias("bucket"))
    led = leaders(met)
    stars = led.filter("node <> leader").select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct()
    links = materialize(verify(stars, people, sets, similarity), "links")
    roots = components(links)

    rooted = people.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), F.explode("buckets").alias("b")).filter(f"b.company > {LEADERS + 1}")
    rooted = rooted.select("node", "root", "b.bucket")
    open_buckets = rooted.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("bucket")
    rest = materialize(rooted.join(open_buckets, "bucket").select("node", "root").distinct(), "rest")
    more = materialize(verify(prefix_pairs(rest, sets, similarity), people, sets, similarity), "links")
    if not more.isEmpty():
        roots = components(links.unionByName(more))
    for done in (people, sets, rest):
        discard(done)

    rows = materialize(found.select("doc_id", "n_shingles", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted")
    ids = rows.filter("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    out = rows.join(ids, "root", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))
