"""SQL beside the operators that have it, brute force beside the others, and working names that callers may use."""

import itertools
import math
import os
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tandem.llm import common, importance, language, line_dedup, media, mixing, near_dedup, queries, toxicity

from test_operators import brute_components, by, text_of

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    df = queries.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({queries.ORACLE_SQL[name]})").fetchall()
    assert sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str) == sorted(want, key=str)


def test_a_large_group_of_near_copies(spark, make):
    """700 copies with edits of their own, most pairs of them from 0.6 to 0.85: components as by brute force, few pairs."""
    rng = random.Random(21)
    base = text_of(rng, 150).split()
    texts = []
    for k in range(700):
        w = list(base)
        for i in rng.sample(range(150), rng.randrange(1, 14)):
            w[i] = f"own{k}x{i}"
        texts.append(" ".join(w))
    texts += [" ".join(base[: 150 - k]) for k in range(0, 60, 7)]  # cut short, without words of their own
    want = brute_components(texts, 2, 0.8)
    docs = make(texts)
    got = by(near_dedup.near_duplicates(docs, words=2), "doc_id", "n_shingles", "component_id")
    assert got == want and 20 < len({c for _, c in want.values()}) < 500


def test_prefix_pairs_lose_no_link_and_leave_most_pairs_out(spark):
    rng = random.Random(22)
    sets = {}
    for k in range(120):
        old = rng.choice(list(sets.values())) if k > 10 and rng.random() < 0.7 else set(rng.sample(range(3000), rng.randrange(5, 90)))
        sets[k] = {x if rng.random() > 0.1 else rng.randrange(3000) for x in old}
    rows = [(k, np.array(sorted(s), dtype=np.int64).tobytes()) for k, s in sets.items()]
    elements = spark.createDataFrame([(k, bytearray(b)) for k, b in rows], "node long, elements binary")
    rest = elements.select("node", F.col("node").alias("root"))
    got = {(r["a"], r["b"]) for r in near_dedup.prefix_pairs(rest, elements, 0.8).collect()}
    pairs = list(itertools.combinations(sets, 2))
    linked = {(a, b) for a, b in pairs if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert linked and linked <= got and len(got) < len(pairs) / 10
    one_root = rest.withColumn("root", F.lit(1).cast("long"))
    assert near_dedup.prefix_pairs(one_root, elements, 0.8).count() == 0


def test_restores_the_cheapest_of_all_readings():
    rng = random.Random(23)
    counts = np.array([rng.randrange(1, 9) ** 3 for _ in range(toxicity.CLASSES**3)], dtype=float)
    model = toxicity.language_model(counts)

    def cost(parts):
        x = y = 0
        total = 0.0
        for text, price in parts:
            total += price
            for c in text:
                z = toxicity.code(c)
                if z or y:
                    total += model[x][y][z]
                    x, y = y, z
        return total + model[x][y][0]

    for token in ("1d10t", "a$$", "m0r.n", "b--4d", "lll0", "x*y"):
        readings = [(cost(parts), "".join(t for t, _ in parts)) for parts in itertools.product(*toxicity.lattice(token))]
        best = min(c for c, _ in readings)
        assert toxicity.restore(token, model) in {t for c, t in readings if c < best + 1e-9}, token


def test_reader_finds_what_every_token_by_itself_would_give():
    rng = random.Random(24)
    model = toxicity.language_model(np.ones(toxicity.CLASSES**3))
    tokens = ["Word", "w0rd", "a.b.c", "ß$x", "don't", "aaab", "!!!", "12", "日本", "İx", "\U0001f600ab", "x*y"]
    texts = ["".join(rng.choice(tokens) + rng.choice([" ", "\n", "  "]) for _ in range(rng.randrange(20))) for _ in range(60)] + ["q i d i o t q", "i d i o t"]
    for t in texts:
        low = t.lower()
        want = set().union(*(toxicity.beginnings(toxicity.words_of(x, model)) for x in set(low.split()))) if low.split() else set()
        for m in toxicity.APART.finditer(low):
            want |= set(toxicity.beginnings(toxicity.words_of(m[0].replace(" ", "_"), model)))
        assert toxicity.Reader(model).text(t) == want, t


def test_scores_follow_from_words_and_weights(spark, make):
    rng = random.Random(25)
    texts = [" ".join(text_of(rng, 20).split() + (["zqvile"] if k % 3 == 0 else [])) for k in range(200)]
    docs = make(texts)
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(200)], "doc_id long, toxic int")
    model, lexicon, weights = toxicity.learn(docs, labels)
    assert "zqvile$" in lexicon
    for k, (score, found) in by(toxicity.score(docs, labels), "doc_id", "score", "found").items():
        best = {w: max(lexicon.get(f, 0.0) for f in toxicity.beginnings([w])) for w in texts[k].split() if toxicity.beginnings([w])}
        hits = [v for v in best.values() if v > 0]
        x = [max(hits, default=0.0) / 5, math.log1p(sum(hits)), math.log1p(len(hits)), 1.0]
        assert found == sorted(w for w, v in best.items() if v > 0)
        assert score == pytest.approx(1 / (1 + math.exp(-float(np.dot(weights, x)))))


def test_a_token_of_a_million_characters():
    model = toxicity.language_model(np.ones(toxicity.CLASSES**3))
    assert len(toxicity.Reader(model).text("a*b." * 250_000)) >= 0
    assert len(common.word_hashes(["x" * 1_000_000])[0]) == 1
    assert len(near_dedup.shingle_sets(["y" * 1_000_000 + " z"], 2)[0]) == 1
    assert language.features("z" * 1_000_001).sum() == 3 * 1_000_001 - 3


def test_language_features_are_counts_of_n_grams():
    def plain(text):
        out = np.zeros(language.DIM)
        codes = [ord(c.lower()[0]) if c.isalpha() else 0 for c in text]
        codes = [c for k, c in enumerate(codes) if c or k == 0 or codes[k - 1]]
        for n in (1, 2, 3):
            for k in range(len(codes) - n + 1):
                key = 0
                for c in codes[k : k + n]:
                    key = (key * 0x110000 + c) % 2**64
                if key:
                    with np.errstate(over="ignore"):
                        out[int(common.mix64(np.array([key * 4 + n], dtype=np.uint64))[0] % np.uint64(language.DIM))] += 1
        return out

    for text in ("Hello, World", "a", "éß 日本", "  x  y1z "):
        got, want = language.features(text), plain(text)
        assert (got == want).all(), (text, got.sum(), want.sum())


def test_log_mel_by_its_definition():
    x = np.random.default_rng(3).normal(size=700)
    mel, loud = media.log_mel(x, 6000)
    padded = np.concatenate([x, np.zeros(-(700 - media.FRAME) % media.HOP)])
    bank = media.mel_bank(6000, media.FRAME // 2 + 1, media.MELS)
    n = np.arange(media.FRAME)
    for k in (0, len(mel) - 1):
        frame = padded[k * media.HOP : k * media.HOP + media.FRAME] * (0.5 - 0.5 * np.cos(2 * np.pi * n / (media.FRAME - 1)))
        power = np.array([abs(np.sum(frame * np.exp(-2j * np.pi * f * n / media.FRAME))) ** 2 for f in range(media.FRAME // 2 + 1)])
        assert np.allclose(mel[k], np.log(power @ bank + 1e-6), atol=1e-4) and loud[k] == pytest.approx(10 * np.log10(power.sum() + 1e-9))


@pytest.mark.parametrize(("up", "down"), [(3, 4), (2, 3), (1, 2)])
def test_polyphase_equals_filtering_the_raised_signal(up, down):
    x = np.random.default_rng(4).normal(size=200)
    taps = media.low_pass(up, down).T.reshape(-1)
    raised = np.zeros(200 * up)
    raised[::up] = x
    full = np.convolve(raised, taps)[8 * max(up, down) :]
    want = full[: 200 * up : down]
    got = media.resample(x, up, down)
    assert len(got) == len(want) and np.allclose(got, want)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_media_digests(spark):
    docs = {r["doc_id"]: r["text"] for r in common.read(spark, DATA, "documents").select("doc_id", "text").collect()}
    for r in queries.op8_media(spark, DATA).collect():
        payload = media.payload_of(docs[r["doc_id"]])
        assert r["payload_bytes"] == len(payload) and r["tail_crc32"] == zlib.crc32(payload[-16:]) and r["media_bytes"] == len(media.store(payload))


def test_importance_weights_by_plain_counting(make):
    rng = random.Random(26)
    texts = [text_of(rng, rng.randrange(0, 12)) for _ in range(40)] + [None, "", "one"]
    docs = make(texts)

    def grams(text):
        h = [int(x) for x in common.word_hashes([text])[0]]
        with np.errstate(over="ignore"):
            pairs = [int(common.mix64(np.array([(a * 0x9E3779B97F4A7C15 + b) % 2**64], dtype=np.uint64))[0]) for a, b in zip(h, h[1:], strict=False)]
        return [x % importance.BUCKETS for x in h + pairs]

    def share(of):
        counts = np.zeros(importance.BUCKETS)
        for t in of:
            np.add.at(counts, grams(t), 1)
        return np.log((counts + importance.PRIOR) / (counts.sum() + importance.PRIOR * importance.BUCKETS))

    ratio = share(texts[:15]) - share(texts)
    got = by(importance.log_weights(docs, docs.filter("doc_id < 15")), "doc_id", "n_grams", "log_weight")
    for k, t in enumerate(texts):
        assert got[k][0] == len(grams(t)) and got[k][1] == pytest.approx(sum(ratio[g] for g in grams(t)))


def test_shards_draw_every_source_and_have_one_size(make):
    rng = random.Random(27)
    docs = make([text_of(rng, 40) for _ in range(120)], sources=[f"s{k % 60}" for k in range(120)])
    spans = mixing.mix(docs, block=8, shard_slots=16).filter("taken > 0")
    slots = [(r["key"], r["slot"], r["shard"]) for r in spans.select("key", "slot", "shard").distinct().collect()]
    assert len({(k, s) for k, s, _ in slots}) == len(slots) and len({k for k, _, _ in slots}) == 60
    sizes = {}
    for _, _, shard in slots:
        sizes[shard] = sizes.get(shard, 0) + 1
    assert max(sizes.values()) <= 16 and sorted(sizes) == list(range(len(sizes)))


def test_repeated_rows_have_their_spans_each(make):
    docs = make(["a b c d e f"] * 3, ids=[1, 1, 2])
    out = mixing.mixed_documents(docs, block=2).collect()
    taken = by(mixing.mix(docs, block=2).groupBy("doc_id").agg(F.sum("taken").alias("taken")), "doc_id", "taken")
    words = {}
    for r in out:
        words[r["doc_id"]] = words.get(r["doc_id"], 0) + len(r["text"].split())
    assert words == {k: v for k, (v,) in taken.items()} == {1: 12, 2: 6}


NAMES = ["id", "any", "kept", "component_id", "guess", "score", "lang_pred", "node", "row", "d", "removed", "text_hash", "key", "part", "seq", "size", "start", "block", "h", "line", "root"]


def test_stages_take_columns_of_any_name(spark, make):
    rng = random.Random(28)
    texts = [text_of(rng, 30) for _ in range(12)]
    texts += [texts[0], None, "", "12 34"]
    plain = make(texts, sources=[rng.choice("ab") for _ in texts]).select("doc_id", "text", "lang", "source", "n_chars")
    docs = plain.select("*", *(F.lit(k).alias(n) for k, n in enumerate(NAMES)))
    for name, stage in corpus_pipeline.STAGES:
        own, other = stage(spark, docs, ""), stage(spark, plain, "")
        if name in ("language", "line dedup", "near dedup"):
            assert own.columns == docs.columns and all(r[n] == k for r in own.collect() for k, n in enumerate(NAMES))
        shared = [c for c in other.columns if c != "ids"]
        assert sorted(map(str, own.select(shared).collect())) == sorted(map(str, other.select(shared).collect()))
        assert stage(spark, docs.limit(0), "").count() == 0


def test_a_buckets_leaders_are_two(spark):
    """Of three nodes all pairs are tried, whichever node has most company."""
    met = spark.createDataFrame([(b, b * 10 + k, (b + k) % 3) for b in range(200) for k in range(3)], "bucket long, node long, score long")
    rows = near_dedup.leaders(met).filter("node <> leader").collect()
    pairs = {}
    for r in rows:
        pairs.setdefault(r["bucket"], set()).add(frozenset((r["node"], r["leader"])))
    assert len(pairs) == 200 and all(len(p) == 3 for p in pairs.values())


def test_no_letter_no_language(spark, make):
    texts = ["² 😀", "½ 😀😀", "12 ③ 💩", "𝟘𝟙", None, "", "#!"] + ["plain english words here"] * 5 + ["𐐀𐐁 deseret"]
    got = by(language.identify_held_out(make(texts)), "doc_id", "lang_pred")
    assert [got[k] for k in range(7)] == [("und",)] * 7 and got[12] != ("und",)


def test_lines_go_from_a_text_of_very_many(spark, make):
    """100 000 lines, every third a repeat: what stays is in order, in a time that grows with the lines."""
    lines = [f"line number {k} of a long text" if k % 3 else "the same line once more" for k in range(100_000)]
    docs = make(["\n".join(lines), "a\nthe same line once more", None])
    got = {r["doc_id"]: r["text"] for r in line_dedup.remove_repeats(docs, min_chars=1000).collect()}
    first = lines.index("the same line once more")
    assert got[0] == "\n".join(x for k, x in enumerate(lines) if k % 3 or k == first) and got[1] == "a"


def test_a_star_may_be_any_letter_in_a_token_of_any_length():
    """The same disguise is read alike in short and long tokens."""
    model = [[[1.0] * toxicity.CLASSES for _ in range(toxicity.CLASSES)] for _ in range(toxicity.CLASSES)]
    for x, y, z in [(0, 2, 1), (2, 1, 4), (1, 4, 0), (2, 1, 27 + ord("-") % 37)]:
        model[x][y][z] = 0.0
    short = len(toxicity.lattice("b*d")[1])
    assert all(len(o) == short for c, o in zip("b*d" * 100, toxicity.lattice("b*d" * 100)) if c == "*")
