"""The training-data operators against brute force, known answers and odd tables."""

import collections
import itertools
import random
import re
import zlib

import numpy as np
import pytest

from tandem.llm import bpe, importance, language, line_dedup, media, mixing, near_dedup, quality_rules, toxicity, url_filter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def by(df, key, *cols):
    return {r[key]: tuple(r[c] for c in cols) for r in df.collect()}


def text_of(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8))) for _ in range(n))


# 1 mixing


def test_mix_meets_targets_and_repeats(make):
    rng = random.Random(1)
    sources = [rng.choice(["a", "b", None, "c"]) for _ in range(150)] + ["tiny"]
    docs = make([text_of(rng, rng.randrange(0, 60)) for _ in range(150)] + ["only five words are here"], sources=sources)
    out = mixing.taken_by_document(mixing.mix(docs, block=16, shard_slots=32)).collect()
    again = mixing.taken_by_document(mixing.mix(docs, block=16, shard_slots=32)).collect()
    assert sorted(map(tuple, out)) == sorted(map(tuple, again)) and len(out) == 151
    source = dict(enumerate(sources))
    taken, target, size = collections.Counter(), {}, {}
    for r in out:
        s = source[r["doc_id"]]
        taken[s] += r["taken"]
        target[s], size[s] = r["target"], r["source_size"]
        assert 0 <= r["taken"] <= 3 * r["size"]
    # progressive filling by the rule's own words
    order = sorted((s for s in target if s is not None)) + [None]
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    want, open_, left = {}, set(order), float(sum(size.values()))
    while True:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 3 * size[s] + 1e-9}
        if not over:
            want |= {s: level * weight[s] for s in open_}
            break
        for s in over:
            want[s] = 3.0 * size[s]
            left -= want[s]
        open_ -= over
    for s in order:
        assert abs(target[s] - want[s]) < 1e-6 and abs(taken[s] - target[s]) <= 0.5


def test_mix_takes_odd_tables(odd, none):
    out = mixing.taken_by_document(mixing.mix(odd)).collect()
    assert len(out) == 10 and all(r["taken"] <= 3 * r["size"] for r in out)
    assert {r["size"] for r in out if r["doc_id"] in (0, 1, 2)} == {0}
    assert mixing.taken_by_document(mixing.mix(none)).count() == 0
    assert mixing.mixed_documents(none).columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_mixed_text_is_made_of_whole_words_of_the_documents(make):
    rng = random.Random(2)
    texts = [text_of(rng, rng.randrange(1, 90)).replace(" ", "\n", 2) for _ in range(40)]
    docs = make(texts, sources=[rng.choice("ab") for _ in range(40)])
    taken = by(mixing.taken_by_document(mixing.mix(docs, block=16)), "doc_id", "taken")
    seen = collections.Counter()
    for r in mixing.mixed_documents(docs, block=16).collect():
        assert r["text"].rstrip() in texts[r["doc_id"]]
        seen[r["doc_id"]] += len(WORD.findall(r["text"]))
    assert {k: v for (k, (v,)) in taken.items() if v} == dict(seen)


@pytest.mark.parametrize("n", [1, 2, 3, 10, 64, 1000])
def test_permutation(n):
    out = mixing.permuted(np.arange(n), np.full(n, n), np.full(n, 12345, dtype=np.uint64))
    assert sorted(out) == list(range(n))


# 2 toxicity


def test_restores_disguises():
    counts = np.zeros(toxicity.CLASSES**3)
    c = [0, *(toxicity.code(x) for x in "idiot moron loser stupid class"), 0]
    for a, b, d in zip([0, *c], c, c[1:], strict=False):
        counts[(a * 64 + b) * 64 + d] += 50
    model = toxicity.language_model(counts)
    for raw, word in (("1d10t", "idiot"), ("m0r0n", "moron"), ("i.d.i.o.t", "idiot"), ("l_o_s_e_r", "loser"), ("iiidiot", "idiot"), ("$tup1d", "stupid"), ("cla$$", "class"), ("m*ron", "moron")):
        assert word in toxicity.words_of(raw, model), raw
    assert toxicity.words_of("plain,", model) == ["plain"] and toxicity.words_of("1234", model) == []
    assert any(w == "idiot" for w, _ in toxicity.Reader(model, {"idiot$": 3.0}).text("you i d i o t"))


def test_toxicity_learns_and_takes_odd_tables(spark, make, odd, none):
    rng = random.Random(4)
    texts, toxic = [], []
    for k in range(240):
        bad = k % 4 == 0
        words = text_of(rng, 30).split()
        if bad:
            words[rng.randrange(30)] = rng.choice(["zqmoron", "zqmor0n"]) if k > 160 else "zqmoron"
        texts.append(" ".join(words))
        toxic.append(int(bad))
    labels = spark.createDataFrame([(k, t, "x") for k, t in enumerate(toxic)], "doc_id long, toxic int, text string")
    got = by(toxicity.score_held_out(make(texts), labels), "doc_id", "held_out", "predicted", "score")
    assert all(h == (zlib.crc32(str(k).encode()) % 4 == 2) for k, (h, _, _) in got.items())
    held = [k for k, (h, _, _) in got.items() if h]
    assert sum(got[k][1] == toxic[k] for k in held) / len(held) > 0.97
    out = toxicity.score(odd, labels).collect()
    assert len(out) == 10 and all(0 <= r["score"] <= 1 for r in out)
    assert toxicity.score(none, labels.limit(0)).count() == 0


# 3 quality rules


def brute_base(text):
    words = WORD.findall(text or "")
    grams = collections.Counter(zip(words, words[1:], words[2:], strict=False))
    hit = {k + d for k, g in enumerate(zip(words, words[1:], words[2:], strict=False)) if grams[g] > 1 for d in range(3)}
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for x in lines:
        if WORD.search(x):
            dup += x in seen
            seen.add(x)
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(hit)


def test_base_rules(make, odd, none):
    rng = random.Random(6)
    texts = ["\n".join(" ".join(rng.choice(["a", "bb", "c#", "d"]) for _ in range(rng.randrange(0, 9))) for _ in range(rng.randrange(1, 9))) for _ in range(60)]
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    got = by(quality_rules.judge(make(texts)), "doc_id", *names)
    assert all(got[k] == brute_base(t) for k, t in enumerate(texts))
    out = quality_rules.judge(odd).collect()
    assert len(out) == 10 and sum(r["base_failed"] for r in out) == 8 and not any(r["kept"] and r["base_failed"] for r in out)
    assert quality_rules.judge(none).count() == 0


def test_divergent_text_is_dropped(make):
    rng = random.Random(7)
    texts = [text_of(rng, 120) + "." for _ in range(300)] + [" ".join("".join(rng.choice("0123456789#$%") for _ in range(5)) for _ in range(120))]
    got = by(quality_rules.judge(make(texts)), "doc_id", "kept")
    assert not got[300][0] and all(got[k][0] for k in range(300))


def test_symbols_and_foreign_words_are_dropped(make):
    rng = random.Random(17)
    common, foreign = (["".join(x) for x in itertools.islice(itertools.product(letters, repeat=3), 100)] for letters in ("abcde", "vwxyz"))
    prose = lambda small, letters, n: " ".join(rng.choice(small) if rng.random() < 0.4 else "".join(rng.choice(letters) for _ in range(rng.randrange(6, 9))) for _ in range(n))
    symbols = " ".join("".join(rng.choice("#$%&|<>*!?;:()-") for _ in range(6)) for _ in range(120))
    texts = [prose(common, "abcdefghij", 120) for _ in range(300)] + [symbols, prose(foreign, "abcdefghij", 120), prose(foreign, "abcdefghij", 50), prose(common, "abcdefghij", 50), symbols[:340]]
    got = by(quality_rules.judge(make(texts)), "doc_id", "kept", "class_distance", "word_distance", "common_distance", "base_failed")
    assert all(got[k][0] for k in [*range(300), 303]) and not any(got[k][0] or got[k][4] for k in (301, 302, 300))
    assert got[300][1] > quality_rules.MAX_CLASS_DISTANCE and got[304][1] > quality_rules.MAX_CLASS_DISTANCE
    assert all(got[k][3] == pytest.approx(1) and got[k][2] < quality_rules.MAX_WORD_DISTANCE for k in (301, 302))


# 4 language


def test_language_is_told_apart(make, odd, none):
    rng = random.Random(8)
    parts = {"en": ["the", "and", "ing", "tion"], "de": ["der", "und", "ung", "sch"], "fr": ["les", "eau", "oi", "que"], "es": ["los", "cion", "ado", "ñ"], "ja": ["日本", "語", "です"]}
    langs = [rng.choice(list(parts)) for _ in range(400)]
    texts = [" ".join("".join(rng.choice(parts[g]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(3, 30))) for g in langs]
    out = language.identify_held_out(make(texts, langs=langs)).collect()
    held = [r for r in out if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in out)
    assert sum(r["lang_pred"] == langs[r["doc_id"]] for r in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 for r in out)
    got = [(r["doc_id"], r["lang_pred"]) for r in language.label(odd).collect()]
    assert len(got) == 10 and {g for k, g in got if k in (0, 1, 2, 4)} == {"und"}
    assert language.label(none).count() == 0


def test_copies_count_once_in_the_training_sample(spark, make):
    rng = random.Random(18)
    texts = [text_of(rng, 12) for _ in range(200)]
    order = {r[0]: r[1] for r in spark.createDataFrame([(t,) for t in texts], "t string").selectExpr("t", "xxhash64(t)").collect()}
    # fr: 2 texts of 400 copies that a share of the rows (15 of 800) passes over; en: the least hash has 60 copies
    few = [t for t in texts if order[t] % 1_000_000 >= 100_000][:2]
    many = sorted(set(texts) - set(few), key=order.get)
    rows = [(t, "fr") for t in few * 400] + [(t, "en") for t in many + many[:1] * 60] + [(None, "en"), ("12 !", "de"), ("one", None)]
    docs = make([t for t, _ in rows], langs=[g for _, g in rows])
    model = language.fit(docs, 5)
    assert model["langs"] == ["en", "fr"] and language.guess(model, few[0])[0] == "fr"
    langs, sample = language.training_sample(docs, 5)
    got = sorted((r["lang"], r["text"]) for r in sample.collect())
    passed = [t for t in many if order[t] % 1_000_000 < 15 / len(many) * 1_000_000]
    assert langs == ["en", "fr"] and len(passed) >= 5
    assert got == sorted([("fr", t) for t in few] + [("en", t) for t in passed[:5]])


# 5 url filters


def brute_url(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[2:] if fits else (None, "allow")))


def test_urls_against_brute_force(spark):
    rng = random.Random(9)
    label = lambda: rng.choice(["a", "b", "com", "net", "co"])
    path = lambda: "".join(rng.choice(["/", "x", "y", "/x"]) for _ in range(rng.randrange(5)))
    host = lambda: ".".join(label() for _ in range(rng.randrange(1, 4)))
    rules = list({(host(), "/" + path() if rng.random() < 0.9 else ""): rng.choice(["allow", "block"]) for _ in range(40)}.items())
    rules = [(h, p, v) for (h, p), v in rules]
    urls = [None, "", "no scheme", "://", "http://", "HTTP://A.Com/x?y://z#q", "x://com"] + [f"http://{host()}/{path()}{rng.choice(['', '?q=/x', '#x'])}" for _ in range(200)]
    pages = spark.createDataFrame([(k, u, "host", "rule") for k, u in enumerate(urls)] + [(5, urls[5], "a", "b")], "page_id long, url string, host string, key string")
    frame = spark.createDataFrame(rules, "host string, path string, verdict string")
    out = url_filter.filter_urls(pages, frame, salts=3).collect()
    assert len(out) == len(urls) + 1
    for r in out:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == brute_url(urls[r["page_id"]], rules)
    assert url_filter.filter_urls(pages.limit(0), frame).count() == 0
    assert url_filter.filter_urls(pages, frame.limit(0)).filter("rule IS NOT NULL").count() == 0


# 6 BPE


def test_bpe_equals_the_library(odd, none):
    tokenizers = pytest.importorskip("tokenizers")
    public = pytest.importorskip("public_tokenizers")
    path = public.path("word_bpe_49k.json")
    lib, own = tokenizers.Tokenizer.from_file(path), bpe.load(path)
    rng = random.Random(10)
    texts = ["", "ΑΣΣ ΟΔΥΣΣΕΥΣ", "İstanbul É é ﬁ", "a<|endoftext|>b <|startoftext|>", "it's we'LL don't 's'", "\x1c a\x85b​c　d", "a" * 3000, "ab" * 500, "é ẛ̣", "１２３ ²½", "<|", "日本語 テキスト 😀👍🏽"]
    texts += ["".join(rng.choice(["th", "e", "ing", " ", "'s", "!", "9", "É", "中", "ß", "\n", "aaa"]) for _ in range(rng.randrange(60))) for _ in range(800)]
    for t in texts:
        want = lib.encode(t, add_special_tokens=False).ids
        ids = own.encode(t)
        assert np.frombuffer(ids, "<u4").tolist() == want, t
        assert own.decode(ids).decode() == lib.decode(want, skip_special_tokens=False), t
    for w in ("the", "antidisestablishment", "zzzqqq", "xx" * 40):
        assert own.encode_word(w) == own.merged("".join(map(chr, [*w[:-1].encode(), w[-1].encode()[0] + 256])))
    out = bpe.encode_documents(odd, path).collect()
    assert len(out) == 10 and {bytes(r["ids"]) for r in out if r["doc_id"] in (0, 1, 2)} == {b""}
    assert bpe.encode_documents(none, path).count() == 0


# 7 near duplicates


def brute_components(texts, words, share):
    sets = []
    for t in texts:
        w = [x.lower() for x in WORD.findall(t or "")]
        sets.append({tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set()))
    root = list(range(len(texts)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and both >= share * len(sets[a] | sets[b]) - 1e-9:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), find(k)) for k in range(len(texts))}


@pytest.mark.parametrize("words", [2, 5])
def test_near_duplicates_against_brute_force(make, words):
    rng = random.Random(11)
    base = [text_of(rng, rng.randrange(1, 120)).split() for _ in range(12)]
    texts = []
    for _ in range(170):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 4, 8])):
            w[rng.randrange(len(w))] = rng.choice(["edit", "other", "x"])
        texts.append(" ".join(w).upper() if rng.random() < 0.2 else " ".join(w))
    want = brute_components(texts, words, 0.8)
    got = by(near_dedup.near_duplicates(make(texts), words=words), "doc_id", "n_shingles", "component_id", "kept")
    assert got == {k: (n, c, c == k) for k, (n, c) in want.items()}


def test_near_duplicates_take_odd_tables(odd, none):
    out = near_dedup.near_duplicates(odd).collect()
    assert len(out) == 10 and {r["component_id"] for r in out if r["doc_id"] == 7} == {7}
    assert {r["n_shingles"] for r in out if r["doc_id"] in (0, 1, 2)} == {0}
    assert near_dedup.near_duplicates(none).count() == 0


def test_estimate_and_merge():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    a, b = x[:2000], x[500:2500]
    r = near_dedup.registers([a, b, np.concatenate([a, b])])
    assert (np.maximum(r[0], r[1]) == r[2]).all()
    j = near_dedup.estimate(r[:1], r[1:2], np.array([2000]), np.array([2000]))[0]
    assert abs(j - 1500 / 2500) < 0.2


# 8 media


def test_media_round_trip(odd, none):
    import io

    import pyarrow as pa

    out = media.media_columns(odd).collect()
    texts = {tuple(r)[:2] for r in odd.select("doc_id", "text").collect()}
    raw = {k: (t or "").encode() for k, t in texts}
    for r in out:
        payload = bytes(r["payload"])
        assert payload == raw[r["doc_id"]] + b" " * (len(payload) - len(raw[r["doc_id"]])) and len(payload) % 192 == 0 and payload
        assert media.read_back(bytes(r["media"])) == payload and r["n_bytes"] == len(raw[r["doc_id"]])
        t = pa.ipc.open_stream(io.BytesIO(bytes(r["tensors"]))).read_all()
        assert t.schema.field("mel").type == pa.fixed_shape_tensor(pa.float32(), [media.FRAMES, media.MELS])
        assert t["start_s"][0].as_py() == 0.0 and all(a <= b for a, b in zip(t["start_s"].to_pylist(), t["end_s"].to_pylist(), strict=True))
    same = [r for r in out if r["doc_id"] == 7]
    assert same[0]["tensors"] == same[1]["tensors"]
    assert media.media_columns(none).count() == 0


def test_resampling_keeps_a_tone():
    t = np.arange(4000) / 8000
    for up, down in ((1, 2), (3, 2), (2, 3)):
        y = media.resample(np.sin(2 * np.pi * 300 * t), up, down)
        want = np.sin(2 * np.pi * 300 * np.arange(len(y)) * down / up / 8000)
        assert len(y) == -(-4000 * up // down) and np.abs(y - want)[50:-50].max() < 0.02


@pytest.mark.parametrize("n", [96, 256, 257, 384, 480, 511])
def test_frames_cover_the_last_sample(n):
    x = np.random.default_rng(n).normal(size=n)
    changed = x.copy()
    changed[-40:] += 3
    mel, loud = media.log_mel(x, 4000)
    assert len(mel) == len(loud) == max(1, -(-(n - media.FRAME) // media.HOP) + 1)
    assert not np.allclose(mel[-1], media.log_mel(changed, 4000)[0][-1])


def test_payloads_that_differ_at_the_end_have_other_energies():
    mel = [media.log_mel(media.resample(np.frombuffer(bytes(800) + tail * 160, dtype=np.uint8).astype(float)), 6000)[0] for tail in (b"a", b"z")]
    assert mel[0].shape == (5, media.MELS) and not np.allclose(mel[0], mel[1])


def test_hysteresis():
    loud = np.array([0, 5, 0, -2, -4, 0, 5, 5, -4, -4.0])
    assert media.segments(loud - np.median(loud), 4, -3) == [(1, 4), (6, 8)]


# 9 importance resampling


def test_importance_prefers_the_target(make, odd, none):
    rng = random.Random(12)
    good = [text_of(rng, 60) for _ in range(100)]
    bad = [" ".join("".join(rng.choice("uvwxyz") for _ in range(5)) for _ in range(60)) for _ in range(100)]
    docs = make(good + bad)
    out = importance.resample(docs, docs.filter("doc_id < 60"), share=0.5).collect()
    assert sum(r["kept"] for r in out) == 100 and sum(r["kept"] for r in out if r["doc_id"] < 100) >= 95
    again = importance.resample(docs, docs.filter("doc_id < 60"), share=0.5).collect()
    assert sorted(map(tuple, out)) == sorted(map(tuple, again))
    got = importance.resample(odd, odd.filter("doc_id = 5")).collect()
    assert len(got) == 10 and len({r["kept"] for r in got if r["doc_id"] == 7}) == 1
    assert importance.resample(none, none).count() == 0


def test_kth_largest_is_exact(spark):
    rng = random.Random(13)
    values = [rng.choice([rng.gauss(0, 1), rng.gauss(0, 1e6), 3.0]) for _ in range(20_000)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for k in (1, 2, 5000, 19_999, 20_000):
        assert importance.kth_largest(df, "v", k) == sorted(values, reverse=True)[k - 1]


# 10 line dedup


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_repeated_lines_against_brute_force(make):
    rng = random.Random(14)
    base = [text_of(rng, 8) for _ in range(15)] + ["é" + text_of(rng, 7), "short"]
    texts = []
    for _ in range(60):
        lines = []
        for _ in range(rng.randrange(1, 6)):
            s = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 1, 2, 3, 4])):
                k = rng.randrange(len(s))
                s[k : k + rng.randrange(2)] = rng.choice(["", "q", "ö"])
            lines.append("".join(s))
        texts.append("\n".join(lines))
    places = [(d, p, x.strip(" ")) for d, t in enumerate(texts) for p, x in enumerate(t.split("\n"))]
    want, near = collections.Counter(), collections.Counter()
    for k, (d, _, x) in enumerate(places):
        exact = x in (y for _, _, y in places[:k])
        if x and (exact or len(x) >= 20 and any(len(y) >= 20 and abs(len(x) - len(y)) <= 2 and edits(x, y) <= 2 for _, _, y in places[:k])):
            want[d] += 1
            near[d] += not exact
    got = by(line_dedup.dedup_report(make(texts), min_chars=20), "doc_id", "n_lines", "n_removed", "n_near")
    assert got == {d: (t.count("\n") + 1, want[d], near[d]) for d, t in enumerate(texts)} and sum(near.values()) > 5


@pytest.mark.parametrize("most", [1, 2, 3])
def test_bit_parallel_distance(spark, most):
    from pyspark.sql import functions as F

    rng = random.Random(most)
    pairs = []
    for _ in range(400):
        a = "".join(rng.choice("abé😀") for _ in range(rng.randrange(1, 12)))
        b = list(a)
        for _ in range(rng.randrange(0, 5)):
            k = rng.randrange(len(b) + 1)
            b[k : k + rng.randrange(2)] = rng.choice(["", "b", "é"])
        if b and abs(len(a) - len(b)) <= most:
            pairs.append((a, "".join(b)))
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", F.expr(line_dedup.within("a", "b", most)).alias("near")).collect()
    assert all(r["near"] == (edits(r["a"], r["b"]) <= most) for r in rows)


def test_lines_keep_columns_of_any_name(make):
    names = ["removed", "gone_id", "text_hash", "own_hash", "d", "hit", "rest", "h", "pos", "line"]
    docs = make(["a\nb", "b\nc", "b"]).selectExpr("doc_id", "text", *(f"cast({k} AS int) AS {n}" for k, n in enumerate(names)), "n_chars")
    out = line_dedup.remove_repeats(docs)
    assert out.columns == docs.columns
    assert {r["doc_id"]: (r["text"], r["own_hash"], r["line"]) for r in out.collect()} == {0: ("a\nb", 3, 9), 1: ("c", 3, 9)}


def test_lines_take_odd_tables(make, odd, none):
    got = {r["doc_id"]: r["n_lines"] for r in line_dedup.dedup_report(odd).collect()}
    assert got[0] == 0 and got[1] == 1 and got[2] == 2
    assert line_dedup.dedup_report(none).count() == 0
    line = "this line is long enough to be looked at"
    docs = make([f"first\n{line}", f"{line}\nkept", line, None, ""])
    out = {r["doc_id"]: (r["text"], r["n_chars"]) for r in line_dedup.remove_repeats(docs).collect()}
    assert out == {0: (f"first\n{line}", 46), 1: ("kept", 4), 3: (None, None), 4: ("", 0)}
