"""The pipeline's stages on a small corpus."""

import random

import corpus_pipeline


def test_stages(spark, make, tmp_path):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    base = [text(80) for _ in range(30)]
    texts = [*base, base[0], base[1].replace(base[1].split()[5], "changed"), None, "", "1234 !!", "\n".join([text(12), text(60)])]
    docs = make(texts, sources=[rng.choice("abc") for _ in texts]).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    rows, at = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, str(tmp_path))
        if name != names[-1]:
            assert at.columns == docs.columns
        at.write.parquet(f"{tmp_path}/{name}")
        at = spark.read.parquet(f"{tmp_path}/{name}")
        rows[name] = at.collect()
    ids = lambda name: {r["doc_id"] for r in rows[name]}
    assert ids("language") == set(range(len(texts))) - {32, 33, 34}
    assert ids("line dedup") == ids("language") - {30}
    assert 31 not in ids("near dedup") and set(range(30)) <= ids("near dedup")
    assert all(r["n_tokens"] == len(r["ids"]) // 4 for r in rows["tokens"]) and len(rows["tokens"]) == len(rows["mixing"])
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(r["n_tokens"] for r in got.collect()) == sorted(r["n_tokens"] for r in rows["tokens"])
