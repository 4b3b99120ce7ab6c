"""Tables with the cases that every operator must take: nulls, empty and long texts, repeated rows, clashing names."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, score double, row int, bucket long"


def prose(rng, n, letters="abcdefghij"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(2, 8))) for _ in range(n))


@pytest.fixture(scope="session")
def make(spark):
    def build(texts, **columns):
        rows = [(columns.get("ids", range(len(texts)))[k], t, columns.get("langs", ["en"] * len(texts))[k], columns.get("sources", ["s"] * len(texts))[k], None if t is None else len(t), "k", 0.5, 7, 9) for k, t in enumerate(texts)]
        return spark.createDataFrame(rows, SCHEMA)

    return build


@pytest.fixture(scope="session")
def odd(make):
    """Null, empty, blank and very long texts, null columns, repeated rows."""
    rng = random.Random(3)
    long = prose(rng, 30_000)
    texts = [None, "", " \n\t ", "one", "#### 1234 !!", long, prose(rng, 80), "same text here twice", "same text here twice", "Ünïcödé ﬁne 日本語 😀 text"]
    ids = [0, 1, 2, 3, 4, 5, None, 7, 7, 9]
    langs = ["en", None, "fr", "en", None, "en", "en", "xx-too-long", "xx-too-long", "en"]
    sources = ["a", None, "b", "", "a", "b", None, "c", "c", "a"]
    return make(texts, ids=ids, langs=langs, sources=sources)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
