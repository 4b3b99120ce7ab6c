"""Token alignment against a plain version: byte ranges compared one by one, counts over all texts."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tandem.llm import token_align

A, B = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def plain():
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    table = {c: bytes([k]) for c, k in token_align.byte_table().items()}

    def tokens(text):
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        bytes_a = [b"".join(table[c] for c in a.id_to_token(k)) if k != 50256 else b"<|endoftext|>" for k in ids_a]
        bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(k) else p.replace("▁", " ").encode() for k in ids_b for p in [b.id_to_piece(k)]]
        if not text or b"".join(bytes_a) != (" " + text).encode() or b"".join(bytes_b) != (" " + text).encode():
            return [], [], [], []
        return ids_a, [len(x) for x in bytes_a], ids_b, [len(x) for x in bytes_b]

    def run(texts):
        found, count = [], Counter()
        for text in texts:
            ids_a, len_a, ids_b, len_b = tokens(text)
            ends_a, ends_b = np.cumsum(len_a), np.cumsum(len_b)
            links = []
            j = 0
            for i, (x, end) in enumerate(zip(ids_a, ends_a)):
                start = end - len_a[i]
                while j and ends_b[j - 1] > start:
                    j -= 1
                while j < len(ids_b) and ends_b[j] - len_b[j] < end:
                    if ends_b[j] > start:
                        links.append((x, ids_b[j]))
                    j += 1
            count.update(links)
            both = sorted(set(ends_a.tolist()) & set(ends_b.tolist()))
            groups, low = [], 0
            for high in both:
                part = [[k for k, e in zip(ids, ends) if low < e <= high] for ids, ends in ((ids_a, ends_a), (ids_b, ends_b))] if len(ids_a) < 3000 else None
                groups.append("|".join(",".join(map(str, p)) for p in part) if part else None)
                low = high
            sha = "" if not ids_a else hashlib.sha256(";".join(groups).encode()).hexdigest() if None not in groups else None
            found.append((len(ids_a), len(ids_b), len(both), links, sha))
        most = Counter()
        for (_, y), n in count.items():
            most[y] = max(most[y], n)
        return [(na, nb, ng, len(links), sum(count[p] == most[p[1]] for p in links), sum(count[p] for p in links), sha) for na, nb, ng, links, sha in found]

    return run


def texts():
    rng = random.Random(8)
    letters = "abcdeéß日😀 \n\t.<|>1½▁'"
    words = ["the", "Thtionoues", "über", "日本語", "<|endoftext|>", "<s>", "a  b", "x\ny", " ", "don't", "12,345", "😀😀", "naïve"]
    out = [None, "", " ", "  lead", "trail  ", "\n", "a", "▁", "plain ▁ sign", "<0x41>", "the the the", "the the the", "\x1c x   y \x85 z"]
    out += ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 40))) for _ in range(150)]
    out += [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 60))) for _ in range(150)]
    return out


@pytest.mark.parametrize("piece", [3, 50, token_align.PIECE])
def test_as_by_comparing_byte_ranges(spark, make, plain, piece):
    given = texts()
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    got = {r["doc_id"]: tuple(r[c] for c in names) for r in token_align.align(make(given), A, B, piece, 0 if piece == 50 else token_align.BROADCAST_PAIRS).collect()}
    assert [got[k] for k in range(len(given))] == plain(given)


def test_a_very_long_text_goes_part_by_part(spark, make, plain, monkeypatch):
    rng = random.Random(9)
    long = " ".join(f"w{rng.randrange(10**6)}{'x' * rng.randrange(9)}" for _ in range(150_000))
    given = [long, "w1 w2", "y" * 40_000]
    got = {r["doc_id"]: r for r in token_align.align(make(given), A, B).collect()}
    for k, want in enumerate(plain(given)):
        assert tuple(got[k][c] for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")) == want[:6]


def test_odd_rows_and_none(spark, odd, none):
    assert token_align.align(none, A, B).collect() == []
    got = token_align.align(odd, A, B).collect()
    assert len(got) == odd.count() and sorted(str(r["doc_id"]) for r in got) == sorted(str(r["doc_id"]) for r in odd.collect())


def test_pieces_have_equal_work_and_meet():
    rng = np.random.default_rng(10)
    for _ in range(200):
        a, b = (np.unique(np.append(rng.integers(1, 200, rng.integers(0, 60)), 200)) for _ in range(2))
        for piece in (1, 2, 7):
            links, sizes = set(), []
            for la, lb, _, _, low, high, _ in token_align.merged(a, b, piece):
                links |= set(zip(la.tolist(), lb.tolist()))
                sizes.append(sum(high) - sum(low))
            starts_a, starts_b = np.append(0, a[:-1]), np.append(0, b[:-1])
            assert links == {(i, j) for i in range(len(a)) for j in range(len(b)) if starts_a[i] < b[j] and starts_b[j] < a[i]}
            assert max(sizes) <= piece + 1 and sum(sizes) == len(a) + len(b)
