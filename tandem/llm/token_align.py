"""Alignment of two tokenizers' tokens by the bytes that they cover, and how often ids meet in the whole corpus.

Both tokenizers cut the same bytes, so a text's two lists of token ends are merged: each end is one link, from the A token
before it to the B token before it, and an end of both closes a group. Merge-path partitioning divides the merging: the
place where the two lists stand after any number of steps is found by a binary search along a diagonal, so pieces of equal
work begin where they like, in the middle of a text or token, and know nothing of each other. A piece counts its own group
ends; their running sum numbers the groups that go over a piece's edges.

A text falls into stretches at single spaces between other characters: neither tokenizer has a token over such a place, so
stretches are encoded once each while they are remembered, and a text of any length is gone through part by part.
"""

from __future__ import annotations

import functools
import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release

#: Steps of merging in a piece; stretches worked on at once; characters of stretches that a worker remembers.
PIECE, PART, MOST = 1 << 15, 1 << 16, 1 << 22
#: More pairs of ids than this are joined by a shuffle; a pair in a broadcast is some 40 bytes.
BROADCAST_PAIRS = 2_000_000
_EDGE, _UNSURE = re.compile(r"(?<=\S) (?=\S)"), re.compile(r"\s | \s|^ | $")


def stretches(text: str) -> list[str]:
    """The text cut at every single space that stands between two characters which are no white space; these spaces go."""
    return _EDGE.split(text) if _UNSURE.search(text) else text.split(" ")


def ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    ends = np.cumsum(lens)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lens), lens)


def byte_table() -> dict[str, int]:
    """The character that byte-level entries write for each byte: itself where it can be seen, else the next from U+0100 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in seen]
    return {chr(b): b for b in seen} | {chr(256 + k): b for k, b in enumerate(rest)}


class Rows:
    """Lists of ids, one after the other in an array that grows by doubling."""

    def __init__(self) -> None:
        self.flat, self.start, self.n = np.zeros(1 << 16, np.int32), np.zeros(1, np.int64), 0

    def add(self, lists: list[list[int]]) -> None:
        lens = np.fromiter(map(len, lists), np.int64, len(lists))
        more = np.fromiter((x for ids in lists for x in ids), np.int32, int(lens.sum()))
        while self.n + len(more) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        self.flat[self.n : self.n + len(more)] = more
        self.start = np.concatenate((self.start, self.n + np.cumsum(lens)))
        self.n += len(more)

    def take(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these lists one after the other, and how many each has."""
        lens = self.start[at + 1] - self.start[at]
        return self.flat[ragged(self.start[at], lens)], lens


class Tokenizers:
    """A: byte-level entries of a tokenizer file. B: a sentencepiece model, which puts a space before what it is given."""

    def __init__(self, a_path: str, b_path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True  # their strings in a text are then ordinary text
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        table = byte_table()
        entries = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(entries.values()) + 1)
        for entry, k in entries.items():
            self.a_bytes[k] = bytes(table[c] for c in entry) if all(c in table for c in entry) else entry.encode()
        pieces = [(self.b.id_to_piece(k), self.b.is_byte(k)) for k in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if byte else p.replace("▁", " ").encode() for p, byte in pieces]
        self.a_len, self.b_len = (np.array(list(map(len, x)), np.int64) for x in (self.a_bytes, self.b_bytes))
        self.names = pa.array([str(k) for k in range(max(len(self.a_bytes), len(self.b_bytes)))])
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.rows = Rows(), Rows()
        self.right, self.size = np.zeros(0, bool), 0

    def encode(self, words: list[str]) -> np.ndarray:
        """Numbers of the words' rows; words not met yet are encoded, after all others are forgotten if they are too many."""
        new = [w for w in set(words) if w not in self.index]
        if self.size + sum(map(len, new)) > MOST:
            self.forget()
            new = list(set(words))
        if new:
            spaced = [" " + w for w in new]
            a = [e.ids for e in self.a.encode_batch_fast(spaced, add_special_tokens=False)]
            b = self.b.encode(new, num_threads=1)
            self.rows[0].add(a)
            self.rows[1].add(b)
            want = [s.encode("utf-8", "surrogatepass") for s in spaced]
            right = [w == b"".join(self.a_bytes[k] for k in x) == b"".join(self.b_bytes[k] for k in y) for w, x, y in zip(want, a, b, strict=True)]
            self.right = np.concatenate((self.right, np.array(right, bool)))
            self.index.update(zip(new, range(len(self.index), len(self.index) + len(new))))
            self.size += sum(map(len, new))
        return np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))


@functools.lru_cache(maxsize=1)
def load(a_path: str, b_path: str) -> Tokenizers:
    return Tokenizers(a_path, b_path)


def crossing(a_ends: np.ndarray, b_ends: np.ndarray, step: int) -> tuple[int, int]:
    """How many of each list come first when both are merged for so many steps; of equal ends A's, and then B's comes too."""
    low, high = max(0, step - len(b_ends)), min(step, len(a_ends))
    while low < high:
        i = (low + high) // 2
        if a_ends[i] <= b_ends[step - i - 1]:
            low = i + 1
        else:
            high = i
    i, j = low, step - low
    if i and j < len(b_ends) and a_ends[i - 1] == b_ends[j]:
        j += 1
    return i, j


def merge_piece(a_ends: np.ndarray, b_ends: np.ndarray, low: tuple[int, int], high: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the ends between two crossings: the linked A and B tokens by number, and for each A and B end whether both end there."""
    (i0, j0), (i1, j1) = low, high
    ea, eb = a_ends[i0:i1], b_ends[j0:j1]
    over_a, over_b = np.searchsorted(eb, ea), np.searchsorted(ea, eb)  # the other list's token at an end; past the piece, its next one
    shut_a, shut_b = np.zeros(len(ea), bool), np.zeros(len(eb), bool)
    inside = over_a < len(eb)
    shut_a[inside] = eb[over_a[inside]] == ea[inside]
    shut_b[over_a[shut_a]] = True
    own = ~shut_b
    links_a = np.concatenate((np.arange(i0, i1), i0 + over_b[own]))
    links_b = np.concatenate((j0 + over_a, np.flatnonzero(own) + j0))
    return links_a, links_b, shut_a, shut_b


def merged(a_ends: np.ndarray, b_ends: np.ndarray, piece: int = PIECE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, tuple[int, int], tuple[int, int], int]]:
    """All pieces: links, the group of each A and B token, the crossings, and how many groups are closed before the piece."""
    total = len(a_ends) + len(b_ends)
    cuts = [crossing(a_ends, b_ends, d) for d in [*range(0, total, piece), total]]
    closed = 0
    for low, high in zip(cuts, cuts[1:], strict=False):
        if low == high:
            continue
        links_a, links_b, shut_a, shut_b = merge_piece(a_ends, b_ends, low, high)
        yield links_a, links_b, closed + np.cumsum(shut_a) - shut_a, closed + np.cumsum(shut_b) - shut_b, low, high, closed
        closed += int(shut_a.sum())


def _joined(ids: np.ndarray, group: np.ndarray, n: int, names: pa.Array) -> pa.Array:
    """Each group's ids, comma between."""
    offsets = np.concatenate(([0], np.cumsum(np.bincount(group, minlength=n)))).astype(np.int32)
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), names.take(pa.array(ids))), ",")


class Document:
    """What is gathered of a text, part by part."""

    def __init__(self) -> None:
        self.n_a = self.n_b = self.n_groups = self.n_links = 0
        self.digest, self.some, self.right = hashlib.sha256(), False, True
        self.pairs: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, n_a: int, n_b: int, n_groups: int, text: str | None, keys: np.ndarray, counts: np.ndarray) -> None:
        self.n_a, self.n_b, self.n_groups, self.n_links = self.n_a + n_a, self.n_b + n_b, self.n_groups + n_groups, self.n_links + int(counts.sum())
        if text is not None:
            self.digest.update((";" * self.some + text).encode())
            self.some = True
        self.pairs.append((keys, counts))
        if len(self.pairs) > 16:
            self.pairs = [self.all_pairs()]

    def all_pairs(self) -> tuple[np.ndarray, np.ndarray]:
        if len(self.pairs) == 1:
            return self.pairs[0]
        keys, at = np.unique(np.concatenate([k for k, _ in self.pairs]), return_inverse=True)
        return keys, np.bincount(at, np.concatenate([n for _, n in self.pairs]), len(keys)).astype(np.int64)


def align_parts(tok: Tokenizers, parts: list[list[str]], piece: int = PIECE) -> list[tuple]:
    """For each part (a list of stretches): whether its bytes come back, counts of tokens and groups, the groups, pairs of ids with their counts."""
    n_words = np.array(list(map(len, parts)))
    at = tok.encode([w for p in parts for w in p])
    part_of = np.repeat(np.arange(len(parts)), n_words)
    right = np.bincount(part_of, ~tok.right[at], len(parts)) == 0
    (a, a_n), (b, b_n) = (rows.take(at) for rows in tok.rows)
    keep = right[part_of]
    if not right.all():
        a, b = a[np.repeat(keep, a_n)], b[np.repeat(keep, b_n)]
        at, part_of, a_n, b_n = at[keep], part_of[keep], a_n[keep], b_n[keep]
    a_part, b_part = np.repeat(part_of, a_n), np.repeat(part_of, b_n)
    a_ends, b_ends = np.cumsum(tok.a_len[a]), np.cumsum(tok.b_len[b])
    b_bits, ab_bits = len(tok.b_bytes).bit_length(), len(tok.a_bytes).bit_length() + len(tok.b_bytes).bit_length()
    keys, counts, a_group, b_group = [], [], np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    for links_a, links_b, own_a, own_b, low, high, _ in merged(a_ends, b_ends, piece):
        k, n = np.unique((a_part[links_a].astype(np.int64) << ab_bits) | (a[links_a].astype(np.int64) << b_bits) | b[links_b], return_counts=True)
        keys.append(k)
        counts.append(n)
        a_group[low[0] : high[0]], b_group[low[1] : high[1]] = own_a, own_b
    if not keys:
        return [(bool(r), 0, 0, 0, None, np.zeros(0, np.int64), np.zeros(0, np.int64)) for r in right]
    keys, where = np.unique(np.concatenate(keys), return_inverse=True)
    counts = np.bincount(where, np.concatenate(counts), len(keys)).astype(np.int64)
    n_groups = int(a_group[-1]) + 1
    groups = pc.binary_join_element_wise(_joined(a, a_group, n_groups, tok.names), _joined(b, b_group, n_groups, tok.names), "|")
    first = np.flatnonzero(np.diff(np.concatenate(([-1], a_group))))
    per_part = np.bincount(a_part[first], minlength=len(parts))
    texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(per_part))).astype(np.int32)), groups), ";").to_pylist()
    cut = np.searchsorted(keys >> ab_bits, np.arange(len(parts) + 1))
    low_bits = (1 << ab_bits) - 1
    a_count, b_count = np.bincount(a_part, minlength=len(parts)), np.bincount(b_part, minlength=len(parts))
    return [(bool(right[k]), int(a_count[k]), int(b_count[k]), int(per_part[k]), texts[k] if right[k] and per_part[k] else None, keys[cut[k] : cut[k + 1]] & low_bits, counts[cut[k] : cut[k + 1]]) for k in range(len(parts))]


def aligned(docs: DataFrame, a_path: str, b_path: str, piece: int = PIECE) -> DataFrame:
    """row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, a, b and n: of each document its distinct linked ids with their number of links.

    Texts that are null, empty or don't come back from both tokenizers have no tokens. Repeated rows give repeated rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = load(a_path, b_path)
        row, b_bits = TaskContext.get().partitionId() << 40, len(tok.b_bytes).bit_length()
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            k = 0
            while k < len(texts):
                start, parts, owners, n = k, [], [], 0
                done: list[Document] = []
                while k < len(texts) and n < PART:
                    words = stretches(texts[k].as_py() or "")
                    done.append(Document())
                    if texts[k].as_py():
                        for w in range(0, len(words), PART):
                            if n and n + min(len(words) - w, PART) > 2 * PART:
                                _add(tok, parts, owners, piece)
                                parts, owners, n = [], [], 0
                            parts.append(words[w : w + PART])
                            owners.append(done[-1])
                            n += len(parts[-1])
                    k += 1
                _add(tok, parts, owners, piece)
                yield _table(ids.slice(start, k - start), row + start, done, b_bits)
            row += batch.num_rows
            release()

    schema = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, a array<int>, b array<int>, n array<int>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def _add(tok: Tokenizers, parts: list[list[str]], owners: list[Document], piece: int) -> None:
    if parts:
        for doc, (right, *found) in zip(owners, align_parts(tok, parts, piece), strict=True):
            doc.right &= right
            doc.add(*found)


def _table(ids: pa.Array, row: int, done: list[Document], b_bits: int) -> pa.RecordBatch:
    good = [d.right and d.some for d in done]
    pairs = [d.all_pairs() if g else (np.zeros(0, np.int64),) * 2 for d, g in zip(done, good, strict=True)]
    offsets = pa.array(np.concatenate(([0], np.cumsum([len(k) for k, _ in pairs]))).astype(np.int32))
    keys, n = (np.concatenate([p[x] for p in pairs]) for x in (0, 1))
    lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (keys >> b_bits, keys & ((1 << b_bits) - 1), n)]
    sums = [pa.array([getattr(d, c) if g else 0 for d, g in zip(done, good, strict=True)], pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")]
    sha = pa.array([d.digest.hexdigest() if g else "" for d, g in zip(done, good, strict=True)])
    return pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + len(done))), ids, *sums, sha, *lists], ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "a", "b", "n"])


def pair_counts(table: DataFrame) -> DataFrame:
    """a, b, count and best (no other A id meets this B id more often) over all documents."""
    pairs = table.selectExpr("inline(arrays_zip(a, b, n))").groupBy("a", "b").agg(F.sum("n").alias("count"))
    pairs = materialize(pairs, "token-pairs")
    most = pairs.groupBy(F.col("b").alias("own")).agg(F.max("count").alias("most"))
    return pairs.join(most, F.col("b") == F.col("own")).select("a", "b", "count", (F.col("count") == F.col("most")).alias("best"))


def align(docs: DataFrame, a_path: str, b_path: str, piece: int = PIECE, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256, and by how often their ids are linked in all documents: n_best, count_sum.

    Both vocabularies bound the pairs of ids. Up to `broadcast_pairs` of them, counted first, are broadcast; more are joined
    by a shuffle. Sums over a document's pairs are partly made before they are shuffled, so that a pair in a third of all
    documents stays where these are.
    """
    table = materialize(aligned(docs, a_path, b_path, piece), "token-links")
    counts = materialize(pair_counts(table), "token-counts")
    small = counts.count() <= broadcast_pairs
    counts = F.broadcast(counts) if small else counts.hint("shuffle_merge")
    links = table.selectExpr("row", "inline(arrays_zip(a, b, n))").join(counts, ["a", "b"])
    sums = links.groupBy("row").agg(F.sum(F.col("n") * F.col("count")).alias("count_sum"), F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"))
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")]
    return table.select("row", *names).join(sums, "row", "left").select(*names, *zero)
