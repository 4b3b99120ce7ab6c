"""BPE encoding and decoding with the public tokenizer files (never trained here).

Encoder: an Aho-Corasick automaton over the reversed vocabulary finds the longest token that begins at each place of a
word in one pass; the encoder takes the longest one that is compatible with the token before it and steps back where none
is. Two tokens are compatible when merging their joined text by rank gives just these two: undoing merges on both sides of
the seam, no earlier merge across it may exist. This gives the same ids as merging pairs by rank, in linear time.
Decoder: one byte table holds every token's text, an offset table where it begins.
"""

from __future__ import annotations

import functools
import json
import re
import struct
import unicodedata
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import release

#: White space as the normalizer's pattern has it; it only parts pieces, so that replacing it by a space changes nothing.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PIECES = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{SPACE}\p{{L}}\p{{N}}]+")
#: The same for lower-case text whose characters all lie in the Latin blocks or the general punctuation.
SIMPLE = re.compile(r"[\x00-\x1b\x20-\u017f\u2010-\u2027\u2030-\u205e]*")
SIMPLE_PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ſ]+|[0-9²³¹¼-¾]|[^{SPACE}a-zªµºß-öø-ſ0-9²³¹¼-¾]+")
#: Bytes of a generation of words kept with their ids in each worker, and the longest word kept.
CACHE, LONGEST = 32 << 20, 64


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, extra = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in letters:
            letters[b], extra = chr(extra), extra + 1
    return [letters[b] for b in range(256)]


class Kept(dict):
    """A cache of a function's results, bounded by bytes: a full generation becomes the old one, from which what is used
    again comes back, so that frequent keys stay."""

    def __init__(self, make: Callable[[str], bytes], limit: int = CACHE):
        self.make, self.limit, self.size, self.old = make, limit, 0, {}

    def __missing__(self, key: str) -> bytes:
        if (got := self.old.get(key)) is None:
            got = self.make(key)
        if len(key) <= LONGEST:
            self.size += 190 + len(key) + len(got)
            if self.size > self.limit:
                self.old, self.size = dict(self), 0
                self.clear()
            self[key] = got
        return got


class WordBpe:
    """A byte-level BPE whose words end in a mark of their own."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, self.end = spec["model"], spec["model"]["end_of_word_suffix"] or ""
        self.specials = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.special_pattern = regex.compile("|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True)))) if self.specials else None
        letter = byte_letters()
        self.byte_of = {c: b for b, c in enumerate(letter)}
        vocab: dict[str, int] = model["vocab"]
        self.ids = {self._symbols(t): i for t, i in vocab.items()}
        # rank and halves of the merge that makes a token; base tokens have none
        self.made: dict[int, tuple[int, int, int]] = {}
        self.merge: dict[tuple[int, int], int] = {}
        for rank, (a, b) in enumerate(tuple(m) if not isinstance(m, str) else m.split(" ") for m in model["merges"]):
            pair, to = (vocab[a], vocab[b]), vocab[a + b]
            self.merge.setdefault(pair, rank)
            self.made.setdefault(to, (rank, *pair))
        self.longest = ahocorasick.Automaton()
        self.size = [0] * (max(self.ids.values(), default=0) + 1)
        for s, i in self.ids.items():
            self.longest.add_word(s[::-1], i)
            self.size[i] = len(s)
        self.longest.make_automaton()
        self.shorter = self._shorter()
        self.compatible = functools.lru_cache(maxsize=1 << 16)(self._compatible)
        table = sorted([*((i, t) for t, i in vocab.items()), *((i, t) for t, i in self.specials.items())])
        coded = [f"{t} ".encode() for _, t in table]
        n = table[-1][0] + 1
        lens = np.zeros(n, dtype=np.int64)
        lens[[i for i, _ in table]] = [len(c) for c in coded]
        self.text, self.offset = np.frombuffer(b"".join(coded), dtype=np.uint8), np.concatenate(([0], np.cumsum(lens)))
        self.words = Kept(lambda w: struct.pack(f"<{len(ids := self.encode_word(w))}I", *ids))

    def _symbols(self, token: str) -> str:
        """A token as one character per byte; the last byte of a word is moved up by 256."""
        body = token[: -len(self.end)] if self.end and token.endswith(self.end) and len(token) > len(self.end) else token
        at = [self.byte_of.get(c, 0x2000 + ord(c)) for c in body]
        if body is not token:
            at[-1] += 256
        return "".join(map(chr, at))

    def _shorter(self) -> list[int]:
        """For each token the longest token that is a proper prefix of it."""
        out = [-1] * len(self.size)
        for s, i in self.ids.items():
            out[i] = next((self.ids[s[:n]] for n in range(len(s) - 1, 0, -1) if s[:n] in self.ids), -1)
        return out

    def _compatible(self, left: int, right: int) -> bool:
        limit = 1 << 60
        while True:
            if self.merge.get((left, right), limit) < limit:
                return False
            a, b = self.made.get(left), self.made.get(right)
            if a is None and b is None:
                return True
            # undo the later of the two merges; a merge across the seam must not come before it
            if b is None or (a is not None and a[0] > b[0]):
                limit, left = a[0], a[2]
            else:
                limit, right = b[0] + 1, b[1]

    def encode_word(self, word: str) -> list[int]:
        """Ids of one pre-tokenized word. Letters that the vocabulary lacks are dropped, as the library does."""
        raw = word.encode("utf-8", "surrogatepass")
        s = raw.decode("latin-1")
        if self.end:
            s = s[:-1] + chr(raw[-1] + 256)
        if (token := self.ids.get(s)) is not None:
            return [token]
        # by distance from the end: the longest token that begins there, as the automaton reports longer ones first
        best = dict(reversed([*self.longest.iter(s[::-1])]))
        size, shorter, n = self.size, self.shorter, len(s)
        out: list[int] = []
        dead, pos, token = set(), 0, best.get(n - 1, -1)
        while pos < n:
            if token < 0:
                dead.add(pos)
                if not out:
                    return self.merged(s)
                last = out.pop()
                pos -= size[last]
                token = shorter[last]
                continue
            end = pos + size[token]
            if end not in dead and (not out or self.compatible(out[-1], token)):
                out.append(token)
                pos, token = end, best.get(n - 1 - end, -1)
            else:
                token = shorter[token]
        return out

    def merged(self, s: str) -> list[int]:
        """The same by merging pairs of least rank; for words with bytes that are no tokens, and as the tests' yardstick."""
        ids = [self.ids[c] for c in s if c in self.ids]
        while len(ids) > 1:
            rank, k = min((self.merge.get(p, 1 << 60), k) for k, p in enumerate(zip(ids, ids[1:], strict=False)))
            if rank == 1 << 60:
                break
            a, b = ids[k : k + 2]
            ids[k : k + 2] = [self.joined(a, b)]
        return ids

    def joined(self, a: int, b: int) -> int:
        rank = self.merge[(a, b)]
        if not hasattr(self, "_to"):
            self._to = {m[0]: i for i, m in self.made.items()}
        return self._to[rank]

    def _plain(self, text: str, out: list[bytes]) -> None:
        if SIMPLE.fullmatch(text):
            out.extend(map(self.words.__getitem__, SIMPLE_PIECES.findall(text.lower())))
            return
        text = unicodedata.normalize("NFC", text)
        # letter by letter: a final sigma has no form of its own here
        low = text.lower() if "Σ" not in text else "".join(c.lower() for c in text)
        out.extend(map(self.words.__getitem__, PIECES.findall(low)))

    def encode(self, text: str | None) -> bytes:
        """The ids as little-endian unsigned 32-bit integers; the special tokens' own strings give their ids."""
        out: list[bytes] = []
        if not text:
            return b""
        if self.special_pattern is None or "<|" not in text:
            self._plain(text, out)
        else:
            at = 0
            for m in self.special_pattern.finditer(text):
                self._plain(text[at : m.start()], out)
                out.append(np.array([self.specials[m[0]]], dtype="<u4").tobytes())
                at = m.end()
            self._plain(text[at:], out)
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        """The tokens' texts in UTF-8, a space between two; the file names no decoder that would join them."""
        at = np.frombuffer(ids, dtype="<u4")
        if not len(at):
            return b""
        start, lens = self.offset[at], self.offset[at + 1] - self.offset[at]
        ends = np.cumsum(lens)
        where = np.arange(ends[-1]) + np.repeat(start - (ends - lens), lens)
        return self.text[where].tobytes()[:-1]


@functools.lru_cache(maxsize=2)
def load(path: str) -> WordBpe:
    return WordBpe(path)


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit integers) and decoded (UTF-8) of every whole text.

    Null and empty texts have no ids. Repeated rows give repeated rows; other columns are not carried. `path` is read by
    each worker: the vocabulary is installed on all of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = [bpe.encode(t.as_py()) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary()), pa.array([bpe.decode(i) for i in ids], pa.binary())], ["doc_id", "ids", "decoded"])
            release()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids binary, decoded binary")
