"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; where the session names none, one of this machine's in local mode alone."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return os.path.join(tempfile.gettempdir(), f"tandem-{spark.sparkContext.applicationId}")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes df to the shared folder and reads it again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(written: DataFrame) -> None:
    """Deletes a table that `materialize` wrote and that nothing will read again."""
    spark = written.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(written.written_to)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release() -> None:
    """Gives memory that a Python worker has freed back to the system; workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only some C libraries have it
        ctypes.CDLL(None).malloc_trim(0)


def n_words(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def held(doc_id: Column, modulus: int, rest: int) -> Column:
    """True where crc32 of the id as text leaves this rest; a null id counts as never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % modulus == rest, F.lit(False))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_R = np.uint64(0x9E3779B97F4A7C15)
_POW = np.ones(1, dtype=np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit integers."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _powers(n: int) -> np.ndarray:
    global _POW
    if len(_POW) < n:
        with np.errstate(over="ignore"):
            _POW = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(n, 4096) * 2, _R)]), dtype=np.uint64)
    return _POW


def chunks(texts: list[str | None], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about `most` characters together, one text at least: what is worked on at once."""
    start, size = 0, 0
    for k, t in enumerate(texts):
        n = len(t or "")
        if k > start and size + n > most:
            yield start, k
            start, size = k, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the ASCII-lower-cased words of all texts, one after the other, and the texts' offsets in them.

    The hash of a word depends on its bytes alone. A null text has no words.
    """
    blobs = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
    raw = np.frombuffer(b" ".join(blobs) + b" ", dtype=np.uint8)
    ends_of = np.cumsum(np.array([len(b) + 1 for b in blobs], dtype=np.int64))
    low, gap = _LOWER[raw], _SPACE[raw]
    edge = np.diff(np.concatenate(([True], gap)).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    lens = ends - starts
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(blobs) + 1, np.int64)
    # the sum over a word of byte x power, the power restarting in each word
    inside = ~gap
    pos = np.flatnonzero(inside).astype(np.int32)
    pos -= np.repeat(starts.astype(np.int32), lens)
    terms = _powers(int(lens.max()) + 1)[pos]
    del pos
    terms *= low[inside].astype(np.uint64) + np.uint64(1)
    begin = np.concatenate(([0], np.cumsum(lens)[:-1]))
    sums = np.add.reduceat(terms, begin)
    hashes = mix64(sums + lens.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
    return hashes, np.concatenate(([0], np.searchsorted(starts, ends_of))).astype(np.int64)
