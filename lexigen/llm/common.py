"""Small helpers the operators share: word splitting, hashing, Arrow columns."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The ASCII white space that separates words and is stripped from lines.
BLANKS = " \t\n\x0b\x0c\r"
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: What str.split() would also cut at, beyond BLANKS.
_OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_UPPER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def words(text: str) -> list[str]:
    """Maximal runs of anything but ASCII white space."""
    return _WORD.findall(text) if _OTHER_SPACE.search(text) else text.split()


def lower_ascii(text: str) -> str:
    """A-Z lower-cased, every other character as it is."""
    return text.lower() if text.isascii() else text.translate(_UPPER)


class HashOf(dict):
    """word -> 64-bit hash, remembered; emptied when it holds ``limit`` words, so
    its memory is bounded whatever the vocabulary."""

    def __init__(self, limit: int = 300_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        if len(word) <= 64:
            self[word] = h
        return h


_HELD: dict[tuple, object] = {}


def _trim() -> None:
    """Give freed memory back to the system, where the C library can."""
    gc.collect()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def held(key: tuple, make=None):
    """What a Python worker keeps between tasks: one thing at a time, so that the tables of
    one operator do not stay in memory beside those of the next. Without ``make``, nothing."""
    if key not in _HELD:
        if _HELD:
            _HELD.clear()
            _trim()
        if make is None:
            return None
        _HELD[key] = make()
    return _HELD[key]


#: Rows hold whole documents, so fewer of them than Spark's default go to Python at a time.
BATCH_ROWS = 1000


def text_batches(spark: SparkSession) -> None:
    """Arrow batches of at most ``BATCH_ROWS`` rows in this session."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93)]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over all others."""
    x = x ^ (x >> np.uint64(32))
    x = x * _ODD[4]
    x = x ^ (x >> np.uint64(32))
    x = x * _ODD[4]
    return x ^ (x >> np.uint64(32))


def window_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of all windows of ``n`` (at most 5) consecutive word hashes; of
    the whole sequence when it is shorter; none for an empty one."""
    n = min(n, len(hashes))
    if not n:
        return hashes
    m = len(hashes) - n + 1
    out = hashes[:m] * _ODD[0]
    for k in range(1, n):
        out = (out ^ (out >> np.uint64(29))) * _ODD[3] + hashes[k : k + m] * _ODD[k]
    return mix64(out)


def texts_of(batch: pa.RecordBatch, name: str) -> list[str]:
    """A text column as Python strings, null as empty."""
    return [t or "" for t in batch.column(name).to_pylist()]


def free_name(df: DataFrame, name: str) -> str:
    """A column name the table does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def without(df: DataFrame, *names: str) -> DataFrame:
    """The input without columns that new ones would clash with: the new one replaces them."""
    taken = {n.lower() for n in names}
    return df.select(*(F.col(f"`{c}`") for c in df.columns if c.lower() not in taken))


def with_columns(batch: pa.RecordBatch, keep: list[str], **new: pa.Array) -> pa.RecordBatch:
    """The kept columns of a batch and new ones."""
    return pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), *new.values()], names=[*keep, *new])


#: Bytes of a table handed to every task at most; beyond it Spark joins by a shuffle.
BROADCAST_BYTES = 32 << 20


def handed_out(df: DataFrame) -> DataFrame:
    """A narrow table, marked to go to every task if it is measured to be small: 32 bytes a row and cell, and the
    length of its texts and digests."""
    cells = [F.lit(32) + (F.coalesce(F.octet_length(f.name), F.lit(0)) if f.dataType.simpleString() in ("string", "binary") else 0) for f in df.schema]
    size = df.agg(F.sum(sum(cells[1:], cells[0]).cast("long"))).first()[0] or 0
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def by_ids(df: DataFrame, ids: DataFrame, on: str, how: str) -> DataFrame:
    """Semi or anti join of wide rows with a table of distinct ids. A small one goes to every task,
    so the wide rows stay where they are."""
    return df.join(handed_out(ids), on, how)
