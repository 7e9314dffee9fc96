"""Helpers that the corpus operators share."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.operators.shared import fresh_path

#: Separators between words: space and U+0009..U+000D; every other character is part of a word.
SEPARATOR = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

#: Ids that a hash join may broadcast (8 bytes each, about 64 MB as a hash relation); above it, a shuffle join.
BROADCAST_IDS = 2_000_000


#: Rows of an Arrow batch, which the JVM and the worker both hold.
BATCH_ROWS = 2000
_ROWS_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


#: A fresh path in the folder that the cluster shares (``spark.checkpoint.dir``).
scratch = fresh_path


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: the lineage ends there."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once per application, as ``--py-files`` would.

    Rows hold whole texts, so Arrow batches get fewer rows than Spark's default.  That is a setting of the session, which
    has no other way to say it: where it holds the default of 10,000, it is set to ``BATCH_ROWS`` and stays so.
    """
    if spark.conf.get(_ROWS_KEY) == "10000":
        spark.conf.set(_ROWS_KEY, str(BATCH_ROWS))
    if getattr(spark.sparkContext, "_marginalia_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="spark-")) / f"{package.name}.zip"
    with zipfile.ZipFile(target, "w") as z:
        for path in sorted(package.rglob("*.py")):
            z.write(path, str(path.relative_to(package.parent)))
    spark.sparkContext.addPyFile(os.fspath(target))
    spark.sparkContext._marginalia_shipped = True


def with_ids(df: DataFrame, ids: DataFrame, column: str, how: str) -> DataFrame:
    """Semi or anti join on one id column; broadcasts ``ids`` only if they are few enough."""
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return df.join(F.broadcast(ids) if few else ids, column, how)


def if_small(df: DataFrame, rows: int = 500_000) -> DataFrame:
    """``df`` (of a few short columns, staged) to be broadcast if it has few rows; else as it is, for a shuffle join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def words(text: Column) -> Column:
    """The words of a text (null: none), as an array, without Python."""
    text = F.coalesce(text, F.lit(""))
    for c in "\t\n\x0b\x0c\r":
        text = F.replace(text, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(text, " "), "")  # a pattern of one character needs no regular expression


def chunks(batches: Iterable[pa.RecordBatch], column: str, max_bytes: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches into runs of rows whose texts hold about ``max_bytes`` (one row at least).

    Numpy work on a run takes some hundred times its bytes for a moment, so the run bounds a worker's memory.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = size[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(size, before + max_bytes, side="right")))
            yield batch.slice(start, end - start)
            start = end


def gathered(batches: Iterable[pa.RecordBatch], column: str, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """Joins Arrow batches until their texts hold about ``max_bytes``."""
    kept, size = [], 0
    for batch in batches:
        if batch.num_rows:
            kept.append(batch)
            size += pc.sum(pc.binary_length(batch.column(column))).as_py() or 0
        if size >= max_bytes:
            yield pa.Table.from_batches(kept).combine_chunks().to_batches()[0]
            kept, size = [], 0
    if kept:
        yield pa.Table.from_batches(kept).combine_chunks().to_batches()[0]


class Remembered(dict):
    """A worker's memory of short keys, bounded by bytes: once full, it starts afresh when asked for ``room``."""

    BYTES, ENTRY = 1 << 25, 400  # an entry's objects, about, beside eight bytes for each character of its key

    held = 0

    def __setitem__(self, key: str, value: object) -> None:
        self.held += self.ENTRY + 8 * len(key)
        super().__setitem__(key, value)

    def room(self) -> None:
        if self.held > self.BYTES:
            self.clear()
            self.held = 0


class Generations(Remembered):
    """A memory of two generations: a full one becomes the older, and what is met again moves to the newer.

    So words that come often stay, however many come once.
    """

    BYTES = 1 << 26  # of a generation

    def __init__(self) -> None:
        self.older: dict = {}

    def room(self) -> None:
        if self.held > self.BYTES:
            self.older = dict(self)
        super().room()

    def unknown(self, keys: set) -> list:
        """The keys that neither generation holds."""
        new, older = [], self.older
        for key in keys:  # set operations with a dict of another class would go through all of it
            if key not in self:
                if key in older:
                    self[key] = older.pop(key)
                else:
                    new.append(key)
        return new


def keep_memory() -> None:
    """Freed arrays of up to some megabytes stay with the process, to be used again.

    The C library gives freed memory back to the system when it is large against the largest block freed so far, and
    each new page costs a fault; once it has freed a block of 30 MB, it keeps up to 60 MB.
    """
    np.empty(30 << 20, np.uint8)


def texts_of(batch: pa.RecordBatch, column: str) -> list[str]:
    return [x or "" for x in batch.column(column).to_pylist()]


def word_hashes(texts: list[str], lower_ascii: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of a batch, and the number of words of each text.

    A polynomial in an odd base modulo 2**64 over the UTF-8 bytes, from prefix sums, so that a whole
    batch takes a fixed number of numpy passes; a finaliser then mixes it with the word's length.
    """
    data = [t.encode("utf-8", "surrogatepass") for t in texts]
    joined = b" ".join(data) + b" "
    raw = np.frombuffer(joined, np.uint8)
    if lower_ascii:
        raw = np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint8)
    gap = (raw == 32) | ((raw >= 9) & (raw <= 13))
    inside = np.concatenate(([False], ~gap))
    starts = np.flatnonzero(inside[1:] & ~inside[:-1])
    ends = np.flatnonzero(~inside[1:] & inside[:-1])
    base, inverse = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
    powers = _powers(base, len(raw) + 1)
    prefix = np.concatenate((np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers[: len(raw)], dtype=np.uint64)))
    back = _powers(inverse, len(raw) + 1)
    hashes = (prefix[ends] - prefix[starts]) * back[starts] + (ends - starts).astype(np.uint64)
    bounds = np.cumsum([len(d) + 1 for d in data])
    counts = np.diff(np.concatenate(([0], np.searchsorted(starts, bounds, side="left"))))
    return mix(hashes), counts


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; the longest table so far stays in the worker if it is modest (8 MB)."""
    known = _POWERS.get(int(base))
    if known is None or len(known) < n:
        known = np.ones(n, np.uint64)
        known[1:] = base
        known = np.cumprod(known, dtype=np.uint64)
        if n <= 1 << 20:
            _POWERS[int(base)] = known
    return known[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit integers (shifts and odd multipliers)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))
