"""Shared helpers: tables, scratch tables, and texts as numpy byte arrays inside Arrow batches."""

from __future__ import annotations

import ctypes
import functools
import inspect
import sys
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bizlens.session import scratch_path

SLICE_BYTES = 1 << 20
POWERS = (1 << 18) + 4096
BATCH_ROWS = 1000
BATCH_BYTES = 4 << 20
PAGE_ROWS = 8
BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64
INVERSE = pow(BASE, -1, 1 << 64)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def sheltered(docs: DataFrame, own: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """``docs`` with all columns but ``own`` named after their place, so that none can clash with an
    operator's columns, whatever its name or case; and these names in order."""
    names = [c if c in own else f"_c{i}" for i, c in enumerate(docs.columns)]
    return docs.toDF(*names), names


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most 1,000 rows and about ``BATCH_BYTES``, so that a worker holds a few
    megabytes at a time, be the rows texts or blocks of them."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def settled(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a written table in the shared folder: a fixed version that a lost executor
    only makes Spark re-read. Parquet looks at the size of a page every ``PAGE_ROWS`` rows at first (100
    by default), so that rows of a whole block each do not make pages of many megabytes."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("parquet.page.size.row.check.min", PAGE_ROWS).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fold(key: str, parts: int) -> Column:
    """crc32 of the key as text, modulo ``parts``; a null key counts as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % parts


def process_cache() -> dict:
    """One dict per Python worker process, kept between tasks."""
    return sys.__dict__.setdefault("_llm_cache", {})


def held_model(key: object, build: Callable[[], object]) -> object:
    """The one large model that a worker process keeps; the last one goes before the next is built."""
    kept = process_cache()
    if kept.get("model_key") != key:
        kept.pop("model", None)
        kept["model"], kept["model_key"] = build(), key
    return kept["model"]


def drop_model() -> None:
    """For work that needs no model: the one of an earlier stage goes."""
    kept = process_cache()
    kept.pop("model", None)
    kept.pop("model_key", None)


def give_back() -> None:
    """Memory that was freed goes back to the system; worker processes live on between tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only glibc has it
    if trim is not None:
        trim(0)


def lean(work: Callable) -> Callable:
    """``work`` on batches, or on a key and its rows, giving back at its end what it has freed."""

    if inspect.isgeneratorfunction(work):

        @functools.wraps(work)
        def run(*args, **named):
            try:
                yield from work(*args, **named)
            finally:
                give_back()
    else:

        @functools.wraps(work)
        def run(key, rows):  # Spark counts the arguments
            try:
                return work(key, rows)
            finally:
                give_back()

    return run


def joined(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, one after the other, and the n + 1 offsets; null is empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``limit`` bytes; a longer text is a run of its own."""
    low, rows = 0, len(offsets) - 1
    while low < rows:
        high = int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1
        high = min(max(high, low + 1), rows)
        yield low, high
        low = high


def byte_values(table: int = 0) -> np.ndarray:
    """A fixed pseudo-random 64-bit value for each byte (splitmix64 of 1..256, then 257..512, ...)."""
    own = np.arange(1, 257, dtype=np.uint64) + np.uint64(256 * table)
    return mixed(own * np.uint64(0xD1B54A32D192ED03))


def mixed(h: np.ndarray) -> np.ndarray:
    """The finisher of splitmix64: spreads every bit over the word."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0..n-1 modulo 2**64, kept per process and grown by need."""
    kept = process_cache().setdefault("powers", {})
    if base not in kept or len(kept[base]) < n:
        size = max(POWERS, n + n // 8)
        kept[base] = np.concatenate(
            [np.ones(1, np.uint64), np.cumprod(np.full(size, base, np.uint64), dtype=np.uint64)]
        )
    return kept[base][:n]


class Hashes:
    """64-bit hashes of any substrings of a byte array, from one pass of prefix sums; another
    ``table`` of byte values makes hashes independent of those of the first."""

    def __init__(self, data: np.ndarray, table: int = 0):
        n = len(data)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(byte_values(table)[data] * powers(BASE, n), dtype=np.uint64, out=self.sums[1:])
        self.inverse = powers(INVERSE, n + 1)

    def __call__(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        raw = (self.sums[end] - self.sums[begin]) * self.inverse[begin]
        return mixed(raw + (end - begin).astype(np.uint64))

    def grams(self, size: int) -> np.ndarray:
        """The hash of the ``size`` bytes from every position that has as many."""
        n = len(self.sums) - size
        if n <= 0:
            return np.zeros(0, np.uint64)
        return mixed((self.sums[size:] - self.sums[:n]) * self.inverse[:n])


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and row of every maximal run of marked bytes; runs end with their row."""
    n = len(inside)
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    begin, last = inside.copy(), inside.copy()
    if n:
        begin[1:] &= ~inside[:-1] | first[1:n]
        last[:-1] &= ~inside[1:] | first[1:n]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(offsets, starts, "right") - 1


def row_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of ``values`` (one per byte) by row."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.float64)])
    return total[offsets[1:]] - total[offsets[:-1]]
