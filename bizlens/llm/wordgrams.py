"""Words and word n-grams of Arrow text columns as fingerprints, and the exchange of fingerprints
between tasks as packed arrays in place of one row each."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bizlens.llm.common import BASE, INVERSE, Hashes, joined, mixed, powers, runs, slices

TEXT_BYTES = 4 << 20
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32  # A-Z
BLOOM_BITS = 26


class Words:
    """The words of some rows: row, exact word number and fingerprint of each. ``breaks`` marks the
    bytes between words; ``ends`` those among them that no n-gram may cross."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray, ends: np.ndarray):
        low = LOWER[data]
        outside = breaks[low]
        begin, end, self.row = runs(~outside, offsets)
        size = end - begin
        at = np.concatenate([[0], np.cumsum(size)])
        packed = low[~outside]
        column = pa.LargeStringArray.from_buffers(
            len(size), pa.py_buffer(at.astype(np.int64)), pa.py_buffer(packed)
        ).dictionary_encode()
        self.word = column.indices.to_numpy(zero_copy_only=False)
        self.names = column.dictionary
        letters, cut = joined(self.names)
        value = Hashes(letters)(cut[:-1], cut[1:]) if len(cut) > 1 else np.zeros(0, np.uint64)
        self.value = value[self.word]
        # words of one piece share a number; a piece ends with its row or at a byte of ``ends``
        stops = np.concatenate([[0], np.cumsum(ends[low])])
        self.piece = self.row + stops[begin]
        self.sums = np.zeros(len(size) + 1, np.uint64)
        np.cumsum(self.value * powers(BASE, len(size)), dtype=np.uint64, out=self.sums[1:])

    def grams(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and fingerprint of every n-gram inside a piece: the difference of two prefix
        polynomials, shifted back to the first word."""
        count = max(len(self.word) - size + 1, 0)
        first = np.flatnonzero(self.piece[:count] == self.piece[size - 1 :]) if count else np.zeros(0, np.int64)
        raw = (self.sums[first + size] - self.sums[first]) * powers(INVERSE, len(self.word) + 1)[first]
        return first, mixed(raw + np.uint64(size))


def byte_set(text: str) -> np.ndarray:
    found = np.zeros(256, bool)
    found[list(text.encode())] = True
    return found


def text_slices(batch: pa.RecordBatch, limit: int = TEXT_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows low to high of a batch with their bytes and offsets, about ``limit`` bytes at a time."""
    data, offsets = joined(batch.column("text"))
    for low, high in slices(offsets, limit):
        yield low, high, data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]


def part_of(found: np.ndarray, parts: int) -> np.ndarray:
    """The part of a fingerprint: its high half, scaled."""
    return (((found >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int32)


def summed_up(found: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct fingerprints, sorted, with the sums of their counts."""
    if not len(found):
        return found, count
    order = np.argsort(found, kind="stable")
    found = found[order]
    first = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]]))
    return found[first], np.add.reduceat(count[order], first)


# --- a Bloom filter of fixed size


def bloom_places(found: np.ndarray, bits: int = BLOOM_BITS) -> tuple[np.ndarray, np.ndarray]:
    shift = np.uint64(64 - bits)
    return found >> shift, mixed(found) >> shift


def bloom_of(frame: DataFrame, column: str, bits: int = BLOOM_BITS) -> np.ndarray:
    """The bitmap of the fingerprints in ``column``: 2**bits bits, whatever their number. Only its
    64-bit words reach the driver, at most 2**(bits-6) of them."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            place = np.unique(np.concatenate(bloom_places(found, bits)))
            bit = (np.uint64(1) << (place & np.uint64(63))).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array((place >> np.uint64(6)).astype(np.int32)), pa.array(bit)], names=["place", "bit"]
            )

    rows = (
        frame.select(column).mapInArrow(places, "place int, bit long")
        .groupBy("place").agg(F.bit_or("bit").alias("bits")).toArrow()
    )
    words = np.zeros(1 << (bits - 6), np.uint64)
    words[rows.column("place").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return words


def in_bloom(words: np.ndarray, found: np.ndarray, bits: int = BLOOM_BITS) -> np.ndarray:
    hit = np.ones(len(found), bool)
    for place in bloom_places(found, bits):
        hit &= (words[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1
    return hit


# --- counted fingerprints, packed


COUNTED = "part int, found binary, counts binary"


def packed_counts(found: np.ndarray, count: np.ndarray, parts: int) -> Iterator[pa.RecordBatch]:
    """Sorted fingerprints and their counts as one row per part."""
    cut = np.searchsorted(part_of(found, parts), np.arange(parts + 1))
    full = np.flatnonzero(np.diff(cut))
    yield pa.RecordBatch.from_pydict(
        {
            "part": pa.array(full, pa.int32()),
            "found": pa.array([found[cut[p] : cut[p + 1]].tobytes() for p in full], pa.binary()),
            "counts": pa.array([count[cut[p] : cut[p + 1]].astype(np.uint32).tobytes() for p in full], pa.binary()),
        }
    )


def merged_counts(least: int):
    """For ``applyInPandas`` on a part: fingerprints whose counts sum to ``least`` or more."""

    def merged(rows: pd.DataFrame) -> pd.DataFrame:
        found = np.concatenate([np.frombuffer(x, np.uint64) for x in rows["found"]])
        count = np.concatenate([np.frombuffer(x, np.uint32) for x in rows["counts"]]).astype(np.int64)
        found, count = summed_up(found, count)
        kept = count >= least
        return pd.DataFrame({"found": found[kept].view(np.int64), "n": count[kept]})

    return merged
