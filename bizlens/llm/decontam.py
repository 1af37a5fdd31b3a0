"""Benchmark decontamination by q-gram lemma filtering.

Items and documents are normalised (lower case, one space between runs of letters and digits). An
item is searched for in windows of ``WINDOW`` characters that start every ``STEP`` characters: a passage
of ``WINDOW`` + ``STEP`` - 1 = 59 normalised characters or more (about ten words) holds a whole window, so it
is found, with up to ``EDIT_SHARE`` of the window (3) edits, as well as the whole item. Windows off the grid of ``GRID`` are aligned only where none of the item's
windows on it was found, so ``hits`` lists those on the grid, or else all found. Window and text share a q-gram at a diagonal (text place less item place); diagonals are
gathered in bands that overlap by half. An occurrence with at most e edits stays inside one
band and shares at least w + 1 - q (e + 1) q-grams there (the q-gram lemma), so only bands with
that many are verified, by a banded alignment of the window against the text.

The items are the query set: they travel to the tasks in blocks of at most ``BLOCK_CHARS``
characters, one pass over the documents per block, so no broadcast grows past that bound.

Items under ``SHORTEST`` normalised characters, for which the lemma rules out nothing, are searched for
as whole words without an edit.

Defined results: null and empty texts are clean; null items, and items without a letter or digit, hold
nothing to search for; an item with a null item_id is searched for and reported under null; equal
items are all reported; repeated rows give repeated results; an empty benchmark leaves every
document clean.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bizlens.llm.common import Hashes, drop_model, joined, lean, slices, small_batches, table

Q = 10
WINDOW = 52
STEP = 8
GRID = 40
EDIT_SHARE = 0.06
SHORTEST = 2 * Q  # from here on, w + 1 - q (e + 1) is positive for the edits allowed
BLOCK_CHARS = 8_000_000
BITMAP_BITS = 22
SLICE = 1 << 18  # bytes of text searched at a time
PLAIN = np.isin(np.arange(256), list(range(48, 58)) + list(range(97, 123)) + list(range(128, 256)))
HITS = "array<struct<item_id:long,begin:int,edits:int>>"


def normalised(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of lower-cased texts with every run of other characters as one space."""
    data, offsets = joined(pc.utf8_lower(pc.fill_null(column, "").cast(pa.large_string())))
    plain = PLAIN[data]
    keep = plain.copy()
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    if len(data):
        keep[1:] |= plain[:-1] & ~first[1:-1]  # the gap after a word
    out = np.where(plain, data, np.uint8(32))[keep]
    kept = np.concatenate([[0], np.cumsum(keep)])
    return out, kept[offsets]


@dataclass
class Index:
    """Sorted q-gram hashes of all windows of a block of items, and a bitmap of them."""

    items: list[int | None]  # item id of each window
    owners: list[int]  # place in the block of the item of each window
    extra: list[bool]  # whether a window is off the grid
    texts: list[bytes]
    hashes: np.ndarray
    window: np.ndarray
    place: np.ndarray
    bitmap: np.ndarray
    short: dict[int, dict[bytes, list[int | None]]]  # ids of the items under SHORTEST, by size and text

    @classmethod
    def of(cls, rows: list[tuple[int | None, str]]) -> Index:
        items, owners, extra, texts, short = [], [], [], [], {}
        for owner, (item, text) in enumerate(rows):
            data, _ = normalised(pa.array([text]))
            whole = data.tobytes().strip()
            if len(whole) < SHORTEST:
                if whole:
                    short.setdefault(len(whole), {}).setdefault(whole, []).append(item)
                continue
            starts = list(range(0, max(len(whole) - WINDOW, 0) + 1, STEP))
            if len(whole) > WINDOW and starts[-1] != len(whole) - WINDOW:
                starts.append(len(whole) - WINDOW)
            for start in starts:
                items.append(item)
                owners.append(owner)
                extra.append(start % GRID != 0 and start != len(whole) - WINDOW)
                texts.append(whole[start : start + WINDOW])
        hashes, window, place = [], [], []
        for i, text in enumerate(texts):
            found = Hashes(np.frombuffer(text, np.uint8)).grams(Q)
            hashes.append(found)
            window.append(np.full(len(found), i))
            place.append(np.arange(len(found)))
        if not texts:
            none = np.zeros(0, np.int64)
            return cls([], [], [], [], np.zeros(0, np.uint64), none, none, np.zeros(1 << BITMAP_BITS, bool), short)
        whole_hashes = np.concatenate(hashes)
        order = np.argsort(whole_hashes, kind="stable")
        bitmap = np.zeros(1 << BITMAP_BITS, bool)
        bitmap[whole_hashes >> np.uint64(64 - BITMAP_BITS)] = True
        return cls(
            items, owners, extra, texts, whole_hashes[order], np.concatenate(window)[order],
            np.concatenate(place)[order], bitmap, short,
        )


def budget(size: int) -> int:
    return int(EDIT_SHARE * size)


def candidates(data: np.ndarray, offsets: np.ndarray, index: Index) -> Iterator[tuple[int, int, int, int]]:
    """(row, window, first and last diagonal) of every band that the q-gram lemma cannot rule out."""
    grams = Hashes(data).grams(Q)
    if not len(grams) or not index.texts:
        return
    at = np.flatnonzero(index.bitmap[grams >> np.uint64(64 - BITMAP_BITS)])
    low = np.searchsorted(index.hashes, grams[at], "left")
    many = np.searchsorted(index.hashes, grams[at], "right") - low
    row = np.searchsorted(offsets, at, "right") - 1
    many[at + Q > offsets[row + 1]] = 0  # a q-gram across two texts
    if not many.sum():
        return
    spot = np.repeat(low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    window, place = index.window[spot], index.place[spot]
    row, at = np.repeat(row, many), np.repeat(at, many)
    # a row without enough q-grams of a window in all has no band with enough
    sizes = np.array([len(t) for t in index.texts])
    least = np.maximum(sizes + 1 - Q * ((EDIT_SHARE * sizes).astype(np.int64) + 1), 1)
    _, pair, total = np.unique(row * len(sizes) + window, return_inverse=True, return_counts=True)
    enough = total[pair] >= least[window]
    if not enough.any():
        return
    row, at, window, place = row[enough], at[enough], window[enough], place[enough]
    size = sizes[window]
    edits = (EDIT_SHARE * size).astype(np.int64)
    diagonal = at - offsets[row] - place + WINDOW  # not negative
    step = edits + 1
    row, window, place = (np.concatenate([x, x]) for x in (row, window, place))
    band = np.concatenate([diagonal // step - shift for shift in (0, 1)])
    # distinct (row, window, band, place) in that order, each as one number where it fits one
    low = int(band.min())
    spans = [int(row.max()) + 1, len(sizes), int(band.max()) - low + 1, int(place.max()) + 1]
    fits = np.prod(np.array(spans, float)) < 2.0**62
    if fits:
        key = np.unique(((row * spans[1] + window) * spans[2] + band - low) * spans[3] + place)
        group = key // spans[3]
    else:
        hits = np.unique(np.column_stack([row, window, band - low, place]), axis=0)
        change = np.any(np.diff(hits[:, :3], axis=0) != 0, axis=1)
        group = np.concatenate([[0], np.cumsum(change)])
    begin = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    count = np.diff(np.append(begin, len(group)))
    if fits:
        owner, own_band = np.divmod(group[begin], spans[2])
        own_row, own_window = np.divmod(owner, spans[1])
    else:
        own_row, own_window, own_band = hits[begin, 0], hits[begin, 1], hits[begin, 2]
    kept = count >= least[own_window]
    for r, w, band in zip(own_row[kept].tolist(), own_window[kept].tolist(), (own_band[kept] + low).tolist(), strict=True):
        e = budget(len(index.texts[w]))
        yield r, w, band * (e + 1) - WINDOW, (band + 2) * (e + 1) - 1 - WINDOW


def aligned(pattern: bytes, text: bytes, limit: int) -> tuple[int, int] | None:
    """(edits, begin) of the best occurrence of ``pattern`` in the short stretch ``text``, if it
    has at most ``limit`` edits: row-wise alignment with free ends in the text."""
    found = text.find(pattern)
    if found >= 0:
        return 0, found
    other = np.frombuffer(text, np.uint8)
    n = len(other)
    spots = np.arange(n + 1)
    cost = np.zeros(n + 1, np.int64)
    begin = spots.copy()
    for i, c in enumerate(pattern, 1):
        diag = cost[:-1] + (other != c)
        up = cost + 1
        best = up.copy()
        own = begin.copy()
        better = diag < best[1:]
        best[1:] = np.where(better, diag, best[1:])
        own[1:] = np.where(better, begin[:-1], own[1:])
        best[0], own[0] = i, 0
        # gaps along the text: the running minimum of cost less place
        slope = best - spots
        low = np.minimum.accumulate(slope)
        source = np.maximum.accumulate(np.where(slope == low, spots, 0))
        cost, begin = low + spots, own[source]
        if cost.min() > limit:
            return None
    end = int(np.argmin(cost))
    return (int(cost[end]), int(begin[end])) if cost[end] <= limit else None


def whole_words(data: np.ndarray, offsets: np.ndarray, index: Index) -> Iterator[tuple[int, int | None, int]]:
    """(row, item id, first place) of every short item that stands in a text between word borders."""
    if not index.short or not len(data):
        return
    edge = np.append(data == 32, True)
    begins = np.ones(len(data), bool)
    begins[1:] = data[:-1] == 32
    begins[offsets[:-1][offsets[:-1] < len(data)]] = True
    at = np.flatnonzero(begins & (data != 32))
    row = np.searchsorted(offsets, at, "right") - 1
    stop = offsets[row + 1]
    hashes = Hashes(data)
    for size, texts in index.short.items():
        end = at + size
        fits = end <= stop
        fits[fits] = (end[fits] == stop[fits]) | edge[end[fits]]
        spots, own = at[fits], row[fits]
        wanted = np.frombuffer(b"".join(texts), np.uint8)
        first = np.arange(len(texts)) * size
        alike = np.isin(hashes(spots, spots + size), Hashes(wanted)(first, first + size))
        seen = set()
        for r, p in zip(own[alike].tolist(), spots[alike].tolist(), strict=True):
            text = data[p : p + size].tobytes()
            if text in texts and (r, text) not in seen:
                seen.add((r, text))
                for item in texts[text]:
                    yield r, item, p - int(offsets[r])


@lean
def searched(batches: Iterator[pa.RecordBatch], index: Index) -> Iterator[pa.RecordBatch]:
    drop_model()
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("begin", pa.int32()), ("edits", pa.int32())]))
    for batch in batches:
        found: list[list[dict]] = [[] for _ in range(batch.num_rows)]
        raw = pc.fill_null(batch.column("text"), "")
        data, offsets = normalised(raw)
        for low, high in slices(offsets, SLICE):
            own = data[offsets[low] : offsets[high]]
            at = offsets[low : high + 1] - offsets[low]
            seen, held = set(), set()
            bands = sorted(candidates(own, at, index), key=lambda c: index.extra[c[1]])
            for row, window, first, last in bands:
                if (row, window) in seen or (index.extra[window] and (row, index.owners[window]) in held):
                    continue
                pattern = index.texts[window]
                limit = budget(len(pattern))
                begin = max(first - limit, 0)
                end = min(last + len(pattern) + limit + 1, int(at[row + 1] - at[row]))
                stretch = own[at[row] + begin : at[row] + end].tobytes()
                hit = aligned(pattern, stretch, limit)
                if hit:
                    seen.add((row, window))
                    if not index.extra[window]:
                        held.add((row, index.owners[window]))
                    found[low + row].append(
                        {"item_id": index.items[window], "begin": begin + hit[1], "edits": hit[0]}
                    )
            for row, item, begin in whole_words(own, at, index):
                found[low + row].append({"item_id": item, "begin": begin, "edits": 0})
        out = {n: batch.column(n) for n in batch.schema.names}
        out["hits"] = pa.array(found, kind)
        yield pa.RecordBatch.from_pydict(out)


def item_blocks(benchmark: DataFrame) -> Iterator[list[tuple[int | None, str]]]:
    """The items in blocks of about ``BLOCK_CHARS`` characters; one block may be empty."""
    items = benchmark.where(F.col("text").isNotNull())
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(1, -(-(WINDOW // STEP) * total // BLOCK_CHARS))  # the windows hold each character so often
    for part in range(parts):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).collect()
        yield sorted(((r["item_id"], r["text"]) for r in rows), key=lambda x: (x[0] is None, x[0] or 0, x[1]))


def with_hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` with a column ``hits``: the items found, where in the normalised text, with how
    many edits."""
    small_batches(docs.sparkSession)
    name = "hits"
    out = docs
    for rows in item_blocks(benchmark):
        index = Index.of(rows)
        before = out.columns
        part = out.withColumnRenamed(name, "earlier_hits") if name in before else out
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in part.schema)
        part = part.mapInArrow(lambda b, index=index: searched(b, index), f"{fields}, hits {HITS}")
        if "earlier_hits" in part.columns:
            part = part.withColumn(name, F.concat("earlier_hits", name)).drop("earlier_hits")
        out = part
    return out


def op6_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = with_hits(docs, table(spark, folder, "benchmark"))
    items = F.array_sort(F.array_distinct(F.transform("hits", lambda h: h["item_id"])))
    return found.select(
        "doc_id", (F.size("hits") > 0).alias("contaminated"), F.size(items).alias("n_items"),
        items.alias("items"), "hits",
    )


def decontamination_stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that hold no passage of a benchmark item."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    renamed = docs.toDF(*names).withColumnRenamed(names[docs.columns.index("text")], "text")
    found = with_hits(renamed, table(spark, folder, "benchmark"))
    return found.where(F.size("hits") == 0).drop("hits").toDF(*docs.columns)
