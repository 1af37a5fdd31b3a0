"""Near-duplicate classes by improved consistent weighted sampling.

A document is the weighted set of its shingles of ``SHINGLE`` words (a shorter text is one shingle).
A weight is sublinear term frequency times a smoothed inverse document frequency over all
documents; frequencies are counted in a hashed table of fixed size, so the table that travels to
the tasks never grows. Consistent weighted samples (Ioffe) are cut into ``BANDS`` bands; texts
that share a band meet in a bucket, and weighted Jaccard similarity of the whole sets decides.

No bucket is expanded into all its pairs. First every text is compared with the best-connected text
of its buckets only. What that links is one component; afterwards a bucket matters only if it holds several
components. There a text's similarity is bounded by the weight it shares with any other text of
such buckets (``with_room``); pairs that the bound rules out are never made. The rest is worked off
round by round: texts outside a bucket's largest component are compared, as pivots, with the members
of other components, more pivots each round, until no untested pair of different components is
left. So no link between different classes is lost.

Equal texts are one node from the start (64-bit hash). Defined results: null and empty texts and
rows with a null doc_id are classes of their own; a text without words is the shingle of its bytes;
rows equal in doc_id and text are one document; a class is named by its smallest doc_id.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bizlens.llm.common import (
    Hashes,
    drop_model,
    held_model,
    joined,
    lean,
    mixed,
    runs,
    settled,
    sheltered,
    slices,
    small_batches,
    table,
)

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 16
ROWS = 4
IDF_SHARE = 0.1  # how far a unique shingle outweighs one that every document has
DF_BITS = 18
DF_PARTS = 64
POOL_BITS = 16
GRID = 16  # weight levels per unit of the natural logarithm
LEVELS = 64
PIVOTS = 64
MARK_LONGS = 32
SLICE = 1 << 18  # bytes of text worked on at a time
MEMBER = ["node", "weight", "room", "marks"]
PLAIN = np.isin(np.arange(256), list(range(48, 58)) + list(range(97, 123)) + list(range(128, 256)))


def lowered(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return joined(pc.utf8_lower(pc.fill_null(column, "").cast(pa.large_string())))


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every row, in order of row and hash, with row and frequency."""
    begin, end, row = runs(PLAIN[data], offsets)
    hashes = Hashes(data)
    word = hashes(begin, end)
    n = len(offsets) - 1
    many = np.bincount(row, minlength=n)
    m = max(len(word) - SHINGLE + 1, 0)
    shingle = np.zeros(m, np.uint64)
    for k in range(SHINGLE):
        shingle = mixed(shingle + word[k : m + k])
    whole = np.flatnonzero(row[:m] == row[SHINGLE - 1 :]) if m else np.zeros(0, np.int64)
    short = np.flatnonzero((many < SHINGLE) & (offsets[1:] > offsets[:-1]))
    last = np.cumsum(many)
    alone = np.array(
        [
            np.bitwise_xor.reduce(mixed(word[last[r] - many[r] : last[r]] + np.arange(many[r], dtype=np.uint64)))
            if many[r]
            else hashes(offsets[r : r + 1], offsets[r + 1 : r + 2])[0]
            for r in short.tolist()
        ],
        np.uint64,
    )
    found = np.concatenate([shingle[whole], alone])
    rows = np.concatenate([row[whole], short])
    order = np.lexsort((found, rows))
    found, rows = found[order], rows[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (rows[1:] != rows[:-1])
    first = np.flatnonzero(new)
    return found[first], rows[first], np.diff(np.append(first, len(found)))


# --- document frequencies, hashed


@lean
def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many documents of the partition hold a shingle of each slot, in ``DF_PARTS`` rows."""
    drop_model()
    total, docs = np.zeros(1 << DF_BITS, np.int64), 0
    for batch in batches:
        data, offsets = lowered(batch.column("text"))
        docs += batch.num_rows
        for low, high in slices(offsets, SLICE):
            own = data[offsets[low] : offsets[high]]
            found, _, _ = shingles(own, offsets[low : high + 1] - offsets[low])
            total += np.bincount(found >> np.uint64(64 - DF_BITS), minlength=len(total))
    if docs:
        parts = total.astype(np.int32).reshape(DF_PARTS, -1)
        yield pa.RecordBatch.from_pydict(
            {
                "part": pa.array(range(DF_PARTS), pa.int32()),
                "docs": pa.array([docs] * DF_PARTS, pa.int64()),
                "counts": pa.array([p.tobytes() for p in parts], pa.binary()),
            }
        )


def summed(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(x, np.int32).astype(np.int64) for x in rows["counts"])
    return pd.DataFrame({"part": [key[0]], "docs": [rows["docs"].sum()], "counts": [total.tobytes()]})


def idf_table(texts: DataFrame) -> np.ndarray:
    """Smoothed idf of every slot, between 1 and 1 + ``IDF_SHARE``; 2**DF_BITS numbers."""
    rows = (
        texts.mapInArrow(frequencies, "part int, docs long, counts binary")
        .groupBy("part").applyInPandas(summed, "part int, docs long, counts binary")
        .orderBy("part").collect()
    )
    if not rows:
        return np.ones(1 << DF_BITS, np.float32)
    count = np.concatenate([np.frombuffer(r["counts"], np.int64) for r in rows])
    docs = rows[0]["docs"]
    return (1 + IDF_SHARE * np.log((docs + 1) / (np.minimum(count, docs) + 1)) / np.log(docs + 1)).astype(np.float32)


def levels(found: np.ndarray, times: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """The weight of every shingle as a level: its logarithm on a grid."""
    weight = (1 + np.log(times)) * idf[found >> np.uint64(64 - DF_BITS)]
    return np.minimum(np.round(GRID * np.log(weight)), LEVELS - 1).astype(np.int64)


# --- consistent weighted sampling


def ranks() -> np.ndarray:
    """For each weight level and each entry of a fixed pool of (r, c, beta): the rank of ln a.
    Equal (entry, t) have equal ranks, as the sampling needs."""
    return held_model("sampling", drawn)


def drawn() -> np.ndarray:
    rng = np.random.default_rng(20240229)
    size = 1 << POOL_BITS
    r, c = rng.gamma(2.0, 1.0, size), rng.gamma(2.0, 1.0, size)
    beta = rng.random(size)
    # level by level, and ranks from one sorted copy: a worker never holds more than three such tables
    log_a = np.empty((LEVELS, size))
    for level, own in enumerate(log_a):
        t = np.floor(level / GRID / r + beta)
        own[:] = np.log(c) - r * (t - beta) - r
    values = np.sort(log_a, axis=None)
    values = values[np.append(True, values[1:] != values[:-1])]
    rank = np.empty(log_a.shape, np.uint32)
    for level, own in enumerate(log_a):
        rank[level] = np.searchsorted(values, own)
    return rank.reshape(-1)


def factors() -> np.ndarray:
    """One odd multiplier per sample."""
    return mixed(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)


def bands(found: np.ndarray, level: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The band hashes (rows by ``BANDS``) of the rows that begin at ``first``."""
    pool = ranks()
    base = level << POOL_BITS
    low = found & np.uint64(0xFFFFFFFF)
    out = np.zeros((len(first), BANDS), np.uint64)
    for k, factor in enumerate(factors()):
        entry = ((found * factor) >> np.uint64(64 - POOL_BITS)).astype(np.int64)
        rank = pool[base + entry].astype(np.uint64) << np.uint64(32)  # decides, before the shingle
        sample = np.minimum.reduceat(rank | low, first)
        band = k // ROWS
        out[:, band] = mixed(out[:, band] + sample + np.uint64(k))
    return out


@lean
def signed(batches: Iterator[pa.RecordBatch], idf: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = lowered(batch.column("text"))
        for low, high in slices(offsets, SLICE):
            own = data[offsets[low] : offsets[high]]
            found, row, times = shingles(own, offsets[low : high + 1] - offsets[low])
            level = levels(found, times, idf)
            first = np.searchsorted(row, np.arange(high - low))  # every row has a shingle
            weight = np.add.reduceat(np.exp(level / GRID), first)
            hashes = bands(found, level, first).view(np.int64)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id").slice(low, high - low),
                    "node": batch.column("node").slice(low, high - low),
                    "weight": pa.array(weight, pa.float32()),
                    "bands": pa.array(list(hashes), pa.list_(pa.int64())),
                }
            )


@lean
def set_rows(batches: Iterator[pa.RecordBatch], idf: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The shingles of a node as sorted 32-bit hashes and their levels, and their bitmap."""
    drop_model()
    for batch in batches:
        data, offsets = lowered(batch.column("text"))
        for low, high in slices(offsets, SLICE):
            own = data[offsets[low] : offsets[high]]
            found, row, times = shingles(own, offsets[low : high + 1] - offsets[low])
            level = levels(found, times, idf).astype(np.uint8)
            high_half = (found >> np.uint64(32)).astype(np.uint32)
            cut = np.searchsorted(row, np.arange(high - low + 1))
            blobs = [
                high_half[cut[i] : cut[i + 1]].tobytes() + level[cut[i] : cut[i + 1]].tobytes()
                for i in range(high - low)
            ]
            maps = []
            for i in range(high - low):
                bits = np.zeros(64 * MARK_LONGS, np.uint8)
                bits[high_half[cut[i] : cut[i + 1]] % len(bits)] = 1
                maps.append(np.packbits(bits).view(np.int64))
            yield pa.RecordBatch.from_pydict(
                {
                    "node": batch.column("node").slice(low, high - low),
                    "shingles": pa.array(blobs, pa.binary()),
                    "marks": pa.array(maps, pa.list_(pa.int64())),
                }
            )


def unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(blob) // 5
    return np.frombuffer(blob, "<u4", n), np.exp(np.frombuffer(blob, np.uint8, n, 4 * n) / GRID)


def similarity(one: bytes, two: bytes) -> float:
    """Weighted Jaccard similarity: sum of minima over sum of maxima."""
    (a, wa), (b, wb) = unpacked(one), unpacked(two)
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    same = b[at] == a
    both = float(np.minimum(wa[same], wb[at[same]]).sum())
    return both / (float(wa.sum()) + float(wb.sum()) - both)


@lean
def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        value = [
            similarity(a, b)
            for a, b in zip(batch.column("one").to_pylist(), batch.column("two").to_pylist(), strict=True)
        ]
        yield pa.RecordBatch.from_pydict(
            {"u": batch.column("u"), "v": batch.column("v"), "similarity": pa.array(value, pa.float64())}
        )


# --- components


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, component): the smallest node that each node is linked to, by rounds of taking the
    neighbours' smallest label and then that label's own label."""
    both = settled(
        edges.select(F.col(u).alias("a"), F.col(v).alias("b"))
        .union(edges.select(F.col(v).alias("a"), F.col(u).alias("b")))
        .distinct(),
        "links",
    )
    labels = both.groupBy("a").agg(F.min("b").alias("m")).select(
        F.col("a").alias("node"), F.least("a", "m").alias("component")
    )
    labels = settled(labels, "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "component"), "b")
        near = near.groupBy("a").agg(F.min("component").alias("least")).withColumnRenamed("a", "node")
        step = labels.join(near, "node").select(
            "node", F.col("component").alias("before"), F.least("component", "least").alias("target")
        )
        own = labels.select(F.col("node").alias("target"), F.col("component").alias("jump"))
        after = settled(
            step.join(own, "target", "left").select(
                "node", "before", F.least("target", F.coalesce("jump", "target")).alias("component")
            ),
            "labels",
        )
        labels = after.select("node", "component")
        if after.where("before <> component").isEmpty():
            return labels


def by_content() -> Column:
    return F.xxhash64("text")


def with_text(docs: DataFrame) -> DataFrame:
    has = F.col("doc_id").isNotNull() & (F.length("text") > 0)
    part = docs.where(has).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return part.withColumn("node", by_content())


def classes(docs: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """(doc_id, node, component) of every row that has an id and a text."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = with_text(docs)
    idf = idf_table(texts.select("text"))
    held = spark.sparkContext.broadcast(idf)  # 2**DF_BITS numbers, whatever the corpus
    signs = settled(
        texts.mapInArrow(
            lambda b: signed(b, held.value), "doc_id long, node long, weight float, bands array<long>"
        ),
        "signatures",
    )
    members = buckets(signs)
    # one edge per text: to the best-connected text of any of its buckets
    centre = F.struct("degree", "node")
    centres = settled(members.groupBy("bucket").agg(F.max(centre).alias("centre")), "centres")
    first = (
        members.join(centres, "bucket").groupBy("node").agg(F.max("centre").alias("best"))
        .select(F.greatest("node", "best.node").alias("u"), F.least("node", "best.node").alias("v"))
        .where("u <> v").distinct()
    )
    needed = members.select("node").distinct()
    contents = texts.groupBy("node").agg(F.first("text").alias("text"))
    # the texts that share a bucket grow with the corpus: they are not to be broadcast at any size
    sets = settled(
        contents.join(needed.hint("merge"), "node", "left_semi").mapInArrow(
            lambda b: set_rows(b, held.value), "node long, shingles binary, marks array<long>"
        ),
        "shingle-sets",
    )
    tested = settled(compared(first.select("u", "v"), sets), "similarities")
    links = tested.where(F.col("similarity") >= threshold).select("u", "v")
    labels = components(links)
    done = spark.createDataFrame([], "bucket long, node long")
    inside = open_members(members, labels)
    sets = settled(sets.join(inside.select("node").distinct(), "node", "left_semi"), "open-sets")
    members = settled(with_room(inside, sets, threshold), "open-members")
    pivots, all_tested, all_links = PIVOTS, [tested.select("u", "v")], [links]
    while True:
        several, chosen = open_buckets(members, labels, done, pivots)
        if chosen.isEmpty():
            break
        pairs = cross_pairs(several, chosen, threshold).join(
            reduce(DataFrame.union, all_tested), ["u", "v"], "left_anti"
        )
        fresh = settled(compared(settled(pairs, "pairs"), sets), "similarities")
        all_tested.append(fresh.select("u", "v"))
        linked = fresh.where(F.col("similarity") >= threshold).select("u", "v")
        if not linked.isEmpty():
            all_links.append(linked)
            labels = components(reduce(DataFrame.union, all_links))
        done = settled(done.union(chosen.select("bucket", "node")), "pivots")
        pivots *= 8
    named = signs.select("doc_id", "node").join(labels, "node", "left")
    return named.select("doc_id", "node", F.coalesce("component", "node").alias("component"))


def buckets(signs: DataFrame) -> DataFrame:
    """(bucket, node, weight, degree) of the buckets that hold more than one text; the degree of a
    text is how many texts its buckets hold, which is largest in the middle of a group."""
    nodes = signs.groupBy("node").agg(F.first("weight").alias("weight"), F.first("bands").alias("bands"))
    spread = nodes.select("node", "weight", F.posexplode("bands").alias("band", "hash")).select(
        F.xxhash64("band", "hash").alias("bucket"), "node", "weight"
    )
    spread = settled(spread, "bands")
    full = settled(spread.groupBy("bucket").count().where("count > 1"), "bucket-sizes")
    kept = settled(spread.join(full, "bucket"), "bucket-members")
    degrees = settled(kept.groupBy("node").agg(F.sum("count").alias("degree")), "degrees")
    return settled(kept.drop("count").join(degrees, "node"), "buckets")


def compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The similarity of every pair (u, v)."""
    one = sets.select(F.col("node").alias("u"), F.col("shingles").alias("one"))
    two = sets.select(F.col("node").alias("v"), F.col("shingles").alias("two"))
    both = pairs.join(one, "u").join(two, "v").select("u", "v", "one", "two")
    return both.mapInArrow(verified, "u long, v long, similarity double")


@lean
def spread_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per node and shingle, in batches of about 2**18 rows."""
    for batch in batches:
        nodes, blobs = batch.column("node").to_pylist(), batch.column("shingles").to_pylist()
        held, size = [], 0
        for place, (node, blob) in enumerate(zip(nodes, blobs, strict=True)):
            found, weight = unpacked(blob)
            held.append((np.full(len(found), node, np.int64), found.view(np.int32), weight))
            size += len(found)
            if size >= 1 << 18 or place == len(nodes) - 1:
                columns = [np.concatenate(c) for c in zip(*held, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c) for c in columns], names=["node", "shingle", "part"]
                )
                held, size = [], 0


def absent(marks: Column, other: Column) -> Column:
    """How many bits of ``marks`` are not in ``other``: so much weight at least is not shared."""
    bits = F.zip_with(marks, other, lambda x, y: F.bit_count(x.bitwiseAND(F.bitwise_not(y))))
    return F.aggregate(bits, F.lit(0), lambda total, n: total + n)


def open_members(members: DataFrame, labels: DataFrame) -> DataFrame:
    """The members of buckets that hold several components. Later rounds open no other bucket, as
    components only merge."""
    named = members.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    several = named.groupBy("bucket").agg(
        F.min("component").alias("low"), F.max("component").alias("high")
    ).where("low <> high").select("bucket")
    return settled(members.join(several, "bucket").select("bucket", "node", "weight"), "open-members")


def with_room(inside: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The members of open buckets with their bitmap and their room: the weight of the shingles that
    another of these texts has as well. No overlap is larger than that, so texts whose room is under
    ``threshold`` of their weight have no further link and are left out."""
    private = (
        sets.mapInArrow(spread_sets, "node long, shingle int, part double")
        .groupBy("shingle").agg(
            F.count("*").alias("texts"), F.min("node").alias("node"), F.min("part").alias("part")
        )
        .where("texts = 1").groupBy("node").agg(F.sum("part").alias("private"))
    )
    room = F.col("weight") - F.coalesce("private", F.lit(0.0))
    return (
        inside.join(settled(private, "private-weights"), "node", "left")
        .select("bucket", "node", "weight", room.alias("room"))
        .where(F.col("room") >= F.col("weight") * (threshold - 1e-4))
        .join(sets.select("node", "marks"), "node")
    )


def open_buckets(
    members: DataFrame, labels: DataFrame, done: DataFrame, pivots: int
) -> tuple[DataFrame, DataFrame]:
    """The members, with components, of buckets that hold several; and for each such bucket up to
    ``pivots`` (about) members outside its largest component that have not been pivots there."""
    named = members.join(labels, "node", "left").select(
        "bucket", *MEMBER, F.coalesce("component", "node").alias("component")
    )
    sizes = named.groupBy("bucket", "component").count()
    main = sizes.groupBy("bucket").agg(
        F.count("*").alias("parts"), F.sum("count").alias("total"),
        F.max_by("component", F.struct("count", "component")).alias("main"),
        F.max("count").alias("most"),
    ).where("parts > 1")
    # a written side lets Spark split the rows of a large bucket over several tasks
    several = settled(named.join(settled(main, "main-components"), "bucket"), "open-buckets")
    outside = several.where("component <> main").join(done, ["bucket", "node"], "left_anti")
    share = F.col("total") - F.col("most")
    turn = F.pmod(F.xxhash64("bucket", "node", F.lit(pivots)), F.greatest(F.floor(share / pivots), F.lit(1)))
    chosen = outside.where((share <= pivots) | (turn == 0)).select("bucket", *MEMBER, "component")
    some = settled(chosen, "chosen")
    if some.isEmpty() and not outside.isEmpty():  # none fell to the hash: take what is left
        some = settled(outside.select("bucket", *MEMBER, "component"), "chosen")
    return several, some


def cross_pairs(several: DataFrame, chosen: DataFrame, threshold: float) -> DataFrame:
    """Pivots with members of other components. The overlap is at most the smaller room, and at most
    either weight less what the bitmaps show to be absent from the other text. The similarity is the
    overlap over both weights less the overlap; pairs that cannot reach the threshold so are left out."""
    pivot = chosen.select(
        "bucket", F.col("node").alias("p"), F.col("weight").alias("pw"), F.col("room").alias("pr"),
        F.col("marks").alias("pm"), F.col("component").alias("pc"),
    )
    needed = (F.col("weight") + F.col("pw")) * (threshold - 1e-4)
    marks, other = F.col("marks"), F.col("pm")
    pairs = several.join(pivot, "bucket").where(
        (F.col("component") != F.col("pc"))
        & (F.least("room", "pr") * (1 + threshold) >= needed)
        & ((F.col("weight") - absent(marks, other)) * (1 + threshold) >= needed)
        & ((F.col("pw") - absent(other, marks)) * (1 + threshold) >= needed)
    )
    return pairs.select(F.greatest("node", "p").alias("u"), F.least("node", "p").alias("v")).distinct()


def op5_neardup(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, class_id (the smallest doc_id of the class) and class_size, one row per document."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = settled(classes(docs), "classes")
    # a written side lets Spark split the rows of a large class over several tasks
    names = settled(
        found.groupBy("component").agg(
            F.min("doc_id").alias("class_id"), F.count("*").alias("class_size")
        ),
        "class-names",
    )
    out = found.join(names, "component").select("doc_id", "class_id", "class_size")
    alone = docs.where(F.col("doc_id").isNull() | F.col("text").isNull() | (F.length("text") == 0))
    own = F.col("doc_id").cast("long")
    return out.union(alone.select(own.alias("doc_id"), own.alias("class_id"), F.lit(1).cast("long")))


def neardup_stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The document with the smallest doc_id of every class (once, if its row repeats)."""
    part, names = sheltered(docs, ("doc_id", "text"))
    found = classes(part.select("doc_id", "text"))
    best = settled(
        found.groupBy("component").agg(F.min(F.struct("doc_id", "node")).alias("best"))
        .select(F.col("best.doc_id").alias("_best_id"), F.col("best.node").alias("_best_node")),
        "representatives",
    )
    has = F.col("doc_id").isNotNull() & (F.length("text") > 0)
    rows = part.where(has).withColumn("_node", by_content())
    kept = rows.join(
        best, (F.col("doc_id") == F.col("_best_id")) & (F.col("_node") == F.col("_best_node"))
    ).dropDuplicates(["_best_id", "_best_node"])
    rest = part.where(~F.coalesce(has, F.lit(False)))
    return kept.select(*names).unionByName(rest).toDF(*docs.columns)
