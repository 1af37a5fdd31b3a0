"""Exact Jaccard join of documents by their sets of word n-grams.

A document is the set of its 64-bit shingle fingerprints; equal sets are one node. Two nodes link when
``100 * intersection >= LINKED * union``. The result is complete: every filter below is a bound that
no linked pair can miss.

1. *Prefixes.* Of a set of ``n`` shingles the ``n - needed(n) + reserve(n)`` smallest are kept. Two
   linked sets share at least ``reserve(needed(n))`` of these, for either's ``n``. So shingles that
   stand in one prefix only rule out most documents, and of the shared ones only the rarest are
   needed to make linked sets meet. The counting is a shuffle of packed arrays.
2. *Families.* The hub of a shared shingle is the node with the most to share (an original rather
   than its changed copies); its family are the nodes that share such a shingle with it. Any two
   nodes that share a shingle are in a family together. Every node is compared with its hubs.
3. *Tiles.* What remains are families with several components. A large one is cut into bands of
   sizes (linked sizes lie in one band or in neighbouring ones, so a node is also a guest of the next
   band) and these into blocks of ``TILE_ROWS`` nodes. A task gets two blocks and compares bitmaps of
   ``MARK_BITS`` hashed shingles: a bit that one set has and the other lacks is a shingle not shared.
   Only for pairs of different components that this bound lets through does exact intersection of the
   sorted arrays decide. No family is expanded into its pairs.

Very frequent shingles (by a table of counts of fixed size) are ranked last, and leave the counting
shuffle; only documents that consist mostly of them carry them, so no task gathers one shingle of a
third of all documents.

Defined results: null and empty texts, and texts without words, are empty sets that link with nothing,
also not with each other; a text with fewer words than a shingle is one shingle; repeated rows each
have a row; a null doc_id takes part but gives no name, and a component of such rows only has a null
name; an empty table gives no rows. Long texts are whole; a task holds a block of texts (or one text)
and ``HELD`` shingles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bizlens.llm.common import mixed, settled, small_batches, table
from bizlens.llm.neardup import components
from bizlens.llm.wordgrams import Words, bloom_of, byte_set, in_bloom, part_of, text_slices

SHINGLE = 4
LINKED = 85  # percent
SLOT_BITS = 20
SLOT_PARTS = 64
FREQUENT = 1000  # a shingle in fewer prefixes is never ranked as frequent
HELD = 3_000_000
PART_TOKENS = 2_000_000
TILE_ROWS = 1024
MARK_BITS = 4096
PAIRS = 1 << 16  # pairs compared at a time
BUCKET_ROWS = 8192
SENT = 1024  # shingles of a set that travels with its bitmap
BAND = math.log(100 / LINKED) * (1 + 1e-6)
_BREAKS, _NONE = byte_set(" \t\n\x0b\x0c\r"), np.zeros(256, bool)


def needed(n):
    """The smallest overlap of a set of ``n`` with any set that it links with."""
    return (LINKED * n + 99) // 100


def reserve(n):
    return 1 + n // 5


def kept_length(n):
    return n - needed(n) + reserve(n)


def shingle_sets(words: Words, rows: int, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles in order of row and fingerprint, their rows, and the set size of each row."""
    many = np.bincount(words.row, minlength=rows)
    found, owner = [], []
    for length in range(1, size + 1):
        first, gram = words.grams(length)
        row = words.row[first]
        if length < size:
            whole = many[row] == length
            gram, row = gram[whole], row[whole]
        found.append(gram)
        owner.append(row)
    found, owner = np.concatenate(found), np.concatenate(owner)
    order = np.lexsort((found, owner))
    found, owner = found[order], owner[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])
    found, owner = found[new], owner[new]
    return found, owner, np.bincount(owner, minlength=rows)


def node_names(found: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every set; 0 for empty sets."""
    ends = np.cumsum(size)
    sums = np.zeros(len(found) + 1, np.uint64)
    np.cumsum(mixed(found + np.uint64(3)), dtype=np.uint64, out=sums[1:])
    total = sums[ends] - sums[ends - size]
    return np.where(size > 0, mixed(total + size.astype(np.uint64)), np.uint64(0))


def sets_of(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        for low, high, data, offsets in text_slices(batch):
            found, owner, size = shingle_sets(Words(data, offsets, _BREAKS, _NONE), high - low)
            yield batch, low, found, owner, size, node_names(found, size)


def prefixes(batches: Iterator[pa.RecordBatch]):
    """The prefix tokens of the distinct sets of a task: nodes, sizes, and token and owner arrays."""
    seen: set[int] = set()
    for _, _, found, owner, size, node in sets_of(batches):
        start = np.cumsum(size) - size
        fresh = np.zeros(len(size), bool)
        for place, name in enumerate(node.tolist()):
            if size[place] and name not in seen:
                seen.add(name)
                fresh[place] = True
        if len(seen) > HELD:
            seen.clear()
        inside = fresh[owner] & (np.arange(len(found)) - start[owner] < kept_length(size)[owner])
        place = np.cumsum(fresh) - 1
        yield node[fresh], size[fresh], mixed(found[inside]), place[owner[inside]]


# --- frequent shingles, by a table of fixed size


def slots(token: np.ndarray) -> np.ndarray:
    return token >> np.uint64(64 - SLOT_BITS)


def slot_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << SLOT_BITS, np.int64)
    for _, _, token, _ in prefixes(batches):
        total += np.bincount(slots(token), minlength=len(total))
    if total.any():
        yield pa.RecordBatch.from_pydict(
            {
                "part": pa.array(range(SLOT_PARTS), pa.int32()),
                "counts": pa.array([x.tobytes() for x in total.astype(np.int32).reshape(SLOT_PARTS, -1)], pa.binary()),
            }
        )


def slot_sums(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(x, np.int32).astype(np.int64) for x in rows["counts"])
    return pd.DataFrame({"part": [key[0]], "counts": [total.tobytes()]})


def frequent_slots(texts: DataFrame) -> tuple[np.ndarray, int]:
    """Which slots are frequent, and the number of prefix tokens."""
    schema = "part int, counts binary"
    rows = texts.mapInArrow(slot_counts, schema).groupBy("part").applyInPandas(slot_sums, schema).orderBy("part").collect()
    if not rows:
        return np.zeros(1 << SLOT_BITS, bool), 0
    count = np.concatenate([np.frombuffer(r["counts"], np.int64) for r in rows])
    return count > max(FREQUENT, 4 * count.mean()), int(count.sum())


# --- shared tokens


def packed_tokens(batches: Iterator[pa.RecordBatch], frequent: np.ndarray, parts: int) -> Iterator[pa.RecordBatch]:
    """Prefix tokens that are not frequent as one row per part: nodes, their sizes, how many frequent
    tokens they have, how many tokens they have here, and these."""

    def sent(held: list) -> pa.RecordBatch:
        shift = np.cumsum([0] + [len(h[0]) for h in held])
        node, size, common, token = (np.concatenate([h[k] for h in held]) for k in range(4))
        owner = np.concatenate([h[4] + s for h, s in zip(held, shift, strict=False)])
        part = part_of(token, parts)
        order = np.argsort(part, kind="stable")
        token, owner, part = token[order], owner[order], part[order]
        cut = np.searchsorted(part, np.arange(parts + 1))
        full = np.flatnonzero(np.diff(cut))
        columns: dict[str, list] = {c: [] for c in ("nodes", "sizes", "common", "counts", "tokens")}
        for p in full:
            own = owner[cut[p] : cut[p + 1]]
            head = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            at = own[head]
            columns["nodes"].append(node[at].tobytes())
            columns["sizes"].append(size[at].astype(np.int32).tobytes())
            columns["common"].append(common[at].astype(np.int32).tobytes())
            columns["counts"].append(np.diff(np.append(head, len(own))).astype(np.int32).tobytes())
            columns["tokens"].append(token[cut[p] : cut[p + 1]].tobytes())
        return pa.RecordBatch.from_pydict(
            {"part": pa.array(full, pa.int32())} | {c: pa.array(v, pa.binary()) for c, v in columns.items()}
        )

    held, total = [], 0
    for node, size, token, owner in prefixes(batches):
        often = frequent[slots(token)]
        held.append((node, size, np.bincount(owner[often], minlength=len(node)), token[~often], owner[~often]))
        total += len(held[-1][3])
        if total > HELD:
            yield sent(held)
            held, total = [], 0
    if total:
        yield sent(held)


SHARED = "node long, token long, texts int, size int, common int"


def shared_tokens(rows: pd.DataFrame) -> pd.DataFrame:
    """The (node, token) of a part whose token stands in two nodes or more, with that number."""
    node, size, common, counts = (
        np.concatenate([np.frombuffer(x, kind) for x in rows[c]])
        for c, kind in (("nodes", np.int64), ("sizes", np.int32), ("common", np.int32), ("counts", np.int32))
    )
    token = np.concatenate([np.frombuffer(x, np.uint64) for x in rows["tokens"]])
    at = np.repeat(np.arange(len(node)), counts)
    order = np.lexsort((node[at], token))
    token, at = token[order], at[order]
    own = node[at]
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (own[1:] != own[:-1])  # a text may come from several tasks
    token, at, own = token[new], at[new], own[new]
    first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
    many = np.diff(np.append(first, len(token)))
    texts = np.repeat(many, many)
    kept = texts > 1
    at = at[kept]
    return pd.DataFrame(
        {
            "node": own[kept], "token": token[kept].view(np.int64), "texts": texts[kept],
            "size": size[at], "common": common[at],
        }
    )


def required(size: Column) -> Column:
    """How many prefix tokens a set shares at least with any set it links with."""
    least = F.floor((size.cast("long") * LINKED + 99) / 100)
    return F.floor(least / 5) + 1


NODES = "doc_id long, node long, size int, rest array<long>"


def named_sets(batches: Iterator[pa.RecordBatch], frequent: np.ndarray) -> Iterator[pa.RecordBatch]:
    """For every row its node and set size; and the frequent tokens that its prefix cannot do without."""
    for batch, low, found, owner, size, node in sets_of(batches):
        rows = len(size)
        start = np.cumsum(size) - size
        inside = np.arange(len(found)) - start[owner] < kept_length(size)[owner]
        token, own = mixed(found[inside]), owner[inside]
        often = frequent[slots(token)]
        token, own = token[often], own[often]
        common = np.bincount(own, minlength=rows)
        spare = common - reserve(needed(size)) + 1
        order = np.lexsort((token, own))
        token, own = token[order], own[order]
        head = np.cumsum(common) - common
        wanted = np.arange(len(token)) - head[own] < spare[own]
        counts = np.bincount(own[wanted], minlength=rows)
        rest = pa.ListArray.from_arrays(
            pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(token[wanted].view(np.int64))
        )
        yield pa.RecordBatch.from_pydict(
            {
                "doc_id": batch.column("doc_id").slice(low, rows),
                "node": pa.array(node.view(np.int64), mask=size == 0),
                "size": pa.array(size, pa.int32()),
                "rest": rest,
            }
        )


def token_rows(shared: DataFrame, nodes: DataFrame) -> DataFrame:
    """``token, node, size, kept``: the prefix tokens that a node has to meet others on, and how many
    it has; an original has more of them than its changed copies."""
    of_node = Window.partitionBy("node")
    rare = (
        shared.withColumn("many", F.count("*").over(of_node))
        .withColumn("place", F.row_number().over(of_node.orderBy("texts", "token")))
        .withColumn("kept", (F.col("many") + F.col("common") - required(F.col("size")) + 1).cast("int"))
        .where("place <= kept").select("token", "node", "size", "kept")
    )
    often = nodes.where(F.size("rest") > 0).groupBy("node").agg(
        F.first("size").alias("size"), F.first("rest").alias("rest")
    ).select(F.explode("rest").alias("token"), "node", "size", F.size("rest").alias("kept"))
    return settled(rare.union(often), "prefix-tokens")


def families(rows: DataFrame) -> DataFrame:
    """``hub, node, size``: the nodes that share a token with its hub, the node of the token with the
    most tokens. Two nodes that share a token are in a family together."""
    hubs = rows.groupBy("token").agg(F.count("*").alias("members"), F.max(F.struct("kept", "node")).alias("hub"))
    hubs = settled(hubs.where("members > 1").select("token", F.col("hub.node").alias("hub")), "hubs")
    return settled(
        rows.join(hubs, "token").groupBy("hub", "node").agg(F.first("size").alias("size")), "families"
    )


def tile_members(inside: DataFrame) -> DataFrame:
    """``hub, band, node, size, component, own, members`` of the tiles that have an owner and several
    components. A family of up to ``TILE_ROWS`` nodes is one tile; in a larger one every node owns
    its band of sizes and is a guest of the next."""
    band = F.floor(F.log(F.col("size").cast("double")) / BAND).cast("int")
    many = inside.groupBy("hub").agg(F.count("*").alias("many"))
    one = F.array(F.struct(F.lit(0).alias("band"), F.lit(True).alias("own")))
    places = F.array(
        F.struct(band.alias("band"), F.lit(True).alias("own")),
        F.struct((band + 1).alias("band"), F.lit(False).alias("own")),
    )
    rows = inside.join(settled(many, "family-sizes"), "hub").select(
        "hub", "node", "size", "component", F.inline(F.when(F.col("many") <= TILE_ROWS, one).otherwise(places))
    )
    tiles = rows.groupBy("hub", "band").agg(
        F.count("*").alias("members"), F.max("own").alias("owned"),
        F.min("component").alias("least"), F.max("component").alias("most"),
    ).where("owned and least <> most").select("hub", "band", "members")
    return rows.join(settled(tiles, "open-tiles"), ["hub", "band"])


# --- exact comparison


def set_rows(batches: Iterator[pa.RecordBatch], wanted: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """The sorted shingles of every set of a task, once, and the bitmap of their hashes. ``wanted`` is a
    Bloom filter of nodes; a few others may pass it."""
    seen: set[int] = set()
    for _, _, found, owner, size, node in sets_of(batches):
        ends = np.cumsum(size)
        hit = size > 0
        if wanted is not None:
            hit &= in_bloom(wanted, node)
        names, blobs, marks = [], [], []
        for place in np.flatnonzero(hit).tolist():
            name = int(node[place])
            if wanted is not None:
                if name in seen:
                    continue
                seen.add(name)
            own = found[ends[place] - size[place] : ends[place]]
            bits = np.zeros(MARK_BITS, np.uint8)
            bits[own & np.uint64(MARK_BITS - 1)] = 1
            names.append(name)
            blobs.append(own.tobytes())
            marks.append(np.packbits(bits).tobytes())
        yield pa.RecordBatch.from_pydict(
            {
                "node": pa.array(np.array(names, np.uint64).view(np.int64)),
                "shingles": pa.array(blobs, pa.binary()),
                "marks": pa.array(marks, pa.binary()),
            }
        )
        if len(seen) > HELD:
            seen.clear()


def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs whose sets link, by intersection of their sorted arrays."""
    for batch in batches:
        good = np.zeros(batch.num_rows, bool)
        for place, (one, two) in enumerate(zip(batch.column("one"), batch.column("two"), strict=True)):
            a, b = np.frombuffer(one.as_buffer(), np.uint64), np.frombuffer(two.as_buffer(), np.uint64)
            good[place] = 100 * min(len(a), len(b)) >= LINKED * max(len(a), len(b)) and intersects(a, b)
        kept = pa.array(good)
        yield pa.RecordBatch.from_arrays([batch.column("u").filter(kept), batch.column("v").filter(kept)], names=["u", "v"])


def links_among(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    one = sets.select(F.col("node").alias("u"), F.col("shingles").alias("one"))
    two = sets.select(F.col("node").alias("v"), F.col("shingles").alias("two"))
    found = pairs.join(one, "u").join(two, "v").select("u", "v", "one", "two")
    return settled(found.mapInArrow(linked, "u long, v long"), "links")


def ordered_pair(one: Column, two: Column) -> list[Column]:
    return [F.least(one, two).alias("u"), F.greatest(one, two).alias("v")]


def not_joined(members: DataFrame, labels: DataFrame) -> DataFrame:
    """``hub, node, size, component`` of families whose nodes are of several components."""
    named = settled(
        members.join(labels, "node", "left").select(
            "hub", "node", "size", F.coalesce("component", "node").alias("component")
        ),
        "named-members",
    )
    several = named.groupBy("hub").agg(F.min("component").alias("least"), F.max("component").alias("most"))
    return named.join(settled(several.where("least <> most").select("hub"), "open-families"), "hub")


def intersects(a: np.ndarray, b: np.ndarray) -> bool:
    both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return 100 * both >= LINKED * (len(a) + len(b) - both)


def pair_places(tile: np.ndarray, side: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of rows to compare, about ``PAIRS`` at a time. Rows come in order of tile and side; a row
    of side 0 meets all of side 1, one of side 2 those behind it."""
    rows = len(tile)
    end = np.searchsorted(tile, tile, "right")
    key = tile * 4 + side
    first = np.where(side == 2, np.arange(rows) + 1, np.searchsorted(key, key, "right"))
    many = np.where(side == 1, 0, np.maximum(end - first, 0))
    total = np.cumsum(many)
    low = 0
    while low < rows:
        high = max(int(np.searchsorted(total, (total[low - 1] if low else 0) + PAIRS, "right")), low + 1)
        own = np.repeat(np.arange(low, high), many[low:high])
        start = np.cumsum(many[low:high]) - many[low:high]
        yield own, first[own] + np.arange(len(own)) - np.repeat(start, many[low:high])
        low = high


def blocked(rows: pd.DataFrame) -> pd.DataFrame:
    """Blocks of some tiles, one or two each: the pairs of different components that bitmaps allow.
    Sets that came along are intersected here, likeliest pairs first, and a pair whose components
    an earlier link has already joined is left out; of the others the pair is returned unsure."""
    number = rows.groupby(["hub", "band", "i", "j"], sort=False).ngroup().to_numpy()
    order = np.lexsort((rows["side"].to_numpy(), number))
    tile, side = number[order], rows["side"].to_numpy()[order]
    node, own, label = (rows[c].to_numpy()[order] for c in ("node", "own", "component"))
    size = rows["size"].to_numpy(np.int64)[order]
    bits = np.frombuffer(b"".join(rows["marks"]), np.uint64).reshape(len(rows), -1)[order]
    blobs = rows["shingles"].to_numpy()[order]
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.get(x, x) != x:
            parent[x] = parent.get(parent[x], parent[x])
            x = parent[x]
        return x

    out: set[tuple[int, int, bool]] = set()
    no: set[tuple[int, int]] = set()
    for one, two in pair_places(tile, side):
        fit = (label[one] != label[two]) & (own[one] | own[two])
        fit &= 100 * np.minimum(size[one], size[two]) >= LINKED * np.maximum(size[one], size[two])
        one, two = one[fit], two[fit]
        lost = np.bitwise_count(bits[one] & ~bits[two]).sum(axis=1, dtype=np.int64)
        gained = np.bitwise_count(bits[two] & ~bits[one]).sum(axis=1, dtype=np.int64)
        most = np.minimum(size[one] - lost, size[two] - gained)
        whole = size[one] + size[two] - most
        fit = np.flatnonzero(100 * most >= LINKED * whole)
        fit = fit[np.argsort(-(most[fit] / whole[fit]), kind="stable")]
        for a, b in zip(one[fit].tolist(), two[fit].tolist(), strict=True):
            pair = (min(node[a], node[b]), max(node[a], node[b]))
            if blobs[a] is None or blobs[b] is None:
                out.add((*pair, False))
                continue
            x, y = root(label[a]), root(label[b])
            if x == y or pair in no:
                continue
            if intersects(np.frombuffer(blobs[a], np.uint64), np.frombuffer(blobs[b], np.uint64)):
                parent[x] = y
                out.add((*pair, True))
            else:
                no.add(pair)
    return pd.DataFrame(sorted(out), columns=["u", "v", "sure"]).astype({"u": np.int64, "v": np.int64, "sure": bool})


def bitmap_pairs(inside: DataFrame, sets: DataFrame) -> DataFrame:
    """What block against block finds in open tiles. A member goes to the pairs of its own block with
    every block of the tile; side 2 is a block with itself. A task takes the block pairs of a bucket,
    about ``BUCKET_ROWS`` rows. Sets of up to ``SENT`` shingles travel with their bitmap."""
    blocks = F.ceil(F.col("members") / TILE_ROWS).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    rows = inside.withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    side = F.when(F.col("_own") == F.col("_other"), 2).when(F.col("_own") < F.col("_other"), 0).otherwise(1)
    rows = settled(
        rows.select(
            "hub", "band", F.least("_own", "_other").alias("i"), F.greatest("_own", "_other").alias("j"),
            side.alias("side"), "node", "size", "own", "component",
        ),
        "tile-blocks",
    )
    buckets = max(1, rows.count() // BUCKET_ROWS)
    bucket = F.pmod(F.xxhash64("hub", "band", "i", "j"), F.lit(buckets))
    carried = sets.select("node", "marks", F.when(F.length("shingles") <= 8 * SENT, F.col("shingles")).alias("shingles"))
    found = (
        rows.join(carried, "node").groupBy(bucket.alias("bucket"))
        .applyInPandas(lambda x: blocked(x), "u long, v long, sure boolean")
    )
    return settled(found.distinct(), "bitmap-pairs")


def classes(docs: DataFrame) -> DataFrame:
    """``doc_id, size, node, component`` for every row; node and component are null for empty sets."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    frequent, total = frequent_slots(texts.select("text"))
    held = spark.sparkContext.broadcast(frequent)  # 2**SLOT_BITS flags
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // PART_TOKENS))
    packed = "part int, nodes binary, sizes binary, common binary, counts binary, tokens binary"
    shared = settled(
        texts.select("text").mapInArrow(lambda b: packed_tokens(b, held.value, parts), packed)
        .groupBy("part").applyInPandas(shared_tokens, SHARED),
        "shared-tokens",
    )
    nodes = settled(texts.mapInArrow(lambda b: named_sets(b, held.value), NODES), "nodes")
    members = families(token_rows(shared, nodes))
    wanted = spark.sparkContext.broadcast(bloom_of(members.select("node").distinct(), "node"))
    rows = texts.select("text").mapInArrow(
        lambda b: set_rows(b, wanted.value), "node long, shingles binary, marks binary"
    )
    sets = settled(rows.groupBy("node").agg(F.first("shingles").alias("shingles"), F.first("marks").alias("marks")), "sets")
    # every node with the hubs of its families
    near = members.where("node <> hub").select(*ordered_pair(F.col("node"), F.col("hub"))).distinct()
    links = links_among(near, sets)
    # all that the bitmaps allow where several components are left
    inside = tile_members(not_joined(members, components(links)))
    found = bitmap_pairs(inside, sets)
    links = links.union(found.where("sure").select("u", "v"))
    links = links.union(links_among(found.where("not sure").select("u", "v"), sets))
    labels = components(links)
    return nodes.join(labels, "node", "left").select(
        "doc_id", "size", "node", F.coalesce("component", "node").alias("component")
    )


def op11_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, n_shingles and component_id, the smallest doc_id that links reach; one row per document."""
    found = settled(classes(table(spark, folder, "documents").select("doc_id", "text")), "components")
    names = settled(
        found.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("component_id")), "names"
    )
    n = F.col("size").cast("long").alias("n_shingles")
    full = found.where("component is not null").join(names, "component").select("doc_id", n, "component_id")
    return full.union(found.where("component is null").select("doc_id", n, F.col("doc_id").alias("component_id")))
