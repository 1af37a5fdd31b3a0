"""Best-fit packing of tokenised documents into sequences by a grouping genetic algorithm.

Documents are tokenised and cut into pieces of at most ``CAPACITY`` ids; full pieces are sequences
of their own. The others are dealt by hash into cells of about ``CELL`` pieces. For each cell
several islands evolve populations of packings: crossover injects well-filled bins of one parent
whole into the other, drops the bins that then hold duplicates, and re-inserts the displaced pieces
by best fit. After each epoch the elite of every island moves to the next island of its cell, by a
join; at the end the best packing of each cell is kept. Cells keep a fixed size at any corpus size,
so tasks stay small and the loss is at most the one open sequence per cell.

Defined results: a null or empty text is the single id that ends a document; repeated rows are
packed as often as they occur, a null doc_id like any other; no document gives no rows.
"""

from __future__ import annotations

import random
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bizlens.llm.common import held_model, lean, settled, sheltered, small_batches, table

CAPACITY = 4096
END_ID = 1
CELL = 4000
ISLANDS = 2
EPOCHS = 2
POPULATION = 4
GENERATIONS = 6
WELL_FILLED = 0.995
CACHED_WORDS = 400_000
TOKENIZER = "word_bpe_49k.json"
PUNCTUATION = ".,;:!?#*$%&"  # a run of these is a word of its own to the tokenizer
ODD_SPACE = re.compile("[\x1c-\x1f]")  # white space to Python, not to the tokenizer
PIECES = "pid long, doc_id long, piece int, start long, length long, ids_crc32 long"


def byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the rest follow from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + n) for n, b in enumerate(rest)}


class Words:
    """Ids of texts by way of a cache of the ids of their words.

    White space is dropped and never joins tokens, so a text's ids are those of its words in turn.
    A word of plain letters with end punctuation goes straight to the merge rules; any other word
    goes through the whole tokenizer."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.letters = byte_letters()
        self.known: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}

    def packed(self, ids: list[int]) -> bytes:
        return np.array(ids, "<u4").tobytes()

    def merged(self, stem: str) -> bytes:
        low = stem.lower()
        found = self.known.get(low)
        if found is None:
            mapped = low if low.isascii() else low.encode().decode("latin-1").translate(self.letters)
            found = self.known[low] = self.packed([t.id for t in self.model.tokenize(mapped)])
        return found

    def tail(self, marks: str) -> bytes:
        found = self.tails.get(marks)
        if found is None:
            found = self.tails[marks] = self.packed(self.whole.encode(marks, add_special_tokens=False).ids)
        return found

    def learnt(self, word: str) -> bytes:
        if len(self.known) > CACHED_WORDS:
            self.known.clear()
        stem = word.rstrip(PUNCTUATION)
        if stem.isalpha() and (stem.isascii() or max(stem) < "ɐ" and "İ" not in stem):
            found = self.merged(stem)
            if len(stem) < len(word):
                found += self.tail(word[len(stem) :])
        else:
            found = self.packed(self.whole.encode(word, add_special_tokens=False).ids)
        self.known[word] = found
        return found

    def ids(self, text: str) -> bytes:
        """The ids of a text and the closing id, as little-endian unsigned 32-bit numbers."""
        end = self.packed([END_ID])
        if ODD_SPACE.search(text):
            return self.packed(self.whole.encode(text, add_special_tokens=False).ids) + end
        known, learnt = self.known.get, self.learnt
        found = [known(w) or learnt(w) for w in text.split()]
        found.append(end)
        return b"".join(found)


def words_of(path: str) -> Words:
    return held_model(("words", path), lambda: Words(path))


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lean
def cut(batches: Iterator[pa.RecordBatch], path: str | None) -> Iterator[pa.RecordBatch]:
    words = words_of(path or tokenizer_path(TOKENIZER))
    pid = TaskContext.get().partitionId() << 33
    for batch in batches:
        out: dict[str, list] = {k: [] for k in ("pid", "doc_id", "piece", "start", "length", "ids_crc32")}
        docs = batch.column("doc_id").to_pylist()
        for doc, text in zip(docs, batch.column("text").to_pylist(), strict=True):
            ids = words.ids(text or "")
            for piece, start in enumerate(range(0, len(ids) // 4, CAPACITY)):
                own = ids[4 * start : 4 * (start + CAPACITY)]
                row = (pid, doc, piece, start, len(own) // 4, zlib.crc32(own))
                for column, value in zip(out.values(), row, strict=True):
                    column.append(value)
                pid += 1
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_pydict(
            {k: pa.array(v, t) for (k, v), t in zip(out.items(), kinds, strict=True)}
        )


# --- one cell: a packing is a list of bins, a bin a list of piece numbers


def best_fit(sizes: list[int], bins: list[list[int]], loose: list[int]) -> list[list[int]]:
    """Puts the loose pieces, largest first, each where it leaves least room."""
    room = sorted((CAPACITY - sum(sizes[i] for i in b), n) for n, b in enumerate(bins))
    out = [list(b) for b in bins]
    for i in sorted(loose, key=lambda x: -sizes[x]):
        at = bisect_left(room, (sizes[i], -1))
        if at < len(room):
            left, n = room.pop(at)
            out[n].append(i)
        else:
            left, n = CAPACITY, len(out)
            out.append([i])
        if left - sizes[i] > 0:
            insort(room, (left - sizes[i], n))
    return out


def fitness(sizes: list[int], bins: list[list[int]]) -> float:
    """Mean squared filling: uneven bins leave usable room."""
    return sum((sum(sizes[i] for i in b) / CAPACITY) ** 2 for b in bins) / max(len(bins), 1)


def crossed(sizes: list[int], one: list[list[int]], two: list[list[int]], rng: random.Random) -> list[list[int]]:
    """Half of the well-filled bins of ``two`` enter ``one`` whole; what they displace is re-fitted."""
    good = [b for b in two if sum(sizes[i] for i in b) >= WELL_FILLED * CAPACITY and rng.random() < 0.5]
    held = {i for b in good for i in b}
    kept, loose = [], []
    for b in one:
        if any(i in held for i in b):
            loose.extend(i for i in b if i not in held)
        else:
            kept.append(b)
    # the worst-filled bins are opened too, which gives the displaced pieces room to combine
    kept.sort(key=lambda b: sum(sizes[i] for i in b))
    opened = max(1, len(kept) // 20)
    for b in kept[:opened]:
        loose.extend(b)
    return best_fit(sizes, good + kept[opened:], loose)


def evolved(sizes: list[int], packings: list[list[list[int]]], seed: int) -> list[list[list[int]]]:
    """The population after ``GENERATIONS`` crossovers, best first: by fewest bins, then by fitness."""

    def ranking(packing: list[list[int]], n: int) -> tuple[int, float, int, list[list[int]]]:
        return -len(packing), fitness(sizes, packing), n, packing

    rng = random.Random(seed)
    items = list(range(len(sizes)))
    while len(packings) < POPULATION:
        if packings or seed % ISLANDS:
            first = rng.sample(items, len(items) // 3)
            packings.append(best_fit(sizes, best_fit(sizes, [], first), list(set(items) - set(first))))
        else:
            packings.append(best_fit(sizes, [], items))
    ranked = sorted((ranking(p, n) for n, p in enumerate(packings)), reverse=True)
    for n in range(GENERATIONS):
        one, two = rng.sample(ranked[:POPULATION], 2) if len(ranked) > 1 else (ranked[0], ranked[0])
        child = crossed(sizes, one[-1], two[-1], rng)
        ranked = sorted([*ranked, ranking(child, len(packings) + n)], reverse=True)
        ranked = ranked[:POPULATION]
    return [p for *_, p in ranked]


def as_numbers(bins: list[list[int]], count: int) -> list[int]:
    out = [0] * count
    for n, b in enumerate(bins):
        for i in b:
            out[i] = n
    return out


def as_bins(numbers: list[int]) -> list[list[int]]:
    out: dict[int, list[int]] = {}
    for i, n in enumerate(numbers):
        out.setdefault(int(n), []).append(i)
    return list(out.values())


STATE = "cell long, island int, pids array<long>, sizes array<int>, packings array<array<int>>"


@lean
def epoch(parts: Iterator[pd.DataFrame], number: int) -> Iterator[pd.DataFrame]:
    for part in parts:
        rows = []
        for row in part.itertuples(index=False):
            sizes = [int(x) for x in row.sizes]
            packings = [as_bins(p) for p in row.packings]
            seed = (int(row.cell) * EPOCHS + number) * ISLANDS + int(row.island)
            best = evolved(sizes, packings, seed)[:2]
            rows.append(
                {
                    "cell": row.cell, "island": row.island, "pids": row.pids, "sizes": row.sizes,
                    "packings": [as_numbers(p, len(sizes)) for p in best],
                }
            )
        yield pd.DataFrame(rows, columns=["cell", "island", "pids", "sizes", "packings"])


def placed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The sequence and offset of every piece of each cell's best packing."""
    for part in parts:
        for row in part.itertuples(index=False):
            numbers = np.asarray(row.packing)
            sizes, pids = np.asarray(row.sizes), np.asarray(row.pids)
            order = np.lexsort((pids, numbers))
            total = np.concatenate([[0], np.cumsum(sizes[order])])
            first = np.searchsorted(numbers[order], numbers[order], "left")
            yield pd.DataFrame(
                {
                    "pid": pids[order],
                    "sequence_id": (int(row.cell) << 20) + numbers[order],
                    "offset": total[:-1] - total[first],
                }
            )



def packed(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece."""
    spark = docs.sparkSession
    small_batches(spark)
    pieces = settled(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
            lambda b: cut(b, path), PIECES
        ),
        "pieces",
    )
    rest = pieces.where(F.col("length") < CAPACITY)
    cells = max(1, -(-rest.count() // CELL))
    states = (
        rest.groupBy(F.pmod(F.xxhash64("pid"), F.lit(cells)).alias("cell"))
        .agg(F.sort_array(F.collect_list(F.struct("pid", F.col("length").cast("int").alias("size")))).alias("own"))
        .select(
            "cell", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"),
            F.col("own.pid").alias("pids"), F.col("own.size").alias("sizes"),
            F.array().cast("array<array<int>>").alias("packings"),
        )
        .repartition(F.col("cell"), F.col("island"))
    )
    for number in range(EPOCHS):
        states = settled(states.mapInPandas(lambda p, n=number: epoch(p, n), STATE), "islands")
        if number + 1 < EPOCHS:
            elite = states.select(
                "cell", ((F.col("island") + 1) % ISLANDS).alias("island"), F.slice("packings", 1, 1).alias("elite")
            )
            states = states.join(elite, ["cell", "island"]).select(
                "cell", "island", "pids", "sizes", F.concat("elite", "packings").alias("packings")
            )
    packing = F.element_at("packings", 1)
    best = states.groupBy("cell").agg(
        F.min_by(F.struct("pids", "sizes", packing.alias("packing")), F.struct(F.array_max(packing), "island")).alias("best")
    )
    spots = best.select("cell", "best.*").mapInPandas(placed, "pid long, sequence_id long, offset long")
    full = pieces.where(F.col("length") == CAPACITY).select(
        "pid", (-F.col("pid") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    spots = settled(spots, "places")
    return pieces.join(spots.union(full), "pid").drop("pid")


def op3_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packed(table(spark, folder, "documents"))


def packing_stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    return packed(sheltered(docs, ("doc_id", "text"))[0])
