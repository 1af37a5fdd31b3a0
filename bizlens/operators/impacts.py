"""An impact-ordered index: postings by term in layers of falling weight, and the chunks' vectors.

A *cell* is one term and one layer. Its largest and smallest weight and its size are known, so a score
that the best ``k`` chunks of a query reach at least is known before a vector is read (a cell and those
above it hold ``k`` postings or more). Tasks read the chunk vectors where they lie, a group of chunks at a
time, and the blocks of queries from a written table; each pair of the two is one matrix product, whose rows
leave the task only if they reach that bound, the ``k``-th best of the task's groups before, and that of
their group. So vectors are never shuffled or repeated, no row per query and chunk is ever written, and
results are exact.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from bizlens.functions.exact import rounded
from bizlens.session import pinned, scratch_path
from bizlens.sources.files import listed, store_of

LAYERS = 12  # each layer spans a factor of the square root of two
CELL_ROWS = 32_768  # chunks of a group
SEED_ROWS = 4096  # queries of a block
SLICE = 512  # chunks of a group that are multiplied at a time
SLACK = 2e-6  # results are ranked at six places; a bound must not cut what rounds up


@dataclass
class ImpactIndex:
    """``vectors``: the keys, ``term_nos``, ``weights`` (one row per chunk). ``postings``, a view of
    them: ``term_no, layer``, the keys, ``weight``. ``cells``: at most ``LAYERS`` rows per term of the
    vocabulary: ``term_no, layer, n, top, low, reach``."""

    vectors: DataFrame
    postings: DataFrame
    cells: DataFrame
    keys: tuple[str, ...]

    @classmethod
    def write(cls, weights: DataFrame, keys: Sequence[str], path: str) -> "ImpactIndex":
        """Lay out ``keys, term_no, weight`` (weights above 0, at most 1)."""
        spark, keys = weights.sparkSession, list(keys)
        entry = F.array_sort(F.collect_list(F.struct("term_no", "weight")))
        weights.groupBy(*keys).agg(entry.alias("_v")).select(
            *keys, F.col("_v.term_no").alias("term_nos"), F.col("_v.weight").alias("weights")
        ).write.mode("overwrite").parquet(f"{path}/vectors")
        above = Window.partitionBy("term_no").orderBy("layer")
        (
            layered(spark.read.parquet(f"{path}/vectors"), keys).groupBy("term_no", "layer")
            .agg(F.count("*").alias("n"), F.max("weight").alias("top"), F.min("weight").alias("low"))
            .withColumn("reach", F.sum("n").over(above))
            .write.mode("overwrite").parquet(f"{path}/cells")
        )
        return cls.read(spark, keys, path, weights.schema)

    @classmethod
    def read(cls, spark: SparkSession, keys: Sequence[str], path: str, schema) -> "ImpactIndex":
        """The stored index; ``schema`` gives the types of the keys."""
        own = ", ".join(f"`{k}` {schema[k].dataType.simpleString()}" for k in keys)
        vectors = spark.read.schema(f"{own}, term_nos array<int>, weights array<double>").parquet(f"{path}/vectors")
        cells = spark.read.schema("term_no int, layer int, n long, top double, low double, reach long")
        return cls(vectors, layered(vectors, keys), cells.parquet(f"{path}/cells"), tuple(keys))

    def contributions(self, cells: DataFrame) -> DataFrame:
        """``query_id``, the keys and ``score`` of every chunk that may be among the best ``places`` of a
        query: in its group none is left out but those below ``bound`` or below the group's own
        ``places``-th best. ``cells``: ``query_id, term_no, query_weight, bound, places``."""
        keys = list(self.keys)
        asked = cells.groupBy("query_id").agg(
            F.array_sort(F.collect_list(F.struct("term_no", "query_weight"))).alias("_q"),
            F.max("bound").alias("bound"), F.max("places").cast("int").alias("places"),
        ).select(
            "query_id", F.col("_q.term_no").alias("term_nos"), F.col("_q.query_weight").alias("weights"),
            "bound", "places",
        )
        path = scratch_path(self.vectors.sparkSession, "queries")
        asked.write.parquet(path)
        group_rows, block_rows, slice_rows, slack = CELL_ROWS, SEED_ROWS, SLICE, SLACK

        def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            store, root = store_of(path)
            reached: dict[int, np.ndarray] = {}
            for found in grouped(batches, group_rows):
                for number, wanted in enumerate(blocks(store, root, block_rows)):
                    bound = wanted.column("bound").to_numpy()
                    bound = np.maximum(bound, reached[number]) if number in reached else bound
                    rows, queries, scores, reached[number] = best_pairs(found, wanted, bound, slice_rows, slack)
                    columns = [wanted.column("query_id").take(pa.array(queries))]
                    columns += [found.column(k).take(pa.array(rows)) for k in keys]
                    out = pa.table([*columns, pa.array(scores)], names=["query_id", *keys, "score"])
                    yield from out.to_batches()

        # a query's id may be a struct, whose fields keep their own nullability
        kinds = StructType([StructField("query_id", asked.schema["query_id"].dataType)])
        for k in keys:
            kinds = kinds.add(k, self.vectors.schema[k].dataType)
        kinds = kinds.add("score", "double")
        return self.vectors.select(*keys, "term_nos", "weights").mapInArrow(scored, kinds)

    def search(self, asked: DataFrame, k: int) -> DataFrame:
        """``query_id, rank``, the keys, ``score``: the ``k`` best chunks of every query (``query_id,
        term_no, query_weight``), ranked at six places, ties by key. A hit shares a term."""
        keys = list(self.keys)
        asked = pinned(asked.where(F.col("query_weight") > 0))
        bound = self.lower_bounds(asked, k)
        wanted = asked.join(bound, "query_id", "left").select(
            "query_id", "term_no", "query_weight", F.coalesce("bound", F.lit(0.0)).alias("bound"), F.lit(k).alias("places")
        )
        scored = self.contributions(wanted).withColumn("score", rounded(F.col("score"), 6))
        best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), *keys)
        return (
            scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", "rank", *keys, "score")
        )

    def lower_bounds(self, asked: DataFrame, k: int) -> DataFrame:
        """``query_id, bound``: a score that the ``k``-th best chunk reaches at least, from the cells, a
        table of bounded size (the vocabulary times ``LAYERS``)."""
        cells = asked.join(F.broadcast(self.cells.where(F.col("reach") >= k)), "term_no")
        return cells.groupBy("query_id").agg((F.max(F.col("query_weight") * F.col("low")) - SLACK).alias("bound"))


def layered(vectors: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The postings of the vectors with their layer."""
    layer = F.least(F.floor(F.log2("weight") * -2), F.lit(LAYERS - 1)).cast("int")
    entries = F.inline(F.arrays_zip(F.col("term_nos").alias("term_no"), F.col("weights").alias("weight")))
    return vectors.select(*keys, entries).withColumn("layer", F.greatest(layer, F.lit(0)))


def flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column one after the other, and where each row begins."""
    parts = [c for c in column.chunks if len(c)]
    sizes = np.concatenate([[0], *[c.value_lengths().to_numpy(zero_copy_only=False) for c in parts]])
    values = [c.flatten().to_numpy(zero_copy_only=False) for c in parts]
    return np.concatenate(values) if values else np.zeros(0), np.cumsum(sizes).astype(np.int64)


def grouped(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """The rows of the batches, ``size`` at a time."""
    held, rows = [], 0
    for batch in batches:
        while len(batch):
            part = batch.slice(0, size - rows)
            held.append(part)
            rows += len(part)
            batch = batch.slice(len(part))
            if rows == size:
                yield pa.Table.from_batches(held).combine_chunks()
                held, rows = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def blocks(store, root: str, size: int) -> Iterator[pa.Table]:
    """The written queries, at most ``size`` at a time, in the same order at every call."""
    for path in listed(store, root, ".parquet"):
        with store.open_input_file(path) as file:
            for batch in pq.ParquetFile(file).iter_batches(size):
                yield pa.Table.from_batches([batch])


def best_pairs(found: pa.Table, wanted: pa.Table, bound: np.ndarray, rows: int, slack: float):
    """Chunk, query and inner product of the pairs above 0 that reach the query's ``bound`` and its
    ``places``-th best here, and the larger of the two per query; ``rows`` chunks are multiplied at a time."""
    terms, ends = flat(wanted.column("term_nos"))
    factors = flat(wanted.column("weights"))[0]
    places = int(wanted.column("places").to_numpy().max()) if len(bound) else 0
    own, at = np.unique(terms, return_inverse=True)
    matrix = np.zeros((len(own), len(bound)))
    np.add.at(matrix, (at, np.repeat(np.arange(len(bound)), np.diff(ends))), factors)
    entries, begins = flat(found.column("term_nos"))
    weights = flat(found.column("weights"))[0]
    best = np.full((places, len(bound)), -np.inf)
    kept = []
    for low in range(0, len(begins) - 1 if len(own) else 0, rows):
        high = min(low + rows, len(begins) - 1)
        part = slice(begins[low], begins[high])
        place = np.minimum(np.searchsorted(own, entries[part]), len(own) - 1)
        hit = own[place] == entries[part]
        row = np.repeat(np.arange(high - low), np.diff(begins[low : high + 1]))
        dense = np.zeros((high - low, len(own)))
        np.add.at(dense, (row[hit], place[hit]), weights[part][hit])
        scores = dense @ matrix
        both = np.vstack([best, scores])
        best = np.partition(both, len(both) - places, axis=0)[len(both) - places :]
        least = np.maximum(best.min(axis=0) - slack, bound)
        r, q = np.nonzero((scores >= least) & (scores > 0))
        kept.append((r + low, q, scores[r, q]))
    if not kept:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), bound
    r, q, s = (np.concatenate(x) for x in zip(*kept, strict=True))
    least = np.maximum(best.min(axis=0) - slack, bound)
    last = s >= least[q]
    return r[last], q[last], s[last], least
