"""TF-IDF postings and exact top-k retrieval over a document table.

Text is searched through an impact-ordered index (``impacts.py``): queries stay a table, and blocks of
them meet groups of chunk vectors under bounds from the index. Dense vectors are searched by blocks of
queries against groups of vectors; tasks send the best ``k`` per query.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from bizlens.functions.exact import rounded
from bizlens.functions.text import (
    STOP_WORDS, chunk_at, chunk_count, chunk_documents, clean, strip, tokens,
)
from bizlens.operators.impacts import ImpactIndex
from bizlens.session import BROADCAST_ROWS, pinned, scratch_path, small_side

# Fixed value: size of the vocabulary.
VOCABULARY = 2048
# Rows of a block: dense queries and vectors of one matrix product.
QUERY_BLOCK = 1024
# Chunks whose words a task counts at a time.
COUNTED_ROWS = 16_384
VECTOR_GROUP = 8192
# Ids of documents, one number each, that a lookup may send to every task.
NAMED_DOCS = 1_000_000
CHUNK = ["doc_id", "chunk_no"]


def numbered(words: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The words of all lists in order: the list each stands in, its number, and the words by number."""
    lengths = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False)
    coded = words.flatten().dictionary_encode()
    return (
        np.repeat(np.arange(len(words)), lengths), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64),
        coded.dictionary,
    )


def term_numbers(owner: np.ndarray, word: np.ndarray, distinct: int) -> tuple[np.ndarray, np.ndarray]:
    """The words and, behind them, each pair of neighbours in a list: their lists and numbers. A pair has
    the number ``distinct`` and up, whose quotient and remainder by ``distinct`` tell its words."""
    same = owner[1:] == owner[:-1]
    pairs = (word[:-1] + 1) * distinct + word[1:]
    return np.concatenate([owner, owner[1:][same]]), np.concatenate([word, pairs[same]])


def spelled(terms: np.ndarray, names: pa.Array) -> pa.Array:
    """Words and pairs by their numbers, in the order of ``terms``, which is ascending."""
    distinct = len(names)
    cut = np.searchsorted(terms, distinct)
    pairs = terms[cut:]
    second = names.take(pa.array(pairs % max(distinct, 1)))
    first = names.take(pa.array(pairs // max(distinct, 1) - 1))
    return pa.concat_arrays([names.take(pa.array(terms[:cut])), pc.binary_join_element_wise(first, second, " ")])


def counted_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``term, n, first``: occurrences of a term and lists that hold it, per batch."""
    for batch in batches:
        for low in range(0, batch.num_rows, COUNTED_ROWS):
            owner, word, names = numbered(batch.column("words").slice(low, COUNTED_ROWS))
            owner, term = term_numbers(owner, word, len(names))
            found, place, n = np.unique(term, return_inverse=True, return_counts=True)
            cells = np.sort(place * COUNTED_ROWS + owner)
            new = np.append(True, cells[1:] != cells[:-1])[: len(cells)]
            first = np.bincount(cells[new] // COUNTED_ROWS, minlength=len(found))
            yield pa.RecordBatch.from_arrays(
                [spelled(found, names).cast(pa.string()), pa.array(n, pa.int64()), pa.array(first, pa.int64())],
                names=["term", "n", "first"],
            )


def known_terms(words: pa.Array, names: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The terms of each list that stand in ``names``: list, place in ``names``, occurrences."""
    owner, word, own = numbered(words)
    split = [term.partition(" ") for term in names.to_pylist()]
    place = {word: k for k, word in enumerate(own.to_pylist())}
    distinct, wanted = len(own), []
    for k, (first, pair, second) in enumerate(split):
        if first in place and (not pair or second in place):
            at = (place[first] + 1) * distinct + place[second] if pair else place[first]
            wanted.append((at, k))
    keys = np.array(sorted(wanted), np.int64).reshape(-1, 2)
    owner, term = term_numbers(owner, word, distinct)
    spot = np.minimum(np.searchsorted(keys[:, 0], term), max(len(keys) - 1, 0))
    hit = keys[spot, 0] == term if len(keys) else np.zeros(len(term), bool)
    size = max(len(names), 1)
    cells = np.sort(owner[hit] * size + keys[spot[hit], 1])
    starts = np.flatnonzero(np.append(True, cells[1:] != cells[:-1])[: len(cells)])
    found, n = cells[starts], np.diff(np.append(starts, len(cells)))
    return found // size, found % size, n


def vocabulary(
    chunks: DataFrame, size: int = VOCABULARY, stop_words: Sequence[str] = STOP_WORDS
) -> DataFrame:
    """The most frequent terms, ties by term, with the number of chunks that hold each. Tasks count
    both for batches of chunks, so that a row leaves them per term and batch, not per occurrence."""
    return (
        chunks.select(tokens(F.col("text"), stop_words).alias("words"))
        .mapInArrow(counted_terms, "term string, n long, first long")
        .groupBy("term")
        .agg(F.sum("n").alias("total"), F.sum("first").alias("df"))
        .orderBy(F.col("total").desc(), "term")
        .limit(size)
        .withColumn("term_no", F.row_number().over(Window.orderBy(F.col("total").desc(), "term")) - 1)
    )


def total_chunks(docs: DataFrame) -> DataFrame:
    return docs.agg(F.sum(chunk_count(clean(F.col("text")))).alias("chunks"))


def unit_weights(
    texts: DataFrame, owner: Sequence[str], terms: DataFrame, stop_words: Sequence[str] = STOP_WORDS
) -> DataFrame:
    """``owner, term, term_no, tf, weight``: tf times idf, scaled to unit length per owner. The
    vocabulary has at most ``VOCABULARY`` rows, hence the broadcast. Tasks count the terms of each
    text by number; one shuffle of these counts by owner serves both the sum and the length."""
    owner = list(owner)
    known = [(r["term"], r["term_no"]) for r in terms.select("term", "term_no").collect()]
    names = pa.array([term for term, _ in known], pa.string())
    numbers = np.array([number for _, number in known], np.int64)
    kept = StructType(
        [texts.schema[c] for c in owner] + [StructField("term_no", terms.schema["term_no"].dataType), StructField("n", LongType())]
    )

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, term, n = known_terms(batch.column("_words"), names)
            columns = [batch.column(c).take(pa.array(row)) for c in owner]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(numbers[term].astype(np.int32)), pa.array(n, pa.int64())],
                names=[*owner, "term_no", "n"],
            )

    counts = (
        texts.select(*owner, tokens(F.col("text"), stop_words).alias("_words"))
        .mapInArrow(counted, kept)
        .repartition(*owner)
        .groupBy(*owner, "term_no")
        .agg(F.sum("n").alias("tf"))
        .join(F.broadcast(terms.select("term", "term_no", "idf")), "term_no")
        .withColumn("_w", F.col("tf") * F.col("idf"))
    )
    length = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy(*owner)))
    return counts.select(*owner, "term", "term_no", "tf", (F.col("_w") / length).alias("weight"))


@dataclass
class TextIndex:
    """A fitted corpus: the documents, ``term, term_no, total, df, idf``, and the postings
    ``doc_id, chunk_no, term, term_no, tf, weight``."""

    docs: DataFrame
    vocabulary: DataFrame
    weights: DataFrame
    stop_words: Sequence[str] = tuple(STOP_WORDS)

    @classmethod
    def fit(
        cls, docs: DataFrame, size: int = VOCABULARY, stop_words: Sequence[str] = STOP_WORDS
    ) -> "TextIndex":
        """Fix the vocabulary; the postings stay lazy."""
        chunks = chunk_documents(docs)
        idf = F.log((F.lit(1.0) + F.col("_chunks")) / (F.lit(1.0) + F.col("df"))) + F.lit(1.0)
        terms = pinned(
            vocabulary(chunks, size, stop_words)
            .withColumn("_chunks", total_chunks(docs).scalar())
            .withColumn("idf", idf)
            .drop("_chunks")
        )
        return cls(docs, terms, unit_weights(chunks, CHUNK, terms, stop_words), tuple(stop_words))

    def save(self, path: str) -> "TextIndex":
        """Write the index and return it as read back, so later queries scan the stored postings."""
        self.vocabulary.write.mode("overwrite").parquet(f"{path}/vocabulary")
        self.weights.write.mode("overwrite").parquet(f"{path}/weights")
        return self.load(self.docs, path, self.stop_words)

    @classmethod
    def load(cls, docs: DataFrame, path: str, stop_words=STOP_WORDS) -> "TextIndex":
        spark = docs.sparkSession
        return cls(
            docs,
            spark.read.parquet(f"{path}/vocabulary"),
            spark.read.parquet(f"{path}/weights").repartition(*CHUNK),
            tuple(stop_words),
        )

    @cached_property
    def impacts(self) -> ImpactIndex:
        """The postings in impact order, written once in the shared folder and read by every search."""
        return ImpactIndex.write(self.weights, CHUNK, scratch_path(self.docs.sparkSession, "impacts"))

    def retrieve(self, queries: DataFrame, k: int = 4) -> DataFrame:
        """The ``k`` best chunks of every query by inner product, ties by chunk. Hits share at
        least one term with the query, so their score is above zero."""
        asked = unit_weights(queries, ["query_id"], self.vocabulary, self.stop_words)
        return self.impacts.search(
            asked.select("query_id", F.col("term_no").cast("int").alias("term_no"), F.col("weight").alias("query_weight")), k
        )

    def with_text(self, hits: DataFrame) -> DataFrame:
        """Look up source and text of the hits; only their documents are cut again. The hits are
        counted first, so that a few of them do not make Spark shuffle all texts; where there are many,
        the texts that none of them is in stay behind, as long as the others' ids are few enough."""
        hits, docs = small_side(hits), self.docs.select("doc_id", "source", "text")
        if hits.count() > BROADCAST_ROWS:
            docs = docs.join(small_side(hits.select("doc_id").distinct(), NAMED_DOCS), "doc_id", "left_semi")
        return hits.join(docs, "doc_id").withColumn("text", chunk_at(clean(F.col("text")), F.col("chunk_no")))

    def evidence(self, queries: DataFrame, k: int = 4, excerpt: int = 300) -> DataFrame:
        """Per query the ranked list of source, excerpt and score, and its distinct sources."""
        hits = self.with_text(self.retrieve(queries, k))
        entry = F.struct(
            F.col("rank"),
            F.col("source"),
            strip(F.substring("text", 1, excerpt)).alias("excerpt"),
            rounded(F.col("score"), 3).alias("relevance_score"),
        )
        return hits.groupBy("query_id").agg(
            F.array_sort(F.collect_list(entry)).alias("evidence"),
            F.array_sort(F.collect_set("source")).alias("sources"),
        )


def unit_rows(frame: pd.DataFrame) -> np.ndarray:
    """Dense vectors of a batch, scaled to unit length."""
    rows = np.vstack(frame["embedding"].to_numpy()).astype(np.float64)
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-300)


def vector_topk(
    vectors: DataFrame, queries: DataFrame, k: int = 4, block: int = QUERY_BLOCK, group: int = VECTOR_GROUP
) -> DataFrame:
    """The ``k`` nearest vectors of every query by cosine, ties by id. ``vectors``: ``vec_id,
    embedding``; ``queries``: ``query_id, embedding``. Vectors are dealt by hash into groups of about
    ``group`` and queries into blocks of about ``block`` rows; every pair of the two is one matrix
    product, of which the best ``k`` per query leave the task."""
    asked = pinned(queries.select("query_id", "embedding"))
    # counted, then dealt: vectors that are computed, not stored, are so only once
    kept = pinned(vectors.select("vec_id", "embedding").where(F.col("embedding").isNotNull()))
    blocks = max(1, -(-asked.count() // block))
    groups = max(1, -(-kept.count() // group))
    kind = queries.schema["query_id"].dataType.simpleString()
    spread = kept.withColumn("_group", F.pmod(F.xxhash64("vec_id"), F.lit(groups))).withColumn(
        "_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    )
    sent = asked.withColumn("_block", F.pmod(F.xxhash64("query_id"), F.lit(blocks))).withColumn(
        "_group", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long")))
    )
    names = ["query_id", "vec_id", "score"]

    def best(found: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        if not len(found) or not len(wanted):
            return pd.DataFrame({c: [] for c in names})
        # ranked at 6 places, so that ties do not hang on the last bit of a sum
        scores = np.round(unit_rows(found) @ unit_rows(wanted).T, 6)
        least = np.partition(scores, -min(k, len(scores)), axis=0)[-min(k, len(scores))]
        row, query = np.nonzero(scores >= least)
        ids = found["vec_id"].to_numpy()[row]
        order = np.lexsort((ids, -scores[row, query], query))
        row, query, ids = row[order], query[order], ids[order]
        first = np.searchsorted(query, query)
        top = np.arange(len(query)) - first < k
        return pd.DataFrame(
            {
                "query_id": wanted["query_id"].to_numpy()[query[top]],
                "vec_id": ids[top],
                "score": scores[row[top], query[top]],
            }
        )

    id_kind = vectors.schema["vec_id"].dataType.simpleString()
    found = spread.groupBy("_group", "_block").cogroup(sent.groupBy("_group", "_block")).applyInPandas(
        best, f"query_id {kind}, vec_id {id_kind}, score double"
    )
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def label_centroids(vectors: DataFrame) -> DataFrame:
    """Mean vector per label, summed element by element so that a large label is combined before
    the shuffle."""
    element = (
        vectors.select("label", F.posexplode("embedding").alias("pos", "x"))
        .groupBy("label", "pos")
        .agg(
            (
                F.sum(F.floor(F.col("x").cast("double") * 1e6 + 0.5)).cast("double")
                / F.count(F.lit(1))
            ).alias("x")
        )
    )
    ordered = F.array_sort(F.collect_list(F.struct("pos", "x")))
    return element.groupBy(F.col("label").cast("long").alias("query_id")).agg(
        F.transform(ordered, lambda e: e["x"]).alias("embedding")
    )
