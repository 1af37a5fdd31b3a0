"""Embedders: anything with ``fit`` and ``encode`` turns rows into vectors.

``fit(docs)`` sees the whole document table and returns the embedder to use; ``state()`` is what a
worker needs to encode (small, fixed in size) and travels with the task; ``load(state)`` runs once in a
worker process, so a heavy model is opened once; ``encode`` takes the values of the column that the
embedder ``reads`` and returns one row of ``dim`` numbers for each.
"""

from __future__ import annotations

import hashlib
import sys
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from typing import Any, ClassVar, Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bizlens.functions.text import chunk_documents
from bizlens.operators import retrieval

ENCODED_ROWS = 2048


class Embedder(Protocol):
    reads: str
    dim: int

    def fit(self, docs: DataFrame) -> "Embedder": ...

    def state(self) -> Any: ...

    def load(self, state: Any) -> Callable[[Sequence], np.ndarray]: ...


def loaded(key: str, build: Callable[[], Any]) -> Any:
    """One opened embedder per worker process and fit."""
    kept = sys.__dict__.setdefault("_embedders", {})
    if key not in kept:
        kept.clear()
        kept[key] = build()
    return kept[key]


def embed(rows: DataFrame, keys: Sequence[str], embedder: Embedder) -> DataFrame:
    """The keys and ``embedding`` of every row, encoded in Arrow batches. A null or empty value has the
    vector of an empty one. An embedder with ``arrow`` is given the Arrow column instead of a list."""
    state, key, reads, keys = embedder.state(), uuid.uuid4().hex, embedder.reads, list(keys)
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keys)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = loaded(key, lambda: embedder.load(state))
        for batch in batches:
            for start in range(0, batch.num_rows, ENCODED_ROWS):
                part = batch.slice(start, ENCODED_ROWS)
                given = part.column(reads)
                given = given if getattr(embedder, "arrow", False) else given.to_pylist()
                vectors = np.asarray(run(given), np.float32)
                flat = pa.array(vectors.reshape(-1))
                ends = pa.array(np.arange(len(vectors) + 1, dtype=np.int32) * vectors.shape[1])
                columns = [part.column(c) for c in keys]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.ListArray.from_arrays(ends, flat)], names=[*keys, "embedding"]
                )

    return rows.select(*keys, reads).mapInArrow(encode, f"{kinds}, embedding array<float>")


def numbered(values: pa.Array | Sequence) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The terms of all rows: row, number, and the terms by number."""
    given = values if isinstance(values, pa.Array) else pa.array(list(values), pa.list_(pa.string()))
    return retrieval.numbered(given)


@dataclass
class HashingEmbedder:
    """Counts of terms in ``dim`` places chosen by a hash of the term, with a sign from the same hash,
    so that collisions cancel rather than add up. Needs no fit."""

    dim: int = 64
    reads: str = "terms"
    arrow: ClassVar[bool] = True

    def fit(self, docs: DataFrame) -> "HashingEmbedder":
        return self

    def state(self) -> int:
        return self.dim

    def load(self, state: int) -> Callable[[Sequence], np.ndarray]:
        known: dict[str, tuple[int, int]] = {}

        def place(term: str) -> tuple[int, int]:
            if term not in known:
                if len(known) > 200_000:
                    known.clear()
                digest = hashlib.md5(term.encode()).hexdigest()
                known[term] = int(digest[:4], 16) % state, 1 if int(digest[4], 16) < 8 else -1
            return known[term]

        def run(values: pa.Array | Sequence) -> np.ndarray:
            row, term, names = numbered(values)
            spots = np.array([place(name) for name in names.to_pylist()], np.int64).reshape(-1, 2)
            cells = row * state + spots[term, 0]
            signs = spots[term, 1].astype(np.float64)
            out = np.bincount(cells, weights=signs, minlength=len(values) * state)
            return out.reshape(len(values), state).astype(np.float32)

        return run


@dataclass
class TfidfEmbedder:
    """Dense unit vectors of the ``size`` most frequent terms, weighted by term frequency and idf. The
    state is the fitted vocabulary."""

    size: int = 256
    reads: str = "terms"
    terms: list[tuple[str, float]] = field(default_factory=list)
    arrow: ClassVar[bool] = True

    @property
    def dim(self) -> int:
        return len(self.terms)

    def fit(self, docs: DataFrame) -> "TfidfEmbedder":
        words = retrieval.vocabulary(chunk_documents(docs), self.size)
        idf = F.log((F.lit(1.0) + F.col("chunks")) / (F.lit(1.0) + F.col("df"))) + F.lit(1.0)
        rows = words.withColumn("chunks", retrieval.total_chunks(docs).scalar()).orderBy("term_no")
        # at most ``size`` rows
        return TfidfEmbedder(self.size, self.reads, [tuple(r) for r in rows.select("term", idf).collect()])

    def state(self) -> list[tuple[str, float]]:
        return self.terms

    def load(self, state: list[tuple[str, float]]) -> Callable[[Sequence], np.ndarray]:
        places = {term: k for k, (term, _) in enumerate(state)}
        idf = np.array([weight for _, weight in state])

        def run(values: pa.Array | Sequence) -> np.ndarray:
            row, term, names = numbered(values)
            spots = np.array([places.get(name, -1) for name in names.to_pylist()], np.int64)[term]
            known = spots >= 0
            cells = row[known] * len(state) + spots[known]
            out = np.bincount(cells, minlength=len(values) * len(state)).reshape(len(values), len(state)) * idf
            return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-300)

        return run
