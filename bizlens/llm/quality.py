"""Quality rules: exact base counts, and a calibrated logistic regression over hashed n-grams.

Features of a text are the mean frequencies of its words and of its byte n-grams, hashed into a
fixed number of weights. The regression is trained on a sample of labelled rows of documented size
(``TRAIN_ROWS``), calibrated (Platt) on rows it was not trained on, and scored in Arrow batches
against fixed thresholds. Counts and scores cover the whole text.

Defined results: a null or empty text has no words, fails the base rules and is not kept; a row
with a null doc_id is scored like any other; repeated rows give repeated results; labels that are
null are not learnt from; without rows of both labels the base rules alone decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bizlens.llm.common import (
    Hashes,
    joined,
    mixed,
    row_sums,
    runs,
    slices,
    small_batches,
    table,
)

TRAIN_ROWS = 2400
BITS = 18
GRAM = 4
ROUNDS = 60
KEEP_FROM = 0.5
LEAST_WORDS = 10
REPEAT_PERCENT = 20
WINDOW = 5
SPACE = np.isin(np.arange(256), [0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])
SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))
RESULT = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
    "n_repeat_words long, base_failed boolean, probability double, kept boolean"
)


def repeated(rows: np.ndarray, hashes: np.ndarray, later_only: bool) -> np.ndarray:
    """Which hashes occur twice or more in their row; the first is left out if ``later_only``."""
    key = mixed(hashes + rows.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    marked = np.zeros(len(key), bool)
    marked[order[1:]] = same
    if not later_only:
        marked[order[:-1]] |= same
    return marked


def counts(data: np.ndarray, offsets: np.ndarray) -> tuple[dict[str, np.ndarray], tuple]:
    """The base counts of every row, and the pieces that the features use again."""
    n = len(offsets) - 1
    inside = ~SPACE[data]
    begin, end, row = runs(inside, offsets)
    hashes = Hashes(data)
    word = hashes(begin, end)
    out = {"n_words": np.bincount(row, minlength=n)}
    out["word_chars"] = row_sums(inside & ((data & 0xC0) != 0x80), offsets).astype(np.int64)
    out["n_symbols"] = row_sums(SYMBOL[data], offsets).astype(np.int64)
    lb, le, lr = runs(data != 0x0A, offsets)
    held = np.concatenate([[0], np.cumsum(inside)])
    wordy = held[le] > held[lb]
    lb, le, lr = lb[wordy], le[wordy], lr[wordy]
    dup = repeated(lr, hashes(lb, le), later_only=True)
    out["n_dup_lines"] = np.bincount(lr[dup], minlength=n)
    cover = np.zeros(len(word), bool)
    m = len(word) - WINDOW + 1
    if m > 0:
        window = np.zeros(m, np.uint64)
        for k in range(WINDOW):
            window = mixed(window + word[k : m + k])
        whole = np.flatnonzero(row[:m] == row[WINDOW - 1 :])
        twice = whole[repeated(row[whole], window[whole], later_only=False)]
        for k in range(WINDOW):
            cover[twice + k] = True
    out["n_repeat_words"] = np.bincount(row[cover], minlength=n)
    return out, (hashes, word, row)


def slots(pieces: tuple, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weight slots of the words, and of the n-gram at each byte with whether it is whole."""
    hashes, word, _ = pieces
    shift = np.uint64(64 - BITS)
    grams = hashes.grams(GRAM)
    whole = np.zeros(len(hashes.sums) - 1, bool)
    whole[: len(grams)] = True
    for k in range(1, GRAM):
        cut = offsets[1:] - k
        whole[cut[cut >= offsets[:-1]]] = False
    slot = np.zeros(len(whole), np.int64)
    slot[: len(grams)] = (mixed(grams + np.uint64(1)) >> shift).astype(np.int64)
    return (word >> shift).astype(np.int64), slot, whole


def logits(pieces: tuple, offsets: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Bias, mean weight of the words and mean weight of the n-grams, per row."""
    n = len(offsets) - 1
    word_slot, gram_slot, whole = slots(pieces, offsets)
    row = pieces[2]
    words = np.bincount(row, weights=weights[0][word_slot], minlength=n)
    grams = row_sums(np.where(whole, weights[1][gram_slot], 0.0), offsets)
    many = np.maximum(row_sums(whole, offsets), 1)
    return weights[2][0] + words / np.maximum(np.bincount(row, minlength=n), 1) + grams / many


def sample(docs: DataFrame, labels: DataFrame, column: str, rows: int) -> DataFrame:
    """About ``rows`` labelled documents, chosen by a hash of their id, at most twice as many."""
    known = labels.where(F.col(column).isNotNull() & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(F.max(column).cast("int").alias("label"))
    total = known.count()
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000))
    part = known.where(slot < int(1_000_000 * min(1.0, rows / max(total, 1))) + 1)
    chosen = F.broadcast(part.limit(2 * rows))
    return docs.select("doc_id", "text").join(chosen, "doc_id")


def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = joined(batch.column("text"))
        label = batch.column("label").to_pylist()
        held = batch.column("held").to_pylist()
        for i in range(batch.num_rows):
            own = data[offsets[i] : offsets[i + 1]]
            at = np.array([0, len(own)])
            _, pieces = counts(own, at)
            word_slot, gram_slot, whole = slots(pieces, at)
            w, wn = np.unique(word_slot, return_counts=True)
            g, gn = np.unique(gram_slot[whole], return_counts=True)
            slot = np.concatenate([w, g + (1 << BITS)]).astype(np.int32)
            value = np.concatenate([wn / max(wn.sum(), 1), gn / max(gn.sum(), 1)])
            yield pa.RecordBatch.from_pydict(
                {
                    "label": pa.array([label[i]], pa.int32()),
                    "held": pa.array([held[i]], pa.bool_()),
                    "slot": pa.array([slot.tobytes()], pa.binary()),
                    "value": pa.array([value.astype(np.float32).tobytes()], pa.binary()),
                }
            )


def fit(rows: pd.DataFrame) -> tuple[np.ndarray, float, float] | None:
    """Weights, and the slope and intercept of the calibration; None without both labels."""
    if rows["label"].nunique() < 2:
        return None
    train = rows[~rows["held"]] if rows.loc[~rows["held"], "label"].nunique() == 2 else rows
    weights = descend(train)
    rest = rows[rows["held"]] if rows.loc[rows["held"], "label"].nunique() == 2 else rows
    slope, shift = platt(scores(rest, weights), rest["label"].to_numpy())
    return weights, slope, shift


def unpacked(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    slot = np.concatenate([np.frombuffer(x, np.int32) for x in rows["slot"]])
    value = np.concatenate([np.frombuffer(x, np.float32) for x in rows["value"]])
    sizes = [len(x) // 4 for x in rows["slot"]]
    return np.repeat(np.arange(len(rows)), sizes), slot, value


def scores(rows: pd.DataFrame, weights: np.ndarray) -> np.ndarray:
    row, slot, value = unpacked(rows)
    return weights[-1] + np.bincount(row, value * weights[slot], minlength=len(rows))


def descend(rows: pd.DataFrame, rate: float = 0.5) -> np.ndarray:
    """Full-batch logistic regression with per-weight step sizes and balanced labels."""
    row, slot, value = unpacked(rows)
    y = rows["label"].to_numpy(float)
    share = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9)) / len(y)
    weights = np.zeros((2 << BITS) + 1)
    seen = np.full(len(weights), 1e-12)
    for _ in range(ROUNDS):
        z = weights[-1] + np.bincount(row, value * weights[slot], minlength=len(y))
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * share
        grad = np.bincount(slot, value * error[row], minlength=len(weights)) + 1e-7 * weights
        grad[-1] = error.sum()
        seen += grad * grad
        weights -= rate * grad / np.sqrt(seen)
    return weights


def platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept by Newton steps, with Platt's smoothed targets."""
    ones, noughts = float((y == 1).sum()), float((y != 1).sum())
    target = np.where(y == 1, (ones + 1) / (ones + 2), 1 / (noughts + 2))
    x = np.column_stack([z, np.ones_like(z)])
    beta, damp = np.array([1.0, 0.0]), 1e-3

    def loss(b: np.ndarray) -> float:
        u = x @ b
        return float((np.logaddexp(0, u) - target * u).sum() + 5e-4 * ((b - [1.0, 0.0]) ** 2).sum())

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        hess = (x * (p * (1 - p))[:, None]).T @ x + damp * np.eye(2)
        step = np.linalg.solve(hess, x.T @ (p - target) + 1e-3 * (beta - [1.0, 0.0]))
        if loss(beta - step) <= loss(beta):
            beta, damp = beta - step, max(damp / 10, 1e-6)
        else:
            damp *= 10
    return max(float(beta[0]), 1e-3), float(beta[1])


def scored(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    if model:
        weights, slope, shift = model.value
        size = 1 << BITS
        parts = (weights[:size], weights[size:-1], weights[-1:])
    for batch in batches:
        data, offsets = joined(batch.column("text"))
        for low, high in slices(offsets):
            at = offsets[low : high + 1] - offsets[low]
            own = data[offsets[low] : offsets[high]]
            base, pieces = counts(own, at)
            p = np.ones(high - low)
            if model:
                z = slope * logits(pieces, at, parts) + shift
                p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            words, repeats = base["n_words"], base["n_repeat_words"]
            failed = (words < LEAST_WORDS) | (100 * repeats > REPEAT_PERCENT * words)
            out = {"doc_id": batch.column("doc_id").slice(low, high - low).cast(pa.int64())}
            out |= {k: pa.array(v, pa.int64()) for k, v in base.items()}
            out |= {"base_failed": pa.array(failed), "probability": pa.array(p)}
            out["kept"] = pa.array(~failed & (p >= KEEP_FROM))
            yield pa.RecordBatch.from_pydict(out)


def quality(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """Base counts, base_failed, the probability of good quality, and kept, per document."""
    spark = docs.sparkSession
    small_batches(spark)
    held = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(4)) == 0
    rows = (
        sample(docs, labels, "quality", train_rows)
        .select("text", "label", held.alias("held"))
        .mapInArrow(featured, "label int, held boolean, slot binary, value binary")
        .toPandas()
    )
    fitted = fit(rows) if len(rows) else None
    model = spark.sparkContext.broadcast(fitted) if fitted else None
    return docs.select("doc_id", "text").mapInArrow(lambda b: scored(b, model), RESULT)


def op9_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality(table(spark, folder, "documents"), table(spark, folder, "labels"))
