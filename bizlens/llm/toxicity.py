"""Toxicity by maximum-scoring segments.

Every word has a log-odds score: its share in toxic against other training documents, smoothed by a
Dirichlet prior that is centred on the share of its longer prefix, that one's on its shorter prefix,
and that one's on the class share, so an unseen form of a toxic stem is still recognised. One
linear scan finds all maximal scoring segments of a text. Their scores are made comparable by
extreme-value statistics (lambda and K of a Gumbel law fitted to the best segments of clean
training rows; the rarest sum over the top r segments), and a logistic curve fitted on a second fold of the training rows
turns that statistic into the score.

The fit uses at most about ``TRAIN_ROWS`` labelled rows and ``VOCABULARY`` weights, both
documented bounds of the model; scores cover every word of every text.

Defined results: null and empty texts get the score of a text without any significant passage;
repeated rows give repeated results; rows with null labels or null ids are not learnt from;
without training rows of both labels every score is 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bizlens.llm.common import Hashes, fold, joined, mixed, runs, slices, small_batches, table
from bizlens.llm.quality import platt, sample

TRAIN_ROWS = 20_000
VOCABULARY = 1 << 16
PRIOR = 5.0
PREFIXES = (4, 5)
DRIFT = 0.7
MOST, LEAST = 6.0, -2.0
PREDICT_FROM = 0.7
TOP = 8
LETTER = np.isin(np.arange(256), list(range(97, 123)) + list(range(128, 256)))
RESULT = "doc_id long, held_out boolean, score double, predicted int, passages array<struct<begin:int,end:int,score:double>>"


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of every word and of its prefixes (short to long), and its begin, end and row."""
    begin, end, row = runs(LETTER[data], offsets)
    hashes = Hashes(data)
    levels = [
        mixed(hashes(begin, np.minimum(end, begin + size)) + np.uint64(size)) for size in PREFIXES
    ]
    return [*levels, hashes(begin, end)], begin, end, row


def lowered(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return joined(pc.utf8_lower(pc.fill_null(column, "").cast(pa.large_string())))


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per hash of each level: toxic and all texts that hold it, and the neighbour pairs it was
    seen between, as a set of 64 hashed bits for toxic and for clean texts."""
    for batch in batches:
        data, offsets = lowered(batch.column("text"))
        label = batch.column("label").to_numpy(zero_copy_only=False).astype(np.int64)
        for low, high in slices(offsets):
            at = offsets[low : high + 1] - offsets[low]
            levels, _, _, row = tokens(data[offsets[low] : offsets[high]], at)
            if not len(row):
                continue
            word = levels[-1]
            beside = np.zeros(len(word) + 2, np.uint64)
            beside[1:-1] = word
            pair = mixed(beside[:-2] * np.uint64(3) + beside[2:]) >> np.uint64(58)
            bit = np.uint64(1) << pair
            toxic = label[low:high][row]
            for level, found in enumerate(levels):
                order = np.argsort(found, kind="stable")
                key, rows = found[order], row[order]
                first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
                text = np.ones(len(key), bool)
                text[1:] = (key[1:] != key[:-1]) | (rows[1:] != rows[:-1])
                bad, bits = toxic[order], bit[order]
                none = np.uint64(0)
                yield pa.RecordBatch.from_pydict(
                    {
                        "level": pa.array(np.full(len(first), level, np.int32)),
                        "hash": pa.array(key[first].view(np.int64)),
                        "toxic": pa.array(np.add.reduceat(text * bad, first)),
                        "texts": pa.array(np.add.reduceat(text.astype(np.int64), first)),
                        "bad_bits": pa.array(
                            np.bitwise_or.reduceat(np.where(bad == 1, bits, none), first).view(np.int64)
                        ),
                        "good_bits": pa.array(
                            np.bitwise_or.reduceat(np.where(bad == 0, bits, none), first).view(np.int64)
                        ),
                    }
                )


def independent(texts: Column, bits: Column) -> Column:
    """Texts counted once per neighbour pair (linear counting over 64 bits), so that copies of one
    passage count as one; above 56 bits a word is common and the plain count is kept."""
    free = 64 - F.bit_count(bits)
    estimate = F.greatest(F.round(-64 * F.log(free / 64)), F.lit(0))
    return F.when(free <= 8, texts).otherwise(F.least(texts, estimate)).cast("long")


@dataclass
class Weights:
    """Sorted hashes with scores, per level from the shortest prefix to the whole word."""

    keys: list[np.ndarray]
    shares: list[np.ndarray]
    base: float

    def scores(self, levels: list[np.ndarray], row: np.ndarray) -> np.ndarray:
        """The log-odds of the most specific level that the model holds for each word. A word that
        repeats the one before it says nothing new and only pays the drift."""
        share = np.full(len(levels[0]), self.base)
        for keys, values, found in zip(self.keys, self.shares, levels, strict=True):
            if len(keys):
                at = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
                share = np.where(keys[at] == found, values[at], share)
        odds = np.log(share / (1 - share)) - np.log(self.base / (1 - self.base))
        again = np.zeros(len(odds), bool)
        again[1:] = (levels[-1][1:] == levels[-1][:-1]) & (row[1:] == row[:-1])
        return np.where(again, 0.0, np.clip(odds, LEAST, MOST)) - DRIFT


def weights_of(rows: pd.DataFrame, base: float) -> Weights:
    """Posterior shares with the parent's share as the centre of each prior."""
    keys, shares = [], []
    for level in range(len(PREFIXES) + 1):
        part = rows[rows["level"] == level]
        order = np.argsort(part["hash"].to_numpy().view(np.uint64))
        prior = part["prior"].fillna(base).to_numpy()[order]
        toxic, texts = part["toxic"].to_numpy()[order], part["texts"].to_numpy()[order]
        keys.append(part["hash"].to_numpy().view(np.uint64)[order])
        shares.append((toxic + PRIOR * prior) / (texts + PRIOR))
    return Weights(keys, shares, base)


def segments(score: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments [begin, end) of one text, by the linear-time scan."""
    total = np.concatenate([[0.0], np.cumsum(score)])
    stack: list[tuple[int, int, float, float, int]] = []  # begin, end, left, right, previous
    for i in np.flatnonzero(score > 0).tolist():
        begin, left, right = i, total[i], total[i + 1]
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= left:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= right:
                stack.append((begin, i + 1, left, right, j))
                break
            begin, left = stack[j][0], stack[j][2]
            del stack[j:]
    return [(b, e, right - left) for b, e, left, right, _ in stack]


@dataclass
class Calibration:
    rate: float  # lambda
    scale: float  # K
    slope: float
    shift: float

    def significance(self, found: list[float], words: int) -> float:
        """How rare the rarest sum of the top r segments is: their normalised scores add up, and
        each further segment pays for the freedom to choose it (the log T term of the sum law)."""
        best, total = 0.0, 0.0
        size = np.log(self.scale * max(words, 2))
        for r, score in enumerate(sorted(found, reverse=True)[:TOP], 1):
            total += max(self.rate * score - size, 0.0)
            best = max(best, total - (r - 1) * np.log(max(total, np.e)))
        return best


def evidence(batches: Iterator[pa.RecordBatch], weights) -> Iterator[pa.RecordBatch]:
    """Per training row its label, number of words and best segment scores."""
    for batch in batches:
        data, offsets = lowered(batch.column("text"))
        label = batch.column("label").to_pylist()
        for low, high in slices(offsets):
            at = offsets[low : high + 1] - offsets[low]
            levels, _, _, row = tokens(data[offsets[low] : offsets[high]], at)
            score = weights.scores(levels, row)
            cut = np.searchsorted(row, np.arange(high - low + 1))
            for i in range(high - low):
                own = score[cut[i] : cut[i + 1]]
                found = sorted((s for _, _, s in segments(own)), reverse=True)[:TOP]
                yield pa.RecordBatch.from_pydict(
                    {
                        "label": pa.array([label[low + i]], pa.int32()),
                        "words": pa.array([len(own)], pa.int64()),
                        "found": pa.array([found], pa.list_(pa.float64())),
                    }
                )


def calibrated(rows: pd.DataFrame) -> Calibration:
    clean = rows[rows["label"] == 0]
    best = np.array([f[0] if len(f) else 0.0 for f in clean["found"]])
    size = np.log(np.maximum(clean["words"].to_numpy(), 2))
    # a Gumbel maximum has quartiles 1.5725 / lambda apart and its median at (ln(K m) + 0.3665) / lambda
    spread = np.subtract(*np.percentile(best, [75, 25])) if len(best) else 1.0
    rate = float(np.clip(1.5725 / max(spread, 1e-9), 0.5, 5.0))
    scale = float(np.exp(np.median(rate * best - 0.3665 - size))) if len(best) else 1.0
    draft = Calibration(rate, scale, 1.0, 0.0)
    x = np.array([draft.significance(list(f), w) for f, w in zip(rows["found"], rows["words"], strict=True)])
    slope, shift = platt(np.log1p(x), rows["label"].to_numpy())
    return Calibration(rate, scale, slope, shift)


def scored(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    fields = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
    for batch in batches:
        n = batch.num_rows
        chance, passages = np.zeros(n), [[] for _ in range(n)]
        if model:
            weights, curve = model
            data, offsets = lowered(batch.column("text"))
            for low, high in slices(offsets):
                at = offsets[low : high + 1] - offsets[low]
                levels, _, _, row = tokens(data[offsets[low] : offsets[high]], at)
                score = weights.scores(levels, row)
                cut = np.searchsorted(row, np.arange(high - low + 1))
                for i in range(high - low):
                    own = score[cut[i] : cut[i + 1]]
                    found = segments(own)
                    x = curve.significance([s for _, _, s in found], len(own))
                    z = curve.slope * np.log1p(x) + curve.shift
                    chance[low + i] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                    floor = np.log(curve.scale * max(len(own), 2)) + 3.0
                    passages[low + i] = [
                        {"begin": b, "end": e, "score": s} for b, e, s in found if curve.rate * s > floor
                    ]
        out = {"doc_id": batch.column("doc_id").cast(pa.int64()), "held_out": batch.column("held_out")}
        out |= {"score": pa.array(chance), "predicted": pa.array((chance >= PREDICT_FROM).astype(np.int32))}
        out["passages"] = pa.array(passages, fields)
        yield pa.RecordBatch.from_pydict(out)


def learnt(docs: DataFrame, labels: DataFrame) -> tuple[Weights, Calibration] | None:
    """Weights from three quarters of the sampled training rows, the curve from the rest."""
    rows = sample(docs, labels.where(fold("doc_id", 3) != 1), "toxic", TRAIN_ROWS)
    second = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(4)) == 0
    first_rows = rows.where(~second).select("text", "label")
    found = (
        first_rows.mapInArrow(
            counted, "level int, hash long, toxic long, texts long, bad_bits long, good_bits long"
        )
        .groupBy("level", "hash")
        .agg(
            F.sum("toxic").alias("toxic"), F.sum("texts").alias("texts"),
            F.bit_or("bad_bits").alias("bad_bits"), F.bit_or("good_bits").alias("good_bits"),
        )
        .select(
            "level", "hash", independent(F.col("toxic"), F.col("bad_bits")).alias("toxic"),
            independent(F.col("texts") - F.col("toxic"), F.col("good_bits")).alias("clean"),
        )
        .select("level", "hash", "toxic", (F.col("toxic") + F.col("clean")).alias("texts"))
    )
    # the share of the sample that the vocabulary bound admits, by strength of evidence
    totals = found.where(F.col("level") == len(PREFIXES)).agg(
        F.sum("toxic").alias("toxic"), F.sum("texts").alias("texts")
    ).toPandas().fillna(0)
    if not 0 < totals["toxic"].iloc[0] < totals["texts"].iloc[0]:
        return None
    base = float(totals["toxic"].iloc[0] / totals["texts"].iloc[0])
    excess = F.abs(F.col("toxic") - base * F.col("texts")) / F.sqrt(base * F.col("texts"))
    kept = found.where(F.col("texts") >= 2).orderBy(F.desc(excess), "level", "hash").limit(VOCABULARY).toPandas()
    weights = weights_of(linked(first_rows, kept, base), base)
    facts = rows.where(second).select("text", "label").mapInArrow(
        lambda b: evidence(b, weights), "label int, words long, found array<double>"
    ).toPandas()
    if facts["label"].nunique() < 2:
        facts = first_rows.mapInArrow(
            lambda b: evidence(b, weights), "label int, words long, found array<double>"
        ).toPandas()
    return weights, calibrated(facts)


def linked(rows: DataFrame, kept: pd.DataFrame, base: float) -> pd.DataFrame:
    """Each kept hash with the posterior share of its parent prefix as its prior."""
    keys = [
        np.sort(kept.loc[kept["level"] == level, "hash"].to_numpy().view(np.uint64))
        for level in range(len(PREFIXES) + 1)
    ]

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = lowered(batch.column("text"))
            out = []
            for low, high in slices(offsets):
                at = offsets[low : high + 1] - offsets[low]
                levels = tokens(data[offsets[low] : offsets[high]], at)[0]
                for level in range(1, len(levels)):
                    if not len(keys[level]):
                        continue
                    spot = np.minimum(np.searchsorted(keys[level], levels[level]), len(keys[level]) - 1)
                    known = keys[level][spot] == levels[level]
                    part = pd.DataFrame({"hash": levels[level][known].view(np.int64)})
                    for up in range(level):
                        part[f"up{up}"] = levels[up][known].view(np.int64)
                    part["level"] = np.int32(level)
                    out.append(part.drop_duplicates())
            if out:
                whole = pd.concat(out).drop_duplicates()
                for up in range(len(PREFIXES)):
                    whole[f"up{up}"] = whole.get(f"up{up}", pd.Series(dtype=float)).astype("Int64")
                names = ["level", "hash", *[f"up{u}" for u in range(len(PREFIXES))]]
                yield pa.RecordBatch.from_pandas(whole[names], preserve_index=False)

    schema = "level int, hash long, " + ", ".join(f"up{u} long" for u in range(len(PREFIXES)))
    links = rows.select("text").mapInArrow(pairs, schema).distinct().toPandas()
    posterior: dict[tuple[int, int], float] = {}
    kept = kept.merge(links, on=["level", "hash"], how="left").sort_values("level")
    priors = []
    for row in kept.itertuples(index=False):
        prior = base
        for up in range(int(row.level)):
            above = getattr(row, f"up{up}")
            if not pd.isna(above):
                prior = posterior.get((up, int(above)), prior)
        priors.append(prior)
        posterior[(int(row.level), int(row.hash))] = (row.toxic + PRIOR * prior) / (row.texts + PRIOR)
    return kept.assign(prior=priors).drop_duplicates(["level", "hash"])


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    small_batches(docs.sparkSession)
    model = learnt(docs, labels)
    part = docs.select("doc_id", "text", (fold("doc_id", 3) == 1).alias("held_out"))
    return part.mapInArrow(lambda b: scored(b, model), RESULT)


def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))
