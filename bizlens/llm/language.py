"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built over a bounded sample of labelled text. A text is
parsed against each automaton into longest matches (phrases); the language that needs the fewest
phrases per character wins. Texts are parsed in stretches of ``STRETCH`` characters, which lets a
worker advance thousands of stretches at once with one table lookup per step; a phrase ends with
its stretch, for every language alike, and every character of a text is parsed.

Every language with a labelled text that holds a letter is learnt from distinct texts of any length, in
the order of their hash: short texts whole, of longer ones the ``STRETCH_CHARS`` characters in the
middle. The sample is bounded by ``SAMPLE_ROWS`` texts and ``SAMPLE_CHARS`` characters per language
(documented parameters of training), so the model stays small at any corpus size. All letters of the
sample are told apart.

Defined results: a null text, or one without a letter, gets ``und`` with score 0; ties go to the
language that sorts first; without any labelled row every text gets ``und``; null languages are
not learnt from; repeated rows give repeated results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bizlens.llm.common import fold, held_model, lean, sheltered, small_batches, table

SAMPLE_ROWS = 400
SAMPLE_CHARS = 40_000
STRETCH_CHARS = 4_000
STRETCH = 256
SYMBOLS = 63  # letters with a column in the dense table (0 is the gap between words); the rest are looked up
UNDECIDED = "und"
RESULT = "lang_pred string, score double, phrases double"


def training_sample(docs: DataFrame, learn: Column) -> dict[str, str]:
    """At most ``SAMPLE_ROWS`` distinct texts and ``SAMPLE_CHARS`` characters per language, by text hash."""
    known = docs.where(learn & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    middle = F.greatest(F.floor((F.length("text") - STRETCH_CHARS) / 2), F.lit(0)).cast("int") + 1
    cut = F.substring(F.col("text"), middle, F.lit(STRETCH_CHARS))
    cut = F.when(cut.rlike(r"\p{L}"), cut).otherwise(
        F.substring(F.regexp_replace("text", r"[^\p{L}]+", " "), 1, STRETCH_CHARS)
    )
    known = known.select("lang", F.xxhash64("text").alias("hash"), cut.alias("text"))
    sizes = known.groupBy("lang").agg(F.approx_count_distinct("hash").alias("texts"))
    # twice the texts wanted, so that the estimate leaves enough; copies of a text are met inside the tasks
    slot = F.pmod("hash", F.lit(1 << 40))
    share = F.least(F.lit(1.0), 2 * SAMPLE_ROWS / F.col("texts")) * (1 << 40)
    picked = known.join(F.broadcast(sizes), "lang").where(slot < share)
    picked = picked.groupBy("lang", slot.alias("slot"), "hash").agg(F.first("text").alias("text"))
    order = Window.partitionBy("lang").orderBy("slot", "hash")
    picked = picked.select(
        "lang", "slot", "text", F.row_number().over(order).alias("place"),
        F.sum(F.length("text")).over(order).alias("reach"),
    ).where((F.col("place") <= SAMPLE_ROWS) & (F.col("reach") <= SAMPLE_CHARS))
    texts: dict[str, str] = {}
    for row in sorted(picked.collect(), key=lambda r: (r["lang"], r["place"])):
        held = texts.get(row["lang"], "")
        if row["text"] not in held:
            texts[row["lang"]] = held + " " + row["text"]
    return dict(sorted(texts.items()))


def letters_only(text: str) -> list[str]:
    """Lower-case words of letters."""
    return "".join(c if c.isalpha() else " " for c in text.lower()).split()


class Model:
    """Alphabet and dense automata of the languages; states of all languages share one table."""

    def __init__(self, sample: dict[str, str]):
        self.languages = sorted(sample)
        parts = {k: " ".join(letters_only(v)) for k, v in sample.items()}
        seen: dict[str, int] = {}
        for text in parts.values():
            for c in text:
                seen[c] = seen.get(c, 0) + 1
        seen.pop(" ", None)
        kept = sorted(sorted(seen), key=seen.get, reverse=True)
        self.code = {c: i + 1 for i, c in enumerate(sorted(kept[:SYMBOLS]) + kept[SYMBOLS:])}
        self.width = min(len(kept), SYMBOLS) + 1  # the gap and the frequent letters
        self.other = len(self.code) + 1  # any letter that no language has
        tables, roots, rare, base = [], [], [], 0
        for name in self.languages:
            states, more = automaton([self.code.get(c, 0) for c in parts[name]], self.width)
            states[states >= 0] += base
            tables.append(states)
            rare.append(more + np.array([base, 0, base]))
            roots.append(base)
            base += len(states)
        self.next = np.concatenate(tables).reshape(-1)
        self.roots = np.array(roots, np.int32)
        moves = np.concatenate(rare)
        keys = moves[:, 0] * (self.other + 1) + moves[:, 1]
        order = np.argsort(keys)
        # the last one ends every search
        self.rare = np.append(keys[order], np.iinfo(np.int64).max)
        self.rare_next = np.append(moves[order, 2], -1).astype(np.int32)
        self.lookup = np.zeros(0x110000, np.uint8 if self.other < 256 else np.int32)

        for point in range(0x110000):
            c = chr(point)
            if c.isalpha():
                low = c.lower()
                self.lookup[point] = self.code.get(low[0], self.other)

    def follow(self, states: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Next states (-1: none) of every language's row of states, for one letter per column."""
        dense = np.minimum(codes, self.width - 1)
        to = self.next[states * np.int64(self.width) + dense]
        rare = np.flatnonzero(codes >= self.width)
        if len(rare):
            keys = states[:, rare].astype(np.int64) * (self.other + 1) + codes[rare]
            spot = np.searchsorted(self.rare, keys)
            to[:, rare] = np.where(self.rare[spot] == keys, self.rare_next[spot], -1)
        return to


def automaton(codes: list[int], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix automaton of a sequence: a dense table of next states (-1: none) for codes under
    ``width``, and rows of (state, code, next state) for the others."""
    links, sizes, nexts = [-1], [0], [{}]
    last = 0
    for c in codes:
        new = len(sizes)
        sizes.append(sizes[last] + 1)
        links.append(0)
        nexts.append({})
        p = last
        while p >= 0 and c not in nexts[p]:
            nexts[p][c] = new
            p = links[p]
        if p >= 0:
            q = nexts[p][c]
            if sizes[q] == sizes[p] + 1:
                links[new] = q
            else:
                clone = len(sizes)
                sizes.append(sizes[p] + 1)
                links.append(links[q])
                nexts.append(dict(nexts[q]))
                while p >= 0 and nexts[p].get(c) == q:
                    nexts[p][c] = clone
                    p = links[p]
                links[q] = links[new] = clone
        last = new
    dense = np.full((len(nexts), width), -1, np.int32)
    rare = []
    for state, out in enumerate(nexts):
        for c, to in out.items():
            if c < width:
                dense[state, c] = to
            else:
                rare.append((state, c, to))
    return dense, np.array(rare, np.int64).reshape(-1, 3)


def model_of(sample: dict[str, str]) -> Model:
    """The automata, built once per worker process."""
    return held_model(("language", *sample.items()), lambda: Model(sample))


def phrase_counts(codes: np.ndarray, offsets: np.ndarray, model: Model) -> np.ndarray:
    """Phrases of every row (given by offsets into codes) against every language."""
    sizes = np.diff(offsets)
    per = -(-sizes // STRETCH)
    row = np.repeat(np.arange(len(sizes)), per)
    begin = offsets[:-1][row] + STRETCH * (np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per))
    length = np.minimum(STRETCH, offsets[1:][row] - begin)
    order = np.argsort(-length, kind="stable")
    row, begin, length = row[order], begin[order], length[order]
    languages = len(model.roots)
    state = np.repeat(model.roots[:, None], len(row), axis=1)
    phrases = np.ones((languages, len(row)), np.int32)
    alive = np.searchsorted(-length, -np.arange(STRETCH), "left")  # stretches longer than the step
    root = model.roots[:, None]
    for step in range(int(length[0]) if len(length) else 0):
        m = int(alive[step])
        c = codes[begin[:m] + step]
        to = model.follow(state[:, :m], c)
        ended = to < 0
        again = model.follow(np.broadcast_to(root, to.shape), c)
        phrases[:, :m] += ended
        # a letter the language has never seen is a phrase of its own
        state[:, :m] = np.where(ended, np.where(again < 0, root, again), to)
    out = np.zeros((languages, len(sizes)))
    for k in range(languages):
        out[k] = np.bincount(row, phrases[k], minlength=len(sizes))
    return out


def coded_rows(texts: list[str | None], model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Letter codes with single gaps between words, and the offsets of the rows."""
    whole = "\x00".join(x or "" for x in texts) + "\x00"
    points = np.frombuffer(whole.encode("utf-32-le", "replace"), np.uint32)
    codes = model.lookup[points]
    cut = np.zeros(len(texts) + 1, np.int64)
    cut[1:] = np.cumsum([len(x or "") + 1 for x in texts])
    blank = codes == 0
    keep = ~blank
    keep[1:] |= blank[1:] & ~blank[:-1]  # the first of a run of gaps
    first = np.zeros(len(codes) + 1, bool)
    first[cut] = True
    keep &= ~(first[:-1] & blank)
    kept = np.concatenate([[0], np.cumsum(keep)])
    return codes[keep], kept[cut]


@lean
def named(batches: Iterator[pa.RecordBatch], sample: dict[str, str]) -> Iterator[pa.RecordBatch]:
    model = model_of(sample) if sample else None
    for batch in batches:
        texts = batch.column("text").to_pylist()
        out = {n: batch.column(n) for n in batch.schema.names}
        low, found = 0, []
        while low < len(texts):
            high, size = low, 0
            while high < len(texts) and (high == low or size < 1 << 20):
                size += len(texts[high] or "")
                high += 1
            found.append(decided(texts[low:high], model))
            low = high
        pred = [x for part in found for x in part[0]]
        out["lang_pred"] = pa.array(pred, pa.string())
        out["score"] = pa.array([x for part in found for x in part[1]], pa.float64())
        out["phrases"] = pa.array([x for part in found for x in part[2]], pa.float64())
        yield pa.RecordBatch.from_pydict(out)


def decided(texts: list[str | None], model: Model | None) -> tuple[list, list, list]:
    if model is None:
        return [UNDECIDED] * len(texts), [0.0] * len(texts), [None] * len(texts)
    codes, offsets = coded_rows(texts, model)
    letters = np.concatenate([[0], np.cumsum(codes > 0)])
    has = letters[offsets[1:]] > letters[offsets[:-1]]
    count = phrase_counts(codes, offsets, model)
    rate = count / np.maximum(np.diff(offsets), 1)
    best = np.argmin(rate, axis=0)
    low = rate[best, np.arange(len(best))]
    rest = np.sort(rate, axis=0)[1] if len(rate) > 1 else 2 * low
    score = np.clip(1 - 0.5 * low / np.maximum(rest, 1e-12), 0.0, 1.0)
    names = [model.languages[b] if ok else UNDECIDED for b, ok in zip(best, has, strict=True)]
    return names, np.where(has, score, 0.0).tolist(), [
        x if ok else None for x, ok in zip(low.tolist(), has, strict=True)
    ]


def identify(docs: DataFrame, sample: dict[str, str], keep: list[str]) -> DataFrame:
    """``keep`` columns plus lang_pred, score and phrases (per character, of the winner)."""
    small_batches(docs.sparkSession)
    part = docs.select(*keep, *([] if "text" in keep else ["text"]))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in part.schema)
    return part.mapInArrow(lambda b: named(b, sample), f"{fields}, {RESULT}")


def held_out() -> Column:
    return fold("doc_id", 4) == 2


def learnt(docs: DataFrame) -> dict[str, str]:
    return training_sample(docs, ~held_out())


def op8_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = identify(docs, learnt(docs), ["doc_id"])
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "phrases")


def language_stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents whose language can be named; those without a letter go."""
    part, names = sheltered(docs, ("doc_id", "text", "lang"))
    found = identify(part, learnt(part), names)
    return found.where(F.col("lang_pred") != UNDECIDED).select(*names).toDF(*docs.columns)
