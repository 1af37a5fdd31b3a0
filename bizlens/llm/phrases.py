"""Phrase collocations by rolling fingerprints.

Texts are cut into pieces and words (see ``SEPARATORS``, ``ENDS``). Prefix polynomials over the words
of a block give the fingerprint of every n-gram; the language is part of the fingerprint. Counts are
summed inside tasks and then by a shuffle of packed arrays. Single words and pairs are counted first.
A Bloom filter of fixed size then tells which pairs are frequent, and only longer n-grams made of
frequent pairs are counted, as no phrase is more frequent than its parts. A filter only saves work;
it never decides a count.

Fingerprints are trusted for pruning only. The last pass goes through the texts again, looks at every
occurrence of a frequent fingerprint, tells different word sequences with one fingerprint apart by
their exact word numbers, and sends each distinct phrase of a block once, as text, with its count and
the pointer to its first occurrence (document, word). The counts that leave are those by text.

Defined results: a null text is empty; a null language is ``und``, together with a language of that
name; repeated rows count as often as they stand there; a null doc_id only makes a null pointer; an
empty table gives no rows. Texts of any length are cut whole; memory is bounded by a block
(``TEXT_BYTES`` or one text) and by ``HELD`` fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bizlens.llm.common import Hashes, joined, mixed, settled, small_batches, table
from bizlens.llm.wordgrams import (
    COUNTED, Words, bloom_of, byte_set, in_bloom, merged_counts, packed_counts, summed_up, text_slices,
)

# Fixed values of the task: what parts pieces and words, phrase lengths, thresholds.
ENDS = ".,;:!?\n\x0b\x0c\r"
SEPARATORS = " \t" + ENDS
LONGEST = 4
FREQUENT = 30
SCALE = 2_000_000
ABSORBED = 80
TOP = 2000
NO_LANGUAGE = "und"

HELD = 3_000_000  # fingerprints a task holds before it sends them on
PART_CHARS = 1 << 24  # characters of text for each part of the exchange
_BREAKS, _ENDS = byte_set(SEPARATORS), byte_set(ENDS)


def language_values(column: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """For each row the number of its language; for each number the fingerprint and the name."""
    names = pc.fill_null(column.cast(pa.large_string()), NO_LANGUAGE).dictionary_encode()
    letters, cut = joined(names.dictionary)
    value = Hashes(letters, 1)(cut[:-1], cut[1:])
    return names.indices.to_numpy(zero_copy_only=False), value, names.dictionary


def blocks(batches: Iterator[pa.RecordBatch]):
    """Words of about ``TEXT_BYTES`` at a time, with the batch, its first row and the languages."""
    for batch in batches:
        number, value, names = language_values(batch.column("lang"))
        for low, high, data, offsets in text_slices(batch):
            words = Words(data, offsets, _BREAKS, _ENDS)
            yield words, batch, low, number[low:high], value, names


def language_grams(words: Words, size: int, number: np.ndarray, value: np.ndarray):
    first, found = words.grams(size)
    return first, mixed(found ^ mixed(value[number[words.row[first]]])) if len(found) else found


def counted(batches: Iterator[pa.RecordBatch], parts: int, sizes: tuple[int, ...], pairs: np.ndarray | None):
    """Packed counts of the n-grams of ``sizes``; with ``pairs``, only of those whose pairs of
    neighbours are all in that filter."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    total = 0
    for words, _, _, number, value, _ in blocks(batches):
        grams = []
        if pairs is not None:
            first, found = language_grams(words, 2, number, value)
            good = np.zeros(len(words.word) + 1, bool)
            good[first[in_bloom(pairs, found)]] = True
        for size in sizes:
            first, found = language_grams(words, size, number, value)
            if pairs is not None:
                kept = np.ones(len(first), bool)
                for k in range(size - 1):
                    kept &= good[first + k]
                found = found[kept]
            grams.append(found)
        every = np.concatenate(grams)
        held.append(summed_up(every, np.ones(len(every), np.int64)))
        total += len(held[-1][0])
        if total > HELD:
            yield from packed_counts(*summed_up(*map(np.concatenate, zip(*held, strict=True))), parts)
            held, total = [], 0
    if held:
        yield from packed_counts(*summed_up(*map(np.concatenate, zip(*held, strict=True))), parts)


PHRASES = "lang string, phrase string, words int, n long, doc_id long, word long"


def spelled(batches: Iterator[pa.RecordBatch], frequent: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Every distinct phrase of a block whose fingerprint is frequent: text, count, first pointer.
    A row without a phrase holds how many words the block has in a language."""
    for words, batch, low, number, value, names in blocks(batches):
        if not len(words.word):
            continue
        many = np.bincount(number[words.row], minlength=len(names))
        own = np.flatnonzero(many)
        yield pa.RecordBatch.from_pydict(
            {
                "lang": names.take(pa.array(own)).cast(pa.string()),
                "phrase": pa.nulls(len(own), pa.string()),
                "words": pa.array(np.zeros(len(own)), pa.int32()),
                "n": pa.array(many[own], pa.int64()),
                "doc_id": pa.nulls(len(own), pa.int64()),
                "word": pa.nulls(len(own), pa.int64()),
            }
        )
        start = np.searchsorted(words.row, np.arange(len(number)))
        ids = batch.column("doc_id").slice(low, len(number)).cast(pa.int64())
        for size in range(1, LONGEST + 1):
            first, found = language_grams(words, size, number, value)
            kept = in_bloom(frequent, found)
            first, found = first[kept], found[kept]
            if not len(first):
                continue
            # equal fingerprints stand together; inside them the exact words decide
            spelling = [words.word[first + k] for k in range(size)]
            order = np.lexsort([first, *spelling[::-1], number[words.row[first]], found])
            first, found = first[order], found[order]
            new = np.ones(len(first), bool)
            new[1:] = found[1:] != found[:-1]
            for column in (number[words.row[first]], *(words.word[first + k] for k in range(size))):
                new[1:] |= column[1:] != column[:-1]
            head = np.flatnonzero(new)
            at = first[head]
            parts = [words.names.take(pa.array(words.word[at + k])) for k in range(size)]
            text = parts[0] if size == 1 else pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string()))
            row = words.row[at]
            yield pa.RecordBatch.from_pydict(
                {
                    "lang": names.take(pa.array(number[row])).cast(pa.string()),
                    "phrase": text.cast(pa.string()),
                    "words": pa.array(np.full(len(at), size), pa.int32()),
                    "n": pa.array(np.diff(np.append(head, len(first))), pa.int64()),
                    "doc_id": ids.take(pa.array(row)),
                    "word": pa.array(at - start[row], pa.int64()),
                }
            )


def frequent_fingerprints(
    texts: DataFrame, parts: int, sizes: tuple[int, ...], least: int, pairs: np.ndarray | None
) -> DataFrame:
    held = texts.sparkSession.sparkContext.broadcast(pairs)  # 2**BLOOM_BITS bits or nothing
    return settled(
        texts.mapInArrow(lambda b: counted(b, parts, sizes, held.value), COUNTED)
        .groupBy("part").applyInPandas(merged_counts(least), "found long, n long"),
        "frequent-fingerprints",
    )


def frequent_phrases(docs: DataFrame, least: int = FREQUENT) -> tuple[DataFrame, DataFrame]:
    """``lang, phrase, words, f, first``: every phrase of 1 to 4 words that stands ``least`` times or
    more in its language, with the pointer (doc_id, word) to its first occurrence; and ``lang, n``,
    all words of each language."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang"))
    chars = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-chars // PART_CHARS))
    short = frequent_fingerprints(texts.select("text", "lang"), parts, (1, 2), least, None)
    long = frequent_fingerprints(
        texts.select("text", "lang"), parts, tuple(range(3, LONGEST + 1)), least, bloom_of(short, "found")
    )
    held = spark.sparkContext.broadcast(bloom_of(short.union(long), "found"))
    found = texts.mapInArrow(lambda b: spelled(b, held.value), PHRASES)
    pointer = F.struct("doc_id", "word")
    rows = settled(
        found.groupBy("lang", "phrase", "words")
        .agg(F.sum("n").alias("f"), F.min(F.when(F.col("doc_id").isNotNull(), pointer)).alias("first"))
        .where((F.col("f") >= least) | (F.col("words") == 0)),
        "phrases",
    )
    return rows.where("words > 0"), rows.where("words = 0").select("lang", F.col("f").alias("n"))


def scored(phrases: DataFrame) -> DataFrame:
    """Every candidate of two words or more with its lowest-scoring cut: ``a, l, r, score``."""
    candidates = phrases.where("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"), "first")
    split = F.split("phrase", " ")
    cuts = F.transform(
        F.sequence(F.lit(1), F.col("words") - 1),
        lambda k: F.struct(
            k.alias("k"),
            F.array_join(F.slice(split, F.lit(1), k), " ").alias("left"),
            F.array_join(F.slice(split, k + 1, F.col("words") - k), " ").alias("right"),
        ),
    )
    part = phrases.select("lang", F.col("phrase").alias("part"), F.col("f").alias("part_f"))
    cut = candidates.select("*", F.inline(cuts))
    for side, name in (("left", "l"), ("right", "r")):
        cut = cut.join(part.select("lang", F.col("part").alias(side), F.col("part_f").alias(name)), ["lang", side])
    score = F.expr(f"(cast(a as decimal(38,0)) * {SCALE}) div (cast(l as decimal(38,0)) + cast(r as decimal(38,0)))")
    best = F.min(F.struct(F.col("score"), F.col("k"), F.col("l"), F.col("r")))
    return (
        cut.withColumn("score", score)
        .groupBy("lang", "phrase", "words", "a", "first").agg(best.alias("best"))
        .select("lang", "phrase", "words", "a", "first", "best.k", "best.l", "best.r", "best.score")
    )


def covers(phrases: DataFrame) -> DataFrame:
    """``lang, phrase, longer``: the largest count of a longer candidate that holds the phrase."""
    split = F.split("phrase", " ")
    inner = F.flatten(
        F.transform(
            F.sequence(F.lit(2), F.col("words") - 1),
            lambda size: F.transform(
                F.sequence(F.lit(1), F.col("words") - size + 1),
                lambda at: F.array_join(F.slice(split, at, size), " "),
            ),
        )
    )
    return (
        phrases.where("words > 2").select("lang", F.explode(inner).alias("phrase"), "f")
        .groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    )


def collocations(
    docs: DataFrame, least: int = FREQUENT, absorbed: int = ABSORBED, top: int = TOP
) -> DataFrame:
    """The ``top`` phrases of every language: ``lang, rank, phrase, words, a, l, r, n, score, first``.
    A phrase goes if a longer one stands at least ``absorbed`` percent as often."""
    phrases, totals = frequent_phrases(docs, least)
    kept = scored(phrases).join(covers(phrases), ["lang", "phrase"], "left").where(
        F.col("longer").isNull()
        | (F.lit(100).cast("decimal(20,0)") * F.col("longer") < F.lit(absorbed).cast("decimal(20,0)") * F.col("a"))
    )
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    best = kept.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return best.join(totals, "lang").select(
        "lang", "rank", "phrase", F.col("words").cast("long").alias("words"), "a", "l", "r", "n", "score", "first"
    )


def op13_phrases(spark: SparkSession, folder: str) -> DataFrame:
    """The best 2,000 collocations of every language."""
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    return collocations(docs).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents
), lists AS (
    SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), totals AS (
    SELECT lang, sum(len(w)) AS n FROM lists GROUP BY lang
), grams AS (
    SELECT lang, size, unnest(list_transform(range(1, len(w) - size + 2), lambda i: w[i:i + size - 1])) AS g
    FROM lists, (SELECT unnest([1, 2, 3, 4]) AS size)
), freq AS (
    SELECT lang, size, g, array_to_string(g, ' ') AS phrase, count(*) AS f FROM grams
    GROUP BY lang, size, g HAVING count(*) >= 30
), cut AS (
    SELECT *, unnest(range(1, size)) AS k FROM freq WHERE size > 1
), scores AS (
    SELECT c.lang, c.size, c.g, c.phrase, c.f AS a, c.k, l.f AS l, r.f AS r,
        ((2000000::hugeint * c.f) // (l.f + r.f))::bigint AS score
    FROM cut c
    JOIN freq l ON l.lang = c.lang AND l.g = c.g[1:c.k]
    JOIN freq r ON r.lang = c.lang AND r.g = c.g[c.k + 1:c.size]
), best AS (
    SELECT * FROM scores
    QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), lengths AS (
    SELECT lang, g, f, size, unnest(range(2, size)) AS part FROM freq WHERE size > 2
), inner_parts AS (
    SELECT lang, f, unnest(list_transform(range(1, size - part + 2), lambda i: g[i:i + part - 1])) AS g FROM lengths
), longer AS (
    SELECT lang, g, max(f) AS f FROM inner_parts GROUP BY lang, g
), kept AS (
    SELECT b.* FROM best b LEFT JOIN longer o ON o.lang = b.lang AND o.g = b.g
    WHERE o.f IS NULL OR 100::hugeint * o.f < 80::hugeint * b.a
), ranked AS (
    SELECT *, row_number() OVER (
        PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept
)
SELECT lang, rank, phrase, a, l, r, n::bigint AS n, score FROM ranked JOIN totals USING (lang)
WHERE rank <= 2000
"""
