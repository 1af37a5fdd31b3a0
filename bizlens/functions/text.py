"""Cleaning, chunking and tokenising as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Characters per chunk and characters shared by neighbours.
CHUNK_SIZE = 500
CHUNK_OVERLAP = 100
# The characters that count as white space at the ends of a text.
SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"
# A short English stop list; pass another list where a fuller one is wanted.
STOP_WORDS = (
    "an and are as at be but by can do does for from had has have how if in into is it its not of "
    "on or our over should so that the their then there these they this to was we were what when "
    "which who why will with you your"
).split()


def strip(text: Column) -> Column:
    return F.trim(text, F.lit(SPACE))


def clean(text: Column) -> Column:
    """Strip, and collapse runs of newlines to one blank line."""
    return F.regexp_replace(strip(text), r"\n{2,}", "\n\n")


def chunk_count(cleaned: Column, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    length = F.length(cleaned)
    return (
        F.when(length == 0, 0)
        .when(length <= size, 1)
        .otherwise(F.ceil((length - size) / F.lit(size - overlap)) + 1)
        .cast("int")
    )


def chunk_at(
    cleaned: Column, number: Column, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP
) -> Column:
    return F.substring(cleaned, number * F.lit(size - overlap) + F.lit(1), F.lit(size))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Even out a scan that arrives in fewer partitions than there are cores (one big file), ahead
    of CPU-heavy text work. A scan that is already wide is left alone."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df


def chunk_documents(
    docs: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP
) -> DataFrame:
    """``doc_id, source, chunk_no, text``: windows of ``size`` characters over the whole text."""
    cleaned = spread(docs.select("doc_id", "source", "text"), "doc_id").withColumn(
        "_clean", clean(F.col("text"))
    )
    count = chunk_count(F.col("_clean"), size, overlap)
    numbers = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(
        F.array().cast("array<int>")
    )
    step = size - overlap
    if overlap <= step:
        # cutting the text once into steps keeps a long text linear; a chunk is a step and the
        # beginning of the next one
        cut = cleaned.withColumn(
            "_steps", F.regexp_extract_all("_clean", F.lit(f"(?s).{{1,{step}}}"), F.lit(0))
        )
        pieces = F.transform(
            numbers,
            lambda n: F.concat(
                F.get("_steps", n),
                F.substring(F.coalesce(F.get("_steps", n + 1), F.lit("")), 1, overlap),
            ),
        )
    else:
        cut = cleaned
        pieces = F.transform(numbers, lambda n: chunk_at(F.col("_clean"), n, size, overlap))
    return cut.select("doc_id", "source", F.posexplode_outer(pieces).alias("chunk_no", "text")).filter(
        F.col("chunk_no").isNotNull()
    )


def tokens(text: Column, stop_words: Sequence[str] = STOP_WORDS) -> Column:
    found = F.regexp_extract_all(F.lower(text), F.lit(TOKEN_PATTERN), F.lit(0))
    return F.filter(found, lambda t: ~t.isin(*stop_words)) if stop_words else found


def with_bigrams(words: Column) -> Column:
    pairs = F.zip_with(
        F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))),
        F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))),
        lambda a, b: F.concat_ws(" ", a, b),
    )
    return F.concat(words, pairs)


def with_terms(
    df: DataFrame, text: str = "text", stop_words: Sequence[str] = STOP_WORDS
) -> DataFrame:
    """Add ``terms``: the words that are no stop words, then each pair of neighbours among them."""
    return (
        df.withColumn("_words", tokens(F.col(text), stop_words))
        .withColumn("terms", with_bigrams(F.col("_words")))
        .drop("_words")
    )


def term_rows(
    df: DataFrame, keep: Sequence[str], text: str = "text", stop_words: Sequence[str] = STOP_WORDS
) -> DataFrame:
    """One row per term occurrence. The outer form is used because for the plain one the optimizer
    adds a filter on the array, which would cut the text into words a second time; the empty rows
    it leaves have a NULL term and fall out at the next join or filter."""
    return with_terms(df, text, stop_words).select(
        *keep, F.explode_outer("terms").alias("term")
    )
