"""Line dedup: repeated runs of lines, found by prefix doubling, keep their first copy only.

The lines of a document that hold a word form its sequence of line ids. Distributed prefix doubling
ranks the suffixes of all sequences by their first 1, 2, 4, ... lines: each step pairs a suffix's
rank with the rank of the suffix that many lines on, sorts the distinct pairs over the cluster and
numbers them in order; a suffix whose rank is unique leaves the work, which ends when none is left.
All suffixes of one rank form an interval of the suffix array with at least that many lines in common.

A run counts from ``MIN_WORDS`` words on; with 1, every repeated run does, however short its lines. Every
maximal repeated run of n lines is the union of the runs of 2**k lines in it (2**k <= n < 2**(k+1)), so
at every step each interval's earliest copy is found by an aggregation, and all later copies go. Where
``MIN_WORDS`` is larger, the shortest runs that hold as many and start or end at a line are looked up as
well; one of n lines is named by the ranks of its first and its last 2**k lines. With 1 word these are
single lines. A later copy reaches some lines far; a running maximum over the places of a document
tells which lines are covered, so no run is unfolded.

Earlier means a smaller (doc_id, text hash, line). Defined results: null and empty texts, and rows
with a null doc_id, stay as they are; rows equal in doc_id and text count as one document and all
get its result; lines without a word stay, unless nothing else is left; the text of a document of
which nothing is left is empty. Only DataFrame functions are used; group sizes are unlimited
because nothing is collected per run (joins on a run's name are left to Spark's skew handling).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bizlens.llm.common import settled, sheltered, table

MIN_WORDS = 1
KEY = ["doc_id", "text_hash"]


def sequences(docs: DataFrame, min_words: int) -> DataFrame:
    """One row per line with a word: its place k in the sequence, its line number, its id, its words,
    and how many lines the shortest long-enough run from here on, and up to here, has (null: none)."""
    line = F.split("text", "\n", -1)
    facts = F.transform(
        line,
        lambda x, i: F.struct(
            i.alias("line"), F.xxhash64(x).alias("id"), F.hash(x).alias("check"),
            F.when(x.rlike(r"\S"), F.size(F.split(F.trim(x), r"\s+"))).otherwise(0).alias("words"),
        ),
    )
    rows = (
        docs.where(F.col("doc_id").isNotNull() & (F.col("text") != ""))
        .select("doc_id", F.xxhash64("text").alias("text_hash"), facts.alias("facts"))
        .withColumn("facts", F.filter("facts", lambda x: x["words"] > 0))
    )

    def span(k: Column, backward: bool) -> Column:
        def reached(n: Column) -> Column:
            begin = k - n + 2 if backward else k + 1
            part = F.slice("facts", begin, n)
            total = F.aggregate(part, F.lit(0), lambda a, x: a + x["words"])
            fits = (begin >= 1) if backward else (k + n <= F.size("facts"))
            return fits & (total >= min_words)

        first = F.filter(F.sequence(F.lit(1), F.lit(min_words)), lambda n: n <= F.size("facts"))
        if backward:
            first = F.filter(first, lambda n: k - n + 2 >= 1)
        return F.element_at(F.concat(F.filter(first, reached), F.array(F.lit(None).cast("int"))), 1)

    marked = F.transform(
        "facts",
        lambda x, k: F.struct(
            k.alias("k"), x["line"].alias("line"), x["id"].alias("id"), x["check"].alias("check"),
            F.when(x["words"] >= min_words, 1).otherwise(span(k, False)).alias("ahead"),
            F.when(x["words"] >= min_words, 1).otherwise(span(k, True)).alias("back"),
        ),
    )
    return rows.select(*KEY, F.inline(marked)).distinct()


def numbered(rows: DataFrame, name: list[str]) -> DataFrame:
    """The names that repeat, sorted over the cluster and numbered in order, with the first copy of each."""
    found = (
        rows.groupBy(*name)
        .agg(F.count("*").alias("copies"), F.min(F.struct(*KEY, "k")).alias("first"))
        .where("copies > 1")
        .orderBy(*name)
        .withColumn("new_rank", F.monotonically_increasing_id())
        .drop("copies")
    )
    # a written side lets Spark split the rows of a frequent line over several tasks
    return settled(found, "line-ranks")


def ranked(rows: DataFrame, name: list[str], size: int) -> DataFrame:
    """The suffixes whose first ``size`` lines repeat, which ``name`` tells: their rank, whether these
    lines are a later copy, and the rank that many lines on."""
    own = rows.join(numbered(rows, name), name).select(
        *KEY, "k", "line", "ahead", F.col("new_rank").alias("rank"),
        (F.struct(*KEY, "k") > F.col("first")).alias("later"),
    )
    on = Window.partitionBy(*KEY).orderBy("k").rangeBetween(size, size)
    return settled(own.withColumn("next_rank", F.max("rank").over(on)), "line-suffixes")


def doubled(ranks: DataFrame, step: int) -> DataFrame:
    """Ranks by the first 2 * ``step`` lines: distinct pairs are sorted and numbered in order."""
    return ranked(ranks.where("next_rank is not null"), ["rank", "next_rank"], 2 * step)


def wide_runs(lines: DataFrame) -> DataFrame:
    """(doc, first k, size) of every shortest long-enough run of three lines or more."""
    return (
        lines.where("ahead > 2").select(*KEY, "k", F.col("ahead").alias("size"))
        .union(
            lines.where("back > 2").select(
                *KEY, (F.col("k") - F.col("back") + 1).alias("k"), F.col("back").alias("size")
            )
        )
        .distinct()
    )


def later_copies(wide: DataFrame, ranks: DataFrame, step: int) -> DataFrame:
    """Those of the runs of ``step`` to 2 * ``step`` lines, both left out, that are later copies; a run
    is named by the ranks of its first and last ``step`` lines."""
    name = ["size", "a", "b"]
    ends = ranks.select(*KEY, F.col("k").alias("end_k"), F.col("rank").alias("b"))
    runs = (
        wide.where((F.col("size") > step) & (F.col("size") < 2 * step))
        .join(ranks.select(*KEY, "k", F.col("rank").alias("a")), [*KEY, "k"])
        .withColumn("end_k", F.col("k") + F.col("size") - step)
        .join(ends, [*KEY, "end_k"])
    )
    first = runs.groupBy(*name).agg(F.min(F.struct(*KEY, "k")).alias("first"))
    # a written side lets Spark split the rows of a frequent run over several tasks
    later = runs.join(settled(first, "first-copies"), name).where(F.struct(*KEY, "k") > F.col("first"))
    return later.select(*KEY, "k", (F.col("k") + F.col("size")).alias("end"))


def named_runs(lines: DataFrame) -> DataFrame:
    """(doc, k, line, end): every repeated line, with the end of the line if it is a later copy, and the
    first place and the end of every longer later copy (line null). Suffixes are doubled until none
    repeats; at each step the long-enough runs of that many lines and the shortest of up to twice as
    many are looked up."""
    most = lines.agg(F.max(F.greatest("ahead", "back"))).first()[0] or 1
    wide = settled(wide_runs(lines), "line-runs") if most > 2 else None
    ranks, step = ranked(lines, ["id", "check"], 1), 1
    own = F.col("later") & (F.col("ahead") <= step)
    runs = ranks.select(*KEY, "k", "line", F.when(own, F.col("k") + 1).alias("end"))
    nowhere = F.lit(None).cast("int").alias("line")
    while not ranks.where("next_rank is not null").isEmpty():
        ranks = doubled(ranks, step)
        step *= 2
        later = ranks.where(F.col("later") & (F.col("ahead") <= step))
        runs = runs.union(later.select(*KEY, "k", nowhere, (F.col("k") + step).alias("end")))
        if step < most:
            runs = runs.union(later_copies(wide, ranks, step).select(*KEY, "k", nowhere, "end"))
    return runs


def deleted_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, text hash and the numbers of the lines to delete, for documents that have any: those
    that a run of later copies, from here or before, reaches past."""
    lines = settled(sequences(docs, min_words), "lines")
    reach = F.max("end").over(Window.partitionBy(*KEY).orderBy("k"))
    return (
        named_runs(lines).withColumn("reach", reach)
        .where(F.col("line").isNotNull() & (F.col("reach") > F.col("k")))
        .groupBy(*KEY).agg(F.collect_set("line").alias("gone"))
    )


def deduplicated(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with the text that is left, and n_lines and n_removed_lines."""
    gone = deleted_lines(docs.select("doc_id", "text"), min_words)
    gone = gone.select(
        F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash"), "gone"
    )
    both = docs.join(
        gone,
        (F.col("doc_id") == F.col("gone_id")) & (F.xxhash64("text") == F.col("gone_hash")),
        "left",
    )
    line = F.split("text", "\n", -1)
    total = F.when(F.coalesce(F.length("text"), F.lit(0)) > 0, F.size(line)).otherwise(0)
    kept = F.array_except(F.sequence(F.lit(0), F.size(line) - 1), "gone")
    left = F.array_join(F.transform(kept, lambda i: F.element_at(line, i + 1)), "\n")
    text = F.when(F.col("gone").isNull(), F.col("text")).when(
        left.rlike(r"\S"), left
    ).otherwise("")
    removed = F.coalesce(F.size("gone"), F.lit(0))
    names = [c for c in docs.columns if c != "text"]
    return both.select(
        *names, text.alias("text"), total.alias("n_lines"),
        F.when(F.col("gone").isNull(), 0).otherwise(removed).alias("n_removed_lines"),
    )


def op10_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return deduplicated(docs)


def line_stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents with later copies of line runs cut out; one of which nothing is left goes."""
    part, names = sheltered(docs, ("doc_id", "text", "n_chars"))
    found = deduplicated(part)
    emptied = (F.col("n_removed_lines") > 0) & (F.col("text") == "")
    kept = found.where(~emptied)
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(
            F.col("n_removed_lines") > 0, F.length("text").cast(part.schema["n_chars"].dataType)
        ).otherwise(F.col("n_chars")))
    return kept.select(*names).toDF(*docs.columns)
