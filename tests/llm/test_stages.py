"""The stages of the pipeline together, with columns that clash, and pages whose markup is broken."""

import random
import time

import numpy as np
import pyarrow as pa
import pytest
import zlib
from pyspark.sql import functions as F

import corpus_pipeline
from bizlens.llm import decontam, lines, pages
from bizlens.llm.packing import TOKENIZER, Words, tokenizer_path

CLASH = [
    "score", "lang_pred", "phrases", "gone", "gone_id", "gone_hash", "n_lines", "n_removed_lines", "node", "hits",
    "Text", "best", "component", "weight", "pid", "piece", "length", "_c0", "_c1",
]


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """A folder of planted documents and a benchmark, and what is planted."""
    rng = random.Random(7)
    folder = tmp_path_factory.mktemp("corpus")
    items = [prose(rng, 40) for _ in range(3)]
    clean = {k: "\n".join(prose(rng, 25) for _ in range(4)) for k in range(20)}
    docs = dict(clean)
    docs[100] = clean[3]  # an exact copy
    words = clean[5].replace("\n", " ").split()
    words[50] = "changed"
    docs[101] = " ".join(words)  # a near copy, on one line
    docs[102] = prose(rng, 60) + " " + items[1] + " " + prose(rng, 60)
    docs[103] = "123 456 !!"
    docs[104] = prose(rng, 30) + "\n" + clean[8].split("\n")[2] + "\n" + prose(rng, 30)
    rows = [(k, t, "en", "s", len(t)) for k, t in docs.items()] + [(105, None, "en", "s", 0), (106, "", None, "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(
        4
    ).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(
        f"{folder}/benchmark.parquet"
    )
    return str(folder), docs, clean


def test_the_whole_pipeline(spark, corpus):
    folder, docs, clean = corpus
    found = corpus_pipeline.run(spark, folder).collect()
    kept = {r.doc_id for r in found}
    # gone: the copy or its original, the near copy or its original, the leak, the texts without letters
    assert kept == {*range(20), 104} or kept == {*range(20), 101, 104} - {5}
    words = Words(tokenizer_path(TOKENIZER))
    for r in found:
        text = docs[r.doc_id]
        if r.doc_id == 104:  # the line that stands in an earlier document is cut out
            text = "\n".join(x for k, x in enumerate(text.split("\n")) if k != 1)
        ids = words.ids(text)
        own = ids[4 * r.start : 4 * (r.start + r.length)]
        assert zlib.crc32(own) == r.ids_crc32 and len(own) == 4 * r.length
    places = {}
    for r in found:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in places.values():
        ends = np.cumsum([n for _, n in sorted(own)])
        assert [at for at, _ in sorted(own)] == [0, *ends[:-1]] and ends[-1] <= 4096


@pytest.mark.parametrize("number", range(len(corpus_pipeline.STAGES)))
def test_stages_bear_columns_that_clash(spark, corpus, number):
    folder, docs, _ = corpus
    name, stage = corpus_pipeline.STAGES[number]
    plain = spark.read.parquet(f"{folder}/documents.parquet")
    wide = plain.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASH])
    want = stage(spark, plain, folder)
    found = stage(spark, wide, folder)
    if name == "packing":
        # the numbers of sequences are any numbers
        columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
        assert sorted(map(tuple, found.select(*columns).collect())) == sorted(map(tuple, want.select(*columns).collect()))
        return
    assert found.columns == wide.columns
    key = lambda r: (r[0], r[1] or "")
    rows, expected = sorted(found.collect(), key=key), sorted(want.collect(), key=key)
    assert [tuple(r)[:5] for r in rows] == [tuple(r) for r in expected]
    assert all(tuple(r)[5:] == tuple(f"own {c}" for c in CLASH) for r in rows)


@pytest.mark.parametrize("number", range(len(corpus_pipeline.STAGES)))
def test_stages_bear_an_empty_table(spark, corpus, number):
    folder, *_ = corpus
    empty = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    assert corpus_pipeline.STAGES[number][1](spark, empty, folder).count() == 0


BROKEN = {
    "unclosed quotes": '<a "' * 250_000,
    "open attributes": "<p>" + '<a href="x ' * 100_000,
    "deep": "<div>" * 60_000 + "</div>" * 60_000,
    "never ending": "<a " * 300_000,
    "many blocks": "<p>word</p>" * 60_000,
    "comments": "<!-- " * 200_000,
}


@pytest.mark.parametrize("name", BROKEN)
def test_broken_pages_take_linear_time(name):
    begin = time.process_time()
    pages.main_text(BROKEN[name])
    assert time.process_time() - begin < 10


def test_pages_repeat_and_may_be_missing(spark):
    page = "<html><body><article><p>" + "The cat and the dog were in the house of the old man. " * 6 + "</p></article></body></html>"
    rows = [(1, "http://a", page), (1, "http://a", page), (2, None, None), (None, "x", "")]
    schema = "page_id long, url string, html string"
    found = [tuple(r) for r in pages.extract(spark.createDataFrame(rows, schema)).collect()]
    text = ("The cat and the dog were in the house of the old man. " * 6).strip()
    assert sorted(found, key=str) == sorted(
        [(1, "http://a", text, len(text))] * 2 + [(2, None, "", 0), (None, "x", "", 0)], key=str
    )
    assert pages.extract(spark.createDataFrame([], schema)).count() == 0


@pytest.mark.parametrize("size", [59, 60, 75, 90, 140])
@pytest.mark.parametrize("edits", [0, 1, 3])
def test_every_passage_of_59_characters_is_found(size, edits):
    """Passages from anywhere in an item, with edits anywhere, between other words: all are found, and
    texts without one are clean."""
    rng = random.Random(size * 10 + edits)
    items = [(k, prose(rng, 60)) for k in range(4)]
    index = decontam.Index.of(items)
    texts, want = [], []
    for _ in range(60):
        item, whole = rng.choice(items)
        at = rng.randrange(len(whole) - size)
        passage = list(whole[at : at + size])
        # the promise is about a stretch of 59 characters: edits all fall in one
        for place in sorted(rng.sample(range(59), edits), reverse=True):
            kind = rng.choice("sdi")
            if kind == "s":
                passage[place] = "z"
            elif kind == "d":
                del passage[place]
            else:
                passage.insert(place, "z")
        text = "".join(passage)
        texts.append(prose(rng, 30) + " " + text + " " + prose(rng, 30))
        want.append(None if edits and size < 75 else item)  # edits may shorten a passage of just 59
        texts.append(prose(rng, 70))
        want.append(-1)
    batch = pa.RecordBatch.from_pydict({"text": texts})
    out = next(decontam.searched(iter([batch]), index)).column("hits").to_pylist()
    for hits, item in zip(out, want, strict=True):
        if item == -1:
            assert not hits
        elif item is not None:
            assert item in {h["item_id"] for h in hits}


def test_a_task_gives_back_what_it_freed_and_blocks_come_a_few_at_a_time(spark):
    """pipeline, op7_suffix_dedup: batches are bounded in bytes, and no model outlives its stage."""
    from bizlens.llm import common

    common.small_batches(spark)
    rows = spark.range(64, numPartitions=1).selectExpr("id", "repeat('x', 500000) AS text")

    def sizes(batches):
        for batch in batches:
            common.process_cache()["model"] = 1
            common.drop_model()
            assert "model" not in common.process_cache()
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.nbytes], pa.int64())})

    got = [r["n"] for r in rows.mapInArrow(common.lean(sizes), "n long").collect()]
    assert sum(got) > 64 * 500_000 and max(got) <= common.BATCH_BYTES + 2 * 500_000


def test_shards_are_matched_in_parts_with_the_same_verdicts(monkeypatch):
    """op7_suffix_dedup: what a shard sorts at once is bounded; equal anchors stay together."""
    from bizlens.llm import substrings

    texts = [f"{'abcdefghij' * 9}{i % 7} some words of text number {i % 11} and so on, again and again".encode() for i in range(40)]
    own = {
        "block": list(range(40)), "ids": [np.array([i]).tobytes() for i in range(40)],
        "sizes": [np.array([len(t)]).tobytes() for t in texts], "data": [substrings.squeezed(t) for t in texts],
    }
    batch = pa.RecordBatch.from_pydict(own)
    rows = pa.Table.from_batches(substrings.entries(iter([batch]), 1)).to_pandas()
    whole = substrings.matched((0,), rows)
    seen, real = [], substrings.verdicts
    monkeypatch.setattr(substrings, "verdicts", lambda *x: seen.append(len(x[0])) or real(*x))
    monkeypatch.setattr(substrings, "MATCH_ENTRIES", 16)
    parts = substrings.matched((0,), rows)
    assert len(seen) > 3 and len(whole) and whole.equals(parts)


def test_ranks_of_the_sampling_take_half_the_memory_and_stay():
    """pipeline: the table is built level by level; the ranks are those of the whole array."""
    import tracemalloc

    from bizlens.llm import neardup

    tracemalloc.start()
    ranks = neardup.drawn()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert ranks.nbytes == 4 * neardup.LEVELS << neardup.POOL_BITS and peak < 4 * 8 * neardup.LEVELS << neardup.POOL_BITS


def test_the_line_stage_doubles_until_no_run_repeats(spark, monkeypatch):
    """The pipeline's stage ranks runs of 1, 2, 4 and 8 lines and cuts the later copies."""
    steps = []
    double = lines.doubled
    monkeypatch.setattr(lines, "doubled", lambda ranks, step: steps.append(step) or double(ranks, step))
    shared = [f"shared line {n}" for n in range(9)]
    table = [(d, "\n".join([f"own {d} a", *shared, f"own {d} b"])) for d in (1, 2)] + [(3, "\n".join(shared)), (4, None)]
    docs = spark.createDataFrame(table, "doc_id long, text string")
    got = {r.doc_id: r.text for r in lines.line_stage(spark, docs, "").collect()}
    assert got == {1: table[0][1], 2: "own 2 a\nown 2 b", 4: None}
    assert steps == [1, 2, 4]
