import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from bizlens.functions import text as tx
from bizlens.operators import retrieval as rt
from bizlens.operators.embedders import HashingEmbedder, TfidfEmbedder, embed

SCHEMA = "doc_id long, source string, text string"


def python_chunks(text):
    text = re.sub(r"\n{2,}", "\n\n", text.strip())
    if not text:
        return []
    last = max(0, math.ceil((len(text) - 500) / 400))
    return [text[400 * n : 400 * n + 500] for n in range(last + 1)]


@pytest.fixture(scope="module")
def odd_texts():
    body = "".join(chr(97 + i % 26) for i in range(2000))
    return [
        "", " \n\t ", "x", body[:500], body[:501], body[:900], body[:901], body[:1300],
        "　  one\n\n\n\n\ntwo\n\n" + "\U0001f600" * 600 + "\x1c ",
    ]


def test_chunks_cover_the_text(spark, odd_texts):
    docs = spark.createDataFrame([(i, "s", t) for i, t in enumerate(odd_texts)], SCHEMA)
    rows = tx.chunk_documents(docs).collect()
    for i, text in enumerate(odd_texts):
        mine = [r.text for r in sorted(rows, key=lambda r: r.chunk_no) if r.doc_id == i]
        assert mine == python_chunks(text)
        if mine:
            rebuilt = mine[0] + "".join(piece[100:] for piece in mine[1:])
            assert rebuilt == re.sub(r"\n{2,}", "\n\n", text.strip())
    counts = docs.select("doc_id", tx.chunk_count(tx.clean(F.col("text"))).alias("n")).collect()
    assert {r.doc_id: r.n for r in counts} == {i: len(python_chunks(t)) for i, t in enumerate(odd_texts)}


def test_terms_are_words_and_pairs_after_stop_words(spark):
    df = spark.createDataFrame([("The Prix d'été_1 of a BIG price",), ("a",), ("price",)], "text string")
    rows = [r.terms for r in tx.with_terms(df).collect()]
    assert rows[0] == ["prix", "été_1", "big", "price", "prix été_1", "été_1 big", "big price"]
    assert rows[1] == [] and rows[2] == ["price"]


WORDS = "price policy supplier risk europe revenue drop market share budget the and of".split()


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(11)
    texts = [" ".join(rng.choice(WORDS, rng.integers(3, 200))) for _ in range(40)]
    texts += [texts[0]] * 20 + ["", "12 zz"]
    return texts, spark.createDataFrame([(i, f"s{i % 3}", t) for i, t in enumerate(texts)], SCHEMA)


def brute_force(texts, queries, size, k):
    """Dense tf-idf and a full sort."""
    chunks = [(i, n, c) for i, t in enumerate(texts) for n, c in enumerate(python_chunks(t))]

    def terms(text):
        words = [w for w in re.findall(r"\w\w+", text.lower()) if w not in tx.STOP_WORDS]
        return Counter(words + [f"{a} {b}" for a, b in zip(words, words[1:])])

    counted = [terms(c) for _, _, c in chunks]
    total = sum(counted, Counter())
    vocabulary = [t for t, _ in sorted(total.items(), key=lambda x: (-x[1], x[0]))[:size]]
    df = {t: sum(t in c for c in counted) for t in vocabulary}
    idf = {t: math.log((1 + len(chunks)) / (1 + df[t])) + 1 for t in vocabulary}

    def vector(c):
        v = np.array([c[t] * idf[t] for t in vocabulary])
        length = np.linalg.norm(v)
        return v / length if length else v

    matrix = np.array([vector(c) for c in counted])
    out = set()
    for q, text in queries:
        scores = np.round(matrix @ vector(terms(text)), 6)
        order = sorted(range(len(chunks)), key=lambda j: (-scores[j], chunks[j][:2]))[:k]
        out |= {(q, r, *chunks[j][:2], scores[j]) for r, j in enumerate(order, 1) if scores[j] > 0}
    return out


QUERIES = [(1, "price policy in Europe"), (2, "supplier risk"), (3, "unknown words"), (4, "revenue revenue drop")]


@pytest.mark.parametrize("size", [15, 2048])
def test_retrieval_equals_a_full_scan(spark, corpus, size):
    texts, docs = corpus
    index = rt.TextIndex.fit(docs, size)
    queries = spark.createDataFrame(QUERIES, "query_id long, text string")
    got = {tuple(r) for r in index.retrieve(queries, 5).collect()}
    want = brute_force(texts, QUERIES, size, 5)
    assert {g[:4] for g in got} == {w[:4] for w in want}
    scores = {w[:4]: w[4] for w in want}
    assert all(abs(g[4] - scores[g[:4]]) < 2e-6 for g in got)


def test_chunk_vectors_have_unit_length(spark, corpus):
    index = rt.TextIndex.fit(corpus[1])
    lengths = index.weights.groupBy("doc_id", "chunk_no").agg(F.sum(F.col("weight") ** 2).alias("n"))
    assert lengths.filter("abs(n - 1) > 1e-9").count() == 0


def test_saved_index_gives_the_same_hits(spark, corpus, tmp_path):
    index = rt.TextIndex.fit(corpus[1])
    stored = index.save(str(tmp_path / "index"))
    queries = spark.createDataFrame(QUERIES, "query_id long, text string")
    first = {tuple(r) for r in index.retrieve(queries).collect()}
    assert first == {tuple(r) for r in stored.retrieve(queries).collect()}
    evidence = stored.evidence(queries).collect()
    assert {r.query_id for r in evidence} == {1, 2, 4}
    assert all(e.source in r.sources for r in evidence for e in r.evidence)


@pytest.mark.parametrize("block", [1, 2, 4096])
def test_vector_topk_equals_a_full_scan(spark, block):
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(300, 8)).astype("float32")
    vectors[100:200] = vectors[0]  # a third are copies
    queries = rng.normal(size=(5, 8))
    queries[0] = vectors[0]
    df = spark.createDataFrame(
        [(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>"
    ).repartition(7)
    asked = spark.createDataFrame(
        [(i, v.tolist()) for i, v in enumerate(queries)], "query_id long, embedding array<double>"
    )
    got = {(r.query_id, r.rank): r.vec_id for r in rt.vector_topk(df, asked, 6, block).collect()}
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    scores = np.round(unit(vectors.astype(float)) @ unit(queries).T, 6)
    for q in range(5):
        order = sorted(range(300), key=lambda j: (-scores[j, q], j))[:6]
        assert [got[q, r] for r in range(1, 7)] == order


def test_counted_terms_leave_a_task_once_per_batch():
    """F11 to F14: rows follow the distinct terms, and numbers spell the same words and pairs."""
    words = [["a1", "b1", "a1", "b1"], [], None, ["b1"], ["a1", "b1"]]
    batch = pa.RecordBatch.from_pydict({"words": pa.array(words, pa.list_(pa.string()))})
    rows = [r for out in rt.counted_terms(iter([batch])) for r in out.to_pylist()]
    assert sorted(map(tuple, (r.values() for r in rows))) == [
        ("a1", 3, 2), ("a1 b1", 3, 2), ("b1", 4, 3), ("b1 a1", 1, 1)
    ]
    names = pa.array(["b1 a1", "zz", "b1"])
    found = rt.known_terms(batch.column("words"), names)
    assert [x.tolist() for x in found] == [[0, 0, 3, 4], [0, 2, 2, 2], [1, 2, 1, 1]]
    nothing = batch.slice(1, 2)
    assert [len(x) for x in rt.known_terms(nothing.column("words"), names)] == [0, 0, 0]
    assert sum(out.num_rows for out in rt.counted_terms(iter([nothing]))) == 0


def test_embedders_read_lists_and_arrow_alike():
    """terms are taken by number; an unknown, missing or empty list has the empty vector."""
    rows = [["x", "y", "x"], None, [], ["q"]]
    for embedder in (HashingEmbedder(8), TfidfEmbedder(2, terms=[("x", 2.0), ("y", 1.0)])):
        run = embedder.load(embedder.state())
        one, two = run(rows), run(pa.array(rows, pa.list_(pa.string())))
        assert embedder.arrow and one.shape == (4, embedder.dim) and (one == two).all()
        assert not one[1:3].any()
    assert run(rows)[0].tolist() == pytest.approx([4 / 17**0.5, 1 / 17**0.5])


def test_vectors_are_computed_once_for_count_and_search(spark):
    """the number of vectors is known before they are dealt; they are not embedded again for it."""
    docs = spark.createDataFrame([(k, ["x", f"y{k}"]) for k in range(5)], "vec_id long, terms array<string>")
    vectors = embed(docs, ["vec_id"], HashingEmbedder(8))
    found = rt.vector_topk(vectors, vectors.withColumnRenamed("vec_id", "query_id"), k=1)
    assert "MapInArrow" not in found._jdf.queryExecution().toString()
    assert {(r.query_id, r.vec_id) for r in found.collect()} >= {(0, 0)}
