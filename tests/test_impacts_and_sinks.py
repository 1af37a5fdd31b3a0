"""The impact-ordered index, shared offers, sorted tables, text files and embedders."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from bizlens import session
from bizlens.functions import text as tx
from bizlens.operators import decisions, impacts, retrieval
from bizlens.operators.embedders import HashingEmbedder, TfidfEmbedder, embed
from bizlens.sources import files


def sparse(seed, chunks=400, terms=60):
    """Chunks over terms of very uneven frequency; some chunks are copies, so that scores tie."""
    rng = np.random.default_rng(seed)
    share = 1 / np.arange(1, terms + 1)
    rows = []
    for c in range(chunks):
        if c % 5 == 4:
            rows += [(c // 3, c, t, w) for _, d, t, w in rows if d == c - 1]
            continue
        own = np.unique(rng.choice(terms, size=rng.integers(1, 12), p=share / share.sum()))
        weight = rng.uniform(0.05, 1, len(own))
        rows += [(c // 3, c, int(t), float(w)) for t, w in zip(own, weight / np.linalg.norm(weight), strict=True)]
    return rows


def asked_rows(seed, queries=30, terms=60):
    rng = np.random.default_rng(seed)
    return [
        (q, int(t), float(rng.uniform(0.05, 1)))
        for q in range(queries)
        for t in rng.choice(terms + 5, size=rng.integers(1, 7), replace=False)
        if t < terms
    ]


def full_scan(rows, asked, k):
    vectors, out = {}, set()
    for d, c, t, w in rows:
        vectors.setdefault((d, c), {})[t] = w
    queries = {}
    for q, t, w in asked:
        queries.setdefault(q, {})[t] = w
    for q, own in queries.items():
        scores = {key: sum(own[t] * v[t] for t in own if t in v) for key, v in vectors.items() if own.keys() & v.keys()}
        best = sorted(scores, key=lambda key: (-round(scores[key], 6), key))[:k]
        out |= {(q, r, *key, round(scores[key], 6)) for r, key in enumerate(best, 1)}
    return out


@pytest.mark.parametrize("seed, k, seeds", [(1, 3, 4096), (2, 1, 40), (3, 8, 1)])
def test_search_equals_a_full_scan(spark, tmp_path, monkeypatch, seed, k, seeds):
    monkeypatch.setattr(impacts, "SEED_ROWS", seeds)
    monkeypatch.setattr(impacts, "CELL_ROWS", 7)  # frequent cells are dealt over several keys
    rows, asked = sparse(seed), asked_rows(seed)
    weights = spark.createDataFrame(rows, "doc_id long, chunk_no int, term_no int, weight double").repartition(6)
    index = impacts.ImpactIndex.write(weights, ["doc_id", "chunk_no"], str(tmp_path / "index"))
    table = spark.createDataFrame(asked, "query_id long, term_no int, query_weight double")
    got = {(r.query_id, r["rank"], r.doc_id, r.chunk_no, r.score) for r in index.search(table, k).collect()}
    want = full_scan(rows, asked, k)
    assert {g[:4] for g in got} == {w[:4] for w in want}
    by = {w[:4]: w[4] for w in want}
    assert all(abs(g[4] - by[g[:4]]) < 2e-6 for g in got)


def test_bounds_leave_most_postings_unread(spark, tmp_path, monkeypatch):
    """One rare strong term and one that every chunk has: the frequent one is never read."""
    rows = [(c, 0, 0, 0.1) for c in range(3000)] + [(c, 0, 1, 0.9) for c in range(0, 3000, 100)]
    weights = spark.createDataFrame(rows, "doc_id long, chunk_no int, term_no int, weight double")
    index = impacts.ImpactIndex.write(weights, ["doc_id", "chunk_no"], str(tmp_path / "index"))
    read = []
    real = impacts.ImpactIndex.contributions

    def counted(self, cells):
        out = real(self, cells)
        read.append(out.count())
        return out

    monkeypatch.setattr(impacts.ImpactIndex, "contributions", counted)
    asked = spark.createDataFrame([(1, 0, 0.5), (1, 1, 0.9)], "query_id long, term_no int, query_weight double")
    found = index.search(asked, 4).orderBy("rank").collect()
    assert [r.doc_id for r in found] == [0, 100, 200, 300] and read[-1] == 30


def test_search_of_nothing(spark, tmp_path):
    weights = spark.createDataFrame(sparse(4, 20), "doc_id long, chunk_no int, term_no int, weight double")
    index = impacts.ImpactIndex.write(weights, ["doc_id", "chunk_no"], str(tmp_path / "index"))
    assert index.search(spark.createDataFrame([], "query_id long, term_no int, query_weight double"), 3).count() == 0
    far = spark.createDataFrame([(1, 999, 1.0)], "query_id long, term_no int, query_weight double")
    assert index.search(far, 3).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_shared_offers_are_filled_in_price_order(spark, seed):
    rng = random.Random(seed)
    offers = [(f"s{k}", float(rng.choice([3, 4, 4, 7, 9])), float(rng.randint(0, 60))) for k in range(8)]
    demand = [(f"r{k}", float(rng.randint(0, 90))) for k in range(5)]
    want, left = set(), sorted(([c, n, k] for n, c, k in offers), key=lambda o: (o[0], o[1]))
    total = sum(k for *_, k in offers)
    capacity, before = {n: k for n, _, k in offers}, 0.0
    for region, volume in demand:
        open_ = volume
        for offer in left:
            take = min(open_, offer[2])
            if take > 0:
                offer[2] -= take
                open_ -= take
                status = "served" if before + volume <= total else "partly served"
                want.add((region, offer[1], offer[0], capacity[offer[1]], volume, status, take, round(take * offer[0], 2)))
        if open_ == volume and volume > 0:
            want.add((region, None, None, None, volume, "unserved", 0.0, 0.0))
        before += volume
    got = decisions.shared_fill(
        spark.createDataFrame(offers, "supplier string, unit_cost double, capacity double").repartition(3),
        spark.createDataFrame(demand, "region string, required_volume double"),
    )
    assert {tuple(r) for r in got.collect()} == want


def test_sorted_table_keeps_its_order(spark, tmp_path):
    rows = spark.range(5000).select("id", (F.col("id") * 7919 % 101).alias("x")).repartition(9)
    files.write_sorted(rows, [F.col("x").desc(), F.col("id")], str(tmp_path / "t"))
    back = files.read_sorted(spark, str(tmp_path / "t")).collect()
    want = sorted(((k * 7919 % 101, k) for k in range(5000)), key=lambda r: (-r[0], r[1]))
    assert [(r.x, r.id) for r in sorted(back, key=lambda r: r.place)] == want
    assert sorted(r.place for r in back) == list(range(1, 5001))
    files.write_sorted(rows.limit(0), [F.col("id")], str(tmp_path / "none"))
    assert files.read_sorted(spark, str(tmp_path / "none")).count() == 0


def test_text_files_come_back_whole(spark, tmp_path):
    texts = ["a\nb\r\nc", "", "ends\n", "\n\n", "É ñ\t", None, " x "]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    files.write_text_folder(docs, str(tmp_path / "t"))
    back = {r.doc_id: (r.text, r.bytes, r.source) for r in files.read_text_folders(spark, str(tmp_path / "t")).collect()}
    assert {k: v[0] for k, v in back.items()} == {k: t or "" for k, t in enumerate(texts)}
    assert all(v[1] == len((texts[k] or "").encode()) + 1 and v[2].startswith(f"doc_id={k}/") for k, v in back.items())


def test_embedders_share_one_interface(spark):
    rows = [(1, "s", "price policy price"), (2, "s", "supplier risk"), (3, "s", ""), (4, "s", None)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    terms = tx.with_terms(docs).select("doc_id", "terms")
    for embedder in (HashingEmbedder(16), TfidfEmbedder(5)):
        fitted = embedder.fit(docs)
        found = {r.doc_id: np.array(r.embedding) for r in embed(terms, ["doc_id"], fitted).collect()}
        assert set(found) == {1, 2, 3, 4} and all(len(v) == fitted.dim for v in found.values())
        assert found[1].any() and not found[3].any() and not found[4].any()


def test_an_embedder_is_opened_once_in_a_worker(spark):
    class Counting:
        reads, dim = "terms", 1

        def fit(self, docs):
            return self

        def state(self):
            return None

        def load(self, state):
            opened = [0]
            opened[0] += 1
            return lambda values: np.full((len(values), 1), opened[0])

    terms = spark.range(5000).select("id", F.array(F.lit("x")).alias("terms")).coalesce(1)
    assert {r.embedding[0] for r in embed(terms, ["id"], Counting()).collect()} == {1.0}


def test_text_files_are_dealt_over_buckets(spark, tmp_path):
    """The driver lists buckets only, however many documents there are; equal ids share a file."""
    docs = spark.createDataFrame([(7, "a"), (7, "a"), (None, "b"), (-3, None)], "doc_id long, text string")
    for _ in range(2):
        files.write_text_folder(docs, str(tmp_path / "t"))
    assert all(p.name.startswith("bucket=") for p in (tmp_path / "t").iterdir())
    back = {r.doc_id: (r.text, r.bytes, r.source) for r in files.read_text_folders(spark, str(tmp_path / "t")).collect()}
    assert {k: v[:2] for k, v in back.items()} == {7: ("a\na", 4), None: ("b", 2), -3: ("", 1)}
    assert back[7][2].startswith("doc_id=7/") and back[None][2].startswith("doc_id=__HIVE_DEFAULT_PARTITION__/")


def test_a_group_sends_only_what_can_be_among_the_best(spark, tmp_path):
    """Every chunk shares a term with every query, but no row per query and chunk leaves a task."""
    rng = np.random.default_rng(6)
    rows = [(c, 0, t, float(w)) for c in range(500) for t, w in enumerate(rng.uniform(0.1, 0.9, 3))]
    weights = spark.createDataFrame(rows, "doc_id long, chunk_no int, term_no int, weight double")
    index = impacts.ImpactIndex.write(weights, ["doc_id", "chunk_no"], str(tmp_path / "index"))
    asked = [(q, t, float(rng.uniform(0.1, 0.9))) for q in range(20) for t in range(3)]
    cells = spark.createDataFrame(
        [(*a, 0.0, 4) for a in asked], "query_id long, term_no int, query_weight double, bound double, places int"
    )
    assert index.contributions(cells).count() == 20 * 4


def test_queries_may_have_composed_ids(spark, tmp_path):
    """The batch of the answers names a query by kind and key."""
    rows, asked = sparse(9, 60), asked_rows(9, 5)
    weights = spark.createDataFrame(rows, "doc_id long, chunk_no int, term_no int, weight double")
    index = impacts.ImpactIndex.write(weights, ["doc_id", "chunk_no"], str(tmp_path / "index"))
    table = spark.createDataFrame(asked, "query_id long, term_no int, query_weight double").withColumn(
        "query_id", F.struct(F.lit("q").alias("kind"), F.col("query_id").cast("string").alias("key"))
    )
    got = {(int(r.query_id.key), r["rank"], r.doc_id, r.chunk_no) for r in index.search(table, 3).collect()}
    assert got == {w[:4] for w in full_scan(rows, asked, 3)}


def test_vectors_are_searched_where_they_lie(spark, tmp_path, monkeypatch):
    """However many blocks of queries there are, no vector is repeated or shuffled."""
    monkeypatch.setattr(impacts, "SEED_ROWS", 3)
    rows, asked = sparse(5), asked_rows(5)
    weights = spark.createDataFrame(rows, "doc_id long, chunk_no int, term_no int, weight double").repartition(6)
    index = impacts.ImpactIndex.write(weights, ["doc_id", "chunk_no"], str(tmp_path / "index"))
    cells = [(*a, 0.0, 2) for a in asked]
    kinds = "query_id long, term_no int, query_weight double, bound double, places int"
    found = index.contributions(spark.createDataFrame(cells, kinds))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan and "CoGroup" not in plan
    assert found.count() > 0


def test_a_group_raises_the_bound_of_the_next(spark, tmp_path, monkeypatch):
    """Groups of one task: what is worse than the best of the groups before stays in the task."""
    monkeypatch.setattr(impacts, "CELL_ROWS", 10)
    monkeypatch.setattr(impacts, "SLICE", 10)
    rows = [(c, 0, 0, 1 - c / 1000) for c in range(500)]
    weights = spark.createDataFrame(rows, "doc_id long, chunk_no int, term_no int, weight double")
    index = impacts.ImpactIndex.write(weights, ["doc_id", "chunk_no"], str(tmp_path / "index"))
    index.vectors = index.vectors.coalesce(1).sortWithinPartitions("doc_id")
    cells = spark.createDataFrame([(1, 0, 1.0, 0.0, 4)], "query_id long, term_no int, query_weight double, bound double, places int")
    assert sorted(r.doc_id for r in index.contributions(cells).collect()) == [0, 1, 2, 3]


def test_many_hits_leave_other_texts_behind(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "BROADCAST_ROWS", 3)
    monkeypatch.setattr(retrieval, "small_side", lambda df, limit=3: session.small_side(df, limit))
    docs = spark.createDataFrame([(i, f"s{i}", f"word{i} and more") for i in range(50)], "doc_id long, source string, text string")
    index = retrieval.TextIndex.fit(docs)
    queries = spark.createDataFrame([(i, f"word{i}") for i in range(8)], "query_id long, text string")
    hits = index.retrieve(queries, 1)
    found = index.with_text(hits)
    assert "LeftSemi" in found._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.query_id, r.doc_id, r.source, r.text) for r in found.collect()} == {(i, i, f"s{i}", f"word{i} and more") for i in range(8)}
