"""Operators 11 to 13 against brute force, with nulls, ties, repeated rows, long texts, empty tables."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from bizlens.llm import negatives, ngramjoin, phrases

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars int, node long, size int, u long"


def documents(spark, rows):
    """Rows of (doc_id, text, lang), with extra columns named like the operators' own."""
    full = [(i, t, x, "s", len(t or ""), 7, 7, 7) for i, t, x in rows]
    return spark.createDataFrame(full, DOCS).repartition(5)


def texts(seed=3):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)] + ["The", "of", "É", "naïve", "a b"]
    out = []
    for _ in range(40):
        base = [rng.choice(words) for _ in range(rng.choice([3, 12, 60, 200]))]
        out.append(" ".join(base))
        for _ in range(rng.choice([0, 1, 4])):
            copy = list(base)
            for _ in range(rng.choice([1, 1, 2, 5])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            out.append(rng.choice([" ", "\t", "  \n"]).join(copy))
    passage = " ".join(rng.choice(words) for _ in range(80))
    out += [passage + " " + " ".join(rng.choice(words) for _ in range(k)) for k in (1, 5, 12, 14, 15, 40, 80)]
    out += ["x", "X", "x y", "x  y", "", " \t\n ", "one two three four", "ONE two three four", out[0], out[0].upper()]
    out.append(" ".join(rng.choice(words) for _ in range(60_000)))
    return out


# --- 11


def shingle_set(text):
    words = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    if len(words) < 4:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + 4]) for i in range(len(words) - 3))


def joined(rows):
    """The smallest id that links reach, by testing all pairs."""
    sets = [shingle_set(t) for _, t, _ in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                parent[find(a)] = find(b)
    names = defaultdict(list)
    for k, (doc, _, _) in enumerate(rows):
        names[find(k)].append(doc)
    least = {k: min((d for d in v if d is not None), default=None) for k, v in names.items()}
    return Counter((doc, len(sets[k]), least[find(k)]) for k, (doc, _, _) in enumerate(rows))


def join_rows(spark, rows, tmp_path):
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    return Counter(tuple(r) for r in ngramjoin.op11_ngram_join(spark, str(tmp_path)).collect())


def test_join_equals_all_pairs(spark, tmp_path):
    rows = [(100 - k, t, "en") for k, t in enumerate(texts())]
    rows += [(500, None, None), (501, None, "en"), (None, "lonely words stand here now", None), (None, texts()[0], "en"), rows[3], rows[3]]
    assert join_rows(spark, rows, tmp_path) == joined(rows)


def test_join_of_a_hot_passage_and_of_a_chain(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ngramjoin, "FREQUENT", 5)  # the passage counts as frequent
    monkeypatch.setattr(ngramjoin, "TILE_ROWS", 4)  # and its tiles are cut into blocks
    rng = random.Random(5)
    hot = [f"h{k}" for k in range(70)]
    rows = [(k, " ".join(hot + [f"q{k}_{j}" for j in range(rng.choice([0, 2, 4, 6, 9, 14, 60]))]), "en") for k in range(60)]
    chain = [f"c{k}" for k in range(100)]
    for k in range(12):
        chain = chain[3:] + [f"d{k}_{j}" for j in range(3)]
        rows.append((1000 + k, " ".join(chain), "en"))
    assert join_rows(spark, rows, tmp_path) == joined(rows)


def test_join_of_an_empty_table(spark, tmp_path):
    assert not join_rows(spark, [], tmp_path)


def test_a_linked_pair_shares_the_reserve():
    """Sizes up to 400: the filters' numbers leave no room for a linked pair to be missed."""
    for n in range(1, 400):
        for m in range(ngramjoin.needed(n), n + 1):
            overlap = -(-85 * (n + m) // 185)
            least = min(ngramjoin.reserve(n), ngramjoin.reserve(m))
            assert overlap >= max(ngramjoin.needed(n), ngramjoin.needed(m))
            assert ngramjoin.kept_length(n) <= n
            assert least >= max(ngramjoin.reserve(ngramjoin.needed(n)), ngramjoin.reserve(ngramjoin.needed(m)))
            assert int(np.log(n) // ngramjoin.BAND) - int(np.log(m) // ngramjoin.BAND) <= 1


def test_bitmaps_never_rule_out_a_link():
    batch = pa.RecordBatch.from_pydict({"text": texts(8)})
    rows = next(ngramjoin.set_rows(iter([batch])))
    sets = [set(np.frombuffer(x, np.uint64).tolist()) for x in rows.column("shingles").to_pylist()]
    marks = [np.frombuffer(x, np.uint64) for x in rows.column("marks").to_pylist()]
    for a in range(len(sets)):
        for b in range(a):
            bound = len(sets[a]) - int(np.bitwise_count(marks[a] & ~marks[b]).sum())
            assert len(sets[a] & sets[b]) <= bound


# --- 12


def vector_rows(seed=1, n=700, dim=6, scale=0.6):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(4, dim))
    rows = []
    for k in range(n):
        v = (centres[k % 4] + rng.normal(size=dim)) * scale / np.sqrt(dim)
        rows.append((k, [float(x) for x in np.float32(v)], int(rng.integers(10))))
    for k in range(200, 420):  # a third are copies: ties
        rows[k] = (k, rows[200][1], rows[k][2])
    rows += [
        (700, None, 1), (701, [0.0] * dim, 1), (702, [float("nan")] + [0.0] * (dim - 1), 2), (703, [None] * dim, 3),
        (704, [float("inf")] * dim, 4), (705, rows[0][1], None), (None, rows[0][1], 1), (750, [1e30] * dim, 1),
        rows[50], rows[50], (800, [0.0] * dim, 1), (801, [0.25, 0.5], 1), (802, [0.5, 0.5], 1), (850, [0.5, 0.25], 1),
        (803, [0.4, 0.25], 2), (900, [], 3), (50, [9.0] * dim, 12),
    ]
    return rows


SCHEMA = "vec_id long, embedding array<float>, label int"


def by_sql(frame, columns):
    con = duckdb.connect()
    con.register("embeddings", frame.toArrow())
    return Counter(con.sql(f"SELECT {columns} FROM ({negatives.ORACLE})").fetchall())


COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


@pytest.mark.parametrize("block, unit, step", [(4096, 1024, 512), (64, 8, 16)])
def test_negatives_equal_a_full_scan(spark, monkeypatch, block, unit, step):
    for name, value in (("BLOCK", block), ("UNIT", unit), ("STEP", step)):
        monkeypatch.setattr(negatives, name, value)
    frame = spark.createDataFrame(vector_rows(), SCHEMA).withColumn("score", F.lit(1)).withColumn("r", F.lit(2))
    got = negatives.hard_negatives(frame.repartition(4), negatives.relabelled())
    want = by_sql(frame, ", ".join(COLUMNS))
    assert len(want) > 50
    assert Counter(tuple(r) for r in got.select(*COLUMNS).collect()) == want


def test_a_walk_ends_early_and_loses_nothing():
    rng = np.random.default_rng(4)
    x = (rng.normal(size=(3000, 8)) * rng.choice([5, 300], size=(3000, 1))).astype(np.int64)
    v = (np.array([400, 0, 0, 0, 0, 0, 0, 0]) + rng.normal(size=(20, 8)) * 9).astype(np.int64)
    ids, labels = np.arange(9000, 9020), np.zeros(20, np.int64)
    seen = []
    real = negatives.products
    negatives.products = lambda a, b: seen.append(a.shape[0] * b.shape[0]) or real(a, b)
    try:
        low = np.full((20, 1), -np.inf)
        best = negatives.walk(v, ids, labels, x, np.arange(3000), np.zeros(3000, np.int64), low, -low, True, 5)
    finally:
        negatives.products = real
    exact = v @ x.T
    for k in range(20):
        want = sorted(range(3000), key=lambda j: (-exact[k, j], j))[:5]
        assert best.id[best.goal == k].tolist() == want
    assert sum(seen) < 20 * 3000 / 2


def test_negatives_of_an_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert negatives.hard_negatives(empty).count() == 0
    assert negatives.hard_negatives(spark.createDataFrame([(50, [1.0], 1)], SCHEMA)).count() == 0


# --- 13


def counted(rows):
    """Counts of all phrases per language by plain Python."""
    f, n = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang or "und"] += len(words)
            for size in range(1, 5):
                for k in range(len(words) - size + 1):
                    f[lang or "und"][tuple(words[k : k + size])] += 1
    return f, n


def best_phrases(rows, least, top):
    f, n = counted(rows)
    out = set()
    for lang, count in f.items():
        good = {p: a for p, a in count.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in good.items():
            if any(
                len(q) > len(p) and 100 * b >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q)))
                for q, b in good.items()
            ):
                continue
            cuts = [(2000000 * a // (count[p[:k]] + count[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            kept.append((-score, -a, " ".join(p).encode(), count[p[:k]], count[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(kept)[:top], 1):
            out.add((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return out


def phrase_rows():
    rng = random.Random(9)
    words = [f"w{k}" for k in range(30)] + ["É", "a b", "New", "York"]
    rows = []
    for k in range(150):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", ", ", ". ", "\n"]) for _ in range(60))
        rows.append((k, text + "New York City of New York", rng.choice(["en", "de", None, "und"])))
    rows += [(900, None, "en"), (901, "", "fr"), (902, " .,; ", "es"), (None, "New York City", "en"), rows[5], rows[5]]
    rows.append((903, "tick tock " * 40_000, "en"))
    return rows


@pytest.mark.parametrize("least, top", [(30, 2000), (8, 5)])
def test_phrases_equal_plain_counts(spark, least, top):
    rows = phrase_rows()
    got = phrases.collocations(documents(spark, rows), least=least, top=top)
    names = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    found = got.select(*names, "first").collect()
    assert {tuple(r)[:-1] for r in found} == best_phrases(rows, least, top)
    by_id = {i: t for i, t, _ in rows}
    for r in found:  # the pointer leads to the phrase
        words = re.findall("[^\x20\x09.,;:!?\x0a-\x0d]+", by_id[r.first.doc_id].translate(LOWER))
        assert " ".join(words[r.first.word : r.first.word + r.phrase.count(" ") + 1]) == r.phrase


def test_equal_fingerprints_of_different_phrases_are_told_apart(spark, monkeypatch):
    """With fingerprints of three bits nearly everything collides; the counts stay those of the texts."""
    rows = phrase_rows()[:80]
    real = phrases.language_grams

    def weak(words, size, number, value):
        first, found = real(words, size, number, value)
        return first, (found >> np.uint64(61)) << np.uint64(61)

    batch = pa.RecordBatch.from_pydict(
        {"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows], "lang": [r[2] for r in rows]}
    )
    monkeypatch.setattr(phrases, "language_grams", weak)
    everything = np.full(1 << 20, ~np.uint64(0))
    count = Counter()
    for out in phrases.spelled(iter([batch]), everything):
        for r in out.to_pylist():
            if r["words"]:
                count[r["lang"], tuple(r["phrase"].split(" "))] += r["n"]
    f, _ = counted(rows)
    assert count == Counter({(lang, p): a for lang, c in f.items() for p, a in c.items()})


def test_phrases_of_an_empty_table(spark):
    assert phrases.collocations(documents(spark, [])).count() == 0
