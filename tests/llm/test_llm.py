"""The pipeline operators against brute force on small tables, with the odd rows every stage must bear."""

import hashlib
import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from bizlens.llm import decontam, language, lines, neardup, packing, pages, quality, substrings, toxicity, urls
from bizlens.llm.suffix import permuted_prefixes, suffix_array

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node long, hits string"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(n))


def rows(extra=()):
    rng = random.Random(3)
    out = [(i, words(rng, 60), "en", "s", 1, 7, "x") for i in range(12)]
    out += [(50, None, None, None, None, None, None), (51, "", "en", "s", 0, 1, "x")]
    out += [(None, words(rng, 40), "en", "s", 1, 1, "x"), (None, None, None, None, None, None, None)]
    out += [(60, words(rng, 9000), "en", "s", 1, 1, "x"), (3, out[3][1], "en", "s", 1, 7, "x")]
    return out + list(extra)


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def brute_substrings(table):
    seen, out = {}, []
    texts = [(d, (t or "").encode()) for d, t in table]
    for d, b in texts:
        for p in range(len(b) - 49):
            if d is not None:
                seen[b[p : p + 50]] = min(seen.get(b[p : p + 50], d), d)
    for d, b in texts:
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if d is not None and seen.get(b[p : p + 50], d) < d:
                gone[p : p + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = gone.count(b"\0\1") + (1 if gone and gone[0] else 0)
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("crowd", [1, 20_000])
def test_substrings(spark, crowd):
    rng = random.Random(5)
    shared, long = words(rng, 14), words(rng, 60)
    extra = [(100 + i, words(rng, 5) + shared + words(rng, 5), "en", "s", 1, 1, "x") for i in range(8)]
    extra += [(200, long, "en", "s", 1, 1, "x"), (201, long[:150] + "Z" + long[150:], "en", "s", 1, 1, "x")]
    extra += [(202, "é" * 80, "en", "s", 1, 1, "x"), (203, "é" * 60, "en", "s", 1, 1, "x")]
    table = rows(extra)
    got = substrings.substring_dedup(spark.createDataFrame(table, SCHEMA), crowd, 500).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_substrings([(r[0], r[1]) for r in table])


def test_contexts_that_share_bits_of_a_hash_are_no_copies(monkeypatch):
    """One passage between different surroundings, with context hashes alike in 40 and in 64 bits."""
    rng = random.Random(6)
    shared = words(rng, 12)
    texts = [(words(rng, 8) + shared + words(rng, 8)).encode() for _ in range(20)]
    own = {"block": range(20), "ids": [np.array([i]).tobytes() for i in range(20)]}
    own |= {"sizes": [np.array([len(t)]).tobytes() for t in texts], "data": [substrings.squeezed(t) for t in texts]}
    batch = substrings.pa.RecordBatch.from_pydict({k: list(v) for k, v in own.items()})
    real = substrings.mixed
    for same in (40, 64):
        monkeypatch.setattr(substrings, "mixed", lambda h, same=same: (real(h) >> np.uint64(same - 1) >> np.uint64(1)) << np.uint64(same % 64))
        rows = substrings.pa.Table.from_batches(substrings.entries(iter([batch]), 1)).to_pandas()
        for r in substrings.matched((0,), rows).itertuples():
            found = substrings.Anchors(batch.slice(r.block, 1).to_pylist()[0], 1)
            for at in np.frombuffer(r.covered, "<u4").tolist():
                context = texts[r.block][found.begin[at] : found.end[at]]
                assert any(context in t for t in texts[: r.block])


def test_frequent_anchors_are_never_gathered(spark, monkeypatch):
    """One passage in every text: no shard gets its anchors, shards are even, and the result is whole."""
    rng = random.Random(7)
    shared = words(rng, 30)
    table = [(i, words(rng, 60) + shared + words(rng, 60)) for i in range(120)]
    sent, settled = [], substrings.settled

    def kept(df, name):
        out = settled(df, name)
        if name == "blocks":
            sent.extend(out.collect())
        return out

    monkeypatch.setattr(substrings, "settled", kept)
    docs = spark.createDataFrame(table, "doc_id long, text string")
    got = substrings.substring_dedup(docs, 50, 500).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_substrings(table)
    batch = substrings.pa.RecordBatch.from_pylist([r.asDict() for r in sent])
    counts = next(substrings.tallied(iter([batch]), 1 << 12)).to_pandas()
    full = substrings.full_buckets((0,), counts, 50)["bucket"].to_numpy()
    rows = substrings.pa.Table.from_batches(substrings.entries(iter([batch]), 8, full, 1 << 12)).to_pandas()
    size = rows["keys"].map(len).groupby(rows["shard"]).sum() // substrings.ENTRY_BYTES
    assert len(size) == 8 and size.max() < 2 * size.min()
    anchors = np.concatenate([substrings.from_five(k[: 5 * (len(k) // substrings.ENTRY_BYTES)]) for k in rows["keys"]])
    assert np.unique(anchors, return_counts=True)[1].max() <= 50


def test_substrings_of_nothing(empty):
    assert substrings.substring_dedup(empty).count() == 0


def test_suffix_array():
    rng = np.random.default_rng(0)
    for n, letters in [(1, 1), (5, 1), (40, 2), (200, 3)]:
        data = rng.integers(0, letters, n).astype(np.uint8)
        text = data.tobytes()
        order = sorted(range(n), key=lambda i: text[i:])
        assert suffix_array(data, 1 << 20).tolist() == order
        found = permuted_prefixes(data, np.array(order), 50)
        for a, b in zip(order, order[1:], strict=False):
            common = 0
            while common < 50 and max(a, b) + common < n and text[a + common] == text[b + common]:
                common += 1
            assert found[b] == common


def brute_lines(table, least):
    docs = {}
    for d, t in table:
        if d is not None and t:
            docs[(d, t)] = [(i, x) for i, x in enumerate(t.split("\n")) if x.strip()]
    order = sorted(docs)
    seen, gone = set(), {}
    for key in order:
        own = docs[key]
        for a in range(len(own)):
            for b in range(a + 1, min(a + least, len(own)) + 1):
                run = tuple(x for _, x in own[a:b])
                if sum(len(x.split()) for x in run) >= least:
                    if run in seen:
                        gone.setdefault(key, set()).update(i for i, _ in own[a:b])
                    seen.add(run)
    return gone


def test_short_repeated_lines_are_deleted(spark):
    """Boilerplate of few words between different lines, which no longer run holds."""
    rng = random.Random(10)
    table = [(i, f"{words(rng, 8)}\nAll rights reserved.\n{words(rng, 7)}\nMenu\n{words(rng, 3)}") for i in range(5)]
    got = lines.deduplicated(spark.createDataFrame(table, "doc_id long, text string")).collect()
    for r in got:
        own = table[r.doc_id][1].split("\n")
        assert r.text.split("\n") == (own if r.doc_id == 0 else own[::2])
        assert r.n_removed_lines == (0 if r.doc_id == 0 else 2)


@pytest.mark.parametrize("least", [2, 6])
def test_runs_of_a_given_size(spark, least):
    rng = random.Random(11)
    pool = [words(rng, n) for n in (1, 1, 2, 2, 3, 7, 9)] + [""]
    table = [(i, "\n".join(rng.choice(pool) for _ in range(8))) for i in range(40)]
    gone = brute_lines(table, least)
    for r in lines.deduplicated(spark.createDataFrame(table, "doc_id long, text string"), least).collect():
        assert r.n_removed_lines == len(gone.get((r.doc_id, table[r.doc_id][1]), set()))


def test_runs_are_doubled_until_none_repeats(spark, monkeypatch):
    """Also where single words count: the longest power of two of every later copy is found."""
    rng = random.Random(12)
    base = [words(rng, 3) for _ in range(11)]
    table = [(i, "\n".join([*(words(rng, 4) for _ in range(i)), *base, words(rng, 5)])) for i in range(3)]
    table += [(3, "\n".join([*base[4:7], "", words(rng, 2), base[0], base[0], base[0]]))]
    steps = []
    double = lines.doubled
    monkeypatch.setattr(lines, "doubled", lambda ranks, step: steps.append(step) or double(ranks, step))
    docs = spark.createDataFrame(table, "doc_id long, text string")
    found = lines.named_runs(lines.sequences(docs, 1)).where("end is not null").collect()
    own = {d: [x for x in t.split("\n") if x] for d, t in table}
    want, seen = set(), {}
    for d in sorted(own):
        for k in range(len(own[d])):
            for size in (1, 2, 4, 8):
                run = tuple(own[d][k : k + size])
                if len(run) == size and seen.setdefault(run, (d, k)) < (d, k):
                    want.add((d, k, k + size))
    assert {(r.doc_id, r.k, r.end) for r in found} == want
    assert steps == [1, 2, 4] and any(end - k == 8 for _, k, end in want)


def test_lines(spark):
    rng = random.Random(8)
    pool = [words(rng, n) for n in (1, 1, 2, 2, 3, 7, 9)] + ["", "  "]
    extra = [(300 + i, "\n".join(rng.choice(pool) for _ in range(8)), "en", "s", 1, 1, "x") for i in range(40)]
    table = rows(extra)
    # earlier means a smaller (doc_id, text hash); ids are unique where texts differ
    gone = brute_lines([(r[0], r[1]) for r in table], lines.MIN_WORDS)
    got = lines.deduplicated(spark.createDataFrame(table, SCHEMA)).collect()
    assert len(got) == len(table)
    originals = {r[0]: r[1] for r in table}
    for r in got:
        lost = gone.get((r.doc_id, originals[r.doc_id]), set()) if r.doc_id is not None else set()
        assert r.n_removed_lines == len(lost)
        if lost:
            left = "\n".join(x for i, x in enumerate(originals[r.doc_id].split("\n")) if i not in lost)
            assert r.text == (left if left.strip() else "")


def test_neardup(spark):
    rng = random.Random(9)
    base = words(rng, 100).split()
    near = base[:50] + ["zzzz"] + base[51:]
    far = base[:50] + words(rng, 50).split()
    extra = [(400, " ".join(base)), (401, " ".join(near)), (402, " ".join(far)), (403, " ".join(base))]
    table = rows([(*e, "en", "s", 1, 1, "x") for e in extra])
    docs = spark.createDataFrame(table, SCHEMA)
    found = {}
    for r in neardup.classes(docs.select("doc_id", "text")).collect():
        found[r.doc_id] = r.component
    assert found[400] == found[401] == found[403] != found[402]
    kept = neardup.neardup_stage(spark, docs, "")
    assert kept.columns == docs.columns
    ids = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)
    assert ids == [*range(12), 50, 51, 60, 400, 402]


def test_bitmaps_rule_out_no_link(spark, monkeypatch):
    """A group of texts around the threshold: the same classes with and without the bound, which
    fewer pairs pass."""
    rng = random.Random(12)
    base = words(rng, 120).split()
    table = []
    for i in range(60):
        own = list(base)
        for _ in range(rng.randint(1, 4)):
            own[rng.randrange(120)] = words(rng, 1)
        table.append((i, " ".join(own)))
    docs = spark.createDataFrame(table, "doc_id long, text string")
    made, settled, absent = [], neardup.settled, neardup.absent

    def counted(df, name):
        out = settled(df, name)
        made.append(out.count() if name == "pairs" else 0)
        return out

    monkeypatch.setattr(neardup, "settled", counted)
    bound = {r.doc_id: r.component for r in neardup.classes(docs).collect()}
    pairs = sum(made)
    made.clear()
    monkeypatch.setattr(neardup, "absent", lambda marks, other: neardup.F.lit(0))
    assert {r.doc_id: r.component for r in neardup.classes(docs).collect()} == bound
    assert pairs < sum(made)

    def marks(blob):
        bits = np.zeros(64 * neardup.MARK_LONGS, np.uint8)
        bits[neardup.unpacked(blob)[0] % len(bits)] = 1
        return np.packbits(bits).view(np.int64).tolist()

    idf = np.ones(1 << neardup.DF_BITS, np.float32)
    texts = neardup.pa.RecordBatch.from_pydict({"node": list(range(60)), "text": [t for _, t in table]})
    blobs = [b for part in neardup.set_rows(iter([texts]), idf) for b in part.column("shingles").to_pylist()]
    sets = spark.createDataFrame([(i, marks(b)) for i, b in enumerate(blobs)], "node long, marks array<long>")
    other = sets.toDF("v", "other")
    found = sets.join(other, neardup.F.expr("node < v")).select("node", "v", absent("marks", "other").alias("n"))
    for r in found.collect():
        one, two = blobs[r.node], blobs[r.v]
        total = neardup.unpacked(one)[1].sum() + neardup.unpacked(two)[1].sum()
        most = neardup.unpacked(one)[1].sum() - r.n
        assert neardup.similarity(one, two) <= most / (total - most) + 1e-9


def test_weighted_jaccard():
    one = np.array([1, 5, 9], "<u4").tobytes() + bytes([0, 4, 8])
    two = np.array([5, 9, 11], "<u4").tobytes() + bytes([4, 0, 0])
    w = lambda *x: np.exp(np.array(x) / neardup.GRID)
    low, high = w(4).sum() + w(0).sum(), w(0).sum() + w(4).sum() + w(8).sum() + w(0).sum()
    assert neardup.similarity(one, two) == pytest.approx(low / high)


def test_decontamination(spark):
    rng = random.Random(4)
    item = words(rng, 30)
    edited = item[:60] + "x" + item[61:]
    extra = [(500, words(rng, 30) + " " + edited.upper() + " " + words(rng, 30)), (501, words(rng, 60))]
    docs = spark.createDataFrame(rows([(*e, "en", "s", 1, 1, "x") for e in extra]), SCHEMA)
    items = spark.createDataFrame([(1, item), (2, None), (3, "short")], "item_id long, text string")
    found = decontam.with_hits(docs.select("doc_id", "text"), items)
    assert {r.doc_id for r in found.where("size(hits) > 0").collect()} == {500}
    assert decontam.with_hits(docs.select("doc_id", "text"), items.limit(0)).where("size(hits) > 0").isEmpty()


def test_decontamination_by_short_nameless_and_partly_held_items(spark):
    rng = random.Random(14)
    item, nameless = words(rng, 60), words(rng, 30)
    table = [(i, words(rng, 20) + " " + item[p : p + 87] + " " + words(rng, 20)) for i, p in enumerate(range(0, 200, 7))]
    table += [(100, words(rng, 9) + " " + nameless), (101, "Zip, the Zap! went " + words(rng, 5)), (102, "unzip the zap"), (103, "zip the zapper")]
    table += [(104, "so: YES"), (105, "yesterday"), (106, "the capital of france is paris " + words(rng, 3)), (107, None), (108, "zip the zap")]
    items = [(1, item), (None, nameless), (2, "zip the zap"), (3, "Yes."), (4, "The capital of France is  Pariis"), (5, "?!"), (6, None)]
    docs = spark.createDataFrame(table, "doc_id long, text string").coalesce(1)
    found = decontam.with_hits(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    got = {r.doc_id: {h.item_id for h in r.hits} for r in found}
    want = {i: {1} for i in range(29)} | {100: {None}, 101: {2}, 104: {3}, 106: {4}, 108: {2}}
    assert {k: v for k, v in got.items() if v} == want


def test_packing_round_trip(odd):
    got = packing.packed(odd.select("doc_id", "text")).collect()
    spans = {}
    for r in got:
        assert 0 < r.length <= packing.CAPACITY and r.start == r.piece * packing.CAPACITY
        spans.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in spans.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    assert sum(r.piece == 0 for r in got) == odd.count()


def test_packing_evolves_where_the_first_fit_meets_the_bound(monkeypatch):
    """All generations run, and what they find is no longer that of the first population."""
    crossings = []
    cross = packing.crossed
    monkeypatch.setattr(packing, "crossed", lambda *args: crossings.append(1) or cross(*args))
    better = 0
    for n in range(12):
        rng = random.Random(n)
        sizes = [min(4095, max(1, int(rng.lognormvariate(5.6, 1.2)))) for _ in range(400)]
        assert len(packing.best_fit(sizes, [], list(range(400)))) == -(-sum(sizes) // packing.CAPACITY)
        crossings.clear()
        last = packing.evolved(sizes, [], n)
        assert len(crossings) == packing.GENERATIONS
        with monkeypatch.context() as still:
            still.setattr(packing, "GENERATIONS", 0)
            first = packing.evolved(sizes, [], n)
        assert sorted(i for b in last[0] for i in b) == list(range(400))
        assert max(sum(sizes[i] for i in b) for b in last[0]) <= packing.CAPACITY
        assert len(last[0]) == len(first[0])
        assert packing.fitness(sizes, last[0]) >= packing.fitness(sizes, first[0])
        better += packing.fitness(sizes, last[0]) > packing.fitness(sizes, first[0])
    assert better


def test_packing_keeps_the_fewest_sequences(monkeypatch):
    """An uneven packing of more bins never goes before one of fewer."""
    sizes = [2048, 2048, 2048, 2049, 1]
    few, many = [[0, 1], [2], [3, 4]], [[0, 1], [3], [2], [4]]
    monkeypatch.setattr(packing, "fitness", lambda sizes, bins: float(len(bins)))
    assert len(packing.evolved(sizes, [many, few, many, many], 0)[0]) == 3


def test_words_have_the_ids_of_the_tokenizer():
    own = packing.Words(packing.tokenizer_path(packing.TOKENIZER))
    rng = random.Random(1)
    texts = ["", "it's we'll 'ss", "a\x1cb", "<|endoftext|> x", "İ ǅ ª é", "Straße, déjà. 12"]
    texts += ["".join(rng.choice("aÉ's.,! \n\tİ9中") for _ in range(40)) for _ in range(300)]
    for text in texts:
        want = [*own.whole.encode(text, add_special_tokens=False).ids, 1]
        assert np.frombuffer(own.ids(text), "<u4").tolist() == want


def test_pages():
    page = (
        "<html><head><title>T</title><style>p{}</style></head><body><nav><a href=/>Menu</a></nav>"
        "<div class='cookie-notice'>We use cookies</div><article><h1>The head</h1><p>First &amp; the best"
        " part<br>of it.<p>Second   part.</p><script>x<y</script></article>"
        "<section class=comments><p>me too</p></section><footer>&copy; x</footer></body></html>"
    )
    assert pages.main_text(page) == "The head\nFirst & the best part of it.\nSecond part."
    assert pages.main_text(None) == pages.main_text("") == ""
    assert pages.main_text("<p>cut <!-- never closed") == pages.main_text("<p>cut")


def test_urls(spark):
    given = ["HTTP://Example.com/en/x?q", "https://www.example.com/en/", "http://a.net/fr/1", None, "no", "x://net/es/"]
    docs = spark.createDataFrame(list(enumerate(given)), "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(docs, [urls.Rule(*r) for r in urls.CHECKED]).collect()}
    assert got[0] == ("example.com", "/en/x", "example.com/en/", "block")
    assert got[1][2:] == ("www.example.com/en/", "allow")
    assert got[2] == ("a.net", "/fr/1", "net/fr/", "block")
    assert got[3] == got[4] == ("", "", None, "allow")
    assert got[5] == ("net", "/es/", "net/es/", "block")


def brute_counts(text):
    parts = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", text or "")]
    windows = [tuple(parts[i : i + 5]) for i in range(len(parts) - 4)]
    twice = {w for w in windows if windows.count(w) > 1} if len(windows) < 2000 else set()
    hit = {i + k for i, w in enumerate(windows) if w in twice for k in range(5)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if line.strip(" \t\n\v\f\r"):
            dup += line in seen
            seen.add(line)
    return len(parts), sum(map(len, parts)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(hit)


def test_quality(spark, odd, empty):
    extra = [(700, "a b c d e a b c d e x"), (701, "x y\nx y\n\n\n #é|"), (702, "one two ")]
    docs = odd.union(spark.createDataFrame([(*e, "en", "s", 1, 1, "x") for e in extra], SCHEMA))
    labels = spark.createDataFrame([(0, 1, 0), (1, 0, 1), (None, None, None)], "doc_id long, quality int, toxic int")
    texts = {r.doc_id: r.text for r in docs.where("doc_id is not null").collect()}
    for r in quality.quality(docs, labels).where("doc_id is not null and doc_id <> 60").collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_counts(texts[r.doc_id])
    assert quality.quality(empty, labels).count() == 0


def test_language_and_toxicity_on_held_out_rows(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = language.op8_language_id(spark, folder).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    share = got.selectExpr("avg(cast(lang = lang_pred as int))").first()[0]
    assert share > 0.95
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    found = toxicity.op1_toxicity(spark, folder).join(labels, "doc_id").where("held_out").toPandas()
    rank = found["score"].rank()
    ones = found["toxic"] == 1
    auc = (rank[ones].sum() - ones.sum() * (ones.sum() + 1) / 2) / (ones.sum() * (~ones).sum())
    assert auc > 0.85


def test_languages_of_short_long_and_repeated_texts(spark):
    """Every language is learnt: of messages only, of books only, beside a hot text, with its own letters."""
    rng = random.Random(13)

    def text(letters, n):
        return " ".join("".join(rng.choice(letters) for _ in range(4)) for _ in range(n))

    kinds = {"aa": ("abcdefgh", 60), "bb": ("ijklmnop", 4), "cc": ("qrstuvwx", 3000)}
    kinds["dd"] = ("".join(chr(0x4E00 + i) for i in range(120)), 60)
    kinds["ee"] = ("".join(chr(0x5E00 + i) for i in range(120)), 60)
    table = [(text(*how), lang) for lang, how in kinds.items() for _ in range(30)]
    table += [("abcd " * 60, "aa")] * 5000
    docs = spark.createDataFrame(table, "text string, lang string").repartition(4)
    sample = language.training_sample(docs, language.F.lit(True))
    assert sorted(sample) == sorted(kinds)
    assert all(len(v) <= language.SAMPLE_CHARS + language.SAMPLE_ROWS for v in sample.values())
    assert sample["aa"].count("abcd " * 10) <= 6 and len(sample["bb"]) > 30 * 18
    new = [(text(how[0], 20), lang) for lang, how in kinds.items() for _ in range(10)]
    found = language.identify(spark.createDataFrame(new, "text string, lang string"), sample, ["text", "lang"])
    assert all(r.lang_pred == r.lang for r in found.collect())


def test_odd_rows_and_nothing(spark, odd, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.toxicity(odd, labels).count() == odd.count()
    named = language.identify(odd, {}, odd.columns)
    assert {r.lang_pred for r in named.collect()} == {"und"}
    for stage in (language.language_stage, lines.line_stage, neardup.neardup_stage):
        out = stage(spark, empty, "")
        assert out.columns == empty.columns and out.count() == 0
    assert packing.packed(empty.select("doc_id", "text")).count() == 0


def test_crowded_windows_leave_a_block_once():
    """op7_suffix_dedup: copies in a block are settled there, so the join sees distinct windows only."""
    text = np.random.default_rng(3).integers(97, 123, 400).astype(np.uint8).tobytes()
    sizes = np.full(6, len(text), np.int64)
    row = {
        "ids": np.array([5, 3, 9, 4, 3, 8], np.int64).tobytes(), "sizes": sizes.tobytes(),
        "data": substrings.squeezed(text * 6),
    }
    found = substrings.Anchors(row, 1, np.array([0]), 1)
    own = np.arange(len(found.shard))[dict(found.by_shard())[1]]
    repeats, windows = substrings.windows_of(found, own)
    assert len({(w["h"], w["g"]) for w in windows}) == len(text) - substrings.LENGTH + 1
    # those of the two rows of the smallest doc_id, which do not remove from each other
    assert {w["doc"] for w in windows} == {3} and len(windows) <= 2 * (len(text) - substrings.LENGTH + 1)
    spans = [tuple(x) for x in repeats] + list(zip(*(x.tolist() for x in found.covered), strict=True))
    touched = np.zeros(6 * len(text), bool)
    for low, high in spans:
        touched[low:high] = True
    assert touched.reshape(6, -1).all(axis=1).tolist() == [True, False, True, True, False, True]


def test_a_window_is_sent_once_and_its_verdict_covers_all_its_places():
    """op7_suffix_dedup: no row per window and place leaves a block, nor is one joined."""
    text = b"ab" * 150
    row = {
        "ids": np.array([7], np.int64).tobytes(), "sizes": np.array([len(text)], np.int64).tobytes(),
        "data": substrings.squeezed(text), "block": 1,
    }
    found = substrings.Anchors(row, 1, np.array([0]), 1)
    _, windows = substrings.windows_of(found, np.arange(len(found.shard)))
    parts = list(substrings.dealt(windows, 1))
    assert [(p, len(sent) // 24) for p, sent, _ in parts] == [(0, 2)]
    _, sent, kept = parts[0]
    earlier = bytes(sent[:32]) + np.array([3, 9], np.int64).tobytes()
    replies = substrings.settled_windows((0,), pd.DataFrame({"block": [2, 1], "bytes": [earlier, sent]}))
    assert sorted(replies["block"]) == [1, 2]
    hit = dict(zip(replies["block"], replies["spans"], strict=True))
    assert np.frombuffer(hit[1], "<u4").tolist() == [0] and np.frombuffer(hit[2], "<u4").tolist() == [1]
    assert substrings.window_spans(kept, hit[1])[-1].tolist()[1] - substrings.window_spans(kept, hit[1])[0, 0] >= 298


def test_contexts_without_a_common_core_stay():
    """op7_suffix_dedup: an anchor alone in common sends nothing to the suffix arrays."""
    rng = np.random.default_rng(5)
    middle, texts = b"the same twenty byte", []
    for _ in range(40):
        sides = rng.integers(97, 123, 90).astype(np.uint8).tobytes()
        texts.append(sides[:45] + middle + sides[45:])
    texts.append(texts[0][:30] + b"#" * 5 + texts[0][35:])
    blocks = []
    for at, text in enumerate(texts):
        blocks.append({
            "block": at, "ids": np.array([at], np.int64).tobytes(), "data": substrings.squeezed(text),
            "sizes": np.array([len(text)], np.int64).tobytes(),
        })
    sent = pa.Table.from_batches(list(substrings.entries(iter([pa.RecordBatch.from_pylist(blocks)]), 1)))
    replies = substrings.matched((0,), sent.to_pandas())
    shipped = set(replies.loc[replies["n_shipped"] > 0, "block"])
    assert shipped == {0, len(texts) - 1}
