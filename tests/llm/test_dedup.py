"""Exact, near and substring duplicates against plain Python."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from chartloom.llm import anchors, components, cuckoo, hyperminhash

SCHEMA = "doc_id long, text string"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(200)]
    passage = " ".join(rng.choices(words, k=50))
    rows = []
    for i in range(n):
        text = rng.choices(words, k=rng.randint(0, 90))
        if i % 5 == 0:
            text = text[:20] + passage.split() + text[20:]
        rows.append((i, rng.choice([" ", "\n", "  "]).join(text)))
    base = rng.choices(words, k=120)
    for i in range(30):                                   # a family of near copies
        copy = list(base)
        for _ in range(i % 7):
            copy[rng.randrange(120)] = f"x{rng.random()}"
        rows.append((1000 + i, " ".join(copy).upper() if i % 2 else " ".join(copy)))
    rows += [(2000, None), (2001, ""), (2002, " \n "), (2003, "one two"), (2004, "one  two"), (2005, "One Two"), (2006, "one"),
             (2007, "again " * 400), (2008, "é à ü\x0bß é à ü"), (2009, "é à ü ß é à ü")]
    return rows


# --- exact -----------------------------------------------------------------------------------------

def norm(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def test_exact_like_brute_force(spark):
    rows = corpus() + [(5000 + i, "the same text") for i in range(40)] + [(7000, None)]
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append(i)
    got = cuckoo.exact_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    texts = dict(rows)
    for r in got:
        ids = groups[norm(texts[r.doc_id])]
        assert (r.keep_id, r.group_size, r.kept) == (min(ids), len(ids), r.doc_id == min(ids))
        assert r.text_sha256 == hashlib.sha256(norm(texts[r.doc_id]).encode()).hexdigest()


def test_exact_null_ids_repeats_and_no_rows(spark):
    df = spark.createDataFrame([(None, "a"), (1, "a"), (1, "a"), (None, "b")], SCHEMA)
    got = Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in cuckoo.exact_duplicates(df).collect())
    assert got == Counter([(None, 1, 3, False), (1, 1, 3, True), (1, 1, 3, True), (None, None, 1, True)])
    assert cuckoo.exact_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_filter_inserts_deletes_and_overflows():
    keys = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(3000)]
    made = cuckoo.CuckooFilter.sized(3000)
    assert all(made.insert(k) for k in keys) and all(k in made for k in keys)
    for k in keys[:1500]:
        assert made.delete(k)
    assert made.n == 1500 and all(k in made for k in keys[1500:])
    assert sum(k in made for k in keys[:1500]) < 30
    small = cuckoo.CuckooFilter(3)
    assert not all(small.insert(k) for k in keys[:100])


def test_index_grows_verifies_and_forgets(spark):
    rows = spark.range(400).select(F.sha2(F.pmod("id", F.lit(300)).cast("string"), 256).alias("digest"), F.col("id"))
    index = cuckoo.CuckooIndex.empty(spark, "bigint", 10)
    index = index.insert(rows.where("id < 20"))
    small = index.filters.agg(F.sum("n"), F.max("log2")).first()
    index = index.insert(rows.where("id >= 20"))                         # far more than the filters were made for
    grown = index.filters.agg(F.sum("n"), F.max("log2")).first()
    assert (small[0], grown[0]) == (20, 300) and grown[1] > small[1]
    probed = index.probe(index._dealt(rows).select("shard", "digest").distinct())
    assert probed.where("hit").count() == 300
    index = index.delete(rows.where("id < 150"))
    live = {r.digest: (r.keep_id, r.group_size) for r in index.groups().collect()}
    # ids 300-399 repeat the digests of 0-99
    assert len(live) == 250 and index.filters.agg(F.sum("n")).first()[0] == 250
    assert sorted(v for v in live.values())[0] == (150, 1)
    assert index.stored.count() == 250


def test_what_the_filter_says_decides(spark, monkeypatch):
    """A miss opens an entry unseen: with a filter that knows nothing, a digest of two batches has two."""
    rows = spark.createDataFrame([("a" * 64, 1), ("a" * 64, 5), ("b" * 64, 2)], "digest string, id long")

    def entries():
        index = cuckoo.CuckooIndex.empty(spark, "bigint", 10)
        index = index.insert(rows.where("id < 3")).insert(rows.where("id >= 3"))
        return sorted((r.digest[0], r.keep_id, r.group_size) for r in index.groups().collect())

    assert entries() == [("a", 1, 2), ("b", 2, 1)]

    def blind(index, keys):
        return keys.select("shard", "digest", F.lit(False).alias("hit"))
    monkeypatch.setattr(cuckoo.CuckooIndex, "probe", blind)
    assert entries() == [("a", 1, 1), ("a", 5, 1), ("b", 2, 1)]

    def suspicious(index, keys):
        return keys.select("shard", "digest", F.lit(True).alias("hit"))
    monkeypatch.setattr(cuckoo.CuckooIndex, "probe", suspicious)
    assert entries() == [("a", 1, 2), ("b", 2, 1)]                       # false hits are found out


def test_exact_long_texts_and_clashing_names(spark):
    long = "word  " * 200_000
    schema = "doc_id long, text string, id long, digest string, shard int, hit boolean, keep_id long, group_size long, content string"
    rows = [(i, t, 9, "x", 1, True, 0, 7, "c") for i, t in [(3, long), (1, long.replace("  ", "\n")), (2, long + "x")]]
    got = cuckoo.exact_duplicates(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got) == [(1, 1, 2, True), (2, 2, 1, True), (3, 1, 2, False)]


# --- near --------------------------------------------------------------------------------------------

def shingles(text):
    w = WORDS.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(rows):
    sets, root = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, x in sets.items():
        for b, y in sets.items():
            if a < b and x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {i: (len(sets[i]), find(i)) for i in root}


@pytest.mark.parametrize("block", [3, 256])
def test_near_like_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(hyperminhash, "BLOCK", block)
    monkeypatch.setattr(hyperminhash, "PIVOT_ROUNDS", 1)
    rows = corpus() + [(9000 + i, "a copy of many words in a row") for i in range(25)]
    want = brute_components(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in
           hyperminhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {i: (n, c, c == i) for i, (n, c) in want.items()}


def test_near_null_ids_and_no_rows(spark):
    df = spark.createDataFrame([(None, "a b c"), (4, "A b  c"), (None, "z")], SCHEMA)
    got = Counter((r.doc_id, r.component_id, r.kept) for r in hyperminhash.near_duplicates(df).collect())
    assert got == Counter([(None, 4, False), (4, 4, True), (None, None, True)])
    assert hyperminhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_estimate_is_near_the_truth():
    rng = np.random.default_rng(3)
    for n, shared in ((40, 36), (400, 300), (4000, 3900)):
        pool = np.unique(rng.integers(0, 2**64, 2 * n - shared, dtype=np.uint64))
        a, b = np.sort(pool[:n]), np.sort(pool[len(pool) - n:])
        both = len(np.intersect1d(a, b))
        true = both / (2 * n - both)
        ra, rb = hyperminhash.registers(a)[None], hyperminhash.registers(b)[None]
        size = np.array([float(n)])
        assert hyperminhash.likely(ra, rb, size, size, round(100 * true) - 3)[0]
        assert not hyperminhash.likely(ra, rb, size, size, min(100, round(100 * true) + 30))[0] or true > 0.75


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- passages ----------------------------------------------------------------------------------------

def brute_repeats(rows, window):
    words = [WORDS.findall(t or "") for _, t in rows]
    seen = Counter(tuple(w[k:k + window]) for w in words for k in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k:k + window])] > 1:
                gone[k:k + window] = [True] * window
        out.append((len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return out


@pytest.mark.parametrize("chunk_bytes,window", [(400, 35), (1 << 20, 35), (2000, 4)])
def test_repeats_like_brute_force(spark, chunk_bytes, window):
    rows = corpus(2) + [(3000, "a b " * 60), (3001, None)]
    want = Counter((i, *w) for (i, _), w in zip(rows, brute_repeats(rows, window)))
    got = anchors.remove_repeats(spark.createDataFrame(rows, SCHEMA), window=window, chunk_bytes=chunk_bytes, per_shard=100).collect()
    assert Counter((r.rest.doc_id, r.n_words, r.n_removed, r.kept) for r in got) == want
    for r in got:
        assert sum(s.end - s.start for s in r.spans) == r.n_removed


def test_repeats_no_rows_and_clashing_names(spark):
    df = spark.createDataFrame([("k", "a b", 3)], "kept string, text string, n_words int")
    row = anchors.remove_repeats(df).first()
    assert (row.rest.kept, row.rest.n_words, row.n_words, row.kept) == ("k", 3, 2, "a b")
    assert anchors.remove_repeats(df.limit(0)).count() == 0
    only = anchors.remove_repeats(df.select("text")).first()
    assert (only.text, only.n_removed) == ("a b", 0)
