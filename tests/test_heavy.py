"""The n-gram summary and the presence blocks against plain counting."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from chartloom.operators import features, heavy


def grams(text):
    w = (text or "").lower().split()
    return {" ".join(w[i:i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)}


def corpus(order, n=1200, seed=1):
    """Every eighth document has a phrase, every eleventh another one; the rest is noise, the orders are adversarial."""
    rng = random.Random(seed)
    docs = []
    for i in range(n):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([0, 3, 30, 60]))]
        words += ["just", "over", "it"] * (i % 8 == 0) + ["just", "under"] * (i % 11 == 0) + ["always"] + ["tenth"] * (i % 10 == 0)
        docs.append(" ".join(words))
    docs[5] = " ".join(f"long{i % 700}" for i in range(3000))
    if order == "first":
        docs.sort(key=lambda d: "over" not in d)                   # all of them in the first tasks
    elif order == "last":
        docs.sort(key=lambda d: ("over" in d, "under" in d))
    elif order == "shuffled":
        rng.shuffle(docs)
    return docs


def counted(docs):
    out = Counter()
    for d in docs:
        out.update(grams(d))
    return out


def arrays(docs):
    return pa.array([(d or "").lower().split() for d in docs], pa.list_(pa.string()))


@pytest.mark.parametrize("order", ["spread", "first", "last", "shuffled"])
@pytest.mark.parametrize("table", [200_000, 50])
def test_merged_tables_miss_no_frequent_term(monkeypatch, order, table):
    monkeypatch.setattr(heavy, "RUN_WORDS", 2_000)
    docs = corpus(order)
    tasks = [docs[:700], docs[700:705], docs[705:], []]             # of very different sizes
    merged, error = Counter(), 0
    for task in tasks:
        held = heavy.Counts(3, table)
        for start, stop, document, names, words in heavy._runs(arrays(task)):
            held.add(stop - start, document, names, words)
        assert held.documents == len(task) and held.error <= len(task) / 20
        true = counted(task)
        assert all(true[t] - held.error <= held.counts.get(t, 0) <= true[t] for t in true)
        merged.update(held.counts)
        error += held.error
    true = counted(docs)
    frequent = {t for t, n in true.items() if n * 10 > len(docs)}
    possible = {t for t, n in merged.items() if (n + error) * 10 > len(docs)}
    assert frequent <= possible and "just over it" in frequent and "tenth" not in frequent
    assert len(possible) <= heavy.KEEP * sum(true.values()) / len(docs)


@pytest.mark.parametrize("order", ["spread", "last"])
def test_vocabulary_is_exact(spark, monkeypatch, order):
    docs = corpus(order) + [None, ""]
    df = spark.createDataFrame(list(enumerate(docs)), "i int, t string").repartition(5, "i")
    true = counted(docs)
    want = sorted((t for t, n in true.items() if n * 10 > len(docs)), key=lambda t: (len(t.split()), t))
    assert heavy.candidates(df, "t").exact is None                  # so that the second pass decides
    assert heavy.frequent_ngrams(df, "t", table=50) == want == features.fit_ngram_vocabulary(df, "t")
    few = df.where("i < 30")
    assert heavy.candidates(few, "t").exact is not None             # tasks too small for an error
    true = counted(docs[:30])
    assert set(heavy.frequent_ngrams(few, "t")) == {t for t, n in true.items() if n * 10 > 30}


def test_presence_blocks(spark):
    docs = corpus("spread", 300) + [None, "", "JUST over"]
    df = spark.createDataFrame([(i, f"k{i % 7}", t) for i, t in enumerate(docs)], "i int, k string, t string").repartition(3)
    terms = ["just", "just over", "over it just", "w17", "not there", "just over it", "tenth always"]
    found = heavy.presence(df, ["k", "i"], "t", terms)
    rows = {(r.k, r.i): r.terms for r in found.rows().collect()}
    assert rows == {(f"k{i % 7}", i): [n for n, t in enumerate(terms) if t in grams(d)] for i, d in enumerate(docs)}
    true = counted(docs)
    assert {terms[r.number]: r.df for r in found.frequency().collect()} == {t: true[t] for t in terms if true[t]}
    assert {(r.i, r.term) for r in found.matrix().collect()} == {(i, t) for i, d in enumerate(docs) for t in terms if t in grams(d)}
    plan = found.matrix()._jdf.queryExecution().optimizedPlan().toString()
    assert "just over it" not in plan.split("LocalRelation")[0]
    assert heavy.presence(df, ["i"], "t", []).matrix().collect() == []


def test_codes_of_very_many_words_do_not_overflow():
    words = np.arange(9, dtype=np.int64) + 3_000_000_000
    document = np.zeros(9, dtype=np.int64)
    _, code, place = heavy._grams(np.append(document, 1), np.append(words, words[0]), 3_000_000_020, 3)
    assert len(set(code.tolist())) == 7 and place.tolist() == list(range(7))


def test_no_documents(spark):
    none = spark.createDataFrame([], "i int, t string")
    assert heavy.frequent_ngrams(none, "t") == [] and features.presence(none, ["i"], "t", ["a"]).collect() == []


def test_texts_are_made_words_once(spark, monkeypatch):
    docs = corpus("spread", 400)
    df = spark.createDataFrame(list(enumerate(docs)), "i int, t string").coalesce(2)
    made, tokens = [], heavy._tokens
    monkeypatch.setattr(heavy, "_tokens", lambda *x: made.append(x) or tokens(*x))
    true = counted(docs)
    want = sorted((t for t, n in true.items() if n * 10 > len(docs)), key=lambda t: (len(t.split()), t))
    assert heavy.candidates(df, "t").exact is None
    made.clear()
    assert heavy.frequent_ngrams(df, "t") == want
    assert len(made) == 1


@pytest.mark.parametrize("base", [50, 2**31])
def test_both_ways_of_counting_a_run(base):
    """A code that can be read back, and one that can not; a word numbered -1 is in no n-gram."""
    rng = np.random.default_rng(3)
    document, words = np.sort(rng.integers(0, 30, 900)), rng.integers(-1, 6, 900)
    for n in (1, 2, 3):
        true = Counter()
        for d in range(30):
            own = words[document == d].tolist()
            true.update({tuple(own[i:i + n]) for i in range(len(own) - n + 1) if min(own[i:i + n]) >= 0})
        lines, count = heavy._in_more(document, words, base, n, 30, 4)
        assert dict(zip(map(tuple, lines.tolist()), count.tolist())) == {g: c for g, c in true.items() if c > 4}
