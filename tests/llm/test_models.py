"""Learned operators: held-out accuracy, the grammar, and defined results."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chartloom.llm import compresslid, nndescent, toxicity

LETTERS = {lang: ["".join(random.Random(f"{lang}{i}").choices("abcdefghilmnoprstuäé", k=6)) for i in range(150)] for lang in ("aa", "bb", "cc")}


def sentence(rng, language, n):
    return " ".join(rng.choices(LETTERS[language], k=n))


def test_language_held_out(spark):
    rng = random.Random(3)
    rows = [(i, sentence(rng, lang, rng.randint(8, 60)), lang) for i, lang in enumerate(rng.choices(list(LETTERS), k=300))]
    rows += [(900, None, "aa"), (901, "", "aa"), (902, "12 34 !", None), (903, "ab" * 30000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    samples = compresslid.learn_dictionaries(df, F.col("doc_id") % 3 != 0, "lang")
    assert set(samples) == set(LETTERS) and all(len(v) <= compresslid.DICTIONARY_BYTES for v in samples.values())
    got = {r.rest.doc_id: r for r in compresslid.classify(df, samples).collect()}
    held = [r for r in rows[:300] if r[0] % 3 == 0]
    assert np.mean([got[i].lang_pred == lang for i, _, lang in held]) > 0.97
    for i in (900, 901, 902):
        assert (got[i].lang_pred, got[i].score, got[i].rejected) == ("und", 0.0, True)
    assert got[903].lang_pred in LETTERS and 0 <= got[903].score <= 1


def test_language_without_labels(spark):
    df = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    assert compresslid.learn_dictionaries(df, F.lit(True), "lang") == {}
    row = compresslid.classify(df, {}).first()
    assert (row.lang_pred, row.rejected) == ("und", True)
    assert compresslid.classify(df.limit(0), {"a": b"abc"}).count() == 0


def test_narrow_margins_are_rejected():
    same = compresslid.Languages({"a": b"some words here", "b": b"some words here"})
    label, score, rejected = same.judge("some words here and there")
    assert (label, score, rejected) == ("a", 0.0, True)


def total(text):
    return toxicity.features(text, toxicity.Lexicon({}))[0]


def test_grammar_reads_the_clause():
    plain = total("what an idiot")
    assert plain > 0 and total("what a day") == 0
    assert total("you are an idiot") > plain and total("idiot that you are") > plain
    assert total("he is not an idiot") < plain
    assert total("the note says idiot") < plain and total('then "what an idiot" was heard') < plain
    assert total("not now. what an idiot") == pytest.approx(plain)
    assert total("not a b c d idiot") == pytest.approx(plain)
    assert total(None) == total("") == 0


def test_composition_multiplies():
    grammar = toxicity.GRAMMAR
    assert grammar.states == 32
    state = 0
    for kind in (toxicity.TARGET, toxicity.NEGATION, toxicity.REPORT):
        state = grammar.next[state][kind]
    assert grammar.factor[state] == pytest.approx(1.5 * 0.1 * 0.5)


def test_toxicity_held_out(spark):
    rng = random.Random(5)
    words = [f"wort{c}{d}" for c in "abcdefghij" for d in "klmnopqrst"]
    rows, labels = [], []
    for i in range(600):
        text, toxic = rng.choices(words, k=rng.randint(5, 60)), rng.random() < 0.3
        for _ in range(rng.randint(1, 4) if toxic else 0):
            text.insert(rng.randrange(len(text)), rng.choice(["grolk", "blunzhead", "blunzface", "idiot"]))
        rows.append((i, " ".join(text).capitalize() + "."))
        labels.append((i, int(toxic)))
    rows += [(900, None), (901, ""), (902, "clean " * 5000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame(labels + [(1, None), (None, 1), (7777, 1)], "doc_id long, toxic int")
    model = toxicity.learn(df, known, F.col("doc_id") % 3 != 0)
    assert "grolk" in model.terms and "blun*" in model.terms
    got = {r.rest.doc_id: r for r in toxicity.score_texts(df, model).collect()}
    held = [(i, y) for i, y in labels if i % 3 == 0]
    assert np.mean([got[i].predicted == y for i, y in held]) > 0.97
    assert all(got[i].predicted == 0 and got[i].score == got[900].score for i in (900, 901, 902))
    assert toxicity.score_texts(df.limit(0), model).count() == 0


def test_toxicity_without_labels(spark):
    df = spark.createDataFrame([(1, "you idiot, you worthless idiot")], "doc_id long, text string")
    model = toxicity.learn(df, spark.createDataFrame([], "doc_id long, toxic int"), F.lit(True))
    assert model.weights == toxicity.PRIOR and toxicity.score_texts(df, model).first().predicted == 1


# --- neighbours ---------------------------------------------------------------------------------------

def exact(ids, vectors, queries, k):
    out = {}
    for q in queries:
        scores = vectors @ vectors[ids.index(q)]
        out[q] = sorted(((i, s) for i, s in zip(ids, scores) if i != q), key=lambda x: (-round(x[1], 9), x[0]))[:k]
    return out


def test_recall_and_scores(spark):
    rng = np.random.default_rng(2)
    vectors = (rng.standard_normal((12, 16))[rng.integers(0, 12, 900)] + 0.6 * rng.standard_normal((900, 16))).astype(np.float32)
    vectors[100:400] = vectors[100]                                           # one very common vector
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in nndescent.nearest(df, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    want = exact(list(range(900)), vectors.astype(float), range(0, 900, 20), 20)
    hits = 0
    for q, near in want.items():
        mine = sorted(got[q])
        assert [x[0] for x in mine] == list(range(1, 21))
        hits += len({x[1] for x in mine} & {i for i, _ in near})
        for _, i, s in mine:
            assert s == pytest.approx(float(vectors[q].astype(float) @ vectors[i].astype(float)), abs=1e-12)
        assert mine == sorted(mine, key=lambda x: (-x[2], x[1]))
    assert hits / (20 * len(want)) >= 0.9
    # ties go to the smallest ids
    assert {x[1] for x in got[200]} <= set(range(100, 121)) | {200} or len({x[2] for x in got[200]}) > 1


def test_recall_with_cells_of_few_per_cent(spark, monkeypatch):
    """The descent and the search carry what the starting cells do not: they hold about 1 % of the nodes."""
    monkeypatch.setattr(nndescent, "CELL", 24)
    monkeypatch.setattr(nndescent, "ROUNDS", 2)
    n = 4000
    vectors = np.random.default_rng(5).standard_normal((n, 32)).astype(np.float32)
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    got = {}
    for r in nndescent.nearest(df, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    want = exact(list(range(n)), vectors.astype(float), range(0, n, 20), 20)
    assert sum(len(got[q] & {i for i, _ in near}) for q, near in want.items()) / (20 * len(want)) >= 0.995


def test_rows_that_take_no_part(spark):
    rows = [(0, [1.0, 0.0]), (20, [0.5, 0.5]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [1.0, None]), (7, [float("nan"), 1.0]),
            (8, [float("inf"), 1.0]), (9, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (20, [0.5, 0.5]), (40, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in nndescent.nearest(df, F.col("vec_id") % 20 == 0).collect()]
    assert sorted(got) == [(0, 1, 20, 0.5), (20, 1, 0, 0.5)]
    assert nndescent.nearest(df.limit(0), F.lit(True)).count() == 0
    # columns named like the operator's own are not read
    more = df.select("*", *[F.lit(7).alias(c) for c in ("node", "nb", "score", "q", "code", "near", "floor", "a.b")])
    assert sorted(tuple(r) for r in nndescent.nearest(more, F.col("vec_id") % 20 == 0).collect()) == sorted(got)


def test_local_join_like_brute_force(spark):
    """Pairs with a fresh member, the best of each member above its floor, whatever the sizes of the groups."""
    rng = np.random.default_rng(8)
    x = rng.standard_normal((60, 8))
    codes = nndescent.encode(x)
    groups, want = [], set()
    for size in (1, 2, 7, 30):
        ids = [int(i) for i in rng.choice(60, size, replace=False)]
        fresh, floor = [bool(v) for v in rng.random(size) < 0.4], [float(v) for v in rng.normal(0, 1, size)]
        groups.append(([(i, bytearray(codes[i]), f, b) for i, f, b in zip(ids, floor, fresh)],))
        scale, whole = nndescent.decode(pa.array([codes[i] for i in ids], pa.binary()))
        for a in range(size):
            others = [((float(whole[a] @ whole[b])) * (scale[a] * scale[b]), ids[b]) for b in range(size) if b != a and (fresh[a] or fresh[b])]
            want |= {(ids[a], nb, s) for s, nb in sorted(others, reverse=True)[:3] if s > floor[a]}
    df = spark.createDataFrame(groups, "them array<struct<node:long,code:binary,floor:double,fresh:boolean>>").coalesce(1)
    got = {tuple(r) for r in nndescent.local_join(df, 3, 3).collect()}
    assert got == want
