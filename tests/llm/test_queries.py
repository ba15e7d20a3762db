"""The registered queries over the smallest tables, and the pipeline against plain Python."""

import os
import random
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from chartloom.llm.queries import ORACLES, QUERIES
from oracle import compare, connect
from test_dedup import brute_components, brute_repeats, norm

SF = "/root/testdata/sf0.001"
here = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


@here
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_like_sql(spark, name):
    compare(spark, SF, QUERIES[name], ORACLES[name], connect(SF))


@here
def test_whole_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").count()
    for name in sorted(set(QUERIES) - set(ORACLES) - {"op4_nn_descent", "op9_vector_packing"}):
        rows = QUERIES[name](spark, SF).collect()
        assert len(rows) == docs == len({r.doc_id for r in rows})
        for r in rows:
            if "held_out" in r:
                parts = {"op2_toxicity": (3, 1), "op3_katz": (5, 1), "op7_language_id": (4, 2)}[name]
                assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % parts[0] == parts[1])


def test_entry_has_all(spark):
    import __spark_entry__ as entry
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())


def test_repeated_rows_leave_one(spark, tmp_path):
    rng = random.Random(9)
    words = [f"word{chr(97 + i)}{chr(97 + j)}" for i in range(20) for j in range(10)]
    one, two, three, four, five = (" ".join(rng.choices(words, k=60)) for _ in range(5))
    rows = [(1, one), (1, one), (None, two), (None, two), (None, two.replace(" ", "  ")), (3, three), (3, three + " more"),
            (None, four), (None, four + " more"), (5, five), (5, "else"), (6, "!"), (6, "!"), (7, "?")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    equal = corpus_pipeline.store.stage(corpus_pipeline.drop_equal(spark, docs, ""), "equal")
    got = sorted((str(r.doc_id), norm(r.text)) for r in equal.collect())
    assert got == sorted({(str(i), norm(t)) for i, t in rows})
    near = corpus_pipeline.store.stage(corpus_pipeline.drop_near(spark, equal, ""), "near")
    left = [(r.doc_id, norm(r.text)) for r in near.collect()]
    assert sorted((str(i), t.removesuffix(" more")) for i, t in left) == sorted(
        [("1", one), ("None", two), ("3", three), ("None", four), ("5", five), ("5", "else"), ("6", "!"), ("7", "?")])
    whole = corpus_pipeline.drop_near(spark, docs, "").collect()                  # also where equal rows reach it
    assert sorted(str(r.doc_id) for r in whole) == ["1", "3", "5", "5", "6", "7", "None", "None"]
    cut = corpus_pipeline.cut_repeats(spark, near, "").collect()
    assert sorted((str(r.doc_id), norm(r.text)) for r in cut) == sorted((str(i), t) for i, t in left)


def test_stages_like_plain_python(spark, tmp_path):
    rng = random.Random(8)
    words = [f"word{chr(97 + i)}{chr(97 + j)}" for i in range(20) for j in range(10)]
    texts = [" ".join(rng.choices(words, k=rng.randint(20, 120))) for _ in range(150)]
    passage = " ".join(rng.choices(words, k=60))
    toxic = set(rng.sample(range(150), 45))
    for i in toxic:
        w = texts[i].split()
        w[3:3] = ["grolk", "idiot"]
        texts[i] = " ".join(w)
    rows = list(enumerate(texts))
    clean = [i for i, _ in rows if i not in toxic]
    rows += [(200, texts[clean[0]].replace(" ", "  ")), (201, texts[clean[1]] + " more"), (202, None), (203, ""),
             (204, texts[clean[2]] + " " + passage), (205, texts[clean[3]][::-1] + " " + passage)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(150)], "doc_id long, quality int, toxic int").write.parquet(
        f"{tmp_path}/labels.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), dict(rows)
    for name, step in corpus_pipeline.STAGES[:-1]:
        out = step(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        docs = corpus_pipeline.store.stage(out, name)
        got = {r.doc_id: r.text for r in docs.collect()}
        if name == "toxicity":
            want = {i: t for i, t in kept.items() if i not in toxic}
        elif name == "exact_dedup":
            first = {}
            for i, t in kept.items():
                first[norm(t)] = min(i, first.get(norm(t), i))
            want = {i: t for i, t in kept.items() if first[norm(t)] == i}
        elif name == "near_dedup":
            want = {i: t for i, t in kept.items() if brute_components(list(kept.items()))[i][1] == i}
        else:
            cut = brute_repeats(list(kept.items()), 35)
            want = {i: (c if lost else t) for (i, t), (_, lost, c) in zip(kept.items(), cut)}
            assert all(r.n_chars == len(r.text or "") for r in docs.collect() if r.text is not None)
        assert got == want, name
        kept = got
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert Counter(r.doc_id for r in pieces).keys() == kept.keys()
    assert sum(r.length for r in pieces) == sum({r.doc_id: r.doc_tokens for r in pieces}.values())
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert np.sum([r.length for r in whole.collect()]) == sum(r.length for r in pieces)
