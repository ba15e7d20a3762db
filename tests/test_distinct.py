"""Distinct runs of terms: the same rows as the texts themselves, exchanged as numbers."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chartloom.functions.text import ngram_range
from chartloom.operators import distinct, features


def rows(spark, texts):
    return spark.createDataFrame([(t.split(" ") if t else ([] if t == "" else None),) for t in texts], "words array<string>")


def told(found):
    listed = [r["term"] for r in found.collect()]
    assert len(listed) == len(set(listed))
    return set(listed)


def grams(texts, high):
    split = [t.split(" ") for t in texts if t]
    return {" ".join(w[i:i + n]) for w in split for n in range(1, high + 1) for i in range(len(w) - n + 1)}


@pytest.mark.parametrize("chunk", [1, 50, 4_000_000])
def test_runs_like_plain_python(spark, monkeypatch, chunk):
    monkeypatch.setattr(distinct, "CHUNK_TERMS", chunk)
    rng = random.Random(8)
    words = [f"w{i}" * (i % 4 + 1) for i in range(60)] + ["é", "日本", "x" * 300]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 30))) for _ in range(200)] + ["", None, "a", "a", "a b"]
    df = rows(spark, texts).repartition(5)
    for high in (1, 2, 3):
        assert told(features.distinct_terms(df, F.col("words"), high)) == grams(texts, high)
    assert told(features.distinct_terms(df, ngram_range(F.col("words")))) == grams(texts, 3)


def test_no_rows(spark):
    assert features.distinct_terms(rows(spark, ["a"]).where("false"), F.col("words"), 3).count() == 0
    assert features.distinct_terms(rows(spark, ["", None]), F.col("words"), 3).count() == 0


def test_lines_of_any_numbers():
    rng = np.random.default_rng(9)
    for base in (3, 2**31, 2**40):
        columns = [rng.integers(0, base, 500) for _ in range(3)]
        columns = [np.concatenate([c, c[:100]]) for c in columns]
        got = distinct.different(columns, base)
        assert list(zip(*(c.tolist() for c in got))) == sorted(set(zip(*(c.tolist() for c in columns))))


def test_messages_hold_what_was_put_in():
    import pyarrow as pa
    names = pa.array([f"n{i}" for i in range(70_000)])
    runs = [distinct.different([np.arange(70_000)], 70_000), distinct.different([np.arange(69_999), np.arange(1, 70_000)], 70_000),
            [np.zeros(0, np.int64)] * 3]
    (part,) = distinct.unpack(pa.scalar(distinct._message(names, runs), pa.binary()))
    held, got = distinct._opened(part, 3)
    assert held.equals(names) and all((a == b).all() for x, y in zip(runs, got) for a, b in zip(x, y))


def test_a_task_has_a_bounded_share_of_the_runs(spark):
    rng = random.Random(10)
    texts = [" ".join(f"{rng.randrange(5000):x}" for _ in range(60)) for _ in range(300)]
    sent = distinct._sent(rows(spark, texts), 3, 40).groupBy("shard").agg(F.count(F.lit(1)).alias("n"))
    assert sent.count() == 40
    found = distinct.distinct_runs(rows(spark, texts), 3, 40)
    sizes = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 40 and max(sizes) < 3 * sum(sizes) / 40


def test_less_travels_than_the_texts_of_the_runs(spark):
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 11))) for _ in range(2000)]
    texts = [" ".join(rng.choice(words) for _ in range(100)) for _ in range(1000)]
    sent = distinct._sent(rows(spark, texts).coalesce(1), 3, 12).agg(F.sum(F.length("message"))).first()[0]
    assert sent < sum(map(len, grams(texts, 3))) / 3          # every run went as a text, twice
    plan = features.distinct_terms(rows(spark, texts), F.col("words"), 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "explode" not in plan.lower()
