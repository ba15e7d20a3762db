"""Katz model against counting with dictionaries."""

import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from chartloom.llm import katz


def brute(rows):
    """rows: (key, text, train) -> {key: (n_tokens, n_known, N, base, score)}, and the model's p(w | h)."""
    tokens = {k: re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) + [None]
              for k, t, _ in rows}
    one, two = Counter(), Counter()
    for k, _, train in rows:
        if train:
            one.update(tokens[k])
            two.update(zip(["<b>"] + tokens[k][:-1], tokens[k]))
    total, types = sum(one.values()), len(one)
    by_count = lambda c: [sum(v == r for v in c.values()) for r in range(1, katz.LOW + 2)]
    d1, d2 = katz.discounts(by_count(one)), katz.discounts(by_count(two))
    cut = lambda c, d: c * (d[c] if c <= katz.LOW else 1)
    spare = 1 - sum(cut(c, d1) for c in one.values()) / total if total else 1
    unseen = max(spare, 0.5 / (total + 0.5 * (types + 1)))
    p1 = lambda w: cut(one[w], d1) / total * (1 - unseen) / (1 - spare) if one[w] else unseen
    after = defaultdict(list)
    for (h, w), c in two.items():
        after[h].append((w, c))

    def p(h, w):
        if h not in after:
            return p1(w)
        n = sum(c for _, c in after[h])
        mass = sum(cut(c, d2) for _, c in after[h]) / n
        left = max(1 - mass, 0.5 / (n + 0.5))
        if two[h, w]:
            return cut(two[h, w], d2) / n * (1 - left) / mass
        return left / (1 - sum(p1(x) for x, _ in after[h])) * p1(w)

    out = {}
    for k, _, _ in rows:
        t = tokens[k]
        base = sum(math.log10((one[w] + 0.5) / (total + 0.5 * (types + 1))) for w in t)
        out[k] = len(t), sum(one[w] > 0 for w in t), total, base, sum(math.log10(p(h, w)) for h, w in zip(["<b>"] + t[:-1], t))
    return out, p, one


def run(spark, rows, **how):
    df = spark.createDataFrame(rows, "key long, text string, train boolean")
    got = katz.score_texts(df, F.col("train"), **how)
    return {r.key: (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score)
            for r in got.select("rest.key", "n_tokens", "n_known", "train_tokens", "base_score", "score").collect()}


@pytest.mark.parametrize("chunk_bytes", [300, 1 << 20])
def test_like_brute_force(spark, chunk_bytes):
    import random
    rng = random.Random(5)
    words = [f"W{i}" for i in range(30)]
    rows = [(i, " ".join(rng.choices(words, weights=[1 / (j + 1) for j in range(30)], k=rng.randint(0, 25))), rng.random() < 0.7)
            for i in range(120)]
    rows += [(900, None, True), (901, "", False), (902, "new words only", False), (903, "  W1\tw1\n", True), (904, "w1 w1", None)]
    want, p, one = brute(rows)
    got = run(spark, rows, chunk_bytes=chunk_bytes, per_shard=50)
    assert got.keys() == want.keys()
    for k in want:
        assert got[k][:3] == want[k][:3]
        assert got[k][3:] == pytest.approx(want[k][3:], rel=1e-9)
    for h in ["<b>", "w0", "w29", "never"]:
        assert sum(p(h, w) for w in [*one, "unseen"]) == pytest.approx(1)


def test_nothing_to_learn_from(spark):
    got = run(spark, [(1, "a b", False), (2, None, False)])
    assert got == {1: (3, 0, 0, 0.0, 0.0), 2: (1, 0, 0, 0.0, 0.0)}


def test_empty_table_and_clashing_names(spark):
    assert run(spark, []) == {}
    df = spark.createDataFrame([(1, "a", "x", 5.0)], "key long, text string, rest string, score double")
    row = katz.score_texts(df, F.lit(True)).select("rest.score", "rest.rest", "n_tokens").first()
    assert tuple(row) == (5.0, "x", 2)


def test_discounts_fall_back_on_small_counts():
    assert katz.discounts([0] * 6)[1] == 0.5
    good = katz.discounts([100000, 40000, 22000, 14000, 10000, 7500])
    assert all(0 < x < 1 for x in good[1:]) and good[0] == 1
