"""The filter audit, the mixture and the importance draw against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from chartloom.llm import filteraudit, mixture, resampling

WORDS = re.compile("[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, rest string, mask string, `a.b` int, score string, n int"


def rows_of(texts, langs=("x", None), sources=("s", None)):
    return [(i, t, langs[i % len(langs)], sources[i % len(sources)], "r", "m", 1, "s", 2) for i, t in enumerate(texts)]


def odd_texts(seed=1):
    rng = random.Random(seed)
    words = ["The", "UPPER", "low", "é", "x#", "日本", "a|b", "tab\tin", "two\n\nlines", "0"]
    out = [None, "", " \t\n", "one", "é" * 40, "#", "A" * 2000, " ".join(f"w{i}" for i in range(150)), "word " * 120]
    out += [" ".join(rng.choices(words, k=rng.choice([1, 5, 30, 140, 400]))) for _ in range(60)]
    out += [" ".join(f"w{rng.randrange(4000)}" for _ in range(20_000))]                   # a very long one
    return out + out[5:30] + [out[40]] * 20


# ---- filter audit ------------------------------------------------------------------------------

def brute_audit(rows, labels):
    good, toxic = ({i for i, q, t in labels if i is not None and (q, t)[k] == 1} for k in (0, 1))
    first = {}
    for r in rows:
        if r[0] is not None:
            first[r[1] or ""] = min(r[0], first.get(r[1] or "", r[0]))
    failing = []
    for r in rows:
        text = r[1] or ""
        words = WORDS.findall(text)
        fails = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words),
                 "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), "D": bool(re.search("[#$%&*|]", text)),
                 "E": r[0] is not None and r[0] > first[text]}
        failing.append((r[2] or "", {f for f in fails if fails[f]}, r[0] in good, r[0] in toxic))
    out = {}
    for part in {p for p, *_ in failing}:
        mine, shapley = [f for f in failing if f[0] == part], Counter()
        for order in permutations("ABCDE"):
            for step, name in enumerate(order, 1):
                before = set(order[:step - 1])
                lost = [f for f in mine if name in f[1] and not f[1] & before]
                shapley[name] += len(lost)
                out[part, "".join(order), step] = [
                    sum(not f[1] & (before | {name}) for f in mine), len(lost), sum(name in f[1] and bool(f[1] & before) for f in mine),
                    sum(f[1] == {name} for f in mine), sum(f[2] for f in lost), sum(f[3] for f in lost)]
        for (p, order, step), values in out.items():
            if p == part:
                values.append(shapley[order[step - 1]])
    return out


def audit(spark, rows, labels):
    flags = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").select(
        "doc_id", (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic"))
    return filteraudit.audit(filteraudit.failure_counts(spark.createDataFrame(rows, DOCS), flags, "lang"))


def test_audit_like_brute_force(spark):
    rows = rows_of(odd_texts(), langs=("x", None, "", "y"))
    rows += rows[3:9] + [(None, *rows[k][1:]) for k in (1, 1, 7, 20)]                     # repeated rows, no ids
    labels = [(i, i % 2, i % 3) for i in range(0, 90, 2)] + [(4, 0, 1), (4, 1, None), (None, 1, 1), (10_000, 1, 1)]
    got = audit(spark, rows, labels).collect()
    want = brute_audit(rows, labels)
    assert len(got) == len(want) == 3 * 600
    for r in got:
        assert [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] == want[r.part, r.filter_order, r.step]


def test_audit_without_rows(spark):
    assert audit(spark, [], []).collect() == []
    assert len(audit(spark, rows_of(["a"]), []).collect()) == 600


@pytest.mark.parametrize("n", [1, 2, 5, 7])
def test_lattice_counts_orders(n):
    edges = filteraudit.lattice(n)
    assert len(edges) == n << n >> 1
    for bit in range(n):
        assert sum(orders for _, b, orders in edges if b == 1 << bit) == math.factorial(n)
    assert all(orders == math.factorial(bin(s).count("1")) * math.factorial(n - 1 - bin(s).count("1")) for s, _, orders in edges)


# ---- mixture -----------------------------------------------------------------------------------

def test_targets():
    assert mixture.targets([10, 10, 10]) == [18.75, 7.5, 3.75]
    assert mixture.targets([1, 100, 100]) == [3.0, pytest.approx(132), pytest.approx(66)]
    assert mixture.targets([1, 1, 100]) == [3.0, 3.0, 96.0]
    assert mixture.targets([0, 5]) == [0.0, 5.0] and mixture.targets([0, 0]) == [0.0, 0.0] and mixture.targets([]) == []


def test_targets_never_pass_the_stop():
    rng = random.Random(5)
    for _ in range(200):
        sizes = [rng.choice([0, 1, 10, 1000, 10 ** 9]) for _ in range(rng.randrange(1, 12))]
        goal = mixture.targets(sizes)
        assert all(g <= 3 * s + 1e-6 for g, s in zip(goal, sizes)) and sum(goal) == pytest.approx(sum(sizes))
        scale = {round(g / (5, 2, 1)[i % 3], 3) for i, (g, s) in enumerate(zip(goal, sizes)) if g < 3 * s - 1e-6}
        assert len(scale) <= 1 or max(scale) == pytest.approx(min(scale), rel=1e-6)       # by weight among the others


@pytest.mark.parametrize("n", [1, 2, 3, 64, 1000, 4097])
def test_permutation(n):
    for key in (1, 2**63 + 5):
        assert sorted(mixture.permuted(np.arange(n), n, key)) == list(range(n))


def test_draw_meets_quotas():
    rng, left = np.random.default_rng(1), np.array([5, 0, 1000, 3], dtype=np.int64)
    while left.any():
        share = mixture.draw(rng, min(100, int(left.sum())), left)
        assert (share <= left).all() and share.sum() == min(100, left.sum())
        left = left - share


def test_mixture(spark):
    rows = rows_of(odd_texts(2), sources=("b", "a", None, "Z", "é", ""))
    rows += rows[3:9] + [(None, *rows[k][1:]) for k in (1, 7, 20)]
    docs = spark.createDataFrame(rows, DOCS)
    got = mixture.taken(docs, block=16, shard=32).collect()
    assert sorted((str(r.doc_id), r["size"]) for r in got) == sorted((str(r[0]), len(WORDS.findall(r[1] or ""))) for r in rows)
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(WORDS.findall(r[1] or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    goal = dict(zip(order, mixture.targets([sizes[s] for s in order])))
    took = Counter()
    for r in got:
        assert (r.source_size, r.target) == (sizes[r.source], goal[r.source]) and 0 <= r.taken <= 3 * r["size"]
        took[r.source] += r.taken
    assert all(abs(took[s] - goal[s]) <= 32 for s in goal)
    # the same for other partitions
    moved = mixture.taken(docs.repartition(5, "lang"), block=16, shard=32).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, moved))
    # and what `taken` counts is what the texts hold
    texts = mixture.mix_texts(docs, block=16, shard=32).collect()
    assert all(len(WORDS.findall(r.text)) == r.n_words <= 16 for r in texts)
    content = {(r[0], r[3], tuple(WORDS.findall(r[1] or ""))) for r in rows}
    words = {}
    for i, s, w in content:
        words.setdefault((i, s), []).append(w)
    assert all(any(tuple(r.text.split(" ")) == tuple(x for x in w[r["at"]:r["at"] + r.n_words]) for w in words[r.doc_id, r.source]) for r in texts)
    from_texts = Counter()
    for r in texts:
        from_texts[r.doc_id] += r.n_words
    by_id = Counter()
    for r in got:
        by_id[r.doc_id] += r.taken
    assert +from_texts == +by_id
    full = Counter()
    for r in texts:
        full[r.shard, r.slot] += r.n_words
    assert max(full.values()) == 16 and {k[0] for k in full} == set(range(max(full)[0] + 1))


def test_mixture_without_words(spark):
    assert mixture.taken(spark.createDataFrame([], DOCS)).collect() == []
    assert [(r.taken, r.target) for r in mixture.taken(spark.createDataFrame(rows_of([None, " ", ""]), DOCS)).collect()] == [(0, 0.0)] * 3
    assert mixture.mix_texts(spark.createDataFrame(rows_of([None]), DOCS)).collect() == []


def test_one_source_is_taken_whole(spark):
    got = mixture.taken(spark.createDataFrame(rows_of(["a b c", "d", "e " * 500], sources=(None,)), DOCS)).collect()
    assert all(r.taken == r["size"] for r in got)


# ---- importance resampling ---------------------------------------------------------------------

RUNS = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def buckets(text):
    words = RUNS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return len(words), [zlib.crc32(" ".join(words[i:i + n]).encode()) % 10_000 for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def brute_draw(rows, target, percent):
    found = [buckets(r[1]) for r in rows]
    s, t = Counter(b for _, f in found for b in f), Counter(b for x in target for b in buckets(x)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + 10_000) / ((s[b] + 1) * (all_t + 10_000)))) for b in range(10_000)]
    out = []
    for r, (n, f) in zip(rows, found):
        h = int(hashlib.sha256(f"42:{'' if r[0] is None else r[0]}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append([r[0], n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None])
    able = sorted((o for o in out if o[1] >= 20), key=lambda o: (-o[4], o[0] is None, o[0] or 0))
    for rank, o in enumerate(able[:len(able) * percent // 100], 1):
        o[5] = rank
    return out


@pytest.mark.parametrize("percent", [5, 40])
def test_resample_like_brute_force(spark, percent):
    texts = odd_texts(3) + ["A" * 700 + " b " + "\0c" * 3 + " 0 \x000 " + "d" * 513, "x" * 512 + " y", "\x001"]
    rows = rows_of(texts)
    rows += rows[30:34] + [(None, *rows[k][1:]) for k in (1, 1, 9, 50)]
    target = [None, "", "low the upper é x", "w1 w2 w3 " * 9]
    got = resampling.resample(spark.createDataFrame(rows, DOCS), spark.createDataFrame([(t,) for t in target], "text string"), percent=percent)
    mine = [[r.rest.doc_id, r.n_words, r.n_features, r.weight, r.score, r["rank"]] for r in got.collect()]
    assert sorted(map(str, mine)) == sorted(map(str, brute_draw(rows, target, percent)))
    assert got.select("rest.*").columns == spark.createDataFrame(rows, DOCS).columns


def test_resample_without_rows(spark):
    none, some = spark.createDataFrame([], DOCS), spark.createDataFrame(rows_of(["a b", None]), DOCS)
    assert resampling.resample(none, some).collect() == []
    assert [r["rank"] for r in resampling.resample(some, none).collect()] == [None, None]
    hundred = spark.createDataFrame(rows_of([f"w{i} " * 20 for i in range(40)]), DOCS)
    assert sorted(r["rank"] or 0 for r in resampling.resample(hundred, none).collect()) == [0] * 38 + [1, 2]


def test_joined_payloads():
    rng = random.Random(4)
    texts = [bytes(rng.choices(b"abc\xc3\xa9", k=rng.choice([1, 2, 7, 300, 70_000]))) for _ in range(40)]
    crc, length = np.array([zlib.crc32(t) for t in texts], np.uint32), np.array([len(t) for t in texts])
    both = resampling.joined(crc[:-1], crc[1:], length[1:])
    assert list(both) == [zlib.crc32(a + b" " + b) for a, b in zip(texts, texts[1:])]
