"""Sub-word ids against the library, packing against its own limits."""

import os
import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

P = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from chartloom.llm import bpe, vectorpack  # noqa: E402

SF = "/root/testdata/sf0.001"
BYTE, WORD = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")
ODD = "aeiou bcd'stremLLAÀÉSSß  \n\t\x1c\x85 \xa0  0123456789²½ÉñßİΣ漢字😀<|endoftext|>́\x00\x7f!?.,ǅŉ"


def odd_texts(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choices(ODD, k=rng.randint(0, 60))) + rng.choice(["", "", "<|endoftext|>", " it's <|startoftext|>x"]) for _ in range(n)]


def test_ids_equal_the_library():
    coder, library = bpe.coder(BYTE), Tokenizer.from_file(BYTE)
    texts = odd_texts(3000) + ["x" * 5000 + "ab" * 3000, "", " ", "the quick brown fox's tail"]
    for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        ids = coder.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == want.ids
        assert coder.decode(ids) == library.decode(want.ids, skip_special_tokens=False) == text


def test_tokens_stay_whole():
    coder = bpe.coder(BYTE)
    for token, name in random.Random(2).sample(sorted(coder.bytes.items()), 2000):
        if token not in coder.special.values():
            assert coder.encode_piece(name) == [token]


def test_encode_table(spark):
    df = spark.createDataFrame([(1, "hello world", "r"), (2, None, None), (3, "", "")], "ids long, text string, rest string")
    rows = {r.rest.ids: r for r in bpe.encode_texts(df, BYTE).collect()}
    assert len(rows[1].ids) == 8 and rows[1].decoded == "hello world" and rows[1].rest.rest == "r"
    assert rows[2].ids == rows[3].ids == b"" and rows[2].text is None
    assert bpe.encode_texts(df.limit(0), BYTE).count() == 0


def test_word_ids_equal_the_library():
    coder, library = vectorpack.word_ids(WORD), Tokenizer.from_file(WORD)
    texts = odd_texts(3000, 5) + ["y" * 3000, ""]
    for _ in range(2):                                               # words new and known
        ids, at = coder.encode(pa.array(texts, pa.large_string()))
        for i, want in enumerate(library.encode_batch(texts, add_special_tokens=False)):
            assert ids[at[i]:at[i + 1]].tolist() == want.ids
    coder.forget()
    assert coder.encode(pa.array(texts[:1], pa.large_string()))[0].tolist() == library.encode(texts[0], add_special_tokens=False).ids
    assert [len(x) for x in coder.encode(pa.array([], pa.large_string()))] == [0, 1]


def test_limits_hold_and_nothing_is_lost():
    rng = random.Random(4)
    packer, sizes, out = vectorpack.Packer(100, 10, 60, pool=50), {}, []
    for e in range(1500):
        sizes[e] = (rng.choice([1, 2, 5, 40, 130, 400]), rng.randint(0, 50))
        out += packer.give(e, *sizes[e])
    out += packer.rest()
    pieces = defaultdict(list)
    for sequence in out:
        assert len(sequence) <= 10 and sum(n for _, _, n in sequence) <= 100
        loss = sum(max(0, s + n - max(s, sizes[e][1])) for e, s, n in sequence)
        assert loss <= 60
        for e, s, n in sequence:
            pieces[e].append((s, n))
    for e, (n, _) in sizes.items():
        ordered = sorted(pieces[e])
        assert ordered[0][0] == 0 and sum(x for _, x in ordered) == n
        assert all(a + b == c for (a, b), (c, _) in zip(ordered, ordered[1:]))


def test_short_texts_fill_sequences():
    for n, tokens, segments in ((10, 4096, None), (5, 4096, None), (1, 4096, None), (5, None, 512)):
        packer, out = vectorpack.Packer(segments=segments), []
        for e in range(5000):
            out += packer.give(e, n)
        assert out and {sum(p[2] for p in s) for s in out} == ({tokens} if tokens else {n * segments})
        assert segments is None or {len(s) for s in out} == {segments}
        out += packer.rest()
        assert sum(p[2] for s in out for p in s) == 5000 * n


def test_packed_table(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choices(["alpha", "beta", "Gamma,", "des", "été"], k=rng.choice([0, 3, 50, 900, 9000])))) for i in range(80)]
    rows += [(900, None), (901, "")]
    library = Tokenizer.from_file(WORD)
    want = {i: [*library.encode(t or "", add_special_tokens=False).ids, vectorpack.END] for i, t in rows}
    got = vectorpack.pack_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), WORD).collect()
    docs, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        docs[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
        assert r.doc_tokens == len(want[r.doc_id])
        assert np.frombuffer(r.ids, "<u4").tolist() == want[r.doc_id][r.start:r.start + r.length]
    for i, ids in want.items():
        assert sum(r.length for r in docs[i]) == len(ids)
    used = padded = 0
    for pieces in sequences.values():
        pieces.sort(key=lambda r: r.offset)
        total = sum(r.length for r in pieces)
        assert [r.offset for r in pieces] == [sum(x.length for x in pieces[:k]) for k in range(len(pieces))]
        assert total <= 4096
        used, padded = used + total, padded + (total if total & (total - 1) == 0 else 4096)
    assert used / padded > 0.99
    assert vectorpack.pack_documents(spark.createDataFrame([], "doc_id long, text string"), WORD).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
def test_documents_leave_hardly_any_padding(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", F.lit(1).alias("ids"), F.lit("x").alias("length"), F.lit("x").alias("first"))
    totals = [r.n for r in vectorpack.pack_documents(docs, WORD).groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()]
    assert sum(totals) / sum(n if n & (n - 1) == 0 else 4096 for n in totals) > 0.995


def test_loss_bearing_tokens_are_limited(spark):
    df = spark.createDataFrame([(i, "word " * 300, 200) for i in range(40)], "doc_id long, text string, prompt int")
    got = vectorpack.pack_documents(df.coalesce(1), WORD, loss_from="prompt", tokens=1024, loss=256).collect()
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append(r)
    for pieces in by.values():
        assert sum(r.length for r in pieces) <= 1024
        assert sum(max(0, r.start + r.length - max(r.start, 200)) for r in pieces) <= 256
    assert sum(r.length for r in got) == 40 * 301
