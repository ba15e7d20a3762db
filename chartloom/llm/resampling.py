"""Importance resampling towards a target text set: hashed n-gram features, their log ratios, a Gumbel draw.

Features are the runs of one to three words; a feature's bucket is its CRC-32 modulo `BUCKETS`. They are read
with an Aho-Corasick automaton: a slice's distinct words, each between two delimiters, carry their CRC and
length, one scan of the slice emits these payloads word by word, and the CRC of a run follows from its
neighbours' payloads alone (the CRC of a joined text is linear in the CRCs of its halves, and the length says
by how much the first half is shifted), so no feature is ever spelled out. A dictionary holds the words of one slice of about `SLICE`
bytes, whatever the corpus's vocabulary; words over `LONGEST` bytes stand in the scanned text as short tokens that carry
the payload of the whole word.

The buckets of all documents and of the target are counted in their tasks and summed; gains and weights are
whole numbers. The draw is ranked in ranges of the score that are scanned separately, one count per range
passing through the driver.

Defined results: a null text is empty; a document without words has no features and weight 0 but still a
score; a null id counts as empty in the hash and comes last among ties; repeated rows are documents of their
own; an empty target or corpus counts nothing; no rows give none. Extra columns travel in `rest`.
"""

from __future__ import annotations

import re
import zlib
from collections import deque
from collections.abc import Iterator
from functools import lru_cache
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from chartloom.llm.store import claim_worker, stage
from chartloom.llm.words import views
from chartloom.operators.ordered import range_bounds, with_range

BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 5
SEED = 42
SLICE = 4 << 20
LONGEST = 512             # bytes of a word that the automaton spells out
BETWEEN = " \n "          # the line feed stands between documents; in the scanned text it is no letter of a word
# bytes that make words, capitals as small letters; all others are spaces
FOLD = np.full(256, 0x20, dtype=np.uint8)
for first, last in ((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF)):
    FOLD[first:last + 1] = np.arange(first, last + 1)
FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
LONG = re.compile("[^ \n]{%d,}" % (LONGEST + 1))
SPACE = np.uint32(zlib.crc32(b" "))


def _apply(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    """A linear map of 32-bit values, given by its images of the values of each byte."""
    return (tables[0][crc & np.uint32(255)] ^ tables[1][(crc >> np.uint32(8)) & np.uint32(255)]
            ^ tables[2][(crc >> np.uint32(16)) & np.uint32(255)] ^ tables[3][crc >> np.uint32(24)])


@lru_cache(maxsize=1)
def _shifts() -> np.ndarray:
    """Tables of what 2^k further zero bytes make of a CRC, for k < 32."""
    byte = np.arange(256, dtype=np.uint32)
    one = np.zeros((4, 256), dtype=np.uint32)
    # the CRC of a zero byte after the register v, without the inversions at both ends: linear in v
    for place in range(4):
        one[place] = [zlib.crc32(b"\0", int(v) << (8 * place)) ^ zlib.crc32(b"\0") for v in byte]
    out = [one]
    for _ in range(31):
        last = out[-1]
        out.append(np.stack([_apply(last, last[place]) for place in range(4)]))
    return np.stack(out)


def shifted(crc: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRCs with `length` bytes to come: what joining them with a text of that length needs."""
    out, tables = crc.copy(), _shifts()
    for k in range(int(length.max()).bit_length() if len(length) else 0):
        mine = (length >> k & 1).astype(bool)
        out[mine] = _apply(tables[k], out[mine])
    return out


def joined(crc: np.ndarray, next_crc: np.ndarray, next_length: np.ndarray) -> np.ndarray:
    """CRCs of `first second` with one space between, from the CRCs of both and the second's length."""
    return shifted(_apply(_shifts()[0], crc) ^ SPACE, next_length) ^ next_crc


def scan(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, CRC and length of every word in folded texts, in order, read off an automaton of their distinct words."""
    import ahocorasick
    whole = f" {BETWEEN.join(t.decode('latin-1') for t in texts)} "       # a character a byte
    long: list[str] = []

    def token(found: re.Match) -> str:
        long.append(found[0])
        return f"\0{len(long) - 1}"
    # in the order of their first places, so that what is frequent stands first in the automaton's nodes
    distinct = dict.fromkeys(whole.split(" "))
    if max(map(len, distinct)) > LONGEST:
        whole = LONG.sub(token, whole)
        distinct = dict.fromkeys(whole.split(" "))
    distinct.pop("", None)
    if not distinct:
        return np.zeros(0, np.int64), np.zeros(0, np.uint32), np.zeros(0, np.int64)
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    deque(map(automaton.add_word, [f" {w} " for w in distinct], range(len(distinct))), maxlen=0)
    automaton.make_automaton()
    spelled = [b"" if w == "\n" else (long[int(w[1:])] if w[0] == "\0" else w).encode("latin-1") for w in distinct]
    crcs = np.fromiter(map(zlib.crc32, spelled), np.uint32, len(spelled))
    lengths = np.fromiter(map(len, spelled), np.int64, len(spelled))
    emitted = np.fromiter(map(itemgetter(1), automaton.iter(whole)), dtype=np.int64)
    crc, length = crcs[emitted], lengths[emitted]
    words = length > 0                                                    # the mark between documents has none
    return np.cumsum(~words)[words], crc[words], length[words]


def features(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(document, bucket) of all single words, all pairs and all triples."""
    document, crc, length = scan(texts)
    run, last = crc, document
    for n in (1, 2, 3):
        if n > 1:
            run, last = joined(run[:-1], crc[n - 1:], length[n - 1:]), last[:-1]
        inside = last == document[n - 1:]
        yield last[inside], (run[inside] % np.uint32(BUCKETS)).astype(np.int64)


def _slices(column: pa.Array) -> Iterator[tuple[int, int, list[bytes]]]:
    for start, stop, data, offsets in views(column, SLICE):
        data = FOLD[data]
        yield start, stop, [data[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:])]


def bucket_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(bucket, n): how often the features of all texts fall into each bucket."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim_worker("resampling")
        total = np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            for _, _, texts in _slices(batch.column(0)):
                for _, bucket in features(texts):
                    total += np.bincount(bucket, minlength=BUCKETS)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["bucket", "n"])

    return (docs.select(F.col(f"`{text}`").alias("text")).mapInArrow(count, "bucket long, n long")
            .groupBy("bucket").agg(F.sum("n").alias("n")))


def gains(docs: DataFrame, target: DataFrame, text: str = "text") -> DataFrame:
    """(bucket, gain) of all buckets: a thousandth of the smoothed log ratio of target to corpus, rounded down."""
    spark = docs.sparkSession
    counts = bucket_counts(docs, text).select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t"))
    counts = counts.unionByName(bucket_counts(target, text).select("bucket", F.lit(0).cast("long").alias("s"), F.col("n").alias("t")))
    every = spark.range(BUCKETS).select(F.col("id").alias("bucket"), F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("t"))
    sums = stage(counts.unionByName(every).groupBy("bucket").agg(F.sum("s").cast("double").alias("s"), F.sum("t").cast("double").alias("t")), "buckets")
    whole = sums.agg(F.sum("s").alias("S"), F.sum("t").alias("T")).first()
    ratio = (F.col("t") + 1) * F.lit(whole["S"] + BUCKETS) / ((F.col("s") + 1) * F.lit(whole["T"] + BUCKETS))
    return sums.select("bucket", F.floor(F.log(ratio) * 1000).cast("long").alias("gain"))


def weigh(docs: DataFrame, gain: DataFrame, text: str = "text") -> DataFrame:
    """(rest, n_words, n_features, weight): the sum of the gains of each document's features."""
    table = np.zeros(BUCKETS, dtype=np.float64)
    for row in gain.collect():                                            # one number per bucket
        table[row["bucket"]] = row["gain"]
    packed = docs.select(F.struct("*").alias("rest"), F.col(f"`{text}`").alias("text"))
    schema = packed.select("rest").schema.add("n_words", "long").add("n_features", "long").add("weight", "long")

    def weigh_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim_worker("resampling")
        for batch in batches:
            for start, stop, texts in _slices(batch.column(1)):
                n = stop - start
                found = [(np.bincount(document, minlength=n), np.bincount(document, table[bucket], minlength=n))
                         for document, bucket in features(texts)]
                weight = sum(w for _, w in found)                         # whole numbers, exact in doubles
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, n), *(pa.array(x.astype(np.int64)) for x in (found[0][0], sum(c for c, _ in found), weight))],
                    names=["rest", "n_words", "n_features", "weight"])

    return packed.mapInArrow(weigh_batch, schema)


def with_score(weighed: DataFrame, id_col: str = "doc_id", seed: int = SEED) -> DataFrame:
    """Add `score`: the weight plus Gumbel noise, in thousandths, from the hash of seed and id."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"rest.`{id_col}`").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.log(-F.log((h + 0.5) / 4294967296)) * -1000).cast("long")
    return weighed.withColumn("score", F.col("weight") + noise)


def draw(scored: DataFrame, id_col: str = "doc_id", percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """Add `rank` (1, 2, ... by score, ties to the smaller id) to the best `percent` of the documents with enough words; null elsewhere."""
    spark, scored = scored.sparkSession, stage(scored, "scored")
    able = F.col("n_words") >= least_words
    ranged = with_range(scored.where(able), "score", range_bounds(scored.where(able), "score"), "_range")
    counts = sorted(((r["_range"], r["n"]) for r in ranged.groupBy("_range").agg(F.count("*").alias("n")).collect()), reverse=True)
    wanted = sum(n for _, n in counts) * percent // 100
    offsets, before = [], 0
    for number, n in counts:
        if before < wanted:
            offsets.append((number, before))
        before += n
    lowest = min((number for number, _ in offsets), default=None)
    no_rank = F.lit(None).cast("long").alias("rank")
    if lowest is None:
        return scored.withColumn("rank", no_rank)
    order = Window.partitionBy("_range").orderBy(F.desc("score"), F.asc_nulls_last(F.col(f"rest.`{id_col}`")))
    top = ranged.where(F.col("_range") >= lowest).withColumn("_place", F.row_number().over(order))
    # one row per range
    above = spark.createDataFrame(offsets, "_range int, _above long")
    place = F.col("_place") + F.col("_above")
    best = top.join(F.broadcast(above), "_range").withColumn("rank", F.when(place <= wanted, place)).select(*scored.columns, "rank")
    return (best.unionByName(ranged.where(F.col("_range") < lowest).select(*scored.columns, no_rank))
            .unionByName(scored.where(~able).select("*", no_rank)))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text: str = "text", percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """(rest, n_words, n_features, weight, score, rank) of every document."""
    return draw(with_score(weigh(docs, gains(docs, target, text), text), id_col, seed), id_col, percent)
