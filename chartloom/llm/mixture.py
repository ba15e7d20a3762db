"""Mixing of sources to target weights, in blocks of a fixed number of words.

The words of a source's documents, one document after the other in a fixed pseudorandom order, are packed
into blocks of `BLOCK` words; blocks do not care where documents end. The output is a row of slots, `SHARD`
of them to an output shard. How many slots of a shard each source gets is a multinomial draw with the
sources' remaining quotas as weights; what a draw takes beyond a quota is drawn again among the others, so
that all quotas are met in the end. The i-th slot of a source is filled by block `permutation(i mod blocks)`,
with another permutation for every pass over the source; blocks and documents' pieces are joined by index.

A target stops at `STOP` times its source's size, so no block is used more than `STOP` times, and hence no
document. Orders and draws depend on ids, texts and a seed, never on partitions: reruns agree.

One row per source (its words, target, blocks) reaches the driver, and one per group of output shards, of
which there are `GROUPS` at most; shards, slots, pieces and documents stay distributed. A source may own any
share of the rows: its words are counted up per range of the order, and its blocks are joined by index.

Defined results: a null text is empty; a document without words takes no slot and has 0 taken; null is a
source by itself, the last; repeated rows are documents of their own; rows that repeat id and text are told apart
by nothing but their places; no rows, or no words at all, give targets of 0. Extra columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from chartloom.llm.store import shuffle_partitions, stage
from chartloom.llm.words import mix

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
STOP = 3
BLOCK = 64                # words of a block
SHARD = 1_024             # slots of an output shard
GROUPS = 1_024            # groups of output shards, at most
SEED = 42


class Source(NamedTuple):
    no: int
    name: str | None
    size: int
    target: float
    blocks: int
    slots: int


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, stop: int = STOP) -> list[float]:
    """Shares of the sum of all sizes by weight (repeating); none above `stop` times its size, what is over is shared again."""
    weight = [weights[i % len(weights)] for i in range(len(sizes))]
    out, open_, left = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while open_:
        scale = left / sum(weight[i] for i in open_)
        full = {i for i in open_ if weight[i] * scale > stop * sizes[i]}
        if not full:
            for i in open_:
                out[i] = weight[i] * scale
            break
        for i in full:
            out[i] = float(stop * sizes[i])
        open_ -= full
        left = float(sum(sizes)) - sum(out)
    return out


def sized(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, source, size, place): the words of each document and where its pseudorandom order puts it."""
    content = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    size = F.size(F.regexp_extract_all(content, F.lit(WORD), F.lit(0))).cast("long")
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source}`").alias("source"), size.alias("size"),
                       F.xxhash64(F.col(f"`{id_col}`"), content).alias("place"), content.alias("text"))


def plan(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, block: int = BLOCK) -> list[Source]:
    """The sources in order with their words, targets, blocks and slots; one row per source."""
    rows = documents.groupBy("source").agg(F.sum("size").alias("size")).collect()
    rows.sort(key=lambda r: (r.source is None, r.source or ""))                 # str compares by code point
    goal = targets([r["size"] for r in rows], weights)
    out = []
    for no, (r, target) in enumerate(zip(rows, goal)):
        blocks = -(-r["size"] // block)
        # a slot brings size / blocks words on average
        out.append(Source(no, r.source, r["size"], target, blocks, min(STOP * blocks, round(target / r["size"] * blocks)) if blocks else 0))
    return out


def source_table(documents: DataFrame, sources: list[Source]) -> DataFrame:
    return documents.sparkSession.createDataFrame(sources, "no int, source string, source_size long, target double, blocks long, slots long")


def _of_source(rows: DataFrame, table: DataFrame) -> DataFrame:
    """`rows` with the columns of their source; null is a source."""
    table = table.withColumnRenamed("source", "_name")
    return rows.join(table, rows["source"].eqNullSafe(table["_name"])).drop("_name")


def placed(documents: DataFrame, table: DataFrame) -> DataFrame:
    """Documents with words, and `start`: the words of their source before them."""
    bits = max(1, (shuffle_partitions(documents.sparkSession) - 1).bit_length())
    rows = _of_source(documents.where("size > 0"), table.select("no", "source"))
    rows = rows.withColumn("range", F.shiftright(F.col("place"), 64 - bits))       # equal shares of the signed hashes
    here = Window.partitionBy("no", "range").orderBy("place", "doc_id", "size")
    inside = rows.withColumn("until", F.sum("size").over(here.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    # one row per source and range
    across = Window.partitionBy("no").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy("no", "range").agg(F.sum("size").alias("_all")).withColumn("before", F.coalesce(F.sum("_all").over(across), F.lit(0)))
    return (inside.join(before.drop("_all"), ["no", "range"])
            .withColumn("start", F.col("before") + F.col("until") - F.col("size")).drop("range", "until", "before"))


def pieces(rows: DataFrame, block: int = BLOCK, texts: bool = False) -> DataFrame:
    """(no, block, offset, doc_id, start, size, at, n_words[, text]): what each document has in each block.

    `offset` is the piece's place in the block, `at` its place in the document, both in words.
    """
    first, last = F.expr(f"start DIV {block}"), F.expr(f"(start + size - 1) DIV {block}")
    each = rows.select("no", "doc_id", "start", "size", *(["text"] if texts else []), F.explode(F.sequence(first, last)).alias("block"))
    begin = F.greatest(F.col("start"), F.col("block") * block)
    end = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block)
    out = each.select("no", "block", (begin - F.col("block") * block).alias("offset"), "doc_id", "start", "size",
                      (begin - F.col("start")).alias("at"), (end - begin).alias("n_words"), *(["text"] if texts else []))
    if texts:
        words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
        out = out.withColumn("text", F.array_join(F.slice(words, (F.col("at") + 1).cast("int"), F.col("n_words").cast("int")), " "))
    return out


def draw(rng: np.random.Generator, n: int, left: np.ndarray) -> np.ndarray:
    """A multinomial draw of `n` with weights `left`, none above its `left`: what is beyond is drawn again."""
    out = np.zeros(len(left), dtype=np.int64)
    while n:
        free = left - out
        more = np.minimum(rng.multinomial(n, free / free.sum()), free)
        out += more
        n -= int(more.sum())
    return out


def permuted(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """Places of `index` under a pseudorandom permutation of range(n): a four-round Feistel network, walked until inside."""
    half = np.uint64(max(1, ((n - 1).bit_length() + 1) // 2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        high, low = out[todo] >> half, out[todo] & mask
        for turn in range(4):
            high, low = low, high ^ (mix(low + np.uint64((key + turn * 0x9E3779B97F4A7C15) % 2**64)) & mask)
        out[todo] = high << half | low
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def _key(seed: int, *of: object) -> int:
    return int.from_bytes(hashlib.sha256(repr((seed, *of)).encode()).digest()[:8], "little")


def filled(source: Source, first: int, n: int, seed: int) -> np.ndarray:
    """Blocks in a source's slots first, ..., first + n - 1."""
    at = np.arange(first, first + n)
    turns, index = at // source.blocks, at % source.blocks
    out = np.empty(n, dtype=np.int64)
    for turn in np.unique(turns):
        mine = turns == turn
        out[mine] = permuted(index[mine], source.blocks, _key(seed, source.no, int(turn)))
    return out


def slots(spark: SparkSession, sources: list[Source], shard: int = SHARD, seed: int = SEED) -> DataFrame:
    """(shard, slot, no, block): which block fills each slot of the output."""
    total = sum(s.slots for s in sources)
    shards = -(-total // shard)
    per_group = max(1, -(-shards // GROUPS))
    rng, left = np.random.default_rng(_key(seed, "groups")), np.array([s.slots for s in sources], dtype=np.int64)
    groups, first = [], np.zeros(len(sources), dtype=np.int64)
    for group in range(-(-shards // per_group)):
        n = min(per_group * shard, total - group * per_group * shard)
        share = draw(rng, n, left)
        groups.append((group, [int(x) for x in first], [int(x) for x in share]))
        first, left = first + share, left - share
    kind = pa.schema([("shard", pa.int64()), ("slot", pa.int64()), ("no", pa.int32()), ("block", pa.int64())])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                rng, number = np.random.default_rng(_key(seed, "shards", row["grp"])), row["grp"] * per_group
                at, left = np.array(row["first"], dtype=np.int64), np.array(row["share"], dtype=np.int64)
                while left.any():
                    share = draw(rng, min(shard, int(left.sum())), left)
                    chosen = [s for s in sources if share[s.no]]
                    no = np.repeat(np.array([s.no for s in chosen]), share[share > 0])
                    block = np.concatenate([filled(s, int(at[s.no]), int(share[s.no]), seed) for s in chosen])
                    order = rng.permutation(len(no))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(no), number)), pa.array(np.arange(len(no))), pa.array(no[order].astype(np.int32)), pa.array(block[order])], schema=kind)
                    at, left, number = at + share, left - share, number + 1

    rows = spark.createDataFrame(groups, "grp long, first array<long>, share array<long>")
    return rows.repartition(shuffle_partitions(spark), "grp").mapInArrow(fill, "shard long, slot long, no int, block long")


def mix_texts(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, block: int = BLOCK, shard: int = SHARD, seed: int = SEED) -> DataFrame:
    """The mixture itself: (shard, slot, source, block, offset, doc_id, at, n_words, text), a row per piece of a block."""
    documents = sized(docs)
    sources = plan(documents, weights, block)
    table = source_table(documents, sources)
    parts = pieces(placed(documents, table), block, texts=True)
    # sorted on both sides: the few rows that slots come from say nothing of how many they are
    found = slots(docs.sparkSession, sources, shard, seed).hint("merge").join(parts, ["no", "block"])
    return found.join(table.select("no", "source"), "no").select(
        "shard", "slot", "source", "block", "offset", "doc_id", "at", "n_words", "text")


def taken(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, block: int = BLOCK, shard: int = SHARD, seed: int = SEED) -> DataFrame:
    """(doc_id, size, source, source_size, target, taken): the words the mixture takes of every document."""
    documents = stage(sized(docs).drop("text"), "sizes")
    sources = plan(documents, weights, block)
    table = source_table(documents, sources)
    times = slots(docs.sparkSession, sources, shard, seed).groupBy("no", "block").agg(F.count("*").alias("times"))
    met = pieces(placed(documents, table), block).join(times.hint("merge"), ["no", "block"], "left")
    # a document is the place where it starts in its source
    sums = met.groupBy("no", "start", "doc_id", "size").agg(F.sum(F.col("n_words") * F.coalesce("times", F.lit(0))).alias("taken"))
    about = table.select("no", "source", "source_size", "target")
    used = sums.join(about, "no").select("doc_id", "size", "source", "source_size", "target", "taken")
    none = _of_source(documents.where("size = 0"), about).select(
        "doc_id", "size", "source", "source_size", "target", F.lit(0).cast("long").alias("taken"))
    return used.unionByName(none)
