"""Approximate nearest neighbours by largest inner product: an NN-descent graph and greedy search on it.

Equal vectors are one node, so a vector that a third of the rows share costs as much as any other; of
its ids the smallest `k` + 1 can be reported and are kept. The graph starts from a few small random-hyperplane
cells per node and improves by local joins: each node brings together its nearest neighbours and a hashed
sample of the nodes that count it among theirs. Entries of a list are fresh until they have taken part in a
join; only pairs with a fresh member are compared, and those that improve a member's list go back to it, until
hardly an entry is fresh. What travels is one byte per component and a scale; the best nodes of a search are
scored again on the original vectors. A search starts from a query's place in the graph (its own node) and the
best of a bounded pool of nodes, and opens the best nodes not opened yet until all `WIDTH` best nodes it knows
are opened: then no step can change its result. For the search each node's list holds its neighbours' codes
too, bucketed by node: a step sends (query, node) requests to the lists and scores back, and nothing else.

The index holds every row. It is approximate by design: recall against brute force is measured in the
tests and given in the README. Scores of codes are whole numbers times two scales, the same in any order of work.

Defined results: vectors that are null, empty, zero, or hold a null or a non-finite component take no
part, nor do rows without an id and vectors whose length is not the table's most frequent one; a row
that repeats id and vector counts once; fewer than `k` candidates are all returned. Other columns are not read.
"""

from __future__ import annotations

import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from chartloom.llm.store import new_path, shuffle_partitions, stage

NEIGHBOURS = 32           # list length of the graph
MEET = 16                 # fresh neighbours, and as many reverse ones, in a local join
KNOWN = 8                 # joined before, and as many reverse ones, that they meet
EACH = 6                  # pairs a join sends back to each of its members, at most
CELL = 64                 # nodes of a starting cell, about
ROUNDS = 4                # starting cells per node
FIRST = 8                 # neighbours a starting cell gives each of its nodes
CHANGED = 0.01            # local joins end when less than this share of all list entries is fresh
WIDTH = 256               # nodes a search keeps
OPEN = 64                 # nodes a search opens at a time
POOL = 1_024              # sampled nodes that every search is compared with
ENTRIES = 32              # of these, the best that it starts from
RESCORED = 4              # times k nodes are scored on the original vectors
SEED = 42


def usable(df: DataFrame, id_col: str, vector: str) -> DataFrame:
    """(vec_id, vec): rows that take part; vec is the components as little-endian bytes."""
    v = F.col(f"`{vector}`")
    kind = "<f4" if df.schema[vector].dataType.elementType.simpleString() == "float" else "<f8"
    inside = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), v.cast("array<double>").alias("v")).where(
        F.col("vec_id").isNotNull() & v.isNotNull() & inside & F.exists(v, lambda x: x != 0))
    size = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if size is None:
        return df.sparkSession.createDataFrame([], "vec_id long, vec binary")

    def pack(batches):
        for batch in batches:
            lists = batch.column("v")
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(kind)
            flat = flat.reshape(len(lists), -1) + 0.0 if len(lists) else flat      # -0.0 is 0.0
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array([x.tobytes() for x in flat], pa.binary())],
                                             names=["vec_id", "vec"])
    return rows.where(F.size("v") == size.n).mapInArrow(pack, "vec_id long, vec binary")


class Graph:
    """nodes (node, vec, code), members (node, vec_id; the smallest ids), edges (node, near: [(score, nb, fresh)])."""

    def __init__(self, nodes: DataFrame, members: DataFrame, edges: DataFrame, kind: str):
        self.nodes, self.members, self.edges, self.kind = nodes, members, edges, kind


def best_lists(entries: DataFrame, key: str, flag: str, merge, k: int) -> DataFrame:
    """(key, near) from (key, nb, score, flag): the k best, each once; flags of the same entry by `merge`."""
    once = entries.repartition(key).groupBy(key, "nb").agg(F.max("score").alias("score"), merge(flag).alias(flag))
    return once.groupBy(key).agg(
        F.slice(F.sort_array(F.collect_list(F.struct("score", "nb", flag)), asc=False), 1, k).alias("near"))


def encode(vectors: np.ndarray) -> list[bytes]:
    """One signed byte per component, behind the vector's scale."""
    scale = np.maximum(np.abs(vectors).max(axis=1) / 127, np.finfo("<f4").tiny).astype("<f4")
    codes = np.round(vectors / scale[:, None]).astype(np.int8)
    return [s.tobytes() + c.tobytes() for s, c in zip(scale, codes)]


def decode(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(scales, whole components) of codes. Sums of their products are exact in the float type chosen."""
    raw = np.frombuffer(b"".join(values.to_pylist()), np.uint8).reshape(len(values), -1) if len(values) else np.zeros((0, 4), np.uint8)
    kind = np.float32 if raw.shape[1] <= 1_024 else np.float64      # 127 * 127 * 1,024 < 2 ** 24
    return np.ascontiguousarray(raw[:, :4]).view("<f4").ravel().astype(np.float64), raw[:, 4:].view(np.int8).astype(kind)


def _rows(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Of each flattened element: its row, and its place there."""
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _long(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


PAIR = "node long, nb long, score double"
MEMBER = ("node", "code", "floor", "fresh")


def local_join(groups: DataFrame, each: int, rows: int) -> DataFrame:
    """(node, nb, score) from the pairs inside each group's list `them` (of MEMBER) that have a fresh member:
    for every member its `each` best others above its floor."""
    def meet(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, rows):
                lists = whole.column("them").slice(start, rows)
                flat = lists.flatten()
                if not len(flat):
                    continue
                row, at = _rows(lists)
                shape = (len(lists), int(at.max()) + 1)
                ids, floor = np.full(shape, -1, np.int64), np.full(shape, np.inf)
                fresh, scale = np.zeros(shape, bool), np.zeros(shape)
                scales, codes = decode(flat.field("code"))
                x = np.zeros((*shape, codes.shape[1]), codes.dtype)
                ids[row, at], floor[row, at], fresh[row, at] = _long(flat.field("node")), _long(flat.field("floor")), _long(flat.field("fresh"))
                scale[row, at], x[row, at] = scales, codes
                scores = (x @ x.transpose(0, 2, 1)) * (scale[:, :, None] * scale[:, None, :])
                out = (ids[:, None, :] < 0) | (ids[:, :, None] == ids[:, None, :]) | ~(fresh[:, :, None] | fresh[:, None, :])
                scores[out] = -np.inf
                n = min(each, shape[1])
                best = np.argpartition(-scores, n - 1, axis=2)[:, :, :n]
                values = np.take_along_axis(scores, best, axis=2)
                g, i, j = np.nonzero((values > floor[:, :, None]) & (values > -np.inf))
                yield pa.RecordBatch.from_arrays([pa.array(ids[g, i]), pa.array(ids[g, best[g, i, j]]), pa.array(values[g, i, j])],
                                                 names=["node", "nb", "score"])
    return groups.select("them").mapInArrow(meet, PAIR)


def cells(nodes: DataFrame, n: int) -> DataFrame:
    """(cell, node): each node in `ROUNDS` cells of about `CELL` nodes; in one, where one holds them all."""
    bits = max(0, int(np.log2(max(1, n / CELL))))
    rounds = ROUNDS if bits else 1

    def hash_planes(batches):
        planes = None
        for batch in batches:
            ids = _long(batch.column("node"))
            if not len(ids):
                continue
            _, x = decode(batch.column("code"))
            if planes is None:
                planes = np.random.default_rng(SEED).standard_normal((x.shape[1], rounds * bits))
            sides = (x @ planes > 0).reshape(len(ids), rounds, bits)
            codes = sides @ (np.int64(1) << np.arange(bits, dtype=np.int64)) if bits else np.zeros((len(ids), rounds), np.int64)
            codes = codes * rounds + np.arange(rounds)
            yield pa.RecordBatch.from_arrays([pa.array(codes.ravel(), pa.int64()), pa.array(np.repeat(ids, rounds), pa.int64())],
                                             names=["plane", "node"])

    coded = stage(nodes.select("node", "code").mapInArrow(hash_planes, "plane long, node long"), "cells")
    parts = coded.groupBy("plane").agg(F.greatest(F.lit(1), F.round(F.count("*") / CELL)).cast("long").alias("parts"))
    return coded.join(parts.hint("merge"), "plane").select(
        F.xxhash64("plane", F.pmod(F.xxhash64("node", "plane"), F.col("parts"))).alias("cell"), "node")


def _gathered(chosen: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """(them) of each group: chosen (key, node, fresh) with the nodes' codes and floors."""
    return (chosen.join(known.hint("merge"), "node").groupBy(key)
            .agg(F.collect_list(F.struct(*MEMBER)).alias("them")))


def build(df: DataFrame, id_col: str, vector: str, k: int) -> Graph:
    kind = "<f4" if df.schema[vector].dataType.elementType.simpleString() == "float" else "<f8"
    rows = stage(usable(df, id_col, vector).distinct(), "vectors")
    named = rows.groupBy("vec").agg(F.min("vec_id").alias("node"))

    def shorten(batches):
        for batch in batches:
            vectors = np.frombuffer(b"".join(batch.column("vec").to_pylist()), kind).astype(np.float64)
            codes = encode(vectors.reshape(batch.num_rows, -1)) if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("vec"), pa.array(codes, pa.binary())],
                                             names=["node", "vec", "code"])

    nodes = stage(named.select("node", "vec").mapInArrow(shorten, "node long, vec binary, code binary"), "nodes")
    order = Window.partitionBy("vec").orderBy("vec_id")
    first = rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1)
    members = stage(first.join(nodes.select("node", "vec").hint("merge"), "vec").select("node", "vec_id"), "members")
    everyone = nodes.select("node", "code", F.lit(float("-inf")).alias("floor"))
    start = _gathered(cells(nodes, nodes.count()).withColumn("fresh", F.lit(True)), everyone, "cell")
    entries = local_join(start, FIRST, 16).withColumn("fresh", F.lit(True))
    edges = stage(best_lists(entries, "node", "fresh", F.min, NEIGHBOURS), "edges")
    turn = 0
    while _fresh_share(edges) >= CHANGED:
        edges, turn = stage(improve(nodes, edges, turn), "edges"), turn + 1
    return Graph(nodes, members, edges, kind)


def _fresh_share(edges: DataFrame) -> float:
    fresh = F.size(F.filter("near", lambda e: e.fresh))
    row = edges.agg(F.sum(fresh), F.sum(F.size("near"))).first()
    return row[0] / row[1] if row[1] else 0.0


def improve(nodes: DataFrame, edges: DataFrame, turn: int) -> DataFrame:
    """One round: neighbours of a node, and nodes it is a neighbour of, meet each other."""
    fresh = F.slice(F.filter("near", lambda e: e.fresh), 1, MEET)
    known = F.slice(F.filter("near", lambda e: ~e.fresh), 1, KNOWN)
    chosen = edges.select("node", F.explode(F.concat(fresh, known)).alias("e")).select("node", "e.nb", "e.fresh")
    rank = Window.partitionBy("nb", "fresh").orderBy(F.xxhash64("node", F.lit(turn)), "node")
    back = chosen.withColumn("n", F.row_number().over(rank)).where(F.col("n") <= F.when(F.col("fresh"), MEET).otherwise(KNOWN))
    joined = (chosen.select(F.col("node").alias("at"), F.col("nb").alias("node"), "fresh")
              .unionByName(back.select(F.col("nb").alias("at"), "node", "fresh")))
    floors = edges.select("node", F.when(F.size("near") >= NEIGHBOURS, F.element_at("near", -1)["score"]).alias("floor"))
    full = nodes.select("node", "code").join(floors.hint("merge"), "node", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
    found = local_join(_gathered(joined, full, "at"), EACH, 128).withColumn("fresh", F.lit(True))
    taken = F.transform(fresh, lambda e: e.nb)
    old = edges.select("node", taken.alias("taken"), F.explode("near").alias("e")).select(
        "node", "e.nb", "e.score", (F.col("e.fresh") & ~F.array_contains("taken", F.col("e.nb"))).alias("fresh"))
    return best_lists(old.unionByName(found), "node", "fresh", F.min, NEIGHBOURS)


def _lists_with_codes(graph: Graph) -> str:
    """Catalog table (node, nbs, codes), bucketed by node: what opening a node reads."""
    spark = graph.nodes.sparkSession
    ends = graph.edges.select("node", F.explode("near.nb").alias("nb"))
    coded = ends.join(graph.nodes.select(F.col("node").alias("nb"), "code").hint("merge"), "nb")
    n, name = shuffle_partitions(spark), f"lists_{uuid.uuid4().hex}"
    lists = coded.repartition(n, "node").groupBy("node").agg(F.collect_list(F.struct("nb", "code")).alias("them"))
    (lists.write.format("parquet").option("path", new_path(spark, "lists")).bucketBy(n, "node").sortBy("node").saveAsTable(name))
    return name


def search(graph: Graph, queries: DataFrame, k: int) -> DataFrame:
    """(q, nb): the best nodes of each query node (q, code), found by greedy search."""
    # a fixed number of rows
    pool = graph.nodes.select("node", "code").orderBy(F.xxhash64("node"), "node").limit(POOL).collect()
    pool_ids, pool_codes = [r.node for r in pool], [bytes(r.code) for r in pool]

    def enter(batches):
        ids, (scales, x) = np.array(pool_ids, np.int64), decode(pa.array(pool_codes, pa.binary()))
        for batch in batches:
            if not batch.num_rows:
                continue
            mine, y = decode(batch.column("code"))
            scores = (y @ x.T) * (mine[:, None] * scales[None])
            q = _long(batch.column("q"))
            n = min(ENTRIES, len(ids))
            best = np.argpartition(-scores, n - 1, axis=1)[:, :n]
            parts = [(np.repeat(q, n), ids[best].ravel(), np.take_along_axis(scores, best, axis=1).ravel()),
                     (q, q, (y * y).sum(axis=1) * (mine * mine))]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts)], names=["q", "nb", "score"])

    def judge(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, 1_024):
                batch = whole.slice(start, 1_024)
                lists = batch.column("them")
                flat = lists.flatten()
                if not len(flat):
                    continue
                row, _ = _rows(lists)
                (mine, y), (scales, x) = decode(batch.column("code")), decode(flat.field("code"))
                scores = np.einsum("ij,ij->i", x, y[row]) * (scales * mine[row])
                keep = scores > _long(batch.column("floor"))[row]
                yield pa.RecordBatch.from_arrays([pa.array(_long(batch.column("q"))[row][keep]), pa.array(_long(flat.field("nb"))[keep]),
                                                  pa.array(scores[keep])], names=["q", "nb", "score"])

    spark, name = graph.nodes.sparkSession, _lists_with_codes(graph)
    lists = spark.table(name).withColumnRenamed("node", "open")
    asked = stage(queries.select("q", "code"), "queries")
    start = asked.mapInArrow(enter, "q long, nb long, score double").withColumn("opened", F.lit(False))
    state = stage(best_lists(start, "q", "opened", F.max, WIDTH), "found")
    waiting = F.exists("near", lambda e: ~e.opened)
    settled = []
    while True:
        settled.append(state.where(~waiting))
        going = state.where(waiting)
        if going.isEmpty():
            break
        going = going.withColumn("now", F.slice(F.transform(F.filter("near", lambda e: ~e.opened), lambda e: e.nb), 1, OPEN))
        # a node that falls out has `WIDTH` better ones, and is not let in again
        floor = F.when(F.size("near") >= WIDTH, F.element_at("near", -1)["score"]).otherwise(F.lit(float("-inf")))
        wanted = going.join(asked.hint("merge"), "q").select("q", "code", floor.alias("floor"), F.explode("now").alias("open"))
        fresh = (wanted.join(lists.hint("merge"), "open").select("q", "code", "floor", "them")
                 .mapInArrow(judge, "q long, nb long, score double").withColumn("opened", F.lit(False)))
        known = going.select("q", "now", F.explode("near").alias("e")).select(
            "q", "e.nb", "e.score", (F.col("e.opened") | F.array_contains("now", F.col("e.nb"))).alias("opened"))
        state = stage(best_lists(known.unionByName(fresh), "q", "opened", F.max, WIDTH), "found")
    spark.sql(f"DROP TABLE {name}")
    best = reduce(DataFrame.unionByName, settled).select("q", F.slice("near.nb", 1, RESCORED * k).alias("nbs"))
    return best.select("q", F.explode("nbs").alias("nb"))


def rescored(found: DataFrame, nodes: DataFrame, kind: str) -> DataFrame:
    """(q, nb, score): inner products of the original vectors, in double precision."""
    def score(batches):
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), kind).astype(np.float64).reshape(batch.num_rows, -1)
                        for c in ("mine", "vec"))
                yield pa.RecordBatch.from_arrays([batch.column("q"), batch.column("nb"), pa.array((a * b).sum(axis=1))],
                                                 names=["q", "nb", "score"])

    vectors = nodes.select(F.col("node").alias("nb"), "vec")
    mine = nodes.select(F.col("node").alias("q"), F.col("vec").alias("mine"))
    return (found.join(vectors.hint("merge"), "nb").join(mine.hint("merge"), "q")
            .select("q", "nb", "mine", "vec").mapInArrow(score, "q long, nb long, score double"))


def nearest(df: DataFrame, queries: Column, id_col: str = "vec_id", vector: str = "embedding", k: int = 20) -> DataFrame:
    """The `k` nearest rows found for every row where `queries` holds: query_id, rank, vec_id, score."""
    graph = build(df, id_col, vector, k)
    wanted = usable(df.where(queries), id_col, vector).distinct()
    places = graph.nodes.select("node", "vec").hint("merge")
    placed = stage(wanted.join(places, "vec").select(F.col("vec_id").alias("query_id"), F.col("node").alias("q")), "asked")
    once = placed.select(F.col("q").alias("node")).distinct().hint("merge")
    asked = graph.nodes.join(once, "node", "left_semi").select(F.col("node").alias("q"), "code")
    found = stage(rescored(search(graph, asked, k), graph.nodes, graph.kind), "scored")
    rows = found.join(graph.members.withColumnRenamed("node", "nb").hint("merge"), "nb").select("q", "vec_id", "score")
    order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    top = rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1).drop("n")
    mine = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (placed.join(top.hint("merge"), "q").where("query_id != vec_id").withColumn("rank", F.row_number().over(mine))
            .where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
