"""Near-duplicate groups by HyperMinHash sketches, and exact verification of every candidate link.

A row's set is its distinct shingles of `SHINGLE` lower-cased words (A-Z only), each as a 64-bit
fingerprint. The fingerprint's first 8 bits choose one of 256 registers; a register keeps the least
remainder as leading-zero count and 10 mantissa bits, 16 bits in all. 32 bands of four registers are the
candidate keys, an empty register standing for a full one that a fixed sequence leads to: without that
a short text's band could hang on one shingle. At similarity 0.75 a link is missed with probability
(1 - 0.75^4)^32 = 5e-6, and more similar ones practically never.

Rows with the same word sequence are one node beforehand, whatever their number. Among nodes that
share a band key, the one with the most company is the key's pivot, and every member is compared with
it: a key costs as many pairs as it has members. Keys whose members are then not yet in one component
go round again with the next pivot. After `PIVOT_ROUNDS` the members outside a key's largest component
meet all its members in blocks of `BLOCK`, in numpy, and only pairs that the registers do not rule out
leave the task. So every two members of a key are either compared or already in one component, and no
link between different components is lost. Wherever registers judge a pair, the expected number of
chance collisions is taken off, and only pairs clearly below the threshold (four standard errors) are
dropped; all others are confirmed on their full sets.

Defined results: null or blank text has an empty set and is linked with nothing; fewer than five words
are one shingle; a row whose id is null takes part, but never names a component unless no member has an
id; rows that repeat an id are all returned.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from chartloom.llm.components import components
from chartloom.llm.store import claim_worker, stage
from chartloom.llm.words import LOWER, STEP, mix, rolling, views, word_hashes, word_spans

SHINGLE = 5
REGISTERS = 256
BANDS = 32
PER_BAND = 4
BLOCK = 256
MANTISSA = 10
PIVOT_ROUNDS = 3
# chance that two registers of unrelated sets agree, times 2^MANTISSA / REGISTERS (published constant)
COLLISIONS = 0.169919487159739093975315012348

SKETCH = "doc_id {id}, content long, node binary, n_shingles long, registers binary"


def shingle_sets(text: pa.Array):
    """(row, lower-cased bytes, sorted distinct fingerprints) of each row."""
    for start, stop, data, offsets in views(text):
        data = LOWER[data]
        starts, ends, first = word_spans(data, offsets)
        words = word_hashes(data, starts, ends)
        runs = rolling(words, SHINGLE)
        for i in range(stop - start):
            a, b = first[i], first[i + 1]
            if b - a >= SHINGLE:
                prints = np.unique(runs[a:b - SHINGLE + 1])
            else:
                prints = rolling(words[a:b], b - a) if b > a else np.zeros(0, np.uint64)
            yield start + i, data[offsets[i]:offsets[i + 1]], prints


def registers(prints: np.ndarray) -> np.ndarray:
    """16-bit registers of sorted distinct fingerprints; 0 is empty."""
    out = np.zeros(REGISTERS, dtype=np.uint16)
    if not len(prints):
        return out
    bucket = prints >> np.uint64(56)
    at = np.searchsorted(bucket, np.arange(REGISTERS, dtype=np.uint64))
    at[at == len(prints)] = 0
    used = bucket[at] == np.arange(REGISTERS, dtype=np.uint64)
    rest = ((prints[at] & np.uint64((1 << 56) - 1)) >> np.uint64(4)).astype(np.int64)
    length = np.frexp(rest.astype(np.float64))[1].astype(np.int64)          # 52 bits are exact in a double
    shift = length - 1 - MANTISSA
    mantissa = np.where(shift >= 0, rest >> np.maximum(shift, 0), rest << np.maximum(-shift, 0)) & ((1 << MANTISSA) - 1)
    out[used] = ((52 - length) * (1 << MANTISSA) + mantissa + 1)[used]
    return out


def _donors() -> np.ndarray:
    """For each register that bands use, the registers to look at in turn, itself first."""
    rng = np.random.default_rng(20)
    return np.array([[i, *rng.permutation(np.delete(np.arange(REGISTERS), i))] for i in range(BANDS * PER_BAND)])


DONORS = _donors()


def bands(regs: np.ndarray) -> np.ndarray:
    """Band keys (rows x BANDS) of register rows with at least one full register."""
    full = regs[:, DONORS] != 0
    donor = DONORS[np.arange(len(DONORS)), full.argmax(axis=2)]
    values = np.take_along_axis(regs, donor, axis=1)
    packed = np.ascontiguousarray(values).view(np.uint64)
    return mix(packed * STEP + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def likely(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of register rows (with their set sizes) the estimate does not rule out.

    Equal registers less the expected chance collisions, over the registers full in either, estimate
    the similarity; the standard error at the threshold is that of drawing this many shingles, without
    return, from a union of the size the threshold implies.
    """
    either = np.count_nonzero((a != 0) | (b != 0), axis=1)
    same = np.count_nonzero((a == b) & (a != 0), axis=1)
    big, little = np.maximum(n_a, n_b), np.maximum(1, np.minimum(n_a, n_b))
    ratio = big / little
    chance = COLLISIONS * REGISTERS / 2 ** MANTISSA * 4 * ratio / (1 + ratio) ** 2
    bar = percent / 100
    union = np.maximum((n_a + n_b) / (1 + bar), 2.0)
    error = np.sqrt(bar * (1 - bar) / np.maximum(either, 1) * np.clip((union - either) / (union - 1), 0.02, 1))
    return ((same - chance) / np.maximum(either, 1) >= bar - 4 * error - 0.01) & (100 * little >= percent * big)


def node_of(lowered: np.ndarray) -> bytes:
    return hashlib.md5(b" ".join(lowered.tobytes().split())).digest()


def sketches(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """doc_id, content (hash of the text as it is), node (md5 of the word sequence), n_shingles, registers."""
    id_type = df.schema[id_col].dataType.simpleString()

    def sketch(batches):
        claim_worker("sketch")
        for batch in batches:
            nodes, sizes, regs = [], [], []
            for _, lowered, prints in shingle_sets(batch.column("text")):
                nodes.append(node_of(lowered))
                sizes.append(len(prints))
                regs.append(registers(prints).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("content"), pa.array(nodes, pa.binary()),
                 pa.array(sizes, pa.int64()), pa.array(regs, pa.binary())],
                names=["doc_id", "content", "node", "n_shingles", "registers"])

    return (df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
            .select("doc_id", "text", F.xxhash64("text").alias("content"))
            .mapInArrow(sketch, SKETCH.format(id=id_type)))


def _matrix(column: pa.Array, kind) -> np.ndarray:
    """One row of numbers per value of a binary column of equal lengths."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1) if len(column) else np.zeros((0, 1), kind)


def band_keys(nodes: DataFrame) -> DataFrame:
    """(key, node): `BANDS` rows per node."""
    def cut(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, 64):
                batch = whole.slice(start, 64)
                keys = bands(_matrix(batch.column("registers"), np.uint16))
                names = batch.column("node").take(pa.array(np.repeat(np.arange(len(keys)), BANDS)))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), names], names=["key", "node"])

    return nodes.select("node", "registers").mapInArrow(cut, "key long, node binary")


def _likely(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs that the register estimate does not rule out."""
    def judge(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                batch = whole.slice(start, 1024)
                size = lambda c: batch.column(c).to_numpy().astype(float)
                keep = likely(_matrix(batch.column("ra"), np.uint16), _matrix(batch.column("rb"), np.uint16),
                              size("na"), size("nb"), percent)
                yield batch.select(["a", "b"]).filter(pa.array(keep))

    side = lambda x: nodes.select(F.col("node").alias(x), F.col("registers").alias("r" + x), F.col("n_shingles").alias("n" + x))
    return (pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ra", "rb", "na", "nb")
            .mapInArrow(judge, "a binary, b binary"))


def blocked_pairs(members: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """(x, y): likely pairs of different components among the members (key, node, c) of each key.

    Members outside the key's largest component meet all members. Both sides come in blocks, each pair
    of blocks in one run of rows, and a pair of nodes counts at the first band the two share.
    """
    sizes = members.groupBy("key", "c").agg(F.count("*").alias("n"))
    keys = sizes.groupBy("key").agg(F.sum("n").alias("all"), F.max(F.struct("n", "c")).alias("main")).select(
        "key", F.ceil(F.col("all") / BLOCK).alias("rows"), F.ceil((F.col("all") - F.col("main.n")) / BLOCK).alias("few"),
        F.col("main.c").alias("main"))
    placed = members.select("key", "node", "c").join(keys, "key").where("few > 0")
    minor = F.col("c") != F.col("main")
    both = F.array(
        F.struct(F.lit(False).alias("asks"), F.expr("sequence(0L, few - 1)").alias("i"), F.expr("array(pmod(xxhash64(node), rows))").alias("j")),
        F.struct(F.lit(True).alias("asks"), F.expr("array(pmod(xxhash64(node, 1), few))").alias("i"), F.expr("sequence(0L, rows - 1)").alias("j")))
    dealt = (placed.withColumn("minor", minor).select("key", "node", "c", "minor", F.explode(both).alias("s"))
             .where("NOT s.asks OR minor").select("key", "node", "c", "minor", "s.asks", F.explode("s.i").alias("i"), "s.j")
             .select("key", "node", "c", "minor", "asks", "i", F.explode("j").alias("j")))
    rows = dealt.join(nodes.select("node", "registers", "n_shingles"), "node")
    cuts = ["key", "i", "j"]

    def meet(key: int, run: pa.Table):
        asks = np.array(run.column("asks").to_pylist())
        regs = _matrix(run.column("registers"), np.uint16)
        keys_, n = bands(regs), run.column("n_shingles").to_numpy().astype(float)
        node, c, minor_ = (np.array(run.column(x).to_pylist(), dtype=object) for x in ("node", "c", "minor"))
        others = np.flatnonzero(~asks)
        xs, ys = [], []
        for x in np.flatnonzero(asks):
            y = others[c[others] != c[x]]
            y = y[~minor_[y].astype(bool) | (node[y] > node[x])]
            if len(y):
                first = (keys_[y] == keys_[x]).argmax(axis=1)
                y = y[keys_[x][first] == key]
            if len(y):
                y = y[likely(np.broadcast_to(regs[x], (len(y), REGISTERS)), regs[y], np.full(len(y), n[x]), n[y], percent)]
            xs += [node[x]] * len(y)
            ys += node[y].tolist()
        return pa.RecordBatch.from_arrays([pa.array(xs, pa.binary()), pa.array(ys, pa.binary())], names=["x", "y"])

    def walk(batches):
        held, at = [], None
        for batch in batches:
            marks = list(zip(*(batch.column(c).to_pylist() for c in cuts)))
            start = 0
            for stop in [i for i in range(1, len(marks)) if marks[i] != marks[i - 1]] + [len(marks)]:
                if start == stop:
                    continue
                if marks[start] != at and held:
                    yield meet(at[0], pa.Table.from_batches(held))
                    held = []
                at = marks[start]
                held.append(batch.slice(start, stop - start))
                start = stop
        if held:
            yield meet(at[0], pa.Table.from_batches(held))

    return rows.repartition(*cuts).sortWithinPartitions(*cuts).mapInArrow(walk, "x binary, y binary")


def _confirmed(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full shingle sets reach the threshold."""
    def confirm(batches):
        claim_worker("sketch")

        @lru_cache(maxsize=256)
        def prints(text: str) -> np.ndarray:
            return next(shingle_sets(pa.array([text], pa.string())))[2]

        for batch in batches:
            keep = []
            for a, b in zip(batch.column("ta").to_pylist(), batch.column("tb").to_pylist()):
                x, y = prints(a), prints(b)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    side = lambda x: texts.select(F.col("node").alias(x), F.col("text").alias("t" + x))
    return (pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ta", "tb")
            .mapInArrow(confirm, "a binary, b binary"))


def node_texts(df: DataFrame, text: str, wanted: DataFrame) -> DataFrame:
    """One text per wanted node."""
    def name(batches):
        for batch in batches:
            nodes = []
            for _, _, data, offsets in views(batch.column("text")):
                data = LOWER[data]
                nodes += [node_of(data[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), batch.column("text")], names=["node", "text"])

    named = df.select(F.col(f"`{text}`").alias("text")).where("text IS NOT NULL").mapInArrow(name, "node binary, text string")
    return named.join(wanted, "node", "left_semi").dropDuplicates(["node"])


def linked_nodes(df: DataFrame, text: str, nodes: DataFrame, percent: int) -> DataFrame:
    """(node, root) of all nodes linked with another; `nodes` is (node, n_shingles, registers)."""
    keys = band_keys(nodes)
    shared = stage(keys.join(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key"), "bands")
    company = shared.groupBy("node").agg(F.sum("n").alias("company"))
    members = shared.join(company, "node").select("key", "node", "company")
    texts = stage(node_texts(df, text, company), "candidates")
    spark = df.sparkSession
    found = spark.createDataFrame([], "node binary, root binary")
    tested = spark.createDataFrame([], "a binary, b binary")
    for turn in range(PIVOT_ROUNDS + 1):
        placed = members.join(found, "node", "left").select("key", "node", "company", F.coalesce("root", "node").alias("c"))
        open_keys = placed.groupBy("key").agg(
            F.min("c").alias("low"), F.max("c").alias("high"),
            F.max(F.struct("company", "node", "c")).alias("pivot")).where("low != high").select("key", "pivot")
        members = stage(placed.join(open_keys, "key"), "members")
        if members.isEmpty():
            break
        if turn < PIVOT_ROUNDS:
            pairs = members.where("c != pivot.c").select(F.col("node").alias("x"), F.col("pivot.node").alias("y"))
        else:
            pairs = blocked_pairs(members, nodes, percent)
        pairs = (pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
                 .join(tested, ["a", "b"], "left_anti"))
        pairs = stage(pairs, "pairs")
        if turn < PIVOT_ROUNDS:
            pairs_left = _likely(pairs, nodes, percent)
        else:
            pairs_left = pairs                                   # the blocks have judged them
        edges = stage(_confirmed(pairs_left, texts, percent), "edges")
        # contract: edges between the components so far, then every node's root by its component's
        ends = (edges.join(found.withColumnsRenamed({"node": "a", "root": "ra"}), "a", "left")
                .join(found.withColumnsRenamed({"node": "b", "root": "rb"}), "b", "left")
                .select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")))
        roots = components(ends)
        moved = found.join(roots.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select(
            "node", F.coalesce("top", "root").alias("root"))
        found = stage(moved.unionByName(roots.join(found, "node", "left_anti")), "roots")
        tested = tested.unionByName(pairs)
        members = members.where(F.col("node") != F.col("pivot.node")).select("key", "node", "company")
    return found


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text: str = "text", percent: int = 75) -> DataFrame:
    """Per row: doc_id, content, n_shingles, component_id, kept (the row that names its component)."""
    return near_groups(df, id_col, text, percent).drop("component")


def near_groups(df: DataFrame, id_col: str = "doc_id", text: str = "text", percent: int = 75) -> DataFrame:
    """`near_duplicates` and component: a binary that tells components apart where ids are null or repeat."""
    known = stage(sketches(df, id_col, text), "sketches")
    grouped = known.where("n_shingles > 0").groupBy("node").agg(
        F.min("doc_id").alias("least"), F.first("n_shingles").alias("n_shingles"), F.first("registers").alias("registers"))
    nodes = stage(grouped, "nodes")
    roots = linked_nodes(df, text, nodes, percent)
    placed = nodes.join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    names = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    named = placed.join(names, "root").select("node", "root", "component_id")
    out = known.join(named, "node", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "content", "n_shingles", component.alias("component_id"),
                      F.col("doc_id").eqNullSafe(component).alias("kept"),
                      F.coalesce("root", F.col("content").cast("string").cast("binary")).alias("component"))
