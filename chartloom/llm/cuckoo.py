"""Exact duplicates with a cuckoo-filter index of live digests.

Texts are equal if they are identical after every run of white space (0x20, 0x09-0x0D) becomes one
space; a digest is the SHA-256 of that form. Digests are dealt into shards of the hash range. A shard
has a cuckoo filter (buckets of four 16-bit fingerprints, partial-key hashing) and the stored content:
the live digests with their smallest id and number of rows (`entries`), and the id of every live row
(`stored`), which only deletion reads.

A batch is reduced to distinct digests before it is dealt, so a text that a third of all rows share
is one key. A filter miss is new for certain and opens an entry without a look at the stored ones. A
hit is only a suspicion: it joins the entry of its full digest, or opens one where there is none. A
filter that cannot place a fingerprint is rebuilt with twice the buckets from its shard's entries.
Deleting removes stored rows, makes the entries of their digests anew from the rows left, and removes
the fingerprint of a digest once its last row is gone.

Defined results: a null text counts as empty; the row that stays has the smallest id of its group, rows
with a null id stay only where no other row has an id; rows repeating the kept id are all kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from chartloom.llm.store import stage

SLOTS = 4
KICKS = 500
FILL = 0.9
KEYS_PER_SHARD = 500_000
FILTER = "shard int, log2 int, n long, slots binary"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def digest(text: Column) -> Column:
    return F.sha2(normalised(text), 256)


class CuckooFilter:
    """Fingerprints of digests; `insert` says False when it is too full."""

    def __init__(self, log2: int, slots: np.ndarray | None = None, n: int = 0):
        self.log2, self.n, self.mask = log2, n, (1 << log2) - 1
        self.slots = (np.zeros(SLOTS << log2, np.uint16) if slots is None else slots).tolist()

    @classmethod
    def sized(cls, keys: int) -> CuckooFilter:
        return cls(max(2, int(np.ceil(np.log2(max(1, keys / (SLOTS * FILL)))))))

    def _places(self, key: str) -> tuple[int, int, int]:
        print_ = int(key[:4], 16) or 1
        first = int(key[16:32], 16) & self.mask
        return print_, first, self._other(first, print_)

    def _other(self, bucket: int, print_: int) -> int:
        return bucket ^ ((print_ * 0x5BD1E995 >> 7) & self.mask)

    def _find(self, bucket: int, print_: int) -> int:
        for at in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
            if self.slots[at] == print_:
                return at
        return -1

    def __contains__(self, key: str) -> bool:
        print_, one, two = self._places(key)
        return self._find(one, print_) >= 0 or self._find(two, print_) >= 0

    def insert(self, key: str) -> bool:
        print_, one, two = self._places(key)
        for bucket in (one, two):
            free = self._find(bucket, 0)
            if free >= 0:
                self.slots[free] = print_
                self.n += 1
                return True
        bucket = two
        for kick in range(KICKS):
            at = bucket * SLOTS + (print_ + kick) % SLOTS
            self.slots[at], print_ = print_, self.slots[at]
            bucket = self._other(bucket, print_)
            free = self._find(bucket, 0)
            if free >= 0:
                self.slots[free] = print_
                self.n += 1
                return True
        return False

    def delete(self, key: str) -> bool:
        """Only for keys known to be stored: another key may share the fingerprint."""
        print_, one, two = self._places(key)
        for bucket in (one, two):
            at = self._find(bucket, print_)
            if at >= 0:
                self.slots[at] = 0
                self.n -= 1
                return True
        return False

    def row(self, shard: int) -> pa.Table:
        return _filter_rows([(shard, self.log2, self.n, np.array(self.slots, np.uint16).tobytes())])


def _filter_rows(rows: list[tuple]) -> pa.Table:
    kinds = [("shard", pa.int32()), ("log2", pa.int32()), ("n", pa.int64()), ("slots", pa.binary())]
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(kinds)], [n for n, _ in kinds])


def _load(table: pa.Table) -> CuckooFilter | None:
    if not table.num_rows:
        return None
    row = table.to_pylist()[0]
    return CuckooFilter(row["log2"], np.frombuffer(row["slots"], np.uint16), row["n"])


def build(keys: DataFrame) -> DataFrame:
    """Filters of (shard, digest) keys, each sized for its keys and doubled until all are placed."""
    def make(table: pa.Table) -> pa.Table:
        names = table.column("digest").to_pylist()
        made = CuckooFilter.sized(len(names))
        while not all(made.insert(k) for k in names):
            made = CuckooFilter(made.log2 + 1)
        return made.row(table.column("shard")[0].as_py())
    return keys.groupBy("shard").applyInArrow(make, FILTER)


class CuckooIndex:
    """`entries` is (shard, digest, keep_id, group_size), one row per live digest; `stored` (shard, digest, id),
    one per live row; `filters` one per shard."""

    def __init__(self, entries: DataFrame, stored: DataFrame, filters: DataFrame, shards: int):
        self.entries, self.stored, self.filters, self.shards = entries, stored, filters, shards

    @classmethod
    def empty(cls, spark: SparkSession, id_type: str, expected: int) -> CuckooIndex:
        shards = 1 << max(4, int(np.ceil(np.log2(max(1, expected / KEYS_PER_SHARD)))))
        return cls(spark.createDataFrame([], f"shard int, digest string, keep_id {id_type}, group_size long"),
                   spark.createDataFrame([], f"shard int, digest string, id {id_type}"),
                   spark.createDataFrame([], FILTER), shards)

    def _dealt(self, rows: DataFrame) -> DataFrame:
        return rows.select(F.pmod(F.xxhash64("digest"), F.lit(self.shards)).cast("int").alias("shard"), "digest", "id")

    def probe(self, keys: DataFrame) -> DataFrame:
        """(shard, digest, hit) of distinct keys."""
        def look(filters: pa.Table, table: pa.Table) -> pa.Table:
            known = _load(filters)
            hits = [known is not None and k in known for k in table.column("digest").to_pylist()]
            return table.select(["shard", "digest"]).append_column("hit", pa.array(hits, pa.bool_()))
        return (self.filters.groupBy("shard").cogroup(keys.select("shard", "digest").groupBy("shard"))
                .applyInArrow(look, "shard int, digest string, hit boolean"))

    def insert(self, rows: DataFrame) -> CuckooIndex:
        """The index with the rows (digest, id) of one batch added."""
        rows = stage(self._dealt(rows), "batch")
        batch = stage(_summed(rows), "arrivals")
        arrivals = stage(batch.join(self.probe(batch), ["shard", "digest"]), "probed")
        at = ["shard", "digest"]
        hits = arrivals.where("hit").select(*at, F.col("keep_id").alias("came"), F.col("group_size").alias("more"))
        joined = self.entries.join(hits, at, "full_outer").select(
            *at, F.least("keep_id", "came").alias("keep_id"),
            (F.coalesce("group_size", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("group_size"),
            F.col("group_size").isNull().alias("fresh"))
        opened = arrivals.where("NOT hit").select(*at, "keep_id", "group_size", F.lit(True).alias("fresh"))
        marked = stage(joined.unionByName(opened), "entries")
        entries, fresh = marked.drop("fresh"), marked.where("fresh").select(*at)

        def add(filters: pa.Table, table: pa.Table) -> pa.Table:
            names = table.column("digest").to_pylist()
            known = _load(filters) or CuckooFilter.sized(len(names))
            if all(known.insert(k) for k in names):
                return known.row((filters if filters.num_rows else table).column("shard")[0].as_py())
            return _filter_rows([(table.column("shard")[0].as_py(), -1, 0, b"")])      # overflow

        added = stage(self.filters.groupBy("shard").cogroup(fresh.groupBy("shard")).applyInArrow(add, FILTER), "filters")
        rebuilt = build(entries.join(added.where("log2 < 0").select("shard"), "shard", "left_semi").select(*at))
        return CuckooIndex(entries, self.stored.unionByName(rows),
                           stage(added.where("log2 >= 0").unionByName(rebuilt), "filters"), self.shards)

    def delete(self, rows: DataFrame) -> CuckooIndex:
        """The index without the stored rows that equal one of (digest, id); others are ignored."""
        gone = self._dealt(rows).select("shard", "digest", "id").distinct()
        same = [self.stored["shard"] == gone["shard"], self.stored["digest"] == gone["digest"],
                self.stored["id"].eqNullSafe(gone["id"])]
        stored = stage(self.stored.join(gone, same, "left_anti"), "stored")
        at = ["shard", "digest"]
        touched = stage(gone.select(*at).distinct().join(self.entries.select(*at), at, "left_semi"), "touched")
        left = stage(_summed(stored.join(touched, at, "left_semi")), "left")
        entries = stage(self.entries.join(touched, at, "left_anti").unionByName(left), "entries")
        dead = touched.join(left.select(*at), at, "left_anti")

        def drop(filters: pa.Table, table: pa.Table) -> pa.Table:
            known = _load(filters)
            for key in table.column("digest").to_pylist():
                known.delete(key)
            return known.row(filters.column("shard")[0].as_py())

        filters = self.filters.groupBy("shard").cogroup(dead.groupBy("shard")).applyInArrow(drop, FILTER)
        return CuckooIndex(entries, stored, stage(filters, "filters"), self.shards)

    def groups(self) -> DataFrame:
        """(digest, keep_id, group_size) of the live digests."""
        return self.entries.select("digest", "keep_id", "group_size")


def _summed(rows: DataFrame) -> DataFrame:
    """(shard, digest, id) rows as one entry per digest: partial sums leave the tasks."""
    return rows.groupBy("shard", "digest").agg(F.min("id").alias("keep_id"), F.count("*").alias("group_size"))


def exact_duplicates(df: DataFrame, id_col: str = "doc_id", text: str = "text", arrivals: int = 2) -> DataFrame:
    """Per row: doc_id, content (hash of the text as it is), keep_id, group_size, kept, text_sha256.

    The rows reach the index in `arrivals` batches, as a growing corpus would.
    """
    rows = stage(df.select(F.col(f"`{id_col}`").alias("id"), digest(F.col(f"`{text}`")).alias("digest"),
                           F.xxhash64(F.col(f"`{text}`")).alias("content")), "digests")
    index = CuckooIndex.empty(df.sparkSession, df.schema[id_col].dataType.simpleString(), rows.count())
    for turn in range(arrivals):
        index = index.insert(rows.where(F.pmod(F.xxhash64("id"), F.lit(arrivals)) == turn))
    # the entries are a stage table: a join of two plain tables can split a digest that very many rows share
    out = rows.join(index.groups(), "digest")
    return out.select(F.col("id").alias("doc_id"), "content", "keep_id", "group_size",
                      F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256"))
