"""Stage tables in the folder all executors share, and the chunk store that several passes read.

A chunk is a run of whole rows (about `chunk_bytes` of text, one row at least) kept as one compressed
Arrow message. Passes exchange small messages keyed by chunk, so the rows themselves are written once
and, because the store is bucketed by chunk, never shuffled again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from chartloom.sources.checkpoints import checkpoint_dir

CHUNK_BYTES = 16 << 20
CODEC = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))


_held: dict[str, Callable[[], object]] = {}


def claim_worker(name: str, clear: Callable[[], object] | None = None) -> None:
    """Python workers outlive their tasks and serve several operators: whoever starts in one empties the
    tables that others have left in it. `clear` empties the caller's own, later."""
    for other in [k for k in _held if k != name]:
        _held.pop(other)()
    if clear:
        _held[name] = clear


def new_path(spark: SparkSession, kind: str) -> str:
    """An unused path in the shared folder (`spark.checkpoint.dir`)."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def stage(df: DataFrame, kind: str) -> DataFrame:
    """Write a table to the shared folder and read it again: cuts lineage, keeps column pruning."""
    path = new_path(df.sparkSession, kind)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def row_slices(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges whose sizes sum to `limit` at most; a larger row is a range by itself."""
    ends = np.cumsum(sizes, dtype=np.int64)
    start = 0
    while start < len(sizes):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield start, stop
        start = stop


def pack_message(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=CODEC) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpack_message(blob) -> pa.RecordBatch:
    with pa.ipc.open_stream(pa.py_buffer(blob)) as reader:
        return reader.read_next_batch()


def binary_sizes(column: pa.Array) -> np.ndarray:
    """Bytes of each value of a string column; nulls are 0."""
    import pyarrow.compute as pc
    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def chunk_store(df: DataFrame, text: str, kind: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """All columns of `df` as a table (chunk long, n_bytes long, blob binary), bucketed by chunk.

    Chunk numbers are (partition << 32 | counter): unique within the written table, which is what
    every later pass reads.
    """
    spark = df.sparkSession

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            at = batch.schema.get_field_index(text)
            sizes = binary_sizes(batch.column(at))
            for start, stop in row_slices(sizes + 64, chunk_bytes):
                blob = pack_message(batch.slice(start, stop - start))
                yield pa.RecordBatch.from_pydict(
                    {"chunk": [number], "n_bytes": [int(sizes[start:stop].sum())], "blob": [blob]},
                    schema=pa.schema([("chunk", pa.int64()), ("n_bytes", pa.int64()), ("blob", pa.binary())]))
                number += 1

    chunks = df.mapInArrow(pack, "chunk long, n_bytes long, blob binary")
    name = f"chunks_{uuid.uuid4().hex}"
    (chunks.write.format("parquet").option("path", new_path(spark, kind)).option("compression", "uncompressed")
     .bucketBy(shuffle_partitions(spark), "chunk").saveAsTable(name))
    return spark.table(name)


def answer_chunks(chunks: DataFrame, answers: DataFrame, work: Callable, schema: str | StructType) -> DataFrame:
    """`work(rows, answers)` for every chunk: its rows and its (shard, payload) answers, maybe none.

    `answers` is (chunk, shard, payload); each chunk gets one payload per shard at most.
    """
    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(schema)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows:
            claim_worker("chunks")
            found = dict(zip(right.column("shard").to_pylist(), right.column("payload").to_pylist()))
            chunk = left.column("chunk")[0].as_py()
            for message in work(chunk, unpack_message(left.column("blob")[0].as_buffer()), found):
                out.append(message.cast(arrow) if message.schema != arrow else message)
        pa.default_memory_pool().release_unused()
        return pa.Table.from_batches(out, schema=arrow)

    return (chunks.groupBy("chunk").cogroup(answers.groupBy("chunk"))
            .applyInArrow(run, schema))


def planes(numbers: np.ndarray) -> bytes:
    """8-byte numbers, first bytes first: the high bytes of small ones become runs that compress to nothing."""
    return np.ascontiguousarray(numbers.ravel()).view(np.uint8).reshape(-1, 8).T.tobytes()


def unplanes(data, kind) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(kind).ravel()


def ordered_planes(keys: np.ndarray) -> bytes:
    """Sorted 8-byte keys as the planes of their differences."""
    return planes(np.diff(keys, prepend=np.uint64(0)))


def ordered_unplanes(data) -> np.ndarray:
    return np.cumsum(unplanes(data, np.uint64), dtype=np.uint64)


def shard_count(chunks: DataFrame, per_shard: int) -> int:
    """A power of two, so that a shard gets about `per_shard` entries if each 6 bytes make one."""
    from pyspark.sql import functions as F
    total = chunks.agg(F.sum("n_bytes")).first()[0] or 0
    return 1 << max(3, int(np.ceil(np.log2(max(1, total / 6 / per_shard)))))
