"""Arrow tables as compressed messages in a binary column."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa


def pack(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def unpack(message: pa.BinaryScalar) -> Iterator[pa.RecordBatch]:
    with pa.ipc.open_stream(message.as_buffer()) as stored:
        yield from stored
