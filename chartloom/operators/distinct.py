"""Every term, or run of terms, of a table once.

A task makes its terms numbers, chunk by chunk, and puts the different runs of a chunk in order. Each shard of the runs' hash
range gets one message per chunk: the terms it needs and the runs as numbers of these. A shard's task brings the numbers of
its messages together. Texts of runs exist only where they are returned.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from chartloom.functions.messages import pack, unpack

CHUNK_TERMS = 4_000_000   # terms of a chunk; a longer row is a chunk by itself
OUT = 100_000             # texts of a returned batch
SEPARATOR = " "
SPREAD = 256
FACTOR = np.uint64(0x9E3779B97F4A7C15)


def different(columns: list[np.ndarray], base: int) -> list[np.ndarray]:
    """The different lines of numbers under `base`, in order. Lines come and go column by column."""
    code, shortened = columns[0].astype(np.int64), []
    for column in columns[1:]:
        values = None
        if len(code) and int(code.max()) >= 2**62 // base:
            values, code = np.unique(code, return_inverse=True)
        shortened.append(values)
        code = code * base + column
    code.sort()
    code, out = code[np.diff(code, prepend=-1) != 0], []
    for values in reversed(shortened):
        code, column = np.divmod(code, base)
        out.append(column)
        code = code if values is None else values[code]
    return [code, *reversed(out)]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """The different terms of a chunk of whole rows, the number of each term, and its row."""
    held, lengths, total = [], [], 0

    def coded() -> tuple[pa.Array, np.ndarray, np.ndarray]:
        terms, sizes = pa.concat_arrays(held).dictionary_encode(null_encoding="encode"), np.concatenate(lengths)
        return terms.dictionary, terms.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(np.arange(len(sizes)), sizes)
    for batch in batches:
        sizes = np.nan_to_num(batch.column(0).value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
        ends, flat, start = np.cumsum(sizes), batch.column(0).flatten(), 0
        while start < len(sizes):
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + CHUNK_TERMS - total, side="right")))
            held.append(flat.slice(before, ends[stop - 1] - before))
            lengths.append(sizes[start:stop])
            total, start = total + int(ends[stop - 1] - before), stop
            if total >= CHUNK_TERMS:
                yield coded()
                held, lengths, total = [], [], 0
    if total:
        yield coded()


def _runs(document: np.ndarray, terms: np.ndarray, n: int, base: int) -> list[np.ndarray]:
    """The different runs of `n` terms that lie in one row."""
    last = max(0, len(terms) - n + 1)
    inside = np.flatnonzero(document[n - 1:] == document[:last])
    return different([terms[inside + k] for k in range(n)], base)


def _keys(names: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Of each term a hash, and a number that orders terms by length, then hash: the same in every chunk."""
    texts = [x or "" for x in names.to_pylist()]
    hashed = np.array([zlib.crc32(x.encode()) for x in texts], dtype=np.int64)
    return hashed, (np.array([len(x) for x in texts], dtype=np.int64) << 32) + hashed


def _shards(hashed: np.ndarray, key: np.ndarray, columns: list[np.ndarray], shards: int) -> np.ndarray:
    """The shard of each run, by its terms.

    Runs go by their longest term, so that a rare term, which is long as a rule, is a name in few messages. With many shards
    the other terms deal a term's runs over one shard in `SPREAD`.
    """
    longest, every = key[columns[0]], hashed[columns[0]].astype(np.uint64)
    for column in columns[1:]:
        longest, every = np.maximum(longest, key[column]), (every + hashed[column].astype(np.uint64)) * FACTOR
    at = ((longest & 0xFFFFFFFF).astype(np.uint64) * FACTOR) >> np.uint64(33)
    shard = (at + ((every * FACTOR) >> np.uint64(33)) % np.uint64(max(1, shards // SPREAD))) % np.uint64(shards)
    return shard.astype(np.uint16 if shards < 2**16 else np.int64)


def _message(names: pa.Array, runs: list[list[np.ndarray]]) -> bytes:
    """The names that are needed, and the bytes of the numbers for each place of the runs of each length, low bytes first; the
    first place as differences."""
    number = np.zeros(len(names), np.int64)
    for columns in runs:
        for c in columns:
            number[c] = 1
    needed = np.flatnonzero(number)
    number[needed] = np.arange(len(needed))
    listed = [names.take(pa.array(needed))]
    for columns in runs:
        for c in (np.diff(number[columns[0]], prepend=0), *(number[c] for c in columns[1:])):
            listed += [pa.array((c >> 8 * k).astype(np.uint8)) for k in range((len(needed).bit_length() + 7) // 8)]
    listed = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in listed]
    return pack(pa.table(listed, names=[str(i) for i in range(len(listed))]))


def _opened(part: pa.RecordBatch, high: int) -> tuple[pa.Array, list[list[np.ndarray]]]:
    """What `_message` was given, in numbers of the names it holds."""
    listed = [part.column(i)[0].values for i in range(part.num_columns)]
    deep, at, runs = (len(listed) - 1) * 2 // (high * (high + 1)), 1, []
    for n in range(1, high + 1):
        columns = []
        for _ in range(n):
            columns.append(sum(c.to_numpy().astype(np.int64) << 8 * k for k, c in enumerate(listed[at:at + deep])))
            at += deep
        runs.append([np.cumsum(columns[0]), *columns[1:]])
    return listed[0], runs


def _sent(df: DataFrame, high: int, shards: int) -> DataFrame:
    """(shard, message) of the different runs of each chunk."""
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, terms, document in _chunks(batches):
            dealt, keys = [], _keys(names)
            for n in range(1, high + 1):
                runs = _runs(document, terms, n, len(names))
                shard = _shards(*keys, runs, shards)
                order = np.argsort(shard, kind="stable")              # inside a shard the runs stay in order
                dealt.append(([c[order] for c in runs], np.searchsorted(shard[order], np.arange(shards + 1))))
            for k in range(shards):
                mine = [[c[ends[k]:ends[k + 1]] for c in runs] for runs, ends in dealt]
                if any(len(columns[0]) for columns in mine):
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([_message(names, mine)], pa.binary())],
                                                     names=["shard", "message"])
    return df.mapInArrow(send, "shard int, message binary")


def distinct_runs(df: DataFrame, high: int, shards: int) -> DataFrame:
    """(term): every run of 1..high terms of a row, as a text, once. `df` has one column, the terms of a row in order."""
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, runs, known = [], [[[] for _ in range(n)] for n in range(1, high + 1)], 0
        for batch in batches:
            for message in batch.column(0):
                for part in unpack(message):
                    held, lines = _opened(part, high)
                    for columns, line in zip(runs, lines):
                        for column, c in zip(columns, line):
                            column.append((c + known).astype(np.uint32))
                    names.append(held)
                    known += len(held)
        if not names:
            return
        terms = pa.concat_arrays(names).dictionary_encode(null_encoding="encode")
        number, names = terms.indices.to_numpy(zero_copy_only=False), terms.dictionary
        for columns in runs:
            found = different([number[np.concatenate(c)] for c in columns], len(names))
            columns.clear()
            for start in range(0, len(found[0]), OUT):
                texts = [names.take(pa.array(c[start:start + OUT])) for c in found]
                joined = texts[0] if len(texts) == 1 else pc.binary_join_element_wise(*texts, SEPARATOR)
                yield pa.RecordBatch.from_arrays([joined], names=["term"])

    sent = _sent(df, high, shards).repartitionById(shards, "shard")
    return sent.select("message").mapInArrow(merge, "term string")
