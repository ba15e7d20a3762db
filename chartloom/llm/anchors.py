"""Removal of repeated passages by fixed-block anchors.

A window is `window` consecutive words of one row. Every word covered by a window whose word sequence
also starts anywhere else, in the same row or another, is removed; windows are judged on the input.

Blocks of half a window, (window + 1) // 2 words, start at every multiple of that length in each row:
any window holds one whole block. The blocks are the index, all rolling runs of block length the
probes. A block that is met by a second run is an anchor hit, and only windows around hits are
extended: their 64-bit fingerprints are counted over the whole corpus, and adjoining windows that
occur again make up the maximal repeats.

Both counts travel as sorted number arrays, one message per (chunk of rows, shard of the hash range),
so a passage that a third of the corpus shares is one number per chunk, a shard holds about
`per_shard` numbers whatever the words are, and no pair of rows is ever formed.

Defined results: a null or blank text has no words and stays null or as it is; rows shorter than a
window lose nothing; two equal rows remove each other's windows (keep one of them beforehand); the
order and number of rows never changes; other columns of any name pass through in `rest`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from chartloom.llm.store import CHUNK_BYTES, answer_chunks, chunk_store, shard_count, unpack_message
from chartloom.llm.words import rolling, views, word_hashes, word_spans

WINDOW = 35
PER_SHARD = 4_000_000
MESSAGE = "shard int, chunk long, probes binary, again binary, blocks binary"
ANSWER = "chunk long, shard int, payload binary"


def wrap(df: DataFrame, text: str) -> DataFrame:
    """(text, rest): the text and one struct of all other columns."""
    others = [F.col(f"`{c}`") for c in df.columns if c != text]
    return df.select(F.col(f"`{text}`").alias("text"), F.struct(*(others or [F.lit(None).alias("none")])).alias("rest"))


class Windows:
    """Fingerprints of one chunk, in row order."""

    def __init__(self, text: pa.Array, window: int, want: bool = False):
        self.block = (window + 1) // 2
        probes, blocks, at, wide, wide_ok, counts = [], [], [], [], [], []
        base = 0
        for start, stop, data, offsets in views(text):
            starts, ends, first = word_spans(data, offsets)
            words = word_hashes(data, starts, ends)
            n = np.diff(first)
            last = np.repeat(first[1:], n)                       # end of the row each word is in
            inside = np.arange(len(words)) - np.repeat(first[:-1], n)
            runs = rolling(words, self.block)
            ok = np.arange(len(runs)) + self.block <= last[:len(runs)]
            aligned = ok & (inside[:len(runs)] % self.block == 0)
            probes.append(runs[ok])
            blocks.append(runs[aligned])
            at.append(np.flatnonzero(aligned) + base)
            if want:
                whole = rolling(words, window)
                fit = np.zeros(len(words), dtype=bool)
                fit[:len(whole)] = np.arange(len(whole)) + window <= last[:len(whole)]
                padded = np.zeros(len(words), dtype=np.uint64)
                padded[:len(whole)] = whole
                wide.append(padded)
                wide_ok.append(fit)
            counts.append(n)
            base += len(words)
        none = np.zeros(0, np.uint64)
        self.n_words = base
        self.probes = np.concatenate(probes or [none])
        self.blocks = np.concatenate(blocks or [none])
        self.block_at = np.concatenate(at or [np.zeros(0, np.int64)])
        self.counts = np.concatenate(counts or [np.zeros(0, np.int64)])
        if want:
            self.wide = np.concatenate(wide or [none])
            self.wide_ok = np.concatenate(wide_ok or [np.zeros(0, bool)])


def _spread(keys: np.ndarray, shards: int) -> np.ndarray:
    """Borders of the shards in sorted keys of log2(shards) + 32 bits."""
    return np.searchsorted(keys, np.arange(shards + 1, dtype=np.uint64) << np.uint64(32))


def _short(hashes: np.ndarray, shards: int) -> np.ndarray:
    return hashes >> np.uint64(32 - int(shards).bit_length() + 1)


def probe_messages(chunks: DataFrame, shards: int, window: int) -> DataFrame:
    def send(batches):
        for batch in batches:
            for chunk, blob in zip(batch.column("chunk").to_pylist(), batch.column("blob")):
                seen = Windows(unpack_message(blob.as_buffer()).column("text"), window)
                probes, n = np.unique(_short(seen.probes, shards), return_counts=True)
                blocks = np.unique(_short(seen.blocks, shards))
                p, b = _spread(probes, shards), _spread(blocks, shards)
                low = (probes & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                low_blocks = (blocks & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                used = [s for s in range(shards) if p[s] < p[s + 1]]
                yield pa.RecordBatch.from_arrays([
                    pa.array(used, pa.int32()), pa.array([chunk] * len(used), pa.int64()),
                    pa.array([low[p[s]:p[s + 1]].tobytes() for s in used], pa.binary()),
                    pa.array([np.packbits(n[p[s]:p[s + 1]] > 1).tobytes() for s in used], pa.binary()),
                    pa.array([low_blocks[b[s]:b[s + 1]].tobytes() for s in used], pa.binary()),
                ], names=["shard", "chunk", "probes", "again", "blocks"])
    return chunks.select("chunk", "blob").mapInArrow(send, MESSAGE)


def _within(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), dtype=bool)
    at = np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)
    return ordered[at] == values


def _repeated(ordered: np.ndarray) -> np.ndarray:
    return np.unique(ordered[1:][ordered[1:] == ordered[:-1]])


def anchor_hits(messages: DataFrame) -> DataFrame:
    """Per chunk and shard the chunk's blocks that a second run, anywhere, equals."""
    def meet(table: pa.Table) -> pa.Table:
        chunks, shard = table.column("chunk").to_pylist(), table.column("shard")[0].as_py()
        probes = [np.frombuffer(x.as_buffer(), np.uint32) for x in table.column("probes")]
        again = [p[np.unpackbits(np.frombuffer(x.as_buffer(), np.uint8), count=len(p)).astype(bool)]
                 for p, x in zip(probes, table.column("again"))]
        met = np.union1d(_repeated(np.sort(np.concatenate(probes))), np.concatenate(again))
        out = []
        for chunk, x in zip(chunks, table.column("blocks")):
            blocks = np.frombuffer(x.as_buffer(), np.uint32)
            hit = blocks[_within(blocks, met)]
            if len(hit):
                out.append((chunk, shard, hit.tobytes()))
        return _answers(out)
    return messages.groupBy("shard").applyInArrow(meet, ANSWER)


def _answers(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()),
                                 pa.array([r[2] for r in rows], pa.binary())], names=["chunk", "shard", "payload"])


def _candidates(seen: Windows, hits: dict[int, bytes], shards: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the windows that hold a hit block, and their fingerprints, ordered by fingerprint."""
    keys = [(np.uint64(s) << np.uint64(32)) | np.frombuffer(v, np.uint32).astype(np.uint64)
            for s, v in sorted(hits.items()) if s < shards]
    hit = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
    at = seen.block_at[_within(_short(seen.blocks, shards), np.sort(hit))]
    near = np.zeros(seen.n_words + 1, dtype=np.int64)
    np.add.at(near, np.maximum(at - (window - seen.block), 0), 1)
    np.add.at(near, at + 1, -1)
    starts = np.flatnonzero((np.cumsum(near[:-1]) > 0) & seen.wide_ok)
    prints = seen.wide[starts]
    order = np.argsort(prints, kind="stable")
    return starts[order], prints[order]


def window_messages(chunks: DataFrame, hits: DataFrame, shards: int, window: int) -> DataFrame:
    """Fingerprints of the windows around anchor hits."""
    def extend(chunk, rows, found):
        seen = Windows(rows.column("text"), window, want=True)
        _, prints = _candidates(seen, found, shards, window)
        bits = int(shards).bit_length() - 1
        cut = np.searchsorted(prints >> np.uint64(64 - bits), np.arange(shards + 1, dtype=np.uint64))
        used = [s for s in range(shards) if cut[s] < cut[s + 1]]
        yield pa.RecordBatch.from_arrays([
            pa.array([chunk] * len(used), pa.int64()), pa.array(used, pa.int32()),
            pa.array([prints[cut[s]:cut[s + 1]].tobytes() for s in used], pa.binary())],
            names=["chunk", "shard", "payload"])
    return answer_chunks(chunks, hits, extend, ANSWER)


def window_repeats(messages: DataFrame, shards: int) -> DataFrame:
    """One bit per fingerprint sent: does it occur again? Answers are numbered from `shards` on."""
    def count(table: pa.Table) -> pa.Table:
        sent = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("payload")]
        again = _repeated(np.sort(np.concatenate(sent)))
        shard = table.column("shard")[0].as_py()
        return _answers([(c, shards + shard, np.packbits(_within(x, again)).tobytes())
                         for c, x in zip(table.column("chunk").to_pylist(), sent)])
    return messages.groupBy("shard").applyInArrow(count, ANSWER)


def _strip(rows: pa.RecordBatch, found: dict, shards: int, window: int):
    text = rows.column("text")
    seen = Windows(text, window, want=True)
    starts, prints = _candidates(seen, found, shards, window)
    bits = int(shards).bit_length() - 1
    cut = np.searchsorted(prints >> np.uint64(64 - bits), np.arange(shards + 1, dtype=np.uint64))
    parts = [np.unpackbits(np.frombuffer(found[shards + s], np.uint8), count=cut[s + 1] - cut[s])
             for s in range(shards) if cut[s] < cut[s + 1]]
    starts = starts[np.concatenate(parts).astype(bool)] if parts else starts
    cover = np.zeros(seen.n_words + window + 1, dtype=np.int32)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + window, -1)
    gone = np.cumsum(cover)[:seen.n_words] > 0
    first = np.concatenate([[0], np.cumsum(seen.counts)])
    lost = np.add.reduceat(np.concatenate([gone, [False]]).astype(np.int64), first[:-1]) * (seen.counts > 0) \
        if len(seen.counts) else np.zeros(0, np.int64)
    kept, spans = [], []
    for i, value in enumerate(text.to_pylist()):
        if value is None:
            kept.append("")
            spans.append([])
            continue
        words = value.encode().split()
        if lost[i]:
            mask = gone[first[i]:first[i + 1]]
            edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
            spans.append([{"start": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2])])
            words = [w for w, m in zip(words, mask.tolist()) if not m]
        else:
            spans.append([])
        kept.append(b" ".join(words).decode())
    return seen.counts, lost, kept, spans


SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def remove_repeats(df: DataFrame, text: str = "text", window: int = WINDOW, chunk_bytes: int = CHUNK_BYTES,
                   per_shard: int = PER_SHARD) -> DataFrame:
    """Per row: text, rest (struct of the other columns), n_words, n_removed, kept (the words that stay,
    joined by one space), spans (word ranges removed)."""
    wrapped = wrap(df, text)
    rest = wrapped.schema["rest"].dataType
    chunks = chunk_store(wrapped, "text", "passages", chunk_bytes)
    shards = shard_count(chunks, per_shard)
    hits = anchor_hits(probe_messages(chunks, shards, window))
    from chartloom.llm.store import stage
    hits = stage(hits, "anchors")
    repeats = window_repeats(window_messages(chunks, hits, shards, window), shards)

    def finish(chunk, rows, found):
        n, lost, kept, spans = _strip(rows, found, shards, window)
        yield pa.RecordBatch.from_arrays(
            [rows.column("text"), rows.column("rest"), pa.array(n, pa.int64()), pa.array(lost, pa.int64()),
             pa.array(kept, pa.string()), pa.array(spans, SPANS)],
            names=["text", "rest", "n_words", "n_removed", "kept", "spans"])

    schema = T.StructType([
        T.StructField("text", T.StringType()), T.StructField("rest", rest), T.StructField("n_words", T.LongType()),
        T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType()),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()),
                                                         T.StructField("end", T.IntegerType())])))])
    return answer_chunks(chunks, hits.unionByName(repeats), finish, schema)
