"""Word bigrams with Katz backoff: Good-Turing discounts, exactly normalised backoff weights.

Tokens are the lower-cased words (A-Z only) of a row and one end token. The model over V seen types
and one unseen type is evaluated recursively: a seen bigram has its discounted relative frequency, any
other the backoff weight of its history times the unigram's probability, which is discounted likewise
and leaves its missing mass to the unseen type. The weight is the mass the history's seen bigrams leave,
over the unigram mass of the types not seen after it, so every history's probabilities sum to one.

Rows are kept in chunks. For each level a chunk sends its distinct n-grams, once each with their local
counts, to shards of the hash range; a shard adds up the counts of all chunks, keeps its part of the
model as a table and answers with the totals. An n-gram one of whose words occurs in no other chunk is
counted on the spot. Backoff sums travel the same way, keyed by history: each
seen bigram is added by the one chunk that owns it. A word that makes up a third of the corpus is one
number per chunk.

Counts below `LOW` + 1 are discounted; where the counts of counts of a small corpus do not give usable
Good-Turing discounts, half a count is taken off instead. A history or table that discounting leaves no
mass reserves half a count, its seen events scaled to match.

Defined results: a null text is empty and has only the end token; an empty training set knows no types,
so the unseen type has probability one; rows repeat freely.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from chartloom.llm.anchors import wrap
from chartloom.llm.store import (answer_chunks, chunk_store, ordered_planes, ordered_unplanes, planes, shard_count, stage,
                                 unpack_message, unplanes)
from chartloom.llm.words import LOWER, STEP, mix, views, word_hashes, word_spans

LOW = 5
CHUNK = 7 << 20
PER_SHARD = 2_000_000
END, BEGIN = np.uint64(0x5E4D), np.uint64(0xBE61)
MESSAGE = "shard int, chunk long, keys binary, counts binary, singles array<long>"
ANSWER = "chunk long, shard int, payload binary, stats array<long>"


class Tokens:
    """The token stream of one chunk: distinct types, and for each token its type and its row."""

    def __init__(self, rows: pa.RecordBatch, train_field: str):
        stream, lengths = [], []
        for _, _, data, offsets in views(rows.column("text")):
            starts, ends, first = word_spans(data, offsets)
            words = word_hashes(LOWER[data], starts, ends)
            n = np.diff(first)
            tokens = np.full(len(words) + len(n), END, dtype=np.uint64)
            tokens[np.arange(len(words)) + np.repeat(np.arange(len(n)), n)] = words
            stream.append(tokens)
            lengths.append(n + 1)
        tokens = np.concatenate(stream or [np.zeros(0, np.uint64)])
        self.lengths = np.concatenate(lengths or [np.zeros(0, np.int64)])
        self.rows = np.repeat(np.arange(len(self.lengths), dtype=np.int32), self.lengths)
        train = rows.column("rest").field(train_field)
        train = np.array([bool(x) for x in train.to_pylist()], dtype=bool)
        self.train = train[self.rows] if len(tokens) else np.zeros(0, bool)
        self.types, self.at = np.unique(tokens, return_inverse=True)
        self.at = self.at.astype(np.int32)
        self.local = np.bincount(self.at, weights=self.train, minlength=len(self.types)).astype(np.int64)

    def bigrams(self, totals: np.ndarray, elsewhere: np.ndarray, begins: int):
        """Distinct (history, word) pairs; history -1 is the beginning of a row."""
        history = np.concatenate([[-1], self.at[:-1]]).astype(np.int64) if len(self.at) else np.zeros(0, np.int64)
        starts = np.cumsum(self.lengths) - self.lengths
        if len(history):
            history[starts] = -1
        pair = (history + 1) * np.int64(len(self.types)) + self.at
        self.pairs, self.pair_at = np.unique(pair, return_inverse=True)
        self.pair_at = self.pair_at.astype(np.int32)
        del history, pair
        self.pair_local = np.bincount(self.pair_at, weights=self.train, minlength=len(self.pairs)).astype(np.int64)
        self.history = self.pairs // max(1, len(self.types)) - 1
        self.word = self.pairs % max(1, len(self.types))
        # types (and the beginning, last) that rows outside this chunk hold, too
        self.shared = np.concatenate([elsewhere, [True]])
        self.history_total = np.concatenate([totals, [begins]])[self.history]
        self.history_key = np.concatenate([self.types, [BEGIN]])
        self.open = self.shared[self.history] & self.shared[self.word]
        keys = mix(self.history_key[self.history] * STEP + mix(self.types[self.word] + np.uint64(1)))
        self.sent = np.flatnonzero(self.open)
        self.sent = self.sent[np.argsort(keys[self.sent], kind="stable")]
        self.keys = keys[self.sent]


def _cut(keys: np.ndarray, shards: int) -> np.ndarray:
    bits = int(shards).bit_length() - 1
    return np.searchsorted(keys >> np.uint64(64 - bits), np.arange(shards + 1, dtype=np.uint64))


def _messages(chunk: int, keys: np.ndarray, values: np.ndarray, shards: int, singles: list[int] | None = None) -> pa.RecordBatch:
    """Sorted keys, and one row of numbers for each, as one message per shard."""
    cut = _cut(keys, shards)
    used = [s for s in range(shards) if cut[s] < cut[s + 1] or (singles and s == 0)]
    return pa.RecordBatch.from_arrays([
        pa.array(used, pa.int32()), pa.array([chunk] * len(used), pa.int64()),
        pa.array([ordered_planes(keys[cut[s]:cut[s + 1]]) for s in used], pa.binary()),
        pa.array([planes(values[cut[s]:cut[s + 1]]) for s in used], pa.binary()),
        pa.array([singles if s == 0 else None for s in used], pa.list_(pa.int64())),
    ], names=["shard", "chunk", "keys", "counts", "singles"])


def _answered(found: dict, keys: np.ndarray, shards: int, level: int, width: int, kind) -> np.ndarray:
    """The numbers that came back for the sorted keys, in their order."""
    cut = _cut(keys, shards)
    parts = [unplanes(found[level * shards + s], kind) for s in range(shards) if cut[s] < cut[s + 1]]
    return np.concatenate(parts or [np.zeros(0, kind)]).reshape(-1, width)


def _histogram(counts: np.ndarray) -> list[int]:
    """How many counts are 1, 2, ..., LOW + 1."""
    return np.bincount(np.minimum(counts[counts > 0], LOW + 2), minlength=LOW + 3)[1:LOW + 2].tolist()


def add_counts(messages: DataFrame, shards: int, level: int) -> DataFrame:
    """Totals of every key. Answers: one row per chunk, with 4 * the total of each key it sent, + 2 if
    another chunk sent it, + 1 if this is the first chunk that counted it. Chunk -1 is the shard's part of the model: keys and counts,
    and as stats the number of tokens, of types and of types by low count. Numbers travel as byte planes."""
    def add(table: pa.Table) -> pa.Table:
        table = table.sort_by("chunk")
        shard, chunks = table.column("shard")[0].as_py(), table.column("chunk").to_pylist()
        keys = [ordered_unplanes(x.as_buffer()) for x in table.column("keys")]
        counts = [unplanes(x.as_buffer(), np.int64) for x in table.column("counts")]
        distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
        flat = np.concatenate(counts)
        totals = np.zeros(len(distinct), np.int64)
        np.add.at(totals, at, flat)
        owner = np.full(len(distinct), len(flat), np.int64)
        counted = np.flatnonzero(flat)
        owner[at[counted[::-1]]] = counted[::-1]                  # the first one wins
        first = np.zeros(len(flat), np.int64)
        first[owner[owner < len(flat)]] = 1
        marked = totals * 4 + 2 * (np.bincount(at, minlength=len(distinct)) > 1)
        out, base = [], 0
        for chunk, own in zip(chunks, keys):
            span = slice(base, base + len(own))
            out.append((chunk, level * shards + shard, planes(marked[at[span]] + first[span]), None))
            base += len(own)
        seen = totals > 0
        low = np.array(_histogram(totals))
        for singles in table.column("singles").to_pylist():
            if singles:
                low = low + np.array(singles)
        model = ordered_planes(distinct[seen]) + planes(totals[seen])
        out.append((-1, level * shards + shard, model, [int(totals.sum()), int(seen.sum()), *map(int, low)]))
        return _rows(out)
    return messages.groupBy("shard").applyInArrow(add, ANSWER)


def _rows(out: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int32()),
                                 pa.array([r[2] for r in out], pa.binary()), pa.array([r[3] for r in out], pa.list_(pa.int64()))],
                                names=["chunk", "shard", "payload", "stats"])


def add_sums(messages: DataFrame, shards: int, level: int) -> DataFrame:
    """Totals of two sums per history, answered to every chunk that sent the history."""
    def add(table: pa.Table) -> pa.Table:
        table = table.sort_by("chunk")                             # the same order of addition each time
        shard, chunks = table.column("shard")[0].as_py(), table.column("chunk").to_pylist()
        keys = [ordered_unplanes(x.as_buffer()) for x in table.column("keys")]
        sums = np.concatenate([unplanes(x.as_buffer(), np.float64) for x in table.column("counts")]).reshape(-1, 2)
        distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
        totals = np.stack([np.bincount(at, weights=sums[:, i], minlength=len(distinct)) for i in (0, 1)], axis=1)
        out, base = [], 0
        for chunk, own in zip(chunks, keys):
            out.append((chunk, level * shards + shard, planes(totals[at[base:base + len(own)]]), None))
            base += len(own)
        return _rows(out)
    return messages.groupBy("shard").applyInArrow(add, ANSWER)


def model_stats(answers: DataFrame) -> list[int]:
    """Tokens, types, and types by low count, over all shards."""
    row = answers.where("chunk = -1").agg(*(F.coalesce(F.sum(F.col("stats")[i]), F.lit(0)).alias(f"s{i}") for i in range(LOW + 3))).first()
    return [int(x) for x in row]


def discounts(low: list[int]) -> np.ndarray:
    """Factor of each count up to LOW (index 0 unused); low[r - 1] is how many events have count r."""
    for k in range(LOW, 0, -1):
        n = [0, *low[:k + 1]]
        if all(n[1:k + 2]):
            spare = (k + 1) * n[k + 1] / n[1]
            if spare < 1:
                d = [((r + 1) * n[r + 1] / n[r] / r - spare) / (1 - spare) for r in range(1, k + 1)]
                if all(0 < x < 1 for x in d):
                    return np.array([1.0, *d, *[1.0] * (LOW - k)])
    return np.array([1.0, *((r - 0.5) / r for r in range(1, LOW + 1))])


def _discounted(counts: np.ndarray, factors: np.ndarray) -> np.ndarray:
    return counts * np.where(counts <= LOW, factors[np.minimum(counts, LOW)], 1.0)


class Unigrams:
    """Discounted probabilities of seen types, and of the one unseen type."""

    def __init__(self, stats: list[int]):
        self.tokens, self.types, low = stats[0], stats[1], stats[2:]
        self.factors = discounts(low)
        lost = sum(r * n * (1 - self.factors[r]) for r, n in enumerate(low[:LOW], 1))
        floor = 0.5 / (self.tokens + 0.5 * (self.types + 1))
        spare = lost / self.tokens if self.tokens else 1.0
        self.unseen = max(spare, floor)
        self.scale = (1 - self.unseen) / (1 - spare) if spare < 1 else 1.0

    def of(self, counts: np.ndarray) -> np.ndarray:
        known = _discounted(counts, self.factors) * self.scale / max(1, self.tokens)
        return np.where(counts > 0, known, self.unseen)

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.5) / (self.tokens + 0.5 * (self.types + 1)))


class Scored:
    """One chunk with what the shards have answered so far."""

    def __init__(self, rows, found, shards, train, uni: Unigrams, begins: int):
        self.stream = stream = Tokens(rows, train)
        answer = _answered(found, stream.types, shards, 0, 1, np.int64)[:, 0]
        self.counts = answer >> 2
        self.uni, self.shards, self.found = uni, shards, found
        stream.bigrams(self.counts, (answer & 2).astype(bool), begins)

    def pair_counts(self) -> None:
        stream = self.stream
        answer = _answered(self.found, stream.keys, self.shards, 1, 1, np.int64)[:, 0]
        self.pairs = stream.pair_local.copy()
        self.owned = ~stream.open & (stream.pair_local > 0)
        self.pairs[stream.sent] = answer >> 2
        self.owned[stream.sent] = (answer & 1).astype(bool)

    def own_sums(self, factors: np.ndarray) -> np.ndarray:
        """Of the bigrams this chunk owns, by history: discounted relative frequency, unigram probability."""
        stream = self.stream
        seen = np.flatnonzero(self.owned)
        history = stream.history[seen]
        share = _discounted(self.pairs[seen], factors) / stream.history_total[seen]
        n = len(stream.types) + 1
        return np.stack([np.bincount(history % n, weights=w, minlength=n)
                         for w in (share, self.uni.of(self.counts[stream.word[seen]]))], axis=1).astype(np.float64)

    def wide_histories(self) -> np.ndarray:
        """Known histories that other chunks hold too, by key; the beginning is the last index."""
        stream = self.stream
        known = np.concatenate([self.counts > 0, [True]]) & stream.shared
        at = np.flatnonzero(known)
        return at[np.argsort(stream.history_key[at], kind="stable")]

    def log_probabilities(self, factors: np.ndarray) -> np.ndarray:
        """log10 of each token's probability."""
        stream = self.stream
        sums = self.own_sums(factors)
        wide = self.wide_histories()
        sums[wide] = _answered(self.found, stream.history_key[wide], self.shards, 2, 2, np.float64)
        total = np.concatenate([self.counts, [0]])
        total[-1] = stream.history_total[stream.history == -1][0] if (stream.history == -1).any() else 0
        with np.errstate(divide="ignore", invalid="ignore"):
            left = np.maximum(1 - sums[:, 0], 0.5 / (total + 0.5))
            scale = np.where(sums[:, 0] > 0, (1 - left) / sums[:, 0], 1.0)
            weight = np.where(total > 0, left / np.maximum(1 - sums[:, 1], self.uni.unseen), 1.0)
        lower = self.uni.of(self.counts[stream.word])
        with np.errstate(divide="ignore", invalid="ignore"):
            seen = _discounted(self.pairs, factors) * scale[stream.history] / stream.history_total
        p = np.where(self.pairs > 0, seen, weight[stream.history] * lower)
        return np.log10(p)[stream.pair_at]


def score_texts(df: DataFrame, train: Column, text: str = "text", chunk_bytes: int = CHUNK,
                per_shard: int = PER_SHARD) -> DataFrame:
    """Per row: text, rest (struct of the other columns), n_tokens, n_known, train_tokens, base_score, score.

    The model learns from the rows where `train` holds (null: not) and scores all of them.
    """
    flag = "_learn"
    while flag in df.columns:
        flag += "_"
    wrapped = wrap(df.withColumn(flag, F.coalesce(train, F.lit(False))), text)
    rest = wrapped.schema["rest"].dataType
    chunks = chunk_store(wrapped, "text", "documents", chunk_bytes)
    shards = shard_count(chunks, per_shard)

    def send_types(batches):
        for batch in batches:
            for chunk, blob in zip(batch.column("chunk").to_pylist(), batch.column("blob")):
                seen = Tokens(unpack_message(blob.as_buffer()), flag)
                yield _messages(chunk, seen.types, seen.local, shards)

    first = stage(add_counts(chunks.select("chunk", "blob").mapInArrow(send_types, MESSAGE), shards, 0), "unigrams")
    uni = Unigrams(model_stats(first))
    begins = chunks_train_rows(first, shards)
    known = partial(Scored, shards=shards, train=flag, uni=uni, begins=begins)

    def send_pairs(chunk, rows, found):
        here = known(rows, found)
        stream = here.stream
        singles = _histogram(stream.pair_local[~stream.open])
        yield _messages(chunk, stream.keys, stream.pair_local[stream.sent], shards, singles)

    to_chunks = first.where("chunk >= 0").select("chunk", "shard", "payload")
    second = stage(add_counts(answer_chunks(chunks, to_chunks, send_pairs, MESSAGE), shards, 1), "bigrams")
    factors = discounts(model_stats(second)[2:])
    to_chunks = to_chunks.unionByName(second.where("chunk >= 0").select("chunk", "shard", "payload"))

    def send_sums(chunk, rows, found):
        here = known(rows, found)
        here.pair_counts()
        wide = here.wide_histories()
        yield _messages(chunk, here.stream.history_key[wide], here.own_sums(factors)[wide], shards)

    third = add_sums(answer_chunks(chunks, to_chunks, send_sums, MESSAGE), shards, 2)
    to_chunks = to_chunks.unionByName(third.select("chunk", "shard", "payload"))

    def finish(chunk, rows, found):
        here = known(rows, found)
        here.pair_counts()
        stream = here.stream
        n = len(stream.lengths)
        counts = here.counts[stream.at]
        by_row = lambda w: np.bincount(stream.rows, weights=w, minlength=n)
        yield pa.RecordBatch.from_arrays(
            [rows.column("text"), rows.column("rest"), pa.array(stream.lengths, pa.int64()),
             pa.array(by_row(counts > 0).astype(np.int64)), pa.array(np.full(n, uni.tokens, np.int64)),
             pa.array(by_row(uni.base(counts))), pa.array(by_row(here.log_probabilities(factors)))],
            names=["text", "rest", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    schema = T.StructType([T.StructField("text", T.StringType()), T.StructField("rest", rest),
                           *(T.StructField(c, T.LongType()) for c in ("n_tokens", "n_known", "train_tokens")),
                           *(T.StructField(c, T.DoubleType()) for c in ("base_score", "score"))])
    return answer_chunks(chunks, to_chunks, finish, schema)


def chunks_train_rows(first: DataFrame, shards: int) -> int:
    """Training rows: the count of the end token, from its shard of the model."""
    bits = int(shards).bit_length() - 1
    row = first.where(F.col("chunk") == -1).where(F.col("shard") == int(END) >> (64 - bits)).select("payload").first()
    if row is None:
        return 0
    half = len(row.payload) // 2
    keys, counts = ordered_unplanes(row.payload[:half]), unplanes(row.payload[half:], np.int64)
    at = np.searchsorted(keys, END)
    return int(counts[at]) if at < len(keys) and keys[at] == END else 0
