"""Stemming by vocabulary: a stored (token, stem) relation that grows, and texts rebuilt from it.

A word is stemmed once, when it is first seen; later texts only add the words the relation lacks.

Texts travel as chunks: the rows of a stretch of `CHUNK_BYTES` of text as one message that holds their words as numbers
in the chunk's own list of words. What meets the relation is that list, so a word travels once per chunk.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from chartloom.functions.messages import pack, unpack
from chartloom.functions.stem import stem_text
from chartloom.sources.checkpoints import checkpoint_dir, materialise

RELATION = "token string, stem string"
# largest relation (bytes of its words) that is broadcast; beyond it words travel to their stems
BROADCAST_BYTES = 8 << 20
# text of a chunk: the larger, the fewer chunks ask for the same word
CHUNK_BYTES = 32 << 20


def distinct_tokens(df: DataFrame, column: str) -> DataFrame:
    """Distinct blank-separated words, without the empty one. A text sends each of its words once."""
    words = F.array_distinct(F.split(F.col(f"`{column}`"), " "))
    return df.select(F.explode(words).alias("token")).where("token != ''").distinct()


class StemStore:
    """The relation in a folder all executors share; without a path, a new one in the checkpoint folder."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        self.path = path or f"{checkpoint_dir(spark).rstrip('/')}/stems-{uuid.uuid4().hex}"
        spark.createDataFrame([], RELATION).write.mode("ignore").parquet(self.path)

    def read(self) -> DataFrame:
        """One row per word. Two jobs that learn at the same time may both write a word: one row stays."""
        return self.spark.read.schema(RELATION).parquet(self.path).dropDuplicates(["token"])

    def learn(self, df: DataFrame, column: str) -> None:
        """Stem the words that the relation does not hold yet, and append them."""
        self.learn_tokens(distinct_tokens(df, column))

    def learn_tokens(self, tokens: DataFrame) -> None:
        """`learn` for words that are at hand, each once."""
        new = tokens.join(self.read(), "token", "left_anti")
        new.select("token", stem_text("token").alias("stem")).write.mode("append").parquet(self.path)

    def n_bytes(self) -> int:
        return self.read().agg(F.sum(F.octet_length("token") + F.octet_length("stem"))).first()[0] or 0


def _packed(df: DataFrame, column: str) -> DataFrame:
    """(rest, text): the other columns travel as one struct, so that their names cannot clash with the text's."""
    others = [F.col(f"`{c}`") for c in df.columns if c != column]
    rest = F.struct(*others) if others else F.struct(F.lit(0).alias("_"))
    return df.select(rest.alias("rest"), F.col(f"`{column}`").alias("text"))


def _joined(words: pa.Array, lists: pa.ListArray, valid: pa.Array) -> pa.Array:
    """Texts from the numbers of their words, blanks at the ends removed; null where not `valid`."""
    texts = pa.LargeListArray.from_arrays(lists.offsets.cast(pa.int64()), words.take(lists.values))
    out = pc.utf8_trim(pc.binary_join(texts, pa.scalar(" ", pa.large_string())), " ")
    return pc.if_else(valid, out, pa.scalar(None, pa.large_string())).cast(pa.string())


def _stretches(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.Table]:
    """The rows in order, as tables of about `limit` bytes of text; a longer text is one by itself."""
    held, size = [], 0
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
        start = 0
        for stop, length in enumerate(lengths):
            if size and size + length > limit:
                held.append(batch.slice(start, stop - start))
                yield pa.Table.from_batches(held)
                held, size, start = [], 0, stop
            size += int(length)
        held.append(batch.slice(start))
    if sum(len(x) for x in held):
        yield pa.Table.from_batches(held)


def chunked(df: DataFrame, column: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(chunk, words, message): the rows of `df` as chunks, stored. `words` lists a chunk's words, each once;
    `message` holds the other columns and the texts as numbers in that list. `df` is read once."""
    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _stretches(batches, chunk_bytes):
            texts = rows.column("text").combine_chunks().cast(pa.large_string())
            split = pc.split_pattern(pc.fill_null(texts, ""), " ")
            coded = split.flatten().dictionary_encode()
            lists = pa.ListArray.from_arrays(split.offsets.cast(pa.int32()), coded.indices)
            table = pa.table([rows.column("rest").combine_chunks(), lists, texts.is_valid()], names=["rest", "at", "valid"])
            words = pa.ListArray.from_arrays([0, len(coded.dictionary)], coded.dictionary.cast(pa.string()))
            yield pa.RecordBatch.from_arrays([words, pa.array([pack(table)], pa.binary())], ["words", "message"])

    chunks = _packed(df, column).mapInArrow(bundle, "words array<string>, message binary")
    return materialise(chunks.select(F.monotonically_increasing_id().alias("chunk"), "words", "message"))


def rebuild_chunks(chunks: DataFrame, df: DataFrame, column: str, store: StemStore, *,
                   broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The rows of `df`, from its chunks, with every word replaced by its stem (see `rebuild`).

    A relation of at most `broadcast_bytes` is broadcast. Beyond it, the chunks' words are joined with those words
    that have another stem than themselves, and each chunk gets its own as (number, stem)."""
    if store.n_bytes() <= broadcast_bytes:
        known = _broadcast(store)
        found = chunks.select("words", "message")
    else:
        known = None
        asked = chunks.select("chunk", F.posexplode("words").alias("at", "token"))
        changed = asked.join(store.read().where("stem != token"), "token").groupBy("chunk").agg(
            F.collect_list("at").alias("at"), F.collect_list("stem").alias("stem"))
        found = chunks.join(changed, "chunk", "left").select("words", "message", "at", "stem")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                words = batch.column(0)[i].values.cast(pa.large_string())
                if known is not None:
                    words = pa.array([known.value.get(w, w) for w in words.to_pylist()], pa.large_string())
                elif batch.column(2)[i].is_valid:
                    place = np.arange(len(words))
                    place[batch.column(2)[i].values.to_numpy()] = len(words) + np.arange(len(batch.column(2)[i].values))
                    words = pa.concat_arrays([words, batch.column(3)[i].values.cast(pa.large_string())]).take(pa.array(place))
                for rows in unpack(batch.column(1)[i]):
                    yield pa.RecordBatch.from_arrays([rows.column("rest"), _joined(words, rows.column("at"), rows.column("valid"))], ["rest", "text"])

    schema = T.StructType([_packed(df, column).schema["rest"], T.StructField("text", T.StringType())])
    return found.mapInArrow(work, schema).select(*[_same(c, column) for c in df.columns])


def rebuild(df: DataFrame, column: str, store: StemStore, *, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """`df` with every word of `column` replaced by its stem, blanks at the ends removed. Words that the
    relation does not hold stay; null stays null, other columns and repeated rows are untouched.

    A relation of at most `broadcast_bytes` is broadcast and the texts do not move. Beyond that, see
    `rebuild_by_position`."""
    if store.n_bytes() <= broadcast_bytes:
        return _rebuild_in_place(df, column, store)
    return rebuild_by_position(df, column, store)


def _broadcast(store: StemStore):
    return store.spark.sparkContext.broadcast(dict(store.read().toArrow().to_pandas().itertuples(index=False, name=None)))


def _rebuild_in_place(df: DataFrame, column: str, store: StemStore) -> DataFrame:
    known = _broadcast(store)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stems = known.value
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = batch.column(at).cast(pa.large_string())
            words = pc.split_pattern(pc.fill_null(texts, ""), " ")
            coded = words.flatten().dictionary_encode()              # each word of a batch is looked up once
            found = pa.array([stems.get(w, w) for w in coded.dictionary.to_pylist()], pa.large_string())
            lists = pa.ListArray.from_arrays(words.offsets, coded.indices)
            yield pa.RecordBatch.from_arrays([batch.column(0), _joined(found, lists, texts.is_valid())], ["rest", "text"])

    packed = _packed(df, column)
    schema = T.StructType([packed.schema["rest"], T.StructField("text", T.StringType())])
    done = packed.mapInArrow(work, schema)
    return done.select(*[_same(c, column) for c in df.columns])


def _same(name: str, column: str) -> Column:
    return F.col("text" if name == column else f"rest.`{name}`").alias(name)


def rebuild_by_position(df: DataFrame, column: str, store: StemStore) -> DataFrame:
    """`rebuild` for a relation of any size: the words of every chunk are joined with the relation and come back by
    their position in the chunk's list. A frequent word is asked for once per chunk."""
    return rebuild_chunks(chunked(df, column), df, column, store, broadcast_bytes=-1)


def stem_by_vocabulary(df: DataFrame, column: str, store: StemStore | None = None, *,
                       broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Learn the new words of `df` and rebuild its texts. `df` is read once."""
    store, chunks = store or StemStore(df.sparkSession), chunked(df, column)
    store.learn_tokens(chunks.select(F.explode("words").alias("token")).where("token != ''").distinct())
    return rebuild_chunks(chunks, df, column, store, broadcast_bytes=broadcast_bytes)
