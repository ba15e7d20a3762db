"""A corpus from raw documents to packed training sequences, five operators one after the other.

Every stage takes what its predecessor kept, with whatever columns it has, and its decisions hold for all
that follow: toxic rows go, of equal texts one row stays, of each near-duplicate group one row stays,
repeated passages are cut out of the texts, and what is left is packed.

Rows are told apart by id and text, so a repeated id loses no other row; of rows that repeat both, and of
several rows that would stay for one group (repeated or null ids), one stays. Null and empty texts are clean,
equal to each other and to nothing else, and pack as an end token.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from chartloom.llm import anchors, cuckoo, hyperminhash, store, toxicity, vectorpack
from chartloom.llm.queries import fold


def _again(docs: DataFrame, found: DataFrame, text: str = "text") -> DataFrame:
    """(text, rest, ...) of an operator with the columns of `docs` again, in order."""
    return found.select(*(F.col(text).alias("text") if c == "text" else F.col(f"rest.`{c}`").alias(c) for c in docs.columns))


def _among(docs: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """`docs` with (left_semi) or without (left_anti) the rows (doc_id, content); content is the hash of the text as it is."""
    rows = rows.select(F.col("doc_id").alias("_id"), "content")
    return docs.join(rows, docs["doc_id"].eqNullSafe(rows["_id"]) & (F.xxhash64(docs["text"]) == rows["content"]), how)


def _one_of_each(docs: DataFrame, found: DataFrame, group: str) -> DataFrame:
    """`docs` with exactly one row of each group that `found` (doc_id, content, kept, `group`) tells."""
    found = store.stage(found.select("doc_id", "content", "kept", F.col(group).alias("group")), "decisions")
    pairs = found.where("kept").groupBy("group", "doc_id", "content").agg(F.count("*").alias("n"))
    several = pairs.groupBy("group").agg(F.min("content").alias("stays"), F.sum("n").alias("rows")).where("rows > 1")
    # kept rows of groups that keep several: none, unless ids are null or repeat
    surplus = store.stage(pairs.join(several, "group").select("doc_id", "content", "n", (F.col("content") == F.col("stays")).alias("stays")), "surplus")
    gone = found.where("NOT kept").select("doc_id", "content")
    if surplus.isEmpty():
        return _among(docs, gone, "left_anti")
    rest = _among(docs, gone.unionByName(surplus.where("NOT stays").select("doc_id", "content")), "left_anti")
    again = surplus.where("stays AND n > 1")
    return _among(rest, again, "left_anti").unionByName(_among(rest, again, "left_semi").dropDuplicates(["doc_id", "text"]))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.learn(docs, labels, fold("doc_id", 3) != 1)
    return _again(docs, toxicity.score_texts(docs, model).where("predicted = 0"))


def drop_equal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _one_of_each(docs, cuckoo.exact_duplicates(docs), "text_sha256")


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _one_of_each(docs, hyperminhash.near_groups(docs), "component")


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = anchors.remove_repeats(docs).withColumn("text", F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text")))
    out = _again(docs, cut)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    pieces = vectorpack.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_equal),
    ("near_dedup", drop_near),
    ("substring_dedup", cut_repeats),
    ("packing", pack),
]

# sub-word ids have no SQL form; the stages are tested against plain Python on a small corpus
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        docs = store.stage(step(spark, docs, sf_dir), name)
    return docs
