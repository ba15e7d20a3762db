"""Vocabularies and feature vectors."""

from __future__ import annotations

from pyspark.ml.feature import CountVectorizerModel, VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F

from chartloom.functions.text import keep_vocabulary, ngram_range, word_tokens
from chartloom.operators import distinct, heavy

# terms of a task that counts them: some 100 bytes each where all differ
TERMS_A_TASK = 4_000_000


def document_frequency(df: DataFrame, terms: Column) -> DataFrame:
    """(term, df): in how many documents each term occurs. Repeats inside a document are removed
    in the row itself, and counts are combined before the shuffle."""
    return (df.select(F.explode(F.array_distinct(terms)).alias("term"))
            .groupBy("term").agg(F.count(F.lit(1)).alias("df")))


def frequent(counted: DataFrame, documents: int, tenths: int = 1) -> DataFrame:
    """Terms in more than a tenth of the documents; exactly a tenth is not enough. In integers,
    so that the edge is exact."""
    return counted.where(F.col("df") * 10 > F.lit(documents * tenths))


def frequent_terms(df: DataFrame, terms: Column, documents: int | None = None) -> list[str]:
    """The kept terms, sorted, on the driver. Their number is bounded: terms that each occur in
    over a tenth of the documents number fewer than ten times the terms of a mean document."""
    if documents is None:
        documents = df.count()
    rows = frequent(document_frequency(df, terms), documents).select("term").collect()
    return sorted(r.term for r in rows)


def fit_ngram_vocabulary(df: DataFrame, body: str, high: int = 3) -> list[str]:
    """Frequent word 1..high-grams, ordered by length, then alphabetically (see `heavy`)."""
    return heavy.frequent_ngrams(df, body, high)


def partitions_for(df: DataFrame, terms: Column) -> int:
    """As many partitions as hold `TERMS_A_TASK` terms each, the shuffle partitions at least."""
    total = df.agg(F.sum(F.greatest(F.size(terms), F.lit(0)).cast("long"))).first()[0] or 0
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // TERMS_A_TASK))


def term_counts(df: DataFrame, key: list[str], terms: Column) -> DataFrame:
    """Long count matrix (key, term, n). One row of `df` is one document. Documents are dealt by key over as many
    partitions as their terms ask for, and counted where they lie: pairs of document and term do not travel."""
    dealt = df.select(*key, terms.alias("_terms")).repartition(partitions_for(df, terms), *key)
    return (dealt.select(*key, F.explode("_terms").alias("term"))
            .groupBy(*key, "term").agg(F.count(F.lit(1)).alias("n")))


def distinct_terms(df: DataFrame, terms: Column, high: int = 1) -> DataFrame:
    """(term): every term once; with `high`, every run of 1..high terms of a document, its n-grams, joined by blanks. Tasks
    exchange runs as numbers, and each returns a bounded share of them (see `distinct`)."""
    return distinct.distinct_runs(df.select(terms.alias("_terms")), high, partitions_for(df, terms))


def presence(df: DataFrame, key: list[str], body: str, vocabulary: list[str]) -> DataFrame:
    """Long presence matrix (key, term) over the vocabulary, from blocks of term numbers."""
    return heavy.presence(df, key, body, vocabulary).matrix()


def prune_rare_words(notes: DataFrame, body: str, terms: list[str]) -> DataFrame:
    return notes.withColumn(body, keep_vocabulary(F.col(body), terms))


def train_range(train: DataFrame, column: str) -> tuple[Column, Column]:
    """Minimum and maximum as scalar subqueries: one aggregate each, no join."""
    return (train.select(F.min(column)).scalar(), train.select(F.max(column)).scalar())


def scale(c: Column, low: Column, high: Column) -> Column:
    """(x - low) / (high - low); 0 where all training values are equal."""
    return F.when(high == low, F.lit(0.0)).otherwise((c - low) / (high - low))


def rerange(c: Column, own_low: Column, own_high: Column, low: Column, high: Column) -> Column:
    """Stretch the other set's own range onto the training range, rounded half to even, then
    scale. A set with a single value sits at the low end."""
    width = own_high - own_low
    moved = F.when(width == 0, low.cast("double")).otherwise(
        (c - own_low) / (width / (high - low)) + low)
    return scale(F.rint(moved), low, high)


def vectorise(df: DataFrame, body: str, vocabulary: list[str], numeric: list[str],
              out: str = "features", high: int = 3) -> DataFrame:
    """Sparse 0/1 n-gram features followed by the numeric columns, in one vector."""
    tokens = df.withColumn("_grams", ngram_range(word_tokens(F.col(body)), 1, high))
    model = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="_grams", outputCol="_text", minTF=1.0)
    model.setBinary(True)
    joined = VectorAssembler(inputCols=["_text", *numeric], outputCol=out)
    return joined.transform(model.transform(tokens)).drop("_grams", "_text")
