"""Catalog: vocabularies, n-grams, scaling."""

from __future__ import annotations

from pyspark.sql import functions as F

from chartloom.functions.text import word_tokens
from chartloom.operators import features, report
from chartloom.operators.split import split_label, with_split
from chartloom.plans.registry import Tables, query
from chartloom.plans.texts import WORDS_SQL, dedupe_sql, plain
from chartloom.sources.checkpoints import materialise

GRAMS_SQL = f"""
w AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents),
g AS (SELECT doc_id, unnest(list_distinct(w)) AS term, 1 AS n FROM w
  UNION ALL SELECT doc_id, unnest(list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))), 2 FROM w
  UNION ALL SELECT doc_id, unnest(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))), 3 FROM w),
v AS (SELECT term, n, count(*) AS df FROM g GROUP BY 1, 2 HAVING count(*) * 10 > (SELECT count(*) FROM documents))"""


def docs(t: Tables):
    return t.texts.select("doc_id", plain().alias("Notes"))


@query(f"""
WITH w AS (SELECT doc_id, unnest(list_distinct({WORDS_SQL})) AS term FROM documents)
SELECT term, count(*) AS df, CAST(count(*) * 10 > (SELECT count(*) FROM documents) AS INTEGER) AS kept FROM w GROUP BY 1""")
def doc_frequency(t: Tables):
    counted = features.document_frequency(docs(t), word_tokens(F.col("Notes")))
    total = t.documents.select(F.count(F.lit(1))).scalar()
    return counted.withColumn("kept", (F.col("df") * 10 > total).cast("int"))


@query(f"WITH w AS (SELECT doc_id, unnest({WORDS_SQL}) AS term FROM documents) SELECT doc_id, term, count(*) AS n FROM w GROUP BY 1, 2")
def term_counts(t: Tables):
    return features.term_counts(docs(t), ["doc_id"], word_tokens(F.col("Notes")))


@query(f"""
WITH w AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents), e AS (SELECT doc_id, unnest(list_distinct(w)) AS term FROM w),
v AS (SELECT list(term) AS terms FROM (SELECT term FROM e GROUP BY 1 HAVING count(*) * 10 > (SELECT count(*) FROM documents)))
SELECT doc_id, array_to_string(list_filter(w, lambda x: list_contains(terms, x)), ' ') AS kept FROM w, v""")
def vocab_filter(t: Tables):
    from chartloom.functions.text import keep_tokens, tokenize
    words = features.frequent_terms(docs(t), word_tokens(F.col("Notes")))
    return docs(t).select("doc_id", F.array_join(keep_tokens(tokenize(F.col("Notes")), words), " ").alias("kept"))


# words are kept by their share of the training notes and leave the training notes only
@query(f"""
WITH w AS (SELECT doc_id, {WORDS_SQL} AS w,
    CASE WHEN ('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8))::BIGINT % 10 < 7 THEN 'train' ELSE 'test' END AS split FROM documents),
e AS (SELECT doc_id, unnest(list_distinct(w)) AS term FROM w WHERE split = 'train'),
v AS (SELECT list(term) AS terms FROM (SELECT term FROM e GROUP BY 1 HAVING count(*) * 10 > (SELECT count(*) FROM w WHERE split = 'train'))),
k AS (SELECT doc_id, array_to_string(list_filter(w, lambda x: list_contains(terms, x)), ' ') AS s FROM w, v WHERE split = 'train')
SELECT doc_id, {dedupe_sql('s')} AS Notes FROM k""")
def prune_rare_terms(t: Tables):
    train = docs(t).where(split_label(F.col("doc_id")) == "train")
    return features.prune_rare_words(train, "Notes", features.frequent_terms(train, word_tokens(F.col("Notes"))))


@query(f"WITH {GRAMS_SQL} SELECT term, CAST(n AS INTEGER) AS n, CAST(row_number() OVER (ORDER BY n, term) - 1 AS INTEGER) AS idx FROM v")
def ngram_vocab(t: Tables):
    rows = [(i, term, len(term.split(" "))) for i, term in enumerate(features.fit_ngram_vocabulary(docs(t), "Notes"))]
    return t.spark.createDataFrame(rows, "idx int, term string, n int")


@query(f"WITH {GRAMS_SQL} SELECT g.doc_id, g.term FROM g JOIN v ON g.term = v.term")
def presence_matrix(t: Tables):
    vocabulary = features.fit_ngram_vocabulary(docs(t), "Notes")
    return features.presence(docs(t), ["doc_id"], "Notes", vocabulary)


@query(f"""
WITH {GRAMS_SQL} SELECT 'selected' AS terms_of, CAST(n AS INTEGER) AS n, count(*) AS terms FROM v GROUP BY 2
UNION ALL SELECT 'all', CAST(n AS INTEGER), count(DISTINCT term) FROM g GROUP BY 2""")
def ngram_len_counts(t: Tables):
    notes = materialise(docs(t))
    every = features.distinct_terms(notes, word_tokens(F.col("Notes")), high=3)
    vocabulary = features.fit_ngram_vocabulary(notes, "Notes")
    chosen = t.spark.createDataFrame([(v,) for v in vocabulary], "term string")
    return (report.length_counts(chosen).withColumn("terms_of", F.lit("selected"))
            .unionByName(report.length_counts(every).withColumn("terms_of", F.lit("all"))))


PEOPLE_SQL = """
p AS (SELECT c_custkey, CAST(18 + (c_custkey * 37) % 70 AS INTEGER) AS age,
      ('0x' || substr(md5(CAST(c_custkey AS VARCHAR)), 1, 8))::BIGINT % 10 < 7 AS train FROM customer),
q AS (SELECT c_custkey, train, CASE WHEN train THEN age ELSE age // 2 + 5 END AS age FROM p),
s AS (SELECT min(age) FILTER (train) AS lo, max(age) FILTER (train) AS hi,
      min(age) FILTER (NOT train) AS own_lo, max(age) FILTER (NOT train) AS own_hi FROM q)"""


def people(t: Tables):
    age = (18 + (F.col("c_custkey") * 37) % 70).cast("int")
    rows = with_split(t.customer.select("c_custkey", age.alias("age")), "c_custkey")
    # the other side covers another age range
    return rows.withColumn("age", F.when(F.col("split") == "train", F.col("age")).otherwise(
        F.floor(F.col("age") / 2) + 5).cast("int"))


@query(f"WITH {PEOPLE_SQL} SELECT c_custkey, round(CAST(age - lo AS DOUBLE) / (hi - lo), 6) AS age_scaled FROM q, s WHERE train")
def scale_train(t: Tables):
    train = people(t).where("split = 'train'")
    low, high = features.train_range(train, "age")
    return train.select("c_custkey", F.round(features.scale(F.col("age"), low, high), 6).alias("age_scaled"))


@query(f"""
WITH {PEOPLE_SQL} SELECT c_custkey, round((round_even(CAST(age - own_lo AS DOUBLE) / ((own_hi - own_lo) / CAST(hi - lo AS DOUBLE)) + lo, 0) - lo)
  / (hi - lo), 6) AS age_scaled FROM q, s WHERE NOT train""")
def scale_rerange(t: Tables):
    both = people(t)
    train, test = both.where("split = 'train'"), both.where("split = 'test'")
    low, high = features.train_range(train, "age")
    own_low, own_high = features.train_range(test, "age")
    return test.select("c_custkey", F.round(
        features.rerange(F.col("age"), own_low, own_high, low, high), 6).alias("age_scaled"))
