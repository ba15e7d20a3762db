"""Counting n-grams: a task's share does not grow with the table, and nothing travels that need not."""

from pyspark.sql import functions as F

from chartloom.functions import rewrite, text
from chartloom.operators import extract, features, joins, notes
from chartloom.functions.text import ngram_range, word_tokens


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def words(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, Notes string")


def test_term_counts_of_repeated_keys_and_empty_texts(spark):
    df = words(spark, ["a b a", None, "", "b"]).unionByName(spark.createDataFrame([(0, "a"), (None, "c c")], "doc_id long, Notes string"))
    got = features.term_counts(df, ["doc_id"], word_tokens(F.col("Notes")))
    assert {tuple(r) for r in got.collect()} == {(0, "a", 3), (0, "b", 1), (3, "b", 1), (None, "c", 2)}


def test_partitions_grow_with_the_terms(spark, monkeypatch):
    monkeypatch.setattr(features, "TERMS_A_TASK", 10)
    df, terms = words(spark, ["a b c d e f g h i j"] * 40), word_tokens(F.col("Notes"))
    assert features.partitions_for(df, terms) == 40
    counted = features.term_counts(df, ["doc_id"], terms)
    assert "hashpartitioning(doc_id" in plan(counted) and plan(counted).count("Exchange") == 1   # terms travelled before
    assert sorted(r["term"] for r in features.distinct_terms(df, terms).collect()) == list("abcdefghij")
    assert features.distinct_terms(df, ngram_range(terms)).count() == 27


def test_replacements_see_the_ones_before(one):
    assert one(lambda c: rewrite.replace_all(c, [("ab", "c"), ("cc", "x"), ("é", "ab")]), "ababé") == "xab"
    assert one(lambda c: rewrite.replace_all(c, [("a", "b")]), None) is None


def test_a_chain_of_replacements_is_one_step(spark):
    df = spark.createDataFrame([("a",)], "v string").select(text.contract_phrases(F.col("v")).alias("v"))
    assert plan(df).count("replace(") == 0                # 100 native searches before


def test_joined_ngrams(one):
    assert one(lambda c: text.joined_ngrams(word_tokens(c), 2), "A b c") == "a b|b c"
    assert [one(lambda c: text.joined_ngrams(word_tokens(c), 3), v) for v in ("a b", "", None)] == ["", "", ""]


def test_closest_looks_within_the_horizon_before_it_ranks(spark):
    df = spark.createDataFrame([(1, 40), (1, 30), (1, 30), (2, 31), (3, None), (4, -2), (4, 0)], "k int, days int")
    got = extract.closest(df, ["k"], "days", 30, "closest")
    assert sorted(map(tuple, got.collect())) == [(1, 30), (1, 30), (4, -2)]
    assert sorted(map(tuple, extract.closest(df, ["k"], "days", 30).collect())) == [(1, 30), (1, 30), (4, -2), (4, 0)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Window") < plan.index("<= 30")


def test_a_day_travels_once_to_its_note_and_once_to_its_admission(spark):
    schema = ("PatientID int, ContactDTS date, HospitalAdmitDTS date, HospitalDischargeDTS date, Date_mrs_post_discharge date, "
              "NoteID int, LineNBR int, NoteTXT string, InpatientNoteTypeDSC string")
    typed = notes.typed_notes(spark.createDataFrame([], schema), False, keys=["PatientID", "HospitalAdmitDTS"])
    plan = typed._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 2


def test_a_task_of_a_join_sorts_a_bounded_share(spark, monkeypatch):
    df = spark.range(1000).select((F.col("id") % 300).alias("key"))
    assert joins.dealt(df, "key") is df
    monkeypatch.setattr(joins, "LINES_A_TASK", 50)
    more = joins.dealt(df, "key")
    assert more.rdd.getNumPartitions() == 20
    assert more.groupBy("key").count().orderBy("key").collect() == df.groupBy("key").count().orderBy("key").collect()
