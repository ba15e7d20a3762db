"""The stored relation of stems, and texts rebuilt from it on both paths."""

import pytest
from pyspark.sql import functions as F

from chartloom.functions.stem import stem_text, stem_word
from chartloom.operators import stems

SCHEMA = "id long, token string, text string, `a.b` int, rest string, digest string"
TEXTS = ["discussed preferred languages", "", None, "walks  walking walked", " walks ", "rationally relational conditional",
         "skies dying sky", "walks walking walked", "walks walking walked", "é ß naïve running", "same " * 5000 + "endings"]


def table(spark):
    return spark.createDataFrame([(i, "t", text, i, "r", None) for i, text in enumerate(TEXTS)], SCHEMA)


@pytest.mark.parametrize("limit", [0, stems.BROADCAST_BYTES])
def test_like_the_stemmer_word_by_word(spark, limit):
    df = table(spark)
    got = stems.stem_by_vocabulary(df, "text", broadcast_bytes=limit)
    assert got.columns == df.columns
    wanted = df.withColumn("text", stem_text("text")).orderBy("id").collect()
    assert got.orderBy("id").collect() == wanted


@pytest.mark.parametrize("limit", [0, stems.BROADCAST_BYTES])
def test_no_rows_one_column_and_repeated_rows(spark, limit):
    assert stems.stem_by_vocabulary(table(spark).limit(0), "text", broadcast_bytes=limit).count() == 0
    only = spark.createDataFrame([("walking",)] * 3 + [(None,)] * 2, "text string")
    got = stems.stem_by_vocabulary(only, "text", broadcast_bytes=limit).collect()
    assert sorted(str(r.text) for r in got) == ["None", "None", "walk", "walk", "walk"]


def test_only_new_words_are_stemmed(spark, tmp_path):
    store = stems.StemStore(spark, str(tmp_path / "relation"))
    store.learn(spark.createDataFrame([("walking dogs",), ("dogs barked",)], "text string"), "text")
    # an entry of its own shows that a known word is not stemmed again
    spark.createDataFrame([("running", "own")], stems.RELATION).write.mode("append").parquet(store.path)
    before = set(store.spark.read.parquet(store.path).inputFiles())
    store.learn(spark.createDataFrame([("dogs running",), ("skies",), (None,)], "text string"), "text")
    added = [f for f in store.spark.read.parquet(store.path).inputFiles() if f not in before]
    assert [tuple(r) for r in store.spark.read.parquet(*added).collect()] == [("skies", "sky")]
    # a second store on the same folder goes on with it
    again = stems.StemStore(spark, store.path)
    known = {r.token: r.stem for r in again.read().collect()}
    assert known == {"running": "own", "skies": "sky", **{w: stem_word(w) for w in ("walking", "dogs", "barked")}}
    rebuilt = stems.rebuild(spark.createDataFrame([("running unknowns",)], "text string"), "text", again)
    assert rebuilt.first().text == "own unknowns"


def test_two_writers_leave_one_row_a_word(spark):
    store = stems.StemStore(spark)
    for _ in range(2):
        spark.createDataFrame([("walking", "walk")], stems.RELATION).write.mode("append").parquet(store.path)
    assert store.read().count() == 1 and store.n_bytes() == len("walkingwalk")


def test_a_hot_word_meets_the_relation_once(spark):
    df = spark.range(2000).select(F.concat(F.lit("the walking "), F.col("id").cast("string")).alias("text"))
    store = stems.StemStore(spark)
    store.learn(df, "text")
    assert store.read().count() == 2002
    got = stems.rebuild_by_position(df, "text", store)
    assert got.where("text LIKE 'the walk %'").count() == 2000


def test_a_word_travels_once_per_chunk(spark, monkeypatch):
    df = spark.range(3000).select("id", F.concat(F.lit("the walking dogs "), F.col("id").cast("string")).alias("text")).coalesce(2)
    store = stems.StemStore(spark)
    chunks = stems.chunked(df, "text")
    assert chunks.count() == 2 and chunks.select(F.explode("words")).count() == 3000 + 2 * 3
    store.learn_tokens(chunks.select(F.explode("words").alias("token")).distinct())
    got = stems.rebuild_chunks(chunks, df, "text", store, broadcast_bytes=-1)
    assert got.orderBy("id").collect() == df.withColumn("text", stem_text("text")).orderBy("id").collect()
    # short chunks hold the same rows in the same way, a text beyond the limit included
    small = stems.chunked(table(spark), "text", chunk_bytes=40)
    assert small.count() > 3
    got = stems.rebuild_chunks(small, table(spark), "text", store, broadcast_bytes=-1)
    assert got.count() == len(TEXTS) and got.where("id = 4").first().text == "walks"


def test_no_row_per_word_of_a_text(spark):
    """Only the chunks' lists of words meet the relation."""
    df = spark.range(50).select(F.repeat(F.lit("walking dogs "), 400).alias("text")).coalesce(1)
    store = stems.StemStore(spark)
    got = stems.stem_by_vocabulary(df, "text", store, broadcast_bytes=0)
    assert got.distinct().collect() == [(("walk dog " * 400).strip(),)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode(words" in plan and "split(" not in plan
