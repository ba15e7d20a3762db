"""The other site: adapter, rejects, preparation and models, on hand-made rows."""

import datetime as dt

from pyspark.sql import functions as F

from chartloom.functions import labels
from chartloom.operators import features
from chartloom.plans import stages
from chartloom.sources.adapters import SiteAdapter, adapt, text_age

LINES = ("PatientID long, gender string, Age int, admission date, discharge date, Date_mrs_post_discharge date, mrs_discharge string, "
         "NoteID long, LineNBR int, ContactDTS date, InpatientNoteTypeDSC string, NoteTXT string")


def test_unread_values_are_rejects(spark):
    site = SiteAdapter(columns={"sex": "gender", "years": "age", "mrs": "score", "wording": "score"}, codes={"sex": {"M": 0, "F": 1}},
                       readers={"years": text_age, "mrs": labels.normalise_label}, required=("mrs",))
    rows = [(1, "M", "41", "4 - Moderately severe", "x"), (2, " F ", ">89", "Deceased", "y"), (3, "X", "41", "3", "z"), (4, "F", "old", "n/a", None),
            (5, None, None, "6 - Deceased", "n"), (6, "M", "41", None, "n"), (7, "M", "", " ", "n"), (8, "m", "-1", "2 - x", "n")]
    df = spark.createDataFrame(rows, "id int, gender string, age string, score string, note string")
    got = adapt(df, site, ["id"])
    assert got.rows.columns == ["id", "note", "sex", "years", "mrs", "wording"]
    assert sorted(map(tuple, got.rows.collect())) == [
        (1, "x", 0, 41, 4.0, "4 - Moderately severe"), (2, "y", 1, 90, 6.0, "Deceased"), (5, "n", None, None, 6.0, "6 - Deceased")]
    assert sorted(map(str, map(tuple, got.rejects.collect()))) == sorted(map(str, [
        (3, "sex", "X"), (4, "mrs", "n/a"), (4, "years", "old"), (6, "mrs", None), (7, "mrs", " "), (8, "sex", "m"), (8, "years", "-1")]))
    assert got.rows.count() + got.rejects.select("id").distinct().count() == len(rows)
    plan = got.rows._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_rejects_are_named_by_what_the_site_wrote(spark):
    site = SiteAdapter(columns={"sex": "gender"}, codes={"sex": {"M": 0}})
    df = spark.createDataFrame([("M",), ("Q",)], "gender string")
    assert [tuple(r) for r in adapt(df, site, ["sex"]).rejects.collect()] == [("Q", "sex", "Q")]
    assert adapt(df.limit(0), site, ["sex"]).rows.collect() == []


def site_lines(spark, follow_up):
    day = dt.date(2020, 1, 1)
    out = []
    for p in range(40):
        gender = "X" if p == 39 else "MF"[p % 2]
        label = "unclear" if p == 38 else "6 - Deceased" if p % 10 == 9 else f"{p % 6} - in words"
        words = "walks alone home" if p % 6 < 3 else "bed bound total care"
        contact = day + dt.timedelta(days=3 + 60 * follow_up)
        for line, text in enumerate((f"Summary visit {words}", "fever noted")):
            out.append((p, gender, 20 + p, day, day + dt.timedelta(days=5), day + dt.timedelta(days=90), label, 100 + p, line, contact,
                        "Discharge Summary", text))
    return spark.createDataFrame(out, LINES)


def test_the_other_site_end_to_end(spark):
    own = stages.prepare_external(site_lines(spark, 0), site_lines(spark, 1), [], stem=False)
    docs = {(r.PatientID, r.follow_up): r for r in own.docs.collect()}
    assert len(docs) == 76 and {p for p, _ in docs} == set(range(38))
    assert sorted(map(tuple, own.rejects.select("PatientID", "field", "value", "follow_up").collect())) == [
        (38, "mrs", "unclear", 0), (38, "mrs", "unclear", 1), (39, "SexDSC", "X", 0), (39, "SexDSC", "X", 1)]
    r = docs[9, 0]
    assert (r.SexDSC, r.mrs, r.Expired) == (1, 6.0, 1) and docs[9, 1].Expired == 0 and docs[1, 0].mrs == 1.0
    assert "bed bound" in docs[4, 0].Notes and "fever noted" in docs[4, 0].Notes
    assert own.discharge_typed.select("DS_days").distinct().first()[0] == 2 and own.follow_up_typed.select("DS_days").distinct().first()[0] == 27

    train = own.docs.where("follow_up = 0").withColumn("Age", F.col("Age") * 2)
    vocabulary = features.fit_ngram_vocabulary(train, "Notes")
    fitted = stages.vector_table(train, train, vocabulary, rerange=False)
    other = stages.external_vectors(own.docs.where("follow_up = 1"), train, vocabulary)
    assert other.agg(F.min("Age_scaled"), F.max("Age_scaled")).first()[:] == (0.0, 1.0)
    _, scored = stages.linear_predictions(fitted, other, None, ["PatientID"])
    rows = scored.collect()
    assert len(rows) == 38 and all(0 <= r.y_pred <= 6 for r in rows)
    assert sum((r.y_pred > 2.5) == (r.mrs > 2.5) for r in rows) > 30
    _, _, hard = stages.binary_predictions(fitted, own_side(fitted), None, ["PatientID"], 1.0, harden_expired=True)
    assert all(r.one == 1.0 for r in hard.where("Expired = 1").collect())


def own_side(fitted):
    return fitted.where("Expired = 1")
