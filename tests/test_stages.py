import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from chartloom.operators import extract, notes, report
from chartloom.operators.stems import StemStore
from chartloom.plans import stages
from chartloom.schemas import ADMISSION_KEYS, ADMISSIONS, NOTE_LINES, VISIT_KEYS
from chartloom.sources.tables import parse_dates, read_note_lines, read_terms, write_csv, write_stage


def admissions(spark, rows):
    """(patient, sex, age, admit, discharge, mrs, follow-up date, mrs at follow-up)"""
    full = [(p, "Non-Hispanic", sex, age, "White", admit, discharge, float(mrs), "Home", "Ischemic Stroke", fup,
             None if later is None else float(later)) for p, sex, age, admit, discharge, mrs, fup, later in rows]
    return parse_dates(spark.createDataFrame(full, ADMISSIONS))


def lines(spark, rows):
    return parse_dates(spark.createDataFrame(rows, NOTE_LINES))


def test_note_lines_file_is_windows_1252(spark, tmp_path):
    (tmp_path / "notes.csv").write_bytes(
        'PatientID,NoteID,LineNBR,ContactDTS,InpatientNoteTypeDSC,NoteTXT\n'
        '1,10,1,1/4/2017,,"said “fine”, ""ok""\nsecond line"\n1,10,2,10/14/2019,Discharge Summary,\n'.encode("cp1252"))
    rows = parse_dates(read_note_lines(spark, str(tmp_path), NOTE_LINES)).orderBy("LineNBR").collect()
    assert rows[0].NoteTXT == 'said “fine”, "ok"\nsecond line' and rows[0].ContactDTS == dt.date(2017, 1, 4)
    assert rows[1].ContactDTS == dt.date(2019, 10, 14) and rows[1].NoteTXT is None


def test_sinks_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a, b", 0), (2, None, 1)], "id int, t string, follow_up int")
    back = write_stage(df, str(tmp_path / "stage"), ["follow_up"])
    assert sorted(map(tuple, back.select("id", "t").collect()), key=str) == [(1, "a, b"), (2, None)]
    write_csv(df, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 2
    (tmp_path / "stop.txt").write_text("the\n\n of \nthe\n")
    assert read_terms(spark, str(tmp_path / "stop.txt")) == ["of", "the"]


def test_cohort_edges(spark):
    people = admissions(spark, [(1, "Male", 18, "1/10/2017", "1/12/2017", 3, "3/1/2017", 2), (2, "Male", 17, "1/10/2017", "1/12/2017", 3, None, None),
                                (3, "Female", 17, "1/10/2017", "1/12/2017", 3, "3/1/2017", 1)])
    days = ["1/9/2017", "1/10/2017", "1/12/2017", "1/13/2017", "3/1/2017", "3/2/2017"]
    body = lines(spark, [(p, p * 10 + i, 1, d, None, "x") for p in (1, 2, 3) for i, d in enumerate(days)])
    inside = notes.discharge_lines(people, body)
    assert sorted(r.NoteID for r in inside.collect()) == [11, 12]
    later = notes.follow_up_lines(people, body)
    assert sorted(r.NoteID for r in later.collect()) == [11, 12, 13, 14, 31, 32, 33, 34]
    assert {(r.PatientID, r.mrs) for r in later.collect()} == {(1, 2.0), (3, 1.0)}


def test_typed_notes(spark):
    people = admissions(spark, [(1, "Male", 60, "1/10/2017", "1/20/2017", 3, None, None)])
    body = lines(spark, [
        # an OT prefix on the first line lifts the whole note; lines come out of order
        (1, 10, 2, "1/18/2017", None, "walks walks well"), (1, 10, 1, "1/18/2017", None, "MGH Occupational Therapy: 12"),
        # an older OT note is not the latest
        (1, 11, 1, "1/15/2017", "PHS IP OT Discharge Box", "older"),
        # the discharge-summary tag holds for its own line only
        (1, 12, 1, "1/19/2017", "Discharge Summary", "summary text"), (1, 12, 2, "1/19/2017", None, "untagged"),
        # what remains; two notes on the latest day are both kept
        (1, 13, 1, "1/20/2017", None, "late a"), (1, 14, 1, "1/20/2017", "Progress", None), (1, 15, 1, "1/11/2017", None, "early")])
    got = {r.NoteID: r for r in notes.typed_notes(notes.discharge_lines(people, body), follow_up=False).collect()}
    assert {k: v.Notes for k, v in got.items()} == {
        10: "MGH Occupational Therapy: 12 walks well", 12: "summary text", 13: "late a", 14: ""}
    assert (got[10].OT_days, got[10].PT_days, got[10].DS_days, got[10].DD_days) == (2, None, 1, 0)
    assert [got[k].type_rank for k in (10, 12, 13)] == [1, 3, 4]


def test_note_in_two_types_counts_once_when_texts_agree(spark):
    people = admissions(spark, [(1, "Male", 60, "1/10/2017", "1/20/2017", 3, None, None)])
    body = lines(spark, [(1, 10, 1, "1/18/2017", "Discharge Summary", "Physical therapy eval")])
    typed = notes.typed_notes(notes.discharge_lines(people, body), follow_up=False)
    assert [(r.Notes, r.type_rank) for r in typed.collect()] == [("Physical therapy eval", 2)]
    clean = notes.normalise_notes(typed, ["the"])
    assert clean.first().Notes == "physic therapi eval"
    store = StemStore(spark)
    assert notes.normalise_notes(typed, ["the"], stems=store).collect() == clean.collect()
    assert {r.token for r in store.read().collect()} == {"physical", "therapy", "eval"}


def test_types_like_lines_typed_one_by_one(spark):
    """Against `assign_types` and plain Python: null ids, dates and texts, repeated lines, notes over several days."""
    people = admissions(spark, [(1, "Male", 60, "1/10/2017", "1/20/2017", 3, None, None), (1, "Male", 60, "1/12/2017", "1/22/2017", 2, None, None),
                                (2, "Female", 70, "1/1/2017", "1/30/2017", 1, None, None)])
    rng = random.Random(5)
    tags = [None, None, None, "PHS IP OT Discharge Box", "PHS IP PT Discharge Box", "Discharge Summary", "Progress"]
    texts = ["x", "y y", None, "", "Physical therapy eval", "Occupational Therapy 3"]
    rows = [(rng.choice([1, 1, 1, 2]), rng.choice([None, *range(12)]), rng.choice([1, 2, 3, None]), f"1/{rng.randint(8, 24)}/2017",
             rng.choice(tags), rng.choice(texts)) for _ in range(160)]
    cohort = notes.discharge_lines(people, lines(spark, rows + rows[:20]))
    latest, pieces = {}, {}
    for r in notes.assign_types(cohort, False).collect():
        admission = tuple(r[k] for k in ADMISSION_KEYS)
        if None in admission:
            continue
        day = latest.get((admission, r.kind))
        if day is None or r.ContactDTS > day:
            latest[admission, r.kind] = r.ContactDTS
        pieces.setdefault((admission, r.kind, r.NoteID, r.ContactDTS), []).append((r.LineNBR is not None, r.LineNBR or 0, r.NoteTXT or ""))
    wanted, dates = {}, {}
    for (admission, kind, note, day), parts in pieces.items():
        if note is None or latest[admission, kind] != day:
            continue
        words = " ".join(t for _, _, t in sorted(parts)).split()
        text = " ".join(w for i, w in enumerate(words) if i == 0 or w != words[i - 1])
        place = notes.NOTE_TYPES.index(kind) + 1
        key = (admission, note, text)
        wanted[key] = min(place, wanted.get(key, 9))
        dates[admission, kind] = (admission[ADMISSION_KEYS.index("HospitalDischargeDTS")] - day).days
    got = notes.typed_notes(cohort, False).collect()
    assert len(got) == len(wanted) > 10
    for r in got:
        admission = tuple(r[k] for k in ADMISSION_KEYS)
        assert wanted[admission, r.NoteID, r.Notes] == r.type_rank
        assert [r[f"{k}_days"] for k in notes.NOTE_TYPES] == [dates.get((admission, k)) for k in notes.NOTE_TYPES]


def test_typing_reads_the_lines_once(spark, tmp_path):
    people = admissions(spark, [(1, "Male", 60, "1/10/2017", "1/20/2017", 3, None, None)])
    notes.discharge_lines(people, lines(spark, [(1, 10, 1, "1/18/2017", None, "x")])).write.parquet(str(tmp_path / "lines"))
    df = notes.typed_notes(spark.read.parquet(str(tmp_path / "lines")), False)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and "Join" not in plan and df.count() == 1


def test_extraction_modes(spark):
    days = [(1, 5, 20), (1, 5, 5), (1, 5, 31)]
    df = spark.createDataFrame(days, "p int, q int, days int")
    assert sorted(r.days for r in extract.closest(df, ["p"], "days").collect()) == [5, 20]
    assert [r.days for r in extract.closest(df, ["p"], "days", mode="closest").collect()] == [5]


def test_note_split_by_flag(spark):
    people = admissions(spark, [(1, "Male", 60, "1/10/2017", "1/20/2017", 3, "2/10/2017", 2)])
    body = lines(spark, [(1, 10, 1, "2/1/2017", None, "Patient expired today"), (1, 10, 2, "2/1/2017", None, "x] 2 slight disability")])
    late = notes.follow_up_lines(people, body)
    assert sorted(r.mrs for r in extract.tick_extractions(late).collect()) == [2, 6]
    assert [r.mrs for r in extract.tick_extractions(late, merge_flags=True).collect()] == [6]


WORDS = {0: "well walking independent", 1: "well walking mild", 2: "slight walking help", 3: "moderate help cane",
         4: "moderate severe bed", 5: "severe bed bound", 6: "comfort care withdrawn"}


@pytest.fixture(scope="module")
def world(spark):
    rng = random.Random(4)
    people, body = [], []
    for p in range(1, 61):
        score, later = p % 7, (p + 1) % 6
        start = dt.date(2018, 1, 1) + dt.timedelta(days=p)
        day = [(start + dt.timedelta(days=d)) for d in (0, 5, 30)]
        text = [f"{d.month}/{d.day}/{d.year}" for d in day]
        followed = p % 4 == 0
        people.append((p, "Male" if p % 2 else "Female", 20 + p, text[0], text[1], score, text[2] if followed else None,
                       later if followed else None))
        for k in range(3):
            words = [rng.choice(WORDS[score].split()) for _ in range(20)]
            body.append((p, p * 100, k, text[1], "Discharge Summary", " ".join(words) + " w/out fever."))
        if followed:
            body.append((p, p * 100 + 1, 1, text[2], None, f"mRS score: {later} today. " + WORDS[later]))
            body.append((p, p * 100 + 1, 2, text[2], None, " ".join(rng.choice(WORDS[later].split()) for _ in range(30))))
    tables = stages.prepare_notes(admissions(spark, people), lines(spark, body), ["the", "of"])
    return tables, stages.prepare_model_tables(tables.clean, min_tokens=5)


def test_stages_to_reports(spark, world):
    tables, model_tables = world
    clean = tables.clean.collect()
    assert {r.follow_up for r in clean} == {0, 1} and any("fever" in r.Notes for r in clean)
    patients = [{r.PatientID for r in side.select("PatientID").collect()} for side in (model_tables.train, model_tables.test)]
    assert patients[0] and patients[1] and not patients[0] & patients[1]
    assert all(len(t.split()) <= 3 for t in model_tables.vocabulary) and "walk" in model_tables.vocabulary

    scores = extract.extract_scores(tables.follow_up_lines, tables.clean)
    found = {r.PatientID: r.mrs_extractions for r in scores.collect()}
    assert found == {p: float((p + 1) % 6) for p in range(4, 61, 4)}

    _, scored = stages.linear_predictions(model_tables.train, model_tables.test, scores, VISIT_KEYS)
    rows = scored.select("PatientID", "follow_up", "mrs", "Expired", "y_pred").collect()
    assert all(0 <= r.y_pred <= 6 for r in rows)
    assert all(r.y_pred == 6 for r in rows if r.Expired == 1 and r.follow_up == 0)
    assert all(r.y_pred == r.mrs for r in rows if r.follow_up == 1)
    flat = spark.createDataFrame([(i, r.mrs, r.y_pred, i % 50) for i, r in enumerate(rows)], "id int, mrs double, y_pred double, days int")
    summary = stages.linear_report(flat, "id", replicates=50).first()
    assert summary.rmse_lo <= summary.rmse <= summary.rmse_hi and summary.spearman > 0.5
    assert report.regression_by_band(flat, "id", "mrs", "y_pred", "days", replicates=20).count() >= 3


def test_binary_stage(spark, world):
    tables, model_tables = world
    _, threshold, scored = stages.binary_predictions(model_tables.train, model_tables.test, None, VISIT_KEYS, 1.0, harden_expired=True)
    rows = scored.select("y", "y_hard", "zero", "one", "Expired").collect()
    assert 0 < threshold < 1 and all(r.one == 1.0 and r.y_hard == 1 for r in rows if r.Expired == 1)
    assert sum(r.y == r.y_hard for r in rows) / len(rows) > 0.7


def test_recency(spark, world):
    tables, _ = world
    typed = tables.discharge_typed
    predictions = typed.select("PatientID", "HospitalAdmitDTS", "HospitalDischargeDTS").distinct().withColumns(
        {"follow_up": F.lit(0), "y_pred": F.lit(1.0)})
    keys = ["PatientID", "HospitalAdmitDTS", "HospitalDischargeDTS"]
    out = report.attach_recency(predictions, typed, typed, keys, keys, ["OT_days", "PT_days", "DS_days", "DD_days"], ["PatientID", "y_pred"])
    assert {r.nmin for r in out.collect()} == {0} and out.count() == 60


def test_external_arrangement(spark):
    rows = [(1, "M", "6 - Deceased", 0, 7, "b"), (1, "M", "6 - Deceased", 0, 5, "a"), (2, "F", "Deceased", 1, 1, "c")]
    df = spark.createDataFrame(rows, "id int, gender string, mrs string, follow_up int, NoteID int, Notes string")
    got = {r.id: (r.gender, r.Notes, r.Expired) for r in notes.arrange_external(df).collect()}
    assert got == {1: (0, "a b", 1), 2: (1, "c", 0)}
