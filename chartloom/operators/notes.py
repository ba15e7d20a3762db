"""Note typing, selection of the latest notes, and note text per admission."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from chartloom.functions import labels, lexicon, text
from chartloom.functions.stem import stem_text
from chartloom.operators.grouping import concat_ordered, having_total, latest_per_group
from chartloom.operators.joins import adults, interval_join
from chartloom.operators.stems import StemStore, stem_by_vocabulary
from chartloom.schemas import ADMISSION_KEYS, DOCUMENT_KEYS

# in the order in which texts of one note are put together
NOTE_TYPES = ["OT", "PT", "DS", "DD"]


def discharge_lines(admissions: DataFrame, notes: DataFrame) -> DataFrame:
    """Lines written during the stay, adults only; the outcome is the score at discharge."""
    people = (adults(admissions)
              .withColumn("Date_mrs_post_discharge", F.col("HospitalDischargeDTS")).drop("mrs_90days"))
    return interval_join(people, notes, "PatientID", "ContactDTS", "HospitalAdmitDTS",
                         "HospitalDischargeDTS")


def follow_up_lines(admissions: DataFrame, notes: DataFrame) -> DataFrame:
    """Lines from admission to follow-up; the outcome is the score at follow-up. Admissions
    without a follow-up date drop out: a comparison with null is never true."""
    visits = admissions.withColumn("mrs", F.col("mrs_90days")).drop("mrs_90days")
    return interval_join(visits, notes, "PatientID", "ContactDTS", "HospitalAdmitDTS",
                         "Date_mrs_post_discharge")


def _starts_with_any(c: Column, prefixes: list[str]) -> Column:
    hit = c.startswith(prefixes[0])
    for prefix in prefixes[1:]:
        hit = hit | c.startswith(prefix)
    return hit


def line_types(note_text: Column, note_type: Column) -> dict[str, Column]:
    """What a single line says about its note. The prefixes are compared after site tags are
    removed, so those that begin with one can not match; as observed."""
    scratch = text.typing_text(note_text)
    tag = F.coalesce(note_type, F.lit(""))
    return {
        "is_ot": _starts_with_any(scratch, lexicon.OT_PREFIXES) | tag.contains(lexicon.OT_TAG),
        "is_pt": _starts_with_any(scratch, lexicon.PT_PREFIXES) | tag.contains(lexicon.PT_TAG),
        "is_ds": tag.contains(lexicon.DS_TAG),
    }


def assign_types(lines: DataFrame, follow_up: bool, *, note: str = "NoteID", note_text: str = "NoteTXT",
                 note_type: str = "InpatientNoteTypeDSC", contact: str = "ContactDTS",
                 admit: str = "HospitalAdmitDTS", discharge: str = "HospitalDischargeDTS",
                 outcome_date: str = "Date_mrs_post_discharge") -> DataFrame:
    """One row per line and type. OT and PT hold for all lines of a note once one line says so;
    DS holds for the tagged lines only; DD is what is left inside the date window. A note can
    have several types."""
    flagged = lines.withColumns(line_types(F.col(note_text), F.col(note_type)))
    # partial aggregation first: a note's lines are not gathered to decide its type
    by_note = (flagged.groupBy(note)
               .agg(F.max("is_ot").alias("note_ot"), F.max("is_pt").alias("note_pt"),
                    F.max("is_ds").alias("note_ds"))
               .where("note_ot or note_pt or note_ds"))
    low, high = (discharge, outcome_date) if follow_up else (admit, discharge)
    lifted = flagged.drop("is_ot", "is_pt").join(by_note, note, "left").na.fill(
        False, subset=["note_ot", "note_pt", "note_ds"])
    in_window = F.col(contact).between(F.col(low), F.col(high))
    kinds = F.array_compact(F.array(
        F.when(F.col("note_ot"), "OT"), F.when(F.col("note_pt"), "PT"), F.when(F.col("is_ds"), "DS"),
        F.when(in_window & ~(F.col("note_ot") | F.col("note_pt") | F.col("note_ds")), "DD")))
    return (lifted.withColumn("kind", F.explode(kinds))
            .drop("is_ds", "note_ot", "note_pt", "note_ds"))


def note_states(lines: DataFrame, follow_up: bool, *, keys: list[str] = ADMISSION_KEYS, note: str = "NoteID",
                line: str = "LineNBR", note_text: str = "NoteTXT", note_type: str = "InpatientNoteTypeDSC",
                contact: str = "ContactDTS", admit: str = "HospitalAdmitDTS", discharge: str = "HospitalDischargeDTS",
                outcome_date: str = "Date_mrs_post_discharge") -> DataFrame:
    """One row per note, admission and day: the day's types as `kinds`, the lines as a sorted array `pieces` of
    (line, text, whether it has the DS tag). The rules are those of `assign_types`.

    Lines are dealt by note once; the types of the whole note are a maximum over its rows where they lie. Lines
    without a note id count for their day but give no text, so that they need not be gathered: each day of an
    admission is a unit of its own for them.
    """
    low, high = (discharge, outcome_date) if follow_up else (admit, discharge)
    days = list(dict.fromkeys([*keys, low, high, contact]))
    said = line_types(F.col(note_text), F.col(note_type))
    # a note is dealt by its id; the hash that spreads lines without one is a constant elsewhere, which costs nothing on the way
    unit = F.when(F.col(note).isNull(), F.xxhash64(*days)).otherwise(F.lit(0).cast("long"))
    piece = F.when(F.col(note).isNotNull(), F.struct(
        F.col(line).alias("line"), F.coalesce(F.col(note_text), F.lit("")).alias("text"), said["is_ds"].alias("is_ds")))
    flagged = lines.select(unit.alias("_unit"), note, *days, *[c.alias(n) for n, c in said.items()], piece.alias("_piece"))
    by_day = (flagged.repartition(note, "_unit").groupBy("_unit", note, *days)
              .agg(*[F.max(n).alias(n) for n in said], F.array_sort(F.collect_list("_piece")).alias("pieces")))
    whole = Window.partitionBy("_unit", note)
    of_note = {n: F.max(n).over(whole) & F.col(note).isNotNull() for n in said}
    in_window = F.col(contact).between(F.col(low), F.col(high))
    typed = by_day.withColumns({f"_{n}": c for n, c in of_note.items()})
    kinds = F.array_compact(F.array(
        F.when(F.col("_is_ot"), "OT"), F.when(F.col("_is_pt"), "PT"), F.when(F.col("is_ds"), "DS"),
        F.when(in_window & ~(F.col("_is_ot") | F.col("_is_pt") | F.col("_is_ds")), "DD")))
    return typed.select(note, *days, kinds.alias("kinds"), "pieces")


def typed_notes(lines: DataFrame, follow_up: bool, *, keys: list[str] = ADMISSION_KEYS,
                note: str = "NoteID", line: str = "LineNBR", note_text: str = "NoteTXT",
                note_type: str = "InpatientNoteTypeDSC", contact: str = "ContactDTS",
                admit: str = "HospitalAdmitDTS", discharge: str = "HospitalDischargeDTS",
                outcome_date: str = "Date_mrs_post_discharge") -> DataFrame:
    """The latest notes of every type per admission as one text each, and for every type how many
    days before the outcome they were written. `lines` is read once; texts are tidied for the latest days only.
    """
    states = note_states(lines, follow_up, keys=keys, note=note, line=line, note_text=note_text, note_type=note_type,
                         contact=contact, admit=admit, discharge=discharge, outcome_date=outcome_date)
    reference = outcome_date if follow_up else discharge
    own = F.filter("pieces", lambda p: (F.col("kind") != "DS") | p["is_ds"])
    # a day travels to its admission as one text; there it stays, as whatever follows is grouped by admission and more. Notes
    # are dealt by their ids, so that a task before this holds few of an admission's days and could leave out few
    dealt = (states.withColumn("kind", F.explode("kinds")).na.drop(subset=[*keys, contact])
             .select(*dict.fromkeys([*keys, note, reference, contact]), "kind", F.array_join(F.transform(own, lambda p: p["text"]), " ").alias("_text"))
             .repartition(*keys))
    latest, whole = latest_per_group(dealt, [*keys, "kind"], contact), F.col("_text")
    rank = F.array_position(F.array(*[F.lit(k) for k in NOTE_TYPES]), F.col("kind"))
    texts = (latest.withColumn("days", F.datediff(F.col(reference), F.col(contact))).na.drop(subset=["days", note])
             .select(*keys, note, text.dedupe_words(text.collapse_whitespace(whole)).alias("Notes"), rank.alias("type_rank"), "kind", "days"))
    # every type of an admission has one date left: a window next to the texts stands for four outer joins
    admission = Window.partitionBy(*keys)
    pivoted = texts.withColumns({f"{k}_days": F.max(F.when(F.col("kind") == k, F.col("days"))).over(admission) for k in NOTE_TYPES})
    # the same text under two types counts once, at the place of the first
    per_type = [f"{k}_days" for k in NOTE_TYPES]
    distinct = pivoted.groupBy(*keys, note, "Notes", *per_type).agg(F.min("type_rank").alias("type_rank"))
    return distinct.select(*keys, note, "Notes", "type_rank", *per_type)


def normalise_notes(typed: DataFrame, stop_words: list[str], *, keys: list[str] = ADMISSION_KEYS,
                    note: str = "NoteID", stem: bool = True, stems: StemStore | None = None) -> DataFrame:
    """One normalised, stemmed text per admission and note. With `stems`, only words that the relation lacks are
    stemmed, and the normalised texts are written once, as chunks; without, each task stems its own words."""
    whole = concat_ordered(typed, [*keys, note], ["type_rank"], "Notes")
    clean = whole.withColumn("Notes", text.normalise_note(F.col("Notes"), stop_words))
    if stem:
        clean = (clean.withColumn("Notes", stem_text("Notes")) if stems is None
                 else stem_by_vocabulary(clean, "Notes", stems))
        clean = clean.withColumn("Notes", text.dedupe_words(text.collapse_whitespace(F.col("Notes"))))
    return clean


def arrange(notes: DataFrame, *, min_tokens: int = 300, keys: list[str] = ADMISSION_KEYS) -> DataFrame:
    """Drop admissions with too little text, one text per note, encode sex and death."""
    group = [*keys, "follow_up"]
    kept = having_total(notes.where(F.col("Notes").isNotNull()), group,
                        text.token_count(F.col("Notes")), min_tokens)
    merged = concat_ordered(kept, [*group, "NoteID"], [], "Notes")
    return (merged.withColumn("Expired", labels.expired_flag(F.col("mrs")))
            .withColumn("SexDSC", labels.encode_category(F.col("SexDSC"), labels.SEX_CODES)))


def arrange_external(notes: DataFrame, *, reset_follow_up: bool = True, sex: str | None = "gender",
                     outcome: str = "mrs", order: list[str] = ("NoteID",)) -> DataFrame:
    """The other site's variant: grouped by every column but the note, no minimum length. `outcome` is the
    label as the site writes it; `sex` is None where an adapter has coded it already."""
    keys = [c for c in notes.columns if c not in ("NoteID", "Notes")]
    docs = concat_ordered(notes, keys, list(order), "Notes")
    docs = docs.withColumn("Expired", labels.expired_flag_external(
        F.col(outcome).cast("string"), F.col("follow_up"), reset_follow_up))
    return docs if sex is None else docs.withColumn(sex, labels.encode_category(F.col(sex), labels.EXTERNAL_SEX_CODES))


def assemble_documents(notes: DataFrame, *, keys: list[str] = DOCUMENT_KEYS, note: str = "NoteID",
                       body: str = "Notes") -> DataFrame:
    """All notes of an admission as one document, in note order; empty notes are skipped."""
    return concat_ordered(notes.where(F.col(body) != ""), keys, [note], body)
