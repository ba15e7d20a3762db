"""Rule-based extraction of an explicit score from follow-up notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from chartloom.functions import lexicon
from chartloom.functions.rewrite import bind, replace_all, rewrite_all
from chartloom.functions.text import collapse_whitespace, dedupe_words, strip_special
from chartloom.operators.grouping import concat_ordered, latest_per_group, union_all
from chartloom.operators.joins import drop_listed_null_safe, keep_listed
from chartloom.schemas import VISIT_KEYS

# unicode classes, and `.` stops at a line feed only
_FLAGS = "(?Ud)"
# --- fixed values: a mention and its context --------------------------------------------------
# "rankin", an optional ":" and "?", one character of the class, then 1 to 50 more
MENTION = _FLAGS + r"(rankin:?\??[?)(\s\[\w].{1,50})"
MENTION_SEPARATOR = " -#- "
MENTION_NOISE = ["remained at", "of", "premorbid rankin"]
SCORE_WORDS = ["score", "scale", "Score", "Scale"]


def death_phrase(c: Column) -> Column:
    """1 where the line reports a death in so many words."""
    return F.coalesce(F.lower(c).rlike(lexicon.death_phrase_pattern()), F.lit(False)).cast("int")


def mark_deaths(c: Column) -> Column:
    """Rewrite the death patterns, in order, to the mark of score 6."""
    return rewrite_all(F.lower(c), [(_FLAGS + p, lexicon.DEATH_MARK) for p in lexicon.DEATH_PATTERNS])


def death_flag(original: Column, marked: Column) -> Column:
    """A literal mark in the note counts as well; as observed."""
    return F.greatest(death_phrase(original),
                      F.coalesce(F.contains(marked, F.lit(lexicon.DEATH_MARK)), F.lit(False)).cast("int"))


def checkbox_score(c: Column, death: Column | None = None) -> Column:
    """Score of the ticked box. Several ticks: the lowest score wins, because each rewrite hides
    the ones after it; the death flag beats every tick. Null without a tick."""
    def score(body: Column) -> Column:
        hits = [F.when(body.rlike("(?U)" + lexicon.tick_pattern(n, w)), n) for n, w in lexicon.TICK_WORDINGS]
        # a literal `mrs_N` in the note is taken for a tick too
        literal = [F.when(F.contains(body, F.lit(f"mrs_{n}")), n) for n in range(7)]
        return F.least(*hits, *literal)
    ticked = bind(F.lower(c), score)
    return ticked if death is None else F.when(death == 1, 6).otherwise(ticked)


def unify_terms(c: Column) -> Column:
    """One word for the score, without the words `score` and `scale` around it."""
    text = replace_all(strip_special(c), [(w, " ") for w in SCORE_WORDS])
    return F.replace(F.lower(collapse_whitespace(text)), F.lit("mrs"), F.lit("rankin"))


def drop_mention_noise(c: Column) -> Column:
    """Plain substrings: `of` also leaves the middle of words. As observed."""
    return replace_all(F.lower(c), [(w, " ") for w in MENTION_NOISE])


def mentions(c: Column) -> Column:
    """Every mention of the score with up to 50 characters of context, left to right."""
    return F.regexp_extract_all(F.lower(c), F.lit(MENTION), 1)


def mention_score(found: Column) -> Column:
    """Score of the mentions of one note. In the last mention the highest digit that follows the
    term wins; `rankin is N` anywhere beats it, again with the highest digit."""
    def highest(body: Column, prefix: str) -> Column:
        return F.coalesce(*[F.when(F.contains(body, F.lit(f"{prefix} {n}")), n) for n in range(5, -1, -1)])

    return bind(found, lambda m: F.coalesce(
        highest(F.array_join(m, MENTION_SEPARATOR), "rankin is"),
        highest(F.try_element_at(m, F.lit(-1)), "rankin")))


def tick_extractions(lines: DataFrame, *, keys: list[str] = VISIT_KEYS, horizon: int = 30,
                     merge_flags: bool = False) -> DataFrame:
    """Scores from ticked boxes and reports of death.

    The death flag belongs to the line and is part of the grouping, so a note with flagged and
    other lines becomes two rows; `merge_flags` lets one flagged line speak for the note.
    """
    marked = lines.withColumn("_marked", mark_deaths(F.col("NoteTXT")))
    flagged = marked.withColumn("mrs6", death_flag(F.col("NoteTXT"), F.col("_marked")))
    group = [*keys, "ContactDTS", "NoteID"]
    if merge_flags:
        per_note = flagged.groupBy(*group).agg(F.max("mrs6").alias("mrs6"))
        flagged = flagged.drop("mrs6").join(per_note, group)
    notes = concat_ordered(flagged, [*group, "mrs6"], ["LineNBR"], "_marked", out="Notes", dedupe=True)
    scored = notes.withColumn("mrs", checkbox_score(F.col("Notes"), F.col("mrs6")))
    late = F.datediff("Date_mrs_post_discharge", "HospitalDischargeDTS")
    return (scored.where(F.col("mrs").isNotNull() & (late <= horizon))
            .select(*keys, "NoteID", "mrs6", "Notes", "mrs").distinct())


def mention_notes(lines: DataFrame, *, keys: list[str] = VISIT_KEYS) -> DataFrame:
    """Lines after discharge, cleaned for mentions, put together per note."""
    after = lines.where(F.col("ContactDTS") >= F.col("HospitalDischargeDTS"))
    cleaned = (after.withColumn("Notes", unify_terms(F.coalesce("NoteTXT", F.lit(""))))
               .withColumn("DD_days", F.datediff("Date_mrs_post_discharge", "ContactDTS")))
    notes = concat_ordered(cleaned, [*keys, "ContactDTS", "DD_days", "NoteID", "mrs_90days"],
                           ["LineNBR"], "Notes")
    return notes.withColumn("Notes", dedupe_words(collapse_whitespace(drop_mention_noise(F.col("Notes")))))


def closest(df: DataFrame, keys: list[str], days: str, horizon: int = 30,
            mode: str = "as_observed") -> DataFrame:
    """Mentions near the follow-up. `as_observed` keeps every row within the horizon; `closest`
    also keeps only the nearest day per admission. The nearest day is looked for within the horizon: if it
    lies beyond, nothing is kept."""
    near = df.where(F.col(days) <= horizon)
    if mode == "closest":
        return latest_per_group(near, keys, days, descending=False)
    if mode != "as_observed":
        raise ValueError(f"unknown mode {mode!r}")
    return near


def mention_extractions(lines: DataFrame, *, keys: list[str] = VISIT_KEYS, horizon: int = 30,
                        mode: str = "as_observed") -> DataFrame:
    """Scores from mentions in running text."""
    found = (mention_notes(lines, keys=keys).withColumn("rankin", mentions(F.col("Notes")))
             .where(F.size("rankin") > 0).withColumn("mrs", mention_score(F.col("rankin"))))
    rows = found.select(*keys, "DD_days", "mrs_90days", "rankin", "mrs").distinct()
    return closest(rows, keys, "DD_days", horizon, mode).drop("DD_days").distinct()


def extract_scores(lines: DataFrame, clean_notes: DataFrame, *, mode: str = "as_observed") -> DataFrame:
    """Extracted follow-up scores: ticked boxes first, running text for the other admissions.

    `lines` are the follow-up lines with the follow-up score in `mrs`; it is read three times,
    so hand in a stage table.
    """
    follow_up = clean_notes.where(F.col("follow_up") == 1)
    ticked = tick_extractions(keep_listed(lines, follow_up, "NoteID"))
    everything = lines.withColumnRenamed("mrs", "mrs_90days")
    done_keys = [*VISIT_KEYS, "mrs_90days"]
    done = keep_listed(everything, ticked, "NoteID").select(*done_keys)
    rest = drop_listed_null_safe(everything, done, done_keys).where(F.col("mrs_90days") != 6)
    spoken = mention_extractions(rest, mode=mode)
    columns = [*VISIT_KEYS, "mrs"]
    both = union_all(spoken.select(*columns).distinct(), ticked.select(*columns).distinct())
    return (both.where(F.col("mrs").isNotNull())
            .withColumn("mrs_extractions", F.col("mrs").cast("double")).drop("mrs"))


def one_score_per_visit(extractions: DataFrame, keys: list[str]) -> DataFrame:
    """The left join that applies scores needs a key at most once; a visit with several
    extracted scores keeps the highest."""
    return extractions.groupBy(*keys).agg(F.max("mrs_extractions").alias("mrs_extractions"))
