"""Catalog: another site's tables under our names and codes, its documents, its models and their recency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from chartloom.functions import labels
from chartloom.operators import bootstrap, features, grouping, joins, models, notes, report
from chartloom.plans.modelling import NUMERIC
from chartloom.plans.registry import Tables, query
from chartloom.plans.relational import stays
from chartloom.plans.stages import binary_predictions, linear_predictions, linear_report
from chartloom.plans.texts import plain, quoted
from chartloom.sources.adapters import SiteAdapter, adapt, text_age
from chartloom.sources.checkpoints import materialise

# the other site's wording: documents in the role of its admissions
GENDERS = ["M", "F", " M ", "U", "F", None, "m"]
LABELS = ["0 - No symptoms", "1 - No significant disability", "2 - Slight disability", "3 - Moderate disability",
          "4 - Moderately severe disability", "5 - Severe disability", "6 - Deceased", "Deceased", "3", "n/a", ""]
AGES = ["41", ">89", " 57", "unknown", "18", "102"]
SITE = SiteAdapter(columns={"SexDSC": "gender", "Age": "age", "mrs": "mrs_discharge", "label": "mrs_discharge"},
                   codes={"SexDSC": labels.EXTERNAL_SEX_CODES}, readers={"mrs": labels.normalise_label, "Age": text_age}, required=("mrs",))


def pick_sql(values: list[str | None], number: str) -> str:
    return f"list_extract([{', '.join('NULL' if v is None else quoted(v) for v in values)}], CAST({number} % {len(values)} + 1 AS INTEGER))"


def pick(values: list[str | None], number: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (number % len(values) + 1).cast("int"))


# written out by hand, not from the adapter
SITE_SQL = f"""
site AS (SELECT doc_id, n_chars, doc_id % 2 AS follow_up, {pick_sql(GENDERS, 'doc_id')} AS gender, {pick_sql(LABELS, 'n_chars')} AS label,
    {pick_sql(AGES, '(doc_id + n_chars)')} AS age FROM documents),
read AS (SELECT *, CASE trim(gender) WHEN 'M' THEN 0 WHEN 'F' THEN 1 END AS SexDSC,
    CASE WHEN label = 'n/a' OR label = '' THEN NULL WHEN contains(label, 'Deceased') THEN 6 ELSE CAST(substr(label, 1, 1) AS DOUBLE) END AS mrs,
    CASE WHEN age = '>89' THEN 90 ELSE TRY_CAST(trim(age) AS INTEGER) END AS Age_years FROM site),
judged AS (SELECT *, gender IS NOT NULL AND SexDSC IS NULL AS no_sex, mrs IS NULL AS no_mrs, Age_years IS NULL AS no_age FROM read)"""


def site_rows(t: Tables) -> DataFrame:
    number = F.col("n_chars")
    return t.documents.select("doc_id", "n_chars", (F.col("doc_id") % 2).cast("int").alias("follow_up"), pick(GENDERS, F.col("doc_id")).alias("gender"),
                              pick(LABELS, number).alias("mrs_discharge"), pick(AGES, F.col("doc_id") + number).alias("age"))


@query(f"""
WITH {SITE_SQL} SELECT doc_id, CAST(SexDSC AS INTEGER) AS SexDSC, CAST(Age_years AS INTEGER) AS Age, CAST(mrs AS DOUBLE) AS mrs,
  CAST(follow_up = 0 AND contains(label, 'Deceased') AS INTEGER) AS Expired FROM judged WHERE NOT (no_sex OR no_mrs OR no_age)""")
def external_rows(t: Tables):
    rows = adapt(site_rows(t), SITE, ["doc_id"]).rows
    return rows.select("doc_id", "SexDSC", "Age", "mrs", labels.expired_flag_external(F.col("label"), F.col("follow_up")).alias("Expired"))


@query(f"""
WITH {SITE_SQL} SELECT doc_id, 'SexDSC' AS field, gender AS value FROM judged WHERE no_sex
UNION ALL SELECT doc_id, 'mrs', label FROM judged WHERE no_mrs UNION ALL SELECT doc_id, 'Age', age FROM judged WHERE no_age""")
def external_rejects(t: Tables):
    return adapt(site_rows(t), SITE, ["doc_id"]).rejects


@query(f"""
WITH n AS (SELECT conv_id, {pick_sql(['M', 'F'], 'conv_id')} AS gender, {pick_sql(LABELS, 'conv_id')} AS mrs, CAST(conv_id % 3 = 0 AS INTEGER) AS follow_up,
    turn, coalesce(text, '') AS text FROM conversations)
SELECT conv_id, CAST(gender = 'F' AS INTEGER) AS gender, mrs, follow_up,
  trim(regexp_replace(string_agg(text, ' ' ORDER BY turn, text), '[\\s\\x0b\\x1c-\\x1f\\x{{85}}\\p{{Z}}]+', ' ', 'g')) AS Notes,
  CAST(follow_up = 0 AND contains(mrs, 'Deceased') AS INTEGER) AS Expired FROM n GROUP BY conv_id, gender, mrs, follow_up""")
def arrange_external(t: Tables):
    own = t.conversations.select("conv_id", pick(["M", "F"], F.col("conv_id")).alias("gender"), pick(LABELS, F.col("conv_id")).alias("mrs"),
                                 (F.col("conv_id") % 3 == 0).cast("int").alias("follow_up"), F.col("turn").alias("NoteID"), F.col("text").alias("Notes"))
    return notes.arrange_external(own)


# ---- recency from the notes --------------------------------------------------------------------

@query("""
WITH stay AS (SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS admit, CAST(o_orderdate AS DATE) + 365 AS discharge,
    CAST(o_orderdate AS DATE) + 455 AS later, o_orderkey % 2 AS follow_up FROM orders),
d AS (SELECT s.*, l_returnflag, date_diff('day', CAST(l_shipdate AS DATE), CASE follow_up WHEN 0 THEN discharge ELSE later END) AS days
  FROM stay s JOIN lineitem ON l_orderkey = o_orderkey AND CAST(l_shipdate AS DATE) BETWEEN admit AND CASE follow_up WHEN 0 THEN discharge ELSE later END),
p AS (SELECT o_orderkey, min(days) FILTER (l_returnflag = 'A') AS a, min(days) FILTER (l_returnflag = 'N') AS n, min(days) FILTER (l_returnflag = 'R') AS r
  FROM d GROUP BY 1),
m AS (SELECT o_orderkey, follow_up, CAST(least(a, n, r) AS INTEGER) AS nmin FROM stay JOIN p USING (o_orderkey))
SELECT o_orderkey, CAST(follow_up AS INTEGER) AS follow_up, nmin, CASE WHEN nmin = 0 THEN '0' ELSE '>0' END AS band FROM m""")
def note_recency(t: Tables):
    """Predictions with the days of their cohort's latest notes of each type, banded as the other site's are."""
    own = stays(t).withColumnRenamed("follow_up_date", "later")
    lines = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_returnflag", F.to_date("l_shipdate").alias("contact"))

    def typed(outcome: str) -> DataFrame:
        near = joins.interval_join(own, lines, "o_orderkey", "contact", "admit", outcome)
        latest = grouping.latest_per_group(near, ["o_orderkey", "l_returnflag"], "contact")
        days = latest.select("o_orderkey", "admit", "discharge", "later", "l_returnflag", F.datediff(outcome, "contact").alias("days"))
        return grouping.pivot_max(days, ["o_orderkey", "admit", "discharge", "later"], "l_returnflag", "days", ["A", "N", "R"])
    predictions = own.withColumn("follow_up", (F.col("o_orderkey") % 2).cast("int"))
    found = report.attach_recency(predictions, typed("discharge"), typed("later"), ["o_orderkey", "admit", "discharge"],
                                  ["o_orderkey", "admit", "discharge", "later"], ["A_days", "N_days", "R_days"], ["o_orderkey", "follow_up"])
    return report.with_bands(found, "nmin", report.EXTERNAL_BANDS).select("o_orderkey", "follow_up", "nmin", "band")


# ---- models of one site on another -------------------------------------------------------------

def two_sites(t: Tables) -> tuple[DataFrame, DataFrame]:
    """English documents train; all others are the other site, with its labels in words and its sexes in letters."""
    both = t.texts.join(t.labels, "doc_id").select(
        "doc_id", "lang", plain().alias("Notes"), (F.col("quality") * 3 + F.col("toxic") * 2).alias("score"), F.lit(0).alias("follow_up"),
        F.least(F.col("n_chars") / 200, F.lit(80.0)).alias("Age"), "toxic")
    both = materialise(both)
    mine = both.where("lang = 'en'").select("doc_id", "Notes", F.col("score").cast("double").alias("mrs"), "Age", (F.col("doc_id") % 2).cast("int").alias("SexDSC"),
                                            F.col("toxic").alias("Expired"), "follow_up")
    words = F.concat(F.col("score").cast("string"), F.lit(" - in words"))
    theirs = both.where("lang <> 'en' OR lang IS NULL").select(
        "doc_id", "Notes", F.when(F.col("score") == 5, "Deceased").otherwise(words).alias("mrs_discharge"), F.col("Age").cast("int").cast("string").alias("age"),
        pick(["M", "F"], F.col("doc_id")).alias("gender"), "follow_up")
    read = adapt(theirs, SITE, ["doc_id"]).rows.withColumn("Expired", labels.expired_flag_external(F.col("label"), F.col("follow_up"))).drop("label")
    vocabulary = features.fit_ngram_vocabulary(mine, "Notes")
    low, high = features.train_range(mine, "Age")
    own_low, own_high = features.train_range(read, "Age")
    train = features.vectorise(mine.withColumn("Age_scaled", features.scale(F.col("Age"), low, high)), "Notes", vocabulary, NUMERIC)
    other = features.vectorise(read.withColumn("Age_scaled", features.rerange(F.col("Age"), own_low, own_high, low, high)), "Notes", vocabulary, NUMERIC)
    return models.pack(train), models.pack(other)


@query()
def external_linear(t: Tables):
    """Fitted on one site, its rules applied and reported on the other."""
    train, other = two_sites(t)
    _, scored = linear_predictions(train, other, None, ["doc_id"])
    found = linear_report(materialise(scored.select("doc_id", "mrs", "y_pred")), "doc_id")
    return found.select(*[F.round(c, 6).alias(c) for c in found.columns])


@query()
def external_binary(t: Tables):
    """The same for two classes; at the other site deaths harden labels and probabilities."""
    train, other = two_sites(t)
    _, _, scored = binary_predictions(train, other, None, ["doc_id"], 0.5, harden_expired=True)
    rows = materialise(scored.select("doc_id", "y", "zero", "one", "y_hard"))
    return bootstrap.perf(rows, "doc_id").select("scope", "metric", *[F.round(c, 6).alias(c) for c in ("value", "lo", "hi")], "ci")
