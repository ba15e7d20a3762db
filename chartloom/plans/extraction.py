"""Catalog: score extraction, typed notes and the flagship query."""

from __future__ import annotations

from pyspark.sql import functions as F

from chartloom.functions import lexicon, text
from chartloom.operators import extract, grouping, joins, notes
from chartloom.plans.registry import Tables, query
from chartloom.plans.relational import day, stays
from chartloom.sources.checkpoints import materialise
from chartloom.plans.texts import PLAIN_SQL, dedupe_sql, phrase, phrase_sql, plain, quoted, regex_sql, replace_sql, sql_list

REPORTS = ["Patient is deceased", "time of death 3 pm", "pronounced him dead", "he  is\texpired", "patient passed away",
           "patient is alive", "patient jones quietly expired at home", "mrs 6 noted", "she was pronounced as death",
           "patient expired", "the expired discharge form", "no change", "pronounced"]


@query(f"""
WITH n AS (SELECT doc_id, {phrase_sql(REPORTS)} || ' ' || {PLAIN_SQL} AS s FROM documents)
SELECT doc_id, CAST({' OR '.join(f"contains(lower(s), {quoted(p)})" for p in lexicon.DEATH_PHRASES)} AS INTEGER) AS mrs6 FROM n""")
def phrase_flag(t: Tables):
    s = F.concat(phrase(REPORTS), F.lit(" "), plain())
    return t.texts.select("doc_id", extract.death_phrase(s).alias("mrs6"))


def marked_sql(s: str) -> str:
    return regex_sql(f"lower({s})", [(p, lexicon.DEATH_MARK) for p in lexicon.DEATH_PATTERNS])


@query(f"""
WITH n AS (SELECT doc_id, {phrase_sql(REPORTS)} || ' ' || {PLAIN_SQL} AS s FROM documents),
 m AS (SELECT doc_id, {marked_sql('s')} AS marked FROM n)
SELECT doc_id, marked, CAST(contains(marked, 'mrs 6') AS INTEGER) AS flag FROM m""")
def rewrite_flag(t: Tables):
    s = F.concat(phrase(REPORTS), F.lit(" "), plain())
    marked = t.texts.select("doc_id", extract.mark_deaths(s).alias("marked"))
    return marked.withColumn("flag", F.contains("marked", F.lit(lexicon.DEATH_MARK)).cast("int"))


TICKS = ["[x] 3 moderate disability", "x] 1 no significant disability and x] 3 - moderate disability",
         "[x]4: the patient has moderately severe disability", "x 5 severe disability", "[ ] 2 slight disability",
         "X] 0 no residual symptoms", "x] 6 - expired", "x]6 dead", "nothing ticked", "mrs_2 by hand"]


def tick_sql(s: str, death: str | None = None) -> str:
    arms = [f"WHEN {death} = 1 THEN 6"] if death else []
    for n in range(7):
        tests = [f"regexp_matches({s}, {quoted(lexicon.tick_pattern(k, w))})" for k, w in lexicon.TICK_WORDINGS if k == n]
        arms.append(f"WHEN contains({s}, 'mrs_{n}') OR {' OR '.join(tests)} THEN {n}")
    return f"CASE {' '.join(arms)} END"


@query(f"""
WITH n AS (SELECT doc_id, lower({phrase_sql(TICKS)}) || ' ' || {PLAIN_SQL} AS s, CAST(n_chars % 9 = 0 AS INTEGER) AS death FROM documents)
SELECT doc_id, {tick_sql('s')} AS tick, {tick_sql('s', 'death')} AS mrs FROM n""")
def checkbox_score(t: Tables):
    s = F.concat(phrase(TICKS), F.lit(" "), plain())
    death = (F.col("n_chars") % 9 == 0).cast("int")
    return t.texts.select("doc_id", extract.checkbox_score(s).alias("tick"),
                              extract.checkbox_score(s, death).alias("mrs"))


SPOKEN_SCORES = ["rankin 3 at discharge and later on in the clinic of this town it was a stable rankin 2",
                 "modified rankin is 4", "rankin: 1 then much later after a long long while indeed rankin? 5 said so",
                 "rankin 1 or rankin 2 today", "rankin is 2 said the nurse who was here all day long and then rankin 5 again",
                 "the rankin was not recorded", "no mention at all", "rankin (0-6) is 3 today", "rankin 4"]
MENTION_SQL = r"(rankin:?\??[?)(\s\[\w].{1,50})"


@query(f"""
WITH n AS (SELECT doc_id, {phrase_sql(SPOKEN_SCORES)} || ' ' || {PLAIN_SQL} AS s FROM documents)
SELECT doc_id, array_to_string(regexp_extract_all(s, {quoted(MENTION_SQL)}, 1), ' -#- ') AS rankin FROM n""")
def kwic_extract(t: Tables):
    s = F.concat(phrase(SPOKEN_SCORES), F.lit(" "), plain())
    return t.texts.select("doc_id", F.array_join(extract.mentions(s), extract.MENTION_SEPARATOR).alias("rankin"))


def mention_sql(found: str) -> str:
    said = " ".join(f"WHEN contains(array_to_string({found}, ' -#- '), 'rankin is {n}') THEN {n}" for n in range(5, -1, -1))
    last = " ".join(f"WHEN contains({found}[-1], 'rankin {n}') THEN {n}" for n in range(5, -1, -1))
    return f"CASE {said} {last} END"


@query(f"""
WITH n AS (SELECT doc_id, {phrase_sql(SPOKEN_SCORES)} || ' ' || {PLAIN_SQL} AS s FROM documents),
 m AS (SELECT doc_id, regexp_extract_all(s, {quoted(MENTION_SQL)}, 1) AS found FROM n)
SELECT doc_id, {mention_sql('found')} AS mrs FROM m""")
def mention_score(t: Tables):
    s = F.concat(phrase(SPOKEN_SCORES), F.lit(" "), plain())
    return t.texts.select("doc_id", extract.mention_score(extract.mentions(s)).alias("mrs"))


# ---- follow-up notes made of conversation turns -------------------------------------------------
# a conversation is a patient with one visit; two turns make a note; every turn is a line

LINE_HEADS = ["", "MRS score: 3 today", "[x] 2 slight disability", "modified Rankin scale is 4", "premorbid rankin 1",
              "rankin remained at 2", "patient expired", "mRS 0 of 6", "", "x] 5 - severe disability", "walks well"]
LINES_SQL = f"""
lines AS (SELECT conv_id AS PatientID, DATE '2020-01-01' + CAST(conv_id % 300 AS INTEGER) AS HospitalAdmitDTS,
    DATE '2020-01-06' + CAST(conv_id % 300 AS INTEGER) AS HospitalDischargeDTS,
    CASE WHEN conv_id % 10 < 9 THEN DATE '2020-01-26' + CAST(conv_id % 300 + conv_id % 20 AS INTEGER) END AS Date_mrs_post_discharge,
    DATE '2020-01-04' + CAST(conv_id % 300 + turn * 3 AS INTEGER) AS ContactDTS,
    conv_id * 100 + turn // 2 AS NoteID, turn AS LineNBR, conv_id % 7 AS mrs,
    {sql_list(LINE_HEADS)}[CAST((conv_id * 5 + turn * 3) % {len(LINE_HEADS)} + 1 AS INTEGER)] || ' ' || {PLAIN_SQL} AS NoteTXT
  FROM conversations)"""


def visit_lines(t: Tables):
    shift = (F.col("conv_id") % 300).cast("int")
    head = F.element_at(F.array(*[F.lit(h) for h in LINE_HEADS]),
                        ((F.col("conv_id") * 5 + F.col("turn") * 3) % len(LINE_HEADS) + 1).cast("int"))

    def date(start, extra=F.lit(0)):
        return F.date_add(F.to_date(F.lit(start)), shift + extra)
    return t.conversations.select(
        F.col("conv_id").alias("PatientID"), date("2020-01-01").alias("HospitalAdmitDTS"),
        date("2020-01-06").alias("HospitalDischargeDTS"),
        F.when(F.col("conv_id") % 10 < 9, date("2020-01-26", (F.col("conv_id") % 20).cast("int"))).alias("Date_mrs_post_discharge"),
        date("2020-01-04", (F.col("turn") * 3).cast("int")).alias("ContactDTS"),
        (F.col("conv_id") * 100 + F.floor(F.col("turn") / 2)).alias("NoteID"), F.col("turn").alias("LineNBR"),
        (F.col("conv_id") % 7).alias("mrs"), F.concat(head, F.lit(" "), plain()).alias("NoteTXT"))


def unify_sql(s: str) -> str:
    special = f"regexp_replace({s}, '[^a-zA-Z0-9 \\n]', ' ', 'g')"
    words = replace_sql(special, [(w, " ") for w in extract.SCORE_WORDS])
    return f"replace(lower(trim(regexp_replace({words}, '\\s+', ' ', 'g'))), 'mrs', 'rankin')"


MENTION_NOTES_SQL = f"""
spoken AS (SELECT PatientID, HospitalAdmitDTS, HospitalDischargeDTS, Date_mrs_post_discharge, ContactDTS, NoteID, mrs_90days,
    CAST(date_diff('day', ContactDTS, Date_mrs_post_discharge) AS INTEGER) AS DD_days,
    string_agg({unify_sql('NoteTXT')}, ' ' ORDER BY LineNBR) AS s
  FROM rest WHERE ContactDTS >= HospitalDischargeDTS AND Date_mrs_post_discharge IS NOT NULL GROUP BY ALL),
trimmed AS (SELECT * EXCLUDE (s), trim(regexp_replace({replace_sql('lower(s)', [(w, ' ') for w in extract.MENTION_NOISE])},
    '\\s+', ' ', 'g')) AS s FROM spoken),
mention_notes AS (SELECT * EXCLUDE (s), {dedupe_sql('s')} AS Notes FROM trimmed)"""


@query(f"""
WITH {LINES_SQL}, rest AS (SELECT * EXCLUDE (mrs), mrs AS mrs_90days FROM lines), {MENTION_NOTES_SQL}
SELECT PatientID, NoteID, strftime(ContactDTS, '%Y-%m-%d') AS contact, DD_days, mrs_90days, Notes FROM mention_notes""")
def notes_select(t: Tables):
    lines = visit_lines(t).withColumnRenamed("mrs", "mrs_90days")
    return extract.mention_notes(lines).select("PatientID", "NoteID", day("ContactDTS").alias("contact"), "DD_days",
                                               "mrs_90days", "Notes")


TICKED_SQL = f"""
marked AS (SELECT *, {marked_sql('NoteTXT')} AS m FROM lines WHERE Date_mrs_post_discharge IS NOT NULL),
flagged AS (SELECT *, CAST(contains(m, 'mrs 6') OR {' OR '.join(f"contains(lower(NoteTXT), {quoted(p)})" for p in lexicon.DEATH_PHRASES)}
    AS INTEGER) AS mrs6 FROM marked),
put AS (SELECT PatientID, HospitalAdmitDTS, HospitalDischargeDTS, Date_mrs_post_discharge, ContactDTS, NoteID, mrs6,
    trim(string_agg(m, ' ' ORDER BY LineNBR)) AS s FROM flagged GROUP BY ALL),
ticked AS (SELECT * EXCLUDE (s), {tick_sql(f"regexp_replace({dedupe_sql('s')}, ' +', ' ', 'g')", 'mrs6')} AS score FROM put
    WHERE date_diff('day', HospitalDischargeDTS, Date_mrs_post_discharge) <= 30)"""


@query(f"""
WITH {LINES_SQL}, {TICKED_SQL}
SELECT DISTINCT PatientID, NoteID, mrs6, CAST(score AS INTEGER) AS mrs FROM ticked WHERE score IS NOT NULL""")
def tick_extractions(t: Tables):
    return extract.tick_extractions(visit_lines(t)).select("PatientID", "NoteID", "mrs6", "mrs").distinct()


@query(f"""
WITH {LINES_SQL}, {TICKED_SQL},
found_ticks AS (SELECT DISTINCT PatientID, HospitalAdmitDTS, HospitalDischargeDTS, Date_mrs_post_discharge, NoteID, score
    FROM ticked WHERE score IS NOT NULL),
done AS (SELECT DISTINCT PatientID, HospitalAdmitDTS, HospitalDischargeDTS, Date_mrs_post_discharge, mrs FROM lines
    WHERE NoteID IN (SELECT NoteID FROM found_ticks)),
rest AS (SELECT l.* EXCLUDE (mrs), l.mrs AS mrs_90days FROM lines l WHERE l.mrs <> 6 AND NOT EXISTS (SELECT 1 FROM done d
    WHERE d.PatientID = l.PatientID AND d.HospitalAdmitDTS = l.HospitalAdmitDTS AND d.HospitalDischargeDTS = l.HospitalDischargeDTS
      AND d.Date_mrs_post_discharge IS NOT DISTINCT FROM l.Date_mrs_post_discharge AND d.mrs = l.mrs)), {MENTION_NOTES_SQL},
found AS (SELECT *, regexp_extract_all(Notes, {quoted(MENTION_SQL)}, 1) AS m FROM mention_notes),
said AS (SELECT DISTINCT PatientID, Date_mrs_post_discharge, {mention_sql('m')} AS score FROM found WHERE len(m) > 0 AND DD_days <= 30)
SELECT PatientID, strftime(Date_mrs_post_discharge, '%Y-%m-%d') AS follow_up_date, CAST(score AS DOUBLE) AS mrs_extractions FROM (
  SELECT * FROM said UNION ALL SELECT DISTINCT PatientID, Date_mrs_post_discharge, score FROM found_ticks)
WHERE score IS NOT NULL""")
def extract_scores(t: Tables):
    lines = materialise(visit_lines(t))
    clean = lines.select("NoteID", F.lit(1).alias("follow_up")).distinct()
    out = extract.extract_scores(lines, clean)
    return out.select("PatientID", day("Date_mrs_post_discharge").alias("follow_up_date"), "mrs_extractions")


# ---- typed notes: orders as admissions, their lines as note lines -------------------------------

STAY_KEYS = ["o_custkey", "o_orderkey", "admit", "discharge"]


def stay_lines(t: Tables):
    """Every line of a customer joined to every stay of that customer that covers its date."""
    owner = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    lines = (t.lineitem.join(owner, "l_orderkey")
             .select("o_custkey", F.col("l_orderkey").alias("NoteID"), F.col("l_linenumber").alias("LineNBR"),
                     F.to_date(F.trunc("l_shipdate", "month")).alias("contact"),
                     F.concat(F.when(F.col("l_quantity") < 4, "Physical therapy, ").otherwise(""),
                              F.concat_ws(" ", "l_returnflag", "l_linestatus", F.col("l_quantity").cast("int"),
                                          "l_partkey")).alias("NoteTXT"),
                     F.when(F.col("l_tax") == 0, "PHS IP OT Discharge Box").when(
                         F.col("l_tax") == 0.08, "Discharge Summary").alias("tag")))
    return joins.interval_join(stays(t).drop("follow_up_date"), lines, "o_custkey", "contact", "admit", "discharge")


@query(f"""
WITH line AS (SELECT o_custkey, l_orderkey AS NoteID, l_linenumber AS LineNBR, CAST(date_trunc('month', l_shipdate) AS DATE) AS contact,
    CASE WHEN l_quantity < 4 THEN 'Physical therapy, ' ELSE '' END || l_returnflag || ' ' || l_linestatus || ' ' ||
      CAST(l_quantity AS INTEGER) || ' ' || l_partkey AS NoteTXT,
    CASE WHEN l_tax = 0 THEN 'OT' WHEN l_tax = 0.08 THEN 'DS' END AS tag, l_quantity < 4 AS pt
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
stay AS (SELECT o_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS admit, CAST(o_orderdate AS DATE) + 365 AS discharge FROM orders),
c AS (SELECT s.*, l.* EXCLUDE (o_custkey) FROM stay s JOIN line l ON s.o_custkey = l.o_custkey AND l.contact BETWEEN s.admit AND s.discharge),
f AS (SELECT *, max(coalesce(tag, '') = 'OT') OVER (PARTITION BY NoteID) AS ot, max(pt) OVER (PARTITION BY NoteID) AS is_pt,
        max(coalesce(tag, '') = 'DS') OVER (PARTITION BY NoteID) AS ds FROM c),
k AS (SELECT *, 'OT' AS kind, 1 AS r FROM f WHERE ot UNION ALL SELECT *, 'PT', 2 FROM f WHERE is_pt
      UNION ALL SELECT *, 'DS', 3 FROM f WHERE tag = 'DS' UNION ALL SELECT *, 'DD', 4 FROM f WHERE NOT (ot OR is_pt OR ds)),
latest AS (SELECT * FROM (SELECT *, max(contact) OVER (PARTITION BY o_custkey, o_orderkey, kind) AS top FROM k) WHERE contact = top),
put AS (SELECT o_custkey, o_orderkey, kind, r, NoteID, CAST(date_diff('day', contact, discharge) AS INTEGER) AS days,
      string_agg(NoteTXT, ' ' ORDER BY LineNBR, NoteTXT) AS s FROM latest GROUP BY o_custkey, o_orderkey, kind, r, NoteID, contact, discharge),
texts AS (SELECT * EXCLUDE (s), {dedupe_sql('s')} AS Notes FROM put),
p AS (SELECT o_custkey, o_orderkey, max(CASE WHEN kind = 'OT' THEN days END) AS "OT_days", max(CASE WHEN kind = 'PT' THEN days END) AS "PT_days",
      max(CASE WHEN kind = 'DS' THEN days END) AS "DS_days", max(CASE WHEN kind = 'DD' THEN days END) AS "DD_days" FROM texts GROUP BY 1, 2)
SELECT t.o_custkey, t.o_orderkey, t.NoteID, t.Notes, CAST(min(t.r) AS BIGINT) AS type_rank, "OT_days", "PT_days", "DS_days", "DD_days"
FROM texts t JOIN p ON t.o_custkey = p.o_custkey AND t.o_orderkey = p.o_orderkey GROUP BY ALL""")
def typed_notes(t: Tables):
    out = notes.typed_notes(stay_lines(t), follow_up=False, keys=STAY_KEYS, note_type="tag", contact="contact",
                            admit="admit", discharge="discharge", outcome_date="discharge")
    return out.drop("admit", "discharge")


@query(r"""
WITH l AS (SELECT o_orderkey, l_linenumber, date_trunc('month', l_shipdate) AS m, l_returnflag || ' ' || l_linestatus AS piece
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey
  WHERE l_shipdate >= o_orderdate AND l_shipdate <= o_orderdate + INTERVAL 365 DAY),
k AS (SELECT * FROM (SELECT *, max(m) OVER (PARTITION BY o_orderkey) AS top FROM l) WHERE m = top),
j AS (SELECT o_orderkey, lower(string_agg(piece, ' ' ORDER BY l_linenumber, piece)) AS s FROM k GROUP BY 1),
d AS (SELECT o_orderkey, """ + dedupe_sql("s") + r""" AS Notes FROM j)
SELECT o_orderkey, Notes, CAST(len(string_split(Notes, ' ')) AS INTEGER) AS tokens FROM d""")
def latest_stay_document(t: Tables):
    lines = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", F.to_date("l_shipdate").alias("contact"),
                              F.concat_ws(" ", "l_returnflag", "l_linestatus").alias("Notes"))
    near = joins.interval_join(stays(t), lines, "o_orderkey", "contact", "admit", "discharge")
    latest = grouping.latest_per_group(near.withColumn("month", F.trunc("contact", "month")), ["o_orderkey"], "month")
    docs = grouping.concat_ordered(latest, ["o_orderkey"], ["l_linenumber"], "Notes")
    clean = text.dedupe_words(text.collapse_whitespace(text.strip_special(text.strip_digits(F.lower("Notes")))))
    return docs.withColumn("Notes", clean).withColumn("tokens", text.token_count(F.col("Notes")))


@query(rf"""
WITH n AS (SELECT conv_id AS PatientID, CASE role WHEN 'user' THEN 'Male' WHEN 'assistant' THEN 'Female' ELSE 'Unknown' END AS sex,
    conv_id % 7 AS mrs, conv_id % 2 AS follow_up, turn // 2 AS NoteID, turn, {PLAIN_SQL} AS Notes FROM conversations),
k AS (SELECT * FROM (SELECT *, sum(len(regexp_extract_all(Notes, '[\p{{L}}\p{{Nd}}]+'))) OVER (PARTITION BY PatientID, sex, mrs, follow_up) AS total FROM n)
      WHERE total >= 300)
SELECT PatientID, CAST(CASE sex WHEN 'Male' THEN 0 WHEN 'Female' THEN 1 END AS INTEGER) AS SexDSC, mrs, follow_up, NoteID,
  trim(regexp_replace(string_agg(Notes, ' ' ORDER BY Notes), ' +', ' ', 'g')) AS Notes, CAST(mrs = 6 AS INTEGER) AS Expired
FROM k GROUP BY PatientID, sex, mrs, follow_up, NoteID""")
def arrange_docs(t: Tables):
    sex = F.when(F.col("role") == "user", "Male").when(F.col("role") == "assistant", "Female").otherwise("Unknown")
    rows = t.conversations.select(
        F.col("conv_id").alias("PatientID"), sex.alias("SexDSC"), (F.col("conv_id") % 7).alias("mrs"),
        (F.col("conv_id") % 2).alias("follow_up"), F.floor(F.col("turn") / 2).alias("NoteID"), plain().alias("Notes"))
    return notes.arrange(rows, keys=["PatientID", "SexDSC", "mrs"])


@query(rf"""
WITH n AS (SELECT conv_id, role, turn, {PLAIN_SQL} AS s FROM conversations)
SELECT conv_id, trim(regexp_replace(string_agg(s, ' ' ORDER BY turn, s), ' +', ' ', 'g')) AS Notes FROM n WHERE s <> '' GROUP BY 1""")
def assemble_docs(t: Tables):
    rows = t.conversations.select("conv_id", "turn", plain().alias("Notes"))
    return notes.assemble_documents(rows, keys=["conv_id"], note="turn")
