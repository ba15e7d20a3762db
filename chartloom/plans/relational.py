"""Catalog: sources, filters, joins, grouping, windows and set operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from chartloom.functions import labels, lexicon
from chartloom.operators import grouping, joins, models, notes, ordered, report, split
from chartloom.operators.extract import closest
from chartloom.plans.registry import Tables, query
from chartloom.sources.tables import parse_dates


def day(c):
    return F.date_format(c, "yyyy-MM-dd")


# ---- sources, projections, filters ------------------------------------------------------------

@query("SELECT doc_id, lang, source, n_chars, md5(text) AS text_md5 FROM documents")
def scan_documents(t: Tables):
    return t.documents.select("doc_id", "lang", "source", "n_chars", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query("""
SELECT c_mktsegment AS segment, c_custkey AS PatientID, c_acctbal AS balance, c_acctbal AS balance_copy,
       CAST(0 AS INTEGER) AS follow_up FROM customer
UNION ALL
SELECT s_name AS segment, s_suppkey AS PatientID, s_acctbal AS balance, s_acctbal AS balance_copy,
       CAST(1 AS INTEGER) AS follow_up FROM supplier""")
def project_align(t: Tables):
    left = (t.customer.drop("c_name", "c_nationkey").withColumnRenamed("c_mktsegment", "segment")
            .withColumnRenamed("c_custkey", "PatientID").withColumnRenamed("c_acctbal", "balance")
            .withColumn("balance_copy", F.col("balance")).withColumn("follow_up", F.lit(0)))
    right = t.supplier.select(F.lit(1).alias("follow_up"), F.col("s_acctbal").alias("balance"),
                              F.col("s_suppkey").alias("PatientID"), F.col("s_name").alias("segment"),
                              F.col("s_acctbal").alias("balance_copy"))
    return grouping.union_all(left, right)


@query("SELECT p_partkey, p_size, p_brand FROM part WHERE p_size >= 18")
def adult_filter(t: Tables):
    return joins.adults(t.part, "p_size").select("p_partkey", "p_size", "p_brand")


@query("""
SELECT d.doc_id, l.quality, regexp_extract(d.text, '[0-9][0-9]+', 0) AS first_number
FROM documents d LEFT JOIN labels l USING (doc_id)
WHERE l.quality IS NOT NULL AND regexp_extract(d.text, '[0-9][0-9]+', 0) <> ''""")
def nonempty_filter(t: Tables):
    return (joins.enrich(t.documents, t.labels, ["doc_id"])
            .select("doc_id", "quality", F.regexp_extract("text", "[0-9][0-9]+", 0).alias("first_number"))
            .where(F.col("quality").isNotNull() & (F.col("first_number") != "")))


NOTE_HEADS = {"en": "MGH Occupational Therapy 12: ", "de": "Physical  therapy. ",
              "fr": "occupational,therapy ", "es": "see physical therapy "}
TYPE_TAGS = {"src0": "PHS IP OT Discharge Box", "src1": "PHS IP PT Discharge Box (late)",
             "src2": "Discharge Summary", "src3": "ED Discharge Summary Note"}


def case_sql(column: str, values: dict[str, str], other: str = "''") -> str:
    arms = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items())
    return f"CASE {column} {arms} ELSE {other} END"


def case_col(column: str, values: dict[str, str]):
    out = F.lit("")
    for k, v in values.items():
        out = F.when(F.col(column) == k, F.lit(v)).otherwise(out)
    return out


def typing_sql(text: str) -> str:
    plain = f"regexp_replace(regexp_replace({text}, '\\p{{Nd}}', '', 'g'), '[^a-zA-Z0-9 \\n]', ' ', 'g')"
    for tag in lexicon.SITE_TAGS:
        plain = f"replace(lower({plain}), '{tag}', ' ')"
    return f"trim(regexp_replace({plain}, '\\s+', ' ', 'g'))"


@query(f"""
WITH n AS (SELECT doc_id, {typing_sql(case_sql('lang', NOTE_HEADS) + " || text")} AS s,
                  {case_sql('source', TYPE_TAGS)} AS tag FROM documents)
SELECT doc_id,
  CAST(starts_with(s, 'occupational therapy') OR starts_with(s, 'mgh occupational therapy')
       OR contains(tag, 'PHS IP OT Discharge Box') AS INTEGER) AS is_ot,
  CAST(starts_with(s, 'physical therapy') OR starts_with(s, 'mgh physical therapy')
       OR contains(tag, 'PHS IP PT Discharge Box') AS INTEGER) AS is_pt,
  CAST(contains(tag, 'Discharge Summary') AS INTEGER) AS is_ds
FROM n""")
def note_type_pred(t: Tables):
    lines = t.documents.withColumn("NoteTXT", F.concat(case_col("lang", NOTE_HEADS), F.col("text"))) \
        .withColumn("tag", case_col("source", TYPE_TAGS))
    types = notes.line_types(F.col("NoteTXT"), F.col("tag"))
    return lines.select("doc_id", *[c.cast("int").alias(n) for n, c in types.items()])


SEGMENTS = {"BUILDING": 0, "FURNITURE": 1, "MACHINERY": 2, "HOUSEHOLD": 3}


@query("""
SELECT c_custkey, CAST(CASE c_mktsegment WHEN 'BUILDING' THEN 0 WHEN 'FURNITURE' THEN 1 WHEN 'MACHINERY' THEN 2
       WHEN 'HOUSEHOLD' THEN 3 END AS INTEGER) AS code FROM customer""")
def encode_category(t: Tables):
    return t.customer.select("c_custkey", labels.encode_category(F.col("c_mktsegment"), SEGMENTS).alias("code"))


LABEL_TEXTS = ["0 - No symptoms", "1 - No significant disability", "2 - Slight disability",
               "3 - Moderate disability", "4 - Moderately severe disability", "5 - Severe disability",
               "6 - Deceased", "Deceased", "3", "6", "2.0", "not recorded"]
LABEL_SQL = f"list_extract([{', '.join(repr(x) for x in LABEL_TEXTS)}], CAST(n_chars % {len(LABEL_TEXTS)} + 1 AS INTEGER))"


def label_text():
    return F.element_at(F.array(*[F.lit(x) for x in LABEL_TEXTS]),
                        (F.col("n_chars") % len(LABEL_TEXTS) + 1).cast("int"))


@query(f"""
WITH n AS (SELECT doc_id, n_chars % 7 AS mrs, {LABEL_SQL} AS label, doc_id % 2 AS follow_up FROM documents)
SELECT doc_id, CAST(mrs = 6 AS INTEGER) AS expired,
       CAST(CASE WHEN follow_up = 1 THEN 0 ELSE CAST(contains(label, 'Deceased') AS INTEGER) END AS INTEGER) AS expired_external,
       CAST(contains(label, 'Deceased') AS INTEGER) AS expired_kept
FROM n""")
def expired_flag(t: Tables):
    follow_up = F.col("doc_id") % 2
    return t.documents.select(
        "doc_id", labels.expired_flag(F.col("n_chars") % 7).alias("expired"),
        labels.expired_flag_external(label_text(), follow_up).alias("expired_external"),
        labels.expired_flag_external(label_text(), follow_up, reset_follow_up=False).alias("expired_kept"))


@query(f"""
WITH n AS (SELECT doc_id, {LABEL_SQL} AS label FROM documents)
SELECT doc_id, label, CASE WHEN contains(label, 'Deceased') THEN 6.0::DOUBLE
    WHEN regexp_matches(label, '^[0-6] -') THEN CAST(label[1] AS DOUBLE)
    ELSE TRY_CAST(label AS DOUBLE) END AS mrs
FROM n""")
def label_norm(t: Tables):
    return t.documents.select("doc_id", label_text().alias("label"), labels.normalise_label(label_text()).alias("mrs"))


@query(f"""
WITH n AS (SELECT doc_id, {LABEL_SQL} AS label FROM documents)
SELECT doc_id, CAST(CASE WHEN contains(label, 'Deceased') THEN 1
    WHEN regexp_matches(label, '^[012]') THEN 0 WHEN regexp_matches(label, '^[3456]') THEN 1 END AS INTEGER) AS y
FROM n""")
def label_binary(t: Tables):
    return t.documents.select("doc_id", labels.dichotomise(labels.normalise_label(label_text())).alias("y"))


@query("SELECT doc_id, greatest(least(CAST(n_chars - 1500 AS DOUBLE) / 500, 6), 0) AS y_pred FROM documents")
def clip(t: Tables):
    return t.documents.select("doc_id", labels.clip((F.col("n_chars") - 1500) / 500).alias("y_pred"))


@query("""
SELECT d.doc_id, CASE WHEN l.quality IS NOT NULL THEN CAST(l.quality * 3 + l.toxic AS DOUBLE)
    WHEN d.n_chars % 7 = 6 THEN 6.0::DOUBLE ELSE CAST(d.n_chars % 61 AS DOUBLE) / 10 END AS y_pred,
  CASE WHEN d.n_chars % 7 = 6 THEN 1.0::DOUBLE ELSE CAST(d.n_chars % 2 AS DOUBLE) END AS y_hard
FROM documents d LEFT JOIN labels l USING (doc_id)""")
def override_pred(t: Tables):
    scored = joins.enrich(t.documents, t.labels, ["doc_id"])
    expired = labels.expired_flag(F.col("n_chars") % 7)
    extracted = (F.col("quality") * 3 + F.col("toxic")).cast("double")
    return scored.select(
        "doc_id",
        labels.override_prediction((F.col("n_chars") % 61) / 10, expired, extracted).alias("y_pred"),
        labels.override_prediction((F.col("n_chars") % 2).cast("double"), expired, expired_value=1.0).alias("y_hard"))


@query("""
SELECT d.doc_id, CASE WHEN l.quality IS NULL THEN CAST(100 - d.n_chars % 101 AS DOUBLE) / 100 ELSE 1.0 - l.quality END AS zero,
  CASE WHEN l.quality IS NULL THEN CAST(d.n_chars % 101 AS DOUBLE) / 100 ELSE CAST(l.quality AS DOUBLE) END AS one
FROM documents d LEFT JOIN labels l USING (doc_id)""")
def override_prob(t: Tables):
    scored = joins.enrich(t.documents, t.labels, ["doc_id"])
    zero, one = labels.override_probabilities(
        (100 - F.col("n_chars") % 101) / 100, (F.col("n_chars") % 101) / 100, F.col("quality"))
    return scored.select("doc_id", zero.alias("zero"), one.alias("one"))


# ---- joins -------------------------------------------------------------------------------------

@query("""
SELECT o_orderkey, o_custkey, l_partkey, l_suppkey, l_linenumber, l_quantity,
       strftime(o_orderdate, '%Y-%m-%d') AS admit, strftime(l_shipdate, '%Y-%m-%d') AS contact,
       CAST(date_diff('day', CAST(l_shipdate AS DATE), CAST(o_orderdate AS DATE) + 365) AS INTEGER) AS days_left
FROM orders JOIN lineitem ON o_orderkey = l_orderkey
WHERE l_shipdate >= o_orderdate AND l_shipdate <= o_orderdate + INTERVAL 365 DAY""")
def interval_join(t: Tables):
    admissions = stays(t).withColumnRenamed("o_orderkey", "key")
    lines = t.lineitem.withColumn("contact", F.to_date("l_shipdate")).withColumnRenamed("l_orderkey", "key")
    joined = joins.interval_join(admissions, lines, "key", "contact", "admit", "discharge")
    return joined.select(F.col("key").alias("o_orderkey"), "o_custkey", "l_partkey", "l_suppkey", "l_linenumber",
                         "l_quantity", day("admit").alias("admit"), day("contact").alias("contact"),
                         F.datediff("discharge", "contact").alias("days_left"))


def stays(t: Tables):
    """Orders in the role of admissions that last a year and are followed up 90 days later."""
    admit = F.to_date("o_orderdate")
    return t.orders.select("o_orderkey", "o_custkey", admit.alias("admit"), F.date_add(admit, 365).alias("discharge"),
                           F.date_add(admit, 455).alias("follow_up_date"))


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem
WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)""")
def semi_join(t: Tables):
    hits = t.lineitem.where("l_quantity > 45")
    return joins.keep_listed(t.lineitem, hits, "l_orderkey").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem
WHERE l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)
  AND l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_discount >= 0.09)""")
def anti_join(t: Tables):
    left = joins.drop_listed(t.lineitem, t.lineitem.where("l_quantity > 45"), "l_orderkey")
    left = joins.drop_listed(left, t.lineitem.where("l_discount >= 0.09"), "l_orderkey")
    return left.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("""
WITH k AS (SELECT l_orderkey, l_partkey, nullif(l_returnflag, 'N') AS flag, nullif(l_linestatus, 'O') AS status, l_quantity
           FROM lineitem)
SELECT k.l_orderkey, k.l_partkey, k.flag, k.status FROM k
WHERE NOT EXISTS (SELECT 1 FROM k r WHERE r.l_quantity > 40 AND r.l_orderkey = k.l_orderkey
    AND r.flag IS NOT DISTINCT FROM k.flag AND r.status IS NOT DISTINCT FROM k.status)""")
def anti_join_nullsafe(t: Tables):
    k = t.lineitem.select("l_orderkey", "l_partkey", F.nullif(F.col("l_returnflag"), F.lit("N")).alias("flag"),
                          F.nullif(F.col("l_linestatus"), F.lit("O")).alias("status"), "l_quantity")
    return joins.drop_listed_null_safe(k, k.where("l_quantity > 40"), ["l_orderkey", "flag", "status"]).drop("l_quantity")


@query("""
SELECT o.o_orderkey, o.o_custkey, m.month FROM orders o JOIN
  (SELECT DISTINCT l_orderkey, strftime(l_shipdate, '%Y-%m') AS month FROM lineitem) m ON o.o_orderkey = m.l_orderkey""")
def composite_join(t: Tables):
    months = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), F.date_format("l_shipdate", "yyyy-MM").alias("month"))
    return joins.attach(t.orders.select("o_orderkey", "o_custkey"), months, ["o_orderkey"], ["month"])


@query("SELECT d.doc_id, d.lang, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)")
def left_enrich(t: Tables):
    return joins.enrich(t.documents.select("doc_id", "lang"), t.labels, ["doc_id"])


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(m, '%Y-%m-%d') AS month FROM (
  SELECT *, date_trunc('month', l_shipdate) AS m,
         max(date_trunc('month', l_shipdate)) OVER (PARTITION BY l_orderkey) AS latest FROM lineitem)
WHERE m = latest""")
def latest_per_group(t: Tables):
    lines = t.lineitem.withColumn("m", F.to_date(F.trunc("l_shipdate", "month")))
    return grouping.latest_per_group(lines, ["l_orderkey"], "m").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", day("m").alias("month"))


@query("""
WITH d AS (SELECT o_orderkey, l_partkey, l_linenumber,
             CAST(date_diff('day', CAST(l_shipdate AS DATE), CAST(o_orderdate AS DATE) + 365) AS INTEGER) AS days
           FROM orders JOIN lineitem ON o_orderkey = l_orderkey
           WHERE l_shipdate >= o_orderdate AND l_shipdate <= o_orderdate + INTERVAL 365 DAY)
SELECT 'as_observed' AS mode, * FROM d WHERE days <= 30
UNION ALL
SELECT 'closest' AS mode, o_orderkey, l_partkey, l_linenumber, days
FROM (SELECT *, min(days) OVER (PARTITION BY o_orderkey) AS least_days FROM d) WHERE days = least_days AND days <= 30""")
def closest_mention(t: Tables):
    lines = t.lineitem.withColumn("contact", F.to_date("l_shipdate")).withColumnRenamed("l_orderkey", "key")
    near = joins.interval_join(stays(t).withColumnRenamed("o_orderkey", "key"), joins.dealt(lines, "key"), "key", "contact", "admit",
                               "discharge")
    days = near.select(F.col("key").alias("o_orderkey"), "l_partkey", "l_linenumber",
                       F.datediff("discharge", "contact").alias("days"))
    return grouping.union_all(*[
        closest(days, ["o_orderkey"], "days", 30, mode).withColumn("mode", F.lit(mode))
        for mode in ("as_observed", "closest")])


@query("""
SELECT l_orderkey, max(CASE WHEN l_returnflag = 'A' THEN l_quantity END) AS "A_days",
  max(CASE WHEN l_returnflag = 'N' THEN l_quantity END) AS "N_days",
  max(CASE WHEN l_returnflag = 'R' THEN l_quantity END) AS "R_days" FROM lineitem GROUP BY 1""")
def days_pivot(t: Tables):
    return grouping.pivot_max(t.lineitem, ["l_orderkey"], "l_returnflag", "l_quantity", ["A", "N", "R"])


# ---- aggregation, windows, sets ----------------------------------------------------------------

@query(r"""
SELECT conv_id, trim(regexp_replace(string_agg(coalesce(text, ''), ' ' ORDER BY turn, text),
       '[\s\x0b\x1c-\x1f\x{85}\p{Z}]+', ' ', 'g')) AS text
FROM conversations GROUP BY conv_id""")
def concat_ordered(t: Tables):
    return grouping.concat_ordered(t.conversations, ["conv_id"], ["turn"], "text")


@query("SELECT DISTINCT l_suppkey, l_returnflag, l_linestatus FROM lineitem")
def distinct_keys(t: Tables):
    return t.lineitem.select("l_suppkey", "l_returnflag", "l_linestatus").distinct()


@query(r"""
WITH n AS (SELECT conv_id, turn, role, len(regexp_extract_all(regexp_replace(text, '[^a-zA-Z]', ' ', 'g'), '\w+')) AS n
           FROM conversations)
SELECT conv_id, turn, role, CAST(n AS INTEGER) AS tokens
FROM (SELECT *, sum(n) OVER (PARTITION BY conv_id) AS total FROM n) WHERE total >= 300""")
def min_tokens_group(t: Tables):
    from chartloom.functions.text import token_count
    pieces = t.conversations.select("conv_id", "turn", "role", token_count(
        F.regexp_replace("text", "[^a-zA-Z]", " ")).alias("tokens"))
    return grouping.having_total(pieces, ["conv_id"], F.col("tokens"), 300)


@query("""
SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.025), 6) AS lo,
       round(quantile_cont(l_extendedprice, 0.975), 6) AS hi FROM lineitem GROUP BY 1""")
def percentile_ci(t: Tables):
    out = ordered.quantiles(t.lineitem, ["l_returnflag"], "l_extendedprice", {"lo": 0.025, "hi": 0.975})
    return out.select("l_returnflag", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))


@query("""
SELECT c_custkey, least(CASE WHEN c_acctbal > 0 THEN c_acctbal END, CASE WHEN c_nationkey > 5 THEN CAST(c_nationkey AS DOUBLE) END,
       CASE WHEN c_custkey % 3 = 0 THEN CAST(c_custkey AS DOUBLE) END) AS nmin FROM customer""")
def row_min(t: Tables):
    return t.customer.select("c_custkey", labels.row_min(
        F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")),
        F.when(F.col("c_nationkey") > 5, F.col("c_nationkey").cast("double")),
        F.when(F.col("c_custkey") % 3 == 0, F.col("c_custkey").cast("double"))).alias("nmin"))


@query("""
SELECT CAST(o_orderkey % 7 AS BIGINT) AS mrs, min(o_totalprice) AS minimum, round(quantile_cont(o_totalprice, 0.25), 4) AS q1,
  round(quantile_cont(o_totalprice, 0.5), 4) AS median, round(quantile_cont(o_totalprice, 0.75), 4) AS q3,
  max(o_totalprice) AS maximum FROM orders GROUP BY 1""")
def box_stats(t: Tables):
    out = report.box_stats(t.orders.withColumn("mrs", F.col("o_orderkey") % 7), "mrs", "o_totalprice")
    return out.select("mrs", "minimum", *[F.round(c, 4).alias(c) for c in ("q1", "median", "q3")], "maximum")


@query("SELECT o_orderkey, CAST(ntile(5) OVER (ORDER BY o_orderkey) - 1 AS INTEGER) AS fold FROM orders")
def fold_assign(t: Tables):
    return split.contiguous_folds(t.orders.select("o_orderkey"), "o_orderkey", 5)


FOLDS_SQL = """
WITH c AS (SELECT o_orderstatus, min(o_orderkey) AS first_seen FROM orders GROUP BY 1),
 dealt AS (SELECT o_orderstatus, (row_number() OVER (ORDER BY first_seen, o_orderkey) - 1) % 5 AS fold
           FROM orders JOIN c USING (o_orderstatus)),
 sizes AS (SELECT o_orderstatus, fold, count(*) AS n FROM dealt GROUP BY ALL),
 ends AS (SELECT o_orderstatus, fold, sum(n) OVER (PARTITION BY o_orderstatus ORDER BY fold) AS upto FROM sizes),
 placed AS (SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS at FROM orders)
SELECT p.o_orderkey, p.o_orderstatus, CAST(min(e.fold) AS INTEGER) AS fold
FROM placed p JOIN ends e ON p.o_orderstatus = e.o_orderstatus AND p.at <= e.upto GROUP BY ALL"""


@query(FOLDS_SQL)
def fold_assign_strat(t: Tables):
    return split.stratified_folds(t.orders.select("o_orderkey", "o_orderstatus"), "o_orderkey", "o_orderstatus", 5)


@query(f"""
WITH dealt_rows AS ({FOLDS_SQL}), folds AS (SELECT unnest(range(5))::INT AS fold),
 outside AS (SELECT f.fold, d.o_orderstatus, count(*) AS n FROM folds f JOIN dealt_rows d ON d.fold <> f.fold GROUP BY ALL)
SELECT fold, o_orderstatus, sum(n) OVER (PARTITION BY fold)::DOUBLE / (count(*) OVER (PARTITION BY fold) * n) AS weight FROM outside""")
def class_weights_by_fold(t: Tables):
    folded = split.stratified_folds(t.orders.select("o_orderkey", "o_orderstatus"), "o_orderkey", "o_orderstatus", 5)
    weights = models.fold_class_weights(folded, "o_orderstatus", 5)
    return weights.select("o_orderstatus", F.posexplode("weights").alias("fold", "weight")).where("weight IS NOT NULL")


@query("""
SELECT 0 AS follow_up, o_orderkey AS id, o_orderstatus AS status FROM orders
UNION ALL SELECT 1 AS follow_up, l_orderkey AS id, l_linestatus AS status FROM lineitem""")
def union_all(t: Tables):
    left = t.orders.select(F.lit(0).alias("follow_up"), F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    right = t.lineitem.select(F.col("l_linestatus").alias("status"), F.col("l_orderkey").alias("id"), F.lit(1).alias("follow_up"))
    return grouping.union_all(left, right)


@query("""
SELECT o_orderkey AS id, o_orderstatus AS status FROM orders
UNION SELECT l_orderkey AS id, l_linestatus AS status FROM lineitem""")
def union_distinct(t: Tables):
    return grouping.union_distinct(
        t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status")),
        t.lineitem.select(F.col("l_orderkey").alias("id"), F.col("l_linestatus").alias("status")))


@query("""
SELECT o_orderkey, CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '2002-01-01') AS INTEGER) AS days FROM orders""")
def day_diff(t: Tables):
    # through the text form the sources deliver, 1/4/2017 style
    text = t.orders.select("o_orderkey", F.date_format("o_orderdate", "M/d/yyyy").alias("ContactDTS"))
    return parse_dates(text).select("o_orderkey", F.datediff(F.to_date(F.lit("2002-01-01")), "ContactDTS").alias("days"))


@query("""
SELECT c_custkey, o_orderkey, CASE WHEN ('0x' || substr(md5(CAST(c_custkey AS VARCHAR)), 1, 8))::BIGINT % 10 < 7
       THEN 'train' ELSE 'test' END AS split
FROM customer JOIN orders ON c_custkey = o_custkey""")
def group_split(t: Tables):
    visits = t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", "o_orderkey")
    return split.with_split(visits, "c_custkey")
