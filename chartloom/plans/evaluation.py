"""Catalog: metrics, curves, bootstrap intervals, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from chartloom.functions import labels
from chartloom.functions.hashing import PRIME, SECOND
from chartloom.operators import bootstrap, curves, metrics, report
from chartloom.operators.features import document_frequency
from chartloom.operators.models import balanced_weights
from chartloom.plans.registry import Tables, query
from chartloom.plans.texts import WORDS_SQL, plain
from chartloom.functions.text import word_tokens

# labelled documents: a true class and score, and made-up predictions that follow from the row
SCORED_SQL = """
scored AS (SELECT d.doc_id, l.quality AS y, CAST((n_chars * 37 + d.doc_id * 11 + 30 * l.quality) % 101 AS DOUBLE) / 100 AS one,
    CAST(100 - (n_chars * 37 + d.doc_id * 11 + 30 * l.quality) % 101 AS DOUBLE) / 100 AS zero,
    CAST((n_chars * 37 + d.doc_id * 11 + 30 * l.quality) % 101 >= 40 AS INTEGER) AS y_hard,
    (n_chars * 13 + d.doc_id) % 7 AS mrs, CAST(((n_chars * 13 + d.doc_id) % 7) * 5 + (n_chars * 7 + d.doc_id * 3) % 31 AS DOUBLE) / 10 AS y_pred,
    CASE WHEN n_chars % 11 <> 0 THEN n_chars % 50 END AS nmin
  FROM documents d JOIN labels l USING (doc_id))"""


def scored(t: Tables):
    points = (F.col("n_chars") * 37 + F.col("doc_id") * 11 + F.col("quality") * 30) % 101
    mrs = (F.col("n_chars") * 13 + F.col("doc_id")) % 7
    return t.documents.select("doc_id", "n_chars").join(t.labels, "doc_id").select(
        "doc_id", F.col("quality").alias("y"), (points / 100).alias("one"), ((100 - points) / 100).alias("zero"),
        (points >= 40).cast("int").alias("y_hard"), mrs.alias("mrs"),
        ((mrs * 5 + (F.col("n_chars") * 7 + F.col("doc_id") * 3) % 31) / 10).alias("y_pred"),
        F.when(F.col("n_chars") % 11 != 0, F.col("n_chars") % 50).alias("nmin"))


def rounded(df, *columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


# one-vs-rest rows; `micro` looks at both classes as one list
STACKED_SQL = """
stacked AS (SELECT doc_id, '0' AS scope, 1 - y AS truth, zero AS score FROM scored UNION ALL SELECT doc_id, '1', y, one FROM scored
  UNION ALL SELECT doc_id, 'micro', 1 - y, zero FROM scored UNION ALL SELECT doc_id, 'micro', y, one FROM scored)"""

# running counts per distinct score, weights and replicates included
CURVE_SQL = """
totals AS (SELECT rep, scope, score, CAST(sum(w * truth) AS BIGINT) AS pos, CAST(sum(w * (1 - truth)) AS BIGINT) AS neg FROM weighted GROUP BY ALL),
runs AS (SELECT *, CAST(sum(pos) OVER (PARTITION BY rep, scope ORDER BY score DESC) AS BIGINT) AS cp,
    CAST(sum(neg) OVER (PARTITION BY rep, scope ORDER BY score DESC) AS BIGINT) AS cn,
    CAST(sum(pos) OVER (PARTITION BY rep, scope) AS BIGINT) AS ap, CAST(sum(neg) OVER (PARTITION BY rep, scope) AS BIGINT) AS an FROM totals),
areas AS (SELECT rep, scope, CASE WHEN max(ap) * max(an) > 0 THEN sum(neg * (cp - pos / 2.0::DOUBLE)) / (max(ap) * CAST(max(an) AS DOUBLE)) END AS auroc,
    sum(pos * (cp / CAST(cp + cn AS DOUBLE))) / max(ap) AS ap,
    sum(pos * (cp / CAST(cp + cn AS DOUBLE) + CASE WHEN cp + cn - pos - neg = 0 THEN 1 ELSE (cp - pos) / CAST(cp + cn - pos - neg AS DOUBLE) END) / 2) / max(ap) AS auprc
  FROM runs GROUP BY ALL)"""
PLAIN_CURVE_SQL = f"{SCORED_SQL}, {STACKED_SQL}, weighted AS (SELECT 0 AS rep, 1 AS w, * FROM stacked), {CURVE_SQL}"


def stacked(t: Tables):
    return curves.stacked(scored(t), {"0": (1 - F.col("y"), F.col("zero")), "1": (F.col("y"), F.col("one"))}, ["doc_id"])


@query(f"WITH {SCORED_SQL} SELECT round(sqrt(avg(pow(mrs - y_pred, 2))), 6) AS rmse FROM scored")
def rmse(t: Tables):
    return rounded(scored(t).agg(metrics.rmse_of(F.col("mrs"), F.col("y_pred")).alias("rmse")), "rmse")


def ranks_sql(source: str, keys: str = "", name: str = "ranks") -> str:
    part = f"PARTITION BY {keys}" if keys else ""
    also = f"PARTITION BY {keys}, " if keys else "PARTITION BY "
    return f"""{name} AS (SELECT *,
      rank() OVER ({part} ORDER BY mrs) + (count(*) OVER ({also} mrs) - 1) / 2.0::DOUBLE AS rt,
      rank() OVER ({part} ORDER BY y_pred) + (count(*) OVER ({also} y_pred) - 1) / 2.0::DOUBLE AS rp FROM {source})"""


@query(f"WITH {SCORED_SQL}, {ranks_sql('scored')} SELECT round(corr(rt, rp), 6) AS spearman FROM ranks")
def spearman(t: Tables):
    return rounded(metrics.spearman(scored(t), [], "mrs", "y_pred"), "spearman")


# ---- curves ------------------------------------------------------------------------------------

@query(f"""
WITH {PLAIN_CURVE_SQL},
n AS (SELECT *, lead(pos) OVER w AS next_pos, lead(neg) OVER w AS next_neg, row_number() OVER w AS place FROM runs
      WINDOW w AS (PARTITION BY scope ORDER BY score DESC))
SELECT scope, score AS threshold, round(cn / CAST(an AS DOUBLE), 6) AS fpr, round(cp / CAST(ap AS DOUBLE), 6) AS tpr FROM n
WHERE place = 1 OR next_pos IS NULL OR next_pos <> pos OR next_neg <> neg
UNION ALL SELECT DISTINCT scope, CAST(NULL AS DOUBLE), 0.0::DOUBLE, 0.0::DOUBLE FROM runs""")
def roc_points(t: Tables):
    return rounded(curves.roc_points(stacked(t), ["scope"], "truth", "score"), "fpr", "tpr")


@query(f"WITH {PLAIN_CURVE_SQL} SELECT scope, round(auroc, 6) AS auc FROM areas WHERE scope <> 'micro'")
def auc(t: Tables):
    areas = curves.curve_areas(stacked(t).where("scope <> 'micro'"), ["scope"], "truth", "score")
    return areas.select("scope", F.round("auroc", 6).alias("auc"))


@query(f"WITH {PLAIN_CURVE_SQL} SELECT round(auroc, 6) AS auc FROM areas WHERE scope = 'micro'")
def auc_micro(t: Tables):
    areas = curves.curve_areas(stacked(t).where("scope = 'micro'"), [], "truth", "score")
    return areas.select(F.round("auroc", 6).alias("auc"))


@query(f"""
WITH {PLAIN_CURVE_SQL},
n AS (SELECT *, lead(pos) OVER w AS next_pos, lead(neg) OVER w AS next_neg, row_number() OVER w AS place FROM runs WHERE scope <> 'micro'
      WINDOW w AS (PARTITION BY scope ORDER BY score DESC)),
pts AS (SELECT scope, cn / CAST(an AS DOUBLE) AS fpr, cp / CAST(ap AS DOUBLE) AS tpr FROM n
  WHERE place = 1 OR next_pos IS NULL OR next_pos <> pos OR next_neg <> neg UNION ALL SELECT DISTINCT scope, 0.0, 0.0 FROM runs WHERE scope <> 'micro'),
ends AS (SELECT scope, fpr, max(tpr) AS high, min(tpr) AS low FROM pts GROUP BY ALL),
grid AS (SELECT DISTINCT p.fpr, s.scope FROM pts p, (SELECT DISTINCT scope FROM pts) s),
placed AS (SELECT g.scope, g.fpr, e.high,
    (SELECT max(b.fpr) FROM ends b WHERE b.scope = g.scope AND b.fpr <= g.fpr) AS x0,
    (SELECT min(a.fpr) FROM ends a WHERE a.scope = g.scope AND a.fpr >= g.fpr) AS x1
  FROM grid g LEFT JOIN ends e ON e.scope = g.scope AND e.fpr = g.fpr),
val AS (SELECT p.scope, p.fpr, coalesce(p.high, b.high + (a.low - b.high) * (p.fpr - x0) / (x1 - x0)) AS v
  FROM placed p JOIN ends b ON b.scope = p.scope AND b.fpr = x0 JOIN ends a ON a.scope = p.scope AND a.fpr = x1),
mean AS (SELECT fpr, avg(v) AS tpr FROM val GROUP BY 1),
area AS (SELECT sum((nx - fpr) * (nt + tpr) / 2) AS auc FROM (SELECT *, lead(fpr) OVER (ORDER BY fpr) AS nx, lead(tpr) OVER (ORDER BY fpr) AS nt FROM mean))
SELECT round(fpr, 6) AS fpr, round(tpr, 6) AS tpr, round(auc, 6) AS auc FROM mean, area""")
def roc_macro(t: Tables):
    points = curves.roc_points(stacked(t).where("scope <> 'micro'"), ["scope"], "truth", "score")
    mean = curves.macro_roc(points, "scope", ["0", "1"])
    return rounded(mean.withColumn("auc", curves.trapezoid_area(mean).scalar()), "fpr", "tpr", "auc")


@query(f"""
WITH {PLAIN_CURVE_SQL} SELECT scope, score AS threshold, round(cp / CAST(cp + cn AS DOUBLE), 6) AS precision,
  round(cp / CAST(ap AS DOUBLE), 6) AS recall, round(2 * cp / CAST(cp + cn + ap AS DOUBLE), 6) AS f1 FROM runs""")
def pr_points(t: Tables):
    return rounded(curves.pr_points(stacked(t), ["scope"], "truth", "score"), "precision", "recall", "f1")


@query(f"WITH {PLAIN_CURVE_SQL} SELECT scope, round(ap, 6) AS ap FROM areas")
def avg_precision(t: Tables):
    return curves.curve_areas(stacked(t), ["scope"], "truth", "score").select("scope", F.round("ap", 6).alias("ap"))


@query(f"WITH {PLAIN_CURVE_SQL} SELECT scope, round(auprc, 6) AS auprc FROM areas")
def auprc(t: Tables):
    return curves.curve_areas(stacked(t), ["scope"], "truth", "score").select("scope", F.round("auprc", 6).alias("auprc"))


@query(f"""
WITH {PLAIN_CURVE_SQL}, f AS (SELECT scope, score, 2 * cp / CAST(cp + cn + ap AS DOUBLE) AS f1 FROM runs),
b AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY f1 DESC, score) AS r FROM f)
SELECT scope, score AS threshold, round(f1, 6) AS f1 FROM b WHERE r = 1""")
def f1_threshold(t: Tables):
    return rounded(curves.f1_threshold(stacked(t), ["scope"], "truth", "score"), "f1")


# ---- labels and confusion ----------------------------------------------------------------------

@query(f"WITH {SCORED_SQL} SELECT doc_id, {', '.join(f'CAST(mrs = {k} AS INTEGER) AS class_{k}' for k in range(7))} FROM scored")
def one_hot(t: Tables):
    return scored(t).select("doc_id", *labels.one_hot(F.col("mrs"), range(7)))


@query(f"WITH {SCORED_SQL} SELECT doc_id, CAST(one > zero AS INTEGER) AS label FROM scored")
def argmax_label(t: Tables):
    return scored(t).select("doc_id", labels.argmax_label(F.col("zero"), F.col("one")).alias("label"))


CONFUSION_SQL = f"""{SCORED_SQL},
grid AS (SELECT a.k AS mrs, b.k AS predicted FROM range(7) a(k), range(7) b(k)),
counted AS (SELECT g.mrs, g.predicted, count(s.doc_id) AS n FROM grid g LEFT JOIN scored s ON s.mrs = g.mrs
  AND CAST(round_even(least(y_pred, 6), 0) AS BIGINT) = g.predicted GROUP BY ALL)"""


def confusion_table(t: Tables):
    predicted = F.rint(labels.clip(F.col("y_pred"))).cast("int")
    return metrics.confusion(scored(t).select(F.col("mrs").cast("int").alias("mrs"), predicted.alias("predicted")),
                             "mrs", "predicted", list(range(7)))


@query(f"WITH {CONFUSION_SQL} SELECT CAST(mrs AS INTEGER) AS mrs, CAST(predicted AS INTEGER) AS predicted, n FROM counted")
def confusion(t: Tables):
    return confusion_table(t).select("mrs", "predicted", "n")


@query(f"""
WITH {CONFUSION_SQL} SELECT CAST(mrs AS INTEGER) AS mrs, CAST(predicted AS INTEGER) AS predicted,
  round(coalesce(n / CAST(nullif(sum(n) OVER (PARTITION BY mrs), 0) AS DOUBLE), 0), 6) AS of_true,
  round(coalesce(n / CAST(nullif(sum(n) OVER (PARTITION BY predicted), 0) AS DOUBLE), 0), 6) AS of_predicted FROM counted""")
def confusion_norm(t: Tables):
    return rounded(confusion_table(t).drop("n"), "of_true", "of_predicted")


# hard-label metrics from (rep, cell counts); `a_` by argmax, `t_` by the tuned label
CELLS_SQL = """
cells AS (SELECT rep, {0} FROM {1} GROUP BY rep),
hard AS (SELECT rep, unnest([{2}]) AS m FROM cells)"""


def _cells() -> str:
    out = []
    for prefix, column in (("a", "(one > zero)::INTEGER"), ("t", "y_hard")):
        for name, y, p in (("tp", 1, 1), ("fp", 0, 1), ("fn", 1, 0), ("tn", 0, 0)):
            out.append(f"CAST(sum(w) FILTER (y = {y} AND {column} = {p}) AS DOUBLE) AS {prefix}_{name}_raw")
            out.append(f"coalesce(CAST(sum(w) FILTER (y = {y} AND {column} = {p}) AS DOUBLE), 0) AS {prefix}_{name}")
    return ", ".join(c for c in out if not c.endswith("_raw"))


def _label_sql(tp, fp, fn, tn) -> dict[str, str]:
    def r(a, b):
        return f"(CASE WHEN {b} = 0 THEN 0 ELSE ({a}) / ({b}) END)"
    return {"ACC": f"(({tp} + {tn}) / ({tp} + {fp} + {fn} + {tn}))", "Recall": r(tp, f"({tp} + {fn})"), "Spec": r(tn, f"({tn} + {fp})"),
            "F1": r(f"2 * {tp}", f"(2 * {tp} + {fp} + {fn})"), "PPV": r(tp, f"({tp} + {fp})")}


def _hard_structs() -> str:
    structs = []
    a = [f"a_{c}" for c in ("tp", "fp", "fn", "tn")]
    b = [f"t_{c}" for c in ("tp", "fp", "fn", "tn")]
    one_a, zero_a = _label_sql(*a), _label_sql(a[3], a[2], a[1], a[0])
    one_t, zero_t = _label_sql(*b), _label_sql(b[3], b[2], b[1], b[0])
    for m in one_a:
        structs += [("0", m, zero_t[m]), ("1", m, one_t[m]), ("micro", m, one_a["ACC"]),
                    ("macro", m, one_a["ACC"] if m == "ACC" else f"({one_a[m]} + {zero_a[m]}) / 2")]
    return ", ".join(f"{{'scope': '{s}', 'metric': '{m}', 'value': {v}}}" for s, m, v in structs)


def values_sql(rows: str) -> str:
    """(rep, scope, metric, value) from a weighted table of scored rows."""
    return f"""{CELLS_SQL.format(_cells(), rows, _hard_structs())},
soft AS (SELECT rep, scope, unnest([{{'metric': 'AUROC', 'value': auroc}}, {{'metric': 'AP', 'value': ap}}, {{'metric': 'AUPRC', 'value': auprc}}]) AS m FROM areas),
flat AS (SELECT rep, m.scope AS scope, m.metric AS metric, m.value AS value FROM hard
  UNION ALL SELECT rep, scope, m.metric, m.value FROM soft
  UNION ALL SELECT rep, 'macro', m.metric, CASE WHEN m.metric = 'AUPRC' THEN max(m.value) FILTER (scope = 'micro')
    ELSE avg(m.value) FILTER (scope <> 'micro') END FROM soft GROUP BY rep, m.metric)"""


REPORT_SQL = f"{PLAIN_CURVE_SQL}, hardrows AS (SELECT 0 AS rep, 1 AS w, * FROM scored), {values_sql('hardrows')}"


@query(f"WITH {REPORT_SQL} SELECT scope, metric, round(value, 6) AS value FROM flat")
def binary_report(t: Tables):
    return rounded(bootstrap.binary_report(scored(t)), "value")


def _scope_query(name: str, scopes: tuple[str, ...]):
    listed = ", ".join(f"'{s}'" for s in scopes)

    def run(t: Tables):
        return rounded(bootstrap.binary_report(scored(t)).where(F.col("scope").isin(*scopes)), "value")
    run.__name__ = name
    return query(f"WITH {REPORT_SQL} SELECT scope, metric, round(value, 6) AS value FROM flat WHERE scope IN ({listed})")(run)


_scope_query("binary_metrics_macro", ("macro",))
_scope_query("binary_metrics_micro", ("micro",))
_scope_query("binary_metrics_label", ("0", "1"))


@query("""
SELECT quality AS y, (SELECT count(*) FROM labels) / CAST(2 * count(*) AS DOUBLE) AS weight FROM labels GROUP BY 1""")
def class_weights(t: Tables):
    return balanced_weights(t.labels.withColumnRenamed("quality", "y"), "y")


# ---- bootstrap ---------------------------------------------------------------------------------

def draw_sql(row: str, row2: str, rep: str, seed: int) -> str:
    return f"(({one_draw_sql(row, rep, seed)} + {one_draw_sql(row2, rep, seed + SECOND)}) % {PRIME})"


def one_draw_sql(row: str, rep: str, seed: int) -> str:
    a = f"(({rep} * 48271 + {seed * 69621 + 16807}) % {PRIME})"
    b = f"(({rep} * 39373 + {seed * 742938285 % PRIME + 1}) % {PRIME})"
    first = f"(({row} * ({a} + 1) + {b}) % {PRIME})"
    return f"(((xor({first}, {first} >> 15) % {PRIME}) * 630360016 + {a}) % {PRIME})"


def seed_sql(key: str, at: int = 1) -> str:
    return f"(('0x' || substr(md5(CAST({key} AS VARCHAR)), {at}, 8))::BIGINT % {PRIME})"


def replicate_sql(source: str, seed: int, replicates: int = bootstrap.REPLICATES, name: str = "reps") -> str:
    weight = " + ".join(f"CAST(u >= {cut} AS INTEGER)" for cut in bootstrap.poisson_cuts())
    return f"""{name}_seeds AS (SELECT *, {seed_sql('doc_id')} AS h, {seed_sql('doc_id', 9)} AS h2 FROM {source}),
{name}_drawn AS (SELECT s.*, r.rep, {draw_sql('s.h', 's.h2', 'r.rep', seed)} AS u FROM {name}_seeds s, range({replicates}) r(rep)),
{name} AS (SELECT * EXCLUDE (u, h, h2), {weight} AS w FROM {name}_drawn WHERE {weight} > 0)"""


@query(f"""
WITH {SCORED_SQL}, {replicate_sql('scored', 1)},
v AS (SELECT rep, sqrt(sum(w * pow(mrs - y_pred, 2)) / sum(w)) AS value FROM reps GROUP BY rep HAVING min(mrs) < max(mrs))
SELECT round(quantile_cont(value, 0.025), 6) AS lo, round(quantile_cont(value, 0.975), 6) AS hi, count(*) AS used FROM v""")
def bootstrap_rmse(t: Tables):
    return rounded(bootstrap.bootstrap_rmse(scored(t), "doc_id", "mrs", "y_pred"), "lo", "hi")


@query(f"""
WITH {SCORED_SQL}, {replicate_sql('scored', 42)},
e AS (SELECT r.* FROM (SELECT *, unnest(range(w)) AS copy FROM reps) r), {ranks_sql('e', 'rep')},
v AS (SELECT rep, corr(rt, rp) AS value FROM ranks GROUP BY rep)
SELECT round(quantile_cont(value, 0.025), 6) AS lo, round(quantile_cont(value, 0.975), 6) AS hi, count(*) AS used FROM v""")
def bootstrap_spearman(t: Tables):
    return rounded(bootstrap.bootstrap_spearman(scored(t), "doc_id", "mrs", "y_pred"), "lo", "hi")


@query(f"""
WITH {SCORED_SQL}, {replicate_sql('scored', 1)},
weighted AS (SELECT rep, w, '0' AS scope, 1 - y AS truth, zero AS score FROM reps UNION ALL SELECT rep, w, '1', y, one FROM reps
  UNION ALL SELECT rep, w, 'micro', 1 - y, zero FROM reps UNION ALL SELECT rep, w, 'micro', y, one FROM reps), {CURVE_SQL},
{values_sql('reps')}, usable AS (SELECT rep FROM reps GROUP BY rep HAVING min(y) < max(y))
SELECT scope, metric, round(greatest(quantile_cont(value, 0.025), 0), 6) AS lo, round(least(quantile_cont(value, 0.975), 1), 6) AS hi,
  count(*) AS used FROM flat SEMI JOIN usable USING (rep) GROUP BY ALL""")
def bootstrap_binary(t: Tables):
    return rounded(bootstrap.bootstrap_binary(scored(t), "doc_id"), "lo", "hi")


@query(f"""
WITH {SCORED_SQL}, p AS (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS place, count(*) OVER () AS n FROM scored),
k AS (SELECT place AS k, n, {seed_sql('place')} AS h, {seed_sql('place', 9)} AS h2 FROM p), r AS (SELECT rep FROM range({bootstrap.REPLICATES}) r(rep)),
d AS (SELECT rep, CAST(floor({draw_sql('h', 'h2', 'rep', 1)} * n / {PRIME}) AS BIGINT) AS place FROM k, r),
v AS (SELECT rep, sqrt(avg(pow(mrs - y_pred, 2))) AS value FROM d JOIN p USING (place) GROUP BY rep)
SELECT round(quantile_cont(value, 0.025), 6) AS lo, round(quantile_cont(value, 0.975), 6) AS hi, count(*) AS used FROM v""")
def bootstrap_exact(t: Tables):
    drawn = bootstrap.resample(scored(t).select("doc_id", "mrs", "y_pred"), "doc_id")
    reps = drawn.groupBy("rep").agg(metrics.rmse_of(F.col("mrs"), F.col("y_pred"), F.col("w")).alias("value"))
    return rounded(bootstrap.interval(reps, [], "value"), "lo", "hi")


BANDS_SQL = "(VALUES ('0', -1, 0), ('(0,7]', 0, 7), ('(7,35]', 7, 35), ('>35', 35, 1000000), ('>7', 7, 1000000)) AS b(band, above, upto)"


@query(f"""
WITH {SCORED_SQL}, banded AS (SELECT b.band, s.* FROM scored s JOIN {BANDS_SQL} ON s.nmin > b.above AND s.nmin <= b.upto),
{ranks_sql('banded', 'band')}, pts AS (SELECT band, count(*) AS rows, sqrt(avg(pow(mrs - y_pred, 2))) AS rmse, corr(rt, rp) AS spearman FROM ranks GROUP BY 1),
{replicate_sql('banded', 1)}, v AS (SELECT band, rep, sqrt(sum(w * pow(mrs - y_pred, 2)) / sum(w)) AS value FROM reps GROUP BY ALL HAVING min(mrs) < max(mrs)),
ci AS (SELECT band, quantile_cont(value, 0.025) AS lo, quantile_cont(value, 0.975) AS hi FROM v GROUP BY 1),
{replicate_sql('banded', 42, name='others')}, e AS (SELECT o.* FROM (SELECT *, unnest(range(w)) AS copy FROM others) o), {ranks_sql('e', 'band, rep', 'rep_ranks')},
rho AS (SELECT band, rep, corr(rt, rp) AS value FROM rep_ranks GROUP BY ALL),
ci_rho AS (SELECT band, quantile_cont(value, 0.025) AS lo, quantile_cont(value, 0.975) AS hi FROM rho WHERE NOT isnan(value) GROUP BY 1)
SELECT pts.band, rows, round(rmse, 6) AS rmse, round(spearman, 6) AS spearman, round(ci.lo, 6) AS rmse_lo, round(ci.hi, 6) AS rmse_hi,
  round(ci_rho.lo, 6) AS spearman_lo, round(ci_rho.hi, 6) AS spearman_hi
FROM pts LEFT JOIN ci ON pts.band = ci.band LEFT JOIN ci_rho ON pts.band = ci_rho.band""")
def metrics_by_band(t: Tables):
    out = report.regression_by_band(scored(t), "doc_id", "mrs", "y_pred", "nmin")
    return rounded(out, "rmse", "spearman", "rmse_lo", "rmse_hi", "spearman_lo", "spearman_hi")


# a band, and a band's replicate, are one number: both are reported from one set of curves. Rows are drawn once,
# whatever bands they are in, and rows with equal scores are one weight before the curves
BAND_CODES = "(VALUES (0, '0', -1, 0), (2000, '(0,7]', 0, 7), (4000, '(7,35]', 7, 35), (6000, '>35', 35, 1000000), (8000, '>7', 7, 1000000)) AS b(code, band, above, upto)"


def by_band_sql(codes: str, rows: str = "scored") -> str:
    return f"""{replicate_sql(rows, 1, name='drawn')},
every AS (SELECT nmin, y, zero, one, y_hard, rep + 1 AS rep, w FROM drawn UNION ALL SELECT nmin, y, zero, one, y_hard, 0, 1 FROM {rows}),
reps AS (SELECT code + rep AS rep, y, zero, one, y_hard, CAST(sum(w) AS BIGINT) AS w FROM every JOIN {codes} ON nmin > above AND nmin <= upto GROUP BY ALL),
weighted AS (SELECT rep, w, '0' AS scope, 1 - y AS truth, zero AS score FROM reps UNION ALL SELECT rep, w, '1', y, one FROM reps
  UNION ALL SELECT rep, w, 'micro', 1 - y, zero FROM reps UNION ALL SELECT rep, w, 'micro', y, one FROM reps), {CURVE_SQL},
{values_sql('reps')}, usable AS (SELECT rep FROM reps GROUP BY rep HAVING min(y) < max(y)),
points AS (SELECT band, scope, metric, value FROM flat JOIN {codes} ON rep = code),
ranges AS (SELECT band, scope, metric, greatest(quantile_cont(value, 0.025), 0) AS lo, least(quantile_cont(value, 0.975), 1) AS hi
  FROM flat SEMI JOIN usable USING (rep) JOIN {codes} ON rep > code AND rep <= code + {bootstrap.REPLICATES} GROUP BY ALL)"""


def ci_sql(lo: str = "lo", hi: str = "hi") -> str:
    return f"' [' || CAST(round({lo}, 2) AS VARCHAR) || '-' || CAST(round({hi}, 2) AS VARCHAR) || ']'"


@query(f"""
WITH {SCORED_SQL}, {by_band_sql(BAND_CODES)}
SELECT band, scope, metric, round(value, 6) AS value, round(lo, 6) AS lo, round(hi, 6) AS hi, {ci_sql()} AS ci
FROM points JOIN ranges USING (band, scope, metric)""")
def binary_by_band(t: Tables):
    return rounded(report.binary_by_band(scored(t), "doc_id", "nmin"), "value", "lo", "hi").drop("used")


EXTERNAL_CODES = "(VALUES (0, '0', -1, 0), (2000, '>0', 0, 1000000)) AS b(code, band, above, upto)"


@query(f"""
WITH {SCORED_SQL}, {by_band_sql(EXTERNAL_CODES)}
SELECT band, scope, metric, round(value, 6) AS value, round(lo, 6) AS lo, round(hi, 6) AS hi, {ci_sql()} AS ci
FROM points JOIN ranges USING (band, scope, metric)""")
def external_by_band(t: Tables):
    found = report.binary_by_band(scored(t), "doc_id", "nmin", report.EXTERNAL_BANDS)
    return rounded(found, "value", "lo", "hi").drop("used")


EVERY_CODE = "(VALUES (0, 'all', -1000000, 1000000)) AS b(code, band, above, upto)"


@query(f"""
WITH {SCORED_SQL}, all_rows AS (SELECT * REPLACE (0 AS nmin) FROM scored), {by_band_sql(EVERY_CODE, 'all_rows')}
SELECT scope, metric, round(value, 6) AS value, round(lo, 6) AS lo, round(hi, 6) AS hi, {ci_sql()} AS ci
FROM points JOIN ranges USING (band, scope, metric)""")
def binary_performance(t: Tables):
    return rounded(bootstrap.perf(scored(t), "doc_id"), "value", "lo", "hi").drop("used")


# ---- coefficient reports -----------------------------------------------------------------------

COEF_SQL = f"""w AS (SELECT doc_id, unnest(list_distinct({WORDS_SQL})) AS term FROM documents),
coefs AS (SELECT term, CAST((count(*) * 37 + length(term) * 13) % 101 - 50 AS DOUBLE) / 50 AS coef FROM w GROUP BY term),
top AS (SELECT term, coef FROM coefs WHERE coef <> 0 ORDER BY abs(coef) DESC, term LIMIT 20)"""


def coefficients(t: Tables):
    """Made-up weights for all words, from how often they occur."""
    counted = document_frequency(t.texts.select(plain().alias("Notes")), word_tokens(F.col("Notes")))
    return counted.select("term", (((F.col("df") * 37 + F.length("term") * 13) % 101 - 50) / 50).alias("coef"))


@query(f"WITH {COEF_SQL} SELECT * FROM top")
def top_terms(t: Tables):
    return report.top_terms(coefficients(t))


@query(f"""
WITH {COEF_SQL} SELECT term, coef, round(coef * 100 / max(abs(coef)) OVER (), 6) AS importance,
  CASE WHEN coef < 0 THEN 'negative' ELSE 'positive' END AS sign FROM top""")
def importance_pct(t: Tables):
    return rounded(report.importance(report.top_terms(coefficients(t))), "importance")
