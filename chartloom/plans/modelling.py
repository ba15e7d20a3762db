"""Catalog: model fitting and search on the labelled documents. Fits have no SQL counterpart, their optimality has."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from chartloom.functions import labels
from chartloom.operators import bootstrap, curves, features, models
from chartloom.operators.split import with_split
from chartloom.plans.feature import GRAMS_SQL
from chartloom.plans.registry import Tables, query
from chartloom.plans.stages import NUMERIC, binary_predictions, importance_report, linear_predictions, linear_report
from chartloom.plans.texts import plain
from chartloom.sources.checkpoints import materialise


def training(t: Tables) -> tuple[DataFrame, list[str]]:
    """Labelled documents with n-gram and numeric features; the score is a mix of label and length."""
    docs = t.texts.join(t.labels, "doc_id").select(
        "doc_id", plain().alias("Notes"), F.col("quality").alias("y"),
        (F.col("quality") * 3.0 + F.col("toxic") * 2 + F.least(F.col("n_chars") / 4000, F.lit(1.0))).alias("mrs"),
        F.least(F.col("n_chars") / 20000, F.lit(1.0)).alias("Age_scaled"), (F.col("doc_id") % 2).alias("SexDSC"),
        F.col("toxic").alias("Expired"), F.lit(0).alias("follow_up"))
    vocabulary = features.fit_ngram_vocabulary(docs, "Notes")
    return models.pack(features.vectorise(docs, "Notes", vocabulary, NUMERIC)), vocabulary


def _pairs(t: Tables, rows, schema: str) -> DataFrame:
    return t.spark.createDataFrame([(float(a), float(b)) for a, b in rows], schema)


@query()
def lasso_fit(t: Tables):
    train, vocabulary = training(t)
    model = models.lasso(models.BEST_ALPHA).fit(train)
    return models.coefficient_table(t.spark, [*vocabulary, *NUMERIC], model.coefficients)


@query()
def lasso_grid(t: Tables):
    train, _ = training(t)
    return _pairs(t, models.search_alpha(train, "doc_id"), "alpha double, r2 double")


@query()
def lasso_importance(t: Tables):
    train, vocabulary = training(t)
    return importance_report(models.lasso(models.BEST_ALPHA).fit(train), vocabulary, t.spark)


@query()
def logit_fit(t: Tables):
    train, vocabulary = training(t)
    model = models.fit_logistic(models.prepare_classes(train), 0.5)
    return models.coefficient_table(t.spark, [*vocabulary, *NUMERIC, "(intercept)"], model.coefficients)


# Every feature's optimality condition holds. The vocabulary is DuckDB's own: a term too many or too few shows.
LABELLED_SQL = "labelled AS (SELECT d.* FROM documents d JOIN labels USING (doc_id))"


def certified_sql(names: list[str]) -> str:
    listed = ", ".join(f"('{n}')" for n in names)
    return f"""
WITH {LABELLED_SQL}, {GRAMS_SQL.replace('FROM documents', 'FROM labelled')}
SELECT term, true AS holds FROM v UNION ALL SELECT name, true FROM (VALUES {listed}) AS n(name)"""


@query(certified_sql(NUMERIC))
def lasso_certificate(t: Tables):
    train, vocabulary = training(t)
    model = models.lasso(models.BEST_ALPHA).fit(train)
    residual = F.col("mrs") - F.col("y_pred")
    return models.certificate(model.transform(train), residual, [*vocabulary, *NUMERIC], model.coefficients, models.BEST_ALPHA,
                              models.CERTIFIED * models.BEST_ALPHA).select("term", "holds")


@query(certified_sql([*NUMERIC, "(intercept)"]))
def logit_certificate(t: Tables):
    train, vocabulary = training(t)
    prepared = models.pack(models.prepare_classes(train))
    model = models.fit_logistic(prepared, 0.5)
    scored = models.probabilities(model.transform(prepared))
    penalty = 1.0 / (0.5 * prepared.count())
    return models.certificate(scored, F.col("y") - F.col("one"), [*vocabulary, *NUMERIC, "(intercept)"], model.coefficients, penalty,
                              models.CERTIFIED * penalty, "features_1", F.col("weight")).select("term", "holds")


@query()
def logit_grid(t: Tables):
    train, _ = training(t)
    return _pairs(t, models.search_penalty(models.prepare_classes(train), "doc_id"), "inverse_penalty double, accuracy double")


@query()
def logit_report(t: Tables):
    """Fit, tune the threshold in training, apply the death rule, report with intervals."""
    train, _ = training(t)
    prepared = models.prepare_classes(train)
    scored = models.probabilities(models.fit_logistic(prepared, 0.5).transform(prepared))
    rows = materialise(scored.select("doc_id", "y", "zero", "one", "Expired"))
    threshold = curves.f1_threshold(rows, [], "y", "one").first()["threshold"]
    hard = F.when(F.col("Expired") == 1, 1).otherwise(models.tuned_label(F.col("one"), F.lit(threshold)))
    return bootstrap.perf(rows.withColumn("y_hard", hard), "doc_id").select(
        "scope", "metric", *[F.round(c, 6).alias(c) for c in ("value", "lo", "hi")], "ci")


@query()
def lasso_predictions(t: Tables):
    train, _ = training(t)
    scored = models.lasso(models.BEST_ALPHA).fit(train).transform(train)
    ruled = labels.override_prediction(labels.clip(F.col("y_pred")), F.col("Expired"))
    return scored.select("doc_id", "mrs", F.round(ruled, 4).alias("y_pred"))


def _split_training(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Training and test rows of the entity split; terms and ranges come from the training rows."""
    docs = t.texts.join(t.labels, "doc_id").select(
        "doc_id", plain().alias("Notes"), (F.col("quality") * 3 + F.col("toxic") * 2).alias("mrs"),
        F.least(F.col("n_chars") / 20000, F.lit(1.0)).alias("Age_scaled"), (F.col("doc_id") % 2).alias("SexDSC"),
        F.col("toxic").alias("Expired"), F.lit(0).alias("follow_up"))
    docs = materialise(with_split(docs, "doc_id"))
    train, test = docs.where("split = 'train'"), docs.where("split = 'test'")
    vocabulary = features.fit_ngram_vocabulary(train, "Notes")
    return (models.pack(features.vectorise(train, "Notes", vocabulary, NUMERIC)),
            features.vectorise(test, "Notes", vocabulary, NUMERIC))


@query()
def linear_stage(t: Tables):
    """Search on the training rows, refit with the best penalty, rules and report on the test rows."""
    train, test = _split_training(t)
    alpha = models.best_setting(models.search_alpha(train, "doc_id"))
    _, scored = linear_predictions(train, test, None, ["doc_id"], alpha)
    report = linear_report(materialise(scored.select("doc_id", "mrs", "y_pred")), "doc_id")
    return report.select(F.lit(float(alpha)).alias("alpha"), *[F.round(c, 6).alias(c) for c in report.columns])


@query()
def binary_stage(t: Tables):
    """The same for the two-class outcome: search, refit, threshold from training, report on the test rows."""
    train, test = _split_training(t)
    prepared = models.prepare_classes(train.withColumn("y", labels.dichotomise(F.col("mrs"))))
    penalty = models.best_setting(models.search_penalty(prepared, "doc_id"))
    _, _, scored = binary_predictions(train, test, None, ["doc_id"], penalty)
    rows = materialise(scored.select("doc_id", "y", "zero", "one", "y_hard"))
    return bootstrap.perf(rows, "doc_id").select(
        F.lit(float(penalty)).alias("inverse_penalty"), "scope", "metric", *[F.round(c, 6).alias(c) for c in ("value", "lo", "hi")], "ci")
