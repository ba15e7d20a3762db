"""The stages end to end: raw tables to notes, documents, models and reports.

Every stage takes and returns DataFrames. Where a table feeds several later branches it is cut
with `materialise`; pass `cut=lambda df: df` to keep one lazy plan.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from chartloom.functions import labels
from chartloom.functions.text import word_tokens
from chartloom.operators import bootstrap, curves, extract, features, metrics, models, notes, report
from chartloom.operators.grouping import union_all
from chartloom.operators.joins import attach, enrich
from chartloom.operators.split import with_split
from chartloom.operators.stems import StemStore
from chartloom.schemas import DOCUMENT_KEYS
from chartloom.sources.adapters import SiteAdapter, adapt
from chartloom.sources.checkpoints import materialise

Cut = Callable[[DataFrame], DataFrame]
NUMERIC = ["Age_scaled", "SexDSC", "Expired", "follow_up"]


@dataclass
class NoteTables:
    follow_up_lines: DataFrame
    discharge_typed: DataFrame
    follow_up_typed: DataFrame
    clean: DataFrame


def prepare_notes(admissions: DataFrame, note_lines: DataFrame, stop_words: list[str],
                  cut: Cut = materialise, stems: StemStore | None = None) -> NoteTables:
    """Stage 1: both cohorts' lines, typed notes and normalised notes, stacked with `follow_up`. `stems` is the
    stored relation of stems both cohorts share, if one is to be kept."""
    dis_lines = cut(notes.discharge_lines(admissions, note_lines))
    fup_lines = cut(notes.follow_up_lines(admissions, note_lines))
    dis = cut(notes.typed_notes(dis_lines, follow_up=False))
    fup = cut(notes.typed_notes(fup_lines, follow_up=True))
    clean = union_all(
        notes.normalise_notes(dis, stop_words, stems=stems).withColumn("follow_up", F.lit(0)),
        notes.normalise_notes(fup, stop_words, stems=stems).withColumn("follow_up", F.lit(1)))
    return NoteTables(fup_lines, dis, fup, cut(clean))


@dataclass
class ModelTables:
    train: DataFrame
    test: DataFrame
    vocabulary: list[str]


def prepare_model_tables(clean: DataFrame, min_tokens: int = 300, cut: Cut = materialise) -> ModelTables:
    """Stage 2: documents of both sides with their feature vectors."""
    arranged = cut(with_split(notes.arrange(clean, min_tokens=min_tokens), "PatientID"))
    train_notes = arranged.where("split = 'train'")
    words = features.frequent_terms(train_notes, word_tokens(F.col("Notes")))
    # rare words leave the training notes only
    train_docs = notes.assemble_documents(features.prune_rare_words(train_notes, "Notes", words))
    test_docs = notes.assemble_documents(arranged.where("split = 'test'"))
    train_docs = cut(attach(train_docs, arranged, DOCUMENT_KEYS, ["Date_mrs_post_discharge"]))
    test_docs = cut(attach(test_docs, arranged, DOCUMENT_KEYS, ["Date_mrs_post_discharge"]))
    vocabulary = features.fit_ngram_vocabulary(train_docs, "Notes")
    return ModelTables(vector_table(train_docs, train_docs, vocabulary, rerange=False),
                       vector_table(test_docs, train_docs, vocabulary, rerange=True), vocabulary)


def vector_table(docs: DataFrame, train: DataFrame, vocabulary: list[str], rerange: bool,
                 age: str = "Age", sex: str = "SexDSC") -> DataFrame:
    low, high = features.train_range(train, "Age")
    if rerange:
        own_low, own_high = features.train_range(docs, age)
        scaled = features.rerange(F.col(age), own_low, own_high, low, high)
    else:
        scaled = features.scale(F.col(age), low, high)
    ready = docs.withColumn("Age_scaled", scaled)
    if sex != "SexDSC":
        ready = ready.withColumn("SexDSC", F.col(sex))
    return features.vectorise(ready, "Notes", vocabulary, NUMERIC)


# --- fixed values: what the other site calls its columns ---
EXTERNAL_SITE = SiteAdapter(
    columns={"SexDSC": "gender", "HospitalAdmitDTS": "admission", "HospitalDischargeDTS": "discharge", "mrs": "mrs_discharge", "label": "mrs_discharge"},
    codes={"SexDSC": labels.EXTERNAL_SEX_CODES}, readers={"mrs": labels.normalise_label}, required=("mrs",))
EXTERNAL_KEYS = ["PatientID", "SexDSC", "Age", "HospitalAdmitDTS", "HospitalDischargeDTS", "Date_mrs_post_discharge", "mrs", "label"]


@dataclass
class ExternalTables:
    discharge_typed: DataFrame
    follow_up_typed: DataFrame
    docs: DataFrame
    rejects: DataFrame


def prepare_external(discharge_lines: DataFrame, follow_up_lines: DataFrame, stop_words: list[str], site: SiteAdapter = EXTERNAL_SITE,
                     keys: list[str] = EXTERNAL_KEYS, stem: bool = True, cut: Cut = materialise) -> ExternalTables:
    """Stage 6: the other site's lines, joined to its admissions already, under our names and codes; typed,
    normalised and put together per admission; with its label as a number, and deaths from its wording.

    Rejects are the lines with a code or label that no list and no reader knows.
    """
    typed, rejects, clean = [], [], []
    for follow_up, lines in enumerate((discharge_lines, follow_up_lines)):
        adapted = adapt(lines, site, ["PatientID", "NoteID"])
        rejects.append(adapted.rejects.distinct().withColumn("follow_up", F.lit(follow_up)))
        latest = cut(notes.typed_notes(cut(adapted.rows), follow_up=bool(follow_up), keys=keys))
        typed.append(latest)
        clean.append(notes.normalise_notes(latest, stop_words, keys=keys, stem=stem).withColumn("follow_up", F.lit(follow_up)))
    docs = notes.arrange_external(union_all(*clean), sex=None, outcome="label").drop("label")
    return ExternalTables(*typed, cut(docs), cut(union_all(*rejects)))


def external_vectors(docs: DataFrame, train_docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """The other site's documents in the columns of the training table; its ages stretched onto the training range."""
    return vector_table(docs, train_docs, vocabulary, rerange=True)


def linear_predictions(train: DataFrame, test: DataFrame, extractions: DataFrame | None, keys: list[str],
                       alpha: float = models.BEST_ALPHA):
    """Stages 4 and 7: lasso, clipped, with the expired rule and extracted scores on top."""
    model = models.lasso(alpha).fit(models.pack(train))
    scored = model.transform(test).withColumn("y_model", labels.clip(F.col("y_pred")))
    extracted = None
    if extractions is not None:
        scored = enrich(scored, extract.one_score_per_visit(extractions, keys), keys)
        extracted = F.col("mrs_extractions")
    return model, scored.withColumn(
        "y_pred", labels.override_prediction(F.col("y_model"), F.col("Expired"), extracted))


def binary_predictions(train: DataFrame, test: DataFrame, extractions: DataFrame | None, keys: list[str],
                       inverse_penalty: float, harden_expired: bool = False):
    """Stages 5 and 8: balanced L1 logistic regression, threshold with the best F1 in training, rules.

    Extracted scores harden labels and probabilities. At the other site (`harden_expired`)
    deaths do that instead; here they only set the label.
    """
    prepared = models.pack(models.prepare_classes(train.withColumn("y", labels.dichotomise(F.col("mrs")))))
    model = models.fit_logistic(prepared, inverse_penalty)
    fitted = models.probabilities(model.transform(prepared))
    threshold = curves.f1_threshold(fitted.select("y", "one"), [], "y", "one").first()["threshold"]
    target = models.with_penalised_intercept(test.withColumn("y", labels.dichotomise(F.col("mrs"))))
    scored = models.probabilities(model.transform(target))
    hard = models.tuned_label(F.col("one"), F.lit(threshold))
    expired = F.col("Expired") == 1
    decided = F.lit(None).cast("int")
    if extractions is not None:
        scored = enrich(scored, extract.one_score_per_visit(extractions, keys), keys)
        decided = labels.dichotomise(F.col("mrs_extractions"))
    y_hard = F.coalesce(decided, F.when(expired, 1).otherwise(hard))
    sure = F.when(expired, 1) if harden_expired else decided
    zero, one = labels.override_probabilities(F.col("zero"), F.col("one"), sure)
    return model, threshold, scored.withColumns({"y_hard": y_hard, "zero": zero, "one": one})


def linear_report(scored: DataFrame, row_key: str | list[str], replicates: int = bootstrap.REPLICATES) -> DataFrame:
    """One row: RMSE and rank correlation, each with its interval."""
    rmse_ci = bootstrap.bootstrap_rmse(scored, row_key, "mrs", "y_pred", replicates=replicates)
    rho_ci = bootstrap.bootstrap_spearman(scored, row_key, "mrs", "y_pred", replicates=replicates)
    points = scored.agg(metrics.rmse_of(F.col("mrs"), F.col("y_pred")).alias("rmse")).withColumns({
        "_rmse": rmse_ci.select(F.struct("lo", "hi")).scalar(),
        "spearman": metrics.spearman(scored, [], "mrs", "y_pred").scalar(),
        "_rho": rho_ci.select(F.struct("lo", "hi")).scalar()})
    return points.select("rmse", F.col("_rmse.lo").alias("rmse_lo"), F.col("_rmse.hi").alias("rmse_hi"),
                         "spearman", F.col("_rho.lo").alias("spearman_lo"), F.col("_rho.hi").alias("spearman_hi"))


def importance_report(model, vocabulary: list[str], spark) -> DataFrame:
    """Top terms with signed importance in percent."""
    table = models.coefficient_table(spark, [*vocabulary, *NUMERIC], model.coefficients)
    return report.importance(report.top_terms(table))
