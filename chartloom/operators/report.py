"""Report tables: importances, distribution summaries, metrics by how recent the notes are."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from chartloom.operators import bootstrap, metrics
from chartloom.operators.ordered import quantiles

TOP_TERMS = 20
# --- fixed values: bands of days between the latest note and the outcome: (name, above, up to) --
BANDS = [("0", -1, 0), ("(0,7]", 0, 7), ("(7,35]", 7, 35), (">35", 35, None), (">7", 7, None)]
EXTERNAL_BANDS = [("0", -1, 0), (">0", 0, None)]


def top_terms(coefficients: DataFrame, n: int = TOP_TERMS) -> DataFrame:
    """Largest non-zero coefficients by absolute value; the term breaks ties."""
    return (coefficients.where("coef <> 0")
            .orderBy(F.abs("coef").desc(), F.col("term").asc()).limit(n))


def importance(top: DataFrame) -> DataFrame:
    """Signed importance in percent of the largest. At most TOP_TERMS rows."""
    largest = F.max(F.abs("coef")).over(Window.partitionBy(F.lit(0)))
    return top.select("term", "coef", (F.col("coef") * 100 / largest).alias("importance"),
                      F.when(F.col("coef") < 0, "negative").otherwise("positive").alias("sign"))


def length_counts(terms: DataFrame, term: str = "term") -> DataFrame:
    """How many terms have one, two or three words."""
    return terms.groupBy(F.size(F.split(term, " ")).alias("n")).agg(F.count(F.lit(1)).alias("terms"))


def box_stats(df: DataFrame, by: str, value: str) -> DataFrame:
    """The five numbers behind a box plot, per class."""
    return quantiles(df, [by], value, {"minimum": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "maximum": 1.0})


def with_bands(df: DataFrame, days: str, bands=BANDS) -> DataFrame:
    """One row per band a row belongs to; bands may overlap. Rows without days are dropped."""
    d = F.col(days)
    hits = [F.when((d > above) & (F.lit(True) if upto is None else d <= upto), F.lit(name))
            for name, above, upto in bands]
    return df.withColumn("band", F.explode(F.array_compact(F.array(*hits))))


def regression_by_band(df: DataFrame, row_key: str, truth: str, prediction: str, days: str, bands=BANDS,
                       replicates: int = bootstrap.REPLICATES) -> DataFrame:
    """Rows, RMSE and rank correlation with intervals per band."""
    banded = with_bands(df, days, bands)
    points = banded.groupBy("band").agg(F.count(F.lit(1)).alias("rows"),
                                        metrics.rmse_of(F.col(truth), F.col(prediction)).alias("rmse"))
    rho = metrics.spearman(banded, ["band"], truth, prediction)
    ci_rmse = bootstrap.bootstrap_rmse(banded, row_key, truth, prediction, ["band"], replicates)
    ci_rho = bootstrap.bootstrap_spearman(banded, row_key, truth, prediction, ["band"], replicates)
    return (points.join(rho, "band", "left")
            .join(ci_rmse.select("band", F.col("lo").alias("rmse_lo"), F.col("hi").alias("rmse_hi")), "band", "left")
            .join(ci_rho.select("band", F.col("lo").alias("spearman_lo"), F.col("hi").alias("spearman_hi")),
                  "band", "left"))


def binary_by_band(df: DataFrame, row_key: str, days: str, bands=BANDS,
                   replicates: int = bootstrap.REPLICATES) -> DataFrame:
    """The full binary report per band."""
    return bootstrap.perf(with_bands(df, days, bands), row_key, ["band"], replicates)


def attach_recency(predictions: DataFrame, discharge_typed: DataFrame, follow_up_typed: DataFrame,
                   discharge_keys: list[str], follow_up_keys: list[str], day_columns: list[str],
                   keep: list[str]) -> DataFrame:
    """Predictions with the day counts of their cohort, and the fewest days over all note types."""
    dis = predictions.where("follow_up = 0").join(
        discharge_typed.select(*discharge_keys, *day_columns).distinct(), discharge_keys)
    fup = predictions.where("follow_up = 1").join(
        follow_up_typed.select(*follow_up_keys, *day_columns).distinct(), follow_up_keys)
    columns = [*keep, *day_columns]
    both = dis.select(*columns).unionByName(fup.select(*columns))
    return both.withColumn("nmin", F.least(*day_columns) if len(day_columns) > 1 else F.col(day_columns[0]))
