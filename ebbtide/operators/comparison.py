"""Side-by-side reports of trained models: metrics, leaderboard, importances, best model, summary."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixed_values import COEFFICIENT_DISPLAY_FACTOR
from .evaluation import classifier_metrics

METRICS = [
    "accuracy", "error_rate", "kappa", "sensitivity", "specificity", "ppv", "f1_no", "f1_yes", "balanced_accuracy",
]
LEADER_COLUMNS = ["auc", "accuracy", "sensitivity", "specificity"]


def model_metrics(configurations: list[tuple[str, DataFrame, float, float]]) -> DataFrame:
    """One row per (name, scored test rows, threshold, AUC); an AUC that is not defined is NULL."""
    rows = [
        classifier_metrics(scored, threshold).select(
            F.lit(i).alias("place"), F.lit(name).alias("model"), "tp", "fp", "fn", "tn", *METRICS,
            F.lit(area).cast("double").alias("auc"), F.lit(float(threshold)).alias("threshold"),
        )
        for i, (name, scored, threshold, area) in enumerate(configurations)
    ]
    return reduce(DataFrame.unionByName, rows)


def leaderboard(metrics: DataFrame) -> DataFrame:
    return metrics.select("place", "model", *LEADER_COLUMNS).orderBy(F.desc("auc"), "place").drop("place")


def metrics_long(metrics: DataFrame) -> DataFrame:
    return metrics.select("model", *LEADER_COLUMNS).unpivot("model", LEADER_COLUMNS, "metric", "value")


def best_model(metrics: DataFrame) -> DataFrame:
    """The first row with the largest AUC, and the advice that follows from it."""
    best = metrics.orderBy(F.desc("auc"), "place").limit(1)
    return best.select(
        "model", *LEADER_COLUMNS, F.concat(F.lit("Usar "), "model", F.lit(" para producción")).alias("recommendation")
    )


def executive_summary(metrics: DataFrame, files: list[str]) -> DataFrame:
    models = metrics.agg(F.count(F.lit(1)).alias("n"))
    return best_model(metrics).select(
        F.current_date().alias("analysed_on"),
        *[F.col(c).alias(f"best_{c}") for c in ["model", *LEADER_COLUMNS]],
        models.scalar().alias("models_evaluated"),
        "recommendation",
        F.array(*[F.lit(f) for f in files]).alias("files"),
    )


def importance_table(
    spark: SparkSession, family: str, pairs: list[tuple[str, float]], top: int = 10
) -> DataFrame:
    rows = [(family, v, float(x)) for v, x in pairs[:top]]
    return spark.createDataFrame(rows, "family string, variable string, importance double")


def coefficient_importance(wald: DataFrame, family: str, top: int = 10) -> DataFrame:
    """The most significant terms, by size times a display factor."""
    terms = wald.filter(F.col("variable") != "(Intercept)").orderBy("p", "variable").limit(top)
    return terms.select(
        F.lit(family).alias("family"), "variable",
        (F.abs("coefficient") * COEFFICIENT_DISPLAY_FACTOR).alias("importance"),
    )
