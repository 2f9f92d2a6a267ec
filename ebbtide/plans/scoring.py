"""Scoring: today's cohort, its probabilities, its monthly activity, and the loss to expect."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import forests, monthly, reports, trees, value
from ..operators.cleaning import clean_sales
from ..operators.encoding import fit_levels
from ..params import Settings, Study
from ..sources.sinks import load_bundle, write_scored
from . import training
from .features import scoring_features


def score_with_tree(features: DataFrame, pruned: list[trees.PrunedNode]) -> DataFrame:
    """Class and probability per client from the pruned tree: a projection, without the fitted model."""
    scored = trees.predict_tree(features, pruned, "client_id")
    return scored.select("client_id", F.col("predicted").alias("churn"), "probability")


def bundle_medians(spark: SparkSession, bundle: str) -> dict[str, float]:
    return {r["column"]: r["value"] for r in spark.read.parquet(f"{bundle}/medians").collect()}  # one per predictor


def score_with_bundle(spark: SparkSession, features: DataFrame, bundle: str) -> DataFrame:
    """`client_id`, `churn` (by the threshold of the bundle) and `probability` from any saved model."""
    description = spark.read.parquet(f"{bundle}/description").first()
    if description["kind"] == "tree":
        return score_with_tree(features, trees.pruned_from_rows(spark.read.parquet(f"{bundle}/nodes").collect()))
    model, _ = load_bundle(spark, bundle)
    if description["kind"] == "forest":
        limit = description["extras"]["max_leaves"]
        prepared = PipelineModel(model.stages[:-1]).transform(features)
        scored = forests.with_probability(
            model.stages[-1], prepared, "client_id", max_leaves=int(limit) if limit else None)
    else:
        levels = fit_levels(spark.read.parquet(f"{bundle}/levels"))
        scored = model.transform(training.linear_table(features, levels)).select(
            "client_id", F.col("prediction").alias("probability"))
    churn = (F.col("probability") > F.lit(description["metrics"]["threshold"])).cast("int")
    return scored.select("client_id", churn.alias("churn"), "probability")


def recent_monthly(raw_sales: DataFrame, since: dt.date) -> DataFrame:
    return monthly.monthly_client(monthly.client_month(clean_sales(raw_sales, since=since), since))


def score_clients(
    raw_sales: DataFrame,
    raw_accounts: DataFrame,
    study: Study,
    score: Callable[[DataFrame], DataFrame],
    medians: dict[str, float] | None,
) -> DataFrame:
    """The result table; `score` turns features into `client_id`, `churn`, `probability`.

    Pass the training medians; without them they are refitted on today's cohort.
    """
    features, _ = scoring_features(raw_sales, raw_accounts, study, medians)
    return value.score_kpis(score(features), recent_monthly(raw_sales, study.scoring_start))


def score_and_value(
    spark: SparkSession,
    raw_sales: DataFrame,
    raw_accounts: DataFrame,
    settings: Settings,
    bundle: str,
    target: str,
    refit_medians: bool = False,
) -> dict[str, DataFrame]:
    """Score with a saved bundle (of any of the models), write the clients with their expected loss, and report on the written table.

    Missing values get the training medians of the bundle; `refit_medians` takes those of today's cohort.
    """
    medians = None if refit_medians else bundle_medians(spark, bundle)
    clients = score_clients(
        raw_sales, raw_accounts, settings.study, lambda features: score_with_bundle(spark, features, bundle), medians)
    write_scored(value.expected_loss(clients, settings.value), target)
    written = spark.read.parquet(target)
    return {
        "clients": written,
        "summary": value.score_summary(written),
        "distribution": reports.table_summary(written, ["probability", *value.KPIS], reuse=False),
        "total": value.expected_loss_total(written),
    }
