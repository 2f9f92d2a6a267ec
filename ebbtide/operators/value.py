"""Business value of scored clients: monthly activity beside the score, and discounted expected loss."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..params import ValueParams

KPIS = ["mean_month_sales", "mean_month_volume"]


def score_kpis(scored: DataFrame, monthly: DataFrame) -> DataFrame:
    """Score with mean monthly sales and volume, 0 for clients without an approved sale. One row per client each."""
    return (
        scored.join(monthly.select("client_id", *KPIS), "client_id", "left")
        .fillna(0.0, KPIS)
        .select("client_id", "churn", "probability", *KPIS)
    )


def expected_loss(scored: DataFrame, value: ValueParams) -> DataFrame:
    loss = F.col("probability") * F.col("mean_month_volume") * F.lit(value.factor)
    return scored.withColumn("expected_loss", loss)


def expected_loss_total(losses: DataFrame) -> DataFrame:
    return losses.agg(F.coalesce(F.sum("expected_loss"), F.lit(0.0)).alias("total_expected_loss"))


def score_summary(scored: DataFrame) -> DataFrame:
    """Clients, predicted to leave, and their percentage."""
    leaving = F.count_if(F.col("churn") == 1)
    return scored.agg(
        F.count(F.lit(1)).alias("clients"),
        leaving.alias("predicted_to_leave"),
        F.round(F.try_divide(leaving * F.lit(100.0), F.count(F.lit(1))), 2).alias("percent"),
    )
