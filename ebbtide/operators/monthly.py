"""Monthly activity of approved sales: per client and month, per client, overall."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixed_values import APPROVED
from ..functions import sum_or_zero


def client_month(sales: DataFrame, since: dt.date | None = None) -> DataFrame:
    approved = sales.filter(F.col("status") == APPROVED)
    if since is not None:
        approved = approved.filter(F.col("sale_date") >= F.lit(since))
    month = F.trunc("sale_date", "month")
    return approved.groupBy("client_id", month.alias("month")).agg(
        F.count(F.lit(1)).alias("month_sales"), sum_or_zero(F.col("amount")).alias("month_volume")
    )


def monthly_client(months: DataFrame) -> DataFrame:
    """Per client over its active months. A busy client arrives as one row per month."""
    return months.groupBy("client_id").agg(
        F.count(F.lit(1)).alias("active_months"),
        F.sum("month_sales").alias("total_sales"),
        F.sum("month_volume").alias("total_volume"),
        F.avg("month_sales").alias("mean_month_sales"),
        F.avg("month_volume").alias("mean_month_volume"),
    )


def monthly_global(clients: DataFrame) -> DataFrame:
    return clients.agg(
        F.avg("mean_month_sales").alias("mean_sales"), F.avg("mean_month_volume").alias("mean_volume")
    )
