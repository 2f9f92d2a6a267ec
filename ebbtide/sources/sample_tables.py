"""The sample star schema seen as sales and accounts, in a sparse and a dense form."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..params import Study
from .readers import accounts_join, star_join, with_partner

# Sparse: orders of a customer, months apart.
SPARSE = Study(
    cut=dt.date(2001, 5, 1),
    definition_start=dt.date(1999, 8, 1),
    scoring_start=dt.date(2000, 1, 1),
)

# Dense: events of a user, several a day.
DENSE = Study(
    cut=dt.date(2024, 1, 20),
    definition_start=dt.date(2024, 1, 1),
    scoring_start=dt.date(2024, 1, 10),
    horizon=1,
    cohort_days=1,
    new_client_days=14,
    windows=(1, 3, 7, 14),
    inactivity_days=1,
)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def order_sales(spark: SparkSession, folder: str) -> DataFrame:
    priority = F.col("o_orderpriority")
    product = (
        F.when(priority == "1-URGENT", F.lit(None).cast("string"))
        .when(priority == "2-HIGH", "qr")
        .when(priority == "3-MEDIUM", "payment_link")
        .when(priority == "4-NOT SPECIFIED", "api_checkout")
        .otherwise("other_device")
    )
    return table(spark, folder, "orders").select(
        F.col("o_custkey").alias("client_id"),
        F.col("o_orderdate").alias("sold_at"),
        product.alias("product"),
        F.when(F.col("o_orderstatus") == "P", "REJECTED").otherwise("APPROVED").alias("status"),
        F.col("o_totalprice").alias("amount"),
    )


def event_sales(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.col("event_type")
    product = (
        F.when(kind == "click", "mpos")
        .when(kind == "view", F.lit(None).cast("string"))
        .when(kind == "signup", "payment_link")
        .when(kind == "purchase", "qr")
        .otherwise("other_device")
    )
    return table(spark, folder, "events").select(
        F.col("user_id").alias("client_id"),
        F.col("ts").alias("sold_at"),
        product.alias("product"),
        F.when(kind == "error", "REJECTED").otherwise("APPROVED").alias("status"),
        F.col("value").alias("amount"),
    )


def customer_accounts(spark: SparkSession, folder: str) -> DataFrame:
    customer, nation = table(spark, folder, "customer"), table(spark, folder, "nation")
    return customer.join(nation, customer.c_nationkey == nation.n_nationkey, "left").select(
        F.col("c_custkey").alias("client_id"),
        F.when(F.col("n_nationkey") != 0, F.col("n_name")).alias("province"),
        F.col("c_mktsegment").alias("account_type"),
        F.col("n_regionkey").alias("sector"),
    )


def star_sales(spark: SparkSession, folder: str) -> DataFrame:
    """Sales read through the star join: line items with their order, part, supplier and customer."""
    lines, orders = table(spark, folder, "lineitem"), table(spark, folder, "orders")
    part, supplier = table(spark, folder, "part"), table(spark, folder, "supplier")
    customer = table(spark, folder, "customer")
    return star_join(
        lines,
        [
            (orders, {"l_orderkey": "o_orderkey"}),
            (part, {"l_partkey": "p_partkey"}),
            (supplier, {"l_suppkey": "s_suppkey"}),
            (customer, {"o_custkey": "c_custkey"}),
        ],
        {
            "client_id": F.col("o_custkey"),
            "sold_at": F.col("o_orderdate"),
            "product": F.col("p_type"),
            "status": F.col("o_orderstatus"),
            "amount": F.col("l_extendedprice"),
        },
        fact_filter=F.col("l_returnflag") != "R",
        dimension_filter=F.col("o_orderstatus") != "P",
    )


def star_accounts(spark: SparkSession, folder: str) -> DataFrame:
    """Accounts read through composite-key joins, one row per distinct combination.

    The keys are made distinct before the joins, so a client with many orders costs one row.
    """
    orders = with_partner(table(spark, folder, "orders").select("o_custkey").distinct(), "o")
    customer = with_partner(table(spark, folder, "customer"), "c")
    nation = with_partner(table(spark, folder, "nation"), "n")
    return accounts_join(
        orders,
        [
            (customer, {"o_custkey": "c_custkey", "o_partner": "c_partner"}),
            (nation, {"c_nationkey": "n_nationkey", "c_partner": "n_partner"}),
        ],
        {
            "client_id": F.col("o_custkey"),
            "province": F.col("n_name"),
            "account_type": F.col("c_mktsegment"),
            "sector": F.col("n_regionkey"),
        },
        account_filter=F.col("o_partner") == 18,
    )
