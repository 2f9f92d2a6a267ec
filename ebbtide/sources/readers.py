"""Table scans and the two star joins that feed them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SALES_COLUMNS = ["client_id", "sold_at", "product", "status", "amount"]
ACCOUNT_COLUMNS = ["client_id", "province", "account_type", "sector"]


def read_sales(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select(*SALES_COLUMNS)


def read_accounts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select(*ACCOUNT_COLUMNS)


def star_join(
    fact: DataFrame,
    dimensions: list[tuple[DataFrame, dict[str, str]]],
    columns: dict[str, Column],
    fact_filter: Column | None = None,
    dimension_filter: Column | None = None,
) -> DataFrame:
    """Fact LEFT JOIN each dimension on {left column: dimension column}, filtered and renamed.

    The fact filter runs before any join. Whether a dimension is broadcast is left to its measured size.
    """
    joined = fact if fact_filter is None else fact.filter(fact_filter)
    for dimension, keys in dimensions:
        on = [joined[left] == dimension[right] for left, right in keys.items()]
        joined = joined.join(dimension, on, "left")
    if dimension_filter is not None:
        joined = joined.filter(dimension_filter)
    return joined.select(*[column.alias(name) for name, column in columns.items()])


def accounts_join(
    accounts: DataFrame,
    dimensions: list[tuple[DataFrame, dict[str, str]]],
    columns: dict[str, Column],
    account_filter: Column | None = None,
) -> DataFrame:
    """The account dimension: the same joins over composite keys, one row per distinct combination."""
    return star_join(accounts, dimensions, columns, fact_filter=account_filter).distinct()


def with_partner(df: DataFrame, prefix: str, partner: int = 18) -> DataFrame:
    """Add the constant partner column of a single-partner table."""
    return df.withColumn(f"{prefix}_partner", F.lit(partner))
