"""Cleaning, date ranges and derived columns of sales and accounts."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..fixed_values import DEFAULT_PRODUCT, DEFAULT_PROVINCE
from ..functions import channel, day_after, is_approved, weekday_number


def clean_sales(sales: DataFrame, since: dt.date | None = None, until: dt.date | None = None) -> DataFrame:
    """Fill the product and turn the sale's timestamp into a day.

    Bounds are both inclusive. They filter the stored timestamp, not the day, so they reach the scan.
    """
    if since is not None:
        sales = sales.filter(F.col("sold_at") >= day_after(since - dt.timedelta(days=1)))
    if until is not None:
        sales = sales.filter(F.col("sold_at") < day_after(until))
    return sales.select(
        "client_id",
        F.to_date("sold_at").alias("sale_date"),
        F.coalesce("product", F.lit(DEFAULT_PRODUCT)).alias("product"),
        "status",
        F.nanvl(F.col("amount").cast("double"), F.lit(None).cast("double")).alias("amount"),  # NaN is no amount
    )


def clean_accounts(accounts: DataFrame) -> DataFrame:
    return accounts.select(
        "client_id",
        F.coalesce("province", F.lit(DEFAULT_PROVINCE)).alias("province"),
        "account_type",
        F.col("sector").cast("double").alias("sector"),
    )


def between_days(sales: DataFrame, first: dt.date, last: dt.date) -> DataFrame:
    """Both ends included."""
    return sales.filter(F.col("sale_date").between(F.lit(first), F.lit(last)))


def look_back(sales: DataFrame, cut: dt.date, days: int) -> DataFrame:
    """The `days` days that end with `cut`: open on the left, closed on the right."""
    return sales.filter((F.col("sale_date") > F.lit(cut - dt.timedelta(days=days))) & (F.col("sale_date") <= F.lit(cut)))


def derive_sales(sales: DataFrame) -> DataFrame:
    return sales.withColumns({
        "weekday": weekday_number(F.col("sale_date")),
        "channel": channel(F.col("product")),
        "approved": is_approved(F.col("status")),
    })


def active_clients(sales: DataFrame, cut: dt.date, days: int) -> DataFrame:
    return look_back(sales, cut, days).select("client_id").distinct()


def active_sales(sales: DataFrame, cut: dt.date, days: int) -> DataFrame:
    """All sales up to `cut` of the clients active at it.

    The feature table does not need this join: it reads activity off each client's last sale. Where the rows
    themselves are wanted, a hot client stays on the streamed side, which adaptive execution can split.
    """
    history = sales.filter(F.col("sale_date") <= F.lit(cut))
    return history.join(active_clients(sales, cut, days), "client_id", "left_semi")


def last_day(sales: DataFrame) -> dt.date:
    """The newest sale date: one value, used as a literal in later filters."""
    return sales.agg(F.max("sale_date")).first()[0]


def one_per_key(df: DataFrame, key: str = "client_id") -> DataFrame:
    """One row per key: the smallest in column order, NULL first.

    An aggregate, not a ranking window: copies collapse before the shuffle, however many a key has.
    """
    rest = [c for c in df.columns if c != key]
    first = df.groupBy(key).agg(F.min(F.struct(*rest)).alias("kept"))
    return first.select(*[F.col(c) if c == key else F.col("kept")[c].alias(c) for c in df.columns])


def category_levels(df: DataFrame, columns: list[str]) -> DataFrame:
    """Levels of each text column with their alphabetical index. Only the levels are sorted, not the rows."""
    pairs = df.select(
        F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("level")) for c in columns])).alias("p")
    ).select("p.*").filter("level is not null").distinct()
    order = Window.partitionBy("column").orderBy("level")
    return pairs.withColumn("level_index", (F.row_number().over(order) - 1).cast("long"))
