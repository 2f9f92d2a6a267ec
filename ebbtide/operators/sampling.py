"""Reproducible split, folds and class balance. All choices depend on a hash of the client, not on row order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import hash_rank, with_first_by_hash


def stratified_split(
    df: DataFrame, seed: int, train_percent: int = 70, label: str = "churned", key: str = "client_id"
) -> DataFrame:
    """Mark ceil(percent of n) rows of each class as `in_train`."""

    def wanted(offsets: DataFrame) -> Column:
        return F.ceil(F.col("stratum_rows") * train_percent / 100.0)

    return with_first_by_hash(df, label, key, seed, "", wanted, "in_train")


def stratified_folds(
    df: DataFrame, seed: int, folds: int = 5, label: str = "churned", key: str = "client_id"
) -> DataFrame:
    """Deal the rows of each class over the folds in hash order: fold sizes differ by one at most."""
    ranked = hash_rank(df, label, key, seed, ":fold", "fold_rank")
    return ranked.withColumn("fold", ((F.col("fold_rank") - 1) % folds).cast("int")).drop("fold_rank")


def with_copies(df: DataFrame, seed: int, label: str = "churned", key: str = "client_id") -> DataFrame:
    """Add `copies`: 1 for the larger class, enough for the smaller one to reach its size.

    The remainder goes to the smaller class's first rows in hash order, so both classes end up equal.
    """

    def classes(offsets: DataFrame) -> tuple[Column, Column]:
        whole = Window.partitionBy()  # bucket counts, not rows
        largest = F.max("stratum_rows").over(whole)
        return largest, F.col("stratum_rows")

    def remainder(offsets: DataFrame) -> Column:
        largest, own = classes(offsets)
        return largest % own

    marked = with_first_by_hash(df, label, key, seed, ":copy", remainder, "one_more")
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("own"))
    base = counts.select(label, F.floor(F.max("own").over(Window.partitionBy()) / F.col("own")).alias("base"))
    joined = marked.join(F.broadcast(base), label)  # one row per class
    return joined.select(*df.columns, (F.col("base") + F.col("one_more").cast("long")).alias("copies"))


def oversample(df: DataFrame, seed: int, label: str = "churned", key: str = "client_id") -> DataFrame:
    """Repeat rows of the smaller class until both classes are equal; `copy` numbers the repeats."""
    copied = with_copies(df, seed, label, key)
    numbers = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))
    return copied.select(*df.columns, numbers.alias("copy"))


def balance_weights(df: DataFrame, label: str = "churned", name: str = "weight") -> DataFrame:
    """The same balance without more rows: each class weighs as much as the largest."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("own"))
    weights = counts.select(label, (F.max("own").over(Window.partitionBy()) / F.col("own")).alias(name))
    return df.join(F.broadcast(weights), label).select(*df.columns, name)  # one row per class
