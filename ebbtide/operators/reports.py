"""Descriptive reports: class shares, long form, histograms, summaries, correlations, impurity."""

from __future__ import annotations

import math

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from .ordering import exact_quantiles

SUMMARY_PROBABILITIES = {0.25: "q1", 0.5: "median", 0.75: "q3"}


def class_balance(df: DataFrame, label: str, part: str | None = None) -> DataFrame:
    """Rows and share of each class, within each part if given."""
    keys = [part, label] if part else [label]
    whole = Window.partitionBy(part) if part else Window.partitionBy()  # a handful of rows
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(whole))


def features_long(df: DataFrame, columns: list[str], key: str = "client_id") -> DataFrame:
    """Numeric columns to (name, value) rows."""
    casted = df.select(key, *[F.col(c).cast("double").alias(c) for c in columns])
    return casted.unpivot(key, columns, "name", "value")


def feature_histogram(df: DataFrame, columns: list[str], bins: int = 30) -> DataFrame:
    """Equal-width bins from min to max of each column; the top edge belongs to the last bin."""
    limits = df.agg(*[f(F.col(c).cast("double")).alias(f"{n}__{c}") for c in columns for n, f in
                      (("low", F.min), ("high", F.max))]).first()  # two numbers per column
    binned = []
    for c in columns:
        low, high = limits[f"low__{c}"], limits[f"high__{c}"]
        if low is None:
            continue
        value = F.col(c).cast("double")
        slot = F.lit(0) if high == low else F.least(F.floor((value - low) / ((high - low) / bins)), F.lit(bins - 1))
        binned.append(F.struct(F.lit(c).alias("name"), F.when(value.isNotNull(), slot + 1).cast("long").alias("bin")))
    return (
        df.select(F.explode(F.array(*binned)).alias("p"))
        .select("p.*")
        .filter("bin is not null")
        .groupBy("name", "bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def table_summary(df: DataFrame, columns: list[str], reuse: bool = True) -> DataFrame:
    """Rows, missing values, minimum, quartiles, median, mean and maximum of each numeric column.

    The input is read several times, so it is written once unless the caller has done so.
    """
    values = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    values = materialise(values, "summary") if reuse else values
    aggregates, rows = [], []
    for i, c in enumerate(columns):
        parts = {
            "present": F.count(c), "missing": F.count_if(F.col(c).isNull()), "minimum": F.min(c), "mean": F.avg(c),
            "maximum": F.max(c),
        }
        aggregates += [part.alias(f"{name}_{i}") for name, part in parts.items()]
        rows.append(F.struct(F.lit(c).alias("column"), *[F.col(f"{name}_{i}").alias(name) for name in parts]))
    moments = values.agg(*aggregates).select(F.explode(F.array(*rows)).alias("p")).select("p.*")
    names = F.create_map(*[F.lit(x) for p, n in SUMMARY_PROBABILITIES.items() for x in (p, n)])
    quantiles = (
        exact_quantiles(values, columns, list(SUMMARY_PROBABILITIES))
        .withColumn("place", F.element_at(names, F.col("probability")))
        .groupBy("column")
        .pivot("place", list(SUMMARY_PROBABILITIES.values()))
        .agg(F.first("value"))
    )
    return moments.join(quantiles, "column", "left")


def text_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows, missing values, distinct values and the most frequent value (the first of equals) of each text column.

    Values are counted once for all columns, so what is shuffled is one row for each value of a task.
    """
    pairs = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]))
    counts = df.select(pairs.alias("p")).select("p.*").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    known = F.col("value").isNotNull()
    best = F.min(F.when(known, F.struct((-F.col("n")).alias("less"), F.col("value").alias("value")))).alias("best")
    found = counts.groupBy("column").agg(
        F.coalesce(F.sum(F.when(known, F.col("n"))), F.lit(0)).alias("present"),
        F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0)).alias("missing"),
        F.count_if(known).alias("levels"), best)
    return found.select("column", "present", "missing", "levels", F.col("best.value").alias("top"),
                        (-F.col("best.less")).alias("top_rows"))


def correlation_matrix(df: DataFrame, columns: list[str]) -> list[list[float]]:
    """Pearson correlation over complete rows: a distributed pass, a columns x columns result."""
    casted = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    vectors = VectorAssembler(inputCols=columns, outputCol="v", handleInvalid="skip").transform(casted)
    return Correlation.corr(vectors.select("v"), "v").first()[0].toArray().tolist()


def correlation_table(df: DataFrame, columns: list[str]) -> DataFrame:
    """The matrix as rows (column_1, column_2, correlation), each pair once; NULL for a constant column."""
    matrix = correlation_matrix(df, columns)
    rows = [
        (a, b, None if math.isnan(matrix[i][j]) else float(matrix[i][j]))
        for i, a in enumerate(columns) for j, b in enumerate(columns) if i < j
    ]
    return df.sparkSession.createDataFrame(rows, "column_1 string, column_2 string, correlation double")


def correlated_pairs(table: DataFrame, limit: float = 0.9) -> DataFrame:
    return table.filter(F.abs("correlation") > limit)


def impurity_by_group(df: DataFrame, group: str, label: str) -> DataFrame:
    """Gini, entropy and scaled entropy of the class distribution of each group, and how far apart they are."""
    counts = df.groupBy(group, label).agg(F.count(F.lit(1)).alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy(group))
    classes = F.size(F.collect_set(label).over(Window.partitionBy()))  # groups x classes rows, not data rows
    shares = counts.select(group, "n", share.alias("p"), classes.alias("classes"))
    top = F.log2(F.max("classes").cast("double"))
    gini = F.sum(F.col("p") * (1 - F.col("p")))
    entropy = -F.sum(F.col("p") * F.log2("p"))
    scaled = F.coalesce(F.try_divide(entropy, top), F.lit(0.0)) * 0.5
    measures = shares.groupBy(group).agg(
        F.sum("n").alias("n"), gini.alias("gini"), entropy.alias("entropy"), scaled.alias("entropy_scaled")
    )
    return measures.withColumn("difference", F.abs(F.col("gini") - F.col("entropy_scaled")))
