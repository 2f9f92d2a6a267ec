"""Inactivity definitions and their check against later behaviour."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..fixed_values import (
    DEFINITION_60D, DEFINITION_X2, DEFINITION_X3, HIT_ACTIVE, HIT_LEFT, MISS_BACK, MISS_LEFT,
)
from ..functions import lossless_percent

OUTCOMES = [HIT_LEFT, MISS_BACK, HIT_ACTIVE, MISS_LEFT]
FLAGS = {"left_x3": DEFINITION_X3, "left_x2": DEFINITION_X2, "left_60d": DEFINITION_60D}


def client_frequency(sales: DataFrame, start: dt.date, cut: dt.date) -> DataFrame:
    """Sales in [start, cut] per client, and whether the client sold again at any time after `cut`.

    The look-ahead rides on the same aggregate: one scan, one shuffle of a few numbers per client, no join.
    """
    day, inside = F.col("sale_date"), F.col("sale_date") <= F.lit(cut)
    per_client = (
        sales.filter(day >= F.lit(start))
        .groupBy("client_id")
        .agg(
            F.count_if(inside).alias("sales_count"),
            F.min(F.when(inside, day)).alias("first_sale"),
            F.max(F.when(inside, day)).alias("last_sale"),
            F.max(F.when(~inside, 1).otherwise(0)).alias("came_back"),
        )
        .filter("sales_count > 0")
    )
    span = F.datediff("last_sale", "first_sale")
    return per_client.select(
        "client_id", "sales_count", "first_sale", "last_sale",
        F.when(F.col("sales_count") > 1, span / (F.col("sales_count") - 1)).alias("mean_gap"),
        F.datediff(F.lit(cut), "last_sale").cast("long").alias("days_since_last"),
        F.col("came_back").cast("long").alias("came_back"),
    )


def churn_definitions(frequency: DataFrame, inactivity_days: int = 60) -> DataFrame:
    """Three flags: silent for over 3x or 2x the usual gap (unknown after one sale), or for over a fixed time."""
    silent = F.col("days_since_last")
    return frequency.withColumns({
        "left_x3": (silent > F.col("mean_gap") * 3).cast("long"),
        "left_x2": (silent > F.col("mean_gap") * 2).cast("long"),
        "left_60d": (silent > inactivity_days).cast("long"),
    })


def evaluate_definitions(flagged: DataFrame) -> DataFrame:
    """Outcome counts and shares of every definition at once; an unknown flag is an outcome of its own."""
    left, back = F.col("left"), F.col("came_back")
    pairs = F.explode(F.array(*[
        F.struct(F.lit(name).alias("definition"), F.col(flag).alias("left")) for flag, name in FLAGS.items()
    ]))
    outcome = (
        F.when((left == 1) & (back == 0), HIT_LEFT)
        .when((left == 1) & (back == 1), MISS_BACK)
        .when((left == 0) & (back == 1), HIT_ACTIVE)
        .when((left == 0) & (back == 0), MISS_LEFT)
    )
    counts = (
        flagged.select("came_back", pairs.alias("p"))
        .select("came_back", "p.*")
        .groupBy("definition", outcome.alias("outcome"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    whole = F.sum("n").over(Window.partitionBy("definition"))
    return counts.withColumn("pct", lossless_percent(F.col("n"), whole))


def compare_definitions(evaluated: DataFrame) -> DataFrame:
    """Outcomes as rows, count and share of each definition as columns."""
    short = F.element_at(F.create_map(*[F.lit(x) for f, d in FLAGS.items() for x in (d, f)]), F.col("definition"))
    wide = (
        evaluated.withColumn("short", short)
        .groupBy("outcome")
        .pivot("short", list(FLAGS))
        .agg(F.first("n").alias("n"), F.first("pct").alias("pct"))
    )
    return wide.fillna(0, [c for c in wide.columns if c != "outcome"])
