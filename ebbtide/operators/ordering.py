"""Exact order statistics without a global sort in one task.

Rows are put into buckets that follow the order (cut points of the values, or leading bits of a hash), the buckets
are counted, and only then is anything sorted, inside a bucket. What is broadcast is one row per bucket.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import hash_key
from ..functions.columns import HASH_BITS

HASH_BUCKET_BITS = 12
MAX_BUCKETS = 1024


def bucket_count(df: DataFrame) -> int:
    return min(MAX_BUCKETS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def with_buckets(df: DataFrame, columns: list[str], buckets: int) -> DataFrame:
    """Add `<column>__bucket`, a non-decreasing function of the column. Any cut points give right results."""
    grid = [i / buckets for i in range(1, buckets)] or [0.5]
    edges = df.approxQuantile(columns, grid, 1 / (4 * buckets))
    splits = [[float("-inf"), *sorted(set(e or [0.0])), float("inf")] for e in edges]
    return Bucketizer(
        splitsArray=splits, inputCols=columns, outputCols=[f"{c}__bucket" for c in columns], handleInvalid="keep"
    ).transform(df)


def running_totals(
    df: DataFrame, key: str, sums: list[str], descending: bool = True, buckets: int | None = None
) -> DataFrame:
    """Add running and whole sums in key order, and the key that follows; `df` has one row per key."""
    bucketed = with_buckets(df, [key], buckets or bucket_count(df)).withColumnRenamed(f"{key}__bucket", "bucket")
    order = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    edge = F.max(key) if descending else F.min(key)
    per_bucket = bucketed.groupBy("bucket").agg(edge.alias("edge"), *[F.sum(s).alias(s) for s in sums])
    along = Window.orderBy(order("bucket"))  # one row per bucket
    offsets = per_bucket.select(
        "bucket",
        F.lead("edge").over(along).alias("next_edge"),
        *[F.coalesce(F.sum(s).over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(f"before_{s}")
          for s in sums],
        *[F.sum(s).over(Window.partitionBy()).alias(f"total_{s}") for s in sums],
    )
    inside = Window.partitionBy("bucket").orderBy(order(key))
    joined = bucketed.join(F.broadcast(offsets), "bucket")
    return joined.select(
        *df.columns,
        *[(F.col(f"before_{s}") + F.sum(s).over(inside)).alias(f"running_{s}") for s in sums],
        *[f"total_{s}" for s in sums],
        F.coalesce(F.lead(key).over(inside), F.col("next_edge")).alias(f"next_{key}"),
    )


def exact_quantiles(
    df: DataFrame, columns: list[str], probabilities: list[float], buckets: int = 256
) -> DataFrame:
    """Interpolated quantiles of each column: rows (column, probability, value). Reads `df` three times.

    A sketch gives a value below and one above each wanted place. One aggregate then counts, for all columns at once,
    how many values lie before and inside each of these brackets. Only values inside a bracket, about 1 / `buckets` of a
    column, leave their row to be ordered. A bracket that misses its place is opened to the whole column.
    """
    values = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    half = 1 / (2 * buckets)
    edges = sorted({q for p in probabilities for q in (p - half, p + half) if 0 < q < 1})
    sketched = values.approxQuantile(columns, edges, half / 2) if edges else [[] for _ in columns]
    at = [dict(zip(edges, found)) for found in sketched]
    brackets = [(i, p, at[i].get(p - half), at[i].get(p + half)) for i in range(len(columns)) for p in probabilities]

    def inside(column: str, low: float | None, high: float | None) -> Column:
        within = F.col(column).isNotNull()
        within = within if low is None else within & (F.col(column) >= low)
        return within if high is None else within & (F.col(column) <= high)

    counted = values.agg(
        *[F.count(c).alias(f"rows_{i}") for i, c in enumerate(columns)],
        *[F.count_if(F.lit(False) if low is None else F.col(columns[i]) < low).alias(f"before_{k}")
          for k, (i, _, low, _) in enumerate(brackets)],
        *[F.count_if(inside(columns[i], low, high)).alias(f"inside_{k}")
          for k, (i, _, low, high) in enumerate(brackets)],
    ).first()
    wanted, members = [], []
    for k, (i, p, low, high) in enumerate(brackets):
        if not counted[f"rows_{i}"]:
            continue
        place, before = p * (counted[f"rows_{i}"] - 1), counted[f"before_{k}"]
        lower, upper = math.floor(place), math.ceil(place)
        if not (before <= lower and upper < before + counted[f"inside_{k}"]):
            low, high, before = None, None, 0
        wanted += [(k, columns[i], float(p), place - lower, rank - before) for rank in {lower, upper}]
        members.append(F.when(inside(columns[i], low, high), F.struct(
            F.lit(k).alias("bracket"), F.col(columns[i]).alias("value"))))
    places = df.sparkSession.createDataFrame(
        wanted, "bracket int, column string, probability double, fraction double, inner_rank long")
    if not members:
        return places.select("column", "probability", F.lit(None).cast("double").alias("value"))
    ordered = Window.partitionBy("bracket").orderBy("value")
    upto = (
        values.select(F.explode(F.array_compact(F.array(*members))).alias("m")).select("m.*")
        .groupBy("bracket", "value").agg(F.count(F.lit(1)).alias("n"))
        .withColumn("upto", F.sum("n").over(ordered))
    )
    found = upto.join(F.broadcast(places), "bracket").filter("inner_rank < upto and inner_rank >= upto - n")
    return found.groupBy("column", "probability").agg(
        (F.min("value") + F.max("fraction") * (F.max("value") - F.min("value"))).alias("value")
    )


def _hashed(df: DataFrame, key: str, seed: int, salt: str) -> DataFrame:
    return df.withColumn("hash", hash_key(F.col(key), seed, salt)).withColumn(
        "bucket", F.shiftright("hash", HASH_BITS - HASH_BUCKET_BITS)
    )


def _bucket_offsets(keyed: DataFrame, stratum: str) -> DataFrame:
    """Rows before each hash bucket of each stratum: strata x 4096 rows at most."""
    counts = keyed.groupBy(stratum, "bucket").agg(F.count(F.lit(1)).alias("bucket_rows"))
    along = Window.partitionBy(stratum).orderBy("bucket")
    return counts.select(
        stratum, "bucket", "bucket_rows",
        (F.sum("bucket_rows").over(along) - F.col("bucket_rows")).alias("before"),
        F.sum("bucket_rows").over(Window.partitionBy(stratum)).alias("stratum_rows"),
    )


def hash_rank(df: DataFrame, stratum: str, key: str, seed: int, salt: str = "", name: str = "rank") -> DataFrame:
    """Add each row's exact place (from 1) in hash order within its stratum. Strata are classes: a few values."""
    keyed = _hashed(df, key, seed, salt)
    offsets = _bucket_offsets(keyed, stratum).select(stratum, "bucket", "before")
    inside = Window.partitionBy(stratum, "bucket").orderBy("hash", key)
    ranked = keyed.join(F.broadcast(offsets), [stratum, "bucket"])
    return ranked.select(*df.columns, (F.col("before") + F.row_number().over(inside)).alias(name))


def with_first_by_hash(
    df: DataFrame, stratum: str, key: str, seed: int, salt: str, wanted: Callable[[DataFrame], Column], name: str
) -> DataFrame:
    """Mark the first k rows of each stratum in hash order, with k from the stratum's counts.

    `wanted` gets (stratum, stratum_rows) counts and returns k per row. Only rows of the bucket that holds place k
    are sorted; the rest are compared with one cut-off per stratum, so wide rows are not shuffled.
    """
    keyed = _hashed(df, key, seed, salt)
    narrow = keyed.select(stratum, key, "hash", "bucket")
    offsets = _bucket_offsets(narrow, stratum)
    target = offsets.withColumn("k", wanted(offsets)).filter("k > before and k <= before + bucket_rows")
    inside = Window.partitionBy(stratum, "bucket").orderBy("hash", key)
    cut = (
        narrow.join(F.broadcast(target.select(stratum, "bucket", "before", "k")), [stratum, "bucket"])
        .withColumn("place", F.col("before") + F.row_number().over(inside))
        .filter("place = k")
        .select(stratum, F.col("hash").alias("cut_hash"), F.col(key).alias("cut_key"))
    )
    marked = keyed.join(F.broadcast(cut), stratum, "left")
    first = (F.col("hash") < F.col("cut_hash")) | (
        (F.col("hash") == F.col("cut_hash")) & (F.col(key) <= F.col("cut_key"))
    )
    return marked.select(*df.columns, F.coalesce(first, F.lit(False)).alias(name))
