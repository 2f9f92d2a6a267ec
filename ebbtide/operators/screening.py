"""Variable screening before the logistic model: variance, correlation, rank, variance inflation."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .reports import correlation_matrix


def varying_columns(df: DataFrame, columns: list[str]) -> list[str]:
    """Columns with a variance over zero: one aggregate."""
    row = df.agg(*[F.var_samp(F.col(c).cast("double")).alias(c) for c in columns]).first().asDict()
    return [c for c in columns if row[c] is not None and row[c] > 0]


def correlation_drops(names: list[str], matrix: list[list[float]], limit: float = 0.9) -> list[dict]:
    """Pairs over the limit, strongest first; each drops its earlier variable unless one of the two is gone.

    Works on the columns x columns matrix. Exact duplicates count as a pair too. Strengths are compared to 9 digits,
    so that rounding noise does not order equal pairs.
    """
    size = len(names)
    pairs = [
        (round(abs(matrix[i][j]), 9), j, i) for j in range(size) for i in range(size)
        if j < i and not math.isnan(matrix[i][j]) and abs(matrix[i][j]) > limit
    ]
    gone: set[int] = set()
    steps = []
    for strength, earlier, later in sorted(pairs, key=lambda p: (-p[0], p[1], p[2])):
        dropped = earlier not in gone and later not in gone
        if dropped:
            gone.add(earlier)
        steps.append({
            "variable": names[earlier], "kept": names[later], "abs_correlation": strength, "dropped": dropped,
        })
    return steps


def screen(df: DataFrame, columns: list[str], limit: float = 0.9) -> tuple[list[str], list[dict]]:
    """Columns left after the variance and correlation screens, and the pairs that decided."""
    varying = varying_columns(df, columns)
    steps = correlation_drops(varying, correlation_matrix(df, varying), limit)
    gone = {s["variable"] for s in steps if s["dropped"]}
    return [c for c in varying if c not in gone], steps


def full_rank(df: DataFrame, columns: list[str]) -> bool:
    """Whether no column is a linear combination of others: rank of the correlation matrix."""
    return bool(columns) and int(np.linalg.matrix_rank(np.array(correlation_matrix(df, columns)))) == len(columns)


def vif(fitted: DataFrame, columns: list[str], errors: list[float], probability: str = "prediction") -> list[dict]:
    """Variance inflation of each term of a fitted logistic model.

    For a one-column term it equals squared standard error times the weighted sum of squares of the column around
    its weighted mean, with weights p(1-p): one aggregate of three sums per column, no matrix to invert.
    Columns are shifted by their mean first, so large amounts lose no digits.
    """
    means = fitted.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in columns]).first().asDict()
    w = F.col(probability) * (1 - F.col(probability))
    sums = [F.sum(w).alias("w")]
    for i, c in enumerate(columns):
        x = F.col(c).cast("double") - F.lit(means[c])
        sums += [F.sum(w * x).alias(f"x_{i}"), F.sum(w * x * x).alias(f"xx_{i}")]
    total = fitted.agg(*sums).first()
    table = [
        {"variable": c, "vif": errors[i] ** 2 * (total[f"xx_{i}"] - total[f"x_{i}"] ** 2 / total["w"])}
        for i, c in enumerate(columns)
    ]
    return sorted(table, key=lambda r: (-r["vif"], r["variable"]))
