"""Features as model inputs: dummy columns, and one fitted pipeline for training, test and scoring."""

from __future__ import annotations

import re

from pyspark.ml import Pipeline
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixed_values import LEFT, STAYED
from .history import FLAG_COLUMNS

CATEGORIES = ["province", "account_type"]


def label_text(column: str = "churned"):
    return F.when(F.col(column) == 1, LEFT).when(F.col(column) == 0, STAYED)


def drop_matching(df: DataFrame, pattern: str) -> DataFrame:
    """Drop columns whose name matches, ignoring case."""
    return df.select(*[c for c in df.columns if not re.search(pattern, c, re.IGNORECASE)])


def flags_to_numbers(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in FLAG_COLUMNS if c in df.columns})


def dummy_columns(df: DataFrame, levels: dict[str, list[str]]) -> DataFrame:
    """0/1 columns: every level of the first category, all but the first level of the others."""
    dummies = {}
    for position, (column, names) in enumerate(levels.items()):
        for name in names if position == 0 else names[1:]:
            dummies[f"{column}_{name}"] = F.coalesce((F.col(column) == name).cast("double"), F.lit(0.0))
    kept = [c for c in df.columns if c not in levels]
    return flags_to_numbers(df).select(
        *kept, *[value.alias(name) for name, value in dummies.items()]
    )


def fit_levels(levels_table: DataFrame) -> dict[str, list[str]]:
    """Levels per category as fitted: the column names of the encoded table."""
    found: dict[str, list[str]] = {}
    for row in levels_table.orderBy("column", "level_index").collect():  # one row per level
        found.setdefault(row["column"], []).append(row["level"])
    return found


def tree_inputs(numeric: list[str], categories: list[str] = CATEGORIES) -> Pipeline:
    """Categories as indexes, which the tree learners split by set; unknown levels get an index of their own."""
    indexed = [f"{c}_index" for c in categories]
    stages = []
    if categories:
        stages.append(StringIndexer(
            inputCols=categories, outputCols=indexed, handleInvalid="keep", stringOrderType="alphabetAsc"
        ))
    return Pipeline(stages=[*stages, VectorAssembler(inputCols=[*numeric, *indexed], outputCol="features")])


def linear_inputs(numeric: list[str], categories: list[str] = CATEGORIES) -> Pipeline:
    """Categories as dummy columns, for models that want numbers only."""
    indexed, dummies = [f"{c}_index" for c in categories], [f"{c}_dummy" for c in categories]
    stages = []
    if categories:
        stages += [
            StringIndexer(inputCols=categories, outputCols=indexed, handleInvalid="keep",
                          stringOrderType="alphabetAsc"),
            OneHotEncoder(inputCols=indexed, outputCols=dummies, dropLast=True),
        ]
    return Pipeline(stages=[*stages, VectorAssembler(inputCols=[*numeric, *dummies], outputCol="features")])
