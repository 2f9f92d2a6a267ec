"""Where results go: files, and model bundles with the facts needed to use them again."""

from __future__ import annotations

from pyspark.ml import Model, PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_metrics(metrics: DataFrame, path: str) -> None:
    """A report of a few rows, as one CSV file with a header."""
    metrics.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_scored(scored: DataFrame, path: str, file_format: str = "parquet") -> None:
    """Scored clients, written in parallel; `csv` adds a header to each part."""
    writer = scored.write.mode("overwrite")
    writer.option("header", True).csv(path) if file_format == "csv" else writer.format(file_format).save(path)


def save_bundle(
    spark: SparkSession,
    path: str,
    kind: str,
    model: Model,
    features: list[str],
    target: str,
    levels: list[str],
    metrics: dict[str, float],
    seed: int,
    tables: dict[str, DataFrame] | None = None,
    extras: dict[str, str] | None = None,
) -> None:
    """Model, one-row description and any tables (cp path, coefficients, grid scores) under one folder."""
    pipeline = model if isinstance(model, PipelineModel) else PipelineModel([model])
    pipeline.write().overwrite().save(f"{path}/model")
    row = (
        kind, features, target, levels, {k: float(v) for k, v in metrics.items() if v is not None}, seed,
        extras or {},
    )
    schema = (
        "kind string, features array<string>, target string, levels array<string>, "
        "metrics map<string,double>, seed int, extras map<string,string>"
    )
    described = spark.createDataFrame([row], schema).withColumn("created_at", F.current_timestamp())
    described.coalesce(1).write.mode("overwrite").parquet(f"{path}/description")
    for name, table in (tables or {}).items():
        table.write.mode("overwrite").parquet(f"{path}/{name}")


def load_bundle(spark: SparkSession, path: str) -> tuple[PipelineModel, DataFrame]:
    return PipelineModel.load(f"{path}/model"), spark.read.parquet(f"{path}/description")
