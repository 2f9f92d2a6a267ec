"""Missing values: counting them and filling them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..fixed_values import SENTINEL
from .history import window_columns
from .ordering import exact_quantiles

TWO_EVENT_COLUMNS = [
    "gap_deviation", "days_between_last_two", "mean_gap", "ticket_deviation", "frequency_change", "ticket_change",
]


def null_report(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Columns with missing values and how many, most first: one aggregate over all columns."""
    columns = columns or df.columns
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("missing")) for c in columns]))
    return (
        counts.select(pairs.alias("p")).select("p.*").filter("missing > 0").orderBy(F.desc("missing"), "column")
    )


def fill_windows(df: DataFrame, windows: tuple[int, ...]) -> DataFrame:
    return df.fillna(0, [c for c in window_columns(windows) if c in df.columns])


def fill_two_event(df: DataFrame) -> DataFrame:
    return df.fillna(SENTINEL, [c for c in TWO_EVENT_COLUMNS if c in df.columns])


def numeric_columns(df: DataFrame, skip: tuple[str, ...] = ("client_id", "churned")) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, NumericType) and f.name not in skip]


def fit_medians(
    df: DataFrame, columns: list[str] | None = None, approx: bool = False, every: bool = False
) -> dict[str, float]:
    """Median of each given numeric column that lacks a value somewhere; of all of them with `every`."""
    columns = columns or numeric_columns(df)
    missing = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns]).first().asDict()
    wanted = [c for c in columns if every or missing[c] > 0]
    if not wanted:
        return {}
    if approx:
        row = df.agg(*[F.approx_percentile(F.col(c), 0.5, 10000).alias(c) for c in wanted]).first().asDict()
        return {c: float(v) for c, v in row.items() if v is not None}
    rows = exact_quantiles(df, wanted, [0.5]).collect()  # one number per column
    return {r["column"]: float(r["value"]) for r in rows if r["value"] is not None}


def fill_medians(df: DataFrame, medians: dict[str, float]) -> DataFrame:
    return df.fillna({c: v for c, v in medians.items() if c in df.columns})
