"""Definition study: which inactivity rule foresees who does not come back."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.cleaning import clean_sales
from ..operators.definitions import churn_definitions, client_frequency, compare_definitions, evaluate_definitions
from ..params import Study


def definition_study(raw_sales: DataFrame, study: Study) -> tuple[DataFrame, DataFrame]:
    """Outcomes of each definition, in long form and side by side."""
    sales = clean_sales(raw_sales, since=study.definition_start)
    frequency = client_frequency(sales, study.definition_start, study.cut)
    evaluated = evaluate_definitions(churn_definitions(frequency, study.inactivity_days))
    return evaluated, compare_definitions(evaluated)
