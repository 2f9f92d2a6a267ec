"""Evaluation of a (label, score) table: confusion measures, exact AUC, ROC, Youden threshold, threshold sweep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .ordering import running_totals

RATES = [
    "accuracy", "error_rate", "kappa", "sensitivity", "specificity", "ppv", "npv", "f1_yes", "f1_no",
    "balanced_accuracy", "prevalence", "no_information_rate", "detection_rate", "detection_prevalence", "mcnemar",
]


def _cells(predicted: Column, label: Column) -> dict[str, Column]:
    return {
        "tp": F.count_if(predicted & (label == 1)),
        "fp": F.count_if(predicted & (label == 0)),
        "fn": F.count_if(~predicted & (label == 1)),
        "tn": F.count_if(~predicted & (label == 0)),
    }


def confusion(scored: DataFrame, threshold: float = 0.5, label: str = "churned", score: str = "score") -> DataFrame:
    """Counts of the four cells; predicted to leave if the score is over the threshold."""
    cells = _cells(F.col(score) > F.lit(threshold), F.col(label))
    return scored.agg(*[c.alias(n) for n, c in cells.items()])


def with_rates(cells: DataFrame) -> DataFrame:
    """Everything that follows from the four counts; NULL where a rate has nothing to divide by."""
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    rate = F.try_divide
    cells = cells.withColumns({
        "accuracy": rate(tp + tn, n),
        "sensitivity": rate(tp, tp + fn),
        "specificity": rate(tn, tn + fp),
        "ppv": rate(tp, tp + fp),
        "npv": rate(tn, tn + fn),
        "prevalence": rate(tp + fn, n),
        "detection_rate": rate(tp, n),
        "detection_prevalence": rate(tp + fp, n),
        "mcnemar": rate((F.abs(fp - fn) - 1) * (F.abs(fp - fn) - 1), fp + fn),
    })
    accuracy, expected = F.col("accuracy"), rate((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp), n * n)
    ppv, sensitivity = F.col("ppv"), F.col("sensitivity")
    npv, specificity = F.col("npv"), F.col("specificity")
    return cells.withColumns({
        "error_rate": 1 - accuracy,
        "kappa": rate(accuracy - expected, 1 - expected),
        "f1_yes": rate(2 * ppv * sensitivity, ppv + sensitivity),
        "f1_no": rate(2 * npv * specificity, npv + specificity),
        "balanced_accuracy": (sensitivity + specificity) / 2,
        "no_information_rate": F.greatest(F.col("prevalence"), 1 - F.col("prevalence")),
    })


def classifier_metrics(
    scored: DataFrame, threshold: float = 0.5, label: str = "churned", score: str = "score"
) -> DataFrame:
    cells = ["tp", "fp", "fn", "tn"]
    return with_rates(confusion(scored, threshold, label, score)).select(*cells, *RATES)


def score_counts(scored: DataFrame, label: str = "churned", score: str = "score") -> DataFrame:
    """One row per distinct score: all that the ROC needs, however many rows share a score."""
    return scored.filter(F.col(score).isNotNull()).groupBy(F.col(score).cast("double").alias("score")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")
    )


def _running(scored: DataFrame, label: str, score: str) -> DataFrame:
    counts = materialise(score_counts(scored, label, score), "scores")
    return running_totals(counts, "score", ["pos", "neg"], descending=True)


def roc_curve(scored: DataFrame, label: str = "churned", score: str = "score") -> DataFrame:
    """One point per distinct score, cutting half way to the next lower one; NULL threshold: everyone is flagged.

    The first point, with threshold infinity and no score, is where nobody is flagged.
    """
    counts = materialise(score_counts(scored, label, score), "scores")
    running = running_totals(counts, "score", ["pos", "neg"], descending=True)
    totals = counts.agg(F.sum("pos").alias("positives"), F.sum("neg").alias("negatives")).filter("positives is not null")
    nobody = totals.select(
        F.lit(None).cast("double").alias("score"), F.lit(float("inf")).alias("threshold"),
        F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("fp"),
        F.try_divide(F.lit(0), F.col("positives")).alias("tpr"),
        F.try_divide(F.lit(0), F.col("negatives")).alias("fpr"), "positives", "negatives")
    return nobody.unionByName(running.select(
        "score",
        ((F.col("score") + F.col("next_score")) / 2).alias("threshold"),
        F.col("running_pos").alias("tp"),
        F.col("running_neg").alias("fp"),
        F.try_divide(F.col("running_pos"), F.col("total_pos")).alias("tpr"),
        F.try_divide(F.col("running_neg"), F.col("total_neg")).alias("fpr"),
        F.col("total_pos").alias("positives"),
        F.col("total_neg").alias("negatives"),
    ))


def auc(scored: DataFrame, label: str = "churned", score: str = "score") -> DataFrame:
    """Area under the ROC curve by ranks: pairs in the right order, ties as half."""
    running = _running(scored, label, score)
    below = F.col("total_neg") - F.col("running_neg") + F.col("neg") * 0.5
    pairs = F.max("total_pos").cast("double") * F.max("total_neg")
    return running.agg(F.try_divide(F.sum(F.col("pos") * below), pairs).alias("auc"))


def youden(roc: DataFrame) -> DataFrame:
    """The threshold with the largest sensitivity + specificity - 1; the lowest of equals.

    Compared as whole numbers, so equal points are equal on any engine.
    """
    big = "decimal(38,0)"
    gain = F.col("tp").cast(big) * F.col("negatives") - F.col("fp").cast(big) * F.col("positives")
    ranked = roc.select(
        gain.alias("gain"),
        F.coalesce("threshold", F.lit(float("-inf"))).alias("threshold"),
        F.col("tpr").alias("sensitivity"),
        (1 - F.col("fpr")).alias("specificity"),
    )
    best = ranked.orderBy(F.desc("gain"), F.asc("threshold")).limit(1)
    return best.select(
        "threshold", "sensitivity", "specificity", (F.col("sensitivity") + F.col("specificity") - 1).alias("youden")
    )


def youden_threshold(scored: DataFrame, label: str = "churned", score: str = "score") -> float:
    return youden(roc_curve(scored, label, score)).first()["threshold"]


def threshold_sweep(
    scored: DataFrame, thresholds: list[float], label: str = "churned", score: str = "score"
) -> DataFrame:
    """Confusion measures at several thresholds from one aggregate."""
    aggregates, rows = [], []
    for i, t in enumerate(thresholds):
        cells = _cells(F.col(score) > F.lit(float(t)), F.col(label))
        aggregates += [c.alias(f"{n}_{i}") for n, c in cells.items()]
        rows.append(F.struct(F.lit(float(t)).alias("threshold"), *[F.col(f"{n}_{i}").alias(n) for n in cells]))
    counted = scored.agg(*aggregates).select(F.explode(F.array(*rows)).alias("p")).select("p.*")
    return with_rates(counted).select("threshold", "accuracy", "sensitivity", "specificity", "f1_yes")
