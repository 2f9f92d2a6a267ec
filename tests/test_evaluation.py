"""Order statistics and evaluation against brute force."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ebbtide.operators import evaluation, ordering, reports


def scored(spark, pairs):
    return spark.createDataFrame([(int(l), float(s)) for l, s in pairs], "churned int, score double")


@pytest.fixture(scope="module")
def tied():
    r = random.Random(4)
    return [(r.random() < 0.3, round(r.random(), 1)) for _ in range(300)]


def brute_auc(pairs):
    yes, no = [s for l, s in pairs if l], [s for l, s in pairs if not l]
    return sum((a > b) + (a == b) / 2 for a, b in itertools.product(yes, no)) / (len(yes) * len(no))


def test_auc_counts_ties_half(spark, tied):
    assert evaluation.auc(scored(spark, tied)).first()["auc"] == pytest.approx(brute_auc(tied))


def test_auc_of_the_reversed_score(spark, tied):
    both = [evaluation.auc(scored(spark, p)).first()["auc"] for p in (tied, [(l, -s) for l, s in tied])]
    assert sum(both) == pytest.approx(1)


def test_auc_of_one_class_is_unknown(spark):
    assert evaluation.auc(scored(spark, [(1, 0.1), (1, 0.2)])).first()["auc"] is None


@pytest.mark.parametrize("buckets", [1, 3, 64])
def test_roc_points_do_not_depend_on_buckets(spark, tied, buckets):
    counts = evaluation.score_counts(scored(spark, tied))
    got = ordering.running_totals(counts, "score", ["pos", "neg"], True, buckets).collect()
    following = dict(zip(sorted({s for _, s in tied}, reverse=True),
                         [*sorted({s for _, s in tied}, reverse=True)[1:], None]))
    assert len(got) == len(following)
    for r in got:
        assert r["running_pos"] == sum(l and s >= r["score"] for l, s in tied)
        assert r["running_neg"] == sum((not l) and s >= r["score"] for l, s in tied)
        assert r["total_pos"] == sum(l for l, _ in tied)
        assert r["next_score"] == following[r["score"]]


def test_youden_is_the_best_cut(spark, tied):
    best = evaluation.youden(evaluation.roc_curve(scored(spark, tied))).first()
    gains = {}
    scores = sorted({s for _, s in tied})
    yes, no = sum(l for l, _ in tied), sum(not l for l, _ in tied)
    for low, high in zip([float("-inf"), *scores], scores):
        t = (low + high) / 2
        gains[t] = sum(l and s > t for l, s in tied) / yes - sum((not l) and s > t for l, s in tied) / no
    top = max(gains.values())
    assert best["youden"] == pytest.approx(top)
    assert best["threshold"] == pytest.approx(min(t for t, g in gains.items() if abs(g - top) < 1e-12))


def test_rates_of_a_known_table(spark):
    cells = spark.createDataFrame([(40, 10, 20, 30)], "tp long, fp long, fn long, tn long")
    r = evaluation.with_rates(cells).first()
    assert r["accuracy"] == 0.7 and r["sensitivity"] == pytest.approx(2 / 3) and r["specificity"] == 0.75
    assert r["kappa"] == pytest.approx(0.4) and r["f1_yes"] == pytest.approx(80 / 110)
    assert r["mcnemar"] == pytest.approx(81 / 30) and r["no_information_rate"] == pytest.approx(0.6)


def test_rates_without_positives_are_null(spark):
    r = evaluation.classifier_metrics(scored(spark, [(0, 0.1), (0, 0.2)])).first()
    assert r["sensitivity"] is None and r["specificity"] == 1 and r["ppv"] is None and r["f1_yes"] is None


def test_threshold_is_exclusive(spark):
    r = evaluation.confusion(scored(spark, [(1, 0.5), (1, 0.51)]), 0.5).first()
    assert (r["tp"], r["fn"]) == (1, 1)


def test_sweep_agrees_with_single_thresholds(spark, tied):
    df = scored(spark, tied)
    for r in evaluation.threshold_sweep(df, [0.3, 0.6]).collect():
        one = evaluation.classifier_metrics(df, r["threshold"]).first()
        assert all(r[c] == one[c] for c in ("accuracy", "sensitivity", "specificity", "f1_yes"))


@pytest.mark.parametrize("buckets", [1, 4, 256])
def test_quantiles_match_interpolation(spark, buckets):
    r = np.random.default_rng(1)
    values = {"a": r.normal(size=501), "b": r.integers(0, 4, size=501).astype(float), "c": np.full(501, 2.0)}
    rows = [tuple(float(values[c][i]) if i % 7 or c != "a" else None for c in "abc") for i in range(501)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    probabilities = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {(x["column"], x["probability"]): x["value"]
           for x in ordering.exact_quantiles(df, ["a", "b", "c"], probabilities, buckets).collect()}
    for i, c in enumerate("abc"):
        present = [row[i] for row in rows if row[i] is not None]
        for p in probabilities:
            assert got[(c, p)] == pytest.approx(np.quantile(present, p))


def test_quantiles_of_an_empty_column(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 2.0)], "a double, b double")
    got = ordering.exact_quantiles(df, ["a", "b"], [0.5]).collect()
    assert [(r["column"], r["value"]) for r in got] == [("b", 1.5)]


def test_a_bracket_that_misses_its_place_is_opened(spark, monkeypatch):
    df = spark.range(101).select(F.col("id").cast("double").alias("a"), (F.col("id") % 7).cast("double").alias("b"))
    monkeypatch.setattr(type(df), "approxQuantile", lambda self, columns, grid, error: [[200.0] * len(grid)] * len(columns))
    got = {(r["column"], r["probability"]): r["value"] for r in ordering.exact_quantiles(df, ["a", "b"], [0.1, 0.5]).collect()}
    assert got == {("a", 0.1): 10, ("a", 0.5): 50, ("b", 0.1): 0, ("b", 0.5): 3}


def test_quantiles_with_nan_and_without_rows(spark):
    nan = float("nan")
    df = spark.createDataFrame([(1.0,), (2.0,), (nan,), (nan,), (None,)], "a double")
    got = {r["probability"]: r["value"] for r in ordering.exact_quantiles(df, ["a"], [0.0, 0.25, 1.0]).collect()}
    assert got[0.0] == 1 and got[0.25] == 1.75 and np.isnan(got[1.0])  # not-a-number is above all numbers
    assert ordering.exact_quantiles(df.where("a > 5 and not isnan(a)"), ["a"], [0.5]).collect() == []


def test_histogram_holds_every_row(spark):
    df = spark.range(1000).select((F.col("id") % 97).cast("double").alias("x"), F.lit(3.0).alias("y"))
    got = reports.feature_histogram(df, ["x", "y"]).collect()
    assert sum(r["n"] for r in got if r["name"] == "x") == 1000
    assert {r["bin"] for r in got if r["name"] == "x"} == set(range(1, 31))
    assert [(r["bin"], r["n"]) for r in got if r["name"] == "y"] == [(1, 1000)]


def test_constant_column_has_no_correlation(spark):
    df = spark.range(20).select(F.col("id").alias("a"), (F.col("id") * -2).alias("b"), F.lit(1).alias("c"))
    got = {(r[0], r[1]): r[2] for r in reports.correlation_table(df, ["a", "b", "c"]).collect()}
    assert got[("a", "b")] == pytest.approx(-1) and got[("a", "c")] is None
