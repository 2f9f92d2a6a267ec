import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ebbtide.operators import ordering, sampling


@pytest.fixture(scope="module", params=[(700, 37), (50, 200), (3, 3)])
def labelled(spark, request):
    left, stayed = request.param
    df = spark.range(left + stayed).select(
        F.col("id").alias("client_id"), (F.col("id") < left).cast("int").alias("churned"))
    return df, left, stayed


def test_split_takes_exact_shares(labelled):
    df, left, stayed = labelled
    got = Counter((r["churned"], r["in_train"]) for r in sampling.stratified_split(df, 123).collect())
    assert got[(1, True)] == math.ceil(left * 0.7) and got[(0, True)] == math.ceil(stayed * 0.7)
    assert sum(got.values()) == left + stayed


def test_split_ignores_partitioning_and_depends_on_the_seed(labelled):
    df, left, stayed = labelled
    first = {r["client_id"] for r in sampling.stratified_split(df, 123).filter("in_train").collect()}
    again = {r["client_id"] for r in sampling.stratified_split(df.repartition(7), 123).filter("in_train").collect()}
    assert first == again
    if left > 100:
        other = {r["client_id"] for r in sampling.stratified_split(df, 5).filter("in_train").collect()}
        assert other != first


def test_oversampling_evens_the_classes(labelled):
    df, left, stayed = labelled
    rows = sampling.oversample(df, 123).collect()
    got = Counter(r["churned"] for r in rows)
    assert got[0] == got[1] == max(left, stayed)
    assert len({(r["client_id"], r["copy"]) for r in rows}) == len(rows)
    assert {r["client_id"] for r in rows} == set(range(left + stayed))


def test_folds_are_even_within_a_class(labelled):
    df, left, stayed = labelled
    rows = sampling.stratified_folds(df, 123, 5).collect()
    assert len(rows) == left + stayed
    for label, n in ((1, left), (0, stayed)):
        sizes = Counter(r["fold"] for r in rows if r["churned"] == label)
        assert max(sizes.values()) - min(sizes.get(k, 0) for k in range(5)) <= 1


def test_weights_balance(labelled):
    df, left, stayed = labelled
    got = {r[0]: r[1] for r in sampling.balance_weights(df).groupBy("churned").agg(F.sum("weight")).collect()}
    assert got[0] == pytest.approx(max(left, stayed)) and got[1] == pytest.approx(max(left, stayed))


def test_hash_rank_is_a_permutation(labelled):
    df, left, _ = labelled
    ranks = [r["rank"] for r in ordering.hash_rank(df, "churned", "client_id", 1).filter("churned = 1").collect()]
    assert sorted(ranks) == list(range(1, left + 1))
