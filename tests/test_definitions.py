import datetime as dt

import pytest

from ebbtide import fixed_values as fv
from ebbtide.operators import definitions, monthly, reports

CUT, START = dt.date(2025, 2, 28), dt.date(2024, 1, 1)


@pytest.fixture(scope="module")
def flagged(make_sales):
    rows = [
        (1, -30, "mpos", "APPROVED", 1.0),                                           # one sale: flags unknown
        (2, -100, "mpos", "APPROVED", 1.0), (2, -90, "mpos", "APPROVED", 1.0),       # silent for 9 gaps
        (3, -40, "mpos", "APPROVED", 1.0), (3, -10, "mpos", "APPROVED", 1.0), (3, 400, "mpos", "APPROVED", 1.0),
        (4, -60, "mpos", "APPROVED", 1.0), (4, -60, "mpos", "APPROVED", 1.0),        # gap 0, exactly 60 days silent
        (5, 3, "mpos", "APPROVED", 1.0),                                             # after the cut only
        (6, -5000, "mpos", "APPROVED", 1.0),                                         # before the start only
    ]
    return definitions.churn_definitions(definitions.client_frequency(make_sales(rows), START, CUT))


def test_flags(flagged):
    got = {r["client_id"]: r.asDict() for r in flagged.collect()}
    assert set(got) == {1, 2, 3, 4}
    assert got[1]["left_x3"] is None and got[1]["left_60d"] == 0
    assert got[2]["left_x3"] == 1 and got[2]["left_60d"] == 1
    assert got[3]["left_x2"] == 0 and got[3]["came_back"] == 1
    assert got[4]["left_x3"] == 1 and got[4]["left_60d"] == 0


def test_unknown_outcome_counts_in_the_share(flagged):
    got = {(r["definition"], r["outcome"]): (r["n"], r["pct"])
           for r in definitions.evaluate_definitions(flagged).collect()}
    assert got[(fv.DEFINITION_X3, None)] == (1, 25.0)
    assert got[(fv.DEFINITION_X3, fv.HIT_LEFT)] == (2, 50.0)
    assert got[(fv.DEFINITION_60D, fv.MISS_LEFT)] == (2, 50.0)


def test_side_by_side_fills_zero(flagged):
    wide = definitions.compare_definitions(definitions.evaluate_definitions(flagged))
    got = {r["outcome"]: r.asDict() for r in wide.collect()}
    assert got[None]["left_60d_n"] == 0 and got[None]["left_x3_n"] == 1


def test_monthly_counts_approved_only(make_sales):
    rows = [(1, 0, "mpos", "APPROVED", 2.0), (1, -1, "mpos", "APPROVED", None), (1, -2, "mpos", "REJECTED", 9.0),
            (1, -40, "mpos", "APPROVED", 4.0), (2, 0, "mpos", None, 4.0)]
    clients = monthly.monthly_client(monthly.client_month(make_sales(rows)))
    got = [r.asDict() for r in clients.collect()]
    assert got == [{"client_id": 1, "active_months": 2, "total_sales": 3, "total_volume": 6.0,
                    "mean_month_sales": 1.5, "mean_month_volume": 3.0}]


def test_impurity_of_known_distributions(spark):
    shares = {"pure": [(0, 10)], "skewed": [(0, 8), (1, 2)], "even": [(0, 5), (1, 5)]}
    rows = [(g, c) for g, parts in shares.items() for c, n in parts for _ in range(n)]
    got = {r["g"]: r for r in reports.impurity_by_group(
        spark.createDataFrame(rows, "g string, c int"), "g", "c").collect()}
    assert got["pure"]["gini"] == 0 and got["pure"]["entropy"] == 0
    assert got["even"]["gini"] == pytest.approx(0.5) and got["even"]["entropy_scaled"] == pytest.approx(0.5)
    assert got["skewed"]["gini"] == pytest.approx(0.32)
    assert got["skewed"]["entropy"] == pytest.approx(0.7219280949)


def test_impurity_with_one_class(spark):
    only = reports.impurity_by_group(spark.createDataFrame([("a", 1)], "g string, c int"), "g", "c").first()
    assert only["gini"] == 0 and only["entropy_scaled"] == 0
