"""Feature rules on hand-made rows, against row-by-row arithmetic."""

import datetime as dt
import statistics

import pytest
from pyspark.sql import functions as F

from ebbtide.operators import cleaning, history, imputing
from ebbtide.params import Study
from ebbtide.plans import features as plan

STUDY = Study()
CUT = STUDY.cut


def rows_by_client(df):
    return {r["client_id"]: r.asDict() for r in df.collect()}


@pytest.fixture(scope="module")
def features(make_sales):
    ok, no = "APPROVED", "REJECTED"
    rows = [
        # 1: one sale
        (1, -5, "mpos", ok, 10.0),
        # 2: two sales on one day
        (2, -3, "qr", ok, 5.0), (2, -3, "payment_link", no, 7.0),
        # 3: three sales, the last two on different days
        (3, -100, "other_device", ok, 1.0), (3, -40, "mpos", ok, 2.0), (3, -10, "mpos", None, 4.0),
        # 4: no amount at all
        (4, -1, "mpos", ok, None), (4, -9, "mpos", ok, None),
        # 5: amounts that cancel out
        (5, -2, "qr", ok, 3.0), (5, -4, "qr", ok, -3.0),
        # 6: on the edges of the windows: at cut, cut-15, cut-60; comes back at cut+60
        (6, 0, "mpos", ok, 1.0), (6, -15, "mpos", ok, 2.0), (6, -60, "mpos", ok, 4.0), (6, 60, "mpos", ok, 9.0),
        # 7: last sale exactly 60 days ago: not in the cohort
        (7, -60, "mpos", ok, 1.0),
        # 8: back only after the horizon
        (8, -1, "mpos", ok, 1.0), (8, 61, "mpos", ok, 1.0),
        # 9: only after the cut
        (9, 5, "mpos", ok, 1.0),
        # 10: the same large amount every time, several a day
        *[(10, -d, "mpos", ok, 123456789.1) for d in (1, 1, 2, 30, 30, 31)],
        # 11: first day without an amount
        (11, -20, "mpos", ok, None), (11, -10, "qr", ok, 2.0), (11, -5, "qr", ok, 4.0),
    ]
    return rows, rows_by_client(history.client_features(make_sales(rows), STUDY))


def test_cohort(features):
    assert set(features[1]) == {1, 2, 3, 4, 5, 6, 8, 10, 11}


def test_label_boundaries(features):
    churned = {c: r["churned"] for c, r in features[1].items()}
    assert churned[6] == 0 and churned[8] == 1 and churned[1] == 1


def test_gaps(features):
    _, got = features
    assert got[1]["days_between_last_two"] is None and got[1]["mean_gap"] is None
    assert got[2]["days_between_last_two"] == 0 and got[2]["mean_gap"] == 0 and got[2]["gap_deviation"] is None
    assert got[3]["days_between_last_two"] == 30
    assert got[3]["gap_deviation"] == pytest.approx(statistics.stdev([60, 30]))
    assert got[10]["days_between_last_two"] == 0
    assert got[10]["gap_deviation"] == pytest.approx(statistics.stdev([1, 0, 28, 1, 0]))
    assert got[6]["mean_gap"] == 30 and got[6]["days_between_last_two"] == 15


def test_amounts_against_plain_arithmetic(features):
    rows, got = features
    for client, r in got.items():
        amounts = [a for c, d, _, _, a in rows if c == client and d <= 0 and a is not None]
        assert r["total_amount"] == pytest.approx(sum(amounts))
        assert r["mean_ticket"] == (pytest.approx(statistics.mean(amounts)) if amounts else None)
        expected = pytest.approx(statistics.stdev(amounts), abs=1e-6) if len(amounts) > 1 else None
        assert r["ticket_deviation"] == expected


def test_null_status_poisons_the_approval_rate(features):
    _, got = features
    assert got[3]["approved"] is None and got[3]["approval_rate"] is None
    assert got[2]["approved"] == 1 and got[2]["approval_rate"] == 0.5


def test_channels_and_products(features):
    _, got = features
    assert got[2]["sells_mixed"] and got[2]["products"] == 2
    assert not got[1]["sells_online"] and got[1]["sells_in_person"]
    assert not got[3]["sells_mixed"] and got[3]["products"] == 2


def test_windows_are_open_on_the_left(features):
    _, got = features
    assert (got[6]["sales_15d"], got[6]["sales_30d"], got[6]["sales_60d"], got[6]["sales_90d"]) == (1, 2, 2, 3)
    assert got[4]["sales_15d"] == 2 and got[4]["amount_15d"] == 0 and got[4]["ticket_15d"] is None
    assert got[3]["amount_15d"] == 4.0
    assert got[3]["sales_15d"] == 1


def test_empty_window_is_null_before_filling(make_sales):
    got = rows_by_client(history.client_features(make_sales([(1, -50, "mpos", "APPROVED", 3.0)]), STUDY))[1]
    assert got["sales_30d"] == 0 and got["amount_30d"] is None and got["amount_60d"] == 3.0


def test_invariants(features):
    for r in features[1].values():
        assert r["weekday_sales"] + r["weekend_sales"] == r["sales"]
        assert r["sales_15d"] <= r["sales_30d"] <= r["sales_60d"] <= r["sales_90d"] <= r["sales"]


def test_new_client_includes_its_first_day(make_sales):
    rows = [(1, -90, "mpos", "APPROVED", 1.0), (1, -1, "mpos", "APPROVED", 1.0),
            (2, -91, "mpos", "APPROVED", 1.0), (2, -1, "mpos", "APPROVED", 1.0)]
    got = rows_by_client(history.client_features(make_sales(rows), STUDY))
    assert got[1]["new_client"] and not got[2]["new_client"]


def test_ratios(make_sales):
    rows = [(1, -1, "mpos", "APPROVED", 6.0), (1, -2, "mpos", "APPROVED", 6.0), (1, -20, "mpos", "APPROVED", 3.0),
            (2, -1, "mpos", "APPROVED", 3.0), (2, -2, "mpos", "APPROVED", -3.0), (3, -40, "mpos", "APPROVED", 2.0)]
    got = rows_by_client(history.with_ratios(history.client_features(make_sales(rows), STUDY), STUDY.windows))
    assert got[1]["activity_change"] == pytest.approx(2 / 1.5)
    assert got[1]["frequency_change"] == pytest.approx(7.5 - 9.5)
    assert got[1]["ticket_change"] == pytest.approx((6 - 5) / 5)
    assert got[2]["ticket_change"] is None  # mean ticket 0
    assert got[3]["activity_change"] == 0 and got[3]["frequency_change"] is None and got[3]["ticket_change"] == -1


def test_label_alone_agrees_with_the_table(make_sales, features):
    alone = {r[0]: r[1] for r in history.churn_label(make_sales(features[0]), STUDY).collect()}
    assert alone == {c: r["churned"] for c, r in features[1].items()}


def test_since_bounds_the_history(make_sales):
    rows = [(1, -100, "mpos", "APPROVED", 1.0), (1, -5, "mpos", "APPROVED", 1.0)]
    got = rows_by_client(history.client_features(
        make_sales(rows), STUDY, since=CUT - dt.timedelta(days=50), labelled=False))
    assert got[1]["sales"] == 1 and "churned" not in got[1]


ACCOUNT_SCHEMA = "client_id long, province string, account_type string, sector double"


def test_context_fan_out_and_dedup(spark, make_sales):
    sales = make_sales([(1, -1, "mpos", "APPROVED", 1.0), (2, -1, "mpos", "APPROVED", 1.0)])
    accounts = spark.createDataFrame([(1, "B", "x", 1.0), (1, "A", "y", None), (1, "A", "x", None)], ACCOUNT_SCHEMA)
    count = {d: plan.with_context(history.client_features(sales, STUDY), accounts, d).count()
             for d in ("before", "after", "never")}
    assert count == {"before": 2, "after": 2, "never": 4}
    kept = rows_by_client(plan.with_context(history.client_features(sales, STUDY), accounts, "before"))
    assert (kept[1]["province"], kept[1]["account_type"]) == ("A", "x")
    assert kept[2]["province"] is None


def test_imputation_leaves_no_gaps(spark, make_sales, features):
    accounts = spark.createDataFrame([(1, "A", "x", 1.0), (2, "A", "x", 3.0), (3, "B", "x", 7.0)], ACCOUNT_SCHEMA)
    raw = plan.raw_features(make_sales(features[0]), accounts, STUDY)
    filled = plan.fill_rules(raw, STUDY)
    medians = imputing.fit_medians(filled)
    assert set(medians) == {"mean_ticket", "approval_rate", "sector"}
    assert medians["sector"] == 3.0
    done = imputing.fill_medians(filled, medians)
    left = {r["column"] for r in imputing.null_report(done).collect()}
    assert left == {"province", "account_type"}
    assert rows_by_client(done)[1]["gap_deviation"] == -1


def test_approximate_medians_are_close(spark):
    df = spark.range(2001).select(F.when(F.col("id") > 0, F.col("id").cast("double")).alias("x"))
    assert imputing.fit_medians(df, ["x"]) == {"x": 1000.5}
    assert abs(imputing.fit_medians(df, ["x"], approx=True)["x"] - 1000.5) <= 1


def test_clean_sales_bounds_reach_the_scan(spark, small):
    from ebbtide.sources.sample_tables import order_sales

    cleaned = cleaning.clean_sales(order_sales(spark, small), dt.date(1999, 1, 1), dt.date(1999, 1, 31))
    plan_text = cleaned._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderdate" in plan_text and "LessThan(o_orderdate" in plan_text
    days = [r[0] for r in cleaned.select("sale_date").distinct().collect()]
    assert min(days) >= dt.date(1999, 1, 1) and max(days) <= dt.date(1999, 1, 31)


def test_feature_plan_reads_sales_once_and_shuffles_twice(spark, small):
    from ebbtide.sources.sample_tables import SPARSE, order_sales

    sales = cleaning.clean_sales(order_sales(spark, small), until=SPARSE.last_look_ahead())
    text = history.client_features(sales, SPARSE)._jdf.queryExecution().executedPlan().toString()
    assert text.count("FileScan") == 1
    assert text.count("Exchange") == 2


def test_hot_client_shrinks_to_its_days(spark, make_sales):
    """A client with a third of all sales reaches the second shuffle as days times products rows."""
    hot = [(1, -(i % 40), ("mpos", "qr")[i % 2], "APPROVED", float(i % 11)) for i in range(3000)]
    rest = [(2 + i % 500, -(i % 59), "mpos", "APPROVED", 1.0) for i in range(6000)]
    sales = make_sales(hot + rest)
    assert history.client_days(sales).filter("client_id = 1").count() == 40
    got = rows_by_client(history.client_features(sales, STUDY))[1]
    amounts = [r[4] for r in hot]
    assert got["sales"] == 3000 and got["products"] == 2
    assert got["total_amount"] == pytest.approx(sum(amounts))
    assert got["ticket_deviation"] == pytest.approx(statistics.stdev(amounts))
    days = sorted(r[1] for r in hot)
    assert got["gap_deviation"] == pytest.approx(statistics.stdev([b - a for a, b in zip(days, days[1:])]))
