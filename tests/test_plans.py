"""The three plans end to end: study, training with saved bundles, scoring with a bundle."""

import threading

import pytest

from ebbtide.params import ForestParams, LogisticParams, Settings, ValueParams, forest_grid
from ebbtide.plans import scoring, training
from ebbtide.plans.study import definition_study
from ebbtide.sources import readers, sinks
from ebbtide.sources.sample_tables import SPARSE, customer_accounts, order_sales

SETTINGS = Settings(study=SPARSE, forests=(ForestParams(6, 5, max_leaves=8, max_depth=6),),
                    logistic=LogisticParams(lambdas=3, max_iter=20))


@pytest.fixture(scope="module")
def folder():
    return "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def data(spark, folder):
    return training.prepare(order_sales(spark, folder), customer_accounts(spark, folder), SPARSE)


@pytest.fixture(scope="module")
def trained(data):
    return training.train_all(data, SETTINGS)


def test_no_client_in_two_folds_or_parts(data):
    folds = data.balanced.select("client_id", "fold").distinct()
    assert folds.count() == folds.select("client_id").distinct().count()
    assert data.train.join(data.test, "client_id", "left_semi").count() == 0


def test_leaky_folds_on_request(spark, folder):
    leaky = training.prepare(order_sales(spark, folder), customer_accounts(spark, folder), SPARSE, leak=True)
    folds = leaky.balanced.select("client_id", "fold").distinct()
    assert folds.count() > folds.select("client_id").distinct().count()


def test_bundles_and_scoring(spark, folder, data, trained, tmp_path):
    paths = training.save_all(trained, str(tmp_path))
    metrics = spark.read.option("header", True).csv(paths["metrics"])
    assert metrics.count() == 5 and "balanced_accuracy" in metrics.columns
    _, described = sinks.load_bundle(spark, paths["tree"])
    row = described.first()
    assert row["levels"] == ["No", "Si"] and row["seed"] == 123 and "auc" in row["metrics"]
    assert len(row["features"]) == 33
    out = scoring.score_and_value(
        spark, order_sales(spark, folder), customer_accounts(spark, folder), SETTINGS, paths["tree"],
        str(tmp_path / "scored"))
    clients = out["clients"].collect()
    summary = out["summary"].first()
    assert summary["clients"] == len(clients) == len({r["client_id"] for r in clients}) == 337
    assert summary["predicted_to_leave"] == sum(r["churn"] for r in clients)
    assert out["total"].first()[0] == pytest.approx(sum(r["expected_loss"] for r in clients))
    for kind in ("forest", "logistic"):
        alone = scoring.score_and_value(
            spark, order_sales(spark, folder), customer_accounts(spark, folder), SETTINGS, paths[kind],
            str(tmp_path / f"scored-{kind}"))
        rows = alone["clients"].collect()
        threshold = spark.read.parquet(f"{paths[kind]}/description").first()["metrics"]["threshold"]
        assert len(rows) == 337 and all(r["churn"] == int(r["probability"] > threshold) for r in rows)
    factor = ValueParams().factor
    assert all(r["expected_loss"] == pytest.approx(r["probability"] * r["mean_month_volume"] * factor) for r in clients)


def test_tree_respects_the_leaf_limit(trained):
    assert len(trained.tree.tree.leaves_at(trained.tree.cp)) <= SETTINGS.tree.max_leaves


def test_context_reaches_the_linear_model_on_request(data):
    with_context = Settings(study=SPARSE, logistic=LogisticParams(use_context=True))
    _, levels, columns = training.linear_columns(data, with_context)
    assert "sector" in columns and any(c.startswith("province_") for c in columns) and levels["account_type"]
    _, none, plain = training.linear_columns(data, SETTINGS)
    assert not none and not any("province" in c or c == "sector" for c in plain)


def test_inflated_variables_go_one_by_one(data):
    loose = Settings(study=SPARSE, logistic=LogisticParams(
        correlation_limit=0.99, lambdas=3, lambda_ratio=1e-5, max_iter=20, drop_by_vif=True))
    selection = training.select_variables(data, loose)
    assert len(selection.final) < len(selection.selected)
    assert all(r["vif"] <= 5 for r in selection.final_vif) and len(selection.final_vif) == len(selection.final)


def test_saved_models_score_test_rows_as_training_did(spark, data, trained, tmp_path):
    paths = training.save_all(trained, str(tmp_path))
    for kind, result in (("tree", trained.tree), ("forest", trained.forest), ("logistic", trained.logistic)):
        again = scoring.score_with_bundle(spark, data.test, paths[kind]).join(
            result.test.select("client_id", "score"), "client_id")
        assert again.count() == data.test.count() and again.where("abs(probability - score) > 1e-9").count() == 0


def test_whole_grid():
    assert len(forest_grid(33)) == 324 and {p.mtry for p in forest_grid(33)} == {4, 6, 8}


def test_value_factor():
    v = 1 / 1.04
    assert ValueParams().factor == pytest.approx(v**0.5 * (1 - v**12) / (1 - v))


def test_study(spark, folder):
    evaluated, wide = definition_study(order_sales(spark, folder), SPARSE)
    assert evaluated.count() == 14 and wide.count() == 5


def test_reading_and_writing_tables(spark, folder, tmp_path):
    sales = order_sales(spark, folder).limit(50)
    sinks.write_scored(sales, str(tmp_path / "sales"))
    sinks.write_scored(sales, str(tmp_path / "text"), "csv")
    assert readers.read_sales(spark, str(tmp_path / "sales")).count() == 50
    assert spark.read.option("header", True).csv(str(tmp_path / "text")).count() == 50
    customer_accounts(spark, folder).write.parquet(str(tmp_path / "accounts"))
    assert readers.read_accounts(spark, str(tmp_path / "accounts")).columns == readers.ACCOUNT_COLUMNS


def test_models_are_trained_side_by_side(spark):
    both = threading.Barrier(3, timeout=30)  # broken unless all three run at the same time

    def job(i):
        both.wait()
        return spark.range(i).count()

    assert training.at_once(spark, *(lambda i=i: job(i) for i in (3, 1, 2))) == [3, 1, 2]

    def fails():
        raise ValueError("no rows")

    with pytest.raises(ValueError, match="no rows"):
        training.at_once(spark, lambda: 1, fails)
