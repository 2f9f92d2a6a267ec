"""Registered queries: each reads the given tables and returns one result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, DoubleType, TimestampNTZType

from ebbtide.operators import cleaning, comparison, definitions, encoding, evaluation, forests, history, imputing
from ebbtide.operators import logistic, monthly, reports, sampling, screening, trees, value
from ebbtide.params import LogisticParams, Settings, Study, TreeParams, ValueParams, forest_grid
from ebbtide.plans import features as plan
from ebbtide.plans import scoring, training
from ebbtide.session import materialise
from ebbtide.sources import sample_tables as sample
from ebbtide.sources.sample_tables import DENSE, SPARSE

Query = Callable[[SparkSession, str], DataFrame]


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Results as they are compared: doubles rounded with ties pushed upwards, dates as text."""
    columns = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, DoubleType):
            c = F.round(c + 1.3 * 10 ** -(digits + 3), digits)
        elif isinstance(f.dataType, (DateType, TimestampNTZType)):
            c = F.to_date(c).cast("string")
        columns.append(c.alias(f.name))
    return df.select(*columns)


def raw_sales(spark: SparkSession, folder: str, study: Study) -> DataFrame:
    return sample.event_sales(spark, folder) if study is DENSE else sample.order_sales(spark, folder)


def sales_until(spark: SparkSession, folder: str, study: Study, ahead: bool = False) -> DataFrame:
    return cleaning.clean_sales(
        raw_sales(spark, folder, study), until=study.last_look_ahead() if ahead else study.cut
    )


def accounts(spark: SparkSession, folder: str) -> DataFrame:
    return cleaning.clean_accounts(sample.customer_accounts(spark, folder))


def label(spark: SparkSession, folder: str, study: Study = SPARSE) -> DataFrame:
    recent = cleaning.clean_sales(raw_sales(spark, folder, study), until=study.last_look_ahead())
    return history.churn_label(recent, study)


def raw_table(spark: SparkSession, folder: str, study: Study = SPARSE) -> DataFrame:
    return plan.raw_features(sales_until(spark, folder, study, ahead=True), accounts(spark, folder), study)


def feature_table(spark: SparkSession, folder: str, study: Study = SPARSE) -> DataFrame:
    table, _ = plan.training_features(
        raw_sales(spark, folder, study), sample.customer_accounts(spark, folder), study
    )
    return table


def scored(spark: SparkSession, folder: str) -> DataFrame:
    table = plan.deterministic_score(feature_table(spark, folder))
    return table.select("client_id", "churned", "score")


def flagged(spark: SparkSession, folder: str, study: Study = SPARSE) -> DataFrame:
    sales = cleaning.clean_sales(raw_sales(spark, folder, study), since=study.definition_start)
    frequency = definitions.client_frequency(sales, study.definition_start, study.cut)
    return definitions.churn_definitions(frequency, study.inactivity_days)


def many_accounts(spark: SparkSession, folder: str) -> DataFrame:
    """Several account rows per client, as the account dimension may hold."""
    return sample.table(spark, folder, "orders").select(
        F.col("o_custkey").alias("client_id"),
        F.col("o_orderpriority").alias("province"),
        F.col("o_orderstatus").alias("account_type"),
        (F.col("o_orderkey") % 5).cast("double").alias("sector"),
    )


def written_label(spark: SparkSession, folder: str, study: Study = SPARSE) -> DataFrame:
    """The label as a table, for operators that read their input more than once."""
    return materialise(label(spark, folder, study), "label")


def split(spark: SparkSession, folder: str, study: Study = SPARSE) -> DataFrame:
    return sampling.stratified_split(written_label(spark, folder, study), study.seed, study.train_percent)


def balanced(spark: SparkSession, folder: str, study: Study = SPARSE) -> DataFrame:
    train = split(spark, folder, study).filter("in_train").drop("in_train")
    return sampling.oversample(materialise(train, "train"), study.seed)


def class_balance(spark: SparkSession, folder: str) -> DataFrame:
    marked = materialise(split(spark, folder), "split")
    train = marked.filter("in_train").drop("in_train")
    parts = [
        marked.select(F.lit("dataset").alias("part"), "churned"),
        marked.select(F.when(F.col("in_train"), "train").otherwise("test").alias("part"), "churned"),
        sampling.oversample(train, SPARSE.seed).select(F.lit("balanced").alias("part"), "churned"),
    ]
    whole = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return reports.class_balance(whole, "churned", "part")


def encoded(spark: SparkSession, folder: str) -> DataFrame:
    levels = encoding.fit_levels(cleaning.category_levels(accounts(spark, folder), encoding.CATEGORIES))
    levels = {c: levels[c] for c in encoding.CATEGORIES}
    table = feature_table(spark, folder).select(
        "client_id", *history.FLAG_COLUMNS, "sector", *encoding.CATEGORIES
    )
    return encoding.dummy_columns(table, levels)


def scoring_table(spark: SparkSession, folder: str) -> DataFrame:
    table, _ = plan.scoring_features(
        raw_sales(spark, folder, SPARSE), sample.customer_accounts(spark, folder), SPARSE
    )
    return table


def recent_monthly(spark: SparkSession, folder: str) -> DataFrame:
    recent = cleaning.clean_sales(raw_sales(spark, folder, SPARSE), since=SPARSE.scoring_start)
    return monthly.monthly_client(monthly.client_month(recent, SPARSE.scoring_start))


def kpis(spark: SparkSession, folder: str) -> DataFrame:
    scored_now = plan.deterministic_score(scoring_table(spark, folder)).select(
        "client_id", (F.col("score") > 0.5).cast("int").alias("churn"), F.col("score").alias("probability")
    )
    return value.score_kpis(scored_now, recent_monthly(spark, folder))


def all_months(spark: SparkSession, folder: str) -> DataFrame:
    return monthly.client_month(cleaning.clean_sales(raw_sales(spark, folder, SPARSE)))


def numeric(table: DataFrame) -> list[str]:
    return imputing.numeric_columns(table)


def with_table(make: Callable[[DataFrame], DataFrame]) -> Query:
    """A report over the feature table."""
    return lambda spark, folder: make(feature_table(spark, folder))


def impute_median(spark: SparkSession, folder: str) -> DataFrame:
    raw = materialise(
        raw_table(spark, folder).select("client_id", *imputing.TWO_EVENT_COLUMNS), "raw-features"
    )
    return imputing.fill_medians(raw, imputing.fit_medians(raw, imputing.TWO_EVENT_COLUMNS))


def score_comparison(spark: SparkSession, folder: str) -> DataFrame:
    """Three scores that need no training, compared as models are: two by one threshold, one by its best."""
    table = materialise(plan.deterministic_score(feature_table(spark, folder)), "scored")
    scores = {
        "mixed": F.col("score"),
        "activity": F.round(1 / (1 + F.col("activity_change")), 4),
        "recency": F.round(F.col("mean_gap") / (F.col("mean_gap") + 200), 4),
    }
    configurations = []
    for name, score in scores.items():
        rows = table.select("churned", score.alias("score"))
        cut = evaluation.youden_threshold(rows) if name == "recency" else 0.5
        configurations.append((name, rows, cut, evaluation.auc(rows).first()["auc"]))
    return comparison.model_metrics(configurations)


def sql_queries() -> dict[str, Query]:
    """Queries that SQL can check."""
    windows = history.window_columns(SPARSE.windows)
    dense_columns = [c for c in plan.predictors(DENSE) if c not in plan.CONTEXT]
    return {
        "sales_scan": lambda s, d: sample.order_sales(s, d),
        "accounts_scan": lambda s, d: sample.customer_accounts(s, d),
        "sales_star_join": lambda s, d: sample.star_sales(s, d),
        "accounts_star_join": lambda s, d: sample.star_accounts(s, d),
        "table_summary": lambda s, d: tidy(_summary(feature_table(s, d)), 4),
        "text_summary": with_table(lambda t: reports.text_summary(t, encoding.CATEGORIES)),
        "clean_sales": lambda s, d: cleaning.clean_sales(raw_sales(s, d, SPARSE)),
        "clean_accounts": lambda s, d: accounts(s, d),
        "definition_window": lambda s, d: cleaning.between_days(
            cleaning.clean_sales(raw_sales(s, d, SPARSE), SPARSE.definition_start, SPARSE.cut),
            SPARSE.definition_start, SPARSE.cut),
        "sales_derived": lambda s, d: cleaning.derive_sales(cleaning.clean_sales(raw_sales(s, d, SPARSE))),
        "active_clients": lambda s, d: cleaning.active_clients(
            sales_until(s, d, SPARSE), SPARSE.cut, SPARSE.cohort_days),
        "active_sales": lambda s, d: cleaning.active_sales(
            sales_until(s, d, SPARSE), SPARSE.cut, SPARSE.cohort_days),
        "current_cut": lambda s, d: cleaning.clean_sales(raw_sales(s, d, SPARSE)).agg(
            F.max("sale_date").alias("cut")),
        "category_levels": lambda s, d: cleaning.category_levels(accounts(s, d), encoding.CATEGORIES),
        "dedup_clients": lambda s, d: cleaning.one_per_key(many_accounts(s, d)),
        "client_frequency": lambda s, d: flagged(s, d).drop(*definitions.FLAGS),
        "churn_definitions": lambda s, d: flagged(s, d),
        "definition_eval": lambda s, d: definitions.evaluate_definitions(flagged(s, d)),
        "definition_eval_dense": lambda s, d: definitions.evaluate_definitions(flagged(s, d, DENSE)),
        "definition_pivot": lambda s, d: definitions.compare_definitions(
            definitions.evaluate_definitions(flagged(s, d))),
        "client_gaps": lambda s, d: history.client_gaps(sales_until(s, d, SPARSE), SPARSE.cut),
        "client_gaps_dense": lambda s, d: history.client_gaps(sales_until(s, d, DENSE), DENSE.cut),
        "feature_history": lambda s, d: history.client_features(
            sales_until(s, d, SPARSE), SPARSE, labelled=False).select("client_id", *history.HISTORY),
        "feature_windows": lambda s, d: history.client_features(
            sales_until(s, d, SPARSE), SPARSE, labelled=False).select("client_id", *windows),
        "feature_ratios": lambda s, d: history.with_ratios(history.client_features(
            sales_until(s, d, SPARSE), SPARSE, labelled=False), SPARSE.windows).select(
                "client_id", *history.RATIOS),
        "feature_context": lambda s, d: plan.with_context(
            cleaning.active_clients(sales_until(s, d, SPARSE), SPARSE.cut, SPARSE.cohort_days), accounts(s, d)),
        "feature_context_fanout": lambda s, d: plan.with_context(
            cleaning.active_clients(sales_until(s, d, SPARSE), SPARSE.cut, SPARSE.cohort_days),
            many_accounts(s, d), "never"),
        "churn_label": lambda s, d: label(s, d),
        "churn_label_dense": lambda s, d: label(s, d, DENSE),
        "label_text": lambda s, d: label(s, d).withColumn("churned", encoding.label_text()),
        "feature_table": lambda s, d: feature_table(s, d),
        "feature_table_dense": lambda s, d: feature_table(s, d, DENSE).select(
            "client_id", *dense_columns, "churned"),
        "null_report": lambda s, d: imputing.null_report(raw_table(s, d), plan.predictors(SPARSE)),
        "impute_zero": lambda s, d: imputing.fill_windows(raw_table(s, d), SPARSE.windows).select(
            "client_id", *windows),
        "impute_sentinel": lambda s, d: imputing.fill_two_event(raw_table(s, d)).select(
            "client_id", *imputing.TWO_EVENT_COLUMNS),
        "impute_median": impute_median,
        "class_balance": class_balance,
        "features_long": with_table(lambda t: reports.features_long(t, numeric(t))),
        "feature_histogram": with_table(lambda t: reports.feature_histogram(t, numeric(t))),
        "feature_correlation": with_table(lambda t: reports.correlation_table(t, numeric(t))),
        "corr_pairs": with_table(lambda t: reports.correlated_pairs(reports.correlation_table(t, numeric(t)))),
        "corr_screen": corr_screen,
        "lasso_lambdas": lasso_lambdas,
        "lasso_penalties": lasso_penalties,
        "lasso_flag": lasso_flag,
        "glm_flag": glm_flag,
        "glm_flag_summary": glm_flag_summary,
        "tree_stump": tree_stump,
        "bag_weights": bag_weights,
        "impurity_by_group": with_table(lambda t: reports.impurity_by_group(t, "account_type", "churned")),
        "stratified_split": lambda s, d: split(s, d),
        "stratified_split_dense": lambda s, d: split(s, d, DENSE),
        "oversample": lambda s, d: balanced(s, d),
        "oversample_dense": lambda s, d: balanced(s, d, DENSE),
        "balance_weights": lambda s, d: sampling.balance_weights(written_label(s, d)),
        "kfold": lambda s, d: sampling.stratified_folds(written_label(s, d), SPARSE.seed, SPARSE.folds),
        "encoded_features": encoded,
        "deterministic_score": lambda s, d: scored(s, d),
        "confusion": lambda s, d: evaluation.confusion(scored(s, d)),
        "classifier_metrics": lambda s, d: evaluation.classifier_metrics(scored(s, d)),
        "threshold_sweep": threshold_sweep,
        "roc_curve": lambda s, d: evaluation.roc_curve(scored(s, d)),
        "auc": lambda s, d: evaluation.auc(scored(s, d)),
        "youden": lambda s, d: evaluation.youden(evaluation.roc_curve(scored(s, d))),
        "score_comparison": score_comparison,
        "score_leaderboard": lambda s, d: comparison.leaderboard(score_comparison(s, d)),
        "score_metrics_long": lambda s, d: comparison.metrics_long(score_comparison(s, d)),
        "best_score": lambda s, d: comparison.best_model(score_comparison(s, d)),
        "client_month": lambda s, d: tidy(all_months(s, d), 4),
        "monthly_client": lambda s, d: _money(monthly.monthly_client(all_months(s, d))),
        "monthly_global": lambda s, d: _money(monthly.monthly_global(monthly.monthly_client(all_months(s, d)))),
        "score_features": scoring_table,
        "score_kpis": lambda s, d: tidy(kpis(s, d), 4),
        "expected_loss": lambda s, d: tidy(value.expected_loss(kpis(s, d), ValueParams()), 4),
        "expected_loss_total": lambda s, d: tidy(
            value.expected_loss_total(value.expected_loss(kpis(s, d), ValueParams())), 2),
        "kpi_summary": lambda s, d: tidy(reports.table_summary(
            kpis(s, d), ["probability", *value.KPIS]), 4),
        "score_summary": lambda s, d: value.score_summary(kpis(s, d)),
    }


# The registered fits: all penalties and steps, and the whole of `forest_grid` (324 combinations, from 180 fits of 500 trees).
FITS = Settings(study=SPARSE, forests=tuple(forest_grid(33)), logistic=LogisticParams())
_stages: dict[tuple[str, str, str], object] = {}


def stage(name: str, spark: SparkSession, folder: str):
    """A training stage, run once per session and folder and shared by the queries that report on it."""
    key = (spark.sparkContext.applicationId, folder, name)
    if key not in _stages:
        _stages[key] = _STAGES[name](lambda other: stage(other, spark, folder), spark, folder)
    return _stages[key]


def stages(names: list[str], spark: SparkSession, folder: str, shared: tuple[str, ...] = ("vectors",)) -> list:
    """Several stages side by side, after those that more than one of them needs."""
    for name in shared:
        stage(name, spark, folder)
    return training.at_once(spark, *(lambda name=name: stage(name, spark, folder) for name in names))


_STAGES = {
    "data": lambda get, s, d: training.prepare(
        sample.order_sales(s, d), sample.customer_accounts(s, d), SPARSE),
    "vectors": lambda get, s, d: training.tree_vectors(get("data")),
    "grown": lambda get, s, d: training.grow_tree(get("data"), get("vectors"), FITS),
    "tree": lambda get, s, d: training.train_tree(get("data"), get("vectors"), FITS),
    "forest": lambda get, s, d: training.train_forest(get("data"), get("vectors"), FITS),
    "linear": lambda get, s, d: training.linear_columns(get("data"), FITS),
    "screened": lambda get, s, d: screening.screen(
        get("linear")[0], get("linear")[2], FITS.logistic.correlation_limit),
    "logistic": lambda get, s, d: training.train_logistic(get("data"), FITS, get("linear")),
    "trained": lambda get, s, d: training.evaluate(get("data"), *stages(["tree", "forest", "logistic"], s, d)),
    "metrics": lambda get, s, d: materialise(get("trained").metrics(), "metrics"),
}


def records(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A report of a few rows that a fit has left on the driver."""
    return spark.createDataFrame([tuple(r.values()) for r in rows], schema)


def tree_fit(spark: SparkSession, folder: str) -> DataFrame:
    data, result = stage("data", spark, folder), stage("tree", spark, folder)
    nodes = result.tree.nodes.values()
    final = result.tree.leaves_at(result.cp)
    row = {
        "rows": data.rows, "nodes": len(nodes), "leaves": sum(not n.inner for n in nodes), "cp_cv": result.cp_cv,
        "cp_limit": result.cp_limit, "cp": result.cp, "final_leaves": len(final),
        "final_depth": max(len(result.tree.ancestors(n)) - 1 for n in final),
    }
    return records(spark, [row], "rows long, nodes int, leaves int, cp_cv double, cp_limit double, cp double, "
                                 "final_leaves int, final_depth int")


def tree_fit_entropy(spark: SparkSession, folder: str) -> DataFrame:
    inputs = stage("vectors", spark, folder)
    model = trees.fit_tree(inputs.train, FITS.tree, inputs.most_levels, entropy=True)
    tree = trees.weakest_links(trees.node_table(spark, model, FITS.tree.min_split), FITS.tree.cp)
    return records(spark, tree.path, "cp double, splits int, leaves int, rel_error double")


def tree_cp_path(spark: SparkSession, folder: str) -> DataFrame:
    _, tree = stage("grown", spark, folder)
    table = records(spark, tree.path, "cp double, splits int, leaves int, rel_error double")
    return table.withColumn("within_limit", F.col("leaves") <= FITS.tree.max_leaves)


def tree_rules(spark: SparkSession, folder: str) -> DataFrame:
    result = stage("tree", spark, folder)
    return trees.rules(spark, result.tree, result.cp, result.inputs.names, result.inputs.levels)


def importance_top(spark: SparkSession, folder: str) -> DataFrame:
    tree, forest = stages(["tree", "forest"], spark, folder)
    table = comparison.importance_table(
        spark, "tree", trees.importance(tree.tree, tree.cp, tree.inputs.names), 15)
    return table.unionByName(comparison.importance_table(
        spark, "forest", forests.importance(forest.model, forest.inputs.names), 15))


def rf_grid(spark: SparkSession, folder: str) -> DataFrame:
    result = stage("forest", spark, folder)
    return forests.grid_table(result.inputs.train, result.grid, result.scores)


def rf_fit(spark: SparkSession, folder: str) -> DataFrame:
    result = stage("forest", spark, folder)
    row = {"trees": result.model.getNumTrees, "nodes": result.model.totalNumNodes, "mtry": result.best.mtry,
           "accuracy": float(max(result.scores))}
    return records(spark, [row], "trees int, nodes int, mtry int, accuracy double")


def rf_oob(spark: SparkSession, folder: str) -> DataFrame:
    """Of the combination that won, with all of its trees."""
    inputs, best = stage("vectors", spark, folder), stage("forest", spark, folder).best
    return forests.out_of_bag(inputs.train, best, best.trees, levels=inputs.most_levels)


def forest_scores(spark: SparkSession, folder: str) -> DataFrame:
    result = stage("forest", spark, folder)
    return result.test.withColumn("predicted", (F.col("score") > 0.5).cast("int"))


def corr_screen(spark: SparkSession, folder: str) -> DataFrame:
    _, pairs = stage("screened", spark, folder)
    return records(spark, pairs, "variable string, kept string, abs_correlation double, dropped boolean")


def lasso_penalties(spark: SparkSession, folder: str, params: LogisticParams = FITS.logistic) -> DataFrame:
    """The penalties to try: from the one that lets the first screened variable in, downwards."""
    columns, _ = stage("screened", spark, folder)
    largest = logistic.largest_lambda(stage("linear", spark, folder)[0], columns)
    rows = [{"step": i, "lambda": x} for i, x in enumerate(logistic.lambda_path(largest, params))]
    return records(spark, rows, "step int, lambda double")


def lasso_lambdas(spark: SparkSession, folder: str) -> DataFrame:
    """A path of six penalties over the same range."""
    return lasso_penalties(spark, folder, LogisticParams(lambdas=6))


def one_flag(spark: SparkSession, folder: str) -> DataFrame:
    """The label and one 0/1 column, for which the linear models have closed forms."""
    table = feature_table(spark, folder).select("churned", (F.col("last_sale_month") > 3).cast("double").alias("late"))
    return materialise(encoding.linear_inputs(["late"], []).fit(table).transform(table), "one-flag")


def glm_flag(spark: SparkSession, folder: str) -> DataFrame:
    data = one_flag(spark, folder)
    wald = logistic.wald_table(data, logistic.fit_glm(data), ["late"])
    return wald.select("variable", "coefficient", "std_error", "z", "odds_ratio")


def glm_flag_summary(spark: SparkSession, folder: str) -> DataFrame:
    data = one_flag(spark, folder)
    return logistic.glm_summary(data, logistic.fit_glm(data)).drop("iterations")


def lasso_flag(spark: SparkSession, folder: str) -> DataFrame:
    """The coefficient along the whole path, and whether each fit is an optimum."""
    data, params = one_flag(spark, folder), FITS.logistic
    lambdas = logistic.lambda_path(logistic.largest_lambda(data, ["late"]), params)
    rows = [{"step": i, "lambda": f.penalty, "coefficient": f.coefficients[0], "intercept": f.intercept,
             "optimal": f.residual <= params.tolerance}
            for i, f in enumerate(logistic.lasso_fits(data, lambdas, params))]
    table = records(spark, rows, "step int, lambda double, coefficient double, intercept double, optimal boolean")
    return tidy(table, 4)


def tree_stump(spark: SparkSession, folder: str) -> DataFrame:
    """One split of one integer column: where it lies, and what is on each side."""
    table = feature_table(spark, folder).select("churned", F.col("weekday_sales").cast("double").alias("n"))
    data = materialise(encoding.tree_inputs(["n"], []).fit(table).transform(table), "stump")
    params = TreeParams(max_depth=1)
    nodes = trees.node_table(spark, trees.fit_tree(data, params), params.min_split)
    root = nodes[0]
    rows = []
    if root.inner:
        left, right = nodes[root.left], nodes[root.right]
        rows = [{"threshold": float(root.cuts[0]), "left_rows": int(left.rows), "left_churned": int(left.positives),
                 "right_rows": int(right.rows), "right_churned": int(right.positives), "gain": float(root.gain)}]
    return records(spark, rows, "threshold double, left_rows long, left_churned long, right_rows long, "
                                "right_churned long, gain double")


def bag_weights(spark: SparkSession, folder: str) -> DataFrame:
    """How often each client is drawn for the first trees of a bag."""
    draws = F.explode(F.array(*[
        F.struct(F.lit(b).alias("tree"), forests.poisson_weight(F.col("client_id"), SPARSE.seed, b).alias("weight"))
        for b in range(3)
    ]))
    return label(spark, folder).select("client_id", draws.alias("d")).select("client_id", "d.*")


def threshold_sweep(spark: SparkSession, folder: str) -> DataFrame:
    rows = materialise(scored(spark, folder), "scored")
    return evaluation.threshold_sweep(rows, [0.3, 0.4, 0.5, 0.6, evaluation.youden_threshold(rows)])


def vif(spark: SparkSession, folder: str) -> DataFrame:
    selection = stage("logistic", spark, folder).selection
    parts = [records(spark, rows, "variable string, vif double").withColumn("step", F.lit(step))
             for step, rows in (("screened", selection.screened_vif), ("final", selection.final_vif))]
    return parts[0].unionByName(parts[1]).withColumn("over_limit", F.col("vif") > FITS.logistic.vif_limit)


def lasso_path(spark: SparkSession, folder: str) -> DataFrame:
    selection = stage("logistic", spark, folder).selection
    path = records(spark, selection.path, "lambda double, mean_auc double, se_auc double")
    return path.withColumn("chosen", F.col("lambda") == selection.chosen_lambda)


def lr_selection_summary(spark: SparkSession, folder: str) -> DataFrame:
    s = stage("logistic", spark, folder).selection
    steps = {"original": s.original, "after correlation screen": s.screened, "selected by lasso": s.selected,
             "in the model": s.final}
    rows = [{"place": i, "step": name, "variables": len(v)} for i, (name, v) in enumerate(steps.items())]
    return records(spark, rows, "place int, step string, variables int")


def glm_fit(spark: SparkSession, folder: str) -> DataFrame:
    wald = stage("logistic", spark, folder).wald
    return wald.select("variable", "coefficient", "p", "significant").orderBy("p", "variable")


def glm_summary(spark: SparkSession, folder: str) -> DataFrame:
    result = stage("logistic", spark, folder)
    return logistic.glm_summary(result.train, result.model)


def lr_predict(spark: SparkSession, folder: str) -> DataFrame:
    result = stage("logistic", spark, folder)
    parts = [t.select(F.lit(n).alias("part"), "client_id", "churned", "score")
             for n, t in (("train", result.train), ("test", result.test))]
    return parts[0].unionByName(parts[1]).withColumn("predicted", (F.col("score") > 0.5).cast("int"))


def score_clients(spark: SparkSession, folder: str) -> DataFrame:
    data, tree = stage("data", spark, folder), stage("tree", spark, folder)
    clients = scoring.score_clients(
        sample.order_sales(spark, folder), sample.customer_accounts(spark, folder), SPARSE,
        lambda features: scoring.score_with_tree(features, tree.pruned), data.all_medians())
    return value.expected_loss(clients, FITS.value)


def fitted_queries() -> dict[str, Query]:
    """Queries that report on trained models; SQL cannot train them."""
    return {
        "tree_fit": tree_fit,
        "tree_fit_entropy": tree_fit_entropy,
        "tree_cp_path": tree_cp_path,
        "tree_cv": lambda s, d: records(
            s, stage("tree", s, d).cv, "cp double, mean_error double, sd_error double"),
        "tree_predict": lambda s, d: stage("tree", s, d).test,
        "tree_rules": tree_rules,
        "importance_top": importance_top,
        "rf_grid": rf_grid,
        "rf_fit": rf_fit,
        "rf_oob": rf_oob,
        "rf_predict": forest_scores,
        "vif": vif,
        "lasso_path": lasso_path,
        "lasso_select": lambda s, d: records(
            s, stage("logistic", s, d).selection.selected, "variable string, coefficient double"),
        "lr_selection_summary": lr_selection_summary,
        "glm_fit": glm_fit,
        "glm_summary": glm_summary,
        "glm_wald": lambda s, d: stage("logistic", s, d).wald,
        "glm_effects": lambda s, d: logistic.effects(stage("logistic", s, d).wald),
        "lr_predict": lr_predict,
        "model_metrics": lambda s, d: stage("metrics", s, d),
        "leaderboard": lambda s, d: comparison.leaderboard(stage("metrics", s, d)),
        "model_metrics_long": lambda s, d: comparison.metrics_long(stage("metrics", s, d)),
        "importance_by_model": lambda s, d: stage("trained", s, d).importances(),
        "best_model": lambda s, d: comparison.best_model(stage("metrics", s, d)),
        "executive_summary": lambda s, d: comparison.executive_summary(
            stage("metrics", s, d), ["metrics", "summary"]).drop("analysed_on"),
        "score_clients": score_clients,
    }


def _summary(table: DataFrame) -> DataFrame:
    return reports.table_summary(table, numeric(table))


def _money(df: DataFrame) -> DataFrame:
    """Amounts to 4 digits, other doubles to 6."""
    return df.withColumns({c: F.round(F.col(c) + 1.3e-7, 4) for c in df.columns if "volume" in c})


def _tidied(make: Query) -> Query:
    return lambda spark, folder: tidy(make(spark, folder))


def queries() -> dict[str, Query]:
    return {name: _tidied(make) for name, make in (sql_queries() | fitted_queries()).items()}
