"""Training: features to balanced rows, three models, and their comparison.

Tables that several fits read are written once. What reaches the driver is bounded by the number of columns, tree
nodes or parameter combinations, never by clients.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import astuple, dataclass, field

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixed_values import (
    FAMILY_FOREST, FAMILY_LOGISTIC, FAMILY_TREE, LEFT, MODEL_FOREST_BEST, MODEL_FOREST_HALF, MODEL_LOGISTIC_BEST,
    MODEL_LOGISTIC_HALF, MODEL_TREE, STAYED,
)
from ..operators import comparison, evaluation, forests, logistic, sampling, screening, trees
from ..operators.encoding import (
    CATEGORIES, dummy_columns, fit_levels, flags_to_numbers, linear_inputs, tree_inputs,
)
from ..operators.cleaning import category_levels
from ..operators.imputing import fit_medians, numeric_columns
from ..params import ForestParams, Settings, Study
from ..session import materialise
from ..sources.sinks import save_bundle, write_metrics
from .features import predictors, training_features

LABEL = "churned"


@dataclass
class TrainingData:
    """Written tables: train (with folds), balanced copies of it, and test."""

    spark: SparkSession
    study: Study
    medians: dict[str, float]
    train: DataFrame
    balanced: DataFrame
    test: DataFrame
    rows: int
    whole: DataFrame

    def all_medians(self) -> dict[str, float]:
        """Also of columns that are complete here, as today's cohort may lack them."""
        rest = [c for c in numeric_columns(self.whole) if c not in self.medians]
        return fit_medians(self.whole, rest, every=True) | self.medians

    @property
    def numeric(self) -> list[str]:
        return [c for c in predictors(self.study) if c not in CATEGORIES]


def split_and_balance(table: DataFrame, study: Study, medians: dict[str, float], leak: bool = False) -> TrainingData:
    """70/30 split by class, folds, oversampling.

    Folds are dealt to clients before copies are made, so a client never sits on both sides of a fold; `leak` deals
    them to the copies instead.
    """
    spark = table.sparkSession
    marked = materialise(sampling.stratified_split(table, study.seed, study.train_percent), "split")
    train = marked.filter("in_train").drop("in_train")
    test = marked.filter("not in_train").drop("in_train")
    if leak:
        copies = sampling.oversample(train, study.seed)
        copies = copies.withColumn("copy_id", F.concat_ws("-", "client_id", "copy"))
        balanced = sampling.stratified_folds(copies, study.seed, study.folds, key="copy_id").drop("copy_id")
        folded = sampling.stratified_folds(train, study.seed, study.folds)
    else:
        folded = materialise(sampling.stratified_folds(train, study.seed, study.folds), "train")
        balanced = sampling.oversample(folded, study.seed)
    balanced = materialise(balanced, "balanced")
    return TrainingData(spark, study, medians, folded, balanced, test, balanced.count(), table)


def prepare(raw_sales: DataFrame, raw_accounts: DataFrame, study: Study, leak: bool = False) -> TrainingData:
    table, medians = training_features(raw_sales, raw_accounts, study)
    return split_and_balance(table, study, medians, leak)


@dataclass
class TreeInputs:
    """Vectors for the tree learners, from one fitted pipeline."""

    pipeline: PipelineModel
    train: DataFrame
    test: DataFrame
    names: list[str]
    levels: dict[str, list[str]]

    @property
    def most_levels(self) -> int:
        return max((len(v) for v in self.levels.values()), default=0) + 1


def tree_vectors(data: TrainingData) -> TreeInputs:
    pipeline = tree_inputs(data.numeric).fit(data.balanced)
    keep = ["client_id", LABEL, "features"]
    indexer = pipeline.stages[0]
    levels = {c: list(l) for c, l in zip(indexer.getInputCols(), indexer.labelsArray)}
    return TreeInputs(
        pipeline,
        materialise(pipeline.transform(data.balanced).select(*keep, "fold"), "tree-train"),
        pipeline.transform(data.test).select(*keep),
        [*data.numeric, *levels],
        levels,
    )


@dataclass
class TreeResult:
    inputs: TreeInputs
    model: object
    tree: trees.Tree
    cv: list[dict]
    cp_cv: float
    cp_limit: float
    cp: float
    pruned: list[trees.PrunedNode]
    test: DataFrame

    def pipeline(self) -> PipelineModel:
        return PipelineModel([*self.inputs.pipeline.stages, self.model])


def grow_tree(data: TrainingData, inputs: TreeInputs, settings: Settings):
    model = trees.fit_tree(inputs.train, settings.tree, inputs.most_levels, LABEL, seed=data.study.seed)
    return model, trees.weakest_links(trees.node_table(data.spark, model, settings.tree.min_split), settings.tree.cp)


def train_tree(data: TrainingData, inputs: TreeInputs, settings: Settings) -> TreeResult:
    """Large tree, cross-validated complexity, leaf limit, pruning."""
    model, tree = grow_tree(data, inputs, settings)
    cps = [r["cp"] for r in tree.path]
    cv = trees.cross_validate(
        data.spark, inputs.train, cps, data.study.folds, settings.tree, inputs.most_levels, LABEL,
        data.study.seed,
    )
    cp_cv = min(cv, key=lambda r: r["mean_error"])["cp"]  # the first of equals: the smaller tree
    cp_limit = trees.leaf_limit_cp(tree.path, settings.tree.max_leaves)
    cp = max(cp_cv, cp_limit)
    pruned = trees.pruned_nodes(tree, cp, inputs.names, inputs.levels)
    scored = trees.predict_tree(data.test, pruned, "client_id", LABEL).withColumnRenamed("probability", "score")
    return TreeResult(
        inputs, model, tree, cv, cp_cv, cp_limit, cp, pruned, materialise(scored, "tree-test")
    )


@dataclass
class ForestResult:
    inputs: TreeInputs
    grid: list[ForestParams]
    scores: list[float]
    best: ForestParams
    model: object
    test: DataFrame


def train_forest(data: TrainingData, inputs: TreeInputs, settings: Settings) -> ForestResult:
    grid = list(settings.forests)
    if len(grid) > 1:
        scores, best, model = forests.grid_search(
            inputs.train, grid, data.study.folds, LABEL, inputs.most_levels, data.study.seed
        )
    else:
        best, scores = grid[0], []
        model = forests.fit_forest(inputs.train, best, LABEL, inputs.most_levels, data.study.seed)
    scored = forests.with_probability(model, inputs.test, "client_id", LABEL, max_leaves=best.max_leaves)
    return ForestResult(
        inputs, grid, scores, best, model,
        materialise(scored.withColumnRenamed("probability", "score"), "forest-test"),
    )


@dataclass
class Selection:
    """The funnel of the logistic model: columns at each step and what decided it."""

    train: DataFrame
    levels: dict[str, list[str]]
    original: list[str]
    screened: list[str]
    pairs: list[dict]
    screened_vif: list[dict]
    path: list[dict]
    chosen_lambda: float
    selected: list[dict]
    final: list[str]
    final_vif: list[dict] = field(default_factory=list)


@dataclass
class LogisticResult:
    selection: Selection
    pipeline: PipelineModel
    model: object
    wald: DataFrame
    train: DataFrame
    test: DataFrame

    def whole_pipeline(self) -> PipelineModel:
        return PipelineModel([*self.pipeline.stages, self.model])


def linear_table(df: DataFrame, levels: dict[str, list[str]]) -> DataFrame:
    """Numbers only; category columns become dummies if their levels are given, and are left out otherwise."""
    return dummy_columns(df, levels) if levels else flags_to_numbers(df.drop(*CATEGORIES))


def _assembled(df: DataFrame, columns: list[str]) -> tuple[PipelineModel, DataFrame]:
    pipeline = linear_inputs(columns, []).fit(df)
    return pipeline, pipeline.transform(df)


def _vif_of(train: DataFrame, columns: list[str]) -> list[dict]:
    """Variance inflation from a fit on the given columns; empty if they are not of full rank."""
    if not screening.full_rank(train, columns):
        return []
    _, vectors = _assembled(train, columns)
    model = logistic.fit_glm(vectors, LABEL)
    errors = model.summary.coefficientStandardErrors[: len(columns)]
    return screening.vif(model.transform(vectors), columns, errors)


def linear_columns(data: TrainingData, settings: Settings) -> tuple[DataFrame, dict[str, list[str]], list[str]]:
    """The encoded balanced rows, the levels they were encoded with, and the candidate columns."""
    levels = {}
    if settings.logistic.use_context:
        found = fit_levels(category_levels(data.balanced, CATEGORIES))
        levels = {c: found.get(c, []) for c in CATEGORIES}
    encoded = linear_table(data.balanced, levels)
    skip = {"client_id", LABEL, "fold", "copy"} | (set() if settings.logistic.use_context else {"sector"})
    columns = [c for c in encoded.columns if c not in skip]
    return materialise(encoded.select("client_id", LABEL, "fold", *columns), "linear-train"), levels, columns


def select_variables(data: TrainingData, settings: Settings, linear: tuple | None = None) -> Selection:
    """Screens, LASSO, and the last drops: the fixed list, or the most inflated variable until none is over the limit.

    `linear` is the result of `linear_columns` if it is at hand.
    """
    params = settings.logistic
    train, levels, columns = linear or linear_columns(data, settings)
    screened, pairs = screening.screen(train, columns, params.correlation_limit)
    screened_vif = _vif_of(train, screened)
    _, vectors = _assembled(train, screened)
    vectors = materialise(vectors.select("client_id", LABEL, "fold", "features"), "lasso")
    lambdas = logistic.lambda_path(logistic.largest_lambda(train, screened, LABEL), params)
    path = logistic.lasso_path(vectors, lambdas, data.study.folds, params, LABEL)
    chosen, selected = logistic.lasso_select(vectors, screened, path, params, LABEL)
    names = [r["variable"] for r in selected]
    final = names if params.drop_by_vif else [c for c in names if c not in params.forced_drops]
    if not final:
        raise ValueError(f"forced_drops leave none of the selected variables {names}")
    final_vif = _vif_of(train, final)
    while params.drop_by_vif and final_vif and final_vif[0]["vif"] > params.vif_limit:
        final = [c for c in final if c != final_vif[0]["variable"]]
        final_vif = _vif_of(train, final)
    return Selection(
        train, levels, columns, screened, pairs, screened_vif, path, chosen, selected, final, final_vif
    )


def train_logistic(data: TrainingData, settings: Settings, linear: tuple | None = None) -> LogisticResult:
    selection = select_variables(data, settings, linear)
    pipeline, vectors = _assembled(selection.train, selection.final)
    model = logistic.fit_glm(vectors, LABEL)
    test = pipeline.transform(linear_table(data.test, selection.levels))
    keep = ["client_id", LABEL, F.col("prediction").alias("score")]
    return LogisticResult(
        selection, pipeline, model, logistic.wald_table(vectors, model, selection.final),
        model.transform(vectors).select(*keep),
        materialise(model.transform(test).select(*keep), "logistic-test"),
    )


@dataclass
class Trained:
    data: TrainingData
    tree: TreeResult
    forest: ForestResult
    logistic: LogisticResult
    thresholds: dict[str, float]
    aucs: dict[str, float | None]

    def metrics(self) -> DataFrame:
        return comparison.model_metrics([
            (MODEL_TREE, self.tree.test, 0.5, self.aucs["tree"]),
            (MODEL_FOREST_HALF, self.forest.test, 0.5, self.aucs["forest"]),
            (MODEL_FOREST_BEST, self.forest.test, self.thresholds["forest"], self.aucs["forest"]),
            (MODEL_LOGISTIC_HALF, self.logistic.test, 0.5, self.aucs["logistic"]),
            (MODEL_LOGISTIC_BEST, self.logistic.test, self.thresholds["logistic"], self.aucs["logistic"]),
        ])

    def importances(self) -> DataFrame:
        spark = self.data.spark
        return (
            comparison.importance_table(
                spark, FAMILY_FOREST, forests.importance(self.forest.model, self.forest.inputs.names))
            .unionByName(comparison.importance_table(
                spark, FAMILY_TREE, trees.importance(self.tree.tree, self.tree.cp, self.tree.inputs.names)))
            .unionByName(comparison.coefficient_importance(self.logistic.wald, FAMILY_LOGISTIC))
        )


def evaluate(data: TrainingData, tree: TreeResult, forest: ForestResult, logit: LogisticResult) -> Trained:
    tests = {"tree": tree.test, "forest": forest.test, "logistic": logit.test}
    aucs = {k: evaluation.auc(t, LABEL).first()["auc"] for k, t in tests.items()}
    thresholds = {k: evaluation.youden_threshold(tests[k], LABEL) for k in ("forest", "logistic")}
    return Trained(data, tree, forest, logit, thresholds, aucs)


def at_once(spark: SparkSession, *jobs: Callable[[], object]) -> list:
    """Results of jobs that do not need each other: their stages are submitted side by side, so that the many short
    passes of one do not leave the cluster idle. The first error is raised once all have ended."""
    with ThreadPoolExecutor(len(jobs)) as pool:
        started = [pool.submit(inheritable_thread_target(spark)(job)) for job in jobs]
    return [s.result() for s in started]


def train_all(data: TrainingData, settings: Settings) -> Trained:
    inputs = tree_vectors(data)
    return evaluate(data, *at_once(
        data.spark, lambda: train_tree(data, inputs, settings), lambda: train_forest(data, inputs, settings),
        lambda: train_logistic(data, settings)))


def save_all(trained: Trained, folder: str) -> dict[str, str]:
    """Three bundles that score alone, the metrics file and the executive summary.

    Each bundle holds the training medians and what its model needs besides itself: the pruned tree's nodes, the forest's
    limit on leaves, the levels of the logistic model's dummies, and the thresholds.
    """
    spark, seed = trained.data.spark, trained.data.study.seed
    levels = [STAYED, LEFT]
    tree, forest, logit = trained.tree, trained.forest, trained.logistic
    paths = {name: f"{folder}/{name}" for name in ("tree", "forest", "logistic", "metrics", "summary")}
    path_rows = [(float(r["cp"]), int(r["splits"]), float(r["rel_error"])) for r in tree.tree.path]
    medians = spark.createDataFrame(sorted(trained.data.all_medians().items()), "column string, value double")
    save_bundle(
        spark, paths["tree"], "tree", tree.pipeline(), tree.inputs.names, LABEL, levels,
        {"auc": trained.aucs["tree"], "cp": tree.cp, "threshold": 0.5}, seed,
        {
            "nodes": spark.createDataFrame([astuple(n) for n in tree.pruned], trees.PRUNED_SCHEMA),
            "medians": medians,
            "cp_path": spark.createDataFrame(path_rows, "cp double, splits int, rel_error double"),
        },
        {"split": "gini"},
    )
    save_bundle(
        spark, paths["forest"], "forest", PipelineModel([*forest.inputs.pipeline.stages, forest.model]),
        forest.inputs.names, LABEL, levels,
        {"auc": trained.aucs["forest"], "threshold": trained.thresholds["forest"]}, seed,
        {
            "grid": forests.grid_table(trained.data.train, forest.grid, forest.scores or [float("nan")]),
            "medians": medians,
        },
        {"best": str(forest.best), "max_leaves": str(forest.best.max_leaves or "")},
    )
    known = [(c, i, v) for c, names in logit.selection.levels.items() for i, v in enumerate(names)]
    save_bundle(
        spark, paths["logistic"], "logistic", logit.whole_pipeline(), logit.selection.final, LABEL, levels,
        {"auc": trained.aucs["logistic"], "threshold": trained.thresholds["logistic"]}, seed,
        {
            "coefficients": logit.wald, "medians": medians,
            "levels": spark.createDataFrame(known, "column string, level_index int, level string"),
        },
    )
    metrics = trained.metrics()
    write_metrics(metrics.drop("place"), paths["metrics"])
    comparison.executive_summary(metrics, ["metrics"]).coalesce(1).write.mode("overwrite").parquet(paths["summary"])
    return paths
