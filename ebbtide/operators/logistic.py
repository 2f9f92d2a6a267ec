"""Logistic model: LASSO selection with the one-standard-error rule, binomial fit, Wald table, effects."""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorSlicer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixed_values import HIGH, LOW, MEDIUM, PROTECTIVE, RISK
from ..params import LogisticParams
from ..session import materialise

INTERCEPT = "(Intercept)"


def largest_lambda(df: DataFrame, columns: list[str], label: str = "churned") -> float:
    """The penalty that lets the first variable in: largest |correlation with the label| times its deviation."""
    y = F.col(label).cast("double")
    row = df.agg(
        F.stddev_pop(y).alias("spread"),
        *[F.corr(F.col(c).cast("double"), y).alias(f"c_{i}") for i, c in enumerate(columns)],
    ).first()
    strengths = [abs(row[f"c_{i}"]) for i in range(len(columns))
                 if row[f"c_{i}"] is not None and not math.isnan(row[f"c_{i}"])]
    return max(strengths, default=0.0) * row["spread"]


def lambda_path(largest: float, params: LogisticParams) -> list[float]:
    """Penalties from the largest down, evenly spaced in logarithm."""
    steps = max(params.lambdas - 1, 1)
    return [largest * params.lambda_ratio ** (i / steps) for i in range(params.lambdas)]


def _lasso(label: str, params: LogisticParams, features: str = "features") -> LogisticRegression:
    return LogisticRegression(
        featuresCol=features, labelCol=label, elasticNetParam=1.0, standardization=True, maxIter=params.max_iter
    )


@dataclass(frozen=True)
class LassoFit:
    """The model at one penalty. `residual` is how far it is from an optimum, as a share of the penalty."""

    penalty: float
    intercept: float
    coefficients: tuple[float, ...]
    residual: float


def gradients(prepared: DataFrame, models: list[tuple[float, list[float]]], label: str = "churned") -> list[list[float]]:
    """Mean of (probability - label) times each column, and last that of (probability - label), for each model.

    One aggregate for all models, given as (intercept, coefficients): products are added up as one vector per task.
    """
    x, y = F.col("x"), F.col("y")
    products = []
    for intercept, coefficients in models:
        weights = F.lit([float(c) for c in coefficients])
        terms = F.zip_with(x, weights, lambda a, b: a * b)
        margin = F.aggregate(terms, F.lit(float(intercept)), lambda total, term: total + term)
        products.append((1 / (1 + F.exp(-margin)) - y).alias("r"))
    rows = prepared.select(vector_to_array("features").alias("x"), F.col(label).cast("double").alias("y"))
    rows = rows.select("x", F.array(*products).alias("errors"))
    each = F.transform("errors", lambda e: F.concat(F.transform(x, lambda v: v * e), F.array(e)))
    mean = rows.select(Summarizer.mean(array_to_vector(F.flatten(each))).alias("mean")).first()["mean"].toArray()
    return mean.reshape(len(models), -1).tolist()


def lasso_residuals(
    prepared: DataFrame, fits: list[tuple[float, float, list[float]]], label: str = "churned"
) -> list[float]:
    """How far each fit (penalty, intercept, coefficients) is from an optimum, as a share of its penalty; 0 is one.

    At an optimum the gradient of a column, over its deviation, is the penalty against the coefficient's sign, or at most
    the penalty where the coefficient is 0, and the intercept's is 0.
    """
    deviations = column_deviations(prepared)
    return [
        _residual(penalty, coefficients, gradient, deviations)
        for (penalty, _, coefficients), gradient in zip(fits, gradients(prepared, [f[1:] for f in fits], label))
    ]


def column_deviations(prepared: DataFrame) -> list[float]:
    return prepared.select(Summarizer.std(F.col("features")).alias("s")).first()["s"].toArray().tolist()


def _residual(penalty: float, coefficients, gradient: list[float], deviations: list[float]) -> float:
    worst = abs(gradient[-1])
    for b, g, s in zip(coefficients, gradient, deviations):
        if s > 0:
            worst = max(worst, abs(g / s + math.copysign(penalty, b)) if b else abs(g / s) - penalty)
    return worst / penalty


def lasso_fits(
    prepared: DataFrame, lambdas: list[float], params: LogisticParams, label: str = "churned"
) -> list[LassoFit]:
    """One fit for each penalty, the largest first, on the columns that can have a coefficient.

    Sequential strong rule: a column is set aside if its gradient at the last penalty is below twice the new penalty
    minus the last one. The rule may err, so the gradients of the fit are computed for all columns, and a fit is repeated
    with the columns that should have been in it. `residual`, over all columns, says whether the steps sufficed.
    """
    deviations = column_deviations(prepared)
    share = prepared.agg(F.avg(F.col(label).cast("double"))).first()[0]
    if share in (None, 0.0, 1.0):
        raise ValueError("both classes are needed")
    nothing = (math.log(share / (1 - share)), [0.0] * len(deviations))
    usable = [j for j, s in enumerate(deviations) if s > 0]
    gradient = gradients(prepared, [nothing], label)[0]
    last, fits, active = max((abs(gradient[j]) / deviations[j] for j in usable), default=0.0), [], set()
    for penalty in sorted(lambdas, reverse=True):
        threshold = 2 * penalty - max(last, penalty)
        kept = active | {j for j in usable if abs(gradient[j]) / deviations[j] >= threshold * (1 - 1e-9)}
        while True:
            intercept, coefficients = nothing[0], list(nothing[1])
            if kept:
                order = sorted(kept)
                narrow = VectorSlicer(inputCol="features", outputCol="kept", indices=order).transform(prepared)
                estimator = _lasso(label, params, "kept")
                wanted = {estimator.regParam: penalty, estimator.tol: params.tol}
                model = estimator.fit(narrow.select(label, "kept"), wanted)
                intercept = float(model.intercept)
                for j, c in zip(order, model.coefficients.toArray()):
                    coefficients[j] = float(c)
            gradient = gradients(prepared, [(intercept, coefficients)], label)[0]
            missed = {j for j in usable if j not in kept
                      and abs(gradient[j]) / deviations[j] > penalty * (1 + params.tolerance)}
            if not missed:
                break
            kept |= missed
        active = {j for j, c in enumerate(coefficients) if c}
        last = penalty
        fits.append(LassoFit(penalty, intercept, tuple(coefficients),
                             _residual(penalty, coefficients, gradient, deviations)))
    return fits


def few_parts(prepared: DataFrame, rows: int, values: int = 1 << 22) -> DataFrame:
    """The rows in parts of about `values` numbers, as each of the many steps of a fit starts a task for every part."""
    row = prepared.select(F.size(vector_to_array("features")).alias("n")).first()
    return prepared.coalesce(max(1, math.ceil(rows * (row["n"] if row else 1) / values)))


def fold_statistics(
    rows: DataFrame, folds: int, centre: np.ndarray, spread: np.ndarray, models: np.ndarray | None = None
) -> np.ndarray:
    """Sums over the rows outside of each fold (`y`, `fold`, `x`), one pass for all folds and one row per part.

    Columns are centred, scaled and followed by a one. With a model for each fold: loss, gradient and curvature of the
    logistic loss at it; without: number of rows, sums and cross products.
    """
    width = len(spread) + 1

    def sums(batches):
        import pyarrow as pa

        total = np.zeros((folds, 1 + width + width * width))
        for batch in batches:
            if not batch.num_rows:
                continue
            y, fold = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            x = np.asarray(batch.column(2).flatten()).reshape(len(y), -1)
            z = np.column_stack([(x - centre) / spread, np.ones(len(y))])
            for f in range(folds):
                outside = fold != f
                zf, yf = z[outside], y[outside]
                loss, error, weight = np.ones(len(yf)), np.ones(len(yf)), np.ones(len(yf))
                if models is not None:
                    margin = zf @ models[f]
                    chance = 0.5 * (1 + np.tanh(margin / 2))
                    loss = np.logaddexp(0, margin) - yf * margin
                    error, weight = chance - yf, chance * (1 - chance)
                total[f, 0] += loss.sum()
                total[f, 1 : width + 1] += error @ zf
                total[f, width + 1 :] += ((zf * weight[:, None]).T @ zf).ravel()
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel()], pa.list_(pa.float64()))], names=["sums"])

    parts = rows.mapInArrow(sums, "sums array<double>")
    whole = parts.agg(Summarizer.sum(array_to_vector("sums")).alias("sums")).first()["sums"]
    return whole.toArray().reshape(folds, -1)


def quadratic_lasso(curve: np.ndarray, slope: np.ndarray, start: np.ndarray, penalty: np.ndarray) -> np.ndarray:
    """The point with the least `slope` * step + step * `curve` * step / 2 + `penalty` * |point|, by coordinates.

    Columns without a curvature stay where they are.
    """
    point, rest, sizes = start.copy(), -slope, np.diag(curve)
    places = [j for j in range(len(point)) if sizes[j] > 0]
    for _ in range(10000):
        largest = 0.0
        for j in places:
            wanted = rest[j] + sizes[j] * point[j]
            value = math.copysign(max(abs(wanted) - penalty[j], 0.0), wanted) / sizes[j]
            step = value - point[j]
            if step:
                point[j] = value
                rest = rest - curve[j] * step
                largest = max(largest, abs(step) * sizes[j])
        if largest < 1e-12:
            break
    return point


@dataclass
class FoldState:
    """Where the path of one fold has got to: the model (scaled columns, intercept last) and what is known at it."""

    rows: float
    ratios: np.ndarray
    model: np.ndarray
    candidate: np.ndarray
    at: int = 0
    steps: int = 0
    value: float = math.inf
    slope: np.ndarray | None = None
    curve: np.ndarray | None = None


def fold_models(
    prepared: DataFrame, lambdas: list[float], folds: int, params: LogisticParams, label: str = "churned"
) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients (fold, penalty, column) and intercepts (fold, penalty) of the LASSO fits without each fold.

    Newton steps, each a quadratic LASSO solved by coordinates from the curvature that one pass finds for all folds at
    once, and each penalty from the model of the one before. A penalty is done when the gradient is within
    `params.tolerance` / 1000 of an optimum, as a share of the penalty, or after `params.max_iter` steps; a step that
    raises the objective is halved. Columns are penalised by their deviation in the fold's own rows.
    """
    rows = prepared.select(
        F.col(label).cast("double").alias("y"), F.col("fold").cast("int").alias("fold"),
        vector_to_array("features").alias("x"))
    first = prepared.select(Summarizer.metrics("mean", "std", "count").summary(F.col("features")).alias("s")).first()["s"]
    centre, spread = first["mean"].toArray(), first["std"].toArray()
    spread = np.where(spread > 0, spread, 1.0)
    rows = materialise(rows.coalesce(max(1, math.ceil(first["count"] * len(spread) / (1 << 20)))), "lasso-rows")
    width = len(spread)
    states = []
    shares = {r["fold"]: (r["n"], r["y"]) for r in rows.groupBy("fold").agg(
        F.count("*").alias("n"), F.sum("y").alias("y")).collect()}
    for f, sums in enumerate(fold_statistics(rows, folds, centre, spread)):
        n, mean = sums[0], sums[1 : width + 1] / sums[0]
        cross = sums[width + 2 :].reshape(width + 1, width + 1)
        variance = np.maximum(np.diag(cross)[:width] - n * mean**2, 0.0) / max(n - 1, 1)
        deviations = np.where(variance > 1e-18, np.sqrt(variance), 0.0)
        share = sum(y for fold, (_, y) in shares.items() if fold != f) / n
        if share in (0.0, 1.0):
            raise ValueError(f"both classes are needed outside of fold {f}")
        model = np.append(np.zeros(width), math.log(share / (1 - share)))
        states.append(FoldState(n, deviations, model, model))
    order = sorted(range(len(lambdas)), key=lambda i: -lambdas[i])
    found = np.zeros((folds, len(lambdas), width + 1))

    def objective(s: FoldState, loss: float, model: np.ndarray) -> float:
        return loss / s.rows + lambdas[order[s.at]] * float(s.ratios @ np.abs(model[:width]))

    def far(s: FoldState) -> float:
        """How far the model is from an optimum, as a share of the penalty."""
        penalty, slope, model = lambdas[order[s.at]], s.slope, s.model
        worst = abs(slope[width])
        for g, r, b in zip(slope, s.ratios, model[:width]):
            if r > 0:
                worst = max(worst, abs(g / r + math.copysign(penalty, b)) if b else abs(g / r) - penalty)
        return worst / penalty

    while any(s.at < len(order) for s in states):
        sums = fold_statistics(rows, folds, centre, spread, np.array([s.candidate for s in states]))
        for f, s in enumerate(states):
            if s.at == len(order):
                continue
            s.steps += 1
            value = objective(s, sums[f, 0], s.candidate)
            if not value <= s.value + 1e-12 * abs(s.value) and s.steps < params.max_iter:
                s.candidate = (s.model + s.candidate) / 2
                continue
            s.model, s.value, loss = s.candidate, value, sums[f, 0]
            s.slope = sums[f, 1 : width + 2] / s.rows
            s.curve = sums[f, width + 2 :].reshape(width + 1, width + 1) / s.rows
            while s.at < len(order) and (far(s) <= params.tolerance / 1000 or s.steps >= params.max_iter):
                found[f, order[s.at]] = s.model
                s.at, s.steps = s.at + 1, 0
                if s.at < len(order):
                    s.value = objective(s, loss, s.model)
            if s.at < len(order):
                usable = np.append(s.ratios > 0, True)
                curve = s.curve * np.outer(usable, usable)
                penalties = np.append(lambdas[order[s.at]] * s.ratios, 0.0)
                s.candidate = quadratic_lasso(curve, s.slope, s.model, penalties)
    coefficients = found[:, :, :width] / spread
    return coefficients, found[:, :, width] - coefficients @ centre


def lasso_path(
    prepared: DataFrame, lambdas: list[float], folds: int, params: LogisticParams, label: str = "churned",
    parallelism: int | None = None,
) -> list[dict]:
    """Mean AUC and its standard error per penalty over the given folds.

    The folds' models come from passes that all of them share (`fold_models`); they are judged side by side.
    """
    evaluator = BinaryClassificationEvaluator(
        labelCol=label, rawPredictionCol="margin", metricName="areaUnderROC", numBins=0)
    spark = prepared.sparkSession
    sizes = {r["fold"]: r["count"] for r in prepared.groupBy("fold").count().collect()}
    for fold in range(folds):
        if not sizes.get(fold, 0) or sum(sizes.values()) == sizes[fold]:
            raise ValueError(f"fold {fold} leaves nothing to train on or to judge by")
    coefficients, intercepts = fold_models(prepared, lambdas, folds, params, label)
    held = [few_parts(prepared.filter(F.col("fold") == f), sizes[f]).select(
        label, vector_to_array("features").alias("x")) for f in range(folds)]

    def judged(job: tuple[int, int]) -> float:
        fold, i = job
        margin = F.lit(float(intercepts[fold, i]))
        for j, c in enumerate(coefficients[fold, i].tolist()):
            margin = margin + F.lit(c) * F.col("x")[j] if c else margin
        return evaluator.evaluate(held[fold].select(label, margin.alias("margin")))

    jobs = [(fold, i) for i in range(len(lambdas)) for fold in range(folds)]
    with ThreadPoolExecutor(parallelism or max(8, min(16, spark.sparkContext.defaultParallelism))) as pool:
        found = dict(zip(jobs, pool.map(inheritable_thread_target(spark)(judged), jobs)))
    areas = [[found[fold, i] for fold in range(folds)] for i in range(len(lambdas))]
    return [
        {"lambda": value, "mean_auc": float(np.mean(a)), "se_auc": float(np.std(a)) / math.sqrt(folds - 1)}
        for value, a in zip(lambdas, areas)
    ]


def one_standard_error(path: list[dict]) -> float:
    """The largest penalty within one standard error of the best mean AUC."""
    best = max(path, key=lambda r: r["mean_auc"])
    return max(r["lambda"] for r in path if r["mean_auc"] >= best["mean_auc"] - best["se_auc"])


def lasso_select(
    prepared: DataFrame, names: list[str], path: list[dict], params: LogisticParams, label: str = "churned"
) -> tuple[float, list[dict]]:
    """Variables with a coefficient at the chosen penalty, by size.

    If that penalty lets none in, the next smaller ones are tried until one does.
    """
    chosen = one_standard_error(path)
    for value in sorted((r["lambda"] for r in path if r["lambda"] <= chosen), reverse=True):
        estimator = _lasso(label, params)
        model = estimator.fit(prepared, {estimator.regParam: value})
        kept = [
            {"variable": n, "coefficient": float(c)} for n, c in zip(names, model.coefficients.toArray()) if c != 0
        ]
        if kept:
            break
    else:
        raise ValueError("no penalty of the path lets a variable in")
    return value, sorted(kept, key=lambda r: (-abs(r["coefficient"]), r["variable"]))


def fit_glm(prepared: DataFrame, label: str = "churned"):
    return GeneralizedLinearRegression(
        featuresCol="features", labelCol=label, family="binomial", link="logit", maxIter=50, tol=1e-8
    ).fit(prepared)


def wald_table(prepared: DataFrame, model, names: list[str]) -> DataFrame:
    """Estimate, standard error, z, p, significance and odds ratio of each term."""
    summary = model.summary
    terms = [*names, INTERCEPT]
    estimates = [*model.coefficients.toArray().tolist(), model.intercept]
    rows = [
        (t, float(e), float(s), float(z), float(p)) for t, e, s, z, p in
        zip(terms, estimates, summary.coefficientStandardErrors, summary.tValues, summary.pValues)
    ]
    table = prepared.sparkSession.createDataFrame(
        rows, "variable string, coefficient double, std_error double, z double, p double"
    )
    return table.withColumns({"significant": F.col("p") < 0.05, "odds_ratio": F.exp("coefficient")})


def glm_summary(prepared: DataFrame, model) -> DataFrame:
    s = model.summary
    row = (float(s.deviance), float(s.nullDeviance), float(s.aic), int(s.numIterations), int(s.degreesOfFreedom))
    return prepared.sparkSession.createDataFrame(
        [row], "deviance double, null_deviance double, aic double, iterations int, degrees_of_freedom int"
    )


def effects(wald: DataFrame, top: int = 10) -> DataFrame:
    """Direction, size and change in odds of the strongest terms."""
    size = F.abs("coefficient")
    terms = wald.filter(F.col("variable") != INTERCEPT).orderBy(F.desc(size), "variable").limit(top)
    change = (F.col("odds_ratio") - 1) * 100
    return terms.withColumns({
        "effect": F.when(F.col("coefficient") > 0, RISK).otherwise(PROTECTIVE),
        "magnitude": F.when(size > 1, HIGH).when(size > 0.5, MEDIUM).otherwise(LOW),
        "odds_change_percent": F.round(change, 1),
        "meaning": F.format_string(
            "each unit more of %s %s the odds of leaving by %s %%", F.col("variable"),
            F.when(change >= 0, "raises").otherwise("lowers"), F.round(F.abs(change), 1).cast("string"),
        ),
    })
