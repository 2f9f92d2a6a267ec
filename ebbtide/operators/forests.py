"""Random forest: grid search, final fit, out-of-bag error, importances.

A fitted forest answers for many smaller ones. Its first 100 or 300 trees are the forest that a fit with as many trees
would give, and a tree with a limit on its leaves is the same tree cut back to its strongest splits. So the grid fits one
forest for each combination of the other parameters and fold; a row goes down all trees once (`with_shares`), its leaves
give a share for each limit, and running sums give the votes of each number of trees.

The node tables of the trees go to every task that judges rows, as Spark's own model does; they hold a few numbers a node.

Where the training rows take at most `GROWN` bytes, they are sent to the tasks as codes and each task grows whole trees
(`growth.py`): a fit of the grid is a task, and all fits are one job. `spark.ml` grows a tree in passes over the rows, which
costs a job for each level of a fit and counts every bin at every node; it fits the larger tables.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from collections import defaultdict
from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, inheritable_thread_target
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from ..functions import hash_key
from ..functions.columns import HASH_BITS
from ..params import ForestParams
from ..session import materialise, new_path
from . import growth
from .growth import cut_shares
from .trees import need_bins

LEAVES = "leaves"
#: Places (rows times trees) that a task judges at once.
SLICE = 1 << 18
#: Bytes of node tables that are sent to the tasks.
SENT = 1 << 28
#: Bytes of training rows, eight for each feature and one for each hashed draw, up to which tasks grow whole trees.
GROWN = 1 << 27


def forest(label: str = "churned", levels: int = 0, seed: int = 123, max_bins: int = 128) -> RandomForestClassifier:
    need_bins(max_bins, levels)
    return RandomForestClassifier(
        featuresCol="features", labelCol=label, bootstrap=True, seed=seed, maxBins=max_bins, leafCol=LEAVES,
        cacheNodeIds=True,  # each row's node is kept, so no pass ships the trees to the tasks and walks them from the root
    )


def _param_map(rf: RandomForestClassifier, p: ForestParams) -> dict:
    return {
        rf.featureSubsetStrategy: str(p.mtry), rf.numTrees: p.trees, rf.subsamplingRate: p.sample_rate,
        rf.minInstancesPerNode: p.min_node, rf.maxDepth: p.max_depth,
    }


def fit_forest(prepared: DataFrame, params: ForestParams, label: str = "churned", levels: int = 0, seed: int = 123):
    """A forest of whole trees grown side by side, or of `spark.ml`'s passes where the rows are too many to be sent."""
    rf = forest(label, levels, seed, params.max_bins)
    data = training_codes(prepared, label)
    if data is None:
        return rf.fit(prepared, _param_map(rf, params))
    path = grown_forest(prepared.sparkSession, data, params, params.trees, seed)
    return saved_forest(prepared.sparkSession, path, rf.copy(_param_map(rf, params)), len(data["arity"]))


def training_codes(
    prepared: DataFrame, label: str, draws: Column | None = None, trees: int = 0, most: int | None = None,
) -> dict | None:
    """The training rows as codes of the distinct values of each feature; None if they take more than `most` bytes.

    The copies that oversampling has made of a client are one row with a count, whose bag is as large as theirs together;
    with `draws` (an array for each row, a count for each tree) every row is for itself. The order of the rows is that of
    their content, so the bags do not depend on how the table is partitioned.
    """
    described = prepared.schema["features"].metadata.get("ml_attr", {})
    features = described.get("num_attrs", 0)
    if not features or prepared.count() * (8 * features + trees) > (GROWN if most is None else most):
        return None
    arity = [0] * features
    for kind in ("nominal", "binary"):
        for a in described.get("attrs", {}).get(kind, []):
            arity[a["idx"]] = 2 if kind == "binary" else a.get("num_vals") or len(a["vals"])
    one = F.xxhash64("client_id") if "client_id" in prepared.columns else F.monotonically_increasing_id()
    fold = F.col("fold") if "fold" in prepared.columns else F.lit(0)
    picked = prepared.select(
        F.col(label).cast("int").alias("label"), fold.cast("int").alias("fold"), one.alias("one"),
        vector_to_array("features").alias("features"), *([draws.alias("draws")] if draws is not None else []))
    table = picked.toArrow().combine_chunks()  # at most `most` bytes
    if not table.num_rows:
        raise ValueError("a forest needs training rows")

    def matrix(name: str) -> np.ndarray:
        return np.asarray(table.column(name).combine_chunks().flatten()).reshape(table.num_rows, -1)

    x, y = matrix("features"), table.column("label").to_numpy()
    if not np.isin(y, (0, 1)).all():
        raise ValueError(f"{label} must be 0 or 1")
    if np.isnan(x).any():
        return None
    values, codes = zip(*(np.unique(c, return_inverse=True) for c in x.T))
    codes = np.column_stack(codes).astype(np.uint16 if max(map(len, values)) <= 1 << 16 else np.int32)
    data = {"values": values, "arity": arity, "label": y.astype(np.uint8), "fold": table.column("fold").to_numpy()}
    if draws is not None:
        return data | {"codes": codes, "copies": np.ones(len(y), np.int64), "draws": matrix("draws")}
    columns = [*codes.T, y, data["fold"], table.column("one").to_numpy()]
    order = np.lexsort(columns)
    new = np.ones(len(y), bool)
    new[1:] = np.any([c[order[1:]] != c[order[:-1]] for c in columns], axis=0)
    firsts = np.flatnonzero(new)
    kept = order[firsts]
    return data | {"codes": codes[kept], "label": data["label"][kept], "fold": data["fold"][kept],
                   "copies": np.diff(firsts, append=len(y))}


def _job(p: ForestParams) -> dict:
    return {"tries": p.mtry, "rate": p.sample_rate, "min_node": p.min_node, "max_depth": p.max_depth,
            "max_bins": p.max_bins}


NODE_COLUMNS = {
    "treeID": "int", "id": "int", "prediction": "double", "impurity": "double", "impurityStats": "array<double>",
    "rawCount": "long", "gain": "double", "leftChild": "int", "rightChild": "int", "featureIndex": "int",
    "leftCategoriesOrThreshold": "array<double>", "numCategories": "int",
}


def grown_forest(spark: SparkSession, data: dict, params: ForestParams, trees: int, seed: int) -> str:
    """Writes the nodes of the trees, in the layout of a saved `spark.ml` forest, and returns the folder."""
    sent = spark.sparkContext.broadcast(data)
    parts = min(trees, 2 * max(4, spark.sparkContext.defaultParallelism))
    ends = [trees * i // parts for i in range(parts + 1)]
    job, arrow = _job(params), {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(),
                                "array<double>": pa.list_(pa.float64())}
    schema = pa.schema([(c, arrow[t]) for c, t in NODE_COLUMNS.items()])
    grown_trees, saved_nodes = growth.grown_trees, growth.saved_nodes

    def run(batches):
        for batch in batches:
            for i in batch.column(0).to_pylist():
                some = job | {"first": ends[i], "end": ends[i + 1]}
                for number, tree, bins in grown_trees(sent.value, some, seed):
                    yield pa.RecordBatch.from_pydict(saved_nodes(number, tree, bins), schema=schema)

    split = F.struct("featureIndex", "leftCategoriesOrThreshold", "numCategories").alias("split")
    node = F.struct("id", "prediction", "impurity", "impurityStats", "rawCount", "gain", "leftChild", "rightChild", split)
    path = new_path(spark, "forest")
    nodes = spark.range(0, parts, 1, parts).mapInArrow(run, ", ".join(f"{c} {t}" for c, t in NODE_COLUMNS.items()))
    nodes.select("treeID", node.alias("nodeData")).write.parquet(f"{path}/data")
    return path


def saved_forest(spark: SparkSession, path: str, rf: RandomForestClassifier, features: int):
    """The model whose nodes are in a folder, with the parameters of its estimator."""
    def described(kind: str, **more) -> str:
        known = [p for p in rf.params if kind == "RandomForest" or p.name not in (
            "bootstrap", "numTrees", "subsamplingRate", "featureSubsetStrategy")]
        return json.dumps({
            "class": f"org.apache.spark.ml.classification.{kind}ClassificationModel", "timestamp": int(time.time() * 1000),
            "sparkVersion": spark.version, "uid": f"{kind}Classifier_{uuid.uuid4().hex[:12]}",
            "paramMap": {p.name: rf.getOrDefault(p) for p in known if rf.isSet(p)},
            "defaultParamMap": {p.name: rf.getOrDefault(p) for p in known if rf.hasDefault(p) and not rf.isSet(p)},
            "numFeatures": features, "numClasses": 2, **more})

    trees = rf.getNumTrees()
    spark.createDataFrame([(described("RandomForest", numTrees=trees),)], "value string").coalesce(1).write.text(
        f"{path}/metadata")
    each = [(i, described("DecisionTree"), 1.0) for i in range(trees)]
    spark.createDataFrame(each, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")
    model = RandomForestClassificationModel.load(path)
    model.saved_at = path
    return model


class ForestNodes:
    """The node tables of all trees of a fitted forest, as arrays over the nodes from the root down.

    `feature` is -1 in a leaf; a number goes left up to `cut`, a category if its row of `sets` (numbered by `cut`) holds it.
    """

    def __init__(self, spark: SparkSession, model=None, path: str | None = None):
        path = path or getattr(model, "saved_at", None)
        if path is None:
            path = new_path(spark, "forest")
            model.write().save(path)
        n = F.col("nodeData")
        split = n["split"]
        is_set = split["numCategories"] >= 0
        saved = spark.read.parquet(f"{path}/data").select(
            "treeID", n["id"].alias("id"), n["leftChild"].alias("left"), n["rightChild"].alias("right"),
            n["impurityStats"][0].alias("no"), n["impurityStats"][1].alias("yes"), n["gain"].alias("gain"),
            F.when(n["leftChild"] >= 0, split["featureIndex"]).otherwise(-1).alias("feature"),
            F.when(~is_set, F.get(split["leftCategoriesOrThreshold"], F.lit(0))).alias("cut"),
            F.when(is_set, split["leftCategoriesOrThreshold"]).alias("categories"))
        table = saved.toArrow().to_pandas().sort_values(["treeID", "id"])  # as many rows as the model has nodes
        listed = table["categories"].notna().to_numpy() & (table["feature"] >= 0).to_numpy()
        groups = [np.asarray(c, np.int64) for c in table["categories"][listed]]
        self.sets = np.zeros((len(groups), 1 + max((int(c.max()) for c in groups if len(c)), default=0)), bool)
        for i, held in enumerate(groups):
            self.sets[i, held] = True
        cut = table["cut"].to_numpy(np.float64, na_value=np.nan).copy()
        cut[listed] = np.arange(len(groups))
        table = table.assign(cut=cut, by_set=listed)
        self.trees = [{c: group[c].to_numpy() for c in ("left", "right", "no", "yes", "gain", "feature", "cut", "by_set")}
                      for _, group in table.groupby("treeID")]

    def shares(self, max_leaves: int | None = None) -> list[np.ndarray]:
        """For each tree the share of leavers of each leaf of the fitted model, after the limit on leaves."""
        return [cut_shares(t, max_leaves) for t in self.trees]

    def bytes(self, limits: int) -> int:
        """Of the table that `flat` makes: five columns, and one of shares for each limit."""
        return sum(len(t["left"]) for t in self.trees) * (21 + 8 * limits) + self.sets.size

    def flat(self, limits: list[int | None]) -> dict[str, np.ndarray]:
        """One table of all trees: `roots`, and for each node its children, its split, and its share after each limit."""
        sizes = np.array([len(t["left"]) for t in self.trees])
        roots = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        whole = {c: np.concatenate([t[c] for t in self.trees]) for c in ("feature", "cut", "by_set")}
        for c in ("left", "right"):
            whole[c] = np.concatenate([t[c] + start for t, start in zip(self.trees, roots)]).astype(np.int32)
        shares = np.zeros((len(limits), sizes.sum()))
        for i, limit in enumerate(limits):
            shares[i, whole["feature"] < 0] = np.concatenate(self.shares(limit))
        return whole | {"feature": whole["feature"].astype(np.int32), "roots": roots, "shares": shares, "sets": self.sets}


def _leaves_only(model, prepared: DataFrame, *keep: str) -> DataFrame:
    quiet = model.copy()
    for name in ("Prediction", "RawPrediction", "Probability"):
        getattr(quiet, f"set{name}Col")("")
    return quiet.transform(prepared).select(*keep, vector_to_array(LEAVES).alias(LEAVES))


def _with_shares(rows: DataFrame, tables: dict[str, list[np.ndarray]]) -> DataFrame:
    """Adds, for each name, the share of leavers of a row's leaf in each tree.

    The shares are a table with a row for each leaf of each tree, joined with the leaves of the rows, one row each. No row
    carries more than its own leaves, and Spark chooses the join by the measured size of the model.
    """
    sizes = [len(s) for s in next(iter(tables.values()))]
    columns = {"tree": np.repeat(np.arange(len(sizes), dtype="int32"), sizes),
               "leaf": np.concatenate([np.arange(n, dtype="int32") for n in sizes])}
    columns |= {name: np.concatenate(t) for name, t in tables.items()}
    shares = materialise(rows.sparkSession.createDataFrame(pa.table(columns)), "shares")
    kept = [c for c in rows.columns if c != LEAVES]
    numbered = rows.withColumn("row", F.monotonically_increasing_id())
    spread = numbered.select("row", *kept, F.posexplode(LEAVES).alias("tree", "leaf"))
    spread = spread.withColumn("leaf", F.col("leaf").cast("int"))
    one = F.array_sort(F.collect_list(F.struct("tree", *tables))).alias("found")
    found = spread.join(shares, ["tree", "leaf"]).groupBy("row").agg(*[F.first(c).alias(c) for c in kept], one)
    return found.select(*kept, *[F.col(f"found.{name}").alias(name) for name in tables])


def _judge(sent: Broadcast, kept: int, names: list[str]):
    """The function of a task that puts each row's shares beside its first columns; executors need not have this package."""
    slice_ = SLICE

    def leaves_of(x: np.ndarray, nodes: dict[str, np.ndarray]) -> np.ndarray:
        """For rows of features the leaf in each tree: all rows go down all trees, a level at a time."""
        at = np.tile(nodes["roots"], len(x))
        row = np.repeat(np.arange(len(x)), len(nodes["roots"]))
        going = np.flatnonzero(nodes["feature"][at] >= 0)
        while len(going):
            node = at[going]
            value, cut = x[row[going], nodes["feature"][node]], nodes["cut"][node]
            left = value <= cut
            listed = np.flatnonzero(nodes["by_set"][node])
            if len(listed):
                known = value[listed] < nodes["sets"].shape[1]
                place = np.where(known, value[listed], 0).astype(np.int64)
                left[listed] = known & nodes["sets"][cut[listed].astype(np.int64), place]
            at[going] = np.where(left, nodes["left"][node], nodes["right"][node])
            going = going[nodes["feature"][at[going]] >= 0]
        return at.reshape(len(x), -1)

    def judge(batches):
        import pyarrow as pa

        nodes = sent.value
        trees = len(nodes["roots"])
        step = max(1, slice_ // trees)
        for batch in batches:
            for first in range(0, batch.num_rows, step):
                part = batch.slice(first, step)
                features = np.asarray(part.column(kept).flatten()).reshape(part.num_rows, -1)
                leaf = leaves_of(features, nodes)
                ends = pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * trees)
                found = [pa.ListArray.from_arrays(ends, pa.array(share[leaf].ravel())) for share in nodes["shares"]]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(kept)), *found], names=names)

    return judge


def with_shares(
    rows: DataFrame, model, nodes: ForestNodes, limits: dict[str, int | None], *keep: str, most: int = SENT,
) -> DataFrame:
    """The columns to keep and, for each name, the share of leavers of a row's leaf in each tree after that limit.

    A projection, nothing is joined or regrouped: the node tables go to the tasks, and rows go down the trees in slices of
    bounded size. If the tables take more than `most` bytes, the leaves that the model itself finds are joined with a
    table of shares instead.
    """
    if nodes.bytes(len(limits)) > most:
        return _with_shares(_leaves_only(model, rows, *keep), {name: nodes.shares(x) for name, x in limits.items()})
    sent = rows.sparkSession.sparkContext.broadcast(nodes.flat(list(limits.values())))
    picked = rows.select(*keep, vector_to_array("features").alias("features"))
    schema = StructType([*picked.schema[: len(keep)], *(StructField(x, ArrayType(DoubleType())) for x in limits)])
    return picked.mapInArrow(_judge(sent, len(keep), [*keep, *limits]), schema)


def mean_share(shares: Column, trees: int) -> Column:
    return F.aggregate(F.slice(shares, 1, trees), F.lit(0.0), lambda s, x: s + x) / trees


def nested_accuracy(model, held: DataFrame, wanted: list[ForestParams], label: str = "churned") -> list[float]:
    """Accuracy on held-out rows of each smaller forest that a fitted one holds: one pass for all of them."""
    nodes = ForestNodes(held.sparkSession, model)
    limits = list(dict.fromkeys(p.max_leaves for p in wanted))
    rows = with_shares(held, model, nodes, {f"shares_{i}": limit for i, limit in enumerate(limits)}, label)
    right = [
        F.avg(((mean_share(F.col(f"shares_{limits.index(p.max_leaves)}"), p.trees) > 0.5) == (
            F.col(label) == 1)).cast("double")).alias(f"right_{i}")
        for i, p in enumerate(wanted)
    ]
    return [float(x) if x is not None else math.nan for x in rows.agg(*right).first()]


def side_by_side(prepared: DataFrame, wanted: int | None = None, most: int = 16) -> int:
    """How many fits run at once: one for each core of the cluster, as the stages of a small fit have few tasks.

    A fit keeps its growing trees and the splits of a group of nodes on the driver, so there is a limit.
    """
    return wanted or max(4, min(most, prepared.sparkSession.sparkContext.defaultParallelism))


def grid_scores(
    prepared: DataFrame, grid: list[ForestParams], folds: int, label: str = "churned", levels: int = 0,
    seed: int = 123, parallelism: int | None = None,
) -> list[float]:
    """Mean accuracy over the given folds of each combination, from one fit for all numbers of trees and leaf limits."""
    families: dict[ForestParams, list[int]] = defaultdict(list)
    for i, p in enumerate(grid):
        families[replace(p, trees=0, max_leaves=None)].append(i)
        need_bins(p.max_bins, levels)
    data = training_codes(prepared, label)
    if data is not None:
        return _scores_by_tasks(prepared.sparkSession, data, grid, families, folds, seed)

    def one_fit(job: tuple[ForestParams, int]) -> list[float]:
        family, fold = job
        members = [grid[i] for i in families[family]]
        largest = replace(family, trees=max(p.trees for p in members))
        model = fit_forest(prepared.filter(F.col("fold") != fold), largest, label, levels, seed)
        return nested_accuracy(model, prepared.filter(F.col("fold") == fold), members, label)

    jobs = [(family, fold) for family in families for fold in range(folds)]
    totals = [0.0] * len(grid)
    with ThreadPoolExecutor(side_by_side(prepared, parallelism)) as pool:
        for (family, _), scores in zip(jobs, pool.map(inheritable_thread_target(prepared.sparkSession)(one_fit), jobs)):
            for i, score in zip(families[family], scores):
                totals[i] += score / folds
    return totals


def _scores_by_tasks(
    spark: SparkSession, data: dict, grid: list[ForestParams], families: dict[ForestParams, list[int]], folds: int, seed: int,
) -> list[float]:
    """Each fit is a task: it grows its trees on the other folds and judges the held-out rows, the largest fits first."""
    sent = spark.sparkContext.broadcast(data)
    jobs = [_job(family) | {"fold": fold, "places": places, "members": [(grid[i].trees, grid[i].max_leaves) for i in places]}
            for family, places in families.items() for fold in range(folds)]
    jobs.sort(key=lambda j: (-j["rate"], j["min_node"], -j["tries"]))
    fold_scores = growth.fold_scores

    def run(batches):
        for batch in batches:
            for i in batch.column(0).to_pylist():
                right, rows = zip(*fold_scores(sent.value, jobs[i], seed))
                yield pa.RecordBatch.from_pydict({"place": jobs[i]["places"], "right": right, "rows": rows}, schema=pa.schema(
                    [("place", pa.int32()), ("right", pa.float64()), ("rows", pa.float64())]))

    found = spark.range(0, len(jobs), 1, len(jobs)).mapInArrow(run, "place int, right double, rows double")
    totals = [0.0] * len(grid)
    for r in sorted(found.collect()):  # a row for each combination and fold
        totals[r["place"]] += (r["right"] / r["rows"] if r["rows"] else math.nan) / folds
    return totals


def grid_search(
    prepared: DataFrame, grid: list[ForestParams], folds: int, label: str = "churned", levels: int = 0,
    seed: int = 123, parallelism: int | None = None,
):
    """Mean accuracy of each combination, the first of the best, and that one fitted on all rows."""
    scores = grid_scores(prepared, grid, folds, label, levels, seed, parallelism)
    best = grid[scores.index(max(scores))]
    return scores, best, fit_forest(prepared, best, label, levels, seed)


def grid_table(prepared: DataFrame, grid: list[ForestParams], scores: list[float]) -> DataFrame:
    rows = [(p.mtry, p.trees, p.sample_rate, p.min_node, p.max_leaves, float(s)) for p, s in zip(grid, scores)]
    return prepared.sparkSession.createDataFrame(
        rows, "mtry int, trees int, sample_rate double, min_node int, max_leaves int, accuracy double"
    ).orderBy(F.desc("accuracy"), "mtry", "trees", "sample_rate", "min_node", "max_leaves")


def with_probability(model, prepared: DataFrame, *keep: str, max_leaves: int | None = None) -> DataFrame:
    """Mean over the trees of the leaf's share of leavers."""
    if max_leaves is None:
        scored = model.transform(prepared)
        return scored.select(*keep, vector_to_array("probability")[1].alias("probability"))
    nodes = ForestNodes(prepared.sparkSession, model)
    rows = with_shares(prepared, model, nodes, {"shares": max_leaves}, *keep)
    return rows.select(*keep, mean_share(F.col("shares"), len(nodes.trees)).alias("probability"))


def _uniform(key: Column, seed: int, tree: int | Column) -> Column:
    return hash_key(key, seed, F.concat(F.lit(":bag"), F.lit(tree).cast("string"))) / F.lit(float(2**HASH_BITS))


def poisson_weight(key: Column, seed: int, tree: int, most: int = 20) -> Column:
    """Times a row is drawn for one tree: a Poisson(1) draw from the hash of its client.

    Twenty draws or more have a probability below the resolution of the hash.
    Copies of a client share the draw, so a row is never out of a bag that holds its twin.
    """
    return _poisson(_uniform(key, seed, tree), most)


def _poisson(u: Column, most: int = 20) -> Column:
    bounds, below = [], 0.0
    for k in range(most):
        below += math.exp(-1) / math.factorial(k)
        bounds.append(below)
    drawn = F.lit(float(most))
    for k in reversed(range(most)):
        drawn = F.when(u < bounds[k], float(k)).otherwise(drawn)
    return drawn


def merged_forest(models: list, features: int) -> RandomForestClassificationModel:
    """One forest of the trees of several, in their order."""
    spark = SparkSession.getActiveSession()
    jvm = spark._jvm.org.apache.spark.ml.classification
    trees = [t._java_obj for m in models for t in m.trees]
    listed = spark.sparkContext._gateway.new_array(jvm.DecisionTreeClassificationModel, len(trees))
    for i, t in enumerate(trees):
        listed[i] = t
    merged = RandomForestClassificationModel(jvm.RandomForestClassificationModel("merged", listed, features, 2))
    return merged.setFeaturesCol("features").setLeafCol(LEAVES)


def _one_by_one(prepared: DataFrame, params: ForestParams, trees: int, label: str, key: str, seed: int, parallelism):
    """A forest of trees that `spark.ml` has fitted one by one with hashed draws."""
    def one_tree(b: int):
        weighted = prepared.withColumn("bag_weight", poisson_weight(F.col(key), seed, b)).filter("bag_weight > 0")
        return RandomForestClassifier(
            featuresCol="features", labelCol=label, weightCol="bag_weight", numTrees=1, bootstrap=False,
            featureSubsetStrategy=str(params.mtry), minInstancesPerNode=params.min_node, maxDepth=params.max_depth,
            maxBins=params.max_bins, seed=seed + b,
        ).fit(weighted)

    with ThreadPoolExecutor(side_by_side(prepared, parallelism)) as pool:  # the trees' jobs run side by side
        models = list(pool.map(inheritable_thread_target(prepared.sparkSession)(one_tree), range(trees)))
    return merged_forest(models, models[0].numFeatures)


def out_of_bag(
    prepared: DataFrame, params: ForestParams, trees: int = 10, label: str = "churned", key: str = "client_id",
    levels: int = 0, seed: int = 123, parallelism: int | None = None,
) -> DataFrame:
    """Out-of-bag confusion and error: each row is voted on by the trees that did not draw it.

    The trees are grown side by side on hashed draws, each as `spark.ml` fits a single tree on those weights. Votes and
    draws of a row are two arrays over the trees, so the plan does not grow with their number and nothing is joined or
    regrouped.
    """
    need_bins(params.max_bins, levels)
    spark = prepared.sparkSession
    numbers = F.sequence(F.lit(0), F.lit(trees - 1))
    draws = F.transform(F.transform(numbers, lambda b: _uniform(F.col(key), seed, b)), lambda u: _poisson(u).cast("byte"))
    data = training_codes(prepared, label, draws, trees)
    if data is not None:
        path = grown_forest(spark, data, params, trees, seed)
        nodes = ForestNodes(spark, path=path)
        merged = None
        if nodes.bytes(1) > SENT:
            rf = forest(label, levels, seed, params.max_bins)
            merged = saved_forest(spark, path, rf.copy(_param_map(rf, replace(params, trees=trees))), len(data["arity"]))
    else:
        merged = _one_by_one(prepared, params, trees, label, key, seed, parallelism)
        nodes = ForestNodes(spark, merged)
    rows = with_shares(prepared, merged, nodes, {"shares": params.max_leaves}, label, key)
    outside = F.transform(numbers, lambda b: _uniform(F.col(key), seed, b) < math.exp(-1))
    votes = F.zip_with("shares", outside, lambda share, out: F.when(out, (share > 0.5).cast("int")))
    votes = F.filter(votes, lambda v: v.isNotNull())
    judged = rows.select(label, votes.alias("votes")).select(
        label, F.size("votes").alias("voters"), F.aggregate("votes", F.lit(0), lambda s, v: s + v).alias("yes"))
    predicted = F.col("yes") > F.col("voters") / 2
    cells = judged.filter("voters > 0").agg(
        F.count_if(predicted & (F.col(label) == 1)).alias("tp"),
        F.count_if(predicted & (F.col(label) == 0)).alias("fp"),
        F.count_if(~predicted & (F.col(label) == 1)).alias("fn"),
        F.count_if(~predicted & (F.col(label) == 0)).alias("tn"),
    )
    wrong, all_rows = F.col("fp") + F.col("fn"), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    return cells.withColumns({
        "oob_error": F.try_divide(wrong, all_rows),
        "class_error_no": F.try_divide(F.col("fp"), F.col("fp") + F.col("tn")),
        "class_error_yes": F.try_divide(F.col("fn"), F.col("fn") + F.col("tp")),
    })


def importance(model, names: list[str]) -> list[tuple[str, float]]:
    values = model.featureImportances.toArray()
    return sorted(((n, float(v)) for n, v in zip(names, values)), key=lambda p: (-p[1], p[0]))
