"""Models on a planted signal; pruning and inflation against direct computation."""

import dataclasses
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.linalg import Vectors
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import functions as F

import registry
from ebbtide.operators import evaluation, forests, growth, logistic, sampling, screening, trees
from ebbtide.operators.encoding import dummy_columns, linear_inputs, tree_inputs
from ebbtide.params import ForestParams, LogisticParams, TreeParams, forest_grid
from ebbtide.session import materialise, new_path


def uniform(name):
    return (F.xxhash64("client_id", F.lit(name)) % 100000 + 100000) / 200000


@pytest.fixture(scope="module")
def planted(spark):
    """Leaving depends on a (up), b (down) and group g1 (up); c is noise; d copies a; e is nearly b."""
    base = spark.range(1500).select(F.col("id").alias("client_id"))
    base = base.withColumns({n: uniform(n) for n in "abc"})
    base = base.withColumn("group", F.concat(F.lit("g"), (F.col("client_id") % 3).cast("string")))
    logit = 5 * F.col("a") - 4 * F.col("b") + F.when(F.col("group") == "g1", 1.5).otherwise(0) - 0.8
    df = base.withColumns({
        "d": F.col("a") * 2, "e": F.col("b") + uniform("e") * 0.05,
        "churned": (uniform("y") < 1 / (1 + F.exp(-logit))).cast("int"),
    })
    folded = sampling.stratified_folds(df, 1, 3)
    return materialise(folded, "planted")


@pytest.fixture(scope="module")
def vectors(planted):
    pipeline = tree_inputs(["a", "b", "c"], ["group"]).fit(planted)
    return materialise(pipeline.transform(planted).select("client_id", "churned", "fold", "features"), "vectors")


@pytest.fixture(scope="module")
def grown(spark, vectors):
    params = TreeParams(max_depth=8)
    model = trees.fit_tree(vectors, params, 4)
    return model, trees.weakest_links(trees.node_table(spark, model, params.min_split), params.cp), params


def test_nodes_add_up(grown):
    _, tree, _ = grown
    for n in tree.nodes.values():
        if n.inner:
            left, right = tree.nodes[n.left], tree.nodes[n.right]
            assert n.rows == left.rows + right.rows and n.positives == left.positives + right.positives
            assert min(left.rows, right.rows) >= 7 and n.rows >= 15
            assert n.collapse >= max(left.collapse if left.inner else 0, right.collapse if right.inner else 0)


def slow_path(tree):
    """Weakest-link pruning, recomputed from scratch at each step."""
    pruned, rows = set(), []

    def branch(i):
        n = tree.nodes[i]
        if not n.inner or i in pruned:
            return n.risk, 1
        (a, x), (b, y) = branch(n.left), branch(n.right)
        return a + b, x + y

    def alive(i):
        n = tree.nodes[i]
        return [] if not n.inner or i in pruned else [i, *alive(n.left), *alive(n.right)]

    alpha = 0.0
    while alive(0):
        strengths = {i: (tree.nodes[i].risk - branch(i)[0]) / (branch(i)[1] - 1) for i in alive(0)}
        alpha = max(alpha, min(strengths.values()))
        while alive(0):
            strengths = {i: (tree.nodes[i].risk - branch(i)[0]) / (branch(i)[1] - 1) for i in alive(0)}
            weak = [i for i, g in strengths.items() if g <= alpha]
            if not weak:
                break
            pruned.update(weak)
        risk, leaves = branch(0)
        rows.append((alpha / tree.root.risk, leaves, risk / tree.root.risk))
    return rows[::-1]


def test_complexity_path_matches_step_by_step_pruning(grown):
    _, tree, _ = grown
    expected = [r for r in slow_path(tree) if r[0] > tree.cp]
    got = [(r["cp"], r["leaves"], r["rel_error"]) for r in tree.path[:-1]]
    assert len(got) == len(expected) > 3
    for g, e in zip(got, expected):
        assert g[1] == e[1] and g[0] == pytest.approx(e[0]) and g[2] == pytest.approx(e[2])


def leaf_map(spark, tree, cp):
    """Leaf of the fitted model -> node and probability of the pruned tree."""
    rows = []
    for node in tree.leaves_at(cp):
        queue = [node]
        while queue:
            n = queue.pop()
            queue += [tree.nodes[n.left], tree.nodes[n.right]] if n.inner else []
            rows += [] if n.inner else [(float(k), node.id, float(node.probability)) for k in range(n.leaf, n.last_leaf + 1)]
    return spark.createDataFrame(rows, "leaf double, node int, probability double")


NAMES, LEVELS = ["a", "b", "c", "group_index"], {"group_index": ["g0", "g1", "g2"]}


def test_pruned_predictions(spark, planted, vectors, grown):
    model, tree, _ = grown
    for cp in (trees.leaf_limit_cp(tree.path, 6), tree.path[-1]["cp"]):
        pruned = trees.pruned_nodes(tree, cp, NAMES, LEVELS)
        scored = trees.predict_tree(planted, pruned, "client_id", "churned")
        plan = scored._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and "Exchange" not in plan
        want = model.transform(vectors).join(leaf_map(spark, tree, cp), "leaf")
        both = scored.select("client_id", "node").join(want.select("client_id", F.col("node").alias("wanted")), "client_id")
        assert both.where("node = wanted").count() == 1500
        seen = {r[0]: r[1:] for r in scored.groupBy("node").agg(
            F.count("*"), F.sum("churned"), F.max("probability")).collect()}
        for leaf in tree.leaves_at(cp):
            rows, positives, probability = seen[leaf.id]
            assert (rows, positives) == (leaf.rows, leaf.positives) and probability == pytest.approx(leaf.probability)
        saved = spark.createDataFrame([dataclasses.astuple(n) for n in pruned], trees.PRUNED_SCHEMA)
        assert trees.pruned_from_rows(saved.collect()) == pruned


def test_unknown_categories_and_missing_numbers_go_as_in_the_fitted_model(spark, planted, vectors, grown):
    model, tree, _ = grown
    pipeline = tree_inputs(["a", "b", "c"], ["group"]).fit(planted)
    odd = spark.createDataFrame([(k, x / 7, 1 - x / 7, 0.5, g) for k, (x, g) in enumerate(
        (x, g) for x in range(8) for g in ("g0", "g1", "g2", "new", None))],
        "client_id long, a double, b double, c double, group string")
    scored = trees.predict_tree(odd, trees.pruned_nodes(tree, 0.0, NAMES, LEVELS), "client_id")
    want = model.transform(pipeline.transform(odd)).join(leaf_map(spark, tree, 0.0), "leaf")
    both = scored.select("client_id", "node").join(want.select("client_id", F.col("node").alias("wanted")), "client_id")
    assert both.count() == 40 and both.where("node != wanted").count() == 0


def test_nodes_below_the_smallest_split_stay_leaves(spark):
    """14 rows of two classes, split 7 to 7 by Spark, are one leaf; with 15 the split stays."""
    for n, leaves in ((14, 1), (15, 2)):
        rows = [(Vectors.dense([float(k)]), int(k >= 7)) for k in range(n)]
        table = spark.createDataFrame(rows, ["features", "churned"])
        model = trees.fit_tree(table, TreeParams())
        assert model.numNodes == 3
        tree = trees.weakest_links(trees.node_table(spark, model, 15), 0.0)
        assert len(tree.leaves_at(0.0)) == leaves
        assert (tree.root.leaf, tree.root.last_leaf) == ((0, 1) if leaves == 1 else (-1, -1))
        # as one leaf (7 of 14 left) everyone is taken to stay; split, each side has its own class
        wrong = trees.fold_errors(tree, [(0, 3, 1), (1, 1, 5)], [0.0])[0]
        assert wrong == pytest.approx(4 / 10 if leaves == 1 else (3 + 5) / 10)


def test_small_nodes_inside_a_tree(grown, spark, vectors):
    """Taking splits back leaves the rest of the tree as it was, and the leaves of the model are all answered for."""
    model, _, params = grown
    every = trees.node_table(spark, model)
    limited = trees.node_table(spark, model, 60)
    assert all(n.rows >= 60 for n in limited.values() if n.inner)
    assert {i for i, n in every.items() if n.inner and n.rows >= 60} == {i for i, n in limited.items() if n.inner}
    covered = sorted(k for n in limited.values() if not n.inner for k in range(n.leaf, n.last_leaf + 1))
    assert covered == list(range(sum(not n.inner for n in every.values())))
    tree = trees.weakest_links(limited, 1e-4)
    assert [r["leaves"] for r in tree.path[:-1]] == [r[1] for r in slow_path(tree) if r[0] > tree.cp]


def test_fold_errors_match_predictions(spark, planted, vectors, grown):
    model, tree, _ = grown
    held = vectors.filter("fold = 0")
    counts = model.transform(held).groupBy("leaf").agg(F.sum("churned"), F.sum(1 - F.col("churned"))).collect()
    cps = [r["cp"] for r in tree.path]
    got = trees.fold_errors(tree, [(int(r[0]), r[1], r[2]) for r in counts], cps)
    for cp, error in list(zip(cps, got))[::3]:
        pruned = trees.pruned_nodes(tree, cp, NAMES, LEVELS)
        scored = trees.predict_tree(planted.filter("fold = 0"), pruned, "churned")
        assert error == pytest.approx(scored.agg(F.avg((F.col("predicted") != F.col("churned")).cast("int"))).first()[0])


def test_cross_validation_finds_signal(spark, vectors, grown):
    _, tree, params = grown
    cv = trees.cross_validate(spark, vectors, [r["cp"] for r in tree.path], 3, params, 4)
    assert min(r["mean_error"] for r in cv) < 0.35 and all(r["sd_error"] >= 0 for r in cv)


def test_rules_cover_everything(spark, grown):
    _, tree, _ = grown
    got = trees.rules(spark, tree, trees.leaf_limit_cp(tree.path, 6), ["a", "b", "c", "group"], {"group": ["g0", "g1", "g2"]}).collect()
    assert sum(r["cover"] for r in got) == pytest.approx(1) and any("a " in r["rule"] for r in got)


def test_importance_finds_the_drivers(grown, vectors):
    _, tree, _ = grown
    assert {v for v, _ in trees.importance(tree, 0.01, ["a", "b", "c", "group"])[:2]} == {"a", "b"}


@pytest.fixture(scope="module")
def forest_model(vectors):
    return forests.fit_forest(vectors.filter("fold != 0"), ForestParams(2, 12, max_depth=7), levels=4)


def plain_cut(tree, most):
    """Best-first splits one by one; returns {leaf of the whole tree: share}."""
    rows = lambda i: tree["no"][i] + tree["yes"][i]
    kept = [0]
    while len(kept) < most:
        open_ = [i for i in kept if tree["left"][i] >= 0]
        if not open_:
            break
        best = max(open_, key=lambda i: (tree["gain"][i] * rows(i), -i))
        kept.remove(best)
        kept += [int(tree["left"][best]), int(tree["right"][best])]
    answer = {}
    for node in kept:
        stack = [node]
        while stack:
            i = stack.pop()
            if tree["left"][i] >= 0:
                stack += [int(tree["left"][i]), int(tree["right"][i])]
            else:
                answer[i] = tree["yes"][node] / rows(node)
    leaves = [i for i in range(len(tree["left"])) if tree["left"][i] < 0]
    return [answer[i] for i in leaves], len(kept)


def test_limit_on_leaves(spark, forest_model):
    nodes = forests.ForestNodes(spark, forest_model)
    assert len(nodes.trees) == 12
    for limit in (1, 2, 5, 17, None):
        for tree, shares in zip(nodes.trees, nodes.shares(limit)):
            want, n = plain_cut(tree, limit or 10**9)
            assert shares.tolist() == pytest.approx(want) and (limit is None or n <= limit)


def test_one_fit_answers_for_smaller_forests(spark, vectors, forest_model):
    held = vectors.filter("fold = 0")
    grid = [ForestParams(2, t, max_leaves=k, max_depth=7) for t in (1, 5, 12) for k in (None, 4, 10)]
    got = forests.nested_accuracy(forest_model, held, grid)
    nodes = forests.ForestNodes(spark, forest_model)
    rows = forest_model.transform(held).select("churned", "leaves").collect()
    for p, accuracy in zip(grid, got):
        shares = nodes.shares(p.max_leaves)
        right = [(np.mean([shares[t][int(r["leaves"][t])] for t in range(p.trees)]) > 0.5) == (r["churned"] == 1) for r in rows]
        assert accuracy == pytest.approx(np.mean(right))
    alone = forests.fit_forest(vectors.filter("fold != 0"), ForestParams(2, 5, max_depth=7), levels=4)
    assert [t.toDebugString for t in alone.trees] != [] and len(alone.trees) == 5
    whole = forests.with_probability(forest_model, held, "client_id").withColumnRenamed("probability", "p")
    same = forests.with_probability(forest_model, held, "client_id", max_leaves=10**6).join(whole, "client_id")
    assert same.where("abs(p - probability) > 1e-9").count() == 0


def test_leaf_shares_are_joined_leaf_by_leaf(spark, vectors, forest_model):
    held = vectors.filter("fold = 0")
    rows = forests._leaves_only(forest_model, held, "client_id")
    shares = forests.ForestNodes(spark, forest_model).shares(5)
    got = forests._with_shares(rows.unionAll(rows), {"s": shares})
    plan = got._sc._jvm.PythonSQLUtils.explainString(got._jdf.queryExecution(), "extended")
    assert "array<array" not in plan and "Join Inner, ((tree" in plan  # no row that holds the whole model
    want = sorted((r["client_id"], [float(shares[t][int(i)]) for t, i in enumerate(r["leaves"])]) for r in rows.collect())
    assert sorted((r["client_id"], r["s"]) for r in got.collect()) == sorted(want + want)


def test_rows_go_down_the_trees_without_a_join(spark, vectors, forest_model, monkeypatch):
    held = vectors.filter("fold = 0")
    nodes = forests.ForestNodes(spark, forest_model)
    assert any(t["by_set"].any() for t in nodes.trees) and not all(t["by_set"].all() for t in nodes.trees)
    limits = {"whole": None, "five": 5}
    monkeypatch.setattr(forests, "SLICE", 36)  # three rows at once
    got = forests.with_shares(held, forest_model, nodes, limits, "client_id", "churned")
    plan = got._sc._jvm.PythonSQLUtils.explainString(got._jdf.queryExecution(), "extended")
    assert "Join" not in plan and "Aggregate" not in plan and "Exchange" not in plan
    joined = forests.with_shares(held, forest_model, nodes, limits, "client_id", "churned", most=0)
    assert got.count() == held.count() and got.exceptAll(joined).isEmpty() and joined.exceptAll(got).isEmpty()


def test_forest_fits_keep_node_ids_and_use_all_cores(spark, vectors):
    assert forests.forest().getCacheNodeIds()
    cores = spark.sparkContext.defaultParallelism
    assert forests.side_by_side(vectors) == max(4, min(16, cores)) and forests.side_by_side(vectors, 3) == 3


def test_forest(vectors):
    grid = [ForestParams(m, t, max_leaves=k, max_depth=5) for m in (2, 3) for t in (5, 10) for k in (None, 8)]
    scores, best, model = forests.grid_search(vectors, grid, 3, levels=4)
    assert len(scores) == 8 and min(scores) > 0.6 and best in grid
    scored = forests.with_probability(
        model, vectors, "churned", max_leaves=best.max_leaves).withColumnRenamed("probability", "score")
    assert evaluation.auc(scored).first()["auc"] > 0.8
    assert {v for v, _ in forests.importance(model, ["a", "b", "c", "group"])[:2]} == {"a", "b"}


def test_out_of_bag(vectors):
    got = forests.out_of_bag(vectors, ForestParams(2, max_depth=6), trees=8, levels=4).first()
    assert 0.15 < got["oob_error"] < 0.4
    assert 1300 < got["tp"] + got["fp"] + got["fn"] + got["tn"] <= 1500


def test_out_of_bag_votes_equal_those_of_single_trees(vectors):
    params = ForestParams(2, max_depth=4)
    votes = {}
    for b in range(4):
        drawn = vectors.withColumn("w", forests.poisson_weight(F.col("client_id"), 123, b))
        tree = RandomForestClassifier(
            labelCol="churned", weightCol="w", numTrees=1, bootstrap=False, featureSubsetStrategy="2", maxDepth=4,
            minInstancesPerNode=1, maxBins=params.max_bins, seed=123 + b).fit(drawn.filter("w > 0"))
        for r in tree.transform(drawn.filter("w = 0")).select("client_id", "churned", "prediction").collect():
            votes.setdefault((r["client_id"], r["churned"]), []).append(r["prediction"])
    cells = Counter((c, sum(v) > len(v) / 2) for (_, c), v in votes.items())
    got = forests.out_of_bag(vectors, params, trees=4, levels=4).first()
    assert (got["tp"], got["fp"], got["fn"], got["tn"]) == (
        cells[1, True], cells[0, True], cells[1, False], cells[0, False])


def saved_tree(spark, path):
    """Nodes of a saved tree; a leaf's impurity is left out, which spark.ml sets to -1 where no split was allowed."""
    found = []
    for r in spark.read.parquet(f"{path}/data").select("nodeData.*").orderBy("id").collect():
        split = r["split"]
        found.append((r["id"], r["prediction"], tuple(r["impurityStats"]), r["rawCount"], r["gain"], r["leftChild"], r["rightChild"],
                      split["featureIndex"], sorted(split["leftCategoriesOrThreshold"]), split["numCategories"]))
    return found


@pytest.mark.parametrize("tries, min_node, depth", [(2, 1, 30), (3, 5, 30), (4, 10, 30), (1, 2, 4)])
def test_a_grown_tree_is_the_one_that_spark_fits(spark, vectors, tries, min_node, depth):
    weight = (F.abs(F.xxhash64("client_id", F.lit("w"))) % 4).cast("double")
    fitted = RandomForestClassifier(
        labelCol="churned", weightCol="w", numTrees=1, bootstrap=False, featureSubsetStrategy=str(tries), maxDepth=depth,
        minInstancesPerNode=min_node, maxBins=128, seed=7).fit(vectors.withColumn("w", weight).filter("w > 0"))
    saved = new_path(spark, "one-tree")
    fitted.write().save(saved)
    params = ForestParams(tries, 1, min_node=min_node, max_depth=depth)
    data = forests.training_codes(vectors, "churned", F.array(weight.cast("byte")), 1)
    grown = saved_tree(spark, forests.grown_forest(spark, data, params, 1, 7))
    assert grown == saved_tree(spark, saved) and (depth == 4 or len(grown) > 50)
    assert any(n[9] == 4 for n in grown)  # a split by categories


def test_fits_of_the_grid_are_whole_fits(spark, vectors):
    """A task's scores are those of a model that is fitted on the other folds and judged as a model is."""
    grid = [ForestParams(2, t, r, s, k, max_depth=8) for r in (0.6, 1.0) for s in (1, 5) for t in (3, 40) for k in (None, 6)]
    got = forests.grid_scores(vectors, grid, 3, levels=4)
    want = np.zeros(len(grid))
    for fold in range(3):
        rest, held = vectors.filter(F.col("fold") != fold), vectors.filter(F.col("fold") == fold)
        for first in range(0, len(grid), 4):
            members = grid[first:first + 4]
            model = forests.fit_forest(rest, members[-1], levels=4)
            want[first:first + 4] += np.array(forests.nested_accuracy(model, held, members)) / 3
    assert got == pytest.approx(want)


def test_forests_do_not_depend_on_partitions_and_copies_are_drawn(spark, vectors):
    copied = vectors.unionAll(vectors.filter("churned = 1"))
    a = forests.training_codes(copied, "churned")
    b = forests.training_codes(copied.repartition(7, "features"), "churned")
    assert all(np.array_equal(a[c], b[c]) for c in ("codes", "label", "fold", "copies"))
    assert len(a["copies"]) == vectors.count() and a["copies"].sum() == copied.count()
    drawn = np.array([growth.bag(a["copies"], 0.7, 1, t) for t in range(200)])
    assert drawn.mean(axis=0) == pytest.approx(0.7 * a["copies"], abs=0.4)
    assert drawn.sum() / 200 == pytest.approx(0.7 * copied.count(), rel=0.02)
    trees = growth.grow(growth.Bins(a, a["copies"], 32), a["label"], drawn[:3], np.arange(3), 2, 4, 30)
    for t, w in zip(trees, drawn):
        leaf = t["left"] < 0
        assert t["no"][0] + t["yes"][0] == w.sum() == t["rows"][0] and min(t["rows"][leaf]) >= 4


def test_larger_tables_are_fitted_by_passes(spark, vectors, monkeypatch):
    grid = [ForestParams(2, t, max_depth=5) for t in (3, 9)]
    params = ForestParams(2, max_depth=5, max_leaves=9)
    sent, votes = forests.grid_scores(vectors, grid, 3, levels=4), forests.out_of_bag(vectors, params, trees=5, levels=4).first()
    monkeypatch.setattr(forests, "GROWN", 0)
    assert forests.training_codes(vectors, "churned") is None
    assert forests.grid_scores(vectors, grid, 3, levels=4) == pytest.approx(sent, abs=0.05)
    assert forests.out_of_bag(vectors, params, trees=5, levels=4).first() == votes


def test_registered_forests_are_the_whole_grid():
    grid = registry.FITS.forests
    assert set(grid) == set(forest_grid(33)) and len(grid) == 324
    assert {p.trees for p in grid} == {100, 300, 500} and {p.sample_rate for p in grid} == {0.6, 0.7, 0.8, 1.0}
    assert {p.min_node for p in grid} == {1, 5, 10}


def test_bag_weights_are_poisson(spark):
    df = spark.range(20000).withColumn("w", forests.poisson_weight(F.col("id"), 1, 0))
    row = df.agg(F.avg("w").alias("m"), F.avg((F.col("w") == 0).cast("int")).alias("zero")).first()
    assert row["m"] == pytest.approx(1, abs=0.03) and row["zero"] == pytest.approx(math.exp(-1), abs=0.02)


def test_screen_drops_duplicates(planted):
    kept, steps = screening.screen(planted, ["a", "b", "c", "d", "e"], 0.9)
    assert kept == ["c", "d", "e"]  # of each pair the earlier goes
    assert steps[0]["variable"] == "a" and steps[0]["kept"] == "d"
    assert screening.full_rank(planted, kept) and not screening.full_rank(planted, ["a", "d"])


def test_variance_screen(planted):
    assert screening.varying_columns(planted.withColumn("k", F.lit(1.0)), ["a", "k"]) == ["a"]


def fitted(planted, columns):
    data = linear_inputs(columns, []).fit(planted).transform(planted)
    model = logistic.fit_glm(data)
    return data, model


def test_glm_recovers_the_plant(planted):
    data, model = fitted(planted.withColumn("g1", (F.col("group") == "g1").cast("int")), ["a", "b", "c", "g1"])
    wald = {r["variable"]: r for r in logistic.wald_table(data, model, ["a", "b", "c", "g1"]).collect()}
    assert wald["a"]["coefficient"] == pytest.approx(5, abs=1) and wald["b"]["coefficient"] == pytest.approx(-4, abs=1)
    assert wald["g1"]["odds_ratio"] == pytest.approx(math.exp(wald["g1"]["coefficient"]))
    assert wald["a"]["significant"] and not wald["c"]["significant"]
    effects = {r["variable"]: r for r in logistic.effects(logistic.wald_table(data, model, ["a", "b", "c", "g1"])).collect()}
    assert effects["a"]["effect"] == "Factor de Riesgo" and effects["b"]["effect"] == "Factor Protector"
    assert effects["a"]["magnitude"] == "Alto" and effects["c"]["magnitude"] == "Bajo"
    assert logistic.glm_summary(data, model).first()["deviance"] > 0


def test_vif_matches_the_weighted_correlation_inverse(planted):
    columns = ["a", "b", "e", "c"]
    data, model = fitted(planted, columns)
    errors = model.summary.coefficientStandardErrors[:4]
    scored = model.transform(data)
    got = {r["variable"]: r["vif"] for r in screening.vif(scored, columns, errors)}
    p = scored.select(*columns, "prediction").toPandas()
    w, x = (p.prediction * (1 - p.prediction)).to_numpy(), p[columns].to_numpy()
    centred = x - np.average(x, axis=0, weights=w)
    cov = (centred * w[:, None]).T @ centred
    inverse = np.linalg.inv(cov / np.sqrt(np.outer(np.diag(cov), np.diag(cov))))
    for i, c in enumerate(columns):
        assert got[c] == pytest.approx(inverse[i, i], rel=1e-4)
    assert got["b"] > 5 > got["c"]


def test_lasso_path_is_that_of_a_cross_validator_in_few_parts(spark, vectors):
    params, lambdas = LogisticParams(max_iter=30), [0.1, 0.01]
    data = vectors.select("churned", "fold", "features").repartition(7)
    estimator = logistic._lasso("churned", params)
    found = CrossValidator(
        estimator=estimator, estimatorParamMaps=[{estimator.regParam: x} for x in lambdas], foldCol="fold", numFolds=3,
        evaluator=BinaryClassificationEvaluator(labelCol="churned", numBins=0)).fit(data)
    path = logistic.lasso_path(data, lambdas, 3, params)
    assert [r["mean_auc"] for r in path] == pytest.approx(found.avgMetrics)
    assert [math.sqrt(2) * r["se_auc"] for r in path] == pytest.approx(found.stdMetrics)
    assert logistic.few_parts(data, 1500).rdd.getNumPartitions() == 1
    assert logistic.few_parts(data, 1500, 2000).rdd.getNumPartitions() == 3
    with pytest.raises(ValueError, match="fold 3"):
        logistic.lasso_path(data, lambdas, 4, params)


def test_fold_models_are_optima_and_share_their_passes(spark, vectors, monkeypatch):
    params, lambdas = LogisticParams(), [0.003, 0.1, 0.02]
    data = vectors.select("churned", "fold", "features").repartition(3)
    passes, one_pass = [], logistic.fold_statistics
    monkeypatch.setattr(logistic, "fold_statistics", lambda *a: passes.append(1) or one_pass(*a))
    coefficients, intercepts = logistic.fold_models(data, lambdas, 3, params)
    assert len(passes) < 25  # for nine fits, each of which took a pass for every step before
    for f in range(3):
        train = data.filter(F.col("fold") != f)
        fits = [(p, float(intercepts[f, i]), coefficients[f, i].tolist()) for i, p in enumerate(lambdas)]
        assert max(logistic.lasso_residuals(train, fits)) < params.tolerance
        estimator = logistic._lasso("churned", params)
        for i, p in enumerate(lambdas):
            whole = estimator.fit(train, {estimator.regParam: p, estimator.tol: 1e-12, estimator.maxIter: 500})
            assert coefficients[f, i] == pytest.approx(whole.coefficients.toArray(), abs=1e-4)
            assert intercepts[f, i] == pytest.approx(whole.intercept, abs=1e-4)


def test_lasso_keeps_the_drivers(planted):
    params = LogisticParams(lambdas=5, max_iter=50)
    names = ["a", "b", "c"]
    data = linear_inputs(names, []).fit(planted).transform(planted)
    largest = logistic.largest_lambda(planted, names)
    lambdas = logistic.lambda_path(largest, params)
    assert lambdas[0] == largest and lambdas[-1] == pytest.approx(largest * 1e-3)
    path = logistic.lasso_path(data, lambdas, 3, params)
    chosen, kept = logistic.lasso_select(data, names, path, params)
    assert chosen >= max(path, key=lambda r: r["mean_auc"])["lambda"]
    assert {"a", "b"} <= {r["variable"] for r in kept}
    at_top = logistic._lasso("churned", params)
    assert at_top.fit(data, {at_top.regParam: largest * 1.001}).coefficients.numNonzeros() == 0


def lasso_data(planted):
    names = ["a", "b", "c", "k"]
    table = planted.withColumn("k", F.lit(2.0))
    return table, names, linear_inputs(names, []).fit(table).transform(table)


def test_gradients_of_several_models_in_one_pass(planted):
    _, names, data = lasso_data(planted)
    models = [(0.5, [0.0] * 4), (-1.0, [0.2, -0.3, 0.0, 0.4])]
    p = data.select(*names, "churned").toPandas()
    x, y = p[names].to_numpy(), p.churned.to_numpy()
    for got, (intercept, coefficients) in zip(logistic.gradients(data, models), models):
        errors = 1 / (1 + np.exp(-(intercept + x @ np.array(coefficients)))) - y
        assert got == pytest.approx([*(x * errors[:, None]).mean(axis=0), errors.mean()], abs=1e-12)


def test_screened_lasso_fits_are_optima_and_equal_whole_fits(planted):
    params = LogisticParams(lambdas=5)
    table, names, data = lasso_data(planted)
    lambdas = logistic.lambda_path(logistic.largest_lambda(table, names[:3]), params)[:3]
    fits = logistic.lasso_fits(data, lambdas, params)
    assert [f.penalty for f in fits] == lambdas and all(f.residual <= params.tolerance for f in fits)
    for f in fits:
        estimator = logistic._lasso("churned", params)
        whole = estimator.fit(data, {estimator.regParam: f.penalty, estimator.tol: params.tol})
        assert list(f.coefficients) == pytest.approx(whole.coefficients.toArray().tolist(), abs=1e-3)
        assert f.coefficients[3] == 0  # a constant column
    again = logistic.lasso_residuals(data, [(f.penalty, f.intercept, list(f.coefficients)) for f in fits])
    assert again == pytest.approx([f.residual for f in fits], abs=1e-9)
    moved = [(f.penalty, f.intercept + 0.5, list(f.coefficients)) for f in fits]
    assert min(logistic.lasso_residuals(data, moved)) > params.tolerance


def test_lasso_needs_both_classes(planted):
    _, _, data = lasso_data(planted.where("churned = 1"))
    with pytest.raises(ValueError):
        logistic.lasso_fits(data, [0.1], LogisticParams())


def test_one_standard_error_rule():
    path = [{"lambda": 3.0, "mean_auc": 0.70, "se_auc": 0.1}, {"lambda": 2.0, "mean_auc": 0.79, "se_auc": 0.1},
            {"lambda": 1.0, "mean_auc": 0.8, "se_auc": 0.02}]
    assert logistic.one_standard_error(path) == 2.0


def test_dummies_keep_all_levels_of_the_first_category(spark):
    df = spark.createDataFrame([(1, "p", "x", True), (2, "q", "y", False), (3, None, "z", True)],
                               "client_id long, province string, account_type string, sells_online boolean")
    wide = dummy_columns(df, {"province": ["p", "q"], "account_type": ["x", "y", "z"]})
    assert wide.columns == ["client_id", "sells_online", "province_p", "province_q", "account_type_y", "account_type_z"]
    assert [r["province_p"] for r in wide.orderBy("client_id").collect()] == [1.0, 0.0, 0.0]
