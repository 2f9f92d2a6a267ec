"""Decision tree with cost-complexity pruning.

Spark grows the tree. Pruning, its cross-validation, rules and importances work on the node table of the fitted
model. A node with fewer than `min_split` rows is a leaf: where Spark has split one, the table takes the split back,
which is the tree that would have been grown without it, since splits of other nodes do not depend on it. The pruned
tree is a column expression over the features (at most `max_leaves` leaves), so scoring needs neither the large tree nor
a join. A regression tree on the 0/1 label splits by p(1-p), which is Gini halved, and keeps sibling leaves of equal
class apart, so leaf probabilities stay sharp.
"""

from __future__ import annotations

import bisect
import heapq
import math
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, fields

from pyspark import inheritable_thread_target
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..params import TreeParams
from ..session import new_path

LEAF = "leaf"


@dataclass
class Node:
    id: int
    left: int
    right: int
    rows: float
    positives: float
    gain: float
    feature: int
    cuts: list[float]
    categories: int
    parent: int = -1
    leaf: int = -1
    last_leaf: int = -1
    collapse: float = math.inf

    @property
    def inner(self) -> bool:
        return self.left >= 0

    @property
    def risk(self) -> float:
        """Misclassified rows if this node were a leaf."""
        return min(self.positives, self.rows - self.positives)

    @property
    def probability(self) -> float:
        return self.positives / self.rows


@dataclass
class Tree:
    """Node table of a fitted tree, with the complexity at which each split is pruned away."""

    nodes: dict[int, Node]
    cp: float
    path: list[dict] = field(default_factory=list)

    @property
    def root(self) -> Node:
        return self.nodes[0]

    def splits_at(self, cp: float) -> list[Node]:
        """Splits that survive pruning at `cp`."""
        kept, queue = [], [self.root]
        while queue:
            node = queue.pop()
            if node.inner and node.collapse > cp:
                kept.append(node)
                queue += [self.nodes[node.right], self.nodes[node.left]]
        return kept

    def leaves_at(self, cp: float) -> list[Node]:
        found, queue = [], [self.root]
        while queue:
            node = queue.pop()
            if node.inner and node.collapse > cp:
                queue += [self.nodes[node.right], self.nodes[node.left]]
            else:
                found.append(node)
        return found

    def ancestors(self, node: Node) -> list[Node]:
        """The node and all above it."""
        chain = [node]
        while chain[-1].parent >= 0:
            chain.append(self.nodes[chain[-1].parent])
        return chain


def need_bins(max_bins: int, levels: int) -> None:
    """The number of bins is the caller's choice: it sets the thresholds of every numeric column."""
    if levels > max_bins:
        raise ValueError(f"max_bins is {max_bins}, but a category column has {levels} levels; raise max_bins")


def fit_tree(
    prepared: DataFrame, params: TreeParams, levels: int = 0, label: str = "churned", entropy: bool = False,
    seed: int = 123,
):
    """Grow the large tree on vectors `features`; `levels` is the largest number of category levels.

    The smallest leaf is `min_bucket` whatever the number of rows; `node_table` applies `min_split`.
    """
    need_bins(params.max_bins, levels)
    options = dict(
        featuresCol="features", labelCol=label, leafCol=LEAF, maxDepth=params.max_depth,
        maxBins=params.max_bins, minInstancesPerNode=params.min_bucket, seed=seed,
    )
    if entropy:
        return DecisionTreeClassifier(impurity="entropy", **options).fit(prepared)
    return DecisionTreeRegressor(**options).fit(prepared)


def node_table(spark: SparkSession, model, min_split: int = 0) -> dict[int, Node]:
    """The fitted tree's nodes, read from its saved form, without splits of nodes with fewer than `min_split` rows.

    `leaf` and `last_leaf` are the leaves of the fitted model (numbered from left to right, as in `leafCol`) that a leaf
    of the table stands for.
    """
    path = new_path(spark, "tree")
    model.write().save(path)
    saved = spark.read.parquet(f"{path}/data")
    nodes = {}
    for r in saved.select("id", "impurityStats", "gain", "leftChild", "rightChild", "split").collect():
        stats = r["impurityStats"]
        rows, positives = (stats[0], stats[1]) if len(stats) == 3 else (stats[0] + stats[1], stats[1])
        s = r["split"]
        nodes[r["id"]] = Node(
            r["id"], r["leftChild"], r["rightChild"], rows, positives, r["gain"], s["featureIndex"],
            list(s["leftCategoriesOrThreshold"]), s["numCategories"],
        )
    return without_small_splits(nodes, min_split)


def without_small_splits(nodes: dict[int, Node], min_split: int) -> dict[int, Node]:
    """Number the leaves, link parents, and turn each node with fewer than `min_split` rows into a leaf."""
    leaf = 0
    for i in sorted(nodes):  # numbered from the root down, the left side first
        node = nodes[i]
        if node.inner:
            nodes[node.left].parent = nodes[node.right].parent = i
        else:
            node.leaf = node.last_leaf = leaf
            leaf += 1
    for i in sorted(nodes, reverse=True):
        node = nodes[i]
        if node.inner:
            node.leaf, node.last_leaf = nodes[node.left].leaf, nodes[node.right].last_leaf
    kept, queue = {}, [0]
    while queue:
        i = queue.pop()
        node = kept[i] = nodes[i]
        if node.inner and node.rows < min_split:
            node.left = node.right = -1
        if node.inner:
            node.leaf = node.last_leaf = -1
            queue += [node.right, node.left]
    return kept


def weakest_links(nodes: dict[int, Node], cp: float) -> Tree:
    """Mark each split with the complexity, relative to the root's risk, that prunes it (Breiman et al. 1984).

    The weakest split is the one that saves the least risk per leaf; taking it out changes only its ancestors.
    """
    risk, leaves, version = {}, {}, dict.fromkeys(nodes, 0)
    for i in sorted(nodes, reverse=True):
        n = nodes[i]
        risk[i] = risk[n.left] + risk[n.right] if n.inner else n.risk
        leaves[i] = leaves[n.left] + leaves[n.right] if n.inner else 1

    def strength(i: int) -> float:
        return (nodes[i].risk - risk[i]) / (leaves[i] - 1)

    heap = [(strength(i), i, 0) for i, n in nodes.items() if n.inner]
    heapq.heapify(heap)
    scale, alpha, done = nodes[0].risk or 1.0, 0.0, set()
    while heap:
        value, i, seen = heapq.heappop(heap)
        if i in done or seen != version[i]:
            continue
        alpha = max(alpha, value)
        queue = [i]
        while queue:
            j = queue.pop()
            if nodes[j].inner and j not in done:
                done.add(j)
                nodes[j].collapse = alpha / scale
                queue += [nodes[j].left, nodes[j].right]
        lost_risk, lost_leaves = nodes[i].risk - risk[i], leaves[i] - 1
        risk[i], leaves[i] = nodes[i].risk, 1
        up = nodes[i].parent
        while up >= 0:
            risk[up] += lost_risk
            leaves[up] -= lost_leaves
            version[up] += 1
            heapq.heappush(heap, (strength(up), up, version[up]))
            up = nodes[up].parent
    tree = Tree(nodes, cp)
    tree.path = complexity_path(tree)
    return tree


def complexity_path(tree: Tree) -> list[dict]:
    """One row per nested subtree: complexity, splits, leaves and error relative to the root's."""
    inner = sorted((n for n in tree.nodes.values() if n.inner and n.collapse > tree.cp), key=lambda n: -n.collapse)
    points = sorted({n.collapse for n in inner}, reverse=True) + [tree.cp]
    gained = {}
    for n in inner:
        saved = n.risk - tree.nodes[n.left].risk - tree.nodes[n.right].risk
        splits, total = gained.get(n.collapse, (0, 0.0))
        gained[n.collapse] = (splits + 1, total + saved)
    rows, splits, risk = [], 0, tree.root.risk
    for point, above in zip(points, [math.inf, *points]):
        if above in gained:
            splits, risk = splits + gained[above][0], risk - gained[above][1]
        rows.append({"cp": point, "splits": splits, "leaves": splits + 1, "rel_error": risk / (tree.root.risk or 1.0)})
    return rows


def leaf_limit_cp(path: list[dict], max_leaves: int) -> float:
    """Complexity of the largest subtree with at most `max_leaves` leaves."""
    fitting = [r for r in path if r["leaves"] <= max_leaves]
    return max(fitting, key=lambda r: r["leaves"])["cp"]


def fold_errors(tree: Tree, leaf_counts: list[tuple[int, int, int]], cps: list[float]) -> list[float]:
    """Error on held-out rows at every complexity, from (leaf, positives, negatives) counts alone.

    Walking up from a leaf, each ancestor answers for the complexities between its own pruning point and that of
    the split above it; the intervals are added up over ascending complexities.
    """
    ascending = sorted(cps)
    steps, total = [0.0] * (len(ascending) + 1), 0
    by_leaf = {k: n for n in tree.nodes.values() if not n.inner for k in range(n.leaf, n.last_leaf + 1)}
    for leaf, positives, negatives in leaf_counts:
        total += positives + negatives
        upper = math.inf
        # From the root down: below the split's own pruning point the rows pass on to its child.
        for node in reversed(tree.ancestors(by_leaf[leaf])):
            lower = node.collapse if node.inner else -math.inf
            if lower < upper:
                first, last = bisect.bisect_left(ascending, lower), bisect.bisect_left(ascending, upper)
                wrong = negatives if node.probability > 0.5 else positives
                steps[first] += wrong
                steps[last] -= wrong
                upper = lower
    errors, running = {}, 0.0
    for cp, step in zip(ascending, steps):
        running += step
        errors[cp] = running / total if total else 0.0
    return [errors[cp] for cp in cps]


def cross_validate(
    spark: SparkSession, prepared: DataFrame, cps: list[float], folds: int, params: TreeParams,
    levels: int = 0, label: str = "churned", seed: int = 123, parallelism: int = 5,
) -> list[dict]:
    """Mean and deviation of the error per complexity: one fit per fold serves all complexities.

    The folds' jobs are submitted side by side, so one fold's last tasks do not leave the cluster idle.
    """

    def one_fold(k: int) -> list[float]:
        model = fit_tree(
            prepared.filter(F.col("fold") != k), params, levels, label, seed=seed
        )
        tree = weakest_links(node_table(spark, model, params.min_split), 0.0)
        counts = (
            model.transform(prepared.filter(F.col("fold") == k))
            .groupBy(LEAF)
            .agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
            .collect()  # one row per leaf
        )
        return fold_errors(tree, [(int(r[LEAF]), r["pos"], r["neg"]) for r in counts], cps)

    with ThreadPoolExecutor(max_workers=parallelism) as pool:
        per_fold = list(pool.map(inheritable_thread_target(spark)(one_fold), range(folds)))
    table = []
    for i, cp in enumerate(cps):
        errors = [e[i] for e in per_fold]
        mean = sum(errors) / folds
        deviation = math.sqrt(sum((e - mean) ** 2 for e in errors) / (folds - 1)) if folds > 1 else None
        table.append({"cp": cp, "mean_error": mean, "sd_error": deviation})
    return table


@dataclass
class PrunedNode:
    """A node of a pruned tree with the names of the table it is applied to; a leaf has no column.

    A number goes left up to `cut`; categories go to the side that lists them, and `others_left` says where unknown and
    missing ones go.
    """

    node: int
    left: int
    right: int
    column: str | None
    cut: float | None
    left_values: list[str] | None
    right_values: list[str] | None
    others_left: bool
    probability: float


PRUNED_SCHEMA = (
    "node int, left int, right int, column string, cut double, left_values array<string>, "
    "right_values array<string>, others_left boolean, probability double"
)


def pruned_nodes(tree: Tree, cp: float, names: list[str], levels: dict[str, list[str]]) -> list[PrunedNode]:
    """The nodes that survive pruning at `cp`, from the root down."""
    found = []
    splits = {n.id for n in tree.splits_at(cp)}
    for n in sorted([*tree.splits_at(cp), *tree.leaves_at(cp)], key=lambda n: n.id):
        if n.id not in splits:
            found.append(PrunedNode(n.id, -1, -1, None, None, None, None, False, float(n.probability)))
        elif n.categories < 0:
            found.append(PrunedNode(n.id, n.left, n.right, names[n.feature], float(n.cuts[0]), None, None,
                                    False, float(n.probability)))
        else:
            known, left = levels[names[n.feature]], {int(c) for c in n.cuts}
            sides = [[v for i, v in enumerate(known) if (i in left) == side] for side in (True, False)]
            found.append(PrunedNode(n.id, n.left, n.right, names[n.feature], None, *sides, len(known) in left,
                                    float(n.probability)))
    return found


def pruned_from_rows(rows: list[Row]) -> list[PrunedNode]:
    return [PrunedNode(*(r[f.name] for f in fields(PrunedNode))) for r in sorted(rows, key=lambda r: r["node"])]


def leaf_column(pruned: list[PrunedNode], suffix: str = "_index") -> Column:
    """The leaf of a row as struct(node, probability): nested conditions over the table's own columns.

    A missing number goes right; the plans fill numbers before this.
    """
    by_id = {n.node: n for n in pruned}

    def below(n: PrunedNode) -> Column:
        if n.column is None:
            return F.struct(F.lit(n.node).alias("node"), F.lit(n.probability).alias("probability"))
        if n.cut is not None:
            left = F.col(n.column).cast("double") <= F.lit(n.cut)
        else:
            column = F.col(n.column.removesuffix(suffix))
            listed = n.right_values if n.others_left else n.left_values
            there = F.coalesce(column.isin(listed), F.lit(False)) if listed else F.lit(False)
            left = ~there if n.others_left else there
        return F.when(left, below(by_id[n.left])).otherwise(below(by_id[n.right]))

    return below(pruned[0])


def predict_tree(df: DataFrame, pruned: list[PrunedNode], *keep: str) -> DataFrame:
    """Node, probability and class of each row; an even leaf stays. A projection: nothing is joined or shuffled."""
    placed = df.select(*keep, leaf_column(pruned).alias("leaf"))
    return placed.select(
        *keep, "leaf.node", "leaf.probability", (F.col("leaf.probability") > 0.5).cast("int").alias("predicted"))


def _condition(node: Node, went_left: bool, names: list[str], levels: dict[str, list[str]]) -> str:
    name = names[node.feature]
    if node.categories < 0:
        return f"{name} {'<=' if went_left else '>'} {node.cuts[0]:g}"
    known = levels.get(name, [])
    shown = [known[int(c)] if int(c) < len(known) else "(other)" for c in sorted(node.cuts)]
    return f"{name} {'in' if went_left else 'not in'} {{{', '.join(shown)}}}"


def rules(
    spark: SparkSession, tree: Tree, cp: float, names: list[str], levels: dict[str, list[str]]
) -> DataFrame:
    """One row per leaf of the pruned tree: its conditions, probability and share of the training rows."""
    rows = []
    for leaf in tree.leaves_at(cp):
        chain = tree.ancestors(leaf)[::-1]
        parts = [_condition(a, b.id == a.left, names, levels) for a, b in zip(chain, chain[1:])]
        rows.append((leaf.id, " and ".join(parts) or "always", float(leaf.probability), leaf.rows / tree.root.rows))
    return spark.createDataFrame(rows, "node int, rule string, probability double, cover double").orderBy(
        "probability", "node"
    )


def importance(tree: Tree, cp: float, names: list[str]) -> list[tuple[str, float]]:
    """Impurity decrease of the surviving splits per variable, as shares, largest first."""
    totals: dict[str, float] = {}
    for n in tree.splits_at(cp):
        totals[names[n.feature]] = totals.get(names[n.feature], 0.0) + n.gain * n.rows
    whole = sum(totals.values()) or 1.0
    return sorted(((v, t / whole) for v, t in totals.items()), key=lambda p: (-p[1], p[0]))
