"""Classification trees grown in a task, from codes of the training rows; `forests.py` deals the trees to the tasks.

The splits are those of `spark.ml`: thresholds by counts, Gini, categories in the order of their leavers, the first of
equal gains, sibling leaves of one class merged, and the features to try at a node from the same draws. A tree on given
weights is node by node the tree that `RandomForestClassifier(numTrees=1, bootstrap=False)` fits with the same seed. What
differs is the work: a node costs by its rows (sorted codes), not by its bins, and trees grow together, a level at a time.

`register_pickle_by_value` lets executors run this without the package.
"""

from __future__ import annotations

import heapq
import sys

import numpy as np
from pyspark import cloudpickle

#: Entries (rows times trees) that grow or are judged together.
TOGETHER = 1 << 18
#: Nodes with at least as many rows are counted by bins, smaller ones by sorted codes.
COUNTED = 256
#: Weight and weight of leavers are summed in one number.
LEAVER_BITS = 26
LEAVER = 1 << LEAVER_BITS
PARTS = ("left", "right", "no", "yes", "rows", "gain", "feature", "cut", "by_set")

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def thresholds(values: np.ndarray, counts: np.ndarray, most: int) -> np.ndarray:
    """At most about `most` cuts between distinct ascending values, so that as many rows lie between two cuts."""
    middle = (values[:-1] + values[1:]) / 2.0
    if len(middle) <= most:
        return middle
    below = np.cumsum(counts)
    stride = below[-1] / (most + 1)
    nearer = below[:-1] + below[1:]  # over twice the target: the value before is nearer to it
    found, at, target = [], -1, stride
    while True:
        at = max(at + 1, int(np.searchsorted(nearer, 2 * target, side="right")))
        if at >= len(middle):
            return middle[found]
        found.append(at)
        target += stride


class Bins:
    """The rows as bins of each feature, cut by the distribution of the rows that count."""

    def __init__(self, data: dict, counts: np.ndarray, max_bins: int):
        codes, self.arity = data["codes"], np.asarray(data["arity"], np.int64)
        most = min(max_bins, int((data["copies"] * (counts > 0)).sum()))
        self.cuts, self.splits = [], np.zeros(len(self.arity), np.int64)
        used = counts > 0
        self.x = np.empty(codes.shape, np.uint8 if max(max_bins, int(self.arity.max(initial=0))) <= 256 else np.uint16)
        for j, values in enumerate(data["values"]):
            if self.arity[j]:
                self.cuts.append(None)
                self.splits[j] = self.arity[j] - 1
                self.x[:, j] = values.astype(np.int64)[codes[:, j]]
                continue
            held = np.bincount(codes[used, j], weights=counts[used], minlength=len(values))
            there = held > 0
            self.cuts.append(thresholds(values[there], held[there], most - 1))
            self.splits[j] = len(self.cuts[-1])
            self.x[:, j] = np.searchsorted(self.cuts[-1], values)[codes[:, j]]
        self.flat, self.features, self.listed = self.x.ravel(), codes.shape[1], bool(self.arity.any())
        self.bits = int(self.splits.max(initial=0)).bit_length()


def _mixed(h: np.ndarray, k: np.ndarray) -> np.ndarray:
    u = np.uint32
    k = k * u(0xCC9E2D51)
    k = ((k << u(15)) | (k >> u(17))) * u(0x1B873593)
    h = h ^ k
    return ((h << u(13)) | (h >> u(19))) * u(5) + u(0xE6546B64)


def _hashed(first: np.ndarray, second: np.ndarray, start: np.ndarray) -> np.ndarray:
    u = np.uint32
    h = _mixed(_mixed(start, first), second) ^ u(8)
    h = (h ^ (h >> u(16))) * u(0x85EBCA6B)
    h = (h ^ (h >> u(13))) * u(0xC2B2AE35)
    return h ^ (h >> u(16))


def drawn_features(seeds: np.ndarray, features: int, tries: int) -> np.ndarray:
    """For each seed a reservoir sample of the features, in the order of the reservoir, as `spark.ml` draws it."""
    out = np.tile(np.arange(tries, dtype=np.int64), (len(seeds), 1))
    u = np.uint64
    first, second = (seeds >> u(32)).astype(np.uint32).byteswap(), (seeds & u(0xFFFFFFFF)).astype(np.uint32).byteswap()
    low = _hashed(first, second, np.full(len(seeds), 0x3C074A61, np.uint32))
    state = (_hashed(first, second, low).astype(u) << u(32)) | low.astype(u)
    for seen in range(tries + 1, features + 1):
        drawn = []
        for bits in (26, 27):
            state = state ^ (state << u(21))
            state = state ^ (state >> u(35))
            state = state ^ (state << u(4))
            drawn.append(state & u((1 << bits) - 1))
        place = (((drawn[0] << u(27)) + drawn[1]).astype(np.float64) * 2.0**-53 * seen).astype(np.int64)
        taken = np.flatnonzero(place < tries)
        out[taken, place[taken]] = seen - 1
    return out


class Draws:
    """A stream of 64-bit numbers for each tree (the linear congruential generator of Java), many at once."""

    def __init__(self, seeds: np.ndarray):
        self.mask = np.uint64((1 << 48) - 1)
        self.state = (seeds.astype(np.uint64) ^ np.uint64(0x5DEECE66D)) & self.mask
        self.times, self.plus = np.ones(1, np.uint64), np.zeros(1, np.uint64)

    def _steps(self, n: int) -> None:
        while len(self.times) <= n:  # twice as many steps: those so far, then one more stretch of them
            one, eleven = np.uint64(0x5DEECE66D), np.uint64(0xB)
            last_times, last_plus = self.times[-1:] * one, self.plus[-1:] * one + eleven
            self.times = np.concatenate([self.times, self.times * last_times])
            self.plus = np.concatenate([self.plus, self.times[: len(self.plus)] * last_plus + self.plus])

    def next(self, tree: np.ndarray) -> np.ndarray:
        """The next number of its tree for each node; a tree's nodes are neighbours."""
        starts = _starts(tree)
        lengths = _lengths(starts, len(tree))
        place = np.arange(len(tree)) - np.repeat(starts, lengths)
        self._steps(2 * int(lengths.max()))
        state = self.state[tree]
        high, low = ((state * self.times[i] + self.plus[i] & self.mask) >> np.uint64(16) for i in (2 * place + 1, 2 * place + 2))
        last = 2 * lengths
        self.state[tree[starts]] = self.state[tree[starts]] * self.times[last] + self.plus[last] & self.mask
        signed = (low.astype(np.uint32).astype(np.int32)).astype(np.int64)
        return (high << np.uint64(32)) + signed.astype(np.uint64)


def gini(no: np.ndarray, yes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    a, b = no / rows, yes / rows
    a *= a
    b *= b
    np.subtract(1.0, a, out=a)
    a -= b
    return a


def _gains(left: np.ndarray, left_yes: np.ndarray, rows, yes, impurity) -> np.ndarray:
    right, right_yes = rows - left, yes - left_yes
    below = gini(left - left_yes, left_yes, left)
    below *= left / rows
    gain = impurity - below
    below = gini(right - right_yes, right_yes, right)
    below *= right / rows
    gain -= below
    return gain


def _starts(numbers: np.ndarray) -> np.ndarray:
    """Where runs of equal numbers begin."""
    new = np.ones(len(numbers), bool)
    np.not_equal(numbers[1:], numbers[:-1], out=new[1:])
    return np.flatnonzero(new)


def _lengths(starts: np.ndarray, whole: int) -> np.ndarray:
    out = np.empty(len(starts), np.int64)
    np.subtract(starts[1:], starts[:-1], out=out[:-1])
    out[-1:] = whole - starts[-1:]
    return out


class Best:
    """The best split of each place."""

    PARTS = ("gain", "feature", "cut", "left", "yes", "rows", "sets")

    def __init__(self, places: int, sets: int):
        self.gain, self.feature = np.full(places, -np.inf), np.full(places, -1)
        self.cut, self.rows = np.zeros(places, np.int64), np.zeros(places, np.int64)
        self.left, self.yes = np.zeros(places), np.zeros(places)
        self.sets = np.zeros((places, sets), bool)

    def keep(self, at, gain, feature, cut, left, yes, rows, sets=None) -> None:
        self.gain[at], self.feature[at], self.cut[at] = gain, feature, cut
        self.left[at], self.yes[at], self.rows[at] = left, yes, rows
        if sets is not None:
            self.sets[at] = sets

    def of_each(self, tries: int) -> Best:
        """The best of every so many places, the first of equals."""
        first = self.gain.reshape(-1, tries).argmax(axis=1) + np.arange(0, len(self.gain), tries)
        for part in self.PARTS:
            setattr(self, part, getattr(self, part)[first])
        return self


class Level:
    """Nodes that are to be split, and the entries (a row in a tree, with its weight) in them."""

    def __init__(self, bins: Bins, min_node: int, by_rows: bool):
        self.bins, self.min_node, self.by_rows = bins, min_node, by_rows

    def counted(self, nodes: int, code, entry_node, low, worth):
        """Bins of nodes that hold rows, in order: node, bin, and weights and rows up to there.

        `worth` of a row is its weight times `LEAVER`, and its weight once more if it left.
        """
        bits = self.bins.bits
        cell = entry_node << bits
        cell += code
        cells = np.bincount(cell, weights=worth[low], minlength=nodes << bits)  # sums below 2 ** 53 are exact
        held = np.flatnonzero(cells)
        rows = np.cumsum(np.bincount(cell, minlength=nodes << bits)[held]) if self.by_rows else None
        return held >> bits, held & ((1 << bits) - 1), np.cumsum(cells[held].astype(np.int64)), rows

    def ordered(self, nodes: int, code, entry_node, low, worth):
        """The same by the sorted codes of the rows, for nodes with fewer rows than bins."""
        bits, low_bits = self.bins.bits, (len(worth) - 1).bit_length()
        kind = np.uint64 if nodes.bit_length() + bits + low_bits > 32 else np.uint32
        key = entry_node.astype(kind)
        key <<= kind(bits)
        key |= code
        key <<= kind(low_bits)
        key |= low
        key.sort()
        added = np.cumsum(worth[key & kind((1 << low_bits) - 1)].astype(np.int64))
        key >>= kind(low_bits)
        last = np.ones(len(key), bool)
        np.not_equal(key[1:], key[:-1], out=last[:-1])
        ends = np.flatnonzero(last)
        key = key[ends].astype(np.int64)
        return key >> bits, key & ((1 << bits) - 1), added[ends], ends + 1 if self.by_rows else None

    def offer(self, best, nodes, feature, total, yes, impurity, node, cut, added, rows, by_set=False):
        """Each node's best cut between neighbouring bins; `nodes` are the places in `best`, bins refer to those."""
        if by_set:  # categories in the order of their leavers
            each = np.diff(added, prepend=0)
            order = np.lexsort((cut, each & (LEAVER - 1), node))
            node, cut, added = node[order], cut[order], np.cumsum(each[order])
            rows = np.cumsum(np.diff(rows, prepend=0)[order]) if self.by_rows else None
        starts = _starts(node)
        sizes = _lengths(starts, len(node))

        def running(added):
            before = np.zeros(len(starts), added.dtype)
            before[1:] = added[starts[1:] - 1]
            return added - np.repeat(before, sizes)

        added = running(added)
        left, all_rows = (added >> LEAVER_BITS).astype(float), total[node]
        raws = running(rows) if self.by_rows else left
        whole = np.repeat(raws[starts + sizes - 1], sizes) if self.by_rows else all_rows
        fit = (raws >= self.min_node) & (whole - raws >= self.min_node)
        if not by_set and self.bins.listed:
            fit &= (self.bins.arity[feature] == 0)[node]
        fit = np.flatnonzero(fit)
        if not len(fit):
            return
        node_, left, left_yes = node[fit], left[fit], (added[fit] & (LEAVER - 1)).astype(float)
        gain = _gains(left, left_yes, all_rows[fit], yes[node_], impurity[node_])
        first = _starts(node_)
        top = np.maximum.reduceat(gain, first)
        equal = np.flatnonzero(gain == np.repeat(top, _lengths(first, len(node_))))
        at = equal[_starts(node_[equal])]  # the first of equals
        chosen, place = node_[at], fit[at]
        sets = None
        if by_set:
            until = np.full(len(nodes), -1)
            until[chosen] = place
            under = np.flatnonzero(np.arange(len(node)) <= until[node])
            sets = np.zeros((len(nodes), best.sets.shape[1]), bool)
            sets[node[under], cut[under]] = True
            sets = sets[chosen]
        best.keep(nodes[chosen], gain[at], feature[chosen], cut[place], left[at], left_yes[at], raws[place], sets)

    def splits(self, row, w, y, node, total, yes, tried) -> Best:
        """The best split of each node among its features; a node and one of its features are a place in the tables."""
        arity, tries = self.bins.arity, tried.shape[1]
        best = Best(tried.size, int(arity.max(initial=0)))
        base, low = row * self.bins.features, (w * 2 + y).astype(np.uint32)
        if int(w.sum()) >= LEAVER:
            raise ValueError("too many rows for one task")
        worth = np.arange(int(low.max()) + 1)
        worth = ((worth >> 1) * (LEAVER + (worth & 1))).astype(float)
        large = np.bincount(node, minlength=len(total)) >= COUNTED
        for is_large in (True, False):
            some = np.flatnonzero(large == is_large)
            if not len(some):
                continue
            at, base_, low_ = node, base, low
            if len(some) < len(total):
                mine = np.flatnonzero(large[node] == is_large)
                number = np.zeros(len(total), np.int64)
                number[some] = np.arange(len(some))
                at, base_, low_ = number[node[mine]], base[mine], low[mine]
            tried_, slots = tried[some], np.arange(tries)
            places, feature = (some[:, None] * tries + slots).ravel(), tried_.ravel()
            index = tried_[at]
            index += base_[:, None]
            code = self.bins.flat[index.ravel()]
            place = ((at * tries)[:, None] + slots).ravel()
            total_, yes_ = total[some].repeat(tries), yes[some].repeat(tries)
            impurity = gini(total_ - yes_, yes_, total_)
            held = (self.counted if is_large else self.ordered)(len(places), code, place, low_.repeat(tries), worth)
            self.offer(best, places, feature, total_, yes_, impurity, *held)
            listed = arity[feature] > 0
            if listed.any():
                of = listed[held[0]]  # the bins of those places, and what lies in each
                number = np.cumsum(listed) - 1
                parts = [np.cumsum(np.diff(x, prepend=0)[of]) if x is not None else None for x in held[2:]]
                self.offer(best, places[listed], feature[listed], total_[listed], yes_[listed], impurity[listed],
                           number[held[0][of]], held[1][of], *parts, by_set=True)
        return best.of_each(tries)


def grow(bins: Bins, y: np.ndarray, weights: np.ndarray, seeds: np.ndarray, tries: int, min_node: int, max_depth: int,
         by_rows: bool = False) -> list[dict[str, np.ndarray]]:
    """Trees on rows with a weight for each tree; numbers of a tree's nodes go from the root down, the left side first.

    `min_node` counts draws of rows, or with `by_rows` rows that were drawn.
    """
    trees = len(weights)
    tree_of, row = np.nonzero(weights)
    w = weights[tree_of, row].astype(np.int64)
    y_ = y[row].astype(np.int64)
    node = tree_of
    total = np.bincount(tree_of, weights=w, minlength=trees)
    yes = np.bincount(tree_of, weights=w * y_, minlength=trees)
    raw = np.bincount(tree_of, minlength=trees).astype(np.int64) if by_rows else total.astype(np.int64)
    level, draws = Level(bins, min_node, by_rows), Draws(seeds)
    found: list[dict[str, np.ndarray]] = []  # a level each; places of children are in the next one

    def entered(tree, total, yes, raw):
        nothing = np.full(len(tree), -1, np.int64)
        found.append({"tree": tree, "total": total, "yes": yes, "rows": raw, "gain": np.full(len(tree), -1.0),
                      "feature": nothing, "cut": nothing.astype(float), "left": nothing.copy(), "right": nothing.copy(),
                      "sets": np.zeros((len(tree), int(bins.arity.max(initial=0))), bool)})
        return found[-1]

    here = entered(np.arange(trees), total, yes, raw)
    active = np.flatnonzero(total > 0)
    node = np.searchsorted(active, node)
    for depth in range(max_depth):
        if not len(active):
            break
        tree = here["tree"][active]
        if tries < bins.features:
            tried = drawn_features(draws.next(tree), bins.features, tries)
        else:
            tried = np.tile(np.arange(bins.features), (len(active), 1))
        best = level.splits(row, w, y_, node, here["total"][active], here["yes"][active], tried)
        split = np.flatnonzero(best.gain > 0)
        at = active[split]
        here["gain"][active] = np.maximum(best.gain, -1.0)
        here["feature"] = here["feature"].copy()
        here["feature"][at], here["cut"][at], here["sets"][at] = best.feature[split], best.cut[split], best.sets[split]
        here["left"][at], here["right"][at] = 2 * np.arange(len(at)), 2 * np.arange(len(at)) + 1

        def sides(whole, left):
            return np.column_stack([left, whole - left]).ravel()

        total, yes = sides(here["total"][at], best.left[split]), sides(here["yes"][at], best.yes[split])
        raw = sides(here["rows"][at], best.rows[split])
        here = entered(np.repeat(here["tree"][at], 2), total, yes, raw)
        going = np.abs(gini(total - yes, yes, total)) >= 2.0**-52
        next_active = np.flatnonzero(going)[::-1]  # the last that was put on the stack comes first
        place = np.full(len(total), -1)
        place[next_active] = np.arange(len(next_active))
        child = np.full(2 * len(active), -1)
        child[2 * split], child[2 * split + 1] = place[::2], place[1::2]
        code = bins.flat[row * bins.features + best.feature[node]].astype(np.int64)
        right = code > best.cut[node]
        by_set = np.flatnonzero(bins.arity[best.feature[node]] > 0)
        right[by_set] = ~best.sets[node[by_set], code[by_set]]
        node = child[2 * node + right]
        kept = np.flatnonzero(node >= 0)
        row, w, y_, node, active = row[kept], w[kept], y_[kept], node[kept], next_active
    return _numbered(found, trees, bins)


def _numbered(found: list[dict[str, np.ndarray]], trees: int, bins: Bins) -> list[dict[str, np.ndarray]]:
    """The nodes of each tree from the root down, after sibling leaves of one class were merged."""
    for above, below in zip(reversed(found[:-1]), reversed(found[1:])):
        inner = np.flatnonzero(above["left"] >= 0)
        a, b = above["left"][inner], above["right"][inner]
        class_of, leaf = below["yes"] > below["total"] - below["yes"], below["left"] < 0
        merged = inner[leaf[a] & leaf[b] & (class_of[a] == class_of[b])]
        above["left"][merged] = above["right"][merged] = -1
    sizes: list[np.ndarray] = []
    for i in reversed(range(len(found))):
        size = np.ones(len(found[i]["tree"]), np.int64)
        inner = np.flatnonzero(found[i]["left"] >= 0)
        if len(inner):
            size[inner] += sizes[0][found[i]["left"][inner]] + sizes[0][found[i]["right"][inner]]
        sizes.insert(0, size)
    ids = [np.full(len(x["tree"]), -1) for x in found]
    ids[0][:] = 0
    columns: dict[str, list[np.ndarray]] = {c: [] for c in ("tree", "id", "sets", *PARTS)}
    for i, part in enumerate(found):
        there = np.flatnonzero(ids[i] >= 0)
        inner = part["left"][there] >= 0
        left, right = np.full(len(there), -1), np.full(len(there), -1)
        left[inner] = ids[i][there[inner]] + 1
        if inner.any():
            a, b = part["left"][there[inner]], part["right"][there[inner]]
            right[inner] = left[inner] + sizes[i + 1][a]
            ids[i + 1][a], ids[i + 1][b] = left[inner], right[inner]
        feature = np.where(inner, part["feature"][there], -1)
        made = {"tree": part["tree"][there], "id": ids[i][there], "left": left, "right": right,
                "no": part["total"][there] - part["yes"][there], "yes": part["yes"][there], "rows": part["rows"][there],
                "gain": np.where(inner, part["gain"][there], -1.0), "feature": feature,
                "cut": part["cut"][there], "by_set": inner & (bins.arity[feature] > 0), "sets": part["sets"][there]}
        for c, values in made.items():
            columns[c].append(values)
    whole = {c: np.concatenate(v) for c, v in columns.items()}
    order = np.lexsort((whole["id"], whole["tree"]))
    ends = np.searchsorted(whole["tree"][order], np.arange(trees + 1))
    return [{c: whole[c][order[a:b]] for c in (*PARTS, "sets")} for a, b in zip(ends, ends[1:])]


def strongest_splits(tree: dict[str, np.ndarray], most: int) -> list[int]:
    """The first splits of a tree best first: of the nodes that can be split, the one that decreases the impurity of all
    rows most."""
    left, right = tree["left"].tolist(), tree["right"].tolist()
    worth = (-tree["gain"] * (tree["no"] + tree["yes"])).tolist()
    found, ready = [], [(worth[0], 0)] if left[0] >= 0 else []
    while ready and len(found) < most:
        _, at = heapq.heappop(ready)
        found.append(at)
        for child in (left[at], right[at]):
            if left[child] >= 0:
                heapq.heappush(ready, (worth[child], child))
    return found


def cut_shares(tree: dict[str, np.ndarray], max_leaves: int | None, splits: list[int] | None = None) -> np.ndarray:
    """Share of leavers of the node that answers for each leaf when only the strongest splits are kept.

    Nodes are numbered from the root down, the left side first, so the leaves under a node are neighbours. `splits` are
    the strongest splits, as many as the limit allows or more, if they are at hand.
    """
    rows = tree["no"] + tree["yes"]
    share = tree["yes"] / np.maximum(rows, 1e-300)
    is_leaf = tree["left"] < 0
    if max_leaves is None or is_leaf.sum() <= max_leaves:
        return share[is_leaf]
    taken = np.asarray((strongest_splits(tree, max_leaves - 1) if splits is None else splits)[: max_leaves - 1], np.int64)
    kept = np.zeros(len(share), bool)
    kept[0] = True
    kept[tree["left"][taken]] = kept[tree["right"][taken]] = True
    kept[taken] = False
    starts = np.flatnonzero(kept)
    before = (np.cumsum(is_leaf) - is_leaf)[starts]  # leaves before each kept node
    return np.repeat(share[starts], np.diff(before, append=is_leaf.sum()))


def judged(bins: Bins, rows: np.ndarray, trees: list[dict[str, np.ndarray]]) -> np.ndarray:
    """For rows of bins the number of the leaf in each tree, leaves counted over all trees."""
    sizes = np.array([len(t["left"]) for t in trees])
    roots = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    feature, cut, by_set, sets = (np.concatenate([t[c] for t in trees]) for c in ("feature", "cut", "by_set", "sets"))
    kids = np.column_stack([np.concatenate([t[c] + r for t, r in zip(trees, roots)]) for c in ("left", "right")]).ravel()
    leaf = feature < 0
    number = np.cumsum(leaf) - 1
    at = np.repeat(roots, len(rows))
    base = np.tile(rows * bins.features, len(trees))
    cut, some = cut.astype(np.int64), by_set.any()
    going = np.flatnonzero(~leaf[at])
    node, base = at[going], base[going]
    while len(going):
        code = bins.flat[base + feature[node]]
        right = code > cut[node]
        if some:
            listed = np.flatnonzero(by_set[node])
            right[listed] = ~sets[node[listed], code[listed]]
        node = kids[2 * node + right]
        inner = ~leaf[node]
        done = np.flatnonzero(~inner)
        at[going[done]] = node[done]
        kept = np.flatnonzero(inner)
        going, node, base = going[kept], node[kept], base[kept]
    return number[at].reshape(len(trees), len(rows))


def bag(copies: np.ndarray, rate: float, seed: int, tree: int) -> np.ndarray:
    """How often each row is drawn with replacement: Poisson, and the copies of a row add up."""
    return np.random.Generator(np.random.PCG64([seed, tree])).poisson(rate * copies)


def fold_scores(data: dict, job: dict, seed: int) -> list[tuple[float, float]]:
    """Rows that are right and all held-out rows, for each smaller forest that one fit on the other folds holds."""
    y, copies, held = data["label"], data["copies"], data["fold"] == job["fold"]
    bins = Bins(data, np.where(held, 0, copies), job["max_bins"])
    rows, weight = np.flatnonzero(held), copies[held]
    limits = list(dict.fromkeys(limit for _, limit in job["members"]))
    added = np.zeros((len(limits), len(rows)))
    want, scores = y[rows] == 1, {}
    train = np.where(held, 0, copies)
    ends = sorted({t for t, _ in job["members"]})
    step = max(1, TOGETHER // max(1, int((train > 0).sum()), len(rows)))
    for first in range(0, ends[-1], step):
        numbers = range(first, min(first + step, ends[-1]))
        weights = np.stack([bag(train, job["rate"], seed, t) for t in numbers])
        seeds = np.array([seed + t for t in numbers], np.int64)
        trees = grow(bins, y, weights, seeds, job["tries"], job["min_node"], job["max_depth"])
        leaves = judged(bins, rows, trees)
        most = max((limit for limit in limits if limit), default=1) - 1
        splits = [strongest_splits(t, most) for t in trees]
        shares = [np.concatenate([cut_shares(t, limit, x) for t, x in zip(trees, splits)]) for limit in limits]
        for t, leaf in zip(numbers, leaves):
            for i, share in enumerate(shares):
                added[i] += share[leaf]
            if t + 1 in ends:
                for i, limit in enumerate(limits):
                    right = (added[i] / (t + 1) > 0.5) == want
                    scores[t + 1, limit] = (float((weight * right).sum()), float(weight.sum()))
    return [scores[m] for m in job["members"]]


def grown_trees(data: dict, job: dict, seed: int):
    """Yields number, nodes and bins of the trees of a job: on bags of all rows, or on the draws that come with them."""
    y, copies, draws = data["label"], data["copies"], data.get("draws")
    numbers = range(job["first"], job["end"])
    if draws is not None:
        for t in numbers:  # each tree cuts its bins by the rows that it draws
            weights = draws[:, t].astype(np.int64)
            bins = Bins(data, weights, job["max_bins"])
            yield t, grow(bins, y, weights[None, :], np.array([seed + t], np.int64), job["tries"], job["min_node"],
                          job["max_depth"], by_rows=True)[0], bins
        return
    bins = Bins(data, copies, job["max_bins"])
    step = max(1, TOGETHER // max(1, len(y)))
    for first in range(numbers.start, numbers.stop, step):
        some = range(first, min(first + step, numbers.stop))
        weights = np.stack([bag(copies, job["rate"], seed, t) for t in some])
        seeds = np.array([seed + t for t in some], np.int64)
        for t, tree in zip(some, grow(bins, y, weights, seeds, job["tries"], job["min_node"], job["max_depth"])):
            yield t, tree, bins


def saved_nodes(number: int, tree: dict[str, np.ndarray], bins: Bins) -> dict[str, list]:
    """The nodes of a tree in the columns of a saved `spark.ml` forest."""
    no, yes, feature, by_set = tree["no"], tree["yes"], tree["feature"], tree["by_set"]
    values = [[] if f < 0 else np.flatnonzero(s).astype(float).tolist() if listed else [float(bins.cuts[f][int(c)])]
              for f, c, listed, s in zip(feature, tree["cut"], by_set, tree["sets"])]
    return {
        "treeID": [number] * len(no), "id": list(range(len(no))), "prediction": (yes > no).astype(float).tolist(),
        "impurity": gini(no, yes, no + yes).tolist(), "impurityStats": np.column_stack([no, yes]).tolist(),
        "rawCount": tree["rows"].tolist(), "gain": tree["gain"].tolist(), "leftChild": tree["left"].tolist(),
        "rightChild": tree["right"].tolist(), "featureIndex": feature.tolist(), "leftCategoriesOrThreshold": values,
        "numCategories": [int(bins.arity[f]) if listed else -1 for f, listed in zip(feature, by_set)],
    }
