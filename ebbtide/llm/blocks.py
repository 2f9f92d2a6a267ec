"""Complete comparison of buckets in which several components are left, in tasks of bounded size.

A bucket holds nodes that share a signature. Its nodes are dealt into blocks by size (words or features), not by number:
a component that is larger than a block has blocks of its own, the others share blocks. Pairs of blocks that hold one
and the same component are left out before any content is joined, because a link inside a component changes no class.
Every other pair of blocks is one group of rows of a task, which returns only links that join components.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.session import materialise

#: Size of the content of a block, as the sum of its nodes' `size`; a single larger node is a block of its own.
BLOCK_SIZE = 1 << 17
#: Nodes and features compared by one matrix product.
TILE, COLUMNS = 256, 4096

Features = Callable[[pa.Array], tuple[np.ndarray, np.ndarray, np.ndarray]]
Test = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]
Make = Callable[[pa.Table], pa.RecordBatch]


def one_of_each_set(members: DataFrame) -> DataFrame:
    """Of buckets (`band`) with the same nodes, the members of one; buckets of one node go."""
    sets = members.groupBy("band").agg(
        F.bit_xor(F.xxhash64("node")).alias("mark"), F.sum(F.hash("node")).alias("sum"),
        F.count(F.lit(1)).alias("n"), F.min("node").alias("low"), F.max("node").alias("high"))
    one = sets.where("n > 1").groupBy("mark", "sum", "n", "low", "high").agg(F.min("band").alias("band"))
    return members.join(materialise(one.select("band"), "buckets"), "band", "left_semi")


def block_pairs(mixed: DataFrame, most: int = BLOCK_SIZE) -> tuple[DataFrame, DataFrame]:
    """For rows (band, node, root, size): the block of each node, and the pairs (band, i, j) of blocks to compare."""
    held = mixed.groupBy("band", "root").agg(F.sum("size").alias("held"))
    held = materialise(held.withColumn("alone", F.col("held") > most), "held")
    shared = held.where("not alone").groupBy("band").agg(F.ceil(F.sum("held") / most).cast("long").alias("shared"))
    dealt = mixed.join(held, ["band", "root"]).join(materialise(shared, "shared"), "band", "left")
    parts = F.when(F.col("alone"), F.ceil(F.col("held") / most).cast("long")).otherwise(F.col("shared"))
    # names of blocks: even for shared ones, odd for those of one component, which the hash of the root sets apart
    own = F.xxhash64("root", F.pmod(F.xxhash64("node"), parts)).bitwiseOR(F.lit(1))
    block = F.when(F.col("alone"), own).otherwise(F.pmod(F.xxhash64("root"), parts) * 2)
    placed = materialise(dealt.select("band", "node", "root", block.alias("block")), "placed")
    blocks = placed.groupBy("band", "block").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    blocks = materialise(blocks, "blocks")
    left = blocks.select("band", *(F.col(c).alias(f"{c}_i") for c in ("block", "low", "high")))
    right = blocks.select("band", *(F.col(c).alias(f"{c}_j") for c in ("block", "low", "high")))
    several = F.least("low_i", "low_j") < F.greatest("high_i", "high_j")
    pairs = left.join(right, "band").where((F.col("block_i") <= F.col("block_j")) & several)
    return placed, pairs.select("band", F.col("block_i").alias("i"), F.col("block_j").alias("j"))


def joining_links(root: np.ndarray, block: np.ndarray, content: pa.Array, features: Features, similar: Test):
    """Pairs of places with similar content, enough of them to connect all components (roots) that have any.

    Places of different blocks are compared if there are two blocks, else all.
    """
    row, value, total = features(content)
    found = []
    _, root = np.unique(root, return_inverse=True)
    single = block.min() == block.max()
    first, second = (np.flatnonzero(block == b) for b in (block.min(), block.max()))
    bounds = np.searchsorted(row, np.arange(len(content) + 1))
    for a in range(0, len(first), TILE):
        for b in range(a if single else 0, len(second), TILE):
            left, right = first[a : a + TILE], second[b : b + TILE]
            both = np.unique(np.concatenate([left, right]))
            if len(np.unique(root[both])) < 2:
                continue
            use = np.concatenate([np.arange(bounds[p], bounds[p + 1]) for p in both])
            _, column, times = np.unique(value[use], return_inverse=True, return_counts=True)
            shared = times[column] > 1
            use, column = use[shared], np.unique(column[shared], return_inverse=True)[1]
            order = np.argsort(column, kind="stable")
            column, local = column[order], np.searchsorted(both, row[use][order])
            common = np.zeros((len(both), len(both)), np.float32)
            for c in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
                part = slice(*np.searchsorted(column, [c, c + COLUMNS]))
                table_ = np.zeros((len(both), COLUMNS), np.float32)
                table_[local[part], column[part] - c] = 1
                common += table_ @ table_.T
            u, v = np.nonzero(similar(common, total[both][:, None], total[both][None, :]))
            for i, j in zip(both[u], both[v]):
                if root[i] != root[j] and (single or block[i] != block[j]):
                    found.append((i, j))
                    root[root == root[j]] = root[i]
    return found


def per_block_pair(mixed: DataFrame, content: DataFrame, columns: list[str], make: Make, schema: str,
                   most: int = BLOCK_SIZE) -> DataFrame:
    """What `make` returns for each pair of blocks of `mixed` (band, node, root).

    `content` has `node`, `size` and `columns`; `make` gets a table with band, node, root, block and these columns.
    """
    sizes = content.select("node", F.greatest("size", F.lit(1)).alias("size"))
    sized = materialise(mixed.select("band", "node", "root").join(sizes, "node"), "sized")
    placed, pairs = block_pairs(sized, most)
    pairs = materialise(pairs, "block-pairs")
    sides = pairs.select("band", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
    rows = sides.join(placed, ["band", "block"]).select("band", "i", "j", "node", "root", "block")
    rows = materialise(rows, "sides").join(content.select("node", *columns), "node")
    rows = rows.select("band", "i", "j", "root", "block", "node", *columns)
    rows = rows.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, kept_key = [], None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in (0, 1, 2)], 1)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(keys)]):
                if a == b:
                    continue
                if kept_key is not None and (keys[a] != kept_key).any():
                    group, kept = pa.Table.from_batches(kept).combine_chunks(), []
                    if group.num_rows > 1:
                        yield make(group)
                kept_key = keys[a]
                kept.append(batch.slice(a, b - a))
        if kept and sum(len(k) for k in kept) > 1:
            yield make(pa.Table.from_batches(kept).combine_chunks())

    return rows.mapInArrow(run, schema)


def compare_buckets(mixed: DataFrame, content: DataFrame, column: str, features: Features, similar: Test,
                    most: int = BLOCK_SIZE) -> DataFrame:
    """Links (u, v) that join components, from all buckets of `mixed` (band, node, root).

    `features` gives row, value (once a row) and total per row of an array of `column`, and `similar` tells from the
    shared number and both totals whether two nodes are linked.
    """

    def links(group: pa.Table) -> pa.RecordBatch:
        node, root, block = (group.column(c).to_numpy() for c in ("node", "root", "block"))
        found = joining_links(root, block, group.column(column).combine_chunks(), features, similar)
        u, v = np.array(found, np.int64).reshape(-1, 2).T
        return pa.RecordBatch.from_arrays([pa.array(node[u]), pa.array(node[v])], names=["u", "v"])

    return per_block_pair(one_of_each_set(mixed), content, [column], links, "u long, v long", most)


def in_no_common(lists: list[np.ndarray], u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """For each u (row) and v (column) whether their lists have nothing in common; a list holds a value once."""
    both = np.unique(np.concatenate([u, v]))
    column, times = np.unique(np.concatenate([np.zeros(0, np.int64), *(lists[p] for p in both)]), return_counts=True)
    column = column[times > 1]
    common = np.zeros((len(both), len(both)), np.float32)
    for c in range(0, len(column), COLUMNS):
        part = column[c : c + COLUMNS]
        held = np.stack([np.isin(part, lists[p]) for p in both]).astype(np.float32)
        common += held @ held.T
    return common[np.searchsorted(both, u)][:, np.searchsorted(both, v)] == 0


def with_possible_partner(mixed: DataFrame, sketches: DataFrame, weights: tuple[int, int], once: bool = False) -> DataFrame:
    """The rows of `mixed` (band, node, root) whose sketch allows a link with a node of another root in the same bucket.

    `sketches` has `node`, `sketch` (counts of features by cell) and `features` (their number); a link is possible if
    the counts differ by at most weights[1] / weights[0] of the sum of both numbers. What comes out grows with the rows,
    not with their pairs. With `once` a pair counts only in one of the buckets that hold it, the largest one (of equal
    ones, the first by name), so a node is not kept in every bucket that it shares with the same nodes.
    """

    def flag(group: pa.Table) -> pa.RecordBatch:
        node, root, block, band, size = (
            group.column(c).to_numpy() for c in ("node", "root", "block", "band", "features"))
        counts = group.column("sketch").combine_chunks()
        counts = counts.flatten().to_numpy().reshape(len(node), -1).astype(np.int32)
        near = np.zeros(len(node), bool)
        if once:  # the buckets of a node that come before this one
            listed, held = group.column("buckets").combine_chunks(), []
            ends, flat = listed.offsets.to_numpy(), listed.values.to_numpy()
            for r in range(len(node)):
                own = flat[ends[r] : ends[r + 1]]
                held.append(own[: np.flatnonzero(own == band[r])[0]])
        first, second = (np.flatnonzero(block == b) for b in (block.min(), block.max()))
        for a in range(0, len(first), 128):
            for b in range(a if block.min() == block.max() else 0, len(second), 128):
                u, v = first[a : a + 128], second[b : b + 128]
                apart = np.abs(counts[u][:, None, :] - counts[v][None, :, :]).sum(2)
                could = (weights[0] * apart <= weights[1] * (size[u][:, None] + size[v])) & (root[u][:, None] != root[v])
                if once and could.any():
                    could &= in_no_common(held, u, v)
                near[u] |= could.any(1)
                near[v] |= could.any(0)
        return pa.RecordBatch.from_arrays([pa.array(band[near]), pa.array(node[near])], names=["band", "node"])

    content, columns, each = sketches.withColumn("size", F.size("sketch")), ["sketch", "features"], one_of_each_set(mixed)
    if once:
        each = materialise(each.select("band", "node", "root"), "each-set")
        large = each.join(materialise(each.groupBy("band").count(), "bucket-sizes"), "band")
        order = F.struct((-F.col("count")).alias("n"), "band")
        listed = large.groupBy("node").agg(F.array_sort(F.collect_list(order)).alias("b"))
        content = content.join(materialise(listed.select("node", F.col("b.band").alias("buckets")), "node-buckets"), "node")
        columns = [*columns, "buckets"]
    flagged = per_block_pair(each, content, columns, flag, "band long, node long")
    return mixed.join(materialise(flagged.distinct(), "flagged"), ["band", "node"], "left_semi")
