"""N-gram Jaccard join with PartEnum signatures.

A document is the set of its distinct three-word shingles (words in lower case as far as A-Z go); a shorter one is one
shingle of all its words. Two documents are linked if 100 * |both| >= 90 * |either|. With H features in only one of two
sets and S as the sum of their sizes this is 19 * H <= S, so linked sets differ little in size too.

Sizes are cut into bands STEPS times as wide as that. A set is signed for its own band, and for the next one if it could
be linked to the smallest set there, so that linked sets are signed for a common band, in which they differ in
at most k features. There the features are hashed into n1 parts, and each part into n2 cells. Some part has at most
k2 = floor(k / n1) of the differing features, so at most k2 of its cells differ. A signature is a part without k2 of its
cells, for every choice of these: linked sets share one of them for certain, so nothing is missed. n1 and n2 are chosen
for each band so that a signature is expected to hold FEATURES features, with as few signatures as that allows.

Equal sets are one node. In a bucket (nodes with one signature) each node is compared with one pivot, which then leaves the
bucket, in rounds; links are merged into components. Buckets that then hold several components still are compared completely in
blocks of bounded size (`blocks`), first their sketches, then the texts of those that could have a partner, each pair in one
of the buckets that hold it. A pair is left out before its texts are joined only if the sets cannot be linked: by
their sizes, or by a sketch, the number of features in each of 64 cells, as sets whose counts differ by D in all have at
least D different features. Nothing else decides: links are verified on the whole sets. Features are 64-bit hashes
of shingles; equal sets are recognised by size and two such sums.

NULL and texts without words have no set (0 shingles) and are linked with nothing. Repeated rows and rows without a key
are nodes like others; a component's name is its smallest key, NULL only if none of its rows has one. A document without
links is its own component. Other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ebbtide.llm.blocks import compare_buckets, one_of_each_set, with_possible_partner
from ebbtide.llm.components import components
from ebbtide.llm.tables import ship, table
from ebbtide.llm.text import MIX_1, ODD, bounded, mix, runs, slices, words
from ebbtide.session import discard, materialise

#: Words of a shingle; least similarity as a fraction; width of a band as a power of it; features wanted in a signature;
#: rounds with pivots; bytes of text handled at once (a single longer text is handled alone).
SHINGLE, LEAST, STEPS, FEATURES, PIVOT_ROUNDS, SLICE = 3, (90, 100), 3, 7, 1, 1 << 19
#: Cells of a sketch, in which the features of a set are counted.
CELLS = 64

Fraction = tuple[int, int]


@functools.cache
def band_end(first: int, least: Fraction = LEAST) -> int:
    """The last size of the band that begins at `first`."""
    return first * least[1] ** STEPS // least[0] ** STEPS


@functools.cache
def bands_of(size: int, least: Fraction = LEAST) -> tuple[int, ...]:
    """The first sizes of the bands for which a set is signed: its own one, and the next one if it comes near it."""
    first = 1
    while band_end(first, least) < size:
        first = band_end(first, least) + 1
    after = band_end(first, least) + 1
    return (first, after) if size * least[1] // least[0] >= after else (first,)


def most_different(first: int, least: Fraction = LEAST) -> int:
    """In how many features linked sets that are signed for a band differ at most."""
    return 2 * band_end(first, least) * (least[1] - least[0]) // (least[1] + least[0])


@functools.cache
def plan(first: int, least: Fraction = LEAST, features: int = FEATURES) -> tuple[int, int, int]:
    """(n1, n2, k2) for the band that begins at `first`, so that the smallest sets signed for it have enough features."""
    most = most_different(first, least)
    smallest = -(-first * least[0] // least[1])
    options = []
    for depth in range(4):
        n1 = math.ceil((most + 1) / (depth + 1))
        k2 = most // n1
        for n2 in range(k2 + 1, k2 + 5):
            held = smallest / n1 * (n2 - k2) / n2
            options.append((-min(held, features), n1 * math.comb(n2, k2), n1, n2, k2))
    _, _, n1, n2, k2 = min(options)
    return n1, n2, k2


def shingle_sets(data: np.ndarray, offsets: np.ndarray, length: int = SHINGLE):
    """Row and hash of each distinct shingle, sorted, and the number of them in each row."""
    low = data + ((data >= 65) & (data <= 90)) * np.uint8(32)
    hashes, _, _, at = words(low, offsets)
    n = np.diff(at)
    owner = np.repeat(np.arange(len(n)), n)
    rows, found = [], []
    whole = runs(hashes, length)
    if len(whole):
        inside = owner[: len(whole)] == owner[length - 1 :]
        rows.append(owner[: len(whole)][inside])
        found.append(whole[inside])
    for r in np.flatnonzero((n > 0) & (n < length)):
        rows.append(np.array([r]))
        found.append(mix(runs(hashes[at[r] : at[r + 1]], int(n[r])) + np.uint64(n[r])))
    row = np.concatenate([np.zeros(0, np.int64), *rows])
    value = np.concatenate([np.zeros(0, np.uint64), *found])
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    return row[new], value[new], np.bincount(row[new], minlength=len(offsets) - 1)


def row_sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of 64-bit integers between consecutive ends, modulo 2**64; empty ranges are 0."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    return total[ends[1:]] - total[ends[:-1]]


def signatures(value: np.ndarray, ends: np.ndarray, first: int, least: Fraction, features: int) -> np.ndarray:
    """A table (sets x signatures) for the band that begins at `first`; set r is value[ends[r]:ends[r + 1]]."""
    n1, n2, k2 = plan(first, least, features)
    n = len(ends) - 1
    seed = mix(np.array([first], np.uint64))
    spot = mix(value ^ seed)
    cell = (spot >> np.uint64(32)) % np.uint64(n1) * np.uint64(n2) + (spot & np.uint64(0xFFFFFFFF)) % np.uint64(n2)
    owner = np.repeat(np.arange(n), np.diff(ends))
    sums = np.zeros(n * n1 * n2, np.uint64)
    np.add.at(sums, owner * (n1 * n2) + cell.astype(np.int64), mix(value + ODD))
    sums = sums.reshape(n, n1, n2)
    made = []
    for number, left in enumerate(itertools.combinations(range(n2), n2 - k2)):
        name = mix(seed + np.arange(n1, dtype=np.uint64) * np.uint64(1 << 16) + np.uint64(number))
        made.append(mix(mix(sums[:, :, left].sum(2, dtype=np.uint64)) + name))
    return np.concatenate(made, 1)


def signed(docs: DataFrame, key: str, text: str, length: int, least: Fraction, features: int) -> DataFrame:
    """`key`, `size` (shingles), `print` and `other` (two sums that name the set), `sketch` and `bands` (its signatures)
    of each row."""
    picked = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in slices(batch.column(2), SLICE, 512):
                row, value, size = shingle_sets(data, offsets, length)
                ends = np.concatenate([[0], np.cumsum(size)])
                cell = row * CELLS + (mix(value ^ MIX_1) % np.uint64(CELLS)).astype(np.int64)
                sketch = np.bincount(cell, minlength=len(size) * CELLS).astype(np.int32)
                prints = np.stack([row_sums(mix(value + ODD), ends), row_sums(mix(value ^ ODD), ends)], 1)
                tags: dict[int, list[int]] = {}
                for r in np.flatnonzero(size):
                    for tag in bands_of(int(size[r]), least):
                        if most_different(tag, least):  # sets that differ in nothing are one node already
                            tags.setdefault(tag, []).append(r)
                made: list[list[np.ndarray]] = [[] for _ in size]
                for tag, at in tags.items():
                    use = np.concatenate([np.arange(ends[r], ends[r + 1]) for r in at])
                    inner = np.concatenate([[0], np.cumsum(size[at])])
                    for r, x in zip(at, signatures(value[use], inner, tag, least, features)):
                        made[r].append(x)
                lists = [np.concatenate(x) if x else np.zeros(0, np.uint64) for x in made]
                cuts = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
                flat = np.concatenate([np.zeros(0, np.uint64), *lists]).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[first:last], batch.column(1)[first:last], pa.array(size), pa.array(prints[:, 0].view(np.int64)),
                     pa.array(prints[:, 1].view(np.int64)),
                     pa.ListArray.from_arrays(pa.array(np.arange(len(size) + 1, dtype=np.int32) * CELLS), pa.array(sketch)),
                     pa.ListArray.from_arrays(pa.array(cuts), pa.array(flat))],
                    names=["key", "text_hash", "size", "print", "other", "sketch", "bands"])

    kind = picked.schema["key"].dataType.simpleString()
    return picked.mapInArrow(
        sign, f"key {kind}, text_hash long, size long, print long, other long, sketch array<int>, bands array<long>")


def sets_in(texts: pa.Array, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and value of each feature, and features per row."""
    found = [(row + first, value, size) for first, _, data, offsets in slices(texts)
             for row, value, size in [shingle_sets(data, offsets, length)]]
    return tuple(np.concatenate(x) for x in zip(*found))


def possible(pairs: DataFrame, sketches: DataFrame, least: Fraction) -> DataFrame:
    """The pairs (u, v) that sizes and sketches do not rule out."""
    for c in ("u", "v"):
        pairs = pairs.join(sketches.select(*(F.col(x).alias(y) for x, y in (
            ("node", c), ("size", f"size_{c}"), ("sketch", f"sketch_{c}")))), c)
    close = least[1] * F.least("size_u", "size_v") >= least[0] * F.greatest("size_u", "size_v")
    apart = F.aggregate(F.zip_with("sketch_u", "sketch_v", lambda a, b: F.abs(a - b)), F.lit(0), lambda s, d: s + d)
    near = (least[1] + least[0]) * apart <= (least[1] - least[0]) * (F.col("size_u") + F.col("size_v"))
    return pairs.where(close & near).select("u", "v")


def linked(pairs: DataFrame, texts: DataFrame, length: int, least: Fraction) -> DataFrame:
    """The pairs (u, v) whose sets are similar enough, from their whole texts."""
    for c in ("u", "v"):
        pairs = pairs.join(texts.select(F.col("node").alias(c), F.col("text").alias(f"text_{c}")), c)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last in bounded([batch.column(2), batch.column(3)], SLICE):
                part = batch.slice(first, last - first)
                left, right = sets_in(part.column(2), length), sets_in(part.column(3), length)
                row, value = (np.concatenate([left[i], right[i]]) for i in (0, 1))
                order = np.lexsort((value, row))
                row, value = row[order], value[order]
                both = np.bincount(row[1:][(row[1:] == row[:-1]) & (value[1:] == value[:-1])], minlength=last - first)
                yield part.select(["u", "v"]).filter(pa.array(
                    least[1] * both >= least[0] * (left[2] + right[2] - both)))

    return pairs.select("u", "v", "text_u", "text_v").mapInArrow(compare, "u long, v long")


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = SHINGLE,
                       least: Fraction = LEAST, features: int = FEATURES) -> DataFrame:
    """`key`, `n_shingles` and `component_id` (the smallest key that links lead to) for each input row."""
    ship(docs.sparkSession)
    low, high = least
    written = materialise(signed(docs, key, text, length, least, features), "signed")
    marked = materialise(written.select("key", "text_hash", "size", "print", "other"), "marked")
    same = ["size", "print", "other"]
    as_text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    nodes = written.where("size > 0").groupBy(*same).agg(
        F.min("key").alias("least"), F.min(F.struct("text_hash", as_text("key").alias("key"))).alias("row"),
        F.first("sketch").alias("sketch"), F.first("bands").alias("bands"))
    nodes = materialise(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    discard(written)
    signs = nodes.select("node", F.explode("bands").alias("band"))
    # one shuffle of the signatures, of which most belong to one node
    members = signs.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("band"))).where("n > 1").drop("n")
    members = materialise(members, "members")
    members = materialise(one_of_each_set(members), "kept-members")

    wanted = nodes.join(members.select("node").distinct(), "node", "left_semi").select("node", "row.text_hash", "row.key")
    found = docs.select(F.xxhash64(text).alias("text_hash"), as_text(key).alias("key"), F.col(text).alias("text"))
    texts = found.join(materialise(wanted, "wanted"), ["text_hash", "key"]).groupBy("node").agg(
        F.first("text").alias("text"))
    texts = materialise(texts.withColumn("size", F.octet_length("text") / 4), "texts")

    def similar(both, one, other):
        return high * both.astype(np.float64) >= low * (one + other - both.astype(np.float64))

    sketches = nodes.join(members.select("node").distinct(), "node", "left_semi").select("node", "size", "sketch")
    sketches = materialise(sketches, "sketches")

    class_of = nodes.sparkSession.createDataFrame([], "node long, root long")
    links = tried = nodes.sparkSession.createDataFrame([], "u long, v long")
    for step in range(PIVOT_ROUNDS + 2):
        at = members.join(class_of, "node", "left").withColumn("root", F.coalesce("root", "node"))
        at = materialise(at, "at")
        roots = at.groupBy("band").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a < b").select("band")
        mixed = materialise(at.join(materialise(roots, "mixed-bands"), "band", "left_semi"), "mixed")
        if mixed.isEmpty():
            break
        if step <= PIVOT_ROUNDS:
            pivots = materialise(mixed.groupBy("band").agg(F.min(F.struct("node", "root")).alias("p")), "pivots")
            both = mixed.join(pivots, "band")
            pairs = both.where("root != p.root").select(F.col("node").alias("u"), F.col("p.node").alias("v"))
            if step:
                members = materialise(both.where("node != p.node").select("node", "band"), "members")
            else:  # at first one pair for each node, and pivots stay: most others are joined after that
                pairs = pairs.groupBy("u").agg(F.min("v").alias("v"))
            pairs = materialise(pairs.distinct().join(tried, ["u", "v"], "left_anti"), "pairs")
            tried = tried.unionByName(pairs)
            near = materialise(possible(pairs, sketches, least), "possible")
            links = links.unionByName(materialise(linked(near, texts, length, least), "checked"))
        else:
            counted = sketches.withColumnRenamed("size", "features")
            left = with_possible_partner(mixed.select("band", "node", "root"), counted, (high + low, high - low), once=True)
            joined = compare_buckets(materialise(left, "left"), texts, "text",
                                     functools.partial(sets_in, length=length), similar)
            links = links.unionByName(materialise(joined, "joined"))
        class_of = materialise(components(links), "classes")

    rooted = nodes.join(class_of, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rooted = materialise(rooted.select(*same, "root", "least"), "rooted")
    named = rooted.join(materialise(rooted.groupBy("root").agg(F.min("least").alias("name")), "names"), "root")
    named = materialise(named.select(*same, "name"), "named")
    filled = marked.where("size > 0").select("key", *same).join(named, same).select("key", "size", "name")
    empty = marked.where("size = 0").select("key", "size", F.col("key").alias("name"))
    return filled.unionByName(empty).select(
        F.col("key").alias(key), F.col("size").alias("n_shingles"), F.col("name").alias("component_id"))


def op12_ngram_join(spark, folder: str) -> DataFrame:
    return jaccard_components(table(spark, folder, "documents"))


OP12_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
k AS (
  SELECT rid, list(DISTINCT array_to_string(w[i : i + 2], ' ') ORDER BY array_to_string(w[i : i + 2], ' ')) AS s
  FROM (SELECT rid, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0) GROUP BY rid),
g AS (SELECT doc_id, coalesce(s, []::VARCHAR[]) AS s FROM d LEFT JOIN k USING (rid)),
n AS (SELECT s, min(doc_id) AS node, len(s) AS size FROM g WHERE len(s) > 0 GROUP BY s),
f AS (SELECT node, size, unnest(s) AS x FROM n),
e AS (
  SELECT a.node AS u, b.node AS v FROM f a JOIN f b ON a.x = b.x AND a.node < b.node
  GROUP BY a.node, b.node, a.size, b.size HAVING 100 * count(*) >= 90 * (a.size + b.size - count(*))),
b AS (SELECT u, v FROM e UNION SELECT v, u FROM e),
r AS (SELECT node, node AS root FROM n UNION SELECT b.v, r.root FROM r JOIN b ON b.u = r.node),
c AS (SELECT node, min(root) AS component_id FROM r GROUP BY node)
SELECT g.doc_id, CAST(len(g.s) AS BIGINT) AS n_shingles, coalesce(c.component_id, g.doc_id) AS component_id
FROM g LEFT JOIN n ON n.s = g.s LEFT JOIN c ON c.node = n.node
"""
