"""Near-duplicate detection with DartMinHash: weighted signatures made of hashed darts, and banded joins.

A document is a weighted set: its shingles (five consecutive words) with their numbers of occurrence. Its similarity to
another one is the weighted Jaccard similarity, sum of minima over sum of maxima.

Darts fall on the plane (element x weight) at random times. For each element and each weight region ([0,1), [1,2),
[2,4), ...) hashes of (element, region, n) give the exponential gap before the n-th dart, its weight position and its
coordinate of the signature. A dart hits a document if its position is below the document's weight of the element. The
earliest hit of each coordinate is kept. As darts do not depend on the document, two documents keep the same dart in a
coordinate with exactly the probability of their similarity. Only darts up to a time limit are thrown, which leaves about
one document in seven with an empty coordinate; for those the limit is doubled until none is empty.

Signatures are cut into bands; documents that agree in a band are candidates, and candidates are verified exactly with
their whole texts. With 30 bands of 5 coordinates a pair of similarity 0.8 is missed with probability 7e-6.

Groups of thousands are joined without listing their pairs. Equal texts are one node. In a band bucket each node is first
verified against one pivot, in a few rounds with different pivots; verified links are merged into components. Buckets
that still hold several components are then compared completely, whatever their size: of buckets with the same nodes one
is taken, and its nodes are dealt into blocks of bounded size, of which all pairs but those inside one component are
compared (`blocks`). A pair inside one component needs no check, as its link cannot change a class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.llm.blocks import compare_buckets
from ebbtide.llm.components import components
from ebbtide.llm.tables import ship, table
from ebbtide.llm.text import ODD, bounded, mix, powers, runs, slices, words
from ebbtide.session import materialise

SHINGLE, SIMILARITY, BANDS, ROWS, PIVOT_ROUNDS = 5, 0.8, 30, 5, 3
#: Text that is compared at once in a task (a single longer pair is compared alone).
PAIR_BYTES = 1 << 19


def shingles(data: np.ndarray, offsets: np.ndarray, length: int = SHINGLE):
    """Row, hash and count of each distinct shingle, sorted; a shorter text is one shingle of all its words."""
    hashes, _, _, at = words(data, offsets)
    n = np.diff(at)
    rows, found = [], []
    whole = runs(hashes, length)
    owner = np.repeat(np.arange(len(n)), n)
    if len(whole):
        inside = owner[: len(whole)] == owner[length - 1 :]
        rows.append(owner[: len(whole)][inside])
        found.append(whole[inside])
    short = np.flatnonzero((n > 0) & (n < length))
    rows.append(short)
    found += [mix(runs(hashes[at[r] : at[r + 1]], int(n[r])) + n[r : r + 1].astype(np.uint64)) for r in short]
    row, value = np.concatenate(rows), np.concatenate([np.zeros(0, np.uint64), *found])
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    first = np.flatnonzero(new)
    return row[first], value[first], np.diff(np.append(first, len(row)))


def unit(x: np.ndarray) -> np.ndarray:
    """Hashes as numbers in (0, 1)."""
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def dart_signatures(row: np.ndarray, element: np.ndarray, weight: np.ndarray, n_rows: int, k: int) -> np.ndarray:
    """An n_rows x k table with the identity of the earliest dart of each coordinate; a row without elements is 0."""
    total = np.bincount(row, weight, n_rows)
    best = np.full(n_rows * k, np.inf)
    dart = np.zeros(n_rows * k, np.uint64)
    limit = np.where(total > 0, (np.log(k) + 2) / np.maximum(total, 1e-300), 0.0)
    region_count = np.where(weight <= 1, 1, 1 + np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64))
    open_rows = total > 0
    while open_rows.any():
        use = np.flatnonzero(open_rows[row])
        rep = np.repeat(use, region_count[use])
        region = np.arange(len(rep)) - np.repeat(np.cumsum(region_count[use]) - region_count[use], region_count[use])
        low = np.where(region == 0, 0.0, 2.0 ** (region - 1))
        width = np.where(region == 0, 1.0, low)
        seed = mix(element[rep] + ODD * (region.astype(np.uint64) + np.uint64(1)))
        doc, most, time, n = row[rep], weight[rep], np.zeros(len(rep)), 0
        while len(doc):
            n += 1
            h = mix(seed + mix(np.array([n], np.uint64)))
            time = time - np.log(unit(h)) / (k * width)
            live = time <= limit[doc]
            doc, most, time, seed, h, low, width = (
                x[live] for x in (doc, most, time, seed, h, low, width))
            second = mix(h ^ np.uint64(0xA0761D6478BD642F))
            hit = low + width * unit(second) < most
            spot = doc[hit] * k + (mix(second ^ ODD)[hit] % np.uint64(k)).astype(np.int64)
            np.minimum.at(best, spot, time[hit])
            won = best[spot] == time[hit]
            dart[spot[won]] = h[hit][won]
        empty = np.isinf(best.reshape(n_rows, k)).any(1) & (total > 0)
        limit = np.where(empty, limit * 2, limit)
        open_rows = empty
    return dart.reshape(n_rows, k)


def band_hashes(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    part = signature.reshape(len(signature), bands, rows)
    summed = (part * powers(ODD, rows)).sum(2, dtype=np.uint64)
    return mix(summed + mix(np.arange(1, bands + 1, dtype=np.uint64)))


def signed(docs: DataFrame, key: str, text: str, bands: int, rows: int) -> DataFrame:
    """`key`, `sha` (of the text) and the band hashes of each row; a text without words has no bands."""
    picked = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")).select(
        "key", F.unhex(F.sha2("text", 256)).alias("sha"), "text")

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in slices(batch.column(2), 1 << 20, 256):
                row, value, count = shingles(data, offsets)
                made = band_hashes(
                    dart_signatures(row, value, count.astype(np.float64), last - first, bands * rows), bands, rows)
                has = np.zeros(last - first, bool)
                has[row] = True
                ends = np.concatenate([[0], np.cumsum(has * bands)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[first:last], batch.column(1)[first:last],
                     pa.ListArray.from_arrays(pa.array(ends), pa.array(made[has].view(np.int64).ravel()))],
                    names=["key", "sha", "bands"])

    kind = picked.schema["key"].dataType.simpleString()
    return picked.mapInArrow(sign, f"key {kind}, sha binary, bands array<long>")


def weighted_jaccard(pairs: DataFrame) -> DataFrame:
    """Adds `similarity` to pairs (u, v, text_u, text_v), over whole texts."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last in bounded([batch.column(c) for c in (2, 3)], PAIR_BYTES):
                part = batch.slice(first, last - first)
                sides = []
                for c in (2, 3):
                    found = [(row + at, value, count) for at, _, data, offsets in slices(part.column(c))
                             for row, value, count in [shingles(data, offsets)]]
                    sides.append([np.concatenate(x) for x in zip(*found)])
                row, value, count = (np.concatenate(x) for x in zip(*sides))
                order = np.lexsort((value, row))
                row, value, count = row[order], value[order], count[order]
                same = (row[1:] == row[:-1]) & (value[1:] == value[:-1])
                shared = np.bincount(row[1:][same], np.minimum(count[1:], count[:-1])[same], part.num_rows)
                total = np.bincount(row, count, part.num_rows)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(shared / np.maximum(total - shared, 1))],
                    names=["u", "v", "similarity"])

    return pairs.mapInArrow(compare, "u long, v long, similarity double")


def verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Pairs (u, v) with whether their texts are similar enough."""
    left = texts.select(F.col("node").alias("u"), F.col("text").alias("text_u"))
    right = texts.select(F.col("node").alias("v"), F.col("text").alias("text_v"))
    both = pairs.join(left, "u").join(right, "v").select("u", "v", "text_u", "text_v")
    scored = weighted_jaccard(both)
    return scored.select("u", "v", (F.col("similarity") >= similarity - 1e-9).alias("linked"))


def layered(texts: pa.Array):
    """Row and hash of each shingle, a repeated one once for each occurrence, and shingles per row."""
    found = [(row + first, value, count) for first, last, data, offsets in slices(texts)
             for row, value, count in [shingles(data, offsets)]]
    row, value, count = (np.concatenate(x) for x in zip(*found))
    rep = np.repeat(np.arange(len(row)), count)
    layer = np.arange(len(rep)) - np.repeat(np.cumsum(count) - count, count)
    return row[rep], value[rep] + ODD * layer.astype(np.uint64), np.bincount(row, count, len(texts))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY,
                    bands: int = BANDS, rows: int = ROWS, with_sha: bool = False) -> DataFrame:
    """`key`, `class_id` and `class_size` for each input row (and the SHA-256 of its text, if wanted).

    The class of a row is its connected component of pairs with a weighted Jaccard similarity of word 5-shingles of
    `similarity` or more, and of equal texts; `class_id` is the smallest key in it (NULL only if no row has one). A text
    of fewer than five words is one shingle. NULL is the empty text; texts without words are only joined to equal ones.
    """
    ship(docs.sparkSession)
    marked = materialise(signed(docs, key, text, bands, rows), "signed")
    nodes = marked.groupBy("sha").agg(F.min("key").alias("least"), F.first("bands").alias("bands"),
                                      F.count(F.lit(1)).alias("copies"))
    nodes = materialise(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    members = nodes.select("node", F.explode("bands").alias("band"))
    several = members.groupBy("band").count().where("count > 1").select("band")
    members = materialise(members.join(materialise(several, "several"), "band"), "members")

    wanted = nodes.join(members.select("node").distinct(), "node", "left_semi").select("node", "sha", "least")
    found = docs.select(F.col(key).alias("least"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    found = found.withColumn("sha", F.unhex(F.sha2("text", 256)))
    same = F.coalesce(F.col("least").cast("string"), F.lit("null"))
    texts = found.withColumn("least", same).join(wanted.withColumn("least", same), ["sha", "least"])
    texts = texts.groupBy("node").agg(F.first("text").alias("text"))
    texts = materialise(texts.withColumn("size", F.octet_length("text") / 4), "texts")

    class_of = nodes.sparkSession.createDataFrame([], "node long, root long")
    links = tried = nodes.sparkSession.createDataFrame([], "u long, v long")
    for step in range(PIVOT_ROUNDS + 1):
        at = members.join(class_of, "node", "left").withColumn("root", F.coalesce("root", "node"))
        at = materialise(at, "at")
        roots = at.groupBy("band").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a < b").select("band")
        mixed = materialise(at.join(materialise(roots, "mixed-bands"), "band", "left_semi"), "mixed")
        if mixed.isEmpty():
            break
        if step < PIVOT_ROUNDS:  # one pivot for each bucket, another one in each round
            turn = F.xxhash64("node", F.lit(step)) if step else F.col("node")
            pivots = materialise(mixed.groupBy("band").agg(
                F.min(F.struct(turn.alias("turn"), "node", "root")).alias("p")), "pivots")
            pairs = mixed.join(pivots, "band").where("root != p.root").select(
                F.greatest("node", "p.node").alias("u"), F.least("node", "p.node").alias("v"))
            pairs = pairs.distinct().join(tried, ["u", "v"], "left_anti")
            checked = materialise(verified(materialise(pairs, "pairs"), texts, similarity), "checked")
            tried = tried.unionByName(checked.select("u", "v"))
            links = links.unionByName(checked.where("linked").select("u", "v"))
        else:
            similar = lambda both, one, other: both >= (similarity - 1e-9) * (one + other - both)
            links = links.unionByName(materialise(compare_buckets(mixed, texts, "text", layered, similar), "joined"))
        class_of = materialise(components(links), "classes")

    rooted = nodes.join(class_of, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rooted = materialise(rooted.select("sha", "root", "least", "copies"), "rooted")
    classes = rooted.groupBy("root").agg(F.min("least").alias("class_id"), F.sum("copies").alias("class_size"))
    named = materialise(rooted.join(materialise(classes, "sizes"), "root").select("sha", "class_id", "class_size"),
                        "named")
    out = marked.select("key", "sha").join(named, "sha")
    return out.select(F.col("key").alias(key), "class_id", "class_size", *(["sha"] if with_sha else []))


def drop_near(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Of each class the row with the smallest key, with all columns; a row without a key always stays.

    Rows that share the smallest key of their class all stay; exact deduplication comes before this.
    """
    as_text = F.coalesce(F.col(key).cast("string"), F.lit("null")).alias("__key")
    marks = near_duplicates(docs, key, text, with_sha=True).where(F.col(key) > F.col("class_id"))
    marks = materialise(marks.select(as_text, F.col("sha").alias("__sha")).distinct(), "dropped")
    sha = F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
    left = docs.withColumn("__key", as_text).withColumn("__sha", sha).join(marks, ["__key", "__sha"], "left_anti")
    return left.select(*(F.col(f"`{c}`") for c in docs.columns))


def op1_near_duplicates(spark, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"))


OP1_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
n AS (SELECT text, min(doc_id) AS node, any_value(w) AS w, count(*) AS copies FROM d GROUP BY text),
s AS (
  SELECT node, array_to_string(w[i : i + 4], ' ') AS g, count(*) AS c
  FROM (SELECT node, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM n WHERE len(w) > 0)
  GROUP BY ALL),
t AS (SELECT node, sum(c) AS total FROM s GROUP BY node),
p AS (
  SELECT a.node AS u, b.node AS v, sum(least(a.c, b.c)) AS shared
  FROM s a JOIN s b ON a.g = b.g AND a.node < b.node GROUP BY ALL),
e AS (
  SELECT u, v FROM p JOIN t x ON x.node = u JOIN t y ON y.node = v
  WHERE shared >= 0.8 * (x.total + y.total - shared) - 1e-9),
b AS (SELECT u, v FROM e UNION SELECT v, u FROM e),
r AS (
  SELECT node, node AS root FROM n
  UNION
  SELECT b.v, r.root FROM r JOIN b ON b.u = r.node),
c AS (SELECT node, min(root) AS class_id FROM r GROUP BY node),
z AS (SELECT class_id, CAST(sum(copies) AS BIGINT) AS class_size FROM c JOIN n USING (node) GROUP BY class_id)
SELECT d.doc_id, c.class_id, z.class_size FROM d JOIN n ON n.text = d.text JOIN c ON c.node = n.node
JOIN z ON z.class_id = c.class_id
"""
