"""Exact deduplication by deterministic block naming.

Each text (without white space) is cut into blocks of fixed size. The distinct blocks are sorted, and a block's place in
the order is its integer name. Then pairs of adjacent names are sorted and named in the same way, again and again, until
each document has one name. Two documents have the same depth and name exactly if their texts are equal: no hash decides.

A 64-bit fingerprint only carries a name from the sorted blocks back to the documents, because a long block need not be
shuffled twice for that. Fingerprints shared by different blocks are found, and there the blocks themselves are joined.

Only DataFrame operations. Names are written to the shared folder before they are used, so a lost executor cannot change
them. What repeats is combined before each shuffle; joins back to the documents are plain joins, which adaptive execution
splits where a name is very frequent.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide.llm.tables import table
from ebbtide.session import materialise

BLOCK_BYTES = 4096
#: Deleted from a text before it is compared.
SPACES = " \t\n\x0b\x0c\r"


def named(distinct: DataFrame, keys: list[str], name: str = "name") -> DataFrame:
    """Distinct rows sorted inside the partitions that the aggregate made; partition and place give the name."""
    return distinct.sortWithinPartitions(*keys).withColumn(name, F.monotonically_increasing_id())


def cut_into_blocks(rows: DataFrame, size: int) -> DataFrame:
    """`block`, `place`, `n_blocks` for each block of `normal`; an empty text has one empty block."""
    raw = rows.withColumn("raw", F.encode("normal", "UTF-8"))
    raw = raw.withColumn("n_blocks", F.greatest(F.lit(1), F.ceil(F.length("raw") / F.lit(size))).cast("int"))
    blocks = F.transform(
        F.sequence(F.lit(0), F.col("n_blocks") - 1),
        lambda i: F.struct(i.alias("place"), F.substring(F.col("raw"), i * F.lit(size) + 1, F.lit(size)).alias("block")),
    )
    kept = [c for c in rows.columns if c != "normal"]
    return raw.select(*kept, "n_blocks", F.explode(blocks).alias("b")).select(*kept, "n_blocks", "b.place", "b.block")


def identities(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    block_bytes: int = BLOCK_BYTES,
    fingerprint: Callable[[Column], Column] = F.xxhash64,
) -> DataFrame:
    """One row per input row: `key`, `n_points` (code points of the text), `text_sha256` (of the text without white
    space), and its identity `depth`, `name`. NULL counts as empty; repeated rows stay."""
    picked = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    normal = F.translate("text", SPACES, "")
    blocks = cut_into_blocks(picked.select(normal.alias("normal")), block_bytes).select("block")
    distinct = blocks.select(fingerprint(F.col("block")).alias("print"), "block").distinct()
    names = materialise(named(distinct, ["block"]).select("print", "name"), "block-names")
    shared = materialise(names.groupBy("print").count().where("count > 1").select("print"), "shared-prints")

    rows = picked.select(
        F.monotonically_increasing_id().alias("row"), "key", F.char_length("text").cast("long").alias("n_points"),
        F.xxhash64("text").alias("row_hash"), normal.alias("normal")).withColumn("text_sha256", F.sha2("normal", 256))
    placed = cut_into_blocks(rows, block_bytes).withColumn("print", fingerprint(F.col("block")))
    if shared.isEmpty():
        level = placed.drop("block").join(names, "print")
    else:
        mixed = blocks.select(fingerprint(F.col("block")).alias("print"), "block").join(shared, "print", "left_semi")
        apart = materialise(
            named(mixed.distinct(), ["block"]).select("print", "block", (-1 - F.col("name")).alias("name")), "apart")
        marked = materialise(placed.join(shared.withColumn("is_shared", F.lit(True)), "print", "left"), "marked")
        level = marked.where("is_shared is null").drop("block", "is_shared").join(
            names.join(shared, "print", "left_anti"), "print").unionByName(
            marked.where("is_shared").drop("is_shared").join(apart, ["print", "block"]).drop("block"))
    level = materialise(level.drop("print"), "level")
    told = ["key", "n_points", "row_hash", "text_sha256"]
    carried = ["row", *told, "n_blocks"]
    done, depth = [], 0
    while True:
        done.append(level.where("n_blocks = 1").select(*told, F.lit(depth).alias("depth"), "name"))
        level = level.where("n_blocks > 1")
        if level.isEmpty():
            break
        depth += 1
        half = F.floor(F.col("place") / 2).cast("int")
        side = lambda k: F.max(F.when(F.col("place") % 2 == k, F.col("name")))
        both = ["left", "alone", "right"]
        pairs = level.groupBy(*carried, half.alias("half")).agg(side(0).alias("left"), side(1).alias("right"))
        pairs = pairs.withColumn("alone", F.col("right").isNull()).withColumn("right", F.coalesce("right", F.lit(0)))
        pairs = materialise(pairs, "pairs")
        names = materialise(named(pairs.select(*both).distinct(), both), "pair-names")
        level = materialise(
            pairs.join(names, both).select(
                *carried[:-1], F.floor((F.col("n_blocks") + 1) / 2).cast("int").alias("n_blocks"),
                F.col("half").alias("place"), "name"), "level")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.withColumnRenamed("key", key)


def grouped(rows: DataFrame, key: str) -> DataFrame:
    """Each row of `identities` with the row that stays and the number of rows of its group."""
    order = F.struct((-F.col("n_points")).alias("less"), F.col(key).isNull().alias("no_key"), F.col(key).alias("key"))
    groups = rows.groupBy("depth", "name").agg(F.min(order).alias("best"), F.count(F.lit(1)).alias("group_size"))
    stays = (F.col("best.less") == -F.col("n_points")) & F.col(key).eqNullSafe(F.col("best.key"))
    return rows.join(materialise(groups, "groups"), ["depth", "name"]).withColumn("kept", stays)


def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """`key`, `keep_id`, `group_size`, `kept`, `text_sha256` for each input row.

    Of equal texts the row with the most code points in the original text stays, then the smallest key (a NULL key comes
    last). Rows that agree in key and length too are one choice: all of them say `kept` (`drop_exact` keeps one).
    """
    rows = materialise(identities(docs, key, text, **options), "identities")
    return grouped(rows, key).select(key, F.col("best.key").alias("keep_id"), "group_size", "kept", "text_sha256")


def drop_exact(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The row of each group that stays, with all columns; of rows that agree in key and length one stays, whatever their
    white space."""
    rows = materialise(identities(docs, key, text), "identities")
    as_text = F.coalesce(F.col(key).cast("string"), F.lit("null"))
    marks = grouped(rows, key).where("kept").groupBy("depth", "name").agg(F.min(
        F.struct(as_text.alias("__key"), F.col("row_hash").alias("__hash"))).alias("stays")).select("stays.*")
    kept = docs.withColumn("__key", as_text).withColumn("__hash", F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    kept = kept.join(marks, ["__key", "__hash"], "left_semi")
    return kept.dropDuplicates(["__key", "__hash"]).select(*(F.col(f"`{c}`") for c in docs.columns))


def op9_exact_dedup(spark, folder: str) -> DataFrame:
    return exact_groups(table(spark, folder, "documents"))


OP9_SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
    regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS normal
  FROM documents),
r AS (
  SELECT *, count(*) OVER (PARTITION BY normal) AS group_size,
    first_value(doc_id) OVER (PARTITION BY normal ORDER BY points DESC, doc_id NULLS LAST) AS keep_id,
    first_value(points) OVER (PARTITION BY normal ORDER BY points DESC, doc_id NULLS LAST) AS keep_points
  FROM n)
SELECT doc_id, keep_id, group_size,
  doc_id IS NOT DISTINCT FROM keep_id AND points = keep_points AS kept, sha256(normal) AS text_sha256
FROM r
"""
