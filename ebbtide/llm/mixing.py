"""Mixing sources to target weights with hash-threshold histograms.

Each source has a budget of words. A budget is a whole number of passes over the source and a part of one pass. For the
part, each document has a fixed point: the hexadecimal MD5 of its key and text. Documents below the source's threshold are
taken once more. The threshold comes from histograms, not from sorting: sizes are summed by source and the first digits of the
point; only the bucket in which the budget ends is summed again, by the next digits. A larger budget has a larger
threshold, so mixes are nested.

What is shuffled is at most sources x buckets rows for each task; the hot source is combined before. Only sources with
their thresholds (a table of its own) meet the documents again. Reruns agree, in any order and partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbtide.llm.tables import table
from ebbtide.session import materialise

#: Fixed values of the registered mix: weights that repeat over the sources, share of all words, most copies of a text.
WEIGHTS, SHARE, MOST_COPIES = (5, 2, 1), 1.5, 2
DIGITS, ALL_DIGITS = 3, 32


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def point(key: str = "doc_id", text: str = "text") -> Column:
    """Of key and text, so that different texts of a frequent key lie apart."""
    named = F.coalesce(F.col(key).cast("string"), F.lit("null"))
    return F.md5(F.concat(named, F.lit(" "), F.coalesce(F.col(text), F.lit(""))).cast("binary"))


def water_fill(sources: DataFrame, share: float, most: int) -> DataFrame:
    """Adds `target`: a share of all sizes by `weight`, at most `most` times a source's `source_size`; what a full source
    leaves goes to the others by weight until none is above. One row per source.

    All targets are min(most * size, level * weight). Taking sources by size per weight, the level that holds when the
    first k are full is known from running sums. It grows with k while the next source is full too, and falls after that:
    of the levels that leave the next source unfilled the largest is the right one.
    """
    cap = (F.col("source_size") * most).cast("double")
    budget = F.sum("source_size").over(Window.partitionBy("one")) * F.lit(share)
    ordered = Window.partitionBy("one").orderBy(cap / F.col("weight"), "place").rowsBetween(
        Window.unboundedPreceding, -1)
    weights = F.sum("weight").over(Window.partitionBy("one"))
    s = sources.withColumn("one", F.lit(1)).select(
        "*", cap.alias("cap"), budget.alias("budget"), weights.alias("weights"),
        F.coalesce(F.sum(cap).over(ordered), F.lit(0.0)).alias("full"),
        F.coalesce(F.sum("weight").over(ordered), F.lit(0)).alias("full_weight"))
    s = s.withColumn("level", (F.col("budget") - F.col("full")) / (F.col("weights") - F.col("full_weight")))
    holds = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))
    level = F.max(holds).over(Window.partitionBy("one"))
    target = F.when(level.isNull(), F.col("cap")).otherwise(F.least("cap", level * F.col("weight")))
    return s.withColumn("target", F.round(target, 6)).drop(
        "one", "cap", "budget", "weights", "full", "full_weight", "level")


def source_targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST_COPIES) -> DataFrame:
    """Sources in code point order, NULL last, with weight, size, target, whole passes and words of the last part."""
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    filled = water_fill(totals.withColumn("place", place).withColumn("weight", weight), share, most)
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    return filled.withColumn("passes", passes.cast("long")).withColumn(
        "part", F.col("target") - F.col("passes") * F.col("source_size"))


def thresholds(sized: DataFrame, targets: DataFrame, digits: int = DIGITS) -> DataFrame:
    """For each source `below`: documents whose point is smaller are taken once more.

    `prefix` is the bucket in which the budget ends, `left` what is left for it. A source is settled when that bucket
    is a single point: it is taken if that comes closer to the budget than leaving it.
    """
    open_ = targets.where("part > 0").select("source", F.col("part").alias("left"), F.lit("").alias("prefix"))
    open_ = materialise(open_, "open")
    settled = []
    for depth in range(digits, ALL_DIGITS + digits, digits):
        bucket = F.substring("point", 1, depth)
        inside = sized.join(open_, sized["source"].eqNullSafe(open_["source"])).where(
            F.col("point").startswith(F.col("prefix")))
        sums = inside.groupBy(open_["source"], "left", bucket.alias("bucket")).agg(
            F.sum("size").alias("words"), F.min("point").alias("first"), F.max("point").alias("last"))
        run = Window.partitionBy("source").orderBy("bucket")
        sums = sums.withColumn("upto", F.sum("words").over(run))
        edge = sums.where("upto > left").withColumn("n", F.row_number().over(run)).where("n = 1").withColumn(
            "left", F.col("left") - F.col("upto") + F.col("words"))
        edge = materialise(edge, "edge")
        near = F.when(F.col("words") - F.col("left") < F.col("left"), F.concat("last", F.lit("~"))).otherwise(
            F.col("first"))
        settled.append(edge.where("first = last").select("source", near.alias("below")))
        open_ = edge.where("first < last").select("source", "left", F.col("bucket").alias("prefix"))
        if open_.isEmpty():
            break
    out = settled[0]
    for more in settled[1:]:
        out = out.unionByName(more)
    return out


def mixed(docs: DataFrame, key: str, text: str, source: str, weights, share: float, most: int) -> DataFrame:
    """All columns of `docs`, and a struct `__mix` (key, source, size, point, source_size, target, taken) beside them."""
    sized = docs.withColumn("__mix", F.struct(
        F.col(key).alias("key"), F.col(source).alias("source"), word_count(text).alias("size"),
        point(key, text).alias("point")))
    narrow = materialise(sized.select("__mix.source", "__mix.size", "__mix.point"), "sizes")
    targets = materialise(source_targets(narrow, weights, share, most), "targets")
    below = thresholds(narrow, targets).select(F.col("source").alias("s"), "below")
    plan = targets.join(below, F.col("source").eqNullSafe(F.col("s")), "left").select(
        F.struct("source", "source_size", "target", "passes", "below").alias("__plan"))
    joined = sized.join(materialise(plan, "plan"), F.col("__mix.source").eqNullSafe(F.col("__plan.source")), "left")
    copies = F.col("__plan.passes") + F.when(F.col("__mix.point") < F.col("__plan.below"), 1).otherwise(0)
    return joined.withColumn("__mix", F.struct(
        "__mix.*", "__plan.source_size", "__plan.target", (copies * F.col("__mix.size")).alias("taken"))).drop("__plan")


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS,
        share: float = SHARE, most: int = MOST_COPIES) -> DataFrame:
    """`key`, `size`, `source_size`, `target` and `taken` (words taken, repeats counted) for each input row.

    NULL texts have size 0; NULL is a source of its own; rows with the same key and text are taken together; an empty table
    gives no rows. The size of a source differs from its target by at most half of the documents at one point.
    """
    done = mixed(docs.select(key, text, source), key, text, source, weights, share, most)
    return done.select(F.col("__mix.key").alias(key), "__mix.size", "__mix.source_size", "__mix.target", "__mix.taken")


def mix_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS,
                  share: float = SHARE, most: int = MOST_COPIES) -> DataFrame:
    """The documents of the mix with all their columns, and `mix_size`, `mix_target`, `mix_taken`.

    A document that is taken more than once has one row, whose `mix_taken` is a multiple of its `mix_size`.
    """
    done = mixed(docs, key, text, source, weights, share, most).where("__mix.taken > 0")
    told = [F.col(f"__mix.{c}").alias(f"mix_{c}") for c in ("size", "target", "taken")]
    return done.select(*(F.col(f"`{c}`") for c in docs.columns), *told)


def op5_mixing(spark, folder: str) -> DataFrame:
    return mix(table(spark, folder, "documents"))


OP5_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ' ' || coalesce(text, '')) AS point,
    CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
src AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    row_number() OVER (ORDER BY source IS NULL, source COLLATE "C") - 1 AS place FROM sized GROUP BY source),
w AS (
  SELECT *, CAST(2 * source_size AS DOUBLE) AS cap, CASE place % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM src),
f AS (
  SELECT *, sum(source_size) OVER () * 1.5 AS budget, sum(weight) OVER () AS weights,
    coalesce(sum(cap) OVER o, 0) AS filled, coalesce(sum(weight) OVER o, 0) AS filled_weight
  FROM w WINDOW o AS (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (
  SELECT *, CAST(budget - filled AS DOUBLE) / CAST(weights - filled_weight AS DOUBLE) AS lv FROM f),
m AS (
  SELECT *, max(CASE WHEN lv * weight <= cap THEN lv END) OVER () AS water FROM l),
t AS (
  SELECT source, source_size, round(CASE WHEN water IS NULL THEN cap ELSE least(cap, water * weight) END, 6) AS target
  FROM m),
p AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS passes FROM t),
r AS (
  SELECT s.doc_id, s.size, p.source_size, p.target, p.passes, p.target - p.passes * p.source_size AS part,
    sum(s.size) OVER (PARTITION BY s.source ORDER BY s.point RANGE UNBOUNDED PRECEDING) AS upto,
    sum(s.size) OVER (PARTITION BY s.source, s.point) AS here
  FROM sized s JOIN p ON s.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, CAST(passes * size + CASE
    WHEN part <= 0 THEN 0 WHEN upto <= part THEN size
    WHEN upto - here <= part AND upto - part < part - (upto - here) THEN size ELSE 0 END * 1 AS BIGINT) AS taken
FROM r
"""
