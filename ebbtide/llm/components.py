"""Connected components of a link table that no machine holds: alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.session import materialise


def star(links: DataFrame, small: bool) -> DataFrame:
    """Links (u > v). Large star: neighbours above a node move to its smallest neighbour. Small star: those below do."""
    if small:
        directed = links.select(F.col("u").alias("n"), F.col("v").alias("m"))
    else:
        both = links.select(F.explode(F.array(F.struct(F.col("u").alias("n"), F.col("v").alias("m")),
                                              F.struct(F.col("v").alias("n"), F.col("u").alias("m")))).alias("e"))
        directed = both.select("e.n", "e.m")
    least = directed.groupBy("n").agg(F.least(F.min("m"), F.col("n")).alias("low"))
    near = directed.join(materialise(least, "least"), "n")
    if small:
        moved = near.select(F.col("m").alias("u"), F.col("low").alias("v")).unionByName(
            near.select(F.col("n").alias("u"), F.col("low").alias("v")))
    else:
        moved = near.where("m > n").select(F.col("m").alias("u"), F.col("low").alias("v"))
    return moved.where("u > v").distinct()


def components(links: DataFrame) -> DataFrame:
    """`node`, `root` (the smallest node of its component) for every node of the links (u, v); others are not listed.

    The number of links never grows, each round is an aggregate and a join on a node, and nothing but a count reaches
    the driver. It ends when every link leads to a root, after a number of rounds about the logarithm of the component's
    diameter. Loops and repeated links do no harm; no links give no rows.
    """
    links = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct()
    links = materialise(links, "links")
    while True:
        inner = links.select(F.col("v").alias("u")).join(links.select("u"), "u", "left_semi")
        several = links.groupBy("u").count().where("count > 1")
        if inner.isEmpty() and several.isEmpty():
            break
        links = materialise(star(links, small=False), "links")
        links = materialise(star(links, small=True), "links")
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
