"""Connected components of a graph of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import dropped, written


def _stars(links: DataFrame, large: bool) -> DataFrame:
    """One step. links: (a, b) with a > b. Large: every larger neighbour of a node goes to its least one; small: the smaller ones do."""
    if large:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("least")).withColumn("least", F.least("a", "least"))
        # Written by itself, so that Spark can split the neighbours of a node with very many.
        moved = both.filter("b > a").join(least.withColumnRenamed("a", "a2"), F.col("a") == F.col("a2")).select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        least = links.groupBy("a").agg(F.min("b").alias("least"))
        moved = links.join(least.withColumnRenamed("a", "a2"), F.col("a") == F.col("a2")).select(F.col("b").alias("a"), F.col("least").alias("b"))
        moved = moved.unionByName(least.select("a", F.col("least").alias("b")))
    return moved.filter("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component): the least node that each node with a link can reach, itself included. links: (a, b), any order, repeats and loops allowed."""
    now = written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "links")
    seen = None
    while True:
        last, now = now, written(_stars(_stars(now, large=True), large=False), "links")
        dropped(last)
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if mark == seen:
            break
        seen = mark
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
