"""Connected components of a graph of links, by alternating large-star and small-star rounds.

Every round is a grouped minimum and an equi-join, so a hub with many links is spread by partial aggregation and
adaptive skew joins; nothing is collected. Each round is written to the shared folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.storage import Scratch


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges(a, b), a > b. Large: the larger neighbours of each node move to its least neighbour; small: the smaller ones and itself."""
    if large:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
        moved = edges.join(least, F.col("b") == F.col("n")).select("a", F.col("m").alias("b"))  # the larger neighbours of b are the a's of its edges
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), "m")
        moved = edges.join(least, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").unionByName(least.select(F.col("n").alias("a"), F.col("m").alias("b")))
    return moved.distinct()


def connected_components(links: DataFrame, scratch: Scratch, name: str = "components") -> DataFrame:
    """links(a, b) -> (node, root): the least node of each component, for every node with a link to another one. Nulls and loops are dropped."""
    edges = scratch.save(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), f"{name}-0")
    done, k = None, 0
    while True:
        k += 1
        edges = scratch.save(_star(_star(edges, True), False), f"{name}-{k}")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        scratch.drop(f"{name}-{k - 1}")
        if now == done:
            break
        done = now
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
