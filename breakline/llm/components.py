"""Connected components of a distributed list of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """`links(a, b)` of non-null longs to (node, component): the smallest node that links lead to.

    Alternates two steps until the links are stars: every node hands its larger neighbours to
    its smallest one, then every node hands its smaller neighbours to the smallest of them. Minima are
    combined before each shuffle, and a node with very many links is one side of an adaptive join, not
    a group. Each step is written to the shared folder. Loops and repeated links do no harm.
    """
    edges = saved(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    for _ in range(rounds):
        if are_stars(edges):
            return edges.toDF("node", "component").union(edges.select("v", F.col("v").alias("component")).distinct())
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        handed = large.join(least, "u")
        small = handed.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()
        edges = saved(small, "links")
    raise RuntimeError(f"the components did not settle in {rounds} rounds")


def are_stars(edges: DataFrame) -> bool:
    """Whether every larger node u of the distinct `edges(u, v)` has one edge, to a node that has no smaller one."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).union(edges.select("v", F.lit(0), F.lit(1)))
    counted = ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return counted.where("down > 1 or down = 1 and up = 1").count() == 0


def joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """`labels(node, component)`, as `components` gives them, after more `links(a, b)` between nodes, old or new.

    Only the components that the links touch are gone through again, each as one node.
    """
    ends = links.join(labels.toDF("a", "p"), "a", "left").join(labels.toDF("b", "q"), "b", "left")
    moved = components(ends.select(F.coalesce("p", "a").alias("a"), F.coalesce("q", "b").alias("b")))
    old = labels.join(moved.toDF("component", "to"), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    return old.union(moved.join(labels, "node", "left_anti"))
