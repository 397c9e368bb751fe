"""Connected components of a link table, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kappaflow.llm.common import Scratch


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour larger than a node is linked to the smallest node among
    the node and its neighbours."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return (both.filter("b > a").join(least, "a")
            .select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node's smaller neighbours and the node itself are linked to the
    smallest of them (edges point from the larger node to the smaller)."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, label) for every node of the undirected ``edges`` (a, b bigint);
    the label is the smallest node of the component.

    Large-star and small-star rounds in turn (logarithmically many); each
    round is written to the scratch folder and the one before is removed.
    Minima are pre-aggregated, so a node with most of the links is no hot
    group; its joins are plain equi-joins that adaptive execution can split."""
    e = scratch.write(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                      .distinct(), f"{name}-0")
    seen = None
    k = 0
    while True:
        state = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(state) == seen or state[0] == 0:
            return e.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(
                e.select(F.col("b").alias("node"), F.col("b").alias("label"))).distinct()
        seen = tuple(state)
        e = scratch.write(_small_star(_large_star(e)), f"{name}-{k + 1}")
        scratch.drop(f"{name}-{k}")
        k += 1
