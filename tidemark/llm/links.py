"""Connected components of link tables as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.frames import materialize


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node each node of `links` (a, b) is connected with.

    Large-star and small-star rounds: every node points its greater, then its smaller neighbours at the smallest
    one, until the links are stars. A round is two aggregates with joins; hubs are split by skew joins, and
    no neighbourhood is collected. Each round is written, which cuts the lineage.
    """

    def towards(edges: DataFrame, upper: bool) -> DataFrame:
        """Each node's neighbours that are greater (upper) or smaller, pointed at its smallest neighbour or itself."""
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        smallest = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        side = both.filter(F.col("b") > F.col("a") if upper else F.col("b") < F.col("a"))
        moved = side.join(smallest, "a").select(F.col("b").alias("x"), F.col("m").alias("y"))
        if not upper:
            moved = moved.union(smallest.select(F.col("a").alias("x"), F.col("m").alias("y")))
        return moved.filter("x != y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()

    edges = materialize(links.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    if edges.isEmpty():
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    sign = F.struct(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")))
    before = None
    while (now := edges.select(sign.alias("s")).first().s) != before:
        before = now
        edges = materialize(towards(edges, True), "links")
        edges = materialize(towards(edges, False), "links")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
