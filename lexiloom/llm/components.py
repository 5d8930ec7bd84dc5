"""Connected components of a distributed graph by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard, tables_of


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of edges (a, b), with component the least node reachable; nodes that are their own component are left out.

    Each pass gives every node's larger neighbours its least neighbour, then does the same for the smaller ones; edges
    only ever shrink towards stars around the least nodes, and a pass that changes nothing ends it. A pass is a few joins
    and aggregates on the ends of the edges; its result is written, so lineage stays short.
    """
    with tables_of() as written:
        now = cut(edges.where("a != b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct())
        mark = None
        while True:
            both = now.unionByName(now.select(F.col("u").alias("v"), F.col("v").alias("u")))
            least = both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("m"))
            large = both.join(least, "v").where("u > v").select(F.col("u").alias("v"), F.col("m").alias("u")).where("v != u").distinct()
            down = large.groupBy("v").agg(F.min("u").alias("m"))
            small = large.join(down, "v").where("u != m").select(F.col("u").alias("v"), F.col("m").alias("u"))
            now = cut(small.unionByName(down.select("v", F.col("m").alias("u"))).where("v != u").distinct())
            discard(now.sparkSession, written, kept=1)  # the pass before
            seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
            if seen == mark:
                return now.select(F.col("v").alias("node"), F.col("u").alias("component"))
            mark = seen


def roots(pointers: DataFrame) -> DataFrame:
    """(node, component) where each row of pointers (node, component) names a smaller node: follows them to the end by doubling."""
    with tables_of() as written:
        now = cut(pointers)
        while True:
            further = now.select(F.col("node").alias("component"), F.col("component").alias("__next"))
            jumped = cut(now.join(further, "component", "left").select("node", F.coalesce("__next", "component").alias("component"), F.col("__next").isNotNull().alias("moved")))
            discard(now.sparkSession, written, kept=1)
            now = jumped.select("node", "component")
            if not jumped.where("moved").limit(1).count():
                return now
