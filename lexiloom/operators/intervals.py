"""Joins of annotations by their places: which overlap, and which is the nearest that encloses another.

Annotations are dealt into buckets of their document, WIDTH code points wide, and meet within a bucket, so that the work follows
what lies close together and not the square of a document. Long documents spread over many keys. An annotation that
covers several buckets is in each; a pair is taken in the first bucket that it shares, so it comes once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Code points in a bucket.
WIDTH = 64


def bucket(place: Column, width: int) -> Column:
    return F.floor(place / width).cast("long")


def buckets(annotations: DataFrame, width: int, name: str = "__bucket") -> DataFrame:
    """annotations (start, end, ...) once for each bucket that they reach; an empty one is in that of its start."""
    last = F.greatest(bucket(F.col("end") - 1, width), bucket(F.col("start"), width))
    return annotations.select("*", F.explode(F.sequence(bucket(F.col("start"), width), last)).alias(name))


def overlaps(one: DataFrame, other: DataFrame, enclosing: bool = True, width: int = WIDTH) -> DataFrame:
    """Pairs of annotations (doc_id, start, end, ...) of one document that share a code point, other's columns after one's with other_ before their names.

    enclosing: whether what encloses one, starting before and ending after it, counts. An annotation with a null place or document meets none.
    """
    theirs = buckets(other, width, "__there").select(F.col("__there"), *[F.col(c).alias(f"other_{c}") for c in other.columns])
    ours = buckets(one, width)
    met = ours.join(theirs, (F.col("doc_id") == F.col("other_doc_id")) & (F.col("__bucket") == F.col("__there")))
    shared = met.where((F.col("start") < F.col("other_end")) & (F.col("other_start") < F.col("end")) & (F.col("__bucket") == F.greatest(bucket(F.col("start"), width), bucket(F.col("other_start"), width))))
    some = shared if enclosing else shared.where((F.col("other_start") >= F.col("start")) | (F.col("other_end") <= F.col("end")))
    return some.drop("__bucket", "__there", "other_doc_id")


def nearest_enclosing(spans: DataFrame, nodes: DataFrame, width: int = WIDTH) -> DataFrame:
    """Distinct spans (doc_id, start, end, ...) with the label and node_id of the nearest of nodes (doc_id, node_id, label, start, end) that starts at or before and ends at or after; null if none.

    The nearest is the one that starts last, then the shortest, then the one with the largest node_id. A span looks only into
    the bucket of its start, which a node that encloses it must reach, and the choice is made by an aggregate.
    """
    held = buckets(nodes, width).select(F.col("doc_id").alias("__doc"), "__bucket", F.struct(F.col("start").alias("s"), (-F.col("end")).alias("e"), "node_id", "label").alias("__node"))
    inside = (F.col("__node.s") <= F.col("start")) & (-F.col("__node.e") >= F.col("end"))
    met = spans.join(held, (F.col("doc_id") == F.col("__doc")) & (bucket(F.col("start"), width) == F.col("__bucket")) & inside, "left")
    return met.groupBy(*spans.columns).agg(F.max("__node").alias("__node")).select(*spans.columns, F.col("__node.label").alias("label"), F.col("__node.node_id").alias("node_id"))
