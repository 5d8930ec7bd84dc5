"""n-gram counts over a stream of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.functions.text import ngrams_of
from lexiloom.operators.annotate import sentences


def streaming_counts(docs: DataFrame, max_n: int = 2) -> DataFrame:
    """(term, freq) of a streaming table (doc_id, text), for output modes complete and update."""
    runs = sentences(docs).select(F.explode(ngrams_of(F.col("lemmas"), 1, max_n)).alias("term"))
    return runs.groupBy(F.array_join("term", " ").alias("term")).agg(F.count(F.lit(1)).alias("freq"))
