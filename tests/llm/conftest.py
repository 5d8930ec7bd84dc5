import pytest
from pyspark.sql import functions as F

LONG = "word " * 30_000 + "x" * 100_000
#: (doc_id, text, source): null, empty and very long texts, ties, repeated rows, a null id and a null source.
ROWS = [
    (1, "the quick brown fox jumps over the lazy dog near the river bank today", "a"),
    (2, "the quick brown fox jumps over the lazy dog near the river bank today", "a"),
    (3, None, "b"),
    (4, "", "b"),
    (5, "one", None),
    (6, LONG, "a"),
    (7, "Mail me: jo.doe@mail.example.com or +1 (234) 555-7713, 4111 1111 1111 1111 from 10.0.0.255", "b"),
    (8, 'token = "ede43f42c939b6405768150e0411590525cf8811" next', None),
    (8, 'token = "ede43f42c939b6405768150e0411590525cf8811" next', None),
    (None, "a row without an id é 😀", "c"),
    (10, " \t\n ", "c"),
]
CLASHING = ["shard", "slot", "size", "__text", "__block", "score", "path", "label", "p", "key", "rep", "n", "sequence_id", "component", "host", "fp", "bits"]


@pytest.fixture(scope="session")
def edge(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, source string")
    return docs.select("*", F.lit("en").alias("lang"), *[F.lit("x").alias(c) for c in CLASHING])


@pytest.fixture(scope="session")
def empty(edge):
    return edge.where("false")
