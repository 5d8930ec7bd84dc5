"""Coordinations of any length, in sentences of any length, with every way through them."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lexiloom.functions.text import found_in
from lexiloom.operators import annotate, candidates
from lexiloom.plans import queries


def known(spark, pairs):
    return spark.createDataFrame(pairs, "a string, b string")


def test_long_coordinations_are_searched(spark):
    """One of nineteen tokens, and one of four in a sentence of over a hundred."""
    long_ = "big " + " ".join(f"w{i}" for i in range(15)) + " and small cell"
    late = " ".join("the" for _ in range(120)) + " big and small cell"
    annotated = annotate.sentences(spark.createDataFrame([(1, long_), (2, late)], "doc_id long, text string"))
    found = candidates.coordinations(annotated, "simple")
    got = candidates.coordinated(found, known(spark, [("w14", "cell"), ("big", "cell")]), "simple").collect()
    assert {(r.doc_id, tuple(r.positions)) for r in got} == {(1, tuple(p)) for p in ([*range(s, 16), 18] for s in range(16))} | {(2, (120, 123))}


def test_ways_grown_in_rounds_are_those_grown_at_once(spark, monkeypatch):
    draw = random.Random(3)
    rows = []
    for k in range(80):
        n = draw.randint(2, 11)
        tags = "".join(draw.choice("aannnc,") for _ in range(n))
        bridged = [(i, j) for i in range(n) for j in range(i + 2, n) if draw.random() < 0.25]
        rows.append((k, tags, bridged, [sorted(draw.sample(range(s + 1, n + 1), draw.randint(0, n - s))) if tags[s] in "an" else [] for s in range(n)]))
    df = spark.createDataFrame(rows, "k int, tags string, bridged array<struct<i:int,j:int>>, ends array<array<int>>")
    for letters, gapped in (("an", F.lit(False)), (None, F.lit(True))):
        at_once = [(r.k, tuple(r.way)) for r in candidates.each_way(df, letters, 11, gapped).collect()]
        with monkeypatch.context() as m:
            m.setattr(candidates, "AT_ONCE", 3)
            in_rounds = [(r.k, tuple(r.way)) for r in candidates.each_way(df, letters, None, gapped).collect()]
        assert sorted(in_rounds) == sorted(at_once) and len(set(in_rounds)) == len(in_rounds) > 100


def test_no_round_holds_all_ways_of_a_row(spark, monkeypatch):
    """Twelve pairs of tokens, each with a bridge that leaves one out: 4096 ways, of which a round's row lists few."""
    n = 24
    row = [(1, "n" * n, [(i, i + 2) for i in range(0, n - 2, 2)], [[n], *[[] for _ in range(n - 1)]])]
    df = spark.createDataFrame(row, "k int, tags string, bridged array<struct<i:int,j:int>>, ends array<array<int>>")
    sizes, inner = [], candidates.grown
    monkeypatch.setattr(candidates, "AT_ONCE", 6)
    monkeypatch.setattr(candidates, "grown", lambda *a: sizes.append(a[5]) or inner(*a))
    assert candidates.each_way(df, None).select(F.array_join(F.col("way").cast("array<string>"), " ").alias("w")).distinct().count() == 2**11 - 1
    assert sizes.count(6) == 4  # rounds of six tokens each


def test_lists_of_thousands_need_no_deep_stack(spark):
    tags = "n," * 6000 + "ncnn"
    df = spark.createDataFrame([(tags,)], "t string")
    letters = candidates.COORDINATED["simple"][0]
    assert [len(m.text) for m in df.select(found_in(F.col("t"), candidates.flat_pattern(letters)).alias("m")).first().m] == [len(tags)]
    assert [len(m.text) for m in df.select(found_in(F.col("t"), candidates.FLAT_GROUP).alias("m")).first().m] == [len(tags) - 1]


class Asked(Exception):
    pass


@pytest.mark.parametrize("name", ["coord_dcs", "bigram_sides", "concept_sides", "results_table", "hypernym_dcs"])
def test_query_bounds_no_coordination(spark, data, monkeypatch, name):
    def searched(annotated, tag_filter, *bounds):
        raise Asked(bounds)

    monkeypatch.setattr(candidates, "coordinations", searched)
    with pytest.raises(Asked) as asked:
        queries.QUERIES[name](spark, data)
    assert asked.value.args == ((),)
