"""Exact quantiles against plain ones, and tail probabilities against published tables and identities."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lexiloom.functions import tails
from lexiloom.operators import statistics


def of(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def lit(*values):
    return [F.lit(float(v)) for v in values]


def test_normal_tail(spark):
    for x in (-9.0, -1.96, -0.1, 0.0, 0.5, 1.959963984540054, 3.0, 7.0, 7.2, 20.0):
        assert of(spark, tails.normal_tail(F.lit(x))) == pytest.approx(math.erfc(x / math.sqrt(2)) / 2, rel=1e-12, abs=1e-15)


def test_log_gamma(spark):
    for x in (0.5, 1.0, 2.5, 10.0, 300.5, 1e6):
        assert of(spark, tails.log_gamma(F.lit(x))) == pytest.approx(math.lgamma(x), rel=1e-13, abs=1e-12)


@pytest.mark.parametrize("t, df, p", [(12.7062047362, 1, 0.05), (2.2281388520, 10, 0.05), (3.1692726726, 10, 0.01), (1.9599639845, 1e9, 0.05), (-2.0422724563, 30, 0.05), (0.0, 7, 1.0)])
def test_t_table(spark, t, df, p):
    assert of(spark, tails.t_tail(*lit(t, df))) == pytest.approx(p, abs=1e-6)


@pytest.mark.parametrize("f, a, b, p", [(161.4476387976, 1, 1, 0.05), (3.7082648191, 3, 10, 0.05), (6.5523125575, 3, 10, 0.01), (2.7108898372, 5, 20, 0.05), (0.0, 3, 9, 1.0)])
def test_f_table(spark, f, a, b, p):
    assert of(spark, tails.f_tail(*lit(f, a, b))) == pytest.approx(p, abs=1e-6)


def test_f_of_one_is_t_squared(spark):
    for t, df in ((0.3, 4), (2.5, 11.7), (9.0, 800)):
        assert of(spark, tails.f_tail(*lit(t * t, 1, df))) == pytest.approx(of(spark, tails.t_tail(*lit(t, df))), rel=1e-9)


@pytest.mark.parametrize("q, k, df, p", [(3.876777, 3, 10, 0.05), (3.958293, 4, 20, 0.05), (3.577935, 3, 20, 0.05), (3.772929, 3, 12, 0.05)])
def test_range_table(spark, q, k, df, p):
    assert of(spark, tails.range_tail(*lit(q, k, df))) == pytest.approx(p, abs=1e-6)


def test_range_of_two_is_t(spark):
    for q, df in ((0.2, 1), (1.0, 3), (3.6, 5), (4.2, 60), (2.8, 100_000)):
        assert of(spark, tails.range_tail(*lit(q, 2, df))) == pytest.approx(of(spark, tails.t_tail(*lit(q / math.sqrt(2), df))), abs=1e-6)


def test_u(spark):
    assert of(spark, tails.u_tail(*lit(50, 10, 10))) == 1.0
    assert of(spark, tails.u_tail(*lit(23, 10, 10))) == pytest.approx(math.erfc((27 - 0.5) / math.sqrt(175) / math.sqrt(2)), rel=1e-9)


def plain_quantile(values, share):
    values, at = sorted(values), share * (len(values) - 1)
    low = values[math.floor(at)]
    return low + (values[math.ceil(at)] - low) * (at - math.floor(at))


@pytest.mark.parametrize("partitions", ["1", "7"])
def test_exact_quantiles(spark, partitions):
    """Groups of one row and of many, a third of all rows with one value, null groups and null values."""
    draw = random.Random(5)
    rows = [(draw.choice(["a", "a", "b", None]), 3.0 if draw.random() < 0.33 else round(draw.gauss(0, 50), draw.choice([0, 3]))) for _ in range(3000)] + [("one", 7.5), ("two", 1.0), ("two", 2.0), ("none", None)]
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        df = spark.createDataFrame(rows, "g string, v double").repartition(5)
        got = {r.g: r.q for r in statistics.order_statistics(df, "v", ["g"], [0, 0.1, 0.5, 0.9, 1]).collect()}
        whole = statistics.order_statistics(df, "v", [], [0.25, 0.333]).first().q
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    assert set(got) == {"a", "b", None, "one", "two"}
    for g, q in got.items():
        assert q == pytest.approx([plain_quantile([v for k, v in rows if k == g], s) for s in (0, 0.1, 0.5, 0.9, 1)])
    assert whole == pytest.approx([plain_quantile([v for _, v in rows if v is not None], s) for s in (0.25, 0.333)])
    empty = spark.createDataFrame([], "g string, v double")
    assert statistics.quantiles(empty, "v", ["g"]).count() == 0


def test_no_percentile_is_left():
    import inspect

    assert "percentile(" not in inspect.getsource(statistics)


def test_triples(spark):
    from lexiloom.operators import structure

    disc = spark.createDataFrame([(1, 0, [0, 3], ["nk", "cell"], "nn"), (1, 1, [0, 1], ["no", "gap"], "nn"), (2, 0, [0, 3], ["nk", "cell"], "nn")], "doc_id long, sent_id int, positions array<int>, term array<string>, tags string")
    sents = spark.createDataFrame([(1, 0, list("ncnn"), "nk and t cells".split()), (1, 1, list("nn"), ["no", "gap"]), (2, 0, list("ncnn"), "b or a cell".split())], "doc_id long, sent_id int, tags array<string>, words array<string>")
    assert [tuple(r) for r in structure.cross_counts(disc, sents).select("concept", "super", "skip", "n", "percent", "example").collect()] == [("(a|n)+n", ".c..", "n##n", 2, 100.0, "b or a cell")]
