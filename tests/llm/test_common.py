from pyspark.sql import functions as F

from lexiloom.llm import common, registry


def test_sieve_passes_all_keys_and_few_others(spark, monkeypatch):
    keys = common.cut(spark.range(0, 3000, 3).withColumnRenamed("id", "k"))
    rows = spark.range(0, 3000).select(F.col("id").alias("k"), F.lit("x").alias("word"))
    passed = {r.k for r in common.Sieve(keys, "k").passed(rows, "k").collect()}
    assert set(range(0, 3000, 3)) <= passed and len(passed) < 1400
    monkeypatch.setattr(common, "SIEVE_WORDS", 2)  # filled up it passes everything
    assert common.Sieve(keys, "k").passed(rows, "k").count() == 3000


def test_without(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (None, "d")], "k long, v string")
    dropped = common.cut(spark.createDataFrame([(2,), (2,), (9,)], "k long"))
    assert sorted((r.k or 0, r.v) for r in common.without(rows, dropped, "k").collect()) == [(0, "d"), (1, "a")]
    assert common.without(rows, dropped.where("false"), "k").count() == 4


def test_slices_keep_all_rows():
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(["a" * n for n in (5, 0, 900, 3, 3)] + [None])], ["t"])
    parts = list(common.slices([batch], "t", 8))
    assert sum(len(p) for p in parts) == 6 and [len(p) for p in parts] == [2, 1, 3]


def test_registry():
    assert set(registry.oracle_sql()) <= set(registry.queries())
    assert all(isinstance(sql, str) for sql in registry.oracle_sql().values())
    assert sorted(int(q[2:].split("_")[0]) for q in registry.queries()) == list(range(1, 14))
