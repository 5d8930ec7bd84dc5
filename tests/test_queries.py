"""Every query against its SQL on the smallest tables, and the driver's contract."""

import duckdb
import pytest

import __spark_entry__ as entry
from lexiloom.plans.oracle import ORACLE
from lexiloom.plans.queries import QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return c


def normal(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(repr(round(r[i], 6)) if isinstance(r[i], float) else str(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, data, duck, name):
    df = QUERIES[name](spark, data)
    got = normal([tuple(r) for r in df.collect()], df.columns)
    found = duck.sql(ORACLE[name])
    assert sorted(df.columns) == sorted(found.columns)
    assert got == normal(found.fetchall(), found.columns)


def test_contract(spark):
    assert set(ORACLE) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 100


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_without_sql_runs(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0
