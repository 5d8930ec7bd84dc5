"""Queries over scored types count, write and join what their result needs, and nothing besides."""

from __future__ import annotations

import pytest

from lexiloom.operators import candidates, evaluation, ranking, termhood
from lexiloom.plans import queries


def barred(*args, **kwargs):
    raise AssertionError("not needed")


@pytest.mark.parametrize(
    ("name", "module", "function"),
    [
        ("filter_any", termhood, "metrics"),
        ("results_table", evaluation, "compared"),
        ("precision_at_k", ranking, "key_ranks"),
        ("matcher", queries, "types"),
        ("eval_corpus", evaluation, "compared"),
        ("error_analysis", candidates, "type_counts"),
        ("extraction_run", ranking, "vote"),
    ],
)
def test_query_does_without(spark, data, monkeypatch, name, module, function):
    monkeypatch.setattr(module, function, barred)
    assert queries.QUERIES[name](spark, data).columns


def test_hypernyms_write_no_contiguous_candidates(spark, data, monkeypatch):
    rows, write = [], queries.written
    monkeypatch.setattr(queries, "written", lambda df, *a: rows.append(df.count() if "positions" in df.columns else 0) or write(df, *a))
    queries.QUERIES["hypernym_dcs"](spark, data)
    assert sum(rows) < candidates.contiguous(queries.target(spark, data), queries.FILTER, 3).count()
