"""Interval joins against all pairs of a document."""

import random

import pytest

from lexiloom.operators import annotate, intervals

SPAN = "doc_id string, start long, end long, name string"


def drawn(seed, n, docs="ab", long_=0.1):
    draw = random.Random(seed)
    out = []
    for i in range(n):
        start = draw.randint(0, 300)
        out.append((draw.choice(docs), start, start + (draw.randint(0, 250) if draw.random() < long_ else draw.randint(1, 9)), f"n{i}"))
    return out


@pytest.mark.parametrize("width", [1, 7, 64, 10_000])
@pytest.mark.parametrize("enclosing", [True, False])
def test_overlaps(spark, width, enclosing):
    one, other = drawn(1, 60), [*drawn(2, 80, "bc"), ("a", 5, 400, "wide")]
    odd = [(None, 1, 5, "no document"), ("a", None, 5, "no place")]
    found = intervals.overlaps(spark.createDataFrame(one + odd, SPAN), spark.createDataFrame(other + odd, SPAN), enclosing, width)
    got = sorted((r.name, r.other_name) for r in found.collect())
    want = sorted((a[3], b[3]) for a in one for b in other if a[0] == b[0] and a[1] < b[2] and b[1] < a[2] and (enclosing or not (b[1] < a[1] and b[2] > a[2])))
    assert got == want and want


@pytest.mark.parametrize("width", [1, 16, 64])
def test_nearest_enclosing(spark, width):
    spans, nodes = drawn(3, 50), drawn(4, 90, long_=0.7)
    held = spark.createDataFrame([(d, i, name, s, e) for i, (d, s, e, name) in enumerate(nodes)], "doc_id string, node_id int, label string, start long, end long")
    found = intervals.nearest_enclosing(spark.createDataFrame(spans, SPAN), held, width)
    got = {r.name: r.label for r in found.collect()}
    for d, s, e, name in spans:
        around = [(n[1], -n[2], i, n[3]) for i, n in enumerate(nodes) if n[0] == d and n[1] <= s and n[2] >= e]
        assert got[name] == (max(around)[3] if around else None)


def test_empty_tables(spark):
    spans, none = spark.createDataFrame(drawn(5, 3), SPAN), spark.createDataFrame([], SPAN)
    assert intervals.overlaps(spans, none).count() == intervals.overlaps(none, spans).count() == 0
    nodes = spark.createDataFrame([], "doc_id string, node_id int, label string, start long, end long")
    assert [r.label for r in intervals.nearest_enclosing(spans, nodes).collect()] == [None] * 3


def test_no_document_meets_itself_whole(spark):
    """Pairs meet by document and bucket, so the join's keys are both."""
    spans = spark.createDataFrame(drawn(6, 3), SPAN)
    plan = intervals.overlaps(spans.hint("merge"), spans)._jdf.queryExecution().executedPlan().toString()
    keys = next(line for line in plan.splitlines() if "Join" in line)
    assert "__bucket" in keys and "__there" in keys and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_pieces(spark):
    docs = spark.createDataFrame([(1, "é😀.\n\nb!c"), (2, None), (3, ""), (4, "..")], "doc_id long, text string")
    got = [(r.doc_id, r.piece, r.start, r.end) for r in annotate.pieces(docs, r"[.!?\n]+").collect()]
    assert got == [(1, 0, 0, 2), (1, 1, 5, 6), (1, 2, 7, 8)]


def test_kinds_hold_their_cases(spark):
    rows = spark.createDataFrame([("Token",), ("Concept",), ("DiscontinuousConcept",), ("Annotation",), (None,)], "kind string")
    held = lambda kind: sorted(r.kind for r in annotate.of_kind(rows, kind).collect())
    assert held("Concept") == ["Concept", "DiscontinuousConcept"] and held("DiscontinuousConcept") == ["DiscontinuousConcept"]
    assert held("Annotation") == ["Annotation", "Concept", "DiscontinuousConcept", "Token"] and held("Other") == []


def test_overlaps_cut_only_documents_with_a_window(spark, tmp_path):
    from lexiloom.plans import queries

    spark.createDataFrame([(1, "run with it, and on", "en"), (2, "nothing here", "en"), (3, None, "en")], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.overlaps(spark, str(tmp_path))
    assert {(r.doc_id, r.word) for r in found.collect()} == {(1, w) for w in ("run", "with", "it", ",", "and", "on")}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Contains(text") == 2
