"""The stages one after another, each held against what it was given."""

import corpus_pipeline as cp
from lexiloom.llm.common import cut, table

from .test_operators import brute_classes


def test_stages(spark, data):
    docs = table(spark, data, "documents")
    columns = docs.columns
    quality, exact, near, mix, pack = (f for _, f in cp.STAGES)
    good = cut(quality(spark, docs, data))
    labels = {r.doc_id: r.quality for r in table(spark, data, "labels").collect()}
    kept = {r.doc_id for r in good.collect()}
    clean = [i for i, q in labels.items() if q == 1]
    assert sum(i in kept for i in clean) > 0.95 * len(clean)
    one = cut(exact(spark, good, data))
    most = {}
    for r in good.collect():
        most[r.text] = max(most.get(r.text, -1), r.doc_id)
    assert {r.doc_id for r in one.collect()} == set(most.values())
    few = cut(near(spark, one, data))
    classes = brute_classes({r.doc_id: r.text for r in one.collect()}, cp.SHINGLE)
    assert {r.doc_id for r in few.collect()} == {c for _, c in classes.values()}
    mixed = cut(mix(spark, few, data))
    from lexiloom.llm import mixing

    copies = {r.doc_id: r.copies for r in mixing.mix(few).collect()}
    counted = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert counted == {i: n for i, n in copies.items() if n}
    for stage in (good, one, few, mixed):
        assert stage.columns == columns
    packed = pack(spark, mixed, data)
    assert packed.where("piece = 0").count() == mixed.count()


def test_empty_and_odd_rows(spark, data, edge, empty):
    """Null and shared ids: rows are told apart, equal ones are copies, and what differs stays."""
    quality, exact, near, mix, pack = (f for _, f in cp.STAGES)
    assert exact(spark, edge, data).where("doc_id = 8").count() == 1
    odd = spark.createDataFrame([(1, "a b c d e f g"), (1, "one two three four five six"), (None, "null one here is long enough"), (None, "null two is another text here"), (3, "a b c d e f g"), (None, None), (9, "")], "doc_id long, text string")
    odd = odd.selectExpr("doc_id", "text", "'en' lang", "'s' source", "cast(1 as long) n_chars")
    few = cut(exact(spark, odd, data))
    assert sorted((r.doc_id or 0, r.text or "") for r in few.collect()) == [(0, "null one here is long enough"), (0, "null two is another text here"), (1, "one two three four five six"), (3, "a b c d e f g"), (9, "")]
    assert sorted(r.text for r in near(spark, few, data).collect()) == sorted(r.text for r in few.collect())
    for docs in (edge, empty):
        n = docs.count()
        for _, stage in cp.STAGES[:-1]:
            made = cut(stage(spark, docs, data))
            assert made.columns == docs.columns and made.count() <= 3 * docs.count()
            docs = made
        packed = cut(pack(spark, docs, data))
        assert packed.where("piece = 0").count() == docs.count()
        assert n or not packed.count()
