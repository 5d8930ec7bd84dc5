"""Readers pass over their documents once, hold little at a time, and write no file for each document."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from lexiloom.plans import readers
from lexiloom.sources import corpora, formats

ARTICLE = '<a><sentence><cons sem="X"><w c="NN">ab</w></cons> <w c="VB">c</w></sentence></a>'


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_records_of_a_file_are_cut_into_ranges(spark, tmp_path, monkeypatch):
    formats.register(spark)
    want = {f"d{i}é": f"word/nn and/cc\nx{i}/nn" + " y/vb" * i for i in range(40)}
    lines = [json.dumps({"doc_id": k, "text": v}, ensure_ascii=False) for k, v in want.items()]
    (tmp_path / "part.txt").write_text("\n".join([*lines, "{broken", json.dumps({"doc_id": "e", "text": "untagged"})]) + "\n")
    for size in (37, 64, 1000, 1 << 20):
        monkeypatch.setattr(formats, "PARTITION_BYTES", size)
        reader = formats.CorpusReader(formats.slashed_document, ["doc_id", "text", "reason"], str(tmp_path), ".txt", False, True)
        found = [row for p in reader.partitions() for row in reader.read(p)]
        assert len(found) == 42
        assert {d: t for d, t, r in found if r is None} == {k: formats.slashed_document(v)[0] for k, v in want.items()}
        assert sorted(r.split(":")[0] for _, _, r in found if r) == ["JSONDecodeError", "ValueError"]


def test_corpus_source_writes_few_files(spark, data, tmp_path, monkeypatch):
    monkeypatch.setattr(readers, "shared_folder", lambda spark: str(tmp_path))
    found = readers.corpus_source(spark, data)
    documents = found.count()
    assert 0 < len(list(tmp_path.rglob("*.txt"))) <= 4 * 4 < documents


def test_slashed_rows_need_no_window_and_one_pass(spark, data):
    texts = spark.createDataFrame([("a", "ab/nn c/vb/x\n\n d \nß/n"), ("b", ""), ("c", None)], "doc_id string, text string")
    rows = corpora.slashed_annotations(texts)
    assert sorted(tuple(r) for r in rows.collect() if r.kind == "token") == [("a", "token", 0, 2, "NN"), ("a", "token", 3, 4, "VB"), ("a", "token", 5, 6, None), ("a", "token", 7, 8, "N")]
    assert sorted((r.start, r.end) for r in rows.where("kind = 'sentence'").collect()) == [(0, 4), (5, 6), (7, 8)]
    asked = plan(readers.reader_slashed(spark, data))
    assert "Window" not in asked and asked.count("Exchange hashpartitioning") == 1


def test_inline_articles_are_parsed_once_in_small_batches(spark, data, monkeypatch):
    assert plan(readers.reader_inline(spark, data)).count("MapInArrow") == 1
    texts = spark.createDataFrame([(f"{i}", ARTICLE) for i in range(50)] + [("x", "<a>")], "doc_id string, text string").coalesce(1)
    monkeypatch.setattr(corpora, "HELD", 8)
    sizes = corpora.parsed_inline(texts).select(F.size("rows").alias("n")).collect()
    assert sum(r.n or 0 for r in sizes) == 200
    rows = corpora.inline_annotations(texts).collect()
    assert len(rows) == 201 and [r.doc_id for r in rows if r.kind == "bad"] == ["x"]
    tables = corpora.inline_corpus(texts)
    assert sum(tables[k].count() for k in ("sentences", "tokens", "concepts", "bad")) == len(rows)
