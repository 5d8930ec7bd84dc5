"""Readers against miniature files written here."""

import os

import pytest
from pyspark.sql import functions as F

from lexiloom.functions.text import merged_spans
from lexiloom.operators import structure
from lexiloom.sources import corpora


def put(folder, name, text):
    path = os.path.join(str(folder), name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_standoff(spark, tmp_path):
    put(tmp_path, "txt/d1.txt", "NK and T cells")
    note = '<annotation><span start="{}" end="{}">x</span><class label="{}">y</class></annotation>'
    tags = "".join(note.format(*t) for t in ((0, 14, "sentence"), (0, 2, "NN"), (3, 6, "CC"), (7, 8, "NN"), (9, 14, "NNS")))
    put(tmp_path, "part-of-speech/d1.xml", f"<annotations>{tags}</annotations>")
    put(tmp_path, "concepts/d1.xml", '<annotations><annotation><span start="0" end="2">a</span><span start="9" end="14">b</span><class label="c">d</class></annotation></annotations>')
    put(tmp_path, "treebank/d1.tree", "(NP (NP (NN NK) (-NONE- *)) (CC and) (NP (NN T) (NNS cells)))")
    c = corpora.load_corpus(spark, "standoff", str(tmp_path))
    assert rows(c["documents"]) == [("d1", "NK and T cells")]
    assert rows(c["sentences"]) == [("d1", 0, 14)]
    assert rows(c["tokens"]) == [("d1", 0, 2, "NN"), ("d1", 3, 6, "CC"), ("d1", 7, 8, "NN"), ("d1", 9, 14, "NNS")]
    assert [(r.label, [tuple(s) for s in r.spans]) for r in c["concepts"].collect()] == [("c", [(0, 2), (9, 14)])]
    nodes = {r.node_id: r for r in c["constituents"].collect()}
    assert (nodes[0].label, nodes[0].start, nodes[0].end, nodes[0].parent_id) == ("NP", 0, 14, None)
    assert (nodes[3].label, nodes[3].start, nodes[3].end) == ("-NONE-", 2, 2)
    strings = {r.node_id: r for r in structure.bracket_strings(c["constituents"]).collect()}
    assert strings[0].structure == "[NP [NP [NN] [-NONE-]] [CC] [NP [NN] [NNS]]]"
    spans = spark.createDataFrame([("d1", 7, 14), ("d1", 0, 50)], "doc_id string, start int, end int")
    found = {r.start: r.label for r in structure.enclosing(spans, c["constituents"]).collect()}
    assert found == {7: "NP", 0: None}


XML = (
    "<article><title><sentence><w c='NN'>Title</w></sentence></title><abstract>"
    "<sentence><cons sem='(AND a b)'><cons><w c='NN'>NK</w></cons> <w c='CC'>and</w> <cons><w c='NN'>T</w></cons> <w c='NNS'>cells</w></cons></sentence>"
    "</abstract></article>"
)


def test_inline(spark):
    texts = spark.createDataFrame([("a", XML)], "doc_id string, text string")
    c = corpora.inline_corpus(texts)
    assert rows(c["sentences"]) == [("a", 0, 5), ("a", 6, 20)]
    text = c["documents"].first().text
    assert [text[r[1] : r[2]] for r in rows(c["tokens"])] == ["Title", "NK", "and", "T", "cells"] and len(text) == 20
    assert ("a", 15, 20, "NNS") in rows(c["tokens"])
    found = sorted([tuple(s) for s in r.spans] for r in c["concepts"].collect())
    assert found == [[(6, 8), (15, 20)], [(13, 20)]]


def test_leaves_meet_tokens():
    """Leaves that join or split tokens, a full stop that is missing, a leaf without a word, and words that differ."""
    tokens = [("ab", 0, 2, "NN"), ("c", 3, 4, "NN"), ("pre-x", 5, 10, "JJ"), ("end", 11, 14, "NN")]
    none = lambda at: [(at, at, "-NONE-")]
    found = corpora.leaf_tokens(["abc", "pre", "-", "x", ".", "", "end", "."], tokens)
    assert found == [[(0, 2, "NN"), (3, 4, "NN")], none(5), none(5), [(5, 10, "JJ")], none(11), none(11), [(11, 14, "NN")], none(14)]
    assert corpora.leaf_tokens([], tokens) == [] and corpora.leaf_tokens(["."], []) == [none(0)]
    for wrong in (["abd"], ["abc", "z"], ["abcpre-xend", "more"]):
        with pytest.raises(ValueError):
            corpora.leaf_tokens(wrong, tokens)


def test_treebank_of_inline_corpus(spark):
    tree = (
        "<set><sentence><tok cat='NN'>Title</tok></sentence>"
        "<sentence><cons cat='NP-SBJ'><cons cat='NP'><tok cat='NN'>NK</tok><cons cat='ADJP'/></cons><tok cat='CC'>and</tok>"
        "<cons cat='NP'><tok cat='NN'>T</tok> <tok cat='NNS'>cells</tok></cons></cons><tok cat='.'>.</tok></sentence></set>"
    )
    c = corpora.inline_corpus(spark.createDataFrame([("a", XML), ("b", XML)], "doc_id string, text string"))
    got = corpora.treebank_trees(spark.createDataFrame([("a", tree)], "doc_id string, text string"), c)
    nodes = {r.node_id: r for r in got.collect()}
    assert [(r.label, r.start, r.end) for _, r in sorted(nodes.items())] == [
        ("sentence", 0, 5), ("NN", 0, 5), ("sentence", 6, 20), ("NP-SBJ", 6, 20), ("NP", 6, 9), ("NN", 6, 8), ("ADJP", 9, 9),
        ("-NONE-", 9, 9), ("CC", 9, 12), ("NP", 13, 20), ("NN", 13, 14), ("NNS", 15, 20), ("-NONE-", 20, 20),
    ]
    assert [nodes[n].parent_id for n in (2, 3, 4, 12)] == [None, 2, 3, 2]
    marked = spark.createDataFrame([("a", 6, 8), ("a", 15, 20), ("b", 13, 14)], "doc_id string, start int, end int")
    strings = {r.node_id: (r.structure, r.unlabelled) for r in structure.marked_structures(got, marked).collect()}
    assert strings[0] == ("(sentence n)", "n")
    assert strings[3] == ("(NP (NP #n (ADJP Ø)) c (NP n #n))", "(#n c (n #n))")
    assert set(strings) == {0, 2, 3, 4, 6, 9}


def test_vertical_blanks_and_nesting(spark):
    """Glue after glue takes one blank, terms nest, files end with or without a line break, and what is not closed is left out."""
    body = "<doc>\n<s>\nA\ta\tDT\n<term>\n<term>\nbig\tb\tJJ\n</term>\ncat\tc\tNN\n<g/>\n<g/>\n</term>\n.\t.\tSENT\n</s>\n<s>\n<term>\nDogs\td\tNNS\n</s>\n</doc>"
    c = corpora.vertical_tables(spark.createDataFrame([("x_1", body), ("y_1", "<doc>\n</doc>\n")], "doc_id string, text string"))
    assert rows(c["documents"]) == [("x_1", "A big cat. Dogs"), ("y_1", "")]
    assert rows(c["sentences"]) == [("x_1", 0, 10), ("x_1", 11, 15)]
    assert sorted(tuple(r.spans[0]) for r in c["concepts"].collect()) == [(2, 5), (2, 9)]


def test_vertical(spark, tmp_path):
    body = "<doc>\n<s>\n<term>\nT\tt\tNN\n<term>\ncell\tcell\tNN\n</term>\n</term>\n<g/>\n.\t.\tSENT\n</s>\n</doc>\n"
    put(tmp_path, "x_1.vert", body)
    put(tmp_path, "x_2.vert", body.replace("<term>\nT", "T").replace("</term>\n</term>", "</term>"))
    c = corpora.load_corpus(spark, "vertical", str(tmp_path))
    assert rows(c["documents"]) == [("x", "T cell.")]
    assert rows(c["tokens"]) == [("x", 0, 1, "NN"), ("x", 2, 6, "NN"), ("x", 6, 7, "SENT")]
    assert sorted(tuple(r.spans[0]) for r in c["concepts"].collect()) == [(0, 6), (2, 6)]


def test_slashed(spark):
    texts = spark.createDataFrame([("b", "\tThe/at dog/nn barks/vbz\n\n ok/uh ./.\n")], "doc_id string, text string")
    c = corpora.slashed_corpus(texts)
    assert rows(c["documents"]) == [("b", "The dog barks\nok .")]
    assert rows(c["tokens"])[:2] == [("b", 0, 3, "AT"), ("b", 4, 7, "NN")]
    assert rows(c["sentences"]) == [("b", 0, 13), ("b", 14, 18)]


def test_annotation_files(spark, tmp_path):
    put(tmp_path, "in/a/d.txt", "Some text.")
    put(tmp_path, "in/annotations/d.anno", "Sentence:[(0, 10)]\nToken:[(0, 4), 'DT']\nToken:[(0 4)]\n__import__('os')\n")
    c = corpora.load_corpus(spark, "annotated", str(tmp_path / "in"))
    assert rows(c["documents"]) == [("d", "Some text.")] and rows(c["sentences"]) == [("d", 0, 10)] and rows(c["tokens"]) == [("d", 0, 4, "DT")]
    assert c["bad_lines"].count() == 2
    good = c["tokens"].withColumn("kind", F.lit("Token"))
    corpora.save_annotations(good, str(tmp_path / "out"))
    assert [r.value for r in spark.read.text(str(tmp_path / "out")).collect()] == ["Token:[(0, 4), 'DT']"]


def test_term_list(spark, tmp_path):
    put(tmp_path, "d2020.bin", "*NEWRECORD\nMH = Killer Cells\nMHX = no\nENTRY = Cells, NK\nENTRY = NK cell|T1|x\n\n*NEWRECORD\nMH = Lung\n")
    put(tmp_path, "q2020.bin", "*NEWRECORD\nSH = lung\nQX = Airways\n")
    got = {" ".join(r.term): r.main for r in corpora.term_list(spark, str(tmp_path)).collect()}
    assert got == {"killer cells": "killer cells", "killer cell": "killer cells", "nk cells": "killer cells", "nk cell": "killer cells", "lung": "lung", "airways": "lung"}


def test_curation(spark):
    texts = spark.createDataFrame([("f", '<doc id="a">\n1\n</doc>\n<doc id="b">\n2\n</doc>\n<doc id="a">\n3\n</doc>\n')], "doc_id string, text string")
    assert [r.doc_id for r in corpora.split_blocks(texts).orderBy("doc_id").collect()] == ["a_1", "a_2", "b_1"]
    articles = spark.createDataFrame([("f", "<set><article><bibliomisc>MEDLINE:123</bibliomisc></article><article><bibliomisc>MEDLINE:45</bibliomisc></article></set>")], "doc_id string, text string")
    assert sorted(r.doc_id for r in corpora.split_articles(articles).collect()) == ["123", "45"]
    counts = spark.createDataFrame([("x", 3), ("y", 9), ("z", 1)], "doc_id string, terms long")
    assert [(r.doc_id, r["rank"]) for r in corpora.curate(counts.select("doc_id"), counts, 1).orderBy("rank").collect()] == [("y", 1), ("x", 2)]
    one = spark.createDataFrame([("m1", "A b\nc")], "doc_id string, title string")
    other = spark.createDataFrame([("p1", "Abc"), ("p2", "A bc")], "doc_id string, title string")
    assert rows(corpora.mapped_by_title(one, other)) == [("m1", "p2")]
    clean, found, failed = corpora.preprocess(spark.createDataFrame([("a", "L text"), ("b", "L")], "doc_id string, text string"), "L", lambda df: df.where("text != ''"))
    assert rows(clean) == [("a", "text"), ("b", "")] and rows(found) == [("a", "text")] and rows(failed) == [("b", "")]


def test_span_merging(spark):
    df = spark.sql("SELECT array(named_struct('start', 0, 'end', 2), named_struct('start', 3, 'end', 5), named_struct('start', 7, 'end', 8)) AS s")
    assert [tuple(x) for x in df.select(merged_spans(F.col("s")).alias("m")).first().m] == [(0, 5), (7, 8)]


def test_collapsed_sequences(spark):
    df = spark.createDataFrame([("ncnn",), ("nnnn",), ("n,n,ncnn",)], "t string")
    got = [r[0] for r in df.select(structure.collapsed(F.col("t"))).collect()]
    assert got[:2] == [".c..", "nnnn"] and got[2] == "([^,c]+,)+.+,?c.[^,c]*"
