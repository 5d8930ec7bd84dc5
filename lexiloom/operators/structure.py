"""Constituent trees: nearest enclosing nodes and bracket strings; tag sequences collapsed to patterns."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.functions.text import tag_letter
from lexiloom.operators.intervals import nearest_enclosing
from lexiloom.operators.statistics import shares

#: Fixed value: brackets around a single token, which go.
SINGLE = r"\(+(#?.)\)+"
#: Patterns of coordinated tag sequences, tried in this order.
COLLAPSERS = (".c..", "..c.", "[^,c]+.c.", ".c.[^,c]+", "[^,c]+.c.[^,c]+", "([^,c]+,)+.+,?c.[^,c]*", "[^,c]*.c.(,[^,c]+)+", "[^c]+c[^c]+c[^c]+")

#: Fixed value: the pattern of a concept's own tag sequence.
CONCEPT_COLLAPSERS = ("(a|n)+n",)


def collapsed(tags: Column, patterns: tuple[str, ...] = COLLAPSERS) -> Column:
    """The first pattern that matches a tag sequence in full, or the sequence."""
    out = None
    for p in patterns:
        hit = tags.rlike(f"^(?:{p})$")
        out = F.when(hit, F.lit(p)) if out is None else out.when(hit, F.lit(p))
    return out.otherwise(tags)


def cross_counts(disc: DataFrame, annotated: DataFrame, fewer_than: int = 10) -> DataFrame:
    """(concept, super, skip, n, percent, example): how often each triple of patterns occurs among discontinuous concepts of fewer tokens that span a coordination.

    concept is the pattern of a concept's tags, super that of all it spans, and skip is what it spans with # for what it
    leaves out. disc: (doc_id, sent_id, positions, tags, term). The example is the least text spanned.
    """
    sentences = annotated.select("doc_id", "sent_id", F.col("tags").alias("__tags"), "words")
    some = disc.where(F.size("term") < fewer_than).join(sentences, ["doc_id", "sent_id"])
    first = F.get("positions", F.lit(0))
    own = lambda c: F.slice(c, first + 1, F.element_at("positions", -1) - first + 1)
    skip = F.array_join(F.transform(own("__tags"), lambda t, i: F.when(F.array_contains("positions", i + first), t).otherwise("#")), "")
    placed = some.select(F.col("tags").alias("own"), F.array_join(own("__tags"), "").alias("spanned"), skip.alias("skip"), F.array_join(own("words"), " ").alias("text")).where(F.contains("spanned", F.lit("c")))
    return shares(placed.select(collapsed(F.col("own"), CONCEPT_COLLAPSERS).alias("concept"), collapsed(F.col("spanned")).alias("super"), "skip", "text"), ["concept", "super", "skip"], "text")


def enclosing(spans: DataFrame, constituents: DataFrame) -> DataFrame:
    """spans (doc_id, start, end) with the label and node_id of the nearest constituent that encloses them; see intervals.nearest_enclosing."""
    return nearest_enclosing(spans, constituents)


def bracket_strings(constituents: DataFrame) -> DataFrame:
    """(doc_id, node_id, structure, unlabelled): each node's tree in brackets, with labels, and without labels and unary steps."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        below: dict[int, list[int]] = {}
        label = dict(zip(pdf.node_id, pdf.label, strict=True))
        for r in pdf.sort_values(["parent_id", "child_ord"]).itertuples():
            if not pd.isna(r.parent_id):
                below.setdefault(int(r.parent_id), []).append(r.node_id)
        full: dict[int, str] = {}
        bare: dict[int, str] = {}
        for n in sorted(label, reverse=True):  # children have larger numbers than their parents
            own = below.get(n, [])
            full[n] = f"[{label[n]}{''.join(' ' + full[c] for c in own)}]"
            bare[n] = bare[own[0]] if len(own) == 1 else f"[{''.join(bare[c] for c in own)}]"
        return pd.DataFrame([(key[0], n, full[n], bare[n]) for n in sorted(label)], columns=["doc_id", "node_id", "structure", "unlabelled"])

    return constituents.groupBy("doc_id").applyInPandas(run, "doc_id string, node_id int, structure string, unlabelled string")


def marked_structures(constituents: DataFrame, marked: DataFrame) -> DataFrame:
    """(doc_id, node_id, structure, unlabelled): bracket strings of all nodes above tokens, whose leaves are tag letters, with # before tokens in marked (doc_id, start, end).

    Labels end before their first hyphen. Without labels, nodes right above an empty token are left out, and brackets
    around a single token go.
    """
    some = marked.select("doc_id", "start", "end").distinct().withColumn("__mark", F.lit("#"))
    joined = constituents.join(some, ["doc_id", "start", "end"], "left")
    leaf = F.concat(F.coalesce("__mark", F.lit("")), tag_letter(F.coalesce("label", F.lit(""))))
    label = F.split_part(F.coalesce("label", F.lit("")), F.lit("-"), F.lit(1))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        below: dict[int, list[int]] = {}
        for r in pdf[pdf.parent_id.notna()].sort_values(["parent_id", "child_ord"]).itertuples():
            below.setdefault(int(r.parent_id), []).append(r.node_id)
        full = dict(zip(pdf.node_id, pdf.leaf, strict=True))
        bare, names = dict(full), dict(zip(pdf.node_id, pdf.label, strict=True))
        hollow = {n for n, own in below.items() if any(c not in below and full[c].endswith("Ø") for c in own)}
        for n in sorted(below, reverse=True):  # children have larger numbers than their parents
            full[n] = f"({names[n]} {' '.join(full[c] for c in below[n])})"
            bare[n] = re.sub(SINGLE, r"\1", f"({' '.join(bare[c] for c in below[n] if c not in hollow)})")
        return pd.DataFrame([(key[0], n, full[n], bare[n]) for n in sorted(below)], columns=["doc_id", "node_id", "structure", "unlabelled"])

    return joined.select("doc_id", "node_id", "parent_id", "child_ord", label.alias("label"), leaf.alias("leaf")).groupBy("doc_id").applyInPandas(run, "doc_id string, node_id int, structure string, unlabelled string")


def subset_terms(terms: DataFrame, words: list[str]) -> DataFrame:
    """Terms that hold all the words."""
    return terms.where(F.size(F.array_except(F.array(*[F.lit(w) for w in words]), F.col("term"))) == 0)
