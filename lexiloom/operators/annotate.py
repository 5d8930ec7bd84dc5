"""Annotation: documents to sentences with their tokens, tag letters and lemmas, by rules.

A sentence is one row with arrays, so that what looks within sentences needs no join. Any table of that shape, with tags
from another annotator, does as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.functions.text import SENTENCE_END, TOKEN, named, placed_tokens, rule_lemma, rule_tag, running_sums


def sentences(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, sent_id, words, tags, lemmas) of sentences that have tokens; sent_id counts all pieces from 0.

    Null texts have no sentences.
    """
    pieces = docs.select(F.col(doc_id).alias("doc_id"), F.posexplode(F.split(F.lower(F.col(text)), SENTENCE_END)).alias("sent_id", "sentence"))
    words = pieces.where(F.col("sentence").rlike(TOKEN)).select("doc_id", "sent_id", F.regexp_extract_all("sentence", F.lit(TOKEN), F.lit(0)).alias("words"))
    return words.select("*", F.transform("words", rule_tag).alias("tags"), F.transform("words", rule_lemma).alias("lemmas"))


def tokens(annotated: DataFrame) -> DataFrame:
    """(doc_id, sent_id, tok_idx, word, tag, lemma): a row for each token of sentences."""
    zipped = F.arrays_zip(F.col("words").alias("word"), F.col("tags").alias("tag"), F.col("lemmas").alias("lemma"))
    one = annotated.select("doc_id", "sent_id", F.posexplode(zipped).alias("tok_idx", "t"))
    return one.select("doc_id", "sent_id", "tok_idx", "t.word", "t.tag", "t.lemma")


def token_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *kept: str) -> DataFrame:
    """(doc_id, tok, start, end, word, kept columns): tokens with their place in the text, in code points.

    The text is cut into tokens and what lies between, and places are running sums of lengths within the row.
    """
    one = docs.select(F.col(doc_id).alias("doc_id"), *kept, F.posexplode(placed_tokens(F.col(text))).alias("tok", "t"))
    words = one.where(F.col("t.word").rlike(r"^[\p{L}\p{N},]"))
    start = F.col("t.start").cast("long")
    return words.select("doc_id", "tok", start.alias("start"), (start + F.char_length("t.word")).alias("end"), "t.word", *kept)


def pieces(docs: DataFrame, separator: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, piece, start, end): what lies between the separators of a text, in code points, without empty pieces; piece counts all from 0."""
    parts, between = F.split(F.col(text), separator, -1), F.regexp_extract_all(text, F.lit(separator), F.lit(0))

    def spans(x: Column) -> Column:
        whole = F.transform(x["parts"], lambda p, i: F.char_length(p) + F.coalesce(F.char_length(F.get(x["between"], i)), F.lit(0)))
        return F.zip_with(running_sums(whole), x["parts"], lambda at, p: F.struct(at.cast("long").alias("start"), (at + F.char_length(p)).cast("long").alias("end")))

    one = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.posexplode(named(F.struct(parts.alias("parts"), between.alias("between")), spans)).alias("piece", "s"))
    return one.select("doc_id", "piece", "s.start", "s.end").where("end > start")


def normalized(annotated: DataFrame, column: str = "lemmas") -> DataFrame:
    """One line of text for each sentence, blanks within a token as underscores."""
    return annotated.select("doc_id", "sent_id", F.array_join(F.transform(column, lambda t: F.replace(t, F.lit(" "), F.lit("_"))), " ").alias("line"))


def tokens_between(one: Column, other: Column, tags: Column, ignored: str = "") -> Column:
    """How many tokens lie between two token numbers of a sentence, leaving out those with ignored tags."""
    first = F.least(one, other)
    inner = F.slice(tags, first + 2, F.greatest(F.lit(0), F.greatest(one, other) - first - 1))
    return F.size(F.filter(inner, lambda t: ~F.array_contains(F.array(*[F.lit(c) for c in ignored]), t)) if ignored else inner)


#: Kinds of annotations, each with the one that it is a case of.
KINDS = {"Sentence": "Annotation", "Token": "Annotation", "Constituent": "Annotation", "Concept": "Annotation", "DiscontinuousConcept": "Concept"}


def of_kind(annotations: DataFrame, kind: str) -> DataFrame:
    """Annotations (kind, ...) of a kind and of all that are cases of it; an unknown kind has none."""
    held = {kind}
    while more := {k for k, above in KINDS.items() if above in held} - held:
        held |= more
    return annotations.where(F.col("kind").isin(sorted(held)))


def add(annotations: DataFrame, more: DataFrame) -> DataFrame:
    """Annotations as a set; equal rows are one."""
    return annotations.unionByName(more).distinct()


def remove(annotations: DataFrame, gone: DataFrame) -> DataFrame:
    return annotations.join(gone, annotations.columns, "left_anti")


def merged(pairs: DataFrame) -> DataFrame:
    """(doc_id, start, end) from pairs (doc_id, start, other_doc_id, other_end) of a left and a right annotation; other documents are an error."""
    same = F.col("doc_id") == F.col("other_doc_id")
    return pairs.select(F.when(same, F.col("doc_id")).otherwise(F.raise_error(F.lit("annotations of two documents"))).alias("doc_id"), "start", F.col("other_end").alias("end"))


def corpus_stats(annotated: DataFrame, concepts: DataFrame) -> DataFrame:
    """One row of counts: documents, sentences, tokens; concepts, discontinuous ones and unigrams, with their types.

    concepts: (term, spans, is_disc).
    """
    base = annotated.agg(F.count_distinct("doc_id").alias("docs"), F.count(F.lit(1)).alias("sentences"), F.sum(F.size("words")).alias("tokens"))
    kinds: dict[str, Column] = {"concepts": F.lit(True), "disc": F.col("is_disc"), "unigrams": F.size("term") == 1}
    counts = [f(k, c) for k, c in kinds.items() for f in (lambda k, c: F.count_if(c).alias(k), lambda k, c: F.count_distinct(F.when(c, F.col("term"))).alias(f"{k}_types"))]
    return base.crossJoin(concepts.agg(*counts))


def count_concepts(concepts: DataFrame, discontinuous: bool = True, doc_frequency: bool = False) -> DataFrame:
    """(term, freq) of concepts (doc_id, term, is_disc): occurrences, or documents, with discontinuous ones or without."""
    some = concepts if discontinuous else concepts.where(~F.col("is_disc"))
    rows = some.select("doc_id", "term").distinct() if doc_frequency else some
    return rows.groupBy("term").agg(F.count(F.lit(1)).alias("freq"))
