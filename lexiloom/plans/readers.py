"""Queries of the corpus readers: the target corpus is rendered in each format and read back.

Every thirteenth document of the inline corpus is left without its end, so that what cannot be read shows with its reason.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.functions.text import rule_tag
from lexiloom.operators import annotate
from lexiloom.sources import corpora, formats
from lexiloom.sources.tables import dealt, shared_folder, table

#: Documents whose number this divides are rendered without their end.
BROKEN = 13


def english(spark: SparkSession, d: str) -> DataFrame:
    """Dealt by number, so that a document's lines meet in the task that reads it."""
    return dealt(table(spark, d, "documents").where("lang = 'en'").select("doc_id", "text"), "doc_id")


def rendered(spark: SparkSession, d: str, line: Column, before: str = "", after: str = "") -> DataFrame:
    """(doc_id, text): a line for each sentence of a document, from its words and tags, in order."""
    lines = annotate.sentences(english(spark, d)).select("doc_id", F.struct("sent_id", line.alias("line")).alias("l"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("l")), lambda l: l["line"]), "\n")
    return lines.groupBy("doc_id").agg(F.concat(F.lit(before), joined, F.lit(after)).alias("text")).select(F.col("doc_id").cast("string").alias("doc_id"), "text")


def items(one) -> Column:
    """An item for each word, from one(word, tag). Both arrays are taken side by side: one looked up by number would be made again for each word."""
    return F.zip_with("words", "tags", one)


def placed(tables: dict[str, DataFrame], *kinds: str) -> DataFrame:
    """(doc_id, kind, start, end, pos) of some tables of a corpus."""
    none = F.lit(None).cast("string")
    parts = {
        "sentences": lambda df: df.select("doc_id", F.lit("sentence").alias("kind"), "start", "end", none.alias("pos")),
        "tokens": lambda df: df.select("doc_id", F.lit("token").alias("kind"), "start", "end", "pos"),
        "concepts": lambda df: df.select("doc_id", F.lit("concept").alias("kind"), F.get("spans", F.lit(0))["start"].alias("start"), F.element_at("spans", -1)["end"].alias("end"), none.alias("pos")),
    }
    out = None
    for k in kinds:
        one = parts[k](tables[k])
        out = one if out is None else out.unionByName(one)
    return out


def _slashed(spark: SparkSession, d: str) -> DataFrame:
    return rendered(spark, d, F.array_join(items(lambda w, t: F.concat(w, F.lit("/"), t)), " "))


def reader_slashed(spark, d):
    return corpora.slashed_annotations(_slashed(spark, d))


def _inline(spark: SparkSession, d: str) -> DataFrame:
    word = lambda w, t: F.concat(F.lit('<w c="'), t, F.lit('">'), w, F.lit("</w>"))
    one = lambda w, t: F.when(t == "n", F.concat(F.lit('<cons sem="N">'), word(w, t), F.lit("</cons>"))).otherwise(word(w, t))
    whole = rendered(spark, d, F.concat(F.lit("<sentence>"), F.array_join(items(one), " "), F.lit("</sentence>")), "<article>", "</article>")
    broken = F.col("doc_id").cast("long") % BROKEN == 0
    return whole.select("doc_id", F.when(broken, F.replace("text", F.lit("</article>"), F.lit(""))).otherwise(F.col("text")).alias("text"))


def reader_inline(spark, d):
    """All kinds in one pass, what cannot be read as bad with its reason's first word."""
    pos = F.when(F.col("kind") == "bad", F.split_part("reason", F.lit(":"), F.lit(1))).otherwise(F.col("pos"))
    return corpora.inline_annotations(_inline(spark, d)).select("doc_id", "kind", "start", "end", pos.alias("pos"))


def reader_vertical(spark, d):
    """A token to a line; commas are glued to what stands before them, and nouns are terms."""
    line = lambda w, t: F.concat_ws("\t", w, w, t)
    one = lambda w, t: F.when(t == "n", F.concat(F.lit("<term>\n"), line(w, t), F.lit("\n</term>"))).when(t == ",", F.concat(F.lit("<g/>\n"), line(w, t))).otherwise(line(w, t))
    texts = rendered(spark, d, F.concat(F.lit("<s>\n"), F.array_join(items(one), "\n"), F.lit("\n</s>")), "<doc>\n", "\n</doc>\n")
    return placed(corpora.vertical_tables(texts), "sentences", "tokens", "concepts")


def reader_annotations(spark, d):
    """Tokens written as annotation lines and read again."""
    spans = annotate.token_spans(english(spark, d)).select(F.col("doc_id").cast("string").alias("doc_id"), F.lit("Token").alias("kind"), "start", "end", rule_tag(F.lower("word")).alias("pos"))
    lines = corpora.annotation_lines(spans).groupBy("doc_id").agg(F.array_join(F.collect_list("line"), "\n").alias("text"))
    good, _ = corpora.parsed_annotations(lines)
    return good


def reader_blocks(spark, d):
    """All documents as blocks of a few files, read in splits: each block's checksum and length."""
    folder = f"{shared_folder(spark).rstrip('/')}/lexiloom-{uuid.uuid4().hex}"
    text = F.translate(F.coalesce("text", F.lit("")), "<>", "()")
    table(spark, d, "documents").select(F.concat(F.lit('<doc id="'), F.col("doc_id"), F.lit('">\n'), text, F.lit("\n</doc>"))).write.text(folder)
    return corpora.blocks(spark, folder).select("doc_id", F.char_length("text").cast("long").alias("n"), F.md5("text").alias("md5"))


def reader_terms(spark, d):
    """A term list of records: each item's first two words are a main term, the others its synonyms."""
    folder = f"{shared_folder(spark).rstrip('/')}/lexiloom-{uuid.uuid4().hex}"
    words = F.filter(F.split("text", r"[^A-Za-z]+"), lambda w: w != "")
    some = table(spark, d, "benchmark").select("item_id", words.alias("w")).where(F.size("w") >= 6)
    word = lambda i: F.get("w", F.lit(i))
    entry = F.concat(F.lit("*NEWRECORD\nRECTYPE = D\nMH = "), word(0), F.lit(" "), word(1), F.lit("\nENTRY = "), word(3), F.lit(", "), word(2), F.lit("\nPRINT ENTRY = no\nENTRY = "), word(4), F.lit("|x|"), word(5))
    some.orderBy("item_id").select(entry).coalesce(1).write.text(folder)  # a list is one file
    found = corpora.terms_in(corpora.records(spark, folder, "*NEWRECORD"), "MH", "ENTRY")
    return found.select(F.array_join("term", " ").alias("term"), "main")


def corpus_source(spark, d):
    """Files of many documents of word/tag items through spark.read.format: documents by length and tokens, and the reason of those that are none."""
    formats.register(spark)
    folder = f"{shared_folder(spark).rstrip('/')}/lexiloom-{uuid.uuid4().hex}"
    broken = F.col("doc_id").cast("long") % BROKEN == 0
    files = _slashed(spark, d).select("doc_id", F.when(broken, F.concat("text", F.lit(" untagged"))).otherwise(F.col("text")).alias("text"))
    files.select(F.to_json(F.struct("doc_id", "text"))).write.text(folder)
    read = spark.read.format("slashed_corpus").option("id", "record").load(folder)
    tokens = F.size(F.filter("rows", lambda r: r["kind"] == "token"))
    return read.select("doc_id", F.char_length("text").cast("long").alias("n"), tokens.alias("tokens"), "reason")


READERS = {f.__name__: f for f in (reader_slashed, reader_inline, reader_vertical, reader_annotations, reader_blocks, reader_terms, corpus_source)}
