"""From raw documents to packed training sequences, in five stages.

Each stage takes what the one before it kept, as written to Parquet, and all but the last return the columns of
documents: the quality classifier drops what it rejects, exact and near duplicates leave one document of each group, the
mix drops or repeats documents towards the sources' targets, and packing places the rest in sequences.

Stages decide over rows: where an id is null or several rows share it, a hash of id and text takes its place. Equal rows
are copies, of which one stays.

Defined results: null texts count as empty; an empty table passes through; extra columns pass through until packing,
which returns its own columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm import exact_dedup, mixing, near_dup, packing, quality
from lexiloom.llm.common import Sieve, cut, discard, table, tables_of, text_of, without

#: Words in a shingle of the near-duplicate stage.
SHINGLE = 5


def keyed(docs: DataFrame) -> DataFrame:
    """docs with __key, which tells rows apart: the id, or a hash of id and text where the id does not."""
    shared = cut(docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or doc_id is null").select("doc_id"))
    hashed = F.xxhash64(F.lit("row"), "doc_id", text_of())
    marked = Sieve(shared, "doc_id").marked(docs, "doc_id")
    return marked.select(*docs.columns, F.when(F.col("__hit") | F.col("doc_id").isNull(), hashed).otherwise(F.col("doc_id")).cast("long").alias("__key"))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier takes as good; it learns from the labels of rows that are not held out."""
    weights = quality.quality_model(docs, table(spark, sf_dir, "labels"))
    name = next(c for c in ("__score", *(f"__score{i}" for i in range(len(docs.columns)))) if c not in docs.columns)
    return quality.score(docs, weights, name).where(F.col(name) >= quality.GOOD).drop(name)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text: one with the largest id. Only rows whose text the operator finds repeated are shuffled."""
    repeated = cut(exact_dedup.equal_texts(docs).where("group_size > 1").select(F.col("text_sha256").alias("__sha")).distinct())
    marked = Sieve(repeated, "__sha").marked(docs.withColumn("__sha", F.sha2(text_of(), 256)), "__sha")
    order = ["doc_id", *(c for c in docs.columns if c != "doc_id")]
    one = marked.where("__hit").groupBy("__sha").agg(F.max(F.struct(*order)).alias("__row")).select(*[F.col("__row").getField(c).alias(c) for c in docs.columns])
    return marked.where("not __hit").select(docs.columns).unionByName(one)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: the one with the smallest key."""
    rows = keyed(docs)
    found = near_dup.linked(rows.select(F.col("__key").alias("doc_id"), "text"), SHINGLE)
    return without(rows, cut(found.where("doc_id != component_id").select(F.col("doc_id").alias("__key"))), "__key").select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    rows = keyed(docs)
    mixed = mixing.mix(rows.select(F.col("__key").alias("doc_id"), "text", "source"))
    taken = mixed.groupBy(F.col("doc_id").alias("__key")).agg(F.max("copies").alias("__copies")).where("__copies > 0")
    found = rows.join(taken, "__key")
    return found.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int")))).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, with their sequence and place."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("source mix", mix_sources),
    ("packing", pack),
]

#: SQL can express neither the classifier nor MinHash nor the tokenizer; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    with tables_of() as written:
        for _, stage in STAGES[:-1]:
            docs = cut(stage(spark, docs, sf_dir))
            discard(spark, written, kept=1)  # the next stage needs this one's output alone
        return STAGES[-1][1](spark, docs, sf_dir)
