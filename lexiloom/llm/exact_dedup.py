"""Exact deduplication by counting quotient filters.

Each partition builds filters over the 64-bit fingerprints of its texts, one for each block of leading bits. The blocks
merge losslessly by their sorted remainders, so a fingerprint's count is exact over the whole table, and what crosses the
network is a slot for each fingerprint and partition, however often a text repeats. Where many blocks are needed, filters of
MERGED partitions merge first and part by STEP bits more, level by level, so that a filter always holds thousands of
slots. Only texts whose fingerprint counts
more than one (and the few others that their bounded, broadcast bitmap passes) are compared byte by byte, grouped by the
text itself with a partial aggregate before the shuffle; groups of one drop out.

Defined results: null counts as empty, so null and empty texts are equal; of equal texts the row with the largest doc_id
stays (a null doc_id is below all others); a row repeated with its doc_id is the same document, and both copies carry the
same decision; an empty table gives an empty result; extra columns are left aside.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import quotient
from .common import Sieve, cut, table, text_of

#: Fingerprints in a filter block, about.
BLOCK_ROWS = 1 << 15
#: Leading bits by which filters part at one level, and partitions whose filters merge between levels.
STEP, MERGED = 8, 64
FILTER = "block long, part long, filter binary"


def lead_bits(rows: int) -> int:
    """Leading bits that part the fingerprints into blocks of about BLOCK_ROWS."""
    return min(40, max(4, (rows // BLOCK_ROWS).bit_length()))


def encoded(found: np.ndarray, counts: np.ndarray, lead: int, part: int) -> pa.RecordBatch:
    """FILTER rows of sorted fingerprints and their counts, one for each block of leading bits."""
    blocks = (found >> np.uint64(64 - lead)).astype(np.int64)
    starts = np.append(np.flatnonzero(np.diff(blocks, prepend=-1)), len(blocks))
    parts = [(int(blocks[a]), quotient.encode(found[a:b], counts[a:b], lead)) for a, b in zip(starts[:-1], starts[1:], strict=True)]
    return pa.RecordBatch.from_arrays([pa.array([b for b, _ in parts], pa.int64()), pa.array([part] * len(parts), pa.int64()), pa.array([f for _, f in parts], pa.binary())], ["block", "part", "filter"])


def partition_filters(fingerprints: DataFrame, lead: int) -> DataFrame:
    """FILTER of each partition of a table with the long column fp, over `lead` leading bits."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        part = TaskContext.get().partitionId()
        for batch in batches:
            new = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            kept = quotient.tally(np.concatenate((kept[0], new)), np.concatenate((kept[1], np.ones(len(new), np.int64))))
            if len(kept[0]) > 2_000_000:  # bounds memory; the merge takes any number of filters
                yield encoded(*kept, lead, part)
                kept = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        yield encoded(*kept, lead, part)

    return fingerprints.mapInArrow(build, FILTER)


def united(filters: list[bytes], block: int, lead: int) -> tuple[np.ndarray, np.ndarray]:
    """The fingerprints of filters of one block, with their counts added."""
    parts = [quotient.decode(f, block, lead) for f in filters]
    return quotient.tally(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))


def merged(filters: list[bytes], block: int, lead: int) -> bytes:
    """The union of filters of one block, counts added."""
    return quotient.encode(*united(filters, block, lead), lead)


def merged_filters(filters: DataFrame, lead: int) -> DataFrame:
    """One (block, filter) for each block of the partitions' filters."""

    def merge(key: tuple, group: pa.Table) -> pa.Table:
        whole = merged(group.column("filter").to_pylist(), key[0].as_py(), lead)
        return pa.table({"block": pa.array([key[0].as_py()], pa.int64()), "filter": pa.array([whole], pa.binary())})

    return filters.groupBy("block").applyInArrow(merge, "block long, filter binary")


def refined(filters: DataFrame, lead: int, to: int) -> DataFrame:
    """FILTER over `to` leading bits, from those over `lead`: the filters of MERGED parts become one part."""

    def refine(key: tuple, group: pa.Table) -> pa.Table:
        block, part = (k.as_py() for k in key)
        return pa.Table.from_batches([encoded(*united(group.column("filter").to_pylist(), block, lead), to, part)])

    return filters.withColumn("part", F.floor(F.col("part") / MERGED).cast("long")).groupBy("block", "part").applyInArrow(refine, FILTER)


def all_filters(fingerprints: DataFrame, lead: int) -> DataFrame:
    """FILTER over `lead` leading bits of a table with the long column fp, level by level."""
    at = min(lead, STEP)
    filters = partition_filters(fingerprints, at)
    while at < lead:
        filters, at = refined(filters, at, min(lead, at + STEP)), min(lead, at + STEP)
    return filters


def repeated(filters: DataFrame, lead: int) -> DataFrame:
    """The fingerprints that the partitions' filters, merged, count more than once: (fp, n)."""

    def read(key: tuple, group: pa.Table) -> pa.Table:
        found, counts = united(group.column("filter").to_pylist(), key[0].as_py(), lead)
        many = counts > 1
        return pa.table({"fp": pa.array(found[many].view(np.int64)), "n": pa.array(counts[many])})

    return filters.groupBy("block").applyInArrow(read, "fp long, n long")


def equal_texts(docs: DataFrame, rows: int | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row of docs (doc_id, text)."""
    lead = lead_bits(docs.count() if rows is None else rows)
    whole = docs.select("doc_id", text_of().alias("text"))
    marked = whole.withColumn("fp", F.xxhash64("text"))
    filters = all_filters(marked.select("fp"), lead)
    candidates = Sieve(cut(repeated(filters, lead).select("fp")), "fp").passed(marked, "fp")
    same = candidates.groupBy("text").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    groups = same.where("group_size > 1").select(F.sha2("text", 256).alias("text_sha256"), "keep_id", "group_size")
    rows_ = whole.select("doc_id", F.sha2("text", 256).alias("text_sha256"))
    found = rows_.join(groups, "text_sha256", "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return found.select(
        "doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256"
    )


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return equal_texts(table(spark, sf_dir, "documents"))


OP7_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""
