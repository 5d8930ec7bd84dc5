"""Sharding by jump consistent hashing, with DataFrame functions only.

A stable key alone decides the shard: the key seeds a 64-bit linear congruential generator, and the generator's jumps
name the shard without a ring table. When shards are appended, rows move only into the new ones.

Slots are numbered over ranges of rows that are ordered by the key's hash, the key, size and checksum. Equal rows are counted
first and dealt out again in chunks, so a key that a third of all rows share takes as many tasks as any other rows.

Defined results: a null key is a key like any other; repeated rows share a shard and take a slot each; null texts have
size 16 and crc32 0; an empty table gives an empty result; extra columns are left aside (internal columns have names
that start with two underscores).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import cut, table, text_of

#: Multiplier of the generator, as published with the algorithm.
MULTIPLIER = 2862933555777941757
LOW = 0xFFFFFFFF
SHARDS = 40
#: Bytes that a row takes besides its text.
ROW_BYTES = 16
#: Equal rows are dealt out in chunks of so many.
CHUNK = 1 << 14


def key_halves(key: Column) -> tuple[Column, Column]:
    """High and low 32 bits of the hashed key, from the MD5 digest of its text."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("\x00null")))
    return tuple(F.conv(F.substring(digest, at, 8), 16, 10).cast("long") for at in (1, 9))


def _advance(high: Column, low: Column) -> tuple[Column, Column]:
    """key * MULTIPLIER + 1 modulo 2**64 in 32-bit halves; no product leaves the range of a long."""
    m_high, m_low = MULTIPLIER >> 32, MULTIPLIER & LOW
    a = low.bitwiseAND(0xFFFF) * m_low + 1
    b = F.shiftright(low, 16) * m_low
    lower = a + F.shiftleft(b.bitwiseAND(0xFFFF), 16)
    upper = (
        F.shiftright(lower, 32)
        + F.shiftright(b, 16)
        + (low * m_high).bitwiseAND(LOW)
        + (high.bitwiseAND(0xFFFF) * m_low).bitwiseAND(LOW)
        + F.shiftleft((F.shiftright(high, 16) * m_low).bitwiseAND(0xFFFF), 16)
    )
    return upper.bitwiseAND(LOW), lower.bitwiseAND(LOW)


def jump(high: Column, low: Column, shards: int) -> Column:
    """struct(shard, grown_shard): the shard of a key among `shards`, and among one more.

    The jumps rise strictly, so the shard among n is the last jump below n, and one walk answers for n and n + 1.
    """
    zero = F.lit(0).cast("long")
    start = F.struct(high.alias("high"), low.alias("low"), zero.alias("to"), zero.alias("shard"), zero.alias("grown"))

    def step(s: Column, _: Column) -> Column:
        high, low = _advance(s["high"], s["low"])
        to = F.floor((s["to"] + 1) * (F.lit(float(1 << 31)) / (F.shiftright(high, 1) + 1)))
        shard = F.when(s["to"] < shards, s["to"]).otherwise(s["shard"])
        moved = F.struct(high.alias("high"), low.alias("low"), to.alias("to"), shard.alias("shard"), s["to"].alias("grown"))
        return F.when(s["to"] <= shards, moved).otherwise(s)

    def last(s: Column) -> Column:
        return F.struct(s["shard"].cast("int").alias("shard"), s["grown"].cast("int").alias("grown_shard"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(shards)), start, step, last)


def numbered(df: DataFrame, shard: str, order: list[str]) -> DataFrame:
    """df with slot: a gapless number from 0 in each shard, by `order`; rows of df are equal where order's columns are.

    A shard is numbered in ranges of its order, whose offsets are running sums over their counts, so that no task takes a
    whole shard. Slots do not depend on the ranges.
    """
    columns = df.columns
    counted = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("__n"))
    # written, since rows and offsets must come from the same ranges
    parts = cut(counted.repartitionByRange(shard, *order).withColumn("__part", F.spark_partition_id()))
    before = W.partitionBy(shard).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    sizes = parts.groupBy(shard, "__part").agg(F.sum("__n").alias("__all"))  # one row for each range and shard in it
    offsets = sizes.select(shard, "__part", F.coalesce(F.sum("__all").over(before), F.lit(0)).alias("__offset"))
    upto = W.partitionBy(shard, "__part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    placed = parts.withColumn("__before", F.coalesce(F.sum("__n").over(upto), F.lit(0))).join(offsets, [shard, "__part"]).withColumn("__first", F.col("__before") + F.col("__offset"))
    one = placed.where("__n = 1").select(*columns, F.col("__first").cast("long").alias("slot"))
    chunks = placed.where("__n > 1").withColumn("__chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1, F.lit(CHUNK).cast("long"))))
    many = chunks.repartition("__first", "__chunk").withColumn("__k", F.explode(F.sequence("__chunk", F.least(F.col("__chunk") + CHUNK, F.col("__n")) - 1)))
    return one.unionByName(many.select(*columns, (F.col("__first") + F.col("__k")).cast("long").alias("slot")))


def shard_rows(docs: DataFrame, shards: int = SHARDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, size, text_crc32, shard, slot and grown_shard of every row."""
    high, low = key_halves(F.col(key))
    keyed = docs.select(key, (F.octet_length(text_of(text)) + F.lit(ROW_BYTES)).cast("long").alias("size"), F.crc32(text_of(text).cast("binary")).alias("text_crc32"), high.alias("__high"), low.alias("__low"))
    placed = keyed.withColumn("__to", jump(F.col("__high"), F.col("__low"), shards)).select("*", "__to.shard", "__to.grown_shard")
    rows = placed.select(key, "size", "text_crc32", "__high", "__low", "shard", "grown_shard")
    return numbered(rows, "shard", ["__high", "__low", key, "size", "text_crc32"]).select(key, "size", "text_crc32", "shard", "slot", "grown_shard")


def op3_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shard_rows(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


#: CRC-32 is taken bit by bit from the bytes' hexadecimal text; jumps fold over a list, in 128-bit integers.
OP3_SQL = f"""
WITH crc_table AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i::BIGINT, range(8)), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c
    FROM range(256) r(i))),
bytes AS (
  SELECT doc_id, coalesce(text, '') AS text, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT) AS b,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, chr(0) || 'null')), 1, 16))::UBIGINT::HUGEINT AS k
  FROM documents),
hashed AS (
  SELECT doc_id, k, (octet_length(encode(text)) + {ROW_BYTES})::BIGINT AS size,
         xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: xor(t[1 + (xor(c, x) & 255)], c >> 8)))::BIGINT AS text_crc32,
         list_reduce(list_prepend({{'k': k, 'to': 0::BIGINT, 's': 0::BIGINT, 'g': 0::BIGINT}}, list_transform(range({SHARDS + 1}), lambda x: {{'k': k, 'to': 0::BIGINT, 's': 0::BIGINT, 'g': 0::BIGINT}})),
           lambda a, _: CASE WHEN a.to <= {SHARDS} THEN {{
             'k': ((a.k * {MULTIPLIER}::HUGEINT + 1) % 18446744073709551616::HUGEINT),
             'to': floor((a.to + 1) * (2147483648.0::DOUBLE / ((((a.k * {MULTIPLIER}::HUGEINT + 1) % 18446744073709551616::HUGEINT) // 8589934592::HUGEINT)::BIGINT + 1)::DOUBLE))::BIGINT,
             's': CASE WHEN a.to < {SHARDS} THEN a.to ELSE a.s END, 'g': a.to}} ELSE a END) AS j
  FROM bytes, crc_table)
SELECT doc_id, size, text_crc32, 'key' AS law, j.s::INTEGER AS shard,
       (row_number() OVER (PARTITION BY j.s ORDER BY k, doc_id, size, text_crc32) - 1)::BIGINT AS slot, j.g::INTEGER AS grown_shard
FROM hashed
"""
