"""Importance resampling towards a target corpus, by hashed runs of words.

Features of a text are all its runs of 1 to RUN words, each hashed into one of BUCKETS. A bucket's gain is the
logarithm of how much likelier the target draws it than the corpus does, smoothed, in whole thousandths; a document's
weight is the sum of its features' gains. The documents with the highest weight plus Gumbel noise are drawn, which is
sampling without replacement in proportion to the weights' exponentials.

A long text is no single piece of work. It is cut at word boundaries into chunks of about CHUNK bytes that carry RUN - 1 words
of the next one; a chunk owns the runs that start in its own words, so every run is counted in exactly one. The chunks of
long texts are dealt over all tasks, and what they give, features and weights, is summed by document. A text of one
chunk is counted where it is read. Bucket counts are added up within a task before they are shuffled; what is broadcast is
the gains, BUCKETS numbers. Ranks are taken over ranges of scores whose offsets are running sums, so no task sorts all.

Hashes of runs are not taken letter by letter: CRC-32 of two strings one after the other follows from both checksums and the
second's length, so each distinct word of a batch is hashed once and runs are combined.

Defined results: a null text has no words; texts without words have weight 0; a null id draws as the word null and comes
last among ties; repeated rows are rows of their own; with an empty target all gains follow from smoothing; an empty
table gives an empty result; extra columns are left aside.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, slices, table, text_of
from .sharding import numbered

RUN = 3
BUCKETS = 10_000
#: Bytes of a long text that a chunk owns, about: it begins and ends with a word.
CHUNK = 1 << 16
#: Documents of fewer words are not drawn, and of the others so many in a hundred are.
LEAST_WORDS, DRAWN = 20, 5
SEED = 42

#: Bytes as words see them: A-Z in lower case, and a blank for what parts words.
PLAIN = np.array([b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)], np.uint8)


def zero_shifts() -> np.ndarray:
    """For each power of two, what so many zero bytes make of each byte of a checksum: shape (power, byte of four, value)."""
    table_ = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table_ = np.where(table_ & 1, (table_ >> 1) ^ np.uint32(0xEDB88320), table_ >> 1)
    bits = np.uint32(1) << np.arange(32, dtype=np.uint32)
    images = table_[bits & 0xFF] ^ (bits >> 8)  # one zero byte, of each bit
    tables = np.zeros((31, 4, 256), np.uint32)
    for power in range(31):
        for value in range(256):
            for bit in range(8):
                if value >> bit & 1:
                    tables[power, :, value] ^= images[bit::8]
        images = tables[power, 0][images & 0xFF] ^ tables[power, 1][images >> 8 & 0xFF] ^ tables[power, 2][images >> 16 & 0xFF] ^ tables[power, 3][images >> 24]
    return tables


def joined_crc(one: np.ndarray, other: np.ndarray, length: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """CRC-32 of strings followed by others of the given lengths, from the checksums of both."""
    out = one.copy()
    for power in range(int(length.max(initial=0)).bit_length()):
        at = np.flatnonzero(length >> power & 1)
        x, t = out[at], shifts[power]
        out[at] = t[0][x & 0xFF] ^ t[1][x >> 8 & 0xFF] ^ t[2][x >> 16 & 0xFF] ^ t[3][x >> 24]
    return out ^ other


def plain(texts: pa.Array) -> pa.Array:
    """Texts in lower case, with blanks for all that parts words."""
    texts = pa.concat_arrays([pc.fill_null(texts, "")])
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8)[ends[0] : ends[-1]] if texts.buffers()[2] else np.zeros(0, np.uint8)
    return pa.StringArray.from_buffers(len(texts), pa.py_buffer((ends - ends[0]).tobytes()), pa.py_buffer(PLAIN[data].tobytes()))


def run_buckets(texts: pa.Array, owned: np.ndarray | None, shifts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bucket and the text of every run of words, and how many words each text owns.

    owned: how many words of each text runs may start at; all of them where it is None or below zero.
    """
    split = pc.ascii_split_whitespace(plain(texts))
    ends = split.offsets.to_numpy().astype(np.int64)
    words = split.values.slice(ends[0], ends[-1] - ends[0]).cast(pa.binary()).dictionary_encode()
    distinct = words.dictionary.to_numpy(zero_copy_only=False).tolist()
    crc = np.fromiter(map(zlib.crc32, distinct), np.uint32, len(distinct))
    after = np.fromiter((zlib.crc32(b" " + w) for w in distinct), np.uint32, len(distinct))
    size = np.fromiter(map(len, distinct), np.int64, len(distinct))
    number = words.indices.to_numpy()
    text = np.repeat(np.arange(len(texts)), np.diff(ends))
    real = size[number] > 0 if len(number) else np.zeros(0, bool)  # blanks at a text's ends leave empty words
    number, text = number[real], text[real]
    counts = np.bincount(text, minlength=len(texts))
    place = np.arange(len(number)) - (np.cumsum(counts) - counts)[text]
    mine = counts if owned is None else np.where(owned < 0, counts, np.minimum(owned, counts))
    starts = np.flatnonzero(place < mine[text])
    value = crc[number[starts]]
    buckets, owners = [value % BUCKETS], [text[starts]]
    for n in range(1, RUN):
        going = place[starts] + n < counts[text[starts]]
        starts, value = starts[going], value[going]
        then = number[starts + n]
        value = joined_crc(value, after[then], size[then] + 1, shifts)
        buckets.append(value % BUCKETS)
        owners.append(text[starts])
    return np.concatenate(buckets).astype(np.int64), np.concatenate(owners), mine


def cut_text(data: bytes) -> Iterator[tuple[bytes, int]]:
    """The chunks of a text's plain bytes, each with the words it owns; the words it carries come after these."""
    start = 0
    while start < len(data):
        stop = data.find(b" ", min(len(data), start + CHUNK))
        stop = len(data) if stop < 0 else stop
        own, end = data[start:stop], stop
        for _ in range(RUN - 1):  # the next words, of which there may be fewer
            while end < len(data) and data[end] == 0x20:
                end += 1
            end = data.find(b" ", end) if data.find(b" ", end) >= 0 else len(data)
        yield own + data[stop:end], len(own.split())
        start = stop


def chunks(docs: DataFrame) -> DataFrame:
    """key, text, chunk and owned of the chunks of docs (key, text) whose texts are longer than one, dealt over all tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            for key, text in zip(batch.column("key").to_pylist(), plain(batch.column("text")), strict=True):
                for i, (part, owned) in enumerate(cut_text(text.as_buffer().to_pybytes())):
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in ((key, pa.string()), (part.decode(), pa.string()), (i, pa.int64()), (owned, pa.int64()))], ["key", "text", "chunk", "owned"])

    return docs.select("key", "text").mapInArrow(run, "key string, text string, chunk long, owned long").repartition("key", "chunk")


def parted(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs (..., text) whose texts are one chunk, and the others."""
    long_ = F.octet_length(text_of()) > CHUNK
    return docs.where(~long_), docs.where(long_)


def bucket_counts(docs: DataFrame) -> DataFrame:
    """(bucket, n): how many features of docs (text) fall into each bucket that has any."""
    tables = zero_shifts()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(BUCKETS, np.int64)
        for batch in slices(batches, "text"):
            owned = batch.column("owned").to_numpy()
            n += np.bincount(run_buckets(batch.column("text"), owned, tables)[0], minlength=BUCKETS)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(n[some], pa.int64())], ["bucket", "n"])

    short, long_ = parted(docs.select("text"))
    whole = lambda df: df.select("text", F.lit(-1).cast("long").alias("owned"))
    pieces = chunks(long_.select(F.lit("").alias("key"), "text")).select("text", "owned")
    each = [df.mapInArrow(run, "bucket long, n long") for df in (whole(short), pieces)]
    return each[0].unionByName(each[1]).groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame) -> np.ndarray:
    """The gain of each bucket, from the features of docs and of target (text)."""
    spark = docs.sparkSession
    both = spark.range(BUCKETS).toDF("bucket").join(bucket_counts(docs).toDF("bucket", "s"), "bucket", "left").join(bucket_counts(target).toDF("bucket", "t"), "bucket", "left")
    filled = cut(both.select("bucket", *[F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in ("s", "t")]))
    all_ = filled.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    likelier = (F.col("t") + 1) * (F.col("all_s") + BUCKETS) / ((F.col("s") + 1) * (F.col("all_t") + BUCKETS))
    rows = filled.crossJoin(F.broadcast(all_)).select("bucket", F.floor(1000 * F.ln(likelier)).cast("long").alias("gain")).collect()  # BUCKETS rows
    out = np.zeros(BUCKETS, np.int64)
    for bucket, gain in rows:
        out[bucket] = gain
    return out


def weighed(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features and weight of every row of docs (doc_id, text)."""
    tables, held = zero_shifts(), docs.sparkSession.sparkContext.broadcast(gain)

    def run(kept: str):
        def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, "text"):
                bucket, text, words = run_buckets(batch.column("text"), batch.column("owned").to_numpy(), tables)
                n = np.bincount(text, minlength=len(batch))
                weight = np.zeros(len(batch), np.int64)
                np.add.at(weight, text, held.value[bucket])
                columns = [batch.column(kept), batch.column("chunk"), *[pa.array(v, pa.int64()) for v in (words, n, weight)]]
                yield pa.RecordBatch.from_arrays(columns, [kept, "chunk", "n_words", "n_features", "weight"])

        return answer

    schema = "chunk long, n_words long, n_features long, weight long"
    short, long_ = parted(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    zero, everything = F.lit(0).cast("long").alias("chunk"), F.lit(-1).cast("long").alias("owned")
    done = short.select("doc_id", "text", zero, everything).mapInArrow(run("doc_id"), f"doc_id long, {schema}").drop("chunk")
    # equal rows share a key: their sums are parted among them again
    keyed = long_.select(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.sha2("text", 256)).alias("key"), "text")
    parts = chunks(keyed).mapInArrow(run("key"), f"key string, {schema}")
    sums = parts.groupBy("key").agg(F.count_if(F.col("chunk") == 0).alias("copies"), *[F.sum(c).alias(c) for c in ("n_words", "n_features", "weight")])
    own = F.split_part("key", F.lit(":"), F.lit(1))
    doc_id = F.when(own != "null", own).cast("long")
    once = sums.select(doc_id.alias("doc_id"), *[F.expr(f"{c} div copies").alias(c) for c in ("n_words", "n_features", "weight")], F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("__copy"))
    return done.unionByName(once.drop("__copy"))


def noise(key: Column) -> Column:
    """Gumbel noise of a row's key, in whole thousandths."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{SEED}:"), F.coalesce(key.cast("string"), F.lit("null"))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def resample(docs: DataFrame, target: DataFrame, least_words: int = LEAST_WORDS, drawn: int = DRAWN) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank (null where not drawn) of every row of docs (doc_id, text), towards target (text)."""
    scored = cut(weighed(docs, gains(docs, target)).withColumn("score", F.col("weight") + noise(F.col("doc_id"))))
    able = scored.where(F.col("n_words") >= least_words)
    kept = able.agg(F.floor(F.count(F.lit(1)) * drawn / 100).alias("__kept"))  # one row
    order = able.withColumns({"__low": -F.col("score"), "__none": F.col("doc_id").isNull(), "__one": F.lit(0)})
    placed = numbered(order, "__one", ["__low", "__none", "doc_id", "n_words", "n_features", "weight"])
    rank = F.when(F.col("slot") < F.col("__kept"), F.col("slot") + 1)
    ranked = placed.crossJoin(F.broadcast(kept)).select(*scored.columns, rank.alias("rank"))
    return ranked.unionByName(scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long")))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")
