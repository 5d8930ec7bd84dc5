"""What the operators of this subpackage share: tables, lineage cuts and Arrow slices."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import cache

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that parts words, as a class body; everything else belongs to a word.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@cache
def own_dir(application: str) -> str:
    """A local folder for one application that runs on this machine alone."""
    return tempfile.mkdtemp(prefix="spark-")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share. Where it is unset a local session gets a
    folder of its own; a cluster must name one."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not folder and context.master.startswith("local") and not context.master.startswith("local-cluster"):
        folder = own_dir(context.applicationId)
    if not folder:
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return folder


#: The folders that the innermost tables_of block of this thread has written.
_OWN: ContextVar[list[str] | None] = ContextVar("own", default=None)


@contextmanager
def tables_of() -> Iterator[list[str]]:
    """The folders that cut writes within the block, in order, as a list; what is left in it at the end goes to the block around.

    Each thread has its own blocks, so that calls side by side do not see each other's tables.
    """
    own: list[str] = []
    token = _OWN.set(own)
    try:
        yield own
    finally:
        _OWN.reset(token)
        if (outer := _OWN.get()) is not None:
            outer.extend(own)


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again: lineage ends here, and lost executors take nothing with them."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/lexiloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if (own := _OWN.get()) is not None:
        own.append(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, written: list[str], kept: int = 0) -> None:
    """Deletes all tables of a block but the last `kept`; nothing that is still to be read may depend on them."""
    gone = written[: len(written) - kept]
    del written[: len(gone)]
    for path in gone:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def text_of(column: str = "text"):
    """A null text counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def slices(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 1 << 20, max_rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of about max_bytes of the column; a longer row makes a piece of its own."""
    for batch in batches:
        lengths = pa.compute.binary_length(batch.column(column)).fill_null(0).to_pylist()
        start = total = 0
        for i, n in enumerate(lengths):
            if i > start and (total + n > max_bytes or i - start >= max_rows):
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if start < len(lengths):
            yield batch.slice(start)
        del batch
        pa.default_memory_pool().release_unused()


#: Words of 64 bits in a sieve, at most: what is broadcast has this bound, however many keys there are.
SIEVE_WORDS = 1 << 18


class Sieve:
    """A bitmap of hashed keys that passes every row whose key is among them and few others; as bits fill up it passes more.

    It goes before a shuffle that only rows with these keys need: the bitmap is a table of SIEVE_WORDS rows at most, so it
    is broadcast at any scale. keys must be a written table, since it is counted first.
    """

    def __init__(self, keys: DataFrame, column: str):
        self.words = min(SIEVE_WORDS, max(64, 1 << (keys.count() // 4).bit_length()))
        word, bit = self._place(column)
        one = F.call_function("shiftleft", F.lit(1).cast("long"), bit)
        self.bits = F.broadcast(keys.select(word.alias("__word"), one.alias("__bits")).groupBy("__word").agg(F.bit_or("__bits").alias("__bits")))

    def _place(self, column: str):
        h = F.xxhash64(F.lit("sieve"), F.col(column))
        return F.pmod(h, F.lit(self.words)), F.shiftright(h, 40).bitwiseAND(63).cast("int")

    def marked(self, df: DataFrame, column: str) -> DataFrame:
        """df with __hit: whether a row's key may be among the sieve's."""
        word, bit = self._place(column)
        joined = df.join(self.bits, word == F.col("__word"), "left")
        return joined.withColumn("__hit", F.coalesce(F.call_function("getbit", F.col("__bits"), bit) == 1, F.lit(False))).drop("__word", "__bits")

    def passed(self, df: DataFrame, column: str) -> DataFrame:
        return self.marked(df, column).where("__hit").drop("__hit")


def without(df: DataFrame, dropped: DataFrame, column: str) -> DataFrame:
    """df without the rows whose key is in dropped, a written table; only rows that the sieve passes are shuffled."""
    marked = Sieve(dropped, column).marked(df, column)
    kept = marked.where("not __hit").select(df.columns)
    return kept.unionByName(marked.where("__hit").select(df.columns).join(dropped.select(column).distinct(), column, "left_anti").select(df.columns))
