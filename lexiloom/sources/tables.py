"""Tables of a folder, and tables written on the way to end a lineage."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, where its files give fewer tasks than there are; larger inputs are left as they lie."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def dealt(df: DataFrame, key: str) -> DataFrame:
    """df dealt by a key, so that counts within it need no shuffle of what is counted. Rows of one key meet in one task.

    There are four tasks for each core or for each that reads the files, since little text becomes many rows.
    """
    return df.repartition(4 * max(df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()), key)


@cache
def own_folder(application: str) -> str:
    """A local folder for one application that runs on this machine alone."""
    return tempfile.mkdtemp(prefix="spark-")


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share; where it is unset, a local one in local
    mode. A cluster must name one."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not folder and context.master.startswith("local") and not context.master.startswith("local-cluster"):
        folder = own_folder(context.applicationId)
    if not folder:
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return folder


def written(df: DataFrame, by: str | None = None) -> DataFrame:
    """df written to the shared folder and read again: lineage ends here. by: a column of few values, one folder for each."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/lexiloom-{uuid.uuid4().hex}"
    (df.write if by is None else df.write.partitionBy(by)).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
