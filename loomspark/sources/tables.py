"""Parquet tables as the operators want them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


BATCH_ROWS, BATCH_BYTES = 256, 1 << 22


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """The same rows, dealt over all cores if the scan has fewer tasks than there are cores (a file of one row group, say).

    Work on texts is much dearer than moving them once; an input with enough tasks is left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def bounded(df: DataFrame) -> DataFrame:
    """The same rows; texts go to Python in batches of at most BATCH_ROWS rows and BATCH_BYTES bytes, as ten thousand of them fill a worker.

    The two settings are the session's and stay.
    """
    conf = df.sparkSession.conf
    rows = int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000"))
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(min(rows, BATCH_ROWS) if rows > 0 else BATCH_ROWS))
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def cut(df: DataFrame) -> DataFrame:
    """The same rows from a checkpoint in the folder of spark.checkpoint.dir (one in the warehouse where it is unset), without their lineage.

    For what several branches of a plan read: it is computed once, and a lost executor costs a reread.
    """
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        base = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/loomspark"
        spark.sparkContext.setCheckpointDir(base)
    return df.checkpoint()
