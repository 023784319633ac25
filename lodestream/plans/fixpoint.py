"""Iterative plans: lineage is cut by written tables in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession

_own: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="lodestream-"))
    return _own[0]


#: Whether Spark deletes a query's shuffle files when it ends; else they stay until the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def without_shuffles(spark: SparkSession):
    """Queries that write a table inside leave no shuffle files behind."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


@contextmanager
def few_rows_a_batch(spark: SparkSession, rows: int = 4):
    """Tables written inside go through Python a few rows at a time: for rows of megabytes."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def cut(df: DataFrame) -> DataFrame:
    """Written and read again: survives lost executors, the plan starts anew, and the job's shuffle files go."""
    path = f"{shared_folder(df.sparkSession)}/fixpoint/{uuid.uuid4().hex}"
    with without_shuffles(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def uncut(df: DataFrame) -> None:
    """Deletes a table that ``cut`` wrote; nothing may read it any more."""
    spark = df.sparkSession
    for path in {name.rpartition("/")[0] for name in df.inputFiles()}:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def cut_counted(df: DataFrame, total: Column) -> tuple[DataFrame, int]:
    """As ``cut``, with an aggregate over all rows that the same job makes."""
    seen = Observation()
    out = cut(df.observe(seen, total.alias("total")))
    return out, seen.get["total"] or 0
