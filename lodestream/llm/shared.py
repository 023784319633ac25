"""Session helpers of the subpackage: shared folder, cut lineage, doc folds."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..plans.fixpoint import without_shuffles

#: Rows in an Arrow batch; texts are long, and a batch is held twice.
BATCH_ROWS = "1000"


def prepare(spark: SparkSession) -> SparkSession:
    """Small Arrow batches, so that a Python worker's memory is bounded."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", "true")  # results for the driver come in columns
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    A folder of our own is taken only where that is unset (tests, one machine).
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not folder:
        folder = getattr(shared_folder, "own", None)
        if not folder:
            folder = shared_folder.own = tempfile.mkdtemp(prefix="lodestream-")
    return folder.rstrip("/")


#: Folders of the tables written since each open ``scratch`` began.
_open: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession):
    """Tables that are materialised inside are deleted at the end; those with ``keep`` belong to the scratch around it, if any."""
    _open.append([])
    try:
        yield
    finally:
        for path in _open.pop():
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def materialise(df: DataFrame, keep: bool = False) -> DataFrame:
    """Write as Parquet to the shared folder and read again: lineage ends here, and the job's shuffle files go."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/lodestream/{uuid.uuid4().hex}"
    if len(_open) > keep:
        _open[-1 - keep].append(path)
    with without_shuffles(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialise_counted(df: DataFrame, total: Column) -> tuple[DataFrame, int]:
    """As ``materialise``, with an aggregate over all rows that the same job makes."""
    seen = Observation()
    out = materialise(df.observe(seen, total.alias("total")))
    return out, seen.get["total"] or 0


#: Bits of the filter of ``only_ids``: a megabyte, whatever the number of ids.
FILTER_BITS = 23


def only_ids(rows: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose key may be among the ids, so that a join moves few others.

    A bitmap of hashed ids is broadcast; it has a fixed size and false
    positives only, and the caller's join decides.
    """
    mask = (1 << FILTER_BITS) - 1
    words = ids.selectExpr(f"xxhash64(id) & {mask}L AS slot").selectExpr("cast(slot >> 5 AS int) AS w", "shiftleft(1L, cast(slot & 31 AS int)) AS b")
    words = words.groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()
    bits = np.zeros(1 << (FILTER_BITS - 5), np.int64)
    bits[words["w"].to_numpy()] = words["b"].to_numpy()
    held = rows.sparkSession.sparkContext.broadcast(bits)

    def run(batches):
        bits = held.value
        for batch in batches:
            at = batch.column(batch.num_columns - 1).to_numpy()
            yield batch.filter(pa.array((bits[at >> 5] >> (at & 31)) & 1 == 1))

    slot = F.coalesce(F.xxhash64(F.col(key)).bitwiseAND(F.lit(mask)), F.lit(0).cast("long"))
    wide = rows.withColumn("__slot", slot)
    return wide.mapInArrow(run, wide.schema).select(*rows.columns)


def remainder(doc_id: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; null ids count as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
