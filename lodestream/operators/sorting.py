"""Distributed sort with global positions, and its check."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.fixpoint import cut

_LOW = (1 << 33) - 1


def sort_positions(rows: DataFrame, value: str, partitions: int | None = None) -> DataFrame:
    """(pos, value) in ascending order: ranges, sorted inside, and offsets from the ranges' counts."""
    by_range = rows.select(value).repartitionByRange(partitions, value) if partitions else rows.select(value).repartitionByRange(value)
    done = by_range.sortWithinPartitions(value).withColumn("at", F.monotonically_increasing_id())
    done = cut(done.select(value, F.shiftright("at", 33).alias("range"), F.col("at").bitwiseAND(F.lit(_LOW)).alias("own")))
    # one row for each partition, so the window and the broadcast are as small as their number
    counts = done.groupBy("range").agg(F.count("*").alias("n"))
    starts = counts.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("start"))
    return done.join(F.broadcast(starts), "range").select((F.col("own") + F.col("start")).cast("long").alias("pos"), value)


def inversions(sorted_rows: DataFrame, value: str) -> DataFrame:
    """(inversions, n, is_sorted): neighbours in the wrong order; nulls are in none, NaN is the largest.

    Neighbours that lie in one batch are compared there; only positions whose
    neighbour lies elsewhere are joined.
    """
    schema = pa.schema([("bad", pa.int64()), ("n", pa.int64()), ("pos", pa.int64()), ("value", pa.float64()), ("is_last", pa.bool_())])

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            pos, x = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False).astype(float)
            ok = ~np.asarray(batch.column(1).is_null())
            order = np.argsort(pos, kind="stable")
            pos, x, ok = pos[order], np.where(np.isnan(x) & ok, np.inf, x)[order], ok[order]
            beside = pos[1:] == pos[:-1] + 1
            bad = int((beside & ok[1:] & ok[:-1] & (x[:-1] > x[1:])).sum())
            for last, border in ((True, np.append(~beside, True)), (False, np.append(True, ~beside))):
                at = np.flatnonzero(border)
                first = np.zeros((2, len(at)), np.int64)
                if last:
                    first[:, 0] = bad, len(pos)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(first[0]), pa.array(first[1]), pa.array(pos[at]), pa.array(x[at], mask=~ok[at]), pa.array(np.full(len(at), last))], schema=schema
                )

    rows = cut(sorted_rows.select("pos", value).mapInArrow(run, "bad long, n long, pos long, value double, is_last boolean"))
    ends = rows.filter("is_last").select((F.col("pos") + 1).alias("pos"), F.col("value").alias("before"))
    across = rows.filter("not is_last").join(ends, "pos").agg(F.count_if(F.col("before") > F.col("value")).alias("across"))
    out = rows.agg(F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).join(F.broadcast(across))
    return out.select((F.col("bad") + F.col("across")).alias("inversions"), "n").withColumn("is_sorted", F.col("inversions") == 0)


def differences(a: DataFrame, b: DataFrame, value: str) -> DataFrame:
    """(differ, n): positions at which two vectors differ; one that only one of them has differs."""
    right = b.select("pos", F.col(value).alias("other"))
    both = a.join(right, "pos", "full")
    return both.agg(F.count_if(~F.col(value).eqNullSafe(F.col("other"))).alias("differ"), F.count("*").alias("n"))
