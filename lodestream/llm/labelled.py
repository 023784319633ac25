"""A bounded sample of labelled texts for fitting a classifier on the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows, and bytes of text, that the driver holds at most.
MAX_ROWS, MAX_BYTES = 10_000, 40_000_000


def sample(docs: DataFrame, labels: DataFrame, label: str, train, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> tuple[list[str], np.ndarray]:
    """Texts and 0/1 labels of at most max_rows labelled documents and max_bytes of text.

    Rows come in the order of a hash of their ids, so that the sample is the
    same in each run; a longer input only gives a thinner sample.  A text that
    doesn't fit into what is left of max_bytes is skipped, smaller ones behind
    it are still taken.  Rows with a null text, label or id, or an id labelled
    both ways, are left out; rows that repeat both id and text count once, and
    an empty table on either side gives no rows.
    """
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).filter(train & F.col("y").isin(0, 1))
    own = own.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("z")).filter("y = z").select("doc_id", "y")
    own = own.orderBy(F.xxhash64(F.col("doc_id"), F.lit(7)), "doc_id").limit(max_rows)
    docs_ = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("text is not null")
    # the ids are at most max_rows, so their side is broadcast
    rows = docs_.join(F.broadcast(own), "doc_id").withColumn("size", F.octet_length("text"))
    # a text's share of the budget shrinks with the sample, not with the input
    sized = rows.select("doc_id", "size").orderBy(F.xxhash64(F.col("doc_id"), F.lit(7)), "doc_id").limit(max_rows).toPandas()
    left, taken = max_bytes, []
    for size in sized["size"].tolist():
        taken.append(size <= left)
        left -= size if taken[-1] else 0
    fits = sized[np.array(taken, bool)]
    if not len(fits):
        return [], np.zeros(0)
    last = F.broadcast(docs.sparkSession.createDataFrame(fits[["doc_id", "size"]].drop_duplicates()))
    found = rows.join(last, ["doc_id", "size"]).select("doc_id", "text", "y").toPandas().drop_duplicates(["doc_id", "text"]).sort_values(["doc_id", "text"])
    return found["text"].tolist(), found["y"].to_numpy(float)
