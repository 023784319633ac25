"""Near-duplicate embeddings by spherical-cap filters.

Filter directions form random product codes: the rotated vector is cut into
``PARTS`` parts, each part has ``WORDS`` random unit words, and a direction is a
choice of one word for each part.  A vector belongs to all filters whose
direction it exceeds its threshold with.  The threshold is a vector's own, as
large as leaves ``LISTED`` directions: one for all would give vectors whose
parts are uneven thousands of filters, and others none.  List decoding finds
them without looking at all directions, as sums of two halves' scores.  Close
vectors share many filters.  Members of a filter meet in tasks of two blocks at
most, and a pair counts in the task of the smallest filter that it shares, so
that links are counted once without a table of pairs.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .clusters import Forest, by_group, components
from .shared import materialise, prepare

#: Codes, parts of a vector, words of a part, filters of a vector in each code.
CODES, PARTS, WORDS, LISTED = 2, 4, 64, 40
#: Members of a filter that meet others at once.
BLOCK = 128


class Code:
    """The product codes of one dimension; the same in each process."""

    def __init__(self, dimension: int):
        rng = np.random.default_rng(dimension)
        self.wide = max(8, -(-dimension // PARTS) * PARTS)
        self.turns, self.words = [], []
        for _ in range(CODES):
            self.turns.append(np.linalg.qr(rng.standard_normal((self.wide, self.wide)))[0][:dimension])
            words = rng.standard_normal((PARTS, WORDS, self.wide // PARTS))
            self.words.append(words / np.linalg.norm(words, axis=2, keepdims=True))

    def filters(self, unit: np.ndarray) -> np.ndarray:
        """The filters of each unit vector, ascending."""
        out = np.empty((len(unit), CODES * LISTED), np.int64)
        for k, (turn, words) in enumerate(zip(self.turns, self.words, strict=True)):
            parts = (unit @ turn).reshape(len(unit), PARTS, -1)
            s = [parts[:, m] @ words[m].T for m in range(PARTS)]
            left = (s[0][:, :, None] + s[1][:, None, :]).reshape(len(unit), -1)
            right = (s[2][:, :, None] + s[3][:, None, :]).reshape(len(unit), -1)
            # a direction among the best has both of its halves among the best
            p = np.argpartition(left, -LISTED, axis=1)[:, -LISTED:]
            q = np.argpartition(right, -LISTED, axis=1)[:, -LISTED:]
            both = np.take_along_axis(left, p, 1)[:, :, None] + np.take_along_axis(right, q, 1)[:, None, :]
            best = np.argpartition(both.reshape(len(unit), -1), -LISTED, axis=1)[:, -LISTED:]
            rows = np.arange(len(unit))[:, None]
            out[:, k * LISTED : (k + 1) * LISTED] = (k * WORDS**2 + p[rows, best // LISTED]) * WORDS**2 + q[rows, best % LISTED]
        return np.sort(out, axis=1)


@cache
def code(dimension: int) -> Code:
    return Code(dimension)


def _matrix(payloads: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(payloads), "<f8").reshape(len(payloads), -1)


def _decode(batches):
    schema = pa.schema([("id", pa.int64()), ("dimension", pa.int32()), ("filters", pa.list_(pa.int64()))])
    for batch in batches:
        ids, payloads = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        by_size: dict[int, list[int]] = {}
        for i, p in enumerate(payloads):
            by_size.setdefault(len(p) // 8, []).append(i)
        for dimension, own in by_size.items():
            for a in range(0, len(own), 256):
                part = own[a : a + 256]
                x = _matrix([payloads[i] for i in part])
                x = x / np.abs(x).max(axis=1, keepdims=True)
                found = code(dimension).filters(x / np.linalg.norm(x, axis=1, keepdims=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids[i] for i in part], pa.int64()), pa.array([dimension] * len(part), pa.int32()), pa.array(list(found), pa.list_(pa.int64()))], schema=schema
                )


def _pairs(frame: pd.DataFrame, threshold: float) -> pd.DataFrame | None:
    """Links of one task: (id, links, root) of the members that have any."""
    x = _matrix(frame["payload"].tolist())
    x = x / np.abs(x).max(axis=1, keepdims=True)
    norm = np.linalg.norm(x, axis=1)
    near = (x @ x.T) / (norm[:, None] * norm[None, :]) >= threshold
    np.fill_diagonal(near, False)
    if not near.any():
        return None
    block = frame["block"].to_numpy()
    if frame["p"].iloc[0] != frame["q"].iloc[0]:
        near &= block[:, None] != block[None, :]
    keep = near.any(axis=1)
    near, frame = near[keep][:, keep], frame[keep]
    if not len(frame):
        return None
    # pairs that meet in a smaller filter, too, count there
    here = frame["key"].iloc[0]
    low = [f[f < here] for f in map(np.asarray, frame["filters"])]
    _, column = np.unique(np.concatenate(low), return_inverse=True)
    shared = np.zeros((len(frame), (int(column.max()) + 1) if len(column) else 1), np.float32)
    shared[np.repeat(np.arange(len(frame)), [len(f) for f in low]), column] = 1
    near &= (shared @ shared.T) == 0
    forest = Forest(len(frame))
    for i, j in zip(*np.nonzero(np.triu(near, 1)), strict=True):
        forest.join(int(i), int(j))
    ids, links = frame["id"].to_numpy(), near @ frame["copies"].to_numpy()
    out = np.flatnonzero(links)
    return pd.DataFrame({"id": ids[out], "links": links[out], "root": ids[[forest.root(int(i)) for i in out]]}, dtype=np.int64)


def embedding_duplicates(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", threshold: float = 0.95) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of vectors.

    Two rows are linked when the cosine of their vectors, in double precision,
    is at least ``threshold``.  Vectors that are null, empty, zero or hold null
    or non-finite components, and vectors of different lengths, link with
    nothing.  n_links counts the other rows linked directly; rows that repeat
    (a vector or a vec_id) are rows of their own, so copies link with each
    other.  A null vec_id links with nothing, and has null component_id and
    kept false.  Other columns are ignored; an empty table gives no rows.
    """
    prepare(vectors.sparkSession)
    e = F.col("e")
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("e"))
    usable = F.col("id").isNotNull() & (F.size(e) > 0) & F.forall(e, lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)
    rows = rows.withColumn("ok", F.coalesce(usable, F.lit(False)))

    def pack(batches):
        for batch in batches:
            values = [np.asarray(x, "<f8").tobytes() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.binary())], names=["id", "payload"])

    packed = rows.filter("ok").select("id", F.transform("e", lambda x: x + F.lit(0.0)).alias("e")).mapInArrow(pack, "id long, payload binary")
    packed = packed.withColumn("d", F.sha2("payload", 256))
    # one representative of each vector, with its copies
    reps = materialise(packed.groupBy("d").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.first("payload").alias("payload")))
    # an id of two vectors must not merge them: representatives go by a number of their own
    reps = reps.withColumn("rep", F.xxhash64("d"))
    decoded = materialise(reps.select("rep", "payload").mapInArrow(_decode, "id long, dimension int, filters array<long>"))
    member = decoded.select("id", "dimension", F.explode("filters").alias("key"))
    sizes = member.groupBy("dimension", "key").agg(F.count("*").alias("n")).filter("n > 1")
    dealt = member.join(sizes, ["dimension", "key"]).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("long"))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks"))).withColumn("other", F.expr("explode(sequence(0L, blocks - 1))"))
    tasks = dealt.select("id", "dimension", "key", "block", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"))
    facts = decoded.select("id", "filters").join(reps.select(F.col("rep").alias("id"), "payload", "copies"), "id")
    found = by_group(tasks.join(facts, "id"), ["dimension", "key", "p", "q"], lambda frame: _pairs(frame, threshold), "id long, links long, root long")
    found = materialise(found)
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    group = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    # copies of one vector, and rows that share an id, hang together by their ids
    classes = reps.select("rep", "id", "d", "copies").join(group.withColumnRenamed("id", "rep"), "rep", "left")
    classes = classes.join(links.withColumnRenamed("id", "rep"), "rep", "left").withColumn("class", F.coalesce("component", "rep"))
    least = classes.groupBy("class").agg(F.min("id").alias("component_id"))
    classes = classes.join(least, "class").select("d", "component_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    good = packed.select("id", "d").join(classes, "d").select("id", "n_links", "component_id")
    bad = rows.filter("not ok").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return good.unionByName(bad).select(
        F.col("id").alias(vec_id), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept")
    )
