"""MinHash near-duplicates by SuperMinHash signatures.

An element's slots come in the order of its own random permutation and its
values grow with the rank in that order, so that a slot keeps the least
(rank, fraction) over the elements: one permutation in place of independent
hash functions.  A document stops as soon as all of its slots are filled, as
no later rank can lower any.  Signatures are cut into bands; documents that
share a band form candidate families, in which the full shingle sets decide.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .clusters import bucket_key, families, resolve
from .shared import materialise, materialise_counted, only_ids, prepare

SLOTS, BANDS = 120, 20
_U = np.uint64
_EMPTY = _U(0xFFFFFFFFFFFFFFFF)


#: Elements whose permutations are held at once.
_SLICE = 1 << 17


def signatures(sets: np.ndarray, sizes: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """SuperMinHash: (documents, slots) of rank << 32 | fraction.

    sets: the distinct hashed elements of all documents, sizes: their offsets.
    A document without elements keeps the largest value in all slots.  Large
    sets go in slices, whose least values are the whole set's.
    """
    out = _signatures(sets[:_SLICE], np.minimum(sizes, _SLICE), slots)
    for low in range(_SLICE, len(sets), _SLICE):
        part = sets[low : low + _SLICE]
        np.minimum(out, _signatures(part, np.clip(sizes - low, 0, len(part)), slots), out=out)
    return out


def _signatures(sets: np.ndarray, sizes: np.ndarray, slots: int) -> np.ndarray:
    n = len(sizes) - 1
    out = np.full(n * slots, _EMPTY)
    own = tk.rows_of(sizes)
    left = np.flatnonzero(np.diff(sizes))
    live, elements = own, sets
    order = np.tile(np.arange(slots, dtype=np.uint8 if slots <= 256 else np.uint16), (len(elements), 1))
    for rank in range(slots):
        draw = tk.mix(elements + _U((2 * rank + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        pick = rank + ((draw >> _U(32)) * _U(slots - rank) >> _U(32)).astype(np.int64)
        row = np.arange(len(elements))
        slot = order[row, pick]
        order[row, pick] = order[:, rank]
        np.minimum.at(out, live * slots + slot, _U(rank << 32) | (draw & _U(0xFFFFFFFF)))
        open_ = (out.reshape(n, slots)[left] == _EMPTY).any(axis=1)
        left = left[open_]
        if not len(left):
            break
        still = np.zeros(n, bool)
        still[left] = True
        keep = still[live]
        if not keep.all():
            live, elements, order = live[keep], elements[keep], order[keep]
    return out.reshape(n, slots)


_SKETCH = pa.schema(
    [("id", pa.int64()), ("h", pa.int64()), ("n", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("bands", pa.list_(pa.int64()))]
)


def _sketcher(width: int, slots: int, bands: int):
    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for a, b, data, offsets in tk.chunks(batch.column(2), 1 << 19):
                sets, sizes = tk.shingle_sets(data, offsets, width)
                values = signatures(sets, sizes, slots).reshape(b - a, bands, slots // bands)
                band = np.broadcast_to(np.arange(bands, dtype=np.uint64), (b - a, bands)).copy()
                for k in range(slots // bands):
                    band = tk.mix(band * _U(0xC2B2AE3D27D4EB4F) + values[:, :, k])
                yield pa.RecordBatch.from_arrays(
                    [
                        ids[a:b],
                        batch.column(1)[a:b],
                        pa.array(np.diff(sizes)),
                        pa.array(tk.segment_sum(tk.mix(sets), sizes).view(np.int64)),
                        pa.array(tk.segment_sum(tk.mix(sets ^ _U(0x5851F42D4C957F2D)), sizes).view(np.int64)),
                        pa.ListArray.from_arrays(pa.array(np.arange(0, (b - a + 1) * bands, bands), pa.int32()), pa.array(bucket_key(band.ravel(), 0))),
                    ],
                    schema=_SKETCH,
                )

    return run


def set_linker(width: int, percent: int):
    """Links documents with 100 * intersection >= percent * union of their full sets."""

    def link(texts, first, forest, side):
        data, offsets = tk.string_buffers(pa.array(texts, pa.large_string()))
        sets, sizes = tk.shingle_sets(data, offsets, width)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            near = _near(sets[sizes[a] : sizes[b]], sizes[a : b + 1] - sizes[a], percent)
            if side is not None:
                near &= side[a:b, None] | side[None, a:b]
            for i, j in zip(*np.nonzero(np.triu(near, 1)), strict=True):
                forest.join(a + int(i), a + int(j))

    return link


def _near(sets: np.ndarray, sizes: np.ndarray, percent: int) -> np.ndarray:
    """For each pair of sets whether 100 * intersection >= percent * union."""
    n, own, size = len(sizes) - 1, tk.rows_of(sizes), np.diff(sizes)
    _, column, times = np.unique(sets, return_inverse=True, return_counts=True)
    common = times[column] > 1
    _, column = np.unique(column[common], return_inverse=True)
    own = own[common]
    order = np.argsort(column, kind="stable")
    own, column = own[order], column[order]
    inter = np.zeros((n, n), np.float32)
    step = max(1, (1 << 21) // max(n, 1))
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, step):
        p, q = np.searchsorted(column, (low, low + step))
        part = np.zeros((n, min(step, int(column[-1]) + 1 - low)), np.float32)
        part[own[p:q], column[p:q] - low] = 1
        inter += part @ part.T
    inter = inter.astype(np.int64)
    near = 100 * inter >= percent * (size[:, None] + size[None, :] - inter)
    return near & (size[:, None] > 0) & (size[None, :] > 0)


def _grouped(docs: DataFrame, doc_id: str, text: str, width: int, percent: int) -> DataFrame:
    """(id, h, n, first): each row's id, text hash, set size and the first (missing, id, h) of its group; null without a set.

    Rows are told apart by id and text.  Groups are made of sets: a set, named
    by 128 bits and its size, is represented by its first row.
    """
    prepare(docs.sparkSession)
    docs = docs.select(F.col(doc_id).cast("long").alias("id"), F.xxhash64(doc_id, text).alias("h"), F.col(text).alias("payload"))
    sketch = materialise(docs.mapInArrow(_sketcher(width, SLOTS, BANDS), "id long, h long, n long, d1 long, d2 long, bands array<long>"))
    place = F.struct(F.col("id").isNull().alias("missing"), "id", "h")
    reps = sketch.filter("n > 0").groupBy("d1", "d2", "n").agg(F.min(F.struct(place.alias("at"), "bands")).alias("r"))
    reps = materialise(reps.select("d1", "d2", "n", "r.at", "r.bands", F.monotonically_increasing_id().alias("rep")))
    member = materialise(families(reps.select(F.explode("bands").alias("key"), F.col("rep").alias("id"))))
    wanted = materialise(member.join(reps.select(F.col("rep").alias("id"), "at"), "id").select(F.col("id").alias("rep"), F.col("at.id").alias("rid"), F.col("at.h").alias("rh")))
    texts = only_ids(docs, wanted.select(F.col("rh").alias("id")), "h").join(wanted, F.col("id").eqNullSafe(F.col("rid")) & (F.col("h") == F.col("rh")))
    texts = materialise(texts.groupBy(F.col("rep").alias("id")).agg(F.first("payload").alias("payload")))
    found = materialise(resolve(member, texts, set_linker(width, percent)).withColumnRenamed("id", "rep"))
    least = materialise(found.join(reps.select("rep", "at"), "rep").groupBy("component").agg(F.min("at").alias("least")))
    root = reps.select("d1", "d2", "n", "rep", "at").join(found, "rep", "left").join(least, "component", "left")
    root = root.select("d1", "d2", "n", F.coalesce("least", "at").alias("first"))
    return sketch.select("id", "h", "n", "d1", "d2").join(root, ["d1", "d2", "n"], "left").select("id", "h", "n", "first")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs.

    Words are runs of bytes other than space and \\t..\\r, A-Z lower-cased; a set
    holds the distinct shingles of ``width`` words, or the whole sequence when
    there are fewer.  Documents are linked when 100 * intersection >= percent *
    union; component_id is the smallest doc_id reachable.  Null and wordless
    texts have no shingles and link with nothing.  Each row is linked by its
    own text, also where rows share a doc_id; one with a null doc_id counts as
    a link, has kept false, and a group of such rows alone a null
    component_id.  Other columns are ignored.  An empty table gives no rows.
    """
    out = _grouped(docs, doc_id, text, width, percent)
    component = F.when(F.col("first").isNull(), F.col("id")).otherwise(F.col("first.id"))
    out = out.select(F.col("id").alias(doc_id), F.col("n").alias("n_shingles"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(doc_id) == F.col("component_id"), F.lit(False)))


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each group of near-duplicates: the first by doc_id, null ids last.

    Rows that repeat both doc_id and text are copies, too: one of them stays.
    Rows whose text is null or holds no word all stay.  All columns of docs are
    returned, whatever their names.
    """
    groups = materialise(_grouped(docs, doc_id, text, width, percent).filter("n > 0").select("id", "h", "first"))
    own = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("h") == F.col("first.h"))
    key = ["id", "h"]
    gone = materialise(groups.filter(~own).select(*key).distinct())
    again, repeats = materialise_counted(groups.filter(own).groupBy(*key).count().filter("count > 1").select(*key), F.count("*"))
    kinds = docs.schema.names
    rows = docs.toDF(*[f"c{k}" for k in range(len(kinds))])
    at, of = f"c{kinds.index(doc_id)}", f"c{kinds.index(text)}"
    rows = rows.withColumn("__id", F.col(at).cast("long")).withColumn("__h", F.xxhash64(at, of))
    same = F.col("__id").eqNullSafe(F.col("id")) & (F.col("__h") == F.col("h"))
    rows = rows.join(gone, same, "left_anti")
    if repeats:
        once = rows.join(again, same, "left_semi").dropDuplicates(["__id", "__h"])
        rows = rows.join(again, same, "left_anti").unionByName(once)
    return rows.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(kinds)])
