"""Connected components, and exact grouping inside candidate families.

``components`` works on an edge table.  Each pass deals the edges out by their
larger end and joins what meets in a partition, until no node has two smaller
neighbours; what is left is a forest, whose nodes then jump to the root.
``ties`` turns buckets (key, side, id) into edges; a bucket that many partitions
hold is tied inside each of them first, so that one row of each travels.  No stage
has two Python functions, since each would take a worker of its own, that stays.
``resolve`` lets a function find the true groups inside each family without any
table of pairs.  Families above ``block`` members are dealt out as pairs of
blocks, so that no task holds more than two blocks.  Joins that may have a hot
key read written tables on both sides, which lets Spark split the key.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialise, materialise_counted
from .textkit import mix

#: Passes after which ``components`` gives up with a RuntimeError; each at least halves what random chains are left with.
MAX_ROUNDS = 60
#: Rows that a task holds at once before it condenses them.
_HELD = 1 << 20
#: Bits of a bucket's key that don't travel, those behind its range, and rows of whole ranges that a task ties at once.
_DROPPED, _REST = np.uint64(13), np.uint64(40)
_TIED = 1 << 18
_EDGES = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("forks", pa.int64())])
_STARS = "u long, v long, forks long"


def gathered(batches, rows: int = _HELD) -> Iterator[list[np.ndarray]]:
    """The columns of Arrow batches without nulls, about ``rows`` rows at a time."""
    held, size = [], 0
    for batch in batches:
        held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        size += batch.num_rows
        if size >= rows:
            yield [np.concatenate(c) for c in zip(*held)]
            held, size = [], 0
    if size:
        yield [np.concatenate(c) for c in zip(*held)]


def to_roots(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node reachable) of all nodes that aren't their own smallest."""
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    up = np.arange(len(ids))
    while True:
        x, y = up[a], up[b]
        apart = x != y
        if not apart.any():
            break
        np.minimum.at(up, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while True:
            higher = up[up]
            if (higher == up).all():
                break
            up = higher
    below = np.flatnonzero(up != np.arange(len(ids)))
    return ids[below], ids[up[below]]


def _contract(batches):
    """Edges (u, v, forks) of a partition as stars; forks counts the nodes' smaller neighbours beyond the first."""
    u = v = np.zeros(0, np.int64)
    forks = 0
    for more_u, more_v, *_ in gathered(batches):
        u, v = np.concatenate([u, more_u]), np.concatenate([v, more_v])
        order = np.lexsort((v, u))
        u, v = u[order], v[order]
        forks += int(((u[1:] == u[:-1]) & (v[1:] != v[:-1])).sum())
        u, v = to_roots(u, v)
    if len(u):
        count = np.zeros(len(u), np.int64)
        count[0] = forks
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(count)], schema=_EDGES)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): component is the smallest id reachable; only ids with edges.

    Rows with a null end or equal ends are ignored.  More than MAX_ROUNDS
    passes raise a RuntimeError.
    """
    ends = edges.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).filter("u is not null and v is not null and u <> v")
    return _joined(ends.mapInArrow(_contract, _STARS))


def _joined(now: DataFrame) -> DataFrame:
    """The components of edges that each partition has contracted."""
    for _ in range(MAX_ROUNDS):
        now, forks = materialise_counted(now.repartition("u").mapInArrow(_contract, _STARS), F.sum("forks"))
        if not forks:
            break
    else:
        raise RuntimeError("components didn't converge")
    now = now.select("u", "v")
    while True:
        up = now.select(F.col("u").alias("v"), F.col("v").alias("w"))
        now, moved = materialise_counted(now.join(up, "v", "left").select("u", F.coalesce("w", "v").alias("v"), F.col("w").isNotNull().alias("moved")), F.count_if("moved"))
        now = now.select("u", "v")
        if not moved:
            break
    roots = now.select("v").distinct()
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots.select(F.col("v").alias("id"), F.col("v").alias("component")))


class Forest:
    """Union-find; the root is the smallest member."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)


def bucket_key(hashed: np.ndarray, side: np.ndarray | int) -> np.ndarray:
    """The key of a bucket's row: 63 bits of a hash, and the side as the lowest bit, so that side 0 sorts first."""
    return ((hashed & np.uint64(0xFFFFFFFFFFFFFFFE)) | np.asarray(side).astype(np.uint64)).view(np.int64)


def _heads(key: np.ndarray) -> np.ndarray:
    """The first row of each sorted row's bucket."""
    new = np.ones(len(key), bool)
    new[1:] = key[1:] >> 1 != key[:-1] >> 1
    return np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))


def _tie_here(batches):
    """What a partition can tie itself becomes buckets of two, and one row of the bucket itself travels."""
    for key, id_ in gathered(batches):
        order = np.argsort(key)
        key, id_ = key[order], id_[order]
        head = _heads(key)
        tied = (head < np.arange(len(key))) & (key[head] & 1 == 0)
        pair = tied & (id_ != id_[head])
        a, b = id_[head][pair], id_[pair]
        own = bucket_key(mix(a.view(np.uint64) ^ mix(b.view(np.uint64))), 0)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([key[~tied], own, own])), pa.array(np.concatenate([id_[~tied], a, b]))], names=["key", "id"])


def _packed(batches):
    """Rows (key, id) as one row for each range of keys that a part of them touches: its keys, sorted, of 5 bytes, and the ids.

    Of a key the side and the first 51 bits of the hash go on; a row takes 13
    bytes, of which the sorted first one compresses.
    """
    for key, id_ in gathered(batches):
        key = key.view(np.uint64)
        key = key >> _DROPPED << np.uint64(1) | key & np.uint64(1)
        order = np.argsort(key)
        key, id_ = key[order], id_[order]
        at = key >> _REST
        first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        ends = np.append(first, len(key)).astype(np.int32)
        columns = [(key >> np.uint64(32)).astype(np.uint8), key.astype(np.uint32), id_]
        blobs = [pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(ends * np.int32(c.itemsize)), pa.py_buffer(c)]) for c in columns]
        yield pa.RecordBatch.from_arrays([pa.array(at[first].astype(np.int32)), *blobs], names=["range", "high", "low", "ids"])


def _unpacked(batch) -> tuple[np.ndarray, np.ndarray]:
    """Keys of 52 bits, and ids, of a batch of ranges."""
    out = []
    for column, kind in zip(batch.columns[1:], (np.uint8, np.uint32, np.int64)):
        ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
        out.append(np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(kind))
    high, low, id_ = out
    key = np.repeat(batch.column(0).to_numpy().astype(np.uint64), np.diff(ends) // 8) << _REST
    return key | high.astype(np.uint64) << np.uint64(32) | low, id_


def _tie_rows(batches):
    """Edges of ranges in ascending order: all rows of a bucket go to its first one, if that has side 0."""
    held, size = [], 0
    for batch in itertools.chain(batches, [None]):
        if batch is not None:
            held.append(_unpacked(batch))
            size += len(held[-1][0])
            if size < _TIED:
                continue
        if not size:
            continue
        key, id_ = (np.concatenate(c) for c in zip(*held))
        held, size = [], 0
        if batch is not None:  # the last range may go on
            last = np.searchsorted(key >> _REST, key[-1] >> _REST)
            held, size = [(key[last:], id_[last:])], len(key) - int(last)
            key, id_ = key[:last], id_[:last]
        order = np.argsort(key)
        key, id_ = key[order].view(np.int64), id_[order]
        head = _heads(key)
        edge = (key[head] & 1 == 0) & (id_ != id_[head])
        yield pa.RecordBatch.from_arrays([pa.array(id_[edge]), pa.array(id_[head][edge])], names=["a", "b"])


def _ranges(rows: DataFrame, made: Callable | None) -> DataFrame:
    here = rows.mapInArrow(lambda batches: _packed(_tie_here(made(batches) if made else batches)), "range int, high binary, low binary, ids binary")
    return here.repartition("range").sortWithinPartitions("range")


def ties(rows: DataFrame, made: Callable | None = None) -> DataFrame:
    """Edges (a, b) of rows (key, id), none null: all ids of a bucket that has an id of side 0 hang together.

    Keys are made by ``bucket_key``; an id of side 1 alone ties nothing.  With
    ``made``, a function of Arrow batches makes these rows from rows.  Rows
    travel packed by range of keys, and a task holds one range at a time or
    ``_TIED`` rows of small ones.
    """
    return _ranges(rows, made).mapInArrow(_tie_rows, "a long, b long")


def families(rows: DataFrame, made: Callable | None = None) -> DataFrame:
    """(id, family): ids whose rows (see ``ties``) hang together; lone ids are left out."""
    stars = _ranges(rows, made).mapInArrow(lambda batches: _contract(_tie_rows(batches)), _STARS)
    return _joined(stars).withColumnRenamed("component", "family")


def by_group(rows: DataFrame, keys: list[str], function: Callable[[pd.DataFrame], pd.DataFrame | None], schema: str, at_once: int = 0) -> DataFrame:
    """function on each group of two rows or more, over sorted partitions; groups have to be bounded.

    With ``at_once``, function gets as many whole groups as have about so many
    rows, told apart by the column ``group``: many small groups cost little
    each.  No more than these and a batch is held.
    """

    def run(batches):
        held, rows_held = [], 0
        for frame in itertools.chain(batches, [None]):
            if frame is not None:
                held.append(frame)
                rows_held += len(frame)
                if rows_held < at_once:
                    continue
            if not rows_held:
                continue
            rows = pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]
            group = rows[keys].to_numpy()
            bounds = np.array([0, *(np.flatnonzero((group[1:] != group[:-1]).any(axis=1)) + 1).tolist(), len(rows)])
            held, rows_held = [], 0
            if frame is not None:
                held, bounds = [rows.iloc[bounds[-2] :]], bounds[:-1]
                rows_held = len(held[0])
            size = np.diff(bounds)
            if at_once:
                rows = rows.iloc[: bounds[-1]].assign(group=np.repeat(np.arange(len(size)), size))[np.repeat(size > 1, size)]
                found = [function(rows.reset_index(drop=True))] if len(rows) else []
            else:
                found = [function(rows.iloc[a : a + n]) for a, n in zip(bounds.tolist(), size.tolist()) if n > 1]
            found = [x for x in found if x is not None]
            if found:
                yield pd.concat(found, ignore_index=True)

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(run, schema)


#: payloads, the first row of each group and the rows' number, forest over their positions to join links of one
#: group in, and None or an array: only pairs with a True at one of their ends need looking at
Linker = Callable[[list, np.ndarray, Forest, "np.ndarray | None"], None]

#: Members that each block of a large family is compared with at once.
PIVOTS = 4
#: Tasks that a member of a large family goes to at most before families meet by bucket instead, where that is possible.
DEALT = 16
#: Rows of whole groups that a linker gets at once.
_AT_ONCE = 512


def _linked(tasks: DataFrame, keys: list[str], payloads: DataFrame, linker: Linker) -> DataFrame:
    """Edges (a, b) found inside each task; tasks: keys, id, side, and label of those known to hang together."""

    def link(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["group", "id", "side"], ascending=[True, True, False]).drop_duplicates(["group", "id"])
        ids, group = frame["id"].to_numpy(), frame["group"].to_numpy()
        forest, seen = Forest(len(ids)), {}
        for i, x in enumerate(zip(group.tolist(), frame["label"].tolist())):
            forest.join(i, seen.setdefault(x, i))
        before = [forest.root(i) for i in range(len(ids))]
        side = frame["side"].to_numpy() > 0
        first = np.append(np.flatnonzero(np.append(True, group[1:] != group[:-1])), len(ids))
        linker(frame["payload"].tolist(), first, forest, None if side.all() else side)
        after = [forest.root(i) for i in range(len(ids))]
        new = [i for i in range(len(ids)) if after[i] != before[i] or before[i] != i]
        return pd.DataFrame({"a": ids[new], "b": ids[[after[i] for i in new]]}, dtype=np.int64)

    return by_group(tasks.join(payloads, "id"), keys, link, "a long, b long", _AT_ONCE)


def _bucket_rows(made: Callable):
    """(bucket, side, id, label, other) of rows (payload, id, label, other); an id comes once in a bucket, with side 0 if it has it."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            key, row = made(batch.column(0).to_pylist())
            order = np.lexsort((key, row))
            key, row = key[order], row[order]
            first = np.ones(len(key), bool)
            first[1:] = (row[1:] != row[:-1]) | (key[1:] >> 1 != key[:-1] >> 1)
            key, row = key[first], pa.array(row[first])
            yield pa.RecordBatch.from_arrays([pa.array(key >> 1), pa.array((key & 1).astype(np.int32)), *[batch.column(c).take(row) for c in (1, 2, 3)]], names=["bucket", "side", "id", "label", "other"])

    return run


def _linked_by_bucket(split: DataFrame, payloads: DataFrame, made: Callable, linker: Linker, block: int) -> DataFrame:
    """Edges (a, b) between members (id, label, other) of one bucket with unlike labels; other: the label isn't its family's largest.

    A bucket is looked at if it has an entry and two labels; of buckets of the
    same ids one is.  In one of more than a block either its entries or the
    others, whichever are fewer, meet all its blocks.
    """
    rows = materialise(split.join(payloads, "id").select("payload", "id", "label", "other").mapInArrow(_bucket_rows(made), "bucket long, side int, id long, label long, other boolean"))
    same = [F.bit_xor(F.xxhash64("id", F.lit(k))).alias(f"s{k}") for k in (0, 1)]
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.count_if(F.col("side") == 0).alias("entries"), F.count_if("other").alias("others"), F.min("label").alias("low"), F.max("label").alias("high"), *same, F.bit_xor(F.xxhash64("id", "side")).alias("sides"))
    sizes = sizes.filter("entries > 0 and low <> high").groupBy("n", "s0", "s1", F.expr("if(n > 2, sides, 0L)")).agg(F.min(F.struct("bucket", "entries", "others")).alias("b"))
    sizes = sizes.select("b.bucket", F.ceil(F.col("n") / block).cast("long").alias("blocks"), (F.col("b.entries") <= F.col("b.others")).alias("by_entry"), F.ceil(F.least("b.entries", "b.others") / block).cast("long").alias("groups"))
    met = rows.join(materialise(sizes), "bucket").select("bucket", "id", "label", "blocks", "groups", F.expr("if(by_entry, side = 0, other)").alias("all"))
    met = materialise(met.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks"))))
    every = met.filter("blocks > 1 or not all").select("bucket", "id", "label", "block", F.expr("explode(sequence(0L, groups - 1))").alias("group"), F.lit(0).alias("side"))
    alone = met.filter("all").select("bucket", "id", "label", F.expr("explode(sequence(0L, blocks - 1))").alias("block"), F.pmod(F.xxhash64("id", F.lit(1)), F.col("groups")).alias("group"), F.lit(1).alias("side"))
    return _linked(every.unionByName(alone), ["bucket", "block", "group"], payloads, linker)


def resolve(member: DataFrame, payloads: DataFrame, linker: Linker, block: int = 128, made: Callable | None = None, in_bucket: Linker | None = None) -> DataFrame:
    """(id, component) of the ids that the linker links, all others left out.

    member: (id, family) and payloads: (id long, payload), one row an id, both
    written tables.  Every pair of a family is looked at unless both ends are
    known to hang together, and pairs never leave a task: a task holds at most
    two blocks and returns one row per member.  A family of more than a block
    is dealt out to blocks first, each with the same few pivots; whoever isn't
    in the family's largest group then meets all its blocks.  With ``made``,
    that makes (key, position) of payloads' buckets, members of families that
    would go to more than DEALT tasks each meet by bucket instead, by the linker
    ``in_bucket``: a family that hangs together by chance then costs what its
    buckets hold, not the square of its size.
    """
    sizes = member.groupBy("family").agg(
        F.ceil(F.count("*") / block).cast("long").alias("blocks"),
        *[F.min(F.struct(F.xxhash64("id", F.lit(k)).alias("h"), "id"))["id"].alias(f"p{k}") for k in range(PIVOTS)],
    )
    sizes, any_large = materialise_counted(sizes.filter("blocks > 1"), F.count("*"))
    own = [F.lit(1).alias("side"), F.col("id").alias("label")]
    if not any_large:
        return components(materialise(_linked(member.select("id", "family", F.lit(0).cast("long").alias("block"), *own), ["family", "block"], payloads, linker)))
    dealt = member.join(sizes.select("family", "blocks"), "family", "left")
    dealt = dealt.select("id", "family", F.coalesce("blocks", F.lit(1)).alias("blocks")).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    pivots = sizes.select("family", F.explode(F.array_distinct(F.array(*[f"p{k}" for k in range(PIVOTS)]))).alias("id"), F.expr("sequence(0L, blocks - 1)").alias("to"))
    first = dealt.select("id", "family", "block").unionByName(pivots.select("id", "family", F.explode("to").alias("block")))
    edges = materialise(_linked(first.select("id", "family", "block", *own), ["family", "block"], payloads, linker))
    known = materialise(components(edges))
    large = dealt.filter("blocks > 1").join(known, "id", "left").select("id", "family", "blocks", "block", F.coalesce("component", "id").alias("label"))
    large = materialise(large)
    main = materialise(large.groupBy("family", "label").agg(F.count("*").alias("n")).groupBy("family").agg(F.max(F.struct("n", "label"))["label"].alias("main"), F.sum("n").alias("all"), F.max("n").alias("n")))
    apart = main.filter("all > n").select("family", "main", F.ceil((F.col("all") - F.col("n")) / block).cast("long").alias("groups"), "all")
    by_bucket = None
    if made:
        wide = F.col("groups") + F.ceil(F.col("all") / block) > DEALT
        met = large.join(apart.filter(wide), "family").select("id", "label", (F.col("label") != F.col("main")).alias("other"))
        met, any_met = materialise_counted(met, F.count("*"))
        by_bucket = materialise(_linked_by_bucket(met, payloads, made, in_bucket, block)) if any_met else None
        apart = apart.filter(~wide)
    split = large.join(apart, "family").withColumn("group", F.pmod(F.xxhash64("id", F.lit(1)), F.col("groups")))
    every = split.select("id", "family", "label", "block", F.expr("explode(sequence(0L, groups - 1))").alias("group"), F.lit(0).alias("side"))
    alone = split.filter("label <> main").select("id", "family", "label", F.expr("explode(sequence(0L, blocks - 1))").alias("block"), "group", F.lit(1).alias("side"))
    more, found = materialise_counted(_linked(every.unionByName(alone), ["family", "block", "group"], payloads, linker), F.count("*"))
    if by_bucket is not None:
        more, found = more.unionByName(by_bucket), 1
    return _with_more(known, more) if found else known


def _with_more(known: DataFrame, edges: DataFrame) -> DataFrame:
    """The components (id, component) of known ones and edges (a, b)."""
    return components(known.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(edges))
