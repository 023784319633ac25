"""Link graphs and weighted graphs: PageRank, shortest paths, partitions."""

from __future__ import annotations

from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.fixpoint import cut, cut_counted, few_rows_a_batch, uncut

# The damping factor, and the error below which ranks have converged.
DAMPING, MAX_ERROR = 0.85, 0.001


def live_links(links: DataFrame, pages: DataFrame) -> DataFrame:
    """Links to pages that exist, as often as they come."""
    return links.join(pages.select(F.col("page").alias("dst")), "dst", "left_semi").select("src", "dst")


def dead_links(links: DataFrame, pages: DataFrame) -> DataFrame:
    return links.join(pages.select(F.col("page").alias("dst")), "dst", "left_anti").select("src", "dst")


def adjacency(links: DataFrame, pages: DataFrame) -> DataFrame:
    """(page, links): every page, with its live links sorted."""
    out = live_links(links, pages).groupBy("src").agg(F.sort_array(F.collect_list("dst")).alias("links"))
    return pages.join(out, pages.page == out.src, "left").select("page", F.coalesce("links", F.array().cast("array<string>")).alias("links"))


def outdegree(links: DataFrame) -> DataFrame:
    return links.groupBy("src").agg(F.count("*").alias("outdeg"))


class LinkGraph:
    """Pages, live links with multiplicity, and out-degrees, written once."""

    def __init__(self, links: DataFrame, pages: DataFrame):
        pages = cut(pages)
        live = cut(live_links(links, pages).groupBy("src", "dst").agg(F.count("*").alias("times")))
        degree = live.groupBy("src").agg(F.sum("times").alias("outdeg"))
        self.edges = cut(live.join(degree, "src").select("src", "dst", (F.col("times") / F.col("outdeg")).alias("share")))
        self.pages = cut(pages.join(self.edges.select(F.col("src").alias("page")).distinct().withColumn("linked", F.lit(True)), "page", "left").select("page", F.coalesce("linked", F.lit(False)).alias("linked")))
        self.n, self.dangling = self.pages.agg(F.count("*"), F.count_if(~F.col("linked"))).first()

    def start(self) -> DataFrame:
        return self.pages.select("page", "linked", F.lit(1.0 / max(self.n, 1)).alias("rank"))

    def step(self, ranks: DataFrame, dangling_mass: float) -> DataFrame:
        """(page, linked, rank, before): one round over all pages."""
        into = self.edges.join(ranks.select(F.col("page").alias("src"), "rank"), "src")
        into = into.groupBy(F.col("dst").alias("page")).agg(F.sum(F.col("rank") * F.col("share")).alias("in"))
        base = ((1 - DAMPING) + DAMPING * dangling_mass) / max(self.n, 1)
        out = ranks.withColumnRenamed("rank", "before").join(into, "page", "left")
        return out.select("page", "linked", (F.lit(base) + DAMPING * F.coalesce("in", F.lit(0.0))).alias("rank"), "before")


def pagerank(links: DataFrame, pages: DataFrame, iterations: int = -1) -> tuple[DataFrame, list[float]]:
    """Ranks (page, rank) and each round's error; -1: until the error is below MAX_ERROR.

    A round whose error grows by more than a tenth stops the run as not converging.
    """
    graph = LinkGraph(links, pages)
    ranks, mass = graph.start(), graph.dangling / max(graph.n, 1)
    errors: list[float] = []
    for _ in range(iterations) if iterations >= 0 else count():
        done = cut(graph.step(ranks, mass))
        mass, error = done.agg(F.sum(F.when(~F.col("linked"), F.col("rank")).otherwise(0.0)), F.sum(F.abs(F.col("rank") - F.col("before")))).first()
        mass, error = mass or 0.0, error or 0.0
        if errors and iterations < 0 and error > 1.1 * errors[-1]:
            raise ArithmeticError(f"the error grows: {errors[-1]} to {error}")
        errors.append(error)
        ranks = done.select("page", "linked", "rank")
        if iterations < 0 and error < MAX_ERROR:
            break
    return ranks.select("page", "rank"), errors


def ranked(ranks: DataFrame, limit: int | None = None) -> DataFrame:
    """By rank, largest first, then by page."""
    out = ranks.orderBy(F.desc("rank"), F.asc("page"))
    return out.limit(limit) if limit is not None else out


def last_edges(edges: DataFrame, order: str = "ord") -> DataFrame:
    """One edge for each (src, dst): the last that comes."""
    return edges.groupBy("src", "dst").agg(F.max_by("w", order).alias("w"))


def relax(dist: DataFrame, edges: DataFrame) -> DataFrame:
    """(v, d): distances over one more edge."""
    step = dist.withColumnRenamed("v", "src").join(edges, "src")
    return step.groupBy(F.col("dst").alias("v")).agg(F.min(F.col("d") + F.col("w")).alias("d"))


def shortest_paths(edges: DataFrame, vertices: DataFrame, source: int = 0, unreachable: int | None = None) -> DataFrame:
    """(v, d) for all vertices; only vertices that came nearer are relaxed again, until none does.

    A round is one job: known distances and those over one more edge are
    merged by vertex, written, and the vertices that came nearer are counted
    while they are written.
    """
    spark = edges.sparkSession
    edges = cut(edges.select("src", "dst", F.col("w").cast("long").alias("w")))
    state, fresh = spark.createDataFrame([(source, 0, True)], "v long, d long, fresh boolean"), 1
    while fresh:
        step = relax(state.filter("fresh").select("v", "d"), edges)
        both = state.select("v", F.col("d").alias("old"), F.lit(None).cast("long").alias("new")).unionByName(step.select("v", F.lit(None).cast("long").alias("old"), F.col("d").alias("new")))
        merged = both.groupBy("v").agg(F.min("old").alias("old"), F.min("new").alias("new"))
        nearer = F.coalesce(F.col("new") < F.col("old"), F.col("old").isNull())
        state, fresh = cut_counted(merged.select("v", F.least("old", "new").alias("d"), nearer.alias("fresh")), F.count_if("fresh"))
    out = vertices.select(F.col("v").cast("long").alias("v")).join(state.select("v", "d"), "v", "left")
    return out.select("v", F.coalesce("d", F.lit(unreachable).cast("long")).alias("d"))


_FAR = np.int64(1 << 50)


def _tile(raw: bytes | None, size: int) -> np.ndarray:
    if raw is None:
        return np.full((size, size), _FAR)
    return np.frombuffer(pa.decompress(raw, size * size * 8, codec="zstd", asbytes=True), np.int64).reshape(size, size).copy()


def _pack(tile: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(tile), codec="zstd", asbytes=True)


def _product(a: np.ndarray, b: np.ndarray, out: np.ndarray) -> np.ndarray:
    for k in range(a.shape[1]):
        np.minimum(out, a[:, k : k + 1] + b[k], out=out)
    return out


def _tiles(cells: DataFrame, size: int) -> DataFrame:
    """(bi, bj, tile) of cells (i, j, d long), for those tiles only that hold any."""

    def fill(frame: pd.DataFrame) -> pd.DataFrame:
        tile = _tile(None, size)
        np.minimum.at(tile, (frame["i"].to_numpy() % size, frame["j"].to_numpy() % size), frame["d"].to_numpy())
        return frame[["bi", "bj"]].iloc[:1].assign(tile=[_pack(tile)])

    cells = cells.select(*[F.col(c).cast("long").alias(c) for c in ("i", "j", "d")]).filter("i is not null and j is not null and d is not null")
    return cells.withColumns({"bi": F.floor(F.col("i") / size), "bj": F.floor(F.col("j") / size)}).groupBy("bi", "bj").applyInPandas(fill, "bi long, bj long, tile binary")


def minplus(a: DataFrame, b: DataFrame, size: int = 512) -> DataFrame:
    """(i, j, d): the least a[i, k] + b[k, j] over k, of whole numbers.

    Tiles meet, not cells: a pair of tiles makes one tile, whatever its cells
    share, so nothing grows with the paths.  Tiles without a cell aren't there.
    """
    left, right = cut(_tiles(a, size)), cut(_tiles(b, size))
    right = right.select(F.col("bi").alias("bk"), "bj", F.col("tile").alias("other"))

    def add(batches):
        now, sums = None, None
        for frame in batches:
            for bi, bj, x, y in zip(frame["bi"], frame["bj"], frame["tile"], frame["other"], strict=True):
                if (bi, bj) != now:
                    if now is not None:
                        yield from _cells(*now, sums, size)
                    now, sums = (bi, bj), _tile(None, size)
                _product(_tile(x, size), _tile(y, size), sums)
        if now is not None:
            yield from _cells(*now, sums, size)

    pairs = left.withColumnRenamed("bj", "bk").join(right, "bk").select("bi", "bj", "tile", "other")
    with few_rows_a_batch(a.sparkSession):
        return cut(pairs.repartition("bi", "bj").sortWithinPartitions("bi", "bj").mapInPandas(add, "i long, j long, d long"))


def _cells(bi: int, bj: int, tile: np.ndarray, size: int):
    """The cells of a tile that are reached, some rows of it at a time."""
    for low in range(0, size, 64):
        i, j = np.nonzero(tile[low : low + 64] < _FAR // 2)
        yield pd.DataFrame({"i": i + low + bi * size, "j": j + bj * size, "d": tile[low + i, j]})


def all_pairs(edges: DataFrame, n: int, size: int = 512) -> DataFrame:
    """(i, j, d) of all reachable pairs: blocked Floyd-Warshall over tiles.

    Each round closes the pivot tile, brings the tiles of its row and column up
    to it, and then all others, each with one tile of the row and one of the
    column, found by equi-joins.  Tiles without a cell aren't there, and a round's
    tables go when the next one's are written.  Only the pivot tile is broadcast: its size is
    fixed.  The diagonal is 0.
    """
    spark, blocks = edges.sparkSession, max(1, -(-n // size))

    def fill(frame: pd.DataFrame) -> pd.DataFrame:
        bi, bj = int(frame["bi"].iloc[0]), int(frame["bj"].iloc[0])
        tile = _tile(None, size)
        own = frame[frame["w"].notna()]
        np.minimum.at(tile, (own["src"].to_numpy(int) % size, own["dst"].to_numpy(int) % size), own["w"].to_numpy(np.int64))
        if bi == bj:
            np.fill_diagonal(tile, 0)
        return pd.DataFrame({"bi": [bi], "bj": [bj], "tile": [_pack(tile)]})

    put = edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), F.col("w").cast("long").alias("w"))
    put = put.withColumn("bi", F.expr(f"src div {size}")).withColumn("bj", F.expr(f"dst div {size}")).filter(F.col("bi").between(0, blocks - 1) & F.col("bj").between(0, blocks - 1))
    none = F.lit(None).cast("long")
    put = put.unionByName(spark.range(blocks).select(none.alias("src"), none.alias("dst"), none.alias("w"), F.col("id").alias("bi"), F.col("id").alias("bj")))
    tiles = cut(put.groupBy("bi", "bj").applyInPandas(fill, "bi long, bj long, tile binary"))
    for r in range(blocks):
        pivot = tiles.filter(f"bi = {r} and bj = {r}").select(F.col("tile").alias("pivot"))  # one row of a fixed size

        def cross(batches, r=r):
            pivot = None
            for frame in batches:
                done = []
                for bi, bj, raw, first in zip(frame["bi"], frame["bj"], frame["tile"], frame["pivot"], strict=True):
                    if pivot is None:
                        pivot = _tile(first, size)
                        for k in range(size):
                            np.minimum(pivot, pivot[:, k : k + 1] + pivot[k], out=pivot)
                    tile = _tile(raw, size)
                    done.append(_pack(pivot if bi == bj else _product(pivot, tile, tile.copy()) if bi == r else _product(tile, pivot, tile.copy())))
                yield frame[["bi", "bj"]].assign(tile=done)

        def rest(batches):
            for frame in batches:
                done = []
                for t, a, b in zip(frame["tile"], frame["a"], frame["b"], strict=True):
                    if a is not None and b is not None:
                        tile = _product(_tile(a, size), _tile(b, size), _tile(t, size))
                        t = _pack(tile) if t is not None or (tile < _FAR // 2).any() else None
                    done.append(t)
                yield frame[["bi", "bj"]].assign(tile=done).dropna()

        with few_rows_a_batch(spark):
            crossed = cut(tiles.filter(f"bi = {r} or bj = {r}").join(F.broadcast(pivot)).mapInPandas(cross, tiles.schema))
        if blocks == 1:
            tiles = crossed
            break
        left = crossed.filter(f"bj = {r} and bi <> {r}").select("bi", F.col("tile").alias("a"))
        up = crossed.filter(f"bi = {r} and bj <> {r}").select("bj", F.col("tile").alias("b"))
        reached = left.select("bi").crossJoin(up.select("bj"))  # tiles that this round may give their first cell
        others = tiles.filter(f"bi <> {r} and bj <> {r}").join(reached, ["bi", "bj"], "full").join(left, "bi", "left").join(up, "bj", "left").select("bi", "bj", "tile", "a", "b")
        before = tiles
        with few_rows_a_batch(spark):
            tiles = cut(crossed.unionByName(others.mapInPandas(rest, tiles.schema)))
        for old in (before, crossed):
            uncut(old)

    def spread(batches):
        for frame in batches:
            for bi, bj, raw in zip(frame["bi"], frame["bj"], frame["tile"], strict=True):
                tile = _tile(raw, size)
                for cells in _cells(bi, bj, tile, size):
                    yield cells[(cells["i"] < n) & (cells["j"] < n)]

    return tiles.mapInPandas(spread, "i long, j long, d long")


def part_first_char(key, parts: int):
    """The first character's code point by the number of parts; an empty key goes to 0."""
    return F.pmod(F.ascii(key), F.lit(parts))


def part_cyclic(v, parts: int):
    return F.pmod(v, F.lit(parts))


def part_block(v, n: int, parts: int):
    """Equal slices of n vertices; the last part takes the rest."""
    return F.least(F.floor(v / F.lit(max(1, n // parts))), F.lit(parts - 1))


def part_balanced(degree: DataFrame, parts: int) -> DataFrame:
    """(v, part): consecutive vertices in parts of about as many edges each.

    A vertex goes to the part that the edges before it have filled.  Running
    sums are made inside slices of vertices, and over the slices' totals, so
    no window has all vertices.
    """
    slice_ = 4096
    from pyspark.sql.window import Window

    parted = degree.withColumn("s", F.expr(f"cast(v div {slice_} as long)"))
    totals = parted.groupBy("s").agg(F.sum("degree").alias("t"))
    before = totals.select("s", (F.sum("t").over(Window.orderBy("s")) - F.col("t")).alias("before"), F.sum("t").over(Window.partitionBy()).alias("all"))
    own = F.sum("degree").over(Window.partitionBy("s").orderBy("v").rowsBetween(Window.unboundedPreceding, -1))
    seen = parted.join(before, "s").withColumn("seen", F.coalesce(own, F.lit(0)) + F.col("before"))
    share = F.floor(F.col("seen") * F.lit(parts) / F.greatest(F.col("all"), F.lit(1)))
    return seen.select("v", F.least(share, F.lit(parts - 1)).cast("int").alias("part"))
