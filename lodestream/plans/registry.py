"""All queries of the engine by name, with the SQL that each is checked against."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import grid, text
from ..operators import graph, sorting
from ..sources import binary
from . import fixtures as fx
from .fixpoint import shared_folder

PARTS = 8
GRID, MAX_ITER = (64, 48), 100
FAR = 1_000_000_000
WIDTH = 64


def _pages(spark, sf):
    return text.titles(fx.wiki_lines(spark, sf)).select("page").distinct()


def _links(spark, sf):
    return text.links(fx.wiki_lines(spark, sf))


def _last(spark, sf):
    return graph.last_edges(fx.edges(spark, sf))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.ranked(graph.pagerank(_links(spark, sf_dir), _pages(spark, sf_dir))[0])


def title_extract(spark, sf):
    wiki = text.titles(fx.wiki_lines(spark, sf)).select("page")
    html = text.titles(fx.table(spark, sf, "pages").select(F.col("html").alias("value"))).select("page")
    return wiki.unionByName(html)


def graph_stats(spark, sf):
    rows = graph.adjacency(_links(spark, sf), _pages(spark, sf))
    return rows.agg(F.count("*").alias("n"), F.count_if(F.size("links") == 0).alias("dangling"), F.sum(F.size("links")).alias("live"))


def pagerank_step1(spark, sf):
    return _rounded(graph.pagerank(_links(spark, sf), _pages(spark, sf), 1)[0])


def _rounded(ranks):
    return ranks.select("page", F.round(F.col("rank") * 1e6, 3).alias("rank_ppm"))


def pagerank_4iter(spark, sf):
    return _rounded(graph.pagerank(_links(spark, sf), _pages(spark, sf), 4)[0])


def pagerank_topk(spark, sf):
    return graph.ranked(_rounded(graph.pagerank(_links(spark, sf), _pages(spark, sf), 4)[0]).withColumnRenamed("rank_ppm", "rank"), 10).withColumnRenamed("rank", "rank_ppm")


def relax_once(spark, sf):
    return graph.relax(spark.createDataFrame([(0, 0)], "v long, d long"), _last(spark, sf))


def sssp(spark, sf):
    return graph.shortest_paths(_last(spark, sf), fx.vertices(spark, sf), 0, FAR)


def _dist(spark, sf):
    """Edges and a zero diagonal: (i, j, d)."""
    own = fx.vertices(spark, sf).select(F.col("v").alias("i"), F.col("v").alias("j"), F.lit(0).cast("long").alias("d"))
    rows = _last(spark, sf).select(F.col("src").alias("i"), F.col("dst").alias("j"), F.col("w").cast("long").alias("d"))
    return rows.unionByName(own).groupBy("i", "j").agg(F.min("d").alias("d"))


def minplus_once(spark, sf):
    d = _dist(spark, sf)
    return graph.minplus(d, d)


def apsp(spark, sf):
    n = fx.vertices(spark, sf).count()
    return graph.all_pairs(_last(spark, sf), n, max(1, min(512, -(-n // 2))))  # two blocks at least, so that all phases run


def sort_f32(spark, sf):
    return sorting.sort_positions(fx.floats(spark, sf), "x")


def sort_check(spark, sf):
    """Of the sorted values, every seventh of them lowered: that makes inversions."""
    return sorting.inversions(sort_f32(spark, sf).select("pos", F.when(F.col("pos") % 7 == 0, F.col("x") - 1000).otherwise(F.col("x")).alias("x")), "x")


def sort_check_clean(spark, sf):
    return sorting.inversions(sort_f32(spark, sf), "x")


def pagerank(spark, sf):
    """To convergence, with the errors of all rounds beside the ranks."""
    ranks, errors = graph.pagerank(_links(spark, sf), _pages(spark, sf))
    last = [F.lit(len(errors)).alias("rounds"), *[F.lit(round(e, 6)).alias(f"error_{k + 1}") for k, e in enumerate(errors[:4])]]
    return _rounded(ranks).select("page", "rank_ppm", *last)


def sobel_rgb(spark, sf):
    """Three channels: the image, its negative, and its half."""
    height = fx.table(spark, sf, "embeddings").count()
    pixels = fx.image(spark, sf).select("y", "x", F.col("v").alias("r"), (255 - F.col("v")).alias("g"), F.expr("v div 2").cast("int").alias("b"))
    return grid.sobel(pixels, WIDTH, height, ["r", "g", "b"])


def diff_count(spark, sf):
    x = sort_f32(spark, sf)
    return sorting.differences(x, x.select("pos", F.when(F.col("pos") % 7 == 0, F.col("x") + 1).otherwise(F.col("x")).alias("x")), "x")


def part_first_char(spark, sf):
    return fx.table(spark, sf, "part").groupBy(graph.part_first_char(F.col("p_name"), PARTS).alias("part")).agg(F.count("*").alias("n"))


def part_cyclic(spark, sf):
    v = fx.vertices(spark, sf)
    return v.select("v", graph.part_cyclic(F.col("v"), PARTS).cast("int").alias("part"))


def part_block(spark, sf):
    v = fx.vertices(spark, sf)
    return v.select("v", graph.part_block(F.col("v"), v.count(), PARTS).cast("int").alias("part"))


def edge_degree(spark, sf):
    deg = graph.outdegree(_last(spark, sf)).select(F.col("src").alias("s"), "outdeg")
    v = fx.vertices(spark, sf)
    return v.join(deg, v.v == deg.s, "left").select("v", F.coalesce("outdeg", F.lit(0)).alias("degree"))


def part_balanced(spark, sf):
    return graph.part_balanced(edge_degree(spark, sf), PARTS)


def mandelbrot(spark, sf):
    return grid.grid(spark, *GRID).select("y", "x", grid.escape_count(MAX_ITER)("x0", "y0").alias("n"))


def mandelbrot_palette(spark, sf):
    return mandelbrot(spark, sf).select("y", "x", *grid.palette(F.col("n"), MAX_ITER))


def sobel(spark, sf):
    height = fx.table(spark, sf, "embeddings").count()
    return grid.sobel(fx.image(spark, sf), WIDTH, height, ["v"])


def timing_variance(spark, sf):
    return fx.table(spark, sf, "events").groupBy("event_type").agg(F.round(F.var_pop("value") * F.count("value"), 4).alias("ssd"))


def adjacency(spark, sf):
    return graph.adjacency(_links(spark, sf), _pages(spark, sf)).select("page", F.array_join("links", ",").alias("links"))


def _file(spark, name: str) -> str:
    """In the cluster's shared folder, where that is a local path; else on the disk that one machine has."""
    folder = shared_folder(spark).removeprefix("file://")
    if "://" not in folder:
        os.makedirs(folder, exist_ok=True)
    return os.path.join(tempfile.mkdtemp(prefix="lodestream-", dir=None if "://" in folder else folder), name)


def f32_roundtrip(spark, sf):
    path = _file(spark, "x.f32")
    binary.sink_f32(sort_f32(spark, sf), path)
    return sorting.differences(sort_f32(spark, sf), binary.scan_f32(spark, path), "x")


def edges_roundtrip(spark, sf):
    path = _file(spark, "graph.bin")
    rows = _last(spark, sf).select("src", "dst", "w", (F.col("src") * 1_000_000 + F.col("dst")).alias("ord"))
    binary.sink_edges(rows, fx.vertices(spark, sf).count(), path)
    return binary.scan_edges(spark, path)


def _image_roundtrip(kind):
    def run(spark, sf):
        path = _file(spark, f"image.{kind}")
        binary.sink_image(mandelbrot_palette(spark, sf), path)
        return (binary.scan_bmp if kind == "bmp" else binary.scan_png)(spark, path)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "title_extract": title_extract,
        "link_extract": _links,
        "prune_dead_links": lambda s, d: graph.live_links(_links(s, d), _pages(s, d)),
        "dead_links": lambda s, d: graph.dead_links(_links(s, d), _pages(s, d)),
        "transpose_graph": lambda s, d: graph.live_links(_links(s, d), _pages(s, d)).select(F.col("dst").alias("src"), F.col("src").alias("dst")),
        "adjacency": adjacency,
        "graph_stats": graph_stats,
        "outdegree": lambda s, d: graph.outdegree(graph.live_links(_links(s, d), _pages(s, d))),
        "edge_degree": edge_degree,
        "pagerank_step1": pagerank_step1,
        "pagerank_4iter": pagerank_4iter,
        "pagerank_topk": pagerank_topk,
        "dedup_edges": _last,
        "relax_once": relax_once,
        "sssp": sssp,
        "minplus_once": minplus_once,
        "apsp": apsp,
        "sort_f32": sort_f32,
        "sort_check": sort_check,
        "sort_check_clean": sort_check_clean,
        "pagerank": pagerank,
        "sobel_rgb": sobel_rgb,
        "diff_count": diff_count,
        "part_first_char": part_first_char,
        "part_cyclic": part_cyclic,
        "part_block": part_block,
        "part_balanced": part_balanced,
        "mandelbrot": mandelbrot,
        "mandelbrot_palette": mandelbrot_palette,
        "sobel": sobel,
        "pi": lambda s, d: grid.integrate_pi(s, 100_000),
        "timing_variance": timing_variance,
        "f32_roundtrip": f32_roundtrip,
        "edges_roundtrip": edges_roundtrip,
        "bmp_roundtrip": _image_roundtrip("bmp"),
        "png_roundtrip": _image_roundtrip("png"),
    }


def _pagerank_sql(rounds: int) -> str:
    first = f"""WITH {fx.SQL_WIKI},
n AS (SELECT count(*) AS n FROM wiki),
r0 AS MATERIALIZED (SELECT page, 1.0::DOUBLE / n AS rank FROM wiki, n)"""
    for k in range(rounds):
        first += f""",
i{k} AS MATERIALIZED (SELECT dst AS page, sum(rank / outdeg) AS s FROM live JOIN outdeg USING (src) JOIN r{k} ON r{k}.page = src GROUP BY dst),
m{k} AS MATERIALIZED (SELECT coalesce(sum(rank), 0.0) AS m FROM r{k} WHERE page NOT IN (SELECT src FROM outdeg)),
r{k + 1} AS MATERIALIZED (SELECT page, (0.15::DOUBLE + 0.85::DOUBLE * m) / n + 0.85::DOUBLE * coalesce(s, 0.0) AS rank FROM wiki LEFT JOIN i{k} USING (page), n, m{k})"""
    return first + f"\nSELECT page, round(rank * 1e6, 3) AS rank_ppm FROM r{rounds}"


def _unescape_sql(column: str) -> str:
    for entity, character in text.ENTITIES:
        column = f"replace({column}, '{entity}', '{character.replace(chr(39), chr(39) * 2)}')"
    return column


def _dist_sql() -> str:
    return f"""WITH {fx.SQL_EDGES},
d0 AS MATERIALIZED (SELECT i, j, min(d) AS d FROM (SELECT src AS i, dst AS j, CAST(w AS BIGINT) AS d FROM edges UNION ALL SELECT s_suppkey, s_suppkey, 0 FROM supplier) GROUP BY i, j)"""


def _apsp_sql(rounds: int = 7) -> str:
    sql = _dist_sql()
    for k in range(rounds):
        sql += f",\nd{k + 1} AS MATERIALIZED (SELECT a.i, b.j, min(a.d + b.d) AS d FROM d{k} a JOIN d{k} b ON a.j = b.i GROUP BY a.i, b.j)"
    return sql


_MANDELBROT = f"""WITH RECURSIVE cell AS (SELECT CAST(y AS INT) AS y, CAST(x AS INT) AS x, x * (4.0::DOUBLE / 64) - 2.0 AS x0, y * (4.0::DOUBLE / 48) - 2.0 AS y0
FROM (SELECT unnest(range(0, 48)) AS y) CROSS JOIN (SELECT unnest(range(0, 64)) AS x)),
z AS (SELECT y, x, x0, y0, 0 AS n, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b FROM cell
UNION ALL SELECT y, x, x0, y0, n + 1, a * a - b * b + x0, 2 * a * b + y0 FROM z WHERE n < {MAX_ITER} AND (n = 0 OR a * a + b * b < 4.0)),
m AS (SELECT y, x, CAST(max(n) AS INT) AS n FROM z GROUP BY y, x)"""
_SORTED = "s AS (SELECT row_number() OVER (ORDER BY x) - 1 AS pos, x FROM (SELECT CAST(l_extendedprice AS FLOAT) AS x FROM lineitem))"


def _sobel_sql(values=("v",), names=("v",)) -> str:
    rows = ", ".join(f"({dy}, {dx}, {a}, {b})" for dy, dx, a, b in grid.STENCIL)
    sums = ", ".join(f"sum({v.replace('v', 'p.v')} * a) AS a_{n}, sum({v.replace('v', 'p.v')} * b) AS b_{n}" for v, n in zip(values, names))
    out = ", ".join(f"CAST(floor(least(255.0, sqrt(CAST(a_{n} * a_{n} + b_{n} * b_{n} AS DOUBLE)) / 8.0)) AS INT) AS {n}" for n in names)
    return f"""WITH {fx.SQL_IMAGE}, m(dy, dx, a, b) AS (VALUES {rows}),
t AS (SELECT c.y, c.x, {sums} FROM image c, m JOIN image p ON p.y = c.y + dy AND p.x = c.x + dx GROUP BY c.y, c.x)
SELECT y, x, {out} FROM t"""


def _converged_sql() -> str:
    """The ranks after four rounds, that the tables converge in, with each round's error."""
    errors = ", ".join(f"(SELECT round(sum(abs(a.rank - b.rank)), 6) FROM r{k + 1} a JOIN r{k} b USING (page)) AS error_{k + 1}" for k in range(4))
    return _pagerank_sql(4).rpartition("\nSELECT")[0] + f"\nSELECT page, round(rank * 1e6, 3) AS rank_ppm, 4 AS rounds, {errors} FROM r4"


def oracle_sql() -> dict[str, str]:
    wiki, edges = f"WITH {fx.SQL_WIKI}\n", f"WITH {fx.SQL_EDGES}\n"
    degree = f"deg AS (SELECT s_suppkey AS v, CAST(count(src) AS BIGINT) AS degree FROM supplier LEFT JOIN edges ON src = s_suppkey GROUP BY s_suppkey)"
    shade = "CAST(n % 16 * 16 AS INT)"
    palette_sql = (
        _MANDELBROT
        + f" SELECT y, x, CASE WHEN n = {MAX_ITER} THEN 0 WHEN n & 16 <> 0 THEN 240 ELSE {shade} END AS r, CASE WHEN n = {MAX_ITER} THEN 0 WHEN n & 16 <> 0 THEN {shade} ELSE 0 END AS g, CASE WHEN n = {MAX_ITER} THEN 0 WHEN n & 16 <> 0 THEN {shade} ELSE 0 END AS b FROM m"
    )
    return {
        "title_extract": wiki + "SELECT page FROM wiki UNION ALL SELECT regexp_extract(h, '<title>(.+?)</title>', 1) FROM (SELECT "
        + _unescape_sql("html")
        + " AS h FROM pages) WHERE regexp_matches(h, '<title>.+?</title>')",
        "link_extract": wiki + "SELECT src, dst FROM links",
        "prune_dead_links": wiki + "SELECT src, dst FROM live",
        "dead_links": wiki + "SELECT src, dst FROM links WHERE dst NOT IN (SELECT page FROM wiki)",
        "transpose_graph": wiki + "SELECT dst AS src, src AS dst FROM live",
        "adjacency": wiki + "SELECT page, coalesce(string_agg(dst, ',' ORDER BY dst), '') AS links FROM wiki LEFT JOIN live ON src = page GROUP BY page",
        "graph_stats": wiki + "SELECT (SELECT count(*) FROM wiki) AS n, (SELECT count(*) FROM wiki WHERE page NOT IN (SELECT src FROM live)) AS dangling, (SELECT count(*) FROM live) AS live",
        "outdegree": wiki + "SELECT src, outdeg FROM outdeg",
        "edge_degree": edges[:-1] + f", {degree} SELECT v, degree FROM deg",
        "pagerank_step1": _pagerank_sql(1),
        "pagerank_4iter": _pagerank_sql(4),
        "pagerank_topk": _pagerank_sql(4) + " ORDER BY rank_ppm DESC, page LIMIT 10",
        "dedup_edges": edges + "SELECT src, dst, w FROM edges",
        "relax_once": edges + "SELECT dst AS v, CAST(min(w) AS BIGINT) AS d FROM edges WHERE src = 0 GROUP BY dst",
        "sssp": _apsp_sql() + f" SELECT s_suppkey AS v, coalesce(d, {FAR}) AS d FROM supplier LEFT JOIN d7 ON j = s_suppkey AND i = 0",
        "minplus_once": _apsp_sql(1) + " SELECT i, j, d FROM d1",
        "apsp": _apsp_sql() + " SELECT i, j, d FROM d7",
        "sort_f32": f"WITH {_SORTED} SELECT pos, x FROM s",
        "sort_check": f"WITH {_SORTED}, t AS (SELECT pos, CASE WHEN pos % 7 = 0 THEN x - 1000 ELSE x END AS x FROM s), u AS (SELECT x, lead(x) OVER (ORDER BY pos) AS y FROM t) SELECT count(*) FILTER (x > y) AS inversions, count(*) AS n, count(*) FILTER (x > y) = 0 AS is_sorted FROM u",
        "sort_check_clean": f"WITH {_SORTED}, u AS (SELECT x, lead(x) OVER (ORDER BY pos) AS y FROM s) SELECT count(*) FILTER (x > y) AS inversions, count(*) AS n, count(*) FILTER (x > y) = 0 AS is_sorted FROM u",
        "pagerank": _converged_sql(),
        "sobel_rgb": _sobel_sql(("v", "(255 - v)", "(v // 2)"), ("r", "g", "b")),
        "diff_count": f"WITH {_SORTED} SELECT count(*) FILTER (pos % 7 = 0) AS differ, count(*) AS n FROM s",
        "part_first_char": f"SELECT CAST(ascii(p_name) % {PARTS} AS INT) AS part, count(*) AS n FROM part GROUP BY 1",
        "part_cyclic": f"SELECT s_suppkey AS v, CAST(s_suppkey % {PARTS} AS INT) AS part FROM supplier",
        "part_block": f"SELECT s_suppkey AS v, CAST(least(s_suppkey // greatest(1, (SELECT count(*) FROM supplier) // {PARTS}), {PARTS - 1}) AS INT) AS part FROM supplier",
        "part_balanced": edges[:-1]
        + f", {degree} SELECT v, CAST(least(floor((sum(degree) OVER (ORDER BY v) - degree) * {PARTS}::DOUBLE / greatest((SELECT sum(degree) FROM deg), 1)), {PARTS - 1}) AS INT) AS part FROM deg",
        "mandelbrot": _MANDELBROT + " SELECT y, x, n FROM m",
        "mandelbrot_palette": palette_sql,
        "sobel": _sobel_sql(),
        "pi": "SELECT round(sum(sqrt(1.0::DOUBLE - (i / 100000.0::DOUBLE) * (i / 100000.0::DOUBLE)) / 100000.0::DOUBLE) * 4.0, 6) AS pi FROM (SELECT unnest(range(0, 100000))::DOUBLE AS i)",
        "timing_variance": "SELECT event_type, round(var_pop(value) * count(value), 4) AS ssd FROM events GROUP BY event_type",
        "edges_roundtrip": edges + "SELECT CAST(src AS INT) AS src, CAST(dst AS INT) AS dst, w, row_number() OVER (ORDER BY src, dst) - 1 AS ord FROM edges",
        "bmp_roundtrip": palette_sql,
        "png_roundtrip": palette_sql,
        "f32_roundtrip": "SELECT CAST(0 AS BIGINT) AS differ, count(*) AS n FROM lineitem",
    }
