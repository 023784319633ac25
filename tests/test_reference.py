import glob
import os
import random

import duckdb
import numpy as np
import pytest

from lodestream.functions import grid, text
from lodestream.operators import graph, sorting
from lodestream.plans import registry
from lodestream.plans.fixpoint import cut
from lodestream.sources import binary

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(spark, db, name):
    got, want = registry.queries()[name](spark, SF).toPandas(), db.execute(registry.oracle_sql()[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    got, want = (x[columns].sort_values(columns).reset_index(drop=True) for x in (got, want))
    assert len(got) == len(want)
    assert all((got[c].to_numpy() == want[c].to_numpy()).all() for c in columns)


def test_links(spark):
    lines = [
        "no title [[a]]",
        "&lt;title&gt;T&lt;/title&gt; &lt;title&gt;U&lt;/title&gt; [[a|x]] [[b#s]] [[é]] [[#z]] [[|q]] [[A]] &amp;quot; &amp;lt;",
    ]
    frame = spark.createDataFrame([(x,) for x in lines], "value string")
    assert [r.page for r in text.titles(frame).collect()] == ["T"]
    assert sorted(r.dst for r in text.links(frame).collect()) == sorted(["A", "B", "é", "#z", "|q", "A"])
    assert '" &lt;' in text.titles(frame).first().line


def test_shortest_paths_against_numpy(spark):
    rng = random.Random(4)
    n, rows = 23, [(rng.randrange(20), rng.randrange(20), rng.randint(0, 30), k) for k in range(70)]
    edges = graph.last_edges(spark.createDataFrame(rows, "src int, dst int, w int, ord long"))
    far = np.full((n, n), 10**9)
    for s, d, w, _ in rows:
        far[s, d] = w
    np.fill_diagonal(far, 0)
    for k in range(n):
        far = np.minimum(far, far[:, k : k + 1] + far[k])
    vertices = spark.createDataFrame([(v,) for v in range(n)], "v int")
    assert {r.v: r.d for r in graph.shortest_paths(edges, vertices, 0, 10**9).collect()} == dict(enumerate(np.minimum(far[0], 10**9).tolist()))
    want = {(i, j): int(far[i, j]) for i in range(n) for j in range(n) if far[i, j] < 10**9}
    assert {(r.i, r.j): r.d for r in graph.all_pairs(edges, n, size=8).collect()} == want


def test_all_pairs_makes_no_tiles_that_nothing_reaches(spark, monkeypatch):
    """Five rings of four vertices, two tiles wide each: four tiles a ring, not the matrix."""
    tables, cut = [], graph.cut

    def counted(df):
        tables.append((out := cut(df), out.count()))
        return out

    monkeypatch.setattr(graph, "cut", counted)
    edges = spark.createDataFrame([(4 * r + k, 4 * r + (k + 1) % 4, 1 + k) for r in range(5) for k in range(4)], "src long, dst long, w long")
    got = {(r.i, r.j): r.d for r in graph.all_pairs(edges, 20, size=2).collect()}
    assert len(got) == 5 * 16 and got[4, 7] == 6 and got[7, 4] == 4 and got[19, 18] == 4 + 1 + 2
    assert max(n for _, n in tables) == 5 * 4


def test_minplus_meets_by_tiles_whatever_the_keys(spark, monkeypatch):
    rng = random.Random(8)
    cells = [[(rng.randrange(40) * 1000 - 7, rng.randrange(40) * 1000 - 7, rng.randrange(-20, 50)) for _ in range(300)] for _ in range(2)]
    want: dict = {}
    for i, k, d in cells[0]:
        for l, j, e in cells[1]:
            if k == l:
                want[i, j] = min(want.get((i, j), 1 << 40), d + e)
    a, b = (spark.createDataFrame(c, "i long, j long, d long") for c in cells)
    done = graph.minplus(a, b, 16)
    assert {(r.i, r.j): r.d for r in done.collect()} == want and done.count() == len(want)
    dense = [spark.range(200 * 200).selectExpr(f"id % 200 AS {x}", f"id div 200 AS {y}", "id % 17 AS d") for x, y in (("i", "j"), ("j", "i"))]
    met = []
    monkeypatch.setattr(graph, "cut", lambda df: met.append(cut(df)) or met[-1])
    assert graph.minplus(*dense).count() == 200 * 200 and met[0].count() == 1  # one tile, no row for each path
    assert graph.minplus(a.limit(0), b).count() == 0


def test_pagerank_sums_to_one_and_converges(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "c"), ("c", "x")], "src string, dst string")
    pages = spark.createDataFrame([("a",), ("b",), ("c",)], "page string")
    ranks, errors = graph.pagerank(links, pages)
    assert abs(sum(r.rank for r in ranks.collect()) - 1) < 1e-9
    assert errors[-1] < graph.MAX_ERROR


def test_sort(spark):
    rows = spark.createDataFrame([(float(x),) for x in [3, 1, 2, 1, float("inf"), float("-inf"), 0]], "x float")
    out = sorting.sort_positions(rows, "x", 3)
    assert [r.x for r in out.orderBy("pos").collect()] == sorted([3, 1, 2, 1, float("inf"), float("-inf"), 0])
    assert sorting.sort_positions(rows.limit(0), "x").count() == 0


def test_escape_count_at_the_edge(spark):
    point = spark.createDataFrame([(-2.0, 0.0), (3.0, 0.0), (0.0, 0.0)], "x0 double, y0 double")
    assert [r[0] for r in point.select(grid.escape_count(50)("x0", "y0")).collect()] == [1, 1, 50]
    assert [r[0] for r in point.select(grid.escape_count(50, strict=True)("x0", "y0")).collect()] == [50, 1, 50]


@pytest.mark.parametrize("shape", [(1, 1), (3, 5), (7, 4)])
def test_images(shape):
    image = np.random.default_rng(1).integers(0, 256, (*shape, 3), dtype=np.uint8)
    assert (binary.decode_bmp(binary.encode_bmp(image)) == image).all()
    assert (binary.decode_png(binary.encode_png(image)) == image).all()


def test_files(spark, tmp_path):
    rows = spark.createDataFrame([(0, 1, 5, 0), (1, 0, 7, 1)], "src int, dst int, w int, ord long")
    binary.sink_edges(rows, 3, str(tmp_path / "g"))
    assert binary.scan_edges(spark, str(tmp_path / "g")).count() == 2
    assert binary.edge_header(spark, str(tmp_path / "g")) == (3, 2)
    (tmp_path / "p").write_text("0\n0\n1\n")
    assert [r.part for r in binary.scan_partition_map(spark, str(tmp_path / "p")).orderBy("v").collect()] == [0, 0, 1]


def test_files_are_written_and_read_in_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(binary, "PART", 100)
    monkeypatch.setattr(binary, "FRAME", 64)
    monkeypatch.setattr(type(spark.range(1)), "toPandas", None)  # the driver never holds all rows
    x = spark.range(1000).selectExpr("999 - id AS pos", "cast(id * 0.5 AS float) AS x").repartition(3, "x")
    binary.sink_f32(x, str(tmp_path / "x"))
    assert np.fromfile(tmp_path / "x", "<f4").tolist() == [0.5 * (999 - k) for k in range(1000)]
    assert binary.scan_f32(spark, str(tmp_path / "x")).join(x.withColumnRenamed("x", "y"), "pos").filter("x = y").count() == 1000
    edges = spark.range(300).selectExpr("cast(id AS int) AS src", "cast(id + 1 AS int) AS dst", "7 AS w", "-id AS ord").repartition(3, "src")
    binary.sink_edges(edges, 301, str(tmp_path / "g"))
    assert binary.edge_header(spark, str(tmp_path / "g")) == (301, 300)
    assert sorted(tuple(r) for r in binary.scan_edges(spark, str(tmp_path / "g")).collect()) == sorted((299 - k, 300 - k, 7, k) for k in range(300))
    binary.sink_f32(x.limit(0), str(tmp_path / "e"))
    assert binary.scan_f32(spark, str(tmp_path / "e")).count() == 0


def test_ranges_of_a_file_are_read_by_different_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(binary, "PART", 100)
    monkeypatch.setattr(binary, "FRAME", 64)
    edges = spark.range(300).selectExpr("cast(id AS int) AS src", "cast(id + 1 AS int) AS dst", "7 AS w", "id AS ord")
    path = str(tmp_path / "g")
    binary.sink_edges(edges, 301, path)
    want = [(k, k + 1, 7, k) for k in range(300)]
    for name in (path, f"file://{path}", f"file:{path}"):
        rows = binary.scan_edges(spark, name)
        assert rows.rdd.glom().map(len).collect() == [100, 100, 100]
        assert sorted(tuple(r) for r in rows.collect()) == want
    # what isn't one file of a disk goes through Spark's source, whole
    assert sorted(tuple(r) for r in binary.scan_edges(spark, f"{path}*").collect()) == want
    np.arange(250, dtype="<f4").tofile(tmp_path / "x")
    for name in ("x", "x*"):
        path = str(tmp_path / name)
        assert sorted((r.pos, r.x) for r in binary.scan_f32(spark, path).collect()) == [(k, float(k)) for k in range(250)]
        assert binary.scan_f32(spark, path, 120).count() == 120
        with pytest.raises(Exception, match="hold no 251 floats"):
            binary.scan_f32(spark, path, 251).count()


def test_text_and_matrix_files(spark, tmp_path):
    binary.sink_partition_map(spark.createDataFrame([(2, 1), (0, 5), (1, 7)], "v int, part int"), str(tmp_path / "m"))
    assert [r.value for r in binary.scan_lines(spark, str(tmp_path / "m")).collect()] == ["5", "7", "1"]
    binary.sink_int_matrix(spark.createDataFrame([(0, 1, 4), (1, 0, 9)], "i long, j long, d long"), 2, str(tmp_path / "d"), 99)
    assert np.fromfile(tmp_path / "d", "<i4").tolist() == [99, 4, 9, 99]
    binary.sink_int_vector(spark.createDataFrame([(1, None), (0, 3)], "v int, d long"), str(tmp_path / "v"), ["v"], "d", 7)
    assert np.fromfile(tmp_path / "v", "<i4").tolist() == [3, 7]
    (tmp_path / "kv").write_text("a\tb\tc\nd\n")
    assert sorted(binary.scan_kv_text(spark, str(tmp_path / "kv")).collect()) == [("a", "b\tc"), ("d", "")]
    x = binary.random_f32(spark, 50, seed=3)
    assert x.collect() == binary.random_f32(spark, 50, seed=3).collect() and x.filter("x < 0 or x > 10000000").count() == 0


def test_inversions_of_unsorted_rows(spark):
    values = [3.0, 1.0, None, 2.0, float("nan"), 5.0, 5.0, 4.0]
    rows = spark.createDataFrame(list(enumerate(values)), "pos long, x double").repartition(3, "x")
    assert tuple(sorting.inversions(rows, "x").first()) == (3, 8, False)
    assert tuple(sorting.inversions(rows.limit(0), "x").first()) == (0, 0, True)


def test_entry(spark):
    import __spark_entry__ as engine

    assert engine.entry(spark).limit(3).count() == 3
    assert set(registry.queries()) <= set(engine.queries())
