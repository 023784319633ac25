"""Inputs derived from the tables: floats, a weighted digraph, wiki text, an image; and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def floats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_extendedprice").cast("float").alias("x"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, w, ord): from each line's supplier to the next line's in its order."""
    by_order = Window.partitionBy("l_orderkey").orderBy(*ORDER)
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("src"),
        F.lead("l_suppkey").over(by_order).alias("dst"),
        F.col("l_quantity").cast("int").alias("w"),
        F.struct("l_orderkey", F.row_number().over(by_order).alias("rn")).alias("ord"),
    )
    return rows.filter("dst is not null")


def vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("v"))


def wiki_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """value: a line for each part whose key isn't a multiple of 10, linking to the next parts of its orders."""
    by_order = Window.partitionBy("l_orderkey").orderBy(*ORDER)
    following = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p"), F.lead("l_partkey").over(by_order).alias("n")).filter("n is not null")
    n = F.col("n").cast("string")
    link = F.when(F.col("n") % 3 == 0, F.concat(F.lit("[[p"), n, F.lit("|label]]"))).when(F.col("n") % 3 == 1, F.concat(F.lit("[[P"), n, F.lit("#top]]")))
    link = link.otherwise(F.concat(F.lit("[[P"), n, F.lit("]]")))
    grouped = following.groupBy("p").agg(F.array_join(F.sort_array(F.collect_list(link)), " &amp; ").alias("links"))
    pages = table(spark, sf_dir, "part").filter("p_partkey % 10 <> 0").select("p_partkey", "p_size")
    out = pages.join(grouped, pages.p_partkey == grouped.p, "left")
    body = F.when(F.col("p_size") <= 40, F.coalesce("links", F.lit(""))).otherwise("")
    return out.select(F.concat(F.lit("&lt;title&gt;P"), F.col("p_partkey").cast("string"), F.lit("&lt;/title&gt; "), body).alias("value"))


def image(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(y, x, v): the embeddings' components, scaled to 0 to 255."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("int").alias("y"), F.posexplode("embedding").alias("x", "e"))
    scaled = F.floor(F.least(F.lit(255.0), F.greatest(F.lit(0.0), (F.col("e").cast("double") + 1.0) * 127.5))).cast("int")
    return rows.select("y", "x", scaled.alias("v"))


SQL_ORDER = f"PARTITION BY l_orderkey ORDER BY {', '.join(ORDER)}"
SQL_EDGES = f"""
raw AS (SELECT l_suppkey AS src, lead(l_suppkey) OVER (w) AS dst, CAST(l_quantity AS INT) AS w, l_orderkey AS o, row_number() OVER (w) AS rn
        FROM lineitem WINDOW w AS ({SQL_ORDER})),
edges AS (SELECT src, dst, w FROM (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY o DESC, rn DESC) AS k FROM raw WHERE dst IS NOT NULL) WHERE k = 1)"""
SQL_WIKI = f"""
following AS (SELECT l_partkey AS p, lead(l_partkey) OVER ({SQL_ORDER}) AS n FROM lineitem),
wiki AS (SELECT p_partkey AS k, 'P' || p_partkey AS page, p_size FROM part WHERE p_partkey % 10 <> 0),
links AS (SELECT wiki.page AS src, 'P' || n AS dst FROM following JOIN wiki ON p = k WHERE n IS NOT NULL AND p_size <= 40),
live AS (SELECT src, dst FROM links WHERE dst IN (SELECT page FROM wiki)),
outdeg AS (SELECT src, count(*) AS outdeg FROM live GROUP BY src)"""
SQL_IMAGE = """
image AS (SELECT CAST(vec_id AS INT) AS y, CAST(x - 1 AS INT) AS x, CAST(floor(least(255.0, greatest(0.0, (CAST(embedding[x] AS DOUBLE) + 1.0) * 127.5))) AS INT) AS v
          FROM embeddings, (SELECT unnest(range(1, 65)) AS x))"""
