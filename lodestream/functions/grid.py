"""Pixel grids: escape counts, palette, stencil, numerical integration."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def slices(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).withColumnRenamed("id", "i")


def circle_area_term(i: Column, n: int) -> Column:
    x = i.cast("double") / F.lit(float(n))
    return F.sqrt(1.0 - x * x) / F.lit(float(n))


def integrate_pi(spark: SparkSession, n: int) -> DataFrame:
    return slices(spark, n).agg(F.round(F.sum(circle_area_term(F.col("i"), n)) * 4.0, 6).alias("pi"))


def grid(spark: SparkSession, width: int, height: int, left=-2.0, right=2.0, lower=-2.0, upper=2.0) -> DataFrame:
    """(y, x, x0, y0) of all pixels; rows are dealt out by the scheduler."""
    cells = spark.range(width * height).select(F.expr(f"cast(id div {width} as int)").alias("y"), (F.col("id") % width).cast("int").alias("x"))
    return cells.select(
        "y",
        "x",
        (F.col("x") * F.lit((right - left) / width) + F.lit(left)).alias("x0"),
        (F.col("y") * F.lit((upper - lower) / height) + F.lit(lower)).alias("y0"),
    )


def escape_count(max_iter: int, strict: bool = False):
    """Iterations of z = z * z + c until |z|^2 >= 4 (> 4 if strict), at least 1 and max_iter at most; over Arrow batches, live points only."""

    @F.pandas_udf("int")
    def count(x0: pd.Series, y0: pd.Series) -> pd.Series:
        cx, cy = x0.to_numpy(float), y0.to_numpy(float)
        out, live = np.zeros(len(cx), np.int32), np.arange(len(cx))
        x, y = np.zeros(len(cx)), np.zeros(len(cx))
        for _ in range(max_iter):
            x, y = x * x - y * y + cx, 2 * x * y + cy
            out[live] += 1
            size = x * x + y * y
            stay = size <= 4.0 if strict else size < 4.0
            if not stay.all():
                live, x, y, cx, cy = live[stay], x[stay], y[stay], cx[stay], cy[stay]
            if not len(live):
                break
        return pd.Series(out)

    return count


def palette(n: Column, max_iter: int) -> list[Column]:
    """r, g, b: black inside, else shades by the count's low bits."""
    shade = (n % 16) * 16
    bright = n.bitwiseAND(F.lit(16)) != 0
    inside = n == max_iter
    r = F.when(inside, 0).when(bright, 240).otherwise(shade)
    rest = F.when(inside, 0).when(bright, shade).otherwise(0)
    return [r.cast("int").alias("r"), rest.cast("int").alias("g"), rest.cast("int").alias("b")]


# The 5 x 5 masks are the outer products of these two, the scale divides the result.
DERIVATIVE, SMOOTH, SCALE = [-1, -2, 0, 2, 1], [1, 4, 6, 4, 1], 8.0
#: (dy, dx, weight of the first mask, of the second); the first mask's derivative runs along x.
STENCIL = [(v - 2, u - 2, DERIVATIVE[u] * SMOOTH[v], SMOOTH[u] * DERIVATIVE[v]) for v in range(5) for u in range(5) if u != 2 or v != 2]


def clamp_u8(value: Column) -> Column:
    return F.floor(F.least(F.lit(255.0), value)).cast("int")


def sobel(pixels: DataFrame, width: int, height: int, channels: list[str]) -> DataFrame:
    """Edge filter over (y, x, channels...); pixels outside are 0.

    Each pixel adds its share to the pixels around it, and the shares are
    summed: one shuffle with map-side sums, and no join.
    """
    around = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("dy", "dx", "a", "b"), row, strict=True)]) for row in STENCIL])
    spread = pixels.select("y", "x", *channels, F.explode(around).alias("s"))
    # a pixel at offset (dy, dx) of its neighbour: the neighbour is at (y - dy, x - dx)
    spread = spread.select((F.col("y") - F.col("s.dy")).alias("y"), (F.col("x") - F.col("s.dx")).alias("x"), "s", *channels)
    spread = spread.filter((F.col("y") >= 0) & (F.col("y") < height) & (F.col("x") >= 0) & (F.col("x") < width))
    sums = spread.groupBy("y", "x").agg(*[F.sum(F.col(c) * F.col(f"s.{m}")).alias(f"{c}_{m}") for c in channels for m in "ab"])
    value = lambda c: F.sqrt((F.col(f"{c}_a") * F.col(f"{c}_a") + F.col(f"{c}_b") * F.col(f"{c}_b")).cast("double")) / SCALE
    return sums.select("y", "x", *[clamp_u8(value(c)).alias(c) for c in channels])
