"""Binary formats: float32 vectors, edge lists, BMP and PNG images; their readers and writers.

Readers go through Spark's binaryFile source, so any store that Spark reads
will do; of vectors and edge lists on a local or shared disk each task reads a
range.  Vectors, matrices and edge lists are encoded on the executors, and the
driver writes their bytes part by part; images are encoded on the driver.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.fixpoint import cut


#: Rows in a frame that a reader makes at once, and in a part that the driver holds of a file to write.
FRAME, PART = 1 << 18, 1 << 20


def _read(spark: SparkSession, path: str, decode, schema: str) -> DataFrame:
    """The frames that decode makes of each file's bytes."""

    def run(batches):
        for frame in batches:
            for raw in frame["content"]:
                yield from decode(memoryview(raw))

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, schema)


def _on_disk(spark: SparkSession, path: str) -> str | None:
    """The path as Python opens it, if Spark too takes it for one file of a disk."""
    scheme = path.partition(":/")[0] if ":/" in path else spark._jsc.hadoopConfiguration().get("fs.defaultFS", "file:").partition(":")[0]
    place = path.removeprefix("file://").removeprefix("file:")
    return place if scheme == "file" and os.path.isfile(place) else None


def _read_items(spark: SparkSession, path: str, width: int, head: int, count: Callable[[bytes, int], int], frame: Callable[[int, bytes], pd.DataFrame], schema: str) -> DataFrame:
    """The frames of a file's items of so many bytes behind a head; count tells their number by the head and the file's size, and refuses short files."""
    place = _on_disk(spark, path)
    if place is None:

        def decode(raw: bytes) -> Iterator[pd.DataFrame]:
            n = count(bytes(raw[:head]), len(raw))
            for at in range(0, n, FRAME):
                yield frame(at, raw[head + at * width : head + min(at + FRAME, n) * width])

        return _read(spark, path, decode, schema)
    size = os.path.getsize(place)
    starts = range(0, max(1, (size - head) // width), PART)  # one at least, that refuses a short file

    def run(batches):
        for batch in batches:
            for start in batch["id"].tolist():
                with open(place, "rb") as file:
                    end = min(start + PART, count(file.read(head), size))
                    for at in range(start, end, FRAME):
                        file.seek(head + at * width)
                        yield frame(at, file.read((min(at + FRAME, end) - at) * width))

    return spark.range(0, starts.stop, PART, len(starts)).mapInPandas(run, schema)


def _write(rows: DataFrame, order: list[str], values: list[str], kind: str, path: str, head: Callable[[int], bytes] = lambda n: b"") -> None:
    """One file of the values by order, behind a head made of their rows' number.

    Executors sort and encode; the driver fetches one partition of bytes after
    the other, and holds no more than that.
    """
    # written first, or the ranges' bounds and each partition would make the rows anew
    rows = cut(rows.select(*order, *values))
    n = rows.count()

    def encode(batches):
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False).astype(kind) for c in batch.columns]
            yield pa.RecordBatch.from_arrays([pa.array([np.stack(columns, axis=1).tobytes()], pa.binary())], names=["raw"])

    parts = rows.repartitionByRange(max(1, -(-n // PART)), *order).sortWithinPartitions(*order).select(*values)
    with open(path, "wb") as file:
        file.write(head(n))
        for row in parts.mapInArrow(encode, "raw binary").toLocalIterator():
            file.write(row["raw"])


def scan_f32(spark: SparkSession, path: str, n: int | None = None) -> DataFrame:
    """(pos, x); a file shorter than n is refused."""

    def count(_: bytes, size: int) -> int:
        if n is not None and size < 4 * n:
            raise ValueError(f"{size} bytes hold no {n} floats")
        return size // 4 if n is None else n

    def frame(at: int, raw: bytes) -> pd.DataFrame:
        x = np.frombuffer(raw, "<f4")
        return pd.DataFrame({"pos": np.arange(at, at + len(x)), "x": x})

    return _read_items(spark, path, 4, 0, count, frame, "pos long, x float")


def sink_f32(rows: DataFrame, path: str, value: str = "x") -> None:
    _write(rows, ["pos"], [value], "<f4", path)


def scan_edges(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst, w, ord) after a header of V and E."""

    def count(head: bytes, size: int) -> int:
        e = struct.unpack("<ii", head)[1]
        if size < 8 + 12 * e:
            raise ValueError(f"{size} bytes hold no {e} edges")
        return e

    def frame(at: int, raw: bytes) -> pd.DataFrame:
        rows = np.frombuffer(raw, "<i4").reshape(-1, 3)
        return pd.DataFrame({"src": rows[:, 0], "dst": rows[:, 1], "w": rows[:, 2], "ord": np.arange(at, at + len(rows))})

    return _read_items(spark, path, 12, 8, count, frame, "src int, dst int, w int, ord long")


def edge_header(spark: SparkSession, path: str) -> tuple[int, int]:
    return struct.unpack("<ii", bytes(spark.read.format("binaryFile").load(path).select(F.substring("content", 1, 8)).first()[0]))


def sink_edges(edges: DataFrame, vertices: int, path: str) -> None:
    _write(edges, ["ord"], ["src", "dst", "w"], "<i4", path, lambda n: struct.pack("<ii", vertices, n))


def sink_int_vector(rows: DataFrame, path: str, order: list[str], value: str, unreachable: int) -> None:
    """Values by the order's columns as int32; null as the sentinel."""
    _write(rows.select(*order, F.coalesce(value, F.lit(unreachable)).alias(value)), order, [value], "<i4", path)


def scan_partition_map(spark: SparkSession, path: str) -> DataFrame:
    """(v, part): line i holds the owner of vertex i."""

    def decode(raw: bytes) -> Iterator[pd.DataFrame]:
        parts = [int(x) for x in bytes(raw).split()]
        yield pd.DataFrame({"v": np.arange(len(parts)), "part": parts})

    return _read(spark, path, decode, "v int, part int")


def _pixels(image: np.ndarray) -> pd.DataFrame:
    y, x = np.indices(image.shape[:2])
    r, g, b = (image[:, :, k].ravel().astype(np.int32) for k in range(3))
    return pd.DataFrame({"y": y.ravel(), "x": x.ravel(), "r": r, "g": g, "b": b})


PIXELS = "y int, x int, r int, g int, b int"


def image_array(pixels: DataFrame) -> np.ndarray:
    frame = pixels.select("y", "x", "r", "g", "b").toPandas()
    out = np.zeros((int(frame["y"].max()) + 1, int(frame["x"].max()) + 1, 3), np.uint8)
    out[frame["y"], frame["x"]] = frame[["r", "g", "b"]].to_numpy()
    return out


def decode_bmp(raw: bytes) -> np.ndarray:
    """24-bit, rows from the bottom, each padded to 4 bytes."""
    start, width, height = struct.unpack_from("<I", raw, 10)[0], *struct.unpack_from("<ii", raw, 18)
    line = -(-width * 3 // 4) * 4
    rows = np.frombuffer(raw, np.uint8, line * abs(height), start).reshape(abs(height), line)[:, : width * 3].reshape(abs(height), width, 3)
    return rows[:: -1 if height > 0 else 1, :, ::-1]


def encode_bmp(image: np.ndarray) -> bytes:
    height, width = image.shape[:2]
    line = -(-width * 3 // 4) * 4
    body = np.zeros((height, line), np.uint8)
    body[:, : width * 3] = image[::-1, :, ::-1].reshape(height, -1)
    head = struct.pack("<2sIHHI", b"BM", 54 + body.size, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 24, 0, body.size, 2835, 2835, 0, 0)
    return head + body.tobytes()


def encode_png(image: np.ndarray) -> bytes:
    height, width = image.shape[:2]

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    rows = np.concatenate([np.zeros((height, 1), np.uint8), image.reshape(height, -1)], axis=1)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


def decode_png(raw: bytes) -> np.ndarray:
    """8-bit RGB (or RGBA, whose alpha is left out), not interlaced, all filters."""
    at, body, width, height, depth = 8, b"", 0, 0, 3
    while at < len(raw):
        size, kind = struct.unpack_from(">I4s", raw, at)
        if kind == b"IHDR":
            width, height = struct.unpack_from(">II", raw, at + 8)
            depth = {2: 3, 6: 4}[raw[at + 17]]
        elif kind == b"IDAT":
            body += raw[at + 8 : at + 8 + size]
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(body), np.uint8).reshape(height, width * depth + 1)
    out, above = np.zeros((height, width * depth), np.uint8), np.zeros(width * depth, np.int32)
    for y in range(height):
        how, line = lines[y, 0], lines[y, 1:].astype(np.int32)
        if how == 2:
            line = line + above
        elif how:
            done = np.zeros(len(line), np.int32)
            for x in range(len(line)):
                a = int(done[x - depth]) if x >= depth else 0
                b, c = int(above[x]), int(above[x - depth]) if x >= depth else 0
                guess = min((a, b, c), key=lambda v, p=a + b - c: abs(p - v))
                done[x] = (int(line[x]) + (a if how == 1 else (a + b) // 2 if how == 3 else guess)) & 255
            line = done
        above = line & 255
        out[y] = above
    return out.reshape(height, width, depth)[:, :, :3]


def scan_bmp(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, lambda raw: [_pixels(decode_bmp(bytes(raw)))], PIXELS)


def scan_png(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, lambda raw: [_pixels(decode_png(bytes(raw)))], PIXELS)


def sink_image(pixels: DataFrame, path: str, flip: bool = False) -> None:
    image = image_array(pixels)
    image = image[::-1] if flip else image
    with open(path, "wb") as file:
        file.write((encode_bmp if path.endswith(".bmp") else encode_png)(image))


def sink_text_kv(rows: DataFrame, path: str, key: str, value: str) -> None:
    """key TAB value, by value, largest first, in one file."""
    rows.orderBy(F.desc(value), F.asc(key)).select(key, F.col(value).cast("string")).coalesce(1).write.option("sep", "\t").csv(path)


def sink_int_matrix(rows: DataFrame, n: int, path: str, unreachable: int) -> None:
    """All n * n values (i, j, d) by rows as int32; pairs that aren't there as the sentinel."""
    cells = rows.sparkSession.range(n * n).select(F.expr(f"id div {n}").alias("i"), (F.col("id") % n).alias("j"))
    sink_int_vector(cells.join(rows.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), "d"), ["i", "j"], "left"), path, ["i", "j"], "d", unreachable)


def sink_partition_map(rows: DataFrame, path: str) -> None:
    """One owner a line, by vertex (v, part), in one file of the folder."""
    rows.orderBy("v").select(F.col("part").cast("string")).coalesce(1).write.text(path)


def scan_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value): the lines of text files, read in splits; the input of titles and links."""
    return spark.read.text(path)


def scan_kv_text(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """(key, value) of lines, split at the first separator; a line without one is a key with an empty value."""
    parts = F.split(F.col("value"), f"\\Q{sep}\\E", 2)
    return scan_lines(spark, path).select(parts[0].alias("key"), F.coalesce(F.get(parts, F.lit(1)), F.lit("")).alias("value"))


def random_f32(spark: SparkSession, n: int = 100, top: int = 10_000_000, seed: int = 0) -> DataFrame:
    """(pos, x): n whole numbers from 0 to top as float32, the same for the same seed and number of partitions."""
    return spark.range(n).select(F.col("id").alias("pos"), F.floor(F.rand(seed) * (top + 1)).cast("float").alias("x"))
