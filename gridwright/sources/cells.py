"""The cells layout: one row for each grid cell, keyed image_id, y, x; and ways in and out of it."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SIDE = 64
KEY = ["image_id", "y", "x"]


def from_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dense 64 x 64 raster for each dozen suppliers: quantity, discount and tax as r, g, b."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        F.floor(F.col("l_suppkey") / 12).alias("image_id"), (F.col("l_orderkey") % SIDE).alias("y"), (F.col("l_partkey") % SIDE).alias("x"),
        (F.floor("l_quantity").cast("int") * 5).alias("r"), (F.round(F.col("l_discount") * 100).cast("int") * 25).alias("g"), (F.round(F.col("l_tax") * 100).cast("int") * 31).alias("b"),
    )
    filled = rows.groupBy(*KEY).agg(F.max("r").alias("r"), F.max("g").alias("g"), F.max("b").alias("b"))
    # Spark takes an exploded row for one row, so cells made by explode() look small enough to broadcast, and the few images would be one task's; a
    # product's size is known, and lines are dealt to tasks before they become cells
    line = lambda name: F.broadcast(spark.range(SIDE).select(F.col("id").alias(name)))
    lines = rows.select("image_id").distinct().crossJoin(line("y")).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "image_id", "y")
    spine = lines.crossJoin(line("x"))
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in "rgb"]
    return spine.join(filled, KEY, "left").select(*KEY, *zero, F.lit(255).alias("a"))


#: The same in DuckDB's SQL; a query's own SQL follows after a comma.
CELLS_SQL = """
WITH filled AS (
  SELECT l_suppkey // 12 AS image_id, l_orderkey % 64 AS y, l_partkey % 64 AS x,
         max(CAST(floor(l_quantity) AS INT) * 5) AS r, max(CAST(round(l_discount * 100) AS INT) * 25) AS g, max(CAST(round(l_tax * 100) AS INT) * 31) AS b
  FROM lineitem GROUP BY 1, 2, 3),
line AS (SELECT range AS v FROM range(64)),
cells AS MATERIALIZED (
  SELECT i.image_id, yy.v AS y, xx.v AS x, coalesce(r, 0) AS r, coalesce(g, 0) AS g, coalesce(b, 0) AS b, 255 AS a
  FROM (SELECT DISTINCT image_id FROM filled) i CROSS JOIN line yy CROSS JOIN line xx
  LEFT JOIN filled f ON f.image_id = i.image_id AND f.y = yy.v AND f.x = xx.v),
lumas AS MATERIALIZED (SELECT image_id, y, x, CAST(floor((2126 * r + 7152 * g + 722 * b) / 10000.0) AS INT) AS v FROM cells)
"""


def luma(r: Column | str = "r", g: Column | str = "g", b: Column | str = "b") -> Column:
    """Integer luma of integer channels."""
    c = [F.col(x) if isinstance(x, str) else x for x in (r, g, b)]
    return F.floor((2126 * c[0] + 7152 * c[1] + 722 * c[2]) / 10000.0).cast("int")


def with_luma(cells: DataFrame) -> DataFrame:
    """image_id, y, x, v: the luma plane."""
    return cells.select(*KEY, luma().alias("v"))


def clamp(v: Column, white: Column | float = 255) -> Column:
    return F.least(F.greatest(v, F.lit(0)), white if isinstance(white, Column) else F.lit(white))


def crop(cells: DataFrame, y0: int, y1: int, x0: int, x1: int) -> DataFrame:
    """Cells of [y0, y1) x [x0, x1); the filter reaches the scan."""
    return cells.where((F.col("y") >= y0) & (F.col("y") < y1) & (F.col("x") >= x0) & (F.col("x") < x1))


def select_channels(cells: DataFrame, r: bool, g: bool, b: bool) -> DataFrame:
    """Channels that are not kept become zero."""
    return cells.select(*KEY, *(F.col(c) if keep else F.lit(0).alias(c) for c, keep in zip("rgb", (r, g, b), strict=True)), "a")


FORMATS = {"8u": 255, "10u": 1023, "16u": 32767, "32f": 1}


def normalize_format(cells: DataFrame, fmt: str | Column) -> DataFrame:
    """Channels as doubles in 0..1, whatever the pixel format; fmt may be a column."""
    f = F.lit(fmt) if isinstance(fmt, str) else fmt
    white = F.element_at(F.create_map(*[F.lit(v) for k, w in FORMATS.items() for v in (k, float(w))]), f)
    return cells.select(*KEY, *((F.col(c) / white).alias(c) for c in "rgba"))


def unpack_10u(packed: DataFrame, column: str = "p") -> DataFrame:
    """10-bit r, g, b out of 2:10:10:10 integers, blue in the low bits after the padding."""
    bits = lambda n: F.shiftright(F.col(column), n).bitwiseAND(1023)
    return packed.select("*", bits(22).alias("r"), bits(12).alias("g"), bits(2).alias("b"))


def stored_format(cells: DataFrame, fmt: str) -> DataFrame:
    """Doubles in 0..1 clamped and scaled to a pixel format's integers."""
    w = FORMATS[fmt]
    return cells.select(*KEY, *(F.floor(clamp(F.col(c), 1.0) * w + 0.5).cast("int").alias(c) for c in "rgba"))


def write_frames(cells: DataFrame, path: str, buckets: int = 64) -> None:
    """Parquet by bucket of images, so that a scan for some images reads few folders."""
    cells.withColumn("bucket", F.pmod(F.col("image_id"), F.lit(buckets))).repartition("bucket").sortWithinPartitions(*KEY).write.partitionBy("bucket").parquet(path)


def apply_params(cells: DataFrame, params: DataFrame, defaults: dict[str, float]) -> DataFrame:
    """One column for each name, the image's own value or the default. params: image_id, name, value."""
    wide = params.groupBy("image_id").agg(*(F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in defaults))
    joined = cells.join(wide, "image_id", "left")
    return joined.withColumns({n: F.coalesce(F.col(n), F.lit(float(v))) for n, v in defaults.items()})


def read_raw_frames(spark: SparkSession, path: str, fmt: str, height: int, width: int, channels: int = 3) -> DataFrame:
    """Raw interleaved dumps: path, y, x, r, g, b, error; a file of the wrong size is one row with the error."""
    kind = {"32f": "<f4", "8u": "u1", "16u": "<u2", "10u": "<u4"}[fmt]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for name, content in zip(part["path"], part["content"], strict=True):
                v = np.frombuffer(content, dtype=kind) if len(content) % np.dtype(kind).itemsize == 0 else np.zeros(0)
                if len(v) != height * width * (1 if fmt == "10u" else channels):
                    yield pd.DataFrame({"path": [name], "y": [None], "x": [None], "r": [None], "g": [None], "b": [None], "error": [f"{len(content)} bytes"]})
                    continue
                if fmt == "10u":
                    v = np.stack([v >> 22 & 1023, v >> 12 & 1023, v >> 2 & 1023], axis=1)
                v = v.reshape(height * width, -1).astype(float)
                order = (2, 1, 0) if fmt == "8u" and channels == 4 else (0, 1, 2)
                y, x = np.divmod(np.arange(height * width), width)
                yield pd.DataFrame({"path": name, "y": y, "x": x, "r": v[:, order[0]], "g": v[:, order[1]], "b": v[:, order[2]], "error": None})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, y long, x long, r double, g double, b double, error string")


def read_bmp_frames(spark: SparkSession, path: str) -> DataFrame:
    """24-bit bitmaps: path, y, x, r, g, b, error; anything else is one row with the error."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for name, content in zip(part["path"], part["content"], strict=True):
                try:
                    if content[:2] != b"BM":
                        raise ValueError("not a bitmap")
                    (start,), (w, h, _, bits) = struct.unpack_from("<I", content, 10), struct.unpack_from("<iiHH", content, 18)
                    stride = (w * 3 + 3) // 4 * 4
                    if bits != 24 or w <= 0 or len(content) < start + stride * abs(h):
                        raise ValueError("truncated or not 24 bits")
                except (ValueError, struct.error) as e:
                    yield pd.DataFrame({"path": [name], "y": [None], "x": [None], "r": [None], "g": [None], "b": [None], "error": [str(e)]})
                    continue
                rows = np.frombuffer(content, np.uint8, stride * abs(h), start).reshape(abs(h), stride)[:, : w * 3].reshape(abs(h), w, 3)
                rows = rows[::-1] if h > 0 else rows
                y, x = np.divmod(np.arange(abs(h) * w), w)
                v = rows.reshape(-1, 3).astype(int)
                yield pd.DataFrame({"path": name, "y": y, "x": x, "r": v[:, 2], "g": v[:, 1], "b": v[:, 0], "error": None})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, y long, x long, r int, g int, b int, error string")


def batch_convert(frames: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cells of the files that could be read, path and error of the others)."""
    return frames.where("error is null").drop("error"), frames.where("error is not null").select("path", "error")


def build_cct_reference(lines: DataFrame, column: str = "value") -> DataFrame:
    """cct, r, g, b from lines of a published table ("2700 K  255 169 87"); other lines are left out."""
    part = lambda i: F.regexp_extract(column, r"^\s*(\d{3,5})\s*K?\s+(\d{1,3})\s+(\d{1,3})\s+(\d{1,3})\s*$", i)
    found = lines.where(part(1) != "").select(*(part(i).cast("int").alias(n) for i, n in enumerate(("cct", "r", "g", "b"), 1)))
    return found.where(F.col("cct") % 100 == 0)
