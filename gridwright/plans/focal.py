"""How neighbourhoods are read: windows along an axis, pushes along offsets, or haloed tiles.

* ``along``: a frame on one axis, for kernels of rank 1. Windows are keyed by image and row (or column).
* ``pushed``: every cell sends its value to the cells that see it, and one aggregation with map-side
  partials gathers them. No join. The image is first widened by copies of border cells where the edge
  rule asks for it, which adds O(perimeter x radius) rows.
* ``tiled``: cells are grouped to blocks with a border; a NumPy function maps a block. One shuffle, with
  (1 + 2r/T)^2 rows instead of (2r + 1)^2.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

IMAGE = "image_id"


def rows_of(name: str = IMAGE):
    """The window of a row of an image, from left to right."""
    return W.partitionBy(name, "y").orderBy("x")


def columns_of(name: str = IMAGE):
    """The window of a column of an image, from top to bottom."""
    return W.partitionBy(name, "x").orderBy("y")


def shape(cells: DataFrame) -> DataFrame:
    """image_id, h, w"""
    return cells.groupBy(IMAGE).agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))


def _places(v: Column, n: Column, r: int, edge: str) -> Column:
    """Where along one axis a cell stands after widening by r: itself, and copies beyond the border."""
    own = F.array(v)
    if edge == "clamp":
        low = F.when(v == 0, F.sequence(F.lit(-r).cast("long"), F.lit(-1).cast("long"))).otherwise(F.array().cast("array<long>"))
        high = F.when(v == n - 1, F.sequence(n, n + r - 1)).otherwise(F.array().cast("array<long>"))
        return F.concat(low, own, high)
    if edge == "mirror":
        below = F.when((v >= 1) & (v <= r), F.array(-v)).otherwise(F.array().cast("array<long>"))
        above = F.when((v <= n - 2) & (v >= n - 1 - r), F.array(2 * (n - 1) - v)).otherwise(F.array().cast("array<long>"))
        return F.concat(below, own, above)
    return own


def widened(cells: DataFrame, r: int, edge: str) -> DataFrame:
    """cells with h and w, and with copies up to r beyond the border for edge 'clamp' or 'mirror'."""
    sized = cells.join(shape(cells), IMAGE)
    if edge in ("zero", "shrink"):
        return sized
    rest = [c for c in cells.columns if c not in ("y", "x")]
    tall = sized.select(*rest, "h", "w", "x", F.explode(_places(F.col("y").cast("long"), F.col("h"), r, edge)).alias("y"))
    return tall.select(*rest, "h", "w", "y", F.explode(_places(F.col("x").cast("long"), F.col("w"), r, edge)).alias("x"))


def pushed(cells: DataFrame, offsets: list[tuple], edge: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """A row for each cell (y, x) and each of its neighbours (y + dy, x + dx): the neighbour's columns, dy, dx and extras of the offset."""
    r = max(max(abs(o[0]), abs(o[1])) for o in offsets)
    wide = widened(cells, r, edge)
    names = ["dy", "dx", *extra]
    table = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, o, strict=True)]) for o in offsets])
    sent = wide.withColumn("o", F.explode(table)).select("*", "o.*").drop("o")
    moved = sent.withColumns({"y": F.col("y") - F.col("dy"), "x": F.col("x") - F.col("dx")})
    inside = (F.col("y") >= 0) & (F.col("y") < F.col("h")) & (F.col("x") >= 0) & (F.col("x") < F.col("w"))
    return moved.where(inside).drop("h", "w")


def tile_with_halo(cells: DataFrame, size: int, r: int, edge: str = "clamp", ordered: bool = True, about: DataFrame | None = None) -> DataFrame:
    """image_id, ty, tx, cells: blocks of size x size with a border of r, as an array of (y, x, values), sorted unless that does not matter.

    about: image_id, h, w and more columns of an image, which every tile then has behind its cells; for edge "zero" or "shrink".
    """
    rest = [] if about is None else about.columns[1:]
    wide = widened(cells, r, edge) if edge != "zero" and about is None else cells.join(shape(cells) if about is None else about, IMAGE)
    # the tiles whose widened extent holds a coordinate
    span = lambda v, n: F.sequence(F.greatest(F.floor((v - r) / size), F.lit(0)), F.least(F.floor((v + r) / size), F.floor((n - 1) / size)))
    values = F.struct(*[c for c in wide.columns if c not in (IMAGE, "h", "w", *rest)])
    placed = wide.select(IMAGE, F.explode(span(F.col("y"), F.col("h"))).alias("ty"), "x", "w", *(c for c in rest if c != "w"), values.alias("cell"))
    placed = placed.select(IMAGE, "ty", F.explode(span(F.col("x"), F.col("w"))).alias("tx"), "cell", *rest)
    found = F.collect_list("cell")
    return placed.groupBy(IMAGE, "ty", "tx").agg((F.sort_array(found) if ordered else found).alias("cells"), *(F.first(c).alias(c) for c in rest))


def untile(tiles: DataFrame, size: int) -> DataFrame:
    """Cells again, borders dropped."""
    flat = tiles.select(IMAGE, "ty", "tx", F.explode("cells").alias("cell")).select(IMAGE, "ty", "tx", "cell.*")
    own = (F.floor(F.col("y") / size) == F.col("ty")) & (F.floor(F.col("x") / size) == F.col("tx")) & (F.col("y") >= 0) & (F.col("x") >= 0)
    return flat.where(own).drop("ty", "tx")


def tile_arrays(batch: pa.RecordBatch, columns: list[str]) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(image, ty, tx, y, x, values) of each tile of a batch of image_id, ty, tx, cells: the nested cells as flat arrays."""
    cells = batch.column(3)
    flat, stops = cells.flatten(), np.cumsum(cells.value_lengths().to_numpy(zero_copy_only=False)).astype(int)
    take = lambda n: flat.field(flat.type.get_field_index(n)).to_numpy(zero_copy_only=False)
    y, x, v = take("y"), take("x"), np.stack([take(c).astype(float) for c in columns], axis=1)
    for i, (a, b) in enumerate(zip([0, *stops[:-1]], stops, strict=True)):
        yield (*(batch.column(k)[i].as_py() for k in range(3)), y[a:b], x[a:b], v[a:b])


def tiled(cells: DataFrame, fn: Callable[[np.ndarray], np.ndarray], r: int, columns: list[str], edge: str = "clamp", size: int = 32, out: list[str] | None = None) -> DataFrame:
    """fn on haloed blocks: (h + 2r, w + 2r, columns) to (h, w, out columns); cells beyond a zero edge are 0.

    For edge "shrink" fn gets one channel more: 1 in the image, 0 outside. A clamped border is repeated in the task: only cells travel.
    """
    names, beyond, clamped = out or columns, edge in ("zero", "shrink"), edge == "clamp"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for nth, (image, ty, tx, gy, gx, v) in enumerate(tile_arrays(batch, columns)):
                y, x = gy - ty * size + r, gx - tx * size + r
                fixed = beyond or clamped
                block = np.zeros((size + 2 * r if fixed else y.max() + 1, size + 2 * r if fixed else x.max() + 1, len(columns) + (edge == "shrink")))
                block[y, x, : len(columns)] = v
                if edge == "shrink":
                    block[y, x, -1] = 1
                if clamped:
                    # where each line of the widened block comes from; the image's last line lies in the block if anything beyond it does
                    rows, cols = (np.clip(np.arange(-r, min(size, n - t * size) + r), -t * size, n - 1 - t * size) + r for n, t in ((batch.column(4)[nth].as_py(), ty), (batch.column(5)[nth].as_py(), tx)))
                    block = block[np.ix_(rows, cols)]
                made = fn(block)
                own = (y >= r) & (y < r + size) & (x >= r) & (x < r + size)
                if not beyond:
                    own &= (y < block.shape[0] - r) & (x < block.shape[1] - r)
                parts = [np.full(own.sum(), image), gy[own], gx[own], *(made[y[own] - r, x[own] - r, i].astype(float) for i in range(len(names)))]
                yield pa.RecordBatch.from_arrays([pa.array(p) for p in parts], [IMAGE, "y", "x", *names])

    kept = cells.select(IMAGE, "y", "x", *columns)
    tiles = tile_with_halo(kept, size, r, "zero" if beyond or clamped else edge, ordered=False, about=shape(cells) if clamped else None)
    return tiles.mapInArrow(run, f"{IMAGE} long, y long, x long, " + ", ".join(f"{c} double" for c in names))


def around(block: np.ndarray, r: int) -> np.ndarray:
    """The (2r + 1)^2 values around each inner cell of an (h + 2r, w + 2r) array, row by row, as the last axis."""
    view = np.lib.stride_tricks.sliding_window_view(block, (2 * r + 1, 2 * r + 1))
    return view.reshape(*view.shape[:2], -1)


def focal_udf(fn: Callable[[np.ndarray], np.ndarray], radius: int, edge: str = "clamp") -> Callable[[DataFrame], DataFrame]:
    """A user's NumPy function on haloed blocks as a DataFrame transform over the three channels."""
    return lambda cells: tiled(cells, fn, radius, ["r", "g", "b"], edge)
