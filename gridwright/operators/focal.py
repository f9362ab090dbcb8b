"""Focal operators: a cell's value from its neighbourhood. Planes are image_id, y, x, v unless said."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import tables
from ..plans.focal import around, columns_of, pushed, rows_of, shape, tiled
from ..plans.iterate import saved
from ..sources.cells import KEY, clamp, luma
from .local import negate_luma
from .stats import min_block_std, otsu_threshold


def square(r: int) -> list[tuple[int, int]]:
    return [(dy, dx) for dy in range(-r, r + 1) for dx in range(-r, r + 1)]


def _back(column: str, cells: DataFrame) -> Column:
    """A column of tiles in the type that cells have it in; no number is null."""
    return F.when(~F.isnan(column), F.col(column)).cast(cells.schema[column].dataType).alias(column)


def convolve(cells: DataFrame, kernel: str) -> DataFrame:
    """Kernel flipped, zero outside, divided, clamped, truncated; on tiles."""
    weights, norm = tables.kernel(kernel)
    r = max(max(abs(dy), abs(dx)) for dy, dx, _ in weights)

    def run(block: np.ndarray) -> np.ndarray:
        h, w = block.shape[0] - 2 * r, block.shape[1] - 2 * r
        known = np.nan_to_num(block[..., :3])
        sums = sum(k * known[r - dy : r - dy + h, r - dx : r - dx + w] for dy, dx, k in weights)
        return np.concatenate([np.minimum(np.floor(np.maximum(sums, 0) / norm), 255), block[r : r + h, r : r + w, 3:]], axis=-1)

    found = tiled(cells, run, r, ["r", "g", "b", "a"], "zero")
    return found.select(*KEY, *(F.col(c).cast("int").alias(c) for c in "rgb"), _back("a", cells))


def box_sum(planes: DataFrame, r: int, column: str = "v") -> DataFrame:
    """s: the sum over (2r+1)^2 cells with border cells repeated, by two window passes."""
    sized = planes.select(*KEY, column).join(shape(planes), "image_id")

    def pass_(df: DataFrame, w: W, at: str, n: str, name: str) -> DataFrame:
        inner = F.sum(name).over(w.rowsBetween(-r, r))
        first, last = F.first(name).over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)), F.last(name).over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
        low, high = F.greatest(F.lit(r) - F.col(at), F.lit(0)), F.greatest(F.col(at) + r - F.col(n) + 1, F.lit(0))
        return df.withColumn(name, inner + first * low + last * high)

    step = pass_(sized.withColumnRenamed(column, "s"), rows_of(), "x", "w", "s")
    return pass_(step, columns_of(), "y", "h", "s").select(*KEY, "s")


def box_mean(planes: DataFrame, r: int) -> DataFrame:
    return box_sum(planes, r).select(*KEY, F.floor(F.col("s") / float((2 * r + 1) ** 2)).cast("int").alias("v"))


def geometric_mean(planes: DataFrame, r: int) -> DataFrame:
    logs = planes.select(*KEY, F.log10(F.col("v") + 1).alias("v"))
    return box_sum(logs, r).select(*KEY, (F.pow(F.lit(10.0), F.col("s") / float((2 * r + 1) ** 2)) - 1).alias("v"))


def sliding_median(block: np.ndarray, r: int) -> np.ndarray:
    """The middle of the (2r + 1)^2 values around each inner cell of an (h + 2r, w + 2r) array, by sliding histograms.

    Every column keeps a histogram of its 2r + 1 cells; a row down takes one cell out of each and puts one in. Running sums of these over
    the columns give each window's histogram as one difference, whatever its width. The bins are the block's different values, whole or not.
    """
    values, rank = np.unique(block, return_inverse=True)
    rank, size = rank.reshape(block.shape), 2 * r + 1
    h, w, n = block.shape[0] - 2 * r, block.shape[1], len(values)
    columns, out = np.zeros((w, n), np.int32), np.empty((h, w - 2 * r), dtype=block.dtype)
    at = np.arange(w)
    for row in rank[: size - 1]:
        columns[at, row] += 1
    sums = np.zeros((w + 1, n), np.int32)
    for y in range(h):
        columns[at, rank[y + size - 1]] += 1
        np.cumsum(columns, axis=0, out=sums[1:])
        counts = np.cumsum(sums[size:] - sums[:-size], axis=1, dtype=np.int32)
        out[y] = values[(counts <= size * size // 2).sum(axis=1)]
        columns[at, rank[y]] -= 1
    return out


def _middle(block: np.ndarray, r: int) -> np.ndarray:
    """sliding_median() where a window has more cells than the block has values, which is when histograms are the shorter way; else by selection."""
    size = 2 * r + 1
    if len(np.unique(block)) <= size * size:
        return sliding_median(block, r)
    # a few rows at a time: the windows of a whole block would be size^2 copies of it
    step = max(1, (1 << 21) // (block.shape[1] * size * size))
    parts = [np.partition(around(block[y : y + step + 2 * r], r), size * size // 2, axis=-1)[..., size * size // 2] for y in range(0, block.shape[0] - 2 * r, step)]
    return np.concatenate([p[: block.shape[0] - 2 * r - y] for p, y in zip(parts, range(0, block.shape[0] - 2 * r, step), strict=True)])


def median(planes: DataFrame, size: int) -> DataFrame:
    """The middle of size x size values, border cells repeated, for any odd size; on tiles that grow with the size, so that
    halos stay a bounded share of the cells that are shuffled."""
    r = size // 2
    found = tiled(planes, lambda b: _middle(b[..., 0], r)[..., None], r, ["v"], size=max(32, 4 * r))
    return found.select(*KEY, F.col("v").cast(planes.schema["v"].dataType).alias("v"))


def _frame_extreme(planes: DataFrame, r: int, fn) -> DataFrame:
    step = planes.select(*KEY, fn("v").over(rows_of().rowsBetween(-r, r)).alias("v"))
    return step.select(*KEY, fn("v").over(columns_of().rowsBetween(-r, r)).alias("v"))


def adaptive_median(planes: DataFrame, rmax: int = 8, tol: int = 0, iters: int = 1) -> DataFrame:
    """Cells that are an extreme of their 3 x 3 neighbourhood get the middle distinct value of the smallest window whose median is inside its range.

    Windows shrink at the border. One shuffle to haloed tiles for each iteration; only suspects look beyond 3 x 3.
    """
    now = planes.select(*KEY, "v")
    for i in range(iters):
        now = tiled(now if i == 0 else saved(now), lambda b: _adapted(b, rmax, tol), rmax, ["v"], "shrink").select(*KEY, F.col("v").cast(planes.schema["v"].dataType).alias("v"))
    return now


def _adapted(block: np.ndarray, rmax: int, tol: int) -> np.ndarray:
    v = np.where(block[..., 1] > 0, block[..., 0], np.inf)
    h, w = v.shape[0] - 2 * rmax, v.shape[1] - 2 * rmax
    own = v[rmax : rmax + h, rmax : rmax + w]
    near = lambda r: v[rmax - r : rmax + h + r, rmax - r : rmax + w + r]
    ring = around(near(1), 1)
    low, high = ring.min(-1), np.where(np.isfinite(ring), ring, -np.inf).max(-1)
    out = own.copy()
    todo = np.argwhere(np.isfinite(own) & ((own <= low + tol) | (own >= high - tol)))
    for r in range(1, rmax + 1):
        if not len(todo):
            break
        s = np.sort(np.lib.stride_tricks.sliding_window_view(near(r), (2 * r + 1, 2 * r + 1))[todo[:, 0], todo[:, 1]].reshape(len(todo), -1), axis=1)
        rows, m = np.arange(len(s)), np.isfinite(s).sum(1)
        med = s[rows, m // 2]
        ready = (med > s[:, 0]) & (med < s[rows, m - 1])
        if ready.any():
            t, at = s[ready], todo[ready]
            rank = np.concatenate([np.zeros((len(t), 1), int), np.cumsum(t[:, 1:] != t[:, :-1], axis=1)], axis=1)
            rank[~np.isfinite(t)] = t.shape[1]
            k = np.where(rank < t.shape[1], rank, -1).max(1) + 1
            right, left = rank == (k // 2)[:, None], rank == (k // 2 - 1)[:, None]
            pick = np.where((k % 2 == 0) & (left.sum(1) > right.sum(1)), left.argmax(1), right.argmax(1))
            out[at[:, 0], at[:, 1]] = t[np.arange(len(t)), pick]
        todo = todo[~ready]
    return out[..., None]


def fuzzy_smooth(planes: DataFrame, size: int, sigma: float) -> DataFrame:
    """Neighbours weighted by likeness, the centre left out, borders repeated; on tiles."""
    r = size // 2

    def run(block: np.ndarray) -> np.ndarray:
        near = np.delete(around(block[..., 0], r), size * size // 2, axis=-1)
        own = block[r : block.shape[0] - r, r : block.shape[1] - r, 0]
        w = np.exp(-((near - own[..., None]) ** 2) / (2.0 * sigma * sigma))
        total = w.sum(-1)
        return np.where(total < 1e-300, own, (w * near).sum(-1) / np.maximum(total, 1e-300))[..., None]

    return tiled(planes, run, r, ["v"])


def fuzzy_median_std(planes: DataFrame) -> DataFrame:
    """Cells whose local deviation is over 1.5 times the image's noise floor move to the median, over 6 times they stay (an edge)."""
    kind = planes.schema["v"].dataType

    def run(block: np.ndarray) -> np.ndarray:
        nine = around(block[..., 0], 1)
        return np.stack([np.round(nine.std(axis=-1, ddof=1), 9), np.partition(nine, 4, axis=-1)[..., 4]], axis=-1)

    near = tiled(planes, run, 1, ["v"], out=["s", "m"]).withColumn("m", F.col("m").cast(kind))
    joined = planes.select(*KEY, "v").join(near, KEY).join(min_block_std(planes), "image_id", "left")
    band = (F.col("s") > 1.5 * F.col("noise_floor")) & (F.col("s") <= 6.0 * F.col("noise_floor"))
    return joined.select(*KEY, F.when(band, F.col("m")).otherwise(F.col("v")).alias("v"))


def bilateral(planes: DataFrame, radius: int, sigma: float, columns: tuple[str, ...] = ("v",)) -> DataFrame:
    """Weights of distance in value over all columns (sigma) and place (sigma 3), windows shrunk at borders; on tiles."""
    place = np.array([math.exp(-(dy * dy + dx * dx) / 18.0) for dy, dx in square(radius)])

    def run(block: np.ndarray) -> np.ndarray:
        near = np.stack([around(block[..., i], radius) for i in range(len(columns))])
        own = block[radius : block.shape[0] - radius, radius : block.shape[1] - radius, : len(columns)]
        d2 = ((near - np.moveaxis(own, -1, 0)[..., None]) ** 2).sum(0)
        w = place * np.exp(-d2 / (2.0 * sigma * sigma)) * around(block[..., -1], radius)
        return np.moveaxis((w * near).sum(-1) / np.maximum(w.sum(-1), 1e-300), 0, -1)

    return tiled(planes, run, radius, list(columns), "shrink")


def _neighbours(v: str = "v") -> dict[str, Column]:
    own = F.col(v)
    return {
        "left": F.coalesce(F.lag(v).over(rows_of()), own), "right": F.coalesce(F.lead(v).over(rows_of()), own),
        "up": F.coalesce(F.lag(v).over(columns_of()), own), "down": F.coalesce(F.lead(v).over(columns_of()), own),
    }


def anisotropic_diffusion(planes: DataFrame, k: float, dt: float, steps: int, every: int = 4) -> DataFrame:
    """Perona-Malik steps over four neighbours, borders repeated; the lineage is cut every few steps."""
    now = planes.select(*KEY, F.col("v").cast("double").alias("v"))
    for i in range(steps):
        step = now.select(*KEY, "v", *(c.alias(n) for n, c in _neighbours().items()))
        flow = sum((F.col(n) - F.col("v")) / (1 + F.pow((F.col(n) - F.col("v")) / k, 2)) for n in ("up", "left", "right", "down"))
        now = step.select(*KEY, clamp(F.col("v") + dt * flow, 255.0).alias("v"))
        if (i + 1) % every == 0 and i + 1 < steps:
            now = saved(now)
    return now


def erode(planes: DataFrame, shape_: str, size: int) -> DataFrame:
    return _morph(planes, shape_, size, F.min)


def dilate(planes: DataFrame, shape_: str, size: int) -> DataFrame:
    return _morph(planes, shape_, size, F.max)


def _morph(planes: DataFrame, shape_: str, size: int, fn) -> DataFrame:
    """Borders repeated. Rank-1 elements take windows (repeating a border changes no extreme of a box), others tiles."""
    r = size // 2
    if shape_ == "square":
        return _frame_extreme(planes, r, fn)
    if shape_ in ("horizontal", "vertical"):
        w = rows_of() if shape_ == "horizontal" else columns_of()
        return planes.select(*KEY, fn("v").over(w.rowsBetween(-r, r)).alias("v"))
    return _extremes(planes, tables.mask(shape_, size)).select(*KEY, ("low" if fn is F.min else "high")).toDF(*KEY, "v")


def _extremes(planes: DataFrame, offsets: list[tuple[int, int]]) -> DataFrame:
    """image_id, y, x, low, high: the least and the largest value at these offsets, borders repeated; a cell without any has no row."""
    r = max(max(abs(dy), abs(dx)) for dy, dx in offsets)
    kind = planes.schema["v"].dataType

    def run(block: np.ndarray) -> np.ndarray:
        h, w = block.shape[0] - 2 * r, block.shape[1] - 2 * r
        there, known = block[..., 1] > 0, (block[..., 1] > 0) & ~np.isnan(block[..., 0])
        at = lambda a, o: a[r + o[0] : r + o[0] + h, r + o[1] : r + o[1] + w]
        parts = []
        for fn, none in ((np.minimum, np.inf), (np.maximum, -np.inf)):
            v = np.where(known, block[..., 0], none)
            parts.append(functools.reduce(fn, (at(v, o) for o in offsets)))
        return np.stack([*parts, functools.reduce(np.logical_or, (at(there, o) for o in offsets))], axis=-1)

    found = tiled(planes.select(*KEY, "v", F.lit(1).alias("n")), run, r, ["v", "n"], out=["low", "high", "n"]).where("n > 0")
    some = F.col("low") <= F.col("high")
    return found.select(*KEY, *(F.when(some, F.col(c)).cast(kind).alias(c) for c in ("low", "high")))


def morph_open(planes: DataFrame, shape_: str, size: int) -> DataFrame:
    return dilate(erode(planes, shape_, size), shape_, size)


def morph_close(planes: DataFrame, shape_: str, size: int) -> DataFrame:
    return erode(dilate(planes, shape_, size), shape_, size)


def morph_gradient(planes: DataFrame, shape_: str, size: int) -> DataFrame:
    """Dilation less erosion, both out of one neighbourhood."""
    return _extremes(planes, tables.mask(shape_, size)).select(*KEY, (F.col("high") - F.col("low")).alias("v"))


def gradient(planes: DataFrame) -> DataFrame:
    """gx, gy: central differences halved, one-sided at the border; and the magnitude."""
    rows, cols = rows_of(), columns_of()

    def along(w) -> Column:
        before, after = F.lag("v").over(w), F.lead("v").over(w)
        return F.when(before.isNull(), (after - F.col("v")).cast("double")).when(after.isNull(), (F.col("v") - before).cast("double")).otherwise((after - before) / 2.0)

    step = planes.select(*KEY, "v", along(rows).alias("gx"))
    step = step.select(*KEY, "gx", along(cols).alias("gy"))
    return step.select(*KEY, "gx", "gy", F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")).alias("magnitude"))


def sobel(planes: DataFrame) -> DataFrame:
    """|gx| + |gy| of the 3 x 3 operator; border cells keep their value."""
    rows, cols = rows_of(), columns_of()
    step = planes.select(*KEY, "v", (F.lead("v").over(rows) - F.lag("v").over(rows)).alias("dx"), (F.lag("v").over(rows) + 2 * F.col("v") + F.lead("v").over(rows)).alias("sx"))
    gx = F.lag("dx").over(cols) + 2 * F.col("dx") + F.lead("dx").over(cols)
    gy = F.lead("sx").over(cols) - F.lag("sx").over(cols)
    return step.select(*KEY, F.coalesce(F.abs(gx) + F.abs(gy), F.col("v")).alias("v"))


def edge_sketch(planes: DataFrame, enhance: float) -> DataFrame:
    g = gradient(planes)
    return g.select(*KEY, (255.0 - F.least(enhance * F.col("magnitude"), F.lit(255.0))).alias("v"))


def charcoal(planes: DataFrame, threshold: float) -> DataFrame:
    """Negative, smooth cells only, Otsu's threshold on what is left, a Gaussian over the result."""
    dark = negate_luma(planes)
    flat = dark.join(gradient(dark).select(*KEY, "magnitude"), KEY).select(*KEY, F.when(F.round("magnitude", 9) <= threshold, F.col("v")).otherwise(0).alias("v"))
    hist = flat.groupBy("image_id", F.col("v").alias("bin")).agg(F.count("*").alias("n"))
    two = flat.join(otsu_threshold(hist), "image_id").select(*KEY, F.when(F.col("v") > F.col("threshold"), 255).otherwise(0).alias("v"))
    weights, norm = tables.kernel("gaussian_3")

    def run(block: np.ndarray) -> np.ndarray:
        h, w = block.shape[0] - 2, block.shape[1] - 2
        return np.floor(sum(k * block[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w] for dy, dx, k in weights) / norm)

    return tiled(two, run, 1, ["v"]).select(*KEY, F.col("v").cast("int").alias("v"))


def mode_filter(cells: DataFrame, w: int) -> DataFrame:
    """The most frequent value of each channel in the forward window, the larger one of equals; on tiles. A null counts as the least value."""
    r, least = w - 1, np.finfo(float).min

    def run(block: np.ndarray) -> np.ndarray:
        h, n = block.shape[0] - 2 * r, block.shape[1] - 2 * r
        window = lambda a: np.lib.stride_tricks.sliding_window_view(a[r:, r:], (w, w)).reshape(h, n, w * w)
        made = []
        for k in range(3):
            v = np.where(block[..., 3] > 0, np.nan_to_num(block[..., k], nan=least), -np.inf)
            s = np.sort(window(v), axis=-1)
            # a run's length at each of its places; the last of the longest ones ends the run of the largest value
            first = np.concatenate([np.ones((h, n, 1), bool), s[..., 1:] != s[..., :-1]], axis=-1)
            long = np.where(np.isinf(s), -1, np.arange(w * w) - np.maximum.accumulate(np.where(first, np.arange(w * w), 0), axis=-1))
            best = w * w - 1 - long[..., ::-1].argmax(-1)
            made.append(np.take_along_axis(s, best[..., None], axis=-1)[..., 0])
        made = np.stack(made, axis=-1)
        return np.where(made == least, np.nan, made)

    found = tiled(cells, run, r, ["r", "g", "b"], "shrink")
    return found.select(*KEY, *(_back(c, cells) for c in "rgb"))


def gauss_weights(sigma: float, radius: int) -> list[float]:
    w = [math.exp(-i * i / (2 * sigma * sigma)) for i in range(-radius, radius + 1)]
    return [v / sum(w) for v in w]


def gaussian_blur(planes: DataFrame, sigma: float, radius: int, columns: tuple[str, ...] = ("v",)) -> DataFrame:
    """Two passes of one-dimensional pushes, borders repeated."""
    w = gauss_weights(sigma, radius)
    one = pushed(planes.select(*KEY, *columns), [(0, i - radius, w[i]) for i in range(len(w))], "clamp", ("k",))
    # the widening copies rows as well; only true rows remain after the push
    step = one.groupBy(*KEY).agg(*(F.sum(F.col(c) * F.col("k")).alias(c) for c in columns))
    two = pushed(step, [(i - radius, 0, w[i]) for i in range(len(w))], "clamp", ("k",))
    return two.groupBy(*KEY).agg(*(F.sum(F.col(c) * F.col("k")).alias(c) for c in columns))


def structure_tensor(planes: DataFrame, sigma: float = 1.0, radius: int = 2) -> DataFrame:
    """l1 >= l2 and the direction (ex, ey) of the smaller one's eigenvector; zero where there is none."""
    g = gradient(planes).select(*KEY, (F.col("gx") * F.col("gx")).alias("A"), (F.col("gy") * F.col("gy")).alias("B"), (F.col("gx") * F.col("gy")).alias("C"))
    t = gaussian_blur(g, sigma, radius, ("A", "B", "C"))
    root = F.sqrt(F.pow(F.col("A") - F.col("B"), 2) + 4 * F.col("C") * F.col("C"))
    step = t.select(*KEY, "A", "B", "C", root.alias("q"))
    ex, ey = 2 * F.col("C"), F.col("B") - F.col("A") - F.col("q")
    size = F.sqrt(ex * ex + ey * ey)
    norm = lambda v: F.when(size < 1e-9, 0.0).otherwise(v / size)
    return step.select(*KEY, ((F.col("A") + F.col("B") + F.col("q")) / 2).alias("l1"), ((F.col("A") + F.col("B") - F.col("q")) / 2).alias("l2"), norm(ex).alias("ex"), norm(ey).alias("ey"))


def pyramid(planes: DataFrame, levels: int) -> list[DataFrame]:
    """Laplacian levels (cell less its parent's mean) and, last, the smallest mean; their sum gives the image back."""
    out, now = [], planes.select(*KEY, F.col("v").cast("double").alias("v"))
    for _ in range(levels):
        mean = now.groupBy("image_id", F.floor(F.col("y") / 2).alias("y"), F.floor(F.col("x") / 2).alias("x")).agg(F.avg("v").alias("v"))
        parent = mean.select("image_id", F.col("y").alias("py"), F.col("x").alias("px"), F.col("v").alias("p"))
        child = now.select(*KEY, "v", F.floor(F.col("y") / 2).alias("py"), F.floor(F.col("x") / 2).alias("px"))
        out.append(child.join(parent, ["image_id", "py", "px"]).select(*KEY, (F.col("v") - F.col("p")).alias("v")))
        now = mean
    return [*out, now]


def reconstruct(levels: list[DataFrame]) -> DataFrame:
    now = levels[-1]
    for diff in reversed(levels[:-1]):
        parent = now.select("image_id", F.col("y").alias("py"), F.col("x").alias("px"), F.col("v").alias("p"))
        child = diff.select(*KEY, "v", F.floor(F.col("y") / 2).alias("py"), F.floor(F.col("x") / 2).alias("px"))
        now = child.join(parent, ["image_id", "py", "px"]).select(*KEY, (F.col("v") + F.col("p")).alias("v"))
    return now


def error_diffusion(planes: DataFrame, threshold: int = 128, columns: tuple[str, ...] = ("v",)) -> DataFrame:
    """Halftone of each row and column on its own: 7/16 of a cell's error goes to the right. Rows in parallel, a column of many rows at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells, size = batch.column(2).flatten(), batch.column(2).value_lengths().to_numpy(zero_copy_only=False)
            if not len(cells):
                continue
            row, nth = np.repeat(np.arange(len(size)), size), np.arange(len(cells)) - np.repeat(np.cumsum(size) - size, size)
            v = np.zeros((len(size), size.max(), len(columns)))
            for k in range(len(columns)):
                v[row, nth, k] = cells.field(k + 1).to_numpy(zero_copy_only=False)
            error, got = np.zeros((len(size), len(columns))), np.zeros(v.shape, dtype=np.int32)
            for i in range(v.shape[1]):
                want = v[:, i] + error
                got[:, i] = np.where(want >= threshold, 255, 0)
                error = (want - got[:, i]) * 7 / 16
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), cells.field(0), *(pa.array(got[row, nth, k]) for k in range(len(columns)))], [*KEY, *columns])

    rows = planes.groupBy("image_id", "y").agg(F.sort_array(F.collect_list(F.struct("x", *columns))).alias("row"))
    return rows.mapInArrow(run, "image_id long, y long, x long, " + ", ".join(f"{c} int" for c in columns))


def dct_basis(n: int) -> list[list[float]]:
    return [[(math.sqrt(1 / n) if k == 0 else math.sqrt(2 / n)) * math.cos(math.pi * (2 * i + 1) * k / (2 * n)) for i in range(n)] for k in range(n)]


def dct_blocks(planes: DataFrame, n: int, inverse: bool = False) -> DataFrame:
    """The cosine transform of every n x n block: y and x inside a block become frequencies (and back). Cells that a block lacks count as 0.

    A cell travels once, to its block; blocks lie in tasks one after the other, and all those of a batch are transformed together.
    """
    basis = np.array(dct_basis(n))
    d = basis.T if inverse else basis

    def places(rows: pa.RecordBatch) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """(whether the image is null, image, y and x of the block), (y, x) of each cell."""
        image, y, x = (rows.column(k) for k in KEY)
        y, x = (c.to_numpy(zero_copy_only=False) for c in (y, x))
        return [image.is_null().to_numpy(zero_copy_only=False), image.fill_null(0).to_numpy(zero_copy_only=False), y // n, x // n], [y, x]

    def made(rows: pa.RecordBatch) -> pa.RecordBatch:
        keys, (gy, gx) = places(rows)
        new = np.ones(len(gy), dtype=bool)
        new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
        first, block = np.flatnonzero(new), np.cumsum(new) - 1
        known = rows.column(3).is_valid().to_numpy(zero_copy_only=False)
        v = np.where(known, rows.column(3).fill_null(0.0).to_numpy(zero_copy_only=False), 0.0)
        cells = np.bincount((block * n + gy % n) * n + gx % n, v, len(first) * n * n).reshape(-1, n, n)
        out = d @ cells @ d.T
        # a block without any value has none afterwards
        none = np.repeat(np.bincount(block, known, len(first)) == 0, n * n)
        at = np.arange(n * n)
        null, image, y, x = (k[first] for k in keys)
        parts = [pa.array(np.repeat(image, n * n), mask=np.repeat(null, n * n)), pa.array((y[:, None] * n + at // n).ravel()), pa.array((x[:, None] * n + at % n).ravel())]
        return pa.RecordBatch.from_arrays([*parts, pa.array(out.ravel(), mask=none)], [*KEY, "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            batch = batch if held is None else pa.concat_batches([held, batch])
            if not batch.num_rows:
                continue
            # the last block may go on in the next batch
            stop = int(np.argmax(np.all([k == k[-1] for k in places(batch)[0]], axis=0)))
            if stop:
                yield made(batch.slice(0, stop))
            held = batch.slice(stop)
        if held is not None and held.num_rows:
            yield made(held)

    block = ["image_id", *(F.floor(F.col(c) / n) for c in ("y", "x"))]
    cells = planes.select(*(F.col(k).cast("long").alias(k) for k in KEY), F.col("v").cast("double").alias("v")).where("y is not null and x is not null")
    return cells.repartition(*block).sortWithinPartitions(*block).mapInArrow(run, "image_id long, y long, x long, v double")


def with_luma(cells: DataFrame) -> DataFrame:
    return cells.select(*KEY, luma().alias("v"))
