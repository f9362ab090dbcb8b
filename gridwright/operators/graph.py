"""Graph and similarity operators: edges between cells, patches and their likeness."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.focal import pushed, tile_arrays, tile_with_halo
from ..plans.iterate import saved
from ..sources.cells import KEY


def half_window(radius: int) -> list[tuple[int, int]]:
    """Offsets of the right half of a window: x+1.. for rows up to y, x.. below, so that no pair comes twice."""
    return [(dy, dx) for dy in range(-radius, radius + 1) for dx in range(0 if dy > 0 else 1, radius + 1)]


def cocircular_edges(tensor: DataFrame, radius: int, cone: float, circ: float) -> DataFrame:
    """image_id, y, x, y2, x2: pairs whose orientations (ex, ey) pass the cone and co-circularity tests; angles in degrees."""
    offsets = [(dy, dx, dx / math.hypot(dy, dx), dy / math.hypot(dy, dx)) for dy, dx in half_window(radius)]
    near = pushed(tensor.select(*KEY, "ex", "ey"), offsets, "shrink", ("ux", "uy"))
    near = near.select(*KEY, "dy", "dx", "ux", "uy", F.col("ex").alias("fx"), F.col("ey").alias("fy")).join(tensor.select(*KEY, "ex", "ey"), KEY)
    along = F.col("ex") * F.col("ux") + F.col("ey") * F.col("uy")
    mirrored = (2 * along * F.col("ux") - F.col("ex")) * F.col("fx") + (2 * along * F.col("uy") - F.col("ey")) * F.col("fy")
    keep = (F.round(F.abs(along), 6) >= round(math.cos(math.radians(cone)), 6)) & (F.round(F.abs(mirrored), 6) >= round(math.cos(math.radians(circ)), 6))
    return near.where(keep).select(*KEY, (F.col("y") + F.col("dy")).alias("y2"), (F.col("x") + F.col("dx")).alias("x2"))


def grid_edges(planes: DataFrame, tol: int) -> DataFrame:
    """image_id, src, dst of right and lower neighbours whose values differ by at most tol; nodes are y * 2^31 + x."""
    away = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in ((0, 1), (1, 0))]))
    asks = planes.select(*KEY, F.col("v").alias("nv"), away.alias("o")).select("image_id", (F.col("y") - F.col("o.dy")).alias("y"), (F.col("x") - F.col("o.dx")).alias("x"), "nv", "o.dy", "o.dx")
    # places beyond the image meet no cell
    near = asks.join(planes.select(*KEY, "v"), KEY)
    node = lambda y, x: y * F.lit(1 << 31) + x
    return near.where(F.abs(F.col("nv") - F.col("v")) <= tol).select("image_id", node(F.col("y"), F.col("x")).alias("src"), node(F.col("y") + F.col("dy"), F.col("x") + F.col("dx")).alias("dst"))


def _both_ways(edges: DataFrame) -> DataFrame:
    return saved(edges.select("image_id", "src", "dst").union(edges.select("image_id", F.col("dst").alias("src"), F.col("src").alias("dst"))))


def _spread(values: DataFrame, both: DataFrame, least: bool, rounds: int) -> DataFrame:
    """Each round a node takes the least (or largest) of itself and its neighbours, all at once; stops when nothing changes. values and both, the edges in both directions, are stored."""
    agg, now = F.min if least else F.max, values
    for i in range(rounds):
        came = both.join(now.withColumnRenamed("node", "src"), ["image_id", "src"]).select("image_id", F.col("dst").alias("node"), "v", F.lit(False).alias("own"))
        # edges may lead to places that are no nodes
        after = saved(now.withColumn("own", F.lit(True)).unionByName(came).groupBy("image_id", "node").agg(agg("v").alias("v"), F.max("own").alias("own")).where("own").drop("own"))
        if i + 1 < rounds and not after.join(now, ["image_id", "node", "v"], "left_anti").head(1):
            return after
        now = after
    return now


def luma_weights(planes: DataFrame, tol: int = 255) -> DataFrame:
    """image_id, src, dst, w: grid_edges() with a weight from 0 to 1 that falls with the difference of their values."""
    values = planes.select("image_id", (F.col("y") * F.lit(1 << 31) + F.col("x")).alias("node"), "v")
    ends = grid_edges(planes, tol)
    for end, name in (("src", "a"), ("dst", "b")):
        ends = ends.join(values.select("image_id", F.col("node").alias(end), F.col("v").alias(name)), ["image_id", end])
    return ends.select("image_id", "src", "dst", (1 - F.abs(F.col("a") - F.col("b")) / 256.0).alias("w"))


def _max_plus(values: DataFrame, edges: DataFrame, norm: float, rounds: int | None, sign: int) -> DataFrame:
    """Rounds in max-plus algebra (sign 1) or min-plus (-1): along an edge of weight w a value changes by sign * norm * log(w), and a node keeps
    the largest (least) of its own and what comes to it. All nodes change at once.

    Without rounds it goes on until nothing changes, which needs weights of at most 1; weights that are null or not positive lead nowhere.
    """
    both = edges.where("w > 0").select("image_id", "src", "dst", (F.log("w") * (sign * norm)).alias("step"))
    both = saved(both.union(both.select("image_id", F.col("dst").alias("src"), F.col("src").alias("dst"), "step")))
    if rounds is None and both.where(F.col("step") * sign > 0).head(1):
        raise ValueError("with weights over 1 values never settle: say how many rounds")
    agg, pick = (F.max, F.greatest) if sign > 0 else (F.min, F.least)
    now, done = saved(values.select("image_id", "node", F.col("v").cast("double").alias("v"))), 0
    moved = now  # only what changed in the last round can change its neighbours in the next
    while rounds is None or done < rounds:
        came = both.join(moved.select("image_id", F.col("node").alias("src"), "v"), ["image_id", "src"]).groupBy("image_id", F.col("dst").alias("node")).agg(agg(F.col("v") + F.col("step")).alias("nv"))
        after = saved(now.join(came, ["image_id", "node"], "left").select("image_id", "node", pick("v", F.coalesce("nv", "v")).alias("v"), F.col("v").alias("old")))
        moved = after.where("v <> old").select("image_id", "node", "v")
        now, done = after.select("image_id", "node", "v"), done + 1
        if not moved.head(1):
            break
    return now


def weighted_erode(values: DataFrame, edges: DataFrame, norm: float, rounds: int | None = 1) -> DataFrame:
    """Each node's least of its value and its neighbours' values less norm * log(w). edges: image_id, src, dst, w. rounds None: to the fixed point."""
    return _max_plus(values, edges, norm, rounds, -1)


def weighted_dilate(values: DataFrame, edges: DataFrame, norm: float, rounds: int | None = 1) -> DataFrame:
    """Each node's largest of its value and its neighbours' values plus norm * log(w)."""
    return _max_plus(values, edges, norm, rounds, 1)


def graph_erode(values: DataFrame, edges: DataFrame, rounds: int = 1) -> DataFrame:
    return _in_turn(values, edges, [(True, rounds)])


def graph_dilate(values: DataFrame, edges: DataFrame, rounds: int = 1) -> DataFrame:
    return _in_turn(values, edges, [(False, rounds)])


def _in_turn(values: DataFrame, edges: DataFrame, steps: list[tuple[bool, int]]) -> DataFrame:
    """Erosions (True) and dilations of so many rounds one after the other, over edges that are stored once."""
    both, values = _both_ways(edges), saved(values.select("image_id", "node", "v"))
    for least, rounds in steps:
        values = _spread(values, both, least, rounds)
    return values


def graph_open(values: DataFrame, edges: DataFrame, n: int = 1) -> DataFrame:
    return _in_turn(values, edges, [(True, n), (False, n)])


def graph_close(values: DataFrame, edges: DataFrame, n: int = 1) -> DataFrame:
    return _in_turn(values, edges, [(False, n), (True, n)])


def graph_asf(values: DataFrame, edges: DataFrame, n: int) -> DataFrame:
    """Alternating filter: close then open, with growing size."""
    return _in_turn(values, edges, [(least, k) for k in range(1, n + 1) for least in (False, True, True, False)])


def extract_patches(planes: DataFrame, p: int = 4, stride: int = 1) -> DataFrame:
    """image_id, py, px, vec: the p x p cells from each stride-th corner on, row by row."""
    offsets = [(dy, dx) for dy in range(p) for dx in range(p)]
    near = pushed(planes.select(*KEY, "v"), offsets, "shrink")
    if stride > 1:
        near = near.where((F.pmod("y", F.lit(stride)) == 0) & (F.pmod("x", F.lit(stride)) == 0))
    grouped = near.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("dy", "dx", "v"))).alias("all"))
    whole = grouped.where(F.size("all") == p * p)
    return whole.select("image_id", F.col("y").alias("py"), F.col("x").alias("px"), F.transform("all", lambda s: s["v"]).alias("vec"))


def patch_distances(block: np.ndarray, y: np.ndarray, x: np.ndarray, radius: int, p: int) -> np.ndarray:
    """(patches, (2 radius + 1)^2) squared distances of the tile's patches at y, x to those around them, infinite where one leaves the image.

    block: radius + p - 1 cells more on each side than the tile, the last channel 1 inside the image. The distances are |a|^2 + |b|^2 - 2 ab: one matrix
    product of the patches asked for with all patches of the block. Whole numbers stay exact.
    """
    halo, wide = radius + p - 1, 2 * radius + 1
    views = np.lib.stride_tricks.sliding_window_view(block, (p, p), axis=(0, 1))
    side = views.shape[1]
    inside = views[:, :, -1].reshape(-1, p * p).all(axis=1)
    every = np.ascontiguousarray(views[:, :, :-1]).reshape(len(inside), -1)
    size = np.einsum("ij,ij->i", every, every)
    own = (y + halo) * side + x + halo
    around = own[:, None] + ((np.arange(wide) - radius)[:, None] * side + np.arange(wide) - radius).ravel()
    out = np.empty((len(own), wide * wide))
    for lo in range(0, len(own), 256):
        at, near = own[lo : lo + 256], around[lo : lo + 256]
        product = every[at] @ every.T
        found = size[at][:, None] + size[near] - 2 * np.take_along_axis(product, near, axis=1)
        out[lo : lo + 256] = np.where(inside[near] & inside[at][:, None], np.maximum(found, 0), np.inf)
    middle = wide * wide // 2
    out[:, middle] = np.where(np.isfinite(out[:, middle]), 0, np.inf)
    return out


def ranked_matches(d: np.ndarray, k: int, tau: float, rank: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, nth) for rows of distances: the patch itself first, up to max(tau, the rank-th distance), at most k; ties by place.

    The rank-th distance comes from a partial selection, and only what it keeps is sorted.
    """
    least = np.partition(d, min(rank, d.shape[1]) - 1, axis=1)[:, :rank]
    limit = np.where(np.isfinite(least), least, 0).max(1)
    row, place = np.nonzero(np.isfinite(d) & (d <= np.maximum(limit, tau)[:, None]))
    order = np.lexsort((np.where(place == d.shape[1] // 2, -1, d[row, place]), row))
    row, place = row[order], place[order]
    nth = np.arange(len(row)) - np.searchsorted(row, row)
    kept = nth < k
    return row[kept], place[kept], nth[kept]


def patch_tiles(planes: DataFrame, columns: tuple[str, ...], radius: int, p: int, size: int) -> DataFrame:
    """Tiles with all that their patches are compared with."""
    return tile_with_halo(planes.select(*KEY, *columns), size, radius + p - 1, "zero", ordered=False)


def patch_block(ty: int, tx: int, y: np.ndarray, x: np.ndarray, v: np.ndarray, size: int, halo: int) -> np.ndarray:
    block = np.zeros((size + 2 * halo, size + 2 * halo, v.shape[1] + 1))
    block[y - ty * size + halo, x - tx * size + halo] = np.concatenate([v, np.ones((len(v), 1))], axis=1)
    return block


def block_match(planes: DataFrame, radius: int = 8, k: int = 512, tau: float = 0.0, rank: int = 32, step: int = 1, p: int = 4, columns: tuple[str, ...] = ("v",), size: int = 32) -> DataFrame:
    """image_id, py, px, my, mx, d, rank: p x p patches within +-radius, itself first, up to max(tau, the rank-th distance), at most k.

    One shuffle to haloed tiles: a tile's patches and all they are compared with lie in one array. Ties go by place.
    """
    halo, wide = radius + p - 1, 2 * radius + 1
    names = ["image_id", "py", "px", "my", "mx", "d", "rank"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for image, ty, tx, y, x, v in tile_arrays(batch, list(columns)):
                gy, gx = np.nonzero(((np.arange(size) + ty * size) % step == 0)[:, None] & ((np.arange(size) + tx * size) % step == 0))
                d = patch_distances(patch_block(ty, tx, y, x, v, size, halo), gy, gx, radius, p)
                at, pick, nth = ranked_matches(d, k, tau, rank)
                py, px = gy[at] + ty * size, gx[at] + tx * size
                parts = [np.full(len(at), image), py, px, py + pick // wide - radius, px + pick % wide - radius, d[at, pick], (nth + 1).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in parts], names)

    return patch_tiles(planes, columns, radius, p, size).mapInArrow(run, "image_id long, py long, px long, my long, mx long, d double, rank int")


def aggregate_patches(patches: DataFrame, p: int = 4) -> DataFrame:
    """image_id, y, x, v: overlapping patch values averaged."""
    flat = patches.select("image_id", "py", "px", F.posexplode("vec").alias("i", "v"))
    return flat.groupBy("image_id", (F.col("py") + F.floor(F.col("i") / p)).alias("y"), (F.col("px") + F.col("i") % p).alias("x")).agg(F.avg("v").alias("v"))
