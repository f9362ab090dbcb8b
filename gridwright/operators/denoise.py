"""Patch denoising: a noise profile from self-similar blocks, and Bayesian shrinkage of groups of similar patches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.focal import tile_arrays, tile_with_halo
from ..plans.iterate import saved
from ..sources.cells import KEY
from .focal import dct_basis
from .graph import patch_block, patch_distances, patch_tiles, ranked_matches

#: From a median absolute deviation to a standard deviation, as this estimator is calibrated (fixed value).
MAD_TO_STD = 1.791106
CELLS_A_BIN, MOST_BINS, MOST_BLOCKS = 42_000, 64, 4000


def _weights(a: np.ndarray) -> np.ndarray:
    """Sizes of coefficients; digits beyond the ninth are rounding."""
    return np.round(np.abs(a), 9)


def sparse_distance(a: np.ndarray, b: np.ndarray, x: np.ndarray | None = None, y: np.ndarray | None = None) -> np.ndarray:
    """Differences weighted by the larger coefficient, the four largest differences left out (of equal ones those of larger weight); over the last axis.

    x, y: the weights of a and b, where they are known.
    """
    d, w = _weights(a - b), np.maximum(_weights(a) if x is None else x, _weights(b) if y is None else y)
    # the twelfth least difference bounds what counts
    kept = (d <= np.partition(d, 11, axis=-1)[..., 11:12]).astype(float)
    one = np.ones(kept.shape[-1])
    out, tied = np.asarray((d * w * kept) @ one), kept @ one > 12
    if tied.any():
        # complex numbers are ordered by difference, then weight
        least = np.partition(d[tied] + 1j * w[tied], 11, axis=-1)[..., :12]
        out[tied] = (least.real * least.imag).sum(-1)
    return out


def self_similar(planes: DataFrame, near: int = 4, far: int = 13, size: int = 32, best: tuple[DataFrame, float] | None = None, measured: bool = True) -> DataFrame:
    """image_id, py, px, f, mean, d: 4 x 4 blocks, their frequencies, and the least distance to a block near..far away on both axes.

    A radius of 16 is for haloed tiles: a tile's blocks and all they are compared with lie in one array.
    Flat corners mark artificial blocks, which are left out. best: (image_id, h, w, bins, lo, hi; a share). Then bin and blocks follow, and a tile sends
    of each bin only what can be among the image's best share, the first row of them with the number of all blocks that they were chosen from.
    Without `measured` d is 0.
    """
    d = np.array(dct_basis(4))
    sizes, share = best or (None, None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for nth, (image, ty, tx, gy, gx, values) in enumerate(tile_arrays(batch, ["v"])):
                y0, x0 = gy.min(), gx.min()
                grid = np.zeros((gy.max() - y0 + 1, gx.max() - x0 + 1))
                grid[gy - y0, gx - x0] = values[:, 0]
                if min(grid.shape) < 4:
                    continue
                view = np.lib.stride_tricks.sliding_window_view(grid, (4, 4))
                f = np.einsum("ki,yxij,mj->yxkm", d, view, d).reshape(*view.shape[:2], 16)
                v = view.reshape(*view.shape[:2], 16)
                good = ~((np.abs(v[..., 0] - v[..., 1]) < 0.001) & (np.abs(v[..., 1] - v[..., 4]) < 0.001) & (np.abs(v[..., 4] - v[..., 5]) < 0.001))
                h, w = good.shape
                ys, xs = np.arange(h) + y0, np.arange(w) + x0
                oy, ox = np.flatnonzero(ys // size == ty), np.flatnonzero(xs // size == tx)
                if not len(oy) or not len(ox):
                    continue
                top, left = oy[0], ox[0]
                own, weights = f[top : top + len(oy), left : left + len(ox)], _weights(f)
                own_weights = weights[top : top + len(oy), left : left + len(ox)]
                least = np.full(own.shape[:2], np.inf)
                for dy in range(near, far + 1):
                    for dx in range(near, far + 1):
                        there = (slice(top + dy, top + dy + len(oy)), slice(left + dx, left + dx + len(ox)))
                        other = f[there]
                        n, m = other.shape[:2]
                        if n and m:
                            found = np.where(good[there], sparse_distance(own[:n, :m], other, own_weights[:n, :m], weights[there]) if measured else 0.0, np.inf)
                            least[:n, :m] = np.minimum(least[:n, :m], found)
                keep = good[top : top + len(oy), left : left + len(ox)] & np.isfinite(least)
                i, j = np.nonzero(keep)
                py, px, mean, dist, more = ys[oy][i], xs[ox][j], own[i, j, 0] / 4, least[i, j].round(6), []
                if share is not None:
                    rows, cols, bins, lo, hi = (batch.column(4 + k)[nth].as_py() for k in range(5))
                    which = np.clip(np.floor((mean - lo) / max(hi - lo, 1e-9) * bins), 0, bins - 1).astype(np.int64)
                    order = np.lexsort((px, py, dist, which))
                    bounds = np.searchsorted(which[order], np.arange(bins + 1))
                    rank, many = np.arange(len(order)) - bounds[which[order]], np.diff(bounds)[which[order]]
                    # an image's bin has no more blocks than the image has cells
                    sent = rank < min(max(int(rows * cols * share), 1), MOST_BLOCKS)
                    at = order[sent]
                    i, j, py, px, mean, dist, more = i[at], j[at], py[at], px[at], mean[at], dist[at], [which[at], np.where(rank == 0, many, 0)[sent]]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(i) + 1) * 16, pa.int32()), pa.array(own[i, j].reshape(-1)))
                parts = [pa.array(np.full(len(i), image)), pa.array(py), pa.array(px), lists, pa.array(mean), pa.array(dist), *(pa.array(m) for m in more)]
                yield pa.RecordBatch.from_arrays(parts, ["image_id", "py", "px", "f", "mean", "d", *(["bin", "blocks"] if more else [])])

    tiles = tile_with_halo(planes.select(*KEY, "v"), size, far + 3, "shrink", ordered=False, about=sizes)
    return tiles.mapInArrow(run, "image_id long, py long, px long, f array<double>, mean double, d double" + (", bin long, blocks long" if share is not None else ""))


def noise_profile(planes: DataFrame, share: float = 0.005, near: int = 4, far: int = 13) -> DataFrame:
    """image_id, bin, level, k, std: noise of 16 frequencies at each intensity, from the most self-similar blocks.

    A bin has CELLS_A_BIN cells, and an image at most MOST_BINS of them; of a bin the best share counts, one block at least and MOST_BLOCKS at most. These
    bounds belong to the estimator, which is calibrated for them. Blocks are neither stored nor shuffled: a tile sends those that can be among the best.
    """
    bins = F.least(F.greatest(F.floor(F.count("*") / CELLS_A_BIN), F.lit(1)), F.lit(MOST_BINS))
    size = saved(planes.groupBy("image_id").agg((F.max("y") + 1).cast("long").alias("h"), (F.max("x") + 1).cast("long").alias("w"), bins.alias("bins")))
    # a single bin needs no borders
    one, more = size.where("bins = 1").withColumns({"lo": F.lit(0.0), "hi": F.lit(0.0)}), size.where("bins > 1")
    if more.head(1):
        blocks = self_similar(planes.join(more.select("image_id"), "image_id", "left_semi"), near, far, measured=False)
        span = blocks.groupBy("image_id").agg(F.min("mean").alias("lo"), F.max("mean").alias("hi"))
        one = saved(one.unionByName(more.join(span, "image_id")))
    blocks = self_similar(planes, near, far, best=(one, share))
    group = W.partitionBy("image_id", "bin")
    counts = F.least(F.greatest(F.floor(F.sum("blocks").over(group) * share), F.lit(1)), F.lit(MOST_BLOCKS))
    rank = F.row_number().over(group.orderBy("d", "py", "px"))
    best = saved(blocks.withColumns({"rank": rank, "keep": counts}).where(F.col("rank") <= F.col("keep")).select("image_id", "bin", "mean", "f"))
    flat_rows = best.select("image_id", "bin", "mean", F.posexplode("f").alias("k", "v"))
    middle = flat_rows.groupBy("image_id", "bin", "k").agg(F.median("v").alias("m"), F.avg("mean").alias("level"))
    mad = flat_rows.join(middle, ["image_id", "bin", "k"]).groupBy("image_id", "bin", "level", "k").agg((F.median(F.abs(F.col("v") - F.col("m"))) * MAD_TO_STD).alias("raw"))
    smooth = W.partitionBy("image_id", "k").orderBy("bin").rowsBetween(-1, 1)
    return mad.select("image_id", "bin", "level", "k", F.avg("raw").over(smooth).alias("std"))


def noise_covariance(profile: DataFrame) -> DataFrame:
    """image_id, bin, i, j, cov: the patch covariance that independent frequencies of these deviations make."""
    d = dct_basis(4)
    basis = [[d[k // 4][i // 4] * d[k % 4][i % 4] for i in range(16)] for k in range(16)]
    rows = F.array(*[F.array(*[F.lit(v) for v in r]) for r in basis])
    one = profile.select("image_id", "bin", (F.col("std") * F.col("std")).alias("var"), rows[F.col("k")].alias("row"))
    sent = one.select("image_id", "bin", "var", "row", F.posexplode("row").alias("i", "di")).select("image_id", "bin", "var", "i", "di", F.posexplode("row").alias("j", "dj"))
    return sent.groupBy("image_id", "bin", "i", "j").agg(F.sum(F.col("var") * F.col("di") * F.col("dj")).alias("cov"))


def noise_levels(profile: DataFrame, top: int = 255) -> DataFrame:
    """image_id, k, level (0..top), std: the profile at every whole intensity, between the known ones by a line.

    The known levels of an image and frequency, MOST_BINS at most, lie in one row; rows are dealt to tasks before they become levels.
    """
    rows = profile.groupBy("image_id", "k").agg(F.sort_array(F.collect_list(F.struct(F.col("level").alias("x"), F.col("std").alias("v")))).alias("known"))
    rows = rows.repartition(int(profile.sparkSession.conf.get("spark.sql.shuffle.partitions")), "image_id", "k")
    at = rows.select("image_id", "k", "known", F.explode(F.sequence(F.lit(0), F.lit(top))).alias("level"))
    below, above = F.filter("known", lambda s: s["x"] <= F.col("level")), F.filter("known", lambda s: s["x"] >= F.col("level"))
    # beyond the known levels the nearest
    left, right = F.coalesce(F.try_element_at(below, F.lit(-1)), F.get("known", F.lit(0))), F.coalesce(F.get(above, F.lit(0)), F.try_element_at("known", F.lit(-1)))
    ends = at.select("image_id", "k", "level", left.alias("l"), right.alias("r"))
    width = F.col("r.x") - F.col("l.x")
    return ends.select("image_id", "k", "level", F.when(width == 0, F.col("l.v")).otherwise(F.col("l.v") + (F.col("r.v") - F.col("l.v")) * (F.col("level") - F.col("l.x")) / width).alias("std"))


#: Squared distances up to which patches count as alike in the two passes, before the noise multiplier.
ALIKE = (48.0, 144.0)
LEAST_GROUP = 16


def _basis() -> np.ndarray:
    d = np.array(dct_basis(4))
    return np.array([[d[k // 4, i // 4] * d[k % 4, i % 4] for i in range(16)] for k in range(16)])


#: What is added to the diagonal of a covariance, and the least pivot of a matrix that counts as positive.
RIDGE, PIVOT = 1e-3, 1e-4


def factor_solve(a: np.ndarray, b: np.ndarray, block: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """(x with a x = b, whether a is positive) for symmetric matrices a (matrices, n, n), by Cholesky factors of all at once.

    The matrices are the last axis inside, so that each of the n steps is one operation on a block of them.
    """
    n, x, good = a.shape[-1], np.empty(b.shape), np.ones(len(a), dtype=bool)
    for lo in range(0, len(a), block):
        f, y = (np.ascontiguousarray(np.moveaxis(m[lo : lo + block], 0, -1)) for m in (a, b))
        ok = good[lo : lo + block]
        for j in range(n):
            f[j:, j] -= np.einsum("kib,ib->kb", f[j:, :j], f[j, :j])
            ok &= f[j, j] > PIVOT
            f[j, j] = np.sqrt(np.where(f[j, j] > PIVOT, f[j, j], 1.0))
            f[j + 1 :, j] /= f[j, j]
        for i in range(n):
            y[i] = (y[i] - np.einsum("kb,kmb->mb", f[i, :i], y[:i])) / f[i, i]
        for i in reversed(range(n)):
            y[i] = (y[i] - np.einsum("kb,kmb->mb", f[i + 1 :, i], y[i + 1 :])) / f[i, i]
        x[lo : lo + block] = np.moveaxis(y, -1, 0)
    return x, good


def _centred(noisy: np.ndarray, basic: np.ndarray | None, there: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, noisy less mean, covariance of the first estimate or else of the noisy ones about that mean) of each group."""
    mask, n = there[:, None, :, None], there.sum(1)[:, None, None, None]
    # full groups need no mask
    only = (lambda v: v) if there.all() else (lambda v: v * mask)
    mean = only(noisy).sum(2, keepdims=True) / n
    rest = only(noisy - mean)
    of = rest if basic is None else only(basic - mean)
    return mean, rest, of.swapaxes(2, 3) @ of / (n - 1)


def shrunk(noisy: np.ndarray, basic: np.ndarray | None, there: np.ndarray, noise: np.ndarray) -> np.ndarray:
    """Groups of patches moved to their means by S (S + N)^-1, S being C - N without its negative part; with a first estimate, by its covariance B (B + N)^-1.

    noisy, basic: group, channel, member, 16; there: which members a group has; noise: group, channel, 16, 16. This takes eigenvalues
    of every group, and does not add to the noise where a group is small.
    """
    mean, rest, signal = _centred(noisy, basic, there)
    if basic is None:
        w, v = np.linalg.eigh(signal - noise)
        # negative energy is no signal
        signal = (v * np.maximum(w, 0)[..., None, :]) @ v.swapaxes(2, 3)
    gain = np.linalg.solve(signal + noise + 1e-3 * np.eye(noise.shape[-1]), signal)
    return mean + rest @ gain


def shrunk_by_difference(noisy: np.ndarray, basic: np.ndarray | None, there: np.ndarray, noise: np.ndarray) -> np.ndarray:
    """The same by (C - N) C^-1 as it stands, and B (B + N)^-1, through Cholesky factors.

    A negative variance is no signal: the
    diagonal of C - N is cut off at 0, and a group whose C - N has no trace becomes its mean. A group whose matrix is not positive stays as it is.
    """
    mean, rest, c = _centred(noisy, basic, there)
    k = noise.shape[-1]
    diagonal = np.arange(k)
    if basic is None:
        signal, total = c - noise, c.copy()
        empty = np.trace(signal, axis1=2, axis2=3) <= 0
        signal[..., diagonal, diagonal] = np.maximum(signal[..., diagonal, diagonal], 0)
        signal[empty] = 0
    else:
        signal, total = c, c + noise
    total[..., diagonal, diagonal] += RIDGE
    # S = signal total^-1, and rows are patches: rest S^T = rest (total^-1 signal)
    gain, good = factor_solve(total.reshape(-1, k, k), signal.reshape(-1, k, k))
    gain, good = gain.reshape(c.shape), good.reshape(c.shape[:2])
    made = mean + rest @ gain
    kept = good if basic is not None else good | empty
    return made if kept.all() else np.where(kept[..., None, None], made, noisy if basic is None else basic)


def tile_estimates(block: np.ndarray, gy: np.ndarray, gx: np.ndarray, n: int, known: list[np.ndarray], mult: float, k: int, radius: int, pilot: bool, rule: Callable = shrunk_by_difference) -> tuple[np.ndarray, np.ndarray]:
    """(sums of the estimates of n channels, their number) of a block's cells, from the groups of the patches at gy, gx.

    block: n noisy channels, n of a first estimate if there is one, and 1 inside the image. known: levels, then stds, of each channel.
    """
    halo, wide, basis = radius + 3, 2 * radius + 1, _basis()
    d = patch_distances(block[..., [*range(n, 2 * n), 2 * n]] if pilot else block, gy, gx, radius, 4)
    row, place, nth = ranked_matches(d, k, ALIKE[pilot] * mult, 32)
    many = np.bincount(row, minlength=len(gy))
    enough = many >= LEAST_GROUP
    total, weight = np.zeros((*block.shape[:2], n)), np.zeros(block.shape[:2])
    if not enough.any():
        return total, weight
    there = np.arange(many.max()) < many[enough][:, None]
    py, px = gy[enough][:, None] + halo, gx[enough][:, None] + halo
    own = enough[row]
    picks = np.full(there.shape, wide * wide // 2)
    picks[(np.cumsum(enough) - 1)[row[own]], nth[own]] = place[own]
    my, mx = py + picks // wide - radius, px + picks % wide - radius
    patches = np.lib.stride_tricks.sliding_window_view(block[..., :-1], (4, 4), axis=(0, 1))
    rows = np.moveaxis(patches[my, mx].reshape(*my.shape, -1, 16), 2, 1)
    level = (rows[:, :n] * there[:, None, :, None]).sum((2, 3)) / (16 * there.sum(1)[:, None])
    std = np.stack([np.stack([np.interp(level[:, c], known[c], known[n + c][:, f]) for f in range(16)], axis=1) for c in range(n)], axis=1)
    noise = basis.T @ ((std**2 * mult)[..., None] * basis)
    made = rule(rows[:, :n], rows[:, n:] if pilot else None, there, noise)
    # all estimates of a cell, by its place in the block
    cell = ((my[..., None] + np.arange(16) // 4) * block.shape[1] + mx[..., None] + np.arange(16) % 4)[there].ravel()
    weight = np.bincount(cell, minlength=weight.size).reshape(weight.shape).astype(float)
    for c in range(n):
        total[..., c] = np.bincount(cell, made[:, c][there].ravel(), minlength=weight.size).reshape(weight.shape)
    return total, weight


def bayes_shrink(planes: DataFrame, columns: tuple[str, ...], table: DataFrame, mult: float = 1.0, step: int = 2, radius: int = 8, k: int = 512, pilot: tuple[str, ...] = (), size: int = 32, rule: Callable = shrunk_by_difference) -> DataFrame:
    """One pass over groups of similar 4 x 4 patches: image_id, y, x and the mean of all estimates of a cell for each column.

    pilot: columns of a first estimate, in which patches are matched and whose covariance then shrinks the noisy ones (the second
    step). table: image_id and for each column levels and stds. A tile matches and shrinks its own patches, and sends sums and
    counts for all cells that they touch; cells in no group keep their value. rule: shrunk_by_difference or shrunk.
    """
    halo, n = radius + 3, len(columns)
    names = ["image_id", "y", "x", *(f"s_{c}" for c in columns), "w"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tables = [[np.array(batch.column(4 + i)[row].as_py(), dtype=float) for i in range(2 * n)] for row in range(len(batch))]
            for known, (image, ty, tx, y, x, v) in zip(tables, tile_arrays(batch, [*columns, *pilot]), strict=True):
                gy, gx = np.nonzero(((np.arange(size) + ty * size) % step == 0)[:, None] & ((np.arange(size) + tx * size) % step == 0))
                block = patch_block(ty, tx, y, x, v, size, halo)
                total, weight = tile_estimates(block, gy, gx, n, known, mult, k, radius, bool(pilot), rule)
                at = np.nonzero(weight)
                parts = [np.full(len(at[0]), image), at[0] + ty * size - halo, at[1] + tx * size - halo, *(total[at][:, c] for c in range(n)), weight[at]]
                yield pa.RecordBatch.from_arrays([pa.array(p) for p in parts], names)

    tiles = patch_tiles(planes, (*columns, *pilot), radius, 4, size).join(table, "image_id")
    tiles = tiles.select("image_id", "ty", "tx", "cells", *(f"levels_{c}" for c in columns), *(f"stds_{c}" for c in columns))
    sums = tiles.mapInArrow(run, "image_id long, y long, x long, " + ", ".join(f"s_{c} double" for c in columns) + ", w double")
    means = sums.groupBy(*KEY).agg(*((F.sum(f"s_{c}") / F.sum("w")).alias(f"m_{c}") for c in columns))
    return planes.select(*KEY, *columns).join(means, KEY, "left").select(*KEY, *(F.coalesce(f"m_{c}", F.col(c).cast("double")).alias(c) for c in columns))


def noise_table(planes: DataFrame, columns: tuple[str, ...], strength: float = 1.0, share: float = 0.005) -> DataFrame:
    """image_id, and for each column levels_c and stds_c: its noise profile as arrays."""
    out = None
    for c in columns:
        profile = noise_profile(planes.select(*KEY, F.col(c).alias("v")), share)
        rows = profile.groupBy("image_id", "bin").agg(F.first("level").alias("level"), F.transform(F.sort_array(F.collect_list(F.struct("k", "std"))), lambda s: s["std"] * strength**0.5).alias("std"))
        bins = rows.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("level", "std"))).alias("t"))
        one = bins.select("image_id", F.transform("t", lambda s: s["level"]).alias(f"levels_{c}"), F.transform("t", lambda s: s["std"]).alias(f"stds_{c}"))
        out = one if out is None else out.join(one, "image_id")
    return out


def _halved(planes: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    return planes.groupBy("image_id", F.floor(F.col("y") / 2).alias("y"), F.floor(F.col("x") / 2).alias("x")).agg(*(F.avg(c).alias(c) for c in columns))


def nl_bayes_denoise(planes: DataFrame, columns: tuple[str, ...] = ("v",), step: int = 2, radius: int = 8, k: int = 512, strength: float = 1.0, scales: int = 3, share: float = 0.005, rule: Callable = shrunk_by_difference) -> DataFrame:
    """image_id, y, x and columns, denoised from coarse to fine.

    The image is halved scales - 1 times. From the smallest on, each scale is denoised in two passes (a first estimate, then the
    second step with that as its pilot) and takes the place of the means that the next finer one was measured from; a mean of four
    cells has a quarter of the noise. An image without a noise profile (under four cells a side) comes back as it is.
    """
    levels = [saved(planes.select(*KEY, *(F.col(c).cast("double").alias(c) for c in columns)))]
    table = saved(noise_table(levels[0], columns, strength, share))
    for _ in range(scales - 1):
        levels.append(saved(_halved(levels[-1], columns)))
    done = None
    for scale in reversed(range(scales)):
        now = levels[scale]
        if done is not None:
            # cells keep their difference from the mean, which now is the denoised one
            parents = [levels[scale + 1].select("image_id", F.col("y").alias("py"), F.col("x").alias("px"), *(F.col(c).alias(f"old_{c}") for c in columns)), done.select("image_id", F.col("y").alias("py"), F.col("x").alias("px"), *(F.col(c).alias(f"new_{c}") for c in columns))]
            place = ["image_id", "py", "px"]
            now = now.withColumns({"py": F.floor(F.col("y") / 2), "px": F.floor(F.col("x") / 2)}).join(parents[0].join(parents[1], place), place).select(*KEY, *((F.col(c) - F.col(f"old_{c}") + F.col(f"new_{c}")).alias(c) for c in columns))
            now = saved(now)
        first = bayes_shrink(now, columns, table, 0.25**scale, step, radius, k, rule=rule)
        pilot = tuple(f"p_{c}" for c in columns)
        both = now.join(first.select(*KEY, *(F.col(c).alias(p) for c, p in zip(columns, pilot, strict=True))), KEY)
        done = saved(bayes_shrink(saved(both), columns, table, 0.25**scale, step, radius, k, pilot, rule=rule))
    return done


def denoise_rgb(cells: DataFrame, **options) -> DataFrame:
    """r, g, b denoised along an orthonormal brightness axis and two colour axes."""
    s3, s2, s6 = 3**0.5, 2**0.5, 6**0.5
    r, g, b = (F.col(c).cast("double") for c in "rgb")
    axes = cells.select(*KEY, ((r + g + b) / s3).alias("p"), ((r - b) / s2).alias("q"), ((r - 2 * g + b) / s6).alias("t"))
    out = nl_bayes_denoise(axes, ("p", "q", "t"), **options)
    p, q, t = F.col("p") / s3, F.col("q") / s2, F.col("t") / s6
    return out.select(*KEY, (p + q + t).alias("r"), (p - 2 * t).alias("g"), (p - q + t).alias("b"))
