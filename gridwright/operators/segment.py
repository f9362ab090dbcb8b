"""Per-image models on small tables: histogram segments, posterising, spectra, principal illuminant."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.focal import tile_arrays, tile_with_halo
from ..sources.cells import KEY, luma
from .local import hue_space, srgb_to_linear
from .stats import dense, luma_histogram  # noqa: F401


def _pooled(h: np.ndarray) -> list[tuple[float, int]]:
    """For each t the last block (mean, bins) of the nearest rising histogram of h[: t + 1]: neighbours that violate the order are pooled.

    The blocks before it are those of h[: t + 1 - bins], so that one pass tells the fits of all beginnings.
    """
    out: list[tuple[float, int]] = []
    for t, v in enumerate(h.tolist()):
        mean, n = float(v), 1
        while n <= t and out[t - n][0] > mean:
            m, k = out[t - n]
            mean, n = (m * k + mean * n) / (k + n), k + n
        out.append((mean, n))
    return out


def _fit(pooled: list[tuple[float, int]], t: int) -> np.ndarray:
    """The fit of h[: t + 1]."""
    found = []
    while t >= 0:
        found.append(pooled[t])
        t -= pooled[t][1]
    means, sizes = zip(*reversed(found), strict=True)
    return np.repeat(means, sizes)


def _monotone(h: np.ndarray, up: bool) -> np.ndarray:
    """The nearest monotone histogram."""
    out = _fit(_pooled(h if up else h[::-1]), len(h) - 1)
    return out if up else out[::-1]


#: Pairs of bins that are looked at together, and the most bins whose pairs are all looked at.
PAIRS, FEW = 1 << 20, 40


@functools.cache
def _all_pairs(length: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(length, 1, length + 1)


def _entropy(r: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Relative entropy of shares r of the mass where the fit has shares p."""
    p, q = np.minimum(np.maximum(p, 1e-12), 1 - 1e-12), 1 - r
    return r * np.log(np.maximum(r, 1e-300) / p) + q * np.log(np.maximum(q, 1e-300) / (1 - p))


def _worst(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> float:
    n = a[-1]
    return float((n * _entropy((a[j] - a[i]) / n, (b[j] - b[i]) / n)).max())


def _misfit(h: np.ndarray, fit: np.ndarray, eps: float) -> float:
    """How far the worst sub-interval's mass is from the nearest monotone histogram, over what chance allows; positive rejects.

    The sums of h and of the fit meet where blocks of equal values of the fit end, and between these one stays on one side of the other. Relative
    entropy is convex, so the worst interval lies in one block, or begins with the first bin or ends with the last one: no others are looked at.
    Only where these show nothing but rounding, all are.
    """
    length = len(h)
    a, b = np.zeros(length + 1), np.zeros(length + 1)
    np.cumsum(h, out=a[1:])
    n = a[-1]
    if n == 0 or length < 2:
        return -1.0
    np.cumsum(fit, out=b[1:])
    worst = -math.inf
    if (a == b).all():
        # shares are equal everywhere but for the bounds of p
        worst = float(n * _entropy(np.ones(1), np.ones(1))[0])
        return worst - math.log(length * (length + 1) / 2 / eps)
    if length > FEW:
        places = np.arange(length)
        # the ends that go with each start, and a block's starts together
        last = np.concatenate([np.flatnonzero(fit[1:] != fit[:-1]) + 1, [length]])
        many = np.repeat(last, np.diff(last, prepend=0)) - places
        stops, lo, before = np.cumsum(many), 0, 0
        i, j = np.concatenate([np.zeros(length, dtype=int), places]), np.concatenate([places + 1, np.full(length, length)])
        while lo < length:
            hi = max(lo + 1, int(np.searchsorted(stops, before + PAIRS, "right")))
            starts = np.repeat(places[lo:hi], many[lo:hi])
            ends = np.arange(len(starts)) - np.repeat(stops[lo:hi] - many[lo:hi] - before, many[lo:hi]) + starts + 1
            worst = max(worst, _worst(a, b, np.concatenate([i, starts]), np.concatenate([j, ends])))
            i, j, lo, before = i[:0], j[:0], hi, int(stops[hi - 1])
    if worst < 1e-6:
        # all sub-intervals, those that begin in a block of bins at a time, so that memory grows with the bins and not with their square
        step = max(1, PAIRS // (length + 1))
        for lo in range(0, length, step):
            i, j = _all_pairs(length) if length <= FEW else np.triu_indices(min(step, length - lo), 1, length + 1 - lo)
            worst = max(worst, _worst(a, b, i + lo, j + lo))
    return worst - math.log(length * (length + 1) / 2 / eps)


#: Places of a peak that are tried before all others are screened, and the places that are screened together.
TRIED, SCREENED = 2, 256


def _hopeless(h: np.ndarray, pooled: list[tuple[float, int]], eps: float) -> np.ndarray:
    """Which beginnings h[: t + 1] surely have a positive misfit, by the intervals from their first bin or to their last one alone.

    Single precision with a margin far over its rounding does for that.
    """
    length = len(h)
    a, at = np.concatenate([[0], np.cumsum(h)]), np.arange(length + 1)
    out = np.zeros(length, dtype=bool)
    for lo in range(0, length, SCREENED):
        rows = np.arange(lo, min(lo + SCREENED, length))
        width = int(rows[-1]) + 2
        # the sums of the fit of each beginning
        b = np.zeros((len(rows), width))
        for row, t in enumerate(rows.tolist()):
            mean, n = pooled[t]
            s = t + 1 - n
            if s > lo:
                b[row, : s + 1] = b[s - 1 - lo, : s + 1]
            elif s:
                b[row, 1 : s + 1] = np.cumsum(_fit(pooled, s - 1))
            b[row, s + 1 : t + 2] = b[row, s] + mean * at[1 : n + 1]
        n = np.maximum(a[rows + 1], 1)[:, None]
        r, p = a[:width] / n, b / n
        r, p, q, rest = (np.maximum(v, 1e-30).astype(np.float32) for v in (r, np.maximum(p, 1e-12), 1 - r, np.maximum(1 - p, 1e-12)))
        # an interval and the rest of the bins have the same entropy, so those to the last bin are among them; beyond the last bin it is 0
        worst = (r * np.log(r / p) + q * np.log(q / rest))[:, :width]
        worst[at[:width] > rows[:, None] + 1] = 0
        worst = worst.max(1)
        out[rows] = (rows > 0) & (a[rows + 1] > 0) & ((worst * (1 - 1e-5) - 1e-5) * n[:, 0] > np.log((rows + 1) * (rows + 2) / 2 / eps))
    return out


def _one_mode(h: np.ndarray, t: int, up: list[tuple[float, int]], down: list[tuple[float, int]], eps: float) -> float:
    """The misfit of rising to a peak at t and falling from it; once it is positive, any positive number."""
    found = _misfit(h[: t + 1], _fit(up, t), eps)
    return found if found > 0 else max(found, _misfit(h[t:], _fit(down, len(h) - 1 - t)[::-1], eps))


def _unimodal(h: np.ndarray, eps: float) -> float:
    """The misfit of rising to a peak and falling from it, at the likeliest place of the peak (highest first) where it is not positive; infinite if there is none."""
    first = int(np.argmax(h))
    found = _one_mode(h, first, _pooled(h[: first + 1]), _pooled(h[first:][::-1]), eps)
    if found <= 0:
        return found
    up, down = _pooled(h), _pooled(h[::-1])
    skipped = np.zeros(len(h), dtype=bool)
    for nth, t in enumerate(np.argsort(-h, kind="stable").tolist()):
        if nth == TRIED and len(h) > FEW:
            skipped = _hopeless(h, up, eps) | _hopeless(h[::-1], down, eps)[::-1]
        if nth and not skipped[t]:
            found = _one_mode(h, t, up, down, eps)
            if found <= 0:
                return found
    return math.inf


def segments_of(h: np.ndarray, eps: float) -> list[tuple[int, int]]:
    """[start, stop) of the modes of a histogram: cuts at its minima go while both sides together are one mode."""
    inner = [i for i in range(1, len(h) - 1) if h[i] <= h[i - 1] and h[i] <= h[i + 1] and (h[i] < h[i - 1] or h[i] < h[i + 1])]
    cuts = [0, *inner, len(h)]
    # neighbouring minima of a flat valley count once
    cuts = [c for k, c in enumerate(cuts) if k == 0 or c != cuts[k - 1] + 1 or c == len(h)]
    known: dict[tuple[int, int], float] = {}
    while len(cuts) > 2:
        for a, b in zip(cuts, cuts[2:], strict=False):
            if (a, b) not in known:
                known[a, b] = _unimodal(h[a:b], eps)
        cost, k = min((known[cuts[k - 1], cuts[k + 1]], k) for k in range(1, len(cuts) - 1))
        if cost > 0:
            break
        cuts.pop(k)
    return list(zip(cuts[:-1], cuts[1:], strict=True))


def circular_segments(h: np.ndarray, eps: float) -> list[tuple[int, int]]:
    """The same on a circle, [start, stop) modulo the number of bins: cut at the least bin, and there too if the two sides are no one mode."""
    n, turn = len(h), int(np.argmin(h))
    parts = segments_of(np.roll(h, -turn), eps)
    if len(parts) > 1 and _unimodal(np.concatenate([np.roll(h, -turn)[parts[-1][0] :], np.roll(h, -turn)[: parts[0][1]]]), eps) <= 0:
        parts = [*parts[1:-1], (parts[-1][0], n + parts[0][1])]
    return [((a + turn) % n, (a + turn) % n + b - a) for a, b in parts]


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[list, pa.RecordBatch]]:
    """(values of keys, their rows) one after the other; rows of the same keys follow each other."""
    held = None
    for batch in batches:
        batch = batch if held is None else pa.concat_batches([held, batch])
        if not batch.num_rows:
            continue
        new = np.zeros(batch.num_rows - 1, dtype=bool)
        for c in (batch.column(k) for k in keys):
            v, null = c.fill_null(0).to_numpy(zero_copy_only=False), c.is_null().to_numpy(zero_copy_only=False)
            new |= (v[1:] != v[:-1]) | (null[1:] != null[:-1])
        bounds = [0, *(np.flatnonzero(new) + 1).tolist()]
        for a, b in zip(bounds, bounds[1:], strict=False):
            yield [batch.column(k)[a].as_py() for k in keys], batch.slice(a, b - a)
        held = batch.slice(bounds[-1])
    if held is not None and held.num_rows:
        yield [held.column(k)[0].as_py() for k in keys], held


def _dealt(hist: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the same keys one after the other. Histograms are few bytes and much work: dealt by number, as Spark would put a megabyte of them into one task."""
    return hist.repartition(int(hist.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys).sortWithinPartitions(*keys)


def _numbers(rows: pa.RecordBatch, column: str, kind: type = float) -> np.ndarray:
    return rows.column(column).to_numpy(zero_copy_only=False).astype(kind)


def _labels(parts: list[tuple[int, int]], bins: int) -> np.ndarray:
    """The segment of each bin."""
    out = np.zeros(bins, dtype=int)
    for k, (a, b) in enumerate(parts):
        out[np.arange(a, b) % bins] = k
    return out


def _class_means(label: np.ndarray, rows: pa.RecordBatch) -> list[pa.Array]:
    """The mean r, g, b of each row's class, from counts n and sums."""
    n = np.maximum(np.bincount(label, _numbers(rows, "n")), 1)
    return [pa.array((np.bincount(label, _numbers(rows, c)) / n)[label]) for c in "rgb"]


def hist_segment(hist: DataFrame, eps: float = 1.0, keys: tuple[str, ...] = ("image_id",), bins: int = 256, circular: bool = False) -> DataFrame:
    """keys, segment, lo, hi (inclusive; hi < lo runs over the end of a circle) of each histogram. hist: keys, bin, n; bins not there are empty.

    Counting has scaled out; here a group is one row for each bin.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, rows in _groups(batches, list(keys)):
            h = np.zeros(bins)
            h[_numbers(rows, "bin", int)] = _numbers(rows, "n")
            parts = circular_segments(h, eps) if circular else segments_of(h, eps)
            same = [pa.array([k] * len(parts), pa.int64()) for k in key]
            found = [pa.array(range(len(parts)), pa.int32()), pa.array([a % bins for a, _ in parts], pa.int32()), pa.array([(b - 1) % bins for _, b in parts], pa.int32())]
            yield pa.RecordBatch.from_arrays([*same, *found], [*keys, "segment", "lo", "hi"])

    return _dealt(hist.select(*keys, "bin", "n"), list(keys)).mapInArrow(run, ", ".join(f"{k} long" for k in keys) + ", segment int, lo int, hi int")


#: What a colour is segmented by; hbin is -1 where it is grey.
HSI_BINS = ["hbin", "sbin", "ibin"]
PALETTE_KEYS = ["image_id", "hue", "sat", "level"]


def _hsi_classes(hbin: np.ndarray, sbin: np.ndarray, ibin: np.ndarray, n: np.ndarray, eps: float, bins: tuple[int, int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hue, sat, level) of each row of an image's counts: segments of hue (a circle), of saturation in each hue, of intensity in each of those."""
    hue, sat, level = np.full(len(n), -1), np.zeros(len(n), dtype=int), np.zeros(len(n), dtype=int)
    coloured = hbin >= 0
    if coloured.any():
        own = hbin[coloured]
        hue[coloured] = _labels(circular_segments(np.bincount(own, n[coloured], bins[0]), eps), bins[0])[own]
    for k in np.unique(hue):
        rows = np.flatnonzero(hue == k)
        if k >= 0:
            sat[rows] = _labels(segments_of(np.bincount(sbin[rows], n[rows], bins[1]), eps), bins[1])[sbin[rows]]
        for m in np.unique(sat[rows]):
            own = rows[sat[rows] == m]
            level[own] = _labels(segments_of(np.bincount(ibin[own], n[own], bins[2]), eps), bins[2])[ibin[own]]
    return hue, sat, level


def _hsi_binned(cells: DataFrame, least: float, bins: tuple[int, int, int]) -> DataFrame:
    """image_id, y, x, r, g, b and the bins of hue, saturation and intensity; those of grey cells tell only the intensity."""
    h, s, level = hue_space("hsi")
    at = lambda c, n, top: F.least(F.floor(c / top * n), F.lit(n - 1)).cast("long")
    hbin, sbin, ibin = (at(c, n, top) for c, n, top in zip((h, s, level), bins, (360.0, 1.0, 1.0), strict=True))
    grey = s < least
    return cells.select(*KEY, *"rgb", F.when(grey, F.lit(-1)).otherwise(hbin).alias("hbin"), F.when(grey, F.lit(0)).otherwise(sbin).alias("sbin"), ibin.alias("ibin")).where(s.isNotNull() & F.col("image_id").isNotNull())


def _hsi_table(binned: DataFrame, eps: float, bins: tuple[int, int, int]) -> DataFrame:
    """image_id, hbin, sbin, ibin, n, hue, sat, level and the mean r, g, b of that class.

    An image's cells are counted once, by all three bins; its counts (at most the product of the numbers of bins, however many cells it has) are one
    task's, which makes all three rounds of segments of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _groups(batches, ["image_id"]):
            found = _hsi_classes(*(_numbers(rows, c, int) for c in HSI_BINS), _numbers(rows, "n"), eps, bins)
            label = np.unique(np.stack(found), axis=1, return_inverse=True)[1].ravel()
            parts = [*(rows.column(c) for c in ("image_id", *HSI_BINS, "n")), *(pa.array(f, pa.int64()) for f in found), *_class_means(label, rows)]
            yield pa.RecordBatch.from_arrays(parts, ["image_id", *HSI_BINS, "n", *PALETTE_KEYS[1:], *"rgb"])

    counts = binned.groupBy("image_id", *HSI_BINS).agg(F.count("*").alias("n"), *(F.sum(F.col(c).cast("double")).alias(c) for c in "rgb"))
    return _dealt(counts, ["image_id"]).mapInArrow(run, "image_id long, hbin long, sbin long, ibin long, n long, hue long, sat long, level long, r double, g double, b double")


def _hsi_joined(cells: DataFrame, eps: float = 1.0, least: float = 0.08, hues: int = 72, saturations: int = 50, levels: int = 64) -> tuple[DataFrame, DataFrame]:
    """(cells with their bins, what is known of bins)."""
    binned = _hsi_binned(cells, least, (hues, saturations, levels))
    return binned, _hsi_table(binned, eps, (hues, saturations, levels))


def hsi_labels(cells: DataFrame, eps: float = 1.0, **options) -> DataFrame:
    """image_id, y, x, r, g, b, hue, sat, level: segments of hue (a circle), of saturation in each hue, of intensity in each of those.

    Cells under the least saturation are grey: their hue is -1, and only their intensity is segmented. Cells are counted once, and
    segments become a table of bins, so the join is by equality.
    """
    binned, table = _hsi_joined(cells, eps, **options)
    return binned.join(table.select("image_id", *HSI_BINS, *PALETTE_KEYS[1:]), ["image_id", *HSI_BINS]).select(*KEY, "r", "g", "b", *PALETTE_KEYS[1:])


def hsi_palette(cells: DataFrame, eps: float = 1.0, **options) -> DataFrame:
    """image_id, hue, sat, level, n and the mean r, g, b of each class."""
    return _hsi_joined(cells, eps, **options)[1].groupBy(*PALETTE_KEYS).agg(F.sum("n").alias("n"), *(F.first(c).alias(c) for c in "rgb"))


def posterize_hsi(cells: DataFrame, eps: float = 1.0, **options) -> DataFrame:
    """Every cell shows the mean of its class of the palette."""
    binned, table = _hsi_joined(cells, eps, **options)
    return binned.drop(*"rgb").join(table, ["image_id", *HSI_BINS]).select(*KEY, "hue", "sat", "level", "r", "g", "b")


def posterize(cells: DataFrame, eps: float = 1.0, bins: int = 256) -> DataFrame:
    """Every cell shows the mean of its luma segment.

    Cells are counted and summed once by luma; the task that segments an image's histogram takes the means too, and they become a table of values, so
    the join is by equality and cells do not meet cells.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _groups(batches, ["image_id"]):
            v, n = _numbers(rows, "v", int), _numbers(rows, "n")
            label = _labels(segments_of(np.bincount(v, n, bins), eps), bins)[v]
            yield pa.RecordBatch.from_arrays([rows.column("image_id"), rows.column("v"), pa.array(label), *_class_means(label, rows)], ["image_id", "v", "label", *"rgb"])

    valued = cells.select(*KEY, luma().cast("long").alias("v"), *(F.col(c).cast("double").alias(c) for c in "rgb")).where(F.col("v").between(0, bins - 1) & F.col("image_id").isNotNull())
    counts = valued.groupBy("image_id", "v").agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in "rgb"))
    table = _dealt(counts, ["image_id"]).mapInArrow(run, "image_id long, v long, label long, r double, g double, b double")
    return valued.select(*KEY, "v").join(table, ["image_id", "v"]).select(*KEY, "label", "r", "g", "b")


def spectrum_2d(planes: DataFrame, size: int = 16) -> DataFrame:
    """image_id, ty, tx, ring, power: the power spectrum of each tile by whole-number radius, a texture and blur feature."""
    fy, fx = np.meshgrid(np.fft.fftfreq(size) * size, np.fft.fftfreq(size) * size, indexing="ij")
    ring = np.floor(np.hypot(fy, fx)).astype(int).ravel()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for image, ty, tx, y, x, v in tile_arrays(batch, ["v"]):
                block = np.zeros((size, size))
                block[y % size, x % size] = v[:, 0]
                total = np.bincount(ring, (np.abs(np.fft.fft2(block)) ** 2 / size**2).ravel())
                n = len(total)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (np.full(n, image), np.full(n, ty), np.full(n, tx), np.arange(n, dtype=np.int32), total)], ["image_id", "ty", "tx", "ring", "power"])

    return tile_with_halo(planes.select(*KEY, "v"), size, 0, "shrink", ordered=False).mapInArrow(run, "image_id long, ty long, tx long, ring int, power double")


def pca_illuminant(cells: DataFrame, fraction: float = 0.035, saturation: float = 0.98, black: float = 0.02, bins: int = 4096) -> DataFrame:
    """image_id, er, eg, eb, ok: the first principal direction of the darkest and brightest cells along the mean colour.

    Three aggregates and two running counts over the projection histogram; only the 3 x 3 moments of an
    image reach Python. Fewer than 16 cells or a negative component give equal components and ok = false.
    """
    lin = cells.select("image_id", *(srgb_to_linear(F.col(c) / 255.0).alias(c) for c in "rgb"))
    level = 0.2126 * F.col("r") + 0.7152 * F.col("g") + 0.0722 * F.col("b")
    good = lin.where((F.greatest("r", "g", "b") < saturation) & (level >= black))
    means = good.groupBy("image_id").agg(*(F.avg(c).alias(f"m{c}") for c in "rgb"), F.count("*").alias("n"))
    size = F.sqrt(F.col("mr") ** 2 + F.col("mg") ** 2 + F.col("mb") ** 2)
    joined = good.join(means.where("n >= 16"), "image_id")
    at = F.least(F.floor((F.col("r") * F.col("mr") + F.col("g") * F.col("mg") + F.col("b") * F.col("mb")) / size / 1.74 * bins), F.lit(bins - 1))
    placed = joined.select("image_id", "r", "g", "b", "n", at.alias("bin"))
    hist = placed.groupBy("image_id", "bin").agg(F.count("*").alias("c"), F.first("n").alias("n"))
    up = W.partitionBy("image_id").orderBy("bin").rowsBetween(W.unboundedPreceding, 0)
    down = W.partitionBy("image_id").orderBy(F.desc("bin")).rowsBetween(W.unboundedPreceding, 0)
    k = F.least(F.greatest(F.floor(F.col("n") * fraction + 0.5), F.lit(1)), F.floor(F.col("n") / 2))
    edges = hist.select("image_id", "bin", (F.sum("c").over(up) - F.col("c") < k).alias("dark"), (F.sum("c").over(down) - F.col("c") < k).alias("bright")).where("dark or bright").select("image_id", "bin")
    kept = placed.join(edges, ["image_id", "bin"])
    pairs = [("r", "r"), ("r", "g"), ("r", "b"), ("g", "g"), ("g", "b"), ("b", "b")]
    moments = kept.groupBy("image_id").agg(*(F.avg(F.col(a) * F.col(b)).alias(a + b) for a, b in pairs))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            out = []
            for row in p.itertuples():
                m = np.array([[row.rr, row.rg, row.rb], [row.rg, row.gg, row.gb], [row.rb, row.gb, row.bb]])
                e = np.linalg.eigh(m)[1][:, -1]
                e = e if e.sum() >= 0 else -e
                ok = bool((e >= 0).all())
                out.append((row.image_id, *(e if ok else [3**-0.5] * 3), ok))
            yield pd.DataFrame(out, columns=["image_id", "er", "eg", "eb", "ok"])

    found = moments.mapInPandas(run, "image_id long, er double, eg double, eb double, ok boolean")
    none = F.lit(3**-0.5)
    return cells.select("image_id").distinct().join(found, "image_id", "left").select("image_id", *(F.coalesce(c, none).alias(c) for c in ("er", "eg", "eb")), F.coalesce("ok", F.lit(False)).alias("ok"))
