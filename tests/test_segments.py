"""Histogram segments and what is painted from them, against a plain twin: isotonic fits by the min-max formula, sub-intervals by loops."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridwright.operators import local, segment
from gridwright.sources.cells import KEY


def rising(h):
    """The isotonic fit of a list: at each place the largest over starts of the least over ends of the mean between them."""
    n = len(h)
    return [max(min(sum(h[a : b + 1]) / (b - a + 1) for b in range(i, n)) for a in range(i + 1)) for i in range(n)]


def misfit(h, fit, eps):
    n, size = sum(h), len(h)
    if n == 0 or size < 2:
        return -1.0
    worst = -math.inf
    for i in range(size):
        for j in range(i + 1, size + 1):
            r, p = sum(h[i:j]) / n, min(max(sum(fit[i:j]) / n, 1e-12), 1 - 1e-12)
            e = (r * math.log(r / p) if r > 0 else 0) + ((1 - r) * math.log((1 - r) / (1 - p)) if r < 1 - 1e-15 else 0)
            worst = max(worst, n * e)
    return worst - math.log(size * (size + 1) / 2 / eps)


def one_mode(h, eps):
    return min(max(misfit(h[: t + 1], rising(h[: t + 1]), eps), misfit(h[t:], rising(h[t:][::-1])[::-1], eps)) for t in range(len(h)))


def twin(h, eps):
    minima = [i for i in range(1, len(h) - 1) if h[i - 1] >= h[i] <= h[i + 1] and (h[i - 1] > h[i] or h[i] < h[i + 1])]
    cuts = [0, *minima, len(h)]
    cuts = [c for k, c in enumerate(cuts) if k == 0 or c != cuts[k - 1] + 1 or c == len(h)]
    while len(cuts) > 2:
        cost, k = min((one_mode(h[cuts[k - 1] : cuts[k + 1]], eps), k) for k in range(1, len(cuts) - 1))
        if cost > 0:
            break
        del cuts[k]
    return list(zip(cuts, cuts[1:]))


def histograms(n):
    rng = np.random.default_rng(17)
    for _ in range(n):
        values = np.concatenate([rng.normal(c, w, int(rng.integers(20, 300))) for c, w in zip(rng.uniform(0, 24, 3), rng.uniform(0.5, 3, 3))])
        yield np.bincount(values.round().clip(0, 23).astype(int), minlength=24)


def test_segments_equal_the_twin(spark):
    all_h = list(histograms(12))
    rows = [(i, b, int(v)) for i, h in enumerate(all_h) for b, v in enumerate(h) if v]
    got = {}
    for r in segment.hist_segment(spark.createDataFrame(rows, "image_id long, bin int, n long"), bins=24).orderBy("segment").collect():
        got.setdefault(r.image_id, []).append((r.lo, r.hi + 1))
    want = {i: twin(h.tolist(), 1.0) for i, h in enumerate(all_h)}
    assert got == want and len({len(v) for v in want.values()}) > 1


@pytest.mark.parametrize("up", [True, False])
def test_monotone_fits_equal_the_min_max_formula(up):
    for h in histograms(20):
        want = rising(h.tolist()) if up else rising(h.tolist()[::-1])[::-1]
        assert np.allclose(segment._monotone(h, up), want)


def test_painting_shows_each_segment_s_mean(spark):
    rng = np.random.default_rng(4)
    g = np.concatenate([rng.normal(50, 6, 200), rng.normal(180, 9, 200)]).clip(0, 255).astype(int).reshape(20, 20)
    rng.shuffle(g.reshape(-1))
    cells = spark.createDataFrame([(0, y, x, *[int(g[y, x])] * 3, 255) for y in range(20) for x in range(20)], "image_id long, y long, x long, r int, g int, b int, a int")
    parts = [(r.lo, r.hi) for r in segment.hist_segment(segment.dense(segment.luma_histogram(cells))).orderBy("segment").collect()]
    luma = {(r.y, r.x): r.v for r in cells.select(*KEY, segment.luma().alias("v")).collect()}
    assert len(parts) >= 2 and parts[0][0] == 0 and parts[-1][1] == 255 and all(a[1] + 1 == b[0] for a, b in zip(parts, parts[1:]))
    for r in segment.posterize(cells).select(*KEY, F.col("r").alias("v")).collect():
        lo, hi = next(p for p in parts if p[0] <= luma[r.y, r.x] <= p[1])
        own = [g[k] for k, v in luma.items() if lo <= v <= hi]
        assert abs(r.v - np.mean(own)) < 1e-9


def test_a_histogram_of_two_modes_looks_at_few_pairs(monkeypatch):
    """Cuts of noisy histograms: pairs of bins grow far more slowly than places of a peak times all pairs."""
    rng = np.random.default_rng(12)
    v = np.concatenate([rng.normal(70, 18, 3000), rng.normal(190, 20, 3000)]).round().clip(0, 255).astype(int)
    looked, plain = [], segment._entropy
    monkeypatch.setattr(segment, "_entropy", lambda r, p: looked.append(r.size) or plain(r, p))
    parts = segment.segments_of(np.bincount(v, minlength=256).astype(float), 1.0)
    assert len(parts) == 2 and 110 < parts[0][1] < 150
    assert sum(looked) < 3_000_000


@pytest.mark.parametrize("few", [2, 40])
def test_long_fits_equal_all_pairs(monkeypatch, few):
    """The worst interval among few candidates is the worst of all."""
    monkeypatch.setattr(segment, "FEW", few)
    rng = np.random.default_rng(21)
    for length in (2, 3, 9, 41, 90):
        for _ in range(8):
            h = rng.poisson(rng.uniform(0.2, 30), length) * (rng.random(length) < rng.uniform(0.3, 1))
            for up in (True, False):
                fit = segment._monotone(h.astype(float), up)
                assert abs(segment._misfit(h.astype(float), fit, 1.0) - misfit(h.tolist(), fit.tolist(), 1.0)) < 1e-6


def test_screened_places_have_a_positive_misfit():
    rng = np.random.default_rng(8)
    seen = 0
    for h in (rng.poisson(rng.uniform(0.2, 9, 60)).astype(float) for _ in range(12)):
        pooled = segment._pooled(h)
        skipped = segment._hopeless(h, pooled, 1.0)
        seen += skipped.sum()
        for t in np.flatnonzero(skipped):
            assert segment._misfit(h[: t + 1], segment._monotone(h[: t + 1], True), 1.0) > 0
    assert seen


def test_groups_go_over_batches():
    table = pa.table({"k": pa.array([1, 1, 2, 2, 2, None, None, 4]), "n": pa.array(range(8))})
    for size in (1, 2, 3, 8):
        got = [(k, g.column("n").to_pylist()) for k, g in segment._groups(iter(table.to_batches(max_chunksize=size)), ["k"])]
        assert got == [([1], [0, 1]), ([2], [2, 3, 4]), ([None], [5, 6]), ([4], [7])]


def _cells(spark, seed=5, images=3, side=16):
    v = np.random.default_rng(seed).integers(0, 4, (images, side, side, 3)) * 60 + np.random.default_rng(seed + 1).integers(0, 9, (images, side, side, 3))
    rows = [(i, y, x, *(int(n) for n in v[i, y, x]), 255) for i in range(images) for y in range(side) for x in range(side)]
    return spark.createDataFrame(rows, "image_id long, y long, x long, r int, g int, b int, a int")


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_posterize_does_not_join_cells_with_cells(spark):
    plan = _plan(segment.posterize(_cells(spark)))
    assert plan.count("Join ") == 1 and "MapInArrow" in plan


def test_palette_counts_cells_once(spark):
    cells = _cells(spark)
    plan = _plan(segment.hsi_palette(cells))
    assert "Join " not in plan and plan.count("LogicalRDD") + plan.count("LocalRelation") == 1


def test_hues_saturations_and_levels_equal_the_twin(spark):
    """Classes and their means against loops over counts of one group after the other."""
    cells = _cells(spark)
    got = {(r.image_id, r.y, r.x): (r.hue, r.sat, r.level, r.r, r.g, r.b) for r in segment.posterize_hsi(cells, hues=18, saturations=10, levels=16).collect()}
    hsi = {(r.image_id, r.y, r.x): (r.h, r.s, r.l) for r in local.to_hue_space(cells, "hsi").collect()}
    rgb = {(r.image_id, r.y, r.x): (r.r, r.g, r.b) for r in cells.collect()}

    def labelled(keys, at, bins, circular=False):
        h = np.bincount([at[k] for k in keys], minlength=bins).astype(float)
        parts = segment.circular_segments(h, 1.0) if circular else twin(h.tolist(), 1.0)
        return {k: next(n for n, (a, b) in enumerate(parts) if at[k] in {p % bins for p in range(a, b)}) for k in keys}

    bin_of = lambda n, top, i: {k: min(int(v[i] / top * n), n - 1) for k, v in hsi.items()}
    hbin, sbin, ibin = bin_of(18, 360.0, 0), bin_of(10, 1.0, 1), bin_of(16, 1.0, 2)
    want = {}
    for image in range(3):
        own = [k for k in hsi if k[0] == image]
        hue = labelled([k for k in own if hsi[k][1] >= 0.08], hbin, 18, True) | {k: -1 for k in own if hsi[k][1] < 0.08}
        sat = {k: 0 for k in own}
        for v in set(hue.values()) - {-1}:
            sat |= labelled([k for k in own if hue[k] == v], sbin, 10)
        for pair in {(hue[k], sat[k]) for k in own}:
            level = labelled([k for k in own if (hue[k], sat[k]) == pair], ibin, 16)
            for k, v in level.items():
                same = [rgb[q] for q in level if level[q] == v]
                want[k] = (*pair, v, *np.mean(same, axis=0))
    assert set(got) == set(want) and len({w[:3] for w in want.values()}) > 3
    for k, w in want.items():
        assert got[k][:3] == w[:3] and np.allclose(got[k][3:], w[3:])
    palette = {(r.image_id, r.hue, r.sat, r.level): (r.n, r.r, r.g, r.b) for r in segment.hsi_palette(cells, hues=18, saturations=10, levels=16).collect()}
    assert {(k[0], *w[:3]) for k, w in want.items()} == set(palette) and sum(v[0] for v in palette.values()) == len(want)
    assert all(np.allclose(palette[k[0], *w[:3]][1:], w[3:]) for k, w in want.items())
