"""Medians by sliding histograms against sorted windows, at every size and kind of value, and their cost."""

import time

import numpy as np
import pytest

from gridwright.operators import focal
from gridwright.plans.focal import around
from gridwright.sources.cells import KEY


def by_sorting(grid, r):
    return np.sort(around(np.pad(grid, r, mode="edge"), r), axis=-1)[..., (2 * r + 1) ** 2 // 2]


@pytest.mark.parametrize("r", [1, 2, 5, 9])
@pytest.mark.parametrize("kind", ["bytes", "two", "floats", "one", "negative"])
def test_both_ways_equal_sorting(r, kind):
    rng = np.random.default_rng(r)
    grid = {"bytes": rng.integers(0, 256, (23, 31)), "two": rng.integers(0, 2, (23, 31)) * 255, "floats": rng.normal(size=(23, 31)), "one": np.full((5, 7), 9), "negative": rng.integers(-40_000, 40_000, (12, 40))}[kind].astype(float)
    want = by_sorting(grid, r)
    assert (focal.sliding_median(np.pad(grid, r, mode="edge"), r) == want).all()
    assert (focal._middle(np.pad(grid, r, mode="edge"), r) == want).all()


@pytest.mark.parametrize("size", [3, 21, 101])
def test_tiles_equal_sorting(spark, size):
    rng = np.random.default_rng(4)
    grid = rng.integers(0, 256, (50, 83))
    df = spark.createDataFrame([(0, y, x, int(grid[y, x])) for y in range(50) for x in range(83)], "image_id long, y long, x long, v int").repartition(3)
    out = focal.median(df, size)
    assert out.schema["v"].dataType == df.schema["v"].dataType
    got = np.full(grid.shape, -1)
    for r in out.collect():
        got[r.y, r.x] = r.v
    assert (got == by_sorting(grid, size // 2)).all() and KEY == out.columns[:3]


def test_time_a_cell_does_not_grow_with_the_radius():
    rng = np.random.default_rng(1)

    def took(r):
        block = rng.integers(0, 256, (120 + 2 * r, 200 + 2 * r)).astype(float)
        best = min(_timed(block, r) for _ in range(3))
        return best / (120 * 200)

    def _timed(block, r):
        start = time.perf_counter()
        focal.sliding_median(block, r)
        return time.perf_counter() - start

    small, large = took(3), took(50)
    # a window of radius 50 has 208 times the cells; only the halo's columns are more
    assert large < 4 * small
