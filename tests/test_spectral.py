"""Whole-image transforms against NumPy's, for any width and height."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridwright.operators import spectral
from gridwright.sources.cells import KEY


def planes(spark, images):
    rows = [(i, y, x, float(v)) for i, g in images.items() for y, row in enumerate(g) for x, v in enumerate(row)]
    return spark.createDataFrame(rows, "image_id long, y long, x long, v double").repartition(5)


def grids(df, *columns):
    rows = df.collect()
    out = {}
    for i in {r.image_id for r in rows}:
        own = [r for r in rows if r.image_id == i]
        assert len({(r.y, r.x) for r in own}) == len(own)
        g = np.zeros((max(r.y for r in own) + 1, max(r.x for r in own) + 1), dtype=complex)
        for r in own:
            g[r.y, r.x] = r[columns[0]] + (1j * r[columns[1]] if len(columns) > 1 else 0)
        out[i] = g
    return out


SHAPES = [(1, 1), (1, 40), (33, 1), (7, 13), (16, 16), (17, 31), (100, 37), (64, 48)]


@pytest.fixture(scope="module")
def images():
    rng = np.random.default_rng(8)
    return {i: rng.integers(0, 256, s) for i, s in enumerate(SHAPES)}


def test_any_length_both_ways(spark, images):
    p = planes(spark, images)
    spectrum = spectral.fft2(p)
    for i, got in grids(spectrum, "re", "im").items():
        assert np.allclose(got, np.fft.fft2(images[i]), rtol=0, atol=1e-9 * images[i].size)
    back = grids(spectral.ifft2(spectrum), "re", "im")
    assert all(np.abs(back[i] - g).max() < 1e-9 for i, g in images.items()) and len(back) == len(SHAPES)


def test_filters(spark, images):
    got = grids(spectral.low_pass(planes(spark, images), 2.0), "v")
    for i, g in images.items():
        fy, fx = np.meshgrid(*(np.fft.fftfreq(n) for n in g.shape), indexing="ij")
        want = np.fft.ifft2(np.fft.fft2(g) * np.exp(-8 * np.pi**2 * (fy**2 + fx**2)))
        # half the length is the lowest frequency here and the highest there: its gain is the same
        assert np.allclose(got[i], want.real, atol=1e-9)
    same = grids(spectral.filtered(planes(spark, images), lambda fy, fx: F.lit(1.0)), "v")
    assert all(np.abs(same[i] - g).max() < 1e-9 for i, g in images.items())


def test_a_cell_that_is_missing_is_zero(spark):
    g = np.arange(20.0).reshape(4, 5)
    p = planes(spark, {0: g}).where("NOT (y = 2 AND x = 1)")
    g[2, 1] = 0
    assert np.allclose(grids(spectral.fft2(p), "re", "im")[0], np.fft.fft2(g))
    assert spectral.fft2(p.limit(0)).collect() == []


def test_rings(spark, images):
    rows = {(r.image_id, r.ring): r for r in spectral.spectrum_rings(planes(spark, {5: images[5], 7: images[7]})).collect()}
    for i in (5, 7):
        g = images[i]
        fy, fx = np.meshgrid(*(np.fft.fftfreq(n) for n in g.shape), indexing="ij")
        ring = np.floor(np.round(np.hypot(fy, fx) * max(g.shape), 9)).astype(int)
        power = np.abs(np.fft.fft2(g)) ** 2 / g.size
        assert {k for j, k in rows if j == i} == set(ring.ravel())
        for k in np.unique(ring):
            assert rows[i, k].n == (ring == k).sum() and np.isclose(rows[i, k].power, power[ring == k].mean())


def test_no_task_holds_an_image(spark, images):
    """Groups are bands of one image: blocks are BAND x BAND cells at most."""
    p = planes(spark, {0: images[6]})
    blocks = spectral._rows(spectral._sized(p), np.fft.fft).collect()
    assert max(len(b.re) for b in blocks) == spectral.BAND**2 and len(blocks) == 7 * 3
    assert KEY == ["image_id", "y", "x"]
