"""The Fourier transform of whole images, both ways, for any width and height.

Rows first, then columns: an image is dealt in bands of BAND rows, each row is transformed along x, and what comes out leaves
the task in blocks of BAND x BAND cells. They are dealt again by bands of columns, which are transformed along y. No
task holds more than BAND rows or columns of an image, and the shuffle between moves blocks, not cells.

Spectra are planes of image_id, y, x, re, im, y and x being the frequencies from 0 on; frequencies above the half are the
negative ones. Cells that an image lacks count as 0.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.focal import shape
from ..sources.cells import KEY

BAND = 16
BLOCK = "image_id long, h long, w long, along long, across long, re array<double>, im array<double>"
_NAMES = ["image_id", "h", "w", "along", "across", "re", "im"]
Transform = Callable[[np.ndarray], np.ndarray]


def _lists(parts: list[np.ndarray]) -> pa.Array:
    stops = np.cumsum([0, *(len(p) for p in parts)])
    return pa.ListArray.from_arrays(pa.array(stops, pa.int32()), pa.array(np.concatenate(parts) if parts else np.zeros(0)))


def _blocks(image: int, h: int, w: int, band: int, lines: np.ndarray) -> pa.RecordBatch:
    """A band's lines in blocks of BAND along them; `across` is the band they go to next."""
    n = -(-lines.shape[1] // BAND)
    parts = [np.ascontiguousarray(lines[:, i * BAND : (i + 1) * BAND]).ravel() for i in range(n)]
    same = lambda v: pa.array(np.full(n, v), pa.int64())
    return pa.RecordBatch.from_arrays([same(image), same(h), same(w), same(band), pa.array(np.arange(n)), _lists([p.real for p in parts]), _lists([p.imag for p in parts])], _NAMES)


def _rows(cells: DataFrame, step: Transform) -> DataFrame:
    """Blocks of the rows after step. cells: image_id, y, x, h, w, re, im."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for image, band, h, w, own in zip(*(batch.column(i).to_pylist() for i in range(4)), batch.column(4), strict=True):
                y, x, re, im = (own.values.field(i).to_numpy(zero_copy_only=False) for i in range(4))
                lines = np.zeros((min(BAND, h - band * BAND), w), dtype=complex)
                lines[y - band * BAND, x] = re + 1j * im
                yield _blocks(image, h, w, band, step(lines))

    grouped = cells.groupBy("image_id", F.floor(F.col("y") / BAND).alias("band")).agg(F.first("h").alias("h"), F.first("w").alias("w"), F.collect_list(F.struct("y", "x", "re", "im")).alias("own"))
    return grouped.mapInArrow(run, BLOCK)


def _gathered(batch: pa.RecordBatch) -> Iterator[tuple[int, int, int, int, np.ndarray]]:
    """(image, h, w, column band, its columns as lines) of rows image_id, band, h, w, own: the blocks of a band of columns."""
    for image, band, h, w, own in zip(*(batch.column(i).to_pylist() for i in range(4)), batch.column(4), strict=True):
        width = min(BAND, w - band * BAND)
        lines = np.zeros((width, h), dtype=complex)
        for block in own.values.to_pylist():
            top = block["along"] * BAND
            part = np.array(block["re"]) + 1j * np.array(block["im"])
            lines[:, top : top + BAND] = part.reshape(-1, width).T
        yield image, h, w, band, lines


def _columns(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("image_id", F.col("across").alias("band")).agg(F.first("h").alias("h"), F.first("w").alias("w"), F.collect_list(F.struct("along", "re", "im")).alias("own"))


def _to_cells(blocks: DataFrame, step: Transform) -> DataFrame:
    """The cells after step along the columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for image, h, _, band, lines in _gathered(batch):
                made = step(lines).T
                y, x = np.divmod(np.arange(made.size), made.shape[1])
                parts = [np.full(made.size, image), y, x + band * BAND, made.real.ravel(), made.imag.ravel()]
                yield pa.RecordBatch.from_arrays([pa.array(p) for p in parts], [*KEY, "re", "im"])

    return _columns(blocks).mapInArrow(run, "image_id long, y long, x long, re double, im double")


def _sized(planes: DataFrame) -> DataFrame:
    value = ["re", "im"] if "re" in planes.columns else [F.col("v").cast("double").alias("re"), F.lit(0.0).alias("im")]
    return planes.select(*KEY, *value).join(shape(planes), "image_id")


def fft2(planes: DataFrame) -> DataFrame:
    """image_id, y, x, re, im: the spectrum of planes with v, or with re and im. Two shuffles."""
    return _to_cells(_rows(_sized(planes), np.fft.fft), np.fft.fft)


def ifft2(spectra: DataFrame) -> DataFrame:
    """image_id, y, x, re, im: what fft2() made them of; im is 0 but for rounding where that was real."""
    return _to_cells(_rows(_sized(spectra), np.fft.ifft), np.fft.ifft)


def frequency(at: Column, n: Column) -> Column:
    """The signed frequency, in cycles a cell, of a place of a spectrum of n cells."""
    return F.when(at * 2 < n, at).otherwise(at - n) / n


def filtered(planes: DataFrame, gain: Callable[[Column, Column], Column]) -> DataFrame:
    """image_id, y, x, v: planes whose every frequency is multiplied by gain(fy, fx), frequencies in cycles a cell from -1/2 to 1/2.

    A gain that is the same for f and -f keeps real planes real.
    """
    spectrum = fft2(planes)
    factor = gain(frequency(F.col("y"), F.col("h")), frequency(F.col("x"), F.col("w")))
    scaled = spectrum.join(shape(planes), "image_id").select(*KEY, (F.col("re") * factor).alias("re"), (F.col("im") * factor).alias("im"))
    return ifft2(scaled).select(*KEY, F.col("re").alias("v"))


def low_pass(planes: DataFrame, sigma: float) -> DataFrame:
    """A Gaussian blur of sigma cells, whatever its width, at the cost of two transforms; the image repeats beyond its borders."""
    return filtered(planes, lambda fy, fx: F.exp((fy * fy + fx * fx) * (-2 * math.pi**2 * sigma**2)))


def spectrum_rings(planes: DataFrame) -> DataFrame:
    """image_id, ring, power, n: the mean power of the frequencies of each whole-number radius, in cycles over the image's longer side."""
    power = (F.col("re") ** 2 + F.col("im") ** 2) / (F.col("h") * F.col("w"))
    fy, fx = frequency(F.col("y"), F.col("h")), frequency(F.col("x"), F.col("w"))
    radius = F.sqrt(fy * fy + fx * fx) * F.greatest("h", "w")
    rows = fft2(planes).join(shape(planes), "image_id").select("image_id", F.floor(F.round(radius, 9)).cast("int").alias("ring"), power.alias("power"))
    return rows.groupBy("image_id", "ring").agg(F.avg("power").alias("power"), F.count("*").alias("n"))
