"""Local operators: a cell's value from that cell alone, as column expressions."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tables
from ..sources.cells import KEY, clamp, luma, normalize_format, select_channels

RGB = ("r", "g", "b")


def _linear(m: list[float], cols: list[Column]) -> list[Column]:
    return [reduce(lambda a, b: a + b, (F.lit(float(m[3 * i + j])) * cols[j] for j in range(3))) for i in range(3)]


def _c(*names: str) -> list[Column]:
    return [F.col(n) for n in names]


def rgb_to_yuv(cells: DataFrame, std: str = "bt709") -> DataFrame:
    return cells.select(*KEY, *(c.alias(n) for c, n in zip(_linear(tables.RGB_TO_YUV[std], _c(*RGB)), ("yy", "u", "v"), strict=True)), "a")


def yuv_to_rgb(cells: DataFrame, std: str = "bt709") -> DataFrame:
    return cells.select(*KEY, *(c.alias(n) for c, n in zip(_linear(tables.YUV_TO_RGB[std], _c("yy", "u", "v")), RGB, strict=True)), "a")


def normalized_yuv(cells: DataFrame, fmt: str | Column, std: str | Column = "bt709") -> DataFrame:
    """image_id, y, x, yy, u, v, a as doubles, yy and a in 0..1 and u, v around 0, whatever the pixel format; format and standard may be columns."""
    rgb = normalize_format(cells, fmt)
    if isinstance(std, str):
        return rgb_to_yuv(rgb, std)
    # a column of an image's own standard: its nine factors as an array
    own = cells.select(*KEY, std.alias("std"))
    table = F.create_map(*(x for name, m in tables.RGB_TO_YUV.items() for x in (F.lit(name), F.array(*map(F.lit, m)))))
    m = F.element_at(table, F.col("std"))
    row = lambda i: sum(m[3 * i + j] * F.col(c) for j, c in enumerate(RGB))
    return rgb.join(own, KEY).select(*KEY, row(0).alias("yy"), row(1).alias("u"), row(2).alias("v"), "a")


def select_channels_yuv(cells: DataFrame, r: bool, g: bool, b: bool, std: str = "bt709", centre: float = 128.0, white: float = 255.0) -> DataFrame:
    """yy, u, v (around centre) whose red, green or blue is taken away: to RGB, without those channels, and back; clamped to 0..white."""
    moved = cells.select(*KEY, F.col("yy").cast("double").alias("yy"), (F.col("u") - centre).alias("u"), (F.col("v") - centre).alias("v"), "a")
    kept = select_channels(yuv_to_rgb(moved, std), r, g, b)
    out = rgb_to_yuv(kept, std)
    return out.select(*KEY, clamp(F.col("yy"), white).alias("yy"), *(clamp(F.col(c) + centre, white).alias(c) for c in "uv"), "a")


def srgb_to_linear(v: Column) -> Column:
    """v in 0..1"""
    return F.when(v > 0.04045, F.pow((v + 0.055) / 1.055, 2.4)).otherwise(v / 12.92)


def linear_to_srgb(v: Column) -> Column:
    return F.when(v > 0.0031308, 1.055 * F.pow(v, 1 / 2.4) - 0.055).otherwise(v * 12.92)


def _lab_f(t: Column) -> Column:
    return F.when(t > 0.008856451679035631, F.cbrt(t)).otherwise(t * 7.787037037037037 + 16.0 / 116.0)


def rgb_to_lab(cells: DataFrame, illuminant: str = "d65", white: float = 255.0, observer: int = 2) -> DataFrame:
    """L, la, lb of channels in 0..white (sRGB primaries)."""
    lin = [srgb_to_linear(F.col(c) / white) for c in RGB]
    xyz = _linear(tables.SRGB_TO_XYZ, lin)
    f = [_lab_f(c * 100.0 / w) for c, w in zip(xyz, tables.white_point(illuminant, observer), strict=True)]
    step = cells.select(*KEY, "a", *(c.alias(f"f{i}") for i, c in enumerate(f)))
    return step.select(*KEY, (116 * F.col("f1") - 16).alias("l"), (500 * (F.col("f0") - F.col("f1"))).alias("la"), (200 * (F.col("f1") - F.col("f2"))).alias("lb"), "a")


def lab_to_rgb(lab: DataFrame, illuminant: str = "d65", white: float = 255.0, observer: int = 2) -> DataFrame:
    """Channels in 0..white, clamped, not rounded."""
    fy = (F.col("l") + 16) / 116.0
    f = [fy + F.col("la") / 500.0, fy, fy - F.col("lb") / 200.0]
    back = lambda t: F.when(t > 6.0 / 29.0, t * t * t).otherwise((t - 16.0 / 116.0) / 7.787037037037037)
    xyz = [back(t) * w / 100.0 for t, w in zip(f, tables.white_point(illuminant, observer), strict=True)]
    lin = _linear(tables.XYZ_TO_SRGB, xyz)
    step = lab.select(*KEY, "a", *(clamp(c, 1.0).alias(n) for c, n in zip(lin, RGB, strict=True)))
    return step.select(*KEY, *((linear_to_srgb(F.col(c)) * white).alias(c) for c in RGB), "a")


def adjust_lab(cells: DataFrame, dl: float, da: float, db: float) -> DataFrame:
    lab = rgb_to_lab(cells)
    moved = lab.select(*KEY, F.least(F.greatest(F.col("l") + dl, F.lit(0.0)), F.lit(100.0)).alias("l"), *(F.least(F.greatest(F.col(c) + d, F.lit(-128.0)), F.lit(127.0)).alias(c) for c, d in (("la", da), ("lb", db))), "a")
    return lab_to_rgb(moved)


def _hue(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column, Column]:
    """(hue in degrees, largest, least, difference)"""
    hi, lo = F.greatest(r, g, b), F.least(r, g, b)
    d = hi - lo
    h = F.when(d == 0, 0.0).when(hi == r, 60.0 * F.pmod((g - b) / d, F.lit(6.0))).when(hi == g, 60.0 * ((b - r) / d + 2)).otherwise(60.0 * ((r - g) / d + 4))
    return h, hi, lo, d


def hue_space(space: str, white: float = 255.0) -> tuple[Column, Column, Column]:
    """(h, s, l) of HSL, HSV, HSI or HSP; h in degrees, s and l in 0..1."""
    r, g, b = (F.col(c) / white for c in RGB)
    h, hi, lo, d = _hue(r, g, b)
    level = {"hsl": (hi + lo) / 2, "hsv": hi, "hsi": (r + g + b) / 3, "hsp": F.sqrt(0.299 * r * r + 0.587 * g * g + 0.114 * b * b)}[space]
    s = {
        "hsl": F.when(d == 0, 0.0).otherwise(d / (1 - F.abs(hi + lo - 1))), "hsv": F.when(hi == 0, 0.0).otherwise(d / hi),
        "hsi": F.when(r + g + b == 0, 0.0).otherwise(1 - 3 * lo / (r + g + b)), "hsp": F.when(hi == 0, 0.0).otherwise(d / hi),
    }[space]
    return h, s, level


def to_hue_space(cells: DataFrame, space: str, white: float = 255.0) -> DataFrame:
    """h, s, l of HSL, HSV, HSI or HSP; h in degrees, s and l in 0..1."""
    return cells.select(*KEY, *(c.alias(n) for c, n in zip(hue_space(space, white), "hsl", strict=True)), "a")


def from_hue_space(hsl: DataFrame, space: str, white: float = 255.0) -> DataFrame:
    """r, g, b in 0..white of HSL, HSV, HSI or HSP; not clamped."""
    h, s, level = F.col("h") / 60.0, F.col("s"), F.col("l")
    middle = 1 - F.abs(F.pmod(h, F.lit(2.0)) - 1)
    sector = F.pmod(F.floor(h), F.lit(6))
    if space == "hsp":
        # lightness is a weighted length, so the weights of the largest, middle and least channel come by sector
        weights = dict(zip(RGB, (0.299, 0.587, 0.114), strict=True))
        part = 1 - s + s * middle
        length = [weights[hi] + weights[mid] * part * part + weights[lo] * (1 - s) * (1 - s) for hi, mid, lo in ("rgb", "grb", "gbr", "bgr", "brg", "rbg")]
        largest = level / F.sqrt(reduce(lambda c, i: c.when(sector == i, length[i]), range(1, 6), F.when(sector == 0, length[0])))
        chroma, base = largest * s, largest * (1 - s)
    else:
        chroma = {"hsl": (1 - F.abs(2 * level - 1)) * s, "hsv": level * s, "hsi": 3 * level * s / (1 + middle)}[space]
        base = {"hsl": level - chroma / 2, "hsv": level - chroma, "hsi": level * (1 - s)}[space]
    pick = lambda full, half: F.when(sector.isin(*full), chroma).when(sector.isin(*half), chroma * middle).otherwise(0.0)
    rgb = (pick((0, 5), (1, 4)), pick((1, 2), (0, 3)), pick((3, 4), (2, 5)))
    return hsl.select(*KEY, *(((c + base) * white).alias(n) for c, n in zip(rgb, RGB, strict=True)), "a")


def adjust_hue(cells: DataFrame, space: str, dh: float, ds: float, dl: float) -> DataFrame:
    """HSL, HSV, HSI or HSP moved: hue wraps, the others are clamped to 0..1, channels to 0..255 (not every intensity has every saturation)."""
    moved = to_hue_space(cells, space).select(*KEY, F.pmod(F.col("h") + dh, F.lit(360.0)).alias("h"), clamp(F.col("s") + ds, 1.0).alias("s"), clamp(F.col("l") + dl, 1.0).alias("l"), "a")
    return from_hue_space(moved, space).select(*KEY, *(clamp(F.col(c), 255.0).alias(c) for c in RGB), "a")


def adjust_cmyk(cells: DataFrame, dc: float, dm: float, dy: float, dk: float, white: float = 255.0) -> DataFrame:
    """Ink shares moved and clamped to 0..1."""
    hi = F.greatest(*_c(*RGB)) / white
    step = cells.select(*KEY, "a", (1 - hi).alias("k"), *(F.when(hi == 0, 0.0).otherwise((hi - F.col(c) / white) / hi).alias(f"i_{c}") for c in RGB))
    ink = {c: clamp(F.col(f"i_{c}") + d, 1.0) for c, d in zip(RGB, (dc, dm, dy), strict=True)}
    k = clamp(F.col("k") + dk, 1.0)
    return step.select(*KEY, *((white * (1 - ink[c]) * (1 - k)).alias(c) for c in RGB), "a")


def adjust_rgb(cells: DataFrame, dr: int, dg: int, db: int) -> DataFrame:
    return cells.select(*KEY, *(clamp(F.col(c) + d).alias(c) for c, d in zip(RGB, (dr, dg, db), strict=True)), "a")


def to_gray(cells: DataFrame, mode: str = "luma") -> DataFrame:
    """luma: integer weights. gamma: luminance of gamma 2.2 light."""
    if mode == "luma":
        return cells.select(*KEY, luma().alias("v"), "a")
    lin = [F.pow(F.col(c) / 255.0, 2.2) for c in RGB]
    return cells.select(*KEY, (255.0 * F.pow(0.2126 * lin[0] + 0.7152 * lin[1] + 0.0722 * lin[2], 1 / 2.2)).alias("v"), "a")


def apply_matrix3(cells: DataFrame, m: list[float]) -> DataFrame:
    """Any 3 x 3 matrix, clamped and truncated."""
    return cells.select(*KEY, *(F.floor(clamp(c, 255.0)).cast("int").alias(n) for c, n in zip(_linear(m, _c(*RGB)), RGB, strict=True)), "a")


def monotone(cells: DataFrame, color: tuple[int, int, int], std: str = "bt709") -> DataFrame:
    """The cell's luma with the chroma of one colour."""
    m = tables.RGB_TO_YUV[std]
    u, v = (sum(m[3 * i + j] * color[j] for j in range(3)) for i in (1, 2))
    yuv = rgb_to_yuv(cells, std).select(*KEY, "yy", F.lit(float(u)).alias("u"), F.lit(float(v)).alias("v"), "a")
    return yuv_to_rgb(yuv, std).select(*KEY, *(clamp(F.col(c), 255.0).alias(c) for c in RGB), "a")


def substitute_color(cells: DataFrame, old: tuple[int, int, int], new: tuple[int, int, int], tol: int, show_mask: bool = False) -> DataFrame:
    """Inside the open box around old: old + new - v, clamped; or a mask of 255 and 0."""
    inside = reduce(lambda a, b: a & b, ((F.col(c) > o - tol) & (F.col(c) < o + tol) for c, o in zip(RGB, old, strict=True)))
    if show_mask:
        return cells.select(*KEY, *(F.when(inside, 255).otherwise(0).alias(c) for c in RGB), "a")
    return cells.select(*KEY, *(F.when(inside, clamp(F.lit(o + n) - F.col(c))).otherwise(F.col(c)).alias(c) for c, o, n in zip(RGB, old, new, strict=True)), "a")


def gamma(cells: DataFrame, g: float, white: float = 255.0) -> DataFrame:
    return cells.select(*KEY, *(F.least(F.pow(F.col(c) / white, g) * white, F.lit(white)).alias(c) for c in RGB), "a")


def to_linear(cells: DataFrame, white: float = 255.0) -> DataFrame:
    return cells.select(*KEY, *(srgb_to_linear(F.col(c) / white).alias(c) for c in RGB), "a")


def to_srgb(cells: DataFrame, white: float = 255.0) -> DataFrame:
    return cells.select(*KEY, *((linear_to_srgb(F.col(c)) * white).alias(c) for c in RGB), "a")


def tone_curve(v: Column, kind: str) -> Column:
    """v in 0..1: bright (cube root of the square), dark (the square) or sigmoid around the middle."""
    return {"bright": F.cbrt(v * v), "dark": v * v, "sigmoid": 1 / (1 + F.exp(-10.0 * (v - 0.5)))}[kind]


def tone(cells: DataFrame, kind: str) -> DataFrame:
    """The curve on luma, chroma kept by adding the change to every channel."""
    v = luma() / 255.0
    step = cells.select("*", (255.0 * (tone_curve(v, kind) - v)).alias("dv"))
    return step.select(*KEY, *(clamp(F.col(c) + F.col("dv"), 255.0).alias(c) for c in RGB), "a")


def negate_luma(planes: DataFrame, white: int = 255) -> DataFrame:
    return planes.select(*KEY, (F.lit(white) - F.col("v")).alias("v"))


def residual_map(original: DataFrame, filtered: DataFrame, center: int = 128, amp: int = 8) -> DataFrame:
    """The amplified difference of two luma planes around a centre."""
    return original.join(filtered.withColumnRenamed("v", "f"), KEY).select(*KEY, clamp(F.lit(center) + amp * (F.col("v") - F.col("f"))).alias("v"))


def noise(seed: int, channel: int) -> Column:
    """0..255 from the key and a seed, the same in any order and partitioning (a linear congruence, so that SQL has it too)."""
    return F.pmod(F.shiftright(F.pmod((F.col("image_id") * 7919 + F.col("y") * 104729 + F.col("x") * 1299709 + channel * 15485863 + seed) * 1103515245 + 12345, F.lit(1 << 31)), 8), F.lit(256))


def augment_noise(cells: DataFrame, level: int, seed: int, mono: bool = False) -> DataFrame:
    """Blends level percent of noise into each channel."""
    return cells.select(*KEY, *(F.floor(((100 - level) * F.col(c) + level * noise(seed, 0 if mono else i)) / 100).cast("int").alias(c) for i, c in enumerate(RGB)), "a")


def bitonal(cells: DataFrame, threshold: int, white: int = 255) -> DataFrame:
    return cells.select(*KEY, F.when(luma() > threshold, white).otherwise(0).alias("v"))


def gamut_limits(spark: SparkSession, hues: int = 360) -> DataFrame:
    """iy, ih, limit: the largest whole chroma that sRGB shows at luminance iy / 100 and hue ih degrees; 100 x hues rows by rule."""
    y, h = np.meshgrid((np.arange(100) + 0.5) / 100, np.radians(np.arange(hues)), indexing="ij")
    fy = np.where(y > 0.008856451679035631, np.cbrt(y), y * 7.787037037037037 + 16 / 116)
    limit = np.zeros(y.shape, dtype=int)
    back = lambda t: np.where(t > 6 / 29, t**3, (t - 16 / 116) / 7.787037037037037)
    for c in range(1, 201):
        xyz = np.stack([back(fy + c * np.cos(h) / 500) * tables.ILLUMINANTS["d65"][0] / 100, y, back(fy - c * np.sin(h) / 200) * tables.ILLUMINANTS["d65"][2] / 100])
        rgb = np.einsum("ij,jyh->iyh", np.array(tables.XYZ_TO_SRGB).reshape(3, 3), xyz)
        limit[((rgb >= -0.001) & (rgb <= 1.001)).all(0)] = c
    rows = pd.DataFrame({"iy": np.repeat(np.arange(100), hues), "ih": np.tile(np.arange(hues), 100), "limit": limit.ravel()})
    return spark.createDataFrame(rows, "iy long, ih long, limit int")


def limited_hue_boost(cells: DataFrame, alpha: float = 10.0, lightness: float = 1.2) -> DataFrame:
    """Chroma grows by up to four times around red hues where it is high for its image; what sRGB can't show is cut back to what it can.

    Pass 1: the largest chroma of each image. Pass 2: the gain, a power on lightness, and for cells out of gamut the least
    limit of the four table entries around their luminance and hue.
    """
    lab = rgb_to_lab(cells)
    chroma = lambda a, b: F.sqrt(a * a + b * b)
    most = lab.groupBy("image_id").agg(F.max(chroma(F.col("la"), F.col("lb"))).alias("most"))
    share = F.when(F.col("most") > 0, chroma(F.col("la"), F.col("lb")) / F.col("most")).otherwise(0.0)
    hue = F.degrees(F.atan2("lb", "la"))
    gain = 1 + 3 * clamp((share - 0.2) / 0.6, 1.0) * F.exp(-alpha * F.pow(hue / 180.0, 2))
    boosted = lab.join(most, "image_id").select(*KEY, "a", (100 * F.pow(F.greatest("l", F.lit(0.0)) / 100.0, 1 / lightness)).alias("l"), (gain * F.col("la")).alias("la"), (gain * F.col("lb")).alias("lb"))
    fy = (F.col("l") + 16) / 116.0
    back = lambda t: F.when(t > 6.0 / 29.0, t * t * t).otherwise((t - 16.0 / 116.0) / 7.787037037037037)
    xyz = [back(t) * w / 100.0 for t, w in zip((fy + F.col("la") / 500.0, fy, fy - F.col("lb") / 200.0), tables.ILLUMINANTS["d65"], strict=True)]
    rgb = _linear(tables.XYZ_TO_SRGB, xyz)
    shown = reduce(lambda p, q: p & q, ((c >= -0.001) & (c <= 1.001) for c in rgb))
    step = boosted.select(*KEY, "a", "l", "la", "lb", shown.alias("shown"), F.least(F.floor(100 * xyz[1]), F.lit(98)).alias("iy"), F.floor(F.pmod(F.degrees(F.atan2("lb", "la")), F.lit(360.0))).alias("ih"))
    limits = gamut_limits(cells.sparkSession)
    corners = [limits.select((F.col("iy") - dy).alias("iy"), F.pmod(F.col("ih") - dh, F.lit(360)).alias("ih"), "limit") for dy in (0, 1) for dh in (0, 1)]
    around = reduce(DataFrame.unionByName, corners).groupBy("iy", "ih").agg(F.min("limit").alias("limit"))
    met = step.join(around, ["iy", "ih"], "left")
    scale = F.when(F.col("shown") | F.col("limit").isNull(), 1.0).otherwise(F.least(F.lit(1.0), F.col("limit") / F.greatest(chroma(F.col("la"), F.col("lb")), F.lit(1e-9))))
    return lab_to_rgb(met.select(*KEY, "a", "l", (scale * F.col("la")).alias("la"), (scale * F.col("lb")).alias("lb")))
