"""HSLuv and HPLuv: hue, saturation as a share of the chroma that fits, lightness; all column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.cells import KEY, clamp
from .local import _linear, linear_to_srgb, srgb_to_linear

#: The public definition's numbers (fixed values).
TO_RGB = [3.240969941904521, -1.537383177570093, -0.498610760293, -0.96924363628087, 1.87596750150772, 0.041555057407175, 0.055630079696993, -0.20397695888897, 1.056971514242878]
TO_XYZ = [0.41239079926595, 0.35758433938387, 0.18048078840183, 0.21263900587151, 0.71516867876775, 0.072192315360733, 0.019330818715591, 0.11919477979462, 0.95053215224966]
REF_U, REF_V, KAPPA, EPSILON = 0.19783000664283681, 0.468319994938791, 903.2962962962963, 0.0088564516790356308


def _lines(level: Column) -> list[tuple[Column, Column]]:
    """(slope, intercept) of the six lines that bound the gamut at a lightness, in the plane of u and v."""
    sub1 = F.pow(level + 16, 3) / 1560896
    sub2 = F.when(sub1 > EPSILON, sub1).otherwise(level / KAPPA)
    out = []
    for i in range(3):
        m1, m2, m3 = TO_RGB[3 * i : 3 * i + 3]
        for t in (0, 1):
            bottom = (632260 * m3 - 126452 * m2) * sub2 + 126452 * t
            top = (838422 * m3 + 769860 * m2 + 731718 * m1) * level * sub2 - 769860 * t * level
            out.append(((284517 * m1 - 94839 * m3) * sub2 / bottom, top / bottom))
    return out


def most_chroma(level: Column, hue: Column, pastel: bool) -> Column:
    """The largest chroma at this lightness: at this hue, or (pastel) at every hue."""
    if pastel:
        return F.least(*[F.abs(b) / F.sqrt(a * a + 1) for a, b in _lines(level)])
    h = F.radians(hue)
    lengths = [b / (F.sin(h) - a * F.cos(h)) for a, b in _lines(level)]
    return F.least(*[F.when(x >= 0, x) for x in lengths])


def to_hsluv(cells: DataFrame, pastel: bool = False, white: float = 255.0) -> DataFrame:
    """h in degrees, s and l in 0..100 of HSLuv, or of HPLuv where pastel."""
    x, y, z = _linear(TO_XYZ, [srgb_to_linear(F.col(c) / white) for c in "rgb"])
    step = cells.select(*KEY, "a", x.alias("cx"), y.alias("cy"), z.alias("cz"))
    level = F.when(F.col("cy") <= EPSILON, F.col("cy") * KAPPA).otherwise(116 * F.cbrt("cy") - 16)
    total = F.col("cx") + 15 * F.col("cy") + 3 * F.col("cz")
    luv = step.select(*KEY, "a", level.alias("l"), *(F.when(total == 0, 0.0).otherwise(13 * level * (k * F.col(c) / total - ref)).alias(n) for n, k, c, ref in (("u", 4, "cx", REF_U), ("v", 9, "cy", REF_V))))
    chroma = F.sqrt(F.col("u") * F.col("u") + F.col("v") * F.col("v"))
    lch = luv.select(*KEY, "a", "l", F.when(chroma < 1e-8, 0.0).otherwise(chroma).alias("c"), F.when(chroma < 1e-8, 0.0).otherwise(F.pmod(F.degrees(F.atan2("v", "u")), F.lit(360.0))).alias("h"))
    full, none = F.col("l") > 99.9999999, F.col("l") < 1e-8
    s = F.when(full | none, 0.0).otherwise(F.col("c") / most_chroma(F.col("l"), F.col("h"), pastel) * 100)
    return lch.select(*KEY, "h", s.alias("s"), F.when(full, 100.0).when(none, 0.0).otherwise(F.col("l")).alias("l"), "a")


def from_hsluv(hsl: DataFrame, pastel: bool = False, white: float = 255.0) -> DataFrame:
    """r, g, b in 0..white, clamped, not rounded."""
    full, none = F.col("l") > 99.9999999, F.col("l") < 1e-8
    chroma = F.when(full | none, 0.0).otherwise(most_chroma(F.col("l"), F.col("h"), pastel) / 100 * F.col("s"))
    luv = hsl.select(*KEY, "a", "l", (chroma * F.cos(F.radians("h"))).alias("u"), (chroma * F.sin(F.radians("h"))).alias("v"))
    y = F.when(F.col("l") <= 8, F.col("l") / KAPPA).otherwise(F.pow((F.col("l") + 16) / 116, 3))
    nu, nv = F.col("u") / (13 * F.col("l")) + REF_U, F.col("v") / (13 * F.col("l")) + REF_V
    x = 9 * y * nu / (4 * nv)
    xyz = luv.select(*KEY, "a", *(F.when(F.col("l") < 1e-8, 0.0).otherwise(c).alias(n) for n, c in (("cx", x), ("cy", y), ("cz", (9 * y - 15 * nv * y - nv * x) / (3 * nv)))))
    lin = _linear(TO_RGB, [F.col(c) for c in ("cx", "cy", "cz")])
    return xyz.select(*KEY, *((linear_to_srgb(clamp(c, 1.0)) * white).alias(n) for c, n in zip(lin, "rgb", strict=True)), "a")


def adjust_hsluv(cells: DataFrame, dh: float, ds: float, dl: float, pastel: bool = False) -> DataFrame:
    """Hue wraps, saturation and lightness are clamped to 0..100."""
    moved = to_hsluv(cells, pastel).select(*KEY, F.pmod(F.col("h") + dh, F.lit(360.0)).alias("h"), clamp(F.col("s") + ds, 100.0).alias("s"), clamp(F.col("l") + dl, 100.0).alias("l"), "a")
    return from_hsluv(moved, pastel)


def channel_summary(column: str) -> Column:
    """A named bundle of aggregates of one channel, as a struct."""
    c = F.col(column)
    return F.struct(F.count(c).alias("n"), F.sum(c).alias("total"), F.min(c).alias("low"), F.max(c).alias("high"), F.avg(c).alias("mean"), F.stddev_pop(c).alias("std"))
