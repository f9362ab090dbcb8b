"""Raster operators as queries over the driver's tables, and independently written SQL for each."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sql
from .functions import tables
from .operators import denoise, focal, geometry, graph, local, nearest, perceptual, segment, spectral, stats, zonal
from .plans.focal import around, focal_udf, tile_with_halo, untile
from .plans.iterate import saved, shared_path
from .sources import cells as src
from .sources.cells import CELLS_SQL, KEY
from .sources.files import write_files
from .sources.frames import read_frame_files, write_frame_files
from .streaming import frames, live

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
DIGITS = 6


def register(name: str, over: str, sql: str | None, fn: Callable[[DataFrame], DataFrame]) -> None:
    """over: 'cells' or 'luma'. sql follows the fixture's own text; doubles are rounded on both sides."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        cells = src.from_lineitem(spark, sf_dir)
        out = fn(cells if over == "cells" else src.with_luma(cells))
        return out.select(*(F.round(c, DIGITS).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes))

    QUERIES[name] = query
    if sql:
        SQL[name] = f"{CELLS_SQL}{sql}" if sql.lstrip().startswith(",") else f"{CELLS_SQL}\n{sql}"


def _rgb(template: str) -> str:
    return ", ".join(template.replace("$c", c) for c in "rgb")


# --- layout -------------------------------------------------------------------------------------
register("crop", "cells", "SELECT * FROM cells WHERE y BETWEEN 8 AND 39 AND x BETWEEN 16 AND 47", lambda c: src.crop(c, 8, 40, 16, 48))
register("select_channels", "cells", "SELECT image_id, y, x, r, 0 AS g, b, a FROM cells", lambda c: src.select_channels(c, True, False, True))
register("normalize_format", "cells", f"SELECT image_id, y, x, {_rgb('round($c / (CASE WHEN image_id % 2 = 0 THEN 255.0::DOUBLE ELSE 1023 END), 6) AS $c')}, round(a / (CASE WHEN image_id % 2 = 0 THEN 255.0::DOUBLE ELSE 1023 END), 6) AS a FROM cells",
         lambda c: src.normalize_format(c, F.when(F.col("image_id") % 2 == 0, "8u").otherwise("10u")))
def _yuv_sql(matrix: list[float], source: str, scale: str = "") -> str:
    row = lambda i: " + ".join(f"{v!r}::DOUBLE * {c}" for v, c in zip(matrix[3 * i : 3 * i + 3], "rgb", strict=True))
    return f"SELECT image_id, y, x, round({row(0)}, 6) + 0.0 AS yy, round({row(1)}, 6) + 0.0 AS u, round({row(2)}, 6) + 0.0 AS v, a FROM {source}"


_SIX = lambda df: df.select(*KEY, *((F.round(k, 6) + 0.0).alias(k) for k in ("yy", "u", "v")), "a")
for _std in ("bt601", "bt2020", "smpte240"):
    register(f"rgb_to_yuv_{_std}", "cells", _yuv_sql(tables.RGB_TO_YUV[_std], "cells"), lambda c, s=_std: _SIX(local.rgb_to_yuv(c, s)))
_UNITS = ", ".join(f"{c} / (CASE WHEN image_id % 2 = 0 THEN 255.0::DOUBLE ELSE 1023 END) AS {c}" for c in "rgba")
register("normalize_yuv", "cells", f", units AS (SELECT image_id, y, x, {_UNITS} FROM cells) SELECT image_id, y, x, yy, u, v, round(a, 6) AS a FROM (" + _yuv_sql(tables.RGB_TO_YUV["bt709"], "units WHERE image_id % 3 <> 0") + " UNION ALL " + _yuv_sql(tables.RGB_TO_YUV["bt2020"], "units WHERE image_id % 3 = 0") + ")",
         lambda c: _SIX(local.normalized_yuv(c, F.when(F.col("image_id") % 2 == 0, "8u").otherwise("10u"), F.when(F.col("image_id") % 3 == 0, "bt2020").otherwise("bt709"))))
register("select_channels_yuv", "cells", """, q AS (SELECT image_id, y, x, a, r::DOUBLE + 1.5748021 * (b - 128) AS cr, r::DOUBLE + 1.85559927 * (g - 128) AS cb FROM cells)
SELECT image_id, y, x, round(least(greatest(0.2126 * cr + 0.0722 * cb, 0), 255), 6) + 0.0 AS yy, round(least(greatest(-0.11457 * cr + 0.5 * cb + 128, 0), 255), 6) + 0.0 AS u, round(least(greatest(0.5 * cr - 0.04585 * cb + 128, 0), 255), 6) + 0.0 AS v, a FROM q""",
         lambda c: _SIX(local.select_channels_yuv(c.select(*KEY, F.col("r").alias("yy"), F.col("g").alias("u"), F.col("b").alias("v"), "a"), True, False, True)))
register("cct_reference", "cells", "SELECT 1000 + 25 * (y * 64 + x) AS cct, r, g, b FROM cells WHERE (1000 + 25 * (y * 64 + x)) % 100 = 0 AND 1000 + 25 * (y * 64 + x) < 100000 AND x % 3 <> 0",
         lambda c: src.build_cct_reference(c.select(F.format_string("%s%d K  %d %d  %d", F.when(F.col("x") % 3 == 0, "x").otherwise(" "), 1000 + 25 * (F.col("y") * 64 + F.col("x")), "r", "g", "b").alias("value"))))
register("unpack_10u", "cells", "SELECT image_id, y, x, r * 4194304 + g * 4096 + b * 4 AS p, r, g, b FROM cells",
         lambda c: src.unpack_10u(c.select(*KEY, (F.col("r") * 4194304 + F.col("g") * 4096 + F.col("b") * 4).alias("p"))))
register("stored_format", "cells", f"SELECT image_id, y, x, {_rgb('CAST(floor(least(greatest(($c - 20) / 220.0::DOUBLE, 0), 1) * 32767 + 0.5) AS INT) AS $c')}, 32767 AS a FROM cells",
         lambda c: src.stored_format(c.select(*KEY, *(((F.col(k) - 20) / 220.0).alias(k) for k in "rgb"), F.lit(1.0).alias("a")), "16u"))
register("tile_round_trip", "luma", "SELECT * FROM lumas", lambda p: untile(tile_with_halo(p, 16, 2, "clamp"), 16).select(*KEY, "v"))
register("tile_sizes", "luma", """
SELECT image_id, ty, tx, CAST(400 AS INT) AS n, CAST(sum(v) AS BIGINT) AS total FROM (
  SELECT l.image_id, t.v AS ty, u.v AS tx, l.v FROM lumas l, range(4) t(v), range(4) u(v), range(-2, 18) dy(o), range(-2, 18) dx(o)
  WHERE l.y = least(greatest(t.v * 16 + dy.o, 0), 63) AND l.x = least(greatest(u.v * 16 + dx.o, 0), 63)) GROUP BY ALL""",
         lambda p: tile_with_halo(p, 16, 2, "clamp").select("image_id", "ty", "tx", F.size("cells").alias("n"), F.aggregate("cells", F.lit(0).cast("long"), lambda a, c: a + c["v"]).alias("total")))
register("apply_params", "cells", "SELECT image_id, y, x, r, g, b, a, CASE WHEN image_id % 3 = 0 THEN CAST(image_id AS DOUBLE) ELSE 1.5 END AS gain FROM cells",
         lambda c: src.apply_params(c, c.where("image_id % 3 = 0").select("image_id", F.lit("gain").alias("name"), F.col("image_id").cast("double").alias("value")).distinct(), {"gain": 1.5}))

# --- local --------------------------------------------------------------------------------------
_Y = "0.2126 * r + 0.7152 * g + 0.0722 * b"
register("rgb_to_yuv", "cells", f"SELECT image_id, y, x, round({_Y}, 6) AS yy, round(-0.11457 * r - 0.38543 * g + 0.5 * b, 6) AS u, round(0.5 * r - 0.45415 * g - 0.04585 * b, 6) AS v, a FROM (SELECT * REPLACE (r::DOUBLE AS r, g::DOUBLE AS g, b::DOUBLE AS b) FROM cells)",
         lambda c: local.rgb_to_yuv(c))
register("yuv_to_rgb", "cells", "SELECT image_id, y, x, round(r::DOUBLE + 1.5748021 * b, 3) AS r, round(r::DOUBLE - 0.18732698 * g - 0.468124 * b, 3) AS g, round(r::DOUBLE + 1.85559927 * g, 3) AS b, a FROM cells",
         lambda c: local.yuv_to_rgb(c.select(*KEY, F.col("r").alias("yy"), F.col("g").alias("u"), F.col("b").alias("v"), "a")).select(*KEY, *(F.round(k, 3).alias(k) for k in "rgb"), "a"))
_LIN = "CASE WHEN $c / 255.0::DOUBLE > 0.04045 THEN pow(($c / 255.0::DOUBLE + 0.055) / 1.055, 2.4) ELSE $c / 255.0::DOUBLE / 12.92 END AS $c"
_LAB = f""", lin AS (SELECT image_id, y, x, {_rgb(_LIN)}, a FROM cells),
xyz AS (SELECT *, (0.4124564 * r + 0.3575761 * g + 0.1804375 * b) * 100 / 95.047 AS p, (0.2126729 * r + 0.7151522 * g + 0.072175 * b) AS q, (0.0193339 * r + 0.119192 * g + 0.9503041 * b) * 100 / 108.883 AS s FROM lin),
f AS (SELECT *, {', '.join(f'CASE WHEN {k} > 0.008856451679035631 THEN cbrt({k}) ELSE {k} * 7.787037037037037 + 16.0 / 116 END AS f{k}' for k in 'pqs')} FROM xyz)"""
register("rgb_to_lab", "cells", f"{_LAB} SELECT image_id, y, x, round(116 * fq - 16, 6) AS l, round(500 * (fp - fq), 6) AS la, round(200 * (fq - fs), 6) AS lb, a FROM f", lambda c: local.rgb_to_lab(c))
register("lab_round_trip", "cells", "SELECT image_id, y, x, r, g, b, a FROM cells", lambda c: local.lab_to_rgb(local.rgb_to_lab(c)).select(*KEY, *(F.round(k).cast("int").alias(k) for k in "rgb"), "a"))
register("adjust_rgb", "cells", f"SELECT image_id, y, x, least(greatest(r + 30, 0), 255) AS r, least(greatest(g - 40, 0), 255) AS g, least(greatest(b + 10, 0), 255) AS b, a FROM cells", lambda c: local.adjust_rgb(c, 30, -40, 10))
register("adjust_lab", "cells", sql.lab_back(f"{_LAB}, m AS (SELECT image_id, y, x, a, {sql.clamped('116 * fq - 16 + 5', 100)} AS l, least(greatest(500 * (fp - fq) - 3, -128), 127) AS la, least(greatest(200 * (fq - fs) + 2, -128), 127) AS lb FROM f)"), lambda c: local.adjust_lab(c, 5.0, -3.0, 2.0))
_AS_LAB = {"l": "r * 100 / 255.0", "la": "(g - 128) * 0.5", "lb": "(b - 128) * 0.5"}
register("lab_to_rgb", "cells", sql.lab_back(", m AS (SELECT image_id, y, x, a, " + ", ".join(f"({e.replace('255.0', '255.0::DOUBLE').replace('0.5', '0.5::DOUBLE')}) AS {n}" for n, e in _AS_LAB.items()) + " FROM cells)"),
         lambda c: local.lab_to_rgb(c.selectExpr(*KEY, "a", *(f"double({e.replace('255.0', 'double(255)').replace('0.5', 'double(0.5)')}) AS {n}" for n, e in _AS_LAB.items()))))
register("rgb_to_lab_10", "cells", f"{_LAB}, t AS (SELECT *, {', '.join(f'{k} * {two!r} / {ten!r} AS t{k}' for k, two, ten in zip('pqs', tables.ILLUMINANTS['d65'], tables.ILLUMINANTS_10['d65'], strict=True))} FROM xyz), u AS (SELECT *, {', '.join(f'CASE WHEN t{k} > 0.008856451679035631 THEN cbrt(t{k}) ELSE t{k} * 7.787037037037037 + 16.0 / 116 END AS f{k}' for k in 'pqs')} FROM t) SELECT image_id, y, x, round(116 * fq - 16, 6) AS l, round(500 * (fp - fq), 6) AS la, round(200 * (fq - fs), 6) AS lb, a FROM u",
         lambda c: local.rgb_to_lab(c, observer=10))
_HUE = """, q AS (SELECT image_id, y, x, a, r / 255.0::DOUBLE AS r, g / 255.0::DOUBLE AS g, b / 255.0::DOUBLE AS b FROM cells),
e AS (SELECT *, greatest(r, g, b) AS hi, least(r, g, b) AS lo, greatest(r, g, b) - least(r, g, b) AS d FROM q),
h AS (SELECT *, CASE WHEN d = 0 THEN 0 WHEN hi = r THEN CASE WHEN g >= b THEN 60 * (g - b) / d ELSE 360 + 60 * (g - b) / d END WHEN hi = g THEN 120 + 60 * (b - r) / d ELSE 240 + 60 * (r - g) / d END AS h FROM e)"""
for _space, _s, _l in (
    ("hsl", "CASE WHEN d = 0 THEN 0 ELSE d / (1 - abs(hi + lo - 1)) END", "(hi + lo) / 2"),
    ("hsv", "CASE WHEN hi = 0 THEN 0 ELSE d / hi END", "hi"),
    ("hsi", "CASE WHEN r + g + b = 0 THEN 0 ELSE 1 - 3 * lo / (r + g + b) END", "(r + g + b) / 3"),
    ("hsp", "CASE WHEN hi = 0 THEN 0 ELSE d / hi END", "sqrt(0.299 * r * r + 0.587 * g * g + 0.114 * b * b)"),
):
    register(f"to_{_space}", "cells", f"{_HUE} SELECT image_id, y, x, round(h, 6) AS h, round({_s}, 6) AS s, round({_l}, 6) AS l, a FROM h", lambda c, s=_space: local.to_hue_space(c, s))
_SL = {
    "hsl": ("CASE WHEN d = 0 THEN 0 ELSE d / (1 - abs(hi + lo - 1)) END", "(hi + lo) / 2"), "hsv": ("CASE WHEN hi = 0 THEN 0 ELSE d / hi END", "hi"),
    "hsi": ("CASE WHEN r + g + b = 0 THEN 0 ELSE 1 - 3 * lo / (r + g + b) END", "(r + g + b) / 3"), "hsp": ("CASE WHEN hi = 0 THEN 0 ELSE d / hi END", "sqrt(0.299 * r * r + 0.587 * g * g + 0.114 * b * b)"),
}
for _space, (_s, _l) in _SL.items():
    register(f"{_space}_round_trip", "cells", "SELECT image_id, y, x, r, g, b, a FROM cells", lambda c, s=_space: local.from_hue_space(local.to_hue_space(c, s), s).select(*KEY, *(F.round(k).cast("int").alias(k) for k in "rgb"), "a"))
    _moved = f"{_HUE}, m AS (SELECT image_id, y, x, a, (h + 200) % 360 AS h, {sql.clamped(f'{_s} + 0.1')} AS s, {sql.clamped(f'{_l} - 0.05')} AS l FROM h)"
    register(f"adjust_{_space}", "cells", sql.hue_back(_space, _moved).replace("{clamp}255 * (", "least(greatest(").replace("){end}", ", 0), 1)"), lambda c, s=_space: local.adjust_hue(c, s, 200.0, 0.1, -0.05).select(*KEY, *((F.col(k) / 255).alias(k) for k in "rgb"), "a"))
    register(f"{_space}_to_rgb", "cells", sql.hue_back(_space, ", m AS (SELECT image_id, y, x, a, r * 7 / 5.0::DOUBLE AS h, g / 255.0::DOUBLE AS s, b / 255.0::DOUBLE AS l FROM cells)").replace("{clamp}", "").replace("{end}", ""),
             lambda c, s=_space: local.from_hue_space(c.select(*KEY, "a", (F.col("r") * 7 / 5.0).alias("h"), (F.col("g") / 255.0).alias("s"), (F.col("b") / 255.0).alias("l")), s))
register("adjust_cmyk", "cells", f""", k AS (SELECT *, 1 - greatest(r, g, b) / 255.0::DOUBLE AS k FROM cells),
i AS (SELECT *, {', '.join(f'CASE WHEN k = 1 THEN 0 ELSE (1 - k - {c} / 255.0::DOUBLE) / (1 - k) END AS i{c}' for c in 'rgb')} FROM k)
SELECT image_id, y, x, {', '.join(f'round(255 * (1 - least(greatest(i{c} + {d}, 0), 1)) * (1 - least(greatest(k - 0.05, 0), 1)), 6) AS {c}' for c, d in zip('rgb', ('0.1', '-0.2', '0.0'), strict=True))}, a FROM i""",
         lambda c: local.adjust_cmyk(c, 0.1, -0.2, 0.0, -0.05))
register("to_gray", "cells", "SELECT image_id, y, x, v, 255 AS a FROM lumas", lambda c: local.to_gray(c))
register("to_gray_gamma", "cells", "SELECT image_id, y, x, round(255 * pow(0.2126 * pow(r / 255.0::DOUBLE, 2.2) + 0.7152 * pow(g / 255.0::DOUBLE, 2.2) + 0.0722 * pow(b / 255.0::DOUBLE, 2.2), 1 / 2.2::DOUBLE), 6) AS v, a FROM cells", lambda c: local.to_gray(c, "gamma"))
register("sepia", "cells", "SELECT image_id, y, x, CAST(floor(least(0.393::DOUBLE * r + 0.769::DOUBLE * g + 0.189::DOUBLE * b, 255)) AS INT) AS r, CAST(floor(least(0.349::DOUBLE * r + 0.686::DOUBLE * g + 0.168::DOUBLE * b, 255)) AS INT) AS g, CAST(floor(least(0.272::DOUBLE * r + 0.534::DOUBLE * g + 0.131::DOUBLE * b, 255)) AS INT) AS b, a FROM cells",
         lambda c: local.apply_matrix3(c, tables.SEPIA))
register("monotone", "cells", f""", y AS (SELECT image_id, y, x, a, {_Y} AS l, -0.11457 * 200 - 0.38543 * 120 + 0.5 * 40 AS u, 0.5 * 200 - 0.45415 * 120 - 0.04585 * 40 AS v FROM (SELECT * REPLACE (r::DOUBLE AS r, g::DOUBLE AS g, b::DOUBLE AS b) FROM cells))
SELECT image_id, y, x, round(least(greatest(l + 1.5748021 * v, 0), 255), 6) AS r, round(least(greatest(l - 0.18732698 * u - 0.468124 * v, 0), 255), 6) AS g, round(least(greatest(l + 1.85559927 * u, 0), 255), 6) AS b, a FROM y""",
         lambda c: local.monotone(c, (200, 120, 40)))
_BOX = "abs(r - 120) < 60 AND abs(g - 100) < 60 AND abs(b - 90) < 60"
register("substitute_color", "cells", f"SELECT image_id, y, x, {', '.join(f'CASE WHEN {_BOX} THEN least(greatest({s} - {c}, 0), 255) ELSE {c} END AS {c}' for c, s in zip('rgb', (320, 150, 100), strict=True))}, a FROM cells",
         lambda c: local.substitute_color(c, (120, 100, 90), (200, 50, 10), 60))
register("substitute_mask", "cells", f"SELECT image_id, y, x, {_rgb(f'CASE WHEN {_BOX} THEN 255 ELSE 0 END AS $c')}, a FROM cells", lambda c: local.substitute_color(c, (120, 100, 90), (200, 50, 10), 60, True))
register("gamma", "cells", f"SELECT image_id, y, x, {_rgb('round(least(255 * pow($c / 255.0::DOUBLE, 0.8), 255), 6) AS $c')}, a FROM cells", lambda c: local.gamma(c, 0.8))
register("srgb_to_linear", "cells", f"{_LAB} SELECT image_id, y, x, {_rgb('round($c, 6) AS $c')}, a FROM lin", lambda c: local.to_linear(c))
register("linear_to_srgb_curve", "cells", f"SELECT image_id, y, x, {_rgb('round(255 * (' + sql.TO_SRGB.format(c='($c / 255.0::DOUBLE)') + '), 6) AS $c')}, a FROM cells", lambda c: local.to_srgb(c.select(*KEY, *((F.col(k) / 255.0).alias(k) for k in "rgb"), "a")))
register("linear_to_srgb", "cells", "SELECT image_id, y, x, r, g, b, a FROM cells", lambda c: local.to_srgb(local.to_linear(c)).select(*KEY, *(F.round(k).cast("int").alias(k) for k in "rgb"), "a"))
for _kind, _f in (("bright", "cbrt(t * t)"), ("dark", "t * t"), ("sigmoid", "1 / (1 + exp(-10 * (t - 0.5)))")):
    register(f"tone_{_kind}", "cells", f", t AS (SELECT *, CAST(floor((2126 * r + 7152 * g + 722 * b) / 10000.0) AS INT) / 255.0::DOUBLE AS t FROM cells) SELECT image_id, y, x, {_rgb(f'round(least(greatest($c + 255 * ({_f} - t), 0), 255), 6) AS $c')}, a FROM t",
             lambda c, k=_kind: local.tone(c, k))
register("negate_luma", "luma", "SELECT image_id, y, x, 255 - v AS v FROM lumas", lambda p: local.negate_luma(p))
register("residual_map", "luma", """, n AS (SELECT l.image_id, l.y, l.x, any_value(l.v) AS v, max(m.v) AS f FROM lumas l JOIN lumas m ON l.image_id = m.image_id AND l.y = m.y AND abs(l.x - m.x) <= 1 GROUP BY l.image_id, l.y, l.x)
SELECT image_id, y, x, least(greatest(128 + 8 * (v - f), 0), 255) AS v FROM n""", lambda p: local.residual_map(p, focal.dilate(p, "horizontal", 3)))  # fmt: skip
_NOISE = "((((image_id * 7919 + y * 104729 + x * 1299709 + {k} * 15485863 + {s}) * 1103515245 + 12345) % 2147483648) >> 8) % 256"
register("augment_noise", "cells", f"SELECT image_id, y, x, {', '.join(f'CAST((80 * {c} + 20 * ({_NOISE.format(k=i, s=3)})) // 100 AS INT) AS {c}' for i, c in enumerate('rgb'))}, a FROM cells", lambda c: local.augment_noise(c, 20, 3))
register("bitonal", "cells", "SELECT image_id, y, x, CASE WHEN v > 90 THEN 255 ELSE 0 END AS v FROM lumas", lambda c: local.bitonal(c, 90))

# --- geometry -----------------------------------------------------------------------------------
register("flip_both", "cells", "SELECT image_id, 63 - y AS y, 63 - x AS x, r, g, b, a FROM cells", lambda c: geometry.flip(c, True, True))
register("flip_horizontal", "cells", "SELECT image_id, y, 63 - x AS x, r, g, b, a FROM cells", lambda c: geometry.flip(c, True, False))
register("mirror", "cells", "SELECT t.image_id, t.y, t.x, s.r, s.g, s.b, s.a FROM cells t JOIN cells s ON s.image_id = t.image_id AND s.y = least(t.y, 63 - t.y) AND s.x = least(t.x, 63 - t.x)", lambda c: geometry.mirror(c, True, True))
register("block_shuffle", "cells", """, b AS (SELECT DISTINCT image_id, y // 16 * 4 + x // 16 AS k FROM cells),
m AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY ((k * 40503 + image_id * 9973 + 11) * 1103515245 + 12345) % 2147483648, k) - 1 AS t FROM b)
SELECT c.image_id, t // 4 * 16 + y % 16 AS y, t % 4 * 16 + x % 16 AS x, r, g, c.b, a FROM cells c JOIN m ON m.image_id = c.image_id AND m.k = y // 16 * 4 + x // 16""", lambda c: geometry.block_shuffle(c, 4, 11))  # fmt: skip
_BY, _BX = "(CASE WHEN y < 44 THEN y // 11 ELSE 4 + (y - 44) // 10 END)", "(CASE WHEN x < 10 THEN 0 ELSE 1 + (x - 10) // 9 END)"
register("resample_blocks", "cells", f"SELECT image_id, {_BY} AS y, {_BX} AS x, {_rgb('round(avg($c), 6) AS $c')} FROM cells GROUP BY 1, {_BY}, {_BX}", lambda c: geometry.resample_blocks(c, 6, 7))
register("pixelate", "cells", f"SELECT image_id, y, x, {_rgb(f'round(avg($c) OVER (PARTITION BY image_id, {_BY}, {_BX}), 6) AS $c')}, a FROM cells", lambda c: geometry.pixelate(c, 6, 7))
register("augment_displace", "cells", f"""SELECT t.image_id, t.y, t.x, s.r, s.g, s.b, s.a FROM (
  SELECT *, least(greatest(y + ({_NOISE.format(k=1, s=5)}) % 7 - 3, 0), 63) AS sy, least(greatest(x + ({_NOISE.format(k=2, s=5)}) % 7 - 3, 0), 63) AS sx FROM cells) t
  JOIN cells s ON s.image_id = t.image_id AND s.y = t.sy AND s.x = t.sx""", lambda c: geometry.augment_displace(c, 3, 5))  # fmt: skip

# --- global -------------------------------------------------------------------------------------
register("histogram", "cells", "SELECT image_id, channel, CAST(bin AS INT) AS bin, count(*) AS n FROM (UNPIVOT (SELECT image_id, r, g, b FROM cells) ON r, g, b INTO NAME channel VALUE bin) GROUP BY ALL", lambda c: stats.histogram(c))
_DENSE = """, d AS (SELECT image_id, CAST(bin.v AS INT) AS bin, coalesce(n, 0) AS n FROM (SELECT DISTINCT image_id FROM lumas) i CROSS JOIN (SELECT range AS v FROM range(256)) bin
  LEFT JOIN (SELECT image_id, v, count(*) AS n FROM lumas GROUP BY ALL) h USING (image_id, v))"""
register("binarize_hist", "cells", f"{_DENSE} SELECT image_id, bin, CAST(n > 1 AS BIGINT) AS n FROM d", lambda c: stats.binarize_hist(stats.luma_histogram(c)))
register("cumulative_hist", "cells", f"{_DENSE} SELECT p.image_id, p.bin, any_value(p.n) AS n, CAST(sum(q.n) AS BIGINT) AS c FROM d p JOIN d q ON p.image_id = q.image_id AND q.bin <= p.bin GROUP BY p.image_id, p.bin", lambda c: stats.cumulative_hist(stats.dense(stats.luma_histogram(c))))
_LUT = _DENSE + """, k AS (SELECT p.image_id, p.bin, count(*) FILTER (q.n > 1) AS c FROM d p JOIN d q ON p.image_id = q.image_id AND q.bin <= p.bin GROUP BY p.image_id, p.bin),
lut AS (SELECT image_id, bin AS v_in, CAST(CASE WHEN t = 0 THEN bin ELSE floor(c * 255.0::DOUBLE / t + 0.5) END AS INT) AS v_out FROM k JOIN (SELECT image_id, max(c) AS t FROM k GROUP BY 1) USING (image_id))"""
register("build_lut", "cells", f"{_LUT} SELECT * FROM lut", lambda c: stats.build_lut(stats.cumulative_hist(stats.binarize_hist(stats.luma_histogram(c)))))
register("equalize_linear", "cells", f"{_LUT} SELECT image_id, y, x, v, v_out FROM lumas JOIN lut USING (image_id) WHERE v = v_in", lambda c: stats.equalize_linear(c))
register("equalize_profile", "cells", f"{_LUT} SELECT image_id, round(avg(v), 6) AS mean_before, round(avg(v_out), 6) AS mean_after, min(v_out) AS low_after, max(v_out) AS high_after, count(*) AS n FROM lumas JOIN lut USING (image_id) WHERE v = v_in GROUP BY image_id",
         lambda c: stats.equalize_linear(c).groupBy("image_id").agg(F.avg("v").alias("mean_before"), F.avg("v_out").alias("mean_after"), F.min("v_out").alias("low_after"), F.max("v_out").alias("high_after"), F.count("*").alias("n")))
register("equalize_clipped", "cells", _DENSE + """, k AS (SELECT p.image_id, p.bin, any_value(p.n) AS n, sum(q.n) AS c FROM d p JOIN d q ON p.image_id = q.image_id AND q.bin <= p.bin GROUP BY p.image_id, p.bin),
o AS (SELECT image_id, bin, CAST(n > 0 AND c BETWEEN 200 AND 3800 AS INT) AS o FROM k),
s AS (SELECT p.image_id, p.bin, sum(q.o) AS c FROM o p JOIN o q ON p.image_id = q.image_id AND q.bin <= p.bin GROUP BY p.image_id, p.bin)
SELECT l.image_id, y, x, v, CAST(floor(c * 255.0::DOUBLE / t) AS INT) AS v_out FROM lumas l JOIN s ON s.image_id = l.image_id AND s.bin = v JOIN (SELECT image_id, max(c) AS t FROM s GROUP BY 1) m ON m.image_id = l.image_id""",
         lambda c: stats.equalize_clipped(c, 200, 3800))
_OTSU = _DENSE + """, w AS (SELECT p.image_id, p.bin, sum(q.n) AS wb, sum(q.n * q.bin) AS sb FROM d p JOIN d q ON p.image_id = q.image_id AND q.bin <= p.bin WHERE p.n > 0 GROUP BY p.image_id, p.bin),
z AS (SELECT w.*, 4096 - wb AS wf, (SELECT sum(n * bin) FROM d WHERE d.image_id = w.image_id) AS total FROM w),
b AS (SELECT image_id, bin, CASE WHEN wf = 0 THEN 0 ELSE round(wb::DOUBLE * wf * pow(sb / wb::DOUBLE - (total - sb) / wf::DOUBLE, 2), 3) END AS v FROM z),
o AS (SELECT image_id, arg_max(bin, v * 1e6 - bin) AS threshold FROM b GROUP BY image_id)"""
register("otsu_threshold", "cells", f"{_OTSU} SELECT * FROM o", lambda c: stats.otsu_threshold(stats.luma_histogram(c)))
register("otsu_binarize", "cells", f"{_OTSU} SELECT image_id, y, x, CASE WHEN v > threshold THEN 255 ELSE 0 END AS v FROM lumas JOIN o USING (image_id)", lambda c: stats.otsu_binarize(c))
register("gray_world", "cells", f"SELECT image_id, y, x, {_rgb('round(least($c * 127.5 / avg($c) OVER (PARTITION BY image_id), 255), 6) AS $c')}, a FROM cells", lambda c: stats.gray_world(c))
register("gray_pixels", "cells", f"""{_LAB}, g AS (SELECT *, greatest(r, g, b) < 0.98 AND least(r, g, b) >= 1e-4 AND pow((r - g) / sqrt(2), 2) + pow((r + g - 2 * b) / sqrt(6), 2) < pow(0.3 * greatest((r + g + b) / sqrt(3), 1e-6), 2) AS gray FROM lin)
SELECT image_id, count(*) FILTER (gray) AS n, {_rgb('round(coalesce(sum($c) FILTER (gray), 0), 6) AS sum_$c')} FROM g GROUP BY image_id""", lambda c: stats.gray_pixel_estimate(c))  # fmt: skip
register("adaptation_matrix", "cells", f"{sql.LINEAR_CELLS} SELECT image_id, {', '.join(f'round(s{i}, 6) AS m{i}' for i in range(9))} FROM ({sql.adaptation(sql.GRAY_SUMS.format(source='lin'))})", lambda c: stats.adaptation_matrix(stats.gray_pixel_estimate(c)))
register("max_normalize", "luma", "SELECT image_id, y, x, round(v / (max(v) OVER (PARTITION BY image_id))::DOUBLE, 6) AS v FROM lumas", lambda p: stats.max_normalize(p))
register("min_block_std", "luma", "SELECT image_id, round(min(s), 6) AS noise_floor FROM (SELECT image_id, stddev_samp(v) AS s FROM lumas GROUP BY image_id, y // 8, x // 8) WHERE round(s, 9) > 0 GROUP BY 1", lambda p: stats.min_block_std(p))
register("hist_extrema", "cells", _DENSE + """, i AS (SELECT image_id, bin, n, bin - row_number() OVER (PARTITION BY image_id, n ORDER BY bin) AS k FROM d),
r AS (SELECT image_id, n, min(bin) AS lo, max(bin) AS hi FROM i GROUP BY image_id, n, k),
e AS (SELECT r.*, p.n AS before, q.n AS after FROM r LEFT JOIN r p ON p.image_id = r.image_id AND p.hi = r.lo - 1 LEFT JOIN r q ON q.image_id = r.image_id AND q.lo = r.hi + 1)
SELECT image_id, CASE WHEN coalesce(before, n + 1) > n AND coalesce(after, n + 1) > n THEN 'min' ELSE 'max' END AS kind, (lo + hi) // 2 AS bin FROM e
WHERE (coalesce(before, n + 1) > n AND coalesce(after, n + 1) > n) OR (coalesce(before, n - 1) < n AND coalesce(after, n - 1) < n)""",
         lambda c: stats.hist_extrema(stats.dense(stats.luma_histogram(c))))
register("image_profile", "cells", """, p AS (SELECT image_id, channel, CAST(bin AS INT) AS bin FROM (UNPIVOT (SELECT c.image_id, r, g, b, v AS luma FROM cells c JOIN lumas USING (image_id, y, x)) ON r, g, b, luma INTO NAME channel VALUE bin))
SELECT coalesce(image_id, -1) AS image_id, coalesce(channel, 'all') AS channel, min(bin) AS low, max(bin) AS high, round(avg(bin), 6) AS mean, round(stddev_pop(bin), 6) AS std, round(avg(CAST(bin >= 250 AS INT)), 6) AS clipped, round(avg(CAST(bin = 0 AS INT)), 6) AS black, count(*) AS n
FROM p GROUP BY GROUPING SETS ((image_id, channel), (image_id), ())""", lambda c: stats.image_profile(c))  # fmt: skip
register("entropy", "cells", f"{_DENSE} SELECT image_id, round(-sum(n / 4096.0 * log2(n / 4096.0)), 6) AS bits FROM d WHERE n > 0 GROUP BY image_id", lambda c: stats.entropy(stats.luma_histogram(c)))


# --- focal --------------------------------------------------------------------------------------
def _near(r: int, edge: str, table: str = "lumas", extra: str = "") -> str:
    """, near AS (a row for each cell and neighbour), by pulling: the neighbour is looked up for each cell."""
    at = "least(greatest(t.y + dy.o, 0), 63) AS sy, least(greatest(t.x + dx.o, 0), 63) AS sx" if edge == "clamp" else "t.y + dy.o AS sy, t.x + dx.o AS sx"
    # places are written out first, so that the join is one by equality
    moved = f", moved AS MATERIALIZED (SELECT t.*, dy.o AS dy, dx.o AS dx, {at} FROM {table} t CROSS JOIN range({-r}, {r + 1}) dy(o) CROSS JOIN range({-r}, {r + 1}) dx(o))"
    return f"{moved}, near AS (SELECT t.image_id, t.y, t.x, dy, dx, {'s.v, t.v AS own' if table == 'lumas' else 's.r, s.g, s.b'}{extra} FROM moved t JOIN {table} s ON s.image_id = t.image_id AND s.y = sy AND s.x = sx)"


def _kernel_sql(name: str) -> str:
    weights, _ = tables.kernel(name)
    return "(VALUES " + ", ".join(f"({-dy}, {-dx}, {w})" for dy, dx, w in weights) + ") k(dy, dx, w)"


for _name in tables.KERNELS:
    _norm, _r = tables.KERNELS[_name][1], len(tables.KERNELS[_name][0]) // 2
    register(f"convolve_{_name}", "cells", f"""SELECT t.image_id, t.y, t.x, {_rgb(f'CAST(least(greatest(coalesce(sum(s.$c * k.w), 0), 0) // {_norm}, 255) AS INT) AS $c')}, any_value(t.a) AS a
FROM cells t CROSS JOIN {_kernel_sql(_name)} LEFT JOIN cells s ON s.image_id = t.image_id AND s.y = t.y + k.dy AND s.x = t.x + k.dx GROUP BY t.image_id, t.y, t.x""", lambda c, n=_name: focal.convolve(c, n))  # fmt: skip
register("box_mean", "luma", f"{_near(3, 'clamp')} SELECT image_id, y, x, CAST(sum(v) // 49 AS INT) AS v FROM near GROUP BY ALL".replace("GROUP BY ALL", "GROUP BY image_id, y, x"), lambda p: focal.box_mean(p, 3))
register("geometric_mean", "luma", f"{_near(1, 'clamp')} SELECT image_id, y, x, round(pow(10, avg(log10(v + 1))) - 1, 6) AS v FROM near GROUP BY image_id, y, x", lambda p: focal.geometric_mean(p, 1))
for _size in (3, 5):
    register(f"median_{_size}", "luma", f"{_near(_size // 2, 'clamp')} SELECT image_id, y, x, CAST(quantile_disc(v, 0.5) AS INT) AS v FROM near GROUP BY image_id, y, x", lambda p, s=_size: focal.median(p, s))
register("median_31", "luma", sql.counted_median(15), lambda p: focal.median(p, 31))
register("adaptive_median", "luma", sql.adaptive_median(8), lambda p: focal.adaptive_median(p, 8))
register("fuzzy_smooth", "luma", f"{_near(1, 'clamp')} SELECT image_id, y, x, round(sum(exp(-pow(v - own, 2) / 1800.0::DOUBLE) * v) / sum(exp(-pow(v - own, 2) / 1800.0::DOUBLE)), 6) AS v FROM near WHERE dy <> 0 OR dx <> 0 GROUP BY image_id, y, x", lambda p: focal.fuzzy_smooth(p, 3, 30.0))
register("fuzzy_median_std", "luma", f"""{_near(1, 'clamp')}, s AS (SELECT image_id, y, x, any_value(own) AS own, round(stddev_samp(v), 9) AS s, quantile_disc(v, 0.5) AS m FROM near GROUP BY image_id, y, x),
f AS (SELECT image_id, min(q) AS q FROM (SELECT image_id, round(stddev_samp(v), 9) AS q FROM lumas GROUP BY image_id, y // 8, x // 8) WHERE q > 0 GROUP BY 1)
SELECT image_id, y, x, CAST(CASE WHEN s > 1.5::DOUBLE * q AND s <= 6 * q THEN m ELSE own END AS INT) AS v FROM s LEFT JOIN f USING (image_id)""", lambda p: focal.fuzzy_median_std(p))  # fmt: skip
register("bilateral", "luma", f"{_near(2, 'shrink')}, w AS (SELECT *, exp(-(dy * dy + dx * dx) / 18.0::DOUBLE) * exp(-pow(v - own, 2) / 3200.0::DOUBLE) AS w FROM near) SELECT image_id, y, x, round(sum(w * v) / sum(w), 6) AS v FROM w GROUP BY image_id, y, x", lambda p: focal.bilateral(p, 2, 40.0))
_LAB_TABLE = f"{_LAB}, lab AS MATERIALIZED (SELECT image_id, y, x, 116 * fq - 16 AS l, 500 * (fp - fq) AS la, 200 * (fq - fs) AS lb FROM f), moved AS MATERIALIZED (SELECT t.*, t.y + dy.o AS sy, t.x + dx.o AS sx, dy.o AS dy, dx.o AS dx FROM lab t CROSS JOIN range(-2, 3) dy(o) CROSS JOIN range(-2, 3) dx(o))"
register("bilateral_lab", "cells", _LAB_TABLE + """, w AS (SELECT t.image_id, t.y, t.x, s.l, s.la, s.lb, exp(-(dy * dy + dx * dx) / 18.0::DOUBLE) * exp(-(pow(s.l - t.l, 2) + pow(s.la - t.la, 2) + pow(s.lb - t.lb, 2)) / 800.0::DOUBLE) AS w FROM moved t JOIN lab s ON s.image_id = t.image_id AND s.y = sy AND s.x = sx)
SELECT image_id, y, x, round(sum(w * l) / sum(w), 5) + 0.0 AS l, round(sum(w * la) / sum(w), 5) + 0.0 AS la, round(sum(w * lb) / sum(w), 5) + 0.0 AS lb FROM w GROUP BY image_id, y, x""",
         lambda c: focal.bilateral(local.rgb_to_lab(c), 2, 20.0, ("l", "la", "lb")).select(*KEY, *((F.round(k, 5) + 0.0).alias(k) for k in ("l", "la", "lb"))))
_STEPS = 6
register("anisotropic_steps", "luma", ", d0 AS (SELECT image_id, y, x, v::DOUBLE AS v FROM lumas), " + ", ".join(f"d{i + 1} AS MATERIALIZED (SELECT l.image_id, l.y, l.x, least(greatest(any_value(l.v) + 0.2::DOUBLE * sum((n.v - l.v) / (1 + pow((n.v - l.v) / 20.0::DOUBLE, 2))), 0), 255) AS v FROM d{i} l JOIN d{i} n ON n.image_id = l.image_id AND abs(n.y - l.y) + abs(n.x - l.x) = 1 GROUP BY l.image_id, l.y, l.x)" for i in range(_STEPS)).replace("abs(n.y - l.y) + abs(n.x - l.x) = 1", "((n.y = l.y AND n.x IN (l.x - 1, l.x + 1)) OR (n.x = l.x AND n.y IN (l.y - 1, l.y + 1)))") + f" SELECT image_id, y, x, round(v, 6) AS v FROM d{_STEPS}",
         lambda p: focal.anisotropic_diffusion(p, 20.0, 0.2, _STEPS))
register("anisotropic_diffusion", "luma", """, d AS (SELECT l.image_id, l.y, l.x, any_value(l.v) AS v, sum((n.v - l.v) / (1 + pow((n.v - l.v) / 20.0::DOUBLE, 2))) AS f FROM lumas l JOIN lumas n ON n.image_id = l.image_id AND abs(n.y - l.y) + abs(n.x - l.x) = 1 GROUP BY l.image_id, l.y, l.x)
SELECT image_id, y, x, round(least(greatest(v + 0.2::DOUBLE * f, 0), 255), 6) AS v FROM d""", lambda p: focal.anisotropic_diffusion(p, 20.0, 0.2, 1))  # fmt: skip
for _shape, _size in (("square", 5), ("vertical", 3), ("horizontal", 7), ("cross", 5), ("frame", 5), ("ring", 5), ("disk", 7), ("diamond", 5)):
    _at = ", ".join(f"({dy}, {dx})" for dy, dx in tables.mask(_shape, _size))
    for _what, _fn in (("erode", "min"), ("dilate", "max")):
        register(f"{_what}_{_shape}", "luma", f"{_near(_size // 2, 'clamp')} SELECT image_id, y, x, {_fn}(v) AS v FROM near WHERE (dy, dx) IN ({_at}) GROUP BY image_id, y, x", lambda p, w=_what, s=_shape, n=_size: getattr(focal, w)(p, s, n))
register("morph_gradient", "luma", f"{_near(1, 'clamp')} SELECT image_id, y, x, max(v) - min(v) AS v FROM near WHERE abs(dy) + abs(dx) <= 1 GROUP BY image_id, y, x", lambda p: focal.morph_gradient(p, "diamond", 3))
for _name, _one, _two in (("open", "min", "max"), ("close", "max", "min")):
    register(f"morph_{_name}", "luma", f"""{_near(1, 'clamp')}, e AS MATERIALIZED (SELECT image_id, y, x, {_one}(v) AS v FROM near GROUP BY image_id, y, x)
SELECT t.image_id, t.y, t.x, {_two}(s.v) AS v FROM e t JOIN e s ON s.image_id = t.image_id AND s.y BETWEEN t.y - 1 AND t.y + 1 AND s.x BETWEEN t.x - 1 AND t.x + 1 GROUP BY t.image_id, t.y, t.x""", lambda p, f=f"morph_{_name}": getattr(focal, f)(p, "square", 3))  # fmt: skip
_GRAD = """, g AS MATERIALIZED (SELECT t.image_id, t.y, t.x, (e.v - w.v) / (e.x - w.x)::DOUBLE AS gx, (s.v - n.v) / (s.y - n.y)::DOUBLE AS gy FROM {t} t
  JOIN {t} e ON e.image_id = t.image_id AND e.y = t.y AND e.x = least(t.x + 1, 63) JOIN {t} w ON w.image_id = t.image_id AND w.y = t.y AND w.x = greatest(t.x - 1, 0)
  JOIN {t} s ON s.image_id = t.image_id AND s.x = t.x AND s.y = least(t.y + 1, 63) JOIN {t} n ON n.image_id = t.image_id AND n.x = t.x AND n.y = greatest(t.y - 1, 0))"""
register("gradient", "luma", _GRAD.format(t="lumas") + " SELECT image_id, y, x, round(gx, 6) AS gx, round(gy, 6) AS gy, round(sqrt(gx * gx + gy * gy), 6) AS magnitude FROM g", lambda p: focal.gradient(p))
register("sobel", "luma", f"{_near(1, 'shrink')}, z AS (SELECT image_id, y, x, any_value(own) AS own, count(*) AS n, sum(v * dx * (2 - abs(dy))) AS gx, sum(v * dy * (2 - abs(dx))) AS gy FROM near GROUP BY image_id, y, x) SELECT image_id, y, x, CAST(CASE WHEN n = 9 THEN abs(gx) + abs(gy) ELSE own END AS INT) AS v FROM z", lambda p: focal.sobel(p))
register("edge_sketch", "luma", _GRAD.format(t="lumas") + " SELECT image_id, y, x, round(255 - least(2 * sqrt(gx * gx + gy * gy), 255), 6) AS v FROM g", lambda p: focal.edge_sketch(p, 2.0))
register("charcoal", "luma", _GRAD.format(t="lumas") + sql.CHARCOAL.format(norm=tables.KERNELS["gaussian_3"][1], kernel=_kernel_sql("gaussian_3")), lambda p: focal.charcoal(p, 30.0))
register("mode_filter", "cells", """, m AS (SELECT t.image_id, t.y, t.x, u.ch, u.v, count(*) AS n FROM cells t JOIN (UNPIVOT (SELECT image_id, y, x, r, g, b FROM cells) ON r, g, b INTO NAME ch VALUE v) u
  ON u.image_id = t.image_id AND u.y BETWEEN t.y AND t.y + 2 AND u.x BETWEEN t.x AND t.x + 2 GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY image_id, y, x, ch ORDER BY n DESC, v DESC) AS i FROM m)
SELECT image_id, y, x, max(v) FILTER (ch = 'r') AS r, max(v) FILTER (ch = 'g') AS g, max(v) FILTER (ch = 'b') AS b FROM k WHERE i = 1 GROUP BY image_id, y, x""", lambda c: focal.mode_filter(c, 3))  # fmt: skip
_GW = f"exp(-(dy * dy + dx * dx) / 2.0::DOUBLE) / pow({'+'.join(f'exp(-{i * i} / 2.0::DOUBLE)' for i in range(-2, 3))}, 2)"
register("gaussian_blur", "luma", f"{_near(2, 'clamp')} SELECT image_id, y, x, round(sum(v * {_GW}), 6) AS v FROM near GROUP BY image_id, y, x", lambda p: focal.gaussian_blur(p, 1.0, 2))
_TENSOR = _GRAD.format(t="lumas") + f""", go AS MATERIALIZED (SELECT t.image_id, t.y, t.x, dy, dx, least(greatest(t.y + dy, 0), 63) AS sy, least(greatest(t.x + dx, 0), 63) AS sx FROM lumas t CROSS JOIN range(-2, 3) dyy(dy) CROSS JOIN range(-2, 3) dxx(dx)),
n AS MATERIALIZED (SELECT t.image_id, t.y, t.x, sum(s.gx * s.gx * {_GW}) AS a, sum(s.gy * s.gy * {_GW}) AS b, sum(s.gx * s.gy * {_GW}) AS c FROM go t JOIN g s ON s.image_id = t.image_id AND s.y = sy AND s.x = sx GROUP BY t.image_id, t.y, t.x)"""
register("structure_tensor", "luma", _TENSOR + """ SELECT image_id, y, x, round((a + b + sqrt(pow(a - b, 2) + 4 * c * c)) / 2, 4) AS l1, round((a + b - sqrt(pow(a - b, 2) + 4 * c * c)) / 2, 4) AS l2 FROM n""",
         lambda p: focal.structure_tensor(p).select(*KEY, F.round("l1", 4).alias("l1"), F.round("l2", 4).alias("l2")))
register("structure_directions", "luma", _TENSOR + """, q AS (SELECT image_id, y, x, 2 * c AS ex, b - a - sqrt(pow(a - b, 2) + 4 * c * c) AS ey FROM n)
SELECT image_id, y, x, round(CASE WHEN sqrt(ex * ex + ey * ey) < 1e-9 THEN 0 ELSE ex / sqrt(ex * ex + ey * ey) END, 4) + 0.0 AS ex, round(CASE WHEN sqrt(ex * ex + ey * ey) < 1e-9 THEN 0 ELSE ey / sqrt(ex * ex + ey * ey) END, 4) + 0.0 AS ey FROM q""",
         lambda p: focal.structure_tensor(p).select(*KEY, *((F.round(k, 4) + 0.0).alias(k) for k in ("ex", "ey"))))
register("pyramid_level", "luma", ", m AS (SELECT image_id, y // 2 AS py, x // 2 AS px, avg(v) AS m FROM lumas GROUP BY ALL) SELECT image_id, y, x, round(v - m, 6) AS v FROM lumas l JOIN m USING (image_id) WHERE py = y // 2 AND px = x // 2", lambda p: focal.pyramid(p, 1)[0])
register("pyramid_level_3", "luma", ", m AS (SELECT image_id, y // 4 AS y, x // 4 AS x, avg(v) AS v FROM lumas GROUP BY ALL), n AS (SELECT image_id, y // 2 AS py, x // 2 AS px, avg(v) AS p FROM m GROUP BY ALL) SELECT m.image_id, y, x, round(v - p, 6) AS v FROM m JOIN n ON n.image_id = m.image_id AND py = y // 2 AND px = x // 2", lambda p: focal.pyramid(p, 3)[2])
register("pyramid_round_trip", "luma", "SELECT image_id, y, x, v FROM lumas", lambda p: focal.reconstruct(focal.pyramid(p, 3)).select(*KEY, F.round("v").cast("int").alias("v")))
register("error_diffusion", "luma", """, RECURSIVE_PLACEHOLDER""", lambda p: focal.error_diffusion(p))
SQL["error_diffusion"] = CELLS_SQL.replace("WITH ", "WITH RECURSIVE ", 1) + """, f AS (
  SELECT image_id, y, x, CASE WHEN v >= 128 THEN 255 ELSE 0 END AS v, (v - CASE WHEN v >= 128 THEN 255 ELSE 0 END) * 7 / 16.0::DOUBLE AS e FROM lumas WHERE x = 0
  UNION ALL
  SELECT l.image_id, l.y, l.x, CASE WHEN l.v + e >= 128 THEN 255 ELSE 0 END, (l.v + e - CASE WHEN l.v + e >= 128 THEN 255 ELSE 0 END) * 7 / 16.0::DOUBLE FROM f JOIN lumas l ON l.image_id = f.image_id AND l.y = f.y AND l.x = f.x + 1)
SELECT image_id, y, x, v FROM f"""
register("error_diffusion_rgb", "cells", """, placeholder""", lambda c: focal.error_diffusion(c, columns=("r", "g", "b")))
SQL["error_diffusion_rgb"] = CELLS_SQL.replace("WITH ", "WITH RECURSIVE ", 1) + """, one AS MATERIALIZED (SELECT * FROM (UNPIVOT (SELECT image_id, y, x, r, g, b FROM cells) ON r, g, b INTO NAME ch VALUE v)), f AS (
  SELECT image_id, y, x, ch, CASE WHEN v >= 128 THEN 255 ELSE 0 END AS v, (v - CASE WHEN v >= 128 THEN 255 ELSE 0 END) * 7 / 16.0::DOUBLE AS e FROM one WHERE x = 0
  UNION ALL
  SELECT l.image_id, l.y, l.x, l.ch, CASE WHEN l.v + e >= 128 THEN 255 ELSE 0 END, (l.v + e - CASE WHEN l.v + e >= 128 THEN 255 ELSE 0 END) * 7 / 16.0::DOUBLE FROM f JOIN one l ON l.image_id = f.image_id AND l.y = f.y AND l.ch = f.ch AND l.x = f.x + 1)
SELECT image_id, y, x, CAST(max(v) FILTER (ch = 'r') AS INT) AS r, CAST(max(v) FILTER (ch = 'g') AS INT) AS g, CAST(max(v) FILTER (ch = 'b') AS INT) AS b FROM f GROUP BY image_id, y, x"""
register("dct_blocks", "luma", """, b AS (SELECT k.v AS k, i.v AS i, CASE WHEN k.v = 0 THEN sqrt(1 / 8.0) ELSE sqrt(2 / 8.0) END * cos(pi() * (2 * i.v + 1) * k.v / 16) AS w FROM range(8) k(v), range(8) i(v))
SELECT image_id, y // 8 * 8 + p.k AS y, x // 8 * 8 + q.k AS x, round(sum(v * p.w * q.w), 4) AS v FROM lumas JOIN b p ON p.i = y % 8 JOIN b q ON q.i = x % 8 GROUP BY image_id, y // 8 * 8 + p.k, x // 8 * 8 + q.k""",
         lambda p: focal.dct_blocks(p, 8).select(*KEY, F.round("v", 4).alias("v")))
register("dct_inverse", "luma", """, b AS (SELECT k.v AS k, i.v AS i, CASE WHEN k.v = 0 THEN sqrt(1 / 8.0) ELSE sqrt(2 / 8.0) END * cos(pi() * (2 * i.v + 1) * k.v / 16) AS w FROM range(8) k(v), range(8) i(v))
SELECT image_id, y // 8 * 8 + p.i AS y, x // 8 * 8 + q.i AS x, round(sum(v * p.w * q.w), 4) AS v FROM lumas JOIN b p ON p.k = y % 8 JOIN b q ON q.k = x % 8 GROUP BY image_id, y // 8 * 8 + p.i, x // 8 * 8 + q.i""",
         lambda p: focal.dct_blocks(p, 8, inverse=True).select(*KEY, F.round("v", 4).alias("v")))
register("dct_round_trip", "luma", "SELECT image_id, y, x, v FROM lumas", lambda p: focal.dct_blocks(focal.dct_blocks(p, 8), 8, inverse=True).select(*KEY, F.round("v").cast("int").alias("v")))

#: Four digits; 0.0 is added so that there is no minus zero.
_FOUR = lambda *names: [(F.round(n, 4) + 0.0).alias(n) for n in names]
register("fft2", "luma", f"{sql.FFT2.format(source='lumas', v='v')} SELECT image_id, y, x, round(re, 4) + 0.0 AS re, round(im, 4) + 0.0 AS im FROM spectrum", lambda p: spectral.fft2(p).select(*KEY, *_FOUR("re", "im")))
register("fft2_round_trip", "luma", "SELECT image_id, y, x, round(v, 6) + 0.0 AS re, 0.0::DOUBLE AS im FROM lumas", lambda p: spectral.ifft2(spectral.fft2(p)).select(*KEY, *((F.round(c, 6) + 0.0).alias(c) for c in ("re", "im"))))
register("fft2_low_pass", "luma", sql.FFT2.format(source="lumas", v="v") + sql.LOW_PASS.format(sigma=3), lambda p: spectral.low_pass(p, 3.0).select(*KEY, *_FOUR("v")))
register("fft2_rings", "luma", sql.FFT2.format(source="lumas", v="v") + """, f AS (SELECT image_id, re * re + im * im AS p, CASE WHEN y < 32 THEN y ELSE y - 64 END AS fy, CASE WHEN x < 32 THEN x ELSE x - 64 END AS fx FROM spectrum)
SELECT image_id, CAST(floor(sqrt(fy * fy + fx * fx)) AS INT) AS ring, round(avg(p / 4096), 4) AS power, count(*) AS n FROM f GROUP BY image_id, floor(sqrt(fy * fy + fx * fx))""", lambda p: spectral.spectrum_rings(p).select("image_id", "ring", *_FOUR("power"), "n"))  # fmt: skip

# --- zones --------------------------------------------------------------------------------------
def _every(cells: DataFrame, n: int = 97, seed: int = 9) -> DataFrame:
    return zonal.hashed_seeds(cells, n, seed)


def _jump_error(cells: DataFrame) -> DataFrame:
    """image_id, share: of how many of an image's cells jump flooding misses the nearest seed."""
    seeds = saved(_every(cells))
    exact = zonal.voronoi_assign(cells, seeds).select(*KEY, F.col("d2").alias("best"))
    return zonal.voronoi_jump(cells, seeds).join(exact, KEY).groupBy("image_id").agg(F.avg((F.col("d2") > F.col("best")).cast("int")).alias("share"))


_LABELS = ", labels AS MATERIALIZED (SELECT image_id, y, x, v // 64 AS label, v FROM lumas)"


def _labels(planes: DataFrame) -> DataFrame:
    return planes.select(*KEY, F.floor(F.col("v") / 64).alias("label"))


_SEEDS = f", seeds AS MATERIALIZED (SELECT image_id, y * 2147483648 + x AS seed_id, y, x FROM cells WHERE ((({_NOISE.format(k=0, s=9)})) * 256 + ({_NOISE.format(k=1, s=9)})) % 97 = 0)"
register("grid_seeds", "cells", "SELECT image_id, (y - 8) // 16 * 4 + (x - 8) // 16 AS label, y, x, r, g, b FROM cells WHERE y % 16 = 8 AND x % 16 = 8", lambda c: zonal.grid_seeds(c, 16))
register("perturb_seeds", "cells", _GRAD.format(t="lumas") + """, n AS (SELECT s.image_id, (s.y - 8) // 16 * 4 + (s.x - 8) // 16 AS label, g.y, g.x, row_number() OVER (PARTITION BY s.image_id, s.y, s.x ORDER BY round(sqrt(gx * gx + gy * gy), 9), g.y, g.x) AS i
  FROM cells s JOIN g ON g.image_id = s.image_id AND g.y BETWEEN s.y - 1 AND s.y + 1 AND g.x BETWEEN s.x - 1 AND s.x + 1 WHERE s.y % 16 = 8 AND s.x % 16 = 8)
SELECT n.image_id, label, n.y, n.x, r, g, b FROM n JOIN cells c ON c.image_id = n.image_id AND c.y = n.y AND c.x = n.x WHERE i = 1""", lambda c: zonal.perturb_seeds(zonal.grid_seeds(c, 16), c))  # fmt: skip
register("superpixels", "cells", sql.superpixels(10), lambda c: zonal.superpixels(c, 16))
register("enforce_connectivity", "cells", None, lambda c: zonal.enforce_connectivity(_labels(src.with_luma(c)), 12))
register("zone_recolor", "cells", f"{_LABELS} SELECT image_id, y, x, label, {_rgb('round(avg($c) OVER (PARTITION BY image_id, label), 6) AS $c')} FROM cells JOIN labels USING (image_id, y, x)", lambda c: zonal.zone_recolor(c, _labels(src.with_luma(c))))
register("zone_borders", "luma", f"{_LABELS} SELECT t.image_id, t.y, t.x, CAST(bool_or(s.label <> t.label) AS INT) AS border FROM labels t JOIN labels s ON s.image_id = t.image_id AND ((s.y = t.y AND s.x IN (t.x, t.x + 1)) OR (s.x = t.x AND s.y = t.y + 1)) GROUP BY t.image_id, t.y, t.x", lambda p: zonal.zone_borders(_labels(p)))
register("neighbour_zones", "luma", f"{_LABELS} SELECT t.image_id, least(t.label, s.label) AS a, greatest(t.label, s.label) AS b, count(*) AS n FROM labels t JOIN labels s ON s.image_id = t.image_id AND ((s.y = t.y AND s.x = t.x + 1) OR (s.x = t.x AND s.y = t.y + 1)) WHERE s.label <> t.label GROUP BY ALL", lambda p: zonal.neighbour_zones(_labels(p)))
register("label_windows", "luma", f"{_LABELS} SELECT image_id, label, count(*) AS n, min(y) AS y0, max(y) AS y1, min(x) AS x0, max(x) AS x1 FROM labels GROUP BY ALL", lambda p: zonal.label_windows(_labels(p)))
_PALETTE = "(VALUES " + ", ".join(f"({i}, {r}, {g}, {b})" for i, (r, g, b) in enumerate(tables.CGA16)) + ") p(idx, pr, pg, pb)"
register("nearest_palette", "cells", f""", n AS (SELECT c.image_id, c.y, c.x, idx, pr, pg, pb, row_number() OVER (PARTITION BY image_id, y, x ORDER BY 30 * pow(r - pr, 2) + 59 * pow(g - pg, 2) + 11 * pow(b - pb, 2), idx) AS i FROM cells c CROSS JOIN {_PALETTE})
SELECT image_id, y, x, idx, pr AS r, pg AS g, pb AS b FROM n WHERE i = 1""", lambda c: zonal.nearest_palette(c, tables.palette(c.sparkSession, "cga16")))  # fmt: skip
_PALETTE_LAB = _LAB.replace("FROM cells)", "FROM (SELECT idx AS image_id, 0 AS y, 0 AS x, pr AS r, pg AS g, pb AS b, 255 AS a FROM {palette}))")
for _old, _new in (("lin AS", "plin AS"), ("xyz AS", "pxyz AS"), (", f AS", ", pf AS"), ("f AS (SELECT", "pf AS (SELECT"), ("FROM lin)", "FROM plin)"), ("FROM xyz)", "FROM pxyz)")):
    _PALETTE_LAB = _PALETTE_LAB.replace(_old, _new, 1) if _old != ", f AS" else _PALETTE_LAB
register("two_color_mix", "cells", _LAB + _PALETTE_LAB.format(palette=_PALETTE) + """, d AS (SELECT f.image_id, f.y, f.x, p.image_id AS idx, round(sqrt(pow(116 * (f.fq - p.fq), 2) + pow(500 * (f.fp - f.fq - p.fp + p.fq), 2) + pow(200 * (f.fq - f.fs - p.fq + p.fs), 2)), 6) AS d FROM f CROSS JOIN pf p),
t AS (SELECT *, row_number() OVER (PARTITION BY image_id, y, x ORDER BY d, idx) AS i FROM d),
o AS (SELECT image_id, y, x, max(idx) FILTER (i = 1) AS first, max(idx) FILTER (i = 2) AS second, max(d) FILTER (i = 1) AS d1, max(d) FILTER (i = 2) AS d2 FROM t WHERE i <= 2 GROUP BY image_id, y, x)
SELECT image_id, y, x, first, second, round(CASE WHEN d1 + d2 = 0 THEN 1 ELSE d2 / (d1 + d2) END, 6) AS share FROM o""", lambda c: zonal.two_color_mix(c, tables.palette(c.sparkSession, "cga16")))  # fmt: skip
for _name in ("ega64", "vga256"):
    _entries = "(VALUES " + ", ".join(f"({i}, {r}, {g}, {b})" for i, (r, g, b) in enumerate(tables.PALETTES[_name])) + ") p(idx, pr, pg, pb)"
    register(f"nearest_{_name}", "cells", f""", k AS (SELECT DISTINCT r, g, b FROM cells), n AS (SELECT k.*, idx, pr, pg, pb, row_number() OVER (PARTITION BY r, g, b ORDER BY 30 * pow(r - pr, 2) + 59 * pow(g - pg, 2) + 11 * pow(b - pb, 2), idx) AS i FROM k CROSS JOIN {_entries})
SELECT image_id, y, x, idx, pr AS r, pg AS g, pb AS b FROM cells JOIN n USING (r, g, b) WHERE i = 1""", lambda c, n=_name: zonal.nearest_palette(c, tables.palette(c.sparkSession, n)))  # fmt: skip
for _name, _entries in (("cga1", sql.CGA1), ("cga0_bright", sql.CGA0_BRIGHT), ("ega_kq3", sql.EGA_KQ3), ("desktop256", sql.DESKTOP256)):
    register(f"nearest_{_name}", "cells", sql.nearest(_entries), lambda c, n=_name: zonal.nearest_palette(c, tables.palette(c.sparkSession, n)))
_TREE = """, n AS (SELECT image_id, d.v AS depth, CAST(y // (64 >> d.v) AS BIGINT) AS qy, CAST(x // (64 >> d.v) AS BIGINT) AS qx, CAST(sum(lumas.v) AS BIGINT) AS mass FROM lumas CROSS JOIN (SELECT CAST(range AS INT) AS v FROM range(5)) d GROUP BY ALL),
t AS (SELECT n.*, NOT (mass > 4000 AND depth < 4) AS is_leaf FROM n),
tree AS (SELECT * FROM t WHERE depth = 0 OR NOT EXISTS (SELECT 1 FROM t p WHERE p.image_id = t.image_id AND p.is_leaf AND p.depth < t.depth AND p.qy = t.qy >> (t.depth - p.depth) AND p.qx = t.qx >> (t.depth - p.depth)))"""
register("quadtree", "luma", f"{_TREE} SELECT * FROM tree",
         lambda p: zonal.quadtree(p.withColumnRenamed("v", "m"), 4000))
register("stratified_seeds", "luma", _TREE + sql.STRATIFIED.format(draw0=sql.drawn("0", 3), draw1=sql.drawn("2 * i", 3), draw2=sql.drawn("2 * i + 1", 3)), lambda p: zonal.stratified_seeds(zonal.quadtree(p.withColumnRenamed("v", "m"), 4000), 200, 3))
register("voronoi_assign", "cells", f"{_SEEDS}, n AS (SELECT c.image_id, c.y, c.x, seed_id, pow(c.y - s.y, 2) + pow(c.x - s.x, 2) AS d2 FROM cells c JOIN seeds s ON s.image_id = c.image_id) SELECT image_id, y, x, min(struct_pack(d2 := d2, seed_id := seed_id)).seed_id AS seed_id, CAST(min(d2) AS BIGINT) AS d2 FROM n GROUP BY image_id, y, x",
         lambda c: zonal.voronoi_assign(c, _every(c)))
register("quadtree_any_size", "luma", sql.quadtree(61, 37, 3000), lambda p: zonal.quadtree(p.where("y < 61 AND x < 37").withColumnRenamed("v", "m"), 3000))
register("voronoi_jump", "cells", f"{_SEEDS}{sql.jumped()} SELECT * FROM jump", lambda c: zonal.voronoi_jump(c, _every(c), tile=16))
register("voronoi_jump_error", "cells", f"""{_SEEDS}{sql.jumped()}, best AS (SELECT c.image_id, c.y, c.x, min(pow(c.y - s.y, 2) + pow(c.x - s.x, 2)) AS d2 FROM cells c JOIN seeds s ON s.image_id = c.image_id GROUP BY c.image_id, c.y, c.x)
SELECT image_id, round(avg(CAST(jump.d2 > best.d2 AS INT)), 6) AS share FROM jump JOIN best USING (image_id, y, x) GROUP BY image_id""",
         lambda c: _jump_error(saved(c.select(*KEY))))
register("lloyd_relax", "luma", f"""{_SEEDS}, n AS (SELECT c.image_id, c.y, c.x, any_value(c.v) AS m, min(struct_pack(d2 := pow(c.y - s.y, 2) + pow(c.x - s.x, 2), seed_id := seed_id)).seed_id AS seed_id FROM lumas c JOIN seeds s ON s.image_id = c.image_id GROUP BY c.image_id, c.y, c.x),
w AS (SELECT image_id, seed_id, sum(m) AS m, sum(y * m) AS sy, sum(x * m) AS sx FROM n GROUP BY ALL)
SELECT s.image_id, s.seed_id, CAST(CASE WHEN m > 0 THEN sy // m ELSE y END AS BIGINT) AS y, CAST(CASE WHEN m > 0 THEN sx // m ELSE x END AS BIGINT) AS x FROM seeds s LEFT JOIN w USING (image_id, seed_id)""",
         lambda p: zonal.lloyd_relax(p.withColumnRenamed("v", "m"), _every(p)))
register("connected_components", "luma", None, lambda p: zonal.connected_components(_labels(p)))
SQL["connected_components"] = CELLS_SQL.replace("WITH ", "WITH RECURSIVE ", 1) + f"""{_LABELS},
reach AS (SELECT image_id, y, x, label, y * 2147483648 + x AS part FROM labels
  UNION SELECT s.image_id, s.y, s.x, s.label, least(r.part, s.y * 2147483648 + s.x) FROM reach r JOIN labels s ON s.image_id = r.image_id AND s.label = r.label AND abs(s.y - r.y) + abs(s.x - r.x) = 1 WHERE r.part < s.y * 2147483648 + s.x)
SELECT image_id, y, x, label, min(part) AS part FROM reach GROUP BY ALL"""

SQL["enforce_connectivity"] = SQL["connected_components"].replace("SELECT image_id, y, x, label, min(part) AS part FROM reach GROUP BY ALL", "").rstrip() + """,
parts AS MATERIALIZED (SELECT image_id, y, x, min(part) AS part FROM reach GROUP BY ALL),
sizes AS (SELECT image_id, part, count(*) AS n, min(y * 2147483648 + x) AS at FROM parts GROUP BY ALL),
goes AS MATERIALIZED (SELECT s.image_id, s.part, CASE WHEN n <= 12 THEN coalesce(w.part, u.part, s.part) ELSE s.part END AS goal FROM sizes s
  LEFT JOIN parts w ON w.image_id = s.image_id AND w.y = s.at // 2147483648 AND w.x = s.at % 2147483648 - 1 LEFT JOIN parts u ON u.image_id = s.image_id AND u.y = s.at // 2147483648 - 1 AND u.x = s.at % 2147483648),
chain AS (SELECT * FROM goes UNION SELECT c.image_id, c.part, g.goal FROM chain c JOIN goes g ON g.image_id = c.image_id AND g.part = c.goal)
SELECT p.image_id, p.y, p.x, c.goal AS label FROM parts p JOIN chain c USING (image_id, part) JOIN goes g ON g.image_id = c.image_id AND g.part = c.goal AND g.goal = c.goal"""


def _seeds_of(cells: DataFrame) -> DataFrame:
    zonal.register_seeds(cells.sparkSession)
    cells.select(*KEY).createOrReplaceTempView("seed_cells")
    return cells.sparkSession.sql("SELECT * FROM seeds(TABLE(seed_cells) PARTITION BY (image_id), 97, 9)")


register("seeds_udtf", "cells", f"{_SEEDS} SELECT * FROM seeds", _seeds_of)

# --- graphs and patches -------------------------------------------------------------------------
_EDGES = ", edges AS MATERIALIZED (SELECT t.image_id, t.y * 2147483648 + t.x AS src, s.y * 2147483648 + s.x AS dst FROM lumas t JOIN lumas s ON s.image_id = t.image_id AND ((s.y = t.y AND s.x = t.x + 1) OR (s.x = t.x AND s.y = t.y + 1)) WHERE abs(s.v - t.v) <= 40), both_ways AS MATERIALIZED (SELECT image_id, src, dst FROM edges UNION ALL SELECT image_id, dst, src FROM edges)"


def _nodes(planes: DataFrame) -> DataFrame:
    return planes.select("image_id", (F.col("y") * F.lit(1 << 31) + F.col("x")).alias("node"), "v")


def _asf(planes: DataFrame) -> DataFrame:
    return graph.graph_asf(_nodes(planes), graph.grid_edges(planes, 40), 1)


register("grid_edges", "luma", f"{_EDGES} SELECT * FROM edges", lambda p: graph.grid_edges(p, 40))
for _what, _fn, _pick in (("erode", "min", "least"), ("dilate", "max", "greatest")):
    register(f"graph_{_what}", "luma", f"{_EDGES}, v AS (SELECT image_id, y * 2147483648 + x AS node, v FROM lumas) SELECT v.image_id, v.node, {_pick}(any_value(v.v), coalesce({_fn}(w.v), any_value(v.v))) AS v FROM v LEFT JOIN both_ways e ON e.image_id = v.image_id AND e.src = v.node LEFT JOIN v w ON w.image_id = e.image_id AND w.node = e.dst GROUP BY v.image_id, v.node",
             lambda p, f=f"graph_{_what}": getattr(graph, f)(_nodes(p), graph.grid_edges(p, 40)))
_ALL_EDGES = _EDGES.replace("abs(s.v - t.v) <= 40", "abs(s.v - t.v) <= 255")
for _what in ("erode", "dilate"):
    register(f"weighted_{_what}", "luma", _ALL_EDGES + sql.weighted(_what, 2, 20.0), lambda p, f=f"weighted_{_what}": getattr(graph, f)(_nodes(p), graph.luma_weights(p), 20.0, 2))
register("graph_asf", "luma", _EDGES + sql.asf(1), lambda p: _asf(saved(p)))
register("cocircular_edges", "luma", _TENSOR + sql.cocircular(2, 30.0, 30.0), lambda p: graph.cocircular_edges(focal.structure_tensor(p), 2, 30.0, 30.0))
register("extract_patches", "luma", f""", n AS (SELECT t.image_id, t.y AS py, t.x AS px, s.v, s.y, s.x FROM lumas t JOIN lumas s ON s.image_id = t.image_id AND s.y BETWEEN t.y AND t.y + 3 AND s.x BETWEEN t.x AND t.x + 3 WHERE t.y % 4 = 0 AND t.x % 4 = 0)
SELECT image_id, py, px, string_agg(v, ',' ORDER BY y, x) AS vec FROM n GROUP BY ALL HAVING count(*) = 16""".replace("GROUP BY ALL HAVING", "GROUP BY image_id, py, px HAVING"), lambda p: graph.extract_patches(p, 4, 4).select("image_id", "py", "px", F.array_join("vec", ",").alias("vec")))  # fmt: skip
register("block_match", "cells", sql.block_match(), lambda c: graph.block_match(c, columns=("r", "g", "b")))
register("block_match_full", "luma", sql.block_match().replace("pow(o.r - s.r, 2) + pow(o.g - s.g, 2) + pow(o.b - s.b, 2)", "pow(o.v - s.v, 2)").replace("FROM cells t", "FROM lumas t").replace("JOIN cells s", "JOIN lumas s"), lambda p: graph.block_match(p))
register("mixed_patches", "luma", """, p AS (SELECT t.image_id, t.y AS py, t.x AS px, s.y, s.x, s.v + (t.y * 7 + t.x * 3) % 11 AS v FROM lumas t JOIN lumas s ON s.image_id = t.image_id AND s.y BETWEEN t.y AND t.y + 3 AND s.x BETWEEN t.x AND t.x + 3 WHERE t.y % 2 = 0 AND t.x % 2 = 0 AND t.y <= 60 AND t.x <= 60)
SELECT image_id, y, x, round(avg(v), 6) AS v FROM p GROUP BY image_id, y, x""", lambda p: graph.aggregate_patches(graph.extract_patches(p, 4, 2).withColumn("vec", F.transform("vec", lambda v: v + (F.col("py") * 7 + F.col("px") * 3) % 11)), 4))  # fmt: skip
register("aggregate_patches", "luma", "SELECT image_id, y, x, CAST(v AS DOUBLE) AS v FROM lumas", lambda p: graph.aggregate_patches(graph.extract_patches(p, 4, 2), 4))

# --- nearest ------------------------------------------------------------------------------------
register("interp_lut", "luma", """, k AS (SELECT image_id, x, max(v) AS v FROM lumas WHERE x % 7 = 3 GROUP BY ALL), q AS (SELECT DISTINCT image_id, x FROM lumas),
b AS (SELECT q.*, (SELECT max(x) FROM k WHERE k.image_id = q.image_id AND k.x <= q.x) AS l, (SELECT min(x) FROM k WHERE k.image_id = q.image_id AND k.x >= q.x) AS r FROM q),
c AS (SELECT image_id, x, coalesce(l, r) AS l, coalesce(r, l) AS r FROM b)
SELECT c.image_id, c.x, round(CASE WHEN l = r THEN m.v ELSE m.v + (n.v - m.v) * (c.x - l) / (r - l)::DOUBLE END, 6) AS v FROM c JOIN k m ON m.image_id = c.image_id AND m.x = l JOIN k n ON n.image_id = c.image_id AND n.x = r""",
         lambda p: nearest.interp_lut(p.select("image_id", "x").distinct(), p.where("x % 7 = 3").groupBy("image_id", "x").agg(F.max("v").alias("v")), ["image_id"]))
register("interp_lut_rows", "luma", """, k AS (SELECT image_id, y, x, v FROM lumas WHERE x % 7 = 3),
b AS (SELECT q.image_id, q.y, q.x, (SELECT max(x) FROM k WHERE k.image_id = q.image_id AND k.y = q.y AND k.x <= q.x) AS l, (SELECT min(x) FROM k WHERE k.image_id = q.image_id AND k.y = q.y AND k.x >= q.x) AS r FROM lumas q),
c AS (SELECT image_id, y, x, coalesce(l, r) AS l, coalesce(r, l) AS r FROM b)
SELECT c.image_id, c.y, c.x, round(CASE WHEN l = r THEN m.v ELSE m.v + (n.v - m.v) * (c.x - l) / (r - l)::DOUBLE END, 6) AS v FROM c JOIN k m ON m.image_id = c.image_id AND m.y = c.y AND m.x = l JOIN k n ON n.image_id = c.image_id AND n.y = c.y AND n.x = r""",
         lambda p: nearest.interp_lut(p.select("image_id", "y", "x"), p.where("x % 7 = 3").select("image_id", "y", "x", "v"), ["image_id", "y"]))
register("nearest_cct", "cells", sql.NEAREST_CCT, lambda c: nearest.nearest_cct(nearest.image_uv(c), nearest.cct_lut(c.sparkSession, nm=0.5)))
register("planckian_uv", "cells", sql.PLANCKIAN, lambda c: nearest.planckian_uv(c.select("image_id").distinct().select("image_id", (4000 + F.pmod("image_id", F.lit(40)) * 100).alias("cct"), F.lit(0.003).alias("duv")), nearest.cct_lut(c.sparkSession, nm=0.5)))
register("shift_temperature", "cells", sql.SHIFT, lambda c: nearest.shift_temperature(c, c.select("image_id").distinct().select("image_id", F.lit(5000).cast("long").alias("cct")), nearest.cct_lut(c.sparkSession, nm=0.5)))
register("white_balance", "cells", sql.white_balance(16), lambda c: nearest.white_balance(c))

# --- what a caller adds, and files -----------------------------------------------------------------


def _own_tables(cells: DataFrame) -> DataFrame:
    tables.register_kernel("own_lines", [[0, 0, 0], [1, 2, 1], [0, 0, 0]], 4)
    tables.register_se("own_corner", ["110", "100", "000"])
    tables.register_palette("own_two", [(0, 0, 0), (255, 128, 64)])
    lines = focal.convolve(cells, "own_lines").select(*KEY, *(F.col(c).alias(f"k{c}") for c in "rgb"))
    corner = focal.erode(src.with_luma(cells), "own_corner", 3).select(*KEY, F.col("v").alias("low"))
    return lines.join(corner, KEY).join(zonal.nearest_palette(cells, tables.palette(cells.sparkSession, "own_two")).select(*KEY, "idx"), KEY)


register("own_tables", "cells", f"""{_near(1, 'clamp')}, e AS (SELECT image_id, y, x, min(v) AS low FROM near WHERE (dy, dx) IN ((-1, -1), (-1, 0), (0, -1)) GROUP BY image_id, y, x),
k AS (SELECT t.image_id, t.y, t.x, {_rgb('CAST(sum(s.$c * (2 - abs(s.x - t.x))) // 4 AS INT) AS k$c')}, any_value(t.r) AS r, any_value(t.g) AS g, any_value(t.b) AS b FROM cells t JOIN cells s ON s.image_id = t.image_id AND s.y = t.y AND s.x BETWEEN t.x - 1 AND t.x + 1 GROUP BY t.image_id, t.y, t.x)
SELECT image_id, y, x, kr, kg, kb, low, CAST(30 * pow(r - 255, 2) + 59 * pow(g - 128, 2) + 11 * pow(b - 64, 2) < 30 * r * r + 59 * g * g + 11 * b * b AS INT) AS idx FROM k JOIN e USING (image_id, y, x)""", _own_tables)  # fmt: skip
register("focal_udf", "cells", f"{_near(1, 'clamp', 'cells')} SELECT image_id, y, x, {_rgb('max($c) - min($c)::DOUBLE AS $c')} FROM near GROUP BY image_id, y, x",
         focal_udf(lambda b: np.stack([around(b[..., i], 1).max(-1) - around(b[..., i], 1).min(-1) for i in range(3)], axis=-1), 1))


def _as_files(cells: DataFrame, fmt: str) -> DataFrame:
    """cells written as a file an image and read back, image_id taken from the name."""
    path = shared_path(cells.sparkSession, "frames")
    write_frame_files(cells, path, fmt)
    good, _ = src.batch_convert(read_frame_files(cells.sparkSession, path, fmt, height=src.SIDE, width=src.SIDE, split=4096))
    return good.select(F.regexp_extract("path", r"(-?\d+)\.\w+$", 1).cast("long").alias("image_id"), "y", "x", *(F.col(c).cast("int").alias(c) for c in "rgb"))


def _broken_files(cells: DataFrame) -> DataFrame:
    """Bitmaps of which every third is cut off and every third after it has no magic: cells and errors of each file."""
    spark, good, bad = cells.sparkSession, shared_path(cells.sparkSession, "frames"), shared_path(cells.sparkSession, "broken")
    write_frame_files(cells, good)
    body, kind = F.col("content"), F.pmod(F.col("image_id"), F.lit(3))
    files = spark.read.format("binaryFile").load(good).withColumn("image_id", F.regexp_extract("path", r"(-?\d+)\.bmp$", 1).cast("long"))
    write_files(files.select(F.regexp_extract("path", r"[^/]+$", 0).alias("name"), F.when(kind == 0, body).when(kind == 1, F.substring(body, 1, 1000)).otherwise(F.concat(F.encode(F.lit("XX"), "UTF-8"), F.substring(body, 3, 1 << 30))).alias("body")), bad)
    rows = read_frame_files(spark, bad).select(F.regexp_extract("path", r"(-?\d+)\.bmp$", 1).cast("long").alias("image_id"), "r", "error")
    return rows.groupBy("image_id", "error").agg(F.count("r").alias("n"), F.coalesce(F.sum("r").cast("long"), F.lit(0)).alias("total"))


def _stored(cells: DataFrame) -> DataFrame:
    path = shared_path(cells.sparkSession, "frames")
    src.write_frames(cells, path)
    return cells.sparkSession.read.parquet(path).select(*KEY, "r", "g", "b", "a")


register("bmp_frames", "cells", "SELECT image_id, y, x, r, g, b FROM cells", lambda c: _as_files(c, "bmp"))
for _fmt, _white in (("8u", 255), ("16u", 32767), ("32f", 255), ("10u", 1023)):
    register(f"raw_frames_{_fmt}", "cells", f"SELECT image_id, y, x, {_rgb(f'CAST($c * {_white} // 255 AS INT) AS $c')} FROM cells", lambda c, f=_fmt, w=_white: _as_files(c.select(*KEY, *(F.expr(f"{k} * {w} div 255").alias(k) for k in "rgb")), f))
register("frames_with_errors", "cells", """SELECT image_id, CASE image_id % 3 WHEN 0 THEN NULL WHEN 1 THEN 'truncated or not 24 bits' ELSE 'not a bitmap' END AS error,
  CASE WHEN image_id % 3 = 0 THEN count(*) ELSE 0 END AS n, CAST(CASE WHEN image_id % 3 = 0 THEN sum(r) ELSE 0 END AS BIGINT) AS total FROM cells GROUP BY image_id""", _broken_files)  # fmt: skip
register("write_frames", "cells", "SELECT * FROM cells", _stored)
_LIMITS = f""", grid AS (SELECT i.v AS iy, h.v AS ih, c.v AS c, (i.v + 0.5) / 100::DOUBLE AS cy, radians(h.v) AS th FROM range(100) i(v), range(360) h(v), range(1, 201) c(v)),
g1 AS (SELECT *, CASE WHEN cy > 0.008856451679035631 THEN cbrt(cy) ELSE cy * 7.787037037037037 + 16 / 116.0::DOUBLE END AS fy FROM grid),
g2 AS (SELECT iy, ih, c, cy, fy + c * cos(th) / 500 AS fx, fy - c * sin(th) / 200 AS fz FROM g1),
g3 AS (SELECT iy, ih, c, cy, {', '.join(f'CASE WHEN f{k} > 6 / 29.0::DOUBLE THEN pow(f{k}, 3) ELSE (f{k} - 16 / 116.0::DOUBLE) / 7.787037037037037 END * {w / 100!r} AS c{k}' for k, w in zip('xz', (95.047, 108.883), strict=True))} FROM g2),
limits AS MATERIALIZED (SELECT iy, ih, coalesce(max(c) FILTER ({' AND '.join(f'{e} BETWEEN -0.001 AND 1.001' for e in sql.linear(tables.XYZ_TO_SRGB, ['cx', 'cy', 'cz']))}), 0) AS lim FROM g3 GROUP BY ALL),
around AS MATERIALIZED (SELECT a.iy, a.ih, min(b.lim) AS lim FROM limits a JOIN limits b ON b.iy IN (a.iy, a.iy + 1) AND (b.ih = a.ih OR b.ih = (a.ih + 1) % 360) WHERE a.iy <= 98 GROUP BY ALL)"""
register("limited_hue_boost", "cells", sql.lab_back(f"""{_LAB}{_LIMITS}, cc AS (SELECT image_id, y, x, a, 116 * fq - 16 AS l, 500 * (fp - fq) AS la, 200 * (fq - fs) AS lb FROM f),
mx AS (SELECT *, sqrt(la * la + lb * lb) / nullif(max(sqrt(la * la + lb * lb)) OVER (PARTITION BY image_id), 0) AS sh FROM cc),
gn AS (SELECT *, 1 + 3 * least(greatest((coalesce(sh, 0) - 0.2::DOUBLE) / 0.6::DOUBLE, 0), 1) * exp(-10 * pow(degrees(atan2(lb, la)) / 180, 2)) AS k FROM mx),
bo AS (SELECT image_id, y, x, a, 100 * pow(greatest(l, 0) / 100, 1 / 1.2::DOUBLE) AS l, k * la AS la, k * lb AS lb FROM gn),
bf AS (SELECT *, (l + 16) / 116.0::DOUBLE + la / 500.0::DOUBLE AS fx, (l + 16) / 116.0::DOUBLE AS fy, (l + 16) / 116.0::DOUBLE - lb / 200.0::DOUBLE AS fz FROM bo),
bx AS (SELECT image_id, y, x, a, l, la, lb, {sql.LAB_BACK} FROM bf),
bs AS (SELECT *, {' AND '.join(f'({e}) BETWEEN -0.001 AND 1.001' for e in sql.linear(tables.XYZ_TO_SRGB, ['cx', 'cy', 'cz']))} AS inside, least(CAST(floor(100 * cy) AS BIGINT), 98) AS iy, CAST(floor((degrees(atan2(lb, la)) + 360) % 360) AS BIGINT) AS ih FROM bx),
bz AS (SELECT bs.*, CASE WHEN inside OR lim IS NULL THEN 1 ELSE least(1, lim / greatest(sqrt(la * la + lb * lb), 1e-9)) END AS cut FROM bs LEFT JOIN around USING (iy, ih)),
m AS (SELECT image_id, y, x, a, l, cut * la AS la, cut * lb AS lb FROM bz)"""), lambda c: local.limited_hue_boost(c))  # fmt: skip

# --- frames in time -----------------------------------------------------------------------------
_FRAMES = "WITH f AS (SELECT ts, user_id % 8 AS stream_id, event_type AS channel, CAST(least(floor(value / 2), 255) AS INT) AS value FROM events)\n"


def _register_frames(name: str, sql: str | None, fn: Callable[[DataFrame], DataFrame]) -> None:
    QUERIES[name] = lambda spark, sf_dir: fn(frames.frame_events(spark, f"{sf_dir}/events.parquet"))
    if sql:
        SQL[name] = _FRAMES + sql


_register_frames("frames_local", "SELECT ts, stream_id, channel, CASE WHEN value > 90 THEN 255 ELSE 0 END AS value FROM f", lambda f: frames.stream_local(f))
_register_frames("frames_histogram", "SELECT date_trunc('hour', ts) AS start, channel, value AS bin, count(*) AS n FROM f GROUP BY ALL", lambda f: frames.stream_histogram(f))
_register_frames("frames_stats", "SELECT date_trunc('hour', ts) AS start, stream_id, min(value) AS low, max(value) AS high, round(avg(value), 6) AS mean, count(*) AS n FROM f GROUP BY ALL", lambda f: frames.stream_frame_stats(f))
_register_frames("frames_sessions", """, g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 3 HOUR THEN 0 ELSE 1 END AS fresh FROM f WINDOW w AS (PARTITION BY stream_id ORDER BY ts)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY stream_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT min(ts) AS start, max(ts) + INTERVAL 3 HOUR AS stop, stream_id, count(*) AS n FROM s GROUP BY stream_id, k""", lambda f: frames.stream_sessions(f))  # fmt: skip
_register_frames("frames_deflicker", """, h AS (SELECT date_trunc('hour', ts) AS start, stream_id, round(avg(value), 6) AS mean FROM f GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY start) AS i FROM h),
s AS (SELECT stream_id, start, mean, i, mean::DOUBLE AS smooth FROM o WHERE i = 1 UNION ALL SELECT o.stream_id, o.start, o.mean, o.i, 0.25::DOUBLE * o.mean + 0.75::DOUBLE * s.smooth FROM s JOIN o ON o.stream_id = s.stream_id AND o.i = s.i + 1)
SELECT stream_id, start, mean, round(smooth, 6) AS smooth, round(CASE WHEN mean = 0 THEN 1 ELSE smooth / mean END, 6) AS gain FROM s""",
                 lambda f: frames.deflicker_batch(frames.stream_frame_stats(f)).select("stream_id", "start", "mean", *(F.round(c, 6).alias(c) for c in ("smooth", "gain"))))
SQL["frames_deflicker"] = SQL["frames_deflicker"].replace("WITH f", "WITH RECURSIVE f", 1)

# --- frames that arrive: each query writes the events to a folder arrival by arrival and runs a stream over it


def _register_live(name: str, sql_: str, fn: Callable[[DataFrame], DataFrame], recursive: str = "") -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")
        rows = live.with_arrival(events).select("event_id", "ts", (F.col("user_id") % 8).alias("stream_id"), F.col("event_type").alias("channel"), F.least(F.floor(F.col("value") / 2), F.lit(255)).cast("int").alias("value"), "arrival")
        return live.in_arrivals(rows, fn, name)

    QUERIES[name] = query
    SQL[name] = sql.ARRIVALS.format(recursive=recursive) + sql_


_register_live("live_local", "SELECT ts, stream_id, channel, CASE WHEN value > 90 THEN 255 ELSE 0 END AS value FROM came", lambda r: frames.stream_local(r))
_register_live("live_histogram", f"SELECT date_trunc('hour', ts) AS start, channel, value AS bin, count(*) AS n FROM f WHERE {sql.CLOSED} GROUP BY ALL", lambda r: frames.stream_histogram(r))
_register_live("live_stats", f"SELECT date_trunc('hour', ts) AS start, stream_id, min(value) AS low, max(value) AS high, round(avg(value), 6) AS mean, count(*) AS n FROM f WHERE {sql.CLOSED} GROUP BY ALL", lambda r: frames.stream_frame_stats(r))
_register_live("live_deflicker", f""", h AS (SELECT date_trunc('hour', ts) AS start, stream_id, round(avg(value), 6) AS mean FROM f WHERE {sql.CLOSED} GROUP BY ALL),
o AS (SELECT *, row_number() OVER w AS i, coalesce(start - lag(start) OVER w > INTERVAL 12 HOUR, true) AS fresh FROM h WINDOW w AS (PARTITION BY stream_id ORDER BY start)),
s AS (SELECT stream_id, start, mean, i, mean::DOUBLE AS smooth FROM o WHERE i = 1 UNION ALL SELECT o.stream_id, o.start, o.mean, o.i, CASE WHEN fresh THEN o.mean::DOUBLE ELSE 0.25::DOUBLE * o.mean + 0.75::DOUBLE * s.smooth END FROM s JOIN o ON o.stream_id = s.stream_id AND o.i = s.i + 1)
SELECT stream_id, start, mean, round(smooth, 6) AS smooth, round(CASE WHEN mean = 0 THEN 1 ELSE smooth / mean END, 6) AS gain FROM s""",
               lambda r: live.deflicker_live(live.frame_means(r)).select("stream_id", "start", "mean", *(F.round(c, 6).alias(c) for c in ("smooth", "gain"))), "RECURSIVE ")

# --- models on patches and small tables ---------------------------------------------------------
register("noise_profile", "luma", sql.NOISE + " SELECT image_id, bin, round(level, 6) AS level, k, round(std, 6) AS std FROM noise", lambda p: denoise.noise_profile(p))
register("noise_covariance", "luma", sql.COVARIANCE, lambda p: denoise.noise_covariance(denoise.noise_profile(p)).withColumn("cov", F.round("cov", 4) + 0.0))
# an image of 4,096 cells has one bin, whose noise is that of every level
register("noise_levels", "luma", sql.NOISE + " SELECT image_id, k, CAST(l.v AS INT) AS level, round(std, 6) AS std FROM noise CROSS JOIN range(256) l(v)", lambda p: denoise.noise_levels(denoise.noise_profile(p)))
register("nl_bayes_denoise", "cells", None, lambda c: denoise.denoise_rgb(c, step=2, radius=8, k=512))
register("hist_segment", "cells", None, lambda c: segment.hist_segment(stats.luma_histogram(c)))
register("hsi_palette", "cells", None, lambda c: segment.hsi_palette(c))
register("posterize_hsi", "cells", None, lambda c: segment.posterize_hsi(c))
register("posterize", "cells", None, lambda c: segment.posterize(c))
register("spectrum_2d", "luma", sql.SPECTRUM, lambda p: segment.spectrum_2d(p).withColumn("power", F.round("power", 0)))
register("pca_illuminant", "cells", sql.PCA, lambda c: segment.pca_illuminant(c))
SQL["pca_illuminant"] = SQL["pca_illuminant"].replace("WITH ", "WITH RECURSIVE ", 1)
for _space, _pastel in (("hsluv", False), ("hpluv", True)):
    register(f"to_{_space}", "cells", f"{sql.hsluv_of(_pastel)} SELECT image_id, y, x, round(h, 6) AS h, round(s, 6) AS s, round(l, 6) AS l, a FROM hs", lambda c, p=_pastel: perceptual.to_hsluv(c, p))
    register(f"{_space}_to_rgb", "cells", sql.hsluv_back(_pastel, ", m AS (SELECT image_id, y, x, a, r * 7 / 5.0::DOUBLE AS h, g * 100 / 255.0::DOUBLE AS s, b * 100 / 255.0::DOUBLE AS l FROM cells)"),
             lambda c, p=_pastel: perceptual.from_hsluv(c.select(*KEY, "a", (F.col("r") * 7 / 5.0).alias("h"), (F.col("g") * 100 / 255.0).alias("s"), (F.col("b") * 100 / 255.0).alias("l")), p))
    register(f"{_space}_round_trip", "cells", "SELECT image_id, y, x, r, g, b, a FROM cells", lambda c, p=_pastel: perceptual.from_hsluv(perceptual.to_hsluv(c, p), p).select(*KEY, *(F.round(k).cast("int").alias(k) for k in "rgb"), "a"))
    register(f"adjust_{_space}", "cells", sql.hsluv_back(_pastel, f"{sql.hsluv_of(_pastel)}, m AS (SELECT image_id, y, x, a, (h + 30) % 360 AS h, {sql.clamped('s - 10', 100)} AS s, {sql.clamped('l + 5', 100)} AS l FROM hs)"), lambda c, p=_pastel: perceptual.adjust_hsluv(c, 30.0, -10.0, 5.0, p))
register("channel_summary", "cells", "SELECT image_id, count(r) AS n, CAST(sum(r) AS BIGINT) AS total, min(r) AS low, max(r) AS high, round(avg(r), 6) AS mean, round(stddev_pop(r), 6) AS std FROM cells GROUP BY image_id", lambda c: c.groupBy("image_id").agg(perceptual.channel_summary("r").alias("s")).select("image_id", "s.*"))
