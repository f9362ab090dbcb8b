"""DuckDB texts for the queries whose SQL is more than a line: each follows after the fixture's own CTEs (cells, lumas)."""

from __future__ import annotations

import math

import numpy as np

from .functions import tables
from .operators import perceptual
from .operators.nearest import C2, CURVES

LIN = "CASE WHEN {c} / 255.0::DOUBLE > 0.04045 THEN pow(({c} / 255.0::DOUBLE + 0.055) / 1.055, 2.4) ELSE {c} / 255.0::DOUBLE / 12.92 END"
TO_SRGB = "CASE WHEN {c} > 0.0031308 THEN 1.055 * pow({c}, 1 / 2.4::DOUBLE) - 0.055 ELSE {c} * 12.92 END"


def clamped(v: str, top: float = 1) -> str:
    return f"least(greatest({v}, 0), {top})"


def linear(m: list[float], names: str | list[str]) -> list[str]:
    return [" + ".join(f"{m[3 * i + j]!r}::DOUBLE * {n}" for j, n in enumerate(names)) for i in range(3)]


def shown(source: str, m: list[float], names: list[str]) -> str:
    """r, g, b from XYZ columns: matrix, clamp, transfer curve."""
    lin = ", ".join(f"{clamped(e)} AS {c}" for e, c in zip(linear(m, names), "rgb", strict=True))
    return f"SELECT image_id, y, x, {', '.join(f'round(255 * ({TO_SRGB.format(c=c)}), 6) AS {c}' for c in 'rgb')}, a FROM (SELECT image_id, y, x, a, {lin} FROM {source})"


# --- colour spaces ------------------------------------------------------------------------------
HUE_BACK = {
    "hsl": ["l - s * least(l, 1 - l) * greatest(least((({n} + h / 30) % 12) - 3, 9 - (({n} + h / 30) % 12), 1), -1)".replace("{n}", str(n)) for n in (0, 8, 4)],
    "hsv": [f"l * (1 - s * (1 - q{c}))" for c in "rgb"],
    "hsi": [f"l * (1 - s) + 3 * l * s * q{c} / (qr + qg + qb)" for c in "rgb"],
    "hsp": [f"l / sqrt(0.299 * pow(1 - s + s * qr, 2) + 0.587 * pow(1 - s + s * qg, 2) + 0.114 * pow(1 - s + s * qb, 2)) * (1 - s + s * q{c})" for c in "rgb"],
}


def hue_back(space: str, moved: str) -> str:
    """moved: a CTE text with image_id, y, x, a, h, s, l. q is 1 for the largest channel and 0 for the least."""
    q = ", ".join(f"1 - greatest(0, least(({n} + h / 60) % 6, 4 - ({n} + h / 60) % 6, 1)) AS q{c}" for n, c in zip((5, 3, 1), "rgb", strict=True))
    return f"{moved}, qs AS (SELECT *, {q} FROM m) SELECT image_id, y, x, " + ", ".join(f"round({{clamp}}255 * ({e}){{end}}, 6) AS {c}" for e, c in zip(HUE_BACK[space], "rgb", strict=True)) + ", a FROM qs"


LAB_BACK = ", ".join(f"CASE WHEN f{k} > 6 / 29.0::DOUBLE THEN pow(f{k}, 3) ELSE (f{k} - 16 / 116.0::DOUBLE) / 7.787037037037037 END * {w / 100!r}::DOUBLE AS c{k}" for k, w in zip("xyz", tables.ILLUMINANTS["d65"], strict=True))


def lab_back(moved: str) -> str:
    """moved: a CTE text that ends in m with image_id, y, x, a, l, la, lb."""
    return f"{moved}, b AS (SELECT image_id, y, x, a, (l + 16) / 116.0::DOUBLE + la / 500.0::DOUBLE AS fx, (l + 16) / 116.0::DOUBLE AS fy, (l + 16) / 116.0::DOUBLE - lb / 200.0::DOUBLE AS fz FROM m), c AS (SELECT image_id, y, x, a, {LAB_BACK} FROM b) {shown('c', tables.XYZ_TO_SRGB, ['cx', 'cy', 'cz'])}"


def _lines() -> str:
    """la0..la5 and lb0..lb5: slope and intercept of the gamut's six borders at lightness l."""
    sub = "CASE WHEN pow(l + 16, 3) / 1560896.0::DOUBLE > 0.0088564516790356308 THEN pow(l + 16, 3) / 1560896.0::DOUBLE ELSE l / 903.2962962962963::DOUBLE END"
    out = []
    for i in range(6):
        m1, m2, m3 = perceptual.TO_RGB[3 * (i // 2) : 3 * (i // 2) + 3]
        bottom = f"({632260 * m3 - 126452 * m2!r} * ({sub}) + {126452 * (i % 2)})"
        out.append(f"{284517 * m1 - 94839 * m3!r} * ({sub}) / {bottom} AS la{i}, ({838422 * m3 + 769860 * m2 + 731718 * m1!r} * l * ({sub}) - {769860 * (i % 2)} * l) / {bottom} AS lb{i}")
    return ", ".join(out)


def _most(pastel: bool) -> str:
    if pastel:
        return "list_min([" + ", ".join(f"abs(lb{i}) / sqrt(la{i} * la{i} + 1)" for i in range(6)) + "])"
    ray = [f"lb{i} / (sin(radians(h)) - la{i} * cos(radians(h)))" for i in range(6)]
    return "list_min([" + ", ".join(f"CASE WHEN {v} >= 0 THEN {v} END" for v in ray) + "])"


def hsluv_of(pastel: bool) -> str:
    """CTEs that end in hs: h, s, l of every cell."""
    x, y, z = linear(perceptual.TO_XYZ, "rgb")
    return f""", lin AS (SELECT image_id, y, x, a, {', '.join(f'{LIN.format(c=c)} AS {c}' for c in 'rgb')} FROM cells),
xyz AS (SELECT image_id, y, x, a, {x} AS cx, {y} AS cy, {z} AS cz FROM lin),
lev AS (SELECT *, CASE WHEN cy <= {perceptual.EPSILON!r} THEN cy * {perceptual.KAPPA!r} ELSE 116 * cbrt(cy) - 16 END AS l, cx + 15 * cy + 3 * cz AS t FROM xyz),
luv AS (SELECT image_id, y, x, a, l, CASE WHEN t = 0 THEN 0 ELSE 13 * l * (4 * cx / t - {perceptual.REF_U!r}) END AS u, CASE WHEN t = 0 THEN 0 ELSE 13 * l * (9 * cy / t - {perceptual.REF_V!r}) END AS v FROM lev),
lch AS (SELECT image_id, y, x, a, l, CASE WHEN sqrt(u * u + v * v) < 1e-8 THEN 0 ELSE sqrt(u * u + v * v) END AS c, CASE WHEN sqrt(u * u + v * v) < 1e-8 THEN 0 ELSE (degrees(atan2(v, u)) + 360) % 360 END AS h FROM luv),
edge AS (SELECT *, {_lines()} FROM lch),
hs AS (SELECT image_id, y, x, a, h, CASE WHEN l > 99.9999999 OR l < 1e-8 THEN 0 ELSE c / {_most(pastel)} * 100 END AS s, CASE WHEN l > 99.9999999 THEN 100 WHEN l < 1e-8 THEN 0 ELSE l END AS l FROM edge)"""


def hsluv_back(pastel: bool, moved: str) -> str:
    """moved: CTEs that end in m with image_id, y, x, a, h, s, l."""
    return f"""{moved}, rim AS (SELECT *, {_lines()} FROM m),
cl AS (SELECT *, CASE WHEN l > 99.9999999 OR l < 1e-8 THEN 0 ELSE {_most(pastel)} / 100 * s END AS c FROM rim),
bk AS (SELECT image_id, y, x, a, l, CASE WHEN l <= 8 THEN l / {perceptual.KAPPA!r} ELSE pow((l + 16) / 116, 3) END AS yy, c * cos(radians(h)) / (13 * l) + {perceptual.REF_U!r} AS nu, c * sin(radians(h)) / (13 * l) + {perceptual.REF_V!r} AS nv FROM cl),
b2 AS (SELECT *, 9 * yy * nu / (4 * nv) AS xx FROM bk),
b3 AS (SELECT image_id, y, x, a, CASE WHEN l < 1e-8 THEN 0 ELSE xx END AS cx, CASE WHEN l < 1e-8 THEN 0 ELSE yy END AS cy, CASE WHEN l < 1e-8 THEN 0 ELSE (9 * yy - 15 * nv * yy - nv * xx) / (3 * nv) END AS cz FROM b2)
{shown('b3', perceptual.TO_RGB, ['cx', 'cy', 'cz'])}"""


# --- whole images -------------------------------------------------------------------------------
def adaptation(sums: str, cat: str = "cat02", want: list[str] | None = None) -> str:
    """m0..m8 from columns n, sum_r, sum_g, sum_b of a source; want: SQL of the wanted white."""
    a = np.array(tables.ADAPTATION[cat]).reshape(3, 3)
    p, q = np.array(tables.XYZ_TO_SRGB).reshape(3, 3) @ np.linalg.inv(a), a @ np.array(tables.SRGB_TO_XYZ).reshape(3, 3)
    xyz = linear(tables.SRGB_TO_XYZ, [f"sum_{c} / greatest(n, 1)::DOUBLE" for c in "rgb"])
    want = want or [repr(v) for v in tables.ILLUMINANTS["d65"]]
    gain = [f"({w}) / ({h})" for w, h in zip(linear(a.ravel().tolist(), want), linear(a.ravel().tolist(), ["cx * 100 / cy", "100.0", "cz * 100 / cy"]), strict=True)]
    cells = [" + ".join(f"{float(p[i, k])!r} * g{k} * {float(q[k, j])!r}" for k in range(3)) for i in range(3) for j in range(3)]
    eye = [1, 0, 0, 0, 1, 0, 0, 0, 1]
    return f"SELECT *, {', '.join(f'CASE WHEN n > 0 AND cy > 1e-9 THEN {c} ELSE {e} END AS s{i}' for i, (c, e) in enumerate(zip(cells, eye, strict=True)))} FROM (SELECT *, {', '.join(f'{g} AS g{i}' for i, g in enumerate(gain))} FROM (SELECT *, {xyz[0]} AS cx, {xyz[1]} AS cy, {xyz[2]} AS cz FROM ({sums})))"


LINEAR_CELLS = f", lin AS MATERIALIZED (SELECT image_id, y, x, {', '.join(f'{LIN.format(c=c)} AS {c}' for c in 'rgb')} FROM cells)"
GRAY = "greatest(r, g, b) < 0.98 AND least(r, g, b) >= 1e-4 AND pow((r - g) / sqrt(2), 2) + pow((r + g - 2 * b) / sqrt(6), 2) < pow(0.3 * greatest((r + g + b) / sqrt(3), 1e-6), 2)"
GRAY_SUMS = f"SELECT image_id, count(*) FILTER ({GRAY}) AS n, {', '.join(f'coalesce(sum({c}) FILTER ({GRAY}), 0) AS sum_{c}' for c in 'rgb')} FROM {{source}} GROUP BY image_id"


def white_balance(rounds: int = 16) -> str:
    """Every round unrolled: images that still move are corrected by the product so far and estimated again."""
    eye = [1, 0, 0, 0, 1, 0, 0, 0, 1]
    out = [f"{LINEAR_CELLS}, w0 AS MATERIALIZED (SELECT DISTINCT image_id, {', '.join(f'{v}::DOUBLE AS m{i}' for i, v in enumerate(eye))}, 9.0::DOUBLE AS px, 9.0::DOUBLE AS py, false AS still FROM cells)"]
    for i in range(1, rounds + 1):
        rows = ", ".join(f"greatest(m{3 * j} * r + m{3 * j + 1} * g + m{3 * j + 2} * b, 0) AS {c}" for j, c in enumerate("rgb"))
        source = f"(SELECT image_id, {rows} FROM lin JOIN w{i - 1} USING (image_id) WHERE NOT still)"
        x, y, z = linear(tables.SRGB_TO_XYZ, ["sum_r", "sum_g", "sum_b"])
        product = ", ".join(" + ".join(f"s{3 * a + k} * m{3 * k + b}" for k in range(3)) + f" AS m{3 * a + b}" for a in range(3) for b in range(3))
        chroma = ", ".join(f"CASE WHEN ({x}) + ({y}) + ({z}) > 0 THEN ({v}) / (({x}) + ({y}) + ({z})) ELSE 0 END AS {n}" for v, n in ((x, "nx"), (y, "ny")))
        out.append(f"e{i} AS MATERIALIZED (SELECT *, {chroma} FROM ({adaptation(GRAY_SUMS.format(source=source))}))")
        out.append(f"w{i} AS MATERIALIZED (SELECT image_id, {product}, nx AS px, ny AS py, pow(nx - px, 2) + pow(ny - py, 2) < 1e-8 AS still FROM e{i} JOIN w{i - 1} USING (image_id))")
    ms = ", ".join(f"round(m{k}, 6) AS m{k}" for k in range(9))
    return ", ".join(out) + " " + " UNION ALL ".join(f"SELECT image_id, {ms}, {i} AS rounds FROM w{i}{' WHERE still' if i < rounds else ''}" for i in range(1, rounds + 1))


def superpixels(rounds: int = 10) -> str:
    """Sixteen centres an image, every round unrolled: all centres of an image are tried."""
    out = [", c0 AS MATERIALIZED (SELECT image_id, (y - 8) // 16 * 4 + (x - 8) // 16 AS label, y::DOUBLE AS cy, x::DOUBLE AS cx, r::DOUBLE AS cr, g::DOUBLE AS cg, b::DOUBLE AS cb FROM cells WHERE y % 16 = 8 AND x % 16 = 8)"]
    for i in range(rounds + 1):
        d = "round((pow(y - cy, 2) + pow(x - cx, 2)) * pow(40 / 16.0::DOUBLE, 2) + (pow(r - cr, 2) + pow(g - cg, 2) + pow(b - cb, 2)), 6)"
        out.append(f"n{i} AS MATERIALIZED (SELECT image_id, y, x, any_value(r) AS r, any_value(g) AS g, any_value(b) AS b, min(struct_pack(d := {d}, label := label)) AS m FROM cells JOIN c{i} USING (image_id) WHERE abs(y - round(cy)) <= 16 AND abs(x - round(cx)) <= 16 GROUP BY image_id, y, x)")
        if i < rounds:
            means = ", ".join(f"avg({k}) AS n{k}" for k in ("y", "x", "r", "g", "b"))
            out.append(f"c{i + 1} AS MATERIALIZED (SELECT image_id, label, {', '.join(f'coalesce(n{k}, c{k}) AS c{k}' for k in ('y', 'x', 'r', 'g', 'b'))} FROM c{i} LEFT JOIN (SELECT image_id, m.label AS label, {means} FROM n{i} GROUP BY ALL) USING (image_id, label))")
    return ", ".join(out) + f" SELECT image_id, y, x, coalesce(m.label, -1) AS label FROM cells LEFT JOIN n{rounds} USING (image_id, y, x)"


def adaptive_median(rmax: int = 8) -> str:
    """Windows one size after the other, each for the cells that no smaller one settled; values as sorted lists."""
    out = [""", ring AS (SELECT t.image_id, t.y, t.x, any_value(t.v) AS v, min(s.v) AS lo, max(s.v) AS hi FROM lumas t JOIN lumas s ON s.image_id = t.image_id AND s.y BETWEEN t.y - 1 AND t.y + 1 AND s.x BETWEEN t.x - 1 AND t.x + 1 GROUP BY t.image_id, t.y, t.x),
u1 AS MATERIALIZED (SELECT image_id, y, x FROM ring WHERE v = lo OR v = hi)"""]
    for r in range(1, rmax + 1):
        out.append(f"o{r} AS MATERIALIZED (SELECT t.image_id, t.y, t.x, t.y + dy.o AS sy, t.x + dx.o AS sx FROM u{r} t CROSS JOIN range({-r}, {r + 1}) dy(o) CROSS JOIN range({-r}, {r + 1}) dx(o))")
        out.append(f"l{r} AS MATERIALIZED (SELECT t.image_id, t.y, t.x, list_sort(list(s.v)) AS l FROM o{r} t JOIN lumas s ON s.image_id = t.image_id AND s.y = sy AND s.x = sx GROUP BY t.image_id, t.y, t.x)")
        out.append(f"k{r} AS MATERIALIZED (SELECT *, l[len(l) // 2 + 1] > l[1] AND l[len(l) // 2 + 1] < l[len(l)] AS ready FROM l{r})")
        out.append(f"u{r + 1} AS MATERIALIZED (SELECT image_id, y, x FROM k{r} WHERE NOT ready)")
    out.append("f AS (" + " UNION ALL ".join(f"SELECT image_id, y, x, l, list_sort(list_distinct(l)) AS d FROM k{r} WHERE ready" for r in range(1, rmax + 1)) + ")")
    out.append("p AS (SELECT *, len(d) AS n, d[len(d) // 2] AS lower, d[len(d) // 2 + 1] AS upper FROM f)")
    out.append("e AS (SELECT image_id, y, x, any_value(n) AS n, any_value(lower) AS lower, any_value(upper) AS upper, count(*) FILTER (e = lower) AS nl, count(*) FILTER (e = upper) AS nu FROM (SELECT image_id, y, x, n, lower, upper, unnest(l) AS e FROM p) GROUP BY image_id, y, x)")
    out.append("o AS (SELECT image_id, y, x, CASE WHEN n % 2 = 0 AND nl > nu THEN lower ELSE upper END AS v FROM e)")
    return ", ".join(out) + " SELECT l.image_id, l.y, l.x, coalesce(o.v, l.v) AS v FROM lumas l LEFT JOIN o USING (image_id, y, x)"


def asf(size: int = 1) -> str:
    """Close then open, as four rounds over the edges for each size."""
    out, at = [", v0 AS MATERIALIZED (SELECT image_id, y * 2147483648 + x AS node, v FROM lumas)"], 0
    for k in range(1, size + 1):
        for fn, pick in [("max", "greatest")] * k + [("min", "least")] * 2 * k + [("max", "greatest")] * k:
            out.append(f"v{at + 1} AS MATERIALIZED (SELECT v.image_id, v.node, {pick}(any_value(v.v), coalesce({fn}(w.v), any_value(v.v))) AS v FROM v{at} v LEFT JOIN both_ways e ON e.image_id = v.image_id AND e.src = v.node LEFT JOIN v{at} w ON w.image_id = e.image_id AND w.node = e.dst GROUP BY v.image_id, v.node)")
            at += 1
    return ", ".join(out) + f" SELECT * FROM v{at}"


SPECTRUM = """, c AS (SELECT image_id, y // 16 AS ty, x // 16 AS tx, y % 16 AS py, x % 16 AS px, v FROM lumas),
rows AS MATERIALIZED (SELECT image_id, ty, tx, px, f.v AS fy, sum(c.v * cos(2 * pi() * f.v * py / 16)) AS re, -sum(c.v * sin(2 * pi() * f.v * py / 16)) AS im FROM c CROSS JOIN range(-8, 8) f(v) GROUP BY ALL),
full2 AS (SELECT image_id, ty, tx, fy, f.v AS fx, sum(re * cos(2 * pi() * f.v * px / 16) + im * sin(2 * pi() * f.v * px / 16)) AS re, sum(im * cos(2 * pi() * f.v * px / 16) - re * sin(2 * pi() * f.v * px / 16)) AS im FROM rows CROSS JOIN range(-8, 8) f(v) GROUP BY ALL)
SELECT image_id, ty, tx, CAST(floor(sqrt(fy * fy + fx * fx)) AS INT) AS ring, round(sum((re * re + im * im) / 256), 0) AS power FROM full2 GROUP BY ALL"""


def locus(low: int = 1000, high: int = 25000, nm: float = 0.5) -> str:
    """lut: cct, X, Y, Z, u, v."""
    lobe = lambda h, m, a, b: f"{h} * exp(-0.5 * pow((w - {m}) / (CASE WHEN w < {m} THEN {a} ELSE {b} END), 2))"
    curves = ", ".join(f"{' + '.join(lobe(*p) for p in lobes)} AS m{k}" for k, lobes in CURVES.items())
    return f""", waves AS MATERIALIZED (SELECT w, pow(w, -5) * 1e15 AS w5, {curves} FROM (SELECT (380 + range * {nm})::DOUBLE AS w FROM range({int(370 / nm) + 1}))),
sums AS (SELECT t.v AS cct, {', '.join(f'sum(w5 / (exp({C2!r} / (w * t.v)) - 1) * m{k}) AS {k}' for k in 'xyz')} FROM range({low}, {high + 1}) t(v) CROSS JOIN waves GROUP BY t.v),
lut AS MATERIALIZED (SELECT cct, x * 100 / y AS wx, 100.0::DOUBLE AS wy, z * 100 / y AS wz, 4 * x / (x + 15 * y + 3 * z) AS u, 6 * y / (x + 15 * y + 3 * z) AS v FROM sums)"""


def _image_uv() -> str:
    x, y, z = linear(tables.SRGB_TO_XYZ, "rgb")
    return f"{LINEAR_CELLS}, ms AS (SELECT image_id, avg(r) AS r, avg(g) AS g, avg(b) AS b FROM lin GROUP BY image_id), pts AS MATERIALIZED (SELECT image_id, 4 * ({x}) / (({x}) + 15 * ({y}) + 3 * ({z})) AS u, 6 * ({y}) / (({x}) + 15 * ({y}) + 3 * ({z})) AS v FROM ms)"


NEAREST_CCT = f"""{locus()}{_image_uv()}, seg AS (SELECT cct, u AS lu, v AS lv, lead(cct) OVER (ORDER BY cct) AS cct2, lead(u) OVER (ORDER BY cct) AS u2, lead(v) OVER (ORDER BY cct) AS v2 FROM lut),
p AS (SELECT pts.image_id, pts.u, pts.v, seg.*, {clamped('((u - lu) * (u2 - lu) + (v - lv) * (v2 - lv)) / (pow(u2 - lu, 2) + pow(v2 - lv, 2))')} AS t FROM pts CROSS JOIN seg WHERE cct2 IS NOT NULL),
d AS (SELECT image_id, struct_pack(d2 := round(pow(u - lu - t * (u2 - lu), 2) + pow(v - lv - t * (v2 - lv), 2), 15), cct := cct + t * (cct2 - cct), side := sign(v - lv - t * (v2 - lv))) AS m FROM p)
SELECT image_id, round(m.cct, 6) AS cct, round(sqrt(m.d2) * m.side, 6) AS duv FROM (SELECT image_id, min(m) AS m FROM d GROUP BY image_id)"""
PLANCKIAN = f"""{locus()}, tan AS (SELECT cct, u, v, coalesce(lead(u) OVER w, u) - coalesce(lag(u) OVER w, u) AS du, coalesce(lead(v) OVER w, v) - coalesce(lag(v) OVER w, v) AS dv FROM lut WINDOW w AS (ORDER BY cct)),
ask AS (SELECT DISTINCT image_id, 4000 + image_id % 40 * 100 AS cct FROM cells)
SELECT image_id, cct, 0.003::DOUBLE AS duv, round(u - CASE WHEN du <= 0 THEN -1 ELSE 1 END * 0.003::DOUBLE * dv / sqrt(du * du + dv * dv), 6) AS u, round(v + CASE WHEN du <= 0 THEN -1 ELSE 1 END * 0.003::DOUBLE * du / sqrt(du * du + dv * dv), 6) AS v FROM ask JOIN tan USING (cct)"""
SHIFT = f"""{locus(5000, 5000)}{LINEAR_CELLS}, mats AS MATERIALIZED (SELECT image_id, {', '.join(f's{i}' for i in range(9))} FROM ({adaptation('SELECT image_id, count(*) AS n, sum(r) AS sum_r, sum(g) AS sum_g, sum(b) AS sum_b, any_value(wx) AS wx, any_value(wz) AS wz FROM lin CROSS JOIN lut GROUP BY image_id', 'bradford', ['wx', '100.0', 'wz'])}))
SELECT image_id, y, x, {', '.join(f'round(greatest(s{3 * i} * r + s{3 * i + 1} * g + s{3 * i + 2} * b, 0), 6) AS {c}' for i, c in enumerate('rgb'))} FROM lin JOIN mats USING (image_id)"""

# --- cells and their neighbours -----------------------------------------------------------------
CHARCOAL = """, flat AS MATERIALIZED (SELECT image_id, y, x, CASE WHEN round(sqrt(gx * gx + gy * gy), 9) <= 30 THEN 255 - v ELSE 0 END AS v FROM g JOIN lumas USING (image_id, y, x)),
h AS (SELECT image_id, v AS bin, count(*) AS n FROM flat GROUP BY ALL),
c AS (SELECT image_id, bin, sum(n) OVER w AS wb, sum(n * bin) OVER w AS sb, sum(n * bin) OVER (PARTITION BY image_id) AS total FROM h WINDOW w AS (PARTITION BY image_id ORDER BY bin)),
b AS (SELECT image_id, bin, CASE WHEN wb = 4096 THEN 0 ELSE round(wb::DOUBLE * (4096 - wb) * pow(sb / wb::DOUBLE - (total - sb) / (4096 - wb)::DOUBLE, 2), 3) END AS s FROM c),
o AS (SELECT image_id, arg_max(bin, s * 1e6 - bin) AS threshold FROM b GROUP BY image_id),
two AS MATERIALIZED (SELECT image_id, y, x, CASE WHEN v > threshold THEN 255 ELSE 0 END AS v FROM flat JOIN o USING (image_id))
SELECT t.image_id, t.y, t.x, CAST(floor(sum(s.v * k.w) / {norm}) AS INT) AS v FROM two t CROSS JOIN {kernel} JOIN two s ON s.image_id = t.image_id AND s.y = least(greatest(t.y + k.dy, 0), 63) AND s.x = least(greatest(t.x + k.dx, 0), 63) GROUP BY t.image_id, t.y, t.x"""


def cocircular(radius: int, cone: float, circ: float) -> str:
    """After CTEs that end in n: image_id, y, x and the smoothed tensor a, b, c."""
    return f""", q AS (SELECT image_id, y, x, 2 * c AS ex, b - a - sqrt(pow(a - b, 2) + 4 * c * c) AS ey FROM n),
e AS MATERIALIZED (SELECT image_id, y, x, CASE WHEN sqrt(ex * ex + ey * ey) < 1e-9 THEN 0 ELSE ex / sqrt(ex * ex + ey * ey) END AS ex, CASE WHEN sqrt(ex * ex + ey * ey) < 1e-9 THEN 0 ELSE ey / sqrt(ex * ex + ey * ey) END AS ey FROM q),
o AS MATERIALIZED (SELECT t.*, t.y + dy.o AS sy, t.x + dx.o AS sx FROM e t CROSS JOIN range({-radius}, {radius + 1}) dy(o) CROSS JOIN range(0, {radius + 1}) dx(o) WHERE dx.o > 0 OR dy.o > 0),
p AS (SELECT t.image_id, t.y, t.x, s.y AS y2, s.x AS x2, t.ex, t.ey, s.ex AS fx, s.ey AS fy, (s.x - t.x) / sqrt(pow(s.x - t.x, 2) + pow(s.y - t.y, 2)) AS ux, (s.y - t.y) / sqrt(pow(s.x - t.x, 2) + pow(s.y - t.y, 2)) AS uy FROM o t JOIN e s ON s.image_id = t.image_id AND s.y = sy AND s.x = sx)
SELECT image_id, y, x, y2, x2 FROM p WHERE round(abs(ex * ux + ey * uy), 6) >= {round(math.cos(math.radians(cone)), 6)!r}::DOUBLE
  AND round(abs((2 * (ex * ux + ey * uy) * ux - ex) * fx + (2 * (ex * ux + ey * uy) * uy - ey) * fy), 6) >= {round(math.cos(math.radians(circ)), 6)!r}::DOUBLE"""


STRATIFIED = """, leaves AS (SELECT image_id, depth, qy, qx, mass FROM tree WHERE is_leaf), tot AS (SELECT image_id, sum(mass) AS total FROM leaves GROUP BY 1),
w AS (SELECT *, mass * 200.0::DOUBLE / total AS want FROM leaves JOIN tot USING (image_id) WHERE total > 0),
c AS (SELECT *, CAST(floor(want) AS BIGINT) + CASE WHEN {draw0} < want - floor(want) THEN 1 ELSE 0 END AS n, 64 / pow(2, depth) AS s FROM w),
i AS (SELECT *, unnest(range(1, n + 1)) AS i FROM c)
SELECT image_id, ((depth * 4096 + qy) * 4096 + qx) * 1048576 + i AS seed_id, CAST(floor((qy + {draw1}) * s) AS BIGINT) AS y, CAST(floor((qx + {draw2}) * s) AS BIGINT) AS x FROM i"""


def drawn(salt: str, seed: int) -> str:
    key = f"image_id * 7919 + depth * 15485863 + qy * 104729 + qx * 1299709 + ({salt}) * 32452843 + {seed}"
    return f"(((((({key}) * 1103515245 + 12345) % 2147483648) * 1103515245 + 12345) % 2147483648) >> 11) / 1048576.0::DOUBLE"


def block_match(radius: int = 8, k: int = 512, rank: int = 32) -> str:
    """Squared differences for each offset as a moved copy of the image, summed along rows and then columns by windows."""
    return f""", o AS MATERIALIZED (SELECT t.*, CAST(dy.o AS TINYINT) AS dy, CAST(dx.o AS TINYINT) AS dx, t.y + dy.o AS sy, t.x + dx.o AS sx FROM cells t CROSS JOIN range({-radius}, {radius + 1}) dy(o) CROSS JOIN range({-radius}, {radius + 1}) dx(o)),
e AS (SELECT o.image_id, dy, dx, o.y, o.x, pow(o.r - s.r, 2) + pow(o.g - s.g, 2) + pow(o.b - s.b, 2) AS e FROM o JOIN cells s ON s.image_id = o.image_id AND s.y = sy AND s.x = sx),
h AS (SELECT image_id, dy, dx, y, x, sum(e) OVER w AS e, count(*) OVER w AS n FROM e WINDOW w AS (PARTITION BY image_id, dy, dx, y ORDER BY x ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)),
v AS (SELECT image_id, dy, dx, y, x, sum(e) OVER w AS d, sum(n) OVER w AS n FROM h WINDOW w AS (PARTITION BY image_id, dy, dx, x ORDER BY y ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)),
r AS (SELECT *, row_number() OVER (PARTITION BY image_id, y, x ORDER BY dy <> 0 OR dx <> 0, d, dy, dx) AS rank FROM v WHERE n = 16),
z AS (SELECT *, max(d) FILTER (rank <= {rank}) OVER (PARTITION BY image_id, y, x) AS top FROM r)
SELECT image_id, y AS py, x AS px, y + dy AS my, x + dx AS mx, d, CAST(rank AS INT) AS rank FROM z WHERE d <= top AND rank <= {k}"""


#: The transform of 64 x 64 planes by its two sums: along x, then along y.
FFT2 = """, turn AS MATERIALIZED (SELECT k.v AS k, n.v AS n, cos(2 * pi() * ((k.v * n.v) % 64) / 64) AS c, -sin(2 * pi() * ((k.v * n.v) % 64) / 64) AS s FROM range(64) k(v), range(64) n(v)),
along_x AS MATERIALIZED (SELECT image_id, y, k AS x, sum({v} * c) AS re, sum({v} * s) AS im FROM {source} JOIN turn ON n = x GROUP BY image_id, y, k),
spectrum AS MATERIALIZED (SELECT image_id, k AS y, x, sum(re * c - im * s) AS re, sum(re * s + im * c) AS im FROM along_x JOIN turn ON n = y GROUP BY image_id, k, x)"""
#: Every frequency times a Gaussian, and the sums backwards.
LOW_PASS = """, damped AS (SELECT image_id, y, x, re * g AS re, im * g AS im FROM (SELECT *, exp(-2 * pi() * pi() * {sigma} * {sigma} * (pow((CASE WHEN y < 32 THEN y ELSE y - 64 END) / 64.0::DOUBLE, 2) + pow((CASE WHEN x < 32 THEN x ELSE x - 64 END) / 64.0::DOUBLE, 2))) AS g FROM spectrum)),
back_x AS MATERIALIZED (SELECT image_id, y, k AS x, sum(re * c + im * s) / 64 AS re, sum(im * c - re * s) / 64 AS im FROM damped JOIN turn ON n = x GROUP BY image_id, y, k)
SELECT image_id, k AS y, x, round(sum(re * c + im * s) / 64, 4) + 0.0 AS v FROM back_x JOIN turn ON n = y GROUP BY image_id, k, x"""


# --- palettes, with values of their own ------------------------------------------------------------
CGA1 = "(VALUES (0, 0, 0, 0), (1, 0, 170, 0), (2, 170, 0, 0), (3, 170, 85, 0)) p(idx, pr, pg, pb)"
CGA0_BRIGHT = "(VALUES (0, 0, 0, 0), (1, 85, 255, 255), (2, 255, 85, 255), (3, 255, 255, 255)) p(idx, pr, pg, pb)"
EGA_KQ3 = """(VALUES (0, 0, 0, 0), (1, 0, 0, 128), (2, 0, 80, 0), (3, 0, 80, 80), (4, 128, 0, 0), (5, 128, 0, 128), (6, 128, 64, 0), (7, 170, 170, 170),
  (8, 85, 85, 85), (9, 85, 85, 255), (10, 85, 200, 85), (11, 85, 200, 200), (12, 200, 85, 85), (13, 200, 85, 200), (14, 255, 255, 85), (15, 255, 255, 255)) p(idx, pr, pg, pb)"""
#: Red rises 42 or 43 a step, green 32 but for the first, blue 85; the lattice starts at (42, 63, 170), its beginning comes behind six extra colours.
DESKTOP256 = """(WITH a AS (SELECT * FROM (VALUES (0, 0, 0, 0), (1, 128, 0, 0), (2, 0, 128, 0), (3, 128, 128, 0), (4, 0, 0, 128), (5, 128, 0, 128), (6, 0, 128, 128), (7, 192, 192, 192), (8, 192, 220, 192), (9, 166, 202, 240)) t(i, r, g, b)),
z AS (SELECT * FROM (VALUES (0, 255, 251, 240), (1, 160, 160, 164), (2, 128, 128, 128), (3, 255, 0, 0), (4, 0, 255, 0), (5, 255, 255, 0), (6, 0, 0, 255), (7, 255, 0, 255), (8, 0, 255, 255), (9, 255, 255, 255)) t(i, r, g, b)),
l AS (SELECT CAST(floor(i.v * 42.5) AS INT) AS r, CASE WHEN j.v = 0 THEN 0 ELSE CAST(j.v * 32 - 1 AS INT) END AS g, CAST(k.v * 85 AS INT) AS b, (i.v * 9 + j.v) * 4 + k.v AS n FROM range(7) i(v), range(9) j(v), range(4) k(v)),
m AS (SELECT r, g, b, CASE WHEN n >= 46 THEN 1000 + n ELSE 3000 + n END AS n FROM l WHERE (r > 0 OR g >= 127)),
x AS (SELECT r, g, b, 2000 + i AS n FROM (VALUES (0, 204, 204, 255), (1, 255, 204, 255), (2, 51, 255, 255), (3, 102, 255, 255), (4, 153, 255, 255), (5, 204, 255, 255)) t(i, r, g, b)),
u AS (SELECT r, g, b, i AS n FROM a UNION ALL SELECT r, g, b, n FROM m WHERE (r, g, b) NOT IN (SELECT (r, g, b) FROM a UNION ALL SELECT (r, g, b) FROM z) UNION ALL SELECT r, g, b, n FROM x UNION ALL SELECT r, g, b, 9000 + i FROM z)
SELECT CAST(row_number() OVER (ORDER BY n) - 1 AS INT) AS idx, r AS pr, g AS pg, b AS pb FROM u) p"""


def nearest(entries: str) -> str:
    return f""", k AS (SELECT DISTINCT r, g, b FROM cells), n AS (SELECT k.*, idx, pr, pg, pb, row_number() OVER (PARTITION BY r, g, b ORDER BY 30 * pow(r - pr, 2) + 59 * pow(g - pg, 2) + 11 * pow(b - pb, 2), idx) AS i FROM k CROSS JOIN {entries})
SELECT image_id, y, x, idx, pr AS r, pg AS g, pb AS b FROM cells JOIN n USING (r, g, b) WHERE i = 1"""


# --- streams ---------------------------------------------------------------------------------------
#: events with the arrival they come in, and what a stream keeps of them: a row is late if its hour had passed the watermark before.
ARRIVALS = """WITH {recursive}raw AS (SELECT event_id, ts, user_id % 8 AS stream_id, event_type AS channel, CAST(least(floor(value / 2), 255) AS INT) AS value FROM events),
span AS (SELECT min(epoch_us(ts)) AS first, max(epoch_us(ts)) - min(epoch_us(ts)) + 1 AS whole FROM raw),
own AS (SELECT raw.*, (epoch_us(ts) - first) * 5 // whole AS own FROM raw CROSS JOIN span),
came AS MATERIALIZED (SELECT *, own + CASE WHEN event_id % 20 = 0 AND own + 2 < 5 THEN 2 ELSE 0 END AS arrival FROM own),
mark AS (SELECT k.v AS arrival, (SELECT max(ts) - INTERVAL 2 HOUR FROM came WHERE came.arrival < k.v) AS before FROM range(5) k(v)),
f AS MATERIALIZED (SELECT came.* FROM came JOIN mark USING (arrival) WHERE before IS NULL OR date_trunc('hour', ts) + INTERVAL 1 HOUR > before),
done AS (SELECT max(ts) - INTERVAL 2 HOUR AS until FROM came)
"""
CLOSED = "date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT until FROM done)"


def counted_median(r: int) -> str:
    """The middle of (2r + 1)^2 values with border cells repeated, by counts of values: first of a column's cells, then of 2r + 1 columns."""
    size = 2 * r + 1
    return f""", moved AS MATERIALIZED (SELECT image_id, x, l.v, o.ty AS y FROM lumas l CROSS JOIN range(64) o(ty) WHERE abs(o.ty - y) <= {r}
  UNION ALL SELECT image_id, x, l.v, o.ty FROM lumas l CROSS JOIN range(64) o(ty) CROSS JOIN range(1, {r + 1}) k(k) WHERE y = 0 AND o.ty - {r} <= -k.k
  UNION ALL SELECT image_id, x, l.v, o.ty FROM lumas l CROSS JOIN range(64) o(ty) CROSS JOIN range(1, {r + 1}) k(k) WHERE y = 63 AND o.ty + {r} >= 63 + k.k),
tall AS MATERIALIZED (SELECT image_id, y, x, v, count(*) AS n FROM moved GROUP BY ALL),
wide AS MATERIALIZED (SELECT image_id, y, x, v, sum(n) AS n FROM (
  SELECT image_id, y, o.ty AS x, tall.v, n * (1 + CASE WHEN tall.x = 0 THEN greatest({r} - o.ty, 0) ELSE 0 END + CASE WHEN tall.x = 63 THEN greatest(o.ty + {r} - 63, 0) ELSE 0 END) AS n
  FROM tall CROSS JOIN range(64) o(ty) WHERE abs(o.ty - tall.x) <= {r}) GROUP BY image_id, y, x, v),
run AS (SELECT image_id, y, x, v, sum(n) OVER (PARTITION BY image_id, y, x ORDER BY v) AS c FROM wide)
SELECT image_id, y, x, min(v) AS v FROM run WHERE c > {size * size // 2} GROUP BY image_id, y, x"""


def weighted(what: str, rounds: int, norm: float) -> str:
    """After both_ways of all neighbours: values that move along an edge change by norm * log(w), w from the luma difference."""
    fn, pick, sign = ("min", "least", "-") if what == "erode" else ("max", "greatest", "+")
    steps = "".join(f""", v{i + 1} AS MATERIALIZED (SELECT a.image_id, a.node, {pick}(any_value(a.v), {fn}(b.v {sign} e.step)) AS v FROM v{i} a JOIN stepped e ON e.image_id = a.image_id AND e.dst = a.node JOIN v{i} b ON b.image_id = e.image_id AND b.node = e.src GROUP BY a.image_id, a.node)""" for i in range(rounds))
    return f""", v0 AS MATERIALIZED (SELECT image_id, y * 2147483648 + x AS node, v::DOUBLE AS v FROM lumas),
stepped AS MATERIALIZED (SELECT e.image_id, src, dst, {norm!r}::DOUBLE * ln(1 - abs(p.v - q.v) / 256) AS step FROM both_ways e JOIN v0 p ON p.image_id = e.image_id AND p.node = src JOIN v0 q ON q.image_id = e.image_id AND q.node = dst){steps}
SELECT image_id, node, round(v, 6) AS v FROM v{rounds}"""


def quadtree(h: int, w: int, limit: int, side: int = 4) -> str:
    """The tree of h x w images, every depth from cells; part q of a side begins at cell floor(length q / 2^depth)."""
    deepest = 0
    while min(h, w) / 2**deepest > side:
        deepest += 1
    return f""", n AS (SELECT image_id, d.k AS depth, CAST(((y + 1) * (1 << d.k) - 1) // {h} AS BIGINT) AS qy, CAST(((x + 1) * (1 << d.k) - 1) // {w} AS BIGINT) AS qx, CAST(sum(v) AS BIGINT) AS mass FROM lumas CROSS JOIN (SELECT CAST(range AS INT) AS k FROM range({deepest + 1})) d WHERE y < {h} AND x < {w} GROUP BY ALL),
t AS (SELECT n.*, NOT (mass > {limit} AND {min(h, w)} / pow(2, depth) > {side}) AS is_leaf FROM n)
SELECT * FROM t WHERE depth = 0 OR NOT EXISTS (SELECT 1 FROM t p WHERE p.image_id = t.image_id AND p.is_leaf AND p.depth < t.depth AND p.qy = t.qy >> (t.depth - p.depth) AND p.qx = t.qx >> (t.depth - p.depth))"""


def jumped(side: int = 64) -> str:
    """After seeds: the passes of jump flooding, steps from half the side to 1."""
    out, i, step = ", j0 AS MATERIALIZED (SELECT image_id, y, x, min(seed_id) AS sid, y AS sy, x AS sx FROM seeds GROUP BY image_id, y, x)", 0, side // 2
    while step:
        out += f""", j{i + 1} AS MATERIALIZED (SELECT image_id, y, x, m.sid AS sid, m.sy AS sy, m.sx AS sx FROM (
  SELECT image_id, y - a.d AS y, x - b.d AS x, min(struct_pack(d2 := pow(y - a.d - sy, 2) + pow(x - b.d - sx, 2), sid := sid, sy := sy, sx := sx)) AS m
  FROM j{i} CROSS JOIN (VALUES (-{step}), (0), ({step})) a(d) CROSS JOIN (VALUES (-{step}), (0), ({step})) b(d) WHERE y - a.d BETWEEN 0 AND {side - 1} AND x - b.d BETWEEN 0 AND {side - 1} GROUP BY image_id, y - a.d, x - b.d))"""
        i, step = i + 1, step // 2
    return out + f", jump AS (SELECT image_id, y, x, sid AS seed_id, CAST(pow(y - sy, 2) + pow(x - sx, 2) AS BIGINT) AS d2 FROM j{i})"


# --- the principal illuminant: two running counts, moments, and an eigenvector by repeated products ----------
PCA = LINEAR_CELLS + """, good AS (SELECT * FROM lin WHERE greatest(r, g, b) < 0.98 AND 0.2126 * r + 0.7152 * g + 0.0722 * b >= 0.02),
means AS (SELECT image_id, avg(r) AS mr, avg(g) AS mg, avg(b) AS mb, count(*) AS n FROM good GROUP BY 1 HAVING count(*) >= 16),
placed AS MATERIALIZED (SELECT image_id, r, g, b, n, least(CAST(floor((r * mr + g * mg + b * mb) / sqrt(mr * mr + mg * mg + mb * mb) / 1.74::DOUBLE * 4096) AS BIGINT), 4095) AS bin FROM good JOIN means USING (image_id)),
hist AS (SELECT image_id, bin, count(*) AS c, any_value(n) AS n FROM placed GROUP BY 1, 2),
sums AS (SELECT *, sum(c) OVER (PARTITION BY image_id ORDER BY bin) - c AS below, sum(c) OVER (PARTITION BY image_id ORDER BY bin DESC) - c AS above, least(greatest(floor(n * 0.035::DOUBLE + 0.5), 1), floor(n / 2)) AS k FROM hist),
kept AS (SELECT p.* FROM placed p JOIN sums USING (image_id, bin) WHERE below < k OR above < k),
m AS MATERIALIZED (SELECT image_id, avg(r * r) AS rr, avg(r * g) AS rg, avg(r * b) AS rb, avg(g * g) AS gg, avg(g * b) AS gb, avg(b * b) AS bb FROM kept GROUP BY 1),
turn(image_id, i, x, y, z) AS (SELECT image_id, 0, sqrt(1 / 3.0::DOUBLE), sqrt(1 / 3.0::DOUBLE), sqrt(1 / 3.0::DOUBLE) FROM m
  UNION ALL SELECT image_id, i + 1, px / sqrt(px * px + py * py + pz * pz), py / sqrt(px * px + py * py + pz * pz), pz / sqrt(px * px + py * py + pz * pz)
  FROM (SELECT t.image_id, i, rr * x + rg * y + rb * z AS px, rg * x + gg * y + gb * z AS py, rb * x + gb * y + bb * z AS pz FROM turn t JOIN m USING (image_id) WHERE i < 300)),
top AS (SELECT image_id, x, y, z, x >= 0 AND y >= 0 AND z >= 0 AS ok FROM turn WHERE i = 300)
SELECT i.image_id, round(CASE WHEN ok THEN x ELSE sqrt(1 / 3.0::DOUBLE) END, 6) AS er, round(CASE WHEN ok THEN y ELSE sqrt(1 / 3.0::DOUBLE) END, 6) AS eg, round(CASE WHEN ok THEN z ELSE sqrt(1 / 3.0::DOUBLE) END, 6) AS eb, coalesce(ok, false) AS ok
FROM (SELECT DISTINCT image_id FROM cells) i LEFT JOIN top USING (image_id)"""


# --- noise from self-similar blocks ----------------------------------------------------------------
#: Frequencies of all 4 x 4 blocks, the least distance to a block 4 to 13 away on both axes, the best half percent, and deviations from medians.
NOISE = """, wave AS MATERIALIZED (SELECT k.v AS k, i.v AS i, CASE WHEN k.v = 0 THEN sqrt(1 / 4.0::DOUBLE) ELSE sqrt(2 / 4.0::DOUBLE) END * cos(pi() * (2 * i.v + 1) * k.v / 8) AS w FROM range(4) k(v), range(4) i(v)),
rows_of AS MATERIALIZED (SELECT image_id, l.y AS y, l.x - i.v AS x, i.v AS i, l.v FROM lumas l CROSS JOIN range(4) i(v) WHERE l.x - i.v BETWEEN 0 AND 60),
along AS MATERIALIZED (SELECT image_id, y, x, k, sum(v * w) AS f FROM rows_of JOIN wave USING (i) GROUP BY image_id, y, x, k),
squares AS (SELECT image_id, a.y - i AS y, x, wave.k * 4 + a.k AS k, sum(f * w) AS f FROM along a CROSS JOIN wave WHERE a.y - i BETWEEN 0 AND 60 GROUP BY image_id, a.y - i, x, wave.k * 4 + a.k),
blocks AS MATERIALIZED (SELECT b.*, p.v AS v0, q.v AS v1, r.v AS v4, s.v AS v5 FROM (SELECT image_id, y, x, list(f ORDER BY k) AS f FROM squares GROUP BY image_id, y, x) b
  JOIN lumas p ON p.image_id = b.image_id AND p.y = b.y AND p.x = b.x JOIN lumas q ON q.image_id = b.image_id AND q.y = b.y AND q.x = b.x + 1
  JOIN lumas r ON r.image_id = b.image_id AND r.y = b.y + 1 AND r.x = b.x JOIN lumas s ON s.image_id = b.image_id AND s.y = b.y + 1 AND s.x = b.x + 1),
good AS MATERIALIZED (SELECT image_id, y, x, f FROM blocks WHERE NOT (v0 = v1 AND v1 = v4 AND v4 = v5)),
asks AS MATERIALIZED (SELECT g.*, y + dy.o AS sy, x + dx.o AS sx FROM good g CROSS JOIN range(4, 14) dy(o) CROSS JOIN range(4, 14) dx(o)),
pairs AS (SELECT a.image_id, a.y, a.x, list_sum(list_transform(list_slice(list_sort(list_transform(range(1, 17), lambda k: struct_pack(d := round(abs(a.f[k] - b.f[k]), 9), m := round(greatest(abs(a.f[k]), abs(b.f[k])), 9)))), 1, 12), lambda z: z.d * z.m)) AS d
  FROM asks a JOIN good b ON b.image_id = a.image_id AND b.y = sy AND b.x = sx),
near AS (SELECT image_id, y, x, round(min(d), 6) AS d FROM pairs GROUP BY image_id, y, x),
known AS (SELECT n.*, f, f[1] / 4 AS mean, row_number() OVER (PARTITION BY image_id ORDER BY d, y, x) AS nth, count(*) OVER (PARTITION BY image_id) AS n FROM near n JOIN good USING (image_id, y, x)),
best AS MATERIALIZED (SELECT * FROM known WHERE nth <= least(greatest(floor(n * 0.005::DOUBLE), 1), 4000)),
flat_rows AS MATERIALIZED (SELECT image_id, mean, k.v AS k, f[k.v + 1] AS v FROM best CROSS JOIN range(16) k(v)),
middle AS (SELECT image_id, k, median(v) AS m, avg(mean) AS level FROM flat_rows GROUP BY 1, 2),
noise AS MATERIALIZED (SELECT image_id, CAST(0 AS BIGINT) AS bin, any_value(level) AS level, CAST(k AS INT) AS k, median(abs(v - m)) * 1.791106 AS std FROM flat_rows JOIN middle USING (image_id, k) GROUP BY image_id, k)"""
COVARIANCE = NOISE + """, cell AS (SELECT p.k * 4 + q.k AS k, p.i * 4 + q.i AS i, p.w * q.w AS d FROM wave p CROSS JOIN wave q)
SELECT image_id, bin, CAST(a.i AS INT) AS i, CAST(b.i AS INT) AS j, round(sum(std * std * a.d * b.d), 4) + 0.0 AS cov FROM noise JOIN cell a ON a.k = noise.k JOIN cell b ON b.k = noise.k GROUP BY image_id, bin, a.i, b.i"""
