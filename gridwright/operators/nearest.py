"""Nearest and as-of lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import tables
from ..plans.iterate import saved
from ..sources.cells import KEY
from . import stats
from .local import _linear, srgb_to_linear


def interp_lut(asked: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """asked: keys, x; known: keys, x, v. v of each asked x between the known rows on both sides; beyond them the nearest."""
    rows = asked.select(*keys, "x", F.lit(None).cast("double").alias("v"), F.lit(True).alias("ask")).unionByName(known.select(*keys, "x", F.col("v").cast("double").alias("v"), F.lit(False).alias("ask")))
    back = W.partitionBy(*keys).orderBy("x", "ask").rowsBetween(W.unboundedPreceding, 0)
    on = W.partitionBy(*keys).orderBy(F.desc("x"), "ask").rowsBetween(W.unboundedPreceding, 0)
    pair = F.when(~F.col("ask"), F.struct("x", "v"))
    both = rows.withColumn("l", F.last(pair, ignorenulls=True).over(back)).withColumn("r", F.last(pair, ignorenulls=True).over(on)).where("ask")
    left, right = F.coalesce("l", "r"), F.coalesce("r", "l")
    step = both.select(*keys, "x", left.alias("l"), right.alias("r"))
    width = F.col("r.x") - F.col("l.x")
    return step.select(*keys, "x", F.when(width == 0, F.col("l.v")).otherwise(F.col("l.v") + (F.col("r.v") - F.col("l.v")) * (F.col("x") - F.col("l.x")) / width).alias("v")).distinct()


def white_balance(cells: DataFrame, rounds: int = 16, threshold: float = 0.3, illuminant: str = "d65", cat: str = "cat02", stop: float = 1e-8) -> DataFrame:
    """Estimate, correct, repeat. image_id, m0..m8 (the product of all corrections), rounds.

    Only images whose chromaticity still moves stay in the loop; linear cells are stored once, read with the product so
    far and never rewritten. State is one row for each image.
    """
    names = [f"m{i}" for i in range(9)]
    lin = saved(cells.select(*KEY, *(srgb_to_linear(F.col(c) / 255.0).alias(c) for c in "rgb")))
    eye = [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]
    now = saved(cells.select("image_id").distinct().select("image_id", *(F.lit(v).alias(n) for v, n in zip(eye, names, strict=True)), F.lit(9.0).alias("cx"), F.lit(9.0).alias("cy")))
    done = None
    for i in range(1, rounds + 1):
        estimate = stats.gray_sums(stats.apply_row_matrix(lin, now), threshold)
        step = stats.adaptation_matrix(estimate, illuminant, cat).select("image_id", *(F.col(n).alias(f"s{n}") for n in names))
        xyz = _linear(tables.SRGB_TO_XYZ, [F.col(f"sum_{c}") for c in "rgb"])
        total = xyz[0] + xyz[1] + xyz[2]
        chroma = estimate.select("image_id", F.when(total > 0, xyz[0] / total).otherwise(0.0).alias("nx"), F.when(total > 0, xyz[1] / total).otherwise(0.0).alias("ny"))
        joined = now.join(step, "image_id").join(chroma, "image_id")
        product = stats._product([F.col(f"s{n}") for n in names], [F.col(n) for n in names])
        moved = F.pow(F.col("nx") - F.col("cx"), 2) + F.pow(F.col("ny") - F.col("cy"), 2)
        after = saved(joined.select("image_id", *(p.alias(n) for p, n in zip(product, names, strict=True)), F.col("nx").alias("cx"), F.col("ny").alias("cy"), (moved < stop).alias("still")))
        ready = after.where("still").select("image_id", *names, F.lit(i).alias("rounds")) if i < rounds else after.select("image_id", *names, F.lit(i).alias("rounds"))
        done = ready if done is None else done.union(ready)
        now = after.where(~F.col("still")).drop("still")
        if i < rounds and not now.head(1):
            break
    return done


#: Lobes (height, centre, left width, right width) of a published fit of the CIE 1931 curves (fixed values).
CURVES = {
    "x": [(1.056, 599.8, 37.9, 31.0), (0.362, 442.0, 16.0, 26.7), (-0.065, 501.1, 20.4, 26.2)],
    "y": [(0.821, 568.8, 46.9, 40.5), (0.286, 530.9, 16.3, 31.1)],
    "z": [(1.217, 437.0, 11.8, 36.0), (0.681, 459.0, 26.0, 13.8)],
}


def _matching(w: Column, observer: int) -> dict[str, Column]:
    """The observer's curves at a wavelength: two lobes of a bell each for 2 degrees; for 10 degrees the published fit by logarithmic bells."""
    if observer == 2:
        lobe = lambda h, m, s1, s2: h * F.exp(-0.5 * F.pow((w - m) / F.when(w < m, s1).otherwise(s2), 2))
        return {k: sum((lobe(*p) for p in lobes[1:]), lobe(*lobes[0])) for k, lobes in CURVES.items()}
    if observer != 10:
        raise ValueError("observers are 2 and 10")
    return {
        "x": 0.398 * F.exp(-1250 * F.pow(F.log((w + 570.1) / 1014), 2)) + 1.132 * F.exp(-234 * F.pow(F.log((1338 - w) / 743.5), 2)),
        "y": 1.011 * F.exp(-0.5 * F.pow((w - 556.1) / 46.14, 2)),
        "z": 2.06 * F.exp(-32 * F.pow(F.log((w - 265.8) / 180.4), 2)),
    }


def read_curves(lines: DataFrame, column: str = "value") -> DataFrame:
    """w, x, y, z from lines of a published table of an observer ("380.0, 0.001368, 0.000039, 0.006450"; blanks or tabs may part the numbers); other lines are left out."""
    number = r"([-+]?\d*\.?\d+(?:[eE][-+]?\d+)?)"
    part = lambda i: F.regexp_extract(column, rf"^\s*{number}[\s,;]+{number}[\s,;]+{number}[\s,;]+{number}\s*$", i)
    return lines.where(part(1) != "").select(*(part(i).cast("double").alias(n) for i, n in enumerate("wxyz", 1)))


#: Second radiation constant in nanometre kelvins; wavelengths of a tabulated observer.
C2, MOST_WAVES = 1.4388e7, 10_000


def cct_lut(spark: SparkSession, low: int = 1000, high: int = 25000, step: int = 1, nm: float = 5, observer: int = 2, curves: DataFrame | None = None) -> DataFrame:
    """cct, X, Y, Z (Y = 100), u, v: black-body spectra from 380 to 750 nm times the observer's curves, summed by Spark.

    curves: w, x, y, z of a tabulated observer (read_curves()), whose own wavelengths are summed over then; by default the published fits every nm nanometres.
    """
    wave = F.explode(F.transform(F.sequence(F.lit(0), F.lit(int(370 / nm))), lambda i: 380 + i * F.lit(float(nm))))
    rows = spark.range(low, high + 1, step).select(F.col("id").alias("cct"), wave.alias("w")).withColumn("w", F.col("w").cast("double"))
    power = F.pow("w", F.lit(-5.0)) * 1e15 / (F.exp(C2 / (F.col("w") * F.col("cct"))) - 1)
    if curves is None:
        matching = _matching(F.col("w"), observer)
    else:
        # a table of an observer has some hundred wavelengths: more than MOST_WAVES is refused before it is broadcast
        if curves.count() > MOST_WAVES:
            raise ValueError(f"a table of an observer has at most {MOST_WAVES} wavelengths")
        known = curves.where("w BETWEEN 380 AND 750").select("w", *(F.col(c).alias(f"c{c}") for c in "xyz"))
        rows = spark.range(low, high + 1, step).select(F.col("id").alias("cct")).crossJoin(F.broadcast(known))
        matching = {c: F.col(f"c{c}") for c in "xyz"}
    sums = rows.groupBy("cct").agg(*(F.sum(power * v).alias(k) for k, v in matching.items()))
    total = F.col("x") + 15 * F.col("y") + 3 * F.col("z")
    return sums.select("cct", *((F.col(c) * 100 / F.col("y")).alias(c.upper()) for c in "xyz"), (4 * F.col("x") / total).alias("u"), (6 * F.col("y") / total).alias("v"))


def planckian_uv(points: DataFrame, lut: DataFrame) -> DataFrame:
    """points: image_id, cct, duv. The chromaticity at that distance from the locus, along its normal."""
    w = W.orderBy("cct")
    tangent = lut.select("cct", F.col("u").alias("lu"), F.col("v").alias("lv"), (F.coalesce(F.lead("u").over(w), "u") - F.coalesce(F.lag("u").over(w), "u")).alias("du"), (F.coalesce(F.lead("v").over(w), "v") - F.coalesce(F.lag("v").over(w), "v")).alias("dv"))
    size = F.sqrt(F.col("du") * F.col("du") + F.col("dv") * F.col("dv"))
    # the locus runs to smaller u as it gets hotter: its upper side is the normal (-dv, du) turned to larger v
    sign = F.when(F.col("du") <= 0, -1.0).otherwise(1.0)
    return points.join(tangent, "cct").select("image_id", "cct", "duv", (F.col("lu") - sign * F.col("duv") * F.col("dv") / size).alias("u"), (F.col("lv") + sign * F.col("duv") * F.col("du") / size).alias("v"))


def shift_temperature(cells: DataFrame, targets: DataFrame, lut: DataFrame, cat: str = "bradford") -> DataFrame:
    """Each image's mean colour is taken to the locus at its target. targets: image_id, cct. Linear r, g, b come back."""
    lin = cells.select(*KEY, *(srgb_to_linear(F.col(c) / 255.0).alias(c) for c in "rgb"))
    sums = lin.groupBy("image_id").agg(F.count("*").alias("n"), *(F.sum(c).alias(f"sum_{c}") for c in "rgb"))
    wanted = sums.join(targets, "image_id").join(lut.select("cct", F.col("X").alias("wx"), F.col("Y").alias("wy"), F.col("Z").alias("wz")), "cct")
    return stats.apply_row_matrix(lin, stats.adaptation_matrix(wanted, cat=cat, target=("wx", "wy", "wz")))


def nearest_cct(points: DataFrame, locus: DataFrame, bucket: float = 0.01) -> DataFrame:
    """points: image_id, u, v. cct and duv of the nearest place on the locus, between rows by projection on its segments.

    Points meet the segments that begin in the grid buckets around theirs, in an equi-join. An answer is final once it is
    nearer than what that reach covers; only the other points go on to a wider one.
    """
    w = W.orderBy("cct")
    # the locus has at most 24,001 rows
    segments = locus.select("cct", F.col("u").alias("lu"), F.col("v").alias("lv"), F.lead("cct").over(w).alias("cct2"), F.lead("u").over(w).alias("u2"), F.lead("v").over(w).alias("v2")).where("cct2 is not null")
    segments = saved(segments)
    at = lambda c: F.floor(F.col(c) / bucket)
    todo = saved(points.select("image_id", "u", "v"))
    size = F.sqrt(F.pow(F.col("u2") - F.col("lu"), 2) + F.pow(F.col("v2") - F.col("lv"), 2))
    longest, lo, hi = segments.agg(F.max(size), F.min(F.least(at("lu"), at("lv"))), F.max(F.greatest(at("lu"), at("lv")))).first()
    if longest is None:
        raise ValueError("a locus has two rows at least")
    low, high = todo.agg(F.min(F.least(at("u"), at("v"))), F.max(F.greatest(at("u"), at("v")))).first()
    widest = max(int(hi - (low if low is not None else hi)), int((high if high is not None else lo) - lo), 1)
    du, dv = F.col("u2") - F.col("lu"), F.col("v2") - F.col("lv")
    t = F.least(F.greatest(((F.col("u") - F.col("lu")) * du + (F.col("v") - F.col("lv")) * dv) / (du * du + dv * dv), F.lit(0.0)), F.lit(1.0))
    pu, pv = F.col("lu") + F.col("t") * du, F.col("lv") + F.col("t") * dv
    d2 = F.pow(F.col("u") - pu, 2) + F.pow(F.col("v") - pv, 2)
    done, reach = None, 1
    while True:
        span = lambda c: F.explode(F.sequence(at(c) - reach, at(c) + reach))  # noqa: B023, E731
        asks = todo.select("*", span("u").alias("bu")).select("*", span("v").alias("bv"))
        pairs = asks.join(segments.withColumns({"bu": at("lu"), "bv": at("lv")}), ["bu", "bv"]).withColumn("t", t)
        best = pairs.select("image_id", "u", "v", F.struct(F.round(d2, 15).alias("d2"), (F.col("cct") + F.col("t") * (F.col("cct2") - F.col("cct"))).alias("cct"), F.signum(F.col("v") - pv).alias("sign")).alias("m"))
        found = best.groupBy("image_id", "u", "v").agg(F.min("m").alias("m"))
        sure = saved(found if reach >= widest else found.where(F.sqrt("m.d2") + longest <= reach * bucket))
        done = sure if done is None else done.union(sure)
        todo = saved(todo.join(sure, ["image_id", "u", "v"], "left_anti"))
        if reach >= widest or not todo.head(1):
            return done.select("image_id", "m.cct", (F.sqrt("m.d2") * F.col("m.sign")).alias("duv"))
        reach = min(widest, 2 * reach)


def image_uv(cells: DataFrame) -> DataFrame:
    """image_id, u, v: CIE 1960 coordinates of each image's mean linear colour."""
    lin = cells.select("image_id", *(srgb_to_linear(F.col(c) / 255.0).alias(c) for c in "rgb"))
    means = lin.groupBy("image_id").agg(*(F.avg(c).alias(c) for c in "rgb"))
    x, y, z = _linear(tables.SRGB_TO_XYZ, [F.col(c) for c in "rgb"])
    return means.select("image_id", (4 * x / (x + 15 * y + 3 * z)).alias("u"), (6 * y / (x + 15 * y + 3 * z)).alias("v"))
