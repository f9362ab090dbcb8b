"""Global operators: one aggregate for each image, joined back to its cells where cells are wanted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import tables
from ..sources.cells import KEY, clamp, luma
from .local import _linear, srgb_to_linear

BIN = ["image_id", "channel"]


def long_channels(cells: DataFrame, with_luma: bool = False) -> DataFrame:
    """image_id, channel, bin: three (or four) rows for each cell."""
    pairs = [F.struct(F.lit(c).alias("channel"), F.col(c).alias("bin")) for c in "rgb"]
    if with_luma:
        pairs.append(F.struct(F.lit("luma").alias("channel"), luma().alias("bin")))
    return cells.select("image_id", F.explode(F.array(*pairs)).alias("p")).select("image_id", "p.*")


def histogram(cells: DataFrame, with_luma: bool = False) -> DataFrame:
    """image_id, channel, bin, n: only bins that occur."""
    return long_channels(cells, with_luma).groupBy(*BIN, "bin").agg(F.count("*").alias("n"))


def luma_histogram(cells: DataFrame) -> DataFrame:
    return cells.groupBy("image_id", luma().alias("bin")).agg(F.count("*").alias("n"))


def dense(hist: DataFrame, bins: int = 256) -> DataFrame:
    """All bins, with n = 0 where there is none."""
    keys = [c for c in hist.columns if c not in ("bin", "n")]
    spine = hist.select(*keys).distinct().select(*keys, F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return spine.join(hist, [*keys, "bin"], "left").select(*keys, "bin", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def binarize_hist(hist: DataFrame, noise: int = 1, bins: int = 256) -> DataFrame:
    """n becomes 1 where it is over the noise, else 0."""
    return dense(hist, bins).withColumn("n", (F.col("n") > noise).cast("long"))


def cumulative_hist(hist: DataFrame) -> DataFrame:
    keys = [c for c in hist.columns if c not in ("bin", "n")]
    run = W.partitionBy(*keys).orderBy("bin").rowsBetween(W.unboundedPreceding, 0)
    return hist.withColumn("c", F.sum("n").over(run))


def build_lut(cumulative: DataFrame, top: int = 255) -> DataFrame:
    """image_id, v_in, v_out: the cumulative share scaled to 0..top, half up."""
    keys = [c for c in cumulative.columns if c not in ("bin", "n", "c")]
    total = F.max("c").over(W.partitionBy(*keys))
    return cumulative.select(*keys, F.col("bin").alias("v_in"), F.when(total == 0, F.col("bin")).otherwise(F.floor(F.col("c") * float(top) / total + 0.5)).cast("int").alias("v_out"))


def apply_lut(planes: DataFrame, lut: DataFrame) -> DataFrame:
    """planes: image_id, y, x, v"""
    return planes.join(lut.withColumnRenamed("v_in", "v"), ["image_id", "v"]).select(*KEY, "v", "v_out")


def equalize_linear(cells: DataFrame, noise: int = 1) -> DataFrame:
    """Luma equalised; image_id, y, x, v, v_out."""
    lut = build_lut(cumulative_hist(binarize_hist(luma_histogram(cells), noise)))
    return apply_lut(cells.select(*KEY, luma().alias("v")), lut)


def equalize_clipped(cells: DataFrame, left: int, right: int) -> DataFrame:
    """Only bins whose running count lies in [left, right] count; the table truncates."""
    c = cumulative_hist(dense(luma_histogram(cells)))
    kept = c.select("image_id", "bin", F.when((F.col("c") >= left) & (F.col("c") <= right), (F.col("n") > 0).cast("long")).otherwise(F.lit(0).cast("long")).alias("n"))
    run = cumulative_hist(kept)
    total = F.max("c").over(W.partitionBy("image_id"))
    lut = run.select("image_id", F.col("bin").alias("v_in"), F.when(total == 0, F.col("bin")).otherwise(F.floor(F.col("c") * 255.0 / total)).cast("int").alias("v_out"))
    return apply_lut(cells.select(*KEY, luma().alias("v")), lut)


def otsu_threshold(hist: DataFrame) -> DataFrame:
    """image_id, threshold: the first bin of the largest variance between classes; foreground is above it."""
    run = W.partitionBy("image_id").orderBy("bin").rowsBetween(W.unboundedPreceding, 0)
    whole = W.partitionBy("image_id")
    step = hist.select("image_id", "bin", F.sum("n").over(run).alias("wb"), F.sum(F.col("n") * F.col("bin")).over(run).alias("sb"), F.sum("n").over(whole).alias("total"), F.sum(F.col("n") * F.col("bin")).over(whole).alias("sum"))
    wf = F.col("total") - F.col("wb")
    gap = F.col("sb") / F.col("wb") - (F.col("sum") - F.col("sb")) / wf
    # rounded, so that equal variances tie whatever the order of additions
    scored = step.select("image_id", "bin", F.when(wf == 0, 0.0).otherwise(F.round(F.col("wb").cast("double") * wf * gap * gap, 3)).alias("between"))
    return scored.groupBy("image_id").agg(F.min_by("bin", F.struct(-F.col("between"), F.col("bin"))).alias("threshold"))


def otsu_binarize(cells: DataFrame) -> DataFrame:
    planes = cells.select(*KEY, luma().alias("v"))
    return planes.join(otsu_threshold(luma_histogram(cells)), "image_id").select(*KEY, F.when(F.col("v") > F.col("threshold"), 255).otherwise(0).alias("v"))


def gray_world(cells: DataFrame) -> DataFrame:
    """Channels scaled so that each image's mean is half of white."""
    means = cells.groupBy("image_id").agg(*(F.avg(c).alias(f"m_{c}") for c in "rgb"))
    return cells.join(means, "image_id").select(*KEY, *(F.when(F.col(f"m_{c}") == 0, F.col(c).cast("double")).otherwise(clamp(F.col(c) * 127.5 / F.col(f"m_{c}"), 255.0)).alias(c) for c in "rgb"), "a")


def gray_pixel_estimate(cells: DataFrame, threshold: float = 0.3, step: int = 1) -> DataFrame:
    """image_id, n and the sums of linear r, g, b over cells that are nearly gray, neither clipped nor black."""
    lin = cells.select(*KEY, *(srgb_to_linear(F.col(c) / 255.0).alias(c) for c in "rgb"))
    if step > 1:
        lin = lin.where(F.pmod(F.col("y") + F.col("x"), F.lit(step)) == 0)
    return gray_sums(lin, threshold)


def gray_sums(lin: DataFrame, threshold: float) -> DataFrame:
    r, g, b = F.col("r"), F.col("g"), F.col("b")
    lum, c1, c2 = (r + g + b) / 3**0.5, (r - g) / 2**0.5, (r + g - 2 * b) / 6**0.5
    gray = (F.greatest(r, g, b) < 0.98) & (F.least(r, g, b) >= 1e-4) & (c1 * c1 + c2 * c2 < F.pow(threshold * F.greatest(lum, F.lit(1e-6)), 2))
    return lin.groupBy("image_id").agg(F.count_if(gray).alias("n"), *(F.coalesce(F.sum(F.when(gray, F.col(c))), F.lit(0.0)).alias(f"sum_{c}") for c in "rgb"))


def _product(a: list[Column], b: list[Column]) -> list[Column]:
    return [sum((a[3 * i + k] * b[3 * k + j] for k in range(1, 3)), a[3 * i] * b[j]) for i in range(3) for j in range(3)]


def _inverse(m: list[float]) -> list[float]:
    import numpy as np

    return np.linalg.inv(np.array(m).reshape(3, 3)).reshape(-1).tolist()


def adaptation_matrix(estimate: DataFrame, illuminant: str = "d65", cat: str = "cat02", target: tuple[str, str, str] | None = None) -> DataFrame:
    """image_id, m0..m8: corrects linear sRGB by diagonal gains in cone space; identity without gray cells.

    target: columns of estimate with the wanted white as X, Y, Z at Y = 100, instead of an illuminant.
    """
    n = F.greatest(F.col("n"), F.lit(1)).cast("double")
    xyz = _linear(tables.SRGB_TO_XYZ, [F.col(f"sum_{c}") / n for c in "rgb"])
    a = tables.ADAPTATION[cat]
    step = estimate.select("image_id", "n", *(target or ()), *(v.alias(k) for v, k in zip(xyz, "XYZ", strict=True)))
    scaled = [F.col(k) * 100.0 / F.col("Y") for k in "XYZ"]
    have, want = _linear(a, scaled), _linear(a, [F.col(c) for c in target] if target else [F.lit(v) for v in tables.ILLUMINANTS[illuminant]])
    gains = [w / h for w, h in zip(want, have, strict=True)]
    lit = lambda m: [F.lit(float(v)) for v in m]
    left = _matmul(tables.XYZ_TO_SRGB, _inverse(a))
    right = _matmul(a, tables.SRGB_TO_XYZ)
    scaled_right = [gains[i // 3] * v for i, v in enumerate(lit(right))]
    m = _product(lit(left), scaled_right)
    ok = (F.col("n") > 0) & (F.col("Y") > 1e-9)
    eye = [1.0, 0, 0, 0, 1.0, 0, 0, 0, 1.0]
    return step.select("image_id", *(F.when(ok, v).otherwise(F.lit(float(e))).alias(f"m{i}") for i, (v, e) in enumerate(zip(m, eye, strict=True))))


def _matmul(a: list[float], b: list[float]) -> list[float]:
    return [sum(a[3 * i + k] * b[3 * k + j] for k in range(3)) for i in range(3) for j in range(3)]


def apply_row_matrix(lin: DataFrame, matrices: DataFrame) -> DataFrame:
    """Each image's own matrix on its linear channels, floored at zero."""
    joined = lin.join(matrices, "image_id")
    rows = [F.col(f"m{3 * i}") * F.col("r") + F.col(f"m{3 * i + 1}") * F.col("g") + F.col(f"m{3 * i + 2}") * F.col("b") for i in range(3)]
    return joined.select(*KEY, *(F.greatest(v, F.lit(0.0)).alias(c) for v, c in zip(rows, "rgb", strict=True)))


def max_normalize(planes: DataFrame) -> DataFrame:
    """v over the image's largest v."""
    top = planes.groupBy("image_id").agg(F.max("v").alias("top"))
    return planes.join(top, "image_id").select(*KEY, F.when(F.col("top") == 0, 0.0).otherwise(F.col("v") / F.col("top")).alias("v"))


def min_block_std(planes: DataFrame, size: int = 8) -> DataFrame:
    """image_id, noise_floor: the least standard deviation over 0 of a block."""
    blocks = planes.groupBy("image_id", F.floor(F.col("y") / size), F.floor(F.col("x") / size)).agg(F.round(F.stddev_samp("v"), 9).alias("s"))
    return blocks.groupBy("image_id").agg(F.min(F.when(F.col("s") > 0, F.col("s"))).alias("noise_floor"))


def hist_extrema(hist: DataFrame) -> DataFrame:
    """image_id, kind, bin: minima and maxima of a dense histogram; a flat one counts once, at its middle."""
    w = W.partitionBy("image_id").orderBy("bin")
    changed = (F.col("n") != F.lag("n").over(w)) | F.lag("n").over(w).isNull()
    islands = hist.withColumn("new", changed.cast("int")).withColumn("run", F.sum("new").over(w))
    runs = islands.groupBy("image_id", "run", "n").agg(F.min("bin").alias("lo"), F.max("bin").alias("hi"))
    v = W.partitionBy("image_id").orderBy("run")
    before, after = F.lag("n").over(v), F.lead("n").over(v)
    low = (before.isNull() | (before > F.col("n"))) & (after.isNull() | (after > F.col("n")))
    high = (before.isNull() | (before < F.col("n"))) & (after.isNull() | (after < F.col("n")))
    both = runs.withColumns({"low": low, "high": high, "only": before.isNull() & after.isNull()}).where("(low or high) and not only")
    return both.select("image_id", F.when(F.col("low"), "min").otherwise("max").alias("kind"), F.floor((F.col("lo") + F.col("hi")) / 2).alias("bin"))


def image_profile(cells: DataFrame) -> DataFrame:
    """Statistics by image and channel, by image over all channels ('all'), and of the corpus (image -1)."""
    rows = long_channels(cells, with_luma=True)
    sets = rows.groupingSets([["image_id", "channel"], ["image_id"], []], "image_id", "channel")
    out = sets.agg(
        F.min("bin").alias("low"), F.max("bin").alias("high"), F.round(F.avg("bin"), 6).alias("mean"), F.round(F.stddev_pop("bin"), 6).alias("std"),
        F.round(F.avg((F.col("bin") >= 250).cast("int")), 6).alias("clipped"), F.round(F.avg((F.col("bin") == 0).cast("int")), 6).alias("black"), F.count("*").alias("n"),
    )
    return out.withColumns({"image_id": F.coalesce("image_id", F.lit(-1)), "channel": F.coalesce("channel", F.lit("all"))})


def entropy(hist: DataFrame) -> DataFrame:
    """image_id, bits"""
    total = F.sum("n").over(W.partitionBy("image_id"))
    p = hist.select("image_id", (F.col("n") / total).alias("p"))
    return p.groupBy("image_id").agg(F.round(-F.sum(F.col("p") * F.log2("p")), 6).alias("bits"))
