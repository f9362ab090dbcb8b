"""Geometric operators: cells change places, values stay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..plans.focal import shape
from ..sources.cells import KEY
from .local import noise


def _values(cells: DataFrame) -> list[str]:
    return [c for c in cells.columns if c not in KEY]


def flip(cells: DataFrame, horizontal: bool, vertical: bool) -> DataFrame:
    sized = cells.join(shape(cells), "image_id")
    y = F.col("h") - 1 - F.col("y") if vertical else F.col("y")
    x = F.col("w") - 1 - F.col("x") if horizontal else F.col("x")
    return sized.select("image_id", y.alias("y"), x.alias("x"), *_values(cells))


def mirror(cells: DataFrame, horizontal: bool, vertical: bool) -> DataFrame:
    """The top half onto the bottom (horizontal axis) and the left half onto the right (vertical axis)."""
    sized = cells.join(shape(cells), "image_id")
    keep = F.lit(True)
    ys: Column = F.array("y")
    xs: Column = F.array("x")
    if horizontal:
        keep &= F.col("y") <= F.col("h") - 1 - F.col("y")
        ys = F.array_distinct(F.array(F.col("y"), F.col("h") - 1 - F.col("y")))
    if vertical:
        keep &= F.col("x") <= F.col("w") - 1 - F.col("x")
        xs = F.array_distinct(F.array(F.col("x"), F.col("w") - 1 - F.col("x")))
    half = sized.where(keep)
    rows = half.select("image_id", F.explode(ys).alias("y"), xs.alias("xs"), *_values(cells))
    return rows.select("image_id", "y", F.explode("xs").alias("x"), *_values(cells))


def block_shuffle(cells: DataFrame, n: int, seed: int) -> DataFrame:
    """n x n blocks in an order drawn for each image. Only the list of blocks is sorted."""
    sized = cells.join(shape(cells), "image_id").withColumns({"bh": F.ceil(F.col("h") / n), "bw": F.ceil(F.col("w") / n)})
    placed = sized.withColumn("block", F.floor(F.col("y") / F.col("bh")) * n + F.floor(F.col("x") / F.col("bw")))
    blocks = placed.select("image_id", "block").distinct()
    draw = F.pmod((F.col("block") * 40503 + F.col("image_id") * 9973 + seed) * 1103515245 + 12345, F.lit(1 << 31))
    rank = F.row_number().over(W.partitionBy("image_id").orderBy(draw, "block")) - 1
    moves = blocks.select("image_id", "block", rank.cast("long").alias("target"))
    out = placed.join(moves, ["image_id", "block"])
    y = F.floor(F.col("target") / n) * F.col("bh") + F.pmod(F.col("y"), F.col("bh"))
    x = F.pmod(F.col("target"), F.lit(n)) * F.col("bw") + F.pmod(F.col("x"), F.col("bw"))
    return out.select("image_id", y.alias("y"), x.alias("x"), *_values(cells))


def block_edges(v: Column, size: Column, target: int) -> Column:
    """The block of a coordinate when size is cut to `target` parts and the first ones take what is left over."""
    base, rest = F.floor(size / target), F.pmod(size, F.lit(target))
    wide = rest * (base + 1)
    return F.when(v < wide, F.floor(v / (base + 1))).otherwise(rest + F.floor((v - wide) / F.greatest(base, F.lit(1))))


def with_blocks(cells: DataFrame, th: int, tw: int) -> DataFrame:
    sized = cells.join(shape(cells), "image_id")
    return sized.withColumns({"by": block_edges(F.col("y"), F.col("h"), th), "bx": block_edges(F.col("x"), F.col("w"), tw)}).drop("h", "w")


def resample_blocks(cells: DataFrame, th: int, tw: int) -> DataFrame:
    """image_id, y, x, r, g, b: block means, one row for each block."""
    return with_blocks(cells, th, tw).groupBy("image_id", F.col("by").alias("y"), F.col("bx").alias("x")).agg(*(F.avg(c).alias(c) for c in "rgb"))


def pixelate(cells: DataFrame, th: int, tw: int) -> DataFrame:
    """Every cell shows the mean of its block."""
    blocks = with_blocks(cells, th, tw)
    means = blocks.groupBy("image_id", "by", "bx").agg(*(F.avg(c).alias(c) for c in "rgb"))
    return blocks.select(*KEY, "by", "bx", "a").join(means, ["image_id", "by", "bx"]).select(*KEY, "r", "g", "b", "a")


def augment_displace(cells: DataFrame, dispersion: int, seed: int) -> DataFrame:
    """Every cell reads from a cell up to `dispersion` away, drawn from its key, clamped to the image."""
    sized = cells.select(*KEY).join(shape(cells), "image_id")
    span = 2 * dispersion + 1
    sy = F.least(F.greatest(F.col("y") + F.pmod(noise(seed, 1), F.lit(span)) - dispersion, F.lit(0)), F.col("h") - 1)
    sx = F.least(F.greatest(F.col("x") + F.pmod(noise(seed, 2), F.lit(span)) - dispersion, F.lit(0)), F.col("w") - 1)
    asks = sized.select(*KEY, sy.alias("sy"), sx.alias("sx"))
    source = cells.select("image_id", F.col("y").alias("sy"), F.col("x").alias("sx"), *_values(cells))
    return asks.join(source, ["image_id", "sy", "sx"]).select(*KEY, *_values(cells))
