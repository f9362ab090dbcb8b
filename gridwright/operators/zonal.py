"""Zonal operators: cells grouped by a label, seed or palette entry."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.focal import columns_of, pushed, rows_of, shape, tile_arrays, tile_with_halo
from ..plans.iterate import components, saved, until_stable
from ..sources.cells import KEY, luma
from .focal import gradient, square
from .local import noise, rgb_to_lab

COMPACTNESS = 40.0


def grid_seeds(cells: DataFrame, k: int) -> DataFrame:
    """image_id, label, y, x, r, g, b: centres of a square grid of about k cells a side S = sqrt(N / k)."""
    s = F.floor(F.sqrt(F.col("h") * F.col("w") / float(k)) + 0.5)
    sized = shape(cells).withColumn("s", s)
    line = lambda n: F.sequence(F.lit(0).cast("long"), F.floor(F.col(n) / F.col("s")) - 1)
    rows = sized.select("image_id", "w", "s", F.explode(line("h")).alias("i"), "h").select("image_id", "s", "i", "w", F.explode(line("w")).alias("j"))
    at = lambda v: F.col(v) * F.col("s") + F.floor(F.col("s") / 2)
    places = rows.select("image_id", (F.col("i") * F.floor(F.col("w") / F.col("s")) + F.col("j")).alias("label"), at("i").alias("y"), at("j").alias("x"))
    return places.join(cells.select(*KEY, "r", "g", "b"), KEY).select("image_id", "label", "y", "x", "r", "g", "b")


def perturb_seeds(seeds: DataFrame, cells: DataFrame) -> DataFrame:
    """Seeds move to the least gradient among their 3 x 3 cells; of equals to the first by row and column."""
    g = gradient(cells.select(*KEY, luma().alias("v"))).select(*KEY, F.round("magnitude", 9).alias("m"))
    offsets = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in square(1)])
    asks = seeds.select("image_id", "label", "y", "x", F.explode(offsets).alias("o")).select("image_id", "label", (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x"))
    best = asks.join(g, KEY).groupBy("image_id", "label").agg(F.min(F.struct("m", "y", "x")).alias("b")).select("image_id", "label", "b.y", "b.x")
    return best.join(cells.select(*KEY, "r", "g", "b"), KEY).select("image_id", "label", "y", "x", "r", "g", "b")


def superpixels(cells: DataFrame, k: int, rounds: int = 10, size: int = 32) -> DataFrame:
    """image_id, y, x, label: the nearest centre in colour and place within S, then centres move to their means.

    Cells are stored once as tiles. In a round each tile meets the centres within reach as one array, by an equi-join, and
    sends sums for them; centres are the only state that goes from round to round.
    """
    sized = saved(shape(cells).select("image_id", F.sqrt(F.col("h") * F.col("w") / float(k)).alias("s")))
    tiles = saved(tile_with_halo(cells.select(*KEY, "r", "g", "b"), size, 0, "zero").join(sized, "image_id"))
    names = ("y", "x", "r", "g", "b")
    centres = saved(grid_seeds(cells, k).select("image_id", "label", *(F.col(c).cast("double").alias(f"c{c}") for c in names)))

    def met(centres: DataFrame) -> DataFrame:
        span = lambda c: F.explode(F.sequence(F.floor((F.round(c) - F.col("s")) / size), F.floor((F.round(c) + F.col("s")) / size)))
        near = centres.join(sized, "image_id").select("*", span("cy").alias("ty")).select("*", span("cx").alias("tx"))
        around = near.groupBy("image_id", "ty", "tx").agg(F.sort_array(F.collect_list(F.struct("label", *(f"c{c}" for c in names)))).alias("near"))
        return tiles.join(around, ["image_id", "ty", "tx"], "left").select("image_id", "ty", "tx", "cells", "s", "near")

    for _ in range(rounds):
        sums = met(centres).mapInArrow(_nearest_centres(False), "image_id long, label long, n long, " + ", ".join(f"s{c} double" for c in names))
        means = sums.groupBy("image_id", "label").agg(*((F.sum(f"s{c}") / F.sum("n")).alias(f"n{c}") for c in names))
        # a centre that no cell chose keeps its values
        centres = saved(centres.join(means, ["image_id", "label"], "left").select("image_id", "label", *(F.coalesce(f"n{c}", f"c{c}").alias(f"c{c}") for c in names)))
    # a cell out of every centre's reach joins the component of none
    return met(centres).mapInArrow(_nearest_centres(True), "image_id long, y long, x long, label long")


def _nearest_centres(cells_too: bool):
    """Tiles with their centres to cells with labels, or to sums for each centre; of equals the least label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (image, _, _, y, x, v) in enumerate(tile_arrays(batch, ["r", "g", "b"])):
                s, near = batch.column(4)[i].as_py(), batch.column(5)[i].values
                label = near.field(0).to_numpy() if near is not None else np.zeros(0, np.int64)
                cy, cx, cr, cg, cb = (near.field(k).to_numpy() if near is not None else np.zeros(0) for k in range(1, 6))
                dy, dx = y[:, None] - cy, x[:, None] - cx
                d = (dy * dy + dx * dx) * (COMPACTNESS / s) ** 2 + ((v[:, [0]] - cr) ** 2 + (v[:, [1]] - cg) ** 2 + (v[:, [2]] - cb) ** 2)
                inside = (np.abs(y[:, None] - np.floor(cy + 0.5)) <= s) & (np.abs(x[:, None] - np.floor(cx + 0.5)) <= s)
                d = np.where(inside, np.floor(d * 1e6 + 0.5), np.inf)
                some = inside.any(1)
                best = d.argmin(1) if len(label) else np.zeros(len(y), int)
                if cells_too:
                    found = np.where(some, label[best] if len(label) else -1, -1)
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in (np.full(len(y), image), y, x, found)], [*KEY, "label"])
                    continue
                n = np.bincount(best[some], minlength=len(label))
                sums = [np.bincount(best[some], w[some], minlength=len(label)) for w in (y, x, v[:, 0], v[:, 1], v[:, 2])]
                parts = (np.full((n > 0).sum(), image), label[n > 0], n[n > 0], *(w[n > 0] for w in sums))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in parts], ["image_id", "label", "n", "sy", "sx", "sr", "sg", "sb"])

    return run


def connected_components(labels: DataFrame) -> DataFrame:
    """image_id, y, x, label, part: 4-connected parts of equal label, named by their first cell in scan order.

    Runs of equal cells in a row are the graph's nodes, so it is smaller than the image.
    """
    w = rows_of()
    new = F.coalesce((F.lag("label").over(w) != F.col("label")).cast("int"), F.lit(1))
    marked = labels.select(*KEY, "label", new.alias("new")).withColumn("run", F.sum("new").over(w))
    wide = F.max("x").over(W.partitionBy("image_id", "y")) + 1
    runs = marked.withColumn("node", F.col("y") * F.lit(1 << 31) + F.min("x").over(W.partitionBy("image_id", "y", "run")))
    runs = saved(runs.withColumn("w", wide).select(*KEY, "label", "node"))
    above = runs.select("image_id", (F.col("y") + 1).alias("y"), "x", "label", F.col("node").alias("b"))
    edges = runs.join(above, [*KEY, "label"]).select("image_id", F.col("node").alias("a"), "b").distinct()
    found = components(runs.select("image_id", "node").distinct(), edges, ["image_id"]).withColumnRenamed("label", "part")
    return runs.join(found, ["image_id", "node"]).select(*KEY, "label", "part")


def enforce_connectivity(labels: DataFrame, min_size: int) -> DataFrame:
    """image_id, y, x, label: parts of at most min_size cells join the part left of, else above, their first cell."""
    parts = saved(connected_components(labels))
    sizes = parts.groupBy("image_id", "part").agg(F.count("*").alias("n"), F.min(F.struct("y", "x")).alias("at"))
    first = sizes.where(F.col("n") <= min_size).select("image_id", "part", "at.y", "at.x")
    asks = first.select("image_id", "part", F.explode(F.array(F.struct(F.lit(0).alias("o"), F.col("y").alias("y"), (F.col("x") - 1).alias("x")), F.struct(F.lit(1).alias("o"), (F.col("y") - 1).alias("y"), F.col("x").alias("x")))).alias("q")).select("image_id", "part", "q.*")
    goes = asks.join(parts.select(*KEY, F.col("part").alias("to")), KEY).groupBy("image_id", "part").agg(F.min_by("to", "o").alias("to"))
    start = sizes.select("image_id", "part").join(goes, ["image_id", "part"], "left").select("image_id", "part", F.coalesce("to", "part").alias("to"))

    def jump(now: DataFrame) -> DataFrame:
        onward = now.select("image_id", F.col("part").alias("to"), F.col("to").alias("next"))
        return now.join(onward, ["image_id", "to"]).select("image_id", "part", F.col("next").alias("to"))

    roots = until_stable(start, jump, lambda a, b: a.join(b, ["image_id", "part", "to"], "left_anti"), 64)
    return parts.join(roots, ["image_id", "part"]).select(*KEY, F.col("to").alias("label"))


def zone_recolor(cells: DataFrame, labels: DataFrame) -> DataFrame:
    """Every cell shows its zone's mean."""
    both = cells.select(*KEY, "r", "g", "b").join(labels.select(*KEY, "label"), KEY)
    means = both.groupBy("image_id", "label").agg(*(F.avg(c).alias(c) for c in "rgb"))
    return both.select(*KEY, "label").join(means, ["image_id", "label"]).select(*KEY, "label", "r", "g", "b")


def zone_borders(labels: DataFrame) -> DataFrame:
    """1 where the cell to the right or below has another label."""
    step = labels.select(*KEY, "label", F.lead("label").over(rows_of()).alias("east"))
    step = step.select(*KEY, "label", "east", F.lead("label").over(columns_of()).alias("south"))
    differs = lambda c: F.coalesce(F.col(c) != F.col("label"), F.lit(False))
    return step.select(*KEY, (differs("east") | differs("south")).cast("int").alias("border"))


def _small(palette: DataFrame, most: int = 4096) -> DataFrame:
    """A palette for a broadcast; raises where it has more than `most` entries."""
    n = palette.limit(most + 1).count()
    if n > most:
        raise ValueError(f"a palette has at most {most} entries")
    return F.broadcast(palette)


def nearest_palette(cells: DataFrame, palette: DataFrame) -> DataFrame:
    """Each cell's nearest palette entry at weights .30, .59, .11; of equals the first. Colours are matched once each."""
    colours = cells.select("r", "g", "b").distinct()
    # weights in hundredths keep the distance an integer
    d = 30 * F.pow(F.col("r") - F.col("pr"), 2) + 59 * F.pow(F.col("g") - F.col("pg"), 2) + 11 * F.pow(F.col("b") - F.col("pb"), 2)
    best = colours.join(_small(palette)).groupBy("r", "g", "b").agg(F.min(F.struct(d.alias("d"), "idx", "pr", "pg", "pb")).alias("m"))
    return cells.select(*KEY, "r", "g", "b").join(best, ["r", "g", "b"]).select(*KEY, "m.idx", F.col("m.pr").alias("r"), F.col("m.pg").alias("g"), F.col("m.pb").alias("b"))


def two_color_mix(cells: DataFrame, palette: DataFrame) -> DataFrame:
    """The two palette entries nearest in Lab and the share of the first, d2 / (d1 + d2)."""
    spot = lambda df, names: df.select(F.lit(0).alias("image_id"), F.lit(0).alias("y"), F.lit(0).alias("x"), *(F.col(n).alias(c) for n, c in zip(names, "rgb", strict=True)), F.lit(255).alias("a"))
    lab = lambda df, names, prefix: rgb_to_lab(spot(df, names).withColumn("a", F.struct(*"rgb"))).select("a", F.col("l").alias(f"{prefix}l"), F.col("la").alias(f"{prefix}a"), F.col("lb").alias(f"{prefix}b"))
    colours = lab(cells.select("r", "g", "b").distinct(), "rgb", "c").select("a.*", "cl", "ca", "cb")
    entries = lab(palette, ("pr", "pg", "pb"), "p").select(F.col("a").alias("entry"), "pl", "pa", "pb").join(palette.withColumn("entry", F.struct(F.col("pr").alias("r"), F.col("pg").alias("g"), F.col("pb").alias("b"))).select("entry", "idx"), "entry")
    d = F.round(F.sqrt(F.pow(F.col("cl") - F.col("pl"), 2) + F.pow(F.col("ca") - F.col("pa"), 2) + F.pow(F.col("cb") - F.col("pb"), 2)), 6)
    ranked = colours.join(_small(entries)).groupBy("r", "g", "b").agg(F.slice(F.array_sort(F.collect_list(F.struct(d.alias("d"), "idx"))), 1, 2).alias("two"))
    one, two = F.col("two")[0], F.col("two")[1]
    share = F.when(one["d"] + two["d"] == 0, 1.0).otherwise(two["d"] / (one["d"] + two["d"]))
    mixes = ranked.select("r", "g", "b", one["idx"].alias("first"), two["idx"].alias("second"), share.alias("share"))
    return cells.select(*KEY, "r", "g", "b").join(mixes, ["r", "g", "b"]).select(*KEY, "first", "second", "share")


def node_of(at: Column, length: Column, depth: Column) -> Column:
    """Which of the 2^depth parts of a side a cell lies in; part q begins at cell floor(length q / 2^depth)."""
    # whole numbers of under 53 bits: their quotient's floor is exact
    return F.floor(((at + 1) * F.pow(F.lit(2.0), depth) - 1) / length)


def quadtree(mass: DataFrame, limit: int, side: int = 4) -> DataFrame:
    """image_id, depth, qy, qx, mass, is_leaf of an image's tree: a node over the limit, with both sides over the least one, splits in four halves.

    mass: image_id, y, x, m. Images may have any width and height; how deep a tree may be comes from its image. Cells are summed once, at the deepest
    depth. Every other node is a sum over these by shifted keys, as the borders of a depth are borders of all below. A node is there if its parent splits.
    """
    sizes = shape(mass).withColumn("deepest", F.greatest(F.lit(0), F.ceil(F.log2(F.least("h", "w") / float(side)))).cast("int"))
    deep = mass.select("image_id", "y", "x", "m").join(sizes, "image_id")
    bottom = deep.groupBy("image_id", "h", "w", "deepest", node_of(F.col("y"), F.col("h"), F.col("deepest")).alias("ky"), node_of(F.col("x"), F.col("w"), F.col("deepest")).alias("kx")).agg(F.sum("m").alias("m"))
    up = lambda key: F.floor(F.col(key) / F.pow(F.lit(2.0), F.col("deepest") - F.col("depth")))
    rows = bottom.select("*", F.explode(F.sequence(F.lit(0), F.col("deepest"))).alias("depth"))
    nodes = rows.groupBy("image_id", "h", "w", "depth", up("ky").alias("qy"), up("kx").alias("qx")).agg(F.sum("m").alias("mass"))
    nodes = nodes.withColumn("splits", (F.col("mass") > limit) & (F.least("h", "w") / F.pow(F.lit(2.0), F.col("depth")) > side))
    # masses only grow towards the root, so a parent that splits has no ancestor that does not
    parents = nodes.where("splits").select("image_id", (F.col("depth") + 1).alias("depth"), F.col("qy").alias("py"), F.col("qx").alias("px"))
    there = nodes.withColumns({"py": F.shiftright("qy", 1), "px": F.shiftright("qx", 1)}).join(parents, ["image_id", "depth", "py", "px"], "left_semi")
    kept = ["image_id", "depth", "qy", "qx", "mass", "splits"]
    return nodes.where("depth = 0").select(*kept).union(there.select(*kept)).select(*kept[:-1], (~F.col("splits")).alias("is_leaf"))


def stratified_seeds(tree: DataFrame, target: int, seed: int, sizes: DataFrame | None = None) -> DataFrame:
    """image_id, seed_id, y, x: points of each leaf in proportion to its mass, the fraction drawn, places drawn inside. sizes: image_id, h, w; 64 x 64 where not given."""
    leaves = tree.where("is_leaf")
    total = leaves.groupBy("image_id").agg(F.sum("mass").alias("total"))
    if sizes is None:
        sizes = total.select("image_id", F.lit(64).alias("h"), F.lit(64).alias("w"))

    def unit(salt: Column | int) -> Column:
        """0..1 from a leaf's key and a salt, by the same congruence as `noise`, twice, so that SQL has it too."""
        mixed = F.pmod((F.col("image_id") * 7919 + F.col("depth") * 15485863 + F.col("qy") * 104729 + F.col("qx") * 1299709 + (salt if isinstance(salt, Column) else F.lit(salt)) * 32452843 + seed) * 1103515245 + 12345, F.lit(1 << 31))
        return F.shiftright(F.pmod(mixed * 1103515245 + 12345, F.lit(1 << 31)), 11) / float(1 << 20)

    want = F.col("mass") * float(target) / F.col("total")
    n = F.floor(want) + F.when(unit(0) < want - F.floor(want), 1).otherwise(0)
    points = leaves.join(total, "image_id").where("total > 0").join(sizes, "image_id").select("image_id", "depth", "qy", "qx", "h", "w", n.alias("n")).where("n > 0").select("*", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("i"))
    place = lambda q, n, odd: F.floor((F.col(q) + unit(2 * F.col("i") + odd)) * (F.col(n) / F.pow(F.lit(2.0), F.col("depth"))))
    name = ((F.col("depth") * 4096 + F.col("qy")) * 4096 + F.col("qx")) * 1048576 + F.col("i")
    return points.select("image_id", name.alias("seed_id"), place("qy", "h", 0).alias("y"), place("qx", "w", 1).alias("x"))


def voronoi_assign(cells: DataFrame, seeds: DataFrame, bucket: int = 16) -> DataFrame:
    """image_id, y, x, seed_id (a long), d2: each cell's nearest seed, exactly; of equals the least id.

    The cells of a bucket are one row and so are its seeds; cells meet the seeds of buckets up to `reach` away. An answer is final once its distance is
    within what that reach covers; only the others go on to a wider one. Neither rows nor broadcasts are made for pairs of cells and seeds.
    """
    at, n = ["image_id", "by", "bx"], int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def dealt(rows: DataFrame, items: list[str], name: str) -> DataFrame:
        """One row for each bucket, dealt to tasks by number: buckets are few bytes when compressed, which Spark would put into one task."""
        y, x = items[-2:]
        placed = rows.select("image_id", *items, F.floor(F.col(y) / bucket).alias("by"), F.floor(F.col(x) / bucket).alias("bx")).dropna(subset=at)
        return placed.repartition(n, *at).groupBy(*at).agg(F.collect_list(F.struct(*items)).alias(name))

    # of seeds in one place the least id
    places = seeds.select("image_id", F.col("y").alias("sy"), F.col("x").alias("sx"), F.col("seed_id").cast("long").alias("seed_id")).groupBy("image_id", "sy", "sx").agg(F.min("seed_id").alias("seed_id"))
    spots = saved(dealt(places.dropna(), ["seed_id", "sy", "sx"], "spots"))
    todo = saved(dealt(cells, ["y", "x"], "cells"))
    ends = [f(c) for f in (F.min, F.max) for c in ("by", "bx")]
    (y0, x0, y1, x1), (sy0, sx0, sy1, sx1) = (df.agg(*ends).first() for df in (todo, spots))
    widest = 0 if y0 is None or sy0 is None else max(y1 - sy0, sy1 - y0, x1 - sx0, sx1 - x0)
    one = lambda c: f"{c}: {cells.schema[c].dataType.simpleString()}"
    kind = f"image_id {cells.schema['image_id'].dataType.simpleString()}, by long, bx long, sure array<struct<{one('y')}, {one('x')}, seed_id: long, d2: long>>, cells array<struct<{one('y')}, {one('x')}>>"
    done, reach = None, 1
    while True:
        span = lambda c: F.explode(F.sequence(F.col(c) - reach, F.col(c) + reach))  # noqa: B023, E731
        asks = todo.select(*at, span("by").alias("sby")).select("*", span("bx").alias("sbx"))
        # either side may look small, but a table of buckets grows with the cells: not to be broadcast
        met = asks.hint("merge").join(spots.select("image_id", F.col("by").alias("sby"), F.col("bx").alias("sbx"), "spots"), ["image_id", "sby", "sbx"]).select(*at, "spots")
        rows = todo.unionByName(met, allowMissingColumns=True).repartition(n, *at).sortWithinPartitions(*at, F.col("spots").isNotNull())
        now = saved(rows.select(*at, "cells", "spots").mapInArrow(_nearest_spots(None if reach >= widest else (reach * bucket) ** 2), kind))
        sure = now.select("image_id", F.inline("sure"))
        done = sure if done is None else done.union(sure)
        todo = now.where(F.size("cells") > 0).select(*at, "cells")
        if reach >= widest or not todo.head(1):
            return done
        reach = min(widest, 2 * reach)


def _nearest_spots(limit: int | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of rows image_id, by, bx, cells, spots, sorted so that a bucket's cells come before the seeds that they meet: the cells whose nearest seed is within
    `limit` (None: all that met one) with it, and the other cells. Of a bucket only its cells and their best seeds are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, types = None, None
        for batch in batches:
            made = []
            types = batch.schema.types
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))
            is_cells = batch.column(3).is_valid().to_numpy(zero_copy_only=False)
            stops = [np.cumsum(np.append(0, batch.column(i).value_lengths().fill_null(0).to_numpy())) for i in (3, 4)]
            part = lambda i: [c.to_numpy(zero_copy_only=False) for c in batch.column(i).flatten().flatten()]  # noqa: B023, E731
            (ys, xs), (sids, sys, sxs) = part(3), part(4)
            row = 0
            while row < len(keys):
                if is_cells[row]:
                    made += [held] if held else []
                    place = slice(stops[0][row], stops[0][row + 1])
                    y, x = ys[place], xs[place]
                    order = np.lexsort((x, y))
                    y, x = y[order], x[order]
                    own = np.append(True, (y[1:] != y[:-1]) | (x[1:] != x[:-1]))
                    y, x = y[own], x[own]
                    held = [keys[row], y, x, np.full(len(y), NONE), np.full(len(y), NONE)]
                    row += 1
                    continue
                last = row
                while last < len(keys) and not is_cells[last]:
                    last += 1
                # all of these rows are seeds that the held bucket's cells meet
                _, y, x, best, d2 = held
                few = max(1, (1 << 20) // len(y))
                for lo in range(stops[1][row], stops[1][last], few):
                    some = slice(lo, min(lo + few, stops[1][last]))
                    far = (np.subtract.outer(y, sys[some]).astype(float) ** 2 + np.subtract.outer(x, sxs[some]).astype(float) ** 2).astype(np.int64)
                    least = far.min(axis=1)
                    name = np.where(far == least[:, None], sids[some], NONE).min(axis=1)
                    better = (least < d2) | ((least == d2) & (name < best))
                    best[better], d2[better] = name[better], least[better]
                row = last
            yield _answers(made, limit, types)
        if held:
            yield _answers([held], limit, types)

    return run


def _answers(made: list[list], limit: int | None, types: list[pa.DataType]) -> pa.RecordBatch:
    """made: key, y, x, seed and square of the distance (NONE: no seed was met) of buckets."""
    sure = [d2 != NONE if limit is None else d2 <= limit for *_, d2 in made]

    def lists(columns: list[int], own: list[np.ndarray], names: list[str]) -> pa.ListArray:
        kinds = [types[3].value_type.field(0).type, types[3].value_type.field(1).type, pa.int64(), pa.int64()]
        flat = [pa.array(np.concatenate([m[i][o] for m, o in zip(made, own, strict=True)]) if made else [], kinds[i - 1]) for i in columns]
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(o.sum() for o in own)]), pa.int32()), pa.StructArray.from_arrays(flat, names))

    keys = [pa.array([m[0][i] for m in made], types[i]) for i in range(3)]
    return pa.RecordBatch.from_arrays([*keys, lists([1, 2, 3, 4], sure, ["y", "x", "seed_id", "d2"]), lists([1, 2], [~o for o in sure], ["y", "x"])], ["image_id", "by", "bx", "sure", "cells"])


JUMPED = "image_id long, ty long, tx long, sid array<long>, sy array<long>, sx array<long>"
NOWHERE = -1
#: No seed yet, and farther than any.
NONE = np.iinfo(np.int64).max


def _nearest_of(y: np.ndarray, x: np.ndarray, sid: np.ndarray, sy: np.ndarray, sx: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the choices along the first axis the seed nearest to each cell; of equals the least id. An sy of NOWHERE is no seed."""
    d2 = np.where(sy == NOWHERE, np.iinfo(np.int64).max, (y - sy) ** 2 + (x - sx) ** 2)
    name = np.where(d2 == d2.min(0), sid, np.iinfo(np.int64).max)
    best = np.argmin(name, axis=0)[None]
    return tuple(np.take_along_axis(a, best, axis=0)[0] for a in (sid, sy, sx))


def voronoi_jump(cells: DataFrame, seeds: DataFrame, tile: int = 32) -> DataFrame:
    """image_id, y, x, seed_id, d2 by jump flooding: each cell takes the nearest of the seeds known at the nine cells a step away, for steps halving from half
    the image's longer side (a power of two) to 1.

    It looks at 9 log2(n) places a cell, however few the seeds, and misses the nearest seed for a small share of cells (voronoi_assign() is exact).
    Cells travel as tiles: a step of a tile or more moves whole tiles by equi-joins on their places, all smaller steps together need
    the eight tiles around and are one pass. Seeds beyond the image are left out; of seeds in one cell the least id stays.
    """
    sizes = saved(shape(cells))
    longest = sizes.agg(F.max(F.greatest("h", "w"))).first()[0] or 1
    top = 1
    while top < longest:
        top *= 2
    at = lambda c: F.floor(F.col(c) / tile)
    grid = sizes.select("image_id", "h", "w", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("h") - 1) / tile))).alias("ty")).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("w") - 1) / tile))).alias("tx"))
    inside = seeds.select("image_id", "seed_id", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x")).join(sizes, "image_id").where("y >= 0 AND x >= 0 AND y < h AND x < w")
    spots = inside.groupBy("image_id", at("y").alias("ty"), at("x").alias("tx")).agg(F.collect_list(F.struct("y", "x", "seed_id")).alias("spots"))

    def splat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for spots in batch.column(3).to_pylist():
                sid, sy, sx = (np.full((tile, tile), v, dtype=np.int64) for v in (0, NOWHERE, NOWHERE))
                for s in sorted(spots or [], key=lambda s: -s["seed_id"]):
                    place = (s["y"] % tile, s["x"] % tile)
                    sid[place], sy[place], sx[place] = s["seed_id"], s["y"], s["x"]
                out.append((sid, sy, sx))
            yield _tiles(batch, out)

    now = saved(grid.join(spots, ["image_id", "ty", "tx"], "left").select("image_id", "ty", "tx", "spots").mapInArrow(splat, JUMPED))
    step = top // 2
    while step >= tile:
        now = saved(_jumped(now, grid, tile, step // tile, [step]))
        step //= 2
    # an image needs only the steps below its own size; a longer one's steps find nothing more in it
    small = [s for s in (step >> i for i in range(step.bit_length())) if s]
    now = _jumped(now, grid, tile, 1, small) if small else now
    flat = now.select("image_id", "ty", "tx", F.posexplode(F.arrays_zip("sid", "sy", "sx")).alias("i", "s"))
    y, x = F.col("ty") * tile + F.floor(F.col("i") / tile), F.col("tx") * tile + F.col("i") % tile
    found = flat.where(F.col("s.sy") != NOWHERE).select("image_id", y.alias("y"), x.alias("x"), F.col("s.sid").alias("seed_id"), (F.pow(y - F.col("s.sy"), 2) + F.pow(x - F.col("s.sx"), 2)).cast("long").alias("d2"))
    return cells.select(*KEY).join(found, KEY)


def _tiles(batch: pa.RecordBatch, made: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    lists = [pa.array([m[i].ravel() for m in made], pa.list_(pa.int64())) for i in range(3)]
    return pa.RecordBatch.from_arrays([*batch.columns[:3], *lists], ["image_id", "ty", "tx", "sid", "sy", "sx"])


def _jumped(now: DataFrame, grid: DataFrame, tile: int, reach: int, steps: list[int]) -> DataFrame:
    """The tiles after these steps, from each tile and the eight that lie `reach` tiles away."""
    away = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]))
    sent = now.withColumn("o", away).select("image_id", (F.col("ty") - F.col("o.dy") * reach).alias("ty"), (F.col("tx") - F.col("o.dx") * reach).alias("tx"), F.struct("o.dy", "o.dx", "sid", "sy", "sx").alias("part"))
    # tiles are few bytes when compressed and much work: dealt by number, as Spark would put thousands of them into one task and one batch
    sent = sent.repartition(int(now.sparkSession.conf.get("spark.sql.shuffle.partitions")), "image_id", "ty", "tx")
    met = sent.join(grid.select("image_id", "ty", "tx", "h", "w"), ["image_id", "ty", "tx"]).groupBy("image_id", "ty", "tx").agg(F.collect_list("part").alias("parts"), F.first("h").alias("h"), F.first("w").alias("w"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            parts, (tys, txs, hs, ws) = batch.column(3), (batch.column(i).to_numpy() for i in (1, 2, 4, 5))
            flat, stops = parts.flatten(), np.cumsum(parts.value_lengths().to_numpy()).astype(int)
            take = lambda n: flat.field(flat.type.get_field_index(n))  # noqa: B023, E731
            dy, dx = take("dy").to_numpy() + 1, take("dx").to_numpy() + 1
            known = [take(c).flatten().to_numpy().reshape(-1, tile, tile) for c in ("sid", "sy", "sx")]
            for ty, tx, h, w, first, stop in zip(tys, txs, hs, ws, [0, *stops[:-1]], stops, strict=True):
                state = [np.full((3 * tile, 3 * tile), v, dtype=np.int64) for v in (0, NOWHERE, NOWHERE)]
                for p in range(first, stop):
                    where = (slice(dy[p] * tile, (dy[p] + 1) * tile), slice(dx[p] * tile, (dx[p] + 1) * tile))
                    for s, c in zip(state, known, strict=True):
                        s[where] = c[p]
                if len(steps) == 1 and steps[0] >= tile:
                    # only the middle tile changes, from the cells of the same place in the others
                    choices = [np.stack([s[i * tile : (i + 1) * tile, j * tile : (j + 1) * tile] for i in range(3) for j in range(3)]) for s in state]
                    y, x = np.meshgrid(np.arange(tile) + ty * tile, np.arange(tile) + tx * tile, indexing="ij")
                    sid, sy, sx = _nearest_of(y, x, *choices)
                    real = (y < h) & (x < w)
                    out.append((sid, np.where(real, sy, NOWHERE), np.where(real, sx, NOWHERE)))
                    continue
                y, x = np.meshgrid(np.arange(3 * tile) + (ty - 1) * tile, np.arange(3 * tile) + (tx - 1) * tile, indexing="ij")
                real = (y >= 0) & (x >= 0) & (y < h) & (x < w)
                for step in steps:
                    wide = [np.pad(s, step, constant_values=v) for s, v in zip(state, (0, NOWHERE, NOWHERE), strict=True)]
                    n = 3 * tile
                    choices = [np.stack([s[i : i + n, j : j + n] for i in (0, step, 2 * step) for j in (0, step, 2 * step)]) for s in wide]
                    sid, sy, sx = _nearest_of(y, x, *choices)
                    # there is nothing beyond the image, not even on the way
                    state = [sid, np.where(real, sy, NOWHERE), np.where(real, sx, NOWHERE)]
                out.append(tuple(s[tile : 2 * tile, tile : 2 * tile] for s in state))
            yield _tiles(batch, out)

    return met.select("image_id", "ty", "tx", "parts", "h", "w").mapInArrow(run, JUMPED)


def lloyd_relax(mass: DataFrame, seeds: DataFrame, rounds: int = 1) -> DataFrame:
    """Seeds move to the weighted mean of their cells (rounded down); those without weight stay. mass: image_id, y, x, m."""
    now = seeds.select("image_id", "seed_id", "y", "x")
    for _ in range(rounds):
        own = voronoi_assign(mass, now).join(mass, KEY)
        mean = lambda v: F.floor(F.sum(F.col(v) * F.col("m")) / F.sum("m"))
        moved = own.groupBy("image_id", "seed_id").agg(F.sum("m").alias("w"), mean("y").alias("ny"), mean("x").alias("nx"))
        now = saved(now.join(moved, ["image_id", "seed_id"], "left").select("image_id", "seed_id", F.when(F.col("w") > 1e-4, F.col("ny")).otherwise(F.col("y")).alias("y"), F.when(F.col("w") > 1e-4, F.col("nx")).otherwise(F.col("x")).alias("x")))
    return now


def hashed_seeds(cells: DataFrame, every: int, seed: int) -> DataFrame:
    """image_id, seed_id, y, x: about one cell in `every`, drawn from its key."""
    return cells.where(F.pmod(noise(seed, 0) * 256 + noise(seed, 1), F.lit(every)) == 0).select("image_id", (F.col("y") * F.lit(1 << 31) + F.col("x")).alias("seed_id"), "y", "x")


class SeedPoints:
    """Table function: rows image_id, y, x go in, about one in `every` comes out as image_id, seed_id, y, x; the same cells as hashed_seeds draws. A batch of rows at a time."""

    def eval(self, rows: pa.RecordBatch, every: pa.Array, seed: pa.Array) -> Iterator[pa.Table]:
        image, y, x = (rows.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in KEY)
        if not len(image):
            return
        # 64 bits that run over keep the low 31, which is all that counts
        drawn = [((image * 7919 + y * 104729 + x * 1299709 + k * 15485863 + seed[0].as_py()) * 1103515245 + 12345) % 2**31 // 256 % 256 for k in (0, 1)]
        own = (drawn[0] * 256 + drawn[1]) % every[0].as_py() == 0
        yield pa.table({"image_id": image[own], "seed_id": y[own] * 2**31 + x[own], "y": y[own], "x": x[own]})


def register_seeds(spark: SparkSession, name: str = "seeds") -> None:
    """SELECT * FROM seeds(TABLE(cells) PARTITION BY image_id, every, seed)"""
    spark.udtf.register(name, F.arrow_udtf(SeedPoints, returnType="image_id bigint, seed_id bigint, y bigint, x bigint"))


def label_windows(labels: DataFrame) -> DataFrame:
    """image_id, label, n, y0, y1, x0, x1: size and box of each zone."""
    return labels.groupBy("image_id", "label").agg(F.count("*").alias("n"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("x").alias("x0"), F.max("x").alias("x1"))


def neighbour_zones(labels: DataFrame) -> DataFrame:
    """image_id, a, b, n: pairs of zones that touch and along how many cell sides."""
    near = pushed(labels.select(*KEY, "label"), [(0, 1), (1, 0)], "shrink").withColumnRenamed("label", "other").join(labels.select(*KEY, "label"), KEY)
    return near.where("other <> label").groupBy("image_id", F.least("label", "other").alias("a"), F.greatest("label", "other").alias("b")).agg(F.count("*").alias("n"))
