"""Trees of any size, jump flooding and weighted morphology against plain loops."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridwright.operators import graph, nearest, segment, zonal
from gridwright.sources.cells import KEY


def frame(spark, grids, name="m"):
    rows = [(i, y, x, int(v)) for i, g in grids.items() for y, row in enumerate(g) for x, v in enumerate(row)]
    return spark.createDataFrame(rows, f"image_id long, y long, x long, {name} int").repartition(4)


def plain_tree(g, limit, side):
    out, todo = set(), [(0, 0, 0, 0.0, 0.0, float(g.shape[0]), float(g.shape[1]))]
    while todo:
        depth, qy, qx, y, x, h, w = todo.pop()
        mass = int(g[int(y) : int(y + h), int(x) : int(x + w)].sum())
        splits = mass > limit and w > side and h > side
        out.add((depth, qy, qx, mass, not splits))
        if splits:
            todo += [(depth + 1, 2 * qy + i, 2 * qx + j, y + i * h / 2, x + j * w / 2, h / 2, w / 2) for i in (0, 1) for j in (0, 1)]
    return out


def test_trees_of_any_size(spark):
    rng = np.random.default_rng(3)
    grids = {i: rng.integers(0, 9, s) * (rng.random(s) < 0.4) for i, s in enumerate([(100, 37), (64, 64), (5, 5), (4, 90), (1, 1), (33, 129)])}
    for limit, side in ((20, 4), (0, 2), (10**9, 4)):
        got = {}
        for r in zonal.quadtree(frame(spark, grids), limit, side).collect():
            got.setdefault(r.image_id, set()).add((r.depth, r.qy, r.qx, r.mass, r.is_leaf))
        assert got == {i: plain_tree(g, limit, side) for i, g in grids.items()}


def test_seeds_stay_in_their_leaves(spark):
    g = frame(spark, {0: np.random.default_rng(1).integers(0, 50, (100, 37))})
    tree = zonal.quadtree(g, 300)
    sizes = spark.createDataFrame([(0, 100, 37)], "image_id long, h long, w long")
    seeds = zonal.stratified_seeds(tree, 400, 5, sizes).collect()
    leaves = {(r.depth, r.qy, r.qx) for r in tree.where("is_leaf").collect()}
    assert 330 < len(seeds) < 470
    for s in seeds:
        depth, qy, qx = s.seed_id >> 44, (s.seed_id >> 32) % 4096, (s.seed_id >> 20) % 4096
        assert (depth, qy, qx) in leaves and 0 <= s.y < 100 and 0 <= s.x < 37
        assert math.floor(100 * qy / 2**depth) <= s.y <= 100 * (qy + 1) / 2**depth and math.floor(37 * qx / 2**depth) <= s.x <= 37 * (qx + 1) / 2**depth


def plain_jump(h, w, seeds, top):
    state = {}
    for sid, y, x in sorted(seeds, reverse=True):
        if 0 <= y < h and 0 <= x < w:
            state[y, x] = (sid, y, x)
    step = top // 2
    while step:
        new = {}
        for y in range(h):
            for x in range(w):
                near = [state[p] for p in ((y + i, x + j) for i in (-step, 0, step) for j in (-step, 0, step)) if p in state]
                if near:
                    new[y, x] = min(near, key=lambda s: ((y - s[1]) ** 2 + (x - s[2]) ** 2, s[0]))
        state, step = new, step // 2
    return {p: (s[0], (p[0] - s[1]) ** 2 + (p[1] - s[2]) ** 2) for p, s in state.items()}


@pytest.mark.parametrize("tile", [8, 16, 64])
def test_jumps_equal_passes_over_cells(spark, tile):
    rng = np.random.default_rng(7)
    shapes = {0: (50, 70), 1: (9, 33), 2: (64, 64)}
    cells = frame(spark, {i: np.zeros(s, int) for i, s in shapes.items()})
    seeds = [(i, k, int(rng.integers(-2, s[0] + 2)), int(rng.integers(0, s[1]))) for i, s in shapes.items() for k in range(14)] + [(2, 99, 5, 5), (2, 98, 5, 5)]
    got = {}
    for r in zonal.voronoi_jump(cells, spark.createDataFrame(seeds, "image_id long, seed_id long, y int, x int"), tile).collect():
        got.setdefault(r.image_id, {})[r.y, r.x] = (r.seed_id, r.d2)
    assert got == {i: plain_jump(*s, [t[1:] for t in seeds if t[0] == i], 128) for i, s in shapes.items()}
    none = zonal.voronoi_jump(cells, spark.createDataFrame(seeds, "image_id long, seed_id long, y int, x int").limit(0), tile)
    assert none.count() == 0


def plain_weighted(v, edges, norm, rounds, sign):
    for _ in range(rounds):
        new = dict(v)
        for a, b, w in edges:
            for x, y in ((a, b), (b, a)):
                step = v[x] + sign * norm * math.log(w)
                new[y] = max(new[y], step) if sign > 0 else min(new[y], step)
        if new == v:
            break
        v = new
    return v


def test_weighted_morphology(spark):
    rng = np.random.default_rng(2)
    g = rng.integers(0, 256, (7, 9))
    planes = frame(spark, {0: g}, "v")
    nodes = planes.select("image_id", (F.col("y") * F.lit(1 << 31) + F.col("x")).alias("node"), "v")
    edges = graph.luma_weights(planes)
    known = [(r.src, r.dst, r.w) for r in edges.collect()]
    assert len(known) == 7 * 8 + 6 * 9
    value = {(y << 31) + x: float(g[y, x]) for y in range(7) for x in range(9)}
    assert all(abs(w - (1 - abs(value[a] - value[b]) / 256)) < 1e-12 for a, b, w in known)
    for fn, sign in ((graph.weighted_erode, -1), (graph.weighted_dilate, 1)):
        for rounds in (1, 3, None):
            got = {r.node: r.v for r in fn(nodes, edges, 15.0, rounds).collect()}
            want = plain_weighted(value, known, 15.0, rounds or 1000, sign)
            assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    # an edge of no weight leads nowhere, one of weight 1 costs nothing
    two = spark.createDataFrame([(0, 1, 10), (0, 2, 20), (0, 3, 5)], "image_id long, node long, v int")
    ends = spark.createDataFrame([(0, 1, 2, 1.0), (0, 2, 3, 0.0), (0, 1, 3, None)], "image_id long, src long, dst long, w double")
    assert sorted((r.node, r.v) for r in graph.weighted_erode(two, ends, 3.0, None).collect()) == [(1, 10.0), (2, 10.0), (3, 5.0)]
    with pytest.raises(ValueError):
        graph.weighted_dilate(two, ends.withColumn("w", F.lit(2.0)), 3.0, None)
    assert KEY[0] == "image_id"


def test_tabulated_observers(spark):
    """A table of the fitted curves, as text, gives the fits' own chromaticities."""
    waves = spark.range(75).select((F.col("id") * 5 + 380).cast("double").alias("w"))
    fits = waves.select("w", *(c.alias(k) for k, c in nearest._matching(F.col("w"), 10).items()))
    lines = fits.select(F.format_string("%.1f, %.17e  %.17e;\t%.17e", "w", "x", "y", "z").alias("value")).union(spark.createDataFrame([("nm x y z",), ("",), ("380 1 2",)], "value string"))
    got = nearest.cct_lut(spark, 2000, 9000, 500, curves=nearest.read_curves(lines)).orderBy("cct").collect()
    want = nearest.cct_lut(spark, 2000, 9000, 500, observer=10).orderBy("cct").collect()
    assert len(got) == 15 and all(abs(a.u - b.u) < 1e-12 and abs(a.v - b.v) < 1e-12 and abs(a.X - b.X) < 1e-9 for a, b in zip(got, want, strict=True))
    with pytest.raises(ValueError):
        nearest.cct_lut(spark, curves=spark.range(20_000).selectExpr("double(id) AS w", "1.0 AS x", "1.0 AS y", "1.0 AS z"))


def test_misfit_in_blocks(monkeypatch):
    """The worst sub-interval of a long histogram, against all pairs at once."""
    monkeypatch.setattr(segment, "PAIRS", 5000)
    rng = np.random.default_rng(6)
    for length in (2, 3, 50, 1500):
        h = rng.integers(0, 40, length).astype(float)
        fit = segment._monotone(h, True)
        a, b, n = np.append(0, np.cumsum(h)), np.append(0, np.cumsum(fit)), h.sum()
        i, j = np.triu_indices(length + 1, 1)
        r, p = (a[j] - a[i]) / n, np.clip((b[j] - b[i]) / n, 1e-12, 1 - 1e-12)
        e = np.where(r > 0, r * np.log(np.maximum(r, 1e-300) / p), 0) + np.where(r < 1, (1 - r) * np.log(np.maximum(1 - r, 1e-300) / (1 - p)), 0)
        assert abs(segment._misfit(h, fit, 1.0) - ((n * e).max() - math.log(length * (length + 1) / 2))) < 1e-9
