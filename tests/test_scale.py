"""What keeps plans whole on larger tables: sizes that Spark can tell, and work that is dealt to many tasks."""

import duckdb
import numpy as np
import pytest

from pyspark.sql.functions import col as spark_col

from gridwright import queries
from gridwright.operators import denoise, focal, geometry, graph, segment, zonal
from gridwright.sources import cells as src
from gridwright.sources import frames as fr


@pytest.fixture(scope="module")
def few_rows(tmp_path_factory):
    """Forty images of one row each."""
    at = tmp_path_factory.mktemp("few")
    duckdb.sql(f"COPY (SELECT range * 12 AS l_suppkey, range AS l_orderkey, range AS l_partkey, 3.0 AS l_quantity, 0.02 AS l_discount, 0.04 AS l_tax FROM range(40)) TO '{at}/lineitem.parquet' (FORMAT parquet)")
    return str(at)


def test_cells_are_dealt_to_many_tasks(spark, few_rows):
    places = src.from_lineitem(spark, few_rows).select(*src.KEY)
    assert places.count() == 40 * 64 * 64
    assert places.rdd.getNumPartitions() > 1


def test_cells_do_not_look_small_enough_to_broadcast(spark, few_rows):
    cells = src.from_lineitem(spark, few_rows)
    size = lambda df: int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    assert size(cells.select(*src.KEY)) >= 40 * 64 * 64 * 24
    moved = geometry.augment_displace(cells, 3, 5)
    assert moved.count() == 40 * 64 * 64
    plan = moved._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "BroadcastHashJoin" in line and "sy#" in line]


def test_many_small_frames_share_tasks(tmp_path):
    for i in range(400):
        (tmp_path / f"{i}.32f").write_bytes(bytes(12 * 12 * 12))
    reader = fr.FrameReader({"path": str(tmp_path), "format": "32f", "height": "12", "width": "12", "split": "144"})
    parts = reader.partitions()
    assert len(parts) <= 300
    seen = [(r["path"], r["y"], r["x"]) for p in parts for b in reader.read(p) for r in b.to_pylist()]
    assert len(seen) == len(set(seen)) == 400 * 144


def test_seed_function_takes_batches(spark):
    cells = spark.range(1 << 15).selectExpr("id div 4096 * 1007 AS image_id", "id % 4096 div 64 AS y", "id % 64 AS x")
    zonal.register_seeds(spark)
    cells.createOrReplaceTempView("some_cells")
    found = spark.sql("SELECT * FROM seeds(TABLE(some_cells) PARTITION BY (image_id), 97, 9)")
    assert "ArrowEvalPythonUDTF" in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(found.collect()) == sorted(zonal.hashed_seeds(cells, 97, 9).select(*found.columns).collect())


def test_histograms_are_dealt_to_many_tasks(spark):
    hist = spark.range(64 * 4).selectExpr("id div 4 AS image_id", "id % 4 AS bin", "id % 3 + 1 AS n").repartition("image_id")
    found = segment.hist_segment(hist, bins=4)
    assert found.select("image_id").distinct().count() == 64
    assert found.rdd.getNumPartitions() > 1


def _square(spark, side, seed=3):
    v = np.random.default_rng(seed).integers(0, 256, (side, side, 4))
    return spark.createDataFrame([(0, y, x, *(int(n) for n in v[y, x])) for y in range(side) for x in range(side)], "image_id long, y long, x long, r int, g int, b int, a int")


def test_modes_do_not_multiply_rows(spark):
    cells = _square(spark, 9).withColumn("r", (spark_col("r") % 3))
    found = focal.mode_filter(cells, 3)
    assert "MapInArrow" in found._jdf.queryExecution().executedPlan().toString()
    r = {(c["y"], c["x"]): c["r"] for c in cells.collect()}
    for c in found.collect():
        near = [r[y, x] for y in range(c["y"], min(c["y"] + 3, 9)) for x in range(c["x"], min(c["x"] + 3, 9))]
        assert c["r"] == max(near, key=lambda v: (near.count(v), v))


def test_a_null_counts_as_the_least_mode(spark):
    cells = spark.sql("SELECT 0L AS image_id, 0L AS y, id AS x, CAST(IF(id = 1, 4, NULL) AS INT) AS r, 1 AS g, 2 AS b FROM range(3)")
    assert [c["r"] for c in focal.mode_filter(cells, 2).orderBy("x").collect()] == [4, 4, None]


def test_noise_levels_are_dealt_to_many_tasks(spark):
    profile = spark.range(8 * 16).selectExpr("id div 16 AS image_id", "0L AS bin", "CAST(id AS DOUBLE) AS level", "CAST(id % 16 AS INT) AS k", "CAST(id AS DOUBLE) AS std").coalesce(1)
    found = denoise.noise_levels(profile)
    assert found.count() == 8 * 16 * 256
    assert found.rdd.getNumPartitions() > 1


@pytest.mark.parametrize("cells_a_bin", [500, 42_000])
def test_tiles_send_only_blocks_that_can_be_best(spark, monkeypatch, cells_a_bin):
    monkeypatch.setattr(denoise, "CELLS_A_BIN", cells_a_bin)
    v = np.random.default_rng(5).integers(0, 256, (50, 41)) // 4 + np.arange(50)[:, None] * 2 - 90
    planes = spark.createDataFrame([(7, y, x, int(v[y, x])) for y in range(50) for x in range(41)], "image_id long, y long, x long, v int")
    seen, plain = [], denoise.saved
    monkeypatch.setattr(denoise, "saved", lambda df: seen.append(plain(df)) or seen[-1])
    got = {(r["bin"], r["k"]): (r["level"], r["std"]) for r in denoise.noise_profile(planes, share=0.02).collect()}
    blocks = denoise.self_similar(planes).toPandas()
    # the best alone are stored
    assert max(df.count() for df in seen) <= 0.02 * len(blocks) + 64
    bins = max(1, 50 * 41 // cells_a_bin)
    blocks["bin"] = np.minimum(np.floor((blocks["mean"] - blocks["mean"].min()) / (blocks["mean"].max() - blocks["mean"].min()) * bins), bins - 1)
    raw, level = np.zeros((bins, 16)), np.zeros(bins)
    for i, part in blocks.groupby("bin"):
        best = part.sort_values(["d", "py", "px"]).head(max(1, int(len(part) * 0.02)))
        f = np.stack(best["f"])
        raw[int(i)], level[int(i)] = np.median(np.abs(f - np.median(f, axis=0)), axis=0) * denoise.MAD_TO_STD, best["mean"].mean()
    assert len(got) == bins * 16
    for i in range(bins):
        want = raw[max(i - 1, 0) : i + 2].mean(0)
        assert np.allclose([got[i, k] for k in range(16)], np.stack([np.full(16, level[i]), want], axis=1))


def test_a_filter_of_many_steps_stores_its_edges_once(spark, monkeypatch):
    values = spark.sql("SELECT 0L AS image_id, id AS node, CAST(id * 7 % 10 AS INT) AS v FROM range(12)")
    # node 99 is none: an edge to it changes nothing
    edges = spark.sql("SELECT 0L AS image_id, id AS src, IF(id = 11, 99L, id + 1) AS dst FROM range(12)")
    seen, plain = [], graph.saved
    monkeypatch.setattr(graph, "saved", lambda df: seen.append(df.columns) or plain(df))
    got = [r["v"] for r in graph.graph_asf(values, edges, 2).orderBy("node").collect()]
    assert sum("dst" in c for c in seen) == 1
    now = [i * 7 % 10 for i in range(12)]
    for fn, k in ((max, 1), (min, 1), (min, 1), (max, 1), (max, 2), (min, 2), (min, 2), (max, 2)):
        for _ in range(k):
            now = [fn(now[max(i - 1, 0) : i + 2]) for i in range(12)]
    assert got == now


def test_edges_need_no_size_of_the_image(spark):
    plan = graph.grid_edges(_square(spark, 6).withColumnRenamed("r", "v"), 40)._jdf.queryExecution().optimizedPlan().toString()
    assert "max(y" not in plan


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_kernels_do_not_multiply_rows(spark):
    cells = _square(spark, 11)
    found = focal.convolve(cells, "sharp_5")
    assert "explode(array(struct" not in _plan(found) and "Generate explode([[" not in _plan(found) and "MapInArrow" in _plan(found)
    weights, norm = focal.tables.kernel("sharp_5")
    g = {(c["y"], c["x"]): c["g"] for c in cells.collect()}
    for c in found.collect():
        total = sum(k * g.get((c["y"] - dy, c["x"] - dx), 0) for dy, dx, k in weights)
        assert c["g"] == min(max(total, 0) // norm, 255)
    assert found.select("a").exceptAll(cells.select("a")).count() == 0


@pytest.mark.parametrize("shape", ["disk", "frame"])
def test_elements_do_not_multiply_rows(spark, shape):
    planes = _square(spark, 37).select(*src.KEY, spark_col("r").alias("v"))
    size = 7 if shape == "disk" else 5
    low, high = focal.erode(planes, shape, size), focal.dilate(planes, shape, size)
    assert "MapInArrow" in _plan(low) and "MapInArrow" in _plan(high)
    v = {(c["y"], c["x"]): c["v"] for c in planes.collect()}
    clip = lambda n: min(max(n, 0), 36)
    for df, fn in ((low, min), (high, max)):
        for c in df.collect():
            assert c["v"] == fn(v[clip(c["y"] + dy), clip(c["x"] + dx)] for dy, dx in focal.tables.mask(shape, size))


def test_elements_in_an_image_with_holes(spark):
    planes = spark.sql("SELECT 0L AS image_id, id div 9 AS y, id % 9 AS x, CAST(IF(id = 40, NULL, id + 3) AS INT) AS v FROM range(81) WHERE id NOT IN (41, 80, 79, 71)")
    assert planes.count() == focal.erode(planes, "disk", 7).count()
    got = {(c["y"], c["x"]): c["v"] for c in focal.erode(planes, "frame", 5).collect()}
    assert min(got.values()) == 3 and got[2, 2] == 3 and got[4, 4] == 2 * 9 + 2 + 3


def test_charcoal_neither_multiplies_rows_nor_broadcasts_cells(spark, few_rows):
    found = focal.charcoal(src.with_luma(src.from_lineitem(spark, few_rows)), 30.0)
    assert "MapInArrow" in _plan(found)
    assert found.count() == 40 * 64 * 64


def _most_rows_broadcast(spark, run):
    """Of all jobs of run(), those of loops and checkpoints too."""
    bus, store = spark.sparkContext._jsc.sc().listenerBus(), spark._jsparkSession.sharedState().statusStore()
    bus.waitUntilEmpty()
    each = lambda seq: (seq.apply(i) for i in range(seq.size()))
    before, most = {e.executionId() for e in each(store.executionsList())}, 0
    run()
    bus.waitUntilEmpty()
    for done in (e.executionId() for e in each(store.executionsList()) if e.executionId() not in before):
        values = store.executionMetrics(done)
        for node in each(store.planGraph(done).allNodes()):
            for m in each(node.metrics()):
                if node.name() == "BroadcastExchange" and m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                    most = max(most, int(values.apply(m.accumulatorId()).replace(",", "")))
    return most


@pytest.fixture(scope="module")
def many_rows(tmp_path_factory):
    """Forty images of 4,096 rows each, no cell black; keys that do not compress, as Spark takes a table for as large as its file."""
    at = tmp_path_factory.mktemp("many")
    duckdb.sql(f"COPY (SELECT range % 40 * 12 AS l_suppkey, range // 40 % 64 + hash(range) % 1000000000 // 64 * 64 AS l_orderkey, range // 2560 AS l_partkey, 9.0 + range % 31 AS l_quantity, 0.02 + range % 7 / 100 AS l_discount, 0.04 AS l_tax FROM range(163840)) TO '{at}/lineitem.parquet' (FORMAT parquet)")
    return str(at)


@pytest.mark.parametrize("name", ["pca_illuminant", "perturb_seeds", "voronoi_jump", "voronoi_jump_error"])
def test_no_broadcast_grows_with_the_cells(spark, many_rows, name):
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    # 163,840 cells are more than that, 64 lines or 40 images are less
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100k")
    try:
        most = _most_rows_broadcast(spark, lambda: queries.QUERIES[name](spark, many_rows).write.format("noop").mode("overwrite").save())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert 0 < most < 100 * 1024 // 8


def test_jumps_are_dealt_to_many_tasks(spark):
    cells = spark.range(1 << 14).selectExpr("id div 4096 AS image_id", "id % 4096 div 64 AS y", "id % 64 AS x")
    grid = spark.range(64).selectExpr("id div 16 AS image_id", "id % 16 div 4 AS ty", "id % 4 AS tx", "64L AS h", "64L AS w")
    known = grid.selectExpr("image_id", "ty", "tx", "array_repeat(ty * 4 + tx, 256) AS sid", "array_repeat(ty * 16, 256) AS sy", "array_repeat(tx * 16, 256) AS sx")
    moved = zonal._jumped(known, grid, 16, 1, [16])
    assert moved.count() == 64 and moved.rdd.getNumPartitions() == 4
    assert {r["seed_id"] for r in zonal.voronoi_jump(cells, spark.range(4).selectExpr("id AS image_id", "id + 5 AS seed_id", "9 AS y", "9 AS x"), 16).collect()} == {5, 6, 7, 8}


def test_nearest_seeds_are_met_without_a_broadcast(spark):
    rng = np.random.default_rng(4)
    # image 0 has far seeds (outside too) and a place with two, image 1 many, image 2 none, image 3 no cells; one cell is there twice and one has no place
    seeds = [(0, 9, -40, 70), (0, 5, 60, 3), (0, 4, 60, 3), *((1, i, int(y), int(x)) for i, (y, x) in enumerate(rng.integers(0, 64, (60, 2)))), (3, 1, 2, 2)]
    cells = [(i, y, x) for i in range(3) for y in range(64) for x in range(64) if (y, x) != (7, 7)]
    plane = spark.createDataFrame([*cells, cells[3], (1, None, 2)], "image_id long, y int, x int")
    spots = spark.createDataFrame(seeds, "image_id long, seed_id long, y int, x int")
    got = []
    assert _most_rows_broadcast(spark, lambda: got.extend(zonal.voronoi_assign(plane, spots, 4).collect())) == 0
    best = lambda i, y, x: min(((y - sy) ** 2 + (x - sx) ** 2, s) for j, s, sy, sx in seeds if i == j)
    assert sorted(map(tuple, got)) == sorted((*c, *best(*c)[::-1]) for c in cells if c[0] < 2)


def test_blocks_are_transformed_where_their_cells_meet(spark):
    """A cell travels once and unmultiplied; batches may end anywhere in a block."""
    rng = np.random.default_rng(2)
    rows = [(i, y, x, None if i == 2 and y < 4 and x < 4 else float(rng.integers(0, 256))) for i in (0, 2, None) for y in range(-4, 9) for x in range(7) if rng.random() < 0.9]
    rows += [(0, 1, 1, 40.0), (0, None, 3, 5.0), (0, 3, None, 5.0), (2, 5, 5, None)]
    planes = spark.createDataFrame(rows, "image_id long, y long, x long, v double")
    basis = np.array(focal.dct_basis(4))
    for size, inverse in ((3, False), (1000, True)):
        blocks, some = {}, set()
        for i, y, x, v in rows:
            if y is not None and x is not None:
                block = blocks.setdefault((i, y // 4, x // 4), np.zeros((4, 4)))
                if v is not None:
                    block[y % 4, x % 4] += v
                    some.add((i, y // 4, x // 4))
        d = basis.T if inverse else basis
        want = {(i, by * 4 + y, bx * 4 + x): (d @ b @ d.T)[y, x] if (i, by, bx) in some else None for (i, by, bx), b in blocks.items() for y in range(4) for x in range(4)}
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            got = {(r.image_id, r.y, r.x): r.v for r in focal.dct_blocks(planes, 4, inverse).collect()}
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert set(got) == set(want) and len(some) < len(blocks)
        assert all((got[k] is None) == (v is None) and (v is None or abs(got[k] - v) < 1e-9) for k, v in want.items())
    plan = focal.dct_blocks(planes, 4)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and plan.count("Exchange ") == 1


def test_block_distances_order_pairs_only_where_differences_are_equal(monkeypatch):
    rng = np.random.default_rng(14)
    kinds, plain = [], np.partition
    monkeypatch.setattr(denoise.np, "partition", lambda a, *args, **more: kinds.append((a.dtype.kind, len(a))) or plain(a, *args, **more))

    def twin(a, b):
        pairs = sorted((round(abs(p - q), 9), round(max(abs(p), abs(q)), 9)) for p, q in zip(a, b))
        return sum(d * w for d, w in pairs[:12])

    a, b = rng.normal(0, 30, (2, 40, 16))
    assert np.allclose(denoise.sparse_distance(a, b), [twin(p, q) for p, q in zip(a, b)], rtol=0, atol=1e-8)
    assert kinds == [("f", 40)]
    # some rows with equal differences at the border
    a[:9], b[:9] = rng.integers(-3, 4, (2, 9, 16))
    weights = denoise._weights(a), denoise._weights(b)
    for got in (denoise.sparse_distance(a, b), denoise.sparse_distance(a, b, *weights)):
        assert np.allclose(got, [twin(p, q) for p, q in zip(a, b)], rtol=0, atol=1e-8)
    assert ("c", 9) in kinds or any(k == "c" and n < 9 for k, n in kinds)
    assert np.allclose(denoise.sparse_distance(a[0], b), [twin(a[0], q) for q in b], rtol=0, atol=1e-8)
