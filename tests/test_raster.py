"""Golden images, properties and sources."""

import inspect
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridwright import queries
from gridwright.functions import tables
from gridwright.operators import denoise, focal, geometry, graph, local, nearest, perceptual, segment, stats, zonal
from gridwright.plans import iterate
from gridwright.plans.focal import focal_udf, pushed, tiled
from gridwright.sources import cells as src
from gridwright.sources.cells import KEY
from gridwright.streaming import frames


def plane(spark, grid, partitions=3):
    rows = [(0, y, x, int(v)) for y, row in enumerate(grid) for x, v in enumerate(row)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "image_id long, y long, x long, v int").repartition(partitions)


def grid(df, column="v"):
    rows = df.collect()
    out = np.full((max(r.y for r in rows) + 1, max(r.x for r in rows) + 1), np.nan)
    for r in rows:
        out[r.y, r.x] = r[column]
    return out


RAMP = np.arange(25).reshape(5, 5)
IMPULSE = np.zeros((5, 5), int)
IMPULSE[2, 2] = 255
CORNER = np.zeros((5, 5), int)
CORNER[0, 0] = 255
NOISE = np.random.default_rng(4).integers(0, 256, (12, 17))


def color(spark, grid_):
    return plane(spark, grid_).select(*KEY, F.col("v").alias("r"), F.col("v").alias("g"), F.col("v").alias("b"), F.lit(255).alias("a"))


def test_edges_of_neighbourhoods(spark):
    p = plane(spark, CORNER)
    total = lambda edge: grid(pushed(p, focal.square(1), edge).groupBy(*KEY).agg(F.sum("v").alias("v")))[0, 0]
    assert (total("zero"), total("clamp"), total("shrink"), total("mirror")) == (255, 4 * 255, 255, 255)
    n = pushed(p, focal.square(1), "shrink").groupBy(*KEY).count()
    assert grid(n, "count")[0, 0] == 4 and grid(n, "count")[2, 2] == 9


def test_golden_images(spark):
    assert (grid(focal.box_mean(plane(spark, np.full((5, 5), 7)), 1)) == 7).all()
    assert grid(focal.box_mean(plane(spark, IMPULSE), 1)).astype(int).tolist()[2] == [0, 28, 28, 28, 0]
    assert (grid(focal.median(plane(spark, IMPULSE), 3)) == 0).all()
    g = focal.gradient(plane(spark, RAMP))
    assert (grid(g, "gx") == 1).all() and (grid(g, "gy") == 5).all()
    assert grid(focal.dilate(plane(spark, IMPULSE), "cross", 3)).sum() == 5 * 255
    out = grid(focal.convolve(color(spark, IMPULSE), "motion_right_9"), "r")
    assert [int(out[i, i]) for i in range(5)] == [28] * 5 and out.sum() == 5 * 28
    clean = grid(focal.adaptive_median(plane(spark, np.where(IMPULSE > 0, 255, RAMP + 50)), 3))
    assert clean[2, 2] < 100 and clean[1, 1] == RAMP[1, 1] + 50


@pytest.mark.parametrize("partitions", [1, 40])
def test_morphology_has_its_properties(spark, partitions):
    p = plane(spark, NOISE, partitions)
    for shape in ("square", "diamond", "disk", "cross"):
        low, high = grid(focal.erode(p, shape, 3)), grid(focal.dilate(p, shape, 3))
        assert (low <= NOISE).all() and (high >= NOISE).all()
        opened = focal.morph_open(p, shape, 3)
        assert (grid(opened) == grid(focal.morph_open(opened, shape, 3))).all()


@pytest.mark.parametrize("edge", ["clamp", "mirror", "zero"])
@pytest.mark.parametrize("size", [8, 64])
def test_tiles_equal_pushes(spark, edge, size):
    p = plane(spark, NOISE)
    fn = lambda b: sum(b[dy : b.shape[0] - 2 + dy, dx : b.shape[1] - 2 + dx] for dy in range(3) for dx in range(3))
    want = grid(pushed(p, focal.square(1), edge).groupBy(*KEY).agg(F.sum("v").alias("v")))
    assert (grid(tiled(p, fn, 1, ["v"], edge, size)) == want).all()
    if edge == "clamp":
        doubled = focal_udf(lambda b: 2 * b[1:-1, 1:-1], 1)(color(spark, NOISE))
        assert (grid(doubled, "g") == 2 * NOISE).all()


def test_round_trips(spark):
    c = color(spark, NOISE)
    assert (grid(geometry.flip(geometry.flip(c, True, True), True, True), "r") == NOISE).all()
    even = plane(spark, NOISE[:8, :8])
    assert np.allclose(grid(focal.reconstruct(focal.pyramid(even, 2))), NOISE[:8, :8])
    assert np.allclose(grid(focal.dct_blocks(focal.dct_blocks(even, 4), 4, inverse=True)), NOISE[:8, :8])
    assert sorted(grid(geometry.block_shuffle(color(spark, NOISE[:8, :8]), 2, 3), "r").ravel()) == sorted(NOISE[:8, :8].ravel())
    displaced = grid(geometry.augment_displace(c, 2, 1), "r")
    assert set(displaced.ravel()) <= set(NOISE.ravel())


def test_histograms_and_tables(spark):
    c = color(spark, NOISE)
    assert stats.histogram(c).agg(F.sum("n")).first()[0] == 3 * NOISE.size
    lut = [r.v_out for r in stats.build_lut(stats.cumulative_hist(stats.binarize_hist(stats.luma_histogram(c), 0))).orderBy("v_in").collect()]
    assert lut == sorted(lut) and lut[-1] == 255
    two = color(spark, np.where(RAMP > 12, 200, 20))
    assert 20 <= stats.otsu_threshold(stats.luma_histogram(two)).first().threshold < 200
    gray = stats.gray_pixel_estimate(color(spark, np.full((5, 5), 120))).first()
    assert gray.n == 25
    m = stats.adaptation_matrix(stats.gray_pixel_estimate(color(spark, np.full((5, 5), 120)))).first()
    assert np.allclose([m[f"m{i}"] for i in range(9)], np.eye(3).ravel(), atol=2e-3)


def test_white_balance_removes_a_cast(spark):
    base = np.random.default_rng(2).integers(90, 140, (12, 12))
    c = plane(spark, base).select(*KEY, (F.col("v") * 1.1).cast("int").alias("r"), F.col("v").alias("g"), (F.col("v") * 0.9).cast("int").alias("b"), F.lit(255).alias("a"))
    m = nearest.white_balance(c, 6).first()
    rgb = np.array([local_linear(v) for v in (1.1 * 115 / 255, 115 / 255, 0.9 * 115 / 255)])
    out = np.array([m[f"m{i}"] for i in range(9)]).reshape(3, 3) @ rgb
    assert np.ptp(out) / out.mean() < 0.25 * np.ptp(rgb) / rgb.mean()


def local_linear(v):
    return ((v + 0.055) / 1.055) ** 2.4


def test_zones(spark):
    two = np.zeros((5, 5), int)
    two[:2, :2] = two[2:4, 2:4] = 1
    parts = zonal.connected_components(plane(spark, two).withColumnRenamed("v", "label"))
    assert parts.where("label = 1").select("part").distinct().count() == 2
    snake = np.zeros((9, 9), int)
    snake[::2] = 1
    snake[1::4, 8] = snake[3::4, 0] = 1
    parts = zonal.connected_components(plane(spark, snake).withColumnRenamed("v", "label"))
    assert parts.where("label = 1").select("part").distinct().count() == 1
    island = np.zeros((6, 6), int)
    island[3, 3] = 5
    merged = zonal.enforce_connectivity(plane(spark, island).withColumnRenamed("v", "label"), 2)
    assert merged.select("label").distinct().count() == 1
    labels = zonal.superpixels(color(spark, NOISE), 6, 2)
    assert labels.count() == NOISE.size
    seeds = spark.createDataFrame([(0, 1, 0, 0), (0, 2, 11, 16)], "image_id long, seed_id long, y long, x long")
    own = {(r.y, r.x): r.d2 for r in zonal.voronoi_assign(plane(spark, NOISE), seeds, 2).collect()}
    assert own == {(y, x): min(y * y + x * x, (11 - y) ** 2 + (16 - x) ** 2) for y in range(12) for x in range(17)}


def test_graph_filters(spark):
    values = spark.createDataFrame([(0, i, v) for i, v in enumerate([5, 1, 7, 7, 3])], "image_id long, node long, v int")
    edges = spark.createDataFrame([(0, 0, 1), (0, 1, 2), (0, 2, 3)], "image_id long, src long, dst long")
    get = lambda df: [r.v for r in df.orderBy("node").collect()]
    assert get(graph.graph_erode(values, edges)) == [1, 1, 1, 7, 3]
    assert get(graph.graph_dilate(values, edges, 9)) == [7, 7, 7, 7, 3]
    opened = graph.graph_open(values, edges)
    assert get(opened) == get(graph.graph_open(opened, edges))


def test_registered_tables(spark):
    tables.register_kernel("twice", [[0, 0, 0], [0, 2, 0], [0, 0, 0]])
    assert (grid(focal.convolve(color(spark, RAMP), "twice"), "r") == 2 * RAMP).all()
    tables.register_se("right", ["000", "001", "000"])
    assert (grid(focal.erode(plane(spark, RAMP), "right", 3))[:, :4] == RAMP[:, 1:]).all()
    tables.register_palette("two", [(0, 0, 0), (255, 255, 255)])
    out = zonal.nearest_palette(color(spark, NOISE), tables.palette(spark, "two"))
    assert (grid(out, "idx") == (NOISE > 127)).all()
    with pytest.raises(ValueError):
        tables.register_kernel("bad", [[1, 2]])


def test_files(spark, tmp_path):
    a = np.arange(24, dtype="<f4").reshape(2, 4, 3)
    (tmp_path / "a.raw").write_bytes(a.tobytes())
    (tmp_path / "b.raw").write_bytes(a.tobytes()[:-4])
    good, bad = src.batch_convert(src.read_raw_frames(spark, str(tmp_path / "*.raw"), "32f", 2, 4))
    assert [[r.r, r.g, r.b] for r in good.orderBy("y", "x").collect()] == a.reshape(-1, 3).tolist()
    assert [r.path.endswith("b.raw") for r in bad.collect()] == [True]
    pixels = np.arange(18, dtype=np.uint8).reshape(2, 3, 3)
    body = b"".join(row.tobytes() + bytes(3) for row in pixels[::-1])
    head = b"BM" + struct.pack("<IHHI", 54 + len(body), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 3, 2, 1, 24, 0, len(body), 0, 0, 0, 0)
    (tmp_path / "c.bmp").write_bytes(head + body)
    (tmp_path / "d.bmp").write_bytes(b"XX" + head[2:] + body)
    (tmp_path / "e.bmp").write_bytes((head + body)[:60])
    good, bad = src.batch_convert(src.read_bmp_frames(spark, str(tmp_path / "*.bmp")))
    assert [[r.b, r.g, r.r] for r in good.orderBy("y", "x").collect()] == pixels.reshape(-1, 3).tolist()
    assert bad.count() == 2
    src.write_frames(color(spark, NOISE), str(tmp_path / "out"), 4)
    assert spark.read.parquet(str(tmp_path / "out")).count() == NOISE.size
    packed = spark.createDataFrame([(5 << 22 | 600 << 12 | 1023 << 2,)], "p int")
    assert src.unpack_10u(packed).first()[1:] == (5, 600, 1023)
    text = spark.createDataFrame([("2700 K  255 169 87",), ("2750 K 1 2 3",), ("header",), ("6500  255 249 253",)], "value string")
    assert sorted(tuple(r) for r in src.build_cct_reference(text).collect()) == [(2700, 255, 169, 87), (6500, 255, 249, 253)]


@pytest.mark.parametrize("fn", [frames.stream_local, frames.stream_histogram, frames.stream_frame_stats, frames.stream_sessions])
def test_stream_equals_batch(spark, sf001, tmp_path, fn):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "events.parquet").symlink_to(f"{sf001}/events.parquet")
    arriving = fn(frames.frame_events(spark, str(tmp_path / "in"), stream=True))
    mode = "append" if fn is frames.stream_local else "complete"
    query = arriving.writeStream.format("memory").queryName(fn.__name__).outputMode(mode).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination()
    want = fn(frames.frame_events(spark, f"{sf001}/events.parquet"))
    key = lambda df: sorted(map(str, df.collect()))
    assert key(spark.table(fn.__name__)) == key(want)


def test_deflicker_state_equals_fold(spark, sf001, tmp_path):
    stats_ = frames.stream_frame_stats(frames.frame_events(spark, f"{sf001}/events.parquet")).select("stream_id", "start", "mean")
    stats_.write.parquet(str(tmp_path / "frames"))
    arriving = frames.deflicker(spark.readStream.schema(stats_.schema).parquet(str(tmp_path / "frames")))
    query = arriving.writeStream.format("memory").queryName("smooth").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination()
    key = lambda df: sorted((r.stream_id, r.start, round(r.smooth, 9)) for r in df.collect())
    assert key(spark.table("smooth")) == key(frames.deflicker_batch(stats_))


def test_color_round_trips(spark):
    c = color(spark, NOISE)
    assert np.allclose(grid(local.lab_to_rgb(local.rgb_to_lab(c)), "g"), NOISE, atol=0.05)
    assert np.allclose(grid(local.to_srgb(local.to_linear(c)), "b"), NOISE, atol=0.05)
    assert np.allclose(grid(local.adjust_cmyk(c, 0, 0, 0, 0), "r"), NOISE)


def test_denoising_reduces_noise(spark):
    rng = np.random.default_rng(6)
    clean = np.add.outer(np.arange(32) * 3, np.arange(32) * 2) + 20
    noisy = np.clip(np.round(clean + rng.normal(0, 8, clean.shape)), 0, 255)
    profile = denoise.noise_profile(plane(spark, noisy), share=0.2)
    std = np.mean([r["std"] for r in profile.where("k > 0").collect()])
    assert 3 < std < 16
    out = grid(denoise.nl_bayes_denoise(plane(spark, noisy), step=2, radius=4, k=40))
    assert np.abs(out - clean).mean() < 0.75 * np.abs(noisy - clean).mean()


def test_colour_images_are_denoised_too(spark):
    rng = np.random.default_rng(8)
    clean = np.stack([np.add.outer(np.arange(24) * a, np.arange(24) * b) + 30 for a, b in ((3, 2), (1, 4), (2, 1))])
    noisy = np.clip(np.round(clean + rng.normal(0, 8, clean.shape)), 0, 255).astype(int)
    rows = [(0, y, x, *map(int, noisy[:, y, x]), 255) for y in range(24) for x in range(24)]
    out = denoise.denoise_rgb(spark.createDataFrame(rows, "image_id long, y long, x long, r int, g int, b int, a int"), radius=5, scales=2, share=0.3)
    for i, c in enumerate("rgb"):
        assert np.abs(grid(out, c) - clean[i]).mean() < 0.8 * np.abs(noisy[i] - clean[i]).mean()
    tiny = plane(spark, np.arange(6).reshape(2, 3))
    assert (grid(denoise.nl_bayes_denoise(tiny, scales=1)) == np.arange(6).reshape(2, 3)).all()


def test_second_step_uses_its_pilot():
    rng = np.random.default_rng(2)
    shape = rng.normal(0, 20, (1, 1, 40, 3)) @ rng.normal(0, 1, (3, 16))
    noisy, noise = shape + rng.normal(0, 5, shape.shape), np.broadcast_to(25 * np.eye(16), (1, 1, 16, 16))
    there = np.arange(40)[None] < 36
    first = denoise.shrunk(noisy, None, there, noise)
    second = denoise.shrunk(noisy, first, there, noise)
    off = lambda v: np.abs(v - shape)[:, :, :36].mean()
    assert off(second) < 0.8 * off(noisy) and off(first) < 0.8 * off(noisy) and not np.allclose(first, second)
    alone = denoise.shrunk(noisy[:, :, :36], None, there[:, :36], noise)
    assert np.allclose(first[:, :, :36], alone)


def test_segments_on_a_circle():
    h = np.zeros(72)
    h[[70, 71, 0, 1]] = (30, 60, 60, 30)
    h[30:36] = (10, 40, 80, 80, 40, 10)
    parts = segment.circular_segments(h, 1.0)
    assert sum(b - a for a, b in parts) == 72 and any(a <= 70 and b >= 74 for a, b in parts)
    line = segment.segments_of(np.array([0, 5, 9, 5, 0, 0, 6, 9, 6, 0], dtype=float) * 20, 1.0)
    assert len(line) == 2


def test_palette_of_hues(spark):
    rng = np.random.default_rng(3)
    red, blue, grey = ((200, 30, 30), (30, 30, 200), (120, 120, 120))
    rows = [(0, i // 30, i % 30, *(int(np.clip(v + n, 0, 255)) for v, n in zip((red, blue, grey)[i % 3], rng.integers(-4, 5, 3) if i % 3 < 2 else [int(rng.integers(-4, 5))] * 3)), 255) for i in range(900)]
    cells = spark.createDataFrame(rows, "image_id long, y long, x long, r int, g int, b int, a int")
    palette = segment.hsi_palette(cells).collect()
    assert sum(p.n for p in palette) == 900 and {p.hue for p in palette} >= {-1} and len({p.hue for p in palette}) == 3
    shown = segment.posterize_hsi(cells).collect()
    assert len(shown) == 900 and all(abs(r.r - dict(((y, x), v) for _, y, x, v, *_ in rows)[r.y, r.x]) < 25 for r in shown[:60])


def test_loops_that_do_not_settle_raise(spark):
    start = spark.createDataFrame([(1,)], "n long")
    with pytest.raises(RuntimeError):
        iterate.until_stable(start, lambda d: d.select((F.col("n") + 1).alias("n")), lambda a, b: a.join(b, "n", "left_anti"), 3)


def test_deflicker_of_sparse_streams(spark):
    rng = np.random.default_rng(5)
    hours = sorted(rng.choice(24 * 400, 700, replace=False).tolist())
    rows = [(s, f"2024-01-01 00:00:00", int(h), float(rng.integers(1, 200))) for s in (0, 1) for h in (hours if s else hours[::50])]
    table = spark.createDataFrame(rows, "stream_id long, base string, h long, mean double").select("stream_id", (F.col("base").cast("timestamp") + F.make_interval(hours="h")).alias("start"), "h", "mean")
    got = {(r.stream_id, r.start): r.smooth for r in frames.deflicker_batch(table.select("stream_id", "start", "mean")).collect()}
    last = {}
    for r in table.orderBy("stream_id", "start").collect():
        last[r.stream_id] = r["mean"] if r.stream_id not in last else 0.25 * r["mean"] + 0.75 * last[r.stream_id]
        assert abs(got[r.stream_id, r.start] - last[r.stream_id]) < 1e-9


def test_iterated_adaptive_median(spark):
    p = plane(spark, NOISE)
    once = focal.adaptive_median(p, 3)
    assert (grid(focal.adaptive_median(p, 3, iters=2)) == grid(focal.adaptive_median(once, 3))).all()


def test_models_on_small_tables(spark):
    two = np.concatenate([np.random.default_rng(1).normal(60, 8, 400), np.random.default_rng(2).normal(190, 8, 400)]).clip(0, 255).astype(int).reshape(20, 40)
    parts = segment.hist_segment(stats.luma_histogram(color(spark, two))).orderBy("segment").collect()
    assert parts[0].lo == 0 and parts[-1].hi == 255 and any(80 < p.hi < 170 for p in parts[:-1]) and len(parts) <= 4
    assert grid(segment.posterize(color(spark, two)), "r").shape == two.shape
    waves = np.tile((128 + 100 * np.cos(2 * np.pi * 4 * np.arange(16) / 16)).round(), (16, 1))
    power = {r.ring: r.power for r in segment.spectrum_2d(plane(spark, waves)).collect()}
    assert max((p, k) for k, p in power.items() if k > 0)[1] == 4
    cast = plane(spark, np.random.default_rng(3).integers(60, 200, (12, 12))).select(*KEY, F.col("v").alias("r"), (F.col("v") * 0.9).cast("int").alias("g"), (F.col("v") * 0.7).cast("int").alias("b"), F.lit(255).alias("a"))
    e = segment.pca_illuminant(cast).first()
    assert e.ok and e.er > e.eg > e.eb


def test_colour_temperatures(spark):
    lut = nearest.cct_lut(spark, 2000, 10000, 50)
    at = {r.cct: r for r in lut.collect()}
    # published places on the locus
    assert abs(at[2850].u - 0.2560) < 0.002 and abs(at[2850].v - 0.3495) < 0.002
    assert abs(at[6500].u - 0.1979) < 0.003 and abs(at[6500].v - 0.3104) < 0.004
    points = spark.createDataFrame([(1, 3000, 0.004), (2, 5000, -0.006), (3, 8000, 0.0)], "image_id long, cct long, duv double")
    back = {r.image_id: r for r in nearest.nearest_cct(nearest.planckian_uv(points, lut).select("image_id", "u", "v"), lut).collect()}
    for i, cct, duv in ((1, 3000, 0.004), (2, 5000, -0.006), (3, 8000, 0.0)):
        assert abs(back[i].cct - cct) < 40 and abs(back[i].duv - duv) < 2e-4
    warm = nearest.shift_temperature(color(spark, NOISE), spark.createDataFrame([(0, 3000)], "image_id long, cct long"), lut)
    m = warm.agg(F.avg("r"), F.avg("b")).first()
    assert m[0] > 1.5 * m[1]


def test_hsluv_of_known_colours(spark):
    c = spark.createDataFrame([(0, 0, 0, 255, 0, 0, 255), (0, 0, 1, 255, 255, 255, 255), (0, 0, 2, 0, 0, 0, 255), (0, 0, 3, 0, 0, 255, 255)], "image_id long, y long, x long, r int, g int, b int, a int")
    got = {r.x: (round(r.h, 2), round(r.s, 2), round(r.l, 2)) for r in perceptual.to_hsluv(c).collect()}
    assert got[0] == (12.18, 100.0, 53.24) and got[1][1:] == (0.0, 100.0) and got[2][1:] == (0.0, 0.0) and got[3] == (265.87, 100.0, 32.3)


def test_block_match_full_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(queries.src, "from_lineitem", lambda *_: color(spark, NOISE))
    monkeypatch.setattr(queries.src, "with_luma", lambda c: c.select(*KEY, F.col("r").alias("v")))
    got = {}
    for r in queries.QUERIES["block_match_full"](spark, "").collect():
        got.setdefault((r.py, r.px), []).append((r["rank"], r.my, r.mx, r.d))
    places = [(y, x) for y in range(NOISE.shape[0] - 3) for x in range(NOISE.shape[1] - 3)]
    assert got.keys() == set(places)
    at = {(y, x): NOISE[y : y + 4, x : x + 4] for y, x in places}
    for py, px in places:
        d = sorted(((my, mx) != (py, px), float(((at[py, px] - at[my, mx]) ** 2).sum()), my, mx) for my, mx in places if abs(my - py) <= 8 and abs(mx - px) <= 8)
        limit = max(x[1] for x in d[:32])
        assert sorted(got[py, px]) == [(i + 1, my, mx, v) for i, (_, v, my, mx) in enumerate(d) if v <= limit]


def test_queries_ask_for_the_whole_job(spark, monkeypatch):
    asked = {}
    for module, name in ((queries.zonal, "superpixels"), (queries.nearest, "white_balance"), (queries.denoise, "denoise_rgb"), (queries.graph, "block_match"), (queries.focal, "adaptive_median")):
        real = inspect.signature(getattr(module, name))

        def note(*args, real=real, name=name, **named):
            bound = real.bind(*args, **named)
            bound.apply_defaults()
            asked[name] = bound.arguments
            return args[0]

        monkeypatch.setattr(module, name, note)
        monkeypatch.setattr(queries.src, "from_lineitem", lambda *_: color(spark, NOISE))
        queries.QUERIES["nl_bayes_denoise" if name == "denoise_rgb" else name](spark, "")
    assert asked["superpixels"]["rounds"] == 10 and asked["white_balance"]["rounds"] == 16 and asked["adaptive_median"]["rmax"] == 8
    assert asked["denoise_rgb"]["options"] == {"step": 2, "radius": 8, "k": 512}
    assert [asked["block_match"][k] for k in ("radius", "k", "rank", "step", "columns")] == [8, 512, 32, 1, ("r", "g", "b")]


def test_queries_look_up_the_full_locus(spark, monkeypatch):
    seen = []
    real = nearest.cct_lut
    monkeypatch.setattr(queries.src, "from_lineitem", lambda *_: color(spark, NOISE))
    monkeypatch.setattr(nearest, "cct_lut", lambda *a, **b: seen.append(real(*a, **b)) or seen[-1])
    for name in ("nearest_cct", "planckian_uv", "shift_temperature"):
        queries.QUERIES[name](spark, "")
    assert len(seen) == 3
    for lut in seen:
        assert lut.select("cct").agg(F.min("cct"), F.max("cct"), F.count("*")).first()[:] == (1000, 25000, 24001)
    fine, coarse = ({r.cct: r for r in real(spark, 1500, 1501, 1, nm).collect()} for nm in (0.5, 5))
    assert abs(fine[1500].u - coarse[1500].u) < 1e-3 and fine[1500].u != coarse[1500].u
    hot = nearest.nearest_cct(spark.createDataFrame([(1, fine[1500].u, fine[1500].v)], "image_id long, u double, v double"), seen[0]).first()
    assert abs(hot.cct - 1500) < 0.5 and abs(hot.duv) < 1e-6
