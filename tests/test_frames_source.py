"""Frame files as a data source: round trips of every format, ranges of rows, errors, files over 2 GB."""

import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridwright.sources import frames as fr


def cells(spark, images):
    rows = [(i, y, x, *map(float, g[y, x])) for i, g in images.items() for y in range(g.shape[0]) for x in range(g.shape[1])]
    return spark.createDataFrame(rows, "image_id long, y long, x long, r double, g double, b double").repartition(4)


def read(spark, path, fmt, **options):
    out = {}
    for r in fr.read_frame_files(spark, path, fmt, **options).collect():
        assert r.error is None
        out.setdefault(int(os.path.basename(r.path).split(".")[0]), {})[r.y, r.x] = (r.r, r.g, r.b)
    return out


@pytest.mark.parametrize("fmt", ["bmp", "8u", "16u", "32f", "10u"])
@pytest.mark.parametrize("split", [100, 1 << 20])
def test_round_trips(spark, tmp_path, fmt, split):
    rng = np.random.default_rng(5)
    shape = (7, 5)
    images = {i: rng.integers(0, 256, (*shape, 3)) for i in range(-1, 6)}
    at = f"file://{tmp_path}/f"
    fr.write_frame_files(cells(spark, images), at, fmt)
    got = read(spark, at, fmt, height=7, width=5, split=split)
    assert got == {i: {(y, x): tuple(map(float, g[y, x])) for y in range(7) for x in range(5)} for i, g in images.items()}
    assert sorted(os.listdir(tmp_path / "f")) == sorted(["_SUCCESS", *(f"{i}.{fmt}" for i in images)])


def test_limits_and_missing_cells(spark, tmp_path):
    rows = [(3, 0, 0, -5.0, 300.0, 12.6), (3, 2, 3, 1.0, 2.0, 3.0)]
    df = spark.createDataFrame(rows, "image_id long, y long, x long, r double, g double, b double")
    fr.write_frame_files(df, f"file://{tmp_path}/f")
    got = read(spark, f"file://{tmp_path}/f", "bmp")[3]
    assert len(got) == 12 and got[0, 0] == (0, 255, 13) and got[2, 3] == (1, 2, 3) and sum(map(sum, got.values())) == 274
    fr.write_frame_files(df, f"file://{tmp_path}/f", mode="overwrite")
    assert sorted(os.listdir(tmp_path / "f")) == ["3.bmp", "_SUCCESS"]
    fr.write_frame_files(df.limit(0), f"file://{tmp_path}/none")
    assert fr.read_frame_files(spark, f"file://{tmp_path}/none").count() == 0


def test_one_bad_file_stops_nothing(spark, tmp_path):
    fr.write_frame_files(cells(spark, {1: np.full((4, 6, 3), 9)}), f"file://{tmp_path}/f")
    good = (tmp_path / "f/1.bmp").read_bytes()
    top_down = good[:22] + struct.pack("<i", -4) + good[26:54] + good[54:][::-1]
    for name, body in (("2.bmp", good[:70]), ("3.bmp", b""), ("4.bmp", b"BM"), ("5.bmp", b"GIF89a" + good), ("6.bmp", good[:28] + b"\x08\x00" + good[30:]), ("7.bmp", top_down)):
        (tmp_path / "f" / name).write_bytes(body)
    rows = fr.read_frame_files(spark, f"file://{tmp_path}/f", split=20).collect()
    errors = {os.path.basename(r.path): r.error for r in rows if r.error}
    assert errors == {"2.bmp": "truncated or not 24 bits", "3.bmp": "not a bitmap", "4.bmp": "truncated or not 24 bits", "5.bmp": "not a bitmap", "6.bmp": "truncated or not 24 bits"}
    assert len(rows) == 5 + 2 * 24


def test_a_frame_over_two_gigabytes(tmp_path):
    """A sparse file of 3.2 GB: every task gets its own rows, and the last rows come from behind the second gigabyte."""
    h, w = 20_000, 40_000
    with open(tmp_path / "big.raw", "wb") as f:
        f.truncate(h * w * 4)
        f.seek((h - 1) * w * 4 + 4 * (w - 1))
        f.write(struct.pack("<I", 7 << 22 | 8 << 12 | 9 << 2))
    reader = fr.FrameReader({"path": str(tmp_path), "format": "10u", "height": str(h), "width": str(w), "split": str(1 << 22)})
    parts = reader.partitions()
    assert len([p for p in parts if p.files]) == -(-h * w * 4 // (1 << 22))
    seen, last = 0, None
    for batch in reader.read(parts[-1]):
        assert batch.nbytes < 100 * fr.CHUNK
        seen, last = seen + len(batch), batch.slice(len(batch) - 1).to_pylist()[0]
    assert (last["y"], last["x"], last["r"], last["g"], last["b"]) == (h - 1, w - 1, 7, 8, 9)
    n = len(parts) - 1
    assert seen == (h - h * (n - 1) // n) * w
    os.truncate(tmp_path / "big.raw", h * w * 4 - 1)
    with_error = [b.to_pylist() for p in reader.partitions()[:3] for b in reader.read(p)]
    assert [r["error"] for b in with_error for r in b] == [f"{h * w * 4 - 1} bytes"]


def test_a_task_that_fails_leaves_nothing(spark, tmp_path):
    df = cells(spark, {i: np.ones((3, 3, 3)) for i in range(4)})
    bad = df.withColumn("r", F.when(F.col("image_id") == 2, F.raise_error(F.lit("no"))).otherwise(F.col("r")).cast("double"))
    with pytest.raises(Exception, match="no"):
        fr.write_frame_files(bad, f"file://{tmp_path}/f")
    assert not (tmp_path / "f").exists() or not os.listdir(tmp_path / "f")
