"""Frames as a data source: bitmaps and raw dumps of any size, read by ranges of rows, written row by row.

Format ``gridwright_frames``. Reading gives the cells of every file below a path. A file over ``split`` bytes is cut into as many ranges of rows;
small files share a task, and so do ranges under CHUNK bytes where MOST_TASKS would not do (up to SPLIT bytes a task): tasks grow with the bytes and
not with the files. A task seeks to its own rows and holds CHUNK bytes of pixels at a time. A
file that can't be read is one row with an error, and the others are read all the same. Writing needs the cells of an image in the order in which the file has them
and holds no more than a batch of them: ``write_frame_files`` sorts them so. Files appear when all tasks have ended.

Options: format (bmp, 8u, 16u, 32f or 10u), and for raw dumps height, width and channels (3, or 4 with blue first in 8u).
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition

from ..plans.focal import shape
from .files import Staged, opened

SPLIT, CHUNK, MOST_TASKS = 32 << 20, 1 << 20, 128
KINDS = {"8u": "u1", "16u": "<u2", "32f": "<f4", "10u": "<u4"}
SCHEMA = "path string, y long, x long, r double, g double, b double, error string"
_TYPES = pa.schema([("path", pa.string()), ("y", pa.int64()), ("x", pa.int64()), ("r", pa.float64()), ("g", pa.float64()), ("b", pa.float64()), ("error", pa.string())])


@dataclass
class Layout:
    """Where a file has its pixels: row i of the file is image row i, or height - 1 - i if the file begins at the bottom."""

    start: int
    stride: int
    height: int
    width: int
    kind: str
    channels: int
    order: tuple[int, int, int]
    upward: bool = False

    def values(self, raw: bytes) -> np.ndarray:
        """(cells, 3) of whole rows."""
        rows = np.frombuffer(raw, np.uint8).reshape(-1, self.stride)
        if self.kind == "10u":
            v = np.ascontiguousarray(rows).view("<u4").reshape(-1)
            return np.stack([v >> 22 & 1023, v >> 12 & 1023, v >> 2 & 1023], axis=1).astype(float)
        kind = np.dtype(KINDS[self.kind])
        own = np.ascontiguousarray(rows[:, : self.width * self.channels * kind.itemsize]).view(kind).reshape(-1, self.channels)
        return own[:, list(self.order)].astype(float)

    def bytes_of(self, v: np.ndarray) -> np.ndarray:
        """(cells, bytes of a cell) of (cells, 3) values, cut off at the format's limits."""
        if self.kind == "10u":
            r, g, b = (np.clip(np.round(v[:, i]), 0, 1023).astype("<u4") for i in range(3))
            return (r << 22 | g << 12 | b << 2).view(np.uint8).reshape(-1, 4)
        if self.kind != "32f":
            v = np.clip(np.round(v), 0, np.iinfo(KINDS[self.kind]).max)
        out = np.zeros((len(v), self.channels), dtype=KINDS[self.kind])
        out[:, list(self.order)] = v
        return out.view(np.uint8).reshape(len(v), -1)


def raw_layout(kind: str, height: int, width: int, channels: int = 3) -> Layout:
    size = 4 if kind == "10u" else channels * np.dtype(KINDS[kind]).itemsize
    return Layout(0, width * size, height, width, kind, channels, (2, 1, 0) if kind == "8u" and channels == 4 else (0, 1, 2))


def bitmap_layout(height: int, width: int) -> Layout:
    return Layout(54, (width * 3 + 3) // 4 * 4, height, width, "8u", 3, (2, 1, 0), upward=True)


def bitmap_head(layout: Layout) -> bytes:
    size = layout.stride * layout.height
    return b"BM" + struct.pack("<IHHI", min(54 + size, 0xFFFFFFFF), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, layout.width, layout.height, 1, 24, 0, min(size, 0xFFFFFFFF), 2835, 2835, 0, 0)


def read_layout(head: bytes, size: int, options: dict[str, str]) -> Layout:
    """The layout of a file from its first bytes; ValueError says why it has none."""
    if (kind := options.get("format", "bmp")) != "bmp":
        found = raw_layout(kind, int(options["height"]), int(options["width"]), int(options.get("channels", 3)))
        if size != found.stride * found.height:
            raise ValueError(f"{size} bytes")
        return found
    if head[:2] != b"BM":
        raise ValueError("not a bitmap")
    if len(head) < 30:
        raise ValueError("truncated or not 24 bits")
    (start,), (w, h, _, bits) = struct.unpack_from("<I", head, 10), struct.unpack_from("<iiHH", head, 18)
    found = Layout(start, (w * 3 + 3) // 4 * 4, abs(h), w, "8u", 3, (2, 1, 0), upward=h > 0)
    if bits != 24 or w <= 0 or h == 0 or size < start + found.stride * found.height:
        raise ValueError("truncated or not 24 bits")
    return found


@dataclass
class Rows(InputPartition):
    """Of n equal ranges of the rows of each file those from i up to j: (path, size, i, j, n)."""

    files: list[tuple[str, int, int, int, int]]

    def __init__(self, files: list[tuple[str, int, int, int, int]]) -> None:
        super().__init__(None)
        self.files = files


class FrameReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options = options

    def partitions(self) -> list[Rows]:
        system, top = opened(self.options["path"])
        found = system.get_file_info(top)
        infos = [found] if found.type == fs.FileType.File else system.get_file_info(fs.FileSelector(top, recursive=True))
        hidden = lambda p: any(x[:1] in "_." for x in p[len(top) :].split("/") if x)
        own = sorted((i for i in infos if i.type == fs.FileType.File and not hidden(i.path)), key=lambda i: i.path)
        split = int(self.options.get("split", SPLIT))
        # what a task gathers of small ranges, so that there are not too many tasks
        share, out, held = max(split, min(SPLIT, sum(i.size for i in own) / MOST_TASKS)), [Rows([])], 0.0
        for path, size, k, n in ((i.path, i.size, k, n) for i in own for n in [max(1, -(-i.size // split))] for k in range(n)):
            if n > 1 and size / n >= CHUNK:
                out.append(Rows([(path, size, k, k + 1, n)]))
                continue
            # the first of the list gathers them
            if held + size / n > share and out[0].files:
                out.append(out[0])
                out[0], held = Rows([]), 0.0
            files, held = out[0].files, held + size / n
            if files and files[-1][0] == path:
                files[-1] = (*files[-1][:3], k + 1, n)
            else:
                files.append((path, size, k, k + 1, n))
        return out

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        system, _ = opened(self.options["path"])
        for path, size, k, j, n in partition.files:
            try:
                with system.open_input_file(path) as file:
                    layout = read_layout(file.read(54), size, self.options)
                    lo, hi = layout.height * k // n, layout.height * j // n
                    for at in range(lo, hi, step := max(1, CHUNK // layout.stride)):
                        rows = min(step, hi - at)
                        file.seek(layout.start + at * layout.stride)
                        v = layout.values(file.read(rows * layout.stride))
                        y, x = np.divmod(np.arange(rows * layout.width), layout.width)
                        y = layout.height - 1 - (y + at) if layout.upward else y + at
                        yield pa.RecordBatch.from_arrays([pa.array([path] * len(y)), pa.array(y), pa.array(x), *(pa.array(v[:, i]) for i in range(3)), pa.nulls(len(y), pa.string())], schema=_TYPES)
            except (ValueError, OSError, struct.error) as e:
                if k == 0:
                    yield pa.RecordBatch.from_pylist([{"path": path, "error": str(e)}], schema=_TYPES)


class FrameWriter(Staged):
    """image_id, h, w, y, x, r, g, b, each image's cells in the order of its file; cells that are missing are 0."""

    def __init__(self, path: str, overwrite: bool, kind: str) -> None:
        super().__init__(path, overwrite)
        self.kind = kind

    def files(self, rows: Iterator[pa.RecordBatch], create) -> Iterator[str]:
        now, out, name, layout, at = None, None, "", None, 0
        for batch in rows:
            image, h, w, y, x = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("image_id", "h", "w", "y", "x"))
            v = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in "rgb"], axis=1)
            edges = np.flatnonzero(np.append(True, image[1:] != image[:-1])).tolist() if len(image) else []
            for a, b in zip(edges, [*edges[1:], len(image)], strict=True):
                if out is None or image[a] != now:
                    if out is not None:
                        yield self._closed(out, name, layout, at)
                    now, at = image[a], 0
                    layout = bitmap_layout(int(h[a]), int(w[a])) if self.kind == "bmp" else raw_layout(self.kind, int(h[a]), int(w[a]))
                    name = f"{now}.{self.kind}"
                    out = create(name)
                    out.write(bitmap_head(layout) if self.kind == "bmp" else b"")
                cell = layout.bytes_of(v[a:b])
                row = layout.height - 1 - y[a:b] if layout.upward else y[a:b]
                place = row * layout.stride + x[a:b] * cell.shape[1]
                part = np.zeros(int(place[-1]) + cell.shape[1] - at, np.uint8)
                part[(place - at)[:, None] + np.arange(cell.shape[1])] = cell
                out.write(part.tobytes())
                at += len(part)
        if out is not None:
            yield self._closed(out, name, layout, at)

    @staticmethod
    def _closed(out, name: str, layout: Layout, at: int) -> str:
        out.write(bytes(layout.stride * layout.height - at))
        out.close()
        return name


class Frames(DataSource):
    @classmethod
    def name(cls) -> str:
        return "gridwright_frames"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return FrameReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return FrameWriter(self.options["path"], overwrite, self.options.get("format", "bmp"))


def read_frame_files(spark: SparkSession, path: str, fmt: str = "bmp", **options: int) -> DataFrame:
    """path, y, x, r, g, b, error of every file below path; options: height, width, channels, split."""
    spark.dataSource.register(Frames)
    return spark.read.format("gridwright_frames").options(format=fmt, **options).load(path)


def write_frame_files(cells: DataFrame, path: str, fmt: str = "bmp", mode: str = "append") -> None:
    """A file image_id.format for each image of cells (image_id, y, x, r, g, b). One task writes an image, from sorted cells that Spark spills where they don't fit."""
    cells.sparkSession.dataSource.register(Frames)
    rows = cells.select("image_id", "y", "x", "r", "g", "b").join(shape(cells), "image_id").selectExpr("image_id", "h", "w", "y", "x", *(f"double({c}) as {c}" for c in "rgb"))
    ordered = rows.repartition("image_id").sortWithinPartitions("image_id", F.desc("y") if fmt == "bmp" else F.asc("y"), "x")
    ordered.write.format("gridwright_frames").option("format", fmt).mode(mode).save(path)
