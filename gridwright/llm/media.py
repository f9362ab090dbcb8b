"""Media columns: ISO media containers as binary columns, indexed without decoding the payload.

``mux`` stores each payload losslessly as 8 x 8 frames of 8-bit grey samples in an ISO container (ftyp,
mdat, moov). ``index_media`` walks the nested boxes of any such container and decodes the sample
tables (stsd, mdhd, stts, stsc, stsz, stco/co64, stss) to codec, duration and the byte ranges of the
key frames. A container that can't be walked gives an ``error`` and null features; the job goes on.

Cases: null text counts as empty; the empty payload is one zero frame; repeated rows give equal
rows; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import as_struct, quoted, stored

FRAME = 64
FRAMES_PER_CHUNK = 64
KEY_EVERY = 32
TIMESCALE = 25
CONTAINERS = frozenset({b"moov", b"trak", b"edts", b"mdia", b"minf", b"dinf", b"stbl", b"udta", b"mvex", b"moof", b"traf"})


def padded(text: bytes) -> bytes:
    """The text with zero bytes up to a positive multiple of 64."""
    return text + bytes(-len(text) % FRAME if text else FRAME)


def _box(kind: bytes, *parts: bytes) -> bytes:
    size = 8 + sum(map(len, parts))
    if size >= 1 << 32:
        return struct.pack(">I4sQ", 1, kind, size + 8) + b"".join(parts)
    return struct.pack(">I4s", size, kind) + b"".join(parts)


def _full(kind: bytes, *parts: bytes) -> bytes:
    return _box(kind, bytes(4), *parts)


def _matrix() -> bytes:
    return struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def mux(payload: bytes) -> bytes:
    """An ISO container with the payload as raw grey frames; a pure function of the payload."""
    frames = len(payload) // FRAME
    ftyp = _box(b"ftyp", b"qt  ", struct.pack(">I", 0), b"qt  ")
    mdat = _box(b"mdat", payload)
    first = len(ftyp) + len(mdat) - len(payload)
    chunks = -(-frames // FRAMES_PER_CHUNK)
    places = first + np.arange(chunks, dtype=np.int64) * (FRAME * FRAMES_PER_CHUNK)
    wide = first + len(payload) >= 1 << 32
    full, rest = divmod(frames, FRAMES_PER_CHUNK)
    runs = ([(1, FRAMES_PER_CHUNK)] if full else []) + ([(full + 1, rest)] if rest else [])
    keys = np.arange(1, frames + 1, KEY_EVERY, dtype=np.uint32)
    entry = _box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HHIIIH", 8, 8, 0x480000, 0x480000, 0, 1), bytes(32), struct.pack(">Hh", 40, -1))
    table = _box(
        b"stbl",
        _full(b"stsd", struct.pack(">I", 1), entry),
        _full(b"stts", struct.pack(">III", 1, frames, 1)),
        _full(b"stss", struct.pack(">I", len(keys)), keys.astype(">u4").tobytes()),
        _full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", at, n, 1) for at, n in runs)),
        _full(b"stsz", struct.pack(">II", FRAME, frames)),
        _full(b"co64" if wide else b"stco", struct.pack(">I", chunks), places.astype(">u8" if wide else ">u4").tobytes()),
    )
    info = _box(b"minf", _full(b"vmhd", bytes(8)), _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _box(b"url ", struct.pack(">I", 1)))), table)
    media = _box(b"mdia", _full(b"mdhd", struct.pack(">IIIIHH", 0, 0, TIMESCALE, frames & 0xFFFFFFFF, 0x55C4, 0)), _full(b"hdlr", bytes(4), b"vide", bytes(13)), info)
    head = _full(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, frames & 0xFFFFFFFF), bytes(16), _matrix(), struct.pack(">II", 8 << 16, 8 << 16))
    movie = _full(b"mvhd", struct.pack(">IIII", 0, 0, TIMESCALE, frames & 0xFFFFFFFF), struct.pack(">IH", 0x10000, 0x100), bytes(10), _matrix(), bytes(24), struct.pack(">I", 2))
    return ftyp + mdat + _box(b"moov", movie, _box(b"trak", head, media))


def walk(data: memoryview, start: int, stop: int, path: tuple[bytes, ...] = ()) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """(path, start, stop) of the body of each box, depth first; raises ValueError on sizes that don't fit."""
    while start < stop:
        if stop - start < 8:
            raise ValueError("truncated box header")
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            if stop - start < 16:
                raise ValueError("truncated box header")
            (size,), body = struct.unpack_from(">Q", data, body), body + 8
        end = stop if size == 0 else start + size
        if end > stop or end < body:
            raise ValueError(f"box {kind!r} of {size} bytes does not fit")
        yield (*path, kind), body, end
        if kind in CONTAINERS:
            yield from walk(data, body, end, (*path, kind))
        start = end


def _ints(data: memoryview, at: int, count: int, stop: int, kind: str = ">u4") -> np.ndarray:
    width = int(kind[-1])
    if at + count * width > stop:
        raise ValueError("sample table is longer than its box")
    return np.frombuffer(data, dtype=kind, count=count, offset=at).astype(np.int64)


def index(media: bytes) -> dict:
    """Codec, timing and sample ranges of the first track with samples; payload bytes are never read."""
    data, found = memoryview(media), {}
    for path, start, stop in walk(data, 0, len(data)):
        if path[-1] == b"trak" and "offsets" in found:
            break
        kind, at = path[-1], start + 4
        if kind == b"mdhd":
            long = data[start] == 1
            found["timescale"], found["duration"] = struct.unpack_from(">IQ" if long else ">II", data, at + (16 if long else 8))
        elif kind == b"stsd":
            if struct.unpack_from(">I", data, at)[0]:
                found["codec"] = bytes(data[at + 8 : at + 12]).decode("latin-1")
        elif kind == b"stts":
            found["times"] = _ints(data, at + 4, 2 * struct.unpack_from(">I", data, at)[0], stop).reshape(-1, 2)
        elif kind == b"stss":
            found["sync"] = _ints(data, at + 4, struct.unpack_from(">I", data, at)[0], stop)
        elif kind == b"stsc":
            found["runs"] = _ints(data, at + 4, 3 * struct.unpack_from(">I", data, at)[0], stop).reshape(-1, 3)
        elif kind == b"stsz":
            same, count = struct.unpack_from(">II", data, at)
            found["sizes"] = np.full(count, same, dtype=np.int64) if same else _ints(data, at + 8, count, stop)
        elif kind in (b"stco", b"co64"):
            found["offsets"] = _ints(data, at + 4, struct.unpack_from(">I", data, at)[0], stop, ">u4" if kind == b"stco" else ">u8")
    missing = {"codec", "timescale", "times", "runs", "sizes", "offsets"} - found.keys()
    if missing:
        raise ValueError("no " + ", ".join(sorted(missing)))
    sizes, chunks, runs = found["sizes"], found["offsets"], found["runs"]
    last = np.append(runs[1:, 0], len(chunks) + 1)
    per_chunk = np.repeat(runs[:, 1], np.maximum(last - runs[:, 0], 0))
    if len(per_chunk) != len(chunks) or per_chunk.sum() != len(sizes):
        raise ValueError("chunk map and sample sizes disagree")
    chunk = np.repeat(np.arange(len(chunks)), per_chunk)
    before = np.cumsum(sizes) - sizes
    heads = np.cumsum(per_chunk) - per_chunk
    places = chunks[chunk] + before - before[heads[chunk]] if len(sizes) else before
    if len(sizes) and (places + sizes).max() > len(data):
        raise ValueError("samples lie outside the file")
    sync = found.get("sync", np.arange(1, len(sizes) + 1)) - 1
    if len(sync) and (sync.min() < 0 or sync.max() >= len(sizes)):
        raise ValueError("sync sample out of range")
    return {
        "codec": found["codec"], "timescale": found["timescale"], "duration": int((found["times"][:, 0] * found["times"][:, 1]).sum()),
        "places": places, "sizes": sizes, "key_offsets": places[sync], "key_lengths": sizes[sync],
    }


def read_payload(media: bytes, found: dict) -> bytes:
    """The samples in order, as the sample tables place them."""
    places, sizes = found["places"], found["sizes"]
    if not len(places):
        return b""
    breaks = np.flatnonzero(places[1:] != (places + sizes)[:-1]) + 1
    starts, stops = places[np.concatenate(([0], breaks))], (places + sizes)[np.concatenate((breaks - 1, [len(places) - 1]))]
    return b"".join(media[a:b] for a, b in zip(starts, stops, strict=True))


def mux_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each whole text, zero-padded, in a container of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t.as_py() or "").encode() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, texts), pa.int64()), pa.array([mux(padded(t)) for t in texts], pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


INDEX = "codec string, timescale long, duration long, n_samples long, n_keyframes long, keyframes array<struct<offset:long,length:long>>, feature string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, error string"


def _described(media: bytes | None) -> dict:
    row = dict.fromkeys(field.name for field in ARROW)
    if media is None:
        return row | {"error": "null"}
    row |= {"media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest()}
    try:
        found = index(media)
    except (ValueError, struct.error) as e:
        return row | {"error": str(e)}
    payload = read_payload(media, found)
    offsets, lengths = found["key_offsets"], found["key_lengths"]
    ranges = zlib.crc32(np.stack([offsets, lengths], 1).astype("<i8").tobytes())
    return row | {
        "codec": found["codec"], "timescale": found["timescale"], "duration": found["duration"], "n_samples": len(found["sizes"]), "n_keyframes": len(offsets),
        "keyframes": [{"offset": int(a), "length": int(b)} for a, b in zip(offsets, lengths, strict=True)],
        "feature": f"codec={found['codec'].strip()};timescale={found['timescale']};duration={found['duration']};samples={len(found['sizes'])};keyframes={len(offsets)};key_bytes={int(lengths.sum())};key_ranges_crc32={ranges}",
        "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-FRAME:]),
    }


def index_media(df: DataFrame, media: str = "media") -> DataFrame:
    """df's columns but the container, and what its boxes say, as the struct ``media_index``."""
    kept = [c for c in df.columns if c != media]
    schema = T.StructType([T.StructField("kept", df.select(*map(quoted, kept)).schema), T.StructField("media_index", T.StructType.fromDDL(INDEX))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = pa.array([_described(m.as_py()) for m in batch.column(1)], ARROW)
            yield pa.RecordBatch.from_arrays([batch.column(0), rows], ["kept", "media_index"])

    out = df.select(as_struct(df, kept).alias("kept"), F.col(quoted(media))).mapInArrow(run, schema)
    return out.select("kept.*", "media_index")


_L, _S = pa.int64(), pa.string()
ARROW = pa.struct([
    ("codec", _S), ("timescale", _L), ("duration", _L), ("n_samples", _L), ("n_keyframes", _L), ("keyframes", pa.list_(pa.struct([("offset", _L), ("length", _L)]))),
    ("feature", _S), ("payload_bytes", _L), ("payload_sha256", _S), ("tail_crc32", _L), ("media_bytes", _L), ("media_sha256", _S), ("error", _S),
])


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's payload in a container, stored as a table of media columns, read back and indexed."""
    media = stored(mux_texts(spark.read.parquet(f"{sf_dir}/documents.parquet")), "media")
    found = index_media(media)
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "codec", "timescale", "duration", "n_keyframes", "keyframes"]
    return found.select("doc_id", "n_bytes", *(F.col(f"media_index.{x}").alias(x) for x in names))
