"""Vectorised helpers on Arrow text columns: byte buffers, word bounds and word hashes, all in NumPy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C15)
_SLICE = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words (splitmix finaliser)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


#: One random-looking word per byte value.
BYTE_CODE = mix(np.arange(1, 257, dtype=U64) * _BASE)
_INVERSE = U64(pow(int(_BASE), -1, 1 << 64))
_TABLES = {int(b): np.ones(1, dtype=U64) for b in (_BASE, _INVERSE)}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64; the table grows to the longest slice that the worker meets."""
    if len(_TABLES[int(base)]) < n:
        table = np.full(max(n, 2 * len(_TABLES[int(base)]), _SLICE), base, dtype=U64)
        table[0] = 1
        _TABLES[int(base)] = np.cumprod(table, dtype=U64)
    return _TABLES[int(base)][:n]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    column = pc.fill_null(column, "") if column.null_count else column
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = _SLICE) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts have about `limit` bytes together; a longer text is alone."""
    n, start = len(offsets) - 1, 0
    while start < n:
        stop = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        stop = min(n, max(stop, start + 1))
        yield start, stop
        start = stop


def prefix_hash(raw: np.ndarray) -> np.ndarray:
    """H[i]: hash of the first i bytes; range_hash() takes differences."""
    out = np.zeros(len(raw) + 1, dtype=U64)
    np.cumsum(BYTE_CODE[raw] * powers(_BASE, len(raw)), out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hash of bytes [start, stop): the same wherever the bytes are the same."""
    return mix((prefix[stop] - prefix[start]) * powers(_INVERSE, len(prefix))[start])


def gram_hash(raw: np.ndarray, size: int) -> np.ndarray:
    """range_hash() of [i, i + size) for every i at which so many bytes begin, with few arrays of that length at a time."""
    prefix = prefix_hash(raw)
    x = prefix[size:] - prefix[:-size]
    x *= powers(_INVERSE, len(prefix))[: len(x)]
    # mix() in place
    high = x >> U64(30)
    x ^= high
    x *= U64(0xBF58476D1CE4E5B9)
    np.right_shift(x, U64(27), out=high)
    x ^= high
    x *= U64(0x94D049BB133111EB)
    np.right_shift(x, U64(31), out=high)
    x ^= high
    return x


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, stop, row) of each word: a run of bytes above the space character inside one text."""
    body = raw > 32
    edge = np.zeros(len(raw) + 1, dtype=bool)
    edge[0] = True
    edge[1:-1] = ~body[:-1]
    edge[offsets] = True
    starts = np.flatnonzero(body & edge[:-1])
    last = np.zeros(len(raw), dtype=bool)
    if len(raw):
        last[:-1] = ~body[1:]
        last[-1] = True
        ends = offsets[1:][offsets[1:] > 0] - 1
        last[ends] = True
    stops = np.flatnonzero(body & last) + 1
    return starts, stops, np.searchsorted(offsets, starts, side="right") - 1
