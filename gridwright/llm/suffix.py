"""Exact substring dedup with suffix arrays built by a difference cover, on Spark.

A byte goes if a LENGTH-byte string that covers it also starts anywhere else. All suffixes of a large
corpus in one order would be several times the corpus on disk, so the order is built for the suffixes that
can matter, and where equal ones meet:

1. Anchors. Every LENGTH-byte window names its least-hashed GRAM-byte substring (the leftmost of equals).
   Equal windows name equal substrings at equal distances, so windows of different anchors differ and
   an anchor seen once has no repeated window. One row for each anchor is counted by hash.
2. Contexts. The windows of an anchor are one stretch of text, its context. Contexts of repeated anchors
   are cut from the texts; equal contexts are stored once for each task and meet by hash.
3. Difference cover. Contexts are dealt by anchor hash; each task strings whole anchor groups together
   and orders the suffixes: triples at the positions 1 and 2 modulo 3 are sorted and named, the names
   are recursed on (until LENGTH bytes are told apart), the remaining suffixes are sorted by first byte
   and rank of the rest, and merged. Then adjacent LENGTH-byte prefixes are compared.
4. Cuts. A context seen twice repeats as a whole. Spans go back to every occurrence and are joined to texts.

   Before that, contexts go that share with no other of their anchor the SIDE bytes on the left of it or those on
   the right: a repeated window has one of them.

An anchor whose distinct contexts exceed HEAVY bytes (a passage in very many documents) does not meet in one
task: module cover orders the suffixes of such contexts by the same steps as Spark jobs, once they are cut down
to what they share with others.

Cases: null counts as empty; texts under LENGTH bytes stay whole; repeated rows are documents of their
own, so they remove each other; a null doc_id stays null; an empty table gives an empty table; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cover
from .skew import spread
from .storage import stored
from .text import U64, gram_hash, mix, prefix_hash, range_hash, slices, utf8

LENGTH = 200
GRAM = 64
SPAN = LENGTH - GRAM + 1
#: Bytes of contexts whose suffixes are ordered together, and of one anchor's contexts at most.
CHUNK, HEAVY = 1 << 19, 1 << 21
#: Of the bytes of a window beside its anchor, at least half lie on one side.
SIDE = (LENGTH - GRAM) // 2
_NONE = (1 << 63) - 1
KEY = ("id", "body")


def keyed(docs: DataFrame) -> DataFrame:
    """id, body, text: rows that agree in doc_id and text share a name and have equal results. Of n texts of one doc_id (or of none) n^2/2^65 pairs are expected to share one."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NONE)).alias("id"), F.xxhash64(text).alias("body"), text.alias("text"))


def _windows_least(h: np.ndarray) -> np.ndarray:
    """For each window of SPAN grams the place of the least one, leftmost of equals."""
    key = h >> U64(24)
    key <<= U64(24)
    key |= np.arange(len(h), dtype=U64)
    # the least of twice as many from two halves, at last from two that overlap
    wide = 1
    while wide < SPAN:
        step = min(wide, SPAN - wide)
        key = np.minimum(key[:-step], key[step:])
        wide += step
    key &= U64((1 << 24) - 1)
    return key.view(np.int64)


def anchor_rows(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, first window, last window, anchor) of each anchor; places count within their text."""
    if len(raw) < LENGTH:
        return (np.zeros(0, np.int64), np.zeros(0, U64), *[np.zeros(0, np.int64)] * 3)
    if len(raw) >= 1 << 24:
        raise ValueError("slice too long")
    h = gram_hash(raw, GRAM)
    least = _windows_least(h)
    new = np.ones(len(least), dtype=bool)
    np.not_equal(least[1:], least[:-1], out=new[1:])
    new[offsets[offsets < len(least)]] = True
    first = np.flatnonzero(new)
    row = np.searchsorted(offsets, first, side="right") - 1
    # windows that reach into the next text are none
    last = np.minimum(np.append(first[1:], len(least)) - 1, offsets[row + 1] - LENGTH)
    own = last >= first
    row, first, last = row[own], first[own], last[own]
    base, anchor = offsets[row], least[first]
    return row, h[anchor], first - base, last - base, anchor - base


def _long_slices(raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes skipped, bytes, offsets): very long texts come in overlapping parts."""
    part = 1 << 22
    # so many bytes that the arrays made of them stay in a core's cache
    for lo, hi in slices(offsets, 1 << 18):
        start, size = offsets[lo], offsets[hi] - offsets[lo]
        if size <= 2 * part:
            yield lo, hi, 0, raw[start : offsets[hi]], offsets[lo : hi + 1] - start
            continue
        for skip in range(0, size, part):
            stop = min(size, skip + part + LENGTH - 1)
            yield lo, hi, skip, raw[start + skip : start + stop], np.array([0, stop - skip])


#: first window, bytes from there to the anchor, number of windows in one long: 10 bits each for the last two
_PLACE = 1 << 20


def anchors(docs: DataFrame) -> DataFrame:
    """hash, id, body, place of every anchor of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, bodies = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            raw, offsets = utf8(batch.column(2))
            for lo, _, skip, part, own in _long_slices(raw, offsets):
                row, h, first, last, anchor = anchor_rows(part, own)
                place = (first + skip) * _PLACE + (anchor - first) * 1024 + last - first + 1
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(ids[lo + row]), pa.array(bodies[lo + row]), pa.array(place)], ["hash", "id", "body", "place"])

    return keyed(docs).mapInArrow(run, "hash long, id long, body long, place long")


def packed(docs: DataFrame) -> DataFrame:
    """id, body, z: compressed texts, so that a shuffle of them is small."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=5, write_content_size=True)
        for b in batches:
            texts = b.column(2).cast(pa.large_binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([squeeze.compress(t.as_py()) for t in texts], pa.binary())], ["id", "body", "z"])

    return keyed(docs).mapInArrow(run, "id long, body long, z binary")


CONTEXT = "hash long, c long, id long, body long, first long, anchor int, size int, context binary"


def contexts(docs: DataFrame) -> DataFrame:
    """CONTEXT rows of all repeated anchors; the bytes are there at least once for each name (hash, c): 128 bits together."""
    rows = anchors(docs)
    again = stored(rows.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1"), "anchors")
    places = spread(rows, again, ["hash"], [*KEY, "place"]).groupBy(*KEY).agg(F.collect_set(F.struct("hash", "place")).alias("places"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        expand = zstandard.ZstdDecompressor()
        for b in batches:
            for at in range(len(b)):
                text, found = expand.decompress(b.column(2)[at].as_py()), b.column(3)[at].values
                h, place = found.field(0).to_numpy(), found.field(1).to_numpy()
                first, lead, count = place // _PLACE, place % _PLACE // 1024, place % 1024
                cut = [text[a : a + n + LENGTH - 1] for a, n in zip(first.tolist(), count.tolist(), strict=True)]
                names = [xxhash.xxh3_64_intdigest(c) for c in cut]
                if len(seen) > 200_000:
                    seen.clear()
                bodies = []
                for n, c in zip(zip(h.tolist(), names, strict=True), cut, strict=True):
                    bodies.append(None if n in seen else c)
                    seen.add(n)
                same = lambda i, k: np.full(len(h), b.column(i)[at].as_py(), dtype=k)  # noqa: E731,B023
                columns = [h, np.array(names, dtype=U64).view(np.int64), same(0, np.int64), same(1, np.int64), first, lead.astype(np.int32), (count + LENGTH - 1).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(bodies, pa.binary())], [x.split()[0] for x in CONTEXT.split(", ")])

    return packed(docs).join(places, [*KEY]).select(*KEY, "z", "places").mapInArrow(_gathered(run), CONTEXT)


def _gathered(run):
    """Small record batches of `run` put together."""

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in run(batches):
            held.append(b)
            size += b.nbytes
            if size > 1 << 23:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
        yield from pa.Table.from_batches(held).combine_chunks().to_batches() if held else []

    return out


def _order(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(order, names from 1): names are equal exactly where all columns are, and sorted as they are."""
    bits = [int(c.max()).bit_length() if len(c) else 1 for c in columns]
    if sum(bits) <= 63:
        key = columns[0].astype(np.int64)
        for c, b in zip(columns[1:], bits[1:], strict=True):
            key = (key << b) | c
        order = np.argsort(key)
        new = np.ones(len(key), dtype=bool)
        new[1:] = key[order][1:] != key[order][:-1]
    else:
        order = np.lexsort(columns[::-1])
        new = np.zeros(len(order), dtype=bool)
        new[:1] = True
        for c in columns:
            new[1:] |= c[order][1:] != c[order][:-1]
    names = np.empty(len(order), dtype=np.int64)
    names[order] = np.cumsum(new)
    return order, names


def ranks(s: np.ndarray, need: int) -> np.ndarray:
    """Rank from 1 of every suffix of s (symbols from 1) by its first `need` symbols; those that agree in them lie side by side in any order."""
    n = len(s)
    wide = np.concatenate([s, np.zeros(8, dtype=np.int64)])
    if need <= 3 or n < 4:
        i = np.arange(n)
        return _order([wide[i + j] for j in range(3)])[1]
    # sort sampled triples, recurse on their names
    one, two = np.arange(1, n + 2, 3), np.arange(2, n + 2, 3)
    sample = np.concatenate([one, two])
    _, names = _order([wide[sample], wide[sample + 1], wide[sample + 2]])
    if names.max() < len(names):
        joined = np.concatenate([names[: len(one)], [0], names[len(one) :]]) + 1
        deep = ranks(joined, -(-need // 3))
        names = np.concatenate([deep[: len(one)], deep[len(one) + 1 :]])
    rank = np.zeros(n + 5, dtype=np.int64)
    rank[sample] = names
    # the remaining suffixes by first symbol and rank of the rest
    rest = np.arange(0, n, 3)
    rest = rest[np.argsort((wide[rest] << int(rank.max()).bit_length()) | rank[rest + 1])]
    sample = sample[sample < n]
    sample = sample[np.argsort(rank[sample])]
    # merge: for each remaining suffix, how many of the sample are less
    # against those at 1 modulo 3 by a symbol and a rank, against those at 2 by two symbols and a rank
    width, symbols = int(rank.max()).bit_length(), int(wide.max()).bit_length()
    one = lambda i: (wide[i] << width) | rank[i + 1]
    two = lambda i: (((wide[i] << symbols) | wide[i + 1]) << width) | rank[i + 2]
    by_one = sample % 3 == 1
    low = np.searchsorted(one(sample[by_one]), one(rest)) + np.searchsorted(two(sample[~by_one]), two(rest))
    # suffixes that agree in `need` symbols may compare by different depths: keep the order of the rest
    low = np.maximum.accumulate(low) if len(low) else low
    merged = np.empty(n, dtype=np.int64)
    rest_place = low + np.arange(len(rest))
    merged[rest_place] = rest
    free = np.ones(n, dtype=bool)
    free[rest_place] = False
    merged[free] = sample
    out = np.empty(n, dtype=np.int64)
    out[merged] = np.arange(1, n + 1)
    return out


def repeated(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Positions whose LENGTH-byte prefix, inside its own context, starts elsewhere in the data too."""
    n = len(data)
    if n < LENGTH:
        return np.zeros(0, dtype=np.int64)
    rank = ranks(data.astype(np.int64) + 1, LENGTH)
    left = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(n)
    order = np.flatnonzero(left >= LENGTH)
    order = order[np.argsort(rank[order], kind="stable")]
    eight = np.zeros(n, dtype=U64)
    for j in range(8):
        eight[: n - j] |= data[j:].astype(U64) << U64(8 * j)
    a, b = order[:-1], order[1:]
    same = np.flatnonzero(eight[a] == eight[b])
    for j in range(8, LENGTH, 8):
        same = same[eight[a[same] + j] == eight[b[same] + j]]
    out = np.zeros(len(order), dtype=bool)
    out[same] = True
    out[same + 1] = True
    return np.sort(order[out])


def runs(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """[start, stop) of what windows at these sorted starts cover."""
    if not len(starts):
        return starts, starts
    breaks = np.flatnonzero(np.diff(starts) > LENGTH) + 1
    return starts[np.append(0, breaks)], starts[np.append(breaks - 1, len(starts) - 1)] + LENGTH


SPANS = "hash long, c long, spans array<struct<a:long,b:long>>"


def _spans(hashes: np.ndarray, names: np.ndarray, data: bytes, offsets: np.ndarray) -> pa.RecordBatch:
    starts = repeated(np.frombuffer(data, dtype=np.uint8), offsets)
    own = np.searchsorted(offsets, starts, side="right") - 1
    out = []
    for i, lo, hi in zip(*_groups(own), strict=True):
        a, b = runs(starts[lo:hi] - offsets[i])
        out.append((int(hashes[i]), int(names[i]), [{"a": int(x), "b": int(y)} for x, y in zip(a, b, strict=True)]))
    kind = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int64(), kind))], ["hash", "c", "spans"])


def _groups(own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not len(own):
        return own, own, own
    cut = np.flatnonzero(np.diff(own)) + 1
    lo = np.append(0, cut)
    return own[lo], lo, np.append(cut, len(own))


def _shared(anchors_of: np.ndarray, data: np.ndarray, offsets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Contexts that share the bytes on one side of the anchor with another context of the same anchor."""
    prefix, out = prefix_hash(data), np.zeros(len(at), dtype=bool)
    place = offsets[:-1] + at
    for start, stop in ((place - SIDE, place + GRAM), (place, place + GRAM + SIDE)):
        some = np.flatnonzero((start >= offsets[:-1]) & (stop <= offsets[1:]))
        _, where, n = np.unique(range_hash(prefix, start[some], stop[some]) ^ mix(anchors_of[some].view(U64)), return_inverse=True, return_counts=True)
        out[some[n[where] > 1]] = True
    # two windows of one context have one anchor at two distances, so they never are equal
    return out


def _order_suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows hash, c, context, anchor sorted by hash and name: whole anchor groups up to CHUNK bytes at a time."""
    held: list[tuple] = []
    size, last = 0, None

    def flush() -> pa.RecordBatch:
        data = b"".join(r[2] for r in held)
        offsets = np.concatenate([[0], np.cumsum([len(r[2]) for r in held])])
        keep = np.flatnonzero(_shared(np.array([r[0] for r in held]), np.frombuffer(data, dtype=np.uint8), offsets, np.array([r[3] for r in held], dtype=np.int64)))
        kept = [held[i] for i in keep]
        offsets = np.concatenate([[0], np.cumsum([len(r[2]) for r in kept])]).astype(np.int64)
        return _spans(np.array([r[0] for r in kept]), np.array([r[1] for r in kept]), b"".join(r[2] for r in kept), offsets)

    for batch in batches:
        for h, name, body, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and (h, name) == held[-1][:2]:
                continue
            if held and h != last and size + len(body) > CHUNK:
                yield flush()
                held, size = [], 0
            held.append((h, name, body, at))
            size, last = size + len(body), h
    if held:
        yield flush()


def _extents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each context and side of its anchor a row for each number of bytes beside the anchor: a hash of those bytes."""
    for batch in batches:
        for h, name, body, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            raw = np.frombuffer(body, dtype=np.uint8)
            for side, beside in enumerate((raw[:at][::-1], raw[at + GRAM :])):
                n = len(beside)
                ends = np.arange(1, n + 1)
                w = range_hash(prefix_hash(beside), np.zeros(n, dtype=np.int64), ends).view(np.int64)
                full = lambda v, t: pa.array(np.full(n, v, dtype=t))  # noqa: E731,B023
                yield pa.RecordBatch.from_arrays([full(h, np.int64), full(name, np.int64), full(side, np.int32), pa.array(ends.astype(np.int32)), pa.array(w)], ["hash", "c", "side", "extent", "w"])


def _heavy_spans(some: DataFrame) -> DataFrame:
    """SPANS of contexts whose anchors have too many for one task. some: hash, c, context, anchor.

    A repeated window has no byte farther from its anchor than what some other context of that anchor shares on
    that side, so contexts are cut down to that first. Those round one passage then mostly are the same
    strings, and the number of different ones no longer grows with the documents that hold the passage.
    """
    name = ["hash", "c"]
    rows = some.select(*name, "context", "anchor").mapInArrow(_gathered(_extents), "hash long, c long, side int, extent int, w long")
    keys = ["hash", "side", "extent", "w"]
    again = stored(rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1"), "extents")
    side = lambda k: F.max(F.when(F.col("side") == k, F.col("extent")))
    shared = spread(rows, again, keys, ["c"]).groupBy(*name).agg(F.coalesce(side(0), F.lit(0)).alias("l"), F.coalesce(side(1), F.lit(0)).alias("r"))
    cut = some.join(shared, name).where(F.col("l") + F.col("r") + GRAM >= LENGTH)
    cut = cut.select(*name, (F.col("anchor") - F.col("l")).cast("long").alias("start"), F.expr(f"substring(context, anchor - l + 1, l + r + {GRAM})").alias("part"))
    cut = stored(cut.withColumn("p", F.xxhash64("part")), "cut")
    parts = stored(cut.groupBy("hash", "p").agg(F.first("part").alias("context"), F.count("*").alias("n")), "parts")
    found = cover.repeated(parts.select("hash", F.col("p").alias("c"), "context"), LENGTH)
    each = F.transform(F.collect_list("at"), lambda x: F.struct(x.alias("a"), (x + LENGTH).alias("b")))
    spans = found.groupBy("hash", F.col("c").alias("p")).agg(each.alias("spans"))
    whole = F.array(F.struct(F.lit(0).cast("long").alias("a"), F.octet_length("context").cast("long").alias("b")))
    known = parts.join(spans, ["hash", "p"], "left").where("n > 1 OR spans IS NOT NULL").select("hash", "p", "n", F.when(F.col("n") > 1, whole).otherwise(F.col("spans")).alias("spans"))
    moved = F.transform("spans", lambda x: F.struct((x["a"] + F.col("start")).alias("a"), (x["b"] + F.col("start")).alias("b")))
    return spread(cut.select(*name, "start", "p"), stored(known, "known"), ["hash", "p"], ["c"]).select(*name, moved.alias("spans"))


def repeated_spans(found: DataFrame, heavy_size: int = HEAVY) -> DataFrame:
    """id, body, spans: what is repeated, for every occurrence of a context. found: CONTEXT rows."""
    name = ["hash", "c"]
    distinct = found.where("context is not null").select(*name, "context", "anchor")
    # a table of its own: where it is small, Spark broadcasts it and the contexts are shuffled once
    heavy = stored(found.where("context is not null").groupBy("hash").agg(F.sum("size").alias("n")).where(F.col("n") > heavy_size).select("hash"), "heavy")
    light = distinct.join(heavy, "hash", "left_anti").repartition("hash").sortWithinPartitions(*name).mapInArrow(_order_suffixes, SPANS)
    some = distinct.join(heavy, "hash", "left_semi").dropDuplicates(name)
    if heavy.head(1):
        light = light.unionByName(_heavy_spans(some))
    places = found.select(*name, *KEY, "first")
    whole = found.groupBy(*name).agg(F.count("*").alias("n"), F.max("size").cast("long").alias("size"))
    parts = light.groupBy(*name).agg(F.flatten(F.collect_list("spans")).alias("spans"))
    every = F.array(F.struct(F.lit(0).cast("long").alias("a"), F.col("size").alias("b")))
    spans = whole.join(parts, name, "left").where("n > 1 OR spans IS NOT NULL").select(*name, "n", F.when(F.col("n") > 1, every).otherwise(F.col("spans")).alias("spans"))
    moved = spread(places, stored(spans, "cover"), name, [*KEY, "first"]).select(*KEY, F.transform("spans", lambda s: F.struct((s["a"] + F.col("first")).alias("a"), (s["b"] + F.col("first")).alias("b"))).alias("spans"))
    return moved.groupBy(*KEY).agg(F.flatten(F.collect_list("spans")).alias("spans"))


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<struct<a:long,b:long>>"


def dedup(docs: DataFrame, heavy_size: int = HEAVY) -> DataFrame:
    """RESULT for each document; `removed` has the byte ranges that go."""
    found = stored(contexts(docs), "contexts")
    spans = stored(repeated_spans(found, heavy_size), "spans")
    kind = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor()
        for batch in batches:
            out = []
            for i in range(len(batch)):
                text, row = expand.decompress(batch.column(1)[i].as_py()), batch.column(2)[i]
                merged: list[list[int]] = []
                if row.is_valid:
                    a, b = (row.values.field(k).to_numpy() for k in (0, 1))
                    order = np.argsort(a, kind="stable")
                    for x, y in zip(a[order].tolist(), b[order].tolist(), strict=True):
                        if merged and x <= merged[-1][1]:
                            merged[-1][1] = max(merged[-1][1], y)
                        else:
                            merged.append([x, y])
                digest, at = hashlib.sha256(), 0
                for x, y in merged:
                    digest.update(text[at:x])
                    at = y
                digest.update(text[at:])
                out.append((len(text), sum(y - x for x, y in merged), len(merged), digest.hexdigest(), [{"a": x, "b": y} for x, y in merged]))
            ids = [None if x == _NONE else x for x in batch.column(0).to_pylist()]
            columns = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(x, t) for x, t in zip(columns, (*[pa.int64()] * 3, pa.string(), kind), strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"])

    return packed(docs).join(spans, [*KEY], "left").select("id", "z", "spans").mapInArrow(run, RESULT)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all, 200 bytes."""
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("removed")
