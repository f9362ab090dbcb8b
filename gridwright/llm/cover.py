"""The difference-cover order of the suffixes of many short texts, as Spark jobs.

ranks() sorts and names the triples at the positions 1 and 2 modulo 3 of all texts, recurses on the names,
and merges the suffixes at 0 modulo 3 in. All of it is counting: a name is the number of lesser triples, a
rank the number of lesser suffixes. Counts come from one sort of the *distinct* keys over range partitions,
with a running sum in each and the partitions' totals before it, so a triple that every text holds is one row.
Then adjacent prefixes are compared. A text is one row and stays in one task; nothing else has to.

The order is right up to `need` symbols: suffixes that differ in them lie apart, others side by side.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .skew import spread
from .storage import stored
from .text import prefix_hash, range_hash

KEYS = ["space", "k1", "k2", "k3"]
_ROWS = "t long, at int, rest int, space int, k1 long, k2 long, k3 long"


def _few(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches in parts, as a text becomes many rows."""
    for b in batches:
        yield from (b.slice(lo, rows) for lo in range(0, len(b), rows))


def _bytes(column: pa.Array) -> pa.ListArray:
    """A binary column as lists of bytes."""
    column = column.cast(pa.binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(column.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    return pa.ListArray.from_arrays(pa.array(offsets - offsets[0]), pa.array(raw))


class _Texts:
    """The symbols of a batch's texts end to end, and each one's place, class and text."""

    def __init__(self, lists: pa.Array) -> None:
        self.symbols = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        self.size = np.diff(lists.offsets.to_numpy())
        self.row = np.repeat(np.arange(len(self.size)), self.size)
        self.at = np.arange(len(self.symbols)) - (np.cumsum(self.size) - self.size)[self.row]
        self.left = self.size[self.row] - self.at

    def ahead(self, values: np.ndarray, j: int) -> np.ndarray:
        """The value j places on, 0 beyond the text's end."""
        moved = np.append(values[j:], np.zeros(min(j, len(values)), dtype=values.dtype))
        return np.where(self.left > j, moved, 0)

    def joined_place(self) -> np.ndarray:
        """Where a sampled place stands in the text of names: those at 1 modulo 3, a separator, those at 2."""
        ones = (self.size + 1) // 3
        return self.at // 3 + np.where(self.at % 3 == 2, ones[self.row] + 1, 0)


def _emit(ids: np.ndarray, texts: _Texts, chosen: np.ndarray, rest: np.ndarray, space: int, keys: list[np.ndarray]) -> pa.RecordBatch:
    columns = [ids[texts.row], texts.at.astype(np.int32), rest.astype(np.int32), np.full(len(rest), space, dtype=np.int32), *keys]
    return pa.RecordBatch.from_arrays([pa.array(c[chosen]) for c in columns], [x.split()[0] for x in _ROWS.split(", ")])


def _triples(sampled: bool):
    """Rows of all triples, or of the sampled ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _few(batches):
            x = _Texts(b.column(1))
            chosen = (x.at % 3 != 0) | (not sampled)
            yield _emit(b.column(0).to_numpy(), x, chosen, np.zeros(len(chosen)), 0, [x.ahead(x.symbols, j) for j in range(3)])

    return run


def _merging(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows t, s, r (ranks of the text of names): the sample by rank; the remaining suffixes with those at 1 modulo 3 by a symbol and a rank, with those at 2 by two symbols and a rank."""
    for b in _few(batches):
        ids, x = b.column(0).to_numpy(), _Texts(b.column(1))
        deep = _Texts(b.column(2))
        start = np.cumsum(deep.size) - deep.size
        sample = x.at % 3 != 0
        rank = np.zeros(len(x.at), dtype=np.int64)
        rank[sample] = deep.symbols[(start[x.row] + x.joined_place())[sample]]
        rest, none = ~sample, np.zeros(len(x.at), dtype=np.int64)
        yield _emit(ids, x, sample, none, 0, [rank, none, none])
        yield _emit(ids, x, x.at % 3 != 2, rest, 1, [x.symbols, x.ahead(rank, 1), none])
        yield _emit(ids, x, x.at % 3 != 1, rest, 2, [x.symbols, x.ahead(x.symbols, 1), x.ahead(rank, 2)])


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of keys, n, rests with what came before them in this partition: sampled rows and remaining ones."""
    part, before = TaskContext.get().partitionId(), [0, 0]
    for b in batches:
        n, rests = b.column("n").to_numpy(), b.column("rests").to_numpy()
        columns = []
        for i, v in enumerate((n - rests, rests)):
            columns.append(pa.array(before[i] + np.cumsum(v) - v))
            before[i] += int(v.sum())
        yield pa.RecordBatch.from_arrays([*b.columns, *columns, pa.array(np.full(len(n), part, dtype=np.int32))], [*b.schema.names, "samples_before", "rests_before", "part"])


def _below(rows: DataFrame) -> DataFrame:
    """t, at, rest, space and how many sampled and remaining rows have lesser keys, those of lesser spaces included."""
    groups = rows.groupBy(*KEYS).agg(F.count("*").alias("n"), F.sum("rest").alias("rests"))
    kind = "space int, k1 long, k2 long, k3 long, n long, rests long, samples_before long, rests_before long, part int"
    local = stored(groups.repartitionByRange(*KEYS).sortWithinPartitions(*KEYS).mapInArrow(_running, kind), "keys")
    # one row for each range partition
    earlier = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    totals = local.groupBy("part").agg(F.sum(F.col("n") - F.col("rests")).alias("s"), F.sum("rests").alias("r"))
    totals = totals.select("part", *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c) for c in ("s", "r")))
    table = local.join(F.broadcast(totals), "part").select(*KEYS, "n", (F.col("samples_before") + F.col("s")).alias("samples"), (F.col("rests_before") + F.col("r")).alias("rests"))
    return spread(rows, table, KEYS, ["t", "at"]).select("t", "at", "rest", "space", "samples", "rests")


def _lists(found: DataFrame, value) -> DataFrame:
    """t, r: one more than the sum of the values at each place, by place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for x in b.column(1):
                at, v = (x.values.field(k).to_numpy() for k in (0, 1))
                sums = np.zeros(int(at.max()) + 1, dtype=np.int64)
                np.add.at(sums, at, v)
                out.append(sums + 1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.int64()))], ["t", "r"])

    listed = found.groupBy("t").agg(F.collect_list(F.struct("at", value.cast("long").alias("v"))).alias("l"))
    return listed.mapInArrow(run, "t long, r array<long>")


def _joined(names: DataFrame) -> DataFrame:
    """t, s: names at 1 modulo 3, a separator, names at 2. names: t, r with 1 at the places between, names from 1 else."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [np.concatenate([v[1::3] + 1, [1], v[2::3] + 1]) for v in (x.values.to_numpy() for x in b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.int64()))], ["t", "s"])

    return names.mapInArrow(run, "t long, s array<long>")


def ranks(texts: DataFrame, need: int) -> DataFrame:
    """t, r: the rank of each suffix of each text by its first `need` symbols. texts: t, s (symbols from 1), each of four or more; a stored table."""
    if need <= 3:
        return stored(_lists(_below(stored(texts.mapInArrow(_triples(False), _ROWS), "triples")), F.col("samples")), "ranks")
    named = _below(stored(texts.mapInArrow(_triples(True), _ROWS), "triples"))
    deep = ranks(stored(_joined(_lists(named, F.col("samples"))), "joined"), -(-need // 3))
    n = F.size("s")
    rest, one, two = (texts.agg(F.sum(F.floor((n + k) / 3)).alias("m")).first()[0] or 0 for k in (2, 1, 0))
    rows = stored(texts.join(deep, "t").select("t", "s", "r").mapInArrow(_merging, _ROWS), "merging")
    own, samples, rests = F.col("rest") == 1, F.col("samples"), F.col("rests")
    first = F.when(own, samples - (one + two) + rests).otherwise(rests)
    second = F.when(own, samples - (one + two) - one).otherwise(rests - rest)
    value = F.when(F.col("space") == 0, samples).when(F.col("space") == 1, first).otherwise(second)
    return stored(_lists(_below(rows), value), "ranks")


def _prefixes(length: int):
    """Rows hash, c, context, r: the suffixes of `length` bytes or more by rank, with a hash of those bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _few(batches):
            lists, rank = _bytes(b.column(2)), b.column(3).flatten().to_numpy()
            raw, x = lists.flatten().to_numpy(), _Texts(lists)
            p = np.flatnonzero(x.left >= length)
            w = range_hash(prefix_hash(raw), p, p + length).view(np.int64)
            columns = (b.column(0).to_numpy()[x.row[p]], b.column(1).to_numpy()[x.row[p]], x.at[p], rank[p], w)
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in columns], ["hash", "c", "at", "r", "w"])

    return run


def _adjacent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows r, h, w, n by rank: those that occur twice or equal the one beside them, and (edge) this partition's first and last."""
    part, first, last = TaskContext.get().partitionId(), None, None
    kinds = {"r": pa.int64(), "h": pa.int64(), "w": pa.int64(), "part": pa.int32(), "edge": pa.bool_()}

    def out(rows: list[tuple], edge: bool) -> pa.RecordBatch:
        full = [(*r, part, edge) for r in rows]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in full], t) for i, t in enumerate(kinds.values())], list(kinds))

    for b in batches:
        if not len(b):
            continue
        r, h, w, n = (b.column(k).to_numpy() for k in ("r", "h", "w", "n"))
        same = np.zeros(len(r), dtype=bool)
        same[1:] = (h[1:] == h[:-1]) & (w[1:] == w[:-1])
        row = lambda i: (int(r[i]), int(h[i]), int(w[i]))  # noqa: E731,B023
        twice = [row(i) for i in np.flatnonzero(same | np.append(same[1:], False) | (n > 1))]
        if first is None:
            first = row(0)
        elif last[1:] == row(0)[1:]:
            twice += [last, row(0)]
        last = row(-1)
        yield out(twice, False)
    if first:
        yield out([first] if first == last else [first, last], True)


def repeated(texts: DataFrame, length: int) -> DataFrame:
    """hash, c, at: where a string of `length` bytes starts that starts elsewhere in the texts too. texts: hash, c, context (bytes, of `length` or more), one row for each name (hash, c)."""
    texts = stored(texts.select("hash", "c", "context", F.monotonically_increasing_id().alias("t")), "texts")

    def symbols(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _few(batches):
            lists = _bytes(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(lists.offsets, pa.array(lists.flatten().to_numpy().astype(np.int64) + 1))], ["t", "s"])

    rank = ranks(stored(texts.select("t", "context").mapInArrow(symbols, "t long, s array<long>"), "symbols"), length)
    found = texts.join(rank, "t").select("hash", "c", "context", "r")
    starts = stored(found.mapInArrow(_prefixes(length), "hash long, c long, at long, r long, w long"), "prefixes")
    groups = stored(starts.groupBy("r", F.col("hash").alias("h"), "w").agg(F.count("*").alias("n")), "prefix_groups")
    order = groups.select("r", "h", "w", "n").repartitionByRange("r").sortWithinPartitions("r")
    beside = stored(order.mapInArrow(_adjacent, "r long, h long, w long, part int, edge boolean"), "beside")
    # the last of a partition and the first of the next: two rows a partition
    over = W.orderBy("part", "r")
    edges = beside.where("edge").select("r", *(f(F.struct("h", "w")).over(over).alias(k) for k, f in (("p", F.lag), ("f", F.lead))), F.struct("h", "w").alias("own"))
    twice = beside.where("not edge").select("r").union(edges.where("(p = own) or (f = own)").select("r")).distinct()
    known = groups.select("r", "n").join(twice, "r")
    return spread(starts, stored(known, "repeated"), ["r"], ["hash", "c", "at"]).select("hash", "c", "at")
