"""Near-duplicate documents by DartMinHash over weighted five-word shingles.

A document is the multiset of its shingles of five words (lower case, split at white space; under five
words: all of them), a shingle weighing as often as it occurs: weights are whole numbers. Each unit of weight of an element is a
column on which darts arrive as a Poisson process of hashed exponential gaps. A document of weight W
looks at the darts up to rank t / W, about t in all whatever its length; each dart falls into one of K
coordinates and the earliest one there is the coordinate's value. If a coordinate stays empty, t doubles.
Two documents agree in a coordinate with the probability of their weighted Jaccard similarity.

BANDS x ROWS coordinates form bands: at similarity 0.8 a pair misses all bands once in 38,000. Each
bucket tests its members against its least member (exact similarity on all shingles). Links make
components. Only where a bucket still has members of several components, more has to be looked at. In a
bucket of up to SMALL members its other pairs across components are tested too, but for those that the
triangle inequality of Jaccard distances rules out. Larger ones (a wide group whose members are alike
to various degrees) are merged into groups by their common members; there all texts outside the
group's largest component are compared with all of its texts of like length, BLOCK by BLOCK, in matrix products of which
only the links that join components leave the task. (Texts are put in bands by their number of elements, each 1 / 0.8 times
the one below: what is alike lies in the same band or the next.) So no pair that shares a bucket is lost, and copies
never are expanded into all pairs.

Texts are named by 64-bit hashes; n different texts expect n^2 / 2^65 pairs to share one.

Cases: a null text counts as empty; texts without words are copies of each other if equal; repeated
rows are exact copies; a null doc_id sorts last; an empty table gives an empty table; columns pass
through deduped() untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .skew import spread
from .storage import as_struct, stored
from .text import U64, mix, prefix_hash, range_hash, slices, utf8, words

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 20, 4
K = BANDS * ROWS
#: Darts looked at: enough that 19 of 20 documents fill all coordinates at once.
DARTS = K * (np.log(K) + 3)
SMALL, BLOCK = 8, 512
#: Elements that a matrix product takes at once.
COLUMNS = 8192
_SEED = mix(np.arange(11, 15, dtype=U64))
_STEP = U64(0x632BE59BD9B4E019)


def shingles(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, row of each element, element) by slices; elements are units of weight."""
    raw_all, offsets_all = utf8(pc.utf8_lower(pc.fill_null(column, "")))
    for lo, hi in slices(offsets_all):
        raw, offsets = raw_all[offsets_all[lo] : offsets_all[hi]], offsets_all[lo : hi + 1] - offsets_all[lo]
        start, stop, row = words(raw, offsets)
        if not len(start):
            yield lo, hi, row, np.zeros(0, U64)
            continue
        word = range_hash(prefix_hash(raw), start, stop)
        count = np.bincount(row, minlength=hi - lo)
        first = np.cumsum(count) - count
        left = count[row] - (np.arange(len(row)) - first[row])
        at = np.flatnonzero((left >= SHINGLE) | ((count[row] < SHINGLE) & (left == count[row])))
        s = word[at]
        for j in range(1, SHINGLE):
            inside = left[at] > j
            s = mix(s * _STEP + np.where(inside, word[np.minimum(at + j, len(word) - 1)], U64(0)))
        row = row[at]
        yield lo, hi, row, _repeats(s, row)


def _repeats(s: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Elements such that the n-th occurrence of a shingle in a document is an element of its own."""
    key = s ^ mix(row.astype(U64) + U64(1))
    order = np.sort(key)
    again = np.unique(order[1:][order[1:] == order[:-1]])
    if not len(again):
        return s
    place = np.minimum(np.searchsorted(again, key), len(again) - 1)
    at = np.flatnonzero(again[place] == key)
    at = at[np.argsort(key[at], kind="stable")]
    new = np.concatenate(([True], key[at][1:] != key[at][:-1]))
    nth = np.arange(len(at)) - np.flatnonzero(new)[np.cumsum(new) - 1]
    s = s.copy()
    s[at] = np.where(nth > 0, mix(s[at] + nth.astype(U64) * _STEP), s[at])
    return s


def _unit(x: np.ndarray) -> np.ndarray:
    return ((x >> U64(11)).astype(np.float64) + 0.5) * 2.0**-53


def signatures(element: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """n x K earliest darts; rows without elements are zeros."""
    out = np.zeros((n, K), dtype=U64)
    weight = np.bincount(row, minlength=n)
    todo, darts = weight > 0, DARTS
    while todo.any():
        own = todo[row]
        e, r = element[own], row[own]
        limit = darts / weight[r]
        rank, nth = np.zeros(len(e)), U64(0)
        cells, ranks, names = [], [], []
        while len(e):
            nth += U64(1)
            dart = mix((e ^ _SEED[0]) + np.multiply(nth, _STEP, dtype=U64))
            rank = rank - np.log(_unit(dart))
            hit = rank <= limit
            e, r, rank, limit, dart = e[hit], r[hit], rank[hit], limit[hit], dart[hit]
            name = mix(dart ^ _SEED[1])
            cells.append(r * K + (name % U64(K)).astype(np.int64))
            ranks.append(rank)
            names.append(name)
        cell, rank, name = np.concatenate(cells), np.concatenate(ranks), np.concatenate(names)
        order = np.lexsort((rank, cell))
        cell = cell[order]
        lead = np.concatenate(([True], cell[1:] != cell[:-1])) if len(cell) else np.zeros(0, bool)
        found = np.bincount(cell[lead] // K, minlength=n)
        full = todo & (found == K)
        use = full[cell[lead] // K]
        out.reshape(-1)[cell[lead][use]] = name[order][lead][use]
        todo, darts = todo & ~full, darts * 2
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    key = np.broadcast_to(mix(np.arange(1, BANDS + 1, dtype=U64)), (len(signature), BANDS))
    for j in range(ROWS):
        key = mix(key * _STEP + signature[:, j::ROWS][:, :BANDS])
    return key.view(np.int64)


def text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def order_key(doc_id: Column) -> Column:
    """doc_id for grouping and order; null comes last."""
    return F.coalesce(doc_id.cast("long"), F.lit((1 << 63) - 1))


def sketches(docs: DataFrame) -> DataFrame:
    """id, uid, keys: the band keys of every document (none without words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for lo, hi, row, element in shingles(batch.column(2)):
                keys = band_keys(signatures(element, row, hi - lo))
                some = np.bincount(row, minlength=hi - lo) > 0
                ends = np.concatenate(([0], np.cumsum(some) * BANDS)).astype(np.int32)
                parts.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[some].reshape(-1))))
            lists = pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], ["id", "uid", "keys"])

    rows = docs.select(order_key(F.col("doc_id")).alias("id"), text_key(F.col("text")).alias("uid"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, uid long, keys array<long>")


def _elements(texts: DataFrame) -> DataFrame:
    """uid, elements: sorted 64-bit elements as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[bytes] = []
            for lo, hi, row, element in shingles(batch.column(1)):
                order = np.lexsort((element, row))
                raw, ends = element[order].tobytes(), np.concatenate(([0], np.cumsum(np.bincount(row, minlength=hi - lo)))) * 8
                out += [raw[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["uid", "elements"])

    return texts.mapInArrow(run, "uid long, elements binary")


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            a, b = np.frombuffer(x.as_py(), U64), np.frombuffer(y.as_py(), U64)
            if len(a) > len(b):
                a, b = b, a
            at = np.searchsorted(b, a)
            both = int((b[np.minimum(at, len(b) - 1)] == a).sum()) if len(b) else 0
            out.append(both / max(1, len(a) + len(b) - both))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.float64())], ["a", "b", "j"])


def _texts(need: DataFrame, docs: DataFrame, names: DataFrame) -> DataFrame:
    """uid, text: the row of each text with its least id (and rows that repeat that)."""
    texts = docs.select(order_key(F.col("doc_id")).alias("id"), text_key(F.col("text")).alias("uid"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return texts.join(need.join(names.select("uid", "id"), "uid"), ["id", "uid"]).select("uid", "text")


def _tested(pairs: DataFrame, docs: DataFrame, names: DataFrame) -> DataFrame:
    """a, b, j: exact weighted Jaccard similarity of each pair of texts, all shingles counted."""
    pairs = stored(pairs, "pairs")
    need = pairs.select(F.col("a").alias("uid")).union(pairs.select(F.col("b").alias("uid"))).distinct()
    elements = stored(_elements(_texts(need, docs, names)).groupBy("uid").agg(F.first("elements").alias("elements")), "elements")
    left = pairs.join(elements.withColumnRenamed("uid", "a").withColumnRenamed("elements", "x"), "a")
    # one lead may have a third of all texts, each of which needs its elements
    asked = stored(pairs.groupBy("b").agg(F.count("*").alias("n")).join(elements.withColumnRenamed("uid", "b").withColumnRenamed("elements", "y"), "b"), "asked")
    both = spread(left, asked, ["b"], ["a"])
    return stored(both.select("a", "b", "x", "y").mapInArrow(_similar, "a long, b long, j double"), "tested")


def classes(docs: DataFrame, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """(sketches: id, uid, keys for each row; uid, copies, class_id, first_uid for each text): how many rows have it, the class's least id and its text."""
    rows = stored(sketches(docs), "sketches")
    names = rows.groupBy("uid").agg(F.min("id").alias("id"), F.count("*").alias("copies"))
    buckets = rows.select("uid", "keys").dropDuplicates(["uid"]).select("uid", F.explode("keys").alias("key"))
    leads = stored(buckets.groupBy("key").agg(F.min("uid").alias("lead"), F.max("uid").alias("last"), F.count("*").alias("n")).where("lead < last").drop("last"), "leads")
    members = stored(spread(buckets, leads, ["key"], ["uid"]), "members")
    tested = _tested(members.where("uid <> lead").select(F.col("uid").alias("a"), F.col("lead").alias("b")).distinct(), docs, names)
    links = tested.where(F.col("j") >= similarity).select("a", "b")
    labels = stored(components(links), "labels")
    named, open_keys = _open(members, labels)
    if open_keys.head(1):
        more = _across(named, open_keys.where(F.col("n") <= SMALL), tested, similarity)
        again = _tested(more, docs, names).where(F.col("j") >= similarity).select("a", "b") if more.head(1) else links.limit(0)
        wide = named.join(open_keys.where(F.col("n") > SMALL), "key", "left_semi")
        blocks = _in_blocks(wide, docs, names, similarity) if wide.head(1) else links.limit(0)
        labels = stored(components(links.union(again).union(blocks)), "labels")
    named = stored(names.join(labels.withColumnRenamed("node", "uid"), "uid", "left").select("uid", "id", "copies", F.coalesce("label", "uid").alias("label")), "labelled")
    firsts = stored(named.groupBy("label").agg(F.min(F.struct("id", "uid")).alias("least"), F.count("*").alias("n")), "firsts")
    return rows, stored(spread(named, firsts, ["label"], ["uid"]).select("uid", "copies", F.col("least.id").alias("class_id"), F.col("least.uid").alias("first_uid")), "classes")


def _open(members: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, uid, lead, label; key, n) of all buckets, and of those with several components and more than two members."""
    named = stored(members.join(labels.withColumnRenamed("node", "uid"), "uid", "left").withColumn("label", F.coalesce("label", "uid")), "named")
    counts = named.groupBy("key").agg(F.min("label").alias("l"), F.max("label").alias("m"), F.count("*").alias("n"))
    return named, stored(counts.where("l <> m and n > 2").select("key", "n"), "open")


def _across(named: DataFrame, keys: DataFrame, tested: DataFrame, similarity: float) -> DataFrame:
    """Untested pairs across components in small buckets, unless their distances from the lead differ too much."""
    j = tested.select(F.col("a").alias("uid"), F.col("b").alias("lead"), "j")
    left = named.where("uid <> lead").join(keys, "key", "left_semi").join(j, ["uid", "lead"]).select("key", "uid", "label", "j")
    rows = left.groupBy("key").agg(F.collect_list(F.struct("uid", "label", "j")).alias("all"))
    pairs = rows.select(F.explode("all").alias("x"), "all").select("x", F.explode("all").alias("y"))
    close = F.abs(F.col("x.j") - F.col("y.j")) <= 1 - similarity + 1e-9
    across = pairs.where((F.col("x.uid") > F.col("y.uid")) & (F.col("x.label") != F.col("y.label")) & close).select(F.col("x.uid").alias("a"), F.col("y.uid").alias("b")).distinct()
    return stored(across.join(tested, ["a", "b"], "left_anti"), "across")


def _in_blocks(wide: DataFrame, docs: DataFrame, names: DataFrame, similarity: float) -> DataFrame:
    """Links that join components of the groups that wide buckets form. wide: key, uid, lead, label."""
    groups = stored(components(wide.where("uid <> lead").select(F.col("uid").alias("a"), F.col("lead").alias("b")).distinct()), "groups")
    texts = groups.withColumnRenamed("node", "uid").withColumnRenamed("label", "g").join(wide.select("uid", "label").distinct(), "uid")
    parts = texts.groupBy("g", "label").agg(F.count("*").alias("n")).groupBy("g").agg(F.max(F.struct("n", "label")).alias("top"))
    size = F.log(F.octet_length("elements") / 8.0) / -np.log(similarity)
    rows = texts.join(_elements(_texts(texts.select("uid"), docs, names)), "uid").dropDuplicates(["uid"]).where(F.octet_length("elements") > 0)
    rows = stored(rows.join(parts.select("g", F.col("top.label").alias("major")), "g").withColumn("band", F.floor(F.round(size, 9))), "wide")
    # texts whose numbers of elements differ by more than the similarity allows are at least two bands apart
    outside = rows.where("label <> major").select("g", "band", "uid", "label", "elements")
    # aliases, so that the two sides' columns are not taken for the same
    within = rows.select(F.explode(F.array(*(F.col("band") + i for i in (-1, 0, 1)))).alias("band"), *(F.col(c).alias(c) for c in ("g", "uid", "label", "elements")))
    many = lambda df, n: df.groupBy("g", "band").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias(n))
    shape = stored(many(outside, "nq").join(many(within, "nd"), ["g", "band"]), "bands")
    mine = lambda n: F.pmod(F.xxhash64("uid"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    asking = outside.join(shape, ["g", "band"]).select("g", "band", mine("nq").alias("q"), every("nd").alias("d"), "uid", "label", "elements")
    asked = within.join(shape, ["g", "band"]).select("g", "band", every("nq").alias("q"), mine("nd").alias("d"), "uid", "label", "elements")
    found = asking.groupBy("g", "band", "q", "d").cogroup(asked.groupBy("g", "band", "q", "d")).applyInArrow(_block(similarity), "a long, b long")
    return stored(found, "blocks")


def _block(similarity: float):
    kind = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def sets(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        parts = [np.frombuffer(x.as_py(), U64) for x in t.column("elements")]
        size = np.array([len(x) for x in parts])
        return np.concatenate(parts), np.repeat(np.arange(len(parts)), size), size

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return pa.Table.from_batches([], kind)
        (x, x_row, x_size), (y, y_row, y_size) = sets(left), sets(right)
        vocabulary = np.intersect1d(x, y)
        both = np.zeros((len(left), len(right)), dtype=np.float32)
        for lo in range(0, len(vocabulary), COLUMNS):
            some = vocabulary[lo : lo + COLUMNS]
            dense = []
            for e, row, n in ((x, x_row, len(left)), (y, y_row, len(right))):
                at = np.minimum(np.searchsorted(some, e), len(some) - 1)
                hit = some[at] == e
                m = np.zeros((n, len(some)), dtype=np.float32)
                m[row[hit], at[hit]] = 1
                dense.append(m)
            both += dense[0] @ dense[1].T
        both = both.astype(np.float64)
        like = both / np.maximum(x_size[:, None] + y_size[None, :] - both, 1) >= similarity
        a, b = left.column("uid").to_numpy(), right.column("uid").to_numpy()
        la, lb = left.column("label").to_numpy(), right.column("label").to_numpy()
        parent: dict[int, int] = {}

        def root(v: int) -> int:
            while parent.get(v, v) != v:
                v = parent[v]
            return v

        out = []
        for i, j in zip(*np.nonzero(like & (la[:, None] != lb[None, :])), strict=True):
            p, q = root(int(la[i])), root(int(lb[j]))
            if p != q:
                parent[p] = q
                out.append((int(a[i]), int(b[j])))
        return pa.Table.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in (0, 1)], schema=kind)

    return run


def deduped(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """docs' own columns, of each class the document with the least doc_id alone."""
    _, found = classes(docs, similarity)
    firsts = stored(found.where("uid = first_uid").select("uid", F.col("class_id").alias("id"), F.col("copies").alias("n")), "kept")
    rows = docs.select(as_struct(docs).alias("row"), order_key(F.col("doc_id")).alias("id"), text_key(F.col("text")).alias("uid"))
    # rows that agree in doc_id and text are one document
    return spread(rows, firsts, ["uid", "id"], ["row"]).groupBy("uid", "id").agg(F.first("row").alias("row")).select("row.*")


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, class_id (least doc_id of the class), kept (it is that one) for every document."""
    rows, found = classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    none = F.lit((1 << 63) - 1)
    # copies of one text may be a third of all rows
    out = spread(rows.select("id", "uid"), found.select("uid", "class_id", F.col("copies").alias("n")), ["uid"], ["id"])
    return out.select(F.nullif("id", none).alias("doc_id"), F.nullif("class_id", none).alias("class_id"), (F.col("id") == F.col("class_id")).alias("kept"))
