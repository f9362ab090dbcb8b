"""Nearest neighbours by inner product with a hierarchical k-means tree and best-bin-first search.

Equal vectors form one class that carries its TOP + 1 least ids, which is all that any result can show of
it. The tree is fitted on a bounded sample (SAMPLE classes of least hash; at most MAX_LEAVES leaves),
then every class is put in its leaf. Vectors get one more coordinate that makes all norms equal, so
that the nearest by distance are the largest by inner product. A query walks the tree with a priority
queue of unexplored nodes, nearest centre first, and lists the leaves in that order. How many of them
are visited is calibrated: CALIBRATION queries are compared with all vectors in blocks, and visits widen
until their recall reaches TARGET. Scores are exact, in double precision, on the original vectors.

Leaves over BLOCK classes are split, and so are the queries of a leaf over QUERIES.

Cases: null, empty and zero vectors and those with null or non-finite components take no part; vectors are
compared with those of their own length, each length having a tree of its own; a null vec_id takes no part;
rows that agree in vec_id and vector count once; fewer candidates than TOP give all; an empty table gives an empty table.
"""

from __future__ import annotations

import functools
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .skew import spread
from .storage import stored

TOP = 20
QUERY_EVERY = 20
LEAF, BRANCHES, MAX_LEAVES = 1000, 8, 4096
#: Vectors of the sample, and their components in all.
SAMPLE, SAMPLE_VALUES = 65_536, 1 << 23
CALIBRATION, TARGET = 200, 0.95
BLOCK, QUERIES = 8192, 8192


def usable(rows: DataFrame) -> DataFrame:
    """id, v (array of double), cid (64-bit name of the vector) of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    good = rows.select(F.col("vec_id").cast("long").alias("id"), v.alias("v")).where(
        F.col("id").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))) & F.exists("v", lambda x: x != 0)
    )
    return good.select("id", "v", F.xxhash64("v").alias("cid"))


class Tree:
    """Centres, children and leaf numbers as plain arrays; at most 2 * MAX_LEAVES nodes."""

    def __init__(self, sample: np.ndarray, leaves: int, norm2: float) -> None:
        self.norm2 = norm2
        self.centres: list[np.ndarray] = []
        self.children: list[list[int]] = []
        self.leaf: list[int] = []
        self.rng = np.random.default_rng(7)
        self.leaves = 0
        self._grow(self.lifted(sample), leaves)
        self.at = np.array(self.centres).reshape(len(self.centres), -1)

    def lifted(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([x, np.sqrt(np.maximum(self.norm2 - (x**2).sum(1, keepdims=True), 0))], axis=1)

    def _grow(self, x: np.ndarray, leaves: int) -> int:
        node = len(self.centres)
        self.centres.append(x.mean(0) if len(x) else x.sum(0))
        self.children.append([])
        self.leaf.append(-1)
        if leaves > 1 and len(x) > 1:
            own = self._means(x, min(BRANCHES, leaves, len(x)))
            found = np.unique(own)
            if len(found) > 1:
                share = [(own == j).sum() for j in found]
                for j, n in zip(found, share, strict=True):
                    self.children[node].append(self._grow(x[own == j], max(1, round(leaves * n / len(x)))))
                return node
        self.leaf[node] = self.leaves
        self.leaves += 1
        return node

    def _means(self, x: np.ndarray, k: int) -> np.ndarray:
        centre = x[self.rng.choice(len(x), k, replace=False)]
        for _ in range(8):
            own = _nearest(x, centre)
            for j in range(k):
                if (own == j).any():
                    centre[j] = x[own == j].mean(0)
        return _nearest(x, centre)

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector, by the nearest child at each node."""
        x, out = self.lifted(x), np.zeros(len(x), dtype=np.int64)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if not self.children[node]:
                out[rows] = self.leaf[node]
                continue
            own = _nearest(x[rows], self.at[self.children[node]])
            todo += [(c, rows[own == j]) for j, c in enumerate(self.children[node]) if (own == j).any()]
        return out

    def walk(self, query: np.ndarray) -> Iterator[int]:
        """Leaves in best-bin-first order."""
        q = np.append(query, 0.0)
        queue = [(0.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            below = self.children[node]
            if not below:
                yield self.leaf[node]
                continue
            for d, c in zip(((self.at[below] - q) ** 2).sum(1).tolist(), below, strict=True):
                heapq.heappush(queue, (d, c))


def _nearest(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return np.argmax(x @ centre.T - 0.5 * (centre**2).sum(1), axis=1)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k largest scores of each row, ties to the smaller id."""
    n = scores.shape[1]
    if n > 4 * k:
        cut = np.partition(scores, n - k, axis=1)[:, n - k]
        return [(c := np.flatnonzero(row >= t))[np.lexsort((ids[c], -row[c]))[:k]] for row, t in zip(scores, cut, strict=True)]
    return [np.lexsort((ids, -row))[:k] for row in scores]


FOUND = "qcid long, cids array<long>, scores array<double>, firsts array<long>"
KIND = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.list_(pa.int64())]
NAMES = [x.split()[0] for x in FOUND.split(", ")]


def _scan(q_names: np.ndarray, q: np.ndarray, names: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> pa.RecordBatch:
    """The k best classes of one block for each query."""
    cids, scores, firsts = [], [], []
    for lo in range(0, len(q), 256):
        s = q[lo : lo + 256] @ x.T
        for row, c in zip(s, _best(s, ids, k), strict=True):
            cids.append(names[c])
            scores.append(row[c])
            firsts.append(ids[c])
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip((q_names, cids, scores, firsts), KIND, strict=True)], NAMES)


def classes_of(rows: DataFrame, top: int) -> DataFrame:
    """cid, v, first, ids: distinct vectors with their top + 1 least ids."""
    rank = F.dense_rank().over(W.partitionBy("cid").orderBy("id"))
    least = rows.withColumn("rank", rank).where(F.col("rank") <= top + 1)
    return least.groupBy("cid").agg(F.first("v").alias("v"), F.sort_array(F.collect_set("id")).alias("ids")).select("cid", "v", F.col("ids")[0].alias("first"), "ids")


def fitted(classes: DataFrame) -> Tree:
    """The tree on the SAMPLE classes of least hash."""
    n, norm2 = classes.agg(F.count("*"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).first()
    length = (classes.select(F.size("v")).first() or [1])[0]
    rows = classes.select("cid", "v").orderBy(F.xxhash64("cid"), "cid").limit(max(1, min(SAMPLE, SAMPLE_VALUES // length))).toArrow()
    return Tree(_matrix(rows.column("v")), min(MAX_LEAVES, max(1, -(-n // LEAF))), norm2 or 0.0)


def in_leaves(classes: DataFrame, tree: Tree) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            leaf = pa.array(tree.assign(_matrix(b.column(1))) if len(b) else [], pa.int64())
            yield pa.RecordBatch.from_arrays([leaf, *b.columns], ["leaf", "cid", "v", "first", "ids"])

    return classes.mapInArrow(run, "leaf long, cid long, v array<double>, first long, ids array<long>")


def calibrated(leaves: DataFrame, queries: DataFrame, tree: Tree, top: int) -> tuple[int, float]:
    """(visits, recall): the leaves to visit so that CALIBRATION queries find TARGET of their exact neighbours."""
    chosen = queries.orderBy(F.xxhash64("cid"), "cid").limit(CALIBRATION).toArrow()
    q, q_names = _matrix(chosen.column("v")), chosen.column("cid").to_numpy()
    if not len(q):
        return 1, 1.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                yield _scan(q_names, q, b.column(1).to_numpy(), _matrix(b.column(2)), b.column(3).to_numpy(), top + 1)

    best = _merged(leaves.select("leaf", "cid", "v", "first").mapInArrow(run, FOUND), top + 1)
    true = best.select("qcid", F.explode("best").alias("b")).select("qcid", F.col("b.cid").alias("cid")).where("qcid <> cid")
    rows = true.join(leaves.select("cid", "leaf"), "cid").select("qcid", "leaf").toPandas()
    place = {}
    for name, v in zip(q_names, q, strict=True):
        place[name] = {leaf: i for i, leaf in enumerate(tree.walk(v))}
    needed = np.sort([place[a][b] + 1 for a, b in zip(rows["qcid"], rows["leaf"], strict=True)])
    if not len(needed):
        return 1, 1.0
    visits = int(needed[min(len(needed) - 1, int(np.ceil(TARGET * len(needed))) - 1)])
    return visits, float((needed <= visits).mean())


def _merged(found: DataFrame, k: int) -> DataFrame:
    """qcid, best: the k best (score, first, cid) over the blocks, as an array: largest score first, ties to the smaller first id."""
    zipped = found.select("qcid", F.transform(F.arrays_zip("scores", "firsts", "cids"), lambda x: F.struct((-x["scores"]).alias("minus"), x["firsts"].alias("first"), x["cids"].alias("cid"))).alias("pairs"))
    return zipped.groupBy("qcid").agg(F.flatten(F.collect_list("pairs")).alias("pairs")).select("qcid", F.slice(F.array_sort("pairs"), 1, k).alias("best"))


def search(rows: DataFrame, is_query, top: int = TOP) -> DataFrame:
    """query_id, rank, vec_id, score for the rows where is_query(id) holds. rows: vec_id, embedding."""
    good = stored(usable(rows), "vectors")
    lengths = sorted(r[0] for r in good.select(F.size("v")).distinct().collect())
    if len(lengths) < 2:
        return _search(good, is_query, top)
    return functools.reduce(DataFrame.union, [_search(good.where(F.size("v") == n), is_query, top) for n in lengths])


def _search(good: DataFrame, is_query, top: int) -> DataFrame:
    classes = stored(classes_of(good, top), "classes")
    tree = fitted(classes)
    leaves = stored(in_leaves(classes, tree), "leaves")
    asked = good.where(is_query(F.col("id")))
    queries = stored(asked.groupBy("cid").agg(F.first("v").alias("v")), "queries")
    visits, _ = calibrated(leaves, queries, tree, top)
    # at most MAX_LEAVES rows
    sizes = leaves.groupBy("leaf").agg(F.count("*").alias("n"), F.sum(F.size("ids")).alias("m"))
    counts = {r["leaf"]: r["m"] for r in sizes.collect()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = []
            for v in _matrix(b.column(1)) if len(b) else []:
                out, held = [], 0
                for leaf in tree.walk(v):
                    if len(out) >= visits and held > top:
                        break
                    out.append(leaf)
                    held += counts.get(leaf, 0)
                lists.append(out)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lists, pa.list_(pa.int64()))], ["cid", "v", "leaves"])

    # a vector is stored once with the list of its leaves
    visits_of = stored(queries.select("cid", "v").mapInArrow(run, "cid long, v array<double>, leaves array<long>"), "visited")
    asks = visits_of.select(F.explode("leaves").alias("leaf")).groupBy("leaf").agg(F.count("*").alias("asks"))
    visited = visits_of.select(F.explode("leaves").alias("leaf"), "cid", "v")
    # two tables of at most MAX_LEAVES rows
    shape = F.broadcast(sizes.join(asks, "leaf").select("leaf", F.ceil(F.col("n") / BLOCK).cast("int").alias("parts"), F.ceil(F.col("asks") / QUERIES).cast("int").alias("qparts")))
    blocks = leaves.join(shape, "leaf").select("leaf", F.pmod(F.xxhash64("cid"), F.col("parts")).alias("part"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("qparts").cast("long") - 1)).alias("qpart"), "cid", "v", "first")
    asking = visited.join(shape, "leaf").select("leaf", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1)).alias("part"), F.pmod(F.xxhash64("cid"), F.col("qparts")).alias("qpart"), "cid", "v")

    def block(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return pa.Table.from_batches([], pa.schema(list(zip(NAMES, KIND, strict=True))))
        return pa.Table.from_batches([_scan(right.column("cid").to_numpy(), _matrix(right.column("v")), left.column("cid").to_numpy(), _matrix(left.column("v")), left.column("first").to_numpy(), top + 1)])

    keys = ["leaf", "part", "qpart"]
    found = blocks.groupBy(*keys).cogroup(asking.groupBy(*keys)).applyInArrow(block, FOUND)
    best = stored(_merged(found, top + 1).select("qcid", F.explode("best").alias("b")).select("qcid", F.col("b.minus").alias("minus"), F.col("b.cid").alias("cid")), "best")
    # a long vector is among the best of most queries, and many queries may be one vector
    often = stored(best.groupBy("cid").agg(F.count("*").alias("n")).join(classes.select("cid", "ids"), "cid"), "often")
    named = spread(best, often, ["cid"], ["qcid"]).select("qcid", F.explode(F.transform("ids", lambda i: F.struct(F.col("minus"), i.alias("id")))).alias("hit"))
    lists = named.groupBy("qcid").agg(F.slice(F.array_sort(F.collect_list("hit")), 1, top + 1).alias("hits"))
    own = asked.select("id", F.col("cid").alias("qcid")).distinct()
    groups = stored(own.groupBy("qcid").agg(F.count("*").alias("n")).join(lists, "qcid"), "lists")
    own = spread(own, groups, ["qcid"], ["id"])
    hits = own.select("id", F.posexplode(F.slice(F.filter("hits", lambda h: h["id"] != F.col("id")), 1, top)).alias("pos", "hit"))
    return hits.select(F.col("id").alias("query_id"), (F.col("pos") + 1).alias("rank"), F.col("hit.id").alias("vec_id"), (-F.col("hit.minus")).alias("score"))


def op5_ann_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest 20 of every twentieth vector among all vectors."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return search(rows, lambda i: i % QUERY_EVERY == 0)
