"""Embedding whitening by a pivoted Cholesky factor and one-sided Jacobi rotations of it.

Vectors become whole numbers, x = floor(256 c), and each different one counts once. Spark gathers their number, their
exact sums and the scatter of x - S / n, row by row of the matrix with map-side partials. That d x d matrix is factored with
diagonal pivoting; the columns of the triangular factor are rotated against each other, pair by pair, until they are
orthogonal. Their squared norms then are the eigenvalues, and the columns over their norms the components. No
product of the factor with itself is formed, so small eigenvalues keep their digits. Rows are projected where they lie, without a shuffle.

Only the different vectors move: as bytes of the narrowest whole-number type that holds them.

Cases: rows with a null vector or one with null or non-finite entries are left out; so are empty vectors, which have no components. Vectors of each length are fitted for
themselves. An entry whose 256-fold is beyond a long becomes the nearest long. A component without variance (eigenvalue at most 1e-12 of the
largest, by rounding zero) gives no rows, so of a single distinct vector there are none. A deviation beyond a long is null. Null ids and repeated rows come back as
they are; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import stored

SCALE, COMPONENTS = 256, 4
#: The longest vectors: the driver holds a few d x d matrices.
LONGEST = 4096
_LONG = np.iinfo(np.int64)


def quantised(v: np.ndarray) -> np.ndarray:
    """floor(256 v) as whole numbers."""
    with np.errstate(over="ignore"):
        x = np.floor(SCALE * v.astype(np.float64))
    low, high = x < -(2.0**63), x >= 2.0**63
    out = np.where(low | high, 0.0, x).astype(np.int64)
    out[low], out[high] = _LONG.min, _LONG.max
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def packed(x: np.ndarray) -> pa.Array:
    """Each row's numbers as bytes of the narrowest type that holds them; equal rows, equal bytes."""
    width = np.select([np.all((x >= np.iinfo(t).min) & (x <= np.iinfo(t).max), axis=1) for t in ("i1", "i2", "i4")], [1, 2, 4], 8)
    size = width * x.shape[1]
    at = np.cumsum(size) - size
    data = np.zeros(int(size.sum()), np.uint8)
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        data[at[rows][:, None] + np.arange(w * x.shape[1])] = x[rows].astype(f"<i{w}").view(np.uint8)
    return pa.Array.from_buffers(pa.large_binary(), len(x), [None, pa.py_buffer(np.append(at, len(data)).astype(np.int64)), pa.py_buffer(data)]).cast(pa.binary())


def unpacked(column: pa.Array, d: int) -> np.ndarray:
    out = np.zeros((len(column), d), dtype=np.int64)
    rows = [x.as_py() for x in column]
    width = np.array([len(x) for x in rows]) // d
    for w in np.unique(width):
        at = np.flatnonzero(width == w)
        out[at] = np.frombuffer(b"".join(rows[i] for i in at), f"<i{w}").reshape(len(at), d)
    return out


def centred(x: np.ndarray, n: int, sums: list[int]) -> tuple[np.ndarray, bool]:
    """(n x - S, whether it fits): 64-bit numbers where all are below 62 bits, else Python's."""
    most = n * int(max(abs(int(x.min(initial=0))), abs(int(x.max(initial=0))))) + max(map(abs, sums), default=0)
    if most < 1 << 62:
        return n * x - np.array(sums, dtype=np.int64), True
    return n * x.astype(object) - np.array(sums, dtype=object), False


def usable(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """key, v (array of double) of the rows that take part."""
    v = F.col(vector).cast("array<double>")
    return rows.select(F.col(key).alias("key"), v.alias("v")).where((F.size("v") > 0) & F.forall("v", lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False))))


def distinct_vectors(good: DataFrame) -> DataFrame:
    """x: the different quantised vectors, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                yield pa.RecordBatch.from_arrays([packed(quantised(_matrix(b.column(0))))], ["x"])

    return good.select("v").mapInArrow(run, "x binary").distinct()


def sums_of(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    """(n, S), exact: the sums of high and low halves, put together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(d, np.int64), np.zeros(d, np.int64)
        for b in batches:
            x = unpacked(b.column(0), d)
            n, high, low = n + len(x), high + (x >> 32).sum(0), low + (x & 0xFFFFFFFF).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d)), pa.array(np.full(d, n)), pa.array(high), pa.array(low)], ["i", "n", "high", "low"])

    rows = fit.mapInArrow(run, "i long, n long, high long, low long").groupBy("i").agg(*(F.sum(c).alias(c) for c in ("n", "high", "low"))).orderBy("i").collect()
    return (rows[0]["n"] if rows else 0), [(r["high"] << 32) + r["low"] for r in rows]


def scatter(fit: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """The sum of (x - S / n) (x - S / n)^T, symmetric; each task's part leaves it as d rows."""
    d = len(sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for b in batches:
            y = centred(unpacked(b.column(0), d), n, sums)[0].astype(np.float64) / n
            total += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d)), pa.array(list(total), pa.list_(pa.float64()))], ["i", "v"])

    rows = fit.mapInArrow(run, "i long, v array<double>").groupBy("i").agg(F.array(*(F.sum(F.col("v")[j]) for j in range(d))).alias("v")).orderBy("i").collect()
    made = np.array([r["v"] for r in rows])
    return (made + made.T) / 2


def pivoted_cholesky(a: np.ndarray, rest: float = 1e-15) -> np.ndarray:
    """L with L L^T = a, its columns made in the order of the largest diagonal left; as many columns as a has rank.

    Rows stay in a's order: in the order of the pivots L is lower triangular.
    """
    d = len(a)
    left, factor = np.diag(a).copy(), np.zeros((d, d))
    free, most = np.ones(d, dtype=bool), left.max(initial=0.0)
    for k in range(d):
        p = int(np.argmax(np.where(free, left, -np.inf)))
        if left[p] <= rest * d * most:
            return factor[:, :k]
        free[p] = False
        root = np.sqrt(left[p])
        factor[p, k] = root
        factor[free, k] = (a[free, p] - factor[free, :k] @ factor[p, :k]) / root
        left[free] -= factor[free, k] ** 2
    return factor


def rounds(n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Every pair of n columns once, in rounds of pairs that do not touch: one column stands, the others go round."""
    circle = np.arange(n + n % 2)
    for _ in range(len(circle) - 1):
        p, q = circle[: len(circle) // 2], circle[: len(circle) // 2 - 1 : -1]
        real = (p < n) & (q < n)
        yield p[real], q[real]
        circle = np.concatenate([circle[:1], circle[-1:], circle[1:-1]])


def jacobi(factor: np.ndarray, most: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, falling, and components as columns) of factor factor^T, by rotating the factor's columns until they are orthogonal."""
    w = factor.copy()
    for _ in range(most):
        worst = 0.0
        for p, q in rounds(w.shape[1]):
            x, y = w[:, p], w[:, q]
            alpha, beta, gamma = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            size = np.sqrt(alpha * beta)
            turn = np.abs(gamma) > 1e-16 * size
            worst = max(worst, float(np.max(np.abs(gamma[turn]) / size[turn], initial=0.0)))
            with np.errstate(divide="ignore", invalid="ignore"):
                zeta = (beta - alpha) / (2 * gamma)
                t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.sqrt(1 + zeta * zeta))
            t = np.where(turn, t, 0.0)
            c = 1 / np.sqrt(1 + t * t)
            w[:, p], w[:, q] = c * x - c * t * y, c * t * x + c * y
        if worst < 1e-15:
            break
    value = (w * w).sum(0)
    order = np.argsort(-value, kind="stable")
    return value[order], w[:, order] / np.sqrt(value[order])


@dataclass
class Fit:
    """n, S and the components with variance of the vectors of one length."""

    n: int
    sums: list[int]
    values: np.ndarray
    components: np.ndarray
    trace: float

    def project(self, x: np.ndarray) -> tuple[np.ndarray, list[int | None]]:
        """(whitened coordinates, deviations) of quantised vectors."""
        y, small = centred(x, self.n, self.sums)
        made = (y.astype(np.float64) / self.n) @ self.components / np.sqrt(self.values)
        if small and int(np.abs(y).max(initial=0)) ** 2 * len(self.sums) <= _LONG.max:
            return made, (y * y).sum(1).tolist()
        exact = (y.astype(object) ** 2).sum(1)
        return made, [v if v <= _LONG.max else None for v in exact]


def fitted(good: DataFrame, d: int, k: int) -> tuple[Fit, DataFrame]:
    """The fit of the vectors of length d, and the stored table of different vectors."""
    if d > LONGEST:
        raise ValueError(f"vectors of {d} entries; the most is {LONGEST}")
    fit = stored(distinct_vectors(good), "distinct")
    n, sums = sums_of(fit, d)
    total = scatter(fit, n, sums) / max(n, 1)
    values, components = jacobi(pivoted_cholesky(total))
    kept = min(k, int((values > 1e-12 * values.max(initial=0.0)).sum()))
    return Fit(n, sums, values[:kept], components[:, :kept], float(np.trace(total))), fit


def identity_error(fit: DataFrame, found: Fit) -> float:
    """The largest entry of the whitened fit list's covariance minus the identity."""
    d, k = len(found.sums), len(found.values)
    if not k:
        return 0.0
    names = [f"w{i}" for i in range(k)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = found.project(unpacked(b.column(0), d))[0]
            yield pa.RecordBatch.from_arrays([pa.array(made[:, i]) for i in range(k)], names)

    rows = fit.mapInArrow(run, ", ".join(f"{c} double" for c in names))
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    # Spark's covariance is centred before it multiplies
    got = rows.agg(*(F.covar_pop(names[i], names[j]).alias(f"c{i}_{j}") for i, j in pairs)).first()
    return max((abs(got[f"c{i}_{j}"] - (i == j)) for i, j in pairs), default=0.0)


WHITENED = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def whitened(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """key, component, n, deviation, whitened, explained, identity_error: a row for each usable vector and component."""
    good = usable(rows, key, vector)
    kind = dict(good.dtypes)["key"]
    lengths = sorted(r[0] for r in good.select(F.size("v").alias("d")).distinct().collect())
    parts = [_whitened(good.where(F.size("v") == d), d, components, kind) for d in lengths]
    none = good.limit(0).selectExpr("key", *(f"cast(null as {x.split()[1]}) as {x.split()[0]}" for x in WHITENED.split(", ")))
    return functools.reduce(DataFrame.union, parts, none).withColumnRenamed("key", key)


def _whitened(good: DataFrame, d: int, components: int, kind: str) -> DataFrame:
    found, fit = fitted(good, d, components)
    k = len(found.values)
    error, share = identity_error(fit, found), found.values / found.trace if found.trace else found.values

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b) or not k:
                continue
            made, deviation = found.project(quantised(_matrix(b.column(1))))
            again = np.repeat(np.arange(len(b)), k)
            columns = [
                b.column(0).take(pa.array(again)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(b))), pa.array(np.full(len(again), found.n)),
                pa.array(deviation, pa.int64()).take(pa.array(again)), pa.array(made.reshape(-1)), pa.array(np.tile(share, len(b))), pa.array(np.full(len(again), error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["key", *(x.split()[0] for x in WHITENED.split(", "))])

    return good.mapInArrow(run, f"key {kind}, {WHITENED}")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four whitened coordinates of every embedding."""
    return whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
