"""Whitening against NumPy's eigenvectors and Python's whole numbers."""

import math

import numpy as np
import pytest

from gridwright.llm import whiten


def brute(vectors, k=4):
    """{vector index: (n, deviation, whitened up to sign, explained)}"""
    x = [[math.floor(256 * float(c)) for c in v] for v in vectors]
    fit = np.array(sorted({tuple(r) for r in x}), dtype=object)
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    y = np.array(fit - np.array([s / n for s in sums]), dtype=float)
    value, vec = np.linalg.eigh(y.T @ y / n)
    value, vec = value[::-1], vec[:, ::-1]
    k = min(k, int((value > 1e-12 * value[0]).sum()))
    out = {}
    for i, r in enumerate(x):
        dev = sum((n * a - s) ** 2 for a, s in zip(r, sums, strict=True))
        out[i] = (n, dev if dev < 1 << 63 else None, [abs((np.array(r, float) - np.array([s / n for s in sums])) @ vec[:, j]) / math.sqrt(value[j]) for j in range(k)], [value[j] / value.sum() for j in range(k)])
    return out


def compared(got, vectors, ids):
    want = brute([vectors[i] for i in ids])
    by = {}
    for r in got:
        by.setdefault(r.vec_id, []).append(r)
    assert set(by) == set(ids)
    for place, i in enumerate(ids):
        n, dev, white, share = want[place]
        rows = sorted(by[i], key=lambda r: r.component)
        assert [r.component for r in rows] == list(range(1, len(white) + 1))
        for r, w, s in zip(rows, white, share, strict=True):
            assert (r.n, r.deviation) == (n, dev) and abs(abs(r.whitened) - w) < 1e-9 and abs(r.explained - s) < 1e-12 and r.identity_error < 1e-9


def test_the_table(spark, sf001):
    rows = {r.vec_id: r.embedding for r in spark.read.parquet(f"{sf001}/embeddings.parquet").collect()}
    ok = [i for i, v in rows.items() if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    compared(whiten.op12_whitening(spark, sf001).collect(), rows, ok)


def test_signs_are_the_same_for_all_rows(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 6)) * [3, 2, 1, 0.5, 0.2, 0.1]
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = whiten.whitened(frame).collect()
    q = np.floor(256 * x)
    value, vec = np.linalg.eigh(np.cov(q.T, bias=True))
    for j in range(4):
        w = np.array([r.whitened for r in sorted(got, key=lambda r: r.vec_id) if r.component == j + 1])
        true = (q - q.mean(0)) @ vec[:, -1 - j] / np.sqrt(value[-1 - j])
        assert min(np.abs(w - true).max(), np.abs(w + true).max()) < 1e-9


def test_edges_of_input(spark):
    nan = float("nan")
    rows = [(1, [0.5, 0.25]), (1, [0.5, 0.25]), (2, [-0.001, 1.0]), (3, None), (4, [nan, 1.0]), (5, [None, 1.0]), (6, [float("inf"), 0.0]), (7, []), (None, [0.0, -0.0]), (8, [1.0, 2.0, 3.0]), (9, [0.1, 7.7])]
    frame = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<double>, n int")
    got = whiten.whitened(frame).collect()
    # the single vector of three entries has no variance
    assert sorted((r.vec_id, r.component) for r in got if r.vec_id is not None) == [(1, 1), (1, 1), (1, 2), (1, 2), (2, 1), (2, 2), (9, 1), (9, 2)]
    vectors = {1: [0.5, 0.25], 2: [-0.001, 1.0], -1: [0.0, -0.0], 9: [0.1, 7.7]}
    once = {(r.vec_id, r.component): r for r in got}
    compared([r if r.vec_id is not None else type(r)(**{**r.asDict(), "vec_id": -1}) for r in once.values()], vectors, [1, 2, -1, 9])
    assert whiten.whitened(frame.limit(0)).collect() == []
    assert whiten.whitened(frame.where("vec_id = 8")).collect() == []


def test_large_entries_are_exact_or_null(spark):
    rows = [(1, [1e300, 1.0]), (2, [-1e300, 2.0]), (3, [3.0, 3e9])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert {r.deviation for r in whiten.whitened(frame).collect()} == {None}
    rows = [(i, [1e4 + i, -2.0 * i * i, 9.0 * (i % 7)]) for i in range(40)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    compared(whiten.whitened(frame).collect(), dict(rows), [i for i, _ in rows])


@pytest.mark.parametrize(("rows", "d", "rank"), [(300, 20, 20), (5, 12, 4), (50, 1, 1), (40, 33, 33)])
def test_factor_and_rotations(rows, d, rank):
    x = np.random.default_rng(d).normal(size=(rows, d)) * 10.0 ** np.linspace(0, -4, d)
    y = x - x.mean(0)
    a = y.T @ y / rows
    factor = whiten.pivoted_cholesky(a)
    assert factor.shape == (d, rank) and np.allclose(factor @ factor.T, a, rtol=0, atol=1e-13 * np.trace(a))
    order = np.argsort([np.flatnonzero(factor[i])[-1] for i in range(d)] if rank == d else np.zeros(d), kind="stable")
    assert rank < d or np.allclose(np.triu(factor[order], 1), 0)
    value, vec = whiten.jacobi(factor)
    true = np.linalg.svd(y, compute_uv=False)[:rank] ** 2 / rows
    # small eigenvalues keep their digits
    assert np.allclose(value, true, rtol=1e-6) and np.allclose(value[: rank // 2 + 1], true[: rank // 2 + 1], rtol=1e-9)
    assert np.allclose(vec.T @ vec, np.eye(rank), atol=1e-12)


def test_rounds_meet_every_pair_once():
    for n in (1, 2, 3, 8, 13):
        seen = [tuple(sorted(x)) for p, q in whiten.rounds(n) for x in zip(p.tolist(), q.tolist(), strict=True)]
        assert sorted(seen) == [(i, j) for i in range(n) for j in range(i + 1, n)]
        assert all(len({*p.tolist(), *q.tolist()}) == 2 * len(p) for p, q in whiten.rounds(n))


def test_packing_is_exact():
    x = np.array([[1, -128, 127], [128, 0, 0], [-40_000, 1, 2], [1 << 40, 0, -1], [0, 0, 0]], dtype=np.int64)
    assert (whiten.unpacked(whiten.packed(x), 3) == x).all()
    assert [len(v.as_py()) for v in whiten.packed(x)] == [3, 6, 12, 24, 3]
