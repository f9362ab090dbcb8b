"""Bayesian shrinkage by Cholesky against plain loops over groups, and block matching against sorted distances."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridwright.operators import denoise, graph
from gridwright.sources.cells import KEY


def one_pass(noisy, pilot, levels, stds, step, radius, k, tau):
    """image by loops: (h, w, channels) noisy and pilot (or None)."""
    h, w, n = noisy.shape
    basis = denoise._basis()
    total, count = np.zeros(noisy.shape), np.zeros((h, w))
    src = noisy if pilot is None else pilot
    for y in range(0, h - 3, step):
        for x in range(0, w - 3, step):
            found = []
            for i in range(max(0, y - radius), min(h - 4, y + radius) + 1):
                for j in range(max(0, x - radius), min(w - 4, x + radius) + 1):
                    d = ((src[y : y + 4, x : x + 4] - src[i : i + 4, j : j + 4]) ** 2).sum()
                    found.append((-1 if (i, j) == (y, x) else d, i, j, d))
            found.sort()
            limit = max(tau, found[:32][-1][3])
            found = [f for f in found if f[3] <= limit][:k]
            if len(found) < denoise.LEAST_GROUP:
                continue
            for c in range(n):
                p = np.array([noisy[i : i + 4, j : j + 4, c].ravel() for _, i, j, _ in found])
                q = p if pilot is None else np.array([pilot[i : i + 4, j : j + 4, c].ravel() for _, i, j, _ in found])
                mean = p.mean(0)
                std = np.array([np.interp(p.mean(), levels, stds[:, f]) for f in range(16)])
                noise = basis.T @ np.diag(std**2) @ basis
                cov = (q - mean).T @ (q - mean) / (len(p) - 1)
                if pilot is None:
                    diff = cov - noise
                    out = np.repeat(mean[None], len(p), axis=0)
                    if np.trace(diff) > 0:
                        np.fill_diagonal(diff, np.maximum(np.diag(diff), 0))
                        out = mean + (p - mean) @ (diff @ np.linalg.inv(cov + 1e-3 * np.eye(16))).T
                else:
                    out = mean + (p - mean) @ (cov @ np.linalg.inv(cov + noise + 1e-3 * np.eye(16))).T
                for (_, i, j, _), v in zip(found, out, strict=True):
                    total[i : i + 4, j : j + 4, c] += v.reshape(4, 4)
            for _, i, j, _ in found:
                count[i : i + 4, j : j + 4] += 1
    return np.where(count[..., None] > 0, total / np.maximum(count, 1)[..., None], noisy)


@pytest.mark.parametrize("size", [8, 32])
def test_both_passes_equal_loops(spark, size):
    rng = np.random.default_rng(11)
    clean = np.stack([np.add.outer(np.arange(19) * 4.0, np.arange(23) * a) for a in (3, -2)], axis=-1) + 60
    noisy = np.round(clean + rng.normal(0, 9, clean.shape), 3)
    levels, stds = np.array([20.0, 120.0]), np.linspace(5, 9, 32).reshape(2, 16)
    df = spark.createDataFrame([(3, y, x, *map(float, noisy[y, x])) for y in range(19) for x in range(23)], "image_id long, y long, x long, a double, b double").repartition(3)
    table = spark.createDataFrame([(3, levels.tolist(), levels.tolist(), stds.tolist(), stds.tolist())], "image_id long, levels_a array<double>, levels_b array<double>, stds_a array<array<double>>, stds_b array<array<double>>")

    def image(out):
        got = np.zeros(noisy.shape)
        for r in out.collect():
            got[r.y, r.x] = (r.a, r.b)
        return got

    first = denoise.bayes_shrink(df, ("a", "b"), table, step=3, radius=4, k=50, size=size)
    want = one_pass(noisy, None, levels, stds, 3, 4, 50, denoise.ALIKE[0])
    got = image(first)
    assert np.abs(got - want).max() < 1e-8 and np.abs(want - clean).mean() < np.abs(noisy - clean).mean()
    both = df.join(first.select(*KEY, F.col("a").alias("pa"), F.col("b").alias("pb")), KEY)
    second = denoise.bayes_shrink(both, ("a", "b"), table, step=3, radius=4, k=50, pilot=("pa", "pb"), size=size)
    assert np.abs(image(second) - one_pass(noisy, got, levels, stds, 3, 4, 50, denoise.ALIKE[1])).max() < 1e-7


def test_factor_and_solve():
    rng = np.random.default_rng(1)
    m = rng.normal(size=(1300, 16, 20))
    a, b = m @ m.swapaxes(1, 2) / 20 + 1e-3 * np.eye(16), rng.normal(size=(1300, 16, 5))
    x, good = denoise.factor_solve(a, b)
    assert good.all() and np.allclose(x, np.linalg.solve(a, b), rtol=1e-9, atol=1e-9)
    a[7] = np.diag([1.0] * 15 + [-1.0])
    a[8] = 0
    assert denoise.factor_solve(a, b)[1].tolist() == [i not in (7, 8) for i in range(1300)]


def test_groups_without_signal_become_their_mean():
    rng = np.random.default_rng(3)
    noisy = rng.normal(100, 1, (2, 1, 20, 16))
    noise = np.broadcast_to(400 * np.eye(16), (2, 1, 16, 16))
    there = np.ones((2, 20), dtype=bool)
    assert np.allclose(denoise.shrunk_by_difference(noisy, None, there, noise), noisy.mean(2, keepdims=True))


@pytest.mark.parametrize(("k", "tau"), [(512, 0.0), (512, 900.0), (10, 900.0)])
def test_matches_equal_sorting(k, tau):
    rng = np.random.default_rng(5)
    d = rng.integers(0, 60, (40, 81)).astype(float) ** 2
    d[:, 40], d[rng.random(d.shape) < 0.3] = 0, np.inf
    d[:, 40] = 0
    d[0, :40] = d[0, 41:] = np.inf
    row, place, nth = graph.ranked_matches(d, k, tau, 32)
    for i in range(len(d)):
        order = sorted(np.flatnonzero(np.isfinite(d[i])).tolist(), key=lambda j: (j != 40, d[i, j], j))
        limit = max(tau, d[i, order[:32]].max())
        want = [j for j in order if d[i, j] <= limit][:k]
        assert place[row == i].tolist() == want and nth[row == i].tolist() == list(range(len(want)))
