"""Search against brute force, and the tree's own order."""

import numpy as np
import pytest

from gridwright.llm import ann


def brute(ids, x, queries, top):
    out = {}
    for q in queries:
        s = x @ x[ids.index(q)]
        order = sorted((i for i in range(len(ids)) if ids[i] != q), key=lambda i: (-s[i], ids[i]))[:top]
        out[q] = [(ids[i], s[i]) for i in order]
    return out


def by_query(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def test_recall_on_the_table(spark, sf01):
    rows = spark.read.parquet(f"{sf01}/embeddings.parquet").collect()
    ids, x = [r.vec_id for r in rows], np.array([r.embedding for r in rows], dtype=float)
    want = brute(ids, x, [i for i in ids if i % 20 == 0], 20)
    got = by_query(ann.op5_ann_search(spark, sf01).collect())
    assert got.keys() == want.keys()
    share = np.mean([len({a for a, _ in got[q]} & {a for a, _ in want[q]}) / len(want[q]) for q in want])
    assert share >= 0.9
    for q in want:
        scores = dict(zip(ids, x @ x[ids.index(q)], strict=True))
        assert all(abs(s - scores[i]) < 1e-12 for i, s in got[q])


@pytest.mark.parametrize("leaf", [20, 1000])
def test_copies_and_norms(spark, monkeypatch, leaf):
    monkeypatch.setattr(ann, "LEAF", leaf)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 6)) * rng.uniform(0.1, 5, size=(300, 1))
    x[40:140] = x[40]
    frame = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, cid int")
    got = by_query(ann.search(frame, lambda i: i % 20 == 0).collect())
    want = brute(list(range(300)), x, range(0, 300, 20), 20)
    assert [a for a, _ in got[60]] == [a for a, _ in want[60]]
    hits = [len({a for a, _ in got[q]} & {a for a, _ in want[q]}) / 20 for q in want]
    assert np.mean(hits) >= 0.9


def test_ties_of_different_vectors_go_to_smaller_ids(spark, monkeypatch):
    monkeypatch.setattr(ann, "LEAF", 20)
    monkeypatch.setattr(ann, "TARGET", 1.0)
    rng = np.random.default_rng(6)
    x = np.concatenate([np.ones((400, 1)), rng.integers(0, 2, size=(400, 9))], axis=1).astype(float)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = by_query(ann.search(frame, lambda i: i % 20 == 0).collect())
    assert got == brute(list(range(400)), x, range(0, 400, 20), 20)


def test_edges_of_input(spark):
    nan, one = float("nan"), [1.0, 0.0]
    rows = [(0, one), (0, one), (20, [0.5, 0.5]), (3, [0.0, 0.0]), (4, None), (5, [nan, 1.0]), (6, [None, 1.0]), (7, one), (8, [1.0]), (None, one), (40, [])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = by_query(ann.search(frame, lambda i: i % 20 == 0).collect())
    assert {q: [a for a, _ in v] for q, v in got.items()} == {0: [7, 20], 20: [0, 7]}
    assert ann.search(frame.limit(0), lambda i: i % 20 == 0).count() == 0


def test_walk_lists_every_leaf_once_nearest_first():
    x = np.random.default_rng(2).normal(size=(500, 5))
    tree = ann.Tree(x, 40, float((x**2).sum(1).max()))
    order = list(tree.walk(x[0]))
    assert sorted(order) == list(range(tree.leaves))
    assert set(tree.assign(x)) <= set(order)


def test_hot_vectors_are_joined_apart(spark, monkeypatch):
    """One long vector is in every list and many queries are one vector: the same result when both are dealt to many tasks."""
    from gridwright.llm import skew

    monkeypatch.setattr(ann, "LEAF", 20)
    rng = np.random.default_rng(9)
    x = rng.normal(size=(240, 5))
    x[7] = 40
    x[100:200] = x[100]
    frame = spark.createDataFrame([(i, np.abs(v).tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    cold = by_query(ann.search(frame, lambda i: i % 20 == 0).collect())
    monkeypatch.setattr(skew, "HOT", 1)
    monkeypatch.setattr(skew, "HOT_SHARE", 1000)
    assert by_query(ann.search(frame, lambda i: i % 20 == 0).collect()) == cold and all(v[0][0] == 7 for v in cold.values())
