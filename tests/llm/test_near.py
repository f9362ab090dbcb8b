"""Near-duplicate classes against brute force over the same shingles in plain Python."""

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from gridwright.llm import near


def multiset(text):
    words = (text or "").lower().split()
    n = near.SHINGLE
    return Counter(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))) if words else Counter()


def brute(rows):
    """Least doc_id of each row's component by all pairs that share a shingle."""
    sets = [multiset(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    inverted, same = defaultdict(set), {}
    for i, (s, (_, t)) in enumerate(zip(sets, rows, strict=True)):
        if (t or "") in same:
            parent[find(i)] = find(same[t or ""])
            continue
        same[t or ""] = i
        for k in s:
            inverted[k].add(i)
    for i in same.values():
        shared = Counter(j for k in sets[i] for j in inverted[k] if j < i)
        for j in shared:
            both = sum((sets[i] & sets[j]).values())
            if both / (sum(sets[i].values()) + sum(sets[j].values()) - both) >= near.SIMILARITY:
                parent[find(i)] = find(j)
    least = defaultdict(lambda: 1 << 62)
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least[find(i)], d)
    return {d: least[find(i)] for i, (d, _) in enumerate(rows)}


def test_elements_count_repeats():
    (_, _, row, element), = near.shingles(pa.array(["a b c d e a b c d e a b c d e", "x y", None, ""]))
    assert np.bincount(row, minlength=4).tolist() == [11, 1, 0, 0]
    assert len(np.unique(element)) == 12


def test_signature_agreement_estimates_weighted_similarity():
    rng = np.random.default_rng(3)
    base = rng.integers(1, 1 << 62, 400).astype(np.uint64)
    other = np.concatenate([base[:320], rng.integers(1, 1 << 62, 80).astype(np.uint64)])
    same = []
    for s in range(30):
        x, y = near.mix(base + np.uint64(s)), near.mix(other + np.uint64(s))
        sig = near.signatures(np.concatenate([x, y]), np.repeat([0, 1], 400), 2)
        same.append((sig[0] == sig[1]).mean())
    assert abs(np.mean(same) - 320 / 480) < 0.03


def test_classes_match_brute_force(spark, sf001):
    docs = spark.read.parquet(f"{sf001}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = {r.doc_id: r.class_id for r in near.op9_near_dedup(spark, sf001).collect()}
    assert got == brute(rows)


def test_edges_of_input(spark):
    text = " ".join(f"w{i}" for i in range(300))
    rows = [(1, None), (2, ""), (None, text), (3, text), (3, text), (4, text + " tail"), (5, "one two"), (6, "ONE  two"), (7, "x " * 5000), (8, " \n")]
    docs = spark.createDataFrame([(*r, "label") for r in rows], "doc_id long, text string, uid string")
    found, named = near.classes(docs)
    got = {(r.id, r.uid): r.class_id for r in found.join(named, "uid").collect()}
    by_id = {k[0]: v for k, v in got.items()}
    assert by_id[1] == by_id[2] == 1 and by_id[3] == by_id[4] == 3 and by_id[6] == 5 and by_id[8] == 8
    assert by_id[(1 << 63) - 1] == 3
    kept = near.deduped(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 5, 7, 8]
    empty = docs.limit(0)
    assert near.deduped(empty).count() == 0


def test_wide_groups_lose_no_link(spark, monkeypatch):
    """Texts that drift away from one another, in buckets too large to test pair by pair."""
    monkeypatch.setattr(near, "BLOCK", 16)
    rng = np.random.default_rng(8)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(120):
        words = list(base)
        for at in rng.choice(150, int(rng.integers(1, 12)), replace=False):
            words[at] = f"x{i}_{at}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found, named = near.classes(docs)
    got = {r.id: r.class_id for r in found.join(named, "uid").collect()}
    assert got == brute(rows)
    assert 1 < len(set(got.values())) < 120
