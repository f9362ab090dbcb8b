"""Suffix order and repeated substrings against brute force."""

import hashlib
import random
import tracemalloc
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridwright.llm import cover, suffix


@settings(max_examples=150, deadline=None)
@given(st.binary(min_size=1, max_size=80) | st.text("ab", min_size=1, max_size=120).map(str.encode), st.sampled_from([4, 9, 30, 400]))
def test_ranks_order_suffixes(data, need):
    rank = suffix.ranks(np.frombuffer(data, dtype=np.uint8).astype(np.int64) + 1, need)
    order = sorted(range(len(data)), key=lambda i: data[i:])
    least = 0
    for a, b in zip(order, order[1:], strict=False):
        if data[a : a + need] != data[b : b + need]:
            least = max(rank[i] for i in order[: order.index(b)])
        assert rank[b] > least


@pytest.mark.parametrize("need", [3, 7, 30])
def test_distributed_ranks_order_suffixes(spark, need):
    r = random.Random(need)
    texts = [bytes(r.choices(b"ab", k=r.randint(4, 60))) for _ in range(40)] + [b"a" * 50] * 3 + [b"ab" * 20] * 2
    frame = spark.createDataFrame([(i, [c + 1 for c in t]) for i, t in enumerate(texts)], "t long, s array<long>")
    rank = {x.t: x.r for x in cover.ranks(frame, need).collect()}
    groups = {}
    for t, text in enumerate(texts):
        assert len(rank[t]) == len(text)
        for i in range(len(text)):
            groups.setdefault(text[i : i + need], []).append(rank[t][i])
    order = sorted(groups)
    assert all(max(groups[a]) < min(groups[b]) for a, b in zip(order, order[1:], strict=False))


def test_distributed_repeats_match_brute_force(spark):
    r = random.Random(9)
    base = bytes(r.choices(range(256), k=60))
    texts = [bytes(r.choices(range(256), k=r.randint(0, 20))) + base[r.randint(0, 20) : r.randint(40, 60)] + bytes(r.choices(b"xy", k=r.randint(0, 30))) for _ in range(40)]
    texts = list({t for t in texts if len(t) >= 12})
    seen = Counter(t[i : i + 12] for t in texts for i in range(len(t) - 11))
    want = sorted((k, i) for k, t in enumerate(texts) for i in range(len(t) - 11) if seen[t[i : i + 12]] > 1)
    frame = spark.createDataFrame([(7, k, bytearray(t)) for k, t in enumerate(texts)], "hash long, c long, context binary")
    assert want and sorted((x.c, x.at) for x in cover.repeated(frame, 12).collect()) == want


def brute(rows):
    texts = [(d, (t or "").encode()) for d, t in rows]
    seen = Counter(t[i : i + 200] for _, t in texts for i in range(len(t) - 199))
    out = []
    for d, t in texts:
        gone = np.zeros(len(t) + 1, dtype=bool)
        for i in range(len(t) - 199):
            if seen[t[i : i + 200]] > 1:
                gone[i : i + 200] = True
        kept = bytes(c for c, g in zip(t, gone, strict=False) if not g)
        out.append((d, len(t), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def rows_of(frame):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in frame.collect()), key=str)


def test_the_table_matches_brute_force(spark, sf001):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf001}/documents.parquet").collect()]
    assert rows_of(suffix.op6_suffix_dedup(spark, sf001)) == brute(docs)


@pytest.mark.parametrize("heavy", [suffix.HEAVY, 1500])
def test_edges_of_input(spark, heavy):
    rng = np.random.default_rng(5)
    word = lambda n: "".join(rng.choice(list("abcdefgh é"), n))
    hot, tail = word(400), word(199)
    rows = [(1, None), (2, ""), (3, "a" * 1000), (4, "ab" * 300), (5, hot), (5, hot), (None, word(50) + hot), (6, hot[:150] + word(90)), (7, tail), (8, tail), (9, word(300) + hot[100:305] + word(250))]
    rows += [(100 + i, word(int(rng.integers(0, 90))) + hot + word(60)) for i in range(30)]
    frame = spark.createDataFrame([(*r, 0, "x") for r in rows], "doc_id long, text string, id int, body string")
    assert rows_of(suffix.dedup(frame, heavy)) == brute(rows)
    assert suffix.dedup(frame.limit(0)).count() == 0


def test_texts_that_agree_in_32_bits_are_told_apart(spark):
    r = random.Random(3)
    shared, alone = ("".join(r.choices("abcdefgh ", k=300)) for _ in range(2))
    for doc_id in (None, 7):
        some = [(doc_id, f"{shared}3534"), (doc_id, f"{alone}285418"), (1, shared)]
        frame = spark.createDataFrame(some, "doc_id long, text string")
        assert frame.select(F.hash("text")).distinct().count() == 2
        assert rows_of(suffix.dedup(frame)) == brute(some)


def test_long_texts_are_read_in_parts(monkeypatch):
    raw = np.frombuffer(np.random.default_rng(1).bytes(9_000_000), dtype=np.uint8)
    parts = list(suffix._long_slices(raw, np.array([0, len(raw)])))
    assert len(parts) == 3
    covered = sum(len(p[3]) - suffix.LENGTH + 1 for p in parts)
    assert covered == len(raw) - suffix.LENGTH + 1


def test_anchors_are_the_leftmost_least_grams_at_few_bytes_a_byte():
    r = np.random.default_rng(3)
    sizes = [0, 300, 199, 200, 0, 1, 900, 201, 63, 0]
    offsets, raw = np.cumsum([0, *sizes]), r.integers(97, 99, sum(sizes)).astype(np.uint8)
    prefix = suffix.prefix_hash(raw)
    expected = []
    for row, (lo, hi) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        for p in range(lo, hi - suffix.LENGTH + 1):
            grams = np.arange(p, p + suffix.SPAN)
            h = suffix.range_hash(prefix, grams, grams + suffix.GRAM)
            i = int(np.argmin(h >> np.uint64(24)))
            if expected and expected[-1][0] == row and expected[-1][4] == p + i - lo:
                expected[-1][3] = p - lo
            else:
                expected.append([row, int(h[i]), p - lo, p - lo, p + i - lo])
    assert [list(map(int, x)) for x in zip(*suffix.anchor_rows(raw, offsets), strict=True)] == expected
    # texts are hashed a piece at a time that stays in a core's cache
    raw, offsets = r.integers(0, 256, 1 << 22).astype(np.uint8), np.arange(0, (1 << 22) + 1, 1 << 12)
    suffix.anchor_rows(raw[: 1 << 20], offsets[:257])
    tracemalloc.start()
    found = sum(len(suffix.anchor_rows(part, own)[0]) for *_, part, own in suffix._long_slices(raw, offsets))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found > 1 << 15 and peak < 32_000_000
