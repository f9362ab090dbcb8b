"""Alignment against sets of ends, with the tokenizer's own file."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from gridwright.llm import align


@pytest.fixture(scope="module")
def tools():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(kept))}
    return a, {i: bytes(letters[c] for c in w) for w, i in a.get_vocab().items() if i < 50_256}, align.Encoders()


def plain(tools, rows):
    """The contract's rows, text by text."""
    a_tok, a_bytes, e = tools
    docs, links = [], Counter()
    for key, text in rows:
        a = a_tok.encode(" " + text, add_special_tokens=False).ids if text else []
        b = e.second.encode(text) if text else []
        whole = (" " + (text or "")).encode()
        if b"".join(a_bytes[i] for i in a) != whole or b"".join(e.bytes_b[i] for i in b) != whole:
            a, b = [], []
        ends = [np.cumsum([0] + [len(t[i]) for i in ids])[1:].tolist() for ids, t in ((a, a_bytes), (b, e.bytes_b))]
        groups, own, i, j = [], [], 0, 0
        for cut in sorted(set(ends[0]) & set(ends[1])):
            x, y = ends[0].index(cut) + 1, ends[1].index(cut) + 1
            groups.append((a[i:x], b[j:y]))
            own.append((a[x - 1], b[y - 1]))
            i, j = x, y
        links.update(own)
        docs.append((key, len(a), len(b), groups, own))
    most = {}
    for (_, b), n in links.items():
        most[b] = max(most.get(b, 0), n)
    for key, n_a, n_b, groups, own in docs:
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        yield key, n_a, n_b, len(groups), len(own), sum(links[x] == most[x[1]] for x in own), sum(links[x] for x in own), hashlib.sha256(text.encode()).hexdigest() if text else ""


def result(spark, docs):
    digests = align.digested(docs)
    return sorted((tuple(r) for r in align.scored(digests, align.counted(digests)).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()), key=str)


def test_the_table(spark, sf001, tools):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf001}/documents.parquet").collect()]
    got = sorted((tuple(r) for r in align.op13_token_alignment(spark, sf001).collect()), key=str)
    assert got == sorted(plain(tools, rows), key=str)


EDGES = [None, "", " ", "   ", "\n", "a", "Hello,  world!\t\n", "<|endoftext|> <s></s><unk>", "e\u0301 ﬁ ① Ａ", "日本語のテキスト", "🙂🙂🏽", "\x00\x01 nul", "a" * 5000, "ab1" * 9000, "'ll don't 12345", "▁already▁there", "x \u00a0 y", "the end " * 300, "the end " * 300, "\u0378 unassigned"]


def test_edges_of_input(spark, tools):
    rows = [(i, t) for i, t in enumerate(EDGES)] + [(None, "a b"), (None, "a b"), (3, "other")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_a int")
    assert result(spark, docs) == sorted(plain(tools, rows), key=str)
    assert result(spark, docs.limit(0)) == []
    assert result(spark, docs.where("text is null")) == [(0, 0, 0, 0, 0, 0, 0, "")]


@pytest.mark.parametrize("seed", range(40))
def test_cuts_of_random_ends(seed):
    rng = np.random.default_rng(seed)
    a, b, bounds, top = [], [], [], 0
    for _ in range(int(rng.integers(1, 6))):
        n = int(rng.integers(1, 3000))
        ends = [np.unique(np.append(rng.integers(1, n + 1, int(rng.integers(0, n))), n)) + top for _ in "ab"]
        bounds.append((len(a), len(a) + len(ends[0]), len(b), len(b) + len(ends[1])))
        a, b, top = [*a, *ends[0]], [*b, *ends[1]], top + n
    a, b = np.array(a), np.array(b)
    at, b_at = align.shared_cuts(a, b, *(np.array(x) for x in zip(*bounds, strict=True)))
    both = np.intersect1d(a, b)
    assert (a[at] == both).all() and (b[b_at] == both).all() and len(at) == len(both)


def test_arrays_of_the_operator(spark, tools):
    docs = spark.createDataFrame([(1, "Hello,  world!"), (2, None), (3, "日本語")], "doc_id long, text string")
    a_tok, a_bytes, e = tools
    for r in align.aligned(docs).collect():
        cut = [([a_bytes[i] for i in r.a_ids[x:y]], [e.bytes_b[i] for i in r.b_ids[z:w]]) for (x, y), (z, w) in zip(zip([0, *r.a_cuts], r.a_cuts), zip([0, *r.b_cuts], r.b_cuts))]
        assert all(b"".join(a) == b"".join(b) != b"" for a, b in cut) and (r.doc_id == 2) == (cut == [])
        assert not cut or (r.a_cuts[-1], r.b_cuts[-1]) == (len(r.a_ids), len(r.b_ids))


def test_links_are_bounded_by_the_vocabularies(tools):
    _, _, e = tools
    ids = [{t: i for i, t in enumerate(x)} for x in (e.bytes_a, e.bytes_b)]
    pairs = {(i, ids[1][t[k:]]) for t, i in ids[0].items() for k in range(len(t)) if t[k:] in ids[1]} | {(ids[0][t[k:]], i) for t, i in ids[1].items() for k in range(len(t)) if t[k:] in ids[0]}
    assert len(pairs) < 500_000 and max(a * 32_000 + b for a, b in pairs) < 1 << 31
