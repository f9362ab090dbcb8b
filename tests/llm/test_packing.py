"""Token ids against the tokenizer itself, and packings against the contract."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from gridwright.llm import packing
from gridwright.llm.tokens import Encoder


@pytest.fixture(scope="module")
def whole():
    t = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    t.encode_special_tokens = True
    return t


ENCODER = Encoder(packing.VOCABULARY)


def split(flat, counts):
    stops = np.cumsum(counts)
    return [flat[a:b].tolist() for a, b in zip(np.append(0, stops[:-1]), stops, strict=True)] if len(counts) else []


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("abcdrstvelmABCÉéßÀÿ'''!!# \n\t\x1c\x0012345") | st.characters(exclude_categories=["Cs"]), max_size=40), max_size=6))
def test_ids_are_the_tokenizers_own(texts):
    t = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    t.encode_special_tokens = True
    assert split(*ENCODER.ids(pa.array(texts, pa.string()))) == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def verify(rows, docs, whole):
    """Every id in exactly one piece, sequences gapless, at most 2048 long; returns the padding."""
    parts, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        parts[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for doc_id, text in docs.items():
        ids = np.array(whole.encode(text or "", add_special_tokens=False).ids + [1], dtype="<u4")
        at = 0
        for r in sorted(parts[doc_id], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    pad = 0
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= 2048
        pad += 0 if at & (at - 1) == 0 else 2048 - at
    return pad


def test_documents_are_packed_whole(spark, sf001, whole):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf001}/documents.parquet").collect()}
    assert verify(packing.op4_packing(spark, sf001).collect(), docs, whole) == 0


def test_edges_of_input(spark, whole):
    docs = {1: None, 2: "", 3: "word " * 9000, 4: "it's 2 o'clock, we'll", 5: "日本語 text"}
    frame = spark.createDataFrame([(k, v, 0) for k, v in docs.items()], "doc_id long, text string, start int").repartition(2)
    assert verify(packing.pack(frame).collect(), docs, whole) == 0
    same = spark.createDataFrame([(None, "a b")] * 3, "doc_id long, text string")
    assert sum(r.length for r in packing.pack(same).collect()) == 9
    assert packing.pack(frame.limit(0)).count() == 0


def test_step_groups_hold_a_budget_and_level_costs():
    lengths = [2048] * 36 + [1024] * 16
    costs = [n * n for n in lengths]
    groups = packing.step_groups(costs, lengths, last=True)
    tokens, cost = defaultdict(int), defaultdict(int)
    for g, n, c in zip(groups, lengths, costs, strict=True):
        tokens[g] += n
        cost[g] += c
    assert sorted(tokens.values())[1:] == [packing.STEP_TOKENS] * 2 and len(tokens) == 3
    full = [cost[g] for g in tokens if tokens[g] == packing.STEP_TOKENS]
    assert max(full) - min(full) <= 2048**2
    waits = packing.step_groups(costs, lengths)
    assert [g < 0 for g in waits] == [g == 2 for g in groups]


def test_step_groups_are_full_but_for_the_last_of_a_partition(spark, sf01):
    docs = spark.read.parquet(f"{sf01}/documents.parquet").repartition(2, "doc_id")
    tokens = defaultdict(int)
    for r in packing.pack(docs).collect():
        tokens[r.step_group] += r.length
    short = [g for g, n in tokens.items() if n != packing.STEP_TOKENS]
    assert len(tokens) > 12 and len({g >> 40 for g in short}) == len(short) <= 2 and max(tokens.values()) == packing.STEP_TOKENS
