"""Containers: exact round trip, box walking, broken files."""

import hashlib

import struct
import zlib


from hypothesis import given, settings
from hypothesis import strategies as st

from gridwright.llm import media


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=20_000))
def test_round_trip(text):
    payload = media.padded(text)
    assert len(payload) % 64 == 0 and len(payload) > 0 and payload.rstrip(b"\0") == text.rstrip(b"\0") and len(payload) - len(text) <= 64
    box = media.mux(payload)
    found = media.index(box)
    assert media.read_payload(box, found) == payload
    assert found["codec"] == "raw " and found["duration"] == len(payload) // 64
    for a, n in zip(found["key_offsets"], found["key_lengths"], strict=True):
        assert box[a : a + n] in payload and n == 64


def test_nested_boxes_and_samples_of_many_sizes():
    sizes = [5, 9, 1, 30, 2]
    data = bytes(range(sum(sizes)))
    full = lambda kind, body: media._full(kind, body)
    ftyp, mdat = media._box(b"ftyp", b"isom"), media._box(b"mdat", data)
    at = len(ftyp) + 8
    table = media._box(
        b"stbl", full(b"stsd", struct.pack(">I", 1) + media._box(b"avc1", bytes(10))), full(b"stts", struct.pack(">5I", 2, 2, 10, 3, 20)), full(b"stss", struct.pack(">3I", 2, 1, 4)),
        full(b"stsc", struct.pack(">7I", 2, 1, 2, 1, 3, 1, 1)), full(b"stsz", struct.pack(">7I", 0, 5, *sizes)), full(b"co64", struct.pack(">IQQQ", 3, at, at + 14, at + 45)),
    )
    mdhd = full(b"mdhd", struct.pack(">IIIIHH", 0, 0, 1000, 80, 0, 0))
    moov = media._box(b"moov", media._box(b"trak", media._box(b"mdia", mdhd, media._box(b"minf", table))))
    found = media.index(ftyp + mdat + moov)
    assert (found["codec"], found["timescale"], found["duration"]) == ("avc1", 1000, 80)
    assert found["places"].tolist() == [at, at + 5, at + 14, at + 15, at + 45]
    assert list(zip(found["key_offsets"].tolist(), found["key_lengths"].tolist(), strict=True)) == [(at, 5), (at + 15, 30)]


def test_edges_of_input(spark):
    rows = [(1, None), (2, ""), (3, "a" * 64), (4, "é" * 5000), (4, "é" * 5000), (None, "x")]
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, media int")
    out = media.index_media(media.mux_texts(docs)).collect()
    assert len(out) == len(rows)
    by = {r.doc_id: r for r in out}
    for doc_id, text in rows:
        raw = (text or "").encode()
        want = raw + bytes((-len(raw)) % 64 if raw else 64)
        m = by[doc_id].media_index
        assert (m.payload_bytes, m.payload_sha256, m.tail_crc32, m.error) == (len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-64:]), None)
    assert by[1].media_index.feature == by[2].media_index.feature
    assert media.index_media(media.mux_texts(docs.limit(0))).count() == 0


def test_broken_containers_are_reported(spark):
    good = media.mux(media.padded(b"hello"))
    bad = [None, b"", b"abc", good[:-10], good.replace(b"moov", b"free"), b"\0\0\0\1mdat" + b"\xff" * 8]
    out = media.index_media(spark.createDataFrame([(i, b) for i, b in enumerate([*bad, good])], "doc_id int, media binary")).orderBy("doc_id").collect()
    assert all(r.media_index.error for r in out[:-1]) and out[-1].media_index.error is None and out[-1].media_index.codec == "raw "



def test_query_reads_every_document(spark, sf001):
    docs = {r.doc_id: r.text.encode() for r in spark.read.parquet(f"{sf001}/documents.parquet").collect()}
    out = media.op1_media_columns(spark, sf001).collect()
    assert {r.doc_id for r in out} == docs.keys() and len(out) == len(docs)
    for r in out:
        want = media.padded(docs[r.doc_id])
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(docs[r.doc_id]), len(want), hashlib.sha256(want).hexdigest())
        assert r.media_sha256 == hashlib.sha256(media.mux(want)).hexdigest()
