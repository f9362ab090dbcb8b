"""Cross-tokenizer alignment: which tokens of two vocabularies cover the same bytes of a text.

Both tokenizers cut the same bytes. Offsets where tokens of both end are shared cuts, and between two neighbouring
shared cuts lies a group. They are found by divide and conquer, many texts at once: an interval of tokens looks, by bisect,
for a shared end near its middle, in rings of doubling width; it is split there and both halves go on; an interval
without a shared end is a group.

Tokens that end together are linked. One of the two then is an ending of the other, so the number of different linked id
pairs is bounded by the vocabularies (each token has no more endings than bytes: some 500,000 here), whatever the
corpus. Their counts are gathered by one aggregation with map-side partials and sent to all tasks. Texts are encoded once, and
neither texts nor links are shuffled.

Cases: a null or empty text, or one whose tokens' bytes are not space + text (a normaliser changed it), has no tokens:
zeros and an empty digest; special tokens' strings are plain text; long texts are encoded whole; repeated rows count as often as they are there, and come
back as they are, null ids too; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import stored

FIRST, SECOND = "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"
#: Bytes of text that are aligned together; a longer text is alone.
SLICE = 1 << 20


class Encoders:
    """Ids and token bytes of both vocabularies. The first file has the ranks of byte_bpe_50k.json, which encodes five times slower."""

    def __init__(self, first: str = FIRST, second: str = SECOND) -> None:
        import public_tokenizers
        import sentencepiece
        import tiktoken

        with open(public_tokenizers.path(first), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.first = tiktoken.Encoding("first", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.second = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(second))
        self.bytes_a = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.bytes_a[i] = token
        piece = self.second.id_to_piece
        self.bytes_b = [bytes([int(piece(i)[3:5], 16)]) if self.second.is_byte(i) else piece(i).replace("▁", " ").encode() for i in range(self.second.get_piece_size())]
        self.size_a, self.size_b = (np.array([len(x) for x in t], dtype=np.int64) for t in (self.bytes_a, self.bytes_b))

    def ids(self, text: str) -> tuple[list[int], list[int]]:
        """Both id lists; empty where the bytes are not those of space + text."""
        if not text:
            return [], []
        whole = " " + text
        a, b, want = self.first.encode_ordinary(whole), self.second.encode(text), whole.encode()
        if b"".join(map(self.bytes_a.__getitem__, a)) != want or b"".join(map(self.bytes_b.__getitem__, b)) != want:
            return [], []
        return a, b


def _ranges(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, value) of all values of the ranges [start, stop)."""
    size = np.maximum(stop - start, 0)
    owner = np.repeat(np.arange(len(start)), size)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size) + start[owner]


def shared_cuts(a: np.ndarray, b: np.ndarray, lo: np.ndarray, hi: np.ndarray, b_lo: np.ndarray, b_hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places in a, places in b) of the ends that both have, by divide and conquer.

    a, b: rising ends. The intervals [lo, hi) of a and [b_lo, b_hi) of b cover the same bytes, so their last ends are shared.
    """
    some = hi > lo
    lo, hi, b_lo, b_hi = (x[some] for x in (lo, hi, b_lo, b_hi))
    cuts_a, cuts_b = [hi - 1], [b_hi - 1]
    near = np.zeros(len(lo), dtype=np.int64)  # how far from the middle has been looked
    while True:
        # the last end is known to be shared: an interval of one token has no other
        open_ = (hi - lo > 1) & (b_hi - b_lo > 1)
        middle = lo + (hi - lo - 1) // 2
        open_ &= near <= np.maximum(middle - lo, hi - 2 - middle)
        if not open_.any():
            break
        lo, hi, b_lo, b_hi, near, middle = (x[open_] for x in (lo, hi, b_lo, b_hi, near, middle))
        far = np.maximum(2 * near, near + 1)
        left = _ranges(np.maximum(lo, middle - far + 1), middle - near + 1)
        right = _ranges(middle + np.maximum(near, 1), np.minimum(hi - 1, middle + far))
        owner, at = np.concatenate([left[0], right[0]]), np.concatenate([left[1], right[1]])
        there = np.searchsorted(b, a[at])
        hit = np.flatnonzero(b[np.minimum(there, len(b) - 1)] == a[at])
        hit = hit[np.lexsort((np.abs(at[hit] - middle[owner[hit]]), owner[hit]))]
        hit = hit[np.append(True, owner[hit][1:] != owner[hit][:-1])] if len(hit) else hit
        found, cut, b_cut = owner[hit], at[hit], there[hit]
        cuts_a.append(cut)
        cuts_b.append(b_cut)
        rest = np.ones(len(lo), dtype=bool)
        rest[found] = False
        zero = np.zeros(len(found), dtype=np.int64)
        lo, hi, b_lo, b_hi, near = (
            np.concatenate(x)
            for x in ((lo[rest], lo[found], cut + 1), (hi[rest], cut + 1, hi[found]), (b_lo[rest], b_lo[found], b_cut + 1), (b_hi[rest], b_cut + 1, b_hi[found]), (far[rest], zero, zero))
        )
    order = np.argsort(at := np.concatenate(cuts_a), kind="stable")
    return at[order], np.concatenate(cuts_b)[order]


ALIGNED = "key {kind}, a_ids array<int>, b_ids array<int>, a_cuts array<int>, b_cuts array<int>"


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(values.astype(np.int32)))


Batches = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def _aligning(first: str, second: str) -> Batches:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders = Encoders(first, second)
        for batch in batches:
            start, rows, held = 0, [], 0
            for i, x in enumerate(batch.column(1)):
                text = x.as_py() or ""
                rows.append(encoders.ids(text))
                held += len(text)
                if held >= SLICE or i == len(batch) - 1:
                    n_a, n_b = (np.array([len(r[j]) for r in rows], dtype=np.int64) for j in (0, 1))
                    ids = [np.fromiter((t for r in rows for t in r[j]), dtype=np.int64, count=int(n.sum())) for j, n in ((0, n_a), (1, n_b))]
                    # texts lie back to back: their last ends are shared, as both vocabularies cover the same bytes
                    stop_a, stop_b = np.cumsum(n_a), np.cumsum(n_b)
                    at, b_at = shared_cuts(np.cumsum(encoders.size_a[ids[0]]), np.cumsum(encoders.size_b[ids[1]]), stop_a - n_a, stop_a, stop_b - n_b, stop_b)
                    row = np.searchsorted(stop_a, at, side="right")
                    cuts = np.bincount(row, minlength=len(rows))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(start, len(rows)), _lists(ids[0], n_a), _lists(ids[1], n_b), _lists(at + 1 - (stop_a - n_a)[row], cuts), _lists(b_at + 1 - (stop_b - n_b)[row], cuts)],
                        ["key", "a_ids", "b_ids", "a_cuts", "b_cuts"],
                    )
                    start, rows, held = i + 1, [], 0

    return run


def _parts(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, str]:
    part = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return part, dict(part.dtypes)["key"]


def aligned(docs: DataFrame, key: str = "doc_id", text: str = "text", first: str = FIRST, second: str = SECOND) -> DataFrame:
    """key, a_ids, b_ids, a_cuts, b_cuts of each row: token ids, and at each shared cut the number of tokens before it."""
    part, kind = _parts(docs, key, text)
    return part.mapInArrow(_aligning(first, second), ALIGNED.format(kind=kind)).withColumnRenamed("key", key)


def _digits(n: int) -> np.ndarray:
    """The decimal digits of 0 .. n - 1, left in rows of zero bytes, with room for one byte more."""
    text = np.arange(n).astype(bytes)
    return np.concatenate([text.view(np.uint8).reshape(n, -1), np.zeros((n, 1), np.uint8)], axis=1)


def _group_texts(a: np.ndarray, b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray, digits: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, length of each token with its mark) of ``a1,a2|b1;...`` over many texts. cut_*: tokens up to each cut; last: whether a text ends there."""
    group_a, group_b = (np.searchsorted(c, np.arange(len(t)), side="right") for t, c in ((a, cut_a), (b, cut_b)))
    # an a token stands behind the b tokens of earlier groups, a b token behind the a tokens of its own too
    at_a = np.arange(len(a)) + np.append(0, cut_b)[group_a]
    at_b = np.arange(len(b)) + cut_a[group_b]
    ids, mark = np.empty(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
    ids[at_a], ids[at_b] = a, b
    mark[at_a[cut_a - 1]] = ord("|")
    mark[at_b[cut_b - 1]] = np.where(last, 0, ord(";"))
    made = digits[ids]
    size = np.count_nonzero(made, axis=1)
    made[np.arange(len(ids)), size] = mark
    return made[made != 0], size + (mark != 0)


DIGESTED = "key {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<int>, times array<int>"


def _digesting(size_b: int) -> Batches:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digits = None
        for batch in batches:
            a, b, cut_a, cut_b = (batch.column(i).flatten().to_numpy().astype(np.int64) for i in range(1, 5))
            n_a, n_b, n = (batch.column(i).value_lengths().to_numpy().astype(np.int64) for i in (1, 2, 3))
            top = max(a.max(initial=0), b.max(initial=0)) + 1
            digits = _digits(int(top)) if digits is None or len(digits) < top else digits
            row, stop = np.repeat(np.arange(len(n)), n), np.cumsum(n)
            cut_a, cut_b = cut_a + (np.cumsum(n_a) - n_a)[row], cut_b + (np.cumsum(n_b) - n_b)[row]
            last = np.zeros(len(cut_a), dtype=bool)
            last[stop[n > 0] - 1] = True
            text, size = _group_texts(a, b, cut_a, cut_b, digits, last)
            ends = np.append(0, np.cumsum(size))[np.cumsum(n_a + n_b)]
            view = memoryview(text)
            sha = [hashlib.sha256(view[x:y]).hexdigest() if y > x else "" for x, y in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
            links, times = np.unique(row * (1 << 32) + a[cut_a - 1] * size_b + b[cut_b - 1], return_counts=True)
            kinds = np.bincount(links >> 32, minlength=len(n))
            long = lambda x: pa.array(x, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), long(n_a), long(n_b), long(n), long(n), pa.array(sha, pa.string()), _lists(links & 0xFFFFFFFF, kinds), _lists(times, kinds)], [x.split()[0] for x in DIGESTED.split(", ")])

    return run


def digested(docs: DataFrame, key: str = "doc_id", text: str = "text", first: str = FIRST, second: str = SECOND, size_b: int = 32_000) -> DataFrame:
    """aligned() with its arrays boiled down, slice by slice in one worker: key, n_a, n_b, n_groups, n_links, groups_sha256 and
    the row's different links (a id * size_b + b id) with how often it has them."""
    part, kind = _parts(docs, key, text)
    align, digest = _aligning(first, second), _digesting(size_b)
    return part.mapInArrow(lambda batches: digest(align(batches)), DIGESTED.format(kind=kind)).withColumnRenamed("key", key)


def counted(digests: DataFrame, size_b: int = 32_000) -> DataFrame:
    """pair, n, best: how many links of the corpus hold an id pair, and whether that is the highest count of its b id."""
    each = digests.select(F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("x.pairs", "x.times")
    n = each.groupBy(F.col("pairs").alias("pair")).agg(F.sum("times").alias("n"))
    # as many rows as the vocabularies have pairs of which one ends in the other, whatever the corpus
    rows = stored(n, "pairs")
    most = rows.groupBy((F.col("pair") % size_b).alias("b")).agg(F.max("n").alias("most"))
    return rows.withColumn("b", F.col("pair") % size_b).join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def scored(digests: DataFrame, counts: DataFrame) -> DataFrame:
    """digests with n_best and count_sum in place of the links. counts: counted(), bounded by the vocabularies."""
    table = counts.orderBy("pair").toArrow()
    known = digests.sparkSession.sparkContext.broadcast(tuple(table.column(c).to_numpy() for c in ("pair", "n", "best")))
    kept = [c for c in digests.columns if c not in ("pairs", "times")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = known.value
        for batch in batches:
            links, times = (batch.column(c).flatten().to_numpy().astype(np.int64) for c in ("pairs", "times"))
            row = np.repeat(np.arange(len(batch)), batch.column("pairs").value_lengths().to_numpy())
            at = np.searchsorted(pair, links)
            ends = np.cumsum(np.bincount(row, minlength=len(batch)))
            total = lambda x: np.diff(np.append(0, np.append(0, np.cumsum(x))[ends]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(total(times * best[at]), pa.int64()), pa.array(total(times * n[at]), pa.int64())], [*kept, "n_best", "count_sum"])

    ddl = ", ".join(f"{c} {t}" for c, t in digests.select(*kept).dtypes)
    return digests.mapInArrow(run, f"{ddl}, n_best long, count_sum long")


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's alignment, and how common its links are in the corpus."""
    digests = stored(digested(spark.read.parquet(f"{sf_dir}/documents.parquet")), "links")
    return scored(digests, counted(digests)).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
