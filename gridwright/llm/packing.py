"""Hierarchical packing of token ids into windows of several lengths.

Each document is cut into whole 2048-token windows and a remainder. The remainder is routed to the tier
of the smallest window that holds it (256, 512, 1024 or 2048). Tiers are packed from the longest window
down: a window opens with the longest remainder of its tier, gaps are filled best fit from the same and
shorter tiers, and what gap then is left takes the head of one more remainder. So windows are exactly
full. What is left at the end of a partition is cut at powers of two, which need no padding either.
Windows wait until GROUPS step groups of exactly STEP_TOKENS can be made of them, and are dealt to these so that
costs (sums of squared piece lengths) are level; only the last group of a partition may hold less.

Packing streams over the partitions of its input in blocks of BLOCK remainders: nothing is shuffled, and
memory is bounded whatever the number of equal keys. Ids of sequences hold the partition's number, so a
task that runs again after a lost executor gives the same rows. Deal the documents out first (the mixing
operator does) where neighbours in a file should not share windows.

Cases: null and empty texts are the end token alone; a null doc_id stays null; repeated rows are packed
each; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tokens import Encoder

WINDOW = 2048
TIERS = (2048, 1024, 512, 256)
END_ID = 1
BLOCK = 2048
#: Tokens of a step group, and how many groups are levelled at once.
STEP_TOKENS, GROUPS = 16 * WINDOW, 8
VOCABULARY = "word_bpe_49k.json"


def route(length: int) -> int:
    """The smallest window that holds so many tokens."""
    return next(w for w in reversed(TIERS) if length <= w)


class Packer:
    """Remainders in, full windows out. A remainder is (length, order, start, ids, doc)."""

    def __init__(self) -> None:
        self.tiers: dict[int, list] = {w: [] for w in TIERS}
        self.order = 0

    def __len__(self) -> int:
        return sum(map(len, self.tiers.values()))

    def add(self, doc: tuple, start: int, ids: np.ndarray) -> None:
        insort(self.tiers[route(len(ids))], (len(ids), self.order, start, ids, doc), key=lambda x: x[:2])
        self.order += 1

    def _best(self, gap: int) -> tuple | None:
        """The longest remainder that fits."""
        for w in TIERS:
            tier = self.tiers[w]
            at = bisect_right(tier, gap, key=lambda x: x[0])
            if at:
                return tier.pop(at - 1)
        return None

    def _next(self) -> tuple | None:
        """The shortest remainder: the one that a cut harms least."""
        for w in reversed(TIERS):
            if self.tiers[w]:
                return self.tiers[w].pop(0)
        return None

    def _fill(self, window: int) -> list[tuple]:
        """Pieces (doc, start, ids) that make up exactly window tokens; that many must be here."""
        out, gap = [], window
        while gap:
            x = self._best(gap) or self._next()
            n = min(x[0], gap)
            out.append((x[4], x[2], x[3][:n]))
            if n < x[0]:
                self.add(x[4], x[2] + n, x[3][n:])
            gap -= n
        return out

    def total(self) -> int:
        return sum(x[0] for tier in self.tiers.values() for x in tier)

    def windows(self, last: bool) -> Iterator[list[tuple]]:
        """All full windows; with `last` also the powers of two that are left."""
        left = self.total()
        for w in TIERS:
            # a tier's window opens with the longest of its own remainders, which _best finds first
            while self.tiers[w] and left >= w:
                yield self._fill(w)
                left -= w
        while last and left:
            w = min(WINDOW, 1 << (left.bit_length() - 1))
            yield self._fill(w)
            left -= w


def step_groups(costs: list[int], lengths: list[int], last: bool = False) -> list[int]:
    """A group for each window, -1: it waits for a later one. Groups have exactly STEP_TOKENS; with last, one more takes the rest.

    Lengths are powers of two and come longest first, so a group with room always has room for the next window. It
    goes to the group of least cost, costliest windows of a length first.
    """
    n = sum(lengths) // STEP_TOKENS
    heap, out = [(0, g, 0) for g in range(n)], [n if last else -1] * len(costs)
    for i in sorted(range(len(costs)), key=lambda i: (-lengths[i], -costs[i])):
        if not heap:
            break
        cost, g, tokens = heapq.heappop(heap)
        out[i] = g
        if tokens + lengths[i] < STEP_TOKENS:
            heapq.heappush(heap, (cost + costs[i], g, tokens + lengths[i]))
    return out


PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_length long, step_group long"


def pack(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row for each piece of a document: where it comes from and where it lies."""
    kinds = [pa.int64()] * 9
    names = [x.split()[0] for x in PIECE.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 40
        encoder, packer, sequences, steps = Encoder(vocabulary), Packer(), 0, 0
        waiting: list[list[tuple]] = []

        def rows(windows: list[list[tuple]], last: bool = False) -> Iterator[pa.RecordBatch]:
            nonlocal sequences, steps
            waiting.extend(windows)
            lengths = [sum(len(p[2]) for p in w) for w in waiting]
            if sum(lengths) < GROUPS * STEP_TOKENS and not last or not waiting:
                return
            groups, out, left = step_groups([sum(len(p[2]) ** 2 for p in w) for w in waiting], lengths, last), [], []
            for w, size, g in zip(waiting, lengths, groups, strict=True):
                if g < 0:
                    left.append(w)
                    continue
                offset = 0
                for (doc_id, tokens), start, ids in w:
                    out.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), tokens, base + sequences, offset, size, base + steps + g))
                    offset += len(ids)
                sequences += 1
            waiting[:] = left
            steps += max(groups) + 1
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

        for batch in batches:
            for lo in range(0, len(batch), 256):
                part = batch.slice(lo, 256)
                flat, counts = encoder.ids(part.column(1))
                stops, whole = np.cumsum(counts).tolist(), []
                for doc_id, a, b in zip(part.column(0).to_pylist(), [0, *stops], stops, strict=False):
                    ids = np.append(flat[a:b], np.uint16(END_ID))
                    doc, cut = (doc_id, len(ids)), len(ids) - len(ids) % WINDOW
                    whole += [[(doc, at, ids[at : at + WINDOW])] for at in range(0, cut, WINDOW)]
                    if cut < len(ids):
                        packer.add(doc, cut, ids[cut:])
                if len(packer) >= BLOCK:
                    whole += packer.windows(last=False)
                if whole:
                    yield from rows(whole)
        yield from rows(list(packer.windows(last=True)), last=True)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECE)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
