"""Text quality by a generalised additive model with pairwise interactions.

Features come from the text alone. The model is a sum of lookup tables: one for each feature, found by
cyclic boosting (each round visits every feature and adds a shallow tree on its bins, shrunk), then one
for each of the PAIRS pairs whose bins explain most of what is left. A score is the logistic of the
sum of the table entries of a document's bins: vectorised additions.

Fit: on at most MAX_TRAIN labelled documents (those with the least hash of doc_id) whose crc32 modulo 4
is not HELD_OUT; several labels of a document are averaged. Scoring sees every whole text.

Cases: null and empty texts have features of zero and get a score; labels without quality or without a
document are ignored; without any usable label every score is 0.5; repeated rows get equal scores; an
empty table gives an empty table; columns pass through kept_only() untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import as_struct
from .text import U64, mix, prefix_hash, range_hash, slices, utf8, words

THRESHOLD = 0.7
HELD_OUT = 2
MAX_TRAIN = 40_000
BINS, PAIR_BINS, PAIRS = 32, 8, 6
ROUNDS, RATE, LEAVES = 150, 0.15, 4
FEATURES = (
    "log_chars", "log_words", "mean_word", "long_words", "distinct_words", "same_as_last", "upper", "digits", "symbols", "stops",
    "bangs", "bars", "high_bytes", "words_a_line", "symbol_ends", "one_byte_words",
)
_UPPER, _LOWER, _DIGIT, _SPACE, _LINE, _STOP, _BANG, _BAR, _SYMBOL, _HIGH = range(10)


def _classes() -> np.ndarray:
    kind = np.full(256, _SYMBOL, dtype=np.int64)
    for span, k in ((range(65, 91), _UPPER), (range(97, 123), _LOWER), (range(48, 58), _DIGIT), (range(33), _SPACE), (range(128, 256), _HIGH)):
        kind[list(span)] = k
    for chars, k in (("\n", _LINE), (".,;:'\"?()-", _STOP), ("!", _BANG), ("|", _BAR)):
        kind[[ord(c) for c in chars]] = k
    return kind


KIND = _classes()


def features(column: pa.Array) -> np.ndarray:
    """One row of FEATURES for each text."""
    raw_all, offsets_all = utf8(column)
    out = np.zeros((len(column), len(FEATURES)))
    for lo, hi in slices(offsets_all):
        raw, offsets, n = raw_all[offsets_all[lo] : offsets_all[hi]], offsets_all[lo : hi + 1] - offsets_all[lo], hi - lo
        size = np.diff(offsets)
        kind = KIND[raw]
        counts = np.bincount(np.repeat(np.arange(n) * 10, size) + kind, minlength=10 * n).reshape(n, 10)
        start, stop, row = words(raw, offsets)
        length, many = stop - start, np.bincount(row, minlength=n)
        per = lambda x: np.bincount(row, weights=x, minlength=n) / np.maximum(many, 1)  # noqa: E731,B023
        name = range_hash(prefix_hash(raw), start, stop)
        _, first = np.unique(name ^ mix(row.astype(U64)), return_index=True)
        same = np.zeros(len(row))
        same[1:] = (name[1:] == name[:-1]) & (row[1:] == row[:-1])
        share = counts / np.maximum(size, 1)[:, None]
        letters = np.maximum(counts[:, _UPPER] + counts[:, _LOWER], 1)
        out[lo:hi] = np.stack([
            np.log1p(size), np.log1p(many), per(length), per(length > 14), np.bincount(row[first], minlength=n) / np.maximum(many, 1), per(same),
            counts[:, _UPPER] / letters, share[:, _DIGIT], share[:, _SYMBOL], share[:, _STOP], share[:, _BANG], share[:, _BAR], share[:, _HIGH],
            many / (counts[:, _LINE] + 1), per(np.isin(kind[stop - 1], (_SYMBOL, _BANG, _BAR))) if len(row) else np.zeros(n), per(length == 1),
        ], axis=1)
    return out


def _best_cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """(gain, cut) of splitting ordered bins with gradient and weight sums g and h."""
    if len(g) < 2:
        return 0.0, 0
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = gl**2 / (hl + 1) + gr**2 / (hr + 1) - g.sum() ** 2 / (h.sum() + 1)
    gain[(hl < 1e-3) | (hr < 1e-3)] = 0
    cut = int(np.argmax(gain))
    return float(gain[cut]), cut + 1


def _shallow(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Values of a tree of at most LEAVES leaves on ordered bins."""
    parts = [(0, len(g))]
    for _ in range(LEAVES - 1):
        gains = [_best_cut(g[a:b], h[a:b]) for a, b in parts]
        i = max(range(len(parts)), key=lambda i: gains[i][0])
        if gains[i][0] <= 1e-9:
            break
        (a, b), cut = parts[i], gains[i][1]
        parts[i : i + 1] = [(a, a + cut), (a + cut, b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + 1)
    return out


def _shallow2(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The same on a grid: the better axis is cut, then each side on the other axis."""
    flip = _best_cut(g.sum(0), h.sum(0))[0] > _best_cut(g.sum(1), h.sum(1))[0]
    g, h = (g.T, h.T) if flip else (g, h)
    gain, cut = _best_cut(g.sum(1), h.sum(1))
    out = np.zeros_like(g)
    for rows in ((slice(0, cut), slice(cut, None)) if gain > 1e-9 else (slice(None),)):
        gain2, cut2 = _best_cut(g[rows].sum(0), h[rows].sum(0))
        for cols in ((slice(0, cut2), slice(cut2, None)) if gain2 > 1e-9 else (slice(None),)):
            out[rows, cols] = g[rows, cols].sum() / (h[rows, cols].sum() + 1)
    return out.T if flip else out


class Additive:
    """Cut points, tables and pair tables; plain arrays that go to the tasks in the closure."""

    def __init__(self, x: np.ndarray, y: np.ndarray) -> None:
        wanted = np.linspace(0, 1, BINS + 1)[1:-1]
        self.cuts = [np.unique(np.quantile(c, wanted)) if len(c) else np.zeros(0) for c in x.T]
        self.coarse = [c[np.linspace(0, len(c) - 1, min(PAIR_BINS - 1, len(c))).astype(int)] if len(c) else c for c in self.cuts]
        self.tables = [np.zeros(len(c) + 1) for c in self.cuts]
        self.pairs: list[tuple[int, int, np.ndarray]] = []
        if not len(y):
            self.base = 0.0
            return
        self.base = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
        bins = self._bins(x, self.cuts)
        total = np.full(len(y), self.base)
        last = np.inf
        for _ in range(ROUNDS):
            for j, table in enumerate(self.tables):
                p = 1 / (1 + np.exp(-total))
                step = RATE * _shallow(np.bincount(bins[j], y - p, len(table)), np.bincount(bins[j], p * (1 - p), len(table)))
                table += step
                total += step[bins[j]]
            loss = float(np.logaddexp(0, np.where(y > 0, -total, total)).mean())
            if last - loss < 1e-5:
                break
            last = loss
        self._interact(x, y, total)

    def _interact(self, x: np.ndarray, y: np.ndarray, total: np.ndarray) -> None:
        coarse = self._bins(x, self.coarse)
        sizes = [len(c) + 1 for c in self.coarse]
        p = 1 / (1 + np.exp(-total))
        gains = []
        for a in range(len(sizes)):
            for b in range(a):
                cell = coarse[a] * sizes[b] + coarse[b]
                g, h = (np.bincount(cell, w, sizes[a] * sizes[b]) for w in (y - p, p * (1 - p)))
                gains.append((float((g**2 / (h + 1)).sum()), a, b))
        chosen = [(a, b, np.zeros((sizes[a], sizes[b]))) for _, a, b in sorted(gains, reverse=True)[:PAIRS]]
        for _ in range(ROUNDS // 3):
            for a, b, table in chosen:
                p = 1 / (1 + np.exp(-total))
                cell = coarse[a] * sizes[b] + coarse[b]
                g, h = (np.bincount(cell, w, table.size).reshape(table.shape) for w in (y - p, p * (1 - p)))
                step = RATE * _shallow2(g, h)
                table += step
                total += step.reshape(-1)[cell]
        self.pairs = chosen

    @staticmethod
    def _bins(x: np.ndarray, cuts: list[np.ndarray]) -> list[np.ndarray]:
        return [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(cuts)]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for table, at in zip(self.tables, self._bins(x, self.cuts), strict=True):
            total += table[at]
        if self.pairs:
            coarse = self._bins(x, self.coarse)
            for a, b, table in self.pairs:
                total += table[coarse[a], coarse[b]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == HELD_OUT, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Additive:
    """The model of documents' labels; at most max_train rows of features come to the driver."""
    order = F.xxhash64("id")
    usable = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("quality").cast("double").alias("y")).where("id is not null and y is not null").where(~held_out(F.col("id")))
    sample = usable.groupBy("id").agg((F.avg("y") >= 0.5).cast("double").alias("y")).orderBy(order, "id").limit(max_train)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(batch.column(2))
            rows = pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), x.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), rows], ["id", "y", "x"])

    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    found = texts.join(F.broadcast(sample), "id").select("id", "y", "text").mapInArrow(run, "id long, y double, x array<double>")
    rows = found.orderBy(order, "id").limit(max_train).toArrow()
    x = rows.column("x").combine_chunks().flatten().to_numpy().reshape(-1, len(FEATURES))
    return Additive(x, rows.column("y").to_numpy())


def scored(docs: DataFrame, model: Additive) -> DataFrame:
    """row (docs' columns), score of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model(features(batch.column(1))), pa.float64())], ["row", "score"])

    both = docs.select(as_struct(docs).alias("row"), F.col("text").cast("string").alias("text"))
    return both.mapInArrow(run, both.select("row").schema.add("score", "double"))


def kept_only(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs' own columns where the score reaches the threshold."""
    return scored(docs, fit(docs, labels)).where(F.col("score") >= threshold).select("row.*")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score for every document; learned without the held-out quarter."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = fit(docs, labels)
    out = scored(docs.select("doc_id", "text"), model)
    return out.select(F.col("row.doc_id").alias("doc_id"), held_out(F.col("row.doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
