"""Line, paragraph or passage dedup: units are normalised and hashed, the earliest ranked occurrence stays.

Rank is (doc_id, position); a null doc_id comes last. Digests are grouped with map-side aggregation, so a
unit that a third of the documents hold costs one row for each task. Occurrences meet the repeated digests
in a join that deals the occurrences of a hot digest to many tasks.

dedup_units() takes each line or paragraph for itself. dedup_passages() looks inside lines too: its units are
lines and the sentences in them, and what is hashed is a window, the shortest run of consecutive units from
each unit on that has PASSAGE words. The units of a repeated window go, but for those that also lie in the
earliest occurrence of a repeated window: so whatever is removed still stands whole elsewhere, and stock
sentences, licence lines and menus that are shorter than a passage stay.

Cases: a null text gives a null kept_text and no units; an empty text stays; repeated rows (same doc_id
and text) count as one document and get equal results, repeats inside one text go; an empty table gives
an empty table; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .skew import spread
from .storage import stored
from .text import slices, utf8

MIN_WORDS = 5
#: Words of a passage. A unit counts its words, or one for WIDE characters where that is more (scripts without blanks).
PASSAGE, WIDE = 30, 8
#: Separators of units, as regular expressions.
UNITS = {"line": "\n", "paragraph": "\n[ \t\r\n]*\n"}


def normalised(unit: Column) -> Column:
    """Lower case, runs of white space as one blank, trimmed."""
    return F.trim(F.regexp_replace(F.lower(unit), r"\s+", " "))


def units(docs: DataFrame, unit: str = "line", min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, row, pos, digest of each unit that has at least min_words words."""
    lines = docs.select("row", "doc_id", F.posexplode(F.split("text", UNITS[unit])).alias("pos", "unit"))
    clean = lines.select("row", "doc_id", "pos", normalised("unit").alias("unit"))
    # blanks count words without making an array of them
    enough = F.length("unit") - F.length(F.translate("unit", " ", "")) >= min_words - 1
    return clean.where(enough & (F.length("unit") > 0)).select("row", "doc_id", "pos", F.unhex(F.md5(F.col("unit").cast("binary"))).alias("digest"))


def _ranked(docs: DataFrame) -> DataFrame:
    """row: what names a document here. Rows that agree in doc_id and text count as one."""
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("body"))
    return docs.select("doc_id", "text", key.alias("row"))


def dedup_units(docs: DataFrame, unit: str = "line", min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, n_units, n_removed, removed_offsets ("start:stop" in characters of the original), kept_text."""
    rows = _ranked(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")))
    found = units(rows, unit, min_words)
    place = F.struct("row", "pos")
    firsts = found.groupBy("digest").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    gone = found.join(firsts, "digest").where(place != F.col("first")).groupBy("row").agg(F.collect_set("pos").alias("gone"))
    return rows.join(gone, "row", "left").select("doc_id", "text", "gone").mapInArrow(_cut(UNITS[unit]), OUT)


OUT = "doc_id long, n_units int, n_removed int, removed_offsets string, kept_text string"


def _cut(separator: str) -> Callable:
    breaks = re.compile(f"({separator})")

    def one(text: str | None, gone: list[int] | None) -> tuple:
        if text is None:
            return 0, 0, "", None
        parts = breaks.split(text) if gone else None
        if parts is None:
            return len(breaks.findall(text)) + 1, 0, "", text
        drop, at, spans, kept = set(gone), 0, [], []
        for i in range(0, len(parts), 2):
            if i // 2 in drop:
                spans.append(f"{at}:{at + len(parts[i])}")
            else:
                kept += parts[i : i + 2]
            at += sum(map(len, parts[i : i + 2]))
        if len(kept) > 1 and len(kept) % 2 == 0:  # the separator after what is now the last unit
            kept.pop()
        return len(parts) // 2 + 1, len(spans), ",".join(spans), "".join(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [one(t.as_py(), g.as_py()) for t, g in zip(batch.column(1), batch.column(2), strict=True)]
            cols = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, k) for x, k in zip(cols, (pa.int32(), pa.int32(), pa.string(), pa.string()), strict=True))], [x.split()[0] for x in OUT.split(", ")])

    return run


def sentences(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, row) of each unit: where a text begins, after a line break, and after the end of a sentence."""
    n = len(raw)
    body = (raw != 32) & (raw != 10) & (raw != 13) & (raw != 9)
    before = np.empty(n, dtype=np.int64)  # the last byte before this one that is no blank
    before[:1] = -1
    before[1:] = np.maximum.accumulate(np.where(body, np.arange(n), -1))[:-1]
    lines = np.concatenate([[0], np.cumsum(raw == 10)])
    at = np.flatnonzero(body & (before != np.arange(n) - 1) | np.isin(np.arange(n), offsets[:-1]) & body) if n else np.zeros(0, np.int64)
    # the full stop, exclamation and question mark of scripts that put no blank after them
    mark = np.zeros(n + 1, dtype=bool)
    if n > 2:
        a, b, c = raw[:-2], raw[1:-1], raw[2:]
        mark[3:] = (a == 0xE3) & (b == 0x80) & (c == 0x82) | (a == 0xEF) & (b == 0xBC) & ((c == 0x81) | (c == 0x9F))
        if mark.any():
            at = np.union1d(at, np.flatnonzero(body & mark[before + 1]))
    last, row = before[at], np.searchsorted(offsets, at, side="right") - 1
    own = last >= offsets[row]
    end = raw[last]
    stop = (end == 46) | (end == 33) | (end == 63)
    keep = ~own | (lines[at] > lines[last + 1]) | stop & (last < at - 1) | mark[last + 1]
    return at[keep], row[keep]


def _windows(raw: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """(row, first unit, units, digest) of each window; raw: lower-case texts."""
    starts, row = sentences(raw, offsets)
    if not len(starts):
        return row, row, row, []
    body = (raw != 32) & (raw != 10) & (raw != 13) & (raw != 9)
    keep = body.copy()
    keep[1:] |= body[:-1]
    at = np.concatenate([[0], np.cumsum(keep)])
    clean = np.where(body, raw, np.uint8(32))[keep]
    last = np.maximum.accumulate(np.where(body, np.arange(len(raw)), -1))
    stops = np.minimum(np.append(starts[1:], len(raw)), offsets[row + 1])
    a, b = at[starts], at[last[stops - 1] + 1]
    blanks = np.concatenate([[0], np.cumsum(clean == 32)])
    chars = np.concatenate([[0], np.cumsum((clean & 0xC0) != 0x80)])
    total = np.cumsum(np.maximum(blanks[b] - blanks[a] + 1, (chars[b] - chars[a]) // WIDE))
    size = np.diff(total, prepend=0)
    end = np.searchsorted(total, total - size + words)
    some = np.flatnonzero(end < np.searchsorted(row, row, side="right"))
    data = clean.tobytes()
    digests = [xxhash.xxh3_128_digest(data[x:y]) for x, y in zip(a[some].tolist(), b[end[some]].tolist(), strict=True)]
    first = np.searchsorted(row, row)
    return row[some], some - first[some], end[some] - some + 1, digests


WINDOW = "digest binary, no_id boolean, id long, body long, pos int, units int"


def windows(rows: DataFrame, words: int = PASSAGE) -> DataFrame:
    """WINDOW rows of all texts. rows: as _ranked() gives them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = utf8(pc.utf8_lower(batch.column(3)))
            for lo, hi in slices(offsets):
                row, first, units, digests = _windows(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], words)
                row = pa.array(row + lo)
                columns = [pa.array(digests, pa.binary()), *(batch.column(i).take(row) for i in range(3)), pa.array(first.astype(np.int32)), pa.array(units.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in WINDOW.split(", ")])

    return rows.select("row.*", "text").mapInArrow(run, WINDOW)


def repeated_windows(found: DataFrame) -> DataFrame:
    """row, pos, units, first of all windows that occur more than once; first: it is the earliest one."""
    place = F.struct("no_id", "id", "body", "pos")
    again = stored(found.groupBy("digest").agg(F.min(place).alias("least"), F.count("*").alias("n")).where("n > 1"), "repeats")
    return spread(found, again, ["digest"], ["id", "body", "pos"]).select(F.struct("no_id", "id", "body").alias("row"), "pos", "units", (place == F.col("least")).alias("first"))


def dedup_passages(docs: DataFrame, words: int = PASSAGE) -> DataFrame:
    """OUT rows; removed_offsets has one range for each unit that goes, the blanks behind it included."""
    rows = _ranked(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")))
    found = repeated_windows(stored(windows(rows, words), "windows"))
    marks = found.groupBy("row").agg(F.collect_set(F.struct("pos", "units", "first")).alias("marks"))
    return rows.join(marks, "row", "left").select("doc_id", "text", "marks").mapInArrow(_cut_units, OUT)


def _cut_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.int32(), pa.int32(), pa.string(), pa.string())
    for batch in batches:
        raw, offsets = utf8(batch.column(1))
        out = []
        for lo, hi in slices(offsets):
            part, own = raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
            starts, row = sentences(part, own)
            bounds = np.searchsorted(row, np.arange(hi - lo + 1))
            for i in range(lo, hi):
                mine = starts[bounds[i - lo] : bounds[i - lo + 1]] - own[i - lo]
                out.append((len(mine), *_without(batch.column(1)[i].as_py(), mine, batch.column(2)[i])))
        columns = list(zip(*out, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, k) for x, k in zip(columns, kinds, strict=True))], [x.split()[0] for x in OUT.split(", ")])


def _without(text: str | None, starts: np.ndarray, marks: pa.ListScalar) -> tuple[int, str, str | None]:
    """(units removed, their offsets, text kept) of one text whose units start at these bytes."""
    if text is None or not marks.is_valid:
        return 0, "", text
    pos, units, first = (marks.values.field(k).to_numpy(zero_copy_only=False) for k in range(3))
    covered = np.zeros((2, len(starts) + 1), dtype=np.int64)
    for k in (0, 1):
        np.add.at(covered[k], pos[first == k], 1)
        np.add.at(covered[k], (pos + units)[first == k], -1)
    covered = covered.cumsum(axis=1)[:, :-1] > 0
    data = text.encode()
    chars = np.concatenate([[0], np.cumsum((np.frombuffer(data, dtype=np.uint8) & 0xC0) != 0x80)])
    spans = np.append(chars[starts], len(text)).tolist()
    kept, at, gone = [], 0, np.flatnonzero(covered[0] & ~covered[1]).tolist()
    for i in gone:
        kept.append(text[at : spans[i]])
        at = spans[i + 1]
    return len(gone), ",".join(f"{spans[i]}:{spans[i + 1]}" for i in gone), "".join(kept) + text[at:]


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of repeated lines and sentences over all documents."""
    return dedup_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op8_line_dedup_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line dedup over all documents, where every line of five words or more is a unit for itself."""
    return dedup_units(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op8_line_dedup_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line dedup over all documents, where every non-empty line is a unit: short ones, and those of scripts without blanks."""
    return dedup_units(spark.read.parquet(f"{sf_dir}/documents.parquet"), min_words=1)


OP8_FLOOR_SQL = r"""
WITH u AS (
  SELECT doc_id, i AS pos, l AS raw, trim(regexp_replace(lower(l), '\s+', ' ', 'g')) AS norm
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)),
p AS (SELECT *, sum(length(raw) + 1) OVER (PARTITION BY doc_id ORDER BY pos) - length(raw) - 1 AS start,
             CASE WHEN norm <> '' AND len(string_split(norm, ' ')) >= 5 THEN norm END AS unit FROM u),
r AS (SELECT *, unit IS NOT NULL AND row_number() OVER (PARTITION BY unit ORDER BY doc_id, pos) > 1 AS gone FROM p)
SELECT doc_id, CAST(count(*) AS INT) AS n_units, CAST(count(*) FILTER (gone) AS INT) AS n_removed,
       coalesce(string_agg(CAST(start AS BIGINT) || ':' || CAST(start + length(raw) AS BIGINT), ',' ORDER BY pos) FILTER (gone), '') AS removed_offsets,
       coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS kept_text
FROM r GROUP BY doc_id
"""
OP8_ALL_SQL = r"""
WITH u AS (
  SELECT doc_id, i AS pos, l AS raw, trim(regexp_replace(lower(l), '\s+', ' ', 'g')) AS norm
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)),
p AS (SELECT *, sum(length(raw) + 1) OVER (PARTITION BY doc_id ORDER BY pos) - length(raw) - 1 AS start FROM u),
r AS (SELECT *, norm <> '' AND row_number() OVER (PARTITION BY norm ORDER BY doc_id, pos) > 1 AS gone FROM p)
SELECT doc_id, CAST(count(*) AS INT) AS n_units, CAST(count(*) FILTER (gone) AS INT) AS n_removed,
       coalesce(string_agg(CAST(start AS BIGINT) || ':' || CAST(start + length(raw) AS BIGINT), ',' ORDER BY pos) FILTER (gone), '') AS removed_offsets,
       coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS kept_text
FROM r GROUP BY doc_id
"""
OP8_SQL = r"""
WITH p AS (
  SELECT doc_id, unnest(parts) AS raw, generate_subscripts(parts, 1) AS k
  FROM (SELECT doc_id, string_split(regexp_replace(text, '(^[ \t\r\n]+|[.!?][ \t\r\n]+|[。！？][ \t\r\n]*|[ \t\r]*\n[ \t\r\n]*)', '\1' || chr(1), 'g'), chr(1)) AS parts FROM documents)),
q AS (SELECT *, CAST(sum(length(raw)) OVER (PARTITION BY doc_id ORDER BY k) - length(raw) AS BIGINT) AS start,
             trim(regexp_replace(lower(raw), '[ \t\r\n]+', ' ', 'g')) AS norm FROM p),
u AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS i, greatest(len(string_split(norm, ' ')), length(norm) // 8) AS size FROM q WHERE norm <> ''),
c AS (SELECT doc_id, i, size, sum(size) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM u),
w AS (SELECT a.doc_id, a.i, b.i AS j FROM (SELECT doc_id, i, upto - size + 30 AS need FROM c) a ASOF JOIN c b ON a.doc_id = b.doc_id AND a.need <= b.upto),
l AS (SELECT doc_id, list(raw ORDER BY i) AS raws FROM u GROUP BY doc_id),
g AS (SELECT doc_id, i, j, trim(regexp_replace(lower(array_to_string(raws[i:j], '')), '[ \t\r\n]+', ' ', 'g')) AS unit FROM w JOIN l USING (doc_id)),
f AS (SELECT *, count(*) OVER (PARTITION BY unit) AS n, row_number() OVER (PARTITION BY unit ORDER BY doc_id, i) AS nth FROM g),
x AS (SELECT doc_id, i, NOT bool_or(nth = 1) AS gone FROM (SELECT doc_id, unnest(range(i, j + 1)) AS i, nth FROM f WHERE n > 1) GROUP BY ALL),
r AS (SELECT q.doc_id, q.k, q.raw, q.start, u.i, coalesce(x.gone, false) AS gone
      FROM q LEFT JOIN u ON q.doc_id = u.doc_id AND q.k = u.k LEFT JOIN x ON x.doc_id = u.doc_id AND x.i = u.i)
SELECT doc_id, CAST(count(i) AS INT) AS n_units, CAST(count(*) FILTER (gone) AS INT) AS n_removed,
       coalesce(string_agg(start || ':' || (start + length(raw)), ',' ORDER BY k) FILTER (gone), '') AS removed_offsets,
       coalesce(string_agg(raw, '' ORDER BY k) FILTER (NOT gone), '') AS kept_text
FROM r GROUP BY doc_id
"""
