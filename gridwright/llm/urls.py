"""URL filter: a sorted array of 64-bit digests that every executor maps into memory.

A rule is a host and the beginning of a path (``example.net/en/``). The rules are hashed (xxhash64 of host and path),
sorted by digest over range partitions and written as files to the shared folder: digests, the places of their
full strings, verdicts and strings. Every executor fetches those files once and its Python workers map them, so
they share one copy and a list may be larger than a worker's memory. No URL is shuffled.

For each URL Spark's own functions hash only what could be a rule: the endings of its host at a dot with a length that some rule's
host has, each with the beginnings of its path of a length that such a rule's path has. A vectorised binary search finds those
digests in the array; the stored strings then confirm a hit, so digests that collide do no harm.
Lists over MAP_BYTES are not sent to executors: ``judged_by_join`` then meets them in a join of distinct digests.

Cases: a null URL or one without ``://`` has an empty host and path, and only a rule of an empty host fits it; A-Z of hosts are
lower-cased, in rules too, and nothing else is; ports and user names are part of a host; a rule without ``/`` fits every path; null rules are left out; a rule that is there twice
with both verdicts blocks; of rules of one length that fit, that of the longer host wins; no rule fits: allow. Null ids and repeated
rows come back as they are; an empty list allows all; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import write_files
from .skew import spread
from .storage import new_path, stored

#: Bytes of strings in one file of the array, and of the whole array that executors fetch.
SHARD_BYTES, MAP_BYTES = 64 << 20, 4 << 30
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DEFAULT = "allow"

#: The rules of op11_url_filter: fixed values.
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://[^/?#]*([^?#]*)", 1)


def prepared(rules: DataFrame) -> DataFrame:
    """digest, rule, block, hl, pl of the distinct rules (rule, verdict); hl and pl are the lengths of host and path."""
    text = F.col("rule").cast("string")
    host = F.translate(F.substring_index(text, "/", 1), UPPER, LOWER)
    own = rules.where(text.isNotNull()).select(host.alias("host"), F.substr(text, F.length(host) + 1).alias("path"), (F.col("verdict") == "block").alias("block"))
    one = own.groupBy(F.concat("host", "path").alias("rule")).agg(F.max("block").alias("block"), F.first(F.length("host")).alias("hl"), F.first(F.length("path")).alias("pl"))
    return one.select(F.xxhash64("rule").alias("digest"), "rule", F.coalesce("block", F.lit(False)).alias("block"), "hl", "pl")


@dataclass
class Lengths:
    """For each length of a rule's host the lengths of such rules' paths: a table of lengths, whatever the number of rules."""

    paths: dict[int, list[int]]

    @staticmethod
    def of(rules: DataFrame) -> Lengths:
        return Lengths({r["hl"]: sorted(r["pl"]) for r in rules.groupBy("hl").agg(F.collect_set("pl").alias("pl")).collect()})

    def candidates(self, host: Column, path: Column) -> Column:
        """What of a URL could be a rule: an array of (d: digest, h, p: lengths of its host and path)."""
        if not self.paths:
            return F.array().cast("array<struct<d:bigint,h:int,p:int>>")
        known = F.create_map(*(x for h, p in self.paths.items() for x in (F.lit(h), F.array(*map(F.lit, p)))))
        at_dot = lambda h: (F.length(host) == h) | (F.substr(host, F.length(host) - h, F.lit(1)) == ".")
        hosts = F.filter(F.map_keys(known), lambda h: (h <= F.length(host)) & at_dot(h))
        one = lambda h, p: F.struct(F.xxhash64(F.concat(F.substr(host, F.length(host) - h + 1), F.substr(path, F.lit(1), p))).alias("d"), h.alias("h"), p.alias("p"))
        return F.flatten(F.transform(hosts, lambda h: F.transform(F.filter(F.element_at(known, h), lambda p: p <= F.length(path)), lambda p: one(h, p))))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bytes]]:
    """(first digest, file) of a partition's rules, sorted by digest: n, digests, n + 1 places, verdicts, strings."""
    table = pa.Table.from_batches([b for b in batches if len(b)] or [], pa.schema([("digest", pa.int64()), ("rule", pa.string()), ("block", pa.bool_())]))
    if not len(table):
        return
    text = [x.encode() for x in table.column("rule").to_pylist()]
    places = np.concatenate([[0], np.cumsum([len(x) for x in text])]).astype("<i8")
    digests = table.column("digest").to_numpy().astype("<i8")
    yield int(digests[0]), b"".join((np.array([len(text)], "<i8").tobytes(), digests.tobytes(), places.tobytes(), table.column("block").to_numpy().astype("u1").tobytes(), *text))


class DigestArray:
    """The files of an array as an executor has fetched them, mapped into memory."""

    def __init__(self, names: list[tuple[int, str]]) -> None:
        self.first = np.array([first for first, _ in names], dtype=np.int64)
        self.parts = []
        for _, name in names:
            raw = np.memmap(SparkFiles.get(name), dtype=np.uint8, mode="r")
            n = int(raw[:8].view("<i8")[0])
            a, b, c = 8 + 8 * n, 8 + 8 * n + 8 * (n + 1), 8 + 8 * n + 8 * (n + 1) + n
            self.parts.append((raw[8:a].view("<i8"), raw[a:b].view("<i8"), raw[b:c], raw[c:]))

    def probe(self, digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(part, place) of the first equal digest; part -1 where there is none."""
        part = np.searchsorted(self.first, digests, side="right") - 1
        place = np.zeros(len(digests), dtype=np.int64)
        for i in np.unique(part[part >= 0]):
            rows, keys = np.flatnonzero(part == i), self.parts[i][0]
            at = np.minimum(np.searchsorted(keys, digests[rows]), len(keys) - 1)
            place[rows] = at
            part[rows[keys[at] != digests[rows]]] = -1
        return part, place

    def confirmed(self, part: int, place: int, text: bytes) -> bool | None:
        """Whether the rule of this full string blocks; None if only its digest is there."""
        keys, places, block, strings = self.parts[part]
        digest = keys[place]
        while place < len(keys) and keys[place] == digest:
            if strings[places[place] : places[place + 1]].tobytes() == text:
                return bool(block[place])
            place += 1
        return None


def _sent(rules: DataFrame, size: int) -> list[tuple[int, str]]:
    """The array's files in the shared folder, and announced to the executors: (first digest, name), sorted."""
    spark, path, job = rules.sparkSession, new_path(rules.sparkSession, "digests"), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for first, body in _packed(batches):
            yield pa.RecordBatch.from_arrays([pa.array([f"{job}-{first + (1 << 63):020d}.digests"]), pa.array([body], pa.binary())], ["name", "body"])

    shards = rules.repartitionByRange(max(1, -(-size // SHARD_BYTES)), "digest").sortWithinPartitions("digest", "rule")
    made = stored(shards.select("digest", "rule", "block").mapInArrow(run, "name string, body binary"), "shards")
    write_files(made, path)
    names = sorted(r["name"] for r in made.select("name").collect())
    for name in names:
        spark.sparkContext.addFile(f"{path}/{name}")
    return [(int(n.rpartition("-")[2].partition(".")[0]) - (1 << 63), n) for n in names]


def judged(rows: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url") -> DataFrame:
    """key, host, path, rule, verdict of each row. rules: rule, verdict (block or allow)."""
    known = stored(prepared(rules), "rules")
    size = known.agg(F.sum(F.octet_length("rule") + 17)).first()[0] or 0
    if size > MAP_BYTES:
        return judged_by_join(rows, known, key, url)
    names, lengths = _sent(known, size), Lengths.of(known)
    parts = rows.select(F.col(key).alias("key"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    asked = parts.select("key", "host", "path", lengths.candidates(F.col("host"), F.col("path")).alias("candidates"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        array = DigestArray(names)
        for batch in batches:
            found, ends = batch.column(3).flatten(), np.cumsum(batch.column(3).value_lengths().to_numpy())
            digest, h, p = (found.field(i).to_numpy() for i in range(3))
            part, place = array.probe(digest)
            hits = np.flatnonzero(part >= 0)
            # longest first; the first that is confirmed counts
            hits = hits[np.lexsort((-h[hits], -(h + p)[hits]))]
            best: dict[int, tuple[str, bool]] = {}
            for row, i in zip(np.searchsorted(ends, hits, side="right").tolist(), hits.tolist(), strict=True):
                if row not in best:
                    host, path = batch.column(1)[row].as_py(), batch.column(2)[row].as_py()
                    rule = host[len(host) - h[i] :] + path[: p[i]]
                    if (block := array.confirmed(part[i], place[i], rule.encode())) is not None:
                        best[row] = (rule, block)
            of = [best.get(i) for i in range(len(batch))]
            rule = pa.array([x and x[0] for x in of], pa.string())
            verdict = pa.array([DEFAULT if x is None else "block" if x[1] else "allow" for x in of], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], rule, verdict], ["key", "host", "path", "rule", "verdict"])

    kind = dict(parts.dtypes)["key"]
    return asked.mapInArrow(run, f"key {kind}, host string, path string, rule string, verdict string").withColumnRenamed("key", key)


def judged_by_join(rows: DataFrame, known: DataFrame, key: str = "page_id", url: str = "url") -> DataFrame:
    """The same for lists that executors can't hold. known: prepared(). Distinct host and path meet the rules, then their rows."""
    parts = rows.select(F.col(key).alias("key"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    places = stored(parts.groupBy("host", "path").agg(F.count("*").alias("n")), "places")
    each = places.select("host", "path", F.explode(Lengths.of(known).candidates(F.col("host"), F.col("path"))).alias("c"))
    named = each.select("host", "path", F.concat(F.substr("host", F.length("host") - F.col("c.h") + 1), F.substr("path", F.lit(1), F.col("c.p"))).alias("rule"), F.struct(F.col("c.h") + F.col("c.p"), "c.h").alias("length"))
    # a rule such as a whole country's may be asked for by a third of all places
    asked = stored(named.groupBy("rule").agg(F.count("*").alias("n")), "asked")
    there = stored(asked.join(known.select("rule", "block"), "rule"), "there")
    best = spread(named, there, ["rule"], ["host", "path"]).groupBy("host", "path").agg(F.max_by(F.struct("rule", "block"), "length").alias("best"))
    groups = stored(places.join(best, ["host", "path"], "left"), "judged")
    out = spread(parts, groups, ["host", "path"], ["key"])
    verdict = F.when(F.col("best").isNull(), DEFAULT).when(F.col("best.block"), "block").otherwise("allow")
    return out.select(F.col("key").alias(key), "host", "path", F.col("best.rule").alias("rule"), verdict.alias("verdict"))


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's URL."""
    return judged(spark.read.parquet(f"{sf_dir}/pages.parquet"), spark.createDataFrame(RULES, "rule string, verdict string"))


OP11_SQL = """
WITH rules(host, path, verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
u AS (SELECT row_number() OVER () AS k, page_id, instr(coalesce(url, ''), '://') AS p0, coalesce(url, '') AS url FROM pages),
t AS (SELECT k, page_id, CASE WHEN p0 = 0 THEN '' ELSE substr(url, p0 + 3) END AS rest FROM u),
p AS (SELECT k, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM t),
m AS (SELECT p.k, r.host || r.path AS rule, verdict, row_number() OVER (PARTITION BY p.k ORDER BY length(r.host || r.path) DESC) AS nth
      FROM p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN (SELECT * FROM m WHERE nth = 1) m USING (k)
"""
