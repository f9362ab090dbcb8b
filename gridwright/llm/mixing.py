"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

A source of size s (characters) and target share w gets the mean repetition rate w * total / s. Each
document inverts the Poisson distribution of its source's rate at a uniform number hashed from seed,
id and text, is repeated that often, and all copies are dealt by a hash of their own and sorted by it.

Cases: without weights the share of a source is size ** temperature; a source without characters or
with no weight given gets rate 1 or 0; a null source is a source of its own; a null text counts as
empty; repeated rows get equal counts; an empty table gives an empty table. Columns pass through
inside a struct, so that names never clash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .storage import as_struct, stored

SEED = 17
TEMPERATURE = 0.7
#: Bytes of the rate table up to which it is broadcast; beyond, a salted join.
BROADCAST_BYTES = 8 << 20
SALTS = 64
#: Factorials up to here come from a table.
SMALL = 32


def source_key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("null"))


def _hex_long(text: Column, digits: int) -> Column:
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("long")


def rates(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = TEMPERATURE) -> DataFrame:
    """source_key, rate: mean number of copies of each source's documents. docs: source_key, size."""
    sizes = docs.groupBy("source_key").agg(F.sum("size").cast("double").alias("size"))
    if weights is None:
        share = F.when(F.col("size") > 0, F.pow("size", F.lit(temperature))).otherwise(0.0)
    else:
        given = F.create_map(*[F.lit(x) for k, v in weights.items() for x in (f"={k}", float(v))]) if weights else F.lit(None).cast("map<string,double>")
        share = F.coalesce(given[F.col("source_key")], F.lit(0.0))
    sizes = sizes.withColumn("share", share)
    # the totals are one row
    total = sizes.agg(F.sum("size").alias("total"), F.sum("share").alias("shares"))
    rate = F.when(F.col("size") > 0, F.col("share") / F.col("shares") * F.col("total") / F.col("size")).otherwise(1.0)
    return sizes.join(F.broadcast(total)).select("source_key", rate.alias("rate"))


def cutoffs(rate: DataFrame) -> DataFrame:
    """source_key, rate, low, cdf: P(n <= k) for k = low, low + 1, ... until it is 1 in double precision.

    All below low together is less likely than 10^-30, so even a rate of millions needs some ten thousand steps.
    """
    spread = 12 * F.sqrt("rate") + 40
    low, high = F.greatest(F.lit(0), F.floor(F.col("rate") - spread)).cast("long"), F.ceil(F.col("rate") + spread).cast("long")
    run = W.partitionBy("source_key").orderBy("k").rowsBetween(W.unboundedPreceding, 0)
    steps = rate.select("source_key", "rate", low.alias("low"), F.explode(F.sequence(low, high)).alias("k"))
    k, mean = F.col("k").cast("double"), F.col("rate")
    # small factorials by table, large ones by Stirling's series around the mean, which loses no digits
    few = F.exp(-mean + k * F.log(mean) - F.array(*(F.lit(math.lgamma(i + 1)) for i in range(SMALL)))[F.least("k", F.lit(SMALL - 1)).cast("int")])
    many = F.exp(k - mean - k * F.log(k / mean) - (1 / (12 * k) - 1 / (360 * k**3) + 1 / (1260 * k**5))) / F.sqrt(2 * math.pi * k)
    mass = F.when(mean <= 0, (k == 0).cast("double")).when(k < SMALL, few).otherwise(many)
    below = steps.withColumn("cdf", F.sum(mass).over(run)).groupBy("source_key", "rate", "low").agg(F.sort_array(F.collect_list(F.struct("k", "cdf"))).alias("steps"))
    return below.select("source_key", "rate", "low", F.transform("steps", lambda s: s["cdf"]).alias("cdf"))


def replicate(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = TEMPERATURE, seed: int = SEED) -> DataFrame:
    """row (docs' columns), copy (from 1), n_copies, shuffle_key: all copies in one global random order."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    name = F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit("|"), text)
    table = stored(cutoffs(rates(docs.select(source_key(F.col("source")).alias("source_key"), F.length(text).alias("size")), weights, temperature)), "rates")
    rows = docs.select(as_struct(docs).alias("row"), source_key(F.col("source")).alias("source_key"), F.md5(name).alias("digest"))
    if (table.agg(F.sum(F.size("cdf") * 8 + 64)).first()[0] or 0) <= BROADCAST_BYTES:
        joined = rows.join(F.broadcast(table), "source_key")
    else:
        salt = F.pmod(F.xxhash64("digest"), F.lit(SALTS)).cast("int")
        many = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn("salt", salt).join(many, ["source_key", "salt"])
    u = (F.conv(F.substring("digest", 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))
    counted = joined.select("row", "digest", (F.col("low") + F.size(F.filter("cdf", lambda c: c < u))).cast("int").alias("n_copies")).where("n_copies > 0")
    copies = counted.select("row", "digest", "n_copies", F.explode(F.sequence(F.lit(1), F.col("n_copies"))).alias("copy"))
    keyed = copies.select("row", "copy", "n_copies", _hex_long(F.concat("digest", F.lit("|"), F.col("copy").cast("string")), 15).alias("shuffle_key"))
    return keyed.repartition("shuffle_key").sortWithinPartitions("shuffle_key")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """docs' own columns, documents repeated or left out to meet the target weights, shuffled."""
    return replicate(docs, **options).select("row.*")


def op10_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole corpus mixed: shares as sizes to the power 0.7, whole texts replicated and shuffled."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return replicate(docs).select("row.doc_id", "row.source", "copy", "n_copies", "shuffle_key", "row.text")


OP10_SQL = """
WITH d AS (
  SELECT doc_id, source, text, coalesce('=' || source, 'null') AS k, length(coalesce(text, '')) AS size,
         md5('17|' || coalesce(CAST(doc_id AS VARCHAR), 'null') || '|' || coalesce(text, '')) AS digest FROM documents),
s AS (SELECT k, CAST(sum(size) AS DOUBLE) AS size FROM d GROUP BY k),
w AS (SELECT k, size, CASE WHEN size > 0 THEN pow(size, 0.7) ELSE 0 END AS share FROM s),
r AS (SELECT k, CASE WHEN size > 0 THEN share / (SELECT sum(share) FROM w) * (SELECT sum(size) FROM w) / size ELSE 1 END AS rate FROM w),
m AS (SELECT k, n, CASE WHEN rate > 0 THEN exp(-rate + n * ln(rate) - lgamma(n + 1)) ELSE CAST(n = 0 AS INT) END AS mass
      FROM (SELECT k, rate, unnest(range(CAST(ceil(rate + 12 * sqrt(rate) + 40) AS BIGINT) + 1)) AS n FROM r)),
c AS (SELECT k, n, sum(mass) OVER (PARTITION BY k ORDER BY n) AS cdf FROM m),
u AS (SELECT *, (CAST(CAST('0x' || substr(digest, 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0 AS u FROM d),
q AS (SELECT u.doc_id, u.source, u.text, u.digest, count(*) AS n_copies
      FROM u JOIN c ON u.k = c.k AND c.cdf < u.u GROUP BY ALL),
e AS (SELECT *, unnest(range(1, n_copies + 1)) AS copy FROM q)
SELECT doc_id, source, CAST(copy AS INT) AS copy, CAST(n_copies AS INT) AS n_copies,
       CAST('0x' || substr(md5(digest || '|' || CAST(copy AS VARCHAR)), 1, 15) AS BIGINT) AS shuffle_key, text
FROM e
"""
