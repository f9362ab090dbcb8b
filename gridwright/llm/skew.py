"""Joins of many rows with the groups they belong to, where one group may hold a third of all rows."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A group is hot from so many rows on, or from 1/HOT_SHARE of all: so at most HOT_SHARE groups are hot.
HOT, HOT_SHARE = 10_000, 10_000
SALTS = 64


def spread(many: DataFrame, groups: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """many joined with groups (one row for each key, n: its rows) by keys; the rows of a hot key go to SALTS tasks.

    groups should be a stored table. The keys of hot groups are broadcast: at most HOT_SHARE of them, whatever the input. Both
    sides meet by one 64-bit hash of keys and salt, which sorts faster than the keys do; the keys are compared then.
    columns: what names a row of many, by which the rows of a hot group are dealt.
    """
    limit = max(HOT, (groups.agg(F.sum("n")).first()[0] or 0) // HOT_SHARE)
    hot = groups.where(F.col("n") > limit).select(*keys, F.lit(True).alias("hot"))
    if not hot.head(1):
        return many.join(groups.drop("n"), keys)
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64(*columns), F.lit(SALTS)).cast("int")).otherwise(0)
    left = many.join(F.broadcast(hot), keys, "left").withColumn("meet", F.xxhash64(*keys, salt)).drop("hot")
    last = F.when(F.col("n") > limit, SALTS - 1).otherwise(0)
    right = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), last))).withColumn("meet", F.xxhash64(*keys, "salt"))
    right = right.drop("n", "salt").withColumnsRenamed({k: f"own_{k}" for k in keys})
    same = functools.reduce(lambda x, y: x & y, (F.col(k) == F.col(f"own_{k}") for k in keys))
    return left.join(right, "meet").where(F.when(same, True).otherwise(False)).drop("meet", *(f"own_{k}" for k in keys))
