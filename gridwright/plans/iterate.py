"""Loops of DataFrame steps: lineage is cut in the cluster's shared checkpoint folder, convergence is a count."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir (a fresh one only where none is set on one machine)."""
    if not spark.sparkContext.getCheckpointDir():
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(found or tempfile.mkdtemp(prefix="gridwright-"))
    return spark.sparkContext.getCheckpointDir()


def shared_path(spark: SparkSession, name: str) -> str:
    """A new place in that folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame) -> DataFrame:
    """df computed once and kept in that folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def until_stable(start: DataFrame, step: Callable[[DataFrame], DataFrame], changed: Callable[[DataFrame, DataFrame], DataFrame], rounds: int) -> DataFrame:
    """Repeats step until changed(before, after) has no row; raises if that takes more than so many rounds."""
    now = saved(start)
    for _ in range(rounds):
        after = saved(step(now))
        if not changed(now, after).head(1):
            return after
        now = after
    raise RuntimeError(f"not stable after {rounds} rounds")


def components(nodes: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """keys, node, label: the least node of each component, separately for each value of keys. edges: keys, a, b.

    Each round a node takes the least label around it and then that label's own label, so that the
    number of rounds grows with the logarithm of a component's diameter.
    """
    both = saved(edges.select(*keys, "a", "b").union(edges.select(*keys, F.col("b").alias("a"), F.col("a").alias("b"))).distinct())

    def step(now: DataFrame) -> DataFrame:
        near = both.join(now.withColumnRenamed("node", "b"), [*keys, "b"]).groupBy(*keys, F.col("a").alias("node")).agg(F.min("label").alias("near"))
        least = now.join(near, [*keys, "node"], "left").select(*keys, "node", "label", F.least("label", F.coalesce("near", "label")).alias("new"))
        # hooking: the old label's node learns of the new one
        hooks = least.where("new < label").groupBy(*keys, F.col("label").alias("node")).agg(F.min("new").alias("hook"))
        hooked = least.join(hooks, [*keys, "node"], "left").select(*keys, "node", F.least("new", F.coalesce("hook", "new")).alias("label"))
        jump = hooked.select(*keys, F.col("node").alias("label"), F.col("label").alias("next"))
        return hooked.join(jump, [*keys, "label"]).select(*keys, "node", F.col("next").alias("label"))

    start = nodes.select(*keys, "node", F.col("node").alias("label"))
    return until_stable(start, step, lambda a, b: a.join(b, [*keys, "node", "label"], "left_anti"), 64)
