"""Tables that cut lineage: written once to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def quoted(name: str) -> str:
    """A column's name as a reference, dots and back-ticks included."""
    return "`" + name.replace("`", "``") + "`"


def as_struct(df: DataFrame, names: list[str] | None = None) -> Column:
    """df's columns (or those named) as one struct, so that no name clashes."""
    return F.struct(*(F.col(quoted(c)) for c in (df.columns if names is None else names)))


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; a fresh folder only where none is set on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="gridwright-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df once and return a frame that reads it back; survives lost executors without recomputing."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
