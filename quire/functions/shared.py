"""The folder that all executors share, lineage cut by checkpoints in it, and joins of rows that are many."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one where that is unset on a single machine, an error on a cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return tempfile.mkdtemp(prefix="quire-")


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared folder and read from there by all that follows."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder(df.sparkSession))
    return df.checkpoint()


def many(df: DataFrame) -> DataFrame:
    """df as a side of a join that is sorted and merged. Spark takes exploded rows to be as few as those that they come from,
    so it would broadcast the lines of a million documents by way of the driver."""
    return df.hint("merge")
