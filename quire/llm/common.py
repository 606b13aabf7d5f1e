"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import math
import tempfile
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Code points of text that a Python worker handles at once.
BATCH_CHARS = 400_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a temporary one where it is unset on a single machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return tempfile.mkdtemp(prefix="quire-")


def cut(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut by a reliable checkpoint.

    It is written to shared_folder().
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(spark))
    out = df.checkpoint()
    # lets Spark's cleaner drop the shuffle files and older checkpoints that nothing refers to any more
    context._jvm.System.gc()
    return out


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have yet, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def slices(rows: Iterable, weight, limit: int = BATCH_CHARS) -> Iterator[list]:
    """Consecutive lists of rows whose weights sum to about limit; a row over the limit comes alone."""
    group: list = []
    total = 0
    for row in rows:
        w = weight(row)
        if group and total + w > limit:
            yield group
            group, total = [], 0
        group.append(row)
        total += w
    if group:
        yield group


def global_rank(df: DataFrame, keys: list[str], bucket: str, n_buckets: int, order: list[str], name: str) -> DataFrame:
    """Adds name: the exact 0-based rank within keys by (bucket, *order).

    bucket must be an int from 0 to n_buckets - 1 that rises with the wanted order. No key's rows meet in one task:
    rows are counted by bucket, the counts are summed up in two levels, and only rows of one bucket are sorted together.
    """
    wide = max(1, math.isqrt(n_buckets))
    fine = df.groupBy(*keys, bucket).agg(F.count(F.lit(1)).alias("_rank_n")).withColumn("_rank_wide", F.floor(F.col(bucket) / wide))
    coarse = fine.groupBy(*keys, "_rank_wide").agg(F.sum("_rank_n").alias("_rank_wide_n"))
    before = lambda parts, by: Window.partitionBy(*parts).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    coarse = coarse.withColumn("_rank_from", F.coalesce(F.sum("_rank_wide_n").over(before(keys, "_rank_wide")), F.lit(0))).drop("_rank_wide_n")
    fine = fine.withColumn("_rank_in", F.coalesce(F.sum("_rank_n").over(before([*keys, "_rank_wide"], bucket)), F.lit(0)))
    on = [fine[k].eqNullSafe(coarse[k]) for k in [*keys, "_rank_wide"]]
    offsets = fine.join(coarse, on).select(*[fine[k].alias(f"_rank_k{i}") for i, k in enumerate([*keys, bucket])], (F.col("_rank_in") + F.col("_rank_from")).alias("_rank_offset"))
    within = F.row_number().over(Window.partitionBy(*keys, bucket).orderBy(*order)) - 1
    ranked = df.withColumn("_rank_row", within)
    on = [ranked[k].eqNullSafe(offsets[f"_rank_k{i}"]) for i, k in enumerate([*keys, bucket])]
    return ranked.join(offsets, on).withColumn(name, F.col("_rank_row") + F.col("_rank_offset")).drop("_rank_row", "_rank_offset", *[f"_rank_k{i}" for i in range(len(keys) + 1)])
