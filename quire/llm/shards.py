"""Sharding by proportional stratified interleaving, in DataFrame operations only.

Rows of each source are ranked in a seeded shuffle; row r (from 0) of a source of n rows stands at (r + 1/2) / n; all
rows in that order are cut into shards whose counts are at most one apart, so each shard has the mixture of the whole.

Defined results: null sources form a source of their own; rows that tie, repeated ones included, are told apart by the
shuffle key, the id and a hash of all columns, and only equal rows may swap places; null ids are shuffled by all columns; a null text has the size
1 and the checksum of an empty text; an empty table gives no rows; other columns are kept, and helper columns avoid
their names; a column named shard or slot, in whatever case, is an error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, global_rank

SHARDS = 16
SEED = 17
#: Rows that are meant to be sorted together; the number of buckets follows from it.
BUCKET_ROWS = 250


def interleave(df: DataFrame, n_shards: int = SHARDS, seed: int = SEED, id_col: str = "doc_id", source_col: str = "source", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """df with shard (int from 0) and slot (long, gapless from 0 within its shard).

    No source is gathered in one task: ranks come from bucket counts (global_rank), and the only numbers the driver
    gets are the row count.
    """
    for name in ("shard", "slot"):
        if free_name(df, name) != name:
            raise ValueError(f"column {name} exists")
    n = df.count()
    buckets = max(1, -(-n // bucket_rows))
    cols = [f"_c{i}" for i in range(len(df.columns))]
    source, row_id = (cols[df.columns.index(c)] for c in (source_col, id_col))
    rows = df.toDF(*cols)
    # rows that tie are told apart by all their columns, so that a stage that is run again gives the same ranks; rows
    # without an id are shuffled by all their columns, so that they don't meet in one bucket
    rows = rows.withColumn("_all", F.xxhash64(*cols))
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(row_id).cast("string"), F.hex("_all"))).cast("binary"))
    rows = rows.withColumn("_key", key).withColumn("_bucket", F.floor(F.conv(F.substring("_key", 1, 8), 16, 10).cast("long") * F.lit(buckets) / F.lit(2**32)).cast("int"))
    rows = global_rank(rows, [source], "_bucket", buckets, ["_key", row_id, "_all"], "_rank")
    sizes = rows.groupBy(source).agg(F.count(F.lit(1)).alias("_n")).withColumnRenamed(source, "_source")
    rows = rows.join(sizes, rows[source].eqNullSafe(sizes["_source"])).drop("_source")
    rows = rows.withColumn("_at", (F.col("_rank") * 2 + 1) / (F.col("_n") * 2)).withColumn("_bucket", F.floor(F.col("_at") * F.lit(buckets)).cast("int"))
    rows = global_rank(rows, [], "_bucket", buckets, ["_at", "_key", row_id, "_all"], "_place")
    shard = F.expr(f"_place * {n_shards} div {max(n, 1)}")
    slot = F.col("_place") - F.expr(f"(shard * {max(n, 1)} + {n_shards - 1}) div {n_shards}")
    out = rows.withColumn("shard", shard.cast("int")).withColumn("slot", slot.cast("long"))
    return out.select(*[F.col(c).alias(name) for c, name in zip(cols, df.columns, strict=True)], "shard", "slot")
