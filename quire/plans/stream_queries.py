"""Queries that run the stream operators over the events table as a file stream, up to what is there now."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import shared
from quire.streaming import queues

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]").withColumn("at", F.col("ts").cast("timestamp"))


def _folder(spark: SparkSession) -> str:
    return f"{shared.folder(spark)}/stream-{uuid.uuid4().hex}"


def _whole(df: DataFrame) -> DataFrame:
    """The result table of an aggregating stream, replaced at each batch."""
    spark, base = df.sparkSession, _folder(df.sparkSession)
    write = lambda batch, _: batch.write.mode("overwrite").parquet(f"{base}/rows")
    df.writeStream.foreachBatch(write).outputMode("complete").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{base}/rows")


def _appended(df: DataFrame) -> DataFrame:
    spark, base = df.sparkSession, _folder(df.sparkSession)
    df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start(f"{base}/rows").awaitTermination()
    return spark.read.parquet(f"{base}/rows")


@query("SELECT event_id % 500 AS job, arg_max(event_type, ts) AS state FROM events GROUP BY event_id % 500")
def stream_job_states(spark, sf_dir):
    jobs = _events(spark, sf_dir).select((F.col("event_id") % 500).alias("job"), "at", F.col("event_type").alias("state"))
    return _whole(queues.job_states(jobs)).select("job", "state")


@query("SELECT CAST(date_trunc('hour', ts) AS VARCHAR) AS start, user_id % 20 AS \"user\", count(*) AS n FROM events GROUP BY ALL")
def stream_activity(spark, sf_dir):
    events = _events(spark, sf_dir).select("at", (F.col("user_id") % 20).alias("user"))
    return _whole(queues.activity(events)).select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "user", "n")


@query()
def stream_limiter(spark, sf_dir):
    """Blocked attempts by the stateful limiter; a test holds it against a plain fold."""
    attempts = _events(spark, sf_dir).select((F.col("user_id") % 10).cast("string").alias("key"), "at", (F.col("event_type") == "purchase").alias("ok"))
    return _appended(queues.limiter(attempts, 3, 3600))
