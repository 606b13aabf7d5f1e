"""Folds over sorted rows: state machines that look at the last event they kept.

Rows are dealt out by key and sorted within their partition; a key's state is all that a worker holds of it, so a key may
have any number of rows. The steps are plain functions, shared by batches and streams.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

Step = Callable[..., tuple]


def sorted_fold(rows: DataFrame, keys: list[str], order: list[str], make: Callable[[], Step], added: str) -> DataFrame:
    """rows with the columns added (as DDL): for each key a step from make() is called with the columns of order and then
    all others, as keyword arguments, in order; it returns the values of the added columns."""
    new = StructType.fromDDL(added)
    schema = StructType([*rows.schema.fields, *new.fields])
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, step = None, None
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            out = []
            for row in zip(*columns, strict=True):
                named = dict(zip(names, row, strict=True))
                key = tuple(named[k] for k in keys)
                if step is None or key != now:
                    now, step = key, make()
                out.append(step(**named))
            made = [pa.array([o[i] for o in out]) for i in range(len(new.fields))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *[m.cast(t) for m, t in zip(made, _arrow(new), strict=True)]], [*names, *[f.name for f in new.fields]])

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def _arrow(fields) -> list[pa.DataType]:
    kinds = {"long": pa.int64(), "bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string(), "double": pa.float64()}
    return [kinds[f.dataType.simpleString()] for f in fields.fields]


def limited(failures: list[int], now: int, ok: bool, limit: int, window: int, clears: bool = True) -> tuple[list[int], int, bool, int | None]:
    """One attempt against the failures of the look-back: what is kept of them, how many there were, whether the attempt is
    blocked, and the seconds to wait. A blocked attempt neither counts nor clears; times are microseconds."""
    kept = [f for f in failures if now - f < window]
    blocked = len(kept) >= limit
    wait = (window - (now - kept[0])) // 1_000_000 + 1 if blocked else None
    after = kept if blocked else ([] if clears else kept) if ok else [*kept, now]
    return after, len(kept), blocked, wait


def rate_limit(attempts: DataFrame, key: str, at: str, seq: str, ok: Column, limit: int, seconds: int, clears: bool = True) -> DataFrame:
    """attempts with failures (of the key in the look-back), blocked and wait_s; a success clears the key if clears."""
    rows = attempts.withColumns({"_at": F.unix_micros(F.col(at).cast("timestamp")), "_ok": ok})

    def make() -> Step:
        state: list[int] = []

        def step(_at: int, _ok: bool, **_: object) -> tuple:
            nonlocal state
            state, n, blocked, wait = limited(state, _at, _ok, limit, seconds * 1_000_000, clears)
            return n, blocked, wait

        return step

    return sorted_fold(rows, [key], ["_at", seq], make, "failures int, blocked boolean, wait_s bigint").drop("_at", "_ok")


def login_limit(attempts: DataFrame, ip: str, email: str, at: str, seq: str, ok: Column, limit: int = 10, seconds: int = 900) -> DataFrame:
    """attempts (told apart by seq) with blocked and wait_s from two folds: by address, which a success doesn't clear, and by
    e-mail, which it does. Each fold counts what its own key doesn't block."""
    one = rate_limit(attempts, ip, at, seq, ok, limit, seconds, clears=False).withColumnsRenamed({"blocked": "_b1", "wait_s": "_w1"}).drop("failures")
    two = rate_limit(attempts, email, at, seq, ok, limit, seconds).select(seq, F.col("blocked").alias("_b2"), F.col("wait_s").alias("_w2"))
    return one.join(two, seq).withColumn("blocked", F.col("_b1") | F.col("_b2")).withColumn("wait_s", F.greatest("_w1", "_w2")).drop("_b1", "_b2", "_w1", "_w2")


def kept_activity(events: DataFrame, key: str, at: str, seq: str, ip: str, seconds: int = 60) -> DataFrame:
    """events with kept: whether seconds have passed since the last kept one of the key, or its address is another."""
    rows = events.withColumn("_at", F.unix_micros(F.col(at).cast("timestamp")))

    def make() -> Step:
        last: tuple | None = None

        def step(_at: int, **row: object) -> tuple:
            nonlocal last
            keep = last is None or _at - last[0] >= seconds * 1_000_000 or row[ip] != last[1]
            if keep:
                last = (_at, row[ip])
            return (keep,)

        return step

    return sorted_fold(rows, [key], ["_at", seq], make, "kept boolean").drop("_at")


def kept_openings(events: DataFrame, key: str, at: str, seq: str, user: str) -> DataFrame:
    """events with kept: unless the last kept opening of the key is of the same minute and user."""
    rows = events.withColumn("_minute", F.date_format(at, "yyyy-MM-dd HH:mm"))

    def make() -> Step:
        last: tuple | None = None

        def step(_minute: str, **row: object) -> tuple:
            nonlocal last
            now = (_minute, row[user])
            keep, last = now != last, now
            return (keep,)

        return step

    return sorted_fold(rows, [key], [at, seq], make, "kept boolean").drop("_minute")


