"""Streams: the work queue's status, message states and the failure limiter."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quire.operators.folds import limited

#: Attempts of a part that the limiter gives out at once.
PART = 50_000


def job_states(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """The latest state of each job of a stream (job, at, state), for update or complete mode."""
    return events.withWatermark("at", late).groupBy("job").agg(F.max_by("state", "at").alias("state"), F.max("at").alias("at"))


def activity(events: DataFrame, unit: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by user and window; windows close once the watermark has passed them."""
    return events.withWatermark("at", late).groupBy(F.window("at", unit).alias("w"), "user").agg(F.count(F.lit(1)).alias("n")).select("w.start", "user", "n")


def limiter(attempts: DataFrame, limit: int = 10, seconds: int = 900, late: str = "15 minutes") -> DataFrame:
    """For each attempt of a stream (key, at, ok) whether its key was blocked by limit failures within the look-back; a
    success clears the key. The state is the failures of the look-back, at most limit of them; it expires once the
    watermark has passed it."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        failures: list[int] = list(state.get[0]) if state.exists else []
        if state.hasTimedOut:
            state.remove()
            return
        # a key's attempts are held as arrays of times and outcomes, nine bytes each, and given out in parts
        at, ok = map(np.concatenate, zip(*((b["at"].to_numpy("datetime64[us]"), b["ok"].to_numpy(bool)) for b in batches), strict=True))
        order = np.argsort(at, kind="stable")
        at, ok = at[order], ok[order]
        for start in range(0, len(at), PART):
            now, good = at[start : start + PART], ok[start : start + PART]
            told = []
            for micros, fine in zip(now.astype("int64").tolist(), good.tolist(), strict=True):
                failures, _, blocked, _ = limited(failures, micros, fine, limit, seconds * 1_000_000)
                told.append(blocked)
            yield pd.DataFrame({"key": key[0], "at": now.astype("datetime64[ns]"), "blocked": told})
        state.update((failures,))
        state.setTimeoutTimestamp(max(int(pd.Series(at).max().timestamp() * 1000), state.getCurrentWatermarkMs()) + seconds * 1000)

    return attempts.withWatermark("at", late).groupBy("key").applyInPandasWithState(step, "key string, at timestamp, blocked boolean", "failures array<long>", "append", GroupStateTimeout.EventTimeTimeout)
