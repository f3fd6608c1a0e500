"""Timers: when rows are due, what an overrun does, and what is caught up after downtime. Times are microseconds."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SKIP, COALESCE, RUN = "skip", "coalesce", "run_immediately"


def due(is_interval: Column, micros: Column, committed: Column) -> Column:
    """One-shot timers are due at their instant, intervals one interval after their commit."""
    return F.when(is_interval, committed + micros).otherwise(micros)


def overrun(due_at: Column, interval: Column, now: Column, policy: str) -> Column:
    """The next due time of an interval timer that fires at now."""
    return {SKIP: now + interval, COALESCE: now, RUN: due_at + interval}[policy]


def missed(due_at: Column, interval: Column, now: Column) -> Column:
    """Whole intervals gone by since a timer was due."""
    return F.floor((now - due_at) / interval).cast("long")


def catch_up(timers: DataFrame, now: int, every: bool) -> DataFrame:
    """Firings owed after downtime: one of each due timer, or one for each interval missed. timers: id, due, interval (null: one-shot)."""
    late = timers.filter(F.col("due") <= now)
    if not every:
        return late.select("id", F.col("due").alias("fires"))
    times = F.when(F.col("interval").isNull(), F.array("due")).otherwise(F.sequence("due", F.lit(now), F.col("interval")))
    return late.select("id", F.explode(times).alias("fires"))


def dispatch_order(timers: DataFrame, now: int) -> DataFrame:
    """Due timers, earliest first; equal ones by id."""
    return timers.filter(F.col("due") <= now).orderBy("due", "id")


#: Calls a second and burst of the rate limiter.
RATE, BURST = 20.0, 60.0


def rate_limited(calls: DataFrame, keys: list[str], rate: float = RATE, burst: float = BURST) -> DataFrame:
    """Whether each call passes its key's token bucket. calls: keys, at (seconds), n (order).

    A recurrence along each key's calls: they are sorted within partitions and run through once, with the bucket as the only state, so neither a key's
    calls nor anything that grows with them is ever held.
    """
    rows = calls.select(*keys, F.col("n").cast("long").alias("n"), F.col("at").cast("double").alias("at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, tokens, last = None, burst, None
        for b in batches:
            allowed = []
            for *k, at in zip(*(b.column(c).to_pylist() for c in [*keys, "at"]), strict=True):
                if k != key:
                    key, tokens, last = k, burst, None
                if last is not None:
                    tokens = min(burst, tokens + (at - last) * rate)
                last = at
                allowed.append(tokens >= 1)
                if allowed[-1]:
                    tokens -= 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(allowed, pa.bool_())], names=[*b.schema.names, "allowed"])

    schema = T.StructType([*rows.schema.fields, T.StructField("allowed", T.BooleanType())])
    return rows.repartition(*keys).sortWithinPartitions(*keys, "at", "n").mapInArrow(run, schema)


def expired(checkpoints: DataFrame, registered: DataFrame, now: int, idle: int = 604_800) -> DataFrame:
    """Subscribers that aren't registered and whose checkpoint is older than idle seconds."""
    return checkpoints.join(registered.select("name"), "name", "left_anti").filter(F.lit(now) - F.col("touched") > idle)
