"""Standing queries: initial sets, deltas from the log, new scopes, resumption and the client's merged cache."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.catalog import TidelogError
from tidelog.functions.spatial import block
from tidelog.operators.changelog import as_of, by_ranges, preimages
from tidelog.operators.views import DELETE, INSERT, UPDATE
from tidelog.plans.analyze import MAX_SPAN, MAX_SUBSCRIPTIONS

Shown = Callable[[Callable[[str], Column]], Column]  # from a way to name columns, whether the row is seen


def initial_set(log: DataFrame, anchor: int, keys: list[str], shown: Shown) -> DataFrame:
    """The rows that a subscription starts with, at its anchor."""
    return as_of(log, anchor, keys).filter(shown(F.col)).drop("lsn")


def deltas(log: DataFrame, keys: list[str], shown: Shown, columns: list[str] | None = None, after: int | None = None, shown_before: Shown | None = None) -> DataFrame:
    """What a subscription sends: 0 to 1 insert, 1 to 1 update, 1 to 0 delete, 0 to 0 nothing. Pre-images chain within a record.

    columns: only these are sent, and an update that leaves them as they were isn't. shown_before: visibility of pre-images, where policies differ.
    """
    old = preimages(log, keys)
    was = F.coalesce(F.col("old_op").isin(INSERT, UPDATE) & (shown_before or shown)(lambda c: F.col(c) if c in keys else F.col("old")[c]), F.lit(False))
    now = F.coalesce((F.col("op") != DELETE) & shown(F.col), F.lit(False))
    kind = F.when(now & ~was, INSERT).when(now & was, UPDATE).when(was, DELETE)
    out = old.withColumn("delta", kind).filter(F.col("delta").isNotNull())
    if after is not None:
        out = out.filter(F.col("lsn") > after)
    rest = [c for c in log.columns if c not in ("lsn", "ordinal", "op", *keys)]
    if columns is not None:
        rest = [c for c in rest if c in columns]
        same = F.lit(True)
        for c in rest:
            same = same & F.col(c).eqNullSafe(F.col("old")[c])
        out = out.filter((F.col("delta") != UPDATE) | ~same)
    gone = F.col("delta") == DELETE
    return out.select("lsn", "ordinal", "delta", *keys, *(F.when(~gone, F.col(c)).alias(c) for c in rest))


#: Width of the bins that ranges and values meet in; ranges of subscriptions span at most MAX_SPAN, hence two bins.
BIN = MAX_SPAN


def fanout(log: DataFrame, subscriptions: DataFrame, keys: list[str]) -> DataFrame:
    """All deltas of many subscriptions: column = value, or low <= column <= high of an integer column. The log meets only those of its table and value.

    log has `value` and, where keys name it, table; subscriptions: sub and value, or sub, low and high, and table likewise. Ranges and values meet in bins,
    so both kinds are equi-joins, which Spark broadcasts while the subscriptions are small.
    """
    old = preimages(log, keys)
    was = old.filter(F.col("old_op").isin(INSERT, UPDATE)).select("lsn", "ordinal", *keys, F.col("old.value").alias("value"), F.lit(1).alias("was"), F.lit(0).alias("now"))
    now = old.filter(F.col("op") != DELETE).select("lsn", "ordinal", *keys, "value", F.lit(0).alias("was"), F.lit(1).alias("now"))
    rows, on = was.unionByName(now), ["table"] if "table" in keys else []
    if "value" in subscriptions.columns:
        sides = rows.join(subscriptions, [*on, "value"])
    else:
        bin_of = lambda c: block(F.col(c), BIN)
        binned = subscriptions.filter("low <= high").withColumn("_bin", F.explode(F.sequence(bin_of("low"), bin_of("high"))))
        sides = rows.withColumn("_bin", bin_of("value")).join(binned, [*on, "_bin"]).filter(F.col("value").between(F.col("low"), F.col("high")))
    both = sides.groupBy("sub", "lsn", "ordinal", *keys).agg(F.max("was").alias("was"), F.max("now").alias("now"))
    return both.select("sub", "lsn", "ordinal", *keys, F.when(F.col("now") == 0, DELETE).when(F.col("was") == 1, UPDATE).otherwise(INSERT).alias("delta"))


def rescope(state: DataFrame, key: str, before: Column, after: Column) -> DataFrame:
    """The diff of a subscription's new predicate: inserts of rows only the new one shows, deletes of those only the old one did. One pass, no join."""
    old, new = F.coalesce(before, F.lit(False)), F.coalesce(after, F.lit(False))
    return state.withColumn("delta", F.when(new & ~old, INSERT).when(old & ~new, DELETE)).filter(F.col("delta").isNotNull()).select("delta", key)


def reset_reconcile(local: DataFrame, snapshot: DataFrame, keys: list[str]) -> DataFrame:
    """Ops that turn local rows into a snapshot: puts of its rows, deletes of keys that it lacks."""
    gone = local.select(*keys).join(snapshot.select(*keys), keys, "left_anti").select(F.lit(DELETE).alias("op"), *keys)
    return snapshot.select(F.lit(UPDATE).alias("op"), *snapshot.columns).unionByName(gone, allowMissingColumns=True)


def resume(log: DataFrame, acked: int, keys: list[str], shown: Shown) -> DataFrame:
    """Deltas from the log alone, without pre-images: deletes as they are, visible ops by their own kind, hidden updates as deletes, hidden inserts not at all."""
    now = F.coalesce(shown(F.col), F.lit(False))
    kind = F.when(F.col("op") == DELETE, DELETE).when(now, F.col("op")).when(F.col("op") == UPDATE, DELETE)
    return log.filter(F.col("lsn") > acked).withColumn("delta", kind).filter(F.col("delta").isNotNull()).select("lsn", "ordinal", "delta", *keys)


RESUME_SECONDS = 300


def check_resume(epoch: str, log_epoch: str, acked: int, head: int, oldest_missed_age: float | None) -> None:
    """Refuses a cursor that the log can't serve; the client then starts anew."""
    if epoch != log_epoch:
        raise TidelogError("resync", "the log has another epoch")
    if acked > head:
        raise TidelogError("resync", "the cursor is beyond the log's head")
    if oldest_missed_age is not None and oldest_missed_age > RESUME_SECONDS:
        raise TidelogError("resync", "the missed records are too old")


def client_state(initial: DataFrame, sent: DataFrame, anchor: int, keys: list[str]) -> DataFrame:
    """What a client holds: the initial set, and what it was sent after the anchor, in order of arrival; absent deletes are ignored.

    Diffs of a new scope have lsn 0 and count from when they arrive, so they need the column arrival; without it deltas arrive in the order of lsns.
    """
    rest = [c for c in initial.columns if c not in keys]
    arrival = F.col("arrival" if "arrival" in sent.columns else "lsn").cast("long").alias("_at")
    base = initial.select(F.lit(-1).cast("long").alias("_at"), F.lit(0).cast("long").alias("ordinal"), F.lit(INSERT).alias("delta"), *keys, *rest)
    later = sent.filter((F.col("lsn") == 0) | (F.col("lsn") > anchor)).select(arrival, F.col("ordinal").cast("long"), "delta", *keys, *rest)
    last = base.unionByName(later).groupBy(*keys).agg(F.max_by(F.struct("delta", *rest), F.struct("_at", "ordinal")).alias("_last"))
    return last.filter(F.col("_last.delta") != DELETE).select(*keys, *(F.col(f"_last.{c}").alias(c) for c in rest))


class FramePump:
    """A client that applies what it was sent only when it is told to: frames wait in order, and each tick applies the next ones, at most so many.

    frames: frame (a number that rises), era, lsn, ordinal, delta, keys and columns. A resync begins a new era; frames of older ones are dead.
    """

    def __init__(self, initial: DataFrame, frames: DataFrame, anchor: int, keys: list[str]):
        self.initial, self.frames, self.anchor, self.keys, self.applied, self.era = initial, frames, anchor, keys, -1, 0

    def resync(self, initial: DataFrame, anchor: int) -> None:
        self.initial, self.anchor, self.era = initial, anchor, self.era + 1

    def tick(self, most: int) -> int:
        """Applies the next live frames; gives how many."""
        if most < 1:
            raise TidelogError("bad_argument", "a tick applies one frame at least")
        live = self.frames.filter((F.col("frame") > self.applied) & (F.col("era") >= self.era)).select("frame").distinct().orderBy("frame").limit(most)
        n = live.agg(F.count(F.lit(1)).alias("n"), F.max("frame").alias("last")).first()
        if n["n"]:
            self.applied = n["last"]
        return n["n"]

    def state(self) -> DataFrame:
        done = self.frames.filter((F.col("frame") <= self.applied) & (F.col("era") >= self.era)).withColumn("arrival", F.col("frame"))
        return client_state(self.initial, done, self.anchor, self.keys)


def cache_changes(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Changes of a cache merged over subscriptions. before, after: sub, key, value. First cover inserts, last uncover deletes, another value updates."""
    merged = lambda df, n: df.groupBy(key).agg(F.count_distinct("sub").alias(f"{n}_refs"), F.max("value").alias(f"{n}_value"))
    both = merged(before, "old").join(merged(after, "new"), key, "full_outer")
    change = F.when(F.col("old_refs").isNull(), INSERT).when(F.col("new_refs").isNull(), DELETE).when(~F.col("old_value").eqNullSafe(F.col("new_value")), UPDATE)
    return both.withColumn("change", change).filter(F.col("change").isNotNull()).select(key, "change", F.coalesce("new_refs", F.lit(0)).alias("refs"))


#: Fixed value: bytes of one chunk of an initial set.
CHUNK_BYTES = 256 << 10


def chunks(sized: DataFrame, key: str, size: str = "bytes", budget: int = CHUNK_BYTES) -> DataFrame:
    """Rows with the number of the chunk they go in, by the bytes of rows before them in key order. Sums of ranges first, so no task sees all rows.

    The rows are written once by ranges of the key, so both the sums and the rows have the same ranges.
    """
    ranged = by_ranges(sized, [key])
    totals = ranged.groupBy("_part").agg(F.sum(size).alias("_sum"))
    before = totals.select("_part", (F.sum("_sum").over(Window.orderBy("_part")) - F.col("_sum")).alias("_before"))  # one row a partition
    so_far = F.sum(size).over(Window.partitionBy("_part").orderBy(key).rowsBetween(Window.unboundedPreceding, 0)) - F.col(size) + F.col("_before")
    return ranged.join(F.broadcast(before), "_part").withColumn("chunk", F.floor(so_far / budget)).drop("_part", "_before")


class Registry:
    """The subscriptions of one connection."""

    def __init__(self, most: int = MAX_SUBSCRIPTIONS):
        self.most, self.live = most, {}

    def add(self, name: str, plan) -> None:
        old = self.live.get(name)
        if old is None and len(self.live) >= self.most:
            raise TidelogError("too_many_subscriptions", f"at most {self.most} subscriptions")
        if old is not None and (old.table.name != plan.table.name or old.columns != plan.columns):
            raise TidelogError("bad_rescope", "a new scope keeps table and columns")
        self.live[name] = plan

    def remove(self, name: str) -> bool:
        return self.live.pop(name, None) is not None


MAX_BUFFERED = 16 << 20


def backpressure(buffered: int, policy: str = "drop_and_resync", limit: int = MAX_BUFFERED) -> str:
    """What to do with a connection that has so many bytes waiting: send, resync, buffer or disconnect."""
    if buffered <= limit:
        return "send"
    return {"drop_and_resync": "resync", "buffer": "buffer", "disconnect": "disconnect"}[policy]
