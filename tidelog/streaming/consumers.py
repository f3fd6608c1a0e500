"""Consumers of the change log as Structured Streaming queries: each has its checkpoint, gets commits in micro-batches and catches up after a stop.

The stream is that of the log's entries, one small file a commit, in lsn order; a batch then reads the data of its entries only. Applying is at least once,
so every applier writes the same for a repeated batch.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from typing import Any

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidelog.operators.changelog import fold
from tidelog.operators.subscriptions import Shown, backpressure, deltas
from tidelog.operators.views import DELETE, INSERT
from tidelog.sources.log import ENTRY_SCHEMA, ChangeLog, delete, hadoop, read_text, write_text

#: Attempts after the first, and seconds before the next; events that wait for one subscriber.
RETRIES, BACKOFF, EVENT_WINDOW = 3, 0.5, 10_000
#: Parts of a projected table: a batch rewrites those that its keys fall in.
BUCKETS = 64

Apply = Callable[[ChangeLog, list[dict], int], None]


def consume(log: ChangeLog, checkpoint: str, apply: Apply, files: int | None = None, available_now: bool = True) -> StreamingQuery:
    """Runs apply(log, entries, batch number) over commits that weren't consumed yet. files: commits in a micro-batch at most, which holds back who is behind.

    Pause is stop(); the same checkpoint resumes.
    """
    reader = log.spark.readStream.schema(ENTRY_SCHEMA)
    if files:
        reader = reader.option("maxFilesPerTrigger", files)

    def run(batch: DataFrame, number: int) -> None:
        # one row a commit: what a driver lists anyway
        entries = sorted((r.asDict() for r in batch.collect()), key=lambda e: e["first"])
        if entries:
            apply(log, entries, number)

    writer = reader.json(f"{log.log.path}/commits").writeStream.option("checkpointLocation", checkpoint).foreachBatch(run)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


class Projection:
    """A table's state in a folder, by buckets of its keys. A manifest of each batch names the version of every bucket; versions that it left alone are kept."""

    def __init__(self, log: ChangeLog, folder: str, buckets: int = BUCKETS):
        self.log, self.folder, self.buckets = log, folder.rstrip("/"), buckets

    def _bucket(self):
        return F.pmod(F.xxhash64(*self.log.keys), F.lit(self.buckets)).cast("int")

    def manifest(self, before: int | None = None) -> dict:
        """The newest complete one, or that before a batch."""
        fs, p = hadoop(self.log.spark, f"{self.folder}/manifests")
        names = sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []
        names = [n for n in names if n.endswith(".json") and (before is None or int(n[:-5]) < before)]
        return json.loads(read_text(self.log.spark, f"{self.folder}/manifests/{names[-1]}")) if names else {"applied": 0, "paths": {}, "epoch": None}

    def applied(self) -> int:
        return self.manifest()["applied"]

    def _read(self, paths: list[str]) -> DataFrame:
        return self.log.spark.read.schema(self.log.schema).parquet(*paths) if paths else self.log.spark.createDataFrame([], self.log.schema)

    def read(self) -> DataFrame:
        return self._read(sorted(self.manifest()["paths"].values()))

    def of_keys(self, ops: DataFrame, number: int) -> tuple[DataFrame, list[int], dict]:
        """State before a batch in the buckets that the ops touch, the buckets, and the manifest before."""
        had = self.manifest(number)
        touched = sorted(r[0] for r in ops.select(self._bucket()).distinct().collect())
        return self._read([had["paths"][str(b)] for b in touched if str(b) in had["paths"]]), touched, had

    def apply(self, log: ChangeLog, entries: list[dict], number: int) -> None:
        """The touched buckets with the batch's last ops over them, as new versions."""
        ops = log.of([e for e in entries if e["last"] > self.manifest(number)["applied"]])
        before, touched, had = self.of_keys(ops, number)
        now = fold(as_log(before).unionByName(ops), log.keys).select(*log.schema.names)
        paths = dict(had["paths"])
        if touched:
            target = f"{self.folder}/data/{number:09d}"
            now.withColumn("_bucket", self._bucket()).repartition(len(touched), "_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(target)
            fs, _ = hadoop(log.spark, target)
            for b in touched:
                path = f"{target}/_bucket={b}"
                if fs.exists(hadoop(log.spark, path)[1]):
                    paths[str(b)] = path
                else:
                    paths.pop(str(b), None)
        self._publish(number, max(e["last"] for e in entries), paths)

    def _publish(self, number: int, applied: int, paths: dict) -> None:
        write_text(self.log.spark, f"{self.folder}/manifests/{number:09d}.json", json.dumps({"applied": applied, "paths": paths, "epoch": self.log.log.epoch()}))

    def bootstrap(self, number: int = 0) -> int:
        """Clears the projection and loads it from the log's state at its head: for a new one, one of another epoch, or one whose next record is truncated."""
        fs, _ = hadoop(self.log.spark, self.folder)
        delete(self.log.spark, self.folder)
        head = self.log.head()
        target = f"{self.folder}/data/{number:09d}"
        self.log.state(head).withColumn("_bucket", self._bucket()).repartition(self.buckets, "_bucket").write.partitionBy("_bucket").parquet(target)
        there = [s.getPath().getName() for s in fs.listStatus(hadoop(self.log.spark, target)[1])]
        self._publish(number, head, {n.split("=")[1]: f"{target}/{n}" for n in there if n.startswith("_bucket=")})
        return head

    def catch_up(self, files: int | None = None) -> int:
        """Applies what is new; begins anew where the log no longer has the next record, or is another one. Gives the lsn applied."""
        log, had = self.log.log, self.manifest()
        if had["applied"] < log.floor(again=True) or had["epoch"] not in (None, log.epoch()):
            delete(self.log.spark, f"{self.folder}-checkpoint")
            return self.bootstrap()
        consume(self.log, f"{self.folder}-checkpoint", self.apply_next, files).awaitTermination()
        return self.applied()

    def apply_next(self, log: ChangeLog, entries: list[dict], number: int) -> None:
        """apply() under a number of its own, which goes on after a bootstrap; a batch that was applied before changes nothing."""
        had = self.manifest()
        new = [e for e in entries if e["last"] > had["applied"]]
        if new:
            fs, p = hadoop(log.spark, f"{self.folder}/manifests")
            last = max((int(s.getPath().getName()[:-5]) for s in fs.listStatus(p) if s.getPath().getName().endswith(".json")), default=-1) if fs.exists(p) else -1
            self.apply(log, new, last + 1)


def as_log(state: DataFrame) -> DataFrame:
    """State rows as inserts before all records."""
    return state.select(F.lit(0).cast("long").alias("lsn"), F.lit(-1).cast("long").alias("ordinal"), F.lit(INSERT).cast("int").alias("op"), *(F.col(f"`{c}`") for c in state.columns))


def delta_sink(log: ChangeLog, folder: str, shown: Shown, columns: list[str] | None = None) -> Apply:
    """Writes each batch's deltas of a subscription. Pre-images come from a projection beside it, whose touched buckets alone are read."""
    state = Projection(log, f"{folder}-state")

    def apply(log: ChangeLog, entries: list[dict], number: int) -> None:
        ops = log.of(entries)
        before, touched, _ = state.of_keys(ops, number)
        if touched:
            old = before.join(ops.select(*log.keys).distinct(), log.keys, "left_semi")
            deltas(as_log(old).unionByName(ops), log.keys, shown, columns, after=entries[0]["first"] - 1).write.mode("overwrite").parquet(f"{folder}/{number:09d}")
        state.apply(log, entries, number)

    return apply


def frames(folder: str, spark: SparkSession, after: int, upto: int, max_bytes: int, policy: str = "drop_and_resync") -> tuple[str, DataFrame | None]:
    """What a connection that has acknowledged `after` is sent of a delta sink: its deltas if they take at most max_bytes, else what the policy says."""
    rows = spark.read.parquet(f"{folder}/*").filter(F.col("lsn").between(after + 1, upto))
    waiting = rows.agg(F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0))).first()[0]
    what = backpressure(waiting, policy, max_bytes)
    return what, rows.orderBy("lsn", "ordinal") if what in ("send", "buffer") else None


class RelationalSink:
    """A table kept in a relational database through a DB-API connection. Rows and the applied lsn go in one of its transactions, so each batch counts once.

    connect: gives a connection. The log's state goes in anew where the sink is behind the log's floor or was filled from another epoch.
    """

    CHUNK = 1000

    def __init__(self, log: ChangeLog, connect: Callable[[], Any], table: str, mark: str = "?"):
        self.log, self.connect, self.table, self.mark = log, connect, table, mark

    def _prepare(self, c: Any) -> None:
        c.execute("create table if not exists tidelog_applied (name varchar(200) primary key, lsn bigint, epoch varchar(64))")
        columns = ", ".join(f"{f.name} {self._type(f.dataType.simpleString())}" for f in self.log.schema)
        c.execute(f"create table if not exists {self.table} ({columns}, primary key ({', '.join(self.log.keys)}))")

    @staticmethod
    def _type(kind: str) -> str:
        return {"string": "varchar", "binary": "blob", "double": "double precision", "float": "real", "timestamp_ntz": "timestamp", "tinyint": "smallint", "int": "integer"}.get(kind, kind)

    def applied(self, c: Any) -> tuple[int, str | None]:
        row = c.execute(f"select lsn, epoch from tidelog_applied where name = {self.mark}", (self.table,)).fetchone()
        return (row[0], row[1]) if row else (0, None)

    def _checkpoint(self, c: Any, lsn: int) -> None:
        c.execute(f"delete from tidelog_applied where name = {self.mark}", (self.table,))
        c.execute(f"insert into tidelog_applied values ({self.mark}, {self.mark}, {self.mark})", (self.table, lsn, self.log.log.epoch()))

    def _put(self, c: Any, rows: Iterator[tuple], replace: bool) -> None:
        names, keys = self.log.schema.names, self.log.keys
        marks = ", ".join([self.mark] * len(names))
        where = " and ".join(f"{k} = {self.mark}" for k in keys)
        at = [names.index(k) for k in keys]
        chunk: list[tuple] = []

        def flush():
            if replace and chunk:
                c.executemany(f"delete from {self.table} where {where}", [tuple(r[1 + i] for i in at) for r in chunk])
            if put := [r[1:] for r in chunk if r[0] != DELETE]:
                c.executemany(f"insert into {self.table} values ({marks})", put)
            chunk.clear()

        for r in rows:
            chunk.append(tuple(bytes(v) if isinstance(v, bytearray) else v for v in r))
            if len(chunk) >= self.CHUNK:
                flush()
        flush()

    def apply(self, log: ChangeLog, entries: list[dict], number: int) -> None:
        connection = self.connect()
        c = connection.cursor()
        try:
            self._prepare(c)
            lsn, epoch = self.applied(c)
            new = [e for e in entries if e["last"] > lsn]
            if lsn < log.log.floor(again=True) or epoch not in (None, log.log.epoch()):
                # the next record is gone, or the log is another one: everything anew, at one lsn
                head = log.head()
                c.execute(f"delete from {self.table}")
                self._put(c, log.state(head).select(F.lit(INSERT), *log.schema.names).toLocalIterator(), False)
                self._checkpoint(c, head)
            elif new:
                last = log.of(new).groupBy(*log.keys).agg(F.max_by(F.struct("op", *log.schema.names), F.struct("lsn", "ordinal")).alias("r"))
                self._put(c, last.select("r.op", *(F.col("r")[n].alias(n) for n in log.schema.names)).toLocalIterator(), True)
                self._checkpoint(c, new[-1]["last"])
            connection.commit()
        except BaseException:
            connection.rollback()
            raise
        finally:
            connection.close()


def deliver(handler: Callable[[dict], None], dead_letters: str, retries: int = RETRIES, backoff: float = BACKOFF, sleep: Callable[[float], None] = time.sleep, window: int = EVENT_WINDOW) -> Apply:
    """Hands events to a handler one by one in order; one that keeps failing goes to the dead letters as a JSON line.

    At most `window` events are on the driver at a time; the rest of a subscriber that is behind waits in the log.
    """

    def apply(log: ChangeLog, entries: list[dict], number: int) -> None:
        failed, waiting = [], []

        def drain():
            for event in waiting:
                for attempt in range(retries + 1):
                    try:
                        handler(event)
                        break
                    except Exception as e:  # noqa: BLE001  a handler may raise anything
                        if attempt == retries:
                            failed.append(json.dumps(event | {"error": str(e), "attempts": attempt + 1}, default=str))
                        else:
                            sleep(backoff * 2**attempt)
            waiting.clear()

        for row in log.of(entries).filter(F.col("op") != DELETE).orderBy("lsn", "ordinal").toLocalIterator():
            waiting.append(row.asDict())
            if len(waiting) >= window:
                drain()
        drain()
        if failed:
            log.spark.createDataFrame([(x,) for x in failed], "value string").write.mode("overwrite").text(f"{dead_letters}/{number:09d}")

    return apply


class Forwarder:
    """Ships one log's events to another database, as records of a table there: lsn by lsn, at least once, and each kept once by its source and lsn.

    The cursor, all at or below which has been shipped, is a holder of the source's log.
    """

    def __init__(self, events: ChangeLog, source: str, folder: str, records: int = 256):
        self.events, self.source, self.path, self.records = events, source, f"{folder}/cursor-{source}.json", records

    def cursor(self) -> int:
        fs, p = hadoop(self.events.spark, self.path)
        known = json.loads(read_text(self.events.spark, self.path)) if fs.exists(p) else {}
        return known["lsn"] if known.get("epoch") == self.events.log.epoch() else self.events.log.floor()

    def forward_once(self, send: Callable[[DataFrame, int], None]) -> bool:
        """Sends the events of the next records (source, lsn, ordinal, kind, body) with the lsn they reach; False: nothing was left."""
        at, head = self.cursor(), self.events.head()
        if at >= head:
            return False
        upto = min(head, at + self.records)
        rows = self.events.read(at, upto).select(F.lit(self.source).alias("source"), "lsn", "ordinal", "kind", "body")
        if not rows.isEmpty():
            send(rows, upto)
        write_text(self.events.spark, self.path, json.dumps({"lsn": upto, "epoch": self.events.log.epoch()}))
        return True

    def drain(self, send: Callable[[DataFrame, int], None]) -> int:
        while self.forward_once(send):
            pass
        return self.cursor()


def accepted(known: DataFrame, shipped: DataFrame) -> DataFrame:
    """What a receiver adds of shipped events: those that it doesn't have by source, lsn and ordinal, each once."""
    key = ["source", "lsn", "ordinal"]
    return shipped.dropDuplicates(key).join(known.select(*key), key, "left_anti")


class Residency:
    """Tables kept as their residency asks: resident in memory, paged on disk, auto by their bytes; each can be promoted or demoted while it is used."""

    LIMIT = 8 << 20

    def __init__(self):
        self.kept: dict[str, DataFrame] = {}

    def keep(self, name: str, df: DataFrame, residency: str, size: int = 0) -> DataFrame:
        level = {"resident": StorageLevel.MEMORY_ONLY, "paged": StorageLevel.DISK_ONLY}.get(residency) or (StorageLevel.MEMORY_ONLY if size <= self.LIMIT else StorageLevel.DISK_ONLY)
        self.drop(name)
        self.kept[name] = df.persist(level)
        return self.kept[name]

    def promote(self, name: str) -> DataFrame:
        return self.keep(name, self.kept[name], "resident")

    def demote(self, name: str) -> DataFrame:
        return self.keep(name, self.kept[name], "paged")

    def where(self, name: str) -> str | None:
        if name not in self.kept:
            return None
        return "memory" if self.kept[name].storageLevel.useMemory else "disk"

    def drop(self, name: str) -> None:
        if name in self.kept:
            self.kept.pop(name).unpersist()
