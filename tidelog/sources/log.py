"""The database's change log: one record a commit, over all tables and the events they caused, with snapshots, truncation, archives and restores.

  data/<id>/<table>/*.parquet   what a commit writes of a table, or of _events: record, ordinal, op and the table's columns
  commits/<first lsn>.json      one entry a commit: first and last lsn, its data's id, tables, time
  snapshots/<lsn>/<table>/      state at an lsn; complete where done.json lies beside the tables
  floor.json, epoch             what was truncated; the log's id, new for every restore

Data is written first and isn't seen by any reader. An entry is then created under the next lsn's name, which succeeds for one writer only: a hard link on
local disks, a rename that doesn't replace elsewhere. So a commit is there as a whole or not at all, and lsns have neither gaps nor doubles, whoever
writes at the same time. A writer that finds its name taken looks at the log again and takes the next, or gives up where it needs the state it has read.
"""

from __future__ import annotations

import io
import json
import threading
import time
import uuid
from collections.abc import Iterable
from dataclasses import dataclass
from decimal import Decimal
from typing import Any

import pyarrow as pa
import pyarrow.parquet as pq
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidelog.catalog import TidelogError
from tidelog.operators.changelog import contiguity, fold, replay, truncation_floor

EVENTS = "_events"
EVENT_SCHEMA = T.StructType([T.StructField("kind", T.StringType()), T.StructField("body", T.StringType())])
HEAD = [T.StructField("record", T.LongType()), T.StructField("ordinal", T.LongType()), T.StructField("op", T.IntegerType())]
#: Entries as a stream of files has them.
ENTRY_SCHEMA = "first long, last long, data string, tables array<string>, at long"


class Conflict(Exception):
    """Another commit came first."""


def hadoop(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def read_text(spark: SparkSession, path: str) -> str:
    """A small text file in any store that Spark reads."""
    fs, p = hadoop(spark, path)
    stream = fs.open(p)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    fs, p = hadoop(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    write_bytes(spark, path, text.encode())


def delete(spark: SparkSession, path: str) -> None:
    fs, p = hadoop(spark, path)
    fs.delete(p, True)


def create_new(spark: SparkSession, root: str, name: str, text: str) -> bool:
    """Makes root/name with this text, whole, unless it exists; of several writers one succeeds."""
    jvm = spark.sparkContext._jvm
    temp = f"{root}/staged/{uuid.uuid4().hex}"
    write_text(spark, temp, text)
    fs, source = hadoop(spark, temp)
    _, target = hadoop(spark, f"{root}/{name}")
    fs.mkdirs(target.getParent())
    try:
        if fs.getScheme() == "file":
            where = [jvm.java.nio.file.Paths.get(fs.makeQualified(p).toUri()) for p in (target, source)]
            jvm.java.nio.file.Files.createLink(*where)
        else:
            context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
            option = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
            option[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
            context.rename(source, target, option)
    except Py4JJavaError as e:
        if "FileAlreadyExists" in e.java_exception.getClass().getName():
            return False
        raise
    finally:
        fs.delete(source, False)
    return True


def _arrow_value(v: Any, kind: T.DataType) -> Any:
    if v is None:
        return None
    if isinstance(kind, T.DecimalType):
        return Decimal(v)
    if isinstance(kind, T.StructType):
        return {f.name: x for f, x in zip(kind.fields, tuple(v), strict=True)}
    return v


class Log:
    """The log in a folder. Entries are remembered; looking for new ones asks for the next name only."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._known: list[dict] = []
        self._floor: int | None = None
        self._lock = threading.RLock()

    # entries

    def _entry(self, first: int) -> dict | None:
        path = f"{self.path}/commits/{first:020d}.json"
        fs, p = hadoop(self.spark, path)
        return json.loads(read_text(self.spark, path)) if fs.exists(p) else None

    def entries(self) -> list[dict]:
        """All entries that aren't truncated, in order."""
        with self._lock:
            if not self._known:
                fs, p = hadoop(self.spark, f"{self.path}/commits")
                names = sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []
                floor = self.floor()
                found = [json.loads(read_text(self.spark, f"{self.path}/commits/{n}")) for n in names if n.endswith(".json")]
                self._known = sorted((e for e in found if e["last"] > floor), key=lambda e: e["first"])
            while (e := self._entry((self._known[-1]["last"] if self._known else self.floor()) + 1)) is not None:
                self._known.append(e)
            return list(self._known)

    def head(self) -> int:
        known = self.entries()
        return known[-1]["last"] if known else self.floor()

    def floor(self, again: bool = False) -> int:
        """The lsn up to which records are gone."""
        if self._floor is None or again:
            fs, p = hadoop(self.spark, f"{self.path}/floor.json")
            self._floor = json.loads(read_text(self.spark, f"{self.path}/floor.json"))["floor"] if fs.exists(p) else 0
        return self._floor

    def epoch(self) -> str:
        fs, p = hadoop(self.spark, f"{self.path}/epoch")
        if not fs.exists(p):
            create_new(self.spark, self.path, "epoch", uuid.uuid4().hex)
        return read_text(self.spark, f"{self.path}/epoch").strip()

    # writing

    def stage_rows(self, data: str, table: str, schema: T.StructType, rows: Iterable[tuple]) -> int:
        """Rows (record, ordinal, op, columns) that are on the driver, as one small file; no Spark job runs."""
        full = T.StructType(HEAD + [T.StructField(f.name, f.dataType) for f in schema])
        rows = list(rows)
        arrow = to_arrow_schema(full)
        columns = [pa.array([_arrow_value(r[i], f.dataType) for r in rows], arrow.field(i).type) for i, f in enumerate(full)]
        out = io.BytesIO()
        pq.write_table(pa.table(columns, names=full.names), out, compression="zstd")
        write_bytes(self.spark, f"{self.path}/data/{data}/{table}/part-0.parquet", out.getvalue())
        return len(rows)

    def stage_frame(self, data: str, table: str, schema: T.StructType, ops: DataFrame) -> None:
        """Ops (ordinal, op, columns, and record where there are several) that executors write."""
        record = F.col("record").cast("long") if "record" in ops.columns else F.lit(0).cast("long")
        ops.select(record.alias("record"), F.col("ordinal").cast("long"), F.col("op").cast("int"), *(F.col(f"`{f.name}`").cast(f.dataType) for f in schema)).write.parquet(f"{self.path}/data/{data}/{table}")

    def claim(self, data: str, tables: Iterable[str], records: int = 1, after: int | None = None) -> int:
        """Makes staged data a commit; gives its first lsn. after: the head that the writer has seen; a newer one is a Conflict."""
        while True:
            head = self.head()
            if after is not None and head != after:
                raise Conflict(f"head is {head}, not {after}")
            entry = {"first": head + 1, "last": head + records, "data": data, "tables": sorted(tables), "at": time.time_ns() // 1000}
            if create_new(self.spark, self.path, f"commits/{head + 1:020d}.json", json.dumps(entry)):
                return head + 1

    def discard(self, data: str) -> None:
        delete(self.spark, f"{self.path}/data/{data}")

    # reading

    def read(self, table: str, schema: T.StructType, after: int = 0, upto: int | None = None, entries: list[dict] | None = None) -> DataFrame:
        """Ops of a table (lsn, ordinal, op, columns) after an lsn; only the folders of commits that wrote it are read."""
        full = T.StructType(HEAD + [T.StructField(f.name, f.dataType) for f in schema])
        mine = [e for e in (self.entries() if entries is None else entries) if table in e["tables"] and e["last"] > after and (upto is None or e["first"] <= upto)]
        names = [f.name for f in schema]
        if not mine:
            return self.spark.createDataFrame([], T.StructType([T.StructField("lsn", T.LongType()), *full.fields[1:]]))
        df = self.spark.read.schema(full).parquet(*(f"{self.path}/data/{e['data']}/{table}" for e in mine))
        if len(mine) == 1:
            df = df.withColumn("_first", F.lit(mine[0]["first"]).cast("long"))
        else:
            first = self.spark.createDataFrame([(e["data"], e["first"]) for e in mine], "_data string, _first long")
            df = df.withColumn("_data", F.regexp_extract(F.col("_metadata.file_path"), r"/data/([0-9a-f]{32})/", 1)).join(F.broadcast(first), "_data")
        lsn = (F.col("_first") + F.col("record")).alias("lsn")
        out = df.select(lsn, "ordinal", "op", *(F.col(f"`{n}`") for n in names))
        if mine[0]["first"] <= after:
            out = out.filter(F.col("lsn") > after)
        return out if upto is None or mine[-1]["last"] <= upto else out.filter(F.col("lsn") <= upto)

    def snapshots(self) -> list[int]:
        """Lsns of complete snapshots."""
        fs, p = hadoop(self.spark, f"{self.path}/snapshots")
        if not fs.exists(p):
            return []
        at = [s.getPath().getName() for s in fs.listStatus(p)]
        return sorted(int(n) for n in at if fs.exists(hadoop(self.spark, f"{self.path}/snapshots/{n}/done.json")[1]))

    def _snapshot_tables(self, lsn: int) -> list[str]:
        return json.loads(read_text(self.spark, f"{self.path}/snapshots/{lsn}/done.json"))["tables"]

    def state(self, table: str, schema: T.StructType, keys: list[str], lsn: int | None = None) -> DataFrame:
        """Rows of a table at an lsn, by the newest snapshot at or before it and the records after that."""
        floor = self.floor(again=True)
        at = [s for s in self.snapshots() if lsn is None or s <= lsn]
        base_lsn = at[-1] if at else 0
        if base_lsn < floor:
            raise TidelogError("truncated", f"records up to {floor} are gone, and no snapshot at or before lsn {lsn} is left")
        tail = self.read(table, schema, base_lsn, lsn)
        if not at or table not in self._snapshot_tables(at[-1]):
            return fold(tail, keys).drop("lsn")
        base = self.spark.read.schema(schema).parquet(f"{self.path}/snapshots/{base_lsn}/{table}")
        return replay(base, base_lsn, tail, keys)

    # snapshots, truncation and archives

    def snapshot(self, tables: dict[str, tuple[T.StructType, list[str]]], truncate: list[tuple[str, int]] | None = None) -> int:
        """Writes the state of all tables at the head; only complete ones count. truncate: also drops records that neither it nor these holders need."""
        lsn = self.head()
        if lsn not in self.snapshots():
            delete(self.spark, f"{self.path}/snapshots/{lsn}")
            for name, (schema, keys) in tables.items():
                self.state(name, schema, keys, lsn).select(*schema.names).repartitionByRange(*keys).sortWithinPartitions(*keys).write.parquet(f"{self.path}/snapshots/{lsn}/{name}")
            write_text(self.spark, f"{self.path}/snapshots/{lsn}/done.json", json.dumps({"lsn": lsn, "tables": sorted(tables)}))
        if truncate is not None:
            self.truncate(truncate)
        return lsn

    def holders(self, others: Iterable[tuple[str, int]] = ()) -> DataFrame:
        """Who needs which records: the newest snapshot, and consumers with the lsn that each has applied."""
        at = self.snapshots()
        rows = [(0, "snapshot", at[-1] if at else 0), *((i, n, lsn) for i, (n, lsn) in enumerate(others, 1))]
        return self.spark.createDataFrame(rows, "position long, name string, lsn long")

    def truncate(self, others: Iterable[tuple[str, int]] = ()) -> tuple[int, str]:
        """Drops records up to the least lsn that the newest snapshot and the consumers have; gives the new floor and who holds it there.

        The floor is written first: a reader that finds a folder gone sees by it that it has to begin at a snapshot.
        """
        row = truncation_floor(self.holders(others)).first()
        gone = [e for e in self.entries() if e["last"] <= row["floor"]]
        floor = gone[-1]["last"] if gone else self.floor()
        if gone:
            write_text(self.spark, f"{self.path}/floor.json", json.dumps({"floor": floor, "holder": row["holder"]}))
            self._floor, self._known = floor, [e for e in self._known if e["last"] > floor]
            for e in gone:
                delete(self.spark, f"{self.path}/commits/{e['first']:020d}.json")
                self.discard(e["data"])
            for s in self.snapshots()[:-1]:
                if s < floor:
                    delete(self.spark, f"{self.path}/snapshots/{s}")
        return floor, row["holder"]

    def verify(self) -> dict:
        """Contiguity of lsns over the entries."""
        known = self.entries()
        gaps = [b["first"] for a, b in zip(known, known[1:]) if b["first"] != a["last"] + 1]
        return {"floor": self.floor(), "first": known[0]["first"] if known else None, "head": self.head(), "contiguous": not gaps, "records": sum(e["last"] - e["first"] + 1 for e in known)}

    def export(self, to: str, tables: dict[str, tuple[T.StructType, list[str]]]) -> dict:
        """An archive: all records by table, the newest snapshot, and a manifest with an order-free checksum of each table that a restore is held against."""
        at = self.snapshots()
        base = at[-1] if at else 0
        sums = {}
        for name, schema in [*((n, s) for n, (s, _) in tables.items()), (EVENTS, EVENT_SCHEMA)]:
            rows = self.read(name, schema, base)
            rows.write.mode("overwrite").parquet(f"{to}/records/{name}")
            sums[name] = checksum(self.spark.read.schema(rows.schema).parquet(f"{to}/records/{name}"))
        for name in self._snapshot_tables(base) if at else []:
            self.spark.read.parquet(f"{self.path}/snapshots/{base}/{name}").write.mode("overwrite").parquet(f"{to}/snapshot/{name}")
        manifest = {"snapshot": base, "head": self.head(), "epoch": self.epoch(), "tables": sorted(tables), "in_snapshot": self._snapshot_tables(base) if at else [], "checksums": sums}
        write_text(self.spark, f"{to}/manifest.json", json.dumps(manifest))
        return manifest


def checksum(df: DataFrame) -> list[int]:
    """Rows, and a sum of their hashes that doesn't depend on their order."""
    r = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.crc32(F.to_json(F.struct("*")).cast("binary"))), F.lit(0)).alias("d")).first()
    return [r["n"], r["d"]]


def restore(archive: str, to: str, spark: SparkSession, tables: dict[str, tuple[T.StructType, list[str]]], at: int | None = None) -> Log:
    """A log from an archive, in an empty folder and a new epoch, up to an lsn between the archive's snapshot and head.

    Consumers of the old epoch hold lsns that may be past the cut; they see the new epoch and begin anew (see Log.epoch and clamp).
    """
    fs, p = hadoop(spark, to)
    if fs.exists(p) and fs.listStatus(p):
        raise TidelogError("not_empty", f"{to} isn't empty")
    manifest = json.loads(read_text(spark, f"{archive}/manifest.json"))
    head, base = manifest["head"], manifest["snapshot"]
    cut = head if at is None else at
    if not base <= cut <= head:
        raise TidelogError("out_of_range", f"{cut} isn't between {base} and {head}")
    new, data = Log(spark, to), uuid.uuid4().hex
    names = {n: s for n, (s, _) in tables.items()} | {EVENTS: EVENT_SCHEMA}
    records = {}
    for name, schema in names.items():
        full = T.StructType([T.StructField("lsn", T.LongType()), *HEAD[1:], *(T.StructField(f.name, f.dataType) for f in schema)])
        records[name] = spark.read.schema(full).parquet(f"{archive}/records/{name}") if name in manifest["checksums"] else spark.createDataFrame([], full)
        if name in manifest["checksums"] and checksum(records[name]) != manifest["checksums"][name]:
            raise TidelogError("corrupt_archive", f"the records of {name} don't match the manifest")
    if base:
        for name in manifest["in_snapshot"]:
            spark.read.parquet(f"{archive}/snapshot/{name}").write.parquet(f"{to}/snapshots/{base}/{name}")
        write_text(spark, f"{to}/snapshots/{base}/done.json", json.dumps({"lsn": base, "tables": manifest["in_snapshot"]}))
        write_text(spark, f"{to}/floor.json", json.dumps({"floor": base, "holder": "restore"}))
    if cut > base:
        for name, schema in names.items():
            new.stage_frame(data, name, schema, records[name].filter(F.col("lsn") <= cut).withColumn("record", F.col("lsn") - (base + 1)))
        new.claim(data, names, cut - base, after=base)
    new.epoch()
    return new


def clamp(applied: int, log: Log) -> int:
    """A consumer's lsn after a restore: no further than the log's head."""
    return min(applied, log.head())


@dataclass
class ChangeLog:
    """One table's part of the log. schema: the table's columns; keys: its primary key."""

    log: Log
    name: str
    schema: T.StructType
    keys: list[str]

    @property
    def spark(self) -> SparkSession:
        return self.log.spark

    def read(self, after: int = 0, upto: int | None = None) -> DataFrame:
        return self.log.read(self.name, self.schema, after, upto)

    def of(self, entries: list[dict]) -> DataFrame:
        """The table's ops in these entries."""
        return self.log.read(self.name, self.schema, entries=entries)

    def head(self) -> int:
        return self.log.head()

    def append(self, ops: DataFrame, after: int | None = None) -> int:
        """One record of ops (ordinal, op and the table's columns). Gives its lsn; no ops, no record."""
        if ops.isEmpty():
            return self.head()
        return self._append(ops, 1, after)

    def append_many(self, ops: DataFrame, after: int | None = None) -> int:
        """Many records at once: rows with a record number from 0 on; their lsns follow the head in its order. Gives the last."""
        n = ops.agg(F.max("record")).first()[0]
        return self.head() if n is None else self._append(ops, n + 1, after) + n

    def _append(self, ops: DataFrame, records: int, after: int | None) -> int:
        data = uuid.uuid4().hex
        try:
            self.log.stage_frame(data, self.name, self.schema, ops)
            return self.log.claim(data, [self.name], records, after)
        except BaseException:
            self.log.discard(data)
            raise

    def state(self, lsn: int | None = None) -> DataFrame:
        return self.log.state(self.name, self.schema, self.keys, lsn)

    def verify(self) -> dict:
        row = contiguity(self.read()).first()
        return {"first": row["first"], "last": row["last"]} | {"records": row["records"]}
