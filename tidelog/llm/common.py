"""What the operators share: scratch tables on the shared checkpoint folder, sizing, and documents dealt out with side data."""

from __future__ import annotations

import gc
import math
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.textnp import trim

#: What one task of a dealt step is meant to hold, as Catalyst estimates it: files count as they lie there, compressed. Tasks stream it, so this bounds time.
SHARD_BYTES = 64 << 20
#: Rows and bytes of one Arrow batch, so that a batch of long documents stays small.
BATCH_ROWS = 2000
BATCH_BYTES = 8 << 20
#: Estimates from here on mean that Catalyst doesn't know.
UNKNOWN_BYTES = 1 << 60


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; only a local session without one gets a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"file://{tempfile.gettempdir()}/tidelog-{os.getpid()}"


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished steps now and not at its next collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def saved(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends here, and a lost executor costs no recomputation. It goes with the driver at the latest."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    release(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path  # noqa: SLF001  for dropped()
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes scratch tables that no later step reads."""
    for t in tables:
        spark = t.sparkSession
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(t._scratch)  # noqa: SLF001
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def tuned(spark: SparkSession) -> None:
    """Small Arrow batches: documents may be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of df's size, from file sizes; no job runs."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


#: Bytes of a side that may be broadcast, by rows times their width (the driver builds every broadcast); and the share and number of rows from which a key counts
#: as hot.
BROADCAST_BYTES = 24 << 20
HOT_SHARE, HOT_ROWS = 10_000, 1000


def small(rows: int, width: int) -> bool:
    """Whether so many rows of so many bytes may be broadcast."""
    return rows * width <= BROADCAST_BYTES


def spread_join(left: DataFrame, right: DataFrame, on: list[str], count: str, how: str) -> DataFrame:
    """left joined with right, whose keys are unique and which has in column `count` (dropped) the rows of left with its key. how: inner, left or left_anti.

    Keys with more than a ten-thousandth of left's matched rows are hot: at most HOT_SHARE keys, so they are broadcast and their rows stay where they are;
    all others are joined by a shuffle, in which no key is large, whatever the sizes. left and right are read twice: they should be tables.
    """
    bare = right.drop(count)
    n, total, most = right.agg(F.count(F.lit(1)), F.coalesce(F.sum(count), F.lit(0)), F.coalesce(F.max(count), F.lit(0))).first()
    if n <= HOT_SHARE:
        return left.join(F.broadcast(bare), on, how)
    limit = max(HOT_ROWS, total // HOT_SHARE)
    if most <= limit:
        return left.join(bare.hint("merge"), on, how)
    hot = right.filter(F.col(count) > limit)
    keys = F.broadcast(hot.select(*on))
    rest = left.join(keys, on, "left_anti").join(right.filter(F.col(count) <= limit).drop(count).hint("merge"), on, how)
    return rest if how == "left_anti" else rest.unionByName(left.join(F.broadcast(hot.drop(count)), on, "inner"))


def parts(df: DataFrame, per: int = SHARD_BYTES) -> int:
    """Partitions to deal df into: the session's number, or more where that would make them larger than per. What has no estimate is summed up."""
    size = plan_bytes(df)
    if size >= UNKNOWN_BYTES:
        strings = [F.coalesce(F.sum(F.octet_length(c)), F.lit(0)) for c, kind in df.dtypes if kind == "string"]
        size = sum(df.agg(*strings).first()) if strings else 0
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / per))


def dealt(docs: DataFrame, id_col: str, text_col: str, n: int, carry: bool = False) -> DataFrame:
    """Columns id, text and shard: a number below n that depends on the row alone. Other columns are left out, so their names can't clash.

    With carry, the whole row is in column row.
    """
    text = F.col(text_col)
    row = [F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")] if carry else []
    return docs.select(*row, F.col(id_col).alias("id"), text.alias("text"), F.pmod(F.xxhash64(F.col(id_col), text), F.lit(n)).cast("int").alias("shard"))


def beside(docs: DataFrame, side: DataFrame, n: int, fn: Callable, schema: str) -> DataFrame:
    """Brings the side rows of each shard to its documents and runs fn once for each partition.

    docs has the column shard, side too; both go to partition number shard. There, all side rows come first.
    fn(side, docs): two iterators of Arrow batches, the first to be read before the second.
    """
    tag = "_is_doc"
    both = side.withColumn(tag, F.lit(False)).unionByName(docs.withColumn(tag, F.lit(True)), allowMissingColumns=True)
    side_cols, doc_cols = side.columns, docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []

        def sides():
            for b in batches:
                is_doc = b.column(b.schema.get_field_index(tag)).to_numpy(zero_copy_only=False)
                first = int(is_doc.argmax()) if is_doc.any() else len(is_doc)
                if first:
                    yield b.slice(0, first).select(side_cols)
                if first < len(is_doc):
                    waiting.append(b.slice(first).select(doc_cols))
                    return

        def texts():
            while waiting:
                yield waiting.pop()
            for b in batches:
                yield b.select(doc_cols)

        yield from fn(sides(), texts())
        trim()

    return both.repartitionById(n, F.col("shard")).sortWithinPartitions(tag).mapInArrow(run, schema)


def drawn(rows: DataFrame, most: dict, most_bytes: int) -> DataFrame:
    """A bounded draw: of each kind at most most[kind] different rows by lot, and of those, by lot, as many as take at most most_bytes of text together.

    rows: kind, lot (a hash of the row) and text. The smallest lot of each of most[kind] residues is looked at, so no row is moved to choose; equal rows count
    once. A row that would exceed the bytes is passed over.
    """
    spark = rows.sparkSession
    n = F.lit(1)
    for kind, k in most.items():
        n = F.when(F.col("kind") == F.lit(kind), F.lit(k)).otherwise(n)
    least = rows.groupBy("kind", F.pmod("lot", n).alias("_r")).agg(F.min(F.struct("lot", F.coalesce(F.octet_length("text"), F.lit(0)).alias("size"))).alias("m"))
    taken, left = [], most_bytes
    for lot, size, kind in sorted((r["m"]["lot"], r["m"]["size"], r["kind"]) for r in least.collect()):
        if size <= left:
            taken.append((kind, lot))
            left -= size
    kind = rows.schema["kind"].dataType.simpleString()
    return rows.join(F.broadcast(spark.createDataFrame(taken, f"kind {kind}, lot long")), ["kind", "lot"]).dropDuplicates(["kind", "lot"])


def trimmed(fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """fn for mapInArrow, with freed memory given back at the end of each task: the worker may idle beside the next operator's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(batches)
        trim()

    return run


def held_out(doc_id: Column, mod: int) -> Column:
    """Whether crc32 of the id as text leaves the remainder 2; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(mod)) == 2
