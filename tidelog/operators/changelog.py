"""The change log: ops in order of (lsn, ordinal), write sets that collapse, and state as the fold of a log.

A log row has lsn, ordinal, op (1 insert, 2 update, 3 delete), key and the row's columns. All operators are relational: windows or aggregates by key, so
they shuffle once on the key, and aggregates combine before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.operators.views import DELETE, INSERT, UPDATE
from tidelog.sources.scratch import saved


def _rest(df: DataFrame, *known: str) -> list[str]:
    return [c for c in df.columns if c not in known]


def collapse(ops: DataFrame, keys: list[str], txn: str = "txn", ordinal: str = "ordinal") -> DataFrame:
    """One op for each transaction and key. Of a legal sequence, first op f and last op l decide: f insert and l delete leave nothing, f insert gives an
    insert, else l delete gives a delete and anything else an update. The last op's values stay; ordinal is that of the first op."""
    rest = _rest(ops, txn, ordinal, "op", *keys)
    by = F.col(ordinal)
    folded = ops.groupBy(txn, *keys).agg(F.min_by("op", by).alias("_f"), F.max_by("op", by).alias("_l"), F.min(by).alias(ordinal), F.max_by(F.struct(*rest), by).alias("_row") if rest else F.lit(None).alias("_row"))
    op = F.when((F.col("_f") == INSERT) & (F.col("_l") == DELETE), F.lit(None)).when(F.col("_f") == INSERT, F.lit(INSERT)).when(F.col("_l") == DELETE, F.lit(DELETE)).otherwise(F.lit(UPDATE))
    out = folded.withColumn("op", op).filter(F.col("op").isNotNull())
    return out.select(txn, *keys, ordinal, "op", *(F.col(f"_row.{c}").alias(c) for c in rest))


def illegal(ops: DataFrame, keys: list[str], txn: str = "txn", ordinal: str = "ordinal") -> DataFrame:
    """Ops that can't follow the op before them on the same key: insert after insert or update, update or delete after delete."""
    before = F.lag("op").over(Window.partitionBy(txn, *keys).orderBy(ordinal))
    bad = (F.col("op") == INSERT) & before.isin(INSERT, UPDATE) | (F.col("op") != INSERT) & (before == DELETE)
    return ops.withColumn("_bad", bad).filter("_bad").drop("_bad")


def fold(log: DataFrame, keys: list[str]) -> DataFrame:
    """State after the whole log: of each key the last op's row, unless it is a delete. An aggregate, so ops combine before the shuffle."""
    rest = _rest(log, "lsn", "ordinal", "op", *keys)
    last = log.groupBy(*keys).agg(F.max_by(F.struct("op", "lsn", *rest), F.struct("lsn", "ordinal")).alias("_last"))
    return last.filter(F.col("_last.op") != DELETE).select(*keys, *(F.col(f"_last.{c}").alias(c) for c in rest), F.col("_last.lsn").alias("lsn"))


def as_of(log: DataFrame, lsn: int, keys: list[str]) -> DataFrame:
    """State at an lsn: the filter reaches the log's scan."""
    return fold(log.filter(F.col("lsn") <= lsn), keys)


def replay(snapshot: DataFrame, snapshot_lsn: int, log: DataFrame, keys: list[str]) -> DataFrame:
    """A snapshot's rows and the log after it, folded; records at or before the snapshot are ignored."""
    rest = [c for c in snapshot.columns if c not in (*keys, "lsn")]
    base = snapshot.select(F.lit(0).cast("long").alias("lsn"), F.lit(0).cast("long").alias("ordinal"), F.lit(INSERT).alias("op"), *keys, *rest)
    tail = log.filter(F.col("lsn") > snapshot_lsn).select(F.col("lsn").cast("long"), F.col("ordinal").cast("long"), F.col("op").cast("int"), *keys, *rest)
    return fold(base.unionByName(tail), keys).drop("lsn")


def upsert(base: DataFrame, batch: DataFrame, keys: list[str], order: str) -> DataFrame:
    """base with the batch's rows put over it; of rows with equal keys the last in order counts."""
    rest = _rest(base, *keys)
    last = batch.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_row")).select(*keys, *(F.col(f"_row.{c}").alias(c) for c in rest))
    return base.join(last.select(*keys), keys, "left_anti").select(*base.columns).unionByName(last.select(*base.columns))


def upsert_ops(base: DataFrame, batch: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The ops that a batch of upserts stages: update where the key is in base or came earlier in the batch, else insert."""
    seen = F.row_number().over(Window.partitionBy(*keys).orderBy(order)) > 1
    known = base.select(*keys).distinct().withColumn("_known", F.lit(True))
    return batch.withColumn("_seen", seen).join(known, keys, "left").withColumn("op", F.when(F.col("_seen") | F.col("_known"), UPDATE).otherwise(INSERT)).drop("_seen", "_known")


def reconcile(base: DataFrame, batch: DataFrame, keys: list[str], order: str) -> DataFrame:
    """A batch made against older state, fitted to base and its own earlier ops: puts become update or insert, deletes of what isn't there go."""
    w = Window.partitionBy(*keys).orderBy(order)
    known = base.select(*keys).distinct().withColumn("_known", F.lit(True))
    there = F.coalesce(F.lag("op").over(w) != DELETE, F.coalesce(F.col("_known"), F.lit(False)))
    fitted = batch.join(known, keys, "left").withColumn("_there", there)
    op = F.when(F.col("op") == DELETE, F.when(F.col("_there"), DELETE)).when(F.col("_there"), UPDATE).otherwise(INSERT)
    return fitted.withColumn("op", op).filter(F.col("op").isNotNull()).drop("_known", "_there")


def preimages(log: DataFrame, keys: list[str]) -> DataFrame:
    """Each op with the op and row it replaces, as columns old_op and old (null: none)."""
    rest = _rest(log, "lsn", "ordinal", "op", *keys)
    w = Window.partitionBy(*keys).orderBy("lsn", "ordinal")
    return log.withColumn("old_op", F.lag("op").over(w)).withColumn("old", F.lag(F.struct(*rest)).over(w))


#: An id has 16 bits of originator and 47 bits of sequence under a zero sign bit.
SEQUENCE_BITS = 47


def by_ranges(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows written once by ranges of order, with the number of their range in _part: whoever reads them twice sees the same ranges."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return saved(rows.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()), "ranges")


def autoinc(rows: DataFrame, id_col: str, originator: int, last: int, order: list[str]) -> DataFrame:
    """rows with ids assigned where they are zero: originator << 47 | last + 1, + 2, ... in order.

    Numbers come from counts of each range of the order, so no task holds all rows.
    """
    ranged = by_ranges(rows.filter(F.col(id_col) == 0), order)
    counts = ranged.groupBy("_part").count()
    before = counts.select("_part", (F.sum("count").over(Window.orderBy("_part")) - F.col("count")).alias("_before"))  # one row a partition
    number = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) + F.col("_before") + F.lit(last)
    filled = ranged.join(F.broadcast(before), "_part").withColumn(id_col, F.shiftleft(F.lit(originator).cast("long"), SEQUENCE_BITS).bitwiseOR(number.cast("long")))
    return rows.filter(F.col(id_col) != 0).unionByName(filled.select(*rows.columns))


def last_sequence(rows: DataFrame, id_col: str, originator: int) -> DataFrame:
    """The highest sequence that ids of this originator have used."""
    mine = F.shiftright(F.col(id_col), SEQUENCE_BITS) == originator
    return rows.filter(mine).agg(F.coalesce(F.max(F.col(id_col).bitwiseAND((1 << SEQUENCE_BITS) - 1)), F.lit(0)).alias("last"))


def applier_lag(head: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Records each consumer has still to apply. head: one row with lsn."""
    return checkpoints.crossJoin(F.broadcast(head.agg(F.max("lsn").alias("head")))).select("name", (F.col("head") - F.col("applied")).alias("lag"))


def truncation_floor(holders: DataFrame) -> DataFrame:
    """The lsn up to which the log may go, and who holds it there: the first holder of the least. holders: position, name, lsn."""
    return holders.agg(F.min("lsn").alias("floor"), F.min_by("name", F.struct("lsn", "position")).alias("holder"))


def contiguity(log: DataFrame) -> DataFrame:
    """Whether lsns run on without a gap: first, last, distinct lsns and their agreement."""
    a = log.agg(F.min("lsn").alias("first"), F.max("lsn").alias("last"), F.count_distinct("lsn").alias("records"))
    return a.withColumn("contiguous", F.col("last") - F.col("first") + 1 == F.col("records"))
