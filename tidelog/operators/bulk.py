"""Bulk loads: rows go to the shards they belong to, one write each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def route(rows: DataFrame, folder: str, head: int) -> DataFrame:
    """Writes rows by their column shard, each shard's in a folder of its own, and gives what each shard got: its rows and the lsn of its write.

    No shuffle: every task writes what it has of each shard. What was written is counted from the files.
    """
    rows.write.partitionBy("shard").parquet(folder)
    kind = rows.schema["shard"].dataType
    return route_counts(rows.sparkSession.read.parquet(folder).withColumn("shard", F.col("shard").cast(kind)), head)


def route_counts(rows: DataFrame, head: int) -> DataFrame:
    """What each shard gets: its rows and the lsn of its write."""
    return rows.groupBy("shard").agg(F.count(F.lit(1)).alias("rows")).select("shard", F.lit(head + 1).cast("long").alias("lsn"), "rows")
