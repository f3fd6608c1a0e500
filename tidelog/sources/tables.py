"""Parquet tables of a folder, read with their declared columns only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.catalog import Catalog
from tidelog.operators.views import DELETE, INSERT, UPDATE


def read_table(spark: SparkSession, folder: str, name: str, catalog: Catalog | None = None) -> DataFrame:
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    if catalog is None or name not in catalog.tables:
        return df
    t = catalog.get(name)
    return df.select(*(F.col(c.name).cast(c.of.spark).alias(c.name) for c in t.columns))


def events_log(spark: SparkSession, folder: str) -> DataFrame:
    """A legal change log made of the events table: each event is a record on its user's row; every fifth one deletes it, the next inserts it again."""
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    op = F.when((n == 1) | (n % 5 == 1), INSERT).when(n % 5 == 0, DELETE).otherwise(UPDATE)
    ev = read_table(spark, folder, "events").select("event_id", "user_id", "event_type", "value")
    return ev.select((F.col("event_id") + 1).alias("lsn"), F.lit(0).cast("long").alias("ordinal"), op.alias("op"), "user_id", "event_type", "value")
