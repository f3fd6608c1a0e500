"""Table state at one point: scans, lookups and counts, and the view of a transaction with its own pending writes on top."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.catalog import Table, TidelogError

INSERT, UPDATE, DELETE = 1, 2, 3


class View:
    """Read-only access to a table's rows. Results come in key order, index results in value-then-key order where the value varies."""

    def __init__(self, table: Table, df: DataFrame):
        self.table, self.df = table, df

    def _indexed(self, column: str):
        if column not in self.table.lookup_columns():
            raise TidelogError("unindexed_column", f"{column} is neither key nor indexed")
        return F.col(column)

    def scan(self) -> DataFrame:
        return self.df.orderBy(self.table.pk.name)

    def find(self, key) -> DataFrame:
        """The row with this key, or none."""
        return self.df.filter(F.col(self.table.pk.name) == F.lit(key))

    def filter(self, column: str, value) -> DataFrame:
        return self.df.filter(self._indexed(column) == F.lit(value)).orderBy(self.table.pk.name)

    def filter_range(self, column: str, low, high) -> DataFrame:
        """low <= column <= high; reversed bounds give nothing."""
        where = self._indexed(column).between(F.lit(low), F.lit(high))
        return self.df.filter(where).orderBy(*([column] if column != self.table.pk.name else []), self.table.pk.name)

    def keys(self) -> DataFrame:
        return self.df.select(self.table.pk.name).orderBy(self.table.pk.name)

    def count(self) -> DataFrame:
        return self.df.agg(F.count(F.lit(1)).alias("count"))

    def any(self) -> DataFrame:
        return self.df.select(F.lit(1).alias("x")).limit(1).agg((F.count(F.lit(1)) > 0).alias("any"))

    def first(self) -> DataFrame:
        return self.df.orderBy(self.table.pk.name).limit(1)


def overlay(base: DataFrame, pending: DataFrame, key: str, small: bool = False) -> DataFrame:
    """base with pending ops (op, and the table's columns) on top: pending rows win, deleted ones go. pending has one op for each key.

    Base rows stay where they are if the pending keys are few: small says so of a transaction's writes, else Spark goes by their size.
    """
    keys = pending.select(key)
    kept = base.join(F.broadcast(keys) if small else keys, key, "left_anti").select(*base.columns)
    return kept.unionByName(pending.filter(F.col("op") != DELETE).select(*base.columns))


def unique_violations(rows: DataFrame, key: str, column: str) -> DataFrame:
    """Rows whose value in column another key has too; nulls don't count."""
    twice = rows.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count_distinct(key).alias("_n")).filter("_n > 1").select(column)
    return rows.join(twice, column, "left_semi")
