"""Handoff of rows from one shard's database to another's: freeze, import, settle or abort, each a record of its own and each idempotent by the handoff's id.

A crash between two steps leaves a state from which the same step, or abort, can be repeated: rows are in the origin until it settles, and whoever writes to a
frozen row is refused. Which rows follow is the application's: a condition for each table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.catalog import Catalog, Column as Declared, Table, TidelogError
from tidelog.engine import Database, WriteSet
from tidelog.operators.views import DELETE, INSERT, UPDATE
from tidelog.sources.log import Conflict

#: Marks of handoffs, and the rows that each has frozen, as tables beside the application's.
MARKS = Table("_handoffs", (Declared("id", "string", primary=True), Declared("state", "string"), Declared("other", "int64")), public=False)
FROZEN = Table("_frozen", (Declared("row", "string", primary=True), Declared("handoff", "string", indexed=True)), public=False)
HandoffSet = dict[str, Callable[[], Column]]


def prepared(catalog: Catalog) -> Catalog:
    """The catalog with the tables that handoffs need."""
    for t in (MARKS, FROZEN):
        catalog.tables.setdefault(t.name, t)
    return catalog


class Shard:
    """One shard's side of handoffs. number: the shard; shard_by: each moving table's shard column."""

    def __init__(self, db: Database, number: int, shard_by: dict[str, str]):
        self.db, self.number, self.shard_by = db, number, shard_by
        prepared(db.catalog)
        db.guards.append(self._guard)

    def _guard(self, writes: dict[str, WriteSet]) -> None:
        """Refuses writes to frozen rows."""
        names = [f"{t}/{k}" for t, w in writes.items() if t in self.shard_by for k in w.ops]
        if not names or not self._any_handoff():
            return
        found = self.db.lookup("_frozen", "row", names, self.db.commits.head())
        if held := [n for n, rows in found.items() if rows]:
            raise TidelogError("frozen", f"{held[0]} is being handed off")

    def _any_handoff(self) -> bool:
        return any("_frozen" in e["tables"] for e in self.db.commits.entries()) or bool(self.db.commits.snapshots())

    def state(self, handoff: str) -> str | None:
        rows = self.db.lookup("_handoffs", "id", [handoff], self.db.commits.head())[handoff]
        return rows[0]["state"] if rows else None

    def _mark(self, handoff: str, state: str, other: int, op: int) -> DataFrame:
        return self.db.spark.createDataFrame([(0, op, handoff, state, other)], "ordinal long, op int, id string, state string, other long")

    def _commit(self, make: Callable[[], dict[str, DataFrame]]) -> int:
        while True:
            head = self.db.commits.head()
            try:
                return self.db.commit_frames(make(), after=head)
            except Conflict:
                continue

    def _frozen(self, table: str, handoff: str) -> DataFrame:
        """Rows of a table that the handoff holds."""
        pk = self.db.catalog.get(table).pk.name
        names = self.db.state("_frozen").filter(F.col("handoff") == handoff).select("row")
        rows = self.db.state(table).withColumn("_row", F.concat(F.lit(f"{table}/"), F.col(pk).cast("string")))
        return rows.join(names, F.col("_row") == F.col("row"), "left_semi").drop("_row")

    def freeze(self, handoff: str, moving: dict[str, Column], destination: int) -> dict[str, DataFrame]:
        """Marks the handoff and its rows frozen in one record; gives the rows to import. Repeated: the same rows. No row at all is refused."""
        state = self.state(handoff)
        if state not in (None, "frozen"):
            raise TidelogError("handoff", f"{handoff} is {state}")
        if state is None:
            if all(self.db.state(t).filter(c).isEmpty() for t, c in moving.items()):
                raise TidelogError("handoff", f"{handoff} would move nothing")

            def ops() -> dict[str, DataFrame]:
                rows = None
                for t, c in moving.items():
                    pk = self.db.catalog.get(t).pk.name
                    one = self.db.state(t).filter(c).select(F.lit(1).alias("ordinal"), F.lit(INSERT).alias("op"), F.concat(F.lit(f"{t}/"), F.col(pk).cast("string")).alias("row"), F.lit(handoff).alias("handoff"))
                    rows = one if rows is None else rows.unionByName(one)
                return {"_handoffs": self._mark(handoff, "frozen", destination, INSERT), "_frozen": rows}

            self._commit(ops)
        return {t: self._frozen(t, handoff) for t in moving}

    def import_(self, handoff: str, rows: dict[str, DataFrame], origin: int) -> int:
        """Takes rows in, rehomed to this shard, with the mark, in one record; what is there already is updated. Repeated: nothing."""
        if self.state(handoff) is not None:
            return self.db.commits.head()

        def ops() -> dict[str, DataFrame]:
            out = {"_handoffs": self._mark(handoff, "imported", origin, INSERT)}
            for t, df in rows.items():
                table, column = self.db.catalog.get(t), self.shard_by[t]
                known = self.db.state(t).select(table.pk.name, F.lit(True).alias("_known"))
                home = df.withColumn(column, F.lit(self.number).cast(table.column(column).of.spark))
                out[t] = home.join(known, table.pk.name, "left").select(F.lit(1).alias("ordinal"), F.when(F.col("_known"), UPDATE).otherwise(INSERT).alias("op"), *table.names)
            return out

        return self._commit(ops)

    def settle(self, handoff: str) -> int:
        """The origin's rows go, as their import is certain. Repeated: nothing."""
        state = self.state(handoff)
        if state in ("settled", "imported"):
            return self.db.commits.head()
        return self._release(handoff, state, "settled")

    def abort(self, handoff: str) -> int:
        """The origin's rows thaw and stay. The caller has made sure that nothing was or will be imported. Repeated: nothing."""
        state = self.state(handoff)
        if state == "aborted":
            return self.db.commits.head()
        return self._release(handoff, state, "aborted")

    def _release(self, handoff: str, state: str | None, into: str) -> int:
        if state != "frozen":
            raise TidelogError("handoff", f"{handoff} is {state or 'unknown'}")

        def ops() -> dict[str, DataFrame]:
            out = {"_handoffs": self._mark(handoff, into, self.number, UPDATE)}
            thaw = self.db.state("_frozen").filter(F.col("handoff") == handoff)
            out["_frozen"] = thaw.select(F.lit(1).alias("ordinal"), F.lit(DELETE).alias("op"), "row", "handoff")
            if into == "settled":
                for t in self.shard_by:
                    out[t] = self._frozen(t, handoff).select(F.lit(1).alias("ordinal"), F.lit(DELETE).alias("op"), *self.db.catalog.get(t).names)
            return out

        return self._commit(ops)


def hand_off(origin: Shard, destination: Shard, handoff: str, moving: dict[str, Column]) -> None:
    """The whole way; may be repeated after a crash at any point."""
    if origin.state(handoff) != "settled":
        destination.import_(handoff, origin.freeze(handoff, moving, destination.number), origin.number)
        origin.settle(handoff)
