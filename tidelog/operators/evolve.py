"""Schema evolution: what changed between two shapes of a table, and rows of an older shape in the newer one."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.catalog import SCHEDULE_AT, Catalog, Kind, Table, TidelogError


@dataclass(frozen=True)
class ShapeDiff:
    verdict: str  # identical, additive or destructive
    changes: tuple[str, ...] = ()


def shape_diff(old: Catalog, new: Catalog) -> ShapeDiff:
    """New tables, new columns and another order are additive; lost tables or columns, other kinds and another key are destructive."""
    added, broken = [], []
    for name, t in old.tables.items():
        n = new.tables.get(name)
        if n is None:
            broken.append(f"table {name} is gone")
            continue
        if t.pk.name != n.pk.name:
            broken.append(f"{name}: the key moved from {t.pk.name} to {n.pk.name}")
        there = {c.name: c for c in n.columns}
        for c in t.columns:
            if c.name not in there:
                broken.append(f"{name}: column {c.name} is gone")
            elif there[c.name].kind != c.kind:
                broken.append(f"{name}.{c.name}: {c.kind} became {there[c.name].kind}")
        more = [c.name for c in n.columns if c.name not in t.names]
        added += [f"{name}: column {c} is new" for c in more]
        if not more and t.names != n.names and set(t.names) == set(n.names):
            added.append(f"{name}: columns are in another order")
    added += [f"table {name} is new" for name in new.tables if name not in old.tables]
    if broken:
        return ShapeDiff("destructive", tuple(broken))
    return ShapeDiff("additive", tuple(added)) if added else ShapeDiff("identical")


def zero(kind: Kind) -> Column:
    """The kind's zero as a column; null for strings and bytes."""
    if kind.name == "scheduleat":
        return F.struct(F.lit(False).alias("is_interval"), F.lit(0).cast("long").alias("micros")).cast(SCHEDULE_AT)
    if kind.name == "timestamp":
        return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.lit(kind.zero).cast(kind.spark)


def remap(df: DataFrame, old: Table, new: Table) -> DataFrame:
    """Rows of the old shape in the new one, by column name; columns that weren't there get their kind's zero, and not null."""
    return df.select(*(F.col(c.name) if c.name in old.names else zero(c.of).alias(c.name) for c in new.columns))


def with_history(parts: list[tuple[DataFrame, Table]], new: Table) -> DataFrame:
    """Rows of several eras, each read by the shape of its time, in the newest one."""
    out = None
    for df, shape in parts:
        now = remap(df, shape, new)
        out = now if out is None else out.unionByName(now)
    return out


def ddl(existing: dict[str, str] | None, table: Table, auto: bool) -> list[str]:
    """What a projection table needs before it can take this shape. existing: columns and kinds, None: no table. Kinds can't change; columns too many don't matter."""
    if existing is None:
        todo = [f"create {table.name}"]
    else:
        for c in table.columns:
            if c.name in existing and existing[c.name] != c.kind:
                raise TidelogError("schema_conflict", f"{table.name}.{c.name} is {existing[c.name]}, not {c.kind}")
        todo = [f"add {table.name}.{c.name}" for c in table.columns if c.name not in existing]
    if todo and not auto:
        raise TidelogError("schema_conflict", f"needs: {', '.join(todo)}")
    return todo
