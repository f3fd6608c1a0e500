"""Declared tables: the closed set of column kinds, their Spark types and rules, and the catalog that resolves names."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace

from pyspark.sql import types as T


class TidelogError(Exception):
    """An error with a code that callers can tell apart."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


@dataclass(frozen=True)
class Kind:
    """A column kind: Spark type, row bytes (None: 5 and the value's own), integer bounds, whether it can be a key, whether it can be null."""

    name: str
    spark: T.DataType
    width: int | None
    low: int | None = None
    high: int | None = None
    key: bool = True
    nullable: bool = False

    @property
    def integer(self) -> bool:
        return self.low is not None

    @property
    def unsigned(self) -> bool:
        return self.low == 0

    @property
    def numeric(self) -> bool:
        return self.integer or self.name in ("float32", "float64")

    @property
    def zero(self):
        if self.nullable:
            return None
        if self.name == "bool":
            return False
        if self.name == "identity":
            return b"\0" * 32
        if self.name == "scheduleat":
            return (False, 0)
        return 0.0 if self.name.startswith("float") else 0


def _int(name: str, spark: T.DataType, bits: int, signed: bool) -> Kind:
    low, high = (-(1 << (bits - 1)), (1 << (bits - 1)) - 1) if signed else (0, (1 << bits) - 1)
    return Kind(name, spark, bits // 8, low, high)


SCHEDULE_AT = T.StructType([T.StructField("is_interval", T.BooleanType()), T.StructField("micros", T.LongType())])
#: The kinds and their row widths.
KINDS = {
    k.name: k
    for k in (
        Kind("bool", T.BooleanType(), 1),
        _int("int8", T.ByteType(), 8, True),
        _int("uint8", T.ShortType(), 8, False),
        _int("int16", T.ShortType(), 16, True),
        _int("uint16", T.IntegerType(), 16, False),
        _int("int32", T.IntegerType(), 32, True),
        _int("uint32", T.LongType(), 32, False),
        _int("int64", T.LongType(), 64, True),
        _int("uint64", T.DecimalType(20, 0), 64, False),
        Kind("float32", T.FloatType(), 4, key=False),
        Kind("float64", T.DoubleType(), 8, key=False),
        Kind("string", T.StringType(), None, nullable=True),
        Kind("bytes", T.BinaryType(), None, nullable=True),
        Kind("identity", T.BinaryType(), 32),
        Kind("timestamp", T.TimestampNTZType(), 8),
        Kind("scheduleat", SCHEDULE_AT, 9, key=False),
    )
}
TIERS, RESIDENCY, PLACEMENTS = ("hot", "relational"), ("paged", "resident", "auto"), ("partitioned", "replicated", "global", "local")


@dataclass(frozen=True)
class Column:
    name: str
    kind: str
    primary: bool = False
    autoinc: bool = False
    unique: bool = False
    indexed: bool = False
    server_only: bool = False
    enum: tuple[tuple[int, str], ...] = ()

    @property
    def of(self) -> Kind:
        return KINDS[self.kind]


@dataclass(frozen=True)
class Table:
    """A declared table; refuses at construction what could not be served."""

    name: str
    columns: tuple[Column, ...]
    public: bool = True
    tier: str = "hot"
    residency: str = "auto"
    placement: str = "local"
    shard_by: str | None = None
    scheduled: str | None = None

    def __post_init__(self):
        bad = lambda text: TidelogError("bad_schema", f"{self.name}: {text}")
        if unknown := [c.kind for c in self.columns if c.kind not in KINDS]:
            raise bad(f"unknown kinds {unknown}")
        if len({c.name for c in self.columns}) != len(self.columns):
            raise bad("column names repeat")
        if sum(c.primary for c in self.columns) != 1:
            raise bad("exactly one primary key column is needed")
        for c in self.columns:
            if (c.primary or c.indexed or c.unique) and not c.of.key:
                raise bad(f"{c.name}: a {c.kind} can't be a key or indexed")
            if c.autoinc and c.kind not in ("int64", "uint64"):
                raise bad(f"{c.name}: only int64 and uint64 count up by themselves")
            if c.unique and self.placement == "partitioned":
                raise bad(f"{c.name}: a partitioned table can't have unique columns")
        if self.shard_by is not None and (self.shard_by not in self.names or self.shard_by == self.pk.name):
            raise bad(f"shard column {self.shard_by} must exist and not be the primary key")
        if self.tier not in TIERS or self.residency not in RESIDENCY or self.placement not in PLACEMENTS:
            raise bad("unknown tier, residency or placement")
        if self.scheduled is not None:
            if sum(c.kind == "scheduleat" for c in self.columns) != 1:
                raise bad("a scheduled table has exactly one scheduleat column")
            object.__setattr__(self, "public", False)
            object.__setattr__(self, "placement", "local")

    @property
    def names(self) -> list[str]:
        return [c.name for c in self.columns]

    @property
    def pk(self) -> Column:
        return next(c for c in self.columns if c.primary)

    @property
    def visible(self) -> list[str]:
        return [c.name for c in self.columns if not c.server_only]

    def column(self, name: str) -> Column:
        """Names match case and all."""
        for c in self.columns:
            if c.name == name:
                return c
        raise TidelogError("unknown_column", f"{self.name} has no column {name}")

    def spark_schema(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, c.of.spark, c.of.nullable, {"kind": c.kind, "primary": c.primary, "indexed": c.indexed, "unique": c.unique, "autoinc": c.autoinc, "server_only": c.server_only}) for c in self.columns])

    def lookup_columns(self) -> set[str]:
        """Columns that row queries may name in a predicate."""
        return {c.name for c in self.columns if c.primary or c.indexed or c.unique}

    def altered(self, **changes) -> Table:
        return replace(self, **changes)


@dataclass
class Catalog:
    tables: dict[str, Table] = field(default_factory=dict)

    def add(self, table: Table) -> Table:
        if table.name in self.tables:
            raise TidelogError("bad_schema", f"table {table.name} is declared twice")
        self.tables[table.name] = table
        return table

    def get(self, name: str) -> Table:
        try:
            return self.tables[name]
        except KeyError:
            raise TidelogError("unknown_table", f"no table {name}") from None

    def manifest(self, procedures: dict | None = None) -> str:
        """Public tables, their columns, and the procedures that clients may call, as JSON."""
        shown = [{"name": t.name, "primaryKey": t.pk.name, "columns": [{"name": c.name, "kind": c.kind, "enum": dict(c.enum)} for c in t.columns if not c.server_only]} for t in self.tables.values() if t.public]
        names = sorted(n for n, p in (procedures or {}).items() if p.client_callable)
        return json.dumps({"tables": sorted(shown, key=lambda t: t["name"]), "procedures": names}, sort_keys=True)


def _columns(text: str) -> tuple[Column, ...]:
    """Columns from 'name:kind[!][#][~]' words; ! primary, # indexed, ~ unique."""
    out = []
    for word in text.split():
        name, kind = word.split(":")
        out.append(Column(name, kind.rstrip("!#~"), primary="!" in kind, indexed="#" in kind, unique="~" in kind))
    return tuple(out)


def star_schema() -> Catalog:
    """The declared tables over the star-schema files. Large ones serve aggregates as the relational tier does."""
    c = Catalog()
    declared = {
        "region": ("r_regionkey:int32! r_name:string#", "relational"),
        "nation": ("n_nationkey:int32! n_name:string# n_regionkey:int32#", "relational"),
        "customer": ("c_custkey:int64! c_name:string c_nationkey:int32# c_acctbal:float64 c_mktsegment:string#", "relational"),
        "supplier": ("s_suppkey:int64! s_name:string s_nationkey:int32# s_acctbal:float64", "relational"),
        "part": ("p_partkey:int64! p_name:string p_brand:string# p_type:string p_size:int32# p_retailprice:float64", "relational"),
        "orders": ("o_orderkey:int64! o_custkey:int64# o_orderstatus:string# o_totalprice:float64 o_orderdate:timestamp# o_orderpriority:string", "relational"),
        "events": ("event_id:int64! ts:timestamp# user_id:int64# event_type:string# value:float64 props:string", "relational"),
        "labels": ("doc_id:int64! quality:uint8# toxic:uint8#", "hot"),
        "benchmark": ("item_id:int64! text:string", "hot"),
    }
    for name, (columns, tier) in declared.items():
        c.add(Table(name, _columns(columns), tier=tier))
    return c
