"""A checked plan as a DataFrame: predicates and columns reach the scan, aggregates run partial and final, order is the language's own."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tidelog.catalog import Catalog, TidelogError
from tidelog.plans.analyze import MAX_BYTES, MAX_ROWS, Mode, Plan, analyze, output_name
from tidelog.plans.sqlsubset import Item, Predicate, parse


def literal(p: Predicate, plan: Plan, i: int = 0) -> Column:
    return F.lit(p.values[i]).cast(plan.table.column(p.column).of.spark)


def condition(plan: Plan) -> Column | None:
    """The predicate as a column; null cells match nothing."""
    p = plan.predicate
    if p is None:
        return None
    c = F.col(p.column)
    if p.op == "between":
        return c.between(literal(p, plan), literal(p, plan, 1))
    return c == literal(p, plan) if p.op == "=" else c != literal(p, plan)


def row_bytes(table, columns=None) -> Column:
    """Bytes of a row in the wire's row format."""
    out = F.lit(0)
    for c in table.columns:
        if columns is not None and c.name not in columns:
            continue
        out = out + (F.lit(c.of.width) if c.of.width is not None else F.when(F.col(c.name).isNull(), F.lit(1)).otherwise(F.octet_length(c.name) + 5))
    return out


def counted(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """df, and the number of rows that an action over it scanned, for the statistics of a table."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows_scanned")), seen


def rows(plan: Plan, df: DataFrame, ordered: bool = True) -> DataFrame:
    where = condition(plan)
    if where is not None:
        df = df.filter(where)
    pk, p = plan.table.pk.name, plan.predicate
    if ordered:
        by_value = p is not None and p.op != "=" and p.column != pk
        df = df.orderBy(*([p.column] if by_value else []), pk)
    return df.select(*plan.columns)


def _key(i: Item) -> Column:
    return F.date_trunc(i.unit, i.column).cast("timestamp_ntz") if i.unit else F.col(i.column)


def _value(i: Item) -> Column:
    if i.function == "COUNT":
        return F.count(F.lit(1) if i.column is None else F.col(i.column))
    return {"SUM": F.sum, "AVG": F.avg, "MIN": F.min, "MAX": F.max}[i.function](i.column)


def aggregate(plan: Plan, df: DataFrame, ordered: bool = True) -> DataFrame:
    where = condition(plan)
    if where is not None:
        df = df.filter(where)
    values = [(i, _value(i)) for i in plan.items if i.function]
    if not plan.group_by:
        return df.agg(*(v.alias(output_name(i)) for i, v in values))
    keys = {(g.column, g.unit): f"_k{n}" for n, g in enumerate(plan.group_by)}
    grouped = df.groupBy(*(_key(g).alias(keys[g.column, g.unit]) for g in plan.group_by))
    out = grouped.agg(*(v.alias(f"_v{n}") for n, (_, v) in enumerate(values))) if values else grouped.agg(F.lit(1).alias("_one"))
    if ordered:
        out = out.orderBy(*(F.asc_nulls_last(k) for k in keys.values()))
    at = iter(range(len(values)))
    return out.select(*(F.col(f"_v{next(at)}" if i.function else keys[i.column, i.unit]).alias(output_name(i)) for i in plan.items))


def run_sql(text: str, catalog: Catalog, read: Callable[[str], DataFrame], params: dict[str, Any] | None = None, mode: Mode = Mode(owner=True), ordered: bool = True) -> DataFrame:
    """Parse, analyze and compile; the DataFrame is the result. read: the current state of a table by its name."""
    plan = analyze(parse(text, params), catalog, mode)
    df = read(plan.table.name)
    return (aggregate if plan.aggregate else rows)(plan, df, ordered)


def checked_size(df: DataFrame, table, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """df, or an error if it has more rows or bytes than may be sent; at most max_rows + 1 rows are looked at."""
    seen = df.limit(max_rows + 1).agg(F.count(F.lit(1)).alias("n"), F.sum(row_bytes(table, df.columns)).alias("b")).first()
    if seen["n"] > max_rows:
        raise TidelogError("too_many_rows", f"more than {max_rows} rows")
    if (seen["b"] or 0) > max_bytes:
        raise TidelogError("too_many_bytes", f"more than {max_bytes} bytes")
    return df
