"""Row policies (a union), column masks (an intersection) and who passes them by."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.catalog import TidelogError


def visible_rows(df: DataFrame, policies: Iterable[Column], owner: bool = False) -> DataFrame:
    """Rows that any policy admits; without policies, or for owners, all."""
    each = list(policies)
    return df if owner or not each else df.filter(reduce(lambda a, b: a | b, (F.coalesce(p, F.lit(False)) for p in each)))


def admitted(df: DataFrame, members: DataFrame, on: str) -> DataFrame:
    """Rows whose `on` is in another table, as a policy that looks there: a semi join."""
    return df.join(members.select(on).distinct(), on, "left_semi")


@dataclass(frozen=True)
class Mask:
    """A set of columns, or all but one."""

    columns: frozenset[str]
    inverted: bool = False

    @staticmethod
    def all() -> Mask:
        return Mask(frozenset(), True)

    @staticmethod
    def none() -> Mask:
        return Mask(frozenset())

    @staticmethod
    def only(*names: str) -> Mask:
        return Mask(frozenset(names))

    def excluding(self, *names: str) -> Mask:
        return Mask(self.columns | set(names), True) if self.inverted else Mask(self.columns - set(names))

    def __and__(self, other: Mask) -> Mask:
        if self.inverted and other.inverted:
            return Mask(self.columns | other.columns, True)
        if self.inverted:
            return Mask(other.columns - self.columns)
        return Mask(self.columns - other.columns) if other.inverted else Mask(self.columns & other.columns)

    def shows(self, name: str) -> bool:
        return (name in self.columns) != self.inverted


def masked(df: DataFrame, policies: Iterable[tuple[Column, Mask, Mask]], always: Iterable[str] = ()) -> DataFrame:
    """df with cells nulled that some policy's mask hides. Each policy: a row condition, the mask where it holds and the mask where it doesn't."""
    each, keep = list(policies), set(always)

    def cell(c: str) -> Column:
        seen = F.lit(True)
        for where, yes, no in each:
            seen = seen & F.when(where, F.lit(yes.shows(c))).otherwise(F.lit(no.shows(c)))
        return F.col(c) if c in keep or not each else F.when(seen, F.col(c)).alias(c)

    return df.select(*(cell(c) for c in df.columns))


def check_call(known: bool, client_callable: bool, allowed: bool, within_rate: bool) -> None:
    """A call of a procedure: what may not be called by clients is as unknown as what isn't there."""
    if not known or not client_callable:
        raise TidelogError("unknown_procedure", "no such procedure")
    if not within_rate:
        raise TidelogError("rate_limited", "too many calls")
    if not allowed:
        raise TidelogError("denied", "not allowed")
