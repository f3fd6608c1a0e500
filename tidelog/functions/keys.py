"""Hashes and order-preserving key bytes."""

from __future__ import annotations

import datetime as dt
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidelog.catalog import KINDS, TidelogError


def identity(issuer: Column, subject: Column) -> Column:
    """SHA-256 of issuer, a line end and subject."""
    return F.unhex(F.sha2(F.concat(issuer, F.lit("\n"), subject), 256))


def table_id(name: str) -> int:
    """FNV-1a, 32 bits, of a table's name."""
    h = 0x811C9DC5
    for b in name.encode():
        h = (h ^ b) * 0x01000193 & 0xFFFFFFFF
    return h


def integer_key(value: int, bits: int, signed: bool) -> bytes:
    """Big-endian bytes whose order is that of the values: signed ones get their sign bit flipped."""
    return (value + (1 << (bits - 1)) if signed else value).to_bytes(bits // 8, "big")


EPOCH = dt.datetime(1970, 1, 1)


def key_bytes(kind: str, value: Any) -> bytes:
    """A key's bytes, in the order of the keys of its kind: integers and times big-endian, text as UTF-8, bytes and identities as they are."""
    k = KINDS[kind]
    if not k.key or value is None:
        raise TidelogError("bad_key", f"{value!r} of kind {kind} can't be a key")
    if k.integer:
        return integer_key(int(value), k.width * 8, not k.unsigned)
    if kind == "bool":
        return b"\1" if value else b"\0"
    if kind == "timestamp":
        return integer_key((value - EPOCH) // dt.timedelta(microseconds=1), 64, True)
    return value.encode() if kind == "string" else bytes(value)


def key_value(kind: str, raw: bytes) -> Any:
    """The key that has these bytes."""
    k = KINDS[kind]
    if k.width is not None and len(raw) != k.width:
        raise TidelogError("bad_key", f"{len(raw)} bytes are no {kind}")
    if k.integer or kind == "timestamp":
        n = int.from_bytes(raw, "big") - (0 if k.unsigned else 1 << (k.width * 8 - 1))
        return EPOCH + dt.timedelta(microseconds=n) if kind == "timestamp" else n
    if kind == "bool":
        return raw == b"\1"
    return raw.decode() if kind == "string" else raw
