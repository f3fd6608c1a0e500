"""Blocks of a chunk grid as column expressions: packing, distance and neighbours."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Offsets of the eight neighbours.
NEIGHBOURS = [(dx, dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if (dx, dy) != (0, 0)]


def block(x: Column, size: int) -> Column:
    """The block that holds a coordinate; negative coordinates floor. In integers, so exact for all of 64 bits but the lowest `size`."""
    c = x.cast("long")
    return F.call_function("div", c - F.pmod(c, F.lit(size).cast("long")), F.lit(size).cast("long"))


def pack(bx: Column, by: Column) -> Column:
    """Two 32-bit block coordinates as one 64-bit number."""
    return F.shiftleft(bx.cast("long"), 32).bitwiseOR(by.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))


def unpack(shard: Column) -> tuple[Column, Column]:
    low = shard.bitwiseAND(F.lit(0xFFFFFFFF))
    return F.shiftright(shard, 32), F.when(low >= 1 << 31, low - (1 << 32)).otherwise(low)


def distance(x: Column, y: Column, bx: Column, by: Column, size: int) -> Column:
    """Chebyshev distance of a chunk from a block: 0 inside, 1 beside it."""
    outside = lambda c, b: F.greatest(b * size - c, c - (b * size + size - 1), F.lit(0))
    return F.greatest(outside(x, bx), outside(y, by))
