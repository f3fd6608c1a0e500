"""Partitioned placement: shards of rows, write sets that span them, and the band of rows that neighbours see."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.functions.spatial import NEIGHBOURS, block, distance, pack, unpack
from tidelog.operators.views import DELETE, INSERT, UPDATE

BAND, MARGIN = 2, 1


def instancing(df: DataFrame, column: str) -> DataFrame:
    """shard: an integer column as it is."""
    return df.withColumn("shard", F.col(column).cast("long"))


def spatial(df: DataFrame, x: Column, y: Column, size: int) -> DataFrame:
    """shard, bx and by: the block of a chunk."""
    return df.withColumn("bx", block(x, size)).withColumn("by", block(y, size)).withColumn("shard", pack(F.col("bx"), F.col("by")))


def neighbours(blocks: DataFrame) -> DataFrame:
    """The eight blocks around each block (shard, bx, by), as shard and neighbour."""
    around = F.explode(F.array(*(F.struct((F.col("bx") + dx).alias("x"), (F.col("by") + dy).alias("y")) for dx, dy in NEIGHBOURS))).alias("n")
    return blocks.select("shard", around).select("shard", pack(F.col("n.x"), F.col("n.y")).alias("neighbour"))


@dataclass(frozen=True)
class Instancing:
    """A shard for each value of an integer column."""

    column: str

    def place(self, df: DataFrame) -> DataFrame:
        return instancing(df, self.column)

    def may_commit(self, writes: DataFrame, shard: int) -> DataFrame:
        """Writes that the shard may not commit."""
        return self.place(writes).filter(F.col("shard") != shard)


@dataclass(frozen=True)
class Spatial:
    """A shard for each block of chunks; the owner of a block may also write within `band` chunks around it, where it sees its neighbours' rows."""

    x: str
    y: str
    size: int
    band: int = BAND

    def place(self, df: DataFrame) -> DataFrame:
        return spatial(df, F.col(self.x), F.col(self.y), self.size)

    def may_commit(self, writes: DataFrame, shard: int) -> DataFrame:
        """Writes that the shard may not commit: those farther than the band from its block."""
        bx, by = unpack(F.lit(shard).cast("long"))
        return self.place(writes).filter(distance(F.col(self.x), F.col(self.y), bx, by, self.size) > self.band)


def spanning(writes: DataFrame, txn: str = "txn") -> DataFrame:
    """Transactions whose writes fall in more than one shard."""
    return writes.groupBy(txn).agg(F.count_distinct("shard").alias("shards")).filter("shards > 1")


def border_band(rows: DataFrame, key: str, size: int, band: int = BAND) -> DataFrame:
    """Rows (key, x, y) that each neighbouring block sees: those within band of it. Every row meets its eight neighbours only."""
    owned = rows.withColumn("bx", block(F.col("x"), size)).withColumn("by", block(F.col("y"), size))
    around = F.explode(F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in NEIGHBOURS))).alias("n")
    seen = owned.select(key, "x", "y", pack(F.col("bx"), F.col("by")).alias("owner"), "bx", "by", around)
    seen = seen.withColumn("ox", F.col("bx") + F.col("n.dx")).withColumn("oy", F.col("by") + F.col("n.dy"))
    return seen.filter(distance(F.col("x"), F.col("y"), F.col("ox"), F.col("oy"), size) <= band).select(key, "owner", pack(F.col("ox"), F.col("oy")).alias("observer"))


def border_stream(ops: DataFrame, keys: list[str]) -> DataFrame:
    """Ops as one observer gets them: ops in its scope ship; a row it had that leaves the scope or is deleted ships as a delete; others don't.

    ops: lsn, ordinal, op, in_scope and keys.
    """
    w = Window.partitionBy(*keys).orderBy("lsn", "ordinal")
    now = (F.col("op") != DELETE) & F.col("in_scope")
    marked = ops.withColumn("_now", now).withColumn("_had", F.coalesce(F.lag("_now").over(w), F.lit(False)))
    kind = F.when(F.col("_now"), F.when(F.col("_had"), UPDATE).otherwise(INSERT)).when(F.col("_had"), DELETE)
    return marked.withColumn("ship", kind).filter(F.col("ship").isNotNull()).drop("_now", "_had")


def border_apply(local: DataFrame, shipped: DataFrame, key: str) -> DataFrame:
    """Ops of a neighbour that may touch local rows: borrowed or absent ones; deletes only where the owner agrees.

    local: key, owner (null: the shard's own). shipped: key, op, owner.
    """
    mine = local.select(F.col(key), F.col("owner").alias("_local"), F.lit(True).alias("_here"))
    both = shipped.join(mine, key, "left")
    borrowed = F.col("_here") & F.col("_local").isNotNull()
    op = F.when(F.col("op") == DELETE, F.when(borrowed & (F.col("_local") == F.col("owner")), DELETE)).when(borrowed, UPDATE).when(F.col("_here").isNull(), INSERT)
    return both.select(key, op.alias("op"), "owner").filter(F.col("op").isNotNull())


def boundary(rows: DataFrame, key: str, size: int, margin: int = MARGIN) -> DataFrame:
    """Where a row stands to its home block (home_x, home_y): crossed with its depth, approaching within margin of the edge, or interior."""
    depth = distance(F.col("x"), F.col("y"), F.col("home_x"), F.col("home_y"), size)
    edge = lambda c, b: F.least(c - b * size, b * size + size - 1 - c)
    inner = F.least(edge(F.col("x"), F.col("home_x")), edge(F.col("y"), F.col("home_y")))
    state = F.when(depth > margin, "crossed").when((depth > 0) | (inner < margin), "approaching").otherwise("interior")
    return rows.select(key, depth.alias("depth"), state.alias("state"))


def rebalance_pick(load: DataFrame) -> DataFrame:
    """The hottest and the coolest node by the sum of their shards' load; equal ones by name. load: node, shard, load."""
    nodes = load.groupBy("node").agg(F.sum("load").alias("load"))
    return nodes.agg(F.max_by("node", F.struct("load", _reversed_name())).alias("hottest"), F.min_by("node", F.struct("load", "node")).alias("coolest"))


def _reversed_name() -> Column:
    """A key that falls as the name rises, so that the first of equal names is the largest."""
    return F.translate(F.hex(F.col("node").cast("binary")), "0123456789ABCDEF", "FEDCBA9876543210")


def sustained(samples: DataFrame, window: int) -> DataFrame:
    """Mean load over (ts - window, ts] of each sample, null unless an older sample shows that the window is full. samples: shard, ts (long), load."""
    w = Window.partitionBy("shard").orderBy("ts")
    mean = F.avg("load").over(w.rangeBetween(-window + 1, 0))
    full = F.min("ts").over(w.rangeBetween(Window.unboundedPreceding, 0)) <= F.col("ts") - window
    return samples.withColumn("sustained", F.when(full, mean))


def empty_shards(shards: DataFrame) -> DataFrame:
    """Shards with no rows, not draining and lately reported, in order."""
    return shards.filter((F.col("rows") == 0) & ~F.col("draining") & F.col("fresh")).select("shard").orderBy("shard")


def rebalance_move(load: DataFrame, hot: float, now: int = 0, rest: int = 0) -> DataFrame:
    """The one move that relieves a hot node, or no row: the heaviest shard of the hottest node that leaves the coolest one below it.

    load: node, shard, load, moved (when it was last moved; null: never). hot: the load beyond which a node is hot. A shard rests for `rest` after a move;
    a node with a single shard can't be helped. Equal nodes and shards go by name. Nodes are few: they are summed to one row.
    """
    nodes = load.groupBy("node").agg(F.sum("load").alias("total"), F.count(F.lit(1)).alias("shards"))
    hottest = nodes.agg(F.max_by(F.struct("node", "total", "shards"), F.struct("total", _reversed_name())).alias("h"))
    others = nodes.join(F.broadcast(hottest), F.col("node") != F.col("h.node"))
    pick = others.groupBy("h").agg(F.min_by(F.struct("node", "total"), F.struct("total", "node")).alias("c"))
    pick = pick.filter((F.col("h.total") > hot) & (F.col("h.shards") > 1))
    mine = load.join(F.broadcast(pick), F.col("node") == F.col("h.node"))
    fit = mine.filter((F.col("load") > 0) & (F.col("c.total") + F.col("load") < F.col("h.total")) & (F.col("moved").isNull() | (F.lit(now) - F.col("moved") >= rest)))
    best = fit.agg(F.max_by(F.struct("shard", F.col("node").alias("origin"), F.col("c.node").alias("target"), "load"), F.struct("load", -F.col("shard"))).alias("m"))
    return best.filter("m is not null").select("m.*")


def drain(load: DataFrame, leaving: DataFrame) -> DataFrame:
    """Where the shards of leaving nodes go: heaviest first, in turn to the nodes that stay, coolest first. load: node, shard, load; leaving: node."""
    gone = F.broadcast(leaving.select("node").distinct())
    stay = load.groupBy("node").agg(F.sum("load").alias("total")).join(gone, "node", "left_anti").orderBy("total", "node")
    names = [r["node"] for r in stay.collect()]  # the nodes of a cluster
    if not names:
        return load.join(gone, "node", "left_semi").select("shard", F.col("node").alias("origin"), F.lit(None).cast("string").alias("target"))
    turn = (F.row_number().over(Window.partitionBy("node").orderBy(F.desc("load"), "shard")) - 1) % len(names)
    moving = load.join(gone, "node", "left_semi")
    return moving.select("shard", F.col("node").alias("origin"), F.element_at(F.array(*map(F.lit, names)), turn + 1).alias("target"))


def reapable(shards: DataFrame) -> DataFrame:
    """Empty shards whose events have all been shipped: their log may go. shards: shard, rows, draining, fresh, head, cursor."""
    return empty_shards(shards.filter(F.col("cursor") >= F.col("head")))
