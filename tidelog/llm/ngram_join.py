"""N-gram Jaccard join: prefix trees over globally ordered shingle sets, with subtrees pruned by the overlap that could still be reached.

1. Each document gives its set of shingle hashes. Equal sets are one class with one representative; only classes go on.
2. In the order of hashes, two linked sets share at least `need` of their first prefix_len shingles. Prefix shingles are counted over the corpus;
   a class with fewer recurring ones has no partner. A recurring shingle's hub is its smallest class. If a class has h hubs, some hub holds
   need / h of what it shares with a partner, and the same hub does so for the partner: both meet in that hub's bucket.
3. A bucket's sets are ordered by falling frequency in a trie. Every set traverses it, sharing the partial overlaps of common paths; a subtree is
   left when overlap so far plus what remains on either side can't reach the least overlap that its sizes require. Links come as spanning edges.
4. A bucket of many sets or shingles is split into blocks, and pairs of blocks are tasks of their own. One of more than a few blocks is first held against
   pivots, the sets that share most with its hub: sets linked with a pivot have its label and are known to be connected, so pairs of one label are no
   task. A large group of near copies thus costs its size and not its square, no link is lost, and no task holds a whole hot bucket.
5. Edges become components by alternating large-star and small-star steps, and classes give them to their documents.

Joins on shingles, buckets, nodes and set hashes broadcast the few keys that hold very many rows, so one hot key doesn't make one long task.

Results: null or wordless texts have no shingles and link with nothing. Repeated rows are rows of one class. A null id takes part; ids of a component
are compared without nulls. Empty tables give empty results; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm import textnp as tn
from tidelog.llm.common import dropped, parts, release, saved, small, spread_join, trimmed, tuned

WORDS = 5
PERCENT = 80
#: Share of a set that its prefix holds beyond what the threshold asks for; more makes buckets finer.
SPARE = 0.06
#: Sets, and shingles of sets, in one block of a bucket.
BLOCK, BLOCK_SHINGLES = 1024, 1 << 20
#: Sets that all others of a bucket are held against, where it has more blocks than PAIRED; pairs of few blocks cost less than another pass over the sets.
PIVOTS, PAIRED = 4, 4
#: Bytes of a row of two to five numbers once broadcast.
ROW_BYTES = 96


def shingle_sets(data: np.ndarray, off: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each document, ascending, and their offsets. Fewer words than `words` make one shingle."""
    start, end, first = tn.words(tn.LOWER[data], off)
    h = tn.span_hash(tn.LOWER[data], start, end)
    n = np.diff(first)
    g = tn.gram_hash(h, words)
    doc = np.repeat(np.arange(len(n)), np.maximum(n - words + 1, 0))
    at = tn.ranges(first[:-1][n >= words], first[1:][n >= words] - words)
    few = np.flatnonzero((n > 0) & (n < words))
    short = tn.Prefix(h, tn.GRAM_BASE_2).spans(first[few], first[few + 1])
    doc, g = np.concatenate([doc, few]), np.concatenate([g[at], short])
    order = np.lexsort((g, doc))
    doc, g = doc[order], g[order]
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (g[1:] != g[:-1])])[: len(g)]
    doc, g = doc[new], g[new]
    return g, np.searchsorted(doc, np.arange(len(n) + 1))


def set_hashes(g: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each set."""
    sums = [np.concatenate([np.zeros(1, tn.U), np.cumsum(tn.mix(g ^ tn.U(salt)))]) for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F)]
    return tuple(s[at[1:]] - s[at[:-1]] for s in sums)


def least_overlap(n: np.ndarray, percent: int) -> np.ndarray:
    """Shingles that a set of n must share with a linked one."""
    return -(-n * percent // 100)


def prefix_len(n: np.ndarray, percent: int) -> np.ndarray:
    return np.minimum(n, n - least_overlap(n, percent) + np.maximum(1, np.ceil(SPARE * n).astype(np.int64)))


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values.view(np.int64)))


def _prefixes(words: int, percent: int):
    """Sizes, hashes and prefixes of the texts' sets, behind the column row."""

    def run(batches):
        for b in batches:
            for lo, hi, data, off in tn.texts(b.column("text")):
                g, at = shingle_sets(data, off, words)
                s1, s2 = set_hashes(g, at)
                n = np.diff(at)
                size = prefix_len(n, percent)
                some = size > 0
                pre = g[tn.ranges(at[:-1][some], at[:-1][some] + size[some] - 1)]
                yield pa.RecordBatch.from_arrays([b.column("row").slice(lo, hi - lo), pa.array(n), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), _lists(pre, size)], names=["row", "n", "s1", "s2", "pre"])

    return run


def _whole_sets(words: int):
    def run(batches):
        for b in batches:
            s1, s2 = tn.as_u64(b.column("s1")), tn.as_u64(b.column("s2"))
            for lo, hi, data, off in tn.texts(b.column("text")):
                g, at = shingle_sets(data, off, words)
                h1, h2 = set_hashes(g, at)
                same = np.flatnonzero((h1 == s1[lo:hi]) & (h2 == s2[lo:hi]))
                if len(same):
                    sizes = np.diff(at)[same]
                    yield pa.RecordBatch.from_arrays([b.column("cls").slice(lo, hi - lo).take(pa.array(same)), _lists(g[tn.ranges(at[same], at[same + 1] - 1)], sizes)], names=["cls", "tokens"])

    return run


class Trie:
    """A radix tree over ascending rank sequences; nodes are rows of arrays, children of one node stand together."""

    def __init__(self, sequences: list[np.ndarray], sizes: np.ndarray):
        order = sorted(range(len(sequences)), key=lambda i: sequences[i].astype(">u4").tobytes())
        self.order = np.array(order, np.int64)
        self.seq = [sequences[i] for i in order]
        self.size = sizes[self.order]
        length = np.array([len(s) for s in self.seq], np.int64)
        self.off = np.concatenate([[0], np.cumsum(length)])
        self.flat = np.concatenate([*self.seq, np.zeros(0, np.int64)])
        n = len(self.seq)
        nodes: list[tuple] = []  # depth above, depth, first leaf, leaf after the last, first child, child after the last
        queue = [(0, lo, hi) for lo, hi in self._split(0, n, 0)]
        self.tops = np.arange(len(queue))
        for above, lo, hi in queue:  # grows on the way
            depth = int(length[lo]) if hi - lo == 1 else self._common(lo, hi - 1, above)
            begin = len(queue)
            if hi - lo > 1:
                queue.extend((depth, a, b) for a, b in self._split(lo, hi, depth))
            nodes.append((above, depth, lo, hi, begin, len(queue)))
        a = np.array(nodes, np.int64).reshape(-1, 6)
        self.above, self.depth, self.lo, self.hi, self.child = a[:, 0], a[:, 1], a[:, 2], a[:, 3], a[:, 4:]
        edges = np.stack([self.lo, self.hi], axis=1).ravel()
        pad = lambda x, fill: np.concatenate([x, [fill]])
        if n:
            self.least = np.minimum.reduceat(pad(self.size, 1 << 60), edges)[::2]
            self.most = np.maximum.reduceat(pad(self.size, 0), edges)[::2]
            self.rest = np.maximum.reduceat(pad(length, 0), edges)[::2] - self.depth

    def _common(self, lo: int, hi: int, depth: int) -> int:
        a, b = self.seq[lo], self.seq[hi]
        n = min(len(a), len(b))
        differ = np.flatnonzero(a[depth:n] != b[depth:n])
        return depth + int(differ[0]) if len(differ) else n

    def _split(self, lo: int, hi: int, depth: int) -> list[tuple[int, int]]:
        """Leaf ranges with equal entries at depth; sequences that end there are leaves of their own and come first."""
        out = []
        while lo < hi and len(self.seq[lo]) == depth:
            out.append((lo, lo + 1))
            lo += 1
        while lo < hi:
            x = self.seq[lo][depth]
            a, b = lo + 1, hi
            while a < b:
                m = (a + b) // 2
                a, b = (m + 1, b) if self.seq[m][depth] == x else (a, m)
            out.append((lo, a))
            lo = a
        return out

    def linked(self, x: np.ndarray, nx: int, mark: np.ndarray, percent: int, leaf: int = -1, one: bool = False) -> np.ndarray:
        """Leaves after `leaf` whose sets are linked with x, a sequence of a set of nx; with one, only the first ones found. mark: scratch over ranks, all zero."""
        mark[x] = 1
        at, overlap, found = self.tops, np.zeros(len(self.tops), np.int64), []
        while len(at):
            ahead = (self.hi[at] > leaf + 1) & (100 * self.most[at] >= percent * nx) & (100 * nx >= percent * self.least[at])
            at, overlap = at[ahead], overlap[ahead]
            if not len(at):
                break
            begin, end = self.off[self.lo[at]] + self.above[at], self.off[self.lo[at]] + self.depth[at]
            some = end > begin
            gain = np.zeros(len(at), np.int64)
            if some.any():
                path = mark[self.flat[tn.ranges(begin[some], end[some] - 1)]]
                gain[some] = np.add.reduceat(path, np.concatenate([[0], np.cumsum((end - begin)[some])[:-1]]))
            overlap = overlap + gain
            last = np.where(self.depth[at] > 0, self.flat[np.maximum(end - 1, 0)] if len(self.flat) else 0, -1)
            remains = np.minimum(len(x) - np.searchsorted(x, last, "right"), self.rest[at])
            fits = (100 + percent) * (overlap + remains) >= percent * (nx + self.least[at])
            at, overlap = at[fits], overlap[fits]
            leaves = self.hi[at] - self.lo[at] == 1
            ends = at[leaves]
            good = (100 + percent) * overlap[leaves] >= percent * (nx + self.size[self.lo[ends]])
            found.append(self.lo[ends[good]])
            if one and good.any():
                break
            at, overlap = at[~leaves], overlap[~leaves]
            kids = self.child[at]
            overlap = np.repeat(overlap, kids[:, 1] - kids[:, 0])
            at = tn.ranges(kids[:, 0], kids[:, 1] - 1)
        mark[x] = 0
        hits = np.concatenate(found) if found else np.zeros(0, np.int64)
        return hits[hits > leaf]


def _ranked(tokens: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Each set as ascending ranks by falling frequency, without shingles that no other set has; the sets' sizes; and scratch over ranks."""
    sizes = np.array([len(t) for t in tokens], np.int64)
    values, inverse, count = np.unique(np.concatenate(tokens), return_inverse=True, return_counts=True)
    order = np.lexsort((values, -count))
    rank = np.empty(len(values), np.int64)
    rank[order] = np.arange(len(values))
    ranks, keep = rank[inverse], (count > 1)[inverse]
    off = np.concatenate([[0], np.cumsum(sizes)])
    return [np.sort(ranks[off[i] : off[i + 1]][keep[off[i] : off[i + 1]]]) for i in range(len(tokens))], sizes, np.zeros(len(values) + 1, np.int64)


class Forest:
    """Components of n numbers by the edges that were let in: those that join two of them."""

    def __init__(self, n: int):
        self.root = list(range(n))

    def _find(self, i: int) -> int:
        root = self.root
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def joins(self, i: int, j: int) -> bool:
        a, b = self._find(i), self._find(j)
        self.root[max(a, b)] = min(a, b)
        return a != b


def join_bucket(tokens: list[np.ndarray], percent: int = PERCENT) -> list[tuple[int, int]]:
    """Edges that span the components of the sets given, each an array of distinct hashes."""
    n = len(tokens)
    if n < 2:
        return []
    seqs, sizes, mark = _ranked(tokens)
    trie, forest, edges = Trie(seqs, sizes), Forest(n), []
    for leaf in range(n):
        for other in trie.linked(trie.seq[leaf], int(trie.size[leaf]), mark, percent, leaf).tolist():
            if forest.joins(leaf, other):
                edges.append((int(trie.order[leaf]), int(trie.order[other])))
    return edges


def join_blocks(asking: list[np.ndarray], asked: list[np.ndarray], percent: int = PERCENT, connected: bool = False) -> list[tuple[int, int]]:
    """Edges that span what one block's sets are linked with of another's. connected: the asked ones are of one component, so one link of each asking set is
    enough."""
    if not asking or not asked:
        return []
    seqs, sizes, mark = _ranked([*asking, *asked])
    n = len(asking)
    trie, forest, edges = Trie(seqs[n:], sizes[n:]), Forest(n + len(asked)), []
    for i in range(n):
        for leaf in trie.linked(seqs[i], int(sizes[i]), mark, percent, one=connected)[: 1 if connected else None].tolist():
            if forest.joins(i, n + leaf):
                edges.append((i, int(trie.order[leaf])))
    return edges


def _groups(batches, keys: list[str], columns: list[str]):
    """Runs of rows with equal keys: the key, and for each row the columns and its shingles."""
    key, rows = None, []
    for batch in batches:
        lists = batch.column("tokens")
        at = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
        values = tn.as_u64(lists.flatten())
        for k, row in enumerate(zip(*(batch.column(c).to_pylist() for c in [*keys, *columns]), strict=True)):
            if row[: len(keys)] != key:
                if rows:
                    yield key, rows
                key, rows = row[: len(keys)], []
            rows.append((*row[len(keys) :], values[at[k] : at[k + 1]]))
    if rows:
        yield key, rows


def _edges(percent: int):
    """Rows sorted by bucket, block i and block j. Gives edges that span what is linked between the blocks, or within one."""

    def run(batches):
        for (_, i, j), rows in _groups(batches, ["bucket", "i", "j"], ["b", "cls", "label"]):
            sides = [{cls: (tokens, label) for b, cls, label, tokens in rows if b == side} for side in ((i, j) if i != j else (i,))]
            if i == j:
                a = z = list(sides[0])
                pairs = join_bucket([sides[0][c][0] for c in a], percent)
            else:
                # a block with a label is one component: it is asked
                if any(label is not None for _, label in sides[0].values()):
                    sides.reverse()
                a, z = map(list, sides)
                one = all(label is not None for _, label in sides[1].values())
                pairs = join_blocks([sides[0][c][0] for c in a], [sides[1][c][0] for c in z], percent, one)
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array([a[x] for x, _ in pairs], pa.int64()), pa.array([z[y] for _, y in pairs], pa.int64())], names=["u", "v"])

    return run


def _labels(percent: int):
    """Rows sorted by bucket, block and rank (pivots have one, others come last). Gives each set's bucket and label: the first pivot it is linked with."""

    def run(batches):
        for (bucket, _), rows in _groups(batches, ["bucket", "b"], ["rank", "cls"]):
            pivots = {cls: tokens for rank, cls, tokens in rows if rank < PIVOTS}
            sets = {cls: tokens for rank, cls, tokens in rows if rank == PIVOTS}
            linked: dict[int, list[int]] = {}
            for pivot, tokens in pivots.items():
                for i, _ in join_blocks(list(sets.values()), [tokens], percent):
                    linked.setdefault(i, []).append(pivot)
            names = list(sets)
            at = list(range(len(names)))
            edges = [linked.get(i, []) for i in at]
            yield pa.RecordBatch.from_arrays([pa.array([bucket] * len(at), pa.int64()), pa.array(names, pa.int64()), pa.array([e[0] if e else None for e in edges], pa.int64()), pa.array(edges, pa.list_(pa.int64()))], names=["bucket", "cls", "label", "pivots"])

    return run


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """node and root (its component's smallest node) for every node of the edges. Rounds end when no edge changes."""
    now = saved(edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).filter("u <> v").distinct(), "edges")
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("c"))
        large = spread_join(both, least, ["u"], "c", "inner").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = saved(large, "edges")
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("c"))
        joined = spread_join(large, least, ["u"], "c", "inner")
        small_star = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        then = saved(small_star, "edges")
        # stars: every node has one edge, and to a node that has none
        changed = not then.select("u").intersect(then.select("v")).isEmpty() or not then.groupBy("u").count().filter("count > 1").isEmpty()
        dropped(now, large)
        now = then
        if not changed:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _blocks(size: Column, shingles: Column) -> Column:
    return F.greatest(F.ceil(size / BLOCK), F.ceil(shingles / BLOCK_SHINGLES)).cast("int")


def _labelled(homes: DataFrame, sets: DataFrame, n_parts: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Buckets of several blocks held against their pivots. Gives homes with label, offset (the label's first block), m (its blocks) and all (the bucket's
    blocks); and the links found. homes: cls, bucket, count, n and m."""
    mine = lambda m: F.pmod(F.xxhash64("cls"), m).cast("int")
    lots = homes.groupBy("bucket", F.pmod(F.xxhash64("cls", F.lit(1)), F.lit(PIVOTS)).alias("lot")).agg(F.max(F.struct("count", "cls")).alias("top"), F.first("m").alias("m"))
    rank = F.row_number().over(Window.partitionBy("bucket").orderBy(F.desc("top"))) - 1  # of PIVOTS rows
    pivots = lots.select("bucket", rank.alias("rank"), F.col("top.cls").alias("cls"), F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("b"))
    tasks = saved(homes.select("bucket", F.lit(PIVOTS).alias("rank"), "cls", mine(F.col("m")).alias("b")).unionByName(pivots), "tasks")
    rows = tasks.join(sets, "cls").repartition(n_parts, "bucket", "b").sortWithinPartitions("bucket", "b", "rank")
    labels = saved(rows.mapInArrow(trimmed(_labels(percent)), "bucket long, cls long, label long, pivots array<long>"), "labels")
    known = labels.select("bucket", "cls", "label").join(homes.select("bucket", "cls", "n"), ["bucket", "cls"])
    each = known.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("shingles")).withColumn("m", _blocks(F.col("size"), F.col("shingles")))
    so_far = Window.partitionBy("bucket").orderBy(F.col("label").asc_nulls_first())  # PIVOTS + 1 rows at most
    placed = each.select("bucket", F.coalesce("label", F.lit(-1)).alias("l"), "m", (F.sum("m").over(so_far) - F.col("m")).cast("int").alias("offset"), F.sum("m").over(Window.partitionBy("bucket")).cast("int").alias("all"), F.col("size").alias("c"))
    placed = saved(placed, "placed")
    out = spread_join(known.select("bucket", "cls", "label", F.coalesce("label", F.lit(-1)).alias("l")), placed, ["bucket", "l"], "c", "inner").drop("l")
    return out, labels.select(F.explode("pivots").alias("u"), F.col("cls").alias("v"))


def _row(id_col: str, text_col: str) -> Column:
    """A row's id with nulls last, and 128 bits of its id and text that tell it from other rows."""
    i, t = F.col(id_col), F.col(text_col)
    return F.struct(i.isNull().alias("none"), i.alias("id"), F.xxhash64(i.isNull(), i, t).alias("h1"), F.xxhash64(F.lit(1), i.isNull(), i, t).alias("h2"))


def _linked(narrow: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Every row of narrow (row, text) with n, s1 and s2 of its set; and for each set comp, the least row of its component, and c, its number of rows."""
    spark = narrow.sparkSession
    kind, n_parts = narrow.schema["row"].dataType.simpleString(), parts(narrow.select("row", "text"))
    every = saved(narrow.mapInArrow(trimmed(_prefixes(words, percent)), f"row {kind}, n long, s1 long, s2 long, pre array<long>"), "sets")
    classes = every.filter("n > 0").groupBy("s1", "s2").agg(F.min("row").alias("rep"), F.first("n").alias("n"), F.first("pre").alias("pre"), F.count(F.lit(1)).alias("c"))
    classes = saved(classes.withColumn("cls", F.monotonically_increasing_id()), "classes")
    tokens = classes.select("cls", F.explode("pre").alias("t"))
    hubs = saved(tokens.groupBy("t").agg(F.count(F.lit(1)).alias("c"), F.min("cls").alias("hub")).filter("c > 1"), "hubs")
    met = saved(spread_join(tokens, hubs, ["t"], "c", "inner").groupBy("cls", "hub").count(), "met")
    dropped(hubs)
    sums = met.groupBy("cls").agg(F.sum("count").alias("all"), F.count(F.lit(1)).alias("h"))
    need = F.greatest(F.lit(1.0), F.col("n") * (SPARE * percent / 100))
    alive = classes.select("cls", "n").join(sums, "cls").filter(F.col("all") >= F.ceil(need - 1e-9)).withColumn("least", need / F.col("h") - 1e-9).select("cls", "n", "least")
    found = saved(met.join(alive, "cls").filter(F.col("count") >= F.col("least")).select("cls", F.col("hub").alias("bucket"), "count", "n"), "homes")
    sizes = found.groupBy("bucket").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("shingles")).filter("c > 1")
    sizes = saved(sizes.select("bucket", "c", _blocks(F.col("c"), F.col("shingles")).alias("m")), "sizes")
    homes = saved(spread_join(found, sizes, ["bucket"], "c", "inner"), "homes")
    wanted = classes.join(homes.select("cls").distinct(), "cls").select("cls", F.col("rep.h1").alias("r1"), F.col("rep.h2").alias("r2"), "s1", "s2")
    wanted = saved(wanted, "wanted")
    dropped(met, found)
    side = F.broadcast(wanted) if small(wanted.count(), ROW_BYTES) else wanted
    sets = narrow.join(side, (F.col("row.h1") == F.col("r1")) & (F.col("row.h2") == F.col("r2"))).select("cls", "s1", "s2", "text")
    sets = saved(sets.mapInArrow(trimmed(_whole_sets(words)), "cls long, tokens array<long>"), "whole")
    none, zero = F.lit(None).cast("long").alias("label"), F.lit(0)
    split, links = homes.filter(F.col("m") <= PAIRED).select("bucket", "cls", none, "m", zero.alias("offset"), F.col("m").alias("all")), None
    if not sizes.filter(F.col("m") > PAIRED).isEmpty():
        more, links = _labelled(homes.filter(F.col("m") > PAIRED), sets, n_parts, percent)
        split = split.unionByName(more)
    b = (F.col("offset") + F.pmod(F.xxhash64("cls"), F.col("m"))).cast("int")
    others = split.withColumn("b", b).withColumn("o", F.explode(F.sequence(zero, F.col("all") - 1)))
    others = others.filter(F.col("label").isNull() | (F.col("o") < F.col("offset")) | (F.col("o") >= F.col("offset") + F.col("m")))
    tasks = saved(others.select("cls", "bucket", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), "b", "label"), "tasks")
    groups = tasks.join(sets, "cls").repartition(n_parts, "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    edges = groups.mapInArrow(trimmed(_edges(percent)), "u long, v long")
    edges = saved(edges if links is None else edges.unionByName(links), "edges")
    dropped(sets, homes, sizes, wanted, tasks)
    roots = components(edges)
    least = roots.join(classes.select(F.col("cls").alias("node"), "rep"), "node")
    groups = least.groupBy("root").agg(F.min("rep").alias("comp"), F.count(F.lit(1)).alias("c"))
    least = saved(spread_join(least, saved(groups, "roots"), ["root"], "c", "inner").select(F.col("node").alias("cls"), "comp"), "least")
    named = saved(classes.select("s1", "s2", "cls", "rep", "c").join(least, "cls", "left").select("s1", "s2", F.coalesce("comp", "rep").alias("comp"), "c"), "named")
    dropped(classes, edges, least)
    release(spark)
    return every, named


def ngram_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """For each document: its id, n_shingles and component_id, the smallest id reachable by links.

    Two documents link when 100 * shared shingles >= percent * shingles of either.
    """
    tuned(docs.sparkSession)
    every, named = _linked(docs.select(_row(id_col, text_col).alias("row"), F.col(text_col).alias("text")), words, percent)
    rows = every.select(F.col("row.id").alias("id"), "n", "s1", "s2")
    out = spread_join(rows.filter("n > 0"), named.select("s1", "s2", F.col("comp.id").alias("comp"), "c"), ["s1", "s2"], "c", "left").select("id", "n", "comp")
    out = out.unionByName(rows.filter("n = 0").select("id", "n", F.col("id").alias("comp")))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("comp").alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """docs with one row of each group of linked ones: that with the smallest id, null last, and of several texts with that id the one of the smallest hash.

    Documents without words stay; of rows with equal id and text one stays. Rows are told apart by 128-bit hashes of id and text, so a null or repeated id
    decides nothing for other rows that have it.
    """
    tuned(docs.sparkSession)
    row = _row(id_col, text_col)
    every, named = _linked(docs.select(row.alias("row"), F.col(text_col).alias("text")), words, percent)
    keys = every.groupBy(F.col("row.h1").alias("h1"), F.col("row.h2").alias("h2")).agg(F.count(F.lit(1)).alias("times"), *(F.first(x).alias(x) for x in ("n", "s1", "s2")))
    keys = saved(keys, "keys")
    with_words = spread_join(keys.filter("n > 0"), named.select("s1", "s2", F.col("comp.h1").alias("m1"), F.col("comp.h2").alias("m2"), "c"), ["s1", "s2"], "c", "left")
    drop = (F.col("h1") != F.col("m1")) | (F.col("h2") != F.col("m2"))
    marked = with_words.select("h1", "h2", "times", drop.alias("drop")).unionByName(keys.filter("n = 0").select("h1", "h2", "times", F.lit(False).alias("drop")))
    # names that no column of docs has
    k1, k2 = (f"_key_{uuid.uuid4().hex}" for _ in range(2))
    found = saved(marked.filter("drop or times > 1").select("drop", F.col("h1").alias(k1), F.col("h2").alias(k2)), "drop")
    dropped(every, named, keys)
    same = (row["h1"] == F.col(k1)) & (row["h2"] == F.col(k2))

    def side(which: str) -> tuple[DataFrame, int]:
        rows = found.filter(which).drop("drop")
        n = rows.count()
        return F.broadcast(rows) if small(n, ROW_BYTES) else rows, n

    kept = docs.join(side("drop")[0], same, "left_anti")
    twice, n_twice = side("not drop")
    if n_twice:
        kept = kept.join(twice, same, "left_anti").unionByName(kept.join(twice, same, "left_semi").dropDuplicates([id_col, text_col]))
    return kept
