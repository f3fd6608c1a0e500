"""Benchmark decontamination: spaced seeds find near copies of test items in documents, and aligned words around each hit are verified.

Texts become words without regard to A-Z case and ASCII punctuation. A mask picks some of a few consecutive words and ignores the rest; equal words at
the picked places make a hit whatever stands at the others, so substituted words don't hide a copy. Each item's masked words are hashed at every place
and joined with those of the documents; a hit fixes the alignment of document and item. Along it, every stretch of WINDOW words (the whole item if it
is shorter) with at least `percent` equal words is an overlap. The masks let no such stretch without a hit when substitutions leave one mask's places whole.

Of hits that follow each other on one alignment only the first is listed: an item's places are sorted by masked words and by the masked words before them, so
those that merely go on are skipped as a range. Repetitive texts thus cost one hit an alignment. Alignments are verified in blocks of bounded size, and
overlaps of one document and item that touch or lie in each other are one.

Items go to all tasks in tables of at most SIDE_BYTES of text, one at a time. With more than one, each is a pass over the documents that writes nothing but the
overlaps it found, by a 128-bit hash of the text; these are joined with the documents at the end. Neither driver nor task holds more than one table.

Results: null or wordless documents and items have no overlap. Items of SHORTEST to MIN_WORDS - 1 words must be there word for word; shorter ones are left out as
too short to tell. Item ids may be of any type; a null one is an item like others. Repeated rows get equal results. Empty tables give empty results or no
overlaps; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm import textnp as tn
from tidelog.llm.common import saved, spread_join, trimmed, tuned

#: Places that a mask compares (1) and ignores (0); the last compares all.
MASKS = ("11010011", "10110101", "110111", "11111")
WINDOW = 13
PERCENT = 80
#: Items of fewer words have to be there word for word; those below SHORTEST aren't sought.
MIN_WORDS, SHORTEST = 8, 5
SIDE_BYTES = 8 << 20
#: Hits that are listed, and words that are compared, at a time.
BLOCK_HITS, BLOCK_WORDS = 1 << 20, 1 << 20
PARTS = np.zeros(256, bool)
PARTS[[c for c in range(128) if not chr(c).isalnum()]] = True
#: Stand for the masked words before an item's and a document's first ones.
BEFORE_ITEM, BEFORE_DOC = tn.U(0), tn.U(1)


def plain_words(data: np.ndarray, off: np.ndarray):
    low = tn.LOWER[data]
    start, end, first = tn.words(np.where(PARTS[low], np.uint8(32), low), off)
    return start, end, first, tn.span_hash(low, start, end)


def masked(h: np.ndarray, mask: str, salt: int) -> np.ndarray:
    """Hash of the picked words from each place on."""
    n = len(h) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, tn.U)
    out = np.full(n, salt, tn.U)
    for i, c in enumerate(mask):
        if c == "1":
            out = out * tn.U(tn.GRAM_BASE) + h[i : i + n]
    return np.maximum(tn.mix(out), tn.U(2))


def _first_not_less(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, x: np.ndarray, after: bool = False) -> np.ndarray:
    """For each range lo..hi of ascending values, where x would go: before equal ones, or after them."""
    lo, hi = lo.copy(), hi.copy()
    while True:
        open_ = np.flatnonzero(lo < hi)
        if not len(open_):
            return lo
        m = (lo[open_] + hi[open_]) // 2
        less = values[m] <= x[open_] if after else values[m] < x[open_]
        lo[open_[less]] = m[less] + 1
        hi[open_[~less]] = m[~less]


class Items:
    """The items' words and, for each mask, their hashes in order with the hash before and the place; a bitmap turns most documents' words away at once."""

    BITS = 20

    def __init__(self, texts: pa.Array):
        parts = [plain_words(data, off)[2:] for _, _, data, off in tn.texts(texts)]
        self.h = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, tn.U)
        size = np.concatenate([np.diff(p[0]) for p in parts]) if parts else np.zeros(0, np.int64)
        self.first = np.concatenate([[0], np.cumsum(size)])
        item = tn.owners(self.first)
        self.keys, self.before, self.place, self.seen = [], [], [], []
        for m, mask in enumerate(MASKS):
            g = masked(self.h, mask, m + 1)
            at = np.arange(len(g))
            of = item[: len(g)]
            at = at[(at + len(mask) <= self.first[of + 1]) & (size[of] >= SHORTEST)]
            before = np.where(at > self.first[item[at]], g[at - 1], BEFORE_ITEM) if len(at) else g[:0]
            order = np.lexsort((before, g[at]))
            self.keys.append(g[at][order])
            self.before.append(before[order])
            self.place.append(at[order].astype(np.int32))
            seen = np.zeros(1 << self.BITS, bool)
            seen[(g[at] >> tn.U(64 - self.BITS)).astype(np.int64)] = True
            self.seen.append(seen)

    def hits(self, h: np.ndarray, first: np.ndarray) -> Iterator[np.ndarray]:
        """Blocks of distinct (document, item, shift) of hits that no hit on the same alignment stands right before. shift: document word minus item word."""
        found, size = [], 0

        def distinct() -> np.ndarray:
            a = np.concatenate(found, axis=1)
            a = a[:, np.lexsort(a)]
            new = np.concatenate([[True], (np.diff(a, axis=1) != 0).any(axis=0)])[: a.shape[1]]
            return a[:, new]

        for m, mask in enumerate(MASKS):
            g = masked(h, mask, m + 1)
            at = np.flatnonzero(self.seen[m][(g >> tn.U(64 - self.BITS)).astype(np.int64)])
            a, b = np.searchsorted(self.keys[m], g[at]), np.searchsorted(self.keys[m], g[at], "right")
            doc = np.searchsorted(first, at, "right") - 1
            fit = (b > a) & (at + len(mask) <= first[doc + 1])
            at, a, b, doc = at[fit], a[fit], b[fit], doc[fit]
            before = np.where(at > first[doc], g[at - 1], BEFORE_DOC)
            skip, on = _first_not_less(self.before[m], a, b, before), _first_not_less(self.before[m], a, b, before, after=True)
            n = (skip - a) + (b - on)
            ends = np.cumsum(n)
            lo = 0
            while lo < len(at):
                hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + BLOCK_HITS, "right")))
                k = slice(lo, hi)
                begin, end = np.concatenate([a[k], on[k]]), np.concatenate([skip[k], b[k]])
                some = end > begin
                place = self.place[m][tn.ranges(begin[some], end[some] - 1)].astype(np.int64)
                times = (end - begin)[some]
                where, of = np.repeat(np.tile(at[k], 2)[some], times), np.repeat(np.tile(doc[k], 2)[some], times)
                found.append(np.stack([of, np.searchsorted(self.first, place, "right") - 1, where - place]))
                size += len(place)
                if size > BLOCK_HITS:
                    yield distinct()
                    found, size = [], 0
                lo = hi
        if size:
            yield distinct()

    def overlaps(self, h: np.ndarray, first: np.ndarray, window: int, percent: int) -> np.ndarray:
        """Rows of document, item, first word and word after the last of each overlap in the document, and the most equal words of an alignment in it."""
        out = [np.zeros((5, 0), np.int64)]
        size = np.diff(self.first)
        for doc, item, shift in self.hits(h, first):
            lo, hi = np.maximum(self.first[item], first[doc] - shift), np.minimum(self.first[item + 1], first[doc + 1] - shift)
            need = np.minimum(window, size[item])
            share = np.where(size[item] < MIN_WORDS, 100, percent)
            fit = np.flatnonzero(hi - lo >= need)
            ends = np.cumsum((hi - lo)[fit])
            k = 0
            while k < len(fit):
                z = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + BLOCK_WORDS, "right")))
                out.append(self._verified(h, first, *(x[fit[k:z]] for x in (doc, item, shift, lo, hi, need, share))))
                k = z
            if len(out) > 16:
                out = [merged(np.concatenate(out, axis=1))]
        return merged(np.concatenate(out, axis=1))

    def _verified(self, h, first, doc, item, shift, lo, hi, need, share) -> np.ndarray:
        n = hi - lo
        cut = np.concatenate([[0], np.cumsum(n)])
        of = np.repeat(np.arange(len(n)), n)
        at = tn.ranges(lo, hi - 1)
        sums = np.concatenate([[0], np.cumsum(h[at + shift[of]] == self.h[at])])
        place = np.arange(len(at))
        starts = place[place + need[of] <= cut[of + 1]]
        w = need[of[starts]]
        starts = starts[100 * (sums[starts + w] - sums[starts]) >= share[of[starts]] * w]
        d = np.bincount(starts, minlength=len(at) + 1) - np.bincount(starts + need[of[starts]], minlength=len(at) + 1)
        hit = np.cumsum(d[: len(at)]) > 0
        begin = hit.copy()
        begin[1:] &= ~hit[:-1]
        edge = cut[1:-1]
        begin[edge] |= hit[edge]
        last = hit.copy()
        last[:-1] &= ~hit[1:]
        last[edge - 1] |= hit[edge - 1]
        x, y = np.flatnonzero(begin), np.flatnonzero(last) + 1
        o = of[x]
        base = lo[o] - cut[o] + shift[o] - first[doc[o]]
        return np.stack([doc[o], item[o], x + base, y + base, sums[y] - sums[x]])


def merged(a: np.ndarray) -> np.ndarray:
    """Overlaps of one document and item that touch become one, with the most equal words of any."""
    if not a.shape[1]:
        return a
    a = a[:, np.lexsort((a[3], a[2], a[1], a[0]))]
    group = np.concatenate([[True], (a[0, 1:] != a[0, :-1]) | (a[1, 1:] != a[1, :-1])])
    # words are counted on from group to group, so that one running maximum serves all
    step = int(a[3].max()) + 2
    base = np.cumsum(group) * step
    reach = np.maximum.accumulate(a[3] + base)
    new = group.copy()
    new[1:] |= (a[2] + base)[1:] > reach[:-1]
    at = np.flatnonzero(new)
    last = np.concatenate([at[1:], [a.shape[1]]]) - 1
    return np.stack([a[0, at], a[1, at], a[2, at], (reach - base)[last], np.maximum.reduceat(a[4], at)])


def item_tables(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[tuple[pa.Array, Items, bool]]:
    """The items in tables of about SIDE_BYTES of text each, one at a time on the driver: their ids, themselves, and whether there is just this one."""
    size = benchmark.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    n = -(-size // SIDE_BYTES) or 1
    items = benchmark.select(F.col(item_col).alias("item"), F.col(text_col).alias("text")).filter(F.col("text").isNotNull())
    for k in range(n):
        part = items if n == 1 else items.filter(F.pmod(F.xxhash64("text", "item"), F.lit(n)) == k)
        table = part.toArrow().combine_chunks().sort_by("item")
        yield table.column("item").combine_chunks(), Items(table.column("text")), n == 1


def _overlaps(table, window: int, percent: int, names: list[str], only_hits: bool):
    """For mapInArrow: the columns names with the overlaps of column text, of all rows or of those that have any."""

    def run(batches):
        ids, items = table.value
        for b in batches:
            for lo, hi, data, off in tn.texts(b.column("text")):
                _, _, first, h = plain_words(data, off)
                doc, item, x, y, n = items.overlaps(h, first, window, percent)
                at = np.searchsorted(doc, np.arange(hi - lo + 1))
                span = pa.StructArray.from_arrays([ids.take(pa.array(item)), pa.array(x), pa.array(y), pa.array(n)], names=["item_id", "first", "after", "equal"])
                found = pa.ListArray.from_arrays(pa.array(at, pa.int32()), span)
                out = pa.RecordBatch.from_arrays([*(b.column(c).slice(lo, hi - lo) for c in names), found], names=[*names, "overlaps"])
                yield out.filter(pa.array(np.diff(at) > 0)) if only_hits else out

    return trimmed(run)


def _found(docs: DataFrame, benchmark: DataFrame, text_col: str, item_col: str, item_text: str, window: int, percent: int, schema: str) -> DataFrame | None:
    """t1, t2 (hashes of a text), its overlaps and c, the number of its rows: for benchmarks of several tables, a pass for each. None: there is only one."""
    spark = docs.sparkSession
    t = F.col(text_col)
    texts = docs.select(*_text_hashes(t), t.alias("text")).filter(t.isNotNull())
    passes = []
    for ids, items, single in item_tables(benchmark, item_col, item_text):
        if single:
            return None
        table = spark.sparkContext.broadcast((ids, items))
        hits = texts.mapInArrow(_overlaps(table, window, percent, ["t1", "t2"], True), f"t1 long, t2 long, overlaps {schema}")
        passes.append(saved(hits.groupBy("t1", "t2").agg(F.first("overlaps").alias("overlaps"), F.count(F.lit(1)).alias("c")), "overlaps"))
        table.destroy()
    every = passes[0]
    for p in passes[1:]:
        every = every.unionByName(p)
    return saved(every.groupBy("t1", "t2").agg(F.flatten(F.collect_list("overlaps")).alias("overlaps"), F.max("c").alias("c")), "overlaps")


def _text_hashes(text) -> list:
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2")]


def _spans(benchmark: DataFrame, item_col: str) -> str:
    return f"array<struct<item_id:{benchmark.schema[item_col].dataType.simpleString()},first:bigint,after:bigint,equal:bigint>>"


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, percent: int = PERCENT) -> DataFrame:
    """For each document: its id, contaminated, the ids of the items it overlaps, ascending and null last, and the overlaps in words."""
    spark = docs.sparkSession
    tuned(spark)
    schema = _spans(benchmark, item_col)
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = _found(narrow, benchmark, "text", item_col, item_text, window, percent, schema)
    if found is None:
        ids, items, _ = next(item_tables(benchmark, item_col, item_text))
        kind = narrow.schema["id"].dataType.simpleString()
        now = narrow.mapInArrow(_overlaps(spark.sparkContext.broadcast((ids, items)), window, percent, ["id"], False), f"id {kind}, overlaps {schema}")
    else:
        keys = narrow.select("id", *(F.coalesce(h, F.lit(0)).alias(f"t{i}") for i, h in enumerate(_text_hashes(F.col("text")), 1)))
        now = spread_join(keys, found, ["t1", "t2"], "c", "left").select("id", F.coalesce("overlaps", F.array().cast(schema)).alias("overlaps"))
    ids = F.array_sort(F.array_distinct(F.transform("overlaps", lambda x: x["item_id"])))
    return now.select(F.col("id").alias(id_col), (F.size("overlaps") > 0).alias("contaminated"), ids.alias("item_ids"), F.array_sort("overlaps").alias("overlaps"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, percent: int = PERCENT) -> DataFrame:
    """docs without the rows that overlap an item; rows and columns stay as they are."""
    spark = docs.sparkSession
    tuned(spark)
    found = _found(docs, benchmark, text_col, item_col, item_text, window, percent, _spans(benchmark, item_col))
    if found is not None:
        # the row is one column beside the hashes, so that no name can clash
        rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *(F.coalesce(h, F.lit(0)).alias(f"t{i}") for i, h in enumerate(_text_hashes(F.col(text_col)), 1)))
        return spread_join(rows, found, ["t1", "t2"], "c", "left_anti").select("row.*")
    ids, items, _ = next(item_tables(benchmark, item_col, item_text))
    table = spark.sparkContext.broadcast(items)
    i = docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            keep = np.ones(len(b), bool)
            for lo, _, data, off in tn.texts(b.column(i)):
                _, _, first, h = plain_words(data, off)
                keep[lo + table.value.overlaps(h, first, window, percent)[0]] = False
            yield b.filter(pa.array(keep))

    return docs.mapInArrow(trimmed(run), docs.schema)
