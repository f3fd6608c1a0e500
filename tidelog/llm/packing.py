"""Variable-capacity best fit: documents go to sequences of several permitted lengths, chosen jointly, and each sequence ends as the cheapest that holds it.

A document's length is its words and one end mark, or any length column. A longer one than the largest sequence is cut into pieces, none is lost.
A sequence costs its length, OVERHEAD, and a share for attention, which grows with the square of the length; so no one length is best for all documents.
Rows are dealt at random into groups of about GROUP_ROWS, each packed by one task:
1. The longest piece that is left opens a sequence. For each permitted length, best fit is tried on what is left: again and again the longest piece that still
   fits. The length that then costs least for each token it took is opened, with those pieces.
2. Best fit over all open bins, by falling length, is done for each choice of permitted lengths; a piece that fits nowhere opens the cheapest a token of them.
3. Of all these the packing that costs least after downsizing each bin to its contents is taken, so none with a single length is cheaper.
A group wastes at most about one part-filled bin more than the whole table would, a share that falls with GROUP_ROWS.

Results: null text is empty and has the end mark alone. Repeated rows and repeated or null ids are packed each by itself. A length of null or below one takes no
room and comes with a bin of its group. Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import saved, trimmed

SIZES = (512, 1024, 2048, 4096)
#: What a sequence costs beyond its tokens, and the length at which attention costs as much as all else.
OVERHEAD, ATTENTION = 32, 1 << 15
GROUP_ROWS = 20_000
#: Choices of permitted lengths that best fit is done for: all of them for up to four lengths, else single ones, neighbours and all.
ALL_CHOICES = 4

Packing = tuple[np.ndarray, np.ndarray, list[int]]


def word_length(text: Column) -> Column:
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), 0)).cast("long") + 1


def costs_of(sizes: tuple[int, ...], overhead: float = OVERHEAD, attention: float = ATTENTION) -> dict[int, float]:
    return {c: c + c * c / attention + overhead for c in sorted(sizes)}


def best_fit_of(lengths: list[int], order: list[int], costs: dict[int, float], usable: tuple[int, ...]) -> Packing:
    """Best fit by falling length over all open bins. Where no usable size holds a piece, the least that does is opened."""
    cheap = sorted(usable, key=lambda c: (costs[c] / c, c))
    sizes = sorted(costs)
    room: list[tuple[int, int]] = []  # open bins by free tokens
    filled: list[int] = []
    of, at = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i in order:
        n = lengths[i]
        k = bisect_left(room, (n, -1))
        if k < len(room):
            free, b = room.pop(k)
        else:
            free = next((c for c in cheap if c >= n), 0) or next(c for c in sizes if c >= n)
            b = len(filled)
            filled.append(0)
        of[i], at[i] = b, filled[b]
        filled[b] += n
        if free > n:
            insort(room, (free - n, b))
    return of, at, filled


def by_trial(lengths: list[int], order: list[int], costs: dict[int, float]) -> Packing:
    """Opens, for the longest piece left, the size that best fit over all pieces left fills at the least cost a token."""
    sizes, top = sorted(costs), max(costs)
    waiting: list[list[int]] = [[] for _ in range(top + 1)]
    for i in reversed(order):
        waiting[lengths[i]].append(i)
    below = list(range(top + 1))  # the longest length up to this one that any piece left has; 0: none

    def longest(n: int) -> int:
        while below[n] != n:
            below[n] = below[below[n]]
            n = below[n]
        return n

    for n in range(1, top + 1):
        if not waiting[n]:
            below[n] = n - 1
    of, at, filled = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), []
    while n := longest(top):
        best = None
        for size in sizes:
            if size < n:
                continue
            free, m, take = size, n, []
            while m:
                k = min(len(waiting[m]), free // m)
                take.append((m, k))
                free -= k * m
                m = longest(min(free, m - 1))
            price = costs[size] / (size - free)
            if best is None or price < best[0]:
                best = (price, take)
            if size - free < size and not longest(n - 1) and len(waiting[n]) == take[0][1]:
                break  # everything left is in it
        used = 0
        for m, k in best[1]:
            for _ in range(k):
                i = waiting[m].pop()
                of[i], at[i] = len(filled), used
                used += m
            if not waiting[m]:
                below[m] = m - 1
        filled.append(used)
    return of, at, filled


def choices(sizes: tuple[int, ...]) -> list[tuple[int, ...]]:
    sizes = tuple(sorted(sizes))
    if len(sizes) <= ALL_CHOICES:
        return [c for k in range(1, len(sizes) + 1) for c in combinations(sizes, k)]
    return sorted({*((s,) for s in sizes), *zip(sizes[:-1], sizes[1:], strict=True), sizes})


def pack(lengths: np.ndarray, sizes: tuple[int, ...] = SIZES, overhead: float = OVERHEAD, attention: float = ATTENTION) -> Packing:
    """Bin and offset of each length (none above the largest size), and each bin's final size."""
    costs = costs_of(sizes, overhead, attention)
    order = [i for i in np.argsort(-lengths, kind="stable").tolist() if lengths[i] > 0]
    plain = lengths.tolist()
    by_cost = sorted(costs, key=lambda c: (costs[c], c))
    fit = [next(c for c in by_cost if c >= n) for n in range(max(costs) + 1)]  # the cheapest size for so many tokens
    best, least = None, 0.0
    if order:
        tried = {c: best_fit_of(plain, order, costs, c) for c in choices(sizes)}
        for packing in [by_trial(plain, order, costs), *tried.values()]:
            cost = sum(costs[fit[f]] for f in packing[2])
            if best is None or cost < least:
                best, least = packing, cost
    of, at, filled = best or (np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), [0] if len(lengths) else [])
    at[lengths <= 0] = 0
    return of, at, [fit[f] for f in filled]


def best_fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: Column | None = None, sizes: tuple[int, ...] = SIZES, overhead: float = OVERHEAD, attention: float = ATTENTION) -> DataFrame:
    """One row for each piece: id, piece, first and after (tokens of the document), bin_id, bin_offset and bin_size."""
    spark = docs.sparkSession
    n_tokens = length if length is not None else word_length(F.col(text_col))
    rows = saved(docs.select(F.col(id_col).alias("id"), F.greatest(F.coalesce(n_tokens.cast("long"), F.lit(0)), F.lit(0)).alias("n"), F.monotonically_increasing_id().alias("r")), "lengths")
    n_groups = max(1, -(-rows.count() // GROUP_ROWS))
    n_parts = max(n_groups, min(n_groups * 4, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    dealt = rows.withColumn("g", F.pmod(F.xxhash64("r"), F.lit(n_groups)).cast("int")).repartition(n_parts, "g").sortWithinPartitions("g", "r")
    largest = max(sizes)
    kind = rows.schema["id"].dataType.simpleString()

    def packed(g: int, ids: pa.Array, n: np.ndarray) -> pa.RecordBatch:
        pieces = np.maximum(1, -(-n // largest))
        row = np.repeat(np.arange(len(n)), pieces)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        first = piece * largest
        size = np.minimum(n[row] - first, largest)
        of, at, bins = pack(size, sizes, overhead, attention)
        arrays = [ids.take(pa.array(row)), pa.array(piece), pa.array(first), pa.array(first + size), pa.array((g << 32) + of), pa.array(at), pa.array(np.array(bins, np.int64)[of])]
        return pa.RecordBatch.from_arrays(arrays, names=["id", "piece", "first", "after", "bin_id", "bin_offset", "bin_size"])

    def run(batches):
        now, ids, lengths = None, [], []
        for b in batches:
            g = b.column("g").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(g)) + 1).tolist(), len(g)]
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                if i == j:
                    continue
                if g[i] != now and ids:
                    yield packed(now, pa.concat_arrays(ids), np.concatenate(lengths))
                    ids, lengths = [], []
                now = int(g[i])
                ids.append(b.column("id").slice(i, j - i))
                lengths.append(b.column("n").to_numpy()[i:j])
        if ids:
            yield packed(now, pa.concat_arrays(ids), np.concatenate(lengths))

    return dealt.mapInArrow(trimmed(run), f"id {kind}, piece long, first long, after long, bin_id long, bin_offset long, bin_size long").withColumnRenamed("id", id_col)
