"""Suffix-array dedup: longest-previous-factor arrays over fragments that can hold recurring strings.

1. Every string of `length` bytes inside a document has an anchor, its SEED-byte gram of least hash. Seeds are counted over the corpus;
   a string that recurs has a recurring seed.
2. Consecutive strings with one anchor form a fragment. For each shard of documents the fragments on recurring seeds are kept once with their number.
3. Fragments meet by seed, where all equal strings are together. Their bytes are joined and sorted as suffixes; previous and next smaller
   positions in suffix order give each position's longest earlier match and its source. Positions that match `length` bytes and their sources recur.
   A fragment that was found twice recurs whole. A seed with very many different fragments isn't gathered: its fragments are cut anew by a second
   anchor and meet by both; strings whose anchors are both that common are counted by a 128-bit hash.
4. Verdicts go back to the shards that hold the fragments, and the documents' bytes are removed there.

With keep_first, a byte goes only if a string that covers it starts somewhere earlier: rows in the order of their ids (integers by value, others by a hash; null
last), equal ids by a hash of their texts, and in a text from left to right. Fragments are then joined in the order of their first occurrences, so that a
previous factor of `length` bytes is an earlier copy; first occurrences lose those starts alone, and all other occurrences everything.

Results: null text is empty. Repeated rows are documents of their own, so their strings recur. Bytes are counted and removed as they are, even inside a
character. Empty tables give empty results; null or repeated ids are kept; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm import textnp as tn
from tidelog.llm.common import beside, dealt, dropped, parts, saved, small, spread_join, trimmed, tuned

LENGTH = 200
SEED = 40
#: Rows of one seed beyond which its fragments aren't gathered in one place.
HOT_ROWS = 2000
#: Times that hot seeds are cut anew.
LEVELS = 1
#: Bytes of fragments whose suffixes are sorted at once; whole seeds stay together.
CHUNK_BYTES = 1 << 18
#: Bytes of text that are worked on at once: every byte takes part in a score of 64-bit arrays.
SLICE_BYTES = 1 << 18


def _dense(key: np.ndarray, order: np.ndarray) -> np.ndarray:
    sorted_key = key[order]
    rank = np.empty(len(key), np.int64)
    rank[order] = np.cumsum(np.concatenate([[0], sorted_key[1:] != sorted_key[:-1]])) if len(key) else 0
    return rank


def _ahead(a: np.ndarray, by: int) -> np.ndarray:
    out = np.zeros_like(a)
    if by < len(a):
        out[: len(a) - by] = a[by:]
    return out


def _nearest_smaller(values: np.ndarray) -> np.ndarray:
    """Index of the nearest smaller value before each entry, or -1, by jumping over entries already known to be larger."""
    at = np.arange(-1, len(values) - 1)
    busy = np.arange(len(values))
    while True:
        busy = busy[at[busy] >= 0]
        busy = busy[values[at[busy]] > values[busy]]
        if not len(busy):
            return at
        at[busy] = at[at[busy]]


def previous_factors(text: np.ndarray, room: np.ndarray, starts: np.ndarray, cap: int, full: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Longest previous factor of each start, at most cap, and the earlier start it matches (-1: none). Not full: only those of cap bytes, else 0.

    room: bytes from each position to the end of its fragment. starts: ascending positions that count, each with room for cap bytes.
    """
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    size, key = 1, text.astype(np.uint64)
    levels = [(1, text)] if full else []
    while size < 8 and size * 2 <= cap:
        key = (key << np.uint64(8 * size)) | _ahead(key, size)
        size *= 2
        if full and size < 8:
            levels.append((size, key))
    rank = _dense(key, np.argsort(key))
    while True:
        if full:
            levels.append((size, rank))
        if size * 2 > cap:
            break
        key = rank * (len(text) + 1) + _ahead(rank, size)
        rank = _dense(key, np.argsort(key))
        size *= 2
    key = rank[starts] * (len(text) + 1) + _ahead(rank, cap - size)[starts]
    suffixes = starts[np.argsort(key, kind="stable")]
    before = _nearest_smaller(suffixes)
    after = len(suffixes) - 1 - _nearest_smaller(suffixes[::-1])[::-1]
    n = len(suffixes)
    at = np.searchsorted(starts, suffixes)

    def alike(other: np.ndarray) -> np.ndarray:
        there = (other >= 0) & (other < n)
        return np.where(there & (key[at] == key[at[np.where(there, other, 0)]]), cap, 0)

    def common(other: np.ndarray) -> np.ndarray:
        there = (other >= 0) & (other < n)
        i, j = suffixes, suffixes[np.where(there, other, 0)]
        limit = np.where(there, np.minimum(np.minimum(room[i], room[j]), cap), 0)
        got = np.zeros(n, np.int64)
        for step, ranks in reversed(levels):
            for _ in range(2 if step == levels[-1][0] else 1):
                x, y = i + got, j + got
                fits = (got < limit) & (np.maximum(x, y) < len(text))
                same = fits.copy()
                same[fits] = ranks[x[fits]] == ranks[y[fits]]
                got[same] += step
        return np.minimum(got, limit)

    a, b = (common(before), common(after)) if full else (alike(before), alike(after))
    longest = np.maximum(a, b)
    source = np.where(longest == 0, -1, suffixes[np.clip(np.where(a >= b, before, after), 0, n - 1)])
    back = np.empty(n, np.int64)
    back[at] = np.arange(n)
    return longest[back], source[back]


def _runs(data: np.ndarray, off: np.ndarray, length: int, k: int):
    sums = tn.Prefix(data, tn.BYTE_BASE)
    g = sums.grams(k)
    pos, a, z = tn.anchors(g, off, length, k)
    return sums, g, pos, a, z


def _seed_len(length: int) -> int:
    return min(SEED, length)


def _seeds(length: int):
    k = _seed_len(length)

    def run(batches):
        for b in batches:
            shard = b.column("shard").to_numpy()
            for lo, _, data, off in tn.texts(b.column("text"), SLICE_BYTES):
                _, g, pos, _, _ = _runs(data, off, length, k)
                pairs = np.stack([g[pos].view(np.int64), shard[lo:][np.searchsorted(off, pos, "right") - 1].astype(np.int64)])
                pairs, n = np.unique(pairs, axis=1, return_counts=True) if len(pos) else (pairs, np.zeros(0, np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1].astype(np.int32)), pa.array(n.astype(np.int64))], names=["seed", "shard", "n"])

    return run


ORDER = ["o1", "o2", "at"]


def _fragments(length: int, keep_first: bool = False):
    """Fragments of each shard on its recurring seeds, once each with their number n; with keep_first also where they first occur: order of the row, byte."""
    k = _seed_len(length)

    def run(side, docs):
        seeds = [tn.as_u64(b.column("seed")) for b in side]
        seeds = np.unique(np.concatenate(seeds)) if seeds else np.zeros(0, tn.U)
        for b in docs:
            shard = b.column("shard").to_numpy()
            for lo, _, data, off in tn.texts(b.column("text"), SLICE_BYTES):
                sums, g, pos, a, z = _runs(data, off, length, k)
                hit = tn.member(g[pos], seeds)
                if not hit.any():
                    continue
                pos, a, z = pos[hit], a[hit], z[hit] + length
                other = tn.Prefix(data, tn.GRAM_BASE_2)
                of = shard[lo:][np.searchsorted(off, pos, "right") - 1]
                keys = np.stack([sums.spans(a, z), other.spans(a, z), of.astype(tn.U)])
                place = []
                if keep_first:
                    doc = np.searchsorted(off, pos, "right") - 1
                    place = [b.column(c).to_numpy()[lo:][doc] for c in ORDER[:2]] + [a - off[doc]]
                    order = np.lexsort((*place[::-1], *keys[::-1]))
                    new = np.flatnonzero(np.concatenate([[True], (keys[:, order][:, 1:] != keys[:, order][:, :-1]).any(axis=0)]))
                    first, n = order[new], np.diff(np.concatenate([new, [len(order)]]))
                else:
                    _, first, n = np.unique(keys, axis=1, return_index=True, return_counts=True)
                raw = data.tobytes()
                for i in range(0, len(first), 5000):
                    j = first[i : i + 5000]
                    body = [raw[x:y] for x, y in zip(a[j].tolist(), z[j].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(g[pos[j]].view(np.int64)), pa.array(keys[0, j].view(np.int64)), pa.array(keys[1, j].view(np.int64)), pa.array(of[j], pa.int32()), pa.array(n[i : i + 5000].astype(np.int64)), pa.array(body, pa.binary()), *(pa.array(x[j]) for x in place)], names=["seed", "f1", "f2", "shard", "n", "body", *ORDER[: len(place)]])

    return run


def recurring_starts(bodies: list[bytes], length: int, later: bool = False) -> list[np.ndarray]:
    """For each of several different fragments, the starts of strings of `length` bytes that occur at least twice among all of them; later: that have occurred
    before, in the order given."""
    sizes = np.array([len(x) for x in bodies])
    off = np.concatenate([[0], np.cumsum(sizes)])
    text = np.frombuffer(b"".join(bodies), np.uint8)
    room = np.repeat(off[1:], sizes) - np.arange(off[-1])
    starts = np.flatnonzero(room >= length)
    longest, source = previous_factors(text, room, starts, length, full=False)
    hit = longest >= length
    found = np.zeros(off[-1] + 1, bool)
    found[starts[hit]] = True
    if not later:
        found[source[hit]] = True
    return [np.flatnonzero(found[off[i] : off[i + 1]]) for i in range(len(bodies))]


def _intervals(starts: np.ndarray) -> list[int]:
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) != 1)
    return np.stack([starts[np.concatenate([[0], cut + 1])], starts[np.concatenate([cut, [len(starts) - 1]])]], axis=1).ravel().tolist()


def _verdicts(length: int, keep_first: bool = False):
    """Fragments in the order of their seeds. Gives f1, f2 and the intervals of starts that recur; null: all of them.

    With keep_first they come in the order of their first occurrences within a seed; the intervals are those of the first one, whose place is given too.
    """
    place = ORDER if keep_first else []

    def rows(group: dict, gone: list) -> pa.RecordBatch:
        cols = [pa.array([k[i] for k in group], pa.int64()) for i in (0, 1)] + [pa.array(gone, pa.list_(pa.int32()))]
        cols += [pa.array([v[2][i] for v in group.values()], pa.int64()) for i in range(len(place))]
        return pa.RecordBatch.from_arrays(cols, names=["f1", "f2", "gone", *place])

    def judged(group: dict) -> pa.RecordBatch:
        starts = recurring_starts([body for body, *_ in group.values()], length, keep_first) if group else []
        kept, gone = {}, []
        for (k, v), s in zip(group.items(), starts, strict=True):
            whole = not keep_first and (v[1] > 1 or len(s) == len(v[0]) - length + 1)
            if v[1] > 1 or len(s):
                kept[k] = v
                gone.append(None if whole else _intervals(s))
        return rows(kept, gone)

    def alone_of(group: dict) -> pa.RecordBatch:
        twice = {k: v for k, v in group.items() if v[1] > 1}
        return rows(twice, [[] if keep_first else None] * len(twice))

    def run(batches):
        waiting, current, seed, size = {}, {}, None, 0
        alone: dict = {}

        def close():
            # a seed whose fragments are all the same needs no sorting: its one fragment was found n times
            (waiting if len(current) > 1 else alone).update(current)

        for b in batches:
            for s, f1, f2, n, body, *at in zip(*(b.column(c).to_pylist() for c in ["seed", "f1", "f2", "n", "body", *place]), strict=True):
                if s != seed:
                    close()
                    current, seed = {}, s
                    if size > CHUNK_BYTES:
                        yield judged(waiting)
                        waiting, size = {}, 0
                    if len(alone) >= 20_000:
                        yield alone_of(alone)
                        alone = {}
                have = current.get((f1, f2))
                current[f1, f2] = (body, n + (have[1] if have else 0), have[2] if have else at)
                size += 0 if have else len(body)
        close()
        yield judged(waiting)
        yield alone_of(alone)
        tn.trim()

    return run


def _pieces(length: int, keep_first: bool = False):
    """Fragments of hot seeds cut anew by a second anchor, that of another hash: most strings of a hot seed part there."""
    k = _seed_len(length)

    def run(batches):
        for b in batches:
            for lo, _, data, off in tn.texts(b.column("body"), SLICE_BYTES):
                g = tn.Prefix(data, tn.GRAM_BASE_2).grams(k)
                pos, a, z = tn.anchors(g, off, length, k)
                of = np.searchsorted(off, a, "right") - 1
                p1, p2, n, seed = (b.column(c).to_numpy()[lo + of] for c in ("f1", "f2", "n", "seed"))
                f1, f2 = (tn.Prefix(data, base).spans(a, z + length).view(np.int64) for base in (tn.BYTE_BASE, tn.GRAM_BASE_2))
                raw = data.tobytes()
                body = [raw[x:y] for x, y in zip(a.tolist(), (z + length).tolist(), strict=True)]
                both = tn.mix(seed.view(tn.U) ^ g[pos]).view(np.int64)
                cols = [both, f1, f2, n, p1, p2, (a - off[of]).astype(np.int32), (z - off[of]).astype(np.int32)]
                names = ["seed", "f1", "f2", "n", "p1", "p2", "first", "last"]
                if keep_first:
                    o1, o2, at = (b.column(c).to_numpy()[lo + of] for c in ORDER)
                    cols, names = [*cols, o1, o2, at + (a - off[of])], [*names, *ORDER]
                yield pa.RecordBatch.from_arrays([*map(pa.array, cols), pa.array(body, pa.binary())], names=[*names, "body"])

    return run


def _strings(length: int, keep_first: bool = False):
    """Each string of each fragment as a hash, for seeds that are too common to gather."""

    def run(batches):
        for b in batches:
            for lo, hi, data, off in tn.texts(b.column("body"), SLICE_BYTES):
                last = off[1:] - length
                at = tn.ranges(off[:-1], last)
                of = np.repeat(np.arange(lo, hi), last - off[:-1] + 1)
                w1, w2 = tn.Prefix(data, tn.BYTE_BASE).grams(length)[at], tn.Prefix(data, tn.GRAM_BASE_2).grams(length)[at]
                f1, f2, n = (b.column(c).to_numpy()[of] for c in ("f1", "f2", "n"))
                start = at - off[of - lo]
                cols, names = [w1.view(np.int64), w2.view(np.int64), f1, f2, start.astype(np.int32), n], ["w1", "w2", "f1", "f2", "start", "n"]
                if keep_first:
                    o1, o2, first = (b.column(c).to_numpy()[of] for c in ORDER)
                    cols, names = [*cols, o1, o2, first + start], [*names, *ORDER]
                yield pa.RecordBatch.from_arrays([*map(pa.array, cols)], names=names)

    return run


def _removed(length: int, texts_too: bool, keep_first: bool = False):
    k = _seed_len(length)

    def run(side, docs):
        f1, f2, gone, where = [np.zeros(0, tn.U)], [np.zeros(0, tn.U)], [], []
        for b in side:
            f1.append(tn.as_u64(b.column("f1")))
            f2.append(tn.as_u64(b.column("f2")))
            gone.extend(b.column("gone").to_pylist())
            if keep_first:
                where.extend(zip(*(b.column(c).to_pylist() for c in ORDER), strict=True))
        known = tn.Pairs(np.concatenate(f1), np.concatenate(f2))
        done: set[tuple] = set()  # rows that hold first occurrences; of rows that are wholly equal only the first one does
        for b in docs:
            ids = b.column("id")
            order = list(zip(*(b.column(c).to_pylist() for c in ORDER[:2]), strict=True)) if keep_first else []
            for lo, hi, data, off in tn.texts(b.column("text"), SLICE_BYTES):
                starts = np.zeros(0, np.int64)
                if len(known.a):
                    sums, _, pos, a, z = _runs(data, off, length, k)
                    at = known.find(sums.spans(a, z + length), tn.Prefix(data, tn.GRAM_BASE_2).spans(a, z + length)) if len(pos) else pos
                    doc = np.searchsorted(off, a, "right") - 1
                    first, last, again, now = [], [], set(), -1
                    for i in np.flatnonzero(at >= 0).tolist():
                        part = gone[at[i]]
                        if keep_first:
                            d = lo + int(doc[i])
                            if d != now:
                                now = d
                                if order[d] in done:
                                    again.add(d)
                                done.add(order[d])
                            if d in again or where[at[i]] != (*order[d], int(a[i] - off[doc[i]])):
                                part = None
                        if part is None:
                            first.append(a[i])
                            last.append(z[i])
                        else:
                            first.extend(a[i] + x for x in part[::2])
                            last.extend(a[i] + x for x in part[1::2])
                    starts = tn.ranges(np.array(first, np.int64), np.array(last, np.int64))
                lost = tn.covered(starts, length, len(data))
                removed = np.concatenate([[0], np.cumsum(lost)])[off]
                edge = lost & np.concatenate([[True], ~lost[:-1]])[: len(lost)]
                edge[off[:-1][off[:-1] < len(lost)]] = lost[off[:-1][off[:-1] < len(lost)]]
                spans = np.diff(np.concatenate([[0], np.cumsum(edge)])[off])
                kept = [(data[off[d] : off[d + 1]][~lost[off[d] : off[d + 1]]] if removed[d + 1] > removed[d] else data[off[d] : off[d + 1]]).tobytes() for d in range(hi - lo)]
                cols = [ids.slice(lo, hi - lo), pa.array(np.diff(off)), pa.array(np.diff(removed).astype(np.int64)), pa.array(spans.astype(np.int64)), pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())]
                names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
                if texts_too:
                    cols.append(pa.array(kept, pa.binary()))
                    names.append("kept")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def _judged(frags: DataFrame, n: int, length: int, levels: int, keep_first: bool = False) -> tuple[DataFrame, list[DataFrame]]:
    """Verdicts on fragments (seed, f1, f2, n, body and with keep_first their place), and the scratch tables they stand on. Hot seeds are cut anew, levels
    times, before strings are counted."""
    place = ORDER if keep_first else []
    schema = "f1 long, f2 long, gone array<int>" + "".join(f", {c} long" for c in place)
    hot = saved(frags.groupBy("seed").count().filter(F.col("count") > HOT_ROWS).select("seed"), "hot")
    n_hot = hot.count()
    hint = F.broadcast(hot) if small(n_hot, 16) else hot
    cold = frags.join(hint, "seed", "left_anti") if n_hot else frags
    cold = cold.select("seed", "f1", "f2", "n", "body", *place).repartition(n, "seed").sortWithinPartitions("seed", *place)
    verdicts = saved(cold.mapInArrow(_verdicts(length, keep_first), schema), "verdicts")
    if not n_hot:
        return verdicts, [hot, verdicts]
    first = [F.min(F.struct(*ORDER)).alias("o")] if keep_first else []
    each = frags.join(hint, "seed", "left_semi").groupBy("f1", "f2").agg(F.first("seed").alias("seed"), F.sum("n").alias("n"), F.first("body").alias("body"), *first)
    if keep_first:
        each = saved(each.select("f1", "f2", "seed", "n", "body", "o.*"), "each")
    places = "".join(f", {c} long" for c in place)
    if levels:
        pieces = saved(each.mapInArrow(_pieces(length, keep_first), f"seed long, f1 long, f2 long, n long, p1 long, p2 long, first int, last int{places}, body binary"), "pieces")
        below, scratch = _judged(pieces.select("seed", "f1", "f2", "n", "body", *place), n, length, levels - 1, keep_first)
        whole, inner = F.array("first", "last"), F.transform("gone", lambda x: x + F.col("first"))
        part = F.when(F.col("gone").isNull(), whole).otherwise(inner)
        if keep_first:
            below = below.select("f1", "f2", "gone", F.struct(*ORDER).alias("o"))
            part = F.when(F.col("o") == F.struct(*ORDER), inner).otherwise(whole)
        found = pieces.select("f1", "f2", "p1", "p2", "first", "last", *place).join(below, ["f1", "f2"]).select("p1", "p2", part.alias("gone"))
        more = found.groupBy(F.col("p1").alias("f1"), F.col("p2").alias("f2")).agg(F.flatten(F.collect_list("gone")).alias("gone"))
        scratch = [*scratch, pieces]
    else:
        strings = saved(each.mapInArrow(_strings(length, keep_first), f"w1 long, w2 long, f1 long, f2 long, start int, n long{places}"), "strings")
        firsts = [F.min(F.struct(*ORDER)).alias("o")] if keep_first else []
        again = strings.groupBy("w1", "w2").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("c"), *firsts)
        again = saved(again.filter("c > 1" if keep_first else "n > 1").select("w1", "w2", *(["o"] if keep_first else [])), "again")
        starts = strings.join(again, ["w1", "w2"]).filter(F.col("o") != F.struct(*ORDER)) if keep_first else strings.join(again, ["w1", "w2"], "left_semi")
        starts = starts.groupBy("f1", "f2").agg(F.collect_list("start").alias("s"))
        more = starts.select("f1", "f2", F.flatten(F.transform("s", lambda x: F.array(x, x))).alias("gone"))
        scratch = [strings, again]
    if keep_first:
        more = each.select("f1", "f2", "n", *ORDER).join(more, ["f1", "f2"], "left").filter("n > 1 or gone is not null")
        more = more.select("f1", "f2", F.coalesce("gone", F.array().cast("array<int>")).alias("gone"), *ORDER)
        scratch = [*scratch, each]
    more = saved(more, "verdicts")
    return verdicts.unionByName(more), [hot, verdicts, more, *scratch]


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, texts: bool = False, keep_first: bool = False) -> DataFrame:
    """For each document: its id, n_bytes, n_removed, n_spans and kept_sha256; with texts also the kept bytes.

    A byte is removed if any string of `length` bytes that covers it also starts anywhere else in the corpus, same document included; with keep_first, if it
    also starts earlier.
    """
    spark = docs.sparkSession
    tuned(spark)
    n = parts(docs.select(id_col, text_col))
    ours = dealt(docs, id_col, text_col, n)
    kind = ours.schema["id"].dataType.simpleString()
    place = ORDER if keep_first else []
    if keep_first:
        rank = F.col("id").cast("long") if kind in ("bigint", "int", "smallint", "tinyint") else F.xxhash64("id")
        ours = ours.withColumn("o1", F.when(F.col("id").isNull(), F.lit((1 << 63) - 1)).otherwise(rank)).withColumn("o2", F.xxhash64("text"))
    seeds = saved(ours.select("text", "shard").mapInArrow(trimmed(_seeds(length)), "seed long, shard int, n long"), "seeds")
    twice = saved(seeds.groupBy("seed").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("c")).filter("n > 1").select("seed", "c"), "twice")
    side = spread_join(seeds.select("seed", "shard"), twice, ["seed"], "c", "inner").select("seed", "shard")  # a seed may come twice from two batches
    schema = "seed long, f1 long, f2 long, shard int, n long, body binary" + "".join(f", {c} long" for c in place)
    frags = saved(beside(ours.select("text", "shard", *place[:2]), side, n, _fragments(length, keep_first), schema), "fragments")
    dropped(seeds, twice)
    verdicts, scratch = _judged(frags, n, length, LEVELS, keep_first)
    side = saved(frags.select("f1", "f2", "shard").distinct().join(verdicts, ["f1", "f2"]).select("f1", "f2", "gone", "shard", *place), "gone")
    dropped(frags, *scratch)
    schema = f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * texts
    return beside(ours, side, n, _removed(length, texts, keep_first), schema).withColumnRenamed("id", id_col)
