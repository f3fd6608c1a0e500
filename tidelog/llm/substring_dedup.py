"""Substring dedup: recurring passages are confirmed, their phrases compiled to sharded Aho-Corasick automata, and all documents streamed through them.

1. Every window of `window` words has an anchor, its phrase of PHRASE words of least hash; equal windows have equal anchors.
   Anchor phrases are counted over the corpus; only those that recur can stand in a recurring window.
2. For each shard of documents, consecutive windows on one recurring phrase form a fragment, kept once with its number. Fragments found twice
   are confirmed whole; the windows of the others are counted over the corpus, by 128 bits of phrase and window hash: those found twice are confirmed.
3. For each shard, an automaton is compiled from the phrases of its confirmed windows, as strings with SYMBOLS characters a word.
   The shard's documents are streamed through it; at each occurrence the windows around it are looked up among the confirmed ones.
An automaton holds no more phrases than its shard has anchors, so its size is bounded by the shard and not by the corpus.
Hot passages are summed in each batch before any shuffle, so they come as at most one row for each batch.

Results: null text has no words. Repeated rows are documents of their own, so their windows recur. Empty tables give empty results.
Null or repeated ids are kept as they are; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm import textnp as tn
from tidelog.llm.common import beside, dealt, dropped, parts, saved, spread_join, trimmed, tuned

WINDOW = 35
PHRASE = 8
#: Characters that stand for a word in an automaton; a chance likeness is rejected when its windows are looked up.
SYMBOLS = 3
#: Most phrases in one automaton; a shard with more gets several.
AUTOMATON_PHRASES = 200_000
TEXTS = ", kept_text string, removed array<struct<first:int,after:int>>"


def _hashed(data, off):
    start, end, first = tn.words(data, off)
    h = tn.span_hash(data, start, end)
    return h, first


def _symbols(h: np.ndarray) -> str:
    """SYMBOLS characters a word, of an alphabet of 32: automaton nodes search their edges one by one, so fan-out stays low."""
    shifts = np.arange(SYMBOLS, dtype=tn.U) * tn.U(5) + tn.U(13)
    return (((h[:, None] >> shifts) & tn.U(31)) + tn.U(48)).astype(np.uint8).tobytes().decode("ascii")


def _phrase_len(window: int) -> int:
    return min(PHRASE, window)


def _of(shard: np.ndarray, lo: int, first: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """The shard of the document that holds each word."""
    return shard[lo:][np.searchsorted(first, pos, "right") - 1]


def _seeds(window: int):
    k = _phrase_len(window)

    def run(batches):
        for b in batches:
            shard = b.column("shard").to_numpy()
            for lo, _, data, off in tn.texts(b.column("text")):
                h, first = _hashed(data, off)
                g = tn.gram_hash(h, k)
                pos, _, _ = tn.anchors(g, first, window, k)
                pairs = np.stack([g[pos].view(np.int64), _of(shard, lo, first, pos).astype(np.int64)])
                pairs, n = np.unique(pairs, axis=1, return_counts=True) if len(pos) else (pairs, np.zeros(0, np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1].astype(np.int32)), pa.array(n.astype(np.int64))], names=["seed", "shard", "n"])

    return run


def _fragments(window: int):
    """side: recurring seeds of the shard. Gives each run of windows on one of them, once for each shard with its number n: hash, phrase and window hashes."""
    k = _phrase_len(window)

    def run(side, docs):
        seeds = [tn.as_u64(b.column("seed")) for b in side]
        seeds = np.unique(np.concatenate(seeds)) if seeds else np.zeros(0, tn.U)
        keys, sizes, windows, phrases = [], [], [], []
        for b in docs:
            shard = b.column("shard").to_numpy()
            for lo, _, data, off in tn.texts(b.column("text")):
                h, first = _hashed(data, off)
                g = tn.gram_hash(h, k)
                pos, a, z = tn.anchors(g, first, window, k)
                hit = tn.member(g[pos], seeds)
                if not hit.any():
                    continue
                pos, a, z = pos[hit], a[hit], z[hit]
                keys.append(np.stack([g[pos], tn.Prefix(h, tn.GRAM_BASE_2).spans(a, z + window), _of(shard, lo, first, pos).astype(tn.U)]))
                sizes.append(z - a + 1)
                windows.append(tn.gram_hash(h, window)[tn.ranges(a, z)])
                text = _symbols(h)
                phrases.extend(text[p * SYMBOLS : (p + k) * SYMBOLS] for p in pos.tolist())
        if not keys:
            return
        key, size, window_hash = np.concatenate(keys, axis=1), np.concatenate(sizes), np.concatenate(windows)
        begin = np.cumsum(size) - size
        order = np.lexsort(key)
        new = np.flatnonzero(np.concatenate([[True], (np.diff(key[:, order].view(np.int64), axis=1) != 0).any(axis=0)]))
        n = np.diff(np.concatenate([new, [len(order)]])).astype(np.int64)
        for i in range(0, len(new), 10_000):
            j = order[new[i : i + 10_000]]
            w = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size[j])]), pa.int32()), pa.array(window_hash[tn.ranges(begin[j], begin[j] + size[j] - 1)].view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(key[0, j].view(np.int64)), pa.array(key[1, j].view(np.int64)), pa.array(key[2, j].astype(np.int32)), pa.array(n[i : i + 10_000]), pa.array([phrases[x] for x in j.tolist()], pa.string()), w], names=["seed", "f", "shard", "n", "phrase", "w"])

    return run


def automata(phrases: list[str], most: int = AUTOMATON_PHRASES) -> list:
    """Aho-Corasick automata over phrases as _symbols() writes them."""
    out = []
    for i in range(0, len(phrases), most):
        one = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        for p in phrases[i : i + most]:
            one.add_word(p)
        one.make_automaton()
        out.append(one)
    return out


def occurrences(machines: list, text: str) -> np.ndarray:
    """Last word of every occurrence of any phrase, ascending."""
    ends = [np.fromiter((e + 1 for e, _ in m.iter(text)), np.int64) for m in machines]
    ends = np.unique(np.concatenate(ends)) if ends else np.zeros(0, np.int64)
    return ends[ends % SYMBOLS == 0] // SYMBOLS - 1


def _removed(window: int, texts_too: bool, carried: str = "id"):
    k = _phrase_len(window)

    def run(side, docs):
        phrases, seed, w = set(), [np.zeros(0, tn.U)], [np.zeros(0, tn.U)]
        for b in side:
            phrases.update(b.column("phrase").to_pylist())
            lists = b.column("w")
            w.append(tn.as_u64(lists.flatten()))
            seed.append(np.repeat(tn.as_u64(b.column("seed")), pc.list_value_length(lists).to_numpy()))
        confirmed = tn.Pairs(np.concatenate(w), np.concatenate(seed))
        machines = automata(sorted(phrases))
        for b in docs:
            ids = b.column(carried)
            for lo, hi, data, off in tn.texts(b.column("text")):
                h, first = _hashed(data, off)
                n = int(first[-1])
                ends = occurrences(machines, _symbols(h))
                starts = np.zeros(0, np.int64)
                if len(ends):
                    p = ends - k + 1
                    doc = np.searchsorted(first, p, "right") - 1
                    a, z = np.maximum(p - (window - k), first[doc]), np.minimum(p, first[doc + 1] - window)
                    fits = (a <= z) & (ends < first[doc + 1])
                    p, a, z = p[fits], a[fits], z[fits]
                    near = tn.ranges(a, z)
                    starts = np.unique(near[confirmed.find(tn.gram_hash(h, window)[near], np.repeat(tn.gram_hash(h, k)[p], z - a + 1)) >= 0])
                gone = tn.covered(starts, window, n)
                removed = np.concatenate([[0], np.cumsum(gone)])[first]
                kept_hash, kept_text, spans = [], [], []
                for d in range(hi - lo):
                    each = data[off[d] : off[d + 1]].tobytes().split()
                    i, j = first[d], first[d + 1]
                    if removed[d + 1] > removed[d]:
                        lost = gone[i:j]
                        each = list(compress(each, ~lost))
                        if texts_too:
                            edge = np.flatnonzero(np.diff(np.concatenate([[0], lost, [0]])))
                            spans.append([{"first": int(x), "after": int(y)} for x, y in edge.reshape(-1, 2)])
                    elif texts_too:
                        spans.append([])
                    kept = b" ".join(each)
                    kept_hash.append(hashlib.sha256(kept).hexdigest())
                    if texts_too:
                        kept_text.append(kept.decode("utf-8", "replace") if removed[d + 1] > removed[d] else None)
                cols = [ids.slice(lo, hi - lo), pa.array(np.diff(first).astype(np.int64)), pa.array(np.diff(removed).astype(np.int64)), pa.array(kept_hash, pa.string())]
                names = [carried, "n_words", "n_removed", "kept_sha256"]
                if texts_too:
                    cols += [pa.array(kept_text, pa.string()), pa.array(spans, pa.list_(pa.struct([("first", pa.int32()), ("after", pa.int32())])))]
                    names += ["kept_text", "removed"]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, texts: bool = False) -> DataFrame:
    """For each document: its id, n_words, n_removed and kept_sha256; with texts also kept_text (null: nothing removed) and the removed word spans.

    A word is removed if any window of `window` words that covers it also starts anywhere else in the corpus, same document included.
    """
    ours, side, n = _confirmed(docs, id_col, text_col, window)
    schema = f"id {ours.schema['id'].dataType.simpleString()}, n_words long, n_removed long, kept_sha256 string" + TEXTS * texts
    return beside(ours, side, n, _removed(window, texts), schema).withColumnRenamed("id", id_col)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size_col: str = "n_chars", window: int = WINDOW) -> DataFrame:
    """docs with the words of recurring passages removed from their texts; texts without any stay as they are, and so do rows and other columns.

    size_col, where there is such a column, gets the new text's length.
    """
    ours, side, n = _confirmed(docs, id_col, text_col, window, carry=True)
    row = ours.schema["row"].dataType.simpleString()
    out = beside(ours.drop("id"), side, n, _removed(window, True, "row"), f"row {row}, n_words long, n_removed long, kept_sha256 string" + TEXTS)
    text = F.coalesce("kept_text", F.col("row")[text_col])
    new = {text_col: text} | ({size_col: F.when(F.col("kept_text").isNull(), F.col("row")[size_col]).otherwise(F.length(text)).cast(docs.schema[size_col].dataType)} if size_col in docs.columns else {})
    return out.select(*(new.get(c, F.col("row")[c]).alias(c) for c in docs.columns))


def _confirmed(docs: DataFrame, id_col: str, text_col: str, window: int, carry: bool = False) -> tuple[DataFrame, DataFrame, int]:
    """Dealt documents, the confirmed phrases and windows of each shard, and the number of shards."""
    spark = docs.sparkSession
    tuned(spark)
    n = parts(docs.select(id_col, text_col))
    ours = dealt(docs, id_col, text_col, n, carry)
    seeds = saved(ours.select("text", "shard").mapInArrow(trimmed(_seeds(window)), "seed long, shard int, n long"), "seeds")
    twice = saved(seeds.groupBy("seed").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("c")).filter("n > 1").select("seed", "c"), "twice")
    side = spread_join(seeds.select("seed", "shard"), twice, ["seed"], "c", "inner").select("seed", "shard")  # a seed may come twice from two batches
    found = saved(beside(ours.select("text", "shard"), side, n, _fragments(window), "seed long, f long, shard int, n long, phrase string, w array<long>"), "fragments")
    dropped(seeds, twice)
    each = saved(found.groupBy("seed", "f").agg(F.sum("n").alias("n"), F.first("w").alias("w")), "each")
    windows = each.select("seed", "f", "n", F.explode("w").alias("w"))
    again = saved(windows.groupBy("seed", "w").agg(F.sum("n").alias("n")).filter("n > 1").select("seed", "w"), "again")
    parts_of = windows.filter("n = 1").join(again, ["seed", "w"], "left_semi").groupBy("seed", "f").agg(F.collect_list("w").alias("w"))
    confirmed = each.filter("n > 1").select("seed", "f", "w").unionByName(parts_of)
    side = saved(found.select("seed", "f", "shard", "phrase").join(confirmed, ["seed", "f"]).select("seed", "phrase", "w", "shard"), "confirmed")
    dropped(found, each, again)
    return ours, side, n
