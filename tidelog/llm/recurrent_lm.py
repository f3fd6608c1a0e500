"""LM scoring: a gated recurrent language model in numpy with a class-factored softmax scores whole documents, its state carried from window to window.

1. Training words are counted over all documents that aren't held out. The TOP most frequent, the end mark among them, are the model's words, in classes of
   falling frequency; all others form the tail class, in which a word has its share (count + 1) / (tail tokens + tail words + 1).
2. Weights start from the counts. The driver first trains on at most SEED_DOCS documents of at most SEED_BYTES in all; then every shard trains from there by truncated backpropagation
   on every window of all its training documents, the state carried from window to window, and the shards' weights are averaged by their tokens.
3. Each shard gets the counts of its words beside its documents, and steps through all of them together; finished ones leave. Of the words' probabilities,
   P(class | state) * P(word | class, state), the logarithms sum up to the score.

Results: null and empty texts have the end mark alone. Repeated rows count as often as they come. Without training documents all counts are zero and words share
alike. Empty tables give empty results; null or repeated ids are kept; other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm import textnp as tn
from tidelog.llm.common import beside, dealt, drawn, dropped, held_out, parts, saved, trimmed, tuned

TOP, CLASSES = 1023, 32
HIDDEN = EMBED = 16
#: Input ids that tail words share by hash, and the width of training windows.
TAIL_INPUTS, WINDOW = 64, 32
#: Documents that the driver and a shard train on at a time.
SEED_LANES, LANES = 64, 256
SEED_DOCS, SEED_BYTES = 1500, 8 << 20
MOD = 7
END = tn.U(0x0123456789ABCDEF)
AVERAGED = 64
LN10 = math.log(10)


@dataclass
class Vocabulary:
    """hashes (ascending) and ids of the model's words; ids go by falling count, so that classes are runs of ids. bound: first id of each class."""

    hashes: np.ndarray
    ids: np.ndarray
    counts: np.ndarray
    bound: np.ndarray
    total: int
    distinct: int

    @property
    def size(self) -> int:
        return len(self.counts)

    @property
    def tail_tokens(self) -> int:
        return self.total - int(self.counts.sum())

    def id_of(self, h: np.ndarray) -> np.ndarray:
        """Model id of each word; size for tail words."""
        if not self.size:
            return np.zeros(len(h), np.int64)
        i = np.minimum(np.searchsorted(self.hashes, h), self.size - 1)
        return np.where(self.hashes[i] == h, self.ids[i], self.size)

    def inputs(self, h: np.ndarray, ids: np.ndarray) -> np.ndarray:
        return np.where(ids < self.size, ids, self.size + 1 + (h >> tn.U(20)).astype(np.int64) % TAIL_INPUTS)


def vocabulary(top: list[tuple[int, int]], total: int, distinct: int) -> Vocabulary:
    h = np.array([t[0] for t in top], np.int64).view(tn.U)
    counts = np.array([t[1] for t in top], np.int64)
    order = np.argsort(h)
    # classes hold about equal shares of the square roots of counts
    share = np.cumsum(np.sqrt(counts))
    bound = np.unique(np.searchsorted(share, np.linspace(0, share[-1], CLASSES + 1)[:-1])) if len(counts) else np.zeros(0, np.int64)
    return Vocabulary(h[order], order, counts, np.concatenate([bound, [len(counts)]]), total, distinct)


def start_weights(v: Vocabulary) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(7)
    n = v.size + 1 + TAIL_INPUTS
    small = lambda *s: (rng.normal(0, 0.15, s)).astype(np.float32)
    word_bias = np.log((v.counts + 0.5) / (v.total + 1)).astype(np.float32)
    mass = [v.counts[a:b].sum() for a, b in zip(v.bound[:-1], v.bound[1:], strict=True)] + [v.tail_tokens]
    class_bias = np.log((np.array(mass) + 0.5) / (v.total + 1)).astype(np.float32)
    return {"E": small(n, EMBED), "Wx": small(EMBED, 3 * HIDDEN), "b": np.zeros(3 * HIDDEN, np.float32), "Wh": small(HIDDEN, 3 * HIDDEN), "C": small(HIDDEN, len(mass)) * 0.1, "cb": class_bias, "W": small(v.size, HIDDEN) * 0.1, "wb": word_bias}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def step(w: dict, xw: np.ndarray, h: np.ndarray):
    """One step of the gated unit: new state, and what backpropagation needs."""
    a = h @ w["Wh"]
    zr = _sigmoid(xw[:, : 2 * HIDDEN] + a[:, : 2 * HIDDEN])
    z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
    hn = a[:, 2 * HIDDEN :]
    n = np.tanh(xw[:, 2 * HIDDEN :] + r * hn)
    return n + z * (h - n), (h, z, r, hn, n)


def log_probs(w: dict, v: Vocabulary, h: np.ndarray, ids: np.ndarray, grads: dict | None = None):
    """Natural log probability of each target given its state, for tail words that of the class; with grads also adds gradients and gives those of states."""
    cls = (np.searchsorted(v.bound, np.arange(v.size + 1), "right") - 1).astype(np.uint8)[ids]
    order = np.argsort(cls, kind="stable")
    h, ids, cls = h[order], ids[order], cls[order]
    cut = np.searchsorted(cls, np.arange(len(v.bound)))
    logits = h @ w["C"] + w["cb"]
    logits -= logits.max(axis=1, keepdims=True)
    rows = np.arange(len(ids))
    out = logits[rows, cls]
    e = np.exp(logits, out=logits)
    total = e.sum(axis=1)
    out -= np.log(total)
    if grads is not None:
        e /= total[:, None]
        e[rows, cls] -= 1
        grads["C"] += h.T @ e
        grads["cb"] += e.sum(axis=0)
        dh = e @ w["C"].T
    for k in range(len(v.bound) - 1):
        at = slice(int(cut[k]), int(cut[k + 1]))
        if at.start == at.stop:
            continue
        a, b = int(v.bound[k]), int(v.bound[k + 1])
        logits = h[at] @ w["W"][a:b].T + w["wb"][a:b]
        logits -= logits.max(axis=1, keepdims=True)
        mine = rows[: at.stop - at.start], ids[at] - a
        own = logits[mine]
        e = np.exp(logits, out=logits)
        total = e.sum(axis=1)
        out[at] += own - np.log(total)
        if grads is not None:
            e /= total[:, None]
            e[mine] -= 1
            grads["W"][a:b] += e.T @ h[at]
            grads["wb"][a:b] += e.sum(axis=0)
            dh[at] += e @ w["W"][a:b]
    back = np.empty_like(order)
    back[order] = rows
    return out[back] if grads is None else (out[back], dh[back])


class Trainer:
    """Truncated backpropagation with Adam over windows of equal width. Fewer windows than lanes make a smaller step."""

    def __init__(self, w: dict, v: Vocabulary, rate: float, lanes: int = 1):
        self.w, self.v, self.rate, self.lanes, self.t, self.tokens = {k: x.copy() for k, x in w.items()}, v, rate, lanes, 0, 0
        self.m = {k: (np.zeros_like(x), np.zeros_like(x)) for k, x in w.items()}

    def batch(self, inputs: np.ndarray, targets: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
        """inputs and targets: windows by WINDOW; target -1: no token. before: states that the windows begin with, else empty ones. Gives the states after them."""
        w, g = self.w, {k: np.zeros_like(self.w[k]) for k in ("C", "cb", "W", "wb")}
        rows, width = inputs.shape
        table = w["E"] @ w["Wx"] + w["b"]
        x, y = np.ascontiguousarray(inputs.T), np.ascontiguousarray(targets.T)
        states = np.zeros((width + 1, rows, HIDDEN), table.dtype)
        if before is not None:
            states[0] = before
        kept = []
        for t in range(width):
            states[t + 1], memory = step(w, table[x[t]], states[t])
            kept.append(memory)
        live = y >= 0
        d_states = np.zeros((width, rows, HIDDEN), table.dtype)
        _, d_states[live] = log_probs(w, self.v, states[1:][live], y[live], g)
        carry = np.zeros((rows, HIDDEN), table.dtype)
        dxw = np.empty((width, rows, 3 * HIDDEN), table.dtype)
        da = np.empty_like(dxw)
        back = np.ascontiguousarray(w["Wh"].T)
        for t in range(width - 1, -1, -1):
            h, z, r, hn, n = kept[t]
            d = d_states[t] + carry
            dn = d * (1 - z) * (1 - n * n)
            dxw[t, :, :HIDDEN] = d * (h - n) * z * (1 - z)
            dxw[t, :, HIDDEN : 2 * HIDDEN] = dn * hn * r * (1 - r)
            dxw[t, :, 2 * HIDDEN :] = dn
            da[t] = dxw[t]
            da[t, :, 2 * HIDDEN :] *= r
            carry = d * z + da[t] @ back
        g["Wh"] = states[:-1].reshape(-1, HIDDEN).T @ da.reshape(-1, 3 * HIDDEN)
        # gradients of the table's rows: summed over equal inputs
        ids = x.ravel()
        order = np.argsort(ids, kind="stable")
        begin = np.flatnonzero(np.diff(ids[order], prepend=-1))
        dt = np.zeros_like(table)
        dt[ids[order][begin]] = np.add.reduceat(dxw.reshape(-1, 3 * HIDDEN)[order], begin)
        g["b"], g["Wx"], g["E"] = dt.sum(axis=0), w["E"].T @ dt, dt @ w["Wx"].T
        n = max(1, int(live.sum()))
        self.t += 1
        self.tokens += n
        rate = self.rate * min(1.0, math.sqrt(rows / self.lanes))
        for k, p in w.items():
            m, s = self.m[k]
            d = g[k] / n
            m += 0.1 * (d - m)
            s += 0.01 * (d * d - s)
            p -= rate * (m / (1 - 0.9**self.t)) / (np.sqrt(s / (1 - 0.99**self.t)) + 1e-6)
        return states[-1]


def tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of lower-cased words with the end mark after each document, and each document's first token."""
    low = tn.LOWER[data]
    start, end, first = tn.words(low, off)
    h = tn.span_hash(low, start, end)
    n = len(off) - 1
    out = np.full(len(h) + n, END, tn.U)
    doc = tn.owners(first)
    out[np.arange(len(h)) + doc] = h
    return out, first + np.arange(n + 1)


def windows(v: Vocabulary, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inputs and targets of all windows in order, and each document's first window (one entry more than documents)."""
    ids = v.id_of(h)
    previous = np.concatenate([[v.size], v.inputs(h, ids)[:-1]]) if len(h) else np.zeros(0, np.int64)
    previous[first[:-1]] = v.size
    begin = np.concatenate([[0], np.cumsum(-(-np.diff(first) // WINDOW))])
    doc = np.repeat(np.arange(len(first) - 1), np.diff(begin))
    at = (first[doc] + (np.arange(len(doc)) - begin[doc]) * WINDOW)[:, None] + np.arange(WINDOW)[None, :]
    live = at < first[doc + 1][:, None]
    at = np.where(live, at, 0)
    return np.where(live, previous[at], v.size).astype(np.int32), np.where(live, ids[at], -1).astype(np.int32), begin


def train_on(trainer: Trainer, columns) -> None:
    """Trains on every window of the texts, a document in each lane: its state goes from window to window, and where it ends the next begins with an empty one."""
    at, end, state = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, HIDDEN), np.float32)
    x, y = np.zeros((0, WINDOW), np.int32), np.zeros((0, WINDOW), np.int32)

    def stepped():
        after = trainer.batch(x[at], y[at], state)
        on = at + 1 < end
        return at[on] + 1, end[on], after[on]

    for column in columns:
        for _, _, data, off in tn.texts(column):
            more_x, more_y, begin = windows(trainer.v, *tokens(data, off))
            rest = tn.ranges(at, end - 1)
            end = np.cumsum(end - at)
            at = np.concatenate([[0], end])[:-1]
            x, y = np.concatenate([x[rest], more_x]), np.concatenate([y[rest], more_y])
            begin = begin + len(rest)
            doc = 0
            while True:
                n = min(trainer.lanes - len(at), len(begin) - 1 - doc)
                at, end = np.concatenate([at, begin[doc : doc + n]]), np.concatenate([end, begin[doc + 1 : doc + n + 1]])
                state = np.concatenate([state, np.zeros((n, HIDDEN), np.float32)])
                doc += n
                if len(at) < trainer.lanes:
                    break
                at, end, state = stepped()
    while len(at):
        at, end, state = stepped()


def score(w: dict, v: Vocabulary, ids: np.ndarray, inputs: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Natural log probability of each document's tokens, tail words as their class: all documents step together, in windows, longest first."""
    n = np.diff(first)
    order = np.argsort(-n, kind="stable")
    longest = int(n.max()) if len(n) else 0
    table = w["E"] @ w["Wx"] + w["b"]
    h = np.zeros((len(n), HIDDEN), np.float32)
    out = np.zeros(len(n))
    base = first[:-1][order]
    ordered = -n[order]
    for t0 in range(0, longest, WINDOW):
        states, where, docs = [], [], []
        for t in range(t0, min(t0 + WINDOW, longest)):
            active = int(np.searchsorted(ordered, -t, "left"))
            at = base[:active] + t
            x = inputs[at - 1] if t else np.full(active, v.size)
            new, _ = step(w, table[x], h[:active])
            h[:active] = new
            states.append(new)
            where.append(at)
            docs.append(order[:active])
        s, at, doc = np.concatenate(states), np.concatenate(where), np.concatenate(docs)
        for i in range(0, len(at), 100_000):
            j = slice(i, i + 100_000)
            out += np.bincount(doc[j], log_probs(w, v, s[j], ids[at[j]]), len(n))
    return out


def _counts(batches):
    """Each word of the shard with its number in training documents."""
    words, numbers, shard = [np.zeros(0, tn.U)], [np.zeros(0, np.int64)], None
    size = 0

    def merged():
        h, at = np.unique(np.concatenate(words), return_inverse=True)
        return h, np.bincount(at, np.concatenate(numbers), len(h)).astype(np.int64)

    for b in batches:
        shard = b.column("shard")[0].as_py() if len(b) else shard
        train = ~b.column("held_out").to_numpy(zero_copy_only=False)
        for lo, hi, data, off in tn.texts(b.column("text")):
            h, first = tokens(data, off)
            u, at = np.unique(h, return_inverse=True)
            words.append(u)
            numbers.append(np.bincount(at, np.repeat(train[lo:hi], np.diff(first)), len(u)).astype(np.int64))
            size += len(u)
        if size > 2_000_000:
            h, c = merged()
            words, numbers, size = [h], [c], 0
    h, c = merged()
    for i in range(0, len(h), 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(h[i : i + 50_000].view(np.int64)), pa.array(np.full(len(h[i : i + 50_000]), shard, np.int32)), pa.array(c[i : i + 50_000])], names=["w", "shard", "c"])
    tn.trim()


def _pack(w: dict) -> bytes:
    return np.concatenate([x.ravel() for x in w.values()]).astype("<f4").tobytes()


def _unpack(raw: np.ndarray, like: dict) -> dict:
    out, i = {}, 0
    for k, x in like.items():
        out[k] = raw[i : i + x.size].reshape(x.shape).astype(np.float32)
        i += x.size
    return out


def train(docs: DataFrame, v: Vocabulary, seed_docs: int = SEED_DOCS) -> dict:
    """Averaged weights. docs: id and text of the training documents."""
    w = start_weights(v)
    if not v.size:
        return w
    lots = docs.select(F.xxhash64("id", "text").alias("lot"), "text", F.lit(True).alias("kind"))
    seed = drawn(lots, {True: seed_docs}, SEED_BYTES).toArrow().sort_by("lot")
    first_trainer = Trainer(w, v, 0.01, SEED_LANES)
    train_on(first_trainer, [seed.column("text")])
    w = first_trainer.w

    def run(batches):
        trainer = Trainer(w, v, 0.004, LANES)
        train_on(trainer, (b.column("text") for b in batches))
        if trainer.tokens:
            yield pa.RecordBatch.from_arrays([pa.array([float(trainer.tokens)]), pa.array([_pack(trainer.w)], pa.binary())], names=["n", "w"])

    def summed(batches):
        total, weight = None, 0.0
        for b in batches:
            for n, raw in zip(b.column("n").to_pylist(), b.column("w").to_pylist(), strict=True):
                x = np.frombuffer(raw, "<f4").astype(np.float64) * n
                total, weight = x if total is None else total + x, weight + n
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([weight]), pa.array([(total / weight).astype("<f4").tobytes()], pa.binary())], names=["n", "w"])

    schema = "n double, w binary"
    rows = docs.select("text").mapInArrow(trimmed(run), schema).repartition(AVERAGED).mapInArrow(summed, schema).collect()
    weight = sum(r["n"] for r in rows)
    return _unpack(sum(np.frombuffer(r["w"], "<f4").astype(np.float64) * (r["n"] / weight) for r in sorted(rows, key=lambda r: (r["n"], bytes(r["w"])))), w) if rows else w


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mod: int = MOD) -> DataFrame:
    """For each document: its id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10)."""
    spark = docs.sparkSession
    tuned(spark)
    n = parts(docs.select(id_col, text_col))
    ours = dealt(docs, id_col, text_col, n).withColumn("held_out", held_out(F.col("id"), mod))
    kind = ours.schema["id"].dataType.simpleString()
    pairs = saved(ours.select("text", "shard", "held_out").repartitionById(n, F.col("shard")).mapInArrow(_counts, "w long, shard int, c long"), "words")
    counts = saved(pairs.groupBy("w").agg(F.sum("c").alias("c")).filter("c > 0"), "counts")
    total, distinct = (x or 0 for x in counts.agg(F.sum("c"), F.count(F.lit(1))).first())
    top = [tuple(r) for r in counts.orderBy(F.desc("c"), "w").limit(TOP + 1).collect()]
    v = vocabulary(top, total, distinct)
    w = train(ours.filter(~F.col("held_out")).select("id", "text"), v)
    side = saved(pairs.select("w", "shard").join(counts, "w", "left").select("w", F.coalesce("c", F.lit(0)).alias("c"), "shard"), "known")
    dropped(pairs, counts)
    tail_words = distinct - v.size

    def run(side_batches, doc_batches):
        sides = [(tn.as_u64(b.column("w")), b.column("c").to_numpy()) for b in side_batches]
        words = np.concatenate([x for x, _ in sides]) if sides else np.zeros(0, tn.U)
        order = np.argsort(words)
        words, count = words[order], (np.concatenate([c for _, c in sides]) if sides else np.zeros(0, np.int64))[order]
        model_id = v.id_of(words)
        model_in = v.inputs(words, model_id).astype(np.int32)
        base = np.log10((count + 1) / (total + distinct + 1))
        share = np.where(model_id < v.size, 0.0, np.log10((count + 1) / (v.tail_tokens + tail_words + 1)))
        kept, place, first, meta = [], [], [], []
        size = 0

        def scored():
            at = np.concatenate(place)
            n_tok = np.concatenate([np.diff(f) for f in first])
            begin = np.concatenate([[0], np.cumsum(n_tok)])
            sums = lambda x: np.add.reduceat(x, begin[:-1])  # noqa: E731  no document is without a token
            log10 = score(w, v, model_id[at], model_in[at], begin) / LN10 + sums(share[at])
            arrays = [pa.concat_arrays(kept), pa.concat_arrays(meta), pa.array(n_tok), pa.array(sums((count[at] > 0).astype(np.int64))), pa.array(np.full(len(n_tok), total, np.int64)), pa.array(sums(base[at])), pa.array(log10)]
            return pa.RecordBatch.from_arrays(arrays, names=["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

        for b in doc_batches:
            for lo, hi, data, off in tn.texts(b.column("text")):
                h, f = tokens(data, off)
                place.append(np.searchsorted(words, h).astype(np.int32))
                first.append(f)
                kept.append(b.column("id").slice(lo, hi - lo))
                meta.append(b.column("held_out").slice(lo, hi - lo))
                size += len(h)
            if size > 4_000_000:
                yield scored()
                kept, place, first, meta, size = [], [], [], [], 0
        if kept:
            yield scored()

    schema = f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return beside(ours, side, n, run, schema).withColumnRenamed("id", id_col)
