"""Toxicity: a linear-chain conditional random field over two labels tags toxic words; its marginals give document scores and offending offsets.

Training, on the driver: at most SAMPLE toxic and CLEAN * SAMPLE clean labelled documents, drawn by a hash, of at most SAMPLE_BYTES of text in all and whole
each; near copies once. A word of a toxic document is labelled when documents of the toxic class have it far more often; all other words are clean. The
field has a weight for words and 4-byte word beginnings that lean to the toxic class, a bias and transitions; likelihood is climbed with forward-backward
marginals on stretches of STRETCH words: all that hold a word with a weight, and as many others, drawn by their hash.
A logistic curve over a document's evidence is fitted on the same documents, weighted to the classes' shares among all labelled rows.

Scoring, in one pass and without a shuffle: words without weights are alike, so a run of g of them is one matrix to the power g. Forward and backward
go over the words with weights only, and are exact for whole texts of any length.

Results: null and empty texts get the score of a text without evidence. Repeated rows get equal scores. Labels that disagree count as toxic, null labels
don't count. Without labels of both classes every score is the share of toxic labels. Only ids, texts and labels are read; of these, only the text makes a score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm import textnp as tn
from tidelog.llm.common import drawn, held_out, trimmed, tuned

SAMPLE = 1200
SAMPLE_BYTES = 12 << 20
#: Clean documents are sampled more, up to so many times SAMPLE.
CLEAN = 2
STRETCH = 100
ROUNDS = 40
BEGINNING = 4
MOD = 4
THRESHOLD = 0.3
#: Log odds from which a word's beginning or form gets a weight, and from which a word of a toxic document is labelled.
LEANING, LABELLED = 1.0, 2.0
MIN_DOCS = 3
#: White space and ASCII punctuation part words.
PARTS = np.zeros(256, bool)
PARTS[[c for c in range(128) if not chr(c).isalnum()]] = True


@dataclass
class Field:
    """Hashes with a weight (words and beginnings, ascending), the bias of label 1, transition potentials, and the document curve."""

    word: np.ndarray
    word_weight: np.ndarray
    head: np.ndarray
    head_weight: np.ndarray
    bias: float
    trans: np.ndarray
    curve: np.ndarray
    prior: float


def tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """Word starts, ends, first word of each document, word hashes and hashes of word beginnings (0: the word is no longer)."""
    low = tn.LOWER[data]
    start, end, first = tn.words(np.where(PARTS[low], np.uint8(32), low), off)
    sums = tn.Prefix(low, tn.BYTE_BASE)
    head = sums.spans(start, np.minimum(end, start + BEGINNING))
    head[end - start <= BEGINNING] = 0
    return start, end, first, sums.spans(start, end), head


def _weights(h: np.ndarray, keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(h)), np.zeros(len(h), np.int64)
    i = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    hit = keys[i] == h
    return np.where(hit, weights[i], 0.0), np.where(hit, i + 1, 0)


def _document_counts(h: np.ndarray, doc: np.ndarray, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((doc, h))
    h, doc = h[order], doc[order]
    del order
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])])[: len(h)]
    h, doc = h[new], doc[new]
    new = np.concatenate([[True], h[1:] != h[:-1]])[: len(h)]
    keys, at = h[new], np.cumsum(new) - 1
    return keys, np.bincount(at, toxic[doc], len(keys)), np.bincount(at, ~toxic[doc], len(keys))


def _leaning(t: np.ndarray, c: np.ndarray, n_t: int, n_c: int) -> np.ndarray:
    """Log odds of the toxic class, or 0 where the likelihood ratio doesn't tell them from chance."""
    share = n_t / (n_t + n_c)
    ratio = 2 * (t * np.log(np.maximum(t, 1e-9) / ((t + c) * share)) + c * np.log(np.maximum(c, 1e-9) / ((t + c) * (1 - share))))
    return np.where((t >= MIN_DOCS) & (ratio >= 2 * np.log(n_t + n_c)), _log_odds(t, c, n_t, n_c), 0.0)


def _log_odds(t: np.ndarray, c: np.ndarray, n_t: int, n_c: int) -> np.ndarray:
    return np.log((t + 0.1) / (n_t + 0.2)) - np.log((c + 0.1) / (n_c + 0.2))


def _sweep(emit: np.ndarray, live: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Forward-backward over rows of equal width. Gives P(label 1) of each word, expected transitions and log partition. emit: potential of label 1."""
    rows, width = emit.shape
    fwd, scale = np.zeros((width, 2, rows)), np.ones((width, rows))
    for t in range(width):
        if t:
            p0, p1 = fwd[t - 1]
            a0, a1 = p0 * trans[0, 0] + p1 * trans[1, 0], p0 * trans[0, 1] + p1 * trans[1, 1]
        else:
            a0, a1 = np.ones(rows), np.ones(rows)
        a1 = a1 * emit[:, t]
        z = np.where(live[:, t], a0 + a1, 1.0)
        fwd[t] = np.where(live[:, t], [a0 / z, a1 / z], fwd[t - 1] if t else 0.5)
        scale[t] = z
    back = np.ones((2, rows))
    prob, pairs = np.zeros((rows, width)), np.zeros((2, 2))
    for t in range(width - 1, -1, -1):
        on = live[:, t]
        g0, g1 = fwd[t] * back
        prob[:, t] = np.where(on, g1 / (g0 + g1), 0.0)
        if t:
            b0, b1 = back[0], back[1] * emit[:, t]
            p0, p1 = fwd[t - 1]
            both = np.array([[p0 * trans[0, 0] * b0, p0 * trans[0, 1] * b1], [p1 * trans[1, 0] * b0, p1 * trans[1, 1] * b1]])
            pairs += (both / both.sum(axis=(0, 1)) * on).sum(axis=2)
            n0, n1 = trans[0, 0] * b0 + trans[0, 1] * b1, trans[1, 0] * b0 + trans[1, 1] * b1
            back = np.where(on, [n0, n1] / (n0 + n1), back)
    return prob, pairs, float(np.log(scale).sum())


def _fit_field(word: np.ndarray, head: np.ndarray, first: np.ndarray, toxic: np.ndarray) -> tuple:
    doc = tn.owners(first).astype(np.int32)
    n_t, n_c = int(toxic.sum()), int((~toxic).sum())
    keys, t, c = _document_counts(word, doc, toxic)
    odds = _leaning(t, c, n_t, n_c)
    lean = odds >= LEANING
    strong = keys[odds >= LABELLED]
    words, start_w = keys[lean], odds[lean]
    keys, t, c = _document_counts(head[head != 0], doc[head != 0], toxic)
    heads = keys[_leaning(t, c, n_t, n_c) >= LEANING]
    label = tn.member(word, strong) & toxic[doc]
    w_of, h_of = _weights(word, words, start_w)[1], _weights(head, heads, np.zeros(len(heads)))[1]
    # stretches that hold a weighted word are the ones that teach weights; of the others, as many again
    place = np.arange(len(word)) - first[doc]
    new = (place % STRETCH == 0).nonzero()[0]
    size = np.diff(np.concatenate([new, [len(word)]]))
    hot = np.add.reduceat(((w_of > 0) | (h_of > 0)).astype(np.int64), new) > 0 if len(new) else np.zeros(0, bool)
    cold = np.flatnonzero(~hot)
    lots = tn.Prefix(word, tn.GRAM_BASE).spans(new[cold], new[cold] + size[cold])
    chosen = np.sort(np.concatenate([np.flatnonzero(hot), cold[np.argsort(lots, kind="stable")[: hot.sum()]]]))
    live = np.arange(STRETCH)[None, :] < size[chosen][:, None]
    at = np.where(live, new[chosen][:, None] + np.arange(STRETCH)[None, :], 0)
    y = label[at] & live
    wi, hi = np.where(live, w_of[at], 0).astype(np.int32), np.where(live, h_of[at], 0).astype(np.int32)
    del w_of, h_of, at, doc, label
    tn.trim()
    ww, hw = np.concatenate([[0.0], start_w]), np.zeros(len(heads) + 1)
    bias, logt = -4.0, np.zeros((2, 2))
    seen = np.zeros((2, 2))
    both = live[:, 1:]
    for i in (0, 1):
        for j in (0, 1):
            seen[i, j] = ((y[:, :-1] == i) & (y[:, 1:] == j) & both).sum()
    params = [ww, hw, np.array([bias]), logt]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    for step in range(1, ROUNDS + 1):
        emit = np.exp(np.clip(ww[wi] + hw[hi] + params[2][0], -30, 30))
        prob, pairs, _ = _sweep(emit, live, np.exp(logt))
        error = np.where(live, prob - y, 0.0)
        grads = [np.bincount(wi.ravel(), error.ravel(), len(ww)) + 0.05 * ww, np.bincount(hi.ravel(), error.ravel(), len(hw)) + 0.2 * hw, np.array([error.sum()]), pairs - seen + 1.0 * logt]
        grads[0][0] = grads[1][0] = 0.0
        grads[3][0, 0] = 0.0
        for p, g, (m, v) in zip(params, grads, moments, strict=True):
            m += 0.1 * (g - m)
            v += 0.02 * (g * g - v)
            p -= 0.3 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.98**step)) + 1e-8)
    return words, ww[1:], heads, hw[1:], float(params[2][0]), np.exp(logt)


def marginals(field: Field, word: np.ndarray, head: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words with weights: their place, P(toxic) given the whole document, and each document's first of them."""
    a, i = _weights(word, field.word, field.word_weight)
    b, j = _weights(head, field.head, field.head_weight)
    at = np.flatnonzero((i > 0) | (j > 0))
    emit = np.exp(np.clip(a[at] + b[at] + field.bias, -30, 30))
    begin = np.searchsorted(at, first)
    # one plain word: then the next label, M = diag(1, exp(bias)) T; its powers from its eigenvalues
    plain = np.diag([1.0, np.exp(field.bias)]) @ field.trans
    value, vector = np.linalg.eig(plain)
    value, vector = value.real, vector.real
    top = int(np.argmax(value))
    one = np.outer(vector[:, top], np.linalg.inv(vector)[top])
    two = np.outer(vector[:, 1 - top], np.linalg.inv(vector)[1 - top])
    ratio = value[1 - top] / value[top]

    def run_of(gap: np.ndarray) -> np.ndarray:
        return one[:, :, None] + two[:, :, None] * np.power(ratio, np.maximum(gap, 0))[None, None, :]

    n = np.diff(begin)
    order = np.argsort(-n, kind="stable")
    prob = np.zeros(len(at))
    if not len(at):
        return at, prob, begin
    active = np.searchsorted(-n[order], -np.arange(int(n.max())), "left")  # documents with more than t such words
    before = np.concatenate([[0], at[:-1] + 1])
    starts_doc = np.zeros(len(at), bool)
    starts_doc[begin[:-1][n > 0]] = True
    doc = np.repeat(np.arange(len(n)), n)
    gap = np.where(starts_doc, at - first[doc], at - before)
    lead = run_of(gap)
    step = np.einsum("ij,jkn->ikn", field.trans, lead)  # label of the word before to label of this one
    base = begin[:-1][order]
    fwd = np.zeros((2, len(at)))
    for t in range(len(active)):
        k = base[: active[t]] + t
        if t:
            p = fwd[:, k - 1]
            a0, a1 = (p[0] * step[0, j, k] + p[1] * step[1, j, k] for j in (0, 1))
        else:
            a0, a1 = lead[0, 0, k] + lead[1, 0, k], lead[0, 1, k] + lead[1, 1, k]
        a1 = a1 * emit[k]
        z = a0 + a1
        fwd[0, k], fwd[1, k] = a0 / z, a1 / z
    tail = run_of(first[1:] - 1 - at[np.maximum(begin[1:] - 1, 0)])
    # after the last weighted word: gap words follow, and the last label may be either
    after = np.einsum("ij,jkn->ikn", field.trans, tail)
    bare = np.linalg.inv(field.trans) if abs(np.linalg.det(field.trans)) > 1e-12 else np.eye(2)
    back = np.ones((2, len(n)))
    for i in (0, 1):
        back[i] = np.maximum((after[i].T @ bare).sum(axis=1), 1e-12)
    for t in range(len(active) - 1, -1, -1):
        docs = order[: active[t]]
        k = begin[docs] + t
        g0, g1 = fwd[0, k] * back[0, docs], fwd[1, k] * back[1, docs]
        prob[k] = g1 / (g0 + g1)
        if t:
            b0, b1 = back[0, docs], back[1, docs] * emit[k]
            n0, n1 = step[0, 0, k] * b0 + step[0, 1, k] * b1, step[1, 0, k] * b0 + step[1, 1, k] * b1
            z = n0 + n1
            back[0, docs], back[1, docs] = n0 / z, n1 / z
    return at, prob, begin


def evidence(prob: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """For each document: one, the log odds that any word is toxic, the log of expected toxic words."""
    sums = lambda x: np.concatenate([[0.0], np.cumsum(x)])
    none = sums(np.log1p(-np.minimum(prob, 1 - 1e-9)))
    none = none[begin[1:]] - none[begin[:-1]]
    many = sums(prob)
    many = many[begin[1:]] - many[begin[:-1]]
    some = np.clip(np.log(np.maximum(-np.expm1(none), 1e-6)) - none, -12, 12)
    return np.stack([np.ones(len(none)), some, np.log1p(np.maximum(many, 0))], axis=1)


def _fit_curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    beta = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        g = x.T @ (weight * (p - y)) + 1e-2 * beta
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(beta))
        beta -= np.linalg.solve(h, g)
    return beta


def _distinct(word: np.ndarray, first: np.ndarray) -> np.ndarray:
    """First document of each group with the same least hash of 8 words: near copies count once in training."""
    g = tn.gram_hash(word, 8)
    n = np.diff(first)
    key = np.zeros(len(n), tn.U)
    whole = tn.Prefix(word, tn.GRAM_BASE_2).spans(first[:-1], first[1:])
    for d in range(len(n)):
        key[d] = g[first[d] : first[d + 1] - 7].min() if n[d] >= 8 else whole[d]
    return np.sort(np.unique(key, return_index=True)[1])


def train(texts: pa.Array, toxic: np.ndarray, prior: float) -> Field:
    none = Field(*[np.zeros(0, tn.U), np.zeros(0)] * 2, -4.0, np.ones((2, 2)), np.zeros(3), prior)
    if not toxic.any() or toxic.all():
        return none
    parts = [(lo, *tokens(data, off)[2:]) for lo, _, data, off in tn.texts(texts)]
    word, head = (np.concatenate([p[i] for p in parts]) for i in (2, 3))
    first = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(p[1]) for p in parts]))])
    keep = _distinct(word, first)
    at = tn.ranges(first[keep], first[keep + 1] - 1) if (np.diff(first)[keep] > 0).all() else np.concatenate([np.arange(first[k], first[k + 1]) for k in keep])
    word, head, toxic = word[at], head[at], toxic[keep]
    first = np.concatenate([[0], np.cumsum(np.diff(first)[keep])])
    if not len(word) or not toxic.any() or toxic.all():
        return none
    field = Field(*_fit_field(word, head, first, toxic), np.zeros(3), prior)
    _, prob, begin = marginals(field, word, head, first)
    weight = np.where(toxic, prior / toxic.mean(), (1 - prior) / (1 - toxic.mean()))
    field.curve = _fit_curve(evidence(prob, begin), toxic.astype(float), weight)
    return field


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, mod: int = MOD, sample_bytes: int = SAMPLE_BYTES) -> Field:
    """Trains on at most `sample` toxic and CLEAN * `sample` clean documents whose crc32(id) mod `mod` isn't 2, of at most sample_bytes together."""
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col), mod)).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("y"))
    shares = {r["y"]: r["n"] for r in known.groupBy((F.col("y") > 0).alias("y")).agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(shares.values())
    prior = shares.get(True, 0) / total if total else 0.0
    most = {True: sample, False: sample * CLEAN}
    pick = [known.filter(F.col("y") > 0 if toxic else F.col("y") <= 0).orderBy(F.xxhash64("id"), "id").limit(n) for toxic, n in most.items()]
    chosen = F.broadcast(pick[0].unionByName(pick[1]))  # ids, sample * (1 + CLEAN) at most
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(chosen, "id").select(F.xxhash64("id", "text").alias("lot"), "text", (F.col("y") > 0).alias("kind"))
    table = drawn(rows, most, sample_bytes).toArrow().combine_chunks().sort_by("lot")
    field = train(table.column("text"), table.column("kind").to_numpy().astype(bool), prior)
    tn.trim()  # the driver goes on with other stages
    return field


def score_texts(field: Field, texts: pa.Array):
    """Yields first row, row after the last, scores and offending byte spans of each slice."""
    for lo, hi, data, off in tn.texts(texts):
        start, end, first, word, head = tokens(data, off)
        at, prob, begin = marginals(field, word, head, first)
        x = evidence(prob, begin)
        score = 1 / (1 + np.exp(-np.clip(x @ field.curve, -30, 30))) if len(field.word) else np.full(hi - lo, field.prior)
        yield lo, hi, score, (at, prob, begin, start, end, off)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", spans: bool = False, mod: int = MOD, **options) -> DataFrame:
    """doc_id, held_out, score and predicted of every document; with spans also offending byte spans, where P(toxic) of a word is at least one half."""
    tuned(docs.sparkSession)
    field = fit(docs, labels, id_col, text_col, mod=mod, **options)
    narrow = docs.select(F.col(id_col).alias("id"), held_out(F.col(id_col), mod).alias("held_out"), F.col(text_col).alias("text"))

    def run(batches):
        for b in batches:
            for lo, hi, score, (at, prob, begin, start, end, off) in score_texts(field, b.column("text")):
                cols = [b.column("id").slice(lo, hi - lo), b.column("held_out").slice(lo, hi - lo), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))]
                names = ["id", "held_out", "score", "predicted"]
                if spans:
                    bad = prob >= 0.5
                    cols.append(pa.array([[{"start": int(start[w] - off[d]), "end": int(end[w] - off[d])} for w in at[begin[d] : begin[d + 1]][bad[begin[d] : begin[d + 1]]]] for d in range(hi - lo)], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))))
                    names.append("spans")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    kind = narrow.schema["id"].dataType.simpleString()
    schema = f"id {kind}, held_out boolean, score double, predicted int" + ", spans array<struct<start:bigint,end:bigint>>" * spans
    return narrow.mapInArrow(trimmed(run), schema).withColumnRenamed("id", id_col)


def without_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, **options) -> DataFrame:
    """docs without the rows that score at least threshold; rows and columns stay as they are."""
    tuned(docs.sparkSession)
    field = fit(docs, labels, id_col, text_col, **options)
    i = docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            keep = [score < threshold for _, _, score, _ in score_texts(field, b.column(i))]
            yield b.filter(pa.array(np.concatenate(keep) if keep else np.zeros(0, bool)))

    return docs.mapInArrow(trimmed(run), docs.schema)
