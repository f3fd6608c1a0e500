"""Toxicity, quality, URL, language-model and decontamination operators."""

import itertools
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from tidelog.llm import decontamination, quality, recurrent_lm, toxicity, url_filter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLDER = "/root/testdata/sf0.01"


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


# toxicity


def test_collapsed_marginals_are_exact():
    rng = np.random.default_rng(0)
    f = toxicity.Field(np.sort(rng.integers(1, 2**60, 5).astype(np.uint64)), rng.normal(1, 2, 5), np.zeros(0, np.uint64), np.zeros(0), -1.3, np.exp(rng.normal(0, 1, (2, 2))), np.zeros(3), 0.1)
    first = np.concatenate([[0], np.cumsum([0, 1, 7, 30, 0, 12])])
    word = np.where(rng.random(first[-1]) < 0.3, f.word[rng.integers(0, 5, first[-1])], np.uint64(7)).astype(np.uint64)
    at, prob, begin = toxicity.marginals(f, word, np.zeros(len(word), np.uint64), first)
    for d in range(len(first) - 1):
        w = word[first[d] : first[d + 1]]
        emit = np.exp(toxicity._weights(w, f.word, f.word_weight)[0] + f.bias)
        weights = {}
        for labels in itertools.product((0, 1), repeat=len(w)) if len(w) <= 12 else []:
            x = 1.0
            for i, y in enumerate(labels):
                x *= (emit[i] if y else 1.0) * (f.trans[labels[i - 1], y] if i else 1.0)
            weights[labels] = x
        if len(w) and weights:
            total = sum(weights.values())
            for k in range(begin[d], begin[d + 1]):
                i = at[k] - first[d]
                assert math.isclose(prob[k], sum(x for y, x in weights.items() if y[i]) / total, rel_tol=1e-9)


def test_document_scores_against_all_labellings():
    """Texts through score_texts, and each labelling of their words weighed by itself."""
    rng = np.random.default_rng(2)
    hash_of = lambda w: int(toxicity.tokens(*column_bytes([w]))[3][0])
    head_of = lambda w: int(toxicity.tokens(*column_bytes([w]))[4][0])
    words = sorted([(hash_of(w), x) for w, x in (("grot", 3.1), ("vexil", 1.2), ("mild", -0.7))])
    heads = sorted([(head_of("snarbing"), 2.0), (head_of("vexil"), 0.4)])
    f = toxicity.Field(np.array([h for h, _ in words], np.uint64), np.array([x for _, x in words]), np.array([h for h, _ in heads], np.uint64), np.array([x for _, x in heads]), -2.1, np.exp(rng.normal(0, 1, (2, 2))), np.array([-1.0, 0.6, 0.8]), 0.1)
    texts = ["", None, "plain words only", "Grot!", "a vexil, b grot mild", "snarbing snarb snarbed x y", "mild mild a b c grot vexil d"]
    got = np.concatenate([s for _, _, s, _ in toxicity.score_texts(f, pa.array(texts))])
    for text, score in zip(texts, got, strict=True):
        each = re.findall("[a-z]+", lower(text or ""))
        gain = [dict(words).get(hash_of(w), 0.0) + dict(heads).get(head_of(w), 0.0) for w in each]
        known = [hash_of(w) in dict(words) or head_of(w) in dict(heads) for w in each]
        total, toxic = 0.0, np.zeros(len(each))
        for labels in itertools.product((0, 1), repeat=len(each)):
            x = math.prod([math.exp(g + f.bias) for g, y in zip(gain, labels, strict=True) if y] + [f.trans[a, b] for a, b in itertools.pairwise(labels)])
            total += x
            toxic += x * np.array(labels)
        p = [t / total for t, k in zip(toxic, known, strict=True) if k]
        none = sum(math.log1p(-x) for x in p)
        some = math.log(max(1 - math.exp(none), 1e-6)) - none
        z = f.curve @ [1, min(max(some, -12), 12), math.log1p(sum(p))]
        assert math.isclose(score, 1 / (1 + math.exp(-z)), rel_tol=1e-6), text


def test_toxicity_sample_is_bounded_in_bytes(spark, toxic_docs):
    docs, labels = toxic_docs
    seen = []
    was = toxicity.train
    try:
        toxicity.train = lambda texts, toxic, prior: seen.append((sum(len(t or "") for t in texts.to_pylist()), len(toxic))) or was(texts, toxic, prior)
        toxicity.fit(docs, labels, sample_bytes=5000)
        toxicity.fit(docs, labels, sample=50)
    finally:
        toxicity.train = was
    assert 2500 < seen[0][0] <= 5000 and 50 < seen[1][1] <= 150


@pytest.fixture(scope="module")
def toxic_docs(spark):
    rng = np.random.default_rng(4)
    plain, bad = [f"plain{i}" for i in range(200)], ["grot", "vexil", "snarb", "quorl"]
    docs, labels = [], []
    for i in range(700):
        words = list(rng.choice(plain, int(rng.integers(5, 80))))
        toxic = bool(i % 4 == 0)
        if toxic:
            for _ in range(2):
                words.insert(int(rng.integers(0, len(words))), str(rng.choice(bad)))
        docs.append((i, " ".join(words), "held_out", 1.0))
        labels.append((i, int(toxic)))
    docs += [(None, None, "x", 0.0), (1000, "", "x", 0.0), (1001, "Grot, " * 5, "x", 0.0), (1001, "Grot, " * 5, "x", 0.0)]
    return spark.createDataFrame(docs, "doc_id long, text string, id string, score double"), spark.createDataFrame([*labels, (5, 0), (6, None), (None, 1)], "doc_id long, toxic int")


def test_toxicity_on_held_out_documents(spark, toxic_docs):
    docs, labels = toxic_docs
    got = toxicity.toxicity(docs, labels, spans=True).collect()
    assert len(got) == 704
    for r in got:
        i = r["doc_id"]
        assert r["held_out"] == (zlib.crc32(("" if i is None else str(i)).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
        want = i == 1001 or i is not None and i < 700 and i % 4 == 0
        assert bool(r["predicted"]) == want, r
        assert bool(r["spans"]) == want
    spans = next(r for r in got if r["doc_id"] == 1001)["spans"]
    assert [(s["start"], s["end"]) for s in spans] == [(6 * k, 6 * k + 4) for k in range(5)]
    kept = toxicity.without_toxic(docs, labels)
    assert kept.schema == docs.schema and kept.count() == 704 - 175 - 2


def test_toxicity_without_labels(spark, toxic_docs):
    docs, labels = toxic_docs
    assert {r["score"] for r in toxicity.toxicity(docs, labels.filter("toxic = 0")).collect()} == {0.0}
    assert toxicity.toxicity(docs.filter("false"), labels).collect() == [] and toxicity.without_toxic(docs, labels.filter("false")).count() == 704


# quality


def base_of(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = Counter(grams)
    hit = {i + k for i, g in enumerate(grams) if count[g] > 1 for k in range(3)}
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit), n < 50 or 100 * len(hit) > 50 * n


def test_quality_against_a_loop(spark):
    rng = np.random.default_rng(3)
    texts = [None, "", "\n\n", "a b c a b c a b c", "x\ny\nx\n x\n", "é # ü | " * 40, "w " * 500] + [" ".join(f"{rng.integers(1e6)}" for _ in range(8 if k < 22 else 70)) for k in range(30)] + ["\n".join(" ".join(f"{rng.integers(1e6)}" for _ in range(9)) for _ in range(12)) for _ in range(80)]
    rows = [(i, t, None if i % 7 == 0 else "bad" if i < 37 else f"h{i % 3}", 1) for i, t in enumerate(texts)]
    got = {r["doc_id"]: tuple(r)[1:] for r in quality.host_quality(spark.createDataFrame(rows, "doc_id long, text string, source string, bad int")).collect()}
    assert len(got) == len(texts)
    facts = [base_of(t) for t in texts]
    assert [got[i][:6] for i in range(len(texts))] == facts
    hosts = {}
    for (_, t, host, _), (n, _, symbols, dup, _, failed) in zip(rows, facts, strict=True):
        lines = sum(bool(WORD.search(x)) for x in (t or "").split("\n"))
        a = hosts.setdefault(host, [0, 0])
        a[0] += 1
        a[1] += failed or 10 * symbols > n or 3 * dup > lines
    total = sum(n for n, _ in hosts.values())
    mean = sum(k for _, k in hosts.values()) / total
    spread = sum(k * k / n for n, k in hosts.values()) / total - mean**2 - mean * (1 - mean) * len(hosts) / total
    weight = mean * (1 - mean) / spread - 1
    bad = {h for h, (n, k) in hosts.items() if (k + mean * weight) / (n + weight) > 0.5}
    assert "bad" in bad and "h0" not in bad and [got[i][6] for i in range(len(texts))] == [not f[5] and r[2] not in bad for f, r in zip(facts, rows, strict=True)]
    assert any(not f[5] and r[2] in bad for f, r in zip(facts, rows, strict=True))
    assert quality.host_quality(spark.createDataFrame([], "doc_id long, text string, source string")).collect() == []


def test_rates_shrink_to_the_prior(spark):
    rows = [("a", i < 30) for i in range(100)] + [("b", i < 35) for i in range(100)] + [("c", True)] * 2
    out = {r["host"]: r for r in quality.host_verdicts(spark.createDataFrame(rows, "host string, failed boolean")).collect()}
    assert 0.3 < out["c"]["rate"] < 1 and abs(out["a"]["rate"] - 0.3) < 0.05 and out["c"]["n"] == 2


# URLs


def test_cascade_is_exact(spark):
    listed = [f"k{i}" for i in range(300)]
    universe = spark.createDataFrame([(k,) for k in listed[:200] + [f"u{i}" for i in range(5000)]], "key string")
    c = url_filter.Cascade(spark.createDataFrame([(k,) for k in listed], "key string"), 300, universe, 5200)
    from pyspark.sql import functions as F

    got = {r["key"] for r in universe.filter(c.has(F.col("key"))).collect()}
    assert got == set(listed[:200]) and len(c.levels) > 1 and len(c.levels[0].bits) <= c.levels[0].size / 7 + 1


def test_longer_lists_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "CHUNK", 7)
    rules = [(f"h{i % 10}.com", "/" + "x" * (i % 4), "block" if i % 3 else "allow") for i in range(40)]
    pages = [(i, f"http://{'s.' * (i % 3)}h{i % 13}.com/{'x' * (i % 5)}") for i in range(80)]
    got = url_filter.url_verdicts(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(rules, "host string, path string, verdict string")).collect()
    assert sorted(tuple(r) for r in got) == sorted((i, *verdict_of(u, rules)) for i, u in pages) and {r["verdict"] for r in got} == {"allow", "block"}


def verdict_of(url, rules):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (lower(m[1]), m[2]) if m else ("", "")
    fit = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best and best[2], best[3] if best else "allow"


def test_urls(spark):
    urls = [None, "", "no scheme", "http://EXAMPLE.com/en/745?x=/y", "https://a.b.example.com/en/8#z", "http://com/en/", "http://xcom/en/", "http://example.net/de/81", "http://example.net/de/7", "http://org?/es/", "http://x.org/es/é", "a://b://c.com/en/", "http://com", "://net/de/"]
    pages = spark.createDataFrame([(i, u, 3) for i, u in enumerate(urls)] + [(None, "http://com/en/", 3)] * 2, "page_id long, url string, keys int")
    rules = spark.createDataFrame(url_filter.QUERY_RULES, "host string, path string, verdict string")
    got = [tuple(r) for r in url_filter.url_verdicts(pages, rules).collect()]
    want = []
    for i, u in [*enumerate(urls), (None, "http://com/en/"), (None, "http://com/en/")]:
        want.append((i, *verdict_of(u, url_filter.QUERY_RULES)))
    assert sorted(got, key=str) == sorted(want, key=str)
    assert url_filter.url_verdicts(pages, rules.filter("false")).filter("verdict <> 'allow' or rule is not null").isEmpty()
    assert url_filter.url_verdicts(pages.filter("false"), rules).collect() == []


# language model


def test_gradients():
    v = recurrent_lm.vocabulary([(i * 7919 + 3, 100 - i) for i in range(60)], 8000, 500)
    w = {k: x.astype(float) for k, x in recurrent_lm.start_weights(v).items()}
    rng = np.random.default_rng(0)
    inputs, targets = rng.integers(0, v.size + 20, (3, 6)), rng.integers(-1, v.size + 1, (3, 6))

    def mean(w):
        table, h, out = w["E"] @ w["Wx"] + w["b"], np.zeros((3, recurrent_lm.HIDDEN)), 0.0
        for t in range(6):
            h, _ = recurrent_lm.step(w, table[inputs[:, t]], h)
            live = targets[:, t] >= 0
            out += recurrent_lm.log_probs(w, v, h[live], targets[live, t]).sum()
        return out / (targets >= 0).sum()

    trainer = recurrent_lm.Trainer(w, v, 0.0)
    trainer.batch(inputs, targets)
    for k in w:
        at = tuple(rng.integers(0, d) for d in w[k].shape) if k != "E" else (int(inputs[0, 0]), 3)
        up, down = ({**w, k: w[k].copy()} for _ in range(2))
        up[k][at] += 1e-5
        down[k][at] -= 1e-5
        assert abs((mean(up) - mean(down)) / 2e-5 + trainer.m[k][0][at] / 0.1) < 1e-5, k


def test_probabilities_sum_to_one_and_state_is_carried():
    v = recurrent_lm.vocabulary([(i + 1, 50 - i) for i in range(20)], 1000, 90)
    w = recurrent_lm.start_weights(v)
    h = np.random.default_rng(0).normal(size=(4, recurrent_lm.HIDDEN)).astype(np.float32)
    total = sum(np.exp(recurrent_lm.log_probs(w, v, h, np.full(4, i))) for i in range(v.size + 1))
    assert np.allclose(total, 1, atol=1e-5)
    rng = np.random.default_rng(1)
    n = [1, 100, 33, 64]
    first = np.concatenate([[0], np.cumsum(n)])
    ids = rng.integers(0, v.size + 1, first[-1])
    together = recurrent_lm.score(w, v, ids, ids, first)
    for d in range(4):
        one = ids[first[d] : first[d + 1]]
        assert np.isclose(recurrent_lm.score(w, v, one, one, np.array([0, len(one)]))[0], together[d], rtol=1e-4)
        state, out = np.zeros((1, recurrent_lm.HIDDEN), np.float32), 0.0
        for t in range(len(one)):
            state, _ = recurrent_lm.step(w, (w["E"] @ w["Wx"] + w["b"])[[one[t - 1] if t else v.size]], state)
            out += recurrent_lm.log_probs(w, v, state, one[[t]])[0]
        assert np.isclose(out, together[d], rtol=1e-4)


def test_training_takes_every_window_and_carries_the_state():
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(["a", "b", "c", "d"], int(n))) for n in [*rng.integers(0, 150, 40), 900]]
    v = recurrent_lm.vocabulary([(int(x), 50 - i) for i, x in enumerate(np.unique(recurrent_lm.tokens(*column_bytes(texts))[0]).view(np.int64))], 1000, 9)

    class Seen(recurrent_lm.Trainer):
        docs, open_docs = [], {}

        def batch(self, inputs, targets, before=None):
            assert len(inputs) <= 3
            after = np.zeros((len(inputs), recurrent_lm.HIDDEN), np.float32)
            for i, (x, y) in enumerate(zip(inputs, targets, strict=True)):
                key = float(before[i, 0])
                assert (x[0] == v.size) == (key == 0)  # an empty state exactly where a document begins
                doc = self.open_docs.pop(key, [])
                doc.extend(y[y >= 0].tolist())
                self.t += 1
                after[i] = self.t
                (self.docs.append(doc) if doc[-1] == end else self.open_docs.update({float(self.t): doc}))
            return after

    h, first = recurrent_lm.tokens(*column_bytes(texts))
    ids = v.id_of(h)
    end = int(ids[-1])
    trainer = Seen(recurrent_lm.start_weights(v), v, 0.01, 3)
    recurrent_lm.train_on(trainer, [pa.array(texts[:17]), pa.array(texts[17:])])
    assert not trainer.open_docs and sorted(trainer.docs) == sorted(ids[a:b].tolist() for a, b in itertools.pairwise(first))


def column_bytes(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])])


def test_lm_counts_and_gain(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text", "lang").limit(300).unionByName(spark.createDataFrame([(None, None, "x"), (10**9, "", "w"), (10**9, "", "w")], "doc_id long, text string, lang string"))
    docs = spark.createDataFrame(docs.collect(), docs.schema)
    texts = [(r["doc_id"], WORD.findall(lower(r["text"] or "")) + [None]) for r in docs.collect()]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    c = Counter(x for i, t in texts if not held(i) for x in t)
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), held(i), len(t), sum(c[x] > 0 for x in t), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in t), 4)) for i, t in texts)
    got = recurrent_lm.lm_scores(docs).collect()
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in got) == want
    out = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out) and all(r["score"] < 0 for r in got)
    assert recurrent_lm.lm_scores(docs.filter("false")).collect() == []


def test_lm_score_of_the_query_step_by_step(spark, monkeypatch):
    """The query's score column against one token at a time in plain Python, from the counts of the training words up."""
    rng = np.random.default_rng(12)
    docs = [(i, " ".join(rng.choice([f"w{int(k)}" for k in rng.zipf(1.4, 40) % 60], int(rng.integers(0, 80))))) for i in range(60)] + [(None, None), (99, "Never seen")]
    monkeypatch.setattr(recurrent_lm, "TOP", 20)
    kept = {}

    def start(docs, v, **_):
        kept["v"], kept["w"] = v, {k: (x + rng.normal(0, 0.3, x.shape)).astype(np.float32) for k, x in recurrent_lm.start_weights(v).items()}
        return kept["w"]

    monkeypatch.setattr(recurrent_lm, "train", start)
    got = {r["doc_id"]: r["score"] for r in recurrent_lm.lm_scores(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    v, w = kept["v"], {k: x.astype(float) for k, x in kept["w"].items()}
    split = {i: [*WORD.findall(lower(t or "")), None] for i, t in docs}
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    c = Counter(x for i, t in split.items() if not held(i) for x in t)
    hash_of = lambda x: recurrent_lm.END if x is None else recurrent_lm.tokens(*column_bytes([x]))[0][0]
    place = {int(h): int(i) for h, i in zip(v.hashes, v.ids, strict=True)}
    tail = sum(n for x, n in c.items() if int(hash_of(x)) not in place)
    tail_words = len(c) - v.size
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    n = recurrent_lm.HIDDEN
    soft = lambda x: x - x.max() - math.log(np.exp(x - x.max()).sum())
    for i, words in split.items():
        h, total, last = np.zeros(n), 0.0, v.size
        for x in words:
            a, b = w["E"][last] @ w["Wx"] + w["b"], h @ w["Wh"]
            z, r = sigmoid(a[:n] + b[:n]), sigmoid(a[n : 2 * n] + b[n : 2 * n])
            h = (1 - z) * np.tanh(a[2 * n :] + r * b[2 * n :]) + z * h
            classes = soft(h @ w["C"] + w["cb"])
            word = int(hash_of(x))
            if word in place:
                k = place[word]
                cls = max(j for j in range(len(v.bound) - 1) if v.bound[j] <= k)
                first, after = v.bound[cls], v.bound[cls + 1]
                total += classes[cls] + soft(h @ w["W"][first:after].T + w["wb"][first:after])[k - first]
                last = k
            else:
                total += classes[-1] + math.log((c[x] + 1) / (tail + tail_words + 1))
                last = v.size + 1 + (word >> 20) % recurrent_lm.TAIL_INPUTS
        assert math.isclose(got[i], total / math.log(10), rel_tol=1e-4), i


def test_lm_without_training_documents(spark):
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2]
    got = recurrent_lm.lm_scores(spark.createDataFrame([(i, "a b c") for i in held], "doc_id long, text string")).collect()
    assert all(r["held_out"] and r["n_tokens"] == 4 and r["n_known"] == 0 and r["train_tokens"] == 0 and r["base_score"] == 0 and math.isfinite(r["score"]) and r["score"] <= 0 for r in got) and len(got) == len(held)


# decontamination


def test_masks_never_miss():
    for n in range(decontamination.MIN_WORDS, decontamination.WINDOW + 1):
        k = n - -(-n * decontamination.PERCENT // 100)
        for c in itertools.combinations(range(n), k):
            same = [i not in c for i in range(n)]
            assert any(all(same[i + j] for j, x in enumerate(m) if x == "1") for m in decontamination.MASKS for i in range(n - len(m) + 1))


def contamination(docs, items, window=13, percent=80):
    """Covered words by document and item, over every alignment."""
    split = lambda t: re.findall(r"(?:[a-zA-Z0-9]|[^\x00-\x7f])+", lower(t or ""))
    out = []
    for t in docs:
        a, hit = split(t), {}
        for k, x in items:
            x = split(x)
            n, share = min(window, len(x)), percent if len(x) >= 8 else 100
            for s in range(-(len(x) - n), len(a) - n + 1) if len(x) >= 5 else []:
                i, j = max(0, -s), min(len(x), len(a) - s)
                same = [a[i + s + q] == x[i + q] for q in range(j - i)]
                for q in range(j - i - n + 1):
                    if 100 * sum(same[q : q + n]) >= share * n:
                        hit.setdefault(k, set()).update(range(i + s + q, i + s + q + n))
        out.append(hit)
    return out


def covered(overlaps):
    got = {}
    for o in overlaps:
        got.setdefault(o["item_id"], set()).update(range(o["first"], o["after"]))
    return got


def test_decontamination(spark):
    rng = np.random.default_rng(6)
    vocab = [f"t{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(vocab, int(rng.integers(3, 40))))) for i in range(25)] + [(25, None), (26, "")]
    docs = [None, "", "t1"]
    for i in range(60):
        words = list(rng.choice(vocab, int(rng.integers(10, 120))))
        x = (items[i % 25][1]).split()
        x = [("changed" if rng.random() < (i % 4) * 0.1 else w).capitalize() for w in x[int(rng.integers(0, 5)) :]]
        words[5:5] = x
        docs.append(", ".join(words))
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(docs)], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: r for r in decontamination.contaminated(df, bench).collect()}
    want = contamination(docs, [(k, x) for k, x in items if x])
    assert [covered(got[i]["overlaps"]) for i in range(len(docs))] == want and any(want)
    assert [got[i]["item_ids"] for i in range(len(docs))] == [sorted(w) for w in want]
    assert all(r["contaminated"] == bool(r["item_ids"]) for r in got.values())
    kept = decontamination.without_contaminated(df, bench)
    assert kept.schema == df.schema and {r["doc_id"] for r in kept.collect()} == {i for i, w in enumerate(want) if not w}
    assert decontamination.contaminated(df, bench.filter("false")).filter("contaminated").isEmpty() and decontamination.contaminated(df.filter("false"), bench).collect() == []


def test_decontamination_in_several_tables(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "SIDE_BYTES", 100)
    bench = spark.createDataFrame([(i, " ".join(f"q{i}x{k}" for k in range(12))) for i in range(8)], "item_id long, text string")
    assert len(list(decontamination.item_tables(bench, "item_id", "text"))) > 1
    df = spark.createDataFrame([(i, f"some words and {' '.join(f'q{i}x{k}' for k in range(12))} more") for i in range(8)], "doc_id long, text string")
    assert sorted((r["doc_id"], r["item_ids"]) for r in decontamination.contaminated(df, bench).collect()) == [(i, [i]) for i in range(8)]
    clean = spark.createDataFrame([(99, "nothing of the kind")], "doc_id long, text string")
    assert [r["doc_id"] for r in decontamination.without_contaminated(df.unionByName(clean), bench).collect()] == [99]


def test_decontamination_of_repetitive_texts():
    rng = np.random.default_rng(9)
    items = ["a " * 40, "a b " * 15, "b a a " * 9, " ".join(rng.choice(["a", "b"], 30)), "c " * 6, "c d e f g", "a a a a"]
    docs = ["a " * 90, "a b " * 50, "x " + "b a a " * 20 + "y", " ".join(rng.choice(["a", "b"], 150)), "c " * 5, "c " * 7, "q c d e f g q", "c d e f x g", " ".join(rng.choice(["a", "b", "c"], 200))]
    for block in (1, 50, 1 << 20):
        before = decontamination.BLOCK_HITS, decontamination.BLOCK_WORDS
        decontamination.BLOCK_HITS = decontamination.BLOCK_WORDS = block
        try:
            table = decontamination.Items(pa.array(items))
            _, _, first, h = decontamination.plain_words(*column_bytes(docs))
            got = [{} for _ in docs]
            for d, k, x, y, n in table.overlaps(h, first, 13, 80).T.tolist():
                at = got[d].setdefault(k, set())
                assert not at & set(range(x, y)) and 0 < n <= y - x
                at.update(range(x, y))
        finally:
            decontamination.BLOCK_HITS, decontamination.BLOCK_WORDS = before
        assert got == contamination(docs, list(enumerate(items)))


def test_decontamination_of_a_very_long_text():
    """Very many equal words against an item of the same word: one hit an alignment, and bounded blocks."""
    import tracemalloc

    table = decontamination.Items(pa.array(["a " * 500]))
    _, _, first, h = decontamination.plain_words(*column_bytes(["b " + "a " * 200_000]))
    tracemalloc.start()
    assert table.overlaps(h, first, 13, 80).T.tolist() == [[0, 0, 0, 200_001, 500]]
    assert tracemalloc.get_traced_memory()[1] < 400_000_000
    tracemalloc.stop()


def test_decontamination_ids_and_clashing_columns(spark, monkeypatch):
    passage = " ".join(f"z{i}" for i in range(20))
    rows = [("p", passage, 1, 2, 3), (None, f"so {passage} it goes", 1, 2, 3), ("q", "clean", 1, 2, 3), ("q", None, 1, 2, 3), ("r", passage, 4, 5, 6)]
    df = spark.createDataFrame(rows, "doc_id string, text string, t1 int, overlaps int, row int")
    bench = spark.createDataFrame([(None, passage), ("it", passage), ("other", "not there " * 30)], "item_id string, text string")
    for limit in (8 << 20, 100):
        monkeypatch.setattr(decontamination, "SIDE_BYTES", limit)
        got = sorted((str(r["doc_id"]), r["contaminated"], r["item_ids"]) for r in decontamination.contaminated(df, bench).collect())
        assert got == [("None", True, ["it", None]), ("p", True, ["it", None]), ("q", False, []), ("q", False, []), ("r", True, ["it", None])]
        kept = decontamination.without_contaminated(df, bench)
        assert kept.schema == df.schema and sorted(str(r["text"]) for r in kept.collect()) == ["None", "clean"]


def test_sql_oracles(spark):
    from tidelog.llm import queries

    c = duckdb.connect()
    for t in ("documents", "pages"):
        c.sql(f"create view {t} as select * from '/root/testdata/sf0.001/{t}.parquet'")
    for name, sql in queries.oracle_sql().items():
        df, want = queries.queries()[name](spark, "/root/testdata/sf0.001"), c.sql(sql)
        names = sorted(df.columns)
        assert sorted(want.columns) == names
        at = [want.columns.index(x) for x in names]
        assert sorted((tuple(r[x] for x in names) for r in df.collect()), key=repr) == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=repr), name
    assert len(queries.queries()) == 10
