"""Substring, suffix and n-gram operators against brute force, on small tables with every kind of trouble."""

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tidelog.llm import common, ngram_join, substring_dedup, suffix_dedup
from tidelog.llm import textnp as tn

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, id string, shard int, seed long, row int, n long, _is_doc boolean"


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def corpus(seed=0):
    rng = np.random.default_rng(seed)
    vocab = [f"w{i}" for i in range(40)] + ["été", "naïve,", "Ünï", "日本"]
    passage = " ".join(rng.choice(vocab, 60))
    texts = [None, "", "   \t\n ", "one", passage, passage, "A b " * 60, "x" * 700, "x" * 400 + "y", passage.replace("w1", "W1")]
    for i in range(30):
        body = list(rng.choice(vocab, int(rng.integers(1, 150))))
        if i % 3 == 0:
            at = int(rng.integers(0, len(body) + 1))
            body[at:at] = passage.split()[: int(rng.integers(20, 61))]
        texts.append(rng.choice([" ", "\n", "  "]).join(body))
    texts += texts[10:16] + [" ".join([*t.split()[:-3], "new"]) for t in texts[16:26]]
    texts.append(" ".join(rng.choice(vocab, 6000)))
    return texts


@pytest.fixture(scope="module")
def texts():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, texts):
    """The texts under ascending ids, with columns of all names that the operators use inside."""
    return spark.createDataFrame([(i, t, "x", 7, 8, 9, 10, True) for i, t in enumerate(texts)], SCHEMA).repartition(3)


def words_removed(texts, w):
    count = Counter()
    split = [WORD.findall(t or "") for t in texts]
    for s in split:
        count.update(tuple(s[i : i + w]) for i in range(len(s) - w + 1))
    out = []
    for s in split:
        gone = [False] * len(s)
        for i in range(len(s) - w + 1):
            if count[tuple(s[i : i + w])] > 1:
                gone[i : i + w] = [True] * w
        kept = " ".join(x for x, g in zip(s, gone) if not g)
        out.append((len(s), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return out


@pytest.mark.parametrize("window", [35, 5, 1])
def test_substring(docs, texts, window):
    got = {r["doc_id"]: r for r in substring_dedup.substring_dedup(docs, window=window, texts=True).collect()}
    for i, (n, removed, sha, kept) in enumerate(words_removed(texts, window)):
        r = got[i]
        assert (r["n_words"], r["n_removed"], r["kept_sha256"]) == (n, removed, sha)
        assert r["kept_text"] == (kept if removed else None) and sum(s["after"] - s["first"] for s in r["removed"]) == removed


def test_substring_stage_keeps_rows(docs, texts):
    out = substring_dedup.without_repeats(docs, size_col="n")
    assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
    got = {r["doc_id"]: r for r in out.collect()}
    for i, (_, removed, _, kept) in enumerate(words_removed(texts, 35)):
        assert got[i]["text"] == (kept if removed else texts[i]) and got[i]["n"] == (len(kept) if removed else 10) and got[i]["seed"] == 8


def bytes_removed(texts, w):
    count = Counter()
    raw = [(t or "").encode() for t in texts]
    for s in raw:
        count.update(s[i : i + w] for i in range(len(s) - w + 1))
    out = []
    for s in raw:
        gone = np.zeros(len(s) + 1, bool)
        for i in range(len(s) - w + 1):
            if count[s[i : i + w]] > 1:
                gone[i : i + w] = True
        gone = gone[: len(s)]
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(s), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(s, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


@pytest.mark.parametrize(("length", "hot", "levels"), [(200, 2000, 1), (30, 3, 1), (30, 2, 0), (1, 2000, 1)])
def test_suffix(docs, texts, length, hot, levels, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT_ROWS", hot)
    monkeypatch.setattr(suffix_dedup, "LEVELS", levels)
    got = {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.suffix_dedup(docs, length=length).collect()}
    assert [got[i] for i in range(len(texts))] == bytes_removed(texts, length)


def later_bytes_removed(texts, w):
    seen, out = set(), []
    for t in texts:
        s = (t or "").encode()
        gone = np.zeros(len(s) + 1, bool)
        for i in range(len(s) - w + 1):
            if s[i : i + w] in seen:
                gone[i : i + w] = True
            seen.add(s[i : i + w])
        gone = gone[: len(s)]
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(s), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(s, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


@pytest.mark.parametrize(("length", "hot", "levels"), [(200, 2000, 1), (30, 3, 1), (30, 2, 0), (30, 2, 2)])
def test_suffix_keeps_the_first(docs, texts, length, hot, levels, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT_ROWS", hot)
    monkeypatch.setattr(suffix_dedup, "LEVELS", levels)
    got = {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.suffix_dedup(docs, length=length, keep_first=True).collect()}
    assert [got[i] for i in range(len(texts))] == later_bytes_removed(texts, length)


def test_suffix_keeps_one_of_equal_rows(spark):
    rows = [(7, "q " * 60), (7, "q " * 60), (3, "first " + "r" * 80), (None, "r" * 80), (9, "r" * 80 + " more")]
    got = suffix_dedup.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string"), length=50, keep_first=True).collect()
    ordered = sorted(rows, key=lambda r: (r[0] is None, r[0]))
    assert sorted((str(r["doc_id"]), r["n_removed"]) for r in got) == sorted((str(i), x[1]) for (i, _), x in zip(ordered, later_bytes_removed([t for _, t in ordered], 50)))


def test_previous_factors():
    rng = np.random.default_rng(1)
    for _ in range(60):
        t, cap = rng.integers(0, 3, rng.integers(1, 80)).astype(np.uint8), int(rng.integers(1, 20))
        ends = np.unique([*rng.integers(1, len(t) + 1, 2), len(t)])
        room = np.array([ends[np.searchsorted(ends, i, "right")] - i for i in range(len(t))])
        starts = np.flatnonzero(room >= cap)
        longest, source = suffix_dedup.previous_factors(t, room, starts, cap)
        for k, i in enumerate(starts):
            same = lambda j, i=i: next((x for x in range(cap) if t[i + x] != t[j + x]), cap)
            best = max((same(j) for j in starts[starts < i]), default=0)
            assert longest[k] == best and (best == 0 or source[k] < i and same(source[k]) >= best)


def components_of(texts, words=5, percent=80):
    sets = []
    for t in texts:
        w = WORD.findall(lower(t or ""))
        sets.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set())
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


@pytest.mark.parametrize(("block", "percent"), [(1024, 80), (2, 80), (1024, 50), (3, 34)])
def test_ngram(docs, texts, block, percent, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    got = {r["doc_id"]: tuple(r)[1:] for r in ngram_join.ngram_components(docs, percent=percent).collect()}
    assert [got[i] for i in range(len(texts))] == components_of(texts, percent=percent)


def test_ngram_chain_of_links(spark):
    """Each text is linked with the next one only; the component is the whole chain."""
    base = [f"a{i}" for i in range(60)]
    chain = []
    for step in range(12):
        chain.append(" ".join([f"b{i}" if i < 2 * step else base[i] for i in range(60)]))
    df = spark.createDataFrame(list(enumerate(chain)), "doc_id long, text string")
    got = sorted(tuple(r) for r in ngram_join.ngram_components(df).collect())
    assert [(n, c) for _, n, c in got] == components_of(chain) and len({c for _, _, c in got}) == 1


def test_one_of_each(spark, docs, texts):
    kept = {r["doc_id"] for r in ngram_join.one_of_each(docs).collect()}
    want = components_of(texts)
    assert kept == {i for i, (n, c) in enumerate(want) if n == 0 or c == i}
    twice = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (1, "q r s t u v"), (2, "a b c d e f"), (None, "only here is this text"), (None, None)], "doc_id long, text string")
    assert sorted((str(r[0]), r[1] or "") for r in ngram_join.one_of_each(twice).collect()) == [("1", "a b c d e f"), ("1", "q r s t u v"), ("None", ""), ("None", "only here is this text")]


def test_one_of_each_decides_by_row(spark, monkeypatch):
    base = [f"c{i}" for i in range(60)]
    near = lambda k, word: " ".join([*base[:k], word, *base[k + 1 :]])
    alone = lambda x: " ".join(f"{x}{i}" for i in range(30))
    one, other = [" ".join(f"{p}{i}" for i in range(50)) for p in ("m", "n")]
    rows = [
        (3, near(2, "x")), (None, near(4, "y")), (5, near(59, "z")),  # one group, its copies under a null id and id 5
        (None, alone("p")), (None, alone("q")), (5, alone("r")),  # texts of their own under the same ids
        (7, one), (7, one + " end"), (None, other), (None, other + " end"), (None, other + " end"),  # groups that share one id, or have none
        (None, ""), (8, "  "), (8, None),
    ]
    df = spark.createDataFrame([(i, t, f"k{n}") for n, (i, t) in enumerate(rows)], "doc_id long, text string, kept string")
    for few in (True, False):
        monkeypatch.setattr(ngram_join, "small", lambda rows, width, few=few: few)
        out = ngram_join.one_of_each(df)
        assert out.schema == df.schema
        got = sorted((str(r["doc_id"]), r["text"] or "") for r in out.collect())
        single = [("3", near(2, "x")), ("None", alone("p")), ("None", alone("q")), ("5", alone("r")), ("None", ""), ("8", "  "), ("8", "")]
        assert [g for g in got if g[0] != "7" and not g[1].startswith("n0 ")] == sorted(single)
        assert len([g for g in got if g[0] == "7"]) == 1 and len([g for g in got if g[1].startswith("n0 ")]) == 1


def test_one_of_each_beside_any_column(spark):
    names = ["doc_id", "text", "_drop", "_drop_h1", "_twice", "h1", "h2", "n", "s1", "s2", "cls", "row"]
    rows = [(i, t, *range(10)) for i, t in [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (3, "g h i j k l")]]
    df = spark.createDataFrame(rows, ", ".join(f"{n} {'string' if n == 'text' else 'long'}" for n in names))
    out = ngram_join.one_of_each(df)
    assert out.schema == df.schema and sorted(r["doc_id"] for r in out.collect()) == [1, 3]


@pytest.mark.parametrize(("block", "shingles", "paired"), [(4, 1 << 20, 1), (1024, 200, 4), (4, 1 << 20, 99)])
def test_ngram_hot_bucket(spark, block, shingles, paired, monkeypatch):
    """A group of near copies of which many are linked with their origin only, beside one that is linked by a chain, in buckets of many blocks."""
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "BLOCK_SHINGLES", shingles)
    monkeypatch.setattr(ngram_join, "PAIRED", paired)
    rng = np.random.default_rng(5)
    base = [f"a{i}" for i in range(70)]

    def near(k):
        out = list(base)
        for at in rng.choice(70, k, replace=False):
            out[at] = f"x{rng.integers(10**9)}"
        return " ".join(out)

    rows = [near(int(k)) for k in rng.integers(0, 5, 60)] + [" ".join([*base[: 70 - 3 * k], *(f"c{i}" for i in range(3 * k))]) for k in range(12)]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r["doc_id"]: tuple(r)[1:] for r in ngram_join.ngram_components(df).collect()}
    assert [got[i] for i in range(len(rows))] == components_of(rows)


def test_blocks_against_each_other():
    rng = np.random.default_rng(7)
    base = rng.integers(0, 60, 30)
    sets = [np.unique(np.where(rng.random(30) < rng.random() * 0.2, rng.integers(0, 60, 30), base)).astype(np.uint64) for _ in range(24)]
    plain = [set(s.tolist()) for s in sets]
    full = {(i, j) for i in range(10) for j in range(14) if 100 * len(plain[i] & plain[10 + j]) >= 80 * len(plain[i] | plain[10 + j])}
    got = ngram_join.join_blocks(sets[:10], sets[10:])

    def roots(pairs):
        r = list(range(24))
        for _ in range(24):
            for i, j in pairs:
                r[i] = r[10 + j] = min(r[i], r[10 + j])
        return r

    assert set(got) <= full and full and len(got) < 24 and roots(got) == roots(full)
    one = ngram_join.join_blocks(sets[:10], sets[10:], connected=True)
    assert set(one) <= full and sorted(i for i, _ in one) == sorted({i for i, _ in full})


@pytest.mark.parametrize("how", ["inner", "left", "left_anti"])
def test_spread_join(spark, how, monkeypatch):
    left = spark.createDataFrame([(1, i) for i in range(50)] + [(2, i) for i in range(8)] + [(3, 0), (9, 1), (9, 2)], "k long, v long")
    right = spark.createDataFrame([(1, "a", 50), (2, "b", 8), (3, "c", 1), (4, "d", 0)], "k long, x string, c long")
    want = sorted(map(str, left.join(right.drop("c"), "k", how).collect()))
    for share, rows in ((10_000, 1000), (2, 1000), (2, 5)):
        monkeypatch.setattr(common, "HOT_SHARE", share)
        monkeypatch.setattr(common, "HOT_ROWS", rows)
        out = common.spread_join(left, right, ["k"], "c", how)
        assert sorted(map(str, out.collect())) == want and out.columns == (["k", "v"] if how == "left_anti" else ["k", "v", "x"])


def test_drawn(spark):
    rows = [(True, i * 7 % 101, "t" * (10 + i)) for i in range(101)] + [(True, 0, "t" * 10)] * 40 + [(False, i, None) for i in range(30)]
    df = spark.createDataFrame(rows, "kind boolean, lot long, text string")
    out = common.drawn(df, {True: 20, False: 4}, 500).collect()
    assert sum(len(r["text"] or "") for r in out) <= 500 and len({(r["kind"], r["lot"]) for r in out}) == len(out)
    assert sum(not r["kind"] for r in out) == 4 and 0 < sum(r["kind"] for r in out) <= 20
    assert common.drawn(df.filter("false"), {True: 5}, 10).collect() == []


def test_rows_of_equal_length_are_dealt_over_all_shards(spark):
    df = spark.range(20_000).selectExpr("cast(null as long) as doc_id", "lpad(cast(id as string), 9, '0') as text")
    counts = {r["shard"]: r["count"] for r in common.dealt(df, "doc_id", "text", 64).groupBy("shard").count().collect()}
    assert len(counts) == 64 and max(counts.values()) < 2 * 20_000 / 64


def test_trie_on_random_sets():
    rng = np.random.default_rng(0)
    for _ in range(150):
        base = rng.integers(0, 60, 30)
        sets = [np.unique(np.where(rng.random(30) < rng.random() * 0.2, rng.integers(0, 60, 30), base))[: int(rng.integers(1, 31))].astype(np.uint64) for _ in range(int(rng.integers(2, 14)))]
        edges = ngram_join.join_bucket([*sets, sets[0].copy()])
        plain = [set(s.tolist()) for s in [*sets, sets[0]]]
        n = len(plain)
        full = [(i, j) for i in range(n) for j in range(i) if 100 * len(plain[i] & plain[j]) >= 80 * len(plain[i] | plain[j])]

        def roots(pairs, n=n):
            r = list(range(n))
            for _ in range(n):
                for a, b in pairs:
                    r[a] = r[b] = min(r[a], r[b])
            return r

        assert roots(edges) == roots(full)


def test_nothing_and_null_ids(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    for run in (substring_dedup.substring_dedup, suffix_dedup.suffix_dedup, ngram_join.ngram_components, substring_dedup.without_repeats, ngram_join.one_of_each):
        assert run(empty).collect() == []
    odd = spark.createDataFrame([(None, "p " * 80), (None, None), (3, "p " * 80), (3, "p " * 80)], "doc_id long, text string")
    assert sorted(r["n_removed"] for r in substring_dedup.substring_dedup(odd).collect()) == [0, 80, 80, 80]
    assert sorted(r["n_removed"] for r in suffix_dedup.suffix_dedup(odd, length=50).collect()) == [0, 160, 160, 160]
    assert sorted(str(r["component_id"]) for r in ngram_join.ngram_components(odd).collect()) == ["3", "3", "3", "None"]


def test_slices_and_anchors():
    column = pa.array(["a b", None, "", "c" * 50, "d e f"])
    seen = [(lo, hi, bytes(d)) for lo, hi, d, _ in tn.texts(column, 10)]
    assert [s[:2] for s in seen] == [(0, 3), (3, 4), (4, 5)] and b"".join(s[2] for s in seen) == b"a b" + b"c" * 50 + b"d e f"
    rng = np.random.default_rng(2)
    h = tn.mix(rng.integers(0, 5, 200).astype(np.uint64))
    off = np.array([0, 0, 3, 90, 200])
    g = tn.gram_hash(h, 3)
    pos, first, last = tn.anchors(g, off, 10, 3)
    got = {s: p for p, a, z in zip(pos, first, last) for s in range(a, z + 1)}
    bits = int(off[-1]).bit_length()
    want = {}
    for a, z in zip(off[:-1], off[1:]):
        for s in range(a, z - 10 + 1):
            want[s] = min(range(s, s + 8), key=lambda i: (int(g[i]) >> bits, i))
    assert got == want


def test_scratch_folder(spark):
    assert common.scratch_root(spark).startswith("file:/")
