"""Packing, token tables and the pipeline."""

import io
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelog.llm import packing, sstable

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("sizes", [(512, 1024, 2048, 4096), (100,), (64, 100)])
def test_pack(sizes):
    rng = np.random.default_rng(0)
    for _ in range(80):
        n = rng.integers(0, max(sizes) + 1, rng.integers(0, 60))
        of, at, bins = packing.pack(n, sizes)
        taken = [np.zeros(b, int) for b in bins]
        for k in range(len(n)):
            taken[of[k]][at[k] : at[k] + n[k]] += 1
        assert all((t <= 1).all() for t in taken) and sum(t.sum() for t in taken) == n.sum()
        assert all(min(c for c in sizes if c >= t.sum()) == b for t, b in zip(taken, bins, strict=True))
        # best fit leaves no two bins that could be one of the largest size, but for the smallest pair
        fill = sorted(int(t.sum()) for t in taken)
        assert len(bins) <= 2 * max(1, -(-int(n.sum()) // min(sizes)))
        if len(sizes) == 1 and len(fill) > 1:
            assert fill[0] + fill[1] > sizes[0]


def cost(bins, sizes=packing.SIZES):
    costs = packing.costs_of(sizes)
    return sum(costs[b] for b in bins)


def single(n, size, sizes=packing.SIZES):
    """Cost of best fit with one size, downsized."""
    costs, left = packing.costs_of(sizes), []
    for x in sorted(n.tolist(), reverse=True):
        fits = [b for b in left if b[0] >= x]
        if fits:
            min(fits)[0] -= x
        else:
            left.append([max(size, min(c for c in sizes if c >= x)) - x, max(size, min(c for c in sizes if c >= x))])
    return sum(min(costs[c] for c in sizes if c >= size - free) for free, size in left)


def test_sizes_are_chosen_jointly():
    n = np.array([300] * 3 + [4096] + [100])
    _, _, bins = packing.pack(n)
    assert sorted(bins) == [1024, 4096]
    # seven of 520 fill 4096 best, one of 1000 fills 1024
    _, _, bins = packing.pack(np.array([520] * 70 + [1000] * 5))
    assert bins.count(4096) >= 9 and bins.count(1024) >= 5 and cost(bins) <= 1.02 * cost([1024] * 5 + [4096] * 10)
    rng = np.random.default_rng(3)
    for n in (np.minimum(4096, rng.lognormal(6, 1, 4000).astype(np.int64) + 1), rng.choice([520, 700, 1300, 1400, 2100, 30], 2000), rng.integers(1, 900, 3000)):
        _, _, bins = packing.pack(n)
        assert cost(bins) < single(n, 4096) and all(cost(bins) <= single(n, s) for s in packing.SIZES)


def test_pack_against_the_optimum():
    sizes = (10, 20, 40)
    costs = packing.costs_of(sizes, 2, 100)

    def optimum(n):
        """Every partition of the pieces into bins."""
        best = [float("inf")]

        def place(i, bins):
            if i == len(n):
                best[0] = min(best[0], sum(min(costs[c] for c in sizes if c >= b) for b in bins))
                return
            for k in range(len(bins)):
                if bins[k] + n[i] <= max(sizes):
                    place(i + 1, [*bins[:k], bins[k] + n[i], *bins[k + 1 :]])
            place(i + 1, [*bins, n[i]])

        place(0, [])
        return best[0]

    rng = np.random.default_rng(8)
    ratios = []
    for _ in range(40):
        n = rng.integers(1, 41, int(rng.integers(1, 8)))
        _, _, bins = packing.pack(n, sizes, 2, 100)
        ratios.append(sum(costs[b] for b in bins) / optimum(n.tolist()))
    assert min(ratios) >= 1 - 1e-9 and max(ratios) < 1.2 and sum(r < 1 + 1e-9 for r in ratios) >= 32


def test_best_fit_loses_nothing(spark):
    texts = [None, "", "a b", "w " * 9000, *[f"{'x ' * (i * 37 % 700)}" for i in range(60)]]
    rows = [(i, t, 5, 6) for i, t in enumerate(texts)] + [(None, "a b", 5, 6), (7, "c", 5, 6), (7, "c", 5, 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int, bin_id int")
    out = packing.best_fit(df).collect()
    length = {}
    for r in out:
        length[r["doc_id"]] = length.get(r["doc_id"], 0) + r["after"] - r["first"]
        assert r["bin_offset"] + r["after"] - r["first"] <= r["bin_size"]
    want = {}
    for i, t, _, _ in rows:
        want[i] = want.get(i, 0) + len(WORD.findall(t or "")) + 1
    assert length == want
    used = {}
    for r in out:
        used.setdefault(r["bin_id"], []).append((r["bin_offset"], r["bin_offset"] + r["after"] - r["first"]))
    assert all(a[1] <= b[0] for spans in used.values() for a, b in zip(sorted(spans), sorted(spans)[1:]))
    assert sorted((r["piece"], r["first"], r["after"]) for r in out if r["doc_id"] == 3) == [(0, 0, 4096), (1, 4096, 8192), (2, 8192, 9001)]
    assert packing.best_fit(df.filter("false")).collect() == []
    odd = spark.createDataFrame([(1, -5), (2, None), (3, 0), (3, 30_000_000)], "doc_id long, n int")
    out = packing.best_fit(odd, length=F.col("n")).collect()
    assert sum(r["after"] - r["first"] for r in out) == 30_000_000 and {r["doc_id"] for r in out} == {1, 2, 3} and all(r["after"] == 0 for r in out if r["doc_id"] < 3)


def table(entries):
    f = io.BytesIO()
    w = sstable.Writer(f)
    for k, v in entries:
        w.add(k, v)
    w.close()
    return sstable.Reader(f)


def test_table_round_trip_and_lookup(monkeypatch):
    monkeypatch.setattr(sstable, "BLOCK_BYTES", 200)
    rng = np.random.default_rng(1)
    ids = sorted([None, None, *map(int, rng.integers(-(2**62), 2**62, 300)), -1, 0, 1, 5, 5, 5], key=lambda x: (x is not None, x or 0))
    entries = [(sstable.key_of(i), rng.integers(0, 60000, int(rng.integers(0, 90))).astype("<u2").tobytes()) for i in ids]
    t = table(entries)
    assert list(t) == entries and t.entries == len(ids) and len(t.blocks) > 10 and [sstable.id_of(k) for k, _ in t] == ids
    for i in {*ids}:
        assert t.get(sstable.key_of(i)) == [v for k, v in entries if k == sstable.key_of(i)]
    absent = [i for i in range(1000, 3000)]
    assert all(t.get(sstable.key_of(i)) == [] for i in absent) and sum(t.may_have(sstable.key_of(i)) for i in absent) < 60
    assert list(table([])) == [] and table([]).get(b"\1") == []
    with pytest.raises(ValueError):
        table([(b"b", b""), (b"a", b"")])
    with pytest.raises(ValueError):
        sstable.Reader(io.BytesIO(b"x" * 200))


def test_encoder_is_the_tokenizer(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(sstable, "CACHE_WORDS", 500)
    t = Tokenizer.from_file(sstable.default_tokenizer())
    t.encode_special_tokens = True
    rng = np.random.default_rng(3)
    letters = list("ab '\n\t 　é1,.<|>sd\0\r")
    texts = ["".join(rng.choice(letters, int(rng.integers(0, 30)))) for _ in range(4000)]
    texts += ["<|endoftext|> x", "word, Word. w.. é. 1. a1, " + "long" * 30 + ". end", "", " ", "\n", "a\n\n\nb", "a  b   c", " ".join(f"w{chr(97 + i % 26)}x." for i in range(900))]
    e = sstable.Encoder(sstable.default_tokenizer())
    want = [np.array(x.ids, "<u2").tobytes() for x in t.encode_batch(texts, add_special_tokens=False)]
    for i in range(0, len(texts), 64):
        assert e.encode(texts[i : i + 64]) == want[i : i + 64]
    assert e.encode(texts) == want


def test_ids_written_and_read(spark, tmp_path):
    from tokenizers import Tokenizer

    texts = [(3, "Hello there, world."), (-5, None), (9, ""), (None, "no id"), (7, "same"), (7, "same"), (1, "line\nline"), (2, "x" * 5000)]
    df = spark.createDataFrame([(i, t, 1) for i, t in texts], "doc_id long, text string, start int")
    files = sstable.write_ids(df, f"{tmp_path}/sst").collect()
    assert all(f["path"].startswith("file:/") for f in files)
    assert sum(f["entries"] for f in files) == len(texts)
    t = Tokenizer.from_file(sstable.default_tokenizer())
    at, want = 0, []
    for i, x in sorted(texts, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 0]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        at += len(ids)
    got = [tuple(r) for r in sstable.read_ids(spark.createDataFrame(files), tokens=True).collect()]
    assert sorted(got, key=lambda r: r[1]) == want
    assert sum(len(sstable.open_table(f["path"]).get(sstable.key_of(7))) for f in files) == 2
    assert sstable.token_ids(df.filter("false")).collect() == []
    with pytest.raises(Exception, match="s3|S3|hdfs|region|resolve"):
        sstable.open_table("s3a://no-such-bucket-here/x")  # the scheme is known, the store isn't there


def test_one_id_of_many_rows_is_split_over_files(spark, tmp_path):
    rows = [(5, "same text")] * 3000 + [(None, f"t {i % 7}") for i in range(500)] + [(i, "x") for i in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    files = sstable.write_ids(df, f"file://{tmp_path}/hot").collect()
    assert len(files) == 4 and max(f["entries"] for f in files) < 1800
    got = sstable.token_ids(df, f"file://{tmp_path}/again").collect()
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in got) == sorted((i is not None, i or 0) for i, _ in rows)
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    by_start = [(r["doc_id"] is not None, r["doc_id"] or 0) for r in sorted(got, key=lambda r: r["start"])]
    assert by_start == sorted(by_start)


def test_files_of_lost_attempts_go(spark, tmp_path):
    folder = tmp_path / "sst"
    folder.mkdir()
    (folder / "part-000000-lost.sst").write_bytes(b"half")
    got = sstable.token_ids(spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string"), f"file://{folder}").collect()
    assert len(got) == 2 and not (folder / "part-000000-lost.sst").exists() and list(folder.glob("*.sst"))


def test_pipeline(spark):
    import corpus_pipeline as c

    from tidelog.llm import decontamination, ngram_join, substring_dedup, toxicity

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels, bench = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("labels", "benchmark"))
    ids = lambda df: sorted(r["doc_id"] for r in df.collect())
    one = c.STAGES[0][1](spark, docs, folder)
    assert ids(one) == sorted(r["doc_id"] for r in toxicity.toxicity(docs, labels).filter("predicted = 0").collect())
    two = c.STAGES[1][1](spark, one, folder)
    groups = ngram_join.ngram_components(one).collect()
    assert ids(two) == sorted({r["component_id"] for r in groups if r["n_shingles"]} | {r["doc_id"] for r in groups if not r["n_shingles"]})
    three = c.STAGES[2][1](spark, two, folder)
    removed = {r["doc_id"]: r["n_removed"] for r in substring_dedup.substring_dedup(two).collect()}
    before = {r["doc_id"]: r["text"] for r in two.collect()}
    assert ids(three) == ids(two) and all((r["text"] == before[r["doc_id"]]) == (removed[r["doc_id"]] == 0) for r in three.collect())
    assert three.select("text", "n_chars").filter("length(text) <> n_chars").isEmpty() and three.schema == docs.schema
    four = c.STAGES[3][1](spark, three, folder)
    assert ids(four) == sorted(r["doc_id"] for r in decontamination.contaminated(three, bench).filter("not contaminated").collect())
    whole = c.run(spark, folder).collect()
    assert sorted({r["doc_id"] for r in whole}) == ids(four) and [n for n, _ in c.STAGES] == ["toxicity", "ngram_jaccard", "substring", "decontamination", "packing"]
