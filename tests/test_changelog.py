"""Change-log operators against step-by-step models."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tidelog.catalog import Catalog, Column, Table, TidelogError
from tidelog.operators import changelog, evolve, policies, shards, subscriptions, timers, views
from tidelog.operators.views import DELETE, INSERT, UPDATE

LEGAL = {None: (INSERT, UPDATE, DELETE), INSERT: (UPDATE, DELETE), UPDATE: (UPDATE, DELETE), DELETE: (INSERT,)}


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def sequences(longest):
    for n in range(1, longest + 1):
        for s in itertools.product((INSERT, UPDATE, DELETE), repeat=n):
            if all(b in LEGAL[a] for a, b in zip((None, *s), s)):
                yield s


def collapsed(seq):
    have = None
    for op in seq:
        if have is None:
            have = op
        elif have == INSERT:
            have = None if op == DELETE else INSERT
        elif have == DELETE:
            have = UPDATE
        else:
            have = op
    return have


def test_collapse_of_all_legal_sequences(spark):
    # after insert and delete only an insert can follow, and the key starts anew
    cases = [s for s in sequences(5)]
    ops = spark.createDataFrame([(t, "k", i, op, i * 10) for t, s in enumerate(cases) for i, op in enumerate(s)], "txn int, key string, ordinal int, op int, value int")
    got = {r["txn"]: (r["op"], r["value"]) for r in changelog.collapse(ops, ["key"]).collect()}
    for t, s in enumerate(cases):
        want = collapsed(s)
        assert got.get(t, (None, None))[0] == want, s
        if want:
            assert got[t][1] == (len(s) - 1) * 10
    assert changelog.illegal(ops, ["key"]).isEmpty()
    wrong = spark.createDataFrame([(1, "k", 0, DELETE), (1, "k", 1, UPDATE)], "txn int, key string, ordinal int, op int")
    assert changelog.illegal(wrong, ["key"]).count() == 1


def random_log(seed, n=300, keys=12):
    rng, live, out = random.Random(seed), set(), []
    for lsn in range(1, n + 1):
        for ordinal in range(rng.randint(1, 2)):
            k = rng.randrange(keys)
            op = rng.choice((UPDATE, DELETE)) if k in live else INSERT
            live.discard(k) if op == DELETE else live.add(k)
            out.append((lsn, ordinal, op, k, rng.randrange(10), rng.choice("ab")))
    return out


SCHEMA = "lsn long, ordinal long, op int, key int, value int, tag string"


def state_at(log, lsn):
    state = {}
    for at, _, op, k, v, t in log:
        if at <= lsn:
            state.pop(k, None) if op == DELETE else state.__setitem__(k, (v, t))
    return sorted((k, *x) for k, x in state.items())


@pytest.mark.parametrize("seed", [1, 2])
def test_state_deltas_and_their_law(spark, seed):
    raw = random_log(seed)
    log = spark.createDataFrame(raw, SCHEMA)
    for lsn in (0, 77, 300):
        assert rows(changelog.as_of(log, lsn, ["key"]).drop("lsn")) == state_at(raw, lsn)
    snapshot = changelog.as_of(log, 120, ["key"]).drop("lsn")
    assert rows(changelog.replay(snapshot, 120, log, ["key"])) == state_at(raw, 300)
    shown = lambda c: c("value") >= 5
    seen = [r for r in state_at(raw, 300) if r[1] >= 5]
    sent = subscriptions.deltas(log, ["key"], shown)
    for anchor in (0, 120, 299):
        start = subscriptions.initial_set(log, anchor, ["key"], shown)
        assert rows(subscriptions.client_state(start, sent, anchor, ["key"])) == seen
    # the truth table, step by step
    old, want = {}, []
    for lsn, ordinal, op, k, v, _ in raw:
        was, now = old.get(k, -1) >= 5, op != DELETE and v >= 5
        if was or now:
            want.append((lsn, ordinal, INSERT if not was else UPDATE if now else DELETE, k))
        old.pop(k, None) if op == DELETE else old.__setitem__(k, v)
    assert rows(sent.select("lsn", "ordinal", "delta", "key")) == sorted(want)
    quiet = subscriptions.deltas(log, ["key"], shown, columns=["tag"])
    assert quiet.columns == ["lsn", "ordinal", "delta", "key", "tag"] and quiet.count() < len(want)
    assert {r["delta"] for r in subscriptions.resume(log, 250, ["key"], shown).collect()} <= {INSERT, UPDATE, DELETE}


def test_upsert_and_reconcile(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    batch = spark.createDataFrame([(2, "c", 1), (3, "d", 2), (3, "e", 3)], "k int, v string, o int")
    assert rows(changelog.upsert(base, batch, ["k"], "o")) == [(1, "a"), (2, "c"), (3, "e")]
    assert [r["op"] for r in changelog.upsert_ops(base, batch, ["k"], "o").orderBy("o").collect()] == [UPDATE, INSERT, UPDATE]
    ops = spark.createDataFrame([(1, DELETE, 1), (1, INSERT, 2), (9, DELETE, 3), (4, UPDATE, 4), (4, DELETE, 5), (4, DELETE, 6)], "k int, op int, o int")
    assert [(r["k"], r["o"], r["op"]) for r in changelog.reconcile(base, ops, ["k"], "o").orderBy("o").collect()] == [(1, 1, DELETE), (1, 2, INSERT), (4, 4, INSERT), (4, 5, DELETE)]


def test_overlay_and_views(spark):
    base = spark.createDataFrame([(1, 5), (2, None), (3, 7)], "k int, v int")
    pending = spark.createDataFrame([(1, 9, UPDATE), (3, None, DELETE), (4, 4, INSERT)], "k int, v int, op int")
    assert sorted(rows(views.overlay(base, pending, "k")), key=str) == [(1, 9), (2, None), (4, 4)]
    t = Table("t", (Column("k", "int32", primary=True), Column("v", "int32", indexed=True), Column("w", "int32")))
    v = views.View(t, base)
    assert [r["k"] for r in v.filter_range("v", 5, 9).collect()] == [1, 3] and v.filter_range("v", 9, 5).isEmpty()
    assert v.first().first()["k"] == 1 and v.any().first()["any"] and not views.View(t, base.filter("k > 9")).any().first()["any"]
    with pytest.raises(TidelogError):
        v.filter("w", 1)
    assert rows(views.unique_violations(spark.createDataFrame([(1, "x"), (2, "x"), (3, None), (4, None)], "k int, u string"), "k", "u").select("k")) == [(1,), (2,)]


def test_autoinc(spark):
    df = spark.createDataFrame([(0, i) for i in range(50)] + [(99, 50)], "id long, n int")
    got = sorted((r["n"], r["id"]) for r in changelog.autoinc(df, "id", 3, 7, ["n"]).collect())
    assert got == [(i, (3 << 47) + 8 + i) for i in range(50)] + [(50, 99)]
    ids = spark.createDataFrame([((3 << 47) + 12,), ((4 << 47) + 99,), (5,)], "id long")
    assert changelog.last_sequence(ids, "id", 3).first()["last"] == 12 and changelog.last_sequence(ids, "id", 8).first()["last"] == 0


def test_subscription_rules(spark):
    state = spark.createDataFrame([(x, x) for x in range(20)], "id int, x int")
    diff = subscriptions.rescope(state, "id", F.col("x").between(0, 7), F.col("x").between(5, 12))
    assert rows(diff) == [(INSERT, i) for i in range(8, 13)] + [(DELETE, i) for i in range(5)]
    for args in (("a", "b", 1, 5, None), ("a", "a", 9, 5, None), ("a", "a", 1, 5, 301.0)):
        with pytest.raises(TidelogError):
            subscriptions.check_resume(*args)
    subscriptions.check_resume("a", "a", 5, 5, 299.0)
    r = subscriptions.Registry(1)
    plan = type("P", (), {"table": type("T", (), {"name": "t"}), "columns": ("a",)})
    r.add("s", plan)
    r.add("s", plan)
    with pytest.raises(TidelogError):
        r.add("other", plan)
    assert r.remove("s") and not r.remove("s")
    assert [subscriptions.backpressure(99 << 20, p) for p in ("drop_and_resync", "buffer", "disconnect")] == ["resync", "buffer", "disconnect"] and subscriptions.backpressure(1) == "send"
    sized = spark.createDataFrame([(i, 30) for i in range(10)], "k int, bytes int")
    assert [r["chunk"] for r in subscriptions.chunks(sized, "k", budget=60).orderBy("k").collect()] == [0, 0, 1, 1, 2, 2, 3, 3, 4, 4]
    before = spark.createDataFrame([(1, "a", 1), (2, "a", 1), (1, "b", 1), (1, "c", 1)], "sub int, key string, value int")
    after = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "d", 1)], "sub int, key string, value int")
    assert rows(subscriptions.cache_changes(before, after, "key")) == [("b", UPDATE, 1), ("c", DELETE, 0), ("d", INSERT, 1)]


def test_policies(spark):
    df = spark.createDataFrame([(1, "x", 5), (2, "y", None)], "id int, who string, n int")
    assert policies.visible_rows(df, []).count() == 2 and policies.visible_rows(df, [F.col("n") > 9], owner=True).count() == 2
    assert rows(policies.visible_rows(df, [F.col("n") > 9, F.col("who") == "y"]).select("id")) == [(2,)]
    m = policies.Mask
    a, n = m.all(), m.none()
    assert n.excluding("x") == n and a.excluding("x").shows("y") and not a.excluding("x").shows("x")
    for one, two in itertools.product([a, n, m.only("x"), m.only("x", "y"), a.excluding("x"), a.excluding("y", "z")], repeat=2):
        assert all((one & two).shows(c) == (one.shows(c) and two.shows(c)) for c in "wxyz")
    got = policies.masked(df, [(F.col("id") == 1, a, m.only("who")), (F.lit(True), a.excluding("n"), a)], always=["id"])
    assert [tuple(r) for r in got.orderBy("id").collect()] == [(1, "x", None), (2, "y", None)]
    for args in ((False, True, True, True), (True, False, True, True), (True, True, False, True), (True, True, True, False)):
        with pytest.raises(TidelogError):
            policies.check_call(*args)


def test_shards(spark):
    pts = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate([(0, 0), (-1, -1), (15, 15), (16, 0), (-17, 3), (8, 8)])], "id int, x long, y long")
    s = {r["id"]: (r["bx"], r["by"], r["shard"]) for r in shards.spatial(pts, F.col("x"), F.col("y"), 16).collect()}
    assert [s[i][:2] for i in range(6)] == [(0, 0), (-1, -1), (0, 0), (1, 0), (-2, 0), (0, 0)] and s[1][2] == -1 and s[3][2] == 1 << 32
    band = {}
    for r in shards.border_band(pts, "id", 16).collect():
        band.setdefault(r["id"], set()).add(r["observer"])
    assert len(band[0]) == 3 and len(band[2]) == 3 and 5 not in band
    home = pts.withColumn("home_x", F.lit(0)).withColumn("home_y", F.lit(0))
    assert {r["id"]: r["state"] for r in shards.boundary(home, "id", 16).collect()} == {0: "approaching", 1: "approaching", 2: "approaching", 3: "approaching", 4: "crossed", 5: "interior"}
    ops = spark.createDataFrame([(1, 0, INSERT, False, 1), (2, 0, UPDATE, True, 1), (3, 0, UPDATE, False, 1), (4, 0, DELETE, False, 1)], "lsn int, ordinal int, op int, in_scope boolean, key int")
    assert [r["ship"] for r in shards.border_stream(ops, ["key"]).orderBy("lsn").collect()] == [INSERT, DELETE]
    load = spark.createDataFrame([("b", 1, 5), ("a", 2, 5), ("c", 3, 1), ("d", 4, 1)], "node string, shard int, load int")
    assert tuple(shards.rebalance_pick(load).first()) == ("a", "c")


def test_new_scope_after_a_delta(spark):
    """A row deleted at lsn 11 comes back by a diff with lsn 0 that arrives later; the diff's delete of another row outlives its update."""
    initial = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, v string")
    sent = spark.createDataFrame([(11, 0, DELETE, 1, None, 1), (12, 0, UPDATE, 2, "bb", 2), (0, 0, INSERT, 1, "again", 3), (0, 1, DELETE, 2, None, 3), (13, 0, UPDATE, 3, "cc", 4)], "lsn long, ordinal long, delta int, k int, v string, arrival long")
    assert rows(subscriptions.client_state(initial, sent, 10, ["k"])) == [(1, "again"), (3, "cc")]


def test_fanout_of_ranges_against_a_loop(spark):
    raw = random_log(7)
    rng = random.Random(1)
    raw = [(lsn, o, op, k, rng.randrange(-3000, 3000)) for lsn, o, op, k, _, _ in raw]
    log = spark.createDataFrame(raw, "lsn long, ordinal long, op int, key int, value long")
    subs = [(i, low := rng.randrange(-3000, 3000), low + rng.randrange(0, 1025)) for i in range(30)] + [(99, 5, 4)]
    got = rows(subscriptions.fanout(log, spark.createDataFrame(subs, "sub int, low long, high long"), ["key"]).select("sub", "lsn", "ordinal", "key", "delta"))
    want, old = [], {}
    for lsn, o, op, k, v in raw:
        for s, low, high in subs:
            was, now = low <= old.get(k, high + 1) <= high, op != DELETE and low <= v <= high
            if was or now:
                want.append((s, lsn, o, k, INSERT if not was else UPDATE if now else DELETE))
        old.pop(k, None) if op == DELETE else old.__setitem__(k, v)
    assert got == sorted(want) and want


def test_frames_are_applied_by_ticks(spark):
    initial = spark.createDataFrame([(1, "a")], "k int, v string")
    frames = spark.createDataFrame([(1, 0, 5, 0, UPDATE, 1, "b"), (2, 0, 6, 0, INSERT, 2, "c"), (3, 0, 7, 0, DELETE, 1, None), (4, 1, 9, 0, INSERT, 4, "d")], "frame long, era int, lsn long, ordinal long, delta int, k int, v string")
    pump = subscriptions.FramePump(initial, frames, 4, ["k"])
    assert rows(pump.state()) == [(1, "a")] and pump.tick(1) == 1 and rows(pump.state()) == [(1, "b")] and pump.tick(1) == 1 and rows(pump.state()) == [(1, "b"), (2, "c")]
    pump.resync(spark.createDataFrame([(7, "new")], "k int, v string"), 8)
    assert pump.tick(9) == 1 and rows(pump.state()) == [(4, "d"), (7, "new")] and pump.tick(9) == 0
    with pytest.raises(TidelogError):
        pump.tick(0)


def test_blocks_beyond_doubles(spark):
    df = spark.createDataFrame([((1 << 60) + 15,), ((1 << 60) + 16,), (-1,), (-(1 << 60) - 1,)], "x long")
    from tidelog.functions.spatial import block

    assert [r[0] for r in df.select(block(F.col("x"), 16)).collect()] == [1 << 56, (1 << 56) + 1, -1, -(1 << 56) - 1]


def test_moves_and_drains(spark):
    load = spark.createDataFrame([("a", 1, 50, None), ("a", 2, 30, None), ("a", 3, 5, None), ("b", 4, 40, None), ("c", 5, 10, None)], "node string, shard int, load int, moved long")
    assert [tuple(r) for r in shards.rebalance_move(load, hot=60).collect()] == [(1, "a", "c", 50)]
    assert shards.rebalance_move(load, hot=90).isEmpty() and shards.rebalance_move(load.filter("shard = 1 or node <> 'a'"), hot=20).isEmpty()
    resting = load.withColumn("moved", F.when(F.col("shard") == 1, 95).cast("long"))
    assert [r["shard"] for r in shards.rebalance_move(resting, hot=60, now=100, rest=10).collect()] == [2]
    assert sorted(tuple(r) for r in shards.drain(load, spark.createDataFrame([("a",)], "node string")).collect()) == [(1, "a", "c"), (2, "a", "b"), (3, "a", "c")]
    every = spark.createDataFrame([("a",), ("b",), ("c",)], "node string")
    assert {r["target"] for r in shards.drain(load, every).collect()} == {None}
    state = spark.createDataFrame([(1, 0, False, True, 5, 5), (2, 0, False, True, 5, 4), (3, 1, False, True, 5, 5)], "shard int, rows int, draining boolean, fresh boolean, head int, cursor int")
    assert [r["shard"] for r in shards.reapable(state).collect()] == [1]
    assert shards.Instancing("shard").may_commit(state, 2).count() == 2


def test_rate_limit_against_a_loop(spark):
    rng = random.Random(5)
    calls = sorted((rng.random() * 5, i, rng.choice("ab")) for i in range(400))
    df = spark.createDataFrame([(k, t, i) for t, i, k in calls], "k string, at double, n long")
    got = {r["n"]: r["allowed"] for r in timers.rate_limited(df, ["k"]).collect()}
    state = {}
    for t, i, k in calls:
        tokens, last = state.get(k, (60.0, None))
        tokens = min(60.0, tokens + (0.0 if last is None else t - last) * 20)
        assert got[i] == (tokens >= 1), i
        state[k] = (tokens - (tokens >= 1), t)
    assert not all(got.values())


def test_timers(spark):
    t = spark.createDataFrame([(1, 10, 5), (2, 12, None), (3, 99, 5)], "id int, due long, interval long")
    assert rows(timers.catch_up(t, 22, every=True)) == [(1, 10), (1, 15), (1, 20), (2, 12)] and rows(timers.catch_up(t, 22, every=False)) == [(1, 10), (2, 12)]
    assert [r["id"] for r in timers.dispatch_order(t, 50).collect()] == [1, 2]


def test_evolution(spark):
    c = Column
    old = Table("t", (c("id", "int64", primary=True), c("a", "int32"), c("b", "string")))
    cat = lambda *ts: Catalog({t.name: t for t in ts})
    assert evolve.shape_diff(cat(old), cat(old)).verdict == "identical"
    more = Table("t", (c("id", "int64", primary=True), c("b", "string"), c("a", "int32"), c("s", "scheduleat"), c("at", "timestamp"), c("who", "identity")))
    other = Table("u", (c("id", "int64", primary=True),))
    assert evolve.shape_diff(cat(old), cat(more, other)).verdict == "additive"
    for worse in (cat(), cat(Table("t", (c("id", "int64", primary=True), c("a", "int64"), c("b", "string")))), cat(Table("t", (c("id", "int64"), c("a", "int32", primary=True), c("b", "string")))), cat(Table("t", (c("id", "int64", primary=True),)))):
        assert evolve.shape_diff(cat(old), worse).verdict == "destructive"
    df = spark.createDataFrame([(1, 2, "x")], old.spark_schema(), verifySchema=False)
    r = evolve.remap(df, old, more).first()
    assert (r["id"], r["b"], r["a"], tuple(r["s"]), str(r["at"]), bytes(r["who"])) == (1, "x", 2, (False, 0), "1970-01-01 00:00:00", b"\0" * 32)
    assert evolve.ddl(None, old, True) == ["create t"] and evolve.ddl({"id": "int64", "a": "int32", "x": "int8"}, old, True) == ["add t.b"]
    for have, auto in (({"id": "int32"}, True), (None, False)):
        with pytest.raises(TidelogError):
            evolve.ddl(have, old, auto)
