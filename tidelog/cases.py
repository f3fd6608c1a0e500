"""Queries of the operators that decide, commit or stream: tables of cases and outcomes, and tables that a real log, snapshot, sink or handoff was through."""

from __future__ import annotations

import json
import sqlite3
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog import queries as core
from tidelog.catalog import Catalog, Column, Table, TidelogError
from tidelog.engine import SNAPSHOT, Database
from tidelog.functions.keys import key_bytes, key_value
from tidelog.handoff import Shard, hand_off
from tidelog.operators import changelog, evolve, policies, subscriptions
from tidelog.operators.views import INSERT
from tidelog.plans.analyze import Mode, analyze, coerce, json_params
from tidelog.plans.compile import checked_size, counted
from tidelog.plans.sqlsubset import parse
from tidelog.queries import LOG, query
from tidelog.sources.jsonio import result_json
from tidelog.sources.log import clamp, restore
from tidelog.sources.scratch import scratch_folder
from tidelog.sources.tables import events_log, read_table
from tidelog.streaming import consumers

Outcomes = list[tuple[str, str]]


def outcome(fn: Callable[[], object]) -> str:
    """What fn gives as text, or the code of the error it raises."""
    try:
        return str(fn())
    except TidelogError as e:
        return e.code


def cases(name: str, expected: Outcomes) -> Callable:
    """A query of cases and outcomes; its SQL has the outcomes that are due."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    sql = "select * from (values " + ", ".join(f"({quoted(a)}, {quoted(b)})" for a, b in expected) + ") t(case_name, outcome)"

    def register(fn: Callable[[SparkSession, str], Outcomes]):
        query(sql, name)(lambda spark, d: spark.createDataFrame(fn(spark, d), "case_name string, outcome string"))
        return fn

    return register


# operands and gates
def _of(kind: str, **options) -> Column:
    return Column("c", kind, **options)


COERCIONS = [
    ("int32", 1.5, "2"), ("int32", 2.5, "2"), ("int32", -0.5, "0"), ("int64", True, "1"), ("uint8", 255, "255"), ("uint8", 256, "bad_operand"), ("int8", -129, "bad_operand"),
    ("uint64", -1, "bad_operand"), ("int64", float("nan"), "bad_operand"), ("float64", 3, "3.0"), ("float64", True, "bad_operand"), ("bool", 1, "bad_operand"), ("string", "x", "x"),
    ("string", 3, "bad_operand"), ("bytes", "AQI=", r"b'\x01\x02'"), ("bytes", "*", "bad_operand"), ("identity", "ab", "bad_operand"), ("timestamp", 1_000_000, "1970-01-01 00:00:01"),
]


@cases("p_coerce", [(f"{k} {v!r}", want) for k, v, want in COERCIONS])
def p_coerce(spark, d):
    return [(f"{k} {v!r}", outcome(lambda k=k, v=v: coerce(_of(k), v))) for k, v, _ in COERCIONS]


NULLS = [("int32", "0"), ("uint64", "0"), ("bool", "False"), ("float64", "0.0"), ("timestamp", "1970-01-01 00:00:00"), ("string", "bad_operand"), ("bytes", "bad_operand")]


@cases("p_null_operand", NULLS)
def p_null_operand(spark, d):
    def one(kind):
        # floats can't be indexed, so they are compared in an aggregate
        indexed = kind != "float64"
        t = Table("t", (Column("id", "int64", primary=True), Column("c", kind, indexed=indexed)), tier="relational")
        text = "SELECT * FROM t WHERE c = :n" if indexed else "SELECT COUNT(*) FROM t WHERE c = :n"
        value = analyze(parse(text, {"n": None}), Catalog({"t": t}), Mode(owner=True)).predicate.values[0]
        return value if kind != "timestamp" else coerce(_of(kind), value)

    return [(k, outcome(lambda k=k: one(k))) for k, _ in NULLS]


LITERALS = [("-3", "-3"), ("2.5", "2.5"), ("'x y'", "x y"), ("TRUE", "True"), ("false", "False"), (":p", "7"), ("'it''s'", "parse_error"), ("1e5", "parse_error"), ("NULL", "parse_error"), ("99999999999999999999", "parse_error"), (":q", "parse_error")]


@cases("p_parse_literals", LITERALS)
def p_parse_literals(spark, d):
    return [(x, outcome(lambda x=x: parse(f"SELECT * FROM t WHERE a = {x}", {"p": 7}).predicate.values[0])) for x, _ in LITERALS]


GATED = Table("Hut", (Column("Id", "int64", primary=True), Column("Valley", "string", indexed=True), Column("Beds", "int32"), Column("Code", "int32", server_only=True)), tier="relational")
CREW = Table("Crew", (Column("Id", "int64", primary=True),), public=False, tier="relational")
SLED = Table("Sled", (Column("Id", "int64", primary=True), Column("Dogs", "uint32", indexed=True)), placement="partitioned")
CATALOG = Catalog({t.name: t for t in (GATED, CREW, SLED)})


def _gate(text: str, mode: Mode, **params) -> str:
    def go():
        analyze(parse(text, params), CATALOG, mode)
        return "ok"

    return outcome(go)


def gates(name: str, rows: list[tuple[str, str, Mode]]) -> None:
    cases(name, [(text, want) for text, want, _ in rows])(lambda spark, d: [(text, _gate(text, mode)) for text, _, mode in rows])


ANYONE, OWNER = Mode(), Mode(owner=True)
gates("p_unindexed", [("SELECT * FROM Hut WHERE Beds = 1", "unindexed_column", ANYONE), ("SELECT * FROM Hut WHERE Valley = 'a'", "ok", ANYONE), ("SELECT * FROM Hut WHERE Id = 1", "ok", ANYONE), ("SELECT COUNT(*) FROM Hut WHERE Beds = 1", "ok", OWNER)])
gates("p_require_predicate", [("SELECT * FROM Hut", "predicate_required", Mode(require=frozenset({"Hut"}))), ("SELECT * FROM Hut WHERE Id = 4", "predicate_required", Mode(require=frozenset({"Hut.Valley"}))), ("SELECT * FROM Hut WHERE Valley = 'b'", "ok", Mode(require=frozenset({"Hut.Valley"}))), ("SELECT * FROM Sled", "ok", Mode(require=frozenset({"Hut"})))])
gates("p_range_span", [("SELECT * FROM Hut WHERE Id BETWEEN 0 AND 1024", "ok", ANYONE), ("SELECT * FROM Hut WHERE Id BETWEEN 0 AND 1025", "range_too_wide", ANYONE), ("SELECT * FROM Hut WHERE Id BETWEEN -9223372036854775808 AND 9223372036854775807", "range_too_wide", ANYONE), ("SELECT * FROM Hut WHERE Id BETWEEN 9 AND 3", "ok", ANYONE), ("SELECT * FROM Hut WHERE Valley BETWEEN 'a' AND 'z'", "ok", ANYONE), ("SELECT COUNT(*) FROM Hut WHERE Id BETWEEN 0 AND 99999", "ok", OWNER)])
gates("p_server_only", [("SELECT Code FROM Hut", "server_only", ANYONE), ("SELECT Code FROM Hut WHERE Id = 1", "server_only", OWNER), ("SELECT * FROM Hut WHERE Code = 1", "server_only", OWNER), ("SELECT MAX(Code) FROM Hut", "server_only", OWNER), ("SELECT * FROM Hut", "ok", ANYONE)])
gates("p_private", [("SELECT * FROM Crew", "unknown_table", ANYONE), ("SELECT * FROM Nowhere", "unknown_table", ANYONE), ("SELECT Id FROM Crew", "ok", OWNER), ("SELECT * FROM Nothing", "unknown_table", OWNER)])
gates("p_agg_gates", [("SELECT COUNT(*) FROM Hut", "owner_required", ANYONE), ("SELECT COUNT(Id) FROM Hut", "ok", OWNER), ("SELECT COUNT(*) FROM Sled", "not_relational", OWNER), ("SELECT MIN(Id) FROM Hut", "no_relational_tier", Mode(owner=True, relational=False)), ("SELECT Valley, COUNT(*) FROM Hut", "not_grouped", OWNER), ("SELECT SUM(Valley) FROM Hut", "unsupported", OWNER), ("SELECT COUNT(*) FROM Hut WHERE Beds <> 0", "unsupported", OWNER)])


@cases("p_ceilings", [("25 rows of 25", "25"), ("25 rows of 24", "too_many_rows"), ("bytes of all", "25"), ("one byte less", "too_many_bytes")])
def p_ceilings(spark, d):
    t = core.CATALOG.get("nation")
    df = read_table(spark, d, "nation", core.CATALOG)
    size = df.agg(F.sum(core.row_bytes(t))).first()[0]
    n = lambda *limits: outcome(lambda: checked_size(df, t, *limits).count())
    return [("25 rows of 25", n(25)), ("25 rows of 24", n(24)), ("bytes of all", n(25, size)), ("one byte less", n(25, size - 1))]


PARAMS = [('{"$identity": "' + "0f" * 32 + '"}', "32 bytes"), ('{"$bytes": "AQ=="}', r"b'\x01'"), ('{"$timestamp": 5}', "1970-01-01 00:00:00.000005"), ('{"$interval": 9}', "(True, 9)"), ("5", "5"), ('{"$what": 1}', "bad_operand"), ('{"$bytes": "*"}', "bad_operand")]


@cases("p_json_params", PARAMS)
def p_json_params(spark, d):
    def one(text):
        v = json_params({"a": json.loads(text)})["a"]
        return "32 bytes" if isinstance(v, bytes) and len(v) == 32 else v

    return [(x, outcome(lambda x=x: one(x))) for x, _ in PARAMS]


@query("""select '{"columns": ["r_regionkey", "r_name"], "rows": [' || string_agg('[' || r_regionkey || ', "' || r_name || '"]', ', ' order by r_regionkey) || ']}' as result from region""")
def p_json_result(spark, d):
    df = read_table(spark, d, "region", core.CATALOG).select("r_regionkey", "r_name").orderBy("r_regionkey")
    return spark.createDataFrame([(result_json(df, core.CATALOG.get("region")),)], "result string")


@query("select count(*) as rows, count(*) filter (where n_regionkey between 1 and 2) as kept from nation")
def q_scan_counters(spark, d):
    """Rows that a scan saw, and those that its predicate left."""
    df, seen = counted(read_table(spark, d, "nation", core.CATALOG), f"scan-{uuid.uuid4().hex}")
    kept = df.filter("n_regionkey between 1 and 2").count()
    return spark.createDataFrame([(seen.get["rows_scanned"], kept)], "rows long, kept long")


@cases("p_manifest", [("Hut", "Id Valley Beds"), ("Sled", "Id Dogs"), ("procedures", "book")])
def p_manifest(spark, d):
    db = Database(spark, scratch_folder(spark, "db"), CATALOG)
    db.procedure("book")(lambda tx: None)
    db.procedure("audit", client_callable=False)(lambda tx: None)
    m = json.loads(CATALOG.manifest(db.procedures))
    return [(t["name"], " ".join(c["name"] for c in t["columns"])) for t in m["tables"]] + [("procedures", " ".join(m["procedures"]))]


KEYS = [("int32", -5), ("int32", 3), ("int64", -(1 << 63)), ("uint64", (1 << 64) - 1), ("bool", True), ("string", "grün"), ("bytes", b"\0\1")]


@cases("p_key_bytes", [("int32 -5", "7ffffffb"), ("int32 3", "80000003"), ("int64 -9223372036854775808", "0000000000000000"), ("uint64 18446744073709551615", "ffffffffffffffff"), ("bool True", "01"), ("string 'grün'", "6772c3bc6e"), (r"bytes b'\x00\x01'", "0001"), ("read back", "True"), ("float64", "bad_key")])
def p_key_bytes(spark, d):
    back = all(key_value(k, key_bytes(k, v)) == v for k, v in KEYS)
    return [(f"{k} {v!r}", key_bytes(k, v).hex()) for k, v in KEYS] + [("read back", str(back)), ("float64", outcome(lambda: key_bytes("float64", 1.0)))]


# policies and subscriptions
def _shown(m: policies.Mask) -> str:
    return "".join(c for c in "abc" if m.shows(c)) or "-"


@cases("p_mask_algebra", [("all", "abc"), ("none", "-"), ("none except a", "-"), ("all except a", "bc"), ("only a b except b", "a"), ("only a b and only b c", "b"), ("all except a and all except b", "c"), ("all except a and only a", "-")])
def p_mask_algebra(spark, d):
    m = policies.Mask
    a = m.all().excluding("a")
    return [("all", _shown(m.all())), ("none", _shown(m.none())), ("none except a", _shown(m.none().excluding("a"))), ("all except a", _shown(a)), ("only a b except b", _shown(m.only("a", "b").excluding("b"))), ("only a b and only b c", _shown(m.only("a", "b") & m.only("b", "c"))), ("all except a and all except b", _shown(a & m.all().excluding("b"))), ("all except a and only a", _shown(a & m.only("a")))]


@query("select 'client' as who, count(*) as rows from orders where o_orderstatus = 'F' union all select 'owner', count(*) from orders")
def p_owner_bypass(spark, d):
    o = read_table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    seen = lambda who, owner: policies.visible_rows(o, [F.col("o_orderstatus") == "F"], owner).agg(F.lit(who).alias("who"), F.count(F.lit(1)).alias("rows"))
    return seen("client", False).unionByName(seen("owner", True))


CALLS = [("book", "ok"), ("audit", "unknown_procedure"), ("nothing", "unknown_procedure"), ("book, too fast", "rate_limited"), ("close", "denied"), ("close by 7", "ok"), ("book nan", "bad_argument")]


@cases("p_reducer_policy", CALLS)
def p_reducer_policy(spark, d):
    db = Database(spark, scratch_folder(spark, "db"), Catalog({}))
    db.procedure("book")(lambda tx, *a: None)
    db.procedure("audit", client_callable=False)(lambda tx: None)
    db.procedure("close", allowed=lambda who: who == 7)(lambda tx: None)
    call = lambda *a, **o: outcome(lambda: db.call(*a, **o) or "ok")
    return [("book", call("book")), ("audit", call("audit")), ("nothing", call("nothing")), ("book, too fast", call("book", within_rate=False)), ("close", call("close", caller=1)), ("close by 7", call("close", caller=7)), ("book nan", call("book", float("nan")))]


RESUMES = [("same epoch, all there", "ok"), ("other epoch", "resync"), ("beyond the head", "resync"), ("missed too long ago", "resync"), ("nothing missed", "ok")]


@cases("p_resume_refuse", RESUMES)
def p_resume_refuse(spark, d):
    go = lambda *a: outcome(lambda: subscriptions.check_resume(*a) or "ok")
    return list(zip([c for c, _ in RESUMES], [go("a", "a", 3, 5, 299.0), go("b", "a", 3, 5, 1.0), go("a", "a", 6, 5, None), go("a", "a", 3, 5, 301.0), go("a", "a", 5, 5, None)], strict=True))


def _plan(text: str):
    return analyze(parse(text), CATALOG)


@cases("p_sub_cap", [("64 subscriptions", "64"), ("one more", "too_many_subscriptions"), ("a new scope of one", "64"), ("another table", "bad_rescope")])
def p_sub_cap(spark, d):
    r = subscriptions.Registry()
    for i in range(64):
        r.add(f"s{i}", _plan(f"SELECT * FROM Hut WHERE Id = {i}"))
    more = outcome(lambda: r.add("more", _plan("SELECT * FROM Sled")))
    n = len(r.live)
    r.add("s3", _plan("SELECT * FROM Hut WHERE Id = 99"))
    return [("64 subscriptions", str(n)), ("one more", more), ("a new scope of one", str(len(r.live))), ("another table", outcome(lambda: r.add("s3", _plan("SELECT * FROM Sled"))))]


@query(LOG + "select user_id, event_type, value from state where event_type = 'click'")
def p_unsubscribe(spark, d):
    """Two subscriptions, of which one is given up: the cache keeps what the other shows."""
    log, r = events_log(spark, d), subscriptions.Registry()
    for name in ("clicks", "views"):
        r.add(name, _plan("SELECT * FROM Sled"))
    r.remove("views")
    shown = {"clicks": "click", "views": "view"}
    out = None
    for name in r.live:
        rows = subscriptions.initial_set(log, 1 << 40, ["user_id"], lambda c, name=name: c("event_type") == shown[name])
        out = rows if out is None else out.unionByName(rows)
    return out


# the log, for real
USER = Table("user_state", (Column("user_id", "int64", primary=True), Column("event_type", "string", indexed=True), Column("value", "float64")))
STATE = LOG + "select user_id, event_type, value from state"


def _events_db(spark: SparkSession, d: str, *cuts: int) -> Database:
    """The events' log as commits of a database: up to each cut, and the rest."""
    db = Database(spark, scratch_folder(spark, "db"), Catalog({"user_state": USER}))
    log = db.log("user_state")
    for low, high in zip((0, *cuts), (*cuts, 1 << 60), strict=True):
        part = events_log(spark, d).filter((F.col("lsn") > low) & (F.col("lsn") <= high))
        log.append_many(part.withColumn("record", F.col("lsn") - (low + 1)), after=low)
    return db


@query(LOG + "select lsn, op, user_id from log where lsn > 800")
def p_log_read(spark, d):
    return _events_db(spark, d, 300, 900).log("user_state").read(800).select("lsn", "op", "user_id")


@query(LOG + "select min(lsn) as first, max(lsn) as last, count(*) as ops, true as contiguous from log")
def p_log_append(spark, d):
    db = _events_db(spark, d, 300, 900)
    v = db.commits.verify()
    return db.log("user_state").read().agg(F.min("lsn").alias("first"), F.max("lsn").alias("last"), F.count(F.lit(1)).alias("ops")).withColumn("contiguous", F.lit(v["contiguous"] and v["first"] == 1))


@query(STATE)
def q_snapshot_plus_tail(spark, d):
    """A snapshot on disk at 400, and the records after it."""
    db = Database(spark, scratch_folder(spark, "db"), Catalog({"user_state": USER}))
    log, ev = db.log("user_state"), events_log(spark, d)
    log.append_many(ev.filter("lsn <= 400").withColumn("record", F.col("lsn") - 1))
    db.snapshot()
    log.append_many(ev.filter("lsn > 400").withColumn("record", F.col("lsn") - 401))
    return db.state("user_state")


@query(LOG + ", s as (select user_id, event_type, value from state) select s.*, 400 as floor, (select max(lsn) from log) as head from s")
def p_snapshot_write(spark, d):
    """A snapshot at the end, and the log dropped as far as a consumer at 400 lets it go."""
    db = _events_db(spark, d, 400)
    head = db.snapshot(holders=[("consumer", 400)])
    return db.state("user_state").withColumn("floor", F.lit(db.commits.floor())).withColumn("head", F.lit(head).cast("long"))


@query(LOG + "select 40::bigint as floor, 'applier' as holder, 3 as records, max(lsn) as snapshot from log group by all")
def q_truncation_floor(spark, d):
    """The log holds back for its slowest consumer, and drops what is before."""
    db = _events_db(spark, d, 20, 40, 300, 900)
    db.snapshot()
    floor, holder = db.commits.truncate([("applier", 40), ("resume", 300)])
    return spark.createDataFrame([(floor, holder, len(db.commits.entries()), db.commits.snapshots()[-1])], "floor long, holder string, records int, snapshot long")


@query(LOG + ", r as (select *, row_number() over (partition by user_id order by lsn desc) as k from log where lsn <= 700) select user_id, event_type, value from r where k = 1 and op <> 3")
def q_point_in_time(spark, d):
    """An archive with a snapshot at 300, restored up to 700 as a log of its own."""
    db = Database(spark, scratch_folder(spark, "db"), Catalog({"user_state": USER}))
    log, ev = db.log("user_state"), events_log(spark, d)
    log.append_many(ev.filter("lsn <= 300").withColumn("record", F.col("lsn") - 1))
    db.snapshot()
    log.append_many(ev.filter("lsn > 300").withColumn("record", F.col("lsn") - 301))
    archive, to = scratch_folder(spark, "archive"), scratch_folder(spark, "restored")
    db.commits.export(archive, db.schemas())
    new = restore(archive, to, spark, db.schemas(), at=700)
    assert new.epoch() != db.commits.epoch() and new.head() == 700 and clamp(900, new) == 700
    return new.state("user_state", log.schema, log.keys)


ARCHIVES = [("whole", "ok"), ("before the snapshot", "out_of_range"), ("a record twice", "corrupt_archive"), ("into a full folder", "not_empty")]


@cases("p_archive_checks", ARCHIVES)
def p_archive_checks(spark, d):
    db = Database(spark, scratch_folder(spark, "db"), Catalog({"user_state": USER}))
    log, ev = db.log("user_state"), events_log(spark, d)
    log.append_many(ev.filter("lsn <= 300").withColumn("record", F.col("lsn") - 1))
    db.snapshot()
    log.append_many(ev.filter("lsn > 300").withColumn("record", F.col("lsn") - 301))
    archive = scratch_folder(spark, "archive")
    db.commits.export(archive, db.schemas())
    to = [scratch_folder(spark, "restored") for _ in range(3)]
    go = lambda folder, at=None: outcome(lambda: restore(archive, folder, spark, db.schemas(), at) and "ok")
    out = [go(to[0]), go(to[1], 200)]
    spark.read.parquet(f"{archive}/records/user_state").limit(1).write.mode("append").parquet(f"{archive}/records/user_state")
    return list(zip([c for c, _ in ARCHIVES], [*out, go(to[2]), go(to[0])], strict=True))


# procedures
NATION = Table("nation", (Column("n_nationkey", "int32", primary=True), Column("n_name", "string", unique=True), Column("n_regionkey", "int32", indexed=True)))


def _nations(spark: SparkSession, d: str) -> Database:
    """The nations, each inserted by a call of a procedure; all calls in one write of as many records."""
    db = Database(spark, scratch_folder(spark, "db"), Catalog({"nation": NATION}))

    @db.procedure("add")
    def add(tx, key, name, region):
        tx.insert("nation", {"n_nationkey": key, "n_name": name, "n_regionkey": region})

    @db.procedure("move")
    def move(tx, key, region):
        tx.update("nation", tx.find("nation", key) | {"n_regionkey": region})

    @db.procedure("drop")
    def drop(tx, key):
        tx.delete("nation", key)

    rows = read_table(spark, d, "nation", core.CATALOG).orderBy("n_nationkey").collect()
    db.call("add", *rows[0])
    db.call_many([("add", *r) for r in rows[1:]])
    return db


query("select n_nationkey, n_name, n_regionkey from nation", "p_insert")(lambda s, d: _nations(s, d).state("nation"))


@query("select n_nationkey, n_name, case when n_nationkey < 10 then 77 else n_regionkey end as n_regionkey from nation")
def p_update(spark, d):
    db = _nations(spark, d)
    db.call_many([("move", k, 77) for k in range(10)])
    return db.state("nation")


@query("select n_nationkey, n_name, n_regionkey from nation where n_nationkey not in (3, 4, 20)")
def p_delete(spark, d):
    db = _nations(spark, d)
    for k in (3, 4, 20, 999):
        db.call("drop", k)
    return db.state("nation")


ABORTS = [("same key", "duplicate_key 25 25"), ("same name", "not_unique 25 25"), ("no such row", "no_such_row 25 25"), ("an error after a write", "lost 25 25"), ("a write that fails", "disk 25 25"), ("then a good one", "26 26 26")]


@cases("p_abort", ABORTS)
def p_abort(spark, d):
    """What went wrong, the head and the number of rows after it."""
    db = _nations(spark, d)

    @db.procedure("fail")
    def fail(tx):
        tx.insert("nation", {"n_nationkey": 70, "n_name": "x"})
        tx.publish("never", "x")
        raise TidelogError("lost", "on purpose")

    def with_broken_disk():
        def broken(*_, **__):
            raise TidelogError("disk", "full")

        was, db.commits.claim = db.commits.claim, broken
        try:
            return db.call("add", 80, "y", 1)
        finally:
            db.commits.claim = was

    @db.procedure("touch")
    def touch(tx, key):
        tx.update("nation", {"n_nationkey": key, "n_name": "nobody"})

    taken = db.state("nation").orderBy("n_nationkey").first()["n_name"]
    after = lambda fn: f"{outcome(fn)} {db.commits.head()} {db.state('nation').count()}"
    calls = [("add", 3, "new", 1), ("add", 60, taken, 1), ("touch", 60), ("fail",)]
    out = [after(lambda c=c: db.call(*c)) for c in calls] + [after(with_broken_disk), after(lambda: db.call("add", 90, "good", 1))]
    return list(zip([c for c, _ in ABORTS], out, strict=True))


@cases("p_init_once", [("first", "True"), ("again", "False"), ("connected", "2"), ("disconnected", "3"), ("sessions", "ana left")])
def p_init_once(spark, d):
    t = Table("session", (Column("who", "string", primary=True), Column("state", "string")))
    db = Database(spark, scratch_folder(spark, "db"), Catalog({"session": t}))
    db.on("connected")(lambda tx: tx.insert("session", {"who": tx.caller, "state": "here"}))
    db.on("disconnected")(lambda tx: tx.update("session", {"who": tx.caller, "state": "left"}))
    first = [db.init(lambda tx: tx.insert("session", {"who": "server", "state": "up"})) for _ in range(2)]
    out = [("first", str(first[0])), ("again", str(first[1])), ("connected", str(db.connected("ana"))), ("disconnected", str(db.disconnected("ana")))]
    return [*out, ("sessions", " ".join(db.state("session").filter("who = 'ana'").first()))]


@query("select n_nationkey, n_name, case when n_nationkey = 2 then 50 when n_nationkey = 5 then 51 else n_regionkey end as n_regionkey from nation where n_nationkey <> 7")
def p_snapshot_isolation(spark, d):
    """A procedure sees the state it began with while others commit; its writes are fitted to the head: of two rows it deletes one is gone, of two it puts one is."""
    db = _nations(spark, d)

    @db.procedure("slow", isolation=SNAPSHOT)
    def slow(tx):
        seen = tx.find("nation", 2)
        db.call("move", 5, 51)
        db.call("drop", 7)
        db.call("drop", 2)
        assert tx.find("nation", 5)["n_regionkey"] != 51 and tx.find("nation", 7) is not None
        tx.delete("nation", 7)
        tx.update("nation", seen | {"n_regionkey": 50})

    db.call("slow")
    return db.state("nation")


@query(LOG + "select lsn, ordinal, case when event_type = 'error' then 'alarm' else 'seen' end as kind, user_id::varchar as body from log where op <> 3")
def q_event_outbox(spark, d):
    """Each record that leaves a row causes an event in the same record; read back with the records' lsns."""
    db = Database(spark, scratch_folder(spark, "db"), Catalog({"user_state": USER}))
    ev = events_log(spark, d).withColumn("record", F.col("lsn") - 1)
    n = ev.count()
    caused = ev.filter("op <> 3").select("record", "ordinal", F.when(F.col("event_type") == "error", "alarm").otherwise("seen").alias("kind"), F.col("user_id").cast("string").alias("body"))
    db.commit_frames({"user_state": ev.drop("lsn")}, caused, records=n)
    return db.events().read().select("lsn", "ordinal", "kind", "body")


def _with_events(spark: SparkSession, d: str) -> Database:
    db = Database(spark, scratch_folder(spark, "db"), Catalog({"nation": NATION}))

    @db.procedure("add")
    def add(tx, key, name, region):
        tx.insert("nation", {"n_nationkey": key, "n_name": name, "n_regionkey": region})
        tx.publish("added", name)
        if region == 1:
            tx.publish("near", key)

    db.call_many([("add", *r) for r in read_table(spark, d, "nation", core.CATALOG).orderBy("n_nationkey").collect()])
    return db


OUTBOX = "with n as (select *, row_number() over (order by n_nationkey) as lsn from nation), e as (select lsn, 0::bigint as ordinal, 'added' as kind, n_name as body from n union all select lsn, 1, 'near', n_nationkey::varchar from n where n_regionkey = 1)\n"


@query(OUTBOX + "select lsn, ordinal, kind, body, row_number() over (order by lsn, ordinal)::bigint as place from e")
def p_event_delivery(spark, d):
    """What a handler heard, in order, over two starts of its consumer."""
    db, heard, checkpoint = _with_events(spark, d), [], scratch_folder(spark, "checkpoint")
    for _ in range(2):
        consumers.consume(db.events(), checkpoint, consumers.deliver(heard.append, scratch_folder(spark, "dead"), window=7)).awaitTermination()
    return spark.createDataFrame([(e["lsn"], e["ordinal"], e["kind"], e["body"], i) for i, e in enumerate(heard, 1)], "lsn long, ordinal long, kind string, body string, place long")


@query(OUTBOX + "select lsn, kind, body, 4::bigint as attempts, 'no' as error from e where kind = 'near'")
def p_dead_letter(spark, d):
    """A handler that never takes one kind of event."""
    db, dead = _with_events(spark, d), scratch_folder(spark, "dead")

    def handler(event):
        if event["kind"] == "near":
            raise ValueError("no")

    consumers.consume(db.events(), scratch_folder(spark, "checkpoint"), consumers.deliver(handler, dead, sleep=lambda _: None)).awaitTermination()
    letters = spark.read.schema("lsn long, kind string, body string, attempts long, error string").json(f"{dead}/*")
    return letters.select("lsn", "kind", "body", "attempts", "error")


@query(OUTBOX + "select 'east' as source, lsn, ordinal, kind, body from e")
def p_event_forward(spark, d):
    """Events shipped to another database a few records at a time, and once more from the start after the cursor was lost: each is kept once."""
    db = _with_events(spark, d)
    inbox = Table("inbox", (Column("id", "string", primary=True), Column("source", "string"), Column("lsn", "int64"), Column("ordinal", "int64"), Column("kind", "string"), Column("body", "string")))
    # the table's own columns lsn and ordinal stand beside those of the log, so they travel as src_
    inbox = Table("inbox", tuple(Column(f"src_{c.name}" if c.name != "id" else "id", c.kind, primary=c.primary) for c in inbox.columns))
    hub = Database(spark, scratch_folder(spark, "hub"), Catalog({"inbox": inbox}))

    def received() -> DataFrame:
        return hub.state("inbox").select(F.col("src_source").alias("source"), F.col("src_lsn").alias("lsn"), F.col("src_ordinal").alias("ordinal"), F.col("src_kind").alias("kind"), F.col("src_body").alias("body"))

    def take(rows: DataFrame, upto: int) -> None:
        new = consumers.accepted(received(), rows)
        ident = F.concat_ws("/", "source", "lsn", "ordinal")
        hub.commit_frames({"inbox": new.select(F.lit(0).alias("o"), ident.alias("id"), *(F.col(c).alias(f"src_{c}") for c in ("source", "lsn", "ordinal", "kind", "body"))).select(F.col("o").alias("ordinal"), F.lit(INSERT).alias("op"), "id", "src_source", "src_lsn", "src_ordinal", "src_kind", "src_body")})

    for _ in range(2):
        consumers.Forwarder(db.events(), "east", scratch_folder(spark, "cursor"), records=9).drain(take)
    return received()


# consumers
@query(STATE)
def p_applier(spark, d):
    """A projection that is stopped after a part of the log and goes on from its checkpoint, one commit a batch."""
    db = _events_db(spark, d, 200, 500, 800)
    p = consumers.Projection(db.log("user_state"), scratch_folder(spark, "projection"), buckets=4)
    consumers.consume(p.log, f"{p.folder}-checkpoint", lambda log, entries, n: p.apply_next(log, entries, n) if entries[0]["first"] < 500 else None, files=2).awaitTermination()
    seen = p.applied()
    again = consumers.Projection(db.log("user_state"), p.folder, buckets=4)
    consumers.consume(p.log, f"{p.folder}-checkpoint-2", again.apply_next, files=1).awaitTermination()
    assert 0 < seen < again.applied() == db.commits.head()
    return again.read()


@query(STATE)
def p_bootstrap(spark, d):
    """A projection that finds its next record truncated loads the state at the head."""
    db = _events_db(spark, d, 200, 600)
    p = consumers.Projection(db.log("user_state"), scratch_folder(spark, "projection"), buckets=4)
    db.snapshot(holders=[])
    assert db.commits.floor() > p.applied() and p.catch_up() == db.commits.head()
    return p.read()


@query(STATE)
def q_relational_projection(spark, d):
    """The table in a relational database, by a consumer whose checkpoint lies there too; every batch is handed to it twice."""
    db = _events_db(spark, d, 150, 600)
    name = f"file:{uuid.uuid4().hex}?mode=memory&cache=shared"
    held = sqlite3.connect(name, uri=True, check_same_thread=False)  # the database lives as long as a connection to it
    connect = lambda: sqlite3.connect(name, uri=True, check_same_thread=False)
    sink = consumers.RelationalSink(db.log("user_state"), connect, "user_state")

    def twice(log, entries, number):
        sink.apply(log, entries, number)
        sink.apply(log, entries, number)

    consumers.consume(db.log("user_state"), scratch_folder(spark, "checkpoint"), twice, files=1).awaitTermination()
    assert sink.applied(held.cursor())[0] == db.commits.head()
    rows = held.execute("select user_id, event_type, value from user_state").fetchall()
    held.close()
    return spark.createDataFrame(rows, "user_id long, event_type string, value double")


@query(LOG + core.DELTA + "select lsn, ordinal, delta, user_id, case when delta <> 3 then event_type end as event_type, case when delta <> 3 then value end as value from delta")
def p_delta_sink(spark, d):
    """Deltas of a subscription, written batch by batch, with pre-images from the batches before."""
    db, folder = _events_db(spark, d, 150, 600), scratch_folder(spark, "deltas")
    consumers.consume(db.log("user_state"), scratch_folder(spark, "checkpoint"), consumers.delta_sink(db.log("user_state"), folder, core._clicks), files=1).awaitTermination()
    return spark.read.parquet(f"{folder}/*")


BUFFERED = [("all at once", "resync"), ("a part", "send"), ("all, buffering", "buffer"), ("all, strict", "disconnect")]


@cases("p_backpressure", BUFFERED)
def p_backpressure(spark, d):
    """A client that is far behind a delta sink."""
    db, folder = _events_db(spark, d, 150), scratch_folder(spark, "deltas")
    consumers.consume(db.log("user_state"), scratch_folder(spark, "checkpoint"), consumers.delta_sink(db.log("user_state"), folder, core._clicks)).awaitTermination()
    head = db.commits.head()
    go = lambda after, policy="drop_and_resync": consumers.frames(folder, spark, after, head, 4000, policy)[0]
    return list(zip([c for c, _ in BUFFERED], [go(0), go(head - 20), go(0, "buffer"), go(0, "disconnect")], strict=True))


@query(LOG + ", r as (select *, row_number() over (partition by user_id order by lsn desc) as k from log where lsn <= 700) select user_id, event_type, value from r where k = 1 and op <> 3 and event_type = 'click'")
def p_frame_tick(spark, d):
    """A client that applies frames only when told to: what is left of 500 up to 700, in ticks; frames of the era before a resync are dead."""
    log, keys = events_log(spark, d).filter("lsn <= 700"), ["user_id"]
    sent = subscriptions.deltas(log, keys, core._clicks)
    frames = sent.filter("lsn > 300").select(F.col("lsn").alias("frame"), F.when(F.col("lsn") > 500, 1).otherwise(0).alias("era"), *sent.columns)
    pump = subscriptions.FramePump(subscriptions.initial_set(log, 300, keys, core._clicks), frames, 300, keys)
    assert pump.tick(5) == 5
    pump.resync(subscriptions.initial_set(log, 500, keys, core._clicks), 500)
    while pump.tick(40):
        pass
    return pump.state()


@cases("p_residency", [("auto, small", "memory"), ("auto, large", "disk"), ("demoted", "disk"), ("promoted", "memory"), ("rows", "25"), ("dropped", "None")])
def p_residency(spark, d):
    r, df = consumers.Residency(), read_table(spark, d, "nation", core.CATALOG)
    out = []
    for name, size in (("auto, small", 1 << 10), ("auto, large", 1 << 30)):
        r.keep("nation", df, "auto", size)
        out.append((name, str(r.where("nation"))))
    r.demote("nation")
    out.append(("demoted", str(r.where("nation"))))
    n = r.promote("nation").count()
    out += [("promoted", str(r.where("nation"))), ("rows", str(n))]
    r.drop("nation")
    return [*out, ("dropped", str(r.where("nation")))]


# placement and evolution
MOB = Table("mob", (Column("id", "int64", primary=True), Column("shard", "int64"), Column("hp", "int32")), placement="partitioned", shard_by="shard")


def _two_shards(spark: SparkSession, d: str) -> tuple[Shard, Shard]:
    """Events as mobs of shard 1, and an empty shard 2."""
    a, b = (Database(spark, scratch_folder(spark, f"shard{n}"), Catalog({"mob": MOB}), originator=n) for n in (1, 2))
    rows = read_table(spark, d, "events").select(F.col("event_id").alias("ordinal"), F.lit(INSERT).alias("op"), F.col("event_id").alias("id"), F.lit(1).alias("shard"), F.col("user_id").alias("hp"))
    a.commit_frames({"mob": rows})
    return Shard(a, 1, {"mob": "shard"}), Shard(b, 2, {"mob": "shard"})


@query("select event_id as id, case when user_id between 10 and 20 then 2 else 1 end as shard, user_id as hp, case when user_id between 10 and 20 then 'second' else 'first' end as database from events")
def p_handoff(spark, d):
    """Rows that move to another shard's database, with every step done twice."""
    a, b = _two_shards(spark, d)
    moving = {"mob": F.col("hp").between(10, 20)}
    for _ in range(2):
        rows = a.freeze("h1", moving, 2)
        b.import_("h1", rows, 1)
    a.settle("h1")
    hand_off(a, b, "h1", moving)
    one, two = (s.db.state("mob").withColumn("database", F.lit(n)) for s, n in ((a, "first"), (b, "second")))
    return one.unionByName(two)


SAGA = [("moves nothing", "handoff"), ("write to a frozen row", "frozen"), ("write to another row", "ok"), ("abort", "aborted"), ("write after abort", "ok"), ("settle after abort", "handoff"), ("rows there", "0")]


@cases("p_handoff_abort", SAGA)
def p_handoff_abort(spark, d):
    a, b = _two_shards(spark, d)
    db = a.db

    @db.procedure("hit")
    def hit(tx, key):
        tx.update("mob", tx.find("mob", key) | {"hp": 0})

    keys = {bool(r["moving"]): r["id"] for r in db.state("mob").groupBy(F.col("hp").between(10, 20).alias("moving")).agg(F.min("id").alias("id")).collect()}
    call = lambda key: outcome(lambda: db.call("hit", key) and "ok")
    out = [outcome(lambda: a.freeze("h0", {"mob": F.col("hp") < -5}, 2))]
    a.freeze("h1", {"mob": F.col("hp").between(10, 20)}, 2)
    out += [call(keys[True]), call(keys[False])]
    a.abort("h1")
    a.abort("h1")
    out += [a.state("h1"), call(keys[True]), outcome(lambda: a.settle("h1")), str(b.db.state("mob").count())]
    return list(zip([c for c, _ in SAGA], out, strict=True))


def _shape(*columns: Column) -> Catalog:
    return Catalog({"t": Table("t", columns)})


_ID, _A, _B = Column("id", "int64", primary=True), Column("a", "int32"), Column("b", "string")
SHAPES = [("same", "identical", _shape(_ID, _A, _B)), ("a column more", "additive", _shape(_ID, _A, _B, Column("c", "bool"))), ("another order", "additive", _shape(_ID, _B, _A)), ("a column less", "destructive", _shape(_ID, _A)), ("another kind", "destructive", _shape(_ID, Column("a", "int64"), _B)), ("another key", "destructive", _shape(Column("id", "int64"), Column("a", "int32", primary=True), _B)), ("no table", "destructive", Catalog({}))]


@cases("p_shape_diff", [(name, verdict) for name, verdict, _ in SHAPES])
def p_shape_diff(spark, d):
    return [(name, evolve.shape_diff(_shape(_ID, _A, _B), new).verdict) for name, _, new in SHAPES]


DDL = [("no table", None, True, "create t"), ("no table, not allowed", None, False, "schema_conflict"), ("a column less", {"id": "int64", "a": "int32"}, True, "add t.b"), ("columns too many", {"id": "int64", "a": "int32", "b": "string", "x": "int8"}, False, ""), ("another kind", {"id": "int64", "a": "int64", "b": "string"}, True, "schema_conflict")]


@cases("p_ddl", [(name, want) for name, _, _, want in DDL])
def p_ddl(spark, d):
    t = Table("t", (_ID, _A, _B))
    return [(name, outcome(lambda have=have, auto=auto: " ".join(evolve.ddl(have, t, auto)))) for name, have, auto, _ in DDL]


@query(LOG + "select name, (select max(lsn) from log) - applied as lag from (values ('a', 150), ('b', 600)) c(name, applied)")
def q_applier_lag(spark, d):
    """How far two consumers are behind the log's head."""
    db = _events_db(spark, d, 150, 600)
    head = db.log("user_state").read().select("lsn")
    return changelog.applier_lag(head, spark.createDataFrame([("a", 150), ("b", 600)], "name string, applied long"))
