"""The SQL subset: parsing, operands, gates and results."""

import datetime as dt

import pytest

from tidelog.catalog import Catalog, Column, Table, TidelogError, star_schema
from tidelog.plans.analyze import Mode, analyze, coerce, json_params
from tidelog.plans.compile import checked_size, run_sql
from tidelog.plans.sqlsubset import parse, parse_subscription

#: Arrivals of goods at mountain huts: what came, how many kilograms, when; the porter is nobody's business.
LOAD = Table("Load", (Column("No", "int64", primary=True, autoinc=True), Column("Goods", "string", indexed=True), Column("Kilos", "int64"), Column("Came", "timestamp"), Column("Porter", "int32", server_only=True)), tier="relational")
HUT = Table("Hut", (Column("No", "int64", primary=True), Column("Open", "bool", indexed=True), Column("Guests", "uint32", indexed=True), Column("Altitude", "int32", indexed=True), Column("Slope", "float32")))
CREW = Table("Crew", (Column("No", "int64", primary=True),), public=False, tier="relational")
CATALOG = Catalog({t.name: t for t in (LOAD, HUT, CREW)})
MONDAY = dt.datetime(2031, 3, 3)


def code(fn):
    with pytest.raises(TidelogError) as e:
        fn()
    return e.value.code


@pytest.fixture(scope="module")
def loads(spark):
    day = lambda n, **more: MONDAY + dt.timedelta(days=n, **more)
    rows = [(11, "flour", 250, day(0, hours=6), 1), (12, "salt", 16, day(0, hours=9, minutes=30), 2), (13, "flour", 75, day(2, minutes=1), 1), (14, "lamp oil", 33, day(2, hours=23), 3), (15, "salt", 8, day(2, hours=23, seconds=59), 2), (16, "flour", 125, day(9), 1), (17, "salt", 4, day(9, hours=12), 4)]
    return spark.createDataFrame(rows, LOAD.spark_schema(), verifySchema=False)


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize("text", ["", "SELECT", "SELECT * FROM", "SELECT * FROM t WHERE", "SELECT * FROM t WHERE a > 1", "SELECT * FROM t WHERE a = 1 AND b = 2", "SELECT * FROM t ORDER BY a", "SELECT * FROM t LIMIT 1", "SELECT a AS b FROM t", "SELECT * FROM t JOIN u", "SELECT SUM(*) FROM t", "SELECT UPPER(a) FROM t", "SELECT DATE_TRUNC('century', a) FROM t", "SELECT DATE_TRUNC('1', a) FROM t", "SELECT * FROM t WHERE a = NULL", "SELECT * FROM t WHERE a = 1e5", "SELECT * FROM t WHERE a = :missing", "SELECT * FROM t GROUP BY a", "SELECT COUNT(*) FROM t GROUP BY COUNT(a)", "SELECT * FROM t WHERE a = 99999999999999999999", "SELECT * FROM t WHERE a = 'it''s'"])
def test_refused_text(text):
    assert code(lambda: parse(text)) == "parse_error"


def test_parse_literals():
    value = lambda x, p=None: parse(f"SELECT * FROM t WHERE a = {x}", p).predicate.values[0]
    assert [value("-3"), value("2.5"), value("'x y'"), value("TRUE"), value("false"), value(":p", {"p": 7})] == [-3, 2.5, "x y", True, False, 7]
    assert parse("select a, count(*) from t group by a").is_aggregate
    assert code(lambda: parse_subscription("SELECT COUNT(*) FROM t")) == "parse_error"
    assert parse("SELECT * FROM t WHERE a != 0").predicate.op == "<>"


def test_coercion():
    c = lambda kind: Column("c", kind)
    assert [coerce(c("int32"), x) for x in (1.5, 2.5, None, True)] == [2, 2, 0, 1]
    assert coerce(c("string"), None) is None and coerce(c("bytes"), "AQI=") == b"\1\2"
    assert coerce(c("identity"), "ab" * 32) == b"\xab" * 32 and coerce(c("timestamp"), 1_000_000) == dt.datetime(1970, 1, 1, 0, 0, 1)
    for kind, value in (("uint8", 256), ("int8", -129), ("uint64", -1), ("int32", "x"), ("bool", 1), ("string", 3), ("identity", "ab"), ("int64", float("nan")), ("bytes", "*")):
        assert code(lambda k=kind, v=value: coerce(c(k), v)) == "bad_operand"
    assert json_params({"a": {"$identity": "00" * 32}, "b": {"$bytes": "AQ=="}, "c": {"$timestamp": 0}, "d": 5, "e": {"$interval": 9}}) == {"a": b"\0" * 32, "b": b"\1", "c": dt.datetime(1970, 1, 1), "d": 5, "e": (True, 9)}
    assert code(lambda: json_params({"a": {"$what": 1}})) == "bad_operand"


def test_gates():
    owner = Mode(owner=True)
    go = lambda text, mode=owner, **p: analyze(parse(text, p), CATALOG, mode)
    assert code(lambda: go("SELECT * FROM Nope")) == "unknown_table"
    assert code(lambda: go("SELECT * FROM Crew", Mode())) == "unknown_table"
    assert go("SELECT * FROM Crew").columns == ("No",)
    assert code(lambda: go("SELECT Porter FROM Load")) == "server_only"
    assert code(lambda: go("SELECT * FROM Load WHERE Porter = 1")) == "server_only"
    assert code(lambda: go("SELECT no FROM Load")) == "unknown_column"
    assert code(lambda: go("SELECT * FROM Load WHERE Kilos = 1")) == "unindexed_column"
    assert go("SELECT COUNT(*) FROM Load WHERE Kilos = 1").aggregate
    assert code(lambda: go("SELECT COUNT(*) FROM Load", Mode())) == "owner_required"
    assert code(lambda: go("SELECT COUNT(*) FROM Hut")) == "not_relational"
    assert code(lambda: go("SELECT COUNT(*) FROM Load", Mode(owner=True, relational=False))) == "no_relational_tier"
    assert code(lambda: go("SELECT Goods, COUNT(*) FROM Load")) == "not_grouped"
    assert code(lambda: go("SELECT SUM(Goods) FROM Load")) == "unsupported"
    assert code(lambda: go("SELECT DATE_TRUNC('hour', Kilos) FROM Load GROUP BY DATE_TRUNC('hour', Kilos)")) == "unsupported"
    assert code(lambda: go("SELECT COUNT(*) FROM Load WHERE Kilos <> 0")) == "unsupported"
    assert code(lambda: go("SELECT * FROM Load WHERE Goods = :g", g=None)) == "bad_operand"
    assert go("SELECT * FROM Load WHERE No = :n", n=None).predicate.values == (0,)
    assert code(lambda: go("SELECT * FROM Load WHERE No BETWEEN 0 AND 1025")) == "range_too_wide"
    assert go("SELECT * FROM Load WHERE No BETWEEN 0 AND 1024")
    assert code(lambda: go("SELECT * FROM Load", Mode(require=frozenset({"Load"})))) == "predicate_required"
    assert code(lambda: go("SELECT * FROM Load WHERE No = 1", Mode(require=frozenset({"Load.Goods"})))) == "predicate_required"
    assert go("SELECT Kilos, No, Kilos FROM Load").columns == ("No", "Kilos")


def test_not_default():
    go = lambda text: analyze(parse(text), CATALOG)
    assert go("SELECT * FROM Hut WHERE Open <> FALSE").predicate.values == (False,)
    assert go("SELECT * FROM Hut WHERE Guests != 0").predicate.values == (0,)
    for text in ("Guests <> 1", "Altitude <> 0", "Guests <> 0.0", "Open <> TRUE"):
        assert code(lambda t=text: go(f"SELECT * FROM Hut WHERE {t}")) in ("unsupported", "bad_operand")


def test_aggregates(loads):
    q = lambda text, **p: rows(run_sql(text, CATALOG, lambda _: loads, p))
    assert q("SELECT COUNT(*) FROM Load") == [(7,)]
    assert q("SELECT COUNT(*), SUM(Kilos), MIN(Kilos), MAX(Kilos) FROM Load WHERE Goods = :g", g="salt") == [(3, 28, 4, 16)]
    assert q("SELECT DATE_TRUNC('day', Came), COUNT(*) FROM Load GROUP BY DATE_TRUNC('day', Came)") == [(MONDAY + dt.timedelta(days=n), k) for n, k in ((0, 2), (2, 3), (9, 2))]
    assert q("SELECT DATE_TRUNC('week', Came), SUM(Kilos) FROM Load GROUP BY DATE_TRUNC('week', Came)") == [(MONDAY, 382), (MONDAY + dt.timedelta(days=7), 129)]
    assert q("SELECT Goods, AVG(Kilos) FROM Load GROUP BY Goods") == [("flour", 150.0), ("lamp oil", 33.0), ("salt", 28 / 3)]
    assert q("SELECT COUNT(*), SUM(Kilos) FROM Load WHERE Goods = 'ice'") == [(0, None)]
    assert q("SELECT COUNT(*) FROM Load GROUP BY Goods") == [(3,), (1,), (3,)]
    assert run_sql("SELECT MAX(Came) FROM Load", CATALOG, lambda _: loads).columns == ["max_Came"]
    assert q("SELECT No, Goods FROM Load WHERE No BETWEEN 13 AND 12") == []
    assert q("SELECT Goods, No FROM Load WHERE Goods = 'salt'") == [(12, "salt"), (15, "salt"), (17, "salt")]


def test_ceilings(loads):
    assert checked_size(loads.select(*LOAD.visible), LOAD, 7)
    assert code(lambda: checked_size(loads.select(*LOAD.visible), LOAD, 6)) == "too_many_rows"
    assert code(lambda: checked_size(loads.select(*LOAD.visible), LOAD, 7, 10)) == "too_many_bytes"


def test_schema_rules():
    c = Column
    bad = lambda *cols, **o: code(lambda: Table("t", cols, **o))
    pk = c("id", "int64", primary=True)
    assert bad(c("a", "int32")) == bad(pk, c("b", "int64", primary=True)) == bad(c("f", "float64", primary=True)) == "bad_schema"
    assert bad(pk, c("a", "int32", autoinc=True)) == bad(pk, c("a", "float32", indexed=True)) == bad(pk, c("a", "decimal")) == "bad_schema"
    assert bad(pk, shard_by="id") == bad(pk, shard_by="x") == bad(pk, c("u", "string", unique=True), placement="partitioned") == bad(pk, scheduled="tick") == "bad_schema"
    timer = Table("t", (pk, c("due", "scheduleat")), scheduled="tick", placement="partitioned")
    assert not timer.public and timer.placement == "local"
    assert '"orders"' in star_schema().manifest() and "Crew" not in CATALOG.manifest() and "Porter" not in CATALOG.manifest()


def test_filters_reach_the_scan(spark):
    from tidelog.sources.tables import read_table

    cat = star_schema()
    df = run_sql("SELECT event_id, user_id FROM events WHERE user_id BETWEEN 5 AND 9", cat, lambda t: read_table(spark, "/root/testdata/sf0.001", t, cat))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(user_id,5)" in plan and "ReadSchema: struct<event_id:bigint,user_id:bigint>" in plan
