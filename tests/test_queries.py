"""Every query with SQL gives what DuckDB gives on the same files."""

import decimal
import math

import duckdb
import pytest

from tidelog import queries as core

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("set timezone = 'UTC'")
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, decimal.Decimal):
        return int(v) if v == int(v) else float(v)
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    return bytes(v) if isinstance(v, bytearray) else v


@pytest.mark.parametrize("name", sorted(core.oracle_sql()))
def test_like_duckdb(spark, duck, name):
    df = core.queries()[name](spark, FOLDER)
    want = duck.sql(core.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    got = sorted((tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=repr)
    at = [want.columns.index(c) for c in sorted(df.columns)]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())


def test_catch_up_of_every_due_timer(spark):
    """As a loop has it, timers overdue for more than ten minutes included."""
    ev = core.read_table(spark, FOLDER, "events").selectExpr("event_id", "unix_micros(cast(ts as timestamp)) as at").collect()
    want = []
    for r in ev:
        step = 1_000_000 * (1 + r["event_id"] % 50) if r["event_id"] % 3 == 0 else None
        due = r["at"] + step if step else 1704067200000000 + r["event_id"] * 1_000_000
        if due <= core.NOW:
            want += [(r["event_id"], f) for f in (range(due, core.NOW + 1, step) if step else [due])]
    assert any(f <= core.NOW - 600_000_000 for _, f in want)
    assert sorted(tuple(r) for r in core.queries()["q_timer_catchup"](spark, FOLDER).collect()) == sorted(want)


def test_no_query_leaves_rows_out():
    """Every query has SQL, and none of its tables is thinned out by a modulo filter."""
    import re

    sql = core.oracle_sql()
    assert set(sql) == set(core.queries())
    assert not [n for n, x in sql.items() if re.search(r"from (orders|events|part|customer|lineitem)\s+where\s+\w+ %", x)]


def test_overlay_moves_no_base_rows(spark):
    from tidelog.operators import views

    base = spark.range(1000).selectExpr("id as k", "id as v")
    pending = spark.createDataFrame([(3, 9, 2), (5, None, 3)], "k long, v long, op int")
    plan = views.overlay(base, pending, "k", small=True)._jdf.queryExecution().executedPlan().toString()
    assert "FullOuter" not in plan and "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
