"""Every operator of the engine as a query over the test tables, with the same thing in DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.catalog import Column, Table, star_schema
from tidelog.functions.keys import identity
from tidelog.operators import bulk, changelog, evolve, policies, shards, subscriptions, timers, views
from tidelog.plans.compile import row_bytes, run_sql
from tidelog.sources.scratch import scratch_folder
from tidelog.sources.tables import events_log, read_table

CATALOG = star_schema()
_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}

LOG = """with numbered as (select *, row_number() over (partition by user_id order by event_id) as n from events),
log as (select event_id + 1 as lsn, 0::bigint as ordinal, case when n = 1 or n % 5 = 1 then 1 when n % 5 = 0 then 3 else 2 end as op, user_id, event_type, value from numbered),
pre as (select *, lag(op) over w as old_op, lag(event_type) over w as old_type, lag(value) over w as old_value from log window w as (partition by user_id order by lsn, ordinal)),
ranked as (select *, row_number() over (partition by user_id order by lsn desc, ordinal desc) as rn from log),
state as (select user_id, event_type, value, lsn from ranked where rn = 1 and op <> 3)
"""


def query(sql: str | None = None, name: str | None = None):
    def register(fn):
        key = name or fn.__name__
        _queries[key] = fn
        if sql is not None:
            _sql[key] = sql
        return fn

    return register


def declared(text: str, sql: str, name: str, params: dict | None = None) -> None:
    """A query of the SQL subset."""
    query(sql, name)(lambda spark, d: run_sql(text, CATALOG, lambda t: read_table(spark, d, t, CATALOG), params))


def _view(spark: SparkSession, d: str, name: str) -> views.View:
    return views.View(CATALOG.get(name), read_table(spark, d, name, CATALOG))


# scans and lookups
NATION = "select n_nationkey, n_name, n_regionkey from nation"
query(NATION, "q_scan_all")(lambda s, d: _view(s, d, "nation").scan())
query("select o_orderkey, o_custkey, o_totalprice from orders where o_orderkey = 7", "q_point_lookup")(lambda s, d: _view(s, d, "orders").find(7).select("o_orderkey", "o_custkey", "o_totalprice"))
query("select event_id, user_id, event_type from events where event_type = 'signup'", "q_index_eq")(lambda s, d: _view(s, d, "events").filter("event_type", "signup").select("event_id", "user_id", "event_type"))
query("select event_id, user_id from events where user_id between 10 and 20", "q_index_range")(lambda s, d: _view(s, d, "events").filter_range("user_id", 10, 20).select("event_id", "user_id"))
query("select o_orderkey, o_totalprice from orders where o_orderkey between 100 and 300", "q_pk_range")(lambda s, d: _view(s, d, "orders").filter_range("o_orderkey", 100, 300).select("o_orderkey", "o_totalprice"))
query("select p_partkey from part", "q_scan_keys")(lambda s, d: _view(s, d, "part").keys())
query('select count(*) as "count" from orders', "q_count")(lambda s, d: _view(s, d, "orders").count())
query('select count(*) > 0 as "any" from supplier', "q_any")(lambda s, d: _view(s, d, "supplier").any())
query("select c_custkey, c_name from customer order by c_custkey limit 1", "q_first")(lambda s, d: _view(s, d, "customer").first().select("c_custkey", "c_name"))

# the SQL subset: rows
declared("SELECT * FROM nation", NATION, "q_select_star")
declared("SELECT o_totalprice, o_orderkey, o_orderkey FROM orders WHERE o_orderstatus = 'F'", "select o_orderkey, o_totalprice from orders where o_orderstatus = 'F'", "q_project")
declared("SELECT * FROM part WHERE p_brand = 'Brand#1'", "select p_partkey, p_name, p_brand, p_type, p_size, p_retailprice from part where p_brand = 'Brand#1'", "q_where_eq")
declared("SELECT event_id, user_id, value FROM events WHERE user_id BETWEEN 5 AND 9", "select event_id, user_id, value from events where user_id between 5 and 9", "q_where_between")
declared("SELECT * FROM labels WHERE toxic <> 0", "select doc_id, quality, toxic from labels where toxic <> 0", "q_where_not_default")
declared("SELECT event_id, event_type FROM events WHERE user_id = :u", "select event_id, event_type from events where user_id = 12", "q_params", {"u": 12})


@query("select p_partkey, case when p_size > 25 then p_size end as size from part where case when p_size > 25 then p_size end = 30")
def q_null_never_matches(spark, d):
    df = read_table(spark, d, "part").select("p_partkey", F.when(F.col("p_size") > 25, F.col("p_size")).alias("size"))
    table = Table("part", (Column("p_partkey", "int64", primary=True), Column("size", "int32", indexed=True)))
    return views.View(table, df).filter("size", 30)


# the SQL subset: aggregates
declared("SELECT COUNT(*) FROM events", 'select count(*) as "count" from events', "q_agg_count_star")
declared("SELECT COUNT(props) FROM events", "select count(props) as count_props from events", "q_agg_count_col")
declared("SELECT SUM(user_id), SUM(event_id) FROM events", "select sum(user_id)::bigint as sum_user_id, sum(event_id)::bigint as sum_event_id from events", "q_agg_sum")
declared("SELECT AVG(p_size) FROM part", "select avg(p_size) as avg_p_size from part", "q_agg_avg")
declared("SELECT MIN(value), MAX(value), MIN(ts), MAX(event_type) FROM events", "select min(value) as min_value, max(value) as max_value, min(ts) as min_ts, max(event_type) as max_event_type from events", "q_agg_min_max")
declared("SELECT event_type, COUNT(*), SUM(user_id) FROM events GROUP BY event_type", 'select event_type, count(*) as "count", sum(user_id)::bigint as sum_user_id from events group by event_type', "q_group_by")
declared("SELECT o_orderstatus, o_orderpriority, COUNT(*) FROM orders GROUP BY o_orderstatus, o_orderpriority", 'select o_orderstatus, o_orderpriority, count(*) as "count" from orders group by all', "q_group_by_multi")
for _unit in ("minute", "hour", "day", "week", "month", "year"):
    declared(f"SELECT DATE_TRUNC('{_unit}', ts), COUNT(*), MAX(user_id) FROM events GROUP BY DATE_TRUNC('{_unit}', ts)", f"select date_trunc('{_unit}', ts)::timestamp as ts, count(*) as \"count\", max(user_id) as max_user_id from events group by 1", f"q_bucket_{_unit}")
declared("SELECT DATE_TRUNC('hour', ts), event_type, COUNT(*), MIN(value) FROM events GROUP BY DATE_TRUNC('hour', ts), event_type", "select date_trunc('hour', ts)::timestamp as ts, event_type, count(*) as \"count\", min(value) as min_value from events group by 1, 2", "q_bucket_group")
declared("SELECT event_type FROM events GROUP BY event_type", "select distinct event_type from events", "q_group_distinct")
declared("SELECT COUNT(*), SUM(user_id), MIN(ts) FROM events WHERE user_id = -1", 'select count(*) as "count", sum(user_id)::bigint as sum_user_id, min(ts) as min_ts from events where user_id = -1', "q_agg_global_empty")
declared("SELECT COUNT(*) FROM events GROUP BY user_id", 'select count(*) as "count" from events group by user_id', "q_group_unselected")
declared("SELECT p_brand, AVG(p_size) FROM part GROUP BY p_brand", "select p_brand, avg(p_size) as avg_p_size from part group by 1 order by 1 nulls last", "q_group_order")
declared("SELECT event_type, COUNT(*) FROM events WHERE value BETWEEN 10 AND 50 GROUP BY event_type", 'select event_type, count(*) as "count" from events where value between 10 and 50 group by 1', "q_agg_filtered")


@query("select 'orders' as name, count(*) as rows, sum(8 + 8 + strlen(o_orderstatus) + 5 + 8 + 8 + strlen(o_orderpriority) + 5)::bigint as bytes from orders")
def q_table_stats(spark, d):
    t = CATALOG.get("orders")
    df = read_table(spark, d, "orders", CATALOG)
    return df.agg(F.count(F.lit(1)).alias("rows"), F.sum(row_bytes(t)).cast("long").alias("bytes")).select(F.lit("orders").alias("name"), "rows", "bytes")


# the change log
@query(LOG + "select user_id, event_type, value from state")
def q_state_fold(spark, d):
    return changelog.fold(events_log(spark, d), ["user_id"]).drop("lsn")


@query(LOG + ", r as (select *, row_number() over (partition by user_id order by lsn desc) as k from log where lsn <= 500) select user_id, event_type, value from r where k = 1 and op <> 3")
def q_as_of(spark, d):
    return changelog.as_of(events_log(spark, d), 500, ["user_id"]).drop("lsn")


query(LOG + "select min(lsn) as first, max(lsn) as last, count(distinct lsn) as records, max(lsn) - min(lsn) + 1 = count(distinct lsn) as contiguous from log", "q_log_contiguity")(lambda s, d: changelog.contiguity(events_log(s, d)))
query(LOG + "select lsn, ordinal, op, user_id, event_type, value, old_op, old_value from pre", "q_preimage")(lambda s, d: changelog.preimages(events_log(s, d), ["user_id"]).select("lsn", "ordinal", "op", "user_id", "event_type", "value", "old_op", F.col("old.value").alias("old_value")))


@query(
    LOG
    + """, t as (select lsn // 100 as txn, lsn, op, user_id, value from log),
f as (select txn, user_id, arg_min(op, lsn) as f, arg_max(op, lsn) as l, min(lsn) as ordinal, arg_max(value, lsn) as value from t group by txn, user_id)
select txn, user_id, ordinal, case when f = 1 then 1 when l = 3 then 3 else 2 end as op, value from f where not (f = 1 and l = 3)"""
)
def q_collapse(spark, d):
    t = events_log(spark, d).select(F.floor(F.col("lsn") / 100).alias("txn"), F.col("lsn").alias("ordinal"), "op", "user_id", "value")
    return changelog.collapse(t, ["user_id"]).select("txn", "user_id", "ordinal", "op", "value")


def _batch(spark, d):
    """Two later prices of finished orders, one of all others, and an order with a new key for each; open orders are to be deleted where ops are asked for."""
    o = read_table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    later = o.withColumn("o_totalprice", F.col("o_totalprice") + 1).withColumn("seq", F.lit(1))
    again = o.withColumn("o_totalprice", F.col("o_totalprice") + F.when(F.col("o_orderstatus") == "F", 2).otherwise(1)).withColumn("seq", F.lit(2))
    return later.unionByName(again).unionByName(o.withColumn("o_orderkey", F.col("o_orderkey") + 100_000_000).withColumn("seq", F.lit(1)))


BATCH = """with o as (select o_orderkey, o_totalprice, o_orderstatus from orders),
batch as (select o_orderkey, o_totalprice + 1 as o_totalprice, o_orderstatus, 1 as seq from o
union all select o_orderkey, o_totalprice + case when o_orderstatus = 'F' then 2 else 1 end, o_orderstatus, 2 from o
union all select o_orderkey + 100000000, o_totalprice, o_orderstatus, 1 from o),
last as (select * from (select *, row_number() over (partition by o_orderkey order by seq desc) as k from batch) where k = 1)
"""


@query(BATCH + "select o_orderkey, o_totalprice from last union all select o_orderkey, o_totalprice from orders where o_orderkey not in (select o_orderkey from last)")
def q_bulk_upsert(spark, d):
    return changelog.upsert(read_table(spark, d, "orders").select("o_orderkey", "o_totalprice"), _batch(spark, d).drop("o_orderstatus"), ["o_orderkey"], "seq")


@query(BATCH + "select o_orderkey % 7 as shard, 101::bigint as lsn, count(*) as rows from batch group by 1")
def q_bulk_route(spark, d):
    return bulk.route(_batch(spark, d).withColumn("shard", F.col("o_orderkey") % 7), scratch_folder(spark, "shards"), 100)


@query(
    BATCH
    + """, ops as (select o_orderkey, seq, case when o_orderstatus = 'P' then 3 else 2 end as op from batch),
j as (select ops.*, orders.o_orderkey is not null as known, lag(op) over (partition by ops.o_orderkey order by seq) as before from ops left join orders using (o_orderkey)),
t as (select *, case when before is not null then before <> 3 else known end as there from j)
select o_orderkey, seq, case when op = 3 then 3 when there then 2 else 1 end as op from t where op <> 3 or there"""
)
def q_reconcile(spark, d):
    ops = _batch(spark, d).select("o_orderkey", "seq", F.when(F.col("o_orderstatus") == "P", 3).otherwise(2).alias("op"))
    return changelog.reconcile(read_table(spark, d, "orders").select("o_orderkey"), ops, ["o_orderkey"], "seq").select("o_orderkey", "seq", "op")


PENDING = BATCH + ", pending as (select o_orderkey, o_totalprice, case when o_orderstatus = 'P' then 3 else 2 end as op from last), merged as (select coalesce(p.o_orderkey, o.o_orderkey) as o_orderkey, case when p.op is not null then p.o_totalprice else o.o_totalprice end as o_totalprice from orders o full join pending p on o.o_orderkey = p.o_orderkey where p.op is null or p.op <> 3)\n"


def _pending(spark, d):
    last = _batch(spark, d).groupBy("o_orderkey").agg(F.max_by("o_totalprice", "seq").alias("o_totalprice"), F.first("o_orderstatus").alias("status"))
    return last.select("o_orderkey", "o_totalprice", F.when(F.col("status") == "P", 3).otherwise(2).alias("op"))


@query(PENDING + "select * from merged")
def q_overlay_merge(spark, d):
    return views.overlay(read_table(spark, d, "orders").select("o_orderkey", "o_totalprice"), _pending(spark, d), "o_orderkey")


@query(PENDING + "select * from merged where o_orderkey between 50 and 90")
def q_overlay_filter(spark, d):
    return q_overlay_merge(spark, d).filter(F.col("o_orderkey").between(50, 90))


@query("select o_custkey, o_orderkey from orders where o_custkey in (select o_custkey from orders group by 1 having count(distinct o_orderkey) > 1)")
def q_unique_violations(spark, d):
    return views.unique_violations(read_table(spark, d, "orders").select("o_custkey", "o_orderkey"), "o_orderkey", "o_custkey")


@query("select p_partkey, (5::bigint << 47) + 10 + row_number() over (order by p_partkey) as id from part where p_size <= 25 union all select p_partkey, p_size::bigint from part where p_size > 25")
def q_autoinc(spark, d):
    rows = read_table(spark, d, "part").select("p_partkey", F.when(F.col("p_size") > 25, F.col("p_size")).otherwise(0).cast("long").alias("id"))
    return changelog.autoinc(rows, "id", 5, 10, ["p_partkey"])


@query(LOG + ", c(name, applied) as (values ('a', 10), ('b', 100)) select name, (select max(lsn) from log) - applied as lag from c")
def q_applier_lag(spark, d):
    return changelog.applier_lag(events_log(spark, d), spark.createDataFrame([("a", 10), ("b", 100)], "name string, applied long"))


# subscriptions
def _clicks(c):
    return c("event_type") == "click"


@query(LOG + "select user_id, event_type, value from state where event_type = 'click'")
def q_initial_set(spark, d):
    log = events_log(spark, d)
    return subscriptions.initial_set(log, 1 << 40, ["user_id"], _clicks)


DELTA = """, flagged as (select *, coalesce(old_op in (1, 2) and old_type = 'click', false) as was, op <> 3 and event_type = 'click' as now from pre),
delta as (select lsn, ordinal, case when now and not was then 1 when now then 2 when was then 3 end as delta, user_id, event_type, value, old_type, old_value from flagged where was or now)
"""


@query(LOG + DELTA + "select lsn, ordinal, delta, user_id, case when delta <> 3 then event_type end as event_type, case when delta <> 3 then value end as value from delta")
def q_delta_predicate_crossing(spark, d):
    return subscriptions.deltas(events_log(spark, d), ["user_id"], _clicks)


@query(LOG + DELTA + "select lsn, ordinal, delta, user_id, case when delta <> 3 then event_type end as event_type from delta where not (delta = 2 and event_type is not distinct from old_type)")
def q_delta_projection_silent(spark, d):
    return subscriptions.deltas(events_log(spark, d), ["user_id"], _clicks, columns=["event_type"])


@query(
    LOG
    + """, many as (select lsn // 50 as lsn, lsn as ordinal, op, user_id, event_type, value from log),
p as (select *, lag(op) over w as old_op, lag(event_type) over w as old_type from many window w as (partition by user_id order by lsn, ordinal)),
flagged as (select *, coalesce(old_op in (1, 2) and old_type = 'click', false) as was, op <> 3 and event_type = 'click' as now from p)
select lsn, ordinal, case when now and not was then 1 when now then 2 when was then 3 end as delta, user_id from flagged where was or now"""
)
def q_delta_chain(spark, d):
    log = events_log(spark, d).select(F.floor(F.col("lsn") / 50).alias("lsn"), F.col("lsn").alias("ordinal"), "op", "user_id", "event_type", "value")
    return subscriptions.deltas(log, ["user_id"], _clicks).select("lsn", "ordinal", "delta", "user_id")


@query(
    LOG
    + """, s(sub, value) as (values (1, 'click'), (2, 'view'), (3, 'click')),
f as (select sub, lsn, ordinal, user_id, coalesce(old_op in (1, 2) and old_type = s.value, false) as was, op <> 3 and event_type = s.value as now from pre, s)
select sub, lsn, ordinal, user_id, case when not now then 3 when was then 2 else 1 end as delta from f where was or now"""
)
def q_fanout(spark, d):
    log = events_log(spark, d).select("lsn", "ordinal", "op", "user_id", F.col("event_type").alias("value"))
    return subscriptions.fanout(log, spark.createDataFrame([(1, "click"), (2, "view"), (3, "click")], "sub int, value string"), ["user_id"])


@query("select 1 as delta, event_id from events where event_id between 5 and 12 and event_id not between 0 and 7 union all select 3, event_id from events where event_id between 0 and 7 and event_id not between 5 and 12")
def q_rescope_diff(spark, d):
    return subscriptions.rescope(read_table(spark, d, "events"), "event_id", F.col("event_id").between(0, 7), F.col("event_id").between(5, 12))


@query("with s as (select case when o_orderstatus = 'F' then o_orderkey + 100000000 else o_orderkey end as o_orderkey from orders) select 2 as op, o_orderkey from s union all select 3, o_orderkey from orders where o_orderkey not in (select o_orderkey from s)")
def q_reset_reconcile(spark, d):
    """A snapshot in which finished orders have other keys than the client knows."""
    o = read_table(spark, d, "orders")
    now = o.select(F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey") + 100_000_000).otherwise(F.col("o_orderkey")).alias("o_orderkey"))
    return subscriptions.reset_reconcile(o.select("o_orderkey"), now, ["o_orderkey"])


@query(LOG + "select lsn, ordinal, case when op = 3 then 3 when event_type = 'click' then op else 3 end as delta, user_id from log where lsn > 600 and (op = 3 or event_type = 'click' or op = 2)")
def q_resume_replay(spark, d):
    return subscriptions.resume(events_log(spark, d), 600, ["user_id"], _clicks)


@query(
    LOG
    + """, scoped as (select user_id, event_type, value from state where event_type in ('view', 'click'))
select user_id, event_type, value from scoped"""
)
def q_initial_plus_delta_equals_head(spark, d):
    """A client that has clicks as of lsn 500, their deltas since, and then a new scope with views too: what it holds is the state at the head."""
    log, keys = events_log(spark, d), ["user_id"]
    wider = lambda c: c("event_type").isin("view", "click")
    sent = subscriptions.deltas(log, keys, _clicks).withColumn("arrival", F.col("lsn"))
    state = changelog.fold(log, keys).drop("lsn")
    diff = subscriptions.rescope(state, "user_id", _clicks(F.col), wider(F.col)).join(state, "user_id")
    diff = diff.select(F.lit(0).cast("long").alias("lsn"), F.lit(0).cast("long").alias("ordinal"), "delta", "user_id", "event_type", "value", F.lit(1 << 40).alias("arrival"))
    return subscriptions.client_state(subscriptions.initial_set(log, 500, keys, _clicks), sent.unionByName(diff), 500, keys)


@query(
    """with b as (select user_id % 4 as sub, case when event_type = 'view' then user_id + 200000 else user_id end as key, max(value) as value from events group by 1, 2),
a as (select user_id % 3 as sub, case when event_type = 'signup' then user_id + 100000 else user_id end as key, max(value) as value from events group by 1, 2),
ob as (select key, count(distinct sub) as n, max(value) as v from b group by key), oa as (select key, count(distinct sub) as n, max(value) as v from a group by key)
select coalesce(ob.key, oa.key) as key, case when ob.n is null then 1 when oa.n is null then 3 else 2 end as change, coalesce(oa.n, 0) as refs from ob full join oa on ob.key = oa.key where ob.n is null or oa.n is null or ob.v is distinct from oa.v"""
)
def q_cache_refcount(spark, d):
    """Views move to keys of their own before, signups after."""
    ev, u = read_table(spark, d, "events"), F.col("user_id")
    side = lambda kind, by, k: ev.groupBy((u % k).alias("sub"), F.when(F.col("event_type") == kind, u + by).otherwise(u).alias("key")).agg(F.max("value").alias("value"))
    return subscriptions.cache_changes(side("view", 200_000, 4), side("signup", 100_000, 3), "key")


@query("select event_id, ((sum(bytes) over (order by event_id) - bytes) // 4096)::bigint as chunk from (select event_id, 40 + strlen(props) as bytes from events)")
def q_chunking(spark, d):
    sized = read_table(spark, d, "events").select("event_id", (F.octet_length("props") + 40).alias("bytes"))
    return subscriptions.chunks(sized, "event_id", budget=4096).select("event_id", "chunk")


# consumers and timers
@query("select 's' || user_id as name from (select user_id, (epoch_us(max(ts)) // 1000000)::bigint as touched from events group by 1) where user_id % 5 <> 0 and 1706600000 - touched > 3600")
def q_expired_subscribers(spark, d):
    ev = read_table(spark, d, "events")
    seen = ev.groupBy("user_id").agg(F.unix_timestamp(F.max("ts").cast("timestamp")).alias("touched")).select(F.concat(F.lit("s"), F.col("user_id")).alias("name"), "user_id", "touched")
    return timers.expired(seen, seen.filter("user_id % 5 = 0"), 1706600000, 3600).select("name")


TIMER = "with t as (select event_id as id, event_id % 3 = 0 as is_interval, case when event_id % 3 = 0 then 1000000 * (1 + event_id % 50) else 1704067200000000 + event_id * 1000000 end as micros, epoch_us(ts) as t0 from events), due as (select id, case when is_interval then t0 + micros else micros end as due, case when is_interval then micros end as step from t)\n"


def _timers(spark, d):
    i = F.col("event_id")
    every = i % 3 == 0
    t = read_table(spark, d, "events").select(i.alias("id"), every.alias("is_interval"), F.when(every, 1_000_000 * (1 + i % 50)).otherwise(F.lit(1704067200000000) + i * 1_000_000).alias("micros"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return t.select("id", timers.due(F.col("is_interval"), F.col("micros"), F.col("at")).alias("due"), F.when(F.col("is_interval"), F.col("micros")).alias("interval"))


query(TIMER + "select id, due from due", "q_timer_due")(lambda s, d: _timers(s, d).select("id", "due"))
NOW = 1704067200000000 + 3600 * 1_000_000


@query(TIMER + f"select id, (({NOW} - due) // step)::bigint as missed, {NOW} + step as skip, {NOW}::bigint as coalesce, due + step as run from due where step is not null and due <= {NOW}")
def q_timer_overrun(spark, d):
    t, now = _timers(spark, d).filter(F.col("interval").isNotNull() & (F.col("due") <= NOW)), F.lit(NOW)
    due, step = F.col("due"), F.col("interval")
    return t.select("id", timers.missed(due, step, now).alias("missed"), *(timers.overrun(due, step, now, p).cast("long").alias(n) for p, n in ((timers.SKIP, "skip"), (timers.COALESCE, "coalesce"), (timers.RUN, "run"))))


@query(TIMER + f"select id, unnest(case when step is null then [due] else range(due, {NOW} + 1, step) end) as fires from due where due <= {NOW}")
def q_timer_catchup(spark, d):
    """Every due timer, however long it is overdue."""
    return timers.catch_up(_timers(spark, d), NOW, every=True)


@query(
    """with recursive c as (select user_id, event_id as n, epoch_us(ts) / 1e9 as t, row_number() over (partition by user_id order by ts, event_id) as k from events),
r as (select user_id, n, t, k, 3.0::double as have from c where k = 1
union all select c.user_id, c.n, c.t, c.k, least(3.0::double, (case when r.have >= 1 then r.have - 1 else r.have end) + (c.t - r.t) * 0.01::double) from r join c on c.user_id = r.user_id and c.k = r.k + 1)
select user_id, n, t as "at", have >= 1 as allowed from r"""
)
def p_rate_limit(spark, d):
    """Events as calls, a hundred days in one second's scale, so that buckets run dry."""
    ev = read_table(spark, d, "events")
    calls = ev.select("user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e9).alias("at"), F.col("event_id").alias("n"))
    return timers.rate_limited(calls, ["user_id"], rate=0.01, burst=3.0)


query(TIMER + f"select id, due from due where due <= {NOW} - 3000000000", "p_timer_dispatch")(lambda s, d: timers.dispatch_order(_timers(s, d), NOW - 3_000_000_000).select("id", "due"))


@query(BATCH + "select o_orderkey, seq, case when row_number() over (partition by o_orderkey order by seq) > 1 or o_orderkey in (select o_orderkey from orders) then 2 else 1 end as op from batch")
def q_upsert_ops(spark, d):
    return changelog.upsert_ops(read_table(spark, d, "orders").select("o_orderkey"), _batch(spark, d).drop("o_orderstatus"), ["o_orderkey"], "seq").select("o_orderkey", "seq", "op")


# visibility
@query("select o_orderkey, o_custkey from orders where o_orderstatus = 'F' or o_custkey = 7")
def q_row_policy_union(spark, d):
    return policies.visible_rows(read_table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), [F.col("o_orderstatus") == "F", F.col("o_custkey") == 7]).select("o_orderkey", "o_custkey")


@query("select c_custkey, c_name, case when c_nationkey = 3 and c_custkey % 2 = 0 then c_acctbal end as c_acctbal, case when c_custkey % 2 = 0 then c_mktsegment end as c_mktsegment from customer")
def q_column_mask(spark, d):
    df = read_table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment", "c_nationkey")
    all_, m = policies.Mask.all(), policies.Mask
    out = policies.masked(df, [(F.col("c_nationkey") == 3, all_, all_.excluding("c_acctbal")), (F.col("c_custkey") % 2 == 0, all_, m.only("c_name"))], always=["c_custkey"])
    return out.select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")


@query("select o_orderkey, o_custkey from orders where o_custkey in (select c_custkey from customer where c_mktsegment = 'BUILDING')")
def q_policy_semi_join(spark, d):
    members = read_table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return policies.admitted(read_table(spark, d, "orders").select("o_orderkey", "o_custkey"), members, "o_custkey")


@query(LOG + ", f as (select *, coalesce(old_op in (1, 2) and old_value > 50, false) as was, op <> 3 and value > 50 as now from pre) select lsn, ordinal, case when now and not was then 1 when now then 2 else 3 end as delta, user_id from f where was or now")
def q_policy_delta(spark, d):
    return subscriptions.deltas(events_log(spark, d), ["user_id"], lambda c: c("value") > 50).select("lsn", "ordinal", "delta", "user_id")


# placement
CHUNKS = "with c as (select event_id as id, (user_id * 7 % 101 - 50)::bigint as x, (event_id % 83 - 41)::bigint as y from events), b as (select *, floor(x / 16.0)::bigint as bx, floor(y / 16.0)::bigint as cy from c)\n"


def _chunks(spark, d):
    return read_table(spark, d, "events").select(F.col("event_id").alias("id"), (F.col("user_id") * 7 % 101 - 50).cast("long").alias("x"), (F.col("event_id") % 83 - 41).cast("long").alias("y"))


query(CHUNKS + "select id, bx * 4294967296 + (cy & 4294967295) as shard from b", "q_shard_of_chunk")(lambda s, d: shards.spatial(_chunks(s, d), F.col("x"), F.col("y"), 16).select("id", "shard"))
query("select event_id, user_id as shard from events", "q_shard_instancing")(lambda s, d: shards.instancing(read_table(s, d, "events"), "user_id").select("event_id", "shard"))


@query(CHUNKS + ", u as (select distinct bx, cy from b), o as (select dx::bigint as dx, dy::bigint as dy from range(-1, 2) t(dx), range(-1, 2) s(dy) where dx <> 0 or dy <> 0) select bx * 4294967296 + (cy & 4294967295) as shard, (bx + dx) * 4294967296 + ((cy + dy) & 4294967295) as neighbour from u, o")
def q_neighbours(spark, d):
    return shards.neighbours(shards.spatial(_chunks(spark, d), F.col("x"), F.col("y"), 16).select("shard", "bx", "by").distinct())


@query("select id // 20 as txn, count(distinct shard) as shards from (" + CHUNKS + "select id, bx * 4294967296 + (cy & 4294967295) as shard from b) group by 1 having count(distinct shard) > 1")
def q_shard_span(spark, d):
    placed = shards.spatial(_chunks(spark, d), F.col("x"), F.col("y"), 16).withColumn("txn", F.floor(F.col("id") / 20))
    return shards.spanning(placed)


@query(
    CHUNKS
    + """, o as (select dx, dy from range(-1, 2) t(dx), range(-1, 2) s(dy) where dx <> 0 or dy <> 0), n as (select id, x, y, bx, cy, bx + dx as ox, cy + dy as oy from b, o)
select id, bx * 4294967296 + (cy & 4294967295) as owner, ox * 4294967296 + (oy & 4294967295) as observer from n
where greatest(ox * 16 - x, x - (ox * 16 + 15), oy * 16 - y, y - (oy * 16 + 15), 0) <= 2"""
)
def q_border_band(spark, d):
    return shards.border_band(_chunks(spark, d), "id", 16)


@query(LOG + ", f as (select *, op <> 3 and value > 50 as now from log), h as (select *, coalesce(lag(now) over (partition by user_id order by lsn), false) as had from f) select lsn, user_id, case when now and had then 2 when now then 1 else 3 end as ship from h where now or had")
def q_border_stream(spark, d):
    return shards.border_stream(events_log(spark, d).withColumn("in_scope", F.col("value") > 50), ["user_id"]).select("lsn", "user_id", "ship")


@query(
    """with l as (select case when o_orderstatus = 'F' then o_orderkey + 100000000 else o_orderkey end as key, case when o_orderkey % 4 = 0 then 9 when o_orderkey % 4 = 1 then 8 end as owner from orders), s as (select o_orderkey as key, case when o_orderkey % 2 = 0 then 3 else 2 end as op, 9 as owner from orders),
j as (select s.*, l.key is not null as here, l.owner as mine from s left join l using (key))
select key, case when op = 3 then 3 when here then 2 else 1 end as op, owner from j where case when op = 3 then here and mine = owner else not here or mine is not null end"""
)
def q_border_apply(spark, d):
    """Finished orders have other keys here than where they come from."""
    k = F.col("o_orderkey")
    o = read_table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    here = F.when(F.col("o_orderstatus") == "F", k + 100_000_000).otherwise(k)
    local = o.select(here.alias("key"), F.when(k % 4 == 0, 9).when(k % 4 == 1, 8).alias("owner"))
    return shards.border_apply(local, o.select(k.alias("key"), F.when(k % 2 == 0, 3).otherwise(2).alias("op"), F.lit(9).alias("owner")), "key")


@query(
    CHUNKS
    + """, h as (select id, x, y, 0 as hx, 0 as hy from c), d as (select id, greatest(hx * 16 - x, x - (hx * 16 + 15), hy * 16 - y, y - (hy * 16 + 15), 0) as depth, least(x - hx * 16, hx * 16 + 15 - x, y - hy * 16, hy * 16 + 15 - y) as inner_ from h)
select id, depth, case when depth > 1 then 'crossed' when depth > 0 or inner_ < 1 then 'approaching' else 'interior' end as state from d"""
)
def q_boundary(spark, d):
    return shards.boundary(_chunks(spark, d).withColumn("home_x", F.lit(0)).withColumn("home_y", F.lit(0)), "id", 16)


LOAD = "with load as (select 'n' || (user_id % 6) as node, user_id as shard, count(*) as load from events group by 1, 2), n as (select node, sum(load) as load from load group by 1)\n"


@query(LOAD + "select (select node from n order by load desc, node limit 1) as hottest, (select node from n order by load, node limit 1) as coolest")
def q_rebalance_pick(spark, d):
    load = read_table(spark, d, "events").groupBy(F.concat(F.lit("n"), F.col("user_id") % 6).alias("node"), F.col("user_id").alias("shard")).agg(F.count(F.lit(1)).alias("load"))
    return shards.rebalance_pick(load)


@query(
    LOAD
    + """, hot as (select node, load from n order by load desc, node limit 1), cool as (select node, load from n where node <> (select node from hot) order by load, node limit 1)
select shard, load.node as origin, cool.node as target, load.load from load, hot, cool
where load.node = hot.node and hot.load > 10 and load.load > 0 and cool.load + load.load < hot.load and (select count(*) from load where node = (select node from hot)) > 1 order by load.load desc, shard limit 1"""
)
def q_rebalance_move(spark, d):
    load = read_table(spark, d, "events").groupBy(F.concat(F.lit("n"), F.col("user_id") % 6).alias("node"), F.col("user_id").alias("shard")).agg(F.count(F.lit(1)).alias("load"))
    return shards.rebalance_move(load.withColumn("moved", F.lit(None).cast("long")), hot=10)


@query(
    LOAD
    + """, stay as (select node, row_number() over (order by load, node) - 1 as turn, count(*) over () as k from n where node <> 'n2'),
m as (select shard, node, row_number() over (order by load desc, shard) - 1 as i from load where node = 'n2')
select m.shard, m.node as origin, stay.node as target from m join stay on m.i % stay.k = stay.turn"""
)
def q_drain(spark, d):
    load = read_table(spark, d, "events").groupBy(F.concat(F.lit("n"), F.col("user_id") % 6).alias("node"), F.col("user_id").alias("shard")).agg(F.count(F.lit(1)).alias("load"))
    return shards.drain(load, spark.createDataFrame([("n2",)], "node string"))


@query(CHUNKS + ", m as (select id, x, y, bx * 4294967296 + (cy & 4294967295) as shard from b) select id, shard from m where greatest(0 * 16 - x, x - 15, 0 * 16 - y, y - 15, 0) > 2")
def q_may_commit(spark, d):
    """Writes that the owner of block (0, 0) may not commit."""
    return shards.Spatial("x", "y", 16).may_commit(_chunks(spark, d), 0).select("id", "shard")


@query(
    LOG
    + """, num as (select lsn, ordinal, op, user_id, event_id_ as value from (select lsn, ordinal, op, user_id, (lsn * 37 % 3000)::bigint as event_id_ from log)),
q as (select *, lag(op) over w as old_op, lag(value) over w as old from num window w as (partition by user_id order by lsn, ordinal)),
s(sub, low, high) as (values (1, 0, 100), (2, 1000, 2000), (3, 2990, 2999), (4, 7, 7), (5, 9, 3)),
f as (select sub, lsn, ordinal, user_id, coalesce(old_op in (1, 2) and old between low and high, false) as was, op <> 3 and value between low and high as now from q, s)
select sub, lsn, ordinal, user_id, case when not now then 3 when was then 2 else 1 end as delta from f where was or now"""
)
def q_fanout_range(spark, d):
    """Subscriptions to ranges, over all of the log."""
    log = events_log(spark, d).select("lsn", "ordinal", "op", "user_id", (F.col("lsn") * 37 % 3000).alias("value"))
    subs = spark.createDataFrame([(1, 0, 100), (2, 1000, 2000), (3, 2990, 2999), (4, 7, 7), (5, 9, 3)], "sub int, low long, high long")
    return subscriptions.fanout(log, subs, ["user_id"])


@query(
    """with s as (select user_id as shard, (epoch_us(ts) // 1000000)::bigint as ts, max(event_id % 100)::double as load from events group by 1, 2)
select shard, ts, case when min(ts) over (partition by shard order by ts) <= ts - 86400 then avg(load) over (partition by shard order by ts range between 86399 preceding and current row) end as sustained from s"""
)
def q_sustained_window(spark, d):
    s = read_table(spark, d, "events").groupBy(F.col("user_id").alias("shard"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("ts")).agg(F.max(F.col("event_id") % 100).cast("double").alias("load"))
    return shards.sustained(s, 86400).select("shard", "ts", "sustained")


@query("select c_custkey as shard from customer left join (select o_custkey, count(*) as rows from orders where o_orderstatus = 'P' group by 1) on c_custkey = o_custkey where coalesce(rows, 0) = 0 and c_custkey % 7 <> 0 and c_acctbal > 0")
def q_empty_shards(spark, d):
    rows = read_table(spark, d, "orders").filter("o_orderstatus = 'P'").groupBy("o_custkey").count()
    c = read_table(spark, d, "customer").join(rows, F.col("c_custkey") == F.col("o_custkey"), "left")
    return shards.empty_shards(c.select(F.col("c_custkey").alias("shard"), F.coalesce("count", F.lit(0)).alias("rows"), (F.col("c_custkey") % 7 == 0).alias("draining"), (F.col("c_acctbal") > 0).alias("fresh")))


# schema evolution
_OLD = Table("part", (Column("p_partkey", "int64", primary=True), Column("p_name", "string"), Column("p_size", "int32")))
_NEW = Table("part", (Column("p_size", "int32"), Column("p_partkey", "int64", primary=True), Column("p_note", "string"), Column("p_stock", "int64"), Column("p_weight", "float64"), Column("p_name", "string")))


@query("select p_size, p_partkey, null::varchar as p_note, 0::bigint as p_stock, 0.0::double as p_weight, p_name from part")
def q_shape_remap(spark, d):
    return evolve.remap(read_table(spark, d, "part").select("p_partkey", "p_name", "p_size"), _OLD, _NEW)


@query(
    """select p_size, p_partkey, null::varchar as p_note, 0::bigint as p_stock, 0.0::double as p_weight, p_name from part where p_partkey <= 50
union all select p_size, p_partkey, p_brand, p_partkey * 2, p_retailprice, p_name from part where p_partkey > 50"""
)
def q_shape_history(spark, d):
    p = read_table(spark, d, "part")
    old = p.filter("p_partkey <= 50").select("p_partkey", "p_name", "p_size")
    new = p.filter("p_partkey > 50").select("p_size", "p_partkey", F.col("p_brand").alias("p_note"), (F.col("p_partkey") * 2).alias("p_stock"), F.col("p_retailprice").alias("p_weight"), "p_name")
    return evolve.with_history([(old, _OLD), (new, _NEW)], _NEW)


@query("select c_custkey, sha256('crm' || chr(10) || c_name) as identity from customer")
def q_identity(spark, d):
    return read_table(spark, d, "customer").select("c_custkey", F.lower(F.hex(identity(F.lit("crm"), F.col("c_name")))).alias("identity"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from tidelog import cases  # noqa: F401  adds its queries

    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    from tidelog import cases  # noqa: F401

    return dict(_sql)
