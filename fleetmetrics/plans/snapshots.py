"""Snapshot jobs (M1-M33), drift and refresh (CD1-CD4) on snapshots derived from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import drift, refresh
from ..jobs import backups as B
from ..jobs import containers as C
from ..jobs import catalog, maintenance, pooler, server, statements, storage
from ..sources import json_reports
from ..sources.tables import table
from .registry import CTR, M, ctr, m, query, r

SNAP = ["host", "snapshot_ts"]


def _host(c):
    return F.concat(F.lit("h"), F.pmod(c, F.lit(4)).cast("string")).alias("host")


def _next_month(c):
    return F.add_months(F.trunc(c, "month"), 1).cast("timestamp").alias("snapshot_ts")


def _next_day(c):
    return (F.date_trunc("day", c) + F.make_interval(days=F.lit(1))).alias("snapshot_ts")


def _t():
    return F.date_format("snapshot_ts", "yyyy-MM-dd").alias("t")


_ACT = """a as (select concat('h', cast(o_custkey % 4 as varchar)) as host, date_trunc('month', o_orderdate) + interval 1 month as snap, o_orderdate as since,
    case o_orderstatus when 'F' then 'active' when 'O' then 'idle' else 'idle in transaction' end as state, case when o_orderpriority = '1-URGENT' then 'Lock' end as wait,
    case when o_custkey % 10 = 0 then 'autovacuum worker' else 'client backend' end as bt from orders)"""


def _activity(spark, sf):
    o = table(spark, sf, "orders")
    state = F.when(F.col("o_orderstatus") == "F", "active").when(F.col("o_orderstatus") == "O", "idle").otherwise("idle in transaction")
    return o.select(
        _host("o_custkey"), _next_month("o_orderdate"), state.alias("state"), F.col("o_orderdate").alias("query_start"), F.col("o_orderdate").alias("state_change"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "Lock").alias("wait_event_type"),
        F.when(F.col("o_custkey") % 10 == 0, "autovacuum worker").otherwise("client backend").alias("backend_type"),
    )


def _settings(rows, **names):
    """Setting rows for the hosts and times of another snapshot."""
    pairs = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(v).alias("setting")) for n, v in names.items()])
    return rows.select(*SNAP).distinct().select(*SNAP, F.inline(pairs))


@query(
    "connection_stats",
    f"""with {_ACT} select host, strftime(snap, '%Y-%m-%d') as t, count(*) as total, count(*) filter (state = 'idle') as idle, count(*) filter (state = 'idle in transaction') as idle_in_txn,
    count(*) filter (state = 'active') as active, coalesce(max(case when state = 'idle in transaction' then epoch(snap - since) end), 0.0) as idle_txn_s,
    coalesce(max(case when bt = 'client backend' and state not like 'idle%' then epoch(snap - since) end), 0.0) as query_s,
    coalesce(max(case when bt = 'client backend' and wait = 'Lock' then epoch(snap - since) end), 0.0) as blocked_s, 100.0::double as max_connections from a group by host, snap""",
)
def connection_stats(spark, sf):
    a = _activity(spark, sf)
    c = server.connection_stats(a, _settings(a, max_connections="100"))
    return c.select(
        "host", _t(), "total", "idle", "idle_in_txn", "active", F.col("max_idle_in_txn_time").alias("idle_txn_s"), F.col("max_query_time").alias("query_s"),
        F.col("max_blocked_query_time").alias("blocked_s"), "max_connections",
    )


@query("autovacuum_workers", f"with {_ACT} select host, strftime(snap, '%Y-%m-%d') as t, count(*) filter (bt = 'autovacuum worker') as count, 3 as max from a group by host, snap")
def autovacuum_workers(spark, sf):
    a = _activity(spark, sf)
    return server.autovacuum_workers(a, _settings(a, autovacuum_max_workers="3")).select("host", _t(), "count", "max")


_EV = """e as (select concat('h', cast(user_id % 4 as varchar)) as host, date_trunc('day', ts) + interval 1 day as snap, * from events)"""


def _events(spark, sf):
    return table(spark, sf, "events").select("*", _host("user_id"), _next_day("ts"))


@query(
    "lock_counts",
    f"""with {_EV}, h as (select host, snap, case when user_id % 7 = 0 then null else user_id % 5 end as db,
    case event_type when 'click' then 'accesssharelock' when 'view' then 'exclusivelock' when 'error' then 'rowsharelock' else 'sharelock' end as mode from e),
    d as (select distinct host, snap, x.oid from e cross join (values (0), (1), (2), (3), (4)) x(oid)),
    t as (select * from (values ('accesssharelock'), ('rowsharelock'), ('rowexclusivelock'), ('shareupdateexclusivelock'), ('sharelock'), ('sharerowexclusivelock'), ('exclusivelock'), ('accessexclusivelock')) v(mode)),
    c as (select host, snap, db, mode, count(*) as n from h where db is not null group by 1, 2, 3, 4)
    select d.host, strftime(d.snap, '%Y-%m-%d') as t, concat('db', cast(d.oid as varchar)) as dbname, t.mode, coalesce(c.n, 0) as "count"
    from d cross join t left join c on c.host = d.host and c.snap = d.snap and c.db = d.oid and c.mode = t.mode""",
)
def lock_counts(spark, sf):
    e = _events(spark, sf)
    mode = F.when(F.col("event_type") == "click", "AccessShareLock").when(F.col("event_type") == "view", "ExclusiveLock").when(F.col("event_type") == "error", "RowShareLock").otherwise("ShareLock")
    held = e.select(*SNAP, F.when(F.col("user_id") % 7 != 0, F.col("user_id") % 5).alias("database"), mode.alias("mode"))
    dbs = e.select(*SNAP).distinct().withColumn("oid", F.explode(F.sequence(F.lit(0), F.lit(4)).cast("array<bigint>")))
    dbs = dbs.withColumn("datname", F.concat(F.lit("db"), F.col("oid").cast("string")))
    return server.locks(dbs, held).select("host", _t(), "dbname", "mode", "count")


def _database_snapshot(spark, sf):
    """Databases and their counters from customers: some templates, some closed to connections."""
    c = table(spark, sf, "customer")
    return c.select(
        _host("c_nationkey"), F.lit("2024-01-31 00:00:00").cast("timestamp").alias("snapshot_ts"), F.col("c_custkey").alias("oid"), F.col("c_name").alias("datname"),
        (F.col("c_custkey") % 10 == 0).alias("datistemplate"), (F.col("c_custkey") % 7 != 0).alias("datallowconn"), (F.col("c_custkey") * 1000003).alias("xid_age"),
        F.floor(F.abs("c_acctbal") * 1000).cast("bigint").alias("size_bytes"),
    )


@query(
    "database_stats",
    """select concat('h', cast(c_nationkey % 4 as varchar)) as host, c_name as dbname, c_custkey * 3 as xact_commit, c_custkey % 11 as deadlocks from customer where c_custkey % 10 <> 0""",
)
def database_stats(spark, sf):
    dbs = _database_snapshot(spark, sf)
    counters = {c: F.col("oid") % 13 for c in server.DATABASE_COUNTERS} | {"xact_commit": F.col("oid") * 3, "deadlocks": F.col("oid") % 11}
    stats = dbs.select(*SNAP, "datname", *[v.alias(k) for k, v in counters.items()])
    return server.database_stats(stats, dbs).select("host", "dbname", "xact_commit", "deadlocks")


@query(
    "database_size",
    """select concat('h', cast(c_nationkey % 4 as varchar)) as host, c_name as dbname, cast(floor(abs(c_acctbal) * 1000) as bigint) as bytes from customer where c_custkey % 10 <> 0""",
)
def database_size(spark, sf):
    return storage.database_size(_database_snapshot(spark, sf)).select("host", "dbname", "bytes")


@query(
    "wraparound",
    """select concat('h', cast(c_nationkey % 4 as varchar)) as host, max(c_custkey * 1000003) as oldest, max(round_even(100 * (c_custkey * 1000003 / 2000000000.0::double), 0)) as wrap,
    max(round_even(100 * (c_custkey * 1000003 / 200000000.0::double), 0)) as vacuum from customer where c_custkey % 7 <> 0 group by 1""",
)
def wraparound(spark, sf):
    dbs = _database_snapshot(spark, sf)
    w = server.wraparound(dbs, _settings(dbs, autovacuum_freeze_max_age="200000000"))
    return w.select(
        "host", F.col("oldest_current_xid").alias("oldest"), F.col("percent_towards_wraparound").alias("wrap"), F.col("percent_towards_emergency_autovac").alias("vacuum")
    )


@query(
    "archive_status",
    f"""with {_EV}, g as (select host, snap, max(case when event_type = 'error' then ts end) as f, max(case when event_type = 'view' then ts end) as a,
    count(*) filter (event_type = 'view') as archived, count(*) filter (event_type = 'error') as failed from e group by 1, 2)
    select host, strftime(snap, '%Y-%m-%d') as t, round(case when f is null or a is null or epoch_us(f - a) < 0 then 0 else epoch_us(f - a) / 1e6 end, 6) as since_fail,
    round(epoch_us(snap - a) / 1e6, 6) as since_archive, archived, failed from g""",
)
def archive_status(spark, sf):
    def of(kind):
        return F.when(F.col("event_type") == kind, F.col("ts"))

    g = _events(spark, sf).groupBy(*SNAP).agg(
        F.max(of("error")).alias("last_failed_time"), F.max(of("view")).alias("last_archived_time"),
        F.count(of("view")).alias("archived_count"), F.count(of("error")).alias("failed_count"),
    )
    a = server.archive_status(g)
    return a.select(
        "host", _t(), r("seconds_since_last_fail").alias("since_fail"), r("seconds_since_last_archive").alias("since_archive"),
        F.col("archived_count").alias("archived"), F.col("failed_count").alias("failed"),
    )


@query(
    "checksum_failures",
    f"""with {_EV}, g as (select host, snap, event_type, count(*) as n, max(case when value > 90 then ts end) as f from e group by 1, 2, 3)
    select host, strftime(snap, '%Y-%m-%d') as t, event_type as dbname, n as count, round(coalesce(epoch_us(snap - f) / 1e6, 0), 6) as since from g""",
)
def checksum_failures(spark, sf):
    g = _events(spark, sf).groupBy(*SNAP, F.col("event_type").alias("datname")).agg(
        F.count("*").alias("checksum_failures"), F.max(F.when(F.col("value") > 90, F.col("ts"))).alias("checksum_last_failure")
    )
    return server.checksum_failures(g).select("host", _t(), "dbname", "count", r("time_since_last_failure_seconds").alias("since"))


@query(
    "recent_and_total",
    f"""with {_EV} select host, strftime(snap, '%Y-%m-%d') as t, cast(coalesce(sum(case when ts > snap - interval 240 minute then floor(value * 100) end), 0) as bigint) as recent,
    cast(sum(floor(value * 100)) as bigint) as total from e group by host, snap""",
)
def recent_and_total(spark, sf):
    files = _events(spark, sf).select(*SNAP, F.floor(F.col("value") * 100).cast("bigint").alias("size"), F.col("ts").alias("modification"))
    w = server.wal_activity(files, minutes=240)
    return w.select("host", _t(), F.col("last_5_min_size_bytes").alias("recent"), F.col("total_size_bytes").alias("total"))


@query(
    "setting_normalise",
    f"""with {_EV}, g as (select host, snap, max(case when user_id % 2 = 0 then event_id end) as a, max(case when user_id % 2 = 1 then event_id end) as b,
    count(*) filter (event_type = 'error') as pending, min(event_id) as v from e group by 1, 2)
    select host, strftime(snap, '%Y-%m-%d') as t, coalesce(a, b) as num_timed, a as buffers_clean, pending, case when v % 2 = 0 then 1 else 2 end as status,
    cast(170000 + v % 10 as int) as version from g""",
)
def setting_normalise(spark, sf):
    """Writer counters under old or new names, pending restarts, role code and version of each snapshot."""
    e = _events(spark, sf)
    g = e.groupBy(*SNAP).agg(
        F.max(F.when(F.col("user_id") % 2 == 0, F.col("event_id"))).alias("num_timed"), F.max(F.when(F.col("user_id") % 2 == 1, F.col("event_id"))).alias("checkpoints_timed"),
        F.min("event_id").alias("v"),
    )
    g = g.withColumn("buffers_clean", F.col("num_timed")).withColumn("in_recovery", F.col("v") % 2 == 0)
    settings = e.select(*SNAP, F.col("event_type").alias("name"), (F.col("event_type") == "error").alias("pending_restart"))
    version = g.select(*SNAP, F.lit("server_version_num").alias("name"), (170000 + F.col("v") % 10).cast("string").alias("setting"))
    out = server.writers(g).join(server.pending_restart(settings), SNAP).join(server.recovery_status(g), SNAP).join(server.server_version(version), SNAP)
    return out.select("host", _t(), "num_timed", "buffers_clean", F.col("count").alias("pending"), "status", F.col("current").alias("version"))


@query(
    "replication_lag",
    """with s as (select o_orderkey as k, o_custkey % 2 = 0 as rec, o_orderkey % 5 = 0 as same, date_trunc('month', o_orderdate) + interval 1 month as snap, o_orderdate as d from orders)
    select k, cast(case when same or not rec then 0 else epoch(snap - d) end as int) as replay, cast(case when not rec then 0 else epoch(snap - d) end as int) as received from s""",
)
def replication_lag(spark, sf):
    o = table(spark, sf, "orders")
    lsn = F.concat_ws("/", F.lit("0"), F.hex("o_orderkey"))
    servers = o.select(
        F.col("o_orderkey").cast("string").alias("host"), _next_month("o_orderdate"), (F.col("o_custkey") % 2 == 0).alias("in_recovery"), lsn.alias("receive_lsn"),
        F.when(F.col("o_orderkey") % 5 == 0, lsn).otherwise(F.lit("0/FFFFFFFF")).alias("replay_lsn"), F.col("o_orderdate").alias("last_xact_replay"),
    )
    return server.replication_lag(servers).select(F.col("host").cast("bigint").alias("k"), F.col("replay_time").alias("replay"), F.col("received_time").alias("received"))


@query(
    "replication_slots",
    """select concat('s', cast(o_orderkey as varchar)) as slot_name, cast(o_orderstatus = 'O' as int) as active, case when o_custkey % 2 = 0 then 65535 else 1048575 end - o_orderkey as retained from orders""",
)
def replication_slots(spark, sf):
    o = table(spark, sf, "orders")
    slots = o.select(
        _host("o_custkey"), F.lit("2024-01-31").cast("timestamp").alias("snapshot_ts"), F.concat(F.lit("s"), F.col("o_orderkey").cast("string")).alias("slot_name"),
        (F.col("o_orderstatus") == "O").alias("active"), F.concat(F.lit("0/"), F.hex("o_orderkey")).alias("restart_lsn"),
    )
    servers = slots.select(*SNAP).distinct().select(
        *SNAP, F.col("host").isin("h0", "h2").alias("in_recovery"), F.lit("0/FFFF").alias("replay_lsn"), F.lit("0/FFFFF").alias("insert_lsn")
    )
    return server.replication_slots(slots, servers).select("slot_name", "active", F.col("retained_bytes").cast("bigint").alias("retained"))


@query(
    "settings_pivot",
    f"""with {_EV} select host, strftime(snap, '%Y-%m-%d') as t, cast(max(case when event_type = 'click' then cast(floor(value) as bigint) end) as int) as checkpoint_timeout,
    max(case when event_type = 'view' then cast(floor(value) as bigint) end)::double as completion, 8192 * max(case when event_type = 'error' then cast(floor(value) as bigint) end) as shared_buffers from e where event_type in ('click', 'view', 'error') group by host, snap""",
)
def settings_pivot(spark, sf):
    name = F.when(F.col("event_type") == "click", "checkpoint_timeout").when(F.col("event_type") == "view", "checkpoint_completion_target").when(F.col("event_type") == "error", "shared_buffers").otherwise("other")
    # one row per setting, as a catalogue has it
    top = _events(spark, sf).groupBy(*SNAP, name.alias("name")).agg(F.max(F.floor("value")).cast("string").alias("setting"))
    g = server.settings_gauge(top.where("name <> 'other'"))
    return g.select("host", _t(), "checkpoint_timeout", F.col("checkpoint_completion_target").alias("completion"), "shared_buffers")


@query(
    "kv_pivot",
    f"""with {_EV}, k as (select host, snap, max(case when event_type = 'click' then cast(floor(value) as bigint) end) as c, max(case when event_type = 'view' then cast(floor(value) as bigint) end) as v,
    max(case when event_type = 'error' then cast(floor(value) as bigint) end) as x, max(case when event_type = 'purchase' then case when value > 95 then 9223372036854775807 else cast(floor(value) as bigint) end end) as p from e group by 1, 2)
    select host, strftime(snap, '%Y-%m-%d') as t, c as shmem, case when host in ('h0', 'h2') then v else x end as dirty, case when host in ('h0', 'h2') then v else 0 end as cache,
    case when host in ('h0', 'h2') then null when p = 9223372036854775807 then 0 else p end as "limit" from k""",
)
def kv_pivot(spark, sf):
    e = _events(spark, sf)
    top = e.groupBy(*SNAP, "event_type").agg(F.max("value").alias("v"))
    whole = F.floor("v").cast("bigint")

    def kv(file, key, val):
        return F.struct(F.lit(file).alias("file"), F.lit(key).alias("key"), val.alias("val"))

    rows = (
        F.when(F.col("event_type") == "click", F.array(kv("memory.stat", "shmem", whole)))
        .when(F.col("event_type") == "view", F.array(kv("memory.stat", "dirty", whole), kv("memory.stat", "cache", whole)))
        .when(F.col("event_type") == "error", F.array(kv("memory.stat", "file_dirty", whole)))
        .when(F.col("event_type") == "purchase", F.array(kv("memory.max", "", F.when(F.col("v") > 95, F.lit(9223372036854775807)).otherwise(whole))))
        .otherwise(F.array(kv("other", "", whole)))
    )
    mode = F.when(F.col("host").isin("h0", "h2"), "legacy").otherwise("unified")
    mem = C.memory(top.select(*SNAP, mode.alias("mode"), F.inline(rows)))
    return mem.select("host", _t(), "shmem", "dirty", "cache", "limit")


@query(
    "disk_mounts",
    """with d as (select case when p_size % 2 = 0 then concat('/tablespaces/', p_name) when p_partkey % 3 = 0 then '/pgdata' end as mount_point, p_size from part)
    select mount_point, count(*) as n, cast(sum(p_size * 1000) as bigint) as total, cast(sum(p_size * 7) as bigint) as sectors from d where mount_point is not null group by 1""",
)
def disk_mounts(spark, sf):
    p = table(spark, sf, "part")
    mount = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("/tablespaces/"), F.col("p_name"))).when(F.col("p_partkey") % 3 == 0, "/pgdata").otherwise("/home")
    base = p.select(
        F.col("p_type").alias("host"), F.lit("2024-01-31").cast("timestamp").alias("snapshot_ts"), F.lit(8).alias("major_number"), F.col("p_partkey").alias("minor_number"),
        mount.alias("mount_point"), F.lit("xfs").alias("fs_type"), F.col("p_size").alias("size"),
    )
    counts = {c: F.col("size") * 1000 for c in ("total_bytes", "available_bytes", "total_file_nodes", "free_file_nodes")}
    disk = base.withColumns({"sectors_read": F.col("size") * 7, "sectors_written": F.col("size")})
    space = C.data_disk(base, base.withColumns(counts)).groupBy("mount_point").agg(F.count("*").alias("n"), F.sum("total_bytes").alias("total"))
    act = C.disk_activity(base, disk).groupBy("mount_point").agg(F.sum("sectors_read").alias("sectors"))
    return space.join(act, "mount_point")


def _statements(spark, sf):
    """Statement statistics from order lines: flag and status stand for role and database."""
    q = F.concat(F.lit("select\n  "), F.col("l_partkey").cast("string"), F.lit(" from a_rather_long_table_name where x = 1"))
    return table(spark, sf, "lineitem").select(
        _host("l_suppkey"), F.lit("2024-01-31").cast("timestamp").alias("snapshot_ts"), F.col("l_returnflag").alias("role"), F.col("l_linestatus").alias("dbname"),
        F.col("l_partkey").alias("queryid"), q.alias("query"), F.col("l_linenumber").cast("bigint").alias("calls"), F.col("l_extendedprice").alias("total_exec_time"),
        F.col("l_quantity").alias("mean_exec_time"), F.col("l_extendedprice").alias("max_exec_time"), F.col("l_linenumber").alias("rows"), "l_orderkey",
        F.col("l_orderkey").alias("wal_records"), F.col("l_linenumber").alias("wal_fpi"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("wal_bytes"),
    )


_ST = """s as (select concat('h', cast(l_suppkey % 4 as varchar)) as host, l_returnflag as role, l_linestatus as dbname, l_partkey as queryid,
    trim(replace(left(concat('select', chr(10), '  ', cast(l_partkey as varchar), ' from a_rather_long_table_name where x = 1'), 40), chr(10), '')) as query, * from lineitem)"""


@query(
    "statement_totals",
    f"""with {_ST} select host, role, dbname, cast(sum(l_linenumber) as bigint) as calls, round(sum(l_extendedprice), 2) as exec_ms, round(avg(l_quantity), 5) as mean_ms,
    cast(sum(l_linenumber) as bigint) as row_count from s group by 1, 2, 3""",
)
def statement_totals(spark, sf):
    t = statements.totals(_statements(spark, sf))
    return t.select("host", "role", "dbname", F.col("calls_count").alias("calls"), r("exec_time_ms", 2).alias("exec_ms"), r("mean_exec_time_ms", 5).alias("mean_ms"), "row_count")


@query(
    "statement_top_total",
    f"""with {_ST}, u as (select host, role, dbname, queryid, query, sum(l_extendedprice) as ms from s group by 1, 2, 3, 4, 5)
    select host, role, dbname, queryid, query, round(ms, 2) as exec_ms from u qualify row_number() over (partition by host order by round(ms, 2) desc, role, dbname, queryid, query) <= 20""",
)
def statement_top_total(spark, sf):
    s = _statements(spark, sf)
    u = statements.by_statement(s).withColumn("total_exec_time", r("total_exec_time", 2))
    return statements.top_total(u).select("host", *statements.ID, F.col("exec_time_ms").alias("exec_ms"))


@query(
    "statement_top_mean",
    f"""with {_ST}, u as (select host, role, dbname, queryid, query, max(l_quantity * l_extendedprice) as ms from s group by 1, 2, 3, 4, 5)
    select host, role, dbname, queryid, query, ms as exec_ms from u qualify row_number() over (partition by host order by ms desc, role, dbname, queryid, query) <= 20""",
)
def statement_top_mean(spark, sf):
    s = _statements(spark, sf).withColumn("mean_time", F.col("mean_exec_time") * F.col("total_exec_time")).drop("mean_exec_time")
    return statements.top_mean(s).select("host", *statements.ID, F.col("exec_time_ms").alias("exec_ms"))


@query(
    "statement_top_wal",
    f"""with {_ST}, u as (select host, role, dbname, queryid, query, max(l_orderkey) as records, cast(max(l_linenumber) as bigint) as fpi, max(l_orderkey * 10 + l_linenumber) as bytes from s group by 1, 2, 3, 4, 5)
    select host, role, dbname, queryid, query, records, fpi, bytes from u qualify row_number() over (partition by host order by bytes desc, role, dbname, queryid, query) <= 20""",
)
def statement_top_wal(spark, sf):
    s = _statements(spark, sf).groupBy(*SNAP, *statements.ID).agg(
        F.max("wal_records").alias("wal_records"), F.max("wal_fpi").cast("bigint").alias("wal_fpi"), F.max("wal_bytes").alias("wal_bytes")
    )
    return statements.top_wal(s).select("host", *statements.ID, "records", "fpi", "bytes")


@query(
    "counter_epoch",
    f"""with {CTR}, d as (select series_key, ts, value, lag(value) over (partition by series_key order by ts, event_id) as p from ctr)
    select series_key, round(coalesce(max(case when value < p then epoch_us(ts) end), 0) / 1e6, 6) as time from d group by 1""",
)
def counter_epoch(spark, sf):
    return statements.reset_times(ctr(spark, sf), ["series_key"], chunk="1h").select("series_key", r("time").alias("time"))


@query(
    "exhaustion_count",
    """with s as (select p_type as host, p_partkey, 1 + p_partkey % 7 as inc, 1 as lo, p_size * 1000 + p_partkey as hi, case when p_partkey % 11 = 0 then null else 1 + (p_partkey * 37) % (p_size * 1000 + p_partkey) end as last from part),
    u as (select host, (hi - lo + 1 + inc - 1) // inc as slots, (coalesce(last, lo) - lo + 1 + inc - 1) // inc as used from s)
    select host, count(*) filter ((200 * used + slots) // (2 * slots) > 75) as count, cast(sum(slots) as bigint) as slots, cast(sum(used) as bigint) as used from u group by 1""",
)
def exhaustion_count(spark, sf):
    hi = F.col("p_size") * 1000 + F.col("p_partkey")
    seq = table(spark, sf, "part").select(
        F.col("p_type").alias("host"), F.lit("2024-01-31").cast("timestamp").alias("snapshot_ts"), (1 + F.col("p_partkey") % 7).alias("increment_by"), F.lit(1).cast("bigint").alias("min_value"),
        hi.alias("max_value"), F.when(F.col("p_partkey") % 11 != 0, 1 + (F.col("p_partkey") * 37) % hi).alias("last_value"),
    )
    n = storage.sequence_exhaustion(seq)
    tot = storage._sequence_use(seq).groupBy(*SNAP).agg(F.sum("slots").cast("bigint").alias("slots"), F.sum("used").cast("bigint").alias("used"))
    return n.join(tot, SNAP).select("host", "count", "slots", "used")


@query(
    "sequence_status",
    """with s as (select s_nationkey as n, count(*) as last from supplier group by 1), u as (select n_nationkey as n, string_agg(distinct c_mktsegment, ', ' order by c_mktsegment) as users from nation join customer on c_nationkey = n_nationkey group by 1)
    select concat('"', n_name, '".seq') as sequence_name, s.last as last_value, 100 as slots, s.last as used, cast(s.last as int) as percent, 100 - s.last as numleft, u.users as table_usage from nation join s on s.n = n_nationkey left join u on u.n = n_nationkey""",
)
def sequence_status(spark, sf):
    at = F.lit("2024-01-31").cast("timestamp").alias("snapshot_ts")
    last = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("last_value"))
    nation = table(spark, sf, "nation")
    seq = nation.join(last, "n_nationkey").select(
        F.lit("h0").alias("host"), at, F.col("n_name").alias("schemaname"), F.lit("seq").alias("sequencename"), "last_value", F.lit(1).cast("bigint").alias("min_value"),
        F.lit(100).cast("bigint").alias("max_value"), F.lit(1).cast("bigint").alias("increment_by"), F.lit(False).alias("cycle"),
    )
    name = F.concat(F.lit('"'), F.col("n_name"), F.lit('".seq'))
    use = table(spark, sf, "customer").select(F.col("c_nationkey").alias("n_nationkey"), "c_mktsegment").distinct().join(nation, "n_nationkey")
    owned = use.select(F.lit("h0").alias("host"), at, name.alias("sequence_name"), F.col("c_mktsegment").alias("table_name"))
    defaults = use.select(F.lit("h0").alias("host"), at, F.concat(F.lit("nextval('"), name, F.lit("'::regclass)")).alias("default_expr"), F.col("c_mktsegment").alias("table_name"))
    out = storage.sequence_status(seq, storage.sequence_tables(owned, defaults))
    return out.select(
        "sequence_name", "last_value", F.col("slots").cast("int").alias("slots"), F.col("used").cast("bigint").alias("used"), "percent", F.col("numleft").cast("bigint").alias("numleft"), "table_usage"
    )


@query(
    "table_sizes",
    """select concat('s', cast(p_size % 5 as varchar)) as schemaname, p_name as relname, p_partkey * 8192 as size_bytes from part where p_size % 5 <> 4 and p_partkey % 4 in (0, 1, 2)""",
)
def table_sizes(spark, sf):
    p = table(spark, sf, "part")
    at = F.lit("2024-01-31").cast("timestamp").alias("snapshot_ts")
    kind = F.element_at(F.array(F.lit("r"), F.lit("m"), F.lit("f"), F.lit("i")), (F.col("p_partkey") % 4 + 1).cast("int"))
    rel = p.select(F.lit("h0").alias("host"), at, F.lit("db").alias("dbname"), (F.col("p_size") % 5).alias("relnamespace"), F.col("p_name").alias("relname"), kind.alias("relkind"), (F.col("p_partkey") * 8192).alias("size_bytes"))
    ns = rel.select(*SNAP, "dbname", F.col("relnamespace").alias("oid")).distinct().withColumns(
        {"nspname": F.concat(F.lit("s"), F.col("oid").cast("string")), "is_other_temp": F.col("oid") == 4}
    )
    return storage.table_size(rel, ns).select("schemaname", "relname", "size_bytes")


@query(
    "user_table_counters",
    """select l_returnflag as schemaname, l_linestatus as relname, cast(sum(l_linenumber) as bigint) as seq_scan, count(*) as n_tup_ins, cast(null as bigint) as idx_scan from lineitem group by 1, 2""",
)
def user_table_counters(spark, sf):
    t = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("schemaname"), F.col("l_linestatus").alias("relname")).agg(F.sum("l_linenumber").alias("seq_scan"), F.count("*").alias("n_tup_ins"))
    t = t.withColumns({"host": F.lit("h0"), "snapshot_ts": F.lit("2024-01-31").cast("timestamp"), "dbname": F.lit("db")})
    return storage.user_tables(t).select("schemaname", "relname", "seq_scan", "n_tup_ins", "idx_scan")


@query(
    "refresh_overdue",
    """with v as (select c_mktsegment as dbname, c_custkey % 3 <> 0 as active, max(o_orderdate) as last, c_custkey from customer left join orders on o_custkey = c_custkey group by 1, 2, 4)
    select dbname, count(*) filter (active and (last is null or last < timestamp '2001-08-01' - interval 120 day)) as count, max(c_custkey)::double as seconds from v group by 1""",
)
def refresh_overdue(spark, sf):
    last = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("last_run"))
    views = table(spark, sf, "customer").join(last, "c_custkey", "left").select(
        F.lit("h0").alias("host"), F.lit("2001-08-01").cast("timestamp").alias("snapshot_ts"), F.col("c_mktsegment").alias("dbname"), (F.col("c_custkey") % 3 != 0).alias("active"), "last_run",
        F.make_interval(days=F.lit(120)).alias("run_interval"), F.col("c_custkey").alias("last_run_seconds"),
    )
    out = maintenance.refresh_failures(views).join(maintenance.longest_refresh(views), [*SNAP, "dbname"])
    return out.select("dbname", "count", "seconds")


@query(
    "pool_sums",
    """select concat('h', cast(user_id % 4 as varchar)) as target, concat(event_type, '.', 'u', cast(user_id % 3 as varchar)) as conn_pool, cast(sum(floor(value)) as bigint) as client_active,
    cast(sum(user_id) as bigint) as server_idle from events group by 1, 2""",
)
def pool_sums(spark, sf):
    rows = _events(spark, sf).withColumn("snapshot_ts", F.lit("2024-01-31").cast("timestamp")).select(
        "host", "snapshot_ts", F.col("host").alias("pgbouncer_target_host"), F.col("event_type").alias("database"), F.concat(F.lit("u"), F.pmod("user_id", F.lit(3)).cast("string")).alias("user"),
        F.floor("value").cast("bigint").alias("cl_active"), F.lit(0).alias("cl_waiting"), F.lit(0).alias("sv_active"), F.col("user_id").alias("sv_idle"), F.lit(0).alias("sv_used"),
    )
    return pooler.pools(rows).select(F.col("pgbouncer_target_host").alias("target"), "conn_pool", "client_active", "server_idle")


@query(
    "pool_state_counts",
    f"""with {_EV} select host, strftime(snap, '%Y-%m-%d') as t, concat('db.u', cast(user_id % 3 as varchar)) as conn_pool, event_type as client_state, count(*) as n from e group by 1, 2, 3, 4""",
)
def pool_state_counts(spark, sf):
    rows = _events(spark, sf).select(
        *SNAP, F.col("host").alias("pgbouncer_target_host"), F.lit("db").alias("database"), F.concat(F.lit("u"), F.pmod("user_id", F.lit(3)).cast("string")).alias("user"), F.col("event_type").alias("state")
    )
    return pooler.clients(rows).select("host", _t(), "conn_pool", "client_state", F.col("client_state_count").alias("n"))


@query(
    "pool_usage",
    """select p_name as pool_db, p_partkey as k, cast(round_even((p_size::double / case when p_partkey % 5 <> 0 then 60 + p_partkey % 5 else 20 + p_partkey % 7 end::double) * 100, 0) as int) as pct from part""",
)
def pool_usage(spark, sf):
    cap = F.when(F.col("p_partkey") % 5 != 0, 60 + F.col("p_partkey") % 5).otherwise(0)
    rows = table(spark, sf, "part").select(
        F.col("p_partkey").cast("string").alias("host"), F.lit("2024-01-31").cast("timestamp").alias("snapshot_ts"), F.lit("t").alias("pgbouncer_target_host"), F.col("p_name").alias("name"),
        cap.alias("max_connections"), F.col("p_size").alias("current_connections"), (20 + F.col("p_partkey") % 7).alias("pool_size"), F.lit(0).alias("paused"), F.lit(0).alias("disabled"),
    )
    return pooler.databases(rows).select("pool_db", F.col("host").cast("bigint").alias("k"), F.col("db_conn_perc_used").alias("pct"))


@query(
    "statement_top_max",
    f"""with {_ST}, u as (select host, role, dbname, queryid, query, max(l_extendedprice) as ms from s group by 1, 2, 3, 4, 5)
    select host, role, dbname, queryid, query, ms as exec_ms from u qualify row_number() over (partition by host order by ms desc, role, dbname, queryid, query) <= 20""",
)
def statement_top_max(spark, sf):
    s = _statements(spark, sf).groupBy(*SNAP, *statements.ID).agg(F.max("max_exec_time").alias("max_time"))
    return statements.top_max(s).select("host", *statements.ID, F.col("exec_time_ms").alias("exec_ms"))


@query(
    "postmaster_uptime",
    f"""with {_EV} select host, strftime(snap, '%Y-%m-%d') as t, round(epoch_us(min(ts)) / 1e6, 6) as started, round(epoch_us(snap - min(ts)) / 1e6, 6) as uptime from e group by host, snap""",
)
def postmaster_uptime(spark, sf):
    servers = _events(spark, sf).groupBy(*SNAP).agg(F.min("ts").alias("postmaster_start_time"))
    return server.postmaster(servers).select("host", _t(), r("start_time_seconds").alias("started"), r("seconds").alias("uptime"))


@query(
    "container_cpu",
    f"""with {_EV}, k as (select host, snap, max(case when event_type = 'click' then cast(floor(value) as bigint) end) as c, max(case when event_type = 'view' then cast(floor(value) as bigint) end) as v from e group by 1, 2)
    select host, strftime(snap, '%Y-%m-%d') as t, c as period_us, greatest(case when host in ('h0', 'h2') then v - 50 else v end, 0) as quota_us, case when host in ('h0', 'h2') then v else c * 1000 end as usage, epoch(snap) as usage_ts from k""",
)
def container_cpu(spark, sf):
    """CPU quota and usage under the key names of both control-group versions."""
    whole = F.floor(F.max(F.when(F.col("event_type") == "click", F.col("value")))).cast("bigint"), F.floor(F.max(F.when(F.col("event_type") == "view", F.col("value")))).cast("bigint")
    g = _events(spark, sf).groupBy(*SNAP).agg(whole[0].alias("c"), whole[1].alias("v"))

    def kv(file, key, val):
        return F.struct(F.lit(file).alias("file"), F.lit(key).alias("key"), val.alias("val"))

    c, v = F.col("c"), F.col("v")
    old = F.array(kv("cpu.cfs_period_us", "", c), kv("cpu.cfs_quota_us", "", v - 50), kv("cpuacct.usage", "", v))
    new = F.array(kv("cpu.max", "2", c), kv("cpu.max", "1", v), kv("cpu.stat", "usage_usec", c))
    legacy = F.col("host").isin("h0", "h2")
    rows = g.select(*SNAP, F.when(legacy, "legacy").otherwise("unified").alias("mode"), F.inline(F.when(legacy, old).otherwise(new)))
    out = C.cpu_cfs(rows).join(C.cpu_acct(rows), SNAP)
    return out.select("host", _t(), "period_us", "quota_us", "usage", "usage_ts")


@query(
    "pool_direct",
    f"""with {_EV}, x as (select host, snap, event_type, cast(floor(sum(value)) as bigint) as wait, count(*) as n from e group by 1, 2, 3)
    select 'ccp_pgbouncer_clients_wait_seconds' as metric, host, event_type as state, count(*) as n, cast(sum(wait) as double) as total from x group by 1, 2, 3""",
)
def pool_direct(spark, sf):
    """Rows as shown by the pooler itself, melted into samples."""
    rows = _events(spark, sf).groupBy(*SNAP, F.col("event_type").alias("state")).agg(F.floor(F.sum("value")).cast("bigint").alias("wait"))
    rows = rows.withColumns({"database": F.lit("db"), "user": F.lit("u"), "application_name": F.lit("psql"), "link": F.lit("")})
    s = catalog.direct_pooler_samples(rows, "clients")
    lab = F.col("labels")
    return s.groupBy("metric", lab["instance"].alias("host"), lab["state"].alias("state")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


@query(
    "drift_samples",
    f"""with {_EV}, s as (select host, snap, event_type as name, count(*) // 12 as setting from e group by 1, 2, 3),
    h as (select host, snap, md5(string_agg(concat(name, cast(setting as varchar)), ',' order by name)) as hash from s group by 1, 2),
    c as (select *, coalesce(cast(hash <> lag(hash) over (partition by host order by snap) as int), 0) as changed from h),
    x as (select host, max(changed) over (partition by host order by snap) as status from c)
    select 'ccp_pg_settings_checksum_status' as metric, host, count(*) as n, cast(sum(status) as double) as drifted from x group by 2""",
)
def drift_samples(spark, sf):
    settings = _events(spark, sf).groupBy(*SNAP, F.col("event_type").alias("name")).agg(F.floor(F.count("*") / 12).cast("string").alias("setting"))
    s = catalog.drift_samples(drift.drift_status(drift.settings_hash(settings)))
    return s.groupBy("metric", F.col("labels")["host"].alias("host")).agg(F.count("*").alias("n"), F.sum("value").alias("drifted"))


# --- backups -----------------------------------------------------------------------------------

_BK = f"""{_EV}, b as (select host, snap, concat('etc_', host, '.conf') as config_file, concat('s', cast(user_id % 2 as varchar)) as stanza, cast(event_id % 2 + 1 as varchar) as repo,
    case event_type when 'click' then 'full' when 'view' then 'diff' else 'incr' end as kind, concat('2.', cast(user_id % 60 as varchar)) as version,
    cast(floor(value * 100) as bigint) as size, cast(floor(epoch(ts)) as bigint) as start, cast(floor(epoch(ts)) as bigint) + user_id as stop, event_type = 'error' as err, event_id from e)"""


def _backup_lines(spark, sf):
    """Report lines made from the events: one backup each, in the command's JSON."""
    start = F.unix_seconds("ts")
    kind = F.when(F.col("event_type") == "click", "full").when(F.col("event_type") == "view", "diff").otherwise("incr")
    doc = F.array(
        F.struct(
            F.concat(F.lit("s"), F.pmod("user_id", F.lit(2)).cast("string")).alias("name"),
            F.array(
                F.struct(
                    kind.alias("type"), (F.col("event_type") == "error").alias("error"),
                    F.struct(F.concat(F.lit("2."), (F.col("user_id") % 60).cast("string")).alias("version")).alias("backrest"),
                    F.struct((F.col("event_id") % 2 + 1).alias("repo-key")).alias("database"),
                    F.struct(F.struct(F.floor(F.col("value") * 10).cast("bigint").alias("delta"), F.floor(F.col("value") * 100).cast("bigint").alias("size")).alias("repository")).alias("info"),
                    F.struct(start.alias("start"), (start + F.col("user_id")).alias("stop")).alias("timestamp"),
                )
            ).alias("backup"),
        )
    )
    e = _events(spark, sf)
    return e.select(*SNAP, F.concat(F.lit("etc/"), F.col("host"), F.lit(".conf|"), F.to_json(doc)).alias("raw"))


def _backups(spark, sf):
    return json_reports.backups(json_reports.split_reports(_backup_lines(spark, sf), keep=("host", "snapshot_ts")))


@query(
    "backup_last_info",
    f"""with {_BK} select host, strftime(snap, '%Y-%m-%d') as t, config_file, stanza, repo, kind as backup_type, concat('2', lpad(split_part(version, '.', 2), 2, '0'), '00') as version,
    size, stop - start as runtime, cast(err as int) as error from b qualify row_number() over (partition by host, snap, config_file, stanza, repo, kind order by start desc, stop desc) = 1""",
)
def backup_last_info(spark, sf):
    i = B.last_info(_backups(spark, sf))
    return i.select(
        "host", _t(), "config_file", "stanza", "repo", "backup_type", F.col("backrest_repo_version").alias("version"), F.col("repo_total_size_bytes").alias("size"),
        F.col("backup_runtime_seconds").alias("runtime"), F.col("backup_error").alias("error"),
    )


@query(
    "backup_ages",
    f"""with {_BK}, g as (select host, snap, config_file, stanza, repo, min(case when kind = 'full' then stop end) as oldest, max(case when kind = 'full' then stop end) as f,
    max(case when kind in ('full', 'diff') then stop end) as d, max(stop) as i from b group by all)
    select host, strftime(snap, '%Y-%m-%d') as t, stanza, repo, oldest, epoch(snap) - f as full_age, epoch(snap) - d as diff_age, epoch(snap) - i as incr_age from g""",
)
def backup_ages(spark, sf):
    b = _backups(spark, sf)
    ages = B.time_since(b).join(B.oldest_full(b), B.REPO, "left")
    return ages.select("host", _t(), "stanza", "repo", F.col("time_seconds").alias("oldest"), *[F.col(f"{k}_time_since_completion_seconds").alias(f"{k}_age") for k in B.KINDS])


# --- drift and refresh -------------------------------------------------------------------------


@query(
    "drift_status",
    f"""with {_EV}, s as (select host, snap, event_type as name, count(*) // 12 as setting from e group by 1, 2, 3),
    h as (select host, snap, md5(string_agg(concat(name, cast(setting as varchar)), ',' order by name)) as hash from s group by 1, 2),
    p as (select *, case when snap >= timestamp '2024-01-15' then 1 else 0 end as ep from h),
    c as (select *, coalesce(cast(hash <> lag(hash) over (partition by host, ep order by snap) as int), 0) as changed from p)
    select host, strftime(snap, '%Y-%m-%d') as t, hash, changed, max(changed) over (partition by host, ep order by snap) as status from c""",
)
def drift_status(spark, sf):
    e = _events(spark, sf)
    settings = e.groupBy(*SNAP, F.col("event_type").alias("name")).agg(F.floor(F.count("*") / 12).cast("string").alias("setting"))
    accepted = e.select("host").distinct().withColumn("accepted_at", F.lit("2024-01-15").cast("timestamp"))
    d = drift.drift_status(drift.settings_hash(settings), accepted)
    return d.select("host", _t(), "hash", "changed", "status")


@query(
    "drift_known_hash",
    f"""with {_EV}, s as (select host, snap, event_type as name, count(*) // 40 as setting from e group by 1, 2, 3),
    h as (select host, snap, md5(string_agg(concat(name, cast(setting as varchar)), ',' order by name)) as hash from s group by 1, 2)
    select host, strftime(snap, '%Y-%m-%d') as t, cast(hash <> md5('click0,error0,purchase0,signup0,view0') as int) as status from h""",
)
def drift_known_hash(spark, sf):
    """Every host is compared with a hash given from outside instead of its own history."""
    e = _events(spark, sf)
    settings = e.groupBy(*SNAP, F.col("event_type").alias("name")).agg(F.floor(F.count("*") / 40).cast("string").alias("setting"))
    known = e.select("host").distinct().withColumn("known_hash", F.md5(F.lit("click0,error0,purchase0,signup0,view0")))
    return drift.drift_status(drift.settings_hash(settings), known=known).select("host", _t(), "status")


@query(
    "hba_drift",
    """with h as (select concat('h', cast(p_partkey // 50 as varchar)) as host, 1 as snap, md5(string_agg(concat('host', case when p_partkey % 3 = 0 then '<<NULL>>' else p_brand end, p_name, '<<NULL>>', '<<NULL>>', 'md5', '<<NULL>>'), ',' order by p_partkey)) as hash from part group by 1, 2)
    select host, snap, hash from h""",
)
def hba_drift(spark, sf):
    p = table(spark, sf, "part")
    none = F.lit(None).cast("string")
    rules = p.select(
        F.concat(F.lit("h"), F.floor(F.col("p_partkey") / 50).cast("string")).alias("host"), F.lit(1).alias("snapshot_ts"), F.col("p_partkey").alias("line_number"), F.lit("host").alias("type"),
        F.when(F.col("p_partkey") % 3 != 0, F.array("p_brand")).alias("database"), F.array("p_name").alias("user_name"), none.alias("address"), none.alias("netmask"),
        F.lit("md5").alias("auth_method"), F.lit(None).cast("array<string>").alias("options"),
    )
    return drift.hba_hash(rules).select("host", F.col("snapshot_ts").alias("snap"), "hash")


@query(
    "due_list",
    """with l as (select o_custkey, max(o_orderdate) as last from orders group by 1)
    select c_name as view_name, last is null as never from customer left join l on c_custkey = o_custkey where c_custkey % 3 <> 0 and c_custkey % 5 <> 0
    and (last is null or last < timestamp '2001-08-01' - to_seconds(c_custkey * 86400))""",
)
def due_list(spark, sf):
    c = table(spark, sf, "customer")
    registry = c.select(
        F.col("c_name").alias("view_name"), F.concat(F.lit("s"), F.col("c_nationkey")).alias("view_schema"), F.col("c_custkey"), (F.col("c_custkey") % 3 != 0).alias("active"),
        F.when(F.col("c_custkey") % 5 == 0, -1).otherwise(F.col("c_custkey") * 86400).alias("run_seconds"),
    )
    log = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderdate").alias("run_at")).join(registry.select("c_custkey", "view_schema", "view_name"), "c_custkey")
    due = refresh.due_list(registry, log, F.lit("2001-08-01").cast("timestamp"))
    return due.select("view_name", F.col("last_run").isNull().alias("never"))


@query(
    "refresh_delta",
    f"""with {M} select strftime(ts, '%Y-%m-%d') as day, metric, count(*) as n, round(sum(value), 4) as total from m group by 1, 2""",
)
def refresh_delta(spark, sf):
    """Days changed since the stored result are recomputed and replace the stored days."""
    s = m(spark, sf).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))

    def compute(x):
        return x.groupBy("day", "metric").agg(F.count("*").alias("n"), r(F.sum("value"), 4).alias("total"))

    stored = compute(s.where("ts < timestamp'2024-01-20 12:00:00'"))
    late = s.where("ts >= timestamp'2024-01-20 12:00:00'").select("day").distinct()
    fresh = compute(s.join(late, "day", "left_semi"))
    return refresh.merge_refreshed(stored, fresh, late, "day")
