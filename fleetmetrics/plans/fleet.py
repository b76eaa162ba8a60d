"""Jobs over servers, poolers, containers and replicas that the other plans do not run."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import drift
from ..jobs import catalog, pooler, server, storage
from ..jobs import containers as C
from ..sources import samples as smp
from ..sources.tables import table
from .registry import M, m, query
from .snapshots import _EV, SNAP, _events, _t

_AT = "2024-01-31"


def _parts(spark, sf):
    return table(spark, sf, "part").withColumns({"host": F.lit("h0"), "snapshot_ts": F.lit(_AT).cast("timestamp")})


@query("replication_lag_size", "select p_name as replica, p_partkey as replica_port, cast(4294967296 + p_partkey * 4095 as decimal(20, 0)) as bytes from part")
def replication_lag_size(spark, sf):
    def position(high, low):
        return F.concat(F.hex(high.cast("bigint")), F.lit("/"), F.hex(low.cast("bigint")))

    k, size = F.col("p_partkey"), F.col("p_size")
    rows = _parts(spark, sf).withColumns(
        {"client_addr": F.col("p_name"), "client_hostname": F.col("p_brand"), "client_port": k, "sent_lsn": position(size, k * 4096), "replay_lsn": position(size - 1, k)}
    )
    return server.replication_lag_size(rows).select("replica", "replica_port", "bytes")


@query(
    "bloat_table",
    """select p_type as schemaname, p_name as objectname, p_partkey as k, p_size * 81920 as size_bytes,
    cast(round_even(p_size * 100 + (p_partkey * 3 - (p_size * 10 - (cast(50 + p_partkey % 51 as double) / 100) * (p_size * 10)) * 8192), 0) as bigint) as wasted from part""",
)
def bloat_table(spark, sf):
    rows = _parts(spark, sf).select(
        F.col("p_partkey").cast("string").alias("host"), "snapshot_ts", F.lit("db").alias("dbname"), F.col("p_type").alias("schemaname"), F.col("p_name").alias("objectname"),
        (F.col("p_size") * 81920).alias("size_bytes"), (F.col("p_size") * 100).alias("dead_tuple_size_bytes"), (F.col("p_partkey") * 3).alias("free_space_bytes"),
        (F.col("p_size") * 10).alias("relpages"), (50 + F.col("p_partkey") % 51).cast("double").alias("fillfactor"),
    )
    return storage.bloat(rows).select("schemaname", "objectname", F.col("host").cast("bigint").alias("k"), F.col("size_bytes").cast("bigint").alias("size_bytes"), F.col("total_wasted_space_bytes").alias("wasted"))


def _target(df):
    return df.withColumn("pgbouncer_target_host", F.lit("t"))


@query("pool_servers", f"with {_EV} select host, strftime(snap, '%Y-%m-%d') as t, concat('db', cast(user_id % 3 as varchar), '.u') as conn_pool, event_type as state, count(*) as n from e group by 1, 2, 3, 4")
def pool_servers(spark, sf):
    rows = _target(_events(spark, sf)).withColumns({"database": F.concat(F.lit("db"), F.col("user_id") % 3), "user": F.lit("u"), "state": F.col("event_type")})
    return pooler.servers(rows).select("host", _t(), "conn_pool", F.col("server_state").alias("state"), F.col("server_state_count").alias("n"))


_ITEMS = ("databases", "pools", "free_clients", "used_clients", "free_servers")


@query(
    "pool_lists",
    f"""with {_EV}, l as (select host, snap, case event_type when 'signup' then 'databases' when 'error' then 'pools' when 'click' then 'free_clients' when 'view' then 'used_clients' else 'free_servers' end as item, count(*) as n from e group by 1, 2, 3)
    select host, strftime(snap, '%Y-%m-%d') as t, item, n from l where item <> 'used_clients'""",
)
def pool_lists(spark, sf):
    """Only the listed items are reported."""
    item = F.element_at(F.create_map(*[F.lit(x) for pair in zip(("signup", "error", "click", "view", "purchase"), _ITEMS, strict=True) for x in pair]), F.col("event_type"))
    rows = _target(_events(spark, sf).withColumn("list", item).groupBy(*SNAP, "list").agg(F.count("*").alias("items")))
    return pooler.lists(rows).select("host", _t(), "item", F.col("item_count").alias("n"))


@query(
    "pool_direct_blocks",
    f"""with {_EV}, x as (select host, snap, event_type, count(*) as n, cast(floor(sum(value)) as bigint) as v from e group by 1, 2, 3),
    u as (select host, snap, event_type as label, unnest([
      {{'metric': 'servers_close_needed', 'value': n}}, {{'metric': 'lists_item_count', 'value': v}}, {{'metric': 'pools_client_active', 'value': n}}, {{'metric': 'pools_client_waiting', 'value': v}},
      {{'metric': 'pools_server_active', 'value': n + 1}}, {{'metric': 'pools_server_idle', 'value': n + 2}}, {{'metric': 'pools_server_used', 'value': n + 3}},
      {{'metric': 'databases_pool_size', 'value': n}}, {{'metric': 'databases_min_pool_size', 'value': n}}, {{'metric': 'databases_reserve_pool', 'value': n}}, {{'metric': 'databases_max_connections', 'value': v}},
      {{'metric': 'databases_current_connections', 'value': n}}, {{'metric': 'databases_paused', 'value': n}}, {{'metric': 'databases_disabled', 'value': n}}]) as s from x)
    select concat('ccp_pgbouncer_', s.metric) as metric, host, label, count(*) as n, cast(sum(s.value) as double) as total from u group by 1, 2, 3""",
)
def pool_direct_blocks(spark, sf):
    """The four other tables that the pooler shows, melted into samples."""
    n, v, kind = F.col("n"), F.col("v"), F.col("event_type")
    x = _events(spark, sf).groupBy(*SNAP, "event_type").agg(F.count("*").alias("n"), F.floor(F.sum("value")).cast("bigint").alias("v"))
    text = {c: F.lit("x") for c in ("user", "state", "application_name", "link", "host_name", "port", "force_user", "pool_mode")}
    base = x.withColumns(text)
    blocks = {
        "servers": (base.withColumns({"database": kind, "close_needed": n}), "database"),
        "lists": (base.withColumns({"list": kind, "items": v}), "list"),
        "pools": (base.withColumns({"database": kind, "cl_active": n, "cl_waiting": v, "sv_active": n + 1, "sv_idle": n + 2, "sv_used": n + 3}), "database"),
        "databases": (base.withColumns({"name": kind, "database": kind, "max_connections": v} | {c: n for c in ("pool_size", "min_pool_size", "reserve_pool", "current_connections", "paused", "disabled")}), "name"),
    }
    out = None
    for name, (rows, label) in blocks.items():
        s = catalog.direct_pooler_samples(rows, name)
        part = s.select("metric", F.col("labels")["instance"].alias("host"), F.col("labels")[label].alias("label"), "value")
        out = part if out is None else out.unionByName(part)
    return out.groupBy("metric", "host", "label").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


@query("container_network", f"with {_EV} select host, strftime(snap, '%Y-%m-%d') as t, event_type as interface, count(*) as tx_packets, cast(sum(user_id) as bigint) as rx_bytes from e group by 1, 2, 3")
def container_network(spark, sf):
    rows = _events(spark, sf).groupBy(*SNAP, F.col("event_type").alias("interface")).agg(
        F.sum("event_id").alias("tx_bytes"), F.count("*").alias("tx_packets"), F.sum("user_id").alias("rx_bytes"), F.count("*").alias("rx_packets")
    )
    return C.network(rows).select("host", _t(), "interface", "tx_packets", "rx_bytes")


@query(
    "container_cpu_stat",
    f"""with {_EV} select host, strftime(snap, '%Y-%m-%d') as t, count(*) filter (event_type = 'click') as nr_periods, count(*) filter (event_type = 'view') as nr_throttled,
    count(*) filter (event_type = 'error') as throttled_time, count(*) filter (event_type = 'signup') as processes, epoch(snap) as snap_ts from e group by host, snap""",
)
def container_cpu_stat(spark, sf):
    """Throttling and process counts out of key/value rows."""
    of = {"click": ("cpu.stat", "nr_periods"), "view": ("cpu.stat", "nr_throttled"), "error": ("cpu.stat", "throttled_time"), "signup": ("process_count", "")}
    counts = [F.struct(F.lit(f).alias("file"), F.lit(k).alias("key"), F.count_if(F.col("event_type") == e).alias("val")) for e, (f, k) in of.items()]
    rows = _events(spark, sf).groupBy(*SNAP).agg(F.array(*counts).alias("kv")).select(*SNAP, F.lit("unified").alias("mode"), F.inline("kv"))
    out = C.cpu_stat(rows).join(C.process_count(rows).withColumnRenamed("count", "processes"), SNAP)
    return out.select("host", _t(), "nr_periods", "nr_throttled", "throttled_time", "processes", "snap_ts")


_HASHES = f"""{_EV}, s as (select host, snap, event_type as name, count(*) // 12 as setting from e group by 1, 2, 3),
    h as (select host, snap, md5(string_agg(concat(name, cast(setting as varchar)), ',' order by name)) as hash from s group by 1, 2),
    c as (select *, coalesce(cast(hash <> lag(hash) over w as int), 0) as changed, row_number() over w as i from h window w as (partition by host order by snap)),
    x as (select *, max(changed) over (partition by host order by snap) as status from c)"""


def _hashes(spark, sf):
    settings = _events(spark, sf).groupBy(*SNAP, F.col("event_type").alias("name")).agg(F.floor(F.count("*") / 12).cast("string").alias("setting"))
    return drift.settings_hash(settings)


@query("drift_history", f"with {_HASHES} select host, strftime(snap, '%Y-%m-%d') as t, hash, status as valid from x where i = 1 or changed = 1")
def drift_history(spark, sf):
    """Stored history: the first state of a host and every change after it."""
    h = _hashes(spark, sf)
    status = drift.drift_status(h)
    if "epoch" not in status.columns:
        status = status.withColumn("epoch", F.lit(0))
    return drift.history_rows(h, status).select("host", F.date_format("created_at", "yyyy-MM-dd").alias("t"), "hash", F.col("valid").cast("int").alias("valid"))


@query(
    "drift_replica",
    f"""with {_HASHES}, p as (select snap, hash, status from x where host = 'h0' and (i = 1 or changed = 1)),
    r as (select h.host, h.snap, h.hash, (select max(p.snap) from p where p.snap <= h.snap) as at from h where host in ('h1', 'h2'))
    select r.host, strftime(r.snap, '%Y-%m-%d') as t, r.hash, case when p.hash is null then 0 when r.hash <> p.hash then 1 else p.status end as status from r left join p on p.snap = r.at""",
)
def drift_replica(spark, sf):
    """Two hosts are replicas of a third and are compared with its stored history."""
    h = _hashes(spark, sf)
    status = drift.drift_status(h)
    if "epoch" not in status.columns:
        status = status.withColumn("epoch", F.lit(0))
    history = drift.history_rows(h, status).where("host = 'h0'")
    primary_of = _events(spark, sf).select("host").distinct().where("host in ('h1', 'h2')").withColumn("primary", F.lit("h0"))
    return drift.replica_status(h, history, primary_of).select("host", _t(), "hash", "status")


@query("copied_labels", f"with {M} select host as instance, metric as kind, count(*) as n from m group by 1, 2")
def copied_labels(spark, sf):
    """Discovered labels are kept under their stored names."""
    s = m(spark, sf).select("metric", F.create_map(F.lit("__host"), F.col("host"), F.lit("__kind"), F.col("metric")).alias("labels"))
    out = smp.copy_labels(s, {"__host": "instance", "__kind": "kind"})
    return out.groupBy(F.col("labels")["instance"].alias("instance"), F.col("labels")["kind"].alias("kind")).agg(F.count("*").alias("n"))
