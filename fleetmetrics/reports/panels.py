"""Dashboard panels as data, and one function that evaluates any of them.

A panel selects one or two metrics, applies a range function, combines the pair, scales, and
aggregates.  ``report(samples, "name", grid, job=...)`` returns ``(series_key, t, value)``; the
keyword arguments are the dashboard variables, turned into label matchers.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..alerts.evaluate import as_series, labels_of
from ..model import series_key
from ..operators import windows as W
from ..operators.aggregate import label_values
from ..operators.matching import keep_if_primary
from ..operators.selectors import clamp_max, clamp_min, compare, divide, largest, select
from ..timeutil import instant_micros, micros

_KEYS = ["metric", "series_key"]


@dataclass(frozen=True)
class Panel:
    metric: str
    fn: str = ""  # range function; '' = newest value
    window: str = "5m"
    metric2: str = ""
    form: str = ""  # how two metrics combine, or 'age' for one
    scale: float = 1.0
    base: float = 0.0  # result = base + scale * value
    agg: str = ""
    by: tuple[str, ...] | None = None  # None with an agg: over everything
    without: tuple[str, ...] | None = None
    agg_first: bool = False  # aggregate both sides, then combine
    matchers: tuple[tuple[str, str, str], ...] = ()
    primary_only: bool = False
    above: float | None = None
    clamp: tuple[float | None, float | None] = (None, None)
    vars: tuple[tuple[str, str, str], ...] = ()  # (argument, label, operator)


def _form(name: str, a: Column, b: Column) -> Column:
    safe = divide(a, b)
    return {
        "ratio": safe, "pct": 100 * safe, "free_pct": 100 - 100 * safe, "one_minus": 1 - safe, "minus": a - b, "plus": a + b,
        "state": 100 * a + b, "used_pct": divide((b - a) * 100, b), "rate_pct": divide(a / 1e9, b) * 100,
    }[name]


def _evaluate(samples: DataFrame, p: Panel, grid: W.Grid, lookback: str) -> DataFrame:
    keys = _KEYS
    if not p.fn:
        return W.instant(samples, grid, lookback, keys)
    if p.fn.endswith("_over_time"):
        name = p.fn.removesuffix("_over_time")
        return W.over_time(samples, grid, p.window, [name], keys).withColumnRenamed(name, "value")
    return {"rate": W.rate, "irate": W.irate, "increase": W.increase, "idelta": W.idelta, "changes": W.changes}[p.fn](samples, grid, p.window, keys)


def _aggregate(v: DataFrame, p: Panel, extra: Sequence[str] = ()) -> DataFrame:
    if not p.agg:
        return v
    labels = labels_of(F.col("series_key"))
    if p.without is not None:
        key = series_key(labels, p.without)
    elif p.by:
        wanted = F.array(*[F.lit(b) for b in p.by])
        key = F.to_json(F.map_from_entries(F.array_sort(F.map_entries(F.map_filter(labels, lambda k, x: F.array_contains(wanted, k))))))
    else:
        key = F.lit("{}")
    if p.agg == "groups":  # count(count by (labels) (v))
        return v.select(key.alias("_g"), "t").distinct().groupBy("t").agg(F.count("*").cast("double").alias("value")).withColumn("series_key", F.lit("{}"))
    agg = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": lambda v: largest(F.col(v)), "count": F.count}[p.agg]("value")
    return v.groupBy(*extra, key.alias("series_key"), "t").agg(agg.cast("double").alias("value"))


def _combine(v: DataFrame, p: Panel, metrics: tuple[str, str]) -> DataFrame:
    """Both metrics side by side per (labels, instant): a fold, no join."""
    a = F.max(F.when(F.col("metric") == metrics[0], F.col("value")))
    b = F.max(F.when(F.col("metric") == metrics[1], F.col("value")))
    out = v.groupBy("series_key", "t").agg(a.alias("a"), b.alias("b")).where("a is not null and b is not null")
    return out.select("series_key", "t", _form(p.form, F.col("a"), F.col("b")).alias("value")).where("value is not null")


def evaluate_panel(samples: DataFrame, p: Panel, grid: W.Grid, lookback: str = "5m", **picked: str) -> DataFrame:
    """One panel over samples ``(metric, labels, ts, value)``."""
    chosen = tuple((label, op, picked[arg]) for arg, label, op in p.vars if arg in picked)
    names = [p.metric, *([p.metric2] if p.metric2 else [])]
    raw = as_series(select(samples, names, (*p.matchers, *chosen)))
    return finish_panel(samples, _evaluate(raw, p, grid, lookback), p, grid, lookback)


def finish_panel(samples: DataFrame, v: DataFrame, p: Panel, grid: W.Grid, lookback: str = "5m") -> DataFrame:
    """What a panel does with the values ``(metric, series_key, t, value)`` of its metrics on the grid."""
    if p.metric2 and p.agg_first:
        v = _combine(_aggregate(v, p, ["metric"]), p, (p.metric, p.metric2))
    else:
        if p.metric2:
            v = _combine(v, p, (p.metric, p.metric2))
        elif p.form == "age":
            v = v.withColumn("value", F.unix_micros("t") / 1e6 - F.col("value"))
        v = _aggregate(_clamped(v, *p.clamp), p)
    if p.primary_only:
        v = _primaries(samples, v, grid, lookback)
    if p.scale != 1.0 or p.base:
        v = v.withColumn("value", F.lit(p.base) + F.col("value") * F.lit(p.scale))
    if p.above is not None:
        v = v.where(compare(F.col("value"), ">", p.above))
    return v.select("series_key", "t", "value")


def _clamped(v: DataFrame, low: float | None, high: float | None) -> DataFrame:
    x = F.col("value")
    x = x if low is None else clamp_min(x, low)
    x = x if high is None else clamp_max(x, high)
    return v.withColumn("value", x)


def _primaries(samples: DataFrame, v: DataFrame, grid: W.Grid, lookback: str) -> DataFrame:
    """Keep elements whose (job, instance) is a primary at that instant."""

    def ids(df: DataFrame) -> DataFrame:
        labels = labels_of(F.col("series_key"))
        return df.withColumns({n: F.coalesce(labels[n], F.lit("")) for n in ("job", "instance")})

    role = as_series(select(samples, "ccp_is_in_recovery_status"))
    return keep_if_primary(ids(v), ids(W.instant(role, grid, lookback, _KEYS)), ["job", "instance", "t"])


PANELS: dict[str, Panel] = {}


def _add(dashboard: str, names_and_panels, vars=()) -> None:
    for name, panel in names_and_panels:
        PANELS[f"{dashboard}/{name}"] = replace(panel, vars=tuple(vars))


def report(samples: DataFrame, name: str, grid: W.Grid, lookback: str = "5m", **picked: str) -> DataFrame:
    return evaluate_panel(samples, PANELS[name], grid, lookback, **picked)


def range_report(samples: DataFrame, name: str, at, span, lookback: str = "5m", **picked: str) -> DataFrame:
    """An instant panel whose window is the whole dashboard range, of any length and end."""
    end = instant_micros(at)
    return evaluate_panel(samples, replace(PANELS[name], window=span), W.Grid(end, end, end), lookback, **picked)


# --- fixed values: the panels of the fleet dashboards -------------------------------------------

_CLUSTER = (("cluster", "pg_cluster", "="),)
_POD = (*_CLUSTER, ("pod", "pod", "="))
_ROLE = (*_CLUSTER, ("role", "role", "="))
_NODES = (("job", "job", "=~"),)
_PG = (("cluster_name", "cluster_name", "="), ("job", "job", "="))
_MASTER = (("role", "=", "master"),)
_POD_LABELS = ("deployment", "instance", "ip", "pod")
_INST = ("instance", "ip", "role")
_SVC = ("pod", "instance", "ip")
_NO_TMPFS = (("fstype", "!~", ".*tmpfs.*|.*root.*|.*pipe.*"),)

# container dashboards: backups
_BACKREST = "ccp_backrest_"
_add("container_backups", [("recovery_window", Panel("ccp_backrest_oldest_full_backup_time_seconds", form="age", matchers=_MASTER))], _CLUSTER)
for _k in ("incr", "diff", "full"):
    _kind = (("backup_type", "=", _k), *_MASTER)
    _add(
        "container_backups",
        [
            (f"time_since_{_k}", Panel(f"{_BACKREST}last_{_k}_backup_time_since_completion_seconds", agg="min", without=_POD_LABELS, matchers=_MASTER)),
            (f"runtime_{_k}", Panel(f"{_BACKREST}last_info_backup_runtime_seconds", agg="min", without=_POD_LABELS, matchers=_kind)),
            (f"size_{_k}", Panel(f"{_BACKREST}last_info_repo_backup_size_bytes", agg="min", without=_POD_LABELS, matchers=_kind)),
        ],
        _CLUSTER,
    )
_add(
    "container_backups",
    [
        ("time_since_archive", Panel("ccp_archive_command_status_seconds_since_last_archive", agg="min", without=_POD_LABELS, matchers=_MASTER)),
        ("wal_failed", Panel("ccp_archive_command_status_failed_count", "idelta", "1m", agg="avg", without=("instance", "ip"), matchers=_MASTER)),
        ("wal_archived", Panel("ccp_archive_command_status_archived_count", "idelta", "1m", agg="avg", without=("instance", "pod", "ip"), matchers=_MASTER)),
    ],
    _CLUSTER,
)

# container dashboards: one pod
_add(
    "pod",
    [
        ("type", Panel("pg_replication_is_replica")),
        ("cpu_usage", Panel("ccp_nodemx_cpuacct_usage", "idelta", "30s", "ccp_nodemx_cpuacct_usage_ts", "rate_pct", agg="avg", without=_INST)),
        ("cpu_quota", Panel("ccp_nodemx_cpucfs_quota_us", metric2="ccp_nodemx_cpucfs_period_us", form="pct", agg="avg", without=_INST)),
        ("processes", Panel("ccp_nodemx_process_count", agg="avg", without=_INST)),
        ("cpu_throttle", Panel("ccp_nodemx_cpustat_throttled_time", "idelta", "30s", "ccp_nodemx_cpustat_snap_ts", "rate_pct", agg="avg", without=_INST)),
        ("disk_used", Panel("ccp_nodemx_data_disk_available_bytes", metric2="ccp_nodemx_data_disk_total_bytes", form="used_pct", agg="avg", without=_INST)),
        ("inodes_used", Panel("ccp_nodemx_data_disk_free_file_nodes", metric2="ccp_nodemx_data_disk_total_file_nodes", form="used_pct", agg="avg", without=_INST)),
        ("mem_free", Panel("ccp_nodemx_mem_limit", metric2="ccp_nodemx_mem_usage_in_bytes", form="minus", agg="avg", without=_INST, clamp=(0, None))),
        *[
            (f"net_{d}", Panel(f"ccp_nodemx_network_{d}_bytes", "rate", "1m", agg="avg", without=_INST, matchers=(("interface", "!=", "tunl0"),)))
            for d in ("rx", "tx")
        ],
        *[(f"disk_{d}", Panel(f"ccp_nodemx_disk_activity_sectors_{d}", "rate", "1m", scale=512, agg="avg", without=_INST)) for d in ("read", "written")],
        *[
            (f"mem_{m}", Panel(f"ccp_nodemx_mem_{m}", agg="avg", without=_INST))
            for m in ("limit", "request", "usage_in_bytes", "cache", "dirty", "shmem", "rss", "mapped_file", "kmem_usage_in_bytes", "inactive_anon", "active_file", "inactive_file")
        ],
        *[(f"cpu_{m}", Panel(f"ccp_nodemx_cpu_{m}", agg="avg", without=_INST)) for m in ("limit", "request")],
    ],
    _POD,
)

# container dashboards: overview and service health
_add("container_overview", [("state", Panel("pg_up", metric2="ccp_is_in_recovery_status", form="state", agg="sum", agg_first=True))], (("cluster", "pg_cluster", "=~"),))
_add(
    "service_health",
    [
        ("saturation_connections", Panel("ccp_connection_stats_total", metric2="ccp_connection_stats_max_connections", form="ratio", agg="sum", without=_SVC, agg_first=True)),
        ("saturation_disk", Panel("ccp_nodemx_data_disk_available_bytes", metric2="ccp_nodemx_data_disk_total_bytes", form="free_pct", agg="avg", without=_SVC, agg_first=True)),
        ("traffic_transactions", Panel("ccp_stat_database_xact_commit", "irate", "1m", "ccp_stat_database_xact_rollback", "plus", agg="sum", agg_first=True)),
        ("traffic_connections", Panel("ccp_connection_stats_active", agg="max", without=(*_SVC, "dbname"))),
        ("traffic_statements", Panel("ccp_pg_stat_statements_total_calls_count", "irate", "1m", agg="sum")),
        ("errors_rollback", Panel("ccp_stat_database_xact_rollback", "irate", "1m", agg="sum", without=_SVC)),
        *[(f"errors_{m}", Panel(f"ccp_stat_database_{m}", "irate", "1m", agg="sum", without=(*_SVC, "dbname"))) for m in ("deadlocks", "conflicts")],
        ("errors_scrape", Panel("pg_exporter_last_scrape_error", agg="max", without=(*_SVC, "dbname"))),
        ("errors_archive", Panel("ccp_archive_command_status_seconds_since_last_fail", agg="max", without=_SVC, clamp=(None, 1))),
        ("duration_mean", Panel("ccp_pg_stat_statements_total_mean_exec_time_ms", agg="max", without=_SVC)),
        ("duration_max", Panel("ccp_pg_stat_statements_top_max_exec_time_ms", agg="max", without=(*_SVC, "query", "queryid"))),
    ],
    _ROLE,
)

# container dashboards: statements over the whole dashboard range
_STMT = (*_ROLE, ("dbname", "dbname", "=~"), ("dbuser", "exported_role", "=~"))
_LESS = ("instance", "ip", "deployment", "pod")
_ALL = (*_LESS, "dbname", "exported_role")
_T, _TOP = "ccp_pg_stat_statements_total_", "ccp_pg_stat_statements_top_"
_add(
    "container_statements",
    [
        ("executed", Panel(f"{_T}calls_count", "sum_over_time", agg="sum", without=_ALL)),
        ("runtime", Panel(f"{_T}exec_time_ms", "sum_over_time", agg="sum", without=_ALL)),
        ("mean_runtime", Panel(f"{_T}mean_exec_time_ms", "sum_over_time", agg="avg", without=_ALL)),
        ("rows", Panel(f"{_T}row_count", "sum_over_time", agg="sum", without=_ALL)),
        ("executions", Panel(f"{_T}calls_count", "irate", agg="sum", without=_LESS)),
        ("top_mean", Panel(f"{_TOP}mean_exec_time_ms", "avg_over_time", agg="avg", without=_LESS)),
        ("top_max", Panel(f"{_TOP}max_exec_time_ms", "max_over_time", agg="max", without=_LESS)),
        ("top_total", Panel(f"{_TOP}total_exec_time_ms", "irate", agg="sum", without=_LESS)),
        ("top_wal", Panel(f"{_TOP}wal_bytes")),
    ],
    _STMT,
)

# host dashboards: file systems, network, operating system
_SIZE = (("", "_bytes"), ("_old", ""))
for _suffix, _unit in _SIZE:
    _free, _total = f"node_filesystem_free{_unit}", f"node_filesystem_size{_unit}"
    _add(
        "filesystem",
        [
            (f"used_pct{_suffix}", Panel(_free, metric2=_total, form="free_pct", matchers=_NO_TMPFS)),
            (f"used{_suffix}", Panel(_total, metric2=_free, form="minus", matchers=_NO_TMPFS)),
        ],
        _NODES,
    )
_add(
    "filesystem",
    [
        *[(m, Panel(f"node_disk_{m}", "irate")) for m in ("reads_completed_total", "writes_completed_total", "reads_completed", "writes_completed", "io_time_seconds_total")],
        # byte counters stay bytes; only sector counters are multiplied
        *[(m, Panel(f"node_disk_{m}", "irate")) for m in ("read_bytes_total", "written_bytes_total")],
        *[(m, Panel(f"node_disk_{m}", "irate", scale=512)) for m in ("sectors_read", "sectors_written")],
    ],
    _NODES,
)
_NET = (("device", "device", "=~"), *_NODES)
for _d in ("receive", "transmit"):
    _bytes = f"node_network_{_d}_bytes_total"
    _add(
        "network",
        [
            (f"{_d}_rate", Panel(_bytes, "irate", "3m", agg="sum")), (f"{_d}_minute", Panel(_bytes, "increase", "1m", agg="sum")),
            (f"{_d}_day", Panel(_bytes, "increase", "24h", agg="sum")),
        ],
        _NET,
    )
_add("network", [(f"receive_{m}", Panel(f"node_network_receive_{m}_total", "irate", "3m", agg="sum")) for m in ("drop", "errs")], _NET)
_add("network", [(f"load{n}", Panel(f"node_load{n}")) for n in (1, 5, 15)], _NODES)
for _proto, _counters in {
    "Tcp": ("CurrEstab", "ActiveOpens", "PassiveOpens", "EstabResets", "AttemptFails", "RetransSegs"),
    "Udp": ("InDatagrams", "InErrors", "OutDatagrams", "NoPorts", "InCsumErrors", "RcvbufErrors", "SndbufErrors"),
}.items():
    _add("network", [(f"{_proto.lower()}_{c}", Panel(f"node_netstat_{_proto}_{c}", "irate", agg="sum")) for c in _counters], _NODES)
_add(
    "network",
    [
        ("conntrack_free", Panel("node_nf_conntrack_entries_limit", metric2="node_nf_conntrack_entries", form="minus", agg="sum", agg_first=True)),
        ("conntrack_limit", Panel("node_nf_conntrack_entries_limit", agg="sum")),
    ],
    _NODES,
)
_M = "node_memory_"
_add(
    "os",
    [
        *[(f"load{n}", Panel(f"node_load{n}")) for n in (1, 5, 15)],
        *[(f"cpu_{m}", Panel("node_cpu_seconds_total", "irate", agg="sum", by=("mode",), matchers=(("mode", "=", m),))) for m in ("idle", "user", "iowait", "system")],
        ("mem_available", Panel(f"{_M}MemAvailable_bytes", metric2=f"{_M}MemTotal_bytes", form="ratio")),
        ("mem_used", Panel(f"{_M}MemTotal_bytes", metric2=f"{_M}MemAvailable_bytes", form="minus")),
        ("swap_used_ratio", Panel(f"{_M}SwapFree_bytes", metric2=f"{_M}SwapTotal_bytes", form="one_minus")),
        ("swap_used", Panel(f"{_M}SwapTotal_bytes", metric2=f"{_M}SwapFree_bytes", form="minus")),
        *[(n, Panel(f"{_M}{m}_bytes")) for n, m in (("mem_total", "MemTotal"), ("mem_cached", "Cached"), ("swap_total", "SwapTotal"), ("swap_cached", "SwapCached"))],
        ("filesystem_by_device", Panel("node_filesystem_free_bytes", metric2="node_filesystem_size_bytes", form="ratio", scale=-100, base=100, agg="sum", by=("job", "device", "mountpoint"), matchers=_NO_TMPFS)),
        ("filesystem", Panel("node_filesystem_free_bytes", metric2="node_filesystem_size_bytes", form="free_pct", matchers=_NO_TMPFS)),
        ("filesystem_old", Panel("node_filesystem_free", metric2="node_filesystem_size", form="free_pct", matchers=_NO_TMPFS)),
        ("up", Panel("up", matchers=(("exp_type", "=", "node"),))),
    ],
    _NODES,
)

# pooler dashboards
_PGB = (("cluster_name", "cluster_name", "=~"), ("job", "job", "=~"))
_PGBF = (("cluster_name", "cluster_name", "=~"), ("target", "pgbouncer_target_host", "=~"), ("conn_pool", "conn_pool", "="))
_STATES = ("client_active", "client_waiting", "server_active", "server_idle", "server_used")
_add(
    "pooler_direct",
    [
        *[(s, Panel(f"ccp_pgbouncer_pools_{s}", agg="sum")) for s in _STATES],
        ("items", Panel("ccp_pgbouncer_lists_item_count")),
        ("pool_used", Panel("ccp_pgbouncer_databases_current_connections", metric2="ccp_pgbouncer_databases_pool_size", form="ratio")),
        ("clients", Panel("ccp_pgbouncer_clients_wait_seconds", agg="sum", by=("pool", "state"))),
        ("servers", Panel("ccp_pgbouncer_servers_close_needed", agg="sum", by=("state",))),
    ],
    (*_PGB, ("pool", "database", "=~"), ("name", "name", "=~")),
)
_add(
    "pooler",
    [
        ("conn_used", Panel("ccp_pgbouncer_database_db_conn_perc_used")),
        *[(s, Panel(f"ccp_pgbouncer_pools_{s}", agg="sum")) for s in _STATES],
        ("items", Panel("ccp_pgbouncer_list_item_count")),
        ("clients", Panel("ccp_pgbouncer_clients_client_state_count")),
        ("servers", Panel("ccp_pgbouncer_servers_server_state_count")),
    ],
    _PGBF,
)

# database dashboards
_OBJ = (*_PG, ("dbname", "dbname", "="), ("schemaname", "schemaname", "="), ("objectname", "objectname", "="), ("relname", "relname", "="))
_WASTE, _BSIZE = "ccp_bloat_check_total_wasted_space_bytes", "ccp_bloat_check_size_bytes"
_add(
    "bloat",
    [
        ("total_pct", Panel(_WASTE, metric2=_BSIZE, form="pct", agg="sum", agg_first=True)), ("table", Panel(_WASTE)),
        ("top", Panel(_WASTE, above=10240)),
    ],
    _OBJ,
)
_add("crud", [(n, Panel(f"ccp_stat_user_tables_n_tup_{n}", "rate", "60s")) for n in ("ins", "upd", "del")], _OBJ)
_add("table_size", [("size", Panel("ccp_table_size_bytes"))], _OBJ)
_BACK = (("stanza", "stanza", "="), ("repo", "repo", "="))
_add(
    "backups",
    [
        ("recovery_window", Panel(f"{_BACKREST}oldest_full_backup_time_seconds", form="age", primary_only=True)),
        *[(f"time_since_{k}", Panel(f"{_BACKREST}last_{k}_backup_time_since_completion_seconds", primary_only=True)) for k in ("incr", "diff", "full")],
        ("runtime", Panel(f"{_BACKREST}last_info_backup_runtime_seconds", primary_only=True)),
        ("size_total", Panel(f"{_BACKREST}last_info_repo_total_size_bytes", primary_only=True)),
        ("size_actual", Panel(f"{_BACKREST}last_info_repo_backup_size_bytes", primary_only=True)),
    ],
    _BACK,
)
_add(
    "statements",
    [
        ("executed", Panel(f"{_T}calls_count", agg="sum")), ("runtime", Panel(f"{_T}exec_time_ms", agg="sum")),
        ("mean_runtime", Panel(f"{_T}mean_exec_time_ms", agg="avg")), ("rows", Panel(f"{_T}row_count", agg="sum")),
        ("executions", Panel(f"{_T}calls_count", "irate", "1m")),
        *[(f"top_{m}", Panel(f"{_TOP}{m}_exec_time_ms")) for m in ("mean", "max", "total")], ("top_wal", Panel(f"{_TOP}wal_bytes")),
    ],
    (*_PG, ("dbname", "dbname", "=~"), ("role", "role", "=~")),
)
_add(
    "overview",
    [
        ("state", Panel("up", metric2="ccp_is_in_recovery_status", form="ratio", matchers=(("exp_type", "=", "pg"),))),
        ("state_exporter", Panel("pg_up", metric2="ccp_is_in_recovery_status", form="ratio")),
    ],
    _NODES,
)

# alert dashboards
_add(
    "alerts",
    [
        ("namespaces", Panel("pg_up", agg="groups", by=("kubernetes_namespace",))), ("clusters", Panel("pg_up", agg="groups", by=("pg_cluster",))),
        ("instances", Panel("pg_up", agg="count")),
        *[(s, Panel("ALERTS", agg="sum", matchers=(("alertstate", "=", "firing"), ("severity", "=", s)))) for s in ("critical", "warning", "info")],
        ("firing", Panel("ALERTS", matchers=(("alertstate", "=", "firing"),), above=0)), ("pending", Panel("ALERTS", matchers=(("alertstate", "=", "pending"),))),
    ],
)

# value mappings of the overview panels
STATE_TEXT = {0.0: "DOWN", 0.5: "PRIMARY", 1.0: "REPLICA"}
CLUSTER_TEXT = ((0, 99, "DOWN"), (100, 199, "STANDALONE"), (200, float("inf"), "HA"))


# dashboard variables: metric, fixed matchers and label of each
VARIABLES = {
    "cluster": (None, (), "pg_cluster"), "pod": (None, (), "pod"), "role": (None, (), "role"),
    "osnodes": ("up", (("exp_type", "=", "node"),), "job"), "network_device": ("node_network_receive_bytes_total", (), "device"),
    "pgcluster": ("up", (("exp_type", "=", "pg"),), "cluster_name"), "pgnodes": ("up", (("exp_type", "=", "pg"),), "job"),
    "pgbcluster": ("up", (("exp_type", "=", "pgbouncer"),), "cluster_name"), "pgbnode": ("up", (("exp_type", "=", "pgbouncer"),), "job"),
    "pool": ("ccp_pgbouncer_databases_pool_size", (), "name"), "pgbouncer_target_host": ("ccp_pgbouncer_pools_client_active", (), "pgbouncer_target_host"),
    "conn_pool": ("ccp_pgbouncer_pools_client_active", (), "conn_pool"), "bloat_database": (_WASTE, (), "dbname"), "bloat_schema": (_WASTE, (), "schemaname"),
    "bloat_object": (_WASTE, (), "objectname"), "crud_database": ("ccp_stat_user_tables_n_tup_ins", (), "dbname"),
    "crud_schema": ("ccp_stat_user_tables_n_tup_ins", (), "schemaname"), "crud_table": ("ccp_stat_user_tables_n_tup_ins", (), "relname"),
    "size_database": ("ccp_database_size_bytes", (), "dbname"), "size_schema": ("ccp_table_size_bytes", (), "schemaname"), "size_table": ("ccp_table_size_bytes", (), "relname"),
    "backrest_stanza": ("ccp_backrest_last_info_backup_runtime_seconds", (), "stanza"), "backrest_repo": ("ccp_backrest_last_info_backup_runtime_seconds", (), "repo"),
    "statement_database": (f"{_T}calls_count", (), "dbname"), "statement_role": (f"{_T}calls_count", (), "role"), "dbuser": (f"{_T}calls_count", (), "exported_role"),
}


def variable(samples: DataFrame, name: str, **picked: str) -> DataFrame:
    """Choices of a dashboard variable, given the labels already picked."""
    metric, fixed, label = VARIABLES[name]
    return label_values(select(samples, metric, (*fixed, *[(k, "=", v) for k, v in picked.items()])), label)
