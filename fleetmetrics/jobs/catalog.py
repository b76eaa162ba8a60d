"""Metric blocks: which job yields which value columns and labels, and how they become samples.

A metric is ``<prefix><block>_<value>`` with the block's labels.  Users add their own blocks with
``register_metric_job``; there is no difference between those and the ones listed here.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..model import to_samples
from . import backups, containers, maintenance, pooler, server, statements, storage

PREFIX = "ccp_"


@dataclass(frozen=True)
class Block:
    name: str
    job: Callable[..., DataFrame]
    snapshots: tuple[str, ...]  # names of the snapshot tables the job reads, in call order
    values: tuple[str, ...]
    labels: tuple[str, ...] = ()

    def metrics(self) -> list[str]:
        return [f"{PREFIX}{self.name}_{v}" for v in self.values]


BLOCKS: dict[str, Block] = {}


def register_metric_job(name: str, fn: Callable[..., DataFrame], snapshots, values, key_labels=()) -> Block:
    """Add a block; ``fn`` takes the named snapshot tables and returns a wide frame."""
    block = Block(name, fn, tuple(snapshots), tuple(values), tuple(key_labels))
    BLOCKS[name] = block
    return block


def run(name: str, tables: Mapping[str, DataFrame]) -> DataFrame:
    """The wide result of a block."""
    block = BLOCKS[name]
    return block.job(*[tables[t] for t in block.snapshots])


def samples(name: str, tables: Mapping[str, DataFrame]) -> DataFrame:
    """The block as samples ``(metric, labels, ts, value)``."""
    block = BLOCKS[name]
    return to_samples(run(name, tables), f"{PREFIX}{name}", block.values, block.labels)


def collect(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Samples of every block whose snapshot tables are given."""
    out = None
    for name, block in BLOCKS.items():
        if all(t in tables for t in block.snapshots):
            s = samples(name, tables)
            out = s if out is None else out.unionByName(s)
    if out is None:
        raise ValueError("no block can run on these tables")
    return out


# fixed values: block names, value columns and labels of the monitored fleet
_DB, _REL = ("dbname",), ("dbname", "schemaname", "relname")
_STMT, _STMT_ID = ("role", "dbname"), ("role", "dbname", "queryid", "query")
_REPO = ("config_file", "stanza", "repo")
_POOL = ("pgbouncer_target_host", "conn_pool")

for _args in [
    ("postgresql_version", server.server_version, ["settings"], ["current"]),
    ("is_in_recovery", server.recovery_status, ["servers"], ["status"]),
    ("locks", server.locks, ["databases", "locks"], ["count"], ("dbname", "mode")),
    ("postmaster_runtime", server.postmaster, ["servers"], ["start_time_seconds"]),
    ("postmaster_uptime", server.postmaster, ["servers"], ["seconds"]),
    ("settings_gauge", server.settings_gauge, ["settings"], ["checkpoint_timeout", "checkpoint_completion_target", "shared_buffers"]),
    ("stat_database", server.database_stats, ["database_stats", "databases"], server.DATABASE_COUNTERS, _DB),
    ("transaction_wraparound", server.wraparound, ["databases", "settings"], ["oldest_current_xid", "percent_towards_wraparound", "percent_towards_emergency_autovac"]),
    ("archive_command_status", server.archive_status, ["archiver"], ["seconds_since_last_fail", "seconds_since_last_archive", "archived_count", "failed_count"]),
    ("settings_pending_restart", server.pending_restart, ["settings"], ["count"]),
    ("replication_lag", server.replication_lag, ["servers"], ["replay_time", "received_time"]),
    ("replication_lag_size", server.replication_lag_size, ["replication"], ["bytes"], ("replica", "replica_hostname", "replica_port")),
    ("replication_slots", server.replication_slots, ["slots", "servers"], ["active", "retained_bytes"], ("slot_name",)),
    (
        "connection_stats", server.connection_stats, ["activity", "settings"],
        ["active", "total", "idle", "idle_in_txn", "max_idle_in_txn_time", "max_query_time", "max_blocked_query_time", "max_connections"],
    ),
    ("wal_activity", server.wal_activity, ["wal_files"], ["last_5_min_size_bytes", "total_size_bytes"]),
    ("autovacuum_workers", server.autovacuum_workers, ["activity", "settings"], ["count", "max"]),
    ("stat_bgwriter", server.writers, ["writer_stats"], ["buffers_clean", "maxwritten_clean", "buffers_alloc"]),
    ("stat_checkpointer", server.writers, ["writer_stats"], ["num_timed", "num_requested", "write_time", "sync_time", "buffers_written"]),
    ("stat_io_bgwriter", server.writers, ["writer_stats"], ["writes", "fsyncs"]),
    ("data_checksum_failure", server.checksum_failures, ["database_stats"], ["count", "time_since_last_failure_seconds"], _DB),
    ("database_size", storage.database_size, ["databases"], ["bytes"], _DB),
    ("table_size", storage.published_table_size, ["relations", "namespaces"], ["bytes"], _REL),
    ("stat_user_tables", storage.user_tables, ["user_tables"], storage.TABLE_COUNTERS, _REL),
    ("bloat_check", storage.bloat, ["bloat_stats"], ["size_bytes", "total_wasted_space_bytes"], ("dbname", "schemaname", "objectname")),
    ("sequence_exhaustion", storage.sequence_exhaustion, ["sequences"], ["count"]),
    ("pg_stat_statements_total", statements.totals, ["statements"], ["calls_count", "exec_time_ms", "mean_exec_time_ms", "row_count"], _STMT),
    ("pg_stat_statements_top_mean", statements.top_mean, ["statements"], ["exec_time_ms"], _STMT_ID),
    ("pg_stat_statements_top_total", statements.top_total, ["statements"], ["exec_time_ms"], _STMT_ID),
    ("pg_stat_statements_top_max", statements.top_max, ["statements"], ["exec_time_ms"], _STMT_ID),
    ("pg_stat_statements_top_wal", statements.top_wal, ["statements"], ["records", "fpi", "bytes"], _STMT_ID),
    ("pg_stat_statements_reset", statements.reset_snapshot, ["statement_counters"], ["time"]),
    ("metric_matview_refresh_last_run_fail", maintenance.refresh_failures, ["metric_matviews"], ["count"], _DB),
    ("metric_table_refresh_last_run_fail", maintenance.refresh_failures, ["metric_tables"], ["count"], _DB),
    ("metric_matview_refresh_longest_runtime", maintenance.longest_refresh, ["metric_matviews"], ["seconds"], _DB),
    ("metric_table_refresh_longest_runtime", maintenance.longest_refresh, ["metric_tables"], ["seconds"], _DB),
    ("backrest_last_info", backups.last_info, ["backups"], ["backrest_repo_version", "repo_backup_size_bytes", "repo_total_size_bytes", "backup_runtime_seconds", "backup_error"], (*_REPO, "backup_type")),
    ("backrest_oldest_full_backup", backups.oldest_full, ["backups"], ["time_seconds"], _REPO),
    ("backrest_last_full_backup", lambda b: backups.time_since_kind(b, "full"), ["backups"], ["time_since_completion_seconds"], _REPO),
    ("backrest_last_diff_backup", lambda b: backups.time_since_kind(b, "diff"), ["backups"], ["time_since_completion_seconds"], _REPO),
    ("backrest_last_incr_backup", lambda b: backups.time_since_kind(b, "incr"), ["backups"], ["time_since_completion_seconds"], _REPO),
    ("pgbouncer_pools", pooler.pools, ["pool_rows"], list(pooler.POOL_COUNTS.values()), _POOL),
    ("pgbouncer_database", pooler.databases, ["pool_databases"], ["db_conn_perc_used", "paused", "disabled"], ("pgbouncer_target_host", "pool_db")),
    ("pgbouncer_clients", pooler.clients, ["pool_clients"], ["client_state_count"], (*_POOL, "client_state")),
    ("pgbouncer_servers", pooler.servers, ["pool_servers"], ["server_state_count"], (*_POOL, "server_state")),
    ("pgbouncer_list", pooler.lists, ["pool_lists"], ["item_count"], ("pgbouncer_target_host", "item")),
    ("nodemx_network", containers.network, ["interfaces"], ["tx_bytes", "tx_packets", "rx_bytes", "rx_packets"], ("interface",)),
    ("nodemx_process", containers.process_count, ["cgroup_kv"], ["count"]),
    (
        "nodemx_mem", containers.memory, ["cgroup_kv"],
        [
            "request", "limit", "cache", "rss", "shmem", "mapped_file", "dirty", "active_anon", "inactive_anon", "active_file", "inactive_file",
            "usage_in_bytes", "kmem_usage_in_bytes",
        ],
    ),
    ("nodemx_cpu", containers.cpu, ["cgroup_kv"], ["request", "limit"]),
    ("nodemx_cpucfs", containers.cpu_cfs, ["cgroup_kv"], ["period_us", "quota_us"]),
    ("nodemx_cpuacct", containers.cpu_acct, ["cgroup_kv"], ["usage", "usage_ts"]),
    ("nodemx_cpustat", containers.cpu_stat, ["cgroup_kv"], ["nr_periods", "nr_throttled", "throttled_time", "snap_ts"]),
    ("nodemx_data_disk", containers.data_disk, ["mounts", "filesystems"], ["total_bytes", "available_bytes", "total_file_nodes", "free_file_nodes"], ("mount_point", "fs_type")),
    ("nodemx_disk_activity", containers.disk_activity, ["mounts", "diskstats"], ["sectors_read", "sectors_written"], ("mount_point",)),
]:
    register_metric_job(*_args)


# the pooler's own SHOW tables, melted as they are; names as published: value -> metric suffix
DIRECT_SUFFIX = {"wait": "wait_seconds", "items": "item_count"} | pooler.POOL_COUNTS


def direct_pooler_samples(rows: DataFrame, block: str) -> DataFrame:
    """Samples of one SHOW table (clients, servers, databases, lists, pools)."""
    values, labels = pooler.DIRECT[block]
    wide = pooler.direct(rows, block)
    if "instance" not in wide.columns:
        wide = wide.withColumn("instance", wide["host"])
    renamed = wide.withColumnsRenamed({v: DIRECT_SUFFIX[v] for v in values if v in DIRECT_SUFFIX})
    out = [DIRECT_SUFFIX.get(v, v) for v in values]
    return to_samples(renamed, f"{PREFIX}pgbouncer_{block}", out, labels, target_labels=("instance",))


def drift_samples(status: DataFrame, kind: str = "pg_settings") -> DataFrame:
    """Drift status of settings (``pg_settings``) or access rules (``pg_hba``) as samples."""
    return to_samples(status, f"{PREFIX}{kind}_checksum", ["status"])
