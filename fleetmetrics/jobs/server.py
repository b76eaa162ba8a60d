"""Server-wide jobs: versions, roles, locks, connections, archiving, replication, writers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as X
from ..model import normalize_columns
from ..operators.matching import zero_fill
from ..operators.selectors import encode, non_negative
from ..timeutil import seconds_between

SNAP = ["host", "snapshot_ts"]
NOW = "snapshot_ts"

# fixed values: lock modes in lower case, reported with 0 when nobody holds them
LOCK_MODES = (
    "accesssharelock", "rowsharelock", "rowexclusivelock", "shareupdateexclusivelock",
    "sharelock", "sharerowexclusivelock", "exclusivelock", "accessexclusivelock",
)
MAX_XID_AGE = 2_000_000_000


def setting_columns(settings: DataFrame, names: dict[str, str]) -> DataFrame:
    """Settings by name as columns, one row per snapshot: one scan for any number of settings."""
    aggs = [F.max(F.when(F.col("name") == name, F.col("setting"))).alias(col) for col, name in names.items()]
    return settings.where(F.col("name").isin(list(names.values()))).groupBy(*SNAP).agg(*aggs)


def server_version(settings: DataFrame) -> DataFrame:
    v = setting_columns(settings, {"v": "server_version_num"})
    return v.select(*SNAP, F.col("v").cast("int").alias("current"))


def recovery_status(servers: DataFrame) -> DataFrame:
    """1 for a replica, 2 for a primary."""
    return servers.select(*SNAP, encode(F.col("in_recovery"), {True: 1}, 2).alias("status"))


def locks(databases: DataFrame, held: DataFrame) -> DataFrame:
    """Lock count per database and mode, zero where none is held."""
    counts = (
        held.where(F.col("database").isNotNull()).groupBy(*SNAP, F.col("database").alias("oid"), F.lower("mode").alias("mode"))
        .agg(F.count("*").alias("count"))
    )
    dim = databases.select(*SNAP, "oid", F.col("datname").alias("dbname"))
    return zero_fill(dim, LOCK_MODES, "mode", counts, [*SNAP, "oid"]).drop("oid")


def postmaster(servers: DataFrame) -> DataFrame:
    start = F.col("postmaster_start_time")
    return servers.select(
        *SNAP, (F.unix_micros(start) / 1e6).alias("start_time_seconds"), seconds_between(F.col(NOW), start).alias("seconds"),
    )


def settings_gauge(settings: DataFrame) -> DataFrame:
    names = ("checkpoint_timeout", "checkpoint_completion_target", "shared_buffers")
    v = setting_columns(settings, {n: n for n in names})
    return v.select(
        *SNAP, F.col("checkpoint_timeout").cast("int").alias("checkpoint_timeout"),
        F.col("checkpoint_completion_target").cast("double").alias("checkpoint_completion_target"),
        (F.col("shared_buffers").cast("bigint") * 8192).alias("shared_buffers"),
    )


# fixed values: counters of a database
DATABASE_COUNTERS = (
    "xact_commit", "xact_rollback", "blks_read", "blks_hit", "tup_returned", "tup_fetched", "tup_inserted",
    "tup_updated", "tup_deleted", "conflicts", "temp_files", "temp_bytes", "deadlocks",
)


def database_stats(stats: DataFrame, databases: DataFrame) -> DataFrame:
    """Activity counters of every database that is not a template."""
    real = databases.where("not datistemplate").select(*SNAP, "datname")
    return stats.join(real, [*SNAP, "datname"]).select(*SNAP, F.col("datname").alias("dbname"), *DATABASE_COUNTERS)


def wraparound(databases: DataFrame, settings: DataFrame) -> DataFrame:
    """Oldest transaction age, in percent of the hard limit and of the forced-vacuum limit."""
    # rounding is monotone, so the largest age gives the largest rounded percentage
    age = databases.where("datallowconn").groupBy(*SNAP).agg(F.max("xid_age").alias("oldest_current_xid"))
    limit = setting_columns(settings, {"freeze": "autovacuum_freeze_max_age"})
    oldest = F.col("oldest_current_xid")
    return age.join(limit, SNAP).select(
        *SNAP, "oldest_current_xid", X.half_even(100 * (oldest / F.lit(float(MAX_XID_AGE)))).alias("percent_towards_wraparound"),
        X.half_even(100 * (oldest / F.col("freeze").cast("double"))).alias("percent_towards_emergency_autovac"),
    )


def archive_status(archiver: DataFrame) -> DataFrame:
    gap = seconds_between(F.col("last_failed_time"), F.col("last_archived_time"))
    return archiver.select(
        *SNAP, non_negative(gap).alias("seconds_since_last_fail"),
        seconds_between(F.col(NOW), F.col("last_archived_time")).alias("seconds_since_last_archive"), "archived_count", "failed_count",
    )


def pending_restart(settings: DataFrame) -> DataFrame:
    return settings.groupBy(*SNAP).agg(F.count_if(F.col("pending_restart")).alias("count"))


def replication_lag(servers: DataFrame) -> DataFrame:
    """Seconds behind: 0 on a primary; replay also 0 when everything received is replayed."""
    behind = X.half_even_int(seconds_between(F.col(NOW), F.col("last_xact_replay")))
    primary = ~F.col("in_recovery")
    caught_up = F.coalesce(F.col("receive_lsn") == F.col("replay_lsn"), F.lit(False))
    return servers.select(
        *SNAP, F.when(caught_up | primary, 0).otherwise(behind).alias("replay_time"), F.when(primary, 0).otherwise(behind).alias("received_time"),
    )


def replication_lag_size(replication: DataFrame) -> DataFrame:
    return replication.select(
        *SNAP, F.col("client_addr").alias("replica"), F.col("client_hostname").alias("replica_hostname"),
        F.col("client_port").alias("replica_port"), X.lsn_diff(F.col("sent_lsn"), F.col("replay_lsn")).alias("bytes"),
    )


def replication_slots(slots: DataFrame, servers: DataFrame) -> DataFrame:
    here = F.when(F.col("in_recovery"), F.col("replay_lsn")).otherwise(F.col("insert_lsn"))
    pos = servers.select(*SNAP, here.alias("_here"))
    return slots.join(pos, SNAP).select(
        *SNAP, "slot_name", F.col("active").cast("int").alias("active"), X.lsn_diff(F.col("_here"), F.col("restart_lsn")).alias("retained_bytes"),
    )


def connection_stats(activity: DataFrame, settings: DataFrame) -> DataFrame:
    """Eight measures of the sessions of a server in one conditional aggregation."""

    def longest(cond, since):
        age = seconds_between(F.col(NOW), F.col(since))
        return F.coalesce(F.max(F.when(cond, age)), F.lit(0.0))

    client = F.col("backend_type") == "client backend"
    counted = activity.groupBy(*SNAP).agg(
        F.count("*").alias("total"), F.count_if(F.col("state") == "idle").alias("idle"),
        F.count_if(F.col("state") == "idle in transaction").alias("idle_in_txn"),
        longest(F.col("state") == "idle in transaction", "state_change").alias("max_idle_in_txn_time"),
        longest(client & ~F.col("state").like("idle%"), "query_start").alias("max_query_time"),
        longest(client & (F.col("wait_event_type") == "Lock"), "query_start").alias("max_blocked_query_time"),
    )
    limit = setting_columns(settings, {"max_connections": "max_connections"}).withColumn("max_connections", F.col("max_connections").cast("double"))
    return counted.withColumn("active", F.col("total") - F.col("idle") - F.col("idle_in_txn")).join(limit, SNAP).select(
        *SNAP, "active", "total", "idle", "idle_in_txn", "max_idle_in_txn_time", "max_query_time", "max_blocked_query_time", "max_connections",
    )


def wal_activity(wal_files: DataFrame, minutes: int = 5) -> DataFrame:
    recent = F.col("modification") > F.col(NOW) - F.make_interval(mins=F.lit(minutes))
    zero = F.lit(0).cast("bigint")
    return wal_files.groupBy(*SNAP).agg(
        F.coalesce(F.sum(F.when(recent, F.col("size"))), zero).alias("last_5_min_size_bytes"), F.coalesce(F.sum("size"), zero).alias("total_size_bytes"),
    )


def autovacuum_workers(activity: DataFrame, settings: DataFrame) -> DataFrame:
    n = activity.groupBy(*SNAP).agg(F.count_if(F.col("backend_type") == "autovacuum worker").alias("count"))
    limit = setting_columns(settings, {"max": "autovacuum_max_workers"})
    return n.join(limit, SNAP).select(*SNAP, "count", F.col("max").cast("int").alias("max"))


# old column name -> columns it became; a server reports one of the two
WRITER_ALIASES = {
    "num_timed": ("checkpoints_timed",), "num_requested": ("checkpoints_req",), "write_time": ("checkpoint_write_time",),
    "sync_time": ("checkpoint_sync_time",), "buffers_written": ("buffers_checkpoint",), "buffers_clean": (), "maxwritten_clean": (),
    "buffers_alloc": (), "writes": ("buffers_backend",), "fsyncs": ("buffers_backend_fsync",),
}


def writers(stats: DataFrame) -> DataFrame:
    """Background writer, checkpointer and back-end I/O counters of all server versions."""
    return normalize_columns(stats, WRITER_ALIASES).select(*SNAP, *WRITER_ALIASES)


def checksum_failures(stats: DataFrame) -> DataFrame:
    last = seconds_between(F.col(NOW), F.col("checksum_last_failure"))
    return stats.select(
        *SNAP, F.col("datname").alias("dbname"), F.col("checksum_failures").alias("count"), F.coalesce(last, F.lit(0.0)).alias("time_since_last_failure_seconds"),
    )
