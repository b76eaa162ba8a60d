"""Container resources from control-group, network and disk snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.selectors import unlimited_to_zero
from .server import SNAP

MOUNTS = ("/pgdata", "/pgwal")
MOUNT_PREFIX = "/tablespaces/%"


def _pivot(kv: DataFrame, wanted: dict[str, tuple[str, str]]) -> DataFrame:
    """Named (file, key) values side by side, in one scan of the key/value snapshot."""
    aggs = [F.max(F.when((F.col("file") == f) & (F.col("key") == k), F.col("val"))).alias(name) for name, (f, k) in wanted.items()]
    files = sorted({f for f, _ in wanted.values()})
    return kv.where(F.col("file").isin(files)).groupBy(*SNAP, "mode").agg(*aggs)


def _by_mode(legacy: Column, unified: Column) -> Column:
    return F.when(F.col("mode") == "legacy", legacy).otherwise(unified)


def _stat(name: str) -> tuple[str, str]:
    return ("memory.stat", name)


def memory(kv: DataFrame) -> DataFrame:
    """Memory use; the key names differ between the two control-group versions, no limit reads 0."""
    stats = ("cache", "rss", "shmem", "mapped_file", "dirty", "file_dirty", "active_anon", "inactive_anon", "active_file", "inactive_file")
    wanted = {s: _stat(s) for s in stats} | {
        "request": ("mem_request", ""), "old_limit": ("memory.limit_in_bytes", ""), "new_limit": ("memory.max", ""),
        "old_usage": ("memory.usage_in_bytes", ""), "new_usage": ("memory.current", ""), "kmem": ("memory.kmem.usage_in_bytes", ""),
    }
    p = _pivot(kv, wanted)
    zero = F.lit(0).cast("bigint")
    return p.select(
        *SNAP, "request", unlimited_to_zero(F.col("mode"), _by_mode(F.col("old_limit"), F.col("new_limit"))).alias("limit"),
        _by_mode(F.col("cache"), zero).alias("cache"), _by_mode(F.col("rss"), zero).alias("rss"), "shmem",
        _by_mode(F.col("mapped_file"), zero).alias("mapped_file"), _by_mode(F.col("dirty"), F.col("file_dirty")).alias("dirty"),
        "active_anon", "inactive_anon", "active_file", "inactive_file", _by_mode(F.col("old_usage"), F.col("new_usage")).alias("usage_in_bytes"),
        _by_mode(F.col("kmem"), zero).alias("kmem_usage_in_bytes"),
    )


def process_count(kv: DataFrame) -> DataFrame:
    return _pivot(kv, {"count": ("process_count", "")}).drop("mode")


def cpu(kv: DataFrame) -> DataFrame:
    return _pivot(kv, {"request": ("cpu_request", ""), "limit": ("cpu_limit", "")}).drop("mode")


def cpu_cfs(kv: DataFrame) -> DataFrame:
    wanted = {"p1": ("cpu.cfs_period_us", ""), "q1": ("cpu.cfs_quota_us", ""), "p2": ("cpu.max", "2"), "q2": ("cpu.max", "1")}
    quota = _by_mode(F.col("q1"), F.col("q2"))
    return _pivot(kv, wanted).select(*SNAP, _by_mode(F.col("p1"), F.col("p2")).alias("period_us"), F.greatest(quota, F.lit(0).cast("bigint")).alias("quota_us"))


def cpu_acct(kv: DataFrame) -> DataFrame:
    p = _pivot(kv, {"u1": ("cpuacct.usage", ""), "u2": ("cpu.stat", "usage_usec")})
    return p.select(*SNAP, _by_mode(F.col("u1"), F.col("u2") * 1000).alias("usage"), (F.unix_micros("snapshot_ts") / 1e6).alias("usage_ts"))


def cpu_stat(kv: DataFrame) -> DataFrame:
    names = ("nr_periods", "nr_throttled", "throttled_time")
    p = _pivot(kv, {n: ("cpu.stat", n) for n in names})
    return p.select(*SNAP, *names, (F.unix_micros("snapshot_ts") / 1e6).alias("snap_ts"))


def network(interfaces: DataFrame) -> DataFrame:
    return interfaces.select(*SNAP, "interface", "tx_bytes", "tx_packets", "rx_bytes", "rx_packets")


def _mounted(mounts: DataFrame) -> DataFrame:
    return mounts.where(F.col("mount_point").isin(*MOUNTS) | F.col("mount_point").like(MOUNT_PREFIX))


_DEV = [*SNAP, "major_number", "minor_number"]


def data_disk(mounts: DataFrame, filesystems: DataFrame) -> DataFrame:
    """Space on data mounts; device numbers are the join key, the mount point tells file systems apart."""
    fs = filesystems.select(*_DEV, "mount_point", "total_bytes", "available_bytes", "total_file_nodes", "free_file_nodes")
    return _mounted(mounts).join(fs, [*_DEV, "mount_point"]).select(
        *SNAP, "mount_point", "fs_type", "total_bytes", "available_bytes", "total_file_nodes", "free_file_nodes"
    )


def disk_activity(mounts: DataFrame, diskstats: DataFrame) -> DataFrame:
    d = diskstats.select(*_DEV, "sectors_read", "sectors_written")
    return _mounted(mounts).join(d, _DEV).select(*SNAP, "mount_point", "sectors_read", "sectors_written")
