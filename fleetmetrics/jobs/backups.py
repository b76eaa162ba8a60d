"""Backup reports: newest backup of each type, oldest full backup, time since completion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import version_key
from ..operators.aggregate import latest
from .server import SNAP

REPO = [*SNAP, "config_file", "stanza", "repo"]
# each kind of backup also counts for the kinds that need it
KINDS = {"full": ("full",), "diff": ("full", "diff"), "incr": ("full", "diff", "incr")}


def last_info(backups: DataFrame) -> DataFrame:
    """Newest backup per repository and type, by start and stop time compared as numbers."""
    b = backups.select(
        *REPO, "backup_type", "start", "stop", version_key(F.col("version")).alias("backrest_repo_version"),
        F.col("delta").alias("repo_backup_size_bytes"), F.col("size").alias("repo_total_size_bytes"),
        (F.col("stop") - F.col("start")).alias("backup_runtime_seconds"), F.when(F.col("error") == "true", 1).otherwise(0).alias("backup_error"),
    )
    values = ["backrest_repo_version", "repo_backup_size_bytes", "repo_total_size_bytes", "backup_runtime_seconds", "backup_error"]
    return latest(b, [*REPO, "backup_type"], ["start", "stop"], values)


def oldest_full(backups: DataFrame) -> DataFrame:
    full = backups.where("backup_type = 'full'")
    return full.groupBy(*REPO).agg(F.min("stop").alias("time_seconds"))


def time_since(backups: DataFrame) -> DataFrame:
    """Seconds since the last completed full, diff and incr backup: one scan, three maxima."""
    now = F.unix_micros("snapshot_ts") / 1e6
    aggs = [F.max(F.when(F.col("backup_type").isin(*types), F.col("stop"))).alias(kind) for kind, types in KINDS.items()]
    g = backups.groupBy(*REPO).agg(*aggs)
    return g.select(*REPO, *[(now - F.col(k)).alias(f"{k}_time_since_completion_seconds") for k in KINDS])


def time_since_kind(backups: DataFrame, kind: str) -> DataFrame:
    col = f"{kind}_time_since_completion_seconds"
    return time_since(backups).where(F.col(col).isNotNull()).select(*REPO, F.col(col).alias("time_since_completion_seconds"))
