"""Refresh bookkeeping of metric views and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.selectors import overdue
from .server import SNAP


def refresh_failures(views: DataFrame) -> DataFrame:
    """Active views or tables whose last refresh is older than their interval, or missing."""
    late = F.col("active") & overdue(F.col("last_run"), F.col("run_interval"), F.col("snapshot_ts"))
    return views.groupBy(*SNAP, "dbname").agg(F.count_if(late).alias("count"))


def longest_refresh(views: DataFrame) -> DataFrame:
    return views.groupBy(*SNAP, "dbname").agg(F.max(F.col("last_run_seconds").cast("double")).alias("seconds"))
