"""Statement statistics: totals, top-N lists and reset detection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import clean_query
from ..model import normalize_columns
from ..operators.aggregate import top_n
from ..timeutil import ceil_div, micros
from .server import SNAP

TOP = 20
ID = ["role", "dbname", "queryid", "query"]
# names before and after the split of planning and execution time
TIME_ALIASES = {"total_exec_time": ("total_time",), "mean_exec_time": ("mean_time",), "max_exec_time": ("max_time",)}


def _prepared(statements: DataFrame) -> DataFrame:
    """Current column names, and texts cut to their label before anything is shuffled."""
    return normalize_columns(statements, TIME_ALIASES).withColumn("query", clean_query(F.col("query")))


def totals(statements: DataFrame) -> DataFrame:
    return normalize_columns(statements, TIME_ALIASES).groupBy(*SNAP, "role", "dbname").agg(
        F.sum("calls").alias("calls_count"), F.sum("total_exec_time").alias("exec_time_ms"),
        F.avg("mean_exec_time").alias("mean_exec_time_ms"), F.sum("rows").alias("row_count"),
    )


def by_statement(statements: DataFrame) -> DataFrame:
    """Total time per statement, where a snapshot has several rows of one (one for each node or plan)."""
    return _prepared(statements).groupBy(*SNAP, *ID).agg(F.sum("total_exec_time").alias("total_exec_time"))


def _top(df: DataFrame, order: str, n: int) -> DataFrame:
    return top_n(df, order, n, ID, SNAP)


def top_total(statements: DataFrame, n: int = TOP) -> DataFrame:
    return _top(_prepared(statements).select(*SNAP, *ID, F.col("total_exec_time").alias("exec_time_ms")), "exec_time_ms", n)


def top_mean(statements: DataFrame, n: int = TOP) -> DataFrame:
    g = _prepared(statements).groupBy(*SNAP, *ID).agg(F.max("mean_exec_time").alias("exec_time_ms"))
    return _top(g, "exec_time_ms", n)


def top_max(statements: DataFrame, n: int = TOP) -> DataFrame:
    return _top(_prepared(statements).select(*SNAP, *ID, F.col("max_exec_time").alias("exec_time_ms")), "exec_time_ms", n)


def top_wal(statements: DataFrame, n: int = TOP) -> DataFrame:
    s = _prepared(statements).select(*SNAP, *ID, F.col("wal_records").alias("records"), F.col("wal_fpi").alias("fpi"), F.col("wal_bytes").alias("bytes"))
    return _top(s, "bytes", n)


def reset_times(counters: DataFrame, keys: Sequence[str], chunk="5m", value: str = "value", ts: str = "ts") -> DataFrame:
    """Newest reset of each counter series as epoch seconds, seen as a drop of its value; 0 if none.

    Neighbours are compared per (series, chunk of time) and then between the chunk ends, so no
    task sorts a whole series.
    """
    base = counters.where(F.col(value).isNotNull()).select(*keys, F.unix_micros(ts).alias("_u"), F.col(value).cast("double").alias("_v"))
    size = micros(chunk)
    inside = Window.partitionBy("_b", *keys).orderBy("_u")
    marked = base.withColumn("_b", ceil_div(F.col("_u"), size)).withColumn("_p", F.lag("_v").over(inside))
    ends = marked.groupBy(*keys, "_b").agg(
        F.max(F.when(F.col("_v") < F.col("_p"), F.col("_u"))).alias("drop_u"), F.min("_u").alias("first_u"),
        F.min_by("_v", "_u").alias("first_v"), F.max_by("_v", "_u").alias("last_v"),
    )
    across = F.lag("last_v").over(Window.partitionBy(*keys).orderBy("_b"))
    edge = ends.withColumn("_q", across).withColumn("edge_u", F.when(F.col("first_v") < F.col("_q"), F.col("first_u")))
    return edge.groupBy(*keys).agg((F.coalesce(F.max(F.greatest("drop_u", "edge_u")), F.lit(0)) / 1e6).alias("time"))


def reset_snapshot(counters: DataFrame, keys: Sequence[str] = ("host", "series_key")) -> DataFrame:
    """Newest reset seen on each host up to the newest snapshot, as one row per host."""
    t = reset_times(counters, keys)
    newest = counters.groupBy("host").agg(F.max("ts").alias("snapshot_ts"))
    return t.groupBy("host").agg(F.max("time").alias("time")).join(newest, "host")
