"""Connection pooler snapshots, seen from the database side and directly."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import pct_of
from .server import SNAP

TARGET = [*SNAP, "pgbouncer_target_host"]
# fixed values: list entries that are reported
LIST_ITEMS = ("databases", "pools", "free_clients", "free_servers", "used_servers")
POOL_COUNTS = {"cl_active": "client_active", "cl_waiting": "client_waiting", "sv_active": "server_active", "sv_idle": "server_idle", "sv_used": "server_used"}


def _pool():
    return F.concat_ws(".", F.col("database"), F.col("user")).alias("conn_pool")


def databases(dbs: DataFrame) -> DataFrame:
    used = pct_of(F.col("current_connections"), F.col("max_connections"), F.col("pool_size"))
    return dbs.select(*TARGET, F.col("name").alias("pool_db"), used.alias("db_conn_perc_used"), "paused", "disabled")


def pools(pool_rows: DataFrame) -> DataFrame:
    return pool_rows.groupBy(*TARGET, _pool()).agg(*[F.sum(c).alias(n) for c, n in POOL_COUNTS.items()])


def clients(client_rows: DataFrame) -> DataFrame:
    return client_rows.groupBy(*TARGET, _pool(), F.col("state").alias("client_state")).agg(F.count("*").alias("client_state_count"))


def servers(server_rows: DataFrame) -> DataFrame:
    return server_rows.groupBy(*TARGET, _pool(), F.col("state").alias("server_state")).agg(F.count("*").alias("server_state_count"))


def lists(list_rows: DataFrame) -> DataFrame:
    kept = list_rows.where(F.col("list").isin(*LIST_ITEMS))
    return kept.select(*TARGET, F.col("list").alias("item"), F.col("items").alias("item_count"))


# rows as shown by the pooler itself are melted without further work: block -> (values, labels)
DIRECT = {
    "clients": (["wait"], ["database", "user", "state", "application_name", "link"]),
    "servers": (["close_needed"], ["database", "user", "state", "application_name", "link"]),
    "databases": (
        ["pool_size", "min_pool_size", "reserve_pool", "max_connections", "current_connections", "paused", "disabled"],
        ["name", "host", "port", "database", "force_user", "pool_mode"],
    ),
    "lists": (["items"], ["list"]),
    "pools": (list(POOL_COUNTS), ["database", "user"]),
}


def direct(rows: DataFrame, block: str) -> DataFrame:
    values, labels = DIRECT[block]
    keep = [c for c in dict.fromkeys([*SNAP, "instance", *labels]) if c in rows.columns]
    return rows.select(*keep, *values)
