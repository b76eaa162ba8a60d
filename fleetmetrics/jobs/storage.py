"""Sizes, table counters, bloat and sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as X
from .server import SNAP


def database_size(databases: DataFrame) -> DataFrame:
    return databases.where("not datistemplate").select(*SNAP, F.col("datname").alias("dbname"), F.col("size_bytes").alias("bytes"))


def table_size(relations: DataFrame, namespaces: DataFrame) -> DataFrame:
    """Tables, materialised views and foreign tables outside other sessions' temporary schemas."""
    own = namespaces.where("not is_other_temp").select(*SNAP, "dbname", F.col("oid").alias("relnamespace"), F.col("nspname").alias("schemaname"))
    rel = relations.where(F.col("relkind").isin("r", "m", "f"))
    return rel.join(own, [*SNAP, "dbname", "relnamespace"]).select(*SNAP, "dbname", "schemaname", "relname", "size_bytes")


def published_table_size(relations: DataFrame, namespaces: DataFrame) -> DataFrame:
    """Table sizes under the name that panels read."""
    return table_size(relations, namespaces).withColumnRenamed("size_bytes", "bytes")


# fixed values: counters of a table
TABLE_COUNTERS = (
    "seq_scan", "seq_tup_read", "idx_scan", "idx_tup_fetch", "n_tup_ins", "n_tup_upd", "n_tup_del", "n_tup_hot_upd",
    "n_tup_newpage_upd", "n_live_tup", "n_dead_tup", "vacuum_count", "autovacuum_count", "analyze_count", "autoanalyze_count",
)


def user_tables(tables: DataFrame) -> DataFrame:
    """Access and maintenance counters per table; a counter the server does not have stays NULL."""
    have = set(tables.columns)
    cols = [F.col(c) if c in have else F.lit(None).cast("bigint").alias(c) for c in TABLE_COUNTERS]
    return tables.select(*SNAP, "dbname", "schemaname", "relname", *cols)


def bloat(bloat_stats: DataFrame, block: int = 8192) -> DataFrame:
    waste = X.bloat_bytes(F.col("dead_tuple_size_bytes"), F.col("free_space_bytes"), F.col("relpages"), F.col("fillfactor"), block)
    return bloat_stats.select(*SNAP, "dbname", "schemaname", "objectname", "size_bytes", waste.alias("total_wasted_space_bytes"))


def _sequence_use(sequences: DataFrame) -> DataFrame:
    lo, hi, inc, last = (F.col(c) for c in ("min_value", "max_value", "increment_by", "last_value"))
    return sequences.withColumns({"slots": X.sequence_slots(lo, hi, inc), "used": X.sequence_used(lo, last, inc)}).withColumn(
        "percent", X.percent_used(F.col("used"), F.col("slots"))
    )


def sequence_exhaustion(sequences: DataFrame, percent: int = 75, inclusive: bool = False) -> DataFrame:
    """Number of sequences that have used more than ``percent`` of their values."""
    p = F.col("percent")
    return _sequence_use(sequences).groupBy(*SNAP).agg(F.count_if(p >= percent if inclusive else p > percent).alias("count"))


def sequence_tables(owned: DataFrame, defaults: DataFrame) -> DataFrame:
    """Tables that use a sequence: recorded dependencies and ``nextval`` column defaults, each once."""
    keys = [*SNAP, "sequence_name", "table_name"]
    named = defaults.withColumn("sequence_name", X.sequence_of_default(F.col("default_expr"))).where(F.col("sequence_name").isNotNull())
    return owned.select(*keys).union(named.select(*keys)).distinct()


def sequence_status(sequences: DataFrame, used_by: DataFrame) -> DataFrame:
    """Detail for every sequence with the tables that use it (a handful for any one sequence)."""
    s = _sequence_use(sequences.withColumn("sequence_name", X.qualified(F.col("schemaname"), F.col("sequencename"))))
    users = used_by.groupBy(*SNAP, "sequence_name").agg(F.array_join(F.sort_array(F.collect_set("table_name")), ", ").alias("table_usage"))
    left = F.when(F.col("slots") < F.col("used"), F.lit(0)).otherwise(F.col("slots") - F.col("used"))
    return s.join(users, [*SNAP, "sequence_name"], "left").select(
        *SNAP, "sequence_name", F.coalesce("last_value", "min_value").alias("last_value"), "slots", "used", "percent", "cycle",
        left.cast("decimal(22,0)").alias("numleft"), "table_usage",
    )
