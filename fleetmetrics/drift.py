"""Configuration drift: checksums of settings and access rules, sticky until accepted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .functions.scalar import joined_array, or_null_text

SNAP = ["host", "snapshot_ts"]


def _ordered_text(df: DataFrame, order: list[str], entry: Column) -> DataFrame:
    """One text per host snapshot, entries in order.

    The rows of one snapshot of one server are bounded by the server's own catalogue (hundreds).
    """
    pairs = F.sort_array(F.collect_list(F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], entry.alias("e"))))
    return df.groupBy(*SNAP).agg(F.array_join(F.transform(pairs, lambda p: p["e"]), ",").alias("text"))


def settings_hash(settings: DataFrame) -> DataFrame:
    """md5 over ``name||setting`` in name order, NULL settings marked."""
    s = settings.withColumn("setting", or_null_text(F.col("setting")))
    out = _ordered_text(s, ["name", "setting"], F.concat("name", "setting"))
    return out.withColumn("hash", F.md5("text"))


def hba_hash(rules: DataFrame) -> DataFrame:
    """md5 over the access rules in line order, so that a mere reordering shows as well."""
    entry = F.concat(
        or_null_text(F.col("type")), joined_array(F.col("database")), joined_array(F.col("user_name")), or_null_text(F.col("address")),
        or_null_text(F.col("netmask")), or_null_text(F.col("auth_method")), joined_array(F.col("options")),
    )
    return _ordered_text(rules, ["line_number"], entry).withColumn("hash", F.md5("text"))


def drift_status(hashes: DataFrame, accepted: DataFrame | None = None, known: DataFrame | None = None) -> DataFrame:
    """0/1 status for each (host, snapshot) of a hash history.

    The first snapshot of a host is valid.  Every later snapshot whose hash differs from the
    stored one sets the status to 1, and 1 stays until the state is accepted.  ``accepted`` holds
    (host, accepted_at): the first snapshot at or after it starts a new history.  ``known`` holds
    (host, known_hash): such hosts are compared with that hash only, from scratch each time.
    One row per host snapshot is windowed, never the settings themselves.
    """
    h = hashes.select(*SNAP, "hash")
    if accepted is not None:
        marks = accepted.select("host", F.col("accepted_at").alias("snapshot_ts"), F.lit(None).cast("string").alias("hash"), F.lit(1).alias("mark"))
        h = h.withColumn("mark", F.lit(0)).unionByName(marks)
        # a mark sorts before the snapshot of the same instant
        epoch = Window.partitionBy("host").orderBy("snapshot_ts", F.col("mark").desc()).rowsBetween(Window.unboundedPreceding, 0)
        h = h.withColumn("epoch", F.sum("mark").over(epoch)).where("mark = 0").drop("mark")
    else:
        h = h.withColumn("epoch", F.lit(0))
    w = Window.partitionBy("host", "epoch").orderBy("snapshot_ts")
    # a changed hash is stored, so "differs from the stored one" is "differs from the one before"
    h = h.withColumn("changed", F.coalesce((F.col("hash") != F.lag("hash").over(w)).cast("int"), F.lit(0)))
    h = h.withColumn("status", F.max("changed").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    if known is not None:
        h = h.join(known.select("host", "known_hash"), "host", "left")
        differs = (F.col("hash") != F.col("known_hash")).cast("int")
        h = h.withColumn("status", F.coalesce(differs, F.col("status"))).withColumn("changed", F.coalesce(differs, F.col("changed")))
        h = h.drop("known_hash")
    return h


def replica_status(hashes: DataFrame, history: DataFrame, primary_of: DataFrame) -> DataFrame:
    """Status of replicas, which store nothing and read their primary's history.

    ``history`` has (host, created_at, hash, valid) rows of primaries, ``primary_of`` maps host to
    primary.  A replica snapshot is compared with the newest row stored up to then: a different
    hash is drift, an equal one takes the stored status over, no row at all counts as valid.
    """
    mine = hashes.join(primary_of.select("host", "primary"), "host").select(
        "primary", F.col("snapshot_ts").alias("at"), F.lit(1).alias("kind"), "host", "hash", F.lit(None).cast("string").alias("stored"), F.lit(None).cast("int").alias("valid"),
    )
    rows = history.select(
        F.col("host").alias("primary"), F.col("created_at").alias("at"), F.lit(0).alias("kind"), F.lit(None).cast("string").alias("host"),
        F.lit(None).cast("string").alias("hash"), F.col("hash").alias("stored"), F.col("valid").cast("int").alias("valid"),
    )
    w = Window.partitionBy("primary").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    both = mine.unionByName(rows).withColumns({"_s": F.last("stored", ignorenulls=True).over(w), "_v": F.last("valid", ignorenulls=True).over(w)})
    status = F.when(F.col("_s").isNull(), 0).when(F.col("hash") != F.col("_s"), 1).otherwise(F.col("_v"))
    return both.where("kind = 1").select("host", F.col("at").alias("snapshot_ts"), "hash", status.alias("status"))


def history_rows(hashes: DataFrame, status: DataFrame, replicas: DataFrame | None = None) -> DataFrame:
    """Rows to append to the stored history: the first state and every change; replicas store nothing."""
    first = F.row_number().over(Window.partitionBy("host", "epoch").orderBy("snapshot_ts")) == 1
    rows = status.withColumn("first", first).where(F.col("first") | (F.col("changed") == 1))
    if replicas is not None:
        rows = rows.join(replicas.select(*SNAP), SNAP, "left_anti")
    return rows.join(hashes.select(*SNAP, "text"), SNAP).select(
        "host", F.col("snapshot_ts").alias("created_at"), "hash", F.col("text").alias("settings_string"), F.col("status").cast("smallint").alias("valid"),
    )
