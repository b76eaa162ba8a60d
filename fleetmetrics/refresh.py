"""Due lists and incremental refresh of metric tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .operators.selectors import overdue
from .session import drop_folder


def due_list(registry: DataFrame, log: DataFrame, as_of: Column, key: str | Sequence[str] = ("view_schema", "view_name"), scope: str | None = None) -> DataFrame:
    """Active objects to refresh: never run, or last run strictly longer ago than their interval.

    An object is known by its schema and name; one run of it is appended by ``run_log``.

    A negative interval (in seconds) switches an object off; ``scope`` restricts the list to
    objects registered for that scope.
    """
    if scope is not None:
        registry = registry.where(F.col("scope") == scope)
    key = [key] if isinstance(key, str) else list(key)
    last = log.groupBy(*key).agg(F.max("run_at").alias("last_run"))
    span = F.make_dt_interval(secs=F.col("run_seconds").cast("decimal(18,6)"))
    active = registry.where(F.col("active") & (F.col("run_seconds") >= 0))
    return active.join(last, key, "left").where(overdue(F.col("last_run"), span, as_of))


def run_log(done: DataFrame, started: Column, seconds: Column, key: Sequence[str] = ("view_schema", "view_name"), replica: bool = False) -> DataFrame:
    """Log rows of the objects just refreshed: key, start and duration; a replica refreshes nothing."""
    rows = done.select(*key, started.alias("run_at"), seconds.cast("double").alias("run_time_seconds"))
    return rows.where(F.lit(not replica))


def refresh_partitions(
    spark: SparkSession, source: DataFrame, target: str, partition: str, changed: DataFrame, compute: Callable[[DataFrame], DataFrame],
) -> None:
    """Recompute only the changed partitions of a stored result and replace them in place.

    The source is cut to the changed partitions before ``compute``, so the work follows the change. A
    changed partition without rows left is deleted: its folder is the only thing that names it, so
    the few names are taken to the driver.
    """
    names = changed.select(partition).distinct()
    part = source.join(names, partition, "left_semi")
    fresh = compute(part)
    fresh.hint("rebalance", partition).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(target)
    gone = names.join(part.select(partition).distinct(), partition, "left_anti").where(F.col(partition).isNotNull())
    for row in gone.select(F.col(partition).cast("string")).toLocalIterator():
        drop_folder(spark, f"{target}/{partition}={row[0]}")


def merge_refreshed(kept: DataFrame, fresh: DataFrame, changed: DataFrame, partition: str) -> DataFrame:
    """The stored result with the changed partitions taken from ``fresh``."""
    old = kept.join(changed.select(partition).distinct(), partition, "left_anti")
    return old.unionByName(fresh)


def fingerprints(source: DataFrame, partition: str) -> DataFrame:
    """(partition, rows, print_a, print_b): an order-independent fingerprint of every partition.

    Two sums of 64-bit hashes over whole rows: rows in any order and in any files give the same, a row
    more, less or changed gives another; a repeated row counts twice, unlike in an exclusive or. One
    aggregation with partial sums, whatever the sizes of the partitions are.
    """

    def plain(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        return F.to_json(F.array_sort(F.map_entries(c))) if isinstance(f.dataType, T.MapType) else c

    # a null passes through a hash unseen, so which columns are null is hashed as well
    columns = [plain(f) for f in source.schema.fields]
    nulls = F.concat(*[F.when(c.isNull(), "1").otherwise("0") for c in columns])
    wide = "decimal(38,0)"
    return source.groupBy(partition).agg(
        F.count("*").alias("rows"), F.sum(F.xxhash64(nulls, *columns).cast(wide)).alias("print_a"), F.sum(F.xxhash64(*columns, nulls, F.lit("b")).cast(wide)).alias("print_b"),
    )


def detect(prints: DataFrame, manifest: DataFrame, partition: str) -> DataFrame:
    """(partition, status) of partitions that are ``new``, ``changed`` or ``vanished`` since the manifest."""
    old = manifest.select(F.col(partition).alias("_p"), F.struct("rows", "print_a", "print_b").alias("_old"))
    now = prints.select(partition, F.struct("rows", "print_a", "print_b").alias("_now"))
    both = now.join(old, F.col(partition).eqNullSafe(F.col("_p")), "full")
    status = F.when(F.col("_old").isNull(), "new").when(F.col("_now").isNull(), "vanished").when(F.col("_old") != F.col("_now"), "changed")
    return both.select(F.when(F.col("_now").isNull(), F.col("_p")).otherwise(F.col(partition)).alias(partition), status.alias("status")).where("status is not null")


def refresh_detected(spark: SparkSession, source: DataFrame, target: str, partition: str, manifest: str, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Find changed and vanished partitions by their fingerprints, refresh them, and return ``detect``.

    The manifest is a folder of versions; the newest finished one counts, and a new one is written after
    the refresh. A run that dies in between is repeated by the next, which finds the same changes and
    overwrites the same partitions. The source is read once for the fingerprints and, in its changed
    partitions, once for the result.
    """
    version = _newest(spark, manifest)
    path = f"{manifest}/version={0 if version is None else version + 1}"
    pending = f"{manifest}/pending"  # fingerprints of this run, which become the version at its end
    fingerprints(source, partition).write.mode("overwrite").parquet(pending)
    prints = spark.read.parquet(pending)
    old = prints.limit(0) if version is None else spark.read.schema(prints.schema).parquet(f"{manifest}/version={version}")
    found = detect(prints, old, partition)
    refresh_partitions(spark, source, target, partition, found, compute)
    prints.write.mode("overwrite").parquet(path)
    return found


def _newest(spark: SparkSession, manifest: str) -> int | None:
    """The newest version whose writing was finished."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(manifest)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    done = fs.globStatus(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder, "version=*/_SUCCESS"))
    return max((int(x.getPath().getParent().getName().split("=")[1]) for x in done or ()), default=None)
