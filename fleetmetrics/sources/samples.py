"""Stored samples: partitioned layout, reading, retention, target labels, relabelling."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import LABEL_KEY, SAMPLE_SCHEMA, label, label_key
from ..operators.selectors import anchored

STORED_SCHEMA = T.StructType([*SAMPLE_SCHEMA.fields, T.StructField(LABEL_KEY, T.StringType()), T.StructField("date", T.DateType())])


def write_samples(samples: DataFrame, path: str, promoted: Sequence[str] = (), mode: str = "append", run: str | None = None) -> None:
    """Append samples as Parquet partitioned by (date, metric), with hot labels promoted to columns.

    A job that may be repeated names its ``run``: it becomes a third partition column, and the run
    replaces what it has written before instead of adding it a second time.

    The text identity of the labels is stored as well, so that readers need not build it for
    every sample again.
    AQE rebalances the partitions before the write, so a metric with very many rows becomes
    several files and rare metrics do not become a file per task.
    """
    out = samples.withColumns({n: label(samples, n) for n in promoted} | {"date": F.to_date("ts"), LABEL_KEY: label_key(samples)})
    if run is not None:
        out = out.withColumn("run", F.lit(run))
    by = ["date", "metric", *(["run"] if run is not None else [])]
    writer = out.hint("rebalance", "date", "metric").sortWithinPartitions("date", "metric", "ts").write.partitionBy(*by)
    if run is not None:
        writer.mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    else:
        writer.mode(mode).parquet(path)


def read_samples(spark: SparkSession, path: str, start=None, end=None, metrics: Sequence[str] | None = None, schema: T.StructType | None = None) -> DataFrame:
    """Stored samples of ``(start, end]``; both the partition columns and ``ts`` are filtered."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    df = reader.parquet(path)
    if start is not None:
        s = F.lit(start).cast("timestamp")
        df = df.where((F.col("date") >= F.to_date(s)) & (F.col("ts") > s))
    if end is not None:
        e = F.lit(end).cast("timestamp")
        df = df.where((F.col("date") <= F.to_date(e)) & (F.col("ts") <= e))
    if metrics is not None:
        df = df.where(F.col("metric").isin(list(metrics)))
    return df


def read_samples_stream(spark: SparkSession, path: str, schema: T.StructType = STORED_SCHEMA, files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def retain(samples: DataFrame, days: int = 7, as_of: Column | None = None, ts: str = "ts") -> DataFrame:
    """The newest ``days`` of samples, counted back from ``as_of`` (default: the newest sample).

    On the stored layout the newest sample is sought in the newest day only, and older days are
    pruned.
    """
    stored = "date" in samples.columns
    if as_of is None:
        newest = samples.where(F.col("date") == samples.agg(F.max("date")).scalar()) if stored else samples
        as_of = newest.agg(F.max(ts)).scalar()
    since = as_of - F.make_interval(days=F.lit(days))
    kept = samples.where(F.col(ts) >= since)
    return kept.where(F.col("date") >= F.to_date(since)) if stored else kept


def add_target_labels(samples: DataFrame, targets: DataFrame, on: Sequence[str] = ("instance",), into_map: bool = True) -> DataFrame:
    """Attach the static labels of each scrape target.

    The target list is joined by key; whether it is broadcast is left to the optimizer's size check.
    """
    extra = [c for c in targets.columns if c not in on]
    joined = samples.join(targets, list(on), "left")
    if not into_map:
        return joined
    added = F.map_filter(
        F.map_from_arrays(F.array(*[F.lit(c) for c in extra]), F.array(*[F.col(c).cast("string") for c in extra])),
        lambda k, v: v.isNotNull(),
    )
    own = F.map_filter(F.col("labels"), lambda k, v: ~k.isin(extra))
    return joined.withColumn("labels", F.map_concat(own, added)).drop(*extra, LABEL_KEY)


# --- relabelling ------------------------------------------------------------------------------


def drop_metrics(samples: DataFrame, pattern: str) -> DataFrame:
    """Do not keep metrics whose whole name matches."""
    return samples.where(~F.col("metric").rlike(anchored(pattern)))


def keep_where(samples: DataFrame, name: str, pattern: str) -> DataFrame:
    """Keep only elements whose label matches as a whole."""
    return samples.where(label(samples, name).rlike(anchored(pattern)))


def replace_label(samples: DataFrame, source: Sequence[str], pattern: str, target: str, replacement: str = "$1", separator: str = ";") -> DataFrame:
    """Set ``target`` when the joined source labels match as a whole; an empty result clears it."""
    joined = F.concat_ws(separator, *[F.col("metric") if s in ("metric", "__name__") else label(samples, s) for s in source])
    new = F.regexp_replace(joined, anchored(pattern), replacement) if "$" in replacement else F.lit(replacement)
    hit = joined.rlike(anchored(pattern))
    if target in samples.columns or "labels" not in samples.columns:
        old = label(samples, target)
        return samples.withColumn(target, F.when(hit, new).otherwise(old))
    rest = F.map_filter(F.col("labels"), lambda k, v: k != target)
    changed = F.when(new == "", rest).otherwise(F.map_concat(rest, F.create_map(F.lit(target), new)))
    return samples.withColumn("labels", F.when(hit, changed).otherwise(F.col("labels"))).drop(LABEL_KEY)


def join_labels(samples: DataFrame, source: Sequence[str], target: str, separator: str = ":") -> DataFrame:
    """Concatenate labels into a new one."""
    text = F.concat_ws(separator, *[F.col("metric") if s == "metric" else label(samples, s) for s in source])
    return _set_label(samples, target, text)


def copy_labels(samples: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Copy discovered labels under their stored names (source -> target)."""
    for source, target in mapping.items():
        samples = _set_label(samples, target, label(samples, source))
    return samples


def _set_label(samples: DataFrame, target: str, text: Column) -> DataFrame:
    if "labels" not in samples.columns:
        return samples.withColumn(target, text)
    rest = F.map_filter(F.col("labels"), lambda k, v: k != target)
    return samples.withColumn("labels", F.map_concat(rest, F.create_map(F.lit(target), text))).drop(LABEL_KEY)
