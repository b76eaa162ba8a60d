"""Samples, labels and series identity.

A sample is ``(metric, labels, ts, value)``.  Labels live in a map column, and hot labels may be
promoted to columns of their own: a predicate on a promoted column reaches the Parquet scan, a
predicate on a map entry does not.  A label that is absent reads as the empty string.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SAMPLE_SCHEMA = T.StructType(
    [
        T.StructField("metric", T.StringType()),
        T.StructField("labels", T.MapType(T.StringType(), T.StringType())),
        T.StructField("ts", T.TimestampType()),
        T.StructField("value", T.DoubleType()),
    ]
)


def label(df: DataFrame, name: str) -> Column:
    """A label of ``df``: promoted column first, then the map, absent -> ''."""
    if name in df.columns:
        return F.coalesce(F.col(name).cast("string"), F.lit(""))
    if "labels" in df.columns:
        return F.coalesce(F.col("labels")[name], F.lit(""))
    return F.lit("")


def series_key(labels: Column, drop: Sequence[str] = ()) -> Column:
    """Order-independent text identity of a label map; empty labels do not count.

    Both sides of a vector match use this text, so maps are never joined or grouped directly.
    """
    gone = F.array(*[F.lit(d) for d in drop]) if drop else None

    def keep(k: Column, v: Column) -> Column:
        real = (v.isNotNull()) & (v != "")
        return real if gone is None else real & ~F.array_contains(gone, k)

    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(F.map_filter(labels, keep)))))


LABEL_KEY = "label_key"


def label_key(df: DataFrame) -> Column:
    """Text identity of the labels: the stored column where there is one, else built from the map.

    Whatever changes the map has to drop the stored column, as the relabelling functions do.
    """
    return F.col(LABEL_KEY) if LABEL_KEY in df.columns else series_key(F.col("labels"))


def with_series_key(df: DataFrame, include_metric: bool = True) -> DataFrame:
    key = series_key(F.col("labels"))
    if include_metric:
        key = F.concat(F.col("metric"), key)
    return df.withColumn("series_key", key)


def promote(df: DataFrame, *names: str) -> DataFrame:
    """Copy labels into plain columns, to be written next to the map and filtered on."""
    return df.withColumns({n: label(df, n) for n in names if n not in df.columns})


def to_samples(
    df: DataFrame, prefix: str, values: Sequence[str], key_labels: Sequence[str] = (), ts: str = "snapshot_ts",
    target_labels: Sequence[str] = ("host",),
) -> DataFrame:
    """Melt a wide snapshot: every value column becomes the metric ``<prefix>_<column>``.

    One narrow pass (no shuffle).  NULL measures yield no sample.
    """
    names = [n for n in (*target_labels, *key_labels) if n in df.columns]
    pairs = [x for n in names for x in (F.lit(n), F.coalesce(F.col(n).cast("string"), F.lit("")))]
    labels = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    wide = df.select(
        labels.alias("labels"), F.col(ts).alias("ts"),
        *[F.col(v).cast("double").alias(f"{prefix}_{v}") for v in values],
    )
    # a map cannot be an unpivot id in every release, so the id pair travels as one struct array
    measures = F.array(*[F.struct(F.lit(f"{prefix}_{v}").alias("metric"), F.col(f"{prefix}_{v}").alias("value")) for v in values])
    return (
        wide.select("labels", "ts", F.explode(measures).alias("m"))
        .select(F.col("m.metric").alias("metric"), "labels", "ts", F.col("m.value").alias("value"))
        .where(F.col("value").isNotNull())
    )


def normalize_columns(df: DataFrame, aliases: dict[str, Sequence[str]]) -> DataFrame:
    """Version-dependent schemas: give every canonical column the first of its names that has a value.

    Columns a version does not have become NULL, so one job serves all versions.
    """
    out = {}
    for canonical, names in aliases.items():
        present = [F.col(n) for n in (canonical, *names) if n in df.columns]
        out[canonical] = F.coalesce(*present) if present else F.lit(None).cast("double")
    return df.withColumns(out)
