"""Parquet tables and the sample views derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.neighbours import running_total
from ..session import prepare


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; zone-less timestamps become UTC instants."""
    return _zoned(prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet"))


def table_stream(spark: SparkSession, sf_dir: str, name: str, files_per_batch: int | None = None) -> DataFrame:
    """The same table as a file stream (schema taken from the files' footer, which fails if there is none).

    A table is one file or a folder of part files; the stream of a single file watches its folder for
    that name only.
    """
    prepare(spark)
    path = f"{sf_dir}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory():
        return _zoned(reader.parquet(path))
    return _zoned(reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir))


def _zoned(df: DataFrame) -> DataFrame:
    return df.select(
        *[F.col(f.name).cast("timestamp").alias(f.name) if isinstance(f.dataType, T.TimestampNTZType) else F.col(f.name) for f in df.schema]
    )


def event_samples(events: DataFrame) -> DataFrame:
    """Events as samples: the type is the metric, four hosts, one series per pair."""
    host = F.concat(F.lit("h"), F.pmod("user_id", F.lit(4)).cast("string"))
    return events.select(
        F.col("event_type").alias("metric"), host.alias("host"),
        F.concat_ws("|", F.col("event_type"), host).alias("series_key"), "ts", "event_id", "value",
    )


def event_counters(samples: DataFrame) -> DataFrame:
    """Running totals per series that restart every day, as a scraped process would keep them."""
    total = running_total(samples, ["series_key"], "ts", "value", ["event_id"])
    return total.withColumn("value", F.round("value", 2))  # the parts have two decimals


def as_labelled(samples: DataFrame) -> DataFrame:
    """Move the host column of the sample view into a label map."""
    return samples.select("metric", F.create_map(F.lit("host"), F.col("host")).alias("labels"), "ts", "value")
