"""Command output of the form ``<config>|<json>``, one line for each repository configuration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BACKUP_SCHEMA = (
    "array<struct<name:string,backup:array<struct<type:string,error:string,"
    "backrest:struct<version:string>,database:struct<`repo-key`:string>,"
    "info:struct<repository:struct<delta:bigint,size:bigint>>,timestamp:struct<start:bigint,stop:bigint>>>>>"
)


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).withColumnRenamed("value", "raw")


def split_reports(lines: DataFrame, system_id: str | None = None, raw: str = "raw", keep: tuple[str, ...] = ()) -> DataFrame:
    """Cut at the first bar; keep only reports that mention the system identifier.

    Slashes of the configuration path become underscores, as the label expects.
    """
    c = F.col(raw)
    if system_id is not None:
        lines = lines.where(c.contains(system_id))
    at = F.instr(c, "|")
    return lines.where(at > 0).select(
        *keep, F.translate(F.substring(c, F.lit(1), at - 1), "/", "_").alias("config_file"),
        F.substring(c, at + 1, F.length(c)).alias("data"),
    )


def backups(reports: DataFrame, keep: tuple[str, ...] = ("host", "snapshot_ts")) -> DataFrame:
    """One row per backup: parsed once, exploded twice (stanza, backup).

    Every job over backup reports starts from this frame, so the JSON is parsed in one scan.
    """
    # the outer form keeps the optimizer from adding a filter that parses the text again
    stanza = reports.select(*keep, "config_file", F.inline_outer(F.from_json("data", BACKUP_SCHEMA))).where(F.col("name").isNotNull())
    b = stanza.select(*keep, "config_file", F.col("name").alias("stanza"), F.explode("backup").alias("b"))
    return b.select(
        *keep, "config_file", "stanza",
        F.col("b.database.repo-key").alias("repo"), F.col("b.type").alias("backup_type"),
        F.col("b.backrest.version").alias("version"), F.col("b.info.repository.delta").alias("delta"),
        F.col("b.info.repository.size").alias("size"), F.col("b.timestamp.start").alias("start"),
        F.col("b.timestamp.stop").alias("stop"), F.col("b.error").alias("error"),
    )


def json_number(text: Column, path: str) -> Column:
    return F.get_json_object(text, path).try_cast("bigint")
