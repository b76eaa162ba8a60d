"""A dictionary of series: label sets kept once, looked up by an inverted list of labels.

A series is (metric, label text). Its id is a 64-bit hash, and a 32-bit check of the same text goes with
it, so that both together tell as many series apart as any fleet has. Samples carry the two numbers and
are joined to series by them; label sets, matchers and grouping keys are worked on once for each series,
however many samples it has.

The inverted list has one row for each label of a series. A matcher is tried on distinct values, not on
series: one that refuses the empty text needs a row that it accepts, one that accepts the empty text
(and with it every series without that label) must find no row that it refuses.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import LABEL_KEY, label_key
from ..sources.literal import values
from .selectors import anchored

#: The columns that identify a series in samples and in the dictionary.
ID = ["series_id", "series_check"]
#: Literal relations up to this many rows are broadcast; their length is known.
SMALL = 10_000
_USE = "rule_id int, kind string, role string, metric string, m_name array<string>, m_value array<string>, m_op array<string>, by array<string>"


def with_ids(samples: DataFrame) -> DataFrame:
    """Samples as (metric, series_id, series_check, ts, value): the label map stays behind."""
    text = label_key(samples)
    return samples.select("metric", F.xxhash64("metric", text).alias("series_id"), F.hash(text, F.col("metric")).alias("series_check"), "ts", "value")


def entries(labels: Column) -> Column:
    """A label map as sorted pairs without empty values, which can be compared and grouped by."""
    return F.array_sort(F.map_entries(F.map_filter(labels, lambda k, v: v.isNotNull() & (v != ""))))


def dictionary(samples: DataFrame) -> DataFrame:
    """(series_id, series_check, metric, label_key, labels) of every series; empty labels do not count."""
    text = label_key(samples).alias("label_key")
    if LABEL_KEY in samples.columns:
        seen = samples.select("metric", text).distinct().withColumn("labels", F.from_json("label_key", "map<string,string>"))
    else:
        seen = samples.select("metric", text, entries(F.col("labels")).alias("labels")).distinct().withColumn("labels", F.map_from_entries("labels"))
    ids = [F.xxhash64("metric", "label_key").alias("series_id"), F.hash("label_key", "metric").alias("series_check")]
    return seen.select(*ids, "metric", "label_key", "labels")


def write_series(samples: DataFrame, path: str, known: DataFrame | None = None) -> None:
    """Append the series of ``samples`` that are not in ``known`` to the dictionary stored at ``path``."""
    new = dictionary(samples)
    if known is not None:
        new = new.join(known.select(*ID), ID, "left_anti")
    new.write.mode("append").partitionBy("metric").parquet(path)


def inverted(series: DataFrame) -> DataFrame:
    """(metric, name, value, series_id, series_check): the inverted list of labels."""
    return series.select("metric", F.explode("labels").alias("name", "value"), *ID)


def rules_of(spark, uses: Iterable[tuple]) -> tuple[DataFrame, bool]:
    """Uses of metrics by rules, ``(rule, kind, role, metric, matchers, by)``, as a literal relation, and
    whether any has a matcher."""
    rows = [(i, kind, role, metric, [n for n, _, _ in ms], [anchored(v) if op in ("=~", "!~") else v for _, op, v in ms], [op for _, op, _ in ms], list(by)) for i, kind, role, metric, ms, by in uses]
    out = values(spark, rows, _USE)
    return (F.broadcast(out) if len(rows) <= SMALL else out), any(r[4] for r in rows)


def _holds(op: Column, pattern: Column, text: Column) -> Column:
    return F.when(op == "=", text == pattern).when(op == "!=", text != pattern).when(op == "=~", F.regexp_like(text, pattern)).otherwise(~F.regexp_like(text, pattern))


def matching(series: DataFrame, uses: DataFrame, matchers: bool = True) -> DataFrame:
    """Every use with each series that it selects: the columns of ``uses``, ids, label text and labels.

    Each distinct (name, value) meets a matcher once. A hit counts +1 for a matcher that refuses the
    empty text, a miss -1 for one that accepts it; a series is selected if the sum over its labels and
    the matchers that accept the empty text is the number of matchers.
    """
    both = series.join(uses, "metric")
    if not matchers:
        return both
    each = uses.where(F.size("m_name") > 0).select("rule_id", "role", "metric", F.posexplode(F.arrays_zip("m_name", "m_value", "m_op")).alias("i", "m"))
    each = each.select("rule_id", "role", "metric", F.col("m.m_name").alias("name"), F.col("m.m_value").alias("pattern"), F.col("m.m_op").alias("op"))
    each = F.broadcast(each.withColumn("empty", _holds(F.col("op"), F.col("pattern"), F.lit(""))))
    rows = inverted(series)
    tried = rows.select("metric", "name", "value").distinct().join(each, ["metric", "name"])
    hit = _holds(F.col("op"), F.col("pattern"), F.col("value"))
    score = F.when(hit & ~F.col("empty"), 1).when(~hit & F.col("empty"), -1).otherwise(0)
    tried = tried.select("rule_id", "role", "metric", "name", "value", score.alias("score")).where("score <> 0")
    sums = rows.join(tried, ["metric", "name", "value"]).groupBy("rule_id", "role", *ID).agg(F.sum("score").alias("score"))
    free = F.size(F.filter(F.arrays_zip("m_name", "m_value", "m_op"), lambda m: _holds(m["m_op"], m["m_value"], F.lit(""))))
    out = both.join(sums, ["rule_id", "role", *ID], "left")
    return out.where(F.coalesce("score", F.lit(0)) + free == F.size("m_name")).drop("score")


def lookup(series: DataFrame, metric: str | None = None, matchers: Sequence[tuple[str, str, str]] = ()) -> DataFrame:
    """The series that a selector means: ``(label, op, value)`` matchers, tried on distinct values."""
    if metric is not None:
        series = series.where(F.col("metric") == metric)
    rows = inverted(series)
    for name, op, value in matchers:
        pattern = F.lit(anchored(value) if op in ("=~", "!~") else value)
        hit = _holds(F.lit(op), pattern, F.col("value"))
        empty = _holds(F.lit(op), pattern, F.lit(""))
        own = rows.where(F.col("name") == name)
        good = own.join(own.select("value").distinct().where(hit), "value").select(*ID)
        bad = own.join(own.select("value").distinct().where(~hit), "value").select(*ID)
        # one of the two joins is empty by a constant condition, which the optimizer folds
        series = series.where(empty).join(bad, ID, "left_anti").unionByName(series.where(~empty).join(good, ID, "left_semi"))
    return series


def of_series(samples: DataFrame, series: DataFrame) -> DataFrame:
    """Samples of the given series; both sides have ids. A semi join, so a small list of series prunes
    the samples by a runtime filter or a broadcast, as the optimizer sees fit."""
    return samples.join(series.select(*ID), ID, "left_semi")
