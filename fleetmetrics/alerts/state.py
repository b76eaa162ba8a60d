"""Pending and firing states, the alert series, and history queries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import render
from ..operators.windows import Grid

_ALERT = ["alertname", "severity", "series_key"]


def alert_states(hits: DataFrame, grid: Grid, keys: Sequence[str] = _ALERT, hold: str = "hold", t: str = "t") -> DataFrame:
    """Add ``active_since`` and ``alertstate`` to the instants at which a condition holds.

    A run of consecutive instants is one activation: pending until it has lasted ``hold`` seconds
    (exactly ``hold`` already fires), any miss starts over.  The windows sort evaluation instants
    of one alert, which the grid bounds; no raw samples are left at this point.
    """
    k = F.unix_micros(t)
    w = Window.partitionBy(*keys).orderBy(t)
    runs = hits.withColumn("_run", k - F.row_number().over(w).cast("bigint") * F.lit(grid.step))
    since = F.min(t).over(Window.partitionBy(*keys, "_run"))
    aged = runs.withColumn("active_since", since).drop("_run")
    lasted = F.unix_micros(t) - F.unix_micros("active_since")
    return aged.withColumn("alertstate", F.when(lasted >= F.col(hold).cast("bigint") * 1000000, "firing").otherwise("pending"))


def transitions(states: DataFrame, grid: Grid, keys: Sequence[str] = _ALERT, t: str = "t") -> DataFrame:
    """Start and end of every firing stretch: ``(keys, active_since, fired_at, resolved_at)``.

    ``resolved_at`` is the first instant after the stretch, NULL when it reaches the end of the grid.
    """
    g = states.where("alertstate = 'firing'").groupBy(*keys, "active_since").agg(F.min(t).alias("fired_at"), F.max(t).alias("_last"), F.max("value").alias("value"))
    nxt = F.timestamp_micros(F.unix_micros("_last") + F.lit(grid.step))
    end = F.timestamp_micros(F.lit(grid.last * grid.step))
    return g.withColumn("resolved_at", F.when(F.col("_last") < end, nxt)).drop("_last")


def alert_series(states: DataFrame) -> DataFrame:
    """The synthetic alert series: value 1 with name, state and severity as labels."""
    extra = F.create_map(F.lit("alertname"), F.col("alertname"), F.lit("alertstate"), F.col("alertstate"), F.lit("severity"), F.col("severity"))
    own = F.map_filter(F.col("labels"), lambda k, v: ~k.isin("alertname", "alertstate", "severity"))
    return states.select(F.lit("ALERTS").alias("metric"), F.map_concat(own, extra).alias("labels"), F.col("t").alias("ts"), F.lit(1.0).alias("value"))


def annotate(states: DataFrame) -> DataFrame:
    """Render each rule's summary text from the labels and the value."""
    labels = F.map_concat(
        F.map_filter(F.col("labels"), lambda k, v: ~k.isin("alertname", "severity")),
        F.create_map(F.lit("alertname"), F.col("alertname"), F.lit("severity"), F.col("severity")),
    )
    return states.withColumn("summary", render(F.col("summary"), labels, F.col("value")))


def firing_now(states: DataFrame, at: Column) -> DataFrame:
    return states.where((F.col("alertstate") == "firing") & (F.col("t") == at))


def history(states: DataFrame, as_of: Column, days: int = 7, state: str | None = "firing") -> DataFrame:
    """States of the last week (or any number of days)."""
    out = states.where((F.col("t") > as_of - F.make_interval(days=F.lit(days))) & (F.col("t") <= as_of))
    return out if state is None else out.where(F.col("alertstate") == state)


def severity_counts(states: DataFrame, severities: Sequence[str] = ("critical", "warning", "info")) -> DataFrame:
    """Firing alerts per severity, with 0 for severities that have none: one conditional aggregation."""
    aggs = [F.count_if((F.col("alertstate") == "firing") & (F.col("severity") == s)).alias(s) for s in severities]
    one = states.agg(*aggs)
    return one.select(F.inline(F.array(*[F.struct(F.lit(s).alias("severity"), F.col(s).alias("count")) for s in severities])))
