"""A dashboard in one pass: all panels of the same window share one set of window states.

Panels are grouped by (kind of state, window). Each group reads the metrics of all its panels once, folds
them to the union of the states that their functions need, and stores the result, which is as small as
the grid. A panel then takes its metrics and series from the stored states, computes its function from
the state columns, and goes on as it would alone. Matchers meet each series once.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..alerts.evaluate import as_series, labels_of
from ..operators import windows as W
from ..operators.selectors import select
from ..session import shared_dir
from ..timeutil import micros
from .panels import Panel, finish_panel

_KEYS = ["metric", "series_key"]
_RANGE = {
    "rate": lambda st, w: W.increase_of(st, w, _KEYS).withColumn("value", F.col("value") / F.lit(w / 1e6)),
    "increase": lambda st, w: W.increase_of(st, w, _KEYS),
    "irate": lambda st, w: W.irate_of(st, _KEYS),
    "idelta": lambda st, w: W.idelta_of(st, _KEYS),
    "changes": lambda st, w: st.select(*_KEYS, "t", F.col("chg").cast("double").alias("value")),
}


def _kind(p: Panel, lookback: str) -> tuple[str, int]:
    """What a panel's states depend on: counters need ordered ones, all else plain ones of its window."""
    if p.fn in _RANGE:
        return "ordered", micros(p.window)
    return "plain", micros(p.window if p.fn else lookback)


def _function(p: Panel) -> str:
    return p.fn.removesuffix("_over_time") if p.fn else "last"


def groups(panels: Mapping[str, Panel], lookback: str = "5m") -> dict[tuple[str, int], list[str]]:
    """The panels that share states, by kind and window."""
    out: dict[tuple[str, int], list[str]] = {}
    for name, p in panels.items():
        out.setdefault(_kind(p, lookback), []).append(name)
    return out


def dashboard(samples: DataFrame, panels: Mapping[str, Panel], grid: W.Grid, lookback: str = "5m", **picked: str) -> DataFrame:
    """``(panel, series_key, t, value)`` of all panels; ``picked`` are the dashboard's variables."""
    spark = samples.sparkSession
    out: DataFrame | None = None
    for (kind, window), names in groups(panels, lookback).items():
        metrics = sorted({m for n in names for m in (panels[n].metric, panels[n].metric2) if m})
        raw = as_series(select(samples, metrics))
        span = dt.timedelta(microseconds=window)
        if kind == "ordered":
            states = W.range_states(raw, grid, span, _KEYS)
        else:
            states = W.over_time(raw, grid, span, sorted({_function(panels[n]) for n in names}), _KEYS)
        path = shared_dir(spark, "dashboard")
        states.write.parquet(path)
        stored = spark.read.schema(states.schema).parquet(path)
        for name in names:
            p = panels[name]
            own = stored.where(F.col("metric").isin([m for m in (p.metric, p.metric2) if m]))
            matchers = (*p.matchers, *((label, op, picked[arg]) for arg, label, op in p.vars if arg in picked))
            if matchers:
                series = own.select(*_KEYS).distinct().withColumn("labels", labels_of(F.col("series_key")))
                own = own.join(select(series, matchers=matchers).select(*_KEYS), _KEYS, "left_semi")
            v = _RANGE[p.fn](own, window) if kind == "ordered" else own.select(*_KEYS, "t", F.col(_function(p)).alias("value"))
            done = finish_panel(samples, v, p, grid, lookback).select(F.lit(name).alias("panel"), "series_key", "t", "value")
            out = done if out is None else out.unionByName(done)
    if out is None:
        raise ValueError("a dashboard has one panel at least")
    return out
