"""Query registry and the SQL fragments shared by the check queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.windows import Grid
from ..sources.tables import event_counters, event_samples, table
from ..timeutil import micros

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``name``, with the equivalent SQL if there is one."""

    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


STEP, RANGE = "6h", "1d"
_DAY = micros("1d")


#: First and last instant of the events, by application and folder: one job for all queries of a session.
_BOUNDS: dict[tuple[str, str], tuple] = {}


def bounds(spark: SparkSession, sf: str) -> tuple:
    key = (spark.sparkContext.applicationId, sf)
    if key not in _BOUNDS:
        _BOUNDS[key] = tuple(table(spark, sf, "events").agg(F.unix_micros(F.min("ts")), F.unix_micros(F.max("ts"))).first())
    return _BOUNDS[key]


def grid(spark: SparkSession, sf: str, step: str = STEP, first: str = STEP) -> Grid:
    """A grid over all events: from ``first`` after the start of their first day to the end of the last."""
    times = bounds(spark, sf)
    lo, hi = (0 if u is None else u // _DAY * _DAY for u in times)
    return Grid(micros(step), lo + micros(first), hi + _DAY)


def day_grid(spark: SparkSession, sf: str) -> Grid:
    return grid(spark, sf, "1d", "1d")


def grid_sql(step: str, first: str) -> str:
    return f"""bounds as (select cast(date_trunc('day', min(ts)) as timestamp) as lo, cast(date_trunc('day', max(ts)) as timestamp) + interval 1 day as hi from events),
  g as (select unnest(generate_series(lo + interval {first}, hi, interval {step})) as t from bounds)"""


G, DAILY = grid_sql("6 hour", "6 hour"), grid_sql("1 day", "1 day")

M = """m as (select event_type as metric, concat('h', cast(user_id % 4 as varchar)) as host,
  concat(event_type, '|', 'h', cast(user_id % 4 as varchar)) as series_key, ts, event_id, value from events)"""
CTR = M + """, ctr as (select series_key, metric, host, ts, event_id, round(sum(value) over (partition by series_key, cast(ts as date)
  order by ts, event_id rows between unbounded preceding and current row), 2) as value from m)"""


def m(spark: SparkSession, sf: str) -> DataFrame:
    return event_samples(table(spark, sf, "events"))


def ctr(spark: SparkSession, sf: str) -> DataFrame:
    return event_counters(m(spark, sf))


def epoch(c: str = "t"):
    """Whole epoch seconds, comparable across engines."""
    return F.unix_seconds(c)


def r(c, digits: int = 6):
    return F.round(c, digits)
