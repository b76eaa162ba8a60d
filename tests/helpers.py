from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from fleetmetrics.sources.literal import values

T0 = dt.datetime(2024, 1, 1)


def at(seconds: float) -> str:
    return (T0 + dt.timedelta(seconds=seconds)).isoformat(sep=" ")


def series(spark, points: dict[str, list[tuple[float, float]]]):
    """Samples from {series_key: [(seconds, value), ...]}."""
    rows = [(k, at(s), float(v)) for k, ps in points.items() for s, v in ps]
    return values(spark, rows, "series_key string, ts timestamp, value double")


def labelled(spark, rows: list[tuple[str, dict, float, float]]):
    """Samples from [(metric, labels, seconds, value)]."""
    data = [(m, ls, at(s), float(v)) for m, ls, s, v in rows]
    return values(spark, data, "metric string, labels map<string,string>, ts timestamp, value double")


def by_time(df, key="series_key", value="value"):
    """{(series, seconds since T0): value}."""
    out = {}
    for r in df.select(key, F.unix_seconds("t").alias("t"), value).collect():
        out[(r[0], r[1] - int(T0.replace(tzinfo=dt.timezone.utc).timestamp()))] = r[2]
    return out
