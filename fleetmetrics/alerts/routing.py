"""Inhibition, routing tree, grouping and notification times."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import label
from ..operators.selectors import anchored
from ..timeutil import ceil_div, micros

# fixed values: an alert is muted by a more severe one with the same name, job and service
INHIBIT_EQUAL = ("alertname", "job", "service")
GROUP_BY = ("severity", "service", "job", "alertname")
GROUP_WAIT, GROUP_INTERVAL, REPEAT_INTERVAL = "30s", "5m", "24h"
DEFAULT_RECEIVER = "default-receiver"


def inhibit(alerts: DataFrame, source: str = "critical", target: str = "warning", equal: Sequence[str] = INHIBIT_EQUAL, at: Sequence[str] = ("t",)) -> DataFrame:
    """Drop ``target`` alerts while a ``source`` alert agrees on the ``equal`` labels."""
    named = alerts.withColumns({f"_e{i}": label(alerts, c) for i, c in enumerate(equal)})
    keys = [f"_e{i}" for i in range(len(equal))] + list(at)
    muting = named.where(F.col("severity") == source).select(*keys).distinct()
    muted = named.where(F.col("severity") == target).join(muting, keys, "left_anti")
    return named.where(F.col("severity") != target).unionByName(muted).select(*alerts.columns)


@dataclass(frozen=True)
class Route:
    receiver: str
    match: dict[str, str] = field(default_factory=dict)
    match_re: dict[str, str] = field(default_factory=dict)
    routes: tuple[Route, ...] = ()


def _leaves(route: Route, path: list[tuple[str, str, str]]):
    """Nodes with the matchers of their whole path, children before parents."""
    here = path + [(k, "=", v) for k, v in route.match.items()] + [(k, "=~", v) for k, v in route.match_re.items()]
    for child in route.routes:
        yield from _leaves(child, here)
    yield route.receiver, here


def route(alerts: DataFrame, tree: Route, name: str = "receiver") -> DataFrame:
    """Receiver of each alert: first matching child on every level, the deepest match wins.

    The tree becomes one conditional expression, so routing adds no join and no shuffle.
    """
    out: Column | None = None
    for receiver, matchers in _leaves(tree, []):
        cond = F.lit(True)
        for key, op, value in matchers:
            text = label(alerts, key)
            cond = cond & ((text == value) if op == "=" else text.rlike(anchored(value)))
        out = F.when(cond, receiver) if out is None else out.when(cond, receiver)
    return alerts.withColumn(name, out)


def group_key(alerts: DataFrame, by: Sequence[str] = GROUP_BY) -> Column:
    return F.concat_ws("/", *[label(alerts, c) for c in by])


def group_alerts(alerts: DataFrame, by: Sequence[str] = GROUP_BY, at: Sequence[str] = ("t",)) -> DataFrame:
    """One row per notification group and instant: size and extremes.

    The members stay rows of ``alerts`` (see ``group_key``); they are not collected into one value,
    because a group can hold any number of them.
    """
    named = [label(alerts, c).alias(c) for c in by]
    return alerts.groupBy(*named, *at).agg(
        F.count("*").alias("alerts"), F.min("series_key").alias("first_member"), F.max("series_key").alias("last_member"), F.max("value").alias("top"),
    )


def notifications(
    stretches: DataFrame, group: Sequence[str], member: Sequence[str] = ("series_key",), wait=GROUP_WAIT, interval=GROUP_INTERVAL, repeat=REPEAT_INTERVAL,
    until: Column | None = None, send_resolved: bool = True,
) -> DataFrame:
    """Notification times of every group from the firing stretches ``(fired_at, resolved_at)``.

    A group lives from its first firing alert until a flush finds nothing firing.  It is flushed
    ``wait`` after its start and every ``interval`` from then on; ``until`` ends the log.  A flush notifies when the set of
    firing alerts changed since the one before, and again whenever ``repeat`` has passed without
    a notification.  Everything is grouping and windows over changes; alerts are never collected.
    """
    w_us, i_us = micros(wait), micros(interval)
    r_us = -(-micros(repeat) // i_us) * i_us  # a repeat waits for the next flush
    lives = _group_lives(stretches, group, w_us, i_us)
    change = F.array(
        F.struct(F.col("fired_at").alias("at"), F.lit(1).alias("delta")), F.struct(F.col("resolved_at").alias("at"), F.lit(-1).alias("delta")),
    )
    moves = lives.select(*group, *member, "life", F.inline(change)).where(F.col("at").isNotNull())
    due = F.unix_micros("at") - F.unix_micros("life") - F.lit(w_us)
    flush = F.greatest(ceil_div(due, i_us), F.lit(0))
    # what happened to one alert between two flushes counts by its net effect
    net = moves.withColumn("flush", flush).groupBy(*group, "life", "flush", *member).agg(F.sum("delta").alias("d"))
    per = net.where("d <> 0").groupBy(*group, "life", "flush").agg(F.count_if(F.col("d") > 0).alias("new"), F.count_if(F.col("d") < 0).alias("resolved"))
    w = Window.partitionBy(*group, "life").orderBy("flush")
    firing = F.sum(F.col("new") - F.col("resolved")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    at = F.unix_micros("life") + F.lit(w_us) + F.col("flush") * F.lit(i_us)
    sent = per.withColumns({"firing": firing, "_at": at}).withColumn("_next", F.lead("_at").over(w))
    if not send_resolved:
        sent = sent.where("firing > 0 and new > 0")
    end = F.col("_next") if until is None else F.least(F.col("_next"), F.unix_micros(until) + F.lit(1))  # least() skips NULL
    every = F.lit(r_us).cast("bigint")
    repeats = F.when((F.col("firing") > 0) & end.isNotNull() & (F.col("_at") + every < end), F.sequence(F.col("_at") + every, end - F.lit(1), every))
    rows = F.concat(
        F.array(F.struct(F.col("_at").alias("at_us"), F.lit("change").alias("reason"))),
        F.coalesce(F.transform(repeats, lambda u: F.struct(u.alias("at_us"), F.lit("repeat").alias("reason"))), F.array().cast("array<struct<at_us:bigint,reason:string>>")),
    )
    out = sent.select(*group, "firing", "new", "resolved", F.inline(rows))
    if until is not None:
        out = out.where(F.col("at_us") <= F.unix_micros(until))
    zero = F.lit(0).cast("bigint")
    return out.select(
        *group, F.timestamp_micros("at_us").alias("sent_at"), "reason", "firing",
        F.when(F.col("reason") == "change", F.col("new")).otherwise(zero).alias("new"), F.when(F.col("reason") == "change", F.col("resolved")).otherwise(zero).alias("resolved"),
    )


def open_lives(stretches: DataFrame, group: Sequence[str], since: Column, wait=GROUP_WAIT, interval=GROUP_INTERVAL) -> DataFrame:
    """The stretches of groups that had not been given up by ``since``: all that a later state can change."""
    w_us, i_us = micros(wait), micros(interval)
    lives = _group_lives(stretches, group, w_us, i_us)
    ends = lives.groupBy(*group, "life").agg(F.count_if(F.col("resolved_at").isNull()).alias("firing"), F.unix_micros(F.max("resolved_at")).alias("end"))
    living = ends.where((F.col("firing") > 0) | (F.col("end") + F.lit(max(w_us, i_us)) >= F.unix_micros(since)))
    return lives.join(living.select(*group, "life"), [*group, "life"], "left_semi").drop("life")


def _group_lives(stretches: DataFrame, group: Sequence[str], w_us: int, i_us: int) -> DataFrame:
    """Add ``life``: start of the group's life that a stretch belongs to.

    Stretches are first merged per time bucket of one interval, so the ordered step below sees a
    bounded number of rows for each group, not all of its alerts.
    """
    far = F.lit(253402300799000000)
    s, e = F.unix_micros("fired_at"), F.coalesce(F.unix_micros("resolved_at"), far)
    bucket = ceil_div(s, i_us)
    cut = stretches.withColumns({"_s": s, "_e": e, "_b": bucket})
    spans = cut.groupBy(*group, "_b").agg(F.min("_s").alias("_s"), F.max("_e").alias("_e"))
    w = Window.partitionBy(*group).orderBy("_s")
    seen = F.max("_e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    # the group is given up by the first flush after everything has resolved
    fresh = F.when(F.col("_s") > seen + F.lit(max(w_us, i_us)), 1).when(seen.isNull(), 1).otherwise(0)
    numbered = spans.withColumn("_f", fresh).withColumn("_n", F.sum("_f").over(w))
    life = numbered.withColumn("life", F.timestamp_micros(F.min("_s").over(Window.partitionBy(*group, "_n"))))
    return cut.join(life.select(*group, "_b", "life"), [*group, "_b"]).drop("_s", "_e", "_b")
