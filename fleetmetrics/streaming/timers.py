"""Keyed state with event-time timers: what falls due without new input, and rows out of order.

Every processor here holds the rows of a key until the watermark has passed them and then works them off
in order, so the outcome does not depend on how rows are spread over micro-batches or in which order
they come within the delay. A timer wakes a key when the next held row or deadline is due. State is kept
in RocksDB; a key holds its rows of one delay, not its history. The Python worker never has them all: they
are kept as sorted runs in pieces and merged, so its memory does not follow the rows of a key.

What the final watermark of a finished input has not reached stays open: a stream that goes on will
emit it.
"""

from __future__ import annotations

import heapq
import json
from bisect import bisect_right
from collections.abc import Iterable, Iterator, Sequence
from itertools import batched, groupby

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..session import shared_dir
from ..timeutil import micros

#: Timers need this state store; it also keeps state that is larger than memory.
CONF = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}

#: Rows that a worker sorts at once, rows of a stored piece, and runs of one level that are merged into one of the next.
SORTED, PIECE, RUNS = 20_000, 1000, 16


def _ms(us: int) -> int:
    """The first millisecond that is not before an instant."""
    return -(-us // 1000)


class InOrder(StatefulProcessor):
    """Base of the processors: held rows by instant, one state row, one timer.

    A subclass gives ``state_schema`` (DDL), ``row_of`` for an input row (a tuple of numbers, strings and booleans that begins with
    its instant in microseconds; None to pass over it) and ``advance(key, state, rows, now)`` that takes rows
    in order and returns the new state, output rows without the key and the next deadline, if any. It
    is called for pieces of the rows up to the watermark, at last without rows at the watermark. An input row may
    be the first state of its key (``seed``), and rows that change no outcome may be left out (``thin``).

    A run is (number, first piece, end, first instant, level): sorted rows, stored in pieces. New rows are sorted in memory up to a
    limit, and ``RUNS`` runs of a level are merged into one of the next.
    """

    state_schema = ""
    names: Sequence[str] = ()

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", self.state_schema)
        self.runs = handle.getValueState("runs", "runs string")
        self.pieces = handle.getMapState("pieces", "run long, piece long", "rows string")

    def close(self) -> None:
        pass

    def seed(self, row: Row) -> tuple | None:
        return None

    def row_of(self, row: Row) -> tuple | None:
        raise NotImplementedError

    def thin(self, rows: list[tuple]) -> list[tuple]:
        return rows

    def advance(self, key: tuple, state: tuple | None, rows: Sequence[tuple], now: int) -> tuple[tuple | None, list[tuple], int | None]:
        raise NotImplementedError

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        return self._work(key, rows, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        return self._work(key, (), timerValues)

    def _add(self, runs: list[list], rows: Iterable[tuple], level: int = 0) -> None:
        number, end, first = max((r[0] for r in runs), default=-1) + 1, 0, None
        for piece in batched(rows, PIECE):
            first = piece[0][0] if first is None else first
            self.pieces.updateValue((number, end), (json.dumps(piece),))
            end += 1
        if end:
            runs.append([number, 0, end, first, level])
        if len(full := [r for r in runs if r[4] == level]) >= RUNS:
            self._add(runs, _distinct(heapq.merge(*(self._take(r) for r in full))), level + 1)
            runs[:] = [r for r in runs if r[1] < r[2]]

    def _take(self, run: list, until: int | None = None) -> Iterator[tuple]:
        """The rows of a run up to an instant, which leave the state."""
        while run[1] < run[2] and (until is None or run[3] <= until):
            at = (run[0], run[1])
            rows = [tuple(x) for x in json.loads(self.pieces.getValue(at)[0])]
            n = len(rows) if until is None else bisect_right(rows, until, key=lambda x: x[0])
            yield from rows[:n]
            if n < len(rows):
                if n:
                    self.pieces.updateValue(at, (json.dumps(rows[n:]),))
                run[3] = rows[n][0]
                return
            self.pieces.removeKey(at)
            run[1] += 1

    def _work(self, key, new: Iterable[Row], timers) -> Iterator[Row]:
        now = timers.getCurrentWatermarkInMs() * 1000
        named = Row(*self.names)
        state = self.state.get() if self.state.exists() else None
        before = json.loads(self.runs.get()[0]) if self.runs.exists() else []
        runs, fresh = [list(r) for r in before], []
        for row in new:
            if (first := self.seed(row)) is not None:
                state = first if state is None else state
            elif (x := self.row_of(row)) is not None:
                fresh.append(x)
                if len(fresh) >= SORTED:
                    fresh = self.thin(sorted({*fresh}))
                    if len(fresh) > SORTED // 2:
                        self._add(runs, fresh)
                        fresh = []
        fresh = self.thin(sorted({*fresh}))
        n = bisect_right(fresh, now, key=lambda x: x[0])
        due = _distinct(heapq.merge(fresh[:n], *(self._take(r, now) for r in runs)))  # a repeated row is one row
        for rows in batched(due, PIECE):
            state, out, _ = self.advance(key, state, rows, rows[-1][0] - 1)  # more rows of the last instant may follow
            yield from (named(*key, *x) for x in out)
        state, out, deadline = self.advance(key, state, (), now)
        yield from (named(*key, *x) for x in out)
        if state is None:
            self.state.clear()
        else:
            self.state.update(state)
        runs = [r for r in runs if r[1] < r[2]]
        self._add(runs, fresh[n:])
        if runs:
            if runs != before:
                self.runs.update((json.dumps(runs),))
        elif before:
            self.runs.clear()
        wake = min([_ms(u) for u in (deadline, *(r[3] for r in runs)) if u is not None], default=None)
        for t in list(self.handle.listTimers()):
            if t != wake:
                self.handle.deleteTimer(t)
        if wake is not None:
            self.handle.registerTimer(max(wake, timers.getCurrentWatermarkInMs() + 1))


def _distinct(rows: Iterable[tuple]) -> Iterator[tuple]:
    """Sorted rows, equal ones once."""
    return (x for x, _ in groupby(rows))


def _stream(stream: DataFrame, keys: Sequence[str], processor: InOrder, added: str, ts: str, delay: str) -> DataFrame:
    schema = T.StructType([*[stream.schema[k] for k in keys], *T._parse_datatype_string(added).fields])
    processor.names = schema.names
    return stream.withWatermark(ts, delay).groupBy(*keys).transformWithState(processor, schema, "Append", "EventTime")


class _DeadMan(InOrder):
    """State: instant of the last sample or of the registration, whether it was a sample, whether down."""

    state_schema = "last long, seen boolean, down boolean"

    def __init__(self, gap: int):
        self.gap = gap

    def seed(self, row: Row) -> tuple | None:
        return None if row["since"] is None else (row["since"], False, False)

    def row_of(self, row: Row) -> tuple:
        return (row["u"],)

    def thin(self, rows):
        """The first and last sample of each stretch of one gap: wherever the watermark stands between them, the
        silence since the first is no longer than the gap."""
        kept = []
        for _, same in groupby(rows, key=lambda x: x[0] // max(self.gap, 1)):
            first, *others = same
            kept += [first, *others[-1:]]
        return kept

    def advance(self, key, state, rows, now):
        if state is None:  # not a target
            return None, [], None
        (last, seen, down), out = state, []

        def fall(until: int) -> None:
            nonlocal down
            if not down and until > last + self.gap:
                down = True
                out.append(("down", last + self.gap, last if seen else None))

        for (u,) in rows:
            fall(u)
            if down:
                down = False
                out.append(("up", u, last if seen else None))
            last, seen = max(last, u), True
        fall(now + 1)
        return (last, seen, down), out, None if down else last + self.gap


def dead_man(samples: DataFrame, targets: DataFrame, gap, keys: Sequence[str] = ("series_key",), delay="10 minutes", ts: str = "ts", since: str = "since") -> DataFrame:
    """When each expected target falls silent and comes back: ``(keys, event, at, last_seen)``.

    ``targets`` (keys, ``since``) seed the state, so a target that never sends is reported ``gap`` after
    it was registered, with no ``last_seen``. Each sample re-arms the target's timer; ``down`` is emitted
    once for a silence of over ``gap``, ``up`` with the sample that ends it. Other series are passed over.

    Targets are stored and come as a stream beside the samples, without an instant, so they do not move the watermark: with an
    initial state a Python worker would hold all samples of a key.
    """
    spark, base = samples.sparkSession, shared_dir(samples.sparkSession, "targets")
    none = F.lit(None)
    flat = samples.select(*keys, ts, F.unix_micros(ts).alias("u"), none.cast("long").alias("since"))
    rows = targets.select(*keys, none.cast(samples.schema[ts].dataType).alias(ts), none.cast("long").alias("u"), F.unix_micros(since).alias("since"))
    rows.write.parquet(base)
    flat = flat.unionByName(spark.readStream.schema(rows.schema).parquet(base))
    out = _stream(flat, keys, _DeadMan(micros(gap)), "event string, at long, last_seen long", ts, delay)
    return out.select(*keys, "event", F.timestamp_micros("at").alias("at"), F.timestamp_micros("last_seen").alias("last_seen"))


class _Epochs(InOrder):
    """State: value, first and last instant and number of samples of the run that is open."""

    state_schema = "value string, start long, last long, n long"

    def row_of(self, row: Row) -> tuple:
        return (row["u"], row["v"])

    def advance(self, key, state, rows, now):
        out = []
        for u, v in rows:
            if state is None:
                state = (v, u, u, 1)
            elif v == state[0]:
                state = (v, state[1], u, state[3] + 1)
            else:
                out.append((*state, u, v))
                state = (v, u, u, 1)
        return state, out, None


def epochs(samples: DataFrame, value: str, keys: Sequence[str] = ("series_key",), delay="10 minutes", ts: str = "ts") -> DataFrame:
    """Runs of one value, such as the role of an instance: ``(keys, value, since, last_seen, samples,
    ended_at, next_value)``, emitted when a sample with another value ends the run.

    A sample that comes late, but within ``delay``, takes its place in time: it can lengthen a run, join
    two or split one, because a run is only closed by samples that the watermark has passed.
    """
    flat = samples.select(*keys, ts, F.unix_micros(ts).alias("u"), F.col(value).cast("string").alias("v")).where("v is not null")
    out = _stream(flat, keys, _Epochs(), "value string, start long, last long, samples long, ended long, next_value string", ts, delay)
    return out.select(*keys, F.col("value").alias(value), *[F.timestamp_micros(c).alias(n) for c, n in (("start", "since"), ("last", "last_seen"), ("ended", "ended_at"))], "samples", "next_value")


class _Alert(InOrder):
    """State: start of the activation (if any) and the last instant. Rows: instant, active, hold."""

    state_schema = "since long, last long, hold long"

    def __init__(self, step: int):
        self.step = step

    def row_of(self, row: Row) -> tuple:
        return (row["u"], row["active"], row["hold"])

    def advance(self, key, state, rows, now):
        since, last, hold = state or (None, None, 0)
        out = []

        def end() -> None:
            nonlocal since
            if since is not None and last - since >= hold:
                out.append((last + self.step, since, "resolved", True))
            since = None

        for u, active, own in rows:
            if last is not None and u <= last:
                continue  # one instant counts once
            if since is not None and (not active or u - last > self.step):
                end()
            if active:
                since = u if since is None else since
                firing = u - since >= own
                out.append((u, since, "firing" if firing else "pending", u == since or firing != (last - since >= own)))
            last, hold = u, own
        # all rows up to now are in: without its next instant a series is silent, and nothing of it is kept
        if last is not None and last + self.step <= now:
            end()
            return None, out, None
        return ((since, last, hold) if last is not None else None), out, last + self.step if last is not None else None


def alert_states(evals: DataFrame, step, keys: Sequence[str] = ("series_key",), hold: str = "hold", delay="10 minutes", t: str = "t") -> DataFrame:
    """pending / firing / resolved from evaluations ``(keys, t, active, hold in seconds)``.

    Evaluations may come up to ``delay`` late and in any order: they wait until the watermark has passed
    them. One that fails, a missed step, or silence ends the activation. ``changed`` marks the rows at which
    the state of an alert is another than before.
    """
    flat = evals.select(*keys, t, F.unix_micros(t).alias("u"), F.col("active").cast("boolean").alias("active"), (F.col(hold).cast("long") * 1_000_000).alias("hold"))
    out = _stream(flat, keys, _Alert(micros(step)), "t_us long, since_us long, alertstate string, changed boolean", t, delay)
    return out.select(*keys, F.timestamp_micros("t_us").alias("t"), F.timestamp_micros("since_us").alias("active_since"), "alertstate", "changed")


class _Notify(InOrder):
    """State: start of the group's life, firing alerts, the last notification, the flush that is due and
    the alerts that changed since the one before, which are those of one interval."""

    state_schema = "life long, firing long, sent long, due long, moved string"

    def __init__(self, wait: int, interval: int, repeat: int):
        # a repeat waits for the next flush
        self.wait, self.interval, self.repeat = wait, interval, -(-repeat // interval) * interval

    def row_of(self, row: Row) -> tuple | None:
        return (row["u"], row["member"], row["d"]) if row["d"] else None

    def advance(self, key, state, rows, now):
        life, firing, sent, due, moved = (*state[:4], json.loads(state[4])) if state else (None, 0, None, None, {})
        out = []

        def following() -> int | None:
            again = sent + self.repeat if firing and sent is not None else None
            return min((x for x in (due, again) if x is not None), default=None)

        def run(until: int) -> None:
            """Notifications that fall due before ``until``: of changes, then repeats without any input."""
            nonlocal life, sent, due, moved
            while (at := following()) is not None and at < until:
                net = [d for d in moved.values() if d] if at == due else []
                if net or at != due or (firing and sent is not None and at == sent + self.repeat):
                    new = sum(d > 0 for d in net)
                    out.append((at, "change" if net else "repeat", firing, new, len(net) - new))
                    sent = at
                if at == due:
                    due, moved = None, {}
                if not firing and due is None:
                    life = sent = None

        for u, member, d in rows:
            run(u)
            if life is None:
                life = u
            firing += d
            moved[member] = moved.get(member, 0) + d
            if due is None:
                first = life + self.wait
                due = first + max(0, -(-(u - first) // self.interval)) * self.interval
        run(now + 1)
        return ((life, firing, sent, due, json.dumps(moved)) if life is not None else None), out, following()


def notify(states: DataFrame, group: Sequence[str], member: Sequence[str] = ("series_key",), wait="30s", interval="5m", repeat="24h", delay="10 minutes", t: str = "t") -> DataFrame:
    """Notifications of groups of alerts: ``(group, sent_at, reason, firing, new, resolved)``.

    ``states`` come from ``alert_states``; those that did not change only move time on. A group is flushed ``wait`` after its
    first alert and every ``interval`` from then on; a flush with changes notifies. Waits and repeats
    are timers of the group: they are sent when the watermark of the stream passes them, be there rows
    of the group or not. A group's state has numbers and the members that changed since the last flush,
    never all members.
    """
    d = F.when(F.col("changed") & (F.col("alertstate") == "firing"), 1).when(F.col("changed") & (F.col("alertstate") == "resolved"), -1).otherwise(0)
    flat = states.select(*group, t, F.unix_micros(t).alias("u"), F.concat_ws("|", *member).alias("member"), d.alias("d"))
    out = _stream(flat, group, _Notify(*map(micros, (wait, interval, repeat))), "at long, reason string, firing long, new long, resolved long", t, delay)
    return out.select(*group, F.timestamp_micros("at").alias("sent_at"), "reason", "firing", "new", "resolved")


def inhibit(alerts: DataFrame, step, source: str = "critical", target: str = "warning", equal: Sequence[str] = ("alertname", "job", "service"), delay="10 minutes", t: str = "t") -> DataFrame:
    """A stream of firing alerts without the ``target`` ones that a ``source`` alert mutes.

    A watermarked left outer join: a target waits until the watermark tells that no source with equal
    labels can come for its step any more, and both sides are dropped from the state then.
    """
    alerts = alerts.withWatermark(t, delay)
    muting = alerts.where(F.col("severity") == source).select(*[F.col(c).alias(f"by_{c}") for c in equal], F.col(t).alias("by_t"), F.lit(True).alias("muted"))
    same = F.lit(True)
    for c in equal:
        same = same & (F.col(c) == F.col(f"by_{c}"))
    within = (F.col("by_t") <= F.col(t)) & (F.col("by_t") > F.col(t) - F.make_dt_interval(secs=F.lit(micros(step) / 1e6)))
    left = alerts.where(F.col("severity") == target).join(muting, same & within, "leftOuter").where("muted is null")
    return left.select(*alerts.columns)
