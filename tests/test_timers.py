"""Streams of state and timers: rows out of order, silence, and nothing from anywhere but the stream."""

from __future__ import annotations

import datetime as dt
import pickle
import random
import tracemalloc

import pytest
from helpers import T0, at, series
from pyspark.sql import Row
from pyspark.sql import functions as F
from test_streaming import evals, stream_of

from fleetmetrics.operators import windows as W
from fleetmetrics.plans import ORACLES, QUERIES, streams, timed
from fleetmetrics.sources.literal import values
from fleetmetrics.streaming import ingest, rates, timers


def secs(t):
    return None if t is None else int((t - T0).total_seconds())


def run(df, name="t"):
    return ingest.run_to_table(df, name).collect()


def test_dead_man(spark, tmp_path):
    parts = [
        series(spark, {"a": [(10, 1), (300, 1)], "x": [(5, 1)]}), series(spark, {"a": [(100, 1), (60, 1)]}),  # 60 and 100 come after 300
        series(spark, {"b": [(700, 1)]}), series(spark, {"end": [(3000, 1)]}),
    ]
    targets = values(spark, [(k, at(0)) for k in ("a", "b", "never")], "series_key string, since timestamp")
    got = sorted((r.series_key, secs(r["at"]), r.event, secs(r.last_seen)) for r in run(timers.dead_man(stream_of(spark, tmp_path, parts), targets, "100s", delay="10 minutes")))
    assert got == [
        ("a", 200, "down", 100), ("a", 300, "up", 100), ("a", 400, "down", 300),
        ("b", 100, "down", None), ("b", 700, "up", None), ("b", 800, "down", 700), ("never", 100, "down", None),
    ]


def test_epochs_take_late_rows_in_their_place(spark, tmp_path):
    def roles(rows):
        return values(spark, [(k, at(s), v) for k, s, v in rows], "series_key string, ts timestamp, role string")

    parts = [
        roles([("a", 0, "p"), ("a", 60, "p"), ("a", 180, "r")]), roles([("a", 120, "r"), ("a", 30, "r"), ("b", 50, "p")]),  # 30 splits the first run
        roles([("a", 240, "p"), ("a", 240, "p"), ("b", 300, "p")]), roles([("end", 9000, "p")]),
    ]
    got = sorted((r.series_key, secs(r.since), secs(r.last_seen), r.role, r["samples"], secs(r.ended_at), r.next_value) for r in run(timers.epochs(stream_of(spark, tmp_path, parts), "role", delay="5 minutes")))
    assert got == [("a", 0, 0, "p", 1, 30, "r"), ("a", 30, 30, "r", 1, 60, "p"), ("a", 60, 60, "p", 1, 120, "r"), ("a", 120, 180, "r", 2, 240, "p")]


def test_a_late_evaluation_counts(spark, tmp_path):
    parts = [evals(spark, [("a", 0, True), ("a", 120, True)]), evals(spark, [("a", 60, True)]), evals(spark, [("c", 9000, False)])]
    from fleetmetrics.streaming import stateful

    got = sorted((secs(r.t), secs(r.active_since), r.alertstate) for r in run(stateful.alert_state_stream(stream_of(spark, tmp_path, parts), "1m", "2m", delay="10 minutes")))
    assert got == [(0, 0, "pending"), (60, 0, "pending"), (120, 0, "firing"), (180, 0, "resolved")]


def test_notifications_fall_due_without_rows(spark, tmp_path):
    schema = "team string, series_key string, t timestamp, alertstate string, changed boolean"

    def moves(rows):
        return values(spark, [("x", k, at(s), state, True) for k, s, state in rows], schema)

    hour = 3600
    parts = [
        moves([("a", 10, "firing"), ("b", 20, "firing"), ("b", 25, "resolved")]), moves([("c", 200, "firing")]),
        # a silent day and a half, in which only time goes on
        values(spark, [("y", "z", at(38 * hour), "pending", False)], schema), moves([("a", 39 * hour, "resolved"), ("c", 39 * hour, "resolved")]), values(spark, [("y", "z", at(80 * hour), "pending", False)], schema),
    ]
    got = [(secs(r.sent_at), r.reason, r.firing, r.new, r.resolved) for r in sorted(run(timers.notify(stream_of(spark, tmp_path, parts), ["team"], delay="1 minute")), key=lambda r: r.sent_at)]
    assert got == [
        (40, "change", 1, 1, 0),  # b came and went before the flush
        (340, "change", 2, 1, 0), (340 + 24 * hour, "repeat", 2, 0, 0), (39 * hour + 40, "change", 0, 0, 2),
    ]


def test_rates_equal_the_batch_operator(spark, tmp_path):
    full = {"a": [(65, 10), (100, 15), (130, 3), (190, 9), (250, 9), (420, 1)], "b": [(61, 5), (600, 2)]}
    parts = [
        series(spark, {"a": [(65, 10), (130, 3)], "b": [(61, 5)]}), series(spark, {"a": [(100, 15), (130, 3), (190, 9)]}),
        series(spark, {"a": [(250, 9), (420, 1)], "b": [(600, 2)]}), series(spark, {"end": [(5000, 1)]}),
    ]
    grid = W.Grid.of("60s", at(60), at(900))
    for fn, ref in ((rates.rate, W.rate), (rates.irate, W.irate)):
        s = stream_of(spark, tmp_path, parts, fn.__name__)
        got = {(r.series_key, secs(r.t)): r.value for r in run(fn(s, "3 minutes", "1 minute", "30 seconds", delay="10 minutes")) if r.series_key != "end"}
        want = {(r.series_key, secs(r.t)): r.value for r in ref(series(spark, full), grid, "3m").collect()}
        assert got == pytest.approx(want) and want
    with pytest.raises(ValueError):
        rates.rate(s, "100 seconds", "1 minute", "30 seconds")


def test_inhibition_joins_streams(spark, tmp_path):
    schema = "alertname string, job string, service string, severity string, host string, t timestamp"

    def alerts(rows):
        return values(spark, [(n, "j", "s", sev, h, at(s)) for n, sev, h, s in rows], schema)

    parts = [alerts([("x", "warning", "h1", 60), ("y", "warning", "h1", 60)]), alerts([("x", "critical", "h2", 60), ("x", "warning", "h1", 120)]), alerts([("z", "critical", "h", 9000)]), alerts([("z", "critical", "h", 9060)])]
    got = sorted((r.alertname, secs(r.t)) for r in run(timers.inhibit(stream_of(spark, tmp_path, parts), "1m", delay="5 minutes")))
    assert got == [("x", 120), ("y", 60)]


@pytest.mark.parametrize("name", ["stream_window", "stream_absence", "stream_deadman", "stream_rate_rows", "stream_role_epochs"])
def test_an_emptied_stream_gives_no_closed_rows(spark, monkeypatch, name):
    """The rows before the last watermark come from the stream and nothing else."""
    sf = "/root/testdata/sf0.001"
    whole = QUERIES[name](spark, sf).count()
    for module in (streams, timed):
        monkeypatch.setattr(module, "table_stream", lambda s, d, n, f=module.table_stream: f(s, d, n).where("false"))
    assert name in ORACLES and QUERIES[name](spark, sf).count() < 0.7 * whole


class _Stored:
    """State of one key in files, as a state store outside the worker."""

    def __init__(self, base):
        self.base, self.timers = base, set()

    def getValueState(self, name, schema):
        return _Variable(self.base / name)

    getListState = getValueState

    def getMapState(self, name, key, schema):
        return _Variable(self.base / name)

    def listTimers(self):
        return iter(self.timers)

    def registerTimer(self, t):
        self.timers.add(t)

    def deleteTimer(self, t):
        self.timers.discard(t)


class _Variable:
    def __init__(self, path):
        path.mkdir(parents=True)
        self.path = path

    def exists(self):
        return (self.path / "v").exists()

    def get(self):
        return pickle.loads((self.path / "v").read_bytes())

    def update(self, value):
        (self.path / "v").write_bytes(pickle.dumps(value))

    put = update

    def clear(self):
        (self.path / "v").unlink(missing_ok=True)

    def getValue(self, key):
        return pickle.loads((self.path / "_".join(map(str, key))).read_bytes())

    def updateValue(self, key, value):
        (self.path / "_".join(map(str, key))).write_bytes(pickle.dumps(value))

    def removeKey(self, key):
        (self.path / "_".join(map(str, key))).unlink()


class _Now:
    def __init__(self, ms):
        self.getCurrentWatermarkInMs = lambda: ms


def _drive(processor, names, base, batches):
    """Output rows after batches (watermark in ms, input rows), the most memory of a call and what is still stored."""
    processor.names = names
    handle = _Stored(base)
    processor.init(handle)
    out, most = [], 0
    for ms, rows in batches:
        tracemalloc.start()
        out += [tuple(r) for r in processor.handleInputRows(("k",), (Row(**r) for r in rows), _Now(ms))]
        most = max(most, tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    return out, most, len([*(base / "pieces").glob("*")]), handle.timers


@pytest.fixture
def small(monkeypatch):
    for name, n in (("SORTED", 400), ("PIECE", 50), ("RUNS", 3)):
        monkeypatch.setattr(timers, name, n, raising=False)


def test_a_worker_holds_a_part_of_a_key(small, tmp_path):
    n = 20_000
    rows = [(i * 1000, "ab"[i // 7 % 2]) for i in range(n)]
    random.Random(1).shuffle(rows)
    rows += rows[:500]  # and some twice
    inputs = ({"k": "k", "u": u, "v": v} for u, v in rows)
    names = ["k", "value", "start", "last", "samples", "ended", "next_value"]
    # all rows of the key wait, then come due in two steps, and a late one lengthens a run
    late = n // 2 + 3
    got, most, stored, wakes = _drive(timers._Epochs(), names, tmp_path, [(-1, inputs), (n // 2, []), (n // 2, [{"k": "k", "u": late * 1000 + 1, "v": "ab"[late // 7 % 2]}]), (n, [])])
    want = [("k", "ab"[i % 2], i * 7000, (i * 7 + 6) * 1000, 7 + (i == late // 7), (i + 1) * 7000, "ab"[(i + 1) % 2]) for i in range((n - 1) // 7)]
    if late % 7 == 6:
        want[late // 7] = (*want[late // 7][:3], late * 1000 + 1, *want[late // 7][4:])
    assert got == want and (stored, wakes) == (0, set())
    assert most < 1_500_000


def test_a_dead_man_keeps_what_bounds_silences(small, tmp_path):
    rnd, gap = random.Random(2), 50_000
    times = sorted({t for _ in range(40) for a in [rnd.randrange(20_000_000)] for t in rnd.sample(range(a, a + 90_000), 500)})
    us, end = rnd.sample(times, len(times)), 25_000_000
    want, last, seen = [], 0, False
    for u in [*times, None]:
        if (u or end + 1) > last + gap:
            want += [("k", "down", last + gap, last if seen else None)] + ([("k", "up", u, last if seen else None)] if u else [])
        last, seen = u, True
    first = [{"k": "k", "u": u, "since": None} for u in us[:9000]] + [{"k": "k", "u": None, "since": 0}]
    # the watermark stands between the samples of a stretch, later ones come after it
    at = times[len(times) // 2] // 1000
    more = [{"k": "k", "u": u, "since": None} for u in us[9000:] if u > at * 1000]
    early = [{"k": "k", "u": u, "since": None} for u in us[9000:] if u <= at * 1000]
    got, most, stored, _ = _drive(timers._DeadMan(gap), ["k", "event", "at", "last_seen"], tmp_path, [(0, (x for x in first + early)), (at, []), (at, more), (end // 1000, [])])
    assert got == want and len(want) > 40 and stored == 0
    assert most < 2_000_000
