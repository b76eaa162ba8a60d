"""Streams over several files, with late and repeated data, against their batch twins."""

from __future__ import annotations

import pytest
from helpers import at, by_time, series
from pyspark.sql import functions as F

from fleetmetrics.operators import windows as W
from fleetmetrics.sources.literal import values
from fleetmetrics.streaming import ingest, rollup, stateful

SCHEMA = "series_key string, ts timestamp, value double"
GRID = W.Grid.of("60s", at(60), at(600))


def stream_of(spark, path, parts, name="in"):
    """A file stream that takes one part per micro-batch, in order."""
    import time

    folder = f"{path}/{name}"
    for df in parts:
        df.coalesce(1).write.mode("append").parquet(folder)
        time.sleep(1.1)  # file order follows modification time
    return spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_dedupe_across_batches(spark, tmp_path):
    a = series(spark, {"a": [(10, 1), (10, 1), (20, 2)]})
    b = series(spark, {"a": [(20, 2), (30, 3)]})
    out = ingest.run_to_table(ingest.dedupe(stream_of(spark, tmp_path, [a, b])), "d")
    assert sorted(r["value"] for r in out.collect()) == [1.0, 2.0, 3.0]


def test_window_stats_match_batch_and_drop_late_rows(spark, tmp_path):
    parts = [
        series(spark, {"a": [(60, 1), (61, 2), (130, 4)]}), series(spark, {"a": [(100, 3), (400, 8)]}),
        series(spark, {"a": [(1200, 1)]}), series(spark, {"a": [(30, 99), (1210, 1)]}),  # 30 s is far behind the watermark by now
    ]
    s = stream_of(spark, tmp_path, parts)
    out = ingest.run_to_table(ingest.window_stats(s, size="2 minutes", slide="1 minute", delay="1 minute"), "w")
    got = by_time(out, value="sum")
    on_time = parts[0].unionByName(parts[1])
    want = by_time(W.over_time(on_time, W.Grid.of("60s", at(60), at(900)), "2m", ["sum"]), value="sum")
    assert got == want


def test_counter_rollup_equals_batch(spark, tmp_path):
    full = {"a": [(65, 10), (100, 15), (130, 3), (190, 9), (250, 9), (420, 1)], "b": [(61, 5), (600, 2)]}
    # out of order between batches, one sample repeated
    parts = [
        series(spark, {"a": [(65, 10), (130, 3)], "b": [(61, 5)]}), series(spark, {"a": [(100, 15), (130, 3), (190, 9)]}),
        series(spark, {"a": [(250, 9), (420, 1)], "b": [(600, 2)]}), series(spark, {"end": [(5000, 1)]}),
    ]
    states = rollup.rollup_counters(stream_of(spark, tmp_path, parts), "60s", delay="3m", path=str(tmp_path / "base"))
    for window in ("60s", "3m", "5m"):
        want = by_time(W.increase(series(spark, full), GRID, window))
        got = by_time(rollup.increase_from_states(states, "60s", GRID, window).where("series_key <> 'end'"))
        assert got == pytest.approx(want) and want
    with pytest.raises(ValueError):
        rollup.increase_from_states(states, "60s", GRID, "90s")


def test_sessions_match_batch(spark, tmp_path):
    pts = {"a": [(0, 1), (100, 1), (290, 1), (1000, 1), (1010, 1)], "b": [(5, 1)]}
    tail = series(spark, {"z": [(9000, 1)]})
    s = stream_of(spark, tmp_path, [series(spark, pts), tail])
    live = ingest.run_to_table(ingest.sessions(s, gap="200 seconds", delay="1 minute"), "s", conf=ingest.SESSION_CONF)
    batch = ingest.sessions_batch(series(spark, pts), gap="200s", chunk="2m")
    key = lambda df: sorted((r["series_key"], r["up_since"], r["last_seen"], r["absent_since"]) for r in df.collect())
    assert key(live) == key(batch) and len(key(live)) == 3


def evals(spark, rows):
    return values(spark, [(k, at(t), a) for k, t, a in rows], "series_key string, t timestamp, active boolean")


def test_alert_state_machine(spark, tmp_path):
    parts = [
        evals(spark, [("a", 0, True), ("a", 60, True), ("b", 0, True)]), evals(spark, [("a", 120, True), ("b", 60, False), ("a", 60, True)]),
        evals(spark, [("a", 180, False), ("b", 120, True), ("b", 180, True)]), evals(spark, [("c", 9000, False)]), evals(spark, [("c", 9060, False)]),
    ]
    out = ingest.run_to_table(stateful.alert_state_stream(stream_of(spark, tmp_path, parts), "60s", "60s", delay="2 minutes"), "a")
    got = sorted((r["series_key"], r["t"].minute * 60 + r["t"].second, r["alertstate"]) for r in out.collect())
    assert got == [
        ("a", 0, "pending"), ("a", 60, "firing"), ("a", 120, "firing"), ("a", 180, "resolved"),
        ("b", 0, "pending"), ("b", 120, "pending"), ("b", 180, "firing"), ("b", 240, "resolved"),  # b falls silent
    ]


def test_drift_stream_is_sticky(spark, tmp_path):
    rows = lambda *xs: values(spark, [("h", at(t), h) for t, h in xs], "host string, snapshot_ts timestamp, hash string")
    s = stream_of(spark, tmp_path, [rows((0, "x"), (1, "x")), rows((2, "y")), rows((3, "x"), (2, "q"))])
    out = ingest.run_to_table(stateful.drift_stream(s), "d").orderBy("snapshot_ts")
    assert [(r["hash"], r["changed"], r["status"]) for r in out.collect()] == [("x", 0, 0), ("x", 0, 0), ("y", 1, 1), ("x", 1, 1)]


def test_notifications_are_sent_once_across_batches(spark, tmp_path):
    from fleetmetrics.alerts import routing

    schema = "g string, series_key string, t timestamp, active_since timestamp, alertstate string"
    row = lambda k, t, s: ("g", k, at(t), at(0), s)
    parts = [
        values(spark, [row("a", 0, "pending"), row("a", 60, "firing")], schema), values(spark, [row("a", 120, "firing"), row("b", 400, "firing")], schema),
        values(spark, [row("a", 420, "resolved"), row("b", 700, "firing")], schema), values(spark, [row("b", 90000, "firing")], schema),
    ]
    log = stateful.notify_stream(stream_of(spark, tmp_path, parts), ["g"], path=str(tmp_path / "n"))
    st = values(spark, [("g", "a", at(60), at(420)), ("g", "b", at(400), None)], "g string, series_key string, fired_at timestamp, resolved_at timestamp")
    want = routing.notifications(st, ["g"], until=F.lit(at(90000)).cast("timestamp"))
    key = lambda df: sorted((r["sent_at"], r["reason"], r["firing"], r["new"], r["resolved"]) for r in df.collect())
    assert key(log) == key(want) and len(key(log)) == 3


def test_notifications_forget_closed_groups(spark, tmp_path):
    """Work per batch follows the open alerts: closed lives are left behind, and the log stays the same."""
    from fleetmetrics.alerts import routing

    schema = "g string, series_key string, t timestamp, active_since timestamp, alertstate string"
    row = lambda g, k, t, since, s: (g, k, at(t), at(since), s)
    parts = [values(spark, [row("g", "a", 10_000 * i + d, 10_000 * i, s) for d, s in ((0, "pending"), (60, "firing"), (400, "resolved"))] + [row("h", "b", 10_000 * i + 5, 0, "firing")], schema) for i in range(5)]
    log = stateful.notify_stream(stream_of(spark, tmp_path, parts), ["g"], path=str(tmp_path / "n"), late="1h")
    st = values(spark, [("g", "a", at(10_000 * i), at(10_000 * i + 60), at(10_000 * i + 400)) for i in range(5)] + [("h", "b", at(0), at(5), None)], "g string, series_key string, active_since timestamp, fired_at timestamp, resolved_at timestamp")
    # the newest instant each batch has seen ends its log
    want = routing.notifications(st, ["g"], until=F.lit(at(40_400)).cast("timestamp"))
    key = lambda df: sorted((r["g"], r["sent_at"], r["reason"], r["firing"], r["new"], r["resolved"]) for r in df.collect())
    assert key(log) == key(want) and len(key(log)) >= 6
    left = spark.read.parquet(str(tmp_path / "n" / "open")).where("batch = 4").collect()
    assert sorted((r["g"], str(r["fired_at"])) for r in left) == [("g", at(40_060)), ("h", at(5))]
    assert {p.name for p in (tmp_path / "n" / "open").iterdir()} == {"batch=3", "batch=4"} and {p.name for p in (tmp_path / "n" / "new").iterdir()} == {"batch=4"}


def test_silent_alerts_end_with_the_input(spark):
    schema = "series_key string, t timestamp, active_since timestamp, alertstate string"
    rows = [("a", at(60), at(0), "firing"), ("a", at(120), at(0), "firing"), ("b", at(60), at(0), "firing"), ("b", at(120), at(0), "resolved"), ("c", at(300), at(240), "firing"), ("d", at(60), at(60), "pending")]
    out = stateful.with_silent(values(spark, rows, schema), F.lit(at(300)).cast("timestamp"), "60s")
    assert sorted((r["series_key"], str(r["t"])) for r in out.where("alertstate = 'resolved'").collect()) == [("a", at(180)), ("b", at(120))]


def test_stored_samples_stream(spark, tmp_path):
    from helpers import labelled

    from fleetmetrics.sources import samples as smp

    path = str(tmp_path / "store")
    smp.write_samples(labelled(spark, [("m", {"job": "a"}, t, t) for t in (10, 20)] + [("n", {"job": "b"}, 86400 + 5, 7)]), path)
    out = ingest.run_to_table(smp.read_samples_stream(spark, path).select("metric", "ts", "value"), "copy")
    assert sorted((r["metric"], r["value"]) for r in out.collect()) == [("m", 10.0), ("m", 20.0), ("n", 7.0)]


def test_tables_of_one_file_and_of_many_stream_alike(spark, tmp_path):
    from fleetmetrics.sources.tables import table_stream

    df = series(spark, {"a": [(10 * i, i) for i in range(30)]})
    whole, split = tmp_path / "whole", tmp_path / "split"
    df.coalesce(1).write.parquet(str(tmp_path / "one"))
    whole.mkdir()
    next((tmp_path / "one").glob("part-*.parquet")).rename(whole / "events.parquet")
    df.repartition(5).write.parquet(str(split / "events.parquet"))
    for folder in (whole, split):
        for files in (None, 1):
            out = ingest.run_to_table(ingest.dedupe(table_stream(spark, str(folder), "events", files)), "t")
            assert out.count() == 30
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        table_stream(spark, str(whole), "orders")
