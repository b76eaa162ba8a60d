"""Edge cases of instant and range vectors, against hand-computed values and plain Python."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F
from helpers import at, by_time, series

from fleetmetrics.operators import windows as W

GRID = W.Grid.of("60s", at(60), at(600))


def test_window_is_open_at_the_start_and_closed_at_the_end(spark):
    s = series(spark, {"a": [(60, 1), (120, 2)]})
    got = by_time(W.over_time(s, GRID, "60s", ["sum"]), value="sum")
    assert got == {("a", 60): 1.0, ("a", 120): 2.0}


def test_lookback_expires(spark):
    got = by_time(W.instant(series(spark, {"a": [(10, 5)]}), GRID, "2m"))
    assert got == {("a", 60): 5.0, ("a", 120): 5.0}


def test_sample_exactly_on_the_far_edge_is_out(spark):
    s = series(spark, {"a": [(60, 5), (200, 7)]})
    got = by_time(W.instant(s, GRID, "2m"))
    assert got[("a", 120)] == 5.0 and ("a", 180) not in got and got[("a", 240)] == 7.0


def test_offset_pairs(spark):
    now = W.instant(series(spark, {"a": [(60, 1), (180, 2)]}), GRID, "1m")
    got = W.with_offset(now, GRID, "2m").collect()
    assert [(r["value"], r["before"]) for r in got] == [(2.0, 1.0)]


def test_offset_must_fit_the_step(spark):
    with pytest.raises(ValueError):
        W.with_offset(series(spark, {"a": [(0, 1)]}), GRID, "90s")


def test_offset_argument_shifts_samples(spark):
    s = series(spark, {"a": [(60, 1)]})
    assert by_time(W.instant(s, GRID, "60s", offset="2m")) == {("a", 180): 1.0}


def test_counter_reset_counts_the_new_value(spark):
    s = series(spark, {"a": [(70, 10), (100, 15), (110, 3), (120, 8)]})
    got = by_time(W.increase(s, GRID, "60s", extrapolate=False))
    assert got == {("a", 120): 5 + 3 + 5}


def test_reset_between_buckets(spark):
    s = series(spark, {"a": [(70, 10), (130, 4), (190, 6)]})
    got = by_time(W.increase(s, GRID, "3m", extrapolate=False))
    assert got[("a", 180)] == 4.0 and got[("a", 240)] == 6.0
    # the first sample of the window never counts, reset or not
    assert got[("a", 300)] == 2.0


def test_one_sample_gives_nothing(spark):
    s = series(spark, {"a": [(70, 10)]})
    for fn in (W.increase, W.rate, W.irate, W.idelta):
        assert by_time(fn(s, GRID, "60s")) == {}


def test_idelta_ignores_resets_and_irate_does_not(spark):
    s = series(spark, {"a": [(70, 10), (100, 15), (110, 3)]})
    assert by_time(W.idelta(s, GRID, "60s")) == {("a", 120): -12.0}
    assert by_time(W.irate(s, GRID, "60s")) == {("a", 120): 0.3}


def test_last_two_must_both_be_inside(spark):
    s = series(spark, {"a": [(50, 1), (110, 4), (200, 9)]})
    assert by_time(W.irate(s, GRID, "60s")) == {}
    assert by_time(W.idelta(s, GRID, "2m")) == {("a", 120): 3.0}


def test_changes(spark):
    s = series(spark, {"a": [(61, 1), (70, 1), (80, 2), (90, 2), (100, 1)], "b": [(61, 3)]})
    assert by_time(W.changes(s, GRID, "60s")) == {("a", 120): 2.0, ("b", 120): 0.0}


def test_extrapolation_to_the_edges(spark):
    # samples every 15 s fill the window up to less than one distance from both edges
    s = series(spark, {"a": [(65 + 15 * i, 100 + i) for i in range(4)]})  # 65, 80, 95, 110
    got = by_time(W.increase(s, GRID, "60s"))[("a", 120)]
    assert got == pytest.approx(3 * (45 + 5 + 10) / 45)


def test_extrapolation_stops_halfway_over_large_gaps_and_at_zero(spark):
    s = series(spark, {"far": [(90, 50), (100, 60)], "zero": [(62, 1), (117, 12)]})
    got = by_time(W.increase(s, GRID, "60s"))
    assert got[("far", 120)] == pytest.approx(10 * (10 + 5 + 5) / 10)
    # "zero" would reach 0 five seconds before its first sample, but the edge is nearer
    assert got[("zero", 120)] == pytest.approx(11 * (55 + 2 + 3) / 55)


def test_rate_is_increase_per_second(spark):
    s = series(spark, {"a": [(65 + 15 * i, 100 + i) for i in range(4)]})
    assert by_time(W.rate(s, GRID, "60s"))[("a", 120)] == pytest.approx(by_time(W.increase(s, GRID, "60s"))[("a", 120)] / 60)


def test_predict_linear(spark):
    s = series(spark, {"a": [(60 + 10 * i, 1000 - 2 * 10 * i) for i in range(1, 7)], "one": [(70, 5)]})
    got = by_time(W.predict_linear(s, GRID, "60s", "5m"))
    assert got.keys() == {("a", 120)} and got[("a", 120)] == pytest.approx(1000 - 2 * 60 - 2 * 300)


def _brute(points, t, w, fn):
    win = sorted(p for p in points if t - w < p[0] <= t)
    if fn in ("sum", "max"):
        return {"sum": sum, "max": max}[fn](v for _, v in win) if win else None
    if fn == "changes":
        return float(sum(a[1] != b[1] for a, b in zip(win, win[1:]))) if win else None
    if len(win) < 2:
        return None
    if fn == "increase":
        return sum(b[1] if b[1] < a[1] else b[1] - a[1] for a, b in zip(win, win[1:]))
    return win[-1][1] - win[-2][1]


@pytest.mark.parametrize("window,chunk", [("3m", "5m"), ("90s", "30s"), ("7m", "1m"), ("59s", "5m"), ("61s", "30s"), ("150s", "30s"), ("481s", "1m"), ("12m", "5m"), ("60s", "7s")])
def test_against_brute_force(spark, window, chunk):
    """Random counters with resets, gaps, repeats and samples on the very edges, for any window."""
    rng = random.Random(7)
    points = {}
    for name in "abcde":
        ts = sorted(rng.sample(range(0, 1200, 5), 60) + [60 * i for i in range(1, 4)])
        v, ps = 0, []
        for t in sorted(set(ts)):
            v = 0 if rng.random() < 0.1 else v + rng.choice([0, 0, 1, 7])
            ps.append((t, v))
        points[name] = ps
    grid = W.Grid.of("60s", at(60), at(1500))
    s = series(spark, points)
    w = W.micros(window) / 1e6
    kw = {"chunk": chunk}
    got = {
        "increase": by_time(W.increase(s, grid, window, extrapolate=False, **kw)), "idelta": by_time(W.idelta(s, grid, window, **kw)),
        "changes": by_time(W.changes(s, grid, window, **kw)), "sum": by_time(W.over_time(s, grid, window, ["sum"]), value="sum"),
        "max": by_time(W.over_time(s, grid, window, ["max"]), value="max"),
    }
    for fn, have in got.items():
        want = {(k, t): _brute(ps, t, w, fn) for k, ps in points.items() for t in range(60, 1501, 60)}
        assert have == {k: v for k, v in want.items() if v is not None}, fn


@pytest.mark.parametrize("window", ["5m", "7m", "60s", "61s", "333s"])
def test_predict_linear_against_least_squares(spark, window):
    points = {"a": [(7 * i + (i % 3), (i * 37) % 41) for i in range(1, 120)], "b": [(100, 4), (400, 9), (401, 3)]}
    got = by_time(W.predict_linear(series(spark, points), W.Grid.of("60s", at(60), at(1200)), window, "10m"))
    w, want = W.micros(window) / 1e6, {}
    for k, ps in points.items():
        for t in range(60, 1201, 60):
            win = [(u - t, v) for u, v in ps if t - w < u <= t]
            mx, my = (sum(p[i] for p in win) / max(1, len(win)) for i in (0, 1))
            var = sum((x - mx) ** 2 for x, _ in win)
            if len(win) > 1 and var:
                want[k, t] = my + sum((x - mx) * (y - my) for x, y in win) / var * (600 - mx)
    assert got == pytest.approx(want)


@pytest.mark.parametrize("window", ["1d", "86401s"])
def test_uneven_windows_make_few_buckets(spark, window):
    """Whatever window and step are, a step has two buckets at most."""
    cuts = W.Cuts(600 * 10**6, W.micros(window))
    u = spark.range(0, 86400, 7).select((F.col("id") * 10**6).alias("u"))
    x = u.select(cuts.index(F.col("u")).alias("x"), "u").withColumn("e", cuts.end(F.col("x")))
    assert x.select("x").distinct().count() <= 2 * 145 and x.where("u > e").count() == 0
    assert cuts.length <= 2 * 144 + 1


def test_long_windows_are_doubled(spark):
    """A day-long window on a one-minute grid merges in a few levels, not in 1440 copies."""
    s = series(spark, {"a": [(i * 600, 1) for i in range(1, 200)]})
    v = W.over_time(s, W.Grid.of("60s", at(86400), at(2 * 86400)), "1d", ["sum", "count", "last"])
    plan = v._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence(" not in plan and plan.count("Aggregate") >= 11
    got = by_time(v, value="sum")
    assert got[("a", 86400)] == 144.0 and got[("a", 86400 + 60)] == 144.0 and got[("a", 2 * 86400)] == 199 - 144


def test_increase_never_negative_and_equals_rate_times_window(spark):
    s = series(spark, {"a": [(i * 7, (i * 13) % 29) for i in range(1, 80)]})
    inc, rate = by_time(W.increase(s, GRID, "2m")), by_time(W.rate(s, GRID, "2m"))
    assert inc and all(v >= 0 for v in inc.values())
    assert all(inc[k] == pytest.approx(rate[k] * 120) for k in inc)


def test_sum_by_equals_sum_of_sums(spark):
    from pyspark.sql import functions as F

    s = series(spark, {"a": [(61, 1), (70, 2)], "b": [(61, 5)]})
    per = W.over_time(s, GRID, "60s", ["sum"]).groupBy("t").agg(F.sum("sum").alias("x")).collect()
    assert [r["x"] for r in per] == [8.0]


def test_dedupe(spark):
    s = series(spark, {"a": [(61, 1), (61, 4), (62, 2)]})
    assert sorted(r["value"] for r in W.dedupe(s).collect()) == [2.0, 4.0]


def test_a_hot_series_is_cut_into_chunks(spark):
    """The sort of raw samples runs per (series, chunk), never per series."""
    plan = W.increase(series(spark, {"a": [(61, 1)]}), GRID, "5m")._jdf.queryExecution().optimizedPlan().toString()
    first = [line for line in plan.splitlines() if "Window" in line and "_u" in line]
    assert first and all("_b" in line.split("], [")[-2] or "_b" in line for line in first)
