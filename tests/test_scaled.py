"""Routing tables, pyramids and detected changes against plainer versions."""

from __future__ import annotations

import random

import pytest
from helpers import at, series
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fleetmetrics import refresh
from fleetmetrics.alerts import route_table as RT
from fleetmetrics.alerts.routing import Route, route
from fleetmetrics.operators import windows as W
from fleetmetrics.operators.pyramid import Pyramid
from fleetmetrics.sources.literal import values

LABELS = ["a", "b", "c"]


def tree(rnd, depth=0, name="r"):
    match = {k: rnd.choice(["x", "y", ""]) for k in rnd.sample(LABELS, rnd.choice([0, 1, 1, 2]))} if depth else {}
    match_re = {rnd.choice(LABELS): rnd.choice(["x|y", ".*", "z.*", "[^x]*"])} if depth and rnd.random() < 0.3 else {}
    kids = tuple(tree(rnd, depth + 1, f"{name}.{i}") for i in range(rnd.choice([0, 2, 3]) if depth < 3 else 0))
    return Route(name, match, match_re, kids)


@pytest.mark.parametrize("seed", [1, 2])
def test_route_table_equals_the_expression(spark, seed):
    rnd = random.Random(seed)
    t = Route("root", routes=tuple(tree(rnd, 1, f"r{i}") for i in range(6)))
    alerts = values(spark, [tuple(rnd.choice(["x", "y", "z", "zz", "", None]) for _ in LABELS) for _ in range(200)], "a string, b string, c string")
    want = route(alerts, t)
    got = RT.route(alerts, *RT.route_tables(spark, t), LABELS)
    cols = [*LABELS, "receiver"]
    assert got.select(cols).exceptAll(want.select(cols)).isEmpty() and got.count() == 200
    assert got.select("receiver").distinct().count() > 3


@given(st.integers(-500, 500), st.integers(0, 900), st.integers(1, 20), st.integers(1, 4), st.integers(2, 5))
def test_a_cover_is_exact_and_short(start, span, base, levels, fan):
    p = Pyramid("", base, levels, fan)
    cells, raw = p.cover(start, start + span)
    ticks = [u for a, b in raw for u in range(a + 1, b + 1)]
    for level, first, last in cells:
        ticks += range((first - 1) * p.size(level) + 1, last * p.size(level) + 1)
    assert sorted(ticks) == list(range(start + 1, start + span + 1))
    assert sum(b - a for a, b in raw) < 2 * base
    most = 2 * (fan - 1) * levels + span // p.size(levels - 1)  # the last level takes what is left
    assert p.cells(start, start + span) <= most


def test_a_pyramid_window_equals_the_operator(spark, tmp_path):
    rnd = random.Random(4)
    samples = series(spark, {k: [(rnd.randint(0, 9000), rnd.randint(-5, 5)) for _ in range(1)] + [(s, rnd.randint(-5, 5)) for s in range(1, 9000, rnd.choice([37, 53]))] for k in "ab"})
    p = Pyramid(str(tmp_path), 60_000_000, 3)
    p.build(samples)
    for end, span in ((8111, 7000), (3600, 3600), (777, 30), (9000, 90)):
        fns = ["sum", "count", "min", "max"]
        want = W.over_time(samples, W.Grid.of("1s", at(end), at(end)), f"{span}s", fns).drop("t")
        got = p.window(spark, samples, at(end), f"{span}s", fns)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())), (end, span)


def test_fingerprints_follow_rows_and_nothing_else(spark, tmp_path):
    schema = "p string, k int, v string, m map<string,int>"
    rows = [("a", 1, "x", {"q": 1, "r": 2}), ("a", 1, "x", {"q": 1, "r": 2}), ("b", 2, None, None), ("c", None, "", {}), ("d", 4, "y", None)]

    def prints(some):
        return refresh.fingerprints(spark.createDataFrame(some, schema).repartition(3), "p")

    def changes(some):
        return {r.p: r.status for r in refresh.detect(prints(some), prints(rows), "p").collect()}

    moved = [("d", 4, "y", None), ("c", None, "", {}), ("a", 1, "x", {"r": 2, "q": 1}), ("b", 2, None, None), ("a", 1, "x", {"q": 1, "r": 2})]
    assert changes(moved) == {}
    assert changes([*rows[1:4], ("b", None, "2", None), ("e", 1, "", None)]) == {"a": "changed", "b": "changed", "d": "vanished", "e": "new"}
    assert changes([*rows[:2], ("b", None, "2", None), ("c", None, None, {}), rows[4]]) == {"b": "changed", "c": "changed"}


def test_a_detected_refresh_can_be_repeated(spark, tmp_path):
    def table(rows):
        return values(spark, rows, "p string, v int")

    def run(rows):
        found = refresh.refresh_detected(spark, table(rows), f"{tmp_path}/t", "p", f"{tmp_path}/m", lambda d: d.groupBy("p").agg(F.sum("v").alias("v")))
        return {r.p: r.status for r in found.collect()}, {r.p: r.v for r in spark.read.schema("v long, p string").parquet(f"{tmp_path}/t").collect()}

    assert run([("a", 1), ("a", 2), ("b", 5)]) == ({"a": "new", "b": "new"}, {"a": 3, "b": 5})
    # a run that died before its manifest was finished left an unfinished version
    spark.range(1).write.parquet(f"{tmp_path}/m/version=1/half")
    assert run([("a", 2), ("a", 1)]) == ({"b": "vanished"}, {"a": 3})
    assert run([("a", 2), ("a", 1), ("c", 0)])[1] == {"a": 3, "c": 0}
