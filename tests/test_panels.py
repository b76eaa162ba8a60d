from __future__ import annotations

import random

import pytest
from helpers import at, labelled

from fleetmetrics.operators.windows import Grid
from fleetmetrics.reports.panels import PANELS, VARIABLES, evaluate_panel, range_report, report, variable

GRID = Grid.of("60s", at(120), at(120))
IDS = {"job": "j", "instance": "i"}


def one(df):
    rows = df.collect()
    assert len(rows) == 1, rows
    return rows[0]["value"]


def pair(name, a, b, **labels):
    p = PANELS[name]
    ls = {**IDS, **labels}
    return [(p.metric, ls, 110, a), (p.metric2, ls, 110, b)]


@pytest.mark.parametrize(
    "name,a,b,want",
    [
        ("filesystem/used_pct", 25, 100, 75.0), ("filesystem/used", 100, 25, 75.0), ("os/mem_available", 25, 100, 0.25), ("os/swap_used_ratio", 25, 100, 0.75),
        ("os/filesystem_by_device", 25, 100, 75.0), ("bloat/total_pct", 5, 50, 10.0), ("container_overview/state", 2, 3, 203.0), ("pod/disk_used", 25, 100, 75.0),
        ("pod/mem_free", 10, 30, 0.0), ("pod/cpu_quota", 50, 100, 50.0), ("overview/state", 1, 2, 0.5), ("network/conntrack_free", 10, 4, 6.0),
    ],
)
def test_pairs(spark, name, a, b, want):
    extra = {"exp_type": "pg"} if name == "overview/state" else {}
    assert one(report(labelled(spark, pair(name, a, b, **extra)), name, GRID)) == pytest.approx(want)


def test_cpu_usage_is_a_ratio_of_last_differences(spark):
    p = PANELS["pod/cpu_usage"]
    s = [(p.metric, IDS, 100, 0), (p.metric, IDS, 115, 3e9), (p.metric2, IDS, 100, 1000), (p.metric2, IDS, 115, 1015)]
    assert one(report(labelled(spark, s), "pod/cpu_usage", GRID)) == pytest.approx(20.0)


def test_age_and_primary_filter(spark):
    role = "ccp_is_in_recovery_status"
    s = [("ccp_backrest_oldest_full_backup_time_seconds", {**IDS, "instance": i, "stanza": "main", "repo": "1"}, 110, 1704067200 + 20) for i in ("p", "r")]
    s += [(role, {**IDS, "instance": "p"}, 110, 2), (role, {**IDS, "instance": "r"}, 110, 1)]
    assert one(report(labelled(spark, s), "backups/recovery_window", GRID, stanza="main")) == 100.0


def test_variables_filter_panels(spark):
    s = [("node_load5", {"job": j}, 110, v) for j, v in (("a", 1), ("b", 2), ("ab", 3))]
    got = {r["value"] for r in report(labelled(spark, s), "os/load5", GRID, job="a|b").collect()}
    assert got == {1.0, 2.0}


def test_groups_and_thresholds(spark):
    s = [("pg_up", {"kubernetes_namespace": n, "pod": str(i)}, 110, 1) for i, n in enumerate("aab")]
    assert one(report(labelled(spark, s), "alerts/namespaces", GRID)) == 2.0 and one(report(labelled(spark, s), "alerts/instances", GRID)) == 3.0
    w = [("ccp_bloat_check_total_wasted_space_bytes", {"objectname": o}, 110, v) for o, v in (("x", 10240), ("y", 10241))]
    assert one(report(labelled(spark, w), "bloat/top", GRID)) == 10241.0


def test_counter_panels(spark):
    s = [("node_netstat_Tcp_ActiveOpens", {"job": j}, t, t) for j in "ab" for t in (60, 90, 120)]
    assert one(report(labelled(spark, s), "network/tcp_ActiveOpens", GRID)) == pytest.approx(2.0)
    c = [("node_disk_sectors_read", IDS, t, t) for t in (90, 120)]
    assert one(report(labelled(spark, c), "filesystem/sectors_read", GRID)) == pytest.approx(512.0)


def test_statements_over_the_dashboard_range(spark):
    s = [("ccp_pg_stat_statements_total_calls_count", {"dbname": d, "exported_role": "r", "pg_cluster": "c"}, t, 1) for d in "ab" for t in (10, 3000, 7200)]
    v = range_report(labelled(spark, s), "container_statements/executed", at(7200), "2h", cluster="c")
    assert one(v) == 6.0
    assert one(range_report(labelled(spark, s), "container_statements/executed", at(7211), "2h", cluster="c")) == 4.0


def test_dashboard_variables(spark):
    s = [("up", {"exp_type": e, "job": j, "cluster_name": c}, 0, 1) for e, j, c in (("pg", "p1", "c1"), ("pg", "p2", "c2"), ("node", "n1", "c1"))]
    df = labelled(spark, s)
    assert [r[0] for r in variable(df, "pgnodes").collect()] == ["p1", "p2"]
    assert [r[0] for r in variable(df, "pgnodes", cluster_name="c2").collect()] == ["p2"]
    assert [r[0] for r in variable(df, "osnodes").collect()] == ["n1"]


def test_every_panel_shape_and_variable_builds(spark):
    """One panel for each combination of function, form and grouping; names do not change the plan."""
    df = labelled(spark, [("m", {"job": "j"}, 0, 1)])
    shapes = {}
    for name, p in PANELS.items():
        shapes.setdefault((p.fn, p.form, p.agg, p.agg_first, bool(p.by), bool(p.without), p.primary_only, p.clamp, p.above), name)
    for name in shapes.values():
        p = PANELS[name]
        picked = {arg: "x" for arg, _, _ in p.vars}
        out = range_report(df, name, at(7200), "2h", **picked) if name.startswith("container_statements/") else evaluate_panel(df, p, GRID, "5m", **picked)
        assert out.columns == ["series_key", "t", "value"], name
    for name in VARIABLES:
        assert len(variable(df, name).columns) == 1


def test_every_metric_read_is_emitted_by_a_block_or_an_exporter():
    """Table sizes once had another name than the panel asks for."""
    from fleetmetrics.jobs.catalog import BLOCKS, PREFIX
    from fleetmetrics.reports.panels import PANELS

    block = BLOCKS["table_size"]
    emitted = {f"{PREFIX}table_size_{v}" for v in block.values}
    assert {p.metric for n, p in PANELS.items() if n.startswith("table_size/")} <= emitted


def test_a_dashboard_equals_its_panels(spark):
    from fleetmetrics.reports import dashboard as D
    from fleetmetrics.reports.panels import Panel

    rnd = random.Random(6)
    rows = [(m, {"host": h, "job": j}, s, float(rnd.randint(0, 50))) for m in ("a", "b") for h, j in (("x", "1"), ("y", "1"), ("z", "2")) for s in range(5, 1800, rnd.choice([30, 47]))]
    samples = labelled(spark, rows)
    grid = Grid.of("2m", at(240), at(1800))
    panels = {
        "one": Panel("a"), "pair": Panel("a", metric2="b", form="pct"), "rate": Panel("a", "rate", "4m", agg="sum", by=("job",)), "irate": Panel("b", "irate", "4m", matchers=(("host", "!~", "x|q"),)),
        "idelta": Panel("a", "idelta", "4m"), "changes": Panel("b", "changes", "4m", agg="max"), "increase": Panel("b", "increase", "6m"), "avg": Panel("a", "avg_over_time", "4m", vars=(("job", "job", "="),)),
        "min": Panel("b", "min_over_time", "4m", without=("host",), agg="min"),
    }
    assert D.groups(panels) == {("plain", 300_000_000): ["one", "pair"], ("ordered", 240_000_000): ["rate", "irate", "idelta", "changes"], ("ordered", 360_000_000): ["increase"], ("plain", 240_000_000): ["avg", "min"]}
    got = {}
    for r in D.dashboard(samples, panels, grid, job="1").collect():
        got.setdefault(r.panel, {})[r.series_key, r.t] = r.value
    for name, p in panels.items():
        want = {(r.series_key, r.t): r.value for r in evaluate_panel(samples, p, grid, job="1").collect()}
        assert got[name] == pytest.approx(want) and want, name
