from __future__ import annotations

import pytest
from helpers import T0, at, labelled
from pyspark.sql import functions as F

from fleetmetrics.alerts import routing as R
from fleetmetrics.alerts import state as S
from fleetmetrics.alerts.evaluate import evaluate
from fleetmetrics.alerts.rules import Rule, catalogue, register_rule
from fleetmetrics.operators.windows import Grid
from fleetmetrics.sources.literal import values

GRID = Grid.of("30s", at(30), at(300))


def sec(ts):
    return int((ts.replace(tzinfo=None) - T0).total_seconds())


def run(spark, samples, *rules, grid=GRID, lookback="30s"):
    return S.alert_states(evaluate(labelled(spark, samples), rules, grid, lookback), grid)


def test_fires_when_the_condition_has_lasted_exactly_as_long_as_required(spark):
    s = [("m", {"job": "a"}, t, 9) for t in range(30, 121, 30)]
    got = run(spark, s, Rule("A", "instant", "m", ">", 5, 60)).orderBy("t").collect()
    assert [(sec(r["t"]), r["alertstate"]) for r in got] == [(30, "pending"), (60, "pending"), (90, "firing"), (120, "firing")]


def test_one_miss_starts_over(spark):
    s = [("m", {}, t, 1 if t == 90 else 9) for t in range(30, 181, 30)]
    got = run(spark, s, Rule("A", "instant", "m", ">", 5, 60)).orderBy("t").collect()
    assert [(sec(r["t"]), r["alertstate"], sec(r["active_since"])) for r in got] == [(30, "pending", 30), (60, "pending", 30), (120, "pending", 120), (150, "pending", 120), (180, "firing", 120)]


def test_transitions(spark):
    s = [("m", {}, t, 9) for t in (30, 60, 90, 180, 210, 240, 270, 300)]
    got = S.transitions(run(spark, s, Rule("A", "instant", "m", ">", 5, 30)), GRID).orderBy("fired_at").collect()
    assert [(sec(r["fired_at"]), r["resolved_at"] and sec(r["resolved_at"])) for r in got] == [(60, 120), (210, None)]


def test_matchers_select_series(spark):
    s = [("up", {"exp_type": e, "job": e}, 30, 0) for e in ("pg", "node", "pgx")] + [("up", {}, 30, 0)]
    hits = evaluate(labelled(spark, s), [Rule("Down", "instant", "up", "<", 1, 0, matchers=(("exp_type", "=~", "pg|node"),)), Rule("NotPg", "instant", "up", "<", 1, 0, matchers=(("exp_type", "!=", "pg"),))], GRID, "30s")
    got = {(r["alertname"], r["labels"].get("job", "")) for r in hits.collect()}
    assert got == {("Down", "pg"), ("Down", "node"), ("NotPg", "node"), ("NotPg", "pgx"), ("NotPg", "")}


def test_inhibition_needs_equal_name_job_and_service(spark):
    rules = [Rule("A", "instant", "m", ">", 5, 0, "warning"), Rule("A", "instant", "m", ">", 8, 0, "critical"), Rule("B", "instant", "m", ">", 5, 0, "warning")]
    s = [("m", {"job": "x"}, 30, 9), ("m", {"job": "y"}, 30, 6)]
    left = R.inhibit(run(spark, s, *rules)).collect()
    assert {(r["alertname"], r["severity"], r["labels"]["job"]) for r in left} == {("A", "critical", "x"), ("B", "warning", "x"), ("A", "warning", "y"), ("B", "warning", "y")}


TREE = R.Route("all", routes=(R.Route("dba", match_re={"service": "pg|my"}, routes=(R.Route("pager", match={"severity": "critical"}),)), R.Route("late", match={"severity": "critical"})))


@pytest.mark.parametrize("service,severity,receiver", [("pg", "critical", "pager"), ("my", "warning", "dba"), ("pgx", "critical", "late"), ("os", "warning", "all")])
def test_routing_is_depth_first(spark, service, severity, receiver):
    df = values(spark, [(service, severity)], "service string, severity string")
    assert R.route(df, TREE).first()["receiver"] == receiver


def test_grouping_counts_without_collecting(spark):
    rows = [("critical", "s", "j", "A", at(0), f"k{i}", float(i)) for i in range(5)] + [("warning", "s", "j", "A", at(0), "z", 1.0)]
    df = values(spark, rows, "severity string, service string, job string, alertname string, t timestamp, series_key string, value double")
    got = {r["severity"]: (r["alerts"], r["first_member"], r["last_member"], r["top"]) for r in R.group_alerts(df).collect()}
    assert got == {"critical": (5, "k0", "k4", 4.0), "warning": (1, "z", "z", 1.0)}


def stretches(spark, *rows):
    data = [(g, k, at(a), None if b is None else at(b)) for g, k, a, b in rows]
    return values(spark, data, "g string, series_key string, fired_at timestamp, resolved_at timestamp")


def sent(df):
    return [(r["g"], sec(r["sent_at"]), r["reason"], r["firing"], r["new"], r["resolved"]) for r in df.orderBy("g", "sent_at").collect()]


def test_notification_times(spark):
    st = stretches(spark, ("g", "a", 0, None), ("g", "b", 20, None), ("g", "c", 40, 200))
    got = sent(R.notifications(st, ["g"], until=F.lit(at(1000)).cast("timestamp")))
    # wait 30 s, then flushes every 5 minutes; c came and went before the next flush
    assert got == [("g", 30, "change", 2, 2, 0)]


def test_resolution_and_a_new_life(spark):
    st = stretches(spark, ("g", "a", 0, 100), ("g", "a", 5000, 5700))
    got = sent(R.notifications(st, ["g"], until=F.lit(at(9000)).cast("timestamp")))
    assert got == [("g", 30, "change", 1, 1, 0), ("g", 330, "change", 0, 0, 1), ("g", 5030, "change", 1, 1, 0), ("g", 5930, "change", 0, 0, 1)]


def test_repeats_until_something_changes(spark):
    st = stretches(spark, ("g", "a", 0, 3 * 86400), ("h", "b", 0, None))
    got = sent(R.notifications(st, ["g"], until=F.lit(at(4 * 86400)).cast("timestamp")).where("g = 'g'"))
    assert [(x[1], x[2]) for x in got] == [(30, "change"), (30 + 86400, "repeat"), (30 + 2 * 86400, "repeat"), (3 * 86400 + 30, "change")]
    only = sent(R.notifications(st, ["g"], send_resolved=False, until=F.lit(at(86400)).cast("timestamp")))
    assert {(x[0], x[2]) for x in only} == {("g", "change"), ("h", "change")}


def test_severity_counts_default_to_zero(spark):
    none = run(spark, [("m", {}, 30, 1)], Rule("A", "instant", "m", ">", 5, 0))
    assert {r["severity"]: r["count"] for r in S.severity_counts(none).collect()} == {"critical": 0, "warning": 0, "info": 0}


def test_user_rules_join_the_catalogue(spark):
    from fleetmetrics.alerts import rules

    r = register_rule(Rule("Mine", "instant", "m", ">", 5, 0))
    try:
        assert r in catalogue("host")
    finally:
        rules._REGISTERED.remove(r)


def test_annotations(spark):
    st = run(spark, [("m", {"job": "x"}, 30, 9)], Rule("A", "instant", "m", ">", 5, 0))
    assert S.annotate(st).first()["summary"] == "x (instance: ): A, value ( 9.0 )"


# --- the whole rule set: a healthy fleet raises nothing, each seeded violation raises its rule ----

BIG = Grid.of("60s", at(3600), at(7200))
BASE = {"job": "j", "instance": "i"}



def _points(rule, bad):
    labels = dict(BASE)
    for name, op, value in rule.matchers:
        labels[name] = {"=": value, "=~": value.split("|")[0].replace("[234]", "4"), "!~": "sda"}.get(op, "x")
    for name in rule.by:
        labels.setdefault(name, "g")
    ticks = range(0, 7201, 30)
    ok = {">": rule.threshold - 1, "<": rule.threshold + 1, "!=": rule.threshold, "==": rule.threshold + 1, ">=": rule.threshold}[rule.op] if rule.op != "any" else 1
    wrong = {">": rule.threshold + 1, "<": rule.threshold - 1, "!=": rule.threshold + 1, "==": rule.threshold, ">=": rule.threshold}[rule.op] if rule.op != "any" else 2
    v = wrong if bad else ok
    k = rule.kind
    if k in ("instant", "max_by", "avg_over_time"):
        return [(rule.metric, labels, t, v) for t in ticks]
    if k == "age":
        return [(rule.metric, labels, t, T0_EPOCH + t - v) for t in ticks]
    if k in ("ratio_pct", "free_pct", "sum_free_pct"):
        pct = v if k == "ratio_pct" else 100 - v
        return [p for t in ticks for p in ((rule.metric, labels, t, pct), (rule.metric2, labels, t, 100))]
    if k == "and_min":
        return [p for t in ticks for p in ((rule.metric, labels, t, 170000), (rule.metric2, {**labels, "dbname": "d"}, t, v))]
    if k == "max_both":
        return [p for t in ticks for p in ((rule.metric, labels, t, v), (rule.metric2, labels, t, v))]
    if k in ("count_by", "odd_count"):
        n = {"odd_count": 2 if bad else 3, "count_by": 2 if bad else 3}[k]
        return [(rule.metric, {**labels, "instance": f"i{i}"}, t, 1) for t in ticks for i in range(n)]
    if k == "load":
        cpus = [(rule.metric2, {**BASE, "cpu": str(c), "mode": m}, t, t) for t in ticks for c in range(2) for m in ("idle", "user")]
        return cpus + [(rule.metric, BASE, t, 2 * v) for t in ticks]
    if k == "changes":
        return [(rule.metric, labels, t, t // 60 if bad else 1) for t in ticks]
    if k in ("changed", "delta", "role_change"):
        jump = {"changed": 1, "delta": 6, "role_change": 1}[k] if bad else 0
        width = {"5m": 300, "60m": 3600}[rule.window]
        return [(rule.metric, labels, t, 1 + jump * (t // width if k == "delta" else (t // width) % 2)) for t in ticks]
    if k == "forecast":
        slope = 1.0 if bad else 0.0
        return [p for t in ticks for p in ((rule.metric, labels, t, 8000 - slope * t), *([(rule.metric2, labels, t, 100000)] if rule.metric2 else []))]
    if k == "absent":
        return [] if bad else [(rule.metric, labels, t, 1) for t in ticks]
    raise AssertionError(k)


T0_EPOCH = 1704067200
ALL = [(p, r) for p in ("host", "container") for r in catalogue(p, include_disabled=True)]


@pytest.mark.parametrize("pack", ["host", "container"])
def test_every_rule_of_the_set(spark, pack):
    """One evaluation of the whole set per side: nothing fires on good data, everything on bad data.

    Rules that share a metric would disturb each other, so every rule reads metrics of its own.
    """
    import dataclasses

    rules, good, bad = [], [], []
    for i, rule in enumerate(catalogue(pack, include_disabled=True)):
        own = dataclasses.replace(rule, alert=f"{i}:{rule.alert}", metric=f"m{i}_a", metric2=f"m{i}_b" if rule.metric2 else "")
        rules.append(own)
        good += _points(own, False)
        bad += _points(own, True)
    schema = "metric string, labels map<string,string>, s double, value double"

    def fired(points):
        raw = spark.createDataFrame([(m, ls, float(t), float(v)) for m, ls, t, v in points], schema)
        samples = raw.select("metric", "labels", F.timestamp_micros((F.lit(T0_EPOCH * 10**6) + F.col("s") * 10**6).cast("bigint")).alias("ts"), "value")
        st = S.alert_states(evaluate(samples, rules, BIG, "5m"), BIG)
        return {r["alertname"] for r in st.where("alertstate = 'firing'").select("alertname").distinct().collect()}

    assert fired(good) == set()
    assert fired(bad) == {r.alert for r in rules}


def test_rule_set_size():
    names = {r.alert for _, r in ALL}
    assert len([1 for p, r in ALL if p == "host"]) == 67 and len([1 for p, r in ALL if p == "container"]) == 33 and "PGIsUp" in names
    by_name = {(r.alert, r.severity): r for _, r in ALL}
    assert by_name[("PatroniPendingRestart", "warning")].severity_num == 300 and by_name[("PatroniRapidTimelineSwitch", "critical")].severity_num == 200
