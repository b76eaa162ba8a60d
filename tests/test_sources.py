from __future__ import annotations

import pytest
from helpers import at, labelled
from pyspark.sql import functions as F

from fleetmetrics.model import label, normalize_columns, series_key, to_samples
from fleetmetrics.operators import aggregate as A
from fleetmetrics.operators import matching as J
from fleetmetrics.operators import selectors as S
from fleetmetrics.sources import exposition, json_reports, logs, samples as smp
from fleetmetrics.sources.literal import values


def test_exposition_lines(spark):
    lines = [
        "# HELP node_disk_queue_max depth", "# TYPE node_disk_queue_max gauge", 'node_disk_queue_max{device="vda"} 256', "node_up 1",
        'esc{a="x\\"y\\\\z",b="p\\nq"} 1.5e3 1704067200000', "inf_metric +Inf", "nan_metric NaN", "broken{", "also broken line here x y", "",
        'space_metric { a = "1" , b="2" }   7',
    ]
    df = spark.createDataFrame([(x,) for x in lines], "raw string")
    got = {r["metric"]: r for r in exposition.parse(df, scraped_at=F.lit(at(0)).cast("timestamp")).collect()}
    assert set(got) == {"node_disk_queue_max", "node_up", "esc", "inf_metric", "nan_metric", "space_metric"}
    assert got["node_disk_queue_max"]["labels"] == {"device": "vda"} and got["node_disk_queue_max"]["value"] == 256
    assert got["node_up"]["labels"] == {}
    assert got["esc"]["labels"] == {"a": 'x"y\\z', "b": "p\nq"} and got["esc"]["value"] == 1500
    assert got["inf_metric"]["value"] == float("inf") and got["space_metric"]["labels"] == {"a": "1", "b": "2"}


def test_exposition_round_trip(spark):
    df = values(spark, [("m", 'a"b\\c', 2.5)], "metric string, h string, value double")
    line = exposition.render(F.col("metric"), [("h", F.col("h"))], F.col("value"))
    got = exposition.parse(df.select(line.alias("raw"))).collect()[0]
    assert got["labels"] == {"h": 'a"b\\c'} and got["value"] == 2.5


def test_labels_and_series_key(spark):
    df = labelled(spark, [("m", {"b": "2", "a": "1", "c": ""}, 0, 1)])
    assert df.select(series_key(F.col("labels"))).first()[0] == '{"a":"1","b":"2"}'
    assert df.select(series_key(F.col("labels"), ["a"])).first()[0] == '{"b":"2"}'
    assert df.select(label(df, "nope")).first()[0] == ""


def test_matchers_are_anchored_and_missing_labels_are_empty(spark):
    df = labelled(spark, [("m", {"device": d}, 0, 1) for d in ("tmpfs", "xtmpfs", "by-uuid", "sda")] + [("m", {}, 0, 1)])

    def devices(*matchers):
        return sorted(r["labels"].get("device", "") for r in S.select(df, "m", matchers).collect())

    assert devices(("device", "!~", "tmpfs|by-uuid")) == ["", "sda", "xtmpfs"]
    assert devices(("device", "!~", ".*tmpfs.*|by-uuid")) == ["", "sda"]
    assert devices(("device", "=~", "s.a")) == ["sda"]
    assert devices(("device", "=", "")) == [""]
    assert devices(("device", "!=", "sda")) == ["", "by-uuid", "tmpfs", "xtmpfs"]


def test_matchers_reach_the_scan(spark, tmp_path):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    path = str(tmp_path / "s")
    smp.write_samples(labelled(spark, [("m", {"job": j}, 0, 1) for j in "abc"]), path, ["job"])
    df = smp.read_samples(spark, path, metrics=["m"], start=at(-10), end=at(10))
    plan = S.select(df, "m", [("job", "=~", "a|b")])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "In(job, [a,b])" in plan and "PartitionFilters: [isnotnull(date" in plan
    assert S.select(df, "m", [("job", "=~", "a|b")]).count() == 2


def test_to_samples_skips_null_measures(spark):
    df = values(spark, [("h1", at(0), "x", 1, None)], "host string, snapshot_ts timestamp, db string, a int, b int")
    got = to_samples(df, "p", ["a", "b"], ["db"]).collect()
    assert [(r["metric"], r["labels"], r["value"]) for r in got] == [("p_a", {"host": "h1", "db": "x"}, 1.0)]


def test_relabel(spark):
    df = labelled(spark, [("ccp_x", {"server": "s", "port": "9187", "ns": "n", "cl": "c"}, 0, 1), ("pg_settings_a", {"server": "s", "port": "1"}, 0, 1)])
    assert [r["metric"] for r in smp.drop_metrics(df, "(pg_locks_count.*|pg_settings.*)").collect()] == ["ccp_x"]
    cleared = {r["metric"]: r["labels"] for r in smp.replace_label(df, ["__name__", "server"], "ccp_.*;.+", "server", "").collect()}
    assert "server" not in cleared["ccp_x"] and cleared["pg_settings_a"]["server"] == "s"
    kept = smp.keep_where(df, "port", "9187")
    joined = smp.copy_labels(smp.join_labels(kept, ["ns", "cl"], "pg_cluster"), {"ns": "kubernetes_namespace"})
    assert joined.first()["labels"]["pg_cluster"] == "n:c" and joined.first()["labels"]["kubernetes_namespace"] == "n"
    assert smp.replace_label(df, ["server"], "(.)", "copy", "x$1").first()["labels"]["copy"] == "xs"


def test_target_labels(spark):
    df = labelled(spark, [("m", {"instance": "a", "job": "old"}, 0, 1), ("m", {"instance": "z"}, 0, 1)]).withColumn("instance", F.col("labels")["instance"])
    targets = values(spark, [("a", "Prod", "pg", "c1")], "instance string, job string, exp_type string, cluster_name string")
    got = {r["instance"]: r["labels"] for r in smp.add_target_labels(df, targets).collect()}
    assert got["a"] == {"instance": "a", "job": "Prod", "exp_type": "pg", "cluster_name": "c1"} and got["z"] == {"instance": "z"}


def test_retention_keeps_the_edge(spark):
    df = labelled(spark, [("m", {}, 86400 * d, d) for d in range(10)])
    assert sorted(r["value"] for r in smp.retain(df, 7).collect()) == list(range(2, 10))


def test_json_reports(spark):
    raw = [("etc/a.conf|[{\"name\":\"main\",\"system-id\":77}]",), ("b|[{\"x\":1}]",), ("no bar 77",), ("c|x|77",)]
    got = json_reports.split_reports(spark.createDataFrame(raw, "raw string"), "77").collect()
    assert [(r["config_file"], r["data"]) for r in got] == [("etc_a.conf", '[{"name":"main","system-id":77}]'), ("c", "x|77")]


LINE = "2024-01-01 00:00:07 UTC [10.0.0.1(5432)] [123]: [1-1] user=app,db=shop,e=00000 LOG:  duration: 12.3 ms  statement: select 1"


def test_log_parsing(spark):
    rows = [(LINE,), (LINE.replace("select 1", "select\n  'a''b', 42"),), ("garbage",), (LINE.replace("00000 LOG:  duration: 12.3 ms  statement: select 1", "42P01 ERROR:  no table"),)]
    log = logs.parse(spark.createDataFrame(rows, "raw string"))
    assert log.count() == 3
    r = log.first()
    assert (r["remote"], r["pid"], r["line_no"], r["user_name"], r["db"], r["sqlstate"], r["level"]) == ("10.0.0.1(5432)", "123", "1", "app", "shop", "00000", "LOG")
    assert str(r["log_time"]) == "2024-01-01 00:00:07"
    rep = {x["statement"]: x for x in logs.report(log).collect()}
    assert set(rep) == {"select ?", "select ?, ?", ""} and rep["select ?"]["total_ms"] == 12.3


def test_log_prefix_is_configurable(spark):
    df = spark.createDataFrame([("2024-01-01 00:00:07.123 UTC [55] app@shop LOG:  hello",)], "raw string")
    r = logs.parse(df, "%m [%p] %u@%d ").first()
    assert (r["pid"], r["user_name"], r["db"], r["message"]) == ("55", "app", "shop", "hello")


def test_log_selection_tests_every_excluded_name(spark):
    rows = [(LINE.replace("db=shop", f"db={d}"),) for d in ("shop", "crm", "postgres", "template1", "hr")]
    rows.append((LINE.replace("select 1", "VACUUM t"),))
    rows.append((LINE.replace("2024-01-01", "2024-01-02"),))
    log = logs.parse(spark.createDataFrame(rows, "raw string"))
    got = logs.select(log, day="2024-01-01", exclude_db=["crm", "hr"], exclude_query="^(VACUUM|COMMIT)")
    assert [r["db"] for r in got.collect()] == ["shop"]
    assert logs.select(log, db="hr").count() == 1


def test_log_files_of_one_day(spark, tmp_path):
    for day in ("2024-01-01", "2024-01-02"):
        (tmp_path / f"postgresql-{day}_000000.log").write_text(LINE + "\n")
    assert logs.read_day(spark, str(tmp_path), "2024-01-02").count() == 1


def test_archive_by_age(spark, tmp_path):
    df = values(spark, [("a", 1, "2024-01-01 00:00:00"), ("a", 2, "2024-01-31 00:00:00"), ("b", 3, "2023-12-01 00:00:00"), ("a", 4, "2024-03-01 00:00:00")], "db string, id int, at timestamp")
    out = str(tmp_path / "o")
    kept = logs.archive(df, "at", F.lit("2024-03-01").cast("timestamp"), out)
    assert sorted(r["id"] for r in kept.collect()) == [2, 4]  # exactly 30 days is not older
    assert {(r["db"], str(r["year"]), r["id"]) for r in spark.read.parquet(f"{out}/archive").collect()} == {("a", "2024", 1), ("b", "2023", 3)}


def test_archive_runs_add_up(spark, tmp_path):
    days = values(spark, [("a", d, f"2024-01-{d:02d} 00:00:00") for d in range(1, 32)], "db string, id int, at timestamp")
    out = str(tmp_path / "o")
    for late in ("2024-02-14", "2024-02-14", "2024-02-15", "2024-02-15"):
        kept = logs.archive(days, "at", F.lit(late).cast("timestamp"), out)
        days = values(spark, [tuple(r) for r in kept.withColumn("at", F.col("at").cast("string")).collect()], "db string, id int, at timestamp")
        both = sorted([r["id"] for r in days.collect()] + [r["id"] for r in logs.read_archive(spark, out).collect()])
        assert both == list(range(1, 32))
    assert days.count() == 16


def test_records_over_several_lines(spark, tmp_path):
    (tmp_path / "postgresql-2024-01-01_a.log").write_text(f"left over\n{LINE}\n\tfrom t\nwhere x = 1\n{LINE}\n\n")
    (tmp_path / "postgresql-2024-01-02.log").write_text(LINE.replace("2024-01-01", "2024-01-02"))
    day = logs.read_day(spark, str(tmp_path), "2024-01-01")
    got = [r["message"] for r in logs.parse(day).collect()]
    whole = logs.parse(spark.createDataFrame([(LINE,)], "raw string")).first()["message"]
    assert sorted(got) == sorted([whole, f"{whole}\n\tfrom t\nwhere x = 1"])


def test_a_label_named_twice_drops_its_line_only(spark):
    from fleetmetrics.sources import exposition

    lines = spark.createDataFrame([('a{x="1",x="2"} 3',), ('a{x="1",y="2"} 4',), ("b 5",)], "raw string")
    assert sorted(r["value"] for r in exposition.parse(lines).collect()) == [4.0, 5.0]


def test_nan_and_zero(spark):
    nan, inf = float("nan"), float("inf")
    v = values(spark, [("a", 1.0), ("a", nan), ("b", nan)], "k string, value double")
    assert {(r["k"], str(r["max"])) for r in A.agg_by(v, ["k"], ["max"]).collect()} == {("a", "1.0"), ("b", "nan")}
    assert [r["value"] for r in S.filter_value(v, ">", 0.5).collect()] == [1.0] and S.filter_value(v, "!=", 1.0).count() == 2
    assert [str(r["value"]) for r in A.top_n(v, "value", 2, ["k"]).collect()] == ["1.0", "nan"]
    q = values(spark, [(5.0, 0.0), (-5.0, 0.0), (0.0, 0.0), (nan, 0.0), (None, 0.0), (6.0, 3.0)], "a double, b double").select(S.divide(F.col("a"), F.col("b")).alias("q"))
    assert [str(r["q"]) for r in q.collect()] == [str(inf), str(-inf), "nan", "nan", "None", "2.0"]


def test_running_total_of_a_null_key(spark):
    from fleetmetrics.operators.neighbours import running_total, with_previous

    s = values(spark, [(None, "2024-01-01 00:10:00", 1.0), (None, "2024-01-01 02:10:00", 2.0), ("k", "2024-01-01 02:10:00", 4.0)], "key string, ts timestamp, value double")
    assert sorted(r["value"] for r in running_total(s, ["key"], "ts", "value").collect()) == [1.0, 3.0, 4.0]
    assert sorted(str(r["prev_value"]) for r in with_previous(s, ["key"], "ts", ["value"]).collect()) == ["1.0", "None", "None"]


def test_a_match_with_several_partners_fails(spark):
    v = values(spark, [("a", "x", 1.0), ("b", "x", 2.0), ("b", "x", 3.0)], "metric string, k string, value double")
    assert J.pivot_metrics(v.where("value < 3"), ["a", "b"], ["k"]).first()["b"] == 2.0
    with pytest.raises(Exception, match="several elements of b"):
        J.pivot_metrics(v, ["a", "b"], ["k"]).collect()


def test_report_rerun_replaces_only_its_day(spark, tmp_path):
    path = str(tmp_path / "r")
    log = logs.parse(spark.createDataFrame([(LINE,), (LINE.replace("2024-01-01", "2024-01-02"),)], "raw string"))
    logs.write_report(logs.report(log), path)
    logs.write_report(logs.report(logs.select(log, day="2024-01-01")), path)
    assert spark.read.parquet(path).count() == 2


def test_vector_matching(spark):
    a = values(spark, [("x", 1, 6.0), ("y", 1, 8.0)], "k string, t int, value double")
    b = values(spark, [("x", 1, 2.0), ("y", 1, 0.0), ("z", 1, 1.0)], "k string, t int, value double")
    assert {(r["k"], r["value"]) for r in J.binary(a, b, "/", ["k", "t"]).collect()} == {("x", 3.0), ("y", float("inf"))}
    assert [r["k"] for r in J.binary(a, b, ">", ["k", "t"]).where("k = 'x'").collect()] == ["x"]
    assert {r["k"] for r in J.unless(b, a, ["k", "t"]).collect()} == {"z"}
    role = values(spark, [("x", 2.0), ("y", 1.0)], "k string, value double")
    assert [(r["k"], r["value"]) for r in J.keep_if_primary(a, role, ["k"]).collect()] == [("x", 6.0)]
    assert [(r["k"], r["value"]) for r in J.keep_if_primary(a, role, ["k"], compat_add=True).collect()] == [("x", 8.0)]


def test_value_mapping_and_bands(spark):
    df = values(spark, [(None,), (0.0,), (0.5,), (150.0,), (250.0,)], "v double")
    text = A.map_values(F.col("v"), {0.0: "DOWN", 0.5: "PRIMARY"}, [(100, 199, "ALONE"), (200, float("inf"), "HA")], "DOWN")
    assert [r[0] for r in df.select(text).collect()] == ["DOWN", "DOWN", "PRIMARY", "ALONE", "HA"]
    band = A.band(F.col("v"), [(None, "green"), (0.5, "orange"), (200, "red")])
    assert [r[0] for r in df.where("v is not null").select(band).collect()] == ["green", "orange", "orange", "red"]
    pct = A.band(F.col("v"), [(None, "low"), (50, "high")], low=F.lit(0.0), high=F.lit(300.0))
    assert [r[0] for r in df.where("v >= 100").select(pct).collect()] == ["high", "high"]


def test_clamp_keeps_nan(spark):
    df = spark.range(1).select(F.lit(float("nan")).alias("v"))
    assert str(df.select(S.clamp_min(F.col("v"), 0)).first()[0]) == "nan"


def test_normalize_columns(spark):
    df = values(spark, [(None, 5.0), (2.0, 9.0)], "total_exec_time double, total_time double")
    got = normalize_columns(df, {"total_exec_time": ("total_time",), "gone": ("never",)}).collect()
    assert [(r["total_exec_time"], r["gone"]) for r in got] == [(5.0, None), (2.0, None)]


@pytest.mark.parametrize("text", ["1x", "", "5 parsecs"])
def test_bad_durations(text):
    from fleetmetrics.timeutil import micros

    with pytest.raises(ValueError):
        micros(text)
