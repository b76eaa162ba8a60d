from __future__ import annotations

from helpers import at
from pyspark.sql import functions as F

from fleetmetrics import drift, refresh
from fleetmetrics.sources.literal import values

H = "host string, snapshot_ts timestamp, "


def hashes(spark, *texts, host="h"):
    return values(spark, [(host, at(i), x) for i, x in enumerate(texts)], H + "hash string")


def status(df):
    return [r["status"] for r in df.orderBy("host", "snapshot_ts").collect()]


def test_settings_hash_is_ordered_and_marks_null(spark):
    import hashlib

    s = values(spark, [("h", at(0), "b", None), ("h", at(0), "a", "1"), ("h", at(1), "a", "1"), ("h", at(1), "b", "<<NULL>>")], H + "name string, setting string")
    got = drift.settings_hash(s).collect()
    assert {r["hash"] for r in got} == {hashlib.md5(b"a1,b<<NULL>>").hexdigest()}


def test_hba_hash_follows_line_order(spark):
    schema = H + "line_number int, type string, database array<string>, user_name array<string>, address string, netmask string, auth_method string, options array<string>"
    row = lambda t, n, db: ("h", at(t), n, "host", [db], ["all"], None, None, "md5", None)
    r = values(spark, [row(0, 1, "a"), row(0, 2, "b"), row(1, 1, "b"), row(1, 2, "a")], schema)
    out = drift.hba_hash(r).orderBy("snapshot_ts").collect()
    assert out[0]["text"] == "hostaall<<NULL>><<NULL>>md5<<NULL>>,hostball<<NULL>><<NULL>>md5<<NULL>>"
    assert out[0]["hash"] != out[1]["hash"]


def test_change_sticks_even_when_it_is_undone(spark):
    assert status(drift.drift_status(hashes(spark, "x", "x", "y", "y", "x", "x"))) == [0, 0, 1, 1, 1, 1]


def test_accepting_starts_a_new_history(spark):
    ok = values(spark, [("h", at(3))], "host string, accepted_at timestamp")
    assert status(drift.drift_status(hashes(spark, "x", "y", "y", "y", "y", "z"), ok)) == [0, 1, 1, 0, 0, 1]


def test_known_hash_overrides_history(spark):
    known = values(spark, [("h", "x")], "host string, known_hash string")
    assert status(drift.drift_status(hashes(spark, "x", "y", "x"), known=known)) == [0, 1, 0]


def test_history_rows_are_first_state_and_changes(spark):
    h = hashes(spark, "x", "x", "y", "y").withColumn("text", F.col("hash"))
    st = drift.drift_status(h)
    rows = drift.history_rows(h, st).orderBy("created_at").collect()
    assert [(r["settings_string"], r["valid"]) for r in rows] == [("x", 0), ("y", 1)]
    replicas = values(spark, [("h", at(2))], "host string, snapshot_ts timestamp")
    assert drift.history_rows(h, st, replicas).count() == 1


def test_replicas_read_their_primary(spark):
    hist = values(spark, [("p", at(10), "x", 0), ("p", at(30), "y", 1)], "host string, created_at timestamp, hash string, valid int")
    of = values(spark, [("r", "p"), ("q", "none")], "host string, primary string")
    h = values(spark, [("r", at(5), "x"), ("r", at(10), "x"), ("r", at(20), "z"), ("r", at(40), "y"), ("q", at(1), "x")], H + "hash string")
    got = drift.replica_status(h, hist, of).orderBy("host", "snapshot_ts").collect()
    assert [(r["host"], r["status"]) for r in got] == [("q", 0), ("r", 0), ("r", 0), ("r", 1), ("r", 1)]


def test_due_list_scope(spark):
    reg = values(spark, [("s", "a", 60, True, "global"), ("s", "b", 60, True, "database")], "view_schema string, view_name string, run_seconds int, active boolean, scope string")
    log = values(spark, [], "view_schema string, view_name string, run_at timestamp")
    assert [r["view_name"] for r in refresh.due_list(reg, log, F.lit(at(0)).cast("timestamp"), scope="database").collect()] == ["b"]


def test_due_list_boundaries(spark):
    reg = values(spark, [("never", 60, True), ("edge", 60, True), ("late", 60, True), ("off", -1, True), ("idle", 60, False)], "view_name string, run_seconds int, active boolean")
    log = values(spark, [("edge", at(0)), ("late", at(-1)), ("late", at(-500)), ("off", at(-9999))], "view_name string, run_at timestamp")
    due = refresh.due_list(reg, log, F.lit(at(60)).cast("timestamp"), key="view_name")
    assert {r["view_name"] for r in due.collect()} == {"never", "late"}


def test_refresh_replaces_only_changed_partitions(spark, tmp_path):
    path = str(tmp_path / "v")
    compute = lambda d: d.groupBy("p").agg(F.sum("x").alias("s"))
    one = values(spark, [("a", 1), ("b", 2)], "p string, x int")
    refresh.refresh_partitions(spark, one, path, "p", one, compute)
    two = values(spark, [("a", 10), ("b", 20)], "p string, x int")
    refresh.refresh_partitions(spark, two, path, "p", two.where("p = 'b'"), compute)
    assert {(r["p"], r["s"]) for r in spark.read.parquet(path).collect()} == {("a", 1), ("b", 20)}


def test_due_list_tells_schemas_apart(spark):
    reg = values(spark, [("s", "v", 60, True), ("t", "v", 60, True)], "view_schema string, view_name string, run_seconds int, active boolean")
    ran = refresh.run_log(reg.where("view_schema = 's'"), F.lit(at(60)).cast("timestamp"), F.lit(2))
    assert [r["view_schema"] for r in refresh.due_list(reg, ran, F.lit(at(90)).cast("timestamp")).collect()] == ["t"]
    assert refresh.run_log(reg, F.lit(at(60)).cast("timestamp"), F.lit(2), replica=True).count() == 0


def test_refresh_deletes_partitions_without_rows(spark, tmp_path):
    path = str(tmp_path / "v")
    compute = lambda d: d.groupBy("p").agg(F.sum("x").alias("s"))
    one = values(spark, [("a", 1), ("b", 2)], "p string, x int")
    refresh.refresh_partitions(spark, one, path, "p", one, compute)
    refresh.refresh_partitions(spark, one.where("p = 'b'"), path, "p", one.where("p = 'a'"), compute)
    assert {r["p"] for r in spark.read.parquet(path).collect()} == {"b"}
