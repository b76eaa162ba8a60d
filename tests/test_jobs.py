"""Snapshot jobs on handmade snapshots."""

from __future__ import annotations

import decimal

import pytest
from helpers import at
from pyspark.sql import functions as F

from fleetmetrics.functions import scalar as X
from fleetmetrics.jobs import backups, catalog, containers, maintenance, pooler, server, statements, storage
from fleetmetrics.sources import json_reports
from fleetmetrics.sources.literal import values

H = "host string, snapshot_ts timestamp, "
S0, S1 = ("h", at(0)), ("h", at(60))


def frame(spark, rows, schema):
    return values(spark, [(*S0, *r) for r in rows], H + schema)


def settings(spark, **kv):
    return frame(spark, [(k, v, False) for k, v in kv.items()], "name string, setting string, pending_restart boolean")


def test_version_and_gauges(spark):
    s = settings(spark, server_version_num="170002", checkpoint_timeout="300", checkpoint_completion_target="0.9", shared_buffers="16384", other=None)
    assert server.server_version(s).first()["current"] == 170002
    g = server.settings_gauge(s).first()
    assert (g["checkpoint_timeout"], g["checkpoint_completion_target"], g["shared_buffers"]) == (300, 0.9, 16384 * 8192)


def test_recovery_and_uptime(spark):
    s = values(spark, [("a", at(100), True, at(0)), ("b", at(100), False, at(40.5))], H + "in_recovery boolean, postmaster_start_time timestamp")
    assert {r["host"]: r["status"] for r in server.recovery_status(s).collect()} == {"a": 1, "b": 2}
    assert {r["host"]: r["seconds"] for r in server.postmaster(s).collect()} == {"a": 100.0, "b": 59.5}


def test_locks_are_zero_filled_and_null_databases_left_out(spark):
    dbs = frame(spark, [(1, "d1"), (2, "d2")], "oid bigint, datname string")
    held = frame(spark, [(1, "AccessShareLock"), (1, "accesssharelock"), (None, "ExclusiveLock"), (9, "ShareLock")], "database bigint, mode string")
    got = {(r["dbname"], r["mode"]): r["count"] for r in server.locks(dbs, held).collect()}
    assert len(got) == 16 and got[("d1", "accesssharelock")] == 2 and sum(got.values()) == 2


def test_wraparound_rounds_half_even_and_skips_closed_databases(spark):
    dbs = frame(spark, [(True, 50_000_000), (True, 10), (False, 1_900_000_000)], "datallowconn boolean, xid_age bigint")
    r = server.wraparound(dbs, settings(spark, autovacuum_freeze_max_age="200000000")).first()
    # 2.5 % rounds to 2, 25 % stays
    assert (r["oldest_current_xid"], r["percent_towards_wraparound"], r["percent_towards_emergency_autovac"]) == (50_000_000, 2.0, 25.0)


def test_archive_status(spark):
    rows = [("a", at(100), at(10), at(4)), ("b", at(100), at(1), at(4)), ("c", at(100), None, at(4)), ("d", at(100), None, None)]
    a = values(spark, [(*r, 5, 6) for r in rows], H + "last_failed_time timestamp, last_archived_time timestamp, archived_count bigint, failed_count bigint")
    got = {r["host"]: r for r in server.archive_status(a).collect()}
    assert [got[h]["seconds_since_last_fail"] for h in "abcd"] == [6.0, 0.0, 0.0, 0.0]
    assert got["a"]["seconds_since_last_archive"] == 96.0 and got["d"]["seconds_since_last_archive"] is None


def test_pending_restart(spark):
    s = frame(spark, [("a", "1", True), ("b", "1", False), ("c", "1", None)], "name string, setting string, pending_restart boolean")
    assert server.pending_restart(s).first()["count"] == 1


def test_replication_lag(spark):
    rows = [
        ("primary", at(100), False, None, None, at(1)), ("caught", at(100), True, "0/10", "0/10", at(40)), ("behind", at(100), True, "0/20", "0/10", at(40)),
        ("odd", at(100), True, None, "0/10", at(40)),
    ]
    s = values(spark, rows, H + "in_recovery boolean, receive_lsn string, replay_lsn string, last_xact_replay timestamp")
    got = {r["host"]: (r["replay_time"], r["received_time"]) for r in server.replication_lag(s).collect()}
    assert got == {"primary": (0, 0), "caught": (0, 60), "behind": (60, 60), "odd": (60, 60)}


def test_lsn_arithmetic(spark):
    d = values(spark, [("16/B374D848", "16/B374D000"), ("FFFFFFFF/FFFFFFFF", "0/0"), ("1/0", "0/FFFFFFFF")], "a string, b string")
    got = [r[0] for r in d.select(X.lsn_diff(F.col("a"), F.col("b"))).collect()]
    assert got == [0x848, 2**64 - 1, 1]


def test_replication_size_and_slots(spark):
    rep = frame(spark, [("10.0.0.2", None, 5432, "0/30", "0/10")], "client_addr string, client_hostname string, client_port int, sent_lsn string, replay_lsn string")
    assert server.replication_lag_size(rep).first()["bytes"] == 0x20
    slots = frame(spark, [("s1", True, "0/10"), ("s2", False, "0/20")], "slot_name string, active boolean, restart_lsn string")
    srv = frame(spark, [(False, "0/99", "0/40")], "in_recovery boolean, replay_lsn string, insert_lsn string")
    assert {r["slot_name"]: (r["active"], int(r["retained_bytes"])) for r in server.replication_slots(slots, srv).collect()} == {"s1": (1, 0x30), "s2": (0, 0x20)}


def test_connection_stats(spark):
    rows = [
        ("active", "client backend", "Lock", at(-50), at(-50)), ("active", "walsender", "Lock", at(-900), at(-900)), ("idle", "client backend", None, at(-800), at(-800)),
        ("idle in transaction", "client backend", None, at(-70), at(-30)), (None, "checkpointer", None, None, None), ("idle in transaction (aborted)", "client backend", None, at(-500), at(-500)),
    ]
    act = frame(spark, rows, "state string, backend_type string, wait_event_type string, query_start timestamp, state_change timestamp")
    r = server.connection_stats(act, settings(spark, max_connections="100")).first()
    assert (r["total"], r["idle"], r["idle_in_txn"], r["active"]) == (6, 1, 1, 4)
    assert (r["max_idle_in_txn_time"], r["max_query_time"], r["max_blocked_query_time"], r["max_connections"]) == (30.0, 50.0, 50.0, 100.0)


def test_connection_stats_without_any_match(spark):
    act = frame(spark, [(None, "checkpointer", None, None, None)], "state string, backend_type string, wait_event_type string, query_start timestamp, state_change timestamp")
    r = server.connection_stats(act, settings(spark, max_connections="10")).first()
    assert (r["max_idle_in_txn_time"], r["max_query_time"], r["max_blocked_query_time"]) == (0.0, 0.0, 0.0)


def test_wal_activity_edge(spark):
    w = frame(spark, [(10, at(-300)), (20, at(-299)), (5, at(-9000))], "size bigint, modification timestamp")
    r = server.wal_activity(w).first()
    assert (r["last_5_min_size_bytes"], r["total_size_bytes"]) == (20, 35)


def test_writers_of_old_and_new_versions(spark):
    old = frame(spark, [(7, 8, 9)], "checkpoints_timed bigint, buffers_backend bigint, buffers_clean bigint")
    new = frame(spark, [(3, 4)], "num_timed bigint, writes bigint")
    o, n = server.writers(old).first(), server.writers(new).first()
    assert (o["num_timed"], o["writes"], o["buffers_clean"], o["fsyncs"]) == (7, 8, 9, None) and (n["num_timed"], n["writes"]) == (3, 4)


def test_checksum_failures(spark):
    s = frame(spark, [("d", 2, at(-10)), (None, 0, None)], "datname string, checksum_failures bigint, checksum_last_failure timestamp")
    assert [(r["dbname"], r["count"], r["time_since_last_failure_seconds"]) for r in server.checksum_failures(s).collect()] == [("d", 2, 10.0), (None, 0, 0.0)]


def test_sequences(spark):
    big = 2**63 - 1
    rows = [
        ("s", "q75", 75, 1, 100, 1, False), ("s", "q76", 76, 1, 100, 1, True), ("s", "unused", None, 1, big, 1, False), ("s", "full", big, 1, big, 1, False),
        ("S", "Odd", 10, 1, 10, 3, False), ("s", "wide", big, -big - 1, big, 1, False),
    ]
    seq = frame(spark, rows, "schemaname string, sequencename string, last_value bigint, min_value bigint, max_value bigint, increment_by bigint, cycle boolean")
    assert storage.sequence_exhaustion(seq).first()["count"] == 4  # q76, full, Odd, wide
    assert storage.sequence_exhaustion(seq, 75, inclusive=True).first()["count"] == 5
    owned = frame(spark, [("s.q75", "t1"), ("s.q75", "t2")], "sequence_name string, table_name string")
    defaults = frame(spark, [("nextval('s.q75'::regclass)", "t2"), ("nextval('s.full'::regclass)", "t9"), ("now()", "x")], "default_expr string, table_name string")
    st = {r["sequence_name"]: r for r in storage.sequence_status(seq, storage.sequence_tables(owned, defaults)).collect()}
    assert st["s.q75"]["table_usage"] == "t1, t2" and st["s.full"]["table_usage"] == "t9" and st["s.unused"]["table_usage"] is None
    assert (st["s.q75"]["percent"], int(st["s.q75"]["numleft"])) == (75, 25)
    assert (int(st['"S"."Odd"']["slots"]), int(st['"S"."Odd"']["used"])) == (4, 4)
    assert int(st["s.wide"]["slots"]) == 2**64 and int(st["s.unused"]["used"]) == 1 and st["s.unused"]["last_value"] == 1


def test_bloat(spark):
    b = frame(spark, [("db", "public", "t", 819200, 1000, 90000, 100, 90.0)], "dbname string, schemaname string, objectname string, size_bytes bigint, dead_tuple_size_bytes bigint, free_space_bytes bigint, relpages bigint, fillfactor double")
    assert storage.bloat(b).first()["total_wasted_space_bytes"] == 1000 + (90000 - round(10 * 8192))


def test_sizes(spark):
    d = frame(spark, [("a", False, 5), ("template0", True, 9)], "datname string, datistemplate boolean, size_bytes bigint")
    assert [(r["dbname"], r["bytes"]) for r in storage.database_size(d).collect()] == [("a", 5)]
    rel = frame(spark, [("db", 1, "t", "r", 10), ("db", 1, "i", "i", 10), ("db", 2, "tmp", "r", 10)], "dbname string, relnamespace bigint, relname string, relkind string, size_bytes bigint")
    ns = frame(spark, [("db", 1, "public", False), ("db", 2, "pg_temp_3", True)], "dbname string, oid bigint, nspname string, is_other_temp boolean")
    assert [(r["schemaname"], r["relname"]) for r in storage.table_size(rel, ns).collect()] == [("public", "t")]


STMT = "role string, dbname string, queryid bigint, query string, calls bigint, total_time double, mean_time double, max_time double, rows bigint, wal_records bigint, wal_fpi bigint, wal_bytes bigint"


def test_statements_with_old_names(spark):
    rows = [("r", "d", i, f"  select\n{'x' * 60}{i}", 2, float(i), float(i), float(100 - i), 1, i, 1, 10 * i) for i in range(30)]
    s = frame(spark, rows, STMT)
    t = statements.totals(s).first()
    assert (t["calls_count"], t["exec_time_ms"], t["mean_exec_time_ms"], t["row_count"]) == (60, 435.0, 14.5, 30)
    top = statements.top_total(s).collect()
    assert len(top) == 20 and {r["queryid"] for r in top} == set(range(10, 30))
    assert {r["query"] for r in top} == {"select" + "x" * 31}  # 40 characters, minus the break, minus blanks
    assert {r["queryid"] for r in statements.top_max(s).collect()} == set(range(20))
    assert len(statements.top_mean(s, 5).collect()) == 5
    assert max(r["bytes"] for r in statements.top_wal(s, 3).collect()) == 290


def test_top_lists_are_per_snapshot(spark):
    rows = [(*snap, "r", "d", i, "q", 1, float(i), 1.0, 1.0, 1, 1, 1, 1) for snap in (S0, S1) for i in range(4)]
    assert statements.top_total(values(spark, rows, H + STMT), 3).count() == 6


def test_reset_detection(spark):
    rows = [("h", "a", at(s), float(v)) for s, v in [(0, 5), (100, 9), (400, 2), (500, 3), (900, 1)]] + [("h", "b", at(s), float(s)) for s in (0, 50)]
    c = values(spark, rows, "host string, series_key string, ts timestamp, value double")
    got = {r["series_key"]: r["time"] for r in statements.reset_times(c, ["series_key"]).collect()}
    assert got["b"] == 0 and got["a"] == 1704067200 + 900
    assert statements.reset_snapshot(c).first()["time"] == 1704067200 + 900


def test_refresh_bookkeeping(spark):
    rows = [("d", True, at(-601), "600"), ("d", True, at(-600), "600"), ("d", True, None, "600"), ("d", False, None, "600"), ("e", True, at(0), "1")]
    v = frame(spark, rows, "dbname string, active boolean, last_run timestamp, secs string")
    v = v.withColumn("run_interval", F.make_dt_interval(secs=F.col("secs").cast("decimal(18,6)"))).withColumn("last_run_seconds", F.col("secs").cast("double"))
    assert {r["dbname"]: r["count"] for r in maintenance.refresh_failures(v).collect()} == {"d": 2, "e": 0}
    assert {r["dbname"]: r["seconds"] for r in maintenance.longest_refresh(v).collect()} == {"d": 600.0, "e": 1.0}


def test_pooler(spark):
    t = "pgbouncer_target_host string, "
    db = frame(spark, [("t", "a", 100, 45, 10, 0, 0), ("t", "b", 0, 5, 10, 0, 1), ("t", "half", 200, 5, 10, 0, 0)], t + "name string, max_connections int, current_connections int, pool_size int, paused int, disabled int")
    assert {r["pool_db"]: r["db_conn_perc_used"] for r in pooler.databases(db).collect()} == {"a": 45, "b": 50, "half": 2}
    pools = frame(spark, [("t", "d", "u", 1, 2, 3, 4, 5), ("t", "d", "u", 1, 0, 0, 0, 0)], t + "database string, user string, cl_active int, cl_waiting int, sv_active int, sv_idle int, sv_used int")
    r = pooler.pools(pools).first()
    assert (r["conn_pool"], r["client_active"], r["server_used"]) == ("d.u", 2, 5)
    rows = frame(spark, [("t", "d", "u", "active"), ("t", "d", "u", "active")], t + "database string, user string, state string")
    assert pooler.clients(rows).first()["client_state_count"] == 2 and pooler.servers(rows).first()["server_state_count"] == 2
    lists = frame(spark, [("t", "pools", 3), ("t", "users", 9)], t + "list string, items int")
    assert [(r["item"], r["item_count"]) for r in pooler.lists(lists).collect()] == [("pools", 3)]


def test_direct_pooler_rows_become_samples(spark):
    rows = frame(spark, [("d", "u", "active", "psql", "", 1.5)], "database string, user string, state string, application_name string, link string, wait double")
    got = catalog.direct_pooler_samples(rows, "clients").first()
    assert got["metric"] == "ccp_pgbouncer_clients_wait_seconds" and got["labels"]["state"] == "active" and got["value"] == 1.5
    lists = frame(spark, [("pools", 4)], "list string, items int")
    assert catalog.direct_pooler_samples(lists, "lists").first()["metric"] == "ccp_pgbouncer_lists_item_count"


def backup(kind, start, stop, repo=1, version="2.41", error=False):
    return (
        f'{{"type":"{kind}","error":{str(error).lower()},"backrest":{{"version":"{version}"}},"database":{{"repo-key":{repo}}},'
        f'"info":{{"repository":{{"delta":{start},"size":{stop}}}}},"timestamp":{{"start":{start},"stop":{stop}}}}}'
    )


def test_backups(spark):
    base = 1704067200
    main = [backup("full", base - 900, base - 800), backup("full", base - 500, base - 99, version="2.5.1"), backup("diff", base - 90, base - 50, error=True), backup("full", base - 400, base - 390, repo=2)]
    data = f'[{{"name":"main","backup":[{",".join(main)}]}},{{"name":"empty","backup":[]}}]'
    rep = json_reports.split_reports(frame(spark, [("etc/x.conf|" + data,), ("bad|not json",)], "raw string"), keep=("host", "snapshot_ts"))
    b = json_reports.backups(rep)
    assert b.count() == 4
    info = {(r["repo"], r["backup_type"]): r for r in backups.last_info(b).collect()}
    assert set(info) == {("1", "full"), ("1", "diff"), ("2", "full")}
    newest = info[("1", "full")]
    assert (newest["config_file"], newest["backrest_repo_version"], newest["backup_runtime_seconds"], newest["backup_error"]) == ("etc_x.conf", "20501", 401, 0)
    assert info[("1", "diff")]["backup_error"] == 1 and info[("2", "full")]["backrest_repo_version"] == "24100"
    assert {r["repo"]: r["time_seconds"] for r in backups.oldest_full(b).collect()} == {"1": base - 800, "2": base - 390}
    ages = {r["repo"]: r for r in backups.time_since(b).collect()}
    assert (ages["1"]["full_time_since_completion_seconds"], ages["1"]["diff_time_since_completion_seconds"], ages["1"]["incr_time_since_completion_seconds"]) == (99, 50, 50)
    assert {r["repo"] for r in backups.time_since_kind(b, "incr").collect()} == {"1", "2"}


def test_backup_times_compare_as_numbers(spark):
    """As text 999 would beat 1000."""
    data = f'[{{"name":"m","backup":[{backup("full", 999, 1001)},{backup("full", 1000, 1002)}]}}]'
    b = json_reports.backups(json_reports.split_reports(frame(spark, [("c|" + data,)], "raw string"), keep=("host", "snapshot_ts")))
    assert backups.last_info(b).first()["repo_backup_size_bytes"] == 1000


KV = "mode string, file string, key string, val bigint"


def test_container_memory(spark):
    old = frame(spark, [("legacy", "memory.limit_in_bytes", "", 9223372036854771712), ("legacy", "memory.stat", "dirty", 3), ("legacy", "memory.stat", "cache", 4), ("legacy", "memory.usage_in_bytes", "", 8)], KV)
    new = frame(spark, [("unified", "memory.max", "", 9223372036854775807), ("unified", "memory.stat", "file_dirty", 5), ("unified", "memory.current", "", 9), ("unified", "mem_request", "", 1)], KV)
    o, n = containers.memory(old).first(), containers.memory(new).first()
    assert (o["limit"], o["dirty"], o["cache"], o["usage_in_bytes"]) == (0, 3, 4, 8)
    assert (n["limit"], n["dirty"], n["cache"], n["usage_in_bytes"], n["kmem_usage_in_bytes"], n["request"]) == (0, 5, 0, 9, 0, 1)
    real = frame(spark, [("unified", "memory.max", "", 77)], KV)
    assert containers.memory(real).first()["limit"] == 77


def test_container_cpu(spark):
    kv = frame(spark, [("unified", "cpu.max", "1", -1), ("unified", "cpu.max", "2", 100000), ("unified", "cpu.stat", "usage_usec", 7), ("unified", "cpu.stat", "nr_periods", 2), ("unified", "cpu_limit", "", 500), ("unified", "process_count", "", 12)], KV)
    c = containers.cpu_cfs(kv).first()
    assert (c["period_us"], c["quota_us"]) == (100000, 0)
    assert (containers.cpu_acct(kv).first()["usage"], containers.cpu_acct(kv).first()["usage_ts"]) == (7000, 1704067200.0)
    assert containers.cpu_stat(kv).first()["nr_periods"] == 2 and containers.cpu(kv).first()["limit"] == 500 and containers.process_count(kv).first()["count"] == 12


def test_container_disks(spark):
    dev = "major_number int, minor_number int, "
    mounts = frame(spark, [(8, 1, "/pgdata", "xfs"), (8, 2, "/tablespaces/a", "xfs"), (8, 3, "/tmp", "xfs")], dev + "mount_point string, fs_type string")
    fs = frame(spark, [(8, m, p, 10, 4, 6, 2) for m, p in ((1, "/pgdata"), (2, "/tablespaces/a"), (3, "/tmp"))], dev + "mount_point string, total_bytes bigint, available_bytes bigint, total_file_nodes bigint, free_file_nodes bigint")
    disk = frame(spark, [(8, 1, 100, 200), (8, 9, 1, 1)], dev + "sectors_read bigint, sectors_written bigint")
    assert {r["mount_point"] for r in containers.data_disk(mounts, fs).collect()} == {"/pgdata", "/tablespaces/a"}
    assert [(r["mount_point"], r["sectors_written"]) for r in containers.disk_activity(mounts, disk).collect()] == [("/pgdata", 200)]


def test_catalogue_runs_and_is_extensible(spark):
    tables = {"settings": settings(spark, server_version_num="160001"), "servers": values(spark, [(*S0, False, at(-5), None, None, None, None)], H + "in_recovery boolean, postmaster_start_time timestamp, receive_lsn string, replay_lsn string, insert_lsn string, last_xact_replay timestamp")}
    got = {r["metric"]: r["value"] for r in catalog.collect(tables).collect()}
    assert got["ccp_postgresql_version_current"] == 160001 and got["ccp_is_in_recovery_status"] == 2 and got["ccp_postmaster_uptime_seconds"] == 5
    catalog.register_metric_job("rooms", lambda t: t, ["rooms"], ["n"], ["room"])
    try:
        rooms = frame(spark, [("r1", 3)], "room string, n int")
        s = catalog.samples("rooms", {"rooms": rooms}).first()
        assert (s["metric"], s["labels"], s["value"]) == ("ccp_rooms_n", {"host": "h", "room": "r1"}, 3.0)
    finally:
        del catalog.BLOCKS["rooms"]
    with pytest.raises(ValueError):
        catalog.collect({"nothing": rooms})


def test_scalar_functions(spark):
    d = values(spark, [("2.41", 0.5, 1.5, 2.5)], "v string, a double, b double, c double")
    r = d.select(X.version_key(F.col("v")), X.half_even(F.col("a")), X.half_even(F.col("b")), X.half_even(F.col("c")), X.quote_ident(F.lit('We"ird'))).first()
    assert tuple(r) == ("24100", 0.0, 2.0, 2.0, '"We""ird"')
    arr = values(spark, [(None,), ([None, "x"],)], "a array<string>").select(X.joined_array(F.col("a")))
    assert [x[0] for x in arr.collect()] == ["<<NULL>>", "x"]
    t = spark.range(1).select(X.render(F.lit("{{ $labels.job }}={{$value}} {{ $labels.none }}!"), F.create_map(F.lit("job"), F.lit("j")), F.lit(2.5))).first()[0]
    assert t == "j=2.5 !"
    assert spark.range(1).select(X.percent_used(F.lit(29).cast("decimal(22,0)"), F.lit(200).cast("decimal(22,0)"))).first()[0] == 15  # 14.5 away from zero
    assert isinstance(spark.range(1).select(X.lsn(F.lit("0/1"))).first()[0], decimal.Decimal)


def test_sql_functions(spark):
    from fleetmetrics.functions.sql import register_sql_functions

    assert "lsn_diff" in register_sql_functions(spark)
    r = spark.sql("select lsn_diff('16/B374D848', '16/B374D000') d, version_key('2.5.1') v, half_even(2.5) h, counter_step(3, 9) c, label(map('a', 'b'), 'x') l, clean_query('  a\\nb ') q").first()
    assert (int(r["d"]), r["v"], r["h"], r["c"], r["l"], r["q"]) == (0x848, "20501", 2.0, 3.0, "", "ab")
