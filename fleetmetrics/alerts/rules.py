"""Alert rules as data, and the rule set for database and host fleets.

A rule names one or two metrics and a kind; ``evaluate`` has one plan for each family of kinds:

==============  =====================================================================
instant         newest value
age             evaluation time minus value
ratio_pct       100 * metric / metric2, same labels
free_pct        100 - 100 * metric / metric2, same labels
sum_free_pct    100 - 100 * sum by (labels) (metric / metric2)
max_by          largest value in each group (all elements when ``by`` is empty)
count_by        number of elements in each group
odd_count       number of elements modulo 2
and_min         metric2 where metric of the same group is at least ``minimum``
max_both        largest value over two metrics in each group, both present
load            metric for each distinct ``by`` label value of metric2 (cores)
avg_over_time   average over ``window``
changes         changes over ``window``
changed         newest value where it differs from the one ``window`` earlier
delta           newest value minus the one ``window`` earlier
role_change     per group, number of elements that differ from the one ``window`` earlier
forecast        line through ``window`` read ``ahead`` later; with metric2 also used % > minimum
absent          1 where no element matches
==============  =====================================================================
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..sources.literal import values

SEVERITY = {"warning": 200, "critical": 300}


@dataclass(frozen=True)
class Rule:
    alert: str
    kind: str
    metric: str
    op: str
    threshold: float
    hold: int  # seconds the condition has to hold before the alert fires
    severity: str = "critical"
    service: str = "postgresql"
    metric2: str = ""
    matchers: tuple[tuple[str, str, str], ...] = ()
    by: tuple[str, ...] = ()
    window: str = ""
    ahead: str = ""
    minimum: float | None = None
    severity_num: int = 0
    enabled: bool = True
    packs: tuple[str, ...] = ("host",)
    summary: str = "{{ $labels.job }} (instance: {{ $labels.instance }}): {{ $labels.alertname }}, value ( {{ $value }} )"
    extra: dict = field(default_factory=dict)


RULE_SCHEMA = (
    "rule_id int, alertname string, kind string, metric string, metric2 string, op string, threshold double, hold int, severity string, "
    "severity_num int, service string, minimum double, summary string"
)


def rule_frame(spark: SparkSession, rules: list[tuple[int, Rule]]) -> DataFrame:
    rows = [
        (i, r.alert, r.kind, r.metric, r.metric2, r.op, float(r.threshold), r.hold, r.severity, r.severity_num or SEVERITY.get(r.severity, 0), r.service, r.minimum, r.summary)
        for i, r in rules
    ]
    return values(spark, rows, RULE_SCHEMA)


_REGISTERED: list[Rule] = []


def register_rule(rule: Rule) -> Rule:
    """Add a user rule to those returned by ``catalogue``."""
    _REGISTERED.append(rule)
    return rule


_BOTH = ("host", "container")
_REAL_FS = (("device", "!~", "tmpfs|by-uuid"), ("fstype", "=~", "xfs|ext[234]"))


def _tiers(alert, kind, metric, warning, critical, hold=60, op=">", **kw):
    return [Rule(alert, kind, metric, op, warning, hold, "warning", **kw), Rule(alert, kind, metric, op, critical, hold, "critical", **kw)]


def catalogue(pack: str = "host", include_disabled: bool = False) -> list[Rule]:
    """The rule set of one pack (``host`` or ``container``) plus registered user rules."""
    rules = [r for r in (*_RULES, *_REGISTERED) if pack in r.packs]
    return rules if include_disabled else [r for r in rules if r.enabled]


def _rule(alert, metric, op, threshold, hold=60, **kw):
    return Rule(alert, kw.pop("kind", "instant"), metric, op, threshold, hold, **kw)


# fixed values: alert names, metrics, thresholds, hold times and severities of the monitored fleet
_RULES: list[Rule] = [
    _rule("SQLExporterScrapeError", "scrape_errors_total", ">", 0),
    *_tiers("PGMatViewRefreshTime", "instant", "ccp_metric_matview_refresh_longest_runtime_seconds", 65, 300),
    *_tiers("PGTableRefreshTime", "instant", "ccp_metric_table_refresh_longest_runtime_seconds", 65, 300),
    _rule("PGMatViewRefreshFail", "ccp_metric_matview_refresh_last_run_fail_count", ">", 0),
    _rule("PGTableRefreshFail", "ccp_metric_table_refresh_last_run_fail_count", ">", 0),
    _rule("PGIsUp", "up", "<", 1, matchers=(("exp_type", "=", "pg"),)),
    _rule("PGIsUp", "pg_up", "<", 1, packs=("container",)),
    _rule("PGExporterScrapeError", "pg_exporter_last_scrape_error", ">", 0, packs=("container",)),
    _rule("PGNoPrimary", "ccp_is_in_recovery_status", "<", 2, 30, kind="max_by", by=("cluster_name",)),
    _rule("PGMinimumVersion", "ccp_postgresql_version_current", "<", 160000, enabled=False),
    _rule("PGMinimumVersion", "ccp_postgresql_version_current", "<", 110005, enabled=False, packs=("container",)),
    _rule("PGRecoveryStatusSwitch", "ccp_is_in_recovery_status", "any", 0, kind="changed", window="5m"),
    _rule("PGRecoveryStatusSwitch_Replica", "ccp_is_in_recovery_status", ">", 1, matchers=(("job", "=", "Replica"),), enabled=False, packs=_BOTH),
    _rule("PGConnectionAbsent_Prod", "ccp_connection_stats_max_connections", "any", 0, 10, kind="absent", matchers=(("job", "=", "Prod"),), enabled=False, packs=_BOTH),
    _rule("PGSettingsChecksum", "ccp_pg_settings_checksum_status", ">", 0, enabled=False),
    _rule("PGSettingsChecksum", "ccp_pg_settings_checksum", ">", 0, enabled=False, packs=("container",)),
    _rule("PGDataChecksum", "ccp_postgresql_version_current", ">", 0, kind="and_min", metric2="ccp_data_checksum_failure_count", minimum=120000, by=("job", "instance")),
    _rule("PGDataChecksum", "ccp_data_checksum_failure", ">", 0, enabled=False, packs=("container",)),
    *_tiers("PGIdleTxn", "instant", "ccp_connection_stats_max_idle_in_txn_time", 300, 900, packs=_BOTH),
    *_tiers("PGQueryTime", "instant", "ccp_connection_stats_max_query_time", 43200, 86400, packs=_BOTH),
    *_tiers("PGConnPerc", "ratio_pct", "ccp_connection_stats_total", 75, 90, metric2="ccp_connection_stats_max_connections", packs=_BOTH),
    *_tiers("PGDBSize", "instant", "ccp_database_size_bytes", 1.073741824e11, 2.68435456e11),
    *_tiers("PGReplicationByteLag", "instant", "ccp_replication_lag_size_bytes", 5.24288e7, 1.048576e8, packs=_BOTH),
    _rule("PGReplicationSlotsInactive", "ccp_replication_slots_active", "==", 0, packs=_BOTH),
    *_tiers("PGXIDWraparound", "instant", "ccp_transaction_wraparound_percent_towards_wraparound", 50, 75, packs=_BOTH),
    *_tiers("PGEmergencyVacuum", "instant", "ccp_transaction_wraparound_percent_towards_emergency_autovac", 110, 125, packs=_BOTH),
    _rule("PGArchiveCommandStatus", "ccp_archive_command_status_seconds_since_last_fail", ">", 300, packs=_BOTH),
    _rule("PGSequenceExhaustion", "ccp_sequence_exhaustion_count", ">", 0, packs=_BOTH),
    _rule("PGSettingsPendingRestart", "ccp_settings_pending_restart_count", ">", 0, packs=_BOTH),
    _rule("PGBackRestLastCompletedFull_main", "ccp_backrest_last_full_backup_time_since_completion_seconds", ">", 648000, matchers=(("stanza", "=", "main"),), enabled=False, packs=_BOTH),
    _rule("PGBackRestLastCompletedIncr_main", "ccp_backrest_last_incr_backup_time_since_completion_seconds", ">", 129600, matchers=(("stanza", "=", "main"),), enabled=False, packs=_BOTH),
    _rule("PGBackRestLastRuntimeFull_main", "ccp_backrest_last_info_backup_runtime_seconds", ">", 14400, matchers=(("backup_type", "=", "full"), ("stanza", "=", "main")), enabled=False, packs=_BOTH),
    _rule("PGBackRestLastRuntimeDiff_main", "ccp_backrest_last_info_backup_runtime_seconds", ">", 3600, matchers=(("backup_type", "=", "diff"), ("stanza", "=", "main")), enabled=False, packs=_BOTH),
    _rule("PGBackRestErrorDuringBackup", "ccp_backrest_last_info_backup_error", ">", 0, enabled=False),
    _rule("PGBackrestAbsentFull_Prod", "ccp_backrest_last_full_backup_time_since_completion_seconds", "any", 0, 10, kind="absent", matchers=(("job", "=", "Prod"),), enabled=False, packs=_BOTH),
    _rule("PGClusterRoleChange", "ccp_is_in_recovery_status", ">=", 1, kind="role_change", by=("pg_cluster",), window="5m", extra={"ignoring": ("instance", "ip", "pod", "role")}, packs=("container",)),
    *_tiers("PGDiskSize", "free_pct", "ccp_nodemx_data_disk_available_bytes", 75, 90, metric2="ccp_nodemx_data_disk_total_bytes", packs=("container",)),
    _rule("DiskFillPredict", "ccp_nodemx_data_disk_available_bytes", "<", 0, 300, kind="forecast", metric2="ccp_nodemx_data_disk_total_bytes", minimum=70, window="1h", ahead="24h", matchers=(("mount_point", "!~", "tmpfs"),), severity="warning", packs=("container",)),
    _rule("NodeExporterScrapeError", "node_textfile_scrape_error", ">", 0, service="system"),
    _rule("ExporterDown", "up", "<", 0.5, 10, kind="avg_over_time", window="5m", service="system", packs=_BOTH),
    *_tiers("DiskUsagePerc", "sum_free_pct", "node_filesystem_avail_bytes", 70, 85, 120, metric2="node_filesystem_size_bytes", by=("job", "device"), matchers=_REAL_FS, service="system"),
    *_tiers("SystemLoad5m", "load", "node_load5", 2, 4, 600, metric2="node_cpu_seconds_total", by=("cpu", "mode"), service="system"),
    *_tiers("MemoryAvailable", "ratio_pct", "node_memory_MemAvailable_bytes", 25, 10, 60, "<", metric2="node_memory_MemTotal_bytes", service="system"),
    _rule("OOMKiller", "node_vmstat_oom_kill", "!=", 0, kind="changes", window="5m", severity="warning", service="system"),
    *_tiers("SwapUsage", "free_pct", "node_memory_SwapFree_bytes", 60, 80, metric2="node_memory_SwapTotal_bytes", service="system"),
    _rule("DiskFillPredict", "node_filesystem_free_bytes", "<", 0, 300, kind="forecast", window="1h", ahead="4h", matchers=_REAL_FS, severity="warning", service="system", enabled=False),
    _rule("ETCDAbsent", "etcd_server_has_leader", "any", 0, 10, kind="absent", service="etcd"),
    _rule("ETCDOddCount", "etcd_server_has_leader", "!=", 1, 10, kind="odd_count", service="etcd"),
    _rule("ETCDLeader", "etcd_server_has_leader", "<", 1, 10, kind="max_by", service="etcd"),
    _rule("ETCDMinimumNodeCount", "etcd_server_has_leader", "<", 3, 10, kind="count_by", service="etcd", enabled=False),
    _rule("ETCDAbsent_etcd1", "etcd_server_has_leader", "any", 0, 10, kind="absent", matchers=(("job", "=", "ip11_etcd1"),), service="etcd", enabled=False),
    _rule("ETCDAbsent_etcd2", "etcd_server_has_leader", "any", 0, 10, kind="absent", matchers=(("job", "=", "ip21_etcd2"),), service="etcd", enabled=False),
    _rule("ETCDAbsent_etcd3", "etcd_server_has_leader", "any", 0, 10, kind="absent", matchers=(("job", "=", "ip31_etcd3"),), service="etcd", enabled=False),
    _rule("PatroniPGIsRunning", "patroni_postgres_running", "!=", 1, service="patroni"),
    _rule("PatroniPendingRestart", "patroni_pending_restart", "!=", 0, 1800, severity="warning", severity_num=300, service="patroni"),
    _rule("PatroniIsPaused", "patroni_is_paused", "!=", 0, 900, service="patroni"),
    *_tiers("PatroniDCSLastSeen", "age", "patroni_dcs_last_seen", 300, 1800, service="patroni"),
    _rule("PatroniRapidTimelineSwitch", "patroni_postgres_timeline", ">", 5, kind="delta", window="60m", severity_num=200, service="patroni"),
    _rule("PatroniTimelineSwitch", "patroni_postgres_timeline", "any", 0, kind="changed", window="5m", severity="warning", service="patroni"),
    _rule("PatroniNoLeader", "patroni_master", "<", 1, kind="max_both", metric2="patroni_standby_leader", by=("cluster",), service="patroni"),
    _rule("BlackBoxProbe", "probe_success", "==", 0, service="blackbox"),
]
