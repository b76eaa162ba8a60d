"""Every registered query against its SQL on the smallest data set."""

from __future__ import annotations

import duckdb
import pytest

from check import TABLES, compare
from fleetmetrics.plans import ORACLES, QUERIES

SF, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
#: Their SQL takes it that a series has a value every day, which the smallest data set does not give.
DENSE = {"rule_ranges", "stream_inhibit", "stream_notifications", "stream_repeat"}


@pytest.fixture(scope="module")
def con():
    def open_(sf):
        c = duckdb.connect()
        for t in TABLES:
            c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
        return c

    return {sf: open_(sf) for sf in (SF, LARGER)}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, con, name):
    sf = LARGER if name in DENSE else SF
    state, _, _, note = compare(spark, con[sf], sf, name, QUERIES[name], ORACLES.get(name))
    assert state == "ok", f"{state}: {note}"


def test_every_query_has_sql():
    assert set(ORACLES) == set(QUERIES)


def test_entry_point(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["alertname", "severity", "host", "t", "active_since", "alertstate"]
    assert set(e.oracle_sql()) <= set(e.queries())
