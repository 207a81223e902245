"""Unit rows for column functions and operators."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pvspark.functions import columns as C
from pvspark.operators import lifecycle, reconcile, reshape, rollup


def values(spark, expr, n=1):
    return spark.range(n).select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize(("hours", "tier"), [(2, "raw"), (6, "raw"), (72, "hourly"), (168, "hourly"), (720, "daily")])
def test_tier(spark, hours, tier):
    start = datetime(2024, 1, 1)
    assert rollup.tier(start, start + timedelta(hours=hours)) == tier
    assert values(spark, C.tier_of(F.lit(start), F.lit(start + timedelta(hours=hours)))) == tier
    assert rollup.tier(start, start + timedelta(hours=1), "daily") == "daily"


@pytest.mark.parametrize(("text", "address"), [(" 192.168.12.53:5075 ", "192.168.12.53:5075"), ("192.168.12.53", "192.168.12.53:5075"), ("[::1]:5075", "[::1]:5075")])
def test_good_address(spark, text, address):
    assert values(spark, C.normalize_address(F.lit(text)))["address"] == address


@pytest.mark.parametrize("text", ["host.example", "10.0.0.999", "10.0.0.1:99999", "10.0.0.1:", "  ", "10.0. 0.1"])
def test_bad_address(spark, text):
    out = values(spark, C.normalize_address(F.lit(text)))
    assert out["address"] is None and out["error"]


@pytest.mark.parametrize(("value", "severity"), [(9, 0), (10, 0), (11, 0), (8, 1), (6, 1), (5, 2), (0, 2), (-100, 2), (12, 1), (14, 1), (15, 2), (100, 2)])
def test_value_alarm(spark, value, severity):
    limits = [F.lit(float(x)) for x in (5, 8, 12, 15)]
    assert values(spark, C.value_alarm(F.lit(float(value)), F.lit(True), *limits)) == severity
    assert values(spark, C.value_alarm(F.lit(float(value)), F.lit(False), *limits)) == 0


@pytest.mark.parametrize(
    ("declared", "enabled", "total", "live", "lost", "gone", "state"),
    [(1, 1, 15, 15, 0, 0, "UP"), (1, 1, 15, 14, 1, 0, "DEGRADED"), (1, 1, 17, 0, 17, 0, "DOWN"), (1, 1, 5, 0, 0, 0, "CONNECTING"), (1, 0, 5, 5, 0, 0, "DISABLED"), (1, 1, 0, 0, 0, 0, "IDLE"), (1, 1, 4, 0, 0, 4, "IDLE"), (0, 0, 3, 3, 0, 0, "UP")],
)
def test_ioc_state(spark, declared, enabled, total, live, lost, gone, state):
    assert values(spark, C.ioc_state(F.lit(bool(declared)), F.lit(bool(enabled)), F.lit(total), F.lit(live), F.lit(lost), F.lit(gone))) == state


def test_zip_stops_at_the_shorter(spark):
    rows = spark.createDataFrame([(1, ["a", "b"], [1.0]), (2, None, [1.0]), (3, [], [])], "k int, n array<string>, v array<double>")
    assert [tuple(r) for r in reshape.zipped(rows, {"name": "n", "value": "v"}, ["k"]).collect()] == [(1, 0, "a", 1.0)]


def test_non_finite(spark):
    rows = spark.createDataFrame([(0.0,), (float("nan"),), (float("inf"),), (float("-inf"),)], "v double")
    assert [r[0] for r in rows.select(C.non_finite(F.col("v"))).collect()] == [False, True, True, True]


def heartbeat_rows(spark, ages, overrides, default):
    now = datetime(2024, 1, 1, 12)
    samples = spark.createDataFrame([(k + 1, now - timedelta(seconds=a), 4.2, 3, 7, k) for k, a in enumerate(ages)], "pv_id int, time timestamp_ntz, value double, severity short, status short, tiebreak long")
    over = spark.createDataFrame(overrides, "pv_id int, heartbeat_s double")
    return lifecycle.heartbeats(samples, default, over, now).collect()


def test_heartbeats(spark):
    assert {r.pv_id for r in heartbeat_rows(spark, [2, 2], [(2, 1.0)], 60.0)} == {2}
    assert {r.pv_id for r in heartbeat_rows(spark, [2, 2], [(2, 0.0)], 0.5)} == {1}
    assert {r.pv_id for r in heartbeat_rows(spark, [5, 15, 5], [(3, 3.0)], 10.0)} == {2, 3}
    assert all((r.value, r.severity, r.status, r.reason) == (4.2, 3, 7, 1) for r in heartbeat_rows(spark, [2], [], 1.0))
    assert heartbeat_rows(spark, [], [], 1.0) == []


def test_changes_skip_empty_names(spark):
    rows = spark.createDataFrame([("add:a,b",), ("del:x",), ("add:,",), ("other:y",), ("add",)], "payload string")
    assert sorted(tuple(r) for r in reconcile.changes(rows).collect()) == [("add", "a"), ("add", "b"), ("del", "x")]
