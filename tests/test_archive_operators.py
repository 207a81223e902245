"""Operators of the archive against plain loops."""

import time
from datetime import datetime

import numpy as np
import pytest
from conftest import DATA
from pyspark.errors import StreamingQueryException
from pyspark.sql import Window
from pyspark.sql import functions as F

from pvspark.operators import catalog, lifecycle, reconcile, reshape, upkeep
from pvspark.plans import queries as q
from pvspark.sources.tables import folder
from pvspark.streaming import jobs


def step(state, code):
    """The state after an event, one at a time."""
    free = {0: 1, 2: 3, 4: 3, 3: 4, 6: 6, 7: 6}
    if code == 1 and state in (0, 1, 4, 5):
        return 2
    if code == 5 and state == 3:
        return 5
    return free.get(code, state)


def alerts(ns, gap):
    out = []
    for n in sorted(ns):
        if not out or n - out[-1] >= gap:
            out.append(n)
    return out


@pytest.mark.parametrize("chunk", [30, 47, 8640])
def test_throttle_in_runs_equals_a_loop(spark, chunk):
    rng = np.random.default_rng(2)
    ns = sorted({*rng.integers(0, 3000, 500).tolist(), *range(4000, 4200), *rng.integers(10_000, 90_000, 300).tolist()})
    windows = spark.createDataFrame([(n, True) for n in ns] + [(3500, False)], "n long, grew boolean")
    assert sorted(r.n for r in upkeep.throttled(windows, 30, chunk).collect()) == alerts(ns, 30)
    assert upkeep.throttled(windows.where("not grew"), 30, chunk).count() == 0


def test_loss_alerts_go_by_ticks_of_ten_seconds(spark):
    seconds = [0, 5, 12, 299, 301, 302, 640, 90_000, 90_011, 90_300]
    rows = spark.createDataFrame([(s, o) for s in seconds for o in ("written", "lost")] + [(950, "written")], "s long, outcome string")
    rows = rows.select(F.timestamp_seconds("s").cast("timestamp_ntz").alias("time"), "outcome")
    got = sorted(r.n for r in upkeep.loss_alerts(rows).collect())
    assert got == alerts({s // 10 for s in seconds}, 30) == [0, 30, 64, 9000, 9030]


def test_status_fold_equals_a_loop_without_lists(spark):
    rng = np.random.default_rng(3)
    rows = [(pv, f"2024-01-{1 + k // 4:02d} 00:00:0{k % 2}", k, code) for pv in range(600) for k, code in enumerate(rng.choice([0, 1, 1, 2, 3, 4, 5, 5, 5, 6, 7, 9], rng.integers(1, 9)).tolist())]
    rows += [(None, "2024-01-01 00:00:00", 1, 2), (900, None, 1, 5), (901, "2024-01-01 00:00:00", 1, None)]
    expect = {}
    for pv, _, _, code in sorted(rows, key=lambda r: (r[1] or "", r[2])):
        expect[pv] = step(expect.get(pv, lifecycle.INIT), code)
    events = spark.createDataFrame(rows, "pv_id int, ts string, event_id long, event_type int").withColumn("ts", F.to_timestamp("ts")).repartition(3)
    folded = lifecycle.status_fold(events)
    assert {r.pv_id: r.state for r in folded.collect()} == expect and len(set(expect.values())) == 7
    for df in (folded, q.queries()["status_fold"](spark, DATA), q.queries()["table_shape"](spark, DATA)):
        assert "collect_list" not in df._jdf.queryExecution().optimizedPlan().toString()


def in_batches(spark, df, order, schema, n):
    """A stream of df with one of n files, by an order, in each micro-batch."""
    path = folder(spark)
    ranked = df.withColumn("_k", F.ntile(n).over(Window.orderBy(order)))
    for k in range(1, n + 1):
        ranked.where(F.col("_k") == k).drop("_k").coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.02)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_status_stream_carries_states_over_batches(spark):
    rng = np.random.default_rng(4)
    rows = [(pv if pv else None, k, int(code)) for pv in range(200) for k, code in enumerate(rng.choice([0, 1, 1, 2, 3, 4, 5, 5, 5, 6, 7, 9], rng.integers(1, 15)))]
    expect = {}
    for pv, _, code in rows:
        expect[pv] = step(expect.get(pv, lifecycle.INIT), code)
    schema = "pv_id int, event_id long, event_type int, ts timestamp"
    df = spark.createDataFrame(rows, "pv_id int, event_id long, event_type int").withColumn("ts", F.timestamp_seconds("event_id"))
    out = jobs.carried(in_batches(spark, df, "event_id", schema, 5), jobs.status, jobs.STATES)
    assert out.select("batch").distinct().count() == 5
    newest = out.groupBy("pv_id").agg(F.max_by("state", "batch").alias("state")).collect()
    assert {r.pv_id: r.state for r in newest} == expect and len(set(expect.values())) == 7


SAMPLES = "pv_id int, time timestamp, tiebreak long, value double, severity smallint, status smallint"


def samples(spark, seed=5, n=400):
    rng = np.random.default_rng(seed)
    at = np.sort(rng.integers(0, 90_000, n))
    df = spark.createDataFrame([(int(rng.integers(0, 6)), int(t), k, float(rng.integers(0, 9))) for k, t in enumerate(at)], "pv_id int, s long, tiebreak long, value double")
    return df.select("pv_id", F.timestamp_seconds("s").alias("time"), "tiebreak", "value", F.lit(0).cast("smallint").alias("severity"), F.lit(0).cast("smallint").alias("status"))


@pytest.mark.parametrize("n", [1, 7])
def test_streams_of_timeouts_and_heartbeats_equal_the_batch_operators(spark, n):
    df = samples(spark)
    now = df.agg(F.max("time")).first()[0]
    whole = df.withColumn("time", F.col("time").cast("timestamp_ntz"))
    every = spark.createDataFrame([(0, 600.0), (1, 7.0), (2, -1.0), (3, None)], "pv_id int, heartbeat_s double")
    for emit in (lambda d, at: lifecycle.timeouts(d, 1800.0, at), lambda d, at: lifecycle.heartbeats(d, 900.0, every, at)):
        out = jobs.carried(in_batches(spark, df, "time", SAMPLES, n), jobs.gaps(emit), jobs.OPEN)
        expect = emit(whole, now).where(F.col("time") < F.lit(now).cast("timestamp_ntz"))
        key = lambda rows: sorted((r.time, r.pv_id) for r in rows)
        assert key(out.collect()) == key(expect.collect()) and expect.count() > 20


def test_late_samples_count_within_the_bound(spark):
    seconds = [[0, 100], [500], [130, 50, 700], [1000]]
    out, kept = [], spark.createDataFrame([], jobs.OPEN)
    for k, batch in enumerate(seconds):
        rows = spark.createDataFrame([(1, s, s, 1.0) for s in batch], "pv_id int, s long, tiebreak long, value double")
        rows = rows.select("pv_id", F.timestamp_seconds("s").alias("time"), "tiebreak", "value", *(F.lit(0).cast("smallint").alias(c) for c in ("severity", "status")))
        new, kept = jobs.gaps(lambda d, at: lifecycle.timeouts(d, 90.0, at), late_s=400)(kept, rows)
        out += [int(r.t) for r in new.select(F.unix_seconds(F.col("time").cast("timestamp")).alias("t")).collect()]
    # The sample at 50 comes when the clock is at 100 and goes; the one at 130 counts. The clock ends at 600.
    assert sorted(out) == [90, 220, 590]


def test_no_rows_at_all_give_no_gaps(spark):
    none = spark.createDataFrame([], SAMPLES)
    out, kept = jobs.gaps(lambda d, at: lifecycle.timeouts(d, 90.0, at))(spark.createDataFrame([], jobs.OPEN), none)
    assert out.count() == kept.count() == 0


def test_a_failed_write_is_made_again_and_doubles_nothing(spark):
    df, path, checkpoint, failed = samples(spark), folder(spark), folder(spark), []
    stream = in_batches(spark, df, "time", SAMPLES, 4)

    def fail(number):
        if number in (0, 2) and failed.count(number) < 2:
            failed.append(number)
            raise OSError("the write failed")

    assert jobs.retried(lambda: jobs.written(stream, path, checkpoint, "append", fail), waits=(0, 0, 0, 0)) == 4
    assert failed == [0, 0, 2, 2] and spark.read.parquet(path).count() == df.count()
    with pytest.raises(StreamingQueryException):
        jobs.retried(lambda: jobs.written(stream, path, folder(spark), "append", lambda number: 1 / 0), waits=(0,))


def test_long_silence_makes_heartbeats_in_runs(spark):
    df = samples(spark, n=1).withColumn("time", F.timestamp_seconds(F.lit(0)).cast("timestamp_ntz"))
    every = spark.createDataFrame([], "pv_id int, heartbeat_s double")
    beats = lifecycle.heartbeats(df, 1.0, every, datetime(1970, 1, 2))
    assert beats.count() == 86_399 and beats.agg(F.max("time")).first()[0] == datetime(1970, 1, 1, 23, 59, 59)


def test_array_change_points(spark):
    rows = [(1, 0, [1.0, 2.0]), (1, 1, [1.0, 2.0]), (1, 2, [1.0, 2.5]), (1, 3, [1.0]), (1, 4, None), (1, 5, None), (1, 6, [0.0]), (2, 0, None)]
    df = spark.createDataFrame(rows, "pv_id int, time int, value array<double>").withColumn("tiebreak", F.lit(0))
    got = {(r.pv_id, r.time): r.reason for r in reshape.array_change_points(df).collect()}
    assert got == {(1, 0): 2, (1, 2): 6, (1, 3): 6, (1, 4): 6, (1, 6): 6, (2, 0): 2}
    assert (1, 2) not in {(r.pv_id, r.time) for r in reshape.array_change_points(df, 0.5).collect()}


def test_poll_without_changes_only_retries_what_is_pending(spark):
    config = spark.createDataFrame([("a", True, 1), ("b", True, 1), ("c", False, 1)], "pv_name string, enabled boolean, d int")
    config = config.select("*", *(F.lit(None).cast("string").alias(c) for c in ("description", "unit", "expected_ioc")), F.lit(1.0).alias("heartbeat_s"), F.lit(datetime(2024, 1, 1)).alias("updated_at"))
    state = spark.createDataFrame([("a", "resolved", False), ("b", "lost", False), ("c", "lost", False), ("d", "not_found", False)], "pv_name string, state string, warned boolean")
    before = config.where("pv_name <> 'a'")
    got = lambda since: sorted((r.pv_name, r.change, r.action) for r in reconcile.polled(before, config, since, state).collect())
    assert got(datetime(2024, 1, 2)) == [("b", "pending", "resolve")]
    assert got(datetime(2023, 1, 1)) == [("a", "added", "resolve"), ("b", "pending", "resolve")]


def test_metadata_of_odd_payloads(spark):
    rows = [("a", "scalar", None), ("b", "enum", "{}"), ("c", "continuum", '{"units": []}'), ("d", "table", '{"columns": []}'), ("e", "unheard_of", '{"descriptor": "x"}'), ("f", "scalar", "not json"), ("g", "matrix", '{"value": [1, 2], "dim": [2]}')]
    got = {r.pv_name: r for r in catalog.extracted(spark.createDataFrame(rows, "pv_name string, nt_type string, data string")).collect()}
    assert len(got) == 7 and all(r.display_high == 0 and r.units == "" and r.description == "" for r in got.values())
    assert (got["b"].scalar_type, got["b"].enum_choices, got["c"].array_size, got["d"].array_size, got["e"].scalar_type) == ("int", [], 0, 0, None)
    assert got["g"].array_size == 2 and got["g"].dimensions == []


def test_captures_are_cut_and_keep_their_places(spark, monkeypatch):
    monkeypatch.setattr(q, "CHUNK", 7)
    rows = spark.range(100).select((F.col("id") % 2).alias("k"), "id", (F.col("id") * 3).alias("v"))
    parts = q.captured(rows, "k", ["id"], value="v")
    assert parts.agg(F.max(F.size("value"))).first()[0] == 7
    got = sorted((r.k, r.idx, r.value) for r in q.placed(parts, {"value": "value"}, "k").collect())
    assert got == [(k, i, 3 * (2 * i + k)) for k in (0, 1) for i in range(50)]


def test_channels_without_a_severity_have_none(spark):
    rows = spark.createDataFrame([(1, ["a", "b", "c"], [1.0, 2.0, 3.0], [2]), (2, ["a", "b"], [1.0], None), (3, None, [1.0], [1])], "k int, n array<string>, v array<double>, s array<int>")
    got = sorted(map(tuple, reshape.zipped(rows, {"name": "n", "value": "v"}, ["k"], {"severity": ("s", 0)}).collect()))
    assert got == [(1, 0, "a", 1.0, 2), (1, 1, "b", 2.0, 0), (1, 2, "c", 3.0, 0), (2, 0, "a", 1.0, 0)]


def test_upserts_take_the_most_recent_row(spark):
    table = spark.createDataFrame([("a", 1, 5), ("b", 2, 3), (None, 3, 1)], "k string, at int, least int")
    new = spark.createDataFrame([("a", 7, 9), ("a", 8, 6), ("a", 8, 6), ("c", None, 2), ("c", 1, 4), (None, 9, 9)], "k string, at int, least int")
    got = sorted(map(repr, map(tuple, catalog.upserted(table, new, "k", "at", "least").collect())))
    assert got == sorted(map(repr, [("a", 8, 5), ("b", 2, 3), ("c", 1, 2), (None, 9, 1)]))


@pytest.mark.parametrize("name", ["status_fold", "pv_stats", "aggregate_payload", "hourly_rollup", "latest_value"])
def test_plans_aggregate_by_hash(spark, name):
    df = q.queries()[name](spark, DATA)
    assert "SortAggregate" not in df._jdf.queryExecution().executedPlan().toString()
