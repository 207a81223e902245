"""Streams over folders of files, rows by due times, and tables that change by buckets."""

import shutil
from pathlib import Path

import pytest
from conftest import DATA, spark_rows
from pyspark.sql import functions as F
from test_archive_operators import SAMPLES, in_batches, samples

from pvspark.operators import lifecycle
from pvspark.plans import queries as q
from pvspark.sources.tables import folder
from pvspark.streaming import jobs

STREAMS = ["streaming_rollup", "streaming_status", "streaming_status_fold", "streaming_timeouts", "streaming_heartbeats", "streaming_status_table", "streaming_config_changes", "retry_safe_write"]


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    """The tables, those of the streams as folders of three files."""
    to = tmp_path_factory.mktemp("folders")
    for file in Path(DATA).glob("*.parquet"):
        if file.stem in ("events", "supplier"):
            spark.read.parquet(str(file)).repartition(3).write.parquet(str(to / file.name))
        else:
            shutil.copy(file, to)
    assert len(list((to / "events.parquet").glob("part-*"))) == 3
    return str(to)


@pytest.mark.parametrize("name", STREAMS)
def test_streams_read_a_folder_as_they_read_a_file(spark, folders, name):
    assert spark_rows(q.queries()[name](spark, folders)) == spark_rows(q.queries()[name](spark, DATA))


def test_all_streams_are_covered():
    assert {n for n in q.queries() if n.startswith("streaming") or n == "retry_safe_write"} == set(STREAMS)


@pytest.mark.parametrize("kind", ["heartbeats", "timeouts"])
def test_each_batch_makes_its_own_rows_only(spark, kind):
    """What emit makes over ten batches is what is written, and signals that aren't due are left where they are."""
    df, made = samples(spark), []
    every = spark.createDataFrame([(0, 600.0), (1, 7.0), (2, -1.0), (3, None)], "pv_id int, heartbeat_s double")

    def emit(rows, now):
        out = lifecycle.heartbeats(rows, 900.0, every, now) if kind == "heartbeats" else lifecycle.timeouts(rows, 1800.0, now)
        made.append(out.where(F.col("time") < F.lit(now).cast("timestamp_ntz")).count())
        return out

    def due(last, now):
        return lifecycle.heartbeats_due(last, 900.0, every, now) if kind == "heartbeats" else lifecycle.timeouts_due(last, 1800.0, now)

    out = jobs.carried(in_batches(spark, df, "time", SAMPLES, 6), jobs.gaps(emit, due=due), jobs.OPEN)
    now = df.agg(F.max("time")).first()[0]
    whole = df.withColumn("time", F.col("time").cast("timestamp_ntz"))
    expect = lifecycle.heartbeats(whole, 900.0, every, now) if kind == "heartbeats" else lifecycle.timeouts(whole, 1800.0, now)
    expect = sorted((r.time, r.pv_id) for r in expect.where(F.col("time") < F.lit(now).cast("timestamp_ntz")).collect())
    assert sorted((r.time, r.pv_id) for r in out.collect()) == expect
    assert sum(made) == len(expect)


def test_silent_signals_sleep_until_they_are_due(spark):
    def at(rows):
        rows = spark.createDataFrame(rows, "pv_id int, s long, value double")
        return rows.select("pv_id", F.timestamp_seconds("s").alias("time"), F.col("s").alias("tiebreak"), "value", *(F.lit(0).cast("smallint").alias(c) for c in ("severity", "status")))

    none = spark.createDataFrame([], "pv_id int, heartbeat_s double")
    step = jobs.gaps(lambda d, now: lifecycle.heartbeats(d, 1000.0, none, now), due=lambda d, now: lifecycle.heartbeats_due(d, 1000.0, none, now))
    out, kept = step(spark.createDataFrame([], jobs.OPEN), at([(1, 0, 1.0), (2, 100, 2.0), (3, 100, float("nan"))]))
    rest = {r.pv_id: r.due for r in kept.collect()}
    assert out.count() == 0 and rest[3] is None or rest[3].timestamp() == 100  # a sample at the clock itself waits for the next batch
    out, new = step(kept, at([(4, 999, 1.0)]))
    assert out.count() == 0 and {r.pv_id for r in new.collect()} == {2, 3, 4}  # those at the clock before; signal 1 is not touched
    kept = kept.where("pv_id = 1").unionByName(new)
    out, new = step(kept, at([(4, 1050, 1.0)]))
    assert [r.pv_id for r in out.collect()] == [1] and {r.pv_id for r in new.collect()} == {1, 4}


@pytest.mark.parametrize("n", [1, 5])
def test_the_status_table_does_not_depend_on_batches(spark, n):
    df = samples(spark, n=900)
    known = spark.range(6).selectExpr("CAST(id AS INT) AS pv_id", "CAST(2 AS SMALLINT) AS state", *(f"CAST(NULL AS {t}) AS {c}" for c, t in jobs.STATUS_VALUES.items()), "0L AS events_total")
    known = known.unionByName(known.limit(1).withColumn("pv_id", F.lit(77)))
    table = jobs.carried_table(in_batches(spark, df, "time", SAMPLES, n), jobs.status_table, known.schema, known)
    rows = [(r.pv_id, r.time.timestamp(), r.tiebreak, r.value) for r in df.collect()]
    expect = {}
    for pv, t, k, v in sorted(rows, key=lambda r: (r[1], r[2])):
        total, window, count, _ = expect.get(pv, (0, None, 0, None))
        expect[pv] = (total + 1, t // 30, count + 1 if window == t // 30 else 1, v)
    got = {r.pv_id: (r.events_total, r.update_hz, r.last_value, r.state) for r in table.collect()}
    assert got == {pv: (total, count / 30.0, v, 3) for pv, (total, _, count, v) in expect.items()} | {77: (0, None, None, 2)}


def test_a_batch_writes_the_buckets_it_changes(spark):
    path, schema = folder(spark), "pv_id int, event_id long, event_type int, ts timestamp"
    rows = spark.range(500).selectExpr("CAST(IF(id < 400, id, 7) AS INT) AS pv_id", "id AS event_id", "CAST(IF(id < 400, 0, 2) AS INT) AS event_type", "timestamp_seconds(id) AS ts")
    stream = in_batches(spark, rows, "event_id", schema, 5)
    jobs.continued(stream, jobs.status, jobs.STATES, path, folder(spark)).awaitTermination()
    table = {r.pv_id: r.state for r in jobs.kept_table(spark, path, jobs.STATES).collect()}
    assert len(table) == 400 and table[7] == lifecycle.ARCHIVING and table[8] == lifecycle.SEARCHING
    versions = jobs._versions(spark, path)
    hot = spark.sql(f"SELECT pmod(xxhash64(7), {jobs.BUCKETS})").first()[0]
    assert versions[hot][-1] == 4 and all(len(v) <= 2 for v in versions.values())
    assert all(v[-1] < 4 for b, v in versions.items() if b != hot)
