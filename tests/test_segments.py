"""Scans in ranges against windows."""

from datetime import datetime

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from pvspark.operators import lifecycle, reshape, segments
from pvspark.operators.segments import scanned


@pytest.fixture(scope="module")
def rows(spark):
    """Nine tenths of the rows are of one key; nulls, and keys with a single row."""
    hot = spark.range(6000).selectExpr(
        "CASE WHEN id % 10 <> 0 THEN 7 WHEN id % 30 = 0 THEN NULL WHEN id < 5000 THEN id % 50 ELSE id END AS pv_id", "timestamp_ntz '2024-01-01' + make_interval(0,0,0,0,0,0, id DIV 3) AS time", "id * 37 % 6000 AS tiebreak",
        "IF(id % 7 = 0, id / 2.0, NULL) AS value", "CAST(IF(id % 900 = 0, id % 4, NULL) AS SMALLINT) AS severity", "IF(id % 11 = 0, 'x', NULL) AS text", "array(CAST(id % 5 AS DOUBLE)) AS numbers",
    )
    return hot.repartition(5).cache()


def same(a, b):
    key = lambda df: sorted(map(repr, map(tuple, df.select(*sorted(df.columns)).collect())))
    return sorted(a.columns) == sorted(b.columns) and key(a) == key(b)


@pytest.mark.parametrize("ranges", [1, 2, 16, None])
def test_scans_equal_windows(rows, ranges):
    w = Window.partitionBy("pv_id").orderBy("time", "tiebreak")
    so_far, later = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(1, Window.unboundedFollowing)
    expect = rows.select(
        "pv_id", "time", "tiebreak", "numbers", F.lag("text").over(w).alias("before"), F.lag("numbers").over(w).alias("array_before"), F.lead("time").over(w).alias("until"), F.first("text", True).over(later).alias("next_text"),
        (F.row_number().over(w) - 1).alias("place"), *(F.last(c, True).over(so_far).alias(c) for c in ("value", "severity", "text")),
    )
    got = scanned(rows, "pv_id", ["time", "tiebreak"], filled=["value", "severity", "text"], before={"before": "text", "array_before": "numbers"}, after={"until": "time"}, coming={"next_text": "text"}, number="place", ranges=ranges)
    assert same(got, expect.withColumn("place", F.col("place").cast("long")))


def test_a_hot_key_spreads_over_all_ranges(rows):
    out = scanned(rows, "pv_id", ["time", "tiebreak"], number="place", ranges=16)
    path = next(iter(out.inputFiles())).rpartition("/")[0]
    ranges = rows.sparkSession.read.parquet(path).withColumn("r", F.shiftright("__at", 33)).groupBy("r").agg(F.count("*").alias("n"), F.count_if(F.col("pv_id") == 7).alias("hot")).collect()
    assert len(ranges) == 16 and max(r.n for r in ranges) < 2 * rows.count() / 16
    assert sum(r.hot > 0 for r in ranges) >= 14


def test_empty_tables_scan_to_none(rows):
    none = scanned(rows.where("tiebreak < 0"), "pv_id", ["time"], filled=["value"], number="n")
    assert none.count() == 0 and set(none.columns) == {*rows.columns, "n"}


@pytest.mark.parametrize("largest", [100, 10**6])
def test_operators_on_a_hot_signal(spark, rows, monkeypatch, largest):
    monkeypatch.setattr(segments, "LARGEST", largest)
    w = Window.partitionBy("pv_id").orderBy("time", "tiebreak")
    filled = reshape.carried_forward(rows, ["value", "severity"])
    plan = filled._jdf.queryExecution().optimizedPlan().toString()
    assert ("__range" in plan) == (largest == 100)
    assert same(filled, rows.withColumns({c: F.last(c, True).over(w.rowsBetween(Window.unboundedPreceding, 0)) for c in ("value", "severity")}))
    events = rows.select("pv_id", F.col("time").alias("ts"), F.col("tiebreak").alias("event_id"), (F.col("tiebreak") % 5).cast("int").alias("event_type"))
    whole, now = rows.where("pv_id IS NOT NULL").withColumns({"value": F.lit(1.0), "status": F.lit(0)}), datetime(2024, 1, 2)
    every = spark.createDataFrame([], "pv_id int, heartbeat_s double")
    marked = whole.withColumn("since", F.lit(None).cast("timestamp_ntz"))
    for made in (lambda d: lifecycle.timeouts(d, 40.0, now), lambda d: lifecycle.heartbeats(d.where("pv_id > 40"), 500.0, every, now)):
        assert same(made(whole), made(marked)) and made(whole).count() > 40
    v = Window.partitionBy("pv_id").orderBy("ts", "event_id")
    kept = events.where("event_type IN (3, 4)").withColumn("b", F.lag("event_type").over(v)).where("b IS NULL OR b <> event_type").withColumn("until", F.lead("ts").over(v))
    assert same(lifecycle.connectivity_intervals(events), kept.where("event_type = 3").select("pv_id", F.col("ts").alias("down_at"), F.col("until").alias("up_at")))
