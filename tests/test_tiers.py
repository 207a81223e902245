"""Stored tiers with rows that come late, and reads that go on where the tiers end."""

from datetime import datetime, timedelta

import pytest
from conftest import spark_rows
from pyspark.sql import functions as F

from pvspark.operators import rollup
from pvspark.sources import tables

DAYS = 20


@pytest.fixture(scope="module")
def samples(spark):
    rows = spark.range(6000).selectExpr("timestamp_ntz '2024-01-01' + make_interval(0,0,0,0,0,0, id * 288) AS time", "CAST(IF(id % 3 = 0, 1, id % 40) AS INT) AS pv_id", "CAST(id * 7 % 1000 AS DOUBLE) AS value", "CAST(id % 4 AS SMALLINT) AS severity", "id AS tiebreak")
    return rows.cache()


def files(spark, root, tier):
    return {f.rpartition("/")[2]: f.split("date=")[1][:10] for f in spark.read.parquet(f"{root}/{tier}").inputFiles()}


def test_late_rows_reach_both_tiers_and_leave_other_dates_alone(spark, samples):
    root, late = tables.folder(spark), (F.col("time") >= "2024-01-05 10:00:00") & (F.col("time") < "2024-01-05 12:00:00") & (F.col("pv_id") != 3)
    tables.write_tiers(samples.where(~late), root, datetime(2024, 1, 21))
    before = {t: files(spark, root, t) for t in ("hourly", "daily")}
    n = tables.refresh_late(samples, samples.where(late), root)
    assert n == samples.where(late).select(F.date_trunc("hour", "time"), "pv_id").distinct().count()
    hours = rollup.hourly(samples)
    for tier, expect in (("hourly", hours), ("daily", rollup.daily(hours))):
        cols = [c for c in expect.columns if not c.startswith(("avg", "stddev", "sum"))]
        assert spark_rows(tables.read_tier(spark, root, tier).select(*cols)) == spark_rows(expect.select(*cols))
        after = files(spark, root, tier)
        assert {f: d for f, d in before[tier].items() if d != "2024-01-05"} == {f: d for f, d in after.items() if d != "2024-01-05"}
    assert tables.refresh_late(samples, samples.limit(0), root) == 0


@pytest.mark.parametrize("cut", [datetime(2024, 1, 9), datetime(2024, 1, 9, 13, 20), datetime(2024, 1, 1, 0, 30)])
@pytest.mark.parametrize("span", [(None, None), (datetime(2024, 1, 3), datetime(2024, 1, 8)), (datetime(2024, 1, 3, 5), datetime(2024, 1, 15, 7)), (datetime(2024, 1, 12), None)])
def test_live_reads_equal_roll_ups_of_all_samples(spark, samples, cut, span):
    root, (start, end) = tables.folder(spark), span
    tables.write_tiers(samples.where(F.col("time") < F.lit(cut)), root, cut)
    hours = rollup.hourly(samples)
    for tier, expect in (("hourly", hours), ("daily", rollup.daily(hours))):
        if start:
            expect = expect.where(F.col("bucket") >= F.lit(start))
        if end:
            expect = expect.where(F.col("bucket") < F.lit(end))
        cols = [c for c in expect.columns if not c.startswith(("avg", "stddev", "sum"))]
        assert spark_rows(tables.read_live(spark, root, tier, samples, start, end).select(*cols)) == spark_rows(expect.select(*cols))


def test_a_range_before_the_mark_reads_no_samples(spark, samples):
    root = tables.folder(spark)
    tables.write_tiers(samples, root)
    plan = tables.read_live(spark, root, "daily", samples, datetime(2024, 1, 2), datetime(2024, 1, 9))._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and "Aggregate" not in plan
    assert tables.marks(spark, root)["daily"] == datetime(2024, 1, 20) and tables.marks(spark, root)["hourly"] > datetime(2024, 1, 20, 22)
    tables.set_mark(spark, root, datetime(2024, 1, 4))
    assert tables.marks(spark, root)["daily"] == datetime(2024, 1, 20)  # an older mark changes nothing
    assert timedelta(0) < datetime(2024, 1, 21) - tables.marks(spark, root)["hourly"] <= timedelta(hours=1)
