"""Upkeep of tables by their files."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from pvspark.sources import files
from pvspark.sources.tables import folder


@pytest.fixture
def table(spark):
    """Four dates, the first with three small files and one large one, the others with one file each."""
    root = folder(spark)
    rows = spark.range(4000).selectExpr("id", "id % 7 AS pv_id", "IF(id % 10 = 0, NULL, id % 3) AS level", "date_add(DATE'2024-01-01', CAST(id DIV 1000 AS INT)) AS date")
    rows.where("id >= 300").coalesce(1).write.partitionBy("date").parquet(root)
    for k in range(3):
        rows.where(f"id DIV 100 = {k}").coalesce(1).write.mode("append").partitionBy("date").parquet(root)
    return root


def state(spark, root):
    return {r.path: r.length for r in files.listing(spark, root).collect()}


def ids(spark, root):
    return sorted(r.id for r in spark.read.parquet(root).select("id").collect())


def test_packing_reads_small_files_only(spark, table):
    before = state(spark, table)
    large = {p for p, n in before.items() if "2024-01-01" not in p} | {max((p for p in before if "2024-01-01" in p), key=before.get)}
    assert files.packed(spark, table, ["pv_id"], small=min(before[p] for p in large)) == {"read": 3, "written": 1}
    after = state(spark, table)
    assert large < set(after) and len(after) == len(before) - 2 and ids(spark, table) == list(range(4000))
    assert files.packed(spark, table, ["pv_id"], small=min(before[p] for p in large)) == {"read": 0, "written": 0}


def test_old_dates_go_whole(spark, table):
    before = state(spark, table)
    assert files.dropped(spark, table, date(2024, 1, 3)) == [date(2024, 1, 1), date(2024, 1, 2)]
    assert set(state(spark, table)) == {p for p in before if "2024-01-03" in p or "2024-01-04" in p} and ids(spark, table) == list(range(2000, 4000))
    assert files.dropped(spark, table, date(2024, 1, 3)) == []


def test_updates_write_files_with_changes_only(spark, table):
    before = state(spark, table)
    got = files.updated(spark, table, (F.col("id") >= 1500) & (F.col("id") < 1600), {"level": F.lit(2)})
    expect = [None if k % 10 == 0 else k % 3 for k in range(1500, 1600)]
    assert got == {"matched": 100, "changed": sum(x != 2 for x in expect), "files": 1}
    assert {p for p in before if "2024-01-02" not in p} < set(state(spark, table)) and ids(spark, table) == list(range(4000))
    assert spark.read.parquet(table).where("level = 2 AND id BETWEEN 1500 AND 1599").count() == 100
    after = state(spark, table)
    assert files.updated(spark, table, (F.col("id") >= 1500) & (F.col("id") < 1600), {"level": F.lit(2)}) == {"matched": 100, "changed": 0, "files": 0}
    assert files.updated(spark, table, F.col("id") == -1, {"level": F.lit(2)}) == {"matched": 0, "changed": 0, "files": 0}
    assert state(spark, table) == after


def test_deletes_count_and_keep_what_is_unknown(spark, table):
    assert files.deleted(spark, table, F.col("level") == 1) == {"deleted": sum(k % 10 != 0 and k % 3 == 1 for k in range(4000)), "files": 7}
    assert ids(spark, table) == [k for k in range(4000) if k % 10 == 0 or k % 3 != 1]  # a null level is not a hit
    assert files.deleted(spark, table, F.col("level") == 1) == {"deleted": 0, "files": 0}
    assert files.deleted(spark, table, F.col("date") == F.lit(date(2024, 1, 4)))["files"] == 1 and max(ids(spark, table)) < 3000


def test_a_swap_that_broke_off_is_carried_out(spark, table, monkeypatch):
    """The driver dies after the record, in the middle of the swap."""
    calls, real = [], files.delete

    def dies(spark, path):
        calls.append(path)
        if len(calls) == 2:
            raise KeyboardInterrupt
        real(spark, path)

    monkeypatch.setattr(files, "delete", dies)
    with pytest.raises(KeyboardInterrupt):
        files.deleted(spark, table, F.col("id") < 1500)
    monkeypatch.setattr(files, "delete", real)
    assert files.recovered(spark, table) == 1 and files.recovered(spark, table) == 0
    assert ids(spark, table) == list(range(1500, 4000))


def test_a_write_that_broke_off_before_its_record_changes_nothing(spark, table, monkeypatch):
    monkeypatch.setattr(files.json, "dumps", lambda x: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        files.deleted(spark, table, F.col("id") < 1500)
    monkeypatch.undo()
    assert ids(spark, table) == list(range(4000))
    files.recovered(spark, table)
    assert ids(spark, table) == list(range(4000))


def test_storage_counts_files_bytes_and_rows(spark, table):
    (whole,) = files.storage(spark, {"t": table}).collect()
    assert (whole.files, whole.rows, whole.bytes) == (7, 4000, sum(state(spark, table).values()))
    assert {str(r.date): (r.files, r.rows) for r in files.storage(spark, {"t": table}, by_date=True).collect()} == {"2024-01-01": (4, 1000), "2024-01-02": (1, 1000), "2024-01-03": (1, 1000), "2024-01-04": (1, 1000)}


def test_tables_without_dates(spark):
    root = folder(spark)
    spark.range(100).selectExpr("id", "id % 2 = 0 AS enabled").repartition(4, "id").write.parquet(root)
    assert files.updated(spark, root, F.col("id") == 5, {"enabled": F.lit(True)}) == {"matched": 1, "changed": 1, "files": 1}
    assert files.packed(spark, root, ["id"])["read"] == 4 and len(state(spark, root)) < 4
    assert ids(spark, root) == list(range(100)) and spark.read.parquet(root).where("enabled").count() == 51
