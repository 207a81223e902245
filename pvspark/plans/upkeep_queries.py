"""Queries over upkeep by files: tables are written, changed or packed by files, and what became of them is read again."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from pvspark.operators import ingest
from pvspark.plans.ingest_queries import BY, U, archive
from pvspark.plans.registry import query
from pvspark.sources import files, tables
from pvspark.sources.bindings import NOW


def written(b, rows, time: str, parts: int = 1) -> str:
    """A table of rows by date with a file for each date and part: a row's part is its time's second modulo the parts."""
    root = tables.folder(b.spark)
    for k in range(parts):
        part = rows.where(F.second(time) % parts == k).withColumn("date", F.to_date(time))
        part.repartition("date").write.mode("append").partitionBy("date").parquet(root)
    return root


def report(b, counts: dict[str, int], root: str, before: int):
    """Counts of a change beside the table's files before and rows after it."""
    return files.storage(b.spark, {"t": root}).select(*(F.lit(v).cast("long").alias(k) for k, v in counts.items()), F.lit(before).cast("long").alias("files_before"), F.col("rows").alias("rows_after"))


@query("""SELECT count(*) FILTER (hit) AS matched, count(*) FILTER (hit AND NOT acknowledged) AS changed, count(DISTINCT time::DATE) FILTER (hit AND NOT acknowledged) AS files, count(DISTINCT time::DATE) AS files_before, count(*) AS rows_after
 FROM (SELECT *, id % 10 = 1 AND time >= '2024-01-10' AND time < '2024-01-13' AS hit FROM alert_log)""")
def acknowledge_files(b):
    """Alerts of three days are acknowledged; the files of the other days stay."""
    root = written(b, b.alert_log, "time")
    n = files.listing(b.spark, root).count()
    hit = (F.col("id") % 10 == 1) & (F.col("time") >= "2024-01-10") & (F.col("time") < "2024-01-13") & ~F.col("acknowledged")
    seen = b.spark.read.parquet(root).where((F.col("id") % 10 == 1) & (F.col("time") >= "2024-01-10") & (F.col("time") < "2024-01-13")).count()
    counts = files.updated(b.spark, root, hit, {"acknowledged": F.lit(True), "acknowledged_by": F.lit("me"), "acknowledged_at": F.lit(b.now)})
    return report(b, counts | {"matched": seen}, root, n)


@query("""SELECT id, CASE WHEN level = 'info' AND time >= '2024-01-10' AND time < '2024-01-13' THEN 'system' ELSE category END AS category FROM alert_log""")
def updated_rows(b):
    root = written(b, b.alert_log, "time")
    files.updated(b.spark, root, (F.col("level") == "info") & (F.col("time") >= "2024-01-10") & (F.col("time") < "2024-01-13"), {"category": F.lit("system")})
    return b.spark.read.parquet(root).select("id", "category")


@query("""SELECT count(*) FILTER (pv_name IN (SELECT min(s_name) FROM supplier WHERE s_suppkey % 7 <> 0 GROUP BY s_nationkey)) AS matched, count(*) FILTER (enabled AND pv_name IN (SELECT min(s_name) FROM supplier WHERE s_suppkey % 7 <> 0 GROUP BY s_nationkey)) AS changed, count(*) AS rows_after FROM config_before""")
def set_enabled_files(b):
    """The first signal of each device is switched off; how many there were, and how many were on."""
    root = tables.folder(b.spark)
    b.config_before.repartition(4, "expected_ioc").write.parquet(root)
    first = [r.n for r in b.config_before.groupBy("expected_ioc").agg(F.min("pv_name").alias("n")).collect()]  # as many as devices
    counts = files.updated(b.spark, root, F.col("pv_name").isin(first), {"enabled": F.lit(False)})
    return report(b, counts, root, 4).select("matched", "changed", "rows_after")


@query(f"""SELECT count(*) FILTER (NOT keep) AS deleted, count(DISTINCT time::DATE) FILTER (NOT keep) AS files, count(DISTINCT time::DATE) AS files_before, count(*) FILTER (keep) AS rows_after FROM (SELECT *, time >= {NOW} - INTERVAL 10 DAY OR level = 'critical' AS keep FROM alert_log)""")
def purge_files(b):
    """Alerts older than ten days are deleted, but critical ones."""
    root = written(b, b.alert_log, "time")
    n = files.listing(b.spark, root).count()
    return report(b, files.deleted(b.spark, root, (F.col("time") < F.lit(b.now - timedelta(days=10))) & (F.col("level") != "critical")), root, n)


@query("""SELECT CAST(d AS VARCHAR) AS date, max(n) AS files_before, 1 AS files_after, CAST(sum(r) AS BIGINT) AS rows FROM (SELECT time::DATE AS d, count(DISTINCT CAST(second(time) AS INT) % 3) OVER (PARTITION BY time::DATE) AS n, 1 AS r FROM samples) GROUP BY d""")
def pack_files(b):
    """Three files for each date are packed into one."""
    root = written(b, b.samples, "time", 3)
    before = files.listing(b.spark, root).groupBy("date").agg(F.count("*").alias("files_before")).collect()  # one row for each date
    files.packed(b.spark, root, ["pv_id", "time"])
    known = b.spark.createDataFrame(before, "date date, files_before long")
    now = files.storage(b.spark, {"t": root}, by_date=True).join(known, "date")
    return now.select(F.col("date").cast("string").alias("date"), "files_before", F.col("files").cast("int").alias("files_after"), "rows")


@query(f"SELECT CAST(time::DATE AS VARCHAR) AS date, count(*) AS rows FROM samples WHERE time::DATE >= {NOW}::DATE - 10 GROUP BY 1")
def drop_old_dates(b):
    """Dates of more than ten days ago are dropped from a stored table; what is left."""
    root = written(b, b.samples, "time")
    files.dropped(b.spark, root, (b.now - timedelta(days=10)).date())
    return files.storage(b.spark, {"t": root}, by_date=True).select(F.col("date").cast("string").alias("date"), "rows")


@query(f"""{U} SELECT {BY} AS name, CAST(sum(CASE k WHEN 4 THEN event_id % 4 WHEN 5 THEN 2 WHEN 6 THEN 4 WHEN 7 THEN CASE event_id % 3 WHEN 0 THEN 3 ELSE 2 END WHEN 8 THEN CASE event_id % 2 WHEN 0 THEN 3 ELSE 2 END WHEN 9 THEN CASE event_id % 2 WHEN 0 THEN 3 ELSE 4 END WHEN 10 THEN 3 ELSE 1 END) AS BIGINT) AS rows,
 TRUE AS has_bytes FROM u WHERE NOT (k = 4 AND event_id % 4 = 0) GROUP BY ALL""")
def table_storage(b):
    """Rows, and whether there are bytes, of every table of the archive; the bytes themselves depend on the writer."""
    root = archive(b)
    out = files.storage(b.spark, {t: f"{root}/{t}" for t in ingest.WRITERS})
    return out.where("rows > 0").select(F.col("table").alias("name"), "rows", (F.col("bytes") > F.col("files")).alias("has_bytes"))
