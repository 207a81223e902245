"""Upkeep of tables by their files: what they hold, packing small ones, dropping old dates, and changes that rewrite only the files with hits.

A rewrite puts its new files into a hidden folder, then records which files it replaces, then swaps them. The record is carried out to its end by recovered() if the driver
breaks off in between, so no row is lost or there twice. One writer changes a table at a time; paths of files come to the driver, as they do when Spark reads a table.
"""

from __future__ import annotations

import json
import uuid
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pvspark.sources.tables import _at, _exists, delete


def listing(spark: SparkSession, root: str) -> DataFrame:
    """The files of a table: path, length, and date (null without one in the path). No file is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(root)
    hidden = F.col("path").substr(F.lit(len(root)), F.length("path")).rlike("/[._]")
    return files.where(~hidden).select("path", "length", F.regexp_extract("path", "/date=([0-9-]+)/", 1).try_cast("date").alias("date"))


def storage(spark: SparkSession, roots: dict[str, str], by_date: bool = False) -> DataFrame:
    """Files, bytes and rows of each table, or of each of its dates. Rows are counted from the files' footers."""
    out, keys = None, ["table", "date"] if by_date else ["table"]
    for table, root in roots.items():
        files = listing(spark, root).withColumn("table", F.lit(table)).groupBy(*keys).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))
        rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(root).select(F.regexp_extract("_metadata.file_path", "/date=([0-9-]+)/", 1).try_cast("date").alias("date"), F.lit(table).alias("table")).groupBy(*keys).agg(F.count("*").alias("rows"))
        same = F.lit(True)
        for k in keys:
            same = same & files[k].eqNullSafe(rows[k])
        one = files.join(rows, same, "left").select(*(files[k] for k in keys), "files", "bytes", F.coalesce("rows", F.lit(0).cast("long")).alias("rows"))
        out = one if out is None else out.unionByName(one)
    return out


def _partition_columns(paths: list[str]) -> list[str]:
    return [part.partition("=")[0] for part in paths[0].split("/")[:-1] if "=" in part]


def _read(spark: SparkSession, root: str, paths: list[str]) -> DataFrame:
    return spark.read.option("basePath", root).parquet(*paths)


def _swapped(rows: DataFrame, root: str, old: list[str], by: list[str]) -> int:
    """Write rows as new files of a table in place of some old ones, and return how many it wrote."""
    spark, name = rows.sparkSession, uuid.uuid4().hex
    staged = f"{root}/_staged-{name}"
    writer = rows.write.partitionBy(*by) if by else rows.write
    writer.parquet(staged)
    fs, at = _at(spark, staged)
    base, new, files = fs.getFileStatus(at).getPath().toString(), [], fs.listFiles(at, True)
    while files.hasNext():
        path = files.next().getPath().toString()
        if path.endswith(".parquet"):
            new.append(path[len(base) + 1 :])
    fs, whole = _at(spark, f"{staged}/_record.json")
    out = fs.create(whole)
    out.write(bytearray(json.dumps({"old": old, "new": new}).encode()))
    out.close()
    fs.rename(whole, _at(spark, f"{root}/_swap-{name}.json")[1])  # at once: there is a whole record or none
    recovered(spark, root)
    return len(new)


def recovered(spark: SparkSession, root: str) -> int:
    """Carry out the swaps that are recorded, and remove folders of writes that broke off before; returns the number of swaps. To be called before a table is read after a crash."""
    fs, at = _at(spark, f"{root}/_swap-*.json")
    done = 0
    for status in fs.globStatus(at) or ():
        stream = fs.open(status.getPath())
        record = json.loads(bytes(stream.readAllBytes()).decode())
        stream.close()
        staged = status.getPath().toString().replace("/_swap-", "/_staged-").removesuffix(".json")
        for path in record["new"]:
            _, source = _at(spark, f"{staged}/{path}")
            _, to = _at(spark, f"{root}/{path}")
            fs.mkdirs(to.getParent())
            if fs.exists(source) and not fs.rename(source, to):
                raise OSError(f"{source} can't be moved to {to}")
        for path in record["old"]:
            delete(spark, path)
        delete(spark, staged)
        fs.delete(status.getPath(), False)
        done += 1
    _, left = _at(spark, f"{root}/_staged-*")
    for status in fs.globStatus(left) or ():
        fs.delete(status.getPath(), True)
    spark.catalog.refreshByPath(root)
    return done


def packed(spark: SparkSession, root: str, order: list[str], small: int = 64 << 20, least: int = 2) -> dict[str, int]:
    """Pack the files under `small` bytes of each date, where there are `least` of them or more, into fewer ones, sorted by the order within them. Other files stay.

    Returns how many files there were and are in those dates' small ones: read and written. AQE sizes what is written."""
    files = listing(spark, root).where(F.col("length") < small)
    crowded = files.groupBy("date").agg(F.collect_list("path").alias("paths")).where(F.size("paths") >= least).collect()
    old = [p for r in crowded for p in r.paths]
    if not old:
        return {"read": 0, "written": 0}
    by = _partition_columns([old[0][len(root.removeprefix("file:").rstrip("/")) :]])
    rows = _read(spark, root, old)
    rows = rows.hint("rebalance", *by) if by else rows.hint("rebalance")
    return {"read": len(old), "written": _swapped(rows.sortWithinPartitions(*by, *order), root, old, by)}


def dropped(spark: SparkSession, root: str, before: date) -> list[date]:
    """Drop a table's dates before one, whole, without reading them; returns the dates that went."""
    if not _exists(spark, root):
        return []
    old = [r.date for r in listing(spark, root).where(F.col("date") < F.lit(before)).select("date").distinct().orderBy("date").collect()]
    fs, at = _at(spark, f"{root}/*")
    where = [root, *(s.getPath().toString() for s in fs.globStatus(at) or () if "/batch=" in s.getPath().toString())]
    for folder in where:
        for day in old:
            delete(spark, f"{folder}/date={day}")
    spark.catalog.refreshByPath(root)
    return old


def _hits(spark: SparkSession, root: str, hit: Column) -> dict[str, int]:
    """The files with rows that a condition holds for, and how many. The condition reaches the scan."""
    return {r.path: r.n for r in spark.read.parquet(root).where(hit).groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count("*").alias("n")).collect()}


def updated(spark: SparkSession, root: str, hit: Column, values: dict[str, Column]) -> dict[str, int]:
    """Give columns of the rows that a condition holds for new values. Returns matched (rows that it holds for), changed (those with a value that was another, null-safe), and files
    (read and written again: those with changed rows, no others)."""
    matched = sum(_hits(spark, root, hit).values())
    differs = F.lit(False)
    for c, v in values.items():
        differs = differs | ~F.col(c).eqNullSafe(v)
    files = _hits(spark, root, hit & differs)
    if files:
        paths = sorted(files)
        rows = _read(spark, root, paths)
        by = _partition_columns([paths[0][len(root.removeprefix("file:").rstrip("/")) :]])
        hit = F.coalesce(hit, F.lit(False))
        _swapped(rows.withColumns({c: F.when(hit, v.cast(rows.schema[c].dataType)).otherwise(F.col(c)) for c, v in values.items()}), root, paths, by)
    return {"matched": matched, "changed": sum(files.values()), "files": len(files)}


def deleted(spark: SparkSession, root: str, hit: Column) -> dict[str, int]:
    """Delete the rows that a condition holds for. Returns deleted, and files (those that held such rows and were written again, or went)."""
    files = _hits(spark, root, hit)
    if files:
        paths = sorted(files)
        by = _partition_columns([paths[0][len(root.removeprefix("file:").rstrip("/")) :]])
        _swapped(_read(spark, root, paths).where(~F.coalesce(hit, F.lit(False))), root, paths, by)
    return {"deleted": sum(files.values()), "files": len(files)}
