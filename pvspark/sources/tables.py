"""Reading updates and writing sample tables. Writes go to one folder for each table, partitioned by date and sorted for pruning."""

from __future__ import annotations

import tempfile
import uuid
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pvspark.operators import rollup


def folder(spark: SparkSession) -> str:
    """A new path in the shared folder of the cluster; in a temporary one where none is set, as in tests, but not on a cluster of many machines."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    base = base or f"file://{tempfile.mkdtemp(prefix='pvspark-')}"
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


# The columns of the sample tables and of the dictionary of names.
_ALARM = "severity smallint, status smallint"
SCHEMAS = {
    "samples": f"time timestamp_ntz, pv_id int, value double, {_ALARM}, reason smallint",
    "samples_string": f"time timestamp_ntz, pv_id int, value string, {_ALARM}",
    "samples_array_num": f"time timestamp_ntz, pv_id int, array_id bigint, idx int, value double, {_ALARM}",
    "samples_array_str": f"time timestamp_ntz, pv_id int, array_id bigint, idx int, value string, {_ALARM}",
    "samples_hist": f"time timestamp_ntz, pv_id int, capture_id bigint, idx int, range_val double, count bigint, {_ALARM}",
    "samples_cont": f"time timestamp_ntz, pv_id int, capture_id bigint, idx int, base_val double, trace_val double, {_ALARM}",
    "samples_nv": f"time timestamp_ntz, pv_id int, capture_id bigint, idx int, name string, value double, {_ALARM}",
    "samples_mch": f"time timestamp_ntz, pv_id int, capture_id bigint, idx int, ch_name string, ch_value double, ch_severity smallint, {_ALARM}",
    "samples_table": f"time timestamp_ntz, pv_id int, data variant, {_ALARM}",
    "samples_custom": f"time timestamp_ntz, pv_id int, nt_type string, data variant, {_ALARM}",
    "samples_image": f"time timestamp_ntz, pv_id int, data binary, codec string, compressed_size bigint, uncompressed_size bigint, dimensions array<int>, unique_id int, attributes variant, {_ALARM}",
    "pv_lookup": "pv_id int, pv_name string",
}


def read_table(spark: SparkSession, root: str, table: str, start: datetime | None = None, end: datetime | None = None) -> DataFrame:
    """A stored sample table by its known columns, without looking into files for them, with start <= time < end; dates prune its folders."""
    rows = spark.read.schema(f"{SCHEMAS[table]}, batch int, date date").parquet(f"{root}/{table}")
    if start is not None:
        rows = rows.where((F.col("date") >= F.lit(start.date())) & (F.col("time") >= F.lit(start)))
    if end is not None:
        rows = rows.where((F.col("date") <= F.lit(end.date())) & (F.col("time") < F.lit(end)))
    return rows.drop("batch", "date")


#: Versions of the layout of a database: what each one adds. A version that was applied is never changed; new tables come with a new one.
LAYOUT = [
    ("dictionary", ("pv_lookup",)), ("samples", ("samples", "samples_string")), ("typed samples", ("samples_table", "samples_custom", "samples_image")),
    ("arrays by element", ("samples_array_num", "samples_array_str")), ("captures by element", ("samples_hist", "samples_cont", "samples_nv", "samples_mch")),
]


def create_tables(spark: SparkSession, database: str, root: str | None = None) -> DataFrame:
    """Bring a database of the catalog to the newest layout, and say for each version whether this call applied it or skipped it as there already.

    Sample tables are partitioned by date. Applied versions are rows of the table layout_versions in the same database; a call that is repeated, or one that broke off
    between the tables and the record, changes nothing that is there. root: where the tables lie, the warehouse if it isn't given.
    """
    at = lambda name: f" LOCATION '{root}/{name}'" if root else ""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`")
    spark.sql(f"CREATE TABLE IF NOT EXISTS `{database}`.layout_versions (version int, name string, tables array<string>) USING parquet{at('layout_versions')}")
    wanted = spark.createDataFrame([(k, name, list(names)) for k, (name, names) in enumerate(LAYOUT, 1)], "version int, name string, tables array<string>")
    new = wanted.join(spark.table(f"`{database}`.layout_versions"), "version", "left_anti").orderBy("version").collect()  # a few rows: the layout's versions
    for row in new:
        for t in row.tables:
            dated = t.startswith("samples")
            spark.sql(f"CREATE TABLE IF NOT EXISTS `{database}`.`{t}` ({SCHEMAS[t]}{', date date' if dated else ''}) USING parquet{' PARTITIONED BY (date)' if dated else ''}{at(t)}")
        spark.createDataFrame([row], wanted.schema).write.insertInto(f"`{database}`.layout_versions")
    applied = [r.version for r in new]
    return wanted.select("version", "name", F.when(F.col("version").isin(applied), "applied").otherwise("skipped").alias("outcome"))


def read_updates(frame: DataFrame, column: str = "data") -> DataFrame:
    """Updates with their JSON payload as a variant and its kind as nt_type."""
    v = F.parse_json(column)
    return frame.withColumn("payload", v).withColumn("nt_type", F.try_variant_get(v, "$.nt_type", "string"))


def write_samples(rows: DataFrame, path: str, mode: str = "append") -> None:
    """Append rows (time, pv_id, ...) by date: AQE sizes the files, and sorting by signal and time lets Parquet's statistics prune."""
    dated = rows.withColumn("date", F.to_date("time"))
    dated.hint("rebalance", "date").sortWithinPartitions("date", "pv_id", "time").write.partitionBy("date").mode(mode).parquet(path)


def read_samples(spark: SparkSession, path: str, start=None, end=None) -> DataFrame:
    """Stored rows with start <= time < end; the date predicate, which Spark does not derive from the time, prunes partitions."""
    rows = spark.read.parquet(path)
    if start is not None:
        rows = rows.where((F.col("date") >= F.lit(start.date())) & (F.col("time") >= F.lit(start)))
    if end is not None:
        rows = rows.where((F.col("date") <= F.lit(end.date())) & (F.col("time") < F.lit(end)))
    return rows


def fanout(rows: DataFrame, root: str, batch: int | None = None) -> DataFrame:
    """Write routed rows (target, time, ...) to their tables, and return the rows written for each. A batch number makes a repeated write of the
    same micro-batch replace the first one instead of adding to it."""
    path = f"{root}/tables" if batch is None else f"{root}/tables/batch={batch}"
    rows.hint("rebalance", "target").sortWithinPartitions("target", "pv_id", "time").write.partitionBy("target").mode("append" if batch is None else "overwrite").parquet(path)
    return rows.sparkSession.read.parquet(path).groupBy("target").agg(F.count("*").alias("n"))


def ensure_tables(wanted: DataFrame, root: str) -> DataFrame:
    """Record the tables and dates (target, date) that are wanted and not there yet, and say what became of each: applied, or skipped since an earlier
    call applied it. The record is a table itself, so a call that is repeated changes nothing."""
    spark, path = wanted.sparkSession, f"{root}/applied"
    schema = "target string, date string, batch string"
    there = spark.read.schema(schema).parquet(path) if _exists(spark, path) else spark.createDataFrame([], schema)
    batch = uuid.uuid4().hex
    wanted.select("target", "date").distinct().join(there, ["target", "date"], "left_anti").withColumn("batch", F.lit(batch)).write.mode("append").parquet(path)
    now = spark.read.schema(schema).parquet(path)
    return wanted.select("target", "date").distinct().join(now, ["target", "date"]).select("target", "date", F.when(F.col("batch") == batch, "applied").otherwise("skipped").alias("outcome"))


def _at(spark: SparkSession, path: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _exists(spark: SparkSession, path: str) -> bool:
    fs, at = _at(spark, path)
    return fs.exists(at)


def is_folder(spark: SparkSession, path: str) -> bool:
    fs, at = _at(spark, path)
    return fs.getFileStatus(at).isDirectory()


def delete(spark: SparkSession, path: str) -> None:
    fs, at = _at(spark, path)
    fs.delete(at, True)


def _write_tier(rows: DataFrame, path: str) -> None:
    """Replace the dates of rows (bucket, pv_id, ...) in a tier's table; other dates stay."""
    dated = rows.withColumn("date", F.to_date("bucket"))
    dated.hint("rebalance", "date").sortWithinPartitions("date", "pv_id", "bucket").write.partitionBy("date").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def _hour(time: datetime) -> datetime:
    return time.replace(minute=0, second=0, microsecond=0)


def _day(time: datetime) -> datetime:
    return time.replace(hour=0, minute=0, second=0, microsecond=0)


_MARK = "%Y%m%dT%H%M%S"


def set_mark(spark: SparkSession, root: str, until: datetime) -> None:
    """Record that the tiers hold every sample before `until`: the hourly one to its hour, the daily one to its day. A mark is the name of an empty file, so that it is read
    without a job; marks never go back."""
    for tier, end in (("hourly", _hour(until)), ("daily", _day(until))):
        fs, at = _at(spark, f"{root}/marks/{tier}-{end.strftime(_MARK)}")
        fs.create(at, True).close()


def marks(spark: SparkSession, root: str) -> dict[str, datetime]:
    """Up to where each tier is complete; buckets from there on are made from finer data when they are read."""
    fs, at = _at(spark, f"{root}/marks/*-*")
    names = [s.getPath().getName().partition("-") for s in fs.globStatus(at) or ()]
    return {tier: max(datetime.strptime(end, _MARK) for t, _, end in names if t == tier) for tier in {n[0] for n in names}}


def write_tiers(samples: DataFrame, root: str, until: datetime | None = None) -> None:
    """The hourly and the daily table of samples; a date that is there already is replaced. The daily one is made from the stored hours.

    until: up to when the samples are complete; if it isn't given, the newest sample's time, so that its hour stays open."""
    _write_tier(rollup.hourly(samples), f"{root}/hourly")
    seen = samples.agg(F.collect_set(F.to_date("time")).alias("dates"), F.max("time").alias("newest")).first()  # as many dates as days were written
    hours = samples.sparkSession.read.parquet(f"{root}/hourly").where(F.col("date").isin(seen.dates))
    _write_tier(rollup.daily(hours.drop("date")), f"{root}/daily")
    if until or seen.newest:
        set_mark(samples.sparkSession, root, until or seen.newest)


def refresh_tiers(samples: DataFrame, root: str, now: datetime, start_offset: timedelta, end_offset: timedelta) -> None:
    """Write again what may have changed: the dates from now - start_offset on, with the whole hours up to now - end_offset."""
    first, end = _day(now - start_offset), _hour(now - end_offset)
    write_tiers(samples.where((F.col("time") >= F.lit(first)) & (F.col("time") < F.lit(end))), root, end)


def _replace(root: str, tier: str, rows: DataFrame, keys: DataFrame, dates: list) -> None:
    """Put rows in place of those of some (bucket, pv_id) in a tier; of the dates that hold them, all other rows are kept, and other dates are not touched."""
    old = rows.sparkSession.read.parquet(f"{root}/{tier}").where(F.col("date").isin(dates)).drop("date")
    same = (F.col("bucket") == F.col("_bucket")) & F.col("pv_id").eqNullSafe(F.col("_pv"))
    _write_tier(old.join(keys, same, "left_anti").unionByName(rows), f"{root}/{tier}")


def refresh_late(samples: DataFrame, late: DataFrame, root: str) -> int:
    """Bring rows into the tiers that came after their hours were written, however late, and return how many (hour, signal) that took. samples: all rows, with the late ones.

    Only the touched hours of the touched signals are made again, from the samples of their dates, and only those dates of the tiers are written again: first hours, then days from
    the stored hours. Hours and days from the marks on are left to the next refresh.
    """
    spark, until, at = late.sparkSession, marks(late.sparkSession, root), folder(late.sparkSession)
    hour = F.date_trunc("hour", F.col("time")).cast("timestamp_ntz")
    late.select(hour.alias("_bucket"), F.col("pv_id").alias("_pv")).where(F.col("_bucket") < F.lit(until["hourly"])).distinct().write.parquet(at)
    touched = spark.read.parquet(at)
    seen = touched.agg(F.count("*").alias("n"), F.collect_set(F.to_date("_bucket")).alias("dates")).first()
    if not seen.n:
        return 0
    dated = samples
    if "date" in samples.columns:
        dated = samples.where(F.col("date").isin(seen.dates)).drop("date")
    dated = dated.where((F.col("time") >= F.lit(datetime.combine(min(seen.dates), datetime.min.time()))) & (F.col("time") < F.lit(datetime.combine(max(seen.dates), datetime.min.time()) + timedelta(days=1))))
    own = dated.join(touched, (hour == F.col("_bucket")) & F.col("pv_id").eqNullSafe(F.col("_pv")), "left_semi")
    _replace(root, "hourly", rollup.hourly(own), touched, seen.dates)
    days = touched.select(F.date_trunc("day", F.col("_bucket")).cast("timestamp_ntz").alias("_bucket"), "_pv").where(F.col("_bucket") < F.lit(until["daily"])).distinct()
    whole = [d for d in seen.dates if datetime.combine(d, datetime.min.time()) < until["daily"]]
    hours = spark.read.parquet(f"{root}/hourly").where(F.col("date").isin(whole)).drop("date")
    of_days = hours.join(days, (F.date_trunc("day", F.col("bucket")).cast("timestamp_ntz") == F.col("_bucket")) & F.col("pv_id").eqNullSafe(F.col("_pv")), "left_semi")
    if whole:
        _replace(root, "daily", rollup.daily(of_days), days, whole)
    return seen.n


def read_auto(spark: SparkSession, root: str, samples: DataFrame, pv_id: int, start: datetime, end: datetime, limit: int = 0, forced: str | None = None) -> DataFrame:
    """One signal's range from the tier that its span asks for, up to the newest sample; only that tier is looked at."""
    tier = rollup.tier(start, end, forced)
    rolled = samples if tier == "raw" else read_live(spark, root, tier, samples, start, end)
    return rollup.auto_range(samples, rolled, rolled, pv_id, start, end, limit, forced)


def read_live(spark: SparkSession, root: str, tier: str, samples: DataFrame, start: datetime | None = None, end: datetime | None = None) -> DataFrame:
    """Rows of a tier with start <= bucket < end, also those that are not stored yet: stored days up to the daily mark, then days of stored hours up to the hourly one,
    then what the samples from there on give. A range that ends before the marks reads stored rows alone."""
    until = marks(spark, root)

    def hours(a: datetime | None, b: datetime | None) -> DataFrame:
        cut = until["hourly"]
        old = read_tier(spark, root, "hourly", a, min(b, cut) if b else cut)
        if b and b <= cut:
            return old
        live = samples.where(F.col("time") >= F.lit(max(a, cut) if a else cut))
        return old.unionByName(rollup.hourly(live.where(F.col("time") < F.lit(b)) if b else live).select(*old.columns))

    if tier == "hourly":
        return hours(start, end)
    cut = until["daily"]
    old = read_tier(spark, root, "daily", start, min(end, cut) if end else cut)
    if end and end <= cut:
        return old
    first = max(start, cut) if start else cut
    last = end and (_day(end) if end == _day(end) else _day(end) + timedelta(days=1))  # a day whose bucket is before the end counts whole
    live = rollup.daily(hours(first if first == _day(first) else _day(first) + timedelta(days=1), last))
    return old.unionByName(live.select(*old.columns))


def read_tier(spark: SparkSession, root: str, tier: str, start: datetime | None = None, end: datetime | None = None) -> DataFrame:
    """Rows of a stored tier with start <= bucket < end; the dates prune partitions, and a signal that is asked for reaches the scan."""
    rows = spark.read.parquet(f"{root}/{tier}")
    if start is not None:
        rows = rows.where((F.col("date") >= F.lit(start.date())) & (F.col("bucket") >= F.lit(start)))
    if end is not None:
        rows = rows.where((F.col("date") <= F.lit(end.date())) & (F.col("bucket") < F.lit(end)))
    return rows.drop("date")


def numbered(rows: DataFrame, order: list, name: str) -> DataFrame:
    """rows with their number from 1 in an order, without bringing them to one task: ranges are sorted by themselves and stored, and each range's rows
    follow those of the ranges before."""
    spark, path = rows.sparkSession, folder(rows.sparkSession)
    ranges = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    ranges.withColumn("_place", F.monotonically_increasing_id()).write.parquet(path)
    stored = spark.read.parquet(path).withColumn("_range", F.shiftright("_place", 33))
    size = {r["_range"]: r["count"] for r in stored.groupBy("_range").count().collect()}  # one row for each range
    before, shift = 0, []
    for k in sorted(size):
        shift += [F.lit(k), F.lit(before + 1)]
        before += size[k]
    offset = F.create_map(*shift)[F.col("_range")] if shift else F.lit(0)
    return stored.withColumn(name, (offset + F.col("_place").bitwiseAND((1 << 33) - 1)).cast("long")).drop("_place", "_range")
