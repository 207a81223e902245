"""Structured Streaming forms: the same operators over streams, with watermarks, keyed state and idempotent writes."""

from __future__ import annotations

import time
from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType

from pvspark.operators import lifecycle, reconcile
from pvspark.operators.rollup import order_key
from pvspark.sources.tables import delete, folder, is_folder


def rollup(samples: DataFrame, lateness: str = "3 hours") -> DataFrame:
    """The hourly roll-up of a stream; rows later than the bound do not change closed hours (tables.refresh_touched() makes those again)."""
    order = order_key()
    rows = samples.withWatermark("time", lateness).groupBy(F.window("time", "1 hour"), "pv_id").agg(
        F.avg("value").alias("avg_value"), F.min("value").alias("min_value"), F.max("value").alias("max_value"), F.stddev_samp("value").alias("stddev_value"), F.count("value").alias("sample_count"),
        F.min_by("value", order).alias("first_value"), F.max_by("value", order).alias("last_value"), F.max("severity").alias("max_severity"), F.sum("value").alias("sum_value"), F.sum(F.col("value") * F.col("value")).alias("sum_squares"),
    )
    return rows.select(F.col("window.start").alias("bucket"), *[c for c in rows.columns if c != "window"])


def stats(samples: DataFrame, window: str = "30 seconds", seconds: float = 30.0) -> DataFrame:
    """Statistics of each signal for each window."""
    order = order_key()
    rows = samples.withWatermark("time", window).groupBy(F.window("time", window), "pv_id").agg(
        F.count("*").alias("events"), F.max_by("value", order).alias("last_value"), F.max_by("severity", order).alias("last_severity"), (F.count("*") / seconds).alias("update_hz")
    )
    return rows.select(F.col("window.start").alias("bucket"), "pv_id", "events", "last_value", "last_severity", "update_hz")


#: Parts of a kept table by the hash of its key; a micro-batch writes those that it changes.
BUCKETS = 64
Step = Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]]


def _versions(spark: SparkSession, path: str) -> dict[int, list[int]]:
    """The batches that wrote each bucket of a kept table, in order."""
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/kept/batch=*/bucket=*")
    found: dict[int, list[int]] = {}
    for x in root.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(root) or ():
        batch, bucket = (int(part.rpartition("=")[2]) for part in x.getPath().toString().rstrip("/").split("/")[-2:])
        found.setdefault(bucket, []).append(batch)
    return {k: sorted(v) for k, v in found.items()}


def kept_table(spark: SparkSession, path: str, kept: str | StructType, before: int | None = None, buckets: set[int] | None = None) -> DataFrame:
    """The table that a job of continued() carries: the newest version of each bucket, or of some, as it was before a batch."""
    live = {b: [v for v in vs if before is None or v < before] for b, vs in _versions(spark, path).items() if buckets is None or b in buckets}
    paths = [f"{path}/kept/batch={vs[-1]}/bucket={b}" for b, vs in live.items() if vs]
    return spark.read.schema(kept).parquet(*paths) if paths else spark.createDataFrame([], kept)


def continued(stream: DataFrame, step: Step, kept: str | StructType, path: str, checkpoint: str, first: DataFrame | None = None, key: str = "pv_id") -> StreamingQuery:
    """Start a job that carries a table (of schema `kept`) from micro-batch to micro-batch: step(table, batch) gives the rows to write, and all new rows of the
    keys that change; the rows of other keys stay. The table is empty before the first batch, or `first`.

    Both are DataFrames, so a batch of any size, or one key with most of it, sorts and spills like any other Spark work. The table lies in buckets by its key's
    hash. A batch writes those with keys that change and leaves the others where earlier batches wrote them. A batch that is tried again replaces its own
    rows and its own buckets, and reads those from before it. Versions that no such batch can ask for are removed.
    """

    def save(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        table = kept_table(spark, path, kept, number) if number or first is None else first
        batch.persist()
        try:
            rows, new = step(table, batch)
            new.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")).write.mode("overwrite").parquet(f"{path}/new")
            new_rows = spark.read.parquet(f"{path}/new")
            (new_rows.drop("bucket") if rows is new else rows).write.mode("overwrite").parquet(f"{path}/batch={number}")
        finally:
            batch.unpersist()
        touched = {r.bucket for r in new_rows.select("bucket").distinct().collect()}  # BUCKETS at most
        rest = first if not number and first is not None else kept_table(spark, path, kept, number, touched)
        changed = new_rows.select(F.col(key).alias("_key")).distinct()
        rest = rest.join(changed, F.col(key).eqNullSafe(F.col("_key")), "left_anti").withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int"))
        rest.unionByName(new_rows).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/kept/batch={number}")
        for bucket, versions in _versions(spark, path).items():
            for v in [v for v in versions if v < number][:-1]:
                delete(spark, f"{path}/kept/batch={v}/bucket={bucket}")

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(save).trigger(availableNow=True).start()


def status(states: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A step of `continued`: the state of each signal with events (pv_id, ts, event_id, event_type).

    A batch's events count as later than those of the batches before."""
    new = lifecycle.status_fold(events, states)
    return new, new


def status_table(table: DataFrame, samples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A step of `continued`: the rows of the status table whose signals have samples, with their statistics. The rate is that of the signal's newest 30 s, however
    the samples are cut into batches."""
    new = lifecycle.status_windows(table, samples)
    return new, new


STATUS_VALUES = {"last_value": "double", "last_severity": "smallint", "last_event_at": "timestamp", "update_hz": "double", "window": "timestamp", "in_window": "bigint"}
STATES = "pv_id int, state smallint"
OPEN = "pv_id int, time timestamp, tiebreak bigint, value double, severity smallint, status smallint, clock timestamp, due timestamp"


def gaps(emit: Callable[[DataFrame, datetime], DataFrame], late_s: float = 0.0, due: Callable[[DataFrame, datetime], DataFrame] | None = None) -> Step:
    """A step of `continued` over samples (the columns of OPEN but the last two): what emit(samples, now) makes of the gaps between a signal's samples, each
    row once. The samples have a column `since`; rows before it are there already, and emit makes none of them.

    The clock is the latest time seen less `late_s`. A sample may be late by that much and still count; older ones are ignored. Kept are, for each signal, the
    last sample before the clock and those after it, and the time at which the signal is due: when the clock passes its next row or its next sample.
    A batch reads and changes the signals that have new samples or are due; all others stay as they are, however long they have been silent.
    due(samples, now) adds the time of the next row of each last sample at or after now, as `due`, or null for none; without it every signal is always due.
    """
    cols = ["pv_id", "time", "tiebreak", "value", "severity", "status"]

    def step(kept: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
        before = kept.agg(F.max("clock")).first()[0]
        new = batch.select(*cols) if before is None else batch.select(*cols).where(F.col("time") >= F.lit(before))
        top = new.agg(F.max("time")).first()[0]
        clock = max(x for x in (before, top and top - timedelta(seconds=late_s)) if x) if before or top else None
        if clock is None:
            return emit(kept.select(*cols).unionByName(new).withColumn("since", F.lit(None).cast("timestamp")), datetime(1970, 1, 1)), kept
        awake = kept.where(F.col("due") < F.lit(clock)).select("pv_id").union(new.select("pv_id")).distinct().withColumnRenamed("pv_id", "_pv")
        rows = kept.join(awake, F.col("pv_id").eqNullSafe(F.col("_pv")), "left_semi").select(*cols).unionByName(new)
        ntz = lambda x: F.lit(x).cast("timestamp_ntz")
        out = emit(rows.withColumn("time", F.col("time").cast("timestamp_ntz")).withColumn("since", ntz(before)), clock).where(F.col("time") < ntz(clock))
        if before is not None:
            out = out.where(F.col("time") >= ntz(before))
        passed, ahead = rows.where(F.col("time") < F.lit(clock)), rows.where(F.col("time") >= F.lit(clock))
        order = order_key()
        last = passed.groupBy("pv_id").agg(F.max("time").alias("time"), *(F.max_by(c, order).alias(c) for c in cols[2:]))
        last = due(last, clock) if due else last.withColumn("due", F.lit(datetime(1970, 1, 1)))
        ahead = ahead.withColumn("due", F.col("time"))  # the signal's next sample closes its gap
        return out, last.withColumn("due", F.col("due").cast("timestamp")).unionByName(ahead).withColumn("clock", F.lit(clock)).select(*cols, "clock", "due")

    return step


def retried(start: Callable[[], StreamingQuery], waits: tuple[float, ...] = (1, 4, 15, 30, 60)) -> int:
    """Run a job to its end and return how often it failed; after each failure it goes on from its checkpoint when the wait is over, and the last one is raised."""
    for failures, wait in enumerate((*waits, None)):
        try:
            start().awaitTermination()
            return failures
        except StreamingQueryException:
            if wait is None:
                raise
            time.sleep(wait)


def notices(stream: DataFrame) -> DataFrame:
    """The changes (op, pv_name) of a stream of notices (payload), as they arrive."""
    return reconcile.changes(stream)


def written(stream: DataFrame, path: str, checkpoint: str, mode: str = "update", then: Callable[[int], None] | None = None) -> StreamingQuery:
    """Start a job that writes every micro-batch to a folder of its number: a batch that is tried again replaces its own rows, so none is doubled.
    `then` is called with the number after each write, before the batch counts as done."""

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
        if then:
            then(number)

    return stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(save).trigger(availableNow=True).start()


def drained(stream: DataFrame, keys: list[str] | None = None, mode: str = "update") -> DataFrame:
    """Run a stream over what there is now and return its rows: with keys, the newest batch's row of each key."""
    spark, path = stream.sparkSession, folder(stream.sparkSession)
    written(stream, path, folder(spark), mode).awaitTermination()
    rows = spark.read.option("basePath", path).parquet(f"{path}/batch=*")
    if keys is None:
        return rows.drop("batch")
    others = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch").alias("r")).select(*keys, "r.*")


def carried(stream: DataFrame, step: Step, kept: str | StructType, first: DataFrame | None = None) -> DataFrame:
    """Run `continued` over what there is now and return its rows, with the number of their batch."""
    spark, path = stream.sparkSession, folder(stream.sparkSession)
    continued(stream, step, kept, path, folder(spark), first).awaitTermination()
    return spark.read.option("basePath", path).parquet(f"{path}/batch=*")


def carried_table(stream: DataFrame, step: Step, kept: str | StructType, first: DataFrame | None = None) -> DataFrame:
    """Run `continued` over what there is now and return the table that it carries."""
    spark, path = stream.sparkSession, folder(stream.sparkSession)
    continued(stream, step, kept, path, folder(spark), first).awaitTermination()
    return kept_table(spark, path, kept)


def file_stream(spark: SparkSession, sf_dir: str, table: str, shape: Callable[[DataFrame], DataFrame], files: int = 1000) -> DataFrame:
    """A table's files as a stream, so many files in a micro-batch: a folder of files, also one partitioned by columns, or a single file."""
    path = f"{sf_dir}/{table}.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files)
    return shape(reader.parquet(path) if is_folder(spark, path) else reader.option("pathGlobFilter", f"{table}.parquet").parquet(sf_dir))
