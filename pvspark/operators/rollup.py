"""Roll-ups and tiered reads. Sums and sums of squares are kept, so coarser roll-ups never read samples again."""

from __future__ import annotations

from datetime import datetime, timedelta
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATS = ("avg_value", "min_value", "max_value", "stddev_value", "sample_count", "first_value", "last_value", "max_severity")


def bucket(time: Column, unit: str) -> Column:
    return F.date_trunc(unit, time).cast("timestamp_ntz")


def order_key(time: str = "time", tiebreak: str = "tiebreak") -> Column:
    """Time, then the tie-break (any long), as one number: an aggregation that orders by it stays a hash aggregation, by a struct it would sort all rows."""
    micros = F.unix_micros(F.col(time).cast("timestamp")).cast("decimal(18,0)")
    return (micros * F.lit(Decimal(1 << 64))).cast("decimal(38,0)") + F.col(tiebreak).cast("decimal(19,0)")


def hourly(samples: DataFrame, tiebreak: str = "tiebreak") -> DataFrame:
    """samples (time, pv_id, value, severity, a tie-break) by hour and signal, in one partial and one final aggregation."""
    order = order_key("time", tiebreak)
    return samples.groupBy(bucket(F.col("time"), "hour").alias("bucket"), "pv_id").agg(
        F.avg("value").alias("avg_value"), F.min("value").alias("min_value"), F.max("value").alias("max_value"), F.stddev_samp("value").alias("stddev_value"),
        F.count("value").alias("sample_count"), F.min_by("value", order).alias("first_value"), F.max_by("value", order).alias("last_value"),
        F.max("severity").alias("max_severity"), F.sum("value").alias("sum_value"), F.sum(F.col("value") * F.col("value")).alias("sum_squares"),
    )


def daily(hours: DataFrame) -> DataFrame:
    """Hourly rows by day. The standard deviation comes from the sums; it is null for one sample."""
    n, s, q = F.sum("sample_count"), F.sum("sum_value"), F.sum("sum_squares")
    deviation = F.when(n > 1, F.sqrt(F.greatest(q - s * s / n, F.lit(0.0)) / (n - 1)))
    return hours.groupBy(bucket(F.col("bucket"), "day").alias("bucket"), "pv_id").agg(
        (s / n).alias("avg_value"), F.min("min_value").alias("min_value"), F.max("max_value").alias("max_value"), deviation.alias("stddev_value"), n.alias("sample_count"),
        F.min_by("first_value", "bucket").alias("first_value"), F.max_by("last_value", "bucket").alias("last_value"), F.max("max_severity").alias("max_severity"),
    )


def realtime(stored: DataFrame, samples: DataFrame, cut: datetime) -> DataFrame:
    """Stored hourly rows before the cut (a whole hour), and the live roll-up of what came since."""
    return stored.where(F.col("bucket") < F.lit(cut)).unionByName(hourly(samples.where(F.col("time") >= F.lit(cut))))


def refreshed(samples: DataFrame, now: datetime, start_offset: timedelta, end_offset: timedelta) -> DataFrame:
    """The hourly rows to write again: whole hours between now - start_offset and now - end_offset."""
    whole = lambda t: t.replace(minute=0, second=0, microsecond=0)
    start, end = now - start_offset, whole(now - end_offset)
    first = whole(start) if start == whole(start) else whole(start) + timedelta(hours=1)
    return hourly(samples.where((F.col("time") >= F.lit(first)) & (F.col("time") < F.lit(end))))


def raw_range(samples: DataFrame, pv_id: int, start: datetime, end: datetime, limit: int = 0) -> DataFrame:
    """Samples of a signal with start <= time < end by time; a limit of 0 is none. All predicates reach the scan."""
    out = samples.where((F.col("pv_id") == pv_id) & (F.col("time") >= F.lit(start)) & (F.col("time") < F.lit(end))).orderBy("time", "tiebreak")
    return out.limit(limit) if limit > 0 else out


def agg_range(rolled: DataFrame, pv_id: int, start: datetime, end: datetime) -> DataFrame:
    """Roll-up rows of a signal with start <= bucket < end by bucket."""
    return rolled.where((F.col("pv_id") == pv_id) & (F.col("bucket") >= F.lit(start)) & (F.col("bucket") < F.lit(end))).orderBy("bucket")


def tier(start: datetime, end: datetime, forced: str | None = None) -> str:
    """raw up to 6 hours, hourly up to 7 days, daily beyond; a forced tier wins."""
    span = end - start
    return forced or ("raw" if span <= timedelta(hours=6) else "hourly" if span <= timedelta(days=7) else "daily")


def auto_range(samples: DataFrame, hours: DataFrame, days: DataFrame, pv_id: int, start: datetime, end: datetime, limit: int = 0, forced: str | None = None) -> DataFrame:
    """One signal's range from the tier that its span asks for: time, value, and what the tier has of min, max and count."""
    chosen = tier(start, end, forced)
    if chosen == "raw":
        rows = raw_range(samples, pv_id, start, end, limit)
        return rows.select("time", "value", F.col("value").alias("min_value"), F.col("value").alias("max_value"), F.lit(1).cast("long").alias("sample_count"), F.lit("raw").alias("tier"))
    rows = agg_range(hours if chosen == "hourly" else days, pv_id, start, end)
    return rows.select(F.col("bucket").alias("time"), F.col("avg_value").alias("value"), "min_value", "max_value", "sample_count", F.lit(chosen).alias("tier"))


def latest(samples: DataFrame) -> DataFrame:
    """The newest sample of each signal."""
    order = order_key()
    return samples.groupBy("pv_id").agg(F.max("time").alias("time"), *(F.max_by(c, order).alias(c) for c in ("value", "severity", "status")))


def first_last(samples: DataFrame) -> DataFrame:
    """The oldest and the newest value of each signal."""
    order = order_key()
    return samples.groupBy("pv_id").agg(F.min_by("value", order).alias("first_value"), F.max_by("value", order).alias("last_value"))


def count_range(samples: DataFrame, pv_id: int, start: datetime, end: datetime) -> DataFrame:
    return samples.where((F.col("pv_id") == pv_id) & (F.col("time") >= F.lit(start)) & (F.col("time") < F.lit(end))).agg(F.count("*").alias("n"))
