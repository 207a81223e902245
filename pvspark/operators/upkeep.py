"""Ingest accounting, retention, layout and chunk advice."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Days that each table's rows are kept; tables that are not here are kept.
RETENTION_DAYS = {
    "samples": 90, "samples_string": 90, "samples_array_num": 90, "samples_array_str": 90, "samples_table": 90, "samples_image": 90, "samples_custom": 90,
    "samples_nv": 90, "samples_hist": 90, "samples_cont": 90, "samples_mch": 90, "samples_hourly": 730, "alert_log": 365, "pv_events": 365,
}


def ingest_report(outcomes: DataFrame, by: list[str]) -> DataFrame:
    """Counts by outcome (fast, slow, skipped, unknown_pv, disconnect, reconnect) and the whole percentage of the fast path, 0 if nothing was published."""
    n = lambda *x: F.count_if(F.col("outcome").isin(*x))
    out = outcomes.groupBy(*by).agg(
        F.count("*").alias("received"), n("fast", "slow").alias("published"), n("skipped").alias("skipped"), n("fast").alias("fast"), n("slow").alias("slow"),
        n("unknown_pv").alias("unknown_pv"), n("disconnect").alias("disconnects"), n("reconnect").alias("reconnects"),
    )
    return out.withColumn("fast_percent", F.when(F.col("published") > 0, F.floor(F.col("fast") * 100 / F.col("published"))).otherwise(0).cast("long"))


def loss_accounting(outcomes: DataFrame, window: str = "1 hour") -> DataFrame:
    """Per window: written, lost and dropped rows, the running loss, and whether it grew. The window function sees one row for each window."""
    n = lambda x: F.count_if(F.col("outcome") == x)
    rows = outcomes.groupBy(F.window("time", window)["start"].alias("bucket")).agg(n("written").alias("written"), n("lost").alias("lost"), n("dropped").alias("dropped"))
    w = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("total_loss", F.sum(F.col("lost") + F.col("dropped")).over(w)).withColumn("grew", F.col("lost") + F.col("dropped") > 0)


def throttled(windows: DataFrame, gap: int, chunk: int = 8640) -> DataFrame:
    """Windows (n consecutive numbers, grew) that raise an alert: those that grew, if the last alert is at least `gap` windows ago.

    Runs of `chunk` windows (`gap` at least) fold by themselves, for each number of windows that the last alert can still hold off at their start;
    then one row for each run gives what holds at each start. No list holds more than the windows of one run, or one row for each run.
    """
    chunk = max(chunk, gap)
    rows = windows.where("grew").groupBy(F.floor(F.col("n") / chunk).alias("c")).agg(F.array_sort(F.collect_list(F.col("n").cast("long"))).alias("ns"))
    begin, left = F.col("c") * chunk, lambda after: F.greatest(F.lit(0).cast("long"), after)
    fold = lambda r: F.aggregate("ns", begin + r, lambda free, x: F.when(x >= free, x + gap).otherwise(free))
    maps = rows.select("c", F.transform(F.sequence(F.lit(0), F.lit(max(0, gap - 1))), lambda r: left(fold(r) - begin - chunk)).alias("then"))
    ordered = maps.agg(F.array_sort(F.collect_list(F.struct("c", "then"))).alias("d"))
    zero = F.struct(F.lit(None).cast("long").alias("c"), F.lit(0).cast("long").alias("r"), F.array().cast("array<struct<c:bigint,r:bigint>>").alias("out"))

    def entered(acc, x):
        r = F.coalesce(left(acc["r"] - (x["c"] - acc["c"] - 1) * chunk), F.lit(0).cast("long"))
        return F.struct(x["c"].alias("c"), F.get(x["then"], r.cast("int")).alias("r"), F.concat(acc["out"], F.array(F.struct(x["c"].alias("c"), r.alias("r")))).alias("out"))

    starts = ordered.select(F.explode(F.aggregate("d", zero, entered, lambda acc: acc["out"])).alias("x")).select("x.c", "x.r")
    last = lambda acc: F.get(acc, F.size(acc) - 1)
    alerts = F.aggregate(
        "ns", F.array().cast("array<bigint>"), lambda acc, x: F.when(x >= F.coalesce(last(acc) + gap, begin + F.col("r")), F.concat(acc, F.array(x))).otherwise(acc)
    )
    return rows.join(starts, "c").select(F.explode(alerts).alias("n"))


def loss_alerts(outcomes: DataFrame, tick: int = 10, gap: int = 30) -> DataFrame:
    """Ticks (numbers of `tick` seconds) that raise an alert: those with lost or dropped rows, at most one in `gap` ticks."""
    n = F.floor(F.unix_micros(F.col("time").cast("timestamp")) / (tick * 1_000_000))
    return throttled(outcomes.where(F.col("outcome").isin("lost", "dropped")).select(n.alias("n"), F.lit(True).alias("grew")).distinct(), gap)


def retention(partitions: DataFrame, now: datetime, days: dict[str, int] | None = None) -> DataFrame:
    """Partitions (table, date) that are past their table's retention, to be dropped whole."""
    policy = F.create_map(*(F.lit(x) for pair in (days or RETENTION_DAYS).items() for x in pair))
    return partitions.where(F.col("date") < F.date_sub(F.lit(now.date()), policy[F.col("table")]))


def storage_report(rows: DataFrame, by: list[str], payload: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("rows"), F.sum(F.length(payload)).cast("long").alias("bytes"))


def compacted(samples: DataFrame) -> DataFrame:
    """Rows clustered for storage: ranges of days and signals, newest first within a signal."""
    return samples.withColumn("date", F.to_date("time")).repartitionByRange("date", "pv_id").sortWithinPartitions("date", "pv_id", F.desc("time"))


def recommend_chunk(rates: DataFrame, max_rows: float, least: int = 60, most: int = 86_400, ratio: float = 1.3) -> DataFrame:
    """rates (n, per_s) with the advised chunk in seconds, and whether it differs from the one before by more than the ratio."""
    seconds = F.when(F.col("per_s") > 0, F.least(F.greatest(F.floor(max_rows / F.col("per_s")), F.lit(least)), F.lit(most))).otherwise(most).cast("long")
    rows = rates.withColumn("seconds", seconds).withColumn("before", F.lag("seconds").over(Window.orderBy("n")))
    change = F.greatest(F.col("seconds") / F.col("before"), F.col("before") / F.col("seconds")) > ratio
    text = F.when(F.col("seconds") >= 3600, F.concat(F.floor(F.col("seconds") / 3600).cast("string"), F.lit(" hours"))).otherwise(F.concat(F.floor(F.col("seconds") / 60).cast("string"), F.lit(" minutes")))
    return rows.select("n", "per_s", "seconds", F.coalesce(change, F.lit(True)).alias("change"), text.alias("chunk"))

