"""The device report."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pvspark.functions import columns as C
from pvspark.operators.rollup import order_key


def counts(status: DataFrame) -> DataFrame:
    """Per device: signals in total and by state, rate, health and times."""
    state = {"searching": (1,), "connected": (2,), "archiving": (3,), "disconnected": (4,), "timed_out": (5,), "unsubscribed": (6,)}
    return status.where("ioc_addr is not null").groupBy(F.col("ioc_addr").alias("address")).agg(
        F.count("*").alias("total"), *(F.count_if(F.col("state").isin(*codes)).alias(name) for name, codes in state.items()),
        F.sum("update_hz").alias("events_per_s"), F.avg("health_score").alias("health"), F.min("connected_at").alias("started_at"), F.max("last_event_at").alias("last_event_at"),
    )


def merged(declared: DataFrame, observed: DataFrame) -> DataFrame:
    """Declared and observed devices, each once; counts, rate and health of devices without signals are 0."""
    both = declared.select("address", "label", "enabled", F.lit(True).alias("declared")).join(observed, "address", "full_outer")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("total", "searching", "connected", "archiving", "disconnected", "timed_out", "unsubscribed", "events_per_s", "health")}
    return both.withColumns({"label": F.coalesce("label", F.lit("")), "declared": F.coalesce("declared", F.lit(False)), "enabled": F.coalesce("enabled", F.lit(True))} | zero)


def events_24h(events: DataFrame, now: datetime) -> DataFrame:
    recent = events.where((F.col("ts") > F.lit(now - timedelta(hours=24))) & F.col("ioc_addr").isNotNull())
    return recent.groupBy(F.col("ioc_addr").alias("address")).agg(
        F.count_if(F.col("event_type") == 3).alias("disconnects_24h"), F.count_if(F.col("event_type") == 4).alias("reconnects_24h"), F.max(F.when(F.col("event_type") == 3, F.col("ts"))).alias("last_disconnect")
    )


def last_error(events: DataFrame) -> DataFrame:
    """The newest detail of a device's disconnects, timeouts and removals. The newest event's key is found first, by hash; texts are compared only where two share it."""
    bad = events.where(F.col("event_type").isin(3, 5, 7) & F.col("detail").isNotNull() & F.col("ioc_addr").isNotNull())
    bad = bad.select(F.col("ioc_addr").alias("address"), order_key("ts", "event_id").alias("_at"), "detail")
    newest = bad.groupBy("address").agg(F.max("_at").alias("_at"))
    return bad.join(newest, ["address", "_at"]).groupBy("address").agg(F.max("detail").alias("last_error"))


def view(declared: DataFrame, status: DataFrame, events: DataFrame, now: datetime, search: str = "", state: str | None = None) -> DataFrame:
    """The whole report, filtered by a part of the label or address and by state, in order of the label or else the address."""
    rows = merged(declared, counts(status)).join(events_24h(events, now), "address", "left").join(last_error(events), "address", "left")
    live, lost = F.col("archiving") + F.col("connected"), F.col("disconnected") + F.col("timed_out")
    rows = rows.withColumn("state", C.ioc_state(F.col("declared"), F.col("enabled"), F.col("total"), live, lost, F.col("unsubscribed")))
    rows = rows.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("disconnects_24h", "reconnects_24h")}).withColumn("events_per_s", F.round("events_per_s").cast("long"))
    return ordered(by_state(found(rows, search), state))


def found(rows: DataFrame, search: str) -> DataFrame:
    """Rows whose label or address holds the text, whatever its case; all rows for a blank one."""
    if not search.strip():
        return rows
    pattern = C.like_pattern(search, escape=True)
    return rows.where(F.col("label").ilike(pattern) | F.col("address").ilike(pattern))


def by_state(rows: DataFrame, state: str | None) -> DataFrame:
    return rows if state is None else rows.where(F.col("state") == state)


def ordered(rows: DataFrame) -> DataFrame:
    return rows.orderBy(F.coalesce(F.nullif("label", F.lit("")), "address"))
