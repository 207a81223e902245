"""Signal status, heartbeats, timeouts and connectivity."""

from __future__ import annotations

from datetime import datetime, timedelta
from decimal import Decimal

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pvspark.functions import columns as C
from pvspark.operators.rollup import order_key
from pvspark.operators.segments import scanned

# Codes of lifecycle events and of states.
SUBSCRIBE, CONNECTED, FIRST_VALUE, DISCONNECT, RECONNECT, TIMEOUT, UNSUBSCRIBE, IOC_REMOVED = range(8)
INIT, SEARCHING, LINKED, ARCHIVING, DISCONNECTED, TIMED_OUT, UNSUBSCRIBED = range(7)

RUN = 8640  # heartbeats that are made at a time

_INTO = ((SUBSCRIBE,), (SUBSCRIBE, CONNECTED), (FIRST_VALUE,), (DISCONNECT,), (FIRST_VALUE, TIMEOUT), (UNSUBSCRIBE,))


def pv_stats(samples: DataFrame, window_seconds: float = 30.0) -> DataFrame:
    """Per signal: number of events, last value and severity, and the rate over the window."""
    order = order_key()
    return samples.groupBy("pv_id").agg(
        F.count("*").alias("events"), F.max_by("value", order).alias("last_value"), F.max_by("severity", order).alias("last_severity"), F.max("time").alias("last_event_at"),
        (F.count("*") / window_seconds).alias("update_hz"),
    )


def status_update(status: DataFrame, stats: DataFrame) -> DataFrame:
    """The status table with the values of the statistics where there are any; other rows stay."""
    new = stats.select("pv_id", *(F.col(c).alias(f"_{c}") for c in ("events", "last_value", "last_severity", "last_event_at", "update_hz")))
    joined = status.join(new, "pv_id", "left")
    out = {c: F.coalesce(F.col(f"_{c}"), F.col(c)) for c in ("last_value", "last_severity", "last_event_at", "update_hz")}
    out["events_total"] = F.col("events_total") + F.coalesce("_events", F.lit(0))
    out["state"] = F.when((F.col("state") == LINKED) & F.col("_events").isNotNull(), ARCHIVING).otherwise(F.col("state")).cast("smallint")
    return joined.withColumns(out).select(*status.columns)


def status_windows(table: DataFrame, samples: DataFrame, seconds: int = 30) -> DataFrame:
    """The rows of the status table whose signals have new samples, with their statistics. update_hz is the rate of the newest window of so many seconds that has any of
    a signal's samples; `window` and `in_window` say which and how many, so that samples of it that come later are added. Late samples count as events only."""
    order = order_key()
    micros, at = F.unix_micros(F.col("time").cast("timestamp")), F.col("window")
    start = F.timestamp_micros(micros - F.pmod(micros, F.lit(seconds * 1_000_000)))
    of_window = samples.groupBy("pv_id", start.alias("_window")).agg(F.count("*").alias("_n"), F.max(order).alias("_order"), F.max("time").alias("_time"), *(F.max_by(c, order).alias(f"_{c}") for c in ("value", "severity")))
    new = of_window.groupBy("pv_id").agg(F.sum("_n").alias("_events"), F.max("_window").alias("_window"), F.max_by("_n", "_window").alias("_n"), F.max("_time").alias("_time"), *(F.max_by(f"_{c}", "_order").alias(f"_{c}") for c in ("value", "severity")))
    joined, later = table.join(new, "pv_id"), F.col("last_event_at").isNull() | (F.col("_time") >= F.col("last_event_at"))
    count = F.when(at.isNull() | (F.col("_window") > at), F.col("_n")).when(F.col("_window") == at, F.col("_n") + F.col("in_window")).otherwise(F.col("in_window"))
    out = {"window": F.greatest("window", "_window"), "in_window": count, "update_hz": count / float(seconds), "last_event_at": F.greatest("last_event_at", F.col("_time").cast("timestamp")), "events_total": F.col("events_total") + F.col("_events")}
    out |= {f"last_{c}": F.when(later, F.col(f"_{c}")).otherwise(F.col(f"last_{c}")) for c in ("value", "severity")}
    out["state"] = F.when(F.col("state") == LINKED, ARCHIVING).otherwise(F.col("state")).cast("smallint")
    return joined.withColumns(out).select(*table.columns)


def _micros(column: str):
    return F.unix_micros(F.col(column).cast("timestamp"))


def _every(samples: DataFrame, default_s: float, overrides: DataFrame) -> DataFrame:
    """samples with the microseconds between heartbeats as `every`, null where there are none."""
    rows = samples.join(overrides.select("pv_id", "heartbeat_s"), "pv_id", "left").withColumn("every", F.coalesce("heartbeat_s", F.lit(default_s)))
    return rows.withColumn("every", F.when((F.col("every") > 0) & ~C.non_finite(F.col("value")), (F.col("every") * 1_000_000).cast("long")))


def _until(samples: DataFrame, now: datetime) -> DataFrame:
    """samples with the time of their signal's next one as `until`, now for the last. A table's signals may be large and are cut; the samples of a micro-batch, which have a time `since`,
    are few for each signal."""
    if "since" in samples.columns:
        rows = samples.withColumn("until", F.lead("time").over(Window.partitionBy("pv_id").orderBy("time", "tiebreak")))
    else:
        rows = scanned(samples, "pv_id", ["time", "tiebreak"], after={"until": "time"})
    return rows.withColumn("until", F.coalesce("until", F.lit(now).cast("timestamp_ntz")))


def heartbeats(samples: DataFrame, default_s: float, overrides: DataFrame, now: datetime) -> DataFrame:
    """Rows at exact multiples of a signal's interval after each real sample, before the next one (or up to now), with its value and alarm.

    overrides (pv_id, heartbeat_s): null the default, 0 or less off. Non-finite values give none. Where samples have a time `since`, no row before it is made.
    """
    rows = _every(_until(samples, now), default_s, overrides)
    n = F.floor((_micros("until") - _micros("time") - 1) / F.col("every")).cast("long")
    first = F.lit(1).cast("long")
    if "since" in samples.columns:
        first = F.greatest(first, F.ceil((_micros("since") - _micros("time")) / F.col("every")).cast("long"))
    # Runs of bounded size: a long silence makes many rows, not one long array.
    runs = rows.withColumn("n", n).withColumn("k0", first).withColumn("run", F.explode(F.when(F.col("n") >= F.col("k0"), F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - F.col("k0")) / RUN)))))
    beats = runs.withColumn("k", F.explode(F.sequence(F.col("run") * RUN + F.col("k0"), F.least("n", (F.col("run") + 1) * RUN + F.col("k0") - 1))))
    at = F.timestamp_micros(_micros("time") + F.col("k") * F.col("every")).cast("timestamp_ntz")
    return beats.select(at.alias("time"), "pv_id", "value", "severity", "status", F.lit(1).cast("smallint").alias("reason"))


def heartbeats_due(last: DataFrame, default_s: float, overrides: DataFrame, now: datetime) -> DataFrame:
    """Each signal's last sample with the time of its first heartbeat at or after now, as `due`; null where it has none."""
    past = F.lit(now).cast("timestamp")
    k = F.greatest(F.lit(1).cast("long"), F.ceil((F.unix_micros(past) - _micros("time")) / F.col("every")).cast("long"))
    return _every(last, default_s, overrides).withColumn("due", F.timestamp_micros(_micros("time") + k * F.col("every"))).select(*last.columns, "due")


def timeouts(samples: DataFrame, after_s: float, now: datetime) -> DataFrame:
    """Gaps of more than `after_s` seconds: the sentinel row at their end of patience. Where samples have a time `since`, no row before it is made."""
    rows = _until(samples, now)
    rows = rows.where(C.seconds_between(F.col("time"), F.col("until")) > after_s)
    at = F.timestamp_micros(_micros("time") + int(after_s * 1_000_000)).cast("timestamp_ntz")
    if "since" in samples.columns:
        rows = rows.where(F.col("since").isNull() | (at >= F.col("since")))
    return rows.select(at.alias("time"), "pv_id", *sentinel(105, 10))


def timeouts_due(last: DataFrame, after_s: float, now: datetime) -> DataFrame:
    """Each signal's last sample with the end of its patience as `due`; null where that is over."""
    at = F.timestamp_micros(_micros("time") + int(after_s * 1_000_000))
    return last.withColumn("due", F.when(at >= F.lit(now).cast("timestamp"), at))


def sentinel(status: int, reason: int):
    """The not-a-number sample that marks a loss or return of a signal."""
    return F.lit(float("nan")).alias("value"), F.lit(3).cast("smallint").alias("severity"), F.lit(status).cast("smallint").alias("status"), F.lit(reason).cast("smallint").alias("reason")


def status_scan(status: DataFrame, stats: DataFrame, now: datetime, after_s: float = 60.0) -> DataFrame:
    """The status table after a scan: the statistics are taken in, archiving signals whose last event is older than `after_s` time out, and every signal has its
    health for its new state. timed_out_now marks those that this scan timed out."""
    rows = status_update(status, stats)
    silent = F.coalesce((F.col("state") == ARCHIVING) & (F.col("last_event_at") < F.lit(now - timedelta(seconds=after_s))), F.lit(False))
    rows = rows.withColumn("timed_out_now", silent).withColumn("state", F.when(F.col("timed_out_now"), TIMED_OUT).otherwise(F.col("state")).cast("smallint"))
    return rows.withColumn("health_score", C.health_score(F.col("state"), F.col("subscribed_at"), F.col("connected_at"), F.col("last_event_at"), F.lit(now)))


def scan_samples(scanned: DataFrame, now: datetime) -> DataFrame:
    """The sentinel samples of the signals that a scan timed out."""
    return scanned.where("timed_out_now").select(F.lit(now).cast("timestamp_ntz").alias("time"), "pv_id", *sentinel(105, 10))


def lifecycle_samples(events: DataFrame) -> DataFrame:
    """Sentinel samples of disconnects and reconnects."""
    down = events.where(F.col("event_type") == DISCONNECT).select(F.col("ts").alias("time"), "pv_id", *sentinel(103, 3))
    return down.unionByName(events.where(F.col("event_type") == RECONNECT).select(F.col("ts").alias("time"), "pv_id", *sentinel(104, 4)))


def status_fold(events: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """Each signal's state after all its events in order; it starts from INIT, or from the signal's state in `before` (pv_id, state).

    Most events set the state whatever it was. After the last of them only the others count: from ARCHIVING, the first TIMEOUT, and the last
    CONNECTED after it; from INIT, SEARCHING and DISCONNECTED, any CONNECTED. All are plain aggregates, and no list is made.
    """
    events = events.select("pv_id", F.lit(0).alias("_seq"), "ts", "event_id", "event_type")
    if before is not None:
        # The events that lead to a state stand for it, before all others.
        into = [F.array(*(F.struct(F.lit(k - 9).alias("_seq"), F.lit(c).alias("event_type")) for k, c in enumerate(codes))) for codes in _INTO]
        past = before.where(F.col("state") != INIT).join(events.select(F.col("pv_id").alias("_pv")).distinct(), F.col("pv_id").eqNullSafe(F.col("_pv")), "left_semi")
        past = past.select("pv_id", F.inline(F.get(F.array(*into), F.col("state") - 1)))
        events = events.unionByName(past, allowMissingColumns=True)
    # Place in the batch, time and id as one number, nulls first: all aggregates are of numbers, so they stay hash aggregates.
    micros = F.coalesce(F.unix_micros(F.col("ts").cast("timestamp")), F.lit(-(1 << 53))).cast("decimal(18,0)")
    at = (F.col("_seq").cast("decimal(3,0)") * F.lit(Decimal(1 << 118))).cast("decimal(38,0)") + (micros * F.lit(Decimal(1 << 64))).cast("decimal(38,0)") + F.coalesce("event_id", F.lit(-(1 << 63))).cast("decimal(19,0)")
    events = events.select("pv_id", F.col("event_type").alias("code"), at.cast("decimal(38,0)").alias("at"))
    code, at = F.col("code"), F.col("at")
    setter = code.isin(SUBSCRIBE, FIRST_VALUE, DISCONNECT, RECONNECT, UNSUBSCRIBE, IOC_REMOVED)
    last = events.groupBy("pv_id").agg(F.max(F.when(setter, at)).alias("last"), F.max_by(code, F.when(setter, at)).alias("by"))
    after = events.where(code.isin(CONNECTED, TIMEOUT)).select(F.col("pv_id").alias("_pv"), "at", "code").join(last, F.col("_pv").eqNullSafe(F.col("pv_id")))
    after = after.where(F.col("last").isNull() | (at > F.col("last"))).groupBy("_pv").agg(F.min(F.when(code == TIMEOUT, at)).alias("timeout"), F.max(F.when(code == CONNECTED, at)).alias("connected"))
    by = F.col("by")
    state = (
        F.when(by.isin(UNSUBSCRIBE, IOC_REMOVED), UNSUBSCRIBED)
        .when(by.isin(FIRST_VALUE, RECONNECT), F.when(F.col("connected") > F.col("timeout"), LINKED).when(F.col("timeout").isNotNull(), TIMED_OUT).otherwise(ARCHIVING))
        .when(F.col("connected").isNotNull(), LINKED)
        .when(by == SUBSCRIBE, SEARCHING)
        .when(by == DISCONNECT, DISCONNECTED)
        .otherwise(INIT)
    )
    return last.join(after, F.col("pv_id").eqNullSafe(F.col("_pv")), "left").select("pv_id", state.cast("smallint").alias("state"))


def connectivity_intervals(events: DataFrame) -> DataFrame:
    """From each disconnect to the signal's next reconnect; the end is null while it is down. Repeated disconnects count once."""
    rows = events.where(F.col("event_type").isin(DISCONNECT, RECONNECT)).withColumn("_up", F.when(F.col("event_type") == RECONNECT, F.col("ts")))
    rows = scanned(rows, "pv_id", ["ts", "event_id"], before={"_before": "event_type"}, coming={"_until": "_up"})
    rows = rows.where((F.col("event_type") == DISCONNECT) & F.coalesce(F.col("_before") == RECONNECT, F.lit(True)))
    return rows.select("pv_id", F.col("ts").alias("down_at"), F.col("_until").alias("up_at"))
