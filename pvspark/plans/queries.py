"""The registered queries of the archive's own operators, each with the SQL that states its result."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pvspark.functions import columns as C
from pvspark.operators import alerts, catalog, fleet, lifecycle, reconcile, reshape, rollup, segments, upkeep
from pvspark.sources import tables
from pvspark.plans import ingest_queries, upkeep_queries  # noqa: F401  they register themselves
from pvspark.plans.registry import oracle_sql, queries, query
from pvspark.sources.bindings import NOW
from pvspark.streaming import jobs

START, END = datetime(2024, 1, 3), datetime(2024, 1, 12)
PV = 8

HOURLY = """, hourly AS (SELECT date_trunc('hour', time) AS bucket, pv_id, avg(value) AS avg_value, min(value) AS min_value, max(value) AS max_value, stddev_samp(value) AS stddev_value, count(value) AS sample_count,
 arg_min(value, (time, tiebreak)) AS first_value, arg_max(value, (time, tiebreak)) AS last_value, max(severity) AS max_severity, sum(value) AS sum_value, sum(value * value) AS sum_squares FROM samples GROUP BY ALL)"""
DAILY = HOURLY + """, daily AS (SELECT date_trunc('day', bucket) AS bucket, pv_id, sum(sum_value) / sum(sample_count) AS avg_value, min(min_value) AS min_value, max(max_value) AS max_value,
 CASE WHEN sum(sample_count) > 1 THEN sqrt(greatest(sum(sum_squares) - sum(sum_value) * sum(sum_value) / sum(sample_count), 0) / (sum(sample_count) - 1)) END AS stddev_value,
 CAST(sum(sample_count) AS BIGINT) AS sample_count, arg_min(first_value, bucket) AS first_value, arg_max(last_value, bucket) AS last_value, max(max_severity) AS max_severity FROM hourly GROUP BY 1, 2)"""
ROLL = "bucket, pv_id, round(avg_value, 6) AS avg_value, min_value, max_value, round(stddev_value, 4) AS stddev_value, sample_count, first_value, last_value, CAST(max_severity AS INT) AS max_severity"


def rolled(df: DataFrame) -> DataFrame:
    return df.select("bucket", "pv_id", F.round("avg_value", 6).alias("avg_value"), "min_value", "max_value", F.round("stddev_value", 4).alias("stddev_value"), "sample_count", "first_value", "last_value", F.col("max_severity").cast("int").alias("max_severity"))


_TIERS: dict[tuple[str, str], str] = {}


def tiers(b) -> str:
    """The folder of the stored hourly and daily tables; written once in a session, then read, as an archive does."""
    key = (b.spark.sparkContext.applicationId, b.sf_dir)
    if key not in _TIERS:
        root = tables.folder(b.spark)
        tables.write_tiers(b.samples, root)
        _TIERS[key] = root
    return _TIERS[key]


# Roll-ups and reads


@query(f"{HOURLY} SELECT {ROLL} FROM hourly")
def hourly_rollup(b):
    return rolled(rollup.hourly(b.samples))


@query(f"{DAILY} SELECT {ROLL} FROM daily")
def daily_rollup(b):
    return rolled(rollup.daily(rollup.hourly(b.samples)))


@query("SELECT pv_id, arg_min(value, (time, tiebreak)) AS first_value, arg_max(value, (time, tiebreak)) AS last_value FROM samples GROUP BY pv_id")
def first_last(b):
    return rollup.first_last(b.samples)


@query(f"{HOURLY} SELECT {ROLL} FROM hourly")
def realtime_rollup(b):
    cut = b.now.replace(minute=0, second=0, microsecond=0) - timedelta(hours=6)
    return rolled(rollup.realtime(tables.read_tier(b.spark, tiers(b), "hourly", end=cut), b.samples, cut))


@query(f"{HOURLY} SELECT {ROLL} FROM hourly WHERE bucket >= date_trunc('hour', {NOW} - INTERVAL 3 HOUR) + INTERVAL 1 HOUR AND bucket < date_trunc('hour', {NOW} - INTERVAL 1 HOUR)")
def refresh_rollup(b):
    return rolled(rollup.refreshed(b.samples, b.now, timedelta(hours=3), timedelta(hours=1)))


@query(f"""{DAILY.replace(" FROM hourly GROUP", f" FROM hourly WHERE bucket < date_trunc('hour', {NOW} - INTERVAL 1 HOUR) GROUP")} SELECT {ROLL} FROM daily""")
def refresh_tiers(b):
    """Tables of what was there three days ago, refreshed from there up to an hour ago: the daily table, made from the hourly one."""
    root, old = tables.folder(b.spark), (b.now - timedelta(days=3)).replace(minute=0, second=0, microsecond=0)
    tables.write_tiers(b.samples.where(F.col("time") < F.lit(old)), root)
    tables.refresh_tiers(b.samples, root, b.now, timedelta(days=3), timedelta(hours=1))
    return rolled(tables.read_tier(b.spark, root, "daily"))


@query(f"SELECT time, pv_id, value, CAST(severity AS INT) AS severity FROM samples WHERE pv_id = {PV} AND time >= '2024-01-03' AND time < '2024-01-12'")
def raw_range(b):
    return rollup.raw_range(b.samples, PV, START, END).select("time", "pv_id", "value", F.col("severity").cast("int").alias("severity"))


@query(f"{HOURLY} SELECT {ROLL} FROM hourly WHERE pv_id = {PV} AND bucket >= '2024-01-03' AND bucket < '2024-01-12'")
def agg_range(b):
    return rolled(rollup.agg_range(tables.read_tier(b.spark, tiers(b), "hourly", START, END), PV, START, END))


@query(f"SELECT time, value FROM samples WHERE pv_id = {PV} AND time >= '2024-01-03' AND time < '2024-01-12' ORDER BY time, tiebreak LIMIT 10")
def order_limit(b):
    return rollup.raw_range(b.samples, PV, START, END, 10).select("time", "value")


@query(f"SELECT count(*) AS n FROM samples WHERE pv_id = {PV} AND time >= '2024-01-03' AND time < '2024-01-12'")
def count_range(b):
    return rollup.count_range(b.samples, PV, START, END)


@query("SELECT pv_id, arg_max(time, (time, tiebreak)) AS time, arg_max(value, (time, tiebreak)) AS value, CAST(arg_max(severity, (time, tiebreak)) AS INT) AS severity FROM samples GROUP BY pv_id")
def latest_value(b):
    return rollup.latest(b.samples).select("pv_id", "time", "value", F.col("severity").cast("int").alias("severity"))


@query(f"{DAILY} SELECT bucket AS time, round(avg_value, 6) AS value, min_value, max_value, sample_count, 'daily' AS tier FROM daily WHERE pv_id = {PV} AND bucket >= '2024-01-03' AND bucket < '2024-01-12'")
def query_auto(b):
    return tables.read_auto(b.spark, tiers(b), b.samples, PV, START, END).withColumn("value", F.round("value", 6))


_OLD: dict[tuple[str, str], str] = {}


def old_tiers(b) -> str:
    """The folder of tiers that were last refreshed days ago, in the middle of an hour; written once in a session."""
    key = (b.spark.sparkContext.applicationId, b.sf_dir)
    if key not in _OLD:
        root, cut = tables.folder(b.spark), b.now - timedelta(days=5, hours=7, minutes=11)
        tables.write_tiers(b.samples.where(F.col("time") < F.lit(cut)), root, cut)
        _OLD[key] = root
    return _OLD[key]


LATE = datetime(2024, 1, 14)


@query(f"{DAILY} SELECT bucket AS time, round(avg_value, 6) AS value, min_value, max_value, sample_count, 'daily' AS tier FROM daily WHERE pv_id = {PV} AND bucket >= '2024-01-14'")
def query_auto_live(b):
    """A range up to now over tiers that were last refreshed days ago."""
    return tables.read_auto(b.spark, old_tiers(b), b.samples, PV, LATE, b.now + timedelta(seconds=1)).withColumn("value", F.round("value", 6))


@query(f"{HOURLY} SELECT {ROLL} FROM hourly")
def live_hourly(b):
    return rolled(tables.read_live(b.spark, old_tiers(b), "hourly", b.samples))


@query(f"{DAILY} SELECT {ROLL} FROM daily")
def live_daily(b):
    return rolled(tables.read_live(b.spark, old_tiers(b), "daily", b.samples))


_REFRESHED: dict[tuple[str, str], str] = {}


def late_tiers(b) -> str:
    """The folder of tiers that were written without some samples, which then came up to a month late; written once in a session."""
    key = (b.spark.sparkContext.applicationId, b.sf_dir)
    if key not in _REFRESHED:
        root, late = tables.folder(b.spark), F.col("tiebreak") % 50 == 7
        tables.write_tiers(b.samples.where(~late), root, b.now + timedelta(days=1))
        tables.refresh_late(b.samples, b.samples.where(late), root)
        _REFRESHED[key] = root
    return _REFRESHED[key]


@query(f"{HOURLY} SELECT {ROLL} FROM hourly")
def late_hourly(b):
    return rolled(tables.read_tier(b.spark, late_tiers(b), "hourly"))


@query(f"{DAILY} SELECT {ROLL} FROM daily")
def late_daily(b):
    return rolled(tables.read_tier(b.spark, late_tiers(b), "daily"))


@query("SELECT event_id, CASE WHEN date_diff('microsecond', ts, e) <= 21600000000 THEN 'raw' WHEN date_diff('microsecond', ts, e) <= 604800000000 THEN 'hourly' ELSE 'daily' END AS tier FROM (SELECT event_id, ts, ts + to_hours(event_id % 400) AS e FROM events)")
def tier_select(b):
    end = F.expr("ts + make_dt_interval(0, CAST(event_id % 400 AS INT))")
    return b.events.select("event_id", C.tier_of(F.col("ts"), end).alias("tier"))


# Filters and predicates


def config_columns(df):
    return df.select("pv_name", "description", "heartbeat_s", "expected_ioc", "enabled")


CONFIG = "SELECT pv_name, description, heartbeat_s, expected_ioc, enabled FROM config_before"


@query(f"{CONFIG} WHERE enabled")
def config_enabled(b):
    return config_columns(catalog.enabled(b.config_before))


@query(f"{CONFIG} WHERE expected_ioc = 'ioc3'")
def config_by_ioc(b):
    return config_columns(b.config_before.where("expected_ioc = 'ioc3'").orderBy("pv_name"))


@query(f"{CONFIG} WHERE pv_name = 'Supplier#000000001'")
def config_get(b):
    return config_columns(b.config_before.where(F.col("pv_name") == "Supplier#000000001"))


@query("SELECT pv_name, updated_at FROM (SELECT * FROM config_before UNION ALL SELECT * FROM config_after) WHERE updated_at > '2024-01-01 12:00:00'")
def config_changed_since(b):
    return catalog.changed_since(b.config_before.unionByName(b.config_after), datetime(2024, 1, 1, 12)).select("pv_name", "updated_at")


@query(f"{CONFIG} WHERE pv_name ILIKE '%LIER#00000_0%' ORDER BY pv_name LIMIT 1000")
def config_search(b):
    return config_columns(catalog.search(b.config_before, "LIER#00000_0", 5000))


@query("SELECT name, id, data_type FROM pv_metadata WHERE data_type = 'enum'")
def metadata_by_type(b):
    return b.pv_metadata.where("data_type = 'enum'").select("name", "id", "data_type")


@query("SELECT name, id, data_type FROM pv_metadata WHERE id = 7")
def metadata_get(b):
    return b.pv_metadata.where("id = 7").select("name", "id", "data_type")


@query("SELECT name, id, data_type FROM pv_metadata")
def metadata_list(b):
    return b.pv_metadata.orderBy("name", "id").select("name", "id", "data_type")


@query("SELECT id, display_low < display_high AS has_display_range, control_low < control_high AS has_control_range, alarm_lolo <> 0 OR alarm_low <> 0 OR alarm_high <> 0 OR alarm_hihi <> 0 AS has_alarm_limits, data_type = 'enum' AS is_enum, data_type = 'image' AS is_image FROM pv_metadata")
def metadata_flags(b):
    rows = b.pv_metadata.withColumn("enum_choices", F.when(F.col("data_type") == "enum", F.array(F.lit("Open"), F.lit("Closed"))).otherwise(F.array().cast("array<string>")))
    return catalog.flags(rows).select("id", "has_display_range", "has_control_range", "has_alarm_limits", "is_enum", "is_image")


@query("SELECT id, CASE WHEN precision < 0 THEN 0 WHEN precision > 15 THEN 15 ELSE precision END AS precision, greatest(min_step, 0) AS min_step, greatest(alarm_hysteresis, 0) AS alarm_hysteresis FROM pv_metadata")
def metadata_clean(b):
    return catalog.cleaned(b.pv_metadata).select("id", "precision", "min_step", "alarm_hysteresis")


ALERT = "SELECT id, time, level, category, pv_name, acknowledged FROM alert_log"


def alert_columns(df):
    return df.select("id", "time", "level", "category", "pv_name", "acknowledged")


@query(f"{ALERT} ORDER BY time DESC, id DESC LIMIT 50")
def alerts_recent(b):
    return alert_columns(alerts.newest(b.alert_log, 50))


@query(f"{ALERT} WHERE NOT acknowledged ORDER BY time DESC, id DESC LIMIT 50")
def alerts_unacked(b):
    return alert_columns(alerts.newest(b.alert_log, 50, ~F.col("acknowledged")))


@query(f"{ALERT} WHERE time >= '2024-01-03' AND time < '2024-01-12' ORDER BY time DESC, id DESC LIMIT 200")
def alerts_by_time(b):
    return alert_columns(alerts.newest(b.alert_log, 200, (F.col("time") >= F.lit(START)) & (F.col("time") < F.lit(END))))


@query(f"{ALERT} WHERE level = 'critical' ORDER BY time DESC, id DESC LIMIT 100")
def alerts_by_level(b):
    return alert_columns(alerts.newest(b.alert_log, 100, F.col("level") == "critical"))


@query(f"{ALERT} WHERE category = 'ioc' ORDER BY time DESC, id DESC LIMIT 100")
def alerts_by_category(b):
    return alert_columns(alerts.newest(b.alert_log, 100, F.col("category") == "ioc"))


@query(f"{ALERT} WHERE pv_name = 'PV:000008' ORDER BY time DESC, id DESC LIMIT 100")
def alerts_by_pv(b):
    return alert_columns(alerts.newest(b.alert_log, 100, F.col("pv_name") == "PV:000008"))


@query("SELECT id, time FROM alert_log ORDER BY time DESC, id DESC LIMIT 10000")
def newest_n(b):
    return alerts.newest(b.alert_log, 10**9).select("id", "time")


@query("SELECT tiebreak, isnan(v) OR isinf(v) AS non_finite FROM (SELECT tiebreak, CASE WHEN tiebreak % 7 = 0 THEN CAST('NaN' AS DOUBLE) WHEN tiebreak % 11 = 0 THEN CAST('-Infinity' AS DOUBLE) ELSE value END AS v FROM samples)")
def non_finite(b):
    v = F.when(F.col("tiebreak") % 7 == 0, float("nan")).when(F.col("tiebreak") % 11 == 0, float("-inf")).otherwise(F.col("value"))
    return b.samples.select("tiebreak", C.non_finite(v).alias("non_finite"))


@query("SELECT tiebreak, CASE WHEN pv_id % 5 = 0 THEN 0 WHEN value <= 5 THEN 2 WHEN value <= 8 THEN 1 WHEN value >= 15 THEN 2 WHEN value >= 12 THEN 1 ELSE 0 END AS alarm FROM samples")
def value_alarm_eval(b):
    limits = [F.lit(x) for x in (5.0, 8.0, 12.0, 15.0)]
    return b.samples.select("tiebreak", C.value_alarm(F.col("value"), F.col("pv_id") % 5 != 0, *limits).alias("alarm"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN control_low < control_high THEN l_quantity BETWEEN control_low AND control_high ELSE TRUE END AS in_range, CASE WHEN control_low < control_high THEN control_high - control_low ELSE 0 END AS width FROM lineitem JOIN pv_metadata ON id = l_partkey")
def control_in_range(b):
    low, high = F.col("control_low"), F.col("control_high")
    rows = b.lineitem.join(b.pv_metadata, F.col("id") == F.col("l_partkey"))
    return rows.select("l_orderkey", "l_linenumber", C.in_control_range(F.col("l_quantity"), low, high).alias("in_range"), F.when(low < high, high - low).otherwise(0.0).alias("width"))


@query("SELECT tiebreak, severity <> 0 AS is_active, severity = 3 AS is_invalid FROM samples")
def alarm_flags(b):
    return b.samples.select("tiebreak", (F.col("severity") != 0).alias("is_active"), (F.col("severity") == 3).alias("is_invalid"))


@query("SELECT event_id, CASE WHEN event_id % 11 IN (2, 3, 4, 10) THEN 'connectivity' WHEN event_id % 11 IN (0, 6, 7, 8, 9) THEN 'value' ELSE 'other' END AS reason_class FROM events")
def reason_class(b):
    return b.events.select("event_id", C.reason_class(F.col("event_id") % 11).alias("reason_class"))


@query("SELECT n_nationkey, n_nationkey % 3 <> 2 AS reachable, n_nationkey % 3 = 0 AS healthy FROM nation UNION ALL SELECT c_custkey + 1000, c_custkey % 3 <> 2, c_custkey % 3 = 0 FROM customer")
def device_flags(b):
    keys = b.nation.select("n_nationkey", F.col("n_nationkey").alias("k")).unionByName(b.customer.select((F.col("c_custkey") + 1000).alias("n_nationkey"), F.col("c_custkey").alias("k")))
    state = F.get(F.array(F.lit("online"), F.lit("suspect"), F.lit("offline")), (F.col("k") % 3).cast("int"))
    return keys.select("n_nationkey", C.device_flags(state).alias("d")).select("n_nationkey", "d.*")


@query("SELECT pv_id, state IN (2, 3) AS active, state IN (4, 5) AS needs_attention FROM pv_status")
def needs_attention(b):
    return b.pv_status.select("pv_id", F.col("state").isin(2, 3).alias("active"), F.col("state").isin(4, 5).alias("needs_attention"))


@query("SELECT event_id, pv_name FROM pv_events WHERE pv_name NOT IN (SELECT pv_name FROM pv_lookup WHERE pv_id % 10 <> 3)")
def unknown_pv(b):
    return catalog.unknown(b.pv_events, b.pv_lookup.where("pv_id % 10 <> 3")).select("event_id", "pv_name")


@query("SELECT event_id FROM pv_events WHERE ioc_addr IS DISTINCT FROM '10.0.0.3:5075'")
def null_safe_change(b):
    return b.pv_events.where(~F.col("ioc_addr").eqNullSafe("10.0.0.3:5075")).select("event_id")


@query("SELECT pv_name FROM config_after WHERE enabled")
def disabled_filter(b):
    return catalog.enabled(b.config_after).select("pv_name")


# Joins


@query("SELECT event_id, l.pv_id FROM pv_events e JOIN pv_lookup l USING (pv_name) WHERE l.pv_id % 2 = 0")
def resolve_pv_id(b):
    return catalog.resolved(b.pv_events.drop("pv_id"), b.pv_lookup.where("pv_id % 2 = 0")).select("event_id", "pv_id")


@query("SELECT event_id, l.pv_id FROM pv_events e LEFT JOIN (SELECT * FROM pv_lookup WHERE pv_id % 2 = 0) l USING (pv_name)")
def events_with_id(b):
    return catalog.with_id(b.pv_events.drop("pv_id"), b.pv_lookup.where("pv_id % 2 = 0")).select("event_id", "pv_id")


@query("SELECT CAST(s_suppkey AS INT) AS pv_id, coalesce(heartbeat_s, -1.0) AS heartbeat_s FROM config_after")
def heartbeat_config(b):
    return catalog.heartbeat_config(b.config_after.drop("s_suppkey"), b.config_after.select("pv_name", F.col("s_suppkey").cast("int").alias("pv_id")))


@query("SELECT event_id FROM pv_events WHERE pv_name IN (SELECT pv_name FROM pv_lookup WHERE pv_id < 20)")
def names_in_list(b):
    return catalog.named_in(b.pv_events, b.pv_lookup.where("pv_id < 20")).select("event_id")


@query("SELECT id, name FROM pv_metadata WHERE id NOT IN (SELECT id FROM pv_metadata WHERE id % 3 = 0)")
def metadata_new_only(b):
    return catalog.new_only(b.pv_metadata, b.pv_metadata.where("id % 3 = 0"), "id").select("id", "name")


STATS = f"stats AS (SELECT pv_id, count(*) AS events, arg_max(value, (time, tiebreak)) AS last_value, arg_max(severity, (time, tiebreak)) AS last_severity, max(time) AS last_event_at, count(*) / 30.0::DOUBLE AS update_hz FROM samples WHERE time > {NOW} - INTERVAL 1 HOUR GROUP BY pv_id)"


def recent(b):
    return lifecycle.pv_stats(b.samples.where(F.col("time") > F.lit(b.now - timedelta(hours=1))))


@query(f", {STATS} SELECT pv_id, events, last_value, CAST(last_severity AS INT) AS last_severity, last_event_at, round(update_hz, 6) AS update_hz FROM stats")
def pv_stats(b):
    return recent(b).withColumn("update_hz", F.round("update_hz", 6)).withColumn("last_severity", F.col("last_severity").cast("int"))


@query(f", {STATS} SELECT s.pv_id, CAST(CASE WHEN s.state = 2 AND t.pv_id IS NOT NULL THEN 3 ELSE s.state END AS INT) AS state, CAST(events_total + coalesce(events, 0) AS BIGINT) AS events_total, t.last_value, round(coalesce(t.update_hz, s.update_hz), 6) AS update_hz FROM pv_status s LEFT JOIN stats t ON s.pv_id = t.pv_id")
def status_update(b):
    status = b.pv_status.withColumns({"last_value": F.lit(None).cast("double"), "last_severity": F.lit(None).cast("smallint"), "update_hz": F.col("update_hz").cast("double")})
    return lifecycle.status_update(status, recent(b)).select("pv_id", F.col("state").cast("int").alias("state"), "events_total", "last_value", F.round("update_hz", 6).alias("update_hz"))


DIFF = """, d AS (SELECT coalesce(a.pv_name, b.pv_name) AS pv_name, CASE WHEN b.pv_name IS NULL THEN 'added' WHEN a.pv_name IS NULL THEN 'removed'
 WHEN a.description IS DISTINCT FROM b.description OR a.unit IS DISTINCT FROM b.unit OR a.heartbeat_s IS DISTINCT FROM b.heartbeat_s OR a.expected_ioc IS DISTINCT FROM b.expected_ioc THEN 'modified' END AS change
 FROM (SELECT * FROM config_before WHERE enabled) b FULL JOIN (SELECT * FROM config_after WHERE enabled) a ON a.pv_name = b.pv_name)"""


@query(f"{DIFF} SELECT pv_name, change FROM d WHERE change IS NOT NULL")
def config_diff(b):
    return reconcile.diff(b.config_before, b.config_after)


@query("SELECT pv_name FROM config_after EXCEPT SELECT pv_name FROM config_before")
def config_added(b):
    return reconcile.added(b.config_before, b.config_after)


@query("SELECT pv_name FROM config_before EXCEPT SELECT pv_name FROM config_after")
def config_removed(b):
    return reconcile.added(b.config_after, b.config_before)


@query("SELECT pv_name FROM config_before INTERSECT SELECT pv_name FROM config_after")
def config_kept(b):
    return reconcile.kept(b.config_before, b.config_after)


@query("SELECT address, 'added' AS change FROM (SELECT address FROM ioc_config WHERE enabled EXCEPT SELECT ioc_addr FROM pv_status) UNION ALL SELECT address, 'removed' FROM (SELECT ioc_addr AS address FROM pv_status EXCEPT SELECT address FROM ioc_config WHERE enabled)")
def ioc_added_removed(b):
    now, before = b.ioc_config.where("enabled").select("address"), b.pv_status.select(F.col("ioc_addr").alias("address")).distinct()
    return reconcile.added(before, now, "address").withColumn("change", F.lit("added")).unionByName(reconcile.added(now, before, "address").withColumn("change", F.lit("removed")))


ACTIONS = f"""{DIFF}, r AS (SELECT pv_name, CASE s_suppkey % 3 WHEN 0 THEN 'resolved' WHEN 1 THEN 'lost' ELSE 'not_found' END AS state, s_suppkey % 2 = 0 AS warned FROM config_before)
 SELECT d.pv_name, change, CASE WHEN change = 'removed' THEN 'unsubscribe' WHEN change = 'modified' AND state = 'resolved' THEN 'update_filter' ELSE 'resolve' END AS action,
 CASE WHEN change <> 'removed' AND state = 'not_found' AND NOT coalesce(warned, FALSE) THEN 'warning' WHEN change <> 'removed' AND state = 'lost' THEN 'warning' END AS alert
 FROM d LEFT JOIN r ON d.pv_name = r.pv_name WHERE change IS NOT NULL"""


@query(ACTIONS, name="config_cycle")
@query(ACTIONS)
def reconcile_actions(b):
    state = F.when(F.col("s_suppkey") % 3 == 0, "resolved").when(F.col("s_suppkey") % 3 == 1, "lost").otherwise("not_found")
    resolution = b.config_before.select("pv_name", state.alias("state"), (F.col("s_suppkey") % 2 == 0).alias("warned"))
    return reconcile.actions(reconcile.diff(b.config_before, b.config_after), resolution)


@query(f"""{DIFF}, r AS (SELECT pv_name, CASE s_suppkey % 3 WHEN 0 THEN 'resolved' WHEN 1 THEN 'lost' ELSE 'not_found' END AS state, s_suppkey % 2 = 0 AS warned FROM config_before), changed AS (SELECT * FROM d WHERE change IS NOT NULL AND EXISTS (SELECT 1 FROM config_after WHERE updated_at > TIMESTAMP '2024-01-01 12:00:00'))
 SELECT c.pv_name, change, CASE WHEN change = 'removed' THEN 'unsubscribe' WHEN change = 'modified' AND state = 'resolved' THEN 'update_filter' ELSE 'resolve' END AS action,
 CASE WHEN change <> 'removed' AND (state = 'lost' OR state = 'not_found' AND NOT warned) THEN 'warning' END AS alert FROM changed c LEFT JOIN r ON c.pv_name = r.pv_name
 UNION ALL SELECT pv_name, 'pending', 'resolve', NULL FROM r WHERE state <> 'resolved' AND pv_name IN (SELECT pv_name FROM config_after WHERE enabled) AND pv_name NOT IN (SELECT pv_name FROM changed)""")
def config_poll(b):
    state = F.when(F.col("s_suppkey") % 3 == 0, "resolved").when(F.col("s_suppkey") % 3 == 1, "lost").otherwise("not_found")
    resolution = b.config_before.select("pv_name", state.alias("state"), (F.col("s_suppkey") % 2 == 0).alias("warned"))
    return reconcile.polled(b.config_before, b.config_after, datetime(2024, 1, 1, 12), resolution)


NOTICES = "SELECT n AS op, unnest([s_name, concat(s_name, 'x')]) AS pv_name FROM (SELECT s_name, CASE s_suppkey % 3 WHEN 0 THEN 'add' WHEN 1 THEN 'del' ELSE 'other' END AS n FROM supplier) WHERE n <> 'other'"


def notices(supplier):
    op = F.when(F.col("s_suppkey") % 3 == 0, "add").when(F.col("s_suppkey") % 3 == 1, "del").otherwise("other")
    return supplier.select(F.concat(op, F.lit(":"), "s_name", F.lit(",,"), "s_name", F.lit("x")).alias("payload"))


@query(NOTICES)
def config_changes(b):
    return reconcile.changes(notices(b.supplier))


# The device report

COUNTS = """, counts AS (SELECT ioc_addr AS address, count(*) AS total, count(*) FILTER (state = 1) AS searching, count(*) FILTER (state = 2) AS connected, count(*) FILTER (state = 3) AS archiving,
 count(*) FILTER (state = 4) AS disconnected, count(*) FILTER (state = 5) AS timed_out, count(*) FILTER (state = 6) AS unsubscribed, sum(update_hz) AS events_per_s, avg(health_score) AS health,
 min(connected_at) AS started_at, max(last_event_at) AS last_event_at FROM pv_status GROUP BY 1)"""
MERGED = COUNTS + """, merged AS (SELECT coalesce(i.address, c.address) AS address, coalesce(label, '') AS label, i.address IS NOT NULL AS declared, coalesce(enabled, TRUE) AS enabled, coalesce(total, 0) AS total, coalesce(connected, 0) AS connected,
 coalesce(archiving, 0) AS archiving, coalesce(disconnected, 0) AS disconnected, coalesce(timed_out, 0) AS timed_out, coalesce(unsubscribed, 0) AS unsubscribed, coalesce(searching, 0) AS searching, coalesce(events_per_s, 0) AS events_per_s, coalesce(health, 0) AS health, started_at, last_event_at FROM ioc_config i FULL JOIN counts c ON i.address = c.address)"""
DAY = f", day AS (SELECT ioc_addr AS address, count(*) FILTER (event_type = 3) AS disconnects_24h, count(*) FILTER (event_type = 4) AS reconnects_24h, max(ts) FILTER (event_type = 3) AS last_disconnect FROM pv_events WHERE ts > {NOW} - INTERVAL 24 HOUR AND ioc_addr IS NOT NULL GROUP BY 1)"
ERRORS = ", errors AS (SELECT ioc_addr AS address, arg_max(detail, (ts, event_id)) AS last_error FROM pv_events WHERE event_type IN (3, 5, 7) AND detail IS NOT NULL AND ioc_addr IS NOT NULL GROUP BY 1)"
VIEW = f"""{MERGED}{DAY}{ERRORS}, fleet AS (SELECT m.address, label, declared, enabled, total, archiving, connected, searching, disconnected, timed_out, unsubscribed, CAST(round(events_per_s) AS BIGINT) AS events_per_s, round(health, 4) AS health, started_at, last_event_at, coalesce(disconnects_24h, 0) AS disconnects_24h, coalesce(reconnects_24h, 0) AS reconnects_24h, last_disconnect, last_error,
 CASE WHEN declared AND NOT enabled THEN 'DISABLED' WHEN total = 0 OR unsubscribed = total THEN 'IDLE' WHEN archiving + connected = 0 AND disconnected + timed_out > 0 THEN 'DOWN' WHEN archiving + connected = 0 THEN 'CONNECTING' WHEN disconnected + timed_out > 0 THEN 'DEGRADED' ELSE 'UP' END AS state
 FROM merged m LEFT JOIN day USING (address) LEFT JOIN errors USING (address))"""
SHOWN = ["address", "label", "declared", "enabled", "total", "archiving", "connected", "searching", "disconnected", "timed_out", "unsubscribed", "events_per_s", "health", "started_at", "last_event_at", "disconnects_24h", "reconnects_24h", "last_disconnect", "last_error", "state"]


@query(f"{COUNTS} SELECT * REPLACE (round(events_per_s, 4) AS events_per_s, round(health, 4) AS health) FROM counts")
def fleet_counts(b):
    return fleet.counts(b.pv_status).withColumns({"events_per_s": F.round(F.col("events_per_s").cast("double"), 4), "health": F.round(F.col("health").cast("double"), 4)})


@query(f"{MERGED} SELECT address, label, declared, enabled, total FROM merged")
def fleet_merged(b):
    return fleet.merged(b.ioc_config, fleet.counts(b.pv_status)).select("address", "label", "declared", "enabled", "total")


@query(f"{DAY[0:]} SELECT * FROM day")
def fleet_events_24h(b):
    return fleet.events_24h(b.pv_events, b.now)


@query(f"{MERGED}{DAY} SELECT m.address, d.disconnects_24h, d.reconnects_24h FROM merged m LEFT JOIN day d USING (address)")
def fleet_24h(b):
    return fleet.merged(b.ioc_config, fleet.counts(b.pv_status)).join(fleet.events_24h(b.pv_events, b.now), "address", "left").select("address", "disconnects_24h", "reconnects_24h")


@query(f"{ERRORS} SELECT * FROM errors")
def fleet_last_error(b):
    return fleet.last_error(b.pv_events)


@query(f"{VIEW} SELECT {', '.join(SHOWN)} FROM fleet")
def fleet_view(b):
    return fleet.view(b.ioc_config, b.pv_status, b.pv_events, b.now).withColumn("health", F.round(F.col("health").cast("double"), 4)).select(*SHOWN)


@query(f"{VIEW} SELECT {', '.join(SHOWN)} FROM fleet WHERE label ILIKE '%VICE 1%' OR address ILIKE '%VICE 1%'")
def fleet_search(b):
    return fleet.view(b.ioc_config, b.pv_status, b.pv_events, b.now, search=" VICE 1 ").withColumn("health", F.round(F.col("health").cast("double"), 4)).select(*SHOWN)


@query(f"{VIEW} SELECT {', '.join(SHOWN)} FROM fleet WHERE state = 'IDLE'")
def fleet_by_state(b):
    return fleet.view(b.ioc_config, b.pv_status, b.pv_events, b.now, state="IDLE").withColumn("health", F.round(F.col("health").cast("double"), 4)).select(*SHOWN)


@query(f"{VIEW} SELECT CAST(row_number() OVER (ORDER BY coalesce(nullif(label, ''), address)) AS INT) AS place, address FROM fleet")
def fleet_order(b):
    rows = fleet.view(b.ioc_config, b.pv_status, b.pv_events, b.now).select("label", "address")
    return tables.numbered(rows, [F.coalesce(F.nullif("label", F.lit("")), "address")], "place").select(F.col("place").cast("int").alias("place"), "address")


@query(f"{VIEW} SELECT address, state FROM fleet")
def derive_ioc_state(b):
    return fleet.view(b.ioc_config, b.pv_status, b.pv_events, b.now).select("address", "state")


@query(f"""SELECT pv_id, round(CASE state WHEN 3 THEN least(1.0, epoch({NOW} - connected_at) / greatest(1.0, epoch({NOW} - subscribed_at))) * CASE WHEN epoch({NOW} - last_event_at) < 60 THEN 1.0 WHEN epoch({NOW} - last_event_at) < 300 THEN 0.5 ELSE 0.1 END
 WHEN 4 THEN 0.0 WHEN 5 THEN 0.1 ELSE 0.5 END::DOUBLE, 6) AS health FROM pv_status""")
def health_score(b):
    score = C.health_score(F.col("state"), F.col("subscribed_at"), F.col("connected_at"), F.col("last_event_at"), F.lit(b.now))
    return b.pv_status.select("pv_id", F.round(score, 6).alias("health"))


# Lifecycle


@query("SELECT ts AS time, pv_id, CAST('NaN' AS DOUBLE) AS value, 3 AS severity, event_type + 100 AS status, event_type AS reason FROM pv_events WHERE event_type IN (3, 4)")
def lifecycle_samples(b):
    return lifecycle.lifecycle_samples(b.pv_events).select("time", "pv_id", "value", *(F.col(c).cast("int").alias(c) for c in ("severity", "status", "reason")))


@query("""SELECT pv_id, ts AS down_at, until AS up_at FROM (SELECT *, lead(ts) OVER w AS until FROM (SELECT *, lag(event_type) OVER (PARTITION BY pv_id ORDER BY ts, event_id) AS before FROM pv_events WHERE event_type IN (3, 4))
 WHERE before IS DISTINCT FROM event_type WINDOW w AS (PARTITION BY pv_id ORDER BY ts, event_id)) WHERE event_type = 3""")
def connectivity_intervals(b):
    return lifecycle.connectivity_intervals(b.pv_events)


TIMEOUTS = f"SELECT time + INTERVAL 6 HOUR AS time, pv_id, 105 AS status FROM (SELECT *, coalesce(lead(time) OVER (PARTITION BY pv_id ORDER BY time, tiebreak), {NOW}) AS until FROM samples) WHERE until - time > INTERVAL 6 HOUR"


@query(TIMEOUTS)
def timeouts(b):
    return lifecycle.timeouts(b.samples, 6 * 3600, b.now).select("time", "pv_id", F.col("status").cast("int").alias("status"))


HEARTBEATS = f"""SELECT time + to_microseconds(k * every) AS time, pv_id, value, CAST(severity AS INT) AS severity FROM (SELECT *, unnest(generate_series(1, (date_diff('microsecond', time, until) - 1) // every)) AS k FROM (
 SELECT *, CASE pv_id % 3 WHEN 0 THEN 7200000000 WHEN 1 THEN 14400000000 END AS every, coalesce(lead(time) OVER (PARTITION BY pv_id ORDER BY time, tiebreak), {NOW}) AS until FROM samples) WHERE every IS NOT NULL AND until > time)"""


def intervals(b):
    return b.pv_lookup.select("pv_id", F.when(F.col("pv_id") % 3 == 0, 7200.0).when(F.col("pv_id") % 3 == 2, 0.0).alias("heartbeat_s"))


@query(HEARTBEATS)
def heartbeats(b):
    return lifecycle.heartbeats(b.samples, 14400.0, intervals(b), b.now).select("time", "pv_id", "value", F.col("severity").cast("int").alias("severity"))


FOLD = """SELECT pv_id, CAST(list_reduce(list_prepend(0, list(event_type ORDER BY ts, event_id)), lambda s, x: CASE WHEN x = 0 THEN 1 WHEN x = 1 AND s IN (0, 1, 4, 5) THEN 2 WHEN x = 2 THEN 3 WHEN x = 3 THEN 4 WHEN x = 4 THEN 3 ELSE s END) AS INT) AS state FROM pv_events GROUP BY pv_id"""


@query(FOLD)
def status_fold(b):
    return lifecycle.status_fold(b.pv_events).select("pv_id", F.col("state").cast("int").alias("state"))


@query(f", {STATS}, fold AS ({FOLD}) SELECT s.pv_id, f.state, coalesce(events, 0) AS events, t.last_value FROM pv_status s JOIN fold f ON f.pv_id = s.pv_id LEFT JOIN stats t ON t.pv_id = s.pv_id")
def status_snapshot(b):
    folded = lifecycle.status_fold(b.pv_events).select("pv_id", F.col("state").cast("int").alias("state"))
    return b.pv_status.select("pv_id").join(folded, "pv_id").join(recent(b), "pv_id", "left").select("pv_id", "state", F.coalesce("events", F.lit(0)).alias("events"), "last_value")


SCAN = f""", {STATS}, u AS (SELECT s.pv_id, CASE WHEN s.state = 2 AND t.pv_id IS NOT NULL THEN 3 ELSE s.state END AS state, coalesce(t.last_event_at, s.last_event_at) AS last_event_at, connected_at, subscribed_at FROM pv_status s LEFT JOIN stats t ON t.pv_id = s.pv_id),
 o AS (SELECT * REPLACE (CASE WHEN state = 3 AND last_event_at < {NOW} - INTERVAL 60 SECOND THEN 5 ELSE state END AS state), state = 3 AND last_event_at < {NOW} - INTERVAL 60 SECOND AS timed_out_now FROM u)"""


@query(f"""{SCAN} SELECT pv_id, CAST(state AS INT) AS state, timed_out_now, round(CASE state WHEN 3 THEN least(1.0, epoch({NOW} - connected_at) / greatest(1.0, epoch({NOW} - subscribed_at))) * CASE WHEN epoch({NOW} - last_event_at) < 60 THEN 1.0 WHEN epoch({NOW} - last_event_at) < 300 THEN 0.5 ELSE 0.1 END
 WHEN 4 THEN 0.0 WHEN 5 THEN 0.1 ELSE 0.5 END::DOUBLE, 6) AS health FROM o""")
def status_scan(b):
    status = b.pv_status.withColumns({"last_value": F.lit(None).cast("double"), "last_severity": F.lit(None).cast("smallint")})
    return lifecycle.status_scan(status, recent(b), b.now).select("pv_id", F.col("state").cast("int").alias("state"), "timed_out_now", F.round("health_score", 6).alias("health"))


@query(f"{SCAN} SELECT {NOW} AS time, pv_id, 3 AS severity, 105 AS status, 10 AS reason FROM o WHERE timed_out_now")
def scan_samples(b):
    status = b.pv_status.withColumns({"last_value": F.lit(None).cast("double"), "last_severity": F.lit(None).cast("smallint")})
    rows = lifecycle.scan_samples(lifecycle.status_scan(status, recent(b), b.now), b.now)
    return rows.select("time", "pv_id", *(F.col(c).cast("int").alias(c) for c in ("severity", "status", "reason")))


# Sparse updates and changes


@query("SELECT tiebreak, last_value(value IGNORE NULLS) OVER w AS value, CAST(last_value(severity IGNORE NULLS) OVER w AS INT) AS severity FROM sparse WINDOW w AS (PARTITION BY pv_id ORDER BY time, tiebreak)")
def sparse_fill(b):
    return reshape.carried_forward(b.sparse, ["value", "severity"]).select("tiebreak", "value", F.col("severity").cast("int").alias("severity"))


@query("SELECT tiebreak, reason FROM (SELECT tiebreak, CASE WHEN row_number() OVER w = 1 THEN 2 WHEN severity IS DISTINCT FROM lag(severity) OVER w THEN 5 WHEN value IS DISTINCT FROM lag(value) OVER w THEN 0 END AS reason FROM samples WINDOW w AS (PARTITION BY pv_id ORDER BY time, tiebreak)) WHERE reason IS NOT NULL")
def change_points(b):
    return reshape.change_points(b.samples).select("tiebreak", F.col("reason").cast("int").alias("reason"))


@query("""SELECT vec_id, reason FROM (SELECT vec_id, CASE WHEN row_number() OVER w = 1 THEN 2 WHEN sqrt(list_sum(list_transform(list_zip(embedding, lag(embedding) OVER w), lambda p: (CAST(p[1] AS DOUBLE) - p[2]) * (CAST(p[1] AS DOUBLE) - p[2])))) > 1.25 THEN 6 END AS reason
 FROM embeddings WINDOW w AS (PARTITION BY label ORDER BY vec_id)) WHERE reason IS NOT NULL""")
def array_change_points(b):
    rows = b.embeddings.select(F.col("label").alias("pv_id"), F.col("vec_id").alias("time"), F.lit(0).alias("tiebreak"), F.col("embedding").cast("array<double>").alias("value"), "vec_id")
    return reshape.array_change_points(rows, 1.25).select("vec_id", F.col("reason").cast("int").alias("reason"))


@query("SELECT pv_id, session, time FROM (SELECT pv_id, tiebreak // 1000 AS session, time, row_number() OVER (PARTITION BY pv_id, tiebreak // 1000 ORDER BY time, tiebreak) AS n FROM samples) WHERE n = 1")
def first_update_metadata(b):
    return catalog.first_updates(b.samples.withColumn("session", F.floor(F.col("tiebreak") / 1000)), "session").select("pv_id", "session", "time")


@query("""SELECT id, time, array_to_string(list_filter([CASE WHEN n > 1 AND units IS DISTINCT FROM pu THEN 'units' END, CASE WHEN n > 1 AND precision IS DISTINCT FROM pp THEN 'precision' END], lambda x: x IS NOT NULL), ',') AS changed
 FROM (SELECT *, row_number() OVER w AS n, lag(units) OVER w AS pu, lag(precision) OVER w AS pp FROM (SELECT user_id AS id, event_id AS time, event_type AS units, CAST(floor(value / 25) AS INT) AS precision FROM events) WINDOW w AS (PARTITION BY id ORDER BY time))
 WHERE n = 1 OR units IS DISTINCT FROM pu OR precision IS DISTINCT FROM pp""")
def metadata_history(b):
    updates = b.events.select(F.col("user_id").alias("id"), F.col("event_id").alias("time"), F.col("event_type").alias("units"), F.floor(F.col("value") / 25).cast("int").alias("precision"))
    return catalog.history(updates, "id", ["units", "precision"]).select("id", "time", F.array_join("changed", ",").alias("changed"))


# Reshaping


@query("SELECT vec_id AS array_id, CAST(unnest(generate_series(0, len(embedding) - 1)) AS INT) AS idx, unnest(embedding) AS value FROM embeddings")
def explode_arrays(b):
    return reshape.exploded(b.embeddings, "embedding", [F.col("vec_id").alias("array_id")])


@query("SELECT vec_id, len(embedding) AS n, round(list_sum(list_transform(embedding, lambda x, i: CAST(x AS DOUBLE) * i)), 4) AS weighted FROM embeddings")
def rebuild_arrays(b):
    back = reshape.rebuilt(reshape.exploded(b.embeddings, "embedding", ["vec_id"]), ["vec_id"])
    weighted = F.aggregate(F.transform("value", lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return back.select("vec_id", F.size("value").cast("long").alias("n"), F.round(weighted, 4).alias("weighted"))


CHUNK = 4096


def captured(rows: DataFrame, key: str, order: list[str], **arrays: str) -> DataFrame:
    """Captures of each key: parallel arrays in order, in parts of at most CHUNK elements, the first of which has place `first`."""
    named = rows.select(key, *order, *(F.col(c).alias(f"_{n}") for n, c in arrays.items()))
    placed = segments.scanned(named, key, [*order, *(f"_{n}" for n in arrays)], number="_place").select(key, "_place", *(F.col(f"_{n}").alias(n) for n in arrays))
    parts = F.array_sort(F.collect_list(F.struct("_place", *arrays)))
    parts = placed.groupBy(key, F.floor(F.col("_place") / CHUNK).alias("part")).agg(parts.alias("p"))
    return parts.select(key, (F.col("part") * CHUNK).cast("int").alias("first"), *(F.col(f"p.{n}").alias(n) for n in arrays))


def placed(parts: DataFrame, arrays: dict[str, str], key: str, **padded: tuple[str, object]) -> DataFrame:
    """The elements of captures, with their place in the whole capture."""
    return reshape.zipped(parts, arrays, [key, "first"], padded).withColumn("idx", F.col("idx") + F.col("first")).drop("first")


@query("SELECT l_orderkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_returnflag, l_quantity) - 1 AS INT) AS idx, l_returnflag AS name, l_quantity AS value FROM lineitem")
def explode_namevalue(b):
    return placed(captured(b.lineitem, "l_orderkey", ["l_linenumber"], name="l_returnflag", value="l_quantity"), {"name": "name", "value": "value"}, "l_orderkey")


HIST = "SELECT l_suppkey, 10 * floor(l_quantity / 10) AS range_val, count(*) AS count FROM lineitem GROUP BY ALL"


def bins(b):
    return b.lineitem.groupBy("l_suppkey", (F.floor(F.col("l_quantity") / 10) * 10.0).alias("range_val")).agg(F.count("*").alias("count"))


@query(f"SELECT l_suppkey, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY range_val) - 1 AS INT) AS idx, range_val, count FROM ({HIST})")
def explode_histogram(b):
    return placed(captured(bins(b), "l_suppkey", ["range_val"], ranges="range_val", counts="count"), {"range_val": "ranges", "count": "counts"}, "l_suppkey")


@query(f"SELECT l_suppkey, CAST(sum(count) AS BIGINT) AS total, max(count) AS max_bin, count(*) AS bins FROM ({HIST}) GROUP BY l_suppkey")
def histogram_stats(b):
    return reshape.histogram_stats(bins(b), ["l_suppkey"])


@query("SELECT o_custkey, CAST(row_number() OVER w - 1 AS INT) AS idx, CAST(row_number() OVER w AS DOUBLE) AS base_val, o_totalprice AS trace_val FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def explode_continuum(b):
    rows = captured(b.orders, "o_custkey", ["o_orderdate", "o_orderkey"], value="o_totalprice").withColumn("base", F.transform("value", lambda x, i: (F.col("first") + i + 1).cast("double")))
    return placed(rows, {"base_val": "base", "trace_val": "value"}, "o_custkey")


@query("SELECT o_custkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INT) AS idx, o_orderpriority AS ch_name, o_totalprice AS ch_value, CASE o_orderstatus WHEN 'F' THEN 2 ELSE 0 END AS ch_severity FROM orders")
def explode_multichannel(b):
    rows = captured(b.orders.withColumn("s", F.when(F.col("o_orderstatus") == "F", 2).otherwise(0)), "o_custkey", ["o_orderkey"], names="o_orderpriority", values="o_totalprice", severities="s")
    return placed(rows, {"ch_name": "names", "ch_value": "values"}, "o_custkey", ch_severity=("severities", 0))


@query("SELECT o_custkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INT) AS idx, o_orderkey, o_orderstatus FROM orders")
def explode_table(b):
    rows = captured(b.orders, "o_custkey", ["o_orderkey"], k="o_orderkey", s="o_orderstatus")
    return placed(rows, {"o_orderkey": "k", "o_orderstatus": "s"}, "o_custkey")


@query("SELECT vec_id, CASE vec_id % 4 WHEN 0 THEN 0 ELSE CAST(len(embedding) AS BIGINT) END AS n_rows, CAST(vec_id % 4 AS INT) AS n_columns FROM embeddings")
def table_shape(b):
    columns = F.slice(F.array("embedding", "embedding", "embedding"), 1, (F.col("vec_id") % 4).cast("int"))
    return b.embeddings.select("vec_id", C.table_shape(columns).alias("s")).select("vec_id", "s.*")


@query("SELECT a.vec_id, round(sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: (CAST(p[1] AS DOUBLE) - p[2]) * (CAST(p[1] AS DOUBLE) - p[2])))), 5) AS distance FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def array_l2(b):
    e = b.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    return e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("e").alias("f")), "vec_id").select("vec_id", F.round(C.array_l2(F.col("e"), F.col("f")), 5).alias("distance"))


@query("SELECT vec_id, embedding[3 * 8 + 5 + 1] AS cell, CASE vec_id % 3 WHEN 0 THEN CAST(len(embedding) // 8 AS INT) ELSE 1 END AS n_rows, CASE vec_id % 3 WHEN 0 THEN 8 ELSE CAST(len(embedding) AS INT) END AS n_columns FROM embeddings")
def matrix_cell(b):
    dim = F.when(F.col("vec_id") % 3 == 0, F.array(F.floor(F.size("embedding") / 8).cast("int"), F.lit(8))).when(F.col("vec_id") % 3 == 1, F.array(F.size("embedding"))).otherwise(F.array().cast("array<int>"))
    cell = C.matrix_cell(F.col("embedding"), F.lit(8), F.lit(3), F.lit(5))
    return b.embeddings.select("vec_id", cell.alias("cell"), C.matrix_shape(F.col("embedding"), dim).alias("s")).select("vec_id", "cell", "s.*")


@query("SELECT vec_id, embedding[2 * 4 + 1 + 1] AS cell, 16 AS points, CAST(len(embedding) // 16 AS INT) AS traces FROM embeddings")
def continuum_cell(b):
    base, values = F.slice("embedding", 1, 16), F.col("embedding")
    return b.embeddings.select("vec_id", C.continuum_cell(base, values, F.lit(2), F.lit(1)).alias("cell"), C.continuum_shape(base, values).alias("s")).select("vec_id", "cell", "s.*")


@query("SELECT vec_id, k AS elem_type, len(embedding) AS n, CASE k WHEN 'float' THEN 4 WHEN 'double' THEN 8 ELSE 0 END * len(embedding) AS bytes, k <> 'string' AS numeric FROM (SELECT *, CASE vec_id % 3 WHEN 0 THEN 'float' WHEN 1 THEN 'double' ELSE 'string' END AS k FROM embeddings)")
def array_bytes(b):
    kind = F.get(F.array(F.lit("float"), F.lit("double"), F.lit("string")), (F.col("vec_id") % 3).cast("int"))
    return b.embeddings.select("vec_id", C.array_info(kind, F.col("embedding")).alias("i")).select("vec_id", "i.*")


@query("SELECT p_partkey, p_size % 4 <> 0 OR p_size * (1 + p_size % 2) <> 2 * p_size AS roi, p_size % 2 = 1 AS binned, CAST(p_size * (1 + p_size % 2) AS INT) AS extent FROM part")
def image_geometry(b):
    dim = F.struct(F.col("p_size").alias("size"), (F.col("p_size") % 4).alias("offset"), (2 * F.col("p_size")).alias("full_size"), (1 + F.col("p_size") % 2).alias("binning"))
    return b.part.select("p_partkey", reshape.image_geometry(F.array(dim)).alias("g")).select("p_partkey", "g.roi", "g.binned", F.get("g.extents", 0).cast("int").alias("extent"))


@query("SELECT p_partkey, unnest(['size', 'price']) AS name, unnest([CAST(p_size AS DOUBLE), p_retailprice]) AS value FROM part")
def image_attributes(b):
    attributes = F.array(F.struct(F.lit("size").alias("name"), F.col("p_size").cast("double").alias("value")), F.struct(F.lit("price").alias("name"), F.col("p_retailprice").alias("value")))
    return b.part.select("p_partkey", F.inline(attributes))


ROUTES = "['samples', 'samples', 'samples', 'samples_string', 'samples_array_num', 'samples_array_num', 'samples_array_str', 'samples_hist', 'samples_cont', 'samples_nv', 'samples_mch', 'samples_table', 'samples_image', 'samples_custom', 'samples_custom', 'samples_custom']"
KINDS = ("scalar", "enum", "aggregate", "string", "scalar_array", "matrix", "string_array", "histogram", "continuum", "name_value", "multi_channel", "table", "nd_array", "union", "custom", "unheard_of")


@query(f"SELECT event_id, ({ROUTES})[event_id % 16 + 1] AS target FROM events")
def route_updates(b):
    kind = F.get(F.array(*map(F.lit, KINDS)), (F.col("event_id") % 16).cast("int"))
    return reshape.routed(b.events.withColumn("nt_type", kind)).select("event_id", "target")


@query(f"SELECT target, count(*) AS n FROM (SELECT ({ROUTES})[event_id % 16 + 1] AS target FROM events) GROUP BY target")
def write_report(b):
    return route_updates(b).groupBy("target").agg(F.count("*").alias("n"))


@query("SELECT 'scalar' AS kind, time, pv_id FROM samples UNION ALL SELECT 'event', ts, pv_id FROM pv_events WHERE event_type = 3")
def all_captures(b):
    parts = {"scalar": b.samples, "event": b.pv_events.where("event_type = 3").select(F.col("ts").alias("time"), "pv_id")}
    return reshape.all_captures(parts).select("kind", "time", "pv_id")


@query("SELECT pv_id, time, CAST(dense_rank() OVER (PARTITION BY pv_id ORDER BY time) AS INT) AS capture_no FROM samples")
def capture_ids(b):
    rows = reshape.capture_ids(b.samples)
    return rows.select("pv_id", "time", F.dense_rank().over(Window.partitionBy("pv_id").orderBy("time")).alias("capture_no"))


@query("SELECT l_suppkey, count(*) AS n, round(avg(l_quantity), 6) AS value, min(l_quantity) AS min, max(l_quantity) AS max FROM lineitem GROUP BY l_suppkey")
def aggregate_payload(b):
    q, at = F.col("l_quantity"), F.col("l_orderkey").cast("decimal(19,0)") * 1000 + F.col("l_linenumber")  # by number: the aggregation stays one by hash
    payload = F.struct(F.count("*").alias("n"), F.avg(q).alias("mean"), F.stddev(q).alias("dispersion"), F.min_by(q, at).alias("first"), F.max_by(q, at).alias("last"), F.min(q).alias("min"), F.max(q).alias("max"))
    return reshape.unpacked_aggregate(b.lineitem.groupBy("l_suppkey").agg(payload.alias("payload"))).select("l_suppkey", "n", F.round("value", 6).alias("value"), "min", "max")


@query("""SELECT e.event_id, l.pv_id, CASE e.event_type WHEN 3 THEN 'samples_hist' ELSE 'samples' END AS target FROM pv_events e JOIN (SELECT * FROM pv_lookup WHERE pv_id % 10 <> 3) l USING (pv_name)""")
def archive_batch(b):
    known = catalog.resolved(b.pv_events.drop("pv_id"), b.pv_lookup.where("pv_id % 10 <> 3"))
    return reshape.routed(known.withColumn("nt_type", F.when(F.col("event_type") == 3, "histogram").otherwise("scalar"))).select("event_id", "pv_id", "target")


# Scalar functions


@query("SELECT event_id, make_timestamp(event_id * 1000000 + (event_id * 1237 % 1000000000) // 1000) AS t, CAST(CAST(event_id AS HUGEINT) * 1000000000 + event_id * 1237 % 1000000000 AS VARCHAR) AS nanos, event_id = 0 AS is_epoch FROM events")
def to_micros(b):
    s, n = F.col("event_id"), F.col("event_id") * 1237 % 1_000_000_000
    return b.events.select("event_id", C.to_micros(s, n).alias("t"), C.total_nanos(s, n).cast("string").alias("nanos"), C.is_epoch(s, n).alias("is_epoch"))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'true' WHEN 1 THEN CAST(event_id AS VARCHAR) ELSE event_type END AS text FROM events")
def as_text(b):
    k = (F.col("event_id") % 3).cast("int")
    text = F.when(k == 0, "TRUE").when(k == 1, F.concat(F.lit("+00"), F.col("event_id").cast("string"))).otherwise(F.col("event_type"))
    return b.events.select("event_id", C.as_text(F.get(F.array(F.lit("boolean"), F.lit("long"), F.lit("string")), k), text).alias("text"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN value WHEN 1 THEN 1.0 WHEN 2 THEN CAST(event_id AS DOUBLE) END AS v, CASE event_id % 4 WHEN 0 THEN CAST(trunc(value) AS BIGINT) WHEN 1 THEN 1 WHEN 2 THEN event_id END AS whole FROM events")
def as_double(b):
    kind = F.get(F.array(F.lit("double"), F.lit("boolean"), F.lit("long"), F.lit("string")), (F.col("event_id") % 4).cast("int"))
    text = F.when(F.col("event_id") % 4 == 0, F.col("value").cast("string")).when(F.col("event_id") % 4 == 1, "true").otherwise(F.col("event_id").cast("string"))
    v = C.as_double(kind, text)
    return b.events.select("event_id", v.alias("v"), C.as_long(v).alias("whole"))


@query("SELECT event_id, k AS kind, k IN ('int', 'ulong') AS is_integer, k = 'float' AS is_floating, k = 'ulong' AS is_unsigned, k IN ('int', 'float') AS exact_in_double, CASE k WHEN 'int' THEN 4 WHEN 'ulong' THEN 8 WHEN 'float' THEN 4 ELSE 0 END AS bytes FROM (SELECT event_id, ['int', 'ulong', 'float', 'string'][event_id % 4 + 1] AS k FROM events)")
def type_class(b):
    kind = F.get(F.array(*map(F.lit, ("int", "ulong", "float", "string"))), (F.col("event_id") % 4).cast("int"))
    return b.events.select("event_id", kind.alias("kind"), C.type_class(kind).alias("c")).select("event_id", "kind", "c.*")


def choices():
    return F.array(*map(F.lit, ("Open", "Closed", "Fault")))


@query("SELECT event_id, CASE i WHEN 0 THEN 'Open' WHEN 1 THEN 'Closed' WHEN 2 THEN 'Fault' END AS label, CASE WHEN i BETWEEN 0 AND 2 THEN i END AS back, CASE i WHEN 0 THEN 'Open(0)' WHEN 1 THEN 'Closed(1)' WHEN 2 THEN 'Fault(2)' ELSE CAST(i AS VARCHAR) END AS text FROM (SELECT event_id, CAST(event_id % 5 - 1 AS INT) AS i FROM events)")
def enum_label(b):
    i = (F.col("event_id") % 5 - 1).cast("int")
    return b.events.select("event_id", C.enum_label(i, choices()).alias("label"), C.enum_index(C.enum_label(i, choices()), choices()).alias("back"), C.enum_text(i, choices()).alias("text"))


def _named(names, code):
    return "CASE " + code + " " + " ".join(f"WHEN {k} THEN '{n}'" for k, n in enumerate(names)) + " ELSE 'UNDEFINED' END"


@query(f"SELECT event_id, {_named(C.SEVERITIES, 'event_id % 7')} AS severity, {_named(C.STATUSES, 'event_id % 9')} AS status, {_named(C.REASONS, 'event_id % 12')} AS reason FROM events")
def code_names(b):
    i = F.col("event_id")
    return b.events.select("event_id", C.severity_name(i % 7).alias("severity"), C.status_name(i % 9).alias("status"), C.reason_name(i % 12).alias("reason"))


@query(f"SELECT event_id, concat({_named(C.SEVERITIES, 'event_id % 7')}, '/', {_named(C.STATUSES, 'event_id % 9')}, CASE WHEN event_id % 2 = 0 THEN concat(': ', event_type) ELSE '' END) AS text FROM events")
def alarm_text(b):
    i = F.col("event_id")
    return b.events.select("event_id", C.alarm_text(i % 7, i % 9, F.when(i % 2 == 0, F.col("event_type"))).alias("text"))


@query("SELECT id, CASE level WHEN 'info' THEN 0 WHEN 'critical' THEN 2 ELSE 1 END AS rank FROM alert_log")
def alert_rank(b):
    return b.alert_log.select("id", C.alert_rank(F.col("level")).alias("rank"))


@query("SELECT pv_name, CASE WHEN heartbeat_s - 2 > 0 THEN greatest(1.0, (heartbeat_s - 2) / 4) END AS heartbeat_s FROM config_before")
def normalize_heartbeat(b):
    h = F.col("heartbeat_s") - 2
    return b.config_before.select("pv_name", F.when(h > 0, C.normalize_heartbeat(h / 4)).alias("heartbeat_s"))


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 AND s_suppkey % 300 <= 255 THEN concat('10.0.0.', CAST(s_suppkey % 300 AS VARCHAR), ':5075') WHEN s_suppkey % 5 = 1 THEN '[::1]:5075' END AS address,
 CASE s_suppkey % 5 WHEN 0 THEN CASE WHEN s_suppkey % 300 > 255 THEN 'not an address' END WHEN 2 THEN 'not an address' WHEN 3 THEN 'trailing colon' WHEN 4 THEN 'empty' END AS error FROM supplier""")
def normalize_address(b):
    k = F.col("s_suppkey")
    text = F.when(k % 5 == 0, F.concat(F.lit(" 10.0.0."), (k % 300).cast("string"), F.lit(" "))).when(k % 5 == 1, "[::1]:5075").when(k % 5 == 2, "host.example:5075").when(k % 5 == 3, "10.0.0.1:").otherwise("   ")
    return b.supplier.select("s_suppkey", C.normalize_address(text).alias("a")).select("s_suppkey", "a.*")


@query("SELECT event_id, length(props) AS json_size FROM events")
def json_size(b):
    return b.events.select("event_id", F.length("props").cast("long").alias("json_size"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def read_updates(b):
    return tables.read_updates(b.events, "props").select("event_id", F.try_variant_get("payload", "$.k", "bigint").alias("k"))


@query("SELECT event_id, concat('{\"id\":', CAST(event_id AS VARCHAR), ',\"kind\":\"', event_type, '\"}') AS data FROM events")
def custom_json(b):
    return b.events.select("event_id", F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("kind"))).alias("data"))


@query("SELECT id, coalesce(display_high, 0.0) AS display_high, coalesce(alarm_hihi, 0.0) AS alarm_hihi, units FROM pv_metadata")
def metadata_extract(b):
    payload = F.struct(F.struct("display_low", "display_high").alias("display"), F.struct("alarm_lolo", "alarm_hihi").alias("alarm"), "units")
    return b.pv_metadata.select("id", payload.alias("p")).select("id", F.coalesce("p.display.display_high", F.lit(0.0)).alias("display_high"), F.coalesce("p.alarm.alarm_hihi", F.lit(0.0)).alias("alarm_hihi"), "p.units")


@query("""SELECT p_partkey, k AS data_type, CASE WHEN k = 'enum' THEN 'int' WHEN k IN ('matrix', 'continuum', 'aggregate') THEN 'double' WHEN k IN ('scalar', 'scalar_array', 'name_value', 'nd_array', 'union') THEN 'float' END AS scalar_type,
 CASE WHEN k IN ('scalar_array', 'matrix', 'histogram', 'name_value') THEN 6 WHEN k = 'continuum' THEN 3 WHEN k = 'table' THEN 4 WHEN k = 'multi_channel' THEN 2 END AS array_size,
 CASE WHEN k IN ('scalar', 'scalar_array', 'matrix') AND p_partkey % 2 = 0 THEN p_type WHEN k IN ('matrix', 'histogram', 'continuum', 'name_value', 'union') THEN 'told' ELSE '' END AS description,
 CASE WHEN k IN ('scalar', 'scalar_array', 'matrix') THEN p_brand WHEN k = 'continuum' THEN 's' ELSE '' END AS units, CASE WHEN k IN ('scalar', 'scalar_array', 'matrix') THEN p_size ELSE 0 END AS precision,
 CASE WHEN k IN ('scalar', 'scalar_array', 'matrix') THEN p_retailprice ELSE 0 END AS display_high, CASE WHEN k IN ('scalar', 'scalar_array') THEN 25.0 ELSE 0 END::DOUBLE AS control_high, CASE WHEN k IN ('scalar', 'scalar_array') THEN 1.5 * p_retailprice ELSE 0 END AS alarm_hihi,
 CASE WHEN k = 'enum' THEN 'Off,On' ELSE '' END AS choices, CASE WHEN k = 'matrix' THEN '2/2,3/3' WHEN k = 'nd_array' THEN '8/16' ELSE '' END AS dims
 FROM (SELECT *, ['scalar', 'enum', 'scalar_array', 'matrix', 'histogram', 'continuum', 'name_value', 'table', 'nd_array', 'multi_channel', 'aggregate', 'union', 'custom'][p_partkey % 13 + 1] AS k FROM part)""")
def metadata_kinds(b):
    kinds = ("scalar", "enum", "scalar_array", "matrix", "histogram", "continuum", "name_value", "table", "nd_array", "multi_channel", "aggregate", "union", "custom")
    number, text = (lambda *xs: F.array(*(F.lit(float(x)) for x in xs))), (lambda *xs: F.array(*map(F.lit, xs)))
    data = F.to_json(F.struct(
        number(1, 2, 3, 4, 5, 6).alias("value"), F.lit("float").alias("scalar_type"), F.lit("told").alias("descriptor"), text("s", "V").alias("units"), number(0, 1, 2).alias("base"), text("Off", "On").alias("choices"),
        F.array(F.lit(2), F.lit(3)).alias("dim"), text("a", "b").alias("channel_name"), F.array(F.struct(number(1, 2, 3, 4).alias("values"))).alias("columns"), F.array(F.struct(F.lit(8).alias("size"), F.lit(16).alias("full_size"))).alias("dimension"),
        F.struct(F.when(F.col("p_partkey") % 2 == 0, F.col("p_type")).otherwise("").alias("description"), F.col("p_brand").alias("units"), F.col("p_size").alias("precision"), F.col("p_retailprice").alias("limit_high")).alias("display"),
        F.struct(F.lit(25.0).alias("limit_high")).alias("control"), F.struct((F.col("p_retailprice") * 1.5).alias("high_alarm")).alias("value_alarm"),
    ))
    rows = b.part.select(F.col("p_partkey").alias("pv_name"), F.get(text(*kinds), (F.col("p_partkey") % 13).cast("int")).alias("nt_type"), data.alias("data"))
    dims = F.array_join(F.transform("dimensions", lambda d: F.concat_ws("/", d["size"].cast("string"), d["full_size"].cast("string"))), ",")
    kept = ("data_type", "scalar_type", "array_size", "description", "units", "precision", "display_high", "control_high", "alarm_hihi")
    return catalog.extracted(rows).select(F.col("pv_name").alias("p_partkey"), *kept, F.array_join("enum_choices", ",").alias("choices"), dims.alias("dims"))


@query("SELECT a AS pv_id, list_extract(v, i) AS value FROM (SELECT vec_id AS a, embedding AS v, unnest(generate_series(1, len(embedding))) AS i FROM embeddings)")
def bulk_from_columns(b):
    ids = F.transform("embedding", lambda x: F.col("vec_id"))
    return b.embeddings.select(F.inline(F.arrays_zip(ids.alias("pv_id"), F.col("embedding").alias("value"))))


# Counts and reports


@query("SELECT count(*) FILTER (level = 'info') AS info, count(*) FILTER (level = 'warning') AS warning, count(*) FILTER (level = 'critical') AS critical, count(*) AS total, count(*) FILTER (level = 'critical') > 0 AS has_critical, count(*) = 0 AS is_clear FROM alert_log WHERE NOT acknowledged")
def alert_summary(b):
    return alerts.summary(b.alert_log)


@query("SELECT count(*) AS n FROM alert_log WHERE NOT acknowledged")
def alert_count_unacked(b):
    return b.alert_log.where("not acknowledged").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n, count(*) FILTER (enabled) AS n_enabled FROM config_before")
def config_counts(b):
    return b.config_before.agg(F.count("*").alias("n"), F.count_if("enabled").alias("n_enabled"))


@query("SELECT data_type, count(*) AS n FROM pv_metadata GROUP BY data_type")
def metadata_count(b):
    return b.pv_metadata.groupBy("data_type").agg(F.count("*").alias("n"))


@query("""SELECT shard, count(*) AS received, count(*) FILTER (outcome IN ('fast', 'slow')) AS published, count(*) FILTER (outcome = 'skipped') AS skipped, count(*) FILTER (outcome = 'fast') AS fast, count(*) FILTER (outcome = 'slow') AS slow,
 count(*) FILTER (outcome = 'unknown_pv') AS unknown_pv, count(*) FILTER (outcome = 'disconnect') AS disconnects, count(*) FILTER (outcome = 'reconnect') AS reconnects,
 CASE WHEN count(*) FILTER (outcome IN ('fast', 'slow')) > 0 THEN count(*) FILTER (outcome = 'fast') * 100 // count(*) FILTER (outcome IN ('fast', 'slow')) ELSE 0 END AS fast_percent FROM outcomes GROUP BY shard""")
def ingest_report(b):
    return upkeep.ingest_report(b.outcomes, ["shard"])


LOSS = """SELECT date_trunc('hour', time) AS bucket, count(*) FILTER (written = 'written') AS written, count(*) FILTER (written = 'lost') AS lost, count(*) FILTER (written = 'dropped') AS dropped FROM outcomes GROUP BY 1"""


def losses(b):
    return upkeep.loss_accounting(b.outcomes.drop("outcome").withColumnRenamed("written", "outcome"))


@query(f"SELECT bucket, written, lost, dropped, CAST(sum(lost + dropped) OVER (ORDER BY bucket) AS BIGINT) AS total_loss, lost + dropped > 0 AS grew FROM ({LOSS})")
def loss_accounting(b):
    return losses(b)


@query(""", grown AS (SELECT list(n ORDER BY n) AS ns FROM (SELECT DISTINCT CAST(epoch_us(time) // 10000000 AS BIGINT) AS n FROM outcomes WHERE written IN ('lost', 'dropped')))
 SELECT unnest(list_reduce(list_prepend(CAST([] AS BIGINT[]), list_transform(ns, lambda x: [x])), lambda acc, x: CASE WHEN len(acc) = 0 OR x[1] - acc[len(acc)] >= 30 THEN list_concat(acc, x) ELSE acc END)) AS n FROM grown""")
def loss_alert(b):
    return upkeep.loss_alerts(b.outcomes.drop("outcome").withColumnRenamed("written", "outcome"))


@query("SELECT pv_id, count(*) AS rows, CAST(sum(length(detail)) AS BIGINT) AS bytes FROM pv_events GROUP BY pv_id")
def storage_report(b):
    return upkeep.storage_report(b.pv_events, ["pv_id"], "detail")


@query(f"SELECT DISTINCT CAST(CAST(ts AS DATE) AS VARCHAR) AS date FROM events WHERE CAST(ts AS DATE) < CAST({NOW} AS DATE) - 10")
def apply_retention(b):
    parts = b.events.select(F.lit("samples").alias("table"), F.to_date("ts").alias("date")).distinct()
    return upkeep.retention(parts, b.now, {"samples": 10}).select(F.col("date").cast("string").alias("date"))


@query("SELECT CAST(CAST(time AS DATE) AS VARCHAR) AS date, pv_id, time, value FROM samples")
def compact(b):
    return upkeep.compacted(b.samples).select(F.col("date").cast("string").alias("date"), "pv_id", "time", "value")


RATES = "SELECT CAST(epoch(date_trunc('hour', ts)) // 3600 AS BIGINT) AS n, count(*) / 3600.0::DOUBLE AS per_s FROM events GROUP BY 1"


@query(f"""SELECT n, round(per_s, 6) AS per_s, seconds, coalesce(greatest(seconds / before, before / seconds) > 1.3, TRUE) AS change, CASE WHEN seconds >= 3600 THEN concat(CAST(seconds // 3600 AS VARCHAR), ' hours') ELSE concat(CAST(seconds // 60 AS VARCHAR), ' minutes') END AS chunk
 FROM (SELECT *, lag(seconds) OVER (ORDER BY n) AS before FROM (SELECT n, per_s, CAST(least(greatest(floor(50 / per_s), 60), 86400) AS BIGINT) AS seconds FROM ({RATES})))""")
def recommend_chunk(b):
    n = F.floor(F.unix_micros(F.date_trunc("hour", "ts")) / 3_600_000_000)
    rates = b.events.groupBy(n.alias("n")).agg((F.count("*") / 3600.0).alias("per_s"))
    return upkeep.recommend_chunk(rates, 50).withColumn("per_s", F.round("per_s", 6))


@query("SELECT address, CAST(round(sum(update_hz)) AS BIGINT) AS events_per_s FROM (SELECT ioc_addr AS address, update_hz FROM pv_status) GROUP BY address")
def rate_format(b):
    return b.pv_status.groupBy(F.col("ioc_addr").alias("address")).agg(F.round(F.sum("update_hz")).cast("long").alias("events_per_s"))


# Table changes; each returns the new table


@query("SELECT pv_name, CAST(CASE WHEN pv_id < 100 THEN pv_id ELSE 99 + row_number() OVER (PARTITION BY pv_id < 100 ORDER BY pv_name) END AS INT) AS pv_id FROM pv_lookup")
def upsert_lookup(b):
    return catalog.registered(b.pv_lookup.where("pv_id < 100").select("pv_name", "pv_id"), b.pv_events.select("pv_name")).select("pv_name", "pv_id")


@query("SELECT pv_name, heartbeat_s, updated_at FROM config_after UNION ALL SELECT pv_name, heartbeat_s, updated_at FROM config_before WHERE pv_name NOT IN (SELECT pv_name FROM config_after)")
def upsert_config(b):
    return catalog.upserted(b.config_before, b.config_after, "pv_name", "updated_at").select("pv_name", "heartbeat_s", "updated_at")


@query("SELECT pv_name, CASE WHEN pv_name IN ('Supplier#000000001', 'Supplier#000000003') THEN FALSE ELSE enabled END AS enabled FROM config_before")
def set_enabled(b):
    return catalog.set_enabled(b.config_before, ["Supplier#000000001", "Supplier#000000003"], False, b.now).select("pv_name", "enabled")


@query("SELECT pv_name, CASE WHEN pv_name = 'Supplier#000000001' THEN 1.0 ELSE heartbeat_s END AS heartbeat_s FROM config_before")
def update_heartbeat(b):
    return catalog.update_heartbeat(b.config_before, "Supplier#000000001", 0.4, b.now).select("pv_name", "heartbeat_s")


@query("SELECT pv_name FROM config_before WHERE pv_name <> 'Supplier#000000001'")
def delete_config(b):
    return catalog.deleted(b.config_before, "pv_name", ["Supplier#000000001"]).select("pv_name")


@query("SELECT id, CASE WHEN id % 2 = 0 THEN concat(units, '!') ELSE units END AS units, CAST(id % 5 AS BIGINT) AS first_seen FROM pv_metadata")
def upsert_metadata(b):
    old = b.pv_metadata.select("id", "units", (F.col("id") % 5).alias("first_seen"), F.lit(0).alias("updated_at"))
    new = old.where("id % 2 = 0").select("id", F.concat("units", F.lit("!")).alias("units"), (F.col("first_seen") + 9).alias("first_seen"), F.lit(1).alias("updated_at"))
    return catalog.upserted(old, new, "id", "updated_at", "first_seen").select("id", "units", "first_seen")


@query("SELECT address, label, CASE WHEN length(label) > 64 THEN 'too_long' WHEN address IN (SELECT address FROM ioc_config) THEN 'conflict' ELSE 'created' END AS outcome FROM (SELECT DISTINCT ioc_addr AS address, CASE WHEN ioc_addr = '10.0.0.2:5075' THEN repeat('x', 65) ELSE 'new' END AS label FROM pv_status)")
def declare_ioc(b):
    wanted = b.pv_status.select(F.col("ioc_addr").alias("address")).distinct().withColumn("label", F.when(F.col("address") == "10.0.0.2:5075", "x" * 65).otherwise("new"))
    return catalog.declared(b.ioc_config, wanted)


@query("SELECT id, message FROM alert_log UNION ALL SELECT (SELECT max(id) FROM alert_log) + row_number() OVER (ORDER BY s_name) AS id, s_name FROM supplier")
def write_alerts(b):
    new = b.supplier.select(F.lit(b.now).alias("time"), F.lit("info").alias("level"), F.col("s_name").alias("message"), F.lit(False).alias("acknowledged"))
    return alerts.appended(b.alert_log, new).select("id", "message")


@query("SELECT id, acknowledged OR id % 10 = 1 AS acknowledged, CASE WHEN NOT acknowledged AND id % 10 = 1 THEN 'me' ELSE acknowledged_by END AS acknowledged_by, NOT acknowledged AND id % 10 = 1 AS changed FROM alert_log")
def acknowledge(b):
    return alerts.acknowledged(b.alert_log, b.alert_log.where("id % 10 = 1").select("id"), "me", b.now).select("id", "acknowledged", "acknowledged_by", "changed")


@query(f"SELECT id FROM alert_log WHERE time >= {NOW} - INTERVAL 10 DAY")
def purge_before(b):
    return alerts.purged(b.alert_log, b.now - timedelta(days=10)).select("id")


# Sources and sinks: written, and read again


def stored(b, rows):
    path = tables.folder(b.spark)
    tables.write_samples(rows, path)
    return tables.read_samples(b.spark, path)


@query("SELECT time, pv_id, value, CAST(severity AS INT) AS severity FROM samples")
def sink_samples(b):
    return stored(b, b.samples).select("time", "pv_id", "value", F.col("severity").cast("int").alias("severity"))


@query("SELECT time, pv_id, value FROM samples WHERE time >= '2024-01-03' AND time < '2024-01-12'")
def read_table(b):
    path = tables.folder(b.spark)
    tables.write_samples(b.samples, path)
    return tables.read_samples(b.spark, path, START, END).select("time", "pv_id", "value")


@query("SELECT conv_id AS pv_id, turn, text AS value FROM conversations")
def sink_strings(b):
    at = F.timestamp_seconds(F.lit(1_704_067_200) + F.col("turn")).cast("timestamp_ntz")
    return stored(b, b.conversations.select(at.alias("time"), F.col("conv_id").alias("pv_id"), "turn", F.col("text").alias("value"))).select("pv_id", "turn", "value")


@query("SELECT label AS pv_id, vec_id AS array_id, CAST(unnest(generate_series(0, len(embedding) - 1)) AS INT) AS idx, unnest(embedding) AS value FROM embeddings")
def sink_arrays(b):
    at = F.timestamp_seconds(F.lit(1_704_067_200) + F.col("vec_id")).cast("timestamp_ntz")
    rows = reshape.exploded(b.embeddings.withColumn("time", at), "embedding", ["time", F.col("label").alias("pv_id"), F.col("vec_id").alias("array_id")])
    return stored(b, rows).select("pv_id", "array_id", "idx", "value")


@query("SELECT vec_id, CAST(4 * len(embedding) AS BIGINT) AS bytes FROM embeddings")
def sink_images(b):
    at = F.timestamp_seconds(F.lit(1_704_067_200) + F.col("vec_id")).cast("timestamp_ntz")
    frame = F.unhex(F.array_join(F.transform("embedding", lambda x: F.lpad(F.hex(F.floor((x + 8) * 1000).cast("bigint")), 8, "0")), ""))
    return stored(b, b.embeddings.select(at.alias("time"), F.col("label").alias("pv_id"), "vec_id", frame.alias("data"))).select("vec_id", F.length("data").cast("long").alias("bytes"))


@query("SELECT event_id, props AS data FROM events")
def sink_json(b):
    rows = b.events.select(F.col("ts").alias("time"), F.col("user_id").alias("pv_id"), "event_id", F.col("props").alias("data"))
    return stored(b, rows).select("event_id", "data")


@query("SELECT l_orderkey AS pv_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_returnflag, l_quantity) - 1 AS INT) AS idx, l_returnflag AS name, l_quantity AS value FROM lineitem")
def sink_captures(b):
    at = F.timestamp_seconds(F.lit(1_704_067_200) + F.col("l_orderkey") % 86_400).cast("timestamp_ntz")
    return stored(b, explode_namevalue(b).withColumn("time", at).withColumnRenamed("l_orderkey", "pv_id")).select("pv_id", "idx", "name", "value")


@query("SELECT target, count(*) AS n FROM (SELECT CASE event_type WHEN 'error' THEN 'samples_hist' ELSE 'samples' END AS target FROM events) GROUP BY target")
def fanout_write(b):
    rows = b.samples.withColumn("target", F.when(F.col("severity") == 2, "samples_hist").otherwise("samples"))
    return tables.fanout(rows, tables.folder(b.spark), batch=1)


@query(f"SELECT target, date, CASE WHEN date < '2024-01-15' THEN 'skipped' ELSE 'applied' END AS outcome FROM (SELECT DISTINCT ({ROUTES})[event_id % 16 + 1] AS target, CAST(CAST(ts AS DATE) AS VARCHAR) AS date FROM events)")
def ensure_tables(b):
    """The tables and dates that the routed updates need, created beside those of the first half of the month, which were there."""
    kind = F.get(F.array(*map(F.lit, KINDS)), (F.col("event_id") % 16).cast("int"))
    wanted = reshape.routed(b.events.withColumn("nt_type", kind)).select("target", F.to_date("ts").cast("string").alias("date")).distinct()
    root = tables.folder(b.spark)
    tables.ensure_tables(wanted.where("date < '2024-01-15'"), root)
    return tables.ensure_tables(wanted, root)


# Streams over the same files; each must give what the batch operator gives


def sample_stream(b):
    severity = F.when(F.col("event_type") == "error", 2).when(F.col("event_type") == "purchase", 1).otherwise(0).cast("smallint")
    return jobs.file_stream(b.spark, b.sf_dir, "events", lambda e: e.select(F.col("ts").cast("timestamp").alias("time"), F.col("user_id").alias("pv_id"), "value", severity.alias("severity"), (F.col("event_type") == "error").cast("smallint").alias("status"), F.col("event_id").alias("tiebreak")))


@query(f"{HOURLY} SELECT {ROLL} FROM hourly")
def streaming_rollup(b):
    rows = jobs.drained(jobs.rollup(sample_stream(b)), ["bucket", "pv_id"])
    return rolled(rows.withColumn("bucket", F.col("bucket").cast("timestamp_ntz")))


@query("SELECT make_timestamp(epoch_us(time) // 30000000 * 30000000) AS bucket, pv_id, count(*) AS events, arg_max(value, (time, tiebreak)) AS last_value FROM samples GROUP BY ALL")
def streaming_status(b):
    return jobs.drained(jobs.stats(sample_stream(b)), ["bucket", "pv_id"]).select(F.col("bucket").cast("timestamp_ntz").alias("bucket"), "pv_id", "events", "last_value")


@query(FOLD)
def streaming_status_fold(b):
    code = F.when(F.col("event_type") == "signup", 0).when(F.col("event_type") == "view", 1).when(F.col("event_type") == "click", 2).when(F.col("event_type") == "error", 3).otherwise(4)
    events = jobs.file_stream(b.spark, b.sf_dir, "events", lambda e: e.select("event_id", F.col("user_id").cast("int").alias("pv_id"), "ts", code.alias("event_type")))
    rows = jobs.carried(events, jobs.status, jobs.STATES)
    return rows.groupBy("pv_id").agg(F.max_by("state", "batch").cast("int").alias("state"))


@query(TIMEOUTS)
def streaming_timeouts(b):
    step = jobs.gaps(lambda samples, now: lifecycle.timeouts(samples, 6 * 3600, now), due=lambda last, now: lifecycle.timeouts_due(last, 6 * 3600, now))
    return jobs.carried(sample_stream(b), step, jobs.OPEN).select("time", "pv_id", F.col("status").cast("int").alias("status"))


@query(HEARTBEATS)
def streaming_heartbeats(b):
    every = intervals(b)
    step = jobs.gaps(lambda samples, now: lifecycle.heartbeats(samples, 14400.0, every, now), due=lambda last, now: lifecycle.heartbeats_due(last, 14400.0, every, now))
    return jobs.carried(sample_stream(b), step, jobs.OPEN).select("time", "pv_id", "value", F.col("severity").cast("int").alias("severity"))


@query("""SELECT pv_id, CASE WHEN pv_id % 6 IN (1, 2) THEN 3 ELSE 1 + pv_id % 6 END AS state, CAST(sum(n) AS BIGINT) AS events_total, arg_max(last_value, w) AS last_value, max(last_at) AS last_event_at, arg_max(n, w) / 30.0 AS update_hz
 FROM (SELECT pv_id, epoch_us(time) // 30000000 AS w, count(*) AS n, arg_max(value, (time, tiebreak)) AS last_value, max(time) AS last_at FROM samples GROUP BY ALL) GROUP BY pv_id""")
def streaming_status_table(b):
    """The status table as the samples arrive, from one without any events."""
    known = b.pv_status.select("pv_id", "state", *(F.lit(None).cast(t).alias(c) for c, t in jobs.STATUS_VALUES.items()), F.lit(0).cast("long").alias("events_total"))
    table = jobs.carried_table(sample_stream(b), jobs.status_table, known.schema, known).select("pv_id", "state", "events_total", "last_value", "last_event_at", "update_hz")
    return table.withColumns({"state": F.col("state").cast("int"), "last_event_at": F.col("last_event_at").cast("timestamp_ntz")})


@query(NOTICES)
def streaming_config_changes(b):
    return jobs.drained(jobs.notices(jobs.file_stream(b.spark, b.sf_dir, "supplier", notices)), mode="append")


@query("SELECT pv_id, count(*) AS n FROM samples GROUP BY pv_id")
def retry_safe_write(b):
    """The first write of the first batch is followed by a failure, and made again."""
    path, checkpoint, left = tables.folder(b.spark), tables.folder(b.spark), [1]

    def fail(number):
        if left and left.pop():
            raise OSError("the write failed")

    jobs.retried(lambda: jobs.written(sample_stream(b), path, checkpoint, "append", fail), waits=(0.1, 1))
    return b.spark.read.option("basePath", path).parquet(f"{path}/batch=*").groupBy("pv_id").agg(F.count("*").alias("n"))


__all__ = ["oracle_sql", "queries", "query"]
