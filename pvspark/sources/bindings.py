"""The archive's tables, bound to the given test tables. Each view is one SELECT that Spark and DuckDB both run."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

ADDRESS = "concat('10.0.0.', CAST({} % 12 AS {string}), ':5075')"

VIEWS = {
    "samples": """SELECT ts AS time, user_id AS pv_id, value,
        CAST(CASE event_type WHEN 'error' THEN 2 WHEN 'purchase' THEN 1 ELSE 0 END AS SMALLINT) AS severity,
        CAST(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS SMALLINT) AS status, CAST(0 AS SMALLINT) AS reason, event_id AS tiebreak FROM {events}""",
    "pv_lookup": "SELECT CAST(user_id AS INT) AS pv_id, concat('PV:', lpad(CAST(user_id AS {string}), 6, '0')) AS pv_name FROM {events} GROUP BY user_id",
    "pv_events": """SELECT event_id, concat('PV:', lpad(CAST(user_id AS {string}), 6, '0')) AS pv_name, CAST(user_id AS INT) AS pv_id, ts,
        CASE event_type WHEN 'signup' THEN 0 WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'error' THEN 3 ELSE 4 END AS event_type,
        CASE WHEN event_type IN ('view', 'error', 'purchase') THEN concat('10.0.0.', CAST(user_id % 12 AS {string}), ':5075') END AS ioc_addr,
        CASE WHEN event_type = 'error' THEN props END AS detail FROM {events}""",
    "ioc_config": """SELECT concat('10.0.0.', CAST(s_suppkey AS {string}), ':5075') AS address, CASE WHEN s_suppkey % 2 = 0 THEN '' ELSE concat('Device ', CAST(s_suppkey AS {string})) END AS label,
        s_suppkey % 5 <> 0 AS enabled FROM {supplier} WHERE s_suppkey > 2""",
    "pv_status": """SELECT concat('PV:', lpad(CAST(user_id AS {string}), 6, '0')) AS pv_name, CAST(user_id AS INT) AS pv_id, CAST(1 + user_id % 6 AS SMALLINT) AS state,
        concat('10.0.0.', CAST(user_id % 12 AS {string}), ':5075') AS ioc_addr, min(ts) AS subscribed_at, min(ts) AS connected_at, max(ts) AS last_event_at,
        count(*) AS events_total, count(*) / 30.0 AS update_hz, 0.5 AS health_score FROM {events} GROUP BY user_id""",
    "config_before": """SELECT s_name AS pv_name, concat('signal ', CAST(s_nationkey AS {string})) AS description, 'mA' AS unit, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE CAST(s_suppkey % 9 AS DOUBLE) END AS heartbeat_s,
        concat('ioc', CAST(s_nationkey AS {string})) AS expected_ioc, s_acctbal > 0 AS enabled, CAST('2024-01-01' AS {timestamp}) AS updated_at, s_suppkey FROM {supplier} WHERE s_suppkey % 7 <> 0""",
    "config_after": """SELECT s_name AS pv_name, concat('signal ', CAST(s_nationkey AS {string})) AS description, 'mA' AS unit,
        CASE WHEN s_suppkey % 11 = 0 THEN 42.0 WHEN s_suppkey % 3 = 0 THEN NULL ELSE CAST(s_suppkey % 9 AS DOUBLE) END AS heartbeat_s,
        concat('ioc', CAST(s_nationkey AS {string})) AS expected_ioc, s_acctbal > 0 AS enabled, CAST('2024-01-02' AS {timestamp}) AS updated_at, s_suppkey FROM {supplier} WHERE s_suppkey % 5 <> 0""",
    "pv_metadata": """SELECT p_name AS name, p_partkey AS id, CASE p_size % 3 WHEN 0 THEN 'scalar' WHEN 1 THEN 'enum' ELSE 'image' END AS data_type, p_size AS array_size, p_size - 5 AS precision,
        CAST(0 AS DOUBLE) AS display_low, p_retailprice - 1000 AS display_high, CAST(p_size AS DOUBLE) AS control_low, CAST(25 AS DOUBLE) AS control_high, CAST(p_size - 20 AS DOUBLE) AS min_step,
        p_retailprice * 0.8 AS alarm_lolo, p_retailprice * 0.9 AS alarm_low, p_retailprice * 1.1 AS alarm_high, p_retailprice * 1.2 AS alarm_hihi, CAST(-1 AS DOUBLE) AS alarm_hysteresis,
        p_type AS description, p_brand AS units FROM {part}""",
    "alert_log": """SELECT event_id AS id, ts AS time, CASE event_type WHEN 'error' THEN 'critical' WHEN 'purchase' THEN 'warning' ELSE 'info' END AS level, 'ingest' AS source,
        CASE event_id % 4 WHEN 0 THEN 'system' WHEN 1 THEN 'pv' WHEN 2 THEN 'ioc' ELSE 'shard' END AS category, concat('PV:', lpad(CAST(user_id AS {string}), 6, '0')) AS pv_name,
        props AS message, event_id % 3 = 0 AS acknowledged, CASE WHEN event_id % 3 = 0 THEN 'operator' END AS acknowledged_by, CASE WHEN event_id % 3 = 0 THEN ts END AS acknowledged_at FROM {events}""",
    "sparse": """SELECT ts AS time, CAST(user_id AS INT) AS pv_id, CASE WHEN event_id % 4 <> 0 THEN value END AS value,
        CASE WHEN event_id % 3 <> 0 THEN CAST(CASE event_type WHEN 'error' THEN 2 WHEN 'purchase' THEN 1 ELSE 0 END AS SMALLINT) END AS severity, event_id AS tiebreak FROM {events}""",
    "outcomes": """SELECT ts AS time, CAST(user_id % 4 AS INT) AS shard, CASE WHEN event_id % 17 = 0 THEN 'unknown_pv' WHEN event_type = 'error' THEN 'disconnect' WHEN event_type = 'purchase' THEN 'reconnect'
        WHEN event_id % 5 = 0 THEN 'skipped' WHEN event_type = 'view' THEN 'fast' ELSE 'slow' END AS outcome,
        CASE WHEN event_id % 211 = 0 THEN 'lost' WHEN event_id % 307 = 0 THEN 'dropped' ELSE 'written' END AS written FROM {events}""",
}

#: For the SQL side: every view as a common table expression, and the parameters that the queries use.
NOW = "(SELECT max(ts) FROM events)"


def ctes() -> str:
    names = {t: t for t in TABLES} | {"string": "VARCHAR", "timestamp": "TIMESTAMP"}
    return "WITH " + ",\n".join(f"{name} AS ({sql.format(**names)})" for name, sql in VIEWS.items())


class Bound:
    """The tables of one directory; views are attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.table(name)
        if name not in VIEWS:
            raise AttributeError(name)
        sql = VIEWS[name]
        used = {t: self.table(t) for t in TABLES if "{" + t + "}" in sql}
        marks = {t: "{" + t + "}" for t in TABLES} | {"string": "STRING", "timestamp": "TIMESTAMP_NTZ"}
        return self.spark.sql(sql.format(**marks), **used)

    @cached_property
    def now(self):
        """The latest time of the data, as the clock of all queries."""
        return self.events.agg({"ts": "max"}).first()[0]
