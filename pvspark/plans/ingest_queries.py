"""Queries over the archive as the ingest pass writes it: a stream of JSON updates of all thirteen kinds, made from the events, goes to all sample tables.

The SQL states each table's rows from the events by rule, without JSON.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pvspark.operators import ingest
from pvspark.plans.registry import query
from pvspark.sources import tables
from pvspark.streaming import jobs

_ROOTS: dict[tuple[str, str], str] = {}

BODY = """CASE event_id % 13
 WHEN 0 THEN concat('{"nt_type":"NTScalar","value":{"type":"Double","v":', value, '}')
 WHEN 1 THEN concat('{"nt_type":"NTScalar","value":{"type":"String","v":"', event_type, '"}')
 WHEN 2 THEN concat('{"nt_type":"NTScalar","value":{"type":"Boolean","v":', IF(event_id % 2 = 1, 'true', 'false'), '}')
 WHEN 3 THEN concat('{"nt_type":"NTEnum","value":{"index":', user_id % 3, ',"choices":["a","b","c"]}')
 WHEN 4 THEN concat('{"nt_type":"NTScalarArray","value":{"type":"DoubleArray","v":[', array_join(transform(IF(event_id % 4 = 0, array(), sequence(1, event_id % 4)), i -> concat(value, i, 'e0')), ','), ']}')
 WHEN 5 THEN concat('{"nt_type":"NTScalarArray","value":{"type":"StringArray","v":["', event_type, '","x"]}')
 WHEN 6 THEN concat('{"nt_type":"NTMatrix","dim":[2,2],"value":[', value, ',2,3,4]')
 WHEN 7 THEN concat('{"nt_type":"NTHistogram","ranges":[0.5,10', IF(event_id % 3 = 0, ',20,30', ''), '],"', IF(event_id % 2 = 0, 'value":{"type":"Int","v":[', 'counts":['), event_id, ',2.5,7', IF(event_id % 2 = 0, ']}', ']'))
 WHEN 8 THEN concat('{"nt_type":"NTContinuum","units":["s"],"base":[0,1', IF(event_id % 2 = 0, ',2,3', ''), '],"value":[', value, ',5,6]')
 WHEN 9 THEN concat('{"nt_type":"NTNameValue","name":["', event_type, '",5,"c"', IF(event_id % 2 = 0, '', ',"d","e"'), '],"value":{"type":"DoubleArray","v":[', value, ',"4",3,null]}')
 WHEN 10 THEN concat('{"nt_type":"NTMultiChannel","channel_name":["p","q","', event_type, '"],"values":[{"type":"Double","v":', value, '},2,{"type":"Int","v":3}],"severities":["Minor"', IF(event_id % 2 = 0, ',2', ''), ']')
 WHEN 11 THEN IF(event_id % 2 = 0, concat('{"nt_type":"NTTable","labels":["x"],"columns":[{"name":"x","values":{"type":"IntArray","v":[', event_id, ']}}]'),
  concat('{"nt_type":"NTNDArray","value":{"type":"', IF(event_id % 3 = 0, 'ShortArray', 'UByteArray'), '","v":[', event_id % 256, ',0,16]},"codec":{"name":"lz4"},"compressed_size":3,"dimension":[{"size":2},{"size":', event_id % 5, '}],"unique_id":', event_id, ',"attribute":[{"name":"gain","value":', value, '}]'))
 ELSE CASE event_id % 3 WHEN 0 THEN concat('{"nt_type":"NTUnion","value":{"type":"Scalar","v":{"type":"Double","v":', value, '}}') WHEN 1 THEN concat('{"nt_type":"Custom","data":{"deep":[1,{"y":', value, '}]}') ELSE concat('{"nt_type":"NTAggregate","n":3,"max":9,"value":', value) END
 END"""
TAIL = """concat(',"alarm":', CASE event_type WHEN 'error' THEN '{"severity":"Major","status":"Device"}' WHEN 'purchase' THEN '{"severity":1}' WHEN 'signup' THEN '{"severity":"Odd","status":99}' ELSE '{}' END,
 ',"timestamp":{"seconds":', unix_micros(CAST(ts AS TIMESTAMP)) DIV 1000000, ',"nanoseconds":', unix_micros(CAST(ts AS TIMESTAMP)) % 1000000 * 1000 + 7, '}}')"""


def updates(events: DataFrame) -> DataFrame:
    """Events as JSON updates: each 97th text is broken off, each 89th has a name that nobody knows."""
    whole = F.concat(F.expr(BODY), F.expr(TAIL))
    name = F.when(F.col("event_id") % 89 == 0, "nobody").otherwise(F.concat(F.lit("PV:"), F.lpad(F.col("user_id").cast("string"), 6, "0")))
    return events.select("event_id", name.alias("pv_name"), F.when(F.col("event_id") % 97 == 0, F.substring(whole, 1, 15)).otherwise(whole).alias("data"))


def archive(b) -> str:
    """The root of the archive that the stream of updates has filled; once in a session."""
    key = (b.spark.sparkContext.applicationId, b.sf_dir)
    if key not in _ROOTS:
        root = tables.folder(b.spark)
        ingest.archive_stream(jobs.file_stream(b.spark, b.sf_dir, "events", updates), b.pv_lookup, root, tables.folder(b.spark)).awaitTermination()
        _ROOTS[key] = root
    return _ROOTS[key]


def stored(b, table: str) -> DataFrame:
    rows = tables.read_table(b.spark, archive(b), table)
    return rows.withColumns({c: F.col(c).cast("int") for c in ("severity", "status", "reason", "ch_severity") if c in rows.columns})


U = """, u AS (SELECT *, event_id % 13 AS k, CASE event_type WHEN 'error' THEN 2 WHEN 'purchase' THEN 1 WHEN 'signup' THEN 4 ELSE 0 END AS severity, CASE event_type WHEN 'error' THEN 1 WHEN 'signup' THEN 6 ELSE 0 END AS status,
 ts AS time, CAST(user_id AS INT) AS pv_id FROM events WHERE event_id % 97 <> 0 AND event_id % 89 <> 0)"""
ROW = "time, pv_id, severity, status"
BY = "CASE k WHEN 0 THEN 'samples' WHEN 1 THEN 'samples_string' WHEN 2 THEN 'samples' WHEN 3 THEN 'samples' WHEN 4 THEN 'samples_array_num' WHEN 5 THEN 'samples_array_str' WHEN 6 THEN 'samples_array_num' WHEN 7 THEN 'samples_hist' WHEN 8 THEN 'samples_cont' WHEN 9 THEN 'samples_nv' WHEN 10 THEN 'samples_mch' WHEN 11 THEN CASE event_id % 2 WHEN 0 THEN 'samples_table' ELSE 'samples_image' END ELSE CASE event_id % 3 WHEN 2 THEN 'samples' ELSE 'samples_custom' END END"


@query(f"{U} SELECT event_id, CASE WHEN event_id % 97 = 0 THEN NULL ELSE ts END AS time, CASE WHEN event_id % 97 = 0 THEN NULL ELSE CASE event_type WHEN 'error' THEN 2 WHEN 'purchase' THEN 1 WHEN 'signup' THEN 4 ELSE 0 END END AS severity, CASE WHEN event_id % 97 <> 0 THEN {BY} END AS target FROM (SELECT *, event_id % 13 AS k FROM events)")
def typed_updates(b):
    rows = ingest.parsed(updates(b.events))
    there = F.col("target").isNotNull()
    return rows.select("event_id", F.when(there, F.col("time")).alias("time"), F.when(there, F.col("severity").cast("int")).alias("severity"), "target")


@query(f"{U} SELECT {ROW}, CASE k WHEN 2 THEN event_id % 2 WHEN 3 THEN user_id % 3 ELSE value END::DOUBLE AS value, 0 AS reason FROM u WHERE k IN (0, 2, 3) OR k = 12 AND event_id % 3 = 2")
def ingest_samples(b):
    return stored(b, "samples")


@query(f"{U} SELECT {ROW}, event_type AS value FROM u WHERE k = 1")
def ingest_strings(b):
    return stored(b, "samples_string")


@query(f"""{U}, a AS (SELECT *, CASE k WHEN 4 THEN list_transform(range(1, event_id % 4 + 1), lambda i: CAST(concat(CAST(value AS VARCHAR), i) AS DOUBLE)) ELSE [value, 2, 3, 4] END AS v FROM u WHERE k IN (4, 6))
 SELECT {ROW}, CAST(unnest(range(0, len(v))) AS INT) AS idx, unnest(v) AS value FROM a""")
def ingest_arrays(b):
    return stored(b, "samples_array_num").drop("array_id")


@query(f"{U} SELECT {ROW}, unnest([0, 1]) AS idx, unnest([event_type, 'x']) AS value FROM u WHERE k = 5")
def ingest_text_arrays(b):
    return stored(b, "samples_array_str").drop("array_id")


@query(f"""{U}, a AS (SELECT *, CASE event_id % 3 WHEN 0 THEN 3 ELSE 2 END AS n FROM u WHERE k = 7)
 SELECT {ROW}, CAST(unnest(range(0, n)) AS INT) AS idx, unnest([0.5, 10, 20][1:n])::DOUBLE AS range_val, unnest([event_id, 0, 7][1:n])::BIGINT AS count FROM a""")
def ingest_histograms(b):
    return stored(b, "samples_hist").drop("capture_id")


@query(f"""{U}, a AS (SELECT *, CASE event_id % 2 WHEN 0 THEN 3 ELSE 2 END AS n FROM u WHERE k = 8)
 SELECT {ROW}, CAST(unnest(range(0, n)) AS INT) AS idx, unnest([0, 1, 2][1:n])::DOUBLE AS base_val, unnest([value, 5, 6][1:n]) AS trace_val FROM a""")
def ingest_continua(b):
    return stored(b, "samples_cont").drop("capture_id")


@query(f"""{U}, a AS (SELECT *, CASE event_id % 2 WHEN 0 THEN 3 ELSE 4 END AS n FROM u WHERE k = 9)
 SELECT {ROW}, CAST(unnest(range(0, n)) AS INT) AS idx, unnest([event_type, '', 'c', 'd'][1:n]) AS name, unnest([value, 0, 3, 0][1:n]) AS value FROM a""")
def ingest_name_values(b):
    return stored(b, "samples_nv").drop("capture_id")


@query(f"{U} SELECT {ROW}, unnest([0, 1, 2]) AS idx, unnest(['p', 'q', event_type]) AS ch_name, unnest([value, 2, 3]) AS ch_value, unnest([1, CASE event_id % 2 WHEN 0 THEN 2 ELSE 0 END, 0]) AS ch_severity FROM u WHERE k = 10")
def ingest_channels(b):
    return stored(b, "samples_mch").drop("capture_id")


@query(f"{U} SELECT {ROW}, event_id AS x, 'NTTable' AS nt_type FROM u WHERE k = 11 AND event_id % 2 = 0")
def ingest_tables(b):
    data = F.col("data")
    return stored(b, "samples_table").select("time", "pv_id", "severity", "status", F.variant_get(data, "$.columns[0].values.v[0]", "bigint").alias("x"), F.variant_get(data, "$.nt_type", "string").alias("nt_type"))


@query(f"{U} SELECT {ROW}, CASE event_id % 3 WHEN 0 THEN 'NTUnion' ELSE 'Custom' END AS nt_type, value FROM u WHERE k = 12 AND event_id % 3 <> 2")
def ingest_customs(b):
    data = F.col("data")
    value = F.coalesce(F.try_variant_get(data, "$.value.v.v", "double"), F.try_variant_get(data, "$.data.deep[1].y", "double"))
    return stored(b, "samples_custom").select("time", "pv_id", "severity", "status", "nt_type", value.alias("value"))


@query(f"""{U} SELECT {ROW}, CASE event_id % 3 WHEN 0 THEN '' ELSE concat(printf('%02X', event_id % 256), '0010') END AS data, 'lz4' AS codec, 3 AS compressed_size, 0 AS uncompressed_size, concat('2,', event_id % 5) AS dimensions, CAST(event_id AS INT) AS unique_id, value AS gain
 FROM u WHERE k = 11 AND event_id % 2 = 1""")
def ingest_images(b):
    rows = stored(b, "samples_image").withColumns({"data": F.hex("data"), "dimensions": F.array_join(F.col("dimensions").cast("array<string>"), ","), "gain": F.variant_get("attributes", "$[0].value", "double")})
    return rows.withColumns({c: F.col(c).cast("int") for c in ("compressed_size", "uncompressed_size")}).drop("attributes")


@query("SELECT pv_name, refused, count(*) AS n FROM (SELECT CASE WHEN event_id % 89 = 0 THEN 'nobody' ELSE concat('PV:', lpad(CAST(user_id AS VARCHAR), 6, '0')) END AS pv_name, CASE WHEN event_id % 97 = 0 THEN 'malformed' ELSE 'unknown_pv' END AS refused FROM events WHERE event_id % 97 = 0 OR event_id % 89 = 0) GROUP BY ALL")
def ingest_refused(b):
    return b.spark.read.parquet(f"{archive(b)}/quarantine").groupBy("pv_name", "refused").agg(F.count("*").alias("n"))


@query(f"""{U}, parts AS (SELECT {BY} AS name, CASE k WHEN 4 THEN event_id % 4 WHEN 5 THEN 2 WHEN 6 THEN 4 WHEN 7 THEN CASE event_id % 3 WHEN 0 THEN 3 ELSE 2 END WHEN 8 THEN CASE event_id % 2 WHEN 0 THEN 3 ELSE 2 END WHEN 9 THEN CASE event_id % 2 WHEN 0 THEN 3 ELSE 4 END WHEN 10 THEN 3 ELSE 1 END AS n FROM u)
 SELECT name, CAST(sum(n) AS BIGINT) AS n FROM parts GROUP BY name
 UNION ALL SELECT 'received', count(*) FROM events UNION ALL SELECT 'published', count(*) FROM u UNION ALL SELECT 'malformed', count(*) FROM events WHERE event_id % 97 = 0 UNION ALL SELECT 'unknown_pv', count(*) FROM events WHERE event_id % 89 = 0 AND event_id % 97 <> 0""")
def ingest_counts(b):
    """The counts that were observed while the tables were written."""
    return b.spark.read.parquet(f"{archive(b)}/counts").groupBy("name").agg(F.sum("n").alias("n"))


@query(f"""{U} SELECT {BY} AS name, count(*) AS captures, count(*) AS ids FROM u WHERE k BETWEEN 5 AND 10 OR k = 4 AND event_id % 4 > 0 GROUP BY ALL""")
def ingest_capture_ids(b):
    """Captures, and ids of captures, of each table whose rows are elements."""
    out = None
    for t, key in (("samples_array_num", "array_id"), ("samples_array_str", "array_id"), ("samples_hist", "capture_id"), ("samples_cont", "capture_id"), ("samples_nv", "capture_id"), ("samples_mch", "capture_id")):
        one = stored(b, t).agg(F.count_if(F.col("idx") == 0).alias("captures"), F.count_distinct(key).alias("ids")).select(F.lit(t).alias("name"), "captures", "ids").where("captures > 0")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"""{U} SELECT {BY} AS name, CAST(sum(CASE k WHEN 4 THEN event_id % 4 WHEN 5 THEN 2 WHEN 6 THEN 4 WHEN 7 THEN CASE event_id % 3 WHEN 0 THEN 3 ELSE 2 END WHEN 8 THEN CASE event_id % 2 WHEN 0 THEN 3 ELSE 2 END WHEN 9 THEN CASE event_id % 2 WHEN 0 THEN 3 ELSE 4 END WHEN 10 THEN 3 ELSE 1 END) AS BIGINT) AS n, count(DISTINCT ts::DATE) AS dates FROM u WHERE NOT (k = 4 AND event_id % 4 = 0) GROUP BY ALL""")
def created_tables(b):
    """The tables of a new database, created by the layout's versions, filled by insertion from the archive, and read by their names."""
    root = tables.folder(b.spark)
    database = f"archive_{root.rpartition('/')[2]}"
    tables.create_tables(b.spark, database, root)
    out = None
    for t in ingest.WRITERS:
        rows = tables.read_table(b.spark, archive(b), t)
        rows.withColumn("date", F.to_date("time")).repartition("date").write.insertInto(f"{database}.{t}")
        one = b.spark.table(f"{database}.{t}").agg(F.count("*").alias("n"), F.count_distinct("date").alias("dates")).select(F.lit(t).alias("name"), "n", "dates").where("n > 0")
        out = one if out is None else out.unionByName(one)
    return out
