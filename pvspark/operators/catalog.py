"""Names, configuration and metadata: reads, joins and changes of dimension tables. Changes return the new table."""

from __future__ import annotations

from datetime import datetime
from decimal import Decimal

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pvspark.functions import columns as C
from pvspark.operators.segments import scanned
from pvspark.sources.tables import numbered


def resolved(events: DataFrame, lookup: DataFrame) -> DataFrame:
    """Events with the id of their name; unknown names go (see unknown). Catalyst broadcasts the dictionary where its size allows."""
    return events.join(lookup, "pv_name")


def with_id(events: DataFrame, lookup: DataFrame) -> DataFrame:
    """Events with the id of their name, null for unknown names."""
    return events.join(lookup, "pv_name", "left")


def unknown(events: DataFrame, lookup: DataFrame) -> DataFrame:
    """Events of unknown names, for quarantine."""
    return events.join(lookup, "pv_name", "left_anti")


def named_in(rows: DataFrame, names: DataFrame) -> DataFrame:
    return rows.join(names.select("pv_name"), "pv_name", "left_semi")


def heartbeat_config(config: DataFrame, lookup: DataFrame) -> DataFrame:
    """Each configured signal's heartbeat; -1 stands for the default."""
    return config.join(lookup, "pv_name").select("pv_id", F.coalesce("heartbeat_s", F.lit(-1.0)).alias("heartbeat_s"))


def enabled(config: DataFrame) -> DataFrame:
    return config.where("enabled")


def changed_since(config: DataFrame, since: datetime) -> DataFrame:
    return config.where(F.col("updated_at") > F.lit(since)).orderBy("updated_at", "pv_name")


def search(config: DataFrame, text: str, limit: int) -> DataFrame:
    """Names that hold the text, whatever its case, in order; % and _ in it are wildcards. 1 to 1000 rows."""
    return config.where(F.col("pv_name").ilike(C.like_pattern(text, escape=False))).orderBy("pv_name").limit(max(1, min(limit, 1000)))


def registered(lookup: DataFrame, names: DataFrame) -> DataFrame:
    """The dictionary with new names appended. Ids stay; new ones follow the largest, in order of the names, which only new names are sorted for."""
    new = names.select("pv_name").where("pv_name is not null").distinct().join(lookup, "pv_name", "left_anti")
    top = lookup.agg(F.coalesce(F.max("pv_id"), F.lit(-1)).alias("m")).first()["m"]
    return lookup.unionByName(numbered(new.select("pv_name"), ["pv_name"], "pv_id").withColumn("pv_id", (F.col("pv_id") + top).cast("int")), allowMissingColumns=True)


def upserted(table: DataFrame, new: DataFrame, key: str, recency: str, keep_least: str | None = None) -> DataFrame:
    """The table with the new rows in place of those of their key; of several the most recent, of those with one recency any, but the same in every run. `keep_least`
    keeps its least value. The table has one row for each key.

    The winners' ranks are found first, by hash aggregation of numbers; only they are joined back to whole rows, and the table's other rows are never aggregated."""
    kind = table.schema[recency].dataType.simpleString()
    at = F.unix_micros(F.col(recency).cast("timestamp")) if kind.startswith(("timestamp", "date")) else F.col(recency)
    rank = (F.coalesce(at.cast("decimal(18,0)"), F.lit(-(10**17)).cast("decimal(18,0)")) * F.lit(Decimal(1 << 64))).cast("decimal(38,0)") + F.xxhash64(*table.columns).cast("decimal(19,0)")
    ranked = new.select(*table.columns).distinct().withColumn("_rank", rank)
    best = ranked.groupBy(F.col(key).alias("_key")).agg(F.max("_rank").alias("_best"), *([F.min(keep_least).alias("_least")] if keep_least else []))
    own = F.col(key).eqNullSafe(F.col("_key"))
    winners = ranked.join(best, own & (F.col("_rank") == F.col("_best")))
    if keep_least:
        before = table.select(F.col(key).alias("_old_key"), F.col(keep_least).alias("_old"))
        winners = winners.join(before, F.col(key).eqNullSafe(F.col("_old_key")), "left").withColumn(keep_least, F.least("_least", "_old"))
    return table.join(best.select("_key"), own, "left_anti").unionByName(winners.select(*table.columns))


def set_enabled(config: DataFrame, names: list[str], on: bool, now: datetime) -> DataFrame:
    hit = F.col("pv_name").isin(names)
    return config.withColumns({"enabled": F.when(hit, on).otherwise(F.col("enabled")), "updated_at": F.when(hit, F.lit(now)).otherwise(F.col("updated_at"))})


def update_heartbeat(config: DataFrame, name: str, seconds: float, now: datetime) -> DataFrame:
    hit = F.col("pv_name") == name
    return config.withColumns({"heartbeat_s": F.when(hit, C.normalize_heartbeat(F.lit(seconds))).otherwise(F.col("heartbeat_s")), "updated_at": F.when(hit, F.lit(now)).otherwise(F.col("updated_at"))})


def deleted(table: DataFrame, key: str, values: list) -> DataFrame:
    return table.where(~F.coalesce(F.col(key).isin(values), F.lit(False)))


def declared(devices: DataFrame, wanted: DataFrame) -> DataFrame:
    """What becomes of each wanted device: created, conflict (there is one already) or too_long (a label over 64 characters)."""
    there = devices.select("address", F.lit(True).alias("_there"))
    outcome = F.when(F.length("label") > 64, "too_long").when(F.col("_there"), "conflict").otherwise("created")
    return wanted.join(there, "address", "left").select("address", "label", outcome.alias("outcome"))


def new_only(metadata: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    return metadata.join(stored.select(key), key, "left_anti")


def flags(metadata: DataFrame) -> DataFrame:
    limits = [F.col(f"alarm_{x}") != 0 for x in ("lolo", "low", "high", "hihi")]
    return metadata.withColumns({
        "has_display_range": F.col("display_low") < F.col("display_high"), "has_control_range": F.col("control_low") < F.col("control_high"),
        "has_alarm_limits": limits[0] | limits[1] | limits[2] | limits[3], "is_enum": F.size("enum_choices") > 0, "is_image": F.col("data_type") == "image",
    })


def cleaned(metadata: DataFrame) -> DataFrame:
    """Precision within 0 to 15; step and hysteresis not negative."""
    return metadata.withColumns({"precision": F.least(F.greatest("precision", F.lit(0)), F.lit(15)), "min_step": F.greatest("min_step", F.lit(0.0)), "alarm_hysteresis": F.greatest("alarm_hysteresis", F.lit(0.0))})


def history(updates: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Updates (key, time, fields) that change a field against the one before, with the names of the changed fields; the first update of a key lists none."""
    rows = scanned(updates, key, ["time"], before={f"_before_{f}": f for f in fields}, number="_n")
    changed = F.array_compact(F.array(*(F.when((F.col("_n") > 0) & ~F.col(f).eqNullSafe(F.col(f"_before_{f}")), f) for f in fields)))
    return rows.withColumn("changed", changed).where((F.col("_n") == 0) | (F.size("changed") > 0)).drop("_n", *(f"_before_{f}" for f in fields))


def first_updates(updates: DataFrame, session: str) -> DataFrame:
    """The first update of each signal in each session."""
    w = Window.partitionBy("pv_id", session).orderBy("time", "tiebreak")
    return updates.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


# What a first update may tell about a signal, whatever its kind. `value` keeps its JSON text, as kinds hold scalars, lists or objects there.
UPDATE = (
    "value string, scalar_type string, descriptor string, units array<string>, base array<double>, choices array<string>, dim array<int>, channel_name array<string>, columns array<struct<values: string>>, "
    "dimension array<struct<size: int, full_size: int>>, display struct<description: string, units: string, precision: int, form: string, limit_low: double, limit_high: double>, "
    "control struct<limit_low: double, limit_high: double, min_step: double>, value_alarm struct<low_alarm: double, low_warning: double, high_warning: double, high_alarm: double, hysteresis: double>"
)


def extracted(updates: DataFrame) -> DataFrame:
    """The metadata of signals from their first updates (pv_name, nt_type, data as JSON): which fields a kind has is its own matter; the rest keep their defaults.

    Limits default to 0 and texts to empty. scalar_type is that of the value or its elements, array_size the number of elements, bins, points, rows or channels."""
    u = lambda f: F.col(f"u.{f}")
    kind = F.col("nt_type")
    of = lambda *kinds: kind.isin(*kinds)
    plain = of("scalar", "scalar_array")
    zero = lambda when, f: F.coalesce(F.when(when, u(f)), F.lit(0.0))
    shown = plain | of("matrix")
    n = F.json_array_length(u("value"))
    described = F.when(of("matrix", "histogram", "continuum", "name_value", "union"), u("descriptor"))
    description = F.coalesce(F.when(shown, F.nullif(u("display.description"), F.lit(""))), described, F.lit(""))
    scalar = F.when(of("enum"), "int").when(of("matrix", "continuum", "aggregate"), "double").when(plain | of("name_value", "nd_array", "union"), u("scalar_type"))
    size = (
        F.when(of("scalar_array", "matrix", "histogram", "name_value"), F.coalesce(n, F.lit(0)))
        .when(of("continuum"), F.coalesce(F.size(u("base")), F.lit(0)))
        .when(of("table"), F.coalesce(F.json_array_length(F.get(u("columns"), 0)["values"]), F.lit(0)))
        .when(of("multi_channel"), F.coalesce(F.size(u("channel_name")), F.lit(0)))
    )
    whole = F.transform(u("dim"), lambda d: F.struct(d.alias("size"), d.alias("full_size")))
    dims = F.when(of("nd_array"), u("dimension")).when(of("matrix") & (F.size(u("dim")) >= 2), whole)
    limits = {"low": "low_warning", "high": "high_warning", "lolo": "low_alarm", "hihi": "high_alarm", "hysteresis": "hysteresis"}
    return updates.withColumn("u", F.from_json("data", UPDATE)).select(
        "pv_name", kind.alias("data_type"), scalar.alias("scalar_type"), size.alias("array_size"), description.alias("description"),
        F.coalesce(F.when(shown, u("display.units")).when(of("continuum"), F.get(u("units"), 0)), F.lit("")).alias("units"), F.coalesce(F.when(shown, u("display.precision")), F.lit(0)).alias("precision"),
        F.when(shown, u("display.form")).alias("display_form"), zero(shown, "display.limit_low").alias("display_low"), zero(shown, "display.limit_high").alias("display_high"),
        zero(plain, "control.limit_low").alias("control_low"), zero(plain, "control.limit_high").alias("control_high"), zero(plain, "control.min_step").alias("min_step"),
        *(zero(plain, f"value_alarm.{f}").alias(f"alarm_{k}") for k, f in limits.items()),
        F.coalesce(F.when(of("enum"), u("choices")), F.array().cast("array<string>")).alias("enum_choices"), F.coalesce(dims, F.array().cast("array<struct<size: int, full_size: int>>")).alias("dimensions"),
    )
