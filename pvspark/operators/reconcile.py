"""Differences of configuration snapshots, and the actions that follow."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIELDS = ("description", "unit", "heartbeat_s", "expected_ioc")


def diff(before: DataFrame, after: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """pv_name and change (added, removed, modified) between the enabled rows of two snapshots; null-safe in every field."""
    one = lambda df, p: df.where("enabled").select("pv_name", F.struct(*(F.col(f) for f in fields)).alias(p))
    both = one(before, "b").join(one(after, "a"), "pv_name", "full_outer")
    change = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed").when(~F.col("a").eqNullSafe(F.col("b")), "modified")
    return both.select("pv_name", change.alias("change")).where("change is not null")


def polled(before: DataFrame, after: DataFrame, since: datetime, resolution: DataFrame) -> DataFrame:
    """The actions of one cycle: none for what did not change since the last poll. When anything did, all enabled rows are compared, so that names which are
    gone or disabled are found as well; names without a device from earlier cycles (state lost or not_found) are resolved again in every cycle."""
    fresh = after.where(F.col("updated_at") > F.lit(since)).limit(1).select(F.lit(True).alias("_fresh"))
    differences = diff(before, after).join(F.broadcast(fresh), F.lit(True), "left_semi")
    pending = resolution.where(F.col("state").isin("lost", "not_found")).join(after.where("enabled"), "pv_name", "left_semi")
    retry = pending.join(differences, "pv_name", "left_anti").select("pv_name", F.lit("pending").alias("change"), F.lit("resolve").alias("action"), F.lit(None).cast("string").alias("alert"))
    return actions(differences, resolution).unionByName(retry)


def added(before: DataFrame, after: DataFrame, key: str = "pv_name") -> DataFrame:
    return after.select(key).join(before.select(key), key, "left_anti")


def kept(before: DataFrame, after: DataFrame, key: str = "pv_name") -> DataFrame:
    return after.select(key).join(before.select(key), key, "left_semi")


def changes(payloads: DataFrame) -> DataFrame:
    """Notices 'add:a,b' or 'del:x' as rows (op, pv_name); empty names and other notices go."""
    op = F.substring_index("payload", ":", 1)
    names = F.explode(F.split(F.expr("substr(payload, instr(payload, ':') + 1)"), ","))
    return payloads.where(F.col("payload").contains(":") & op.isin("add", "del")).select(op.alias("op"), names.alias("pv_name")).where("pv_name <> ''")


def actions(differences: DataFrame, resolution: DataFrame) -> DataFrame:
    """What to do about each change: resolve, unsubscribe or update_filter; a warning the first time that a name is not found.

    resolution: pv_name, state (resolved, lost, not_found), warned boolean."""
    rows = differences.join(resolution, "pv_name", "left")
    action = F.when(F.col("change") == "removed", "unsubscribe").when((F.col("change") == "modified") & (F.col("state") == "resolved"), "update_filter").otherwise("resolve")
    alert = F.when((F.col("change") != "removed") & (F.col("state") == "not_found") & ~F.coalesce("warned", F.lit(False)), "warning").when((F.col("change") != "removed") & (F.col("state") == "lost"), "warning")
    return rows.select("pv_name", "change", action.alias("action"), alert.alias("alert"))
