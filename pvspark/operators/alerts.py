"""The alert log: reads, counts, and changes that return the new log."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pvspark.sources.tables import numbered


def newest(log: DataFrame, limit: int, where: Column | None = None) -> DataFrame:
    """The newest rows that fulfil a condition, 1 to 10,000 of them; a top-k without a full sort."""
    rows = log if where is None else log.where(where)
    return rows.orderBy(F.desc("time"), F.desc("id")).limit(max(1, min(limit, 10_000)))


def summary(log: DataFrame) -> DataFrame:
    """Open alerts by level, in one row."""
    level = F.col("level")
    out = log.where("not acknowledged").agg(*(F.count_if(level == x).alias(x) for x in ("info", "warning", "critical")), F.count("*").alias("total"))
    return out.withColumns({"has_critical": F.col("critical") > 0, "is_clear": F.col("total") == 0})


def appended(log: DataFrame, new: DataFrame) -> DataFrame:
    """The log with new rows, numbered after its largest id in their order."""
    top = log.agg(F.coalesce(F.max("id"), F.lit(0)).alias("m")).first()["m"]
    return log.unionByName(numbered(new, ["time", "message"], "id").withColumn("id", F.col("id") + top), allowMissingColumns=True)


def acknowledged(log: DataFrame, ids: DataFrame, by: str, now: datetime) -> DataFrame:
    """The log with the open rows of the ids acknowledged; `changed` marks them."""
    rows = log.join(ids.select(F.col("id"), F.lit(True).alias("_hit")).distinct(), "id", "left")
    hit = F.coalesce("_hit", F.lit(False)) & ~F.col("acknowledged")
    return rows.withColumn("changed", hit).withColumns({
        "acknowledged": F.col("acknowledged") | F.col("changed"), "acknowledged_by": F.when(F.col("changed"), by).otherwise(F.col("acknowledged_by")),
        "acknowledged_at": F.when(F.col("changed"), F.lit(now)).otherwise(F.col("acknowledged_at")),
    }).drop("_hit")


def purged(log: DataFrame, cutoff: datetime) -> DataFrame:
    return log.where(F.col("time") >= F.lit(cutoff))
