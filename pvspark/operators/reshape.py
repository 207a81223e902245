"""Payloads to rows and back, as generators inside the scan's stage: nothing here shuffles but the inverse, `rebuilt`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pvspark.functions import columns as C
from pvspark.operators.segments import scanned

# The target table of each payload kind.
TARGETS = {
    "scalar": "samples", "enum": "samples", "aggregate": "samples", "string": "samples_string", "scalar_array": "samples_array_num", "matrix": "samples_array_num",
    "string_array": "samples_array_str", "histogram": "samples_hist", "continuum": "samples_cont", "name_value": "samples_nv", "multi_channel": "samples_mch",
    "table": "samples_table", "nd_array": "samples_image", "union": "samples_custom", "custom": "samples_custom",
}


def target(kind: Column) -> Column:
    """The table that takes a payload kind; free-form data for unknown ones."""
    return F.coalesce(F.create_map(*(F.lit(x) for pair in TARGETS.items() for x in pair))[kind], F.lit("samples_custom"))


def zipped(rows: DataFrame, arrays: dict[str, str], keep: list[str], padded: dict[str, tuple[str, object]] | None = None) -> DataFrame:
    """One row for each place of the shorter of the arrays (a new name to the array's column), with its 0-based idx. Null arrays give no rows.

    padded: more arrays that don't count for the length, each with the value that stands for what it lacks."""
    padded = padded or {}
    n = F.least(*(F.coalesce(F.size(c), F.lit(0)) for c in arrays.values())) if len(arrays) > 1 else F.coalesce(F.size(next(iter(arrays.values()))), F.lit(0))
    struct = lambda i: F.struct(i.alias("idx"), *(F.get(c, i).alias(name) for name, c in arrays.items()), *(F.coalesce(F.get(c, i), F.lit(v)).alias(name) for name, (c, v) in padded.items()))
    places = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), struct))
    return rows.select(*keep, F.inline(places))


def exploded(rows: DataFrame, column: str, keep: list[str]) -> DataFrame:
    return zipped(rows, {"value": column}, keep)


def rebuilt(elements: DataFrame, keys: list[str]) -> DataFrame:
    """The array of each key from its element rows (idx, value), by idx."""
    sorted_ = F.array_sort(F.collect_list(F.struct("idx", "value")))
    return elements.groupBy(*keys).agg(F.transform(sorted_, lambda x: x["value"]).alias("value"))


def capture_ids(rows: DataFrame) -> DataFrame:
    """A reproducible id for each capture, from its signal and time."""
    return rows.withColumn("capture_id", F.xxhash64("pv_id", "time"))


def routed(updates: DataFrame) -> DataFrame:
    """Updates (nt_type, ...) with the table that takes them."""
    return updates.withColumn("target", target(F.col("nt_type")))


def unpacked_aggregate(rows: DataFrame) -> DataFrame:
    """The stored value of an aggregate payload, its mean, beside the parts that the samples table does not keep."""
    return rows.select("*", F.col("payload.mean").alias("value"), *(F.col(f"payload.{f}").alias(f) for f in ("n", "dispersion", "first", "last", "min", "max")))


def histogram_stats(bins: DataFrame, keys: list[str]) -> DataFrame:
    return bins.groupBy(*keys).agg(F.sum("count").alias("total"), F.max("count").alias("max_bin"), F.count("*").alias("bins"))


def carried_forward(updates: DataFrame, fields: list[str], fill: str = "last") -> DataFrame:
    """Sparse updates (pv_id, time, tiebreak, fields) with each unchanged, null field set to its last known value, or to 0 with fill='zero'."""
    if fill == "zero":
        return updates.fillna(0, fields)
    return scanned(updates, "pv_id", ["time", "tiebreak"], filled=fields)


def image_geometry(dims: Column) -> Column:
    """STRUCT<roi, binned, extents>: whether any axis has an offset or a size other than its full one, or a binning, and size times binning."""
    return F.struct(
        F.exists(dims, lambda d: (d["offset"] != 0) | (d["size"] * d["binning"] != d["full_size"])).alias("roi"), F.exists(dims, lambda d: d["binning"] > 1).alias("binned"),
        F.transform(dims, lambda d: d["size"] * d["binning"]).alias("extents"),
    )


def change_points(samples: DataFrame) -> DataFrame:
    """Samples that differ from the one before, with the reason: 2 first, 5 severity, 0 value."""
    rows = scanned(samples, "pv_id", ["time", "tiebreak"], before={"_v": "value", "_s": "severity"}, number="_n")
    reason = F.when(F.col("_n") == 0, 2).when(~F.col("severity").eqNullSafe(F.col("_s")), 5).when(~F.col("value").eqNullSafe(F.col("_v")), 0)
    return rows.withColumn("reason", reason.cast("smallint")).where("reason is not null").drop("_v", "_s", "_n")


def array_change_points(captures: DataFrame, least: float = 0.0) -> DataFrame:
    """Captures (pv_id, time, tiebreak, value array) that differ from the one before: reason 2 for the first, 6 where the length differs or the distance is
    more than `least`. A null array differs from any other."""
    rows = scanned(captures, "pv_id", ["time", "tiebreak"], before={"_v": "value"}, number="_n")
    far = F.coalesce(C.array_l2(F.col("value"), F.col("_v")) > least, ~(F.col("value").isNull() & F.col("_v").isNull()))
    return rows.withColumn("reason", F.when(F.col("_n") == 0, 2).when(far, 6).cast("smallint")).where("reason is not null").drop("_v", "_n")


def all_captures(tables: dict[str, DataFrame]) -> DataFrame:
    """The sample tables in one shape: kind, time, pv_id, severity, status."""
    out = None
    for kind, df in tables.items():
        part = df.select(F.lit(kind).alias("kind"), "time", "pv_id", *(F.col(c) if c in df.columns else F.lit(0).cast("smallint").alias(c) for c in ("severity", "status")))
        out = part if out is None else out.unionByName(part)
    return out


__all__ = ["TARGETS", "all_captures", "array_change_points", "capture_ids", "carried_forward", "change_points", "exploded", "histogram_stats", "image_geometry", "rebuilt", "routed", "target", "unpacked_aggregate", "zipped"]
