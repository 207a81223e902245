"""What a row takes from the rows before or after it of its key, where one key may hold most rows.

A window over a key sorts all its rows in one task. That is what is done where the largest key, which is counted first, has no more rows than one task takes. Beyond that, the rows are sorted by
key and order in ranges of about equal size, which cut large keys; each range is scanned by itself, and what goes over its borders follows from one summary row for each range and key.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pvspark.sources.tables import folder


#: Rows of a key that one task sorts.
LARGEST = 2_000_000


def scanned(
    rows: DataFrame, key: str, order: list[str], *, filled: Iterable[str] = (), before: Mapping[str, str] | None = None, after: Mapping[str, str] | None = None,
    coming: Mapping[str, str] | None = None, number: str | None = None, ranges: int | None = None,
) -> DataFrame:
    """rows with more columns, by the order of each key's rows (nulls first; ties in any order, but the same for all columns).

    filled: columns whose nulls become the last value before them. before, after: a new name to the column that the row before or after has; null without one.
    coming: a new name to a column's next value after the row that is not null. number: the row's place in its key, from 0. ranges: so many ranges, whatever
    the keys' sizes; if none are given, keys of more than LARGEST rows are cut in ranges by size.

    The rows of ranges are stored, so that all steps see one order. A key's summaries, as many as its ranges, are then the most that one task takes of a key.
    """
    before, after, coming, filled = dict(before or {}), dict(after or {}), dict(coming or {}), list(filled)
    if ranges is None and (rows.groupBy(key).count().agg(F.max("count")).first()[0] or 0) <= LARGEST:
        w = Window.partitionBy(key).orderBy(*(F.col(c).asc_nulls_first() for c in order))
        out = {n: F.lag(c).over(w) for n, c in before.items()} | {n: F.lead(c).over(w) for n, c in after.items()}
        out |= {n: F.first(c, True).over(w.rowsBetween(1, Window.unboundedFollowing)) for n, c in coming.items()}
        out |= {number: (F.row_number().over(w) - 1).cast("long")} if number else {}
        out |= {c: F.last(c, True).over(w.rowsBetween(Window.unboundedPreceding, 0)) for c in filled}
        return rows.select(*(F.col(c) for c in rows.columns if c not in out), *(v.alias(n) for n, v in out.items()))
    spark, path = rows.sparkSession, folder(rows.sparkSession)
    ends = [F.col(c).asc_nulls_first() for c in (key, *order)]
    ranged = rows.repartitionByRange(ranges, *ends) if ranges else rows.repartitionByRange(*ends)
    ranged.sortWithinPartitions(*ends).withColumn("__at", F.monotonically_increasing_id()).write.parquet(path)
    part = spark.read.parquet(path).withColumn("__range", F.shiftright("__at", 33))

    at, known = F.col("__at"), lambda c: F.when(F.col(c).isNotNull(), F.col("__at"))
    summary = part.groupBy("__range", key).agg(
        F.count("*").alias("__rows"), *(F.max_by(c, known(c)).alias(f"__filled_{c}") for c in filled), *(F.max_by(c, at).alias(f"__before_{n}") for n, c in before.items()),
        *(F.min_by(c, at).alias(f"__after_{n}") for n, c in after.items()), *(F.min_by(c, known(c)).alias(f"__coming_{n}") for n, c in coming.items()),
    )
    of_key = Window.partitionBy(key).orderBy("__range")
    past, future = of_key.rowsBetween(Window.unboundedPreceding, -1), of_key.rowsBetween(1, Window.unboundedFollowing)
    carry = summary.select(
        F.col("__range").alias("__owner_range"), F.col(key).alias("__owner_key"), F.coalesce(F.sum("__rows").over(past), F.lit(0)).alias("__rows"), *(F.last(f"__filled_{c}", True).over(past).alias(f"__filled_{c}") for c in filled),
        *(F.lag(f"__before_{n}").over(of_key).alias(f"__before_{n}") for n in before), *(F.lead(f"__after_{n}").over(of_key).alias(f"__after_{n}") for n in after), *(F.first(f"__coming_{n}", True).over(future).alias(f"__coming_{n}") for n in coming),
    )

    own = Window.partitionBy("__range", key).orderBy("__at")
    so_far, later = own.rowsBetween(Window.unboundedPreceding, 0), own.rowsBetween(1, Window.unboundedFollowing)
    first, last = F.row_number().over(own) == 1, F.lead("__at").over(own).isNull()
    out = {n: F.when(first, F.col(f"__before_{n}")).otherwise(F.lag(c).over(own)) for n, c in before.items()}
    out |= {n: F.when(last, F.col(f"__after_{n}")).otherwise(F.lead(c).over(own)) for n, c in after.items()}
    out |= {n: F.coalesce(F.first(c, True).over(later), F.col(f"__coming_{n}")) for n, c in coming.items()}
    out |= {number: F.row_number().over(own) - 1 + F.col("__rows")} if number else {}
    out |= {c: F.coalesce(F.last(c, True).over(so_far), F.col(f"__filled_{c}")) for c in filled}
    joined = part.join(carry, (F.col("__range") == F.col("__owner_range")) & F.col(key).eqNullSafe(F.col("__owner_key")))
    return joined.select(*(F.col(c) for c in rows.columns if c not in out), *(v.alias(n) for n, v in out.items()))
