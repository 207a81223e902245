"""What each filter of a chain removes, keeps and repeats, in every order of the filters, by higher-order SQL folds.

Documents are counted by the filters that they fail: a part of the table has at most 2**5 such cells, however many documents it has. Each cell folds
across the array of all orders, a literal that goes with the plan, and gives a struct of counts for every order and step, weighted by the cell's documents;
the cells of a part merge by sums of these structs, element by element.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The filters, in the order of the bits of a mask of failed ones, and all orders of them.
FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
#: Limits of the filters A to C: words, percent of distinct words, percent of capitals.
WORDS, DISTINCT, CAPITALS = 200, 50, 3

SPACE = " \t\n\x0b\f\r"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
STRUCT = f"struct<{','.join(f'{c}:bigint' for c in COUNTS)}>"


def failing(text: Column) -> Column:
    """The mask of those of A to D that a text fails. A null text is empty."""
    text = F.coalesce(text, F.lit(""))
    inner = F.btrim(text, F.lit(SPACE))
    words = F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, "[\\x20\\x09-\\x0D]+"))
    fails = [
        F.size(words) < WORDS,
        F.size(F.array_distinct(words)).cast("long") * 100 < F.size(words).cast("long") * DISTINCT,
        F.regexp_count(text, F.lit("[A-Z]")).cast("long") * 100 > F.char_length(text).cast("long") * CAPITALS,
        text.rlike("[#$%&*|]"),
    ]
    return sum((f.cast("int") * (1 << k) for k, f in enumerate(fails[1:], 1)), fails[0].cast("int"))


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): how many documents of a part fail just the filters of a mask, and how many of those are good or toxic.

    Texts are compared by their SHA-256; a null text is an empty one, a null language the part of the empty one. A document fails E if a smaller id has
    the same text: a row with a null id neither does nor makes others do, and rows of one id don't make each other. Rows are counted by text and id first, then
    by text alone, which partial aggregation shrinks to a row for each task, part and text, so a text that a third of all rows share is not brought to
    one task. A document with several rows of labels is good or toxic if any says so, one without labels neither.
    """
    said = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(c)
    own = labels.groupBy(F.col("doc_id").cast("long").alias("id")).agg(said("quality"), said("toxic"))
    text = F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce("lang", F.lit("")).alias("part"), failing(F.col("text")).alias("mask"), text.alias("text"))
    of_text = ["text", "part", "mask", "quality", "toxic"]
    rows = rows.join(own, "id", "left").fillna(False, ["quality", "toxic"]).groupBy("id", *of_text).agg(F.count("*").alias("n"))
    known = F.when(F.col("id").isNotNull(), F.struct("id", "n"))
    groups = rows.groupBy(of_text).agg(F.sum("n").alias("n"), F.min(known).alias("least"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("unknown"))
    first = F.col("least.id") == F.min("least.id").over(Window.partitionBy("text"))  # a text has as many rows as parts and labels
    firsts = F.col("unknown") + F.when(first, F.col("least.n")).otherwise(0)
    split = F.array(F.struct(F.col("mask"), firsts.alias("n")), F.struct((F.col("mask") + (1 << FILTERS.index("E"))).alias("mask"), (F.col("n") - firsts).alias("n")))
    split = groups.select("part", "quality", "toxic", split.alias("split")).select("part", "quality", "toxic", F.inline("split"))
    lost = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0))
    return split.where("n > 0").groupBy("part", "mask").agg(F.sum("n").alias("n"), lost("quality").alias("good"), lost("toxic").alias("toxic"))


def folded(cell: Column) -> Column:
    """The counts of one cell (mask, n, good, toxic) at every order and step: an array of structs, in the order of ORDERS and steps."""
    orders, bits = F.array(*(F.lit(o) for o in ORDERS)), F.create_map(*(F.lit(x) for k, f in enumerate(FILTERS) for x in (f, 1 << k)))

    def at_step(done: Column, step: Column, order: Column) -> Column:
        """done: the structs of the steps before, and whether one of their filters has removed the cell's documents."""
        bit = F.element_at(bits, F.substring(order, step, F.lit(1)))
        fails, gone = cell["mask"].bitwiseAND(bit) != 0, done["gone"]
        count = lambda when, n="n": F.when(when, cell[n]).otherwise(F.lit(0).cast("long"))
        now = F.struct(
            count(~fails & ~gone).alias("kept"), count(fails & ~gone).alias("removed"), count(fails & gone).alias("redundant"), count(cell["mask"] == bit).alias("unique_fails"),
            count(fails & ~gone, "good").alias("good_lost"), count(fails & ~gone, "toxic").alias("toxic_lost"),
        )
        return F.struct(F.concat(done["steps"], F.array(now)).alias("steps"), (gone | fails).alias("gone"))

    none = F.struct(F.array().cast(f"array<{STRUCT}>").alias("steps"), F.lit(False).alias("gone"))
    return F.flatten(F.transform(orders, lambda o: F.aggregate(F.sequence(F.lit(1), F.lit(len(FILTERS))), none, lambda done, k: at_step(done, k, o), lambda done: done["steps"])))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part, order and step, zeros included; without documents there are no rows. Parts with the same letters in other cases are apart."""
    by_part = cells(docs, labels).groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # 32 at most
    zero = F.transform(F.sequence(F.lit(1), F.lit(len(ORDERS) * len(FILTERS))), lambda _: F.struct(*(F.lit(0).cast("long").alias(c) for c in COUNTS)))
    add = lambda a, b: F.struct(*((a[c] + b[c]).alias(c) for c in COUNTS))
    sums = F.aggregate("cells", zero, lambda done, cell: F.zip_with(done, folded(cell), add))
    rows = by_part.select("part", F.posexplode(sums).alias("at", "c"))
    order = F.element_at(F.array(*(F.lit(o) for o in ORDERS)), F.floor(F.col("at") / len(FILTERS)).cast("int") + 1)
    rows = rows.select("part", order.alias("filter_order"), (F.col("at") % len(FILTERS) + 1).cast("int").alias("step"), "c.*")
    own = Window.partitionBy("part", F.substring("filter_order", F.col("step"), F.lit(1)))
    return rows.withColumn("shapley", F.sum("removed").over(own))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def oracle() -> str:
    return """WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS words FROM documents),
 first AS (SELECT text, min(doc_id) AS least FROM d GROUP BY text),
 own AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
 fails AS (SELECT d.doc_id, part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, [len(words) < 200, 100 * len(list_distinct(words)) < 50 * len(words),
  100 * len(regexp_replace(d.text, '[^A-Z]', '', 'g')) > 3 * len(d.text), regexp_matches(d.text, '[#$%&*|]'), coalesce(d.doc_id > least, false)] AS f
  FROM d JOIN first ON first.text = d.text LEFT JOIN own ON own.doc_id = d.doc_id),
 letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
 orders AS (SELECT a.l || b.l || c.l || d.l || e.l AS o FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
 steps AS (SELECT o, k, ascii(substr(o, k, 1)) - 64 AS own, list_transform(range(1, k), lambda j: ascii(substr(o, j, 1)) - 64) AS earlier FROM orders, (SELECT unnest(range(1, 6)) AS k)),
 cell AS (SELECT part, f, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM fails GROUP BY ALL),
 placed AS (SELECT part, o, k, own, n, good, toxic, f[own] AS bad, len(list_filter(earlier, lambda j: f[j])) > 0 AS gone, len(list_filter(f, lambda x: x)) AS n_bad FROM cell, steps),
 counts AS (SELECT part, o, k, own, coalesce(sum(n) FILTER (NOT bad AND NOT gone), 0) AS kept, coalesce(sum(n) FILTER (bad AND NOT gone), 0) AS removed, coalesce(sum(n) FILTER (bad AND gone), 0) AS redundant,
  coalesce(sum(n) FILTER (bad AND n_bad = 1), 0) AS unique_fails, coalesce(sum(good) FILTER (bad AND NOT gone), 0) AS good_lost, coalesce(sum(toxic) FILTER (bad AND NOT gone), 0) AS toxic_lost FROM placed GROUP BY ALL)
 SELECT part, o AS filter_order, CAST(k AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM counts"""
