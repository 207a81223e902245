"""What the operators share: tables in the shared folder, and connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pvspark.llm import text as tx


#: Rows of a batch that goes to Python.
BATCH_ROWS = 1000
#: Stored tables that are still there.
_kept: list[tuple[SparkSession, str]] = []


def folder(spark: SparkSession) -> str:
    """A new path in spark.checkpoint.dir. Where that is unset, as in tests, a temporary folder; not on a cluster, whose machines would each have their own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        base = f"file://{tempfile.mkdtemp(prefix='pvspark-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Fewer rows in the batches between the JVM and Python while a table is written, so that long texts take little memory on both sides."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(int(before), BATCH_ROWS) if int(before) > 0 else BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def stored(df: DataFrame) -> DataFrame:
    """The rows of df, written as Parquet in the shared folder and read again: later jobs start there, also when executors are lost."""
    spark, path = df.sparkSession, folder(df.sparkSession)
    with small_batches(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_path = path
    _kept.append((spark, path))
    return out


def mark() -> int:
    """A place in the order of stored tables, for released()."""
    return len(_kept)


def released(since: int = 0, but: DataFrame | None = None) -> None:
    """Remove the files of all tables stored since a mark(), but those of one table. To be called when what was made from them is written: results
    read their stored tables when an action runs."""
    keep = [x for x in _kept[since:] if but is not None and x[1] == but._stored_path]
    for spark, path in _kept[since:]:
        if all(path != x[1] for x in keep):
            _delete(spark, path)
    _kept[since:] = keep


def dropped(df: DataFrame) -> None:
    """Remove the files of a stored table that no later step reads."""
    _delete(df.sparkSession, df._stored_path)
    _kept[:] = [x for x in _kept if x[1] != df._stored_path]


def _delete(spark: SparkSession, path: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def roots(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges left-right, and the smallest node that each one reaches."""
    nodes, at = np.unique(np.concatenate([left, right]), return_inverse=True)
    a, b = at[: len(left)], at[len(left) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while not np.array_equal(jumped := new[new], new):
            new = jumped
        if np.array_equal(new, label):
            return nodes, nodes[label]
        label = new


def _forest(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    edges = pd.concat([pd.DataFrame({"node": np.zeros(0, np.int64), "root": np.zeros(0, np.int64)}), *parts])
    nodes, least = roots(edges["node"].to_numpy(np.int64), edges["root"].to_numpy(np.int64))
    keep = nodes != least
    yield pd.DataFrame({"node": nodes[keep], "root": least[keep]})


def components(edges: DataFrame) -> DataFrame:
    """(node long, component long) for all nodes of edges (node long, root long); component: the smallest node that is reachable.

    Each round merges the edges of a node inside its partition, then replaces every root by that root's own root. Tables in the shared folder
    cut the lineage. A root with a third of all nodes is the key of a join whose other side has one row for it, which AQE splits.
    Loops and repeated edges count once; without edges there are no rows.
    """
    n = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    e = edges.where("node <> root").select(F.greatest("node", "root").alias("node"), F.least("node", "root").alias("root"))
    e = stored(e.mapInPandas(tx.tidy(_forest), "node long, root long"))
    while True:
        merged = stored(e.repartition(n, "node").mapInPandas(tx.tidy(_forest), "node long, root long"))
        dropped(e)
        up = merged.select(F.col("node").alias("root"), F.col("root").alias("above"))
        e = stored(merged.join(up, "root", "left").select("node", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")))
        rows, nodes, moved = e.agg(F.count("*"), F.countDistinct("node"), F.count_if("moved")).first()
        dropped(merged)
        if rows == nodes and not moved:  # each node has one root, and no root has one
            return e.select("node", F.col("root").alias("component")).union(e.select("root", "root").distinct())
