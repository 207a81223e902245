"""What the two classifiers share: sparse word features of whole texts, counted in tasks, and small numpy fits on bounded samples."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pvspark.llm import text as tx

BUCKETS = 1 << 20


def held_out(parts: int, rest: int):
    """Whether crc32 of the id as text leaves `rest` when divided by `parts`; a null id is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % parts == rest, F.lit(False))


def word_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The distinct word buckets of each row and their rows."""
    h, rows = tx.words(column, tx.ALNUM)
    both = np.unique((rows.astype(np.int64) << 20) | (h >> np.uint64(44)).astype(np.int64))
    return both & (BUCKETS - 1), both >> 20


def sample(docs: DataFrame, labels: DataFrame, label: str, parts: int, rest: int, rows: int) -> DataFrame:
    """About `rows` labelled documents outside the held-out part (doc_id, text, label), chosen by a hash of their ids; the labels that are taken are at
    most twice as many."""
    train = labels.where(~held_out(parts, rest)).where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("int").alias("label"))
    key, step = F.xxhash64("doc_id"), max(1, train.count() // rows)
    some = train.where(F.pmod(key, F.lit(step)) == 0).orderBy(key, "label").limit(2 * rows)
    return docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")  # at most 2 * rows rows of ids and labels


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def adam(gradient: Callable[[np.ndarray], np.ndarray], w: np.ndarray, steps: int, rate: float) -> np.ndarray:
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w


def scored(docs: DataFrame, score: Callable[[pa.Array], np.ndarray]) -> DataFrame:
    """docs with doc_id and score, a function of the texts alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tx.chunks(batch):
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(score(part.column("text")), pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(tx.tidy(run), "doc_id long, score double")


def filtered(docs: DataFrame, keep: Callable[[pa.Array], np.ndarray]) -> DataFrame:
    """The rows of docs that `keep` is true for, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tx.chunks(batch):
                yield part.filter(pa.array(keep(part.column("text"))))

    return docs.mapInArrow(tx.tidy(run), docs.schema)


def mapped(frame: DataFrame, of: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """What `of` makes of frame, a chunk at a time, in tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tx.chunks(batch):
                yield of(part)

    return frame.mapInArrow(tx.tidy(run), schema)


def at_most(frame: DataFrame, rows: int) -> pd.DataFrame:
    """Rows of small features at the driver: all, or `rows` of them by the order of their column `key`, when ids or texts that repeat make them more.
    Each task keeps no more than `rows`, and no task gets the texts of others."""
    return frame.orderBy("key").limit(rows).drop("key").toArrow().to_pandas()
