"""Embedding near-dedup with randomised-rotation binary codes.

A unit vector is rotated at random and kept as its signs plus a correction factor, its inner product with the code, and, for the other side of an
estimate, the rotated vector in steps of a byte. A code's inner product with another vector, divided by the factor, is an unbiased estimate of the
cosine. A pair is dropped when the estimate stays below the threshold by more than its error's confidence bound, or when the bytes' own bound, which
is certain, does. Whole vectors are fetched only for the members of pairs that are left, and decide.

Which vectors meet: signs of sums of the bytes are buckets, of about BUCKET rows however many rows there are; a pair at the threshold shares at least
one of the tables' buckets with the probability RECALL, closer pairs more. Equal vectors are one row with a weight. Large buckets are split into
blocks, and links are counted, not listed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pvspark.llm import text as tx
from pvspark.llm.jaccard_join import dealt, whole
from pvspark.llm.shared import components, dropped, roots, stored

THRESHOLD = 0.93
RECALL = 0.96
#: Rows of a bucket, about, if a table's rows were spread evenly; buckets of more are split into blocks.
BUCKET = 1024
#: Width of the confidence bound in standard deviations of the estimate.
CONFIDENCE = 4.0
#: Pairs of a block that are handled at once.
PAIRS = 1 << 20

_CODES = "label long, k1 long, k2 long, vec_id long, dim int, bytes binary, scale float, error float, factor float"
_MEMBERS = "key long, low int, high int, own int, tab int, id long, k1 long, bytes binary"


def plan(n: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """Bits of a bucket's code, so that buckets keep their size, and how many tables reach the recall for a pair at the threshold."""
    bits = max(4, math.ceil(math.log2(max(n, 2) / BUCKET)))
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log1p(-same))


@cache
def rotation(dim: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(dim).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def buckets(steps: np.ndarray, bits: int, tables: range) -> np.ndarray:
    """The bucket code of each vector in some tables, from its bytes: signs of their sums with random signs. Sums of bytes are exact in any order."""
    out, x = np.empty((len(steps), len(tables)), np.int64), steps.astype(np.float32)
    for k, t in enumerate(tables):
        signs = np.random.default_rng((steps.shape[1], t)).choice(np.array([-1, 1], np.float32), (steps.shape[1], bits))
        out[:, k] = (x @ signs > 0) @ (1 << np.arange(bits))
    return out


def units(vectors) -> np.ndarray:
    """Vectors of length 1; parts are brought near 1 first, so that no square is beyond a double."""
    x = np.asarray(list(vectors), np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def signs(steps: np.ndarray) -> np.ndarray:
    """The binary codes, of length 1."""
    return np.where(steps >= 0, np.float32(1), np.float32(-1)) * np.float32(steps.shape[1] ** -0.5)


def codes(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of unit vectors: the rotated ones in steps of a byte, the length of a step, the distance from the rotated vector, and the correction factor."""
    rotated = unit @ rotation(unit.shape[1])
    scale = (np.abs(rotated).max(axis=1) / 127).astype(np.float32)
    steps = np.rint(rotated / scale[:, None]).astype(np.int8)
    error = np.linalg.norm(rotated - steps * scale[:, None].astype(np.float64), axis=1) + 1e-6
    return steps, scale, error.astype(np.float32), (signs(steps) * rotated).sum(axis=1).astype(np.float32)


def near(steps: np.ndarray, scale: np.ndarray, error: np.ndarray, factor: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float, confidence: float = CONFIDENCE) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of the rows left and right whose cosine may reach the threshold."""
    dim, f = steps.shape[1], np.clip(factor, 1e-3, 1.0)
    full = steps.astype(np.float32) * scale[:, None]
    # a code is its vector times the factor and a random direction across it, of which the other vector has at most sqrt(1 - threshold**2) if it is near
    spread = np.sqrt(1 - f * f) / f * math.sqrt((1 - threshold * threshold) / max(1, dim - 1))
    estimate = (signs(steps[left]) @ full[right].T) / f[left, None]
    estimate += (confidence * spread[left])[:, None] + error[None, right] / f[left, None]
    i, j = np.nonzero(estimate >= threshold)
    i, j = left[i], right[j]
    keep = []
    for a in range(0, len(i), PAIRS):
        p, q = i[a : a + PAIRS], j[a : a + PAIRS]
        keep.append(np.einsum("ij,ij->i", full[p], full[q]) + error[p] + np.float32(1.02) * error[q] >= threshold)
    ok = np.concatenate(keep) if keep else np.zeros(0, bool)
    return i[ok], j[ok]


def first_met(steps: np.ndarray, p: np.ndarray, q: np.ndarray, tab: int, bits: int) -> np.ndarray:
    """Whether pairs share no bucket of the tables before tab: a pair counts in the first table where it meets."""
    new = np.ones(len(p), bool)
    if tab and len(p):
        rows, at = np.unique(np.r_[p, q], return_inverse=True)
        c = buckets(steps[rows], bits, range(tab))
        for k in range(tab):
            new &= c[at[: len(p)], k] != c[at[len(p) :], k]
    return new


def _coded(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for dim, g in frame.groupby(frame["embedding"].map(len)):
            steps, scale, error, factor = codes(units(g["embedding"]))
            yield g[["label", "k1", "k2", "vec_id"]].assign(dim=dim, bytes=[x.tobytes() for x in steps], scale=scale, error=error, factor=factor)


def _entries(bits: int, tables: int, columns: list[str]):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for _, g in frame.groupby("dim"):
                steps = np.frombuffer(b"".join(g["bytes"]), np.int8).reshape(len(g), -1)
                for t in range(tables):
                    yield g.assign(tab=t, code=buckets(steps, bits, range(t, t + 1))[:, 0])[columns]

    return run


def _blocks(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray]]:
    """Each block of a partition that is sorted by key, low and high, with the rows of its two sides (the same, if it is one block)."""
    for frame, cuts in whole(frames, ["key", "low", "high"]):
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if b - a > 1:
                g = frame.iloc[a:b]
                own, low, high = g["own"].to_numpy(), g["low"].iloc[0], g["high"].iloc[0]
                yield g, *((np.arange(b - a),) * 2 if low == high else (np.flatnonzero(own == low), np.flatnonzero(own == high)))


def _candidates(bits: int, threshold: float):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g, left, right in _blocks(frames):
            steps, tab = np.frombuffer(b"".join(g["bytes"]), np.int8).reshape(len(g), -1), int(g["tab"].iloc[0])
            i, j = near(steps, *(g[c].to_numpy(np.float32) for c in ("scale", "error", "factor")), left, right, threshold)
            i, j = (i[i < j], j[i < j]) if left is right else (i, j)
            new = first_met(steps, i, j, tab, bits)
            rows = np.unique(np.r_[i[new], j[new]])
            if len(rows):
                yield g.iloc[rows][["key", "low", "high", "own", "tab", "id", "k1", "bytes"]]

    return run


def _links(bits: int, threshold: float):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g, left, right in _blocks(frames):
            ids, weight, unit = g["id"].to_numpy(), g["weight"].to_numpy(np.int64), units(g["embedding"])
            p, q = np.nonzero(unit[left] @ unit[right].T >= threshold - 1e-9)
            p, q = left[p], right[q]
            p, q = (p[p < q], q[p < q]) if left is right else (p, q)
            ok = np.concatenate([np.zeros(0, bool), *(np.einsum("ij,ij->i", unit[p[a : a + PAIRS]], unit[q[a : a + PAIRS]]) >= threshold for a in range(0, len(p), PAIRS))])
            p, q = p[ok], q[ok]
            new = first_met(np.frombuffer(b"".join(g["bytes"]), np.int8).reshape(len(g), -1), p, q, int(g["tab"].iloc[0]), bits)
            p, q = p[new], q[new]
            if len(p):
                node, at = np.unique(np.r_[p, q], return_inverse=True)
                n = np.bincount(at, weights=weight[np.r_[q, p]]).astype(np.int64)
                reached, least = roots(ids[p], ids[q])
                yield pd.DataFrame({"node": ids[node], "k1": g["k1"].to_numpy()[node], "n": n, "root": least[np.searchsorted(reached, ids[node])]})

    return run


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row of vectors (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Only vectors of one label and one length are compared. Null labels, and vectors that are null, empty, zero or hold null or non-finite
    parts, link with nothing: n_links 0, their own component, kept. Rows that share an id are one node; a null id is not linked.
    """
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("long").alias("label"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    keyed = vectors.withColumn("ok", F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite, F.lit(False)))
    keyed = keyed.withColumn("k1", F.xxhash64("embedding")).withColumn("k2", F.xxhash64("embedding", F.lit(1)))
    key = ["label", "k1", "k2"]
    one = F.first(F.struct("dim", "bytes", "scale", "error", "factor")).alias("c")
    rows = stored(keyed.where("ok").mapInPandas(tx.tidy(_coded), _CODES).groupBy(*key).agg(F.min("vec_id").alias("id"), F.count("*").alias("weight"), one).select(*key, "id", "weight", "c.*"))
    bits, tables = plan(rows.count(), threshold)
    bucket = F.xxhash64("label", "dim", "tab", "code").alias("key")
    light = rows.select("label", "dim", "bytes").mapInPandas(tx.tidy(_entries(bits, tables, ["label", "dim", "tab", "code"])), "label long, dim int, tab int, code long")
    large = stored(light.groupBy(bucket).agg(F.count("*").alias("m")).where(F.col("m") > BUCKET))
    names = ["label", "dim", "tab", "code", "id", "k1", "bytes", "scale", "error", "factor"]
    entries = rows.select(*(c for c in names if c not in ("tab", "code"))).mapInPandas(tx.tidy(_entries(bits, tables, names)), "label long, dim int, tab int, code long, id long, k1 long, bytes binary, scale float, error float, factor float")
    members = entries.select(bucket, "tab", "id", "k1", "bytes", "scale", "error", "factor").join(large, "key", "left").withColumn("m", F.coalesce("m", F.lit(1)))
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    block = ["key", "low", "high"]
    left = stored(dealt(members).repartition(parts, *block).sortWithinPartitions(*block).mapInPandas(tx.tidy(_candidates(bits, threshold)), _MEMBERS))
    # whole vectors, once for each member of a pair that is left
    need = left.select(F.col("id").alias("vec_id"), "k1").distinct()
    exact = keyed.where("ok").join(need, ["vec_id", "k1"]).groupBy(F.col("vec_id").alias("id"), "k1").agg(F.first("embedding").alias("embedding"))
    exact = exact.join(rows.select("id", "k1", "weight"), ["id", "k1"])
    grouped = left.join(exact, ["id", "k1"]).repartition(parts, *block).sortWithinPartitions(*block)
    found = stored(grouped.mapInPandas(tx.tidy(_links(bits, threshold)), "node long, k1 long, n long, root long"))
    for table in (large, left):
        dropped(table)
    counts = found.groupBy(F.col("node").alias("id"), "k1").agg(F.sum("n").alias("n"))
    classes = rows.select(*key, "id", "weight").join(counts, ["id", "k1"], "left").join(components(found).withColumnRenamed("node", "id"), "id", "left")
    classes = classes.select(*key, (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n"), F.coalesce("component", "id").alias("component"))
    out = keyed.select("vec_id", "ok", F.when(F.col("ok"), F.col("label")).alias("label"), "k1", "k2").join(classes, key, "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))


def op4_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
