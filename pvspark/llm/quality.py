"""Quality by positive-unlabelled learning.

Trusted positives are documents labelled as good; every other text of the training part is unlabelled web text, whatever its label. The share of
good documents among the unlabelled is estimated (best bin: the least ratio of unlabelled to positive texts above a score), and a logistic model
over shape features minimises the non-negative unbiased risk: the negatives' part of the risk, taken as unlabelled minus prior times positives,
is not allowed below zero.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pvspark.llm import text as tx
from pvspark.llm.classifiers import adam, at_most, held_out, mapped, sample, scored, sigmoid

PARTS, HELD_OUT = 5, 0
THRESHOLD = 0.3
#: About how many positives and unlabelled texts the fit sees; at most twice as many.
POSITIVES, UNLABELLED = 6000, 12_000

_KINDS = {
    "upper": [(65, 91)], "lower": [(97, 123)], "digit": [(48, 58)], "space": [(32, 33)], "line": [(10, 11)], "stop": [(46, 47)], "comma": [(44, 45)],
    "bang": [(33, 34), (63, 64)], "symbol": [(35, 39), (42, 44), (60, 63), (64, 65), (92, 93), (94, 95), (124, 127)], "mark": [(39, 42), (45, 46), (47, 48), (58, 60), (91, 97), (123, 124)], "wide": [(128, 256)],
}
_CLASS = np.zeros(256, np.int64)
for _k, _ranges in enumerate(_KINDS.values()):
    for _a, _b in _ranges:
        _CLASS[_a:_b] = _k + 1
NAMES = ("bias", *_KINDS, "other", "words", "word_length", "distinct_words", "distinct_pairs", "distinct_lines", "commonest_word", "long_words", "sentence")


def features(column: pa.Array) -> np.ndarray:
    """Shape features of each text: shares of kinds of characters, repetition of words, word pairs and lines, and lengths. An empty text has zeros."""
    data, offsets = tx.flat(column)
    n, size = len(column), np.diff(offsets).astype(float)
    row = np.repeat(np.arange(n), np.diff(offsets))
    kinds = len(_KINDS) + 1
    share = np.bincount(row * kinds + _CLASS[data], minlength=n * kinds).reshape(n, kinds) / np.maximum(size, 1)[:, None]
    low = tx.LOWER[data]
    starts, ends, of = tx.spans(low, offsets, tx.ALNUM)
    h = tx.hashes(low, starts, ends)
    words = np.bincount(of, minlength=n)
    safe = np.maximum(words, 1)

    def distinct(keys, rows, total):
        order = np.lexsort((keys, rows))
        k, r = keys[order], rows[order]
        new = np.r_[np.ones(min(1, len(k)), bool), (k[1:] != k[:-1]) | (r[1:] != r[:-1])]
        most = np.zeros(n)
        if len(k):
            at = np.flatnonzero(new)
            np.maximum.at(most, r[at], np.diff(np.r_[at, len(k)]))
        return np.bincount(r[new], minlength=n) / np.maximum(total, 1), most / np.maximum(total, 1)

    d, most = distinct(h, of, words)
    with np.errstate(over="ignore"):
        same = of[1:] == of[:-1]
        pairs = tx.mix(h[:-1] * np.uint64(3) + h[1:])[same] if len(h) else h
    d2, _ = distinct(pairs, of[1:][same] if len(h) else of, words - 1)
    line = np.ones(256, bool)
    line[10] = False
    a, b, lof = tx.spans(low, offsets, line)
    lines = np.bincount(lof, minlength=n)
    d3, _ = distinct(tx.hashes(low, a, b), lof, lines)
    length = np.bincount(of, weights=ends - starts, minlength=n) / safe
    longest = np.bincount(of, weights=(ends - starts) > 12, minlength=n) / safe
    sentence = np.log1p(words / np.maximum(1, np.bincount(row[(data == 46) | (data == 33)], minlength=n)))
    x = np.column_stack([np.ones(n), *share[:, 1:].T, share[:, 0], np.log1p(words), length, d, d2, d3, most, longest, sentence])
    x[size == 0, 1:] = 0
    return x


class Model:
    """Standardised features, their squares, and their cuts at the ends."""

    def __init__(self, x: np.ndarray):
        self.mean, self.std = x.mean(axis=0), x.std(axis=0) + 1e-6
        self.mean[0], self.std[0] = 0, 1

    def inputs(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.std, -5, 5)
        return np.hstack([z, z[:, 1:] ** 2 / 5])

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self.inputs(x) @ self.w


def prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of positives among the unlabelled, from scores that rise with positives: the least upper bound over all score levels."""
    levels = np.quantile(positive, np.linspace(0.0, 0.95, 96))
    p = (positive[None, :] >= levels[:, None]).mean(axis=1)
    u = (unlabelled[None, :] >= levels[:, None]).mean(axis=1)
    margin = np.sqrt(1 / max(1, len(positive))) + np.sqrt(1 / max(1, len(unlabelled)))
    return float(np.clip(np.min((u + margin / 2) / np.maximum(p - margin / 2, 1e-3)), 0.02, 0.98))


def fit(positive: np.ndarray, unlabelled: np.ndarray, steps: int = 400) -> Model:
    """The model of least non-negative risk; without positives or unlabelled texts every score is a half."""
    model = Model(np.vstack([positive, unlabelled]) if len(positive) + len(unlabelled) else np.zeros((1, len(NAMES))))
    model.w, model.prior = np.zeros(2 * len(NAMES) - 1), 0.5
    if not len(positive) or not len(unlabelled):
        return model
    p, u = model.inputs(positive), model.inputs(unlabelled)

    def plain(w):
        a, b = sigmoid(p @ w), sigmoid(u @ w)
        return -(1 - a) @ p / len(p) + b @ u / len(u) + 1e-3 * w

    rough = adam(plain, model.w, 200, 0.05)
    model.prior = prior(p @ rough, u @ rough)

    def risk(w):
        a, b = sigmoid(p @ w), sigmoid(u @ w)
        loss_neg = lambda s: -np.log(np.maximum(1 - s, 1e-9))
        negative = loss_neg(b).mean() - model.prior * loss_neg(a).mean()
        g_pos = -model.prior * (1 - a) @ p / len(p)
        g_neg = b @ u / len(u) - model.prior * a @ p / len(p)
        return (g_pos + g_neg if negative >= 0 else -g_neg) + 1e-4 * w

    model.w = adam(risk, rough, steps, 0.03)
    return model


def trained(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model:
    """The model of positives (labels.quality = 1) and unlabelled texts outside the held-out part, both chosen by hashes. Features are made in
    tasks; only they, and of either kind at most twice as many rows as stated, come to the driver."""
    key = F.xxhash64("doc_id", "text", F.lit(5)).alias("key")
    shape = lambda part: pa.RecordBatch.from_arrays([part.column("key"), pa.array(list(features(part.column("text"))), pa.list_(pa.float64()))], ["key", "x"])
    matrix = lambda texts, rows: np.array(at_most(mapped(texts.select(key, "text"), shape, "key long, x array<double>"), 2 * rows)["x"].tolist()).reshape(-1, len(NAMES))
    good = matrix(sample(docs, labels.where("quality = 1"), "quality", PARTS, HELD_OUT, positives), positives)
    train = docs.where(~held_out(PARTS, HELD_OUT))
    step = max(1, train.count() // unlabelled)
    web = matrix(train.where(F.pmod(key, F.lit(step)) == 0).select("doc_id", "text"), unlabelled)
    return fit(good, web)


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, held_out, score (0 to 1), predicted (1 if the score is at least 0.3). Null and empty
    texts are scored by their zero features; null ids and repeated rows stay."""
    model = trained(docs, labels)
    out = scored(docs, lambda column: sigmoid(model.logit(features(column))))
    return out.select("doc_id", held_out(PARTS, HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op10_quality(spark, sf_dir: str) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    return quality(read("documents"), read("labels"))
