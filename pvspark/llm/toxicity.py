"""Toxicity by a counterfactually regularised classifier.

A logistic regression over the words of a text. Identity terms in labelled texts are swapped for others of their group, and the squared change
of the logit is penalised: a mention of a group does not raise the score by itself. As texts that mention any group may be few, each labelled text is also learned from with
a mention put into it, of a group and a term that its hash chooses whatever its label, and that term is swapped as well. Words are kept as features where
their share among toxic training texts differs clearly from that among the others; identity terms always are.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pvspark.llm import text as tx
from pvspark.llm.classifiers import adam, at_most, filtered, held_out, mapped, sample, scored, sigmoid, word_sets

PARTS, HELD_OUT = 4, 2
THRESHOLD = 0.3
#: About how many labelled texts the fit sees (at most twice as many), and how many words it keeps besides the identity terms.
SAMPLE, WORDS = 16_000, 1500
COUNTERFACTUAL, RIDGE = 1.0, 2e-4

#: Neutral terms for groups of people; within a line each can stand for another.
IDENTITY = (
    ("woman", "man", "girl", "boy"),
    ("women", "men", "girls", "boys"),
    ("gay", "lesbian", "bisexual", "straight", "transgender", "queer"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "african", "european", "indigenous"),
    ("american", "mexican", "chinese", "indian", "german", "french", "arab"),
    ("young", "old", "elderly"),
    ("disabled", "blind", "deaf"),
    ("immigrant", "immigrants", "refugee", "refugees"),
    ("frau", "mann", "mädchen", "junge"),
    ("schwul", "lesbisch", "hetero", "queer"),
    ("muslime", "christen", "juden", "hindus", "buddhisten", "atheisten"),
    ("deutsche", "türken", "polen", "franzosen", "araber"),
    ("femme", "homme", "fille", "garçon"),
    ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées"),
    ("français", "algériens", "marocains", "allemands", "arabes"),
    ("mujer", "hombre", "niña", "niño"),
    ("musulmanes", "cristianos", "judíos", "hindúes", "budistas", "ateos"),
    ("españoles", "mexicanos", "colombianos", "gitanos", "árabes"),
)


@lru_cache
def identity_buckets() -> tuple[tuple[int, ...], ...]:
    return tuple(tuple(int(word_sets(pa.array([w]))[0][0]) for w in group) for group in IDENTITY)


def swaps(own: np.ndarray) -> list[tuple[int, int]]:
    """The swaps (a term of the text, another of its group) that a text's word buckets allow."""
    held = set(own.tolist())
    return [(a, b) for group in identity_buckets() for a in group if a in held for b in group if b != a]


def mention(key: int) -> tuple[int, int]:
    """The term that is put into a text with this hash, and the one of its group that it is swapped for."""
    groups = identity_buckets()
    key = key & (1 << 63) - 1
    group, key = groups[key % len(groups)], key // len(groups)
    a, b = key % len(group), key // len(group) % (len(group) - 1)
    return group[a], group[b + (b >= a)]


def _words(part: pa.RecordBatch) -> pa.RecordBatch:
    """For each distinct word of a chunk, the texts of either label that have it."""
    buckets, rows = word_sets(part.column("text"))
    label = part.column("label").to_numpy()[rows]
    words, at = np.unique(buckets, return_inverse=True)
    count = [np.bincount(at[label == y], minlength=len(words)) for y in (0, 1)]
    return pa.RecordBatch.from_arrays([pa.array(words, pa.int32()), pa.array(count[0]), pa.array(count[1])], ["word", "negative", "positive"])


def _features(chosen: np.ndarray):
    """Of each text its label, its words among the chosen ones (as their places), the term that is put into it, and the swaps of its identity terms and of that one."""

    def of(part: pa.RecordBatch) -> pa.RecordBatch:
        buckets, rows = word_sets(part.column("text"))
        at = np.minimum(np.searchsorted(chosen, buckets), len(chosen) - 1)
        ok = chosen[at] == buckets
        at, rows = at[ok], rows[ok]
        ends = np.r_[0, np.cumsum(np.bincount(rows, minlength=len(part)))]
        put = [mention(k) for k in part.column("key").to_pylist()]
        pairs = [[*swaps(chosen[at[a:b]]), m] for a, b, m in zip(ends[:-1], ends[1:], put, strict=True)]
        side = lambda k: pa.array([np.searchsorted(chosen, [p[k] for p in own]) for own in pairs], pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays([part.column("key"), part.column("label").cast(pa.int32()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(at, pa.int32())), pa.array(np.searchsorted(chosen, [m[0] for m in put]), pa.int32()), side(0), side(1)], ["key", "label", "words", "put", "swap_out", "swap_in"])

    return of


def selected(counts: DataFrame, negatives: int, positives: int, keep: int = WORDS) -> np.ndarray:
    """The words (buckets, ascending) whose share among positives differs most from that among negatives, `keep` at most, and all identity terms.
    counts: word, negative, positive, the texts that have a word; the choice is made where the counts are."""
    share = positives / max(1, negatives + positives)
    n, expect = F.col("negative") + F.col("positive"), (F.col("negative") + F.col("positive")) * share
    z = F.abs((F.col("positive") - expect) / F.sqrt(expect * (1 - share) + 1e-9))
    found = counts.where((n >= 4) & (z > 3.5)).orderBy(z.desc(), "word").limit(keep).select("word").collect()
    return np.unique(np.r_[np.array([r.word for r in found], np.int64), np.concatenate([np.array(g) for g in identity_buckets()])])


def fit(labels: np.ndarray, words: list[np.ndarray], swapped: np.ndarray, size: int, weight: float = COUNTERFACTUAL) -> tuple[np.ndarray, float]:
    """A weight for each of `size` words and a bias. words: the words of each labelled text; swapped: rows of (out, in), one for each swap of an identity
    term in a labelled text; the mean squared change of the logit by a swap is penalised.
    Without labels of both kinds, the bias alone gives the known share (a half without any)."""
    y = labels.astype(float)
    share = (y.sum() + 1) / (len(y) + 2)
    out, bias = np.zeros(size), float(np.log(share / (1 - share)))
    if not 0 < y.sum() < len(y):
        return out, bias
    col, row = np.concatenate(words).astype(np.int64), np.repeat(np.arange(len(words)), [len(w) for w in words])
    a, b = swapped.astype(np.int64).reshape(-1, 2).T

    def gradient(w):
        p = sigmoid(np.bincount(row, weights=w[col], minlength=len(y)) + w[-1])
        g = np.bincount(col, weights=(p - y)[row], minlength=len(w)) / len(y)
        g[-1] += (p - y).mean()
        g[:-1] += RIDGE * w[:-1]
        change = 2 * weight * (w[b] - w[a]) / max(1, len(a))  # of the mean squared change of the logit
        return g + np.bincount(b, weights=change, minlength=len(w)) - np.bincount(a, weights=change, minlength=len(w))

    w = adam(gradient, np.r_[out, bias], 400, 0.05)
    return w[:-1], float(w[-1])


def trained(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE, weight: float = COUNTERFACTUAL):
    """A function of texts that gives scores, learned from labelled documents outside the held-out part (labels: doc_id, toxic). Words are counted and
    chosen by tasks; to the driver come the chosen ones, and for 2 * rows texts at most their places in that list."""
    some = sample(docs, labels, "toxic", PARTS, HELD_OUT, rows).select(F.xxhash64("doc_id", "text").alias("key"), "text", "label")
    counts = mapped(some, _words, "word int, negative long, positive long").groupBy("word").agg(F.sum("negative").alias("negative"), F.sum("positive").alias("positive"))
    total = some.agg(F.count_if(F.col("label") != 1).alias("negative"), F.count_if(F.col("label") == 1).alias("positive")).first()
    chosen = selected(counts, total.negative, total.positive)
    found = at_most(mapped(some, _features(chosen), "key long, label int, words array<int>, put int, swap_out array<int>, swap_in array<int>"), 2 * rows)
    pair = lambda c: np.concatenate([np.zeros(0, np.int64), *(np.asarray(x, np.int64) for x in found[c])])
    words = [*found["words"], *(np.r_[np.asarray(w, np.int64), p] for w, p in zip(found["words"], found["put"], strict=True))]  # without and with the mention
    values, bias = fit(np.tile(found["label"].to_numpy(), 2), words, np.stack([pair("swap_out"), pair("swap_in")], 1), len(chosen), weight)

    def score(column: pa.Array) -> np.ndarray:
        buckets, of = word_sets(column)
        at = np.minimum(np.searchsorted(chosen, buckets), len(chosen) - 1)
        ok = chosen[at] == buckets
        return sigmoid(np.bincount(of[ok], weights=values[at[ok]], minlength=len(column)) + bias)

    return score


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, held_out, score (0 to 1), predicted (1 if the score is at least 0.3). A null or empty
    text scores what the bias gives; null ids and repeated rows stay; without labels every score is a half."""
    out = scored(docs, trained(docs, labels))
    return out.select("doc_id", held_out(PARTS, HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not predicted to be toxic, with all their columns."""
    score = trained(docs, labels)
    return filtered(docs, lambda column: score(column) < THRESHOLD)


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    return toxicity(read("documents"), read("labels"))
