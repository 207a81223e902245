"""Language-model scores of whole texts.

The model is causal self-attention over subword ids, in numpy (see attention.py); all probabilities come from it. Every window of the training texts
is learned from once, in one of ROUNDS rounds that a hash of its text, id and place gives it, so nothing depends on how the input is split and copies of
a text are spread. The windows of a round are dealt to shards of about SHARD windows; each is trained on from the same weights, and the results are
averaged.

The base score is a unigram model over words. Counts of words are a table; the most frequent ones (FREQUENT at most) go to every task, and what a
text has besides is joined with the table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pvspark.llm import attention as at
from pvspark.llm import text as tx
from pvspark.llm.classifiers import held_out
from pvspark.llm.encoding import encode
from pvspark.llm.shared import stored

PARTS, HELD_OUT = 5, 1
#: One window in SHARE is learned from in each of ROUNDS rounds (other ones each time, so all of them in the end), about SHARD windows together.
SHARE, ROUNDS, SHARD, RATE = 2, 2, 1 << 17, 0.02
#: Words whose counts every task holds (4 MB); frequencies are cut at a step of 2**(1/STEPS), so all words of one step are in or out.
FREQUENT, STEPS = 1 << 18, 8
#: Distinct words that a task holds before it sends their counts, and rows of a batch that it sends.
HELD, SENT = 1 << 20, 1 << 16
#: Weights of a shard that go to their means as one row.
PIECE = 1 << 12
#: Bytes of text, or of ids, that are handled at once.
ENCODED = 1 << 20

_ROWS = "row bigint, doc_id bigint, held boolean, n_tokens bigint, known bigint, base double"
_KEPT = "key bigint, ids binary"


class Table:
    """Values of 64-bit keys; looked up by their last bits, and by order where those are taken."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.mask = np.uint64((1 << max(4, int(len(keys) * 4).bit_length())) - 1)
        self.slot = np.full(int(self.mask) + 1, -1, np.int32)
        self.slot[(keys & self.mask).astype(np.int64)] = np.arange(len(keys))
        self.keys, self.values = keys, values
        left = np.flatnonzero(self.slot[(keys & self.mask).astype(np.int64)] != np.arange(len(keys)))
        self.left = left[np.argsort(keys[left])]

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which keys are there, and their values."""
        k = self.slot[(keys & self.mask).astype(np.int64)].astype(np.int64)
        hit = (k >= 0) & (self.keys[k] == keys) if len(self.keys) else np.zeros(len(keys), bool)
        if len(self.left):
            rest = np.flatnonzero(~hit)
            other = self.left[np.minimum(np.searchsorted(self.keys[self.left], keys[rest]), len(self.left) - 1)]
            ok = self.keys[other] == keys[rest]
            k[rest[ok]], hit[rest[ok]] = other[ok], True
        return hit, self.values[k[hit]]


def targets(column: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts, each followed by EDGE, and their numbers."""
    ids, n = encode(column, path)
    return np.insert(ids, np.cumsum(n), at.EDGE), n + 1


def _level():
    return F.floor(F.log2("n") * STEPS)


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): how often each word (its hash) occurs in the training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> Iterator[pa.RecordBatch]:
            words, of = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True)
            n = np.bincount(of, weights=np.concatenate([x for _, x in held]), minlength=len(words)).astype(np.int64)
            held.clear()
            for a in range(0, len(words), SENT):
                yield pa.RecordBatch.from_arrays([pa.array(words[a : a + SENT].view(np.int64)), pa.array(n[a : a + SENT])], ["word", "n"])

        for batch in batches:
            for part in tx.chunks(batch):
                held.append(np.unique(tx.words(part.column("text"), tx.NOT_SPACE)[0], return_counts=True))
                if sum(len(x) for x, _ in held) > HELD:
                    yield from merged()
        if held:
            yield from merged()

    texts = docs.where(~held_out(PARTS, HELD_OUT)).select("text")
    return stored(texts.mapInArrow(tx.tidy(run), "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n")))


def _bytes(ids: np.ndarray, n: np.ndarray) -> pa.Array:
    """Ids as bytes, two each, of texts with n ids."""
    ends = np.r_[0, 2 * np.cumsum(n)].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends), pa.py_buffer(ids.astype("<u2"))])


def _ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ids of all texts, how many each has, and a hash of each."""
    column = column.cast(pa.large_binary())
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data, ends = np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]], ends - ends[0]
    return data.view("<u2").astype(np.int64), np.diff(ends) // 2, tx.hashes(data, ends[:-1], ends[1:])


def encoded(docs: DataFrame, frequent: pa.Table, path: str) -> DataFrame:
    """Of each text its ids, what its frequent words add to the base score, and its other words, each once, with the times they occur."""
    word, value = frequent.column("word").to_numpy().view(np.uint64), np.log10(frequent.column("n").to_numpy() + 0.5)
    shared = docs.sparkSession.sparkContext.broadcast((word, value))  # at most FREQUENT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, table = TaskContext.get().partitionId() << 40, Table(*shared.value)
        for batch in batches:
            for part in tx.chunks(batch, limit=ENCODED):
                ids, n = targets(part.column("text"), path)
                h, rows = tx.words(part.column("text"), tx.NOT_SPACE)
                hit, values = table.find(h)
                size = len(part)
                base = np.bincount(rows[hit], weights=values, minlength=size)
                other, of = h[~hit], rows[~hit]
                by = np.lexsort((other, of))
                other, of = other[by], of[by]
                first = np.flatnonzero(np.r_[True, (other[1:] != other[:-1]) | (of[1:] != of[:-1])][: len(other)])
                ends = pa.array(np.r_[0, np.cumsum(np.bincount(of[first], minlength=size))], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(row, row + size)), part.column("doc_id"), part.column("held"), pa.array(np.bincount(rows, minlength=size) + 1), pa.array(np.bincount(rows[hit], minlength=size)), pa.array(base),
                     _bytes(ids, n), pa.ListArray.from_arrays(ends, pa.array(other[first].view(np.int64))), pa.ListArray.from_arrays(ends, pa.array(np.diff(np.r_[first, len(other)])))],
                    ["row", "doc_id", "held", "n_tokens", "known", "base", "ids", "word", "times"],
                )
                row += size

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out(PARTS, HELD_OUT).alias("held"))
    return stored(rows.mapInArrow(tx.tidy(run), _ROWS + ", ids binary, word array<bigint>, times array<bigint>"))


def id_counts(train: DataFrame) -> np.ndarray:
    """How often each id occurs in the training texts; as many rows as the vocabulary has come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(at.VOCABULARY, np.int64)
        for batch in batches:
            for part in tx.chunks(batch, "ids", ENCODED):
                total += np.bincount(_ids(part.column("ids"))[0], minlength=at.VOCABULARY)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["id", "n"])

    out = np.zeros(at.VOCABULARY)
    for r in train.select("ids").mapInArrow(tx.tidy(run), "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r.id] = r.n
    return out


def chosen(train: DataFrame, turn: int, share: int = SHARE) -> DataFrame:
    """The windows of a round: a key that orders and deals them, ids (of attention.sequences()). Rows of one text and one id, and only they, have the
    same keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tx.chunks(batch, "ids", ENCODED):
                ids, n, texts = _ids(part.column("ids"))
                slots, inside = at.windows(n)
                k = -(-n // at.STEP)
                rows = tx.mix(texts + tx.mix(part.column("doc_id").fill_null(-1).to_numpy().view(np.uint64)))
                key = tx.mix(np.repeat(rows, k) + (np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                some = np.flatnonzero(key % np.uint64(share) == turn)
                kept = at.sequences(ids, slots[some], inside[some])
                yield pa.RecordBatch.from_arrays([pa.array(key[some].view(np.int64)), _bytes(kept.ravel(), np.full(len(kept), kept.shape[1]))], ["key", "ids"])

    return train.select("doc_id", "ids").mapInArrow(tx.tidy(run), _KEPT)


def _learn(w: dict, c: at.Classes, rate: float):
    def run(group: pa.Table) -> pa.Table:
        rows = np.concatenate([_ids(x)[0].astype("<u2") for x in group.column("ids").chunks]).reshape(len(group), at.WINDOW + 1)
        rows = rows[np.argsort(group.column("key").to_numpy(), kind="stable")]  # windows of one key are alike
        flat = at.pack(at.fit(w, c, rows, rate))
        parts = [flat[a : a + PIECE] for a in range(0, len(flat), PIECE)]
        return pa.table({"piece": np.arange(len(parts)), "w": pa.array(parts, pa.list_(pa.float32())), "n": np.full(len(parts), len(group))})

    return run


def trained(texts: DataFrame, share: int = SHARE, rounds: int = ROUNDS, shard: int = SHARD) -> tuple[dict, at.Classes]:
    """The model of the training texts. Without any, all ids are alike."""
    train = texts.where("not held")
    c = at.Classes(id_counts(train))
    w = at.start(c)
    shards = max(1, round((train.agg(F.sum(F.ceil(F.length("ids") / (2 * at.STEP)))).first()[0] or 0) / share / shard))
    for turn in range(rounds):
        dealt = chosen(train, turn, share).select("key", "ids", F.pmod(F.shiftrightunsigned("key", 16), F.lit(shards)).alias("shard"))
        dealt = dealt.repartition(2 * shards, "shard")  # a number of its own: by bytes, AQE would join shards, whose work is large for their size
        some = dealt.groupBy("shard").applyInArrow(_learn(w, c, RATE * 0.3**turn), "piece bigint, w array<float>, n bigint")
        some = some.repartition("piece").select("piece", "n", F.posexplode("w"))  # pieces are shuffled whole, which takes less than a row for each weight
        mean = some.groupBy("piece", "pos").agg((F.sum(F.col("col").cast("double") * F.col("n")) / F.sum("n")).alias("x"))  # as many rows as the model has weights
        flat = at.pack(w)
        for batch in mean.toArrow().to_batches():
            flat[batch.column("piece").to_numpy() * PIECE + batch.column("pos").to_numpy()] = batch.column("x").to_numpy()
        w = at.unpack(flat)
    return w, c


def scored(docs: DataFrame, path: str, share: int = SHARE) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (both log10).

    A null text is empty: its only token is its end. Null ids are not held out; repeated rows are scored, and counted, each.
    """
    counts = word_counts(docs)
    steps = sorted(counts.groupBy(_level().alias("level")).agg(F.count("*").alias("words"), F.sum("n").alias("n")).collect(), reverse=True)  # STEPS for each doubling
    v, n = sum(r.words for r in steps), sum(r.n for r in steps)
    levels = [r.level for r, words in zip(steps, np.cumsum([r.words for r in steps]), strict=True) if words <= FREQUENT]
    is_frequent = _level() >= levels[-1] if levels else F.lit(False)
    texts = encoded(docs, counts.where(is_frequent).toArrow(), path)
    w, c = trained(texts, share)
    ends = texts.where("not held").count()
    v, n = v + (ends > 0), n + ends

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tx.chunks(batch, "ids", ENCODED):
                ids, size, _ = _ids(part.column("ids"))
                x = np.add.reduceat(at.log_probability(w, c, ids, size), np.cumsum(size) - size) / np.log(10)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(x)], [*part.schema.names[:-1], "score"])

    words = texts.select("row", F.explode(F.arrays_zip("word", "times")).alias("x")).select("row", "x.word", "x.times")
    sums = words.join(counts.where(~is_frequent), "word", "left").groupBy("row").agg(
        F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("more"), F.sum(F.when(F.col("n").isNotNull(), F.col("times"))).alias("more_known")
    )
    rows = texts.select("row", "doc_id", "held", "n_tokens", "known", "base", "ids").mapInArrow(tx.tidy(score), _ROWS + ", score double")
    zero, tokens = F.lit(0), F.col("n_tokens")
    return rows.join(sums, "row", "left").select(
        "doc_id", F.col("held").alias("held_out"), "n_tokens", (F.col("known") + F.coalesce("more_known", zero) + int(ends > 0)).alias("n_known"), F.lit(int(n)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", zero) + float(np.log10(ends + 0.5)) - tokens * float(np.log10(n + 0.5 * (v + 1)))).alias("base_score"), "score",
    )


def op7_lm_scoring(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return scored(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
