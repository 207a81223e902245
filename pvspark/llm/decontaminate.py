"""Benchmark decontamination by a distributed positional inverted index.

The index is partitioned by document: each row of it is a block of documents with, for every term, the sorted positions where the term occurs.
A search counts how often each test term occurs in the whole index, then, in every block, takes the postings of a window's rarest term,
adjusts them by the term's offset in the window and intersects them with the other terms' postings, from rare to frequent. With a slop of 0
these are exact phrase matches; otherwise each term may stand up to `slop` words from its place (proximity).
"""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pvspark.llm import text as tx
from pvspark.llm.shared import stored

WINDOW = 10
#: Unused positions between two documents of a block, so that no window or slop reaches over.
GAP = 64
#: Test words that one pass over the index takes (at most 34 MB at each task, see Probe.size()); more words take more passes.
WORDS_PER_PASS = 1_000_000
#: Windows that are ordered at once.
RANKED = 1 << 16

INDEX = "block bigint, doc_ids array<bigint>, firsts array<bigint>, n_words array<int>, terms array<bigint>, ends array<int>, positions array<int>"
_HITS = "block bigint, row int, doc_id bigint, n_words bigint, starts array<int>, ends array<int>, items array<bigint>, near bigint"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in tx.chunks(batch):
            terms, rows = tx.words(part.column("text"), tx.ALNUM)
            count = np.bincount(rows, minlength=len(part))
            firsts = np.r_[0, np.cumsum(count + GAP)[:-1]]
            positions = np.arange(len(terms)) + (np.cumsum(count + GAP) - np.cumsum(count) - GAP)[rows]
            order = np.argsort(terms, kind="stable")
            terms = terms[order]
            last = np.flatnonzero(np.r_[terms[1:] != terms[:-1], np.ones(min(1, len(terms)), bool)])
            one = lambda x, kind: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x if isinstance(x, pa.Array) else pa.array(x, kind))
            ids = part.column("doc_id").cast(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array([secrets.randbits(62)]), one(ids, None), one(firsts, pa.int64()), one(count, pa.int32()), one(terms[last].view(np.int64), pa.int64()), one(last + 1, pa.int32()), one(positions[order], pa.int32())],
                ["block", "doc_ids", "firsts", "n_words", "terms", "ends", "positions"],
            )


def build_index(docs: DataFrame) -> DataFrame:
    """The index of all words of all documents (doc_id, text), kept in the shared folder. A null text has no words; a null doc_id is kept."""
    return stored(docs.select("doc_id", "text").mapInArrow(tx.tidy(_blocks), INDEX))


class Probe:
    """The windows of some test items: the items' words as places in a sorted list of distinct terms, and where each window starts.

    A word takes 4 bytes, and each of its windows 12 more and `size` for the order of its terms; nothing is repeated for overlapping windows.
    """

    def __init__(self, items: list[tuple[int, str]], size: int):
        words = [tx.words(pa.array([text]), tx.ALNUM)[0] for _, text in items]
        self.terms, place = np.unique(np.concatenate([np.zeros(0, np.uint64), *words]), return_inverse=True)
        self.words, self.groups = place.astype(np.int32), []
        n = np.array([len(w) for w in words], np.int64)
        begin = np.cumsum(n) - n
        for width in np.unique(np.minimum(n[n > 0], size)).tolist():
            some = np.flatnonzero(np.minimum(n, size) == width)
            k = n[some] - width + 1
            starts = np.repeat(begin[some] - (np.cumsum(k) - k), k) + np.arange(k.sum())
            self.groups.append((width, np.repeat(np.array([i for i, _ in items], np.int64)[some], k), starts.astype(np.int32)))
        self.orders: list[np.ndarray] = []

    def size(self) -> int:
        """The bytes of all arrays."""
        return sum(x.nbytes for x in (self.terms, self.words, *self.orders, *chain.from_iterable(g[1:] for g in self.groups)))

    def rank(self, counts: np.ndarray) -> None:
        """Order each window's offsets by how often their terms occur in the whole index; the order of a run of windows at a time."""
        n = counts[self.words]
        for width, _, starts in self.groups:
            order = np.empty((len(starts), width), np.int8)
            for a in range(0, len(starts), RANKED):
                order[a : a + RANKED] = np.argsort(n[starts[a : a + RANKED, None] + np.arange(width)], axis=1, kind="stable")
            self.orders.append(order)

    def search(self, terms: np.ndarray, ends: np.ndarray, positions: np.ndarray, slop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Items, first and last + 1 positions of the windows that occur in a block. Each distinct term is looked up once; windows are taken on by
        their rarest term, then checked term by term, so most leave after one step."""
        out = [(np.zeros(0, np.int64),) * 3]
        if not len(terms) or not len(self.terms):
            return out[0]
        place = np.minimum(np.searchsorted(terms, self.terms), len(terms) - 1).astype(np.int32)
        place[terms[place] != self.terms] = -1
        at = place[self.words]  # of each word, its term's place in the block; -1 where it does not occur
        begins = np.r_[0, ends[:-1]].astype(np.int64)
        span = np.int64(positions.max()) + 1 + 2 * GAP
        keys = np.repeat(np.arange(len(terms)), ends - begins) * span + positions + GAP
        for (width, items, starts), order in zip(self.groups, self.orders, strict=True):
            live = np.arange(len(starts))
            for k in range(width):  # from the rarest term on: does it occur in the block at all?
                live = live[at[starts[live] + order[live, k]] >= 0]
            if not len(live):
                continue
            rare = at[starts[live] + order[live, 0]]
            n = ends[rare] - begins[rare]
            which = np.repeat(live, n)
            start = positions[np.repeat(begins[rare] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())].astype(np.int64) - order[which, 0]
            for k in range(1, width):
                offset = order[which, k].astype(np.int64)
                least = at[starts[which] + offset] * span + np.maximum(start + offset - slop, -GAP) + GAP
                next_ = keys[np.minimum(np.searchsorted(keys, least), len(keys) - 1)]
                ok = (next_ >= least) & (next_ <= least + 2 * slop)
                which, start = which[ok], start[ok]
            out.append((items[which], start, start + width))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _counts(probe: Probe):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(len(probe.terms), np.int64)
        for frame in frames:
            for terms, ends in zip(frame["terms"], frame["ends"], strict=True):
                terms, n = np.asarray(terms, np.int64).view(np.uint64), np.diff(np.asarray(ends, np.int64), prepend=0)
                if len(terms):
                    at = np.minimum(np.searchsorted(terms, probe.terms), len(terms) - 1)
                    total += np.where(terms[at] == probe.terms, n[at], 0)
        some = np.flatnonzero(total)
        yield pd.DataFrame({"term": some, "n": total[some]})

    return run


def _found(probe: Probe, slop: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                ids = batch.column("doc_ids")[k].values
                get = lambda c, k=k, batch=batch: batch.column(c)[k].values.to_numpy(zero_copy_only=False)
                firsts, n_words, block = get("firsts"), get("n_words"), (get("terms").view(np.uint64), get("ends"), get("positions"))
                items, start, end = probe.search(*block, 0)
                doc = np.searchsorted(firsts, start, "right") - 1
                near = np.zeros(len(ids), np.int64)
                if slop:
                    _, s, _ = probe.search(*block, slop)
                    near = np.bincount(np.searchsorted(firsts, np.maximum(s, 0), "right") - 1, minlength=len(ids)) - np.bincount(doc, minlength=len(ids))
                order = np.lexsort((start, doc))
                doc, start, end, items = doc[order], (start - firsts[doc])[order], (end - firsts[doc])[order], items[order]
                # overlapping or touching windows of a document become one passage
                fresh = np.r_[np.ones(min(1, len(doc)), bool), (doc[1:] != doc[:-1]) | (start[1:] > np.maximum.accumulate(end + doc * (1 << 40))[:-1] - doc[1:] * (1 << 40))] if len(doc) else np.zeros(0, bool)
                at = np.flatnonzero(fresh)
                runs = (doc[at], start[at], np.maximum.reduceat(end, at) if len(at) else end)
                pairs = np.unique(np.stack([doc, items], 1), axis=0) if len(doc) else np.zeros((0, 2), np.int64)
                lists = lambda of, values, kind, ids=ids: pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.bincount(of, minlength=len(ids)))], pa.int32()), pa.array(values, kind))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(ids), batch.column("block")[k].as_py())), pa.array(np.arange(len(ids)), pa.int32()), ids, pa.array(n_words, pa.int64()), lists(runs[0], runs[1], pa.int32()), lists(runs[0], runs[2], pa.int32()), lists(pairs[:, 0], pairs[:, 1], pa.int64()), pa.array(near, pa.int64())],
                    ["block", "row", "doc_id", "n_words", "starts", "ends", "items", "near"],
                )

    return run


def search(index: DataFrame, items: DataFrame, size: int = WINDOW, slop: int = 0, words_per_pass: int = WORDS_PER_PASS) -> DataFrame:
    """Where windows of the items (item_id, text) occur in the index.

    One row for each indexed document: doc_id, n_words, passages array<struct<start,end>> (word numbers, end exclusive; overlapping or touching
    windows are one passage), items array<bigint> (distinct, ascending), near (window occurrences that are not exact but within `slop` words;
    0 if slop is 0). Items without words or with a null id have no windows; without items each document has none.
    The items are read in passes of bounded size, so that what the tasks get does not grow with the benchmark.
    """
    if slop + size > GAP:
        raise ValueError(f"size and slop must not exceed {GAP} words together")
    spark, outs, batch, held = items.sparkSession, [], [], 0

    def one_pass(batch: list) -> DataFrame:
        probe = Probe(batch, size)
        counts = np.zeros(len(probe.terms), np.int64)
        if len(counts):  # as many rows as distinct test terms of the pass at most
            for r in index.select("terms", "ends").mapInPandas(tx.tidy(_counts(probe)), "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
                counts[r.term] = r.n
        probe.rank(counts)
        return index.mapInArrow(tx.tidy(_found(probe, slop)), _HITS)

    for r in items.where("item_id is not null and text is not null").select("item_id", "text").toLocalIterator():
        n = len(tx.words(pa.array([r.text]), tx.ALNUM)[0])
        if held and held + n > words_per_pass:
            outs.append(one_pass(batch))
            batch, held = [], 0
        batch.append((r.item_id, r.text))
        held += n
        if held >= words_per_pass:
            outs.append(one_pass(batch))
            batch, held = [], 0
    if batch or not outs:
        outs.append(one_pass(batch))
    zipped = lambda a, b: F.transform(F.arrays_zip(a, b), lambda x: F.struct(x[a].alias("start"), x[b].alias("end")))
    if len(outs) == 1:
        return outs[0].select("doc_id", "n_words", zipped("starts", "ends").alias("passages"), F.col("items"), "near")
    every = reduce(DataFrame.unionByName, outs)
    merged = every.groupBy("block", "row", "doc_id", "n_words").agg(F.array_sort(F.flatten(F.collect_list(zipped("starts", "ends")))).alias("all"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.sum("near").alias("near"))
    joined = F.aggregate(
        "all",
        F.array().cast("array<struct<start:int,end:int>>"),
        lambda acc, x: F.when((F.size(acc) > 0) & (x["start"] <= F.element_at(acc, -1)["end"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], x["end"]).alias("end"))))).otherwise(F.concat(acc, F.array(x))),
    )
    return merged.select("doc_id", "n_words", joined.alias("passages"), "items", "near")


def contamination(docs: DataFrame, items: DataFrame, size: int = WINDOW, slop: int = 0) -> DataFrame:
    """Index the documents and search the items in them; one row for each document, also for repeated and null ids."""
    return search(build_index(docs), items, size, slop)


def decontaminated(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """The documents in which no window of an item occurs; all columns stay. A row goes for its own text (known by a 64-bit hash), whatever its id is;
    clean rows stay, also those with a null id or text."""
    key = F.xxhash64(F.coalesce("text", F.lit("")))
    hit = contamination(docs.select(key.alias("doc_id"), "text"), items, size).where("size(passages) > 0").select(F.col("doc_id").alias("_hit")).distinct()
    return docs.join(hit, key == hit["_hit"], "left_anti")


def digest(items: list[int]) -> str:
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()


def op3_decontaminate(spark, sf_dir: str) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    found = contamination(read("documents"), read("benchmark"), slop=2)
    n_hit = F.aggregate("passages", F.lit(0).cast("long"), lambda acc, x: acc + (x["end"] - x["start"]))
    names = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), F.col("near").alias("n_near")
    )
