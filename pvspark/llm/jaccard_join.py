"""N-gram Jaccard self-join with signature trees; lossless.

1. Every text becomes its set of distinct word shingles (as hashes), texts with equal sets one representative.
2. In an order of all shingles (frequent ones last), two sets of Jaccard similarity t share a shingle among the first n - ceil(t*n) + 1 of each.
   Those shingles are keys; keys of one set alone, and keys that repeat the members of another key, go.
3. A task's sets form signature trees, one for each bitmap width, in which the members of a key are a branch: nodes hold the OR of their sets' bitmaps and the range of
   their sizes. A dual traversal drops node pairs whose largest possible overlap is too small, and pairs of branches, which share no key. What remains connects
   sets to candidate groups, so each set is in one group.
4. Second trees over the candidate groups, whose leaf pairs are compared by their whole sets, give the links as a forest; connected components follow.

Groups over BLOCK members are split into blocks and the pairs of blocks dealt to tasks; only forests are emitted, never all pairs.
Shingle hashes have 52 bits: in two sets of 500, two different shingles are taken as one with a chance of about 1 in 10**10.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pvspark.llm import text as tx
from pvspark.llm.shared import components, dropped, roots, stored

WORDS, SIMILARITY = 3, 0.9
#: Members of a group that one task compares with themselves or with those of another block.
BLOCK = 1024
LEAF, FANOUT = 8, 4
#: Counters of the table that puts frequent shingles last (2 MB, whatever the corpus).
COUNTERS = 1 << 18

_STEP = 0x9FB21C651E98DF25
_HASH = np.uint64((1 << 52) - 1)
_SETS = "doc_id bigint, n bigint, k1 bigint, k2 bigint, prefix array<bigint>, bits binary"


def shingles(column: pa.Array, width: int, kind: np.ndarray = tx.NOT_SPACE) -> tuple[np.ndarray, np.ndarray]:
    """52-bit shingle hashes of each row in text order, repeated ones too, and their rows. Texts of fewer words have one shingle of all their words."""
    h, rows = tx.words(column, kind)
    n = np.bincount(rows, minlength=len(column))
    first = np.cumsum(n) - n
    out, of = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    with np.errstate(over="ignore"):
        if len(h) >= width:
            s = np.zeros(len(h) - width + 1, np.uint64)
            for j in range(width):
                s = s * np.uint64(_STEP) + h[j : j + len(s)]
            ok = rows[: len(s)] == rows[width - 1 :]
            out.append(tx.mix(s[ok]))
            of.append(rows[: len(s)][ok])
        for r in np.flatnonzero((n > 0) & (n < width)):
            s = np.array([n[r]], np.uint64)
            for x in h[first[r] : first[r] + n[r]]:
                s = tx.mix(s * np.uint64(5) + x)
            out.append(s)
            of.append(np.array([r]))
    return np.concatenate(out) >> np.uint64(12), np.concatenate(of)


def shingle_sets(column: pa.Array, width: int, kind: np.ndarray = tx.NOT_SPACE) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each row (at most tx.CHUNK_ROWS rows), sorted by row and hash, and their rows."""
    s, of = shingles(column, width, kind)
    both = np.sort((of.astype(np.uint64) << np.uint64(52)) | s)
    both = both[np.r_[np.ones(min(1, len(both)), bool), both[1:] != both[:-1]]]
    return both & _HASH, (both >> np.uint64(52)).astype(np.int64)


def _counter(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(34)).astype(np.int64)


def _frequent(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for part in tx.chunks(batch):
                total += np.bincount(_counter(shingles(part.column("text"), width)[0]), minlength=COUNTERS)
        mean = total.mean()
        some = np.flatnonzero(total > mean + 8 * np.sqrt(mean) + 8)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], ["counter", "n"])

    return run


def frequent(docs: DataFrame, width: int = WORDS) -> np.ndarray:
    """For each counter 0, or, where its shingles stand out, the logarithm of how often they occur, 15 at most. At most COUNTERS rows come to the driver.
    It only sets an order: any table gives the same links."""
    out = np.zeros(COUNTERS, np.int64)
    for r in docs.select("text").mapInArrow(tx.tidy(_frequent(width)), "counter long, n long").groupBy("counter").agg(F.sum("n").alias("n")).collect():
        out[r.counter] = r.n
    return np.minimum(15, np.log2(out + 1)).astype(np.uint64)


def bitmap(s: np.ndarray) -> bytes:
    """A set's bitmap: a power of two of bits, between 64 and 8192, about one for each shingle."""
    m = int(min(8192, max(64, 1 << int(np.ceil(np.log2(max(1, len(s))))))))
    bits = np.zeros(m, np.uint8)
    bits[(s % np.uint64(m)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def least_overlap(n: np.ndarray, t: int) -> np.ndarray:
    """How many shingles a set of n has in common, at least, with any set of similarity t percent."""
    return -(-n * t // 100)


def _sets(width: int, t: int, rank: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tx.chunks(batch):
                s, of = shingle_sets(part.column("text"), width)
                n = np.bincount(of, minlength=len(part))
                begin = np.cumsum(n) - n
                with np.errstate(over="ignore"):
                    sums = [np.r_[np.uint64(0), np.cumsum(tx.mix(s + np.uint64(c)), dtype=np.uint64)] for c in (0x1234567, 0x89ABCDEF0)]
                    k = [(x[begin + n] - x[begin]).view(np.int64) for x in sums]
                # the order of all shingles: how frequent (16 steps), then 48 bits of the hash; these 52 bits are the key
                ordered = np.sort((of.astype(np.uint64) << np.uint64(52)) | (rank[_counter(s)] << np.uint64(48)) | (s >> np.uint64(4))) & _HASH
                size = np.where(n > 0, n - least_overlap(n, t) + 1, 0)
                keep = np.arange(len(s)) - np.repeat(begin, n) < np.repeat(size, n)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(k[0]), pa.array(k[1]),
                     pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)], pa.int32()), pa.array(ordered[keep].view(np.int64))),
                     pa.array([bitmap(s[a : a + m]) for a, m in zip(begin, n, strict=True)], pa.binary())],
                    ["doc_id", "n", "k1", "k2", "prefix", "bits"],
                )

    return run


class Tree:
    """A signature tree over sets of one bitmap width that belong to groups: below the root there is a branch for each group. Each node holds the OR of its
    sets' bitmaps, their range of sizes, and the largest excess: how many shingles of a set share a bit with another shingle of that set.

    Level 0 are the sets, by group, size and bitmap; level 1 their leaves; on the last level each group has one node."""

    def __init__(self, members: np.ndarray, bits: np.ndarray, sizes: np.ndarray, group: np.ndarray):
        order = np.lexsort((*(bits[:, i] for i in range(min(4, bits.shape[1]))), sizes, group))
        self.members, bits, sizes = members[order], bits[order], sizes[order]
        self.levels, self.groups = [(bits, sizes, sizes, sizes - np.bitwise_count(bits).sum(axis=1, dtype=np.int64))], [group[order]]
        self.first: list[np.ndarray] = [np.zeros(0, np.int64)]  # where each node's children begin on the level below
        while True:
            g, (b, lo, hi, excess) = self.groups[-1], self.levels[-1]
            begin = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
            place = np.arange(len(g)) - np.repeat(begin, np.diff(np.r_[begin, len(g)]))
            at = np.flatnonzero(place % (LEAF if len(self.levels) == 1 else FANOUT) == 0)
            self.levels.append((np.bitwise_or.reduceat(b, at), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at), np.maximum.reduceat(excess, at)))
            self.groups.append(g[at])
            self.first.append(np.r_[at, len(g)])
            if len(at) == len(begin):
                return

    def below(self, level: int, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The children of nodes of a level, and which of the nodes each one is of."""
        first = self.first[level]
        n = first[i + 1] - first[i]
        of = np.repeat(np.arange(len(i)), n)
        return first[i][of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n), of


def possible(a: tuple, b: tuple, t: int) -> np.ndarray:
    """Which pairs of nodes can hold sets of similarity t percent: the sizes allow it, and so does the largest possible overlap.
    Shared shingles have shared bits; so sets of the two nodes share at most the bits of both ORs and the lesser excess."""
    (ab, alo, ahi, ax), (bb, blo, bhi, bx) = a, b
    ok = (ahi * 100 >= blo * t) & (bhi * 100 >= alo * t)
    at = np.flatnonzero(ok)
    for part in np.array_split(at, max(1, len(at) * ab.shape[1] >> 24)):
        most = np.bitwise_count(ab[part] & bb[part]).sum(axis=1, dtype=np.int64) + np.minimum(ax[part], bx[part])
        ok[part] = np.minimum(most, np.minimum(ahi[part], bhi[part])) >= -(-(alo[part] + blo[part]) * t // (100 + t))
    return ok


def traverse(a: Tree, b: Tree, t: int, seen: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Dual traversal from the roots: the pairs of leaves that may hold a link; in one tree (a is b) each pair once. Branches of different groups are no pairs.
    seen, if given, gets how many node pairs were visited and how many of them dropped."""
    _, i, j = np.intersect1d(a.groups[-1], b.groups[-1], assume_unique=True, return_indices=True)
    la, lb = len(a.levels) - 1, len(b.levels) - 1
    while True:
        if a is b:
            i, j = i[i <= j], j[i <= j]
        keep = possible(tuple(x[i] for x in a.levels[la]), tuple(x[j] for x in b.levels[lb]), t)
        if seen is not None:
            seen[0] += len(keep)
            seen[1] += int((~keep).sum())
        i, j = i[keep], j[keep]
        if la == lb == 1:
            return i, j
        if la > 1:
            i, of = a.below(la, i)
            j, la = j[of], la - 1
        if lb > 1:
            j, of = b.below(lb, j)
            i, lb = i[of], lb - 1


class Forest:
    """Which members of a group are already connected."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        if len(i):
            nodes, least = roots(self.label[i], self.label[j])
            to = np.arange(len(self.label))
            to[nodes] = least
            self.label = to[self.label]


def overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of the sets of two leaves."""
    every, at = np.unique(np.concatenate([*a, *b]), return_inverse=True)
    m = np.zeros((len(a) + len(b), len(every)), np.float32)
    m[np.repeat(np.arange(len(a) + len(b)), [len(x) for x in (*a, *b)]), at] = 1
    return (m[: len(a)] @ m[len(a) :].T).astype(np.int64)


def compared(forest: Forest, a: Tree, b: Tree, pairs: tuple[np.ndarray, np.ndarray], t: int, sets: list | None, sizes: np.ndarray, seen: list[int] | None = None) -> None:
    """Join the sets of the given pairs of leaves that link: those whose bitmaps allow it or, with sets, exactly those. Pairs that are connected already are skipped."""
    step = max(1, (1 << 22) // (LEAF * LEAF * a.levels[0][0].shape[1]))
    for k in range(0, len(pairs[0]), step):
        i, of = a.below(1, pairs[0][k : k + step])
        j, more = b.below(1, pairs[1][k : k + step][of])
        i, of = i[more], of[more]
        if a is b:
            ok = i < j
            i, j, of = i[ok], j[ok], of[ok]
        ok = forest.label[a.members[i]] != forest.label[b.members[j]]
        i, j, of = i[ok], j[ok], of[ok]
        ok = possible(tuple(z[i] for z in a.levels[0]), tuple(z[j] for z in b.levels[0]), t)
        if seen is not None:
            seen[0] += len(ok)
            seen[1] += int((~ok).sum())
        x, y, of = a.members[i[ok]], b.members[j[ok]], of[ok]
        if sets is None:
            forest.join(x, y)
            continue
        for c, d in zip(*(lambda cut: (cut[:-1], cut[1:]))(np.r_[0, np.flatnonzero(of[1:] != of[:-1]) + 1, len(of)]), strict=True):
            open_ = np.flatnonzero(forest.label[x[c:d]] != forest.label[y[c:d]]) + c
            if not len(open_):
                continue
            if len(open_) == 1:
                n = np.array([len(np.intersect1d(sets[x[open_[0]]], sets[y[open_[0]]], assume_unique=True))], np.int64)
            else:
                ux, uy = np.unique(x[open_]), np.unique(y[open_])
                n = overlaps([sets[m] for m in ux], [sets[m] for m in uy])[np.searchsorted(ux, x[open_]), np.searchsorted(uy, y[open_])]
            ok = 100 * n >= t * (sizes[x[open_]] + sizes[y[open_]] - n)
            forest.join(x[open_[ok]], y[open_[ok]])


def connect(bits: list[bytes], sizes: np.ndarray, group: np.ndarray, left: np.ndarray, right: np.ndarray, t: int, sets: list | None, seen: list[int] | None = None) -> np.ndarray:
    """A label for each row; rows of a group that a chain of links connects have one label.

    left, right: whether a row is of the group's first or second block; where a group is compared with itself, all its rows are of both. Trees are built over all groups'
    rows of a bitmap width and traversed with themselves, with the other block's, and with those of the next width: sizes in a link differ by less than half."""
    forest = Forest(len(sizes))
    width = np.fromiter(map(len, bits), np.int64, len(bits))
    same = left & right

    def tree(rows: np.ndarray, w: int) -> Tree:
        raw = np.frombuffer(b"".join([bits[k] for k in rows]), np.uint8).reshape(len(rows), -1)
        return Tree(rows, raw if raw.shape[1] == w else raw[:, :w] | raw[:, w:], sizes[rows], group[rows])

    for w in np.unique(width):
        for v in (w, 2 * w):
            mine, yours = width == w, width == v
            jobs = [(same & mine, same & yours), (left & ~same & mine, right & ~same & yours)] + [(right & ~same & mine, left & ~same & yours)] * int(v != w)
            for k, (x, y) in enumerate(jobs):
                x, y = np.flatnonzero(x), np.flatnonzero(y)
                if v == w and not k:  # a row alone has nobody to be compared with
                    x = x[np.bincount(group[x], minlength=1)[group[x]] > 1] if len(x) else x
                    y = x
                else:
                    x, y = x[np.isin(group[x], group[y])], y[np.isin(group[y], group[x])]
                if not len(x) or not len(y):
                    continue
                a = tree(x, w)
                b = a if y is x else tree(y, w)
                compared(forest, a, b, traverse(a, b, t, seen), t, sets, sizes, seen)
    return forest.label


def whole(frames: Iterator[pd.DataFrame], by: list[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Frames of whole groups, from a partition that is sorted by the columns `by`, with the first row of each group and the number of rows."""
    held = None
    for frame in chain(frames, [None]):
        if frame is not None and not len(frame):
            continue
        if frame is not None and held is not None:
            frame = pd.concat([held, frame], ignore_index=True)
        every = held if frame is None else frame
        if every is None:
            return
        values = every[by].to_numpy()
        cuts = np.r_[0, np.flatnonzero((values[1:] != values[:-1]).any(axis=1)) + 1, len(every)]
        if frame is None:
            yield every, cuts
            return
        held = every.iloc[cuts[-2] :].reset_index(drop=True)
        if len(cuts) > 2:
            yield every.iloc[: cuts[-2]], cuts[:-1]


def _links(t: int, exact: bool):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for every, cuts in whole(frames, ["key", "low", "high"]):
            ids, sizes, own, low, high = (every[c].to_numpy() for c in ("id", "n", "own", "low", "high"))
            sets = [np.asarray(x, np.int64).view(np.uint64) for x in every["shingles"]] if exact else None
            bits = [bitmap(x) for x in sets] if exact else every["bits"].tolist()
            group = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
            label = connect(bits, sizes, group, own == low, own == high, t, sets)
            _, first = np.unique(label, return_index=True)
            node, least = roots(ids, ids[first][np.searchsorted(label[first], label)])
            if (node != least).any():
                yield pd.DataFrame({"node": node[node != least], "root": least[node != least]})

    return run


def dealt(members: DataFrame) -> DataFrame:
    """members (key, m members of the key, id, ...) with the blocks that each row is compared with: itself and one other block at a time."""
    size = F.greatest(F.lit(BLOCK / 4), F.least(F.lit(BLOCK * 4.0), 8 * F.sqrt("m")))
    n = F.ceil(F.col("m") / size).cast("int")
    own = F.when(n > 1, F.pmod(F.xxhash64("id"), n)).otherwise(0).cast("int")
    rows = members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), n - 1)))
    return rows.select("*", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high")).drop("m", "other")


def forest(members: DataFrame, t: int, exact: bool) -> DataFrame:
    """Edges (node, root) that connect what is linked inside the keys of members (key, m, id, n, bits or shingles)."""
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = dealt(members).repartition(parts, "key", "low", "high").sortWithinPartitions("key", "low", "high")
    return rows.mapInPandas(tx.tidy(_links(t, exact)), "node long, root long")


def _shingles(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tx.chunks(batch):
                s, of = shingle_sets(part.column("text"), width)
                n = np.bincount(of, minlength=len(part))
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)], pa.int32()), pa.array(s.view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("key"), part.column("m"), part.column("id"), pa.array(n, pa.int64()), lists], ["key", "m", "id", "n", "shingles"])

    return run


def shared_keys(docs: DataFrame, width: int, t: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The set of each row of docs (doc_id, text) as (doc_id, n, k1, k2, ...), one representative (id) of each set, and the members of each key that sets share:
    key, m members of it, id, n, bits."""
    found = stored(docs.mapInArrow(tx.tidy(_sets(width, t, frequent(docs, width))), _SETS))
    sets = stored(found.where("n > 0 and doc_id is not null").groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("id"), F.first("prefix").alias("prefix"), F.first("bits").alias("bits")))
    entries = sets.select(F.explode("prefix").alias("key"), "id")
    keys = entries.groupBy("key").agg(F.count("*").alias("m"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("y"))
    keys = stored(keys.where("m > 1").groupBy("m", "x", "y").agg(F.min("key").alias("key")).select("key", "m"))
    return found, sets, entries.join(keys, "key").join(sets.select("id", "n", "bits"), "id").select("key", "m", "id", "n", "bits")


def jaccard_classes(docs: DataFrame, width: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """One row for each document (doc_id, text): doc_id, n_shingles, component_id (the smallest doc_id that links reach).

    Two documents link if the Jaccard similarity of their shingle sets is at least `similarity` (in whole percent, over 0.5). A null text or one
    without words has 0 shingles and links with nothing. Rows that share an id are one node; a null id has no component.
    """
    t = round(similarity * 100)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    key, (found, sets, members) = ["k1", "k2", "n"], shared_keys(docs, width, t)
    candidates = stored(components(forest(members, t, False)))
    size = stored(candidates.groupBy("component").agg(F.count("*").alias("m")))
    near = candidates.join(size, "component").select(F.col("component").alias("key"), "m", F.col("node").alias("id"))
    texts = sets.select(*key, "id").join(near, "id")  # one text of each set
    texts = docs.join(texts.select("key", "m", "id"), docs["doc_id"] == F.col("id")).select("key", "m", "id", "text")
    links = components(forest(texts.mapInArrow(tx.tidy(_shingles(width)), "key long, m long, id long, n long, shingles array<bigint>"), t, True))
    classes = sets.select(*key, "id").join(links.withColumnRenamed("node", "id"), "id", "left").select(*key, F.coalesce("component", "id").alias("component_id"))
    return found.select("doc_id", *key).join(classes, key, "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def deduplicated(docs: DataFrame, width: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """One document of each class: the one of the least id. All columns stay, and so do rows without an id or words.

    Where ids repeat, each row is a document of its own and is judged by its own text: rows that repeat text and id are one class, while rows that share an id
    alone do not touch each other.
    """
    repeated = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").limit(1).count()
    if not repeated:
        classes = jaccard_classes(docs, width, similarity)
        gone = classes.where("doc_id <> component_id").select(F.col("doc_id").alias("_gone"))
        return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")
    row = next(f"_row{k}" for k in range(len(docs.columns) + 1) if f"_row{k}" not in docs.columns)
    order = ["doc_id", F.xxhash64("text")]  # numbers go by id, and rows of one id are spread over tasks
    rows = stored(docs.where("doc_id is not null").repartitionByRange(*order).sortWithinPartitions(*order).withColumn(row, F.monotonically_increasing_id()))
    classes = jaccard_classes(rows.select(F.col(row).alias("doc_id"), "text"), width, similarity)
    gone = classes.where("doc_id <> component_id").select(F.col("doc_id").alias("_gone"))
    return rows.join(gone, rows[row] == gone["_gone"], "left_anti").drop(row).unionByName(docs.where("doc_id is null"))


def op8_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
