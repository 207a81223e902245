"""Best-fit packing of tokenised documents into sequences, improved by swap-based local search.

Whole pieces fill a sequence each. The others are dealt at random to groups of a bounded size; in a group, best-fit decreasing makes the first
sequences, then moves, one-for-one and two-for-one exchanges out of the emptiest one raise the sum of squared fills until no sequence can be
emptied. What stays under-filled in all groups is dealt and packed once more.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pvspark.llm import text as tx
from pvspark.llm.encoding import encode
from pvspark.llm.shared import stored

CAPACITY = 2048
END = 0
#: Pieces that one task packs together.
GROUP = 8192
#: Sequences filled less than this go to the second round.
UNDERFULL = 0.98

VOCABULARY = "byte_bpe_50k.json"
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def _pieces(path: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tx.chunks(batch):
                ids, n = encode(part.column("text"), path)
                ids, n = np.insert(ids, np.cumsum(n), END), n + 1
                begin, k = np.cumsum(n) - n, -(-n // capacity)
                piece = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
                head = np.repeat(n - (k - 1) * capacity, k)
                start = np.where(piece == 0, 0, head + (piece - 1) * capacity)
                length = np.where(piece == 0, head, capacity)
                at = np.repeat(begin, k) + start
                raw = ids.astype("<u4")
                crc = [zlib.crc32(raw[a : a + m]) for a, m in zip(at.tolist(), length.tolist(), strict=True)]
                doc = part.column("doc_id").cast(pa.int64()).take(pa.array(np.repeat(np.arange(len(part)), k)))
                yield pa.RecordBatch.from_arrays([doc, pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def best_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """A bin for each piece: the largest pieces first, each into the fullest bin that has room."""
    bins, free, by_room, rooms = np.zeros(len(sizes), np.int64), [], {}, 0
    for k in np.argsort(-sizes, kind="stable").tolist():
        s = int(sizes[k])
        fits = rooms >> s
        if fits:
            room = s + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            b, room = len(free), capacity
            free.append(capacity)
        bins[k], free[b] = b, room - s
        if room - s:
            by_room.setdefault(room - s, []).append(b)
            rooms |= 1 << (room - s)
    return bins


def reachable(sums: np.ndarray, capacity: int) -> np.ndarray:
    """For each room from 0 to capacity, the largest of the sums that fits it; 0 if none does."""
    table = np.zeros(capacity + 1, np.int64)
    fit = sums[sums <= capacity]
    table[fit] = fit
    return np.maximum.accumulate(table)


def local_search(sizes: np.ndarray, bins: np.ndarray, capacity: int) -> np.ndarray:
    """Exchange pieces of the emptiest bin for smaller ones of fuller bins, or move them there, while that raises the squared fill.

    Each step takes the change that moves most tokens: a move, one piece for one, or two for one; all pieces and all pairs of pieces of the emptiest bin
    are looked at (pieces of one size are alike, and the distinct sizes in a bin are few). A bin without a step stays as it is; the search ends when
    the room of the other bins is less than what the emptiest bin holds, or no bin has a step.
    """
    bins = bins.copy()
    fill = np.bincount(bins, weights=sizes).astype(np.int64)
    stuck = np.zeros(len(fill), bool)
    while True:
        open_ = np.flatnonzero((fill > 0) & (fill < capacity) & ~stuck)
        if not len(open_):
            return bins
        donor = open_[np.argmin(fill[open_])]
        room = np.where(fill > 0, capacity - fill, 0)
        room[donor] = 0
        if room.sum() < fill[donor]:
            return bins
        own = np.flatnonzero(bins == donor)
        size, count = np.unique(sizes[own], return_counts=True)
        i, j = np.triu_indices(len(size))
        double = (i < j) | (count[i] > 1)
        i, j = i[double], j[double]
        one, two = reachable(size, capacity), reachable(size[i] + size[j], capacity)
        # what a receiving bin gives back: nothing (its index -1 - bin) or one piece; it must end up fuller than before
        holes, back = np.flatnonzero(room > 0), np.flatnonzero((room[bins] > 0) & (bins != donor))
        which = np.r_[-1 - holes, back, back]
        total = np.r_[one[room[holes]], one[room[bins[back]] + sizes[back]], two[room[bins[back]] + sizes[back]]]
        more = total - np.r_[np.zeros(len(holes), np.int64), sizes[back], sizes[back]]
        best = int(np.argmax(np.where(total > 0, more, 0)))
        if total[best] == 0 or more[best] <= 0:
            stuck[donor] = True
            continue
        if best >= len(holes) + len(back):
            k = np.flatnonzero(size[i] + size[j] == total[best])[0]
            first, second = own[sizes[own] == size[i[k]]], own[sizes[own] == size[j[k]]]
            take = [first[0], second[-1]]
        else:
            take = [own[sizes[own] == total[best]][0]]
        to = bins[which[best]] if which[best] >= 0 else -1 - which[best]
        if which[best] >= 0:
            bins[which[best]] = donor
        bins[take] = to
        fill[donor] -= more[best]
        fill[to] += more[best]


def _pack(capacity: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("uid", ignore_index=True)
        sizes = group["length"].to_numpy(np.int64)
        bins = local_search(sizes, best_fit(sizes, capacity), capacity)
        order = np.argsort(bins, kind="stable")
        ends = np.cumsum(sizes[order])
        new = np.r_[True, bins[order][1:] != bins[order][:-1]]
        offset = np.empty(len(sizes), np.int64)
        offset[order] = ends - sizes[order] - np.repeat((ends - sizes[order])[new], np.diff(np.r_[np.flatnonzero(new), len(sizes)]))
        fill = np.bincount(bins, weights=sizes).astype(np.int64)[bins]
        return pd.DataFrame({"uid": group["uid"], "length": sizes, "grp": group["grp"], "bin": bins, "offset": offset, "fill": fill})

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces (uid long, unique; length 1 to capacity) with sequence_id and offset: uid, sequence_id, offset. Without pieces there are no rows."""
    schema = "uid long, length long, grp long, bin long, offset long, fill long"
    whole = pieces.where(F.col("length") == capacity).select("uid", (F.col("uid") * 4).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest, out = pieces.where(F.col("length") < capacity).select("uid", "length"), [whole]
    for turn in (1, 2):
        groups = max(1, -(-rest.count() // GROUP))
        packed = stored(rest.withColumn("grp", F.pmod(F.xxhash64("uid", F.lit(turn)), F.lit(groups))).groupBy("grp").applyInPandas(_pack(capacity), schema))
        done = packed if turn == 2 or groups == 1 else packed.where(F.col("fill") >= UNDERFULL * capacity)
        out.append(done.select("uid", ((F.col("grp") * (1 << 24) + F.col("bin")) * 4 + turn).alias("sequence_id"), "offset"))
        if turn == 2 or groups == 1:
            break
        rest = packed.where(F.col("fill") < UNDERFULL * capacity).select("uid", "length")
    every = out[0]
    for o in out[1:]:
        every = every.unionByName(o)
    return every


def packed(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """One row for each piece of each document (doc_id, text): doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids, then the id 0; a null or empty text is that id alone. Documents over `capacity` are cut, the first piece being the
    shorter one. Rows that repeat, or have a null id, are packed as they come.
    """
    pieces = stored(docs.select("doc_id", "text").mapInArrow(tx.tidy(_pieces(path, capacity)), PIECES).withColumn("uid", F.monotonically_increasing_id()))
    return pieces.join(pack(pieces, capacity), "uid").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op9_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path(VOCABULARY))
