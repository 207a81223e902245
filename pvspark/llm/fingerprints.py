"""Document fingerprints from prefix polynomial hashes.

The prefix array of a text holds the polynomial hash of each of its prefixes, modulo two primes. Any two spans are compared by four of its entries, and
the longest common extension of two places is found by binary search over lengths.

A fingerprint is a prefix array that is kept at some places only: at anchors, which the text around them chooses, and on a grid from the text's start.
So two fingerprints can be asked the same questions as two texts, at the steps between their places. Their likeness is the share of the longer text that
common extensions cover, each one found by binary search from a pair of places.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pvspark.llm import text as tx

#: Moduli and their bases. A pair of hashes tells two spans of n code points apart but with a chance of about n**2 * 2**-62.
PRIMES = (np.uint64(2147483647), np.uint64(2147483629))
BASES = (911382323, 972663749)
#: Code points that are hashed at once, and those of the window that decides whether a place is an anchor.
BLOCK, WINDOW = 1 << 15, 8
#: A text of n code points has about n / 2**scale anchors and as many grid places: PLACES to twice as many.
PLACES = 32

_powers: list[tuple[np.ndarray, np.ndarray]] = []


def _tables() -> list[tuple[np.ndarray, np.ndarray]]:
    """Powers of each base and of its inverse, up to a block."""
    if not _powers:
        for p, base in zip(PRIMES, BASES, strict=True):
            pair = []
            for b in (base, pow(base, -1, int(p))):
                out = np.ones(1, np.uint64)
                while len(out) <= BLOCK:
                    out = np.concatenate([out, out * np.uint64(pow(b, len(out), int(p))) % p])
                pair.append(out)
            _powers.append(tuple(pair))
    return _powers


def power(k: int, which: int) -> int:
    return pow(BASES[which], k, int(PRIMES[which]))


def points(text: str | None) -> np.ndarray:
    """The code points of a text; a null one has none."""
    return np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)


def prefixes(block: np.ndarray, before: tuple[int, int] = (0, 0)) -> list[np.ndarray]:
    """Hashes of the prefixes that end in a block of at most BLOCK code points, modulo each prime; before: those of all that stands before the block."""
    n, out = len(block), []
    for (up, down), p, h in zip(_tables(), PRIMES, before, strict=True):
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((block.astype(np.uint64) + np.uint64(1)) * down[:n] % p, out=total[1:])
        total %= p
        total[1:] = total[1:] * up[:n] % p  # the sum of c[i] * base**(end - 1 - i)
        out.append((total + np.uint64(h) * up[: n + 1]) % p if h else total)
    return out


class PrefixHashes:
    """The whole prefix array of one text."""

    def __init__(self, text: str | None):
        parts, at = [[np.zeros(1, np.uint64)] for _ in PRIMES], (0, 0)
        codes = points(text)
        for start in range(0, len(codes), BLOCK):
            block = prefixes(codes[start : start + BLOCK], at)
            for part, own in zip(parts, block, strict=True):
                part.append(own[1:])
            at = tuple(int(x[-1]) for x in block)
        self.n, self.h = len(codes), [np.concatenate(p) for p in parts]

    def span(self, start: int, end: int) -> tuple[int, int]:
        """The hash of the code points from start to end (exclusive); equal spans have equal hashes wherever they stand."""
        return tuple((int(h[end]) - int(h[start]) * power(end - start, k)) % int(PRIMES[k]) for k, h in enumerate(self.h))


def equal(a: PrefixHashes, i: int, b: PrefixHashes, j: int, length: int) -> bool:
    """Whether the spans of a length at place i of a and place j of b are equal; a span that leaves its text equals none."""
    return i + length <= a.n and j + length <= b.n and a.span(i, i + length) == b.span(j, j + length)


def extension(a: PrefixHashes, i: int, b: PrefixHashes, j: int) -> int:
    """The length of the longest common extension: how far a from i and b from j agree."""
    low, high = 0, min(a.n - i, b.n - j)
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if equal(a, i, b, j, middle) else (low, middle - 1)
    return low


def scale_of(n: int) -> int:
    return max(0, (n // PLACES).bit_length() - 1)


@dataclass
class Sample:
    """A prefix array of n code points at some places: at the multiples of 2**scale, at anchors of at least that level, and at the end."""

    n: int
    scale: int
    grid: np.ndarray
    places: np.ndarray
    levels: np.ndarray
    hashes: np.ndarray
    whole: int
    #: Hashes modulo the first prime of the last WINDOW + 1 prefixes at most, for a text that goes on.
    last: np.ndarray

    def thinned(self, scale: int) -> Sample:
        """The same at fewer places."""
        if scale <= self.scale:
            return self
        keep, step = self.levels >= scale, 1 << scale - self.scale
        return Sample(self.n, scale, self.grid[step - 1 :: step], self.places[keep], self.levels[keep], self.hashes[keep], self.whole, self.last)


def start_of(scale: int) -> Sample:
    none = np.zeros(0, np.int64)
    return Sample(0, scale, np.zeros(0, np.uint64), none, none, np.zeros(0, np.uint64), 0, np.zeros(1, np.uint64))


def extended(s: Sample, codes: np.ndarray) -> Sample:
    """The sample of a text that goes on with these code points, from the sample of what stands before.

    A place is an anchor if the hash of the WINDOW code points before it, well mixed, ends in `scale` zero bits or more; their number is its level. So
    the text alone chooses anchors, and those of a larger scale are among those of a smaller one.
    """
    step, p, up = 1 << s.scale, PRIMES[0], _tables()[0][0]
    n, whole, last, grid, places, levels, hashes = s.n, s.whole, s.last, [s.grid], [s.places], [s.levels], [s.hashes]
    for start in range(0, len(codes), BLOCK):
        one, two = prefixes(codes[start : start + BLOCK], (whole >> 31, whole & (1 << 31) - 1))
        both = one << np.uint64(31) | two
        grid.append(both[step - n % step :: step])
        one = np.concatenate([last, one[1:]])
        if len(one) > WINDOW:
            window = tx.mix((one[WINDOW:] + (p - one[:-WINDOW]) * up[WINDOW]) % p)
            at = np.flatnonzero((window & np.uint64(step - 1)) == 0)
            ends = at + WINDOW - (len(last) - 1)  # counted from the block's start
            at, ends = at[ends > 0], ends[ends > 0]
            low = window[at] | np.uint64(1 << 62)
            places.append(n + ends)
            levels.append(np.log2((low & (~low + np.uint64(1))).astype(np.float64)).astype(np.int64))
            hashes.append(both[ends])
        n, whole, last = n + len(both) - 1, int(both[-1]), one[-WINDOW - 1 :]
    return Sample(n, s.scale, *(np.concatenate(x) for x in (grid, places, levels, hashes)), whole, last)


def sample(text: str | None) -> Sample:
    codes = points(text)
    return extended(start_of(scale_of(len(codes))), codes)


def written(s: Sample) -> str:
    """A fingerprint as text: length, scale and hash of the whole; the grid; the anchors as place.level.hash. Equal texts have equal ones."""
    anchors = ",".join(f"{x}.{k}.{h:x}" for x, k, h in zip(s.places.tolist(), s.levels.tolist(), s.hashes.tolist(), strict=True))
    return f"{s.n}.{s.scale}.{s.whole:x};{','.join(f'{h:x}' for h in s.grid.tolist())};{anchors}"


def read(fingerprint: str) -> Sample:
    first, grid, anchors = fingerprint.split(";")
    n, scale, whole = first.split(".")
    rows = [x.split(".") for x in anchors.split(",")] if anchors else []
    places, levels = (np.array([int(r[k]) for r in rows], np.int64) for k in (0, 1))
    return Sample(int(n), int(scale), np.array([int(x, 16) for x in grid.split(",") if x], np.uint64), places, levels, np.array([int(r[2], 16) for r in rows], np.uint64), int(whole, 16), np.zeros(1, np.uint64))


def _last_equal(n: int, same) -> int:
    """How many of the first n are the same, if none is after the first that is not."""
    low, high = 0, n
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if same(middle - 1) else (low, middle - 1)
    return low


class _Ends:
    """The places of a sample from 0 to the text's end, their hashes, and the spans from each to the next."""

    def __init__(self, s: Sample):
        inner = s.places < s.n
        at = np.concatenate([[0], s.places[inner], [s.n]])
        h = np.concatenate([np.zeros(1, np.uint64), s.hashes[inner], np.array([s.whole], np.uint64)])
        self.places, self.prefix = at.tolist(), h.tolist()
        size, out = np.diff(at), []
        for k, p in enumerate(PRIMES):
            up = _tables()[k][0][size] if size.max(initial=0) <= BLOCK else np.array([power(x, k) for x in size.tolist()], np.uint64)
            own = h >> np.uint64(31) if k == 0 else h & np.uint64((1 << 31) - 1)
            out.append((own[1:] + (p - own[:-1]) * up) % p)
        #: Length and hash of the span from each place to the next.
        self.next = list(zip(size.tolist(), (out[0] << np.uint64(31) | out[1]).tolist(), strict=True))

    def span(self, i: int, j: int) -> tuple[int, int]:
        """Length and hash of the text from the i-th place to the j-th."""
        n, mask = self.places[j] - self.places[i], (1 << 31) - 1
        a, b = self.prefix[i], self.prefix[j]
        one = ((b >> 31) - (a >> 31) * power(n, 0)) % int(PRIMES[0])
        return n, one << 31 | ((b & mask) - (a & mask) * power(n, 1)) % int(PRIMES[1])


def likeness(a: Sample, b: Sample) -> float:
    """From 0 to 1: the share of the longer text that common extensions cover, to the steps between places. Texts that are equal, also empty ones, have 1.

    The first extension starts at both texts' starts; each further one at the next span between places that both have, in order. How far one goes is found
    by binary search: where two texts agree up to some place, they agree up to every place before.
    """
    if (a.n, a.whole) == (b.n, b.whole):
        return 1.0
    if not a.n or not b.n:
        return 0.0
    a, b = sorted((a, b), key=lambda s: (s.n, s.whole))
    scale = max(a.scale, b.scale)
    a, b = a.thinned(scale), b.thinned(scale)
    ag, bg = a.grid.tolist(), b.grid.tolist()
    on_grid = _last_equal(min(len(ag), len(bg)), lambda k: ag[k] == bg[k]) << scale
    x, y = _Ends(a), _Ends(b)
    nx, ny = len(x.places) - 1, len(y.places) - 1

    def steps(i: int, j: int) -> int:
        return _last_equal(min(nx - i, ny - j), lambda k: x.span(i, i + k + 1) == y.span(j, j + k + 1))

    i = j = steps(0, 0)
    covered = max(on_grid, x.places[i])
    starts: dict[tuple[int, int], list[int]] = {}
    if not {*x.next[i:]}.isdisjoint(y.next[j:]):
        for k in range(j, ny):
            starts.setdefault(y.next[k], []).append(k)
    while i < nx and starts:
        found = starts.get(x.next[i], ())
        k = bisect_left(found, j)
        if k == len(found):
            i += 1
            continue
        j = found[k]
        far = steps(i, j)
        covered += x.places[i + far] - max(x.places[i], min(on_grid, x.places[i + far]))
        i, j = i + far, j + far
    return min(1.0, covered / max(a.n, b.n))


def edited(text: str, following: str) -> str:
    """A text whose last quarter is replaced by as much of the start of the following text, or all of it."""
    q = len(text) // 4
    return text[: len(text) - q] + following[:q]


class Document:
    """A text with its sample, and that of what its edited form begins with, hashed once."""

    def __init__(self, text: str):
        self.text, codes = text, points(text)
        self.cut = len(codes) - len(codes) // 4
        self.head = extended(start_of(scale_of(len(codes))), codes[: self.cut])
        self.own = extended(self.head, codes[self.cut :])

    def edited(self, following: str) -> Sample:
        """The sample of edited()."""
        tail = points(following[: len(self.text) - self.cut])
        scale = scale_of(self.cut + len(tail))
        head = self.head if scale >= self.head.scale else extended(start_of(scale), points(self.text[: self.cut]))
        return extended(head, tail).thinned(scale)


def _ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, str, bool]]:
    for batch in batches:
        for part in tx.chunks(batch):
            ids, texts, guests = (part.column(c).to_pylist() for c in ("doc_id", "text", "guest"))
            yield from zip(ids, (t or "" for t in texts), guests, strict=True)


COLUMNS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row of a sorted range with the row after it; the range's own rows come first, then the first of the next range."""
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    before, out = None, []
    for doc_id, text, guest in _ordered(batches):
        now = Document(text)
        if before is not None:
            own_id, own = before
            other, changed = own.edited(text), edited(own.text, text).encode("utf-8", "surrogatepass")
            out.append((own_id, own.own.n, hashlib.sha256(changed).hexdigest(), written(own.own), written(other), likeness(own.own, other), likeness(own.own, now.own)))
            if len(out) == 256:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
                out = []
        before = None if guest else (doc_id, now)
        if guest:
            break
    for _ in batches:  # the other rows of the next range's first id
        pass
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)


def with_next(docs: DataFrame) -> DataFrame:
    """Ranges of docs (doc_id, text) by id, one in each partition and sorted, with the first rows of the range after it as guests; after the last range come those of
    the first.

    The ranges' bounds are quantiles of the ids, found in one pass over the ids alone: as many as spark.sql.shuffle.partitions. A row's range is found by
    binary search. Null ids come first; rows of one id are ordered by text, null first, and are in one range.
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    seen = ids.agg(F.percentile_approx("doc_id", [k / n for k in range(n)], max(10_000, 20 * n)), F.min("doc_id"), F.count_if(F.isnull("doc_id"))).first()
    bounds = sorted({x for x in seen[0] or () if x > seen[1]})
    last, bound = len(bounds), F.array(*map(F.lit, bounds)).cast("array<bigint>")
    jumps = F.array(*(F.lit(1 << k) for k in reversed(range(max(1, last.bit_length())))))
    go = lambda at, jump: F.when((at + jump <= last) & (F.get(bound, at + jump - 1) <= F.col("doc_id")), at + jump).otherwise(at)
    part = F.aggregate(jumps, F.lit(0), go)
    first = F.isnull("doc_id") if seen[2] else F.col("doc_id") == F.lit(seen[1])
    guest = lambda where, part: F.when(where, F.struct(part.cast("int").alias("part"), F.lit(True).alias("guest")))
    places = F.array_compact(F.array(F.struct("part", F.lit(False).alias("guest")), guest(F.get(bound, F.col("part") - 1) == F.col("doc_id"), F.col("part") - 1), guest(first, F.lit(last))))
    rows = ids.withColumn("part", part).select("doc_id", "text", places.alias("places")).select("doc_id", "text", F.inline("places"))
    return rows.repartitionById(last + 1, "part").sortWithinPartitions("guest", F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first()).select("doc_id", "text", "guest")


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row for each row of docs (doc_id, text): length in code points, fingerprint, digest and fingerprint of the edited text, and how like the fingerprint is
    to that one and to the next document's.

    The next document is the one of the next id, after the last the first, so a single one is its own next; null ids come first, rows that share an id follow each other by their
    text. A null text is empty. Without rows there are none; other columns do not matter.
    """
    return with_next(docs).mapInArrow(tx.tidy(_compared), COLUMNS)


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
