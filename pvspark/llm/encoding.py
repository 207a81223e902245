"""Token ids of whole columns of texts, exactly as `tokenizers` (a .json file) or `tiktoken` (a .tiktoken file) gives them with a byte-level vocabulary.

A text is cut where no match of the tokenizer's pattern reaches over, so each segment can be encoded alone; segments seen before come from a table of
fixed size. What a task holds does not grow with what it reads.
"""

from __future__ import annotations

import base64
import os

import numpy as np
import pyarrow as pa

from pvspark.llm import text as tx

#: Places of the table of known segments (12 bytes each), and how many segments and ids (2 bytes each) it keeps before it starts anew.
SLOTS, SEGMENTS, IDS = 1 << 21, 1 << 20, 1 << 22
#: Segments that are given to the tokenizer as one text.
JOINED = 2000
_coders: dict[str, Coder] = {}

_NEXT = np.zeros(256, bool)
_NEXT[33:127] = _NEXT[0xC3:] = True
_NEXT[0xE1:0xE4] = False
_ODD = np.ones(256, bool)
_ODD[33:127] = False
_ODD[60] = True


def ink(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the characters that end at some places are surely no white space."""
    last = data[at]
    wide = (last >= 128) & (data[np.maximum(at - 1, 0)] != 0xC2) & ~np.isin(data[np.maximum(at - 2, 0)], (0xE1, 0xE2, 0xE3))
    return wide | (last > 32) & (last < 127)


def segments(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of pieces of text that the tokenizer never merges over: cut before each single space between two characters that are
    surely no white space, where its pattern always begins a new match. Characters with the first bytes C2 and E1 to E3 may be white space (U+0085,
    U+00A0, U+1680, U+2000 and so on, U+3000), so there is no cut beside them, nor beside control characters."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    first = offsets[:-1][offsets[1:] > offsets[:-1]]
    at = np.flatnonzero(data == 32)
    at = at[(at > 0) & (at < len(data) - 1)]
    cut = np.zeros(len(data), bool)
    cut[at[_NEXT[data[at + 1]] & ink(data, at - 1)]] = True
    edge = first[first > 0]
    cut[edge - 1] = False  # the last character of a text
    cut[first] = True
    starts = np.flatnonzero(cut)
    return starts, np.r_[starts[1:], len(data)], np.searchsorted(offsets[1:], starts, "right")


def byte_of() -> dict[str, int]:
    """The bytes that a byte-level vocabulary's characters stand for: printable Latin-1 characters for themselves, the others from U+0100 on, in order."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in printable)}


def by_tokenizers(path: str):
    """A function from a text to its ids by the library tokenizers, and the ranks of its vocabulary, whose merges are in the order of its ids."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has its own core
    from tokenizers import Tokenizer

    run, byte = Tokenizer.from_file(path), byte_of()
    special = {t.content for t in run.get_added_tokens_decoder().values()}
    ranks = {bytes(byte[c] for c in token): k for token, k in run.get_vocab().items() if token not in special}
    sizes = {k: len(x) for x, k in ranks.items()} | {k: len(t.content.encode()) for k, t in run.get_added_tokens_decoder().items()}
    return lambda text: run.encode_batch_fast([text], add_special_tokens=False)[0].ids, ranks, sizes


def by_ranks(ranks: dict[bytes, int]):
    """The same by tiktoken, which has no special tokens."""
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


class Coder:
    """A tokenizer and the ids of segments that it has encoded."""

    def __init__(self, path: str):
        if path.endswith(".json"):
            self.run, ranks, sizes = by_tokenizers(path)
            self.quick = by_ranks(ranks)
        else:
            with open(path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            sizes = {k: len(x) for x, k in ranks.items()}
            self.run = self.quick = by_ranks(ranks)
        self.bytes = np.zeros(max(sizes) + 1, np.int64)  # of each id's text
        self.bytes[list(sizes)] = list(sizes.values())
        self.clear()

    def clear(self) -> None:
        self.keys, self.entries = np.zeros(SLOTS, np.uint64), np.full(SLOTS, -1, np.int32)
        self.ends, self.pool = np.zeros(1, np.int32), np.zeros(0, np.uint16)

    def encode_new(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As encode(), by the tokenizer. Segments that begin with a space and end with surely no white space are encoded many in one text, since there
        is a cut between any two of them; the bytes of the ids tell where each begins. Of these, printable ASCII ones without a "<", of which no special
        token is, go by the same merges in tiktoken, which is some times faster."""
        raw, n, every = data.tobytes(), np.zeros(len(starts), np.int64), []
        plain = (data[starts] == 32) & (ends - starts > 1)
        plain &= _NEXT[data[np.minimum(starts + 1, len(data) - 1)]] & ink(data, ends - 1)
        odd = np.r_[0, np.cumsum(_ODD[data])]
        quick = plain & (odd[ends] == odd[np.minimum(starts + 1, len(data))])
        for kind, run, most in ((quick, self.quick, JOINED), (plain & ~quick, self.run, JOINED), (~plain, self.run, 1)):
            some = np.flatnonzero(kind)
            for k in range(0, len(some), most):
                part = some[k : k + most]
                text = b"".join([raw[a:b] for a, b in zip(starts[part].tolist(), ends[part].tolist(), strict=True)])
                ids = np.array(run(text.decode("utf-8", "replace")), np.uint16)
                n[part] = np.diff(np.searchsorted(np.cumsum(self.bytes[ids]), np.cumsum(ends[part] - starts[part])) + 1, prepend=0) if most > 1 else len(ids)
                every.append((part, ids))
        pool = np.empty(int(n.sum()), np.uint16)
        at = np.cumsum(n) - n
        for part, ids in every:
            m = n[part]
            pool[np.repeat(at[part] - (np.cumsum(m) - m), m) + np.arange(len(ids))] = ids
        return n, pool

    def encode(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all segments, one after the other, and how many each has."""
        keys = tx.hashes(data, starts, ends)
        slots = (keys & np.uint64(SLOTS - 1)).astype(np.int64)
        entry = self.entries[slots].astype(np.int64)
        new = np.flatnonzero((entry < 0) | (self.keys[slots] != keys))
        bounds, pool = self.ends, self.pool
        if len(new):
            _, first, at = np.unique(keys[new], return_index=True, return_inverse=True)
            some = new[first]
            n, more = self.encode_new(data, starts[some], ends[some])
            entry[new] = len(bounds) - 1 + at
            bounds, pool = np.r_[bounds, (bounds[-1] + np.cumsum(n)).astype(np.int32)], np.r_[pool, more]
            if len(bounds) > SEGMENTS or len(pool) > IDS:
                self.clear()
            else:
                self.ends, self.pool = bounds, pool
                self.keys[slots[some]], self.entries[slots[some]] = keys[some], entry[some]
        begin = bounds[entry]
        n = bounds[entry + 1] - begin
        return pool[np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())], n


def encode(column: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """All token ids of a column of texts, and how many each text has; a null text has none. Strings of special tokens of a .json file are those tokens."""
    data, offsets = tx.flat(column)
    starts, ends, rows = segments(data, offsets)
    if not len(starts):
        return np.zeros(0, np.uint16), np.zeros(len(column), np.int64)
    if path not in _coders:
        _coders[path] = Coder(path)
    ids, n = _coders[path].encode(data, starts, ends)
    return ids, np.bincount(rows, weights=n, minlength=len(column)).astype(np.int64)
