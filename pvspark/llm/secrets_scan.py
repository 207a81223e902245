"""Secret scans: an Aho-Corasick automaton finds keywords, anchored expressions look only near its hits, and checksums that are embedded in a
secret decide whether it is one.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from pvspark.llm import text as tx

#: Kinds in the order in which spans of one start are listed; the first three are the base kinds.
KINDS = ("assign", "access", "hex", "github", "npm", "jwt", "private_key", "xprv", "age")

# Anchored at a keyword. The keyword part is matched on lower-cased text, where A-Z and a-z are alike.
_ASSIGN = re.compile(r"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([a-z0-9+/_.=-]+)")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_GITHUB = re.compile(r"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
_NPM = re.compile(r"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
_JWT = re.compile(r"(eyJ[A-Za-z0-9_-]++)\.(eyJ[A-Za-z0-9_-]++)\.[A-Za-z0-9_-]++")
_URL64 = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-")
_XPRV = re.compile(r"xprv[1-9A-HJ-NP-Za-km-z]{107}(?![1-9A-HJ-NP-Za-km-z])")
_AGE = re.compile(r"AGE-SECRET-KEY-1([QPZRY9X8GF2TVDW0S3JN54KHCE6MUA7L]{58})(?![A-Z0-9])")
_KEY = re.compile(r"-----BEGIN ([A-Z ]*)PRIVATE KEY-----([A-Za-z0-9+/=\s]+)-----END \1PRIVATE KEY-----")

# Keywords (lower case) and what to look for at their place.
KEYWORDS = {
    "password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "apikey": "assign", "api_key": "assign", "akia": "access",
    "ghp_": "github", "gho_": "github", "ghu_": "github", "ghs_": "github", "ghr_": "github", "npm_": "npm", "eyj": "jwt", "-----begin ": "private_key",
    "xprv": "xprv", "age-secret-key-1": "age",
}

# The alphabets of base-62, base-58 and Bech32 digits, and Bech32's generator.
_BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
_BECH32 = "qpzry9x8gf2tvdw0s3jn54khce6mua7l"
_GENERATOR = (0x3B6A57B2, 0x26508E6D, 0x1EA119FA, 0x3D4233DD, 0x2A1462B3)
_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_automata: list = []


def automaton():
    if not _automata:
        import ahocorasick

        a = ahocorasick.Automaton()
        for word, kind in KEYWORDS.items():
            a.add_word(word, (len(word), kind))
        a.make_automaton()
        _automata.append(a)
    return _automata[0]


def base62_crc(body: str) -> str:
    """CRC-32 of a token's body as six base-62 digits: the checksum at the end of tokens of the kinds github and npm."""
    n, out = zlib.crc32(body.encode()), ""
    while n:
        n, d = divmod(n, 62)
        out = _BASE62[d] + out
    return out.rjust(6, "0")


def decodes(part: str) -> bool:
    """Whether base64url text holds a JSON object."""
    try:
        return isinstance(json.loads(base64.urlsafe_b64decode(part + "=" * (-len(part) % 4))), dict)
    except (ValueError, RecursionError):
        return False


def is_der(body: str) -> bool:
    """Whether base64 text decodes to an ASN.1 sequence of exactly its stated length, or to a key file with its own header."""
    try:
        raw = base64.b64decode(re.sub(r"\s+", "", body), validate=True)
    except binascii.Error:
        return False
    if raw.startswith(b"openssh-key-v1\0"):
        return True
    if len(raw) < 2 or raw[0] != 0x30:
        return False
    if raw[1] < 128:
        return len(raw) == raw[1] + 2
    k = raw[1] & 127
    return 0 < k <= 4 and len(raw) == int.from_bytes(raw[2 : 2 + k], "big") + 2 + k


def is_base58_checked(token: str) -> bool:
    """Whether base-58 text ends with the first four bytes of its payload's double SHA-256."""
    n = 0
    for c in token:
        n = n * 58 + _BASE58.index(c)
    raw = n.to_bytes(82, "big")
    return hashlib.sha256(hashlib.sha256(raw[:-4]).digest()).digest()[:4] == raw[-4:]


def is_bech32(prefix: str, data: str) -> bool:
    """Whether Bech32 data (lower case) has the checksum that goes with its prefix."""
    check = 1
    for v in [*(ord(c) >> 5 for c in prefix), 0, *(ord(c) & 31 for c in prefix), *map(_BECH32.index, data)]:
        top, check = check >> 25, (check & 0x1FFFFFF) << 5 ^ v
        for k, g in enumerate(_GENERATOR):
            check ^= g if top >> k & 1 else 0
    return check == 1


def find(text: str | None) -> list[tuple[str, int, int]]:
    """Spans (kind, start, end exclusive) of a text in code points, by start, then kind. A null text is empty. Linear in the text.

    All kinds but hex are looked for at keyword hits only; runs of hex digits have no keyword, so they are found by one scan of the whole text."""
    if not text:
        return []
    low, out, past = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"), [], dict.fromkeys(KINDS, 0)
    for last, (length, kind) in automaton().iter(low):
        start = last + 1 - length
        if start < past[kind]:
            continue
        if kind == "assign":
            m = _ASSIGN.match(low, start)
            good = m and len(m[1]) >= 6
        elif kind == "access":
            m = _ACCESS.match(text, start)
            good = m and m.end() - start >= 20
        elif kind == "jwt":  # only at the start of a run, so each run is read a few times at most, however often the keyword stands in it
            m = None if start and text[start - 1] in _URL64 else _JWT.match(text, start)
            good = m and decodes(m[1]) and decodes(m[2])
        elif kind == "private_key":
            m = _KEY.match(text, start)
            good = m and is_der(m[2])
        elif kind == "xprv":
            m = _XPRV.match(text, start)
            good = m and is_base58_checked(m[0])
        elif kind == "age":
            m = _AGE.match(text, start)
            good = m and is_bech32("age-secret-key-", m[1].lower())
        else:
            m = (_GITHUB if kind == "github" else _NPM).match(text, start)
            good = m and base62_crc(m[1]) == m[2]
        if m:
            past[kind] = m.end()
            if good:
                out.append((kind, start, m.end()))
    out += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def joined(found: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def _scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = []
        for text in frame["text"]:
            every = find(text)
            base = [s for s in every if s[0] in KINDS[:3]]
            count = [sum(s[0] == k for s in base) for k in KINDS[:3]]
            rows.append((*count, hashlib.sha256(joined(base).encode()).hexdigest(), joined(every), len(every)))
        out = pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_spans"])
        out.insert(0, "doc_id", frame["doc_id"].to_numpy())
        yield out


def secrets(docs: DataFrame) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, counts of the base kinds, a digest of their spans, all spans as kind:start:end, and their number.
    Null texts have no spans; a null id and repeated rows stay; other columns do not matter."""
    return docs.select("doc_id", "text").mapInPandas(tx.tidy(_scan), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_spans long")


def op5_secrets(spark, sf_dir: str) -> DataFrame:
    return secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
