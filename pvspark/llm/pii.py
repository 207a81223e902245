"""Personal data: fixed expressions give the base spans, and a semi-Markov conditional random field adds spans that they miss.

The field looks at compounds: runs of text without white space that hold a digit, an @ or an (at), joined where one space stands between two of
them. Any other segment has no digit and no @, which no entity is without, so it is outside. In a compound, each run of up to MAX_TOKENS tokens
is scored as a whole for each kind, and dynamic programming picks the boundaries and kinds of the best cover jointly.

It is fitted on compounds of a bounded sample of documents, with the base spans as labels, and on rewritten ones: "(at)" for "@", phone numbers
without "+", cards in groups with dots; these are kinds of writing that the expressions miss. Added spans never overlap base spans.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pvspark.llm import text as tx

KINDS = ("email", "ip", "card", "phone")
MAX_TOKENS = 24
#: Tokens whose segments are scored at once.
TOKENS = 2048
#: About how many documents the field is fitted on, and how many compounds.
SAMPLE_DOCS, SAMPLE_COMPOUNDS = 3000, 250

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_PART = re.compile(r"[0-9]+")
_TRIGGER = re.compile(r"[0-9@]|[(\[]at[)\]]")
_CHUNK = re.compile(r"\S+")
_TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|\s|.", re.S)
_EMAIL_SHAPE = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")
_PHONE_SHAPE = re.compile(r"\+?[0-9 ]*\(?[0-9]{2,4}\)?[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}")
_GROUPS = re.compile(r"[0-9]{4}(?:[ .-][0-9]{4}){2,3}(?:[ .-][0-9]{1,3})?")
_DATE = re.compile(r"[0-9]{2,4}[-./][0-9]{1,2}[-./][0-9]{1,4}")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base(text: str) -> list[tuple[str, int, int]]:
    """The base spans (kind, start, end exclusive), leftmost and non-overlapping for each kind, by start, then kind. Linear in the text."""
    out, past, at = [], 0, text.find("@")
    while at >= 0:
        m, start = _DOMAIN.match(text, at + 1), at
        if m:
            while start > past and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                out.append(("email", start, m.end()))
                past = m.end()
        at = text.find("@", at + 1)
    for m in _DOTTED.finditer(text):
        parts = [x.span() for x in _PART.finditer(text, *m.span())]
        for k in range(0, len(parts) - 3, 4):
            if all(len(p := text[a:b].lstrip("0")) < 4 and int(p or 0) < 256 for a, b in parts[k : k + 4]):
                out.append(("ip", parts[k][0], parts[k + 3][1]))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append(("phone", *m.span()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def compounds(text: str) -> Iterator[tuple[int, int]]:
    """Where a text's compounds start and end."""
    begin = end = at = 0
    while m := _TRIGGER.search(text, at):
        a = m.start()
        while a > end and not text[a - 1].isspace():
            a -= 1
        b = _CHUNK.match(text, m.start()).end()
        if m[0][-1] in ")]" and b - a == 4:  # a lone (at) takes the words on both sides
            while a > max(end + 1, 1) and text[a - 1] == " " and not text[a - 2].isspace():
                a -= 2
                while a > end and not text[a - 1].isspace():
                    a -= 1
                break
            after = _CHUNK.match(text, b + 1) if text[b : b + 1] == " " else None
            b = after.end() if after else b
        if end and a == end + 1 and text[end] == " ":
            end = b
        else:
            if end:
                yield begin, end
            begin, end = a, b
        at = b
    if end:
        yield begin, end


NAMES = (
    "bias", "at", "written_at", "one_at", "email_shape", "loose_edge", "digits_0", "digits_1_6", "digits_7_8", "digits_9_11", "digits_12_15", "digits_16", "digits_17_19", "luhn", "not_luhn",
    "ip", "not_ip", "plus", "brackets", "phone_shape", "letters", "all_digits", "groups", "before", "after", "date", "spaces", "long", "symbols",
)
N_FEATURES = len(NAMES)
_AT = re.compile(r"[(\[]at[)\]]")
_SPACED_AT = re.compile(r"\s*[(\[]at[)\]]\s*")


def _is(c: np.ndarray, of: str) -> np.ndarray:
    return np.isin(c, [ord(x) for x in of])


_TO_NINE, _SHAPES = str.maketrans("012345678", "9" * 9), [NAMES.index(k) for k in ("phone_shape", "groups", "date")]


@lru_cache(1 << 16)
def shapes(s: str) -> tuple[bool, bool, bool]:
    """Whether a segment, with 9 for each digit, has the shape of a phone number, of groups of a card's digits, of a date."""
    return len(s) < 40 and bool(_PHONE_SHAPE.fullmatch(s)), bool(_GROUPS.fullmatch(s)), bool(_DATE.fullmatch(s))


def segments(text: str, cuts: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The candidate segments whose last token is one of low to high - 1: first token, last token + 1, and whole-span features.

    A candidate begins and ends without white space, has MAX_TOKENS tokens at most, and an @ or (at), or from 4 to 19 digits: no entity has less, or
    more without an @. Counts of characters come from sums along the text; only shapes of segments with fitting counts are matched one by one."""
    first = max(0, low - MAX_TOKENS + 1)
    origin, sub = cuts[first], text[cuts[first] : cuts[high]]
    c = np.frombuffer(sub.encode("utf-32-le", "surrogatepass"), np.uint32)
    upto = lambda kind: np.r_[0, np.cumsum(kind)]
    digit, alpha = (c >= 48) & (c < 58), np.fromiter(map(str.isalpha, sub), bool, len(sub)) if len(c) else np.zeros(0, bool)
    space = np.fromiter(map(str.isspace, sub), bool, len(sub)) if len(c) else np.zeros(0, bool)
    n_digit, n_at, n_dot, n_alpha, n_space, n_open, n_close, n_odd = map(upto, (digit, c == 64, c == 46, alpha, c == 32, c == 40, c == 41, _is(c, "!?$&*/\\'\"=<>|~^")))
    written = [m.span() for m in _AT.finditer(sub)]
    begun, ended = np.zeros(len(c) + 2, np.int64), np.zeros(len(c) + 2, np.int64)
    for x, y in written:
        begun[x + 1] += 1
        ended[y] += 1
    begun, ended = np.cumsum(begun), np.cumsum(ended)
    j = np.repeat(np.arange(low + 1, high + 1), MAX_TOKENS)
    i = j - np.tile(np.arange(1, MAX_TOKENS + 1), high - low)
    i, j = i[i >= 0], j[i >= 0]
    a, b = cuts[i] - origin, cuts[j] - origin
    d, at, w = n_digit[b] - n_digit[a], n_at[b] - n_at[a], np.maximum(0, ended[b] - begun[a])
    ok = ~space[a] & ~space[b - 1] & ((at + w > 0) | ((d >= 4) & (d <= 19)))
    i, j, a, b, d, at, w = (x[ok] for x in (i, j, a, b, d, at, w))
    x = np.zeros((len(i), N_FEATURES))
    size, dots, letters = b - a, n_dot[b] - n_dot[a], n_alpha[b] - n_alpha[a]
    edge_before = np.fromiter((sub[k - 1] if k else text[origin - 1 : origin] for k in a.tolist()), "U1", len(a))
    edge_after = np.fromiter((text[origin + k : origin + k + 1] for k in b.tolist()), "U1", len(b))
    word = lambda e, more: np.char.isalnum(e) | ((e != "") & np.isin(e, list(more)))
    card, dotted = (d >= 12) & (d <= 19), (dots == 3) & (d + 3 == size)
    columns = {
        "bias": True, "at": at > 0, "written_at": w > 0, "one_at": at + w == 1, "loose_edge": _is(c[b - 1], " .,;:-(@+[") | _is(c[a], " .,;:-)@]"), "digits_0": d == 0, "digits_1_6": (d > 0) & (d < 7),
        "digits_7_8": (d > 6) & (d < 9), "digits_9_11": (d > 8) & (d < 12), "digits_12_15": (d > 11) & (d < 16), "digits_16": d == 16, "digits_17_19": (d > 16) & (d < 20), "plus": c[a] == 43,
        "brackets": (n_open[b] > n_open[a]) & (n_close[b] > n_close[a]), "letters": letters > 0, "all_digits": d == size, "before": word(edge_before, "@.-+"), "after": word(edge_after, "@"),
        "spaces": n_space[b] > n_space[a], "long": j - i > 8, "symbols": n_odd[b] > n_odd[a],
    }
    for name, value in columns.items():
        x[:, NAMES.index(name)] = value
    put = lambda k, name, value=True: x.__setitem__((k, NAMES.index(name)), value)
    for k in np.flatnonzero(columns["one_at"] & (size <= 320)).tolist():
        put(k, "email_shape", bool(_EMAIL_SHAPE.fullmatch(_SPACED_AT.sub("@", sub[a[k] : b[k]]))))
    for k in np.flatnonzero(dotted).tolist():
        good = all(p and len(p) < 4 and int(p) < 256 for p in sub[a[k] : b[k]].split("."))
        put(k, "ip" if good else "not_ip")
    value = c[digit].astype(np.int64) - 48
    double, even = value * 2 - 9 * (value > 4), np.arange(len(value)) % 2 == 0
    sums = [upto(np.where(even, value, double)), upto(np.where(even, double, value))]  # the undoubled digits are those of the last one's parity
    p, q = n_digit[a], n_digit[b]
    checked = np.where(q % 2 == 1, sums[0][q] - sums[0][p], sums[1][q] - sums[1][p]) % 10 == 0
    x[:, NAMES.index("luhn")], x[:, NAMES.index("not_luhn")] = card & (letters == 0) & checked, card & (letters == 0) & ~checked
    plain = sub.translate(_TO_NINE)
    for k in np.flatnonzero((letters == 0) & (at + w == 0)).tolist():
        x[k, _SHAPES] = shapes(plain[a[k] : b[k]])
    return i, j, x


def token_cuts(text: str) -> np.ndarray:
    return np.fromiter((0, *(m.end() for m in _TOKEN.finditer(text))), np.int64)


def best(text: str, weights: np.ndarray) -> list[tuple[int, int, int]]:
    """The entities (start, end, kind) of the best cover of a compound by dynamic programming; a token outside entities scores 0. It goes along the
    tokens, TOKENS of them at a time, and keeps two numbers for each; a segment that scores no more than 0 is never part of the best cover."""
    cuts = token_cuts(text)
    n = len(cuts) - 1
    value, back, kinds = np.zeros(n + 1), np.full(n + 1, -1, np.int64), np.zeros(n + 1, np.int8)
    for low in range(0, n, TOKENS):
        high = min(n, low + TOKENS)
        i, j, x = segments(text, cuts, low, high)
        score = x @ weights.T
        top, kind = score.max(axis=1), score.argmax(axis=1)
        into: dict[int, list] = {}
        for k in np.flatnonzero(top > 0).tolist():
            into.setdefault(int(j[k]), []).append((int(i[k]), float(top[k]), int(kind[k])))
        for end in range(low + 1, high + 1):
            value[end] = value[end - 1]
            for start, s, of in into.get(end, ()):
                if value[start] + s > value[end]:
                    value[end], back[end], kinds[end] = value[start] + s, start, of
    out, j = [], n
    while j:
        if back[j] < 0:
            j -= 1
        else:
            out.append((int(cuts[back[j]]), int(cuts[j]), int(kinds[j])))
            j = int(back[j])
    return out[::-1]


class Lattice:
    """All candidate segments of a labelled compound (tokens i to j) with their features, for the fit."""

    def __init__(self, text: str):
        self.cuts = token_cuts(text)
        i, j, self.x = segments(text, self.cuts, 0, len(self.cuts) - 1)
        self.spans = list(zip(i.tolist(), j.tolist(), strict=True))

    def gradient(self, weights: np.ndarray, gold: np.ndarray) -> np.ndarray:
        """Of the log-likelihood of the labelled cover: observed minus expected features. gold: segments by kinds, 1 where labelled."""
        score = self.x @ weights.T
        n, total = len(self.cuts) - 1, np.logaddexp.reduce(score, axis=1) if self.spans else np.zeros(0)
        ahead, behind = np.zeros(n + 1), np.zeros(n + 1)
        at, to = {}, {}
        for k, (i, j) in enumerate(self.spans):
            at.setdefault(j, []).append((i, total[k]))
            to.setdefault(i, []).append((j, total[k]))
        for j in range(1, n + 1):
            ahead[j] = np.logaddexp.reduce([ahead[j - 1], *(ahead[i] + s for i, s in at.get(j, ()))])
        for i in range(n - 1, -1, -1):
            behind[i] = np.logaddexp.reduce([behind[i + 1], *(behind[j] + s for j, s in to.get(i, ()))])
        i, j = np.array(self.spans, int).reshape(-1, 2).T
        p = np.exp(np.minimum(0, ahead[i][:, None] + score + behind[j][:, None] - ahead[n]))
        return (gold - p).T @ self.x


def rewritten(text: str, spans: list[tuple[str, int, int]]) -> Iterator[tuple[str, list[tuple[str, int, int]]]]:
    """A compound with one labelled entity in ways of writing that the expressions miss."""
    for kind, a, b in spans if len(spans) == 1 else ():
        s = text[a:b]
        for new in {
            "email": [s.replace("@", x) for x in ("(at)", "[at]", " (at) ", " [at] ")],
            "phone": [s.removeprefix("+"), re.sub(r"^\+[0-9]+ ", "", s), re.sub(r"^\+[0-9]+ ", "", s).replace("(", "").replace(") ", "-").replace(" ", "-")],
            "card": [x.join(re.findall(".{1,4}", s)) for x in (" ", "-", ".")] if s.isdigit() else [],
        }.get(kind, []):
            yield text[:a] + new + text[b:], [(kind, a, a + len(new))]


#: Text with digits that is not personal data, for the fit.
PLAIN = ("2024-10-12", "3.14159", "1,234,567", "12:30", "v2.10.3", "300.12.999.4", "1.2.3", "10%", "(1998)", "4845168114407320", "4845 1681 1440 7320", "123456789", "00000", "20,000", "5-7", "[12]", "No. 8", "1st", "a1b2c3", "3x4", "555-12", "user@", "@home", "2,5 (3)")


def fit(found: list[tuple[str, list[tuple[str, int, int]]]], steps: int = 50) -> np.ndarray:
    """Weights (kinds by features) from labelled compounds, by gradient ascent with a Gaussian prior. Without compounds, from the rewritten seeds."""
    seeds = [("jo.doe@mail.org", [("email", 0, 15)]), ("10.1.200.7", [("ip", 0, 10)]), ("4111111111111111", [("card", 0, 16)]), ("+1 (212) 555-0100", [("phone", 0, 17)]), ("bob@mail.com, 300", [("email", 0, 12)]), ("mail ann@site.net 42", [("email", 5, 17)])]
    every = {}
    for text, spans in [*seeds, *((x, []) for x in PLAIN), *found]:
        every.setdefault(text, spans)
        every.update({t: s for t, s in rewritten(text, spans) if t not in every})
    cases = []
    for text, spans in every.items():
        lattice = Lattice(text)
        gold = np.zeros((len(lattice.spans), len(KINDS)))
        where = {(lattice.cuts[i], lattice.cuts[j]): k for k, (i, j) in enumerate(lattice.spans)}
        taken = 0
        for kind, a, b in spans:
            if a >= taken and (a, b) in where:
                gold[where[a, b], KINDS.index(kind)], taken = 1, b
        if len(lattice.spans):
            cases.append((lattice, gold))
    w = np.zeros((len(KINDS), N_FEATURES))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        g = sum(lattice.gradient(w, gold) for lattice, gold in cases) / len(cases) - 1e-4 * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w += 0.3 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    return w


def find(text: str | None, weights: np.ndarray) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and all spans, of a text; a null text is empty."""
    text = text or ""
    first = base(text)
    added, starts, reach = [], [s[1] for s in first], list(accumulate((s[2] for s in first), max))
    for a, b in compounds(text):
        if b - a < 7:  # shorter ones hold no entity: 7 digits or a@b.com at least
            continue
        inside = [s for s in first[bisect_right(reach, a) : bisect_left(starts, b)] if a < s[2]]
        if len(inside) == 1 and inside[0][1:] == (a, b):
            continue
        for x, y, kind in best(text[a:b], weights):
            before = bisect_left(starts, a + y)  # base spans that start before the entity ends; whether one of them ends after its start
            if not before or reach[before - 1] <= a + x:
                added.append((KINDS[kind], a + x, a + y))
    return first, sorted(first + added, key=lambda s: (s[1], KINDS.index(s[0])))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """A text with <KIND> for each span; of overlapping spans the first, and then the longest, is masked and the rest of the others too."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if b > at:
            out += [text[at:a], f"<{kind.upper()}>"] if a >= at else []
            at = b
    return "".join([*out, text[at:]])


def trained(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_compounds: int = SAMPLE_COMPOUNDS) -> np.ndarray:
    """Weights from compounds of about `sample_docs` documents, chosen by a hash of their rows; of compounds of one shape one is taken, so copies of a
    document count once. Only the compounds of the tasks' shapes are shuffled, and `sample_compounds` of them come to the driver."""
    step = max(1, docs.count() // sample_docs)

    def label(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for text in frame["text"].dropna():
                spans = base(text)
                for a, b in compounds(text):
                    if b - a <= 120:
                        rows.append((text[a:b], joined([(k, x - a, y - a) for k, x, y in spans if a <= x and y <= b])))
            yield pd.DataFrame(rows, columns=["compound", "spans"])

    some = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(step)) == 0).select("text")
    found = some.mapInPandas(tx.tidy(label), "compound string, spans string").withColumn("shape", F.regexp_replace(F.regexp_replace("compound", "[A-Za-z]+", "a"), "[0-9]", "9")).groupBy("shape").agg(F.min_by(F.struct("compound", "spans"), F.xxhash64("compound")).alias("c")).select("c.*").orderBy(F.xxhash64("compound"), "compound").limit(sample_compounds).collect()
    return fit([(r.compound, [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in r.spans.split(",") if s)]) for r in found])


def personal_data(docs: DataFrame, weights: np.ndarray | None = None) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, counts of the base kinds, a digest of the base spans, all spans as kind:start:end, and their number.
    Null texts have no spans; null ids and repeated rows stay; other columns do not matter."""
    w = trained(docs) if weights is None else weights

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for text in frame["text"]:
                first, every = find(text, w)
                rows.append((*(sum(s[0] == k for s in first) for k in KINDS), hashlib.sha256(joined(first).encode()).hexdigest(), joined(every), len(every)))
            out = pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_spans"])
            out.insert(0, "doc_id", frame["doc_id"].to_numpy())
            yield out

    return docs.select("doc_id", "text").mapInPandas(tx.tidy(scan), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long")


def redacted(docs: DataFrame, weights: np.ndarray | None = None) -> DataFrame:
    """The documents with <EMAIL>, <IP>, <CARD> or <PHONE> in place of personal data; n_chars, where there is one, counts the new text.
    All other columns stay, and so do null texts."""
    w = trained(docs) if weights is None else weights

    def change(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(text=[t if t is None else masked(t, find(t, w)[1]) for t in frame["text"]])

    out = docs.mapInPandas(tx.tidy(change), docs.schema)
    return out.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op1_pii(spark, sf_dir: str) -> DataFrame:
    return personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
