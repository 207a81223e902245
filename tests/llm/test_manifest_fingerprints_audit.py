"""The Merkle manifest, the fingerprints and the filter audit against brute force and on odd inputs."""

import hashlib
import random
import re
import sys
import zlib
from itertools import permutations
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
from conftest import DATA, duck_rows, spark_rows  # noqa: E402

from pvspark.llm import filter_audit, fingerprints, merkle, queries  # noqa: E402

#: doc_id, text, lang, source: nulls in each column, repeated rows and ids, ties, and empty, blank and long texts.
ODD = [
    (1, "a\nb", "x", "s"), (1, "a\nb", "x", "s"), (2, None, None, None), (None, "q" * 70, "x", None), (None, None, None, ""), (4, "", "", ""), (8, "z\n", None, "é"), (3, " \t#A \n", "y", "s"),
    (3, "xxx", "y", "s"), (5, "a\nb", "y", "s"), (9, "word \n" * 70_000, "x", "s"), (10, "Žluť 漢字 😀 " * 40, "x", "t"), (11, "A" * 300, "x", "t"),
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, lang, s, None if t is None else len(t), "other", 7) for i, t, lang, s in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, tree string, part int").repartition(3)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def plain(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def result(df):
    return sorted(repr(tuple(r)) for r in df.collect())


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest(*out[-1][k : k + 3]) for k in range(0, len(out[-1]), 3)])
    return out


def siblings_of(levels, i):
    out = []
    for level in levels[:-1]:
        first = i - i % 3
        out.append((level[first:i], level[i + 1 : first + 3]))
        i //= 3
    return out


def manifest_brute(rows):
    def leaf(r, text):
        return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[0], r[3], r[2], r[4], text)))

    sources = sorted({r[3] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    members = {s: sorted((r for r in rows if r[3] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1]))) for s in sources}
    trees = {s: levels_of([leaf(r, r[1]) for r in own]) for s, own in members.items()}
    top = levels_of([trees[s][-1][0] for s in sources])
    out = []
    for k, s in enumerate(sources):
        for i, r in enumerate(members[s]):
            path = siblings_of(trees[s], i) + siblings_of(top, k)
            even = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[1] is not None
            at = leaf(r, r[1].replace("\n", "") if even else r[1])
            for left, right in path:
                at = digest(*left, at, *right)
            root = top[-1][0]
            out.append((r[0], trees[s][0][i], trees[s][-1][0], root, digest(*(d for x in path for side in x for d in side)), at, at == root))
    return sorted(map(repr, out))


COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def test_manifest_equals_brute_force_and_sql(spark, duck, documents):
    got = queries.queries()["op11_merkle_manifest"](spark, DATA)
    assert result(got) == manifest_brute(plain(documents, *COLUMNS))
    columns, rows = duck_rows(duck, queries.oracle_sql()["op11_merkle_manifest"])
    assert sorted(got.columns) == columns and spark_rows(got) == rows
    counts = {r.verified for r in got.select("verified").distinct().collect()}
    assert counts == {True, False}


def test_manifest_odd(odd):
    assert result(merkle.manifest(odd)) == manifest_brute(plain(odd, *COLUMNS))
    assert merkle.manifest(odd.where("doc_id = -1")).count() == 0
    (one,) = merkle.manifest(odd.where("doc_id = 10")).collect()
    assert one.leaf == one.subroot == one.root and one.proof_sha256 == digest()


@pytest.mark.parametrize("n", [2, 3, 4, 9, 10, 27, 28, 81, 82, 84, 243, 244, 730])
def test_manifest_of_all_shapes(spark, monkeypatch, n):
    """Trees that end within, at and just beyond a stored level."""
    monkeypatch.setattr(merkle, "LEVELS", 2)
    monkeypatch.setattr(merkle, "SUBTREE", 9)
    docs = spark.range(n).selectExpr("id AS doc_id", "concat('t\n', id) AS text", "'en' AS lang", "if(id % 5 = 0, 'hot', 'rest') AS source", "id AS n_chars")
    assert result(merkle.manifest(docs)) == manifest_brute(plain(docs, *COLUMNS))


def test_manifest_stores_every_few_levels_only(spark, documents):
    nodes = documents.selectExpr("'' AS tree", "doc_id AS pos", f"{documents.count()}L AS n", "sha2(text, 256) AS digest")
    levels, roots = merkle.climbed(nodes)
    assert [x.selectExpr("sum(size(nodes))").first()[0] for x in levels] == [200, 3]
    assert roots.first().digest == levels_of([r.digest for r in nodes.orderBy("pos").collect()])[-1][0]


def test_prefix_hashes_and_extensions():
    rng = random.Random(1)
    for _ in range(200):
        a = "".join(rng.choice("ab😀") for _ in range(rng.randrange(40)))
        b = a[rng.randrange(len(a) + 1) :] + "".join(rng.choice("ab") for _ in range(9))
        x, y = fingerprints.PrefixHashes(a), fingerprints.PrefixHashes(b)
        i, j = rng.randrange(len(a) + 1), rng.randrange(len(b) + 1)
        n = 0
        while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
            n += 1
        assert fingerprints.extension(x, i, y, j) == n
        for k in range(n + 2):
            assert fingerprints.equal(x, i, y, j, k) == (k <= n)
        for k, p in enumerate(fingerprints.PRIMES):
            h = 0
            for c in a:
                h = (h * fingerprints.BASES[k] + ord(c) + 1) % int(p)
            assert int(x.h[k][-1]) == h


def test_fingerprints_do_not_depend_on_blocks(monkeypatch):
    rng = random.Random(2)
    text = "".join(rng.choice("abcdefgh ") for _ in range(5000))
    whole, long = fingerprints.written(fingerprints.sample(text)), "".join(rng.choice("abcd") for _ in range(100_000))
    of_long = fingerprints.written(fingerprints.sample(long))
    document = fingerprints.Document(text)
    assert fingerprints.written(document.own) == whole
    for other in ("", "zzz", "zab " * 2000, text):
        assert fingerprints.written(document.edited(other)) == fingerprints.written(fingerprints.sample(fingerprints.edited(text, other)))
    assert fingerprints.written(fingerprints.read(whole)) == whole
    monkeypatch.setattr(fingerprints, "BLOCK", 37)
    assert fingerprints.written(fingerprints.sample(text)) == whole
    assert fingerprints.written(fingerprints.sample(long)) == of_long


def test_fingerprints_keep_what_the_prefix_array_holds():
    rng = random.Random(3)
    text = "".join(rng.choice("abcdefgh ") for _ in range(4000))
    s, whole = fingerprints.sample(text), fingerprints.PrefixHashes(text)
    one = lambda k: int(whole.h[0][k]) << 31 | int(whole.h[1][k])
    assert s.grid.tolist() == [one(k) for k in range(1 << s.scale, s.n + 1, 1 << s.scale)]
    assert [int(h) for h in s.hashes] == [one(k) for k in s.places.tolist()]
    assert 10 < len(s.places) < 200


def test_likeness():
    rng = random.Random(4)
    new = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    like = lambda a, b: fingerprints.likeness(*(fingerprints.read(fingerprints.written(fingerprints.sample(t))) for t in (a, b)))
    for n in (40, 300, 3000, 90_000):
        a = new(n)
        assert like(a, a) == 1 and like(a, new(n)) < (0.05 if n > 40 else 0.5)
        many = a[: n // 3] + "XY" + a[n // 3 : n // 2] + a[n // 2 + 2 :] + "Z"
        assert like(a, many) == like(many, a) > (0.6 if n > 40 else 0.4)
        assert 0.65 < like(a, fingerprints.edited(a, new(n))) < 0.9
    assert like("", "") == 1 and like("", "a") == 0 == like("ab", "cd")
    assert like("ab" * 50_000, "ab" * 50_000 + "c") > 0.9


def fingerprint_brute(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    out = []
    for k, (doc_id, text) in enumerate(rows):
        text, following = text or "", rows[(k + 1) % len(rows)][1] or ""
        q = len(text) // 4
        changed = text[: len(text) - q] + following[:q]
        a, b, c = map(fingerprints.sample, (text, changed, following))
        out.append((doc_id, len(text), digest(changed), fingerprints.written(a), fingerprints.written(b), fingerprints.likeness(a, b), fingerprints.likeness(a, c)))
    return sorted(map(repr, out))


def test_fingerprints_equal_brute_force(spark, documents):
    got = queries.queries()["op12_fingerprints"](spark, DATA)
    assert result(got) == fingerprint_brute(plain(documents, "doc_id", "text"))
    rows = got.collect()
    assert min(r.near_edited for r in rows) > 0.7 and np.median([r.near_next for r in rows]) < 0.05


def test_fingerprints_odd(spark, odd):
    named = odd.withColumnRenamed("tree", "guest")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("1", "4", "50"):  # also more ranges than ids
            spark.conf.set("spark.sql.shuffle.partitions", n)
            assert result(fingerprints.fingerprints(named)) == fingerprint_brute(plain(odd, "doc_id", "text"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    for where in ("doc_id = -1", "doc_id = 8", "doc_id is null", "doc_id = 1"):
        some = odd.where(where)
        assert result(fingerprints.fingerprints(some)) == fingerprint_brute(plain(some, "doc_id", "text"))


def audit_brute(docs, labels):
    own, least, rows = {}, {}, []
    for i, quality, toxic in labels:
        had = own.get(i, (False, False))
        own[i] = (had[0] or quality == 1, had[1] or toxic == 1)
    for i, text, _ in docs:
        if i is not None:
            least[text or ""] = min(least.get(text or "", i), i)
    for i, text, lang in docs:
        text = text or ""
        w = re.findall("[^\x20\x09-\x0d]+", text)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), "D": bool(re.search("[#$%&*|]", text)), "E": i is not None and least[text] < i}
        rows.append((lang or "", fails, own.get(i, (False, False)) if i is not None else (False, False)))
    out = []
    for part in {r[0] for r in rows}:
        shares, found = dict.fromkeys("ABCDE", 0), []
        for order in map("".join, permutations("ABCDE")):
            alive = [r for r in rows if r[0] == part]
            everyone = list(alive)
            for step, f in enumerate(order, 1):
                gone = [r for r in alive if r[1][f]]
                redundant = sum(r[1][f] for r in everyone) - len(gone)
                alive = [r for r in alive if not r[1][f]]
                shares[f] += len(gone)
                found.append((part, order, step, len(alive), len(gone), redundant, sum(r[1][f] and sum(r[1].values()) == 1 for r in everyone), sum(r[2][0] for r in gone), sum(r[2][1] for r in gone), f))
        out += [(*r[:-1], shares[r[-1]]) for r in found]
    return sorted(map(repr, out))


def test_audit_equals_brute_force_and_sql(spark, duck, documents):
    got = queries.queries()["op13_filter_audit"](spark, DATA)
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    assert result(got) == audit_brute(plain(documents, "doc_id", "text", "lang"), plain(labels, "doc_id", "quality", "toxic"))
    columns, rows = duck_rows(duck, queries.oracle_sql()["op13_filter_audit"])
    assert sorted(got.columns) == columns and spark_rows(got) == rows


def test_audit_odd(spark, odd):
    labels = [(1, 1, 0), (1, 0, 1), (5, None, 1), (None, 1, 1), (3, 1, None), (99, 1, 1)]
    table = spark.createDataFrame([(*x, "y") for x in labels], "doc_id long, quality int, toxic int, text string")
    docs = plain(odd, "doc_id", "text", "lang")
    assert result(filter_audit.audit(odd, table)) == audit_brute(docs, labels)
    assert result(filter_audit.audit(odd, table.where("doc_id = -1"))) == audit_brute(docs, [])
    assert filter_audit.audit(odd.where("doc_id = -1"), table).count() == 0
