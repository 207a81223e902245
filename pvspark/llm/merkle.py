"""A Merkle manifest of a dataset by checkpoint and recompute.

The rows of each source are the leaves of a tree whose nodes have up to three children; the sources' subroots are the leaves of one more tree.
Only every LEVELS-th level of a tree is stored, as aligned subtrees: a row holds the up to 3**LEVELS consecutive nodes under one node of the next
stored level. Climbing keeps nothing of the levels between. A proof is extracted from the top down: each subtree makes its missing inner nodes again
from its stored ones, adds their siblings to the path that came from above, and drops them.

All hashing is done with Spark's own functions. No group is larger than a subtree, and no source is ever in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pvspark.llm.shared import dropped, stored

#: Children of a node, and levels from one stored level to the next.
ARITY, LEVELS = 3, 4
SUBTREE = ARITY**LEVELS

NODE = "struct<left:string,right:string>"


def sha256(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """A value of a leaf: `-` for null, else its UTF-8 bytes' count, a colon, and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(text: Column) -> Column:
    """The digest of a row of documents with this text."""
    return sha256(*(field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")), field(text))


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows (tree, ...) with their place pos from 0 in the order within their tree, and the tree's number of rows n, both long.

    Ranges of (tree, order) are sorted by themselves and stored; where each range's part of a tree begins follows from the counts of the ranges before,
    one row for each range and tree.
    """
    keys = ["tree", *order]
    ranges = stored(rows.repartitionByRange(*(F.col(c).asc_nulls_first() for c in keys)).sortWithinPartitions(*(F.col(c).asc_nulls_first() for c in keys)).withColumn("_at", F.monotonically_increasing_id()))
    ranges = ranges.withColumn("_range", F.shiftright("_at", 33))
    part = ranges.groupBy("tree", "_range").agg(F.count("*").alias("_size"), F.min("_at").alias("_first"))
    tree = Window.partitionBy("tree")
    before = F.coalesce(F.sum("_size").over(tree.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    part = part.select("tree", "_range", "_first", before.alias("_before"), F.sum("_size").over(tree).alias("n"))
    return ranges.join(part, ["tree", "_range"]).withColumn("pos", F.col("_at") - F.col("_first") + F.col("_before")).drop("_at", "_range", "_first", "_before")


def subtrees(nodes: DataFrame) -> DataFrame:
    """Nodes (tree, pos, n, digest, ...) of one level as stored aligned subtrees (tree, block, n, nodes: their other columns by pos)."""
    rest = [c for c in nodes.columns if c not in ("tree", "n", "pos")]
    block = F.floor(F.col("pos") / SUBTREE).alias("block")
    return stored(nodes.groupBy("tree", block, "n").agg(F.sort_array(F.collect_list(F.struct("pos", *rest))).alias("nodes")))


def levels() -> Column:
    """All levels of a subtree, from its nodes up to the one node on top. In a tree of one subtree the levels end with the first that has a single node."""

    def up(done: Column, _: Column) -> Column:
        last = F.element_at(done, -1)
        runs = F.sequence(F.lit(0), F.floor((F.size(last) - 1) / ARITY).cast("int"))
        return F.when((F.size(last) == 1) & (F.col("n") <= SUBTREE), done).otherwise(F.concat(done, F.array(F.transform(runs, lambda r: F.sha2(F.concat_ws("", F.slice(last, r * ARITY + 1, ARITY)), 256)))))

    return F.aggregate(F.sequence(F.lit(1), F.lit(LEVELS)), F.array(F.col("nodes.digest")), up)


def climbed(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The stored levels of trees, as subtrees, from the nodes of the lowest one; and the root of each tree (tree, digest)."""
    out, deepest = [], None
    while deepest is None or deepest > 1:
        out.append(subtrees(nodes))
        top = F.element_at(F.element_at(levels(), -1), 1)
        # in a step of its own: beside another n, the n within the fold would mean that one
        nodes = out[-1].withColumn("digest", top).select("tree", F.col("block").alias("pos"), F.ceil(F.col("n") / SUBTREE).alias("n"), "digest")
        deepest = out[-1].agg(F.max(F.ceil(F.col("n") / SUBTREE))).first()[0] or 0
    return out, nodes.select("tree", "digest")


def siblings(i: Column) -> Column:
    """The path of a subtree's i-th node (from 0) inside it: for each level, the digests left and right of the path's node in its run, joined."""

    def step(level: Column, k: Column) -> Column:
        at = F.floor(i / F.element_at(F.array(*(F.lit(ARITY**j) for j in range(LEVELS + 1))), k + 1)).cast("int")
        first = at - at % ARITY
        return F.struct(F.concat_ws("", F.slice(level, first + 1, at - first)).alias("left"), F.concat_ws("", F.slice(level, at + 2, first + ARITY - 1 - at)).alias("right"))

    return F.transform(F.slice(F.col("_levels"), 1, F.size("_levels") - 1), step)


def paths(levels_down: list[DataFrame], above: DataFrame | None = None) -> DataFrame:
    """The nodes of the lowest stored level with their paths to the very top, and what else `above` has for their trees.

    above: (tree, pos = 0, path: from the tree's root upwards, ...), or none if the trees' roots are the very top; levels_down: what climbed() stored.
    """
    rest = [c for c in above.columns if c not in ("tree", "pos", "path")] if above is not None else []
    for k, level in reversed(list(enumerate(levels_down))):
        here = level.withColumn("path", F.array().cast(f"array<{NODE}>")) if above is None else level.join(above.withColumnRenamed("pos", "block"), ["tree", "block"])
        here = here.withColumn("_levels", levels())
        nodes = here.select("tree", *rest, "path", "_levels", F.posexplode("nodes").alias("_i", "_node"))
        whole = nodes.select("tree", *rest, F.concat(siblings(F.col("_i")), "path").alias("path"), "_node.*")
        above = whole if k == 0 else stored(whole.drop("digest"))
    return above


def folded(digest: Column, path: Column) -> Column:
    """The root that a leaf's digest and a path of siblings give."""
    return F.aggregate(path, digest, lambda at, s: sha256(s["left"], at, s["right"]))


def joined(path: Column) -> Column:
    """All digests of a path, level by level, left to right."""
    return F.concat_ws("", F.transform(path, lambda s: F.concat(s["left"], s["right"])))


def proofs(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """One row for each row of docs (doc_id, source, lang, n_chars, text): doc_id, leaf, subroot, root, the path of siblings (array of left and right for each
    level), and the digest of the row with the text `tampered` in place of its own, as now_leaf.

    Sources are ordered by their UTF-8 bytes, null first and apart from an empty one; leaves by doc_id, null first, then by digest, so that repeated rows
    and ids have a defined place. A tree of one leaf has an empty path. Without rows there is no root, and the result is empty. Other columns do not matter.
    """
    source = F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))  # null sorts before every other
    now = leaf(F.col("text")) if tampered is None else leaf(tampered)
    leaves = stored(docs.select(source.alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), leaf(F.col("text")).alias("digest"), now.alias("now_leaf")))
    stored_levels, subroots = climbed(placed(leaves, ["doc_id", "digest"]))
    dropped(leaves)
    above = stored(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("source"), "digest"))
    top_levels, roots = climbed(placed(above, ["source"]))
    root = roots.first()  # one row at most
    root = F.lit(root["digest"] if root else None).cast("string").alias("root")
    of_sources = paths(top_levels).select(F.col("source").alias("tree"), F.lit(0).cast("long").alias("pos"), "path", F.col("digest").alias("subroot"))
    return paths(stored_levels, of_sources).select("doc_id", F.col("digest").alias("leaf"), "subroot", root, "path", "now_leaf")


def manifest(docs: DataFrame) -> DataFrame:
    """Leaf, subroot, root and digest of the proof for each row, and the root that its leaf gives after line feeds were deleted from the texts of rows
    whose id has an even crc32. A null id is not tampered with; a null text stays null."""
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    text = F.when(even, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    rows = proofs(docs, text)
    again = folded(F.col("now_leaf"), F.col("path"))
    return rows.select("doc_id", "leaf", "subroot", "root", F.sha2(joined(F.col("path")), 256).alias("proof_sha256"), again.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def oracle() -> str:
    """The result in DuckDB SQL: every level of every tree, each row's siblings, and a fold along them. CRC-32 goes bit by bit."""
    field = lambda x: f"CASE WHEN {x} IS NULL THEN '-' ELSE concat(strlen(CAST({x} AS VARCHAR)), ':', {x}) END"
    leaf = lambda text: f"sha256(concat({', '.join(map(field, ('doc_id', 'source', 'lang', 'n_chars', text)))}))"
    bit = "lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END"
    octet = f"lambda c, b: list_reduce(list_prepend(xor(c, b), CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[])), {bit})"
    crc = f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))), {octet}), 4294967295::BIGINT)"
    up = "SELECT tree, level + 1, pos // 3, sha256(string_agg(digest, '' ORDER BY pos)), (n + 2) // 3 FROM {t} WHERE n > 1 GROUP BY tree, level, pos // 3, n"
    side = lambda t, a, b, way: f"(SELECT coalesce(string_agg({t}.digest, '' ORDER BY {t}.pos), '') FROM {t} WHERE {t}.tree = {a} AND {t}.level = x.level AND {t}.pos // 3 = {b} // CAST(pow(3, x.level + 1) AS BIGINT) AND {t}.pos {way} {b} // CAST(pow(3, x.level) AS BIGINT))"
    return f"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, CASE WHEN source IS NULL THEN '' ELSE concat('=', source) END AS tree, {leaf('text')} AS leaf,
  CASE WHEN doc_id IS NOT NULL AND {crc} % 2 = 0 THEN {leaf("replace(text, chr(10), '')")} ELSE {leaf('text')} END AS now FROM documents),
 placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM d),
 nodes(tree, level, pos, digest, n) AS (SELECT tree, 0, pos, leaf, n FROM placed UNION ALL {up.format(t='nodes')}),
 subroots AS (SELECT tree, digest, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1),
 tops(tree, level, pos, digest, n) AS (SELECT '', 0, pos, digest, n FROM subroots UNION ALL {up.format(t='tops')}),
 own AS (SELECT p.*, s.digest AS subroot, s.pos AS top_pos, (SELECT max(level) FROM nodes WHERE nodes.tree = p.tree) AS depth FROM placed p JOIN subroots s ON s.tree = p.tree),
 steps AS (SELECT o.r, x.level AS k, {side('nodes', 'o.tree', 'o.pos', '<')} AS a, {side('nodes', 'o.tree', 'o.pos', '>')} AS b FROM own o JOIN (SELECT DISTINCT tree, level FROM nodes WHERE n > 1) x ON x.tree = o.tree
  UNION ALL SELECT o.r, o.depth + x.level, {side('tops', "''", 'o.top_pos', '<')}, {side('tops', "''", 'o.top_pos', '>')} FROM own o, (SELECT DISTINCT level FROM tops WHERE n > 1) x),
 fold(r, k, digest) AS (SELECT r, 0, now FROM own UNION ALL SELECT f.r, f.k + 1, sha256(concat(s.a, f.digest, s.b)) FROM fold f JOIN steps s ON s.r = f.r AND s.k = f.k),
 root AS (SELECT digest FROM tops WHERE n = 1),
 proofs AS (SELECT r, sha256(string_agg(a || b, '' ORDER BY k)) AS proof FROM steps GROUP BY r),
 folded AS (SELECT r, arg_max(digest, k) AS digest FROM fold GROUP BY r)
SELECT doc_id, leaf, subroot, root.digest AS root, coalesce(proof, sha256('')) AS proof_sha256, folded.digest AS folded_root, folded.digest = root.digest AS verified
FROM own JOIN folded USING (r) LEFT JOIN proofs USING (r), root"""
