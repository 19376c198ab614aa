"""Merkle manifest of a dataset (operator 13).

Every row is a leaf, each source a tree of 16-ary runs, and the sources' roots
form one more such tree.  A leaf's place in its source comes from
``numbered`` and not from a window, so a source may hold any share of the rows.
Per level, windows over aligned blocks of ``BLOCK`` neighbours carry lag and
lead columns at the fixed offsets 1 to 15; slot and run length mask those
that belong to another run.  What is left are a node's siblings, and
the first child of each run hashes its parent.  Levels shrink sixteenfold, so
there are as many as the largest source needs; paths go down again the
same way, each node taking its parent's.

Defined results: nulls in a column are ``-`` in the leaf; rows without a source form the
first source, apart from an empty one; rows without an id come first in their source and are
never tampered with; rows of one id are ordered by their leaves; repeated rows are
leaves of their own; an empty table gives an empty result; columns besides the five are
not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointweave.llm.common import durable, release
from pointweave.operators.tables import looked_up, numbered

ARITY = 16
#: Neighbours that a window orders at a time; a multiple of ``ARITY``.
BLOCK = ARITY * ARITY
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(*parts: Column) -> Column:
    """Lowercase hex sha256 of the parts, concatenated."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """Byte count, colon, value; ``-`` for a null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(text: Column) -> Column:
    return digest(*(field(F.col(c)) for c in FIELDS[:-1]), field(text))


#: Lag and lead columns of all offsets, and what the slot and the run's length leave of them.
_NEIGHBOURS = [f"{side}(digest, {k}) OVER (PARTITION BY tree, block ORDER BY pos) AS {side}_{k}" for side in ("lag", "lead") for k in range(1, ARITY)]
_BEFORE = ", ".join(f"IF(slot >= {k}, lag_{k}, NULL)" for k in range(ARITY - 1, 0, -1))
_AFTER = ", ".join(f"IF(slot + {k} < run, lead_{k}, NULL)" for k in range(1, ARITY))


def _siblings(nodes: DataFrame) -> DataFrame:
    """``before`` and ``after``: the digests of the nodes of a node's run on either side of it.

    nodes: tree, pos, n (nodes of the tree at this level), digest.
    """
    blocks = nodes.selectExpr("*", f"pos div {BLOCK} AS block", f"pos % {ARITY} AS slot", f"least({ARITY}, n - pos + pos % {ARITY}) AS run")
    wide = blocks.selectExpr("*", *_NEIGHBOURS)
    return wide.selectExpr(*nodes.columns, "block", f"concat_ws('', {_BEFORE}) AS before", f"concat_ws('', {_AFTER}) AS after")


def _grown(nodes: DataFrame) -> DataFrame:
    """The next level of the trees that still hold several nodes."""
    first = _siblings(nodes.where("n > 1")).where(F.col("pos") % ARITY == 0)
    return first.select("tree", F.expr(f"pos div {ARITY}").alias("pos"), F.expr(f"(n + {ARITY - 1}) div {ARITY}").alias("n"), digest(F.col("digest"), F.col("after")).alias("digest"))


def levels(leaves: DataFrame) -> list[DataFrame]:
    """All levels of the trees, leaves first; a tree is absent above its root."""
    most = leaves.agg(F.max("n")).first()[0] or 1
    out = [leaves]
    while most > 1:
        most = -(-most // ARITY)
        out.append(durable(_grown(out[-1]), "level"))
    return out


def roots(tree: list[DataFrame]) -> DataFrame:
    out = tree[0].where("n = 1").select("tree", "digest")
    for level in tree[1:]:
        out = out.unionAll(level.where("n = 1").select("tree", "digest"))
    return out


def paths(tree: list[DataFrame], above: DataFrame) -> DataFrame:
    """The leaves with what ``above`` has for their tree: its columns, and before its ``path`` a node's siblings (before, after) of each level."""
    more = [c for c in above.columns if c not in ("tree", "path")]
    out = None
    for level in reversed(tree):
        own = level.where("n = 1").join(above, "tree").select(*level.columns, "path", *more)
        if out is not None:
            # the parents of a block meet its nodes as one row, where the window has put them
            parents = out.groupBy("tree", F.expr(f"pos div {BLOCK // ARITY}").alias("block")).agg(F.array_sort(F.collect_list(F.struct("pos", "path", *more))).alias("parents"))
            below = _siblings(level.where("n > 1")).join(parents, ["tree", "block"])
            parent = F.element_at("parents", (F.expr(f"pos div {ARITY}") - F.col("parents")[0]["pos"] + 1).cast("int"))
            path = F.concat(F.array(F.struct("before", "after")), parent["path"])
            own = own.unionAll(below.select(*level.columns, path.alias("path"), *(parent[c].alias(c) for c in more)))
        out = own if level is tree[0] else durable(own, "paths")
    return out


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, changed (the tampered leaf or null), subroot, root and path of every row."""
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    hashed = docs.select(
        "doc_id",
        F.coalesce(F.concat(F.lit(":"), F.col("source")), F.lit("")).alias("tree"),
        leaf(F.col("text")).alias("digest"),
        F.when(tampered, leaf(F.translate("text", _CAPITALS, _SMALL))).alias("changed"),
    )
    placed = durable(numbered(hashed, "doc_id", "digest", by=["tree"], name="pos"), "placed")
    sizes = placed.groupBy("tree").agg(F.count(F.lit(1)).alias("n"), F.count(F.lit(1)).alias("rows"))
    leaves = durable(looked_up(placed, sizes, "tree", "rows", placed.count()), "leaves")
    release(placed)
    tree = levels(leaves)
    # the sources' roots are the leaves of the last tree
    subroots = durable(roots(tree), "subroots")
    order = numbered(subroots.select(F.col("tree").alias("of"), "digest"), "of", name="pos")
    top = levels(durable(order.select("of", F.lit("").alias("tree"), "pos", F.lit(subroots.count()).alias("n"), "digest"), "top"))
    none = F.array().cast("array<struct<before:string,after:string>>")
    above = durable(paths(top, roots(top).select("tree", F.col("digest").alias("root"), none.alias("path"))), "above")
    found = paths(tree, above.select(F.col("of").alias("tree"), "path", F.col("digest").alias("subroot"), "root"))
    return found.select("doc_id", F.col("digest").alias("leaf"), "changed", "subroot", "root", "path")


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, start, lambda d, s: digest(s["before"], d, s["after"]))


def report(docs: DataFrame) -> DataFrame:
    rows = manifest(docs)
    proof = F.sha2(F.array_join(F.transform("path", lambda s: F.concat(s["before"], s["after"])), ""), 256)
    out = rows.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), fold(F.coalesce("changed", "leaf"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


ORACLE = r"""
WITH RECURSIVE l AS MATERIALIZED (
  SELECT row_number() OVER () AS row, doc_id, coalesce(':' || source, '') AS tree, sha256(pre || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    CASE WHEN crc % 5 = 0 THEN sha256(pre || coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) END AS changed
  FROM (SELECT *, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
      || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS pre,
      xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT), lambda c, b: list_reduce(range(8), lambda d, i: CASE WHEN d & 1 = 1 THEN xor(d >> 1, 3988292384) ELSE d >> 1 END, xor(c, b)), 4294967295::BIGINT), 4294967295) AS crc
    FROM documents)),
placed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM l),
low(level, tree, pos, n, h) AS (
  SELECT 0, tree, pos, n, leaf FROM placed
  UNION ALL SELECT level + 1, tree, pos // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY pos)) FROM low WHERE n > 1 GROUP BY level, tree, pos // 16, n),
tops AS MATERIALIZED (SELECT tree AS of, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n, h FROM low WHERE n = 1),
high(level, pos, n, h) AS (
  SELECT 0, pos, n, h FROM tops
  UNION ALL SELECT level + 1, pos // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY pos)) FROM high WHERE n > 1 GROUP BY level, pos // 16, n),
runs AS MATERIALIZED (SELECT level, tree, pos // 16 AS run, list(h ORDER BY pos) AS hs FROM low WHERE n > 1 GROUP BY 1, 2, 3),
high_runs AS MATERIALIZED (SELECT level, pos // 16 AS run, list(h ORDER BY pos) AS hs FROM high WHERE n > 1 GROUP BY 1, 2),
climb(row, tree, level, pos, folded, proof) AS (
  SELECT row, tree, 0, pos, coalesce(changed, leaf), '' FROM placed
  UNION ALL SELECT row, tree, level + 1, pos // 16, sha256(array_to_string(hs[:pos % 16], '') || folded || array_to_string(hs[pos % 16 + 2:], '')), proof || array_to_string(hs[:pos % 16], '') || array_to_string(hs[pos % 16 + 2:], '')
  FROM climb JOIN runs USING (level, tree) WHERE run = pos // 16),
at_top AS MATERIALIZED (SELECT c.row, t.h AS subroot, t.pos, c.folded, c.proof FROM (SELECT row, tree, max(level) AS level FROM climb GROUP BY 1, 2) m JOIN climb c USING (row, tree, level) JOIN tops t ON t.of = c.tree),
rise(row, subroot, level, pos, folded, proof) AS (
  SELECT row, subroot, 0, pos, folded, proof FROM at_top
  UNION ALL SELECT row, subroot, level + 1, pos // 16, sha256(array_to_string(hs[:pos % 16], '') || folded || array_to_string(hs[pos % 16 + 2:], '')), proof || array_to_string(hs[:pos % 16], '') || array_to_string(hs[pos % 16 + 2:], '')
  FROM rise JOIN high_runs USING (level) WHERE run = pos // 16)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root AS verified
FROM placed JOIN (SELECT * FROM rise QUALIFY row_number() OVER (PARTITION BY row ORDER BY level DESC) = 1) USING (row), (SELECT h AS root FROM high WHERE n = 1)
"""
