"""The Merkle manifest against plain hashing."""

import hashlib
import zlib
from itertools import groupby

import pytest

from pointweave.llm import manifest


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def climb(nodes):
    """Root, and the (before, after) of each node level by level."""
    paths, where = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, at in enumerate(where):
            run = nodes[at - at % 16 : at - at % 16 + 16]
            paths[i].append(("".join(run[: at % 16]), "".join(run[at % 16 + 1 :])))
        nodes = [H(*nodes[i : i + 16]) for i in range(0, len(nodes), 16)]
        where = [at // 16 for at in where]
    return nodes[0], paths


def brute(rows):
    lower = {65 + i: 97 + i for i in range(26)}
    made = []
    for doc_id, text, lang, source, n_chars in rows:
        whole = H(*map(field, (doc_id, source, lang, n_chars, text)))
        bad = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0
        other = H(*map(field, (doc_id, source, lang, n_chars, text and text.translate(lower)))) if bad else whole
        made.append((source, doc_id, whole, other))
    name = lambda r: (r[0] is not None, (r[0] or "").encode())
    made.sort(key=lambda r: (name(r), (r[1] is not None, r[1] or 0), r[2]))
    groups = [list(g) for _, g in groupby(made, name)]
    trees = [climb([r[2] for r in g]) for g in groups]
    root, high = climb([t[0] for t in trees])
    out = []
    for g, (subroot, paths), top in zip(groups, trees, high):
        for (_, doc_id, whole, other), path in zip(g, paths):
            folded = other
            for before, after in path + top:
                folded = H(before, folded, after)
            out.append((doc_id, whole, subroot, root, H(*(b + a for b, a in path + top)), folded, folded == root))
    return sorted(out, key=repr)


def ours(df):
    cols = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted((tuple(r) for r in df.select(cols).collect()), key=repr)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("n,sources", [(1, 1), (2, 1), (16, 1), (17, 1), (257, 1), (300, 20), (40, 40)])
def test_against_plain_hashing(spark, n, sources):
    rows = [(i * 3, None if i % 11 == 0 else f"Text É {i}", None if i % 7 == 0 else "en", None if i % sources == 0 else f"src{i % sources}", i) for i in range(n)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS tree", "2 AS pos", "3 AS digest", "4 AS path").repartition(3)
    assert ours(manifest.report(df)) == brute(rows)


def test_hot_source_nulls_ties_and_repeats(spark):
    rows = [(i % 5000, "A" * (i % 40), "de", "big", None) for i in range(6000)] + [(None, "x", None, None, 1), (None, "x", None, None, 1), (3, "", "", "", 0), (3, None, "", "", 0), (1, "B", "", "small", 0)]
    assert ours(manifest.report(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_empty_table(spark):
    assert manifest.report(spark.createDataFrame([], SCHEMA)).count() == 0
