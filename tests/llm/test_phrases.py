"""Collocations against plain counting, and the index against looking."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from pointweave.llm import phrases as ph

LONGEST, LEAST = 4, 6


def brute(rows, longest=LONGEST, least=LEAST, best=2000, covered=100):
    lower = {65 + i: 97 + i for i in range(26)}
    f, before, after, n = Counter(), Counter(), Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            w = re.findall(r"[^ \t]+", piece)
            n[lang] += len(w)
            for m in range(1, longest + 1):
                for i in range(len(w) - m + 1):
                    key = (lang, *w[i : i + m])
                    f[key] += 1
                    before[key] += i > 0
                    after[key] += i + m < len(w)
    candidates = [k for k, v in f.items() if v >= least and len(k) > 2]
    longer = {}
    for lang, *w in candidates:
        for size in range(2, len(w)):
            for i in range(len(w) - size + 1):
                part = (lang, *w[i : i + size])
                longer[part] = max(longer.get(part, 0), f[(lang, *w)])
    out = {}
    for key in candidates:
        lang, *w = key
        a = f[key]
        if 100 * longer.get(key, 0) >= covered * a:
            continue
        score, k, left, right = min((1000 * a * n[lang] // (f[(lang, *w[:k])] * f[(lang, *w[k:])]), k, f[(lang, *w[:k])], f[(lang, *w[k:])]) for k in range(1, len(w)))
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), left, right, before[key], after[key]))
    return sorted((lang, r, p.decode(), -a, left, right, n[lang], -s, b, e) for lang, found in out.items() for r, (s, a, p, left, right, b, e) in enumerate(sorted(found)[:best], 1))


def corpus(seed, n):
    rng = random.Random(seed)
    vocabulary = ["a", "b", "c", "the", "New", "YORK", "é", "x" * 40, "d'un", "zz\xa0z"] + [f"w{i}" for i in range(30)]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    rows = []
    for i in range(n):
        words = rng.choices(vocabulary, weights, k=rng.randrange(0, 40))
        text = "".join(w + rng.choice([" ", " ", " ", "\t", "  ", ", ", ".", "\n", "\r"]) for w in words)
        rows.append((rng.choice(["en", "de", None, "und"]), text))
    rows += [("en", "alpha beta gamma delta")] * 9 + [("en", "beta gamma")] * 3 + [(None, None), ("en", ""), ("en", " ., \n"), ("fr", "only once here")]
    return rows


def sorted_rows(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score", "before", "after").collect())


@pytest.mark.parametrize("best,covered", [(2000, 100), (5, 60)])
def test_against_plain_counting(spark, best, covered):
    rows = corpus(1, 300)
    df = spark.createDataFrame(rows, "lang string, text string").selectExpr("*", "1 AS shard", "'x' AS words", "7 AS doc_id").repartition(5)
    got = sorted_rows(ph.collocations(df, LONGEST, LEAST, best, covered))
    assert got == brute(rows, best=best, covered=covered) and got


def test_several_shards_in_a_task(spark, monkeypatch):
    rows = corpus(2, 200)
    df = spark.createDataFrame(rows, "lang string, text string").coalesce(1)
    # the tasks' own module: a shard ends after each 64 texts there
    assert sorted_rows(ph.collocations(df.unionAll(df), LONGEST, 2 * LEAST)) == brute(rows * 2, least=2 * LEAST)


def test_one_language_and_repeated_words(spark):
    rows = [("en", "the " * 500)] * 3 + [("en", "a b")] * 2
    assert sorted_rows(ph.collocations(spark.createDataFrame(rows, "lang string, text string"), 5, 10)) == brute(rows, 5, 10)


@pytest.mark.parametrize("buckets", [1, 5])
def test_words_are_summed_over_shards_and_numbered(spark, buckets):
    held = [(7, "en", ["a", "b", "é", "x\\y"], [3, 1, 2, 1]), (8, "en", ["é", "c", "a"], [2, 9, 1]), (9, "de", ["a", "b"], [3, 4]), (10, "fr", ["only"], [1])]
    sharded = spark.createDataFrame(held, "shard long, lang string, words array<string>, counts array<int>")
    rows = ph._named(ph._word_packs(sharded, buckets), 4).collect()
    n, count, number = Counter(), {}, {}
    for r in rows:
        if r["shard"] == -1:
            n[r["lang"]] += r["n"]
            for w, c, gid in zip(r["words"], r["counts"], r["gids"]):
                count[r["lang"], w], number[gid] = c, (r["lang"], w)
    assert n == {"en": 19, "de": 7, "fr": 1}
    assert count == {("en", "a"): 4, ("en", "é"): 4, ("en", "c"): 9, ("de", "b"): 4} and len(number) == 4
    told = {}
    for r in rows:
        if r["shard"] != -1:
            steps, gids = ph._arrays(r["data"], *ph._FOUND)
            for local, gid in zip(np.cumsum(steps).tolist(), gids.tolist()):
                told[r["shard"], local] = number[gid]
    assert told == {(s, i): (lang, w) for s, lang, words, _ in held for i, w in enumerate(words) if (lang, w) in count}


def test_nothing_is_frequent(spark):
    df = spark.createDataFrame([("en", "a b c"), (None, None)], "lang string, text string")
    assert ph.collocations(df).count() == 0 and ph.collocations(df.limit(0)).count() == 0


def test_intervals_count_occurrences():
    rng = np.random.default_rng(3)
    text = np.r_[0, rng.integers(0, 6, 3000), 0].astype(np.int32)
    depth = 5
    index = ph.Index(ph.transform(text, depth), ph.transform(text[::-1], depth), 6)
    for size in range(1, depth + 1):
        want = Counter(tuple(text[i : i + size].tolist()) for i in range(len(text) - size + 1))
        names = sorted(w for w in want if min(w) >= ph.WORD)
        low, back, found = index.find(np.array(names))
        assert found.tolist() == [want[w] for w in names]
        if size == depth:
            continue
        parent, symbol, far, _, grown = index.extended(low, back, found)
        seen = {(*names[p], s): c for p, s, c in zip(parent.tolist(), symbol.tolist(), grown.tolist())}
        longer = Counter(tuple(text[i : i + size + 1].tolist()) for i in range(len(text) - size))
        assert seen == {w: c for w, c in longer.items() if min(w) >= ph.WORD}
        # the forward interval of an extension is the one that a search finds
        again = index.find(np.array([(*names[p], s) for p, s in zip(parent.tolist(), symbol.tolist())]))
        assert np.array_equal(again[0], far)
        at = [i for i in range(1, len(text) - size) if text[i - 1] == 0]
        bounded = Counter(tuple(text[i : i + size + 1].tolist()) for i in at)
        assert index.forward.bounded(far, grown).tolist() == [bounded[(*names[p], s)] for p, s in zip(parent.tolist(), symbol.tolist())]
