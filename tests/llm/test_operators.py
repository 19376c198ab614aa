"""The ten operators against brute force, with nulls, empty and long texts, ties,
repeated rows, empty tables and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from pointweave.llm import bpe, chat, decontam, jpeg, langid, neardup, pii, quality, queries, repeats, sharding
from pointweave.llm.common import held_out

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, ids string, `key` string"
WORDS = "the of and ocean river stone light under over paper window cloud green table music north quiet seven".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "s", "ly", ","]) for _ in range(n))


@pytest.fixture(scope="module")
def messy(spark):
    rng = random.Random(4)
    base = prose(rng, 120)
    texts = [base, base, base + " tail", "Intro. " + base, None, "", " ", "\n\t", "x", "É", "!?", "12345", "a" * 3000, prose(rng, 9000), "\x00zero\x00", "<|endoftext|> mid <|endoftext|>", "😀" * 40]
    texts += [prose(rng, rng.randrange(1, 80)) for _ in range(25)]
    rows = [(i, t, rng.choice(["en", "de", None]), "s", None, 7, "clash", None) for i, t in enumerate(texts)]
    rows += [rows[0], rows[5], (None, base, None, None, 1, 1, None, "k"), (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df):
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]


def by_text(df, docs, *cols):
    """Result rows with their texts, matched by id (ids of this fixture have one text, but for null)."""
    text = dict(rows_of(docs.where("doc_id is not null")))
    return [(text[r["doc_id"]], tuple(r[c] for c in cols)) for r in df.where("doc_id is not null").collect()]


# 1 -------------------------------------------------------------------------------------------------


def test_jpeg_round_trip(messy, empty):
    out = jpeg.report(messy)
    assert out.count() == messy.count() and jpeg.report(empty).count() == 0
    for text, (n, size, sha, crc) in by_text(out, messy, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32"):
        data = text.encode()
        payload = data + bytes(-len(data) % 64 if data else 64)
        assert (n, size, sha, crc) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))


def test_jpeg_refuses_what_is_none():
    good = jpeg.encode(bytes(range(64)))
    for bad in (None, b"", b"\xff\xd8", good[: len(good) - 20], good.replace(b"\xff\xc0", b"\xff\xc2")):
        assert isinstance(jpeg.decode([bad])[0], str)


def _code(pairs, lengths, symbols):
    codes, sizes, _ = jpeg._canonical(lengths, symbols)
    bits = ""
    for symbol, value, size in pairs:
        bits += format(int(codes[symbol]), f"0{int(sizes[symbol])}b")
        if size:
            bits += format(value if value > 0 else value + (1 << size) - 1, f"0{size}b")
    return bits


def test_jpeg_colour_without_restarts():
    """A 4:2:0 image of 2 x 1 MCUs, DC coded as differences across the scan."""
    dc, ac = jpeg._DC, jpeg._AC
    y = [40, 44, 35, 41, 10, -5, 300, 302]
    prior = {0: 0, 1: 0, 2: 0}
    bits = ""
    for mcu in range(2):
        for part, value in [*((0, y[4 * mcu + i]) for i in range(4)), (1, 7 * mcu), (2, -9)]:
            gap = value - prior[part]
            prior[part] = value
            bits += _code([(abs(gap).bit_length(), gap, abs(gap).bit_length())], *dc)
            bits += _code([(0x11, 1, 1), (0x00, 0, 0)], *ac)
    bits += "1" * (-len(bits) % 8)
    scan = int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\x00")
    s = jpeg._segment
    head = b"\xff\xd8" + s(0xDB, b"\x00" + bytes([8] * 64)) + s(0xC0, bytes([8, 0, 16, 0, 32, 3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0]))
    head += s(0xC4, b"\x00" + bytes(dc[0]) + dc[1]) + s(0xC4, b"\x10" + bytes(ac[0]) + ac[1]) + s(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0]))
    frame, coefficients, part = jpeg.decode([head + scan + b"\xff\xd9"])[0]
    assert (frame.width, frame.height) == (32, 16)
    assert coefficients[part == 0, 0].tolist() == y and coefficients[part == 1, 0].tolist() == [0, 7]
    thumb = jpeg.thumbnail(frame, coefficients, part)
    assert thumb.tolist() == [[168, 172, 138, 123], [163, 169, 255, 255]]


# 2 -------------------------------------------------------------------------------------------------


def removed(rows, length):
    seen, out = set(), {}
    for doc, text in sorted(rows):
        data = text.encode()
        gone = bytearray(len(data))
        for p in range(len(data) - length + 1):
            if data[p : p + length] in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(data[p : p + length])
        left = bytes(x for x, g in zip(data, gone) if not g)
        runs = len(re.findall(rb"\x01+", bytes(gone)))
        out[doc] = (len(data), len(data) - len(left), runs, hashlib.sha256(left).hexdigest())
    return out


@pytest.mark.parametrize("many", [2, 4000])
def test_repeats(spark, messy, empty, many, monkeypatch):
    monkeypatch.setattr(repeats, "MANY", many)
    docs = messy.where("doc_id is not null")
    expected = removed(set(rows_of(docs)), 100)
    for r in repeats.report(docs).collect():
        assert tuple(r)[1:] == expected[r["doc_id"]]
    assert repeats.report(messy).count() == messy.count() and repeats.report(empty).count() == 0


def test_repeats_of_low_entropy_text(spark):
    rng = random.Random(9)
    rows = [(i, "".join(rng.choice(["ab" * rng.randrange(80), "x" * rng.randrange(150), "".join(rng.choice("ab") for _ in range(60))]) for _ in range(4))) for i in range(60)]
    expected = removed(rows, 100)
    out = repeats.report(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in out} == expected


def removed_in_parts(rows, length):
    """As ``removed``, by row: texts of one id, or of none, are parts of one document in the order of place and digest."""
    parts = {(2**63 - 1 if d is None else d, xxhash.xxh64_intdigest(t.encode(), 42) - 2**64 * (xxhash.xxh64_intdigest(t.encode(), 42) >> 63)): t.encode() for d, t in rows}
    least = {}
    for (d, part), data in parts.items():
        for p in range(len(data) - length + 1):
            at = (d, p, part)
            least[data[p : p + length]] = min(at, least.get(data[p : p + length], at))
    out = {}
    for (d, part), data in parts.items():
        gone = bytearray(len(data))
        for p in range(len(data) - length + 1):
            if least[data[p : p + length]] != (d, p, part):
                gone[p : p + length] = b"\1" * length
        left = bytes(x for x, g in zip(data, gone) if not g)
        out[None if d == 2**63 - 1 else d, data.decode()] = (len(data), len(data) - len(left), len(re.findall(rb"\x01+", bytes(gone))), hashlib.sha256(left).hexdigest())
    return out


@pytest.mark.parametrize("many", [2, 4000])
def test_repeats_of_rows_that_share_an_id(spark, many, monkeypatch):
    """More texts under one id than 16-bit digests tell apart; marks of one row must not reach another."""
    monkeypatch.setattr(repeats, "MANY", many)
    rng = random.Random(12)
    passage = [prose(rng, 40) for _ in range(12)]
    heads = ["", passage[0] + " "]  # equal phrases at equal places
    rows = []
    for i in range(1000):
        doc = None if i % 3 else i % 2 + 7
        rows.append((doc, rng.choice(heads) + prose(rng, rng.randrange(1, 60)) + rng.choice(["", " " + rng.choice(passage)]) + f" {i}"))
    copies = rows[:20] * 10
    expected = removed_in_parts(rows, 100)
    got = repeats.spans(spark.createDataFrame(rows + copies, "doc_id long, text string").repartition(5), 100)
    # no group holds the marks of many rows
    assert got.agg(F.max(F.size("repeats"))).first()[0] < 400
    out = repeats.report(spark.createDataFrame(rows + copies, "doc_id long, text string").repartition(5)).collect()
    assert Counter((r["doc_id"], *tuple(r)[1:]) for r in out) == Counter((d, *expected[d, t]) for d, t in rows + copies)


# 3 -------------------------------------------------------------------------------------------------


def test_sharding(spark, messy, empty):
    out = sharding.assign(messy).collect()
    assert len(out) == messy.count() and sharding.assign(empty).count() == 0
    for s in {r["shard"] for r in out}:
        slots = sorted(r["slot"] for r in out if r["shard"] == s)
        assert slots == list(range(len(slots)))
    assert all(r["grown_shard"] in (r["shard"], 40) for r in out)
    text = dict(rows_of(messy.where("doc_id is not null")))
    for r in out:
        if r["doc_id"] is not None:
            data = text[r["doc_id"]].encode()
            assert (r["size"], r["text_crc32"]) == (len(data) + 16, zlib.crc32(data))


def test_slots_of_a_hot_key(spark):
    """A third of the rows have no id and another third one id and text: slots are gapless, over several tasks."""
    rows = spark.range(30_000).selectExpr("CASE WHEN id % 3 = 0 THEN NULL WHEN id % 3 = 1 THEN 7 ELSE id END AS doc_id", "CASE WHEN id % 3 = 1 THEN 'same' ELSE concat('t', id) END AS text")
    out = sharding.assign(rows)
    slots = {}
    for r in out.select("shard", "slot").collect():
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and sum(map(len, slots.values())) == 30_000


def test_released_copies_of_several_blocks(spark, tmp_path):
    """Twenty blocks of a benchmark: the same findings as with one, and no more than two copies of the documents on disk."""
    import os

    rng = random.Random(12)
    items = [(i, prose(rng, 40)) for i in range(60)]
    docs = spark.createDataFrame([(i, prose(rng, 60) + " " + (items[i % 60][1] if i % 5 == 0 else "") + f" {rng.random()}") for i in range(200)], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string").coalesce(1)
    here = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(here))
    many = sorted(map(tuple, decontam.report(docs, bench, block_bytes=3000).drop("longest_item").collect()))
    assert many == sorted(map(tuple, decontam.report(docs, bench).drop("longest_item").collect()))
    assert len(set(os.listdir(here)) - before) <= 2


def test_sharding_follows_weights(spark):
    docs = spark.range(20000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    n = {r["shard"]: r["count"] for r in sharding.assign(docs, [1.0, 2.0, 5.0]).groupBy("shard").count().collect()}
    assert n[0] == pytest.approx(2500, rel=0.1) and n[1] == pytest.approx(5000, rel=0.1) and n[2] == pytest.approx(12500, rel=0.1)
    with pytest.raises(ValueError):
        sharding.assign(docs, [1.0, 0.0])


# 4 and 5 -------------------------------------------------------------------------------------------


def test_language(spark, sf, messy, empty):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = langid.report(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in out]) > 0.9
    every = langid.report(messy)
    assert every.count() == messy.count() and langid.report(empty).count() == 0
    for text, (lang, score) in by_text(every, messy, "lang_pred", "score"):
        assert 0 <= score <= 1 and (lang == "und") == (not any(c.isalpha() for c in text))


def test_mixture_finds_two_languages():
    rng = np.random.default_rng(1)
    p = rng.dirichlet(np.full(300, 0.1), 3).T + 1e-6
    n = rng.multinomial(500, p[:, 0] / p[:, 0].sum()) + rng.multinomial(300, p[:, 2] / p[:, 2].sum())
    at = np.flatnonzero(n)
    share = langid.mixture(p[at], n[at])
    assert share[1] == 0 and share[0] == pytest.approx(0.625, abs=0.1) and share.sum() == pytest.approx(1)


def test_quality(spark, sf, messy, empty):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out = quality.report(docs, labels).join(labels, "doc_id").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in out]) > 0.85
    odd = spark.createDataFrame([(0, 1), (0, 1), (1, 0), (2, None), (None, 1), (99, 1), (3, 1), (4, 0)], "doc_id long, quality int")
    scored = quality.report(messy, odd).collect()
    assert len(scored) == messy.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in scored)
    assert quality.report(empty, odd).count() == 0
    one_kind = quality.report(messy, odd.where("quality = 1")).collect()
    assert {(round(r["score"], 9), r["predicted"]) for r in one_kind} == {(0.3, 1)}


def test_held_out_fold(messy):
    for r in messy.select("doc_id", held_out().alias("h")).collect():
        assert r["h"] == (zlib.crc32(b"" if r["doc_id"] is None else str(r["doc_id"]).encode()) % 5 == 0)


# 6 -------------------------------------------------------------------------------------------------


def shingles(text, k):
    w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), text.encode()))
    return ({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)}) if w else set()


def groups(rows, k, percent):
    sets = {d: shingles(t, k) for d, t in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    posting = {}
    for d in sorted(sets):
        common = Counter(e for s in sets[d] for e in posting.get(s, ()))
        for s in sets[d]:
            posting.setdefault(s, []).append(d)
        for e, n in common.items():
            if 100 * n >= percent * (len(sets[d]) + len(sets[e]) - n):
                a, b = find(d), find(e)
                root[max(a, b)] = min(a, b)
    return {d: (len(sets[d]), find(d)) for d in sets}


@pytest.mark.parametrize("k,percent", [(3, 85), (5, 80)])
def test_near_duplicates(spark, messy, empty, k, percent):
    rng = random.Random(k)
    rows = list(set(rows_of(messy.where("doc_id is not null"))))
    base = prose(rng, 150).split()
    for i in range(120):  # copies that are edited more and more, so that some bridge others
        w = list(base)
        for _ in range(i // 12):
            w[rng.randrange(len(w))] = f"w{rng.randrange(10**6)}"
        rows.append((1000 + i, " ".join(w)))
    docs = spark.createDataFrame(rows + rows[:3], "doc_id long, text string").repartition(3)
    expected = groups(rows, k, percent)
    out = neardup.report(docs, k, percent).collect()
    assert len(out) == len(rows) + 3
    for r in out:
        assert (r["n_shingles"], r["component_id"]) == expected[r["doc_id"]] and r["kept"] == (r["doc_id"] == r["component_id"])
    assert neardup.report(messy, k, percent).count() == messy.count() and neardup.report(empty, k, percent).count() == 0


def test_many_members_of_open_buckets(spark, monkeypatch):
    """Copies of one text with many edits: most pairs lie under the threshold, some link across components; small blocks."""
    monkeypatch.setattr(neardup, "BLOCK", 2_000)
    rng = random.Random(31)
    base = prose(rng, 90).split()
    rows = []
    for i in range(300):
        w = list(base)
        for _ in range(rng.randrange(1, 14)):
            w[rng.randrange(len(w))] = rng.choice([f"q{rng.randrange(6)}", f"w{i}", "stone"])
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for k, percent in ((3, 85), (5, 80)):
        expected = groups(rows, k, percent)
        assert len({c for _, c in expected.values()}) > 3
        for r in neardup.report(docs, k, percent).collect():
            assert (r["n_shingles"], r["component_id"]) == expected[r["doc_id"]]


def test_one_row_of_each_group_stays(spark, messy):
    rng = random.Random(32)
    base, other = prose(rng, 100), prose(rng, 100)
    rows = [(None, base), (None, base), (4, base), (4, base), (4, base + " tail"), (9, other), (None, None), (None, None), (8, " "), (None, other + " x"), (None, "only here"), (None, "only here")]
    docs = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, mark int").repartition(3)
    kept = sorted(((r["doc_id"], r["text"]) for r in neardup.representatives(docs).collect()), key=repr)
    assert [r for r in kept if r[0] == 4] == [min([(4, base), (4, base + " tail")], key=lambda r: hashlib.md5(r[1].encode()).digest())]
    assert [r for r in kept if r[0] != 4] == sorted([(9, other), (None, None), (None, None), (8, " "), (None, "only here")], key=repr)


@pytest.mark.parametrize("common,every,percent", [(4, 5, 80), (6, 7, 85)])
def test_short_texts_share_a_band(common, every, percent):
    """Sets of a few shingles at the threshold meet in a band as surely as long ones."""
    rng = np.random.default_rng(5)
    rows = neardup.rows_per_band(percent / 100)
    bands = neardup.REGISTERS // rows
    for _ in range(4000):
        h = rng.integers(0, 2**64, every, dtype=np.uint64)
        same = neardup.sketch(np.sort(h)) == neardup.sketch(np.sort(h[:common]))
        assert same[: bands * rows].reshape(bands, rows).all(axis=1).any()


def test_estimate_is_close():
    rng = np.random.default_rng(2)
    h = rng.integers(0, 2**64, 3000, dtype=np.uint64)
    a, b = np.sort(h[:2600]), np.sort(h[400:])
    assert neardup.estimate(neardup.sketch(a), neardup.sketch(b)) == pytest.approx(2200 / 3000, abs=0.12)


# 7 -------------------------------------------------------------------------------------------------


def windows(text):
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), text.encode()))


def longest_match(words, items, window=10):
    """Length and first place of the longest match that starts where a whole window stands."""
    best = (0, None)
    for i in range(len(words)):
        runs = []
        for v in items:
            for j in range(len(v)):
                k = 0
                while i + k < len(words) and j + k < len(v) and words[i + k] == v[j + k]:
                    k += 1
                runs.append((k, k >= min(window, len(v)) and j + min(window, len(v)) <= len(v)))
        if any(whole for _, whole in runs) and max(k for k, _ in runs) > best[0]:
            best = (max(k for k, _ in runs), i)
    return best


def thue_morse(n):
    """Two different words of 2^n letters that polynomial hashes modulo 2^64 cannot tell apart from n = 10 on."""
    a, b = "a", "b"
    for _ in range(n):
        a, b = a + b, b + a
    return a, b


@pytest.mark.parametrize("n", [3, 4, 5, 6, 10, 11])
def test_long_words_that_collide_in_polynomials(spark, n):
    a, b = thue_morse(n)
    docs = spark.createDataFrame([(1, f"alpha beta {a}"), (2, f"alpha beta {b}"), (3, b)], "doc_id long, text string")
    out = {r["doc_id"]: r for r in decontam.report(docs, spark.createDataFrame([(7, a)], "item_id long, text string")).collect()}
    assert [out[d]["n_hit"] for d in (1, 2, 3)] == [1, 0, 0]
    assert all(r["kept"] and r["component_id"] == r["doc_id"] for r in neardup.report(docs).collect())


#: Words that hashes of exclusive-or and sum in steps of eight bytes cannot tell apart.
SWAPPED = ("v7ig3uqeybv200b0", "ofk2y4n1ds04413x")


def test_words_that_collide_in_steps_of_eight_bytes(spark):
    a, b = SWAPPED
    tail = " one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(1, f"alpha beta {a}"), (2, f"alpha beta {b}"), (3, a + tail), (4, b + tail), (5, f"alpha beta {a} alpha beta {b}")], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.report(docs).collect()}
    assert got == {1: (1, 1, True), 2: (1, 2, True), 3: (9, 3, True), 4: (9, 4, True), 5: (4, 5, True)}
    assert neardup.representatives(docs.where("doc_id < 3")).count() == 2


def test_words_of_every_length_are_told_apart():
    rng = random.Random(9)
    for size in range(1, 70):
        word = bytearray(rng.choices(b"abcdefghijklmnopqrstuvwxyz0123456789", k=size))
        forms = {bytes(word)}
        for _ in range(40):
            other = bytearray(word)
            i, j = rng.randrange(size), rng.randrange(size)
            other[i], other[j] = other[j], other[i]
            if rng.random() < 0.5:
                other[rng.randrange(size)] ^= 1 << rng.randrange(4)
            if not set(other) & {32, *range(9, 14)}:
                forms.add(bytes(other))
        forms |= {f + b"\x01" for f in forms} | {f + b"\x07" for f in forms}
        text = b" ".join(sorted(forms))
        _, _, lanes, _ = neardup.word_lanes(np.frombuffer(text, np.uint8), neardup._WORD, neardup.LOWER, np.array([0, len(text)]))
        assert lanes.shape[1] == len(forms) and all(len(set(lane.tolist())) == len(forms) for lane in lanes)


@pytest.mark.parametrize("width,percent", [(3, 85), (5, 80)])
def test_pieces_of_few_words(spark, width, percent):
    """A batch of few words in all, beside a text that fills a batch of its own."""
    for n in range(8):
        text = " ".join(WORDS[:n]).encode()
        (x, y), = neardup.shingle_lanes(np.frombuffer(text, np.uint8), np.array([0, len(text)]), width)
        assert len(x) == len(y) == (0 if n == 0 else max(1, n - width + 1))
    rows = [(0, " ".join(f"w{i}" for i in range(90_000)))] + [(n, " ".join(WORDS[:n])) for n in range(1, 8)] + [(10, WORDS[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.report(docs, width, percent).collect()}
    assert got == {0: (90_001 - width, 0), 10: (1, 1)} | {n: (max(1, n - width + 1), n) for n in range(1, 8)}
    assert neardup.representatives(docs, width, percent).count() == 8


def test_windows_and_links_are_confirmed_on_bytes(monkeypatch):
    """With a hash that sees lengths only, different words still match nothing."""
    import pyarrow as pa

    hashed = decontam.word_hashes

    def poor(*args):
        starts, ends, _, at = hashed(*args)
        return starts, ends, (ends - starts).astype(np.uint64), at

    monkeypatch.setattr(decontam, "word_hashes", poor)
    known = decontam.Benchmark([("x", "one two six ten")], 3)
    texts = pa.array(["how two six ten", "one two six", "and for the win"])
    found = decontam.Found(texts, 0, 3, known)
    assert {(d, p - int(found.at[d])) for d, p, *_ in found.hits} == {(0, 1), (1, 0)}
    assert neardup.confirmed(b"a b c d", b"A b c d", 3, 100) and not neardup.confirmed(b"a b c d", b"a b c e", 3, 85)


def test_repetitive_text(spark):
    """A thousand equal words against twenty thousand: no pair of a suffix and a place is made."""
    docs = spark.createDataFrame([(1, "word " * 20_000), (2, "word " * 9), (3, "other")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "word " * 1000), (2, "Word " * 300)], "item_id long, text string")
    out = {r["doc_id"]: r for r in decontam.report(docs, bench).collect()}
    assert (out[1]["n_hit"], out[1]["n_items"], out[1]["longest"], out[1]["longest_at"]) == (20_000, 2, 1000, 0)
    assert not out[2]["contaminated"] and out[3]["longest"] == 0 and out[3]["longest_at"] is None


def test_suffix_array_is_in_order():
    rng = np.random.default_rng(3)
    for letters in (1, 2, 5, 300):
        h = rng.integers(0, letters, 500).astype(np.uint64)
        stop = np.repeat([100, 101, 350, 500], [100, 1, 249, 150])
        array = decontam.SuffixArray(h, stop, 500)
        follow = [tuple(array.ids[i : stop[i]].tolist()) for i in array.order.tolist()]
        assert follow == sorted(follow) and sorted(array.order.tolist()) == list(range(500))


@pytest.mark.parametrize("block", [1 << 20, 600])
def test_decontamination(spark, messy, empty, block):
    rng = random.Random(5)
    docs = dict(rows_of(messy.where("doc_id is not null")))
    some = [t for t in docs.values() if len(windows(t)) > 30]
    items = [(i, " ".join(t.split()[5:27])) for i, t in enumerate(some[:6])] + [(50, "Quiet, OCEAN"), (51, None), (52, "!!"), (53, "Quiet ocean"), (54, prose(rng, 40)), (None, "river stone light")]
    marks = {}
    for i, t in items:
        w = windows(t or "")
        for g in [tuple(w[j : j + 10]) for j in range(len(w) - 9)] or ([tuple(w)] if w else []):
            marks.setdefault(g, set()).add(i)
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = decontam.report(messy, bench, block_bytes=block).cache()
    assert out.count() == messy.count() and decontam.report(empty, bench, block_bytes=block).count() == 0
    for r in out.where("doc_id is not null").collect():
        w = windows(docs[r["doc_id"]])
        hit, found = set(), set()
        for g, ids in marks.items():
            for j in range(len(w) - len(g) + 1):
                if tuple(w[j : j + len(g)]) == g:
                    hit |= set(range(j, j + len(g)))
                    found |= ids
        names = sorted(str(i) for i in found if i is not None)
        assert (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) == (len(w), len(hit), len(names), bool(hit))
        assert r["items_sha256"] == hashlib.sha256(",".join(names).encode()).hexdigest()
        assert (r["longest"], r["longest_at"]) == longest_match(w, [windows(t or "") for _, t in items])
    clean = decontam.clean(messy, bench, block_bytes=block)
    assert clean.columns == messy.columns and clean.count() == out.where("not contaminated").count()
    assert decontam.report(messy, bench.limit(0)).where("contaminated").count() == 0


# 8 -------------------------------------------------------------------------------------------------


def test_chat(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (2, 0, "user", "hi"), (3, 0, "user", "hi"), (3, 1, "assistant", "yo"), (4, 0, "user", "other"), (5, 0, None, None), (5, 0, None, None), (6, 0, "unknown", ""), (None, 0, "user", "lost")]
    conv = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, whole int")
    out = {r["conv_id"]: r for r in chat.maximal(conv).collect()}
    assert set(out) == {1, 4, 5, 6, None}
    assert out[1]["n_equal"] == 2 and out[1]["text"] == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nyo<|im_end|>\n"
    assert out[5]["text"] == out[6]["text"]
    assert chat.maximal(conv.limit(0)).count() == 0


# 9 -------------------------------------------------------------------------------------------------


def luhn(d):
    return sum(v if i % 2 == 0 else (v * 2 - 9 if v > 4 else v * 2) for i, v in enumerate(map(int, reversed(d)))) % 10 == 0


def base_spans(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m)) <= 15]
    return out


def test_pii(spark, messy, empty):
    rng = random.Random(6)
    bits = ["a.b@c.de", "a@b.c_d@e.f", "x@y", "@q.w", "1.2.3.4", "001.02.3.255", "256.1.1.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (650) 555-0100", "+49", "é😀", " call ", "12" * 30, "+1 2 3 4 5 6 7 8 9 ", "GB82 WEST 1234 5698 7654 32", "DE89370400440532013000", "\n", "."]
    texts = ["".join(rng.choice(bits) + rng.choice(["", " ", ",", "-"]) for _ in range(rng.randrange(1, 12))) for _ in range(300)]
    texts += ["7" * 50_000, "a" * 50_000 + "@", "1." * 20_000, "+1" + " " * 20_000 + "2"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").unionByName(messy.where("doc_id is not null").select((F.col("doc_id") + 1000).alias("doc_id"), "text"))
    out = pii.report(docs).collect()
    text = dict(rows_of(docs))
    for r in out:
        spans = base_spans(text[r["doc_id"]])
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest(), text[r["doc_id"]][:200]
        assert [r[f"n_{k}"] for k in pii.BASE] == [sum(s[0] == k for s in spans) for k in pii.BASE]
        assert r["spans"].startswith(joined)
    assert any(r["n_iban"] for r in out)
    assert pii.report(empty).count() == 0 and pii.report(messy).count() == messy.count()
    red = pii.redact(messy.withColumn("text", F.when(F.col("doc_id") == 8, "Mail a.b@c.de or 4111 1111 1111 1111!").otherwise(F.col("text"))))
    assert red.columns == messy.columns
    assert red.where("doc_id = 8").first()["text"] == "Mail [EMAIL] or [CARD]!"
    assert red.where("text is null").count() == messy.where("text is null").count()


# 10 ------------------------------------------------------------------------------------------------


def test_bpe(spark, messy, empty):
    tokenizers = pytest.importorskip("tokenizers")
    path = queries.tokenizer_path()
    theirs = tokenizers.Tokenizer.from_file(path)
    out = bpe.digests(messy, path)
    assert out.count() == messy.count() and bpe.digests(empty, path).count() == 0
    for text, (n, ids_sha, decoded_sha) in by_text(out, messy, "n_tokens", "ids_sha256", "decoded_sha256"):
        ids = theirs.encode(text, add_special_tokens=False).ids
        assert n == len(ids) and ids_sha == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert decoded_sha == hashlib.sha256(theirs.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    both = bpe.decode(bpe.encode(messy, path), path)
    once = bpe.round_trip(messy, path)
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "", r["ids"], r["decoded"])
    assert sorted(map(key, both.collect())) == sorted(map(key, once.collect()))
    assert all(r["decoded"] == (r["text"] or "") for r in once.collect())


def test_bpe_random_strings():
    tokenizers = pytest.importorskip("tokenizers")
    path = queries.tokenizer_path()
    theirs = tokenizers.Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        ours = bpe.Bpe(f.read())
    rng = random.Random(8)
    letters = "abcehlstxyz'  \t\n\r\x1c\x85\xa0é½²٣你😀ا़!?.,0123\x00ſK<|endoftext|>"
    for _ in range(3000):
        s = "".join(rng.choice(letters) for _ in range(rng.randrange(40))) + rng.choice(["", "<|endoftext|>", " the", "'ll've"])
        ids = theirs.encode(s, add_special_tokens=False).ids
        assert ours.encode(s) == ids and ours.decode(ids) == theirs.decode(ids, skip_special_tokens=False)


def test_chat_with_a_long_conversation(spark):
    """Fifteen hundred turns, logged whole and cut at three places."""
    turns = [(k, "user" if k % 2 == 0 else "assistant", f"turn {k}") for k in range(1500)]
    rows = [(conv, *t) for conv, n in ((1, 1500), (2, 700), (3, 1), (4, 1499)) for t in turns[:n]] + [(5, 0, "user", "other")]
    out = {r["conv_id"]: r for r in chat.maximal(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert set(out) == {1, 5} and out[1]["n_turns"] == 1500 and out[1]["text"].count("<|im_start|>") == 1500


def test_quality_of_an_id_with_many_rows(spark):
    rng = random.Random(45)
    docs = [(i % 40 + 1, prose(rng, 30) if i % 2 else "!!! $$$ " * 5) for i in range(400)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 41)], "doc_id long, quality int")
    merit = quality.train(spark.createDataFrame(docs, "doc_id long, text string"), labels)
    assert np.isfinite(merit.weights).all()
