"""Plain re-computations of what operators 1, 3, 4 and 5 estimate or store."""

import hashlib
import math
import random
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash


from pointweave.llm import jpeg, langid, quality, sharding
from pointweave.llm.common import held_out

# 1: a decoder that reads one bit at a time ---------------------------------------------------------


def read_jpeg(data):
    """Width, height and the coefficients of each block of a grey baseline file."""
    assert data[:2] == b"\xff\xd8"
    at, codes, restart = 2, {}, 0
    while True:
        marker, size = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xC0:
            height, width = struct.unpack(">HH", body[1:5])
            assert body[0] == 8 and body[5] == 1
        elif marker == 0xC4:
            code, k, table = 0, 17, {}
            for n in range(1, 17):
                for _ in range(body[n]):
                    table[format(code, f"0{n}b")] = body[k]
                    code, k = code + 1, k + 1
                code <<= 1
            codes[body[0]] = table
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            break
    parts, part = [], bytearray()
    while True:
        b = data[at]
        at += 1
        if b != 0xFF:
            part.append(b)
        elif data[at] == 0:
            part.append(b)
            at += 1
        else:
            parts.append(bytes(part))
            part = bytearray()
            at += 1
            if data[at - 1] == 0xD9:
                break
    blocks = []
    for part in parts:
        bits = "".join(format(b, "08b") for b in part)
        place, dc = 0, 0

        def symbol(table):
            nonlocal place
            end = place + 1
            while bits[place:end] not in table:
                end += 1
                assert end - place <= 16
            word, place = bits[place:end], end
            return table[word]

        def value(n):
            nonlocal place
            word, place = bits[place : place + n], place + n
            if not n:
                return 0
            return int(word, 2) if word[0] == "1" else int(word, 2) - (1 << n) + 1

        for _ in range(restart):
            block = [0] * 64
            dc += value(symbol(codes[0]))
            block[0], k = dc, 1
            while k < 64:
                s = symbol(codes[0x10])
                if s == 0:
                    break
                k += s >> 4
                if s & 15:
                    block[k] = value(s & 15)
                k += 1
            blocks.append(block)
            assert set(bits[place:]) <= {"1"} and len(bits) - place < 8
    return width, height, blocks


def test_jpeg_by_an_independent_decoder(spark):
    rng = random.Random(41)
    texts = ["", "a", "é" * 64, "\x00" * 100, bytes(range(1, 128)).decode() * 3, "".join(chr(rng.randrange(1, 0x2FFF)) for _ in range(700)), "x\x00" * 200 + "\x00" * 130]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    stored = {r["doc_id"]: r["media"] for r in jpeg.store(docs).collect()}
    for r in jpeg.report(docs).collect():
        width, height, blocks = read_jpeg(stored[r["doc_id"]])
        data = texts[r["doc_id"]].encode()
        payload = data + bytes(-len(data) % 64 if data else 64)
        flat = bytes(v for b in blocks for v in b)
        assert flat[: len(payload)] == payload and not any(flat[len(payload) :])
        assert (r["width"], r["height"]) == (width, height) and len(blocks) * 64 == width * height
        thumb = bytes(min(255, (b[0] + 4) // 8 + 128) for b in blocks)
        assert r["thumb_sha256"] == hashlib.sha256(thumb).hexdigest()
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored[r["doc_id"]]), hashlib.sha256(stored[r["doc_id"]]).hexdigest())
        assert (r["payload_sha256"], r["tail_crc32"]) == (hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        # the hash's cells: means of the thumbnail over an 8 x 8 grid, in 1/1024
        w, h = width // 8, height // 8
        grid = [thumb[y * w : (y + 1) * w] for y in range(h)]
        cut = lambda n, i: (min(i * n // 8, n - 1), max((i + 1) * n // 8, i * n // 8 + 1))
        cells = []
        for i in range(8):
            for j in range(8):
                (t, b), (lo, hi) = cut(h, i), cut(w, j)
                own = [grid[y][x] for y in range(t, b) for x in range(lo, hi)]
                cells.append(sum(own) * 1024 // len(own))
        bits = "".join("1" if c > sum(cells) // 64 else "0" for c in cells)
        assert r["feature"] == f"{width}x{height}:{int(bits, 2):016x}"


# 3 -------------------------------------------------------------------------------------------------


def test_sharding_by_an_independent_winner(spark):
    weights = [1.0, 2.5, 0.5, 3.0]
    ids = [0, 1, -1, 2**62, -(2**63), *range(100, 400)]
    docs = spark.createDataFrame([(i, "x") for i in ids], "doc_id long, text string")

    def winner(key, weights):
        best = []
        for shard, weight in enumerate(weights):
            h = xxhash.xxh64_intdigest(struct.pack("<i", shard), xxhash.xxh64_intdigest(struct.pack("<q", key), 42))
            best.append((-math.log(((h >> 11) + 0.5) / 2.0**53) / weight, shard))
        return min(best)[1]

    for r in sharding.assign(docs, weights).collect():
        assert r["shard"] == winner(r["doc_id"], weights)
        assert r["grown_shard"] == winner(r["doc_id"], [*weights, sum(weights) / 4])
    plain = {r["doc_id"]: r for r in sharding.assign(docs).collect()}
    assert all(plain[i]["shard"] == winner(i, [1.0] * 40) and plain[i]["grown_shard"] == winner(i, [1.0] * 41) for i in ids)


# 4 -------------------------------------------------------------------------------------------------


def trigrams(text):
    data = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in b" " + text.encode() + b" ")
    grams = [data[i : i + 3] for i in range(len(data) - 2) if data[i : i + 3] != b"   "]
    return Counter((int.from_bytes(g, "big") * 0x9E3779B1 % 2**32) >> 17 for g in grams)


def plain_em(rows, share, steps):
    for _ in range(steps):
        new, total = [0.0] * len(share), 0
        for p, n in rows:
            mixed = sum(s * q for s, q in zip(share, p))
            for k, q in enumerate(p):
                new[k] += n * share[k] * q / mixed
            total += n
        share = [x / total for x in new]
    return share, sum(n * math.log(sum(s * q for s, q in zip(share, p))) for p, n in rows)


def test_language_by_a_plain_twin(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()]
    counts, langs = {}, sorted({lang for _, _, lang in rows if lang is not None})
    for i, text, lang in rows:
        if zlib.crc32(str(i).encode()) % 5 and lang is not None and text is not None:
            counts.setdefault(lang, Counter()).update(trigrams(text))
    size = {lang: sum(counts[lang].values()) + 0.5 * 2**15 for lang in langs}
    names, table = langid.train(docs.where(~held_out()))
    assert names == langs and table.sum(0) == pytest.approx(np.ones(len(names)))
    found = {r["doc_id"]: r for r in langid.report(docs).collect()}
    for i, text, _ in rows[::4]:
        grams = trigrams(text or "")
        if not any(c.isalpha() for c in text or ""):
            assert found[i]["lang_pred"] == "und"
            continue
        own = [([(counts[lang][g] + 0.5) / size[lang] for lang in langs], n) for g, n in grams.items()]
        share, _ = plain_em(own, [1 / len(langs)] * len(langs), langid.STEPS)
        order = sorted(range(len(langs)), key=lambda k: -share[k])
        cost, best = langid.PENALTY * math.log(sum(grams.values()) + 1), (-math.inf, None)
        for k in range(1, len(langs) + 1):
            chosen = order[:k]
            start = [share[c] + 1e-6 for c in chosen]
            part, value = plain_em([([p[c] for c in chosen], n) for p, n in own], [s / sum(start) for s in start], langid.STEPS if k > 1 else 0)
            if value - cost * k <= best[0]:
                break
            best = (value - cost * k, {chosen[j]: x for j, x in enumerate(part)})
        top = max(best[1], key=lambda c: (best[1][c], -c))
        assert found[i]["lang_pred"] == langs[top] and found[i]["n_langs"] == sum(x > 0 for x in best[1].values())
        assert found[i]["score"] == pytest.approx(min(1.0, best[1][top]), abs=1e-9)


def test_language_without_a_learnable_one(spark):
    docs = spark.createDataFrame([(1, "some words", None), (5, None, "en")], "doc_id long, text string, lang string")
    assert {(r["lang_pred"], r["score"]) for r in langid.report(docs).collect()} == {("und", 0.0)}


# 5 -------------------------------------------------------------------------------------------------


def plain_features(text):
    data = text.encode()
    size = max(1, len(data))
    kinds = [lambda b: 65 <= b <= 90, lambda b: 97 <= b <= 122, lambda b: 48 <= b <= 57, lambda b: b == 32, lambda b: b == 10, lambda b: b in b".,;:?", lambda b: b == 33, lambda b: b == 124, lambda b: b in b"#$%&*@^~_=<>{}[]\\/+", lambda b: b >= 128]
    out = [sum(map(k, data)) / size for k in kinds]
    words = bytes(b if 33 <= b <= 126 or b >= 128 else 32 for b in data).lower().split()
    n = len(words)
    out += [math.log1p(len(data)), math.log1p(n), min(sum(map(len, words)) / max(1, n), 40) / 10]
    if not n:
        return [*out, 0, 0, 0, 0, 1]
    distinct = lambda k: len({tuple(words[i : i + k]) for i in range(n - k + 1)}) / (n - k + 1) if n >= k else 1.0
    return [*out, distinct(1), max(Counter(words).values()) / n, distinct(2), distinct(4), float(n < 20)]


def test_quality_features_by_a_plain_twin():
    rng = random.Random(43)
    bits = ["The", "the", "and", "é", "x1", "...", "!", "|", "#$%", "\n", "ocean", "OCEAN,", "a" * 70, "😀"]
    texts = ["", " ", "\n\n", *(" ".join(rng.choice(bits) for _ in range(rng.randrange(1, 60))) for _ in range(200))]
    data = [t.encode() for t in texts]
    offsets = np.cumsum([0, *map(len, data)])
    got = quality.features(np.frombuffer(b"".join(data), np.uint8), offsets)
    assert got.shape[1] == len(quality.FEATURES)
    for row, text in zip(got, texts):
        assert row == pytest.approx(np.array(plain_features(text)), abs=1e-9), text


def test_quality_fit_is_the_optimum():
    """At the weights, the pairs' logistic loss has no slope; the threshold is the quantile of the share of label 0."""
    rng = np.random.default_rng(44)
    k = len(quality.FEATURES)
    x = rng.normal(size=(300, k)) * rng.uniform(0.1, 5, k)
    x[0] *= 100  # an outlier, cut alike in fit and score
    label = (x @ rng.normal(size=k) + rng.normal(size=300) * 5 > 1).astype(int)
    merit = quality.fit(x, label, 0.4)
    z = np.clip((x - x.mean(0)) / (x.std(0) + 1e-9), -6, 6)
    high, low = z[label == 1], z[label == 0]
    slope, pairs = np.zeros(k), 0
    for step in range(quality.PARTNERS):
        for i in range(max(len(high), len(low))):
            gap = high[i % len(high)] - low[(i * (2 * step + 1) + step * step) % len(low)]
            slope += gap / (1 + math.exp(float(gap @ merit.weights)))
            pairs += 1
    assert np.abs(slope / pairs - quality.RIDGE * merit.weights).max() < 1e-6
    merits = z @ merit.weights
    assert merit.merits(x) == pytest.approx(merits)
    below = 0.6 * (merits[label == 1] < merit.threshold).mean() + 0.4 * (merits[label == 0] < merit.threshold).mean()
    assert below == pytest.approx(0.4, abs=0.6 / len(high) + 0.4 / len(low))
    assert ((merit.scores(x) >= quality.THRESHOLD) == (merits >= merit.threshold)).all()


def test_quality_ranks_held_out_documents(spark, sf):
    docs, labels = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet"), spark.read.parquet(f"{sf.replace('0.001', '0.01')}/labels.parquet")
    out = quality.report(docs, labels).where("held_out").join(labels.where("quality is not null"), "doc_id").collect()
    good, bad = ([r["score"] for r in out if r["quality"] == q] for q in (1, 0))
    area = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert area > 0.9 and np.mean([r["predicted"] == r["quality"] for r in out]) > 0.85
