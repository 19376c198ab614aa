"""Packed token files against the tokenizers library and against plain unpacking."""

import zlib

import numpy as np
import pytest

from pointweave.llm import tokenfiles as tf

TEXTS = ["", "Hello world", "a  b\tc\n d's we'll é ́x", "<|endoftext|>x <|startoftext|>", "x" * 5000 + " yes", "ΑΣ ΑΣ. İstanbul ǅ ﬃ", "12345 67 \U0001f600‍\U0001f600", " ", "lorem ipsum " * 3000]


@pytest.fixture(scope="module")
def path():
    public = pytest.importorskip("public_tokenizers")
    return public.path("word_bpe_49k.json")


def library(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@pytest.mark.parametrize("bits", [1, 2, 7, 8, 13, 16, 17, 24, 31, 32])
def test_any_stretch_of_packed_ids(bits):
    rng = np.random.default_rng(bits)
    ids = rng.integers(0, 1 << bits, 3 * tf.BLOCK + 77, dtype=np.uint64).astype(np.uint32)
    file = tf.File(tf.image(ids, [5, None], np.array([0, 10, len(ids)]), bits, 3, 4) + b"\n")
    assert (file.part, file.nth, file.bits) == (3, 4, bits) and file.missing.tolist() == [False, True]
    assert len(file.data) == -(-len(ids) * bits // 8)
    for lo, hi in [(0, len(ids)), (0, 0), (1, 2), (4095, 4097), (8191, 12300), (len(ids) - 1, len(ids)), (5000, 5000)]:
        assert np.array_equal(file.ids(lo, hi), ids[lo:hi])


def test_width_is_the_least():
    assert [tf.width(n) for n in (1, 2, 3, 256, 257, 49408, 50257, 65536, 65537)] == [1, 1, 2, 8, 9, 16, 16, 16, 17]


def test_pieces_give_the_ids_of_whole_texts(path, sf):
    import pyarrow.parquet as pq

    texts = TEXTS + [t or "" for t in pq.read_table(f"{sf}/documents.parquet", columns=["text"]).column(0).to_pylist()]
    with open(path) as f:
        encoder = tf.Encoder(f.read())
    assert encoder.by_pieces
    texts += ["".join(chr(c) for c in range(n, n + 40)) + " a" for n in range(0, 700, 3)]
    texts += [f"x{chr(c)}Y {chr(c)}{chr(c)}'s{chr(c).upper()}" for c in range(0x80, 0x250)]
    texts += [f"a{chr(c)}b 'S{chr(c)}{chr(c)}'ll {chr(c)} don't''s </w> <| |>x" for c in [*range(128), 0x85, 0xA0, 0x1680, 0x2028, 0x3000, 0x301, 0xFEFF]]
    seen, tf.SEEN = tf.SEEN, 3000  # so that pieces are forgotten on the way
    try:
        whole = library(path).encode_batch(texts, add_special_tokens=False)
        for t, e in zip(texts, whole):
            assert len(encoder.seen) <= 3000 + len(t) and np.frombuffer(encoder.encode(t), "<u4").tolist() == e.ids
    finally:
        tf.SEEN = seen


def test_other_vocabularies_encode_whole_texts():
    public = pytest.importorskip("public_tokenizers")
    with open(public.path("byte_bpe_50k.json")) as f:
        content = f.read()
    encoder = tf.Encoder(content)
    assert not encoder.by_pieces
    for t in TEXTS:
        assert np.frombuffer(encoder.encode(t), "<u4").tolist() == encoder.library.encode(t, add_special_tokens=False).ids


def plain(rows, path, end=2):
    tok, out, at = library(path), [], 0
    for doc_id, text in rows:
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, end], "<u4")
        out.append((doc_id, at, len(ids), zlib.crc32(ids.tobytes()), ids.tolist()))
        at += len(ids)
    return out


def test_files_hold_every_document_in_order(spark, path, tmp_path):
    rows = [(i * 7 % 50, TEXTS[i % len(TEXTS)] + f" {i}") for i in range(50)] + [(None, "no id"), (90, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("x", "y").repartition(5)
    tf.write(df.selectExpr("*", "1 AS part", "2 AS start"), str(tmp_path / "t"), path, 2, file_ids=2000)
    want = plain(sorted(rows, key=lambda r: (r[0] is not None, r[0])), path)
    got = sorted(tuple(r) for r in tf.read(spark, str(tmp_path / "t")).select("start", "doc_id", "n_tokens", "ids_crc32", "ids").collect())
    assert [(d, s, n, c, i) for s, d, n, c, i in got] == want
    files = tf.manifest(spark, str(tmp_path / "t")).collect()
    assert len(files) > 3 and sum(f.n_docs for f in files) == len(rows)
    ids = [x for r in want for x in r[4]]
    for lo, hi in [(0, 10), (1990, 4100), (len(ids) - 3, len(ids) + 50), (len(ids), len(ids) + 1)]:
        found = sorted(tuple(r) for r in tf.stretch(spark, str(tmp_path / "t"), lo, hi).collect())
        assert [x for _, part in found for x in part] == ids[lo:hi]


def test_ties_and_empty_tables(spark, path, tmp_path):
    rows = [(1, "same"), (1, "same"), (1, "other"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id int, text string")
    got = sorted(tuple(r) for r in tf.report(df, str(tmp_path / "a"), path).select("start", "doc_id", "n_tokens").collect())
    assert got[0][:2] == (0, None) and [g[1] for g in got[1:]] == [1, 1, 1] and got[-1][0] + got[-1][2] == 1 + sum(len(library(path).encode(t or "", add_special_tokens=False).ids) + 1 for _, t in rows[:3])
    assert tf.report(df.limit(0), str(tmp_path / "b"), path).count() == 0


def test_query_against_the_library(spark, sf, path):
    from pointweave.llm.queries import op12_packed_token_files

    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in op12_packed_token_files(spark, sf).collect())
    assert got == [x[:4] for x in plain(docs, path)]
