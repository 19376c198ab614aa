"""Token ids as bit-packed binary files (operator 12).

Documents are cut at ranges of their id, encoded where their range lies and
written in its order, as files of at most about ``FILE_IDS`` ids.  A file holds

* a header, big-endian: magic, bits an id, range and file number, documents, ids, blocks;
* little-endian: the documents' ids (int64) and a byte each that tells whether the id is
  missing, where each document starts (int64, one more than documents), and the byte
  offset of each block of ``BLOCK`` ids (int64, one more than blocks);
* the blocks: each id in the fewest bits that the vocabulary needs, lowest bits first.

Numpy unpacks any stretch of a file from its block offsets alone.  Files are written and
read by Spark (rows of text without a character set, and its binary source), so the
folder may be in any store that Spark reaches.  Beside them ``manifest`` holds the ids
before each file, so that a stretch of the whole corpus opens its own files only.

Encoding is the tokenizers library's; what it has encoded before is looked up.

Defined results: a null or empty text has the end id alone; rows without an id come
first; rows of one id are in the order of their texts' hashes; repeated rows are documents of
their own; an empty table gives no files and an empty result; other columns are not read.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pointweave.llm.bpe import tokenizer_file
from pointweave.llm.common import small_batches

BLOCK = 4096
#: Ids after which a file ends at the next document.
FILE_IDS = 1 << 24
#: Pieces, and words, that a task remembers, and the longest of them in characters.
SEEN, PIECE = 300_000, 64
#: Fixed value: how the vocabulary cuts lower-cased text into words.
RULE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Pieces of printable ASCII and Latin-1 letters, and what the rule means for them.
_PLAIN = re.compile(r"[!-~\xC0-\xD6\xD8-\xF6\xF8-\xFF]*").fullmatch
_WORDS = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[a-z\xDF-\xF6\xF8-\xFF]+|[0-9]|[^a-z0-9\xDF-\xF6\xF8-\xFF]+").findall
#: How the vocabulary writes bytes that stand for no printable character.
_BYTES = {b: 256 + i for i, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174))}
_HEADER = struct.Struct(">4sBxxxIIQQQ")
_MAGIC = b"PWTF"
#: Widths that are numpy's own.
_WHOLE = {8: "<u1", 16: "<u2", 32: "<u4"}


def width(vocabulary: int) -> int:
    """Bits of the largest of so many ids."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids one after another in ``bits`` bits each, lowest bits first, up to a whole byte."""
    if bits in _WHOLE:
        return ids.astype(_WHOLE[bits]).tobytes()
    out = []
    for lo in range(0, len(ids), 64 * BLOCK):
        part = np.ascontiguousarray(ids[lo : lo + 64 * BLOCK], "<u4")
        out.append(np.packbits(np.unpackbits(part.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :bits].ravel(), bitorder="little").tobytes())
    return b"".join(out)


def unpack(data: np.ndarray, offsets: np.ndarray, bits: int, start: int, stop: int) -> np.ndarray:
    """Ids [start, stop) of blocks that begin at byte ``offsets`` of ``data``; only the bytes of their blocks are looked at."""
    first, last = start // BLOCK, -(-stop // BLOCK)
    if start >= stop:
        return np.zeros(0, np.uint32)
    low = int(offsets[first])
    if bits in _WHOLE:
        return np.frombuffer(data[low : int(offsets[last])].tobytes(), _WHOLE[bits])[start - first * BLOCK : stop - first * BLOCK].astype(np.uint32)
    held = np.zeros(int(offsets[last]) - low + 8, np.uint8)
    held[:-8] = data[low : int(offsets[last])]
    eight = np.ndarray(len(held) - 7, "<u8", held, strides=(1,))
    out = np.empty(stop - start, np.uint32)
    for lo in range(start, stop, 64 * BLOCK):
        at = np.arange(lo, min(stop, lo + 64 * BLOCK))
        bit = (offsets[at // BLOCK] - low) * 8 + at % BLOCK * bits
        out[at - start] = (eight[bit >> 3] >> (bit & 7).astype(np.uint64)) & np.uint64((1 << bits) - 1)
    return out


def image(ids: np.ndarray, documents: list[int | None], starts: np.ndarray, bits: int, part: int, nth: int) -> bytes:
    """The bytes of a file."""
    blocks = -(-len(ids) // BLOCK)
    offsets = np.minimum(np.arange(blocks + 1) * (BLOCK * bits // 8), -(-len(ids) * bits // 8))
    head = _HEADER.pack(_MAGIC, bits, part, nth, len(documents), len(ids), blocks)
    names = np.array([0 if d is None else d for d in documents], "<i8")
    missing = np.array([d is None for d in documents], np.uint8)
    return b"".join([head, names.tobytes(), missing.tobytes(), starts.astype("<i8").tobytes(), offsets.astype("<i8").tobytes(), pack(ids, bits)])


class File:
    """A file's parts; ids are unpacked when asked for."""

    def __init__(self, content: bytes | memoryview) -> None:
        magic, self.bits, self.part, self.nth, n, self.n_ids, blocks = _HEADER.unpack_from(content)
        if magic != _MAGIC:
            raise ValueError("not a token file")
        at = _HEADER.size
        self.documents = np.frombuffer(content, "<i8", n, at)
        self.missing = np.frombuffer(content, np.uint8, n, at + 8 * n).astype(bool)
        self.starts = np.frombuffer(content, "<i8", n + 1, at + 9 * n)
        self.offsets = np.frombuffer(content, "<i8", blocks + 1, at + 17 * n + 8)
        self.data = np.frombuffer(content, np.uint8, int(self.offsets[-1]), at + 17 * n + 16 + 8 * blocks)

    def ids(self, start: int, stop: int) -> np.ndarray:
        return unpack(self.data, self.offsets, self.bits, start, stop)


class Encoder:
    """The library's ids of texts.

    A vocabulary that splits at white space and at ``RULE`` gives a text the ids of its
    pieces between spaces.  Pieces met before are looked up; new ones of printable
    ASCII and Latin-1 letters are cut as the rule cuts them, and the words among them not met
    before go to the library's model.  Other new pieces are encoded as one text with a special token
    between them.  Other vocabularies encode whole texts.
    """

    def __init__(self, content: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has its own share of the machine
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(content)
        self.library.no_truncation()
        self.library.no_padding()
        told = json.loads(content)
        special = [t for t in told["added_tokens"] if t["special"] and t["content"].startswith("<|") and not (t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"])]
        steps = (told["pre_tokenizer"] or {}).get("pretokenizers", [])
        spaced = any(n.get("pattern") == {"Regex": r"\s+"} and n.get("content") == " " for n in (told["normalizer"] or {}).get("normalizers", []))
        suffix = told["model"].get("end_of_word_suffix")
        self.by_pieces = bool(suffix and special and spaced and steps and steps[0].get("pattern") == {"Regex": RULE} and steps[0]["behavior"] == "Removed" and steps[0]["invert"])
        if self.by_pieces:
            self.model = self.library.model
            self.between, self.mark = special[0]["content"], special[0]["id"]
        self.seen: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _cut(self, joined: str) -> list[bytes]:
        """Ids of the pieces between special tokens."""
        ids = np.array(self.library.encode(joined, add_special_tokens=False).ids, "<u4")
        raw, at = ids.tobytes(), [-1, *np.flatnonzero(ids == self.mark).tolist(), len(ids)]
        return [raw[4 * (a + 1) : 4 * b] for a, b in zip(at, at[1:])]

    def _merged(self, word: str) -> bytes:
        shown = word if word.isascii() else word.encode().decode("latin-1").translate(_BYTES)
        return array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()

    def _learned(self, pieces: Iterable[str]) -> dict[str, bytes]:
        known, odd, out = self.words, [], {}
        if len(known) > SEEN:
            known.clear()
        for p in pieces:
            if len(p) > PIECE or "<|" in p:
                out[p] = self.whole(p)
            elif _PLAIN(p):
                ids = b""
                for word in _WORDS(p.lower()):
                    if word not in known:
                        known[word] = self._merged(word)
                    ids += known[word]
                out[p] = ids
            else:
                odd.append(p)
        if odd:
            out.update(zip(odd, self._cut(self.between.join(odd))))
        return out

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not self.by_pieces:
            return self.whole(text)
        pieces = text.replace("\n", " ").replace("\t", " ").split(" ")
        try:
            return b"".join(map(self.seen.__getitem__, pieces))
        except KeyError:
            pass
        known = self.seen
        new = self._learned({p for p in pieces if p not in known})
        out = b"".join([known[p] if p in known else new[p] for p in pieces])
        if len(known) + len(new) > SEEN:
            known.clear()
        known.update((p, ids) for p, ids in new.items() if len(p) <= PIECE)
        return out


def vocabulary(content: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_str(content).get_vocab_size()


@lru_cache(1)
def _encoder(content: str) -> Encoder:
    """One encoder for each worker, whatever the number of its tasks."""
    return Encoder(content)


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int, file_ids: int = FILE_IDS) -> None:
    """Encode ``docs`` (doc_id, text), each with ``end_id`` behind it, into files below ``path`` in the order of doc_id."""
    spark = docs.sparkSession
    content = tokenizer_file(spark, tokenizer)
    bits = width(max(vocabulary(content.value), end_id + 1))
    end = np.array([end_id], "<u4").tobytes()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumns({"likeness": F.xxhash64("text"), "place": F.monotonically_increasing_id()})
    ordered = rows.repartitionByRange("doc_id", "likeness", "place").sortWithinPartitions("doc_id", "likeness", "place").select(F.spark_partition_id().alias("part"), "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, nth, part = _encoder(content.value), 0, 0
        names: list[int | None] = []
        held: list[bytes] = []
        size = 0

        def finish() -> pa.RecordBatch:
            starts = np.r_[0, np.cumsum([len(x) // 4 for x in held])]
            made = image(np.frombuffer(b"".join(held), "<u4"), names, starts, bits, part, nth)
            return pa.RecordBatch.from_arrays([pa.array([made], pa.binary())], ["image"])

        for batch in batches:
            for p, name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                part = p
                ids = encoder.encode(text.as_py() or "") + end
                names.append(name)
                held.append(ids)
                size += len(ids) // 4
                if size >= file_ids:
                    yield finish()
                    names, held, size, nth = [], [], 0, nth + 1
        if held:
            yield finish()

    images = small_batches(ordered).mapInArrow(run, "image binary")
    # the bytes of a row and the separator, which no reader of the format looks at
    images.select(F.col("image").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).text(f"{path}/files")
    number = lambda at, n: F.conv(F.hex(F.substring("content", at, n)), 16, 10).cast("long")
    heads = _files(spark, path).select("path", number(9, 4).alias("part"), number(13, 4).alias("nth"), number(17, 8).alias("n_docs"), number(25, 8).alias("n_ids"))
    heads.write.parquet(f"{path}/heads")
    heads = spark.read.schema(heads.schema).parquet(f"{path}/heads")
    before = lambda w: F.coalesce(F.sum("n_ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # as many ranges as shuffle partitions; the files of a range are added up apart
    ranges = heads.groupBy("part").agg(F.sum("n_ids").alias("n_ids")).select("part", before(Window.partitionBy(F.lit(0)).orderBy("part")).alias("base"))
    inside = heads.withColumn("inside", before(Window.partitionBy("part").orderBy("nth")))
    inside.join(F.broadcast(ranges), "part").select("path", "part", "nth", "n_docs", "n_ids", (F.col("base") + F.col("inside")).alias("base")).write.parquet(f"{path}/manifest")


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(f"{path}/files").where(F.col("length") >= _HEADER.size)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """path, part, nth, n_docs, n_ids and base (the ids of all files before it) of each file."""
    return spark.read.schema("path string, part long, nth long, n_docs long, n_ids long, base long").parquet(f"{path}/manifest")


def read(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and, if wanted, the ids of each document, from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                file = File(content.as_buffer())
                n = len(file.documents)
                for lo in range(0, n, 4096):
                    hi = min(n, lo + 4096)
                    at = file.starts[lo : hi + 1]
                    own = file.ids(int(at[0]), int(at[-1]))
                    cut = (at - at[0]).tolist()
                    columns = [
                        pa.array(np.full(hi - lo, file.part)), pa.array(np.full(hi - lo, file.nth)),
                        pa.array(file.documents[lo:hi], mask=file.missing[lo:hi]), pa.array(at[:-1]), pa.array(np.diff(at)),
                        pa.array([zlib.crc32(own[a:b]) for a, b in zip(cut, cut[1:])], pa.int64()),
                    ]
                    if ids:
                        columns.append(pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(own.astype(np.int32))))
                    yield pa.RecordBatch.from_arrays(columns, ["part", "nth", "doc_id", "inside", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    rows = _files(spark, path).select("content").mapInArrow(run, "part long, nth long, doc_id long, inside long, n_tokens long, ids_crc32 long" + (", ids array<int>" if ids else ""))
    out = rows.join(manifest(spark, path).select("part", "nth", "base"), ["part", "nth"])
    return out.select("doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if ids else []))


def stretch(spark: SparkSession, path: str, start: int, stop: int) -> DataFrame:
    """Ids [start, stop) of the whole corpus: a row (start, ids) for each file that holds some; other files are not opened."""
    held = manifest(spark, path).where((F.col("base") < stop) & (F.col("base") + F.col("n_ids") > start)).select("path", "base")
    names = [r[0] for r in held.select("path").collect()]  # as many as the stretch has files
    if not names:
        return spark.createDataFrame([], "start long, ids array<int>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, base in zip(batch.column(0), batch.column(1).to_pylist()):
                file = File(content.as_buffer())
                low, high = max(0, start - base), min(file.n_ids, stop - base)
                own = file.ids(low, high).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([base + low]), pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), pa.array(own))], ["start", "ids"])

    return spark.read.format("binaryFile").load(names).join(F.broadcast(held), "path").select("content", "base").mapInArrow(run, "start long, ids array<int>")


def report(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Write the files, then tell what they hold."""
    write(docs, path, tokenizer, end_id)
    return read(docs.sparkSession, path, ids=False)
