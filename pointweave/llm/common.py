"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pointweave.sources.durable import durable, release  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str = "doc_id", folds: int = 5) -> Column:
    """True for documents whose crc32 of the decimal id is 0 modulo ``folds``.

    A null id counts as the empty text (crc32 0), hence as held out.
    """
    text = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % folds == 0


#: Rows that a task holds at a time where it hands texts to Python.
BATCH_ROWS = 1000


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, with Arrow batches of ``BATCH_ROWS`` rows in its session.

    Whole texts are long, and the default of 10000 rows holds tens of MB on
    either side of each Python worker.  A value that the user set stays.
    """
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if conf.get(key) == "10000":
        conf.set(key, str(BATCH_ROWS))
    return df


def pieces(texts: pa.Array, most_bytes: int) -> Iterator[tuple[int, int]]:
    """Row ranges of a batch that hold about ``most_bytes`` of text each.

    A longer text is a range of its own: texts are never cut here.
    """
    sizes = np.diff(np.frombuffer(texts.buffers()[1], dtype=np.int32, count=len(texts) + texts.offset + 1)[texts.offset :])
    start, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if held and held + n > most_bytes:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(texts):
        yield start, len(texts)


def flat_bytes(texts: pa.Array, start: int, stop: int) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of rows [start, stop) and their n + 1 offsets from 0."""
    at = np.frombuffer(texts.buffers()[1], dtype=np.int32, count=len(texts) + texts.offset + 1)[texts.offset :][start : stop + 1].astype(np.int64)
    if texts.buffers()[2] is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), at - at[0]
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[at[0] : at[-1]]
    return data, at - at[0]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit words (multiply, shift, multiply)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    return x


_SECOND = np.uint64(0xA24BAED4963EE407)
#: Words under this length are packed with it into 64 bits; longer ones have a digest.
PACKED = 8
_KEPT = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


class _Digests(dict[bytes, bytes]):
    """128-bit BLAKE2b digests of words, remembered up to a number of them."""

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= 200_000:
            self.clear()
        out = self[word] = hashlib.blake2b(word, digest_size=16).digest()
        return out


_DIGESTS = _Digests()


def word_lanes(data: np.ndarray, is_word: np.ndarray, lower: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of concatenated texts: start, end, 128 bits in two lanes (rows), and words up to each text.

    ``is_word`` and ``lower`` are tables of 256 entries.  A word is a maximal
    run of word bytes inside one text.  Words of up to seven bytes are told
    apart by each lane alone; longer ones by their 128-bit digests.
    """
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((2, 0), np.uint64), np.zeros(len(offsets), np.int64)
    inside = is_word[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < n)]
    first[inner] = inside[inner]
    last[inner - 1] = inside[inner - 1]
    starts = np.flatnonzero(first)
    ends = np.flatnonzero(last) + 1
    size = ends - starts
    folded = np.zeros(n + 8, np.uint8)
    folded[:n] = lower[data]
    eight = np.ndarray(n, "<u8", folded, strides=(1,))
    packed = (eight[starts] & _KEPT[np.minimum(size, PACKED)]) | (np.minimum(size, PACKED).astype(np.uint64) << np.uint64(56))
    lanes = np.stack([mix64(packed), mix64(packed ^ _SECOND)])
    long = np.flatnonzero(size >= PACKED)
    if len(long):
        flat = folded.tobytes()
        words = [flat[a:b] for a, b in zip(starts[long].tolist(), ends[long].tolist())]
        lanes[:, long] = np.frombuffer(b"".join(map(_DIGESTS.__getitem__, words)), "<u8").reshape(-1, 2).T
    return starts, ends, lanes, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, is_word: np.ndarray, lower: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """:func:`word_lanes` with the first lane only: 64 bits, which may agree by chance; what they find is confirmed on bytes."""
    starts, ends, lanes, at = word_lanes(data, is_word, lower, offsets)
    return starts, ends, lanes[0], at


def byte_table(chosen: Iterable[int]) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chosen)] = True
    return out


#: A-Z to a-z, other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def lowered(text: bytes) -> bytes:
    """A-Z to a-z, other bytes as they are."""
    return text.translate(LOWER.tobytes())
