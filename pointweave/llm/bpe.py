"""Byte-level BPE encoding and decoding (operator 10).

Each pre-token is encoded on its own: its bytes form a doubly linked list of
symbols, a priority queue holds the merge rank of every neighbouring pair, and
the least rank (then the leftmost place) is merged first.  Entries whose pair
has meanwhile changed are stale and skipped when they come up.  Decoding
concatenates the vocabulary's byte strings.

The vocabulary file is read once on the driver and its content (1.5 MB, one
fixed file) travels to the tasks; the path is a parameter.

Defined results: a null text counts as empty (no ids, empty decoding); the
added token's string inside a text becomes its one id, as the library does;
rows are independent, so ties, repeated rows, null ids and extra columns
(which are not read) change nothing; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from heapq import heapify, heappop, heappush
from itertools import accumulate, chain

import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from pointweave.llm.common import small_batches

#: White space as the file's library sees it (fixed value of the format).
_SPACE = r"\t-\r \x85\xA0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: The byte-level pre-tokenizer's pattern (fixed value of the format).
_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"

#: Pre-tokens whose ids a worker keeps; beyond it the memo is emptied after a text.
MEMO = 300_000


def _byte_letters() -> dict[str, int]:
    """The format's letter for each byte: printable ones stand for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain}
    for i, b in enumerate(b for b in range(256) if b not in set(plain)):
        letters[chr(256 + i)] = b
    return letters


class Bpe:
    """Encoder and decoder for one byte-level BPE file."""

    def __init__(self, content: str) -> None:
        spec = json.loads(content)
        letters = _byte_letters()
        model = spec["model"]
        ids = model["vocab"]
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.strings = {i: bytes(letters[c] for c in s) for s, i in ids.items() if s not in self.added}
        self.strings |= {i: s.encode() for s, i in self.added.items()}
        self.first = [0] * 256
        for letter, b in letters.items():
            self.first[b] = ids[letter]
        # for each left id: right id -> rank; for each rank: what it joins and makes
        self.ranks: list[dict[int, int]] = [{} for _ in range(max(ids.values()) + 1)]
        self.left, self.right, self.joined = [], [], []
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks[ids[left]].setdefault(ids[right], rank)
            self.left.append(ids[left])
            self.right.append(ids[right])
            self.joined.append(ids[left + right])
        self.split = regex.compile(_PATTERN)
        self.cut = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.memo = _Memo(self.word)
        self.names = {i: str(i) for i in self.strings}

    def word(self, piece: str) -> tuple[int, ...]:
        """Ids of one pre-token."""
        symbol = [*map(self.first.__getitem__, piece.encode())]
        n = len(symbol)
        ranks, left, right = self.ranks, self.left, self.right
        bits = n.bit_length()
        # an entry is (rank, place) in one integer
        queue = [ranks[a][b] << bits | i for i, (a, b) in enumerate(zip(symbol, symbol[1:])) if b in ranks[a]]
        if not queue:
            return tuple(symbol)
        heapify(queue)
        places = (1 << bits) - 1
        after = [*range(1, n), -1]
        before = [*range(-1, n - 1)]
        while queue:
            entry = heappop(queue)
            at, rank = entry & places, entry >> bits
            to = after[at]
            if to < 0 or symbol[at] != left[rank] or symbol[to] != right[rank]:
                continue  # stale: one of the two has been merged elsewhere
            symbol[at] = new = self.joined[rank]
            symbol[to] = -1
            after[at] = following = after[to]
            if following >= 0:
                before[following] = at
                if (other := symbol[following]) in ranks[new]:
                    heappush(queue, ranks[new][other] << bits | at)
            prior = before[at]
            if prior >= 0 and new in (row := ranks[symbol[prior]]):
                heappush(queue, row[new] << bits | prior)
        return tuple([s for s in symbol if s >= 0])

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for part in self.cut.split(text) if self.cut else (text,):
            if part in self.added:
                out.append(self.added[part])
            else:
                out += chain.from_iterable(map(self.memo.__getitem__, self.split.findall(part)))
        if len(self.memo) > MEMO:
            self.memo.clear()
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.strings.__getitem__, ids)).decode("utf-8", "replace")


class _Memo(dict):
    """Ids of each pre-token seen; a long one is not kept."""

    def __init__(self, word: Callable[[str], tuple[int, ...]]) -> None:
        super().__init__()
        self.word = word

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self.word(piece)
        if len(piece) < 64:
            self[piece] = ids
        return ids


_READY: dict[str, Bpe] = {}


def _loaded(content: Broadcast) -> Bpe:
    """One encoder in each Python worker; its memo serves all tasks there."""
    text = content.value
    key = hashlib.sha256(text.encode()).hexdigest()
    if key not in _READY:
        _READY.clear()
        _READY[key] = Bpe(text)
    return _READY[key]


def tokenizer_file(spark: SparkSession, path: str) -> Broadcast:
    """The vocabulary file's content for all tasks (a few MB, fixed)."""
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``docs`` with an added column ``ids array<int>``; a clashing one is replaced."""
    content = tokenizer_file(docs.sparkSession, path)
    kept = docs.drop("ids")
    schema = T.StructType([*kept.schema, T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(content)
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                ids = [bpe.encode(t or "") for t in part.column(text).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(ids, pa.list_(pa.int32()))], [*part.schema.names, "ids"])

    return small_batches(kept).mapInArrow(run, schema)


def decode(rows: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """``rows`` with an added column ``decoded string``; a clashing one is replaced."""
    content = tokenizer_file(rows.sparkSession, path)
    kept = rows.drop("decoded")
    schema = T.StructType([*kept.schema, T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(content)
        for batch in batches:
            texts = [bpe.decode(x or []) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "decoded"])

    return small_batches(kept).mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``docs`` with ``ids`` and what they decode to, ``decoded``, made in one pass.

    One worker a task holds the vocabulary then, where :func:`encode` followed
    by :func:`decode` has two.  Clashing columns are replaced.
    """
    content = tokenizer_file(docs.sparkSession, path)
    kept = docs.drop("ids", "decoded")
    schema = T.StructType([*kept.schema, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(content)
        for batch in batches:
            for lo in range(0, batch.num_rows, 100):
                part = batch.slice(lo, 100)
                ids = [pa.array(bpe.encode(t.as_py() or ""), pa.int32()) for t in part.column(text)]
                texts = [bpe.decode(x.to_pylist()) for x in ids]
                at = pa.array([0, *accumulate(map(len, ids))], pa.int32())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(at, pa.concat_arrays(ids)), pa.array(texts, pa.string())], [*part.schema.names, "ids", "decoded"])

    return small_batches(kept).mapInArrow(run, schema)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Encode, then decode, each whole text; counts and digests of both."""
    content = tokenizer_file(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(content)
        for batch in batches:
            counts, ids_sha, decoded_sha = [], [], []
            for i in range(batch.num_rows):
                ids = bpe.encode(batch.column(1)[i].as_py() or "")
                counts.append(len(ids))
                ids_sha.append(hashlib.sha256(",".join(map(bpe.names.__getitem__, ids)).encode()).hexdigest())
                decoded_sha.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha), pa.array(decoded_sha)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return small_batches(docs.select("doc_id", "text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
