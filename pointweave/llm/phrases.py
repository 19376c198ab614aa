"""Phrase collocations from FM-indexes over word ids (operator 11).

A shard is what a task reads, one language at a time and about ``SHARD`` words, and keeps
its own dictionary.  Words travel packed by bucket, and those that occur often enough anywhere get a number; in a shard's
sequence the others become one common symbol a run, and piece ends another.  The shard's
index is the BWT of that sequence and of its reverse, from suffixes ordered to the
longest phrase's depth, which is all that intervals of such phrases need.

Phrases grow a word a level.  A shard finds the intervals of the phrases that are frequent
so far by backward search in both directions, and extends each to the right through
the reverse BWT; the forward interval moves by the number of lesser symbols.  An
extension counts only if the phrase without its first word is frequent too, as no other
can be.  Local counts are packed by bucket of the phrase and summed over shards, and what is
frequent goes back to the shards that hold it.  Two numbers come with each count: how many of the occurrences have a word
to their left and to their right, which the two intervals tell.

Defined results: a null or empty text has no words; documents without a language belong
to ``und``, as those named so; ids are not read, so null or repeated ids and repeated rows
just count; ties in score and count go by the phrase; an empty table, or one without
frequent phrases, gives an empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pointweave.llm.common import LOWER, durable, mix64, release, small_batches
from pointweave.sources.durable import shared_dir

#: Words of a shard; a longer piece of text makes a longer shard.
SHARD = 1 << 20
#: Least number of buckets that local counts are summed in.
BUCKETS = 256
#: Symbols of a sequence: the end of a piece, a run of words that are nowhere frequent, then words.
END, RARE, WORD = 0, 1, 2

_ENDS = b".,;:!?\n\x0b\x0c\r"
_TABLE = LOWER.copy()
_TABLE[9] = 32
_TABLE[list(_ENDS)] = 10
_TABLE = _TABLE.tobytes()


def words_of(texts: list[bytes], ids: defaultdict[bytes, int]) -> np.ndarray:
    """Numbers of the words of texts, which ``ids`` (0 the empty word, 1 the end of a piece) gives and remembers."""
    flat = b"\n".join(texts).translate(_TABLE).replace(b"\n", b" \n ").split(b" ")
    out = np.fromiter(map(ids.__getitem__, flat), np.int32, len(flat))
    return out[out != 0]


def _dictionary() -> defaultdict[bytes, int]:
    ids: defaultdict[bytes, int] = defaultdict()
    ids.default_factory = ids.__len__
    ids[b""], ids[b"\n"] = 0, 1
    return ids


_SHARDS = "shard long, lang string, words array<string>, counts array<int>, seq binary"


def shards(docs: DataFrame) -> DataFrame:
    """shard, lang, distinct words with their counts, and the packed sequence (1 the end of a piece, 2 the first word)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        task, made = TaskContext.get().partitionId(), 0
        held: dict[str, list[np.ndarray]] = {}
        ids: dict[str, defaultdict[bytes, int]] = {}

        def finish(lang: str) -> pa.RecordBatch:
            nonlocal made
            seq = np.concatenate(held.pop(lang))
            own = ids.pop(lang)
            counts = np.bincount(seq, minlength=len(own))[2:]
            names = list(own)[2:]
            made += 1
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([(task << 32) + made]), pa.array([lang]), pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), pa.array(names, pa.binary()).cast(pa.string())),
                    pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), pa.array(counts.astype(np.int32))), pa.array([pack.compress(seq.tobytes())], pa.binary()),
                ],
                ["shard", "lang", "words", "counts", "seq"],
            )

        for batch in batches:
            groups: dict[str, list[bytes]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if text.is_valid and len(text.as_buffer()):
                    groups.setdefault(lang, []).append(text.as_buffer().to_pybytes())
            for lang, texts in groups.items():
                for lo in range(0, len(texts), 64):
                    seq = words_of(texts[lo : lo + 64], ids.setdefault(lang, _dictionary()))
                    held.setdefault(lang, [np.array([1], np.int32)]).extend((seq, np.array([1], np.int32)))
                    if sum(map(len, held[lang])) >= SHARD:
                        yield finish(lang)
        for lang in sorted(held):
            yield finish(lang)

    return small_batches(docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")).mapInArrow(run, _SHARDS)


def depth_ranks(text: np.ndarray, depth: int) -> np.ndarray:
    """Places of all suffixes, ordered by their first ``depth`` symbols at least (prefix doubling; the end repeats symbol 0)."""
    rank, reach = text.astype(np.int64), 1
    while True:
        shifted = np.zeros_like(rank)
        shifted[:-reach] = rank[reach:]
        key = rank * (int(rank.max()) + 1) + shifted
        order = np.argsort(key, kind="stable")
        reach *= 2
        if reach >= depth:
            return order
        sorted_ = key[order]
        rank[order] = np.cumsum(np.r_[0, sorted_[1:] != sorted_[:-1]])


def transform(text: np.ndarray, depth: int) -> np.ndarray:
    """BWT: the symbol before each suffix in order."""
    return text[depth_ranks(text, depth) - 1]


class Bwt:
    """Backward search in one direction; intervals are arrays."""

    def __init__(self, bwt: np.ndarray, symbols: int) -> None:
        self.bwt, self.n = bwt, len(bwt)
        order = np.argsort(bwt, kind="stable")
        # occurrences sorted by (symbol, place): a symbol's rank before a place is found by bisection
        self.places = bwt[order].astype(np.int64) * (self.n + 1) + order
        self.starts = np.r_[0, np.cumsum(np.bincount(bwt, minlength=symbols))]
        self.ends = np.r_[0, np.cumsum(bwt == END)]

    def step(self, low: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Where interval bounds go when a symbol is put in front."""
        return np.searchsorted(self.places, symbol.astype(np.int64) * (self.n + 1) + low)

    def bounded(self, low: np.ndarray, size: np.ndarray) -> np.ndarray:
        """How many suffixes of each interval stand behind the end of a piece."""
        return self.ends[low + size] - self.ends[low]


class Index:
    """Both directions of one sequence."""

    def __init__(self, forward: np.ndarray, backward: np.ndarray, symbols: int) -> None:
        self.symbols = symbols
        self.forward, self.backward = Bwt(forward, symbols), Bwt(backward, symbols)

    def find(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Forward low, backward low and size of the interval of each row of symbols."""
        low, high = self.forward.starts[phrases[:, -1]], self.forward.starts[phrases[:, -1] + 1]
        for k in range(phrases.shape[1] - 2, -1, -1):
            low, high = self.forward.step(low, phrases[:, k]), self.forward.step(high, phrases[:, k])
        back = self.backward.starts[phrases[:, 0]]
        for k in range(1, phrases.shape[1]):
            back = self.backward.step(back, phrases[:, k])
        return low, back, high - low

    def extended(self, low: np.ndarray, back: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
        """Right extensions by words: parent, symbol, and the interval of each."""
        first = np.repeat(back - np.r_[0, np.cumsum(size)[:-1]], size)
        symbol = self.backward.bwt[first + np.arange(len(first))].astype(np.int64)
        key = np.repeat(np.arange(len(size)), size) * self.symbols + symbol
        key.sort()
        fresh = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        found = np.diff(np.r_[fresh, len(key)])
        parent, symbol = key[fresh] // self.symbols, key[fresh] % self.symbols
        # the symbols less than this one of the parent's interval come before it
        lesser = fresh - np.r_[0, np.cumsum(size)][parent]
        word = symbol >= WORD
        parent, symbol, found, lesser = parent[word], symbol[word], found[word], lesser[word]
        return parent, symbol, low[parent] + lesser, self.backward.step(back[parent], symbol), found


def _unpacked(data: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), kind)


def _planes(*arrays: np.ndarray) -> bytes:
    """Arrays of one length, byte by byte, as numbers of one range share their high bytes."""
    return zstandard.compress(b"".join(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() for a in arrays), 1)


def _arrays(data: bytes, *kinds: str) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.decompress(data), np.uint8)
    widths = [np.dtype(k).itemsize for k in kinds]
    n, at, out = len(raw) // sum(widths), 0, []
    for kind, width in zip(kinds, widths):
        out.append(np.ascontiguousarray(raw[at : at + n * width].reshape(width, n).T).view(kind).ravel())
        at += n * width
    return out


#: What a shard tells of an extension: name of the phrase, last word, occurrences, those with a word before and behind.
_LOCAL = ("<i8", "<i8", "<i4", "<i4", "<i4")
#: What is summed up of a frequent one, and what its shards are told.
_SUMMED, _BACK = ("<i8",) * 6, ("<i8",) * 3


#: What a shard tells of a word besides its bytes, and what it is told of a frequent one: place in its dictionary (as steps), occurrences or number.
_HELD, _FOUND = ("<i4", "<i4"), ("<i4", "<i8")


def _word_packs(sharded: DataFrame, buckets: int) -> DataFrame:
    """Each shard's words by bucket of the word: bucket, shard, lang, words (by line ends, which are in no word), data."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                words = batch.column(2)[i].values.cast(pa.binary()).to_pylist()
                counts = batch.column(3)[i].values.to_numpy()
                bucket = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)) % np.uint64(buckets)
                order = np.argsort(bucket, kind="stable")
                cuts = np.r_[np.flatnonzero(np.r_[True, np.diff(bucket[order]) != 0]), len(order)] if len(order) else np.zeros(1, np.int64)
                parts = [order[x:y] for x, y in zip(cuts.tolist(), cuts[1:].tolist())]
                columns = [
                    pa.array(bucket[order[cuts[:-1]]].astype(np.int64)),
                    pa.array(np.full(len(parts), batch.column(0)[i].as_py(), np.int64)),
                    pa.array([batch.column(1)[i].as_py()] * len(parts), pa.string()),
                    pa.array([zstandard.compress(b"\n".join([words[j] for j in part.tolist()]), 3) for part in parts], pa.binary()),
                    pa.array([_planes(np.diff(part, prepend=0).astype("<i4"), counts[part].astype("<i4")) for part in parts], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["bucket", "shard", "lang", "words", "data"])

    return sharded.select("shard", "lang", "words", "counts").mapInArrow(run, "bucket long, shard long, lang string, words binary, data binary")


_NAMED = "shard long, lang string, n long, words array<string>, counts array<long>, gids array<long>, data binary"


def _named(packs: DataFrame, least: int) -> DataFrame:
    """Words of a bucket summed up.  Rows of shard -1: a language's words n, and its frequent words with counts and
    numbers; the others tell shards which of their words are frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def finish() -> pa.RecordBatch:
            sums: dict[str, dict[bytes, int]] = {}
            for _, lang, words, data in held:
                own = sums.setdefault(lang, {})
                for w, c in zip(zstandard.decompress(words).split(b"\n"), _arrays(data, *_HELD)[1].tolist()):
                    own[w] = own.get(w, 0) + c
            out, gids, first = [], {}, at << 32
            for lang, own in sums.items():
                often = [w for w, c in own.items() if c >= least]
                gids[lang] = dict(zip(often, range(first, first + len(often))))
                first += len(often)
                out.append((-1, lang, sum(own.values()), [w.decode() for w in often], [own[w] for w in often], list(gids[lang].values()), None))
            for shard, lang, words, data in held:
                gid = np.array([gids[lang].get(w, -1) for w in zstandard.decompress(words).split(b"\n")], np.int64)
                local = np.cumsum(_arrays(data, *_HELD)[0])
                if (gid >= 0).any():
                    out.append((shard, lang, None, None, None, None, _planes(np.diff(local[gid >= 0], prepend=0).astype("<i4"), gid[gid >= 0])))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["shard", "lang", "n", "words", "counts", "gids", "data"])

        for batch in batches:
            for bucket, *row in zip(*(batch.column(c).to_pylist() for c in range(5))):
                if bucket != at:
                    if held:
                        yield finish()
                    at, held = bucket, []
                held.append(row)
        if held:
            yield finish()

    return packs.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, _NAMED)


def _indexes(sequences: DataFrame, depth: int) -> DataFrame:
    """shard, gids (global number of each local word) and both BWTs; sequences: shard, seq, frequent (packs of local, gid)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for i in range(batch.num_rows):
                seq = _unpacked(batch.column(1)[i].as_py(), np.int32)
                packs = [_arrays(data, *_FOUND) for data in batch.column(2)[i].as_py()]
                local, gid = np.concatenate([np.cumsum(steps) for steps, _ in packs]), np.concatenate([gids for _, gids in packs])
                order = np.argsort(gid)
                symbol = np.full(int(seq.max()) + 1, RARE, np.int32)
                symbol[1] = END
                symbol[local[order] + 2] = np.arange(len(order)) + WORD
                text = symbol[seq]
                again = np.r_[False, (text[1:] == text[:-1]) & (text[1:] < WORD)]
                text = text[~again]
                made = [pack.compress(transform(t, depth).astype(np.int32).tobytes()) for t in (text, text[::-1])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([pack.compress(gid[order].astype(np.int64).tobytes())], pa.binary()), *(pa.array([m], pa.binary()) for m in made)], ["shard", "gids", "forward", "backward"])

    return sequences.select("shard", "seq", "frequent").mapInArrow(run, "shard long, gids binary, forward binary, backward binary")


def _known(gids: np.ndarray, told: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Names and symbols of the frequent phrases of a shard, from what it was told level by level."""
    names, symbols = gids, np.arange(len(gids)).reshape(-1, 1) + WORD
    for level in told:
        parts = [_arrays(data, *_BACK) for data in level]
        name, prefix, last = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(names)
        heads = order[np.searchsorted(names[order], prefix)]
        names, symbols = name, np.hstack([symbols[heads], (np.searchsorted(gids, last) + WORD).reshape(-1, 1)])
    return names, symbols


def _grown(indexes: DataFrame, size: int, buckets: int) -> DataFrame:
    """Phrases of size + 1 words in each shard, packed by bucket: bucket, shard, data.

    indexes: shard, gids, forward, backward and what the shard was told of each level so far.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                gids = _unpacked(batch.column(1)[i].as_py(), np.int64)
                index = Index(*(_unpacked(batch.column(c)[i].as_py(), np.int32) for c in (2, 3)), len(gids) + WORD)
                names, words = _known(gids, [batch.column(4 + c)[i].as_py() for c in range(size - 1)])
                parent, symbol, low, back, found = index.extended(*index.find(words))
                if size > 1:
                    # the extension without its first word has a head and a last word too: is it among the known?
                    heads, head = np.unique(words[:, :-1], axis=0, return_inverse=True)
                    have = np.sort(head.ravel() * index.symbols + words[:, -1])
                    tails = _places(heads, words[:, 1:])[parent]
                    key = tails * index.symbols + symbol
                    at = np.minimum(np.searchsorted(have, key), len(have) - 1)
                    keep = (tails >= 0) & (have[at] == key)
                    parent, symbol, low, back, found = (x[keep] for x in (parent, symbol, low, back, found))
                prefix, last = names[parent], gids[symbol - WORD]
                columns = [prefix, last, found, found - index.forward.bounded(low, found), found - index.backward.bounded(back, found)]
                bucket = (mix64(mix64(prefix.astype(np.uint64)) + last.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
                order = np.lexsort((last, prefix, bucket))
                bucket, columns = bucket[order], [c[order] for c in columns]
                cuts = np.r_[np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]), len(bucket)] if len(bucket) else np.zeros(1, np.int64)
                packs = [_planes(np.diff(columns[0][x:y], prepend=0), *(c[x:y].astype(k) for c, k in zip(columns[1:], _LOCAL[1:]))) for x, y in zip(cuts.tolist(), cuts[1:].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(bucket[cuts[:-1]]), pa.array(np.full(len(packs), batch.column(0)[i].as_py(), np.int64)), pa.array(packs, pa.binary())], ["bucket", "shard", "data"])

    return indexes.mapInArrow(run, "bucket long, shard long, data binary")


def _merged(packs: DataFrame, least: int) -> DataFrame:
    """Rows of a bucket summed up: shard (-1: the sums), data.  A frequent phrase gets a name, told to the shards that hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def finish() -> pa.RecordBatch:
            parts = [_arrays(data, *_LOCAL) for _, data in held]
            shard = np.repeat([s for s, _ in held], [len(p[0]) for p in parts])
            prefix = np.concatenate([np.cumsum(p[0]) for p in parts])
            last, *numbers = (np.concatenate([p[k] for p in parts]).astype(np.int64) for k in range(1, 5))
            order = np.lexsort((shard, last, prefix))
            shard, prefix, last = shard[order], prefix[order], last[order]
            fresh = np.r_[True, (prefix[1:] != prefix[:-1]) | (last[1:] != last[:-1])]
            starts = np.flatnonzero(fresh)
            sums = [np.add.reduceat(x[order], starts) for x in numbers]
            often = sums[0] >= least
            names = (at << 32) + np.cumsum(often) - 1
            out = [(-1, _planes(*(x[often] for x in (names, prefix[starts], last[starts], *sums))))]
            group = np.cumsum(fresh) - 1
            rows = np.flatnonzero(often[group])
            rows = rows[np.argsort(shard[rows], kind="stable")]
            cuts = np.r_[np.flatnonzero(np.r_[True, shard[rows][1:] != shard[rows][:-1]]), len(rows)] if len(rows) else np.zeros(1, np.int64)
            for x, y in zip(cuts.tolist(), cuts[1:].tolist()):
                own = rows[x:y]
                out.append((int(shard[own[0]]), _planes(names[group[own]], prefix[own], last[own])))
            return pa.RecordBatch.from_arrays([pa.array([s for s, _ in out], pa.int64()), pa.array([d for _, d in out], pa.binary())], ["shard", "data"])

        for batch in batches:
            for bucket, shard, data in zip(*(batch.column(c).to_pylist() for c in range(3))):
                if bucket != at:
                    if held:
                        yield finish()
                    at, held = bucket, []
                held.append((shard, data))
        if held:
            yield finish()

    return packs.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "shard long, data binary")


def _spelled(merged: DataFrame) -> DataFrame:
    """name, prefix, last, count, before and after of the frequent phrases."""
    names = ["name", "prefix", "last", "count", "before", "after"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in _arrays(data, *_SUMMED)], names)

    return merged.where("shard = -1").select("data").mapInArrow(run, ", ".join(f"{n} long" for n in names))


def _places(rows: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Index of each wanted row among sorted distinct rows, -1 where it is none of them."""
    both = np.concatenate([rows, wanted])
    _, ids = np.unique(both, axis=0, return_inverse=True)
    ids = ids.ravel()
    place = np.full(int(ids.max()) + 1 if len(ids) else 0, -1)
    place[ids[: len(rows)]] = np.arange(len(rows))
    return place[ids[len(rows) :]]


def _bucketed(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` as a table bucketed by shard: what shards are told comes to its rows, which are not shuffled again."""
    spark, table = rows.sparkSession, f"{name}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{table}"
    rows.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), "shard").option("path", path).option("compression", "zstd").saveAsTable(table)
    out = spark.table(table)
    out._durable_path, out._table = path, table
    return out


def _dropped(table: DataFrame) -> None:
    table.sparkSession.sql(f"DROP TABLE IF EXISTS {table._table}")
    release(table)


def frequent(docs: DataFrame, longest: int, least: int) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """Words (gid, lang, word, count), words in all of each language (lang, n), and the phrases of 2 to ``longest``
    words that occur ``least`` times: name, words (gids), count, before, after."""
    sharded = _bucketed(shards(docs), "shards")
    # as many buckets as keep each in a task's memory
    entries = sharded.agg(F.sum(F.size("counts"))).first()[0] or 0
    named = durable(_named(_word_packs(sharded, max(BUCKETS, entries >> 20)), least), "named")
    own = named.where("shard = -1")
    totals = durable(own.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    words = durable(own.select("lang", F.explode(F.arrays_zip("words", "counts", "gids")).alias("w")).select("lang", F.col("w.words").alias("word"), F.col("w.counts").alias("count"), F.col("w.gids").alias("gid")), "words")
    found = named.where("shard >= 0").groupBy("shard").agg(F.collect_list("data").alias("frequent"))
    indexes = _bucketed(_indexes(sharded.select("shard", "seq").join(found, "shard"), longest), "indexes")
    release(named)
    _dropped(sharded)
    buckets = max(BUCKETS, (totals.agg(F.sum("n")).first()[0] or 0) >> 21)
    known = words.select(F.col("gid").alias("name"), F.array("gid").alias("words"))
    levels, asked, told = [], indexes, []
    for size in range(1, longest):
        merged = durable(_merged(_grown(asked, size, buckets), least), "merged")
        level = durable(_spelled(merged).join(known.select(F.col("name").alias("prefix"), "words"), "prefix").select("name", F.concat("words", F.array("last")).alias("words"), "count", "before", "after"), "phrases")
        levels.append(level.select("words", "count", "before", "after"))
        known = level.select("name", "words")
        if size + 1 < longest:
            told.append(_bucketed(merged.where("shard >= 0").groupBy("shard").agg(F.collect_list("data").alias(f"told_{size}")), "told"))
            asked = asked.join(told[-1], "shard")
        release(merged)
    for table in (indexes, *told):
        _dropped(table)
    return words, totals, levels


def collocations(docs: DataFrame, longest: int = 5, least: int = 100, best: int = 2000, covered: int = 100) -> DataFrame:
    """Each language's ``best`` phrases of 2 to ``longest`` words: lang, rank, phrase, a, l, r, n, score, before, after.

    A phrase that lies inside a longer one with at least ``covered`` per cent of its count is dropped.
    """
    words, totals, levels = frequent(docs, longest, least)
    every = levels[0]
    for level in levels[1:]:
        every = every.unionAll(level)
    every = durable(every.withColumn("m", F.size("words")), "every")
    counts = every.select("words", "count").unionAll(words.select(F.array("gid").alias("words"), "count"))
    # both parts of every cut
    cuts = every.select("words", F.col("count").alias("a"), F.explode(F.sequence(F.lit(1), F.col("m") - 1)).alias("k"))
    parts = cuts.select("words", "a", "k", F.explode(F.array(F.struct(F.lit("l").alias("side"), F.expr("slice(words, 1, k)").alias("part")), F.struct(F.lit("r").alias("side"), F.expr("slice(words, k + 1, size(words) - k)").alias("part")))).alias("p")).select("words", "a", "k", "p.*")
    sized = parts.join(counts.select(F.col("words").alias("part"), F.col("count").alias("f")), "part")
    both = sized.groupBy("words", "a", "k").agg(F.max(F.when(F.col("side") == "l", F.col("f"))).alias("l"), F.max(F.when(F.col("side") == "r", F.col("f"))).alias("r"))
    lang = words.select(F.col("gid").alias("head"), "lang").join(totals, "lang")
    placed = both.withColumn("head", F.col("words")[0]).join(lang, "head")
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    placed = placed.withColumns({"top": (wide("a") * wide("n") * F.lit(1000).cast("decimal(4,0)")).cast("decimal(38,0)"), "under": wide("l") * wide("r")})
    scored = placed.withColumn("score", F.expr("top div under")).groupBy("words", "lang", "n", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("low"))
    # what a longer phrase covers
    inner = every.where("m > 2").select("count", "words", F.explode(F.expr("flatten(transform(sequence(2, m - 1), s -> transform(sequence(1, m - s + 1), i -> slice(words, i, s))))")).alias("part"))
    covers = inner.groupBy(F.col("part").alias("words")).agg(F.max("count").alias("longer"))
    left = scored.join(covers, "words", "left").where(F.col("longer").isNull() | (F.lit(100).cast("decimal(5,0)") * F.col("longer") < F.lit(covered).cast("decimal(5,0)") * F.col("a")))
    spelled = left.select("words", F.posexplode("words").alias("pos", "gid")).join(words.select("gid", "word"), "gid")
    phrases = spelled.groupBy("words").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda w: w["word"]), " ").alias("phrase"))
    rows = left.join(phrases, "words").join(every.select("words", "before", "after"), "words")
    rows = rows.select("lang", "phrase", "a", F.col("low.l").alias("l"), F.col("low.r").alias("r"), "n", F.col("low.score").alias("score"), "before", "after")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    # the best of each share of a language first, so that no language meets in one task
    some = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(64))).orderBy(*order)
    few = rows.withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= best).drop("rank")
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= best)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score", "before", "after")


ORACLE = r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
g AS (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM (SELECT lang, w, unnest(range(1, 6)) AS m FROM w) WHERE len(w) >= m),
f AS MATERIALIZED (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase, count(*) AS f, count(*) FILTER (i > 1) AS before, count(*) FILTER (i + m - 1 < len(w)) AS after FROM g GROUP BY 1, 2, 3 HAVING count(*) >= 100),
n AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM w GROUP BY 1),
c AS MATERIALIZED (SELECT lang, m, phrase, f AS a, before, after, string_split(phrase, ' ') AS w FROM f WHERE m > 1),
k AS (SELECT lang, m, phrase, a, before, after, w, unnest(range(1, m)) AS k FROM c),
s AS (SELECT k.lang, k.m, k.phrase, a, k.before, k.after, k, l.f AS l, r.f AS r, n, 1000::HUGEINT * a * n // (l.f::HUGEINT * r.f) AS score
  FROM k JOIN f l ON l.lang = k.lang AND l.phrase = array_to_string(k.w[:k], ' ') JOIN f r ON r.lang = k.lang AND r.phrase = array_to_string(k.w[k + 1:], ' ') JOIN n ON n.lang = k.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
p AS (SELECT lang, a, w, z, unnest(range(1, m - z + 2)) AS i FROM (SELECT lang, m, a, w, unnest(range(2, m)) AS z FROM c)),
o AS (SELECT lang, array_to_string(w[i:i + z - 1], ' ') AS phrase, max(a) AS longer FROM p GROUP BY 1, 2),
x AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank FROM b LEFT JOIN o ON o.lang = b.lang AND o.phrase = b.phrase WHERE longer IS NULL OR 100 * longer < 100 * a)
SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score, before, after FROM x WHERE rank <= 2000
"""
