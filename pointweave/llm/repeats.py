"""Verbatim repeats across a corpus by prefix-free parsing (operator 2).

A byte is removed if a ``length``-byte string that covers it also starts
earlier: in a document of smaller doc_id, or earlier in the same document.

Parsing.  A rolling hash of ``GRAM`` bytes chooses triggers: of every window of
``reach`` start positions, the one of least hash (the leftmost of equals).
Whether a position is the trigger of a window depends on the bytes of that
window alone, so equal strings are cut alike wherever they stand.  The start
positions that share a trigger form a phrase; it is taken together with the
``length`` bytes that follow, which is all of the parse's suffix that matters.

Dictionary and parse.  The distinct phrases are the dictionary, the occurrences
the parse.  All occurrences are sorted by (trigger bytes, phrase, doc_id,
place), where digests stand for the first two: a phrase is looked at once,
however often the corpus repeats it, and every occurrence that is not the first
of its phrase is a repeat as a whole.  A first one can only repeat parts of other
phrases that share its trigger bytes.  For those, the phrases that meet in a
task form one dictionary text, and its suffix array, built by prefix doubling
over the bytes to the depth of ``length``, brings equal strings together; with
the occurrences of their phrases, the earliest of each stays and the others are
repeats.  Matches matter to ``length`` bytes only, so neither array goes deeper,
and arrays are per task, as no order across tasks is needed.

Frequent triggers.  A first pass counts trigger bytes.  Those of more than 1 in
``HOT`` occurrences (fewer than ``HOT``, whatever the corpus; only these reach
the driver) are dealt by phrase instead, and so are triggers of more than
``MANY`` occurrences: the start positions of their firsts then part ways by the
digests of their own strings, so that no trigger gathers in a task.

Every task first reduces what it read: of equal phrases it sends the earliest
and knows the others to be repeats.  So a phrase that fills a third of the
corpus is a row per task in the shuffle.

Defined results: a null text counts as empty; texts under ``length`` bytes
keep everything.  A null id sorts after all others.  Rows of one id (or of
none) are parts of one document, told apart by ``part``, a 64-bit digest of the
text: of equal strings the one at the least place in its row comes first, then
the one of least part.  Marks are grouped and joined by id and part, so that no
group grows with the number of rows of an id.  Repeated rows are the same row
and get the same result.  An empty table gives an empty table; further columns
are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pointweave.llm.common import durable, flat_bytes, mix64, pieces, release, small_batches

LENGTH, GRAM = 100, 8
HELD_BYTES = 1 << 20
#: Occurrences that a task reduces at a time.
REDUCED = 400_000
#: Occurrences beyond which the start positions of a trigger's phrases part ways,
#: and rows that a task sorts at a time.
MANY, KEYED = 4_000, 8_000
#: Triggers of a larger share of all occurrences than 1 in ``HOT`` are dealt by phrase.
HOT = 2_000

U64 = np.uint64
_LAST = (1 << 63) - 1
_COUNT = (1 << 32) - 1
#: Texts with firsts that a task remembers, to look into repeated rows once.
SEEN = 100_000


def phrases(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trigger, first start position and number of start positions of each phrase.

    Positions count from the first of the concatenated texts.
    """
    reach = 64
    while reach + GRAM > length:
        reach //= 2
    n = len(data)
    none = (np.zeros(0, np.int64),) * 3
    if n < length:
        return none
    padded = np.concatenate([data, np.zeros(GRAM, np.uint8)])
    grams = np.ndarray(n, "<u8", padded, strides=(1,)).astype(U64)
    key = (mix64(grams) & U64(0xFFFFFFFF00000000)) | np.arange(n, dtype=U64)
    step = 1
    while step < reach:
        key[:-step] = np.minimum(key[:-step], key[step:])
        step *= 2
    # start positions whose string lies inside its text
    valid = np.zeros(n + 1, np.int8)
    long = np.diff(offsets) >= length
    np.add.at(valid, offsets[:-1][long], 1)
    np.add.at(valid, offsets[1:][long] - length + 1, -1)
    at = np.flatnonzero(np.cumsum(valid[:n], dtype=np.int8))
    if not len(at):
        return none
    trigger = (key[at] & U64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, (trigger[1:] != trigger[:-1]) | (at[1:] != at[:-1] + 1)])
    return trigger[first], at[first], np.diff(np.r_[first, len(at)])


def _reduced(key: np.ndarray, own: np.ndarray, doc: np.ndarray, part: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the earliest of equal (key, own), and of the later ones.

    Rows of the same document, part and place are the same occurrence (a repeated row).
    """
    order = np.lexsort((part, place, doc, own, key))
    k, o, d, t, p = key[order], own[order], doc[order], part[order], place[order]
    new = np.r_[True, (k[1:] != k[:-1]) | (o[1:] != o[:-1])]
    start = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    same = (d == d[start]) & (t == t[start]) & (p == p[start])
    return order[new], order[~same]


_COLUMNS = ["key", "own", "doc", "part", "place"]
#: kind of an occurrence: the first of its phrase in its task, a later one, or a first one of a frequent trigger.
FIRST, LATER, OFTEN = 0, 1, 2
_ROWS = "key long, own long, doc long, part long, place long, kind int"


def _rows(key: np.ndarray, own: np.ndarray, doc: np.ndarray, part: np.ndarray, place: np.ndarray, hot: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """The earliest of equal rows, and the runs of those known to be repeats."""
    if not len(key):
        return
    if hot is None or not len(hot):
        often = np.zeros(len(key), bool)
    else:  # the occurrences of a frequent trigger part ways by their phrases
        often = hot[np.minimum(np.searchsorted(hot, key), len(hot) - 1)] == key
        key = np.where(often, mix64(key.view(U64) ^ mix64(own.view(U64))).view(np.int64), key)
    first, later = _reduced(key, own, doc, part, place)
    yield _batch(key[first], own[first], doc[first], part[first], place[first], np.where(often[first], OFTEN, FIRST))
    if len(later):
        # neighbouring phrases of a text join into one run; repeated rows count once
        order = later[np.lexsort((place[later], part[later], doc[later]))]
        d, t, p = doc[order], part[order], place[order]
        once = np.r_[True, (d[1:] != d[:-1]) | (t[1:] != t[:-1]) | (p[1:] != p[:-1])]
        d, t, start, count = d[once], t[once], p[once] >> 32, p[once] & _COUNT
        joins = (d[1:] == d[:-1]) & (t[1:] == t[:-1]) & (start[1:] == start[:-1] + count[:-1])
        head = np.flatnonzero(np.r_[True, ~joins])
        place = start[head] << 32 | np.add.reduceat(count, head)
        spread = mix64(mix64(d[head].view(U64) ^ place.view(U64)) ^ t[head].view(U64)).view(np.int64)
        yield _batch(spread, np.zeros(len(place), np.int64), d[head], t[head], place, np.full(len(place), LATER))


def _batch(key: np.ndarray, own: np.ndarray, doc: np.ndarray, part: np.ndarray, place: np.ndarray, kind: np.ndarray) -> pa.RecordBatch:
    arrays = [pa.array(np.ascontiguousarray(x).view(np.int64)) for x in (key, own, doc, part, place)]
    return pa.RecordBatch.from_arrays([*arrays, pa.array(kind.astype(np.int32))], [*_COLUMNS, "kind"])


def _trigger_keys(raw: bytes, trigger: np.ndarray, length: int) -> np.ndarray:
    """Digests of the bytes that every string of a trigger is sure to share."""
    near = length - 63 if length >= 64 + GRAM else GRAM
    return np.array([xxhash.xxh3_64_intdigest(raw[a : a + near]) for a in trigger.tolist()], U64).view(np.int64)


def frequent_triggers(docs: DataFrame, length: int) -> np.ndarray:
    """Sorted keys of the triggers of more than 1 in ``HOT`` occurrences: fewer than ``HOT``, however large the corpus.

    A task sends the keys of more than 1 in 4 ``HOT`` of its own occurrences, so
    that a trigger that is missed has less than 1.25 in ``HOT`` of all.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0

        def finish() -> pa.RecordBatch:
            key, n = np.unique(np.concatenate(held), return_counts=True)
            often = n * 4 * HOT > count
            # the row without a key tells how many there were
            return pa.RecordBatch.from_arrays([pa.array([None, *key[often].tolist()], pa.int64()), pa.array([count, *n[often].tolist()], pa.int64())], ["key", "n"])

        for batch in batches:
            for lo, hi in pieces(batch.column(0), HELD_BYTES):
                data, offsets = flat_bytes(batch.column(0), lo, hi)
                held.append(_trigger_keys(data.tobytes(), phrases(data, offsets, length)[0], length))
                count += len(held[-1])
            if count >= REDUCED:
                yield finish()
                held, count = [], 0
        if count:
            yield finish()

    counted = durable(small_batches(docs.select("text").where("text IS NOT NULL")).mapInArrow(run, "key long, n long"), "triggers")
    total = counted.where("key IS NULL").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    often = counted.where("key IS NOT NULL").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") * HOT > total).select("key").collect()
    release(counted)
    return np.sort(np.array([r["key"] for r in often], np.int64))


def _parse(docs: DataFrame, length: int) -> DataFrame:
    """Occurrences of phrases.  place packs start << 32 and count."""
    hot = frequent_triggers(docs, length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        count = 0
        for batch in batches:
            ids, parts = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for lo, hi in pieces(batch.column(2), HELD_BYTES):
                data, offsets = flat_bytes(batch.column(2), lo, hi)
                trigger, first, n = phrases(data, offsets, length)
                if not len(first):
                    continue
                raw = data.tobytes()
                digest = xxhash.xxh3_64_intdigest
                key = _trigger_keys(raw, trigger, length)
                own = np.array([digest(raw[a:b]) for a, b in zip(first.tolist(), (first + n - 1 + length).tolist())], U64).view(np.int64)
                row = np.searchsorted(offsets, first, "right") - 1
                place = (first - offsets[row]) << 32 | n
                held.append([key, own, ids[lo:hi][row], parts[lo:hi][row], place])
                count += len(key)
                if count >= REDUCED:
                    yield from _rows(*(np.concatenate(x) for x in zip(*held)), hot)
                    held, count = [], 0
        if held:
            yield from _rows(*(np.concatenate(x) for x in zip(*held)), hot)

    return small_batches(docs.select("doc", "part", "text")).mapInArrow(run, _ROWS)


def _compared(rows: DataFrame) -> DataFrame:
    """Rows in suffix order with what they are: a repeat, or a first that must be looked into."""
    key = Window.partitionBy("key")
    nth = F.rank().over(Window.partitionBy("key", "own").orderBy("doc", "place", "part"))
    return (
        rows.withColumn("nth", nth)
        .withColumn("mixed", (F.col("kind") == OFTEN) | (F.min("own").over(key) != F.max("own").over(key)))
        .withColumn("many", (F.col("kind") == OFTEN) | (F.count(F.lit(1)).over(key) > MANY))
        .withColumn("repeat", (F.col("kind") == LATER) | (F.col("nth") > 1))
        .where("repeat or mixed")
        .select("key", "doc", "part", "place", "repeat", "many")
    )


_PLACED = f"{_ROWS}, bytes binary"


def _looked_into(joined: DataFrame, length: int) -> DataFrame:
    """The firsts in ``joined`` with their bytes, by the digest of their trigger bytes.

    Where more than ``MANY`` occurrences share the trigger bytes, a row for
    each start position goes by the digest of its own string instead: such rows
    are reduced like phrases, so none of these groups can grow with the corpus
    either.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            keys, docs, parts, places, texts = [], [], [], [], []
            held: list[list[np.ndarray]] = []
            for doc, part, text, marks in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                if (doc, part) in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add((doc, part))
                data = text.as_py().encode()
                for key, place, many in {(m["key"], m["place"], m["many"]) for m in marks.as_py()}:
                    at, n = place >> 32, place & _COUNT
                    if many:
                        starts = np.arange(at, at + n)
                        held.append([*_digests([(data[at : at + n - 1 + length], n)], length), np.full(n, doc), np.full(n, part), starts << 32 | 1])
                    else:
                        keys.append(key), docs.append(doc), parts.append(part), places.append(place), texts.append(data[at : at + n - 1 + length])
            zeros = np.zeros(len(keys), np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array(zeros), *(pa.array(x, pa.int64()) for x in (docs, parts, places)), pa.array(zeros.astype(np.int32)), pa.array(texts, pa.binary())],
                [*_COLUMNS, "kind", "bytes"],
            )
            if held:
                for rows in _rows(*(np.concatenate(x) for x in zip(*held))):
                    yield rows.append_column("bytes", pa.nulls(rows.num_rows, pa.binary()))

    return small_batches(joined).mapInArrow(run, _PLACED)


def _digests(texts: list[tuple[bytes, int]], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Two digests of the string at each of the first n positions of each text."""
    digest = [xxhash.xxh3_128_digest(t[i : i + length]) for t, n in texts for i in range(n)]
    both = np.frombuffer(b"".join(digest), ">i8").reshape(-1, 2)
    return both[:, 0].astype(np.int64), both[:, 1].astype(np.int64)


def alike(text: np.ndarray, length: int) -> np.ndarray:
    """For each position the rank of its ``length``-byte string among all of the text's, equal for equal strings.

    The text's suffix array to that depth: positions are sorted by their first
    eight bytes, and what is still alike by the ranks of both halves of a string
    of twice the length.  Strings that run past the end are filled with zeros.
    """
    n = len(text)
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    reach = min(8, length)
    key = np.ndarray(n, ">u8", padded, strides=(1,)).astype(U64) >> U64(8 * (8 - reach))
    order = np.argsort(key)
    ranked = key[order]
    new = np.r_[True, ranked[1:] != ranked[:-1]][:n]
    rank = np.zeros(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0)) + 1
    while reach < length:
        step = min(reach, length - reach)
        slots = np.flatnonzero(~(new & np.r_[new[1:], True]))
        if not len(slots):
            break
        place = order[slots]
        far = place + step
        pair = rank[place] * (n + 1) + np.where(far < n, rank[np.minimum(far, n - 1)], 0)
        by = np.argsort(pair, kind="stable")
        place, pair = place[by], pair[by]
        fresh = np.r_[True, pair[1:] != pair[:-1]]
        order[slots] = place
        new[slots] |= fresh
        rank[place] = slots[np.maximum.accumulate(np.where(fresh, np.arange(len(slots)), 0))] + 1
        reach += step
    return rank


def _suffixes(placed: DataFrame, length: int) -> DataFrame:
    """Start positions, among the firsts, whose string also starts earlier.

    Rows arrive by key; the dictionary's suffixes of whole keys are sorted
    together, a bounded number of keys at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = 0

        def finish(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            is_later = rows["kind"].to_numpy() == LATER
            later = rows.filter(pa.array(is_later))
            if later.num_rows:
                yield pa.RecordBatch.from_arrays([later[c].combine_chunks() for c in _COLUMNS[2:]], _COLUMNS[2:])
            rows = rows.filter(pa.array(~is_later))
            key, own, doc, part, place = (rows[c].to_numpy() for c in _COLUMNS)
            texts = rows["bytes"].to_pylist()
            whole = np.array([t is not None for t in texts], bool)
            # the dictionary: the phrases' bytes one after another, and where each string starts
            size = np.array([len(t) for t in texts if t is not None], np.int64)
            rank = alike(np.frombuffer(b"".join(t for t in texts if t is not None), np.uint8), length)
            n = place[whole] & _COUNT
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            ranks = rank[np.repeat(np.cumsum(size) - size, n) + step]
            strings = [np.repeat(key[whole], n), ranks, np.repeat(doc[whole], n), np.repeat(part[whole], n), (np.repeat(place[whole] >> 32, n) + step) << 32 | 1]
            for found in (strings, [x[~whole] for x in (key, own, doc, part, place)]):
                for batch in _rows(*found):
                    if batch.num_rows and batch.column("kind")[0].as_py() == LATER:
                        yield batch.select(_COLUMNS[2:])

        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            if count < KEYED:
                continue
            rows = pa.Table.from_batches(held)
            key = rows["key"].to_numpy()
            cut = int(np.searchsorted(key, key[-1], "left"))  # the last key may go on
            if cut:
                yield from finish(rows.slice(0, cut))
                held, count = rows.slice(cut).to_batches(), rows.num_rows - cut
        if held:
            yield from finish(pa.Table.from_batches(held))

    return small_batches(placed).mapInArrow(run, "doc long, part long, place long")


def spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, text and ``repeats``: packed runs of start positions that are repeats."""
    rows = docs.select(F.coalesce("doc_id", F.lit(_LAST)).alias("doc"), "doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("part", F.xxhash64("text"))
    found = _compared(_parse(rows, length))
    # sets, as every task that has a repeated row sends its marks
    marks = found.groupBy("doc", "part").agg(
        F.collect_set(F.when(F.col("repeat"), F.col("place"))).alias("repeats"),
        F.collect_set(F.when(~F.col("repeat"), F.struct("key", "place", "many"))).alias("firsts"),
    )
    # both uses read the same columns, so that the texts are shuffled once
    joined = rows.join(marks, ["doc", "part"], "left")
    placed = _looked_into(joined.where(F.size("firsts") > 0).select("doc", "part", "text", "firsts", "doc_id"), length)
    more = _suffixes(placed.repartition("key").sortWithinPartitions("key"), length).groupBy("doc", "part").agg(F.collect_set("place").alias("more"))
    none = F.array().cast("array<bigint>")
    return joined.join(more, ["doc", "part"], "left").select("doc_id", "text", F.concat(F.coalesce("repeats", none), F.coalesce("more", none)).alias("repeats"))


def report(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Bytes removed from each document, and the digest of what is left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, runs, kept = [], [], [], []
            for text, marks in zip(batch.column(1), batch.column(2)):
                data = text.as_py().encode()
                gone = np.zeros(len(data), bool)
                place = np.array(marks.as_py(), np.int64)
                if len(place):
                    step = np.zeros(len(data) + 1, np.int64)
                    np.add.at(step, place >> 32, 1)
                    np.add.at(step, np.minimum((place >> 32) + (place & _COUNT) - 1 + length, len(data)), -1)
                    gone = np.cumsum(step[:-1]) > 0
                left = np.frombuffer(data, np.uint8)[~gone]
                sizes.append(len(data))
                removed.append(len(data) - len(left))
                runs.append(int(np.count_nonzero(gone[1:] & ~gone[:-1]) + (len(gone) > 0 and gone[0])))
                kept.append(hashlib.sha256(left.tobytes()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return small_batches(spans(docs, length)).mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
