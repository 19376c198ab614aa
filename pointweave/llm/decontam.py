"""Benchmark decontamination with training suffix arrays (operator 7).

Every task cuts its documents into shards and builds a word-level suffix array
of each: the places of the shard's words in the order of the words that follow,
by prefix doubling.  Each benchmark suffix that starts a window (``window``
words, or the whole of a shorter item) is binary-searched in it: the bounds of
the places that begin alike are narrowed word by word, so that no pair of a
suffix and a place is made, however often both repeat.  A place belongs to one
window of a length at most, and every window found is confirmed on the words'
bytes.  From each confirmed place, the longest verbatim match with any benchmark
suffix follows from the suffix array of the benchmark, searched the same way;
``longest``, ``longest_at`` and ``longest_item`` tell its length and places.
Matches that hold no whole window are not reported.

The benchmark travels to the tasks in blocks of at most ``block_bytes`` of
text.  The driver holds one block at a time and what is broadcast has a fixed
bound however large the benchmark grows: with several blocks, documents pass
the blocks one after another, written to the shared folder in between; what a
block has read is deleted, so two copies stand there at most.

Defined results: a null or wordless text has no words and is clean; null or
wordless items have no window; equal items all count; an item without an id
marks words and names no item; rows are independent, so ties, repeated rows,
null ids and further columns change nothing; an empty table of documents gives
an empty table, an empty benchmark leaves all clean.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointweave.llm.common import LOWER, byte_table, durable, flat_bytes, lowered, pieces, release, small_batches, word_hashes

WINDOW = 10
BLOCK_BYTES = 16 << 20
#: Text bytes of a shard (a longer text is a shard of its own).
SHARD_BYTES = 2 << 20

#: 0-9, A-Z (lower-cased), a-z and every byte of a non-ASCII character.
_WORD = byte_table([*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)])
_WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

_HITS = "doc_id long, n_words long, spans array<struct<start:long,end:long>>, items array<string>, longest long, longest_at long, longest_item string"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_NONE = np.zeros(0, np.int64)


class SuffixArray:
    """Places of words, ordered by up to ``depth`` words that follow inside their text.

    h[i] is the hash of word i, stop[i] where its text ends.
    """

    def __init__(self, h: np.ndarray, stop: np.ndarray, depth: int) -> None:
        n = len(h)
        self.vocabulary, ids = np.unique(h, return_inverse=True)
        self.ids, self.stop = ids + 1, stop  # 0 stands past the end of a text
        self.bits = max(1, len(self.vocabulary).bit_length())
        self.wide = max(1, min(8, 63 // self.bits))
        key = self._packed(self.ids, np.arange(n), stop)
        order = np.argsort(key)
        self.keys, self.order = key[order], order
        new = np.r_[True, self.keys[1:] != self.keys[:-1]][:n]
        rank = np.zeros(n, np.int64)
        rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0)) + 1
        reach = self.wide
        while reach < depth:  # only places that still begin alike are ordered further
            slots = np.flatnonzero(~(new & np.r_[new[1:], True]))
            if not len(slots):
                break
            place = order[slots]
            far = place + reach
            pair = rank[place] * (n + 1) + np.where(far < stop[place], rank[np.minimum(far, n - 1)], 0)
            by = np.argsort(pair, kind="stable")
            place, pair = place[by], pair[by]
            fresh = np.r_[True, pair[1:] != pair[:-1]]
            order[slots] = place
            new[slots] |= fresh
            rank[place] = slots[np.maximum.accumulate(np.where(fresh, np.arange(len(slots)), 0))] + 1
            reach *= 2

    def _packed(self, ids: np.ndarray, first: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """The first ``wide`` words of each suffix in one integer."""
        key = np.zeros(len(first), np.int64)
        for j in range(self.wide):
            key = key << self.bits | (np.where(first + j < stop, ids[np.minimum(first + j, len(ids) - 1)], 0) if len(ids) else 0)
        return key

    def own(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """This array's ids of other words (0: it lacks the word), and where each run of known words ends."""
        if not len(self.vocabulary) or not len(h):
            return np.zeros(len(h), np.int64), np.arange(len(h))
        at = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
        ids = np.where(self.vocabulary[at] == h, at + 1, 0)
        gaps = np.r_[np.flatnonzero(ids == 0), len(h)]
        return ids, gaps[np.searchsorted(gaps, np.arange(len(h)))]

    def _bound(self, left: np.ndarray, right: np.ndarray, word: np.ndarray, depth: int, upper: bool) -> np.ndarray:
        """Binary search, for all bounds at once, by the word at ``depth``."""
        lo, hi = left.copy(), right.copy()
        going = np.flatnonzero(lo < hi)
        while len(going):
            mid = (lo[going] + hi[going]) >> 1
            start = self.order[mid]
            own = np.where(start + depth < self.stop[start], self.ids[np.minimum(start + depth, len(self.ids) - 1)], 0)
            right_of = own <= word[going] if upper else own < word[going]
            lo[going[right_of]] = mid[right_of] + 1
            hi[going[~right_of]] = mid[~right_of]
            going = going[lo[going] < hi[going]]
        return lo

    def _narrowed(self, left: np.ndarray, right: np.ndarray, word: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """The part of each interval with this word at ``depth``; equal questions are asked once."""
        _, once, back = np.unique(left * (len(self.vocabulary) + 1) + word, return_index=True, return_inverse=True)
        left, right, word = left[once], right[once], word[once]
        return self._bound(left, right, word, depth, False)[back], self._bound(left, right, word, depth, True)[back]

    def intervals(self, h: np.ndarray, first: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which of the strings h[first : first + length] stand here, and from where to where in ``order``."""
        ids, until = self.own(h)
        which = np.flatnonzero(until[first] >= first + length) if len(first) else _NONE
        first, length = first[which], length[which]
        key = self._packed(ids, first, first + length)
        free = self.bits * (self.wide - np.minimum(length, self.wide))
        left = np.searchsorted(self.keys, key, "left")
        right = np.searchsorted(self.keys, key | (np.int64(1) << free) - 1, "right")
        for depth in range(self.wide, int(length.max(initial=0))):
            going = np.flatnonzero((length > depth) & (left < right))
            left[going], right[going] = self._narrowed(left[going], right[going], ids[first[going] + depth], depth)
        found = left < right
        return which[found], left[found], right[found]

    def longest(self, h: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Length of the longest string at h[first] (before end) that stands here, and a place of it."""
        ids, until = self.own(h)
        end = np.minimum(end, until[first])
        key = self._packed(ids, first, end)
        left, right = np.searchsorted(self.keys, key, "left"), np.searchsorted(self.keys, key, "right")
        length, place = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
        for near in (left - 1, left):  # the neighbours share the most words
            near = np.clip(near, 0, len(self.keys) - 1)
            alike = sum((key >> self.bits * k == self.keys[near] >> self.bits * k).astype(np.int64) for k in range(self.wide))
            alike = np.minimum(alike, end - first)
            more = alike > length
            length[more], place[more] = alike[more], self.order[near[more]]
        going = np.flatnonzero((left < right) & (end - first >= self.wide))
        depth = self.wide
        while len(going):
            place[going], length[going] = self.order[left[going]], depth
            going = going[first[going] + depth < end[going]]
            left[going], right[going] = self._narrowed(left[going], right[going], ids[first[going] + depth], depth)
            going = going[left[going] < right[going]]
            depth += 1
        return length, place


class Benchmark:
    """One block of items: their words, and the suffixes that start a window."""

    def __init__(self, items: list[tuple[str | None, str]], window: int) -> None:
        self.names, self.window = [i for i, _ in items], window
        self.texts = [t.encode() for _, t in items]
        offsets = np.cumsum([0, *map(len, self.texts)])
        _, _, self.words, self.at = word_hashes(np.frombuffer(b"".join(self.texts), np.uint8), _WORD, LOWER, offsets)
        size = np.diff(self.at)
        starts = np.where(size > 0, size - np.minimum(size, window) + 1, 0)
        self.owner = np.repeat(np.arange(len(items)), starts)
        self.first = self.at[self.owner] + np.arange(len(self.owner)) - np.repeat(np.cumsum(starts) - starts, starts)
        self.length = np.minimum(size, window)[self.owner]
        self._order: SuffixArray | None = None
        self._split: dict[int, list[bytes]] = {}

    def order(self) -> SuffixArray:
        if self._order is None:
            size = np.diff(self.at)
            self._order = SuffixArray(self.words, np.repeat(self.at[1:], size), int(size.max(initial=1)))
        return self._order

    def window_bytes(self, suffix: int) -> bytes:
        item = int(self.owner[suffix])
        if item not in self._split:
            self._split[item] = _WORDS.findall(lowered(self.texts[item]))
        start = int(self.first[suffix] - self.at[item])
        return b" ".join(self._split[item][start : start + int(self.length[suffix])])


class Found:
    """Confirmed windows in the texts of one shard."""

    def __init__(self, texts: pa.Array, lo: int, hi: int, benchmark: Benchmark) -> None:
        data, offsets = flat_bytes(texts, lo, hi)
        _, _, self.h, self.at = word_hashes(data, _WORD, LOWER, offsets)
        self.benchmark = benchmark
        stop = np.repeat(self.at[1:], np.diff(self.at))
        array = SuffixArray(self.h, stop, benchmark.window)
        which, left, right = array.intervals(benchmark.words, benchmark.first, benchmark.length)
        #: text, place and length of each window, and the items it is of
        self.hits: list[tuple[int, int, int, frozenset[int]]] = []
        if not len(which):
            return
        order = np.lexsort((left, benchmark.length[which]))
        cut = np.flatnonzero(np.diff(left[order]) | np.diff(benchmark.length[which][order])) + 1
        split: dict[int, list[bytes]] = {}
        for group in np.split(order, cut):  # equal windows share their places
            owners: dict[bytes, set[int]] = {}
            for s in which[group].tolist():
                owners.setdefault(benchmark.window_bytes(s), set()).add(int(benchmark.owner[s]))
            items = {w: frozenset(o) for w, o in owners.items()}
            length = int(benchmark.length[which[group[0]]])
            place = array.order[left[group[0]] : right[group[0]]]
            for p, d in zip(place.tolist(), (np.searchsorted(self.at, place, "right") - 1).tolist()):
                if d not in split:
                    split[d] = _WORDS.findall(lowered(data[offsets[d] : offsets[d + 1]].tobytes()))
                start = p - int(self.at[d])
                own = items.get(b" ".join(split[d][start : start + length]))
                if own is not None:
                    self.hits.append((d, p, length, own))

    def _longest(self, places: dict[int, list[int]]) -> Iterator[tuple[int, int, int, str | None]]:
        """Of each text with hits: its number, the longest match's negative length, its first place, and its item."""
        if not places:
            return
        texts = list(places)
        words = np.concatenate([self.h[self.at[d] : self.at[d + 1]] for d in texts])
        size = np.array([self.at[d + 1] - self.at[d] for d in texts])
        begin = np.cumsum(size) - size
        hits = np.array([len(places[d]) for d in texts])
        text = np.repeat(np.arange(len(texts)), hits)
        inner = np.concatenate([np.array(places[d]) - self.at[d] for d in texts])
        length, place = self.benchmark.order().longest(words, begin[text] + inner, (begin + size)[text])
        order = np.lexsort((inner, -length, text))
        for chosen in order[np.cumsum(hits) - hits].tolist():
            item = int(np.searchsorted(self.benchmark.at, place[chosen], "right")) - 1
            yield texts[text[chosen]], -int(length[chosen]), int(inner[chosen]), self.benchmark.names[item]

    def rows(self, batch: pa.RecordBatch, lo: int, hi: int, last: bool) -> pa.RecordBatch:
        """The batch's rows [lo, hi) with what this block adds to earlier blocks' findings."""
        n = hi - lo
        spans: list[list] = [[] for _ in range(n)]
        items: list[set] = [set() for _ in range(n)]
        best: list[tuple] = [(0, 0, None)] * n
        if "spans" in batch.schema.names:
            for i, (s, names, *longest) in enumerate(zip(*(batch.column(c).slice(lo, n).to_pylist() for c in ("spans", "items", "longest", "longest_at", "longest_item")))):
                spans[i], items[i], best[i] = s, set(names), (-longest[0], longest[1], longest[2]) if longest[0] else best[i]
        marked: dict[int, list[tuple[int, int]]] = {}
        for d, p, length, own in self.hits:
            marked.setdefault(d, []).append((p, length))
            items[d] |= {self.benchmark.names[k] for k in own} - {None}
        for d, found in marked.items():
            found.sort()
            for p, length in found:
                start, end = p - int(self.at[d]), p - int(self.at[d]) + length
                if spans[d] and spans[d][-1]["start"] <= start <= spans[d][-1]["end"]:
                    spans[d][-1]["end"] = max(end, spans[d][-1]["end"])
                else:
                    spans[d].append({"start": start, "end": end})
        for d, *longest in self._longest({d: sorted({p for p, _ in found}) for d, found in marked.items()}):
            best[d] = min(best[d], tuple(longest), key=lambda b: b[:2])
        columns = {
            "n_words": pa.array(np.diff(self.at), pa.int64()),
            "spans": pa.array(spans, _SPANS),
            "items": pa.array([sorted(i) for i in items], pa.list_(pa.string())),
            "longest": pa.array([-b[0] for b in best], pa.int64()),
            "longest_at": pa.array([b[1] if b[0] else None for b in best], pa.int64()),
            "longest_item": pa.array([b[2] for b in best], pa.string()),
        }
        kept = ("doc_id",) if last else ("doc_id", "text")
        return pa.RecordBatch.from_arrays([*(batch.column(c).slice(lo, n) for c in kept), *columns.values()], [*kept, *columns])


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[tuple[list[tuple[str | None, str]], bool]]:
    """Items in blocks of bounded size, and whether a block is the last; the driver holds two at a time."""
    block, held, ready = [], 0, None
    rows = benchmark.select(F.col("item_id").cast("string"), F.col("text")).where("text is not null")
    for item, text in rows.toLocalIterator():
        if block and held + len(text) > block_bytes // 4:
            if ready is not None:
                yield ready, False
            ready, block, held = block, [], 0
        block.append((item, text))
        held += len(text)
    if ready is not None:
        yield ready, not block
    if block or ready is None:
        yield block, True


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: its words, hit spans (in words), items found and the longest match."""
    out = docs.select("doc_id", "text")
    for block, last in _blocks(benchmark, block_bytes):
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent, last=last) -> Iterator[pa.RecordBatch]:
            known = Benchmark(sent.value, window)
            for batch in batches:
                for lo, hi in pieces(batch.column("text"), SHARD_BYTES):
                    yield Found(batch.column("text"), lo, hi, known).rows(batch, lo, hi, last)

        before, out = out, small_batches(out).mapInArrow(run, _HITS if last else _HITS.replace("doc_id long", "doc_id long, text string"))
        if not last:
            out = durable(out, "matches")
            release(before)
            sent.destroy()
    return out


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Digest columns of every document (see the module's notes)."""
    x = matches(docs, benchmark, window, block_bytes)
    merged = F.expr("aggregate(array_sort(spans), named_struct('n', 0L, 'to', 0L), (a, s) -> named_struct('n', a.n + greatest(0L, s.end - greatest(s.start, a.to)), 'to', greatest(a.to, s.end)), a -> a.n)")
    return x.select(
        "doc_id",
        "n_words",
        merged.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
        "longest",
        "longest_at",
        "longest_item",
    )


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Documents without any benchmark window, with their own columns only."""
    out = docs
    for block, last in _blocks(benchmark, block_bytes):
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            known = Benchmark(sent.value, window)
            for batch in batches:
                for lo, hi in pieces(batch.column("text"), SHARD_BYTES):
                    dirty = np.zeros(hi - lo, bool)
                    dirty[[d for d, *_ in Found(batch.column("text"), lo, hi, known).hits]] = True
                    yield batch.slice(lo, hi - lo).filter(pa.array(~dirty))

        before, out = out, small_batches(out).mapInArrow(run, docs.schema)
        if not last:
            out = durable(out, "clean")
            release(before)
            sent.destroy()
    return out
