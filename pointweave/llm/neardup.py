"""Near-duplicate groups with HyperMinHash (operator 6).

Every distinct shingle set is a node.  A node's sketch has ``REGISTERS``
buckets; a bucket holds, for its least hash, the leading-zero count and
``MANTISSA`` further bits (16 bits in all).  Empty buckets borrow from filled
ones by a fixed probe sequence.  Bands of registers propose candidates, the
collision-corrected Jaccard estimate discards the hopeless ones, and the full
shingle sets decide: first as hashes, and a link at last as the words' bytes.

Pairs inside a band's bucket are not enumerated.  First each member is
compared with one centre of its bucket and the verified links form components.
Two members of one component need no further link.  Members of buckets that
still hold several components are looked at again through their rarest
shingles: in the order of (occurs in one component only, frequency, hash), one of
the first n - ceil(2 t n / (1 + t)) + 1 shingles of the smaller of two linked sets
is among the first n - ceil(t n) + 1 of the other.  A member whose own edits make
up that many needs no comparison, and shingles that are not among the first of any
smaller set bring no one together.  The others meet in blocks of bounded text,
where each member outside the largest component is compared with the members of
other components through an inverted index.  No link between different texts is lost that could join
components.

Equal sets are grouped before anything else, so copies are one node; they are known
by a 128-bit digest of their shingles, which are 128 bits each themselves (words of seven
bytes or fewer whole, longer ones by BLAKE2b).  What a group finds out goes back to its rows,
however many they are, by ``looked_up``.

Defined results: words are runs of non-space bytes after A-Z are lower-cased;
a text with fewer words than a shingle has them all as its one shingle; a null
or wordless text has the empty set and is linked with nothing.  Rows of equal
sets are one node, whatever their ids, so repeated rows and ties share a
component; its id is the least doc_id of its rows (nulls aside), and a row is
kept if it has that id.  A row with a null id in a group of such rows only has
a null component and is kept.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pointweave.llm.common import LOWER, byte_table, durable, flat_bytes, lowered, mix64, pieces, release, small_batches, word_lanes
from pointweave.operators.graph import connected_components
from pointweave.operators.tables import looked_up

REGISTERS, MANTISSA = 256, 10
#: Chance that registers of different minima agree (HyperMinHash paper).
COLLISION = 0.169919 * 2.0**-MANTISSA
#: Standard errors of slack that the estimate is given before the sets decide.
SLACK = 6.0
#: Shingles of the members that a block holds (a larger set is a block's only one of its half).
BLOCK = 400_000
HELD_BYTES = 1 << 19

U64 = np.uint64
_WORD = byte_table(set(range(256)) - {32, *range(9, 14)})
_WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
_FIRST, _OTHER = U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F)
_PROBES = (mix64(np.arange(REGISTERS * 64, dtype=U64) + U64(77)) % U64(REGISTERS)).astype(np.int64).reshape(64, REGISTERS)
#: Where the probes find none, the filled register of least rank lends: sets that share most registers agree on it as often.
_RANKS = mix64(np.arange(REGISTERS * REGISTERS, dtype=U64) + U64(REGISTERS * 64 + 77)).reshape(REGISTERS, REGISTERS)


def rows_per_band(threshold: float) -> int:
    """Rows with which 256 registers miss a pair at the threshold about once in 10^8."""
    rows = 1
    while (1 - threshold ** (rows + 1)) ** (REGISTERS // (rows + 1)) < 1e-8:
        rows += 1
    return rows


def shingle_lanes(data: np.ndarray, offsets: np.ndarray, width: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sorted distinct shingles of each of the concatenated texts, 128 bits in two lanes."""
    _, _, (a, b), at = word_lanes(data, _WORD, LOWER, offsets)
    one, two = a.copy(), b.copy()
    for i in range(1, min(width, len(a))):
        n = len(a) - i
        one[:n] = mix64(one[:n] * _FIRST + a[i:])
        two[:n] = mix64((two[:n] ^ one[:n]) * _OTHER + b[i:])
    one, two = mix64(one), mix64(two)
    out = []
    for lo, hi in zip(at[:-1].tolist(), at[1:].tolist()):
        if hi - lo >= width:
            x, y = one[lo : hi - width + 1], two[lo : hi - width + 1]
            order = np.argsort(x)
            x, y = x[order], y[order]
            again = x[1:] == x[:-1]
            if np.any(again & (y[1:] != y[:-1])):  # two shingles that share a lane
                order = np.lexsort((y, x))
                x, y = x[order], y[order]
                again = x[1:] == x[:-1]
            fresh = np.r_[True, ~(again & (y[1:] == y[:-1]))]
            out.append((x[fresh], y[fresh]))
        elif hi > lo:
            whole = hashlib.blake2b(np.stack([a[lo:hi], b[lo:hi]]).tobytes(), digest_size=16).digest()
            out.append(tuple(np.frombuffer(whole, U64).reshape(2, 1)))
        else:
            out.append((np.zeros(0, U64), np.zeros(0, U64)))
    return out


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """The first lane of :func:`shingle_lanes`: what searches for links goes by; it never decides on one."""
    return [x for x, _ in shingle_lanes(data, offsets, width)]


def sketch(hashes: np.ndarray) -> np.ndarray:
    """Registers of a sorted set: bucket by the top 8 bits, least hash in each."""
    bucket = (hashes >> U64(56)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    low = hashes[first] & U64((1 << 56) - 1)
    bits = np.frexp(low.astype(np.float64))[1]
    shift = bits - 1 - MANTISSA
    mantissa = np.where(shift >= 0, low >> np.maximum(shift, 0).astype(U64), low << np.maximum(-shift, 0).astype(U64)) & U64((1 << MANTISSA) - 1)
    out = np.zeros(REGISTERS, np.uint16)
    filled = np.zeros(REGISTERS, bool)
    out[bucket[first]] = (np.maximum(56 - bits, 0).astype(np.uint16) << np.uint16(MANTISSA)) | mantissa.astype(np.uint16)
    filled[bucket[first]] = True
    empty = np.flatnonzero(~filled)
    source = filled.copy()
    for probe in _PROBES:
        if not len(empty):
            return out
        to = probe[empty]
        good = source[to]
        out[empty[good]] = out[to[good]]
        empty = empty[~good]
    have = np.flatnonzero(source)
    out[empty] = out[have[_RANKS[np.ix_(empty, have)].argmin(axis=1)]]
    return out


def estimate(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard estimate of two sketches, corrected for chance agreement."""
    return max(0.0, (np.count_nonzero(a == b) / len(a) - COLLISION) / (1 - COLLISION))


def jaccard_parts(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    both = np.concatenate([a, b])
    both.sort()
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return common, len(both) - common


def confirmed(a: bytes, b: bytes, width: int, percent: int) -> bool:
    """Whether two texts are linked, by the bytes of their words."""
    sets = []
    for text in (a, b):
        words = _WORDS.findall(lowered(text))
        sets.append({b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))})
    common = len(sets[0] & sets[1])
    return 100 * common >= percent * (len(sets[0]) + len(sets[1]) - common)


_SIGNATURES = "doc_id long, mark binary, digest binary, n long, regs binary, packed binary"


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, mark (md5 of the text), digest of the set, its size, registers and the packed text of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            texts = batch.column(2)
            for lo, hi in pieces(texts, HELD_BYTES):
                data, offsets = flat_bytes(texts, lo, hi)
                lanes = shingle_lanes(data, offsets, width)
                digests = [hashlib.blake2b(np.stack(pair).tobytes(), digest_size=16).digest() for pair in lanes]
                sets = [x for x, _ in lanes]
                regs = [sketch(s).tobytes() if len(s) else None for s in sets]
                packed = [pack.compress(data[a:b].tobytes()) if len(s) else None for s, a, b in zip(sets, offsets[:-1].tolist(), offsets[1:].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).slice(lo, hi - lo) for i in (0, 1)), pa.array(digests, pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array(regs, pa.binary()), pa.array(packed, pa.binary())],
                    ["doc_id", "mark", "digest", "n", "regs", "packed"],
                )

    return small_batches(docs.select("doc_id", F.unhex(F.md5("text")).alias("mark"), "text")).mapInArrow(run, _SIGNATURES)


def _hashed(texts: list[bytes], width: int) -> list[np.ndarray]:
    return shingle_sets(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]), width)


def _links(links: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], ["src", "dst"])


def _verify(pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """Rows (a, b, n_a, n_b, regs_a, regs_b, packed_a, packed_b) whose sets are linked."""
    t = percent / 100

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[int, tuple[bytes, np.ndarray]] = {}

        def member(node: int, packed: pa.Scalar) -> tuple[bytes, np.ndarray]:
            if node not in memo:
                if len(memo) >= 64:
                    memo.clear()
                text = zstandard.decompress(packed.as_py())
                memo[node] = text, _hashed([text], width)[0]
            return memo[node]

        for batch in batches:
            c = {name: batch.column(name) for name in batch.schema.names}
            a, b = c["a"].to_pylist(), c["b"].to_pylist()
            na, nb = c["n_a"].to_pylist(), c["n_b"].to_pylist()
            links = []
            for i in range(len(a)):
                slack = SLACK * math.sqrt(t * (1 - t) / min(REGISTERS, na[i], nb[i]))
                if estimate(np.frombuffer(c["regs_a"][i].as_py(), np.uint16), np.frombuffer(c["regs_b"][i].as_py(), np.uint16)) < t - slack:
                    continue
                one, two = member(a[i], c["packed_a"][i]), member(b[i], c["packed_b"][i])
                common, union = jaccard_parts(one[1], two[1])
                if 100 * common >= percent * union and confirmed(one[0], two[0], width, percent):
                    links.append((a[i], b[i]))
            yield _links(links)

    return pairs.mapInArrow(run, "src long, dst long")


def _block_links(nodes: np.ndarray, labels: np.ndarray, texts: list[bytes], width: int, percent: int) -> list[tuple[int, int]]:
    """Links between members of different components, one per member and component."""
    names, own, sizes = np.unique(labels, return_inverse=True, return_counts=True)
    if len(names) < 2:
        return []
    sets = _hashed(texts, width)
    n = np.array([len(s) for s in sets])
    vocabulary, ids = np.unique(np.concatenate(sets), return_inverse=True)
    member = np.repeat(np.arange(len(sets)), n)
    order = np.argsort(ids, kind="stable")
    posting = member[order]
    starts = np.searchsorted(ids[order], np.arange(len(vocabulary) + 1))
    bounds = np.r_[0, np.cumsum(n)]
    out = []
    for x in np.flatnonzero(own != sizes.argmax()).tolist():
        terms = ids[bounds[x] : bounds[x + 1]]
        terms = terms[starts[terms + 1] - starts[terms] > 1]
        if not len(terms):
            continue
        common = np.bincount(np.concatenate([posting[starts[t] : starts[t + 1]] for t in terms.tolist()]), minlength=len(sets))
        linked = np.flatnonzero((100 * common >= percent * (n + n[x] - common)) & (own != own[x]))
        met: set[int] = set()
        for y in linked.tolist():
            if own[y] not in met and confirmed(texts[x], texts[y], width, percent):
                met.add(own[y])
                out.append((int(nodes[x]), int(nodes[y])))
    return out


def _resolve(members: DataFrame, width: int, percent: int) -> DataFrame:
    """Links across components inside blocks; rows (gram, i, j, node, label, packed) are sorted by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = None, []

        def finish() -> pa.RecordBatch:
            texts = [zstandard.decompress(r[2]) for r in held]
            return _links(_block_links(np.array([r[0] for r in held]), np.array([r[1] for r in held]), texts, width, percent))

        for batch in batches:
            c = [batch.column(i).to_pylist() for i in range(6)]
            for key, i, j, node, label, packed in zip(*c):
                if (key, i, j) != block:
                    if held:
                        yield finish()
                    block, held = (key, i, j), []
                held.append((node, label, packed))
        if held:
            yield finish()

    return small_batches(members).mapInArrow(run, "src long, dst long")


def _grams(members: DataFrame, width: int) -> DataFrame:
    """A row for each shingle of (node, label, n, packed)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                part = batch.slice(lo, 200)
                sets = _hashed([zstandard.decompress(p) for p in part.column(3).to_pylist()], width)
                size = [len(s) for s in sets]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64)), *(pa.array(np.repeat(part.column(i).to_numpy(), size)) for i in range(3))], ["gram", "node", "label", "n"])

    return small_batches(members.select("node", "label", "n", "packed")).mapInArrow(run, "gram long, node long, label long, n long")


def _rare(grams: DataFrame, percent: int) -> DataFrame:
    """Of each node the shingles by which a linked node of another component must be met."""
    seen = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("rows"), F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("gram", "rows", F.col("rows").alias("freq"))
    shared = looked_up(grams, seen, "gram", "rows", grams.count()).where("freq IS NOT NULL")
    own = Window.partitionBy("node")
    nth = F.row_number().over(own.orderBy("freq", "gram"))
    alone = F.col("n") - F.count(F.lit(1)).over(own)
    length = F.expr(f"n - (({percent} * n + 99) div 100) + 1")
    least = F.expr(f"n - ((2 * {percent} * n + {percent + 99}) div {percent + 100}) + 1")
    return shared.select("gram", "node", "label", "n", (nth + alone <= length).alias("first"), (nth + alone <= least).alias("core")).where("first").drop("first")


def _meetings(rare: DataFrame) -> DataFrame:
    """gram, blocks of the shingles at which several components meet; of those with equal members one."""
    met = rare.groupBy("gram").agg(
        F.count(F.lit(1)).alias("members"),
        F.min("label").alias("low"),
        F.max("label").alias("high"),
        F.sum("n").alias("shingles"),
        F.bool_or("core").alias("core"),
        *(F.bit_xor(F.xxhash64(F.lit(k), F.col("node"))).alias(f"who_{k}") for k in (1, 2)),
    )
    same = met.where("core and low <> high").groupBy("members", "who_1", "who_2").agg(F.min("gram").alias("gram"), F.first("shingles").alias("shingles"))
    return same.select("gram", F.ceil(F.col("shingles") / BLOCK).cast("int").alias("blocks"))


def components(docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The rows' signatures, and (digest, rows, first) of each set with words: how many rows
    have it, and the first row (doc_id, mark) of its component."""
    threshold = percent / 100
    rows = rows_per_band(threshold)
    bands = REGISTERS // rows
    least = math.ceil(threshold / (1 - threshold) - 1e-9) if percent < 100 else 1
    signed = durable(signatures(docs, width), "signatures")
    every = durable(signed.select("doc_id", "mark", "digest", "n"), "rows")
    # sets too small to be linked with another than themselves need no candidates
    nodes = durable(signed.where(F.col("n") >= least).select("digest", "n", "regs", "packed").dropDuplicates(["digest"]).withColumn("node", F.monotonically_increasing_id()), "nodes")
    release(signed)
    # odd bands order nodes downwards, so that their centres differ
    banded = nodes.select(
        "node",
        F.posexplode(F.array(*(F.xxhash64(F.substring("regs", 1 + 2 * rows * i, 2 * rows), F.lit(i)) for i in range(bands)))).alias("band", "key"),
    ).select("key", F.when(F.col("band") % 2 == 0, F.col("node")).otherwise(F.bitwise_not("node")).alias("placed"), (F.col("band") % 2 == 1).alias("odd"))
    centres = banded.groupBy("key").agg(F.min("placed").alias("centre"), F.max("placed").alias("other"), F.count(F.lit(1)).alias("members")).where("centre <> other").select("key", "centre", "members")
    met = looked_up(banded, centres, "key", "members", nodes.count() * bands).where("centre IS NOT NULL")
    turned = lambda c: F.when(F.col("odd"), F.bitwise_not(c)).otherwise(F.col(c))
    cells = durable(met.select("key", turned("placed").alias("node"), turned("centre").alias("centre")).distinct(), "cells")
    # what follows concerns members of shared buckets only
    whole, nodes = nodes, durable(nodes.join(cells.select("node").distinct(), "node", "left_semi"), "nodes")
    release(whole)
    pairs = cells.where("node <> centre").select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct()
    side = lambda s: nodes.select(F.col("node").alias(s), F.col("n").alias(f"n_{s}"), F.col("regs").alias(f"regs_{s}"), F.col("packed").alias(f"packed_{s}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b").where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    links = durable(_verify(joined, width, percent), "links")
    labels = durable(connected_components(links), "labels")
    # members of buckets that still hold several components
    named = cells.select("key", "node").join(labels, "node", "left").select("key", "node", F.coalesce("component", "node").alias("label"))
    open_keys = named.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("members")).where("low <> high and members > 2").select("key")
    members = named.join(open_keys, "key", "left_semi").select("node", "label").distinct().join(nodes.select("node", "n", "packed"), "node")
    grams = durable(_grams(members, width), "grams")
    rare = durable(_rare(grams, percent), "rare")
    release(cells, grams)
    placed = (
        rare.join(_meetings(rare), "gram")
        .withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        .select("gram", "node", "label", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("with"))
        .join(nodes.select("node", "packed"), "node")
        .select("gram", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), "node", "label", "packed")
        .repartition("gram", "i", "j")
        .sortWithinPartitions("gram", "i", "j")
    )
    more = durable(_resolve(placed, width, percent), "links")
    release(rare, links)
    if not more.isEmpty():
        edges = more.unionAll(labels.select(F.col("node").alias("src"), F.col("component").alias("dst")))
        labels = durable(connected_components(edges), "labels")
    first = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "mark")
    sets = every.where("n > 0").groupBy("digest").agg(F.min(first).alias("first"), F.count(F.lit(1)).alias("rows"))
    linked = durable(labels.join(nodes.select("node", "digest"), "node").join(sets.select("digest", "first"), "digest").select("digest", "component", "first"), "linked")
    release(nodes, labels, more)
    lowest = linked.groupBy("component").agg(F.min("first").alias("low"), F.count(F.lit(1)).alias("members"))
    of_set = looked_up(linked.select("digest", "component"), lowest, "component", "members", linked.count()).select("digest", "low")
    return every, sets.join(of_set, "digest", "left").select("digest", "rows", F.coalesce("low", "first").alias("first"))


def report(docs: DataFrame, width: int = 3, percent: int = 85) -> DataFrame:
    """n_shingles, component_id and kept of every row."""
    every, found = components(docs, width, percent)
    own = every.select("doc_id", "digest", "n")
    placed = looked_up(own.where("n > 0"), found, "digest", "rows", every.count()).select("doc_id", "n", F.col("first.doc_id").alias("component_id"))
    wordless = own.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return placed.unionAll(wordless).select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def representatives(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without the rows of a group but one: the least by (doc_id, nulls last, md5 of the text).

    Of rows that are equal in both, one stays.  Rows without words all stay.
    """
    _, found = components(docs.select("doc_id", "text"), width, percent)
    kept = found.select(F.col("first.doc_id").alias("kept_id"), F.col("first.mark").alias("kept_mark")).distinct()
    worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    own = docs.where(worded).select(F.struct(*docs.columns).alias("own"), F.col("doc_id").alias("id"), F.unhex(F.md5("text")).alias("mark"))
    # equal rows meet as one row of each task, before the winners are looked up
    once = own.dropDuplicates(["id", "mark"])
    out = once.join(kept, F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("mark") == F.col("kept_mark")), "left_semi")
    return out.select(*(F.col("own")[c].alias(c) for c in docs.columns)).unionAll(docs.where(~worded))
