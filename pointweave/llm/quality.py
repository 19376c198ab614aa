"""Document quality by Bradley-Terry pairwise ranking (operator 5).

A document's merit is a weighted sum of text features.  A document labelled 1
is preferred to one labelled 0; the weights minimise the logistic loss of the
feature differences of such pairs.  The threshold is a quantile of the merits:
the share of label 0 among all training labels.  The score puts that threshold
at 0.3.

Fitting uses every labelled document and ``PARTNERS`` pairs for each.  Features
stay in a table, in chunks of ``CHUNK`` documents of a label; chunks of the two labels
meet, the rarer label's as often as needed, and a Newton step sums the slopes
and bends of the pairs of chunks.  The threshold is found in ever finer bins of the merits of
all chunks.  The driver holds sums, weights and bin counts only.

Defined results: a null text counts as empty and is scored like any text; an id
with both labels trains with each of them once, and of several rows of an id the
text of least md5 trains; null labels never train; with
labels of one kind only, every text scores 0.3 and is predicted 1; rows are
independent, further columns are not read, an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointweave.llm.common import LOWER, byte_table, durable, flat_bytes, held_out, pieces, release, small_batches, word_hashes
from pointweave.operators.tables import numbered

CHUNK, PARTNERS, RIDGE, THRESHOLD = 8_192, 8, 1e-3, 0.3
#: Bins of merits that a pass counts.
BINS = 4_096
HELD_BYTES = 1 << 19

_WORD = byte_table([*range(33, 127), *range(128, 256)])
_CLASSES = {
    "upper": range(65, 91),
    "lower": range(97, 123),
    "digit": range(48, 58),
    "space": b" ",
    "line": b"\n",
    "stop": b".,;:?",
    "shout": b"!",
    "bar": b"|",
    "symbol": b"#$%&*@^~_=<>{}[]\\/+",
    "other": range(128, 256),
}
_CLASS = np.full(256, len(_CLASSES), np.int64)
for _k, _bytes in enumerate(_CLASSES.values()):
    _CLASS[list(_bytes)] = _k

FEATURES = (*_CLASSES, "log_bytes", "log_words", "word_length", "new_words", "commonest", "new_pairs", "new_runs", "short")


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of ``FEATURES`` for each of the concatenated texts."""
    docs = len(offsets) - 1
    size = np.diff(offsets)
    out = np.zeros((docs, len(FEATURES)))
    owner = np.repeat(np.arange(docs), size)
    width = len(_CLASSES) + 1
    counts = np.bincount(owner * width + _CLASS[data], minlength=docs * width).reshape(docs, width)
    k = len(_CLASSES)
    out[:, :k] = counts[:, :k] / np.maximum(size, 1)[:, None]
    starts, ends, h, at = word_hashes(data, _WORD, LOWER, offsets)
    words = np.diff(at)
    out[:, k] = np.log1p(size)
    out[:, k + 1] = np.log1p(words)
    out[:, k + 2] = np.minimum(np.add.reduceat(np.r_[ends - starts, 0], np.minimum(at[:-1], len(h))) * (words > 0) / np.maximum(words, 1), 40) / 10
    for d in np.flatnonzero(words).tolist():
        own = h[at[d] : at[d + 1]]
        n = len(own)
        ordered = np.sort(own)
        cut = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
        out[d, k + 3] = len(cut) / n
        out[d, k + 4] = np.diff(np.r_[cut, n]).max() / n
        for j, run in ((k + 5, 2), (k + 6, 4)):
            if n >= run:
                key = own[: n - run + 1].copy()
                for i in range(1, run):
                    key = key * np.uint64(0x9E3779B97F4A7C15) + own[i : n - run + 1 + i]
                key.sort()
                out[d, j] = (1 + np.count_nonzero(key[1:] != key[:-1])) / len(key)
            else:
                out[d, j] = 1.0
    out[:, k + 7] = words < 20
    return out


def _mapped(rows: DataFrame, keep: list[str], schema: str, finish) -> DataFrame:
    """Apply ``finish(features)`` to each text; ``keep`` columns come first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(keep))
            for lo, hi in pieces(texts, HELD_BYTES):
                arrays, names = finish(features(*flat_bytes(texts, lo, hi)))
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(lo, hi - lo) for i in range(len(keep))), *arrays], [*keep, *names])

    return small_batches(rows.select(*keep, "text")).mapInArrow(run, schema)


def standard(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Features as fitting and scoring see them: outliers count as six deviations."""
    return np.clip((x - mean) / scale, -6, 6)


class Merit:
    """Weights over standardised features, and the threshold."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray, threshold: float) -> None:
        self.mean, self.scale, self.weights, self.threshold = mean, scale, weights, threshold

    def merits(self, x: np.ndarray) -> np.ndarray:
        return standard(x, self.mean, self.scale) @ self.weights

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = np.clip(self.merits(x) - self.threshold, -30, 30)
        return 1 / (1 + np.exp(-z) * (1 - THRESHOLD) / THRESHOLD)


def fit(x: np.ndarray, label: np.ndarray, share_low: float, partners: int = PARTNERS, ridge: float = RIDGE) -> Merit:
    """Logistic loss on the differences of (preferred, other) pairs, by Newton steps."""
    mean, scale = (x.mean(0), x.std(0) + 1e-9) if len(x) else (np.zeros(len(FEATURES)), np.ones(len(FEATURES)))
    z = standard(x, mean, scale)
    high, low = z[label == 1], z[label == 0]
    w = np.zeros(len(FEATURES))
    if not len(high) or not len(low):
        return Merit(mean, scale, w, 0.0)
    n = max(len(high), len(low))
    gaps = np.concatenate([high[(np.arange(n)) % len(high)] - low[(np.arange(n) * (2 * k + 1) + k * k) % len(low)] for k in range(partners)])
    for _ in range(25):
        p = 1 / (1 + np.exp(np.clip(gaps @ w, -30, 30)))
        slope = gaps.T @ p / len(gaps) - ridge * w
        bend = (gaps * (p * (1 - p))[:, None]).T @ gaps / len(gaps) + ridge * np.eye(len(w))
        step = np.linalg.solve(bend, slope)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    # the quantile of the merits, each label weighted by its share of all labels
    merit = np.r_[high @ w, low @ w]
    weight = np.r_[np.full(len(high), (1 - share_low) / len(high)), np.full(len(low), share_low / len(low))]
    order = np.argsort(merit)
    at = int(np.searchsorted(np.cumsum(weight[order]), share_low))
    near = merit[order][[max(at - 1, 0), min(at, len(merit) - 1), min(at + 1, len(merit) - 1)]]
    return Merit(mean, scale, w, float((near[1] + near[2]) / 2))


def _chunks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """quality, chunk, packed: the features of all labelled documents outside the held-out fold, ``CHUNK`` rows of them at a time."""
    known = labels.select("doc_id", "quality").where("quality in (0, 1)").where(~held_out()).select("doc_id", F.col("quality").cast("int").alias("quality")).distinct()
    # features are made where the texts lie, so that no text is shuffled; one text for each id and label
    kind = dict(docs.dtypes)["doc_id"]
    own = docs.where(~held_out()).select("doc_id", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("digest"), "text")
    made = _mapped(own, ["doc_id", "digest"], f"doc_id {kind}, digest string, x array<double>", lambda x: ([pa.array(list(x), pa.list_(pa.float64()))], ["x"]))
    met = made.join(known.hint("merge"), "doc_id").groupBy("doc_id", "quality").agg(F.min(F.struct("digest", "x")).alias("least"))
    found = durable(met.select("doc_id", "quality", "least.x", F.xxhash64("doc_id", F.lit("quality")).alias("turn")), "features")
    placed = numbered(found, "turn", "doc_id", by=["quality"], name="nth").select("quality", F.expr(f"nth div {CHUNK}").alias("chunk"), "x")

    def packed(rows: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(rows["x"].to_numpy())
        x = x[np.lexsort(x.T)]  # the same fit in whatever order rows arrive
        return pd.DataFrame({"quality": rows["quality"].iloc[:1], "chunk": rows["chunk"].iloc[:1], "packed": [x.tobytes()]})

    out = durable(placed.groupBy("quality", "chunk").applyInPandas(packed, "quality int, chunk long, packed binary"), "chunks")
    release(found)
    return out


def _rows(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed).reshape(-1, len(FEATURES))


def _summed(chunks: DataFrame, columns: list[str], function) -> np.ndarray:
    """The sum over all rows of ``function`` of their arrays; it gives arrays of one length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in columns)):
                one = function(*(_rows(v) if isinstance(v, bytes) else v for v in row))
                total = one if total is None else total + one
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["sums"])

    parts = chunks.select(*columns).mapInArrow(run, "sums array<double>")
    sums = parts.select(F.posexplode("sums").alias("at", "sum")).groupBy("at").agg(F.sum("sum").alias("sum")).collect()
    return np.array([r["sum"] for r in sorted(sums, key=lambda r: r["at"])])


def train(docs: DataFrame, labels: DataFrame, partners: int = PARTNERS, ridge: float = RIDGE) -> Merit:
    """:func:`fit` on all labelled documents outside the held-out fold, as sums over chunks of them."""
    chunks, k = _chunks(docs, labels), len(FEATURES)
    held = {r["quality"]: (r["n"], r["rows"]) for r in chunks.groupBy("quality").agg(F.count(F.lit(1)).alias("n"), F.sum(F.expr(f"length(packed) div {8 * k}")).alias("rows")).collect()}
    total = sum(rows for _, rows in held.values())
    mean, scale, w = np.zeros(k), np.ones(k), np.zeros(k)
    if total:
        mean = _summed(chunks, ["packed"], lambda x: x.sum(0)) / total
        scale = np.sqrt(_summed(chunks, ["packed"], lambda x: ((x - mean) ** 2).sum(0)) / total) + 1e-9
    if len(held) < 2:
        release(chunks)
        return Merit(mean, scale, w, 0.0)
    most = max(n for n, _ in held.values())
    side = lambda q, name: chunks.where(F.col("quality") == q).select(F.explode(F.sequence("chunk", F.lit(most - 1), F.lit(held[q][0]).cast("long"))).alias("chunk"), F.col("packed").alias(name))
    pairs = durable(side(1, "high").join(side(0, "low"), "chunk"), "pairs")

    def step(high: np.ndarray, low: np.ndarray) -> np.ndarray:
        high, low, n = standard(high, mean, scale), standard(low, mean, scale), max(len(high), len(low))
        slope, bend, at = np.zeros(k), np.zeros((k, k)), np.arange(n)
        for turn in range(partners):
            gaps = high[at % len(high)] - low[(at * (2 * turn + 1) + turn * turn) % len(low)]
            p = 1 / (1 + np.exp(np.clip(gaps @ w, -30, 30)))
            slope += gaps.T @ p
            bend += (gaps * (p * (1 - p))[:, None]).T @ gaps
        return np.r_[float(n * partners), slope, bend.ravel()]

    for _ in range(25):
        sums = _summed(pairs, ["high", "low"], step)
        move = np.linalg.solve(sums[1 + k :].reshape(k, k) / sums[0] + ridge * np.eye(k), sums[1 : 1 + k] / sums[0] - ridge * w)
        w = w + move
        if np.abs(move).max() < 1e-6:
            break
    w = np.round(w, 9)  # sums differ in their last digits by the order in which tasks end
    share = _share_low(labels)
    threshold = _threshold(chunks, mean, scale, w, {q: rows for q, (_, rows) in held.items()}, share)
    release(chunks, pairs)
    return Merit(mean, scale, w, threshold)


def _share_low(labels: DataFrame) -> float:
    """The share of label 0 among all labels outside the held-out fold."""
    known = labels.where("quality in (0, 1)").where(~held_out())
    n = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    return n.get(0, 0) / max(1, sum(n.values()))


def _threshold(chunks: DataFrame, mean: np.ndarray, scale: np.ndarray, w: np.ndarray, rows: dict[int, int], share: float) -> float:
    """The quantile ``share`` of all merits, each label weighted by its share of all labels; between it and the next merit."""
    weight = np.array([share / rows[0], (1 - share) / rows[1]])
    low, high = -7 * np.abs(w).sum() - 1, 7 * np.abs(w).sum() + 1
    under = 0.0  # the weight of the merits below ``low``
    merits = lambda x: standard(x, mean, scale) @ w
    while high - low > 1e-11 * max(1.0, abs(low)):
        edges = np.linspace(low, high, BINS + 1)

        def counted(x: np.ndarray, quality: int, edges: np.ndarray = edges) -> np.ndarray:
            merit = merits(x)
            place = np.searchsorted(edges, merit[(merit >= edges[0]) & (merit < edges[-1])], "right") - 1
            out = np.zeros((2, BINS))
            out[quality] = np.bincount(place, minlength=BINS)
            return out.ravel()

        counts = weight @ _summed(chunks, ["packed", "quality"], counted).reshape(2, BINS)
        upto = under + np.cumsum(counts)
        reached = np.flatnonzero((upto >= share - 1e-12) & (counts > 0))
        at = int(reached[0]) if len(reached) else int(np.flatnonzero(counts)[-1])
        under = float(upto[at] - counts[at])
        low, high = float(edges[at]), float(edges[at + 1])

    def following(batches: Iterator[pa.RecordBatch], high: float = high) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            least = [float(m[m >= high].min()) for m in map(merits, map(_rows, batch.column("packed").to_pylist())) if (m >= high).any()]
            yield pa.RecordBatch.from_arrays([pa.array(least, pa.float64())], ["merit"])

    # between the merit at the quantile and the next one
    after = chunks.select("packed").mapInArrow(following, "merit double").agg(F.min("merit")).first()[0]
    return (low + high) / 2 if after is None else ((low + high) / 2 + after) / 2


def score(docs: DataFrame, merit: Merit, keep: list[str]) -> DataFrame:
    """``keep`` columns of ``docs`` and the score of each text."""
    sent = docs.sparkSession.sparkContext.broadcast(merit)
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return _mapped(docs, keep, f"{kept}, score double", lambda x: ([pa.array(sent.value.scores(x))], ["score"]))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    out = score(docs, train(docs, labels), ["doc_id"])
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def accepted(docs: DataFrame, merit: Merit) -> DataFrame:
    """The documents whose score reaches the threshold, with all their columns."""
    sent = docs.sparkSession.sparkContext.broadcast(merit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            for lo, hi in pieces(texts, HELD_BYTES):
                good = sent.value.scores(features(*flat_bytes(texts, lo, hi))) >= THRESHOLD
                yield batch.slice(lo, hi - lo).filter(pa.array(good))

    return small_batches(docs).mapInArrow(run, docs.schema)
