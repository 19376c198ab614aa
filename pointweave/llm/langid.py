"""Language of a text by multilingual mixture inference (operator 4).

Each language is a distribution over hashed byte trigrams, counted by Spark
over every training document.  A text is a mixture: expectation-maximisation
estimates the language proportions that best explain its trigrams.  Sets of
languages grow by the largest proportions, and the set of the highest
likelihood, less ``penalty * ln(trigrams)`` for each language, is selected.

The model has languages x ``buckets`` counts whatever the corpus holds; that
table alone goes through the driver to the tasks.

Defined results: a null text, or one without a letter, is ``und`` with score 0;
so is every text where no training document has a language.  Rows are
independent, repeated rows train as often as they stand, equal proportions
fall to the language that sorts first; null ids count as held out and never
train; a null language never trains; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointweave.llm.common import LOWER, held_out, small_batches

BUCKETS = 1 << 15
STEPS = 12
PENALTY = 3.0
SMOOTHING = 0.5

#: ASCII letters lower-cased, other ASCII as a space, non-ASCII bytes kept.
_FOLD = np.where((LOWER >= 97) & (LOWER <= 122) | (LOWER >= 128), LOWER, 32).astype(np.uint32)
_LETTER = regex.compile(r"\p{L}")


def _grams(data: bytes, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams of a padded text that are not all space: bucket, count."""
    x = _FOLD[np.frombuffer(b" " + data + b" ", np.uint8)]
    key = (x[:-2] << np.uint32(16)) | (x[1:-1] << np.uint32(8)) | x[2:]
    key = key[key != 0x202020]
    n = np.bincount((key * np.uint32(0x9E3779B1)) >> np.uint32(32 - buckets.bit_length() + 1), minlength=buckets)
    at = np.flatnonzero(n)
    return at, n[at]


def train(docs: DataFrame, buckets: int = BUCKETS) -> tuple[list[str], np.ndarray]:
    """Languages in order, and probabilities[bucket, language].

    ``docs`` has text and lang; every row with both counts.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, n in held.items():
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(n[at], pa.int64())], ["lang", "bucket", "n"])
            held.clear()

        for batch in batches:
            for lang, text in zip(batch.column(1), batch.column(0)):
                at, n = _grams(text.as_py().encode(), buckets)
                own = held.setdefault(lang.as_py(), np.zeros(buckets, np.int64))
                own[at] += n
                if len(held) > 64:
                    yield from flush()
        yield from flush()

    rows = small_batches(docs.select("text", "lang").where("text is not null and lang is not null")).mapInArrow(count, "lang string, bucket long, n long")
    table = rows.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    names = sorted(table["lang"].unique())
    counts = np.full((buckets, len(names)), SMOOTHING)
    counts[table["bucket"].to_numpy(int), np.searchsorted(names, table["lang"].to_numpy(str))] += table["n"].to_numpy(float) if len(names) else 0
    return names, counts / counts.sum(0) if len(names) else counts


def _em(p: np.ndarray, n: np.ndarray, start: np.ndarray, steps: int) -> tuple[np.ndarray, float]:
    """Proportions after ``steps`` rounds, and the log-likelihood they have."""
    share = start / start.sum()
    total = n.sum()
    for _ in range(steps):
        share = share * ((n / (p @ share)) @ p) / total
    return share, float(n @ np.log(p @ share))


def mixture(p: np.ndarray, n: np.ndarray, steps: int = STEPS, penalty: float = PENALTY) -> np.ndarray:
    """Language proportions of one text, zero outside the selected set.

    p[i, l]: probability of the text's i-th distinct trigram in language l;
    n[i]: how often it stands there.
    """
    langs = p.shape[1]
    share, _ = _em(p, n, np.ones(langs), steps)
    order = np.argsort(-share, kind="stable")
    cost = penalty * np.log(n.sum() + 1.0)
    best, best_value = None, -np.inf
    for k in range(1, langs + 1):
        chosen = order[:k]
        own, value = (np.ones(1), float(n @ np.log(p[:, chosen[0]]))) if k == 1 else _em(p[:, chosen], n, share[chosen] + 1e-6, steps)
        if value - cost * k <= best_value:
            break
        best_value = value - cost * k
        best = np.zeros(langs)
        best[chosen] = own
    return best


def predict(docs: DataFrame, names: list[str], probabilities: np.ndarray, steps: int = STEPS, penalty: float = PENALTY) -> DataFrame:
    """doc_id, lang_pred, score (its proportion) and n_langs selected."""
    buckets = len(probabilities)
    sent = docs.sparkSession.sparkContext.broadcast((names, probabilities))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, table = sent.value
        for batch in batches:
            langs, scores, sizes = [], [], []
            for value in batch.column(1):
                text = value.as_py()
                if not text or not names or not _LETTER.search(text):
                    langs.append("und"), scores.append(0.0), sizes.append(0)
                    continue
                at, n = _grams(text.encode(), buckets)
                if not len(at):  # letters that fold to nothing cannot occur
                    langs.append("und"), scores.append(0.0), sizes.append(0)
                    continue
                share = mixture(table[at], n, steps, penalty)
                k = int(share.argmax())
                langs.append(names[k]), scores.append(float(min(1.0, share[k]))), sizes.append(int((share > 0).sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(sizes, pa.int32())], ["doc_id", "lang_pred", "score", "n_langs"])

    return small_batches(docs.select("doc_id", "text")).mapInArrow(run, "doc_id long, lang_pred string, score double, n_langs int")


def report(docs: DataFrame) -> DataFrame:
    """Train on the documents that are not held out, predict all."""
    names, table = train(docs.where(~held_out()))
    return predict(docs, names, table).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "n_langs")
