"""A training-corpus pipeline made of the library's operators.

Stages, in order: drop documents of low quality, keep one document of each
near-duplicate group, drop documents that hold benchmark text, replace
personal data, encode as byte-level BPE.  Each stage gets all documents that
the stage before it kept; all but the last return the columns of ``documents``.

Nulls: a document with a null text is scored as an empty one, is never a near
duplicate or contaminated, stays null when redacted and encodes to no ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointweave.llm import bpe, decontam, neardup, pii, quality
from pointweave.llm.common import durable, table
from pointweave.llm.queries import tokenizer_path


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose pairwise-ranked quality score reaches the threshold.

    The ranking is fitted on the labels of the whole table ``documents``.
    """
    merit = quality.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality.accepted(docs, merit)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of five-word-shingle similarity of 0.8 or more."""
    return neardup.representatives(docs, width=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a verbatim benchmark window."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind; n_chars counts the new text."""
    clean = pii.redact(docs)
    return clean.withColumn("n_chars", F.char_length("text").cast("long")).select(docs.columns) if "n_chars" in docs.columns else clean


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token ids, their number and the digest of what they decode to.

    Columns of those names, or named ``decoded``, are replaced.
    """
    out = bpe.round_trip(docs, tokenizer_path())
    own = ("ids", "n_tokens", "decoded", "decoded_sha256")
    return out.select(*(c for c in docs.columns if c not in own), "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality", drop_low_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", replace_personal_data),
    ("encoding", encode),
]

#: The classifier and the tokenizer have no form in SQL; tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = durable(docs, name)
    return docs
