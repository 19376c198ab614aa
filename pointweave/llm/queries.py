"""The registered queries of the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pointweave.llm import bpe, chat, decontam, jpeg, langid, manifest, neardup, oracles, phrases, pii, quality, repeats, sharding, tokenfiles
from pointweave.llm.common import table
from pointweave.sources.durable import shared_dir


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_jpeg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jpeg.report(table(spark, sf_dir, "documents"))


def op4_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.report(table(spark, sf_dir, "documents"))


def op5_pairwise_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_parsed_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.report(table(spark, sf_dir, "documents"))


def op3_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"))


def op6_hyperminhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.report(table(spark, sf_dir, "documents"), width=3, percent=85)


def op7_suffix_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("longest_item")


def op8_snapshot_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.maximal(table(spark, sf_dir, "conversations"))


def op9_checked_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op10_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), tokenizer_path())


def op11_fm_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op12_packed_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    return tokenfiles.report(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.report(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_jpeg_media": op1_jpeg_media,
        "op4_language_mixture": op4_language_mixture,
        "op5_pairwise_quality": op5_pairwise_quality,
        "op2_parsed_repeats": op2_parsed_repeats,
        "op3_rendezvous_sharding": op3_rendezvous_sharding,
        "op6_hyperminhash_groups": op6_hyperminhash_groups,
        "op7_suffix_decontamination": op7_suffix_decontamination,
        "op8_snapshot_collapse": op8_snapshot_collapse,
        "op9_checked_pii": op9_checked_pii,
        "op10_bpe_round_trip": op10_bpe_round_trip,
        "op11_fm_collocations": op11_fm_collocations,
        "op12_packed_token_files": op12_packed_token_files,
        "op13_merkle_manifest": op13_merkle_manifest,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_parsed_repeats": oracles.REPEATS,
        "op6_hyperminhash_groups": oracles.NEAR_DUPLICATES,
        "op7_suffix_decontamination": oracles.DECONTAMINATION,
        "op8_snapshot_collapse": chat.ORACLE,
        "op11_fm_collocations": phrases.ORACLE,
        "op13_merkle_manifest": manifest.ORACLE,
    }
