"""One query for each operator, over whole sample tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mercato.llm import (
    bpe,
    merkle,
    mixing,
    oracle,
    pii,
    quality,
    rules,
    secrets,
    simhash,
    toxicity,
    trie,
    url_lists,
    warc,
    winnow,
)
from mercato.llm.common import read
from mercato.session import checkpoint, remove_folder, shared_folder


def op1_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's fingerprint and near-duplicate component."""
    found = simhash.near_duplicates(read(spark, folder, "documents"))
    return found.select(
        F.col("id").alias("doc_id"),
        simhash.hex_digits(F.col("fingerprint")).alias("fingerprint"),
        "component_id",
    )


def op2_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's toxicity score."""
    return toxicity.report(read(spark, folder, "documents"), read(spark, folder, "labels"))


def op3_secret_scans(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets in every document, found once for each distinct text.

    The ledger lies in the shared folder until its findings are read.
    """
    stored = f"{shared_folder(spark)}/ledger-{uuid.uuid4().hex}"
    found = checkpoint(
        secrets.report(read(spark, folder, "documents"), ledger=secrets.Ledger(spark, stored))
    )
    remove_folder(spark, stored)
    return found


def op4_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    """Every page against the list entries active on the day of its fetch."""
    pages = read(spark, folder, "pages")
    found = url_lists.filtered(url_lists.sample_captures(pages), url_lists.sample_events(pages))
    return found.withColumn("lists", F.array_join("lists", ","))


def op5_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's quality score."""
    return quality.report(read(spark, folder, "documents"), read(spark, folder, "labels"))


def op6_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Words of every document that lie in passages of the benchmark."""
    return winnow.report(read(spark, folder, "documents"), read(spark, folder, "benchmark"))


def op7_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Every page written to archives and read back.

    The archives lie in the shared folder until their records are read.
    """
    archives = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    warc.write_archives(read(spark, folder, "pages"), archives)
    found = checkpoint(
        warc.read_archives(spark, archives).select(
            "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
        )
    )
    remove_folder(spark, archives)
    return found


#: The rank file of the BPE query, one of the public tokenizers.
RANK_FILE = "byte_bpe_50k.tiktoken"


def public_ranks() -> bpe.Ranks:
    return bpe.load_ranks(public_tokenizers.path(RANK_FILE), public_tokenizers.PATTERN)


def op8_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of every document, and the bytes that they stand for."""
    return bpe.report(spark, read(spark, folder, "documents"), public_ranks())


def op9_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Measurements and failure bits of every document under the rule ledger."""
    return rules.report(read(spark, folder, "documents"))


def op10_pii(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data in every document, and the terms that give it away."""
    return pii.report(read(spark, folder, "documents"))


def op11_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's proof in the manifest, and whether it holds for the possibly tampered text.

    The manifest lies in the shared folder until its proofs are read.
    """
    stored = f"{shared_folder(spark)}/manifest-{uuid.uuid4().hex}"
    found = checkpoint(merkle.report(spark, read(spark, folder, "documents"), stored))
    remove_folder(spark, stored)
    return found


def op12_weighted_mix(spark: SparkSession, folder: str) -> DataFrame:
    """What a mix by source weights takes of every document."""
    return mixing.mix(read(spark, folder, "documents"))


def op13_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    """Every shared prefix of the rebuilt conversations."""
    return trie.report(read(spark, folder, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_simhash_near_dedup,
        op2_toxicity,
        op3_secret_scans,
        op4_url_filters,
        op5_quality_classifier,
        op6_benchmark_decontamination,
        op7_warc,
        op8_byte_bpe,
        op9_quality_rules,
        op10_pii,
        op11_merkle_manifest,
        op12_weighted_mix,
        op13_prefix_trie,
    )
}

ORACLE_SQL: dict[str, str] = oracle.SQL
