"""The corpus pipeline: stages from raw documents to token ids.

Each stage takes (spark, docs, folder of the sample tables) and returns a
DataFrame; each is written as Parquet and read again before the next. A stage
works on all rows that its predecessor kept. All but the last return the columns of
``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mercato.llm import bpe, rules, secrets, simhash, winnow
from mercato.llm.common import read
from mercato.llm.queries import public_ranks
from mercato.llm.stages import run_stages

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the policy of the rule ledger rejects go."""
    return rules.passing(docs, policy=rules.POLICIES["v1"])


def near_dedup(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that with the smallest id."""
    return simhash.drop_near_duplicates(docs, shingle=3, max_bits=2)


def decontamination(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that are contaminated by the benchmark go."""
    return winnow.clean(docs, read(spark, folder, "benchmark"))


def secret_scans(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Secrets are replaced by a mark; the length of the text follows."""
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def byte_bpe(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Every text's token ids, with digests of the ids and of what they decode to."""
    return bpe.tokenized(spark, docs, public_ranks())


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("secret_scans", secret_scans),
    ("byte_bpe", byte_bpe),
]

#: SimHash and BPE cannot be written in SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages over ``documents``."""
    return run_stages(spark, read(spark, folder, "documents"), folder, STAGES)
