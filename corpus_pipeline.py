"""A packed training corpus from raw documents, in stages that each write their result.

Language identification drops documents whose language it rejects; the Jaccard join keeps one document of each group of near
duplicates; decontamination drops documents that hold benchmark passages; the secret scan masks secrets in the texts; packing
places the token pieces of what is left in sequences of 2048 tokens.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from gradus.llm import decontamination, jaccard_join, language_id, packing, secret_scan
from gradus.llm.common import read, written


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language is rejected go: null texts, texts without letters, narrow margins. Whole texts are judged."""
    return language_id.drop_rejected(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates stays, that of the smallest doc_id; texts without words all stay."""
    return jaccard_join.drop_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a window of a benchmark item go; an empty benchmark takes none."""
    return decontamination.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows stay; found secrets are masked in their texts, and n_chars follows."""
    return secret_scan.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of the token pieces of all rows; a null or empty text is its end id alone."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)


STAGES = [
    ("language_id", identify_language),
    ("jaccard_join", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("secret_scan", mask_secrets),
    ("best_two_fit", pack),
]

#: SQL can't say what zstandard, the tokenizers library and the packing do.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of ``documents``. Extra columns, whatever their names, pass through to the last stage; no rows give no pieces."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
