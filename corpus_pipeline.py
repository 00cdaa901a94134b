"""The training-data pipeline: documents that are good, unique, not in a benchmark and free of secrets, as token ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pulsegrid.llm import bpe, decontaminate, near_dedup, ordinal_quality, secret_scan
from pulsegrid.llm.common import Workspace, read


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stay whose probability of the best grade, by the ordinal classifier, is high enough.

    A null text is judged as an empty one; repeated rows share their fate; without ratings all documents stay.
    """
    ratings = ordinal_quality.graded(read(spark, sf_dir, "labels"))
    return ordinal_quality.keep_good(docs, ratings)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: that of the least doc_id, and one row of it.

    Null and empty texts, and rows with a null doc_id, stay as they are.
    """
    return near_dedup.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold the question and the answer of a benchmark item go.

    Null and empty texts and rows with a null doc_id stay; repeated rows go together; without items all stay.
    """
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are replaced by a mark; all documents stay, null texts stay null."""
    return secret_scan.redact(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and digests of the ids and of the text that they decode to; a null text has none."""
    import public_tokenizers

    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.json")).select("doc_id", "lang", "source", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("quality classifier", quality),
    ("MinHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scans", secrets),
    ("BPE encoding and decoding", tokens),
]

#: SQL can't express the stages; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    work = Workspace(spark)
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = work.save(stage(spark, docs, sf_dir))
    return docs
