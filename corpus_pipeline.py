"""The corpus pipeline: five stages over documents, each written as Parquet and read again by the next.

language     documents without letters, or of which no language has 40 % of the words' probability, go
exact        of equal texts one stays
near         of each group of near copies (five-word shingles, similarity 0.8 or more) one stays
secrets      secrets are replaced by [SECRET] in the texts; no document goes
packing      documents are packed into bins of 32 KiB; one row for each piece of a document

All but the last return the columns of documents. ORACLE_SQL is None: SQL expresses neither the language
model nor the packing; tests/llm compares the stages with plain versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cartolith.llm import _common as C
from cartolith.llm import exact_dedup, lang_id, near_dedup, packing, secret_scan

LEAST_SHARE = 0.4


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lang_id.accepted(docs, lang_id.fit(docs), least=LEAST_SHARE)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.representatives(docs, size=5, percent=80)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(packing.items_of(docs))


STAGES = [("language", language), ("exact", exact), ("near", near), ("secrets", secrets), ("packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = C.materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
