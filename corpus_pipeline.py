"""Corpus pipeline: quality classifier, exact dedup, near-duplicate join, PII surrogates, packing.

Each stage works on all rows its predecessor kept, is written as Parquet into the shared folder and read again. All
but the last return the columns of `documents`; the last returns the packed pieces with their ids.

Edge cases, stage by stage: a null text counts as empty everywhere. quality scores an empty text like any other; exact
dedup keeps the smallest doc_id of equal texts (a null one only if there is no other, one of rows that tie on it); near
dedup keeps the first of each group by doc_id, then text, and every text without words; pii leaves null texts null; packing gives an
empty text its one closing id. Repeated rows are equal texts, so one stays. Texts of any length go whole through every
stage. An empty table gives empty stages. Further columns pass through all stages but the last, which returns its own;
names that begin with `_` are reserved.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trackloom.llm import exact_dedup, jaccard_join, packing, pii, quality_conv, shared

#: a real run takes its own, secret
SURROGATE_KEY = "corpus-pipeline"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_conv.keep_good(docs, shared.table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.deduplicate(docs)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.replace_pii(docs, SURROGATE_KEY).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, keep_ids=True)


STAGES = [("quality", quality), ("exact_dedup", exact), ("near_dedup", near), ("pii", private), ("packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = shared.staged(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
