"""Corpus preparation: judge, deduplicate, redact, pack.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is
written as Parquet to the shared folder and read again as the next stage's docs.

Every stage takes null values in any column, empty and very long texts, repeated
rows and ids, tables without rows, and further columns whatever their names; the
stages' docstrings say what becomes of them.  All but the last return the columns
that they were given.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from stratafield.llm import ngram_join, packing, quality, secrets
from stratafield.llm.storage import materialize

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line classifier does not reject.

    A null or empty text is judged as one empty line; rows without doc_id are
    judged like others; repeated rows share one fate; without labels of both
    classes nothing is rejected; an empty table stays empty."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def keep_unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the smallest doc_id, null last.

    Rows are judged one by one by their texts, so unlike rows with one doc_id all
    stay and like ones leave one; of rows that agree in doc_id and text one stays;
    rows with a null, empty or blank text all stay; an empty table stays empty."""
    return ngram_join.keep_one(docs)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced.

    No row goes: null and empty texts stay as they are, repeated rows are treated
    alike, rows without doc_id too; an empty table stays empty."""
    return secrets.redact_secrets(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining texts with their sequence and offset.

    A null or empty text is the end id alone; a null doc_id stays null; repeated
    rows are packed once each; an empty table gives no rows."""
    return packing.pack_documents(docs, TOKENIZER)


STAGES = [("quality", keep_quality), ("near_duplicates", keep_unique), ("secrets", hide_secrets), ("packing", pack)]

#: No stage but the packing of lengths can be told in SQL; tests hold the rows
#: against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
