"""A training corpus from raw documents, in five stages.

Each stage works on all rows that the one before kept, and is written as Parquet
in the shared folder and read again, so a lost executor costs no stage twice.
All stages but the last return the columns of documents.

1. quality: documents that the classifier rejects (poor or toxic) go.
2. near_duplicates: of each group of similar documents the least doc_id stays.
3. decontamination: documents that leak a benchmark item go.
4. secrets: live-looking secrets are masked in the text; no document goes.
5. bpe: the tokens of every document.

Odd input: null and empty texts are judged by the classifier as empty texts; kept
ones pass the next stages untouched and end with null or no tokens.  Rows without
a doc_id are never near duplicates, and are judged, checked and masked as any
other; rows with one doc_id stay or go together as near duplicates and each for
itself elsewhere.  Further columns, whatever their names, pass all stages but the
last.  An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from orrery.llm import bpe, decontam, jaccard, quality, secrets
from orrery.llm.common import table, written


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.filter_documents(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode(docs)


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("secrets", mask_secrets),
    ("bpe", encode),
]

#: Trees, a latent basis and byte-pair merges are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
