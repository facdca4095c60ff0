"""The corpus pipeline: each stage works on all that its predecessor kept, written as Parquet and read again.

Toxic documents go; of each group of near-duplicates the one with the smallest id stays; documents that hold a benchmark item go;
personal data is masked in the text and the length brought up to date; the rest is encoded as piece ids with spans.
All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from echolake.llm import decontaminate, personal, pieces, simhash, toxicity
from echolake.llm.common import stored, table
from echolake.llm.queries import piece_model


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    net = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.keep(docs, net)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def personal_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return personal.mask(docs, personal.train(docs))


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encode(docs, piece_model(), decoded=True)


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("personal_data", personal_stage),
    ("pieces", encode_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
