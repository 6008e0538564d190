"""The corpus pipeline: quality, line dedup, near-duplicate documents, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from specloom.llm import common, jaccard, linededup, packing, quality
from specloom.llm.queries import vocabulary


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.resample(docs, common.table(spark, sf_dir, "labels"))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return linededup.clean(docs, copy_share=linededup.COPY_SHARE, **linededup.ALL_LINES)


def one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"), with_ids=True)


STAGES = [("quality", good_documents), ("line dedup", without_repeated_lines), ("near duplicates", one_of_similar), ("packing", packed)]
#: Hashes, tokens and random keys are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written to the shared folder and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = common.cut(docs, "stage")
    return docs
