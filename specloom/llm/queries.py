"""One query for each operator, with production parameters, over the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specloom.llm import ann, collocation, common, exact, extraction, jaccard, linededup, media, packing, pieces, quality, sharding, sql, trie, warc


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(common.table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op2_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.interleave(common.table(spark, sf_dir, "documents"), shards=24)


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(common.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op3_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.decisions(common.table(spark, sf_dir, "documents"), **linededup.ALL_LINES)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = common.table(spark, sf_dir, "pages")
    return warc.archive_and_read(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract(common.table(spark, sf_dir, "pages"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.decisions(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "times", "random_access"
    return media.store(common.table(spark, sf_dir, "documents")).select(*names)


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar(common.table(spark, sf_dir, "documents")).drop("text_hash")


def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(common.table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocation.collocations(common.table(spark, sf_dir, "documents"))


def op12_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.decisions(common.table(spark, sf_dir, "documents"))


def op13_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.nodes(common.table(spark, sf_dir, "conversations")).drop("position", "subtree_end")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_pack, op2_shard, op3_lines, op4_warc, op5_extract, op6_quality, op7_media, op8_jaccard, op9_neighbours, op10_pieces, op11_phrases, op12_exact, op13_trie)}
SQL: dict[str, str] = sql.SQL
