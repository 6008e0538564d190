"""Sharding by proportional stratified interleaving: every shard gets the mixture of sources that the whole table has."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows that a bucket of the shuffled order holds on average, and the most buckets that there may be.
BUCKET_ROWS, MOST_BUCKETS = 500, 65_536


def shuffle_key(seed: int, *columns: str) -> Column:
    """A hexadecimal digest of seed and columns; sorting by it shuffles."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *parts))


def interleave(
    docs: DataFrame, *, shards: int, seed: int = 17, doc_id: str = "doc_id", text: str = "text", source: str = "source"
) -> DataFrame:
    """Deals all rows to shards so that counts differ by one at most and each shard matches the mixture of sources.

    Rows are shuffled within their source by a seeded digest; row r of n there gets the fraction (r + 1/2) / n. All rows
    sorted by fraction make one sequence, which is cut into shards of equal count.

    Neither a source nor the sequence is ever sorted as a whole: rows go to even buckets of the digest, or of the fraction,
    each bucket is sorted alone, and counts of the buckets before it give the rank. A source that holds most rows is thus
    spread over as many tasks as any other rows, and two narrow shuffles do; texts are read once and not moved.

    Null sources are a source of their own; a null text has the size 8 and the checksum of no bytes; null and repeated
    doc_ids are dealt like others, repeated rows in any order; an empty table gives no rows; further columns are ignored.
    """
    total = docs.count()
    buckets = max(1, min(MOST_BUCKETS, math.ceil(total / BUCKET_ROWS)))
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        (F.octet_length(body) + 8).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.col(source).cast("string").alias("source"),
    )
    rows = rows.withColumn("key", shuffle_key(seed, "doc_id", "text_crc32", "size"))
    rows = rows.withColumn("stratum", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    rows = rows.withColumn("bucket", F.floor(F.conv(F.substring("key", 1, 7), 16, 10).cast("long") * buckets / (1 << 28)))
    own = ["key", "doc_id", "text_crc32", "size"]

    counts = rows.groupBy("stratum", "bucket").agg(F.count(F.lit(1)).alias("n"))
    whole = W.partitionBy("stratum")
    counts = counts.select(
        "stratum",
        "bucket",
        (F.sum("n").over(whole.orderBy("bucket")) - F.col("n")).alias("before"),
        F.sum("n").over(whole).alias("of"),
    )
    rank = F.row_number().over(W.partitionBy("stratum", "bucket").orderBy(*own)) - 1
    ranked = rows.withColumn("rank", rank).join(counts, ["stratum", "bucket"]).withColumn("rank", F.col("before") + F.col("rank"))
    ranked = ranked.select(*own, "source", "stratum", ((2 * F.col("rank") + 1).cast("double") / (2 * F.col("of")).cast("double")).alias("fraction"))
    ranked = ranked.withColumn("bucket", F.floor(F.col("fraction") * buckets))

    counts = ranked.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.select("bucket", (F.sum("n").over(W.orderBy("bucket")) - F.col("n")).alias("before"))
    place = F.row_number().over(W.partitionBy("bucket").orderBy("fraction", "stratum", *own)) - 1
    placed = ranked.withColumn("place", place).join(F.broadcast(counts), "bucket")  # MOST_BUCKETS rows at most
    placed = placed.withColumn("place", F.col("before") + F.col("place"))
    shard = F.expr(f"(place * {shards}L) div {max(total, 1)}L")
    return placed.withColumn("shard", shard).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        (F.col("place") - F.expr(f"(shard * {total}L + {shards - 1}L) div {shards}L")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "source",
    )


def write_shards(docs: DataFrame, placed: DataFrame, path: str, *, doc_id: str = "doc_id") -> None:
    """Writes the documents into a folder for each shard, in the order of the slots; doc_id must be unique."""
    rows = docs.join(placed.select(F.col("doc_id").alias(doc_id), "shard", "slot"), doc_id)
    rows.repartition("shard", F.floor(F.col("slot") / 100_000)).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
