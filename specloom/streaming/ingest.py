"""Streaming ingest (an extension): micro-batches of raw records keep the k best of each key and nucleus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from specloom.operators import ingest


def merge_top(state: DataFrame | None, batch: DataFrame, k: int) -> DataFrame:
    """The k best of what was kept and what is new; only k rows a key and nucleus are ever kept, so the state is bounded."""
    found = ingest.candidates(batch)
    if state is not None:
        found = state.drop("rank").unionByName(found)
    return ingest.top_candidates(found.dropDuplicates(["mol_key", "nucleus", "row_index"]), k)


def start(raw: DataFrame, state_path: str, checkpoint: str, *, k: int = 3) -> StreamingQuery:
    """Runs merge_top on every micro-batch. Each batch writes a folder of its own and the next reads the last whole one, so
    a batch that is run again starts from the same state and gives the same rows."""
    spark = raw.sparkSession

    def step(batch: DataFrame, number: int) -> None:
        before = spark.read.parquet(f"{state_path}/batch={number - 1}") if number else None
        merge_top(before, batch, k).write.mode("overwrite").parquet(f"{state_path}/batch={number}")

    return raw.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def best_pairs(spark: SparkSession, state_path: str, batch: int, **options) -> DataFrame:
    """Best pairs as of a batch."""
    return ingest.best_pairs(spark.read.parquet(f"{state_path}/batch={batch}").drop("rank"), **options)
