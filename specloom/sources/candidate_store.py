"""Candidates stored in the order in which molecules are paired."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: The stored order. Nulls come first in files, so a null score counts as the lowest number.
ORDER = ["mol_key", "nucleus", "falling", "row_index"]
LOWEST = 1 << 30
#: Spark reports a bucket's order to the planner only with this setting; each bucket is one file here, so it holds.
ORDERED = "spark.sql.legacy.bucketedTableScan.outputOrdering"


class CandidateStore:
    """Candidates as Parquet in buckets by mol_key, each one file sorted by mol_key, nucleus, falling score and row: an index by
    molecule. Counting, ranking and pairing by molecule over rows() shuffle and sort nothing.

    path: a folder of the store's own. buckets: so many that a task takes about 128 MB of Parquet; a store is opened with the
    number it was written with, another finds no files. A molecule is in one bucket whole, as ranking needs it, and ranking
    streams over it. write() and reset() replace all that was there. Null keys are a molecule. Extra columns are kept, but one
    named falling is replaced.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 200):
        if buckets < 1:
            raise ValueError("a store needs buckets")
        self.spark, self.path, self.buckets = spark, f"{path.rstrip('/')}/buckets-{buckets}", buckets

    def write(self, found: DataFrame) -> CandidateStore:
        """found: candidates (mol_key, nucleus, score, row_index, ...). One exchange, by the buckets' own hash."""
        falling = F.coalesce(-F.col("score"), F.lit(LOWEST)).cast("int")
        rows = found.withColumn("falling", falling).repartition(self.buckets, "mol_key")
        with self._named() as name:
            writer = rows.write.mode("overwrite").format("parquet").option("path", self.path)
            writer.bucketBy(self.buckets, "mol_key").sortBy(*ORDER).saveAsTable(name)
        # empty buckets have no files, so the columns are stored apart
        self.spark.createDataFrame([], rows.schema).write.mode("overwrite").parquet(f"{self.path}-columns")
        return self

    def reset(self) -> CandidateStore:
        """Leaves no rows and the same columns."""
        return self.write(self.spark.createDataFrame([], self._columns()))

    def rows(self) -> DataFrame:
        """The candidates, with falling, in their buckets and order; switches the setting on that tells plans of the order."""
        schema = self._columns()
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        by = f"CLUSTERED BY (mol_key) SORTED BY ({', '.join(ORDER)}) INTO {self.buckets} BUCKETS"
        self.spark.conf.set(ORDERED, "true")
        with self._named() as name:
            self.spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet {by} LOCATION '{self.path}'")
            return self.spark.table(name)

    def _columns(self) -> StructType:
        return self.spark.read.parquet(f"{self.path}-columns").schema

    @contextmanager
    def _named(self):
        """A name in the catalog, which alone knows of buckets, for as long as it takes to bind it. The files stay."""
        name = f"specloom_candidates_{uuid.uuid4().hex}"
        try:
            yield name
        finally:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
