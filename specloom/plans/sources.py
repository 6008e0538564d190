"""Queries of the readers: tables written as the files that are read in production, and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specloom.operators.order import shared_folder
from specloom.plans.registry import registry
from specloom.sources import line_index, tables

QUERIES, SQL, query = registry()

#: Bytes of a range in these queries, so that even small files have many.
SIZE = 1 << 18


def _orders(spark: SparkSession, d: str) -> DataFrame:
    """Orders in the order of their keys, in files whose names keep that order."""
    rows = spark.read.parquet(f"{d}/orders.parquet")
    return rows.repartitionByRange(4, "o_orderkey").sortWithinPartitions("o_orderkey")


_K = "o_orderkey"
#: Cells by o_orderkey % 6: plain, line ends, quotes, the delimiter, both, and none.
CELLS = ("C{k}", "C\n{k}\n", 'say "{k}"', "a,{k}", '"\n,{k}""\n', "")


@query(
    rf"""select o_orderkey::varchar as filename, nullif(replace(list_extract([{", ".join("'" + c.replace(chr(10), "' || chr(10) || '") + "'" for c in CELLS)}], (o_orderkey % 6 + 1)::int), '{{k}}', o_orderkey::varchar), '') as smiles,
    o_orderstatus nmr_type, o_orderpriority processed, row_number() over (order by o_orderkey) - 1 row_index from orders"""
)
def s1_quoted_csv(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("o_orderkey").cast("string")
    cell = F.replace(F.element_at(F.array(*map(F.lit, CELLS)), (F.col("o_orderkey") % 6 + 1).cast("int")), F.lit("{k}"), key)
    values = {"Filename": key, "SMILES": F.when(cell != "", cell), "NMR_type": F.col("o_orderstatus"), "NMR_processed": F.col("o_orderpriority")}
    raw = _orders(spark, d).select(*(values.get(c, F.lit("x")).alias(c) for c in tables.RAW_COLUMNS))
    path = shared_folder(spark, "raw-csv")
    raw.write.options(header=True, escape=chr(34), ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    return tables.read_raw_csv(spark, path, size=SIZE).select("filename", "smiles", "nmr_type", "processed", "row_index")


@query("select p as position, o_orderkey as id, o_orderpriority as priority from (select *, row_number() over (order by o_orderkey) - 1 p from orders) x where p % 97 = 5")
def s7_random_access(spark: SparkSession, d: str) -> DataFrame:
    path = shared_folder(spark, "samples")
    _orders(spark, d).select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("priority")).write.json(path)
    index = line_index.LineIndex(spark, path, size=SIZE)
    lines = index.take(spark.range(5, len(index), 97).withColumnRenamed("id", "position"))
    return lines.select("position", F.from_json("line", "id long, priority string").alias("r")).select("position", "r.*")
