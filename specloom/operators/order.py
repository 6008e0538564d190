"""Places in hashed orders without a sort of the whole, and the folder that driver and executors share."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Leading hexadecimal digits of a hash that make its bucket.
DIGITS = 3


def hash_order(seed: int, *columns: str) -> Column:
    """SHA-256 of 'seed:columns': an order that any engine can repeat."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)), 256)


def place_by_hash(rows: DataFrame, keys: list[str], hashed: str, *ties: str, name: str = "place") -> DataFrame:
    """Adds the place (from 1) of each row among those of equal keys, in the order of a SHA-256 and then of ties.

    The hash's first digits deal the rows of a key to buckets, which are counted and sorted each on its own, so that a key
    with most of the rows is spread like any other. Null keys are equal.
    """
    rows = rows.withColumn("__bucket", F.substring(hashed, 1, DIGITS))
    counts = rows.groupBy(*keys, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(W.partitionBy(*keys).orderBy("__bucket")) - F.col("__n")
    counts = counts.select(*(F.col(k).alias(f"__{k}") for k in keys), F.col("__bucket").alias("__b"), before.alias("__before"))
    own = F.row_number().over(W.partitionBy(*keys, "__bucket").orderBy(hashed, *ties))
    same = F.col("__bucket") == F.col("__b")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    rows = rows.withColumn("__own", own).join(counts, same)
    return rows.withColumn(name, F.col("__before") + F.col("__own")).drop("__bucket", "__b", "__before", "__own", *(f"__{k}" for k in keys))


def checkpoint_root(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir). Only a local master, as in tests, may do without."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        sc = spark.sparkContext
        current = sc._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        if not re.match(r"local(\[[^,\]]*\])?$", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "/tmp/checkpoints/specloom"
    return root


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new, unused path in the application's part of the shared folder, which is deleted when the application ends."""
    sc = spark.sparkContext
    top = f"{checkpoint_root(spark).rstrip('/')}/specloom-{sc.applicationId}"
    if getattr(sc, "_specloom_folder", None) != top:
        path = sc._jvm.org.apache.hadoop.fs.Path(top)
        files = path.getFileSystem(sc._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        sc._specloom_folder = top
    return f"{top}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame, label: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: the lineage ends here and lost executors lose nothing."""
    spark = df.sparkSession
    path = shared_folder(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._specloom_path = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes what cut() wrote for df, which nothing reads any more."""
    sc = df.sparkSession.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(df._specloom_path)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
