"""Helpers that all training-data operators share: tables, the shared folder, shipping code, worker caches."""

from __future__ import annotations

import os
import sys
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

import specloom
from specloom.operators.order import cut, discard, shared_folder  # noqa: F401  the operators' helpers


def ship(spark: SparkSession) -> None:
    """Gives this package to the executors' Python workers, once a context; Spark's driver serves the archive."""
    sc = spark.sparkContext
    if getattr(sc, "_specloom_shipped", False):
        return
    top = Path(specloom.__file__).resolve().parent
    archive = Path(os.path.realpath(tempfile.mkdtemp())) / "specloom.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f.relative_to(top.parent))
    sc.addPyFile(str(archive))
    sc._specloom_shipped = True


def arrow_map(df: DataFrame, run, schema: str) -> DataFrame:
    """df.mapInArrow, where run may use this package."""
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def by_group(df: DataFrame, keys: list[str], run: Callable, schema: str) -> DataFrame:
    """Applies run to the Arrow table of each group; groups must be small. One sort, and one Python call for many groups."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(k) for k in range(len(keys))]
            values = list(zip(*(c.to_pylist() for c in columns), strict=True))
            a = 0
            for b in range(batch.num_rows + 1):
                if b == batch.num_rows:
                    rest.append(batch.slice(a, b - a))
                    last = values[-1]
                elif values[b] != (values[b - 1] if b else last):
                    if b > a:
                        rest.append(batch.slice(a, b - a))
                    if rest:
                        yield from run(pa.Table.from_batches(rest))
                    rest, a = [], b
        if rest:
            yield from run(pa.Table.from_batches(rest))

    rows = df.select(*keys, *(c for c in df.columns if c not in keys)).repartition(*keys).sortWithinPartitions(*keys)
    return arrow_map(rows, stream, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, by any path that Spark's readers can open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def worker_cache(name: str) -> dict:
    """A dict that lives as long as the Python worker, whatever tasks it runs."""
    return sys.modules["pyspark"].__dict__.setdefault("_specloom_cache", {}).setdefault(name, {})


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme of the file system that it belongs to."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString()


def file_system(path: str):
    """pyarrow's file system for a qualified path, and the path in it. For Python workers.

    Archives and indexes are read by range, which Spark's readers don't offer, so the shared folder must be one that pyarrow
    opens as well: a mounted folder (file), hdfs, s3 (s3a is the same store) or gs. Any other scheme raises.
    """
    from pyarrow import fs

    scheme, _, rest = path.partition(":")
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return fs.FileSystem.from_uri(f"{ {'s3a': 's3', 's3n': 's3'}.get(scheme, scheme) }:{rest}")


def vocabulary_bytes(spark: SparkSession, path: str):
    """The bytes of a vocabulary file, read by the driver and broadcast, so that workers need no such path."""
    return spark.sparkContext.broadcast(Path(path).read_bytes())
