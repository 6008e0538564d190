"""Byte ranges of files, which tasks read on their own: listing on the driver, range reads in Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

import specloom

#: Bytes of a range, and bytes that are read at once where the end of a line is looked for.
RANGE, STEP = 32 << 20, 1 << 16


def ship(spark: SparkSession) -> None:
    """Gives this package to the executors' Python workers, once a context."""
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


def _at(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def listed(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """Qualified path, size and time of change of a file, or of the files of a folder or pattern, by path. Hidden ones don't count."""
    p, files = _at(spark, path)
    found = []
    for top in files.globStatus(p) or []:
        for s in files.listStatus(top.getPath()) if top.isDirectory() else [top]:
            if not s.isDirectory() and s.getPath().getName()[0] not in "_.":
                found.append((files.makeQualified(s.getPath()).toString(), s.getLen(), s.getModificationTime()))
    if not found:
        raise FileNotFoundError(f"no file at {path}")
    return sorted(found)


def replace_folder(spark: SparkSession, new: str, path: str) -> None:
    """Puts a finished folder in the place of another. Readers find the old one, none, or the new one, never a part."""
    p, files = _at(spark, path)
    files.delete(p, True)
    if not files.rename(_at(spark, new)[0], p):
        raise OSError(f"{new} can't become {path}")


def file_system(path: str):
    """pyarrow's file system for a qualified path, and the path in it. Schemes that both it and Spark know: file, hdfs, s3, gs."""
    from pyarrow import fs

    scheme, _, rest = path.partition(":")
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return fs.FileSystem.from_uri(f"{ {'s3a': 's3', 's3n': 's3'}.get(scheme, scheme) }:{rest}")


def opened(path: str) -> pa.NativeFile:
    """A qualified path, opened for reads at any place."""
    system, inner = file_system(path)
    return system.open_input_file(inner)


def made_folder(spark: SparkSession, path: str) -> str:
    """The qualified path of a folder, which is made if it isn't there."""
    p, system = _at(spark, path)
    system.mkdirs(p)
    return system.makeQualified(p).toString()


def ranges(found: list[tuple[str, int, int]], size: int = RANGE) -> list[tuple[int, str, int, int]]:
    """Number, path, start and end of the ranges of files; an empty file has one."""
    every = [(path, a, min(a + size, length)) for path, length, _ in found for a in range(0, max(length, 1), size)]
    return [(k, *r) for k, r in enumerate(every)]


def line_start(f: pa.NativeFile, at: int, length: int) -> int:
    """The first place from `at` on where a physical line starts, or the length."""
    if at <= 0:
        return 0
    at -= 1
    while at < length:
        step = f.read_at(min(STEP, length - at), at)
        k = step.find(b"\n")
        if k >= 0:
            return at + k + 1
        at += len(step)
    return length


def map_ranges(spark: SparkSession, rows: list[tuple], schema: str, run: Callable[[tuple], Iterator[pa.RecordBatch]], out: str) -> DataFrame:
    """What run makes of each row, a task for each as far as there are not thousands. The rows are a list of ranges."""
    ship(spark)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield from run(row)

    df = spark.createDataFrame(rows, schema)
    return df.repartition(max(1, min(len(rows), 10_000)), df.columns[0]).mapInArrow(stream, out)
