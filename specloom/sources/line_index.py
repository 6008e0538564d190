"""Random access to the lines of text files: an index of byte offsets, kept beside the files, and range reads by position."""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specloom.sources import files

#: Lines from one noted offset to the next, and the version of what is written.
EVERY, VERSION = 64, 1
_SCHEMA = "number long, path string, start long, end long, lines long, offsets binary"


def signature(found: list[tuple[str, int, int]], every: int) -> str:
    """What an index is valid for: the paths, sizes and times of change of the files."""
    return hashlib.sha256(json.dumps([VERSION, every, found]).encode()).hexdigest()


def packed(offsets: np.ndarray) -> bytes:
    """Ascending offsets as compressed differences."""
    return zlib.compress(np.diff(offsets, prepend=0).astype("<u8").tobytes(), 6)


def unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(data), "<u8").astype(np.int64))


def lines_of(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the lines that aren't blank."""
    view = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(view == 10)
    if len(view) and (not len(ends) or ends[-1] != len(view) - 1):
        ends = np.append(ends, len(view))
    starts = np.append(0, ends[:-1] + 1) if len(ends) else ends
    shown = np.append(0, np.cumsum(~np.isin(view, [9, 10, 13, 32])))
    kept = shown[ends] > shown[starts]
    return starts[kept], ends[kept]


class LineIndex:
    """The lines of a file or folder by position (from 0, in the order of paths; blank lines have none).

    The index lies in the hidden folder `_offsets` beside the data (or in `folder`), one row for each byte range: how many
    lines start in it, and the offset of every n-th, as differences. It is written whole and then put in its place. One that
    was made for other sizes or times of the files, or for another n, is made anew.
    """

    def __init__(self, spark: SparkSession, path: str, *, every: int = EVERY, size: int = files.RANGE, folder: str | None = None):
        self.spark, self.path, self.every, self.size = spark, path.rstrip("/"), every, size
        self.folder = folder or f"{self.path if '*' not in self.path and files._at(spark, self.path)[1].isDirectory(files._at(spark, self.path)[0]) else self.path.rpartition('/')[0]}/_offsets"
        self.found = files.listed(spark, path)
        self.key = signature(self.found, every)
        self.built = False
        if not self._valid():
            self._build()

    def _valid(self) -> bool:
        try:
            return files.listed(self.spark, f"{self.folder}/key={self.key}") != []
        except FileNotFoundError:
            return False

    def _build(self) -> None:
        every = self.every

        def scan(row: tuple) -> Iterator[pa.RecordBatch]:
            number, name, start, end = row
            with files.opened(name) as f:
                length = f.size()
                a, b = files.line_start(f, start, length), files.line_start(f, end, length)
                starts, _ = lines_of(f.read_at(max(b - a, 0), a))
            values = (number, name, a, b, len(starts), packed(starts[::every]))
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in values], names=[c.split()[0] for c in _SCHEMA.split(", ")])

        rows = files.map_ranges(self.spark, files.ranges(self.found, self.size), "number long, path string, start long, end long", scan, _SCHEMA)
        part = f"{self.folder}.part-{self.key[:16]}"
        rows.coalesce(max(1, len(self.found) // 1000)).write.mode("overwrite").parquet(f"{part}/key={self.key}")
        files.replace_folder(self.spark, part, self.folder)
        self.built = True

    def table(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/key={self.key}")

    def _firsts(self) -> np.ndarray:
        """The position of the first line of each range, and the number of all lines. One number a range."""
        counts = [r.lines for r in self.table().select("number", "lines").orderBy("number").collect()]
        return np.append(0, np.cumsum(counts)).astype(np.int64)

    def __len__(self) -> int:
        return int(self._firsts()[-1])

    def take(self, positions: DataFrame, name: str = "position") -> DataFrame:
        """The lines at positions (a table, repeated ones too): position, line, bytes_read. A position that isn't there is an
        error. The rows of a range meet it by its number; a read begins at the noted offset before the line and ends after
        `every` lines at most; equal and near positions share a read."""
        firsts = self.spark.sparkContext.broadcast(self._firsts())  # a number a range, as many as the driver lists
        every = self.every

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                p = batch.column(0).to_numpy()
                if len(p) and (p.min() < 0 or p.max() >= firsts.value[-1]):
                    raise IndexError(f"positions go from 0 to {int(firsts.value[-1]) - 1}")
                number = np.searchsorted(firsts.value, p, side="right") - 1
                own = p - firsts.value[number]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (p, number, own // every, own % every)], names=["position", "number", "block", "at"])

        def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, source, offsets, data = None, None, None, (-1, None)
            try:
                for batch in batches:
                    out: list[tuple] = []
                    for number, block, at, position, path, start, end, noted in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                        if held != number:
                            if source is not None:
                                source.close()
                            source, offsets, held, data = files.opened(path), np.append(unpacked(noted), end - start), number, (-1, None)
                        read = 0
                        if data[0] != block:
                            a, b = int(offsets[block]), int(offsets[block + 1])
                            body = source.read_at(b - a, start + a)
                            data, read = (block, [body[i:j] for i, j in zip(*lines_of(body), strict=True)]), b - a
                        out.append((position, data[1][at].decode("utf-8", "replace").rstrip("\r"), read))
                    columns = list(zip(*out, strict=True)) or [(), (), ()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.int64()), strict=True)], names=["position", "line", "bytes_read"])
            finally:
                if source is not None:
                    source.close()

        files.ship(self.spark)
        placed = positions.select(F.col(name).cast("long").alias("position")).mapInArrow(place, "position long, number long, block long, at long")
        # the blocks of a range spread its positions, so that a range with most of them isn't one task's
        placed = placed.repartition("number", "block").join(self.table().drop("lines"), "number").select("number", "block", "at", "position", "path", "start", "end", "offsets")
        return placed.repartition("number", "block").sortWithinPartitions("number", "block", "at").mapInArrow(fetch, "position long, line string, bytes_read long")
