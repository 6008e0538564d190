"""CSV whose quoted cells may hold line ends, read by as many tasks as there are byte ranges.

A range can't know whether it begins inside a quoted cell. So a first pass follows it from both states and notes the state at
its end, how many records start in it and where the first does; the states of all ranges follow one from another, and with
them each range knows its records and their numbers. The second pass parses.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from specloom.sources import files

#: Rows of a batch that goes to Spark.
BATCH = 5_000
_QUOTE, _END, _RETURN = ord('"'), ord("\n"), ord("\r")


def outside(data: np.ndarray, inside: bool, delimiter: int) -> tuple[np.ndarray, bool]:
    """Which line ends of the bytes lie outside quoted cells, and whether the end of the bytes lies inside one.

    The bytes start a line. A quote opens a cell at the cell's start, or goes on with it right after a closing quote; in the
    middle of a cell that isn't quoted it is a sign like others.
    """
    quotes, ends = np.flatnonzero(data == _QUOTE), np.flatnonzero(data == _END)
    before = np.where(quotes > 0, data[quotes - 1], _END) if len(quotes) else quotes
    starts = (before == delimiter) | (before == _END) | (before == _RETURN)
    follows = np.append(False, np.diff(quotes) == 1) if len(quotes) else starts
    opening = np.arange(len(quotes)) % 2 == int(inside)
    if (starts | follows)[opening].all():  # every quote counts
        return ends[(np.searchsorted(quotes, ends) % 2 == 1) == inside], inside ^ bool(len(quotes) % 2)
    counts, closed = np.zeros(len(quotes), bool), -2
    state = inside
    for k, (place, start) in enumerate(zip(quotes.tolist(), starts.tolist(), strict=True)):
        if state:
            state, closed, counts[k] = False, place, True
        elif start or closed == place - 1:
            state = counts[k] = True
    quotes = quotes[counts]
    return ends[(np.searchsorted(quotes, ends) % 2 == 1) == inside], state


def _records(data: np.ndarray, inside: bool, delimiter: int) -> tuple[np.ndarray, bool]:
    """Where records start that aren't blank lines, and the state at the end."""
    ends, state = outside(data, inside, delimiter)
    starts = ends + 1 if inside else np.append(0, ends + 1)
    starts = starts[starts < len(data)]
    sign = data[starts]
    follows = data[np.minimum(starts + 1, len(data) - 1)] if len(data) else sign
    return starts[(sign != _END) & ~((sign == _RETURN) & (follows == _END))], state


def plan(spark: SparkSession, path: str, *, size: int = files.RANGE, delimiter: str = ",") -> list[tuple]:
    """The ranges that have records: number, path, place of the first record, end, number of the first record in the table,
    and the header of the file, which is its first record. One row a range comes to the driver, none of the file's rows."""
    found = files.listed(spark, path)
    mark = ord(delimiter)

    def scan(row: tuple) -> Iterator[pa.RecordBatch]:
        number, name, start, end = row
        with files.opened(name) as f:
            length = f.size()
            a, b = files.line_start(f, start, length), files.line_start(f, end, length)
            data = np.frombuffer(f.read_at(max(b - a, 0), a), np.uint8)
        out = [number, name, a, b]
        for inside in (False, True):
            starts, state = _records(data, inside, mark)
            out += [len(starts), a + int(starts[0]) if len(starts) else b, state]
        header = b""
        if start == 0 and out[4]:
            starts, _ = _records(data, False, mark)
            header = data[starts[0] : starts[1] if len(starts) > 1 else len(data)].tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*out, header)], names=_NAMES)

    schema = "number long, path string, start long, end long"
    rows = files.map_ranges(spark, files.ranges(found, size), schema, scan, _SCANNED).collect()
    out, total = [], 0
    inside, header, last = False, b"", None
    for r in sorted(rows):
        if r.path != last:
            inside, header, last = False, r.header, r.path
            skip = 1
        n, first, state = (r.n_in, r.first_in, r.state_in) if inside else (r.n_out, r.first_out, r.state_out)
        if n:
            out.append((r.number, r.path, first, r.end, total, skip, bytes(header)))
            total += n - skip
            skip = 0
        inside = state
    return out


_NAMES = ["number", "path", "start", "end", "n_out", "first_out", "state_out", "n_in", "first_in", "state_in", "header"]
_SCANNED = "number long, path string, start long, end long, n_out long, first_out long, state_out boolean, n_in long, first_in long, state_in boolean, header binary"


def _text(f: pa.NativeFile, begin: int, end: int, delimiter: int) -> str:
    """The records that start from begin to end, the last one whole."""
    length = f.size()
    data = f.read_at(end - begin, begin)
    _, inside = outside(np.frombuffer(data, np.uint8), False, delimiter)
    parts = [data]
    while inside and end < length:  # lines are read until one ends outside
        stop = files.line_start(f, end + 1, length)
        line = f.read_at(stop - end, end)
        # a line that starts inside a cell: its line ends outside quoted cells end the record
        ends, inside = outside(np.frombuffer(line, np.uint8), True, delimiter)
        parts.append(line)
        end = stop
    return b"".join(parts).decode("utf-8", "replace")


def _parsed(text: str, delimiter: str) -> Iterator[list]:
    return (r for r in csv.reader(io.StringIO(text, newline=""), delimiter=delimiter, quoting=csv.QUOTE_NOTNULL) if r)


def read(spark: SparkSession, path: str, columns: dict[str, str], *, max_rows: int | None = None, size: int = files.RANGE, delimiter: str = ",") -> DataFrame:
    """The named columns of CSV files with headers as text, renamed, and row_index (from 0, in the order of paths and rows).

    Cells may be quoted, hold doubled quotes and line ends (\\n or \\r\\n); an empty cell without quotes is null, a short row
    ends in nulls, surplus cells and blank lines don't count, and a sign that isn't UTF-8 is replaced. A file without one of
    the columns is an error. Only the ranges that hold the first max_rows rows are parsed. Ranges are followed twice.
    """
    csv.field_size_limit(1 << 30)
    rows = [r for r in plan(spark, path, size=size, delimiter=delimiter) if max_rows is None or r[4] < max_rows]
    names, mark = list(columns), ord(delimiter)

    def run(row: tuple) -> Iterator[pa.RecordBatch]:
        _, name, begin, end, first, skip, header = row
        csv.field_size_limit(1 << 30)
        given = next(_parsed(header.decode("utf-8", "replace").removeprefix("﻿"), delimiter))
        missing = [n for n in names if n not in given]
        if missing:
            raise ValueError(f"{name} has no column {', '.join(missing)}")
        at = [given.index(n) for n in names]
        with files.opened(name) as f:
            text = _text(f, begin, end, mark)
        held: list[list] = []

        def batch() -> pa.RecordBatch:
            nonlocal first
            cells = [pa.array([r[i] if i < len(r) else None for r in held], pa.string()) for i in at]
            number = pa.array(np.arange(first, first + len(held)), pa.int64())
            first += len(held)
            held.clear()
            return pa.RecordBatch.from_arrays([*cells, number], names=[*columns.values(), "row_index"])

        for k, record in enumerate(_parsed(text, delimiter)):
            if k < skip:
                continue
            if max_rows is not None and first + len(held) >= max_rows:
                break
            held.append(record)
            if len(held) == BATCH:
                yield batch()
        if held:
            yield batch()

    out = ", ".join([*(f"`{c}` string" for c in columns.values()), "row_index long"])
    if not rows:
        return spark.createDataFrame([], out)
    return files.map_ranges(spark, rows, "number long, path string, begin long, end long, first long, skip int, header binary", run, out)
