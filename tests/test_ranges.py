"""Readers by byte ranges: quoted CSV and the index of lines."""

import csv
import os
import random

import numpy as np
import pytest

from specloom.sources import files, line_index, quoted_csv
from specloom.sources import tables as T


def table(n):
    draw = random.Random(n)
    cells = ["a", "x\ny", '"q"\n\n"', "", "l,\r\nk", '"', " ", 'a"b', "é\n", '""', "\n"]
    return [[f"r{k}", draw.choice(cells) * draw.choice([1, 1, 30]), draw.choice(["", "z", '5"'])] for k in range(n)]


def write(path, rows, header=("A", "B", "C"), end="\n"):
    with open(path, "w", newline="", encoding="utf-8") as f:
        w = csv.writer(f, lineterminator=end)
        w.writerow(header)
        w.writerows(rows)


def expected(rows, first=0):
    return [(*(c or None for c in r), k) for k, r in enumerate(rows, first)]


def by_number(df):
    return sorted(map(tuple, df.collect()), key=lambda r: r[-1])


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("size", [700, files.RANGE])
def test_ranges_give_the_rows_of_the_whole_file(spark, tmp_path, size, end):
    rows = table(400)
    write(tmp_path / "a.csv", rows, end=end)
    got = quoted_csv.read(spark, str(tmp_path / "a.csv"), {"A": "a", "B": "b", "C": "c"}, size=size)
    assert by_number(got) == expected(rows)
    if size == 700:
        assert got.rdd.getNumPartitions() > 5  # tasks follow the ranges
        one = spark.read.options(header=True, multiLine=True, escape='"').csv(str(tmp_path / "a.csv"))
        plain = [k for k, r in enumerate(rows) if "\r" not in r[1] and not r[1].strip(" ") == ""]  # where Spark's reader keeps cells as they are
        if end == "\n":
            whole = [tuple(r) for r in one.collect()]
            assert len(whole) == len(rows) and all(whole[k] == by_number(got)[k][:3] for k in plain)


def test_quotes_inside_cells_blank_lines_and_short_rows(spark, tmp_path):
    body = 'A,B,C\nr0,5" pipe,"x\ny"\n\nr1\n"r2","a""b",say "hi, there\nr3,"","q",extra\n\r\nr4,"open\n\n\nto the end'
    (tmp_path / "a.csv").write_text("﻿" + body, encoding="utf-8", newline="")
    want = [("r0", '5" pipe', "x\ny", 0), ("r1", None, None, 1), ("r2", 'a"b', 'say "hi', 2), ("r3", "", "q", 3), ("r4", "open\n\n\nto the end", None, 4)]
    for size in (7, 1000):
        assert by_number(quoted_csv.read(spark, str(tmp_path / "a.csv"), {"A": "a", "B": "b", "C": "c"}, size=size)) == want


def test_files_of_a_folder_and_pushed_limits(spark, tmp_path, monkeypatch):
    one, two = table(60), table(90)
    write(tmp_path / "1.csv", one)
    write(tmp_path / "2.csv", [r[::-1] for r in two], ("C", "B", "A"))  # another order of columns
    write(tmp_path / "3.csv", [])
    (tmp_path / "4.csv").write_text("")
    (tmp_path / "_hidden.csv").write_text("x")
    got = quoted_csv.read(spark, str(tmp_path), {"C": "c", "A": "a"}, size=500)
    want = [(c, a, k) for a, _, c, k in expected(one) + expected(two, 60)]
    assert by_number(got) == want
    some = quoted_csv.read(spark, str(tmp_path), {"C": "c", "A": "a"}, size=500, max_rows=65)
    assert by_number(some) == want[:65]
    assert some.rdd.getNumPartitions() < got.rdd.getNumPartitions()  # later ranges aren't read again
    with pytest.raises(Exception, match="no column D"):
        quoted_csv.read(spark, str(tmp_path), {"D": "d"}).collect()
    with pytest.raises(FileNotFoundError):
        quoted_csv.read(spark, str(tmp_path / "none*.csv"), {"A": "a"})


def test_states_of_any_piece(spark):
    """The two states of a piece, with and without quotes that don't count, equal those of a walk over its bytes."""
    draw = random.Random(4)
    for _ in range(500):
        text = "".join(draw.choices(['"', "\n", ",", "a"], k=draw.choice([0, 1, 5, 30])))
        for inside in (False, True):
            state, before, closed, ends = inside, "\n", False, []
            for k, c in enumerate(text):
                was, closed = closed, False
                if c == '"' and state:
                    state, closed = False, True
                elif c == '"' and (before in ",\n" or was):
                    state = True
                elif c == "\n" and not state:
                    ends.append(k)
                before = c
            got, end = quoted_csv.outside(np.frombuffer(text.encode(), np.uint8), inside, ord(","))
            assert got.tolist() == ends and end == state


def test_raw_csv_numbers_by_a_column(spark, tmp_path):
    names = [*T.RAW_COLUMNS, "n"]
    write(tmp_path / "raw.csv", [[f"f{i}", "C\nC", *["x"] * (len(names) - 3), 9 - i] for i in range(10)], names)
    rows = T.read_raw_csv(spark, str(tmp_path / "raw.csv"), row_index="n", max_rows=3, size=100)
    assert sorted((r.row_index, r.filename) for r in rows.collect()) == [(0, "f9"), (1, "f8"), (2, "f7")]


@pytest.fixture()
def lines(tmp_path):
    draw = random.Random(7)
    texts = [f"{k}:" + "é" * draw.choice([0, 1, 40]) for k in range(1000)]
    folder = tmp_path / "data"
    folder.mkdir()
    for k in range(3):
        body = "\n".join(t + draw.choice(["", "", "\n", "\n  \n", "\r"]) for t in texts[k * 300 : (k + 1) * 300 if k < 2 else 1000])
        (folder / f"part-{k}").write_text(body, encoding="utf-8", newline="")
    return folder, texts


def test_lines_by_position(spark, lines):
    folder, texts = lines
    index = line_index.LineIndex(spark, str(folder), every=16, size=2_000)
    assert index.built and len(index) == 1000
    wanted = [0, 999, 5, 5, 299, 300, *range(400, 420)]
    got = index.take(spark.createDataFrame([(p,) for p in wanted], "position long")).collect()
    assert sorted((r.position, r.line) for r in got) == sorted((p, texts[p]) for p in wanted)
    # a read goes from one noted offset to the next, and equal positions share it
    most = max(len((t + "\n  \n").encode()) for t in texts) * 16
    assert max(r.bytes_read for r in got) <= most and sum(r.bytes_read > 0 for r in got) < len(wanted) / 2
    assert sum(f.stat().st_size for f in (folder / "_offsets").rglob("*.parquet")) < sum(f.stat().st_size for f in folder.glob("part-*"))
    with pytest.raises(Exception, match="positions go from"):
        index.take(spark.createDataFrame([(1000,)], "position long")).collect()


def test_an_index_is_used_again_until_a_file_changes(spark, lines):
    folder, texts = lines
    assert line_index.LineIndex(spark, str(folder), size=2_000).built
    again = line_index.LineIndex(spark, str(folder), size=2_000)
    assert not again.built and len(again) == 1000
    assert line_index.LineIndex(spark, str(folder), size=2_000, every=8).built
    with open(folder / "part-0", "a", encoding="utf-8") as f:
        f.write("\nnew")
    changed = line_index.LineIndex(spark, str(folder), size=2_000)
    assert changed.built and len(changed) == 1001
    got = changed.take(spark.createDataFrame([(300,), (301,)], "position long")).collect()
    assert {r.position: r.line for r in got} == {300: "new", 301: texts[300]}
    size, when = os.path.getsize(folder / "part-1"), os.stat(folder / "part-1").st_mtime
    os.utime(folder / "part-1", (when + 60, when + 60))
    assert os.path.getsize(folder / "part-1") == size and line_index.LineIndex(spark, str(folder), size=2_000).built


def test_an_unfinished_index_is_never_seen(spark, lines, monkeypatch):
    folder, _ = lines

    def fails(*_):
        raise OSError("no room")

    monkeypatch.setattr(files, "replace_folder", fails)
    with pytest.raises(OSError, match="no room"):
        line_index.LineIndex(spark, str(folder), size=2_000)
    monkeypatch.undo()
    assert line_index.LineIndex(spark, str(folder), size=2_000).built


def test_one_file_and_no_lines(spark, tmp_path):
    (tmp_path / "s.jsonl").write_text('{"id": 1}\n\n{"id": 2}')
    index = line_index.LineIndex(spark, str(tmp_path / "s.jsonl"))
    assert (tmp_path / "_offsets").is_dir()
    assert [r.line for r in index.take(spark.createDataFrame([(1,)], "position long")).collect()] == ['{"id": 2}']
    (tmp_path / "e").mkdir()
    (tmp_path / "e/x").write_text("\n \n")
    assert len(line_index.LineIndex(spark, str(tmp_path / "e"))) == 0
