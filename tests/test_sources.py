import pytest
from pyspark.sql import functions as F

from specloom.sources import tables as T


def test_raw_csv_and_row_numbers(spark, tmp_path):
    names = list(T.RAW_COLUMNS)
    lines = [",".join(names)] + [",".join([f"f{i}", "CCO", *["x"] * (len(names) - 2)]) for i in range(50)]
    (tmp_path / "raw.csv").write_text("\n".join(lines) + "\n")
    rows = T.read_raw_csv(spark, str(tmp_path / "raw.csv"))
    assert [(r.filename, r.row_index) for r in rows.orderBy("row_index").collect()] == [(f"f{i}", i) for i in range(50)]
    assert T.read_raw_csv(spark, str(tmp_path / "raw.csv"), max_rows=7).count() == 7


def test_samples_splits_and_sidecars(spark, tmp_path):
    (tmp_path / "s.jsonl").write_text(
        '{"id":"a","canonical_smiles":"CCO","13C_NMR":{"solvent":"CDCl3","peaks":[{"shift":58.1},{"shift":[18.2,19.0]}]},"1H_NMR":{"peaks":[]}}\n\n{"id":"b","smiles":"C","13C_NMR":{"data":[{"shift":1}]}}\n'
    )
    rows = {r.id: r for r in T.read_samples(spark, str(tmp_path / "s.jsonl")).collect()}
    assert [p.shifts for p in rows["a"].c13_nmr.peaks] == [[58.1], [18.2, 19.0]] and rows["b"].canonical_smiles == "C"
    (tmp_path / "subsets").mkdir()
    (tmp_path / "subsets/val_ids.txt").write_text("a\n\n b \n")
    ids = T.read_split_ids(spark, str(tmp_path), "validation")
    assert T.of_split(T.read_samples(spark, str(tmp_path / "s.jsonl")), ids).count() == 2
    with pytest.raises(FileNotFoundError):
        T.read_split_ids(spark, str(tmp_path), "train")
    (tmp_path / "c.jsonl").write_text('{"id":"a","candidates":["x"]}\n{"id":"","candidates":["x"]}\n{"id":"b","candidates":[]}\n{"id":"a","candidates":["y"]}\n')
    assert [tuple(r) for r in T.read_sidecar(spark, str(tmp_path / "c.jsonl")).collect()] == [("a", ["y"])]


def test_sinks_and_logs(spark, tmp_path):
    rows = spark.createDataFrame([("a", "train", None), ("b", "val", "x")], "id string, split string, v string")
    T.write_jsonl(rows, str(tmp_path / "j"))
    assert T.read_jsonl(spark, str(tmp_path / "j"), "id string, v string").count() == 2
    T.write_csv(rows, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 2
    T.write_split_ids(rows, str(tmp_path / "i"))
    assert spark.read.text(str(tmp_path / "i")).where(F.col("split") == "val").first()[0] == "b"
    log = T.union_logs([spark.createDataFrame([(1, 0.5)], "step int, loss double"), spark.createDataFrame([(2, 0.1)], "step int, lr double")])
    assert log.columns == ["step", "loss", "lr"] and log.count() == 2
    T.write_report({"b": {2, 1}, "a": (1,)}, tmp_path / "r.json")
    assert '"b": [\n    1,' in (tmp_path / "r.json").read_text()


def test_quoted_newlines_stay_in_their_cell(spark, tmp_path):
    names = list(T.RAW_COLUMNS)
    rest = ["x"] * (len(names) - 2)
    (tmp_path / "raw.csv").write_text("\n".join([",".join(names), ",".join(["f0", '"C\nC"', *rest]), ",".join(["f1", '"say ""C"""', *rest])]) + "\n")
    rows = T.read_raw_csv(spark, str(tmp_path / "raw.csv"))
    assert [(r.filename, r.smiles, r.row_index) for r in rows.orderBy("row_index").collect()] == [("f0", "C\nC", 0), ("f1", 'say "C"', 1)]


@pytest.mark.parametrize("schema", ["id string, v int", None])
def test_a_malformed_json_line_stops_the_job(spark, tmp_path, schema):
    (tmp_path / "a.jsonl").write_text('{"id":"a","v":1}\n\n{"id":"b"}\n')
    assert sorted((r.id, r.v) for r in T.read_jsonl(spark, str(tmp_path / "a.jsonl"), schema).collect()) == [("a", 1), ("b", None)]
    (tmp_path / "a.jsonl").write_text('{"id":"a","v":1}\n{"id":\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        T.read_jsonl(spark, str(tmp_path / "a.jsonl"), schema).collect()
