"""Sources and sinks: raw CSV, JSON lines, split lists, sidecars, logs, and their Parquet forms."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from specloom.sources import files, quoted_csv

# Columns of the raw file and the names they get.
RAW_COLUMNS = {
    "Filename": "filename",
    "SMILES": "smiles",
    "Page_in_file_mol": "page_mol",
    "Page_in_file_para": "page_para",
    "Location_in_page_mol": "location_mol",
    "Location_in_page_para": "location_para",
    "NMR_type": "nmr_type",
    "NMR_frequency": "frequency",
    "NMR_solvent": "solvent",
    "NMR_processed": "processed",
    "Atom_number": "atom_number",
    "Atom_number_diff_env": "atom_number_diff_env",
    "Atom_number_abstract": "atom_number_abstract",
}
H_TYPE = "struct<frequency:string,solvent:string,peaks:array<struct<shift:double,multiplicity:string,J:array<double>,integration:double,shift_range:array<double>>>>"
SPLIT_ALIASES = {"validation": "val"}


def read_raw_csv(spark: SparkSession, path: str, *, max_rows: int | None = None, row_index: str | None = None, size: int | None = None) -> DataFrame:
    """The raw file's known columns as text, renamed, and row_index: a column that numbers the rows, or their place in the file.

    Quoted cells may hold line ends; a file is read by as many tasks as it has ranges of `size` bytes (see quoted_csv). Only
    ranges with the first max_rows rows are parsed, if rows are numbered by their place.
    """
    columns = RAW_COLUMNS | ({row_index: "given"} if row_index else {})
    rows = quoted_csv.read(spark, path, columns, max_rows=None if row_index else max_rows, size=size or files.RANGE)
    if not row_index:
        return rows
    rows = rows.withColumn("row_index", F.col("given").cast("long")).drop("given")
    return rows if max_rows is None else rows.where(F.col("row_index") < max_rows)


def numbered(rows: DataFrame, name: str = "row_index") -> DataFrame:
    """Rows with a gapless number from 0 in reading order: counts of the partitions before, and the place in its own."""
    rows = rows.withColumn("__m", F.monotonically_increasing_id())
    part, place = F.shiftright("__m", 33), F.col("__m").bitwiseAND((1 << 33) - 1)
    rows = rows.withColumns({"__p": part, "__i": place})
    sizes = rows.groupBy("__p").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("__p", (F.sum("n").over(W.orderBy("__p")) - F.col("n")).alias("before"))
    return rows.join(F.broadcast(before), "__p").withColumn(name, F.col("before") + F.col("__i")).drop("__m", "__p", "__i", "before")  # a row a partition


def read_jsonl(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """JSON lines without the blank ones. A line that isn't JSON stops the job, as it would otherwise be a row of nulls."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    strict = {"mode": "FAILFAST"}
    if schema is None:
        return spark.read.options(**strict).json(path)
    return lines.select(F.from_json("value", schema, strict).alias("r")).select("r.*")


def carbon_shifts(value: Column) -> Column:
    """A 13C shift that is a number or a list, as JSON text, made an array."""
    return F.when(value.startswith("["), F.from_json(value, "array<double>")).otherwise(F.array(value.try_cast("double")))


SAMPLE = f"id string, canonical_smiles string, smiles string, molecular_formula string, `13C_NMR` struct<frequency:string,solvent:string,peaks:array<struct<shift:string>>,data:array<struct<shift:string>>>, `1H_NMR` {H_TYPE}"


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """Nested samples in one shape; 13C peaks may be numbers or lists."""
    rows = read_jsonl(spark, path, SAMPLE)
    c = F.col("13C_NMR")
    peaks = F.transform(F.coalesce(c["peaks"], c["data"]), lambda p: F.struct(carbon_shifts(p["shift"]).alias("shifts")))
    carbon = F.struct(c["frequency"].alias("frequency"), c["solvent"].alias("solvent"), peaks.alias("peaks"))
    return rows.select("id", F.coalesce("canonical_smiles", "smiles").alias("canonical_smiles"), "molecular_formula", carbon.alias("c13_nmr"), F.col("1H_NMR").alias("h1_nmr"))


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_split_ids(spark: SparkSession, folder: str, split: str) -> DataFrame:
    """Ids of a split from its list, which may be in the folder subsets; a missing list is an error."""
    name = f"{SPLIT_ALIASES.get(split, split)}_ids.txt"
    for path in (f"{folder}/{name}", f"{folder}/subsets/{name}"):
        if exists(spark, path):
            return spark.read.text(path).select(F.trim("value").alias("id")).where("id <> ''").distinct()
    raise FileNotFoundError(f"no list of ids for the split {split} in {folder}")


def of_split(samples: DataFrame, ids: DataFrame) -> DataFrame:
    return samples.join(ids, "id", "left_semi")


def last_of(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*(F.desc(c) for c in order)))
    return rows.withColumn("__r", rank).where("__r = 1").drop("__r")


def read_sidecar(spark: SparkSession, path: str) -> DataFrame:
    """id and candidates; rows without either are left out, and of repeated ids the last counts."""
    rows = numbered(read_jsonl(spark, path, "id string, candidates array<string>"), "place").where("trim(id) <> '' and size(candidates) > 0")
    return last_of(rows, ["id"], ["place"]).drop("place")


def write_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def write_split_ids(rows: DataFrame, folder: str) -> None:
    """A folder of ids for each split."""
    rows.select("split", F.col("id").cast("string").alias("value")).write.mode("overwrite").partitionBy("split").text(folder)


def union_logs(frames: list[DataFrame], first: tuple[str, ...] = ("step", "epoch", "loss")) -> DataFrame:
    """Logs with different columns as one: known columns first, the others by name, missing ones null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out.select(*(c for c in first if c in out.columns), *sorted(c for c in out.columns if c not in first))


def load_yaml(path: str | Path) -> dict:
    import yaml

    value = yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}
    if not isinstance(value, dict):
        raise ValueError(f"{path} holds no mapping")
    return value


def load_rules(path: str | Path):
    """A rule library from a YAML file with the keys library_name, h1_shift_regions, c13_shift_regions and fragment_rules."""
    from specloom.operators.rules import Library

    raw = load_yaml(path)
    if not raw.get("library_name"):
        raise ValueError(f"{path} isn't a rule library")
    tail = lambda r: (r["conclusion"], float(r["confidence"]), r["strength"], r["human_tip"])
    region = lambda r: (r["id"], float(r["min_ppm"]), float(r["max_ppm"]), *tail(r))
    peak = lambda s: (float(s["integration"]), tuple(s["multiplicities"]))
    rules = raw.get("fragment_rules", [])
    singles = tuple((r["id"], float(r["integration"]), float(r.get("integration_tolerance", 0.5)), tuple(r["multiplicities"]), r.get("min_ppm"), r.get("max_ppm"), *tail(r)) for r in rules if r["type"] == "single_peak")
    pairs = tuple((r["id"], peak(r["first"]), peak(r["second"]), float(r.get("integration_tolerance", 0.5)), float(r.get("matching_j_tolerance_hz", 0.5)), *tail(r)) for r in rules if r["type"] == "paired_multiplets")
    return Library(raw["library_name"], tuple(map(region, raw.get("h1_shift_regions", []))), tuple(map(region, raw.get("c13_shift_regions", []))), singles, pairs)


def json_safe(value):
    """A value that JSON can hold: sets sorted, tuples as lists, what is unknown as text."""
    if isinstance(value, dict):
        return {str(k): json_safe(v) for k, v in value.items()}
    if isinstance(value, (set, frozenset)):
        return sorted(json_safe(v) for v in value)
    if isinstance(value, (list, tuple)):
        return [json_safe(v) for v in value]
    return value if isinstance(value, (str, int, float, bool, type(None))) else str(value)


def write_report(row: dict, path: str | Path) -> None:
    """A small report as JSON, written whole or not at all."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    part = path.with_suffix(path.suffix + ".part")
    part.write_text(json.dumps(json_safe(row), indent=2, ensure_ascii=False) + "\n", encoding="utf-8")
    part.replace(path)
