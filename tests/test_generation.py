"""Resumable runs: a ledger of finished prompts, failures as rows."""

import os

import pytest
from pyspark.sql import functions as F

from specloom.operators import generation


def counted(path, breaks_at=None):
    """A generator that notes each call in a file, fails on some prompts, and ends the process's task on one."""

    def load():
        def answer(prompt, seed, n):
            if breaks_at is not None and prompt == breaks_at and not os.path.exists(f"{path}.mended"):
                raise SystemExit("the machine is gone")
            with open(path, "a", encoding="utf-8") as f:
                f.write(f"{prompt} {seed}\n")
            if prompt.endswith("3"):
                raise ValueError("no answer")
            return [(f"{prompt}/{k}", [1] * (seed % 3) + [0]) for k in range(n)]

        return answer

    return load


def prompts(spark, n):
    return spark.range(n).select(F.when(F.col("id") != 1, F.concat(F.lit("i"), (F.col("id") % 5).cast("string"))).alias("id"), F.col("id").alias("index"), F.concat(F.lit("p"), F.col("id").cast("string")).alias("prompt"))


def calls(path):
    return sorted(path.read_text().split("\n")[:-1]) if path.exists() else []


def test_answers_seeds_and_failures(spark, tmp_path):
    log = tmp_path / "calls"
    rows = prompts(spark, 40).unionByName(spark.createDataFrame([("x", 99, None)], "id string, index long, prompt string"))
    got = {r["index"]: r for r in generation.generate(rows, counted(log), str(tmp_path / "ledger"), seed=7, samples=2).collect()}
    assert len(got) == 41 and got[1].id is None and got[4].seed == 11
    assert [o.text for o in got[4].outputs] == ["p4/0", "p4/1"] and got[99].outputs[0].text == "/0"
    assert got[13].error == "ValueError: no answer" and got[13].outputs == [] and sum(r.error is not None for r in got.values()) == 4
    assert len(calls(log)) == len(set(calls(log))) == 41
    # again: nothing is generated; more prompts: only the new ones; another seed is another run
    again = generation.generate(rows, counted(log), str(tmp_path / "ledger"), seed=7, samples=2)
    assert again.count() == 41 and len(calls(log)) == 41
    more = generation.generate(prompts(spark, 45), counted(log), str(tmp_path / "ledger"), seed=7, samples=2)
    assert more.count() == 45 and len(calls(log)) == 46  # 99 isn't asked for and stays in the ledger
    generation.generate(prompts(spark, 3), counted(log), str(tmp_path / "ledger"), seed=8, samples=2)
    assert len(calls(log)) == 49
    assert generation.generate(prompts(spark, 0), counted(log), str(tmp_path / "none"), seed=7).collect() == []


def test_a_broken_run_goes_on_where_it_was(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(generation, "CHUNK", 4)
    monkeypatch.setattr(generation, "TASK", 16)
    log, place = tmp_path / "calls", str(tmp_path / "ledger")
    rows = prompts(spark, 60)
    with pytest.raises(Exception):  # noqa: B017  whatever Spark makes of a worker that ends
        generation.generate(rows, counted(log, breaks_at="p37"), place, seed=1).collect()
    first = calls(log)
    kept = generation.ledger(rows, f"{place}/seed=1/samples=1").count()
    assert 0 < len(first) < 60 and 0 < kept <= len(first)
    (tmp_path / "calls.mended").write_text("")
    got = generation.generate(rows, counted(log, breaks_at="p37"), place, seed=1)
    assert sorted(r["index"] for r in got.collect()) == list(range(60))
    every = calls(log)
    assert set(every) == {f"p{k} {k + 1}" for k in range(60)}
    # only the prompts of the files that were not finished are asked again
    assert len(every) - len(first) == 60 - kept and len(every) - 60 <= 4 * 4
    assert not list((tmp_path / "ledger").rglob(".*.parquet"))


def test_the_ledger_has_whole_files_only(spark, tmp_path, monkeypatch):
    place = tmp_path / "ledger" / "seed=1" / "samples=1"
    place.mkdir(parents=True)
    (place / ".abc.parquet").write_bytes(b"a part")
    assert generation.generate(prompts(spark, 5), counted(tmp_path / "calls"), str(tmp_path / "ledger"), seed=1).count() == 5


def test_summaries_of_runs(spark, tmp_path):
    from specloom.plans import generation as plans

    rows = prompts(spark, 26).select("id", "index", F.concat(F.lit("order "), F.col("index").cast("string")).alias("prompt"), F.lit("C").alias("reference"))
    direct = generation.direct_run(rows, plans.chains, str(tmp_path / "d"), seed=0, eos=0, max_new=6, max_samples=20)
    assert direct.count() == 20 and {r["index"] for r in direct.where("failed").collect()} == {0, 13}
    facts = plans._facts(spark)
    full = facts.withColumn("canonical", F.col("smiles")).withColumns({n: F.lit(0) for n in ("components", "charge", "radicals")}).withColumns({"stereo": F.lit(False), "elements_ok": F.lit(True), "ring_scaffold": F.lit("")})
    full = full.withColumns({"groups": F.array().cast("array<string>"), "bits2048": F.array(F.length("smiles"))})
    report = generation.direct_summary(direct, full).collect()
    assert len(report) == 1 and report[0].num_examples == 20 and report[0].generation_errors == 2
    assert report[0].valid_smiles == 18 / 20 and report[0].exact_match == sum(k % 7 == 0 and k % 13 != 0 for k in range(20)) / 20
    more = rows.withColumns({"wanted": F.when(F.col("index") % 2 == 0, F.lit("C3H8")), "body": F.lit(""), "exact": F.lit("CCC"), "connectivity": F.lit("CCC"), "support": F.lit(None).cast("map<string,double>")})
    found = generation.constrained_run(more, plans.chains, str(tmp_path / "c"), facts, seed=0, candidates=7, eos=0, max_new=6)
    by = {r["index"]: r for r in found.collect()}
    assert len(by) == 26 and by[13].prediction == "" and by[13].raw_count == 0
    assert by[2].prediction == "CCC" and by[2].formula_valid == ["CCC"] and not by[2].ranking_attempted
    assert by[3].prediction == "CCCC" and by[3].ranking_attempted and not by[3].ranking_failed  # the answer of seed 3
    report = generation.constrained_report(found).first()
    assert report.num_examples == 26 and report.generation_errors == 2 and report.candidate_oracle_exact == 24 / 26


def test_files_follow_time_and_not_prompts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(generation, "TASK", 200)
    assert generation.generate(prompts(spark, 800), counted(tmp_path / "calls"), str(tmp_path / "quick"), seed=1).count() == 800
    assert len(list((tmp_path / "quick").rglob("*.parquet"))) == 4  # one a task
    monkeypatch.setattr(generation, "SECONDS", 0.0)
    assert generation.generate(prompts(spark, 800), counted(tmp_path / "more"), str(tmp_path / "slow"), seed=1).count() == 800
    assert len(list((tmp_path / "slow").rglob("*.parquet"))) >= 800 // 16
    monkeypatch.setattr(generation, "LARGEST_TASK", 100)
    monkeypatch.setattr(generation, "SIZE", 1)
    assert generation.generate(prompts(spark, 50), counted(tmp_path / "long"), str(tmp_path / "large"), seed=1).count() == 50
    assert len(list((tmp_path / "large").rglob("*.parquet"))) >= 45  # each answer is large enough for a file; failures are not, and wait for the next


def test_places_that_a_task_has_written(tmp_path):
    from pyarrow import fs

    for name in ("m-1-0-16.parquet", "m-1-20-33.parquet", "m-11-0-5.parquet", ".x.m-1-33-40.parquet", "n-1-50-60.parquet"):
        (tmp_path / name).write_bytes(b"")
    assert sorted(generation._written(fs.LocalFileSystem(), str(tmp_path), "m-1")) == [(0, 16), (20, 33)]
