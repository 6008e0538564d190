"""Runs of a generator over prompts that can be broken off and gone on with, and the two evaluations that rest on them.

What a generator gave is kept in a ledger, a folder of Parquet files in the shared file system. Each file is written under a
hidden name and then renamed, so the ledger holds whole files only; a run that starts again does what isn't there.
"""

from __future__ import annotations

import math
import time
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specloom.functions import outputs
from specloom.operators import evaluate, order, tasks
from specloom.sources import files

#: From a prompt, a seed and a number of answers to that many answers: text, and tokens with the end token if it came.
Generator = Callable[[str, int, int], list[tuple[str, list[int]]]]
#: Prompts after which a file of the ledger may end, and prompts of a task. A file goes on until it took SECONDS or holds SIZE
#: signs and tokens, so that slow generators lose few answers when a task ends, and the files of quick ones are few.
CHUNK, TASK, SECONDS, SIZE = 16, 1024, 5.0, 8_000_000
#: Tasks grow up to so many prompts once there are WAVES tasks for each core.
LARGEST_TASK, WAVES = 32_768, 4
LEDGER = "id string, index long, seed long, outputs array<struct<text: string, tokens: array<int>>>, error string"
_TYPE = pa.schema(
    [("id", pa.string()), ("index", pa.int64()), ("seed", pa.int64()), ("outputs", pa.list_(pa.struct([("text", pa.string()), ("tokens", pa.list_(pa.int32()))]))), ("error", pa.string())]
)


def ledger(rows: DataFrame, folder: str) -> DataFrame:
    """What a folder holds: one row for each finished pair of id and index. A pair that two attempts of a task finished in
    different files counts once."""
    found = rows.sparkSession.read.schema(LEDGER).parquet(folder)
    return found.dropDuplicates(["id", "index"])


def generate(rows: DataFrame, generator: Callable[[], Generator], folder: str, *, seed: int, samples: int = 1) -> DataFrame:
    """Answers to prompts: id, index, seed, outputs, error. rows: id, index (a number of the row's own), prompt.

    `generator` is called once a task and loads what it needs. A prompt's seed is seed + index, so that its answers depend on
    neither tasks nor order. A prompt whose generation fails is a row with an error and no outputs, and stops nothing; it is
    finished too. Pairs that the ledger in the folder has are not generated again: neither by a run that starts again nor by
    a task that is tried again, which finds the files of its first try. A null prompt is empty; null ids are ids.
    """
    spark = rows.sparkSession
    place = files.made_folder(spark, f"{folder.rstrip('/')}/seed={seed}/samples={samples}")
    done = ledger(rows, place).select(F.col("id").alias("__id"), F.col("index").alias("__index"))
    todo = rows.select(F.col("id").cast("string").alias("id"), F.col("index").cast("long").alias("index"), F.coalesce("prompt", F.lit("")).alias("prompt"))
    todo = todo.join(done, F.col("id").eqNullSafe(F.col("__id")) & (F.col("index") == F.col("__index")), "left_anti")
    todo = order.cut(todo, "prompts")  # tasks that are tried again see the same rows
    n = todo.count()
    if n:
        files.ship(spark)
        mark = uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            system, inner = files.file_system(place)
            own = f"{mark}-{TaskContext.get().partitionId()}"
            known = _written(system, inner, own)
            answer, held, size, at, made, began = None, [], 0, 0, 0, time.monotonic()

            def save() -> None:
                if held:
                    _write(system, f"{inner}/{own}-{at - len(held)}-{at}.parquet", held)
                    held.clear()

            try:
                for batch in batches:
                    for name, index, prompt in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                        if any(a <= at < b for a, b in known):
                            save()
                            at += 1
                            continue
                        answer = answer or generator()
                        if not held:
                            size, began = 0, time.monotonic()
                        row = _answered(answer, name, index, prompt, seed + index, samples)
                        held.append(row)
                        at, made = at + 1, made + 1
                        size += sum(len(x["text"] or "") + len(x["tokens"]) for x in row["outputs"])
                        if size >= SIZE or len(held) >= CHUNK and time.monotonic() - began >= SECONDS:
                            save()
            finally:
                save()  # what is finished stays, also if the task fails
            yield pa.RecordBatch.from_arrays([pa.array([made])], names=["made"])

        least = WAVES * spark.sparkContext.defaultParallelism
        parts = max(math.ceil(n / LARGEST_TASK), min(math.ceil(n / TASK), least))
        spread = todo.select("id", "index", "prompt").repartition(parts, "index").sortWithinPartitions("index", "id", "prompt")
        spread.mapInArrow(run, "made long").agg(F.sum("made")).collect()
    order.discard(todo)
    wanted = rows.select(F.col("id").cast("string").alias("__id"), F.col("index").cast("long").alias("__index"))
    found = ledger(rows, place).join(wanted, F.col("id").eqNullSafe(F.col("__id")) & (F.col("index") == F.col("__index")), "left_semi")
    return found.select("id", "index", "seed", "outputs", "error")


def _written(system, folder: str, own: str) -> list[tuple[int, int]]:
    """Places of a task's rows that an earlier attempt of it has written."""
    names = [f.base_name for f in system.get_file_info(fs.FileSelector(folder)) if f.base_name.startswith(f"{own}-")]
    return [tuple(map(int, x.removesuffix(".parquet").split("-")[-2:])) for x in names]


def _answered(answer: Generator, name: str | None, index: int, prompt: str, seed: int, samples: int) -> dict:
    row = {"id": name, "index": index, "seed": seed, "outputs": [], "error": None}
    try:
        found = answer(prompt, seed, samples)
        row["outputs"] = [{"text": text, "tokens": list(tokens)} for text, tokens in found]
    except Exception as failure:  # one prompt's failure is a row, whatever it is
        row["error"] = f"{type(failure).__name__}: {failure}"
    return row


def _write(system, name: str, rows: list[dict]) -> None:
    import pyarrow.parquet as pq

    folder, _, last = name.rpartition("/")
    part = f"{folder}/.{uuid.uuid4().hex}.{last}"
    pq.write_table(pa.Table.from_pylist(rows, schema=_TYPE), part, filesystem=system)
    system.move(part, name)


def _one_row(*frames: DataFrame) -> DataFrame:
    """Tables of one row each, side by side."""
    out = frames[0].withColumn("__one", F.lit(1))
    for f in frames[1:]:
        out = out.join(f.withColumn("__one", F.lit(1)), "__one")
    return out.drop("__one")


def first_answers(found: DataFrame, *, eos: int, max_new: int) -> DataFrame:
    """id, index, seed, prediction, failed, and the trace of the first answer; an answer that failed is empty in all."""
    first = F.get("outputs", F.lit(0))
    rows = found.withColumns({"prediction": F.coalesce(first["text"], F.lit("")), "tokens": F.coalesce(first["tokens"], F.array().cast("array<int>"))})
    names = ("generated_tokens", "ended", "truncated", "repeated")
    return rows.select("id", "index", "seed", "prediction", F.col("error").isNotNull().alias("failed"), *(c.alias(n) for c, n in zip(outputs.trace(F.col("tokens"), eos, max_new), names, strict=True)))


def direct_run(samples: DataFrame, generator: Callable[[], Generator], folder: str, *, seed: int = 0, eos: int, max_new: int, max_samples: int | None = None) -> DataFrame:
    """A prediction for each sample, by one answer: id, index, seed, prediction, failed, trace, reference.

    samples: id, index, prompt, reference. Only samples with an index below max_samples are run.
    """
    rows = samples if max_samples is None else samples.where(F.col("index") < max_samples)
    found = first_answers(generate(rows, generator, folder, seed=seed), eos=eos, max_new=max_new)
    return found.join(rows.select(F.col("index").cast("long").alias("index"), "reference"), "index")


def direct_summary(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """One row: structure_summary, generation_summary and generation_errors of a direct run. facts: the molecule dimension."""
    named = rows.withColumn("id", F.col("index"))
    return _one_row(evaluate.structure_summary(evaluate.evaluate(named, facts)), evaluate.generation_summary(rows), rows.agg(F.count_if("failed").alias("generation_errors")))


def constrained_run(samples: DataFrame, generator: Callable[[], Generator], folder: str, facts: DataFrame, *, seed: int = 3407, candidates: int = 32, eos: int, max_new: int, max_samples: int | None = None) -> DataFrame:
    """A prediction for each sample, chosen among candidates that its formula admits.

    samples: id, index, prompt, wanted (formula or null), body (of the ranking prompt), exact and connectivity of the
    reference, and support (a map from connectivity to a rate, or null). `candidates` answers make the candidates; those
    left, sorted by support, go into a second prompt if they are more than one, and its answer is the prediction if it is
    one of them. `failed` says that the formula admits none, generation_failed that there was no answer. Both generations have a ledger. A failed generation is a sample without candidates.
    """
    rows = samples if max_samples is None else samples.where(F.col("index") < max_samples)
    rows = rows.withColumn("index", F.col("index").cast("long"))
    found = generate(rows, generator, f"{folder}/candidates", seed=seed, samples=candidates)
    wanted = rows.select("index", "wanted")
    each = found.select("index", F.posexplode_outer("outputs").alias("pos", "o")).withColumn("smiles", outputs.final_smiles(F.col("o")["text"]))
    known = facts.select("smiles", "connectivity", "accepted", "isotopes", "formula")
    each = each.join(wanted, "index").join(known, "smiles", "left").withColumn("accepted", F.coalesce("accepted", F.lit(False)))
    filtered = evaluate.filter_candidates(each.withColumnRenamed("index", "id"))
    none = found.select(F.col("index").alias("id"), F.size("outputs").alias("raw"))
    filtered = filtered.join(none, "id").withColumn("raw_count", F.col("raw")).drop("raw")
    support = rows.where("support is not null").select(F.col("index").alias("id"), F.explode("support").alias("connectivity", "support"))
    reference = rows.select(F.col("index").alias("id"), "exact", "connectivity")

    def rank(lists: DataFrame) -> DataFrame:
        asked = lists.join(rows.select(F.col("index"), F.col("id").alias("name"), "body"), lists["id"] == F.col("index"))
        asked = asked.select(F.col("name").alias("id"), "index", tasks.ranking_prompt(F.col("body"), F.col("candidates")).alias("prompt"))
        answers = generate(asked, generator, f"{folder}/ranking", seed=seed).select("index", outputs.final_smiles(F.get("outputs", F.lit(0))["text"]).alias("smiles"))
        return answers.join(known.select("smiles", F.col("connectivity").alias("answer")), "smiles", "left").select(F.col("index").alias("id"), "answer")

    chosen = evaluate.constrain_and_rank(order.cut(filtered, "filtered"), support, reference, rank).withColumnRenamed("id", "index")
    traces = first_answers(found, eos=eos, max_new=max_new).drop("prediction", "id").withColumnRenamed("failed", "generation_failed")
    return chosen.join(traces, "index")


def constrained_report(rows: DataFrame) -> DataFrame:
    """One row: constrained_summary, generation_summary and generation_errors of a constrained run."""
    return _one_row(evaluate.constrained_summary(rows), evaluate.generation_summary(rows), rows.agg(F.count_if("generation_failed").alias("generation_errors")))
