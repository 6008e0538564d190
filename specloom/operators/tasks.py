"""Prompts, tasks, chat messages and the masks that train only on responses."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specloom.functions import parsing

STRUCTURE, GROUPS, RANKING, REGIONS = "structure_prediction", "functional_group_recognition", "candidate_ranking", "spectral_region_classification"
TASKS = (STRUCTURE, GROUPS, RANKING, REGIONS)
IGNORED = -100

# The instruction on output, the system message, and the structure prompts; {context} stands for the tables.
OUTPUT = 'Return exactly one JSON object and no other text using this schema: {"smiles":"string (canonical SMILES, or null if insufficient data)"}.'
SYSTEM = """
You are a specialized molecular structure elucidation model for one-dimensional NMR data. 
Analyze the provided 1H NMR and/or 13C NMR information, 
including peak tables, chemical shifts, integrations, multiplicities, coupling constants, solvent, frequency, and any explicitly provided molecular formula. 
Predict the most likely molecular structure based only on the supplied information.
Output exactly one JSON object and nothing else: {"smiles":"string (canonical SMILES, or null if insufficient data)"}.
Do not output reasoning.
Do not include explanations, reasoning steps, Markdown, labels, prefixes, suffixes, code blocks, confidence scores, or alternative structures. 
Do not use hidden target structures, database identifiers, IUPAC names, answer labels, or any information not explicitly present in the input. 
Do not describe peak tables as raw FID data. 
If the data are insufficient, set "smiles" to null.
"""
OPENINGS = (
    "Infer the molecular structure from the one-dimensional 1H NMR and 13C NMR peak tables below. Use the molecular formula when it is provided as a hard constraint.",
    "Determine the unknown compound using the numerical 1H NMR and 13C NMR evidence. Combine chemical shifts, multiplicities, couplings, integrations, carbon signal counts, and any molecular formula shown below.",
    "Act as an expert small-molecule NMR structure elucidation model. Analyze the 1H NMR and 13C NMR peak tables jointly and infer the structure most consistent with all constraints.",
    "Solve the structure of the unknown compound from paired 1D NMR measurements. Treat the 1H NMR and 13C NMR tables as complementary evidence and obey the molecular formula if present.",
    "Use all available tabulated one-dimensional 1H NMR and 13C NMR evidence to predict the canonical molecular structure. Consider proton environments, carbon environments, signal counts, and formula constraints.",
    "Perform direct molecular structure prediction from the given 1H NMR and 13C NMR peak data. Select the structure that best accounts for the combined spectral measurements.",
    "Analyze the tabulated NMR data for an unknown compound. Use the 1H NMR and 13C NMR peak tables together with any supplied molecular formula to identify the structure.",
    "Identify the molecular structure represented by the 1D NMR evidence. Use the numerical 1H NMR and 13C NMR data jointly rather than treating either table independently.",
)
EVIDENCE = "Use the numerical 1H and 13C peak tables."


def opening(index: Column) -> Column:
    """Opening by number; one out of range stops the job."""
    inside = (index >= 0) & (index < len(OPENINGS))
    return F.when(inside, F.get(F.array(*(F.lit(x) for x in OPENINGS)), index.cast("int"))).otherwise(F.raise_error(F.concat(F.lit("no prompt template "), index.cast("string"))))


def context(tables: Column, formula: Column | None = None, rules: Column | None = None) -> Column:
    """Formula line, peak tables and rule context, apart by blank lines; null where a wanted formula is missing."""
    parts = [tables] if rules is None else [tables, rules]
    if formula is None:
        return F.concat_ws("\n\n", *parts)
    given = F.nullif(F.trim(formula), F.lit(""))
    return F.when(given.isNotNull(), F.concat_ws("\n\n", F.concat(F.lit("Molecular formula: "), given), *parts))


def structure_prompt(index: Column, body: Column) -> Column:
    return F.concat(opening(index), F.lit("\n\n"), body, F.lit("\n\n" + OUTPUT))


def groups_prompt(body: Column, labels: tuple[str, ...]) -> Column:
    head = f"{EVIDENCE} Identify the functional groups present in the molecule. Choose labels only from this ontology: {', '.join(labels)}.\n\n"
    return F.concat(F.lit(head), body, F.lit("\n\nReturn only one sorted JSON array of unique functional group labels."))


def regions_prompt(body: Column) -> Column:
    head = f"{EVIDENCE} Classify all observed signals into the controlled overlapping spectral region labels represented by the peak tables.\n\n"
    return F.concat(F.lit(head), body, F.lit('\n\nReturn only a JSON object with keys "1H" and "13C" and sorted unique label arrays.'))


def ranking_prompt(body: Column, candidates: Column) -> Column:
    head = f"{EVIDENCE} Select the best candidate structure using the available spectral evidence.\n\n"
    return F.concat(F.lit(head), body, F.lit("\n\nCandidates:\n"), parsing.numbered(candidates), F.lit("\n\n" + OUTPUT))


def smiles_target(smiles: Column) -> Column:
    return F.to_json(F.struct(smiles.alias("smiles")), {"ignoreNullFields": "false"})


def list_target(labels: Column) -> Column:
    return F.to_json(F.array_sort(F.array_distinct(labels)))


def regions_target(h: Column, c: Column) -> Column:
    none = F.array().cast("array<string>")
    return F.to_json(F.struct(F.coalesce(h, none).alias("1H"), F.coalesce(c, none).alias("13C")))


def task_examples(rows: DataFrame, *, labels: tuple[str, ...], stereo: str = "preserve") -> DataFrame:
    """id, task, prompt, target, reject. rows: id, task, template, body, target, connectivity, groups, h_regions, c_regions,
    candidates. A row that can't be made has a reason in reject, and no prompt."""
    if stereo not in ("preserve", "remove"):
        raise ValueError("stereo must be 'preserve' or 'remove'")
    goal = F.col("target") if stereo == "preserve" else F.col("connectivity")
    task = F.col("task")
    reject = (
        F.when(~task.isin(*TASKS), "unsupported_task")
        .when(goal.isNull(), "invalid_target")
        .when(F.col("body").isNull(), "missing_formula")
        .when((task == RANKING) & ~F.coalesce(F.array_contains("candidates", goal), F.lit(False)), "target_not_in_candidates")
    )
    prompt = (
        F.when(task == STRUCTURE, structure_prompt(F.coalesce("template", F.lit(0)), F.col("body")))
        .when(task == GROUPS, groups_prompt(F.col("body"), labels))
        .when(task == REGIONS, regions_prompt(F.col("body")))
        .otherwise(ranking_prompt(F.col("body"), F.col("candidates")))
    )
    target = F.when(task == GROUPS, list_target(F.col("groups"))).when(task == REGIONS, regions_target(F.col("h_regions"), F.col("c_regions"))).otherwise(smiles_target(goal))
    rows = rows.withColumn("reject", reject)
    kept = F.col("reject").isNull()
    return rows.select("id", "task", F.when(kept, prompt).alias("prompt"), F.when(kept, target).alias("target"), "reject")


def with_fallback(rows: DataFrame, sidecar: DataFrame) -> DataFrame:
    """Candidates of each sample, and structure prediction instead of ranking where it has none."""
    rows = rows.join(sidecar.select("id", "candidates"), "id", "left")
    return rows.withColumn("task", F.when((F.col("task") == RANKING) & (F.coalesce(F.size("candidates"), F.lit(0)) <= 0), STRUCTURE).otherwise(F.col("task")))


def template_index(seed: int, key: Column) -> Column:
    """Template of a sample, the same in any order of reading."""
    return F.pmod(F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(str(seed)), key, F.lit("template")).cast("binary"), 256), 1, 8), 16, 10).cast("bigint"), F.lit(len(OPENINGS)))


def messages(system: Column, prompt: Column, target: Column) -> Column:
    """System, user and assistant message."""
    turn = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    return F.array(turn("system", system), turn("user", prompt), turn("assistant", target))


def render(chat: Column, start: str = "<|im_start|>", end: str = "<|im_end|>") -> Column:
    """A conversation as training text."""
    return F.array_join(F.transform(chat, lambda m: F.concat(F.lit(start), m["role"], F.lit("\n"), m["content"], F.lit(end + "\n"))), "")


def prefix_faults(chat: Column) -> Column:
    """Why a conversation can't be split into prefix and response; null if it can."""
    last = F.element_at(chat, -1)
    return F.when(F.size(chat) < 2, "too_short").when(last["role"] != "assistant", "last_role").when(F.coalesce(F.trim(last["content"]), F.lit("")) == "", "empty_response")


def response_mask(ids: Column, prefix: Column, target: Column) -> Column:
    """Labels: the ids of the target, which begins after `prefix` ids and has `target` ids; all others are ignored."""
    return F.transform(ids, lambda x, i: F.when((i >= prefix) & (i < prefix + target), x).otherwise(F.lit(IGNORED)))


def mask_faults(ids: Column, labels: Column, decoded: Column, expected: Column) -> Column:
    """Why supervised labels aren't exactly the expected response; null if they are."""
    plain = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", "")
    return (
        F.when(F.size(ids) != F.size(labels), "length_mismatch")
        .when(~F.exists(labels, lambda x: x != IGNORED), "no_supervised_tokens")
        .when(F.lower(decoded).rlike(r"</?think>"), "think_tag")
        .when(plain(decoded) != plain(expected), "target_mismatch")
    )


def last_assistant(rows: DataFrame) -> DataFrame:
    """conv_id, text: the last assistant turn that isn't empty."""
    spoken = rows.where((F.col("role") == "assistant") & (F.trim("text") != ""))
    return spoken.groupBy("conv_id").agg(F.max_by("text", "turn").alias("text"))


def tokenize(rows: DataFrame, column: str, tokenizer: str, out: str = "ids", *, length: int | None = None, pad: int = 0) -> DataFrame:
    """Adds token ids by a tokenizer file of the tokenizers library, cut and padded to a length if one is given. A null text is
    empty. The driver reads the file, and tasks get its content, so that executors need no such path."""
    content = rows.sparkSession.sparkContext.broadcast(Path(tokenizer).read_text(encoding="utf-8"))  # a vocabulary, whatever the rows

    @F.pandas_udf("array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from tokenizers import Tokenizer

        own = Tokenizer.from_str(content.value)
        for texts in batches:
            yield pd.Series([e.ids for e in own.encode_batch(texts.fillna("").tolist(), add_special_tokens=False)])

    rows = rows.withColumn(out, run(F.col(column)))
    if length is None:
        return rows
    return rows.withColumn(out, F.slice(F.concat(F.col(out), F.array_repeat(F.lit(pad), length)), 1, length))
