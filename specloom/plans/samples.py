"""Queries of sample assembly: literal tables, peaks, samples, counters, tasks."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from specloom.functions import chemistry, outputs, parsing
from specloom.operators import evaluate, ingest, manifest, tasks
from specloom.plans import adapters as A
from specloom.plans import curation
from specloom.plans.chemistry import STRUCTURES, TRUE_OF
from specloom.plans.registry import registry

QUERIES, SQL, query = registry()

# Each order's tables as Python literals: every form of a 1H tuple, mappings, scalars, missing values, and texts that don't parse.
#: A 1H peak by pos % 6; $s and $r are shifts, $j a coupling. A 13C peak by pos % 5.
H_FORMS = ("('app d', ['$j Hz', '3.1'], '2H', $s, $r)", "($s, 'quintet', [$j, None], '3H')", "($s,)", "{'shift': $s, 'multiplicity': 'BR S', 'J': $j, 'integration': 'n'}", "(None, 'd')", "{'shift': $s}")
C_FORMS = ("($s,)", "($s, $r)", "$s", "None", "('x', '$r ppm')")


def _tables(spark: SparkSession, d: str) -> DataFrame:
    """id, h, c: the texts of an order."""
    rows = A.h_peaks(spark, d).select("id", "pos", F.round(F.col("shift") * 100).cast("bigint").alias("s"), F.col("integration").cast("int").alias("n"))
    cents = lambda v: F.concat(F.floor(v / 100).cast("string"), F.lit("."), F.lpad((v % 100).cast("string"), 2, "0"))

    marks = {"$s": cents(F.col("s")), "$r": cents(F.col("s") + F.col("n")), "$j": cents(F.col("n") * 110)}

    def filled(forms: tuple[str, ...]) -> Column:
        texts = [F.concat(*(marks.get(x, F.lit(x)) for x in re.split(r"(\$[srj])", form) if x)) for form in forms]
        out = texts[-1]
        for k, text in reversed(list(enumerate(texts[:-1]))):
            out = F.when(F.col("pos") % len(forms) == k, text).otherwise(out)
        return out

    both = rows.select("id", "pos", filled(H_FORMS).alias("h"), filled(C_FORMS).alias("c")).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("pos", "h", "c"))).alias("p"))
    both = both.select("id", F.array_join("p.h", ", ").alias("h"), F.array_join("p.c", ", ").alias("c"))
    broken = lambda t: F.when(F.col("id") % 13 == 0, F.concat(F.lit("["), t)).when(F.col("id") % 17 == 0, "").when(F.col("id") % 19 == 0, "nan").otherwise(F.concat(F.lit("["), t, F.lit("]")))
    return both.select("id", broken(F.col("h")).alias("h"), F.when(F.col("id") % 11 == 0, "[]").otherwise(broken(F.col("c"))).alias("c"))


def _sql_filled(forms: tuple[str, ...]) -> str:
    listed = ", ".join("'" + f.replace("'", "''") + "'" for f in forms)
    cents = lambda v: f"(({v}) // 100) || '.' || lpad((({v}) % 100)::varchar, 2, '0')"
    text = f"list_extract([{listed}], (pos % {len(forms)})::int + 1)"
    for mark, value in (("$s", "s"), ("$r", "s + n"), ("$j", "n * 110")):
        text = f"replace({text}, '{mark}', {cents(value)})"
    return text


def _sql_json(text: str) -> str:
    """A literal as JSON, null where it is none."""
    for old, new in (("''''", "'\"'"), ("'('", "'['"), ("')'", "']'"), ("',]'", "']'"), ("'None'", "'null'")):
        text = f"replace({text}, {old}, {new})"
    return f"case when {text} like '[%' and json_valid({text}) then {text}::json end"


def _sql_number(text: str) -> str:
    return f"try_cast(nullif(regexp_extract({text}, '{parsing.NUMBER}'), '') as double)"


TABLES = f"""{A.H_PEAKS}, forms as (select id, pos, {_sql_filled(H_FORMS)} h, {_sql_filled(C_FORMS)} c from (select id, pos, round(shift * 100)::bigint s, integration::int n from h_peaks) x),
listed as (select id, string_agg(h, ', ' order by pos) h, string_agg(c, ', ' order by pos) c from forms group by 1),
broken as (select id, {", ".join(f"case when id % 13 = 0 then '[' || {n} when id % 17 = 0 then '' when id % 19 = 0 then 'nan' else '[' || {n} || ']' end {n}" for n in "hc")} from listed),
texts as (select id, h, case when id % 11 = 0 then '[]' else c end c from broken), parsed as (select id, {_sql_json("h")} h, {_sql_json("c")} c from texts),
h_items as (select id, generate_subscripts(x, 1) pos, unnest(x) e from (select id, h::json[] x from parsed where h is not null) y),
h_fields as (select id, pos, json_type(e) kind, coalesce(json_array_length(e), 0) len, e->>'$[0]' a, e->>'$[1]' b, e->>'$[2]' c, e->>'$[3]' d, e->>'$[4]' f, e from h_items),
h_kinds as (select *, kind = 'ARRAY' and len >= 5 and {_sql_number("a")} is null and {_sql_number("d")} is not null and {_sql_number("f")} is not null source from h_fields),
h_named as (select id, pos, source, {_sql_number("d")} hi, {_sql_number("f")} lo,
  {_sql_number("case when kind = 'OBJECT' then e->>'$.shift' else a end")} shift, case when source then a when kind = 'OBJECT' then e->>'$.multiplicity' else b end mult,
  case when source then e->'$[1]' when kind = 'OBJECT' then e->'$.J' else e->'$[2]' end js, case when source then c when kind = 'OBJECT' then e->>'$.integration' else d end area from h_kinds),
h_made as (select id, row_number() over (partition by id order by pos)::int pos, case when source then (hi + lo) / 2 else shift end shift,
  case when mult is null then 's' when lower(replace(mult, ' ', '')) = 'quintet' then 'p' when lower(replace(mult, ' ', '')) = 'brs' then 'brs' else regexp_replace(lower(replace(mult, ' ', '')), '^app', '') end multiplicity,
  list_filter(list_transform(case when json_type(js) = 'ARRAY' then (js->>'$[*]') else [js->>'$'] end, lambda x: {_sql_number("x")}), lambda x: x is not null) j,
  coalesce({_sql_number("area")}, 1.0) integration, case when source then least(hi, lo) end low, case when source then greatest(hi, lo) end high from h_named where source or shift is not null),
c_items as (select id, generate_subscripts(x, 1) pos, unnest(x) e from (select id, c::json[] x from parsed where c is not null) y),
c_made as (select id, row_number() over (partition by id order by pos)::int pos, s from (select id, pos,
  list_filter(list_transform(case when json_type(e) = 'ARRAY' then (e->>'$[*]') else [e->>'$'] end, lambda x: {_sql_number("x")}), lambda x: x is not null) s from c_items) y where len(s) > 0)"""


def _parsed(spark: SparkSession, d: str) -> DataFrame:
    return _tables(spark, d).withColumns({"h_raw": ingest.literals(F.col("h"), ingest.H_FIELDS), "c_raw": ingest.literals(F.col("c"))})


@query(f"with {TABLES} select id, h is not null h_parses, c is not null c_parses, json_array_length(h)::int h_tuples, json_array_length(c)::int c_tuples from parsed")
def f2_literals(spark, d):
    size = lambda c: F.when(F.col(c).isNotNull(), F.size(c))
    return _parsed(spark, d).select("id", F.col("h_raw").isNotNull().alias("h_parses"), F.col("c_raw").isNotNull().alias("c_parses"), size("h_raw").alias("h_tuples"), size("c_raw").alias("c_tuples"))


@query(f"with {TABLES} select id, pos, len(s)::int shifts, s[1] first_shift, s[-1] last_shift from c_made")
def f7_carbon_peaks(spark, d):
    rows = _parsed(spark, d).select("id", F.posexplode(ingest.c_table(F.col("c_raw"))).alias("pos", "p"))
    return rows.select("id", (F.col("pos") + 1).alias("pos"), F.size("p.shifts").alias("shifts"), F.element_at("p.shifts", 1).alias("first_shift"), F.element_at("p.shifts", -1).alias("last_shift"))


@query(f"with {TABLES} select id, pos, shift, multiplicity, len(j)::int couplings, j[1] first_j, integration, low, high from h_made")
def f8_proton_peaks(spark, d):
    rows = _parsed(spark, d).select("id", F.posexplode(ingest.h_table(F.col("h_raw"))).alias("pos", "p"))
    ends = F.col("p.shift_range")
    return rows.select("id", (F.col("pos") + 1).alias("pos"), "p.shift", "p.multiplicity", F.size("p.J").alias("couplings"), F.get("p.J", F.lit(0)).alias("first_j"), "p.integration", F.get(ends, F.lit(0)).alias("low"), F.get(ends, F.lit(1)).alias("high"))


#: Structures in the kernel's own canonical writing, with their formulas; those without one aren't accepted.
CANONICAL = (("CCO", "C2H6O"), ("CC(C)O", "C3H8O"), ("O=C1CCCCC1", "C6H10O"), ("C[SeH]", None), ("not_a_smiles", None))
NAMED = ", ".join(f"({k}, '{s}', {'null' if f is None else repr(f)})" for k, (s, f) in enumerate(CANONICAL))


def _samples(spark: SparkSession, d: str) -> DataFrame:
    record = lambda n: F.struct(F.col(n).alias("processed"), *(F.concat(F.lit(f"{n}-{x}-"), F.col("id").cast("string")).alias(x) for x in ("filename", "page_mol", "page_para", "location_mol", "location_para", "frequency", "solvent")))
    key = A.pick(F.col("id") % len(CANONICAL), tuple(s for s, _ in CANONICAL))
    pairs = _tables(spark, d).select(key.alias("mol_key"), record("h").alias("h"), record("c").alias("c"))
    return ingest.samples(pairs, chemistry.facts(pairs.select(F.col("mol_key").alias("smiles"))))


SAMPLES = f"""{TABLES}, named(k, smiles, formula) as (values {NAMED}),
samples as (select p.id key, 'nmr-' || substr(sha256(n.smiles), 1, 16) id, n.smiles canonical_smiles, n.formula molecular_formula, 'c-filename-' || p.id c_file, 'h-location_para-' || p.id h_place, 'h-solvent-' || p.id h_solvent,
  coalesce(h.n, 0)::int h_peaks, coalesce(c.n, 0)::int c_peaks from parsed p join named n on p.id % {len(CANONICAL)} = n.k
  left join (select id, count(*) n from h_made group by 1) h on h.id = p.id left join (select id, count(*) n from c_made group by 1) c on c.id = p.id
  where n.formula is not null and p.h is not null and p.c is not null)"""


@query(f"with {SAMPLES} select * exclude (key) from samples")
def p4_samples(spark, d):
    size = lambda n: F.size(f"{n}.peaks")
    return _samples(spark, d).select(
        "id", "canonical_smiles", "molecular_formula", F.col("meta.source_13c.filename").alias("c_file"), F.col("meta.source_1h.location_para").alias("h_place"), F.col("h1_nmr.solvent").alias("h_solvent"), size("h1_nmr").alias("h_peaks"), size("c13_nmr").alias("c_peaks")
    )


@query(f"with {SAMPLES} select canonical_smiles from samples order by 1 limit 20")
def o3_first_samples(spark, d):
    return ingest.first_samples(_samples(spark, d), 20).select("canonical_smiles")


def _records(spark: SparkSession, d: str) -> DataFrame:
    """smiles, nmr_type: raw records with structures of every kind, from part."""
    k = F.col("p_partkey")
    return A.table(spark, d, "part").select(A.pick(k % len(STRUCTURES), tuple(s[0] for s in STRUCTURES)).alias("smiles"), A.pick(k % 7, ("1H NMR", "13C NMR", "1 H", "13c", "1H", "19F NMR", "")).alias("nmr_type"))


RECORDS = f"{TRUE_OF}, records as (select t.*, id % 7 < 5 kept, heavy is not null and violations = '' accepted from t)"


@query(f"""with {RECORDS} select count(*) rows_seen, count(*) filter (kept and accepted) candidate_rows, count(*) filter (kept and heavy is null) invalid_smiles, count(*) filter (not kept) unsupported_nmr_rows,
  count(*) filter (kept and accepted and isotopes > 0) isotope_normalized_rows, coalesce(sum(isotopes) filter (kept and accepted), 0)::bigint isotope_labels_removed from records""")
def a1_molecule_counters(spark, d):
    rows = _records(spark, d)
    return ingest.molecule_counters(rows, chemistry.facts(rows))


@query(f"""with {RECORDS} select case when heavy is null then 'invalid_smiles' else violations end violation, count(*) n from records where kept and not accepted group by 1""")
def a1_rejections(spark, d):
    rows = _records(spark, d)
    return ingest.rejections(rows, chemistry.facts(rows))


@query(f"with {curation.SPLIT} select split, count(*) n from split group by 1")
def a5_split_sizes(spark, d):
    return manifest.split_sizes(curation._split(spark, d))


FUNNEL = ("raw_count", "unique_count", "failed")


@query("""select event_type run, avg(value) raw_count, avg(coalesce(case when event_id % 3 > 0 then event_id % 8 end, 0)) unique_count, avg((user_id % 4 = 0)::int) failed
  from (select event_type, event_id, user_id, coalesce(round(value), 0)::double value from events) x group by 1""")
def a18_funnel_means(spark, d):
    rows = A.table(spark, d, "events").select(F.col("event_type").alias("run"), F.round("value").alias("raw_count"), F.when(F.col("event_id") % 3 > 0, F.col("event_id") % 8).alias("unique_count"), (F.col("user_id") % 4 == 0).alias("failed"))
    return evaluate.funnel_means(rows, FUNNEL)


TASK_ROWS = f"""listed as (select p_partkey id, case when p_partkey % 5 = 4 then 'unknown' else {A.sql_pick("p_partkey % 5 % 4", tasks.TASKS)} end task, p_partkey % 8 template, case when p_partkey % 11 <> 0 then 'tables ' || p_size end body,
  case when p_partkey % 13 <> 0 then p_brand end target, case when p_partkey % 3 = 0 then [p_brand, p_type] when p_partkey % 3 = 1 then [p_type] end candidates from part)"""


def _task_rows(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Samples without candidates, and the sidecar of those that have some."""
    k, text = F.col("p_partkey"), F.array("p_type")
    rows = A.table(spark, d, "part").select(
        k.alias("id"),
        F.when(k % 5 == 4, "unknown").otherwise(A.pick(k % 5 % 4, tasks.TASKS)).alias("task"),
        (k % 8).cast("int").alias("template"),
        F.when(k % 11 != 0, F.concat(F.lit("tables "), F.col("p_size").cast("string"))).alias("body"),
        F.when(k % 13 != 0, F.col("p_brand")).alias("target"),
        F.col("p_name").alias("connectivity"),
        F.array("p_type", "p_brand", "p_type").alias("groups"),
        text.alias("h_regions"),
        F.array().cast("array<string>").alias("c_regions"),
    )
    sidecar = A.table(spark, d, "part").where(k % 3 != 2).select(k.alias("id"), F.when(k % 3 == 0, F.array("p_brand", "p_type")).otherwise(text).alias("candidates"))
    return rows, sidecar


@query(f"with {TASK_ROWS} select id, case when task = '{tasks.RANKING}' and candidates is null then '{tasks.STRUCTURE}' else task end task, len(candidates)::int candidates from listed")
def j7_ranking_fallback(spark, d):
    return tasks.with_fallback(*_task_rows(spark, d)).select("id", "task", F.when(F.col("candidates").isNotNull(), F.size("candidates")).alias("candidates"))


_OPENINGS = ", ".join("'" + o.replace("'", "''") + "'" for o in tasks.OPENINGS)
GROUPS_OFFERED = ("alcohol", "ether")


@query(f"""with {TASK_ROWS}, f as (select * replace (case when task = '{tasks.RANKING}' and candidates is null then '{tasks.STRUCTURE}' else task end as task), chr(10) || chr(10) gap from listed),
r as (select f.*, case when task = 'unknown' then 'unsupported_task' when target is null then 'invalid_target' when body is null then 'missing_formula'
  when task = '{tasks.RANKING}' and not list_contains(candidates, target) then 'target_not_in_candidates' end reject from f)
select r.id, task, reject, case when reject is not null then null when task = '{tasks.STRUCTURE}' then list_extract([{_OPENINGS}], template::int + 1) || gap || body || gap || '{tasks.OUTPUT}'
  when task = '{tasks.GROUPS}' then '{tasks.EVIDENCE} Identify the functional groups present in the molecule. Choose labels only from this ontology: {", ".join(GROUPS_OFFERED)}.' || gap || body || gap || 'Return only one sorted JSON array of unique functional group labels.'
  when task = '{tasks.REGIONS}' then '{tasks.EVIDENCE} Classify all observed signals into the controlled overlapping spectral region labels represented by the peak tables.' || gap || body || gap || 'Return only a JSON object with keys "1H" and "13C" and sorted unique label arrays.'
  else '{tasks.EVIDENCE} Select the best candidate structure using the available spectral evidence.' || gap || body || gap || 'Candidates:' || chr(10) || '1. ' || candidates[1] || chr(10) || '2. ' || candidates[2] || gap || '{tasks.OUTPUT}' end prompt,
  case when reject is not null then null when task = '{tasks.GROUPS}' then '["' || least(p_type, p_brand) || '","' || greatest(p_type, p_brand) || '"]' when task = '{tasks.REGIONS}' then '{{"1H":["' || p_type || '"],"13C":[]}}'
  else '{{"smiles":"' || target || '"}}' end target from r join part on r.id = p_partkey""")
def g1_task_examples(spark, d):
    return tasks.task_examples(tasks.with_fallback(*_task_rows(spark, d)), labels=GROUPS_OFFERED)


# Predictions are the reference in another writing (as JSON, or bare), or another molecule in a fenced block.
READ = "heavy is not null"
LIKE = f"(id % 3 < 2 and {READ} or id % 3 = 2 and coalesce(stereo, false))"


@query(f"""with {TRUE_OF}, m as (select *, {READ} or id % 3 = 2 valid, {LIKE} same_skeleton from t)
select id, valid valid_smiles, id % 3 < 2 and {READ} exact_match, same_skeleton connectivity_exact_match, same_skeleton formula_match, coalesce(stereo, false) reference_stereo, coalesce(ring, '') <> '' ring_scaffold_applicable,
  case when coalesce(ring, '') <> '' then same_skeleton end ring_scaffold_match, valid and (not same_skeleton or parts = 1) is_single_component, valid and (not same_skeleton or charge = 0) is_neutral,
  valid and (not same_skeleton or radicals = 0) has_no_radicals, valid and (not same_skeleton or isotopes = 0) has_no_isotope_labels, valid and (not same_skeleton or violations not like 'unsupported%') has_only_allowed_elements,
  valid and (not same_skeleton or violations = '' and isotopes = 0) domain_valid_smiles, case when id % 3 < 2 then ({READ})::int::double end tanimoto_of_equal from m""")
def m1_row_evaluator(spark, d):
    """The evaluator on the real kernel: one row of metrics for each prediction."""
    k = F.col("p_partkey")
    of = lambda i: A.pick(k % len(STRUCTURES), tuple(s[i] for s in STRUCTURES))
    text = F.when(k % 3 == 0, F.to_json(F.struct(of(1).alias("smiles")))).when(k % 3 == 1, of(1)).otherwise(F.concat(F.lit("```smiles\n"), of(2), F.lit("\n```")))
    rows = A.table(spark, d, "part").select(k.alias("id"), text.alias("prediction"), of(0).alias("reference"))
    every = rows.select(F.explode(F.array(outputs.final_smiles(F.col("prediction")), F.col("reference"))).alias("smiles"))
    got = evaluate.evaluate(rows, chemistry.facts(every))
    names = ("valid_smiles", "exact_match", "connectivity_exact_match", "formula_match", "reference_stereo", "ring_scaffold_applicable", "ring_scaffold_match", *evaluate.DOMAIN_FLAGS)
    return got.select("id", *names, F.when(F.col("id") % 3 < 2, F.col("tanimoto")).alias("tanimoto_of_equal"))
