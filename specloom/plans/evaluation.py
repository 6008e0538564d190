"""Queries of evaluation: candidates, rankings, summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from specloom.functions.sets import overlap_scores
from specloom.operators import evaluate
from specloom.plans import adapters as A
from specloom.plans.registry import registry

QUERIES, SQL, query = registry()

FILTERED = f"""{A.CANDIDATES}, ok as (select *, row_number() over (partition by id, connectivity order by pos) r from candidates where accepted and isotopes = 0),
lists as (select c.id, count(*) raw_count, max(c.wanted) wanted, count(k.pos) unique_count, coalesce(string_agg(k.connectivity, ',' order by c.pos) filter (k.pos is not null), '') domain_valid,
  coalesce(string_agg(k.connectivity, ',' order by c.pos) filter (k.pos is not null and k.formula = c.wanted), '') formula_valid
  from candidates c left join (select * from ok where r = 1) k on c.id = k.id and c.pos = k.pos group by 1)"""


def _filtered(spark, d):
    return evaluate.filter_candidates(A.candidates(spark, d))


@query(f"""with {FILTERED} select id, raw_count, unique_count::int unique_count, domain_valid, formula_valid, wanted is not null applicable, wanted is not null and formula_valid = '' failed from lists""")
def p10_candidate_filter(spark, d):
    text = lambda n: F.array_join(n, ",").alias(n)
    return _filtered(spark, d).select("id", "raw_count", "unique_count", text("domain_valid"), text("formula_valid"), "applicable", "failed")


@query(f"""with {FILTERED}, s as (select id, case when wanted is not null then formula_valid else domain_valid end sel from lists)
select id, case when sel = '' then '' when list_contains(string_split(sel, ','), 'c' || (id % 4)) then 'c' || (id % 4) else string_split(sel, ',')[1] end prediction,
  not (sel <> '' and list_contains(string_split(sel, ','), 'c' || (id % 4))) failed from s""")
def m2_resolve_ranked(spark, d):
    answer = F.concat(F.lit("c"), (F.col("id") % 4).cast("string"))
    prediction, failed = evaluate.resolve(F.col("selectable"), answer)
    return _filtered(spark, d).select("id", prediction.alias("prediction"), failed.alias("failed"))


@query(f"with {A.CANDIDATES} select id, pos, row_number() over (partition by id order by coalesce(support, 0) desc, pos)::int rank from candidates")
def w10_presort(spark, d):
    return evaluate.presort(A.candidates(spark, d)).select("id", "pos", "rank")


RANKED = f"""{A.H_PEAKS}, firsts as (select id, multiplicity m, min(pos) p from h_peaks group by 1, 2), ranks as (select id, m, row_number() over (partition by id order by p) r from firsts),
total as (select id, count(*) n, count(*) filter (m not in ('brs', 'hept')) v from ranks group by 1), hit as (select t.id, n, v, coalesce(r.r, 0) rank from total t left join ranks r on t.id = r.id and r.m = 't')"""


@query(f"""with {RANKED} select id, (rank > 0)::int::double covered, v / n::double valid_rate, (rank = 1)::int::double top1, (rank between 1 and 3)::int::double hits3, (rank between 1 and 5)::int::double hits5,
  case when rank > 0 then 1.0::double / rank else 0.0::double end mrr from hit""")
def w12_candidate_rank(spark, d):
    rows = A.h_peaks(spark, d).groupBy("id").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("pos", "multiplicity"))), lambda x: x["multiplicity"])).alias("m"))
    valid = F.transform("m", lambda x: ~x.isin("brs", "hept"))
    names = ("covered", "valid_rate", "top1", "hits3", "hits5", "mrr")
    return rows.select("id", *(c.alias(n) for c, n in zip(evaluate.candidate_ranking(F.col("m"), F.lit("t"), valid), names, strict=True)))


EOS, LIMIT = 2, 60
TRACE = f"""{A.TOKENS}, cutoff as (select id, prediction, tokens, list_position(tokens, {EOS}) p from token_rows),
kept as (select id, prediction, case when p > 0 then tokens[1:p] else tokens end t, coalesce(p, 0) > 0 ended from cutoff),
grams as (select id, g, count(*) c from (select id, unnest(list_transform(range(1, greatest(len(t) - 2, 1)), lambda i: array_to_string(t[i:i + 3], ' '))) g from kept) x group by 1, 2),
often as (select distinct id from grams where c >= 3),
traced as (select k.id, prediction, len(t)::int generated_tokens, ended, not ended and len(t) >= {LIMIT} truncated, o.id is not null repeated from kept k left join often o on k.id = o.id)"""


def _traced(spark, d):
    return evaluate.generation_rows(A.token_rows(spark, d), eos=EOS, max_new=LIMIT)


@query(f"with {TRACE} select id, generated_tokens, ended, truncated, repeated from traced")
def w13_repeated_4gram(spark, d):
    return _traced(spark, d).drop("prediction")


@query(f"""with {TRACE} select avg(generated_tokens) mean_generated_tokens, quantile_cont(generated_tokens, 0.5)::double median_generated_tokens, avg(ended::int) eos_rate, avg(truncated::int) truncation_rate,
  avg(repeated::int) repetition_rate, count(distinct trim(prediction))::double / count(*) unique_prediction_rate, 1 - count(distinct trim(prediction))::double / count(*) duplicate_prediction_rate from traced""")
def a15_generation_summary(spark, d):
    return evaluate.generation_summary(_traced(spark, d))


SCORES = f"""{A.LABELLED}, n as (select id, predicted, reference, len(list_intersect(predicted, reference)) s, len(predicted) np, len(reference) nr from labelled),
pr as (select *, case when np = 0 and nr = 0 then 1.0::double when np = 0 then 0 else s / np::double end p, case when np = 0 and nr = 0 then 1.0::double when nr = 0 then 0 else s / nr::double end r from n),
f as (select id, p, r, case when np = 0 and nr = 0 then 1.0::double when p + r > 0 then 2 * p * r / (p + r) else 0 end f1 from pr)"""


@query(f"with {SCORES} select id, p as precision, r as recall, f1 from f")
def t4_group_overlap(spark, d):
    p, r, f = overlap_scores(F.col("predicted"), F.col("reference"))
    return A.labelled(spark, d).select("id", p.alias("precision"), r.alias("recall"), f.alias("f1"))


COUNTS = f"""{A.LABELLED}, pred as (select id, unnest(predicted) label from labelled), ref as (select id, unnest(reference) label from labelled), space(label) as (values ('en'), ('good'), ('never')),
pairs as (select coalesce(p.label, r.label) label, (p.id is not null)::int p, (r.id is not null)::int r from pred p full join ref r on p.id = r.id and p.label = r.label),
sums as (select label, sum(p * r)::bigint tp, sum(p * (1 - r))::bigint fp, sum(r * (1 - p))::bigint fn from pairs group by 1),
counts as (select label, coalesce(tp, 0)::bigint tp, coalesce(fp, 0)::bigint fp, coalesce(fn, 0)::bigint fn from sums full join space using (label)),
scored as (select *, tp + fn support, coalesce(tp / nullif(tp + fp, 0)::double, 0) p, coalesce(tp / nullif(tp + fn, 0)::double, 0) r from counts),
rated as (select *, coalesce(2 * p * r / nullif(p + r, 0), 0) f1 from scored)"""


def _counts(spark, d):
    space = spark.createDataFrame([("en",), ("good",), ("never",)], "label string")
    return evaluate.label_counts(A.labelled(spark, d), space)


@query(f"with {COUNTS} select label, tp, fp, fn, support, p as precision, r as recall, f1 from rated")
def a12_multilabel_per_class(spark, d):
    return _counts(spark, d)


@query(f"""with {COUNTS}, m as (select sum(tp) / (sum(tp) + sum(fp))::double p, sum(tp) / (sum(tp) + sum(fn))::double r, round(avg(f1), 9) macro_f1, round(avg(f1) filter (support > 0), 9) supported_macro_f1 from rated),
e as (select count(*) num_examples, avg((list_sort(predicted) = list_sort(reference))::int) exact_match from labelled)
select num_examples, exact_match, p micro_precision, r micro_recall, 2 * p * r / (p + r) micro_f1, macro_f1, supported_macro_f1 from e, m""")
def a12_multilabel_micro(spark, d):
    rows = evaluate.multilabel_summary(A.labelled(spark, d), _counts(spark, d))
    return rows.withColumns({c: F.round(c, 9) for c in ("macro_f1", "supported_macro_f1")})


@query(f"with {SCORES} select round(avg(p), 9) as precision, round(avg(r), 9) as recall, round(avg(f1), 9) as f1 from f")
def a13_sample_macro(spark, d):
    p, r, f = overlap_scores(F.col("predicted"), F.col("reference"))
    return A.labelled(spark, d).agg(F.round(F.avg(p), 9).alias("precision"), F.round(F.avg(r), 9).alias("recall"), F.round(F.avg(f), 9).alias("f1"))


@query(f"""with {FILTERED}, s as (select *, wanted is not null applicable, wanted is not null and formula_valid = '' failed,
  case when formula_valid = '' then 0 else len(string_split(formula_valid, ',')) end nf from lists)
select count(*) num_examples, avg(applicable::int) formula_constraint_applicable_rate, avg((not failed)::int) filter (applicable) formula_constraint_coverage, avg(failed::int) formula_constraint_failure_rate,
  avg(raw_count) mean_raw_candidate_count, avg(unique_count) mean_unique_candidate_count, avg(unique_count) mean_domain_valid_candidate_count, avg(nf) mean_formula_valid_candidate_count,
  0.0::double candidate_oracle_exact, 0.0::double candidate_oracle_connectivity, 0.0::double ranking_attempt_rate, 0.0::double ranking_failure_rate from s""")
def a14_constrained_summary(spark, d):
    flags = {n: F.lit(False) for n in ("candidate_oracle_exact", "candidate_oracle_connectivity", "ranking_attempted", "ranking_failed")}
    return evaluate.constrained_summary(_filtered(spark, d).withColumns(flags))


@query(f"""with {FILTERED}, {A.CANDIDATES.split(', candidates as ')[0].replace('h_peaks as', 'h_again as')},
sup as (select id, connectivity, max(support) support from candidates group by 1, 2), sel as (select id, case when wanted is not null then formula_valid else domain_valid end sel from lists),
items as (select s.id, connectivity, i from (select id, unnest(string_split(sel, ',')) connectivity, generate_subscripts(string_split(sel, ','), 1) i from sel where sel <> '') s),
ranked as (select i.id, i.connectivity, row_number() over (partition by i.id order by coalesce(support, 0) desc, i) r from items i left join sup on i.id = sup.id and i.connectivity = sup.connectivity)
select s.id, coalesce(r.connectivity, '') prediction, count(a.connectivity) > 1 ranking_attempted, count(a.connectivity) > 1 ranking_failed, coalesce(bool_or(a.connectivity = 'c' || (s.id % 4)), false) candidate_oracle_connectivity
from sel s left join ranked r on s.id = r.id and r.r = 1 left join ranked a on s.id = a.id group by 1, 2""")
def m3_constrained_pipeline(spark, d):
    supports = A.candidates(spark, d).groupBy("id", "connectivity").agg(F.max("support").alias("support"))
    found = _filtered(spark, d)
    reference = found.select("id", F.lit("none").alias("exact"), F.concat(F.lit("c"), (F.col("id") % 4).cast("string")).alias("connectivity"))
    rows = evaluate.constrain_and_rank(found, supports, reference)
    return rows.select("id", "prediction", "ranking_attempted", "ranking_failed", "candidate_oracle_connectivity")


def _structures(spark, d):
    """Prediction rows in the shape that evaluate() gives, from orders."""
    k, t = F.col("o_orderkey"), F.round(F.col("o_totalprice") * 100).cast("bigint")
    flag = lambda m: t % m == 0
    return A.table(spark, d, "orders").select(
        (t % 5 != 0).alias("valid_smiles"), flag(7).alias("exact_match"), flag(6).alias("connectivity_exact_match"), flag(3).alias("formula_match"), ((t % 1001) / 1000.0).alias("tanimoto"),
        A.pick(t % 3, ("compliant", "invalid", "non_bare")).alias("output_state"), ((t % 11) / 10.0).alias("group_precision"), ((t % 13) / 12.0).alias("group_recall"), ((t % 17) / 16.0).alias("group_f1"),
        (k % 4 == 0).alias("reference_stereo"), (k % 3 != 0).alias("ring_scaffold_applicable"), F.when(k % 3 != 0, flag(5)).alias("ring_scaffold_match"), *(flag(m).alias(n) for m, n in zip((2, 3, 5, 7, 11, 13), evaluate.DOMAIN_FLAGS, strict=True)),
    )


ROUNDED = ("mean_tanimoto", "mean_tanimoto_valid_only", "group_precision_sample_macro", "group_recall_sample_macro", "group_f1_sample_macro")
STRUCTURES = """s as (select o_orderkey k, round(o_totalprice * 100)::bigint t from orders), x as (select *, (t % 1001) / 1000.0::double tan from s)"""


@query(f"""with {STRUCTURES} select count(*) num_examples, avg((t % 5 <> 0)::int) valid_smiles, avg((t % 7 = 0)::int) exact_match, avg((t % 6 = 0)::int) connectivity_exact_match, avg((t % 3 = 0)::int) formula_accuracy,
  round(avg(tan), 9) mean_tanimoto, round(avg(tan) filter (t % 5 <> 0), 9) mean_tanimoto_valid_only, quantile_cont(tan, 0.5) median_tanimoto, quantile_cont(tan, 0.25) tanimoto_q25, quantile_cont(tan, 0.75) tanimoto_q75,
  {", ".join(f"avg((tan >= {x})::int) tanimoto_ge_{str(x).replace('.', '_')}" for x in (0.3, 0.5, 0.7, 0.85))},
  avg((t % 3 = 0)::int) output_format_compliant, avg((t % 3 = 1)::int) invalid_bare_output, avg((t % 3 = 2)::int) non_bare_output, round(avg((t % 11) / 10.0::double), 9) group_precision_sample_macro,
  round(avg((t % 13) / 12.0::double), 9) group_recall_sample_macro, round(avg((t % 17) / 16.0::double), 9) group_f1_sample_macro, avg((t % 7 = 0)::int) filter (k % 4 <> 0) exact_match_achiral,
  avg((t % 7 = 0)::int) filter (k % 4 = 0) exact_match_stereo, avg((k % 3 <> 0)::int) ring_scaffold_coverage, avg((t % 5 = 0)::int) filter (k % 3 <> 0) ring_scaffold_match,
  {", ".join(f"avg((t % {m} = 0)::int) {n}" for m, n in zip((2, 3, 5, 7, 11, 13), evaluate.DOMAIN_FLAGS, strict=True))} from x""")
def a6_structure_summary(spark, d):
    rows = evaluate.structure_summary(_structures(spark, d))
    return rows.withColumns({c: F.round(c, 9) for c in ROUNDED})


@query(f"""with {STRUCTURES} select quantile_cont(tan, 0.25) q25, quantile_cont(tan, 0.5) median, quantile_cont(tan, 0.75) q75, round(avg(tan), 9) mean, avg((tan >= 0.3)::int) ge_03 from x""")
def a7_quantiles(spark, d):
    t = F.col("tanimoto")
    return _structures(spark, d).agg(F.percentile(t, F.lit(0.25)).alias("q25"), F.percentile(t, F.lit(0.5)).alias("median"), F.percentile(t, F.lit(0.75)).alias("q75"), F.round(F.avg(t), 9).alias("mean"), evaluate.rate(t >= 0.3).alias("ge_03"))


@query(f"""with {STRUCTURES}, y as (select case when t % 3 <> 0 then tan end v from x) select count(v) / count(*)::double support_coverage, round(avg(v), 9) support_mean, round(avg(coalesce(v, 0)), 9) support_end_to_end from y""")
def a10_support_summary(spark, d):
    rows = A.table(spark, d, "orders").select(F.round(F.col("o_totalprice") * 100).cast("bigint").alias("t"))
    got = evaluate.support_summary(rows.select(F.when(F.col("t") % 3 != 0, (F.col("t") % 1001) / 1000.0).alias("support")))
    return got.withColumns({c: F.round(c, 9) for c in ("support_mean", "support_end_to_end")})


@query("""with l as (select doc_id, quality, toxic from labels), c as (select 'quality' as "check", quality = 1 ok from l union all select 'not_toxic', toxic = 0 from l union all select 'even', quality = 1 from l where doc_id % 2 = 0)
select "check", count(*) applicable, count(*) filter (ok) passed, avg(ok::int) rate from c group by 1""")
def a11_rule_check_rates(spark, d):
    entry = lambda k, v: F.struct(F.lit(k).alias("key"), v.alias("value"))
    good, clean = F.col("quality") == 1, F.col("toxic") == 0
    entries = F.array_compact(F.array(entry("quality", good), entry("not_toxic", clean), F.when(F.col("doc_id") % 2 == 0, entry("even", good))))
    return evaluate.check_rates(A.table(spark, d, "labels").select(F.map_from_entries(entries).alias("checks")))


@query("""select event_type kind, count(*) entries, arg_max(value, event_id) filter (value is not null) last_loss, min(value) best_loss, arg_min(user_id, (value, event_id)) best_step from events group by 1""")
def a17_log_summary(spark, d):
    rows = A.table(spark, d, "events").select(F.col("event_type").alias("kind"), F.col("event_id").alias("pos"), F.col("user_id").alias("step"), F.col("value").alias("loss"))
    return evaluate.log_summary(rows)


@query("""select o.o_orderkey id, o.o_orderstatus prediction, case when o.o_orderkey % 2 = 0 then 'F' else 'O' end reference, o.o_orderstatus = case when o.o_orderkey % 2 = 0 then 'F' else 'O' end matched from orders o""")
def j11_aligned(spark, d):
    rows = A.table(spark, d, "orders")
    p = rows.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("prediction"))
    r = rows.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 2 == 0, "F").otherwise("O").alias("reference"))
    return evaluate.aligned(p, r).select("id", "prediction", "reference", (F.col("prediction") == F.col("reference")).alias("matched"))


@query("""select o_orderkey id, o_comment_ prediction, o_orderstatus reference, false exact_match, case when o_orderkey % 2 = 0 then 0.5 else 0.0 end::double tanimoto
  from (select *, o_orderpriority o_comment_ from orders) x""")
def p11_legacy_rows(spark, d):
    old = A.table(spark, d, "orders").select(F.col("o_orderkey").alias("sample_id"), F.col("o_orderpriority").alias("pred"), F.col("o_orderstatus").alias("ref"), F.when(F.col("o_orderkey") % 2 == 0, 0.5).alias("tanimoto_similarity"))
    return evaluate.upgrade_rows(old)
