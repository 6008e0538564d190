"""Queries of the manifest, splits, curation and hard negatives."""

from __future__ import annotations

from pyspark.sql import functions as F

from specloom.operators import manifest, negatives
from specloom.plans import adapters as A
from specloom.plans.registry import registry

QUERIES, SQL, query = registry()

SPLIT = f"""{A.MANIFEST}, sizes as (select murcko_scaffold, count(*) n, sha256('3407:' || coalesce(murcko_scaffold, '')) h from qc where qc_status = 'pass' group by 1),
run as (select *, coalesce(sum(n) over (order by n desc, h rows between unbounded preceding and 1 preceding), 0) before_n, sum(n) over () total from sizes),
lim as (select *, before_n < floor(total * 0.8) in_train from run),
named as (select murcko_scaffold, case when in_train then 'train' when before_n - sum(case when in_train then n else 0 end) over () < floor(total * 0.1) then 'val' else 'test' end split from lim),
split as (select q.*, case when q.qc_status = 'pass' then n.split else 'excluded' end split from qc q left join named n on q.murcko_scaffold = n.murcko_scaffold)"""
REASON = """case when qc_status <> 'pass' then 'manifest_qc_fail' when len(violations) > 0 then violations[1] when isotope_label_count > 0 then 'isotope_labeled_structure'
  when heavy_atom_count < 2 then 'too_few_heavy_atoms' when heavy_atom_count > 40 then 'too_many_heavy_atoms' when h_peak_count < 1 then 'too_few_1h_peaks'
  when h_peak_count > 80 then 'too_many_1h_peaks' when c_peak_count < 1 then 'too_few_13c_peaks' when c_peak_count > 120 then 'too_many_13c_peaks'
  when trim(h_solvent) <> trim(c_solvent) then 'solvent_mismatch' end"""
ORDER = f"""{SPLIT}, turns as (select *, row_number() over (partition by split, murcko_scaffold order by sha256('3407:' || id), id) turn, sha256('3407:' || murcko_scaffold) sh
  from split where split <> 'excluded'), ordered as (select *, row_number() over (partition by split order by turn, sh) position from turns)"""


def _qc(spark, d):
    return manifest.quality(A.manifest(spark, d))


def _split(spark, d):
    return manifest.scaffold_splits(_qc(spark, d))


def _ordered(spark, d):
    return manifest.balanced_order(_split(spark, d).where("split <> 'excluded'"), by="split")


@query(f"with {A.MANIFEST} select id, qc_status, qc_reason, heavy_atom_count, h_peak_count, c_peak_count from qc")
def p5_manifest_qc(spark, d):
    return _qc(spark, d).select("id", "qc_status", "qc_reason", "heavy_atom_count", "h_peak_count", "c_peak_count")


@query(f"with {A.MANIFEST} select id, {REASON} reject_reason from qc")
def p6_filter_reasons(spark, d):
    return manifest.filtered(_qc(spark, d), heavy=(2, 40), solvents="matched").select("id", "reject_reason")


@query(f"with {A.MANIFEST} select reject_reason, count(*) n from (select {REASON} reject_reason from qc) x where reject_reason is not null group by 1")
def p7_reject_histogram(spark, d):
    rows = manifest.filtered(_qc(spark, d), heavy=(2, 40), solvents="matched")
    return rows.where("reject_reason is not null").groupBy("reject_reason").agg(F.count(F.lit(1)).alias("n"))


@query(f"""with {A.MANIFEST} select id, lower(trim(h_solvent)) not in ('', 'nan', 'none', 'not_known', 'unknown') and lower(trim(c_solvent)) not in ('', 'nan', 'none', 'not_known', 'unknown') known,
  trim(h_solvent) = trim(c_solvent) matched, trim(h_solvent) = 'CDCl3' and trim(c_solvent) = 'CDCl3' cdcl3 from qc""")
def p8_solvent_policies(spark, d):
    rows = _qc(spark, d).withColumns({"qc_status": F.lit("pass"), "violations": F.array().cast("array<string>"), "isotope_label_count": F.lit(0)})
    wide = {"heavy": (0, 1000), "h_peaks": (0, 1000), "c_peaks": (0, 1000)}
    return rows.select("id", *(manifest.reject_reason(solvents=s, **wide).isNull().alias(s) for s in ("known", "matched", "cdcl3")))


@query(f"with {SPLIT} select id, split from split")
def w3_scaffold_split(spark, d):
    return _split(spark, d).select("id", "split")


@query(f"with {A.MANIFEST} select reason, count(*) n from (select unnest(string_split(qc_reason, ';')) reason from qc) x where reason <> '' group by 1")
def a3_qc_reason_counts(spark, d):
    return manifest.reason_counts(_qc(spark, d))


@query(f"with {SPLIT} select split, count(*) n, count(distinct murcko_scaffold) scaffolds from split group by 1")
def a3_split_counts(spark, d):
    return _split(spark, d).groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("murcko_scaffold").alias("scaffolds"))


@query(f"""with {SPLIT}, own as (select distinct split, murcko_scaffold s from split where split <> 'excluded'),
pairs as (select a.split x, b.split y from own a join own b on a.s = b.s)
select count(*) filter (x = 'train' and y = 'val') train_val, count(*) filter (x = 'train' and y = 'test') train_test, count(*) filter (x = 'val' and y = 'test') val_test from pairs""")
def a4_split_overlap(spark, d):
    return manifest.split_overlap(_split(spark, d))


@query(f"with {ORDER} select id, split, turn::int turn, position from ordered")
def w4_balanced_order(spark, d):
    return _ordered(spark, d).select("id", "split", "turn", "position")


@query(f"""with {ORDER}, want(subset, split, n) as (values (100, 'train', 80), (100, 'val', 10), (100, 'test', 10), (500, 'train', 400), (500, 'val', 50), (500, 'test', 50))
select w.subset, o.split, o.id, o.position from ordered o join want w on o.split = w.split where o.position <= w.n""")
def w5_nested_prefix(spark, d):
    return manifest.nested_subsets(_ordered(spark, d), [100, 500])


@query(f"""with recursive {A.MANIFEST}, keyed as (select *, coalesce(nullif(canonical_smiles, ''), id) structure from qc),
g as (select structure, count(*) n, row_number() over (order by sha256('3407:' || structure), structure) rn from keyed group by 1),
want as (select round_even(sum(n) * 0.1, 0)::bigint val, round_even(sum(n) * 0.1, 0)::bigint test from g),
fold(rn, v, t, split) as (select 0::bigint, 0::bigint, 0::bigint, '' union all
  select rn, v + case when split = 'val' then n else 0 end, t + case when split = 'test' then n else 0 end, split from (
    select g.rn, g.n, f.v, f.t, case when f.v / val::double <= f.t / test::double then case when f.v < val then 'val' else 'train' end
      else case when f.t < test then 'test' else 'train' end end split from fold f join g on g.rn = f.rn + 1, want) x)
select k.id, k.canonical_smiles, f.split from keyed k join g on k.structure = g.structure join fold f on f.rn = g.rn""")
def w6_grouped_split(spark, d):
    return manifest.grouped_splits(_qc(spark, d)).select("id", "canonical_smiles", "split")


@query(f"""with {A.MANIFEST} select count(*) samples, count(distinct coalesce(murcko_scaffold, '')) unique_scaffolds, coalesce(min(heavy_atom_count), 0)::int heavy_atom_min,
  coalesce(max(heavy_atom_count), 0)::int heavy_atom_max from qc""")
def a5_subset_summary(spark, d):
    return manifest.summary(_qc(spark, d))


@query(f"with {A.MANIFEST} select trim(h_solvent) h_solvent, trim(c_solvent) c_solvent, count(*) n from qc group by 1, 2 order by n desc, 1, 2 limit 10")
def a5_top_solvents(spark, d):
    return manifest.top_solvents(_qc(spark, d))


PAIRS = f"""{A.MOLECULES}, uniq as (select formula, smiles, min(id) id from molecules group by 1, 2),
allp as (select m.id target_id, m.smiles target, m.formula, u.id, u.smiles from molecules m join uniq u on m.formula = u.formula and m.smiles <> u.smiles),
pool as (select * exclude (r) from (select *, row_number() over (partition by target_id order by sha256('3407:' || target_id || ':' || id), id) r from allp) x where r <= {negatives.POOL})"""
#: The pool of w7_stable_pool, whose feature the cap is; below most groups' size, so that it shows.
SMALL = 16
FACTS = """facts as (select smiles, any_value(ring_scaffold) ring_scaffold, any_value(groups) groups, any_value(bits) bits
  from (select distinct on (smiles) * from molecules order by smiles, id) x group by 1)"""
SCORED = f"""{PAIRS}, {FACTS}, scored as (select p.*, coalesce(a.ring_scaffold <> '' and a.ring_scaffold = b.ring_scaffold, false) same_ring_scaffold,
  case when len(list_distinct(list_concat(a.groups, b.groups))) = 0 then 1.0::double
    else len(list_intersect(a.groups, b.groups))::double / len(list_distinct(list_concat(a.groups, b.groups))) end group_jaccard,
  coalesce(len(list_intersect(a.bits, b.bits))::double / nullif(len(a.bits) + len(b.bits) - len(list_intersect(a.bits, b.bits)), 0), 0) tanimoto
  from pool p join facts a on p.target = a.smiles join facts b on p.smiles = b.smiles)"""


def _facts(spark, d):
    rows = A.molecules(spark, d)
    return rows.groupBy("smiles").agg(F.min_by(F.struct("ring_scaffold", "groups", "bits"), "id").alias("f")).select("smiles", "f.*")


def _pairs(spark, d, pool=negatives.POOL):
    return negatives.formula_pairs(A.molecules(spark, d).select("id", "smiles", "formula"), pool=pool)


def _scored(spark, d):
    return negatives.scored(_pairs(spark, d), _facts(spark, d))


@query(f"with {PAIRS} select target_id, id, formula from allp")
def j5_formula_pairs(spark, d):
    return negatives.formula_pairs(A.molecules(spark, d).select("id", "smiles", "formula"), pool=1 << 30).select("target_id", "id", "formula")


@query(f"with {PAIRS} select target_id, id from pool".replace(f"r <= {negatives.POOL}", f"r <= {SMALL}"))
def w7_stable_pool(spark, d):
    return _pairs(spark, d, SMALL).select("target_id", "id")


@query(f"with {SCORED} select target_id, id, group_jaccard from scored")
def t1_group_jaccard(spark, d):
    return _scored(spark, d).select("target_id", "id", "group_jaccard")


@query(f"with {SCORED} select target_id, id, tanimoto from scored")
def t6_tanimoto(spark, d):
    return _scored(spark, d).select("target_id", "id", "tanimoto")


@query(f"""with {SCORED} select target_id, id, same_ring_scaffold, rank::int rank from (select *, row_number() over (partition by target_id
  order by same_ring_scaffold desc, group_jaccard desc, tanimoto desc, smiles desc) rank from scored) x where rank < 8""")
def w8_hard_negatives(spark, d):
    return negatives.hardest(_pairs(spark, d), _facts(spark, d)).select("target_id", "id", "same_ring_scaffold", "rank")


@query(f"""with {SCORED}, best as (select * from (select *, row_number() over (partition by target_id order by same_ring_scaffold desc, group_jaccard desc, tanimoto desc, smiles desc) rank
  from scored) x where rank < 8), shown as (select target_id, target s from best union select target_id, smiles from best)
select target_id id, string_agg(s, ' ' order by sha256('3407:' || target_id || ':' || s), s) candidates from shown group by 1""")
def w9_display_order(spark, d):
    rows = A.molecules(spark, d).select("id", "smiles", "formula")
    return negatives.sidecar(rows, _facts(spark, d)).select("id", F.array_join("candidates", " ").alias("candidates"))


@query(f"""with {A.MOLECULES}, k as (select formula, count(distinct smiles) kinds from molecules group by 1), x as (select count(*) n, count(*) filter (kinds > 1) s from molecules join k using (formula))
select n input_samples, s candidate_sets, n - s omitted_without_negatives, s / n::double candidate_coverage from x""")
def j6_targets_without_negatives(spark, d):
    return negatives.report(A.molecules(spark, d))
