"""Queries of ingest: records, candidates, pairs, splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from specloom.operators import ingest
from specloom.operators.order import shared_folder
from specloom.plans import adapters as A
from specloom.plans.registry import registry
from specloom.sources.candidate_store import CandidateStore

QUERIES, SQL, query = registry()

#: On these tables a hundred rows cost a point, so that distance matters.
ROWS_A_POINT = 100
CAND = f"""{A.RAW}, cand as (select *, case when nmr_type like '1H%' then '1h' else '13c' end nucleus,
  case when trim(processed) not in ('', '[]') then 100 else 0 end + case when trim(solvent) not in ('', 'not_known', 'nan', 'None') then 10 else 0 end
  + case when trim(solvent) = 'CDCl3' then 5 else 0 end score from raw where nmr_type like '1H%' or nmr_type like '13C%')"""
TOP = f"""{CAND}, topk as (select * from (select *, row_number() over (partition by mol_key, nucleus order by score desc, row_index) rn from cand) z where rn <= 3)"""


@query(f"with {CAND} select row_index, mol_key, nucleus, score from cand")
def p2_record_score(spark, d):
    return ingest.candidates(A.raw_records(spark, d)).select("row_index", "mol_key", "nucleus", "score")


@query(f"""with {A.RAW} select count(*) "rows", count(*) filter (nmr_type not like '19F%') candidates, count(*) filter (nmr_type like '19F%') unsupported from raw""")
def a1_ingest_counters(spark, d):
    return ingest.counters(A.raw_records(spark, d))


@query(f"""with {CAND} select mol_key, count(*) filter (nucleus = '1h') h_count, count(*) filter (nucleus = '13c') c_count from cand group by 1
  having count(*) filter (nucleus = '1h') > 0 and count(*) filter (nucleus = '13c') > 0""")
def j1_both_nuclei(spark, d):
    return ingest.paired_keys(ingest.candidates(A.raw_records(spark, d)))


@query(f"with {TOP} select mol_key, nucleus, row_index, score, rn::int as rank from topk")
def w1_topk_per_nucleus(spark, d):
    return ingest.top_candidates(ingest.candidates(A.raw_records(spark, d))).select("mol_key", "nucleus", "row_index", "score", "rank")


@query(f"""with {TOP}, pairs as (select h.mol_key, h.row_index h_row, c.row_index c_row, h.rn hrn, c.rn crn, h.score + c.score
    + case when h.solvent = c.solvent and h.solvent not in ('', 'not_known') then 1000 else 0 end
    + case when h.solvent = 'CDCl3' and c.solvent = 'CDCl3' then 100 else 0 end - (abs(h.row_index - c.row_index) // {ROWS_A_POINT}) pair_score
  from topk h join topk c on h.mol_key = c.mol_key where h.nucleus = '1h' and c.nucleus = '13c')
select mol_key, h_row, c_row, pair_score::bigint pair_score from (select *, row_number() over (partition by mol_key order by pair_score desc, hrn, crn) r from pairs) y where r = 1""")
def j3_best_pair(spark, d):
    return ingest.best_pairs(ingest.candidates(A.raw_records(spark, d)), rows_a_point=ROWS_A_POINT)


def _stored(spark, d):
    return CandidateStore(spark, shared_folder(spark, "candidates"), 8).write(ingest.candidates(A.raw_records(spark, d))).rows()


@query(SQL["w1_topk_per_nucleus"])
def s4_stored_topk(spark, d):
    return ingest.top_candidates(_stored(spark, d)).select("mol_key", "nucleus", "row_index", "score", "rank")


@query(SQL["j3_best_pair"])
def s4_stored_pairs(spark, d):
    return ingest.best_pairs(_stored(spark, d), rows_a_point=ROWS_A_POINT)


@query("""select o.o_orderkey, o.o_custkey, o.o_orderstatus from orders o where o.o_custkey in (select c_custkey from customer where c_mktsegment = 'BUILDING')""")
def s6_split_semi_join(spark, d):
    ids = A.table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return A.table(spark, d, "orders").join(ids, "o_custkey", "left_semi").select("o_orderkey", "o_custkey", "o_orderstatus")


@query("""with s as (select conv_id, turn, text, row_number() over (partition by conv_id order by turn desc, text desc) r from conversations where text is not null and trim(text) <> '')
select conv_id, turn, text from s where r = 1""")
def s8_last_duplicate(spark, d):
    from specloom.sources.tables import last_of

    rows = A.table(spark, d, "conversations").where("text is not null and trim(text) <> ''")
    return last_of(rows, ["conv_id"], ["turn", "text"]).select("conv_id", "turn", "text")
