"""Queries of the resumable runs, with a small generator whose answers follow from prompt and seed."""

from __future__ import annotations

from pyspark.sql import functions as F

from specloom.operators import generation
from specloom.operators.order import shared_folder
from specloom.plans import adapters as A
from specloom.plans.registry import registry

QUERIES, SQL, query = registry()

EOS, MAX_NEW, SEED = 0, 6, 3407


def chains():
    """Alkanes by prompt and seed, one an answer; prompts of a multiple of 13 fail."""

    def answer(prompt: str, seed: int, n: int) -> list[tuple[str, list[int]]]:
        words = prompt.split()
        if words[0] == "order" and int(words[1]) % 13 == 0:
            raise ValueError("no answer")
        size = [1 + (seed + k) % 7 for k in range(n)]
        return [('{"smiles": "' + "C" * s + '"}', [5] * s + ([EOS] if s < MAX_NEW else [])) for s in size]

    return answer


def _samples(spark, d):
    k = F.col("o_orderkey")
    prompt = F.concat(F.lit("order "), k.cast("string"), F.lit(" "), F.col("o_orderpriority"))
    return A.table(spark, d, "orders").select(k.cast("string").alias("id"), k.alias("index"), prompt.alias("prompt"), F.repeat(F.lit("C"), (k % 9 + 1).cast("int")).alias("reference"))


@query(f"""with x as (select o_orderkey k, o_orderkey % 13 = 0 failed, 1 + ({SEED} + o_orderkey) % 7 s from orders)
select k::varchar id, k as index, {SEED} + k seed, case when failed then '' else '{{"smiles": "' || repeat('C', s::int) || '"}}' end prediction, failed,
  case when failed then 0 else s + (s < {MAX_NEW})::int end::int generated_tokens, not failed and s < {MAX_NEW} ended, not failed and s >= {MAX_NEW} truncated, not failed and s >= 6 repeated from x""")
def m4_direct_run(spark, d):
    found = generation.direct_run(_samples(spark, d), chains, shared_folder(spark, "ledger"), seed=SEED, eos=EOS, max_new=MAX_NEW)
    return found.drop("reference")


def _facts(spark):
    """The dimension of the generator's structures; chains of two don't belong to the domain."""
    n = F.col("id").cast("int")
    chain, formula = F.repeat(F.lit("C"), n), F.concat(F.lit("C"), n.cast("string"), F.lit("H"), (2 * n + 2).cast("string"))
    return spark.range(1, 8).select(chain.alias("smiles"), chain.alias("connectivity"), (n != 2).alias("accepted"), F.lit(0).alias("isotopes"), formula.alias("formula"))


_WANTED = "case when k % 3 = 0 then 'C' || (1 + k % 7) || 'H' || (2 * (1 + k % 7) + 2) end"


@query(f"""with x as (select o_orderkey k, o_orderkey % 13 = 0 failed from orders),
c as (select k, pos, 1 + ({SEED} + k + pos) % 7 n from x, range(0, 4) t(pos) where not failed),
f as (select *, 'C' || n || 'H' || (2 * n + 2) formula from c), w as (select k, {_WANTED} wanted from x),
kept as (select f.k, n, pos from f join w on f.k = w.k where n <> 2 and (wanted is null or wanted = formula)),
best as (select k, count(*) left_, arg_min(n, (-(n % 3), pos)) first from kept group by k)
select x.k as index, case when failed then 0 else 4 end raw_count, coalesce(left_, 0)::int selectable, case when left_ > 1 then repeat('C', (case when exists (select 1 from kept where kept.k = x.k and kept.n = 1 + ({SEED} + x.k) % 7) then 1 + ({SEED} + x.k) % 7 else first end)::int)
  else coalesce(repeat('C', first::int), '') end prediction, coalesce(left_, 0) > 1 ranking_attempted,
  coalesce(left_, 0) > 1 and not exists (select 1 from kept where kept.k = x.k and kept.n = 1 + ({SEED} + x.k) % 7) ranking_failed, failed generation_failed from x left join best on x.k = best.k""")
def m5_constrained_run(spark, d):
    k = F.col("o_orderkey")
    chain = F.concat(F.lit("C"), (k % 7 + 1).cast("string"), F.lit("H"), (2 * (k % 7 + 1) + 2).cast("string"))
    rates = F.map_from_entries(F.transform(F.sequence(F.lit(1), F.lit(7)), lambda n: F.struct(F.repeat(F.lit("C"), n), (n % 3).cast("double"))))
    samples = _samples(spark, d).withColumn("o_orderkey", F.col("index")).withColumns({"wanted": F.when(F.col("index") % 3 == 0, chain), "body": F.lit("peaks"), "exact": F.col("reference"), "connectivity": F.col("reference"), "support": rates})
    found = generation.constrained_run(samples, chains, shared_folder(spark, "ledger"), _facts(spark), seed=SEED, candidates=4, eos=EOS, max_new=MAX_NEW)
    return found.select("index", "raw_count", F.size("selectable").alias("selectable"), "prediction", "ranking_attempted", "ranking_failed", "generation_failed")
